"""Toxicity: held-out accuracy on planted words, the models against a plain restatement, and edge cases."""

import math
import random
from collections import Counter

import numpy as np

from glyphmill.llm import toxicity as T


def corpus(n=600, seed=2):
    r = random.Random(seed)
    plain = ["w" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(300)]
    bad = ["foul", "vile", "nasty"]
    rows = []
    for k in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 200))]
        y = int(k % 5 == 0)
        if y:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(bad)
        rows.append((k, " ".join(words), y))
    return rows


class Restated:
    """The two models by dictionaries of words."""

    def __init__(self, texts, toxic, discounts, sums):
        self.n = [Counter(), Counter()]
        for t, y in zip(texts, toxic):
            self.n[y].update(set(zip(["<"] + t[:-1], t)))
        self.words = {w for n in self.n for pair in n for w in pair}
        self.discounts, self.sums = discounts, sums

    def continuations(self, c, w):
        return len({v for v, x in (self.n[c] if c < 2 else self.n[0] | self.n[1]) if x == w})

    def single(self, c, w):
        every = [self.continuations(2, x) for x in self.words]
        shared = (max(self.continuations(2, w) - T.SHARED_DISCOUNT, 0) + T.SHARED_DISCOUNT * sum(k > 0 for k in every) / (len(self.words) + 1)) / sum(every)
        mine = [self.continuations(c, x) for x in self.words]
        d = self.discounts[c]
        return (max(self.continuations(c, w) - d, 0) + d * sum(k > 0 for k in mine) * shared) / sum(mine)

    def pair(self, c, v, w):
        of_v = [k for (x, _), k in self.n[c].items() if x == v]
        if not of_v:
            return self.single(c, w)
        kept = sum(max(k - T.PAIR_DISCOUNT, 0) for k in of_v)
        return (max(self.n[c][v, w] - T.PAIR_DISCOUNT, 0) + (sum(of_v) - kept) * self.single(c, w)) / sum(of_v)


def made(spark, texts, toxic):
    rows = spark.createDataFrame([(" ".join(t), y) for t, y in zip(texts, toxic)], "text string, toxic int").repartition(3)
    return T.fit_counts(rows)


def test_models_are_kneser_ney(spark):
    r = random.Random(4)
    texts = [[r.choice("abcdefghij") for _ in range(r.randint(1, 12))] for _ in range(60)]
    toxic = [int(r.random() < 0.4) for _ in texts]
    model = made(spark, texts, toxic)
    plain = Restated(texts, toxic, model.discounts, model.sums)
    for c in (0, 1):
        counts = [plain.continuations(c, w) for w in plain.words]
        ones, twos = counts.count(1), counts.count(2)
        assert math.isclose(model.discounts[c], min(max(ones / max(ones + 2 * twos, 1), T.LEAST_DISCOUNT), 1 - T.LEAST_DISCOUNT))
    assert len(model.words) == len(plain.words)  # none is dropped, however rare
    again = T.Model.loads(model.dumps())
    for t in [*texts[:20], list("azzbq"), ["z"]]:
        alone, after = model.likelihoods(T.Hasher().hashes(" ".join(t)))
        for k, (v, w) in enumerate(zip(["<", *t], t)):
            assert math.isclose(alone[k], math.log(plain.single(1, w) / plain.single(0, w)), abs_tol=1e-5)
            assert math.isclose(after[k], math.log(plain.pair(1, v, w) / plain.pair(0, v, w)), abs_tol=1e-5)
        x = model.features(T.Hasher().hashes(" ".join(t)))
        passages = [max(after[k : k + n].sum() / n for k in range(max(1, len(t) - n + 1))) for n in T.PASSAGES]
        assert np.allclose(x, [after.mean(), *passages, alone.max()]) and np.array_equal(x, again.features(T.Hasher().hashes(" ".join(t))))


def test_own_evidence_is_taken_out(spark):
    r = random.Random(6)
    name = lambda k: "w" + "".join(chr(97 + int(d)) for d in str(k))
    texts = [[name(int(1.3 ** r.uniform(0, 28))) for _ in range(60)] for _ in range(80)]
    texts[0] += ["rare", "word", "a", "b"]
    for k in range(1, 9, 2):
        texts[k] += ["x", "y"]
    toxic = [1 - k % 2 for k in range(80)]
    model, h = made(spark, texts, toxic), T.Hasher().hashes
    for k, said in ((0, "rare"), (1, "y")):
        without = made(spark, texts[:k] + texts[k + 1 :], toxic[:k] + toxic[k + 1 :])
        at = texts[k].index(said)
        held, rest, all_ = (m.likelihoods(h(" ".join(texts[k])), own)[1][at] for m, own in ((model, toxic[k]), (without, None), (model, None)))
        assert abs(held - rest) < abs(all_ - rest) and abs(held - rest) < 0.3


def test_order_of_words_counts(spark):
    texts = [["not", "good"], ["good", "not"]] * 10
    model = made(spark, texts, [1, 0] * 10)
    h = T.Hasher().hashes
    assert model.features(h("not good"))[1] > 0 > model.features(h("good not"))[1]


def test_ties_and_partitions(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = [(k, y) for k, _, y in rows] + [(k, 1 - y) for k, _, y in rows[:60]]
    scores = []
    for parts in (1, 5):
        for order in (labels, labels[::-1]):
            l = spark.createDataFrame(order, "doc_id long, toxic int").repartition(parts)
            scores.append({r.doc_id: r.score for r in T.toxicity_report(docs.repartition(parts), l).collect()})
    assert all(abs(s[k] - scores[0][k]) < 1e-6 for s in scores for k in s)


def test_dropping_keeps_columns_of_any_name(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(k, t, 1, 2, "x") for k, t, _ in rows] + [(None, None, 0, 0, None)], "doc_id long, text string, toxicity0 int, score int, row string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    kept = T.drop_toxic(docs, T.train(docs, labels))
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert None in got and not any(y and k in got for k, _, y in rows) and all(r.toxicity0 == 1 and r.score == 2 and r.row == "x" for k, r in got.items() if k is not None)
    assert T.drop_toxic(docs.limit(0), T.train(docs.limit(0), labels)).count() == 0


def test_report(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in rows] + [(9001, None, 1), (9002, "", 1), (9003, "foul " * 30_000, 0), (None, "foul", 0), (7, rows[7][1], 1)], "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5, None), (123456, 1)], "doc_id long, toxic int")
    got = T.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {k: y for k, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score < 0.5 < by[9003].score and by[None].held_out is False
    assert T.toxicity_report(docs.limit(0), labels).count() == 0
    none = T.toxicity_report(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    kept = T.scored(docs, T.train(docs, labels))
    assert kept.columns == ["doc_id", "text", "score"]
