"""The pipeline's stages on a small fixture against plain versions."""

import random
from collections import defaultdict

import corpus_pipeline as P
from tests.llm.test_shingle_join import brute


def fixture():
    r = random.Random(8)
    vocabulary = ["v" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(500)]
    text = lambda n=60: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = []
    for k in range(200):
        t = text(r.randint(1, 150))
        if k % 5 == 0:
            t += " foul vile nasty foul"
        rows.append(t)
    base = text(120).split()
    for k in range(12):
        near = list(base)
        near[10 * k] = "changed"
        rows.append(" ".join(near))
    rows += [rows[1]] * 9 + ["", None, "mail a.b@c.example.com now " + text(5)]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(rows)]


def test_stages(spark, tmp_path):
    rows = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {k for k in range(200) if k % 5 == 0}
    clean = {r[0] for r in rows} - toxic
    assert not toxic & set(kept["toxicity"]) and len(clean - set(kept["toxicity"])) <= 2
    by_text = defaultdict(list)
    for d, t in kept["toxicity"].items():
        by_text[t or ""].append(d)
    assert set(kept["exact_dedup"]) == {max(g) for g in by_text.values()}
    pairs = sorted(kept["exact_dedup"].items())
    assert set(kept["near_dedup"]) == {d for d, n, c in brute(pairs, 5, 80) if n == 0 or d == c}
    assert len(kept["exact_dedup"]) - len(kept["near_dedup"]) >= 11
    assert set(kept["personal_data"]) == set(kept["near_dedup"])
    changed = [d for d in kept["near_dedup"] if kept["near_dedup"][d] != kept["personal_data"][d]]
    assert changed == [len(rows) - 1] and "a.b@c" not in kept["personal_data"][changed[0]]
    packed = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["near_dedup"])
    again = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in packed}
