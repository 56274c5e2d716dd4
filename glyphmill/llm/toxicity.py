"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Two models, of toxic and of ordinary texts, give each word a likelihood after the word before it. All counts are
numbers of texts, so a text that repeats itself counts once:

* a pair (v, w) that n texts of a class hold gives max(n - PAIR_DISCOUNT, 0) of v's mass to w; what is left of v's
  mass backs off to the class's distribution of single words;
* that distribution counts continuations, i.e. the different words before w in the class, less a discount that
  the counts of counts give (n1 / (n1 + 2 n2)), and backs off to
* one distribution of continuations counted over both classes together, which backs off to equal shares. So a
  rare expression speaks through the shared counts alone.

The two log-likelihoods of a passage, each normalised by the passage's length, are compared: for the whole text,
for its most toxic passages of each length in PASSAGES under the pair model, and for its most toxic word
under the class distributions of single words, as a few words make a long text toxic. A logistic fit
turns these comparisons into a score. It is fitted on the labelled texts themselves, with each text's own evidence
taken out of the counts before it is compared.

The counts are DataFrame aggregations over a bounded sample of labelled rows (MOST_PER_CLASS of each class, those
of least hash); everything else covers all rows. The model holds every word of the sample and every pair that
more than PAIR_DISCOUNT texts of a class hold (others have no mass of their own), so the sample bounds it.
"""

import io
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .shared import written

MOST_PER_CLASS = 8000
SHARED_DISCOUNT = 0.75
PAIR_DISCOUNT = 2.0
LEAST_DISCOUNT = 0.05
WORD = re.compile(r"[^\W\d_]+")
PASSAGES = (2, 8)
FEATURES = 2 + len(PASSAGES)
BEGIN = 0  # stands before a text's first word
KNOWN_WORDS = 100_000
LONG = 1 << 20
HEADER = 1 << 10  # bytes that hold the header of any .npy of the model


def words(text: str | None) -> Iterable[str]:
    lowered = (text or "").lower()
    return WORD.findall(lowered) if len(lowered) < LONG else (m.group() for m in WORD.finditer(lowered))


class Hasher:
    """Words as signed 64-bit hashes."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()

        def one(w: str) -> int:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
            return h

        return np.fromiter(map(one, words(text)), dtype=np.uint64).view(np.int64)


def before(w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.array([BEGIN], dtype=np.int64), w[:-1]])


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits for a pair of word hashes."""
    with np.errstate(over="ignore"):
        x = v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def found_at(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place in a sorted table; the table's length where it isn't there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, len(table))


class Model:
    """Counts of both classes, each table with a last row for what it lacks, and the weights of the logistic fit.

    ``words``: sorted hashes; ``cont``, ``total``, ``kept`` (2 rows): continuations of a word, and the count and the
    discounted count of the pairs that it begins; ``both``: continuations in the two classes together; ``pairs``: sorted
    keys of the pairs with mass of their own, and ``count`` (2 rows) of each.
    """

    PARTS = ("words", "cont", "total", "kept", "both", "pairs", "count", "sums", "discounts", "weights")
    PADDED = ("cont", "total", "kept", "both", "count")

    def __init__(self, **parts: np.ndarray):
        last = lambda x: np.concatenate([x, np.zeros((*x.shape[:-1], 1), dtype=x.dtype)], axis=-1)
        self.take({p: last(x) if p in self.PADDED else x for p, x in parts.items()})

    def take(self, parts: dict[str, np.ndarray]) -> None:
        """Takes the parts as they are; tables have their last row."""
        self.words, self.pairs, self.weights = parts["words"], parts["pairs"], parts["weights"]
        self.cont, self.total, self.kept, self.both, self.count = (parts[p] for p in self.PADDED)
        # sums: for each class and for both together, all continuations and the words that have any
        self.sums, self.discounts = parts["sums"], parts["discounts"]
        n, types = self.sums[2]
        uniform = 1.0 / (len(self.words) + 1)
        self.shared = (np.maximum(self.both - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * types * uniform) / n if n else np.full(len(self.words) + 1, uniform)

    @classmethod
    def empty(cls) -> "Model":
        none, two = np.empty(0, np.int64), np.empty((2, 0), np.float32)
        return cls(words=none, cont=two, total=two, kept=two, both=np.empty(0, np.float32), pairs=none, count=two, sums=np.zeros((3, 2)), discounts=np.zeros(2), weights=np.zeros(1 + FEATURES))

    def likelihoods(self, w: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratios (toxic over ordinary) of each word of a text alone and after the word before it.
        With ``own``, the text's class, the text's own pairs are taken out of that class's counts: exactly for pairs, and
        for continuations as if no other text held these pairs, which only matters for rare words."""
        v = before(w)
        at, context, pair = found_at(self.words, w), found_at(self.words, v), found_at(self.pairs, pair_key(v, w))
        if own is not None:
            _, first = np.unique(pair_key(v, w), return_index=True)
            mine_w, mine_v = np.bincount(at[first], minlength=len(self.words) + 1), np.bincount(context[first], minlength=len(self.words) + 1)
            had = self.count[own][pair[first]]
            lost = np.bincount(context[first], weights=np.maximum(had - PAIR_DISCOUNT, 0) - np.maximum(had - 1 - PAIR_DISCOUNT, 0), minlength=len(self.words) + 1)
        alone, after = [], []
        for c in (0, 1):
            cont, total, kept, count, n, types = self.cont[c][at], self.total[c][context], self.kept[c][context], self.count[c][pair], *self.sums[c]
            if c == own:
                cont, total, kept, count, n = np.maximum(cont - mine_w[at], 0), np.maximum(total - mine_v[context], 0), np.maximum(kept - lost[context], 0), count - 1, max(n - len(first), 0)
            d = self.discounts[c]
            single = (np.maximum(cont - d, 0) + d * types * self.shared[at]) / n if n else self.shared[at]
            mass = np.maximum(total, 1e-9)
            pairs = np.where(total > 0, (np.maximum(count - PAIR_DISCOUNT, 0) + np.maximum(total - kept, 0) * single) / mass, single)
            alone.append(np.log(np.maximum(single, 1e-300)))
            after.append(np.log(np.maximum(pairs, 1e-300)))
        return alone[1] - alone[0], after[1] - after[0]

    def features(self, w: np.ndarray, own: int | None = None) -> np.ndarray:
        """Length-normalised comparisons of a text's words (hashes): see the module's text. A
        text shorter than a passage counts as one with neutral words added. All 0 without words."""
        if not len(w):
            return np.zeros(FEATURES)
        alone, after = self.likelihoods(w, own)
        sums = np.concatenate([[0.0], np.cumsum(after)])
        best = [float((sums[k:] - sums[:-k]).max() / k) if len(w) >= k else float(after.sum() / k) for k in PASSAGES]
        return np.array([after.mean(), *best, alone.max()])

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def dumps(self) -> bytes:
        """The parts one after another, each as a .npy of its own, which begins at a multiple of 64 bytes."""
        out = io.BytesIO()
        for p in self.PARTS:
            np.save(out, np.ascontiguousarray(getattr(self, p)), allow_pickle=False)
            out.write(bytes(-out.tell() % 64))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> "Model":
        """The model over ``data`` itself: its tables are read there, so a worker holds them once."""
        model, parts, at = cls.__new__(cls), {}, 0
        for p in cls.PARTS:
            head = io.BytesIO(data[at : at + HEADER])
            np.lib.format.read_magic(head)
            shape, _, kind = np.lib.format.read_array_header_1_0(head)
            at += head.tell()
            parts[p] = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
            at += -(-parts[p].nbytes // 64) * 64
        model.take(parts)
        return model


def counted(rows: DataFrame) -> DataFrame:
    """``v``, ``w``, ``n0``, ``n1``: in how many rows (``text``, ``toxic``) of each class the word w follows v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, "text", 1 << 20):
            parts = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = hasher.hashes(text)
                if len(w):
                    both = np.unique(np.stack([before(w), w]), axis=1)
                    parts.append(np.vstack([both, np.full((1, both.shape[1]), toxic, dtype=np.int64)]))
            if parts:
                v, w, c = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array((c == 0).astype(np.int32)), pa.array((c == 1).astype(np.int32))], ["v", "w", "n0", "n1"])

    made = rows.select("text", "toxic").mapInArrow(run, "v long, w long, n0 int, n1 int")
    return made.groupBy("v", "w").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1"))


def fit_counts(rows: DataFrame) -> Model:
    """The two models of ``rows`` (``text``, ``toxic``), without weights."""
    pairs = written(counted(rows), "toxicity-pairs")
    kept = lambda n: F.greatest(F.col(n) - F.lit(PAIR_DISCOUNT), F.lit(0.0))
    ends = pairs.groupBy(F.col("w").alias("h")).agg(F.count_if(F.col("n0") > 0).alias("cont0"), F.count_if(F.col("n1") > 0).alias("cont1"), F.count("*").alias("both"))
    begins = pairs.groupBy(F.col("v").alias("h")).agg(F.sum("n0").alias("total0"), F.sum("n1").alias("total1"), F.sum(kept("n0")).alias("kept0"), F.sum(kept("n1")).alias("kept1"))
    table = ends.join(begins, "h", "full").fillna(0).toArrow()  # a row for each word of the sample
    often = pairs.where((F.col("n0") > PAIR_DISCOUNT) | (F.col("n1") > PAIR_DISCOUNT)).toArrow()
    column = lambda t, name: t.column(name).to_numpy().astype(np.float64)
    if not table.num_rows:
        return Model.empty()
    order = np.argsort(table.column("h").to_numpy())
    words_, cont = table.column("h").to_numpy()[order], np.stack([column(table, f"cont{c}")[order] for c in (0, 1)])
    both = column(table, "both")[order]
    keys = pair_key(often.column("v").to_numpy(), often.column("w").to_numpy())
    by_key = np.argsort(keys)
    ones, twos = ((cont == k).sum(axis=1) for k in (1, 2))
    two = lambda name: np.stack([column(table, f"{name}{c}")[order] for c in (0, 1)]).astype(np.float32)
    return Model(
        words=words_, cont=cont.astype(np.float32), total=two("total"), kept=two("kept"), both=both.astype(np.float32), pairs=keys[by_key],
        count=np.stack([column(often, f"n{c}")[by_key] for c in (0, 1)]).astype(np.float32),
        sums=np.stack([[x.sum(), (x > 0).sum()] for x in (*cont, both)]).astype(np.float64), discounts=np.clip(ones / np.maximum(ones + 2 * twos, 1), LEAST_DISCOUNT, 1 - LEAST_DISCOUNT), weights=np.zeros(1 + FEATURES),
    )


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a weighted logistic regression with a ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ b)
        b += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return b


def compared(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features of labelled rows, their own evidence taken out, and their classes, in a defined order."""
    sent = rows.sparkSession.sparkContext.broadcast(model.dumps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, hasher = Model.loads(sent.value), Hasher()
        for batch in slices(batches, "text", 1 << 20):
            toxic = batch.column(1).to_pylist()
            x = [mine.features(hasher.hashes(t), c).tolist() for t, c in zip(batch.column(0).to_pylist(), toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    got = sorted((r.toxic, r.x) for r in rows.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>").collect())
    sent.unpersist()
    return np.array([x for _, x in got]).reshape(-1, FEATURES), np.array([c for c, _ in got], dtype=np.int64)


def crc_of(c):
    return F.crc32(F.encode(c.cast("string"), "UTF-8"))


def train(documents: DataFrame, labels: DataFrame, *, most_per_class: int = MOST_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from ``labels`` (id, ``toxic``) and the texts of those rows.

    Rows without id, label (0 or 1) or document don't count; an id with both labels is toxic; null texts count as empty;
    rows of ``documents`` that share an id each count. Other columns are not read, whatever their names. Without any
    usable row the model scores every text 0.5. At most ``most_per_class`` labelled ids of each class, those of least
    hash, are used; more of a class weigh as much as they are. The order of rows and partitions doesn't matter.
    """
    spark = documents.sparkSession
    usable = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(most_per_class) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1]).collect()  # at most twice most_per_class ids and labels
    if not sample:
        return Model.empty()
    weight = np.array([sizes.get(c, 0) / max(1, sum(r.toxic == c for r in sample)) for c in (0, 1)])
    # from Arrow: rows of Python objects would pass a second set of Python workers, which then stays beside that of the Arrow functions
    chosen = F.broadcast(spark.createDataFrame(pa.table({"id": pa.array([r.id for r in sample], pa.int64()), "toxic": pa.array([r.toxic for r in sample], pa.int32())})))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id").select("text", "toxic")
    model = fit_counts(rows)
    x, y = compared(rows, model)
    if len(y):
        model.weights = logistic(x, y, weight[y])
    return model


def scored(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with its rows' toxicity (0 to 1) appended as ``score_col``, which replaces a column of that name. All other
    columns are kept, whatever their names. Null, empty and wordless texts get the score of no evidence; repeated rows
    score alike; an empty table gives no rows. Nothing is shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(model.dumps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, hasher = Model.loads(sent.value), Hasher()
        for batch in slices(batches, "text"):
            x = np.array([mine.features(hasher.hashes(t)) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine.score(x), pa.float64())], ["row", "score"])

    columns = [c for c in df.columns if c != score_col]
    read = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)), F.lit(0).alias("none")).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = read.mapInArrow(run, f"row {read.schema['row'].dataType.simpleString()}, score double")
    return out.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)), F.col("score").alias(score_col))


def drop_toxic(df: DataFrame, model: Model, *, reject_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``scored`` gives less than ``reject_from``, with all their columns."""
    free = next(c for c in (f"toxicity{k}" for k in range(len(df.columns) + 1)) if c not in df.columns)
    return scored(df, model, text_col=text_col, score_col=free).where(F.col(free) < reject_from).drop(free)


def toxicity_report(documents: DataFrame, labels: DataFrame, *, most_per_class: int = MOST_PER_CLASS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score of 0.5 or more) for each row of ``documents``. Labels
    of held-out rows (crc32 of the id as text divisible by 5) aren't read by the fit. Nulls, empty texts and ties as in
    ``train`` and ``scored``; a null id isn't held out."""
    model = train(documents, labels.where(crc_of(F.col("doc_id")) % 5 != 0), most_per_class=most_per_class)
    out = scored(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (F.coalesce(crc_of(F.col("doc_id")), F.lit(1)) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
