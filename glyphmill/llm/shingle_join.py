"""N-gram Jaccard join with PartEnum signatures.

A text's set is that of its distinct word shingles, as 64-bit hashes. Two sets of sizes a and b whose
Jaccard similarity is at least t % differ in at most (a + b)(100 - t) / (100 + t) elements. Sizes fall into
bands such that linked sets lie in one band or in neighbouring ones, and each set signs for its own band and
the next. A band that allows k differences divides the domain (the range of the hash) into groups of
partitions and signs, for each group, the contents of every subset of its partitions that is large enough
for linked sets to share one:

* k up to FEW: one group of k + 2 partitions. At least two of them agree: every pair of partitions signs.
* more: groups of three partitions, at least k / 2 + 1 of them. A group with at most one difference agrees in
  two of its partitions: every two of three sign. There are some more groups than needed, so linked sets
  agree like this in several; a set with fewer groups than that in which two partitions are empty leaves its
  empty signatures out, which nearly all sets of a band would share by chance.

Sets, not documents, are joined: copies share a class. What a task signs is deduplicated and packed into
one binary row for each of many ranges of signatures. The owner of a range sorts it. A bucket of up to SMALL
classes gives all its pairs; of a larger one each member is paired with the first. A bucket
that verified links don't make one component yet is compared with its most central member (that of the most
and largest buckets), twice; what is still apart goes through an exact filter in blocks: a class's parity
sketch is linear, so the bits in which two sketches differ are at most the elements in which the sets do. So
no link between components is lost, and a group of many near copies costs about its size in rows. Every pair is
verified on the whole sets. Components are the only result: pairs that already share one are skipped, so the
links inside a component are neither all found nor listed nor counted.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices, trim
from .components import connected
from .shared import partitions_for, written

SMALL = 4
FEW = 6
PIVOTS = 2
BLOCK = 2048
FLUSH_SIGNATURES = 600_000
KNOWN_WORDS = 100_000
OWNED_BYTES = 16 << 20
SLICE_BITS = 3
MOST_BITS = 1 << 28
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        with np.errstate(over="ignore"):
            self.factors = mix(np.arange(1, width + 1, dtype=np.uint64) * C1) | np.uint64(1)

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone cuts
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = np.empty(len(words), dtype=np.uint64)
        for k, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out[k] = h
        return out

    def set_of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint64)
        words = self.hashes(text)
        n = len(words) - self.width + 1
        if not len(words):
            return words
        with np.errstate(over="ignore"):
            if n < 1:
                return mix(np.array([(words * self.factors[: len(words)]).sum() + np.uint64(len(words))], dtype=np.uint64))
            total = words[:n] * self.factors[0]
            for k in range(1, self.width):
                total += words[k : k + n] * self.factors[k]
            return np.unique(mix(total + np.uint64(self.width)))


def key_of(sets: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sets.tobytes())


class Signer:
    """Signatures of sets at a similarity of ``percent``."""

    def __init__(self, percent: int):
        self.percent, self.highs, self.plans = percent, [], {}

    def band(self, size: int) -> int:
        while not self.highs or self.highs[-1] < size:
            low = self.highs[-1] + 1 if self.highs else 1
            self.highs.append(low * 100 // self.percent)
        return int(np.searchsorted(self.highs, size))

    def plan(self, band: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Bounds of the band's partitions, a salt for each signature, and how many groups linked sets agree in
        (0 for the single group of few differences)."""
        if band not in self.plans:
            while band >= len(self.highs):
                self.band(self.highs[-1] + 1)
            k = 2 * self.highs[band] * (100 - self.percent) // (100 + self.percent)
            groups = k // 2 + 4 + k // 16
            parts, signs = (k + 2, (k + 2) * (k + 1) // 2) if k <= FEW else (3 * groups, 3 * groups)
            bounds = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
            with np.errstate(over="ignore"):
                salts = mix(np.arange(signs, dtype=np.uint64) + np.uint64(band << 32) + C1)
            # k = 0: only equal sets are linked, and they're one class
            self.plans[band] = None if k == 0 else (bounds, salts, 0 if k <= FEW else groups - k // 2)
        return self.plans[band]

    def sign(self, sets: np.ndarray) -> np.ndarray:
        if not len(sets):
            return sets
        band, out = self.band(len(sets)), []
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(sets + C1))])
            for b in (band, band + 1):
                plan = self.plan(b)
                if plan is None:
                    continue
                bounds, salts, agreeing = plan
                at = np.concatenate([[0], np.searchsorted(sets, bounds), [len(sets)]])
                parts, sizes = sums[at[1:]] - sums[at[:-1]], np.diff(at)
                if not agreeing:
                    x, y = np.triu_indices(len(parts), 1)
                    out.append(mix(mix(parts[x] + salts) + parts[y] * C3))
                    continue
                x, y = np.arange(len(parts)).reshape(-1, 3)[:, [1, 2, 0]].ravel(), np.arange(len(parts)).reshape(-1, 3)[:, [2, 0, 1]].ravel()
                signs, empty = mix(mix(parts[x] + salts) + parts[y] * C3), sizes[x] + sizes[y] == 0
                out.append(signs[~empty] if empty.reshape(-1, 3).any(axis=1).sum() < agreeing else signs)
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def keys_of(df: DataFrame, parts: int) -> list[int]:
    """For each of ``parts`` hash partitions an integer that Spark deals to it."""
    keys: dict[int, int] = {}
    tried = 8 * parts + 64
    while len(keys) < parts:
        for r in df.sparkSession.range(tried).selectExpr("cast(id as int) as k", f"pmod(hash(cast(id as int)), {parts}) as p").groupBy("p").agg(F.min("k").alias("k")).collect():
            keys[r.p] = r.k
        tried *= 4
    return [keys[p] for p in range(parts)]


def signed(df: DataFrame, width: int, percent: int, parts: list[int]) -> DataFrame:
    """Packed signatures and documents (payloads that begin with "s" and "d"), by ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(width), Signer(percent)
        seen: set[bytes] = set()
        sigs: list[np.ndarray] = []
        classes: list[int] = []
        docs: list[bytes] = []
        held = flushes = 0

        def flush() -> pa.RecordBatch:
            rows = [(parts[(flushes * 7919 + TASK) % len(parts)], b"d" + b"".join(docs))]
            if held:
                sig, owner = np.concatenate(sigs), np.repeat(np.arange(len(sigs), dtype=np.uint16), [len(s) for s in sigs])
                order = np.argsort(sig)
                sig, owner = sig[order], owner[order]
                ids = np.array(classes, dtype=np.uint64)
                edges = np.searchsorted(sig, np.array([(p << 64) // len(parts) for p in range(1, len(parts))], dtype=np.uint64)).tolist()
                for p, (begin, end) in enumerate(zip([0, *edges], [*edges, len(sig)])):
                    if begin < end:
                        used, local = np.unique(owner[begin:end], return_inverse=True)
                        rows.append((parts[p], struct.pack("<cII", b"s", len(used), end - begin) + ids[used].tobytes() + sig_bits(sig[begin:end]).astype("<u4").tobytes() + local.astype("<u2").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "payload"])

        from pyspark import TaskContext

        TASK = TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets = shingler.set_of(text)
                key = key_of(sets)
                docs.append(struct.pack("<?qq16s", doc is not None, doc or 0, len(sets), key))
                if key in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(key)
                mine = signer.sign(sets)
                if len(mine):
                    sigs.append(mine)
                    classes.append(int.from_bytes(key[:8], "little"))
                    held += len(mine)
                if held >= FLUSH_SIGNATURES or len(sigs) >= 65_000 or len(docs) >= 100_000:
                    yield flush()
                    sigs, classes, docs, held, flushes = [], [], [], 0, flushes + 1
        if docs:
            yield flush()

    read = df.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(run, "part int, payload binary")


def sig_bits(sig: np.ndarray) -> np.ndarray:
    """32 bits that tell the signatures of one range apart but for chance, which only adds candidates. They're
    mixed, since a range's leading bits agree."""
    return mix(sig) >> np.uint64(32)


def bucket_pairs(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From one range's signatures and classes: candidate pairs, and signature and class of the members of
    buckets of more than SMALL classes."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    keep = np.ones(len(sig), dtype=bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, cls = sig[keep], cls[keep]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(sig)))
    run, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
    first = np.repeat(cls[starts], sizes) if len(starts) else cls
    inner = np.ones(len(sig), dtype=bool)
    inner[starts] = False
    a, b = [first[inner]], [cls[inner]]
    for d in range(1, SMALL):
        k = np.flatnonzero((run[d:] == run[:-d]) & (size[d:] <= SMALL) & inner[:-d]) if len(sig) > d else np.empty(0, np.int64)
        a.append(cls[k])
        b.append(cls[k + d])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    big = size > SMALL
    return pairs[:, 0], pairs[:, 1], sig[big], cls[big]


def candidates(packed: DataFrame) -> DataFrame:
    """``kind`` 0: a candidate pair of classes ``a``, ``b``; 1: bucket ``a`` and member ``b`` of a large bucket; 2: a document
    ``a`` with ``n`` shingles and class ``key``. Expects all rows of a part in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        names = ["kind", "a", "b", "n", "key"]
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data[:1] == b"d":
                    rows = list(struct.iter_unpack("<?qq16s", data[1:]))
                    ids = pa.array([r[1] if r[0] else None for r in rows], pa.int64())
                    nothing = pa.nulls(len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([2] * len(rows), pa.int32()), ids, nothing, pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names)
                    continue
                _, m, n = struct.unpack_from("<cII", data)
                ids = np.frombuffer(data, "<u8", m, 9)
                sig = np.frombuffer(data, "<u4", n, 9 + 8 * m)
                held.setdefault(part, []).append((sig.copy(), ids.copy(), np.frombuffer(data, "<u2", n, 9 + 8 * m + 4 * n).copy()))
        # a bucket lies in one slice, by its signature's leading bits, so what sorting takes is a slice's share
        for part, got in held.items():
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for begin in range(1 << SLICE_BITS):
                mine = [(sig[at], ids[local[at]]) for sig, ids, local in got for at in [np.flatnonzero(sig >> (32 - SLICE_BITS) == begin)]]
                a, b, bucket, member = bucket_pairs(np.concatenate([m[0] for m in mine]), np.concatenate([m[1] for m in mine]))
                found += [(0, a, b), (1, bucket.astype(np.uint64) | np.uint64(part) << np.uint64(32), member)]
            pairs = np.unique(np.stack([np.concatenate([x[k] for x in found if x[0] == 0]) for k in (1, 2)], axis=1), axis=0)
            for kind, x, y in [(0, pairs[:, 0].copy(), pairs[:, 1].copy()), *(f for f in found if f[0] == 1)]:
                for k in range(0, len(x), 50_000):
                    p, q = x[k : k + 50_000].view(np.int64), y[k : k + 50_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), kind, np.int32)), pa.array(p), pa.array(q), pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.binary())], names)

    return packed.mapInArrow(run, "kind int, a long, b long, n long, key binary")


def maybe_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` as the struct ``row`` of its columns c0, c1, ..., and ``maybe``: false where its column ``key``, as a long, is surely not
    in ``ids`` (its only column, of longs; nulls are ignored), by a bitmap. The bitmap has at least eight bits for each id, up to
    MOST_BITS (a broadcast of 64 MB at most); with more ids than that fills, all rows are ``maybe``, and the join that follows
    moves them."""
    held = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)), F.lit(0).alias("none")).alias("row"), F.col(f"`{key}`").cast("long").alias("at"))
    name, total = ids.columns[0], ids.count()
    bits = 1 << max(16, (8 * total).bit_length())
    if bits > MOST_BITS:
        return held.select("row", F.lit(True).alias("maybe"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = ids.where(F.col(name).isNotNull()).select(place(F.col(name)).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    words = written(words, "bitmap")
    marked = held.withColumn("place", place(F.col("at"))).join(F.broadcast(words), F.shiftright("place", 6) == F.col("word"), "left")
    return marked.select("row", F.coalesce(F.expr("(shiftright(bits, cast(place % 64 as int)) & 1L) = 1"), F.lit(False)).alias("maybe"))


def sketch_of(sets: np.ndarray) -> bytes:
    """Whether an odd number of elements falls into each of so many places that few share one."""
    places = max(256, 1 << (2 * len(sets) - 1).bit_length())
    with np.errstate(over="ignore"):
        odd = np.bincount((mix(sets ^ C2) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded to the length of the shortest."""
    rows, least = [np.frombuffer(x, np.uint64) for x in sketches], min(map(len, sketches)) // 8
    while any(len(r) > least for r in rows):
        rows = [r[: len(r) // 2] ^ r[len(r) // 2 :] if len(r) > least else r for r in rows]
    return np.stack(rows)


def may_link(apart, n, m, percent: int):
    """Whether sets of these sizes that differ in at least ``apart`` elements can be linked."""
    return (apart * (100 + percent) <= (n + m) * (100 - percent)) & (100 * n >= percent * m) & (100 * m >= percent * n)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked pairs ``u``, ``v`` (class keys) among candidate pairs ``a``, ``b`` (short classes), or ``u``, ``v``."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s_v", 4 << 20):
            u, v, n, m, s, t = (c.to_pylist() for c in batch.columns)
            keep = [k for k in range(len(u)) if may_link(int(np.bitwise_count(np.bitwise_xor(*folded([s[k], t[k]]))).sum()), n[k], m[k], percent)]
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_v", 4 << 20):
            u, v = [], []
            for ku, kv, su, sv in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(su, np.uint64), np.frombuffer(sv, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    u.append(ku)
                    v.append(kv)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    if "a" in pairs.columns:
        side = lambda short, key, n, sketch: sets.select(F.col("short").alias(short), F.col("key").alias(key), F.col("n").alias(n), F.col("sketch").alias(sketch))
        near = (F.col("n_u") * 100 >= F.col("n_v") * percent) & (F.col("n_v") * 100 >= F.col("n_u") * percent) & (F.col("u") != F.col("v"))
        both_sides = pairs.join(side("a", "u", "n_u", "s_u"), "a").join(side("b", "v", "n_v", "s_v"), "b").where(near)
        pairs = written(both_sides.select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(sketched, "u binary, v binary"), "shingle-likely")
    # only sets that a pair names are moved
    named = written(pairs.select(F.explode(F.array("u", "v")).alias("key")).select(short_of(F.col("key")).alias("named")).distinct(), "shingle-named")
    likely = maybe_in(sets.select("short", "key", "set"), "short", named).where("maybe")
    whole = lambda key: likely.select(F.col("row.c1").alias(key), F.col("row.c2").alias(f"set_{key}"))
    return pairs.join(whole("u"), "u").join(whole("v"), "v").select("u", "v", "set_u", "set_v").mapInArrow(run, "u binary, v binary")


def still_apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of large buckets of several components, with their ``root``."""
    rooted = members.join(roots, F.col("key") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "key").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return written(rooted.join(several, "bucket", "left_semi"), "shingle-open")


def pivot_pairs(apart: DataFrame, turn: int) -> DataFrame:
    """Each bucket's most central member with the members outside of its component; at later turns the most
    central one outside of the first one's component."""
    order = F.struct("degree", "key")
    main = apart.groupBy("bucket").agg(F.max_by("root", order).alias("main"))
    others = apart if not turn else apart.join(main, "bucket").where("root <> main").drop("main")
    pivot = others.groupBy("bucket").agg(F.max_by("short", order).alias("a"), F.max_by("root", order).alias("near"))
    return apart.join(pivot, "bucket").where("root <> near").select("a", F.col("short").alias("b")).distinct()


def block_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u``, ``v`` between components of a bucket that sizes and sketches allow, found in blocks of BLOCK."""
    at = F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("n", "key")) - 1) / BLOCK).cast("int")
    placed = apart.select("bucket", "key", "root", "n", at.alias("block"))
    last = placed.groupBy("bucket").agg(F.max("block").alias("last"))
    dealt = placed.join(last, "bucket").select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).join(sets.select("key", "sketch"), "key")

    def run(table: pa.Table) -> pa.Table:
        cells = {c: table.column(c).to_pylist() for c in ("key", "root", "n", "sketch", "block", "lo", "hi")}
        keys, n, block, sketch = cells["key"], np.array(cells["n"]), np.array(cells["block"]), folded(cells["sketch"])
        names = {r: k for k, r in enumerate(dict.fromkeys(cells["root"]))}
        root = np.array([names[r] for r in cells["root"]])
        u, v, same = [], [], cells["lo"][0] == cells["hi"][0]
        step = max(1, (16 << 20) // sketch.nbytes)
        for i in range(0, len(keys), step):
            rows = slice(i, i + step)
            fits = (root[rows, None] != root[None, :]) & (np.arange(len(keys))[rows, None] < np.arange(len(keys))[None, :]) & (same | (block[rows, None] != block[None, :]))
            if fits.any():
                apart_ = np.bitwise_count(sketch[rows, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int64)
                for x, y in np.argwhere(fits & may_link(apart_, n[rows, None], n[None, :], percent)).tolist():
                    u.append(min(keys[i + x], keys[y]))
                    v.append(max(keys[i + x], keys[y]))
        return pa.table([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(run, "u binary, v binary").distinct()


def link_components(df: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, ``n_shingles`` and ``component_id``, the least id that links reach.

    Texts are lower-cased (A-Z) and cut at ASCII white space; two link when 100 * intersection >= percent *
    union of their sets of ``width``-word shingles; a shorter text is one shingle. Null, empty and blank texts
    have no shingle and link with nothing. Ids are integers; a null id is never a component's id unless the
    component has no other. Repeated rows each give a row. Other columns are not read. An empty table gives
    no rows. Shingles are compared as 64-bit hashes, equal classes as 128-bit ones.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    owners = partitions_for(docs, OWNED_BYTES, 2 * (100 - percent) / 10)
    packed = signed(docs, width, percent, keys_of(docs, owners)).repartition(owners, "part")
    rows = written(candidates(packed), "shingle-candidates")
    found = rows.where("kind = 2").select(F.col("a").alias("id"), "n", "key")
    classes = written(found.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n")).withColumn("short", short_of(F.col("key"))), "shingle-classes")
    twins = classes.groupBy("short").agg(F.count("*").alias("times")).where("times > 1").select(F.col("short").alias("a"), F.col("short").alias("b"))
    pairs = written(rows.where("kind = 0").select("a", "b").distinct().unionByName(twins), "shingle-pairs")
    big = rows.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("short"))
    members = pairs.select(F.col("a").alias("short")).unionByName(pairs.select(F.col("b").alias("short"))).unionByName(big.select("short")).distinct()
    wanted = written(classes.join(members, "short").select("rep", "key", "short"), "shingle-wanted")
    sets = sets_of(docs, wanted, width)
    links = written(verified(pairs, sets, percent), "shingle-links")
    roots = connected(links)
    if big.limit(1).count():
        sized = big.join(big.groupBy("bucket").agg(F.count("*").alias("size")), "bucket")
        degrees = sized.groupBy("short").agg(F.sum("size").alias("degree"))
        members = written(big.join(degrees, "short").join(classes.select("short", "key", "n"), "short"), "shingle-members")
        for turn in range(PIVOTS + 1):
            apart = still_apart(members, roots)
            if not apart.limit(1).count():
                break
            more = written(pivot_pairs(apart, turn) if turn < PIVOTS else block_pairs(apart, sets, percent), "shingle-more")
            links = links.unionByName(written(verified(more, sets, percent), "shingle-links"))
            roots = connected(links)
    labelled = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    named = labelled.join(least, "root").select("key", "component")
    return found.join(named, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def short_of(key: Column) -> Column:
    """The first eight bytes of a class key, little-endian, as a signed integer."""
    bytes_ = [F.conv(F.hex(F.substring(key, k, 1)), 16, 10).cast("long") for k in range(1, 9)]
    out = bytes_[0]
    for k in range(1, 8):
        out = out.bitwiseOR(F.shiftleft(bytes_[k], 8 * k))
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``key``, ``short``, ``n``, ``sketch`` and ``set`` (sorted hashes) of the wanted classes, from the texts of their least documents.
    Documents that are surely not wanted are left out before the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in slices(batches, "text"):
            sets = [shingler.set_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch_of(s) for s in sets], pa.binary()), batch.column(1), batch.column(2)], ["got", "set", "n", "sketch", "key", "short"])

    at = lambda c: (F.coalesce(F.col(c), F.lit(0)).alias("at"), F.col(c).isNull().alias("none"))
    likely = maybe_in(docs.select("id", "text"), "id", wanted.select("rep")).select(F.col("row.c0").alias("id"), F.col("row.c1").alias("text"), "maybe")
    texts = likely.where((F.col("maybe") | F.col("id").isNull()) & F.col("text").isNotNull()).select(*at("id"), "text")
    # repeated rows fall together where the join has put them, so sets needn't be moved for that
    read = texts.join(wanted.select(*at("rep"), "key", "short"), ["at", "none"]).distinct().select("text", "key", "short")
    made = read.mapInArrow(run, "got binary, set binary, n long, sketch binary, key binary, short long")
    sets = written(made.where("got = key").select("key", "short", "n", "sketch", "set"), "shingle-sets")
    # texts that differ under one id can still have one set
    again = sets.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").limit(1).count()
    return written(sets.dropDuplicates(["key"]), "shingle-sets") if again else sets


def drop_near_copies(df: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is their component's least (see ``link_components``), with all their columns, whatever
    their names.

    Rows without shingles (null, empty and blank texts) stay. Rows with a null id can't be told apart and stay; rows
    that share a kept id all stay, so exact copies should be dropped before. An empty table gives no rows. Only rows that a
    bitmap of the dropped ids can't clear are shuffled.
    """
    found = link_components(df.select(id_col, text_col), width=width, percent=percent, id_col=id_col, text_col=text_col)
    gone = written(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast("long").alias("gone")).distinct(), "shingle-gone")
    marked = maybe_in(df, id_col, gone)
    key = F.col(f"row.c{df.columns.index(id_col)}").cast("long")
    open_rows = marked.where("maybe").join(gone, key == F.col("gone"), "left_anti")
    kept = marked.where("not maybe").unionByName(open_rows)
    return kept.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns)))
