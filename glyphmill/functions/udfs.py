"""Arrow functions for what Spark has no expression for. Each takes batches by pieces of bounded bytes, so that what a
worker holds follows neither the number of rows in a batch nor the table's size."""

import ctypes
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Marks that end a sentence, and pairs that protect what they enclose.
TERMINATORS = "。！？；\n"
PAIRS = dict(zip("「『“《【（", "」』”》】）"))
MARK = re.compile(f"[{TERMINATORS}{''.join(PAIRS)}{''.join(PAIRS.values())}]")
TRAIL = re.compile(f"[{TERMINATORS}{''.join(PAIRS.values())}]*")
MOST_BYTES = 1 << 20
ENCODINGS = ("utf-8", "utf-8-sig", "big5", "cp950", "gb18030", "utf-16")


def texts_struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def decode_bytes(data: bytes, candidates=ENCODINGS) -> tuple[str, str]:
    """The first encoding that decodes strictly, else UTF-8 with replacement characters."""
    for name in candidates:
        try:
            return data.decode(name), name
        except (UnicodeDecodeError, LookupError):
            pass
    return data.decode("utf-8", errors="replace"), "utf-8-replace"


def split_sentences(text: str | None, protect: bool = True) -> list[str]:
    """Sentences of a text. A terminator outside of all open pairs ends one, together with the closing marks
    and terminators right after it; a closing mark closes only the innermost pair, if it's that pair's."""
    out, begin, at, stack = [], 0, 0, []
    text = text or ""
    while found := MARK.search(text, at):
        mark, at = found.group(), found.end()
        if mark in TERMINATORS:
            if not stack:
                at = TRAIL.match(text, at).end()
                out.append(text[begin:at])
                begin = at
        elif protect and mark in PAIRS:
            stack.append(PAIRS[mark])
        elif stack and stack[-1] == mark:
            stack.pop()
    out.append(text[begin:])
    return [s for s in map(str.strip, out) if s]


def entropy_of(text: str | None) -> float:
    n = len(text or "")
    return round(-sum(k / n * math.log2(k / n) for k in Counter(text).values()), 3) + 0.0 if n else 0.0


def trim() -> None:
    """Gives back what earlier tasks of this worker freed; allocators keep pages otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def pieces(batches: Iterator[pa.Array], most: int = MOST_BYTES) -> Iterator[pa.Array]:
    """The same values in arrays of at most ``most`` bytes (one value at least)."""
    trim()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(batch):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
        if not len(batch):
            yield batch


def mapped(batches: Iterator[pa.Array], f: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """``f`` of every value, by pieces."""
    for piece in pieces(batches):
        yield pa.array(map(f, piece.to_pylist()), kind, size=len(piece))


def _kept_null(f: Callable) -> Callable:
    return lambda t: None if t is None else f(t)


def nfkc_of(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


@arrow_udf(T.StringType())
def _unescape(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return mapped(texts, _kept_null(html.unescape), pa.string())


@arrow_udf(T.StringType())
def _nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return mapped(texts, _kept_null(nfkc_of), pa.string())


@arrow_udf(T.ArrayType(T.StringType()))
def _protected(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return mapped(texts, split_sentences, pa.list_(pa.string()))


@arrow_udf(T.ArrayType(T.StringType()))
def _unprotected(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return mapped(texts, lambda t: split_sentences(t, False), pa.list_(pa.string()))


@arrow_udf(T.DoubleType())
def _entropy(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return mapped(texts, entropy_of, pa.float64())


@arrow_udf(texts_struct("text", "encoding"))
def _decoded(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("text", pa.string()), ("encoding", pa.string())])
    return mapped(data, lambda d: dict(zip(("text", "encoding"), (None, None) if d is None else decode_bytes(d))), kind)


def html_unescape(c: Column) -> Column:
    """Character references resolved. The column goes to Python as it is, without a condition around it: a
    condition would repeat the whole expression that makes it, which costs more than the passage."""
    return _unescape(c)


def nfkc(c: Column) -> Column:
    """Unicode NFKC; see html_unescape."""
    return _nfkc(c)


def sentences(c: Column, protect: bool = True) -> Column:
    return (_protected if protect else _unprotected)(c)


def char_entropy(c: Column) -> Column:
    """Shannon entropy of the characters in bits, to three places; 0 for an empty text."""
    return _entropy(F.coalesce(c, F.lit("")))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that it names several times, computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _binary_even(c: Column, digits: int) -> Column:
    """The fraction becomes a whole number of 2**-60, of 2**-66 below 2**-6 and of 2**-72 below 2**-12, which is exact wherever
    a half of up to four digits lies; its product with 10**digits is kept in two parts."""
    whole, ten = F.floor(F.abs(c)), F.lit(10**digits)
    fraction = F.abs(c) - whole
    by_size = lambda x: F.when(fraction < 2.0**-12, x(12)).when(fraction < 2.0**-6, x(6)).otherwise(x(0))
    bits = (fraction * by_size(lambda e: F.lit(2.0 ** (60 + e)))).cast("long")
    unit = by_size(lambda e: F.lit(1 << (30 + e)).cast("long"))
    down = bits.bitwiseAND(F.lit((1 << 30) - 1)) * ten
    up = F.shiftright(bits, 30) * ten + F.shiftright(down, 30)
    rest, more = up % unit * 2, down.bitwiseAND(F.lit((1 << 30) - 1)) > 0
    units = whole * ten + ((up - up % unit) / unit).cast("long")
    above = (rest > unit) | ((rest == unit) & (more | (units % 2 == 1)))
    return F.when(F.isnan(c) | (F.abs(c) >= float(10**15) / 10**digits), c).otherwise(F.signum(c) * (units + above.cast("long")) / float(10**digits))


def py_round(c: Column, digits: int) -> Column:
    """Rounds the exact binary value, ties to even: neither round() nor bround() of Spark does."""
    return once(c.cast("double"), lambda x: _binary_even(x, digits))


def even_round(c: Column, digits: int) -> Column:
    """Rounds the scaled value, ties to even, as round_even() of SQL engines: a value that is a tie once scaled goes to the even
    neighbour, though its binary value may lie on either side of the tie."""
    return F.rint(c.cast("double") * float(10**digits)) / float(10**digits)


def decode_fallback(c: Column) -> Column:
    """Struct of text and encoding of a binary column."""
    return _decoded(c)
