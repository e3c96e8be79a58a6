"""Bit vectors as arrays of 64-bit words (form W) and as packed structs (form P).

Form W is ``ARRAY<BIGINT>`` with the first bit of the vector as the highest bit of the first word and
zeros after the last bit. Where vectors are of one known length, a list of BIGINT columns stands for
them as well: counts and comparisons of two such lists are compiled code without arrays. Form P is ``STRUCT<nbits BIGINT, endian STRING, buf BINARY>`` with zero
pad bits. Word expressions are plain BIGINT operators that Spark compiles; there is no text in them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .text import ColumnOrName, c

Words = ColumnOrName | list[Column]
PACKED = "struct<nbits:bigint,endian:string,buf:binary>"


def to_words(bits: ColumnOrName) -> Column:
    return X.words_of(c(bits))


def columns(bits: ColumnOrName, n: int) -> list[Column]:
    """The words of vectors of n bits as a list of columns, one at least."""
    return [X.number(F.rpad(F.substring(c(bits), 64 * k + 1, 64), 64, "0")) for k in range(max(1, -(-n // 64)))]


def from_words(words: ColumnOrName, nbits: ColumnOrName) -> Column:
    return X.text_of(c(words), c(nbits))


def pack(bits: ColumnOrName, endian: str = "big") -> Column:
    return F.struct(F.length(c(bits)).cast("long").alias("nbits"), F.lit(endian).alias("endian"), X.to_bytes(bits, endian).alias("buf"))


def unpack(packed: ColumnOrName) -> Column:
    p = c(packed)
    bits = F.when(p["endian"] == "big", X.from_bytes(p["buf"], "big")).otherwise(X.from_bytes(p["buf"], "little"))
    return F.substring(bits, F.lit(1), p["nbits"].cast("int"))


def popcount(words: Words) -> Column:
    if isinstance(words, list):
        return reduce(Column.__add__, map(F.bit_count, words))
    return F.aggregate(c(words), F.lit(0), lambda s, w: s + F.bit_count(w))


def combine(a: Words, b: Words, op) -> Column | list[Column]:
    if isinstance(a, list):
        return [op(x, y) for x, y in zip(a, b, strict=True)]
    return F.zip_with(c(a), c(b), op)


def and_(a: Words, b: Words) -> Column | list[Column]:
    return combine(a, b, lambda x, y: x.bitwiseAND(y))


def or_(a: Words, b: Words) -> Column | list[Column]:
    return combine(a, b, lambda x, y: x.bitwiseOR(y))


def xor(a: Words, b: Words) -> Column | list[Column]:
    return combine(a, b, lambda x, y: x.bitwiseXOR(y))


def invert(words: ColumnOrName, nbits: ColumnOrName) -> Column:
    """All bits flipped; those after the last stay zero."""
    keep = lambda k: F.when(64 * (k + 1) <= c(nbits), F.lit(-1).cast("long")).otherwise(X.shifted(F.lit(-1).cast("long"), 64 * (k + 1) - c(nbits)))
    return F.transform(c(words), lambda w, k: F.bitwise_not(w).bitwiseAND(keep(k)))


def count_and(a: Words, b: Words) -> Column:
    return popcount(and_(a, b))


def count_or(a: Words, b: Words) -> Column:
    return popcount(or_(a, b))


def count_xor(a: Words, b: Words) -> Column:
    return popcount(xor(a, b))


def any_and(a: Words, b: Words) -> Column:
    if isinstance(a, list):
        return reduce(Column.__or__, (w != 0 for w in and_(a, b)))
    return F.exists(and_(a, b), lambda w: w != 0)


def subset(a: Words, b: Words) -> Column:
    if isinstance(a, list):
        return reduce(Column.__and__, (x == w for x, w in zip(a, and_(a, b))))
    return F.forall(F.zip_with(c(a), c(b), lambda x, y: x.bitwiseAND(y) == x), lambda ok: ok)


def correspond_all(a: Words, b: Words, nbits: ColumnOrName) -> Column:
    """Counts of the four pairs over the words of two vectors of nbits bits: ff, ft, tf, tt."""
    tt, ones_a, ones_b = count_and(a, b), popcount(a), popcount(b)
    return F.struct((c(nbits) - ones_a - ones_b + tt).alias("ff"), (ones_b - tt).alias("ft"), (ones_a - tt).alias("tf"), tt.alias("tt"))
