"""Vectors made from nothing: zeros, ones, random vectors, primes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _word(size: int = 64):
    return F.expr(f"bit_or(shiftleft(1L, {size - 1} - cast(idx % {size} as int)))")


#: Up to this share of ones a word is drawn by the place of its first one.
SPARSE = 1 / 32


def _dense_word(p: float, seed: int):
    digits = f"{round(p * (1 << 64)):064b}".rstrip("0") if p < 1 else ""
    word = F.lit(-1 if p == 1 else 0).cast("long")
    for k, digit in enumerate(reversed(digits)):
        fair = F.xxhash64(F.lit(seed), F.lit(k), F.col("id"))
        word = fair if k == 0 else fair.bitwiseOR(word) if digit == "1" else fair.bitwiseAND(word)
    return word


def _sparse_word(p: float, seed: int):
    """Most words are zero, which one hash tells; the others have their first one by a geometric gap and are drawn densely behind it."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(64), F.col("id")), 11) * F.lit(2.0**-53)
    some = u < -math.expm1(64 * math.log1p(-p))
    first = F.least(F.floor(F.log1p(-u) / math.log1p(-p)), F.lit(63)).cast("int")
    top = F.call_function("shiftleft", F.lit(1).cast("long"), 63 - first)
    behind = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), 63 - first))
    return F.when(some, top.bitwiseOR(_dense_word(p, seed).bitwiseAND(behind))).otherwise(F.lit(0).cast("long"))


def random_words(spark: SparkSession, n: int, p: float = 0.5, seed: int = 0) -> DataFrame:
    """(word_idx, word) of n bits that are one with probability p each; the last word has zeros behind bit n.

    A fair word is one hash. The binary digits of p, from the last to the first, join fair words by
    ``or`` for a one and ``and`` for a zero, which gives every bit the probability p (to 64 digits).
    For few ones (or few zeros) the gap to the first one of a word is drawn first.
    """
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be in range 0.0 <= p <= 1.0")
    if 0 < p <= SPARSE or 1 - SPARSE <= p < 1:
        word = _sparse_word(min(p, 1 - p), seed)
        word = word if p < 0.5 else F.bitwise_not(word)
    else:
        word = _dense_word(p, seed)
    last, rest = divmod(n, 64)
    if rest:
        word = F.when(F.col("id") == last, word.bitwiseAND(F.lit(-1 << (64 - rest)).cast("long"))).otherwise(word)
    return spark.range(last + (rest > 0)).select(F.col("id").alias("word_idx"), word.alias("word"))


def bits(words: DataFrame, n: int) -> DataFrame:
    """(idx, bit) of rows (word_idx, word), the first n bits."""
    one = words.select("word_idx", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    return one.select((64 * F.col("word_idx") + F.col("k")).alias("idx"), F.call_function("getbit", "word", 63 - F.col("k")).cast("int").alias("bit")).where(F.col("idx") < n)


def urandom(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """(idx, bit) of n fair bits, others on each call unless there is a seed."""
    import random

    return bits(random_words(spark, n, 0.5, random.SystemRandom().getrandbits(31) if seed is None else seed), n)


def random_p(spark: SparkSession, n: int, p: float = 0.5, seed: int = 0) -> DataFrame:
    """(idx, bit): every bit is one with probability p."""
    return bits(random_words(spark, n, p, seed), n)


def random_k(spark: SparkSession, n: int, k: int, seed: int = 0) -> DataFrame:
    """(idx, bit) with exactly k ones, every choice as likely as any other.

    The k least of n random keys are ones. Counts of the keys' first 16 bits tell in which of 65,536
    bins the k-th lies; bins below it are all ones, and only its own rows are ranked.
    """
    if not 0 <= k <= n:
        raise ValueError("k must be in range 0 <= k <= n")
    key = F.xxhash64(F.lit(seed), F.col("id"))
    keyed = spark.range(n).select(F.col("id").alias("idx"), key.alias("key"), F.shiftrightunsigned(key, 48).alias("bin"))
    left, edge = k, 0
    for edge, size in sorted((r.bin, r.n) for r in keyed.groupBy("bin").agg(F.count("*").alias("n")).collect()):  # at most 65,536 rows
        if size >= left:
            break
        left -= size
    few = keyed.where(F.col("bin") == edge).orderBy("key", "idx").limit(left).select(F.col("idx").alias("chosen"))
    one = (F.col("bin") < edge) | F.col("chosen").isNotNull()
    return keyed.join(few, F.col("idx") == F.col("chosen"), "left").select("idx", F.when(one, 1).otherwise(0).alias("bit"))


SEGMENT = 1 << 20


def primes(spark: SparkSession, n: int, odd: bool = False) -> DataFrame:
    """(idx) of the ones, in no order: idx (or 2 idx + 1 with odd) is prime.

    Segments of SEGMENT numbers are sieved apart from each other by the primes up to the root of n, so nothing is shuffled.
    """
    top = 2 * n if odd else n
    root = np.ones(math.isqrt(max(top - 1, 0)) + 1, bool)
    root[:2] = False
    for p in range(2, math.isqrt(len(root)) + 1):
        if root[p]:
            root[p * p :: p] = False
    base = np.flatnonzero(root)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.column(0).to_pylist():
                start = segment * SEGMENT
                is_prime = np.ones(min(SEGMENT, top - start), bool)
                is_prime[: max(0, 2 - start)] = False
                for p in base.tolist():
                    is_prime[max(p * p, -(-start // p) * p) - start :: p] = False
                found = np.flatnonzero(is_prime) + start
                found = (found[found % 2 == 1] - 1) // 2 if odd else found
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["idx"])

    count = -(-max(top, 0) // SEGMENT)
    return spark.range(0, count, 1, max(1, min(count, 4096))).mapInArrow(sieve, "idx long")


def sieve_report(spark: SparkSession, n: int) -> DataFrame:
    """count, twins, sum and sum of squares of the primes below n."""
    p = primes(spark, n)
    twins = p.join(p.select((F.col("idx") + 2).alias("idx")), "idx", "left_semi").select(F.count("*").alias("twins"))
    k = F.col("idx").cast("decimal(18,0)")
    return p.agg(F.count("*").alias("count"), F.sum("idx").alias("sum_p"), F.sum(k * k).cast("decimal(38,0)").alias("sum_sq")).crossJoin(twins)  # one row each


def nth_prime(spark: SparkSession, n: int) -> DataFrame:
    """The n-th prime, below the bound n (ln n + ln ln n). Only the segment that holds it is ranked."""
    bound = 15 if n < 6 else int(n * (math.log(n) + math.log(math.log(n)))) + 1
    found = primes(spark, bound + 1).withColumn("segment", F.floor(F.col("idx") / SEGMENT))
    left, segment = n, 0
    for segment, size in sorted((r.segment, r.c) for r in found.groupBy("segment").agg(F.count("*").alias("c")).collect()):  # a row a segment
        if size >= left:
            break
        left -= size
    return found.where(F.col("segment") == segment).orderBy("idx").limit(left).agg(F.max("idx").alias("prime"))


def middle_numbers(spark: SparkSession, n: int) -> DataFrame:
    """(m): numbers between twin primes below n."""
    p = primes(spark, n).withColumnRenamed("idx", "p")
    return p.select((F.col("p") + 1).alias("m")).join(p.select((F.col("p") - 1).alias("m")), "m", "left_semi")


def words(rows: DataFrame) -> DataFrame:
    """(word_idx, word) of rows (idx) of ones or (idx, bit)."""
    ones = rows.where("bit = 1") if "bit" in rows.columns else rows
    return ones.groupBy(F.floor(F.col("idx") / 64).alias("word_idx")).agg(_word().alias("word"))


def ranked(rows: DataFrame, within: str) -> DataFrame:
    """(within, idx, rank) of ones, counted from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy("idx")))
