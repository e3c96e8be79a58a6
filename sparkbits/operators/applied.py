"""Operators made of bit vectors: Bloom filters, error correction, automata, registers, permutations, sparse forms, bitmaps."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# ---- Bloom filters


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n keys and a rate p of false positives."""
    if not 0 < p < 1 or n < 1:
        raise ValueError("0 < p < 1 and n >= 1 expected")
    return math.ceil(-n * math.log2(p) / math.log(2)), math.ceil(-math.log2(p))


#: Bits of one shard. A longer filter is many filters side by side, and a key has all its places in one of them.
SHARD_BITS = 1 << 22


def bloom_shards(m: int) -> tuple[int, int]:
    """(shards, bits of each) of a filter of m bits or a few more; one shard has m bits exactly."""
    n = -(-m // SHARD_BITS)
    return (1, m) if n == 1 else (n, -(-m // (64 * n)) * 64)


def bloom_shard(key: Column, m: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(bloom_shards(m)[0])).cast("long")


def bloom_positions(key: Column, m: int, k: int) -> Column:
    shards, bits = bloom_shards(m)
    inside = lambda j: F.pmod(F.xxhash64(key, j), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), inside if shards == 1 else lambda j: bloom_shard(key, m) * bits + inside(j))


def bloom_build(df: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """(word_idx, word): the filter as 64-bit words; at most m / 64 rows whatever the input's size.

    With several shards the keys are dealt out by shard, not their k places: a word is made inside one task.
    """
    shards, bits = bloom_shards(m)
    word = F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("word")
    if shards == 1:
        places = df.select(F.explode(bloom_positions(F.col(key), m, k)).alias("p"))
        return places.groupBy(F.floor(F.col("p") / 64).alias("word_idx")).agg(word)
    dealt = df.select(F.col(key).alias("key"), bloom_shard(F.col(key), m).alias("shard")).repartition("shard")
    places = dealt.select("shard", F.explode(bloom_positions(F.col("key"), m, k)).alias("p"))
    return places.groupBy("shard", F.floor(F.col("p") / 64).alias("word_idx")).agg(word).select("word_idx", "word")


def bloom_probe(df: DataFrame, key: str, bloom: DataFrame, m: int, k: int, local_bits: int = 1 << 24) -> DataFrame:
    """df with ``maybe``: all k positions of the key are set.

    A filter of up to local_bits (2 MB) is read once and becomes a constant of the plan; of a longer one, each row
    meets the words of its own shard (512 kB) as an array, so rows are moved once and their places never.
    """
    shards, bits = bloom_shards(m)
    col = F.col(key)
    at = lambda j: F.pmod(F.xxhash64(col, F.lit(j)), F.lit(bits))
    if m <= local_bits:
        words = [0] * (shards * bits // 64 + 1)
        for r in bloom.select("word_idx", "word").collect():  # at most local_bits / 64 rows
            words[r.word_idx] = r.word
        data = F.lit(b"".join(w.to_bytes(8, "big", signed=True) for w in words))
        # eight bytes of a constant as a number: its place is found without walking it
        word = lambda p: F.conv(F.hex(F.substring(data, F.shiftright(p, 6).cast("int") * 8 + 1, F.lit(8))), 16, -10).cast("long")
        place = at if shards == 1 else lambda j: bloom_shard(col, m) * bits + at(j)
        hit = [F.call_function("getbit", word(place(j)), (place(j) % 64).cast("int")) == 1 for j in range(k)]
        return df.withColumn("maybe", reduce(Column.__and__, hit))
    each = -(-bits // 64)
    listed = bloom.groupBy(F.floor(F.col("word_idx") / each).cast("long").alias("_s")).agg(F.array_sort(F.collect_list(F.struct((F.col("word_idx") % each).cast("int").alias("i"), "word"))).alias("_l"))
    before = F.concat(F.array(F.lit(-1)), F.transform("_l", lambda x: x["i"]))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    dense = F.flatten(F.zip_with(F.slice("_l", 1, each), F.slice(before, F.lit(1), F.size("_l")), lambda x, b: F.concat(zeros(x["i"] - b - 1), F.array(x["word"]))))
    filters = listed.select("_s", F.concat(dense, zeros(each - 1 - F.element_at("_l", -1)["i"])).alias("_w"))
    hit = [F.call_function("getbit", F.get("_w", F.floor(at(j) / 64).cast("int")), (at(j) % 64).cast("int")) == 1 for j in range(k)]
    met = df.withColumn("_shard", bloom_shard(col, m)).join(filters.hint("shuffle_hash"), F.col("_shard") == F.col("_s"), "left")
    return met.withColumn("maybe", F.coalesce(reduce(Column.__and__, hit), F.lit(False))).drop("_shard", "_s", "_w")


def bloom_stats(bloom: DataFrame, m: int, k: int) -> DataFrame:
    """ones, approx_items and the current rate of false positives."""
    size = math.prod(bloom_shards(m))
    ones = F.sum(F.bit_count("word"))
    return bloom.agg(ones.alias("ones")).select("ones", (-F.lit(size / k) * F.log(1 - F.col("ones") / size)).alias("approx_items"), F.pow(F.col("ones") / size, F.lit(k)).alias("rate"))


# ---- Hamming code: parity bits at the powers of two, and bit 0 so that the parity of all is even


def hamming_send(bits: Column) -> Column:
    """Data bits at the places that are no power of two, with parity bits put in."""

    def placed(b: Column) -> Column:
        n = F.length(b)
        r = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(0), lambda r, j: F.when(F.pow(F.lit(2), r) < n + r + 1, j).otherwise(r))
        return X.joined(F.transform(X.span(n + r + 1), lambda k: F.when(F.bit_count(k) > 1, X.at(b, k - F.length(F.bin(k.cast("long"))) - 1)).otherwise("0")))

    def checked(data: Column) -> Column:
        return X.let(X.xor_indices(data), lambda s: X.joined(F.transform(X.span(F.length(data)), lambda k: F.when(F.bit_count(k) == 1, F.when(s.bitwiseAND(k) != 0, "1").otherwise("0")).otherwise(X.at(data, k)))))

    return X.let(X.let(X.let(bits, placed), checked), lambda x: F.concat(X.parity(x).cast("string"), X.tail(x, 1)))


def hamming_receive(bits: Column) -> Column:
    """STRUCT<bits, errors>: the data and the number of wrong bits, 0, 1 (put right) or 2 (not to be trusted)."""

    def received(b: Column, place: Column) -> Column:
        flipped = lambda k: F.when(k == place, F.translate(X.at(b, k), "01", "10")).otherwise(X.at(b, k))
        data = X.joined(F.transform(F.filter(X.span(F.length(b)), lambda k: F.bit_count(k) > 1), flipped))
        return F.struct(data.alias("bits"), F.when(X.parity(b) == 1, 1).when(place != 0, 2).otherwise(0).alias("errors"))

    return X.let(bits, lambda b: X.let(X.xor_indices(b), lambda place: received(b, place)))


# ---- automata and registers


def _checked(bits: str) -> str:
    if not bits or set(bits) - {"0", "1"}:
        raise ValueError("non-empty string of 0 and 1 expected")
    return bits


def rule90(spark: SparkSession, start: str, steps: int) -> DataFrame:
    """(step, bits): every bit becomes the exclusive or of its neighbours, around the ends."""
    n = len(start)
    left, right = "concat(substring(bits, 2), left(bits, 1))", "concat(right(bits, 1), left(bits, length(bits) - 1))"
    both = f"array_join(transform(sequence(1, {n}), k -> if(substring({left}, k, 1) = substring({right}, k, 1), '0', '1')), '')"
    return spark.sql(f"WITH RECURSIVE r(step, bits) AS (SELECT 0, '{_checked(start)}' UNION ALL SELECT step + 1, {both} FROM r WHERE step < {int(steps)}) SELECT step, bits FROM r")


def lfsr(spark: SparkSession, state: int, taps: int, width: int, steps: int) -> DataFrame:
    """(step, state) of a shift register: the parity of the tapped bits comes in at the top."""
    new = f"shiftright(state, 1) | shiftleft(cast(bit_count(state & {int(taps)}L) % 2 as bigint), {int(width) - 1})"
    return spark.sql(f"WITH RECURSIVE r(step, state) AS (SELECT 0, {int(state)}L UNION ALL SELECT step + 1, {new} FROM r WHERE step < {int(steps)}) SELECT step, state FROM r")


def lfsr_period(states: DataFrame) -> DataFrame:
    """First step at which the state of step 0 comes back."""
    first = states.where("step = 0").select(F.col("state").alias("start"))
    return states.where("step > 0").join(F.broadcast(first), F.col("state") == F.col("start")).agg(F.min("step").alias("period"))  # one row


# ---- permutations with the same number of ones


def lexico_next(value: Column) -> Column:
    """The next greater BIGINT with as many ones (up to 62 bits)."""
    low = value.bitwiseAND(-value)
    ripple = value + low
    return ripple.bitwiseOR(F.shiftrightunsigned(F.floor(value.bitwiseXOR(ripple) / low).cast("long"), 2))


def lexico_all(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(bits) of all vectors of length n with k ones, in no order."""
    if not 0 <= k <= n:
        raise ValueError("k must be in range 0 <= k <= n")
    rows = spark.range(1).select(F.lit("").alias("bits"))
    for done in range(n):
        used = F.length(F.replace(F.col("bits"), F.lit("0"), F.lit("")))
        rows = rows.select(F.explode(F.array(F.concat("bits", F.lit("0")), F.concat("bits", F.lit("1")))).alias("bits")).where((used <= k) & (used + (n - done - 1) >= k))
    return rows


# ---- sparse forms


def flips(bits: Column) -> Column:
    """Places where the value changes, counted from a zero before the start; the length comes last."""
    return X.let(bits, lambda b: F.concat(X.places(X.edges(b, F.lit("0")), "1"), F.array(F.length(b))))


def from_flips(places: Column) -> Column:
    """Runs between neighbouring places, zeros and ones taking turns."""
    value = F.array(F.lit("0"), F.lit("1"))
    run = lambda v: F.transform(v["p"], lambda z, r: F.repeat(F.get(value, r.bitwiseAND(F.lit(1))), z - F.get(v["before"], r)))
    return X.let(places, lambda p: X.let(F.struct(p.alias("p"), F.concat(F.array(F.lit(0)), p).alias("before")), lambda v: X.joined(run(v))))


def sparse_ones(bits: Column) -> Column:
    return F.struct(F.length(bits).alias("n"), X.search(bits, "1").alias("ones"))


def from_sparse(sparse: Column) -> Column:
    """A one after each run of zeros, and the zeros behind the last."""
    def run(v: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), v["ones"])
        gaps = F.zip_with(v["ones"], before, lambda k, b: F.lpad(F.lit("1"), k - b, F.lit("0")))  # null behind the last one, which joins as nothing
        return F.rpad(X.joined(gaps), v["n"], F.lit("0"))

    return X.let(sparse, run)


# ---- images


def pbm(rows: DataFrame, width: int) -> DataFrame:
    """(content): a binary PBM file from rows (y, bits) of equal width; each line is padded to whole bytes."""
    lines = F.array_sort(F.collect_list(F.struct("y", F.hex(X.to_bytes("bits")).alias("h"))))
    body = F.array_join(F.transform(lines, lambda x: x["h"]), "")
    return rows.groupBy().agg(F.unhex(F.concat(F.hex(F.encode(F.concat(F.lit(f"P4\n{width} "), F.count("*").cast("string"), F.lit("\n")), "utf-8")), body)).alias("content"))


def from_pbm(content: Column) -> Column:
    """Array of the image's lines as bits, top line first."""
    head = F.regexp_extract(F.decode(F.substring(content, 1, 64), "iso-8859-1"), r"(?s)^(P4\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s)", 1)
    size = lambda g: F.regexp_extract(head, r"(\d+)\s+(\d+)\s$", g).cast("int")
    each = F.ceil(size(1) / 8)
    line = lambda y: X.head(X.from_bytes(F.substring(content, F.length(head) + 1 + (y * each).cast("int"), each.cast("int"))), size(1))
    return F.transform(X.span(size(2)), line)


def mandelbrot(spark: SparkSession, width: int, height: int, steps: int = 30) -> DataFrame:
    """(y, bits): ones where the iteration stays bounded."""
    grid = spark.range(width * height).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    re, im = F.col("x") * (3.5 / width) - 2.5, F.col("y") * (2.0 / height) - 1.0
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(True).alias("inside"))
    step = lambda s, _: F.struct((s["a"] * s["a"] - s["b"] * s["b"] + re).alias("a"), (2 * s["a"] * s["b"] + im).alias("b"), (s["inside"] & (s["a"] * s["a"] + s["b"] * s["b"] <= 4)).alias("inside"))
    bounded = lambda s, _: F.when(s["inside"], step(s, _)).otherwise(s)
    bit = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, bounded, lambda s: s["inside"].cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("x", bit.cast("string").alias("b"))))
    return grid.groupBy("y").agg(F.array_join(F.transform(ordered, lambda v: v["b"]), "").alias("bits"))
