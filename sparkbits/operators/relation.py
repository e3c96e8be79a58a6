"""Bit vectors as rows: one per bit (id, idx, bit) or one per 64-bit word (id, word_idx, word).

This is the form for vectors too long for one value and for work over many vectors at once. All
operators are joins and aggregates that partition by id (or by id and word), with partial
aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W


def explode_bits(df: DataFrame, id_col: str, bits_col: str = "bits") -> DataFrame:
    """(id, idx, bit) of a text column."""
    return df.select(id_col, F.posexplode(X.to_list(bits_col)).alias("idx", "bit"))


def ones(df: DataFrame, id_col: str, bits_col: str = "bits") -> DataFrame:
    """(id, idx) of the set bits: the sparse form."""
    return df.select(id_col, F.explode(X.search(bits_col, "1")).alias("idx"))


def collapse_bits(rows: DataFrame, id_col: str) -> DataFrame:
    """Back to (id, bits), in the order of idx."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "bit")))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["bit"].cast("string")), "").alias("bits"))


def explode_words(df: DataFrame, id_col: str, bits_col: str = "bits") -> DataFrame:
    """(id, word_idx, word, nbits) with the first bit of a word highest and zeros behind the last bit."""
    return df.select(id_col, F.length(bits_col).alias("nbits"), F.posexplode(W.to_words(bits_col)).alias("word_idx", "word"))


def collapse_words(rows: DataFrame, id_col: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "word")))
    words = rows.groupBy(id_col).agg(F.transform(ordered, lambda x: x["word"]).alias("words"), F.max("nbits").alias("nbits"))
    return words.select(id_col, W.from_words("words", "nbits").alias("bits"))


def combine_words(a: DataFrame, b: DataFrame, id_col: str, op) -> DataFrame:
    """Bitwise operation on equal (id, word_idx); op gets two BIGINT columns."""
    other = b.select(id_col, "word_idx", F.col("word").alias("other"))
    return a.join(other, [id_col, "word_idx"]).withColumn("word", op(F.col("word"), F.col("other"))).drop("other")


def count_words(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.sum(F.bit_count("word")).alias("ones"))


#: Neighbouring indices of one vector that one task numbers; a longer vector is several blocks.
BLOCK_BITS = 16


def ranked(rows: DataFrame, id_col: str, name: str = "rank", weight: Column | None = None, idx: str = "idx") -> DataFrame:
    """rows with the number of rows (or sum of weights) of the same id and smaller index.

    Blocks of 65,536 indices are summed first; one row a block is then summed over the vector, and inside
    blocks rows are numbered apart from each other. No task has to hold or sort a whole vector.
    """
    weight = F.lit(1) if weight is None else weight
    block = F.shiftright(F.col(idx).cast("long"), BLOCK_BITS)
    weighed = rows.withColumn("_b", block).withColumn("_w", weight.cast("long"))
    sums = weighed.groupBy(id_col, "_b").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(id_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = sums.select(F.col(id_col).alias("_id"), F.col("_b").alias("_block"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(id_col, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    placed = weighed.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    met = placed.join(starts, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_block")))
    return met.withColumn(name, F.col("_start") + F.col("_in")).drop("_b", "_w", "_in", "_id", "_block", "_start")


def renumber(rows: DataFrame, id_col: str) -> DataFrame:
    """Indices 0, 1, ... in the old order."""
    return ranked(rows, id_col).withColumn("idx", F.col("rank")).drop("rank")


def mask_select(rows: DataFrame, mask: DataFrame, id_col: str) -> DataFrame:
    """Bits where the mask of the same id has a one, renumbered."""
    kept = mask.where("bit = 1").select(id_col, "idx")
    return renumber(rows.join(kept, [id_col, "idx"], "left_semi"), id_col)


def mask_delete(rows: DataFrame, mask: DataFrame, id_col: str) -> DataFrame:
    gone = mask.where("bit = 1").select(id_col, "idx")
    return renumber(rows.join(gone, [id_col, "idx"], "left_anti"), id_col)


def mask_scatter(rows: DataFrame, mask: DataFrame, values: DataFrame, id_col: str) -> DataFrame:
    """The r-th one of the mask takes bit r of values; both have rows (id, idx, bit)."""
    new = ranked(mask.where("bit = 1"), id_col).join(values.select(id_col, F.col("idx").alias("rank"), F.col("bit").alias("new")), [id_col, "rank"]).select(id_col, "idx", "new")
    return rows.join(new, [id_col, "idx"], "left").select(id_col, "idx", F.coalesce("new", "bit").alias("bit"))


def gather(rows: DataFrame, places: DataFrame, id_col: str) -> DataFrame:
    """places has (id, pos, idx): bit idx comes to place pos."""
    return places.join(rows, [id_col, "idx"]).select(id_col, F.col("pos").alias("idx"), "bit")


def scatter(rows: DataFrame, updates: DataFrame, id_col: str, extend: bool = False) -> DataFrame:
    """updates has (id, pos, idx, bit); of several for one index that with the greatest pos stays.

    An update beyond the end does nothing, or with extend becomes a bit behind the last one.
    """
    last = updates.groupBy(F.col(id_col).alias("u_id"), F.col("idx").alias("u_idx")).agg(F.max_by("bit", "pos").alias("new"))
    met = rows.join(last, F.col(id_col).eqNullSafe(F.col("u_id")) & (F.col("idx") == F.col("u_idx")), "full" if extend else "left")
    return met.select(F.coalesce(id_col, "u_id").alias(id_col), F.coalesce("idx", "u_idx").alias("idx"), F.coalesce("new", "bit").alias("bit"))


def delete(rows: DataFrame, places: DataFrame, id_col: str) -> DataFrame:
    return renumber(rows.join(places.select(id_col, "idx"), [id_col, "idx"], "left_anti"), id_col)


def intervals(rows: DataFrame, id_col: str) -> DataFrame:
    """Maximal runs (id, value, start, stop): the r-th place where a run begins goes with the r-th where one ends.

    Neighbours meet in joins on (id, idx), so a long vector is spread over tasks.
    """
    beside = lambda d: rows.select(F.col(id_col).alias("o_id"), (F.col("idx") + d).alias("o_idx"), F.col("bit").alias("o_bit"))
    edge = lambda d: rows.join(beside(d), F.col(id_col).eqNullSafe(F.col("o_id")) & (F.col("idx") == F.col("o_idx")), "left").where("o_bit is null or o_bit <> bit").select(id_col, "idx", "bit")
    starts = ranked(edge(1), id_col).select(F.col(id_col).alias("s_id"), "rank", F.col("bit").alias("value"), F.col("idx").cast("long").alias("start"))
    ends = ranked(edge(-1), id_col).select(id_col, F.col("rank").alias("e_rank"), (F.col("idx") + 1).cast("long").alias("stop"))
    return ends.join(starts, F.col(id_col).eqNullSafe(F.col("s_id")) & (F.col("rank") == F.col("e_rank"))).select(id_col, "value", "start", "stop")


def count_n(rows: DataFrame, id_col: str, n: int, value: int = 1) -> DataFrame:
    """(id, place): the least index below which n bits have the value; null where there are fewer."""
    seen = ranked(rows, id_col, "seen", (F.col("bit") == value).cast("int"))
    hit = F.when((F.col("bit") == value) & (F.col("seen") == n - 1), F.col("idx") + 1)
    return seen.groupBy(id_col).agg((F.lit(0).cast("long") if n == 0 else F.min(hit)).alias("place"))


def count_n_words(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """count_n for ones over word rows: a prefix sum over words, then a search inside one word."""
    upto = ranked(rows, id_col, "before", F.bit_count("word"), idx="word_idx")
    hit = upto.where((F.col("before") < n) & (F.col("before") + F.bit_count("word") >= n))
    inside = F.element_at(X.search(F.lpad(F.bin("word"), 64, "0"), "1"), (n - F.col("before")).cast("int"))
    return hit.select(id_col, (64 * F.col("word_idx") + inside + 1).alias("place"))


def index_sums(set_rows: DataFrame, id_col: str) -> DataFrame:
    """(id, sum_idx, sum_sq, xor_idx, n) over rows (id, idx) of set bits."""
    k = F.col("idx").cast("decimal(18,0)")
    return set_rows.groupBy(id_col).agg(F.sum(k.cast("decimal(38,0)")).alias("sum_idx"), F.sum((k * k).cast("decimal(38,0)")).alias("sum_sq"), F.bit_xor(F.col("idx").cast("long")).alias("xor_idx"), F.count("*").alias("n"))


def first_k(set_rows: DataFrame, k: int, right: bool = False) -> DataFrame:
    """The k least (or greatest) indices over all rows: a top-k, not a sort."""
    return set_rows.orderBy(F.desc("idx") if right else F.asc("idx")).limit(k)


#: Rows of a block of all_pairs, and pairs that a task makes.
PAIR_ROWS, PAIRS_A_TASK = 1024, 1 << 23


def all_pairs(a: DataFrame, a_key: str, b: DataFrame, b_key: str, rows: int = PAIR_ROWS, per_task: int = PAIRS_A_TASK) -> DataFrame:
    """Every row of a beside every row of b; the two have no column in common.

    Either side is dealt into blocks of about 1,024 rows by its key, and each pair of blocks is one key of a hash join:
    a task holds a few blocks, whatever the tables' size. The number of tasks follows that of the pairs, as sizes in
    bytes say nothing of the work; a number given to repartition isn't lessened at run time.
    """
    n_a, n_b = a.count(), b.count()
    blocks_a, blocks_b = max(1, -(-n_a // rows)), max(1, -(-n_b // rows))
    tasks = min(blocks_a * blocks_b, max(1, -(-n_a * n_b // per_task)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    first = lambda k: F.lit(k).cast("long")
    left = a.withColumn("_i", block(a_key, blocks_a) * blocks_b).select("*", F.explode(F.sequence(F.col("_i"), F.col("_i") + (blocks_b - 1), first(1))).alias("_g")).drop("_i")
    right = b.withColumn("_j", block(b_key, blocks_b)).select("*", F.explode(F.sequence(F.col("_j"), F.col("_j") + blocks_b * (blocks_a - 1), first(blocks_b))).alias("_g")).drop("_j")
    return left.repartition(tasks, "_g").hint("shuffle_hash").join(right.repartition(tasks, "_g"), "_g").drop("_g")


#: Blocks that the containing side is dealt into where an empty vector asks for all of it.
BLOCKS = 32


def subset_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) of vectors (id, bits) of one length, every set bit of a being set in b.

    Each a looks only among the b that have its rarest set bit, by the counts of all b, and whole
    vectors are compared as words. A vector without ones is in every b: such ones meet all b in blocks.
    """
    left = a.select(F.col("id").alias("a_id"), F.length("bits").alias("a_n"), W.to_words("bits").alias("a_w"), X.search("bits", "1").alias("a_ones"))
    right = b.select(F.col("id").alias("b_id"), F.length("bits").alias("b_n"), W.to_words("bits").alias("b_w"), X.search("bits", "1").alias("b_ones"))
    counts = right.select(F.explode("b_ones").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    asked = left.select("a_id", F.explode("a_ones").alias("idx")).join(counts, F.col("idx") == F.col("k"), "left")
    rarest = asked.groupBy(F.col("a_id").alias("r_id")).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "idx"))["idx"].alias("rare"))
    keyed = left.join(rarest, F.col("a_id").eqNullSafe(F.col("r_id")))
    some = keyed.join(right.select("b_id", "b_n", "b_w", F.explode("b_ones").alias("idx")), F.col("rare") == F.col("idx"))
    found = some.where((F.col("a_n") == F.col("b_n")) & W.subset("a_w", "b_w")).select("a_id", "b_id")
    empty = left.where(F.size("a_ones") == 0).select("a_id", "a_n", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)).cast("array<bigint>")).alias("g"))
    dealt = right.select("b_id", "b_n", F.pmod(F.xxhash64("b_id"), F.lit(BLOCKS)).alias("h"))
    return found.unionByName(empty.join(dealt, (F.col("g") == F.col("h")) & (F.col("a_n") == F.col("b_n"))).select("a_id", "b_id"))


def bitmap(rows: DataFrame, key: str | list[str], position: Column) -> DataFrame:
    """(key, bucket, bitmap, ones): positions as 32,768-bit bitmaps of BINARY, lowest bit first."""
    keys = [key] if isinstance(key, str) else key
    return rows.select(*keys, position.alias("p")).groupBy(*keys, F.bitmap_bucket_number(F.col("p")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p"))).alias("bitmap")).withColumn("ones", F.bitmap_count("bitmap"))
