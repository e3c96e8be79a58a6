"""Document fingerprints with DataFrame functions only.

SimHash: every word's 64-bit hash votes on 64 signed bits with a weight (its length, 8 at most); a
bit is set where the votes for it outweigh those against. Votes are counted in lanes: of a hash the
bits k, k+16, k+32, k+48 are one long with four 16-bit lanes, so 16 sums of longs count all 64 bits
inside the generated code of one hash aggregate. Texts are cut after every 2,048 words so that no
lane overflows, and the parts are added up in wider lanes.

``within`` finds all fingerprints within a Hamming radius by permuted block tables: 64 bits are cut
into radius + 3 blocks, there is a table for every choice of 3 blocks, and two fingerprints within
the radius agree in all blocks of some choice.

The next document of each is found without a global window: ids are dealt into ranges of about
RANGE_BYTES of text, as many as the input needs; the greatest id of each range also goes to the range above
it, and the greatest of all to the lowest range. Their bounds are one row, which is joined to all.

Defined cases: null counts as an empty text; a text without words has fingerprint zero; of equal ids
the order is by the texts' MD5; null ids come last; the only document is its own next one; a very long
text is cut after every 2,048 words, but has to fit a row; an empty table gives no rows; further columns are
ignored. Ids are numbers, and a key: rows that repeat one id, or have none, lie in one range.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, scratch

WORDS_A_PART = 2048
RANGE_BYTES = 512 << 20
LANES = 0x0001000100010001
WIDE = 0x0000FFFF0000FFFF


def votes(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys and the long fp for every row; the keys tell rows apart. Adds no exchange where rows lie together by one of the keys."""
    words = rows.select(*keys, F.posexplode(F.split(F.lower(text), r"\s+")).alias("pos", "word"))
    hashed = words.select(*keys, F.shiftright("pos", 11).alias("part"), F.xxhash64("word").alias("h"), F.least(F.length("word"), F.lit(8)).cast("long").alias("w"))
    lane = lambda k: F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{k}")
    parts = hashed.groupBy(*keys, "part").agg(F.sum("w").alias("w"), *(lane(k) for k in range(16)))
    wide = parts.groupBy(*keys).agg(
        F.sum("w").alias("w"),
        *(F.sum(F.col(f"v{k}").bitwiseAND(F.lit(WIDE))).alias(f"e{k}") for k in range(16)),
        *(F.sum(F.shiftrightunsigned(f"v{k}", 16).bitwiseAND(F.lit(WIDE))).alias(f"o{k}") for k in range(16)),
    )
    count = lambda k, j: F.shiftrightunsigned(f"{'eo'[j % 2]}{k}", 32 * (j // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.when(count(k, j) * 2 > F.col("w"), F.shiftleft(F.lit(1).cast("long"), k + 16 * j)).otherwise(F.lit(0).cast("long")) for k in range(16) for j in range(4)]
    return wide.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def ranges(docs: DataFrame, id_col: str, text_col: str, least: int, range_bytes: int) -> DataFrame:
    """One row: _cuts, the ids that bound ranges of about as many rows, in blocks (_fine) with their last ids (_coarse), and _top, the greatest id.

    There are at least ``least`` ranges, and as many as the bytes of text need.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    count = max(least, -(-size // range_bytes), 2)
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(id_col, [k / count for k in range(1, count)], 20 * count)))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.agg(F.coalesce(cuts, F.array().cast(f"array<{kind}>")).alias("_cuts"), F.max(id_col).alias("_top"))
    step = F.greatest(F.floor(F.sqrt(F.size("_cuts"))), F.lit(1)).cast("int")
    starts = F.when(F.size("_cuts") > 0, F.sequence(F.lit(0), F.size("_cuts") - 1, F.col("_step"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_step", step).withColumn("_fine", F.transform(starts, lambda k: F.slice("_cuts", k + 1, F.col("_step"))))
    return saved(rows.withColumn("_coarse", F.transform("_fine", lambda x: F.element_at(x, -1))), "fingerprint-ranges")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (_range, _at, _ghost, _id, _text, _next): the text of the next document by descending id, after the last that of the first.

    _at is a row's place in its range; rows with _ghost stand there only as another's next.
    """
    spark = docs.sparkSession
    bounds = ranges(docs, id_col, text_col, count or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), range_bytes)
    key, text = F.col("_key"), F.coalesce(F.col("_value"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_value")).crossJoin(F.broadcast(bounds))  # one row, of a number for each RANGE_BYTES
    below = lambda a: F.size(F.filter(a, lambda x: x < key))
    block = F.when(key.isNotNull(), below(F.col("_coarse"))).otherwise(0)
    inside = F.coalesce(F.get("_fine", block), F.slice("_cuts", 1, 0))
    place = F.when(key.isNotNull(), F.least(block * F.col("_step"), F.size("_cuts")) + below(inside)).otherwise(0)
    ghost = lambda r, wrap: F.array(F.struct(r.alias("r"), F.lit(1).alias("g"), F.lit(wrap).alias("wrap")))
    none = F.array().cast("array<struct<r:int,g:int,wrap:int>>")
    also = F.when(F.array_contains(inside, key), ghost(place + 1, 0)).otherwise(none)
    around = F.when(key.eqNullSafe(F.col("_top")), ghost(F.lit(0), 1)).otherwise(none)
    here = F.array(F.struct(place.alias("r"), F.lit(0).alias("g"), F.lit(0).alias("wrap")))
    dealt = rows.select(key.alias("_id"), text.alias("_text"), F.explode(F.concat(here, also, around)).alias("x"))
    dealt = dealt.select("_id", "_text", F.col("x.r").alias("_range"), F.col("x.g").alias("_ghost"), F.col("x.wrap").alias("_wrap"), F.md5("_text").alias("_md5"))
    order = Window.partitionBy("_range").orderBy("_wrap", F.col("_id").desc_nulls_last(), "_md5")
    return dealt.select("_range", F.row_number().over(order).alias("_at"), "_ghost", "_id", "_text", F.lead("_text").over(order).alias("_next"))


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def links(fps: DataFrame, asked: DataFrame, radius: int = 3) -> DataFrame:
    """(q, fp, m): for every distinct fingerprint q of asked those of fps within the radius, and how many rows have them; both have a column fp.

    Documents come with a join on fp, so copies form no pairs.
    """
    blocks = radius + 3
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    tables = list(combinations(range(blocks), 3))
    block = lambda c, i: F.shiftrightunsigned(c, bounds[i]).bitwiseAND(F.lit((1 << (bounds[i + 1] - bounds[i])) - 1))

    def permuted(c: Column, t: int) -> Column:
        """The chosen blocks brought together, with the table's number."""
        value = F.lit(t).cast("long")
        for i in tables[t]:
            value = F.shiftleft(value, bounds[i + 1] - bounds[i]).bitwiseOR(block(c, i))
        return F.struct(F.lit(t).alias("t"), value.alias("key"))

    spread = lambda df, c: df.select("*", F.inline(F.array(*(permuted(F.col(c), t) for t in range(len(tables))))))
    there = spread(fps.groupBy("fp").agg(F.count("*").alias("m")), "fp")
    query = spread(asked.select(F.col("fp").alias("q")).distinct(), "q").select("q", F.col("t").alias("qt"), F.col("key").alias("qk"))
    x = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(len(tables))  # of the tables in which the two agree
    for t in reversed(range(len(tables))):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in tables[t])
        first = F.when(x.bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64))) == 0, F.lit(t)).otherwise(first)
    # no broadcast: the planner takes the queries for as small as they are before they are spread over the tables
    met = query.hint("merge").join(there, (F.col("qt") == F.col("t")) & (F.col("qk") == F.col("key")) & (F.bit_count(x) <= radius) & (first == F.col("t")))
    return met.select("q", "fp", "m")


def within(fps: DataFrame, asked: DataFrame, radius: int = 3) -> DataFrame:
    """(q, n): for every distinct fingerprint q of asked the number of rows of fps within the radius."""
    return links(fps, asked, radius).groupBy("q").agg(F.sum("m").alias("n"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, every: int = 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_within.

    n_within: rows within the radius of this fingerprint, itself included, for every ``every``-th id, else null.
    """
    with scratch(docs.sparkSession) as work:
        rows = with_next(docs, id_col, text_col)
        n = F.length("_text")
        half = F.floor(n / 2).cast("int")
        edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
        both = rows.select("_range", "_at", "_ghost", "_id", "_text", n.cast("long").alias("n_chars"), F.when(F.col("_ghost") == 0, edited).alias("_edited"))
        both = both.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
        keys = ["_range", "_at", "_ghost", "_id", "n_chars", "edited_sha256"]
        sides = both.select(*keys, F.posexplode(F.when(F.col("_ghost") == 0, F.array("_text", "_edited")).otherwise(F.array("_text"))).alias("_side", "_words"))
        counted = votes(sides, [*keys, "_side"], F.col("_words"))
        side = lambda s: F.max(F.when(F.col("_side") == s, F.col("fp")))
        paired = counted.groupBy(*keys).agg(side(0).alias("fp"), side(1).alias("edited"))
        paired = paired.withColumn("next", F.lead("fp").over(Window.partitionBy("_range").orderBy("_at"))).where("_ghost = 0")
        found = saved(paired.select(F.col("_id"), "n_chars", "edited_sha256", "fp", "edited", "next"), "fingerprints")
        asked = F.pmod(F.col("_id"), F.lit(every)) == 0
        near = saved(within(found, found.where(asked), radius), "fingerprints-within")
        known = work.result(found.join(near, asked & (F.col("fp") == F.col("q")), "left"), "fingerprints-result")
    return known.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited")).alias("edited_fingerprint"),
        likeness("fp", "edited").alias("near_edited"),
        likeness("fp", "next").alias("near_next"),
        F.col("n").alias("n_within"),
    )
