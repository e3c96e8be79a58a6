"""SimHash near-duplicate groups by an inverted index over byte positions.

Two 64-bit fingerprints within 3 bits agree in at least 5 of their 8 bytes. The index lists
fingerprints under (positions, values) of 4 bytes at a time, for the 14 sets of positions that are
the planes of the cube {0,1}^3: whichever 3 bytes differ lie in one plane, and the opposite plane
is a set of 4 bytes that agree, so every wanted pair meets in some list. (Lists of single bytes
would hold a 256th of all fingerprints each.) Within a list the equal bytes of a pair are tallied,
pairs below 5 go, and the rest are verified by the differing bits.

Equal fingerprints are one node, so copies form no pairs. A list of up to ``block`` fingerprints is
one cell. A longer one is listed once more under its key and half of the 32 bits that the key leaves
open, in 20 ways of which one at least holds any wanted pair; such a list is a 65,536th of the first,
and only if it is too long again it is cut into blocks, every pair of blocks being a cell. So no task
holds a whole long list. A cell gives a spanning forest of its links, never all pairs. Components are
then found by star contraction.

Defined cases: null and empty texts and texts of blanks have fingerprint zero and are linked like
any other; equal rows stay equal rows; a component's id is its least doc_id, null if it has none;
a very long text is hashed 65,536 shingles at a time, but its words have to fit a worker; an empty table gives
no rows; further columns are ignored by fingerprints and kept by ``deduplicate`` and ``deduplicate_similar``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, field, map_arrow, record_batch, saved, scratch, shared_dir
from .components import components

SEED = 42
RADIUS = 3
#: Bytes that agree at least where at most RADIUS bits differ.
SHARED = 8 - RADIUS
#: The planes {x : a . x = c (mod 2)} of the cube whose corners number the byte positions.
PLANES = [[x for x in range(8) if bin(a & x).count("1") % 2 == c] for a in range(1, 8) for c in (0, 1)]


def shingle_hashes(text: bytes, n: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of all word n-grams, 65,536 at a time."""
    import xxhash

    digest, words = xxhash.xxh64_intdigest, text.lower().split()
    if not words:
        return
    if len(words) < n:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)
        return
    for start in range(0, len(words) - n + 1, 65536):
        part = words[start : start + 65536 + n - 1]
        if n == 3:
            yield np.array([digest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(part, part[1:], part[2:])], np.uint64)
        else:
            yield np.array([digest(b" ".join(part[i : i + n]), SEED) for i in range(len(part) - n + 1)], np.uint64)


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the hashes."""
    votes, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text or b"", n):
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """Rows (_id, _md5 of the text, fp)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_md5"), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([field(rows, "_id"), field(rows, "_md5"), T.StructField("fp", T.LongType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(to, [batch.column(0), batch.column(1), [fingerprint(t.as_py(), n) for t in batch.column(2)]])

    return map_arrow(rows, run, schema)


def _node_fingerprints(texts: DataFrame, n: int) -> DataFrame:
    """Rows (node, fp) of texts with columns _node and _text."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("fp", T.LongType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(to, [batch.column(0), [fingerprint(t.as_py(), n) for t in batch.column(1)]])

    return map_arrow(texts, run, schema)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter on equal bytes, then the differing bits."""
    x = a ^ b
    near = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1) >= SHARED
    near[near] = np.bitwise_count(x[near]) <= RADIUS
    return near


def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, a, b = fps, [], []
    while len(left) > 1:
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            here, reached = reached[0], reached[1:]
            near = _close(np.full(len(left), here), left)
            if near.any():
                found = left[near]
                a += [int(here)] * len(found)
                b += found.tolist()
                reached, left = np.concatenate([reached, found]), left[~near]
    return a, b


def _sized(index: DataFrame, block: int) -> DataFrame:
    """Index rows (fp, key) of lists with two fingerprints at least, and their number n."""
    sizes = saved(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k"), "postings")
    return saved(index.join(sizes, F.col("key") == F.col("k")).select("fp", "key", "n"), "lists")


def _open_bits(fp: Column, key: Column) -> Column:
    """The 32 bits of a fingerprint that its key leaves open."""
    table = F.shiftrightunsigned(key, 32).cast("int")
    rest = F.lit(None).cast("long")
    for p, plane in enumerate(PLANES):
        value = F.lit(0).cast("long")
        for i in (x for x in range(8) if x not in plane):
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)))
        rest = F.when(table == p, value).otherwise(rest)
    return rest


def _second_keys(key: Column, rest: Column) -> list[Column]:
    """Keys for the fingerprints of one long list: its key and half of the open bits.

    At most RADIUS of those bits differ, so of six blocks three at least agree: there is a key for each choice of three.
    """
    cuts = [round(32 * i / 6) for i in range(7)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(6), 3)]
    return [F.xxhash64(key, F.lit(t), rest.bitwiseAND(F.lit(m))) for t, m in enumerate(masks)]


def links(fps: DataFrame, block: int = 200) -> DataFrame:
    """Edges (a, b) that span the groups of fingerprints within RADIUS bits; fps has a distinct column fp."""
    byte = lambda i: F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255))

    def key(plane: int):
        value = F.lit(plane).cast("long")
        for i in PLANES[plane]:
            value = F.shiftleft(value, 8).bitwiseOR(byte(i))
        return value  # the plane's number above 4 bytes

    index = fps.select("fp", F.explode(F.array(*(key(p) for p in range(len(PLANES))))).alias("key"))
    lists = _sized(index, block)
    short = lists.where(F.col("n") <= block).select("fp", "key")
    long = lists.where(F.col("n") > block).select("fp", "key", _open_bits(F.col("fp"), F.col("key")).alias("open"))
    long = long.select("fp", F.explode(F.array(*_second_keys(F.col("key"), F.col("open")))).alias("key"))
    sub = _sized(long, block)
    blocks = F.ceil(F.col("n") * 1.0 / block)
    own = F.pmod(F.xxhash64("fp", "key"), blocks)
    cell = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.least(own, other) * blocks + F.greatest(own, other))
    cells = short.select("fp", "key", F.lit(0).cast("long").alias("cell")).unionByName(sub.select("fp", "key", F.explode(F.when(F.col("n") <= block, F.array(F.lit(0).cast("long"))).otherwise(cell)).alias("cell")))
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(1)) + 1
            starts, ends = np.append(0, edge), np.append(edge, len(rows))
            sizes, fp = ends - starts, np.ascontiguousarray(rows[:, 0])
            pairs = starts[sizes == 2]
            near = _close(fp[pairs], fp[pairs + 1]) if len(pairs) else np.zeros(0, bool)
            a, b = fp[pairs][near].tolist(), fp[pairs + 1][near].tolist()
            for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
                x, y = forest(fp[s:e])
                a, b = a + x, b + y
            return record_batch(to, [a, b])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.int64)
            held.append(rows)
            rows = np.concatenate(held)
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, 1:] != rows[-1, 1:]).any(1))
            cut = last[-1] + 1 if len(last) else 0  # the last cell may go on in the next batch
            if cut:
                yield edges(rows[:cut])
            held = [rows[cut:]]
        if held and len(held[0]):
            yield edges(held[0])

    return map_arrow(dealt, run, schema)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """Rows (_id, _md5, fp, root, component_id); root is a fingerprint of the group."""
    rows = saved(fingerprints(docs, id_col, text_col, n), "simhash")
    distinct = saved(rows.groupBy("fp").agg(F.min("_id").alias("first")), "simhash-distinct")
    root = components(links(distinct)).select(F.col("node"), "root")
    rooted = saved(distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = saved(rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id")), "simhash-least")
    named = saved(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id"), "simhash-groups")
    return rows.join(named, F.col("fp") == F.col("f")).select("_id", "_md5", "fp", "root", "component_id")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every whole text."""
    with scratch(docs.sparkSession) as work:
        found = work.result(groups(docs, id_col, text_col, n), "simhash-result")
    return found.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """docs with one document of each group of fingerprints within RADIUS bits: that with the least id (and, of equal ids, the least MD5 of its text)."""
    found = groups(docs, id_col, text_col, n)
    keep = saved(found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_md5")).alias("x")).select(F.col("x._id").alias("_id"), F.col("x._md5").alias("_md5")), "simhash-kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_key"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_md5"))
    joined = rows.join(keep, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_md5") == F.col("_md5")))
    one = Window.partitionBy("_key", "_text_md5").orderBy("_key")  # equal rows: the join has put them together
    return joined.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def deduplicate_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """docs with one document of each group of near copies: that with the least id, null last.

    Near copies are texts with a Jaccard similarity of 0.8 or more on n-word shingles. The fingerprints' links
    come first and are verified; ``near_copies`` finds what fingerprints within RADIUS bits miss.
    """
    from .near_copies import links as near_links
    from .near_copies import verified

    spark = docs.sparkSession
    with scratch(spark) as work:
        text = F.coalesce(F.col(text_col), F.lit(""))
        name, path = f"near_texts_{uuid.uuid4().hex}", shared_dir(spark, "near-texts")
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_node"))
        one = Window.partitionBy("_node").orderBy(F.col("_id").asc_nulls_last())
        count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").write.option("compression", "zstd").option("path", path).bucketBy(count, "_node").saveAsTable(name)
        work.paths.append(path)
        try:
            exact = spark.table(name)
            texts = exact.select("_node", F.coalesce(F.col("_row")[text_col], F.lit("")).cast("binary").alias("_text"))
            fps = saved(_node_fingerprints(texts, n), "near-fingerprints")
            heads = saved(fps.groupBy("fp").agg(F.min("node").alias("head")), "near-heads")
            equal = fps.join(heads.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
            side = lambda c: heads.select(F.col("fp").alias(f"f{c}"), F.col("head").alias(f"h{c}"))
            close = links(heads.select("fp")).join(side("a"), F.col("a") == F.col("fa")).join(side("b"), F.col("b") == F.col("fb")).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
            seeds = saved(verified(saved(equal.unionByName(close).distinct(), "near-seeds"), texts, n), "near-seed-links")
            grouped = saved(components(near_links(texts, n, seeds)).distinct(), "near-groups")
            who = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("_node"))
            members = saved(grouped.join(exact.select("_node", "_id"), F.col("node") == F.col("_node")).select("root", who.alias("who")), "near-members")
            least = members.groupBy("root").agg(F.min("who").alias("least")).withColumnRenamed("root", "r")
            gone = saved(members.join(least, F.col("root") == F.col("r")).where("who._node <> least._node").select(F.col("who._node").alias("gone")), "near-gone")
            kept = exact.join(gone, F.col("_node") == F.col("gone"), "left_anti")
            return work.result(kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns)), "near-kept")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
