"""The exact search behind ``simhash_dedup.deduplicate_similar``: texts with a Jaccard similarity of 0.8 or more.

Texts are sets of XXH64 hashes of word n-grams. Fingerprints within a few bits give the first
candidates (``simhash_dedup.links``); as similar texts may differ in more bits than any index over their
bytes can promise to find, a prefix filter finds the rest: in any common order of hashes, two sets of
similarity 0.8 share one of the first k - ceil(0.8 k) + 1 of either's k hashes, so an inverted index over
these prefixes misses no pair. The order is by the count of a hash's bucket, rarest first, which keeps
widespread passages out of prefixes. A pair whose places in a list leave too little overlap goes
(positional filter); the others are verified on whole sets.

Large groups of near copies are linked without their pairs: in a round a text is held against one text of
another group at most, the head of one of its lists. First heads are the texts that share the most of their
prefix with others: an edit gives a text hashes that nobody has, so these are the least edited ones, and
what was made from one text meets at it or near it (of equal ones, that with the most frequent hashes is the
head). Later heads are drawn, those that share much more often,
and every other round takes the shortest list, where chains of edits find their neighbours. Rounds end when
they no longer link much. All pairs that lie in different groups after that are looked at, whatever their
number: many texts that share hashes of their prefixes and aren't similar still give all their pairs.

Defined cases: equal texts are one node; texts without words are near copies of each other; a text
with fewer than n words is one shingle; equal rows become one; null ids come last. Nodes are 64-bit
hashes of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_arrow, record_batch, saved, scratch
from .components import components
from .simhash_dedup import shingle_hashes

#: Bits of a hash that number its bucket.
BUCKET_BITS = 16
#: Hashes that a worker holds while pairs are verified.
HELD = 1 << 20
#: Rounds at most in which each text is held against one other; one that links WORTH of its pairs or less is the last.
ROUNDS, WORTH = 6, 0.1


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes; one that stands for no word if there is none."""
    parts = list(shingle_hashes(text or b"", n))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefix(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The hashes of which a similar set has one at least, in the common order."""
    order = np.lexsort((found, weight[_buckets(found)]))
    return found[order[: len(found) - (4 * len(found) + 4) // 5 + 1]]


def _bucket_counts(texts: DataFrame, n: int) -> np.ndarray:
    """How many hashes of all texts each bucket has."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                for hashes in shingle_hashes(t.as_py(), n):
                    counts += np.bincount(_buckets(hashes), minlength=1 << BUCKET_BITS)
        some = np.flatnonzero(counts)
        yield record_batch(to, [some, counts[some]])

    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in map_arrow(texts.select("_text"), run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row for each bucket
        out[r.bucket] = r.n
    return out


def _index(texts: DataFrame, n: int) -> DataFrame:
    """Rows (key, node, size, rest, common): rest counts the hashes of the text from this one on, common is the mean count of its hashes' buckets."""
    weights = texts.sparkSession.sparkContext.broadcast(_bucket_counts(texts, n))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "node", "size", "rest")] + [T.StructField("common", T.DoubleType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(t.as_py(), n)
                keys = prefix(found, weights.value)
                yield record_batch(to, [keys.view(np.int64), np.full(len(keys), node), np.full(len(keys), len(found)), len(found) - np.arange(len(keys)), np.full(len(keys), weights.value[_buckets(found)].mean())])

    return map_arrow(texts.select("_node", "_text"), run, schema)


def _may_link(size: Column, rest: Column, size2: Column, rest2: Column) -> Column:
    """Length and positional filter: 9 x overlap >= 4 x (size + size2) is a similarity of 0.8."""
    return (5 * F.least(size, size2) >= 4 * F.greatest(size, size2)) & (9 * F.least(rest, rest2) >= 4 * (size + size2))


def verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    text = lambda k: texts.select(F.col("_node").alias(k), F.col("_text").alias(f"text_{k}"))
    both = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # sets of texts that other pairs may have too
        size = 0
        for batch in batches:
            near = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                for node, text in ((a, x), (b, y)):
                    if node not in held:
                        held[node] = shingles(text.as_py(), n)
                        size += len(held[node])
                near.append(similar(held[a], held[b]))
                if size > HELD:
                    held, size = {}, 0
            yield record_batch(to, [c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]])

    return map_arrow(both, run, schema)


def _lists(texts: DataFrame, n: int) -> DataFrame:
    """The index rows of keys that two texts at least have, with the number of their texts and the share of its prefix that a text has in such rows."""
    with scratch(texts.sparkSession) as work:
        index = saved(_index(texts, n), "near-index")
        several = index.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").withColumnRenamed("key", "k")
        lists = index.join(several, F.col("key") == F.col("k")).drop("k")
        share = F.count("*").over(Window.partitionBy("node")) / (F.floor(F.col("size") / 5) + 1)
        return work.result(lists.withColumn("share", share), "near-lists")


def _open_lists(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of lists whose texts lie in several groups so far, with the group (root) of each."""
    with scratch(lists.sparkSession) as work:
        roots = saved(components(edges).distinct(), "near-roots").withColumnRenamed("node", "r_node")
        rooted = saved(lists.join(roots, F.col("node") == F.col("r_node"), "left").select(*lists.columns, F.coalesce("root", "node").alias("root")), "near-rooted")
        several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(F.col("key").alias("k"))
        return work.result(rooted.join(several, F.col("key") == F.col("k")).drop("k"), "near-open")


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """For each text (b) of open lists one head (a) of another group at most, where the two may be similar."""
    drawn = (F.xxhash64("node", F.lit(turn)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    score = F.log(drawn) / F.pow("share", F.lit(4)) if turn else F.col("share")
    heads = rows.groupBy("key").agg(F.max(F.struct(score.alias("score"), "common", "node", "size", "rest", "root")).alias("head")).withColumnRenamed("key", "k")
    fits = _may_link(F.col("size"), F.col("rest"), F.col("head.size"), F.col("head.rest"))
    apart = rows.join(heads, F.col("key") == F.col("k")).where((F.col("root") != F.col("head.root")) & fits)
    first = -F.col("members") if turn % 2 else F.struct("head.score", "head.common")
    return apart.groupBy(F.col("node").alias("b")).agg(F.max(F.struct(first.alias("first"), F.col("head.node").alias("a"))).alias("x")).select("x.a", "b")


def _apart(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of texts that meet in an open list, lie in different groups and may be similar.

    The members of a list's largest group are held against those of other groups, never against each other.
    """
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"))
    most = sizes.select(F.col("key").alias("k"), F.col("most.root").alias("most"))
    x, y = rows.join(most, F.col("key") == F.col("k")).where("root <> most").alias("x"), rows.alias("y")
    fits = _may_link(F.col("x.size"), F.col("x.rest"), F.col("y.size"), F.col("y.rest"))
    once = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("x.most")) | (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & once & fits)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def links(texts: DataFrame, n: int, seeds: DataFrame) -> DataFrame:
    """Edges (a, b) that span the groups of near copies; texts has a distinct _node and _text. seeds: verified edges."""
    edges = seeds
    rows = _open_lists(_lists(texts, n), edges)
    for turn in range(ROUNDS):
        pairs = saved(_stars(rows, turn), "near-stars")
        found = saved(verified(pairs, texts, n), "near-star-links")
        edges = edges.unionByName(found)
        rows = _open_lists(rows.drop("root"), edges)
        if found.count() <= WORTH * pairs.count():
            break
    return edges.unionByName(saved(verified(saved(_apart(rows), "near-pairs"), texts, n), "near-pair-links"))
