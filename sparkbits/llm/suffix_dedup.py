"""Repeated windows by a depth-limited radix sort of suffixes.

Texts are rows of tokens: bytes, or words between white space. A suffix begins at each token, and
two suffixes are told apart through their first ``length`` tokens only, by most-significant-digit
passes over longer and longer leading runs of tokens. A group that a pass leaves with one suffix
holds no repeat and drops out; what still agrees after ``length`` tokens is a repeated window.

One row for each suffix would be many times the text, so the passes start from few heads and take in
more heads only inside groups that are left:

Pass 0, digit of ``gram`` tokens, a head for each zone. Every window has an anchor, the place of the
least hash among the grams inside it, which depends on the window's tokens alone: windows with equal
tokens have equal grams at equal places, so only windows whose anchor gram leads two suffixes go on.
The neighbouring windows of one anchor are a zone (about one for each 170 bytes). If the tokens under
all windows of a zone occur twice as well, the whole zone is repeated and done.
Pass 1, digit of length - step + 1 tokens, a head for each ``step`` windows of what is left, counted
from the anchor: the leading tokens of the suffix at the step's last window, which all its windows share.
Pass 2, digit of length tokens, a head for each window.

Digits are 64-bit hashes and only sort out; that tokens are equal is decided by 128 bits of SHA-256,
as is that texts are. Each pass counts digits with partial aggregation and brings the counts back with
joins that can be split, so copies, common passages and runs of one byte put no group into one task.

Runs of a short period (one byte, a rule of dashes, padding): a window that equals the one a period
on is a repeat without any further look, and of all the zones of such a run only the last goes on,
as ``known``, so that single windows elsewhere still meet it. The marks of a text are therefore
fewer than one for a hundred tokens or so, and are gathered beside the text they belong to.

Equal texts are worked on once, with their number of copies.

Defined cases: null and empty texts have no tokens; texts under ``length`` tokens lose nothing; copies
of a text of ``length`` tokens or more lose everything; equal rows are copies of each other; a very long
text is cut into pieces of a million tokens while it is hashed, but has to fit one row; an empty table
gives no rows; null ids and further columns do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SCRATCH, arrow_schema, map_arrow, record_batch, saved, scratch, shared_dir


class Unit(NamedTuple):
    """What a token is, the tokens of a window, of a gram, and the windows of a step."""

    words: bool
    length: int
    gram: int
    step: int


BYTES, WORDS = Unit(False, 400, 64, 28), Unit(True, 50, 8, 6)
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
LOW = np.uint64((1 << 21) - 1)

ROWS = T.StructType([T.StructField("k", T.BinaryType()), T.StructField("a", T.IntegerType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("known", T.BooleanType()), T.StructField("done", T.BooleanType()), T.StructField("digit", T.LongType()), T.StructField("whole", T.BinaryType())])


class Roller:
    """Rolling hashes of grams: sums of token value times power, brought to a common power."""

    def __init__(self, unit: Unit) -> None:
        self.unit = unit
        n = PIECE + 2 * unit.length
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.full(n, BASE, np.uint64))
            self.back = np.multiply.accumulate(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
        self.value = np.random.default_rng(400).integers(1, 1 << 63, 256, np.uint64)

    def grams(self, tokens: np.ndarray) -> np.ndarray:
        g = self.unit.gram
        sums = np.zeros(len(tokens) + 1, np.uint64)
        value = tokens if self.unit.words else self.value[tokens]
        np.cumsum(value * self.power[: len(tokens)], out=sums[1:])
        h = (sums[g:] - sums[:-g]) * self.back[: len(tokens) - g + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


class Tokens:
    """A text's tokens: their values, and the bytes of any run of them."""

    def __init__(self, text: bytes, unit: Unit):
        if unit.words:
            import xxhash

            words = text.split()
            self.text = b" ".join(words)
            self.values = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            self.begin, self.end = (ends - sizes).tolist(), [0, *ends.tolist()]
        else:
            self.text, self.values, self.begin = text, np.frombuffer(text, np.uint8), None

    def run(self, a: int, z: int) -> bytes:
        return self.text[a:z] if self.begin is None else self.text[self.begin[a] : self.end[z]]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every width neighbours, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def zones(values: np.ndarray, roller: Roller) -> np.ndarray:
    """Rows (anchor, first window, last window, hash of the anchor's gram) in order; the last of equal hashes is the anchor."""
    length, span = roller.unit.length, roller.unit.length - roller.unit.gram + 1
    parts = []
    for start in range(0, len(values) - length + 1, PIECE):
        stop = min(start + PIECE, len(values) - length + 1)  # windows start..stop-1
        hashes = roller.grams(values[start : stop - 1 + length])
        order = (hashes & ~LOW) | (LOW - np.arange(len(hashes), dtype=np.uint64))
        anchors = (LOW - (sliding_min(order, span) & LOW)).astype(np.int64)
        cuts = np.append(0, np.flatnonzero(np.diff(anchors)) + 1)
        ends = np.append(cuts[1:], len(anchors))
        parts.append(np.stack([start + anchors[cuts], start + cuts, start + ends - 1, hashes[anchors[cuts]].view(np.int64)], 1))
    if not parts:
        return np.zeros((0, 4), np.int64)
    out = np.concatenate(parts)
    again = np.append(False, out[1:, 0] == out[:-1, 0])  # a zone that goes on in the next piece
    if again.any():
        last = np.append(np.flatnonzero(~again)[1:] - 1, len(out) - 1)
        ends = out[last, 2]
        out = out[~again]
        out[:, 2] = ends
    return out


def without_periods(found: np.ndarray, values: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Rows (anchor, first, last, hash, known) that are left for the passes, and window ranges that are repeats already.

    A zone whose windows all equal those a period on, which are windows of the next zone, is done and
    goes; the part of the next zone that equals it is done too and known.
    """
    rows = np.concatenate([found, np.zeros((len(found), 1), np.int64)], 1)
    same = np.flatnonzero(found[1:, 3] == found[:-1, 3]) if len(found) else []
    if not len(same):
        return rows, []
    shift = found[same + 1, 0] - found[same, 0]
    cuts = np.flatnonzero((np.diff(same) != 1) | (np.diff(shift) != 0)) + 1
    gone, by = np.zeros(len(found), bool), np.zeros(len(found), np.int64)
    for part, p in zip(np.split(same, cuts), shift[np.append(0, cuts)].tolist()):
        begin, end = int(found[part[0], 1]), int(min(found[part[-1], 2] + length, len(values) - p))
        wrong = np.append(0, np.cumsum(values[begin:end] != values[begin + p : end + p]))
        stops = found[part, 2] + length - begin
        fits = stops < len(wrong)
        fits[fits] = wrong[stops[fits]] == wrong[found[part[fits], 1] - begin]
        gone[part[fits]], by[part[fits]] = True, p
    if not gone.any():
        return rows, []
    ranges = np.concatenate([found[gone, 1:3], found[gone, 1:3] + by[gone, None]])
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.append(True, ranges[1:, 0] > reach[:-1] + 1)
    done = list(zip(ranges[first, 0].tolist(), reach[np.append(np.flatnonzero(first)[1:] - 1, len(reach) - 1)].tolist()))
    heads = np.flatnonzero(gone[:-1] & ~gone[1:]) + 1  # zones after one that is gone
    parts = []
    for k in heads.tolist():
        a, first, last, h, _ = rows[k].tolist()
        p = a - int(rows[k - 1, 0])
        lo, hi = int(rows[k - 1, 1]) + p, int(rows[k - 1, 2]) + p
        parts += [x for x in ((a, first, lo - 1, h, 0), (a, lo, hi, h, 1), (a, hi + 1, last, h, 0)) if x[1] <= x[2]]
    rest = ~gone
    rest[heads] = False
    return np.concatenate([rows[rest], np.array(parts, np.int64).reshape(-1, 5)]), done


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def distinct_texts(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """Rows (k, text, copies), bucketed by k so that later joins don't move the texts again; and the table's name."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(text_key(text).alias("k"), text.alias("text"))
    name, path = f"distinct_texts_{uuid.uuid4().hex}", shared_dir(spark, "distinct-texts")
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    writer = rows.groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("copies")).write.option("compression", "zstd").option("path", path)
    writer.bucketBy(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k").saveAsTable(name)
    return spark.table(name), name


def zone_rows(texts: DataFrame, unit: Unit) -> DataFrame:
    """Pass 0: a row for each zone; digit is the gram's hash, whole the digest of all its tokens."""
    to = arrow_schema(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, sha = Roller(unit), hashlib.sha256
        for batch in batches:
            columns: list[list] = [[] for _ in ROWS]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = Tokens(text, unit)
                left, done = without_periods(zones(tokens.values, roller), tokens.values, unit.length)
                rows = left.tolist()
                n = len(rows) + len(done)
                for c, v in zip(columns, (
                    [k] * n,
                    [r[0] for r in rows] + [0] * len(done),
                    [r[1] for r in rows] + [d[0] for d in done],
                    [r[2] for r in rows] + [d[1] for d in done],
                    [r[4] == 1 for r in rows] + [False] * len(done),
                    [False] * len(rows) + [True] * len(done),
                    [r[3] for r in rows] + [0] * len(done),
                    [sha(tokens.run(r[1], r[2] + unit.length)).digest()[:16] for r in rows] + [b""] * len(done),
                )):
                    c += v
                if len(columns[0]) > 50_000:
                    yield record_batch(to, columns)
                    columns = [[] for _ in ROWS]
            yield record_batch(to, columns)

    return map_arrow(texts.where(F.octet_length("text") >= unit.length).select("k", "text"), run, ROWS)


def finer(texts: DataFrame, marks: DataFrame, unit: Unit, step: int) -> DataFrame:
    """The next pass: rows of step windows around the anchor for all marks that go on."""
    to = arrow_schema(ROWS)
    grouped = marks.groupBy(F.col("k").alias("key")).agg(F.collect_list(F.struct("a", "lo", "hi", "known")).alias("marks"))  # beside a text of a hundred tokens for each
    rows = texts.join(grouped, F.col("k") == F.col("key")).select("k", "text", "marks")
    length = unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sha, part = hashlib.sha256, xxhash.xxh3_64_intdigest
        for batch in batches:
            for k, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tokens = Tokens(text, unit)
                columns: list[list] = [[] for _ in ROWS]
                for m in marks:
                    a = m["a"]
                    for j in range((a - m["hi"]) // step, (a - m["lo"]) // step + 1):
                        last = a - step * j  # windows of this step begin at last - step + 1 .. last
                        lo, hi = max(m["lo"], last - step + 1), min(m["hi"], last)
                        digit = part(tokens.run(last, last - step + 1 + length), j & 0xFFFFFFFF)
                        for c, v in zip(columns, (k, a, lo, hi, m["known"], False, digit - (1 << 64) if digit >> 63 else digit, sha(tokens.run(lo, hi + length)).digest()[:16])):
                            c.append(v)
                yield record_batch(to, columns)

    return map_arrow(rows, run, ROWS)


def sifted(rows: DataFrame, last: bool = False) -> DataFrame:
    """What a pass decides: rows (k, a, lo, hi, known, done, on).

    done: all windows of the row occur elsewhere. on: for the next pass, as some other row has the
    same digit but other tokens; of rows with equal tokens one goes on, as ``known``.
    """
    ready, rows = rows.where("done"), rows.where("not done").drop("done")
    name = F.xxhash64("k", "a", "lo")
    same = rows.groupBy("digit", "whole").agg(F.count("*").alias("n"), F.min(name).alias("one"), F.min("known").alias("known"))
    if last:
        found = saved(same.where("n > 1").select("digit", "whole", "n", "one", F.lit(False).alias("mixed")), "suffix-equal")
    else:
        same = saved(same, "suffix-digits")
        open_row = (F.col("n") == 1) & ~F.col("known")
        mixed = same.groupBy("digit").agg(F.count("*").alias("c"), F.count_if(open_row).alias("o")).where("c > 1 and o > 0").select(F.col("digit").alias("d"))
        mixed = saved(mixed, "suffix-mixed")
        found = same.join(mixed, F.col("digit") == F.col("d"), "left").where("n > 1 or d is not null").select("digit", "whole", "n", "one", F.col("d").isNotNull().alias("mixed"))
        found = saved(found, "suffix-found")
    found = found.select(F.col("whole").alias("w"), F.col("digit").alias("g"), "n", "one", "mixed")
    met = rows.join(found, (F.col("whole") == F.col("w")) & (F.col("digit") == F.col("g")))
    on = F.col("mixed") & ((F.col("n") == 1) | (F.col("one") == name))
    out = met.select("k", "a", "lo", "hi", (F.col("known") | (F.col("n") > 1)).alias("known"), ((F.col("n") > 1) & ~F.col("known")).alias("done"), on.alias("on")).where("done or on")
    return saved(out.unionByName(ready.select("k", "a", "lo", "hi", "known", "done", F.lit(False).alias("on"))), "suffix-marks")


def repeats(texts: DataFrame, unit: Unit) -> DataFrame:
    """Rows (k, lo, hi): all windows that begin at lo..hi occur elsewhere in the texts."""
    marks = sifted(saved(zone_rows(texts, unit), "suffix-zones"))
    done = [marks]
    for step in (unit.step, 1):
        marks = sifted(saved(finer(texts, marks.where("on"), unit, step), "suffix-steps"), last=step == 1)
        done.append(marks)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.where("done").select("k", "lo", "hi")


def removed(marks: list[dict], size: int, copies: int, length: int) -> list[list[int]]:
    """Maximal runs [begin, end) of tokens under repeated windows."""
    if copies > 1 and size >= length:
        return [[0, size]]
    runs: list[list[int]] = []
    for m in sorted(marks or [], key=lambda m: m["lo"]):
        if runs and m["lo"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], m["hi"] + length)
        else:
            runs.append([m["lo"], m["hi"] + length])
    return runs


def _marked(texts: DataFrame, unit: Unit, name: str) -> DataFrame:
    found = saved(repeats(texts, unit).groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias(name)), f"suffix-{name}")
    return found.withColumnRenamed("k", f"{name}_k")


def cut(docs: DataFrame, text_col: str = "text", kept: bool = False) -> DataFrame:
    """Rows (k, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words, and the kept bytes if asked) of the distinct texts.

    n_shared_words: words under windows of WORDS.length words that occur elsewhere; they are counted, not removed.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("k", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("n_shared_words", T.LongType()), *([T.StructField("kept", T.BinaryType())] if kept else [])])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text, copies, marks, shared in zip(*(c.to_pylist() for c in batch.columns)):
                runs = removed(marks, len(text), copies, BYTES.length)
                left = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)]))
                n_words = len(text.split()) if copies > 1 else 0
                words = sum(z - a for a, z in removed(shared, n_words, copies, WORDS.length))
                out.append((k, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), words, *([left] if kept else [])))
            yield record_batch(to, [list(c) for c in zip(*out)] if out else [[] for _ in to])

    with scratch(spark) as work:
        texts, name = distinct_texts(docs, text_col)
        try:
            rows = texts
            for unit, column in ((BYTES, "marks"), (WORDS, "shared")):
                with scratch(spark) as inner:
                    marks = inner.result(_marked(texts, unit, column), f"suffix-{column}")
                rows = rows.join(marks, F.col("k") == F.col(f"{column}_k"), "left")
            return work.result(map_arrow(rows.select("k", "text", "copies", "marks", "shared"), run, schema), "suffix-cut")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words for every whole text."""
    result = cut(docs, text_col)
    keys = docs.select(F.col(id_col).alias("_id"), text_key(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_k"))
    return keys.join(result, F.col("_k") == F.col("k")).select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")
