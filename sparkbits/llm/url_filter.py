"""URL filters: rules first, then segmented words and naive Bayes.

Host labels and path pieces are split into words by the most likely segmentation under a unigram
model (Viterbi). Words are then scored by multinomial naive Bayes, whose two classes are the URLs that
a rule blocks and those that a rule allows: rules are the only marks that pages have. The URLs without
a rule get the likelier class.

Word counts of both models are taken over all rows and all words count. A unigram count is less one, so
that no piece vouches for itself as a word. The ``vocabulary`` most frequent words are sent to executors;
rarer ones are joined to the pieces and rows that hold them. A word of the classes is any that a URL under
a rule has; other words say nothing about a class. Both are smoothed by SMOOTH for each distinct word.

Defined cases: a null URL or one without '://' has an empty host and path; without any known word the
verdict is the more frequent class, and allow where no URL is under a rule or both are as frequent;
longest rule first, of equally long ones the earlier; letters beyond the LONGEST-th of a piece begin a
new word, so a very long URL is split in time and memory in proportion to its length; a row goes in, a row
comes out, whatever its id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, field, map_arrow, record_batch, saved, scratch


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules of the contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Letters of a word at most; the label of a host has no more.
LONGEST = 63
#: Letters of the pieces whose splits a worker holds.
MEMO = 8 << 20
SMOOTH = 0.1


def _tail(url: Column) -> Column:
    """What follows the first '://', else ''."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(_tail(url), r"^([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The rule that fits, as text, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1].host + x[1].path), x[0]))
    for _, r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _parts(name: str) -> set[str]:
    """All that may be a word of name."""
    return {name[a:b] for a in range(len(name)) for b in range(a + 1, min(len(name), a + LONGEST) + 1)}


class Segmenter:
    """Most likely split into words of a unigram model; an unknown piece costs more the longer it is."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = self.total = total or sum(counts.values()) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = math.log(total)
        self.longest = max(map(len, counts), default=1)
        self.memo: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def split(self, name: str, rare: dict[str, int] | None = None) -> tuple[str, ...]:
        """rare: counts of further words that may be in this name."""
        if rare:
            own = Segmenter({}, self.total)
            own.cost = {w: self.cost[w] for w in _parts(name) if w in self.cost} | {w: math.log(self.total / n) for w, n in rare.items()}
            own.longest = max(map(len, own.cost))
            return own.split(name)
        if name in self.memo:
            return self.memo[name]
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = [(best[start] + self.cost.get(name[start:end], self.unknown + 2.3 * (end - start)), start) for start in range(max(0, end - self.longest), end)]
            if end > self.longest:  # a longer piece is an unknown word: its first letter at the earliest
                first = max(0, end - LONGEST)
                options += [(best[start] + self.unknown + 2.3 * (end - start), start) for start in range(first, end - self.longest)]
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        if self.held > MEMO:
            self.memo.clear()
            self.held = 0
        self.memo[name] = found = tuple(reversed(words))
        self.held += len(name)
        return found


PIECE = re.compile(r"[^\W\d_]+|\d+")


def pieces_of(host: str, path: str) -> list[str]:
    """Runs of letters and of digits in the host's labels and in the path."""
    return [p for name in (host.split(":")[0], path.lower()) for p in PIECE.findall(name)]


def words_of(host: str, path: str, segmenter: Segmenter, known: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Words of the pieces; numbers are one word. known: splits of pieces with rare words."""
    return [w for p in pieces_of(host, path) for w in (("#",) if p[0].isdigit() else (known or {}).get(p) or segmenter.split(p))]


def _top(counted: DataFrame, key: str, most: int) -> tuple[list, DataFrame | None]:
    """The most frequent rows by n, and the table of all others if there are any."""
    top = counted.orderBy(F.desc("n"), key).limit(most).collect()  # at most ``most`` rows
    if len(top) < most:
        return top, None
    n, last = (top[-1]["n"], top[-1][key]) if top else (1 << 62, "")
    rest = counted.where((F.col("n") < n) | ((F.col("n") == n) & (F.col(key) > last)))
    return top, None if rest.isEmpty() else rest


def _per_row(rows: DataFrame, keys: Column, rest: DataFrame | None, key: str, value: Column) -> DataFrame:
    """rows with ``given``: (k, v) of the row's keys that are in rest."""
    kind = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", rest.select(value).schema[0].dataType)])) if rest is not None else T.ArrayType(T.StringType())
    if rest is None:
        return rows.withColumn("given", F.lit(None).cast(kind))
    held = rows.select("row_no", F.explode(F.array_distinct(keys)).alias("k")).join(rest.select(F.col(key).alias("k"), value.alias("v")), "k")
    given = held.groupBy("row_no").agg(F.collect_list(F.struct("k", "v")).alias("given"))
    return rows.join(given, "row_no", "left")


def _dict(given: list | None) -> dict:
    return {x["k"]: x["v"] for x in given or ()}


def unigrams(pages: DataFrame, url_col: str, body_col: str | None, vocabulary: int) -> tuple[Segmenter, DataFrame | None]:
    """Segmenter over the most frequent words of titles, hosts and paths; the table (w, n) of all other words."""
    url = F.col(url_col)
    texts = [F.concat_ws(" ", host_of(url), path_of(url))]
    if body_col:
        texts.append(F.regexp_extract(F.col(body_col), r"(?i)<title>([^<]*)", 1))
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counted = words.where(F.length("w").between(1, LONGEST)).groupBy("w").agg((F.count("*") - 1).alias("n")).where("n > 0")
    counted = saved(counted, "url-unigrams")
    total = (counted.agg(F.sum("n")).first()[0] or 0) + 1
    top, rest = _top(counted, "w", vocabulary)
    return Segmenter({r.w: r.n for r in top}, total), rest


def _rare_splits(urls: DataFrame, model, rare: DataFrame) -> DataFrame:
    """(piece, n, words) of the distinct pieces that may hold a rare word."""
    pieces = saved(urls.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("n")), "url-pieces")
    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("part", T.StringType())])
    to = arrow_schema(schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = [] if p[0].isdigit() else list(_parts(p))
                yield record_batch(to, [[p] * len(found), found])

    held = map_arrow(pieces.select("piece"), parts, schema).join(rare, F.col("part") == F.col("w")).groupBy("piece").agg(F.collect_list(F.struct(F.col("w").alias("k"), F.col("n").alias("v"))).alias("rare"))
    both = pieces.join(held, "piece").select("piece", "n", "rare")
    schema2 = T.StructType([T.StructField("piece", T.StringType()), T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])
    out = arrow_schema(schema2)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(out, [*batch.columns[:2], [list(model.value.split(p, _dict(r))) for p, r in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]])

    return saved(map_arrow(both, split, schema2), "url-rare-splits")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", body_col: str | None = "html", vocabulary: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict, words and block_score for every row."""
    sc = pages.sparkSession.sparkContext
    with scratch(pages.sparkSession) as work:
        segmenter, rare = unigrams(pages, url_col, body_col, vocabulary)
        model = sc.broadcast(segmenter)  # at most vocabulary words
        host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
        urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        urls = urls.select("*", rule.alias("rule"), verdict.alias("ruled"))
        cut = T.StructType([*urls.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType()))])
        cut_to = arrow_schema(cut)

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield record_batch(cut_to, [*batch.columns, [pieces_of(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]])

        top, rest, columns = [], None, urls.columns
        if rare is None:
            urls = urls.withColumn("row_no", F.monotonically_increasing_id())
        else:
            urls = saved(map_arrow(urls, pieces, cut).withColumn("row_no", F.monotonically_increasing_id()), "url-pieces-of-rows")
            top, rest = _top(_rare_splits(urls, model, rare), "piece", vocabulary)
        frequent = sc.broadcast({r.piece: tuple(r.words) for r in top})  # at most vocabulary pieces
        urls = _per_row(urls, F.col("pieces"), rest, "piece", F.col("words")).select(*columns, "row_no", "given")
        schema = T.StructType([*urls.schema.fields[:-1], T.StructField("words", T.ArrayType(T.StringType()))])
        to = arrow_schema(schema)

        def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(6).to_pylist())
                yield record_batch(to, [*batch.columns[:6], [words_of(h, p, model.value, ChainMap(_dict(g), frequent.value)) for h, p, g in rows]])

        split = saved(map_arrow(urls, segment, schema), "url-words")
        classes = {r.ruled: r for r in split.where("ruled is not null").groupBy("ruled").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("w")).collect()}  # two rows
        block, allow = (classes.get(k) for k in ("block", "allow"))
        counts = split.where("ruled is not null").select("ruled", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("ruled") == "block").alias("block"), F.count_if(F.col("ruled") == "allow").alias("allow"))
        counts = saved(counts.withColumn("n", F.col("block") + F.col("allow")), "url-counts")
        smooth = SMOOTH * counts.count()
        in_block, in_allow = (max(smooth, SMOOTH) + (x.w if x else 0) for x in (block, allow))
        log_ratio = lambda b, a: math.log((b + SMOOTH) / in_block) - math.log((a + SMOOTH) / in_allow)
        top, rest = _top(counts, "w", vocabulary)
        ratio = {r.w: log_ratio(r.block, r.allow) for r in top}
        prior = math.log(((block.n if block else 0) + SMOOTH) / ((allow.n if allow else 0) + SMOOTH))
        weights = sc.broadcast((ratio, prior))  # at most vocabulary words
        split = _per_row(split, F.col("words"), rest, "w", F.array("block", "allow")).select(*columns, "words", "given")
        result = T.StructType([field(pages, id_col), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("block_score", T.DoubleType())])
        out = arrow_schema(result)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio, prior = weights.value
            for batch in batches:
                words, ruled = batch.column(5).to_pylist(), batch.column(4).to_pylist()
                rare = [{w: log_ratio(*v) for w, v in _dict(g).items()} for g in batch.column(6).to_pylist()]
                odds = [prior + sum(ratio[x] if x in ratio else r.get(x, 0.0) for x in w) for w, r in zip(words, rare)]
                verdicts = [r or ("block" if o > 0 else "allow") for r, o in zip(ruled, odds)]
                yield record_batch(out, [*batch.columns[:4], verdicts, batch.column(5), [1 / (1 + math.exp(-max(-700.0, min(700.0, o)))) for o in odds]])

        return work.result(map_arrow(split, score, result), "url-verdicts")
