"""Secret scans with DataFrame functions only: base patterns and multipart credential linking.

Base findings (``assign``, ``access``, ``hex``) are reported by themselves. The linking method adds
what is too weak alone: short assigned values and long opaque strings (``weak_secret``), short
access identifiers (``weak_access``) and the endpoints (``endpoint``) they go with. Candidates and
their complements are interval-joined within a document: both are put into bins of ``scope`` code
points, equal bins meet in a semi-join, and a candidate stays if a complement that doesn't overlap it
lies within ``scope`` code points. A weak secret needs an access identifier or an endpoint near it, a weak identifier
needs a secret, an endpoint needs an identifier and a secret.

Regular expressions give matches without places, so places are running sums over the lengths of the
matches and of the pieces between them.

Defined cases: a null text counts as empty; equal rows (id and text) give equal rows, as many as
came in; null ids are an id like any other; spans that begin at one place are ordered by kind; a very long
text has to fit a row, its findings are rows of their own until they are listed beside it; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, scratch

# The base patterns of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
# Further parts of a credential.
ENDPOINT = r"(?:https?|wss?|ftp|sftp|amqp|redis|mysql|postgres(?:ql)?|mongodb)://[^\s\"'<>|]+"
OPAQUE = r"(?<![A-Za-z0-9+/])(?!AKIA)[A-Za-z0-9+/]{32,}={0,2}"

KINDS = ("assign", "access", "hex", "weak_secret", "weak_access", "endpoint")
BASE = 3


#: A pattern, strings of which each match holds one (a cheap test before the pattern), and the kind
#: of a match m, null if the match is no part at all.
PATTERNS = (
    (ASSIGN, (":", "="), lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12, "assign").when(F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8, "weak_secret")),
    (ACCESS, ("AKIA",), lambda m: F.when(F.length(m) >= 18, "access").when(F.length(m) >= 12, "weak_access")),
    (HEX, (), lambda m: F.lit("hex")),
    (ENDPOINT, ("://",), lambda m: F.lit("endpoint")),
    (OPAQUE, (), lambda m: F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), "weak_secret")),
)
PART = "struct<p:int,i:int,gap:bigint,len:bigint,kind:string>"


def _parts(text: Column, p: int) -> Column:
    """Array of PART: for each match of pattern p its place in order, the gap before it, its length and kind."""
    pattern, signs, kind = PATTERNS[p]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    one = lambda x, i: F.struct(F.lit(p).alias("p"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("len"), kind(x["m"]).cast("string").alias("kind"))
    rows = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), one)
    there = text.rlike(pattern)
    if signs:
        there = F.when(reduce(Column.__or__, [text.contains(x) for x in signs]), there)
    return F.when(there, rows.cast(f"array<{PART}>")).otherwise(F.array().cast(f"array<{PART}>"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (_id, _hash, copies, kind, start, end), and one with a null kind for every document.

    _hash tells texts of one id apart; copies is how many equal rows came in.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.md5(text).alias("_hash"), text.alias("_text"))
    found = rows.select(
        "_id",
        "_hash",
        F.explode(F.concat(F.array(F.struct(F.lit(-1), F.lit(0), F.lit(0), F.lit(0), F.lit(None)).cast(PART)), *(_parts(F.col("_text"), p) for p in range(len(PATTERNS))))
        ).alias("x"),
    ).select("_id", "_hash", "x.*")
    whole = found.groupBy("_id", "_hash", "p", "i").agg(F.first("gap").alias("gap"), F.first("len").alias("len"), F.first("kind").alias("kind"), F.count("*").alias("copies"))
    before = Window.partitionBy("_id", "_hash", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    placed = whole.withColumn("end", end).where((F.col("p") < 0) | F.col("kind").isNotNull())
    return placed.select("_id", "_hash", "copies", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _near(weak: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Rows of weak that have one of the others beside them within scope code points: an interval semi-join by bins."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    left = weak.withColumn("_bin", bins(F.col("start") - scope, F.col("end") + scope))
    right = others.select(F.col("_id").alias("r_id"), F.col("_hash").alias("r_hash"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), bins(F.col("start"), F.col("end")).alias("r_bin"))
    meets = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_hash") == F.col("r_hash")) & (F.col("_bin") == F.col("r_bin"))
    close = (F.col("r_start") <= F.col("end") + scope) & (F.col("r_end") >= F.col("start") - scope)
    apart = (F.col("r_end") <= F.col("start")) | (F.col("r_start") >= F.col("end"))
    return left.join(right, meets & close & apart, "left_semi").drop("_bin").distinct()


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per (_id, _hash): copies and found, the sorted array of (start, rank of the kind, end, kind)."""
    all_parts = saved(parts(docs, id_col, text_col), "secret-parts")
    some = all_parts.where("kind is not null")
    kind = F.col("kind")
    secrets = some.where(kind.isin("assign", "hex", "weak_secret"))
    accesses = some.where(kind.isin("access", "weak_access"))
    endpoints = some.where(kind == "endpoint")
    linked = (
        _near(some.where(kind == "weak_secret"), accesses.unionByName(endpoints), scope)
        .unionByName(_near(accesses.where(kind == "weak_access"), secrets, scope))
        .unionByName(_near(_near(endpoints, accesses, scope), secrets, scope))
    )
    kept = all_parts.where(kind.isNull() | kind.isin(*KINDS[:BASE])).unionByName(linked)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    one = F.when(kind.isNotNull(), F.struct("start", rank.alias("rank"), "end", "kind"))
    return kept.groupBy("_id", "_hash").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_set(one)).alias("found"))


def _text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every whole text."""
    base = F.filter("found", lambda x: x["rank"] <= BASE)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    with scratch(docs.sparkSession) as work:
        rows = spans(docs, id_col, text_col, scope)
        found = rows.select(
            F.col("_id").alias(id_col),
            *(count(k).alias(f"n_{k}") for k in KINDS[:BASE]),
            F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"),
            _text(F.col("found")).alias("spans"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
        )
        return work.result(found.drop("_copy"), "secrets")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", scope: int = 200, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by the mask."""
    with scratch(docs.sparkSession) as work:
        found = work.result(spans(docs, id_col, text_col, scope).where(F.size("found") > 0).select("_id", "_hash", "found"), "secret-spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.substring(F.col("_row")[text_col], (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask)))).otherwise(s["out"]).alias("out"),
    )
    masked = F.aggregate("found", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("_row")[text_col], (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_key"), F.md5(text).alias("_md5"))
    joined = rows.join(found.hint("merge"), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_hash")), "left")
    new = F.when(F.col("found").isNull(), F.col("_row")[text_col]).otherwise(masked)
    joined = joined.withColumn("_new", new)
    value = {text_col: F.col("_new"), chars_col: F.when(F.col("found").isNull(), F.col("_row")[chars_col]).otherwise(F.length("_new").cast("long")) if chars_col in docs.columns else None}
    return joined.select(*((value[c] if value.get(c) is not None else F.col("_row")[c]).alias(c) for c in docs.columns))
