"""How a query is registered: a carrier table of bit vectors, result columns, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Carriers in DuckDB: 64 sign bits of each embedding; a bit for each event of a user in order of event_id.
SIGN_SQL = "SELECT vec_id AS id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings"
USER_SQL = "SELECT user_id AS id, string_agg(CASE WHEN value > 35 THEN '1' ELSE '0' END, '' ORDER BY event_id) AS bits FROM events GROUP BY user_id"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("bits"))


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("value") > 35, "1").otherwise("0").alias("b")))).alias("e"))
    return rows.select("id", F.array_join(F.transform("e", lambda x: x["b"]), "").alias("bits"))


TASKS_A_CORE = 8

#: All bits of each document's text, in UTF-8.
TEXT_SQL = "SELECT doc_id AS id, encode(coalesce(text, '')) AS data, CASE WHEN coalesce(text, '') = '' THEN '' ELSE encode(text)::BIT::VARCHAR END AS bits FROM documents"


def whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are dealt out first: the work on a bit costs a hundred times what moving it does, and a file may be a single task."""
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    dealt = texts.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return dealt.select("id", X.from_bytes("data").alias("bits"))


def vectors(carrier: str) -> tuple[Callable, str]:
    return {"sign": (sign, SIGN_SQL), "user": (user, USER_SQL), "text": (whole_text, TEXT_SQL)}[carrier]


def define(name: str, carrier: str, columns: Mapping[str, tuple[Callable[[], Column], str] | Callable[[], Column]], shared: Mapping[str, Callable[[], Column]] | None = None) -> None:
    """Registers a projection of a carrier; a column without SQL leaves the query without an oracle. Shared columns are worked out once, for several others."""
    load, sql = vectors(carrier)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = load(spark, sf_dir).select("*", *(v().alias(k) for k, v in (shared or {}).items()))
        return rows.select("id", *((v[0] if isinstance(v, tuple) else v)().alias(k) for k, v in columns.items()))

    QUERIES[name] = run
    if all(isinstance(v, tuple) for v in columns.values()):
        ORACLES[name] = f"WITH v AS ({sql}) SELECT id, {', '.join(f'{v[1]} AS {k}' for k, v in columns.items())} FROM v"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a whole query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def picked(expr: str, source: str = "range(length(bits))", where: str = "true") -> str:
    """DuckDB text made of expr for every i of source."""
    return f"array_to_string([{expr} for i in {source} if {where}], '')"


def bit(i: str = "i", text: str = "bits") -> str:
    return f"substr({text}, ({i})::BIGINT + 1, 1)"
