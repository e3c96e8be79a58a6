"""A corpus pipeline over ``documents``: five stages, each of them one training-data operator.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``.

Defined cases, for every stage: null texts go in the first one, and would be kept or count as empty in the
others; empty and letterless texts go in the first one; of equal rows and near copies one stays, that with the
least id, null last (equal rows with one id are one row); very long texts are worked on whole and have to fit a
row; an empty table gives an empty one with the same columns; further columns, whatever their names, come along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbits.llm import decontaminate, language_id, secrets, sentencepiece_codec, simhash_dedup
from sparkbits.llm.common import saved, scratch, table
from sparkbits.llm.queries import tokenizer_file

#: Difference of losses below which two languages are too close to call.
CLOSE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language the model can't tell: null and letterless ones, and those as close to another language.

    A call is close where the loss of the second language is less than CLOSE above that of the first. Where no
    language could be learned, documents with a letter stay.
    """
    found = language_id.identify(docs, carry=True, flag_below=CLOSE)
    told = (F.col("lang_pred") != "und") & ~F.col("ambiguous")
    return found.where(told | ((F.col("lang_pred") == "und") & F.col("row.text").rlike(r"\p{L}"))).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that with the least id."""
    return simhash_dedup.deduplicate_similar(docs, n=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text that is left."""
    return sentencepiece_codec.encode_decode(docs, tokenizer_file(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secret_scan", secret_spans),
    ("sentencepiece", tokens),
]

#: SQL has neither the trained language model nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as work:
        for name, stage in STAGES[:-1]:
            docs = saved(stage(spark, docs, sf_dir), name)
        return work.result(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
