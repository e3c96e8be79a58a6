"""Quality scores by supervised subword embeddings.

Whole words and the character n-grams inside them are hashed to vectors; a document is the average
of its vectors, and a softmax layer over that gives the class. Vectors and layer are trained
together by stochastic gradient descent in numpy. Scoring is linear up to the softmax, so vectors
and layer are multiplied once after training and each feature then carries two numbers.

Training rows are a bounded sample of the labelled rows that may be learned from: at most about
``most_rows`` rows and ``most_bytes`` bytes, drawn by a hash of the id.

Defined cases: null and empty texts get the score of a document without features (the share of
label 1 among the training rows), and so does everything when there is nothing to learn from (0.5). A row goes in,
a row comes out; a very long text is hashed in pieces of 1 MB but is no training row above LONGEST bytes; an
empty table gives no rows; further columns are ignored; labels for unknown ids and null labels are unused;
of several labels of one document all count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, field, held_out, map_arrow, record_batch
from .subwords import ngrams, sparse, summed, word_hashes

SIZES, BITS, DIM = (2, 3, 4), 15, 12
#: Bytes of a training row at most.
LONGEST = 1 << 20
BLANKS = bytes(32 if b in b"\t\n\r\x0b\x0c" else b for b in range(256))


class Model(NamedTuple):
    logits: np.ndarray  # bucket x class
    bias: np.ndarray


def features(text: str | None) -> Iterator[np.ndarray]:
    data = (text or "").encode().translate(BLANKS)
    words = (h | (1 << BITS) for h in word_hashes(data, BITS))  # words and n-grams have buckets of their own
    return chain(ngrams(data, SIZES, BITS), words)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int, most_bytes: int) -> list:
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label"))
    n = known.count()
    if not n:
        return []
    mean = docs.select(F.avg(F.octet_length(text_col)).alias("b")).first().b or 1
    most = max(1, int(min(most_rows, most_bytes / max(1, mean))))
    place = F.pmod(F.xxhash64(F.col("_label_id").cast("string"), F.lit("quality")), F.lit(1 << 30))
    drawn = known.withColumn("_place", place).where(F.col("_place") < int(min(1, most / n) * (1 << 30))).orderBy("_place", "_label").limit(2 * most)
    rows = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= LONGEST).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), F.col("_id") == F.col("_label_id"))  # at most 2 * most rows
    return [(r[0], r[1]) for r in rows.orderBy("_place", "_label", "_text").limit(2 * most).select("_label", "_text").collect()]


def train(rows: list[tuple[int, str]], epochs: int = 6, rate: float = 3.0, seed: int = 8) -> Model:
    size = 2 << BITS
    if not rows:
        return Model(np.zeros((size, 2), np.float32), np.zeros(2))
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    label = np.array([r[0] for r in rows])
    inputs = [sparse(features(r[1]), size) for r in rows]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    ones = (label.sum() + 0.5) / (len(label) + 1)
    bias = np.log(np.array([1 - ones, ones]))
    steps = 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, share = inputs[k]
            mean = share @ vectors[at]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[k]] -= 1
            pace = rate * (1 - steps / (epochs * len(rows)))
            back = (layer @ p.astype(np.float32)).astype(np.float32)
            layer -= pace * 0.3 * np.outer(mean, p).astype(np.float32)
            vectors[at] -= (20 * pace) * share[:, None] * back
            steps += 1
    return Model((vectors @ layer).astype(np.float32), bias)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 5000, most_bytes: int = 24 << 20, threshold: float = 0.3) -> DataFrame:
    """held_out, score and predicted for every whole text."""
    model = train(training_rows(docs, labels, id_col, text_col, label_col, most_rows, most_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**(BITS + 1) rows of two numbers
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    schema = T.StructType([field(docs, id_col), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            score = []
            for text in batch.column(2).to_pylist():
                total, n = summed(model.logits, features(text))
                z = total / max(1, n) + model.bias
                score.append(float(1 / (1 + np.exp(np.clip(z[0] - z[1], -700, 700)))))
            yield record_batch(to, [batch.column(0), batch.column(1), score, [int(s >= threshold) for s in score]])

    return map_arrow(rows, run, schema)
