"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary logistic classifier over hashed letter n-grams
is trained by stochastic gradient descent; a text takes the language whose codeword has the least
loss over all bits, each bit weighed by how well it is learned. Close calls are flagged.

Training rows are a bounded sample: at most about ``per_language`` rows and ``bytes_per_language``
bytes of each language, drawn by a hash of the id from all rows that may be learned from.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any training
row everything is ``und``; with one language every text with a letter is of it; of equal losses the
first language by name. A row goes in, a row comes out, whatever its id; a very long text is hashed in
pieces of 1 MB but is no training row above LONGEST bytes; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, field, held_out, map_arrow, record_batch, released
from .subwords import ngrams, sparse, summed

SIZES, BITS = (1, 2, 3, 4), 14
#: Bytes of a training row at most.
LONGEST = 1 << 20
#: ASCII letters stay, all other ASCII separates words.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """All dichotomies for up to six languages, else the best of some random codes."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        return np.array([[1, *bits] for bits in itertools.product((-1, 1), repeat=n - 1) if -1 in bits], float).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, max(15, int(np.ceil(10 * np.log2(n))))))
        near = (code @ code.T - 1e9 * np.eye(n)).max()
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


def letters(text: str | None) -> bytes:
    """The lower-cased words of a text as bytes; empty if it has no letter."""
    if not text:
        return b""
    data = text.lower().encode().translate(LETTERS)
    if data.isascii():
        return b" ".join(data.split())
    return b" ".join(data.split()) if any(c.isalpha() for c in text) else b""


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, bytes_per_language: int) -> list:
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= LONGEST))
    sizes = rows.groupBy(F.col(lang_col).cast("string").alias("l")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("b")).collect()  # one row per language
    if not sizes:
        return []
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang_col).cast("string") == r.l, float(min(1, per_language / r.n, bytes_per_language / max(1, r.b)))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 30))
    drawn = rows.where(place < share * (1 << 30)).select(F.col(lang_col).cast("string"), text_col, place.alias("_place"))
    return [(r[0], r[1]) for r in drawn.orderBy("_place", text_col).limit(2 * per_language * len(sizes)).collect()]


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 40.0, seed: int = 5) -> Model:
    rows = sorted((lang, data) for lang, text in rows if (data := letters(text)))
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((1 << BITS, 1), np.float32), np.zeros(1), np.ones(1))
    code = codewords(len(languages))
    target = code[[languages.index(lang) for lang, _ in rows]]
    features = [sparse(ngrams(data, SIZES, BITS), 1 << BITS) for _, data in rows]
    weights, bias = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    order, steps = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, share = features[k]
            margin = share @ weights[at] + bias
            pull = (rate / (1 + steps / len(rows))) * target[k] / (1 + np.exp(np.clip(target[k] * margin, -30, 30)))
            weights[at] += share[:, None] * pull.astype(np.float32)
            bias += 0.01 * pull
            steps += 1
    loss = np.mean([np.logaddexp(0, -target[k] * (share @ weights[at] + bias)) for k, (at, share) in enumerate(features)], axis=0)
    trust = np.exp(-2 * loss)
    return Model(languages, code, weights, bias, trust / trust.sum() * len(trust))


def decode(model: Model, margins: np.ndarray, flag_below: float) -> tuple[str, float, bool]:
    losses = (np.logaddexp(0, -model.code * margins) * model.trust).sum(1)
    likely = np.exp(losses.min() - losses)
    likely /= likely.sum()
    best = int(losses.argmin())
    rest = np.delete(losses, best)
    return model.languages[best], float(likely[best]), bool(len(rest) and rest.min() - losses[best] < flag_below)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1200, bytes_per_language: int = 4 << 20, flag_below: float = 0.5, carry: bool = False) -> DataFrame:
    """held_out, lang_pred, score and ambiguous for every whole text.

    carry: the columns of docs come along as a struct ``row``.
    """
    model = train(training_rows(docs, id_col, text_col, lang_col, per_language, bytes_per_language))
    released()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = []
            texts = batch.column(0).field(text_col) if carry else batch.column(2)
            for text in texts.to_pylist():
                data = letters(text)
                if not data or not model.languages:
                    out.append(("und", 0.0, False))
                    continue
                total, n = summed(model.weights, ngrams(data, SIZES, BITS))
                out.append(decode(model, total / max(1, n) + model.bias, flag_below))
            yield record_batch(to, [batch.column(0), batch.column(1), *(list(x) for x in zip(*out))] if out else [batch.column(0), batch.column(1), [], [], []])

    key: Column = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.col(id_col)
    rows = docs.select(key.alias("row"), held_out(F.col(id_col)).alias("held_out"), *([] if carry else [F.col(text_col).alias("_text")]))
    schema = T.StructType([field(rows, "row"), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    to = arrow_schema(schema)
    found = map_arrow(rows, run, schema)
    return found if carry else found.withColumnRenamed("row", id_col)
