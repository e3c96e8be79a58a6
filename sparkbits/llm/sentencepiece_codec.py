"""SentencePiece encoding and decoding through a table of distinct chunks.

In the models this serves no piece holds a space marker after another character, so no merge
crosses the start of a marked word. A text is therefore cut before every run of markers, each
distinct chunk is segmented once by the sentencepiece library, and the ids are joined back in the
order of the chunks. The table lives in the Python worker, spans all batches of its task and is
emptied when it holds ``table_bytes``; a chunk met after that is segmented again, with equal ids.

Defined cases: null and empty texts have no ids and decode to ''. A literal U+2581 counts as a
space, as in the library. Repeated rows, null ids and further columns do no harm: a row goes in, a
row comes out, and only the asked columns are returned; an empty table gives no rows. A very long text
has to fit a row, and the list of its chunks a worker; words of any length are one chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, field, map_arrow, record_batch, row_slices

MARK = "▁"
CHUNK = re.compile(r" +[^ ]*")
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def chunks(text: str) -> list[str]:
    """The marked words of a text, each with its leading run of spaces; the first has the dummy prefix."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return CHUNK.findall(" " + text)
    return [" " + w for w in text.split(" ")]


class ChunkTable:
    """Distinct chunk -> (its ids, the ids as text, its decoded text)."""

    def __init__(self, model_file: str, table_bytes: int = 48 << 20):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for i in range(self.sp.get_piece_size()):
            if re.search(f"[^{MARK}]{MARK}", self.sp.id_to_piece(i)):
                raise ValueError(f"piece {i} crosses a space marker; this model needs whole-text encoding")
        pieces = lambda t: "".join(self.sp.encode(t, out_type=str))
        if (pieces("a"), pieces("a  b"), pieces("\ufb01")) != (f"{MARK}a", f"{MARK}a{MARK}{MARK}b", f"{MARK}\ufb01"):
            raise ValueError("the model must add a dummy prefix, keep white space and not normalise; others need whole-text encoding")
        self.limit, self.size = table_bytes, 0
        self.rows: dict[str, tuple[list[int], bytes, str]] = {}

    def fill(self, wanted: set[str]) -> None:
        new = [c for c in wanted if c not in self.rows]
        if self.size > self.limit:
            self.rows, self.size = {}, 0
            new = list(wanted)
        encoded = self.sp.encode([c[1:] for c in new], num_threads=1) if new else []
        for i, c in enumerate(new):
            if c == " ":  # a lone marker; the library gives nothing for ''
                encoded[i] = [self.sp.piece_to_id(MARK)]
        decoded = self.sp.decode(encoded) if new else []
        for c, ids, text in zip(new, encoded, decoded):
            self.rows[c] = (ids, ",".join(map(str, ids)).encode(), " " + text)
            self.size += 250 + 4 * len(c) + 40 * len(ids)


def decode_ids(model_file: str, ids: Sequence[int]) -> str:
    """The library's decode(ids) for one list."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file).decode(list(ids))


def encode_decode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = ("ids", "decoded"), table_bytes: int = 48 << 20) -> DataFrame:
    """Rows of id_col and the asked outputs, of OUTPUTS, for every whole text of df."""
    schema = T.StructType([field(df, id_col), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = ChunkTable(model_file, table_bytes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in row_slices([len(t or "") for t in texts]):
                parts = [chunks(t or "") for t in texts[start:stop]]
                memo.fill({c for p in parts for c in p})
                rows = memo.rows
                columns: list = [batch.column(0).slice(start, stop - start)]
                found = [[rows[c] for c in p] for p in parts]
                joined = [b",".join([r[1] for r in f]) for f in found] if "ids_sha256" in outputs else []
                texts_back = ["".join([r[2] for r in f])[1:] for f in found] if {"decoded", "decoded_sha256"} & set(outputs) else []
                for o in outputs:
                    if o == "ids":
                        columns.append([[i for r in f for i in r[0]] for f in found])
                    elif o == "decoded":
                        columns.append(texts_back)
                    elif o == "n_tokens":
                        columns.append([sum([len(r[0]) for r in f]) for f in found])
                    elif o == "ids_sha256":
                        columns.append([hashlib.sha256(j).hexdigest() for j in joined])
                    else:
                        columns.append([hashlib.sha256(t.encode()).hexdigest() for t in texts_back])
                yield record_batch(to, columns)

    return map_arrow(df.select(id_col, text_col), run, schema)
