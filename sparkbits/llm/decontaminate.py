"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are put into one suffix automaton. Document words are streamed through it while
the longest matching length is tracked; where that length reaches a window of an item (``window``
words, or a whole shorter item) the window's words are hit. A stream starts anew where two
neighbouring words are no pair of any item, because no longer match can span that place.

The automaton goes to the executors, so its size is bounded: items are cut into segments that overlap by
window - 1 words, segments are dealt into shards of about ``shard_words`` words, and documents pass the
shards one after another. Shards are built in tasks, each as flat numpy arrays of 50 to 80 bytes a
word; what the driver holds is these arrays, never the items.

Defined cases: a null text or item has no words; an item without words has no window; repeated
items count once by item_id, items with a null id are written as ''; repeated documents give
repeated rows; very long items are segments; a very long document has to fit a row, and its words
a Python list; an empty table of documents gives no rows, an empty benchmark no hits; further columns of
either table are ignored.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, field, map_arrow, record_batch, row_slices, saved, scratch

#: A-Z to a-z; bytes that end words to spaces. Bytes from 0x80 belong to words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window, in flat arrays.

    ``keys`` has state << 32 | word of every transition in order, ``targets`` the states they lead to.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        grown = _Growing()
        sequences = []
        for name, tokens in items:
            if tokens:
                ids = array("i", (self.vocab.setdefault(w, len(self.vocab)) for w in tokens))
                sequences.append((name, ids))
                last = 0
                for w in ids:
                    last = grown.extend(last, w)
        states = len(grown.link)
        keys = np.fromiter(grown.step.keys(), np.int64, len(grown.step))
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.fromiter(grown.step.values(), np.int32, len(keys))[order]
        self.link, self.length = np.array(grown.link, np.int32), np.array(grown.length, np.int32)
        self.names = sorted({name for name, _ in sequences})
        number = {name: k for k, name in enumerate(self.names)}
        #: For each state the words of a whole short item that it is, or 0.
        self.whole = np.zeros(states, np.int32)
        held: set[int] = set()  # state << 32 | item
        for name, ids in sequences:
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1):
                state = 0
                for w in ids[i : i + n]:
                    state = grown.step[state << 32 | w]
                held.add(state << 32 | number[name])
            if n < window:
                self.whole[state] = n
        found = np.sort(np.fromiter(held, np.int64, len(held)))
        self.item_states, self.items = (found >> 32).astype(np.int32), (found & 0xFFFFFFFF).astype(np.int32)
        #: For each state the ancestor that holds the last ``window`` words, and the nearest that is a whole short item; or -1.
        at_window, short = [-1] * states, [-1] * states
        for v in np.argsort(self.length, kind="stable")[1:].tolist():
            up = grown.link[v]
            at_window[v] = at_window[up] if at_window[up] >= 0 else v if grown.length[v] >= window else -1
            short[v] = v if self.whole[v] else short[up]
        self.at_window, self.short = np.array(at_window, np.int32), np.array(short, np.int32)
        self.shortest = min((min(window, len(ids)) for _, ids in sequences), default=0)
        size = len(self.vocab)
        pairs = [np.asarray(ids[:-1], np.int64) * size + np.asarray(ids[1:], np.int64) for _, ids in sequences if len(ids) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def to(self, state: int, word: int) -> int:
        """The state that a word leads to, or -1."""
        key = state << 32 | word
        at = int(np.searchsorted(self.keys, key))
        return int(self.targets[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def items_of(self, state: int) -> list[str]:
        a, z = np.searchsorted(self.item_states, (state, state + 1))
        return [self.names[k] for k in self.items[a:z]]

    def scan(self, tokens: list[int], runs: list[list[int]], found: set[str], base: int = 0) -> None:
        """Streams tokens; adds [first, end) of hit words to runs, and the items to found."""
        v = matched = 0
        link, length, window, whole, short = self.link, self.length, self.window, self.whole, self.short
        seen: set[int] = set()
        for i, w in enumerate(tokens, base + 1):
            to = -1 if w < 0 else self.to(v, w)
            while to < 0 and v:
                v = int(link[v])
                matched = int(length[v])
                to = -1 if w < 0 else self.to(v, w)
            if to < 0:
                continue
            v = to
            matched += 1
            widest = 0
            if matched >= window:
                widest = window
                seen.add(int(self.at_window[v]))
            s = int(short[v])
            while s >= 0:
                if whole[s] <= matched:
                    widest = max(widest, int(whole[s]))
                    seen.add(s)
                s = int(short[link[s]])
            if widest:
                if runs and runs[-1][1] >= i - widest:
                    while len(runs) > 1 and runs[-2][1] >= i - widest:
                        runs.pop()
                    runs[-1][0] = min(runs[-1][0], i - widest)
                    runs[-1][1] = i
                else:
                    runs.append([i - widest, i])
        for state in seen:
            found.update(self.items_of(state))

    def match(self, texts: list[list[bytes]]) -> list[tuple[list[list[int]], set[str]]]:
        """For each word list the hit runs and the items."""
        out: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in texts]
        if not self.shortest:
            return out
        get, size = self.vocab.get, len(self.vocab)
        counts = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, int(counts.sum()))
        ends = np.cumsum(counts)
        starts = ends - counts
        if self.shortest == 1:
            streams = [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(starts, ends)) if b > a]
        else:
            joined = np.zeros(len(ids), bool)  # word i follows word i - 1 in some item
            if len(ids) > 1:
                a, b = ids[:-1], ids[1:]
                keys = a * size + b
                at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                joined[1:] = (a >= 0) & (b >= 0) & (self.pairs[at] == keys)
            joined[starts[counts > 0]] = False
            cuts = np.flatnonzero(~joined)
            sizes = np.diff(np.append(cuts, len(ids)))
            cuts, sizes = cuts[sizes >= self.shortest], sizes[sizes >= self.shortest]
            owners = np.searchsorted(ends, cuts, side="right")
            streams = [(int(k), int(c), int(c + n)) for k, c, n in zip(owners, cuts, sizes)]
        for k, a, b in streams:
            runs, found = out[k]
            self.scan(ids[a:b].tolist(), runs, found, a - int(starts[k]))
        return out


class _Growing:
    """A suffix automaton that is being built: one dict of transitions, and the words of each state as linked lists."""

    def __init__(self) -> None:
        self.link, self.length, self.first = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.words, self.more = array("i"), array("i")
        self.step: dict[int, int] = {}

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.first.append(-1)
        return len(self.length) - 1

    def _put(self, state: int, w: int, to: int) -> None:
        self.words.append(w)
        self.more.append(self.first[state])
        self.first[state] = len(self.words) - 1
        self.step[state << 32 | w] = to

    def extend(self, last: int, w: int) -> int:
        known = self.step.get(last << 32 | w, -1)
        if known >= 0:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        state = self._new(self.length[last] + 1, 0)
        at = last
        while at >= 0 and (at << 32 | w) not in self.step:
            self._put(at, w, state)
            at = self.link[at]
        if at >= 0:
            below = self.step[at << 32 | w]
            self.link[state] = below if self.length[below] == self.length[at] + 1 else self._split(at, w, below)
        return state

    def _split(self, at: int, w: int, below: int) -> int:
        """A state for the shorter words of ``below``, which keeps the longer ones."""
        upper = self._new(self.length[at] + 1, self.link[below])
        edge = self.first[below]
        while edge >= 0:
            word = self.words[edge]
            self._put(upper, word, self.step[below << 32 | word])
            edge = self.more[edge]
        self.link[below] = upper
        while at >= 0 and self.step.get(at << 32 | w) == below:
            self.step[at << 32 | w] = upper
            at = self.link[at]
        return upper


class Shards(NamedTuple):
    automata: list[bytes]  # pickled
    window: int


#: Words of a segment of an item.
SEGMENT = 20_000


def segments(bench: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (name, words, n) of the distinct items, cut into segments that overlap by window - 1 words."""
    rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("binary").alias("text")).distinct()
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("n", T.LongType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words(text)
                parts = [tokens[k : k + SEGMENT + window - 1] for k in range(0, max(1, len(tokens) - window + 1), SEGMENT)] if tokens else []
                yield record_batch(to, [[name] * len(parts), parts, [len(p) for p in parts]])

    return map_arrow(rows, run, schema)


def build(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10, shard_words: int = 500_000) -> Shards:
    """One automaton for each shard of about shard_words words, built in a task of its own."""
    schema = T.StructType([T.StructField("automaton", T.BinaryType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[bytes]]] = []
        shard = None
        for batch in batches:
            for k, name, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if k != shard and held:
                    yield record_batch(to, [[pickle.dumps(Automaton(held, window))]])
                    held = []
                shard = k
                held.append((name, tokens))
        if held:
            yield record_batch(to, [[pickle.dumps(Automaton(held, window))]])

    with scratch(bench.sparkSession):
        rows = saved(segments(bench, item_col, text_col, window), "decontaminate-segments")
        total = rows.agg(F.sum("n")).first()[0] or 0
        count = max(1, -(-total // shard_words))
        dealt = rows.select(F.pmod(F.xxhash64("name", "words"), F.lit(count)).alias("shard"), "name", "words").repartition(count, "shard").sortWithinPartitions("shard")
        found = saved(map_arrow(dealt, run, schema), "decontaminate-shards")
        blobs = [bytes(r.automaton) for r in found.toLocalIterator()]  # one shard after another
    return Shards(blobs or [pickle.dumps(Automaton([], window))], window)


def merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def matches(docs: DataFrame, shards: Shards, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_words, runs (hit word ranges), items, and the carried columns."""
    sc = docs.sparkSession.sparkContext
    schema = T.StructType([field(docs, id_col, "_id"), T.StructField("_text", T.BinaryType()), *(field(docs, c) for c in carry), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
    to = arrow_schema(schema)
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), *carry, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<bigint>>").alias("runs"), F.array().cast("array<string>").alias("items"))
    for shard in shards.automata:
        sent = sc.broadcast(shard)  # about shard_words words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = pickle.loads(sent.value)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for start, stop in row_slices([len(t or b"") for t in texts]):
                    part = batch.slice(start, stop - start)
                    split = [words(t) for t in texts[start:stop]]
                    found = automaton.match(split)
                    before, names = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                    yield record_batch(to, [*part.columns[:-3], [len(t) for t in split], [merged(old + new) if new else old for old, (new, _) in zip(before, found)], [sorted(set(old) | new) if new else old for old, (_, new) in zip(names, found)]])

        out = map_arrow(out, run, schema)
    return out


def report(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every whole document."""
    found = matches(docs, build(bench, window=window), id_col, text_col)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select(
        F.col("_id").alias(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def without_runs(text: str, runs: list[list[int]]) -> str:
    """The text without its hit words and what stands between the words of one run."""
    data = text.encode()
    spans = []
    marked = data.translate(LOWER)
    at = 0
    for w in marked.split():
        at = marked.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    kept, last = [], 0
    for a, b in runs:
        kept.append(data[last : spans[a][0]])
        last = spans[b - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def clean(docs: DataFrame, bench: DataFrame, window: int = 10, max_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with hit runs removed from the text; documents hit over more than max_coverage of their words go."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(id_col, text_col, F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")])).alias("_rest"))
    found = matches(packed, build(bench, window=window), id_col, text_col, ("_rest",))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    to, names = arrow_schema(schema), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {n: [] for n in names}
            for row in batch.to_pylist():
                hit = sum(b - a for a, b in row["runs"])
                if hit and hit > max_coverage * row["n_words"]:
                    continue
                text = None if row["_text"] is None else row["_text"].decode()
                if hit:
                    text = without_runs(text, row["runs"])
                for n in names:
                    kept[n].append(row["_id"] if n == id_col else text if n == text_col else len(text) if n == chars_col and hit else row["_rest"][n])
            yield record_batch(to, [kept[n] for n in names])

    return map_arrow(found, run, schema)
