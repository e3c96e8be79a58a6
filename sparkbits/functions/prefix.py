"""Prefix codes: encoding, decoding, decode trees, Huffman and canonical Huffman codes."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .text import ColumnOrName, c

MAX_DEPTH = 256
MAX_CANONICAL = 31
#: Bits that one look into a decoding table covers, and places that are looked up at once.
LOOK, BLOCK = 12, 1 << 16


def windows(bits: str, start: int, count: int, width: int) -> np.ndarray:
    """The next width bits of every place from start on as numbers; zeros stand behind the end."""
    data = np.zeros(count + width, np.int64)
    part = np.frombuffer(bits[start : start + count + width].encode("ascii"), np.uint8)
    data[: len(part)] = part - 48
    out = np.zeros(count, np.int64)
    for j in range(width):
        out = out << 1 | data[j : j + count]
    return out


class DecodeTree:
    """Binary trie over code words; a node has children or a symbol, never both."""

    def __init__(self, code: Mapping[str, str]):
        if not isinstance(code, Mapping):
            raise TypeError("a code is a mapping of symbols to code words")
        if not code:
            raise ValueError("a code has one symbol at least")
        self.root: list = [None, None]
        for symbol, word in code.items():
            if not word:
                raise ValueError("a code word has one bit at least")
            if len(word) > MAX_DEPTH:
                raise ValueError(f"a code word has {MAX_DEPTH} bits at most")
            node = self.root
            for k, bit in enumerate(word):
                at, last = int(bit), k == len(word) - 1
                if last:
                    if node[at] is not None:
                        raise ValueError(f"the code word of {symbol!r} clashes with another")
                    node[at] = (symbol,)
                else:
                    if node[at] is None:
                        node[at] = [None, None]
                    node = node[at]
                    if isinstance(node, tuple):
                        raise ValueError(f"the code word of {symbol!r} clashes with another")

    def walk(self) -> Iterator[tuple[str, object]]:
        todo: list[tuple[str, object]] = [("", self.root)]
        while todo:
            path, node = todo.pop()
            yield path, node
            if isinstance(node, list):
                todo += [(path + str(b), node[b]) for b in (1, 0) if node[b] is not None]

    def nodes(self) -> tuple[int, int, int]:
        """Numbers of nodes with one child, with two children, and with a symbol."""
        kinds = [2 if isinstance(n, tuple) else int(n[0] is not None and n[1] is not None) for _, n in self.walk()]
        return kinds.count(0), kinds.count(1), kinds.count(2)

    def complete(self) -> bool:
        return self.nodes()[0] == 0

    def todict(self) -> dict[str, str]:
        return {n[0]: p for p, n in self.walk() if isinstance(n, tuple)}

    def _table(self) -> tuple[int, list, list[int]]:
        """(width, for each number of width bits the symbol it begins with, and how many bits that has; 0 if none fits)."""
        if not hasattr(self, "table"):
            words = self.todict()
            width = min(LOOK, max(map(len, words.values())))
            symbols: list = [None] * (1 << width)
            sizes = [0] * (1 << width)
            for symbol, word in words.items():
                if len(word) <= width:
                    first, n = int(word, 2) << (width - len(word)), 1 << (width - len(word))
                    symbols[first : first + n] = [symbol] * n
                    sizes[first : first + n] = [len(word)] * n
            self.table = width, symbols, sizes
        return self.table

    def _slowly(self, bits: str, at: int) -> tuple[str, int]:
        """The symbol at a place whose code word the table doesn't hold, and the word's length."""
        node = self.root
        for k in range(at, len(bits)):
            node = node[int(bits[k])]
            if node is None:
                raise ValueError(f"no code word fits the bits at position {at} .. {k}")
            if isinstance(node, tuple):
                return node[0], k + 1 - at
        raise ValueError(f"incomplete code word at position {at}")

    def decode(self, bits: str, at: int = 0, skip: Mapping[int, int] | None = None) -> Iterator[tuple[int, str]]:
        """(place of the code word, symbol), lazily; after symbol number k, skip[k] raw bits are passed over.

        A step for each symbol: numpy looks the next bits of a block of places up at once.
        """
        width, symbols, sizes = self._table()
        start, looked, n = at, [], 0
        while at < len(bits):
            if not 0 <= at - start < len(looked):
                start, looked = at, windows(bits, at, min(BLOCK, len(bits) - at), width).tolist()
            x = looked[at - start]
            symbol, size = symbols[x], sizes[x]
            if not size or at + size > len(bits):
                symbol, size = self._slowly(bits, at)
            yield at, symbol
            at += size + (skip.get(n, 0) if skip else 0)
            n += 1


def book(code: Mapping[str, str]) -> Column:
    """A code dictionary as a map literal."""
    DecodeTree(code)
    return F.create_map(*map(F.lit, chain.from_iterable(code.items())))


def encode(symbols: ColumnOrName, code: Mapping[str, str] | Column, strict: bool = True) -> Column:
    """The code words of an array of symbols, one after the other."""
    if isinstance(code, Mapping):
        if any(not w for w in code.values()):
            raise ValueError("a code word has one bit at least")
        code = F.create_map(*map(F.lit, chain.from_iterable(code.items())))
    words = F.transform(c(symbols), lambda s: F.try_element_at(code, s))
    known = F.forall(c(symbols), lambda s: F.coalesce(F.array_contains(F.map_keys(code), s), F.lit(False)))
    return X.fail(known, X.joined(words), "a symbol has no code word", strict)


def decode(bits: ColumnOrName, code: Mapping[str, str], strict: bool = True) -> Column:
    """Array of symbols. Not strict: null instead of an error for bits that are no whole code words."""
    tree = DecodeTree(code)

    @F.pandas_udf("array<string>")
    def run(a: pd.Series) -> pd.Series:
        out = []
        for x in a:
            try:
                out.append(None if x is None else [s for _, s in tree.decode(x)])
            except ValueError:
                if strict:
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(c(bits))


def decode_partly(bits: ColumnOrName, code: Mapping[str, str]) -> Column:
    """STRUCT<symbols, error, at>: the symbols before an error, the error, and where it happened."""
    tree = DecodeTree(code)

    @F.pandas_udf("struct<symbols:array<string>,error:string,at:long>")
    def run(a: pd.Series) -> pd.DataFrame:
        rows = []
        for x in a:
            found, error, at = [], None, 0
            try:
                for place, s in tree.decode(x or ""):
                    found.append(s)
                    at = place
                at = len(x or "")
            except ValueError as e:
                error = str(e)
                at = int(error.split("position ")[1].split(" ")[0])
            rows.append((found, error, at))
        return pd.DataFrame(rows, columns=["symbols", "error", "at"])

    return run(c(bits))


def decode_fixed(bits: ColumnOrName, code: Mapping[str, str]) -> Column:
    """For code words of one length: a lookup for each piece, without Python."""
    (width,) = {len(w) for w in code.values()}
    back = F.create_map(*map(F.lit, chain.from_iterable((w, s) for s, w in code.items())))
    return F.transform(X.pieces(c(bits), width), lambda x: F.element_at(back, x))


def tree_rows(spark: SparkSession, tree: DecodeTree) -> DataFrame:
    """(symbol, code) of a decode tree."""
    return spark.createDataFrame(list(tree.todict().items()), "symbol string, code string")


def decoder(code: Mapping[str, str], skip: Mapping[int, int] | None = None, start: int = 0):
    """A table function bits -> rows (pos, bit_index, symbol) from bit start on; after symbol number k, skip[k] raw bits are passed over."""
    tree, jumps = DecodeTree(code), dict(skip or {})

    class Decoder:
        def eval(self, bits: str):
            for n, (place, symbol) in enumerate(tree.decode(bits, start, jumps)):
                yield n, place, symbol

    return F.udtf(Decoder, returnType="pos: int, bit_index: int, symbol: string")


# ---- codebooks as relations (book_id, symbol, code)


def prefixes(codes: DataFrame, key: str = "book_id") -> DataFrame:
    """Rows (key, prefix, bit) for every proper prefix of a code word and the bit after it."""
    return codes.select(key, F.explode(F.transform(X.span(F.length("code")), lambda k: F.struct(F.substring("code", F.lit(1), k).alias("prefix"), X.at(F.col("code"), k).alias("bit")))).alias("x")).select(key, "x.*")


def ambiguous(codes: DataFrame, key: str = "book_id") -> DataFrame:
    """Code words that are empty, too long, repeated, or a prefix of another: no rows for a valid book."""
    inner = prefixes(codes, key).select(F.col(key).alias("k"), F.col("prefix").alias("p")).distinct()
    clash = codes.join(inner, (F.col(key) == F.col("k")) & (F.col("code") == F.col("p")), "left_semi")
    twice = codes.groupBy(key, "code").agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("k"), F.col("code").alias("p"))
    again = codes.join(twice, (F.col(key) == F.col("k")) & (F.col("code") == F.col("p")), "left_semi")
    wrong = codes.where(~F.length("code").between(1, MAX_DEPTH))
    return clash.union(again).union(wrong).distinct()


def nodes(codes: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, incomplete, complete, leaf): numbers of nodes of each book's tree."""
    inner = prefixes(codes, key).groupBy(key, "prefix").agg(F.count_distinct("bit").alias("children")).groupBy(key).agg(F.count_if(F.col("children") == 1).alias("incomplete"), F.count_if(F.col("children") == 2).alias("complete"))
    return inner.join(codes.groupBy(key).agg(F.count("*").alias("leaf")), key)


def encode_rows(rows: DataFrame, codes: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """(key, bits): rows (key, pos, symbol) joined to code words (symbol, code) and put together in order."""
    met = rows.join(codes, "symbol", "left")
    return met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, F.coalesce("code", F.raise_error(F.lit("a symbol has no code word"))).alias("code")))), lambda x: x["code"]), "").alias("bits"))


# ---- Huffman


def huffman_tree(freq: Mapping[str, float]):
    """Nested pairs; equal weights are taken in the order they were made."""
    if not freq:
        raise ValueError("a Huffman code needs one symbol at least")
    heap = [(f, n, (s,)) for n, (s, f) in enumerate(freq.items())]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, [a[2], b[2]]))
        made += 1
    return heap[0][2]


def huffman_code(freq: Mapping[str, float]) -> dict[str, str]:
    """Symbol -> code word of least total length; a lone symbol has '0'."""
    if not isinstance(freq, Mapping):
        raise TypeError("frequencies are a mapping of symbols to numbers")
    tree = huffman_tree(freq)
    if isinstance(tree, tuple):
        return {tree[0]: "0"}
    out, todo = {}, [("", tree)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, tuple):
            out[node[0]] = path
        else:
            todo += [(path + "1", node[1]), (path + "0", node[0])]
    return out


def canonical_huffman(freq: Mapping[str, float]) -> tuple[dict[str, str], list[int], list[str]]:
    """The code, the number of code words of each length, and the symbols in order."""
    lengths = {s: len(w) for s, w in huffman_code(freq).items()}
    symbols = sorted(lengths, key=lengths.__getitem__)
    count = [0] * (max(lengths.values()) + 1)
    out, value, before = {}, 0, lengths[symbols[0]]
    for s in symbols:
        value <<= lengths[s] - before
        before = lengths[s]
        out[s] = f"{value:0{before}b}"
        value += 1
        count[before] += 1
    return out, count, symbols


def canonical_symbols(bits: str, count: list[int], symbols: list[str]) -> Iterator[str]:
    """Decodes by the numbers of code words of each length alone.

    Seen as fractions of one, the code words of each length fill a stretch right above those of the shorter
    ones. So the next bits of a place, as a fraction, tell by the ends of the stretches how long the code word
    is, and by their distance from the stretch's beginning which one of its length.
    """
    if len(count) > MAX_CANONICAL + 1:
        raise ValueError(f"code words have {MAX_CANONICAL} bits at most")
    if any(n < 0 for n in count) or sum(count[1:]) != len(symbols):
        raise ValueError("count doesn't fit the symbols")
    width = max(1, len(count) - 1)
    lengths = np.arange(1, width + 1)
    sizes = np.array([*count[1:], *([0] * (width + 1 - max(len(count), 1)))][:width], np.int64)
    filled = np.cumsum(sizes << (width - lengths))  # where each length's stretch ends, in units of the longest word
    if len(filled) and filled[-1] > 1 << width:
        raise ValueError("count has more code words than there can be")
    begins, before = filled - (sizes << (width - lengths)), np.cumsum(sizes) - sizes
    at = 0
    while at < len(bits):
        start, n = at, min(BLOCK, len(bits) - at)
        x = windows(bits, at, n, width)
        kind = np.searchsorted(filled, x, side="right")  # the shortest length whose stretch goes beyond x
        known = np.minimum(kind, width - 1)
        which = (before[known] + ((x - begins[known]) >> (width - lengths[known]))).tolist()
        steps = np.where(kind < width, lengths[known], 0).tolist()
        while at - start < n:
            step = steps[at - start]
            if at + (step or width) > len(bits):
                raise ValueError("the bits end inside a code word")
            if not step:
                raise ValueError(f"no code word fits the bits at position {at}")
            yield symbols[which[at - start]]
            at += step


def canonical_decode(bits: ColumnOrName, count: list[int], symbols: list[str]) -> Column:
    @F.pandas_udf("array<string>")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else list(canonical_symbols(x, count, symbols)) for x in a], dtype=object)

    return run(c(bits))


def books(freqs: DataFrame, key: str = "book_id", canonical: bool = False) -> DataFrame:
    """(key, symbol, code) of a Huffman code for each key; freqs has (key, symbol, freq), a symbol table a key."""
    schema = T.StructType([freqs.schema[key], T.StructField("symbol", T.StringType()), T.StructField("code", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        freq = dict(zip(pdf["symbol"], pdf["freq"]))  # as many rows as the alphabet has symbols
        code = canonical_huffman(freq)[0] if canonical else huffman_code(freq)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(code), "symbol": list(code), "code": list(code.values())})

    return freqs.groupBy(key).applyInPandas(run, schema)


def efficiency(freqs: DataFrame, codes: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, entropy, mean_length, ratio) of each book."""
    total = freqs.groupBy(key).agg(F.sum("freq").alias("total"))
    shares = freqs.join(total, key).join(codes, [key, "symbol"]).withColumn("p", F.col("freq") / F.col("total"))
    out = shares.groupBy(key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") * F.length("code")).alias("mean_length"))
    return out.withColumn("ratio", F.col("entropy") / F.col("mean_length"))


# ---- compressed files: codebook and message in one blob


def compress(data: bytes, canonical: bool = False) -> bytes:
    """Huffman-coded bytes: the number of symbols, (symbol, code word or length) pairs, then the serialized message."""
    from .codecs import bits_of, packed, vl_encode

    freq: dict[str, int] = {}
    for byte in data:
        freq[chr(byte)] = freq.get(chr(byte), 0) + 1
    freq = dict(sorted(freq.items()))
    if not freq:
        return b"\0\0"
    code = canonical_huffman(freq)[0] if canonical else huffman_code(freq)
    out = [len(code).to_bytes(2, "little")]
    for s, w in code.items():
        out.append(bytes([ord(s)]) + (bytes([len(w)]) if canonical else vl_encode(bits_of(w))))
    bits = "".join(code[chr(b)] for b in data)
    pad = -len(bits) % 8
    return b"".join([*out, bytes([16 + pad]), packed(bits_of(bits), "big")])


def decompress(blob: bytes, canonical: bool = False) -> bytes:
    from .codecs import text_of, unpacked, vl_decode

    n, at = int.from_bytes(blob[:2], "little"), 2
    if not n:
        return b""
    code: dict[str, str] = {}
    lengths: dict[str, int] = {}
    for _ in range(n):
        s = chr(blob[at])
        if canonical:
            lengths[s] = blob[at + 1]
            at += 2
        else:
            bits, at = vl_decode(blob, at + 1)
            code[s] = text_of(bits)
    body = blob[at + 1 :]
    bits = text_of(unpacked(body, "big", 8 * len(body) - (blob[at] & 7)))
    if canonical:
        count = [0] * (max(lengths.values()) + 1)
        for v in lengths.values():
            count[v] += 1
        return bytes(ord(s) for s in canonical_symbols(bits, count, sorted(lengths, key=lengths.__getitem__)))
    return bytes(ord(s) for _, s in DecodeTree(code).decode(bits))


def _bytes_column(kernel, column: ColumnOrName) -> Column:
    @F.pandas_udf("binary")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernel(bytes(x)) for x in a], dtype=object)

    return run(c(column))


def compressed(data: ColumnOrName, canonical: bool = False) -> Column:
    return _bytes_column(lambda x: compress(x, canonical), data)


def decompressed(blob: ColumnOrName, canonical: bool = False) -> Column:
    return _bytes_column(lambda x: decompress(x, canonical), blob)


def decode_all(bits: Iterable[str], code: Mapping[str, str]) -> list[list[str]]:
    tree = DecodeTree(code)
    return [[s for _, s in tree.decode(b)] for b in bits]
