"""Prefix codes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkbits.functions import prefix as P

HELLO = {"H": "111", "e": "0", "l": "110", "o": "10"}


def test_encode_decode(one):
    word = F.split(F.lit("Hello"), "")
    assert one(P.encode(word, HELLO), F.array_join(P.decode(P.encode(word, HELLO), HELLO), "")) == ["111011011010", "Hello"]
    assert one(P.decode(F.lit("1110"), HELLO), P.decode(F.lit("11"), HELLO, strict=False), P.encode(F.array(F.lit("x")), HELLO, strict=False)) == [["H", "e"], None, None]
    partly = one(P.decode_partly(F.lit("011011"), HELLO))[0]
    assert (partly.symbols, partly.at) == (["e", "l"], 4) and partly.error.startswith("incomplete")


def test_tree():
    t = P.DecodeTree(HELLO)
    assert t.nodes() == (0, 3, 4) and t.complete() and t.todict() == HELLO
    assert P.DecodeTree({"a": "00"}).nodes() == (2, 0, 1)
    for bad in ({"a": "0", "b": "01"}, {"a": "01", "b": "0"}, {"a": "0", "b": "0"}, {"a": ""}, {}, {"a": "0" * 257}):
        with pytest.raises(ValueError):
            P.DecodeTree(bad)
    with pytest.raises(ValueError, match="no code word fits"):
        list(P.DecodeTree({"a": "00"}).decode("01"))


def test_table_function_skips(spark):
    spark.udtf.register("decode_hello", P.decoder(HELLO, {0: 2}))
    rows = spark.sql("SELECT * FROM decode_hello('111' || '01' || '0' || '10')").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "H"), (1, 5, "e"), (2, 6, "o")]


def test_canonical():
    freq = {"a": 5, "b": 2, "r": 2, "c": 1, "d": 1}
    code, count, symbols = P.canonical_huffman(freq)
    assert sum(2.0 ** -len(w) for w in code.values()) == 1 and sum(count) == len(symbols) == 5
    assert sorted(code.values(), key=lambda w: (len(w), w)) == [code[s] for s in symbols]
    bits = "".join(code[s] for s in "abracadabra")
    assert "".join(P.canonical_symbols(bits, count, symbols)) == "abracadabra"
    assert "".join(P.canonical_symbols("01011001110011110101100", [0, 1, 1, 1, 2], list("abrcd"))) == "abracadabra"
    with pytest.raises(ValueError, match="end inside"):
        list(P.canonical_symbols("11", [0, 1, 1, 1, 2], list("abrcd")))
    with pytest.raises(ValueError, match="no code word fits"):
        list(P.canonical_symbols("1" * 3, [0, 1], ["a"]))
    with pytest.raises(ValueError):
        list(P.canonical_symbols("1", [0, 3], list("abc")))


def test_huffman_is_optimal():
    assert P.huffman_code({"x": 3}) == {"x": "0"}
    with pytest.raises(ValueError):
        P.huffman_code({})
    freq = {chr(97 + k): f for k, f in enumerate([1, 1, 2, 3, 5, 8, 13])}
    code = P.huffman_code(freq)
    assert sum(freq[s] * len(w) for s, w in code.items()) == 33 + 20 + 12 + 7 + 4 + 2
    P.DecodeTree(code)


def test_files():
    for data in (b"", b"a", b"aaaa", bytes(range(256)) * 3, b"hello world"):
        for canonical in (False, True):
            assert P.decompress(P.compress(data, canonical), canonical) == data


def test_relations(spark):
    codes = spark.createDataFrame([("h", s, w) for s, w in HELLO.items()], "book_id string, symbol string, code string")
    assert P.ambiguous(codes).count() == 0
    assert [tuple(r) for r in P.nodes(codes).collect()] == [("h", 0, 3, 4)]
    assert {r.symbol for r in P.ambiguous(codes.union(spark.createDataFrame([("h", "x", "11")], codes.schema))).collect()} == {"x"}
    freqs = spark.createDataFrame([("k", s, f) for s, f in zip("abcd", (1, 2, 4, 8))], "book_id string, symbol string, freq long")
    assert {r.symbol: len(r.code) for r in P.books(freqs).collect()} == {"a": 3, "b": 3, "c": 2, "d": 1}
