"""Codecs and conversions against golden bytes, errors and round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbits.functions import codecs as K
from sparkbits.functions import convert as V


def b(text: str) -> np.ndarray:
    return K.bits_of(text.replace(" ", ""))


VL = {"": "40", "0": "30", "1": "38", "0000": "00", "0001": "01", "001101": "d320", "00001": "e040", "0000000001": "9002", "010101001110011": "b5a718", "01010110111001110": "95b71c"}
RL = {"": "3000", "0": "300101", "1": "310101", "10": "31020101", "01": "30020101", "1" + "0" * 63: "3140013f", "0" + "1" * 63: "3040013f", "0" * 4 + "1" * 16 + "0" * 7: "301b041007"}
SC = [("", "little", "0000"), ("110", "little", "0103010300"), ("0000001", "little", "0107014000"), ("0000001", "big", "1107010200"), ("0000111111110000", "little", "011002f00f00"), ("0000000000001000", "big", "1110a10c00"), ("000000001", "big", "1109a10800"), ("0" * 97 + "110110", "little", "0167a46162646500")]


def test_vl_golden():
    for bits, blob in VL.items():
        assert K.vl_encode(b(bits)).hex() == blob
        assert K.text_of(K.vl_decode(bytes.fromhex(blob))[0]) == bits
    for bad in ("70", "f0", "50", "60", "", "e0"):
        with pytest.raises(ValueError):
            K.vl_decode(bytes.fromhex(bad))
    data, at, out = bytes.fromhex("403038402ce040d320"), 0, []
    while at < len(data):
        bits, at = K.vl_decode(data, at)
        out.append(K.text_of(bits))
    assert len(out) == 7 and out[:3] == ["", "0", "1"] and out[-2:] == ["00001", "001101"]


def test_rl_golden():
    for bits, blob in RL.items():
        assert K.rl_encode(b(bits)).hex() == blob
        assert K.text_of(K.rl_decode(bytes.fromhex(blob))[0]) == bits
    for bad in ("00", "01", "32", "30010001", "310102", "", "31"):
        with pytest.raises(ValueError):
            K.rl_decode(bytes.fromhex(bad))
    with pytest.raises(OverflowError):
        K.rl_decode(b"0" + b"\xff" * 10 + b"\x01")


def test_sc_golden():
    for bits, endian, blob in SC:
        assert K.sc_encode(b(bits), endian).hex() == blob
        got, e, end = K.sc_decode(bytes.fromhex(blob))
        assert (K.text_of(got), e, end) == (bits, endian, len(blob) // 2)
    long = np.zeros(1 << 24, np.uint8)
    long[[0xAA, 0xBBCC, 0xDDEEFF]] = 1
    blob = bytes.fromhex("0400000001c303aa0000ccbb00ffeedd00")
    assert K.sc_encode(long, "little") == blob and np.array_equal(K.sc_decode(blob)[0], long)
    assert K.sc_stat(blob) == ("little", 1 << 24, [0, 0, 0, 1, 0])
    for bad in ("20", "c000", "0108c0", "0108c1", "0108c5", "0108ff", "01080200000000", "0108a10800", "01"):
        with pytest.raises(ValueError):
            K.sc_decode(bytes.fromhex(bad))
    with pytest.raises(OverflowError):
        K.sc_decode(bytes.fromhex("09" + "00" * 9))


def test_random_round_trips():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 255, 256, 257, 5000, 70_000, 300_000):
        for p in (0.5, 0.1, 0.02, 0.001, 0.00005):
            bits = (rng.random(n) < p).astype(np.uint8)
            for endian in ("big", "little"):
                assert np.array_equal(K.sc_decode(K.sc_encode(bits, endian))[0], bits)
            assert np.array_equal(K.vl_decode(K.vl_encode(bits))[0], bits)
            assert np.array_equal(K.rl_decode(K.rl_encode(bits))[0], bits)


def test_sparse_sizes():
    """Published shares of the raw size for random vectors of several densities."""
    rng = np.random.default_rng(2)
    for p, share in ((0.125, 0.95681512), (0.0625, 0.53125548), (0.00390625, 0.06188744), (0.00097656, 0.01582754)):
        bits = (rng.random(1 << 23) < p).astype(np.uint8)
        assert len(K.sc_encode(bits)) * 8 / len(bits) == pytest.approx(share, rel=0.02)


def test_uleb128():
    for n in (0, 1, 127, 128, 300, (1 << 63) - 1):
        assert K.uleb128_decode(K.uleb128_encode(n)) == (n, len(K.uleb128_encode(n)))
    assert K.uleb128_decode(b"\x80\x80\x00") == (0, 3)
    with pytest.raises(ValueError):
        K.uleb128_encode(-1)


def test_columns(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("01") for _ in range(n)),) for n in (0, 1, 9, 64, 300)] + [(None,)]
    df = spark.createDataFrame(rows, "b string").select("b", K.vl_decoded(K.vl_encoded("b"))["bits"].alias("vl"), K.rl_decoded(K.rl_encoded("b"))["bits"].alias("rl"), K.sc_decoded(K.sc_encoded("b", "little"))["bits"].alias("sc"), V.deserialize(V.serialize("b"))["bits"].alias("se"))
    for r in df.collect():
        assert r.vl == r.rl == r.sc == r.se == r.b


def test_serialize_golden(one):
    cases = [("", "little", "00"), ("1", "little", "0701"), ("1", "big", "1780"), ("11111", "big", "13f8"), ("11110000", "little", "000f"), ("11110000", "big", "10f0"), ("10000111110110", "big", "1287d8")]
    assert one(*(F.lower(F.hex(V.serialize(F.lit(x), e))) for x, e, _ in cases)) == [h for *_, h in cases]
    assert one(*(V.deserialize(F.unhex(F.lit(h)), strict=False).isNull() for h in ("", "01", "08", "18", "07", "20", "80"))) == [True] * 7


def test_bases_golden(one):
    cases = [("101", 2, "101", "101"), ("110100", 4, "320", "310"), ("111001", 8, "74", "71"), ("11110001", 16, "f8", "f1"), ("1111100001", 32, "7Q", "7B"), ("111111000001", 64, "/g", "/B"), ("1000", 16, "1", "8"), ("010010011101", 16, "29b", "49d"), ("0000110011101111", 16, "037f", "0cef")]
    got = one(*(V.to_base(F.lit(x), n, e) for x, n, *_ in cases for e in ("little", "big")))
    assert got == [y for *_, a, z in cases for y in (a, z)]
    back = one(*(V.from_base(F.lit(y), n, e) for _, n, a, z in cases for y, e in ((a, "little"), (z, "big"))))
    assert back == [x for x, *_ in cases for _ in range(2)]
    assert one(V.from_base(F.lit("a"), 32, strict=False), V.to_hex(F.lit("101"), strict=False)) == [None, None]


def test_integers_golden(one):
    assert one(V.to_int(F.lit("00101")), V.to_int(F.lit("00101"), endian="little")) == [5, 20]
    signed = {"1": -1, "01": -2, "001": -4, "110": 3, "00001": -16, "11110": 15, "111111111": -1, "000000001": -256}
    assert one(*(V.to_int(F.lit(x), signed=True, endian="little") for x in signed)) == list(signed.values())
    assert one(K.int_text(F.lit("1" * 200)), K.text_int(F.lit(str((1 << 200) - 1))), V.to_int(F.lit("1" * 126))) == [str((1 << 200) - 1), "1" * 200, (1 << 126) - 1]
    assert one(V.from_int(F.lit(0)), V.from_int(F.lit(-5), 8, signed=True), V.from_int(F.lit(300), 8, strict=False)) == ["0", "11111011", None]


def test_inflate_and_doubles(spark):
    data = b"abc" * 500
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = packer.compress(data) + packer.flush()
    import gzip

    df = spark.createDataFrame([(raw, gzip.compress(data), -2.5)], "r binary, g binary, d double")
    r = df.select(K.inflate("r").alias("r"), K.inflate("g", "gzip").alias("g"), K.inflate("r", "gzip", strict=False).alias("bad"), K.double_bits("d").alias("d"), K.bits_double(K.double_bits("d")).alias("back")).first()
    assert bytes(r.r) == bytes(r.g) == data and r.bad is None and r.d == "1" + "10000000000" + "01" + "0" * 50 and r.back == -2.5


def test_batches_are_bounded(spark):
    """A worker holds a thousand rows or 16 MB at once, however many a task has."""
    keys = list(K.BATCH)
    old = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        K.deflated(F.lit(b""))
        assert all(0 < int(spark.conf.get(k).rstrip("b")) <= K.BATCH[k] for k in keys)
        spark.conf.set(keys[0], "50")
        K.inflate(F.lit(b""))
        assert spark.conf.get(keys[0]) == "50"
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
