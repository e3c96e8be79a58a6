"""Form T against golden values and a Python model (lists and strings)."""

from __future__ import annotations

import random
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from sparkbits.functions import convert as V
from sparkbits.functions import text as X
from sparkbits.functions import words as W
from sparkbits.operators import applied as A


def test_find_golden(one):
    b = "10011000101000"
    cases = [(("", 7, 13), {}, 7), (("", 15, 99), {}, -1), (("0", 0, 99), {}, 1), (("1", 8, 12), {"right": True}, 10), (("1", -99, -4), {"right": True}, 8), (("11", 0, 99), {}, 3), (("11", 4, 99), {}, -1), (("101", 0, 99), {"right": True}, 8)]
    assert one(*(X.find("b", *a, **k) for a, k, _ in cases), b=b) == [x for *_, x in cases]


def test_search_and_count_golden(one):
    b = "10010101110011111001011"
    assert one(X.search("b", "011"), X.search("b", "111"), X.search("b", "1011"), X.search("b", "100"), X.search(F.lit("10011"), ""), b=b) == [[6, 11, 20], [7, 12, 13, 14], [5, 19], [0, 9, 16], [0, 1, 2, 3, 4, 5]]
    b = "100110001110000"
    assert one(X.count_sub("b", ""), X.count_sub("b", "", 16), X.count_sub("b", "00"), X.count_sub("b", "11"), X.count_sub("b", "000"), b=b) == [16, 0, 4, 2, 2]
    b = "010011000111001101"
    assert one(X.count("b"), X.count("b", 1, 1, 18, 2), X.count("b", 1, 15, 4, -3), X.count("b", 0, 7, -3), b=b) == [9, 6, 2, 4]


def test_reductions_golden(one):
    b = "111110111110111110111110011110111110111110111000"
    assert one(*(X.count_n("b", n, v) for n, v in ((2, 0), (10, 0), (20, 1), (37, 1), (0, 1))), b=b) == [12, 47, 23, 45, 0]
    a = "011001111101"
    assert one(X.sum_indices("a"), X.sum_indices("a", 2), X.xor_indices("a"), X.xor_indices(F.lit("0001100")), a=a) == [49, 381, 13, 7]
    r = X.correspond_all(F.lit("0000011111"), F.lit("0000100111"))
    assert tuple(one(r)[0]) == (4, 1, 2, 3)
    runs = one(X.intervals(F.lit("001111000000011")))[0]
    assert [tuple(x) for x in runs] == [(0, 0, 2), (1, 2, 6), (0, 6, 13), (1, 13, 15)]
    assert one(X.intervals(F.lit("")))[0] == []


def test_model_slices(spark):
    rng = random.Random(3)
    rows, want, exprs = [], [], []
    cuts = [(rng.choice([None, *range(-9, 10)]), rng.choice([None, *range(-9, 10)]), rng.choice([-5, -3, -2, -1, 1, 2, 3])) for _ in range(14)]
    for n in range(9):
        rows.append(("".join(rng.choice("01") for _ in range(n)),))
    for a, z, s in cuts:
        exprs += [X.slice_("b", a, z, s), X.del_slice("b", a, z, s), X.fill_slice("b", 1, a, z, s), X.count("b", 1, a, z, s)]
    got = spark.createDataFrame(rows, "b string").select("b", *(e.alias(f"c{k}") for k, e in enumerate(exprs))).collect()
    for r in got:
        want = [r.b]
        for a, z, s in cuts:
            x = list(r.b)
            gone, filled = x.copy(), x.copy()
            del gone[a:z:s]
            places = range(*slice(a, z, s).indices(len(x)))
            for k in places:
                filled[k] = "1"
            want += ["".join(x[a:z:s]), "".join(gone), "".join(filled), x[a:z:s].count("1")]
        assert list(r) == want


def test_model_edits(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("01") for _ in range(n)),) for n in (1, 2, 7, 8, 31, 32, 33, 63, 64, 65, 100)]
    m = "".join(rng.choice("01") for _ in range(200))
    mask = F.substring(F.lit(m), F.lit(1), F.length("b"))
    cols = [X.and_("b", mask), X.or_("b", mask), X.xor("b", mask), X.invert("b"), X.lshift("b", 5), X.rshift("b", 5), X.rotate("b", 9), X.rotate("b", -9), X.reverse("b"), X.sort("b"), X.sort("b", True), X.insert("b", -2, 1), X.select_mask("b", mask), X.del_mask("b", mask), X.strip("b", "both"), X.parity("b"), X.count_xor("b", mask), X.subset(X.and_("b", mask), mask), W.from_words(W.xor(W.to_words("b"), W.to_words(mask)), F.length("b")), W.from_words(W.invert(W.to_words("b"), F.length("b")), F.length("b")), X.from_bytes(X.to_bytes("b", "little"), "little")]
    for r in spark.createDataFrame(rows, "b string").select("b", *(c.alias(f"c{k}") for k, c in enumerate(cols))).collect():
        b, n = r.b, len(r.b)
        k = m[:n]
        z = lambda f: "".join("01"[f(x, y)] for x, y in zip(b, k))  # noqa: E731, B023
        by = 9 % n
        ins = list(b)
        ins.insert(-2, "1")
        inv = b.translate(str.maketrans("01", "10"))
        want = [z(lambda x, y: x == y == "1"), z(lambda x, y: "1" in x + y), z(lambda x, y: x != y), inv, (b[5:] + "0" * min(5, n))[:n], ("0" * 5 + b)[:n], b[n - by :] + b[: n - by], b[by:] + b[:by], b[::-1], "".join(sorted(b)), "".join(sorted(b, reverse=True)), "".join(ins)]
        want += ["".join(x for x, y in zip(b, k) if y == "1"), "".join(x for x, y in zip(b, k) if y == "0"), b.strip("0"), b.count("1") % 2, sum(x != y for x, y in zip(b, k)), True, z(lambda x, y: x != y), inv, b + "0" * (-n % 8)]
        assert list(r)[1:] == want, b


def test_scatter_keeps_last(one):
    b = "00000000"
    assert one(X.put("b", F.expr("array(1, -1, 1)"), F.lit("011")), X.put("b", F.expr("array(1, 1)"), F.lit("10")), X.put_value("b", F.expr("array(0, -2)"), 1), X.del_list("b", F.expr("array(0, 0, 7)")), X.gather(F.lit("0110"), F.expr("array(1, -1, 1)")), b=b) == ["01000001", "00000000", "10000010", "000000", "101"]


def test_errors(one):
    bad = [X.parse(F.lit("012")), X.get("b", 3), X.lshift("b", -1), X.and_("b", F.lit("1")), X.index("b", "11"), X.select_mask("b", F.lit("1")), X.zeros(-1), X.set_bit("b", 0, 2), X.pop("b", 9)["item"], X.remove(F.lit("0"), 1), X.count_n("b", 9)]
    for c in bad:
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|only 0, 1|a length is|no bit|fewer such|vector|negative"):
            one(c, b="101")
    with pytest.raises(ValueError):
        X.fill_mask("b", "1", 2)
    with pytest.raises(ValueError):
        X.slice_("b", step=0)
    assert one(X.get("b", 3, strict=False), X.parse(F.lit("0 1_1 ")), X.index("b", "11", strict=False), b="101") == [None, "011", None]


def test_null_in_null_out(spark):
    row = spark.createDataFrame([(None,)], "b string")
    cols = [X.count("b"), X.slice_("b", 1, 2), X.slice_("b", None, None, -1), X.and_("b", F.lit("1")), X.find("b", "1"), X.search("b", "1"), X.parse("b"), X.to_bytes("b"), X.sort("b"), X.all_("b")]
    assert list(row.select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first()) == [None] * len(cols)


def test_pretty(one):
    assert one(X.pretty(F.lit("")), X.pretty(F.lit("1" * 9)), X.pretty(F.repeat(F.lit("10"), 40), width=40)) == ["bits()", "bits('11111111 1')", "bits('''\n" + "\n".join("    " + " ".join(["10101010"] * n) for n in (4, 4, 2)) + "\n''')"]


def test_words_model(spark):
    """What goes through words of 64 or groups of 18 bits, at lengths around their ends, against Python."""
    rng = random.Random(12)
    rows = [tuple("".join(rng.choice("01") for _ in range(n)) for _ in "bm") for n in (0, 1, 7, 8, 9, 17, 18, 19, 36, 63, 64, 65, 127, 128, 129, 200) for _ in range(2)]
    rows += [("0" * 70, "1" * 70), ("1" * 70, "0" * 70), ("0" * 130 + "1", "1" + "0" * 130), (None, None)]
    runs = lambda b: [(int(v), a, z) for a, z, v in ((m.start(), m.end(), m[0][0]) for m in re.finditer("0+|1+", b))]
    ones = lambda b: [k for k, x in enumerate(b) if x == "1"]
    turn = lambda b, a, z: "".join(b[8 * k : 8 * k + 8].ljust(8, "0")[::-1][: len(b[8 * k : 8 * k + 8])] if a <= k < z else b[8 * k : 8 * k + 8] for k in range(-(-len(b) // 8)))
    data = lambda b: bytes(int(b[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(b), 8))
    little = lambda b: bytes(int(b[k : k + 8].ljust(8, "0")[::-1], 2) for k in range(0, len(b), 8))
    xor_all = lambda k: reduce(lambda x, y: x ^ y, k, 0)
    cases = {
        "kept": (X.select_mask("b", "m"), lambda b, m: "".join(x for x, y in zip(b, m) if y == "1")),
        "both": (X.and_("b", "m"), lambda b, m: "".join("1" if x == y == "1" else "0" for x, y in zip(b, m))),
        "either": (X.or_("b", "m"), lambda b, m: "".join("1" if "1" in (x, y) else "0" for x, y in zip(b, m))),
        "differ": (X.xor("b", "m"), lambda b, m: "".join("1" if x != y else "0" for x, y in zip(b, m))),
        "n_both": (X.count_and("b", "m"), lambda b, m: sum(x == y == "1" for x, y in zip(b, m))),
        "meets": (X.any_and("b", "m"), lambda b, m: any(x == y == "1" for x, y in zip(b, m))),
        "inside": (X.subset("b", "m"), lambda b, m: all(y == "1" for x, y in zip(b, m) if x == "1")),
        "sum": (X.sum_indices("b").cast("long"), lambda b, m: sum(ones(b))),
        "squares": (X.sum_indices("b", 2).cast("long"), lambda b, m: sum(k * k for k in ones(b))),
        "xored": (X.xor_indices("b"), lambda b, m: xor_all(ones(b))),
        "listed": (X.to_list("b"), lambda b, m: [int(x) for x in b]),
        "places": (X.search("b", "1"), lambda b, m: ones(b)),
        "pairs": (X.search("b", "11", 2, 60), lambda b, m: [k for k in range(2, min(60, len(b)) - 1) if b[k : k + 2] == "11"]),
        "zeros": (X.search("b", "0", 3), lambda b, m: [k for k in range(3, len(b)) if b[k] == "0"]),
        "first5": (X.first_k("b", 5), lambda b, m: ones(b)[:5]),
        "last5": (X.first_k("b", 5, right=True), lambda b, m: ones(b)[::-1][:5]),
        "third": (X.count_n("b", 3, strict=False), lambda b, m: ones(b)[2] + 1 if len(ones(b)) > 2 else None),
        "last_zero": (X.find("b", "0", right=True), lambda b, m: b.rfind("0")),
        "right_in": (X.find("b", "10", 4, 50, right=True), lambda b, m: b.rfind("10", 4, 50)),
        "runs": (F.transform(X.intervals("b"), lambda r: F.array(r["value"].cast("long"), r["start"], r["stop"])), lambda b, m: [list(r) for r in runs(b)]),
        "turned": (X.bytereverse("b"), lambda b, m: turn(b, 0, 99)),
        "turned_in": (X.bytereverse("b", 1, 3), lambda b, m: turn(b, 1, 3)),
        "big": (X.to_bytes("b"), lambda b, m: data(b)),
        "little": (X.to_bytes("b", "little"), lambda b, m: little(b)),
        "from_big": (X.from_bytes(X.to_bytes("b")), lambda b, m: b.ljust(-(-len(b) // 8) * 8, "0")),
        "from_little": (X.from_bytes(X.to_bytes("b", "little"), "little"), lambda b, m: b.ljust(-(-len(b) // 8) * 8, "0")),
        "a_byte_each": (X.unpack("b"), lambda b, m: bytes(map(int, b))),
        "packed": (X.pack(X.unpack("b", b"\x00", b"\xff")), lambda b, m: b),
        "marks": (X.unpack("b", b"z", b"0"), lambda b, m: b.replace("1", "y").replace("0", "z").replace("y", "0").encode()),
        "nul_one": (X.unpack("b", b"1", b"\x00"), lambda b, m: b.replace("1", "\0").replace("0", "1").encode()),
        "words": (W.from_words(W.to_words("b"), F.length("b")), lambda b, m: b),
        "flips": (A.from_flips(A.flips(F.col("b"))), lambda b, m: b),
        "sparse": (A.from_sparse(A.sparse_ones(F.col("b"))), lambda b, m: b),
        "base64": (F.when(F.length("b") % 6 == 0, V.to_base("b", 64)), lambda b, m: "".join(V.ALPHABETS[64][int(b[k : k + 6], 2)] for k in range(0, len(b), 6)) if len(b) % 6 == 0 else None),
        "base64_back": (V.from_base(V.to_base(F.rpad("b", (6 * F.ceil(F.length("b") / 6)).cast("int"), F.lit("0")), 64), 64), lambda b, m: b.ljust(-(-len(b) // 6) * 6, "0")),
        "hex_little": (V.from_hex(V.to_hex(F.rpad("b", (4 * F.ceil(F.length("b") / 4)).cast("int"), F.lit("0")), "little"), "little"), lambda b, m: b.ljust(-(-len(b) // 4) * 4, "0")),
    }
    got = spark.createDataFrame(rows, "b string, m string").select("b", "m", *(v[0].alias(k) for k, v in cases.items())).collect()
    for r in got:
        for k, (_, model) in cases.items():
            v = bytes(r[k]) if isinstance(r[k], bytearray) else r[k]
            assert v == (None if r.b is None else model(r.b, r.m)), (k, r.b, r.m)


def test_texts_are_dealt_out(spark, tmp_path):
    """A table of one file and one row group is no single task."""
    from sparkbits.plans.base import whole_text

    spark.createDataFrame([(k, "a text") for k in range(200)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bits = whole_text(spark, str(tmp_path)).select("id", "bits", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in bits}) > 4 and {r.bits for r in bits} == {"".join(f"{x:08b}" for x in b"a text")}
