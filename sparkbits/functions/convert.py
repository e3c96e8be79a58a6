"""Bit vectors to and from numbers and digits, and the native codecs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .text import ColumnOrName, c, fail, i

# The digits of each base.
ALPHABETS = {
    2: "01",
    4: "0123",
    8: "01234567",
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _alphabet(n: int) -> str:
    if n not in ALPHABETS:
        raise ValueError(f"base must be 2, 4, 8, 16, 32 or 64, not {n}")
    return ALPHABETS[n]


def to_base(bits: ColumnOrName, n: int, endian: str = "big", group: int = 0, sep: str = " ", strict: bool = True) -> Column:
    """Digits of log2(n) bits each; with little endian a digit's first bit is its lowest."""
    digits, m, b = _alphabet(n), int(math.log2(n)), c(bits)
    if n == 16:
        out = F.lower(X._bits_hex(b, turned=endian != "big"))
    elif n == 64 and endian == "big":
        out = F.left(F.regexp_replace(F.base64(X.to_bytes(b)), "[\r\n]", ""), F.ceil(F.length(b) / m).cast("int"))
    else:
        turn = (lambda x: x) if endian == "big" else F.reverse
        out = X.joined(F.transform(X.pieces(b, m), lambda x: F.substring(F.lit(digits), F.conv(turn(x), 2, 10).cast("int") + 1, F.lit(1))))
    return fail(F.length(b) % m == 0, X.to01(out, group, sep), f"digits to base {n} need a multiple of {m} bits", strict)


def from_base(text: ColumnOrName, n: int, endian: str = "big", strict: bool = True) -> Column:
    """White space is skipped; base 16 takes either case."""
    digits, m = _alphabet(n), int(math.log2(n))
    s = F.regexp_replace(c(text), r"(?U)\s", "")
    s = F.lower(s) if n == 16 else s
    turn = (lambda x: x) if endian == "big" else F.reverse
    if n == 64 and endian == "big":
        bits = X.let(s, lambda x: F.left(X.from_bytes(F.unbase64(F.rpad(x, (4 * F.ceil(F.length(x) / 4)).cast("int"), F.lit("A")))), m * F.length(x)))
    else:
        bits = X._hex_bits(F.upper(s), turned=endian != "big") if n == 16 else X.joined(F.transform(X.chars(s), lambda x: turn(F.lpad(F.bin((F.position(x, F.lit(digits)) - 1).cast("long")), m, "0"))))
    allowed = "^[" + digits.replace("+", r"\+").replace("/", "/") + "]*$"
    return fail(s.rlike(allowed), bits, f"a character is no digit to base {n}", strict)


def to_hex(bits: ColumnOrName, endian: str = "big", group: int = 0, sep: str = " ", strict: bool = True) -> Column:
    return to_base(bits, 16, endian, group, sep, strict)


def from_hex(text: ColumnOrName, endian: str = "big", strict: bool = True) -> Column:
    return from_base(text, 16, endian, strict)


def to_int(bits: ColumnOrName, signed: bool = False, endian: str = "big", strict: bool = True) -> Column:
    """The number as DECIMAL(38,0), for up to 126 bits; ``to_int_text`` has no such bound."""
    b = c(bits) if endian == "big" else F.reverse(c(bits))
    n = F.length(b)
    zero = F.lit(0).cast("decimal(38,0)")
    part = lambda k: F.conv(F.substring(b, 32 * k + 1, F.lit(32)), 2, 10).cast("decimal(38,0)")
    size = lambda k: F.least(F.lit(32), n - 32 * k)
    value = F.aggregate(X.span(F.ceil(n / 32)), zero, lambda s, k: (s * X.shifted(F.lit(1).cast("long"), size(k)).cast("decimal(11,0)") + part(k)).cast("decimal(38,0)"))
    if signed:
        top = F.aggregate(X.span(n), F.lit(1).cast("decimal(38,0)"), lambda s, k: (s * 2).cast("decimal(38,0)"))
        value = F.when(b.startswith("1"), (value - top).cast("decimal(38,0)")).otherwise(value)
    return fail((n > 0) & (n <= 126), value, "a number has 1 to 126 bits here", strict)


def from_int(value: ColumnOrName, length: int | None = None, endian: str = "big", signed: bool = False, strict: bool = True) -> Column:
    """BIGINT to bits: the fewest (one at least), or a fixed length."""
    v = c(value).cast("long")
    if signed and length is None:
        raise TypeError("signed requires argument length")
    if length is not None and length <= 0:
        raise ValueError("length must be > 0")
    raw = F.bin(v)  # two's complement, 64 digits for negative numbers
    if length is None:
        bits, ok = raw, v >= 0
    else:
        wide = F.when(v < 0, F.lpad(raw, max(64, length), "1")).otherwise(F.lpad(raw, max(64, length), "0"))
        bits = F.substring(wide, max(64, length) - length + 1, length)
        if signed:
            ok = F.lit(True) if length >= 64 else (v >= -(1 << (length - 1))) & (v < (1 << (length - 1)))
        else:
            ok = (v >= 0) if length >= 63 else (v >= 0) & (v < (1 << length))
    bits = bits if endian == "big" else F.reverse(bits)
    return fail(ok, bits, "int not representable", strict)


def utf8_bits(point: ColumnOrName) -> Column:
    """The UTF-8 sequence of a number of up to 31 bits: one to four bytes for a code point, up to six by the older rule."""
    v = c(point).cast("long")
    digits = lambda n, shift: F.lpad(F.bin(F.shiftright(v, shift).bitwiseAND(F.lit((1 << n) - 1))), n, "0")
    more = lambda n: [x for k in range(n - 2, -1, -1) for x in (F.lit("10"), digits(6, 6 * k))]
    out = F.when(v < 1 << 7, F.concat(F.lit("0"), digits(7, 0)))
    for n, top in ((2, 11), (3, 16), (4, 21), (5, 26), (6, 31)):
        out = out.when(v < 1 << top, F.concat(F.lit("1" * n + "0"), digits(7 - n, 6 * (n - 1)), *more(n)))
    return fail((v >= 0) & (v < 1 << 31), out, "no UTF-8 sequence has this number")


def code_point(bits: ColumnOrName) -> Column:
    """Code point of one UTF-8 sequence given as bits."""
    b = c(bits)
    n = F.length(b) / 8
    lead = F.when(n == 1, X.slice_(b, 1, 8)).otherwise(X.tail(X.head(b, 8), n + 1))
    more = X.joined(F.transform(X.span(n - 1), lambda k: F.substring(b, 8 * (k + 1) + 3, F.lit(6))))
    return F.conv(F.concat(lead, more), 2, 10).cast("int")


# ---- serialize / deserialize


def serialize(bits: ColumnOrName, endian: str = "big") -> Column:
    """A head byte (0x10 for big, pad bits below) and the buffer."""
    head = F.lpad(F.hex((X.padbits(bits) + (16 if endian == "big" else 0)).cast("long")), 2, "0")
    return F.concat(F.unhex(head), X.to_bytes(bits, endian))


def deserialize(blob: ColumnOrName, strict: bool = True) -> Column:
    """STRUCT<bits, endian>. Pad bits of the input may be anything."""
    b = c(blob)
    head = F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int")
    pad = head.bitwiseAND(7)
    ok = (F.length(b) > 0) & (head.bitwiseAND(0xE8) == 0) & ((F.length(b) > 1) | (head.bitwiseAND(0xEF) == 0))
    body = F.substring(b, F.lit(2), F.length(b))
    whole = F.when(head >= 16, X.from_bytes(body, "big")).otherwise(X.from_bytes(body, "little"))
    out = F.struct(X.head(whole, F.length(whole) - pad).alias("bits"), F.when(head >= 16, "big").otherwise("little").alias("endian"))
    return F.when(b.isNotNull(), fail(F.coalesce(ok, F.lit(False)), out, "invalid header byte", strict))


def to_json(bits: ColumnOrName) -> Column:
    """Up to 50 bits as 0/1 text, more as base64 of serialize()."""
    b = c(bits)
    short = F.to_json(F.struct(b.alias("bits")))
    long = F.to_json(F.struct(F.base64(serialize(b)).alias("bits_b64")))
    return F.when(F.length(b) <= 50, short).otherwise(long)


def from_json(text: ColumnOrName) -> Column:
    x = F.from_json(c(text), "bits string, bits_b64 string")
    return F.coalesce(x["bits"], deserialize(F.unbase64(x["bits_b64"]), strict=False)["bits"])


def small_ints(bits: ColumnOrName, k: int) -> Column:
    """The vector as numbers of k bits each."""
    return F.transform(X.pieces(c(bits), k), lambda x: F.conv(x, 2, 10).cast("int"))


def small_int_get(bits: ColumnOrName, k: int, j: ColumnOrName | int) -> Column:
    return F.conv(F.substring(c(bits), (i(j) if isinstance(j, int) else c(j)) * k + 1, F.lit(k)), 2, 10).cast("int")


def small_int_set(bits: ColumnOrName, k: int, j: int, value: ColumnOrName | int) -> Column:
    v = i(value) if isinstance(value, int) else c(value)
    return X.set_slice(bits, F.lpad(F.bin(v.cast("long")), k, "0"), k * j, k * j + k)


def from_small_ints(values: ColumnOrName, k: int) -> Column:
    return X.joined(F.transform(c(values), lambda v: F.lpad(F.bin(v.cast("long")), k, "0")))
