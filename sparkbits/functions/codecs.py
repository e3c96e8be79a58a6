"""Binary codecs whose cursor depends on the data: variable length (vl), sparse (sc), run length (rl).

The kernels work on numpy arrays of 0 and 1 in index order; the column functions wrap them as
Arrow-based pandas functions over form T. Parallelism is across rows. A decoder gives the vector and
the number of bytes it has read, so several values may follow each other in one blob.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import ColumnOrName, c, from_bytes, to_bytes

#: Bytes that a block of type m spans.
SPAN = {m: 1 << (8 * m - 3) for m in (1, 2, 3, 4)}


def bits_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) - 48


def text_of(bits: np.ndarray) -> str:
    return (bits.astype(np.uint8) + 48).tobytes().decode("ascii")


def packed(bits: np.ndarray, endian: str) -> bytes:
    return np.packbits(bits, bitorder=endian).tobytes()


def unpacked(data: bytes, endian: str, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder=endian)[:n]


# ---- ULEB128


def uleb128_encode(n: int) -> bytes:
    if n < 0:
        raise ValueError("a number is 0 or more here")
    groups = [n >> s & 127 for s in range(0, max(1, n.bit_length()), 7)]
    return bytes([*(g | 128 for g in groups[:-1]), groups[-1]])


def uleb128_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number and where it ends. At most 63 bits; needless zero groups are allowed."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the data end too early")
        byte = data[at]
        at += 1
        if byte & 127 and (shift > 62 or (byte & 127) << shift >> 63):
            raise OverflowError("a number has 63 bits at most")
        n |= (byte & 127) << shift if shift < 64 else 0
        shift += 7
        if byte < 128:
            return n, at


# ---- run length


def rl_encode(bits: np.ndarray) -> bytes:
    """ASCII of the first bit, the number of bits, the lengths of the runs."""
    edges = np.flatnonzero(np.diff(bits)) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(bits)]])) if len(bits) else []
    return (b"1" if len(bits) and bits[0] else b"0") + uleb128_encode(len(bits)) + b"".join(uleb128_encode(int(r)) for r in runs)


def rl_decode(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    if at >= len(data) or data[at] not in b"01":
        raise ValueError("the first byte is neither 0 nor 1")
    value = data[at] - 48
    n, at = uleb128_decode(data, at + 1)
    runs: list[int] = []
    left = n
    while left:
        run, at = uleb128_decode(data, at)
        if not 0 < run <= left:
            raise ValueError("run of length zero" if not run else "run exceeds the number of bits")
        runs.append(run)
        left -= run
    return np.repeat((np.arange(len(runs)) + value) % 2, runs).astype(np.uint8), at


# ---- variable length


def vl_encode(bits: np.ndarray) -> bytes:
    """Four data bits behind a 3-bit count of padding, then seven a byte; the high bit says that more follows."""
    pad = (4 - len(bits)) % 7
    data = np.concatenate([bits, np.zeros(pad, np.uint8)])
    rows = np.zeros((1 + (len(data) - 4) // 7, 8), np.uint8)
    rows[:-1, 0] = 1
    rows[0, 1:4] = [pad >> 2 & 1, pad >> 1 & 1, pad & 1]
    rows[0, 4:] = data[:4]
    rows[1:, 1:] = data[4:].reshape(-1, 7)
    return packed(rows.ravel(), "big")


def vl_decode(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    end = at
    while end < len(data) and data[end] & 128:
        end += 1
    if end >= len(data):
        raise ValueError("no byte ends the vector")
    rows = unpacked(data[at : end + 1], "big", 8 * (end + 1 - at)).reshape(-1, 8)
    pad = data[at] >> 4 & 7
    if pad > (6 if len(rows) > 1 else 4):
        raise ValueError(f"0x{data[at]:02x} is no first byte")
    bits = np.concatenate([rows[0, 4:], rows[1:, 1:].ravel()])
    return bits[: len(bits) - pad], end + 1


# ---- sparse


def _number(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "little")


def sc_encode(bits: np.ndarray, endian: str = "big") -> bytes:
    return sc_encode_packed(packed(bits, endian), len(bits), endian)


def sc_encode_packed(data: bytes, n: int, endian: str = "big") -> bytes:
    """Blocks of raw bytes or of the places of ones, whichever is smaller; zeros after the last one cost nothing.

    data has n bits, pad bits zero. Places come from the words that aren't zero only.
    """
    size = _number(n)
    out = [bytes([(16 if endian == "big" else 0) | len(size)]), size]
    whole = len(data) // 8 * 8
    words = np.frombuffer(data, np.uint64, whole // 8)
    some = np.flatnonzero(words)
    found = words[some]
    if whole < len(data) and any(data[whole:]):
        some = np.append(some, whole // 8)
        found = np.append(found, np.frombuffer(data[whole:] + bytes(whole + 8 - len(data)), np.uint64))
    row, column = np.divmod(np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder=endian)), 64)
    one = 64 * some[row] + column
    at, last = 0, int(one[-1]) // 256 * 32 if len(one) else -1
    before = np.searchsorted(one, np.arange(0, 256 * (max(last, 0) // 32 + 2), 256)).tolist()  # ones before each 32 bytes

    def count(a: int, b: int) -> int:
        return before[min(b // 32, len(before) - 1)] - before[min(a // 32, len(before) - 1)]

    while at <= last:
        if count(at, at + 32) >= min(32, len(data) - at):
            n = min(32, len(data) - at)
            if n == 32:
                while n < 128 * 32 and at + n + 32 <= len(data) and count(at + n, at + n + 32) >= 32:
                    n += 32
            out += [bytes([n if n <= 32 else 31 + n // 32]), data[at : at + n]]
            at += n
            continue
        m = 1
        while m < 4:
            ones = count(at, at + SPAN[m + 1])
            blocks = min(256, (last - at) // SPAN[m] + 1)
            if ones > 255 or 2 + ones >= blocks * (1 if m == 1 else 2):
                break
            m += 1
        first = before[at // 32]
        places = one[first : first + count(at, at + SPAN[m])] - 8 * at
        out.append(bytes([0xA0 + len(places)]) if m == 1 else bytes([0xC0 + m, len(places)]))
        out.append(places.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :m].tobytes())
        at += SPAN[m]
    return b"".join([*out, b"\0"])


def _sc_head(data: bytes, at: int) -> tuple[str, int, int]:
    if at >= len(data):
        raise ValueError("the data end too early")
    head = data[at]
    if head & 0xE0:
        raise ValueError(f"0x{head:02x} is no header")
    size = head & 15
    if size > 8:
        raise OverflowError(f"a length of {size} bytes is too long")
    if at + 1 + size > len(data):
        raise ValueError("the data end too early")
    return "big" if head & 16 else "little", int.from_bytes(data[at + 1 : at + 1 + size], "little"), at + 1 + size


def _sc_blocks(data: bytes, at: int):
    """(type, bytes spanned, payload, end) of every block, the stop byte included as type None."""
    while True:
        if at >= len(data):
            raise ValueError("the data end too early")
        head = data[at]
        at += 1
        if head == 0:
            yield None, 0, b"", at
            return
        if head <= 0x9F:
            kind, width = 0, head if head <= 32 else 32 * (head - 31)
            span = width
        elif head <= 0xBF:
            kind, width, span = 1, head - 0xA0, SPAN[1]
        elif 0xC2 <= head <= 0xC4:
            if at >= len(data):
                raise ValueError("the data end too early")
            kind = head - 0xC0
            width, span = kind * data[at], SPAN[kind]
            at += 1
        else:
            raise ValueError(f"0x{head:02x} begins no block")
        if at + width > len(data):
            raise ValueError("the data end too early")
        yield kind, span, data[at : at + width], at + width
        at += width


def sc_decode(data: bytes, at: int = 0) -> tuple[np.ndarray, str, int]:
    buffer, n, endian, at = sc_decode_packed(data, at)
    return unpacked(buffer, endian, n), endian, at


def sc_decode_packed(data: bytes, at: int = 0) -> tuple[np.ndarray, int, str, int]:
    """The vector's bytes, its number of bits, the endianness, and where the encoding ends."""
    endian, n, at = _sc_head(data, at)
    out = np.zeros(-(-n // 8), np.uint8)
    place = 0
    sparse: list[np.ndarray] = []
    for kind, span, payload, at in _sc_blocks(data, at):  # noqa: B020
        if kind == 0:
            if place + span > len(out):
                raise ValueError(f"raw bytes go beyond the vector: {place} and {span} more, of {len(out)}")
            out[place : place + span] = np.frombuffer(payload, np.uint8)
        elif kind:
            raw = np.zeros((len(payload) // kind, 8), np.uint8)
            raw[:, :kind] = np.frombuffer(payload, np.uint8).reshape(-1, kind)
            sparse.append(raw.view("<u8").ravel().astype(np.int64) + 8 * place)
            if len(raw) and sparse[-1].max() >= n:
                raise ValueError(f"a block of type {kind} sets bit {sparse[-1].max()} of {n}")
        place += span
    if sparse:
        ones = np.concatenate(sparse)
        within = ones & 7
        np.bitwise_or.at(out, ones >> 3, np.left_shift(1, 7 - within if endian == "big" else within).astype(np.uint8))
    if n % 8:  # pad bits of a raw block may be anything
        out[-1] &= (0xFF << (8 - n % 8)) & 0xFF if endian == "big" else (1 << n % 8) - 1
    return out, n, endian, at


def serialize(data: bytes, n: int, endian: str = "big") -> bytes:
    """A head byte, and n bits as they lie in data."""
    return bytes([(16 if endian == "big" else 0) + -n % 8]) + data


def deserialize(blob: bytes) -> tuple[memoryview, int, str]:
    """The vector's bytes, its number of bits and the endianness."""
    if not blob or blob[0] & 0xE8 or (len(blob) == 1 and blob[0] & 7):
        raise ValueError("this is no first byte of a vector")
    return memoryview(blob)[1:], 8 * (len(blob) - 1) - (blob[0] & 7), "big" if blob[0] & 16 else "little"


def sc_stat(data: bytes) -> tuple[str, int, list[int]]:
    """Endianness, number of bits, number of blocks of each type."""
    endian, n, at = _sc_head(data, 0)
    blocks = [0] * 5
    for kind, *_ in _sc_blocks(data, at):
        if kind is not None:
            blocks[kind] += 1
    return endian, n, blocks


# ---- column functions

#: Rows and bytes that a Python worker gets at once: a value is held several times over while a kernel runs.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded() -> None:
    """Lowers larger Arrow batch settings of the session, as plans read them when they run."""
    spark = SparkSession.getActiveSession()
    for key, most in BATCH.items() if spark else ():
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def released() -> None:
    """Gives back what the batches before have left: workers stay for later tasks, and freed memory piles up in them."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _column(kernel: Callable, returns: str, strict: bool, *columns: ColumnOrName) -> Column:
    bounded()

    def run(*series: pd.Series) -> pd.Series:
        released()
        out = []
        for row in zip(*series):
            if any(x is None for x in row):
                out.append(None)
                continue
            try:
                out.append(kernel(*row))
            except (ValueError, OverflowError):
                if strict:
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    if returns.startswith("struct"):

        def struct(a: pd.Series) -> pd.DataFrame:
            names = [f.split(":")[0] for f in returns[7:-1].split(",")]
            return pd.DataFrame([x if x is not None else [None] * len(names) for x in run(a)], columns=names)

        return F.pandas_udf(struct, returns)(*map(c, columns))

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    return F.pandas_udf(one, returns)(*map(c, columns))


def rl_encoded(bits: ColumnOrName) -> Column:
    return _column(lambda x: rl_encode(bits_of(x)), "binary", True, bits)


def rl_decoded(blob: ColumnOrName, strict: bool = True) -> Column:
    def kernel(x: bytes):
        bits, end = rl_decode(bytes(x))
        return text_of(bits), end

    return _column(kernel, "struct<bits:string,consumed:long>", strict, blob)


def vl_encoded(bits: ColumnOrName) -> Column:
    return _column(lambda x: vl_encode(bits_of(x)), "binary", True, bits)


def vl_decoded(blob: ColumnOrName, strict: bool = True) -> Column:
    def kernel(x: bytes):
        bits, end = vl_decode(bytes(x))
        return text_of(bits), end

    return _column(kernel, "struct<bits:string,consumed:long>", strict, blob)


def vl_stream(blob: ColumnOrName) -> Column:
    """All vectors of a blob that holds several."""

    def kernel(x: bytes):
        at, out, data = 0, [], bytes(x)
        while at < len(data):
            bits, at = vl_decode(data, at)
            out.append(text_of(bits))
        return out

    return _column(kernel, "array<string>", True, blob)


def sc_encoded(bits: ColumnOrName, endian: str = "big") -> Column:
    return _column(lambda x: sc_encode(bits_of(x), endian), "binary", True, bits)


def sc_decoded(blob: ColumnOrName, strict: bool = True) -> Column:
    def kernel(x: bytes):
        bits, endian, end = sc_decode(bytes(x))
        return text_of(bits), endian, end

    return _column(kernel, "struct<bits:string,endian:string,consumed:long>", strict, blob)


def sc_stats(blob: ColumnOrName, strict: bool = True) -> Column:
    """STRUCT<endian, nbits, b0..b4>."""

    def kernel(x: bytes):
        endian, n, blocks = sc_stat(bytes(x))
        return endian, n, *blocks

    return _column(kernel, "struct<endian:string,nbits:long,b0:int,b1:int,b2:int,b3:int,b4:int>", strict, blob)


def uleb128(value: ColumnOrName) -> Column:
    """Seven bits a byte, the low ones first; the high bit says that more follows. BIGINT without Python."""
    v = c(value).cast("long")
    step = lambda s, k: F.when(F.shiftrightunsigned(v, 7 * k) > 0, F.concat(s, F.array(F.shiftrightunsigned(v, 7 * k).bitwiseAND(F.lit(127))))).otherwise(s)
    groups = reduce(step, range(1, 9), F.array(v.bitwiseAND(F.lit(127))))
    more = F.transform(groups, lambda g, k: F.lpad(F.hex(g + F.when(k < F.size(groups) - 1, 128).otherwise(0)), 2, "0"))
    return F.when(v >= 0, F.unhex(F.array_join(more, ""))).otherwise(F.when(v < 0, F.raise_error(F.lit("a number is 0 or more here"))))


def uleb128_number(blob: ColumnOrName) -> Column:
    """STRUCT<value, consumed> of the number that a blob begins with."""
    return _column(lambda x: uleb128_decode(bytes(x)), "struct<value:long,consumed:long>", True, blob)


def deflated(data: ColumnOrName, kind: str = "raw") -> Column:
    """BINARY to a DEFLATE stream: raw, zlib or gzip."""
    import zlib

    wbits = {"raw": -15, "zlib": 15, "gzip": 31}[kind]

    def kernel(x: bytes):
        packer = zlib.compressobj(6, zlib.DEFLATED, wbits)
        return packer.compress(bytes(x)) + packer.flush()

    return _column(kernel, "binary", True, data)


def inflate(blob: ColumnOrName, kind: str = "raw", strict: bool = True) -> Column:
    """BINARY out of a DEFLATE stream: raw, zlib or gzip (with its checksum)."""
    import zlib

    wbits = {"raw": -15, "zlib": 15, "gzip": 31}[kind]

    def kernel(x: bytes):
        try:
            return zlib.decompress(bytes(x), wbits)
        except zlib.error as e:
            raise ValueError(str(e)) from e

    return _column(kernel, "binary", strict, blob)


def double_bits(value: ColumnOrName) -> Column:
    """The 64 bits of a double: sign, 11 of exponent, 52 of fraction."""

    @F.pandas_udf("binary")
    def run(a: pd.Series) -> pd.Series:
        data = a.to_numpy(np.float64, na_value=0.0).astype(">f8").tobytes()
        return pd.Series([None if gone else data[8 * k : 8 * k + 8] for k, gone in enumerate(a.isna())], dtype=object)

    return from_bytes(run(c(value)))


def bits_double(bits: ColumnOrName) -> Column:
    """The double that 64 bits stand for."""

    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        data = b"".join(bytes(8) if x is None else bytes(x) for x in a)
        return pd.Series(np.frombuffer(data, ">f8").astype(np.float64)).where(a.notna(), None)

    return run(F.when(F.length(c(bits)) == 64, to_bytes(bits)))


def int_text(bits: ColumnOrName, signed: bool = False, endian: str = "big") -> Column:
    """The number of any size as decimal text."""

    def kernel(x: str):
        if not x:
            raise ValueError("a number has one bit at least")
        x = x if endian == "big" else x[::-1]
        return str(int(x, 2) - (1 << len(x) if signed and x[0] == "1" else 0))

    return _column(kernel, "string", True, bits)


def text_int(text: ColumnOrName, length: int | None = None, endian: str = "big", signed: bool = False, strict: bool = True) -> Column:
    """Decimal text of any size to bits."""

    def kernel(x: str):
        n = int(x)
        if length is None:
            if n < 0:
                raise OverflowError("a number is 0 or more here")
            out = f"{n:b}"
        else:
            low, high = (-(1 << (length - 1)), 1 << (length - 1)) if signed else (0, 1 << length)
            if not low <= n < high:
                raise OverflowError(f"the number doesn't fit {length} bits")
            out = f"{n & ((1 << length) - 1):0{length}b}"
        return out if endian == "big" else out[::-1]

    return _column(kernel, "string", strict, text)
