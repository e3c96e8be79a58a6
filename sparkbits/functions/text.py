"""Bit vectors as strings of 0 and 1 (form T).

Every function takes and gives Columns and stays inside Spark SQL. Null in, null out. An invalid
value raises (``raise_error``); functions with a ``strict`` argument give null instead where it is
False. Indices are Python's: they count from zero, negative ones from the end.

Every function takes time in proportion to the length of its vectors (those that merge lists of
indices sort, so n log n): a text is cut into characters or pieces in one pass, and nothing inside a
lambda looks a place up in a text, as that walks the text from its start. A lambda costs far more for each
element than a string function for each character: most functions go through words of 64 bits, and what
has to list bits one by one does it in a single pass. ``let`` keeps an argument from being worked out anew
wherever it is named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
Int = Column | int
CHUNK = 64
RUNS = "array<struct<value:int,start:bigint,stop:bigint>>"
EQUAL = "two vectors of one length are needed"


def c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def i(x: Int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def t(x: ColumnOrName | str) -> Column:
    """A column, or a string of 0 and 1 (or empty) as a literal."""
    return F.lit(x) if isinstance(x, str) and set(x) <= {"0", "1"} else c(x)


def fail(ok: Column, value: Column, message: str, strict: bool = True) -> Column:
    """value where ok, else an error or null; null where ok is null."""
    otherwise = F.when(~ok, F.raise_error(F.lit(message))) if strict else F.lit(None)
    return F.when(ok, value).otherwise(otherwise)


def span(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.when(n.isNotNull(), F.array().cast("array<int>")))


def at(b: Column, k: Int) -> Column:
    """The character at a non-negative index. It walks the text: not for use inside a lambda over indices."""
    return F.substring(b, (i(k) + 1).cast("int"), F.lit(1))


def head(b: Column, n: Int) -> Column:
    return F.substring(b, F.lit(1), F.greatest(i(n).cast("int"), F.lit(0)))


def tail(b: Column, n: Int) -> Column:
    """From index n on, n not negative."""
    return F.substring(b, (i(n) + 1).cast("int"), F.length(b))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def chars(b: Column) -> Column:
    """The characters as an array."""
    return F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.when(b.isNotNull(), F.array().cast("array<string>")))


def pieces(b: Column, n: int) -> Column:
    """Every n characters as an array; the last piece may be shorter."""
    return F.regexp_extract_all(b, F.lit(f".{{1,{n}}}"), F.lit(0))


def places(b: Column, value: str) -> Column:
    """The indices of a character."""
    return let(b, lambda v: F.filter(F.transform(chars(v), lambda x, k: F.when(x == value, k)), lambda k: k.isNotNull()))


def number(piece: Column) -> Column:
    """Up to 64 bits as a BIGINT."""
    return F.conv(piece, 2, -10).cast("long")


def padded(b: Column, n: int) -> Column:
    """With zeros up to a multiple of n."""
    return F.rpad(b, (n * F.ceil(F.length(b) / n)).cast("int"), F.lit("0"))


def words_of(b: Column) -> Column:
    """BIGINT words of 64 bits with zeros after the last bit."""
    return F.transform(pieces(padded(b, CHUNK), CHUNK), number)


def text_of(words: Column, n: Column) -> Column:
    """The first n bits of BIGINT words."""
    return F.left(joined(F.transform(words, lambda w: F.lpad(F.bin(w), CHUNK, "0"))), n.cast("int"))


def shifted(a: Column, n: Int) -> Column:
    """a << n for a column n."""
    return F.call_function("shiftleft", a, i(n).cast("int"))


def joined(a: Column) -> Column:
    return F.array_join(a, "")


# ---- constructors and conversions to plain values


def parse(text: ColumnOrName, strict: bool = True) -> Column:
    """0/1 text; Unicode white space and underscores are skipped, anything else is an error."""
    bare = F.regexp_replace(c(text), r"(?U)[\s_]", "")
    return fail(bare.rlike("^[01]*$"), bare, "only 0, 1, white space and underscores make a vector", strict)


def zeros(n: Int) -> Column:
    return fail(i(n) >= 0, F.repeat(F.lit("0"), i(n).cast("int")), "a length is 0 at least")


def ones(n: Int) -> Column:
    return fail(i(n) >= 0, F.repeat(F.lit("1"), i(n).cast("int")), "a length is 0 at least")


def from_list(values: ColumnOrName, strict: bool = True) -> Column:
    """An array of integers 0 and 1."""
    a = c(values)
    return fail(F.forall(a, lambda x: F.coalesce(x.isin(0, 1), F.lit(False))), joined(F.transform(a, lambda x: x.cast("int").cast("string"))), "bit must be 0 or 1", strict)


def _hex_bits(digits: Column, turned: bool = False) -> Column:
    """Hexadecimal digits to four bits each; turned, a digit's first bit is its lowest."""
    if turned:
        return F.reverse(_hex_bits(F.reverse(digits)))
    return joined(F.transform(pieces(digits, 16), lambda x: F.lpad(F.bin(F.conv(x, 16, -10).cast("long")), 4 * F.length(x), F.lit("0"))))


def _bits_hex(bits: Column, turned: bool = False) -> Column:
    """Four bits to an upper-case hexadecimal digit each, the last ones padded with zeros."""
    if turned:
        return F.reverse(_bits_hex(F.reverse(bits)))
    return let(bits, lambda b: F.left(joined(F.transform(words_of(b), lambda w: F.lpad(F.hex(w), 16, "0"))), F.ceil(F.length(b) / 4).cast("int")))


def from_bytes(data: ColumnOrName, endian: str = "big") -> Column:
    """Eight bits a byte of BINARY."""
    bits = _hex_bits(F.hex(c(data)))
    return bits if endian == "big" else let(bits, _bytes_turned)


def to_bytes(bits: ColumnOrName, endian: str = "big") -> Column:
    """BINARY with pad bits zero."""
    whole = padded(c(bits), 8)
    return F.unhex(_bits_hex(whole if endian == "big" else let(whole, _bytes_turned)))


def _bytes_turned(whole: Column) -> Column:
    """The bits of each byte in reverse order."""
    return joined(F.transform(pieces(whole, 8), F.reverse))


def pack(data: ColumnOrName) -> Column:
    """One bit a byte of BINARY: 0x00 is 0, anything else 1."""
    return F.translate(F.decode(c(data), "iso-8859-1"), "".join(map(chr, range(256))), "0" + "1" * 255)


def unpack(bits: ColumnOrName, zero: bytes = b"\x00", one: bytes = b"\x01") -> Column:
    """One byte a bit, as BINARY."""
    if len(zero) != 1 or len(one) != 1:
        raise ValueError("a byte is needed for either bit")
    y, z = [x for x in "xyz" if x.encode() != zero][:2]  # neither is written before it is looked for
    marked = F.translate(c(bits), "01", z + y)
    text = F.replace(F.replace(marked, F.lit(z), F.lit(zero.decode("latin-1"))), F.lit(y), F.lit(one.decode("latin-1")))
    return F.encode(text, "iso-8859-1")


def to_list(bits: ColumnOrName) -> Column:
    return chars(c(bits)).cast("array<int>")


def to01(bits: ColumnOrName, group: int = 0, sep: str = " ") -> Column:
    if group < 0:
        raise ValueError("a group has 0 or more bits")
    return c(bits) if group == 0 or not sep else F.array_join(pieces(c(bits), group), sep)


def show(bits: ColumnOrName) -> Column:
    return F.when(c(bits) == "", "bits()").otherwise(F.concat(F.lit("bits('"), c(bits), F.lit("')")))


def pretty(bits: ColumnOrName, group: int = 8, indent: int = 4, width: int = 80) -> Column:
    """Grouped and wrapped lines, as one string."""
    if group < 1 or indent < 0 or width <= indent:
        raise ValueError("group >= 1, indent >= 0 and width > indent are needed")
    a_line = group * ((width - indent) // (group + 1)) or max(1, width - indent - 2)
    b = c(bits)
    n = F.length(b)
    lines = F.transform(pieces(b, a_line), lambda x: F.concat(F.lit(" " * indent), to01(x, group)))
    many = F.concat(F.lit("bits('''\n"), F.array_join(lines, "\n"), F.lit("\n''')"))
    return F.when(n == 0, "bits()").when(len("bits('')") + n + F.floor((n - 1) / group) >= width, many).otherwise(F.concat(F.lit("bits('"), to01(b, group), F.lit("')")))


# ---- inspection


def length(bits: ColumnOrName) -> Column:
    return F.length(c(bits))


def nbytes(bits: ColumnOrName) -> Column:
    return bits2bytes(F.length(c(bits)))


def padbits(bits: ColumnOrName) -> Column:
    return F.pmod(-F.length(c(bits)), F.lit(8))


def bits2bytes(n: Int) -> Column:
    return fail(i(n) >= 0, F.ceil(i(n) / 8), "a number of bits is 0 or more")


def buffer_info(bits: ColumnOrName, endian: str = "big") -> Column:
    return F.struct(nbytes(bits).alias("nbytes"), F.lit(endian).alias("endian"), padbits(bits).alias("padbits"), F.lit(True).alias("readonly"))


def all_(bits: ColumnOrName) -> Column:
    return ~c(bits).contains("0")


def any_(bits: ColumnOrName) -> Column:
    return c(bits).contains("1")


def contains(bits: ColumnOrName, sub: ColumnOrName) -> Column:
    return c(bits).contains(t(sub))


def compare(a: ColumnOrName, b: ColumnOrName) -> Column:
    """-1, 0 or 1; lexicographic, a proper prefix is smaller."""
    return F.when(c(a) < t(b), -1).when(c(a) == t(b), 0).when(c(a) > t(b), 1)


def hash_(bits: ColumnOrName) -> Column:
    """Equal vectors hash equally, whatever their endianness."""
    return F.xxhash64(F.length(c(bits)), c(bits))


# ---- indices and slices


def wrap(n: Column, k: Int) -> Column:
    return F.when(i(k) < 0, i(k) + n).otherwise(i(k))


def get(bits: ColumnOrName, k: Int, strict: bool = True) -> Column:
    b = c(bits)
    p = wrap(F.length(b), k)
    return fail((p >= 0) & (p < F.length(b)), at(b, p).cast("int"), "no bit has this index", strict)


def bounds(n: Column, start: Int | None, stop: Int | None, step: int = 1) -> tuple[Column, Column]:
    """slice(start, stop, step).indices(n) without the step."""
    low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
    clip = lambda x: F.when(i(x) < 0, F.greatest(i(x) + n, low)).otherwise(F.least(i(x), high))
    first = (low if step > 0 else high) if start is None else clip(start)
    last = (high if step > 0 else low) if stop is None else clip(stop)
    return first.cast("int"), last.cast("int")


def slice_(bits: ColumnOrName, start: Int | None = None, stop: Int | None = None, step: int = 1) -> Column:
    b = c(bits)
    if step == 1:
        a, z = bounds(F.length(b), start, stop)
        return F.substring(b, a + 1, F.greatest(z - a, F.lit(0)))
    if step == 0:
        raise ValueError("a slice's step is not 0")
    n = F.length(b)
    a, z = bounds(n, start, stop, step)
    if step < 0:  # forward over the reversed vector
        b, a, z = F.reverse(b), n - 1 - a, n - 1 - z
    part = F.substring(b, a + 1, F.greatest(z - a, F.lit(0)))
    return F.regexp_replace(part, f"(.).{{0,{abs(step) - 1}}}", "$1")


def select_mask(bits: ColumnOrName, mask: ColumnOrName, strict: bool = True) -> Column:
    """Every 18 bits and their mask are read as decimal numbers: the digits of x + 2 y are 2 and 3 where the mask is 1."""
    return let(F.struct(c(bits).alias("b"), t(mask).alias("m")), lambda v: _select_mask(v["b"], v["m"], strict))


def _select_mask(b: Column, m: Column, strict: bool) -> Column:
    group = lambda x: pieces(padded(x, 18), 18)
    sums = F.zip_with(group(b), group(m), lambda x, y: (x.cast("long") + y.cast("long") * 2 + 10**18).cast("string"))
    kept = F.translate(joined(sums), "2301", "01")  # the 1 in front keeps leading zeros, and goes with them
    return fail(F.length(b) == F.length(m), kept, "vector and mask have to be as long as each other", strict)


def normal(n: Column, index: Column, strict: bool = True) -> Column:
    """Indices of a list with negative ones wrapped; an error if any is out of range."""
    wrapped = F.transform(index, lambda k: F.when(k < 0, k + n).otherwise(k).cast("int"))
    return fail(F.forall(wrapped, lambda k: (k >= 0) & (k < n)), wrapped, "no bit has this index", strict)


def gather(bits: ColumnOrName, index: ColumnOrName, strict: bool = True) -> Column:
    b = c(bits)
    return let(F.struct(F.length(b).alias("n"), chars(b).alias("x")), lambda v: joined(F.transform(normal(v["n"], c(index), strict), lambda p: v["x"][p])))


def put_at(b: Column, chosen, value) -> Column:
    """b with value(bit, k) at every index k for which chosen(k) holds."""
    return joined(F.transform(chars(b), lambda x, k: F.when(chosen(k), value(x, k)).otherwise(x)))


def in_slice(n: Column, start: Int | None, stop: Int | None, step: int, body) -> Column:
    """body(chosen, rank, size) of an extended slice: is an index in it, its rank there, and the slice's size."""
    if step == 0:
        raise ValueError("a slice's step is not 0")
    a, z = bounds(n, start, stop, step)

    def inner(x: Column) -> Column:
        a, z = x["a"], x["z"]
        chosen = (lambda k: (k >= a) & (k < z) & ((k - a) % step == 0)) if step > 0 else (lambda k: (k <= a) & (k > z) & ((a - k) % -step == 0))
        return body(chosen, lambda k: ((k - a) / step).cast("int"), F.greatest(F.ceil((z - a) / step), F.lit(0)))

    return let(F.struct(a.alias("a"), z.alias("z")), inner)


def _entry(k: Column, turn: Column, bit: Column) -> Column:
    return F.struct(k.cast("int").alias("k"), turn.cast("int").alias("turn"), bit.cast("string").alias("bit"))


def merged(b: Column, updates: Column) -> Column:
    """b with updates, an array of _entry: the last entry of each index stays, and one with a null bit leaves nothing."""
    base = F.transform(chars(b), lambda x, k: _entry(k, F.lit(-1), x))
    last = lambda s: F.filter(s, lambda x, i: (i == F.size(s) - 1) | (s[F.least(i + 1, F.size(s) - 1)]["k"] != x["k"]))
    return let(F.array_sort(F.concat(base, updates)), lambda s: F.array_join(F.transform(last(s), lambda x: x["bit"]), ""))


def wrapped(n: Column, index: Column, value) -> Column:
    """Array of _entry for a list of indices: value(j, place) at place j of the list, later ones winning."""
    return let(n, lambda size: F.transform(index, lambda k, j: _entry(F.when(k < 0, k + size).otherwise(k), j, value(j))))


def valid_list(n: Column, index: Column) -> Column:
    return F.forall(index, lambda j: (j < n) & (j >= -n))


def set_bit(bits: ColumnOrName, k: Int, v: Int, strict: bool = True) -> Column:
    b = c(bits)
    p = wrap(F.length(b), k)
    new = F.concat(head(b, p), i(v).cast("string"), tail(b, p + 1))
    return fail((p >= 0) & (p < F.length(b)) & i(v).isin(0, 1), new, "no bit has this index, or the value is neither 0 nor 1", strict)


def set_slice(bits: ColumnOrName, other: ColumnOrName, start: Int | None = None, stop: Int | None = None, step: int = 1, strict: bool = True) -> Column:
    """Step 1 may change the length, other steps need as many bits as places."""
    b, o = c(bits), t(other)
    if step == 1:
        a, z = bounds(F.length(b), start, stop)
        return F.concat(head(b, a), o, tail(b, F.greatest(a, z)))
    new = lambda inside, rank, size: fail(size == F.length(o), let(chars(o), lambda v: put_at(b, inside, lambda _, k: v[rank(k)])), "the slice has another number of bits", strict)
    return in_slice(F.length(b), start, stop, step, new)


def fill_slice(bits: ColumnOrName, value: int, start: Int | None = None, stop: Int | None = None, step: int = 1) -> Column:
    b = c(bits)
    if step == 1:
        a, z = bounds(F.length(b), start, stop)
        return F.concat(head(b, a), F.repeat(F.lit(str(value)), F.greatest(z - a, F.lit(0))), tail(b, F.greatest(a, z)))
    return in_slice(F.length(b), start, stop, step, lambda inside, *_: put_at(b, inside, lambda _, k: F.lit(str(value))))


def set_mask(bits: ColumnOrName, mask: ColumnOrName, other: ColumnOrName, strict: bool = True) -> Column:
    """The bits under the mask's ones become those of other, in order."""
    b, m, o = c(bits), t(mask), t(other)
    new = merged(b, let(chars(o), lambda v: F.transform(places(m, "1"), lambda k, r: _entry(k, F.lit(0), v[r]))))
    return fail((F.length(b) == F.length(m)) & (count(m) == F.length(o)), new, "the mask has to be as long as the vector, and to have a one for each new bit", strict)


def fill_mask(bits: ColumnOrName, mask: ColumnOrName, value: int, strict: bool = True) -> Column:
    """The bits under the mask's ones become value: ``b & ~mask`` or ``b | mask``."""
    if value not in (0, 1):
        raise ValueError("a bit is 0 or 1")
    return or_(bits, mask, strict) if value else and_(bits, invert(t(mask)), strict)


def put(bits: ColumnOrName, index: ColumnOrName, other: ColumnOrName, strict: bool = True) -> Column:
    """bits[index[k]] = other[k] for all k in order; the last of several writes stays."""
    b, o, ix = c(bits), t(other), c(index)
    n = F.length(b)
    new = merged(b, let(chars(o), lambda v: wrapped(n, ix, lambda j: v[j])))
    return let(n, lambda size: fail(valid_list(size, ix) & (F.size(ix) == F.length(o)), new, "an index is out of range, or there are not as many bits as indices", strict))


def put_value(bits: ColumnOrName, index: ColumnOrName, value: int, strict: bool = True) -> Column:
    b, ix = c(bits), c(index)
    n = F.length(b)
    return let(n, lambda size: fail(valid_list(size, ix), merged(b, wrapped(n, ix, lambda _: F.lit(str(value)))), "no bit has this index", strict))


def del_at(bits: ColumnOrName, k: Int, strict: bool = True) -> Column:
    b = c(bits)
    p = wrap(F.length(b), k)
    return fail((p >= 0) & (p < F.length(b)), F.concat(head(b, p), tail(b, p + 1)), "no bit has this index", strict)


def del_slice(bits: ColumnOrName, start: Int | None = None, stop: Int | None = None, step: int = 1) -> Column:
    b = c(bits)
    if step == 1:
        a, z = bounds(F.length(b), start, stop)
        return F.concat(head(b, a), tail(b, F.greatest(a, z)))
    return in_slice(F.length(b), start, stop, step, lambda inside, *_: put_at(b, inside, lambda _, k: F.lit("")))


def del_mask(bits: ColumnOrName, mask: ColumnOrName, strict: bool = True) -> Column:
    return select_mask(bits, invert(t(mask)), strict)


def del_list(bits: ColumnOrName, index: ColumnOrName, strict: bool = True) -> Column:
    b, ix = c(bits), c(index)
    n = F.length(b)
    return let(n, lambda size: fail(valid_list(size, ix), merged(b, wrapped(n, ix, lambda _: F.lit(None))), "no bit has this index", strict))


def strip(bits: ColumnOrName, mode: str = "right") -> Column:
    forms = {"right": r"0+$", "left": r"^0+", "both": r"^0+|0+$"}
    if mode not in forms:
        raise ValueError("mode must be 'left', 'right' or 'both'")
    return F.regexp_replace(c(bits), forms[mode], "")


# ---- bitwise algebra


def both(a: Column, b: Column, body) -> Column:
    """body(a, b) with either worked out once."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: body(v["a"], v["b"]))


def paired(a: Column, b: Column, op) -> Column:
    """op(x, y) of the words of two vectors."""
    return F.zip_with(words_of(a), words_of(b), op)


def bitwise(a: Column, b: Column, op, strict: bool = True) -> Column:
    return both(a, b, lambda x, y: fail(F.length(x) == F.length(y), text_of(paired(x, y, op), F.length(x)), EQUAL, strict))


def and_(a: ColumnOrName, b: ColumnOrName, strict: bool = True) -> Column:
    return bitwise(c(a), t(b), lambda x, y: x.bitwiseAND(y), strict)


def or_(a: ColumnOrName, b: ColumnOrName, strict: bool = True) -> Column:
    return bitwise(c(a), t(b), lambda x, y: x.bitwiseOR(y), strict)


def xor(a: ColumnOrName, b: ColumnOrName, strict: bool = True) -> Column:
    return bitwise(c(a), t(b), lambda x, y: x.bitwiseXOR(y), strict)


def invert(bits: ColumnOrName, start: Int | None = None, stop: Int | None = None, step: int | None = None) -> Column:
    """All bits, or those of a slice where step is given."""
    b = c(bits)
    flip = lambda x: F.translate(x, "01", "10")
    if step is None:
        return flip(b)
    return in_slice(F.length(b), start, stop, step, lambda inside, *_: put_at(b, inside, lambda x, k: flip(x)))


def invert_at(bits: ColumnOrName, k: Int, strict: bool = True) -> Column:
    b = c(bits)
    p = wrap(F.length(b), k)
    return fail((p >= 0) & (p < F.length(b)), F.concat(head(b, p), F.translate(at(b, p), "01", "10"), tail(b, p + 1)), "no bit has this index", strict)


def lshift(bits: ColumnOrName, k: Int, strict: bool = True) -> Column:
    """Toward index 0, zeros come in; the length stays."""
    b = c(bits)
    return fail(i(k) >= 0, F.rpad(tail(b, F.least(i(k), F.length(b))), F.length(b), F.lit("0")), "negative shift count", strict)


def rshift(bits: ColumnOrName, k: Int, strict: bool = True) -> Column:
    b = c(bits)
    return fail(i(k) >= 0, F.lpad(head(b, F.length(b) - i(k)), F.length(b), F.lit("0")), "negative shift count", strict)


def rotate(bits: ColumnOrName, k: Int = 1) -> Column:
    """To the right by k, to the left for negative k."""
    b = c(bits)
    by = F.pmod(i(k), F.greatest(F.length(b), F.lit(1)))
    return F.concat(tail(b, F.length(b) - by), head(b, F.length(b) - by))


def reverse(bits: ColumnOrName) -> Column:
    return F.reverse(c(bits))


def bytereverse(bits: ColumnOrName, start: Int | None = None, stop: Int | None = None) -> Column:
    """Reverses the bits inside each byte of a byte range. A last byte that isn't whole is padded with zeros, which come first then."""

    def turned(b: Column) -> Column:
        a, z = bounds(F.ceil(F.length(b) / 8).cast("int"), start, stop)
        part = F.substring(b, 8 * a + 1, F.greatest(8 * (z - a), F.lit(0)))
        new = let(part, lambda x: F.left(_bytes_turned(padded(x, 8)), F.length(x)))
        return F.concat(head(b, 8 * a), new, tail(b, F.greatest(8 * a, F.least(8 * z, F.length(b)))))

    return let(c(bits), turned)


def byteswap(data: ColumnOrName, n: int | None = None, strict: bool = True) -> Column:
    """Reverses every n bytes of BINARY, all of it without n."""
    digits = F.hex(c(data))
    turned = lambda x: joined(F.reverse(pieces(x, 2)))
    if n is None:
        return F.unhex(turned(digits))
    return fail(F.length(digits) / 2 % max(n, 1) == 0, F.unhex(joined(F.transform(pieces(digits, 2 * max(n, 1)), turned))), f"the bytes are no multiple of {n}", strict)


def set_all(bits: ColumnOrName, value: Int) -> Column:
    return F.repeat(i(value).cast("string"), F.length(c(bits)))


def append(bits: ColumnOrName, value: Int) -> Column:
    return fail(i(value).isin(0, 1), F.concat(c(bits), i(value).cast("string")), "bit must be 0 or 1")


def concat(*vectors: ColumnOrName) -> Column:
    return F.concat(*(t(v) for v in vectors))


def extend_bytes(bits: ColumnOrName, data: ColumnOrName, endian: str = "big") -> Column:
    """Raw bytes after the last bit."""
    return F.concat(c(bits), from_bytes(data, endian))


def insert(bits: ColumnOrName, k: Int, value: Int) -> Column:
    b = c(bits)
    p = F.when(i(k) < 0, F.greatest(i(k) + F.length(b), F.lit(0))).otherwise(F.least(i(k), F.length(b)))
    return F.concat(head(b, p), i(value).cast("string"), tail(b, p))


def pop(bits: ColumnOrName, k: Int = -1, strict: bool = True) -> Column:
    """The bit taken out, and the rest."""
    b = c(bits)
    p = wrap(F.length(b), k)
    ok = (p >= 0) & (p < F.length(b))
    return F.struct(fail(ok, at(b, p).cast("int"), "no bit has this index", strict).alias("item"), fail(ok, F.concat(head(b, p), tail(b, p + 1)), "no bit has this index", strict).alias("rest"))


def remove(bits: ColumnOrName, value: int, strict: bool = True) -> Column:
    """Without the first bit of that value."""
    b = c(bits)
    p = F.instr(b, str(value)) - 1
    return fail(p >= 0, F.concat(head(b, p), tail(b, p + 1)), f"no bit is {value}", strict)


def clear(bits: ColumnOrName) -> Column:
    return head(c(bits), 0)


def copy(bits: ColumnOrName) -> Column:
    return c(bits)


def fill(bits: ColumnOrName) -> Column:
    """Padded with zeros to whole bytes, and how many were added."""
    return F.struct(F.rpad(c(bits), (8 * F.ceil(F.length(c(bits)) / 8)).cast("int"), F.lit("0")).alias("bits"), padbits(bits).alias("added"))


def repeat(bits: ColumnOrName, n: Int) -> Column:
    return F.repeat(c(bits), F.greatest(i(n), F.lit(0)))


def sort(bits: ColumnOrName, reverse: bool = False) -> Column:
    k, n = count(bits), F.length(c(bits))
    low, high = F.repeat(F.lit("0"), n - k), F.repeat(F.lit("1"), k)
    return F.concat(high, low) if reverse else F.concat(low, high)


# ---- reductions


def count(bits: ColumnOrName, value: int = 1, start: Int | None = None, stop: Int | None = None, step: int = 1) -> Column:
    b = c(bits) if start is None and stop is None and step == 1 else slice_(bits, start, stop, step)
    return F.length(b) - F.length(F.replace(b, F.lit(str(value)), F.lit("")))


def count_sub(bits: ColumnOrName, sub: ColumnOrName, start: Int = 0, stop: Int | None = None) -> Column:
    """Occurrences that don't overlap. An empty sub is at every place from start to stop, none where start is beyond the end."""
    b, s = c(bits), t(sub)
    n = F.length(b)
    a, z = bounds(n, start, stop)
    within = F.substring(b, a + 1, F.greatest(z - a, F.lit(0)))
    some = (F.length(within) - F.length(F.replace(within, s, F.lit("")))) / F.length(s)
    none = F.when(i(start) > n, 0).otherwise(F.greatest(z - a + 1, F.lit(0)))
    return F.when(F.length(s) == 0, none).otherwise(some).cast("long")


def count_n(bits: ColumnOrName, n: Int, value: int = 1, strict: bool = True) -> Column:
    """The least index below which there are n bits of the value."""

    def place(v: Column) -> Column:
        before = F.call_function("substring_index", v["b"], F.lit(str(value)), v["n"])  # what lies before the n-th one
        last = F.length(before) + 1
        found = F.when(v["n"] == 0, F.lit(0)).when((v["n"] > 0) & (last <= F.length(v["b"])), last)
        return let(found, lambda x: fail(x.isNotNull(), x, "there are fewer such bits", strict))

    return let(F.struct(c(bits).alias("b"), i(n).cast("int").alias("n")), place)


def parity(bits: ColumnOrName) -> Column:
    return count(bits) % 2


def sum_indices(bits: ColumnOrName, mode: int = 1) -> Column:
    """Sum of the set indices, or of their squares with mode 2."""
    if mode not in (1, 2):
        raise ValueError("mode is 1 or 2")
    # bit j of the place inside a word is set in the words' bits under _UNDER[j], so that counts of bits give all sums
    ones = lambda w, m: F.bit_count(w.bitwiseAND(F.lit(m)))
    places = lambda w: reduce(Column.__add__, (ones(w, m) * (1 << j) for j, m in enumerate(_UNDER)))
    squares = lambda w: reduce(Column.__add__, (ones(w, m & k) * ((1 << j + h) * (1 if j == h else 2)) for j, m in enumerate(_UNDER) for h, k in enumerate(_UNDER) if j <= h))
    exact = lambda x: x.cast("decimal(18,0)")
    if mode == 1:
        term = lambda w, k: exact(F.bit_count(w) * (CHUNK * k.cast("long")) + places(w))
    else:
        square = lambda k: exact(k.cast("long") * k.cast("long"))
        term = lambda w, k: square(k) * exact(F.bit_count(w) * CHUNK**2) + exact(k.cast("long") * (2 * CHUNK)) * exact(places(w)) + exact(squares(w))
    terms = lambda b: F.transform(words_of(b), lambda w, k: term(w, k).cast("decimal(38,0)"))
    return F.aggregate(terms(c(bits)), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))


#: Under mask j lie the bits of a word whose place, from its first bit, has bit j set.
_UNDER = [sum(1 << 63 - p for p in range(64) if p >> j & 1) for j in range(6)]
_UNDER = [m - (1 << 64) if m >> 63 else m for m in _UNDER]


def xor_indices(bits: ColumnOrName) -> Column:
    odd = lambda w, m: F.bit_count(w.bitwiseAND(F.lit(m)) if m else w) % 2
    term = lambda w, k: reduce(Column.bitwiseXOR, (odd(w, m) * (1 << j) for j, m in enumerate(_UNDER)), odd(w, 0) * (CHUNK * k))
    return F.aggregate(F.transform(words_of(c(bits)), term), F.lit(0), lambda s, x: s.bitwiseXOR(x.cast("int")))


def _pair_count(a: Column, b: Column, op, strict: bool) -> Column:
    total = lambda x, y: F.aggregate(paired(x, y, lambda p, q: F.bit_count(op(p, q))), F.lit(0), lambda s, n: s + n)
    return both(a, b, lambda x, y: fail(F.length(x) == F.length(y), total(x, y), EQUAL, strict))


def count_and(a: ColumnOrName, b: ColumnOrName, strict: bool = True) -> Column:
    return _pair_count(c(a), t(b), lambda x, y: x.bitwiseAND(y), strict)


def count_or(a: ColumnOrName, b: ColumnOrName, strict: bool = True) -> Column:
    return _pair_count(c(a), t(b), lambda x, y: x.bitwiseOR(y), strict)


def count_xor(a: ColumnOrName, b: ColumnOrName, strict: bool = True) -> Column:
    """The Hamming distance."""
    return _pair_count(c(a), t(b), lambda x, y: x.bitwiseXOR(y), strict)


def any_and(a: ColumnOrName, b: ColumnOrName, strict: bool = True) -> Column:
    meets = lambda x, y: F.exists(paired(x, y, lambda p, q: p.bitwiseAND(q) != 0), lambda found: found)
    return both(c(a), t(b), lambda x, y: fail(F.length(x) == F.length(y), meets(x, y), EQUAL, strict))


def subset(a: ColumnOrName, b: ColumnOrName, strict: bool = True) -> Column:
    inside = lambda x, y: F.forall(paired(x, y, lambda p, q: p.bitwiseAND(q) == p), lambda ok: ok)
    return both(c(a), t(b), lambda x, y: fail(F.length(x) == F.length(y), inside(x, y), EQUAL, strict))


def correspond_all(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Counts of the four pairs: ff, ft, tf, tt."""
    tt = count_and(a, b)
    ft, tf = count(t(b)) - tt, count(c(a)) - tt
    return F.struct((F.length(c(a)) - tt - ft - tf).alias("ff"), ft.alias("ft"), tf.alias("tf"), tt.alias("tt"))


# ---- search


def search(bits: ColumnOrName, sub: ColumnOrName, start: Int | None = None, stop: Int | None = None, right: bool = False) -> Column:
    """All places where sub begins, overlapping ones too. An empty sub is at every place, the end included."""
    b, s = c(bits), t(sub)
    a, z = bounds(F.length(b), start, stop)
    within = F.substring(b, a + 1, F.greatest(z - a, F.lit(0)))
    single = isinstance(sub, str) and sub in ("0", "1")
    marked = within if single else F.regexp_replace(within, F.concat(F.lit("(?="), s, F.lit(").")), F.lit("x"))
    every = F.sequence(a, F.greatest(z, a))
    listed = places(marked, sub if single else "x")
    found = listed if start is None or isinstance(start, int) and start == 0 else let(a, lambda first: F.transform(listed, lambda k: k + first))
    out = F.when(F.length(s) > 0, found).otherwise(F.when(z >= a, every).otherwise(F.array().cast("array<int>")))
    out = F.when(b.isNotNull() & s.isNotNull(), out)
    return F.reverse(out) if right else out


def find(bits: ColumnOrName, sub: ColumnOrName, start: Int = 0, stop: Int | None = None, right: bool = False) -> Column:
    """First (or last) place of sub, -1 if there is none or start is beyond the end."""

    def part(v: Column) -> Column:
        a, z = bounds(v["n"], start, stop)
        return F.struct(v["b"].alias("b"), v["n"].alias("n"), a.alias("a"), z.alias("z"), F.substring(v["b"], a + 1, F.greatest(z - a, F.lit(0))).alias("within"))

    def found(v: Column) -> Column:
        m = F.length(s)
        if right:
            p = F.position(F.reverse(s), F.reverse(v["within"]))
            some = let(p, lambda x: F.when(x > 0, F.greatest(v["a"], v["z"]) - m - x + 1).otherwise(-1))
        else:
            some = let(F.position(s, v["within"]), lambda x: F.when(x > 0, v["a"] + x - 1).otherwise(-1))
        none = v["z"] if right else v["a"]
        return F.when(v["b"].isNotNull() & s.isNotNull(), F.when((i(start) > v["n"]) | (v["z"] < v["a"]), -1).when(m == 0, none).otherwise(some))

    s = t(sub)
    return let(let(F.struct(c(bits).alias("b"), F.length(c(bits)).alias("n")), part), found)


def index(bits: ColumnOrName, sub: ColumnOrName, start: Int = 0, stop: Int | None = None, right: bool = False, strict: bool = True) -> Column:
    p = find(bits, sub, start, stop, right)
    return fail(p >= 0, p, "the vector does not hold this one", strict)


def edges(b: Column, before: Column) -> Column:
    """A one where a bit differs from the one in front of it; before is what the first one is held against."""
    return xor(b, F.left(F.concat(before, b), F.length(b)))


def intervals(bits: ColumnOrName) -> Column:
    """Maximal runs as (value, start, stop): the places where the bit changes, values taking turns."""

    def runs(b: Column) -> Column:
        first = F.substring(b, 1, 1)
        starts = places(edges(b, F.translate(first, "01", "10")), "1")
        turns = lambda f: F.slice(F.flatten(F.array_repeat(F.when(first == "1", F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))), F.ceil(F.size(f) / 2).cast("int"))), F.lit(1), F.size(f))
        stops = lambda f: F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.length(b).cast("long")))
        some = let(starts.cast("array<bigint>"), lambda f: F.arrays_zip(turns(f).alias("value"), f.alias("start"), stops(f).alias("stop")))
        return F.when(F.length(b) > 0, some).otherwise(F.when(b.isNotNull(), F.array().cast(RUNS)))

    return let(c(bits), runs)


def first_k(bits: ColumnOrName, k: int, right: bool = False) -> Column:
    """The first (or last) k set indices: only the part of the vector up to the k-th is looked at."""
    if right:
        cut = lambda b: F.struct(F.concat(F.lit("1"), F.substring_index(b, "1", -k)).alias("part"), (F.length(b) - F.length(F.substring_index(b, "1", -k)) - 1).alias("shift"))
        whole = lambda v: F.transform(places(v["part"], "1"), lambda p: p + v["shift"])
        return let(c(bits), lambda b: let(cut(b), lambda v: F.slice(F.reverse(F.filter(whole(v), lambda p: p >= 0)), 1, k)))
    return let(c(bits), lambda b: F.slice(search(F.left(b, F.length(F.substring_index(b, "1", k)) + 1), "1"), 1, k))


# ---- binary distances


def distances(a: ColumnOrName, b: ColumnOrName) -> dict[str, Column]:
    """Seven dissimilarities by name; a zero denominator gives NaN, but 0 for yule."""
    r = correspond_all(a, b)
    n = F.length(c(a)).cast("double")
    ff, ft, tf, tt = (r[x].cast("double") for x in ("ff", "ft", "tf", "tt"))
    return distances_of(n, ff, ft, tf, tt)


def distances_of(n: Column, ff: Column, ft: Column, tf: Column, tt: Column) -> dict[str, Column]:
    x = ft + tf
    over = lambda p, q: F.when(q == 0, F.lit(float("nan"))).otherwise(F.try_divide(p, q))
    h = tf * ft
    return {
        "dice": over(x, 2 * tt + x),
        "hamming": over(x, n),
        "jaccard": over(x, tt + x),
        "rogerstanimoto": over(2 * x, n + x),
        "russellrao": over(n - tt, n),
        "sokalsneath": over(2 * x, tt + 2 * x),
        "yule": F.when(h == 0, F.lit(0.0)).otherwise(F.try_divide(2 * h, tt * ff + h)),
    }


def all_of(*vectors: ColumnOrName) -> Column:
    return reduce(and_, vectors)
