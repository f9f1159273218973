"""Scalar functions: tokens, prefixed terms, signatures, shards, bit fields, saturation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the term signature.
BKDR_SEED = 131313
MASK32 = 0xFFFFFFFF
MASK31 = 0x7FFFFFFF


def tokens(text: Column) -> Column:
    """Tokens in order, split at single spaces, empty ones left out; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda x: x != "")


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def token_positions(text: Column) -> Column:
    """Array of (pos, term), pos counted from 0 among the non-empty tokens."""
    return F.transform(tokens(text), lambda x, i: F.struct(i.alias("pos"), x.alias("term")))


def char_segments(text: Column, inner: str = r"[^\p{L}\p{N}]+") -> Column:
    """Array of (pos, term, subs): tokens as ``tokens`` cuts them, pos counted in characters from 0, and below each token
    that ``inner`` (a pattern) cuts further its distinct parts, at the token's place.  Linear in the text."""

    def places(chars: Column) -> Column:
        return F.filter(F.transform(chars, lambda c, i: F.when((c != " ") & (c != "") & ((i == 0) | (F.get(chars, i - 1) == " ")), i)), lambda i: i.isNotNull())

    def segment(at: Column, term: Column) -> Column:
        parts = F.array_distinct(F.filter(F.split(term, inner), lambda x: (x != "") & (x != term)))
        return F.struct(at.alias("pos"), term.alias("term"), F.transform(parts, lambda x: F.struct(at.alias("pos"), x.alias("term"))).alias("subs"))

    return F.zip_with(bound(F.split(F.coalesce(text, F.lit("")), ""), places), tokens(text), segment)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value made once, however often ``f`` names it, also below other functions of elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def title(text: Column) -> Column:
    """The first line."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def prefixed(token: str, value: Column) -> Column:
    """PREFIX INT and STR: one term."""
    return F.concat(F.lit(token), value.cast("string"))


def prefixed_list(token: str, values: Column) -> Column:
    """PREFIX LIST_INT and LIST_STR: distinct terms, nulls left out."""
    return F.array_distinct(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: prefixed(token, v)))


def strip(text: Column) -> Column:
    """What stands behind leading blanks, tabs and line ends, up to the next of these."""
    return F.regexp_extract(text, r"^[ \t\n]*([^ \t\n]*)", 1)


def is_comment(line: Column) -> Column:
    """Whether a configuration line, after blanks and tabs, starts with #."""
    return F.coalesce(line.rlike(r"^[ \t]*#"), F.lit(False))


def is_valid_ip(address: Column) -> Column:
    """Whether an address is four numbers of 0 to 255, dotted (255.255.255.255 stands for none)."""
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.coalesce(address.rlike(rf"^{part}(\.{part}){{3}}$") & (address != "255.255.255.255"), F.lit(False))


def saturate(value: Column, bits: int) -> Column:
    """Clamp to what a field of so many bits holds; negative values to 0."""
    return F.least(F.greatest(value.cast("long"), F.lit(0).cast("long")), F.lit((1 << bits) - 1).cast("long"))


def _bytes(text: Column) -> Column:
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


def sign_bkdr(text: Column) -> Column:
    """First half of a term's signature: h * seed + byte, modulo 2^32, as 31 bits."""
    step = lambda h, c: (h * BKDR_SEED + c).bitwiseAND(F.lit(MASK32))
    return F.aggregate(_bytes(text), F.lit(0).cast("long"), step, lambda h: h.bitwiseAND(F.lit(MASK31)))


def sign_ap(text: Column) -> Column:
    """Second half of a term's signature: shifts and exclusive ors that alternate by byte position, as 31 bits."""
    zero = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        h = a["h"]
        even = F.shiftleft(h, 7).bitwiseXOR(c).bitwiseXOR(F.shiftright(h, 3))
        odd = F.bitwise_not(F.shiftleft(h, 11).bitwiseXOR(c).bitwiseXOR(F.shiftright(h, 5)))
        return F.struct(h.bitwiseXOR(F.when(a["i"] % 2 == 0, even).otherwise(odd)).bitwiseAND(F.lit(MASK32)).alias("h"), (a["i"] + 1).alias("i"))

    return F.aggregate(_bytes(text), zero, step, lambda a: a["h"].bitwiseAND(F.lit(MASK31)))


def sign64(text: Column) -> Column:
    """Both halves in one long."""
    return F.shiftleft(sign_bkdr(text), 32).bitwiseOR(sign_ap(text))


def shard(sign: Column, shards: int = 4) -> Column:
    return F.pmod(sign, F.lit(shards).cast("long"))


def bit_layout(widths: dict[str, int]) -> dict[str, int]:
    """Offset of each field in one long; fields in order, from the low end.  At most 63 bits in all."""
    offsets, at = {}, 0
    for name, bits in widths.items():
        offsets[name] = at
        at += bits
    if at > 63:
        raise ValueError(f"the fields take {at} bits; a long has 63 to give")
    return offsets


def bitfield_pack(widths: dict[str, int]) -> Column:
    """The columns of these names packed into one long, each clamped to its width; null is 0."""
    offsets = bit_layout(widths)
    parts = [F.shiftleft(saturate(F.coalesce(F.col(n), F.lit(0)), bits), offsets[n]) for n, bits in widths.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def bitfield_get(packed: Column, name: str, widths: dict[str, int]) -> Column:
    return F.shiftright(packed, bit_layout(widths)[name]).bitwiseAND(F.lit((1 << widths[name]) - 1))


def bitfield_set(packed: Column, name: str, value: Column, widths: dict[str, int]) -> Column:
    """``packed`` with one field replaced; its neighbours stay."""
    at, bits = bit_layout(widths)[name], widths[name]
    return packed.bitwiseAND(F.lit(~(((1 << bits) - 1) << at))).bitwiseOR(F.shiftleft(saturate(value, bits), at))


def bitfield_entries(packed: Column, widths: dict[str, int]) -> Column:
    """Array of (field, value) of all fields, in the layout's order."""
    return F.array(*(F.struct(F.lit(n).alias("field"), bitfield_get(packed, n, widths).alias("value")) for n in widths))


def bitmap_has(bitmap: Column, position: Column) -> Column:
    """Whether a bitmap of ``bitmap_construct_agg`` has the bit at this position (from 0)."""
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
