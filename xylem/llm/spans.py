"""Matches of patterns with their places in code points, by built-in functions only.

``split`` and ``regexp_extract_all`` cut a text at the same leftmost non-overlapping matches, so running sums of
the lengths of gaps and matches give each match its place.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,value:string,at:int>>"


def none() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str) -> Column:
    """The matches' texts."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join, zero: int) -> Column:
    """The running ``join`` (sum, maximum) of an array of numbers, each with its own value in it.

    An array that grows by one in an aggregate is copied each time, so this goes by blocks of the cube root of its
    length: n values cost about n to the power 4/3 in copies, not n squared.
    """

    def along(items: Column, first: Column) -> Column:
        """first, first + x1, first + x1 + x2, ..."""
        return F.aggregate(items, F.array(first), lambda s, x: F.concat(s, F.array(join(F.element_at(s, -1), x))))

    def summed(blocks: Column) -> Column:
        firsts = along(F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), lambda a, x: join(a, x))), F.lit(zero))
        return F.flatten(F.zip_with(blocks, F.slice(firsts, F.lit(1), F.size(blocks)), lambda b, first: F.slice(along(b, first), F.lit(2), F.size(b))))

    def cut(v: Column) -> Column:
        n = F.size(v)
        whole = lambda block: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda k: F.slice(v, (k * block + 1).cast("int"), block))
        return F.when(n > 0, let(let(F.greatest(F.lit(1), F.ceil(F.cbrt(n.cast("double"))).cast("int")), whole), summed)).otherwise(F.array().cast("array<int>"))

    return let(values, cut)


def placed(text: Column, pattern: str, found: Column) -> Column:
    """(start, stop, value, at) of each of the ``found`` matches: places in code points, stop exclusive, and the start in bytes."""

    def total(pairs: Column, size) -> Column:
        return running(F.transform(pairs, lambda p: size(p["g"]) + size(p["v"])), lambda a, b: a + b, 0)

    def made(pairs: Column) -> Column:
        stops = F.zip_with(total(pairs, F.char_length), total(pairs, F.octet_length), lambda c, b: F.struct(c.alias("c"), b.alias("b")))
        return F.zip_with(stops, pairs, lambda s, p: F.struct((s["c"] - F.char_length(p["v"])).alias("start"), s["c"].alias("stop"), p["v"].alias("value"), (s["b"] - F.octet_length(p["v"])).alias("at")))

    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("g"), v.alias("v")))
    return F.when(F.size(found) > 0, let(pairs, made)).otherwise(none())


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass Luhn's test."""
    back = F.reverse(number)

    def one(i: Column) -> Column:
        d = F.ascii(F.substring(back, i + 1, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.char_length(number) - 1), one), F.lit(0), lambda a, b: a + b) % 10 == 0


def named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), x["at"].alias("at")))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans`` (at, end: places in bytes; put; sorted by ``at``) replaced; of overlapping ones the
    first is put and covers all of them. Texts are cut by bytes, which takes no walk from their start."""
    cut = lambda raw, a, b: F.decode(F.substring(raw, a + 1, F.greatest(b - a, F.lit(0))), "UTF-8")

    def each(raw: Column, before: Column) -> Column:
        """``before``: how far the spans before each one reach."""
        parts = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda x, b: F.when(x["at"] >= b, F.concat(cut(raw, b, x["at"]), x["put"])).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(raw, F.element_at(before, -1), F.octet_length(raw)))

    ends = running(F.transform(spans, lambda x: x["end"]), F.greatest, 0)
    return let(F.encode(text, "UTF-8"), lambda raw: let(F.concat(F.array(F.lit(0)), ends), lambda before: each(raw, before)))
