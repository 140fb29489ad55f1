"""Typed column values: what a scalar expression of the query language lowers to."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ["integer", "decimal", "float", "double"]
#: Derived integer types with their least and greatest values (fixed by XML Schema).
INTEGERS = {
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "nonNegativeInteger": (0, None), "unsignedLong": (0, None), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255), "positiveInteger": (1, None),
}
#: Derived string types with the pattern of their values.
STRINGS = {
    "normalizedString": r"^[^\t\n\r]*$", "token": r"^$|^[^\s](?:[^\t\n\r]*[^\s])?$", "language": r"^[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*$", "NMTOKEN": r"^[\w.:-]+$",
    "Name": r"^[A-Za-z_:][\w.:-]*$", "NCName": r"^[A-Za-z_][\w.-]*$", "ID": r"^[A-Za-z_][\w.-]*$", "IDREF": r"^[A-Za-z_][\w.-]*$", "ENTITY": r"^[A-Za-z_][\w.-]*$",
}
#: Calendar fragments with the pattern of their values.
FRAGMENTS = {
    "gYear": r"^-?\d{4,}(?:Z|[+-]\d\d:\d\d)?$", "gYearMonth": r"^-?\d{4,}-\d\d(?:Z|[+-]\d\d:\d\d)?$", "gMonth": r"^--\d\d(?:Z|[+-]\d\d:\d\d)?$",
    "gMonthDay": r"^--\d\d-\d\d(?:Z|[+-]\d\d:\d\d)?$", "gDay": r"^---\d\d(?:Z|[+-]\d\d:\d\d)?$",
}

SPARK = {
    "string": "string", "untyped": "string", "empty": "string", "anyURI": "string", "boolean": "boolean", "integer": "bigint", "decimal": "decimal(38,12)", "float": "float", "double": "double",
    "date": "date", "dateTime": "timestamp", "time": "string", "dayTimeDuration": "interval day to second", "yearMonthDuration": "interval year to month",
    "hexBinary": "binary", "base64Binary": "binary", "QName": "struct<ns:string,prefix:string,local:string>",
    "item": "struct<kind:string,text:string>", "never": "string",
} | {k: "bigint" for k in INTEGERS} | {k: "string" for k in [*STRINGS, *FRAGMENTS]}


class StaticError(Exception):
    """An error that the analysis of a query finds; ``code`` is its W3C name."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class V:
    """A value in each row: at most one item (null is the empty sequence), or with ``many`` an array of items.

    ``tz``: minutes of the zone of a date or time, where one was given. ``fields``: of an element or row value, its
    named parts. ``name``: of a value that is an element or attribute of that name.
    """

    col: Column
    type: str
    many: bool = False
    tz: Column | None = None
    fields: dict[str, V] = field(default_factory=dict)
    name: str | None = None

    def but(self, col: Column, type: str | None = None, **more) -> V:
        return replace(self, col=col, type=type or self.type, **({"name": None} | more))


def of_spark(kind: T.DataType) -> tuple[str, bool]:
    """Item type and whether it is an array, of a column's type."""
    if isinstance(kind, T.ArrayType):
        return of_spark(kind.elementType)[0], True
    for cls, name in (
        (T.StringType, "string"), (T.BooleanType, "boolean"), (T.DecimalType, "decimal"), (T.DoubleType, "double"), (T.FloatType, "float"), (T.DateType, "date"), (T.TimestampType, "dateTime"),
        (T.TimestampNTZType, "dateTime"), (T.DayTimeIntervalType, "dayTimeDuration"), (T.YearMonthIntervalType, "yearMonthDuration"), (T.BinaryType, "base64Binary"), (T.IntegralType, "integer"),
    ):
        if isinstance(kind, cls):
            return name, False
    return "struct", False


def base(name: str) -> str:
    """The type that arithmetic and comparison treat ``name`` as."""
    if name.startswith("item("):
        return "item"
    return "integer" if name in INTEGERS else "string" if name in STRINGS or name == "anyURI" else name


def lit(value) -> V:
    if isinstance(value, bool):
        return V(F.lit(value), "boolean")
    if isinstance(value, int):
        return V(F.lit(value).cast("bigint"), "integer")
    if isinstance(value, float):
        return V(F.lit(value), "double")
    return V(F.lit(value), "string")


def members(name: str) -> list[str]:
    """The types that items of a mixed type can have: ``item(integer|string)`` is kept as the kind and text of each item."""
    return name[5:-1].split("|") if name.startswith("item(") else []


def settle(v: V, mixed: str = "string") -> V:
    """A mixed value as one type: the widest number if all its items are numbers, else ``mixed``."""
    kinds = members(v.type)
    if not kinds:
        return v
    to = max((base(k) for k in kinds), key=NUMERIC.index) if all(base(k) in NUMERIC for k in kinds) else mixed
    one = lambda x: cast(V(x["text"], "untyped"), to).col
    return v.but(F.transform(v.col, one) if v.many else one(v.col), to)


def tagged(v: V) -> Column:
    """An item of a known type as an item of a mixed one."""
    if members(v.type):
        return v.col
    if v.fields:
        from xylem.session import element_text

        return F.struct(F.lit("element()").alias("kind"), element_text(v, v.name or "row").alias("text"))
    return F.when(v.col.isNotNull(), F.struct(F.lit(v.type).alias("kind"), string(v).alias("text")))


def all_tagged(v: V) -> Column:
    """The items of a value as items of a mixed type, in an array."""
    if not v.many:
        return F.filter(F.array(tagged(v)), lambda x: x.isNotNull())
    return v.col if members(v.type) else F.transform(v.col, lambda x: tagged(V(x, v.type)))


def mixture(values: list[V]) -> str:
    """The type of a sequence of all these: a common one, or a mixed one."""
    kinds = dict.fromkeys(k for v in values if v.type not in ("empty", "never") for k in members(v.type) or ["element()" if v.fields else v.type])
    if len(kinds) == 1 or len({base(k) for k in kinds}) == 1 or not kinds:
        return common(values)
    return f"item({'|'.join(kinds)})"


def as_kind(v: V, kind: str) -> Column:
    """An item cast to ``kind``, which may be a mixed one."""
    return tagged(v) if members(kind) else cast(v, kind).col


def text(v: V) -> Column:
    """The item as a string; the empty sequence as the empty string."""
    return F.coalesce(string(v), F.lit(""))


def string(v: V) -> Column:
    """The item's string value; null stays null."""
    kind = base(v.type)
    if kind == "item":
        return v.col["text"]
    if kind == "double" or kind == "float":
        whole = (F.abs(v.col) < 1e6) & (v.col == F.floor(v.col))
        plain = F.regexp_replace(v.col.cast("string"), r"\.0$", "")
        return F.when(F.isnan(v.col), "NaN").when(v.col == float("inf"), "INF").when(v.col == float("-inf"), "-INF").when(whole, v.col.cast("bigint").cast("string")).otherwise(plain)
    if kind == "decimal":
        return F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind == "dateTime":
        body = F.regexp_replace(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        return F.concat(F.when(F.date_format(v.col, "ss.SSSSSS") == "00.000000", F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(body), zone(v))
    if kind in ("date", "time"):
        return F.concat(v.col.cast("string"), zone(v))
    if kind == "hexBinary":
        return F.hex(v.col)
    if kind == "base64Binary":
        return F.base64(v.col)
    if kind == "QName":
        return F.concat(F.when(v.col["prefix"] != "", F.concat(v.col["prefix"], F.lit(":"))).otherwise(""), v.col["local"])
    if kind == "dayTimeDuration":
        return day_time_text(v.col)
    if kind == "yearMonthDuration":
        months = F.extract(F.lit("YEAR"), v.col) * 12 + F.extract(F.lit("MONTH"), v.col)
        size, sign = F.abs(months), F.when(months < 0, "-").otherwise("")
        years, rest = F.floor(size / 12), size % 12
        return F.when(months == 0, "P0M").otherwise(F.concat(sign, F.lit("P"), F.when(years > 0, F.concat(years.cast("string"), F.lit("Y"))).otherwise(""), F.when(rest > 0, F.concat(rest.cast("string"), F.lit("M"))).otherwise("")))
    return v.col.cast("string")


def zone(v: V) -> Column:
    if v.tz is None:
        return F.lit("")
    size = F.abs(v.tz)
    named = F.concat(F.when(v.tz < 0, "-").otherwise("+"), F.lpad((size / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.when(v.tz.isNull(), "").when(v.tz == 0, "Z").otherwise(named)


def micros(c: Column) -> Column:
    """A day-time interval's microseconds."""
    part = lambda k: F.extract(F.lit(k), c)
    return part("DAY").cast("bigint") * 86_400_000_000 + part("HOUR").cast("bigint") * 3_600_000_000 + part("MINUTE").cast("bigint") * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def day_time_text(c: Column) -> Column:
    total = micros(c)
    size = F.abs(total)
    days, hours, minutes = (F.floor(size / n) % m if m else F.floor(size / n) for n, m in ((86_400_000_000, None), (3_600_000_000, 24), (60_000_000, 60)))
    seconds = F.regexp_replace(((size % 60_000_000) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(10,6)").cast("string"), r"\.?0+$", "")
    seconds = F.when(size % 60_000_000 == 0, "0").otherwise(F.when(seconds == "", "0").otherwise(seconds))
    some = lambda n, k: F.when(n > 0, F.concat(n.cast("string"), F.lit(k))).otherwise("")
    clock = F.concat(some(hours, "H"), some(minutes, "M"), F.when(size % 60_000_000 > 0, F.concat(seconds, F.lit("S"))).otherwise(""))
    return F.when(total == 0, "PT0S").otherwise(F.concat(F.when(total < 0, "-").otherwise(""), F.lit("P"), some(days, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise("")))


def ebv(v: V) -> Column:
    """Effective boolean value, never null."""
    if v.many:
        return F.size(v.col) > 0
    kind = base(v.type)
    if kind == "empty":
        return F.lit(False)
    if kind == "boolean":
        out = v.col
    elif kind in NUMERIC:
        out = (v.col != 0) & ~F.isnan(v.col.cast("double"))
    elif kind in ("string", "untyped"):
        out = F.length(v.col) > 0
    elif kind in ("struct", "node", "row"):
        out = v.col.isNotNull()
    elif kind == "item":
        n = v.col["text"].try_cast("double")
        out = F.when(v.col["kind"] == "boolean", v.col["text"] == "true").when(v.col["kind"].isin([k for k in members(v.type) if base(k) in NUMERIC]), (n != 0) & ~F.isnan(n)).otherwise((v.col["kind"] == "element()") | (F.length(v.col["text"]) > 0))
    else:
        raise StaticError("FORG0006", f"no effective boolean value of xs:{v.type}")
    return F.coalesce(out, F.lit(False))


def promoted(a: V, b: V) -> tuple[Column, Column, str]:
    """Both sides as one type for arithmetic or ordering."""
    x, y = base(a.type), base(b.type)
    x, y = ("double" if x == "untyped" and y in [*NUMERIC, "untyped"] else x), ("double" if y == "untyped" and x in [*NUMERIC, "untyped"] else y)
    if x in NUMERIC and y in NUMERIC:
        kind = NUMERIC[max(NUMERIC.index(x), NUMERIC.index(y))]
        return cast(a, kind).col, cast(b, kind).col, kind
    if x == "untyped":
        return cast(a, y).col, b.col, y
    if y == "untyped":
        return a.col, cast(b, x).col, x
    return a.col, b.col, x


PATTERN_DT = r"^(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
PATTERN_YM = r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?$"


def cast(v: V, to: str, safe: bool = False) -> V:
    """``cast as`` of an item; ``safe``: null where it fails."""
    if members(v.type):
        v = V(v.col["text"], "untyped")
    have = base(v.type)
    if to not in SPARK:
        raise StaticError("XPST0051", f"unknown type xs:{to}")
    want = SPARK[to]
    c = v.col
    change = (lambda x, k: x.try_cast(k)) if safe else (lambda x, k: x.cast(k))
    fail = lambda ok, out: F.when(c.isNull(), None).when(ok, out).otherwise(F.lit(None) if safe else F.raise_error(F.concat(F.lit(f"FORG0001: not a value of xs:{to}: "), F.coalesce(string(v), F.lit("()")))))
    if to == v.type:
        return v
    if v.type == "empty":
        return V(c.cast(want) if want != "binary" and not want.startswith("struct") else F.lit(None).cast(want), to, v.many)
    if to in ("string", "untyped", "anyURI"):
        return V(string(v), to)
    if to in STRINGS:
        trimmed = F.trim(string(v)) if to != "normalizedString" else string(v)
        return V(fail(trimmed.rlike(STRINGS[to]), trimmed).cast("string"), to)
    if to in FRAGMENTS:
        return V(fail(string(v).rlike(FRAGMENTS[to]), string(v)).cast("string"), to)
    if to in INTEGERS:
        whole = cast(v, "integer", safe).col
        low, high = INTEGERS[to]
        ok = F.lit(True)
        if low is not None:
            ok = ok & (whole >= low)
        if high is not None and high < 2**63 - 1:
            ok = ok & (whole <= high)
        return V(fail(F.coalesce(ok, F.lit(False)), whole).cast("bigint"), to)
    if to in NUMERIC:
        if have == "boolean":
            return V(c.cast("int").cast(want), to)
        if have in ("string", "untyped"):
            trimmed = F.trim(c)
            if to in ("double", "float"):
                trimmed = F.when(trimmed == "INF", "Infinity").when(trimmed == "-INF", "-Infinity").otherwise(trimmed)
            return V(change(trimmed, want), to)
        if have in NUMERIC:
            if to == "integer" and have in ("double", "float", "decimal"):
                return V(change(F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "bigint"), to)
            return V(change(c, want), to)
    if to == "boolean":
        if have in NUMERIC:
            return V(F.when(c.isNull(), None).otherwise((c != 0) & ~F.isnan(c.cast("double"))), to)
        trimmed = F.trim(string(v))
        return V(fail(trimmed.isin("true", "false", "1", "0"), trimmed.isin("true", "1")).cast("boolean"), to)
    if to in ("dateTime", "date", "time"):
        if have == "dateTime":
            return V({"date": c.cast("date"), "time": F.date_format(c, "HH:mm:ss")}[to], to, tz=v.tz)
        if have == "date" and to == "dateTime":
            return V(c.cast("timestamp"), to, tz=v.tz)
        raw = F.trim(string(v))
        found = F.regexp_extract(raw, r"(Z|[+-]\d\d:\d\d)$", 1)
        sign = F.when(found.startswith("-"), -1).otherwise(1)
        tz = F.when(raw.isNull() | (found == ""), None).when(found == "Z", 0).otherwise(sign * (F.substring(found, 2, 2).try_cast("int") * 60 + F.substring(found, 5, 2).try_cast("int")))
        body = F.regexp_replace(raw, r"(Z|[+-]\d\d:\d\d)$", "") if to != "date" else F.when(F.length(raw) > 10, F.regexp_replace(raw, r"(Z|[+-]\d\d:\d\d)$", "")).otherwise(raw)
        if to == "date":
            found = F.when(F.length(raw) > 10, found).otherwise("")
            tz = F.when(F.length(raw) > 10, tz)
        if to == "time":
            return V(fail(body.rlike(r"^\d\d:\d\d:\d\d(\.\d+)?$"), body).cast("string"), to, tz=tz)
        return V(change(F.regexp_replace(body, "T", " ") if to == "dateTime" else body, want), to, tz=tz)
    if to == "dayTimeDuration" and have in ("string", "untyped"):
        part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, PATTERN_DT, k), F.lit("")).try_cast("decimal(18,6)"), F.lit(0))
        made = F.make_dt_interval(part(2).cast("int"), part(3).cast("int"), part(4).cast("int"), part(5).cast("decimal(18,6)"))
        return V(fail(c.rlike(PATTERN_DT) & c.rlike(r"\d"), F.when(c.startswith("-"), -made).otherwise(made)), to)
    if to == "yearMonthDuration" and have in ("string", "untyped"):
        part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, PATTERN_YM, k), F.lit("")).try_cast("int"), F.lit(0))
        made = F.make_ym_interval(part(2), part(3))
        return V(fail(c.rlike(PATTERN_YM) & c.rlike(r"\d"), F.when(c.startswith("-"), -made).otherwise(made)), to)
    if to == "hexBinary":
        return V(F.unhex(string(v)) if have != "base64Binary" else c, to)
    if to == "base64Binary":
        return V(F.unbase64(string(v)) if have != "hexBinary" else c, to)
    if to == "QName":
        cut = F.split(string(v), ":")
        return V(F.struct(F.lit("").alias("ns"), F.when(F.size(cut) > 1, cut[0]).otherwise("").alias("prefix"), F.element_at(cut, -1).alias("local")), to)
    raise StaticError("XPTY0004", f"no cast from xs:{v.type} to xs:{to}")


def arithmetic(op: str, a: V, b: V) -> V:
    """``+ - * div idiv mod``; an empty operand gives the empty sequence."""
    if "empty" in (a.type, b.type):
        return V(F.lit(None).cast("bigint"), "integer")
    x, y = base(a.type), base(b.type)
    days, months = "dayTimeDuration", "yearMonthDuration"
    if x in ("date", "dateTime", "time") or y in ("date", "dateTime", "time"):
        if op == "+" and x in (days, months):
            return arithmetic(op, b, a)
        if op == "-" and x == y:
            if x == "time":
                return V((F.concat(F.lit("1970-01-01 "), a.col).cast("timestamp") - F.concat(F.lit("1970-01-01 "), b.col).cast("timestamp")), days)
            at = lambda v: v.col.cast("timestamp") if v.tz is None else v.col.cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(v.tz, F.lit(0)))
            return V(at(a) - at(b), days)
        if op in "+-" and y in (days, months):
            by = b.col if op == "+" else -b.col
            if x == "time":
                return a.but(F.date_format(F.concat(F.lit("1970-01-01 "), a.col).cast("timestamp") + by, "HH:mm:ss"))
            return a.but((a.col.cast("timestamp") + by).cast(SPARK[x]) if x == "date" else a.col + by)
        raise StaticError("XPTY0004", f"xs:{x} {op} xs:{y}")
    if x in (days, months) or y in (days, months):
        if op in "+-" and x == y:
            return V(a.col + b.col if op == "+" else a.col - b.col, x)
        if op == "*":
            d, n = (a, b) if x in (days, months) else (b, a)
            return V(d.col * n.col, d.type)
        if op == "div" and x == y:
            total = (lambda c: micros(c)) if x == days else (lambda c: F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c))
            return V((total(a.col).cast("decimal(30,6)") / total(b.col).cast("decimal(30,6)")).cast("decimal(38,12)"), "decimal")
        if op == "div":
            return V(a.col / b.col, a.type)
        raise StaticError("XPTY0004", f"xs:{x} {op} xs:{y}")
    p, q, kind = promoted(a, b)
    if kind not in NUMERIC:
        raise StaticError("XPTY0004", f"xs:{x} {op} xs:{y}")
    if op == "div":
        if kind in ("integer", "decimal"):
            return V((p.cast("decimal(28,10)") / q.cast("decimal(28,10)")).cast("decimal(38,12)"), "decimal")
        return V(F.when(q != 0, p / F.nullif(q, F.lit(0).cast(SPARK[kind]))).when(p.isNull() | q.isNull(), None).when(F.isnan(p) | (p == 0), float("nan")).when(p > 0, float("inf")).otherwise(float("-inf")), kind)
    if op == "idiv":
        out = p / q if kind not in ("integer",) else None
        return V(F.call_function("div", p, q) if out is None else F.when(out < 0, F.ceil(out)).otherwise(F.floor(out)).cast("bigint"), "integer")
    if op == "mod":
        return V(p % q, kind)
    out = p + q if op == "+" else p - q if op == "-" else p * q
    return V(out.cast(SPARK[kind]) if kind == "decimal" else out, kind)


COMPARE = {
    "eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y,
}
GENERAL = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
ORDERED = [*NUMERIC, "string", "boolean", "date", "dateTime", "time", "dayTimeDuration", "yearMonthDuration"]


def compare(op: str, a: V, b: V, general: bool = False) -> V:
    """Value comparison of items; with ``general`` untyped operands take the other's type."""
    if "empty" in (a.type, b.type):
        return V(F.lit(None).cast("boolean"), "boolean")
    if members(a.type) or members(b.type):  # what an item is shows at run time; text that is no number equals none
        general, a, b = True, settle(a, "untyped"), settle(b, "untyped")
        sides = [cast(x, "double", safe=True) if x.type == "untyped" and base(y.type) in NUMERIC else x for x, y in ((a, b), (b, a))]
        a, b = sides
    if not general:
        a, b = (v.but(v.col, "string") if v.type == "untyped" else v for v in (a, b))
    elif a.type == b.type == "untyped":
        a, b = a.but(a.col, "string"), b.but(b.col, "string")
    x, y, kind = promoted(a, b)
    p, q = base(a.type), base(b.type)
    if kind not in NUMERIC and p != q and "untyped" not in (p, q):
        raise StaticError("XPTY0004", f"xs:{p} {op} xs:{q}")
    if op not in ("eq", "ne") and kind not in ORDERED:
        raise StaticError("XPTY0004", f"xs:{kind} has no order")
    out = COMPARE[op](x, y)
    if kind in ("double", "float"):  # NaN equals nothing here
        out = F.when(F.isnan(x) | F.isnan(y), F.lit(op == "ne")).otherwise(out)
    return V(out, "boolean")


def general(op: str, a: V, b: V) -> V:
    """Existential comparison of two sequences; never empty."""
    if "empty" in (a.type, b.type):
        return V(F.lit(False), "boolean")
    if not a.many and not b.many:
        return V(F.coalesce(compare(GENERAL[op], a, b, True).col, F.lit(False)), "boolean")
    if a.many and b.many:
        each = F.exists(a.col, lambda x: F.exists(b.col, lambda y: compare(GENERAL[op], V(x, a.type), V(y, b.type), True).col))
    elif a.many:
        each = F.exists(a.col, lambda x: compare(GENERAL[op], V(x, a.type), b, True).col)
    else:
        each = F.exists(b.col, lambda y: compare(GENERAL[op], a, V(y, b.type), True).col)
    return V(F.coalesce(each, F.lit(False)), "boolean")


def array(v: V) -> V:
    """The value as an array of its items."""
    if v.many:
        return v.but(F.coalesce(v.col, F.array().cast(f"array<{SPARK[base(v.type)]}>")) if base(v.type) in SPARK else v.col)
    none = F.filter(F.array(v.col), lambda x: F.lit(False))
    return v.but(F.when(v.col.isNull(), none).otherwise(F.array(v.col)), many=True)


def common(values: list[V]) -> str:
    """The type that all items of a sequence are stored as."""
    kinds = list(dict.fromkeys(base(v.type) for v in values if v.type not in ("empty", "never"))) or ["empty"]
    if len(kinds) == 1:
        return kinds[0]
    if all(k in NUMERIC for k in kinds):
        return max(kinds, key=NUMERIC.index)
    return "string"


def concatenated(values: list[V]) -> V:
    """The comma operator on cell sequences."""
    if not values:
        return V(F.array().cast("array<string>"), "string", True)
    kind = mixture(values)
    if members(kind):
        return V(F.concat(*(all_tagged(v) for v in values if v.type != "empty")), kind, True)
    same = [array(v) if base(v.type) == kind else array(v).but(_each(array(v), kind), kind) for v in values]
    return V(F.concat(*(v.col for v in same)), kind, True)


def _each(v: V, kind: str) -> Column:
    return F.transform(v.col, lambda x: cast(V(x, v.type), kind).col)
