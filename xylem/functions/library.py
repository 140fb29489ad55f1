"""Built-in functions as column builders, by family. ``FUNCTIONS[name] = (least args, most args, builder)``.

A builder gets one :class:`V` for each argument and returns a V, using built-in Spark functions (Arrow UDFs only
for Unicode normalisation and URI resolution). Functions that need the focus, a relation or the catalog have no
builder here; the compiler has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from xylem.functions.values import NUMERIC, SPARK, StaticError, V, array, base, cast, common, compare, concatenated, ebv, lit, promoted, string, text

CODEPOINT = "http://www.w3.org/2005/xpath-functions/collation/codepoint"
MANY = 10_000
FUNCTIONS: dict[str, tuple[int, int, Callable[..., V] | None]] = {}


def function(name: str, least: int, most: int | None = None):
    def put(build):
        for n in name.split():
            FUNCTIONS[n] = (least, least if most is None else most, build)
        return build

    return put


def no_collation(args: tuple[V, ...]) -> None:
    """Only the codepoint collation exists; a collation argument is accepted and ignored."""


def number(v: V) -> V:
    """An item as a number: untyped ones as xs:double."""
    if base(v.type) in NUMERIC:
        return v
    if v.type == "untyped":
        return cast(v, "double")
    raise StaticError("XPTY0004", f"a number is needed, not xs:{v.type}")


# ---- aggregates over cell sequences (relations are aggregated by the compiler)


@function("count", 1)
def count(v):
    return V((F.size(array(v).col) if v.many else v.col.isNotNull().cast("int")).cast("bigint"), "integer")


def numbers(v: V) -> V:
    v = array(v)
    if v.type == "empty":
        return v.but(F.array().cast("array<bigint>"), "integer")
    return v.but(F.transform(v.col, lambda x: cast(V(x, v.type), "double").col), "double") if v.type == "untyped" else v


@function("sum", 1, 2)
def sum_(v, zero=None):
    v = numbers(v)
    kind = base(v.type)
    if kind not in [*NUMERIC, "dayTimeDuration", "yearMonthDuration"]:
        raise StaticError("FORG0006", f"no sum of xs:{v.type}")
    start = F.lit(0).cast(SPARK[kind]) if kind in NUMERIC else F.make_dt_interval() if kind == "dayTimeDuration" else F.make_ym_interval()
    total = F.aggregate(v.col, start, lambda a, x: (a + x).cast(SPARK[kind]) if kind in NUMERIC else a + x)
    empty = cast(zero, kind).col if zero is not None else start
    return V(F.when(F.size(v.col) == 0, empty).otherwise(total), kind)


@function("avg", 1)
def avg(v):
    v = numbers(v)
    total = sum_(v)
    if base(v.type) in ("dayTimeDuration", "yearMonthDuration"):
        return V(F.when(F.size(v.col) > 0, total.col / F.nullif(F.size(v.col), F.lit(0))), v.type)
    kind = "decimal" if base(v.type) in ("integer", "decimal") else "double"
    return V(F.when(F.size(v.col) > 0, (total.col.cast(SPARK[kind] if kind == "double" else "decimal(28,10)") / F.nullif(F.size(v.col), F.lit(0))).cast(SPARK[kind])), kind)


def extreme(v: V, pick) -> V:
    v = numbers(v)
    out = pick(v.col)
    if base(v.type) in ("double", "float"):
        out = F.when(F.exists(v.col, F.isnan), F.lit(float("nan"))).otherwise(out)
    return V(F.when(F.size(v.col) > 0, out), v.type)


@function("max", 1, 2)
def max_(v, *collation):
    return extreme(v, F.array_max)


@function("min", 1, 2)
def min_(v, *collation):
    return extreme(v, F.array_min)


# ---- sequences


@function("empty", 1)
def empty(v):
    return V(F.size(array(v).col) == 0 if v.many else v.col.isNull(), "boolean")


@function("exists", 1)
def exists(v):
    return V(~empty(v).col, "boolean")


@function("distinct-values", 1, 2)
def distinct_values(v, *collation):
    return array(v).but(F.array_sort(F.array_distinct(array(v).col)))


@function("index-of", 2, 3)
def index_of(v, item, *collation):
    v = array(v)
    places = F.filter(F.sequence(F.lit(0), F.size(v.col)), lambda i: F.coalesce(compare("eq", V(F.get(v.col, i), v.type), item, True).col, F.lit(False)))
    return V(F.transform(places, lambda i: (i + 1).cast("bigint")), "integer", True)


@function("insert-before", 3)
def insert_before(v, at, more):
    both = concatenated([v, more])
    v, more = array(v), array(more)
    k = F.greatest(F.least(at.col, F.size(v.col) + 1), F.lit(1)).cast("int")
    head, tail = F.slice(both.col, F.lit(1), k - 1), F.slice(both.col, k, F.greatest(F.size(v.col) - k + 1, F.lit(0)))
    return both.but(F.concat(head, F.slice(both.col, F.size(v.col) + 1, F.size(more.col)), tail))


@function("remove", 2)
def remove(v, at):
    return array(v).but(F.filter(array(v).col, lambda x, i: i + 1 != at.col))


@function("reverse", 1)
def reverse(v):
    return array(v).but(F.reverse(array(v).col))


def half_up(c: Column) -> Column:
    return F.floor(c.cast("double") + 0.5).cast("bigint")


@function("subsequence", 2, 3)
def subsequence(v, start, length=None):
    v, first = array(v), half_up(start.col)
    last = F.lit(2**31) if length is None else first + half_up(length.col)
    return v.but(F.filter(v.col, lambda x, i: (i + 1 >= first) & (i + 1 < last)))


@function("item-at", 2)
def item_at(v, at):
    v = array(v)
    far = F.raise_error(F.lit("SE1003: item-at: no such position"))
    return V(F.when(F.size(v.col) == 0, None).when((at.col < 1) | (at.col > F.size(v.col)), far).otherwise(F.get(v.col, (at.col - 1).cast("int"))), v.type)


def sized(name: str, code: str, low: int, high: int | None):
    def build(v):
        n = count(v).col
        ok = (n >= low) if high is None else (n >= low) & (n <= high)
        fail = F.raise_error(F.lit(f"{code}: {name}"))
        if high == 1:
            one = F.get(array(v).col, F.lit(0)) if v.many else v.col
            return V(F.when(ok, one).otherwise(fail), v.type)
        return array(v).but(F.when(ok, array(v).col).otherwise(fail))

    FUNCTIONS[name] = (1, 1, build)


sized("zero-or-one", "FORG0003", 0, 1)
sized("one-or-more", "FORG0004", 1, None)
sized("exactly-one", "FORG0005", 1, 1)


@function("unordered", 1)
def unordered(v):
    return v


@function("deep-equal", 2, 3)
def deep_equal(a, b, *collation):
    if not a.many and not b.many:
        x, y, _ = promoted(a, b)
        return V(x.eqNullSafe(y), "boolean")  # NaN is deep-equal to NaN, as columns have it
    both = common([a, b])
    x, y = concatenated([a]), concatenated([b])
    return V((F.transform(x.col, lambda i: cast(V(i, x.type), both).col)).eqNullSafe(F.transform(y.col, lambda i: cast(V(i, y.type), both).col)), "boolean")


# ---- strings


@function("codepoint-equal", 2)
def codepoint_equal(a, b):
    return V(string(a) == string(b), "boolean")


@function("compare", 2, 3)
def compare_(a, b, *collation):
    x, y = string(a), string(b)
    return V(F.when(x.isNull() | y.isNull(), None).when(x < y, -1).when(x == y, 0).otherwise(1).cast("bigint"), "integer")


@function("concat", 2, MANY)
def concat(*args):
    return V(F.concat(*(text(a) for a in args)), "string")


@function("contains", 2, 3)
def contains(a, b, *collation):
    return V(F.contains(text(a), text(b)), "boolean")


@function("starts-with", 2, 3)
def starts_with(a, b, *collation):
    return V(F.startswith(text(a), text(b)), "boolean")


@function("ends-with", 2, 3)
def ends_with(a, b, *collation):
    return V(F.endswith(text(a), text(b)), "boolean")


@function("default-collation", 0)
def default_collation():
    return lit(CODEPOINT)


@function("lower-case", 1)
def lower_case(a):
    return V(F.lower(text(a)), "string")


@function("upper-case", 1)
def upper_case(a):
    return V(F.upper(text(a)), "string")


@function("normalize-space", 0, 1)
def normalize_space(a):
    return V(F.trim(F.regexp_replace(text(a), r"[ \t\r\n]+", " ")), "string")


@function("string-length", 0, 1)
def string_length(a):
    return V(F.char_length(text(a)).cast("bigint"), "integer")


@function("string-join", 2)
def string_join(v, sep):
    v = array(v)
    return V(F.call_function("array_join", F.transform(v.col, lambda x: string(V(x, v.type))), text(sep)), "string")


@function("string-to-codepoints", 1)
def string_to_codepoints(a):
    chars = F.filter(F.split(text(a), ""), lambda c: c != "")
    return V(F.transform(chars, lambda c: F.ascii(c).cast("bigint")), "integer", True)


@function("codepoints-to-string", 1)
def codepoints_to_string(v):
    v = array(v)
    return V(F.array_join(F.transform(v.col, lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0")), "UTF-32")), ""), "string")


@function("substring", 2, 3)
def substring(a, start, length=None):
    first = half_up(start.col)
    low = F.greatest(first, F.lit(1)).cast("int")
    if length is None:
        return V(F.substring(text(a), low, F.lit(2**31 - 1)), "string")
    last = first + half_up(length.col)
    return V(F.substring(text(a), low, F.greatest(last - low, F.lit(0)).cast("int")), "string")


@function("substring-before", 2, 3)
def substring_before(a, b, *collation):
    at = F.call_function("instr", text(a), text(b))
    return V(F.when((at > 0) & (text(b) != ""), F.substring(text(a), F.lit(1), at - 1)).otherwise(""), "string")


@function("substring-after", 2, 3)
def substring_after(a, b, *collation):
    at = F.call_function("instr", text(a), text(b))
    return V(F.when(at > 0, F.substring(text(a), at + F.char_length(text(b)), F.lit(2**31 - 1))).otherwise(""), "string")


@function("translate", 3)
def translate(a, old, new):
    return V(F.call_function("translate", text(a), text(old), text(new)), "string")


def pattern(p: V, flags: V | None) -> Column:
    if flags is None:
        return text(p)
    return F.when(text(flags) == "", text(p)).otherwise(F.concat(F.lit("(?"), F.regexp_replace(text(flags), "[^smix]", ""), F.lit(")"), text(p)))


@function("matches", 2, 3)
def matches(a, p, flags=None):
    return V(F.rlike(text(a), pattern(p, flags)), "boolean")


def fixed(p: Column) -> Column:
    """The pattern, unless it matches the empty string."""
    return F.when(F.rlike(F.lit(""), p), F.raise_error(F.lit("FORX0003: pattern matches the empty string"))).otherwise(p)


@function("replace", 3, 4)
def replace(a, p, new, flags=None):
    return V(F.regexp_replace(text(a), fixed(pattern(p, flags)), text(new)), "string")


@function("tokenize", 2, 3)
def tokenize(a, p, flags=None):
    return V(F.when(text(a) == "", F.array().cast("array<string>")).otherwise(F.split(text(a), fixed(pattern(p, flags)), -1)), "string", True)


@function("normalize-unicode", 1, 2)
def normalize_unicode(a, form=None):
    @F.pandas_udf("string")
    def run(s, k):
        import unicodedata

        return s.combine(k, lambda x, f: unicodedata.normalize(f.strip().upper() or "NFC", x) if f.strip() else x)

    return V(run(text(a), text(form) if form is not None else F.lit("NFC")), "string")


# ---- numbers


@function("abs", 1)
def abs_(v):
    v = number(v)
    return v.but(F.abs(v.col))


def narrowed(v: V, out: Column) -> V:
    return v.but(out.cast(SPARK[base(v.type)]))


@function("ceiling", 1)
def ceiling(v):
    v = number(v)
    return narrowed(v, F.when(F.isnan(v.col.cast("double")), v.col).otherwise(F.ceil(v.col).cast(SPARK[base(v.type)])))


@function("floor", 1)
def floor(v):
    v = number(v)
    return narrowed(v, F.when(F.isnan(v.col.cast("double")), v.col).otherwise(F.floor(v.col).cast(SPARK[base(v.type)])))


@function("round", 1)
def round_(v):
    v = number(v)
    up = v.col + (F.lit(0.5) if base(v.type) in ("double", "float") else F.lit(0.5).cast("decimal(2,1)"))
    return v if base(v.type) == "integer" else narrowed(v, F.floor(up))


@function("round-half-to-even", 1, 2)
def round_half_to_even(v, places=None):
    v = number(v)
    return narrowed(v, F.bround(v.col, places.col.cast("int") if places is not None else 0))


@function("number", 0, 1)
def number_(v):
    out = v.col.cast("double") if base(v.type) in [*NUMERIC, "boolean"] else string(v).try_cast("double")
    return V(F.coalesce(out, F.lit(float("nan"))), "double")


# ---- booleans


@function("true", 0)
def true():
    return lit(True)


@function("false", 0)
def false():
    return lit(False)


@function("boolean", 1)
def boolean(v):
    return V(ebv(v), "boolean")


@function("not", 1)
def not_(v):
    return V(~ebv(v), "boolean")


# ---- dates, times, durations


@function("current-date", 0)
def current_date():
    return V(F.current_date(), "date", tz=F.lit(0))


@function("current-dateTime", 0)
def current_date_time():
    return V(F.current_timestamp(), "dateTime", tz=F.lit(0))


@function("current-time", 0)
def current_time():
    return V(F.date_format(F.current_timestamp(), "HH:mm:ss"), "time", tz=F.lit(0))


def minutes_interval(c: Column) -> Column:
    return F.when(c.isNotNull(), F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(c, F.lit(0))))


@function("implicit-timezone", 0)
def implicit_timezone():
    return V(minutes_interval(F.lit(0)), "dayTimeDuration")


def whole_minutes(v: V) -> Column:
    c = v.col
    return (F.extract(F.lit("DAY"), c) * 1440 + F.extract(F.lit("HOUR"), c) * 60 + F.extract(F.lit("MINUTE"), c)).cast("int")


@function("adjust-dateTime-to-timezone adjust-date-to-timezone adjust-time-to-timezone", 1, 2)
def adjust(v, to=None):
    new = F.lit(0) if to is None else whole_minutes(to)
    old = v.tz if v.tz is not None else F.lit(None).cast("int")
    if v.type == "time":
        moved = F.date_format(F.concat(F.lit("1970-01-02 "), v.col).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(new - old, F.lit(0))), "HH:mm:ss")
        return V(moved, "time", tz=new)
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(new - old, F.lit(0)))
    moved = v.col.cast("timestamp") + shift
    return V(moved.cast(SPARK[v.type]), v.type, tz=new)


@function("dateTime", 2)
def date_time(d, t):
    made = F.concat(d.col.cast("string"), F.lit(" "), t.col.cast("string")).cast("timestamp")
    tz = d.tz if t.tz is None else t.tz if d.tz is None else F.when(d.tz != t.tz, F.raise_error(F.lit("FORG0008: zones differ")).cast("int")).otherwise(F.coalesce(d.tz, t.tz))
    return V(made, "dateTime", tz=tz)


for _kind in ("date", "dateTime"):
    for _part, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth)):
        FUNCTIONS[f"{_part}-from-{_kind}"] = (1, 1, lambda v, f=_f: V(f(v.col).cast("bigint"), "integer"))


def clock(v: V) -> Column:
    return v.col if v.type == "dateTime" else F.concat(F.lit("1970-01-01 "), v.col).cast("timestamp")


for _kind in ("dateTime", "time"):
    FUNCTIONS[f"hours-from-{_kind}"] = (1, 1, lambda v: V(F.hour(clock(v)).cast("bigint"), "integer"))
    FUNCTIONS[f"minutes-from-{_kind}"] = (1, 1, lambda v: V(F.minute(clock(v)).cast("bigint"), "integer"))
    FUNCTIONS[f"seconds-from-{_kind}"] = (1, 1, lambda v: V(F.extract(F.lit("SECOND"), clock(v)).cast("decimal(38,12)"), "decimal"))
for _part in ("days", "hours", "minutes", "seconds", "years", "months"):
    _kind = "decimal" if _part == "seconds" else "integer"
    FUNCTIONS[f"{_part}-from-duration"] = (1, 1, lambda v, p=_part[:-1].upper(), k=_kind: V(F.when(v.col.isNotNull(), F.extract(F.lit(p), v.col) if (p in ("YEAR", "MONTH")) == (v.type == "yearMonthDuration") else F.lit(0)).cast(SPARK[k]), k))
for _kind in ("date", "dateTime", "time"):
    FUNCTIONS[f"timezone-from-{_kind}"] = (1, 1, lambda v: V(minutes_interval(v.tz if v.tz is not None else F.lit(None).cast("int")), "dayTimeDuration"))


# ---- names


@function("QName", 2)
def qname(uri, name):
    cut = F.split(text(name), ":")
    return V(F.struct(text(uri).alias("ns"), F.when(F.size(cut) > 1, cut[0]).otherwise("").alias("prefix"), F.element_at(cut, -1).alias("local")), "QName")


@function("local-name-from-QName", 1)
def local_name_from(v):
    return V(v.col["local"], "NCName")


@function("prefix-from-QName", 1)
def prefix_from(v):
    return V(F.nullif(v.col["prefix"], F.lit("")), "NCName")


@function("namespace-uri-from-QName", 1)
def uri_from(v):
    return V(v.col["ns"], "anyURI")


# ---- URIs


@function("encode-for-uri", 1)
def encode_for_uri(a):
    out = F.url_encode(text(a))
    for old, new in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, old, new)
    return V(out, "string")


def percent(a: V, kept: str) -> V:
    chars = F.filter(F.split(text(a), ""), lambda c: c != "")
    return V(F.array_join(F.transform(chars, lambda c: F.when(c.rlike(kept), c).otherwise(F.regexp_replace(F.url_encode(c), r"\+", "%20"))), ""), "string")


@function("escape-html-uri", 1)
def escape_html_uri(a):
    return percent(a, r"^[\x20-\x7E]$")


@function("iri-to-uri", 1)
def iri_to_uri(a):
    return percent(a, r"""^[!#$%&'()*+,\-./0-9:;=?@A-Z\[\]_a-z~]$""")


@function("resolve-uri", 1, 2)
def resolve_uri(a, against=None):
    @F.pandas_udf("string")
    def run(s, k):
        from urllib.parse import urljoin

        return s.combine(k, lambda x, y: None if x is None else urljoin(y, x))

    return V(run(string(a), text(against)), "anyURI")


# ---- digests


def digest(name: str, make) -> None:
    FUNCTIONS[f"crypto:{name}"] = (1, 1, lambda v: V(F.upper(make(octets(v))), "string"))


def octets(v: V) -> Column:
    return v.col if base(v.type) in ("base64Binary", "hexBinary") else text(v).cast("binary")


for _name, _bits in (("sha224", 224), ("sha256", 256), ("sha384", 384), ("sha512", 512)):
    digest(_name, lambda c, b=_bits: F.sha2(c, b))
digest("sha1", F.sha1)
digest("md5", F.md5)


@function("crypto:digest", 2)
def any_digest(algorithm, v):
    name = F.lower(F.trim(text(algorithm)))
    out = F.when(name == "md5", F.md5(octets(v))).when(name == "sha1", F.sha1(octets(v)))
    for bits in (224, 256, 384, 512):
        out = out.when(name == f"sha{bits}", F.sha2(octets(v), bits))
    return V(F.upper(out.otherwise(F.raise_error(F.lit("SE5052: unknown digest")))), "string")


# ---- diagnostics


@function("error", 0, 3)
def error(*args):
    code = text(args[0]) if args else F.lit("FOER0000")
    return V(F.raise_error(F.concat_ws(": ", code, *(text(a) for a in args[1:2]))), "never")


@function("trace", 2)
def trace(v, label):
    return v


#: Functions of the registry that the compiler or the store answers (focus, relations, nodes, catalog, indexes, full text, SQL, engine).
CONTEXTUAL = {
    "last": (0, 0), "position": (0, 0), "lang": (1, 2), "data": (1, 1), "filter_entry_level": (1, 1), "id": (1, 2), "idref": (1, 2), "is_ancestor": (2, 2), "local-name": (0, 1), "name": (0, 1),
    "namespace-uri": (0, 1), "nilled": (1, 1), "node-name": (1, 1), "root": (0, 1), "string": (0, 1), "string-value": (1, 1), "typed-value": (1, 1), "in-scope-prefixes": (1, 1),
    "namespace-uri-for-prefix": (2, 2), "resolve-QName": (2, 2), "base-uri": (0, 1), "document-uri": (1, 1), "static-base-uri": (0, 0), "collection": (1, 1), "doc": (1, 2), "doc-available": (1, 2),
    "col-available": (1, 1), "document": (1, 2), "index-scan": (3, 3), "index-keys": (1, 1), "index-scan-between": (4, 4), "fthighlight": (2, 3), "fthighlight-blocks": (2, 3), "ftindex-scan": (2, 3),
    "ftindex-dict": (1, 2), "ftscan": (3, 4), "ftwindex-scan": (2, 4), "sql:close": (1, 1), "sql:commit": (1, 1), "sql:connect": (1, 4), "sql:exec-update": (2, MANY), "sql:execute": (2, MANY),
    "sql:prepare": (2, 3), "sql:rollback": (1, 1), "se:checkpoint": (0, 0), "se:get-property": (1, 1), "test": (1, 1),
}
for _name, (_least, _most) in CONTEXTUAL.items():
    FUNCTIONS[_name] = (_least, _most, None)
