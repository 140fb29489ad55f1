"""Secret scans: patterns, and credentials that are told by their parts.

Multipart credential linking. Beside the plain patterns there are weak candidates: user names, mail addresses and
short-lived key ids (identifiers), long mixed strings (secrets) and addresses of services and machines (endpoints).
Alone they mean nothing. Each is taken with an interval of ``SCOPE`` code points on either side, and intervals are joined with
the other parts of the same text; a weak candidate is reported only where complementary parts lie within its
scope: an identifier with a secret, a secret with an identifier or an endpoint, an endpoint with both.

The interval join is an equi-join on text and bucket of ``SCOPE`` code points, so it compares neighbours only,
and what it makes grows with the length of a text. All of it is DataFrame functions.

Defined results: a null text is the empty text and has no spans; rows are told apart by doc_id and text, and
equal rows each get their row; weak candidates that overlap a plain match are part of it; texts of any length are
scanned whole, in time that grows with their length; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.shared import Scratch
from xylem.llm.spans import listed, matches, named, placed

# Fixed patterns. Runs of 16 and 32 characters are the same runs that are found without a least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = ["assign", "access", "hex"]
# Weak candidates.
WEAK = {
    "identifier": r"""\b(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}+|\b(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}+""",
    "key": r"[A-Za-z0-9+/_-]{20,}+={0,2}",
    "mail": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "host": r"(?:\G|(?<![0-9.]))[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}+(?::[0-9]{1,5}+)?+(?!\.?[0-9])",
    "endpoint": r"""\b(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]++""",
}
ROLE = {"access": "identifier", "assign": "key", "hex": "key", "identifier": "identifier", "mail": "identifier", "key": "key", "host": "endpoint", "endpoint": "endpoint"}
#: What a text must contain to have a candidate of a kind.
SIGNS = {"access": "AKIA", "endpoint": "://", "mail": "@", "host": "."}
#: Code points on either side of a candidate that are its scope.
SCOPE = 200


def with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text that isn't null), plain spans in ``base`` by start and weak ones in ``weak``."""
    text = F.col("text")
    every = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | WEAK
    for kind, pattern in every.items():
        found = matches(text, pattern)
        if kind in SIGNS:
            found = F.when(text.contains(SIGNS[kind]), found).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(f"m_{kind}", found)
    rows = rows.withColumn("m_key", F.filter("m_key", lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]")))
    for kind, pattern in every.items():
        if kind != "key":
            rows = rows.withColumn(f"m_{kind}", placed(text, pattern, F.col(f"m_{kind}")))
    # long strings are many and few are mixed: they are placed only where some are
    rows = rows.withColumn("m_key", placed(text, WEAK["key"], F.when(F.size("m_key") > 0, matches(text, WEAK["key"])).otherwise(F.array().cast("array<string>"))))
    rows = rows.withColumn("m_key", F.filter("m_key", lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]")))
    rows = rows.withColumn("m_assign", F.filter("m_assign", lambda x: F.char_length(F.regexp_replace(x["value"], VALUE, "")) >= 8))
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).otherwise(2)
    ordered = F.array_sort(F.transform(F.concat(*(named(k, F.col(f"m_{k}")) for k in BASE)), lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    rows = rows.withColumn("base", F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))))
    weak = F.transform(F.concat(*(named(k, F.col(f"m_{k}")) for k in WEAK)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    rows = rows.withColumn("weak", weak).withColumn("weak", F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"]))))
    return rows.drop(*(f"m_{k}" for k in every))


def by_start(*spans: str) -> Column:
    """All spans by start, then kind as listed: plain ones first."""
    order = F.create_map(*(F.lit(x) for k, name in enumerate([*BASE, *WEAK]) for x in (name, k)))
    keyed = F.transform(F.concat(*spans), lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))


def linked(parts: DataFrame) -> DataFrame:
    """(d, t, extra): the weak candidates of each text that complementary parts bear out, by start."""
    role = F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair))
    row = lambda column, weak: parts.where(F.size("weak") > 0).select("doc_id", "tkey", F.explode(column).alias("x")).select("doc_id", "tkey", "x.*", F.lit(weak).alias("own"))
    one = row("weak", True).unionByName(row("base", False)).distinct().withColumn("role", role[F.col("kind")])
    bucket = F.floor(F.col("start") / SCOPE)
    left = one.where("own").withColumn("bucket", F.explode(F.sequence(bucket - 1, F.floor(F.col("stop") / SCOPE) + 1))).alias("x")
    right = one.withColumn("bucket", F.explode(F.sequence(bucket, F.floor(F.col("stop") / SCOPE)))).alias("y")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.tkey") == F.col("y.tkey")) & (F.col("x.bucket") == F.col("y.bucket"))
    close = (F.col("y.start") < F.col("x.stop") + SCOPE) & (F.col("x.start") < F.col("y.stop") + SCOPE)
    has = lambda k: F.max(F.col("y.role") == k)
    seen = left.join(right, same & close & (F.col("x.role") != F.col("y.role"))).groupBy("x.doc_id", "x.tkey", "x.kind", "x.start", "x.stop").agg(has("identifier").alias("i"), has("key").alias("k"), has("endpoint").alias("e"))
    own = role[F.col("kind")]
    good = seen.where(F.when(own == "identifier", F.col("k")).when(own == "key", F.col("i") | F.col("e")).otherwise(F.col("i") & F.col("k")))
    return good.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("extra"))


def secret_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, tkey (hash of the text), plain spans ``base`` and linked weak ones ``extra`` of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    parts = scratch.keep(with_parts(rows).select("doc_id", "tkey", "base", "weak"), "parts")
    more = linked(parts)
    joined = parts.drop("weak").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left").drop("d", "t")
    extra = F.coalesce("extra", F.array().cast("array<struct<start:int,kind:string,stop:int>>"))
    return joined.withColumn("extra", F.transform(extra, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))))


def op5_secrets(spark, sf_dir) -> DataFrame:
    scratch = Scratch(spark, "secrets")
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    result = scratch.keep(found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(by_start("base", "extra")).alias("spans")), "result")
    scratch.drop(but=[result])
    return result
