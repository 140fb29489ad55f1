"""Personal data: patterns, and terms that reveal what the patterns found.

Information-theoretic sanitisation. The patterns' matches (addresses, cards, phones) are the protected
entities. A term t of an entity e's texts discloses it as far as knowing t makes e likely: with document frequencies
over the whole corpus, PMI(e; t) / IC(e) is the share of e's information that t gives away; it is 1 if t occurs
nowhere without e. Every entity and every term of its texts is scored, in however few texts they are; few texts say
little, so each term counts as if ``PRIOR`` more texts had it without the entity, which bounds the share from
below. Terms that reach ``DISCLOSE`` are generalised, those that reach ``REMOVE`` are removed. (One text alone
is enough for an entity and a term from about 250 different texts in the table on.)

Terms are looked for in the whole text, and each occurrence of a flagged one in a text that holds the entity is a
span, except where it overlaps an entity.

All of it is DataFrame functions: the texts are read once for the spans, and once for the document frequencies
of terms. Texts with entities are kept aside, and shuffled if the flagged terms are too many to be sent; of the
others only small rows are. Counts are combined before each
shuffle, so an entity, a term or a copied text that a third of all rows have is spread over all tasks. Equal
texts count once for what they support, so copies alone disclose nothing.

Defined results: a null text is the empty text and has no spans; rows are told apart by doc_id and text, and
equal rows each get their row; spans of different kinds may overlap; texts of any length are scanned whole, in time
that grows with their length; a null doc_id is kept; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.shared import Scratch
from xylem.llm.spans import digits, let, listed, luhn, matches, named, placed, replaced

# Fixed patterns; groups are possessive, which matches the same and needs no stack for long runs. A match that starts
# with a run starts at the run's start or where the match before it ended, so no run is walked from each of its places.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
TERMS = "array<struct<start:int,stop:int,share:double,at:int,end:int>>"
#: What a term is.
TERM = r"\p{L}{4,}"
#: Texts that each term is taken to be in besides, without the entity; shares of the entity's information to generalise and to remove at.
PRIOR, DISCLOSE, REMOVE = 2, 0.8, 0.98
#: Keys of copied texts up to which they are sent to all executors.
SENT = 100_000

CHECKS = {
    "email": (EMAIL, "@", None),
    "ip": (IP, ".", lambda v: F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255)),
    "card": (CARD, None, lambda v: F.char_length(digits(v)).between(13, 19) & luhn(digits(v))),
    "phone": (PHONE, "+", lambda v: F.char_length(digits(v)).between(9, 15)),
}


def passing(column: str, check) -> Column:
    return F.filter(column, lambda x: check(x["value"]))


def with_base(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text that isn't null) and an array of spans for each kind."""
    for kind, (pattern, sign, _) in CHECKS.items():
        found = matches(F.col("text"), pattern)
        rows = rows.withColumn(f"m_{kind}", F.when(F.col("text").contains(sign), found).otherwise(F.array().cast("array<string>")) if sign else found)
    for kind, (pattern, _, check) in CHECKS.items():
        rows = rows.withColumn(f"m_{kind}", placed(F.col("text"), pattern, F.col(f"m_{kind}")))
        if check:
            rows = rows.withColumn(f"m_{kind}", passing(f"m_{kind}", check))
    return rows.withColumn("base", F.concat(*(named(k, F.col(f"m_{k}")) for k in KINDS))).drop(*(f"m_{k}" for k in KINDS))


def terms_of(text: Column) -> Column:
    """Hashes of the different terms of ``text``."""
    return F.array_distinct(F.transform(matches(text, TERM), lambda t: F.xxhash64(F.lower(t))))


def texts_with(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, with_term): in how many different texts of ``docs`` (text, tkey) a term is; ``copied`` has the tkey of each text of several rows.

    Texts of one row are counted by term alone before the shuffle, which so carries the vocabulary of each task and
    not each word; only those of several rows are told apart by their key.
    """
    copied = copied.select(F.col("tkey").alias("copy"))
    rows = docs.join(F.broadcast(copied) if copied.count() <= SENT else copied, F.col("tkey") == F.col("copy"), "left")
    each = rows.select("copy", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("copy", "term").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("with_term"))


def disclosures(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """(tkey, term, share) of the terms that disclose an entity of their text; all counts are of different texts.

    A term of more texts than ``most`` reaches DISCLOSE with no entity of its text, whatever they have in common, so
    only rarer ones are paired with entities. Entities of one text alone have the same counts with each of its terms:
    they stand for one.
    """
    texts = scratch.keep(spans.groupBy("tkey").agg(F.count(F.lit(1)).alias("n")), "texts")
    total = float(max(texts.count(), 1))
    some = spans.where(F.size("base") > 0)
    alone = some.select("tkey", F.explode("base").alias("x")).select("tkey", F.xxhash64(F.col("x.kind"), F.lower("x.value")).alias("entity")).distinct()
    counts = alone.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")).where(F.col("with_entity") < total)
    of_text = alone.join(counts, "entity").select("tkey", F.when(F.col("with_entity") == 1, F.col("tkey")).otherwise(F.col("entity")).alias("entity"), "with_entity")
    entities = scratch.keep(of_text.distinct(), "entities")
    most = lambda n: F.pow(n, F.lit(DISCLOSE)) * total ** (1 - DISCLOSE) * (1 + 1e-9) - PRIOR
    terms = some.select("tkey", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    top = entities.groupBy("tkey").agg(F.max("with_entity").alias("top"))
    seen = texts_with(docs, texts.where("n > 1"))
    rare = scratch.keep(terms.join(top, "tkey").join(seen, "term").where(F.col("with_term") <= most(F.col("top"))).select("tkey", "term", "with_term"), "rare")
    near = scratch.keep(rare.join(entities, "tkey").where(F.col("with_term") <= most(F.col("with_entity"))), "near")
    both = near.groupBy("entity", "term", "with_entity", "with_term").agg(F.count(F.lit(1)).alias("both"))
    inform = F.log2(total / F.col("with_entity"))
    share = F.log2(F.col("both") * total / (F.col("with_entity") * (F.col("with_term") + PRIOR))) / inform
    flagged = both.select("entity", "term", share.alias("share")).where(F.col("share") >= DISCLOSE)
    return near.join(flagged, ["entity", "term"]).groupBy("tkey", "term").agg(F.max("share").alias("share"))


def terms_in(text: Column, found: Column, hashes: Column, shares: Column) -> Column:
    """(start, stop, share, and bytes at to end) of those of the ``found`` terms whose hash is one of ``hashes``."""
    one = lambda x, share: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), share[F.xxhash64(F.lower(x["value"]))].alias("share"), x["at"].alias("at"), (x["at"] + F.octet_length(x["value"])).alias("end"))
    scored = let(F.map_from_arrays(hashes, shares), lambda share: F.transform(placed(text, TERM, found), lambda x: one(x, share)))
    return F.filter(scored, lambda x: x["share"].isNotNull())


def personal_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, tkey (hash of the text), base spans and disclosing terms of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = with_base(rows.withColumn("tkey", F.xxhash64("text")))
    spans = scratch.keep(spans.select("doc_id", "tkey", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "spans")
    flagged = disclosures(rows.select("text", F.xxhash64("text").alias("tkey")), spans, scratch)
    lists = flagged.groupBy("tkey").agg(F.array_sort(F.collect_list(F.struct("term", "share"))).alias("flags"))
    lists = scratch.keep(lists.select(F.col("tkey").alias("t"), F.col("flags.term").alias("hashes"), F.col("flags.share").alias("shares")), "flagged")
    none = F.array().cast(TERMS)
    some = spans.where(F.size("base") > 0).join(lists, F.col("tkey") == F.col("t"), "left").withColumn("found", matches(F.col("text"), TERM))
    at = F.when(F.col("t").isNotNull(), terms_in(F.col("text"), F.col("found"), F.col("hashes"), F.col("shares"))).otherwise(none)
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
    some = some.withColumn("terms", at).select("doc_id", "tkey", "base", F.filter("terms", free).alias("terms"))
    return spans.where(F.size("base") == 0).select("doc_id", "tkey", "base", none.alias("terms")).unionByName(some)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with each entity replaced by its kind, disclosing terms generalised or removed, and n_chars anew."""
    scratch = Scratch(docs.sparkSession, "personal")
    found = personal_spans(docs, scratch)
    terms = F.transform("terms", lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end"), F.when(x["share"] >= REMOVE, "").otherwise("<TERM>").alias("put")))
    base = F.transform("base", lambda x: F.struct(x["at"].alias("at"), (x["at"] + F.octet_length(x["value"])).alias("end"), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("put")))
    edits = scratch.keep(found.where((F.size("base") > 0) | (F.size("terms") > 0)).select(F.col("doc_id").alias("_edit_id"), F.col("tkey").alias("_edit_key"), F.array_sort(F.concat(base, terms)).alias("_edits")).distinct(), "edits")
    scratch.drop(but=[edits])
    # texts without any entity stay where they are: terms are only looked for in texts with one
    body = F.coalesce("text", F.lit(""))
    some = F.rlike(body, F.lit(EMAIL)) | F.rlike(body, F.lit(IP)) | F.rlike(body, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")) | F.rlike(body, F.lit(PHONE))
    touched = docs.where(some).join(edits, F.col("doc_id").eqNullSafe(F.col("_edit_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_edit_key")), "left")
    put = touched.withColumn("_put", F.when(F.col("_edits").isNotNull(), replaced(F.col("text"), F.col("_edits"))))
    out = {"text": F.coalesce("_put", "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_put").isNull(), F.col("n_chars")).otherwise(F.char_length("_put")).cast(docs.schema["n_chars"].dataType)
    return docs.where(~some).unionByName(put.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns)))


def op3_personal_data(spark, sf_dir) -> DataFrame:
    scratch = Scratch(spark, "personal")
    found = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    told = lambda spans, kind: F.transform(spans, lambda x: F.struct((kind if kind is not None else x["kind"]).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    result = scratch.keep(found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat(told("base", None), told("terms", F.lit("term")))).alias("spans")), "result")
    scratch.drop(but=[result])
    return result
