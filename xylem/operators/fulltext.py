"""Full-text search: a postings table, a small query language, scores and highlighting.

Query language: words, ``word*`` (beginning), ``"a phrase"``, ``OR``, ``( )``, ``word~`` (stem), ``:N`` (boost) and
``tag CONTAINS word``; words side by side must all occur. There is no NOT.

Score of a document: the sum over query words of sqrt(occurrences * boost) / sqrt(words in it) * idf**2 with
idf = 1 + ln(N / (df + 1)), in real division.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.functions.values import StaticError
from xylem.operators.stemming import stemmer

#: What separates words.
BREAK = r"[^\p{L}\p{N}]+"
TYPES = ["xml", "xml-hl", "string-value", "delimited-value", "customized-value"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


@dataclass(frozen=True)
class Options:
    """Options of an index: the language of stems ("" for none), and whether words are kept beside them."""

    language: str = ""
    both: bool = False

    @staticmethod
    def of(text: str) -> Options:
        found = {}
        for part in filter(None, (x.strip() for x in text.split(","))):
            name, _, value = part.partition("=")
            if name not in ("backend", "native", "stemming", "stemtype") or name in found or name == "stemtype" and value != "both" or name == "backend" and value != "native":
                raise StaticError("SE3022", f"bad options for full-text index: {part}")
            found[name] = value
        if found.get("stemming"):
            stemmer(found["stemming"])
        return Options(found.get("stemming", ""), "stemtype" in found)

    def column(self, stemmed: bool) -> str:
        """The column of postings that a query word is looked up in."""
        return "stem" if self.language and (stemmed or not self.both) else "term"

    def word(self, word: str, stemmed: bool) -> str:
        return stemmer(self.language)(word) if self.column(stemmed) == "stem" else word


def stems(language: str, column: str) -> Column:
    rule = stemmer(language)
    return F.pandas_udf(lambda words: words.map(rule), "string", F.PandasUDFType.SCALAR)(column)


def postings(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, term, stem, pos, path, length) of ``docs`` (doc_id, and text or parts: array of (path, text)); ``pos`` counts the document's words."""
    if "parts" not in docs.columns:
        docs = docs.select("doc_id", F.array(F.struct(F.lit("").alias("path"), F.col("text").alias("text"))).alias("parts"))
    words = F.flatten(F.transform("parts", lambda p: F.transform(words_of(F.coalesce(p["text"], F.lit(""))), lambda w: F.struct(p["path"].alias("path"), w.alias("term")))))
    rows = docs.select("doc_id", words.alias("words")).select("doc_id", "words", F.size("words").alias("length"))  # else each word's row has all words beside it
    out = rows.select("doc_id", "length", F.posexplode("words").alias("pos", "w")).select("doc_id", F.col("w.term").alias("term"), "pos", F.col("w.path").alias("path"), "length")
    return out.withColumn("stem", stems(options.language, "term") if options.language else F.lit(None).cast("string"))


@dataclass
class Want:
    """A node of a parsed query: word, phrase, all, any or within."""

    kind: str
    parts: list = field(default_factory=list)
    word: str = ""
    stemmed: bool = False
    boost: float = 1.0
    tag: str = ""


_TOKEN = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"|(OR)\b|(CONTAINS)\b|(~?[\w]+\*?~?(?::\d+)?))')


def parse_query(text: str) -> Want:
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise StaticError("SE3022", f"full-text query: {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    k = 0

    def any_of() -> Want:
        nonlocal k
        parts = [all_of()]
        while k < len(tokens) and tokens[k][4]:
            k += 1
            parts.append(all_of())
        return parts[0] if len(parts) == 1 else Want("any", parts)

    def all_of() -> Want:
        nonlocal k
        parts = []
        while k < len(tokens) and not tokens[k][2] and not tokens[k][4]:
            m = tokens[k]
            k += 1
            if m[1]:
                parts.append(any_of())
                k += 1
            elif m[3] is not None:
                parts.append(Want("phrase", [w for w in re.split(r"[\W_]+", m[3].lower()) if w]))
            elif m[5]:
                tag, inner = parts.pop().word, all_one()
                parts.append(Want("within", [inner], tag=tag))
            else:
                parts.append(word(m[6]))
        return parts[0] if len(parts) == 1 else Want("all", parts)

    def all_one() -> Want:
        nonlocal k
        m = tokens[k]
        k += 1
        return Want("phrase", m[3].lower().split()) if m[3] is not None else word(m[6])

    def word(raw: str) -> Want:
        raw, _, boost = raw.partition(":")
        return Want("word", word=raw.strip("~").lower(), stemmed="~" in raw, boost=float(boost or 1))

    return any_of()


def leaves(want: Want) -> list[Want]:
    return [want] if want.kind in ("word", "phrase", "within") else [x for p in want.parts for x in leaves(p)]


def hits(index: DataFrame, want: Want, options: Options = Options()) -> DataFrame:
    """(doc_id, n, length) of the documents that have a leaf of the query."""
    if want.kind == "within":
        return hits(index.where(F.col("path").rlike(rf"(^|/){re.escape(want.tag)}(/|$)")), want.parts[0], options)
    if want.kind == "word":
        at = F.col(options.column(want.stemmed))
        cond = at.startswith(want.word[:-1]) if want.word.endswith("*") else at == options.word(want.word, want.stemmed)
        return index.where(cond).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length"))
    column, parts = options.column(False), [options.word(w, False) for w in want.parts]
    wanted = index.where(F.col(column).isin(list(set(parts)))).select("doc_id", "path", F.col(column).alias("term"), "pos", "length")
    found = None
    for k, w in enumerate(parts):  # all words of a phrase start at one place
        part = wanted.where(F.col("term") == w).select("doc_id", "path", (F.col("pos") - k).alias("start"), *(["length"] if k == 0 else []))
        found = part if found is None else found.join(part, ["doc_id", "path", "start"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length"))


def search(index: DataFrame, query: str, total: int | None = None, options: Options = Options()) -> DataFrame:
    """(doc_id, score) of the documents that match: one grouped pass over the postings of all leaves."""
    want = parse_query(query)
    parts = leaves(want)
    frames = [hits(index, x, options).select("doc_id", F.lit(k).alias("leaf"), "n", "length", F.lit(x.boost).alias("boost")) for k, x in enumerate(parts)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    n = F.lit(float(total if total is not None else index.select("doc_id").distinct().count()))
    df = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("df"))
    idf = F.lit(1.0) + F.log(n / (F.col("df") + 1))
    part = F.sqrt(F.col("n") * F.col("boost")) / F.sqrt("length") * idf * idf
    docs = rows.join(F.broadcast(df), "leaf").groupBy("doc_id").agg(F.sum(part).alias("score"), F.collect_set("leaf").alias("leaves"))
    numbers = iter(range(len(parts)))

    def holds(w: Want) -> Column:
        if w.kind in ("word", "phrase", "within"):
            return F.array_contains("leaves", next(numbers))
        out = None
        for p in w.parts:
            c = holds(p)
            out = c if out is None else (out & c if w.kind == "all" else out | c)
        return out

    return docs.where(holds(want)).select("doc_id", "score")


def matches_query(text: Column, query: str, kind: str = "string-value", parts: Column | None = None) -> Column:
    """Whether a text matches, without an index; ``parts``: (path, text) of its elements."""
    if kind not in TYPES:
        raise StaticError("SE3022", f"unknown document type {kind}")
    words = words_of(text)

    def holds(w: Want) -> Column:
        if w.kind == "word":
            if w.word.endswith("*"):
                return F.exists(words, lambda x: x.startswith(w.word[:-1]))
            return F.array_contains(words, w.word)
        if w.kind == "phrase":
            return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(" " + " ".join(w.parts) + " ")
        if w.kind == "within":
            if parts is None:
                raise StaticError("SE3022", "CONTAINS needs elements")
            inner = w.parts[0]
            own = F.filter(parts, lambda p: p["path"].rlike(rf"(^|/){re.escape(w.tag)}(/|$)"))
            bodies = F.transform(own, lambda p: words_of(F.coalesce(p["text"], F.lit(""))))
            if inner.kind == "phrase":
                return F.exists(bodies, lambda b: F.concat(F.lit(" "), F.array_join(b, " "), F.lit(" ")).contains(" " + " ".join(inner.parts) + " "))
            if inner.word.endswith("*"):
                return F.exists(bodies, lambda b: F.exists(b, lambda x: x.startswith(inner.word[:-1])))
            return F.exists(bodies, lambda b: F.array_contains(b, inner.word))
        out = None
        for p in w.parts:
            c = holds(p)
            out = c if out is None else (out & c if w.kind == "all" else out | c)
        return out

    return F.coalesce(holds(parse_query(query)), F.lit(False))


def highlighted(text: Column, query: str, blocks: bool = False) -> Column:
    """``text`` with hits marked; with ``blocks`` only the words around hits."""
    terms = []
    for w in leaves(parse_query(query)):
        w = w.parts[0] if w.kind == "within" else w
        terms.append(r"[\W_]+".join(re.escape(p) for p in w.parts) if w.kind == "phrase" else re.escape(w.word.strip("~*")) + (r"\w*" if w.word.endswith("*") else ""))
    pattern = rf"(?iu)\b({'|'.join(sorted(terms, key=len, reverse=True))})\b"
    marked = F.regexp_replace(text, pattern, "<hit>$1</hit>")
    if not blocks:
        return marked
    around = rf"(?iu)(?:\S+\s+){{0,5}}\S*(?:{'|'.join(sorted(terms, key=len, reverse=True))})\S*(?:\s+\S+){{0,5}}"
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(around), F.lit(0)), lambda x: F.regexp_replace(x, F.lit(pattern), F.lit("<hit>$1</hit>"))), " ... ")


def documents(table: DataFrame) -> int:
    """How many documents have a word: each has one at place 0."""
    return table.where("pos = 0").select("doc_id").distinct().count()


@dataclass
class Stored:
    """A full-text index: stored postings, its number of documents, options, and how it is made anew."""

    table: DataFrame
    total: int
    kind: str
    options: str
    again: Callable[[], DataFrame] | None = None
    source: Any = None


class FullText:
    """Full-text indexes of a session. One over a store that has a later version is made anew when it is next used."""

    def __init__(self, session):
        self.session = session
        self.indexes: dict[str, Stored] = {}

    def create(self, name: str, docs: DataFrame, kind: str = "string-value", options: str = "", again: Callable[[], DataFrame] | None = None, source: Callable[[], Any] | None = None) -> None:
        """An index of ``docs`` (doc_id, parts)."""
        if kind not in TYPES:
            raise StaticError("SE3022", f"unknown document type {kind}")
        if name in self.indexes:
            raise StaticError("SE2033", f"index {name} exists")
        least = self.session.spark.sparkContext.defaultParallelism
        docs = docs if docs.rdd.getNumPartitions() >= least else docs.repartition(least)
        table = self.written(name, postings(docs, Options.of(options)))
        self.indexes[name] = Stored(table, documents(table), kind, options, again, (source, source()) if source else None)

    def written(self, name: str, table: DataFrame) -> DataFrame:
        """Postings in segments: each task sorts the words of its own documents, so nothing is shuffled, a common word is
        spread over all segments, and a scan reads only the row groups of the words it wants."""
        folder = self.session.fresh_folder(f"ft-{name}")
        table.sortWithinPartitions("term", "doc_id", "pos").write.option("parquet.block.size", 4 << 20).parquet(folder)
        return self.session.spark.read.parquet(folder)

    def drop(self, name: str) -> None:
        if self.indexes.pop(name, None) is None:
            raise StaticError("SE1061", f"no index {name}")

    def open(self, name: str) -> Stored:
        if name not in self.indexes:
            raise StaticError("SE1061", f"no index {name}")
        held = self.indexes[name]
        if held.source and held.again and held.source[0]() is not held.source[1]:
            del self.indexes[name]
            self.create(name, held.again(), held.kind, held.options, held.again, held.source[0])
            held = self.indexes[name]
        return held

    def append(self, name: str, docs: DataFrame) -> None:
        """Postings of more documents (doc_id, parts) beside those there are."""
        held = self.open(name)
        held.table = held.table.unionByName(self.written(name, postings(docs, Options.of(held.options))))
        held.total = documents(held.table)

    def dictionary(self, name: str) -> DataFrame:
        held = self.open(name)
        return held.table.select(F.col(Options.of(held.options).column(False)).alias("term")).distinct()

    def scan(self, name: str, query: str, options: str = "") -> DataFrame:
        held = self.open(name)
        found = search(held.table, query, held.total, Options.of(held.options))
        if "count_only" in options:
            return found.agg(F.count(F.lit(1)).alias("count"))
        return found.drop("score") if "nosort" in options else found
