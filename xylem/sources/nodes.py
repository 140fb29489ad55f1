"""XML documents as a node table: shredding, storage by path, and serialising.

A document is numbered in document order: ``pre`` of a node, ``size`` its number of nodes below (attributes
included), so a descendant is a range of ``pre``. Numbers are ``GAP`` apart, so later insertions seldom have to
renumber. Simple elements and attributes carry their text as ``value``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, pre long, size long, level int, parent long, kind string, ns string, pfx string, local string, path string, value string"
GAP = 1
#: Nodes in an Arrow batch, about.
BATCH = 20_000
#: Bytes of documents in a batch that goes to Python, about: a document is in one batch, several long ones aren't.
BATCH_BYTES = 1 << 20
#: Bytes of files of a node table that an update reads in a task, at most: some 300,000 nodes where they compress well.
TASK_BYTES = 4 << 20
#: Characters that are parsed at once.
PIECE = 1 << 16


def shredded(xml: str, strip_space: bool = True) -> Iterator[list[list]]:
    """Nodes of one document as :func:`shred` has them, in lists, each node once its end is reached: only the elements
    that are open are held, however long the document is."""
    out: list[list] = []
    stack: list[list] = [[0, 0, 0, None, "document", "", "", "", "", None]]
    texts: list[list | None] = [None]  # of each open node: the texts below it, none if it has other content
    scopes, held, seen = [{"xml": "http://www.w3.org/XML/1998/namespace", "": ""}], [], 1
    parser = expat.ParserCreate()
    parser.buffer_text, parser.ordered_attributes = True, True

    def add(kind: str, pfx: str = "", local: str = "", value: str | None = None, ns: str = "") -> list:
        nonlocal seen
        top = stack[-1]
        label = f"{pfx}:{local}" if pfx else local
        step = {"element": label, "attribute": f"@{label}", "text": "text()"}.get(kind, f"{kind}()")
        row = [seen, 0, top[2] + 1, top[0], kind, ns, pfx, local, f"{top[8]}/{step}", value]
        seen += 1
        if kind == "text":
            if texts[-1] is not None:
                texts[-1].append(value)
        elif kind != "attribute":
            texts[-1] = None
        if kind != "element":
            out.append(row)
        return row

    def text() -> None:
        if not held:
            return
        raw = "".join(held)
        held.clear()
        if raw and (raw.strip() or not strip_space):
            add("text", value=raw)

    def start(name, attributes):
        text()
        pairs = list(zip(attributes[::2], attributes[1::2], strict=True))
        scope = scopes[-1]
        if any(k.startswith("xmlns") for k, _ in pairs):
            scope = scope | {(k[6:] if k != "xmlns" else ""): v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        scopes.append(scope)
        pfx, _, local = name.rpartition(":")
        stack.append(add("element", pfx, local, ns=scope.get(pfx, "")))
        texts.append([])
        for k, v in pairs:
            if k != "xmlns" and not k.startswith("xmlns:"):
                apfx, _, alocal = k.rpartition(":")
                add("attribute", apfx, alocal, v, scope.get(apfx, "") if apfx else "")

    def end(name=None):
        text()
        scopes.pop()
        row, below = stack.pop(), texts.pop()
        row[1] = seen - 1 - row[0]
        if below is not None:
            row[9] = "".join(below)
        out.append(row)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = held.append
    parser.CommentHandler = lambda data: (text(), add("comment", value=data))
    parser.ProcessingInstructionHandler = lambda target, data: (text(), add("processing-instruction", "", target, data))
    for at in range(0, len(xml), PIECE):
        parser.Parse(xml[at : at + PIECE], False)
        if out:
            yield out
            out.clear()
    parser.Parse("", True)
    held.clear()
    end()
    yield out


def shred(xml: str, strip_space: bool = True) -> list[list]:
    """Nodes of one document: [pre, size, level, parent, kind, ns, pfx, local, path, value] in document order."""
    return sorted((n for some in shredded(xml, strip_space) for n in some), key=lambda n: n[0])


def node_table(docs: DataFrame, strip_space: bool = True) -> DataFrame:
    """The node table of ``docs`` (doc_id, xml), one document at a time on the executors, in batches of about ``BATCH`` nodes."""
    names = ["pre", "size", "level", "parent", "kind", "ns", "pfx", "local", "path", "value"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners = [], []

        def table() -> pa.RecordBatch:
            columns = [pa.array(owners, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

        for batch in batches:
            for doc, xml in zip(*batch.columns, strict=True):
                doc = doc.as_py()
                for nodes in shredded(xml.as_py(), strip_space):
                    held += nodes
                    owners += [doc] * len(nodes)
                    if len(held) >= BATCH:
                        yield table()
                        held, owners = [], []
        if held:
            yield table()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "xml").mapInArrow(run, SCHEMA).withColumn("path_id", F.crc32(F.col("path").cast("binary")))


@dataclass
class NodeStore:
    """Documents of one collection as a node table; ``uris``: (doc_id, uri), a row for each document."""

    nodes: DataFrame
    uris: DataFrame | None = None
    name: str = ""
    only: list[int] | None = None
    version: int = 0
    history: list[DataFrame] = field(default_factory=list)
    known: list[tuple[str, int]] | None = None

    def paths(self) -> list[tuple[str, int]]:
        """The distinct rooted paths and their ids: as many as the documents have shapes, not as they have nodes."""
        if self.known is None:
            self.known = [(r.path, r.path_id) for r in self.nodes.select("path", "path_id").distinct().collect()]
        return self.known

    def at_path(self, pattern: str) -> DataFrame:
        """The nodes whose rooted path matches, read from the partitions of those paths only."""
        ids = [i for path, i in self.paths() if re.fullmatch(pattern, path)]
        return self.frame().where(F.col("path_id").isin(ids) & F.rlike(F.col("path"), F.lit(f"^(?:{pattern})$")) if ids else F.lit(False))

    def frame(self, axis: str = "self", test=None) -> DataFrame:
        found = self.nodes
        if self.only is not None:
            found = found.where(F.col("doc_id").isin(self.only))
        return found

    def uri(self, doc_id: Column) -> Column:
        return F.concat(F.lit(self.name + "/"), doc_id.cast("string"))

    def replaced(self, nodes: DataFrame) -> NodeStore:
        """The next version; older ones stay readable."""
        return NodeStore(nodes, self.uris, self.name, self.only, self.version + 1, [*self.history, self.nodes])

    def descriptive_schema(self) -> DataFrame:
        """One row for each distinct rooted path with its kind and number of nodes."""
        return self.frame().where("kind != 'document'").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("nodes"))


def stored(spark, nodes: DataFrame, folder: str, spread: bool = True) -> DataFrame:
    """A node table written by path, each file in document order, and read back. Without ``spread`` the rows are written
    where they are: those of a stored table are by path already."""
    names = [c for c in nodes.columns if c != "path_id"]
    if spread:
        files = F.pmod(F.xxhash64("doc_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))  # adaptive execution joins those of small inputs
        nodes = nodes.repartition("path_id", files)
    nodes.sortWithinPartitions("path_id", "doc_id", "pre").write.mode("overwrite").partitionBy("path_id").parquet(folder)
    return spark.read.schema(nodes.select(*names, "path_id").schema).parquet(folder).select(*nodes.columns)


@contextmanager
def small_batches(spark) -> Iterator[None]:
    """Arrow batches of about ``BATCH_BYTES`` for what is run meanwhile: Spark reads the setting when a plan runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_tasks(spark) -> Iterator[None]:
    """Files are read in pieces of at most ``TASK_BYTES`` by what is run meanwhile: a task sorts what it reads before it is written."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    known = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(key, str(min(known, TASK_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def load(session, docs: DataFrame, name: str) -> NodeStore:
    """Shreds ``docs`` (doc_id, xml) and stores the table by path."""
    with small_batches(session.spark):
        nodes = stored(session.spark, node_table(docs), session.fresh_folder(f"nodes-{name}"))
    return NodeStore(nodes, docs.select("doc_id"), name)


def serialised(nodes: DataFrame, method: str = "xml", indent: bool = False, character_map: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, xml) of whole documents: the inverse of :func:`node_table`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("pre").to_dict("records")
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "xml": [written(rows, method, indent, character_map or {})]})

    return nodes.groupBy("doc_id").applyInPandas(run, "doc_id long, xml string")


def written(rows: list[dict], method: str = "xml", indent: bool = False, characters: dict[str, str] | None = None) -> str:
    """Nodes in document order as text; ``sxml``: as a Scheme list."""
    below: dict = {}
    for r in rows:
        below.setdefault(None if pd.isna(r["parent"]) else int(r["parent"]), []).append(r)
    numbers = {int(r["pre"]) for r in rows}
    tops = [r for r in rows if pd.isna(r["parent"]) or int(r["parent"]) not in numbers]

    def plain(s: str) -> str:
        s = escape(s or "")
        for k, v in (characters or {}).items():
            s = s.replace(k, v)
        return s

    def one(r: dict, depth: int) -> str:
        kind, inner = r["kind"], below.get(int(r["pre"]), [])
        label = f"{r['pfx']}:{r['local']}" if r["pfx"] else r["local"]
        if method == "sxml":
            if kind == "text":
                return quoteattr(r["value"])
            if kind in ("document", "element"):
                held = [x for x in inner if x["kind"] == "attribute"]
                parts = ["(@ " + " ".join(f"({x['local']} {quoteattr(x['value'])})" for x in held) + ")"] if held else []
                return f"({'*TOP*' if kind == 'document' else label} " + " ".join(parts + [one(x, depth + 1) for x in inner if x["kind"] != "attribute"]) + ")"
            return ""
        if kind == "document":
            return "".join(one(x, depth) for x in inner)
        if kind == "text":
            return plain(r["value"])
        if kind == "comment":
            return f"<!--{r['value']}-->"
        if kind == "processing-instruction":
            return f"<?{r['local']} {r['value']}?>"
        if kind == "attribute":
            return f"{label}={quoteattr(r['value'])}"
        held = "".join(f" {one(x, 0)}" for x in inner if x["kind"] == "attribute")
        rest = [x for x in inner if x["kind"] != "attribute"]
        if not rest:
            return f"<{label}{held}/>"
        gap = "\n" + "  " * (depth + 1) if indent and all(x["kind"] != "text" for x in rest) else ""
        return f"<{label}{held}>" + "".join(gap + one(x, depth + 1) for x in rest) + (gap[:-2] if gap else "") + f"</{label}>"

    return "".join(one(r, 0) for r in tops)
