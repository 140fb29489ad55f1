"""Updates of node tables as DataFrame transforms: each gives the rows of the next version.

``target`` names the nodes to update, once each, by (doc_id, pre, size, level, parent, kind, path_id). No document is held
in a task: rows are moved by arithmetic on their numbers, or in sorted passes over blocks of each document's numbers; a node
that reaches into a later block is marked at the start of it.

Numbers may have gaps. To make room, all numbers are multiplied by the same factor, so that a place between two nodes
becomes as many as are put there; that needs no knowledge of the nodes before. Of nodes that end at one place each is
inside the one before, so their levels tell which of them is to hold what is put there.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.functions.values import StaticError
from xylem.sources.nodes import shred, written

#: Numbers stay below this.
MOST = 1 << 62
#: Nodes in a block of a document, about.
BLOCK = 1 << 16
#: Rows that are sent to all tasks, at most.
FEW = 10_000
_UP = "/[^/]*$"


def width(nodes: DataFrame) -> int:
    """How many numbers a block has, so that about ``BLOCK`` nodes are in one: numbers may have gaps."""
    numbers = nodes.where((F.col("path_id") == numbered(F.lit(""))) & (F.col("kind") == "document")).agg(F.sum((F.col("pre") + F.col("size") + 1).cast("double"))).first()[0]
    return max(1, min(MOST, int(BLOCK * numbers / max(1, nodes.count())))) if numbers else MOST


def marked(nodes: DataFrame, tops: DataFrame, wide: int, mark: Column) -> DataFrame:
    """``nodes`` with ``_mark``, null, ``_block`` and ``_at``, their place in it; and ``mark`` of each of ``tops`` (doc_id, pre,
    size) in every block that it reaches into, at its number or before all others."""
    first = F.expr(f"pre div {wide}L")
    marks = tops.withColumn("_mark", mark).withColumn("_block", F.explode(F.sequence(first, F.expr(f"(pre + size) div {wide}L"))))
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns if c != "doc_id"]
    marks = marks.select("doc_id", *none, "_mark", "_block", F.when(F.col("_block") == first, F.col("pre")).otherwise(-1).alias("_at"))
    return nodes.withColumns({"_mark": F.lit(None).cast(marks.schema["_mark"].dataType), "_block": first, "_at": F.col("pre")}).unionByName(marks)


def order(first: bool = True):
    """The pass over a block so far; ``first``: a node comes after its own mark."""
    own = F.col("_mark").isNull() if first else F.col("_mark").isNotNull()
    return Window.partitionBy("doc_id", "_block").orderBy("_at", own).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def told(nodes: DataFrame, tops: DataFrame, wide: int, itself: bool = True) -> DataFrame:
    """``nodes`` with ``_inside``: whether a node is below one of ``tops`` (doc_id, pre, size), or with ``itself`` is one. In
    document order it is, if it comes before the furthest end of the tops so far."""
    both = marked(nodes, tops, wide, F.col("pre") + F.col("size")).withColumn("_last", F.max("_mark").over(order(itself)))
    return both.where("_mark is null").select(*nodes.columns, F.coalesce(F.col("_last") >= F.col("pre"), F.lit(False)).alias("_inside"))


def listed(frame: DataFrame, column: str) -> list:
    """The distinct values of a column that has few: path ids, paths or levels."""
    return sorted(r[0] for r in frame.select(column).distinct().collect())


def paths_of(nodes: DataFrame, target: DataFrame) -> list[str]:
    """The paths that targets can have: those of their path ids."""
    return listed(nodes.where(F.col("path_id").isin(listed(target, "path_id"))), "path")


def with_paths(nodes: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` with the paths of its nodes, read from the partitions of those paths only."""
    known = nodes.where(F.col("path_id").isin(listed(target, "path_id"))).select("doc_id", "pre", "path")
    return target.join(known, ["doc_id", "pre"])


def dense(nodes: DataFrame) -> DataFrame:
    """``nodes`` numbered without gaps, with ``_old``, their numbers before: a sorted pass over nodes and their ends."""
    starts = nodes.select("doc_id", F.col("pre").alias("_at"), F.lit(0).alias("_end"), F.col("pre").alias("_old"))
    ends = nodes.select("doc_id", (F.col("pre") + F.col("size")).alias("_at"), F.lit(1).alias("_end"), F.col("pre").alias("_old"))
    so_far = Window.partitionBy("doc_id").orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = starts.unionByName(ends).withColumn("_n", F.sum(1 - F.col("_end")).over(so_far) - 1)
    places = counted.groupBy("doc_id", "_old").agg(F.min(F.when(F.col("_end") == 0, F.col("_n"))).alias("_new"), F.max(F.when(F.col("_end") == 1, F.col("_n"))).alias("_last"))
    out = nodes.withColumnRenamed("pre", "_old").join(places, ["doc_id", "_old"])
    above = places.select("doc_id", F.col("_old").alias("parent"), F.col("_new").alias("_parent"))
    out = out.join(above, ["doc_id", "parent"], "left")
    return out.withColumns({"pre": F.col("_new"), "size": F.col("_last") - F.col("_new"), "parent": F.col("_parent")}).select(*nodes.columns, "_old")


def roomy(nodes: DataFrame, target: DataFrame, times: int) -> tuple[DataFrame, DataFrame]:
    """Both, numbered anew where numbers that are ``times`` as large would be too large."""
    top = nodes.where((F.col("path_id") == numbered(F.lit(""))) & (F.col("kind") == "document")).agg(F.max(F.col("pre") + F.col("size"))).first()[0]
    if ((top or 0) + 1) * times < MOST:
        return nodes, target
    fresh = dense(nodes)
    wanted = target.select("doc_id", F.col("pre").alias("_old"))
    return fresh.drop("_old"), fresh.join(wanted, ["doc_id", "_old"], "left_semi").select(*target.columns)


def moved(nodes: DataFrame, times: int, by: int = 0, end: Column | int = 0) -> DataFrame:
    """``nodes`` with all numbers multiplied and moved on; ``end``: how much further elements reach."""
    pre, last = F.col("pre") * times, (F.col("pre") + F.col("size")) * times
    size = last - pre + F.when(F.col("kind").isin("element", "document"), end).otherwise(0)
    return nodes.withColumns({"pre": pre + by, "size": size.cast("long"), "parent": F.col("parent") * times + by})


def valued(nodes: DataFrame, values: DataFrame, ids: list[int]) -> DataFrame:
    """``nodes`` with other values of some elements, which have one of the path ids: ``values`` (doc_id, pre, _value). Other
    nodes pass by the join."""
    here = F.col("path_id").isin(ids)
    new = values.select("doc_id", "pre", F.struct("_value").alias("_new"))
    own = nodes.where(here).join(new, ["doc_id", "pre"], "left")
    value = F.when(F.col("_new").isNotNull() & (F.col("kind") == "element"), F.col("_new")["_value"]).otherwise(F.col("value"))
    return nodes.where(~here).unionByName(own.withColumn("value", value).select(*nodes.columns))


def texts(owners: DataFrame, below: DataFrame) -> DataFrame:
    """``owners`` (doc_id, pre, path_id) with ``_value``: their text if all that is in ``below`` (doc_id, _owner, pre, kind, value) is text."""
    text = F.when(F.col("kind") == "text", F.struct("pre", "value"))
    made = below.where("kind != 'attribute'").groupBy("doc_id", F.col("_owner").alias("pre")).agg(F.min(F.col("kind") == "text").alias("_plain"), F.array_sort(F.collect_list(text)).alias("_texts"))
    whole = F.array_join(F.transform(F.coalesce("_texts", F.array().cast("array<struct<pre: bigint, value: string>>")), lambda x: x["value"]), "")
    return owners.join(made, ["doc_id", "pre"], "left").select("doc_id", "pre", F.when(F.coalesce("_plain", F.lit(True)), whole).alias("_value"))


def revalued(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """``nodes`` with the values of ``owners`` (doc_id, pre, path_id) made anew from what is below them."""
    here = owners.select("doc_id", F.col("pre").alias("_owner"))
    below = nodes.withColumn("_owner", F.col("parent")).join(here, ["doc_id", "_owner"], "left_semi")
    return valued(nodes, texts(owners, below), listed(owners, "path_id"))


def numbered(path: Column) -> Column:
    return F.crc32(path.cast("binary"))


def above(target: DataFrame) -> DataFrame:
    """(doc_id, pre, path_id) of the parents of targets that have paths."""
    return target.select("doc_id", F.col("parent").alias("pre"), numbered(F.regexp_replace("path", _UP, "")).alias("path_id")).distinct()


def parsed(xml: str) -> list[list]:
    """Content to insert: rows of a fragment, attributes of a wrapping ``<_/>`` included; places, levels and paths count from
    those of the fragment, and a parent is None at its top."""
    rows = shred(f"<_>{xml}</_>" if not xml.startswith("<_") else xml)[2:]
    return [[r[0] - 2, r[1], r[2] - 2, r[3] - 2 if r[3] > 1 else None, r[4], r[5], r[6], r[7], r[8][2:], r[9]] for r in rows]


PARTS = "_k long, _size long, _level int, _up long, kind string, ns string, pfx string, local string, _path string, value string"


def put(owners: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes of fragments: rows of ``PARTS`` with ``_base``, the number of the first, and their owner's doc_id, ``_owner``,
    ``_depth`` and ``_above`` (its path)."""
    path = F.concat("_above", "_path")
    return owners.select(
        "doc_id", (F.col("_base") + F.col("_k")).alias("pre"), F.col("_size").alias("size"), (F.col("_depth") + 1 + F.col("_level")).cast("int").alias("level"),
        F.coalesce(F.col("_base") + F.col("_up"), F.col("_owner")).alias("parent"), "kind", "ns", "pfx", "local", path.alias("path"), "value", numbered(path).alias("path_id"),
    ).select(*columns)


def insert(nodes: DataFrame, target: DataFrame, xml: str, where: str = "into") -> DataFrame:
    """A copy of ``xml`` into, preceding or following each target."""
    rows = parsed(xml)
    target = target.where(F.col("kind").isin("element", "document") if where == "into" else F.col("parent").isNotNull())
    levels = listed(target, "level")
    if not levels or not rows:
        return nodes
    marks = [r for r in rows if r[4] == "attribute" and r[3] is None] if where == "into" else []
    content = [[r[0] - len(marks), *r[1:3], None if r[3] is None else r[3] - len(marks), *r[4:]] for r in rows if r not in marks]
    a, m, top, many = len(marks), len(content), levels[-1], levels[-1] - levels[0] + 1
    times = 1 + m if where == "preceding" else 1 + a + m * many
    nodes, target = roomy(nodes, target, times)
    hit = with_paths(nodes, target)
    first, last = F.col("pre") * times, (F.col("pre") + F.col("size")) * times
    slot = a + (top - F.col("level")) * m + 1
    parts = lambda some: F.broadcast(nodes.sparkSession.createDataFrame(some, PARTS))
    if where == "into":
        out = moved(nodes, times, end=a + F.least(F.greatest(top - F.col("level") + 1, F.lit(0)), F.lit(many)) * m)
        owned = hit.withColumns({"_owner": first, "_depth": F.col("level"), "_above": F.col("path")})
        base = last + slot
    else:
        up = {"_depth": F.col("level") - 1, "_above": F.regexp_replace("path", _UP, "")}
        if where == "following":
            out = moved(nodes, times, end=F.least(F.greatest(top - F.col("level"), F.lit(0)), F.lit(many)) * m)
            owned, base = hit.withColumns({"_owner": F.col("parent") * times, **up}), last + slot
        else:
            out = moved(nodes, times, by=m)
            owned, base = hit.withColumns({"_owner": F.col("parent") * times + m, **up}), first
    columns, owner = nodes.columns, ("doc_id", "_owner", "_depth", "_above", "_base")
    new = []
    if marks:
        held = nodes.where("kind = 'attribute'").join(target.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.max("pre").alias("_last"))
        owners = owned.join(held, ["doc_id", "pre"], "left").withColumn("_base", F.coalesce("_last", "pre") * times + 1)
        new.append(put(owners.select(*owner).crossJoin(parts(marks)), columns))
    if content:
        new.append(put(owned.withColumn("_base", base).select(*owner).crossJoin(parts(content)), columns))
        tops = [r for r in content if r[3] is None and r[4] != "attribute"]
        changed = hit.select("doc_id", "pre", "path_id") if where == "into" else above(hit)
        changed = changed.withColumn("pre", F.col("pre") * times + (m if where == "preceding" else 0))
        if tops and all(r[4] == "text" for r in tops):
            return revalued(reduce(DataFrame.unionByName, new, out), changed)
        if tops:
            out = valued(out, changed.withColumn("_value", F.lit(None).cast("string")), listed(changed, "path_id"))
    return reduce(DataFrame.unionByName, new, out)


def delete(nodes: DataFrame, target: DataFrame) -> DataFrame:
    """Without the targets and what is below them: nodes up to the furthest end of the targets before them.

    Numbers may have gaps, so the nodes left keep theirs; only the text values of the targets' parents are made anew.
    """
    target = target.where("kind != 'document'")
    hit, paths = with_paths(nodes, target), paths_of(nodes, target)
    if not paths:
        return nodes
    wide, owners = width(nodes), above(hit)
    kept = children(nodes, sorted({p.rpartition("/")[0] for p in paths})).join(hit.select("doc_id", "pre"), ["doc_id", "pre"], "left_anti").withColumnRenamed("parent", "_owner")
    kept = kept.join(owners.select("doc_id", F.col("pre").alias("_owner")), ["doc_id", "_owner"], "left_semi")
    nodes = valued(nodes, texts(owners, kept), listed(owners, "path_id"))
    near = under(paths, True)
    return nodes.where(~near).unionByName(told(nodes.where(near), hit, wide).where("not _inside").drop("_inside"))


def children(nodes: DataFrame, paths: list[str], *more: str) -> DataFrame:
    """(doc_id, pre, parent, kind, value) of nodes, attributes left out, that can be right below one at ``paths``; values of
    texts only."""
    below = reduce(Column.__or__, (F.col("path").startswith(p + "/") & (F.col("level") == p.count("/") + 1) for p in paths))
    return nodes.where(below & (F.col("kind") != "attribute")).select("doc_id", "pre", "parent", "kind", F.when(F.col("kind") == "text", F.col("value")).alias("value"), *more)


def under(paths: list[str], itself: bool) -> Column:
    """Whether a node can be below one that has one of ``paths``, or be it."""
    path = F.col("path")
    return reduce(Column.__or__, (path.startswith(p + "/") | (path == p) if itself else path.startswith(p + "/") for p in paths))


def around(nodes: DataFrame, target: DataFrame, levels: list[int], wide: int) -> tuple[DataFrame, dict[int, Column]]:
    """``nodes`` with the targets they are at or below, by the targets' levels: (pre, parent, kind), null where there is
    none. Of one level, the last target before a node in document order is the only one it can be in."""
    names = nodes.columns
    both, so_far = marked(nodes, target, wide, F.struct("pre", (F.col("pre") + F.col("size")).alias("end"), "parent", "kind", "level")), order()
    last = {n: F.last(F.when(F.col("_mark")["level"] == n, F.col("_mark")), ignorenulls=True).over(so_far) for n in levels}
    both = both.select(*names, "_mark", *(c.alias(f"_in{n}") for n, c in last.items())).where("_mark is null")
    held = {n: F.when((F.col(f"_in{n}")["end"] >= F.col("pre")) & (F.col("level") >= n), F.col(f"_in{n}")) for n in levels}
    return both.select(*names, *(c.alias(f"_in{n}") for n, c in held.items())), {n: F.col(f"_in{n}") for n in levels}


def climbed(frame: DataFrame, inside: dict[int, Column]) -> DataFrame:
    """``frame`` with ``_top`` and ``_hops``: the nearest node above that stays, and how many targets are before it."""
    top, hops = F.col("parent"), F.lit(0)
    for n in sorted(inside, reverse=True):
        gone = inside[n].isNotNull() & (inside[n]["pre"] == top)
        top, hops = F.when(gone, inside[n]["parent"]).otherwise(top), hops + gone.cast("int")
    return frame.withColumns({"_top": top, "_hops": hops})


def small(nodes: DataFrame, rows: list, schema: str) -> DataFrame:
    """A few rows for all tasks, without Python workers."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return F.broadcast(nodes.sparkSession.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ", ")))))


def covered(nodes: DataFrame, target: DataFrame, paths: list[str]) -> bool:
    """Whether all nodes at the paths of targets are targets: then its path tells which targets a node is in."""
    ids = listed(target, "path_id")
    return len(ids) == len(paths) and nodes.where(F.col("path_id").isin(ids)).count() == target.count()


def lifted(nodes: DataFrame, target: DataFrame, paths: list[str]) -> DataFrame:
    """:func:`delete_undeep` of all nodes at ``paths``: no pass over documents. Only nodes right below a target meet what
    takes them, which is sent to them if it is one node a document, and few."""
    gone, up = {*paths}, lambda p: p.rpartition("/")[0]

    def over(path: str) -> list[str]:
        """The targets right above one another, and above ``path``."""
        return [up(path), *over(up(path))] if up(path) in gone else []

    tops = climbed(*around(target, target, listed(target, "level"), width(nodes))) if any(map(over, paths)) else target.withColumn("_top", F.col("parent"))
    tops = tops.select("doc_id", "pre", "_top")
    owners = tops.select("doc_id", F.col("_top").alias("pre")).distinct()
    few = owners.limit(FEW + 1).collect()
    single = len(few) <= FEW and len({r.doc_id for r in few}) == len(few)
    takers = small(nodes, few, "doc_id bigint, _top bigint") if single else tops.withColumnRenamed("pre", "parent")
    raised = lambda frame: frame.join(takers, ["doc_id"] if single else ["doc_id", "parent"])

    owner_paths = sorted({up(over(p)[-1] if over(p) else p) for p in paths})
    stay = nodes.where(~F.col("path").isin(paths))
    kept = raised(children(stay, paths)).withColumnRenamed("_top", "_owner").drop("parent")
    own = children(stay, owner_paths).withColumnRenamed("parent", "_owner").join(owners.withColumnRenamed("pre", "_owner"), ["doc_id", "_owner"], "left_semi")
    values = texts(owners, kept.unionByName(own))

    def shaped(frame: DataFrame, some: list[str]) -> DataFrame:
        """The nodes at some paths, with the levels and paths that they get."""
        new = {p: "/".join(x for i, x in enumerate(p.split("/")) if "/".join(p.split("/")[: i + 1]) not in gone) for p in some}
        rows = [(p, q, p.count("/") - q.count("/"), zlib.crc32(q.encode())) for p, q in new.items()]
        frame = frame.where(F.col("path_id").isin([zlib.crc32(p.encode()) for p in some]))
        both = frame.join(small(nodes, rows, "path string, _path string, _less int, _id bigint"), "path")
        return both.withColumns({"level": F.col("level") - F.col("_less"), "path": F.col("_path"), "path_id": F.col("_id")})

    near = under(paths, True)
    left = [p for p in listed(nodes.where(near), "path") if p not in gone]
    low, deep = [p for p in left if up(p) in gone and "/@" not in p], [p for p in left if up(p) not in gone]
    inner = [p for p in owner_paths if p in left]  # below another target
    ids = lambda some: [zlib.crc32(p.encode()) for p in some]
    out = [valued(nodes.where(~near), values, ids(set(owner_paths) - set(inner)))]
    below = valued(nodes, values, ids(inner)) if inner else nodes
    if low:
        out.append(shaped(raised(below), low).withColumn("parent", F.col("_top")).select(*nodes.columns))
    if deep:
        out.append(shaped(below, deep).select(*nodes.columns))
    return reduce(DataFrame.unionByName, out)


def delete_undeep(nodes: DataFrame, target: DataFrame) -> DataFrame:
    """Without the targets and their attributes; what was below them moves up. Numbers stay, with gaps."""
    target = target.where("kind != 'document'")
    paths = paths_of(nodes, target)
    if paths and covered(nodes, target, paths):
        return lifted(nodes, target, paths)
    hit = with_paths(nodes, target)
    levels = listed(hit, "level")
    if not levels:
        return nodes

    wide = width(nodes)
    outer, inside = around(hit, target, levels, wide)
    own = climbed(outer, inside)
    steps = F.split("path", "/")
    tops = own.select("doc_id", "pre", "_top", F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1 - F.col("_hops")), "/").alias("_path"))
    owner_paths = listed(tops, "_path")
    owners = tops.select("doc_id", F.col("_top").alias("pre"), numbered(F.col("_path")).alias("path_id")).distinct()
    kept = children(nodes, sorted({*paths, *owner_paths}), "path_id")
    here = F.col("path_id").isin(listed(target, "path_id"))
    kept = kept.where(~here).unionByName(kept.where(here).join(target.select("doc_id", "pre"), ["doc_id", "pre"], "left_anti"))
    places = tops.select("doc_id", F.col("pre").alias("parent"), F.col("_top").alias("_owner")).unionByName(owners.select("doc_id", F.col("pre").alias("parent"), F.col("pre").alias("_owner")))
    nodes = valued(nodes, texts(owners, kept.join(places, ["doc_id", "parent"])), [zlib.crc32(p.encode()) for p in owner_paths])

    near = under(paths, True)
    rows, inside = around(nodes.where(near), target, levels, wide)
    rows = climbed(rows, inside)
    itself = reduce(Column.__or__, (F.coalesce(inside[n]["pre"] == F.col("pre"), F.lit(False)) for n in levels))
    rows = rows.where(~itself & ~((F.col("kind") == "attribute") & (F.col("_hops") > 0)))
    lost = lambda x, i: reduce(Column.__or__, (inside[n].isNotNull() & (i == n) for n in levels))
    count = sum((inside[n].isNotNull().cast("int") for n in levels), F.lit(0))
    path = F.when(count > 0, F.array_join(F.filter(F.split("path", "/"), lambda x, i: ~lost(x, i)), "/")).otherwise(F.col("path"))
    rows = rows.withColumns({"parent": F.col("_top"), "level": (F.col("level") - count).cast("int"), "path": path}).withColumn("path_id", numbered(F.col("path")))
    return nodes.where(~near).unionByName(rows.select(*nodes.columns))


def replace(nodes: DataFrame, target: DataFrame, make, keep) -> DataFrame:
    """Each target replaced by ``make(xml of the target)``; every one sees the original document. Only a target's own nodes
    come together in a task. ``keep`` stores targets and new nodes: room is made for as many as the largest has."""
    target = target.where("parent is not null")
    wide, paths = width(nodes), paths_of(nodes, target)
    if not paths:
        return nodes
    whole = covered(nodes, target, paths)  # then nothing at or below the paths stays
    if any(p.startswith(q + "/") for p in paths for q in paths):
        target = told(target, target, wide, False).where("not _inside").drop("_inside")  # the outermost
    hit = keep(with_paths(nodes, target))
    target = hit.drop("path")
    near, names = under(paths, True), ["pre", "parent", "kind", "pfx", "local", "value"]

    def passed(nodes: DataFrame, target: DataFrame, wide: int) -> DataFrame:
        """Nodes that may be in a target, with ``_top``: the number of the one they are in."""
        both, so_far = marked(nodes.where(near), target, wide, F.struct("pre", (F.col("pre") + F.col("size")).alias("end"))), order()
        both = both.withColumn("_last", F.last("_mark", ignorenulls=True).over(so_far)).where("_mark is null")
        return both.withColumn("_top", F.when(F.col("_last")["end"] >= F.col("pre"), F.col("_last")["pre"])).select(*nodes.columns, "_top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if k == "string" else pa.int32() if k == "int" else pa.int64()) for n, k in (x.split() for x in f"doc_id long, _top long, {PARTS}".split(", "))])
        for batch in batches:
            out = []
            for doc, top, rows in zip(*batch.columns, strict=True):
                out += [[doc.as_py(), top.as_py(), *r] for r in parsed(make(written(rows.as_py())))]
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    told_apart = passed(nodes, target, wide).where("_top is not null").groupBy("doc_id", "_top").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))
    made = keep(told_apart.mapInArrow(run, f"doc_id long, _top long, {PARTS}"))
    times = (made.agg(F.max("_k")).first()[0] or 0) + 1
    roomier, target = roomy(nodes, target, times)
    if roomier is not nodes:
        places = dense(nodes).select("doc_id", F.col("_old").alias("_top"), F.col("pre").alias("_new"))
        made = made.join(places, ["doc_id", "_top"]).withColumn("_top", F.col("_new")).drop("_new")
        nodes, hit, wide = roomier, with_paths(roomier, target), width(roomier)
    left = nodes.where(~near)
    if not whole:
        left = left.unionByName(passed(nodes, target, wide).where("_top is null").drop("_top"))
    out = moved(left, times, end=times - 1)
    owners = hit.select("doc_id", F.col("pre").alias("_top"), (F.col("pre") * times).alias("_base"), (F.col("parent") * times).alias("_owner"), (F.col("level") - 1).alias("_depth"), F.regexp_replace("path", _UP, "").alias("_above"))
    out = out.unionByName(put(made.join(owners, ["doc_id", "_top"]), nodes.columns))
    tops = made.where("_up is null and kind not in ('text', 'attribute')").select("doc_id", F.col("_top").alias("pre"), F.lit(True).alias("_mixed")).distinct()
    changed = hit.join(tops, ["doc_id", "pre"], "left").groupBy("doc_id", (F.col("parent") * times).alias("pre"), numbered(F.regexp_replace("path", _UP, "")).alias("path_id"))
    changed = keep(changed.agg(F.coalesce(F.max("_mixed"), F.lit(False)).alias("_mixed")))
    mixed, plain = changed.where("_mixed").drop("_mixed"), changed.where("not _mixed").drop("_mixed")
    out = valued(out, mixed.withColumn("_value", F.lit(None).cast("string")), listed(mixed, "path_id"))
    return revalued(out, plain) if plain.take(1) else out


def rename(nodes: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """Elements and attributes renamed, and their steps in the paths of what is below them, in one pass over the nodes that
    have such paths."""
    pfx, _, local = name.rpartition(":")
    target = target.where(F.col("kind").isin("element", "attribute"))
    levels = listed(target, "level")
    if not levels:
        return nodes
    near = under(paths_of(nodes, target), True)
    rows, inside = around(nodes.where(near), target, levels, width(nodes))
    itself = reduce(Column.__or__, (F.coalesce(inside[n]["pre"] == F.col("pre"), F.lit(False)) for n in levels))
    at = lambda i: reduce(Column.__or__, (inside[n].isNotNull() & (i == n) for n in levels))
    path = F.array_join(F.transform(F.split("path", "/"), lambda x, i: F.when(at(i), F.concat(F.when(x.startswith("@"), "@").otherwise(""), F.lit(name))).otherwise(x)), "/")
    path = F.when(reduce(Column.__or__, (inside[n].isNotNull() for n in levels)), path).otherwise(F.col("path"))
    rows = rows.withColumns({"local": F.when(itself, local).otherwise(F.col("local")), "pfx": F.when(itself, pfx).otherwise(F.col("pfx")), "path": path}).withColumn("path_id", numbered(F.col("path")))
    return nodes.where(~near).unionByName(rows.select(*nodes.columns))


def checked(kind: str) -> None:
    if kind == "move":
        raise StaticError("SE2016", "update move isn't supported")
