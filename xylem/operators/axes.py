"""Axes and node tests on the node table: joins and filters over (doc_id, pre, size, level, parent)."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from xylem.plans.parser import Test
    from xylem.plans.relation import Node


def related(axis: str, c: Node, n: Node) -> Column:
    """The join condition of an axis: ``n`` is on it, seen from ``c``. Every one is an equality on doc_id besides."""
    same = c.col("doc_id") == n.col("doc_id")
    pre, at, end = c.col("pre"), n.col("pre"), c.col("pre") + c.col("size")
    plain = n.col("kind") != "attribute"
    inside = (at > pre) & (at <= end)
    outside = (pre > at) & (pre <= at + n.col("size"))
    siblings = (c.col("parent") == n.col("parent")) & plain & (c.col("kind") != "attribute")
    return same & {
        "child": (n.col("parent") == pre) & plain,
        "attribute": (n.col("parent") == pre) & ~plain,
        "descendant": inside & plain,
        "descendant-attribute": inside & ~plain,
        "descendant-or-self": (at >= pre) & (at <= end) & (plain | (at == pre)),
        "self": at == pre,
        "parent": c.col("parent") == at,
        "ancestor": outside,
        "ancestor-or-self": outside | (at == pre),
        "following": (at > end) & plain,
        "preceding": (at + n.col("size") < pre) & plain,
        "following-sibling": siblings & (at > pre),
        "preceding-sibling": siblings & (at < pre),
    }[axis]


def beyond(nodes: DataFrame, contexts: DataFrame, axis: str) -> DataFrame:
    """``nodes`` on the axis following or preceding of any of ``contexts`` (doc_id, pre, size): one bound for each document
    decides it, so no node meets more than one row."""
    if axis == "following":
        bound, on = F.min(F.col("pre") + F.col("size")), F.col("pre") > F.col("_bound")
    else:
        bound, on = F.max("pre"), F.col("pre") + F.col("size") < F.col("_bound")
    bounds = contexts.groupBy(F.col("doc_id").alias("_d")).agg(bound.alias("_bound"))
    return nodes.join(bounds, (F.col("doc_id") == F.col("_d")) & on, "left_semi").where("kind != 'attribute'")


def beside(nodes: DataFrame, contexts: DataFrame, axis: str) -> DataFrame:
    """``nodes`` on the axis following-sibling or preceding-sibling of any of ``contexts``: one bound for each parent decides it."""
    after = axis == "following-sibling"
    contexts = contexts.where("kind != 'attribute'").groupBy(F.col("doc_id").alias("_d"), F.col("parent").alias("_p"))
    bounds = contexts.agg((F.min("pre") if after else F.max("pre")).alias("_bound"))
    on = F.col("pre") > F.col("_bound") if after else F.col("pre") < F.col("_bound")
    return nodes.join(bounds, (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("_p")) & on, "left_semi").where("kind != 'attribute'")


def reached(nodes: DataFrame, contexts: DataFrame, axis: str) -> DataFrame:
    """``nodes`` on the axis ancestor(-or-self) or descendant(-or-self) of any of ``contexts`` (doc_id, pre, size), in one
    sorted pass over each document: a node is below a context if it comes before the furthest end of the contexts so far,
    and above one if the next context comes before its own end. No node meets more than one row."""
    up, itself = axis.startswith("ancestor"), axis.endswith("or-self")
    names = nodes.columns
    marks = contexts.select("doc_id", "pre", *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in names if c not in ("doc_id", "pre")), F.col("pre").alias("_at"), (F.col("pre") + F.col("size")).alias("_end"))
    both = nodes.withColumns({"_at": F.lit(None).cast("long"), "_end": F.lit(None).cast("long")}).unionByName(marks)
    first = F.col("_at").isNull() != F.lit(itself)  # a context comes before the node it is, if that is on the axis
    so_far = Window.partitionBy("doc_id").orderBy(F.desc("pre") if up else F.asc("pre"), F.desc(first)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near, far = (F.min("_at") if up else F.max("_at")).over(so_far), F.max("_end").over(so_far)
    passed = both.withColumns({"_near": near, "_far": far}).where("_at is null")
    plain = (F.col("kind") != "attribute") | ((F.col("_near") == F.col("pre")) if itself else F.lit(False))
    on = F.col("_near") <= F.col("pre") + F.col("size") if up else (F.col("_far") >= F.col("pre")) & plain
    return passed.where(on).select(*names)


def tested(frame: DataFrame, test: Test, principal: str, axis: str) -> DataFrame:
    """``frame`` (a node table) filtered by a node test; filters come before the join and reach the scan."""
    kind = test.kind
    if kind in ("element", "attribute"):
        frame = frame.where(F.col("kind") == (kind if kind != "element" or principal == "element" else principal))
    elif kind in ("text", "comment", "processing-instruction"):
        frame = frame.where(F.col("kind") == kind)
    elif kind == "document-node":
        frame = frame.where(F.col("kind") == "document")
    if test.name and kind != "document-node":
        pfx, _, local = test.name.rpartition(":")
        if local != "*":
            frame = frame.where(F.col("local") == local)
        if pfx and pfx != "*":
            frame = frame.where(F.col("pfx") == pfx)
    return frame


def document_order(nodes: DataFrame, prefix: str = "") -> DataFrame:
    """Duplicates dropped and rows in document order."""
    key = [prefix + "doc_id", prefix + "pre"]
    return nodes.dropDuplicates(key).orderBy(*key)


def deepest(nodes: DataFrame, prefix: str) -> DataFrame:
    """Of nested nodes only the deepest: those that the next one of the document, in document order, isn't inside of."""
    c = lambda n: F.col(prefix + n)
    places = nodes.select(c("doc_id").alias("_d"), c("pre").alias("_p"), (c("pre") + c("size")).alias("_end")).distinct()
    after = F.lead("_p").over(Window.partitionBy("_d").orderBy("_p"))
    outer = places.withColumn("_next", after).where(F.col("_next") <= F.col("_end"))
    return nodes.join(outer, (c("doc_id") == F.col("_d")) & (c("pre") == F.col("_p")), "left_anti")


def language(tuples: DataFrame, node: Node, wanted: Column) -> tuple[DataFrame, Column]:
    """Whether the nearest ``xml:lang`` at or above ``node`` is ``wanted`` or a variety of it."""
    marks = node.store.frame("attribute", None).where((F.col("kind") == "attribute") & (F.col("pfx") == "xml") & (F.col("local") == "lang"))
    owners = node.store.frame("self", None).select("doc_id", F.col("pre").alias("_own"), F.col("size").alias("_size"))
    marks = marks.join(owners, (marks["doc_id"] == owners["doc_id"]) & (marks["parent"] == owners["_own"])).select(marks["doc_id"].alias("_doc"), "_own", "_size", F.col("value").alias("_lang"))
    keys = [node.prefix + "doc_id", node.prefix + "pre"]
    near = tuples.select(*keys).distinct().join(marks, (F.col(keys[0]) == F.col("_doc")) & (F.col("_own") <= F.col(keys[1])) & (F.col(keys[1]) <= F.col("_own") + F.col("_size")))
    best = near.groupBy(*(F.col(k).alias(f"_{n}") for n, k in enumerate(keys))).agg(F.max_by("_lang", "_own").alias("_nearest"))
    joined = tuples.join(best, (F.col(keys[0]) == F.col("_0")) & (F.col(keys[1]) == F.col("_1")), "left").drop("_0", "_1")
    found, want = F.lower("_nearest"), F.lower(wanted)
    return joined, F.coalesce((found == want) | found.startswith(F.concat(want, F.lit("-"))), F.lit(False))
