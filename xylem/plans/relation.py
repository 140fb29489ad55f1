"""Relations and tuple streams: what sequences lower to."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from xylem.functions.values import V, of_spark

_numbers = count(1)


def fresh(stem: str) -> str:
    """A column name that no other part of a plan has."""
    return f"{stem}_{next(_numbers)}"


@dataclass
class Row:
    """A virtual element: a table row whose columns are its children and attributes, kept under ``prefix``."""

    prefix: str
    columns: dict[str, tuple[str, bool]]
    table: str | None = None

    def names(self) -> list[str]:
        return [self.prefix + c for c in self.columns]


@dataclass
class Node:
    """A node: its columns of the node table, kept under ``prefix``."""

    prefix: str
    store: Any

    COLUMNS = ("doc_id", "pre", "size", "level", "parent", "kind", "ns", "pfx", "local", "path_id", "value")

    def col(self, name: str) -> Column:
        return F.col(self.prefix + name)

    def names(self) -> list[str]:
        return [self.prefix + c for c in self.COLUMNS]


@dataclass
class Link:
    """A condition between an inner relation and the tuples around it; for an equality also its two sides, for an
    inequality ``ranged``: (sign, inner side, outer side), both of one ordered type."""

    condition: Column
    outer: Column | None = None
    inner: Column | None = None
    ranged: tuple[str, Column, Column] | None = None


@dataclass
class Tuples:
    """A tuple stream: a DataFrame whose columns hold the variables in scope.

    ``order``: sort keys, most significant first. ``links``: conditions that reach the stream ``around`` it.
    ``distinct``: (table, column, filters text) if the tuples are exactly the distinct values of that column.
    """

    df: DataFrame | None
    vars: dict[str, Any] = field(default_factory=dict)
    focus: Any = None
    around: Tuples | None = None
    order: list[Column] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    reached: set[str] = field(default_factory=set)
    sorted: bool = False
    distinct: tuple | None = None
    waiting: list[tuple] = field(default_factory=list)

    def find(self, name: str) -> Any:
        """The binding of a variable, here or around; what is found around is noted in ``reached``."""
        t, passed = self, []
        while t is not None:
            if name in t.vars:
                bound = t.vars[name]
                for p in passed:
                    p.note(bound)
                return bound
            passed.append(t)
            t = t.around
        return None

    def focused(self) -> Any:
        t, passed = self, []
        while t is not None:
            if t.focus is not None:
                for p in passed:
                    p.note(t.focus)
                return t.focus
            passed.append(t)
            t = t.around
        return None

    def note(self, bound: Any) -> None:
        if isinstance(bound, (Row, Node)):
            self.reached.add(bound.prefix)
        elif isinstance(bound, V):
            self.reached.add("value")

    def where(self, condition: Column) -> None:
        self.df = self.df.where(condition)

    def put(self, stem: str, col: Column) -> str:
        name = fresh(stem)
        self.df = self.df.withColumn(name, col)
        return name


@dataclass
class Relation:
    """A sequence as rows: tuples and the item of each."""

    tuples: Tuples
    item: Any

    @property
    def df(self) -> DataFrame:
        return self.tuples.df

    @property
    def links(self) -> list[Link]:
        return self.tuples.links

    def narrowed(self, to: Column) -> Relation:
        self.tuples.where(to)
        return self


def flat(df: DataFrame, stem: str, table: str | None = None) -> tuple[DataFrame, Row]:
    """A table's columns renamed under a prefix of their own."""
    prefix = fresh(stem) + "_"
    row = Row(prefix, {f.name: of_spark(f.dataType) for f in df.schema.fields}, table)
    return df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns)), row


def numbered(df: DataFrame, order: list[Column], name: str, folder: str) -> DataFrame:
    """``df`` with positions from 1, without a global window.

    The ordered rows are written to ``folder`` once, each with its partition and its place in it; positions are
    those places plus the sizes of the partitions before, of which there is one number for each partition. Were the
    rows not stored, the sizes and the rows would come from two runs of one plan, which adaptive execution may
    split into partitions differently.
    """
    spark = df.sparkSession
    held = {c: f"c{k}" for k, c in enumerate(df.columns) if not isinstance(df.schema[k].dataType, NullType)}
    rows = df.orderBy(*order) if order else df
    rows.select(*(F.col(f"`{c}`").alias(p) for c, p in held.items()), F.monotonically_increasing_id().alias("at")).write.parquet(folder)
    back = spark.read.parquet(folder)
    part = F.shiftrightunsigned("at", 33)
    sizes = sorted((r.part, r.n) for r in back.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    before = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))
    known = F.coalesce("_before", F.raise_error(F.lit("SE0003: rows of an unknown partition")).cast("bigint"))
    joined = back.withColumn("_part", part).join(before, "_part", "left")
    columns = [F.col(held[c]).alias(c) if c in held else F.lit(None).alias(c) for c in df.columns]
    return joined.select(*columns, (known + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
