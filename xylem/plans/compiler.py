"""From the tree of a query to DataFrames.

Scalar expressions become columns; sequences become relations. A correlated inner sequence (an inner FLWOR, a
path from a variable) is built on its own, with the conditions that reach outward kept aside as links. Where it
is used decides what the links become: join conditions, semi or anti joins, or a grouped aggregate that is
joined back, so nothing is evaluated once per tuple. Join selection, pushdown and pruning are Catalyst's.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.functions import library
from xylem.functions.values import GENERAL, INTEGERS, NUMERIC, SPARK, STRINGS, StaticError, V, all_tagged, arithmetic, array, base, cast, common, compare, concatenated, ebv, general, as_kind, lit, members, mixture, of_spark, promoted, settle, string, tagged
from xylem.plans.interpret import recursive_udf
from xylem.plans.parser import E, Step, Test, positional
from xylem.plans.relation import Link, Node, Relation, Row, Tuples, flat, fresh, numbered

SOURCES = {"collection", "doc", "document", "index-scan", "index-scan-between", "index-keys", "ftindex-scan", "ftscan", "ftwindex-scan", "ftindex-dict", "sql:execute", "id", "idref"}
KEEPERS = {"distinct-values", "reverse", "subsequence", "remove", "insert-before", "unordered", "filter_entry_level", "data", "root", "index-of", "one-or-more", "zero-or-one", "exactly-one", "trace"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "string-join", "exists", "empty", "not", "boolean", "deep-equal"}
FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass
class Static:
    """Static context: what the prolog declares."""

    functions: dict[tuple[str, int], tuple] = field(default_factory=dict)
    externals: dict[str, tuple] = field(default_factory=dict)
    variables: dict[str, Any] = field(default_factory=dict)
    namespaces: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)
    empty: str = "least"
    ordering: str = "ordered"
    base_uri: str = ""
    boundary_space: str = "strip"


@dataclass
class Lazy:
    """A let-bound sequence that is built where it is used, in the scope where it was bound."""

    tree: E
    scope: dict[str, Any]
    made: Relation | None = None

    def relation(self, build) -> Relation:
        """Built once; every use gets a copy, so that aggregates over one sequence can share a pass."""
        if self.made is None:
            self.made = build()
        made = self.made.tuples
        return Relation(replace(made, links=list(made.links), order=list(made.order), vars=dict(made.vars)), self.made.item)


class Compiler:
    def __init__(self, session, static: Static):
        self.session, self.static, self.spark = session, static, session.spark
        self.active: list[tuple[str, int]] = []
        self.opposites: dict[int, tuple[Column, Column]] = {}

    # ---- which expressions are relations

    def is_rel(self, e: Any, t: Tuples) -> bool:
        if not isinstance(e, E):
            return False
        if e.op == "call":
            name = e.info["name"]
            if name in SOURCES:
                return True
            if name in KEEPERS:
                return any(self.is_rel(a, t) for a in e.args[:1])
            known = self.static.functions.get((name, len(e.args)))
            return bool(known) and (name, len(e.args)) not in self.active and self.is_rel(known[1], Tuples(None, {p: Lazy(a, t.vars) for (p, _), a in zip(known[0], e.args, strict=True)}, around=t))
        if e.op == "var":
            bound = self.bound(e.args[0], t)
            return isinstance(bound, Lazy) or isinstance(bound, Relation)
        if e.op in ("paren", "ordered", "unordered", "pragma", "filter", "treat"):
            return self.is_rel(e.args[0], t)
        if e.op == "path":
            start = e.args[0]
            if self.is_rel(start, t) or start.op == "root":
                return True
            if start.op == "context":
                return isinstance(t.focused(), Node)
            if start.op == "var":
                return isinstance(self.bound(start.args[0], t), Node)
            return False
        if e.op == "flwor":
            return any(c[0] == "for" and (self.is_rel(c[2], t) or isinstance(c[2], E) and c[2].op == "range") for c in e.info["clauses"]) or self._lets_rel(e, t)
        if e.op in ("union", "intersect", "except", "seq"):
            return bool(e.args) and any(self.is_rel(a, t) for a in e.args)
        if e.op == "if":
            return any(self.is_rel(a, t) for a in e.args[1:])
        return False

    def _lets_rel(self, e: E, t: Tuples) -> bool:
        lets = [c for c in e.info["clauses"] if c[0] in ("let", "for")]
        inner = Tuples(None, {c[1]: Lazy(c[2], t.vars) for c in lets if c[0] == "let" and self.is_rel(c[2], t)}, around=t)
        return any(c[0] == "for" and self.is_rel(c[2], inner) for c in lets)

    def bound(self, name: str, t: Tuples) -> Any:
        found = t.find(name)
        if found is None:
            found = self.static.variables.get(name)
        if found is None:
            raise StaticError("XPST0008", f"${name} isn't bound")
        return found

    # ---- relations

    def relation(self, e: E, t: Tuples) -> Relation:
        """``e`` as rows; conditions on the tuples around are left in its links."""
        op = e.op
        if op in ("paren", "ordered", "pragma", "treat"):
            return self.relation(e.args[0], t)
        if op == "unordered":
            out = self.relation(e.args[0], t)
            out.tuples.order = []
            return out
        if op == "call":
            return self.call_relation(e, t)
        if op == "var":
            bound = self.bound(e.args[0], t)
            if isinstance(bound, Lazy):
                return bound.relation(lambda: self.relation(bound.tree, Tuples(t.df, bound.scope, t.focus, t.around) if bound.scope is not t.vars else t))
            if isinstance(bound, Relation):
                return Relation(replace(bound.tuples, links=list(bound.links)), bound.item)
            return self.exploded(self.value(e, t), t)
        if op == "filter":
            return self.filtered(self.relation(e.args[0], t), e.info["predicates"], t, None)
        if op == "path":
            return self.path(e, t)
        if op == "flwor":
            return self.flwor(e, t)
        if op in ("union", "intersect", "except"):
            return self.set_operation(e, t)
        if op == "seq":
            return self.sequence(e, t)
        if op == "if":
            test = ebv(self.value(e.args[0], t))
            yes, no = (self.relation(a, t) if self.is_rel(a, t) else None for a in e.args[1:])
            if yes and no is None and e.args[2].op == "seq" and not e.args[2].args:
                yes.links.append(Link(test)) if t.df is not None and t.vars else yes.narrowed(test)
                return yes
            raise StaticError("SE0001", "both branches of this conditional are relations")
        if op == "range":
            a, b = (self.value(x, self.one_row()) for x in e.args)
            df = self.one_row().df.select(F.explode(F.when(a.col <= b.col, F.sequence(a.col, b.col)).otherwise(F.array().cast("array<bigint>"))).alias(name := fresh("n")))
            if all(x.op == "lit" for x in e.args):
                low, high = (x.args[0] for x in e.args)
                df = self.spark.range(low, high + 1).select(F.col("id").alias(name))
            return Relation(Tuples(df, around=t, order=[F.col(name)]), V(F.col(name), "integer"))
        return self.exploded(self.value(e, t), t)

    def one_row(self) -> Tuples:
        return Tuples(self.spark.range(1).select(F.lit(1).alias(fresh("one"))), dict(self.static.variables))

    def exploded(self, v: V, t: Tuples) -> Relation:
        """A cell sequence as rows, beside the tuples it comes from."""
        own = t if t.df is not None else self.one_row()
        self.flush(own)
        item, pos = fresh("item"), fresh("pos")
        df = own.df.select("*", F.posexplode(array(v).col).alias(pos, item))
        return Relation(Tuples(df, dict(own.vars), own.focus, own.around, [*own.order, F.col(pos)]), V(F.col(item), v.type))

    def source(self, df: DataFrame, stem: str, table: str | None, t: Tuples) -> Relation:
        data, row = flat(df, stem, table)
        return Relation(Tuples(data, around=t), row)

    def call_relation(self, e: E, t: Tuples) -> Relation:
        name, args = e.info["name"], e.args
        if name in ("collection", "doc", "document"):
            title = self.constant(args[0], t)
            self.session.check("DOCUMENT" if name != "collection" else "COLLECTION", title)
            found = self.session.catalog.open(title, self.constant(args[1], t) if len(args) > 1 else None)
            if isinstance(found, DataFrame):
                return self.source(found, title, title, t)
            return self.nodes(found, found.frame(), t, F.col("kind") == "document")
        if name in ("index-scan", "index-scan-between", "index-keys", "ftindex-scan", "ftindex-dict", "ftwindex-scan"):
            return self.index_relation(name, args, t)
        if name == "ftscan":
            found = self.relation(args[0], t)
            from xylem.operators.fulltext import matches_query

            held, focus = found.tuples, found.item
            inner = Tuples(held.df, held.vars, focus, t)
            body = self.value(E("path", [E("context")], {"steps": [Step("self", Test("node"), [])]}), inner) if isinstance(focus, V) else None
            text = string(body) if body is not None else self.row_text(focus)
            parts = F.array(*(F.struct(F.lit(f"row/{c}").alias("path"), string(V(F.col(focus.prefix + c), k)).alias("text")) for c, (k, many) in focus.columns.items() if not many and k != "struct")) if isinstance(focus, Row) else None
            held.where(matches_query(text, self.constant(args[1], t), self.constant(args[2], t) if len(args) > 2 else "string-value", parts))
            return found
        if name == "sql:execute":
            query = self.constant(args[1], t)
            handle = self.constant(args[0], t)
            params = [self.literal(a, t) for a in args[2:]]
            return self.source(self.session.connector.execute(handle, query, params), "sql", None, t)
        if name in ("id", "idref"):
            found = self.relation(args[1], t) if len(args) > 1 else self.relation(E("root"), t)
            wanted = array(self.value(args[0], t))
            hits = self.axis(found, "descendant-attribute", Test("attribute"), t)
            hits.narrowed(F.exists(F.split(F.trim(hits.item.col("value")), r"\s+"), lambda x: F.array_contains(wanted.col, x)))
            local = F.lower(hits.item.col("local"))
            hits.narrowed(local.endswith("id") if name == "id" else local.contains("idref"))
            return self.settled(self.axis(hits, "parent", Test("element"), t), "parent")
        if name == "distinct-values":
            return self.distinct(args[0], t)
        if name in ("unordered", "trace", "one-or-more", "zero-or-one", "exactly-one", "data"):
            out = self.relation(args[0], t)
            if name == "data":
                out.item = self.atomized(out.item, out.tuples)
            return out
        if name == "reverse":
            out = self.relation(args[0], t)
            self.positioned(out)
            out.tuples.order = [self.paired(F.col(out.pos).desc(), F.col(out.pos).asc())]
            return out
        if name in ("subsequence", "remove", "insert-before"):
            out = self.relation(args[0], t)
            if name == "subsequence" and out.tuples.order and not out.links:
                first = max(1, self._round(args[1], t))
                stop = self._round(args[1], t) + self._round(args[2], t) if len(args) > 2 else None
                df = out.df.orderBy(*out.tuples.order)
                if stop is not None:
                    df = df.limit(max(0, stop - 1))
                out.tuples.df = df.offset(first - 1) if first > 1 else df
                return out
            self.positioned(out)
            at, place = self._round(args[1], t), F.col(out.pos)
            if name == "subsequence":
                out.tuples.where((place >= at) & (place < at + self._round(args[2], t) if len(args) > 2 else F.lit(True)))
            elif name == "remove":
                out.tuples.where(place != at)
            else:
                more = self.relation(args[2], t)
                self.positioned(more)
                return self.stacked([(out, F.when(place < at, F.lit(0)).otherwise(2)), (more, F.lit(1))], t)
            out.tuples.order = [place]
            return out
        if name == "index-of":
            out = self.relation(args[0], t)
            self.positioned(out)
            key = compare("eq", self.atomized(out.item, out.tuples), self.value(args[1], t), True)
            out.tuples.where(key.col)
            return Relation(out.tuples, V(F.col(out.pos), "integer"))
        if name == "filter_entry_level":
            from xylem.operators.axes import deepest

            out = self.relation(args[0], t)
            out.tuples.df = deepest(out.df, out.item.prefix)
            return out
        if name == "root":
            return self.settled(self.axis(self.relation(args[0], t), "ancestor-or-self", Test("document-node"), t), "ancestor")
        known = self.static.functions.get((name, len(args)))
        if known:
            return self.inlined(known, name, args, t, self.relation)
        return self.exploded(self.value(e, t), t)

    def _round(self, e: E, t: Tuples) -> int:
        import math

        return math.floor(float(self.literal(e, t)) + 0.5)

    def index_relation(self, name: str, args: list[E], t: Tuples) -> Relation:
        store = self.session.indexes
        title = self.constant(args[0], t)
        if name == "index-keys":
            return self.source_value(store.keys(title), "key", t)
        if name == "ftindex-dict":
            return self.source_value(self.session.fulltext.dictionary(title), "term", t)
        if name in ("ftindex-scan", "ftwindex-scan"):
            df = self.session.fulltext.scan(title, self.constant(args[1], t), self.constant(args[2], t) if len(args) > 2 else "")
            out = self.source(df, "ft", None, t)
            if "score" in df.columns:
                out.tuples.order, out.tuples.sorted = [F.col(out.item.prefix + "score").desc()], True
            return out
        if name == "index-scan":
            constant = self.is_constant(args[1], t)
            df, key = store.table(title)
            mode = self.constant(args[2], t)
            found = self.source(df, "ix", None, t)
            k = V(F.col(found.item.prefix + key), found.item.columns[key][0])
            want = self.value(args[1], t)
            cond = compare(mode.lower() if mode != "EQ" else "eq", k, cast(want, k.type) if base(want.type) != base(k.type) else want)
            if constant:
                return found.narrowed(cond.col)
            found.links.append(Link(cond.col, want.col, k.col) if mode == "EQ" else Link(cond.col))
            return found
        df, key = store.table(title)
        found = self.source(df, "ix", None, t)
        k = V(F.col(found.item.prefix + key), found.item.columns[key][0])
        low, high, mode = cast(self.value(args[1], t), k.type), cast(self.value(args[2], t), k.type), self.constant(args[3], t)
        left, right = {"INT": ("gt", "lt"), "SEG": ("ge", "le"), "HINTL": ("ge", "lt"), "HINTR": ("gt", "le")}[mode]
        return found.narrowed(compare(left, k, low).col & compare(right, k, high).col)

    def source_value(self, df: DataFrame, column: str, t: Tuples) -> Relation:
        out = self.source(df, "v", None, t)
        name = out.item.prefix + column
        return Relation(replace(out.tuples, order=[F.col(name)]), V(F.col(name), out.item.columns[column][0]))

    def distinct(self, e: E, t: Tuples) -> Relation:
        inner = self.relation(e, t)
        v = self.atomized(inner.item, inner.tuples)
        name = fresh("k")
        if inner.links:
            inner.tuples.df = inner.df.withColumn(name, v.col)
            return Relation(inner.tuples, V(F.col(name), v.type))
        df = inner.df.where(v.col.isNotNull()).select(v.col.alias(name)).distinct()
        out = Relation(Tuples(df, around=t, order=[F.col(name)]), V(F.col(name), v.type))
        out.tuples.distinct = self.signature(e)
        return out

    def signature(self, e: E) -> tuple | None:
        """(table, column) of ``collection("t")/row/c``."""
        if e.op == "path" and e.args[0].op == "call" and e.args[0].info["name"] == "collection" and e.args[0].args[0].op == "lit":
            steps = e.info["steps"]
            if len(steps) == 2 and all(isinstance(s, Step) and not s.predicates for s in steps):
                return e.args[0].args[0].args[0], steps[1].test.name
        return None

    def positioned(self, r: Relation) -> None:
        """Numbers the rows of ``r``, within each outer tuple if it has links."""
        name = fresh("pos")
        order = r.tuples.order or [F.monotonically_increasing_id()]
        if r.links:
            keys = [x.inner for x in r.links if x.inner is not None]
            if not r.tuples.order:
                r.tuples.df = r.df.withColumn(seen := fresh("seen"), F.monotonically_increasing_id())
                order = [F.col(seen)]
            r.tuples.df = r.df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        else:
            r.tuples.df = numbered(r.df, r.tuples.order, name, self.session.fresh_folder("numbered"))
        r.pos = name

    def filtered(self, r: Relation, predicates: list[E], t: Tuples, focus: list[Column] | None) -> Relation:
        """``r[p]...``; ``focus``: columns that tell the contexts of a step apart, None for a whole sequence."""
        for p in predicates:
            if positional(p) or p.op == "range":
                r = self.placed(r, p, t, focus)
            else:
                own = Tuples(r.df, r.tuples.vars, r.item, t)
                own.links, own.order = r.links, r.tuples.order
                self.restrict(p, own)
                r.tuples.df, r.tuples.links = own.df, own.links
        return r

    def placed(self, r: Relation, p: E, t: Tuples, focus: list[Column] | None) -> Relation:
        low, high = self.bounds(p)
        if focus is None and not r.links and r.tuples.order and low is not None and (p.op != "call"):
            df = r.df.orderBy(*r.tuples.order)
            if high is not None:
                df = df.limit(max(0, high))
            r.tuples.df = df.offset(low - 1) if low > 1 else df
            return r
        if focus is None and not r.links and p.op == "call" and p.info["name"] == "last" and r.tuples.order:
            r.tuples.df = r.df.orderBy(*(self.turned(c) for c in r.tuples.order)).limit(1)
            return r
        keys = focus if focus is not None else [x.inner for x in r.links if x.inner is not None]
        if focus is None and not keys:
            self.positioned(r)
            pos, last = V(F.col(r.pos), "integer"), None
        else:
            order = r.tuples.order
            if not order:
                r.tuples.df = r.df.withColumn(seen := fresh("seen"), F.monotonically_increasing_id())
                order = [F.col(seen)]
            window = Window.partitionBy(*keys)
            r.tuples.df = r.df.withColumn(at := fresh("pos"), F.row_number().over(window.orderBy(*order)).cast("bigint"))
            last = None
            if uses_last(p):
                r.tuples.df = r.df.withColumn(size := fresh("last"), F.count(F.lit(1)).over(window))
                last = V(F.col(size), "integer")
            pos = V(F.col(at), "integer")
        if last is None and uses_last(p):
            total = r.df.agg(F.count(F.lit(1)).alias(size := fresh("last")))
            r.tuples.df = r.df.crossJoin(F.broadcast(total))
            last = V(F.col(size), "integer")
        own = Tuples(r.df, r.tuples.vars, r.item, t)
        own.vars = {**own.vars, "fs:position": pos, "fs:last": last}
        v = self.value(p, own)
        self.flush(own)
        r.tuples.df = own.df
        r.tuples.where(compare("eq", pos, v).col if base(v.type) in NUMERIC else ebv(v))
        return r

    def turned(self, c: Column) -> Column:
        """The opposite of a sort key; a bare column sorts upward."""
        return self.opposites[id(c)][1] if id(c) in self.opposites else c.desc()

    def paired(self, key: Column, opposite: Column) -> Column:
        self.opposites[id(key)] = key, opposite
        return key

    def bounds(self, p: E) -> tuple[int | None, int | None]:
        """Positions that a predicate keeps, if they are one constant range."""
        if p.op == "paren":
            return self.bounds(p.args[0])
        if p.op == "lit" and isinstance(p.args[0], int):
            return p.args[0], p.args[0]
        if p.op in ("general", "value") and isinstance(p.args[0], E) and p.args[0].op == "call" and p.args[0].info["name"] == "position" and p.args[1].op == "lit":
            n = p.args[1].args[0]
            sign = {"eq": "=", "le": "<=", "lt": "<", "ge": ">=", "gt": ">"}.get(p.info["sign"], p.info["sign"])
            return {"=": (n, n), "<=": (1, n), "<": (1, n - 1), ">=": (n, None), ">": (n + 1, None)}.get(sign, (None, None))
        if p.op == "and":
            (a, b), (c, d) = map(self.bounds, p.args)
            return (None, None) if a is None or c is None else (max(a, c), min((x for x in (b, d) if x is not None), default=None))
        return None, None

    def set_operation(self, e: E, t: Tuples) -> Relation:
        a, b = (self.relation(x, t) for x in e.args)
        if isinstance(a.item, V) or isinstance(b.item, V):
            if not (getattr(a.item, "name", None) and getattr(b.item, "name", None)):
                raise StaticError("XPTY0004", f"{e.op} needs nodes")
            name = fresh("u")
            x, y = (r.df.where(r.item.col.isNotNull()).select(r.item.col.alias(name)) for r in (a, b))
            df = x.union(y).distinct() if e.op == "union" else x.intersect(y) if e.op == "intersect" else x.subtract(y)
            return Relation(Tuples(df, around=t), V(F.col(name), a.item.type, name=a.item.name))
        if isinstance(a.item, Row):
            x, y = a.df.select(*a.item.names()), b.df.select(*(F.col(b.item.prefix + c).alias(a.item.prefix + c) for c in a.item.columns))
            df = x.unionByName(y).distinct() if e.op == "union" else x.intersect(y) if e.op == "intersect" else x.subtract(y)
            return Relation(Tuples(df, around=t), a.item)
        x, y = a.df.select(*a.item.names()), b.df.select(*(F.col(b.item.prefix + c).alias(a.item.prefix + c) for c in Node.COLUMNS))
        key = [a.item.prefix + c for c in ("doc_id", "pre")]
        df = x.unionByName(y).dropDuplicates(key) if e.op == "union" else x.join(y.select(*key), key, "left_semi" if e.op == "intersect" else "left_anti").dropDuplicates(key)
        return Relation(Tuples(df, around=t, order=[F.col(k) for k in key]), a.item)

    def sequence(self, e: E, t: Tuples) -> Relation:
        return self.stacked([(self.relation(a, t), F.lit(k)) for k, a in enumerate(e.args)], t)

    def stacked(self, parts: list[tuple[Relation, Column]], t: Tuples) -> Relation:
        """Concatenation, ordered by branch and then within it."""
        values = [self.atomized(r.item, r.tuples) for r, _ in parts]
        kind, branch, place, item = mixture(values), fresh("branch"), fresh("place"), fresh("item")
        frames = []
        for (r, k), v in zip(parts, values, strict=True):
            if not hasattr(r, "pos"):
                self.positioned(r)
            frames.append(r.df.select(k.alias(branch), F.col(r.pos).cast("bigint").alias(place), as_kind(v, kind).alias(item)))
        return Relation(Tuples(reduce(DataFrame.unionByName, frames), around=t, order=[F.col(branch), F.col(place)]), V(F.col(item), kind))

    # ---- paths

    def path(self, e: E, t: Tuples) -> Relation:
        start, steps = e.args[0], e.info["steps"]
        if start.op in ("var", "context", "root") and not self.is_rel(start, t):
            bound = self.bound(start.args[0], t) if start.op == "var" else t.focused()
            if isinstance(bound, Node):
                step = Step("ancestor-or-self", Test("document-node"), []) if start.op == "root" else steps[0]
                first = self.axis_from(bound, step, t)
                return self.walk(first, steps if start.op == "root" else steps[1:], t)
            return self.exploded(self.value(e, t), t)
        if start.op == "call" and start.info["name"] in ("collection", "doc", "document"):
            found = self.absolute(start, steps, t)
            if found:
                return self.walk(found[0], steps[found[1] :], t)
        return self.walk(self.relation(start, t), steps, t)

    def absolute(self, start: E, steps: list, t: Tuples) -> tuple[Relation, int] | None:
        """The longest prefix of downward steps without predicates, as one scan of the stored paths that it matches."""
        title = self.constant(start.args[0], t)
        self.session.check("DOCUMENT" if start.info["name"] != "collection" else "COLLECTION", title)
        store = self.session.catalog.open(title, self.constant(start.args[1], t) if len(start.args) > 1 else None)
        if isinstance(store, DataFrame):
            return None
        pattern, taken = "", 0
        for step in steps:
            part = one_path(step)
            if part is None:
                break
            pattern, taken = pattern + part, taken + 1
            if step.predicates:
                break
        if not taken:
            return None
        last = steps[taken - 1]
        out = self.nodes(store, store.at_path(pattern), t)
        if last.predicates:
            if any(positional(p) for p in last.predicates) and last.axis != "child":
                return None
            out = self.filtered(out, last.predicates, t, [out.item.col("doc_id"), out.item.col("parent")])
        return out, taken

    def walk(self, r: Relation, steps: list, t: Tuples) -> Relation:
        for step in steps:
            if isinstance(step, E):
                own = Tuples(r.df, r.tuples.vars, r.item, t, r.tuples.order, r.links)
                if self.is_rel(step, own):
                    r = self.relation(step, own)
                else:
                    v = self.value(step, own)
                    self.flush(own)
                    r = Relation(replace(r.tuples, df=own.df), v)
                continue
            if isinstance(r.item, Row):
                r = self.row_step(r, step, t)
            elif isinstance(r.item, Node):
                if step.axis in ("following", "preceding", "ancestor", "ancestor-or-self", "descendant", "descendant-or-self", "following-sibling", "preceding-sibling") and not (r.tuples.vars or r.links or r.tuples.waiting) and not any(positional(p) for p in step.predicates):
                    r = self.filtered(self.beyond(r, step.axis, step.test, t), step.predicates, t, None)
                    continue
                key = [r.item.col("doc_id"), r.item.col("pre")]
                r = self.settled(self.filtered(self.axis(r, step.axis, step.test, t), step.predicates, t, key if step.predicates else None), step.axis)
            elif isinstance(r.item, V) and step.axis == "self":
                r = self.filtered(r, step.predicates, t, None)
            else:
                raise StaticError("XPTY0019", "a step needs nodes")
        return r

    def row_step(self, r: Relation, step: Step, t: Tuples) -> Relation:
        row: Row = r.item
        if step.test.name == "row" and step.axis in ("child", "descendant") or step.axis == "self" or (step.test.name is None and step.test.kind in ("element", "node") and "row" not in row.columns and step.axis == "child" and not getattr(r, "inside", False)):
            r.inside = True
            return self.filtered(r, step.predicates, t, None)
        v = self.column(row, step.test)
        out = Relation(r.tuples, v)
        if v.many:
            name, pos = fresh("item"), fresh("pos")
            out.tuples.df = out.df.select("*", F.posexplode(v.col).alias(pos, name))
            out.item = v.but(F.col(name), many=False)
        else:
            out.tuples.where(v.col.isNotNull())
        return self.filtered(out, step.predicates, t, None)

    def column(self, row: Row, test: Test) -> V:
        name = (test.name or "").split(":")[-1]
        if name not in row.columns:
            if not test.name and test.kind in ("element", "attribute", "node"):
                parts = [string(V(F.col(row.prefix + c), k)) for c, (k, many) in row.columns.items() if not many]
                return V(F.filter(F.array(*parts), lambda x: x.isNotNull()), "untyped", True)
            if test.kind == "text":
                return V(self.row_text(row), "untyped")
            raise StaticError("XPST0005", f"no such part: {test.name}")
        kind, many = row.columns[name]
        return V(F.col(row.prefix + name), kind, many, name=name)

    def row_text(self, row: Row) -> Column:
        return F.concat_ws(" ", *(string(V(F.col(row.prefix + c), k)) for c, (k, many) in row.columns.items() if not many and k != "struct"))

    def nodes(self, store, frame: DataFrame, t: Tuples, condition: Column | None = None) -> Relation:
        frame = frame if condition is None else frame.where(condition)
        prefix = fresh("n") + "_"
        node = Node(prefix, store)
        df = frame.select(*(F.col(c).alias(prefix + c) for c in Node.COLUMNS))
        return Relation(Tuples(df, around=t, order=[node.col("doc_id"), node.col("pre")]), node)

    def axis(self, r: Relation, axis: str, test: Test, t: Tuples) -> Relation:
        """One step from the nodes of ``r``, in document order without duplicates."""
        from xylem.operators.axes import related, tested

        c: Node = r.item
        hit = self.nodes(c.store, tested(c.store.frame(axis, test), test, "attribute" if "attribute" in axis else "element", axis), t)
        joined = r.df.join(hit.df, related(axis, c, hit.item))
        return Relation(replace(r.tuples, df=joined, order=[hit.item.col("doc_id"), hit.item.col("pre")]), hit.item)

    def beyond(self, r: Relation, axis: str, test: Test, t: Tuples) -> Relation:
        """A step along a wide axis of which only the nodes reached matter."""
        from xylem.operators.axes import beside, beyond, reached, tested

        c: Node = r.item
        sibling = axis.endswith("sibling")
        contexts = r.df.select(*(c.col(k).alias(k) for k in (("doc_id", "pre", "parent", "kind") if sibling else ("doc_id", "pre", "size"))))
        find = beside if sibling else beyond if axis in ("following", "preceding") else reached
        return self.nodes(c.store, find(tested(c.store.frame(axis, test), test, "element", axis), contexts, axis), t)

    def settled(self, r: Relation, axis: str) -> Relation:
        """A step's result without the columns of its contexts; each node once, unless the axis reaches none twice."""
        if r.tuples.vars:
            return r
        reached = set().union(*(names_of(x.condition) for x in r.links), *(names_of(x.inner) for x in r.links if x.inner is not None)) if r.links else set()
        kept = [c for c in r.df.columns if c in reached and c not in r.item.names()]
        df = r.df.select(*kept, *r.item.names())
        if axis not in ("child", "attribute", "self"):
            df = df.dropDuplicates([*kept, r.item.prefix + "doc_id", r.item.prefix + "pre"])
        return Relation(replace(r.tuples, df=df), r.item)

    def axis_from(self, node: Node, step: Step, t: Tuples) -> Relation:
        """One step from a variable: the join with its tuples is left as links."""
        from xylem.operators.axes import related, tested

        hit = self.nodes(node.store, tested(node.store.frame(step.axis, step.test), step.test, "attribute" if "attribute" in step.axis else "element", step.axis), t)
        hit.links.append(Link(node.col("doc_id") == hit.item.col("doc_id"), node.col("doc_id"), hit.item.col("doc_id")))
        if step.axis in ("child", "attribute"):
            hit.links.append(Link(node.col("pre") == hit.item.col("parent"), node.col("pre"), hit.item.col("parent")))
        else:
            hit.links.append(Link(related(step.axis, node, hit.item)))
        if any(positional(p) for p in step.predicates) and step.axis not in ("child", "attribute"):
            return self.filtered(self.joined_from(node, hit, t), step.predicates, t, [node.col("doc_id"), node.col("pre")])
        return self.filtered(hit, step.predicates, t, None)

    def joined_from(self, node: Node, hit: Relation, t: Tuples) -> Relation:
        """Positions along a wide axis need the contexts themselves: they are joined in once."""
        around = t
        while around.df is None or node.prefix + "pre" not in around.df.columns:
            around = around.around
        own = Node(fresh("c") + "_", node.store)
        condition = reduce(operator.and_, (x.condition for x in hit.links))
        mapped = hit.df.join(around.df.select(*node.names()).distinct(), condition)
        mapped = mapped.select(*hit.df.columns, *(F.col(c).alias(own.prefix + c.removeprefix(node.prefix)) for c in node.names()))
        links = [Link(node.col(k) == own.col(k), node.col(k), own.col(k)) for k in ("doc_id", "pre")]
        return Relation(replace(hit.tuples, df=mapped, links=links), hit.item)

    # ---- FLWOR

    def flwor(self, e: E, t: Tuples) -> Relation:
        own = Tuples(None, {}, None, t)
        for kind, name, body, at, declared in e.info["clauses"]:
            if kind == "for":
                self.bind_for(own, name, body, at, t)
            elif kind == "let":
                self.bind_let(own, name, body, declared)
            elif kind == "where":
                if own.df is None:
                    own.df = self.one_row().df
                self.restrict(body, own)
            else:
                own.order = [self.sort_key(k, down, low, own) for k, down, low in body]
                own.sorted = True
        if own.df is None:
            own.df = self.one_row().df
        body = e.args[0]
        if self.is_rel(body, own):
            inner = self.relation(body, own)
            order = own.order + inner.tuples.order
            return Relation(self.joined(own, inner, order), inner.item)
        v = self.value(body, own)
        if isinstance(v, (Row, Node)):
            return Relation(own, v)
        self.flush(own)
        if v.many:
            item, pos = fresh("item"), fresh("pos")
            own.df = own.df.select("*", F.posexplode(v.col).alias(pos, item))
            own.order = [*own.order, F.col(pos)] if own.order else []
            v = V(F.col(item), v.type)
        elif not v.fields:
            own.where(v.col.isNotNull())
        return Relation(own, v)

    def bind_for(self, own: Tuples, name: str, body: E, at: str | None, t: Tuples) -> None:
        scope = own if own.df is not None or own.vars else t
        if not self.is_rel(body, scope) and body.op != "range":
            if own.df is None:
                own.df = self.one_row().df
            v = self.value(body, own)
            self.flush(own)
            item, pos = fresh(name), fresh("pos")
            own.df = own.df.select("*", F.posexplode(array(v).col).alias(pos, item))
            own.vars[name] = V(F.col(item), v.type, fields={}, name=v.name)
            own.order = [*own.order, F.col(pos)]
            if at:
                own.vars[at] = V((F.col(pos) + 1).cast("bigint"), "integer")
            return
        probe = Tuples(None, {}, None, own)
        inner = self.relation(body, probe)
        if at:
            self.positioned(inner)
            inner.tuples.vars[at] = V(F.col(inner.pos).cast("bigint"), "integer")
        if own.df is None:
            own.df, own.order, own.sorted, own.distinct = inner.df, inner.tuples.order, inner.tuples.sorted, inner.tuples.distinct
            own.links += inner.links
            if inner.links and t is not None:
                own.reached |= inner.tuples.reached
        else:
            merged = self.joined(own, inner, own.order + inner.tuples.order)
            own.df, own.order, own.links, own.distinct = merged.df, merged.order, merged.links, None
        own.vars[name] = inner.item
        if at:
            own.vars[at] = inner.tuples.vars[at]

    def joined(self, own: Tuples, inner: Relation, order: list[Column]) -> Tuples:
        """The tuples with the inner rows beside them; links that reach further out are kept."""
        self.flush(own)
        have = set(own.df.columns) | set(inner.df.columns)
        near, far = [], []
        for link in inner.links:
            (near if names_of(link.condition) <= have else far).append(link)
        df = own.df.join(inner.df, reduce(operator.and_, (x.condition for x in near))) if near else own.df.crossJoin(inner.df)
        return replace(own, df=df, order=order, links=own.links + far)

    def bind_let(self, own: Tuples, name: str, body: E, declared) -> None:
        if self.is_rel(body, own):
            own.vars[name] = Lazy(body, dict(own.vars))
            return
        if own.df is None:
            own.df = self.one_row().df
        v = self.value(body, own)
        if isinstance(v, V) and not v.fields:
            self.flush(own)
            v = replace(v, col=F.col(own.put(name.replace(":", "_"), v.col)))
        own.vars[name] = v

    def sort_key(self, key: E, down: bool, low: str | None, own: Tuples) -> Column:
        v = settle(self.one(self.value(key, own), own))
        self.flush(own)
        c = string(v) if v.type == "untyped" else v.col
        nulls_low = (low or self.static.empty) == "least"
        up, back = (c.asc_nulls_first(), c.desc_nulls_last()) if nulls_low else (c.asc_nulls_last(), c.desc_nulls_first())
        return self.paired(back, up) if down else self.paired(up, back)

    # ---- conditions

    def restrict(self, e: E, own: Tuples, negate: bool = False) -> None:
        """Keeps the tuples for which ``e`` holds: conjuncts become filters, links, semi joins or anti joins."""
        if e.op == "paren":
            return self.restrict(e.args[0], own, negate)
        if e.op == "and" and not negate or e.op == "or" and negate:
            for a in e.args:
                self.restrict(a, own, negate)
            return None
        if e.op == "call" and e.info["name"] in ("not", "boolean") and len(e.args) == 1:
            return self.restrict(e.args[0], own, negate != (e.info["name"] == "not"))
        if e.op == "call" and e.info["name"] in ("exists", "empty") and self.is_rel(e.args[0], own):
            return self.semi(self.relation(e.args[0], Tuples(None, {}, None, own)), own, negate != (e.info["name"] == "empty"))
        if self.is_rel(e, own):
            return self.semi(self.relation(e, Tuples(None, {}, None, own)), own, negate)
        if e.op == "quant":
            every = e.info["kind"] == "every"
            if any(self.is_rel(b[1], own) for b in e.info["binds"]):
                inner = Tuples(None, {}, None, own)
                for name, body, _, _ in e.info["binds"]:
                    self.bind_for(inner, name, body, None, own)
                self.restrict(e.args[0], inner, every)
                return self.semi(Relation(inner, None), own, negate != every)
        if e.op == "general":
            a, b = e.args
            sign = e.info["sign"]
            if self.is_rel(b, own) and not self.is_rel(a, own):
                a, b, sign = b, a, FLIP[sign]
            if self.is_rel(a, own):
                inner = self.relation(a, Tuples(None, {}, None, own))
                if self.is_rel(b, own):
                    other = self.relation(b, Tuples(None, {}, None, own))
                    x, y = self.atomized(inner.item, inner.tuples), self.atomized(other.item, other.tuples)
                    merged = replace(inner.tuples, df=inner.df.join(other.df, general(sign, x, y).col), links=inner.links + other.links)
                    return self.semi(Relation(merged, None), own, negate)
                x, y = self.atomized(inner.item, inner.tuples), self.value(b, own)
                self.flush(own)
                condition = F.exists(y.col, lambda i: general(sign, x, V(i, y.type)).col) if y.many else compare({"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}[sign], x, y, True).col
                inner.links.append(Link(condition, y.col, x.col) if sign == "=" and not y.many and base(x.type) == base(y.type) else Link(condition))
                return self.semi(inner, own, negate)
        self.compared(e, own, negate)
        return None

    def compared(self, e: E, own: Tuples, negate: bool) -> None:
        """A plain condition: a filter, or a link if it reaches outward."""
        condition = ~ebv(self.value(e, own)) if negate else self.test(e, own)
        self.flush(own)
        have = set(own.df.columns)
        if names_of(condition) <= have:
            own.where(condition)
            return
        link = Link(condition)
        if not negate and e.op in ("general", "value") and e.info["sign"] in ("=", "eq"):
            x, y = (self.one(self.value(a, own), own) for a in e.args)
            for a, b in ((x, y), (y, x)):
                if base(x.type) == base(y.type) and names_of(a.col) <= have and not names_of(b.col) & have:
                    link = Link(x.col == y.col, b.col, a.col)
        if not negate and e.op in ("general", "value") and GENERAL.get(e.info["sign"], e.info["sign"]) in ("lt", "le", "gt", "ge"):
            x, y = (self.one(self.raw(a, own), own) for a in e.args)
            sign = GENERAL.get(e.info["sign"], e.info["sign"])
            p, q, kind = promoted(x, y)
            if not members(x.type) and not members(y.type) and kind in [*NUMERIC, "date", "dateTime"] and x.tz is None and y.tz is None:
                for a, b, s in ((p, q, sign), (q, p, {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}[sign])):
                    if names_of(a) <= have and not names_of(b) & have:
                        link.ranged = s, a, b
        own.links.append(link)

    def test(self, e: E, own: Tuples) -> Column:
        """A condition for a filter, where null is as good as false: kept bare, so that it can reach the scan."""
        if e.op == "paren":
            return self.test(e.args[0], own)
        if e.op in ("and", "or"):
            a, b = (self.test(x, own) for x in e.args)
            return a & b if e.op == "and" else a | b
        if e.op in ("general", "value") and not any(self.is_rel(a, own) for a in e.args):
            a, b = (self.raw(x, own) for x in e.args)
            if e.op == "value":
                a, b = self.one(a, own), self.one(b, own)
            if not a.many and not b.many and "empty" not in (a.type, b.type):
                return compare(GENERAL.get(e.info["sign"], e.info["sign"]), a, b, e.op == "general").col
        return ebv(self.truth(e, own))

    def semi(self, inner: Relation, own: Tuples, negate: bool) -> None:
        self.flush(own)
        kind = "left_anti" if negate else "left_semi"
        have = set(own.df.columns) | set(inner.df.columns)
        if any(not names_of(x.condition) <= have for x in inner.links):
            raise StaticError("SE0002", "a condition reaches over two levels")
        condition = reduce(operator.and_, (x.condition for x in inner.links)) if inner.links else F.lit(True)
        own.df = own.df.join(inner.df, condition, kind)

    # ---- aggregates of relations

    def aggregate(self, inner: Relation, t: Tuples, make, kind: str, empty: Column | None, many: bool = False, fold: tuple | None = None) -> V:
        """An aggregate over an inner relation as a column of ``t``; ``empty``: what it is over no rows; ``fold``: (of
        rows, of parts, at last) if it can be made of aggregates of parts."""
        name = fresh("agg")
        if t.df is None:
            t.df = self.one_row().df
        t.waiting.append((inner, make.alias(name), (name, *fold) if fold else None))
        return V(F.col(name) if empty is None else F.coalesce(F.col(name), empty), kind, many)

    def flush(self, t: Tuples) -> None:
        """Joins waiting aggregates to the tuples; those over the same rows and links share one pass."""
        passes: dict[tuple, tuple[Relation, list[Column], list]] = {}
        for inner, make, fold in t.waiting:
            same = (id(inner.df), *((str(x.condition), str(x.inner), str(x.outer)) for x in inner.links))
            held = passes.setdefault(same, (inner, [], []))
            held[1].append(make), held[2].append(fold)
        t.waiting.clear()
        for inner, make, folds in passes.values():
            links = inner.links
            if not links:
                t.df = t.df.crossJoin(F.broadcast(inner.df.agg(*make)))  # one row
            elif all(x.inner is not None for x in links):
                keys = [fresh("key") for _ in links]
                sums = inner.df.groupBy(*(x.inner.alias(k) for x, k in zip(links, keys, strict=True))).agg(*make)
                if t.distinct and len(links) == 1 and getattr(inner, "grouped", None) == t.distinct and len(t.df.columns) == 1:
                    key = t.df.columns[0]
                    t.df = sums.withColumnRenamed(keys[0], key).where(F.col(key).isNotNull())  # the distinct values are its groups
                    continue
                t.df = t.df.join(sums, reduce(operator.and_, (x.outer == F.col(k) for x, k in zip(links, keys, strict=True))), "left").drop(*keys)
            elif len(links) == 1 and links[0].ranged and all(folds):
                self.folded(t, inner.df, *links[0].ranged, folds)
            else:
                have = set(t.df.columns)
                used = sorted(set().union(*(names_of(x.condition) for x in links)) & have)
                pairs = t.df.select(*used).distinct().join(inner.df, reduce(operator.and_, (x.condition for x in links)))
                keys = [fresh("key") for _ in used]
                sums = pairs.groupBy(*(F.col(u).alias(k) for u, k in zip(used, keys, strict=True))).agg(*make)
                t.df = t.df.join(sums, reduce(operator.and_, (F.col(u).eqNullSafe(F.col(k)) for u, k in zip(used, keys, strict=True))), "left").drop(*keys)

    def folded(self, t: Tuples, df: DataFrame, sign: str, inner: Column, outer: Column, folds: list[tuple]) -> None:
        """Aggregates over the rows whose ``inner`` side is less (or more) than a tuple's ``outer`` side, without making pairs.

        Rows are aggregated by value. Quantiles cut the values of both sides into ranges; within a range aggregates
        run along the sorted values, and what the ranges before it hold, one row for each range, is added.
        """
        at = t.put("at", outer)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        names = [fresh("fold") for _ in folds]
        kind = df.select(inner.alias("v")).schema["v"].dataType
        real = (lambda c: ~F.isnan(c) & c.isNotNull()) if kind.simpleString() in ("double", "float") else (lambda c: c.isNotNull())
        rows = df.groupBy(inner.alias("v")).agg(*(rule(None).alias(n) for (_, rule, *_), n in zip(folds, names, strict=True))).where(real(F.col("v")))
        wanted = t.df.select(F.col(at).alias("v")).distinct().where(real(F.col("v")))
        both = rows.withColumn("side", F.lit(0)).unionByName(wanted.withColumn("side", F.lit(1)), allowMissingColumns=True)
        cuts = both.agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 1000)).first()[0] if parts > 1 else None
        literal = F.array(*(F.lit(c).cast(kind) for c in sorted(set(cuts)))) if cuts else F.array().cast(f"array<{kind.simpleString()}>")
        both = both.withColumn("range", F.size(F.filter(literal, lambda c: c < F.col("v"))))
        up = sign in ("lt", "le")
        tie = F.col("side").asc() if sign in ("le", "ge") else F.col("side").desc()  # equal rows come first only if they count
        along = Window.partitionBy("range").orderBy(F.col("v").asc() if up else F.col("v").desc(), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = both.groupBy("range").agg(*(merge(n).alias(n) for (_, _, merge, _), n in zip(folds, names, strict=True)))
        across = Window.orderBy(F.col("range").asc() if up else F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        before = whole.select("range", *(merge(n).over(across).alias(f"{n}_before") for (_, _, merge, _), n in zip(folds, names, strict=True)))
        run = both.select("v", "side", "range", *(merge(n).over(along).alias(n) for (_, _, merge, _), n in zip(folds, names, strict=True))).where("side = 1")
        ends = run.join(F.broadcast(before), "range", "left")
        made = []
        for (name, _, merge, finish), n in zip(folds, names, strict=True):
            a, b = F.col(n), F.col(f"{n}_before")
            made.append(finish({"sum": F.coalesce(a + b, a, b), "min": F.least(a, b), "max": F.greatest(a, b)}[merge.__name__]).alias(name))
        key = fresh("key")
        t.df = t.df.join(ends.select(F.col("v").alias(key), *made), F.col(at) == F.col(key), "left").drop(key, at)

    def column_of(self, e: E, t: Tuples) -> Relation | None:
        """``$v/column`` of a let-bound table sequence, nulls kept: aggregates pass over them."""
        if e.op == "path" and e.args[0].op == "var" and len(e.info["steps"]) == 1:
            bound, step = self.bound(e.args[0].args[0], t), e.info["steps"][0]
            if isinstance(bound, Lazy) and isinstance(step, Step) and not step.predicates and step.test.name:
                inner = self.relation(e.args[0], Tuples(None, {}, None, t))
                if isinstance(inner.item, Row) and step.test.name in inner.item.columns and not inner.item.columns[step.test.name][1]:
                    return Relation(inner.tuples, self.column(inner.item, step.test))
        return None

    def call_aggregate(self, name: str, args: list[E], t: Tuples) -> V:
        inner = self.column_of(args[0], t) if name in ("sum", "avg", "min", "max") else None
        inner = inner or self.relation(args[0], Tuples(None, {}, None, t))
        inner.grouped = self.grouping(args[0], t)
        if name == "count":
            return self.aggregate(inner, t, F.count(F.lit(1)), "integer", F.lit(0).cast("bigint"), fold=(lambda _: F.count(F.lit(1)), F.sum, lambda c: c.cast("bigint")))
        if name in ("exists", "empty", "boolean", "not"):
            some = self.aggregate(inner, t, F.count(F.lit(1)) > 0, "boolean", F.lit(False), fold=(lambda _: F.count(F.lit(1)), F.sum, lambda c: c > 0))
            return V(~some.col, "boolean") if name in ("empty", "not") else some
        v = self.atomized(inner.item, inner.tuples)
        if name == "string-join":
            sep = self.value(args[1], t)
            made = F.transform(F.array_sort(F.collect_list(F.struct(*(self.sort_struct(inner)), string(v).alias("s")))), lambda x: x["s"])
            joined = self.aggregate(inner, t, made, "string", F.array().cast("array<string>"), True)
            return V(F.call_function("array_join", joined.col, library.text(sep)), "string")
        v = settle(v)
        if v.type == "untyped":
            v = cast(v, "double")
        k = base(v.type)
        if name in ("sum", "avg") and k not in [*NUMERIC, "empty", "dayTimeDuration", "yearMonthDuration"]:
            raise StaticError("FORG0006", f"no {name} of xs:{v.type}")
        if name == "sum":
            zero = cast(self.value(args[1], t), k).col if len(args) > 1 else F.lit(0).cast(SPARK[k])
            return self.aggregate(inner, t, F.sum(v.col).cast(SPARK[k]), k, zero, fold=(lambda _: F.sum(v.col), F.sum, lambda c: c.cast(SPARK[k])) if k in NUMERIC else None)
        if name == "avg":
            if k in ("integer", "decimal"):
                return self.aggregate(inner, t, (F.sum(v.col.cast("decimal(28,10)")) / F.count(v.col)).cast("decimal(38,12)"), "decimal", None)
            return self.aggregate(inner, t, F.avg(v.col), k, None)
        pick = F.max(v.col) if name == "max" else F.min(v.col)
        if name == "min" and k in ("double", "float"):
            pick = F.when(F.max(F.isnan(v.col)), float("nan")).otherwise(pick)
        fold = (lambda _: pick, F.max if name == "max" else F.min, lambda c: c) if k not in ("double", "float") or name == "max" else None
        return self.aggregate(inner, t, pick, k, None, fold=fold)

    def sort_struct(self, r: Relation) -> list[Column]:
        """What a collected sequence is sorted by: the place of each row among those of its outer tuple."""
        order, keys = r.tuples.order, [x.inner for x in r.links if x.inner is not None]
        if not order:
            return [F.col(r.tuples.put("seen", F.monotonically_increasing_id()))]
        if keys:
            return [F.col(r.tuples.put("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))))]
        self.positioned(r)
        return [F.col(r.pos)]

    def grouping(self, e: E, t: Tuples) -> tuple | None:
        """(table, column) if ``e`` is all rows of a table whose column equals the tuple's one value."""
        while e.op in ("paren",) or e.op == "var" and isinstance(self.bound(e.args[0], t), Lazy):
            e = e.args[0] if e.op == "paren" else self.bound(e.args[0], t).tree
        if e.op == "path" and e.args[0].op == "var" and isinstance(self.bound(e.args[0].args[0], t), Lazy):
            return self.grouping(self.bound(e.args[0].args[0], t).tree, t)
        if e.op == "path" and e.args[0].op == "call" and e.args[0].info["name"] == "collection":
            row = e.info["steps"][0]
            if isinstance(row, Step) and row.test.name == "row" and len(row.predicates) == 1 and not any(s.predicates for s in e.info["steps"][1:] if isinstance(s, Step)):
                p = row.predicates[0]
                if p.op in ("general", "value") and p.info["sign"] in ("=", "eq"):
                    for x, y in (p.args, p.args[::-1]):
                        if x.op == "path" and x.args[0].op == "context" and len(x.info["steps"]) == 1 and y.op == "var":
                            return e.args[0].args[0].args[0], x.info["steps"][0].test.name
        return None

    # ---- scalar values

    def is_constant(self, e: E, t: Tuples) -> bool:
        return e.op == "lit" or e.op in ("neg", "paren", "cast") and self.is_constant(e.args[0], t) or e.op == "call" and e.info["name"] not in ("position", "last") and all(self.is_constant(a, t) for a in e.args)

    def literal(self, e: E, t: Tuples) -> Any:
        if e.op == "lit":
            return float(e.args[0]) if e.info.get("kind") == "decimal" else e.args[0]
        if e.op == "paren":
            return self.literal(e.args[0], t)
        if e.op == "neg":
            return -self.literal(e.args[0], t)
        v = self.value(e, self.one_row())
        return self.spark.range(1).select(v.col).first()[0]

    def constant(self, e: E, t: Tuples) -> str:
        return str(self.literal(e, t))

    def atomized(self, item: Any, t: Tuples) -> V:
        if isinstance(item, Row):
            return V(self.row_text(item), "untyped")
        if isinstance(item, Node):
            return V(item.col("value"), "untyped")
        return item

    def one(self, v: V, t: Tuples) -> V:
        """A value as a single item."""
        return V(F.get(v.col, F.lit(0)), v.type, name=v.name) if v.many else v

    def value(self, e: E, t: Tuples) -> Any:
        op = e.op
        if op == "lit":
            x = e.args[0]
            return V(F.lit(x).cast("decimal(38,12)"), "decimal") if e.info.get("kind") == "decimal" else lit(x)
        if op == "chars":
            return V(F.lit(e.args[0]), "string")
        if op in ("paren", "ordered", "unordered", "pragma"):
            return self.value(e.args[0], t)
        if op == "seq" and not e.args:
            return V(F.array().cast("array<string>"), "empty", True)
        if self.is_rel(e, t):
            return self.gathered(e, t)
        if op == "var":
            bound = self.bound(e.args[0], t)
            return bound if isinstance(bound, V) else bound
        if op == "context":
            return t.focused()
        if op == "path":
            return self.scalar_path(e, t)
        if op == "seq":
            return concatenated([self.raw(a, t) for a in e.args])
        if op == "filter":
            return self.cell_filter(self.raw(e.args[0], t), e.info["predicates"], t)
        if op == "flwor":
            return self.cell_flwor(e, t)
        if op == "quant":
            return self.cell_quantifier(e, t)
        if op in ("arith", "value", "general", "node"):
            return self.operator(e, t)
        if op in ("neg", "plus"):
            v = library.number(self.one(self.item(e.args[0], t), t))
            return v.but(-v.col) if op == "neg" else v
        if op in ("and", "or"):
            a, b = (ebv(self.truth(x, t)) for x in e.args)
            return V(a & b if op == "and" else a | b, "boolean")
        if op == "range":
            a, b = (self.one(self.item(x, t), t).col for x in e.args)
            return V(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")), "integer", True)
        if op == "if":
            test, told = ebv(self.truth(e.args[0], t)), e.args[0]
            narrow = told.args[0].args[0] if told.op == "instance" and told.args[0].op == "var" else None
            yes = self.narrowed(narrow, told.info["kind"], e.args[1], t) if narrow else self.raw(e.args[1], t)
            return self.branches([(test, yes), (None, self.raw(e.args[2], t))])
        if op in ("cast", "castable", "instance", "treat"):
            return self.typed(e, t)
        if op == "typeswitch":
            return self.typeswitch(e, t)
        if op == "make":
            return self.construct(e, t)
        if op == "call":
            return self.call(e, t)
        if op in ("union", "intersect", "except"):
            raise StaticError("XPTY0004", f"{op} needs nodes")
        raise StaticError("XPST0003", f"unknown expression {op}")

    def truth(self, e: E, t: Tuples) -> V:
        if self.is_rel(e, t):
            return self.call_aggregate("exists", [e], t)
        return self.value(e, t)

    def raw(self, e: E, t: Tuples) -> V:
        """A value whose items may be of different types."""
        return self.atomized(self.value(e, t), t)

    def item(self, e: E, t: Tuples) -> V:
        return settle(self.raw(e, t))

    def typeswitch(self, e: E, t: Tuples) -> Any:
        """The first case whose type the value has. Where types are known, so is the case; else each row decides."""
        over = e.args[0]
        v = self.value(over, t)
        if isinstance(v, V) and not v.fields:
            self.flush(t) if t.df is not None else None
        own = over.args[0] if over.op == "var" else None
        parts: list[tuple[Column | None, Any]] = []
        for name, kind, body in [*e.info["cases"], (e.info["default"][0], None, e.info["default"][1])]:
            known = True if kind is None else self.is_instance(v, kind)
            if known is False:
                continue
            value = self.narrowed(own, kind, body, t, name, v)
            if known is True:
                parts.append((None, value))
                break
            parts.append((known, value))
        if len(parts) == 1:
            return parts[0][1]
        return self.branches([(c, self.atomized(x, t)) for c, x in parts])

    def narrowed(self, own: str | None, kind: tuple | None, body: E, t: Tuples, name: str | None = None, v: Any = None) -> Any:
        """``body`` where variable ``own`` (and ``name``, bound to the same) is known to be of a type."""
        v = self.bound(own, t) if v is None else v
        if kind and isinstance(v, V) and members(v.type) and not v.many and kind[0] in SPARK:
            v = cast(v, kind[0], safe=True)
        saved = t.vars
        t.vars = {**saved, **{n: v for n in (own, name) if n}}
        try:
            return self.value(body, t)
        finally:
            t.vars = saved

    def extended(self, t: Tuples, name: str | None, v: Any) -> Tuples:
        if name is None:
            return t
        return replace(t, vars={**t.vars, name: v}) if t.df is None else self._within(t, {name: v})

    def _within(self, t: Tuples, more: dict) -> Tuples:
        t.vars = {**t.vars, **more}
        return t

    def gathered(self, e: E, t: Tuples) -> V:
        """A relation as a cell sequence, in order."""
        inner = self.relation(e, Tuples(None, {}, None, t))
        if isinstance(inner.item, V) and inner.item.fields:
            value, kind = inner.item.col, "struct"
        else:
            v = self.atomized(inner.item, inner.tuples)
            value, kind = v.col, v.type
        made = F.transform(F.array_sort(F.collect_list(F.struct(*self.sort_struct(inner), value.alias("x")))), lambda s: s["x"]) if kind != "struct" else F.collect_list(value)
        empty = F.array().cast(f"array<{SPARK[base(kind)]}>") if base(kind) in SPARK else None
        out = self.aggregate(inner, t, made, kind, empty, True)
        return replace(out, name=getattr(inner.item, "name", None) or (None if not isinstance(inner.item, Node) else "node"))

    def scalar_path(self, e: E, t: Tuples) -> V:
        start = e.args[0]
        item = t.focused() if start.op in ("context", "root") else self.value(start, t)
        for step in e.info["steps"]:
            if isinstance(step, E):
                t2 = self.extended_focus(t, item)
                item = self.value(step, t2)
                t2.focus = None
                continue
            if isinstance(item, Row):
                if step.axis == "self" or step.test.name == "row" and "row" not in item.columns:
                    continue
                item = self.column(item, step.test)
            elif isinstance(item, V) and item.fields:
                name = (step.test.name or "").split(":")[-1]
                if name not in item.fields:
                    item = V(F.lit(None).cast("string"), "untyped")
                else:
                    item = replace(item.fields[name], name=name)
            elif isinstance(item, V) and item.many and item.type == "struct":
                item = V(F.transform(item.col, lambda x: x[step.test.name]), "untyped", True, name=step.test.name)
            elif isinstance(item, V) and step.axis == "self":
                pass
            elif isinstance(item, V) and step.test.kind in ("text", "node"):
                item = V(string(item), "untyped")
            else:
                raise StaticError("XPTY0019", "a step needs nodes")
            if step.predicates:
                item = self.cell_filter(item, step.predicates, t)
        return item

    def extended_focus(self, t: Tuples, item: Any) -> Tuples:
        return replace(t, focus=item)

    def local(self, t: Tuples, focus: Any, more: dict[str, Any]) -> Tuples:
        """A scope for an expression inside a lambda."""
        return Tuples(t.df, {**t.vars, **more}, focus if focus is not None else t.focus, t.around, waiting=t.waiting)

    def cell_filter(self, v: V, predicates: list[E], t: Tuples) -> V:
        for p in predicates:
            v = array(v)
            if p.op == "lit" and isinstance(p.args[0], int):
                v = V(F.get(v.col, F.lit(p.args[0] - 1)) if p.args[0] > 0 else F.lit(None).cast(SPARK.get(v.type, "string")), v.type)
                continue
            if p.op == "call" and p.info["name"] == "last":
                v = V(F.try_element_at(v.col, F.lit(-1)), v.type)
                continue
            size = F.size(v.col)

            def test(x: Column, i: Column, v=v, p=p, size=size) -> Column:
                pos, last = V((i + 1).cast("bigint"), "integer"), V(size.cast("bigint"), "integer")
                found = self.value(p, self.local(t, V(x, v.type), {"fs:position": pos, "fs:last": last}))
                return compare("eq", pos, found).col if base(found.type) in NUMERIC and not found.many else ebv(found)

            v = v.but(F.filter(v.col, lambda x, i: test(x, i)))
        return v

    def cell_flwor(self, e: E, t: Tuples) -> V:
        """A FLWOR over cell sequences, as transforms and filters of arrays."""
        clauses = e.info["clauses"]
        if not clauses:
            return self.value(e.args[0], t)
        (kind, name, body, at, _), rest = clauses[0], clauses[1:]
        tail = replace_info(e, clauses=rest)
        if kind == "let":
            return self.value(tail, self.local(t, None, {name: self.value(body, t)}))
        if kind == "where":
            v = self.value(tail, t)
            none = F.filter(array(v).col, lambda x: F.lit(False)) if not v.fields else None
            test = ebv(self.truth(body, t))
            return array(v).but(F.when(test, array(v).col).otherwise(none), many=True) if none is not None else v.but(F.when(test, v.col))
        if kind == "order":
            raise StaticError("SE0003", "order by needs a for clause before it")
        over = array(self.raw(body, t))
        if rest and rest[-1][0] == "order":
            keys = rest[-1][2]

            def keyed(x: Column) -> Column:
                scope = self.local(t, None, {name: V(x, over.type)})
                return F.struct(*(self.value(k, scope).col.alias(f"k{n}") for n, (k, _, _) in enumerate(keys)), x.alias("x"))

            ordered = F.array_sort(F.transform(over.col, keyed))
            if keys[0][1]:
                ordered = F.reverse(ordered)
            over = over.but(F.transform(ordered, lambda s: s["x"]))
            tail = replace_info(e, clauses=rest[:-1])
        if len(tail.info["clauses"]) == 1 and tail.info["clauses"][0][0] == "where" and not at:
            test = tail.info["clauses"][0][2]
            over = over.but(F.filter(over.col, lambda x: ebv(self.value(test, self.local(t, None, {name: V(x, over.type)})))))
            tail = replace_info(e, clauses=[])
        got: dict[str, Any] = {}

        def one(x: Column, i: Column) -> Column:
            v = self.value(tail, self.local(t, None, {name: V(x, over.type)} | ({at: V((i + 1).cast("bigint"), "integer")} if at else {})))
            got["v"] = v
            return v.col

        mapped = F.transform(over.col, one)
        v = got["v"]
        if v.many:
            return V(F.flatten(mapped), v.type, True)
        return V(F.filter(mapped, lambda x: x.isNotNull()), v.type, True)

    def cell_quantifier(self, e: E, t: Tuples) -> V:
        if any(self.is_rel(b[1], t) for b in e.info["binds"]):
            inner = Tuples(None, {}, None, t)
            for name, body, _, _ in e.info["binds"]:
                self.bind_for(inner, name, body, None, t)
            every = e.info["kind"] == "every"
            self.restrict(e.args[0], inner, every)
            some = self.aggregate(Relation(inner, None), t, F.count(F.lit(1)) > 0, "boolean", F.lit(False))
            return V(~some.col if every else some.col, "boolean")
        (name, body, _, _), rest = e.info["binds"][0], e.info["binds"][1:]
        over = array(self.raw(body, t))
        test = e.args[0] if not rest else replace_info(e, binds=rest)
        pick = F.exists if e.info["kind"] == "some" else F.forall
        return V(pick(over.col, lambda x: ebv(self.value(test, self.local(t, None, {name: V(x, over.type)})))), "boolean")

    def operator(self, e: E, t: Tuples) -> V:
        if e.op == "general" and any(self.is_rel(a, t) for a in e.args):
            side = 0 if self.is_rel(e.args[0], t) else 1
            inner = self.relation(e.args[side], Tuples(None, {}, None, t))
            x, y = self.atomized(inner.item, inner.tuples), self.item(e.args[1 - side], t)
            hit = general(e.info["sign"], *((x, y) if side == 0 else (y, x)))
            inner.links.append(Link(hit.col))
            return self.aggregate(inner, t, F.count(F.lit(1)) > 0, "boolean", F.lit(False))
        if e.op == "node":
            return self.node_comparison(e, t)
        a, b = (self.raw(x, t) for x in e.args)
        if e.op == "general":
            return general(e.info["sign"], a, b)
        a, b = self.one(a, t), self.one(b, t)
        if e.op == "arith":
            a, b = settle(a, "untyped"), settle(b, "untyped")
        return arithmetic(e.info["sign"], a, b) if e.op == "arith" else compare(e.info["sign"], a, b)

    def node_comparison(self, e: E, t: Tuples) -> V:
        a, b = (self.value(x, t) for x in e.args)
        if not isinstance(a, Node) or not isinstance(b, Node):
            raise StaticError("XPTY0004", "node comparison needs nodes")
        key = lambda n: F.struct(n.col("doc_id").alias("d"), n.col("pre").alias("p"))
        return V({"is": key(a) == key(b), "<<": key(a) < key(b), ">>": key(a) > key(b)}[e.info["sign"]], "boolean")

    def branches(self, parts: list[tuple[Column | None, V]]) -> V:
        values = [v for _, v in parts]
        real = [v for v in values if v.type not in ("empty", "never")] or values
        kept = {id(v) for v in real}
        kind, many = mixture(real), any(v.many for v in real)
        if members(kind):
            real = [v if v.many else v.but(tagged(v), kind) for v in real]
            whole = [(test, next((r for r, o in zip(real, [x for x in values if id(x) in kept], strict=True) if o is v), v if v.type == "never" else None)) for test, v in parts]
            return self.mixed_branches(whole, kind, many)
        out = None
        for test, v in parts:
            if id(v) not in kept:
                c = v.col if v.type == "never" else F.lit(None)
            else:
                v = cast(v, kind) if not v.many and base(v.type) != kind else v
                c = array(v).col if many else v.col
            out = c if test is None and out is None else out.otherwise(c) if test is None else F.when(test, c) if out is None else out.when(test, c)
        return V(out, kind, many)

    def mixed_branches(self, parts: list[tuple[Column | None, V | None]], kind: str, many: bool) -> V:
        """Branches of different types; None is the empty sequence."""
        out = None
        for test, v in parts:
            if v is None:
                c = F.lit(None)
            elif many and v.type != "never":
                c = all_tagged(v)
            else:
                c = v.col
            out = c if test is None and out is None else out.otherwise(c) if test is None else F.when(test, c) if out is None else out.when(test, c)
        return V(out, kind, many)

    # ---- types

    def typed(self, e: E, t: Tuples) -> V:
        kind, _, sign = e.info["kind"]
        v = self.value(e.args[0], t)
        if e.op == "instance":
            known = self.is_instance(v, e.info["kind"])
            return lit(known) if isinstance(known, bool) else V(known, "boolean")
        if e.op == "treat":
            known = self.is_instance(v, e.info["kind"])
            if known is False:
                raise StaticError("XPDY0050", f"not a {kind}{sign}")
            if known is not True:
                fail = F.raise_error(F.lit(f"XPDY0050: not a {kind}{sign}"))
                v = v.but(F.when(known, v.col).otherwise(fail), name=v.name)
                if members(v.type) and kind in SPARK:
                    v = v.but(F.transform(v.col, lambda x: cast(V(x, v.type), kind).col) if v.many else cast(v, kind).col, kind)
            return v
        v = self.one(self.atomized(v, t), t)
        if members(v.type):
            v = V(v.col["text"], "untyped")
        if e.op == "castable":
            try:
                out = cast(v, kind, safe=True)
            except StaticError:
                return lit(False)
            return V(F.when(v.col.isNull(), F.lit(sign == "?")).otherwise(out.col.isNotNull()), "boolean")
        out = cast(v, kind)
        return out

    def is_instance(self, v: Any, kind: tuple) -> bool | Column:
        """Whether a value has a sequence type: told at once where its type and number of items are known, else a condition."""
        name, _, sign = kind
        if isinstance(v, (Row, Node)):
            return name in ("item()", "node()", "element()")
        none = F.size(array(v).col) == 0 if v.many else v.col.isNull()
        if name == "empty":
            return v.type == "empty" or (none if v.many or not v.fields else False)
        mixed = members(v.type)
        fits = [m for m in mixed if self.fits(m, name, False)] if mixed else None
        if mixed and len(fits) < len(mixed):
            each = F.forall(v.col, lambda x: x["kind"].isin(fits)) if v.many else v.col["kind"].isin(fits)
            each = F.coalesce(each, F.lit(True)) if fits else none
        elif not mixed and v.type != "empty" and not self.fits(v.type, name, bool(v.fields) or v.name is not None):
            return False if sign in ("", "+") else none
        else:
            each = None
        if v.many:
            size = F.size(array(v).col)
            number = {"": size == 1, "?": size <= 1, "+": size >= 1, "*": None}[sign or ""]
        else:
            number = None if sign in ("?", "*") or v.fields else ~none
        found = [c for c in (each, number) if c is not None]
        return reduce(operator.and_, found) if found else True

    @staticmethod
    def fits(have: str, name: str, node: bool) -> bool:
        """Whether an item of type ``have`` is of the item type ``name``."""
        if name == "item()":
            return True
        if name in ("node()", "element()", "attribute()", "text()"):
            return node or have == name or name == "node()" and have == "element()"
        if name in ("anyAtomicType", "anySimpleType"):
            return have not in ("struct", "element()")
        return name == have or name == "decimal" and base(have) == "integer" or name == "integer" and have in INTEGERS or name == "string" and have in STRINGS or name == "untypedAtomic" and have == "untyped"

    # ---- calls

    def call(self, e: E, t: Tuples) -> V:
        name, args = e.info["name"], e.args
        if name.startswith("xs:") or name.startswith("xdt:"):
            return cast(self.one(self.item(args[0], t), t), name.split(":")[1])
        if name in AGGREGATES and args and self.is_rel(args[0], t) and name != "deep-equal":
            return self.call_aggregate(name, args, t)
        if name in ("position", "last"):
            found = t.find(f"fs:{name}")
            if found is None:
                raise StaticError("XPDY0002", f"{name}() has no focus")
            return found
        own = self.static.functions.get((name, len(args)))
        if own:
            return self.inlined(own, name, args, t, self.value)
        if name in self.static.externals or name in self.session.externals:
            fn, kind = self.session.externals[name]
            return V(fn(*(self.item(a, t).col for a in args)), kind)
        known = library.FUNCTIONS.get(name)
        if not known:
            raise StaticError("XPST0017", f"no function {name}#{len(args)}")
        least, most, build = known
        if not least <= len(args) <= most:
            raise StaticError("XPST0017", f"{name} takes {least} to {most} arguments, not {len(args)}")
        if build is None:
            return self.contextual(name, args, t)
        if not args and least == 0 and most == 1 and name in ("normalize-space", "string-length", "number"):
            values = [self.atomized(t.focused(), t)]
        else:
            values = [self.item(a, t) for a in args]
        if name in ("codepoints-to-string", "string-join", "count", "sum", "avg", "min", "max", "empty", "exists", "distinct-values", "index-of", "insert-before", "remove", "reverse", "subsequence", "item-at", "zero-or-one", "one-or-more", "exactly-one", "unordered", "deep-equal", "boolean", "not", "trace"):
            return build(*values)
        if name == "resolve-uri" and len(values) == 1:
            values.append(lit(self.static.base_uri))
        return build(*(self.one(v, t) for v in values))

    def contextual(self, name: str, args: list[E], t: Tuples) -> V:
        session = self.session
        if name in ("data", "string", "typed-value", "string-value"):
            v = self.value(args[0], t) if args else t.focused()
            if isinstance(v, Node):
                return V(self.node_text(v, t), "untyped")
            v = self.atomized(v, t)
            if name in ("data", "typed-value"):
                return replace(v, name=None)
            one = self.one(v, t)
            return V(F.coalesce(string(one), F.lit("")), "string")
        if name in ("name", "local-name", "node-name", "namespace-uri", "nilled", "base-uri", "document-uri"):
            v = self.value(args[0], t) if args else t.focused()
            if isinstance(v, Node):
                local, pfx = v.col("local"), v.col("pfx")
                if name == "node-name":
                    return V(F.when(v.col("kind").isin("element", "attribute"), F.struct(v.col("ns").alias("ns"), pfx.alias("prefix"), local.alias("local"))), "QName")
                if name in ("base-uri", "document-uri"):
                    uri = v.store.uri(v.col("doc_id"))
                    return V(uri if name == "base-uri" else F.when(v.col("kind") == "document", uri), "anyURI")
                return V({"name": F.when(pfx != "", F.concat(pfx, F.lit(":"), local)).otherwise(local), "local-name": local, "namespace-uri": v.col("ns"), "nilled": F.when(v.col("kind") == "element", F.lit(False))}[name], "boolean" if name == "nilled" else "string")
            label = v.table if isinstance(v, Row) else v.name
            label = "row" if isinstance(v, Row) else label
            if name == "nilled":
                return V(F.lit(False) if isinstance(v, Row) or v.name else F.lit(None).cast("boolean"), "boolean")
            if name in ("base-uri", "document-uri"):
                return V(F.lit(v.table if isinstance(v, Row) else None).cast("string"), "anyURI")
            if name == "node-name":
                return V(F.struct(F.lit("").alias("ns"), F.lit("").alias("prefix"), F.lit(label).alias("local")), "QName")
            return lit("" if name == "namespace-uri" else label or "")
        if name == "static-base-uri":
            return V(F.lit(self.static.base_uri or None).cast("string"), "anyURI")
        if name in ("doc-available", "col-available"):
            return lit(session.catalog.exists(*(self.constant(a, t) for a in args)))
        if name in ("fthighlight", "fthighlight-blocks"):
            from xylem.operators.fulltext import highlighted

            return V(highlighted(library.text(self.one(self.item(args[1], t), t)), self.constant(args[0], t), name.endswith("blocks")), "string")
        if name == "is_ancestor":
            a, b = (self.value(x, t) for x in args)
            return V((a.col("doc_id") == b.col("doc_id")) & (a.col("pre") < b.col("pre")) & (b.col("pre") <= a.col("pre") + a.col("size")), "boolean")
        if name in ("in-scope-prefixes", "namespace-uri-for-prefix", "resolve-QName"):
            names = F.create_map(*(F.lit(x) for pair in {"xml": "http://www.w3.org/XML/1998/namespace", **self.static.namespaces}.items() for x in pair))
            if name == "in-scope-prefixes":
                return V(F.map_keys(names), "string", True)
            first = self.one(self.item(args[0], t), t)
            if name == "namespace-uri-for-prefix":
                return V(F.try_element_at(names, library.text(first)), "anyURI")
            cut = F.split(library.text(first), ":")
            pfx = F.when(F.size(cut) > 1, cut[0]).otherwise("")
            return V(F.struct(F.coalesce(F.try_element_at(names, pfx), F.lit("")).alias("ns"), pfx.alias("prefix"), F.element_at(cut, -1).alias("local")), "QName")
        if name.startswith("sql:"):
            given = [self.literal(a, t) for a in args]
            return lit(session.connector.call(name[4:], given))
        if name == "se:checkpoint":
            return V(F.array().cast("array<string>"), "string", True)
        if name == "se:get-property":
            key = self.constant(args[0], t)
            if key != "$user":
                raise StaticError("SE1003", f"no property {key}")
            return lit(session.security.user)
        if name == "lang":
            from xylem.operators.axes import language

            node = self.value(args[1], t) if len(args) > 1 else t.focused()
            t.df, out = language(t.df, node, library.text(self.one(self.item(args[0], t), t)))
            return V(out, "boolean")
        if name == "root":
            return self.value(args[0], t) if args else t.focused()
        if name == "test":
            return lit(self.sound(self.relation(args[0], Tuples(None))))
        raise StaticError("XPST0017", f"{name} isn't possible here")

    def sound(self, r: Relation) -> bool:
        """Whether the stored nodes of ``r`` nest: each below a parent of the level above whose range holds its own. One job."""
        if not isinstance(r.item, Node):
            raise StaticError("XPTY0004", "test needs stored nodes")
        nodes = r.item.store.frame()
        owners = nodes.select(F.col("doc_id").alias("d"), F.col("pre").alias("p"), (F.col("pre") + F.col("size")).alias("e"), F.col("level").alias("l"))
        both = nodes.where("kind != 'document'").join(owners, (F.col("doc_id") == F.col("d")) & (F.col("parent") == F.col("p")), "left")
        nested = (F.col("p") < F.col("pre")) & (F.col("pre") + F.col("size") <= F.col("e")) & (F.col("level") == F.col("l") + 1)
        return not both.where(~F.coalesce(nested, F.lit(False))).take(1)

    def node_text(self, node: Node, t: Tuples) -> Column:
        """String value: kept for simple nodes, else the text below in document order."""
        from xylem.operators.axes import related

        hit = self.nodes(node.store, node.store.frame("descendant", Test("text")).where(F.col("kind") == "text"), t)
        hit.links.append(Link(node.col("doc_id") == hit.item.col("doc_id"), node.col("doc_id"), hit.item.col("doc_id")))
        hit.links.append(Link(related("descendant", node, hit.item)))
        made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(hit.item.col("pre").alias("p"), hit.item.col("value").alias("x")))), lambda s: s["x"]), "")
        below = self.aggregate(hit, t, made, "untyped", F.lit(""))
        return F.coalesce(node.col("value"), below.col)

    def inlined(self, known: tuple, name: str, args: list[E], t: Tuples, run) -> Any:
        params, body, kind = known
        if (name, len(args)) in self.active or calls(body, name):
            values = [self.one(self.item(a, t), t) for a in args]
            return V(recursive_udf(self.static.functions, name, len(args), kind)(*(v.col.cast("double") if base(v.type) in NUMERIC else v.col for v in values)), "integer" if kind and kind[0] == "integer" else "double" if not kind else base(kind[0]))
        self.active.append((name, len(args)))
        try:
            more = {}
            for (p, declared), a in zip(params, args, strict=True):
                if self.is_rel(a, t):
                    more[p] = Lazy(a, t.vars)
                    continue
                v = self.value(a, t)
                if declared and isinstance(v, (V, Row)) and declared[0] in SPARK:
                    v = self.converted(self.atomized(v, t), declared)
                more[p] = v
            if t.df is None:
                return run(body, Tuples(None, more, t.focus, t))
            saved = t.vars
            t.vars = {**t.vars, **more}
            out = run(body, t)
            t.vars = {**saved, **{k: v for k, v in more.items() if run != self.value}}
            if kind and isinstance(out, V) and kind[0] in SPARK and not out.fields:
                out = self.converted(out, kind)
            return out
        finally:
            self.active.pop()

    def converted(self, v: V, kind: tuple) -> V:
        """Function conversion: atomised items are cast if untyped and promoted if numeric."""
        want = kind[0]
        if v.many:
            return v if base(v.type) == want else v.but(F.transform(v.col, lambda x: cast(V(x, v.type), want).col), want)
        if base(v.type) == want or v.type == want:
            return v
        if v.type == "untyped" or base(v.type) in NUMERIC and want in NUMERIC or v.type == "anyURI":
            return cast(v, want)
        raise StaticError("XPTY0004", f"xs:{v.type} given, xs:{want} needed")

    # ---- constructors

    def construct(self, e: E, t: Tuples) -> V:
        kind = e.info["kind"]
        if kind == "document":
            return self.value(e.args[0], t)
        label = None
        if e.info["name"] is not None:
            label = str(self.literal(e.info["name"], t)).split(":")[-1]
        if kind in ("text", "attribute", "comment", "processing-instruction"):
            v = self.spaced(e.args[0], t)
            return V(v.col, "untyped" if kind != "comment" else "string", name=label or kind, fields={}) if kind != "attribute" else replace(v, name="@" + label)
        fields: dict[str, V] = {}
        for key, parts in e.info["attributes"]:
            value = self.value(parts[0], t) if len(parts) == 1 else None
            value = settle(self.atomized(value, t)) if value is not None else V(F.concat(*(library.text(self.one(self.item(p, t), t)) for p in parts)) if parts else F.lit(""), "string")
            fields["@" + key.split(":")[-1]] = replace(value, name=None)
        body = e.args[0].args if e.args[0].op == "seq" else [e.args[0]]
        for k, part in enumerate(body):
            v = self.value(part, t)
            v = settle(v) if isinstance(v, V) else v
            if isinstance(v, Row):
                fields |= {c: V(F.col(v.prefix + c), kk, many, name=c) for c, (kk, many) in v.columns.items()}
                continue
            if isinstance(v, Node):
                v = V(v.col("value"), "untyped", name="node")
            if v.fields and v.name:
                fields[v.name] = v.fields["_VALUE"] if set(v.fields) == {"_VALUE"} else v
            elif v.name and not v.many:
                fields[v.name] = replace(v, name=None)
            elif v.name and v.many:
                fields[v.name] = replace(v, name=None)
            elif v.many and v.type == "struct":
                fields["items"] = v
            else:
                held = fields.get("_VALUE")
                fields["_VALUE"] = v if held is None else V(F.concat(library.text(self.one(held, t)), library.text(self.one(v, t))), "string")
        self.flush(t) if t.df is not None else None
        struct = F.struct(*((v.col if not v.fields else v.col).alias(k) for k, v in fields.items())) if fields else F.struct(F.lit("").alias("_VALUE"))
        return V(struct, "struct", fields=fields or {"_VALUE": V(F.lit(""), "string")}, name=label)

    def spaced(self, e: E, t: Tuples) -> V:
        v = self.item(e, t)
        if not v.many:
            return v
        return V(F.array_join(F.transform(v.col, lambda x: string(V(x, v.type))), " "), "untyped")


def one_path(step: Any) -> str | None:
    """A downward step as a pattern for the next part of a rooted path."""
    if not isinstance(step, Step) or step.axis not in ("child", "descendant", "attribute", "descendant-attribute"):
        return None
    test, deep = step.test, "(?:/[^/]+)*" if step.axis.startswith("descendant") else ""
    mark = "@" if "attribute" in step.axis else ""
    if test.kind == "text":
        return rf"{deep}/text\(\)"
    if test.kind not in ("element", "attribute") or test.kind == "attribute" and not mark:
        return None
    if not test.name:
        return rf"{deep}/{mark}[^/@()]+"
    pfx, _, local = test.name.rpartition(":")
    first = rf"{re.escape(pfx)}:" if pfx and pfx != "*" else "(?:[^/:]+:)?"
    return rf"{deep}/{mark}{first}{'[^/@():]+' if local == '*' else re.escape(local)}"


def replace_info(e: E, **more) -> E:
    return E(e.op, e.args, {**e.info, **more})


def calls(e: Any, name: str) -> bool:
    if isinstance(e, E):
        return e.op == "call" and e.info["name"] == name or any(calls(a, name) for a in e.args) or any(calls(x, name) for x in e.info.values())
    if isinstance(e, (list, tuple)):
        return any(calls(x, name) for x in e)
    return False


def uses_last(e: Any) -> bool:
    return calls(e, "last")


def names_of(c: Column) -> set[str]:
    """Names of the columns that an expression reads."""
    return set(re.findall(r"[A-Za-z_][\w.\-]*_\d+(?:_[A-Za-z_]\w*)?", c._jc.toString()))
