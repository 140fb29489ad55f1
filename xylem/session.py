"""A session: names, and queries and statements as text."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.functions.values import StaticError, V, settle, string
from xylem.operators import updates
from xylem.operators.fulltext import FullText
from xylem.plans.compiler import Compiler, Static
from xylem.plans.parser import E, parse
from xylem.plans.relation import Node, Relation, Row, Tuples
from xylem.sources.catalog import Catalog, Connector, Indexes, Security
from xylem.sources.nodes import SCHEMA, NodeStore, load, serialised, small_tasks, stored

#: Triggers that may fire one another.
CASCADE = 10
#: What updating a document needs.
_NEEDS = {"insert": "INSERT", "delete": "DELETE", "delete_undeep": "DELETE", "replace": "REPLACE", "rename": "RENAME"}


@dataclass
class Trigger:
    name: str
    time: str
    event: str
    target: str
    path: str
    each: str
    action: Callable[..., Any]


class Session:
    """``Session(spark)``, then :meth:`register` tables and run :meth:`xquery`."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self._folder = spark, folder
        self.catalog, self.indexes, self.fulltext = Catalog(self), Indexes(self), FullText(self)
        self.security, self.connector = Security(), Connector(spark)
        self.triggers: dict[str, Trigger] = {}
        self.modules: dict[str, list] = {}
        self.module_texts: dict[str, str] = {}
        self.externals: dict[str, tuple[Callable, str]] = {}
        self.depth = 0
        self.debug = False
        self._scratch: list[str] = []
        self.made: dict[str, str] = {}
        self._own = ""

    def folder(self, name: str) -> str | None:
        return f"{self._folder}/{name}" if self._folder else None

    # ---- sources

    def tables(self, sf_dir: str, *names: str) -> Session:
        """Registers Parquet tables of a folder as collections (and as views for SQL)."""
        for name in names:
            self.register(name, self.spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return self

    def register(self, name: str, source: DataFrame | NodeStore) -> Session:
        self.catalog.register(name, source)
        return self

    def register_function(self, name: str, fn: Callable, kind: str) -> None:
        """An external function: ``fn`` makes a column of its argument columns (a UDF, a pandas UDF or built-ins)."""
        self.externals[name] = fn, kind

    def load_xml(self, name: str, docs: DataFrame) -> NodeStore:
        """Bulk load of (doc_id, xml) as a collection."""
        self.check("LOAD-FILE")
        store = load(self, docs, name)
        self.catalog.register(name, store)
        return store

    def load_document(self, xml: str, name: str, collection: str | None = None, doc_id: int = 0) -> NodeStore:
        store = load(self, self.spark.createDataFrame([(doc_id, xml)], "doc_id long, xml string"), name)
        self.catalog.create_document(name, collection, store)
        return store

    def empty_store(self, name: str) -> NodeStore:
        return NodeStore(self.spark.createDataFrame([], SCHEMA + ", path_id long"), None, name)

    def check(self, privilege: str, name: str | None = None) -> None:
        kind = None
        if privilege in ("DOCUMENT", "COLLECTION"):
            kind, privilege = privilege.lower(), "QUERY"
        if not self.security.allowed(privilege, kind, name):
            raise StaticError("SE3065", f"{self.security.user} lacks {privilege} on {name or 'the database'}")

    # ---- queries

    def xquery(self, text: str, **variables: Any) -> DataFrame:
        """The result of a query, or of a statement, as a DataFrame.

        A sequence of atomic items has the column ``item``; constructed elements have a column for each attribute
        and child; rows and nodes have their own columns. ``order by`` gives an ordered DataFrame.
        """
        tree = parse(text)
        if not self.debug:
            out = self.run(tree, variables)
        else:
            out = self.debugged(tree, variables)
        body = tree.args[0]
        if body.op == "create" and body.info["kind"] in ("index", "full-text index", "trigger"):
            self.made[body.info["name"]] = text
        elif body.op == "drop":
            self.made.pop(body.info["name"], None)
        return out

    def debugged(self, tree: E, variables: dict[str, Any]) -> DataFrame:
        """With ``debug`` set: an error of the analysis says which expressions it is in, innermost last."""
        from xylem.plans import compiler

        stack: list[str] = []
        kept = compiler.Compiler.value, compiler.Compiler.relation

        def noted(run):
            def wrapped(own, e, t):
                stack.append(e.info.get("name") if e.op == "call" else e.op)
                out = run(own, e, t)
                stack.pop()
                return out

            return wrapped

        compiler.Compiler.value, compiler.Compiler.relation = map(noted, kept)
        try:
            return self.run(tree, variables)
        except StaticError as e:
            e.add_note("in " + " > ".join(stack))
            raise
        finally:
            compiler.Compiler.value, compiler.Compiler.relation = kept

    def export(self, folder: str) -> None:
        """Collections, documents, indexes, triggers, modules, users and privileges as files of ``folder``."""
        stores: list = []

        def number(x: Any) -> int:
            at = next((k for k, y in enumerate(stores) if y is x), None)
            if at is None:
                stores.append(x)
                (x.nodes if isinstance(x, NodeStore) else x).write.parquet(f"{folder}/data/{len(stores) - 1}")
            return len(stores) - 1 if at is None else at

        kind = lambda x: "nodes" if isinstance(x, NodeStore) else "table"
        rows = [("collection", n, None, kind(x), number(x)) for n, x in self.catalog.collections.items()]
        rows += [("document", n, c, kind(x), number(x)) for (c, n), x in self.catalog.documents.items()]
        rows += [("statement", n, text, None, None) for n, text in self.made.items()]
        rows += [("module", uri, self.module_texts[uri], None, None) for uri in self.modules]
        rows.append(("security", "", json.dumps(self.security.state()), None, None))
        self.spark.createDataFrame(rows, "part string, name string, info string, kind string, data int").coalesce(1).write.parquet(f"{folder}/catalog")

    def restore(self, folder: str, security: bool = True) -> Session:
        """What :meth:`export` wrote, into this session; ``security``: users and privileges too."""
        rows = self.spark.read.parquet(f"{folder}/catalog").collect()
        held = {}
        for r in rows:
            if r.data is not None and r.data not in held:
                data = self.spark.read.parquet(f"{folder}/data/{r.data}")
                held[r.data] = NodeStore(data, None, r.name) if r.kind == "nodes" else data
        for r in rows:
            if r.part == "collection":
                self.catalog.collections[r.name] = held[r.data]
            elif r.part == "document":
                self.catalog.documents[r.info, r.name] = held[r.data]
            elif r.part == "module":
                self.load_module(r.info, replace=True)
            elif r.part == "security" and security:
                self.security.restore(json.loads(r.info))
        for r in rows:
            if r.part == "statement":
                self.xquery(r.info)
        return self

    def run(self, tree: E, variables: dict[str, Any] | None = None) -> DataFrame:
        static = self.static(tree, variables or {})
        body = tree.args[0]
        if body.op in ("update", "create", "drop", "rename", "grant", "revoke", "alter", "load", "load-module", "metadata", "schema", "explain"):
            return getattr(self, "do_" + body.op.replace("-", "_"))(body, static)
        return self.result(body, static)

    def static(self, tree: E, variables: dict[str, Any]) -> Static:
        from xylem.functions.values import lit

        out = Static()
        out.variables = {k: lit(v) for k, v in variables.items()}
        compiler = Compiler(self, out)
        self.declare(tree.info["prolog"], out, compiler)
        return out

    def declare(self, prolog: list[tuple], out: Static, compiler: Compiler) -> None:
        for kind, *rest in prolog:
            if kind == "function":
                name, params, result, body = rest
                if (name, len(params)) in out.functions:
                    raise StaticError("XQST0034", f"{name}#{len(params)} is declared twice")
                out.functions[name, len(params)] = params, body, result
            elif kind == "external":
                out.externals[rest[0]] = tuple(rest[1:])
                if rest[0] not in self.externals:
                    raise StaticError("SE1090", f"external function {rest[0]} isn't registered")
            elif kind == "variable":
                name, _, body = rest
                if body is None:
                    if name not in out.variables:
                        raise StaticError("XPDY0002", f"external variable ${name} has no value")
                else:
                    from xylem.plans.compiler import Lazy

                    t = compiler.one_row()
                    out.variables[name] = Lazy(body, {}) if compiler.is_rel(body, t) else compiler.value(body, t)
            elif kind == "namespace":
                out.namespaces[rest[0]] = rest[1]
            elif kind == "option":
                out.options[rest[0]] = rest[1]
            elif kind == "empty":
                out.empty = rest[0]
            elif kind == "ordering":
                out.ordering = rest[0]
            elif kind == "base-uri":
                out.base_uri = rest[0]
            elif kind == "boundary-space":
                out.boundary_space = rest[0]
            elif kind == "import":
                if rest[1] not in self.modules:
                    raise StaticError("XQST0059", f"no module {rest[1]}")
                self.declare(self.modules[rest[1]], out, compiler)
            elif kind == "collation" and not rest[0].endswith("collation/codepoint"):
                raise StaticError("XQST0038", f"no collation {rest[0]}")
            elif kind == "version" and rest[0] != "1.0":
                raise StaticError("XQST0031", f"no version {rest[0]}")

    def result(self, body: E, static: Static) -> DataFrame:
        compiler = Compiler(self, static)
        t = Tuples(None)
        if body.op == "flwor" or compiler.is_rel(body, t):
            return self.shown(compiler.relation(body, t), static)
        t = compiler.one_row()
        v = compiler.value(body, t)
        compiler.flush(t)
        if isinstance(v, V) and v.many:
            return self.shown(compiler.exploded(v, t), static)
        if isinstance(v, V) and not v.fields:
            t.where(v.col.isNotNull())
        return self.shown(Relation(t, v), static)

    def shown(self, r: Relation, static: Static) -> DataFrame:
        df, item = r.df, r.item
        if r.links:
            raise StaticError("SE0002", "a condition refers to nothing in scope")
        if r.tuples.order and (r.tuples.sorted or isinstance(item, Node)) and static.ordering == "ordered":
            df = df.orderBy(*r.tuples.order)
        if isinstance(item, Row):
            return df.select(*(F.col(item.prefix + c).alias(c) for c in item.columns))
        if isinstance(item, Node):
            return df.select(*(F.col(item.prefix + c).alias(c) for c in Node.COLUMNS))
        if item.fields:
            return df.select(*(v.col.alias(k.lstrip("@") if k != "_VALUE" else "value") for k, v in item.fields.items()))
        return df.select(settle(item).col.alias("item"))

    def xml(self, text: str, root: str | None = None) -> DataFrame:
        """A query's result serialised: the column ``xml``, an element for each item."""
        tree = parse(text)
        static = self.static(tree, {})
        compiler = Compiler(self, static)
        t = Tuples(None)
        body = tree.args[0]
        if compiler.is_rel(body, t):
            r = compiler.relation(body, t)
        else:
            t = compiler.one_row()
            r = Relation(t, compiler.value(body, t))
            compiler.flush(t)
        if isinstance(r.item, Node):
            return serialised(r.item.store.frame(), "xml", "indent=yes" in static.options.get("se:output", ""))
        characters = dict(x.split("=") for x in static.options.get("se:character-map", "").split(";") if "=" in x)
        return r.df.select(element_text(r.item, r.item.name if isinstance(r.item, V) else "row", characters).alias("xml"))

    def explain(self, text: str) -> str:
        """The plan that a query gets."""
        df = self.xquery(text)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def do_explain(self, e: E, static: Static) -> DataFrame:
        began = time.time()
        df = self.run(e.args[0])
        plan = df._jdf.queryExecution().simpleString()
        rows = [("plan", plan)]
        if e.info["profile"]:
            rows += [("rows", str(df.count())), ("seconds", f"{time.time() - began:.3f}")]
        return self.spark.createDataFrame(rows, "part string, text string")

    # ---- statements

    def done(self, what: str) -> DataFrame:
        return self.spark.createDataFrame([(what,)], "done string")

    def literal(self, e: E, static: Static) -> str:
        return Compiler(self, static).constant(e, Tuples(None))

    def do_create(self, e: E, static: Static) -> DataFrame:
        kind, name = e.info["kind"], e.info["name"]
        if kind == "collection":
            self.check("CREATE-COLLECTION")
            self.catalog.create_collection(name)
        elif kind == "document":
            self.check("CREATE-DOCUMENT")
            self.catalog.create_document(name, e.info.get("inside"))
        elif kind == "index":
            self.check("CREATE-INDEX")
            self.create_index(e, static)
        elif kind == "full-text index":
            self.check("CREATE-INDEX")
            on, form, kinds = e.info["on"], e.info["type"], e.info.get("kinds") or {}
            self.fulltext.create(name, self.bodies(on, form, kinds, static), form, e.info["options"], lambda: self.bodies(on, form, kinds, static), lambda: self.catalog.open(path_of(on)[0]))
        elif kind == "trigger":
            self.check("CREATE-TRIGGER")
            actions = e.info["actions"]

            def action(session: Session, new: Any = None) -> Any:
                out = None
                for a in actions:
                    if a.op == "make" or a.op in ("seq", "if", "flwor", "lit", "var", "call"):
                        out = fragment(a)
                    else:
                        session.run(E("module", [a], {"prolog": []}))
                return out if out is not None else new

            self.add_trigger(name, e.info["time"], e.info["event"], *path_of(e.info["on"]), e.info["each"], action)
        elif kind == "user":
            self.check("CREATE-USER")
            self.security.create_user(name, e.info["password"])
        elif kind == "role":
            self.security.create_role(name)
        return self.done(f"{kind} {name} created")

    def keyed(self, on: E, by: E | None, static: Static) -> tuple[DataFrame, str | None]:
        """Rows of the ON path, and the name of the BY path's column."""
        for path in (on, by):
            if path is not None and path.op == "path" and any(getattr(s, "predicates", None) for s in path.info["steps"]):
                raise StaticError("SE2030", "index paths have no predicates")
        compiler = Compiler(self, static)
        r = compiler.relation(on, Tuples(None))
        if isinstance(r.item, Row):
            rows = r.df.select(*(F.col(r.item.prefix + c).alias(c) for c in r.item.columns))
            return rows, by.info["steps"][-1].test.name if by is not None else None
        key = None
        if by is not None:
            r.tuples.vars["owner"] = r.item  # keeps its columns beside those of the keys
            step = compiler.walk(r, by.info["steps"] if by.op == "path" else [], Tuples(None))
            owners = r.item
            rows = step.df.select(owners.col("doc_id").alias("doc_id"), owners.col("pre").alias("pre"), step.item.col("value").alias("key"))
            return rows, "key"
        text = compiler.node_text(r.item, r.tuples)
        return r.tuples.df.select(r.item.col("doc_id").alias("doc_id"), text.alias("text")), key

    def create_index(self, e: E, static: Static) -> None:
        make = lambda: self.keyed(e.info["on"], e.info["by"], static)
        self.indexes.create(e.info["name"], *make(), e.info["type"], e.info["using"], make, lambda: self.catalog.open(path_of(e.info["on"])[0]))

    def bodies(self, on: E, form: str, kinds: dict[str, str], static: Static) -> DataFrame:
        """(doc_id, parts) of the rows or nodes of a path: their texts as ``form`` has them, each with its elements' names.

        ``xml``: the words of the XML representation, names among them; ``string-value``: text only, in one piece;
        ``delimited-value``: text only, element by element; ``customized-value``: ``kinds`` has the form of each element
        name, others are xml.
        """
        compiler, column = Compiler(self, static), None
        r = compiler.relation(on, Tuples(None))
        if isinstance(r.item, V) and on.op == "path" and len(on.info["steps"]) > 1:  # a column of rows
            column = on.info["steps"][-1].test.name
            r = compiler.relation(E("path", on.args, {**on.info, "steps": on.info["steps"][:-1]}), Tuples(None))
        part = lambda path, text: F.struct(F.lit(path).alias("path"), text.alias("text"))
        if isinstance(r.item, Row):
            row = r.item
            cell = lambda c: string(V(F.col(row.prefix + c), row.columns[c][0]))
            names = [column] if column else [c for c, (k, many) in row.columns.items() if not many and k != "struct"]
            key = next((c for c in row.columns if c.endswith("_id") or c.endswith("key")), next(iter(row.columns)))
            parts = [part(f"row/{c}", cell(c)) for c in names]
            if form in ("xml", "xml-hl") or form == "customized-value":
                parts += [part("", F.lit(c)) for c in names if kinds.get(c, "xml") == "xml"]
            return r.df.select(F.col(row.prefix + key).cast("long").alias("doc_id"), F.array(*parts).alias("parts"))
        if not isinstance(r.item, Node):
            raise StaticError("SE2030", "a full-text index needs rows or nodes")
        store, node = r.item.store, r.item
        tops = r.df.select(node.col("doc_id").alias("d"), node.col("pre").alias("p"), (node.col("pre") + node.col("size")).alias("e")).distinct()
        below = store.frame().join(tops, (F.col("doc_id") == F.col("d")) & (F.col("pre") >= F.col("p")) & (F.col("pre") <= F.col("e")))
        names = form in ("xml", "xml-hl", "customized-value")
        below = below.where(F.col("kind") == "text" if not names else F.col("kind").isin("text", "element", "attribute"))
        own = F.regexp_replace(F.regexp_replace("path", "/(text\\(\\)|@[^/]*)$", ""), "[^/:]+:", "")
        text = F.when(F.col("kind") == "element", F.col("local")).when(F.col("kind") == "attribute", F.concat_ws(" ", "local", "value")).otherwise(F.col("value"))
        if names and kinds:
            last = F.element_at(F.split(own, "/"), -1)
            below = below.where((F.col("kind") == "text") | ~last.isin([k for k, f in kinds.items() if f != "xml"]))
        one = F.struct("pre", F.struct(own.alias("path"), text.alias("text")).alias("part"))
        parts = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["part"])
        found = below.groupBy("d", "p").agg(parts.alias("parts"))
        if form == "string-value":  # texts that touch make one word
            whole = F.array_join(F.transform("parts", lambda x: x["text"]), "")
            found = found.withColumn("parts", F.when(F.size("parts") == 1, F.col("parts")).otherwise(F.array(F.struct(F.get(F.col("parts"), F.lit(0))["path"].alias("path"), whole.alias("text")))))
        return found.groupBy(F.col("d").alias("doc_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "parts"))), lambda x: x["parts"])).alias("parts"))

    def do_drop(self, e: E, static: Static) -> DataFrame:
        kind, name = e.info["kind"], e.info["name"]
        self.check("DROP", name)
        {
            "collection": lambda: self.catalog.drop_collection(name), "document": lambda: self.catalog.drop_document(name, e.info.get("inside")), "index": lambda: self.indexes.drop(name),
            "full-text index": lambda: self.fulltext.drop(name), "trigger": lambda: self.drop_trigger(name), "module": lambda: self.drop_module(name),
            "user": lambda: self.security.drop_user(name), "role": lambda: self.security.drop_role(name),
        }[kind]()
        return self.done(f"{kind} {name} dropped")

    def drop_module(self, name: str) -> None:
        if self.modules.pop(name, None) is None:
            raise StaticError("SE1073", f"no module {name}")

    def do_rename(self, e: E, static: Static) -> DataFrame:
        self.catalog.rename_collection(e.info["name"], e.info["new"])
        return self.done("renamed")

    def do_alter(self, e: E, static: Static) -> DataFrame:
        self.security.alter_user(e.info["name"], e.info["password"])
        return self.done("altered")

    def do_grant(self, e: E, static: Static) -> DataFrame:
        self.security.grant(e.args, e.info["on"], e.info["whom"])
        return self.done("granted")

    def do_revoke(self, e: E, static: Static) -> DataFrame:
        self.security.revoke(e.args, e.info["on"], e.info["whom"])
        return self.done("revoked")

    def do_load(self, e: E, static: Static) -> DataFrame:
        """``LOAD "path" "name" ["collection"]``: the file is read by Spark, so any store it knows will do."""
        self.check("LOAD-FILE")
        source, name = e.args
        docs = self.spark.read.text(source, wholetext=True).select(F.lit(0).cast("long").alias("doc_id"), F.col("value").alias("xml"))
        self.catalog.create_document(name, e.info["collection"], load(self, docs, name))
        return self.done(f"document {name} loaded")

    def do_load_module(self, e: E, static: Static) -> DataFrame:
        self.check("LOAD-MODULE")
        self.load_module("\n".join(r.value for r in self.spark.read.text(e.args[0]).collect()), e.info["replace"])
        return self.done("module loaded")

    def load_module(self, text: str, replace: bool = False) -> str:
        """A library module: its text's declarations, under its namespace."""
        prolog = parse(text + "\n()").info["prolog"]
        uri = next(p[2] for p in prolog if p[0] == "module")
        if uri in self.modules and not replace:
            raise StaticError("SE1072", f"module {uri} exists")
        self.module_texts[uri] = text
        self.modules[uri] = [p for p in prolog if p[0] != "module"]
        return uri

    def do_metadata(self, e: E, static: Static) -> DataFrame:
        self.check("RETRIEVE-METADATA")
        return self.catalog.metadata(e.info["kind"], e.info["inside"], e.info["statistics"])

    def do_schema(self, e: E, static: Static) -> DataFrame:
        return self.catalog.schema(e.args[0])

    # ---- updates and triggers

    def add_trigger(self, name: str, time: str, event: str, target: str, path: str, each: str, action: Callable) -> None:
        """``action(session, new)``: for a BEFORE INSERT or REPLACE node trigger its result is what is inserted; None cancels."""
        if name in self.triggers:
            raise StaticError("SE3211", f"trigger {name} exists")
        self.triggers[name] = Trigger(name, time, event, target, path, each, action)

    def drop_trigger(self, name: str) -> None:
        if self.triggers.pop(name, None) is None:
            raise StaticError("SE3212", f"no trigger {name}")

    def fire(self, time: str, event: str, target: str, new: Any) -> Any:
        """Runs triggers in the order of their names; the result is the content to insert."""
        for t in sorted(self.triggers.values(), key=lambda t: t.name):
            if (t.time, t.event, t.target) == (time, event, target):
                self.depth += 1
                try:
                    if self.depth > CASCADE:
                        raise StaticError("SE3204", "triggers fire one another too often")
                    got = t.action(self, new)
                    if time == "before" and t.each == "node" and event in ("insert", "replace"):
                        if got is None:
                            return None
                        new = got
                finally:
                    self.depth -= 1
        return new

    def do_update(self, e: E, static: Static) -> DataFrame:
        compiler = Compiler(self, static)
        kind = e.info["kind"]
        over = e.args[1] if kind == "insert" else e.args[0]
        target_name = path_of(over)[0]
        self.check(_NEEDS[kind], target_name)
        event = "delete" if kind == "delete_undeep" else kind
        new = self.fire("before", event, target_name, fragment(e.args[0]) if kind == "insert" else "" if kind == "replace" else None)
        r = compiler.relation(over, Tuples(None))  # after the triggers, which may make a version themselves
        if not isinstance(r.item, Node):
            raise StaticError("SE2020", "updates need stored nodes")
        target = self.kept(r.df.select(*(r.item.col(c).alias(c) for c in ("doc_id", "pre", "size", "level", "parent", "kind", "path_id"))).distinct(), "targets")
        store: NodeStore = r.item.store
        nodes = store.nodes
        if kind == "insert":
            out = nodes if new is None else updates.insert(nodes, target, new, e.info["where"])
        elif kind == "replace":
            name, template = e.info["name"], e.args[1]
            out = updates.replace(nodes, target, lambda xml: fragment(template, {name: xml}), lambda made: self.kept(made, "made"))
        else:
            out = {"delete": lambda: updates.delete(nodes, target), "delete_undeep": lambda: updates.delete_undeep(nodes, target), "rename": lambda: updates.rename(nodes, target, e.info.get("new"))}[kind]()
        self.replace_store(store, store.replaced(self.written(out, False)))
        self.fire("after", event, target_name, None)
        return self.done(kind)

    def fresh_folder(self, stem: str) -> str:
        """A folder of its own for a stored table: in the session's folder, the cluster's shared one, or a temporary one."""
        root = self._folder or self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root and not self.spark.sparkContext.master.startswith("local"):
            raise StaticError("SE1003", "tables need a folder that all executors share: set spark.checkpoint.dir")
        if not root:
            if not self._own:
                self._own = "file://" + tempfile.mkdtemp(prefix="xylem-")
                atexit.register(shutil.rmtree, self._own.removeprefix("file://"), ignore_errors=True)
            root = self._own
        path = f"{root}/{re.sub(r'[^A-Za-z0-9_.-]', '_', stem)}-{uuid.uuid4().hex[:12]}"
        if not self._folder:
            if not self._scratch:
                atexit.register(self.close)
            self._scratch.append(path)
        return path

    def close(self) -> None:
        """Deletes the stored tables of a session that has no folder of its own."""
        context = self.spark.sparkContext
        if context._jsc is None or context._jvm is None:
            return
        for path in self._scratch:
            try:
                where = context._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the session of Spark has ended
                break
        self._scratch = []

    def written(self, nodes: DataFrame, spread: bool = True) -> DataFrame:
        """A version, stored: it doesn't carry the plans of those before it."""
        with small_tasks(self.spark):
            return stored(self.spark, nodes, self.fresh_folder("version"), spread)

    def kept(self, frame: DataFrame, stem: str) -> DataFrame:
        """``frame``, stored as it is and read back."""
        frame.write.parquet(folder := self.fresh_folder(stem))
        return self.spark.read.schema(frame.schema).parquet(folder)

    def replace_store(self, old: NodeStore, new: NodeStore) -> None:
        """The next version takes the old one's names."""
        for held in (self.catalog.collections, self.catalog.documents):
            for k, v in held.items():
                if v is old:
                    held[k] = new


def path_of(e: E) -> tuple[str, str]:
    """Document or collection of a path and the rest of it."""
    while e.op in ("paren", "union", "intersect", "except"):
        e = e.args[0]
    if e.op == "path" and e.args[0].op == "call":
        return e.args[0].args[0].args[0], "/".join(getattr(getattr(s, "test", None), "name", None) or "*" for s in e.info["steps"])
    if e.op == "call" and e.args:
        return e.args[0].args[0], ""
    raise StaticError("SE2020", "updates need a path from doc() or collection()")


def fragment(e: E, variables: dict[str, str] | None = None) -> str:
    """XML text of a constructor; variables are XML texts."""
    from xml.sax.saxutils import escape, quoteattr

    known = variables or {}
    if e.op == "make":
        body = "".join(fragment(a, known) for a in e.args)
        if e.info["kind"] == "element":
            name = e.info["name"].args[0]
            inner = e.args[0].args if e.args[0].op == "seq" else [e.args[0]]
            held = [a for a in inner if a.op == "make" and a.info["kind"] == "attribute"]
            marks = "".join(f" {k}={quoteattr(''.join(text_of(p, known) for p in parts))}" for k, parts in e.info["attributes"])
            marks += "".join(f" {a.info['name'].args[0]}={quoteattr(''.join(text_of(x, known) for x in a.args))}" for a in held)
            body = "".join(fragment(a, known) for a in inner if a not in held)
            return f"<{name}{marks}>{body}</{name}>"
        if e.info["kind"] == "attribute":
            return f"<_ {e.info['name'].args[0]}={quoteattr(''.join(text_of(x, known) for x in e.args))}/>"
        if e.info["kind"] == "comment":
            return f"<!--{''.join(text_of(a, known) for a in e.args)}-->"
        if e.info["kind"] == "processing-instruction":
            return f"<?{e.info['name'].args[0]} {''.join(text_of(a, known) for a in e.args)}?>"
        return escape("".join(text_of(a, known) for a in e.args)) if e.info["kind"] == "text" else body
    if e.op in ("seq", "paren"):
        return "".join(fragment(a, known) for a in e.args)
    if e.op == "var":
        return known[e.args[0]]
    if e.op == "path" and e.args[0].op == "var":
        return inside(known[e.args[0].args[0]], e.info["steps"])
    return escape(text_of(e, known))


def inside(xml: str, steps: list) -> str:
    """Children of an XML text along simple steps."""
    import xml.etree.ElementTree as tree

    found = [tree.fromstring(xml)]
    for s in steps:
        if s.axis == "attribute":
            return "".join(x.get(s.test.name, "") for x in found)
        if s.test.kind == "text":
            return "".join(x.text or "" for x in found)
        found = [c for x in found for c in x if s.test.name in (None, c.tag)]
    return "".join(tree.tostring(x, encoding="unicode").strip() for x in found)


def text_of(e: E, known: dict[str, str]) -> str:
    if e.op in ("lit", "chars"):
        return str(e.args[0])
    if e.op in ("paren", "seq"):
        return " ".join(text_of(a, known) for a in e.args)
    if e.op in ("var", "path"):
        return fragment(e, known)
    raise StaticError("SE2021", f"{e.op} isn't possible in the content of an update")


def element_text(v: Any, name: str, characters: dict[str, str] | None = None):
    """An element's XML text as a column."""
    from xylem.functions.values import array

    def plain(c):
        for old, new in {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", **(characters or {})}.items():
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    if isinstance(v, Row):
        parts = [F.when(F.col(v.prefix + c).isNotNull(), F.concat(F.lit(f"<{c}>"), plain(string(V(F.col(v.prefix + c), k))), F.lit(f"</{c}>"))).otherwise("") for c, (k, many) in v.columns.items() if not many]
        return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))
    if not v.fields:
        if v.many:
            return F.array_join(F.transform(array(v).col, lambda x: plain(string(V(x, v.type)))), " ")
        return plain(string(v))
    held = [F.coalesce(F.concat(F.lit(f' {k[1:]}="'), plain(string(x)), F.lit('"')), F.lit("")) for k, x in v.fields.items() if k.startswith("@")]
    body = []
    for k, x in v.fields.items():
        if k.startswith("@"):
            continue
        if k == "_VALUE":
            body.append(F.coalesce(element_text(x, k, characters), F.lit("")))
        elif x.fields:
            body.append(element_text(x, k, characters))
        elif x.many:
            body.append(F.array_join(items(x, k, plain), ""))
        else:
            body.append(F.when(x.col.isNotNull(), F.concat(F.lit(f"<{k}>"), plain(string(x)), F.lit(f"</{k}>"))).otherwise(""))
    return F.concat(F.lit(f"<{name}"), *held, F.lit(">"), *body, F.lit(f"</{name}>"))


def items(v: V, name: str, plain):
    from xylem.functions.values import array

    return F.transform(array(v).col, lambda i: F.concat(F.lit(f"<{name}>"), plain(string(V(i, v.type))), F.lit(f"</{name}>")))
