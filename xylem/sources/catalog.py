"""Named collections and documents, value indexes, users and privileges, SQL connections."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.functions.values import SPARK, StaticError, V, cast, of_spark
from xylem.sources.nodes import NodeStore

#: System documents (fixed values).
SYSTEM = ["$documents", "$collections", "$schema", "$indexes", "$version", "$ftindexes", "$triggers", "$errors", "$modules"]
INDEX_TYPES = ["string", "integer", "float", "double", "date", "time", "dateTime", "yearMonthDuration", "dayTimeDuration"]


class Catalog:
    """Collections are tables (virtual documents) or node stores; documents are stores of one document."""

    def __init__(self, session):
        self.session = session
        self.collections: dict[str, Any] = {}
        self.documents: dict[tuple[str | None, str], Any] = {}

    def register(self, name: str, source: DataFrame | NodeStore) -> None:
        self.collections[name] = source

    def exists(self, name: str, collection: str | None = None) -> bool:
        if collection is not None:
            return (collection, name) in self.documents
        return name in self.collections or (None, name) in self.documents or name in SYSTEM

    def open(self, name: str, collection: str | None = None) -> DataFrame | NodeStore:
        if name.startswith("$"):
            return self.system(name)
        if collection is not None:
            if (collection, name) in self.documents:
                return self.documents[collection, name]
            held = self.collections.get(collection)
            if isinstance(held, NodeStore) and name.isdigit():
                return NodeStore(held.nodes, held.uris, collection, [int(name)], held.version)
        if (None, name) in self.documents:
            return self.documents[None, name]
        if name in self.collections:
            return self.collections[name]
        raise StaticError("FODC0002", f"no document or collection {name}")

    def create_collection(self, name: str) -> None:
        if name in self.collections:
            raise StaticError("SE2002", f"collection {name} exists")
        self.collections[name] = self.session.empty_store(name)

    def drop_collection(self, name: str) -> None:
        if self.collections.pop(name, None) is None:
            raise StaticError("SE2003", f"no collection {name}")
        self.documents = {k: v for k, v in self.documents.items() if k[0] != name}

    def rename_collection(self, name: str, new: str) -> None:
        if new in self.collections:
            raise StaticError("SE2002", f"collection {new} exists")
        self.collections[new] = self.collections.pop(name)
        self.documents = {(new if k[0] == name else k[0], k[1]): v for k, v in self.documents.items()}

    def create_document(self, name: str, collection: str | None = None, store: NodeStore | None = None) -> None:
        if (collection, name) in self.documents:
            raise StaticError("SE2001", f"document {name} exists")
        if collection is not None and collection not in self.collections:
            raise StaticError("SE2003", f"no collection {collection}")
        store = store or self.session.empty_store(name)
        self.documents[collection, name] = store
        if collection is not None and isinstance(self.collections[collection], NodeStore):
            held = self.collections[collection]
            self.collections[collection] = held.replaced(held.nodes.unionByName(store.nodes))

    def drop_document(self, name: str, collection: str | None = None) -> None:
        if self.documents.pop((collection, name), None) is None:
            raise StaticError("SE2006", f"no document {name}")
        if collection is not None:
            kept = [v for (c, _), v in self.documents.items() if c == collection]
            store = self.session.empty_store(collection)
            for k in kept:
                store = store.replaced(store.nodes.unionByName(k.nodes))
            self.collections[collection] = store

    def names(self, kind: str, inside: str | None = None) -> list[tuple[str, str]]:
        if kind == "collections":
            return [(n, "nodes" if isinstance(x, NodeStore) else "table") for n, x in self.collections.items()]
        return [(n, c or "") for (c, n) in self.documents if inside is None or c == inside]

    def metadata(self, kind: str, inside: str | None = None, statistics: bool = False) -> DataFrame:
        rows = self.names(kind, inside)
        if statistics:
            counts = [(n, x, self._size(n if kind == "collections" else (x or None, n))) for n, x in rows]
            return self.session.spark.createDataFrame(counts, "name string, info string, size long")
        return self.session.spark.createDataFrame(rows, "name string, info string")

    def _size(self, key) -> int:
        found = self.collections[key] if isinstance(key, str) else self.documents[key]
        return (found.nodes if isinstance(found, NodeStore) else found).count()

    def schema(self, name: str) -> DataFrame:
        """Descriptive schema: distinct paths of a store, or the columns of a table."""
        found = self.open(name)
        if isinstance(found, NodeStore):
            return found.descriptive_schema()
        return self.session.spark.createDataFrame([(f"/row/{f.name}", f.dataType.simpleString()) for f in found.schema.fields], "path string, kind string")

    def system(self, name: str) -> DataFrame:
        spark, session = self.session.spark, self.session
        rows = {
            "$collections": lambda: self.names("collections"), "$documents": lambda: self.names("documents"), "$version": lambda: [("3.6", "xylem")],
            "$indexes": lambda: [(n, x[1]) for n, x in session.indexes.indexes.items()], "$ftindexes": lambda: [(n, x.options) for n, x in session.fulltext.indexes.items()],
            "$triggers": lambda: [(t.name, f"{t.time} {t.event}") for t in session.triggers.values()], "$modules": lambda: [(n, "") for n in session.modules],
            "$errors": lambda: [("XPST0003", "syntax"), ("XPST0008", "unbound name"), ("XPTY0004", "type"), ("FORG0001", "value to cast")],
        }
        for stem in ("$schema", "$document_", "$collection_", "$schema_"):
            if name.startswith(stem) and name != "$schema":
                return self.schema(name.split("_", 1)[1])
        if name == "$schema":
            out = None
            for n in self.collections:
                part = self.schema(n).select(F.lit(n).alias("name"), F.col("path").alias("info"))
                out = part if out is None else out.unionByName(part)
            return out if out is not None else spark.createDataFrame([], "name string, info string")
        if name not in rows:
            raise StaticError("FODC0002", f"no system document {name}")
        return spark.createDataFrame(rows[name](), "name string, info string")


class Indexes:
    """Value indexes: key tables, sorted by key within files so that scans skip what they can't need."""

    def __init__(self, session):
        self.session = session
        self.indexes: dict[str, tuple[DataFrame, str]] = {}
        self.makers: dict[str, tuple] = {}

    def create(self, name: str, rows: DataFrame, key: str, kind: str, using: str = "btree", again: Callable[[], tuple[DataFrame, str]] | None = None, source: Callable[[], Any] | None = None) -> None:
        """An index over ``rows`` by column ``key`` cast to ``kind``; rows without a key aren't in it. ``again``: makes the
        rows anew, when ``source`` has changed."""
        if name in self.indexes:
            raise StaticError("SE2033", f"index {name} exists")
        if kind not in INDEX_TYPES or using == "bstrie" and kind != "string" or using not in ("btree", "bstrie"):
            raise StaticError("SE2034", f"no {using} index on xs:{kind}")
        have = of_spark(rows.schema[key].dataType)[0]
        table = rows.withColumn(key, cast(V(F.col(key), have), kind).col if have != kind else F.col(key)).where(F.col(key).isNotNull())
        folder = self.session.fresh_folder(f"index-{name}")
        table.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(folder)
        self.indexes[name] = self.session.spark.read.parquet(folder), key
        if again and source:
            self.makers[name] = again, source, source(), kind, using

    def drop(self, name: str) -> None:
        if self.indexes.pop(name, None) is None:
            raise StaticError("SE1061", f"no index {name}")

    def table(self, name: str) -> tuple[DataFrame, str]:
        if name not in self.indexes:
            raise StaticError("SE1061", f"no index {name}")
        if name in self.makers:
            again, source, held, kind, using = self.makers[name]
            if source() is not held:  # its documents have a later version
                del self.indexes[name]
                self.create(name, *again(), kind, using, again, source)
        return self.indexes[name]

    def keys(self, name: str) -> DataFrame:
        table, key = self.table(name)
        return table.select(F.col(key).alias("key")).distinct()


#: Privileges (fixed values).
PRIVILEGES = [
    "CREATE-USER", "CREATE-DOCUMENT", "CREATE-COLLECTION", "CREATE-INDEX", "CREATE-TRIGGER", "LOAD-FILE", "LOAD-MODULE", "QUERY", "INSERT", "DELETE", "RENAME", "REPLACE", "RETRIEVE-METADATA", "DROP",
]


class Security:
    """Users, roles and privileges. Off until the first user is created; then every access is checked."""

    def __init__(self):
        self.users: dict[str, str] = {}
        self.roles: dict[str, set] = {"DBA": {("ALL", None, None)}, "PUBLIC": set()}
        self.members: dict[str, set[str]] = {}
        self.granted: dict[str, set] = {}
        self.user = "SYSTEM"

    @staticmethod
    def digest(password: str) -> str:
        return hashlib.sha256(password.encode()).hexdigest()

    def create_user(self, name: str, password: str) -> None:
        if name in self.users:
            raise StaticError("SE2057", f"user {name} exists")
        self.users[name] = self.digest(password)

    def alter_user(self, name: str, password: str) -> None:
        self._user(name)
        self.users[name] = self.digest(password)

    def drop_user(self, name: str) -> None:
        self._user(name)
        del self.users[name]
        self.members.pop(name, None)
        self.granted.pop(name, None)

    def _user(self, name: str) -> None:
        if name not in self.users:
            raise StaticError("SE2056", f"no user {name}")

    def login(self, name: str, password: str) -> None:
        if name != "SYSTEM" and self.users.get(name) != self.digest(password):
            raise StaticError("SE3053", "wrong user or password")
        self.user = name

    def state(self) -> dict:
        """Users with password digests, roles, members and privileges, as plain lists."""
        sets = lambda d: {k: sorted(map(list, v), key=str) for k, v in d.items()}
        return {"users": self.users, "roles": sets(self.roles), "members": {k: sorted(v) for k, v in self.members.items()}, "granted": sets(self.granted)}

    def restore(self, state: dict) -> None:
        self.users = dict(state["users"])
        self.roles, self.granted = ({k: {tuple(x) for x in v} for k, v in state[part].items()} for part in ("roles", "granted"))
        self.members = {k: set(v) for k, v in state["members"].items()}

    def create_role(self, name: str) -> None:
        if name in self.roles:
            raise StaticError("SE3069", f"role {name} exists")
        self.roles[name] = set()

    def drop_role(self, name: str) -> None:
        if self.roles.pop(name, None) is None:
            raise StaticError("SE3070", f"no role {name}")
        for held in self.members.values():
            held.discard(name)

    def grant(self, names: list[str], on: tuple | None, whom: str) -> None:
        for name in names:
            if on is None and name in self.roles:
                self.members.setdefault(whom, set()).add(name)
            else:
                self._privilege(name)
                self._store(whom).add((name, *(on or (None, None))))

    def revoke(self, names: list[str], on: tuple | None, whom: str) -> None:
        for name in names:
            if on is None and name in self.roles:
                self.members.get(whom, set()).discard(name)
            else:
                self._privilege(name)
                self._store(whom).discard((name, *(on or (None, None))))

    def _privilege(self, name: str) -> None:
        if name not in PRIVILEGES and name != "ALL":
            raise StaticError("SE3068", f"no privilege {name}")

    def _store(self, whom: str) -> set:
        return self.roles[whom] if whom in self.roles else self.granted.setdefault(whom, set())

    def allowed(self, privilege: str, kind: str | None = None, name: str | None = None) -> bool:
        if not self.users or self.user == "SYSTEM":
            return True
        held = set(self.granted.get(self.user, set())) | self.roles["PUBLIC"]
        for role in self.members.get(self.user, set()):
            held |= self.roles.get(role, set())
        return any(p in (privilege, "ALL") and (k in (None, "database") or (k, n) == (kind, name)) for p, k, n in held)


class Connector:
    """Relational sources: ``sql:connect`` and what follows it. ``spark:`` is this session's own views; any other
    address is read by JDBC; updates run through a DB-API connection that the caller registers."""

    def __init__(self, spark):
        self.spark = spark
        self.handles: dict[str, dict] = {}
        self.statements: dict[str, tuple[str, str]] = {}
        self.drivers: dict[str, Any] = {}

    def connect(self, url: str, user: str | None = None, password: str | None = None, options: str | None = None) -> str:
        handle = f"c{len(self.handles) + 1}"
        self.handles[handle] = {"url": url, "user": user, "password": password}
        return handle

    def _handle(self, handle: str) -> dict:
        if handle not in self.handles:
            raise StaticError("SE2113", "no such connection")
        return self.handles[handle]

    def execute(self, handle: str, query: str, params: list) -> DataFrame:
        if handle in self.statements:
            handle, query = self.statements[handle][0], self.statements[handle][1]
        at = self._handle(handle)
        if at["url"].startswith("spark:"):
            return self.spark.sql(query, args=params) if params else self.spark.sql(query)
        reader = self.spark.read.format("jdbc").option("url", at["url"]).option("query", query)
        for k in ("user", "password"):
            if at[k]:
                reader = reader.option(k, at[k])
        return reader.load()

    def call(self, name: str, given: list) -> Any:
        if name == "connect":
            return self.connect(*given)
        if name == "close":
            self._handle(given[0])
            del self.handles[given[0]]
            return True
        if name == "prepare":
            self._handle(given[0])
            self.statements[key := f"s{len(self.statements) + 1}"] = given[0], given[1]
            return key
        at = self._handle(self.statements[given[0]][0] if given[0] in self.statements else given[0])
        if name in ("commit", "rollback"):
            driver = self.drivers.get(at["url"])
            getattr(driver, name)() if driver else None
            return True
        if name == "exec-update":
            driver = self.drivers.get(at["url"])
            if not driver:
                raise StaticError("SE2112", "no driver for updates at this address")
            return driver.cursor().execute(given[1], given[2:]).rowcount
        raise StaticError("XPST0017", f"no function sql:{name}")


assert all(k in SPARK for k in INDEX_TYPES)
