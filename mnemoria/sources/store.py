"""A writable store: tables of Parquet files whose contents a log of versions lists.

A write adds files and never changes one. An append adds a file set; a delete adds a delete vector, the keys
that are gone from all rows written before; an upsert adds both. A transaction collects the changes of any
number of tables, and the version that lists them is written last, by one rename: readers see all of them or
none, and what fails on the way leaves files that no version names (`vacuum` removes them). A reader may stay
on a version while others write.

Reading joins the keys of delete vectors with the rows older than them, and only those; `compact` writes a
table anew as one file set without vectors. Rows of a null key are not stored.
"""

from __future__ import annotations

import atexit
import copy
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import StoreError
from .log import Folder, Log

#: How often an append that another writer came before is tried again.
TRIES = 10
_SEQ, _GONE = "__written", "__gone"


def _read(spark: SparkSession, state: dict | None, root: str, table: str, key: str) -> DataFrame:
    """The rows of a table in a state: file sets without the rows that later delete vectors name."""
    found = (state or {"tables": {}})["tables"].get(table)
    if not found or not found["schema"]:
        raise StoreError("STORAGE_READ_FAILED", f"no table {table}")
    schema = StructType.fromJson(found["schema"])
    files = lambda sets: spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in sets]) if sets else spark.createDataFrame([], schema)
    last = max((seq for _, seq in found["deletes"]), default=-1)
    fresh = files([p for p, seq in found["adds"] if seq >= last])
    older = [(p, seq) for p, seq in found["adds"] if seq < last]
    if not older:
        return fresh
    old = reduce(DataFrame.unionByName, [files([p]).withColumn(_SEQ, F.lit(seq)) for p, seq in older])
    vectors = [spark.read.schema(StructType([schema[key]])).parquet(f"{root}/{p}").withColumn(_GONE, F.lit(seq)) for p, seq in found["deletes"]]
    gone = reduce(DataFrame.unionByName, vectors).groupBy(key).agg(F.max(_GONE).alias(_GONE))
    kept = old.join(gone, key, "left").filter(F.col(_GONE).isNull() | (F.col(_GONE) <= F.col(_SEQ)))
    return kept.select(*schema.names).unionByName(fresh)


class Transaction:
    """Changes of some tables that become a version together, at `commit` or at the end of a `with` block."""

    def __init__(self, store: Store):
        self.store, self.spark, self.root = store, store.spark, store.root
        self.base = store.log.latest()
        self.state = copy.deepcopy(store.log.read(self.base)) or {"seq": 0, "tables": {}}
        self.only_appends, self.changes = True, []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def exists(self, table: str) -> bool:
        return table in self.state["tables"]

    def read(self, table: str, key: str = "id") -> DataFrame:
        """With this transaction's own changes."""
        self.only_appends = False
        return _read(self.spark, self.state, self.root, table, key)

    def _write(self, rows: DataFrame, table: str) -> tuple[str, dict]:
        path = f"data/{table}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        return path, rows.schema.jsonValue()

    def _list(self, table: str, kind: str, path: str, schema: dict | None, seq: int) -> None:
        entry = self.state["tables"].setdefault(table, {"schema": None, "adds": [], "deletes": [], "properties": {}})
        entry["schema"] = entry["schema"] or schema
        entry[kind].append([path, seq])
        self.state["seq"] = seq
        self.changes.append((table, kind, path, schema))

    def _add(self, table: str, rows: DataFrame, key: str) -> DataFrame:
        """Writes rows and returns them as written."""
        known = self.state["tables"].get(table, {}).get("schema")
        if known:
            rows = rows.select(*StructType.fromJson(known).names)
        path, schema = self._write(rows.filter(F.col(key).isNotNull()), table)
        self._list(table, "adds", path, schema, self.state["seq"] + 1)
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}")

    def append(self, table: str, rows: DataFrame, key: str = "id") -> DataFrame:
        """Rows as they are, repeated keys included."""
        return self._add(table, rows, key)

    def delete(self, table: str, keys: DataFrame, key: str = "id") -> None:
        if self.exists(table):
            self.only_appends = False
            path, _ = self._write(keys.select(key).filter(F.col(key).isNotNull()).distinct(), f"{table}-gone")
            self._list(table, "deletes", path, None, self.state["seq"] + 1)

    def upsert(self, table: str, rows: DataFrame, key: str = "id") -> None:
        """Rows replace those of their keys; of rows that repeat a key the largest stays."""
        self.only_appends = False
        other = [c for c in rows.columns if c != key]
        one = rows.groupBy(key).agg(F.max(F.struct(*other)).alias("r")).select(key, "r.*").select(*rows.columns)
        path, schema = self._write(one.filter(F.col(key).isNotNull()), table)
        seq = self.state["seq"] + 1
        if self.exists(table):  # the vector has the rows' number: it names what is older than they are
            gone, _ = self._write(self.spark.read.schema(one.schema).parquet(f"{self.root}/{path}").select(key), f"{table}-gone")
            self._list(table, "deletes", gone, None, seq)
        self._list(table, "adds", path, schema, seq)

    def insert_new(self, table: str, rows: DataFrame, key: str = "id") -> DataFrame:
        """Rows whose key is not there yet are written, the smallest for each key; returns those."""
        other = [c for c in rows.columns if c != key]
        one = rows.groupBy(key).agg(F.min(F.struct(*other)).alias("r")).select(key, "r.*").select(*rows.columns)
        if self.exists(table):
            one = one.join(self.read(table, key).select(key), key, "left_anti").select(*rows.columns)
        return self._add(table, one, key)

    def set_property(self, table: str, name: str, value: str) -> None:
        """A fact about a table, kept with its versions; the table must be there."""
        if not self.exists(table):
            raise StoreError("STORAGE_WRITE_FAILED", f"no table {table}")
        self.only_appends = False
        self.state["tables"][table]["properties"][name] = value

    def commit(self) -> int:
        """Write the version. Appends that another writer came before are put after that writer's changes."""
        for _ in range(TRIES):
            try:
                self.store.log.commit(self.base + 1, self.state)
                return self.base + 1
            except StoreError:
                latest = self.store.log.latest()
                if not self.only_appends or latest == self.base:
                    raise
                changes, self.changes = self.changes, []
                self.base, self.state = latest, self.store.log.read(latest)
                for table, kind, path, schema in changes:
                    self._list(table, kind, path, schema, self.state["seq"] + 1)
        raise StoreError("STORAGE_CONSISTENCY", "other writers came first each time")


class Store:
    """version: read this one for good; None: the last one at each read."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.log = Log(spark, self.root)

    def at(self, version: int) -> Store:
        """A reader that stays on a version."""
        return Store(self.spark, self.root, version)

    def latest(self) -> int:
        return self.log.latest() if self.version is None else self.version

    def state(self) -> dict:
        return self.log.read(self.latest()) or {"seq": 0, "tables": {}}

    def exists(self, table: str) -> bool:
        return table in self.state()["tables"]

    def read(self, table: str, key: str = "id") -> DataFrame:
        return _read(self.spark, self.state(), self.root, table, key)

    def properties(self, table: str) -> dict[str, str]:
        return self.state()["tables"].get(table, {}).get("properties", {})

    def transaction(self) -> Transaction:
        if self.version is not None:
            raise StoreError("STORAGE_WRITE_FAILED", f"this reader stays on version {self.version}")
        return Transaction(self)

    def append(self, table: str, rows: DataFrame, key: str = "id") -> None:
        """Rows as they are, repeated keys included."""
        with self.transaction() as t:
            t.append(table, rows, key)

    def upsert(self, table: str, rows: DataFrame, key: str = "id") -> None:
        """Rows replace those of their keys; of rows that repeat a key the largest stays."""
        with self.transaction() as t:
            t.upsert(table, rows, key)

    def insert_new(self, table: str, rows: DataFrame, key: str = "id") -> None:
        """Rows whose key is not there yet are written, the smallest for each key."""
        with self.transaction() as t:
            t.insert_new(table, rows, key)

    def delete(self, table: str, keys: DataFrame, key: str = "id") -> None:
        with self.transaction() as t:
            t.delete(table, keys, key)

    def expire(self, table: str, now: int, key: str = "id", expires: str = "expires_at") -> None:
        """Rows whose time is over go; rows without one stay."""
        with self.transaction() as t:
            t.delete(table, t.read(table, key).filter(F.col(expires) < now), key)

    def sink_batch(self, rows: DataFrame, embed, raw: str = "verbatim", table: str = "memories", vectors: str = "vectors") -> None:
        """A batch (id, content, ...): raw rows first, then new memories together with their vectors.

        embed turns (id, content) into (id, embedding). Texts whose hash has a vector are not embedded
        again. If anything fails after the raw rows, neither memories nor vectors change.
        """
        self.append(raw, rows.select("id", "content"))
        try:
            with self.transaction() as t:
                ids = t.insert_new(table, rows).select("id")
                hashed = rows.join(ids, "id", "left_semi").withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
                if t.exists(vectors):
                    hashed = hashed.join(t.read(vectors).select("content_hash").distinct(), "content_hash", "left_anti")
                once = hashed.groupBy("content_hash").agg(F.min(F.struct("id", "content")).alias("r")).select("r.*", "content_hash")
                made = embed(once.select("id", "content")).join(once.select("id", "content_hash"), "id")
                t.upsert(vectors, made.select("id", "embedding", "content_hash"))
        except Exception as e:
            raise StoreError("STORAGE_CONSISTENCY", "the batch's memories and vectors are not written") from e

    def rebuild(self, embed, table: str = "memories", vectors: str = "vectors") -> None:
        """All vectors anew from the table of record; vectors of rows that are gone go."""
        with self.transaction() as t:
            rows = t.read(table).select("id", "content")
            made = embed(rows).join(rows.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")), "id").select("id", "embedding", "content_hash")
            t.upsert(vectors, made)
            t.delete(vectors, t.read(vectors).join(rows, "id", "left_anti"))

    def compact(self, table: str, key: str = "id") -> None:
        """The table as one file set without delete vectors; readers of older versions go on as before."""
        with self.transaction() as t:
            rows = t.read(table, key)
            path, schema = t._write(rows, table)
            kept = t.state["tables"][table]["properties"]
            t.state["tables"][table] = {"schema": schema, "adds": [], "deletes": [], "properties": kept}
            t._list(table, "adds", path, schema, t.state["seq"] + 1)

    def vacuum(self, keep: int = 1) -> None:
        """Keep the last versions; remove the others, and the files that none of those lists."""
        last = self.log.versions()[-keep:]
        listed = {p for v in last for t in self.log.read(v)["tables"].values() for kind in ("adds", "deletes") for p, _ in t[kind]}
        if last:
            self.log.forget_before(last[0])
        folder = Folder(self.spark, self.root)
        for name in folder.names("data"):
            if f"data/{name}" not in listed:
                folder.delete(f"data/{name}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name in the one that the session shares; a temporary one on a local master without it.

    It is removed when the driver's Python ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("MISSING_CONFIG", "set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mnemoria-store-")
    root = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    try:
        Folder(spark, root).delete()
    except Exception:  # noqa: BLE001  the session has gone: the folder's owner cleans up
        pass


def scratch(spark: SparkSession) -> Store:
    """A store of its own in the shared folder of the session."""
    return Store(spark, shared_folder(spark, "store"))
