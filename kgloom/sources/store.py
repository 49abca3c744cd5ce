"""Stores as Parquet folders: the graph's tables, the extraction cache, and what they and the point store share.

Plain Parquet has no row-level merge. A table is dealt to BUCKETS by the hash of its key; an upsert reads and rewrites only
the buckets that its rows touch, into folders of their own, and an append adds folders. A manifest names the folders of
every table of a store and is committed last, by creating a file that mustn't exist yet: a reader sees all tables of one
version, a writer that lost a race fails, and what a failed writer left behind belongs to no version (`clean` deletes it).
An upsert repeated after a failure gives the same tables.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgloom.functions import names as N
from kgloom.operators import graph, kg
from kgloom.shared import Scratch, removed, sendable

BUCKETS = 32
#: Tasks that may write one bucket.
SPLITS = 4
#: Tries of a call, and seconds before the first of them is repeated.
ATTEMPTS, DELAY = 5, 5.0
#: Seconds between looks at a manifest that is being written.
WAITS = (0.1, 0.5, 2.0, 5.0)


class Conflict(Exception):
    """Another writer has committed this version."""


class _Files:
    """Small files of a folder, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.files = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = "") -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []

    def read(self, name: str) -> str:
        source = self.files.open(self._path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that mustn't exist yet: of several writers the file system lets one through."""
        try:
            out = self.files.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(name) from e
            raise
        out.write(bytearray(text.encode()))
        out.close()


def last_of_each(rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row of each key: the last in the order column, or in the order in which the rows are read."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    best = rows.select(F.struct(*key).alias("k"), at.alias("o"), F.struct(*rows.columns).alias("r")).groupBy("k").agg(F.max_by("r", "o").alias("r"))
    return best.select("r.*")


class Tables:
    """The tables below a root, in buckets, under one manifest."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ------------------------------------------------------------ manifest

    def _files(self) -> _Files:
        return _Files(self.spark, self.root)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._files().names("_manifest") if n.endswith(".json"))

    def manifest(self) -> dict[str, Any]:
        """table -> schema, key and, by bucket, folders."""
        found = self.versions()
        for wait in (*WAITS, None):
            try:
                return json.loads(self._files().read(f"_manifest/{found[-1]}.json")) if found else {}
            except ValueError:  # its writer hasn't closed it yet
                if wait is None:
                    raise
                time.sleep(wait)
        return {}

    def commit(self, before: list[int], tables: dict[str, Any]) -> None:
        self._files().create(f"_manifest/{before[-1] + 1 if before else 0}.json", json.dumps(tables))

    # ------------------------------------------------------------ reading

    def exists(self, name: str) -> bool:
        return name in self.manifest()

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or only some of its buckets."""
        return self._read(self.manifest(), name, buckets)

    def _read(self, tables: dict[str, Any], name: str, buckets: list[int] | None = None) -> DataFrame:
        if name not in tables:
            raise FileNotFoundError(f"{self.root}/{name}")
        schema = StructType.fromJson(tables[name]["schema"])
        parts = tables[name]["parts"]
        paths = [f"{self.root}/{p}" for b, found in sorted(parts.items()) if buckets is None or int(b) in set(buckets) for p in found]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket_of(self, *key: str) -> Any:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *key: str) -> list[int]:
        """The buckets that rows lie in; no more numbers than buckets."""
        return sorted(r[0] for r in rows.select(self.bucket_of(*key)).distinct().collect())

    # ------------------------------------------------------------ writing

    def write(self, rows: DataFrame, name: str, key: list[str], split: Column | None = None, within: Callable[[DataFrame, list[str]], DataFrame] | None = None, splits: int = SPLITS, in_order: bool = False) -> dict[str, list[str]]:
        """Writes rows, dealt to buckets; gives the folders of each. A key that many rows have is written by several tasks.

        split: the number that tells a bucket's tasks apart, by default of the whole row. within: what is made of the rows
        where they have been dealt to, told the columns by which they are. splits: tasks that may write one bucket; beyond
        SPLITS each of them is a task of its own. in_order: as `_write`.
        """
        number = F.xxhash64(*rows.columns) if split is None else split
        dealt = rows.withColumns({"__bucket": self.bucket_of(*key), "__split": F.pmod(number, F.lit(splits)).cast("int")})
        if splits > SPLITS:
            dealt = dealt.repartitionById(self.buckets * splits, F.col("__bucket") * F.lit(splits) + F.col("__split"))
        else:
            dealt = dealt.repartition("__bucket", "__split")
        return self._write((within(dealt, ["__bucket", "__split"]) if within else dealt).drop("__split"), name, in_order)

    def write_last(self, rows: DataFrame, name: str, key: list[str], order: str | None = None) -> dict[str, list[str]]:
        """As `write`, of only the last row of each key, by the order column or as the rows are read: what is dealt to a
        bucket's tasks by its key is reduced there, so that a row moves once."""
        split = F.pmod(F.shiftright(F.xxhash64(*key), 32), F.lit(SPLITS))
        at = F.col(order) if order else F.monotonically_increasing_id()
        dealt = rows.select(at.alias("__at"), F.struct(*rows.columns).alias("__row"), *key)
        dealt = dealt.withColumns({"__bucket": self.bucket_of(*key), "__split": split}).repartition("__bucket", "__split")
        last = dealt.groupBy("__bucket", "__split", *key).agg(F.max_by("__row", "__at").alias("__row"))
        return self._write(last.select("__row.*", "__bucket"), name)

    def _write(self, dealt: DataFrame, name: str, in_order: bool = False) -> dict[str, list[str]]:
        """in_order: rows stay in the order that they have, as a task holds a file of each bucket open instead of sorting."""
        folder, conf, files = f"{name}/{uuid.uuid4().hex}", dealt.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(files)
        if in_order:
            conf.set(files, str(self.buckets))
        try:
            dealt.write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        finally:
            conf.set(files, before)
        found = [n for n in self._files().names(folder) if n.startswith("__bucket=")]
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in found}

    def appended(self, tables: dict[str, Any], name: str, rows: DataFrame, key: list[str], write: Callable[[DataFrame, str, list[str]], dict[str, list[str]]]) -> dict[str, Any]:
        """The table's entry after rows are added."""
        entry = tables.get(name)
        both = rows if entry is None else self._read(tables, name).limit(0).unionByName(rows, allowMissingColumns=True)
        parts = write(both, name, key)
        old = {} if entry is None else entry["parts"]
        return {"schema": both.schema.jsonValue(), "key": key, "parts": {b: [*old.get(b, []), *parts.get(b, [])] for b in {*old, *parts}}}

    def added(self, tables: dict[str, Any], made: dict[str, Any], name: str) -> tuple[DataFrame, list[int]]:
        """The rows that an entry has beyond the table's, and their buckets."""
        old = {p for ps in tables.get(name, {"parts": {}})["parts"].values() for p in ps}
        parts = {b: [p for p in ps if p not in old] for b, ps in made[name]["parts"].items()}
        parts = {b: ps for b, ps in parts.items() if ps}
        return self._read({name: made[name] | {"parts": parts}}, name), sorted(map(int, parts))

    def replaced(self, tables: dict[str, Any], name: str, rows: DataFrame, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame] | None, more: list[int] | None = None, within: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> dict[str, Any]:
        """The table's entry after rows are merged into the buckets they touch (and `more`), or appended without a merge.

        within: as of `write`.
        """
        entry = tables.get(name)
        if entry is None or merge is None:
            return self.appended(tables, name, rows, key, lambda rows, name, key: self.write(rows, name, key, within=within))
        held = Scratch(self.spark)
        rows = held.stored(rows, name)  # made once, though it is read twice
        whole = entry["key"] != key  # dealt by another key: all of it is dealt anew
        at = list(range(self.buckets)) if whole else sorted({*self.touched(rows, *key), *(more or ())})
        merged = merge(self._read(tables, name, at), rows)
        parts = self.write(merged, name, key, within=within)
        kept = {} if whole else {b: p for b, p in entry["parts"].items() if int(b) not in set(at)}
        held.clear()
        return {"schema": merged.schema.jsonValue(), "key": key, "parts": kept | parts}

    def put(self, name: str, rows: DataFrame, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        before, tables = self.versions(), self.manifest()
        self.commit(before, tables | {name: self.replaced(tables, name, rows, key, merge)})

    def clean(self, keep: int = 1) -> int:
        """Deletes folders that the last versions don't name, and older manifests; how many. Not while others write."""
        files, found = self._files(), self.versions()
        named = {p.rsplit("/", 1)[0] for v in found[-keep:] for t in json.loads(files.read(f"_manifest/{v}.json")).values() for ps in t["parts"].values() for p in ps}
        gone = [f"{t}/{f}" for t in files.names() if t != "_manifest" for f in files.names(t) if f"{t}/{f}" not in named]
        gone += [f"_manifest/{v}.json" for v in found[:-keep]]
        return sum(removed(self.spark, f"{self.root}/{g}") for g in gone)

    def drop(self) -> bool:
        """Whether there was a table to drop."""
        there = bool(self.manifest())
        removed(self.spark, self.root)
        return there


def retried(call: Callable[[], Any], attempts: int, delay: float, sleep: Callable[[float], None]) -> Any:
    """What call gives, made again after a failure, as often and after as long as told; the last failure is raised."""
    for _ in range(attempts - 1):
        try:
            return call()
        except Exception:  # noqa: BLE001
            sleep(delay)
    return call()


class Table:
    """One table of a store."""

    def __init__(self, tables: Tables, name: str):
        self.tables, self.name = tables, name

    def exists(self) -> bool:
        return self.tables.exists(self.name)

    def read(self) -> DataFrame:
        return self.tables.read(self.name)


class GraphStore:
    """nodes (name, type, ...), rels (source, target, type, ...), mentions (chunk_id, name)."""

    TABLES = ("nodes", "rels", "mentions")
    #: Version of the constraints: 1 has one node for each name, 2 one for each name and type.
    VERSIONS = {1: ["name"], 2: ["name", "type"]}

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.tables = spark, Tables(spark, root, buckets)

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.TABLES:
            return self.tables.read(name)
        raise AttributeError(name)

    def merge_nodes(self, rows: DataFrame, key: list[str] | None = None, order: str | None = None, policies: dict[str, str] | None = None) -> None:
        """key: the given one, else id, else name, else the first column. Columns follow kg's policies, those of nodes unless told."""
        names = rows.columns
        self.merge(rows, key=key or (["id"] if "id" in names else ["name"] if "name" in names else names[:1]), order=order, policies=policies)

    def create_nodes(self, rows: DataFrame) -> None:
        self.tables.put("nodes", rows, self.tables.manifest().get("nodes", {}).get("key", ["name"]))

    def create_relationships(self, rows: DataFrame) -> None:
        """Appends, repeats included, where both ends are nodes."""
        self.tables.put("rels", kg.created_relationships(rows, self.nodes), ["source", "target", "type"])

    def merge_relationships(self, rows: DataFrame, order: str | None = None, policies: dict[str, str] | None = None) -> None:
        self.merge(rels=rows, order=order, policies=policies)

    def add_mentions(self, rows: DataFrame) -> None:
        self.merge(mentions=rows)

    def merge(self, nodes: DataFrame | None = None, rels: DataFrame | None = None, mentions: DataFrame | None = None, key: list[str] | None = None, order: str | None = None, policies: dict[str, str] | None = None, attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep, once: tuple[str, ...] = (), loose: DataFrame | None = None) -> None:
        """Nodes, relationships between nodes and mentions, in one commit; made again if it fails, as a point store's upsert.

        Nodes are one for each key, by default name and label: types that have one label, as ORG and ORGANIZATION, are one
        node, whose type the last row gives. policies: of columns that aren't merged as usual. once: tables whose rows
        repeat no key and have sorted sets as lists, which are left as they are. loose: a table of all names (name) that
        relationships may end at without being a node; only these are looked up, and by default all ends.
        """
        retried(lambda: self._merge(nodes, rels, mentions, key or ["name", "label"], order, policies or {}, once, loose), attempts, delay, sleep)

    def _merge(self, nodes: DataFrame | None, rels: DataFrame | None, mentions: DataFrame | None, key: list[str], order: str | None, policies: dict[str, str], once: tuple[str, ...], loose: DataFrame | None = None) -> None:
        before, tables = self.tables.versions(), self.tables.manifest()
        made = {}

        def merged(name: str, rows: DataFrame, by: list[str], how: dict[str, str]) -> None:
            single = rows if name in once else kg.reduced(rows, by, how, order)
            made[name] = self.tables.replaced(tables, name, single, by, lambda old, new: kg.merged_columns(old, new, by, how))

        if nodes is not None:
            if "label" in key and "label" not in nodes.columns:
                nodes = nodes.withColumn("label", N.label_of(F.col("type")))
            merged("nodes", nodes, key, kg.NODE_POLICIES | policies)
        if rels is not None:
            known = self.tables._read(tables | made, "nodes")
            created = kg.created_relationships(rels, known) if loose is None else kg.tied_relationships(rels, loose, known)
            merged("rels", created, ["source", "target", "type"], policies)
        if mentions is not None:  # told apart where they are dealt to, so that they move once
            made["mentions"] = self.tables.replaced(tables, "mentions", mentions, ["chunk_id"], lambda old, new: old.unionByName(new), within=lambda dealt, by: dealt.distinct())
        self.tables.commit(before, tables | made)

    def collapse(self, mapping: DataFrame, dry_run: bool = False) -> dict[str, int]:
        """Makes every entity of the mapping (entity_id, primary_id) its primary one, in all three tables by one commit.

        Entities are named by the first column of the nodes' key, as are the ends of relationships and mentions. Gives how
        many entities go and how many rows each table loses; a dry run does no more than that.
        """
        before, tables = self.tables.versions(), self.tables.manifest()
        read = lambda name, like: self.tables._read(tables, name) if name in tables else self.spark.createDataFrame([], like)
        given = {"nodes": read("nodes", "id string"), "rels": read("rels", "source string, target string, type string"), "mentions": read("mentions", "chunk_id string, name string")}
        key = tables["nodes"]["key"] if "nodes" in tables else ["id"]
        held = Scratch(self.spark)
        gone = sendable(held.stored(mapping.where("entity_id <> primary_id").select("entity_id", "primary_id"), "gone"))  # made once for all tables
        out = dict(zip(given, graph.collapsed(*given.values(), gone, key[0]), strict=True))
        keys = {"nodes": key, "rels": ["source", "target", "type"], "mentions": ["chunk_id"]}
        made = {} if dry_run else {name: self.tables.replaced({}, name, rows, keys[name], None) for name, rows in out.items() if name in tables}
        left = {name: (out[name] if dry_run else self.tables._read(made, name)).count() if name in tables else 0 for name in out}
        counts = {name: given[name].count() - left[name] for name in given}
        if not dry_run:
            self.tables.commit(before, tables | made)
        held.clear()
        return counts

    def write_by_label(self, path: str, rows: DataFrame) -> None:
        """Nodes as one folder for each label; folders of labels that rows don't have stay as they are."""
        labelled = rows if "label" in rows.columns else rows.withColumn("label", N.label_of(F.col("type")))
        dealt = labelled.repartition("label", F.pmod(F.xxhash64(*rows.columns), F.lit(SPLITS)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label").parquet(path)

    def query(self, sql: str, **args: Any) -> DataFrame:
        """SQL over nodes, rels and mentions, with named parameters; no rows if there is no store. Views of the session don't matter."""
        there = self.tables.manifest()
        known = {name: self.tables._read(there, name) for name in self.TABLES if name in there}
        if not known:
            return self.spark.createDataFrame([], "n long")
        sql = sql.strip().replace("{", "{{").replace("}", "}}")
        own = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in known)
        more = f", {sql[4:]}" if sql[:4].lower() == "with" else f" {sql}"
        return self.spark.sql(f"WITH {own}{more}", args=args, **known)

    def counts(self) -> dict[str, int]:
        there = self.tables.manifest()
        return {name: self.tables._read(there, name).count() if name in there else 0 for name in self.TABLES}

    def constraint_faults(self, version: int) -> DataFrame:
        """key, n: keys of the version's constraint that several nodes have, which a migration has to merge first."""
        key = self.VERSIONS[version]
        return self.nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def migrate(self, version: int, order: str | None = None) -> int:
        """Brings nodes under the version's constraint, the last of a key's nodes staying; how many keys were at fault."""
        faults = self.constraint_faults(version).count()
        key, nodes = self.VERSIONS[version], self.nodes
        if faults or self.tables.manifest()["nodes"]["key"] != key:
            before, tables = self.tables.versions(), self.tables.manifest()
            entry = self.tables.replaced({}, "nodes", last_of_each(nodes, key, order), key, None)
            self.tables.commit(before, tables | {"nodes": entry})
        return faults

    def drop(self) -> int:
        """How many nodes there were."""
        n = self.counts()["nodes"]
        self.tables.drop()
        return n

    def backup(self, path: str) -> dict[str, int]:
        """Each table as JSON lines below a path."""
        for name in self.TABLES:
            if self.tables.exists(name):
                self.tables.read(name).write.mode("overwrite").json(f"{path}/{name}")
        return self.counts()


class ExtractionCache:
    """cache_key -> result, timestamp. What is put one by one is kept in memory and saved for every AUTOSAVE of them."""

    AUTOSAVE = 100
    ROW = "cache_key string, result string, timestamp double"

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.tables, self.pending = spark, Tables(spark, root, buckets), {}

    def split(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with their cached result, and rows to be computed. keyed has cache_key."""
        self.save()
        if not self.tables.exists("results"):
            return keyed.withColumns({"result": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("double")}).limit(0), keyed
        held = self.tables.read("results")
        return keyed.join(held, "cache_key"), keyed.join(held, "cache_key", "left_anti")

    def set(self, rows: DataFrame) -> None:
        """rows: cache_key, result, timestamp; the latest of a key stays."""
        latest = lambda both: both.groupBy("cache_key").agg(F.max_by("result", "timestamp").alias("result"), F.max("timestamp").alias("timestamp"))
        self.tables.put("results", latest(rows.select("cache_key", "result", "timestamp")), ["cache_key"], lambda old, new: latest(old.unionByName(new)))

    def put(self, key: str, result: Any, timestamp: float | None = None) -> None:
        self.pending[key] = (key, json.dumps(result), time.time() if timestamp is None else timestamp)
        if len(self.pending) >= self.AUTOSAVE:
            self.save()

    def save(self) -> None:
        if self.pending:
            self.set(self.spark.createDataFrame(list(self.pending.values()), self.ROW))
            self.pending.clear()

    def _row(self, key: str) -> Any:
        if not self.tables.exists("results"):
            return None
        at = self.tables.touched(self.spark.createDataFrame([(key,)], "cache_key string"), "cache_key")
        return self.tables.read("results", at).where(F.col("cache_key") == key).first()

    def contains(self, key: str) -> bool:
        return key in self.pending or self._row(key) is not None

    def get(self, key: str) -> Any:
        row = self._row(key) if key not in self.pending else {"result": self.pending[key][1]}
        return json.loads(row["result"]) if row else None

    def __len__(self) -> int:
        self.save()
        return self.tables.read("results").count() if self.tables.exists("results") else 0

    def clear(self) -> None:
        self.pending.clear()
        self.tables.drop()
