"""Upserts of the graph store by policy, one commit for all tables, and entities that become one."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import kg
from kgloom.plans import indexing
from kgloom.sources.points import PointStore
from kgloom.sources.store import GraphStore

NODE = "name string, type string, description string, keywords array<string>, n int, at int"


def store_of(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/g", buckets=4)


def test_a_second_batch_loses_nothing(spark, tmp_path):
    g = store_of(spark, tmp_path)
    g.merge(spark.createDataFrame([("a", "ORG", "first", ["k1"], 3, 1), ("b", "PERSON", None, None, None, 1)], NODE), order="at")
    g.merge(spark.createDataFrame([("a", "ORGANIZATION", "second and longer", ["k2", "k1"], 2, 2), ("b", "PERSON", "x", [], 7, 1)], NODE), order="at")
    got = {r["name"]: r.asDict() for r in g.nodes.collect()}
    assert set(got) == {"a", "b"}  # ORG and ORGANIZATION have one label
    assert (got["a"]["type"], got["a"]["description"], got["a"]["keywords"], got["a"]["n"]) == ("ORGANIZATION", "first", ["k1", "k2"], 2)
    assert (got["b"]["description"], got["b"]["keywords"], got["b"]["n"]) == ("x", [], 7)
    g.merge(spark.createDataFrame([("a", "ORG", None, None, None, 3)], NODE), order="at")
    assert g.nodes.where("name = 'a'").first()["keywords"] == ["k1", "k2"]


POLICIES = {"l": "last", "f": "first", "g": "greatest", "t": "longest", "u": "unite", "c": "concatenate"}
ROW = "k int, at int, l string, f string, g int, t string, u array<int>, c array<int>"


def plain(rows):
    out = {}
    for k, at, last, first, g, t, u, c in sorted(rows, key=lambda r: r[1]):
        o = out.setdefault(k, dict.fromkeys(POLICIES))
        o["l"] = o["l"] if last is None else last
        o["f"] = first if o["f"] is None else o["f"]
        o["g"] = max((x for x in (o["g"], g) if x is not None), default=None)
        o["t"] = t if t is not None and (o["t"] is None or len(t) > len(o["t"])) else o["t"]
        o["u"] = o["u"] if u is None else sorted({*(o["u"] or ()), *u})
        o["c"] = o["c"] if c is None else (o["c"] or []) + c
    return out


def test_policies_against_plain_version(spark):
    rng = random.Random(7)
    maybe = lambda x: x if rng.random() < 0.7 else None
    rows = [(rng.randrange(15), at, maybe(f"l{at}"), maybe(f"f{at}"), maybe(rng.randrange(99)), maybe("x" * rng.randrange(5) + str(at)), maybe([rng.randrange(9) for _ in range(rng.randrange(4))]), maybe([rng.randrange(9) for _ in range(rng.randrange(3))])) for at in range(200)]
    frame = spark.createDataFrame(rows, ROW).repartition(6)
    once = kg.reduced(frame, ["k"], POLICIES, "at").drop("at")
    got, want = {r["k"]: {c: r[c] for c in POLICIES} for r in once.collect()}, plain(rows)
    assert [(k, c, got[k][c], want[k][c]) for k in want for c in POLICIES if got[k][c] != want[k][c]] == []
    for cut in (1, 100, 199):
        old, new = (kg.reduced(frame.where(w), ["k"], POLICIES, "at").drop("at") for w in (f"at < {cut}", f"at >= {cut}"))
        assert {r["k"]: {c: r[c] for c in POLICIES} for r in kg.merged_columns(old, new, ["k"], POLICIES).collect()} == plain(rows)
    with pytest.raises(ValueError, match="no such policy"):
        kg.reduced(frame, ["k"], {"l": "any"})


def test_one_commit_or_none(spark, tmp_path):
    g = store_of(spark, tmp_path)
    nodes = spark.createDataFrame([("a", "T"), ("b", "T")], "name string, type string")
    rels = spark.createDataFrame([("a", "b", "R"), ("a", "nobody", "R")], "source string, target string, type string")
    said = spark.createDataFrame([(1, "a"), (1, "a")], "chunk_id long, name string")
    g.merge(nodes, rels, said)
    assert g.counts() == {"nodes": 2, "rels": 1, "mentions": 1} and len(g.tables.versions()) == 1
    tries, waits, real = [], [], g.tables.commit

    def fails(before, made):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("lost")
        real(before, made)

    g.tables.commit = fails
    g.merge(nodes.withColumn("name", F.concat("name", F.lit("2"))), sleep=waits.append)
    assert len(tries) == 3 and len(waits) == 2 and g.counts() == {"nodes": 4, "rels": 1, "mentions": 1} and len(g.tables.versions()) == 2


def test_collapse_moves_all_three_tables(spark, tmp_path):
    g = store_of(spark, tmp_path)
    g.merge(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, name string"), key=["id"])
    g.tables.put("rels", spark.createDataFrame([(1, 3, "R", "d"), (2, 3, "R", "d"), (3, 2, "R", "e"), (2, 1, "R", "f")], "source long, target long, type string, description string"), ["source", "target", "type"])
    g.add_mentions(spark.createDataFrame([(7, 1), (7, 2), (8, 2)], "chunk_id long, name long"))
    mapping = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "entity_id long, primary_id long")
    before = g.tables.versions()
    assert g.collapse(mapping, dry_run=True) == {"nodes": 1, "rels": 1, "mentions": 1} and g.tables.versions() == before
    assert g.collapse(mapping) == {"nodes": 1, "rels": 1, "mentions": 1}
    assert sorted(tuple(r) for r in g.rels.select("source", "target", "description").collect()) == [(1, 1, "f"), (1, 3, "d"), (3, 1, "e")]
    assert sorted(tuple(r) for r in g.mentions.select("chunk_id", "name").collect()) == [(7, 1), (8, 1)]
    assert {r["id"] for r in g.nodes.collect()} == {1, 3}


def test_queries_leave_the_session_alone(spark, tmp_path):
    g = store_of(spark, tmp_path)
    g.merge(spark.createDataFrame([("a", "T"), ("{b}", "T")], "name string, type string"))
    spark.range(5).createOrReplaceTempView("nodes")
    assert g.query("SELECT count(*) AS n FROM nodes WHERE name = :name", name="{b}").first()["n"] == 1
    assert g.query("WITH n AS (SELECT name FROM nodes WHERE name <> '{b}') SELECT * FROM n").first()["name"] == "a"
    assert spark.table("nodes").count() == 5
    spark.catalog.dropTempView("nodes")


def test_labels_are_written_apart(spark, tmp_path):
    g, path = store_of(spark, tmp_path), f"file://{tmp_path}/labels"
    rows = lambda *r: spark.createDataFrame(r, "name string, type string")
    g.write_by_label(path, rows(("a", "ORG"), ("b", "PERSON"), ("c", "ORGANIZATION")))
    g.write_by_label(path, rows(("d", "ORG")))
    assert {(r["name"], r["label"]) for r in spark.read.parquet(path).collect()} == {("d", "Organization"), ("b", "Person")}


def test_index_commits_the_graph_once(spark, tmp_path):
    g, points = store_of(spark, tmp_path), PointStore(spark, f"file://{tmp_path}/p", buckets=2)
    docs = spark.createDataFrame([(1, "Alice met Bob in Paris"), (2, "Bob met Carol in Rome")], "doc_id long, text string")
    indexing.index(docs.where("doc_id = 1"), points, g)
    indexing.index(docs, points, g)
    assert len(g.tables.versions()) == 2
    assert {r["name"] for r in g.nodes.collect()} == {"alice", "bob", "paris", "carol", "rome"}


def test_collapse_makes_its_mapping_once(spark, tmp_path):
    """All three tables use the mapping, which is computed once for a call."""
    store = GraphStore(spark, str(tmp_path / "g"))
    store.merge(spark.createDataFrame([(i, "x", "T") for i in range(4)], "id long, name string, type string"), key=["id"])
    store.tables.put("rels", spark.createDataFrame([(0, 1, "R"), (2, 3, "R"), (1, 2, "R")], "source long, target long, type string"), ["source", "target", "type"])
    store.add_mentions(spark.createDataFrame([(7, 0), (7, 1), (8, 2)], "chunk_id long, name long"))
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    mapping = spark.createDataFrame([(i, i // 2 * 2) for i in range(4)], "entity_id long, primary_id long").coalesce(1).mapInArrow(counted, "entity_id long, primary_id long")
    told = store.collapse(mapping, dry_run=True)
    assert told == {"nodes": 2, "rels": 0, "mentions": 1} and calls.value == 4
    assert store.collapse(mapping) == told and calls.value == 8
    assert sorted(tuple(r) for r in store.rels.collect()) == [(0, 0, "R"), (0, 2, "R"), (2, 2, "R")]
    assert sorted(tuple(r) for r in store.mentions.collect()) == [(7, 0), (8, 2)]
