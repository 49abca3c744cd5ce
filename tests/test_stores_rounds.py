"""The appending point store and its pruned search, and runs with memory."""

import os
import random

from pyspark.sql import functions as F

from kgloom.operators import conversation
from kgloom.operators import retrieval as R
from kgloom.plans import rag, rounds
from kgloom.plans.providers import using
from kgloom.sources.points import PointStore


def zipf(rng, words):
    return f"word{int(words ** rng.random()) - 1}"


def corpus(spark, n, words=400, length=30, seed=4):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(zipf(rng, words) for _ in range(rng.randint(0, length)))) for i in range(n)], "doc long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def best(df):
    return rows_of(df.select("query_id", "doc", "score", "rank"))


def test_an_upsert_writes_what_it_brings(spark, tmp_path):
    store = PointStore(spark, f"file://{tmp_path}/s", buckets=8)
    docs = corpus(spark, 300)
    store.create(docs)
    before = {(t, b): p for t, e in store.tables.manifest().items() for b, p in e["parts"].items()}
    new = spark.createDataFrame([(i, f"word1 word2 fresh{i}") for i in (3, 4, 5, 1000, 1001)], "doc long, text string")
    store.upsert(new)
    after = store.tables.manifest()
    written = {t: [p for b, ps in e["parts"].items() for p in ps if p not in before.get((t, b), [])] for t, e in after.items()}
    count = lambda t: spark.read.parquet(*(f"{store.tables.root}/{p}" for p in written[t])).count()
    assert all(set(p) <= set(after[t]["parts"][b]) for (t, b), p in before.items())  # nothing is rewritten
    assert (count("points"), count("postings"), count("replaced")) == (5, 15, 3)
    whole = docs.join(new, "doc", "left_anti").unionByName(new)
    assert rows_of(store.points.read()) == rows_of(whole)
    assert rows_of(store.postings.read()) == rows_of(R.postings(whole, "doc"))
    store.upsert(new.limit(2))
    store.compact()
    assert rows_of(store.points.read()) == rows_of(whole) and rows_of(store.postings.read()) == rows_of(R.postings(whole, "doc"))
    assert "replaced" not in store.tables.manifest() and store.tables.clean() > 0 and rows_of(store.points.read()) == rows_of(whole)


def test_pruned_search_is_exact_and_reads_less(spark, tmp_path):
    docs = corpus(spark, 3000, words=2000, length=40)
    rng = random.Random(8)
    asked = spark.createDataFrame([(i, " ".join(zipf(rng, 2000) for _ in range(rng.randint(1, 12))) + " nothing") for i in range(40)], "item long, text string")
    store = PointStore(spark, f"file://{tmp_path}/s", buckets=4)
    store.create(docs.where("doc % 3 <> 0").unionByName(docs.where("doc % 5 = 0 and doc % 3 = 0").withColumn("text", F.lit("word0 word1 old"))))
    store.upsert(docs.where("doc % 3 = 0"))
    for k in (1, 5, 50, 4000):
        assert best(store.sparse_arm(asked, "item", k)) == best(R.sparse_arm(asked, docs, "doc", "item", k))
    tokens = R.asked_tokens(asked, "item")
    found = store.searched(tokens, 5)
    met, there = found["met"].count(), store.posted(tokens).join(tokens, "token").count()
    assert met < 0.6 * there, (met, there)
    assert found["scores"].count() < 0.5 * R.sparse_scores(asked, docs, "doc", "item").count()


def test_search_over_odd_stores(spark, tmp_path):
    store = PointStore(spark, f"file://{tmp_path}/s", buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "doc long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "absent")], "item long, text string")
    store.create(frame([]))
    assert store.sparse_arm(asked, "item", 3).count() == 0
    same = [(i, "alpha beta") for i in range(9)] + [(20, None), (21, "")]
    store.upsert(frame(same))
    got = best(store.sparse_arm(asked, "item", 3))
    assert [r[1] for r in got] == [0, 1, 2] and got == best(R.sparse_arm(asked, frame(same), "doc", "item", 3))
    store.upsert(frame([(i, "gamma") for i in range(9)]))
    assert store.sparse_arm(asked, "item", 3).count() == 0


TURNS = "conv_id long, turn int, text string"


def plain_rounds(rows, window):
    said, out = {}, []
    for c, t, text in sorted(rows):
        before = said.setdefault(c, [])
        history = before[-window:] if window else before
        answer = None if "fail" in text else f"{text}<{'|'.join(a for _, a in history)}>"
        out.append((c, t, text, len(history), answer))
        if answer is not None:
            before.append((text, answer))
    return sorted(out, key=str)


def test_rounds_carry_answers_on(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["a", "b", "fail"]) + str(t)) for c in range(40) for t in range(rng.randint(1, 9))]
    respond = lambda given: given.select("conv_id", F.when(~F.contains("text", F.lit("fail")), F.concat("text", F.lit("<"), F.array_join(F.transform("history", lambda h: h["response"]), "|"), F.lit(">"))).alias("answer"))
    asked = spark.createDataFrame([*rows, (None, 1, "nobody")], TURNS)
    for window in (2, None):
        got = rounds.in_rounds(asked, respond, window).select("conv_id", "turn", "text", F.size("history"), "answer")
        assert rows_of(got) == plain_rounds(rows, window)
    assert rounds.in_rounds(asked.limit(0), respond).count() == 0


def test_a_broken_run_goes_on(spark, tmp_path):
    rows = [(c, t, f"{c}-{t}") for c in range(3) for t in range(4)]
    calls = []

    def respond(given):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("the third round breaks")
        return given.select("conv_id", F.concat("text", F.size("history").cast("string")).alias("answer"))

    asked, root = spark.createDataFrame(rows, TURNS), f"file://{tmp_path}/run"
    try:
        rounds.in_rounds(asked, respond, root=root)
        raise AssertionError("it should have broken")
    except OSError:
        pass
    got = rounds.in_rounds(asked, respond, root=root)
    assert len(calls) == 5  # two rounds are not asked again
    assert {(r["conv_id"], r["turn"], r["answer"]) for r in got.collect()} == {(c, t, f"{c}-{t}{t}") for c in range(3) for t in range(4)}


def test_second_question_is_searched_with_the_first_answer(spark, tmp_path):
    """'What did it do' finds nothing by itself; with the first answer it finds that document's neighbour."""
    docs = spark.createDataFrame([(1, "Napoleon ruled France"), (2, "France invented cheese"), (3, "clouds carry rain"), (4, "rain makes rivers")], "doc_id long, text string")
    one = "conversation_id string, task_id string, Collection string, input array<struct<speaker:string,text:string>>"
    tasks = spark.createDataFrame([("c1", "t1", "x", [("user", "Napoleon")]), ("c1", "t2", "x", [("user", "what did it do")]), ("c2", "t3", "x", [("user", "clouds")]), ("c2", "t4", "x", [("user", "what did it do")]), (None, "t5", "x", [("user", "what did it do")])], one)
    store = PointStore(spark, f"file://{tmp_path}/s", buckets=2)
    store.create(docs.select(F.col("doc_id").alias("doc"), "text", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("vector")))
    respond = rounds.retrieving(None, None, k=2, store=store)
    more = {"embed": lambda t: F.lit(None).cast("array<double>"), "rewrite": lambda q, h: F.concat_ws(" ", q, F.element_at(h, -1)["response"])}
    with using(**more):
        asked = rounds.run_conversations(tasks, f"file://{tmp_path}/p", respond)
        alone = rag.run_tasks(tasks, docs, docs.select(F.col("doc_id").alias("doc"), F.lit(None).cast("array<double>").alias("vector")), f"file://{tmp_path}/q", k=2)
        found = {r["task_id"]: {c["document_id"] for c in r["contexts"]} for r in asked.collect()}
        lone = {r["task_id"]: {c["document_id"] for c in r["contexts"]} for r in alone.collect()}
    assert found == {"t1": {"1"}, "t2": {"1", "2"}, "t3": {"3"}, "t4": {"3", "4"}, "t5": set()}
    assert lone == {"t1": {"1"}, "t2": set(), "t3": {"3"}, "t4": set(), "t5": set()}
    assert asked.count() == 5 and conversation.WINDOW == 5


def test_stores_move_ids_rather_than_texts(spark, tmp_path, capsys):
    """Replaced rows are told by ids that are broadcast; a run that finds nothing to do commits nothing."""
    from kgloom.plans import indexing
    from kgloom.sources.points import PointStore

    docs = spark.createDataFrame([(i, f"Alice Smith met Bob number{i}") for i in range(12)], "doc_id long, text string")
    store = PointStore(spark, str(tmp_path / "points"))
    indexing.index(docs, store)
    found = store.tables.versions()
    assert indexing.index(docs, store)["points"] == 12 and store.tables.versions() == found
    store.upsert(docs.where("doc_id < 5").selectExpr("doc_id AS doc", "'other' AS text"))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.points.read().explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
        assert store.points.read().where("text = 'other'").count() == 5 and store.points.read().count() == 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_merged_tables_are_not_reduced_again(spark, tmp_path, monkeypatch):
    """What indexing has merged goes to the graph as it is, mentions come from the occurrences, and blocks are counted once."""
    from kgloom.operators import kg
    from kgloom.plans import indexing
    from kgloom.sources.points import ALL, PointStore
    from kgloom.sources.store import GraphStore

    docs = spark.createDataFrame([(i, "Napoleon met Alice Smith. Bonaparte met Alice Smith. Napoleon met Alice Smith") for i in range(3)], "doc_id long, text string")
    points, graph = PointStore(spark, str(tmp_path / "points")), GraphStore(spark, str(tmp_path / "graph"))
    monkeypatch.setattr(kg, "reduced", lambda *a, **k: 1 / 0)
    assert indexing.index(docs, points, graph) == {"points": 3, "has_sparse": True, "nodes": 2, "rels": 2, "mentions": 6}
    assert sorted((r["source"], r["target"]) for r in graph.rels.collect()) == [("alice smith", "napoleon bonaparte"), ("napoleon bonaparte", "alice smith")]
    assert rows_of(graph.mentions.select("chunk_id", "name")) == sorted((i, n) for i in range(3) for n in ("alice smith", "napoleon bonaparte"))
    assert "chunks" not in graph.nodes.columns
    blocks = {(r["token"], r["block"]): (r["df"], r["top"]) for r in points.tables.read("blocks").collect()}
    assert len(blocks) == points.tables.read("blocks").count() and blocks[ALL, 0] == (3, 0.0) and blocks["bonaparte", 0] == (3, 1 / 3)


def test_embedding_is_the_hash_of_each_token(spark):
    import hashlib

    from kgloom.functions import text as T
    from kgloom.plans.providers import embed

    rows = spark.createDataFrame([(0, "river stone river"), (1, None), (2, ""), (3, "stone the bridge")], "i long, text string").repartition(2)
    for r in rows.select(T.tokens(F.col("text")).alias("t"), embed(F.col("text"), 8).alias("v")).collect():
        want = [0.0] * 8
        for t in r["t"]:
            h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
            want[h % 8] += 1 if h >> 31 else -1
        assert r["v"] == want


def test_compared_runs_search_the_documents_once(spark, tmp_path, monkeypatch):
    """Runs with and without the graph differ in the graph's documents only."""
    from kgloom.sources import jsonl

    tasks = spark.createDataFrame([(i, f"t{i}", "s", [("user", f"word{i} river")]) for i in range(3)], "c int, task_id string, Collection string, input array<struct<speaker:string,text:string>>")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], jsonl.TASK_SCHEMA).schema.fields}
    tasks = tasks.select(F.col("c").cast("string").alias("conversation_id"), "task_id", "Collection", "input", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("contexts", "predictions")))
    docs = spark.createDataFrame([(i, f"word{i} river. bank") for i in range(4)], "doc_id long, text string")
    points = docs.select(F.col("doc_id").alias("doc"), F.array(F.lit(1.0)).alias("vector"))
    vectors = tasks.select(F.col("task_id").alias("query_id"), F.array(F.lit(1.0)).alias("vector"))
    arm = {"entities": tasks.select(F.col("task_id").alias("query_id"), F.lit(1).alias("entity_pos"), F.lit("x").alias("name")), "mentions": spark.createDataFrame([(3, "x")], "chunk_id long, name string")}
    calls, search = [], R.hybrid
    monkeypatch.setattr(R, "hybrid", lambda *a, **k: calls.append(1) or search(*a, **k))
    got = rag.compared_runs(tasks, docs, points, f"file://{tmp_path}/runs", 2, vectors, **arm).first()
    assert len(calls) == 1 and got["total_tasks"] == 3 and got["avg_contexts_no_kg"] == 2
    assert got["same_responses"] + got["different_responses"] == 3


def test_postings_of_many_tasks_and_blocks_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Texts beyond what a bucket's tasks hold have more tasks, blocks are counted where postings lie, and many points are met by ids."""
    from kgloom.sources import points as P

    rows = spark.createDataFrame([(i, f"word{i % 7} common river{i} common") for i in range(60)], "doc long, text string")
    monkeypatch.setattr(P, "SPLIT_CHARS", 40)
    monkeypatch.setattr(P, "BLOCK_DOCS", 4)
    monkeypatch.setattr(P, "SENT_POINTS", 10)
    store, shuffled, runs = P.PointStore(spark, f"file://{tmp_path}/s", buckets=4), [], P._blocks
    monkeypatch.setattr(P, "_blocks", lambda *a: shuffled.append(runs(*a)) or shuffled[-1])
    store.create(rows.where("doc < 50"))
    plan = shuffled[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "[token#" not in plan.split("MapInArrow")[0] and "Aggregate [__bucket" not in plan
    files = {f for ps in store.tables.manifest()["postings"]["parts"].values() for p in ps for f in os.listdir(f"{tmp_path}/s/{p}") if f.endswith(".parquet")}
    assert len(files) > 16
    store.upsert(rows.where("doc >= 45").withColumn("text", F.concat("text", F.lit(" again"))))
    want = R.postings(rows.withColumn("text", F.when(F.col("doc") >= 45, F.concat("text", F.lit(" again"))).otherwise(F.col("text"))), "doc")
    assert rows_of(store.postings.read()) == rows_of(want)
    n = store.tables.manifest()["blocks"]["n"]
    counted = lambda df: {(r["token"], r["block"]): r["df"] for r in df.groupBy("token", "block").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    assert n == 12 and counted(store.tables.read("blocks")) == counted(want.select("token", P._block("doc", n).alias("block"), F.lit(1).alias("df"))) | {(P.ALL, 0): 60}
    more = spark.createDataFrame([(3, "x"), (99, "y"), (99, "z"), (None, "n")], "doc long, text string")
    assert sorted(r["text"] for r in store.missing(more).collect()) == ["n", "y", "z"]


def test_only_loose_ends_are_looked_up(spark, tmp_path, monkeypatch):
    """Ends that an extraction names itself aren't looked up; others are known by another document or go."""
    from kgloom.operators import kg
    from kgloom.plans import extraction, indexing
    from kgloom.sources.store import GraphStore

    monkeypatch.setattr(kg, "guarded", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(kg, "created_relationships", lambda *a, **k: 1 / 0)
    entity = lambda *names: [(n, "OTHER", n, []) for n in names]
    rel = lambda *ends: [(a, b, "RELATED_TO", "d", 5) for a, b in ends]
    found = [(1, (entity("Alice", "Bonaparte"), rel(("alice", "napoleon"), ("Alice", "Carol"), ("alice", "nobody"), ("alice", None)))), (2, (entity("carol"), rel(("carol", "alice"), ("ghost", "carol")))), (3, (entity(), rel(("bonaparte", "carol"))))]
    found = spark.createDataFrame(found, f"chunk long, result {extraction.RESULT}")
    nodes, rels, mentions, loose = indexing.graph_tables(found)
    store = GraphStore(spark, f"file://{tmp_path}/g")
    store.merge(nodes, rels, mentions, once=("nodes", "rels"), loose=loose)
    assert sorted((r["source"], r["target"]) for r in store.rels.collect()) == [("alice", "carol"), ("alice", "napoleon bonaparte"), ("carol", "alice"), ("napoleon bonaparte", "carol")]
    other = GraphStore(spark, f"file://{tmp_path}/o")
    other.merge(spark.createDataFrame([("ghost", "OTHER")], "name string, type string"), key=["name"])
    nodes, rels, mentions, loose = indexing.graph_tables(found, deduplicate=False)
    other.merge(nodes, rels, mentions.unionByName(mentions), ["name"], once=("nodes",), loose=loose)
    assert sorted((r["source"], r["target"]) for r in other.rels.collect()) == [("ghost", "carol")]
    assert rows_of(other.mentions.select("chunk_id", "name")) == [(1, "Alice"), (1, "Bonaparte"), (2, "carol")]
