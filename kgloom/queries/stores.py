"""Store queries: what is written by the stores' operators, read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import kg
from kgloom.operators.graph import primaries
from kgloom.plans import extraction, indexing, rag
from kgloom.plans.providers import DIMENSIONS, using
from kgloom.shared import scratch, stored
from kgloom.sources.points import PointStore
from kgloom.sources.store import ExtractionCache, GraphStore
from kgloom.streaming import indexer
from kgloom.streaming.memory import remembered

from . import query, table
from .evaluation import TURNS, asked as turns
from .graphs import PRIMARY, entities, pairs
from .search import DENSE, IDF, SPARSE, _posted, fused_sql, items, query_vectors, tokens_sql
from .search import points as vectors


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---------------------------------------------------------------- points

#: Two thirds of the documents are stored; then every second one is upserted with another text, and one of them twice.
UPSERTED = "final AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' again' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0)"


def upserted(spark: SparkSession, sf_dir: str) -> PointStore:
    store = PointStore(spark, scratch(spark, "points"))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text")
    store.create(rows.where("doc % 3 <> 0"))
    even = rows.where("doc % 2 = 0")
    old = even.withColumns({"text": F.lit("old"), "at": F.lit(0)})
    new = even.withColumns({"text": F.concat("text", F.lit(" again")), "at": F.lit(1)})
    store.upsert(new.unionByName(old.where("doc % 4 = 0")), order="at")
    return store


@query(f"WITH {UPSERTED} SELECT doc_id AS doc, md5(text) AS digest FROM final")
def points_upserted(spark, sf_dir):
    return upserted(spark, sf_dir).points.read().select("doc", F.md5("text").alias("digest"))


@query(f"WITH {UPSERTED}, {_posted('d', 'final', 'doc_id')} SELECT doc, token, tf, round(weight, 6) AS weight FROM d")
def postings_upserted(spark, sf_dir):
    return upserted(spark, sf_dir).postings.read().select("doc", "token", "tf", F.round("weight", 6).alias("weight"))


@query(f"WITH {UPSERTED} SELECT count(*) AS points, true AS has_sparse, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM final)) AS missing FROM final")
def store_stats(spark, sf_dir):
    store = upserted(spark, sf_dir)
    stats = store.stats()
    left = store.missing(docs(spark, sf_dir).withColumn("doc", F.col("doc_id")))
    return left.agg(F.lit(stats["points"]).cast("long").alias("points"), F.lit(stats["has_sparse"]).alias("has_sparse"), F.count(F.lit(1)).alias("missing"))


@query(f"WITH {SPARSE} SELECT query_id, doc, round(score, 6) AS score, rank FROM sparse WHERE rank <= 10")
def sparse_topk_stored(spark, sf_dir):
    """As sparse_topk, from a store's postings."""
    store = PointStore(spark, scratch(spark, "points"))
    store.create(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text"))
    return store.sparse_arm(items(spark, sf_dir), "item_id", 10).select("query_id", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


#: As SPARSE, where all points count as documents.
SPARSE_OF_ALL = SPARSE.replace(IDF, IDF.replace("(SELECT count(*) FROM documents)", "(SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings))"))


@query(f"""WITH {SPARSE_OF_ALL}, {DENSE}, {fused_sql(1, 1, 5)}
SELECT f.query_id, f.doc, f.rank AS position, max(score_norm) OVER (PARTITION BY query_id) AS max_score, md5(coalesce(text, '')) AS digest FROM fused f LEFT JOIN documents ON doc_id = f.doc""")
def retrieve_stored(spark, sf_dir):
    """Questions answered by a store alone, after an upsert: texts, vectors and postings, pruned by block maxima."""
    store = PointStore(spark, scratch(spark, "points"))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text").join(vectors(spark, sf_dir), "doc", "full_outer")
    store.create(rows.withColumn("text", F.when(F.col("doc") % 10 == 0, F.lit("another text")).otherwise(F.col("text"))).where("doc % 7 <> 0"))
    store.upsert(rows.where("doc % 7 = 0 or doc % 10 = 0"))
    asked = items(spark, sf_dir).select(F.col("item_id").alias("query_id"), "text")
    found = rag.retrieve(None, asked, None, query_vectors(spark, sf_dir), store=store)
    return found.select("query_id", "doc", F.col("position").cast("long").alias("position"), "max_score", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT doc_id AS doc, false AS has_sparse FROM documents WHERE text <> ''")
def dense_only_store(spark, sf_dir):
    store = PointStore(spark, scratch(spark, "points"))
    store.create(indexing.points(docs(spark, sf_dir)).drop("text"), sparse=False)
    return store.points.read().select("doc", F.lit(store.stats()["has_sparse"]).alias("has_sparse"))


HASHED = f"""hashed AS (SELECT doc_id, h % {DIMENSIONS} AS dim, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS value FROM (
  SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, unnest({tokens_sql()}) AS t FROM documents)) GROUP BY ALL)"""


@query(f"WITH {HASHED} SELECT doc_id AS doc, dim, CAST(value AS BIGINT) AS value FROM hashed WHERE value <> 0")
def embed_documents(spark, sf_dir):
    """The offline embedding's components that aren't 0."""
    rows = indexing.points(docs(spark, sf_dir)).select("doc", F.posexplode("vector").alias("dim", "x"))
    return rows.where("x <> 0").select("doc", F.col("dim").cast("long").alias("dim"), F.col("x").cast("long").alias("value"))


# ---------------------------------------------------------------- graph

NODES = "nodes AS (SELECT p_name AS name, arg_max(p_type, p_partkey) AS type, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY p_name)"
#: Relationships between consecutive parts of an order; some ends are no nodes.
RELS = "given AS (SELECT x.p_name AS source, CASE WHEN a.l_orderkey % 5 = 0 THEN 'nobody' ELSE y.p_name END AS target, 'NEXT_TO' AS type, a.l_orderkey AS last_order FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part x ON x.p_partkey = a.l_partkey JOIN part y ON y.p_partkey = b.l_partkey), known AS (SELECT * FROM given WHERE target <> 'nobody')"


def _nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("at"))


def _rels(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    rows = lines.join(after, ["l_orderkey", "l_linenumber"]).join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    rows = rows.join(part.toDF("next", "other"), "next")
    target = F.when(F.col("l_orderkey") % 5 == 0, "nobody").otherwise(F.col("other"))
    return rows.select(F.col("p_name").alias("source"), target.alias("target"), F.lit("NEXT_TO").alias("type"), F.col("l_orderkey").alias("at"))


def graph_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    store = GraphStore(spark, scratch(spark, "graph"))
    rows = _nodes(spark, sf_dir)
    store.merge_nodes(rows.where("at % 2 = 0"), ["name"], order="at")
    store.merge_nodes(rows, ["name"], order="at")
    return store


@query(f"WITH {NODES} SELECT * FROM nodes")
def graph_nodes_merged(spark, sf_dir):
    """Merged twice by name; the last row of a name wins."""
    return graph_store(spark, sf_dir).nodes.select("name", "type", "brand")


@query(f"WITH {NODES}, {RELS} SELECT source, target, max(last_order) AS last_order, count(*) AS n FROM known GROUP BY ALL")
def graph_relationships(spark, sf_dir):
    """n: relationships created, repeats included; last_order: of the merged one, whose last properties win. Ends are looked up by name."""
    store, rows = graph_store(spark, sf_dir), _rels(spark, sf_dir)
    store.merge_relationships(rows, order="at")
    store.merge_relationships(rows, order="at")
    merged = store.rels
    other = graph_store(spark, sf_dir)
    other.create_relationships(rows)
    created = other.rels.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return merged.join(created, ["source", "target"]).select("source", "target", F.col("at").alias("last_order"), "n")


@query(f"WITH {NODES} SELECT type, count(*) AS n FROM nodes WHERE brand >= 'Brand#3' GROUP BY type")
def graph_query(spark, sf_dir):
    """SQL over the stored tables, with a parameter."""
    return graph_store(spark, sf_dir).query("SELECT type, count(*) AS n FROM nodes WHERE brand >= :least GROUP BY type", least="Brand#3")


@query(f"WITH {NODES}, {RELS} SELECT 'nodes' AS part, (SELECT count(*) FROM nodes) AS stored, (SELECT count(*) FROM nodes) AS in_backup, true AS dropped UNION ALL SELECT 'rels', (SELECT count(*) FROM (SELECT DISTINCT source, target FROM known)), (SELECT count(*) FROM (SELECT DISTINCT source, target FROM known)), true")
def graph_backup_and_drop(spark, sf_dir):
    """Counts of the store, of its backup, and whether it was dropped."""
    store = graph_store(spark, sf_dir)
    store.merge_relationships(_rels(spark, sf_dir), order="at")
    path = scratch(spark, "backup")
    counts = store.backup(path)
    store.drop()
    gone = not any(store.counts().values())
    out = None
    for name in ("nodes", "rels"):
        rows = spark.read.json(f"{path}/{name}").agg(F.lit(name).alias("part"), F.lit(counts[name]).cast("long").alias("stored"), F.count(F.lit(1)).alias("in_backup"), F.lit(gone).alias("dropped"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("WITH f AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1) SELECT f.name, n, (SELECT count(*) FROM f) AS merged, (SELECT count(DISTINCT p_name) FROM part) AS left_ FROM f")
def graph_constraints(spark, sf_dir):
    """Names that several nodes have, before the constraint of one node a name is set; then how many are left."""
    store = GraphStore(spark, scratch(spark, "graph"))
    store.create_nodes(_nodes(spark, sf_dir))
    faults = store.constraint_faults(1)
    merged = store.migrate(1, order="at")
    return faults.select("name", "n", F.lit(merged).cast("long").alias("merged"), F.lit(store.counts()["nodes"]).cast("long").alias("left_"))


#: Parts as occurrences of entities: ORG and ORGANIZATION have one label. Even ones come first, then the others.
FOUND = """found AS (SELECT p_partkey AS pos, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'ORGANIZATION' ELSE 'PERSON' END AS type, CASE p_partkey % 3 WHEN 2 THEN 'Person' ELSE 'Organization' END AS label,
  p_brand || ' ' || p_partkey AS description, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS keyword, p_type AS alias, p_partkey % 10 AS chunk, p_partkey % 2 AS batch FROM part)"""


def _found(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 0, "ORG").when(key % 3 == 1, "ORGANIZATION").otherwise("PERSON")
    return table(spark, sf_dir, "part").select(
        key.alias("at"), F.col("p_name").alias("name"), kind.alias("type"), F.concat_ws(" ", "p_brand", key.cast("string")).alias("description"),
        F.when(key % 5 != 0, F.array("p_brand")).alias("keywords"), F.array("p_type").alias("aliases"), F.array(key % 10).alias("chunks"), (key % 2).alias("batch"),
    )


@query(f"""WITH {FOUND} SELECT name, label, arg_max(type, batch * 1000000000 + pos) AS type, arg_min(description, batch * 1000000000 + pos) AS description,
  array_to_string(list_sort(list(DISTINCT keyword) FILTER (WHERE keyword IS NOT NULL)), ',') AS keywords, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS chunks FROM found GROUP BY ALL""")
def graph_nodes_united(spark, sf_dir):
    """Two batches of entities: lists are united, the first description stays, the last type counts, one node for a name and label."""
    store, rows = GraphStore(spark, scratch(spark, "graph")), _found(spark, sf_dir)
    for batch in (0, 1):
        store.merge(rows.where(F.col("batch") == batch), order="at")
    lists = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("keywords", "aliases", "chunks")]
    return store.nodes.select("name", "label", "type", "description", *lists)


@query(f"""WITH {NODES}, {RELS}, r AS (SELECT source, target, last_order AS pos, last_order % 9 AS strength, 'k' || last_order % 4 AS keyword, last_order % 2 AS batch FROM known)
SELECT source, target, max(strength) AS strength, array_to_string(list_sort(list(DISTINCT keyword)), ',') AS keywords, arg_min('d' || pos, batch * 1000000000 + pos) AS description FROM r GROUP BY ALL""")
def graph_rels_united(spark, sf_dir):
    """Two batches of relationships by policies of the caller: the greatest strength, all keywords, the first description."""
    store, at = graph_store(spark, sf_dir), F.col("at")
    rows = _rels(spark, sf_dir).select("source", "target", "type", "at", (at % 9).alias("strength"), F.array(F.concat(F.lit("k"), (at % 4).cast("string"))).alias("keywords"), F.concat(F.lit("d"), at.cast("string")).alias("description"))
    for batch in (0, 1):
        store.merge_relationships(rows.where(at % 2 == batch), order="at", policies={"strength": "greatest", "description": "first"})
    return store.rels.select("source", "target", "strength", F.array_join("keywords", ",").alias("keywords"), "description")


@query(f"""WITH {PRIMARY}, p AS (SELECT DISTINCT a.primary_id AS source, b.primary_id AS target FROM pairs JOIN prim a ON a.entity_id = src JOIN prim b ON b.entity_id = dst),
m AS (SELECT DISTINCT l_orderkey AS chunk, primary_id AS name FROM lineitem JOIN prim ON entity_id = l_partkey)
SELECT 'node' AS part, primary_id AS a, NULL AS b FROM prim WHERE entity_id = primary_id UNION ALL SELECT 'rel', source, target FROM p UNION ALL SELECT 'mention', chunk, name FROM m
UNION ALL SELECT 'nodes lost', (SELECT count(*) FROM prim WHERE entity_id <> primary_id), NULL
UNION ALL SELECT 'rels lost', (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM pairs)) - (SELECT count(*) FROM p), NULL
UNION ALL SELECT 'mentions lost', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) - (SELECT count(*) FROM m), NULL""")
def graph_collapsed(spark, sf_dir):
    """Entities equal in name and type become one in nodes, relationships and mentions; what a dry run had told."""
    store = GraphStore(spark, scratch(spark, "graph"))
    rels = stored(pairs(spark, sf_dir), "pairs")  # relationships and the mapping are made of it
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("name"))
    found = entities(spark, sf_dir)
    store.merge(found.withColumnRenamed("entity_id", "id"), key=["id"])
    store.tables.put("rels", rels.distinct().select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("NEXT_TO").alias("type")), ["source", "target", "type"])
    store.add_mentions(said)
    mapping = stored(primaries(found, rels), "mapping")  # for three calls
    told = store.collapse(mapping, dry_run=True)
    if told != store.collapse(mapping) or any(store.collapse(mapping).values()):
        raise AssertionError("a dry run tells what a run does, and a second run does nothing")
    none = F.lit(None).cast("long").alias("b")
    lost = spark.createDataFrame([(f"{name} lost", n) for name, n in told.items()], "part string, a long").withColumn("b", none)
    return store.nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), none).unionByName(store.rels.select(F.lit("rel").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"))).unionByName(store.mentions.select(F.lit("mention").alias("part"), F.col("chunk_id").alias("a"), F.col("name").alias("b"))).unionByName(lost)


@query("SELECT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS label, p_partkey AS id, CASE WHEN p_type < 'M' AND p_type IN (SELECT p_type FROM part WHERE p_partkey % 2 = 0) THEN 2 ELSE 1 END AS batch FROM part WHERE NOT (p_type < 'M' AND p_type IN (SELECT p_type FROM part WHERE p_partkey % 2 = 0)) OR p_partkey % 2 = 0")
def grouped_write(spark, sf_dir):
    """Nodes written by label; a second write replaces the labels that it has, and no others."""
    store, path = GraphStore(spark, scratch(spark, "graph")), scratch(spark, "labels")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    store.write_by_label(path, rows.withColumn("batch", F.lit(1)))
    store.write_by_label(path, rows.where("type < 'M' and id % 2 = 0").withColumn("batch", F.lit(2)))
    return spark.read.parquet(path).select("label", "id", "batch")


# ---------------------------------------------------------------- cache

KEYED = "keyed AS (SELECT doc_id, substr(sha256('extract' || '|||' || substr(text, 1, 500)), 1, 16) AS cache_key FROM documents)"


@query(f"WITH {KEYED}, held AS (SELECT cache_key, max(doc_id) AS last FROM keyed WHERE doc_id % 3 <> 0 GROUP BY cache_key) SELECT doc_id, k.cache_key, last AS result FROM keyed k LEFT JOIN held h ON h.cache_key = k.cache_key")
def cache_split(spark, sf_dir):
    """Documents with what the cache holds for their key: the latest of two sets."""
    cache = ExtractionCache(spark, scratch(spark, "cache"))
    keyed = docs(spark, sf_dir).select("doc_id", T.cache_key(F.lit("extract"), F.col("text")).alias("cache_key"))
    for r in (1, 2):
        cache.set(keyed.where(F.col("doc_id") % 3 == r).select("cache_key", F.col("doc_id").cast("string").alias("result"), F.col("doc_id").cast("double").alias("timestamp")))
    hits, misses = cache.split(keyed)
    return hits.select("doc_id", "cache_key", F.col("result").cast("long").alias("result")).unionByName(misses.select("doc_id", "cache_key", F.lit(None).cast("long").alias("result")))


# ---------------------------------------------------------------- extraction and indexing

NAMES = r"""named AS (SELECT doc_id, CASE WHEN length(trim(text)) >= 10 THEN regexp_extract_all(text, '(^|[^\p{L}\p{N}_])(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)', 2) ELSE [] END AS names FROM documents),
ents AS (SELECT DISTINCT doc_id, lower(n) AS name, n AS description FROM (SELECT doc_id, unnest(names) AS n FROM named)),
rels AS (SELECT DISTINCT doc_id, lower(a) AS source, lower(b) AS target, a || ' ' || b AS description FROM (SELECT doc_id, names[i] AS a, names[i + 1] AS b FROM (SELECT doc_id, names, unnest(range(1, CAST(len(names) AS BIGINT))) AS i FROM named)))"""
COUNTED = "SELECT doc_id, (SELECT count(*) FROM ents e WHERE e.doc_id = d.doc_id) AS entities, (SELECT count(*) FROM rels r WHERE r.doc_id = d.doc_id) AS relationships FROM documents d"


def _counted(found: DataFrame) -> DataFrame:
    return found.select(F.col("chunk").alias("doc_id"), F.size("result.entities").cast("long").alias("entities"), F.size("result.relationships").cast("long").alias("relationships"))


@query(f"WITH {NAMES} {COUNTED}")
def extract_structured(spark, sf_dir):
    return _counted(extraction.extracted(docs(spark, sf_dir)))


@query(f"WITH {NAMES} {COUNTED}")
def extract_delimited(spark, sf_dir):
    """Through delimited output that is parsed."""
    return _counted(extraction.extracted(docs(spark, sf_dir), way="delimited"))


@query(f"WITH {NAMES} {COUNTED}")
def extract_batches(spark, sf_dir):
    """Ten documents to a call; calls whose first id is divisible by three fail, and their documents are asked for alone."""
    from kgloom.plans.providers import extract_batch

    with using(extract_batch=lambda d: F.when(F.get(d, F.lit(0))["doc_id"] % 3 != 0, extract_batch(d))):
        return _counted(extraction.extracted(docs(spark, sf_dir), way="batch", size=10))


@query(r"""WITH """ + NAMES + r""", last AS (SELECT doc_id, name, any_value(d) AS d FROM (SELECT doc_id, lower(names[i]) AS name, last_value(names[i]) OVER (PARTITION BY doc_id, lower(names[i]) ORDER BY list_position(names, names[i]) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d FROM (SELECT doc_id, names, unnest(range(1, CAST(len(names) AS BIGINT) + 1)) AS i FROM named)) GROUP BY ALL),
more AS (SELECT DISTINCT doc_id, lower(n) AS name, n AS d FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{Lu}{2,}')))) AS n FROM documents WHERE length(trim(text)) >= 10))
SELECT doc_id, name, d AS description FROM last UNION ALL SELECT doc_id, name, d FROM more m WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.doc_id = m.doc_id AND l.name = m.name)""")
def extract_gleaned(spark, sf_dir):
    """Entities of the first look, and words in capitals that only the second finds."""
    found = extraction.extracted(docs(spark, sf_dir), way="gleaning")
    return found.select(F.col("chunk").alias("doc_id"), F.explode("result.entities").alias("e")).select("doc_id", "e.name", "e.description")


@query(rf"""WITH {NAMES}, keyed AS (SELECT doc_id, substr(sha256('structured' || '|||' || substr(text, 1, 500)), 1, 16) AS key, length(trim(text)) >= 10 AS asked FROM documents),
source AS (SELECT doc_id, CASE WHEN asked THEN min(doc_id) FILTER (WHERE asked) OVER (PARTITION BY key) END AS least FROM keyed)
SELECT doc_id, (SELECT count(*) FROM ents e WHERE e.doc_id = s.least) AS entities, (SELECT count(*) FROM rels r WHERE r.doc_id = s.least) AS relationships FROM source s""")
def extract_cached(spark, sf_dir):
    """Half of the documents, then all: texts that begin alike share the extraction of the least document, out of the cache."""
    cache = ExtractionCache(spark, scratch(spark, "cache"))
    rows = docs(spark, sf_dir)
    least = rows.withColumn("key", T.cache_key(F.lit("structured"), F.col("text"))).where(F.length(F.trim("text")) >= 10).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    extraction.cached(rows.join(least.where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_semi"), cache)
    return _counted(extraction.cached(rows, cache))


GRAPHED = f"""{NAMES}, canon AS (SELECT doc_id, CASE WHEN name IN ('napoleon', 'napoleon i', 'bonaparte') THEN 'napoleon bonaparte' ELSE name END AS name FROM ents),
ends AS (SELECT CASE WHEN source IN ('napoleon', 'napoleon i', 'bonaparte') THEN 'napoleon bonaparte' ELSE source END AS source, CASE WHEN target IN ('napoleon', 'napoleon i', 'bonaparte') THEN 'napoleon bonaparte' ELSE target END AS target FROM rels)"""
STORED = f"WITH {GRAPHED} SELECT (SELECT count(DISTINCT name) FROM canon) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM ends)) AS rels, (SELECT count(*) FROM (SELECT DISTINCT doc_id, name FROM canon)) AS mentions, (SELECT count(*) FROM documents WHERE text <> '') AS points"


def _sizes(spark: SparkSession, counts: dict) -> DataFrame:
    return spark.range(1).select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("nodes", "rels", "mentions", "points")])


def _stores(spark: SparkSession) -> tuple[PointStore, GraphStore]:
    return PointStore(spark, scratch(spark, "points")), GraphStore(spark, scratch(spark, "graph"))


@query(STORED)
def index_documents(spark, sf_dir):
    """Points and graph of all documents; the second run finds nothing to do."""
    points, graph = _stores(spark)
    indexing.index(docs(spark, sf_dir), points, graph)
    return _sizes(spark, indexing.index(docs(spark, sf_dir), points, graph))


@query(STORED)
def index_resumed(spark, sf_dir):
    """Interrupted after some documents, in another order, then taken up."""
    points, graph = _stores(spark)
    indexing.index(docs(spark, sf_dir).where("doc_id % 4 = 1"), points, graph)
    return _sizes(spark, indexing.index(docs(spark, sf_dir), points, graph))


@query(f"WITH {NAMES} SELECT name, count(DISTINCT doc_id) AS chunks FROM ents GROUP BY name")
def index_without_dedup(spark, sf_dir):
    """A node for each name as it is, and its chunks."""
    points, graph = _stores(spark)
    indexing.index(docs(spark, sf_dir), points, graph, deduplicate=False)
    return graph.nodes.select("name").join(graph.mentions, "name").groupBy("name").agg(F.count_distinct("chunk_id").alias("chunks"))


@query(STORED)
def stream_index_stores(spark, sf_dir):
    """The documents as a stream, through extraction into both stores."""
    points, graph = _stores(spark)
    rows = indexer.stream_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    indexer.store_stream(rows, points, graph, scratch(spark, "checkpoint")).awaitTermination()
    return _sizes(spark, points.stats() | graph.counts())


@query("SELECT count(*) AS rows_, true AS several, true AS timed FROM documents")
def stream_progress(spark, sf_dir):
    """What a stream says of itself: rows, whether it took several batches, whether it had a rate."""
    root = scratch(spark, "progress")
    docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text").repartition(6).write.parquet(f"{root}/in")
    rows = indexer.stream_table(spark, f"{root}/in", files_per_trigger=2)
    run = indexer.index_stream(rows, f"{root}/out", f"{root}/checkpoint")
    run.awaitTermination()
    seen = indexer.progress(run)
    return spark.range(1).select(F.lit(seen["rows"]).cast("long").alias("rows_"), F.lit(seen["batches"] > 1).alias("several"), F.lit(seen["rows_a_minute"] > 0).alias("timed"))


@query(f"WITH {TURNS} SELECT conv_id, turn, md5(coalesce(h, '')) AS digest FROM hist")
def stream_memory(spark, sf_dir):
    """The last turns of each conversation, kept as a stream's state."""
    root = scratch(spark, "memory")
    turns(spark, sf_dir).write.parquet(f"{root}/in")
    rows = indexer.stream_table(spark, f"{root}/in")
    remembered(rows).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("conv_id", "turn", F.md5("history").alias("digest"))


@query(r"WITH n AS (SELECT item_id, CASE WHEN length(trim(text)) >= 10 THEN regexp_extract_all(text, '(^|[^\p{L}\p{N}_])(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)', 2) ELSE [] END AS names FROM benchmark), d AS (SELECT item_id, n, min(i) AS i FROM (SELECT item_id, unnest(names) AS n, generate_subscripts(names, 1) AS i FROM n) GROUP BY ALL) SELECT item_id AS query_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) AS BIGINT) AS entity_pos, lower(n) AS name FROM d")
def query_entities(spark, sf_dir):
    found = rag.query_entities(items(spark, sf_dir).select(F.col("item_id").alias("query_id"), "text"))
    return found.withColumn("entity_pos", F.col("entity_pos").cast("long"))


@query("SELECT p_partkey % 40 AS doc_id, count(*) FILTER (WHERE p_partkey % 3 <> 2) AS entities, count(*) FILTER (WHERE p_partkey % 3 = 2) AS relationships, coalesce(string_agg(p_name, ',' ORDER BY p_partkey) FILTER (WHERE p_partkey % 3 <> 2), '') AS names FROM part GROUP BY 1 UNION ALL SELECT 40, 0, 0, ''")
def results_by_document(spark, sf_dir):
    """Rows of one answer brought together by document, in their order; a document without any is in it too."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("doc_id"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("name"), F.col("p_brand").alias("target"))
    entities = rows.where("line_no % 3 <> 2").select("doc_id", "line_no", "name")
    rels = rows.where("line_no % 3 = 2").select("doc_id", "line_no", F.col("name").alias("source"), "target")
    found = kg.by_document(entities, rels, spark.range(41).toDF("doc_id"))
    names = F.array_join(F.transform("entities", lambda e: e["name"]), ",")
    return found.select("doc_id", F.size("entities").cast("long").alias("entities"), F.size("relationships").cast("long").alias("relationships"), names.alias("names"))
