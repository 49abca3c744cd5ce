"""Graph queries: orders are chunks that mention parts; parts are related to their suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import graph

from . import query, table

MENTIONS = "mentions AS (SELECT DISTINCT l_orderkey AS chunk_id, p_name AS name, p_brand AS title, p_type AS domain FROM lineitem JOIN part ON p_partkey = l_partkey)"
#: Each benchmark item asks for two parts.
ASKED = "asked AS (SELECT item_id AS query_id, e AS entity_pos, p_name AS name, p_brand AS title, p_type AS domain FROM benchmark, (SELECT unnest(range(1, 3)) AS e), part WHERE p_partkey = item_id + 10 * e)"
EDGES = "edges AS (SELECT DISTINCT 'part ' || l_partkey AS src, 'supplier ' || l_suppkey AS dst FROM lineitem), both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
PARTS = "seeds AS (SELECT 'part ' || p_partkey AS name FROM part)"
SUPPLIERS = "seeds AS (SELECT 'supplier ' || s_suppkey AS name FROM supplier)"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As they are said, repeats included: the operators take one for the same as several."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("chunk_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("title"), F.col("p_type").alias("domain"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("entity_pos"))
    return ids.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("query_id") + 10 * F.col("entity_pos")).select("query_id", "entity_pos", F.col("p_name").alias("name"), F.col("p_brand").alias("title"), F.col("p_type").alias("domain"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("dst"))


def seeds(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every part, or every supplier."""
    return table(spark, sf_dir, kind).select(F.concat(F.lit(f"{kind} "), F.col({"part": "p_partkey", "supplier": "s_suppkey"}[kind]).cast("string")).alias("name"))


def _chunks_sql(where: str) -> str:
    return f"WITH {MENTIONS}, {ASKED}, hit AS (SELECT DISTINCT query_id, entity_pos, chunk_id FROM asked a JOIN mentions m ON m.name = a.name AND ({where})) SELECT query_id, entity_pos, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity_pos ORDER BY chunk_id) AS r FROM hit) WHERE r <= 10"


@query(_chunks_sql("m.title = a.title"))
def entity_chunks_v1(spark, sf_dir):
    m, a = mentions(spark, sf_dir), asked(spark, sf_dir)
    kept = m.join(a.select("name", F.col("title").alias("t")).distinct(), "name").where(graph.title_filter(F.col("t"), F.col("title"))).select("chunk_id", F.concat_ws("\n", "name", "t").alias("name"))
    return graph.entity_chunks(a.withColumn("name", F.concat_ws("\n", "name", "title")), kept).select("query_id", "entity_pos", "chunk_id")


@query(_chunks_sql("m.domain = 'ECONOMY' OR m.title = 'Brand#2'"))
def entity_chunks_v2(spark, sf_dir):
    """Asked by domain or alias: an entity counts if its domain is the title, or the title is one of its aliases."""
    m = mentions(spark, sf_dir)
    kept = m.where(graph.title_filter(F.lit("ECONOMY"), domain=F.col("domain"), aliases=F.array(F.when(F.col("title") == "Brand#2", "ECONOMY").otherwise("none"))))
    return graph.entity_chunks(asked(spark, sf_dir).drop("title", "domain"), kept.select("chunk_id", "name")).select("query_id", "entity_pos", "chunk_id")


@query(f"WITH {EDGES}, {PARTS} SELECT name, dst AS related, 1 AS hops FROM (SELECT name, dst, row_number() OVER (PARTITION BY name ORDER BY dst) AS r FROM seeds JOIN both_ ON src = name) WHERE r <= 5")
def expand_1hop(spark, sf_dir):
    return graph.expanded(seeds(spark, sf_dir, "part"), edges(spark, sf_dir), 1).select("name", "related", "hops")


@query(f"""WITH RECURSIVE {EDGES}, {SUPPLIERS}, walk AS (SELECT name, name AS place, 0 AS hops FROM seeds UNION SELECT w.name, b.dst, w.hops + 1 FROM walk w JOIN both_ b ON b.src = w.place WHERE w.hops < 2)
SELECT name, place AS related, min(hops) AS hops FROM walk WHERE place <> name GROUP BY name, place""")
def expand_2hop(spark, sf_dir):
    return graph.expanded(seeds(spark, sf_dir, "supplier"), edges(spark, sf_dir), 2, limit=None).select("name", "related", "hops")


@query(f"""WITH {EDGES}, {PARTS}, rel AS (SELECT name, string_agg(dst, ',' ORDER BY dst) AS related FROM (SELECT name, dst, row_number() OVER (PARTITION BY name ORDER BY dst) AS r FROM seeds JOIN both_ ON src = name) WHERE r <= 5 GROUP BY name),
said AS (SELECT name, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS chunks FROM (SELECT name, c, row_number() OVER (PARTITION BY name ORDER BY c) AS r FROM (SELECT DISTINCT 'part ' || l_partkey AS name, l_orderkey AS c FROM lineitem)) WHERE r <= 5 GROUP BY name)
SELECT s.name, coalesce(related, '') AS related, coalesce(chunks, '') AS chunks FROM seeds s LEFT JOIN rel USING (name) LEFT JOIN said USING (name)""")
def entity_context(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.col("l_orderkey").alias("chunk_id"))
    out = graph.entity_context(seeds(spark, sf_dir, "part"), edges(spark, sf_dir), m)
    empty = F.array().cast("array<string>")
    return out.select("name", F.array_join(F.coalesce("related", empty), ",").alias("related"), F.array_join(F.coalesce(F.col("chunks").cast("array<string>"), empty), ",").alias("chunks"))


SEARCH = f"""{MENTIONS}, {ASKED}, hit AS (SELECT DISTINCT query_id, entity_pos, chunk_id FROM asked a JOIN mentions m ON m.name = a.name),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity_pos ORDER BY chunk_id) AS r FROM hit) WHERE r <= 10),
firsts AS (SELECT query_id, chunk_id, min(entity_pos) AS entity_pos FROM own GROUP BY ALL),
open_ AS (SELECT query_id, entity_pos, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY entity_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT query_id, entity_pos, count(*) AS n FROM firsts GROUP BY ALL)),
ranked AS (SELECT f.query_id, chunk_id, row_number() OVER (PARTITION BY f.query_id ORDER BY f.entity_pos, chunk_id) AS position FROM firsts f JOIN open_ o ON o.query_id = f.query_id AND o.entity_pos = f.entity_pos AND o.before < 10)"""


@query(f"WITH {SEARCH} SELECT * FROM ranked WHERE position <= 5")
def graph_search(spark, sf_dir):
    return graph.search(asked(spark, sf_dir).drop("title", "domain"), mentions(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


NEXT = """near_ AS (SELECT x.p_name AS src, y.p_name AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part x ON x.p_partkey = a.l_partkey JOIN part y ON y.p_partkey = b.l_partkey),
next_ AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM near_ UNION ALL SELECT dst, src FROM near_) WHERE src <> dst)"""


def titled_sql(same: str, column: str, far: int = 3) -> str:
    """Search with a title: entities and the ones near them are of it; of at most five near ones three are used."""
    return f"""WITH {MENTIONS}, {ASKED}, {NEXT},
titled AS (SELECT query_id, entity_pos, name, {column} AS asked FROM asked),
start AS (SELECT DISTINCT query_id, entity_pos, 0 AS far, 0 AS rank, chunk_id FROM titled a JOIN mentions m ON m.name = a.name AND ({same})),
rel AS (SELECT DISTINCT a.name, a.asked, n.dst AS related FROM (SELECT DISTINCT name, asked FROM titled) a JOIN next_ n ON n.src = a.name JOIN (SELECT DISTINCT name, title, domain FROM mentions) m ON m.name = n.dst AND ({same})),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, asked ORDER BY related) AS rank FROM rel) WHERE rank <= {far}),
via AS (SELECT DISTINCT query_id, entity_pos, 1 AS far, rank, chunk_id FROM titled a JOIN near USING (name, asked) JOIN mentions m ON m.name = near.related AND ({same})),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity_pos, far, rank ORDER BY chunk_id) AS r FROM (SELECT * FROM start UNION ALL SELECT * FROM via)) WHERE r <= 10),
firsts AS (SELECT query_id, chunk_id, min(entity_pos * 2 + far) AS place FROM own GROUP BY ALL),
open_ AS (SELECT query_id, entity_pos, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY entity_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT query_id, place // 2 AS entity_pos, count(*) AS n FROM firsts GROUP BY ALL)),
ranked AS (SELECT f.query_id, chunk_id, row_number() OVER (PARTITION BY f.query_id ORDER BY place, chunk_id) AS position FROM firsts f JOIN open_ o ON o.query_id = f.query_id AND o.entity_pos = f.place // 2 AND o.before < 16)
SELECT * FROM ranked WHERE position <= 8"""


def next_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that follow each other in an order."""
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = pairs(spark, sf_dir).join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _titled(spark, sf_dir, said: DataFrame, title: str) -> DataFrame:
    who = asked(spark, sf_dir).select("query_id", "entity_pos", "name", F.col(title).alias("title"))
    found = graph.search(who, said, next_names(spark, sf_dir), 8, entities=said.drop("chunk_id").distinct())
    return found.withColumn("position", F.col("position").cast("long"))


@query(titled_sql("m.title = a.asked", "title"))
def graph_search_titled(spark, sf_dir):
    """Version 1: an entity is of the title that it has. Near entities add their chunks."""
    return _titled(spark, sf_dir, mentions(spark, sf_dir).select("chunk_id", "name", "title"), "title")


@query(titled_sql("m.domain = a.asked OR m.title = 'Brand#2' AND a.asked LIKE 'E%'", "domain"))
def graph_search_domain(spark, sf_dir):
    """Version 2: an entity is of a title that is its domain or one of its aliases."""
    said = mentions(spark, sf_dir)
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("t")).distinct().agg(F.array_sort(F.collect_set(F.when(F.startswith("t", F.lit("E")), F.col("t")))).alias("e"))
    aliases = F.when(F.col("title") == "Brand#2", F.col("e")).otherwise(F.array().cast("array<string>"))
    said = said.crossJoin(F.broadcast(kinds)).select("chunk_id", "name", "domain", aliases.alias("aliases"))  # one row
    return _titled(spark, sf_dir, said, "domain")


@query(f"WITH {MENTIONS}, {ASKED}, {NEXT}, who AS (SELECT DISTINCT name, title FROM asked), rel AS (SELECT name, string_agg(dst, ',' ORDER BY dst) AS related FROM (SELECT name, dst, row_number() OVER (PARTITION BY name ORDER BY dst) AS r FROM (SELECT DISTINCT name FROM who) JOIN next_ ON src = name) WHERE r <= 5 GROUP BY name), said AS (SELECT name, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS chunks FROM (SELECT name, chunk_id, row_number() OVER (PARTITION BY name ORDER BY chunk_id) AS r FROM (SELECT DISTINCT w.name, chunk_id FROM who w JOIN mentions m ON m.name = w.name AND m.title = w.title)) WHERE r <= 5 GROUP BY name) SELECT n.name, coalesce(related, '') AS related, coalesce(chunks, '') AS chunks FROM (SELECT DISTINCT name FROM who) n LEFT JOIN rel USING (name) LEFT JOIN said USING (name)")
def entity_context_titled(spark, sf_dir):
    who = asked(spark, sf_dir).select("name", "title")
    out = graph.entity_context(who, next_names(spark, sf_dir), mentions(spark, sf_dir).select("chunk_id", "name", "title"))
    empty = F.array().cast("array<string>")
    return out.select("name", F.array_join(F.coalesce("related", empty), ",").alias("related"), F.array_join(F.coalesce(F.col("chunks").cast("array<string>"), empty), ",").alias("chunks"))


def entities(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("title"))


def pairs(spark, sf_dir) -> DataFrame:
    """Relationships between parts: of one order, consecutive lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return rows.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst")


PAIRS = "pairs AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"
PRIMARY = f"""{PAIRS}, deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM pairs UNION ALL SELECT dst FROM pairs) GROUP BY id),
prim AS (SELECT p_partkey AS entity_id, first_value(p_partkey) OVER (PARTITION BY p_name, p_type ORDER BY coalesce(d, 0) DESC, p_partkey) AS primary_id FROM part LEFT JOIN deg ON id = p_partkey)"""


@query("SELECT p_name AS name, p_type AS type, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS titles FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) > 1")
def entity_collisions(spark, sf_dir):
    return graph.collisions(entities(spark, sf_dir)).withColumn("titles", F.array_join("titles", ","))


@query(f"WITH {PRIMARY} SELECT entity_id, primary_id FROM prim")
def collision_primaries(spark, sf_dir):
    return graph.primaries(entities(spark, sf_dir), pairs(spark, sf_dir))


@query(f"WITH {PRIMARY} SELECT DISTINCT a.primary_id AS src, b.primary_id AS dst FROM pairs JOIN prim a ON a.entity_id = src JOIN prim b ON b.entity_id = dst")
def merge_collisions(spark, sf_dir):
    """Relationships after every entity has been merged into the primary one of its name and type."""
    rels = pairs(spark, sf_dir)
    return graph.redirected(rels, graph.primaries(entities(spark, sf_dir), rels), ["src", "dst"])


@query(f"WITH {PAIRS} SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM part WHERE p_partkey % 11 = 0) AS nameless, (SELECT count(*) FROM pairs) AS relationships, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)) AS orphans")
def graph_verify(spark, sf_dir):
    blanked = entities(spark, sf_dir).withColumn("name", F.when(F.col("entity_id") % 22 == 0, "").when(F.col("entity_id") % 11 != 0, F.col("name")))
    said = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("entity_id"))
    return graph.verified(blanked, pairs(spark, sf_dir), said)


@query("SELECT p_partkey AS entity_id FROM part WHERE p_partkey % 11 = 0")
def graph_null_name_check(spark, sf_dir):
    blanked = entities(spark, sf_dir).withColumn("name", F.when(F.col("entity_id") % 22 == 0, "").when(F.col("entity_id") % 11 != 0, F.col("name")))
    return blanked.where(F.coalesce("name", F.lit("")) == "").select("entity_id")


