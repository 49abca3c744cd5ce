"""Knowledge-graph building: parts stand for entities, (part, supplier) pairs of lineitem for relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import tables
from kgloom.operators import aliases, kg
from kgloom.shared import spread

from . import query, table

ALIAS_CASES = [("Napoleon", "french revolution"), ("the emperor", "french revolution"), ("The Emperor ", "French-Revolution"), ("the cloud", "ibm"), ("ibm", "IBM Cloud docs"), ("the convention", "frenchrevolution"), ("unknown", None), ("bonaparte", None), ("the king", "")]
_CASES_SQL = ", ".join("({}, {}, {})".format(i, *("NULL" if x is None else f"'{x}'" for x in c)) for i, c in enumerate(ALIAS_CASES))

#: Occurrences of entities: a part's name (every seventh under an alias), its type, a description of varying length.
ENTITY_ROWS = """rows_ AS (
  SELECT p_partkey AS seq, p_partkey % 50 AS chunk,
         CASE WHEN p_partkey % 7 = 0 THEN 'Napoleon' WHEN p_partkey % 7 = 1 THEN 'the emperor ' WHEN p_partkey % 70 = 2 THEN 'napoleon bonaparte' ELSE upper(p_name) END AS name,
         lower(p_type) AS type, substr(p_brand || ' ' || p_name, 1, 6 + p_partkey % 9) AS description, [p_brand, p_type] AS keywords
  FROM part), named AS (
  SELECT *, lower(trim(name)) AS raw, upper(type) AS t,
         CASE WHEN lower(trim(name)) IN ('napoleon', 'the emperor') THEN 'napoleon bonaparte' ELSE lower(trim(name)) END AS canonical FROM rows_
), placed AS (SELECT *, row_number() OVER (PARTITION BY canonical, t ORDER BY seq) AS nth FROM named)"""
MERGED_ENTITIES = f"""{ENTITY_ROWS}, merged AS (
  SELECT canonical AS name, t AS type, arg_max(description, length(description) * 10000000000 - seq) AS description,
         array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ',') AS keywords,
         count(DISTINCT chunk) AS n_chunks,
         coalesce(array_to_string(list_sort(list(DISTINCT raw) FILTER (WHERE nth > 1 AND raw <> canonical)), ','), '') AS aliases
  FROM placed GROUP BY canonical, t)"""


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def entity_rows(spark, sf_dir) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, "Napoleon").when(F.col("p_partkey") % 7 == 1, "the emperor ").when(F.col("p_partkey") % 70 == 2, "napoleon bonaparte").otherwise(F.upper("p_name"))
    text = F.substr(F.concat_ws(" ", "p_brand", "p_name"), F.lit(1), (6 + F.col("p_partkey") % 9).cast("int"))
    return spread(part(spark, sf_dir)).select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 50).alias("chunk"), name.alias("name"), F.lower("p_type").alias("type"), text.alias("description"), F.array("p_brand", "p_type").alias("keywords"))


def merged(spark, sf_dir) -> DataFrame:
    return kg.merged_entities(entity_rows(spark, sf_dir), F.lit("french revolution"))


REL_ROWS = """rels AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 50 AS chunk, p_name AS source, 'supplier ' || (l_suppkey % 20) AS target, l_shipmode AS type,
         substr(p_brand || l_returnflag, 1, 5 + CAST(l_orderkey % 4 AS INTEGER)) AS description, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS strength, [l_returnflag, l_linestatus] AS keywords
  FROM (SELECT *, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'filled' END AS l_shipmode FROM lineitem) l JOIN part p ON p.p_partkey = l.l_partkey)"""
MERGED_RELS = """mrels AS (
  SELECT source, target, type, arg_max(description, length(description) * CAST(100000000000 AS BIGINT) - seq) AS description, CAST(max(coalesce(strength, 5)) AS BIGINT) AS strength,
         array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ',') AS keywords, count(DISTINCT chunk) AS n_chunks
  FROM rels GROUP BY source, target, type)"""


def rel_rows(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_orderkey") % 50).alias("chunk"), F.col("p_name").alias("source"), F.concat(F.lit("supplier "), (F.col("l_suppkey") % 20).cast("string")).alias("target"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("filled").alias("type"), F.substr(F.concat("p_brand", "l_returnflag"), F.lit(1), (5 + F.col("l_orderkey") % 4).cast("int")).alias("description"),
        F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")).alias("strength"), F.array("l_returnflag", "l_linestatus").alias("keywords"), F.lit(None).cast("string").alias("semantic_type"),
    )


def _entity_columns(df: DataFrame) -> DataFrame:
    return df.select("name", "type", "description", F.array_join("keywords", ",").alias("keywords"), F.size("chunks").cast("long").alias("n_chunks"), F.array_join("aliases", ",").alias("aliases"))


def _rel_columns(df: DataFrame) -> DataFrame:
    return df.select("source", "target", "type", "description", F.col("strength").cast("long").alias("strength"), F.array_join("keywords", ",").alias("keywords"), F.size("chunks").cast("long").alias("n_chunks"))


@query(f"""SELECT p_partkey, CASE
  WHEN name ILIKE '%napoleon%' OR name = 'bonaparte' THEN 'napoleon bonaparte'
  WHEN lower(trim(name)) = 'the emperor' AND d LIKE '%french%' THEN 'napoleon bonaparte'
  WHEN lower(trim(name)) = 'the convention' AND d LIKE '%french%' THEN 'national convention'
  WHEN name = 'the cloud' AND d LIKE '%ibm%' THEN 'ibm cloud' WHEN name = 'ibm' AND d LIKE '%ibm%' THEN 'international business machines' ELSE name END AS canonical
FROM (SELECT p_partkey, coalesce(name, p_name) AS name, lower(coalesce(d, '')) AS d FROM part LEFT JOIN (VALUES {_CASES_SQL}) t(i, name, d) ON i = p_partkey % 12)""")
def alias_resolve(spark, sf_dir):
    """The cases in turn, and names of parts between them."""
    cases = spark.createDataFrame([(i, *c) for i, c in enumerate(ALIAS_CASES)], "i int, name string, domain string")
    rows = part(spark, sf_dir).join(F.broadcast(cases), F.col("p_partkey") % 12 == F.col("i"), "left")
    return rows.select("p_partkey", N.canonical_name(F.coalesce("name", "p_name"), F.col("domain")).alias("canonical"))


@query("""SELECT source, CASE WHEN n = 1 THEN 'Product,Technology,Organization,Feature,Concept' WHEN n = 2 THEN 'Person,Organization,Concept,Date,Product,Market' WHEN n = 3 THEN 'Person,Event,Location,Concept,Date,Organization' WHEN n = 4 THEN 'Product,Technology,Organization,Feature,Concept' ELSE 'PERSON,ORGANIZATION,LOCATION,EVENT,CONCEPT,PRODUCT,DATE,OTHER' END AS types
FROM (SELECT DISTINCT source, length(source) + CAST(right(source, 1) AS INTEGER) - 4 AS n FROM documents)""")
def entity_types_for_domain(spark, sf_dir):
    n = F.length("source") + F.substring("source", -1, 1).cast("int") - 4
    domain = F.when(n == 1, "IBM Cloud").when(n == 2, "FiQA").when(n == 3, "French-Revolution notes").when(n == 4, "clou").when(n == 5, "").otherwise("zzz")
    return table(spark, sf_dir, "documents").select("source", n.alias("n"), domain.alias("domain")).distinct().select("source", F.array_join(N.entity_types_of(F.col("domain")), ",").alias("types"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Location' WHEN 2 THEN 'Person' ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS label FROM part""")
def type_label(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    given = F.when(kind == 0, "org").when(kind == 1, " Loc ").when(kind == 2, "PERSON").otherwise(F.col("p_type"))
    return part(spark, sf_dir).select("p_partkey", N.label_of(given).alias("label"))


@query(f"WITH {MERGED_ENTITIES} SELECT * FROM merged")
def merge_entities(spark, sf_dir):
    return _entity_columns(merged(spark, sf_dir))


@query(f"WITH {REL_ROWS}, {MERGED_RELS} SELECT * FROM mrels")
def merge_relationships(spark, sf_dir):
    return _rel_columns(kg.merged_relationships(rel_rows(spark, sf_dir)))


GUARDED = "known AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 25 UNION SELECT 'supplier ' || s_suppkey FROM supplier WHERE s_suppkey < 10), guarded AS (SELECT * FROM mrels WHERE source IN (SELECT name FROM known) AND target IN (SELECT name FROM known))"


def _known(spark, sf_dir) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey < 10").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("name"))
    return part(spark, sf_dir).where("p_size > 25").select(F.col("p_name").alias("name")).unionByName(suppliers)


@query(f"WITH {REL_ROWS}, {MERGED_RELS}, {GUARDED} SELECT * FROM guarded")
def orphan_guard(spark, sf_dir):
    return _rel_columns(kg.guarded(kg.merged_relationships(rel_rows(spark, sf_dir)), _known(spark, sf_dir)))


@query(f"WITH {MERGED_ENTITIES}, {REL_ROWS}, {MERGED_RELS}, {GUARDED} SELECT (SELECT count(*) FROM merged) AS entities, (SELECT count(*) FROM mrels) AS relationships, (SELECT count(*) FROM guarded) AS kept")
def dedup_pipeline_stats(spark, sf_dir):
    rels = kg.merged_relationships(rel_rows(spark, sf_dir))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(merged(spark, sf_dir), "entities").crossJoin(count(rels, "relationships")).crossJoin(count(kg.guarded(rels, _known(spark, sf_dir)), "kept"))


GLEAN = """a AS (SELECT p_name AS name, p_type AS type, p_partkey AS seq, substr(p_brand, 1, 5 + CAST(p_partkey % 3 AS INTEGER)) AS description FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT p_name AS name, p_type AS type, p_partkey AS seq, substr(p_brand || p_type, 1, 4 + CAST(p_partkey % 6 AS INTEGER)) AS description FROM part WHERE p_partkey % 3 = 0),
fa AS (SELECT name, type, arg_max(description, seq) AS da FROM a GROUP BY ALL), fb AS (SELECT name, type, arg_max(description, length(description) * 10000000000 - seq) AS db FROM b GROUP BY ALL)"""


@query(f"WITH {GLEAN} SELECT name, type, CASE WHEN da IS NULL OR length(db) > length(da) THEN db ELSE da END AS description FROM fa FULL JOIN fb USING (name, type)")
def merge_initial_gleaned(spark, sf_dir):
    rows = part(spark, sf_dir).select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("seq"), "p_brand")
    a = rows.where("seq % 3 <> 0").withColumn("description", F.substr("p_brand", F.lit(1), (5 + F.col("seq") % 3).cast("int")))
    b = rows.where("seq % 3 = 0").withColumn("description", F.substr(F.concat("p_brand", "type"), F.lit(1), (4 + F.col("seq") % 6).cast("int")))
    return kg.merged_gleaning(a, b, ["name", "type"])


@query(r"""SELECT doc_id, CASE WHEN x IN ('', '_') THEN 'RELATED_TO' ELSE upper(substr(x, 1, 100)) END AS rel_type FROM (
  SELECT doc_id, CASE WHEN regexp_matches(x, '^[0-9]') THEN 'REL_' || x ELSE x END AS x FROM (
    SELECT doc_id, regexp_replace(CASE WHEN doc_id % 5 = 0 THEN '9 ' || text WHEN doc_id % 5 = 1 THEN '-' ELSE text END, '[^a-zA-Z0-9_]', '_', 'g') AS x FROM documents))""")
def sanitize_rel_type_a(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("9 "), "text")).when(F.col("doc_id") % 5 == 1, "-").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", N.rel_type(raw).alias("rel_type"))


@query(r"""SELECT doc_id, CASE WHEN x = '' THEN 'RELATED_TO' ELSE x END AS rel_type FROM (
  SELECT doc_id, substr(trim(upper(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN ' ,;' ELSE text END, '[^a-zA-Z0-9]+', '_', 'g')), '_'), 1, 50) AS x FROM documents)""")
def sanitize_rel_type_b(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 5 == 0, " ,;").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", N.rel_type_of_keywords(raw).alias("rel_type"))


def _content(batch: bool):
    head = F.concat(F.lit("doc_id:"), F.col("p_partkey").cast("string"), F.lit(kg.FIELD)) if batch else F.lit("")
    entity = F.concat(head, F.concat_ws(kg.FIELD, F.lit("entity"), F.concat(F.lit(" "), "p_name"), F.lower("p_type"), "p_brand"))
    rel = F.concat(head, F.concat_ws(kg.FIELD, F.lit("relation"), "p_name", "p_brand", F.lit("made by"), "p_type"))
    short = F.concat(head, F.concat_ws(kg.FIELD, F.lit("entity"), "p_name"))
    end = F.when(F.col("p_partkey") % 3 == 0, kg.END).otherwise("")
    return F.concat_ws("\n", short, entity, end, F.lit("  "), rel, F.lit("noise"))


@query("""WITH rules AS (SELECT p_partkey AS rule, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN substr(p_brand, 1, 6) ELSE p_brand || ' ' || p_type END END AS domain, p_name AS alias, 'entity ' || p_partkey AS canonical FROM part WHERE p_partkey % 5 = 0),
sq AS (SELECT *, replace(replace(lower(trim(domain)), ' ', ''), '-', '') AS r FROM rules), said AS (SELECT *, replace(replace(lower(trim(p_brand)), ' ', ''), '-', '') AS d FROM part),
hit AS (SELECT p_partkey, arg_min(canonical, (CASE WHEN domain IS NULL THEN 1000000000 ELSE 0 END) + rule) AS canonical FROM said JOIN sq ON lower(trim(alias)) = lower(trim(p_name)) AND (domain IS NULL OR contains(d, r) OR contains(r, d)) GROUP BY p_partkey)
SELECT p.p_partkey, coalesce(h.canonical, p.p_name) AS canonical FROM part p LEFT JOIN hit h USING (p_partkey)""")
def alias_table(spark, sf_dir):
    """Aliases from a table: a rule for every fifth part, in domains that lie in the brand's or around it."""
    key, rows = F.col("p_partkey"), part(spark, sf_dir)
    where = F.when(key % 4 != 0, F.when(key % 3 == 0, F.substring("p_brand", 1, 6)).otherwise(F.concat_ws(" ", "p_brand", "p_type")))
    rules = rows.where(key % 5 == 0).select(key.alias("rule"), where.alias("domain"), F.col("p_name").alias("alias"), F.concat(F.lit("entity "), key.cast("string")).alias("canonical"))
    return aliases.resolved(rows.select("p_partkey", "p_name", "p_brand"), rules, "p_name", "p_brand").select("p_partkey", "canonical")


@query("SELECT p_partkey, 1 + 1 AS line_no, 'entity' AS kind, p_name AS a, upper(p_type) AS b FROM part UNION ALL SELECT p_partkey, 5, 'relation', p_name, p_brand FROM part WHERE p_partkey % 3 <> 0")
def parse_delimited(spark, sf_dir):
    entities, rels = kg.parsed(part(spark, sf_dir).select("p_partkey", _content(False).alias("content")), ["p_partkey"])
    return entities.select("p_partkey", (F.col("line_no") + 1).alias("line_no"), F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b")).unionByName(rels.select("p_partkey", (F.col("line_no") + 1).alias("line_no"), F.lit("relation").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query("SELECT p_partkey, 1 + 1 AS line_no, 'entity' AS kind, p_name AS a, upper(p_type) AS b FROM part UNION ALL SELECT p_partkey, 5, 'relation', p_name, p_brand FROM part WHERE p_partkey % 3 <> 0")
def parse_delimited_sql(spark, sf_dir):
    """As parse_delimited, by a table function in a SQL text."""
    tables.register(spark)
    rows = spread(part(spark, sf_dir)).select("p_partkey", _content(False).alias("content"))
    return spark.sql("SELECT p_partkey, line_no + 1 AS line_no, kind, name AS a, coalesce(target, type) AS b FROM {outputs}, LATERAL extraction_lines(content)", outputs=rows)


@query(r"""WITH said AS (SELECT string_split(concat_ws(chr(10), h || 'entity<|#|>' || p_name, h || 'entity<|#|> ' || p_name || '<|#|>' || lower(p_type) || '<|#|>' || p_brand, CASE WHEN p_partkey % 3 = 0 THEN '<|COMPLETE|>' ELSE '' END, '  ', h || 'relation<|#|>' || p_name || '<|#|>' || p_brand || '<|#|>made by<|#|>' || p_type, 'noise'), chr(10)) AS l
  FROM (SELECT *, 'doc_id:' || p_partkey || '<|#|>' AS h FROM part)),
lines AS (SELECT unnest(CASE WHEN list_contains(l, '<|COMPLETE|>') THEN l[:list_position(l, '<|COMPLETE|>') - 1] ELSE l END) AS line FROM said),
fields AS (SELECT CAST(regexp_extract(line, '^doc_id:(-?\d+)<\|#\|>', 1) AS BIGINT) AS doc_id, string_split(regexp_replace(line, '^doc_id:-?\d+<\|#\|>', ''), '<|#|>') AS f FROM lines WHERE regexp_matches(line, '^doc_id:-?\d+<\|#\|>'))
SELECT doc_id, count(*) FILTER (WHERE f[1] = 'entity') AS entities, count(*) FILTER (WHERE f[1] = 'relation') AS relationships FROM fields
WHERE (f[1] = 'entity' AND len(f) >= 4 OR f[1] = 'relation' AND len(f) >= 5) AND doc_id IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY doc_id""")
def parse_batch_delimited(spark, sf_dir):
    """Counts by document; output for documents that weren't asked for is left out."""
    rows = part(spark, sf_dir)
    entities, rels = kg.parsed_batch(rows.select(_content(True).alias("content")), rows.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id")))
    both = entities.select("doc_id", F.lit(1).alias("e")).unionByName(rels.select("doc_id", F.lit(0).alias("e")))
    return both.groupBy("doc_id").agg(F.sum("e").alias("entities"), F.sum(1 - F.col("e")).alias("relationships"))


@query("""WITH old AS (SELECT p_partkey AS id, p_name AS name, p_type AS type FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END AS name, p_size AS size FROM part WHERE p_partkey % 5 <> 0)
SELECT id, coalesce(new.name, old.name) AS name, type, size FROM old FULL JOIN new USING (id)""")
def upsert_nodes(spark, sf_dir):
    rows = part(spark, sf_dir)
    old = rows.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    new = rows.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).alias("name"), F.col("p_size").alias("size"))
    return kg.upserted_nodes(old, new, ["id"])


@query("""WITH e AS (SELECT p_name AS source, p_brand AS target, p_type AS type, max(p_size) FILTER (WHERE p_partkey % 2 = 0) AS a, max(p_size) FILTER (WHERE p_partkey % 2 = 1) AS b, list(DISTINCT p_size % 7) AS l FROM part GROUP BY ALL)
SELECT source, target, type, coalesce(b, a) AS size, array_to_string(list_sort(l), ',') AS sizes FROM e""")
def upsert_rels(spark, sf_dir):
    """Two batches: the later size replaces the earlier one, lists are united."""
    rows = part(spark, sf_dir).select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_type").alias("type"), "p_size", "p_partkey")
    half = lambda r: rows.where(F.col("p_partkey") % 2 == r).groupBy("source", "target", "type").agg(F.max("p_size").alias("size"), F.collect_set(F.col("p_size") % 7).alias("sizes"))
    out = kg.upserted_merge(half(0), half(1), ["source", "target", "type"], ["sizes"])
    return out.withColumn("sizes", F.array_join("sizes", ","))


@query("""SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS name, upper(lower(p_type)) AS type, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS n_keywords, CASE WHEN p_partkey % 5 IN (0, 1) THEN 5 ELSE CAST(p_partkey % 5 AS INTEGER) END AS strength, p_brand AS semantic_type FROM part WHERE p_partkey % 6 <> 0""")
def normalize_kg(spark, sf_dir):
    rows = part(spark, sf_dir).select("p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("name"), F.lower("p_type").alias("type"), F.when(F.col("p_partkey") % 4 != 0, F.array("p_brand")).alias("keywords"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_partkey")).alias("source_doc_id"), "p_brand")
    entities = kg.normalized_entities(kg.in_batch(rows))
    given = F.when(F.col("p_partkey") % 5 != 1, (F.col("p_partkey") % 5).cast("int"))
    rels = kg.normalized_relationships(rows.select("p_partkey", F.col("name").alias("source"), F.col("name").alias("target"), F.col("p_brand").alias("type"), given.alias("strength"), "keywords"))
    return entities.select("p_partkey", "name", "type", F.size("keywords").alias("n_keywords")).join(rels.select("p_partkey", "strength", "semantic_type"), "p_partkey")


@query("SELECT p_brand AS title, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY p_brand")
def group_by_title(spark, sf_dir):
    return part(spark, sf_dir).groupBy(F.col("p_brand").alias("title")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_name").alias("names"))


@query("SELECT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS label, count(*) AS n FROM part GROUP BY 1")
def grouped_write_counts(spark, sf_dir):
    return part(spark, sf_dir).groupBy(N.label_of(F.col("p_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name AS name, arg_max(p_type, p_partkey) AS type, arg_max(p_brand, p_partkey) AS title FROM part GROUP BY p_name")
def name_only_merge_last_wins(spark, sf_dir):
    return kg.last_title(part(spark, sf_dir).select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("title")))


@query("SELECT n.name, coalesce(t, 'OTHER') AS type FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT s_name FROM supplier) n LEFT JOIN (SELECT p_name AS name, arg_min(p_type, p_partkey) AS t FROM part GROUP BY 1) USING (name)")
def infer_type_by_name(spark, sf_dir):
    names = part(spark, sf_dir).select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()
    return kg.inferred_type(names, part(spark, sf_dir).select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("seq")))
