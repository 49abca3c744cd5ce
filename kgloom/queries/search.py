"""Retrieval queries: benchmark items are the questions, documents the corpus.

Dense vectors: the vector of an item is the embedding of the same number, and a document's that of its own (a pairing
without meaning, for lack of a model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import text as T
from kgloom.operators import cells, fusion
from kgloom.operators import retrieval as R

from . import query, table

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tokens_sql(text: str = "text") -> str:
    bare = rf"list_transform(regexp_split_to_array(lower({text}), '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    return f"list_filter({bare}, lambda t: length(t) > 2 AND t NOT IN ({STOP}))"


def _posted(name: str, source: str, key: str) -> str:
    return f"""{name} AS (
  SELECT doc, token, tf, tf / CAST(max(tf) OVER (PARTITION BY doc) AS DOUBLE) AS weight FROM (
    SELECT doc, token, count(*) AS tf FROM (SELECT {key} AS doc, unnest({tokens_sql()}) AS token FROM {source}) GROUP BY ALL))"""


POSTED = f"{_posted('d', 'documents', 'doc_id')}, {_posted('q', 'benchmark', 'item_id')}"
IDF = "idf AS (SELECT token, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d GROUP BY token)"
SPARSE = f"""{POSTED}, {IDF}, sparse AS (
  SELECT query_id, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (
    SELECT q.doc AS query_id, d.doc AS doc, round(sum(q.weight * i.idf * d.weight), 9) AS score
    FROM q JOIN idf i USING (token) JOIN d USING (token) GROUP BY ALL)) WHERE rank <= 50)"""
DENSE = """dense AS (
  SELECT query_id, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (
    SELECT b.item_id AS query_id, e.vec_id AS doc, round(list_cosine_similarity(CAST(qe.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score
    FROM benchmark b JOIN embeddings qe ON qe.vec_id = b.item_id CROSS JOIN embeddings e)) WHERE rank <= 50)"""


def fused_sql(dense: float, sparse: float, k: int) -> str:
    return f"""fused AS (
  SELECT query_id, doc, score, rank, round(score / (({dense} + {sparse}) / 61.0), 6) AS score_norm FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (
      SELECT query_id, doc, round(sum(part), 9) AS score FROM (
        SELECT query_id, doc, CAST({dense} AS DOUBLE) / (60 + rank) AS part FROM dense
        UNION ALL SELECT query_id, doc, CAST({sparse} AS DOUBLE) / (60 + rank) FROM sparse) GROUP BY ALL)) WHERE rank <= {k})"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).join(points(spark, sf_dir), F.col("item_id") == F.col("doc")).select(F.col("item_id").alias("query_id"), "vector")


def sparse(spark, sf_dir, k: int = R.ARM_LIMIT) -> DataFrame:
    return R.sparse_arm(items(spark, sf_dir), docs(spark, sf_dir), "doc_id", "item_id", k)


def hybrid(spark, sf_dir, k: int, dense: float = 1.0, weight: float = 1.0) -> DataFrame:
    return R.hybrid(items(spark, sf_dir), docs(spark, sf_dir), points(spark, sf_dir), query_vectors(spark, sf_dir), "doc_id", "item_id", k, R.RRF_C, dense, weight)


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(f"WITH {_posted('d', 'documents', 'doc_id')} SELECT doc, token, tf FROM d")
def tokenize_tf(spark, sf_dir):
    return R.postings(docs(spark, sf_dir), "doc_id").select("doc", "token", "tf")


@query(f"WITH {_posted('d', 'documents', 'doc_id')} SELECT doc, token, round(weight, 6) AS weight FROM d")
def tf_norm(spark, sf_dir):
    return R.postings(docs(spark, sf_dir), "doc_id").select("doc", "token", F.round("weight", 6).alias("weight"))


@query(f"WITH {_posted('d', 'documents', 'doc_id')}, {IDF} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return R.idf(R.postings(rows, "doc_id"), rows.agg(F.count(F.lit(1)).alias("n"))).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {SPARSE} SELECT query_id, doc, round(score, 6) AS score, rank FROM sparse WHERE rank <= 10")
def sparse_topk(spark, sf_dir):
    return as_long(sparse(spark, sf_dir, 10), "rank").select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH twice AS (SELECT item_id, text || ' ' || text AS text FROM benchmark), {_posted('one_', 'benchmark', 'item_id')}, {_posted('two_', 'twice', 'item_id')}
SELECT (SELECT count(*) FROM benchmark) AS queries, count(*) AS differing FROM (SELECT doc, token, round(weight, 9) AS w FROM one_) a FULL JOIN (SELECT doc, token, round(weight, 9) AS w FROM two_) b ON a.doc = b.doc AND a.token = b.token AND a.w = b.w WHERE a.doc IS NULL OR b.doc IS NULL""")
def dup_query_invariance(spark, sf_dir):
    """Asking twice leaves the sparse weights as they are."""
    rows = items(spark, sf_dir)
    one, two = (R.postings(x, "item_id").select("doc", "token", F.round("weight", 9).alias("weight")) for x in (rows, rows.withColumn("text", T.duplicated(F.col("text")))))
    differing = one.exceptAll(two).unionByName(two.exceptAll(one)).agg(F.count(F.lit(1)).alias("differing"))
    return rows.agg(F.count(F.lit(1)).alias("queries")).crossJoin(differing)


@query(f"WITH {DENSE} SELECT query_id, doc, round(score, 6) AS score, rank FROM dense")
def cosine_topk(spark, sf_dir):
    return as_long(R.dense_arm(query_vectors(spark, sf_dir), points(spark, sf_dir)), "rank").select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {DENSE} SELECT query_id, doc, round(score, 6) AS score, rank FROM dense WHERE rank <= 5")
def cosine_topk_cells(spark, sf_dir):
    """As cosine_topk, from cells of which only those that can hold a better point are read."""
    found = cells.Cells(points(spark, sf_dir)).search(query_vectors(spark, sf_dir), 5)
    return as_long(found, "rank").select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {SPARSE}, {DENSE}, {fused_sql(1, 1, 50)} SELECT query_id, doc, round(score, 6) AS score, score_norm, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return as_long(hybrid(spark, sf_dir, 50), "rank").select("query_id", "doc", F.round("score", 6).alias("score"), "score_norm", "rank")


@query(f"WITH {SPARSE}, {DENSE}, {fused_sql(1, 1, 5)} SELECT query_id, doc, round(score, 6) AS score, rank FROM fused")
def hybrid_topk(spark, sf_dir):
    return as_long(hybrid(spark, sf_dir, 5), "rank").select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {SPARSE}, {DENSE}, {fused_sql(0.7, 0.3, 5)} SELECT query_id, doc, round(score, 6) AS score, rank FROM fused")
def hybrid_weighted(spark, sf_dir):
    return as_long(hybrid(spark, sf_dir, 5, 0.7, 0.3), "rank").select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


GATE = "best AS (SELECT b.item_id AS query_id, b.text, coalesce(max(score_norm), 0) AS max_score FROM benchmark b LEFT JOIN fused f ON f.query_id = b.item_id GROUP BY ALL)"


@query(f"WITH {SPARSE}, {DENSE}, {fused_sql(1, 1, 5)}, {GATE} SELECT query_id, max_score, max_score < 0.5 AS idk FROM best")
def max_score_idk_gate(spark, sf_dir):
    best = R.max_scores(items(spark, sf_dir), hybrid(spark, sf_dir, 5), "item_id")
    return best.select("query_id", "max_score", (R.gated(F.lit("answer"), F.col("max_score")) == T.IDK_MESSAGE).alias("idk"))


search_sql = f"WITH {SPARSE}, {DENSE}, {fused_sql(1, 1, 10)}, {GATE} SELECT f.query_id, f.doc, f.rank, b.max_score FROM fused f JOIN best b ON b.query_id = f.query_id"


@query(search_sql)
def search_with_max_score(spark, sf_dir):
    found = hybrid(spark, sf_dir, 10)
    best = R.max_scores(items(spark, sf_dir), found, "item_id")
    return as_long(found, "rank").select("query_id", "doc", "rank").join(best, "query_id")


@query("SELECT doc_id, n_chars FROM documents WHERE text <> '' AND doc_id IN (SELECT item_id FROM benchmark)")
def point_lookup(spark, sf_dir):
    ids = items(spark, sf_dir).select(F.col("item_id").alias("doc_id"))
    return R.lookup(docs(spark, sf_dir), ids, "doc_id").select("doc_id", "n_chars")


#: Graph documents of an item: those numbered three and seven times it, and the first found one again.
FOUND = f"WITH {SPARSE}, found AS (SELECT s.query_id, s.doc, d.text, d.source, s.rank AS pos, round(s.score / 10, 6) AS score FROM sparse s JOIN documents d ON d.doc_id = s.doc WHERE s.rank <= 4)"
GRAPH = """graph AS (
  SELECT item_id AS query_id, doc_id AS doc, d.text AS text, source, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS pos
  FROM benchmark b JOIN (SELECT doc_id, text, source FROM documents) d ON d.doc_id IN (b.item_id * 3 + 1, b.item_id * 7 + 2)
), allrows AS (
  SELECT query_id, doc, text, source, 0 AS arm, pos, score FROM found
  UNION ALL SELECT query_id, doc, text, source, 1, pos, NULL FROM graph
), firsts AS (
  SELECT *, max(arm) OVER (PARTITION BY query_id) AS has_graph, row_number() OVER (PARTITION BY query_id, substr(text, 1, 100) ORDER BY arm, pos) AS nth,
         coalesce(avg(score) FILTER (WHERE arm = 0) OVER (PARTITION BY query_id), 0.5) AS mean FROM allrows
), uniq AS (SELECT * FROM firsts WHERE has_graph = 0 OR nth = 1)"""


def _found(spark, sf_dir) -> DataFrame:
    got = sparse(spark, sf_dir, 4).join(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text", "source"), "doc")
    return got.select("query_id", "doc", "text", "source", F.col("rank").alias("pos"), F.round(F.col("score") / 10, 6).alias("score"))


def _graph(spark, sf_dir) -> DataFrame:
    ids = items(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.array(F.col("item_id") * 3 + 1, F.col("item_id") * 7 + 2))).alias("doc"))
    rows = ids.join(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text"), "doc")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("doc")))


@query(f"{FOUND}, {GRAPH} SELECT query_id, doc, CAST(arm AS BIGINT) AS arm, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arm, pos) AS position FROM uniq) WHERE position <= 5")
def fuse_append(spark, sf_dir):
    return as_long(fusion.appended(_found(spark, sf_dir), _graph(spark, sf_dir)), "arm", "position").select("query_id", "doc", "arm", "position")


@query(f"""{FOUND}, {GRAPH}, rated AS (SELECT *, round(CASE WHEN arm = 1 THEN least(1.0, mean + 0.3 * 0.5) ELSE score END, 9) AS s FROM uniq)
SELECT query_id, doc, round(s, 6) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, arm, pos) AS position FROM rated) WHERE position <= 5""")
def fuse_scored(spark, sf_dir):
    return as_long(fusion.scored(_found(spark, sf_dir), _graph(spark, sf_dir)), "position").select("query_id", "doc", F.round("score", 6).alias("score"), "position")


@query(f"""{FOUND} SELECT b.item_id AS query_id, md5(coalesce(string_agg('[' || pos || '] ' || CASE WHEN length(trim(f.text)) > 2000 THEN substr(trim(f.text), 1, 2000) || '...' ELSE trim(f.text) END, chr(10) || chr(10) ORDER BY pos), 'No relevant context found.')) AS digest
FROM benchmark b LEFT JOIN found f ON f.query_id = b.item_id GROUP BY b.item_id""")
def format_context(spark, sf_dir):
    asked = items(spark, sf_dir).select(F.col("item_id").alias("query_id"))
    return fusion.context(_found(spark, sf_dir).withColumnRenamed("pos", "position"), asked).select("query_id", F.md5("context").alias("digest"))


ANSWER_SQL = "text || ' [' || (doc_id % 4 + 1) || '] and [' || (doc_id % 3 + 2) || '][1]'"


def _answer() -> F.Column:
    return F.concat("text", F.lit(" ["), (F.col("doc_id") % 4 + 1).cast("string"), F.lit("] and ["), (F.col("doc_id") % 3 + 2).cast("string"), F.lit("][1]"))


@query(rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({ANSWER_SQL}, '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)))), ',') AS cited FROM documents")
def citations(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.citations(_answer()), ",").alias("cited"))


@query(rf"""SELECT doc_id, md5(a || chr(10) || chr(10) || '---' || chr(10) || '**References:**' || chr(10) || array_to_string(list_transform(list_filter([1, 2, 3], lambda n: contains(a, '[' || n || ']')), lambda n: chr(10) || '[' || n || '] ' || ['s1', 'Unknown source', 's3'][n] || chr(10) || '    ' || [lang, source, text][n] || chr(10)), '')) AS digest
FROM (SELECT *, {ANSWER_SQL} AS a FROM documents)""")
def references(spark, sf_dir):
    given = F.array(*[F.struct(F.lit(s).cast("string").alias("source"), t.alias("text")) for s, t in (("s1", F.col("lang")), (None, F.col("source")), ("s3", F.col("text")))])
    return docs(spark, sf_dir).select("doc_id", F.md5(fusion.references(_answer(), given)).alias("digest"))


@query(f"{FOUND} SELECT query_id, CASE WHEN doc % 4 = 0 THEN 'unknown' ELSE CAST(doc AS VARCHAR) END AS document_id, md5(text) AS digest, max(score) OVER (PARTITION BY query_id) AS score, pos AS position FROM found")
def context_rows(spark, sf_dir):
    got = _found(spark, sf_dir).withColumnRenamed("pos", "position")
    out = fusion.context_rows(got, F.when(F.col("doc") % 4 != 0, F.col("doc").cast("string")))
    return as_long(out, "position").select("query_id", "document_id", F.md5("text").alias("digest"), "score", "position")
