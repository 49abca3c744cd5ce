"""Queries over documents, pages and JSON lines: scans, chunks, keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import names as N
from kgloom.functions import text as T
from kgloom.operators import chunking
from kgloom.sources import jsonl

from . import query, table

#: SQL for the words and the estimated tokens of a text.
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
N_TOKENS = f"CAST(floor(len({WORDS}) * CAST(1.3 AS DOUBLE)) AS BIGINT)"
SIZE_CLASS = "CASE WHEN n_tokens < 150 THEN 'short' WHEN n_tokens > 512 THEN 'long' ELSE 'normal' END"
CLASSED = f"classed AS (SELECT *, {SIZE_CLASS} AS size_class FROM (SELECT *, {N_TOKENS} AS n_tokens FROM documents))"
#: Greedy packing as a recursion over the documents of a domain in order.
PACKED = f"""{CLASSED}, numbered AS (
  SELECT doc_id, source, size_class, n_tokens, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM classed
), walk AS (
  SELECT source, doc_id, rn, CAST(0 AS BIGINT) AS pack,
         CASE WHEN size_class = 'short' AND n_tokens < 150 THEN n_tokens ELSE 0 END AS held,
         NOT (size_class = 'short' AND n_tokens < 150) AS closed
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.source, n.doc_id, n.rn,
         w.pack + CASE WHEN w.closed OR n.size_class <> 'short' THEN 1 ELSE 0 END,
         CASE WHEN n.size_class <> 'short' THEN 0 WHEN w.held + n.n_tokens >= 150 THEN 0 ELSE w.held + n.n_tokens END,
         n.size_class <> 'short' OR w.held + n.n_tokens >= 150
  FROM walk w JOIN numbered n ON n.source = w.source AND n.rn = w.rn + 1
)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"SELECT page_id, lower(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(\.jsonl)+$', '', 'i')) AS domain FROM pages")
def file_domain_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.domain_of_path(F.col("url")).alias("domain"))


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 2) ELSE props END AS line FROM events) WHERE json_valid(line)")
def malformed_json_filter(spark, sf_dir):
    line = F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line")).where(T.strict_json(F.col("line")).isNotNull()).select("event_id")


@query(f"WITH {CLASSED} SELECT source, size_class, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM classed GROUP BY ALL")
def size_class_counts(spark, sf_dir):
    return chunking.classified(docs(spark, sf_dir)).groupBy("source", "size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))


@query("SELECT CASE WHEN lang <> '' THEN lang ELSE 'unknown' END AS domain, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY ALL")
def domain_groups(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("domain", N.domain_of_line(F.col("lang"), F.lit(None).cast("string")))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(f"WITH RECURSIVE {PACKED} SELECT doc_id, source, pack, row_number() OVER (PARTITION BY source, pack ORDER BY doc_id) AS pack_pos FROM walk")
def pack_short_docs(spark, sf_dir):
    return chunking.packs(docs(spark, sf_dir), "source", "doc_id").select("doc_id", "source", "pack", (F.col("pack_pos")).alias("pack_pos"))


SPLIT = f"SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_no, CAST(i * 616 AS INTEGER) AS start_word, array_to_string(list_slice(w, i * 616 + 1, i * 616 + 682), ' ') AS text FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / 616.0) AS BIGINT))) AS i FROM (SELECT doc_id, source, {WORDS} AS w FROM long_docs))"


@query(f"WITH {CLASSED}, long_docs AS (SELECT * FROM classed WHERE size_class = 'long') SELECT doc_id, chunk_no, start_word, md5(text) AS digest FROM ({SPLIT})")
def split_long_docs(spark, sf_dir):
    long = chunking.classified(docs(spark, sf_dir)).where("size_class = 'long'")
    return chunking.split_long(long, "doc_id").select("doc_id", "chunk_no", "start_word", F.md5("text").alias("digest"))


@query("""SELECT doc_id, i * 800 AS start_index, md5(substr(text, CAST(i * 800 + 1 AS BIGINT), 1000)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, length(text) - 201) // 800)) AS i FROM documents WHERE length(text) > 0)""")
def char_split_windows(spark, sf_dir):
    return chunking.char_windows(docs(spark, sf_dir), "doc_id").select("doc_id", "start_index", F.md5("text").alias("digest"))


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text <> ''),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS stop FROM t
  UNION ALL
  SELECT doc_id, CASE WHEN stop < 0 THEN 0 WHEN blank > 0 THEN back + blank ELSE back END AS start, fresh FROM (
    SELECT doc_id, stop, back, blank, n, CASE WHEN most >= n THEN n WHEN para > 0 THEN low + wide - para + 1 WHEN line > 0 THEN low + wide - line + 1 WHEN word > 0 THEN low + wide - word + 1 ELSE most END AS fresh FROM (
      SELECT *, length(w) AS wide, strpos(reverse(w), chr(10) || chr(10)) AS para, strpos(reverse(w), chr(10)) AS line, strpos(reverse(w), ' ') AS word FROM (
        SELECT *, substr(text, low + 1, most - low) AS w FROM (
          SELECT *, least(n, here + 1000) AS most, here + 500 AS low FROM (
            SELECT *, CASE WHEN stop < 0 THEN 0 WHEN blank > 0 THEN back + blank ELSE back END AS here FROM (
              SELECT *, CASE WHEN stop < 0 THEN 0 ELSE strpos(substr(text, back + 1, stop - back), ' ') END AS blank FROM (
                SELECT doc_id, text, n, w.start, w.stop, greatest(w.start + 1, w.stop - 200) AS back FROM walk w JOIN t USING (doc_id) WHERE w.stop < t.n)))))))
), pieces AS (SELECT doc_id, start, substr(text, start + 1, stop - start) AS piece FROM walk JOIN t USING (doc_id) WHERE stop > 0)
SELECT doc_id, start + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS start_index, md5(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS digest FROM pieces WHERE regexp_matches(piece, '\S')""")
def char_split_recursive(spark, sf_dir):
    """Chunks that end, if they can, at a paragraph, a line or a blank."""
    return chunking.char_split(docs(spark, sf_dir), ["doc_id"]).select("doc_id", "start_index", F.md5("text").alias("digest"))


@query(f"""WITH RECURSIVE {PACKED}, long_docs AS (SELECT * FROM classed WHERE size_class = 'long'),
chunks AS (
  SELECT w.source, string_agg(n.text, chr(10) ORDER BY n.doc_id) AS text, string_agg(CAST(n.doc_id AS VARCHAR), ',' ORDER BY n.doc_id) AS ids, 0 AS part
  FROM walk w JOIN numbered n USING (doc_id) WHERE n.size_class <> 'long' GROUP BY w.source, w.pack
  UNION ALL SELECT source, text, CAST(doc_id AS VARCHAR), chunk_no FROM ({SPLIT})
)
SELECT source, 'chunk-' || substr(sha256(source || '|' || ids || '|' || part), 1, 8) AS chunk_id, md5(text) AS digest, ids FROM chunks""")
def preprocess_chunks(spark, sf_dir):
    out = chunking.preprocessed(docs(spark, sf_dir), "source", "doc_id")
    return out.select("source", "chunk_id", F.md5("text").alias("digest"), F.array_join("source_ids", ",").alias("ids"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM documents")
def chunk_ordinals(spark, sf_dir):
    return chunking.numbered(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id").select("doc_id", "ordinal")


@query("SELECT (row_number() OVER (ORDER BY source, doc_id) - 1) // 350 AS batch, doc_id FROM documents")
def batch_assignment(spark, sf_dir):
    rows = chunking.numbered(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")
    return rows.select(F.floor(F.col("ordinal") / 350).alias("batch"), "doc_id")


@query("SELECT doc_id, md5(CASE WHEN lang <> '' THEN text || chr(10) || chr(10) || 'Keywords: ' || lang || ', ' || source ELSE text END) AS digest, md5(CASE WHEN doc_id % 5 = 0 THEN 'replaced' ELSE text END) AS page_content, source FROM documents")
def payload_enrichment(spark, sf_dir):
    """Text with its keywords, and the payload, in which metadata goes before text."""
    meta = F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("page_content"), F.lit("replaced"), F.lit("source"), F.col("source"))).otherwise(F.create_map(F.lit("source"), F.col("source")))
    made = jsonl.payload(F.col("text"), meta)
    keywords = F.when(F.col("lang") != "", F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.enriched(F.col("text"), keywords)).alias("digest"), F.md5(made["page_content"]).alias("page_content"), made["source"].alias("source"))


@query("SELECT source, greatest(1, least(1000, CAST(floor((128000 - 2000) * CAST(0.8 AS DOUBLE) / (avg(length(text)) / 4.0 + 50)) AS BIGINT))) AS batch_size FROM documents GROUP BY source")
def batch_size_estimate(spark, sf_dir):
    from kgloom.plans.sizing import batch_size

    return docs(spark, sf_dir).groupBy("source").agg(batch_size(F.avg(F.length("text"))).alias("batch_size"))


@query("SELECT source, count(*) * 34344 AS bytes FROM documents GROUP BY source")
def batch_memory_estimate(spark, sf_dir):
    from kgloom.plans.sizing import batch_bytes

    return docs(spark, sf_dir).groupBy("source").agg(batch_bytes(F.count(F.lit(1))).alias("bytes"))


@query("SELECT CAST(sum(n * 34344) AS BIGINT) AS bytes, count(*) AS batches FROM (SELECT doc_id // 350 AS b, count(*) AS n FROM documents GROUP BY b)")
def queue_bytes(spark, sf_dir):
    from kgloom.plans.sizing import batch_bytes

    batches = docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 350).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return batches.agg(F.sum(batch_bytes(F.col("n"))).alias("bytes"), F.count(F.lit(1)).alias("batches"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents)
SELECT source AS query_id, string_agg('[' || p || '] Source: ' || lang || chr(10) || '    Content: ' || substr(trim(text), 1, 100) || '...', chr(10) ORDER BY p) AS context FROM r WHERE p <= 3 GROUP BY source""")
def source_listing_text(spark, sf_dir):
    from kgloom.operators import fusion

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = docs(spark, sf_dir).withColumn("position", place).where("position <= 3")
    return fusion.source_listing(rows.select(F.col("source").alias("query_id"), "position", "text", F.col("lang").alias("source")))


@query("""SELECT doc_id, md5('Extract entities of these types: ' || CASE WHEN lang = 'en' THEN 'Product, Technology, Organization, Feature, Concept' ELSE 'PERSON, ORGANIZATION, LOCATION, EVENT, CONCEPT, PRODUCT, DATE, OTHER' END || chr(10) || substr(text, 1, 2000)) AS single,
md5('--- Document ' || doc_id || ' ---' || chr(10) || CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '...' ELSE text END) AS batch FROM documents""")
def prompt_text(spark, sf_dir):
    from kgloom.plans import prompts

    domain = F.when(F.col("lang") == "en", "ibm cloud").otherwise("nothing known")
    return docs(spark, sf_dir).select("doc_id", F.md5(prompts.extraction(F.col("text"), domain)).alias("single"), F.md5(prompts.batch_document(F.col("doc_id"), F.col("text"))).alias("batch"))


@query("""SELECT doc_id, md5('Found so far: ' || lang || ', ' || source || chr(10) || substr(text, 1, 2000)) AS gleaning, md5('Name the entities in this question: ' || text) AS entities,
md5('Does the question depend on the conversation? Answer yes or no.' || chr(10) || lang || chr(10) || 'Question: ' || text) AS judge, md5('Put the question so that it stands alone.' || chr(10) || lang || chr(10) || 'Question: ' || text) AS rewrite,
md5('Answer from the numbered documents and cite them as [n].' || chr(10) || source || chr(10) || 'Question: ' || text) AS answer FROM documents""")
def prompt_builders(spark, sf_dir):
    from kgloom.plans import prompts

    text, lang, source = F.col("text"), F.col("lang"), F.col("source")
    made = {"gleaning": prompts.gleaning(text, F.array(lang, source)), "entities": prompts.query_entities(text), "judge": prompts.rewrite_judge(text, lang), "rewrite": prompts.rewrite(text, lang), "answer": prompts.answer(text, source)}
    return docs(spark, sf_dir).select("doc_id", *[F.md5(c).alias(n) for n, c in made.items()])


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'gave up' ELSE md5(text) END AS answer, CAST(CASE WHEN doc_id % 7 = 0 THEN 4 WHEN doc_id % 3 = 0 THEN 3 ELSE 1 END AS BIGINT) AS calls FROM documents")
def provider_retried(spark, sf_dir):
    """A registered provider whose calls fail: some twice, some always, which gives the fallback."""
    from kgloom.plans.providers import PROVIDERS, retried, using

    @F.pandas_udf("struct<answer:string,calls:long>")
    def answer(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for i, text in zip(ids, texts):
            made: list[int] = []

            def call(i=i, text=text, made=made) -> str:
                made.append(1)
                if i % 7 == 0 or (i % 3 == 0 and len(made) < 3):
                    raise ConnectionError(i)
                return text

            out.append((retried(call, attempts=4, fallback="gave up", sleep=lambda _: None), len(made)))
        return pd.DataFrame(out, columns=["answer", "calls"])

    with using(answer=answer):
        rows = docs(spark, sf_dir).select("doc_id", PROVIDERS["answer"](F.col("doc_id"), F.md5("text")).alias("a"))
    return rows.select("doc_id", "a.answer", "a.calls")
