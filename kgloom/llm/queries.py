"""The queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, line_dedup, phrases, pii, quality, sharding, simhash, spans, topk, trie, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24, next_shards=25)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("next_shard").alias("shard_in_next_map"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "part", "role", "recovered_role", "rendered")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, with_ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(pii.joined_spans(base), "UTF-8"), 256).alias("base_sha256"), pii.joined_spans(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), max_n=3, min_count=10, top=2000, held_by=50)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_QUERIES = (op1_sharding, op2_topk, op3_chat, op4_line_dedup, op5_warc, op6_decontaminate, op7_bpe, op8_simhash, op9_pii, op10_quality, op11_phrases, op12_trie, op13_spans)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


#: DuckDB over the same tables. A-Z and a-z are fixed values; blanks are [\x20\x09-\x0D].
_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP4 = r"""
WITH lines AS (
  SELECT rowid_ AS r, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce('id ' || doc_id, 'row ' || r)) >= 10
)
SELECT doc_id, count(*) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY r, doc_id
"""

_OP5 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to, true AS verified
FROM w
"""


_OP11 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
    FROM documents
  )
), words AS (
  SELECT p, lang, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT p, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces)
), suffixes AS (
  SELECT lang, word AS w1, lead(word) OVER s AS w2, lead(word, 2) OVER s AS w3 FROM words WINDOW s AS (PARTITION BY p ORDER BY i)
), f AS MATERIALIZED (
  SELECT lang, w1 AS phrase, 1 AS k, count(*) AS f FROM suffixes GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM suffixes WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM suffixes WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j.j, array_to_string(string_split(c.phrase, ' ')[:j.j], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[j.j + 1:], ' ') AS rest
  FROM f c JOIN (VALUES (1), (2)) j(j) ON j.j < c.k
), firsts AS MATERIALIZED (
  SELECT cuts.*, f.f AS l FROM cuts JOIN f ON f.lang = cuts.lang AND f.phrase = cuts.first
), both_parts AS MATERIALIZED (
  SELECT firsts.*, f.f AS r FROM firsts JOIN f ON f.lang = firsts.lang AND f.phrase = firsts.rest
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score,
         row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a * a) // (l::HUGEINT * r), j) AS place
  FROM both_parts
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(string_split(phrase, ' ')[:2], ' ') AS phrase, f FROM f WHERE k = 3
    UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:], ' '), f FROM f WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longer h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE place = 1 AND (h.f IS NULL OR 100 * h.f < 50 * a)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang) WHERE rank <= 2000
"""

_OP13 = r"""
WITH words AS (
  SELECT r, doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
  SELECT r, doc_id, i, word, md5(string_agg(word, ' ') OVER f) AS key, count(*) OVER f AS n
  FROM words WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), judged AS (
  SELECT r, i, word, n = 20 AND row_number() OVER (PARTITION BY key, n ORDER BY doc_id, i) > 1 AS again FROM windows
), covered AS (
  SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged
), kept AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": _OP2, "op4_line_dedup": _OP4, "op5_warc": _OP5, "op11_phrases": _OP11, "op13_spans": _OP13}
