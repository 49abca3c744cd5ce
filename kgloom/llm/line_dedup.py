"""Line deduplication: lines found in many documents are dropped from every document.

Lines are normalised, hashed to 128 bits and counted by distinct document; keys over the threshold lose all their
lines; the others are put together again by position. Everything is a DataFrame expression.

The normalised hashes of each document are computed once and stored, so that counting and dropping read the same narrow
table. Within a row a key is counted once (array_distinct) before rows are made, so this count needs no shuffle by
document. It is at least the number of documents; only the rows of keys that reach the threshold by it are then counted
again by distinct document, reduced in each task first. Keys over the threshold are stored too: Spark knows the size of that table and broadcasts it only below
spark.sql.autoBroadcastJoinThreshold; above, the join is dealt by key, and a key that many documents share is split as a
skewed join, which adaptive execution can do because nothing but the join stands on the exchange.

Defined results: a null or empty text is one empty line, whose key has no code points and is never counted. Rows with one
id are one document, a row without id is one of its own. All rows lose the lines of frequent keys, and stay. Extra columns
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, row_key, short_batches, stored

MIN_DOCS = 10
MIN_CHARS = 1


def bare_line(line: Column) -> Column:
    """The line without white space at both ends; btrim, which copies every character, runs only where there is some."""
    edge = F.lit(False)
    for c in BLANKS:
        edge = edge | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    return F.when(edge, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def folded(bare: Column) -> Column:
    """Equal for two lines exactly if they are equal after A-Z have been put in lower case and all else left alone.

    The UTF-8 bytes are read as Latin-1 and put in lower case: A-Z become a-z, and of the others only the first bytes of
    two-byte characters change, to first bytes of longer ones, from which the number of bytes that follow still tells them.
    """
    return F.lower(F.decode(bare.cast("binary"), "ISO-8859-1"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text rebuilt from the lines that stay, and n_lines and n_dropped."""
    short_batches(docs.sparkSession)
    keys = row_key(doc_id, text)

    # one transform for each step: what a lambda computes is computed once for each time that it is named
    bare = F.transform(_lines(F.col(text)), bare_line)
    codes = F.transform(bare, lambda x: F.when(F.char_length(x) >= min_chars, folded(x)))
    pairs = F.transform(codes, lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    # stored with the hashes, so that a row's number is given once
    document = F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit("no id"), F.monotonically_increasing_id())).otherwise(F.xxhash64(doc_id))
    hashes = stored(docs.select(*keys, document.alias("document"), pairs.alias("hashes")), "line-hashes")
    once = hashes.select("document", F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null").select("document", "h.*")
    at_least = F.col("n") >= min_docs
    often = stored(once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(at_least).select("h1", "h2"), "lines-of-many-rows")
    distinct = once.join(often, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "document").agg(F.lit(1).alias("one"))
    frequent = stored(distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(at_least).select("h1", "h2"), "frequent-lines")
    at = hashes.select("k1", "k2", F.posexplode("hashes").alias("pos", "h")).where("h is not null").select("k1", "k2", "pos", "h.*")
    gone = at.join(frequent, ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    # the narrow side is hashed, so that whole texts aren't sorted to be joined
    gone = gone.toDF("__line_k1", "__line_k2", "__line_gone")
    marked = docs.withColumns({"__line_k1": keys[0], "__line_k2": keys[1]}).join(gone.hint("shuffle_hash"), ["__line_k1", "__line_k2"], "left").drop("__line_k1", "__line_k2")
    lines = _lines(F.col(text))
    gone_col = F.coalesce("__line_gone", F.array().cast("array<int>"))
    at_once = F.array(F.struct(lines.alias("lines"), gone_col.alias("gone")))  # split once, not for each line
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])  # noqa: E731  a hash set: linear
    kept = F.transform(at_once, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x["lines"], i)), "\n"))[0]
    return marked.withColumns({text: F.when(F.size(gone_col) == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(kept), "n_lines": F.size(lines).cast("long"), "n_dropped": F.size(gone_col).cast("long")}).drop("__line_gone")
