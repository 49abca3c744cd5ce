"""Text functions: tokens, sizes, keys, truncation and formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "were", "will", "with", "you", "your", "what", "when",
    "where", "who", "which", "why", "how", "this", "these", "those",
)

# Sizes in tokens and characters.
MIN_TOKENS, MAX_TOKENS, OVERLAP_TOKENS = 150, 512, 50
MIN_EXTRACT_CHARS = 10
CONTEXT_CHARS, STRUCTURED_BATCH_CHARS, BATCH_CHARS, SINGLE_CHARS, PREVIEW_CHARS = 2000, 1500, 1000, 2000, 150
CONTENT_KEY_CHARS, CACHE_KEY_CHARS = 100, 500

# Fixed value: what is answered when nothing relevant was found.
IDK_MESSAGE = "I couldn't find relevant information in the available documents to answer this. Could you try rephrasing, or ask about a related topic covered in the documentation?"
IDK_SIGN = "couldn't find relevant information"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a lambda names from outside is computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Search tokens in order: lower case, only letters and digits, longer than two, no stop words.

    Other characters are taken out of the whole text before it is split, which is one pass and not one for each word.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def word_count(text: Column) -> Column:
    return F.size(_words(text)).cast("long")


def token_count(text: Column) -> Column:
    """Estimated model tokens: 1.3 for each word, cut to a whole number."""
    return F.floor(F.size(_words(text)) * F.lit(1.3).cast("double")).cast("long")


def size_class(count: Column) -> Column:
    """short, normal or long, by number of tokens."""
    return F.when(count < MIN_TOKENS, "short").when(count > MAX_TOKENS, "long").otherwise("normal")


def content_key(text: Column) -> Column:
    """Texts with the same first characters count as the same content."""
    return F.substring(text, 1, CONTENT_KEY_CHARS)


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def duplicated(query: Column) -> Column:
    """The query twice, which lets a dense model read it twice; sparse weights stay as they are."""
    return F.concat_ws(" ", query, query)


def cache_key(template: Column, text: Column) -> Column:
    """16 hex digits of a prompt template and the text's beginning."""
    return F.substring(F.sha2(F.concat(template, F.lit("|||"), F.substring(text, 1, CACHE_KEY_CHARS)), 256), 1, 16)


def is_yes(answer: Column) -> Column:
    return F.startswith(F.lower(F.trim(answer)), F.lit("y"))


def is_idk(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(IDK_SIGN))


def strict_json(line: Column) -> Column:
    """The line as a variant, null unless all of it is one JSON value.

    try_parse_json stops after the first value, so the line is parsed inside a list and inside an object: what goes on
    after a value breaks one or the other.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    alone = F.size(listed.cast("array<variant>")) == 1
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}"))).isNotNull()
    return F.when(alone & inside, F.try_variant_get(listed, "$[0]", "variant"))


def any_keyword(text: Column, keywords: Column) -> Column:
    """Whether any keyword is part of the text, in any case."""
    return F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))


def citations(answer: Column) -> Column:
    """Distinct citation numbers [n], in order; numbers that are no 32-bit ones cite nothing."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def enriched(text: Column, keywords: Column) -> Column:
    """Text with a line of keywords, if there are any."""
    joined = F.array_join(keywords, ", ")
    return F.when(F.coalesce(joined, F.lit("")) != "", F.concat(text, F.lit("\n\nKeywords: "), joined)).otherwise(text)
