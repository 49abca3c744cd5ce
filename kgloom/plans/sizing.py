"""Sizes of batches for model calls and queues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a document, tokens of a context and of its prompt, share that is used, characters of a
# token, tokens around a document, and the largest batch.
DOC_CHARS, CONTEXT_TOKENS, PROMPT_TOKENS, MARGIN, TOKEN_CHARS, DOC_TOKENS, LARGEST = 500, 128_000, 2000, 0.8, 4.0, 50, 1000
# Bytes of a point (vector of 1536 floats and its rest), of 50 entities, of 10 relationships, of the rest.
POINT_BYTES, ENTITIES_BYTES, RELS_BYTES, REST_BYTES = 4 * 1536 + 200, 50 * 500, 10 * 200, 1000


def batch_size(mean_chars: Column | None = None, context: int = CONTEXT_TOKENS, margin: float = MARGIN) -> Column:
    """Documents that fit into one call, between 1 and 1000."""
    chars = F.lit(float(DOC_CHARS)) if mean_chars is None else mean_chars
    fits = F.floor((context - PROMPT_TOKENS) * F.lit(margin).cast("double") / (chars / TOKEN_CHARS + DOC_TOKENS))
    return F.greatest(F.lit(1), F.least(F.lit(LARGEST), fits)).cast("long")


def batch_bytes(n: Column) -> Column:
    return (n * (POINT_BYTES + ENTITIES_BYTES + RELS_BYTES + REST_BYTES)).cast("long")
