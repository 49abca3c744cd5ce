"""Table functions for SQL: what extraction output holds, as rows.

    SELECT d.id, e.* FROM outputs d, LATERAL extraction_lines(d.content) e

One row of text becomes its lines' rows, beside the row that it came from. The rules are those of
operators.kg.parsed, which is the way for data frames.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from kgloom.operators.kg import END, FIELD

#: kind is entity (name, type, description) or relation (name is the source, with target, type and description).
LINE = "doc_id long, line_no int, kind string, name string, target string, type string, description string"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _document(line: str) -> tuple[int | None, str]:
    """The number after doc_id: and the rest of a line that begins with one."""
    head, mark, rest = line.partition(FIELD)
    digits = head.removeprefix("doc_id:")
    if not mark or digits == head or not digits.removeprefix("-").isascii() or not digits.removeprefix("-").isdigit():
        return None, line
    number = int(digits)
    return (number, rest) if _LEAST <= number <= _MOST else (None, line)


def lines_of(content: str | None) -> Iterator[tuple]:
    """Rows of LINE: entities with three fields at least, relations with four, up to the end mark."""
    for number, raw in enumerate((content or "").strip(" ").split("\n")):
        line = raw.strip(" ")
        if END in line:
            return
        doc_id, rest = _document(line)
        fields = [f.strip(" ") for f in rest.split(FIELD)]
        if fields[0] == "entity" and len(fields) >= 4:
            yield doc_id, number, "entity", fields[1], None, fields[2].upper(), fields[3]
        elif fields[0] == "relation" and len(fields) >= 5:
            yield doc_id, number, "relation", fields[1], fields[2], fields[3], fields[4]


class ExtractionLines:
    """extraction_lines(content): null or empty text has no rows; lines that fit neither kind are left out."""

    def eval(self, content: str) -> Iterator[tuple]:
        yield from lines_of(content)


def register(spark: SparkSession) -> None:
    """Makes extraction_lines known to the session's SQL.

    Rows travel pickled in batches: with Arrow, each call would make a batch of its own for the few lines of one text.
    """
    spark.udtf.register("extraction_lines", udtf(ExtractionLines, returnType=LINE, useArrow=False))
