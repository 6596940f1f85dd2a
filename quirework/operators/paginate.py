"""Text to pages: a per-row map, no shuffle, whatever the text length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.arrays import exploded, let
from quirework.functions.text import wrap_lines

# Page sizes (points), margin, font size and leading of plain-text pages.
TEXT_PAGE_SIZES = {"A4": (595.28, 841.89), "LETTER": (612.0, 792.0), "LEGAL": (612.0, 1008.0)}
TEXT_MARGIN = 72.0
TEXT_FONT_SIZE = 12.0
TEXT_LINE_HEIGHT = 1.5


def lines_per_page(
    size: str = "A4",
    margin: float = TEXT_MARGIN,
    font_size: float = TEXT_FONT_SIZE,
    line_height: float = TEXT_LINE_HEIGHT,
) -> int:
    """A line is set while the pen is on or above the bottom margin."""
    height = TEXT_PAGE_SIZES[size][1]
    return math.floor((height - 2 * margin) / (font_size * line_height)) + 1


def _pages_of(lines: Column, k: int) -> Column:
    n_pages = F.floor((F.size(lines) - 1) / F.lit(k)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(n_pages, F.lit(0))),
        lambda i: F.array_join(F.slice(lines, i * F.lit(k) + 1, F.lit(k)), "\n"),
    )


def page_texts(text: Column, per_page: int | None = None, wrap_at: int | None = None) -> Column:
    """Texts of the pages of a text, in order.

    Without ``wrap_at`` every input line is one output line.  With it, each
    paragraph is wrapped to that many characters; a blank one uses one line.
    """
    lines = F.split(text, "\n")
    if wrap_at:
        lines = F.flatten(
            F.transform(
                lines,
                lambda p: F.when(p.rlike(r"\S"), wrap_lines(p, wrap_at)).otherwise(F.array(F.lit(""))),
            )
        )
    return let(lines, lambda ls: _pages_of(ls, per_page or lines_per_page()))


def paginate(docs: DataFrame, per_page: int | None = None, wrap_at: int | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, page_no, text), by ``page_texts``."""
    pages = exploded(docs, "doc_id", array=page_texts(F.col("text"), per_page, wrap_at), value="text", at="_i")
    return pages.select("doc_id", (F.col("_i") + 1).cast("long").alias("page_no"), "text")


def json_lines(docs: DataFrame, width: int = 80, column: str = "json") -> DataFrame:
    """Pretty-printed JSON as numbered lines of at most ``width`` characters.

    A continued line repeats its indent plus two blanks.
    """
    indent = lambda l: F.regexp_extract(l, r"^(\s*)", 1)

    def wrapped(line: Column) -> Column:
        pad = indent(line)
        body = F.substring(line, F.length(pad) + 1, F.length(line))
        first = F.greatest(F.lit(width) - F.length(pad), F.lit(1))
        later = F.greatest(F.lit(width) - F.length(pad) - 2, F.lit(1))
        rest = F.substring(body, first + 1, F.length(body))
        # one pass: a substring by place walks the text from its start each time
        pieces = F.regexp_extract_all(rest, F.concat(F.lit("(?s).{1,"), later.cast("string"), F.lit("}")), F.lit(0))
        tail = let(F.concat(pad, F.lit("  ")), lambda p: F.transform(pieces, lambda piece: F.concat(p, piece)))
        head = F.array(F.concat(pad, F.substring(body, F.lit(1), first)))
        return (
            F.when(F.length(line) <= width, F.array(line))
            .otherwise(F.filter(F.concat(head, tail), lambda part: part.rlike(r"\S")))
        )

    lines = F.flatten(F.transform(F.split(F.col(column), "\n"), wrapped))
    return exploded(docs, "doc_id", array=lines, value="line", at="_i").select(
        "doc_id", (F.col("_i") + 1).cast("long").alias("line_no"), "line"
    )
