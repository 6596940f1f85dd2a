"""Text search over positioned items, and redaction."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.arrays import let, match_starts
from quirework.functions.units import half_up
from quirework.operators.errors import error_rows
from quirework.operators.prefix import page_block, running
from quirework.session import materialise

WORD = "[A-Za-z0-9_]"


def term_pattern(term: str, regex: bool = False, whole_word: bool = False, case: bool = False) -> str:
    """JVM pattern of one search term; literal unless ``regex``.

    Word edges and case folding follow the browser's rules: edges are ASCII,
    folding is Unicode-wide.
    """
    body = term if regex else re.sub(r"([.*+?^${}()|\[\]\\/-])", r"\\\1", term)
    if whole_word and not regex:
        left = f"(?<!{WORD})" if re.match(WORD, term[0]) else f"(?<={WORD})"
        right = f"(?!{WORD})" if re.match(WORD, term[-1]) else f"(?={WORD})"
        body = f"{left}{body}{right}"
    return body if case else f"(?iu){body}"


def _spans(text: Column, pattern: str, term_no: int) -> Column:
    """array<struct<term_no,start,text>>: offsets are running lengths of the
    pieces between matches and of the matches before."""

    def placed(found: Column) -> Column:
        starts = match_starts(F.split(text, pattern, -1), found)
        return F.zip_with(
            starts,
            found,
            lambda at, h: F.struct(F.lit(term_no).alias("term_no"), at.alias("start"), h.alias("text")),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


# What the browser's classes stand for (ASCII only, edges included).
CLASSES = {"w": "A-Za-z0-9_", "d": "0-9"}
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
INNER = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"


def browser_regex(pattern: str, case: bool) -> re.Pattern:
    """A browser pattern compiled here: ASCII classes, ``$`` at the very end, named groups."""
    out, in_class = [], False
    for tok in re.findall(r"(?s)\\.|\(\?<(?![=!])|.", pattern):
        low = tok[1:].lower()
        if tok[0] == "\\" and low in CLASSES and tok[1:].islower():
            tok = CLASSES[low] if in_class else f"[{CLASSES[low]}]"
        elif tok[0] == "\\" and low in CLASSES and not in_class:
            tok = f"[^{CLASSES[low]}]"
        elif tok in ("\\b", "\\B") and not in_class:
            tok = EDGE if tok == "\\b" else INNER
        elif tok == "(?<" and not in_class:
            tok = "(?P<"
        elif tok == "$" and not in_class:
            tok = r"\Z"
        elif tok == "[" and in_class:
            tok = r"\["
        elif tok in "[]":
            in_class = tok == "["
        out.append(tok)
    return re.compile("".join(out), 0 if case else re.IGNORECASE)


def _regex_spans(patterns: Sequence[str], case: bool):
    """Spans of every pattern in one pass over Arrow batches, held as columns of plain values.

    After an empty match the search goes on one character later.
    """

    @F.arrow_udf("array<struct<term_no:int,start:int,text:string>>")
    def spans(text: pa.Array) -> pa.Array:
        rxs = [browser_regex(p, case) for p in patterns]
        nos, starts, found, offsets = array("i"), array("i"), [], array("i", [0])
        for value in text:
            s = value.as_py()
            for no, rx in enumerate(rxs if s is not None else ()):
                m = rx.search(s)
                while m:
                    nos.append(no)
                    starts.append(m.start())
                    found.append(sys.intern(m.group()))
                    at = m.end() + (m.end() == m.start())
                    m = rx.search(s, at) if at <= len(s) else None
            offsets.append(len(nos))
        ints = lambda v: pa.array(np.frombuffer(v, dtype=np.int32))
        structs = pa.StructArray.from_arrays([ints(nos), ints(starts), pa.array(found, pa.string())], names=["term_no", "start", "text"])
        return pa.ListArray.from_arrays(ints(offsets), structs)

    # a deterministic function would be run a second time for the filter that explode implies
    return spans.asNondeterministic()


def find_text(
    items: DataFrame,
    terms: Sequence[str],
    case: bool = False,
    regex: bool = False,
    whole_word: bool = False,
    number: bool = True,
) -> DataFrame:
    """Every match of every term inside single text items.

    ``match_no`` counts per document in page, item, term, offset order and is
    part of the id.  Items without any match never leave the scan stage.
    Literal terms are searched in the JVM, patterns in Arrow batches.
    """
    terms = [t for t in terms if t.strip()]
    if not terms:
        raise ValueError("Search term is required")
    text = F.col("str")
    if regex:
        # one engine for all patterns, and one pass over the item
        spans, wanted = _regex_spans(terms, case)(text), F.lit(True)
    else:
        patterns = [term_pattern(t, False, whole_word, case) for t in terms]
        spans = F.flatten(F.array(*[_spans(text, p, i) for i, p in enumerate(patterns)]))
        wanted = reduce(or_, [text.rlike(p) for p in patterns])
    tr = F.col("transform")
    one = F.col("width") / F.length("str")
    found = (
        items.filter((text != "") & wanted)
        # values of the item are worked out once, before its matches become rows
        .select(
            "doc_id", "page_no", "item_no",
            one.alias("_one"), "height", tr[0].alias("_sx"), tr[4].alias("_tx"), tr[5].alias("_ty"),
            spans.alias("_hits"),
        )
        .withColumn("m", F.explode_outer("_hits"))
        # a plain explode would search a second time, for a filter on the number of matches
        .where("m IS NOT NULL")
        .select(
            "doc_id", "page_no", "item_no",
            F.col("m.term_no").alias("term_no"),
            F.col("m.start").alias("start"),
            F.col("m.text").alias("text"),
            (F.col("_tx") + F.col("m.start") * F.col("_one")).alias("x"),
            F.col("_ty").alias("y"),
            (F.length("m.text") * F.col("_one")).alias("width"),
            F.when(F.col("height") != 0, F.abs("height"))
            .otherwise(F.abs("_sx") * 0.8)
            .alias("height"),
        )
    )
    if not number:
        return found
    # numbering reads the matches twice; the search itself must run once
    found = materialise(found, "matches")
    numbered = running(
        found,
        ["doc_id"],
        [page_block(), F.col("page_no"), page_block("item_no", 65536)],
        ["page_no", "item_no", "term_no", "start"],
        before="match_no",
    )
    return numbered.withColumns(
        {
            "id": F.concat_ws(
                "-", F.lit("match"), F.col("page_no"), _fixed2("x"), _fixed2("y"), F.col("match_no")
            ),
            "selected": F.lit(True),
        }
    )


def _fixed2(c: str) -> Column:
    return half_up(F.col(c), 2).cast("decimal(20,2)").cast("string")


def match_summary(matches: DataFrame) -> DataFrame:
    """Matches and pages with matches per document, aggregated page by page."""
    per_page = matches.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    return per_page.groupBy("doc_id").agg(
        F.sum("n").cast("long").alias("n_matches"),
        F.count("*").alias("n_pages"),
        F.min("page_no").alias("first_page"),
        F.max("page_no").alias("last_page"),
    )


def match_pages(matches: DataFrame) -> DataFrame:
    """The pages with matches, one row each."""
    return matches.select("doc_id", "page_no").distinct()


def redact(
    items: DataFrame,
    matches: DataFrame,
    replacement: str = "█",
    selected_ids: DataFrame | None = None,
) -> DataFrame:
    """Remove matched text from its items: the replacement stands for each character
    run.  Overlapping matches are merged, so no matched character survives."""
    chosen = matches.filter("selected")
    if selected_ids is not None:
        chosen = chosen.join(selected_ids.select("id"), "id", "left_semi")
    spans = chosen.groupBy("doc_id", "page_no", "item_no").agg(
        F.array_sort(
            F.collect_set(
                F.struct(
                    F.col("start").alias("s"), (F.col("start") + F.length("text")).alias("e")
                )
            )
        ).alias("spans")
    )
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"), F.lit(False).alias("open"))

    def step(acc, sp):
        gap = F.greatest(sp["s"] - acc["pos"], F.lit(0))
        kept = F.substring(F.col("str"), acc["pos"] + 1, gap)
        # a span starting inside or right at the end of the last one adds no second mark
        joined = acc["open"] & (sp["s"] < acc["pos"])
        out = F.when(joined, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit(replacement)))
        return F.struct(
            out.alias("out"), F.greatest(acc["pos"], sp["e"]).alias("pos"), F.lit(True).alias("open")
        )

    cleaned = F.aggregate(
        F.col("spans"),
        empty,
        step,
        lambda a: F.concat(a["out"], F.substring(F.col("str"), a["pos"] + 1, F.length("str"))),
    )
    return (
        items.join(spans, ["doc_id", "page_no", "item_no"], "left")
        .withColumn("str", F.when(F.col("spans").isNull(), F.col("str")).otherwise(cleaned))
        .drop("spans")
    )


def unmatched_documents(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Error row for each document in which nothing was selected for redaction."""
    docs = items.select("doc_id").distinct()
    none = docs.join(matches.filter("selected").select("doc_id").distinct(), "doc_id", "left_anti")
    return error_rows(none, "redact", "INVALID_OPTIONS", F.lit("No matches selected for redaction"))


def to_pdf_coords(areas: DataFrame, pages: DataFrame) -> DataFrame:
    """Areas given from the top-left corner, turned to the bottom-left origin."""
    h = pages.select("doc_id", "page_no", "height_pt")
    return areas.join(h, ["doc_id", "page_no"]).withColumn(
        "y", F.col("height_pt") - F.col("y") - F.col("height")
    ).drop("height_pt")


def validate_areas(areas: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Messages about (doc_id, area_no, page_no, x, y, width, height), one row each."""
    n = F.col("area_no")
    checks = F.array(
        F.when(
            (F.col("page_no") < 1) | (F.col("page_no") > F.coalesce("n_pages", F.lit(0))),
            F.format_string("Area %d: Invalid page number %d", n, F.col("page_no")),
        ),
        F.when(F.col("width") <= 0, F.format_string("Area %d: Width must be positive", n)),
        F.when(F.col("height") <= 0, F.format_string("Area %d: Height must be positive", n)),
        F.when(F.col("x") < 0, F.format_string("Area %d: X coordinate cannot be negative", n)),
        F.when(F.col("y") < 0, F.format_string("Area %d: Y coordinate cannot be negative", n)),
    )
    found = areas.join(page_counts, "doc_id", "left").select(
        "doc_id", "area_no", F.posexplode(checks).alias("check_no", "message")
    ).filter("message IS NOT NULL")
    missing = page_counts.join(areas.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id",
        F.lit(0).cast("long").alias("area_no"),
        F.lit(0).alias("check_no"),
        F.lit("No redaction areas specified").alias("message"),
    )
    return found.unionByName(missing)


TILE = 64.0


def redact_areas(items: DataFrame, areas: DataFrame, replacement: str = "") -> DataFrame:
    """Replace the text of items whose box meets an area (bottom-left origin).

    Both sides are repeated per horizontal band they touch, so the join key is
    (doc, page, band) and a crowded page spreads over its bands.
    """

    def bands(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / TILE), F.floor(hi / TILE)))

    iy, ih = F.col("transform")[5], F.abs("height")
    boxes = items.select(
        "doc_id", "page_no", "item_no",
        F.col("transform")[4].alias("ix"), iy.alias("iy"), F.col("width").alias("iw"), ih.alias("ih"),
        bands(iy, iy + ih).alias("_band"),
    )
    marks = areas.filter("width > 0 AND height > 0").select(
        "doc_id", "page_no", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"),
        bands(F.col("y"), F.col("y") + F.col("height")).alias("_band"),
    )
    hit = (
        boxes.join(marks, ["doc_id", "page_no", "_band"])
        .filter("ix < x + w AND ix + iw > x AND iy < y + h AND iy + ih > y")
        .select("doc_id", "page_no", "item_no")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return (
        items.join(hit, ["doc_id", "page_no", "item_no"], "left")
        .withColumn("str", F.when(F.col("_hit"), F.lit(replacement)).otherwise(F.col("str")))
        .drop("_hit")
    )
