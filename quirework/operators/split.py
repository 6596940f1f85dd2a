"""Splitting documents into parts, and labelling their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.units import letters, roman
from quirework.operators.errors import error_rows
from quirework.operators.pages import pages_in_spans, spec_spans
from quirework.operators.prefix import (

    interval_join,
    number_rows,
    page_block,
    running,
    with_totals,
)

KEY = ["doc_id"]


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """Parts of ``n`` pages; the last may be short."""
    return pages.withColumn("part_no", (F.floor((F.col("page_no") - 1) / F.lit(n)) + 1).cast("long"))


def split_n(pages: DataFrame, n: int) -> DataFrame:
    """``n`` parts of almost equal length, longer ones first; a document with
    fewer pages than parts stays whole."""
    df = with_totals(pages, KEY)
    t, i = F.col("total_pages"), F.col("page_no") - 1
    size = F.greatest(F.floor(t / F.lit(max(n, 1))), F.lit(1))
    extra = F.pmod(t, F.lit(max(n, 1)))
    head = extra * (size + 1)
    part = F.when(i < head, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - head) / size))
    whole = (F.lit(n) <= 0) | (F.lit(n) > t)
    return df.withColumn(
        "part_no", F.when(whole, F.lit(1)).otherwise(part + 1).cast("long")
    ).drop("total_pages")


def split_parity(pages: DataFrame) -> DataFrame:
    """Part 1 holds odd pages, part 2 even pages."""
    return pages.withColumn("part_no", F.when(F.col("page_no") % 2 == 1, 1).otherwise(2).cast("long"))


def split_by_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Assign pages to (doc_id, range_no, start_page, end_page) rows.

    Overlapping ranges put a page into several parts.  Use ``check_ranges``
    first; ranges reaching outside the document match only existing pages.
    """
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("_last"))
    spans = ranges.join(last, "doc_id").select(
        *ranges.columns,
        F.greatest(F.col("start_page"), F.lit(1).cast("long")).alias("_lo"),
        F.least("end_page", "_last").alias("_hi"),
    )
    joined = interval_join(pages, spans, KEY, "page_no", "_lo", "_hi").drop("_lo", "_hi")
    return joined.withColumnRenamed("range_no", "part_no").withColumn(
        "part_page", (F.col("page_no") - F.col("start_page") + 1).cast("long")
    )


def check_ranges(ranges: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Error row per document: the message of its first bad range."""
    n, s, e, t = (F.col(c) for c in ("range_no", "start_page", "end_page", "n_pages"))
    msg = (
        F.when(s < 1, F.format_string("Range %d: Start page must be at least 1.", n))
        .when(e < s, F.format_string("Range %d: End page (%d) cannot be less than start page (%d).", n, e, s))
        .when(e > t, F.format_string("Range %d: End page (%d) exceeds total pages (%d).", n, e, t))
        .when(s > t, F.format_string("Range %d: Start page (%d) exceeds total pages (%d).", n, s, t))
    )
    bad = (
        ranges.join(page_counts, "doc_id")
        .withColumn("_m", msg)
        .filter("_m IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min_by("_m", "range_no").alias("message"))
    )
    return error_rows(bad, "split_by_ranges", "INVALID_PAGE_RANGE", "message")


def outline_ranges(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Top-level bookmarks as ranges (doc_id, range_no, start_page, end_page, label).

    Marks outside the document are dropped and marks sharing a page collapse to
    the last.  Pages before the first mark become ``Introduction``; a document
    without usable marks stays whole as ``Complete Document``.
    """
    marks = (
        outline.filter("level = 1")
        .join(page_counts, "doc_id")
        .filter("page_no BETWEEN 1 AND n_pages")
        .groupBy("doc_id", "page_no")
        .agg(F.max_by("title", "ordinal").alias("label"), F.max("n_pages").alias("n_pages"))
    )
    # next mark: inside the block by window, over the block edge by the block's successor
    blk = marks.withColumn("_b", page_block("page_no"))
    edges = blk.groupBy("doc_id", "_b").agg(F.min("page_no").alias("_first"))
    w = Window.partitionBy("doc_id").orderBy("_b")
    edges = edges.select(
        "doc_id",
        "_b",
        F.lead("_first").over(w).alias("_next_block"),
        (F.row_number().over(w) == 1).alias("_head"),
        "_first",
    )
    wl = Window.partitionBy("doc_id", "_b").orderBy("page_no")
    joined = blk.join(edges, ["doc_id", "_b"])
    nxt = F.coalesce(F.lead("page_no").over(wl), F.col("_next_block"))
    body = joined.select(
        "doc_id",
        F.col("page_no").alias("start_page"),
        F.coalesce(nxt - 1, F.col("n_pages")).alias("end_page"),
        "label",
    )
    intro = (
        edges.filter("_head AND _first > 1")
        .select(
            "doc_id",
            F.lit(1).cast("long").alias("start_page"),
            (F.col("_first") - 1).alias("end_page"),
            F.lit("Introduction").alias("label"),
        )
    )
    whole = page_counts.join(marks.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id",
        F.lit(1).cast("long").alias("start_page"),
        F.col("n_pages").alias("end_page"),
        F.lit("Complete Document").alias("label"),
    )
    out = body.unionByName(intro).unionByName(whole)
    return number_rows(out, KEY, ["start_page"], "range_no")


def split_by_outline(outline: DataFrame, pages: DataFrame) -> DataFrame:
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return split_by_ranges(pages, outline_ranges(outline, counts))


def consecutive_ranges(selected: DataFrame) -> DataFrame:
    """Runs of consecutive selected pages as (doc_id, start_page, end_page)."""
    numbered = number_rows(selected.distinct(), KEY, ["page_no"], "_rn")
    # an island may span blocks; grouping by its constant difference is one
    # partial-aggregated groupBy, so long islands collapse before the shuffle
    return (
        numbered.groupBy("doc_id", (F.col("page_no") - F.col("_rn")).alias("_island"))
        .agg(F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"))
        .drop("_island")
    )


def page_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that applies to each page; among several the later one wins.

    ``rules``: (doc_id, rule_no, page_range, style, prefix, start_value).
    """
    hits = pages_in_spans(pages, spec_spans(pages, rules, "page_range", "labels"))
    best = hits.groupBy("doc_id", "page_no").agg(
        F.max_by(F.struct("rule_no", "style", "prefix", "start_value"), "rule_no").alias("rule")
    )
    return pages.join(best, ["doc_id", "page_no"], "left")


def render_label(style: Column, prefix: Column, n: Column) -> Column:
    """Styles: D decimal, R/r roman, A/a letters, none (prefix alone)."""
    num = (
        F.when(style == "D", n.cast("string"))
        .when(style == "R", roman(n))
        .when(style == "r", F.lower(roman(n)))
        .when(style == "A", letters(n))
        .when(style == "a", F.lower(letters(n)))
        .otherwise(F.lit(""))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), num)


def page_labels(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Label text of every page.

    A rule keeps counting over disjoint stretches; pages without a rule show
    their page number.
    """
    ruled = page_rules(pages.select("doc_id", "page_no"), rules).withColumn(
        "_rule", F.coalesce(F.col("rule.rule_no"), F.lit(-1))
    )
    counted = running(ruled, ["doc_id", "_rule"], [page_block()], ["page_no"], before="_seen")
    value = F.when(
        F.col("_rule") >= 0, F.coalesce(F.col("rule.start_value"), F.lit(1)) + F.col("_seen")
    ).otherwise(F.col("page_no"))
    style = F.when(F.col("_rule") >= 0, F.col("rule.style")).otherwise(F.lit("D"))
    return counted.select(
        "doc_id",
        "page_no",
        F.when(F.col("_rule") >= 0, F.col("_rule")).alias("rule_no"),
        style.alias("style"),
        value.cast("long").alias("value"),
        render_label(style, F.col("rule.prefix"), value.cast("long")).alias("label"),
    )


def label_runs(labelled: DataFrame) -> DataFrame:
    """First page of every stretch of one rule, with its starting value.

    The previous page is found by an equi-join on its number, not by a window
    over the document.
    """
    prev = labelled.select(
        "doc_id", (F.col("page_no") + 1).alias("page_no"), F.coalesce("rule_no", F.lit(-1)).alias("_p")
    )
    return (
        labelled.join(prev, ["doc_id", "page_no"], "left")
        .filter(F.col("_p").isNull() | (F.col("_p") != F.coalesce("rule_no", F.lit(-1))))
        .select("doc_id", "page_no", "rule_no", "style", F.col("value").alias("start_value"))
    )


def overlay_pages(
    base: DataFrame,
    layer: DataFrame,
    pairs: DataFrame,
    page_range: str = "",
    loop: bool = True,
    mode: str = "overlay",
) -> DataFrame:
    """Which layer page is drawn with each base page.

    ``pairs`` maps doc_id (base) to layer_id.  Base pages are never dropped;
    pages outside the range or past a non-looping layer stay unchanged.
    """
    from quirework.functions.pagespec import literal_covers

    counts = layer.groupBy(F.col("doc_id").alias("layer_id")).agg(F.count("*").alias("_n"))
    with_layer = base.join(pairs.join(counts, "layer_id"), "doc_id", "left")
    p = F.col("page_no")
    want = literal_covers(page_range, p, "overlay")
    no = (F.pmod(p - 1, F.col("_n")) + 1) if loop else F.when(p <= F.col("_n"), p)
    return with_layer.select(
        "doc_id",
        "page_no",
        F.when(want & no.isNotNull(), F.col("layer_id")).alias("layer_id"),
        F.when(want, no).cast("long").alias("layer_page"),
        F.when(want & no.isNotNull(), F.lit(mode)).otherwise(F.lit("copy")).alias("mode"),
    )


def doc_stats(pages: DataFrame) -> DataFrame:
    """Pages and characters per document; partial sums before the shuffle."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum(F.length("text")).cast("long").alias("n_chars")
    )


def part_ranges(parted: DataFrame) -> DataFrame:
    """(doc_id, part_no) -> page span of each part."""
    return parted.groupBy("doc_id", "part_no").agg(
        F.min("page_no").alias("start_page"),
        F.max("page_no").alias("end_page"),
        F.count("*").alias("n_pages"),
    )


