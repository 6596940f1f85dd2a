"""Page algebra: select, delete, reorder, rotate, crop, merge, interleave."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.pagespec import literal_covers, literal_ranges, spec_ranges
from quirework.operators.errors import error_rows
from quirework.operators.prefix import interval_join, number_rows, page_block, running, with_totals

KEY = ["doc_id"]


def select_pages(pages: DataFrame, spec: str, dialect: str = "extract") -> DataFrame:
    """Keep the pages of an option string; a plain predicate that reaches the scan."""
    return pages.filter(literal_covers(spec, F.col("page_no"), dialect))


def spec_spans(pages: DataFrame, specs: DataFrame, column: str, dialect: str) -> DataFrame:
    """Specification rows as intervals (_lo, _hi, _par) cut to the document's pages."""
    rest = [c for c in specs.columns if c != column]
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("_last"))
    return (
        specs.select(*rest, F.explode(spec_ranges(F.col(column), dialect)).alias("_r"))
        .join(last, "doc_id")
        .select(
            *rest,
            F.greatest(F.col("_r.lo"), F.lit(1).cast("long")).alias("_lo"),
            F.least(F.col("_r.hi"), F.col("_last")).alias("_hi"),
            F.col("_r.parity").alias("_par"),
        )
    )


def pages_in_spans(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page_no) with the columns of every span that covers the page."""
    hits = interval_join(pages.select("doc_id", "page_no"), spans, KEY, "page_no", "_lo", "_hi")
    return hits.filter((F.col("_par") < 0) | (F.col("page_no") % 2 == F.col("_par"))).drop(
        "_lo", "_hi", "_par"
    )


def select_pages_by(pages: DataFrame, specs: DataFrame, dialect: str = "extract") -> DataFrame:
    """Keep the pages named by a per-document specification (doc_id, spec)."""
    spans = spec_spans(pages, specs.select("doc_id", "spec"), "spec", dialect)
    hits = pages_in_spans(pages, spans).select("doc_id", "page_no").distinct()
    return pages.join(hits, ["doc_id", "page_no"], "left_semi")


def check_selection(page_counts: DataFrame, specs: DataFrame) -> DataFrame:
    """Strict reading: one error row per document whose list is empty or out of range."""
    r = F.filter(spec_ranges(F.col("spec"), "extract"), lambda x: x["hi"] >= x["lo"])
    bad_low = F.filter(r, lambda x: x["lo"] < 1)
    bad_high = F.filter(r, lambda x: x["hi"] > F.col("n_pages"))
    msg = (
        F.when(F.size(r) == 0, F.lit("No pages specified for extraction."))
        .when(
            F.size(bad_low) > 0,
            F.concat(
                F.lit("Page number must be at least 1. Found "),
                F.get(bad_low, F.lit(0))["lo"].cast("string"),
                F.lit("."),
            ),
        )
        .when(
            F.size(bad_high) > 0,
            F.format_string(
                "Page %d exceeds total pages (%d).",
                F.greatest(F.get(bad_high, F.lit(0))["lo"], F.col("n_pages") + 1),
                F.col("n_pages"),
            ),
        )
    )
    found = page_counts.join(specs, "doc_id").withColumn("message", msg)
    return error_rows(found.filter("message IS NOT NULL"), "select_pages", "INVALID_PAGE_RANGE", "message")


def renumber(pages: DataFrame, number: str = "page_no") -> DataFrame:
    """Close gaps: page numbers become 1..n in the old order."""
    return number_rows(pages, KEY, [number], "_new").drop(number).withColumnRenamed("_new", number)


def delete_pages(pages: DataFrame, spec: str) -> DataFrame:
    """Drop pages and renumber the rest; a document left empty yields no rows
    (see ``emptied_documents`` for its error row)."""
    kept = pages.filter(~literal_covers(spec, F.col("page_no")))
    # gaps are known from the option itself, so the shift is arithmetic
    merged: list[list[int]] = []
    for lo, hi, _ in sorted(r for r in literal_ranges(spec) if r[1] >= r[0]):
        lo = max(lo, 1)
        if hi < lo:
            continue
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    shift = F.lit(0).cast("long")
    for lo, hi in merged:
        shift = shift + F.when(F.col("page_no") > hi, F.lit(hi - lo + 1)).otherwise(0)
    return kept.withColumn("page_no", F.col("page_no") - shift)


def emptied_documents(pages: DataFrame, spec: str) -> DataFrame:
    left = F.sum((~literal_covers(spec, F.col("page_no"))).cast("long"))
    gone = pages.groupBy("doc_id").agg(left.alias("n")).filter("n = 0")
    return error_rows(gone, "delete_pages", "INVALID_OPTIONS", F.lit("Cannot delete all pages."))


def filter_parity(pages: DataFrame, mode: str, listed: Sequence[int] = ()) -> DataFrame:
    """Pages for ``all``, ``odd``, ``even`` or ``custom`` (an explicit list)."""
    p = F.col("page_no")
    cond = {
        "all": F.lit(True),
        "odd": p % 2 == 1,
        "even": p % 2 == 0,
        "custom": p.isin(list(listed)) if listed else F.lit(False),
    }[mode]
    return pages.filter(cond)


def reorder_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Rebuild documents from (doc_id, new_no, page_no); repeats are allowed."""
    return (
        order.join(pages, ["doc_id", "page_no"])
        .withColumnRenamed("page_no", "source_page")
        .withColumnRenamed("new_no", "page_no")
    )


def rotate_pages(pages: DataFrame, angle: float | None = None, by_page: DataFrame | None = None) -> DataFrame:
    """Turn pages by one angle, or by (doc_id, page_no, angle) rows.

    Quarter turns add to ``rotation``; other angles grow the box instead.
    """
    if by_page is None:
        turned = pages.withColumn("_a", F.lit(float(angle)))
    else:
        turned = pages.join(
            by_page.select("doc_id", "page_no", F.col("angle").cast("double").alias("_a")),
            ["doc_id", "page_no"],
            "left",
        ).withColumn("_a", F.coalesce("_a", F.lit(0.0)))
    quarter = F.pmod(F.col("_a"), F.lit(90.0)) == 0
    rad = F.radians("_a")
    c, s = F.abs(F.cos(rad)), F.abs(F.sin(rad))
    w, h = F.col("width_pt"), F.col("height_pt")
    return turned.withColumns(
        {
            "rotation": F.when(
                quarter, F.pmod(F.col("rotation") + F.col("_a"), F.lit(360.0)).cast("int")
            ).otherwise(F.col("rotation")),
            "width_pt": F.when(quarter, w).otherwise(w * c + h * s),
            "height_pt": F.when(quarter, h).otherwise(w * s + h * c),
        }
    ).drop("_a")


def crop_boxes(pages: DataFrame, crops: DataFrame) -> DataFrame:
    """Crop boxes from fractions (x, y, width, height; top-left origin)."""
    w, h = F.col("width_pt"), F.col("height_pt")
    return pages.join(crops, ["doc_id", "page_no"], "left").select(
        *pages.columns,
        F.coalesce(F.col("cx") * w, F.lit(0.0)).alias("box_x"),
        F.coalesce(h - F.col("cy") * h - F.col("ch") * h, F.lit(0.0)).alias("box_y"),
        F.coalesce(F.col("cw") * w, w).alias("box_w"),
        F.coalesce(F.col("ch") * h, h).alias("box_h"),
    )


def merge_docs(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Concatenate documents: plan rows are (bundle_id, file_no, doc_id).

    Offsets come from one row per file, so no bundle is gathered in one task.
    """
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("_n"))
    files = plan.join(counts, "doc_id")
    offsets = running(files, ["bundle_id"], [page_block("file_no")], ["file_no"], F.col("_n"), "_off")
    return pages.join(offsets.drop("_n"), "doc_id").select(
        "bundle_id",
        (F.col("_off") + F.col("page_no")).cast("long").alias("page_no"),
        F.col("doc_id").alias("source_doc"),
        F.col("page_no").alias("source_page"),
        *[c for c in pages.columns if c not in ("doc_id", "page_no")],
    )


def merge_outline(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """One bookmark per merged file, at its first page; titles drop the extension."""
    from quirework.functions.names import stem

    counts = pages.groupBy("doc_id").agg(F.count("*").alias("_n"))
    files = plan.join(counts, "doc_id")
    offsets = running(files, ["bundle_id"], [page_block("file_no")], ["file_no"], F.col("_n"), "_off")
    return offsets.select(
        "bundle_id",
        F.col("file_no").alias("ordinal"),
        stem(F.col("filename")).alias("title"),
        (F.col("_off") + 1).cast("long").alias("page_no"),
    )


def reverse_pages(pages: DataFrame) -> DataFrame:
    """Last page first; documents of a single page are left out (see errors)."""
    out = with_totals(pages, KEY).filter("total_pages >= 2")
    return out.withColumn(
        "page_no", (F.col("total_pages") - F.col("page_no") + 1).cast("long")
    ).drop("total_pages")


def insert_blank(
    pages: DataFrame, position: int, count: int = 1, size: tuple[float, float] | None = None
) -> DataFrame:
    """Insert blank pages after ``position`` (0 = in front), sized like page 1."""
    shifted = pages.withColumn("_old", F.col("page_no")).withColumn(
        "page_no", F.col("page_no") + F.when(F.col("page_no") > position, F.lit(count)).otherwise(0)
    )
    doc = pages.groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= position)
    first = pages.filter("page_no = 1").select("doc_id", "width_pt", "height_pt")
    blanks = doc.join(first, "doc_id").select(
        "doc_id",
        F.explode(F.sequence(F.lit(position + 1).cast("long"), F.lit(position + count).cast("long"))).alias("page_no"),
        (F.lit(float(size[0])) if size else F.col("width_pt")).alias("width_pt"),
        (F.lit(float(size[1])) if size else F.col("height_pt")).alias("height_pt"),
        F.lit(0).alias("rotation"),
    )
    # a document shorter than the position is reported, not changed
    valid = with_totals(shifted, KEY, "_old", "_t").filter(F.col("_t") >= position).drop("_t", "_old")
    return valid.unionByName(blanks, allowMissingColumns=True)


def interleave(pages: DataFrame, plan: DataFrame, reverse_second: bool = False) -> DataFrame:
    """Take page 1 of every file, then page 2, ...; short files run out.

    ``plan`` rows are (bundle_id, file_no, doc_id), file_no from 1.
    """
    joined = pages.join(plan, "doc_id")
    if reverse_second:
        joined = with_totals(joined, ["bundle_id", "doc_id"]).withColumn(
            "_round",
            F.when(F.col("file_no") == 2, F.col("total_pages") - F.col("page_no") + 1).otherwise(
                F.col("page_no")
            ),
        ).drop("total_pages")
    else:
        joined = joined.withColumn("_round", F.col("page_no"))
    out = number_rows(
        joined,
        ["bundle_id"],
        ["_round", "file_no"],
        "_new",
        blocks=[page_block("_round"), F.col("_round"), page_block("file_no")],
    )
    return out.select(
        "bundle_id",
        F.col("_new").alias("page_no"),
        F.col("doc_id").alias("source_doc"),
        F.col("page_no").alias("source_page"),
        *[c for c in pages.columns if c not in ("doc_id", "page_no")],
    )


def concat(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union of page tables by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# Fixed value: size of a blank page in an assembly (A4, points).
BLANK_SIZE = (595.28, 841.89)


def assemble(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Build documents from rows (target_id, position, doc_id, page_no, turn).

    A row without a source document is a blank page.
    """
    src = pages.select(
        "doc_id", "page_no", "width_pt", "height_pt", F.col("rotation").alias("_rot")
    )
    return plan.join(src, ["doc_id", "page_no"], "left").filter(
        F.col("doc_id").isNull() | F.col("width_pt").isNotNull()
    ).select(
        "target_id",
        "position",
        F.col("doc_id").alias("source_doc"),
        F.col("page_no").alias("source_page"),
        F.coalesce("width_pt", F.lit(BLANK_SIZE[0])).alias("width_pt"),
        F.coalesce("height_pt", F.lit(BLANK_SIZE[1])).alias("height_pt"),
        F.pmod(F.coalesce("_rot", F.lit(0)) + F.coalesce("turn", F.lit(0)), F.lit(360)).cast("int").alias("rotation"),
    )


def drop_blank_pages(pages: DataFrame, threshold: float = 99.0) -> DataFrame:
    """Drop pages whose white share reaches the threshold, then renumber.

    Expects ``white_pixels`` and ``total_pixels``; a page table with text only
    gets them from :func:`text_ink`.  All-blank documents yield no rows.
    """
    blank = 100.0 * F.col("white_pixels") / F.col("total_pixels") >= threshold
    return renumber(pages.filter(~blank))


def text_ink(pages: DataFrame) -> DataFrame:
    """Blank-page statistic for text pages: no visible character means all white."""
    seen = F.length(F.regexp_replace("text", r"\s+", ""))
    return pages.withColumns(
        {"white_pixels": F.when(seen == 0, F.lit(1)).otherwise(0), "total_pixels": F.lit(1)}
    )


def page_numbers(
    pages: DataFrame,
    fmt: str = "number",
    start: int = 1,
    skip_first: bool = False,
    mode: str = "all",
    prefix: str = "",
    suffix: str = "",
    custom: str = "Page {page} of {total}",
    skip: Sequence[int] = (),
) -> DataFrame:
    """The number text to stamp on each page."""
    from quirework.functions.units import roman

    df = with_totals(pages, KEY)
    less = 1 if skip_first else 0
    p = F.col("page_no")
    shown = (F.lit(start - 1 - less) + p).cast("long")
    total = (F.col("total_pages") - less).cast("long")
    text = {
        "number": shown.cast("string"),
        "roman": roman(shown),
        "page-of-total": F.format_string("Page %d of %d", shown, total),
        "custom": F.replace(
            F.replace(F.lit(custom), F.lit("{page}"), shown.cast("string")),
            F.lit("{total}"),
            total.cast("string"),
        ),
    }[fmt]
    cond = F.lit(True)
    if skip_first:
        cond = cond & (p != 1)
    if skip:
        cond = cond & ~p.isin(list(skip))
    if mode == "odd-only":
        cond = cond & (p % 2 == 1)
    elif mode == "even-only":
        cond = cond & (p % 2 == 0)
    return df.filter(cond).select(
        "doc_id", "page_no", F.concat(F.lit(prefix), text, F.lit(suffix)).alias("stamp")
    )


def header_footer(
    pages: DataFrame, template: str, date: str, page_range: str = "all", skip_first: bool = False
) -> DataFrame:
    """Header or footer text; ``{page}``, ``{total}`` and ``{date}`` are filled in."""
    df = with_totals(pages, KEY)
    text = F.lit(template)
    for mark, val in (
        ("{page}", F.col("page_no").cast("string")),
        ("{total}", F.col("total_pages").cast("string")),
        ("{date}", F.lit(date)),
    ):
        text = F.replace(text, F.lit(mark), val)
    cond = literal_covers(page_range, F.col("page_no"), "header")
    if skip_first:
        cond = cond & (F.col("page_no") != 1)
    return df.filter(cond).select("doc_id", "page_no", text.alias("stamp"))


def grid_groups(pages: DataFrame, cols: int, rows: int, skip_first: bool = False) -> DataFrame:
    """Contact-sheet number and slot of each page; the cover may stand alone."""
    k = cols * rows
    idx = F.col("page_no") - 1
    if skip_first:
        sheet = F.when(idx == 0, F.lit(1)).otherwise(F.floor((idx - 1) / F.lit(k)) + 2)
        slot = F.when(idx == 0, F.lit(0)).otherwise(F.pmod(idx - 1, F.lit(k)))
    else:
        sheet = F.floor(idx / F.lit(k)) + 1
        slot = F.pmod(idx, F.lit(k))
    return pages.withColumns({"sheet_no": sheet.cast("long"), "slot": slot.cast("long")})


# Contents-page geometry (A4, points).
TOC_PAGE_HEIGHT, TOC_MARGIN, TOC_INDENT, TOC_LEADING, TOC_TITLE_EXTRA = 842, 72, 20, 1.8, 6


def toc_layout(outline: DataFrame, font_size: float = 12.0) -> DataFrame:
    """Contents page, row and shifted target of each outline entry.

    Expects (doc_id, ordinal from 1, level, title, page_no).
    """
    fs = float(font_size)
    lead = fs * TOC_LEADING
    room = TOC_PAGE_HEIGHT - 2 * TOC_MARGIN
    later = max(1, math.floor(room / lead + 1e-9))
    first = max(0, math.floor((room - 2 * (fs + TOC_TITLE_EXTRA)) / lead + 1e-9))
    counted = with_totals(outline, KEY, "ordinal", "_total")

    def sheet(i: Column) -> Column:
        return F.when(i < first, F.lit(1)).otherwise(F.floor((i - first) / F.lit(later)) + 2)

    i = F.col("ordinal") - 1
    n_toc = sheet(F.col("_total") - 1)
    return counted.select(
        "doc_id",
        "ordinal",
        "title",
        sheet(i).cast("long").alias("toc_page"),
        (F.when(i < first, i).otherwise(F.pmod(i - first, F.lit(later)))).cast("long").alias("toc_row"),
        ((F.col("level") - 1) * TOC_INDENT).cast("long").alias("indent"),
        (F.col("page_no") + n_toc).cast("long").alias("target_page"),
    )
