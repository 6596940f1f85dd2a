"""Table detection on positioned items, text lines, and Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirework.functions.arrays import let
from quirework.functions.text import squeeze, strip
from quirework.functions.units import half_up
from quirework.operators.pagepacks import PAGE, changes, map_pages, map_parts, ordered

# Row and column tolerance of the table grid, line tolerance (points).
ROW_STEP, COL_STEP, LINE_TOLERANCE = 5.0, 10.0, 5.0


#: What a pattern's white space is to the JVM.
BLANK = " \t\n\x0b\f\r"


def page_grid(ys: np.ndarray, xs: np.ndarray, nos: np.ndarray, strs: list, min_cols: int, min_rows: int) -> list[tuple]:
    """Tables of a page as (table_no, y of each row, rows of cells), from items on the grid."""
    order = ordered(strs, nos, xs, -ys)
    y, x = ys[order], xs[order]
    columns, col = np.unique(x, return_inverse=True)
    new_row = np.r_[True, y[1:] != y[:-1]]
    new_cell = new_row | np.r_[True, x[1:] != x[:-1]]
    first = np.flatnonzero(new_cell)
    cells: list[str | None] = [None if strs[k] is None else strs[k].strip(BLANK) for k in order[first].tolist()]
    size = np.diff(np.r_[first, len(order)])
    for c in np.flatnonzero(size > 1).tolist():
        for k in order[first[c] + 1 : first[c] + size[c]].tolist():
            cells[c] = None if strs[k] is None or cells[c] is None else f"{cells[c]} {strs[k]}".strip(BLANK)
    col = col[first].tolist()
    row_at = np.flatnonzero(new_row[first]).tolist()
    found: list[tuple[list, list]] = []
    open_ = False
    for i, j in zip(row_at, [*row_at[1:], len(cells)], strict=True):
        if sum(1 for c in cells[i:j] if c) < min_cols:
            open_ = False
            continue
        row: list[str | None] = [""] * len(columns)
        for c, text in zip(col[i:j], cells[i:j], strict=True):
            row[c] = text
        if not open_:
            found.append(([], []))
            open_ = True
        found[-1][0].append(float(y[first[i]]))
        found[-1][1].append(row)
    return [(no, *t) for no, t in enumerate((t for t in found if len(t[0]) >= min_rows), 1)]


def page_tables_of(items: DataFrame, min_cols: int, min_rows: int) -> DataFrame:
    """(doc_id, page_no, table_no, ys, rows): one row per table.

    Items snap to a 5 x 10 point grid.  A page's items come together once, packed, and its tables are found in one go."""
    grid = items.select(
        *PAGE,
        (half_up(F.col("transform")[5] / ROW_STEP) * ROW_STEP).alias("y"),
        (half_up(F.col("transform")[4] / COL_STEP) * COL_STEP).alias("x"),
        "item_no",
        "str",
    )
    keys = dict(grid.dtypes)
    arrow = pa.schema([
        *((c, to_arrow_type(grid.schema[c].dataType)) for c in PAGE), ("table_no", pa.int64()), ("ys", pa.list_(pa.float64())), ("rows", pa.list_(pa.list_(pa.string()))),
    ])
    schema = ", ".join(f"{c} {keys[c]}" for c in PAGE) + ", table_no long, ys array<double>, rows array<array<string>>"
    return map_pages(grid, lambda y, x, no, s: page_grid(y, x, no, s, min_cols, min_rows), schema, arrow)


def table_rows(items: DataFrame, min_cols: int = 2, min_rows: int = 2) -> DataFrame:
    """Rows of detected tables: (doc_id, page_no, table_no, row_no, y, cells)."""
    found = page_tables_of(items, min_cols, min_rows)
    rows = found.select(*PAGE, "table_no", F.posexplode(F.arrays_zip("ys", "rows")).alias("i", "r"))
    return rows.select(*PAGE, "table_no", (F.col("i") + 1).cast("long").alias("row_no"), F.col("r.ys").alias("y"), F.col("r.rows").alias("cells"))


def detect_tables(items: DataFrame, min_cols: int = 2, min_rows: int = 2) -> DataFrame:
    """One row per table: (doc_id, page_no, table_no, start_y, end_y, rows)."""
    # rows come from the top
    found = page_tables_of(items, min_cols, min_rows)
    return found.select(*PAGE, "table_no", F.col("ys")[0].alias("start_y"), F.element_at("ys", -1).alias("end_y"), "rows")


def first_fit(page: np.ndarray, ys: np.ndarray, nos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line of each item, numbered over all pages in order, and the y of each line's opening item."""
    order = np.lexsort((nos, ys, page))
    p, y = page[order], ys[order]
    new = np.r_[True, (p[1:] != p[:-1]) | (y[1:] != y[:-1])]
    at = np.flatnonzero(new)
    values, of, first = y[at], p[at], nos[order[at]]
    line = np.empty(len(at), dtype=np.int64)
    leaders: list[float] = []
    begin, last = 0, None
    by_first = np.lexsort((values, first, of))
    for v, y_, page_ in zip(by_first.tolist(), values[by_first].tolist(), of[by_first].tolist(), strict=True):
        if page_ != last:
            begin, last = len(leaders), page_
        fit = next((k for k in range(begin, len(leaders)) if abs(leaders[k] - y_) < LINE_TOLERANCE), len(leaders))
        if fit == len(leaders):
            leaders.append(y_)
        line[v] = fit
    out = np.empty(len(order), dtype=np.int64)
    out[order] = line[np.cumsum(new) - 1]
    return out, np.array(leaders)


def font_styles(font: str) -> tuple[bool, bool]:
    """Whether a font's name says bold, and italic."""
    return bool(re.search("bold|heavy|black", font.lower())), bool(re.search("italic|oblique", font.lower()))


def page_lines(ys: np.ndarray, xs: np.ndarray, nos: np.ndarray, strs: list, fonts: list, sizes: np.ndarray) -> list[tuple]:
    """Lines of a page as (y, font size, bold, italic, items, x), first fit in item order."""
    of, leaders = first_fit(np.zeros(len(ys), dtype=np.int64), ys, nos)
    order = ordered(strs, nos, xs, of)
    start = np.flatnonzero(np.diff(of[order], prepend=-1)).tolist()
    styles = {f: font_styles(f) for f in set(fonts) if f is not None}
    out = []
    for i, j in zip(start, [*start[1:], len(order)], strict=True):
        at = order[i:j]
        own = [styles[f] for f in {fonts[k] for k in at.tolist()} if f is not None]
        bold, italic = (any(s[n] for s in own) if own else None for n in (0, 1))
        listed = (xs[at], nos[at], [strs[k] for k in at.tolist()], [fonts[k] for k in at.tolist()])
        out.append((float(leaders[of[at[0]]]), float(np.max(sizes[at])), bold, italic, listed, float(xs[at[0]])))
    return out


def line_items(items: DataFrame) -> DataFrame:
    """What lines need of items."""
    return items.select(
        *PAGE, F.col("transform")[5].cast("double").alias("y"), F.col("transform")[4].cast("double").alias("x"), F.col("item_no").cast("long").alias("item_no"), "str", "font_name",
        F.when(F.col("height") > 0, F.col("height")).otherwise(F.abs(F.col("transform")[0])).cast("double").alias("fs"),
    )


def group_lines(items: DataFrame) -> DataFrame:
    """Items to text lines, first fit in item order.

    An item joins the first line whose opening item is less than 5 points away
    in y.  Whether and where it joins depends on y alone, so the fold runs over
    the distinct y values of a page (in order of first appearance).  A page's
    items come together once, packed.
    """
    base = line_items(items)
    keys = dict(base.dtypes)
    item = pa.struct([("x", pa.float64()), ("item_no", pa.int64()), ("str", pa.string()), ("font_name", pa.string())])
    arrow = pa.schema([
        *((c, to_arrow_type(base.schema[c].dataType)) for c in PAGE), ("y", pa.float64()), ("font_size", pa.float64()),
        ("is_bold", pa.bool_()), ("is_italic", pa.bool_()), ("items", pa.list_(item)), ("x", pa.float64()),
    ])
    schema = ", ".join(f"{c} {keys[c]}" for c in PAGE) + (
        ", y double, font_size double, is_bold boolean, is_italic boolean, items array<struct<x:double,item_no:long,str:string,font_name:string>>, x double"
    )
    return map_pages(base, page_lines, schema, arrow)


def line_text(items: Column) -> Column:
    return squeeze(F.array_join(F.transform(items, lambda i: i["str"]), " "))


def number_lines(lines: DataFrame) -> DataFrame:
    """line_no from the top of the page."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc("y"))
    return lines.withColumn("line_no", F.row_number().over(w).cast("long"))


def heading_level(lines: DataFrame) -> DataFrame:
    """0 for body text, 1 to 3 for headings, from size, weight and length."""
    # a page's lines are few and are needed together next, so a page window serves both
    mean = F.avg("font_size").over(Window.partitionBy(*PAGE))
    # the text first: items that nobody reads after it stay out of the window's exchange
    df = lines.withColumn("text", line_text(F.col("items"))).withColumn("_mean", mean)
    return df.withColumn("heading_level", level_of(F.col("text"), F.col("font_size") / F.col("_mean"), F.col("is_bold"))).drop("_mean")


#: Lines of fewer characters are short.
SHORT = 80


def level_of(text: Column, r: Column, bold: Column) -> Column:
    """Heading level of a line whose font size is ``r`` times the page's mean."""
    n = F.length(text)
    short = n < SHORT
    open_end = ~text.rlike(r"[.!?:;,]\z")
    return (
        F.when(text == "", 0)
        .when((r >= 1.8) | ((r >= 1.4) & bold & short), 1)
        .when((r >= 1.4) | ((r >= 1.2) & bold & short & open_end), 2)
        .when((r >= 1.15) & short & open_end, 3)
        .when(bold & open_end & (n < 50), 3)
        .otherwise(0)
    )


def squeezed(strs: pa.Array) -> pa.Array:
    """What each item adds to its line's text: single blanks within, none around."""
    spaced = pc.fill_null(pc.match_substring_regex(strs, f"[{BLANK}]"), False)
    if not pc.any(spaced).as_py():
        return strs
    parts = [re.sub(f"[{BLANK}]+", " ", s).strip(" ") for s in strs.filter(spaced).to_pylist()]
    return pc.replace_with_mask(strs, spaced, pa.array(parts, strs.type))


#: What is kept of the items of a page at one y: the first item's number, the largest font size, bold (-1 unknown), the length of their
#: squeezed texts and how many of them are not empty; the last one of those, if the line may be short.
AT_Y = (("y", "double"), ("first", "long"), ("fs", "double"), ("bold", "int"), ("size", "long"), ("parts", "long"), ("x", "double"), ("item_no", "long"), ("str", "string"))


def last_of(group: np.ndarray, x: np.ndarray, nos: np.ndarray, strs: pa.Array, at: np.ndarray) -> np.ndarray:
    """The last one of the places ``at`` in each group, in rising order of the groups."""
    order = ordered(strs.take(pa.array(at)).to_pylist(), nos[at], x[at], group[at])
    of = group[at][order]
    return at[order[np.r_[of[1:] != of[:-1], True][: len(of)]]]


def at_each_y(items: DataFrame) -> DataFrame:
    """doc_id, page_no and ``AT_Y``: the items of a page at one y that follow one another, in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            page = np.cumsum(changes(b.column(0)) | changes(b.column(1)))
            y, x, no, bold = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "item_no", "bold"))
            by_y = np.lexsort((y, page))
            p, v = page[by_y], y[by_y]
            new = np.r_[True, (p[1:] != p[:-1]) | (v[1:] != v[:-1])]
            start, row = np.flatnonzero(new), np.empty(len(new), dtype=np.int64)
            row[by_y] = np.cumsum(new) - 1
            strs = b.column("str")
            length = pc.fill_null(pc.utf8_length(squeezed(strs)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            fs = pc.fill_null(b.column("fs"), -np.inf).to_numpy(zero_copy_only=False)
            size, parts = (np.add.reduceat(c[by_y], start) for c in (length, (length > 0).astype(np.int64)))
            last = last_of(row, x, no, strs, np.flatnonzero((length > 0) & (size + parts - 1 <= SHORT)[row]))
            end = np.full(len(start), -1)
            end[row[last]] = last
            ends = pa.array(end, mask=end < 0)
            cols = [v[start], np.minimum.reduceat(no[by_y], start), np.maximum.reduceat(fs[by_y], start), np.maximum.reduceat(bold[by_y], start), size, parts]
            lead = pa.array(by_y[start])
            cols = [b.column(0).take(lead), b.column(1).take(lead), *map(pa.array, cols), *(b.column(c).take(ends) for c in ("x", "item_no", "str"))]
            yield pa.RecordBatch.from_arrays(cols, names=[*PAGE, *(c for c, _ in AT_Y)])

    base = line_items(items)
    bold = F.lower("font_name").rlike("bold|heavy|black")
    slim = base.select(*PAGE, "y", "x", "item_no", "str", "fs", F.when(bold, 1).when(~bold, 0).otherwise(-1).alias("bold"))
    keys = dict(base.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"{c} {keys[c]}" for c in PAGE), *(f"{c} {t}" for c, t in AT_Y)]))


def item_headings(items: DataFrame) -> DataFrame:
    """doc_id, page_no, y and heading_level of each line: ``heading_level`` of ``group_lines``, without texts or lists of items.

    A level depends on a line's length, its end, its size and its weight, so items at one y become one row before the one exchange."""
    rows = at_each_y(items)

    def lines(docs, nos, n, y, first, fs, bold, size, parts, x, no, strs) -> pa.RecordBatch:
        page = np.repeat(np.arange(len(n) - 1), np.diff(n))
        y, first, fs, bold, size, parts, x, no = (c.to_numpy(zero_copy_only=False) for c in (y, first, fs, bold, size, parts, x, pc.fill_null(no, 0)))
        of, leaders = first_fit(page, y, first)
        of_page = np.empty(len(leaders), dtype=np.int64)
        of_page[of] = page
        by_line = np.argsort(of, kind="stable")
        start = np.searchsorted(of[by_line], np.arange(len(leaders)))
        fs, bold = (np.maximum.reduceat(c[by_line], start) for c in (fs, bold))
        size, parts = (np.add.reduceat(c[by_line], start) for c in (size, parts))
        length = size + np.maximum(parts - 1, 0)
        # long lines have the same level whatever their end is
        texts = np.where(length > SHORT, "x" * (SHORT + 1), "").astype(object)
        last = last_of(of, x, no, strs, np.flatnonzero(strs.is_valid().to_numpy(zero_copy_only=False) & (length <= SHORT)[of]))
        ends = squeezed(strs.take(pa.array(last))).to_pylist()
        for line, end in zip(of[last].tolist(), ends, strict=True):
            texts[line] = end.rjust(length[line], "x")
        unsized = np.isneginf(fs)
        of_sized = of_page[~unsized]
        sized = np.bincount(of_sized, minlength=len(n) - 1)
        mean = np.bincount(of_sized, fs[~unsized], len(n) - 1) / np.maximum(sized, 1)
        lead = pa.array(of_page)
        cols = [pa.array(leaders), pa.array(fs, mask=unsized), pa.array(mean[of_page], mask=(sized == 0)[of_page]), pa.array(bold > 0, mask=bold < 0), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([docs.take(lead), nos.take(lead), *cols], names=[*PAGE, "y", "font_size", "mean", "is_bold", "stand_in"])

    keys = dict(rows.dtypes)
    # stand_in: a text of the line's length (or not short either) with its end
    found = map_parts(rows, lines, ", ".join(f"{c} {keys[c]}" for c in PAGE) + ", y double, font_size double, mean double, is_bold boolean, stand_in string")
    return found.select(*PAGE, "y", level_of(F.col("stand_in"), F.col("font_size") / F.col("mean"), F.col("is_bold")).alias("heading_level"))


# List marks, numbered entries, addresses.
BULLET, NUMBERED, URL = r"^[•●○◦▪▸►\-*]\s+", r"^(\d+)[.)]\s+(.*)$", r"(https?://\S+)"
# Lines that show the columns of a table, items and columns it needs, gap between columns and
# reach of a column (points).
SAMPLE_LINES, SAMPLE_ITEMS, MIN_COLUMNS, COLUMN_GAP, COLUMN_REACH = 5, 6, 3, 15.0, 40.0


def column_centres(xs: list[np.ndarray]) -> np.ndarray:
    """Centres of the columns that a few lines share; empty if they form no table."""
    sample = np.sort(np.concatenate(xs))
    if len(sample) < SAMPLE_ITEMS:
        return np.empty(0)
    ends = np.concatenate(([0], np.flatnonzero(sample[1:] - sample[:-1] >= COLUMN_GAP) + 1, [len(sample)]))
    size = ends[1:] - ends[:-1]
    first, size = ends[:-1][size > 1], size[size > 1]
    if len(first) < MIN_COLUMNS:
        return np.empty(0)
    # sums of a few values are taken for all columns at once, in the order that a mean adds them
    sums = sample[first]
    for k in range(1, min(int(size.max()), FEW)):
        more = size > k
        sums[more] += sample[first[more] + k]
    centres = sums / size
    for c in np.flatnonzero(size >= FEW).tolist():
        centres[c] = sample[first[c] : first[c] + size[c]].mean()
    return centres


#: Numpy adds up fewer values than these one after the other.
FEW = 8


def nearest_column(xs: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest column (the left one on equal distance), -1 where none is in reach."""
    if centres[-1] != centres[-1]:
        # a place that is no number makes the last column none, and nothing is nearest
        return np.full(len(xs), -1)
    right = np.minimum(centres.searchsorted(xs), len(centres) - 1)
    if (centres[right] == xs).all():
        return right
    left = np.maximum(right - 1, 0)
    away_left, away_right = np.abs(xs - centres[left]), np.abs(xs - centres[right])
    nearest = np.where(away_left <= away_right, left, right)
    nearest[~(np.minimum(away_left, away_right) < COLUMN_REACH)] = -1
    return nearest


def line_cells(xs: np.ndarray, texts: list[str | None], centres: np.ndarray) -> list[str]:
    """Texts of a line under their nearest column."""
    nearest = nearest_column(xs, centres)
    n = len(nearest)
    if n and nearest[0] == 0 and nearest[-1] == n - 1 and (nearest[1:] > nearest[:-1]).all():
        # one text for each of the first columns
        return [*[t.strip() if t else "" for t in texts], *[""] * (len(centres) - n)]
    cells: dict[int, list[str]] = {}
    for c, t in zip(nearest.tolist(), texts):
        if t and c >= 0:
            cells.setdefault(c, []).append(t)
    return [" ".join(cells[c]).strip() if c in cells else "" for c in range(len(centres))]


def page_tables(xs: list[np.ndarray], texts: list[np.ndarray]) -> list[dict]:
    """Tables of a page as (first line, last line, Markdown), from the top, however long.

    A table takes its columns from its first lines and goes on until a line has
    nothing under them.
    """
    found, at = [], 0
    while at < len(xs):
        centres = column_centres(xs[at : at + SAMPLE_LINES])
        rows: list[tuple[int, list[str]]] = []
        for i in range(at, len(xs) if len(centres) else at):
            cells = line_cells(xs[i], texts[i], centres)
            if any(cells):
                rows.append((i, cells))
            elif len(rows) > 1 or i >= at + SAMPLE_LINES:
                break
        if len(rows) < 2:
            at += 1
            continue
        shown = ["| " + " | ".join(cells) + " |" for _, cells in rows]
        rule = "| " + " | ".join(["---"] * len(centres)) + " |"
        last = rows[-1][0]
        found.append({"first": at, "last": last, "text": "\n".join([shown[0], rule, *shown[1:]])})
        at = last + 1
    return found


def places(lists: pa.Array) -> np.ndarray:
    """Where the elements of each list begin, and the last one's end."""
    return np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]


def tables_of(xs: Column, texts: Column) -> Column:
    """page_tables of a row's lines, as array<struct<first,last,text>>."""

    @F.arrow_udf("array<struct<first:int,last:int,text:string>>")
    def found(xs: pa.Array, texts: pa.Array) -> pa.Array:
        lines, words = xs.flatten(), texts.flatten()
        return tables_in(places(xs), places(lines), lines.flatten().to_numpy(zero_copy_only=False), words.flatten().to_pylist())

    return found(xs, texts)


TABLE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("text", pa.string())])


def tables_in(pages: np.ndarray, lines: np.ndarray, xs: np.ndarray, texts: list) -> pa.Array:
    """page_tables of each page, from the places where its lines begin, and their items'."""
    cuts, ends = lines.tolist(), pages.tolist()
    found = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        at = [slice(cuts[k], cuts[k + 1]) for k in range(a, b)]
        found.append(page_tables([xs[k] for k in at], [texts[k] for k in at]))
    return pa.array(found, pa.list_(TABLE))


def line_kinds(line: Column, mean: Column, margin: Column, links: bool) -> Column:
    """The line (y, x, font_size, is_bold, is_italic, font, joined) with its kind (blank, heading, mono, bullet, numbered,
    bold, italic, body), indent and what Markdown shows of it."""

    def kind_of(text: Column) -> Column:
        level = level_of(text, line["font_size"] / mean, line["is_bold"])
        return let(F.struct(text.alias("text"), level.alias("level")), shown_of)

    def shown_of(m: Column) -> Column:
        text = m["text"]
        kind = (
            F.when(text == "", "blank")
            .when(m["level"] > 0, "heading")
            .when(F.lower(line["font"]).rlike("mono|courier"), "mono")
            .when(text.rlike(BULLET), "bullet")
            .when(text.rlike(NUMBERED), "numbered")
            .when(line["is_bold"], "bold")
            .when(line["is_italic"], "italic")
            .otherwise("body")
        )
        indent = F.floor((line["x"] - margin) / mean + 0.5).cast("int")
        return let(F.struct(kind.alias("kind"), indent.alias("indent"), text.alias("text"), m["level"].alias("level")), put)

    def put(m: Column) -> Column:
        text, kind = m["text"], m["kind"]
        shown = F.regexp_replace(text, URL, "[$1]($1)") if links else text
        pad = F.repeat(F.lit("  "), F.least(m["indent"], F.lit(3)))
        as_shown = (
            F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), m["level"]), F.lit(" "), shown))
            .when(kind == "mono", text)
            .when(kind == "bullet", F.concat(pad, F.lit("- "), F.regexp_replace(shown, BULLET, "")))
            .when(kind == "numbered", F.concat(pad, F.regexp_replace(text, NUMBERED, "$1. $2")))
            .when(kind == "bold", F.concat(F.lit("**"), shown, F.lit("**")))
            .when(kind == "italic", F.concat(F.lit("*"), shown, F.lit("*")))
            .otherwise(shown)
        )
        return F.struct(
            (-line["y"]).alias("up"), line["x"].alias("x"), line["y"].alias("y"), kind.alias("kind"), m["indent"].alias("indent"), as_shown.alias("shown"),
            mean.alias("_mean"),
        )

    return let(strip(F.regexp_replace(line["joined"], r"\s+", " ")), kind_of)


def lines_to_markdown(lines: DataFrame, keep_breaks: bool = False, links: bool = False) -> DataFrame:
    """(doc_id, page_no, markdown).

    Every line has a kind; lines of one table, of one code block and of one
    paragraph are one unit each, and units are put together with or without a
    blank line.  A page is one cell, so its lines (not a document's) come
    together: one exchange by (doc_id, page_no), then one ordered fold over the
    lines of each page.  Only table columns are found in Python.
    """
    joined = F.array_join(F.transform("items", lambda i: i["str"]), " ")
    line = F.struct(
        "y", "x", "font_size", "is_bold", "is_italic", F.col("items")[0]["font_name"].alias("font"), joined.alias("joined"),
        F.transform("items", lambda i: i["x"]).alias("xs"), F.transform("items", lambda i: i["str"]).alias("strs"),
    )
    pages = lines.groupBy(*PAGE).agg(F.avg("font_size").alias("_mean"), F.min("x").alias("_margin"), F.collect_list(line).alias("raw"))
    shown = F.transform("raw", lambda r: let(line_kinds(r, F.col("_mean"), F.col("_margin"), links), lambda l: F.struct(l["up"], l["x"], l["y"], l["kind"], l["indent"], l["shown"], l["_mean"], r["xs"], r["strs"])))
    by_page = pages.select(*PAGE, F.array_sort(shown).alias("ls"))
    by_page = by_page.withColumn("tables", tables_of(F.col("ls.xs"), F.col("ls.strs")))
    return by_page.select(*PAGE, tidy(page_text(F.col("ls"), F.col("tables"), keep_breaks)).alias("markdown"))


def items_to_markdown(items: DataFrame, keep_breaks: bool = False, links: bool = False) -> DataFrame:
    """``lines_to_markdown`` of ``group_lines``, from items that come together once.

    Lines and table columns of a page are found in one go, so that neither single items nor the words of lines go through a
    second exchange."""
    base = line_items(items)
    line = pa.struct([
        ("y", pa.float64()), ("x", pa.float64()), ("font_size", pa.float64()), ("is_bold", pa.bool_()), ("is_italic", pa.bool_()), ("font", pa.string()), ("joined", pa.string()),
    ])

    def pages(docs, nos, n, y, x, no, text, font, fs) -> pa.RecordBatch:
        page = np.repeat(np.arange(len(n) - 1), np.diff(n))
        y, x, no, fs = (c.to_numpy(zero_copy_only=False) for c in (y, x, no, fs))
        of, leaders = first_fit(page, y, no)
        of_page = np.empty(len(leaders), dtype=np.int64)
        of_page[of] = page
        # lines from the top of each page
        from_top = np.lexsort((-leaders, of_page))
        place = np.empty(len(leaders), dtype=np.int64)
        place[from_top] = np.arange(len(leaders))
        strs = text.to_numpy(zero_copy_only=False)
        order = ordered(strs, no, x, place[of])
        start = np.searchsorted(place[of][order], np.arange(len(leaders)))
        ends = np.r_[start, len(order)]
        names = font.dictionary_encode()
        code = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)[order]
        styles = np.array([*map(font_styles, names.dictionary.to_pylist()), (False, False)])
        unnamed = ~np.logical_or.reduceat(code >= 0, start)
        bold, italic = (pa.array(np.logical_or.reduceat(styles[code, k], start), mask=unnamed) for k in (0, 1))
        known = text.take(pa.array(order))
        cuts = ends
        if known.null_count:
            cuts = np.r_[0, np.cumsum(known.is_valid().to_numpy(zero_copy_only=False))][ends]
            known = known.drop_null()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), known), " ")
        lead = pa.array(order[start])
        at = np.searchsorted(of_page[from_top], np.arange(len(n)))
        fields = [pa.array(leaders[from_top]), pa.array(x[order[start]]), pa.array(np.maximum.reduceat(fs[order], start)), bold, italic, font.take(lead), joined]
        lines = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(line)))
        return pa.RecordBatch.from_arrays([docs, nos, lines, tables_in(at, ends, x[order], strs[order].tolist())], names=[*PAGE, "raw", "tables"])

    keys = dict(base.dtypes)
    schema = ", ".join(f"{c} {keys[c]}" for c in PAGE) + (
        ", raw array<struct<y:double,x:double,font_size:double,is_bold:boolean,is_italic:boolean,font:string,joined:string>>"
        ", tables array<struct<first:int,last:int,text:string>>"
    )
    found = map_parts(base, pages, schema)
    total = F.aggregate(F.col("raw.font_size"), F.lit(0.0), lambda a, v: a + v)
    found = found.select(*PAGE, "raw", "tables", (total / F.size("raw")).alias("_mean"), F.array_min("raw.x").alias("_margin"))
    shown = F.transform("raw", lambda r: line_kinds(r, F.col("_mean"), F.col("_margin"), links))
    return found.select(*PAGE, tidy(page_text(shown, F.col("tables"), keep_breaks)).alias("markdown"))


def tidy(text: Column) -> Column:
    return strip(F.regexp_replace(text, r" +\n", "\n"))


_PAGE_STATE = "struct<last:string,before:string,y:double,indent:int,first:int,open:boolean,out:array<string>>"


def page_text(lines: Column, tables: Column, keep_breaks: bool) -> Column:
    """Markdown of a page by one fold over its lines, from the top.

    The state holds the kind of the unit at hand and of the line before, where
    that line stood, whether its paragraph can take more lines up, and the
    pieces put out so far.
    """

    def shown_line(line: Column, i: Column) -> Column:
        def as_row(t: Column) -> Column:
            return F.struct(
                F.when(t.isNotNull(), "table").otherwise(line["kind"]).alias("kind"), F.when(t.isNotNull(), t["text"]).otherwise(line["shown"]).alias("shown"),
                line["y"].alias("y"), line["indent"].alias("indent"), line["_mean"].alias("mean"), t["first"].alias("first"),
            )

        return let(F.get(F.filter(tables, lambda t: i.between(t["first"], t["last"])), 0), as_row)

    def step(a: Column, line: Column) -> Column:
        kind, shown = line["kind"], line["shown"]
        # a body line may go on with the running text of the line before
        close = (F.abs(a["y"] - line["y"]) < line["mean"] * 1.8) & (F.abs(a["indent"] - line["indent"]) <= 1)
        flows = F.lit(not keep_breaks) & (kind == "body") & a["before"].isin("body", "bold", "italic") & close

        def joined(m: Column) -> Column:
            same = F.when(kind == "table", (a["before"] == "table") & (a["first"] == line["first"])).when(kind == "mono", a["before"] == "mono").otherwise(m["flows"] & a["open"])
            # lines that look like list entries take nothing up: a paragraph begins at the first line of its run that does not
            # (as a table's text does; one anchor before all of them ends the search at once)
            loose = (kind != "table") & ~shown.rlike(r"^(?:\s*-|\s*\d+\.|[#|])")
            return F.struct(F.coalesce(same, F.lit(False)).alias("same"), F.when(m["flows"], a["open"] | loose).otherwise(loose).alias("open"))

        def put_out(m: Column) -> Column:
            apart = kind.isin("heading", "table", "mono") | a["last"].isin("heading", "table", "blank") | ((a["last"] == "mono") & (kind == "body"))
            more = F.when(kind == "table", "").when(kind == "mono", F.concat(F.lit("\n"), shown)).otherwise(F.concat(F.lit(" "), shown))
            begun = F.when(kind == "blank", "").otherwise(F.concat(F.when(a["last"].isNull(), "").when(apart, "\n\n").otherwise("\n"), F.when(kind == "mono", "```\n").otherwise(""), shown))
            ended = F.when(a["last"] == "mono", "\n```").otherwise("")
            return F.struct(
                F.when(m["same"], a["last"]).otherwise(kind).alias("last"), kind.alias("before"), line["y"].alias("y"), line["indent"].alias("indent"),
                line["first"].alias("first"), m["open"].alias("open"), F.concat(a["out"], F.array(F.when(m["same"], more).otherwise(F.concat(ended, begun)))).alias("out"),
            ).cast(_PAGE_STATE)

        return let(let(F.struct(F.coalesce(flows, F.lit(False)).alias("flows")), joined), put_out)

    start = F.from_json(F.lit('{"out": []}'), _PAGE_STATE)
    end = lambda a: F.concat(F.array_join(a["out"], ""), F.when(a["last"] == "mono", "\n```").otherwise(""))
    return F.aggregate(F.transform(lines, shown_line), start, step, end)
