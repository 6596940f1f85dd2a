"""Imposition and page geometry as column arithmetic on a page manifest.

A manifest row is (doc_id, page_no, width_pt, height_pt, rotation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.pagespec import literal_covers
from quirework.functions.units import half_up, orientation, standard_size, to_inches, to_mm
from quirework.operators.prefix import number_rows, page_block, running, with_totals

# Sheet sizes in points.
SHEETS = {
    "A4": (595.28, 841.89),
    "Letter": (612.0, 792.0),
    "Legal": (612.0, 1008.0),
    "A3": (841.89, 1190.55),
    "Tabloid": (792.0, 1224.0),
}
# Outer margin and gutter of sheets with margins.
MARGIN, GUTTER = 36.0, 10.0

PAGE = ["doc_id", "page_no"]


def _size() -> tuple[Column, Column]:
    return F.col("width_pt"), F.col("height_pt")


def page_dimensions(pages: DataFrame) -> DataFrame:
    """Size in points, inches and millimetres, orientation, standard name."""
    W, H = _size()
    return pages.select(
        *PAGE,
        half_up(W, 2).alias("width_pt"),
        half_up(H, 2).alias("height_pt"),
        to_inches(W).alias("width_in"),
        to_inches(H).alias("height_in"),
        to_mm(W).alias("width_mm"),
        to_mm(H).alias("height_mm"),
        orientation(W, H).alias("orientation"),
        standard_size(W, H).alias("standard_size"),
    )


def size_key() -> Column:
    W, H = _size()
    return F.concat(half_up(W).cast("string"), F.lit("x"), half_up(H).cast("string"))


def page_size_summary(pages: DataFrame) -> DataFrame:
    """Pages per size in each document, and whether all pages are alike.

    The page list itself comes from ``pages_of_size``: one row per page.
    """
    per_size = pages.groupBy("doc_id", size_key().alias("size_key")).agg(
        F.count("*").alias("n_pages"), F.min("page_no").alias("first_page")
    )
    sizes = per_size.groupBy("doc_id").agg((F.count("*") == 1).alias("uniform"))
    return per_size.join(sizes, "doc_id")


def pages_of_size(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", size_key().alias("size_key"), "page_no")


def _sheet(size: str, landscape: Column) -> tuple[Column, Column]:
    w, h = SHEETS[size]
    short, long = min(w, h), max(w, h)
    return (
        F.when(landscape, F.lit(long)).otherwise(F.lit(short)),
        F.when(landscape, F.lit(short)).otherwise(F.lit(long)),
    )


def _fit(cell_x: Column, cell_y: Column, cell_w: Column, cell_h: Column, w: Column, h: Column) -> dict[str, Column]:
    """Scale to fit a cell and centre inside it."""
    s = F.least(cell_w / w, cell_h / h)
    return {
        "scale": s,
        "x": cell_x + (cell_w - w * s) / 2,
        "y": cell_y + (cell_h - h * s) / 2,
        "out_w": w * s,
        "out_h": h * s,
    }


N_UP_GRIDS = {2: (2, 1), 4: (2, 2), 9: (3, 3), 16: (4, 4)}


def n_up(
    pages: DataFrame,
    n: int = 4,
    size: str = "A4",
    orient: str = "auto",
    margins: bool = True,
    vertical: bool = False,
    grid: tuple[int, int] | None = None,
) -> DataFrame:
    """Place ``n`` pages on a sheet, row by row from the top.

    ``grid`` (columns, rows; each 1..10, others are refused) replaces ``n``.  ``auto`` turns the sheet when page 1
    is landscape and the grid is wider than tall; only that choice needs a join,
    on the first pages.
    """
    W, H = _size()
    if grid:
        cols, rows = grid
        if not (1 <= cols <= 10 and 1 <= rows <= 10):
            raise ValueError(f"grid {cols} x {rows} is not within 1 x 1 and 10 x 10")
    else:
        cols, rows = N_UP_GRIDS.get(n, (2, 2))
        if vertical and n == 2:
            cols, rows = rows, cols
    df = pages
    if orient == "auto":
        if cols > rows:
            first = pages.filter("page_no = 1").select("doc_id", (W > H).alias("_land"))
            df = pages.join(first, "doc_id", "left")
        else:
            df = pages.withColumn("_land", F.lit(False))
    else:
        df = pages.withColumn("_land", F.lit(orient == "landscape"))
    sw, sh = _sheet(size, F.coalesce("_land", F.lit(False)))
    m, g = (MARGIN, GUTTER) if margins else (0.0, 0.0)
    cw = (sw - 2 * m - g * (cols - 1)) / cols
    ch = (sh - 2 * m - g * (rows - 1)) / rows
    k = cols * rows
    j = F.pmod(F.col("page_no") - 1, F.lit(k))
    row, col = F.floor(j / F.lit(cols)), F.pmod(j, F.lit(cols))
    placed = _fit(m + col * (cw + g), sh - m - (row + 1) * ch - row * g, cw, ch, W, H)
    return df.select(
        *PAGE,
        (F.floor((F.col("page_no") - 1) / F.lit(k)) + 1).cast("long").alias("sheet_no"),
        row.cast("long").alias("row"),
        col.cast("long").alias("col"),
        sw.alias("sheet_w"),
        sh.alias("sheet_h"),
        *[c.alias(nm) for nm, c in placed.items()],
    )


def booklet(
    pages: DataFrame, grid: tuple[int, int] = (1, 2), size: str = "Letter", orient: str = "auto", padding: float = 10.0
) -> DataFrame:
    """Sheet side, slot and position of every page; blank slots have no row.

    ``grid`` is (rows, columns).  1 x 2 is saddle-stitch order, written as the
    inverse map page -> (side, slot), so no slot table is generated.
    """
    W, H = _size()
    rows, cols = grid
    stitched = (rows, cols) == (1, 2)
    df = with_totals(pages, ["doc_id"])
    p = F.col("page_no")
    if stitched:
        padded = F.ceil(F.col("total_pages") / 4) * 4
        # first half: odd pages sit right on front sides, even pages left on backs;
        # second half mirrors it, counted from the padded end
        from_end = padded - p
        early = p <= padded / 2
        leaf = F.when(early, F.floor((p - 1) / 2)).otherwise(F.floor(from_end / 2))
        front = F.when(early, p % 2 == 1).otherwise(from_end % 2 == 0)
        side = leaf * 2 + F.when(front, 0).otherwise(1)
        slot = F.when(early, F.when(front, 1).otherwise(0)).otherwise(F.when(front, 0).otherwise(1))
    else:
        k = rows * cols
        side, slot = F.floor((p - 1) / F.lit(k)), F.pmod(p - 1, F.lit(k))
    landscape = F.lit(stitched if orient == "auto" else orient == "landscape")
    sw, sh = _sheet(size, landscape)
    cw, ch = sw / cols, sh / rows
    r, c = F.floor(slot / F.lit(cols)), F.pmod(slot, F.lit(cols))
    placed = _fit(c * cw + padding, sh - (r + 1) * ch + padding, cw - 2 * padding, ch - 2 * padding, W, H)
    return df.select(
        *PAGE, (side + 1).cast("long").alias("side_no"), slot.cast("long").alias("slot"),
        *[v.alias(k2) for k2, v in placed.items()],
    )


# Fixed values: (columns, rows) of each way to divide a page.
DIVISIONS = {"vertical": (2, 1), "horizontal": (1, 2), "grid-2x2": (2, 2), "grid-3x3": (3, 3)}


def _tiles(pages: DataFrame, cols: int, rows: int) -> DataFrame:
    n = F.explode(F.sequence(F.lit(0), F.lit(cols * rows - 1)))
    return pages.withColumn("_t", n).withColumns(
        {"row": F.floor(F.col("_t") / F.lit(cols)).cast("long"), "col": F.pmod("_t", F.lit(cols)).cast("long")}
    )


def divide(pages: DataFrame, kind: str = "grid-2x2") -> DataFrame:
    """Cut pages into equal boxes in reading order; output numbers are arithmetic."""
    W, H = _size()
    cols, rows = DIVISIONS[kind]
    w, h = W / cols, H / rows
    return _tiles(pages, cols, rows).select(
        "doc_id",
        ((F.col("page_no") - 1) * (cols * rows) + F.col("_t") + 1).cast("long").alias("page_no"),
        F.col("page_no").alias("source_page"),
        (F.col("col") * w).alias("box_x"),
        (H - (F.col("row") + 1) * h).alias("box_y"),
        w.alias("box_w"),
        h.alias("box_h"),
    )


def posterize(
    pages: DataFrame, rows: int = 2, cols: int = 2, overlap: float = 0.0, mode: str = "fit",
    size: str = "A4", orient: str = "auto", page_range: str = "",
) -> DataFrame:
    """Enlarge page tiles to full sheets; tiles overlap, but not beyond the page.

    A tile's origin moves down by the overlap on every row but the first and
    left on every column but the first, its extent grows on inner edges.
    """
    W, H = _size()
    picked = pages.filter(literal_covers(page_range, F.col("page_no"), "tables"))
    t = _tiles(picked, cols, rows)
    r, c = F.col("row"), F.col("col")
    inner = lambda cond: F.when(cond, F.lit(float(overlap))).otherwise(0.0)
    tw, th = W / cols, H / rows
    sx = c * tw - inner(c > 0)
    sy = H - (r + 1) * th - inner(r > 0)
    ew = tw + inner(c > 0) + inner(c < cols - 1)
    eh = th + inner(r > 0) + inner(r < rows - 1)
    left, bottom = F.greatest(sx, F.lit(0.0)), F.greatest(sy, F.lit(0.0))
    right, top = F.least(sx + ew, W), F.least(sy + eh, H)
    land = (W > H) if orient == "auto" else F.lit(orient == "landscape")
    pw, ph = _sheet(size, land)
    ax, ay = pw / (right - left), ph / (top - bottom)
    s = F.least(ax, ay) if mode == "fit" else F.greatest(ax, ay)
    return t.select(
        *PAGE, "row", "col",
        left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"),
        s.alias("scale"),
        ((pw - (right - left) * s) / 2).alias("x"),
        ((ph - (top - bottom) * s) / 2).alias("y"),
    )


def grid_combine(
    pages: DataFrame, plan: DataFrame, cols: int = 2, rows: int = 2, size: str = "A4",
    orient: str = "landscape", margins: bool = True, spacing: float = 10.0,
    fill: str = "leave-empty", all_pages: bool = False,
) -> DataFrame:
    """Put pages of several documents on shared sheets.

    ``plan``: bundle_id, file_no, doc_id.  Only page 1 of each file is used
    unless ``all_pages``.  A bundle with fewer items than cells may be filled by
    repeating its items or its last item.
    """
    W, H = _size()
    src = pages if all_pages else pages.filter("page_no = 1")
    items = number_rows(
        src.join(plan, "doc_id"), ["bundle_id"], ["file_no", "page_no"], "item_no", total="_n",
        blocks=[page_block("file_no"), F.col("file_no"), page_block("page_no")],
    )
    k = cols * rows
    i = F.col("item_no")
    one = F.array(i)
    if fill == "repeat":
        copies = F.when(
            F.col("_n") < k, F.filter(F.sequence(i, F.lit(k).cast("long")), lambda v: F.pmod(v - i, F.col("_n")) == 0)
        ).otherwise(one)
    elif fill == "stretch-last":
        copies = F.when((F.col("_n") < k) & (i == F.col("_n")), F.sequence(i, F.lit(k).cast("long"))).otherwise(one)
    else:
        copies = one
    cells = items.withColumn("cell_no", F.explode(copies))
    sw, sh = _sheet(size, F.lit(orient == "landscape"))
    m = MARGIN if margins else 0.0
    cw = (sw - 2 * m - spacing * (cols - 1)) / cols
    ch = (sh - 2 * m - spacing * (rows - 1)) / rows
    j = F.pmod(F.col("cell_no") - 1, F.lit(k))
    r, c = F.floor(j / F.lit(cols)), F.pmod(j, F.lit(cols))
    placed = _fit(m + c * (cw + spacing), sh - m - ch - r * (ch + spacing), cw, ch, W, H)
    return cells.select(
        "bundle_id",
        F.col("cell_no").cast("long").alias("cell_no"),
        (F.floor((F.col("cell_no") - 1) / F.lit(k)) + 1).cast("long").alias("sheet_no"),
        F.col("doc_id").alias("source_doc"),
        F.col("page_no").alias("source_page"),
        *[v.alias(n) for n, v in placed.items()],
    )


def fix_size(
    pages: DataFrame, target: tuple[float, float] = SHEETS["A4"], mode: str = "fit",
    orient: str = "auto", keep_ratio: bool = True,
) -> DataFrame:
    """New page size, scale and offset: fit, fill, stretch or center."""
    W, H = _size()
    tw, th = float(target[0]), float(target[1])
    if orient == "auto":
        swap = (W > H) != F.lit(tw > th)
    else:
        swap = F.lit((orient == "landscape" and tw < th) or (orient == "portrait" and tw > th))
    fw = F.when(swap, F.lit(th)).otherwise(F.lit(tw))
    fh = F.when(swap, F.lit(tw)).otherwise(F.lit(th))
    ax, ay = fw / W, fh / H
    if mode == "center":
        ax = ay = F.lit(1.0)
    elif mode in ("fit", "fill") and keep_ratio:
        ax = ay = F.least(ax, ay) if mode == "fit" else F.greatest(ax, ay)
    zero = mode == "stretch"
    return pages.select(
        *PAGE,
        fw.alias("width_pt"), fh.alias("height_pt"), ax.alias("scale_x"), ay.alias("scale_y"),
        (F.lit(0.0) if zero else (fw - W * ax) / 2).alias("x"),
        (F.lit(0.0) if zero else (fh - H * ay) / 2).alias("y"),
    )


def combine_extent(pages: DataFrame, orient: str = "vertical", spacing: float = 10.0) -> DataFrame:
    """Size of the one page all pages of a document are stitched onto."""
    W, H = _size()
    gaps = (F.count("*") - 1) * F.lit(float(spacing))
    # sums run over thousandths of a point, so partial sums combine exactly
    total = lambda c: F.sum(half_up(c * 1000.0)) / F.lit(1000.0)
    if orient == "horizontal":
        return pages.groupBy("doc_id").agg((total(W) + gaps).alias("width"), F.max(H).alias("height"))
    return pages.groupBy("doc_id").agg(F.max(W).alias("width"), (total(H) + gaps).alias("height"))


def stitch(pages: DataFrame, orient: str = "vertical", spacing: float = 10.0) -> DataFrame:
    """Offset of each page on the stitched page, centred on the short axis."""
    W, H = _size()
    main = W if orient == "horizontal" else H
    step = (half_up(main * 1000.0) + F.lit(int(spacing * 1000))).cast("long")
    moved = running(pages, ["doc_id"], [page_block()], ["page_no"], step, "_before", "_all")
    ext = pages.groupBy("doc_id").agg(F.max(W).alias("_mw"), F.max(H).alias("_mh"))
    before, all_ = F.col("_before") / 1000.0, F.col("_all") / 1000.0
    df = moved.join(ext, "doc_id")
    if orient == "horizontal":
        return df.select(*PAGE, before.alias("x"), ((F.col("_mh") - H) / 2).alias("y"))
    top = all_ - float(spacing)
    return df.select(*PAGE, ((F.col("_mw") - W) / 2).alias("x"), (top - before - H).alias("y"))


def watermark_plan(pages: DataFrame, mode: str = "all", listed: tuple[int, ...] = ()) -> DataFrame:
    """Pages that get a watermark."""
    from quirework.operators.pages import filter_parity

    return filter_parity(pages, mode, listed).select(*PAGE)
