"""Queries of imposition and page geometry over the page manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import units as U
from quirework.operators import geometry as G
from quirework.plans import sqlviews as S
from quirework.plans import views as V
from quirework.plans.registry import query, r6

FIT = ("scale", "x", "y", "out_w", "out_h")


def _fit_sql(cx: str, cy: str, cw: str, ch: str) -> str:
    s = f"least(({cw}) / width_pt, ({ch}) / height_pt)"
    return (
        f"round({s}, 6) AS scale, round(({cx}) + (({cw}) - width_pt * {s}) / 2, 6) AS x, round(({cy}) + (({ch}) - height_pt * {s}) / 2, 6) AS y, "
        f"round(width_pt * {s}, 6) AS out_w, round(height_pt * {s}, 6) AS out_h"
    )


_MM = "width_pt / 72.0::DOUBLE * 25.4::DOUBLE"


@query(f"""
WITH {S.MANIFEST}, n(i, name, sw, sh) AS (VALUES (1,'Letter',612,792),(2,'Legal',612,1008),(3,'Tabloid',792,1224),(4,'A0',2384,3370),(5,'A1',1684,2384),(6,'A2',1191,1684),(7,'A3',842,1191),(8,'A4',595,842),(9,'A5',420,595),(10,'A6',298,420),(11,'B4',709,1001),(12,'B5',499,709),(13,'Executive',522,756)),
s AS (SELECT w, h, arg_min(CASE WHEN abs(w - sw) <= 2 AND abs(h - sh) <= 2 THEN name ELSE name || ' (Landscape)' END, i) AS standard_size
  FROM (SELECT DISTINCT width_pt AS w, height_pt AS h FROM manifest), n WHERE (abs(w - sw) <= 2 AND abs(h - sh) <= 2) OR (abs(w - sh) <= 2 AND abs(h - sw) <= 2) GROUP BY ALL)
SELECT doc_id, page_no, width_pt, height_pt, floor(width_pt / 72.0::DOUBLE * 100 + 0.5) / 100 AS width_in, floor(height_pt / 72.0::DOUBLE * 100 + 0.5) / 100 AS height_in,
  floor({_MM} * 10 + 0.5) / 10 AS width_mm, floor({_MM.replace('width', 'height')} * 10 + 0.5) / 10 AS height_mm,
  CASE WHEN abs(width_pt - height_pt) < 1 THEN 'square' WHEN width_pt > height_pt THEN 'landscape' ELSE 'portrait' END AS orientation, standard_size
FROM manifest LEFT JOIN s ON w = width_pt AND h = height_pt
""")
def page_dimensions(spark, sf):
    return G.page_dimensions(V.manifest(spark, sf))


_SIZE_KEY = "CAST(floor(width_pt + 0.5) AS BIGINT) || 'x' || CAST(floor(height_pt + 0.5) AS BIGINT)"


@query(f"""
WITH {S.MANIFEST}, k AS (SELECT doc_id, {_SIZE_KEY} AS size_key, count(*) AS n_pages, min(page_no) AS first_page FROM manifest GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY doc_id) = 1 AS uniform FROM k
""")
def page_size_summary(spark, sf):
    return G.page_size_summary(V.manifest(spark, sf))


@query(f"WITH {S.MANIFEST} SELECT doc_id, {_SIZE_KEY} AS size_key, page_no FROM manifest")
def pages_of_size(spark, sf):
    return G.pages_of_size(V.manifest(spark, sf))


@query(f"""
WITH {S.MANIFEST}, f AS (SELECT doc_id, width_pt > height_pt AS land FROM manifest WHERE page_no = 1),
g AS (SELECT m.*, CASE WHEN land THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS sw, CASE WHEN land THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS sh, (page_no - 1) % 2 AS c FROM manifest m JOIN f USING (doc_id)),
h AS (SELECT *, (sw - 72 - 10) / 2 AS cw, sh - 72 AS ch FROM g)
SELECT doc_id, page_no, (page_no - 1) // 2 + 1 AS sheet_no, 0 AS "row", c AS col, sw AS sheet_w, sh AS sheet_h, {_fit_sql("36 + c * (cw + 10)", "sh - 36 - ch", "cw", "ch")} FROM h
""")
def n_up_two(spark, sf):
    out = G.n_up(V.manifest(spark, sf), 2)
    return out.select("doc_id", "page_no", "sheet_no", "row", "col", "sheet_w", "sheet_h", *[r6(c) for c in FIT])


@query(f"""
WITH {S.MANIFEST}, g AS (SELECT *, 612.0::DOUBLE AS sw, 792.0::DOUBLE AS sh, (page_no - 1) % 6 AS j FROM manifest),
h AS (SELECT *, j // 2 AS r, j % 2 AS c, sw / 2 AS cw, sh / 3 AS ch FROM g)
SELECT doc_id, page_no, (page_no - 1) // 6 + 1 AS sheet_no, r AS "row", c AS col, sw AS sheet_w, sh AS sheet_h, {_fit_sql("c * cw", "sh - (r + 1) * ch", "cw", "ch")} FROM h
""")
def n_up_custom_grid(spark, sf):
    out = G.n_up(V.manifest(spark, sf), size="Letter", orient="portrait", margins=False, grid=(2, 3))
    return out.select("doc_id", "page_no", "sheet_no", "row", "col", "sheet_w", "sheet_h", *[r6(c) for c in FIT])


@query(f"""
WITH {S.MANIFEST}, d AS (SELECT doc_id, count(*) AS n, CAST(ceil(count(*) / 4) AS BIGINT) * 4 AS l FROM manifest GROUP BY 1),
s AS (SELECT doc_id, n, l, unnest(range(0, l // 4)) AS p FROM d),
t AS (SELECT doc_id, n, x.side, x.slot, x.pg FROM s, LATERAL (VALUES (2 * p + 1, 0, l - 2 * p), (2 * p + 1, 1, 2 * p + 1), (2 * p + 2, 0, 2 * p + 2), (2 * p + 2, 1, l - 2 * p - 1)) x(side, slot, pg))
SELECT m.doc_id, page_no, side AS side_no, slot, {_fit_sql("slot * 396.0 + 10", "10.0", "376.0", "592.0")} FROM t JOIN manifest m ON m.doc_id = t.doc_id AND m.page_no = t.pg
""")
def booklet(spark, sf):
    return G.booklet(V.manifest(spark, sf)).select("doc_id", "page_no", "side_no", "slot", *[r6(c) for c in FIT])


@query(f"""
WITH {S.MANIFEST}, g AS (SELECT *, (page_no - 1) // 4 + 1 AS side_no, (page_no - 1) % 4 AS slot FROM manifest)
SELECT doc_id, page_no, side_no, slot, {_fit_sql("(slot % 2) * 297.64::DOUBLE + 5", "841.89::DOUBLE - (slot // 2 + 1) * 420.945::DOUBLE + 5", "287.64::DOUBLE", "410.945::DOUBLE")} FROM g
""")
def booklet_grid(spark, sf):
    return G.booklet(V.manifest(spark, sf), (2, 2), "A4", padding=5.0).select("doc_id", "page_no", "side_no", "slot", *[r6(c) for c in FIT])


@query(f"""
WITH {S.MANIFEST}, t AS (SELECT *, unnest(range(0, 9)) AS t FROM manifest)
SELECT doc_id, (page_no - 1) * 9 + t + 1 AS page_no, page_no AS source_page, round((t % 3) * width_pt / 3, 6) AS box_x, round(height_pt - (t // 3 + 1) * (height_pt / 3), 6) AS box_y,
  round(width_pt / 3, 6) AS box_w, round(height_pt / 3, 6) AS box_h FROM t
""")
def divide(spark, sf):
    out = G.divide(V.manifest(spark, sf), "grid-3x3")
    return out.select("doc_id", "page_no", "source_page", *[r6(c) for c in ("box_x", "box_y", "box_w", "box_h")])


@query(f"""
WITH {S.MANIFEST}, t AS (SELECT *, r, c FROM manifest, (VALUES (0), (1)) a(r), (VALUES (0), (1), (2)) b(c)),
b AS (SELECT *, c * width_pt / 3 - CASE WHEN c > 0 THEN 20 ELSE 0 END AS sx, height_pt - (r + 1) * height_pt / 2 - CASE WHEN r > 0 THEN 20 ELSE 0 END AS sy,
  width_pt / 3 + CASE WHEN c > 0 THEN 20 ELSE 0 END + CASE WHEN c < 2 THEN 20 ELSE 0 END AS ew, height_pt / 2 + CASE WHEN r > 0 THEN 20 ELSE 0 END + CASE WHEN r < 1 THEN 20 ELSE 0 END AS eh FROM t),
e AS (SELECT *, greatest(sx, 0) AS l, greatest(sy, 0) AS bt, least(sx + ew, width_pt) AS rt, least(sy + eh, height_pt) AS tp,
  CASE WHEN width_pt > height_pt THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS pw, CASE WHEN width_pt > height_pt THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS ph FROM b),
f AS (SELECT *, greatest(pw / (rt - l), ph / (tp - bt)) AS s FROM e)
SELECT doc_id, page_no, r AS "row", c AS col, round(l, 6) AS "left", round(bt, 6) AS bottom, round(rt, 6) AS "right", round(tp, 6) AS top, round(s, 6) AS scale,
  round((pw - (rt - l) * s) / 2, 6) AS x, round((ph - (tp - bt) * s) / 2, 6) AS y FROM f
""")
def posterize(spark, sf):
    out = G.posterize(V.manifest(spark, sf), 2, 3, 20.0, "fill")
    return out.select("doc_id", "page_no", "row", "col", *[r6(c) for c in ("left", "bottom", "right", "top", "scale", "x", "y")])


@query(f"""
WITH {S.MANIFEST}, p AS (SELECT DISTINCT doc_id, doc_id // 3 AS bundle_id, doc_id % 3 + 1 AS file_no FROM manifest),
i AS (SELECT bundle_id, file_no AS n, count(*) OVER (PARTITION BY bundle_id) AS k, m.* FROM p JOIN manifest m USING (doc_id) WHERE page_no = 1),
c AS (SELECT *, unnest(list_filter(range(1, 7), lambda v: (v - 1) % k + 1 = n)) AS cell_no FROM i),
j AS (SELECT *, (cell_no - 1) // 3 AS r, (cell_no - 1) % 3 AS c, (841.89::DOUBLE - 72 - 16) / 3 AS cw, (595.28::DOUBLE - 72 - 8) / 2 AS ch FROM c)
SELECT bundle_id, cell_no, 1 AS sheet_no, doc_id AS source_doc, page_no AS source_page, {_fit_sql("36 + c * (cw + 8)", "595.28::DOUBLE - 36 - ch - r * (ch + 8)", "cw", "ch")} FROM j
""")
def grid_combine(spark, sf):
    m = V.manifest(spark, sf)
    plan = m.filter("page_no = 1").select(
        F.floor(F.col("doc_id") / F.lit(3)).cast("long").alias("bundle_id"), (F.col("doc_id") % 3 + 1).alias("file_no"), "doc_id"
    )
    out = G.grid_combine(m, plan, 3, 2, spacing=8.0, fill="repeat")
    return out.select("bundle_id", "cell_no", "sheet_no", "source_doc", "source_page", *[r6(c) for c in FIT])


@query(f"""
WITH {S.MANIFEST}, p AS (SELECT DISTINCT doc_id, doc_id // 2 AS bundle_id, doc_id % 2 + 1 AS file_no FROM manifest)
SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY file_no, page_no) AS cell_no, (row_number() OVER (PARTITION BY bundle_id ORDER BY file_no, page_no) - 1) // 4 + 1 AS sheet_no,
  doc_id AS source_doc, page_no AS source_page FROM manifest JOIN p USING (doc_id)
""")
def grid_combine_all_pages(spark, sf):
    m = V.manifest(spark, sf)
    plan = m.filter("page_no = 1").select(
        F.floor(F.col("doc_id") / F.lit(2)).cast("long").alias("bundle_id"), (F.col("doc_id") % 2 + 1).alias("file_no"), "doc_id"
    )
    return G.grid_combine(m, plan, all_pages=True).select("bundle_id", "cell_no", "sheet_no", "source_doc", "source_page")


_FIX = f"""{S.MANIFEST}, f AS (SELECT *, CASE WHEN width_pt > height_pt THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS fw, CASE WHEN width_pt > height_pt THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS fh FROM manifest)"""


@query(f"""
WITH {_FIX}, s AS (
  SELECT 'fit' AS mode, *, least(fw / width_pt, fh / height_pt) AS ax, least(fw / width_pt, fh / height_pt) AS ay FROM f
  UNION ALL SELECT 'fill', *, greatest(fw / width_pt, fh / height_pt), greatest(fw / width_pt, fh / height_pt) FROM f
  UNION ALL SELECT 'stretch', *, fw / width_pt, fh / height_pt FROM f UNION ALL SELECT 'center', *, 1, 1 FROM f)
SELECT mode, doc_id, page_no, fw AS width_pt, fh AS height_pt, round(ax, 6) AS scale_x, round(ay, 6) AS scale_y,
  CASE WHEN mode = 'stretch' THEN 0 ELSE round((fw - width_pt * ax) / 2, 6) END AS x, CASE WHEN mode = 'stretch' THEN 0 ELSE round((fh - height_pt * ay) / 2, 6) END AS y FROM s
""")
def fix_page_size(spark, sf):
    m = V.manifest(spark, sf)
    out = None
    for mode in ("fit", "fill", "stretch", "center"):
        one = G.fix_size(m, mode=mode).select(
            F.lit(mode).alias("mode"), "doc_id", "page_no", "width_pt", "height_pt", *[r6(c) for c in ("scale_x", "scale_y", "x", "y")]
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""
WITH {S.MANIFEST} SELECT 'vertical' AS orient, doc_id, max(width_pt) AS width, round(sum(height_pt) + (count(*) - 1) * 10, 6) AS height FROM manifest GROUP BY 2
UNION ALL SELECT 'horizontal', doc_id, round(sum(width_pt) + (count(*) - 1) * 10, 6), max(height_pt) FROM manifest GROUP BY 2
""")
def combine_extent(spark, sf):
    m = V.manifest(spark, sf)
    cols = [F.col("doc_id"), r6("width"), r6("height")]
    v = G.combine_extent(m, "vertical").select(F.lit("vertical").alias("orient"), *cols)
    return v.unionByName(G.combine_extent(m, "horizontal").select(F.lit("horizontal").alias("orient"), *cols))


@query(f"""
WITH {S.MANIFEST}, w AS (SELECT *, coalesce(sum(width_pt + 10) OVER b, 0) AS bx, coalesce(sum(height_pt + 10) OVER b, 0) AS by_,
  sum(height_pt + 10) OVER d - 10 AS th, max(width_pt) OVER d AS mw, max(height_pt) OVER d AS mh FROM manifest
  WINDOW b AS (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d AS (PARTITION BY doc_id))
SELECT 'vertical' AS orient, doc_id, page_no, round((mw - width_pt) / 2, 6) AS x, round(th - by_ - height_pt, 6) AS y FROM w
UNION ALL SELECT 'horizontal', doc_id, page_no, round(bx, 6), round((mh - height_pt) / 2, 6) FROM w
""")
def stitch_positions(spark, sf):
    m = V.manifest(spark, sf)
    cols = ["doc_id", "page_no", r6("x"), r6("y")]
    v = G.stitch(m, "vertical").select(F.lit("vertical").alias("orient"), *cols)
    return v.unionByName(G.stitch(m, "horizontal").select(F.lit("horizontal").alias("orient"), *cols))


@query(f"WITH {S.MANIFEST} SELECT doc_id, page_no FROM manifest WHERE page_no % 2 = 0")
def watermark_pages(spark, sf):
    return G.watermark_plan(V.manifest(spark, sf), "even")


@query("SELECT o_orderkey, ((o_custkey * 45 - 3000) % 360 + 360) % 360 AS angle FROM orders")
def normalize_angles(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", U.normalize_angle(F.col("o_custkey") * 45 - 3000).alias("angle")
    )
