"""Queries of the page algebra, splitting and labelling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import pagespec
from quirework.operators import pages, paginate, split
from quirework.plans import sqlviews as S
from quirework.plans import views as V
from quirework.plans.registry import query, r6


@query(f"WITH {S.DOC_PAGES} SELECT doc_id, page_no, text FROM doc_pages")
def paginate_text(spark, sf):
    return V.doc_pages(spark, sf)


@query(r"""
WITH w AS (
  SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda p:
    CASE WHEN regexp_matches(p, '\S')
    THEN regexp_extract_all(trim(regexp_replace(p, ' +', ' ', 'g'), ' '), '(.{1,60}|[^ ]+)(?: |$)', 1)
    ELSE [''] END)) AS ls FROM documents),
x AS (SELECT doc_id, ls, unnest(range(0, (greatest(len(ls), 1) - 1) // 39 + 1)) AS i FROM w)
SELECT doc_id, i + 1 AS page_no, array_to_string(ls[i*39+1 : i*39+39], chr(10)) AS text FROM x
""")
def paginate_wrapped(spark, sf):
    return paginate.paginate(V.text_table(spark, sf, "documents", "doc_id", "text"), wrap_at=60)


@query(f"""
WITH {S.DOC_PAGES}
SELECT doc_id, (page_no - 1) // 2 + 1 AS part_no, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM doc_pages GROUP BY ALL
""")
def split_every_two(spark, sf):
    parted = split.split_every(V.doc_pages(spark, sf), 2)
    return parted.groupBy("doc_id", "part_no").agg(
        F.count("*").alias("n_pages"), F.sum(F.length("text")).cast("long").alias("n_chars")
    )


@query(f"""
WITH {S.DOC_PAGES},
t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, ntile(3) OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM doc_pages)
SELECT doc_id, CASE WHEN n < 3 THEN 1 ELSE k END AS part_no, min(page_no) AS start_page, max(page_no) AS end_page, count(*) AS n_pages
FROM t GROUP BY ALL
""")
def split_into_three(spark, sf):
    return split.part_ranges(split.split_n(V.doc_pages(spark, sf), 3))


@query(f"""
WITH {S.DOC_PAGES}
SELECT doc_id, CASE WHEN page_no % 2 = 1 THEN 1 ELSE 2 END AS part_no, count(*) AS n_pages FROM doc_pages GROUP BY ALL
""")
def split_odd_even(spark, sf):
    return split.split_parity(V.doc_pages(spark, sf)).groupBy("doc_id", "part_no").agg(
        F.count("*").alias("n_pages")
    )


def _ranges(spark, sf):
    n = F.col("n_pages")
    two = F.least(n, F.lit(2).cast("long"))
    rows = F.array(
        F.struct(F.lit(1).cast("long").alias("range_no"), F.lit(1).cast("long").alias("start_page"), two.alias("end_page")),
        F.struct(F.lit(2).cast("long").alias("range_no"), two.alias("start_page"), n.alias("end_page")),
        F.struct(F.lit(3).cast("long").alias("range_no"), n.alias("start_page"), n.alias("end_page")),
    )
    return V.page_counts(spark, sf).select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


@query(f"""
WITH {S.DOC_PAGES}, {S.PAGE_COUNTS},
r AS (SELECT doc_id, n.range_no, n.s AS start_page, n.e AS end_page FROM page_counts,
  LATERAL (VALUES (1, 1, least(2, n_pages)), (2, least(2, n_pages), n_pages), (3, n_pages, n_pages)) n(range_no, s, e))
SELECT p.doc_id, r.range_no AS part_no, p.page_no, p.page_no - r.start_page + 1 AS part_page, length(p.text) AS n_chars
FROM doc_pages p JOIN r ON p.doc_id = r.doc_id AND p.page_no BETWEEN r.start_page AND r.end_page
""")
def split_by_ranges(spark, sf):
    out = split.split_by_ranges(V.doc_pages(spark, sf), _ranges(spark, sf))
    return out.select("doc_id", "part_no", "page_no", "part_page", F.length("text").cast("long").alias("n_chars"))


@query(f"""
WITH {S.PAGE_COUNTS},
r AS (SELECT doc_id, n_pages, n.* FROM page_counts, LATERAL (VALUES (1, n_pages - 2, 4), (2, 3, n_pages), (3, 1, 2)) n(range_no, s, e)),
m AS (SELECT doc_id, range_no, CASE
    WHEN s < 1 THEN 'Range ' || range_no || ': Start page must be at least 1.'
    WHEN e < s THEN 'Range ' || range_no || ': End page (' || e || ') cannot be less than start page (' || s || ').'
    WHEN e > n_pages THEN 'Range ' || range_no || ': End page (' || e || ') exceeds total pages (' || n_pages || ').' END AS message FROM r)
SELECT doc_id, arg_min(message, range_no) AS message, 'INVALID_PAGE_RANGE' AS code, 'VALIDATION_ERROR' AS category, true AS recoverable
FROM m WHERE message IS NOT NULL GROUP BY doc_id
""")
def check_ranges(spark, sf):
    n = F.col("n_pages")
    lit = lambda v: F.lit(v).cast("long")
    rows = F.array(
        *[
            F.struct(lit(i).alias("range_no"), s.alias("start_page"), e.alias("end_page"))
            for i, s, e in ((1, n - 2, lit(4)), (2, lit(3), n), (3, lit(1), lit(2)))
        ]
    )
    counts = V.page_counts(spark, sf)
    ranges = counts.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")
    return split.check_ranges(ranges, counts).select("doc_id", "message", "code", "category", "recoverable")


@query(f"""
WITH {S.OUTLINE}, {S.PAGE_COUNTS},
m AS (SELECT doc_id, page_no, arg_max(title, ordinal) AS label, max(n_pages) AS n_pages
      FROM outline JOIN page_counts USING (doc_id) WHERE level = 1 AND page_no BETWEEN 1 AND n_pages GROUP BY ALL),
b AS (SELECT doc_id, page_no AS s, coalesce(lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) - 1, n_pages) AS e, label FROM m
  UNION ALL SELECT doc_id, 1, min(page_no) - 1, 'Introduction' FROM m GROUP BY doc_id HAVING min(page_no) > 1
  UNION ALL SELECT doc_id, 1, n_pages, 'Complete Document' FROM page_counts WHERE doc_id NOT IN (SELECT doc_id FROM m))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS range_no, s AS start_page, e AS end_page, label FROM b
""")
def outline_ranges(spark, sf):
    return split.outline_ranges(V.outline(spark, sf), V.page_counts(spark, sf))


@query(f"""
WITH {S.OUTLINE}, {S.PAGE_COUNTS},
m AS (SELECT DISTINCT doc_id, page_no FROM outline JOIN page_counts USING (doc_id) WHERE level = 1 AND page_no BETWEEN 1 AND n_pages),
s AS (SELECT doc_id, page_no FROM m UNION SELECT doc_id, 1 FROM page_counts),
p AS (SELECT p.doc_id, p.page_no, (SELECT count(*) FROM s WHERE s.doc_id = p.doc_id AND s.page_no <= p.page_no) AS part_no FROM doc_pages p)
SELECT doc_id, part_no, count(*) AS n_pages FROM p GROUP BY ALL
""")
def split_by_outline(spark, sf):
    out = split.split_by_outline(V.outline(spark, sf), V.doc_pages(spark, sf))
    return out.groupBy("doc_id", "part_no").agg(F.count("*").alias("n_pages"))


@query(f"""
WITH {S.DOC_PAGES},
s AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS g FROM doc_pages WHERE contains(text, 'and'))
SELECT doc_id, min(page_no) AS start_page, max(page_no) AS end_page FROM s GROUP BY doc_id, g
""")
def consecutive_ranges(spark, sf):
    sel = V.doc_pages(spark, sf).filter(F.col("text").contains("and")).select("doc_id", "page_no")
    return split.consecutive_ranges(sel)


@query(f"""
WITH {S.DOC_PAGES}, p AS (SELECT doc_id, page_no, lang FROM doc_pages JOIN documents d USING (doc_id))
SELECT 'extract' AS dialect, doc_id, page_no FROM p WHERE (lang = 'en' AND page_no IN (1, 2, 4)) OR (lang = 'de' AND page_no = 2)
UNION ALL SELECT 'tables', doc_id, page_no FROM p WHERE (lang = 'en' AND page_no IN (1, 2, 4)) OR (lang = 'de' AND page_no = 2) OR lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT 'labels', doc_id, page_no FROM p WHERE (lang = 'en' AND page_no IN (1, 2, 4, 7, 8, 9)) OR (lang = 'fr' AND page_no % 2 = 1)
  OR (lang = 'de' AND page_no BETWEEN 1 AND 5) OR lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT 'header', doc_id, page_no FROM p WHERE (lang = 'en' AND page_no IN (1, 2, 4)) OR (lang = 'de' AND page_no = 2) OR lang NOT IN ('en', 'fr', 'de')
""")
def page_spec_dialects(spark, sf):
    p = V.doc_pages(spark, sf).select("doc_id", "page_no").join(V.specs(spark, sf), "doc_id")
    sel = F.array(
        *[
            F.when(pagespec.covers(pagespec.spec_ranges(F.col("spec"), d), F.col("page_no")), F.lit(d))
            for d in ("extract", "tables", "labels", "header")
        ]
    )
    return p.select(F.explode(F.array_compact(sel)).alias("dialect"), "doc_id", "page_no")


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN '1-2,4-4,9-7' WHEN 'de' THEN '2-2,5-1' ELSE '' END AS ranges FROM documents
""")
def parse_split_ranges(spark, sf):
    r = pagespec.spec_ranges(F.col("spec"), "split")
    text = F.array_join(F.transform(r, lambda x: F.concat_ws("-", x["lo"], x["hi"])), ",")
    return V.specs(spark, sf).select("doc_id", text.alias("ranges"))


@query(f"WITH {S.DOC_PAGES} SELECT doc_id, page_no, text FROM doc_pages WHERE page_no IN (1, 2, 4)")
def select_pages(spark, sf):
    return pages.select_pages(V.doc_pages(spark, sf), "1-2,4")


@query(f"""
WITH {S.DOC_PAGES} SELECT doc_id, page_no, length(p.text) AS n_chars FROM doc_pages p JOIN documents d USING (doc_id)
WHERE (lang = 'en' AND page_no IN (1, 2, 4, 7, 8, 9)) OR (lang = 'de' AND page_no BETWEEN 1 AND 5)
  OR lang NOT IN ('en', 'fr', 'de') OR (lang = 'fr' AND page_no % 2 = 1)
""")
def select_pages_by_document(spark, sf):
    out = pages.select_pages_by(V.doc_pages(spark, sf), V.specs(spark, sf), "labels")
    return out.select("doc_id", "page_no", F.length("text").cast("long").alias("n_chars"))


@query(f"""
WITH {S.PAGE_COUNTS} SELECT * FROM (SELECT doc_id, CASE
  WHEN lang = 'fr' OR lang NOT IN ('en', 'fr', 'de') THEN 'No pages specified for extraction.'
  WHEN lang = 'en' AND n_pages < 4 THEN 'Page ' || CASE WHEN n_pages < 2 THEN 2 ELSE 4 END || ' exceeds total pages (' || n_pages || ').'
  WHEN lang = 'de' AND n_pages < 2 THEN 'Page 2 exceeds total pages (' || n_pages || ').'
  END AS message FROM page_counts JOIN documents USING (doc_id)) WHERE message IS NOT NULL
""")
def check_selection(spark, sf):
    return pages.check_selection(V.page_counts(spark, sf), V.specs(spark, sf)).select("doc_id", "message")


@query(f"""
WITH {S.DOC_PAGES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no, text
FROM doc_pages WHERE page_no NOT IN (2, 3, 5)
""")
def delete_pages(spark, sf):
    return pages.delete_pages(V.doc_pages(spark, sf), "2-3,5,3")


@query(f"""
WITH {S.DOC_PAGES} SELECT doc_id, 'Cannot delete all pages.' AS message FROM doc_pages GROUP BY doc_id HAVING max(page_no) <= 2
""")
def delete_all_pages_error(spark, sf):
    return pages.emptied_documents(V.doc_pages(spark, sf), "1-2").select("doc_id", "message")


@query(f"""
WITH {S.DOC_PAGES} SELECT 'odd' AS mode, doc_id, page_no FROM doc_pages WHERE page_no % 2 = 1
UNION ALL SELECT 'even', doc_id, page_no FROM doc_pages WHERE page_no % 2 = 0
UNION ALL SELECT 'custom', doc_id, page_no FROM doc_pages WHERE page_no IN (1, 3)
""")
def filter_parity(spark, sf):
    p = V.doc_pages(spark, sf).select("doc_id", "page_no")
    return pages.concat(
        [
            pages.filter_parity(p, m, x).select(F.lit(m).alias("mode"), "doc_id", "page_no")
            for m, x in (("odd", ()), ("even", ()), ("custom", (1, 3)))
        ]
    )


@query(f"""
WITH {S.DOC_PAGES}, o AS (
  SELECT doc_id, page_no * 2 - 1 AS new_no, page_no FROM doc_pages UNION ALL SELECT doc_id, page_no * 2, page_no + 1 FROM doc_pages)
SELECT o.doc_id, o.new_no AS page_no, o.page_no AS source_page, length(p.text) AS n_chars
FROM o JOIN doc_pages p ON o.doc_id = p.doc_id AND o.page_no = p.page_no
""")
def reorder_pages(spark, sf):
    p = V.doc_pages(spark, sf)
    n = F.col("page_no")
    order = p.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct((n * 2 - 1).alias("new_no"), n.alias("page_no")),
                F.struct((n * 2).alias("new_no"), (n + 1).alias("page_no")),
            )
        ).alias("o"),
    ).select("doc_id", "o.*")
    return pages.reorder_pages(p, order).select(
        "doc_id", "page_no", "source_page", F.length("text").cast("long").alias("n_chars")
    )


@query(f"""
WITH {S.MANIFEST}, a AS (SELECT *, CASE WHEN page_no = 1 THEN -90 WHEN page_no = 2 THEN 30 ELSE 0 END AS a FROM manifest),
b AS (SELECT *, abs(cos(radians(a))) AS c, abs(sin(radians(a))) AS s FROM a)
SELECT doc_id, page_no, CASE WHEN a % 90 = 0 THEN (rotation + a + 360) % 360 ELSE rotation END AS rotation,
  round(CASE WHEN a % 90 = 0 THEN width_pt ELSE width_pt * c + height_pt * s END, 6) AS width_pt,
  round(CASE WHEN a % 90 = 0 THEN height_pt ELSE width_pt * s + height_pt * c END, 6) AS height_pt FROM b
""")
def rotate_pages(spark, sf):
    m = V.manifest(spark, sf)
    turns = m.filter("page_no <= 2").select(
        "doc_id", "page_no", F.when(F.col("page_no") == 1, -90.0).otherwise(30.0).alias("angle")
    )
    return pages.rotate_pages(m, by_page=turns).select(
        "doc_id", "page_no", "rotation", r6("width_pt"), r6("height_pt")
    )


@query(f"WITH {S.MANIFEST} SELECT doc_id, page_no, (rotation + 450) % 360 AS rotation FROM manifest")
def rotate_all(spark, sf):
    return pages.rotate_pages(V.manifest(spark, sf), angle=450).select("doc_id", "page_no", "rotation")


@query(f"""
WITH {S.MANIFEST} SELECT doc_id, page_no, round(CASE WHEN rotation = 0 THEN 0.1 * width_pt ELSE 0 END, 6) AS box_x,
  round(CASE WHEN rotation = 0 THEN height_pt - 0.2 * height_pt - 0.5 * height_pt ELSE 0 END, 6) AS box_y,
  round(CASE WHEN rotation = 0 THEN 0.6 * width_pt ELSE width_pt END, 6) AS box_w,
  round(CASE WHEN rotation = 0 THEN 0.5 * height_pt ELSE height_pt END, 6) AS box_h FROM manifest
""")
def crop_boxes(spark, sf):
    m = V.manifest(spark, sf)
    crops = m.filter("rotation = 0").select(
        "doc_id", "page_no", F.lit(0.1).alias("cx"), F.lit(0.2).alias("cy"), F.lit(0.6).alias("cw"), F.lit(0.5).alias("ch")
    )
    out = pages.crop_boxes(m, crops)
    return out.select("doc_id", "page_no", r6("box_x"), r6("box_y"), r6("box_w"), r6("box_h"))


@query(f"""
WITH {S.CONV_PAGES}, {S.CONV_PLAN}
SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY file_no, page_no) AS page_no,
  p.doc_id AS source_doc, p.page_no AS source_page, text FROM conv_pages p JOIN conv_plan USING (doc_id)
""")
def merge_documents(spark, sf):
    return pages.merge_docs(V.conv_pages(spark, sf), V.conv_plan(spark, sf))


@query(f"""
WITH {S.CONV_PAGES}, {S.CONV_PLAN}, n AS (SELECT doc_id, count(*) AS n FROM conv_pages GROUP BY 1)
SELECT bundle_id, file_no AS ordinal, 'conv_' || doc_id || '.v1' AS title,
  CAST(coalesce(sum(n) OVER (PARTITION BY bundle_id ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS page_no
FROM conv_plan JOIN n USING (doc_id)
""")
def merge_outline(spark, sf):
    return pages.merge_outline(V.conv_pages(spark, sf), V.conv_plan(spark, sf))


@query(f"""
WITH {S.DOC_PAGES}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_pages)
SELECT doc_id, n - page_no + 1 AS page_no, text FROM t WHERE n >= 2
""")
def reverse_pages(spark, sf):
    return pages.reverse_pages(V.doc_pages(spark, sf))


@query(f"""
WITH {S.MANIFEST}, n AS (SELECT doc_id, count(*) AS n FROM manifest GROUP BY 1 HAVING count(*) >= 30)
SELECT doc_id, page_no + CASE WHEN page_no > 30 THEN 2 ELSE 0 END AS page_no, width_pt, height_pt, rotation FROM manifest JOIN n USING (doc_id)
UNION ALL SELECT doc_id, 30 + k, width_pt, height_pt, 0 FROM manifest JOIN n USING (doc_id), (VALUES (1), (2)) b(k) WHERE page_no = 1
""")
def insert_blank(spark, sf):
    return pages.insert_blank(V.manifest(spark, sf), 30, 2)


@query(f"""
WITH {S.CONV_PAGES}, {S.CONV_PLAN},
j AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM conv_pages JOIN conv_plan USING (doc_id)),
k AS (SELECT *, CASE WHEN file_no = 2 THEN n - page_no + 1 ELSE page_no END AS r FROM j)
SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY r, file_no) AS page_no, doc_id AS source_doc, page_no AS source_page, text FROM k
""")
def interleave(spark, sf):
    return pages.interleave(V.conv_pages(spark, sf), V.conv_plan(spark, sf), reverse_second=True)


@query(f"""
WITH {S.DOC_PAGES}, {S.CONV_PAGES} SELECT doc_id, page_no, text FROM doc_pages UNION ALL SELECT doc_id, page_no, text FROM conv_pages
""")
def union_pages(spark, sf):
    return pages.concat([V.doc_pages(spark, sf), V.conv_pages(spark, sf)])


@query(f"""
WITH {S.MANIFEST}
SELECT doc_id AS target_id, page_no * 2 AS position, doc_id AS source_doc, page_no AS source_page, width_pt, height_pt, (rotation + 90) % 360 AS rotation FROM manifest
UNION ALL SELECT doc_id, page_no * 2 + 1, NULL, NULL, 595.28, 841.89, 0 FROM manifest WHERE rotation = 180
""")
def assemble_pages(spark, sf):
    m = V.manifest(spark, sf)
    copies = m.select(
        F.col("doc_id").alias("target_id"), (F.col("page_no") * 2).alias("position"), "doc_id", "page_no", F.lit(90).alias("turn")
    )
    blanks = m.filter("rotation = 180").select(
        F.col("doc_id").alias("target_id"), (F.col("page_no") * 2 + 1).alias("position"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_no"), F.lit(0).alias("turn"),
    )
    return pages.assemble(copies.unionByName(blanks), m)


@query(f"""
WITH {S.MANIFEST}, {S.CONV_PAGES}, n AS (SELECT doc_id AS layer_id, count(*) AS n FROM conv_pages GROUP BY 1)
SELECT m.doc_id, page_no, CASE WHEN page_no % 2 = 1 THEN layer_id END AS layer_id,
  CASE WHEN page_no % 2 = 1 AND n IS NOT NULL THEN (page_no - 1) % n + 1 END AS layer_page,
  CASE WHEN page_no % 2 = 1 AND n IS NOT NULL THEN 'overlay' ELSE 'copy' END AS mode
FROM manifest m LEFT JOIN n ON m.doc_id = n.layer_id
""")
def overlay_pages(spark, sf):
    layer = V.conv_pages(spark, sf)
    pairs = V.conv_plan(spark, sf).select("doc_id", F.col("doc_id").alias("layer_id"))
    return split.overlay_pages(V.manifest(spark, sf), layer, pairs, "odd", loop=True)


LABELS = f"""{S.DOC_PAGES},
h AS (SELECT p.doc_id, page_no, CASE WHEN lang = 'es' THEN NULL WHEN page_no BETWEEN 4 AND 6 THEN 3 WHEN page_no % 2 = 0 THEN 2
        WHEN page_no BETWEEN 1 AND 3 OR page_no BETWEEN 7 AND 8 THEN 1 END AS rule_no FROM doc_pages p JOIN documents USING (doc_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_no ORDER BY page_no) - 1 AS seen FROM h),
l AS (SELECT doc_id, page_no, rule_no, CASE rule_no WHEN 1 THEN 'r' WHEN 2 THEN 'D' WHEN 3 THEN 'A' ELSE 'D' END AS style,
  CASE rule_no WHEN 1 THEN 1 + seen WHEN 2 THEN 5 + seen WHEN 3 THEN 27 + seen ELSE page_no END AS value FROM c),
labelled AS (SELECT *, CASE rule_no WHEN 1 THEN (['i','ii','iii','iv','v'])[value] WHEN 2 THEN 'A-' || value
  WHEN 3 THEN (['AA','BB','CC'])[value - 26] ELSE '' || value END AS label FROM l)"""


@query(f"WITH {LABELS} SELECT doc_id, page_no, rule_no, style, value, label FROM labelled")
def page_labels(spark, sf):
    return split.page_labels(V.doc_pages(spark, sf), V.label_rules(spark, sf))


@query(f"""
WITH {LABELS}, t AS (SELECT *, coalesce(rule_no, -1) AS r, lag(coalesce(rule_no, -1)) OVER (PARTITION BY doc_id ORDER BY page_no) AS q FROM labelled)
SELECT doc_id, page_no, rule_no, style, value AS start_value FROM t WHERE q IS NULL OR q <> r
""")
def label_runs(spark, sf):
    return split.label_runs(split.page_labels(V.doc_pages(spark, sf), V.label_rules(spark, sf)))


ROMAN_SQL = """repeat('M', CAST(v // 1000 AS INT))
  || (['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[v // 100 % 10 + 1]
  || (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[v // 10 % 10 + 1]
  || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[v % 10 + 1]"""


@query(f"""
WITH v AS (SELECT o_orderkey, o_custkey % 4000 AS v FROM orders)
SELECT o_orderkey, CASE WHEN v <= 0 THEN '' ELSE {ROMAN_SQL} END AS roman,
  CASE WHEN v <= 0 THEN '' ELSE repeat(chr(CAST(65 + (v - 1) % 26 AS INT)), CAST((v - 1) // 26 + 1 AS INT)) END AS letters FROM v
""")
def render_labels(spark, sf):
    v = F.col("o_custkey") % 4000
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        split.render_label(F.lit("R"), F.lit(""), v).alias("roman"),
        split.render_label(F.lit("A"), F.lit(None).cast("string"), v).alias("letters"),
    )


@query(f"""
WITH {S.MANIFEST}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) - 1 AS n, page_no + 8 AS v FROM manifest)
SELECT doc_id, page_no, 'p. ' || {ROMAN_SQL} AS stamp, 'roman' AS fmt FROM t WHERE page_no <> 1
UNION ALL SELECT doc_id, page_no, 'Page ' || (page_no - 1) || ' of ' || n, 'of' FROM t WHERE page_no <> 1 AND page_no % 2 = 0
UNION ALL SELECT doc_id, page_no, '[' || page_no || '/' || (n + 1) || ']', 'custom' FROM t WHERE page_no <> 3
""")
def page_number_stamps(spark, sf):
    m = V.manifest(spark, sf)
    return pages.concat(
        [
            pages.page_numbers(m, "roman", start=10, skip_first=True, prefix="p. ").withColumn("fmt", F.lit("roman")),
            pages.page_numbers(m, "page-of-total", skip_first=True, mode="even-only").withColumn("fmt", F.lit("of")),
            pages.page_numbers(m, "custom", custom="[{page}/{total}]", skip=(3,)).withColumn("fmt", F.lit("custom")),
        ]
    )


@query(f"""
WITH {S.DOC_PAGES}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_pages)
SELECT doc_id, page_no, '2024-01-01 - ' || page_no || '/' || n AS stamp FROM t WHERE page_no <> 1
""")
def header_footer(spark, sf):
    return pages.header_footer(V.doc_pages(spark, sf), "{date} - {page}/{total}", "2024-01-01", skip_first=True)


@query(f"""
WITH {S.MANIFEST} SELECT doc_id, page_no, CASE WHEN page_no = 1 THEN 1 ELSE (page_no - 2) // 6 + 2 END AS sheet_no,
  CASE WHEN page_no = 1 THEN 0 ELSE (page_no - 2) % 6 END AS slot FROM manifest
""")
def contact_sheets(spark, sf):
    return pages.grid_groups(V.manifest(spark, sf), 3, 2, True).select("doc_id", "page_no", "sheet_no", "slot")


@query(f"""
WITH {S.OUTLINE}, o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS ordinal, level, title, page_no, count(*) OVER (PARTITION BY doc_id) AS n FROM outline),
t AS (SELECT *, CASE WHEN ordinal <= 30 THEN 1 ELSE (ordinal - 31) // 32 + 2 END AS tp, CASE WHEN n <= 30 THEN 1 ELSE (n - 31) // 32 + 2 END AS nt FROM o)
SELECT doc_id, ordinal, title, tp AS toc_page, CASE WHEN ordinal <= 30 THEN ordinal - 1 ELSE (ordinal - 31) % 32 END AS toc_row,
  CAST((level - 1) * 20 AS BIGINT) AS indent, page_no + nt AS target_page FROM t
""")
def toc_layout(spark, sf):
    from quirework.operators.prefix import number_rows

    numbered = number_rows(V.outline(spark, sf), ["doc_id"], ["ordinal"], "seq").drop("ordinal")
    return pages.toc_layout(numbered.withColumnRenamed("seq", "ordinal"), 12.0)


@query(f"""
WITH {S.DOC_PAGES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no, length(text) AS n_chars
FROM doc_pages WHERE regexp_matches(text, '\\S')
""")
def drop_blank_pages(spark, sf):
    out = pages.drop_blank_pages(pages.text_ink(V.doc_pages(spark, sf)))
    return out.select("doc_id", "page_no", F.length("text").cast("long").alias("n_chars"))


@query(f"""
WITH {S.DOC_PAGES} SELECT doc_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM doc_pages GROUP BY 1
""")
def doc_stats(spark, sf):
    return split.doc_stats(V.doc_pages(spark, sf))


@query(f"WITH {S.OUTLINE} SELECT doc_id, count(*) AS n_marks FROM outline GROUP BY 1")
def outline_count(spark, sf):
    return V.outline(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_marks"))


@query(r"""
WITH j AS (SELECT doc_id, '{' || chr(10) || '  "id": ' || doc_id || ',' || chr(10) || '    "body": "' || replace(text, chr(10), ' ') || '"' || chr(10) || '}' AS json FROM documents),
l AS (SELECT doc_id, unnest(string_split(json, chr(10))) AS line, generate_subscripts(string_split(json, chr(10)), 1) AS k FROM j),
p AS (SELECT *, regexp_extract(line, '^(\s*)', 1) AS pad, length(regexp_extract(line, '^(\s*)', 1)) AS np FROM l),
b AS (SELECT *, substr(line, np + 1) AS body FROM p),
q AS (SELECT doc_id, k, 0 AS i, CASE WHEN length(line) <= 70 THEN line ELSE pad || substr(body, 1, 70 - np) END AS line, length(line) > 70 AS wrapped FROM b
  UNION ALL SELECT doc_id, k, i, pad || '  ' || substr(body, 70 - np + (i - 1) * (68 - np) + 1, 68 - np), true
  FROM (SELECT *, unnest(range(1, CAST(ceil((length(body) - (70 - np)) / (68 - np)) AS BIGINT) + 1)) AS i FROM b WHERE length(line) > 70))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS line_no, line FROM q WHERE NOT wrapped OR regexp_matches(line, '\S')
""")
def json_pretty_lines(spark, sf):
    d = V.text_table(spark, sf, "documents", "doc_id", "text")
    j = F.concat(
        F.lit('{\n  "id": '), F.col("doc_id").cast("string"), F.lit(',\n    "body": "'),
        F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit('"\n}'),
    )
    return paginate.json_lines(d.select("doc_id", j.alias("json")), width=70)


