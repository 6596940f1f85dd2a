"""The derived tables of ``views`` as SQL fragments for the twins."""

DOC_PAGES = """doc_pages AS (
  SELECT doc_id, i + 1 AS page_no, array_to_string(ls[i*4+1 : i*4+4], chr(10)) AS text
  FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // 4 + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""

PAGE_COUNTS = """page_counts AS (
  SELECT doc_id, (len(string_split(text, chr(10))) - 1) // 4 + 1 AS n_pages FROM documents)"""

CONV_PAGES = """conv_pages AS (
  SELECT conv_id AS doc_id, turn + 1 AS page_no, text FROM conversations)"""

CONV_PLAN = """conv_plan AS (
  SELECT conv_id // 4 AS bundle_id, conv_id % 4 + 1 AS file_no, conv_id AS doc_id,
         'conv_' || conv_id || '.v1.pdf' AS filename
  FROM conversations WHERE turn = 0)"""

MANIFEST = """manifest AS (
  SELECT (k // 64) * 2 + CASE WHEN k % 64 >= 24 THEN 1 ELSE 0 END AS doc_id,
         CASE WHEN k % 64 < 24 THEN k % 64 + 1 ELSE k % 64 - 23 END AS page_no,
         CASE WHEN turn THEN h ELSE w END AS width_pt,
         CASE WHEN turn THEN w ELSE h END AS height_pt, rotation
  FROM (SELECT o_orderkey AS k, o_orderpriority < '3' AS turn,
          ([612,612,792,2384,1684,1191,842,595,420,298,709,499,522]::DOUBLE[])[o_custkey % 13 + 1] AS w,
          ([792,1008,1224,3370,2384,1684,1191,842,595,420,1001,709,756]::DOUBLE[])[o_custkey % 13 + 1] AS h,
          CASE o_orderstatus WHEN 'F' THEN 90 WHEN 'P' THEN 180 ELSE 0 END AS rotation
        FROM orders))"""

LINE_ITEMS = DOC_PAGES + """, line_items AS (
  SELECT doc_id, page_no, i - 1 AS item_no, str, 50.0::DOUBLE AS tx,
         (800.0 - 14.0 * (i - 1))::DOUBLE AS ty, (length(str) * 5.0)::DOUBLE AS width, 10.0::DOUBLE AS height
  FROM (SELECT doc_id, page_no, unnest(ls) AS str, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls FROM doc_pages)))"""

WORD_ITEMS = DOC_PAGES + """, word_items AS (
  SELECT doc_id, page_no, i * 1000000 + j AS item_no, str, 50.0 + 60.0 * j AS tx,
         800.0 - 14.0 * i - (j % 2) AS ty, i = 0 AND str = initcap_word AS big
  FROM (SELECT doc_id, page_no, i, unnest(ws) AS str, generate_subscripts(ws, 1) - 1 AS j
        FROM (SELECT doc_id, page_no, generate_subscripts(ls, 1) - 1 AS i, string_split(unnest(ls), ' ') AS ws
              FROM (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls FROM doc_pages))),
       LATERAL (SELECT upper(str[1]) || lower(str[2:]) AS initcap_word))"""

FILES = """files AS (
  SELECT doc_id, lang, source, n_chars,
    source || '_' || doc_id || '.' || CASE lang WHEN 'fr' THEN 'PDF' WHEN 'de' THEN 'txt' WHEN 'es' THEN 'png' ELSE 'pdf' END AS filename,
    CASE WHEN lang = 'de' THEN 'text/plain' WHEN lang = 'es' THEN 'image/png'
         WHEN n_chars % 3 = 0 THEN '' ELSE 'application/pdf' END AS mime,
    CASE WHEN n_chars % 11 = 0 THEN 0 ELSE n_chars * 100000 END AS size_bytes,
    CASE WHEN n_chars % 7 = 0 THEN 'PK--1.4 ' WHEN n_chars % 7 = 1 THEN '%PDF-x.y' ELSE '%PDF-1.7' END
    || chr(10) || CASE WHEN n_chars % 6 = 0 THEN '/Encrypt 1 0 R' || chr(10) ELSE '' END || text
    || CASE WHEN n_chars % 5 = 0 THEN chr(10) || '<< /Type /Sig /ByteRange [0 100 200 ' || n_chars || '] /Prop << /Name (inner) >> /Contents <' || repeat('00FFAA', CASE WHEN n_chars % 10 = 0 THEN 4000 ELSE 1 END) || '> /Reason (by '
            || source || ') /M (D:20240102030405) >>' || chr(10) ELSE chr(10) END
    || CASE WHEN n_chars % 4 = 0 THEN '' ELSE '%%EOF' || chr(10) END AS content
  FROM documents)"""

DOC_META = """doc_meta AS (
  SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 40) AS title,
    CASE WHEN lang = 'en' THEN '' ELSE source END AS author, lang AS subject,
    lang || ', ' || source AS keywords, CASE WHEN n_chars > 1000 THEN 'writer' ELSE '' END AS creator,
    'maker' AS producer
  FROM documents)"""

OUTLINE = DOC_PAGES + """, outline AS (
  SELECT doc_id, p * 3 + s AS ordinal, CASE WHEN s = 2 THEN 2 ELSE 1 END AS level,
         t || '#' || s AS title,
         CASE WHEN s = 1 AND first <> 'a' THEN p + 1000 ELSE p END AS page_no
  FROM (SELECT doc_id, page_no AS p, lower(substr(text, 1, 1)) AS first, substr(text, 1, 20) AS t, unnest([0, 1, 2]) AS s
        FROM doc_pages WHERE lower(substr(text, 1, 1)) IN ('a', 'e', 'i', 'o', 'u')))"""

RUNS = """runs AS (
  SELECT event_id AS id, user_id AS workflow_id, ts AS start_ts, CAST(floor(value) AS BIGINT) AS duration_ms,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'cancelled' ELSE 'running' END AS status
  FROM events)"""

FLOWS = """flow_nodes AS (
  SELECT o_orderkey // 16 AS flow_id, o_orderkey AS node_id,
    CASE o_orderstatus WHEN 'F' THEN 'pdf' WHEN 'O' THEN '.png' ELSE 'txt' END AS output_format,
    CASE WHEN o_orderpriority < '3' THEN ['.pdf', '.png'] ELSE ['.pdf'] END AS accepted,
    CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'processing' ELSE 'idle' END AS status,
    o_custkey % 101 AS progress, 'step ' || o_orderpriority AS label
  FROM orders),
flow_edges AS (
  SELECT o_orderkey // 16 AS flow_id, o_orderkey * 2 + hop - 1 AS edge_id, o_orderkey * 2 + hop - 1 AS edge_no,
    o_orderkey AS source, o_orderkey + hop AS target
  FROM orders, (VALUES (1), (2)) h(hop)
  WHERE (hop = 1 AND o_orderstatus <> 'P' AND o_orderkey % 16 < 15)
     OR (hop = 2 AND o_totalprice > 300000 AND o_orderkey % 16 < 14))"""

CATALOGUE = """catalogue AS (
  SELECT p_partkey AS id, p_partkey AS pos, p_name AS name,
    lower(replace(p_name || '-' || p_type, ' ', '-')) AS slug, lower(p_type) AS category,
    CASE WHEN p_size > 25 THEN 'Part of ' || p_brand ELSE '' END AS description,
    [lower(p_type), lower(p_brand)] AS features, [p_partkey + 1, p_partkey + p_size * 40] AS related,
    p_size = 1 AS disabled
  FROM part)"""

# rating of one text (alias t) against one query (alias q), both lower case
FUZZY_MACRO = """CASE WHEN {q} = '' THEN 0 WHEN {t} = {q} THEN 1
  WHEN contains({t}, {q}) THEN 0.7::DOUBLE + 0.2::DOUBLE * (length({q})::DOUBLE / length({t})) + 0.1::DOUBLE * (1 - (strpos({t}, {q}) - 1)::DOUBLE / length({t}))
  WHEN len(list_filter(string_split({q}, ' '), lambda a: len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda b: contains(b, a) OR contains(a, b))) > 0)) > 0
  THEN 0.4::DOUBLE + 0.3::DOUBLE * (len(list_filter(string_split({q}, ' '), lambda a: len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda b: contains(b, a) OR contains(a, b))) > 0))::DOUBLE / len(string_split({q}, ' ')))
  WHEN {run} = length({q}) THEN 0.3::DOUBLE + 0.2::DOUBLE * ({run}::DOUBLE / length({t}))
  WHEN {run} > length({q}) * 0.5 THEN 0.1::DOUBLE + 0.2::DOUBLE * ({run}::DOUBLE / length({q}))
  ELSE 0 END"""


def fuzzy_sql(q: str, t: str) -> str:
    run = (
        f"(length({q}) - length(list_reduce(string_split({t}, ''), "
        f"lambda rest, c: CASE WHEN rest <> '' AND rest[1] = c THEN rest[2:] ELSE rest END, {q})))"
    )
    return FUZZY_MACRO.format(q=q, t=t, run=run)

#: Page pairs of the two versions: scores of the recurrence row by row, then the steps back from the last pages; begins with RECURSIVE parts.
PAGE_PAIRS = r"""
lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
v2 AS (SELECT doc_id, flatten(list_transform(ls, lambda l, i: CASE WHEN (i - 1) % 7 = 6 THEN []::VARCHAR[] WHEN (i - 1) % 11 = 10 THEN [l, l] ELSE [l] END)) AS ls FROM lines),
pages_a AS (SELECT doc_id, i + 1 AS page_no, array_to_string(ls[i*4+1 : i*4+4], chr(10)) AS text FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // 4 + 1)) AS i FROM lines)),
pages_b AS (SELECT doc_id, i + 1 AS page_no, array_to_string(ls[i*4+1 : i*4+4], chr(10)) AS text FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // 4 + 1)) AS i FROM v2)),
ca AS (SELECT doc_id, page_no, regexp_replace(text, '\s+', '', 'g') AS c FROM pages_a),
cb AS (SELECT doc_id, page_no, regexp_replace(text, '\s+', '', 'g') AS c FROM pages_b),
sims AS MATERIALIZED (
  SELECT a.doc_id, a.page_no AS i, list(CASE WHEN a.c = '' AND b.c = '' THEN 1.0 WHEN a.c = '' OR b.c = '' THEN 0.0
    ELSE 2.0 * (length(b.c) - length(translate(b.c, a.c, ''))) / (length(a.c) + length(b.c)) END::DOUBLE ORDER BY b.page_no) AS s
  FROM ca a JOIN cb b USING (doc_id) GROUP BY ALL),
shape AS (SELECT doc_id, n, m FROM (SELECT doc_id, max(page_no) AS n FROM pages_a GROUP BY 1) JOIN (SELECT doc_id, max(page_no) AS m FROM pages_b GROUP BY 1) USING (doc_id)),
score(doc_id, i, d) AS (
  SELECT doc_id, 0::BIGINT, list_transform(range(0, m + 1), lambda x: 0.0::DOUBLE) FROM shape
  UNION ALL
  SELECT p.doc_id, p.i + 1, list_reduce(list_zip(s.s, p.d[:-2], p.d[2:]), lambda acc, z: list_append(acc, CASE WHEN z[1] >= 0.25 THEN z[2] + z[1] ELSE greatest(z[3], acc[-1]) END), [0.0]::DOUBLE[])
  FROM score p JOIN sims s ON s.doc_id = p.doc_id AND s.i = p.i + 1),
table_ AS MATERIALIZED (SELECT * FROM score),
steps(doc_id, k, i, j, page_a, page_b, similarity) AS (
  SELECT doc_id, -1::BIGINT, n, m, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM shape
  UNION ALL
  SELECT t.doc_id, t.k + 1,
    CASE WHEN hit OR NOT go_left THEN t.i - 1 ELSE t.i END, CASE WHEN hit OR go_left THEN t.j - 1 ELSE t.j END,
    CASE WHEN hit OR NOT go_left THEN t.i END, CASE WHEN hit OR go_left THEN t.j END, CASE WHEN hit THEN sim END
  FROM (
    SELECT w.doc_id, w.k, w.i, w.j, s.s[w.j] AS sim, coalesce(w.i > 0 AND w.j > 0 AND s.s[w.j] >= 0.25, false) AS hit,
      coalesce(w.j > 0 AND (w.i = 0 OR own.d[w.j] >= up.d[w.j + 1]), false) AS go_left
    FROM steps w LEFT JOIN sims s ON s.doc_id = w.doc_id AND s.i = w.i
      LEFT JOIN table_ own ON own.doc_id = w.doc_id AND own.i = w.i LEFT JOIN table_ up ON up.doc_id = w.doc_id AND up.i = w.i - 1
    WHERE w.i > 0 OR w.j > 0) t),
pairs AS (SELECT doc_id AS pair_id, -k AS pair_no, page_a, page_b, similarity FROM steps WHERE k >= 0)
"""
