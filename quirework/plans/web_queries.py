"""Queries over HTML pages, mail, file manifests and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import mail as M
from quirework.functions import names as N
from quirework.functions import text as T
from quirework.functions import units as U
from quirework.operators import errors, files, html, mail, meta
from quirework.plans import sqlviews as S
from quirework.plans import views as V
from quirework.plans.registry import query
from quirework.session import shared_dir
from quirework.sources import readers, writers

# ---- HTML ---------------------------------------------------------------------

_TAGS = ", ".join(f"'{t}'" for t in html.ALLOWED_TAGS)
_NAME, _ATTRIBUTE, _HANDLER = (x.replace("'", "''") for x in (html.NAME, html.ATTRIBUTE, html.HANDLER))
_OWN = "\n    OR ".join(
    "(" + (f"tag = '{t}' AND " if t else "") + "name IN (" + ", ".join(f"'{n}'" for n in names) + "))"
    for t, names in ({"": html.COMMON_ATTRS} | html.TAG_ATTRS).items()
)


def _clean_sql(column: str) -> str:
    """Allow-list cleaning in SQL over the pieces of a page; RE2's word edge is ASCII, as the rule wants."""
    return f"""
cut AS (SELECT page_id, string_split({column}, '>') AS l FROM pages),
piece AS (SELECT page_id, len(l) AS n, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM cut),
part AS (SELECT *, regexp_extract(p, '(?s)^(.*?)<(/?)([a-zA-Z][a-zA-Z0-9]*)\\b(.*)$', ['front', 'slash', 'tag', 'rest']) AS m FROM piece),
tags AS (SELECT page_id, k, p, k < n AS ended, m.front AS front, m.slash AS slash, lower(m.tag) AS tag, m.rest AS rest FROM part),
attr AS (SELECT page_id, k, tag, unnest(l) AS raw, generate_subscripts(l, 1) AS j FROM (
  SELECT page_id, k, tag, regexp_extract_all(regexp_replace(rest, '/\\z', ''), '{_ATTRIBUTE}') AS l FROM tags WHERE ended AND slash = '' AND tag IN ({_TAGS}))),
pair AS (SELECT page_id, k, tag, j, lower(regexp_extract(raw, '^{_NAME}')) AS name, regexp_replace(raw, '^{_NAME}\\s*=?\\s*', '') AS v FROM attr),
val AS (SELECT page_id, k, tag, j, name, CASE WHEN length(v) > 1 AND v[1] IN ('"', '''') AND v[1] = v[-1] THEN v[2:-2] ELSE v END AS v FROM pair),
kept AS (SELECT page_id, k, string_agg(' ' || name || '="' || replace(v, '"', '&quot;') || '"' || CASE WHEN tag = 'a' AND name = 'href' THEN ' rel="noopener noreferrer"' ELSE '' END, '' ORDER BY j) AS a
  FROM val WHERE ({_OWN})
    AND NOT (name IN ('href', 'src') AND regexp_matches(lower(trim(v)), '^(javascript:|data:|vbscript:)')) GROUP BY ALL),
shown AS (SELECT page_id, k, CASE WHEN NOT ended THEN p WHEN tag = '' THEN p || '>' WHEN tag NOT IN ({_TAGS}) THEN front WHEN slash = '/' THEN front || '</' || tag || '>'
  ELSE front || '<' || tag || coalesce(a, '') || CASE WHEN ends_with(rest, '/') THEN ' />' ELSE '>' END END AS s FROM tags LEFT JOIN kept USING (page_id, k))
SELECT page_id, regexp_replace(string_agg(s, '' ORDER BY k), '{_HANDLER}', '', 'g') AS html FROM shown GROUP BY page_id
"""


@query("WITH " + _clean_sql("html"))
def sanitize_html(spark, sf):
    return html.sanitize_html(readers.html_pages(V.text_table(spark, sf, "pages"))).select("page_id", "html")


@query(
    "WITH "
    + _clean_sql("regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')")
)
def sanitize_html_drop_scripts(spark, sf):
    return html.sanitize_html(V.text_table(spark, sf, "pages"), drop_content=True).select("page_id", "html")


@query("""
SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS url FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, '(https?://[^\\s<>"]+)', 1) AS l FROM pages)
""")
def html_links(spark, sf):
    p = V.text_table(spark, sf, "pages").withColumn("html", F.concat_ws(" ", "url", "html"))
    return html.html_links(p)


@query("""
SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS href,
  NOT regexp_matches(lower(trim(unnest(l))), '^(javascript:|data:|vbscript:)') AS safe FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS l FROM pages)
""")
def html_hrefs(spark, sf):
    return html.html_hrefs(V.text_table(spark, sf, "pages"))


@query("""
SELECT page_id, url FROM (SELECT page_id, CASE WHEN length(html) % 3 = 0 THEN ' JavaScript:' || url ELSE url END AS url FROM pages) WHERE NOT regexp_matches(lower(trim(url)), '^(javascript:|data:|vbscript:)')
""")
def safe_urls(spark, sf):
    p = V.text_table(spark, sf, "pages")
    bad = F.when(F.length("html") % 3 == 0, F.concat(F.lit(" JavaScript:"), F.col("url"))).otherwise(F.col("url"))
    return html.filter_safe_urls(p.select("page_id", bad.alias("url")))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages
""")
def html_text(spark, sf):
    return html.html_text(V.text_table(spark, sf, "pages"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped,
  regexp_replace(url, '(?i)(https?://[^\\s<>"]+)', '<a href="\\1">\\1</a>', 'g') AS linked FROM pages
""")
def escape_and_link(spark, sf):
    return V.text_table(spark, sf, "pages").select(
        "page_id", T.escape_html(F.col("html")).alias("escaped"), T.linkify(F.col("url")).alias("linked")
    )


# ---- mail ---------------------------------------------------------------------

_MULTI = "turn % 3 = 2"
_FLAT = "turn % 3 = 2 AND conv_id % 3 = 0"


@query(f"""
SELECT conv_id * 100 + turn AS doc_id, text AS subject, 'user' || conv_id || '@example.org' AS sender,
  'a@example.org, b@example.org' AS recipients, CAST(NULL AS VARCHAR) AS cc, CAST(NULL AS VARCHAR) AS bcc,
  TIMESTAMP '2024-01-01 10:00:00' + INTERVAL (turn % 10) SECOND AS sent_ts,
  CASE WHEN {_FLAT} THEN '<p><img src="cid:pic1"> and <img src="cid:none"></p>' || chr(10) WHEN {_MULTI} THEN '<p>' || text || '</p>' || chr(10) WHEN role <> 'user' THEN '<p>' || text || '</p>' END AS html_body,
  CASE WHEN {_MULTI} THEN text || chr(10) WHEN role = 'user' THEN text END AS text_body,
  CASE WHEN NOT {_MULTI} THEN 0 WHEN conv_id % 3 = 2 THEN 2 ELSE 1 END AS n_attachments FROM conversations
""")
def parse_emails(spark, sf):
    return mail.parse_emails(V.eml(spark, sf))


@query(f"""
SELECT conv_id * 100 + turn AS doc_id, p.* EXCLUDE (k) FROM conversations JOIN (VALUES
  (0, 1, '1', 'text', 'attachment', false, false), (0, 2, '2', 'html', 'attachment', false, false), (0, 3, '3', 'attachment', 'p.png', true, false),
  (1, 1, '1.1', 'text', 'attachment', false, false), (1, 2, '1.2', 'html', 'attachment', false, false), (1, 3, '2', 'attachment', 'notes.txt', false, false),
  (2, 1, '1.1', 'text', 'attachment', false, false), (2, 2, '1.2', 'html', 'attachment', false, false), (2, 3, '2', 'attachment', 'notes.txt', false, false),
  (2, 4, '3', 'attachment', 'attachment', false, false), (2, 5, '3.1', 'text', 'attachment', false, true)) p(k, part_no, path, kind, filename, is_inline, forwarded) ON conv_id % 3 = k
WHERE {_MULTI}
""")
def email_parts(spark, sf):
    return mail.email_parts(V.eml(spark, sf)).select("doc_id", "part_no", "path", "kind", "filename", "is_inline", "forwarded")


@query(f"""
SELECT conv_id * 100 + turn AS doc_id, CASE conv_id % 3 WHEN 0 THEN 'pic1' END AS content_id, text AS content FROM conversations WHERE {_MULTI}
UNION ALL SELECT conv_id * 100 + turn, NULL, NULL FROM conversations WHERE {_MULTI} AND conv_id % 3 = 2
""")
def email_attachments(spark, sf):
    return mail.email_attachments(V.eml(spark, sf)).select("doc_id", "content_id", F.col("data").cast("string").alias("content"))


@query(f"""
SELECT conv_id * 100 + turn AS doc_id, CASE WHEN {_FLAT} THEN '<p><img src="data:image/png; name="p.png";base64,' || to_base64(encode(text)) || '"> and <img src="cid:none"></p>' || chr(10)
  WHEN {_MULTI} THEN '<p>' || text || '</p>' || chr(10) WHEN role <> 'user' THEN '<p>' || text || '</p>' ELSE '' END AS html_body FROM conversations
""")
def resolve_inline_images(spark, sf):
    raw = V.eml(spark, sf)
    return mail.resolve_cids(mail.parse_emails(raw).select("doc_id", "html_body"), mail.email_attachments(raw))


@query("""
SELECT conv_id, turn, text AS b64, text AS qp, 'Re: ' || text || ' end' AS word FROM conversations
""")
def decode_mail_text(spark, sf):
    c = V.table(spark, sf, "conversations")
    raw = F.encode("text", "UTF-8")
    # lines of base64 and soft line breaks stay in
    qp = F.regexp_replace(F.hex(raw), "(..)", "=$1")
    soft = F.regexp_replace(qp, "((?:=..){25})", "$1=\r\n")
    word = F.concat(F.lit("Re: =?UTF-8?q?"), qp, F.lit("?= end"))
    return c.select(
        "conv_id", "turn", M.decode_b64(F.base64(raw)).alias("b64"), M.decode_qp(soft).alias("qp"), M.decode_words(word).alias("word")
    )


# ---- files --------------------------------------------------------------------

_ACCEPT = ("application/pdf", "image/*")


@query(f"""
WITH {S.FILES}, c AS (
  SELECT doc_id, 'FILE_EMPTY' AS code, 'The file is empty or could not be read.' AS message FROM files WHERE size_bytes = 0
  UNION ALL SELECT doc_id, 'FILE_TOO_LARGE', 'File size exceeds the maximum limit of 100MB.' FROM files WHERE size_bytes > 104857600
  UNION ALL SELECT doc_id, 'FILE_TYPE_INVALID', 'Invalid file type. Expected: application/pdf, image/*' FROM files
    WHERE size_bytes <> 0 AND NOT (mime = 'application/pdf' OR starts_with(mime, 'image') OR ends_with(lower(filename), '.pdf')))
SELECT doc_id, code, message, 'FILE_ERROR' AS category, true AS recoverable FROM c
""")
def validate_files(spark, sf):
    return files.validate_files(V.files(spark, sf), accepted=_ACCEPT).select("doc_id", "code", "message", "category", "recoverable")


@query(f"""
WITH {S.FILES}
SELECT doc_id, 'FILE_NOT_PDF' AS code, 'The file does not appear to be a valid PDF.' AS message FROM files WHERE NOT starts_with(content, '%PDF-')
UNION ALL SELECT doc_id, 'PDF_MALFORMED', 'Could not determine PDF version.' FROM files WHERE starts_with(content, '%PDF-') AND NOT regexp_matches(content, '^%PDF-\\d\\.\\d')
UNION ALL SELECT doc_id, 'PDF_MALFORMED', 'PDF file appears to be incomplete or corrupted.' FROM files WHERE starts_with(content, '%PDF-') AND n_chars % 4 = 0 AND NOT contains(right(content, 300), '%%EOF')
""")
def validate_structure(spark, sf):
    return files.validate_structure(V.files(spark, sf)).select("doc_id", "code", "message")


@query(f"WITH {S.FILES} SELECT doc_id, contains(content, '/Encrypt') AS encrypted FROM files")
def flag_encrypted(spark, sf):
    return files.flag_encrypted(V.files(spark, sf)).select("doc_id", "encrypted")


def _behind_text(df):
    """Every ninth file with its mark behind all else."""
    mark = F.when(F.col("n_chars") % 9 == 0, "/Encrypt 2 0 R").otherwise("").cast("binary")
    return df.withColumn("content", F.concat("content", mark))


@query(f"WITH {S.FILES} SELECT doc_id, contains(content, '/Encrypt') OR n_chars % 9 = 0 AS encrypted FROM files")
def flag_encrypted_full(spark, sf):
    return files.flag_encrypted(_behind_text(V.files(spark, sf))).select("doc_id", "encrypted")


@query(f"""
WITH {S.FILES} SELECT doc_id, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS ext,
  CASE lower(regexp_extract(filename, '\\.([^.]*)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain' WHEN 'png' THEN 'image/png' END AS mime,
  CASE lang WHEN 'de' THEN 'txt' WHEN 'es' THEN 'png' ELSE 'pdf' END || ':' || regexp_replace(filename, '\\.[^.]*$', '') AS label,
  CASE WHEN lang IN ('de', 'es') THEN regexp_replace(filename, '\\.[^.]*$', '') || '.pdf' ELSE filename END AS as_pdf FROM files
""")
def file_names(spark, sf):
    n = F.col("filename")
    return V.files(spark, sf).select(
        "doc_id", N.file_ext(n).alias("ext"), N.mime_from_name(n).alias("mime"),
        F.concat_ws(":", N.file_ext(n), N.stem(n)).alias("label"), N.ensure_extension(n, "pdf").alias("as_pdf"),
    )


_SAFE = "regexp_replace(regexp_replace(regexp_replace(replace(url || '..' || html, '..', ''), '[/\\\\]', '', 'g'), '^\\.+', ''), '[\\x00-\\x1f\\x7f]', '', 'g')"


@query(f"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(trim(regexp_replace({_SAFE}, '[<>:"|?*]', '', 'g')), '^\\.+', ''), '\\.+$', '') AS s FROM pages),
e AS (SELECT *, CASE WHEN contains(s, '.') AND NOT regexp_matches(s, '^\\.[^.]*$') THEN lower(regexp_extract(s, '\\.([^.]*)$', 1)) ELSE '' END AS ext FROM s)
SELECT page_id, CASE WHEN s = '' THEN 'download' WHEN length(s) <= 200 THEN s WHEN ext <> '' THEN substr(s, 1, greatest(199 - length(ext), 0)) || '.' || ext ELSE substr(s, 1, 199) END AS safe FROM e
""")
def sanitize_filenames(spark, sf):
    raw = F.concat("url", F.lit(".."), "html")
    return V.text_table(spark, sf, "pages").select("page_id", N.sanitize_filename(raw).alias("safe"))


@query(f"""
WITH {S.FILES}, f AS (SELECT doc_id, size_bytes AS s FROM files),
u AS (SELECT *, CASE WHEN s >= 1073741824 THEN 3 WHEN s >= 1048576 THEN 2 WHEN s >= 1024 THEN 1 ELSE 0 END AS i FROM f)
SELECT doc_id, CASE WHEN s = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', round(s / power(1024.0::DOUBLE, i), 2)), '\\.?0+$', '') || (['', ' KB', ' MB', ' GB'])[i + 1] END AS size_text,
  CASE WHEN s = 0 THEN '0 B' ELSE regexp_replace(printf('%.1f', round(s / power(1024.0::DOUBLE, i), 1)), '\\.?0+$', '') || (['', ' KB', ' MB', ' GB'])[i + 1] END AS short_text FROM u
""")
def format_sizes(spark, sf):
    s = F.col("size_bytes")
    return V.files(spark, sf).select(
        "doc_id", U.format_size(s).alias("size_text"), U.format_size(s, 1, "B").alias("short_text")
    )


@query(f"""
WITH {S.FILES} SELECT doc_id, CASE WHEN ends_with(lower(filename), '.png') OR ends_with(lower(filename), '.jpg') THEN 'images' WHEN ends_with(lower(filename), '.pdf') THEN 'pdfs' END AS route_id FROM files
""")
def route_files(spark, sf):
    return files.route_files(V.files(spark, sf), [("images", [".png", "JPG"]), ("pdfs", ["pdf", "png"])]).select("doc_id", "route_id")


@query(f"""
WITH {S.FILES} SELECT doc_id, CASE WHEN lang = 'en' AND source = 'src1' THEN 'c' WHEN size_bytes >= 200000000 AND lower(regexp_extract(filename, '\\.([^.]*)$', 1)) = 'pdf' THEN 'a'
  WHEN regexp_matches(source, '[3-5]$') AND NOT contains(source, '4') THEN 'b' ELSE 'rest' END AS target_id FROM files
""")
def route_by_rules(spark, sf):
    branches = [
        {"priority": 2, "target": "a", "conditions": [
            {"type": "file-size", "operator": "greater-or-equal", "value": 200000000},
            {"type": "file-format", "operator": "equals", "value": "pdf"}]},
        {"priority": 3, "target": "b", "conditions": [
            {"type": "metadata", "field": "source", "operator": "matches", "value": "[3-5]$"},
            {"type": "metadata", "field": "source", "operator": "not-contains", "value": "4"}]},
        {"priority": 1, "target": "c", "conditions": [{"type": "custom", "value": "lang = 'en' AND source = 'src1'"}]},
    ]
    return files.route_by_rules(V.files(spark, sf), branches, "all", "rest").select("doc_id", "target_id")


@query(f"""
WITH {S.FILES} SELECT doc_id, 0 AS idx, 'by ' || source AS reason, '2024-01-02T03:04:05' AS signing_time, 200 + n_chars AS range_end,
  CASE WHEN 200 + n_chars = octet_length(encode(content)) THEN 'full' WHEN 200 + n_chars < octet_length(encode(content)) THEN 'partial' ELSE 'unknown' END AS coverage FROM files WHERE n_chars % 5 = 0
""")
def signature_inventory(spark, sf):
    out = files.signature_inventory(V.files(spark, sf))
    br = F.col("byte_range")
    return out.select("doc_id", "idx", "reason", "signing_time", (br[2] + br[3]).alias("range_end"), "coverage")


@query(f"""
WITH {S.FILES}, s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, count(*) OVER () AS t FROM files)
SELECT doc_id, n // 30 + 1 AS bundle_id, 'images_part_' || lpad('' || (n // 30 + 1), CAST(length('' || CAST(ceil(t / 30) AS BIGINT)) AS INT), '0') || '.pdf' AS bundle_name FROM s
""")
def assign_bundles(spark, sf):
    return writers.assign_bundles(V.files(spark, sf).select("doc_id"), 30)


@query(f"""
WITH {S.FILES}, c AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'FILE_NOT_PDF' WHEN n_chars % 4 = 0 THEN 'PDF_MALFORMED' WHEN n_chars % 6 = 0 THEN 'PDF_ENCRYPTED' END AS code FROM files)
SELECT doc_id, code, CASE WHEN code = 'PDF_ENCRYPTED' OR code = 'PDF_MALFORMED' THEN 'PROCESSING_ERROR' ELSE 'FILE_ERROR' END AS category, code <> 'PDF_MALFORMED' AS recoverable,
  CASE code WHEN 'PDF_MALFORMED' THEN 'Try using the Repair PDF tool first.' WHEN 'PDF_ENCRYPTED' THEN 'Please decrypt the PDF first using the Decrypt tool.' ELSE 'Please try again.' END AS suggested_action
FROM c WHERE code IS NOT NULL
""")
def split_errors(spark, sf):
    f = V.files(spark, sf)
    n = F.col("n_chars")
    coded = f.withColumn(
        "error_code", F.when(n % 7 == 0, "FILE_NOT_PDF").when(n % 4 == 0, "PDF_MALFORMED").when(n % 6 == 0, "PDF_ENCRYPTED")
    )
    _, bad = errors.split_errors(coded)
    return bad.select("doc_id", "code", "category", "recoverable", "suggested_action")


# ---- metadata and other document tables ----------------------------------------


@query(f"""
WITH {S.DOC_META} SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN upper(source) ELSE title END AS title,
  CASE WHEN lang = 'fr' THEN author ELSE 'editor ' || lang END AS author FROM doc_meta JOIN documents USING (doc_id)
""")
def edit_metadata(spark, sf):
    d = V.table(spark, sf, "documents")
    patch = d.select(
        "doc_id",
        F.when(F.col("source").isin("src1", "src2"), F.upper("source")).alias("title"),
        F.when(F.col("lang") == "fr", F.lit("  ")).otherwise(F.concat(F.lit("editor "), F.col("lang"))).alias("author"),
    )
    return meta.edit_metadata(V.doc_meta(spark, sf), patch).select("doc_id", "title", "author")


@query("SELECT doc_id, unnest([lang, source]) AS keyword, unnest([1, 2]) AS pos FROM documents")
def metadata_keywords(spark, sf):
    k = V.doc_meta(spark, sf).select("doc_id", F.posexplode(meta.keyword_list(F.col("keywords"))).alias("p", "keyword"))
    return k.select("doc_id", "keyword", (F.col("p") + 1).alias("pos"))


@query(f"""
WITH {S.DOC_META} SELECT doc_id, CASE WHEN title <> '' THEN '' ELSE title END AS title, '' AS author, subject, '' AS creator,
  array_to_string(list_filter([CASE WHEN title <> '' THEN 'title' END, CASE WHEN author <> '' THEN 'author' END, CASE WHEN creator <> '' THEN 'creator' END], lambda x: x IS NOT NULL), ',') AS removed FROM doc_meta
""")
def remove_metadata(spark, sf):
    out = meta.remove_metadata(V.doc_meta(spark, sf), ("creator", "title", "author"))
    return out.select("doc_id", "title", "author", "subject", "creator", F.array_join("removed_fields", ",").alias("removed"))


def _annotations(spark, sf):
    e = V.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "Link").when(F.col("event_type") == "view", "Highlight").otherwise("Text")
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("ann_id"), (F.floor("value") % 20 + 1).cast("long").alias("page_no"), kind.alias("kind")
    )


_ANN = """ann AS (SELECT user_id AS doc_id, event_id AS ann_id, CAST(floor(value) AS BIGINT) % 20 + 1 AS page_no,
  CASE event_type WHEN 'click' THEN 'Link' WHEN 'view' THEN 'Highlight' ELSE 'Text' END AS kind FROM events)"""


@query(f"WITH {_ANN} SELECT * FROM ann WHERE NOT (kind IN ('Link', 'Highlight') AND page_no BETWEEN 2 AND 9)")
def remove_annotations(spark, sf):
    return meta.remove_annotations(_annotations(spark, sf), ("Link", "Highlight"), "2-9")


@query(f"""
WITH {_ANN}, {S.DOC_META} SELECT 'annotation' AS item, doc_id, ann_id AS item_id, kind AS note FROM ann WHERE kind <> 'Link'
UNION ALL SELECT 'meta', doc_id, 0, title || author FROM (SELECT doc_id, '' AS title, '' AS author FROM doc_meta)
UNION ALL SELECT 'removed', doc_id, 0, 'metadata,JavaScript,links' FROM doc_meta
UNION ALL SELECT 'action', user_id, event_id, event_type FROM events WHERE event_type <> 'error'
""")
def sanitize_documents(spark, sf):
    actions = V.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), "event_id", F.when(F.col("event_type") == "error", "JavaScript").otherwise(F.col("event_type")).alias("kind")
    )
    out = meta.sanitize(
        {"meta": V.doc_meta(spark, sf), "annotations": _annotations(spark, sf), "actions": actions},
        ("remove_links", "remove_metadata", "remove_javascript"),
    )
    row = lambda df, item, ident, note: df.select(F.lit(item).alias("item"), "doc_id", ident.alias("item_id"), note.alias("note"))
    zero = F.lit(0).cast("long")
    return (
        row(out["annotations"], "annotation", F.col("ann_id"), F.col("kind"))
        .unionByName(row(out["meta"], "meta", zero, F.concat("title", "author")))
        .unionByName(row(out["removed"], "removed", zero, F.array_join("removed_items", ",")))
        .unionByName(row(out["actions"], "action", F.col("event_id"), F.col("kind")))
    )


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity * 4 >= 50 AND l_quantity * 3 >= 50 AND l_extendedprice >= 10240 GROUP BY ALL
""")
def filter_images(spark, sf):
    li = V.table(spark, sf, "lineitem")
    img = li.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 4).alias("width"), (F.col("l_quantity") * 3).alias("height"), F.col("l_extendedprice").alias("size")
    )
    return meta.filter_images(img).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


def _attachments(spark, sf):
    """Some names look like numbered copies of others."""
    o = V.table(spark, sf, "orders")
    again = F.when(F.col("o_orderkey") % 17 < 2, F.concat(F.lit("_"), (F.col("o_orderkey") % 5 + 1).cast("string"))).otherwise("")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("notes"), again)).otherwise(
        F.concat(F.lower(F.substring("o_orderpriority", 3, 3)), F.lit(".a"), again, F.lit(".txt"))
    )
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("idx"), name.alias("name"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).cast("long").alias("page_no"),
        F.concat(F.lit("cust"), (F.col("o_custkey") % 10).cast("string"), F.lit(".pdf")).alias("filename"),
    )


@query("""
WITH a AS (SELECT o_custkey AS doc_id, o_orderkey AS idx, 'cust' || (o_custkey % 10) || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '_page1' END || '_'
    || CASE WHEN o_orderstatus = 'P' THEN 'notes' ELSE lower(substr(o_orderpriority, 3, 3)) || '.a' END
    || CASE WHEN o_orderkey % 17 < 2 THEN '_' || (o_orderkey % 5 + 1) ELSE '' END AS head, CASE WHEN o_orderstatus = 'P' THEN '' ELSE '.txt' END AS tail FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY doc_id, idx) - 1 AS k FROM a),
names AS (SELECT DISTINCT head || tail AS f FROM a),
bases AS (SELECT head, tail, max(k) AS most FROM k GROUP BY ALL),
free AS (SELECT head, tail, n, row_number() OVER (PARTITION BY head, tail ORDER BY n) AS k
         FROM (SELECT head, tail, unnest(generate_series(1, most + 20)) AS n FROM bases) s WHERE head || '_' || n || tail NOT IN (SELECT f FROM names))
SELECT doc_id, idx, k.head || CASE WHEN k.k = 0 THEN '' ELSE '_' || n END || k.tail AS unique_name FROM k LEFT JOIN free USING (head, tail, k)
""")
def dedupe_attachment_names(spark, sf):
    return meta.dedupe_names(_attachments(spark, sf)).select("doc_id", "idx", "unique_name")


@query("""
SELECT o_custkey AS doc_id, o_orderkey AS idx FROM orders WHERE (o_custkey, o_orderkey) NOT IN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice < 100000)
""")
def drop_attachments(spark, sf):
    cheap = V.table(spark, sf, "orders").filter("o_totalprice < 100000").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("idx"))
    return meta.drop_attachments(_attachments(spark, sf), cheap).select("doc_id", "idx")


def _fields(spark, sf):
    p = V.table(spark, sf, "part")
    kind = F.when(F.col("p_size") < 10, "PDFTextField").when(F.col("p_size") < 20, "PDFCheckBox").when(F.col("p_size") < 30, "PDFDropdown").when(F.col("p_size") < 40, "PDFRadioGroup").otherwise("PDFButton")
    return p.select(
        (F.col("p_partkey") % 100).alias("doc_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), kind.alias("class_name"), F.lit("old").alias("value")
    )


_FIELDS = """fields AS (SELECT p_partkey % 100 AS doc_id, 'f' || p_partkey AS name, p_partkey,
  CASE WHEN p_size < 10 THEN 'Text' WHEN p_size < 20 THEN 'CheckBox' WHEN p_size < 30 THEN 'Dropdown' WHEN p_size < 40 THEN 'RadioGroup' ELSE 'Button' END AS type FROM part)"""


@query(f"WITH {_FIELDS} SELECT doc_id, name, type FROM fields")
def list_form_fields(spark, sf):
    return meta.list_fields(_fields(spark, sf))


@query(f"""
WITH {_FIELDS}, v AS (SELECT l_partkey, arg_max(CASE WHEN l_returnflag = 'A' THEN 'true' ELSE l_returnflag END, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate)) AS v FROM lineitem GROUP BY 1)
SELECT doc_id, name, type, CASE WHEN v IS NULL OR type = 'Button' THEN 'old' WHEN type = 'CheckBox' THEN CASE WHEN v = 'true' THEN 'true' ELSE 'false' END ELSE v END AS value
FROM fields LEFT JOIN v ON p_partkey = l_partkey
""")
def fill_forms(spark, sf):
    li = V.table(spark, sf, "lineitem")
    values = li.select(
        (F.col("l_partkey") % 100).alias("doc_id"),
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("name"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate").alias("seq"),
        F.when(F.col("l_returnflag") == "A", "true").otherwise(F.col("l_returnflag")).alias("value"),
    )
    return meta.fill_forms(meta.list_fields(_fields(spark, sf)).withColumn("value", F.lit("old")), values)


@query("""
WITH l AS (SELECT c_custkey, c_name, c_acctbal > 0 AS visible FROM customer),
a AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS toggles, arg_max(CASE WHEN o_orderstatus = 'O' THEN 'layer ' || o_orderkey END, CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS nm,
  bool_or(o_orderstatus = 'P' AND o_totalprice > 490000) AS gone FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 450000 GROUP BY 1)
SELECT c_custkey AS layer_id, coalesce(nm, c_name) AS name, visible <> (coalesce(toggles, 0) % 2 = 1) AS visible FROM l LEFT JOIN a ON c_custkey = o_custkey WHERE NOT coalesce(gone, false)
UNION ALL SELECT 1000000000 + o_orderkey, 'new', true FROM orders WHERE o_orderstatus = 'P' AND o_totalprice BETWEEN 440000 AND 450000
""")
def manage_layers(spark, sf):
    layers = V.table(spark, sf, "customer").select(
        F.lit(0).alias("doc_id"), F.col("c_custkey").alias("layer_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("visible")
    )
    o = V.table(spark, sf, "orders")
    st, price = F.col("o_orderstatus"), F.col("o_totalprice")
    action = (
        F.when(st == "F", "toggle").when(st == "O", "rename").when((st == "P") & (price > 490000), "delete")
        .when((st == "P") & price.between(440000, 450000), "add")
    )
    acts = o.select(
        F.lit(0).alias("doc_id"),
        F.when(action == "add", F.lit(1000000000) + F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("layer_id"),
        F.col("o_orderkey").alias("seq"), action.alias("action"),
        F.when(action == "add", F.lit("new")).otherwise(F.concat(F.lit("layer "), F.col("o_orderkey").cast("string"))).alias("name"),
    ).filter("action IS NOT NULL")
    return meta.manage_layers(layers, acts).drop("doc_id")


@query("""
SELECT event_id, date_trunc('second', ts) AS ts, date_trunc('day', ts) AS day FROM events
""")
def parse_pdf_dates(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(
        "event_id",
        U.pdf_date(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+00'00'"))).alias("ts"),
        U.pdf_date(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMdd"))).alias("day"),
    )


@query("""
WITH t AS (SELECT event_id, ts, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) AS d FROM events)
SELECT event_id, CASE WHEN d < 60000000 THEN 'Just now' WHEN d < 3600000000 THEN (d // 60000000) || 'm ago' WHEN d < 86400000000 THEN (d // 3600000000) || 'h ago'
  WHEN d < 604800000000 THEN (d // 86400000000) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM t
""")
def relative_times(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return V.table(spark, sf, "events").select("event_id", U.relative_time(F.col("ts"), now).alias("age"))


@query("""
WITH h AS (SELECT c_custkey, lpad(printf('%x', (c_custkey * 7919) % 16777216), 6, '0') AS h FROM customer),
v AS (SELECT c_custkey, h, list_transform([1, 3, 5], lambda i: (strpos('0123456789abcdef', h[i]) - 1) * 16 + strpos('0123456789abcdef', h[i+1]) - 1) AS v FROM h)
SELECT c_custkey, round(v[1] / 255, 6) AS r, round(v[2] / 255, 6) AS g, round(v[3] / 255, 6) AS b FROM v
""")
def hex_colors(spark, sf):
    h = F.lpad(F.lower(F.hex((F.col("c_custkey") * 7919) % 16777216)), 6, "0")
    rgb = U.hex_to_rgb(F.concat(F.lit("#"), h))
    return V.table(spark, sf, "customer").select(
        "c_custkey", *[F.round(rgb[c], 6).alias(c) for c in ("r", "g", "b")]
    )


@query(f"""
WITH {S.FILES}, {S.PAGE_COUNTS} SELECT doc_id,
  CASE WHEN n_pages = 1 THEN regexp_replace(filename, '\\.[^.]*$', '') || '_page_1.pdf' ELSE regexp_replace(filename, '\\.[^.]*$', '') || '_part2_pages_1-' || n_pages || '.pdf' END AS split_name,
  CASE WHEN n_pages <= 3 THEN regexp_replace(filename, '\\.[^.]*$', '') || CASE n_pages WHEN 1 THEN '_page_1' WHEN 2 THEN '_pages_1-2' ELSE '_pages_1-2-3' END || '.pdf'
    ELSE regexp_replace(filename, '\\.[^.]*$', '') || '_' || n_pages || '_pages_extracted.pdf' END AS extract_name,
  CASE WHEN n_pages = 2 THEN regexp_replace(filename, '\\.[^.]*$', '') || '_b.x_merged.pdf' ELSE regexp_replace(filename, '\\.[^.]*$', '') || '_and_' || (n_pages - 1) || '_more_merged.pdf' END AS merge_name,
  regexp_replace(filename, '\\.[^.]*$', '') || '_' || (n_pages + 1) || '.' || regexp_extract(filename, '\\.([^.]*)$', 1) AS nth_name
FROM files JOIN page_counts USING (doc_id)
""")
def output_names(spark, sf):
    f = V.files(spark, sf).select("doc_id", "filename").join(V.page_counts(spark, sf), "doc_id")
    n, name = F.col("n_pages"), F.col("filename")
    one = F.lit(1).cast("long")
    return f.select(
        "doc_id",
        N.split_name(name, one, n, F.lit(2), F.when(n == 1, 1).otherwise(5)).alias("split_name"),
        N.extract_name(name, n, F.sequence(one, F.least(n, F.lit(3).cast("long")))).alias("extract_name"),
        N.merge_name(name, F.lit("b.x.pdf"), n).alias("merge_name"),
        N.indexed_name(name, n).alias("nth_name"),
    )


@query("""
WITH d AS (SELECT doc_id, n_chars, CAST(to_json({text: text}) AS VARCHAR) AS j, '{"text": "' || text || '"}' AS bare FROM documents)
SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN json_valid(left(j, length(j) - 1)) WHEN 1 THEN json_valid(bare) ELSE json_valid(j) END AS good FROM d
""")
def check_json(spark, sf):
    """Whole texts as JSON: cut short, put in quotes as they are, or escaped."""
    d = V.table(spark, sf, "documents")
    js, k = F.to_json(F.struct("text")), F.col("n_chars") % 3
    bare = F.concat(F.lit('{"text": "'), "text", F.lit('"}'))
    text = F.when(k == 0, F.substring(js, F.lit(1), F.length(js) - 1)).when(k == 1, bare).otherwise(js)
    return readers.check_json(d.select("doc_id", text.alias("text"))).select("doc_id", F.col("error_code").isNull().alias("good"))


def _files(spark, sf, text, purpose):
    """A text file per row of ``benchmark``; Spark's writer ends each with a line break."""
    path = shared_dir(spark, purpose)
    items = V.table(spark, sf, "benchmark").select(F.xxhash64("item_id", "text").alias("k"), F.coalesce(text, F.lit("")).alias("v"))
    items.repartition("k").write.partitionBy("k").text(path)
    return path


@query("""
SELECT coalesce(text, '') || chr(10) AS text, count(*) AS n FROM benchmark GROUP BY 1
""")
def read_text_files(spark, sf):
    docs = readers.read_text_docs(spark, _files(spark, sf, F.col("text"), "texts"))
    return docs.groupBy("text").agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN length(text) % 3 = 0 THEN NULL ELSE text END AS text, length(text) % 3 <> 0 AS good, count(*) AS n FROM benchmark WHERE text IS NOT NULL GROUP BY ALL
""")
def read_json_files(spark, sf):
    item = F.concat(F.to_json(F.struct("text")), F.when(F.length("text") % 3 == 0, ",").otherwise(""))
    docs = readers.read_json_docs(spark, _files(spark, sf, item, "json"), "*.txt")
    text = F.when(F.col("error_code").isNull(), F.get_json_object("json", "$.text"))
    return docs.groupBy(text.alias("text"), F.col("error_code").isNull().alias("good")).agg(F.count("*").alias("n"))


@query("""
SELECT 'item' || length(text) || '@example.org' AS sender, text || chr(10) AS body, count(*) AS n FROM benchmark WHERE text IS NOT NULL GROUP BY ALL
""")
def read_mail_files(spark, sf):
    head = F.concat(F.lit("From: item"), F.length("text").cast("string"), F.lit("@example.org\nSubject: item\n\n"))
    found = mail.parse_emails(readers.read_emails(spark, _files(spark, sf, F.concat(head, F.col("text")), "mail"), "*.txt"))
    return found.filter("sender <> ''").groupBy("sender", F.col("text_body").alias("body")).agg(F.count("*").alias("n"))


@query("""
SELECT 'doc' || doc_id || '@example.org' AS sender, regexp_replace(text, '\\n+$', '') AS body, count(*) AS n FROM documents GROUP BY ALL
""")
def read_mailbox(spark, sf):
    """Every document as a message of a few large mail boxes, cut by bytes; lines that look like a message's first are quoted."""
    path = shared_dir(spark, "mailbox")
    sender = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("@example.org"))
    text = F.regexp_replace(F.col("text"), r"(?m)^(>*From )", ">$1")
    box = F.concat(F.lit("From "), sender, F.lit(" Mon Jan  1 10:00:00 2024\nFrom: "), sender, F.lit("\nSubject: document\n\n"), text, F.lit("\n"))
    V.table(spark, sf, "documents").select(box.alias("value")).write.text(path)
    found = readers.read_mailboxes(spark, path).where("error_code IS NULL").select(F.monotonically_increasing_id().alias("doc_id"), "raw")
    return mail.parse_emails(found).groupBy("sender", F.col("text_body").alias("body")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN n_chars % 3 <> 0 THEN text END AS text, n_chars % 3 <> 0 AS good, count(*) AS n FROM documents GROUP BY ALL
""")
def read_json_lines(spark, sf):
    """Every document as a line of JSON, every third one cut short."""
    path = shared_dir(spark, "json-lines")
    js = F.to_json(F.struct("text"))
    V.table(spark, sf, "documents").select(F.when(F.col("n_chars") % 3 == 0, F.substring(js, F.lit(1), F.length(js) - 1)).otherwise(js).alias("value")).write.text(path)
    good = F.col("error_code").isNull()
    docs = readers.read_json_lines(spark, path)
    return docs.groupBy(F.when(good, F.get_json_object("json", "$.text")).alias("text"), good.alias("good")).agg(F.count("*").alias("n"))
