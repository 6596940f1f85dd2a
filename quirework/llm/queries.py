"""One registered query per operator of this subpackage, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.session import materialise

from . import automata, bitplanes, decontam, langid, packing, pii, postings, simhash, suffixdedup, topk, turns, urlfilter, warc
from .common import table

HOST_RULES = (
    urlfilter.HostRule("block", "net"),
    urlfilter.HostRule("allow", "example.net", "/en/"),
    urlfilter.HostRule("block", "example.com", "/de/"),
    urlfilter.HostRule("allow", "org", "/fr/"),
)
#: Tracking addresses, and mobile copies of pages that exist elsewhere.
PATTERN_RULES = (
    urlfilter.PatternRule("allow", r"://www\.", ("www",)),
    urlfilter.PatternRule("block", r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed")),
    urlfilter.PatternRule("block", r"[?&]ref=x(&|#|$)", ("ref", "x")),
    urlfilter.PatternRule("block", r"://m\.[^/?#]*/es/", ("m", "es")),
    urlfilter.PatternRule("block", r"/(login|cart|checkout)(/|$)"),
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialise(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(archives, payloads=False).drop("payload")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.dedup_words(table(spark, sf_dir, "documents")).drop("spans")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(pii.KINDS) for x in (k, i)])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    ordered = lambda spans: F.transform(F.array_sort(spans), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), F.element_at(number, s["kind"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(pii.KINDS)).alias("no"), s["end"].alias("end"), F.lit("term").alias("kind")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(listed(ordered(base)).cast("binary"), 256).alias("base_sha256"),
        listed(ordered(F.concat(base, terms))).alias("spans"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 2))
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 2, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, HOST_RULES, PATTERN_RULES).drop("url")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    hit = F.aggregate(
        F.array_sort("spans"),
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: a["n"],
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op11_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    edited, report = turns.repair(turns.damaged(rows))
    counts = [c for c in report.columns if c != "conv_id"]
    parts = rows.select("conv_id").unionByName(report, allowMissingColumns=True).unionByName(turns.digests(edited), allowMissingColumns=True)
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitplanes.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.col("centroid").cast("binary"), 256)).drop("centroid")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_topk, op3_suffix_dedup, op4_simhash, op5_substring_dedup, op6_pii, op7_language_id, op8_packing, op9_url_filter, op10_decontaminate, op11_postings, op12_turns, op13_bitplanes, pipeline)
}

SQL: dict[str, str] = {}

SQL["op2_topk"] = """
WITH v AS (
    SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL["op9_url_filter"] = r"""
WITH p AS (
    SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
    SELECT *, CASE
        WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
        CASE
        WHEN regexp_matches(url, '://www\.') THEN '://www\.'
        WHEN regexp_matches(url, '[?&]utm_source=feed(&|#|$)') THEN '[?&]utm_source=feed(&|#|$)'
        WHEN regexp_matches(url, '[?&]ref=x(&|#|$)') THEN '[?&]ref=x(&|#|$)'
        WHEN regexp_matches(url, '://m\.[^/?#]*/es/') THEN '://m\.[^/?#]*/es/'
        WHEN regexp_matches(url, '/(login|cart|checkout)(/|$)') THEN '/(login|cart|checkout)(/|$)' END AS pattern
    FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
        WHEN pattern IS NULL OR pattern = '://www\.' THEN 'allow' ELSE 'block' END AS verdict
FROM r
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

SQL["op10_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
    FROM (SELECT *, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - least(10, len(w)) + 2))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dg AS (
    SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
m AS (SELECT r, i, bw.n, item_id FROM dg JOIN bw ON dg.n = bw.n AND dg.g = bw.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

SQL["op1_warc"] = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM d),
c AS (
    SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((list_sum(list_transform(range(0, 5),
        lambda j: (strpos('0123456789abcdef', substr(h, (i // 4) * 5 + j + 1, 1)) - 1) * CAST(power(16, 4 - j) AS BIGINT))) // CAST(power(32, 3 - i % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest
    FROM k
)
SELECT page_id, url, CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type, payload_digest,
    CAST(payload_bytes AS BIGINT) AS payload_bytes, CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM c
"""

SQL["op3_suffix_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, lower(hex(encode(coalesce(text, '')))) AS t FROM documents),
g AS (SELECT r, doc_id, i, substr(t, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, t, unnest(range(0, len(t) // 2 - 49)) AS i FROM d WHERE len(t) >= 100)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
b AS (SELECT DISTINCT r, i + j AS p FROM f, (SELECT unnest(range(0, 50)) AS j)),
n AS (SELECT r, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM b) GROUP BY r),
kept AS (
    SELECT r, string_agg(substr(t, 2 * i + 1, 2), '' ORDER BY i) AS k
    FROM (SELECT r, t, unnest(range(0, len(t) // 2)) AS i FROM d WHERE r IN (SELECT r FROM n)) c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = c.r AND b.p = c.i) GROUP BY r
)
SELECT doc_id, CAST(len(t) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN n.r IS NULL THEN t ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

SQL["op5_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
b AS (SELECT r, list(DISTINCT i + j) AS gone FROM f, (SELECT unnest(range(0, 13)) AS j) GROUP BY r),
k AS (
    SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE r IN (SELECT r FROM b)) c
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS i FROM b) z WHERE z.r = c.r AND z.i = c.i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(CASE WHEN b.r IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""


def _rounds(n: int) -> str:
    """Assignments and centroids of ``n`` rounds, each a step of the twin."""
    steps = []
    for i in range(n + 1):
        near = f"""
a{i} AS MATERIALIZED (
    SELECT r, any_value(vec_id) AS vec_id, min(d) AS d, arg_min(c, d * 16 + c) AS c
    FROM (SELECT r, vec_id, c, CAST(list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, k{i} k) GROUP BY r
)"""
        mean = f""",
m{i} AS (
    SELECT c, list(m ORDER BY i) AS e
    FROM (SELECT c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT c, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM a{i} JOIN v USING (r)) GROUP BY c, i) GROUP BY c
),
k{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.e, k.e) AS e FROM k{i} k LEFT JOIN m{i} m USING (c))"""
        steps.append(near + (mean if i < n else ""))
    return ",".join(steps)


SQL["op13_bitplanes"] = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
k0 AS MATERIALIZED (
    SELECT c, e FROM (SELECT e, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c FROM v) WHERE c < 16
),{_rounds(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(e, ',')) AS centroid_sha256
FROM a3 JOIN k3 USING (c)
"""
