"""Queries over pipelines, run logs, catalogues and key tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import fuzzy as Z
from quirework.functions import names as N
from quirework.functions import units as U
from quirework.operators import catalogue as C
from quirework.operators import flow, runs
from quirework.plans import sqlviews as S
from quirework.plans import views as V
from quirework.plans.registry import query, r6

# ---- pipelines ----------------------------------------------------------------


@query(f"""
WITH {S.FLOWS}, j AS (SELECT e.*, s.output_format AS o, t.accepted AS a FROM flow_edges e JOIN flow_nodes s ON s.node_id = e.source JOIN flow_nodes t ON t.node_id = e.target)
SELECT flow_id, edge_id, len(list_filter(a, lambda f: ltrim(f, '.') = ltrim(o, '.'))) > 0 AS is_valid FROM j
""")
def check_edges(spark, sf):
    return flow.check_edges(V.flow_nodes(spark, sf), V.flow_edges(spark, sf)).select("flow_id", "edge_id", "is_valid")


@query(f"""
WITH {S.FLOWS} SELECT flow_id, node_id, node_id NOT IN (SELECT target FROM flow_edges) AS is_input, node_id NOT IN (SELECT source FROM flow_edges) AS is_output,
  node_id NOT IN (SELECT target FROM flow_edges) AND node_id NOT IN (SELECT source FROM flow_edges) AS is_orphan FROM flow_nodes
""")
def flow_roles(spark, sf):
    return flow.flow_roles(V.flow_nodes(spark, sf), V.flow_edges(spark, sf))


@query(f"""
WITH {S.FLOWS} SELECT flow_id, count(*) AS n_inputs, 'Workflow has ' || count(*) || ' input nodes.' AS message FROM flow_nodes
WHERE node_id NOT IN (SELECT target FROM flow_edges) GROUP BY 1 HAVING count(*) > 1
""")
def flow_warnings(spark, sf):
    return flow.flow_warnings(flow.flow_roles(V.flow_nodes(spark, sf), V.flow_edges(spark, sf)))


@query(f"""
WITH {S.FLOWS} SELECT flow_id, CAST(floor(sum(CASE status WHEN 'complete' THEN 100 WHEN 'processing' THEN progress ELSE 0 END) / count(*) + 0.5) AS BIGINT) AS progress FROM flow_nodes GROUP BY 1
""")
def flow_progress(spark, sf):
    return flow.flow_progress(V.flow_nodes(spark, sf))


@query(f"""
WITH {S.FLOWS}, f AS (SELECT flow_id, e.target AS node_id, e.edge_no, x.k AS file_no, 'out' || e.source || '_' || x.k AS filename FROM flow_edges e, (VALUES (1), (2)) x(k)
  UNION ALL SELECT flow_id, node_id, 0, 1, 'own' || node_id FROM flow_nodes WHERE node_id NOT IN (SELECT target FROM flow_edges))
SELECT flow_id, node_id, row_number() OVER (PARTITION BY node_id ORDER BY edge_no, file_no) AS input_no, filename FROM f
""")
def gather_inputs(spark, sf):
    nodes = V.flow_nodes(spark, sf)
    outs = nodes.select(
        "flow_id", "node_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("file_no")
    ).withColumn("filename", F.format_string("out%d_%d", "node_id", "file_no"))
    own = nodes.select("flow_id", "node_id", F.lit(1).cast("long").alias("file_no"), F.format_string("own%d", "node_id").alias("filename"))
    return flow.gather_inputs(nodes, V.flow_edges(spark, sf), outs, own)


@query(f"""
WITH {S.FLOWS} SELECT node_id, k - 1 AS i, CASE WHEN progress % 4 = 0 THEN 'm' || k || '.pdf' WHEN progress % 4 = 1 THEN 'c' || k || '.pdf'
  WHEN progress % 4 = 2 THEN 'one.v_' || k || '.pdf' ELSE replace(label, ' ', '_') || '_output_' || k || '.pdf' END AS name FROM flow_nodes, (VALUES (1), (2), (3)) x(k)
""")
def node_output_names(spark, sf):
    n = V.flow_nodes(spark, sf)
    m = F.col("progress") % 4
    meta_names = F.when(m == 0, F.array(F.lit("m1.pdf"), F.lit(" m2.pdf"), F.lit("m3.pdf"))).otherwise(F.array(F.lit("x.pdf")))
    fname = F.when(m == 1, "c1.pdf, c2.pdf,c3.pdf").when(m == 2, "one.v.pdf").otherwise("")
    return n.select("node_id", F.posexplode(N.node_output_names(F.lit(3), meta_names, fname, F.col("label"))).alias("i", "name"))


@query("""
SELECT event_id AS run_id, CASE event_type WHEN 'error' THEN 'n' || user_id WHEN 'view' THEN 'cur' ELSE '' END AS failed_node,
  CASE WHEN event_type = 'click' THEN 'Unknown error occurred' WHEN event_type = 'view' THEN 'Run CANCELLED by User now' ELSE event_type END AS message,
  event_type = 'view' AS is_cancelled FROM events
""")
def failure_context(spark, sf):
    t = F.col("event_type")
    e = V.table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"),
        F.when(t == "error", F.concat(F.lit("n"), F.col("user_id").cast("string"))).otherwise("").alias("error_node"),
        F.when(t == "view", "cur").alias("current_node"),
        F.when(t == "view", "Run CANCELLED by User now").when(t != "click", t).alias("error_message"),
    )
    return flow.failure_context(e)


def _definitions(spark, sf):
    """A pipeline definition as JSON per order; some lack a part or point nowhere."""
    o = V.table(spark, sf, "orders")
    st, price = F.col("o_orderstatus"), F.col("o_totalprice")
    label = F.when(price < 50000, F.lit("")).otherwise(F.col("o_orderpriority"))
    target = F.when(price > 400000, F.lit("n9")).otherwise(F.lit("n2"))
    node = lambda i: F.concat(
        F.lit('{"id":"' + i + '","type":"tool","data":{"toolId":"t","label":"'), label,
        F.lit('","acceptedFormats":[".pdf"],"outputFormat":".pdf"}}'),
    )
    return o.select(
        F.col("o_orderkey").alias("flow_id"),
        F.concat(
            F.lit("{"), F.when(st == "P", F.lit("")).otherwise(F.lit('"name":"x",')),
            F.lit('"nodes":['), node("n1"), F.lit(","), node("n2"),
            F.lit('],"edges":[{"id":"e1","source":"n1","target":"'), target, F.lit('"}]}'),
        ).alias("json"),
    )


@query("""
SELECT o_orderkey AS flow_id, CASE WHEN o_orderstatus = 'P' THEN 'Invalid workflow file format' WHEN o_totalprice < 50000 THEN 'Invalid node data: missing toolId or label'
  WHEN o_totalprice > 400000 THEN 'Invalid edge: references non-existent node' END AS message FROM orders
""")
def validate_flows(spark, sf):
    return flow.validate_flows(_definitions(spark, sf))


@query("""
SELECT 'node' AS item, o_orderkey AS flow_id, k AS item_no, CASE k WHEN 0 THEN 'n1' ELSE 'n2' END AS id FROM orders, (VALUES (0), (1)) x(k)
UNION ALL SELECT 'edge', o_orderkey, 0, 'e1' FROM orders
""")
def expand_templates(spark, sf):
    t = _definitions(spark, sf).select("flow_id", F.from_json("json", flow.FLOW_SCHEMA).alias("j")).select("flow_id", "j.nodes", "j.edges")
    nodes, edges = flow.expand_templates(t)
    return nodes.select(F.lit("node").alias("item"), "flow_id", F.col("node_no").alias("item_no"), "id").unionByName(
        edges.select(F.lit("edge").alias("item"), "flow_id", F.col("edge_no").alias("item_no"), "id")
    )


# ---- run logs -----------------------------------------------------------------

_STATS = """count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled,
  round(coalesce(avg(duration_ms) FILTER (status = 'completed' AND duration_ms <> 0), 0), 6) AS avg_duration, round(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*), 6) AS success_rate"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("avg_duration", "success_rate")})


@query(f"WITH {S.RUNS} SELECT {_STATS} FROM runs")
def run_stats(spark, sf):
    return _rounded(runs.run_stats(V.runs(spark, sf)))


@query(f"WITH {S.RUNS} SELECT workflow_id, {_STATS} FROM runs GROUP BY 1")
def run_stats_by_workflow(spark, sf):
    return _rounded(runs.run_stats(V.runs(spark, sf), "workflow_id"))


@query("""
SELECT user_id, count(*) AS n_files, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed,
  CAST(floor(sum(CASE WHEN event_type = 'purchase' THEN 100 ELSE CAST(floor(value) AS BIGINT) % 100 END) / count(*) + 0.5) AS BIGINT) AS progress FROM events GROUP BY 1
""")
def batch_summary(spark, sf):
    t = F.col("event_type")
    b = V.table(spark, sf, "events").select(
        "user_id",
        F.when(t == "purchase", "completed").when(t == "error", "error").otherwise("processing").alias("status"),
        F.when(t == "purchase", 100).otherwise(F.floor("value") % 100).alias("progress"),
    )
    return runs.batch_summary(b, "user_id")


def _vitals(spark, sf, *more):
    t = F.col("event_type")
    metric = F.when(t == "click", "INP").when(t == "view", "LCP").when(t == "error", "FID").when(t == "signup", "TTFB").otherwise("CLS")
    v = F.col("value")
    return V.table(spark, sf, "events").select(
        *more, metric.alias("metric"), F.when(t == "view", v * 20).when(t == "purchase", v / 1000).when(t == "signup", v * 10).otherwise(v * 4).alias("value")
    )


_VITALS = """s AS (SELECT CASE event_type WHEN 'click' THEN 'INP' WHEN 'view' THEN 'LCP' WHEN 'error' THEN 'FID' WHEN 'signup' THEN 'TTFB' ELSE 'CLS' END AS metric,
  CASE event_type WHEN 'view' THEN value * 20 WHEN 'purchase' THEN value / 1000 WHEN 'signup' THEN value * 10 ELSE value * 4 END AS value FROM events),
b(metric, good, fair) AS (VALUES ('LCP', 2500, 4000), ('FID', 100, 300), ('CLS', 0.1, 0.25), ('FCP', 1800, 3000), ('TTFB', 800, 1800), ('INP', 200, 500))"""


@query(f"""
WITH {_VITALS} SELECT metric, CASE WHEN value <= good THEN 'good' WHEN value <= fair THEN 'needs-improvement' ELSE 'poor' END AS rating, count(*) AS n, round(max(value), 6) AS worst
FROM s JOIN b USING (metric) GROUP BY ALL
""")
def vitals_summary(spark, sf):
    return runs.vitals_summary(_vitals(spark, sf)).withColumn("worst", F.round("worst", 6))


@query(f"""
WITH {_VITALS} SELECT metric, round(quantile_disc(value, 0.75), 6) AS p75 FROM s GROUP BY metric
""")
def vitals_percentile(spark, sf):
    """Exact while a metric has fewer samples than the sketch has places."""
    return runs.vitals_percentile(_vitals(spark, sf)).select("metric", F.round("p", 6).alias("p75"))


@query(f"""
WITH {_VITALS}, q AS (SELECT metric, quantile_disc(value, 0.72) AS lo, quantile_disc(value, 0.78) AS hi FROM s GROUP BY metric)
SELECT metric, count(*) AS n, true AS near FROM s JOIN q USING (metric) GROUP BY metric
""")
def vitals_percentile_merged(spark, sf):
    """Hourly sketches merged to days and days to one: within three hundredths of the rank of the exact percentile."""
    at = V.table(spark, sf, "events").select("event_id", "ts")
    s = _vitals(spark, sf, "event_id").join(at, "event_id").select("metric", "ts", "value")
    hours = runs.vitals_sketches(s)
    days = runs.merge_sketches(hours.withColumn("day", F.to_date("window_start")), ["metric", "day"])
    found = runs.sketch_percentile(runs.merge_sketches(days, ["metric"]))
    exact = s.groupBy("metric").agg(F.percentile("value", F.array(F.lit(0.72), F.lit(0.78))).alias("b"))
    near = F.col("p").between(F.col("b")[0], F.col("b")[1])
    return found.join(exact, "metric").select("metric", F.col("n").cast("long").alias("n"), near.alias("near"))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1
""")
def latest_run(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return runs.latest(e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
WITH l AS (SELECT user_id AS name, event_type AS tool, max(event_id) AS id, max(ts) AS processed_ts FROM events GROUP BY ALL)
SELECT name, tool, id FROM l ORDER BY processed_ts DESC, id DESC LIMIT 10
""")
def recent_files(spark, sf):
    e = V.table(spark, sf, "events").select(
        F.col("user_id").alias("name"), F.col("event_type").alias("tool"), F.col("event_id").alias("id"), F.col("ts").alias("processed_ts")
    )
    return runs.recent(e, 10).select("name", "tool", "id")


@query("""
SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50
""")
def retain_last(spark, sf):
    e = V.table(spark, sf, "events").select("event_type", "event_id", "ts")
    return runs.retain(e, 50, ["event_type"], ["ts", "event_id"]).select("event_type", "event_id")


@query(f"WITH {S.CATALOGUE} SELECT id, name FROM catalogue WHERE contains(lower(name), 'ring') OR contains(lower(description), 'ring') OR contains(lower(slug), 'ring')")
def search_flows(spark, sf):
    return runs.search_flows(V.catalogue(spark, sf), "RING", ("name", "description", "slug")).select("id", "name")


@query("""
WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS start_ts FROM orders),
u AS (SELECT l_orderkey AS id, max(l_shipdate) AS end_ts, arg_max(CASE WHEN l_returnflag = 'R' THEN 'failed' END, CASE WHEN l_returnflag = 'R' THEN (l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) END) AS status FROM lineitem GROUP BY 1)
SELECT r.id, coalesce(u.status, r.status) AS status, u.end_ts, epoch_ms(u.end_ts) - epoch_ms(r.start_ts) AS duration_ms FROM r LEFT JOIN u USING (id)
""")
def complete_runs(spark, sf):
    r = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("start_ts"),
        F.lit(None).cast("long").alias("duration_ms"),
    )
    u = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("seq"),
        F.col("l_shipdate").alias("end_ts"),
        F.when(F.col("l_returnflag") == "R", "failed").alias("status"),
    )
    return runs.complete_runs(r, u).select("id", "status", "end_ts", "duration_ms")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def remove_by_key(spark, sf):
    gone = V.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return runs.remove(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), gone)


@query("SELECT o_orderkey AS id, o_custkey AS name FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
def projects_by_tool(spark, sf):
    p = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("tool"),
        (F.col("o_orderstatus") == "O").alias("in_progress"), F.col("o_orderdate").alias("updated_ts"),
    )
    return runs.projects_by(p, tool="1-URGENT", in_progress=True).select("id", "name")


# ---- catalogue ----------------------------------------------------------------


@query(f"""
WITH {S.CATALOGUE}, s AS (SELECT id, lower(name) AS t FROM catalogue),
r AS (SELECT id, {S.fuzzy_sql("'small rod'", "t")} AS a, {S.fuzzy_sql("'gt'", "t")} AS b, {S.fuzzy_sql("'rdwxgt'", "t")} AS c FROM s)
SELECT id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM r
""")
def fuzzy_scores(spark, sf):
    n = F.col("name")
    return V.catalogue(spark, sf).select(
        "id", *[r6(Z.fuzzy_score(F.lit(q), n), k) for k, q in (("a", " Small rod"), ("b", "gt"), ("c", "rdwxgt"))]
    )


def _scored(q: str) -> str:
    lit = f"'{q}'"
    f = lambda t: S.fuzzy_sql(lit, t)
    return f"""{S.CATALOGUE}, n AS (SELECT *, lower(name) AS tn, lower(replace(slug, '-', ' ')) AS ts, lower(description) AS td, replace(features[1], '-', ' ') AS f1, replace(features[2], '-', ' ') AS f2 FROM catalogue),
c AS (SELECT *, {f("tn")} AS sn, {f("ts")} AS ss, CASE WHEN td = '' THEN 0 ELSE {f("td")} END AS sd, greatest({f("f1")}, {f("f2")}) AS sf FROM n),
scored AS (SELECT *, greatest(sn, ss, sd, sf) AS score, CASE WHEN sn = greatest(sn, ss, sd, sf) THEN 'name' WHEN greatest(ss, sd) = greatest(sn, ss, sd, sf) THEN 'description' ELSE 'features' END AS matched_field FROM c)"""


@query(f"WITH {_scored('red promo')} SELECT id, round(score, 6) AS score, matched_field FROM scored WHERE score >= 0.1")
def ranked_search(spark, sf):
    return C.search(V.catalogue(spark, sf), "red promo").select("id", F.round("score", 6).alias("score"), "matched_field")


@query(f"WITH {_scored('brand#17')} SELECT pos, name, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, pos LIMIT 5")
def suggestions(spark, sf):
    return C.suggest(V.catalogue(spark, sf), "Brand#17", 5).select("pos", "name", F.round("score", 6).alias("score"))


@query(f"""
WITH {_scored('promo')} SELECT id FROM scored WHERE contains(tn, 'promo') OR contains(ts, 'promo') OR contains(td, 'promo') OR contains(f1, 'promo') OR contains(f2, 'promo') OR sn >= 0.3
""")
def matches_query(spark, sf):
    return C.matches_query(V.catalogue(spark, sf), "Promo").select("id")


@query(f"""
WITH {S.CATALOGUE} SELECT 'slug' AS how, id, 0 AS rank FROM catalogue WHERE slug = 'red-widget-economy' AND NOT disabled
UNION ALL SELECT 'category', id, 0 FROM catalogue WHERE category = 'promo' AND NOT disabled
UNION ALL SELECT 'popular', id, CASE id WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 3 END FROM catalogue WHERE id IN (7, 3, 11) AND NOT disabled
UNION ALL SELECT 'id', id, 0 FROM catalogue WHERE id = 5 AND NOT disabled
""")
def catalogue_lookups(spark, sf):
    c = V.catalogue(spark, sf)
    zero = F.lit(0).cast("long")
    pick = lambda df, how, rank=zero: df.select(F.lit(how).alias("how"), "id", rank.alias("rank"))
    return (
        pick(C.by_slug(c, "red-widget-economy"), "slug")
        .unionByName(pick(C.by_category(c, "promo"), "category"))
        .unionByName(pick(C.popular(c, [7, 3, 11]), "popular", F.col("rank")))
        .unionByName(pick(C.by_id(c, 5), "id"))
    )


@query(f"WITH {S.CATALOGUE} SELECT category, count(*) AS n FROM catalogue WHERE NOT disabled GROUP BY ROLLUP (category)")
def category_counts(spark, sf):
    return C.category_counts(V.catalogue(spark, sf))


@query(f"""
WITH {S.CATALOGUE}, l AS (SELECT id, unnest(related) AS related_id FROM catalogue)
SELECT l.id, related_id, c.name AS related_name FROM l JOIN catalogue c ON c.id = related_id AND NOT c.disabled
""")
def related_tools(spark, sf):
    return C.related(V.catalogue(spark, sf))


@query(f"""
WITH {S.CATALOGUE}, l AS (SELECT id, unnest(related) AS related_id FROM catalogue) SELECT id, related_id FROM l WHERE related_id NOT IN (SELECT id FROM catalogue)
""")
def dangling_related(spark, sf):
    return C.dangling_related(V.catalogue(spark, sf))


_KEYS_BASE = """base AS (SELECT c_custkey AS doc_id, k.path, k.value FROM customer, LATERAL (VALUES ('profile.name', c_name), ('profile.segment', lower(c_mktsegment)),
  ('place.home.nation', '' || c_nationkey), ('profile.count', '{count} pages'), ('place.home.far.b.c.leaf', '' || c_custkey), ('list.0', c_name), ('list.1', '[x]'), ('brand', 'quire')) k(path, value))"""
_KEYS_LOCAL = """local AS (SELECT * FROM (SELECT c_custkey AS doc_id, k.path, k.value FROM customer, LATERAL (VALUES ('profile.name', c_name),
  ('profile.segment', CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) END), ('profile.level', CASE WHEN c_acctbal > 5000 THEN 'vip' END), ('place.home.nation', '' || c_nationkey), ('profile.count', '{count} pages'), ('place.home.far.b.c.leaf', '' || c_custkey), ('list.0', c_name), ('list.1', '[x]'), ('brand', 'quire')) k(path, value)) WHERE value IS NOT NULL)"""


@query(f"WITH {_KEYS_LOCAL} SELECT doc_id, path, value FROM local")
def flatten_keys(spark, sf):
    return C.flatten_keys(V.locale_json(spark, sf, True))


@query(f"""
WITH {_KEYS_BASE}, {_KEYS_LOCAL} SELECT doc_id, path, CASE WHEN l.value IS NULL THEN 'missing' WHEN b.value IS NULL THEN 'extra' ELSE 'untranslated' END AS issue
FROM base b FULL JOIN local l USING (doc_id, path) WHERE l.value IS NULL OR b.value IS NULL OR (b.value = l.value AND path <> 'brand')
""")
def audit_keys(spark, sf):
    base = C.flatten_keys(V.locale_json(spark, sf, False))
    local = C.flatten_keys(V.locale_json(spark, sf, True))
    return C.audit_keys(base, local, ("doc_id", "path"))


@query(f"""
WITH {_KEYS_BASE}, {_KEYS_LOCAL}, k AS (SELECT doc_id, path FROM base UNION ALL SELECT c_custkey, 'profile.level' FROM customer)
SELECT doc_id, path, coalesce(l.value, b.value, path) AS value FROM k LEFT JOIN local l USING (doc_id, path) LEFT JOIN base b USING (doc_id, path)
""")
def lookup_with_fallback(spark, sf):
    base = C.flatten_keys(V.locale_json(spark, sf, False))
    local = C.flatten_keys(V.locale_json(spark, sf, True))
    level = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("profile.level").alias("path"))
    return C.lookup_with_fallback(base.select("doc_id", "path").unionByName(level), local, base, ("doc_id", "path"))


@query(f"WITH {_VITALS} SELECT metric, value > 0 AS positive, count(*) AS n FROM s GROUP BY ALL")
def vitals_samples(spark, sf):
    s = _vitals(spark, sf).withColumn("rating", U.rating(F.col("metric"), F.col("value")))
    return s.filter("rating IS NOT NULL").groupBy("metric", (F.col("value") > 0).alias("positive")).agg(F.count("*").alias("n"))
