"""Pipeline definitions as rows: nodes, edges, checks and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.prefix import page_block, running


def _dotted(c):
    return F.lower(F.when(c.startswith("."), c).otherwise(F.concat(F.lit("."), c)))


def check_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with ``is_valid``: the source's output must be accepted by the target.

    ``nodes``: flow_id, node_id, output_format, accepted (array); ``edges``:
    flow_id, edge_id, source, target.
    """
    src = nodes.select("flow_id", F.col("node_id").alias("source"), "output_format")
    dst = nodes.select("flow_id", F.col("node_id").alias("target"), "accepted")
    out = F.col("output_format")
    return (
        edges.join(src, ["flow_id", "source"])
        .join(dst, ["flow_id", "target"])
        .withColumn("is_valid", F.exists("accepted", lambda f: _dotted(f) == _dotted(out)))
        .withColumn(
            "message",
            F.when(
                ~F.col("is_valid"),
                F.concat(
                    F.lit('Output format "'), out, F.lit('" is not compatible with accepted formats: '),
                    F.array_join("accepted", ", "),
                ),
            ),
        )
    )


def flow_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """is_input (no edge arrives), is_output (none leaves), is_orphan (neither)."""
    targets = edges.select("flow_id", F.col("target").alias("node_id")).distinct().withColumn("_in", F.lit(True))
    sources = edges.select("flow_id", F.col("source").alias("node_id")).distinct().withColumn("_out", F.lit(True))
    return (
        nodes.join(targets, ["flow_id", "node_id"], "left")
        .join(sources, ["flow_id", "node_id"], "left")
        .select(
            "flow_id", "node_id",
            F.col("_in").isNull().alias("is_input"),
            F.col("_out").isNull().alias("is_output"),
            (F.col("_in").isNull() & F.col("_out").isNull()).alias("is_orphan"),
        )
    )


def flow_warnings(roles: DataFrame) -> DataFrame:
    """Flows with several input nodes, or with none."""
    return (
        roles.groupBy("flow_id")
        .agg(F.count_if("is_input").alias("n_inputs"))
        .filter("n_inputs <> 1")
        .withColumn(
            "message",
            F.when(F.col("n_inputs") == 0, "Workflow has no input nodes.").otherwise(
                F.format_string("Workflow has %d input nodes.", F.col("n_inputs"))
            ),
        )
    )


def flow_progress(nodes: DataFrame) -> DataFrame:
    """Percentage done per flow: complete counts 100, processing its own share."""
    done = F.when(F.col("status") == "complete", F.lit(100.0)).when(
        F.col("status") == "processing", F.col("progress").cast("double")
    ).otherwise(0.0)
    return nodes.groupBy("flow_id").agg(
        F.floor(F.sum(done) / F.count("*") + 0.5).cast("long").alias("progress")
    )


def gather_inputs(nodes: DataFrame, edges: DataFrame, outputs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Files a node receives: its parents' outputs in edge order, or its own
    assigned files when it has no parent.

    ``outputs`` and ``assigned``: flow_id, node_id, file_no, filename.
    """
    parents = edges.select("flow_id", "edge_no", F.col("source").alias("_src"), F.col("target").alias("node_id"))
    fed = parents.join(
        outputs.withColumnRenamed("node_id", "_src"), ["flow_id", "_src"]
    ).select("flow_id", "node_id", "edge_no", "file_no", "filename")
    roots = nodes.join(parents.select("flow_id", "node_id").distinct(), ["flow_id", "node_id"], "left_anti")
    own = assigned.join(roots.select("flow_id", "node_id"), ["flow_id", "node_id"], "left_semi").select(
        "flow_id", "node_id", F.lit(0).cast("long").alias("edge_no"), "file_no", "filename"
    )
    both = fed.unionByName(own)
    return running(
        both, ["flow_id", "node_id"],
        [page_block("edge_no"), F.col("edge_no"), page_block("file_no")],
        ["edge_no", "file_no"], before="_n",
    ).select("flow_id", "node_id", (F.col("_n") + 1).cast("long").alias("input_no"), "filename")


def expand_templates(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Template rows with nested nodes and edges -> (node rows, edge rows)."""
    nodes = templates.select("flow_id", F.posexplode("nodes").alias("node_no", "n")).select(
        "flow_id", "node_no", "n.*"
    )
    edges = templates.select("flow_id", F.posexplode("edges").alias("edge_no", "e")).select(
        "flow_id", "edge_no", "e.*"
    )
    return nodes, edges


FLOW_SCHEMA = (
    "name string, nodes array<struct<id:string,type:string,data:struct<toolId:string,label:string,"
    "acceptedFormats:array<string>,outputFormat:string>>>, "
    "edges array<struct<id:string,source:string,target:string>>"
)


def validate_flows(flows: DataFrame, column: str = "json") -> DataFrame:
    """(flow_id, message): the first failing rule of an imported definition, or null."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    j = flows.withColumn("_j", F.from_json(column, FLOW_SCHEMA))
    nodes, edges = F.col("_j.nodes"), F.col("_j.edges")
    ids = F.transform(nodes, lambda n: n["id"])
    bad_node = F.exists(nodes, lambda n: blank(n["id"]) | blank(n["type"]) | n["data"].isNull())
    bad_data = F.exists(nodes, lambda n: blank(n["data"]["toolId"]) | blank(n["data"]["label"]))
    bad_fmt = F.exists(
        nodes, lambda n: n["data"]["acceptedFormats"].isNull() | n["data"]["outputFormat"].isNull()
    )
    bad_edge = F.exists(edges, lambda e: blank(e["id"]) | blank(e["source"]) | blank(e["target"]))
    dangling = F.exists(
        edges, lambda e: ~F.array_contains(ids, e["source"]) | ~F.array_contains(ids, e["target"])
    )
    msg = (
        F.when(
            F.col("_j").isNull() | blank(F.col("_j.name")) | nodes.isNull() | edges.isNull(),
            "Invalid workflow file format",
        )
        .when(bad_node, "Invalid node structure: missing id, type, or data")
        .when(bad_data, "Invalid node data: missing toolId or label")
        .when(bad_fmt, "Invalid node data: missing acceptedFormats or outputFormat")
        .when(bad_edge, "Invalid edge structure: missing id, source, or target")
        .when(dangling, "Invalid edge: references non-existent node")
    )
    return j.select("flow_id", msg.alias("message"))


def failure_context(errors: DataFrame) -> DataFrame:
    """Failed node, message and whether the user cancelled."""
    msg = F.coalesce("error_message", F.lit("Unknown error occurred"))
    return errors.select(
        "run_id",
        F.coalesce(
            F.when(F.col("error_node") != "", F.col("error_node")), F.col("current_node"), F.lit("")
        ).alias("failed_node"),
        msg.alias("message"),
        msg.rlike("(?i)cancelled by user").alias("is_cancelled"),
    )
