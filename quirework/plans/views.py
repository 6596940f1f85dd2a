"""Tables of the document model derived from the given tables.

All views are narrow (row by row) or keyed by a unique column: none of them
gathers a document in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.units import STANDARD_SIZES
from quirework.operators.paginate import paginate

PER_PAGE = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, unchanged: filters and column choice reach the scan."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows carry much work (long texts), spread evenly.

    A file is cut at its row groups only, and a few of them may hold all long
    texts; Spark picks the number of partitions at run time, on tables of any size.
    """
    df = table(spark, sf, name)
    return (df.select(*columns) if columns else df).hint("rebalance")


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    return paginate(text_table(spark, sf, "documents", "doc_id", "text"), per_page=PER_PAGE)


def page_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_pages) straight from the line count: no shuffle."""
    n = F.size(F.split("text", "\n"))
    return table(spark, sf, "documents").select(
        "doc_id", (F.floor((n - 1) / F.lit(PER_PAGE)) + 1).cast("long").alias("n_pages")
    )


def conv_pages(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text"
    )


def conv_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles of four conversations: (bundle_id, file_no, doc_id, filename)."""
    return (
        table(spark, sf, "conversations")
        .filter("turn = 0")
        .select(
            F.floor(F.col("conv_id") / F.lit(4)).cast("long").alias("bundle_id"),
            (F.col("conv_id") % 4 + 1).alias("file_no"),
            F.col("conv_id").alias("doc_id"),
            F.format_string("conv_%d.v1.pdf", F.col("conv_id")).alias("filename"),
        )
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Page manifest: order keys are unique and dense, so 64 of them become one
    document of 24 and one of 40 pages by arithmetic alone."""
    k = F.col("o_orderkey")
    r = k % 64
    sizes = list(STANDARD_SIZES.values())
    i = (F.col("o_custkey") % len(sizes)).cast("int")
    w = F.get(F.array(*[F.lit(float(s[0])) for s in sizes]), i)
    h = F.get(F.array(*[F.lit(float(s[1])) for s in sizes]), i)
    turn = F.col("o_orderpriority") < "3"
    return table(spark, sf, "orders").select(
        (F.floor(k / F.lit(64)).cast("long") * 2 + F.when(r >= 24, 1).otherwise(0)).alias("doc_id"),
        (F.when(r < 24, r + 1).otherwise(r - 23)).cast("long").alias("page_no"),
        F.when(turn, h).otherwise(w).alias("width_pt"),
        F.when(turn, w).otherwise(h).alias("height_pt"),
        F.when(F.col("o_orderstatus") == "F", 90).when(F.col("o_orderstatus") == "P", 180).otherwise(0).alias("rotation"),
    )


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Positioned text, one item per line of a page."""
    lines = doc_pages(spark, sf).select(
        "doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("i", "str")
    )
    y = F.lit(800.0) - F.lit(14.0) * F.col("i")
    return lines.select(
        "doc_id",
        "page_no",
        F.col("i").cast("long").alias("item_no"),
        "str",
        F.array(F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(50.0), y).alias("transform"),
        (F.length("str") * F.lit(5.0)).alias("width"),
        F.lit(10.0).alias("height"),
        F.lit("Helvetica").alias("font_name"),
    )


def word_items(spark: SparkSession, sf: str) -> DataFrame:
    """Positioned text, one item per word; y wobbles by one point with the word
    index, upper-case first lines are larger and bold."""
    lines = doc_pages(spark, sf).select(
        "doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    words = lines.select(
        "doc_id", "page_no", "i", F.posexplode(F.split("line", " ")).alias("j", "str")
    )
    big = (F.col("i") == 0) & (F.col("str") == F.initcap("str"))
    size = F.when(big, F.lit(16.0)).otherwise(F.lit(10.0))
    y = F.lit(800.0) - F.lit(14.0) * F.col("i") - (F.col("j") % 2)
    return words.select(
        "doc_id",
        "page_no",
        (F.col("i").cast("long") * 1000000 + F.col("j")).alias("item_no"),
        "str",
        F.array(size, F.lit(0.0), F.lit(0.0), size, F.lit(50.0) + F.lit(60.0) * F.col("j"), y).alias("transform"),
        (F.length("str") * F.lit(5.0)).alias("width"),
        size.alias("height"),
        F.when(big, F.lit("Helvetica-Bold")).otherwise(F.lit("Helvetica")).alias("font_name"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per document with valid and broken bytes, by language and length."""
    d = text_table(spark, sf, "documents")
    ext = (
        F.when(F.col("lang") == "fr", "PDF").when(F.col("lang") == "de", "txt")
        .when(F.col("lang") == "es", "png").otherwise("pdf")
    )
    mime = (
        F.when(F.col("lang") == "de", "text/plain").when(F.col("lang") == "es", "image/png")
        .when(F.col("n_chars") % 3 == 0, "").otherwise("application/pdf")
    )
    head = (
        F.when(F.col("n_chars") % 7 == 0, "PK--1.4 ").when(F.col("n_chars") % 7 == 1, "%PDF-x.y")
        .otherwise("%PDF-1.7")
    )
    sig = F.when(
        F.col("n_chars") % 5 == 0,
        F.concat(
            F.lit("\n<< /Type /Sig /ByteRange [0 100 200 "), F.col("n_chars").cast("string"),
            F.lit("] /Prop << /Name (inner) >> /Contents <"), F.expr("repeat('00FFAA', IF(n_chars % 10 = 0, 4000, 1))"),
            F.lit("> /Reason (by "), F.col("source"), F.lit(") /M (D:20240102030405) >>\n"),
        ),
    ).otherwise("\n")
    tail = F.when(F.col("n_chars") % 4 == 0, "").otherwise("%%EOF\n")
    body = F.concat(head, F.lit("\n"), F.when(F.col("n_chars") % 6 == 0, "/Encrypt 1 0 R\n").otherwise(""), F.col("text"), sig, tail)
    return d.select(
        "doc_id",
        F.format_string("%s_%d.%s", F.col("source"), F.col("doc_id"), ext).alias("filename"),
        mime.alias("mime"),
        F.when(F.col("n_chars") % 11 == 0, 0).otherwise(F.col("n_chars") * 100000).cast("long").alias("size_bytes"),
        F.encode(body, "UTF-8").alias("content"),
        "lang",
        "source",
        "n_chars",
    )


def doc_meta(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 40).alias("title"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("source")).alias("author"),
        F.col("lang").alias("subject"),
        F.concat(F.col("lang"), F.lit(", "), F.col("source")).alias("keywords"),
        F.when(F.col("n_chars") > 1000, F.lit("writer")).otherwise(F.lit("")).alias("creator"),
        F.lit("maker").alias("producer"),
    )


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """A bookmark on every page whose text opens with a vowel, some on the same
    page or past the end; ordinals follow the page (three slots per page)."""
    p = doc_pages(spark, sf)
    first = F.lower(F.substring("text", 1, 1))
    marks = p.filter(first.isin("a", "e", "i", "o", "u"))
    return marks.select(
        "doc_id",
        F.col("page_no").alias("_p"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("s"), F.lit(1).alias("level"), F.col("page_no").alias("page_no")),
                F.struct(F.lit(1).alias("s"), F.lit(1).alias("level"), F.when(first == "a", F.col("page_no")).otherwise(F.col("page_no") + 1000).alias("page_no")),
                F.struct(F.lit(2).alias("s"), F.lit(2).alias("level"), F.col("page_no").alias("page_no")),
            )
        ).alias("m"),
        F.substring("text", 1, 20).alias("t"),
    ).select(
        "doc_id",
        (F.col("_p") * 3 + F.col("m.s")).alias("ordinal"),
        F.col("m.level").alias("level"),
        F.format_string("%s#%d", F.col("t"), F.col("m.s")).alias("title"),
        F.col("m.page_no").alias("page_no"),
    )


def specs(spark: SparkSession, sf: str) -> DataFrame:
    """A page specification per document, by language."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", "1-2, 4,9-7")
        .when(F.col("lang") == "fr", "odd")
        .when(F.col("lang") == "de", " 3-,2x, 5-1")
        .otherwise("")
        .alias("spec"),
    )


def label_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Three overlapping label rules per document."""
    rules = F.array(
        *[
            F.struct(
                F.lit(n).cast("long").alias("rule_no"), F.lit(r).alias("page_range"), F.lit(s).alias("style"),
                F.lit(p).alias("prefix"), F.lit(v).cast("long").alias("start_value"),
            )
            for n, r, s, p, v in ((1, "1-3,7-8", "r", "", 1), (2, "even", "D", "A-", 5), (3, "6-4", "A", "", 27))
        ]
    )
    return (
        table(spark, sf, "documents")
        .filter("lang <> 'es'")
        .select("doc_id", F.explode(rules).alias("r"))
        .select("doc_id", "r.*")
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    t = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("workflow_id"),
        F.col("ts").alias("start_ts"),
        F.floor(F.col("value")).cast("long").alias("duration_ms"),
        F.when(t == "error", "failed").when(t == "purchase", "completed").when(t == "view", "cancelled").otherwise("running").alias("status"),
    )


def eml(spark: SparkSession, sf: str) -> DataFrame:
    """A message per conversation turn: plain, HTML or multipart by role and turn, with every transfer encoding; of the multipart ones one
    in three is flat, one holds alternatives and an attached text, and one also an enclosed message of several parts."""
    c = text_table(spark, sf, "conversations")
    doc_id = F.col("conv_id") * 100 + F.col("turn")
    subj = F.concat(F.lit("=?utf-8?B?"), F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("?="))
    head = F.concat(
        F.lit("Subject:\r\n "), subj, F.lit("\r\nFrom: user"), F.col("conv_id").cast("string"),
        F.lit("@example.org\r\nTo: a@example.org,\r\n  b@example.org\r\nDate: Mon, 1 Jan 2024 10:00:0"),
        (F.col("turn") % 10).cast("string"), F.lit(" +0000\r\n"),
    )
    img = F.base64(F.encode("text", "UTF-8"))
    def b64(c: Column) -> Column:
        return F.base64(F.encode(c, "UTF-8"))

    def qp(c: Column) -> Column:
        return F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "=$1")

    odd = F.col("conv_id") % 2 == 1
    b64_head, qp_head = (F.lit(f"Content-Transfer-Encoding: {e}\r\n\r\n") for e in ("base64", "quoted-printable"))
    page = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))
    multi = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="b0"\r\n\r\n--b0\r\nContent-Type: text/plain; charset=utf-8\r\n'),
        # the line break before the boundary belongs to the part
        F.when(odd, F.concat(b64_head, b64(F.concat("text", F.lit("\n"))))).otherwise(F.concat(F.lit("\r\n"), F.col("text"))),
        F.lit('\r\n--b0\r\nContent-Type: text/html\r\n\r\n<p><img src="cid:pic1"> and <img src="cid:none"></p>\r\n--b0\r\nContent-Type: image/png; name="p.png"\r\nContent-ID: <pic1>\r\nContent-Transfer-Encoding: base64\r\n\r\n'),
        img,
        F.lit("\r\n--b0--\r\n"),
    )
    nested = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="b0"\r\n\r\nnot shown\r\n--b0\r\nContent-Type: multipart/alternative;\r\n boundary="b0.in"\r\n\r\n--b0.in\r\nContent-Type: text/plain; charset=utf-8\r\n'),
        F.when(odd, F.concat(qp_head, qp(F.col("text")))).otherwise(F.concat(F.lit("\r\n"), F.col("text"))),
        F.lit("\r\n--b0.in\r\nContent-Type: text/html\r\n\r\n"), page,
        F.lit('\r\n--b0.in--\r\n--b0\r\nContent-Type: text/plain; name="notes.txt"\r\nContent-Disposition: attachment; filename="notes.txt"\r\nContent-Transfer-Encoding: base64\r\n\r\n'),
        b64(F.col("text")),
        F.when(
            F.col("conv_id") % 3 == 2,
            F.concat(
                F.lit('\r\n--b0\r\nContent-Type: message/rfc822\r\n\r\nSubject: enclosed\r\nContent-Type: multipart/mixed; boundary="b0.fwd"\r\n\r\n--b0.fwd\r\nContent-Type: text/plain\r\n\r\n'),
                F.col("text"), F.lit("\r\n--b0.fwd--"),
            ),
        ).otherwise(""),
        F.lit("\r\n--b0--\r\n"),
    )
    multi = F.when(F.col("conv_id") % 3 == 0, multi).otherwise(nested)
    plain = F.when(odd, F.concat(qp_head, qp(F.col("text")))).otherwise(F.concat(F.lit("\r\n"), F.col("text")))
    web = F.concat(
        F.lit("Content-Type: text/html\r\n"),
        F.when(odd, F.concat(b64_head, b64(page))).otherwise(F.concat(F.lit("\r\n"), page)),
    )
    body = F.when(F.col("turn") % 3 == 2, multi).when(F.col("role") == "user", plain).otherwise(web)
    return c.select(doc_id.alias("doc_id"), F.concat(head, body).alias("raw"))


def flow_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen consecutive orders form one pipeline."""
    k = F.col("o_orderkey")
    fmt = F.when(F.col("o_orderstatus") == "F", "pdf").when(F.col("o_orderstatus") == "O", ".png").otherwise("txt")
    acc = F.when(F.col("o_orderpriority") < "3", F.array(F.lit(".pdf"), F.lit("PNG"))).otherwise(F.array(F.lit(".pdf")))
    return table(spark, sf, "orders").select(
        F.floor(k / F.lit(16)).cast("long").alias("flow_id"),
        k.alias("node_id"),
        fmt.alias("output_format"),
        acc.alias("accepted"),
        F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "processing").otherwise("idle").alias("status"),
        (F.col("o_custkey") % 101).alias("progress"),
        F.concat(F.lit("step "), F.col("o_orderpriority")).alias("label"),
    )


def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each step feeds the next of its pipeline unless it has status P; steps of
    large customers also feed the one after."""
    k = F.col("o_orderkey")
    hops = F.array(
        F.when((F.col("o_orderstatus") != "P") & (k % 16 < 15), F.lit(1)),
        F.when((F.col("o_totalprice") > 300000) & (k % 16 < 14), F.lit(2)),
    )
    return (
        table(spark, sf, "orders")
        .select(k.alias("source"), F.explode(hops).alias("hop"))
        .filter("hop IS NOT NULL")
        .select(
            F.floor(F.col("source") / F.lit(16)).cast("long").alias("flow_id"),
            (F.col("source") * 2 + F.col("hop") - 1).alias("edge_id"),
            (F.col("source") * 2 + F.col("hop") - 1).alias("edge_no"),
            "source",
            (F.col("source") + F.col("hop")).alias("target"),
        )
    )


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    p = text_table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        k.alias("pos"),
        F.col("p_name").alias("name"),
        F.lower(F.replace(F.concat_ws("-", "p_name", "p_type"), F.lit(" "), F.lit("-"))).alias("slug"),
        F.lower("p_type").alias("category"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("Part of "), F.col("p_brand"))).otherwise("").alias("description"),
        F.array(F.lower("p_type"), F.lower("p_brand")).alias("features"),
        F.array(k + 1, k + F.col("p_size") * 40).alias("related"),
        (F.col("p_size") == 1).alias("disabled"),
    )


def locale_json(spark: SparkSession, sf: str, local: bool) -> DataFrame:
    """Nested settings per customer; the local version lacks what its data lacks."""
    c = table(spark, sf, "customer")
    if local:
        seg = F.when(F.col("c_acctbal") > 0, F.lower("c_mktsegment"))
        extra = F.when(F.col("c_acctbal") > 5000, F.lit("vip"))
    else:
        seg, extra = F.lower("c_mktsegment"), F.lit(None).cast("string")
    deep = F.struct(F.struct(F.struct(F.col("c_custkey").alias("leaf")).alias("c")).alias("b"))
    return c.select(
        F.col("c_custkey").alias("doc_id"),
        F.to_json(
            F.struct(
                F.struct(F.col("c_name").alias("name"), seg.alias("segment"), extra.alias("level"), F.lit("{count} pages").alias("count")).alias("profile"),
                F.struct(F.struct(F.col("c_nationkey").cast("string").alias("nation"), deep.alias("far")).alias("home")).alias("place"),
                F.array(F.col("c_name"), F.lit("[x]")).alias("list"),
                F.lit("quire").alias("brand"),
            )
        ).alias("json"),
    )
