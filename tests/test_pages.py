"""Literal cases of page specifications, splitting, names and stamps."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quirework.functions import names as N
from quirework.functions import pagespec as P
from quirework.operators import pages, paginate, split
from quirework.operators.prefix import interval_join, number_rows, running


def doc(spark, n, doc_id=1):
    return spark.range(1, n + 1).select(F.lit(doc_id).cast("long").alias("doc_id"), F.col("id").alias("page_no"), F.lit("t").alias("text"))


def parts(df):
    return sorted((r.start_page, r.end_page) for r in split.part_ranges(df).collect())


@pytest.mark.parametrize(
    "text,want",
    [
        ("5", [(5, 5)]),
        ("1-5", [(1, 5)]),
        ("1,3,5", [(1, 1), (3, 3), (5, 5)]),
        ("1-3,5,7-10", [(1, 3), (5, 5), (7, 10)]),
        (" 1 - 3 , 5 ", [(1, 3), (5, 5)]),
        ("", []),
        ("a,2,b-c,4-x", [(2, 2)]),
        ("3x", [(3, 3)]),
    ],
)
def test_split_specification(spark, text, want):
    got = spark.createDataFrame([(text,)], ["s"]).select(P.spec_ranges(F.col("s"), "split").alias("r")).first().r
    assert [(r.lo, r.hi) for r in got] == want
    assert [(a, b) for a, b, _ in P.literal_ranges(text, "split")] == want


@pytest.mark.parametrize("total,n,want", [
    (10, 2, [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]),
    (10, 3, [(1, 3), (4, 6), (7, 9), (10, 10)]),
    (3, 1, [(1, 1), (2, 2), (3, 3)]),
    (3, 10, [(1, 3)]),
])
def test_split_every(spark, total, n, want):
    assert parts(split.split_every(doc(spark, total), n)) == want


@pytest.mark.parametrize("total,n,want", [
    (10, 3, [(1, 4), (5, 7), (8, 10)]), (9, 3, [(1, 3), (4, 6), (7, 9)]), (2, 5, [(1, 2)]), (4, 0, [(1, 4)]),
])
def test_split_n(spark, total, n, want):
    assert parts(split.split_n(doc(spark, total), n)) == want


def test_split_then_merge_is_identity(spark):
    whole = doc(spark, 11)
    cut = split.split_every(whole, 4)
    pieces = number_rows(cut, ["part_no"], ["page_no"], "_p").select(
        F.col("part_no").alias("doc_id"), F.col("_p").alias("page_no"), F.col("page_no").alias("old")
    )
    plan = pieces.select("doc_id").distinct().select(F.lit(1).cast("long").alias("bundle_id"), F.col("doc_id").alias("file_no"), "doc_id")
    back = pages.merge_docs(pieces, plan).collect()
    assert all(r.page_no == r.old for r in back) and len(back) == 11


def test_reverse_twice_is_identity(spark):
    d = doc(spark, 7).withColumn("k", F.col("page_no"))
    twice = pages.reverse_pages(pages.reverse_pages(d)).collect()
    assert len(twice) == 7 and all(r.page_no == r.k for r in twice)


def test_single_page_document_is_not_reversed(spark):
    assert pages.reverse_pages(doc(spark, 1)).count() == 0


def test_insert_blank_in_front_and_past_end(spark):
    m = doc(spark, 3).select("doc_id", "page_no", F.lit(10.0).alias("width_pt"), F.lit(20.0).alias("height_pt"), F.lit(0).alias("rotation"))
    got = sorted(r.page_no for r in pages.insert_blank(m, 0, 2).collect())
    assert got == [1, 2, 3, 4, 5]
    assert pages.insert_blank(m, 4, 1).count() == 0


def test_delete_keeps_order(spark):
    got = pages.delete_pages(doc(spark, 6).withColumn("k", F.col("page_no")), "2,4-5").orderBy("page_no").collect()
    assert [(r.page_no, r.k) for r in got] == [(1, 1), (2, 3), (3, 6)]


def test_lines_per_page_default():
    assert paginate.lines_per_page() == 39


def test_names(spark):
    row = spark.range(1).select(
        N.split_name(F.lit("doc.pdf"), F.lit(1), F.lit(5), F.lit(1), F.lit(1)).alias("a"),
        N.split_name(F.lit("doc.pdf"), F.lit(3), F.lit(3), F.lit(2), F.lit(4)).alias("b"),
        N.merge_name(F.lit("one.pdf"), F.lit("two.pdf"), F.lit(2)).alias("c"),
        N.merge_name(F.lit("one.pdf"), F.lit("two.pdf"), F.lit(3)).alias("d"),
        N.sanitize_filename(F.lit("../../etc/pa<ss>wd.txt ")).alias("e"),
        N.sanitize_filename(F.lit("")).alias("f"),
        N.ensure_extension(F.lit("a.TXT"), "pdf").alias("g"),
        N.sanitize_filename(F.concat(F.repeat(F.lit("x"), 300), F.lit(".PDF"))).alias("h"),
        N.safe_label(F.lit("  ")).alias("i"),
    ).first()
    assert (row.a, row.b) == ("doc_pages_1-5.pdf", "doc_part2_page_3.pdf")
    assert (row.c, row.d) == ("one_two_merged.pdf", "one_and_2_more_merged.pdf")
    assert (row.e, row.f, row.g) == ("etcpasswd.txt", "download", "a.pdf")
    assert len(row.h) == 200 and row.h.endswith(".pdf") and row.i == "workflow_node"


def test_running_total_equals_window_under_skew(spark):
    """A third of all rows under one key, blocks far smaller than the key."""
    random.seed(1)
    rows = [(1, p) for p in range(1, 400)] + [(k, p) for k in range(2, 10) for p in random.sample(range(1, 300), 100)]
    df = spark.createDataFrame(rows, "k long, p long").withColumn("v", F.col("p") % 7)
    blocks = [F.floor(F.col("p") / 64), F.floor(F.col("p") / 8)]
    got = running(df, ["k"], blocks, ["p"], F.col("v"), "b", "t").collect()
    want = {}
    for k in {r[0] for r in rows}:
        acc, ps = 0, sorted(p for kk, p in rows if kk == k)
        total = sum(p % 7 for p in ps)
        for p in ps:
            want[(k, p)] = (acc, total)
            acc += p % 7
    assert {(r.k, r.p): (r.b, r.t) for r in got} == want


def test_interval_join_equals_brute_force(spark):
    random.seed(2)
    pts = [(random.randint(1, 3), random.randint(1, 60)) for _ in range(200)]
    ivs = [(random.randint(1, 3), i, *sorted((random.randint(1, 60), random.randint(1, 60)))) for i in range(30)]
    got = interval_join(
        spark.createDataFrame(pts, "k long, p long"), spark.createDataFrame(ivs, "k long, i long, lo long, hi long"), ["k"], "p", "lo", "hi", size=8
    ).collect()
    want = sorted((k, p, i) for k, p in pts for kk, i, lo, hi in ivs if k == kk and lo <= p <= hi)
    assert sorted((r.k, r.p, r.i) for r in got) == want


def test_outline_collapses_and_introduces(spark):
    marks = [(1, 1, 1, "A", 3), (1, 2, 1, "B", 3), (1, 3, 1, "C", 5), (1, 4, 1, "out", 99), (1, 5, 2, "deep", 4)]
    o = spark.createDataFrame(marks, "doc_id long, ordinal long, level int, title string, page_no long")
    counts = spark.createDataFrame([(1, 6), (2, 4)], "doc_id long, n_pages long")
    got = sorted((r.doc_id, r.start_page, r.end_page, r.label) for r in split.outline_ranges(o, counts).collect())
    assert got == [(1, 1, 2, "Introduction"), (1, 3, 4, "B"), (1, 5, 6, "C"), (2, 1, 4, "Complete Document")]


def test_label_counts_continue_over_gaps(spark):
    rules = spark.createDataFrame([Row(doc_id=1, rule_no=1, page_range="1-2,5", style="r", prefix="p-", start_value=3)])
    got = {r.page_no: r.label for r in split.page_labels(doc(spark, 5), rules).collect()}
    assert got == {1: "p-iii", 2: "p-iv", 3: "3", 4: "4", 5: "p-v"}
