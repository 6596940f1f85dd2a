"""Tables, Markdown, HTML, mail, files, readers, sinks and streams on small input."""

import datetime
import json
import random

import numpy as np
from pyspark.sql import functions as F

from quirework.operators import catalogue, files, find, html, mail, meta, runs, tables
from quirework.sources import readers, writers
from quirework.streaming import jobs


def items(spark, rows, font="Helvetica", size=10.0):
    """rows: (str, x, y) on one page."""
    data = [(1, 1, i, s, [size, 0.0, 0.0, size, float(x), float(y)], 5.0 * len(s), size, font) for i, (s, x, y) in enumerate(rows)]
    return spark.createDataFrame(
        data, "doc_id long, page_no long, item_no long, str string, transform array<double>, width double, height double, font_name string"
    )


def test_table_with_heading_and_ragged_row(spark):
    grid = [("Title", 50, 700), ("Name", 50, 680), ("Qty", 150, 680), ("Note", 250, 681)]
    grid += [("a", 50, 660), ("1", 150, 660), ("x,y", 250, 660), ("b", 51, 640), ("2", 149, 640)]
    t = tables.detect_tables(items(spark, grid))
    row = t.first()
    assert row.rows == [["Name", "Qty", "Note"], ["a", "1", "x,y"], ["b", "2", ""]]
    assert (row.start_y, row.end_y) == (680.0, 640.0)
    assert writers.table_csv(t, False).first().text == 'Name,Qty,Note\na,1,"x,y"\nb,2,\n\n'
    js = json.loads(writers.table_json(t).first().text)
    assert js["rows"][1] == {"Name": "b", "Qty": "2", "Note": ""}
    assert writers.table_markdown(t, False).first().text.splitlines()[4] == "| a | 1 | x,y |"


def test_duplicate_and_blank_headers(spark):
    t = spark.createDataFrame([(1, 1, 1, [["h", "", "h"], ["1", "2", "3"]])], "doc_id long, page_no long, table_no long, rows array<array<string>>")
    assert json.loads(writers.table_json(t).first().text)["rows"] == [{"column_2": "2", "h": "3"}]


def test_first_fit_is_not_a_bucket(spark):
    # 100 opens a line; 104 joins it; 108 is 8 away from the opener and opens another
    lines = tables.group_lines(items(spark, [("a", 10, 100), ("b", 20, 104), ("c", 30, 108), ("d", 5, 105)]))
    got = {r.y: [i.str for i in r["items"]] for r in lines.collect()}
    assert got == {100.0: ["a", "b"], 108.0: ["d", "c"]}


def test_markdown_of_a_page(spark):
    rows = [("Report", 50, 800), ("First part of", 50, 780), ("a paragraph.", 50, 766), ("• one", 50, 740), ("2) two", 50, 720), ("", 50, 700), ("end", 50, 680)]
    df = items(spark, rows)
    df = df.withColumn("height", F.when(F.col("str") == "Report", 30.0).otherwise(F.col("height")))
    md = tables.lines_to_markdown(tables.group_lines(df)).first().markdown
    assert md == "# Report\n\nFirst part of a paragraph.\n- one\n2. two\n\nend"


def test_markdown_code_and_emphasis(spark):
    body = items(spark, [("plain text here and so on, long enough to stay body.", 50, 800)])
    code = items(spark, [("x = 1", 50, 700), ("y = 2", 50, 680)], "Courier").withColumn("item_no", F.col("item_no") + 10)
    ital = items(spark, [("slanted words, many of them.", 50, 640)], "Times-Italic").withColumn("item_no", F.col("item_no") + 20)
    md = tables.lines_to_markdown(tables.group_lines(body.unionByName(code).unionByName(ital))).first().markdown
    assert "```\nx = 1\ny = 2\n```" in md and "*slanted words, many of them.*" in md


def test_markdown_tables_of_any_length():
    xs = [np.array([10.0, 80.0, 150.0])] * 150 + [np.array([10.0])] * 3 + [np.array([400.0])]
    texts = [np.array([f"r{i}", "b", "c"], dtype=object) for i in range(150)]
    texts += [np.array(["tail"], dtype=object)] * 3 + [np.array(["far"], dtype=object)]
    (table,) = tables.page_tables(xs, texts)
    shown = table["text"].split("\n")
    assert (table["first"], table["last"], len(shown)) == (0, 152, 154)
    assert shown[:3] == ["| r0 | b | c |", "| --- | --- | --- |", "| r1 | b | c |"] and shown[-1] == "| tail |  |  |"
    assert tables.page_tables(xs[-2:], texts[-2:]) == [] and tables.page_tables([], []) == []


def test_columns_of_a_long_line_take_no_square():
    """Cells of a line were found by a table of its words times all columns."""
    import time

    xs = [50.0 + 60.0 * np.arange(20000)] * 5
    texts = [np.array([f"w{i}" for i in range(20000)], dtype=object)] * 5
    began = time.time()
    (table,) = tables.page_tables(xs, texts)
    assert time.time() - began < 10
    assert table["text"].split("\n")[4] == "| " + " | ".join(texts[0]) + " |"
    # the left one of two columns as near as each other, and none beyond 40 points
    assert tables.line_cells(np.array([30.0, 55.0, 150.0, 161.0]), ["a", "b ", "c", "d"], np.array([10.0, 50.0, 120.0])) == ["a", "b", "c"]


def test_markdown_of_items_is_that_of_lines(spark):
    r = random.Random(6)
    words = ["a", "• x", "b.", "", None, "1. c", "-", " d  e", "Long line of words"]
    rows = [
        (r.randrange(3), r.randrange(9), i, r.choice(words), [10.0, 0.0, 0.0, r.choice([10.0, 14.0, 20.0]), 50.0 + r.choice([12, 60]) * r.randrange(5), 800.0 - 14 * r.randrange(14) - r.randrange(3)],
         5.0, r.choice([0.0, 10.0, 10.0, 16.0]), r.choice(["Helvetica", "Helvetica-Bold", "Times-Italic", "Courier", None]))
        for i in range(1500)
    ]
    schema = "doc_id long, page_no long, item_no long, str string, transform array<double>, width double, height double, font_name string"
    df = spark.createDataFrame(rows, schema)
    for options in ({}, {"keep_breaks": True, "links": True}):
        want = tables.lines_to_markdown(tables.group_lines(df), **options).orderBy("doc_id", "page_no").collect()
        got = tables.items_to_markdown(df.repartition(5), **options)
        assert got.orderBy("doc_id", "page_no").collect() == want and any("| --- |" in x.markdown for x in want)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_mail_bodies_are_decoded(spark):
    rows = [
        (1, "Content-Transfer-Encoding: base64\r\n\r\nZ3LDvMOfZQ=="),
        (2, "Content-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\ngr=FC=DFe=\r\n!"),
        (3, "Content-Type: text/html\r\nContent-Transfer-Encoding: BASE64\r\n\r\nPGI+\r\nPC9iPg=="),
        (4, 'Content-Type: multipart/mixed; boundary="x.+1"\r\n\r\n--x.+1\r\nContent-Type: text/plain; charset="latin1"\r\n'
            "Content-Transfer-Encoding: base64\r\n\r\nZ3L8\r\n--x.+1\r\nContent-Type: text/html\r\n\r\na\u0001b <img src='cid:q'> \u0001\r\n--x.+1--"),
        (5, "\r\nplain"),
    ]
    got = {r.doc_id: r for r in mail.parse_emails(spark.createDataFrame(rows, "doc_id long, raw string")).collect()}
    assert [got[i].text_body for i in (1, 2, 4, 5)] == ["grüße", "grüße!", "grü", "plain"]
    assert got[3].html_body == "<b></b>" and got[4].html_body == "a\u0001b <img src='cid:q'> \u0001\n"
    bodies = spark.createDataFrame([(4, got[4].html_body), (5, None), (6, "no\nlinks")], "doc_id long, html_body string")
    att = spark.createDataFrame(
        [(4, 1, "q", True, "image/png", "QQ==")],
        "doc_id long, part_no long, content_id string, is_inline boolean, content_type string, base64_data string",
    )
    shown = {r.doc_id: r.html_body for r in mail.resolve_cids(bodies, att).collect()}
    assert shown == {4: 'a\u0001b <img src="data:image/png;base64,QQ=="> \u0001\n', 5: "", 6: "no\nlinks"}


def test_search_edges(spark):
    df = items(spark, [("über ber BER, ber_x", 50, 700), ("aaa", 50, 680)])
    got = sorted((r.item_no, r.start, r.text) for r in find.find_text(df, ["ber"], whole_word=True).collect())
    # word edges are ASCII, so the umlaut before "ber" is an edge
    assert got == [(0, 1, "ber"), (0, 5, "ber"), (0, 9, "BER")]
    empty = find.find_text(df.filter("item_no = 1"), ["aa", "b*"], regex=True, number=False).collect()
    assert sorted((r.term_no, r.start, r.text) for r in empty) == [(0, 0, "aa"), (1, 0, ""), (1, 1, ""), (1, 2, ""), (1, 3, "")]


def test_patterns_that_match_places(spark):
    schema = "doc_id long, page_no long, item_no long, str string, width double, height double, transform array<double>"
    df = spark.createDataFrame([(1, 1, 1, "the cat the", 110.0, 8.0, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0])], schema)

    def starts(term):
        return sorted(r.start for r in find.find_text(df, [term], regex=True, number=False).collect())

    assert starts("(?=the)") == [0, 8]
    assert starts(r"\b") == [0, 3, 4, 7, 8, 11]
    assert starts("$") == [11]
    assert starts(r"(?<w>[\w[]+)") == [0, 4, 8]


def test_names_are_unique(spark):
    def final(names, hashed=False):
        ids = [(i * 2654435761 << 24) % (1 << 62) if hashed else i for i in range(len(names))]
        rows = [(d, 1, n, 0, "d.pdf") for d, n in zip(sorted(ids), names)]
        df = spark.createDataFrame(rows, "doc_id long, idx long, name string, page_no long, filename string")
        out = meta.dedupe_names(df).orderBy("doc_id", "idx").collect()
        return [r.unique_name for r in out]

    assert final(["a.txt", "a.txt", "a_1.txt"]) == ["d_a.txt", "d_a_2.txt", "d_a_1.txt"]
    many = ["n", "n_2", "n", "n", "n_1", "n_4", "n_2", "n", "n_2_1", "b.x", "b_1.x", "b.x", "b_2.x", "b.x"] * 3
    for hashed in (False, True):
        got = final(many, hashed)
        assert len(set(got)) == len(many)
        assert got[:14:13] == ["d_n", "d_b_4.x"]

def test_overlapping_matches_are_all_removed(spark):
    df = items(spark, [("abcabc", 50, 700)])
    found = find.find_text(df, ["ab", "bc"], number=False).withColumn("selected", F.lit(True))
    assert find.redact(df, found, "#").first().str == "##"


def test_html_cleaning(spark):
    cases = {
        '<p onclick="x()" class=\'a"b\'>t</p>': '<p class="a&quot;b">t</p>',
        '<a href="javascript:alert(1)" title=x>l</a>': '<a title="x">l</a>',
        '<A HREF="http://e.org">l</A>': '<a href="http://e.org" rel="noopener noreferrer">l</a>',
        "<script>bad()</script><br/>": "bad()<br />",
        "1 < 2 <custom>x</custom>": "1 < 2 x",
        "<td colspan=2 width=3>": '<td colspan="2">',
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    got = {r.page_id: r.html for r in html.sanitize_html(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    one = spark.createDataFrame([(1, "<script>bad()</script>x")], "page_id long, html string")
    assert html.sanitize_html(one, drop_content=True).first().html == "x"


EML = (
    "Subject: =?utf-8?Q?Caf=C3=A9_?=\r\n folded\r\nFrom: a@b\r\nSubject: second =?iso-8859-1?B?6Q==?=\r\n"
    'Content-Type: multipart/related; boundary="B"\r\n\r\npreamble\r\n--B\r\nContent-Type: text/html\r\n'
    'Content-Transfer-Encoding: quoted-printable\r\n\r\n<img src=3D"cid:i1">=\r\n<b>=C3=A9</b>\r\n'
    '--B\r\nContent-Type: image/png\r\nContent-ID: <i1>\r\nContent-Transfer-Encoding: base64\r\n\r\nAAEC\r\n'
    '--B\r\nContent-Type: application/zip\r\nContent-Disposition: attachment; filename="z.zip"\r\n\r\nraw\r\n--B--\r\n'
)


def test_mail(spark):
    raw = spark.createDataFrame([(1, EML), (2, "no header")], "doc_id long, raw string")
    got = {r.doc_id: r for r in mail.parse_emails(raw).collect()}
    assert got[1].subject == "second é" and got[1].n_attachments == 2
    assert got[1].html_body.strip().endswith("<b>é</b>")
    assert got[2].subject == "(No Subject)"
    att = {r.filename: r for r in mail.email_attachments(raw).collect()}
    assert att["attachment"].is_inline and bytes(att["attachment"].data) == b"\x00\x01\x02"
    assert not att["z.zip"].is_inline
    body = mail.resolve_cids(mail.parse_emails(raw).filter("doc_id = 1"), mail.email_attachments(raw)).first().html_body
    assert 'src="data:image/png;base64,AAEC"' in body


def test_rules_of_files(spark):
    df = spark.createDataFrame(
        [(1, "a.pdf", "", 10), (2, "b.png", "image/png", 0), (3, "c.txt", "text/plain", 300)], "doc_id long, filename string, mime string, size_bytes long"
    )
    got = sorted((r.doc_id, r.code) for r in files.validate_files(df, max_size=200).collect())
    assert got == [(2, "FILE_EMPTY"), (3, "FILE_TOO_LARGE"), (3, "FILE_TYPE_INVALID")]
    one = files.route_files(df, [("only", [".zip"])])
    assert {r.route_id for r in one.collect()} == {"only"}


def test_forms_and_layers(spark):
    f = spark.createDataFrame([(1, "t", "Text", "old"), (1, "c", "CheckBox", ""), (1, "b", "Button", "old")], "doc_id long, name string, type string, value string")
    v = spark.createDataFrame([(1, "t", 1, "x"), (1, "t", 2, "y"), (1, "c", 1, "true"), (1, "b", 1, "n"), (1, "zz", 1, "n")], "doc_id long, name string, seq long, value string")
    assert {r.name: r.value for r in meta.fill_forms(f, v).collect()} == {"t": "y", "c": "true", "b": "old"}


def test_retain_survives_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(2).alias("k"), "id")
    got = runs.retain(df, 5, ["k"], ["id"]).collect()
    assert sorted((r.k, r.id) for r in got) == [(1, i) for i in range(1995, 2000)] + [(2, i) for i in range(2995, 3000)]


def test_key_audit(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("brand", "q")], ["path", "value"])
    b = spark.createDataFrame([("x", "1"), ("z", "3"), ("brand", "q")], ["path", "value"])
    got = {(r.path, r.issue) for r in catalogue.audit_keys(a, b).collect()}
    assert got == {("x", "untranslated"), ("y", "missing"), ("z", "extra")}


def test_readers_and_sinks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one\ntwo")
    (src / "b.json").write_text('{"a": 1}')
    (src / "c.json").write_text("{broken")
    (src / "m.eml").write_text(EML)
    assert readers.read_text_docs(spark, str(src)).first().text == "one\ntwo"
    js = {r.filename: r.error_code for r in readers.read_json_docs(spark, str(src)).collect()}
    assert js == {"b.json": None, "c.json": "FILE_CORRUPTED"}
    assert mail.parse_emails(readers.read_emails(spark, str(src))).first().sender == "a@b"
    m = readers.read_files(spark, str(src))
    assert m.count() == 4 and "content" not in m.columns
    assert readers.read_files(spark, str(src), "*.txt", content=True).first().content == b"one\ntwo"
    out = str(tmp_path / "bundles")
    writers.write_bundle(writers.assign_bundles(m, 3), out)
    back = spark.read.parquet(out)
    assert sorted(r["count"] for r in back.groupBy("bundle_id").count().collect()) == [1, 3]


def test_document_parts_join_to_one_object(spark):
    pages = spark.range(1, 8).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("page_no"), F.concat(F.lit("p "), F.col("id").cast("string")).alias("text"))
    m = spark.createDataFrame([(1, "T")], "doc_id long, title string")
    o = spark.createDataFrame([(1, i, 1, f"m{i}", i) for i in range(1, 6)], "doc_id long, ordinal long, level int, title string, page_no long")
    parts = writers.to_document_json(m, pages, o, per_part=2).orderBy("part_no").collect()
    whole = json.loads("".join(r.json for r in parts))
    assert len(parts) > 3 and [p["pageNumber"] for p in whole["pages"]] == list(range(1, 8))
    assert [x["title"] for x in whole["outline"]] == ["m1", "m2", "m3", "m4", "m5"]


def test_file_stream_reports_errors(spark, tmp_path):
    src = tmp_path / "arriving"
    src.mkdir()
    (src / "good.pdf").write_bytes(b"%PDF-1.7\nx\n%%EOF\n")
    (src / "bad.pdf").write_bytes(b"hello")
    (src / "cut.pdf").write_bytes(b"%PDF-1.4\nno end")
    got = jobs.drain(jobs.intake_errors(jobs.intake(spark, str(src))), "t").collect()
    assert sorted(r.code for r in got) == ["FILE_NOT_PDF", "PDF_MALFORMED"]


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "runs")
    schema = "id long, start_ts timestamp, duration_ms long, status string"

    def land(rows):
        spark.createDataFrame(rows, "id long, ts string, duration_ms long, status string").select(
            "id", F.col("ts").cast("timestamp").alias("start_ts"), "duration_ms", "status"
        ).coalesce(1).write.mode("append").parquet(src)

    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def go():
        s = spark.readStream.schema(schema).parquet(src)
        q = jobs.run_stats_windows(s, "1 hour", late="10 minutes").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", ck
        ).trigger(availableNow=True).start()
        q.awaitTermination()

    land([(1, "2024-01-01 00:10:00", 100, "completed"), (2, "2024-01-01 03:00:00", 50, "failed")])
    go()
    land([(3, "2024-01-01 00:20:00", 100, "completed"), (4, "2024-01-01 06:00:00", 50, "failed")])
    go()
    got = {str(r.window_start): r.total for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-01 03:00:00"] == 1


def test_flatten_keys_enters_any_depth(spark):
    rows = [(1, '{"d": {"e": {"f": {"g": {"h": "x"}}}}, "t": "{count} pages", "n": 1.5, "z": null, "l": ["a", {"k": true}], "o": {}}'), (2, "{broken"), (3, None), (4, '"text"')]
    df = spark.createDataFrame(rows, "doc_id long, json string")
    got = {(r.path, r.value) for r in catalogue.flatten_keys(df).collect()}
    assert got == {("d.e.f.g.h", "x"), ("t", "{count} pages"), ("n", "1.5"), ("z", None), ("l.0", "a"), ("l.1.k", "true")}


def test_signatures_at_their_own_bounds(spark):
    from quirework.operators import files

    sig = b"<< /Type /Sig /ByteRange [0 1 2 3] /Contents <" + b"0A" * 9000 + b"> /Name (a \\(b\\)) /Prop << /Name (inner) /Reason (no) >> /ContactInfo (me) /M (D:20240102030405) >>"
    none = b"<< /Type /SigFieldLock /ByteRange [0 1 2 3] /Contents <00> >> << /Type /Sig /Contents <00> >>"
    df = spark.createDataFrame([(1, b"x" * 9000 + none + sig + b"<<" + sig), (2, b"/Type /Sig"), (3, None)], "doc_id long, content binary")
    got = files.signature_inventory(df).orderBy("idx").collect()
    assert [(r.doc_id, r.idx, r.contents_hex, r.reason, r.contact, r.signing_time) for r in got] == [(1, i, 18000, None, "me", "2024-01-02T03:04:05") for i in (0, 1)]


def test_encryption_mark_anywhere(spark):
    from quirework.operators import files

    df = spark.createDataFrame([(1, b"a" * 5000 + b"/Encrypt"), (2, b"a")], "doc_id long, content binary")
    assert {r.doc_id: r.encrypted for r in files.flag_encrypted(df).collect()} == {1: True, 2: False}


def test_html_cleaning_by_pieces(spark):
    cases = [
        ('<a href=x/>t', '<a href="x" rel="noopener noreferrer" />t'),
        ("<a href=x/\n>t", '<a href="x/" rel="noopener noreferrer">t'),
        ("<A HREF='q\"r' onclick=\"f()\">t</A >", '<a href="q&quot;r" rel="noopener noreferrer">t</a>'),
        ("1 < 2 <b-x class='k' id>b</b> > c", '1 < 2 <b class="k" id="">b</b> > c'),
        ('<img src=" JavaScript:x" alt="\U0001F600">', '<img alt="\U0001F600">'),
        ("<script>x</script><b_c>y", "x<b_c>y"),
        ("<a <b>z</b>", "<a>z</b>"),
        ('on <td colspan="2" scope=r>onload="x"', 'on <td colspan="2">'),
        ("", ""),
        ("<p", "<p"),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, html string")
    got = [r.html for r in html.sanitize_html(df).orderBy("page_id").collect()]
    assert got == [c[1] for c in cases]


def test_newest_rows_over_many_batches(spark, tmp_path):
    src, path, ck = (str(tmp_path / n) for n in ("in", "latest", "ck"))
    schema = "k string, ts long, id long"
    for i in range(6):
        rows = [("hot", i, i), (f"k{i}", i, i), ("old", 100 - i, i)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.keep_latest(stream, path, ["k"], "ts", "id", ck, fold_every=2).awaitTermination()
        got = {r.k: r.id for r in jobs.read_latest(spark, path, ["k"], "ts", "id").collect()}
        assert got == {"hot": i, "old": 0} | {f"k{j}": j for j in range(i + 1)}
    assert sorted(p.name for p in (tmp_path / "latest").iterdir()) == ["v=3", "v=4", "v=5"]


def test_table_and_markdown_files(spark, tmp_path):
    t = spark.createDataFrame(
        [(7, 1, 1, [["a", "b"], ["1,5", 'q"']]), (7, 2, 1, [["c"], ["2"]]), (8, 1, 1, [["d"], ["3"]])],
        "doc_id long, page_no long, table_no int, rows array<array<string>>",
    )
    out = {f: str(tmp_path / f) for f in ("json", "csv", "markdown", "pages")}
    for f in ("json", "csv", "markdown"):
        writers.write_tables(t, out[f], f)
    js = spark.read.json(out["json"]).orderBy("docId", "pageNumber").collect()
    assert [(r.docId, r.pageNumber, r.tableIndex, r.headers) for r in js] == [(7, 1, 1, ["a", "b"]), (7, 2, 1, ["c"]), (8, 1, 1, ["d"])]

    def whole(f, doc):
        return "".join(p.read_text() for p in sorted((tmp_path / f / f"doc_id={doc}").rglob("part-*.txt")))

    assert whole("csv", 7) == '# Table 1 (Page 1)\na,b\n"1,5",q""\n\n# Table 1 (Page 2)\nc\n2\n\n'
    assert whole("markdown", 8) == "## Table 1 (Page 1)\n\n| d |\n| --- |\n| 3 |\n\n"
    pages = spark.createDataFrame([(1, i, f"p{i}") for i in range(1, 6)], "doc_id long, page_no long, markdown string")
    writers.write_markdown(pages, out["pages"], per_part=2)
    assert whole("pages", 1) == "\n\n---\n\n".join(f"p{i}" for i in range(1, 6)) + "\n"


def test_json_texts_hold_one_value(spark):
    good = ['{"a": 1}', " [1, 2]\n", '"x"', "null", "0"]
    bad = ["", "{broken", '{"a": 1},', "1, 2", '1, "b": 2', "1], [2", '1}, {"a": 2', '{"a": 1} x', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    got = {r.doc_id for r in readers.check_json(df).filter("error_code IS NULL").collect()}
    assert got == set(range(len(good)))


def newest_by_hand(deliveries, n):
    """{key: items held} after each delivery, by looking at all rows so far."""
    best, out = {}, []
    for rows in deliveries:
        for k, item, ts, i in rows:
            best[k, item] = max(best.get((k, item), (ts, i)), (ts, i))
        held = {}
        for (k, item), at in best.items():
            held.setdefault(k, []).append((at, item))
        out.append({(k, item, at[1]) for k, v in held.items() for at, item in sorted(v, reverse=True)[:n]})
    return out


def test_newest_rows_over_restarts_and_late_rows(spark, tmp_path):
    r = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    deliveries = [[(r.randrange(5), r.choice("abcdef"), start + datetime.timedelta(minutes=60 * d + r.randint(-90, 60)), 100 * d + i) for i in range(40)] for d in range(4)]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "k int, item string, ts timestamp, id long"
    for d, want in zip(deliveries, newest_by_hand(deliveries, 2), strict=True):
        spark.createDataFrame(d, schema).write.mode("append").parquet(src)
        with jobs.stateful(spark):
            stream = spark.readStream.schema(schema).parquet(src)
            changes = jobs.newest_changes(stream, "k", "item", "ts", "id", 2)
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        got = jobs.newest_of(spark.read.parquet(out), "k").collect()
        assert {(x.k, x.item, x.id) for x in got} == want
    state = spark.read.format("statestore").option("path", ck).option("stateVarName", "items").load()
    assert state.count() <= 2 * 5


def test_idle_keys_are_let_go(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    at = lambda hour: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)
    schema = "k int, item string, ts timestamp, id long"
    for rows in ([(1, "a", at(0), 1), (2, "a", at(0), 2)], [(2, "b", at(20), 3)], [(3, "c", at(40), 4)], [(3, "c", at(41), 5)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        with jobs.stateful(spark):
            changes = jobs.newest_changes(spark.readStream.schema(schema).parquet(src), "k", "item", "ts", "id", 2, idle_ms=10 * 3_600_000)
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = jobs.newest_of(spark.read.parquet(out), "k").collect()
    assert {(x.k, x.item) for x in got} == {(3, "c")}


def test_lookup_sends_no_side_whole(spark, tmp_path):
    from quirework.operators import catalogue

    spark.createDataFrame([(i, f"k{i}", f"v{i}") for i in range(50)], "doc_id long, path string, value string").write.parquet(f"{tmp_path}/keys")
    base = spark.read.parquet(f"{tmp_path}/keys")
    found = catalogue.lookup_with_fallback(base.select("doc_id", "path"), base.where("doc_id % 2 = 0"), base.where("doc_id % 3 > 0"), ("doc_id", "path"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = {i: f"v{i}" if i % 2 == 0 or i % 3 else f"k{i}" for i in range(50)}
    assert {r["doc_id"]: r["value"] for r in found.collect()} == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_marked_files_hold_every_line(spark, tmp_path):
    t = spark.createDataFrame(
        [(7, 1, 1, [["a", "b"], ["1,5", "x\ny"]]), (7, 2, 1, [["c"], ["2"]]), (8, 1, 1, [["d"], [""]])],
        "doc_id long, page_no long, table_no int, rows array<array<string>>",
    )
    path = str(tmp_path / "csv")
    writers.write_tables(t, path, "csv", folders=False)
    assert not list((tmp_path / "csv").glob("doc_id=*"))
    got = sorted((r.doc_id, r.line) for r in readers.marked_lines(spark, path).collect())
    seven = ["# Table 1 (Page 1)", "a,b", '"1,5","x', 'y"', "", "# Table 1 (Page 2)", "c", "2", ""]
    assert got == sorted([(7, x) for x in seven] + [(8, x) for x in ("# Table 1 (Page 1)", "d", "", "")])


def test_items_of_a_page_meet_once(spark):
    """Tables and lines take one exchange, of packed pages; scattered items give what neighbours give."""
    r = random.Random(4)
    rows = [(r.choice(["a", " b", "", "c d "]), 50 + 60 * r.randrange(6) + r.choice([0, 3]), 700 - 14 * r.randrange(9) - r.randrange(2)) for _ in range(200)]
    df = items(spark, rows).withColumn("page_no", F.col("item_no") % 3).repartition(1).sortWithinPartitions("page_no")
    for fn, order in ((tables.table_rows, ("page_no", "table_no", "row_no")), (tables.detect_tables, ("page_no", "table_no")), (tables.group_lines, ("page_no", "y"))):
        one = fn(df)
        assert plan_of(one).count("RepartitionByExpression") == 1 and "Aggregate" not in plan_of(one)
        same = [x.orderBy(*order).collect() for x in (one, fn(df.repartition(7, "item_no")))]
        assert same[0] == same[1] and same[0]


def test_headings_move_no_items(spark):
    """Levels from one row for each y of a page, in one exchange of pages, equal those of whole lines."""
    r = random.Random(6)
    texts = ["Title", "two  words", " in. ", "end.", "a,", "", " ", "\u2028", "\u2028 .", "x.\u2028", "\u00a0", "\u0085", "é😀?", "\t\x0b;\r", "w" * 78, "v" * 79, "u" * 80, None]
    rows = []
    for i in range(3000):
        size = r.choice([8.0, 10.0, 10.0, 12.0, 15.0, 19.0])
        x, y = 50.0 + 20 * r.randrange(4), 700.0 - 14 * r.randrange(12) - r.choice([0, 0, 1, 3])
        rows.append((i % 5, i % 31, r.randrange(40), r.choice(texts), [size, 0.0, 0.0, size, x, y], 5.0, r.choice([size, 0.0]), r.choice(["Helvetica", "X-Black", None])))
    schema = "doc_id long, page_no long, item_no long, str string, transform array<double>, width double, height double, font_name string"
    df = spark.createDataFrame(rows, schema)
    cols = ("doc_id", "page_no", "y", "heading_level")
    got = {}
    for name, parts in (("one", df.repartition(1).sortWithinPartitions("doc_id", "page_no")), ("some", df.repartition(7, "item_no"))):
        levels = tables.item_headings(parts)
        got[name] = sorted(levels.select(*cols).collect())
    want = sorted(tables.heading_level(tables.group_lines(df)).select(*cols).collect())
    assert got["one"] == got["some"] == want and {x.heading_level for x in want} == {0, 1, 2, 3}
    # two items at one y, many of them: a row each leaves the first step
    many = spark.createDataFrame([(1, 1, i, "w", [9.0, 0.0, 0.0, 9.0, 50.0 + i, 700.0 - i % 2], 5.0, 9.0, "Helvetica") for i in range(1000)], schema).coalesce(1)
    assert [(x.size, x.parts, x.str) for x in tables.at_each_y(many).collect()] == [(500, 500, None), (500, 500, None)]


def test_headings_query_has_one_exchange_of_pages(spark):
    from quirework.plans import text_queries

    plan = text_queries.heading_levels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1 and "Window" not in plan


def test_arrays_are_worked_out_once(spark, tmp_path):
    """An explode that filters by an array's size works the array out a second time."""
    spark.createDataFrame([(1, 1, 0, "the other", [10.0, 0.0, 0.0, 10.0, 50.0, 800.0], 45.0, 10.0)], "doc_id long, page_no long, item_no long, str string, transform array<double>, width double, height double").write.parquet(f"{tmp_path}/i")
    spark.createDataFrame([(1, "Subject: x\r\n\r\nbody")], "doc_id long, raw string").write.parquet(f"{tmp_path}/m")
    found = find.find_text(spark.read.parquet(f"{tmp_path}/i"), ["the"], number=False)
    assert plan_of(found).count("regexp_extract_all") == 1 and [r.start for r in found.orderBy("start").collect()] == [0, 5]
    assert plan_of(mail.email_parts(spark.read.parquet(f"{tmp_path}/m"))).count("size(transform(transform(") == 0


def test_long_json_lines_are_cut_in_one_pass(spark):
    import time

    from quirework.operators import paginate

    body = "ab cdé " * 700000
    df = spark.createDataFrame([(1, f'{{\n  "body": "{body}"\n}}')], "doc_id long, json string")
    began = time.time()
    got = [r.line for r in paginate.json_lines(df, width=70).orderBy("line_no").collect()]
    assert time.time() - began < 40
    line = f'  "body": "{body}"'
    assert got[0] == "{" and got[1] == line[:70] and got[-1] == "}"
    assert "".join(x[4:] for x in got[2:-1]) == line[70:]
