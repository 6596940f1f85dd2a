"""Sinks: JSON documents, table text, Markdown, recognised text, bundles.

Texts that belong to a whole document are produced in parts of at most
``pages_per_part`` pages: joining the parts of a document in order gives its
text, and no task ever holds more than one part.  Ordinary documents have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.arrays import let
from quirework.functions.text import strip
from quirework.operators.prefix import page_block, running

PAGES_PER_PART = 1024


def _ordered_join(order: str, text: str, sep: str) -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), sep
    )


def _parts(pages: DataFrame, text: str, sep: str, per_part: int) -> DataFrame:
    """Ordered concatenation by document part; later parts begin with ``sep``."""
    blk = (F.floor((F.col("page_no") - 1) / F.lit(per_part)) + 1).cast("long")
    parts = pages.withColumn("part_no", blk).groupBy("doc_id", "part_no").agg(
        _ordered_join("page_no", text, sep).alias("text")
    )
    first = parts.groupBy("doc_id").agg(F.min("part_no").alias("_first"))
    return parts.join(first, "doc_id").select(
        "doc_id",
        "part_no",
        F.when(F.col("part_no") == F.col("_first"), F.col("text"))
        .otherwise(F.concat(F.lit(sep), F.col("text")))
        .alias("text"),
    )


def page_json(pages: DataFrame, with_text: bool = True) -> Column:
    fields = [F.col("page_no").alias("pageNumber")]
    for c, name in (("width_pt", "width"), ("height_pt", "height"), ("rotation", "rotation")):
        if c in pages.columns:
            fields.append(F.col(c).alias(name))
    if with_text and "text" in pages.columns:
        fields.append(strip(F.regexp_replace(F.coalesce("text", F.lit("[Error extracting page: no text]")), r"\s+", " ")).alias("text"))
    return F.to_json(F.struct(*fields))


def to_document_json(
    meta: DataFrame,
    pages: DataFrame,
    outline: DataFrame | None = None,
    with_text: bool = True,
    spec: str = "",
    per_part: int = PAGES_PER_PART,
) -> DataFrame:
    """(doc_id, part_no, json): the parts of a document join to one JSON object.

    Keys: metadata, info, outline (top-level titles in order) and pages.
    """
    from quirework.functions.pagespec import literal_covers

    last = F.ceil(F.col("n_pages") / F.lit(per_part)).cast("long")
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    picked = pages.filter(literal_covers(spec, F.col("page_no"), "tables"))
    body = _parts(picked.withColumn("_j", page_json(picked, with_text)), "_j", ",", per_part)
    mcols = [c for c in meta.columns if c != "doc_id"]
    start = F.concat(
        F.lit('{"metadata":'), F.to_json(F.struct(*mcols)),
        F.lit(',"info":{"pageCount":'), F.col("n_pages").cast("string"), F.lit("}"),
    )
    head = meta.join(counts, "doc_id")
    pieces = []
    if outline is None:
        # a document's outline may itself need several parts; pages follow after them
        head = head.withColumn("_shift", F.lit(0).cast("long"))
        opening = F.lit(',"pages":[')
    else:
        tops = outline.filter("level = 1").select(
            "doc_id",
            F.to_json(F.struct("title", F.col("page_no").alias("dest"))).alias("_j"),
            F.col("ordinal").alias("page_no"),
        )
        shift = tops.groupBy("doc_id").agg(
            F.floor((F.max("page_no") - 1) / F.lit(per_part)).cast("long").alias("_shift")
        )
        head = head.join(shift, "doc_id", "left").withColumn("_shift", F.coalesce("_shift", F.lit(0)))
        start = F.concat(start, F.lit(',"outline":['))
        opening = F.lit('],"pages":[')
        pieces.append(
            _parts(tops, "_j", ",", per_part).select("doc_id", "part_no", F.lit(1).alias("_sec"), "text")
        )
        body = body.join(shift, "doc_id", "left").withColumn(
            "part_no", F.col("part_no") + F.coalesce("_shift", F.lit(0))
        )
    pieces.append(body.select("doc_id", "part_no", F.lit(3).alias("_sec"), "text"))
    frame = F.array(
        F.struct(F.lit(1).cast("long").alias("part_no"), F.lit(0).alias("_sec"), start.alias("text")),
        F.struct((F.col("_shift") + 1).alias("part_no"), F.lit(2).alias("_sec"), opening.alias("text")),
        F.struct((F.col("_shift") + last).alias("part_no"), F.lit(4).alias("_sec"), F.lit("]}").alias("text")),
    )
    rows = head.select("doc_id", F.explode(frame).alias("f")).select("doc_id", "f.*")
    for p in pieces:
        rows = rows.unionByName(p)
    return rows.groupBy("doc_id", "part_no").agg(_ordered_join("_sec", "text", "").alias("json"))


def document_json_rows(meta: DataFrame, pages: DataFrame, with_text: bool = True) -> DataFrame:
    """Page-level JSON lines, for corpora read back by Spark: (doc_id, page_no, json)."""
    return pages.join(meta.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", "page_no", page_json(pages, with_text).alias("json")
    )


def table_json(tables: DataFrame, page_numbers: bool = True) -> DataFrame:
    """JSON per table; blank headers become ``column_k``, the last of equal
    headers wins."""
    named = F.transform(
        F.col("rows")[0],
        lambda h, i: F.when(h == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(h),
    )

    def render(keys: Column, pos: Column) -> Column:
        def obj(cells: Column) -> Column:
            picked = F.transform(pos, lambda p: F.coalesce(F.get(cells, p), F.lit("")))
            return F.map_from_arrays(keys, picked)

        fields = [
            F.col("table_no").alias("tableIndex"),
            F.col("rows")[0].alias("headers"),
            F.transform(F.slice("rows", 2, F.size("rows")), obj).alias("rows"),
        ]
        if page_numbers:
            fields.append(F.col("page_no").alias("pageNumber"))
        return F.to_json(F.struct(*fields))

    # headers sorted with their positions; the last entry of a run of equals stays
    def last_of_equals(srt: Column) -> Column:
        return F.filter(
            srt, lambda e, j: F.coalesce(F.get(srt, j + 1)["k"] != e["k"], F.lit(True))
        )

    at = F.array_sort(F.transform(named, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    text = let(
        let(at, last_of_equals),
        lambda kept: let(
            F.transform(kept, lambda e: e["k"]),
            lambda ks: let(F.transform(kept, lambda e: e["i"]), lambda ps: render(ks, ps)),
        ),
    )
    return tables.select("doc_id", "page_no", "table_no", text.alias("text"))


def table_markdown(tables: DataFrame, page_numbers: bool = True) -> DataFrame:
    def bar(cells: Column) -> Column:
        shown = F.transform(cells, lambda c: F.when(c == "", F.lit(" ")).otherwise(c))
        return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |\n"))

    rows = F.col("rows")
    title = F.concat(F.lit("## Table "), F.col("table_no").cast("string"))
    if page_numbers:
        title = F.concat(title, F.lit(" (Page "), F.col("page_no").cast("string"), F.lit(")"))
    rule = F.concat(
        F.lit("| "), F.array_join(F.transform(rows[0], lambda _: F.lit("---")), " | "), F.lit(" |\n")
    )
    text = F.concat(
        title, F.lit("\n\n"), bar(rows[0]), rule,
        F.array_join(F.transform(F.slice(rows, 2, F.size(rows)), bar), ""), F.lit("\n"),
    )
    return tables.select("doc_id", "page_no", "table_no", text.alias("text"))


def csv_cell(c: Column) -> Column:
    """Quotes are doubled; the cell is wrapped only for a comma or line break."""
    q = F.replace(c, F.lit('"'), F.lit('""'))
    return F.when(q.contains(",") | q.contains("\n"), F.concat(F.lit('"'), q, F.lit('"'))).otherwise(q)


def table_csv(tables: DataFrame, page_numbers: bool = True) -> DataFrame:
    lines = F.transform(
        "rows", lambda r: F.concat(F.array_join(F.transform(r, csv_cell), ","), F.lit("\n"))
    )
    head = F.lit("")
    if page_numbers:
        head = F.format_string("# Table %d (Page %d)\n", F.col("table_no"), F.col("page_no"))
    text = F.concat(head, F.array_join(lines, ""), F.lit("\n"))
    return tables.select("doc_id", "page_no", "table_no", text.alias("text"))


def number_tables(tables: DataFrame) -> DataFrame:
    """Table numbers that run through a document instead of restarting per page."""
    return running(
        tables, ["doc_id"], [page_block()], ["page_no", "table_no"], before="_k"
    ).withColumn("table_no", (F.col("_k") + 1).cast("long")).drop("_k")


def _write_documents(texts: DataFrame, path: str, part: Column, *order: str) -> None:
    """Texts as text files, one folder per document and part; folders in the order of their names hold a document's texts in
    order.  Parts are dealt by hash, so a long document is written by several tasks.  Every text gets a line break at its end.
    """
    dealt = texts.withColumn("part", F.lpad(part.cast("string"), 9, "0")).repartition("doc_id", "part")
    ordered = dealt.sortWithinPartitions("doc_id", "part", *order)
    ordered.select("doc_id", "part", "text").write.mode("overwrite").partitionBy("doc_id", "part").text(path)


def _write_marked(texts: DataFrame, path: str, part: Column, *order: str) -> None:
    """The same texts in as many files as there are tasks: every line begins with its document's id and a comma, and a
    document's lines stand in order within each part.  ``readers.marked_lines`` takes them apart again."""
    dealt = texts.withColumn("part", part).repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", *order)
    mark = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(","))
    lines = F.transform(F.split("text", "\n"), lambda l: F.concat(mark, l))
    dealt.select(F.array_join(lines, "\n").alias("text")).write.mode("overwrite").text(path)


def write_tables(tables: DataFrame, path: str, fmt: str = "json", folders: bool = True) -> None:
    """Tables in their own format: ``json`` as JSON lines, one table each with its ``docId``; ``csv`` and ``markdown`` as
    text files in a folder per document and part of ``PAGES_PER_PART`` pages.

    A folder per document costs some file operations each; for a corpus, without ``folders``, the same lines go to a file
    per task, each behind its document's id."""
    if fmt == "json":
        line = F.concat(F.lit('{"docId":'), F.col("doc_id").cast("string"), F.lit(","), F.substring("text", 2, 1 << 30))
        table_json(tables).select(line.alias("text")).write.mode("overwrite").text(path)
        return
    texts = {"markdown": table_markdown, "csv": table_csv}[fmt](tables)
    ended = texts.withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    part = F.floor((F.col("page_no") - 1) / F.lit(PAGES_PER_PART)) + 1
    (_write_documents if folders else _write_marked)(ended, path, part, "page_no", "table_no")


def markdown_parts(pages: DataFrame, page_heads: bool = False, per_part: int = PAGES_PER_PART) -> DataFrame:
    """Documents as Markdown parts; empty pages are skipped."""
    shown = pages.filter(strip(F.col("markdown")) != "")
    if page_heads:
        shown = shown.withColumn(
            "markdown", F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), F.col("markdown"))
        )
    return _parts(shown, "markdown", "\n\n---\n\n", per_part)


def write_markdown(pages: DataFrame, path: str, page_heads: bool = False, per_part: int = PAGES_PER_PART) -> None:
    """Markdown text files, a folder per document and part."""
    parts = markdown_parts(pages, page_heads, per_part)
    first = F.min("part_no").over(Window.partitionBy("doc_id"))
    # the line break that the writer puts behind a part is the one that the next part begins with
    body = F.when(F.col("_first") == F.col("part_no"), F.col("text")).otherwise(F.regexp_replace("text", r"\A\n", ""))
    _write_documents(parts.withColumn("_first", first).withColumn("text", body), path, F.col("part_no"))


def assemble_page_text(pages: DataFrame, per_part: int = PAGES_PER_PART) -> DataFrame:
    """Recognised page texts of a document; a page without text carries its error.

    Expects doc_id, page_no, text and optionally error.
    """
    error = F.col("error") if "error" in pages.columns else F.lit("Unknown error")
    body = F.coalesce("text", F.concat(F.lit("[OCR Error: "), F.coalesce(error, F.lit("Unknown error")), F.lit("]")))
    head = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"))
    return _parts(pages.withColumn("_t", F.concat(head, body)), "_t", "\n\n", per_part)


def assign_bundles(files: DataFrame, per_bundle: int, order: str = "doc_id") -> DataFrame:
    """Number files in order and group them into bundles of ``per_bundle``.

    Bundle names carry as many digits as the bundle count has.  The numbering
    is block-wise, so the whole list never sorts in one task.
    """
    df = files.withColumn("_all", F.lit(1))
    # four levels of blocks keep every level small for dense and for hashed ids
    blocks = [page_block(order, 1 << k) for k in (52, 40, 24, 12)]
    numbered = running(df, ["_all"], blocks, [order], before="_n", total="_t")
    digits = F.length(F.ceil(F.col("_t") / F.lit(per_bundle)).cast("string"))
    bundle = (F.floor(F.col("_n") / F.lit(per_bundle)) + 1).cast("long")
    return numbered.withColumn("bundle_id", bundle).withColumn(
        "bundle_name",
        F.concat(F.lit("images_part_"), F.lpad(bundle.cast("string"), digits, F.lit("0")), F.lit(".pdf")),
    ).drop("_all", "_n", "_t")


def write_bundle(files: DataFrame, path: str) -> None:
    """Numbered files as a table in order of their bundles, a bundle within one part file; ``bundle_id`` stays a column."""
    files.repartitionByRange("bundle_id").sortWithinPartitions("bundle_id").write.mode("overwrite").parquet(path)
