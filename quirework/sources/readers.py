"""Readers: file manifests, plain text, JSON, mail and HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.names import mime_from_name


def _doc_id():
    """A stable id from the path, so re-reading gives the same key."""
    return F.xxhash64(F.col("path"))


def read_files(
    spark: SparkSession, path: str, glob: str | None = None, content: bool = False
) -> DataFrame:
    """File manifest; ``content`` is read only when asked for.

    Spark's file sources leave out files of zero bytes, here and in streams, so
    the empty-file rule only applies to manifests that come from elsewhere.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return manifest(r.load(path), content)


def manifest(raw: DataFrame, content: bool = False) -> DataFrame:
    name = F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))
    cols = [
        _doc_id().alias("doc_id"),
        name.alias("filename"),
        mime_from_name(name).alias("mime"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_ts"),
        F.col("path"),
    ]
    return raw.select(*cols, *(["content"] if content else []))


def read_text_docs(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One document per text file: (doc_id, filename, text)."""
    raw = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    return raw.select(_doc_id().alias("doc_id"), F.substring_index("path", "/", -1).alias("filename"), F.col("value").alias("text"))


def read_json_docs(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One JSON document per file: (doc_id, filename, json, error_code).

    Text that does not parse is kept with an error code instead of failing.
    """
    docs = read_text_docs(spark, path, glob)
    return check_json(docs)


def read_json_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One JSON document per line: (filename, json, error_code).

    Spark cuts a large file by bytes, so one file is read by many tasks; a line
    that does not parse is kept with an error code.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return check_json(lines.select(name.alias("filename"), F.col("value").alias("text")).where("trim(text) <> ''"))


def read_mailboxes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Messages of mail boxes: (filename, envelope, raw, error_code).

    A message begins with a ``From `` line (sender and date); such lines inside a
    message are quoted by ``>``.  The line break before it separates records, so
    Spark cuts a large box by bytes.  What has no sender and date on its first
    line is kept whole, with an error code.  Line breaks at a message's end
    belong to the box.
    """
    r = spark.read.option("lineSep", "\nFrom ").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    # the first record of a file still has its mark, the others lost it to the separator
    own = r.select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("filename"), F.regexp_replace("value", "^From ", "").alias("t")).where("trim(t) <> ''")
    envelope = F.substring_index("t", "\n", 1)
    good = envelope.rlike(r"^\S+ +[A-Z][a-z]{2} [A-Z][a-z]{2} ")
    body = F.when(F.position(F.lit("\n"), F.col("t")) > 0, F.substring("t", F.position(F.lit("\n"), F.col("t")) + 1, F.length("t"))).otherwise("")
    raw = F.regexp_replace(F.regexp_replace(body, r"(?m)^>(>*From )", "$1"), r"\n+\z", "")
    return own.select("filename", F.when(good, envelope).alias("envelope"), F.when(good, raw).otherwise(F.col("t")).alias("raw"), F.when(~good, "FILE_CORRUPTED").alias("error_code"))


def check_json(docs: DataFrame) -> DataFrame:
    """Exactly one JSON value per text.  The parser stops behind the first value, so the text is tried as the only item of
    an array and as the only field of an object: what follows a value breaks one of the two."""
    alone = [F.try_parse_json(F.concat(F.lit(a), "text", F.lit(z))) for a, z in (("[", "]"), ('{"v":', "}"))]
    ok = alone[0].isNotNull() & alone[1].isNotNull()
    return docs.select(
        *[c for c in docs.columns if c != "text"],
        F.col("text").alias("json"),
        F.when(~ok, F.lit("FILE_CORRUPTED")).alias("error_code"),
    )


def read_emails(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """Raw messages for ``parse_emails``: (doc_id, filename, raw)."""
    return read_text_docs(spark, path, glob).withColumnRenamed("text", "raw")


def html_pages(df: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """A table with an HTML column as the page source of the HTML operators."""
    rest = [c for c in df.columns if c not in (key, column)]
    return df.select(F.col(key).alias("page_id"), F.col(column).alias("html"), *rest)


def marked_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, line: lines of files that begin with their document's id and a comma."""
    raw = spark.read.schema("value string").text(path)
    at = F.position(F.lit(","), F.col("value"))
    return raw.select(F.substring("value", F.lit(1), at - 1).cast("long").alias("doc_id"), F.substring(F.col("value"), at + 1, F.length("value")).alias("line"))
