"""A training corpus in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontam, langid, nearcopies, packing, pii
from quirework.llm.queries import tokenizer_path
from quirework.session import materialise

#: SQL can express neither the language model nor the order of packing; tests compare with brute force.
ORACLE_SQL = None


def private(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    taken = {c.lower() for c in docs.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language has half the letters, go."""
    return langid.keep_identified(docs, langid.train(docs.where(langid.fold(F.col("doc_id")) != 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: that with the smallest id, rows without id last.

    Rows are told apart by id and text: of different texts under one id each is judged by itself, and of rows with equal id
    and text the one with the smallest number of all other columns stays."""
    key, row, root = (private(docs, n) for n in ("text", "row", "component"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    # maps have no order and no hash, but a JSON text
    number = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    keyed = docs.select("*", nearcopies.text_key().alias(key), number.alias(row))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("t"), F.col(row).alias("r"))
    found = nearcopies.near_copies(docs).select(F.col("text_key").alias(key), F.col("component").alias(root))
    kept = keyed.select("doc_id", key, row).join(found, key).groupBy(root).agg(F.min(order).alias("k")).select("k.*")
    own, more = keyed.alias("o"), kept.alias("k")
    same = F.col("o.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"o.{key}") == F.col("k.t")) & (F.col(f"o.{row}") == F.col("k.r"))
    one = own.join(more, same, "left_semi").dropDuplicates(["doc_id", key, row])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms replaced; the number of characters follows where there is one."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), added_tokens=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", remove_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
