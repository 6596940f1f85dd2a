"""Ranked search and look-ups over a catalogue of tools, and key audits."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.fuzzy import fuzzy_score

MIN_SCORE, MATCH_SCORE = 0.1, 0.3


def _spaced(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(" "))


def score_fields(df: DataFrame, query: str) -> DataFrame:
    """Best score and the field it came from; a later field must be strictly better.

    Fields in order: name, slug (reported as description), description, features.
    Texts repeat a lot, so callers may score distinct texts and join back.
    """
    q = F.lit(query)
    scored = df.withColumns(
        {
            "_name": fuzzy_score(q, F.col("name")),
            "_slug": fuzzy_score(q, _spaced(F.col("slug"))),
            "_desc": F.when(
                F.coalesce(F.col("description"), F.lit("")) != "", fuzzy_score(q, F.col("description"))
            ).otherwise(0.0),
            "_feat": F.coalesce(
                F.array_max(F.transform("features", lambda f: fuzzy_score(q, _spaced(f)))), F.lit(0.0)
            ),
        }
    )
    best = F.greatest("_name", "_slug", "_desc", "_feat")
    field = (
        F.when(F.col("_name") == best, "name")
        .when((F.col("_slug") == best) | (F.col("_desc") == best), "description")
        .otherwise("features")
    )
    return scored.withColumns({"score": best, "matched_field": field}).drop("_name", "_slug", "_desc", "_feat")


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows scoring at least 0.1, best first, catalogue order among equals."""
    if not query.strip():
        return score_fields(df, query).filter(F.lit(False))
    return score_fields(df, query).filter(F.col("score") >= MIN_SCORE).orderBy(F.desc("score"), "pos")


def suggest(df: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Names of the ``k`` best rows."""
    return search(df, query).limit(k).select("pos", "name", "score")


def matches_query(df: DataFrame, query: str) -> DataFrame:
    """Plain containment in name, slug, features, title or description, or a
    fuzzy score of 0.3 on name or title; an empty query matches all."""
    q = query.lower().strip()
    if not q:
        return df
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    cond = (
        has(_spaced(F.col("name")))
        | has(_spaced(F.col("slug")))
        | has(F.col("description"))
        | F.exists("features", lambda f: F.lower(_spaced(f)).contains(q))
        | (fuzzy_score(F.lit(q), F.lower("name")) >= MATCH_SCORE)
    )
    return df.filter(cond)


def by_id(df: DataFrame, ident) -> DataFrame:
    return df.filter((F.col("id") == ident) & ~F.col("disabled"))


def by_slug(df: DataFrame, slug: str) -> DataFrame:
    return df.filter((F.col("slug") == slug) & ~F.col("disabled"))


def by_category(df: DataFrame, category: str) -> DataFrame:
    return df.filter((F.col("category") == category) & ~F.col("disabled"))


def popular(df: DataFrame, ids: Sequence) -> DataFrame:
    """Enabled rows of an ordered id list, with their rank."""
    rank = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id"))
    return df.filter(F.col("id").isin(list(ids)) & ~F.col("disabled")).withColumn("rank", rank)


def category_counts(df: DataFrame) -> DataFrame:
    """Rows per category and in total (category null)."""
    return df.filter(~F.col("disabled")).rollup("category").agg(F.count("*").alias("n"))


def related(df: DataFrame) -> DataFrame:
    """(id, related_id, related_name) for links that exist."""
    links = df.select("id", F.explode("related").alias("related_id"))
    names = df.filter(~F.col("disabled")).select(F.col("id").alias("related_id"), F.col("name").alias("related_name"))
    return links.join(names, "related_id").select("id", "related_id", "related_name")


def dangling_related(df: DataFrame) -> DataFrame:
    """Links to rows that do not exist."""
    links = df.select("id", F.explode("related").alias("related_id"))
    return links.join(df.select(F.col("id").alias("related_id")), "related_id", "left_anti").select("id", "related_id")


def leaf_values(text: str | None) -> list[dict] | None:
    """Leaves of a JSON value as {path, value}: objects and arrays are entered to any depth, array items by their index.

    Strings stay as they are, other leaves are JSON text, null stays null.  Text that is no JSON has no leaves.
    """
    try:
        top = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(top, (dict, list)):
        return None
    out, todo = [], [("", top)]
    while todo:
        prefix, value = todo.pop()
        if isinstance(value, (dict, list)):
            inner = value.items() if isinstance(value, dict) else enumerate(value)
            todo.extend((f"{prefix}.{k}" if prefix else str(k), v) for k, v in inner)
        else:
            out.append({"path": prefix, "value": value if value is None or isinstance(value, str) else json.dumps(value)})
    return out


def flatten_keys(df: DataFrame, column: str = "json", key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Nested JSON as dotted keys: (key columns, path, value), one row per leaf of the parsed value."""

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(leaf_values, na_action=None)

    return df.select(*key, F.explode(leaves(column)).alias("leaf")).select(*key, "leaf.path", "leaf.value")


def audit_keys(base: DataFrame, other: DataFrame, key: Sequence[str] = ("path",), skip: Sequence[str] = ("brand",)) -> DataFrame:
    """(key columns, issue): missing in other, extra in other, or untranslated.

    One full join on the key gives all three answers.
    """
    b = base.select(*key, F.col("value").alias("_b"), F.lit(True).alias("_hb"))
    o = other.select(*key, F.col("value").alias("_o"), F.lit(True).alias("_ho"))
    issue = (
        F.when(F.col("_ho").isNull(), "missing")
        .when(F.col("_hb").isNull(), "extra")
        .when((F.col("_b") == F.col("_o")) & ~F.col(key[-1]).isin(*skip), "untranslated")
    )
    return b.join(o, list(key), "full").select(*key, issue.alias("issue")).filter("issue IS NOT NULL")


def lookup_with_fallback(keys: DataFrame, local: DataFrame, base: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Local value, else the base value, else the key itself.

    Leaves are many times the size of the files they come from, so neither side is sent whole to all executors."""
    l = local.select(*key, F.col("value").alias("_l")).hint("merge")
    b = base.select(*key, F.col("value").alias("_b")).hint("merge")
    return (
        keys.join(l, list(key), "left")
        .join(b, list(key), "left")
        .select(*key, F.coalesce("_l", "_b", F.col(key[-1])).alias("value"))
    )
