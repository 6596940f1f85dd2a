"""URL filtering by host rules and by pattern rules that are looked up through their rarest literal token.

Only DataFrame functions.  Verdicts are computed once per distinct url and joined back, so a url or host with a third of
all rows costs one row before the join.

Edge cases: a url that is null or has no ``://`` has an empty host and path, fits no host rule and gets the default verdict
unless a pattern fits its text (null: default).  Ports and user names stay part of the host.  Repeated rows each get their
verdict.  Among fitting host rules the longest (host and path together) wins, ties to the smaller rule text; among fitting
patterns the one given first.  Extra columns of the input are kept.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az

#: Rules are options held by the driver and are broadcast; this bound is checked.
MAX_RULES = 200_000


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``tokens``: runs of a-z and 0-9 that stand as whole tokens in every lower-cased url the pattern matches.  A rule
    without any is tried on every url."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_az(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens, and the empty one under which rules without a token are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lower_az(url), r"[^a-z0-9]+")))


def host_hits(urls: DataFrame, rules: Sequence[HostRule]) -> DataFrame:
    """url, rule, verdict: the longest fitting host rule of each url that has one."""
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(r.host, r.path, r.text, r.verdict) for r in rules], "r_host string, r_path string, rule string, verdict string"
    )
    labels = F.split(F.col("host"), r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return (
        urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .select("url", "path", F.explode(tails).alias("r_host"))
        .join(F.broadcast(table), "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("url")
        .agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "rule")).alias("h"))
        .select("url", "h.rule", "h.verdict")
    )


def rule_index(urls: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """token, rule_no, pattern, p_verdict: each rule under the literal token that the fewest urls have."""
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(i, r.pattern, r.verdict, list(r.tokens) or [""]) for i, r in enumerate(rules)],
        "rule_no int, pattern string, p_verdict string, tokens array<string>",
    )
    wanted = table.select("rule_no", "pattern", "p_verdict", F.explode("tokens").alias("token"))
    counts = (
        urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    return (
        wanted.join(counts, "token", "left")
        .groupBy("rule_no", "pattern", "p_verdict")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )


def pattern_hits(urls: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """url, pattern, p_verdict: the first pattern that matches each url that has one."""
    return (
        urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(F.broadcast(rule_index(urls, rules)), "token")
        .where(F.expr("rlike(url, pattern)"))
        .groupBy("url")
        .agg(F.min_by(F.struct("pattern", "p_verdict"), "rule_no").alias("p"))
        .select("url", "p.pattern", "p.p_verdict")
    )


def filter_urls(
    pages: DataFrame,
    host_rules: Sequence[HostRule],
    pattern_rules: Sequence[PatternRule] = (),
    default: str = "allow",
    url: str = "url",
) -> DataFrame:
    """``pages`` with host, path, rule, pattern and verdict (columns of these names are replaced)."""
    if len(host_rules) + len(pattern_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: split the list and keep the longest fit of each part")
    urls = pages.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    found = host_hits(urls, host_rules).join(pattern_hits(urls, pattern_rules), "url", "full")
    hits = found.select(
        F.col("url").alias("__url"),
        "rule",
        F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern"),
        F.coalesce("verdict", "p_verdict").alias("verdict"),
    )
    own = pages.drop("host", "path", "rule", "pattern", "verdict")
    link = F.coalesce(F.col(url), F.lit(""))
    return (
        own.join(hits, own[url] == hits["__url"], "left")
        .select(
            *[own[c] for c in own.columns],
            host_of(link).alias("host"),
            path_of(link).alias("path"),
            hits["rule"],
            hits["pattern"],
            F.coalesce(hits["verdict"], F.lit(default)).alias("verdict"),
        )
    )
