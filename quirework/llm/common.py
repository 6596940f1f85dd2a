"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batch, max_bytes: int = 8 << 20):
    """Consecutive slices of an Arrow batch of about ``max_bytes`` each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * max_bytes / max(batch.get_total_buffer_size(), 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)
