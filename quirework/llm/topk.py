"""Exact top-k by inner product: branch and bound over dimension blocks in vertical layout.

Candidates are laid out in blocks of rows, each stored dimension by dimension; queries in blocks of their own.  Every candidate
block meets every query block once, as a pair of two binary values keyed by both numbers, so no side is broadcast and a
task holds one pair at a time.  Within a pair, a query takes the dimension blocks in descending order of its own mass, adds up
partial scores, bounds what is left by the product of the blocks' norms, and keeps only candidates whose upper bound
reaches the k-th best lower bound.  Pairs give at most k rows per query, which are ranked in the end.

Components are floor(scale * x) of the components as doubles; scores are exact integers (doubles below 2^53, else Python integers,
cut to the range of a long).  Edge cases: vectors that are null or hold null or non-finite components, and rows without
an id, take no part; shorter vectors are filled up with zeros; an empty vector scores 0.  A query never returns rows of its own
id; a repeated id is asked once and answered by each of its rows.  Ties go to the smaller id.  Fewer than k candidates: all
of them.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 8
FOUND = "query_id long, vec_id long, score long"


def pack(ids: list[int], vectors: list, scale: float) -> bytes:
    """Ids and components of a block, dimension after dimension."""
    width = max(map(len, vectors), default=0)
    m = np.zeros((width, len(vectors)))
    for i, v in enumerate(vectors):
        m[: len(v), i] = np.floor(scale * np.asarray(v, dtype=np.float64))
    m = m.astype("<f4") if (np.abs(m).max(initial=0) < 1 << 24) else m
    return np.array([len(ids), width, m.itemsize], dtype="<i8").tobytes() + np.array(ids, dtype="<i8").tobytes() + m.tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, size = np.frombuffer(block, dtype="<i8", count=3)
    ids = np.frombuffer(block, dtype="<i8", count=n, offset=24)
    return ids, np.frombuffer(block, dtype=f"<f{size}", offset=24 + 8 * n).reshape(width, n).astype(np.float64)


def best(query: np.ndarray, x: np.ndarray, norms: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of ``x`` among ``alive`` that may be in the top k, with their scores."""
    cuts = range(0, len(query), DIMS)
    mass = np.array([np.sqrt(np.dot(query[c : c + DIMS], query[c : c + DIMS])) for c in cuts])
    order = np.argsort(-mass, kind="stable")
    part = np.zeros(len(alive))
    whole = len(alive) == x.shape[1]
    for i, b in enumerate(order):
        rows = x[b * DIMS : (b + 1) * DIMS]
        part = part + query[b * DIMS : (b + 1) * DIMS] @ (rows if whole else rows[:, alive])
        rest = order[i + 1 :]
        if len(alive) > k and i % 2:
            left = mass[rest] @ (norms[rest] if whole else norms[np.ix_(rest, alive)]) * (1 + 1e-9) + 1e-6
            low = part - left
            reach = part + left >= np.partition(low, len(low) - k)[len(low) - k]
            if reach.sum() < 0.8 * len(alive):
                alive, part, whole = alive[reach], part[reach], False
    return alive, part


def search(q_block: bytes, x_block: bytes, k: int) -> tuple[list[int], list[int], list[int]]:
    """Up to k rows for each query of one pair of blocks."""
    (qids, q), (ids, x) = unpack(q_block), unpack(x_block)
    width = max(len(q), len(x))
    q, x = (np.vstack([m, np.zeros((width - len(m), m.shape[1]))]) for m in (q, x))
    out: tuple[list, list, list] = ([], [], [])
    exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(width, 1) < 1 << 53
    norms = np.array([np.sqrt((x[c : c + DIMS] ** 2).sum(axis=0)) for c in range(0, width, DIMS)]) if exact else None
    for j, qid in enumerate(qids.tolist()):
        alive = np.flatnonzero(ids != qid)
        if exact and width:
            if len(alive) == len(ids):
                alive = np.arange(len(ids))
            alive, score = best(np.ascontiguousarray(q[:, j]), x, norms, alive, k)
            score = score.astype(np.int64)
        else:
            mine = [int(v) for v in q[:, j]]
            exactly = [sum(a * int(b) for a, b in zip(mine, x[:, c], strict=True)) for c in alive]
            score = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exactly], dtype=np.int64)
        top = np.lexsort((ids[alive], ~score))[:k]
        out[0].extend([qid] * len(top))
        out[1].extend(ids[alive[top]].tolist())
        out[2].extend(score[top].tolist())
    return out


def blocks(vecs: DataFrame, n: int, scale: float) -> DataFrame:
    """no, block: the vectors dealt into ``n`` blocks."""

    def make(key, rows):
        ids = rows.column("vec_id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        vectors = rows.column("embedding").to_pylist()
        return pa.table({"no": [key[0].as_py()], "block": [pack([ids[i] for i in order], [vectors[i] for i in order], scale)]}, pa.schema([("no", pa.int64()), ("block", pa.binary())]))

    dealt = vecs.withColumn("no", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    return dealt.groupBy("no").applyInArrow(make, "no long, block binary")


def top_k(vecs: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vecs`` (vec_id, embedding) that fulfil ``is_query``."""
    e = F.col("embedding")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    vecs = vecs.withColumn("vec_id", F.col("vec_id").cast("long")).where(F.col("vec_id").isNotNull() & e.isNotNull() & ok)
    queries = vecs.where(is_query).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    vecs = vecs.select("vec_id", "embedding")
    n, m = vecs.count(), queries.count()
    n_x, n_q = max(1, math.ceil(n / rows)), max(1, math.ceil(m / query_rows))
    x = blocks(vecs, n_x, scale).select(F.col("no").alias("x_no"), F.col("block").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("q_no"))
    q = blocks(queries, n_q, scale).select(F.col("no").alias("q_no"), F.col("block").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_x - 1).cast("long"))).alias("x_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, c = search(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), k)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, c)], names=["query_id", "vec_id", "score"])

    found = q.join(x, ["x_no", "q_no"]).select("q", "x").mapInArrow(run, FOUND)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
