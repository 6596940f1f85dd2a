"""Approximate nearest neighbours from balanced posting lists (Euclidean distance).

Distinct vectors are dealt into lists around centroids.  Centroids are fitted on the driver to a sample of at most ``sample_rows``
vectors a list and ``max_lists`` lists (both parameters): the sample is halved again and again at the median of its main direction,
so all lists begin equally long; a few rounds of means follow, in which a list under a quarter of the average moves to halve the longest.
Every vector is indexed: in its nearest list, and at a border also in up to ``replicas`` lists whose centroid is within ``border``
times the nearest distance.  A list longer than ``segment_rows`` is cut into segments by hash, their number estimated from the sample.

A query searches the centroids in a graph that each task holds in memory (nearest centroids and links back, at most
``max_lists`` nodes, so its size is bounded): nodes are expanded as long as they are within ``ratio`` times the best distance found, and those
lists are selected, however many they are.  Each (list, segment) meets its queries in one group; distances are computed on the original vectors in double
precision.  The index is built with matrix products instead of the graph, as all vectors of a batch are compared at once.

Equal vectors are one entry that keeps its ``k`` + 1 smallest ids, which is all that any answer can hold, and equal query vectors are searched once,
so neither a third of equal rows nor of equal queries meets in one task.

Edge cases: vectors that are null, all zeros, empty, or hold null or non-finite components, and rows without id, take no part; shorter vectors are filled
up with zeros.  A query never returns rows of its own id; a repeated id is asked once, with its smallest vector, and answered by each of its
vectors, at its least distance.  Ties go to the smaller id.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import materialise

from .common import slices

LINKS = 16
SALTS = 8
MANY = 1 << 30


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows of doubles, the shorter ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, dtype=np.int64)
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    width = max(width, int(size.max(initial=0)))
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T), 0)


def halves(x: np.ndarray, rows: np.ndarray, lists: int) -> Iterator[np.ndarray]:
    """Rows in ``lists`` parts of equal length, cut across the main direction."""
    if lists == 1 or len(rows) < 2:
        yield rows
        return
    own = x[rows] - x[rows].mean(axis=0)
    v = own[np.argmax((own**2).sum(axis=1))]
    for _ in range(8):
        v = own.T @ (own @ v)
        n = np.linalg.norm(v)
        v = v / n if n else v
    order = rows[np.argsort(own @ v, kind="stable")]
    cut = len(rows) * (lists // 2) // lists
    yield from halves(x, order[:cut], lists // 2)
    yield from halves(x, order[cut:], lists - lists // 2)


def fit(x: np.ndarray, lists: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the share of the sample in each list."""
    parts = [p for p in halves(x, np.arange(len(x)), lists) if len(p)]
    own = np.array([x[p].mean(axis=0) for p in parts])
    for _ in range(rounds):
        label = np.concatenate([squared(x[s : s + 4096], own).argmin(axis=1) for s in range(0, len(x), 4096)])
        order = np.argsort(label, kind="stable")
        size = np.bincount(label, minlength=len(own))
        groups = np.split(order, np.cumsum(size)[:-1])
        own = np.array([x[g].mean(axis=0) if len(g) else c for g, c in zip(groups, own, strict=True)])
        longest = list(np.argsort(-size, kind="stable"))
        for c in np.flatnonzero(size < len(x) / len(own) / 4):
            at = longest.pop(0)
            if size[at] > 2 * len(x) / len(own):
                a, b = halves(x, groups[at], 2)
                own[c], own[at] = x[a].mean(axis=0), x[b].mean(axis=0)
    label = np.concatenate([squared(x[s : s + 4096], own).argmin(axis=1) for s in range(0, len(x), 4096)])
    return own, np.bincount(label, minlength=len(own)) / len(x)


def links(centroids: np.ndarray) -> np.ndarray:
    """Neighbours of each centroid: its nearest, the next one in number so that all are linked, and links back; -1 for none."""
    n, near = len(centroids), min(LINKS, len(centroids) - 1)
    of: list[set[int]] = [{(i + 1) % n, (i - 1) % n} for i in range(n)]
    for s in range(0, n, 1024):
        d = squared(centroids[s : s + 1024], centroids)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :near]):
            for j in row.tolist():
                of[s + i].add(j)
                of[j].add(s + i)
    out = np.full((n, max(map(len, of))), -1)
    for i, own in enumerate(of):
        out[i, : len(own)] = sorted(own)
    return out


def walk(queries: np.ndarray, centroids: np.ndarray, graph: np.ndarray, ratio: float, beam: int = 8) -> Iterator[np.ndarray]:
    """For each query the centroids within ``ratio`` of the nearest, found along the graph from a few entries."""
    n = len(centroids)
    entries = np.unique(np.linspace(0, n - 1, 8).astype(int))
    for s in range(0, len(queries), 256):
        q = queries[s : s + 256]
        d = np.full((len(q), n), np.inf)
        d[:, entries] = squared(q, centroids[entries])
        known = np.zeros(d.shape, dtype=bool)
        known[:, entries] = True
        todo = known.copy()
        while True:
            best = np.partition(d, min(beam, n) - 1, axis=1)[:, min(beam, n) - 1]
            limit = np.maximum(d.min(axis=1) * ratio**2, np.where(np.isfinite(best), best, 0))
            row, node = np.nonzero(todo & (d <= limit[:, None]))
            if not len(row):
                break
            todo[row, node] = False
            row, node = np.repeat(row, graph.shape[1]), graph[node].ravel()
            new = node >= 0
            row, node = row[new], node[new]
            fresh = np.unique((row * n + node)[~known[row, node]])
            row, node = fresh // n, fresh % n
            d[row, node] = ((q[row] - centroids[node]) ** 2).sum(axis=1)
            known[row, node] = todo[row, node] = True
        for own in d <= d.min(axis=1, keepdims=True) * ratio**2:
            yield np.flatnonzero(own)


def usable(vecs: DataFrame) -> DataFrame:
    e = F.col("embedding")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vecs.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & ok)


def entries(vecs: DataFrame, k: int) -> DataFrame:
    """embedding, ids: the distinct vectors with their ``k`` + 1 smallest ids."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = vecs.select("embedding", "vec_id").distinct().withColumn("no", F.row_number().over(first)).where(F.col("no") <= k + 1)
    return ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def nearest(x: np.ndarray, ids: list[list[int]], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, id and distance of each query's ``k`` nearest ids."""
    out: list[tuple] = []
    with np.errstate(over="ignore", invalid="ignore"):
        norm, own = (x**2).sum(axis=1), (q**2).sum(axis=1)
        slack = 1e-12 * (norm.max() + own)
        for s in range(0, len(q), 256):
            rough = norm + own[s : s + 256, None] - 2 * (q[s : s + 256] @ x.T)
            for i, row in enumerate(rough, s):
                near = np.arange(len(x))
                if len(x) > k and np.isfinite(slack[i]):
                    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack[i])
                d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                found = sorted((dist, j) for dist, at in zip(d.tolist(), near.tolist(), strict=True) for j in ids[at])[:k]
                out += [(i, j, dist) for dist, j in found]
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return np.array(cols[0], dtype=np.int64), np.array(cols[1], dtype=np.int64), np.array(cols[2], dtype=np.float64)


def search(
    vecs: DataFrame, is_query: Column, k: int = 10, list_rows: int = 64, max_lists: int = 4096, sample_rows: int = 32,
    replicas: int = 4, border: float = 1.1, ratio: float = 1.15, segment_rows: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score (distance) of the ``k`` nearest found for the rows of ``vecs`` (vec_id, embedding) that fulfil ``is_query``."""
    spark = vecs.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    vecs = usable(vecs)
    index = materialise(entries(vecs, k), "entries")
    n, width, top = index.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], empty)
    # very large components would overflow when squared; distances of the answers are computed unscaled
    scale = 1.0 if top < 1e100 else 1.0 / top
    lists = min(max_lists, max(1, round(n / list_rows)))
    share = min(1.0, lists * sample_rows / n)
    hashed = F.pmod(F.xxhash64("embedding"), F.lit(MANY))
    sample = index.where(hashed < math.ceil(share * MANY)).select("embedding").limit(2 * lists * sample_rows).toArrow()
    x = matrix(sample.column(0), width) * scale if sample.num_rows else np.zeros((1, width))
    centroids, shares = fit(x, min(lists, len(x)))
    graph = links(centroids)
    segments = np.maximum(1, np.ceil(shares * n * replicas / segment_rows)).astype(np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                d = np.sqrt(squared(matrix(part.column(0), width) * scale, centroids))
                order = np.argpartition(d, min(replicas, d.shape[1]) - 1, axis=1)[:, :replicas]
                chosen = np.take_along_axis(d, order, axis=1) <= border * d.min(axis=1, keepdims=True)
                row, at = np.nonzero(chosen)
                to = order[row, at]
                seg = np.asarray(part.column(2)).astype(np.int64)[row] % segments[to]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(seg.astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows)], names=["list", "seg", "embedding", "ids"])

    kind = dict(index.dtypes)["embedding"]
    posted = index.select("embedding", "ids", hashed.alias("h")).mapInArrow(deal, f"list int, seg int, embedding {kind}, ids array<long>")

    asked = vecs.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    heads = materialise(asked.groupBy("embedding").agg(F.min("vec_id").alias("q_no")), "queries")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                found = list(walk(matrix(part.column(0), width) * scale, centroids, graph, ratio))
                row = np.repeat(np.arange(len(found)), [int(segments[f].sum()) for f in found])
                to = np.concatenate([np.repeat(f, segments[f]) for f in found])
                seg = np.concatenate([np.arange(m) for f in found for m in segments[f]])
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(seg.astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows)], names=["list", "seg", "embedding", "q_no"])

    routed = heads.mapInArrow(select, f"list int, seg int, embedding {kind}, q_no long")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            row, ids, dist = nearest(matrix(left.column("embedding"), width), left.column("ids").to_pylist(), matrix(right.column("embedding"), width), k + 1)
            parts = [np.asarray(right.column("q_no"))[row], ids, dist]
        return pa.table([pa.array(p) for p in parts], names=["q_no", "vec_id", "score"])

    found = posted.groupBy("list", "seg").cogroup(routed.groupBy("list", "seg")).applyInArrow(meet, "q_no long, vec_id long, score double")
    # a vector in several lists is found several times
    once = found.groupBy("q_no", "vec_id").agg(F.min("score").alias("score"))
    ranked = Window.partitionBy("q_no").orderBy("score", "vec_id")
    best = once.withColumn("no", F.row_number().over(ranked)).where(F.col("no") <= k + 1)
    best = best.groupBy("q_no").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    salted = best.join(heads, "q_no").select("embedding", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = asked.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(salted, ["embedding", "salt"])
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return (
        rows.select(F.col("vec_id").alias("query_id"), "found")
        .select("query_id", F.posexplode(own).alias("at", "f"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
    )
