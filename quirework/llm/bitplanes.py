"""Centroid clustering on bit planes: exact dot products and distances from weighted AND-popcounts.

A vector of 64 components, each the integer floor(scale * x), is stored as its two's-complement bit planes: plane i packs bit i of all
components into one uint64 and weighs 2^i, the last plane -2^i.  The dot product of two vectors is the sum over all pairs of planes
of both weights times the popcount of their AND, and |x|^2 likewise, so squared distances are exact integers.  Each
vector has as many planes as its widest component needs.

A round assigns every vector to its nearest centroid (ties: smaller number) and replaces each centroid by the floor of its
vectors' mean.  Tasks add up their own vectors per centroid and component; only these k x 64 partial sums are shuffled, and the driver
receives k x 64 totals.  Planes are written once to the shared folder and read in each round.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part.  Repeated rows count
as often as they occur.  Rows without an id are clustered and keep a null id, and may begin a cluster only after all rows with
one; of equal ids the smaller vector comes first.  Fewer vectors than centroids: one centroid for each.  Components of any size stay
exact; distances and inertias beyond a long are given as its largest value.  Extra columns are ignored.  An empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import materialise

from .common import slices

DIMS = 64
LONG = (1 << 63) - 1
#: Bits of one limb of a partial sum: a task may add up 2^38 of them in a long.
LIMB = 24
#: Planes of either side up to which weights, popcounts and distances fit a long; wider vectors (components from 2^26 on) are multiplied as
#: Python integers, as the pairs of their planes grow with the square of their width.
NARROW = 27


def integers(vector: list[float], scale: float) -> list[int]:
    """floor(scale * x) of each component."""
    scaled = [scale * x for x in vector]
    return [math.floor(s) if math.isfinite(s) else int(x) * int(scale) for s, x in zip(scaled, vector, strict=True)]


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes, rows x planes, of integers (rows x 64); an object array holds integers of any size."""
    least, most = int(x.min(initial=0)), int(x.max(initial=0))
    width = max((~least).bit_length(), most.bit_length()) + 1
    out = np.empty((len(x), width), dtype="<u8")
    for i in range(width):
        bits = ((x >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def as_planes(components: list[int]) -> np.ndarray:
    return planes(np.array([components], dtype=object))


def weights(width: int) -> list[int]:
    return [1 << i for i in range(width - 1)] + [-(1 << (width - 1))]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot product of each row of planes ``a`` (n x p) with the planes ``b`` (n x q or 1 x q)."""
    if max(a.shape[1], b.shape[1]) > NARROW:
        return (exact(a) * exact(b)).sum(axis=1)
    out = np.zeros(len(a), dtype=np.int64)
    for i, u in enumerate(weights(a.shape[1])):
        for j, v in enumerate(weights(b.shape[1])):
            out += np.bitwise_count(a[:, i] & b[:, j]).astype(np.int64) * (u * v)
    return out


def exact(x: np.ndarray) -> np.ndarray:
    """Integers of any size (rows x 64) from planes."""
    return sum(limb.astype(object) << (LIMB * at) for at, limb in enumerate(components(x)))


def nearest(x: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, for rows of planes."""
    own, best, label = dots(x, x), None, np.zeros(len(x), dtype=np.int32)
    for no, c in enumerate(centroids):
        d = own - 2 * dots(x, c) + dots(c, c)[0]
        if best is None:
            best = d
        else:
            less = (d < best).astype(bool)
            best, label = np.where(less, d, best), np.where(less, no, label).astype(np.int32)
    return label, best


def _by_width(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and planes of the vectors with equally many planes."""
    raw = values.to_pylist()
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        yield at, np.frombuffer(b"".join(raw[i] for i in at), dtype="<u8").reshape(len(at), -1)


def whole(vecs: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part."""
    e = F.col("embedding")
    ok = e.isNotNull() & (F.size(e) == DIMS) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vecs.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def packed(vecs: DataFrame, scale: float) -> DataFrame:
    """vec_id, planes of whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(-1, DIMS)
                with np.errstate(over="ignore"):
                    y = np.floor(scale * x)
                wide = (np.abs(y) >= 1 << (NARROW - 1)).any(axis=1)
                out: list = [None] * len(x)
                for i, p in zip(np.flatnonzero(~wide), planes(y[~wide].astype(np.int64)), strict=True):
                    out[i] = p.tobytes()
                for i in np.flatnonzero(wide):
                    out[i] = as_planes(integers(x[i].tolist(), scale)).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["vec_id", "planes"])

    return vecs.mapInArrow(run, "vec_id long, planes binary")


def components(x: np.ndarray) -> np.ndarray:
    """Integers (rows x 64) from planes, limb after limb: limbs x rows x 64."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.shape[1], 8), axis=2, bitorder="little").astype(np.int64)
    out = []
    for at in range(0, x.shape[1], LIMB):
        part = bits[:, at : at + LIMB]
        w = np.array([1 << i for i in range(part.shape[1])], dtype=np.int64)
        w[-1] *= -1 if at + part.shape[1] == x.shape[1] else 1
        out.append(np.einsum("npd,p->nd", part, w))
    return np.array(out)


def totals(data: DataFrame, centroids: list[np.ndarray]) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid with vectors: their number and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for _, x in _by_width(part.column(0)):
                    label, _ = nearest(x, centroids)
                    limbs = components(x)
                    for c in np.unique(label):
                        mine = label == c
                        for at, limb in enumerate(limbs):
                            s = sums.setdefault((int(c), at), np.zeros(DIMS + 1, dtype=np.int64))
                            s[:DIMS] += limb[mine].sum(axis=0)
                            s[DIMS] += mine.sum() if at == 0 else 0
        for (c, at), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(s), pa.int32()), pa.array([at] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(s)], names=["c", "at", "i", "n"])

    parts = data.select("planes").mapInArrow(run, "c int, at int, i int, n long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("c", "at", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        count, total = out.get(r.c, (0, [0] * DIMS))
        if r.i == DIMS:
            count += int(r.n)
        else:
            total[r.i] += int(r.n) << (LIMB * r.at)
        out[r.c] = count, total
    return out


def first_centroids(vecs: DataFrame, k: int, scale: float, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vecs.select(h.alias("h"), "embedding").orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).collect()
    return [integers(r.embedding, scale) for r in rows]


def cluster(vecs: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components as decimal integers joined by commas)."""
    vecs = whole(vecs)
    data = materialise(packed(vecs, scale), "planes")
    own = first_centroids(vecs, k, scale, seed)
    for _ in range(rounds if own else 0):
        found = totals(data, [as_planes(c) for c in own])
        own = [[s // found[i][0] for s in found[i][1]] if i in found else c for i, c in enumerate(own)]
    centroids = [as_planes(c) for c in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                label, distance = np.zeros(part.num_rows, dtype=np.int32), np.zeros(part.num_rows, dtype=np.int64)
                for at, x in _by_width(part.column(1)):
                    label[at], d = nearest(x, centroids)
                    distance[at] = np.minimum(d, LONG)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    near = materialise(data.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.s) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    text = [",".join(map(str, c)) for c in own]
    rows = [(i, min(inertia.get(i, 0), LONG), min(sum(inertia.values()), LONG), t) for i, t in enumerate(text)]
    # at most k rows
    of = near.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string")
    return near.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
