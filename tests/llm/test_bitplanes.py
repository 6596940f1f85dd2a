import hashlib
import math
import random

import numpy as np
import pytest

from quirework.llm import bitplanes

TYPE = "vec_id long, embedding array<double>, cluster string, planes int"


def slow(rows, k, rounds=3):
    """(vec_id, cluster, distance, cluster inertia, inertia, centroid) by plain integers."""
    ok = [(i, [math.floor(64 * x) if math.isfinite(64 * x) else 64 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    own = [v for _, v in sorted(ok, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(own)) for _, v in ok]

    for _ in range(rounds):
        near = assign()
        for n in range(len(own)):
            mine = [v for (_, v), (_, c) in zip(ok, near, strict=True) if c == n]
            if mine:
                own[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    most = (1 << 63) - 1
    cut = [(min(d, most), c) for d, c in near]
    of = lambda n: min(sum(d for d, c in cut if c == n), most)
    return sorted(((i, c, d, of(c), min(sum(x for x, _ in cut), most), ",".join(map(str, own[c]))) for (i, _), (d, c) in zip(ok, cut, strict=True)), key=str)


def found(spark, rows, k=5):
    data = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], TYPE).repartition(3)
    return sorted(map(tuple, bitplanes.cluster(data, k).collect()), key=str)


def vectors(seed, n, scale=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, scale) for _ in range(64)]) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = vectors(1, 120)
    rows += [(7, rows[7][1]), (200, rows[3][1]), (201, rows[3][1]), (None, rows[4][1]), (None, [0.0] * 64)]
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 63 + [None]), (303, [float("nan")] * 64), (304, [float("inf")] * 64), (305, []), (306, [-1e-300] * 64)]
    assert found(spark, rows) == slow(rows, 5)


def test_components_of_any_size_stay_exact(spark):
    rows = vectors(2, 12) + [(100 + i, v) for i, v in vectors(3, 6, 1e6)] + [(200 + i, v) for i, v in vectors(4, 6, 1e25)] + [(300, [1.7e308] * 64), (301, [-1.7e308] * 64)]
    assert found(spark, rows, 4) == slow(rows, 4)


def test_few_and_no_vectors(spark):
    rows = vectors(5, 3)
    assert found(spark, rows, 16) == slow(rows, 16)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []


def test_rows_without_id_begin_clusters_last(spark):
    rows = [(None, v) for _, v in vectors(6, 4)] + vectors(7, 2)
    assert found(spark, rows, 3) == slow(rows, 3)


@pytest.mark.parametrize("low,high", [(-3, 3), (0, 1), (-1, 0), (-(1 << 20), 1 << 20)])
def test_dot_products_of_planes(low, high):
    r = np.random.default_rng(8)
    a, b = (r.integers(low, high, size=(20, 64), endpoint=True) for _ in range(2))
    assert (bitplanes.dots(bitplanes.planes(a), bitplanes.planes(b)) == (a * b).sum(axis=1)).all()
    limbs = bitplanes.components(bitplanes.planes(a))
    assert (sum(limb << (bitplanes.LIMB * i) for i, limb in enumerate(limbs)) == a).all()
