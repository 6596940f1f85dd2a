import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import postings, queries

TYPE = "vec_id long, embedding array<double>, label int, ids string, list int"


def slow(rows, k, each=10):
    """{query id: [(distance, id)]} of all rows, nearest first, each id once."""
    ok = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in ok), default=0)
    ids, x = [i for i, _ in ok], np.array([v + [0.0] * (width - len(v)) for _, v in ok]).reshape(len(ok), width)
    out = {}
    for q in sorted({i for i in ids if i % each == 0}):
        own = x[min((v, at) for at, (i, v) in enumerate(ok) if i == q)[1]]
        with np.errstate(over="ignore"):
            d = np.sqrt(((x - own) ** 2).sum(axis=1))
        best: dict = {}
        for i, dist in zip(ids, d.tolist(), strict=True):
            if i != q:
                best[i] = min(dist, best.get(i, math.inf))
        out[q] = sorted((dist, i) for i, dist in best.items())[:k]
    return out


def found(spark, rows, k=5, each=10, **more):
    data = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], TYPE).repartition(3)
    got: dict = {}
    for r in sorted(postings.search(data, F.col("vec_id") % each == 0, k, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.score, r.vec_id))
    return got


def near(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for _, i in a[q]] == [i for _, i in b[q]]
        assert [d for d, _ in a[q]] == pytest.approx([d for d, _ in b[q]], rel=1e-12)


def vectors(seed, n, dims=12, base=0):
    r = random.Random(seed)
    return [(base + i, [r.gauss(0, 1) for _ in range(dims)]) for i in range(n)]


#: With a ratio without end every list is read, so answers are exact and the bookkeeping can be tested.
ALL = {"ratio": 1e9, "list_rows": 20, "segment_rows": 30}


def test_all_lists_give_exact_answers(spark):
    rows = vectors(1, 200)
    rows += [(300 + i, rows[3][1]) for i in range(40)]  # equal vectors, queries among them
    rows += [(20, rows[20][1])] * 3 + [(30, [0.5] * 12), (500, [1.0, 2.0]), (None, [1.0] * 12)]
    rows += [(600, None), (610, []), (620, [0.0] * 12), (630, [float("nan")] * 12), (640, [float("inf"), 1.0]), (650, [None, 1.0])]
    near(found(spark, rows, **ALL), slow(rows, 5))


def test_few_and_no_vectors(spark):
    rows = vectors(2, 3)
    near(found(spark, rows), slow(rows, 5))
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0])]) == {}
    assert found(spark, [(10, [0.0])]) == {}


def test_only_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)]
    near(found(spark, rows), slow(rows, 5))


def test_large_and_small_components(spark):
    rows = vectors(3, 30) + [(100 + i, [x * 1e200 for x in v]) for i, v in vectors(4, 20)] + [(200 + i, [x * 1e-200 for x in v]) for i, v in vectors(5, 20)]
    got, want = found(spark, rows, **ALL), slow(rows, 5)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_recall_on_clustered_vectors(spark):
    r = np.random.default_rng(6)
    middle = r.normal(size=(40, 32)) * 3
    rows = [(i, (middle[i % 40] + r.normal(size=32) * 0.7).tolist()) for i in range(4000)]
    got, want = found(spark, rows, 10), slow(rows, 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_lists_are_balanced_and_few_are_read():
    r = np.random.default_rng(7)
    x = np.repeat(r.normal(size=(64, 16)) * 4, 100, axis=0) + r.normal(size=(6400, 16)) * 0.5
    own, share = postings.fit(x, 100)
    assert len(own) == 100 and share.max() < 4 / 100
    graph = postings.links(own)
    lists = list(postings.walk(x[::50], own, graph, 1.15))
    exact = np.sqrt(postings.squared(x[::50], own))
    exact = exact <= 1.15 * exact.min(axis=1, keepdims=True)
    assert sum(map(len, lists)) >= 0.98 * exact.sum()
    assert np.mean([len(v) for v in lists]) < 10


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_given_tables(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = slow(rows, 10, 100)
    got: dict = {}
    for r in queries.op11_postings(spark, path).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for _, i in want[q]}) for q in want)
    recall = hits / sum(map(len, want.values()))
    print(sf, "recall", recall)
    assert recall >= 0.9
