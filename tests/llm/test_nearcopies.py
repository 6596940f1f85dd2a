"""The pipeline's near-duplicate stage against exact similarities."""

import random

from quirework.llm import nearcopies

COLUMNS = "doc_id long, text string, lang string"


def stage(spark, rows):
    import corpus_pipeline

    df = spark.createDataFrame([(i, t, "en") for i, t in rows], COLUMNS).repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def text(r, n=200):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def kept(rows):
    """Smallest row of each component, by brute force."""
    sets, root = [nearcopies.shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * min(len(sets[a]), len(sets[b])) < 4 * max(len(sets[a]), len(sets[b])):
                continue
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    least: dict = {}
    for x, (i, t) in zip(root, rows, strict=True):
        key = (i is None, i or 0, t or "")
        least[x] = min(least.get(x, key), key)
    return sorted(least.values())


def test_copies_far_apart_in_bits_and_unlike_texts(spark, monkeypatch):
    r, rows = random.Random(5), []
    for g in range(25):
        base = text(r)
        rows.append((10 * g, " ".join(base)))
        for k, changed in enumerate((1, 2, 3, 4, 6, 9), 1):  # similarity of about 0.95 down to 0.63
            w = list(base)
            for p in r.sample(range(200), changed):
                w[p] = "changed" + str(r.random())
            rows.append((10 * g + k, " ".join(w)))
    base = text(r)
    for k in range(60):  # one large group
        w = list(base)
        for p in r.sample(range(200), k % 4):
            w[p] = "other" + str(k)
        rows.append((1000 + k, " ".join(w).upper() if k == 7 else " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "One  two")]
    want = kept(rows)
    assert 25 < len(want) < 120
    assert [(i is None, i or 0, t or "") for i, t in stage(spark, rows)] == want
    monkeypatch.setattr(nearcopies, "SMALL", 2)
    monkeypatch.setattr(nearcopies, "LEADERS", 1)
    assert [(i is None, i or 0, t or "") for i, t in stage(spark, rows)] == want


def test_rows_without_id_and_texts_under_one_id(spark):
    r = random.Random(6)
    a, b, c, d = (" ".join(text(r, 30)) for _ in range(4))
    rows = [(None, a), (None, b), (3, b), (5, c), (5, d), (4, d), (7, c), (7, c), (None, a)]
    assert stage(spark, rows) == [(3, b), (4, d), (5, c), (None, a)]
    assert stage(spark, rows[:0]) == []


def test_common_passage_does_not_bring_pairs_together(spark, monkeypatch):
    """Texts that share 70 to 95 % of their words: few reach 0.8, and pairs below it are hardly ever made."""
    r = random.Random(8)
    shared = text(r, 70)
    rows = []
    for g in range(150):
        own = text(r, r.choice([8, 20, 25]))
        rows.append((10 * g, " ".join(own + shared)))
        if g % 10 == 0:
            rows.append((10 * g + 1, " ".join(own + shared + ["more"])))
    made = []
    write = nearcopies.materialise
    monkeypatch.setattr(nearcopies, "materialise", lambda df, name: made.append((name, write(df, name))) or made[-1][1])
    want = kept(rows)
    assert [(i is None, i or 0, t or "") for i, t in stage(spark, rows)] == want
    pairs = [df.count() for name, df in made if name == "pairs"]
    assert len(pairs) == 3 and pairs[2] < 10 * len(rows), pairs


def test_clashing_and_map_columns(spark):
    r = random.Random(9)
    rows = [(i, " ".join(text(r, 20)), {"a": i}, "x", 1) for i in range(4)]
    rows += [(9, rows[0][1], {"a": 9}, "y", 2), (0, rows[0][1], {"a": 0, "b": 1}, "x", 1), (0, rows[0][1], {"a": 0}, "x", 1)]
    import corpus_pipeline

    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, __text string, __row int")
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted(x.doc_id for x in out.collect()) == [0, 1, 2, 3]


def test_whole_table(spark):
    """Rows kept of a given table, against all pairs."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert [(i is None, i or 0, t or "") for i, t in stage(spark, rows)] == kept(rows)


def test_a_large_group_is_joined_by_fingerprints(spark, monkeypatch):
    """Near copies of one text: what few bits join, bands do not pair again."""
    r = random.Random(12)
    base, rows = text(r, 600), []
    for k in range(300):
        w = list(base)
        w[r.randrange(600)] = f"other{k}"
        rows.append((k, " ".join(w)))
    made = []
    write = nearcopies.materialise
    monkeypatch.setattr(nearcopies, "materialise", lambda df, name: made.append((name, write(df, name))) or made[-1][1])
    assert stage(spark, rows) == [rows[0]]
    count = {name: df.count() for name, df in reversed(made) if name in ("alike", "pairs")}
    print(count)
    assert 250 < count.get("alike", 0) <= 300 and count["pairs"] < 30 * len(rows) / 10, count
