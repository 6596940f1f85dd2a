"""Comparison against brute force: alignment, page pairing, moved text."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.operators import align, compare


def slow_ops(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif j and (i == 0 or t[i][j - 1] >= t[i - 1][j]):
            j -= 1
            out.append((-1, j))
        else:
            i -= 1
            out.append((i, -1))
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_alignment_equals_table(a, b):
    assert compare.lcs_ops(a, b) == slow_ops(a, b)


def similar(x, y):
    x, y = "".join(x.split()), "".join(y.split())
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    return 2 * sum(c in set(x) for c in y) / (len(x) + len(y))


def slow_pairs(a, b):
    n, m = len(a), len(b)
    s = [[similar(x, y) for y in b] for x in a]
    t = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = t[i - 1][j - 1] + s[i - 1][j - 1] if s[i - 1][j - 1] >= 0.25 else max(t[i - 1][j], t[i][j - 1])
    out, i, j = [], n, m
    while i or j:
        if i and j and s[i - 1][j - 1] >= 0.25:
            out.append((i, j))
            i, j = i - 1, j - 1
        elif j and (i == 0 or t[i][j - 1] >= t[i - 1][j]):
            out.append((None, j))
            j -= 1
        else:
            out.append((i, None))
            i -= 1
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [None, 3, 1])
def test_page_pairing_equals_table(spark, monkeypatch, size):
    if size:
        monkeypatch.setattr(compare, "align", lambda pages, at_least: align.align(pages, at_least, size))
    random.seed(5)
    kinds = ["", "abc abd", "xyz zzy x", "0123 99", "abx 01"]
    a_rows, b_rows, docs = [], [], {}
    for d in range(40):
        a = [random.choice(kinds) for _ in range(random.randint(1, 9))]
        b = [random.choice(kinds) for _ in range(random.randint(1, 9))]
        docs[d] = (a, b)
        a_rows += [(d, i + 1, t) for i, t in enumerate(a)]
        b_rows += [(d, i + 1, t) for i, t in enumerate(b)]
    schema = "doc_id long, page_no long, text string"
    got = compare.pair_pages(spark.createDataFrame(a_rows, schema), spark.createDataFrame(b_rows, schema)).collect()
    for d, (a, b) in docs.items():
        mine = sorted(((r.page_a, r.page_b) for r in got if r.pair_id == d), key=str)
        assert mine == slow_pairs(a, b), (a, b)


def test_pairing_moves_letters_and_not_texts(spark):
    kinds = ["", None, " \t\n", "abc abd\u00a0", "xyz ✂ zzy𝒳", "über𝒳", "aa\u0001 b", "a" * 5000]
    schema = "doc_id long, page_no long, text string"
    a, b = (spark.createDataFrame([(d * 10 + e, 1, (x, y)[side]) for d, x in enumerate(kinds) for e, y in enumerate(kinds)], schema) for side in (0, 1))
    written = []
    real = compare.materialise
    try:
        compare.materialise = lambda df, purpose: written.append(real(df, purpose)) or written[-1]
        got = {(r.page_a, r.page_b, r.pair_id): r for r in compare.pair_pages(a, b, keep_text=True).collect()}
    finally:
        compare.materialise = real
    assert "string" not in [t for _, t in written[0].dtypes]
    for d, x in enumerate(kinds):
        for e, y in enumerate(kinds):
            mine = [r for r in got.values() if r.pair_id == d * 10 + e]
            squeezed = ["".join(c for c in t or "" if c not in " \t\n\x0b\f\r") for t in (x, y)]
            if x is not None and y is not None:
                p, q = squeezed
                s = 1.0 if not p and not q else 0.0 if not p or not q else 2 * sum(c in p for c in q) / (len(p) + len(q))
            if x is None or y is None:
                assert [(r.similarity, r.text_a, r.text_b) for r in mine] == [(None, x, y)]
            elif s >= compare.PAGE_MATCH:
                assert [(r.similarity, r.text_a, r.text_b) for r in mine] == [(s, x, y)]
            else:
                assert sorted((r.page_a or 0, r.text_a or "", r.text_b or "") for r in mine) == [(0, "", y), (1, x, "")]


def test_scores_of_a_block():
    r = np.random.default_rng(3)
    for n, m in ((1, 1), (1, 7), (7, 1), (5, 9), (12, 4), (0, 3), (3, 0)):
        s = r.random((n, m)).round(2)
        hit = s >= 0.6
        top, left = r.random(m + 1), r.random(n + 1)
        left[0] = top[0]
        want = np.zeros((n + 1, m + 1))
        want[0], want[:, 0] = top, left
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                want[i, j] = want[i - 1, j - 1] + s[i - 1, j - 1] if hit[i - 1, j - 1] else max(want[i - 1, j], want[i, j - 1])
        assert (align.fill(s, hit, top, left) == want).all()


def letters_of(n, seed):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list(alphabet), 6)) for alphabet in ("abcdef", "ghijkl", "mnopqr", "stuvwx", "0123456")]
    return [words[k] if k < 5 else "" for k in r.integers(0, 6, n)]


def pages_of(spark, a, b):
    rows = [(1, 2, s, i + 1, t) for s, side in (("a", a), ("b", b)) for i, t in enumerate(side)]
    return spark.createDataFrame(rows, "pair_id long, _break long, side string, page_no long, t string")


def in_order(rows):
    return [(r.page_a, r.page_b, r.similarity) for r in sorted(rows, key=lambda r: -r.pair_no)]


def test_blocks_equal_one_block(spark):
    a, b = letters_of(1300, 1), letters_of(1100, 2)
    one = align.align(pages_of(spark, a, b), 0.25, 2000).collect()
    cut = align.align(pages_of(spark, a, b), 0.25, 256).collect()
    assert sorted(r.pair_no for r in cut) == sorted(range(-1 - len(cut), -1))
    assert in_order(one) == in_order(cut)
    assert any(r.page_a is None for r in cut) and any(r.page_b is None for r in cut) and any(r.similarity for r in cut)


def test_two_long_dissimilar_versions(spark, monkeypatch):
    """20,000 pages a side over 100 blocks: every page once, both in order, matches alike, and no block larger than its bound."""
    a, b = letters_of(20_000, 4), letters_of(20_000, 5)
    rows = align.align(pages_of(spark, a, b), 0.25, 2048).sort(F.desc("pair_no")).collect()
    for side in ("page_a", "page_b"):
        assert [r[side] for r in rows if r[side] is not None] == list(range(20_000, 0, -1))
    assert all((r.similarity is not None) == (r.page_a is not None and r.page_b is not None) for r in rows)
    assert all(r.similarity >= 0.25 and similar(a[r.page_a - 1], b[r.page_b - 1]) == r.similarity for r in rows if r.similarity is not None)


def test_moved_text_equals_loops(spark):
    random.seed(7)
    rows = []
    for seq in range(120):
        text = "".join(random.choice("abcdef") for _ in range(random.randint(3, 14)))
        rows.append((1, seq, random.choice(["added", "deleted", "modified"]), text))
    # reading order runs over pairs: two marks of different pairs may share mark_no
    df = spark.createDataFrame(
        [(p, -9 + seq // 16, seq % 16, kind, text) for p, seq, kind, text in rows],
        "pair_id long, pair_no long, mark_no long, type string, text string",
    )

    def seq(pair_no, mark_no):
        return (pair_no + 9) * 16 + mark_no

    got = {
        (seq(r.added_pair, r.added_mark), seq(r.deleted_pair, r.deleted_mark), r.is_target)
        for r in compare.find_moved(df).collect()
    }
    owner, target = {}, {}
    for _, ds, kind, dt in rows:
        if kind == "deleted" and len(dt) >= 5:
            for _, as_, k2, at in rows:
                if k2 == "added" and len(at) >= 5 and as_ not in owner and similar(dt, at) >= 0.85:
                    owner[as_] = ds
                    target[ds] = as_
    assert got == {(a, d, target[d] == a) for a, d in owner.items()}


def moved_rows(rows, spark):
    return spark.createDataFrame(rows, "pair_id long, pair_no long, mark_no long, type string, text string")


def slow_first(rows):
    """{(pair, added text): place of the first deleted text alike}."""
    out = {}
    deleted = sorted((p, n, m, t) for p, n, m, kind, t in rows if kind == "deleted" and len(t) >= 5)
    for p, _, _, kind, t in rows:
        if kind == "added" and len(t) >= 5:
            first = next(((n, m) for q, n, m, d in deleted if q == p and similar(d, t) >= 0.85), None)
            if first:
                out[p, t] = first
    return out


@pytest.mark.parametrize("letters,longest,heads", [("abcdefghijklmnopqrstuvwxyz", 30, 0), ("abcdefgh", 12, 0), ("aeiouäß€😀xyz", 60, 2), ("abcdefghijklmnopqrstuvwxyz", 200, 8)])
def test_first_alike_by_letters(spark, monkeypatch, letters, longest, heads):
    monkeypatch.setattr(compare, "MOVED_FIRST", heads)
    r = random.Random(longest)
    texts = ["".join(r.choices(letters, weights=range(1, len(letters) + 1), k=r.randint(5, longest))) for _ in range(160)]
    rows = [(i % 2, i // 40, i % 40, r.choice(["added", "deleted"]), r.choice(texts)) for i in range(400)]
    got = {(x.pair_id, x.t): tuple(x.deleted) for x in first_alike_of(moved_rows(rows, spark)).collect()}
    assert got == slow_first(rows)


def first_alike_of(marks):
    marks = marks.withColumns({"t": F.col("text"), "place": F.struct("pair_no", "mark_no")})
    letters = F.array_join(F.array_sort(F.array_distinct(F.split("t", ""))), "")
    kinds = marks.where("type = 'deleted'").groupBy("pair_id", letters.alias("letters"), F.length("t").alias("n")).agg(F.min("place").alias("place"))
    return compare.first_alike(kinds, marks.where("type = 'added'").select("pair_id", "t").distinct())


def test_few_pairs_on_a_hot_document(spark, monkeypatch):
    """Segments of prose, short and long, of one document: those that match hardly meet anything, and only short ones that match nothing are joined."""
    r = random.Random(11)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkjqxz", weights=range(26, 0, -1), k=r.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(6000):
        text = "".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 20, 60])))
        rows.append((1, i // 100, i % 100, "added" if i % 2 else "deleted", text))
    made = []
    keep = compare.moved_candidates
    monkeypatch.setattr(compare, "moved_candidates", lambda k, t: made.append(keep(k, t)) or made[-1])
    found = first_alike_of(moved_rows(rows, spark)).count()
    pairs = made[0].count()
    print("pairs", pairs, "found", found)
    assert found > 2000 and pairs + compare.MOVED_FIRST * 3000 < 3000 * 3000 / 4


def word(text, x, y, font="F"):
    return {"text": text, "x": x, "y": y, "w": 10.0, "h": 8.0, "font": font}


def words(*rows):
    return {c: [r[c] for r in rows] for c in compare.BOX}


def test_highlights_join_and_classify():
    wa = words(
        word("a", 0.0, 400.0), word("b", 12.0, 400.0), word("c", 24.0, 400.0), word("foot", 0.0, 790.0)
    )
    wb = words(word("a", 0.0, 400.0, "G"), word("x", 12.0, 400.0))
    marks, differing = compare.page_highlights(wa, wb, 800.0, 800.0)
    assert differing == 4
    assert list(zip(marks["side"], marks["type"], marks["text"], marks["category"])) == [
        ("a", "modified", "a", "formatting"),
        ("a", "deleted", "bc", "text"),
        ("a", "deleted", "foot", "header-footer"),
        ("b", "modified", "a", "formatting"),
        ("b", "added", "x", "text"),
    ]
    assert marks["w"][1] == 24.0
    empty, none = compare.page_highlights(words(), words(), 800.0, 800.0)
    assert empty["text"] == [] and none == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), max_size=20))
def test_islands_follow_their_first_box(rows):
    y = np.array([float(v) for v, _ in rows])
    joined = np.array([j for _, j in rows], dtype=bool)
    want, anchor, n = [], None, -1
    for v, j in rows:
        if n < 0 or not j or abs(v - anchor) >= compare.SAME_LINE:
            anchor, n = v, n + 1
        want.append(n)
    assert compare.islands(y, joined).tolist() == want


def test_moved_text_through_page_pairs(spark):
    """A deleted page and an inserted one: both texts keep their own marks."""
    schema = "doc_id long, page_no long, text string"
    a = spark.createDataFrame([(1, 1, "abcdefgh"), (1, 2, "12345678"), (1, 3, "stuvwxyz")], schema)
    b = spark.createDataFrame([(1, 1, "12345678"), (1, 2, "stuvwxyz"), (1, 3, "ABCDEFGH abcdefgh"), (1, 4, "abcdefgh")], schema)
    pairs = compare.pair_pages(a, b, keep_text=True)
    numbers = sorted(r.pair_no for r in pairs.collect())
    assert numbers == list(range(1 - len(numbers), 1))

    def boxed(text):
        one = F.struct(
            F.col(text).alias("text"), F.lit(9.0).alias("x"), F.lit(400.0).alias("y"),
            F.lit(10.0).alias("w"), F.lit(8.0).alias("h"), F.lit("F").alias("font"),
        )
        return F.when(F.col(text).isNotNull(), F.array(one))

    marks = compare.diff_words(
        pairs.withColumns(
            {"words_a": boxed("text_a"), "words_b": boxed("text_b"), "height_a": F.lit(800.0), "height_b": F.lit(800.0)}
        )
    )
    got = {(r.side, r.type, r.text, r.to_page) for r in compare.mark_moved(marks).collect()}
    assert got == {
        ("a", "moved", "abcdefgh", 4), ("b", "moved", "abcdefgh", 1), ("b", "added", "ABCDEFGH abcdefgh", None),
    }


def test_difference_counts(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, ["a", "b", "c"], ["b", "c", "d", "e"]), (2, None, 1, None, ["x"])],
        "pair_id long, page_a long, page_b long, words_a array<string>, words_b array<string>",
    )
    got = {r.pair_id: r for r in compare.diff_percent(compare.word_ops(df)).collect()}
    assert (got[1].equal, got[1].added, got[1].deleted, got[1].diff_percent) == (2, 2, 1, 75.0)
    assert got[2].diff_percent == 100.0


def test_hidden_kinds(spark):
    df = spark.createDataFrame([("moved", "text"), ("added", "formatting"), ("added", "text")], ["type", "category"])
    assert compare.filter_highlights(df, ("moved", "formatting")).count() == 1
    assert compare.filter_highlights(df).count() == 3
    assert df.filter(F.lit(True)).count() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_moved_text_sends_no_table_whole(spark, tmp_path):
    """Files are far smaller than their rows under each letter: a join that trusts a file's size fills the driver."""
    rows = [(i % 7, 0, i, "added" if i % 2 else "deleted", f"text of number {i}") for i in range(200)]
    moved_rows(rows, spark).write.parquet(f"{tmp_path}/marks")
    marks = spark.read.parquet(f"{tmp_path}/marks")
    assert "Broadcast" not in plan_of(first_alike_of(marks))
    kinds = marks.where("type = 'deleted'").selectExpr("pair_id", "text AS letters", "length(text) AS n", "struct(pair_no, mark_no) AS place")
    assert "Broadcast" not in plan_of(compare.moved_candidates(kinds, marks.selectExpr("pair_id", "text AS t")))


def test_boxes_of_words_equal_the_expression(spark):
    from pyspark.sql import functions as F

    from quirework.functions import text as T

    rows = [(1, "two words\n  of \t lines \n\nx", "中文 a\nb c"), (2, None, ""), (3, "é😀 z y v", "one")]
    df = spark.createDataFrame(rows, "pair_id long, text_a string, text_b string").withColumns({"font_a": F.lit("F1"), "font_b": F.when(F.col("pair_id") > 1, "F2")})

    def by_expression(c, font):
        word = lambda i: lambda w: F.struct(w["text"].alias("text"), w["x"].alias("x"), (F.lit(40.0) + i * 14.0).alias("y"), w["w"].alias("w"), F.lit(10.0).alias("h"), font.alias("font"))
        return F.flatten(F.transform(F.split(c, "\n"), lambda line, i: F.transform(T.tokenize_words(line, F.lit(50.0), F.length(line) * 5.0), word(i))))

    want = df.select("pair_id", by_expression(F.col("text_a"), F.col("font_a")).alias("words_a"), by_expression(F.col("text_b"), F.col("font_b")).alias("words_b"))
    got = compare.box_words(df)
    assert got.orderBy("pair_id").collect() == want.orderBy("pair_id").collect()


def test_equal_endings_need_no_scores():
    class Word(str):
        hashed = 0

        def __hash__(self):
            Word.hashed += 1
            return str.__hash__(self)

    a = [Word(f"w{i}") for i in range(500)]
    assert compare.lcs_ops(a, [Word(w) for w in a]) == [(i, i) for i in range(500)]
    assert Word.hashed == 0
    assert compare.lcs_ops(["x"], ["x", "x"]) == [(-1, 0), (0, 1)]


@pytest.mark.parametrize("whole", [1 << 20, 60, 0])
def test_texts_of_pairs_come_with_their_document(spark, monkeypatch, whole):
    """Texts cut from whole documents, or page by page from long ones, are those that page tables give."""
    from quirework.operators.paginate import page_texts, paginate

    monkeypatch.setattr(compare, "WHOLE", whole)
    r = random.Random(5)
    docs = [(i, "\n".join("".join(r.choices("abcdefghij ", k=r.randrange(12))) for _ in range(r.randrange(1, 14)))) for i in range(30)]
    docs = spark.createDataFrame([*docs, (30, None), (None, "a\nb")], "doc_id long, text string")
    edited = lambda t: F.regexp_replace(t, "(?m)^a.*\n", "")
    a, b = paginate(docs, 2), paginate(docs.select("doc_id", edited(F.col("text")).alias("text")), 2)
    cols = ("pair_id", "pair_no", "page_a", "page_b", "similarity", "text_a", "text_b")
    want = compare.pair_pages(a, b, keep_text=True).select(*cols).collect()
    got = compare.pair_texts(compare.pair_pages(a, b), docs, lambda t: page_texts(t, 2), lambda t: page_texts(edited(t), 2))
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want)) and len(want) > 90


def test_texts_of_a_pair_move_once(spark, monkeypatch):
    """Texts come to the pairs with their document: pages of usual documents are made after the exchange and not before."""
    from quirework.plans import text_queries

    seen = []
    keep = compare.box_words
    monkeypatch.setattr(compare, "box_words", lambda df: seen.append(df) or keep(df))
    text_queries.diff_highlights(spark, "/root/testdata/sf0.001")
    plan = plan_of(seen[0])
    assert "hashpartitioning(pair_id" in plan and "REBALANCE" not in plan


def test_few_deleted_texts_make_no_pairs(spark, monkeypatch):
    """A document's deleted texts are all tried at once if they are few; only what stands behind them is joined on letters."""
    made = []
    keep = compare.moved_candidates
    monkeypatch.setattr(compare, "moved_candidates", lambda k, t: made.append((k.count(), t.count())) or keep(k, t))
    r = random.Random(3)
    most = compare.MOVED_FIRST * compare.MOVED_MORE
    many = [(d, 0, i, kind, "".join(r.choices("abcdefghijklmnopqrst", k=r.randint(5, 9)))) for d, n in ((1, 60), (2, most + 40)) for kind in ("added", "deleted") for i in range(n)]
    got = {(x.pair_id, x.t): tuple(x.deleted) for x in first_alike_of(moved_rows(many, spark)).collect()}
    assert got == slow_first(many)
    assert made[0][0] <= 40 and made[0][1] <= most + 40


def test_moved_marks_know_their_place(spark):
    """Marks get page and position of the other end, also those that share a mark number."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=r.randint(3, 9))) for _ in range(40)]
    rows = []
    for p in range(3):
        for i in range(80):
            side = r.choice("ab")
            kind = r.choice(["deleted" if side == "a" else "added", "modified"]) if i % 3 else ("deleted" if side == "a" else "added")
            rows.append((p, -(i // 9), i % 9, 10 + i // 9, 20 + i // 9, side, kind, r.choice([*words, None]), float(i), float(-i)))
    marks = spark.createDataFrame(rows, "pair_id long, pair_no long, mark_no long, page_a long, page_b long, side string, type string, text string, x double, y double")
    place = {(m[0], m[1], m[2]): m for m in rows}
    want = {k: (m[6], None, None, None) for k, m in place.items()}
    for x in compare.find_moved(marks).collect():
        d, a = (x.pair_id, x.deleted_pair, x.deleted_mark), (x.pair_id, x.added_pair, x.added_mark)
        want[a] = ("moved", place[d][3], place[d][8], place[d][9])
        if x.is_target:
            want[d] = ("moved", place[a][4], place[a][8], place[a][9])
    got = {(x.pair_id, x.pair_no, x.mark_no): (x.type, x.to_page, x.to_x, x.to_y) for x in compare.mark_moved(marks).collect()}
    assert got == want and sum(v[0] == "moved" for v in want.values()) > 20
