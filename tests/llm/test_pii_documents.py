"""Disclosing terms anywhere in the documents that hold the entity."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quirework.llm import pii

FILL = " ".join(f"common{chr(97 + k)}" for k in range(20))


def test_terms_far_from_the_entity(spark):
    far = f"zorbel {FILL} ann@site.example.org {FILL} zorbel Zorbel"
    rows = [(i, f"{far} {i}") for i in range(5)] + [(100 + i, f"{FILL} {i}") for i in range(60)] + [(200, None), (None, "x@y.zz")]
    # both near and far: the pair is found in the window, its far places belong to it
    rows += [(300 + i, f"quibber 10.0.0.1 {FILL} quibber {i}") for i in range(6)]
    # another entity's document keeps the term
    rows += [(400, f"zorbel {FILL} bob@site.example.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = {r.doc_id: r.text for r in pii.redact(df, threshold=0.9).collect()}
    assert len(clean) == len(rows)
    assert all("orbel" not in clean[i] and "common" in clean[i] for i in range(5))
    assert all("quibber" not in clean[300 + i] for i in range(6))
    assert clean[400] == f"zorbel {FILL} [EMAIL]" and clean[100] == f"{FILL} 0"


def test_free_terms():
    t = "one a@b.cc two @ one"
    assert pii.free_terms(t, pii.base_spans(t)) == {"one": [(0, 3), (17, 20)], "two": [(11, 14)]}


def slow_disclosing(texts, reach, threshold, support):
    """{(term, entity): disclosure} by counting everything, distinct texts once."""
    texts = {t or "" for t in texts}
    n, n_texts, near, near_texts, both, held, near_e = Counter(), Counter(), Counter(), defaultdict(set), Counter(), Counter(), Counter()
    for t in texts:
        n.update(w.lower() for w in re.findall(r"[^\W\d_]{3,}", t))
        n_texts.update({w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)})
        spans = pii.base_spans(t)
        free = [m for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(m.start() < e and s < m.end() for s, _, e in spans)]
        found = {pii.entity(k, t[s:e]) for s, k, e in spans}
        held.update(found)
        both.update((w, e) for e in found for w in {m[0].lower() for m in free})
        places = set()
        for s, k, e in spans:
            before, after = [m for m in free if m.start() < s], [m for m in free if m.start() >= e]
            places |= {(m.start(), m[0].lower(), pii.entity(k, t[s:e])) for m in before[-reach:] + after[:reach]}
        for _, w, e in places:
            near[w, e] += 1
            near_e[e] += 1
            near_texts[w, e].add(t)
    out: dict = {}

    def rate(pair, both, of, p_e):
        score = 0.0 if p_e >= 1 else math.log(min(1.0, both / of) / p_e) / -math.log(p_e)
        if score >= threshold:
            out[pair] = max(score, out.get(pair, -1.0))

    for (w, e), k in near.items():
        if len(near_texts[w, e]) >= support:
            rate((w, e), k, n[w], near_e[e] / max(1, sum(n.values()), near_e[e]))
    for (w, e), k in both.items():
        if k >= support:
            rate((w, e), k, n_texts[w], held[e] / max(1, len(texts), held[e]))
    return out


def check(spark, rows, reach, threshold, support):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    base = pii.base(df, reach).cache()
    got = {(r.term, r.entity): r.disclosure for r in pii.disclosing(base, df, threshold, support).collect()}
    want = slow_disclosing([t for _, t in rows], reach, threshold, support)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)
    return want


def test_disclosure_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    words = ["w" + "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 60))) for _ in range(80)]
    people = [f"p{i}@mail.org" for i in range(6)] + ["10.0.0.1", "+49 30 1234567"]
    rows = [(0, ""), (1, None)]
    for i in range(120):
        who = r.choice(people[: 1 + i % 8])
        own = [words[people.index(who)]] * (i % 3) + [r.choice(words) for _ in range(r.randint(0, 40))]
        r.shuffle(own)
        rows.append((i, " ".join([*own[:9], who, *own[9:]]) if i % 4 else " ".join(own)))
    rows += [r.choice(rows) for _ in range(60)]
    assert check(spark, rows, 8, 0.2, 3)
    assert check(spark, rows, 2, 0.1, 2)
    monkeypatch.setattr(pii, "HELD", 16)  # many partial sums
    assert check(spark, rows, 8, 0.2, 3)


def test_disclosure_over_a_whole_table(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert check(spark, rows, 8, 0.1, 1)
    check(spark, rows, 8, 0.95, 3)


def test_copies_count_once(spark):
    rows = [(i, "please mail bob@example.org today") for i in range(8)] + [(20, "please mail me today"), (21, "mail"), (22, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "please mail [EMAIL] today" and clean[20] == rows[8][1]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cc x", "k", 5, {"a": 1}), (2, None, "l", None, None)], "doc_id long, text string, text_key string, row long, base map<string,int>")
    out = pii.redact(df)
    assert out.schema == df.schema
    assert sorted(map(tuple, out.collect())) == [(1, "[EMAIL] x", "k", 5, {"a": 1}), (2, None, "l", None, None)]


def test_long_words_around_an_entity():
    long = ["".join(chr(97 + (i * k) % 26) for k in range(500)) for i in range(1, 13)]
    t = " ".join([*long[:6], "a@b.cc", *long[6:]])
    assert [x["term"] for x in pii.near_terms(t, pii.base_spans(t), 8)] == long
