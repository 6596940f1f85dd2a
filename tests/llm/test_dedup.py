"""Substring removal and SimHash against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import automata, repeats, simhash, suffixdedup


def brute(sequences, size):
    """Per (id, sequence): which symbols go."""
    first: dict = {}
    for i, s in sequences:
        for a in range(len(s) - size + 1):
            g = tuple(s[a : a + size])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, s in sequences:
        gone = [False] * len(s)
        for a in range(len(s) - size + 1):
            if first[tuple(s[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        out.append(gone)
    return out


def n_spans(gone):
    return sum(g and not (a and gone[a - 1]) for a, g in enumerate(gone))


def expected_bytes(rows, size=50):
    seqs = [(i, (t or "").encode()) for i, t in rows]
    return sorted((i, len(s), sum(g), n_spans(g), hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()) for (i, s), g in zip(seqs, brute(seqs, size)))


def expected_words(rows, size=13):
    seqs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    return sorted((i, len(s), sum(g), hashlib.sha256(" ".join(w for w, x in zip(s, g) if not x).encode()).hexdigest()) for (i, s), g in zip(seqs, brute(seqs, size)))


def test_bytes(docs, docs_rows):
    got = sorted(tuple(r) for r in suffixdedup.dedup_bytes(docs).drop("spans").collect())
    want = expected_bytes(docs_rows)
    assert sum(w[2] for w in want) > 1000
    assert got == want


@pytest.mark.parametrize("wide", [1, 5, 20_000])
def test_bytes_in_many_chunks(docs, docs_rows, wide, monkeypatch):
    finder = suffixdedup.ByteFinder()
    answer = repeats.Finder.answer_triggers

    def narrow(shard, rows):
        repeats.WIDE = wide
        return answer(shard, rows)

    finder.answer_triggers = narrow
    got = finder.run(docs, chunk_bytes=3000, shard_bytes=9000).drop("spans").collect()
    assert sorted(tuple(r) for r in got) == expected_bytes(docs_rows)


def test_words(docs, docs_rows):
    got = sorted(tuple(r) for r in automata.dedup_words(docs).drop("spans").collect())
    want = expected_words(docs_rows)
    assert sum(w[2] for w in want) > 300
    assert got == want
    few = automata.WordFinder().run(docs, chunk_bytes=3000, shard_bytes=9000).drop("spans").collect()
    assert sorted(tuple(r) for r in few) == want


def test_without_ids_and_empty(spark):
    text = "the same long passage of more than fifty bytes and of more than thirteen words that repeats here, and here again"
    rows = [(None, text), (None, text), (1, text), (1, text), (2, text + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixdedup.dedup_bytes(df).select("doc_id", "n_removed").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, len(text))]
    got = automata.dedup_words(df).select("doc_id", "n_removed").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 20)]
    for f in (suffixdedup.dedup_bytes, automata.dedup_words, simhash.near_duplicates):
        assert f(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "abcdefghij klmnop " * 60_000 + "end"
    df = spark.createDataFrame([(1, text), (2, "zz " + text)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffixdedup.dedup_bytes(df).collect()}
    assert got == {1: 0, 2: len(text) + 1}  # the space before it repeats too
    got = {r.doc_id: r.n_removed for r in automata.dedup_words(df).collect()}
    assert got == {1: 0, 2: len(text.split())}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=14), min_size=1, max_size=8))
def test_automaton(sequences):
    auto = automata.SuffixAutomaton()
    for i, s in enumerate(sequences):
        auto.add(s, i)
    auto.finish()
    first: dict = {}
    for i, s in enumerate(sequences):
        for a in range(len(s) - 2):
            first.setdefault(tuple(s[a : a + 3]), i)
    for s in sequences:
        assert auto.windows(s, 3) == [first[tuple(s[a : a + 3])] for a in range(len(s) - 2)]


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[a : a + 3]) for a in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps):
    """Smallest reachable id by brute force over (id, fingerprint)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least: dict = {}
    for a, (i, _) in enumerate(fps):
        least[find(a)] = min(least.get(find(a), i), i)
    return [least[find(a)] for a in range(len(fps))]


def test_simhash(docs, docs_rows):
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [(i, slow_fingerprint(t)) for i, t in docs_rows]
    want = sorted((i, f, c) for (i, f), c in zip(fps, components(fps)))
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})
    assert got == want


def test_simhash_links_chains_and_balls(spark):
    r = np.random.default_rng(3)
    fps = {0, 7, (1 << 64) - 1}
    for _ in range(12):
        c = int(r.integers(0, 1 << 63)) * 2
        for _ in range(40):
            x = c
            for b in r.integers(0, 64, size=r.integers(0, 3)):
                x ^= 1 << int(b)
            fps.add(x)
        for _ in range(30):  # a chain of steps of three bits
            for b in r.integers(0, 64, size=3):
                c ^= 1 << int(b)
            fps.add(c)
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "fp long")
    roots = {r.v % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(df)).collect()}
    want = components(rows)
    mine = [roots.get(f, f) for _, f in rows]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))
