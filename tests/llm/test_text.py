"""Decontamination, PII, language ID, packing, pipeline against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.llm import decontam, langid, packing, pii, queries


SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contaminated(docs, items, n=10):
    wins: dict = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for a in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for size in {len(k) for k in wins}:
            for a in range(len(w) - size + 1):
                if (g := tuple(w[a : a + size])) in wins:
                    hit.update(range(a, a + size))
                    found |= wins[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [16 << 20, 400])
def test_decontamination(spark, docs, docs_rows, block, monkeypatch):
    texts = [t for _, t in docs_rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:25]).upper()), (12, " ".join(texts[1].split()[:10])), (3, "a, b"), (4, None), (5, ""), (6, "changed"), (7, " ".join(texts[0].split()[3:25])), (8, "é é é é é é é é é é é é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(queries, "table", lambda s, d, n: docs if n == "documents" else bench)
    monkeypatch.setattr(decontam.contamination, "__defaults__", (10, block))
    rows = docs_rows
    got = sorted(tuple(r) for r in queries.op10_decontaminate(spark, "").collect())
    want = contaminated(rows, items)
    assert sum(w[5] for w in want) > 5
    assert got == want
    kept = decontam.drop_contaminated(docs, bench, 10, block)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_decontamination_without_items(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, bench).where("size(spans) > 0").count() == 0
    assert decontam.drop_contaminated(docs, bench).count() == docs.count()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+%1 25(é", max_size=60))
def test_base_spans(t):
    assert pii.base_spans(t) == slow_spans(t)


def test_base_spans_of_long_runs():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+" * 200_000, "+1" * 100_000):
        pii.base_spans(t)
    assert pii.base_spans("x 4111 1111-1111 1111 y") == [(2, 2, 21)]


def test_terms(spark):
    rows = [(i, f"ask zorbel about it at ann@site.example.org or elsewhere please {i}") for i in range(6)]
    rows += [(100 + i, "please ask about it or elsewhere at home") for i in range(60)] + [(200, None), (201, ""), (None, "x@y.zz")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")
    found = {r.doc_id: r for r in pii.find(df, threshold=0.95).collect()}
    assert len(found) == len(rows)
    text = rows[0][1]
    assert [text[s.start : s.end] for s in found[0].terms] == ["zorbel"]
    assert [(s.kind, text[s.start : s.end]) for s in found[0].base] == [("email", "ann@site.example.org")]
    assert found[100].terms == [] and found[100].base == []
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "ask  about it at [EMAIL] or elsewhere please 0"
    assert clean[100] == rows[6][1] and clean[200] is None and clean[None] == "[EMAIL]"
    assert pii.redact(df.limit(0)).count() == 0


def test_query_of_pii(spark, docs, monkeypatch):
    rows = [(1, "b@c.de 10.0.0.1 +49 (30) 1234567 4111 1111 1111 1111"), (2, None), (2, None), (3, "é a@b.c +1 10.0.0.1 999999")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda s, d, n: df)
    got = sorted(tuple(r) for r in queries.op6_pii(spark, "").collect())
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), got):
        spans = slow_spans(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r == (i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), listed)


def test_rows_by_trigram_key():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 50, 5000))
    rows = langid.Rows(keys)
    assert (rows[keys] == np.arange(1, len(keys) + 1)).all()
    other = np.setdiff1d(r.integers(0, 1 << 50, 20_000), keys)
    assert not rows[other].any() and not langid.Rows(keys[:0])[other].any()


def test_letters_of_many_scripts_are_kept(spark):
    """Thousands of letters: every one of them and every language's script is learned."""
    han = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(i, "".join(han[(60 * i + k) % 3000] for k in range(60)), "zh") for i in range(60)] + [(100 + i, "the cat sat on a mat", "en") for i in range(400)]
    rows += [(900, "Ωμέγα και άλφα", "el")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["el", "en", "zh"] and len(model.alphabet) >= 3000
    docs = spark.createDataFrame([(1, han[5] + han[6]), (2, "the mat"), (3, "άλφα"), (4, f"the mat. {han[9] * 3}, cat")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["zh", "en", "el"]
    assert [s.lang for s in got[4].spans] == ["en", "zh", "en"]


def test_language_held_out(spark):
    got = queries.op7_language_id(spark, SF.replace("0.001", "0.01"))
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def slow_viterbi(scores, penalty):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        k = int(value.argmax())
        switch = value < value[k] - penalty
        back.append(np.where(switch, k, np.arange(len(value))))
        value = np.maximum(value, value[k] - penalty) + s
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi():
    r = np.random.default_rng(1)
    sizes = [0, 5, 1, 0, 30, 2]
    scores = r.normal(size=(sum(sizes), 3)) * 3
    begins = np.cumsum([0, *sizes])
    got = langid.viterbi(scores, begins, 4.0)
    for a, b in zip(begins[:-1], begins[1:]):
        if a < b:
            assert got[a:b].tolist() == slow_viterbi(scores[a:b], 4.0)


def test_language_edges(spark):
    en, ru = "the house and the garden with the other things", "дом и сад в этом городе и другие вещи"
    rows = [(i, en + f" {i}", "en") for i in range(8)] + [(20 + i, ru, "ru") for i in range(8)] + [(50, None, "en"), (51, "123 !?", "en"), (52, "", None), (None, en, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.identify(df.unionByName(spark.createDataFrame([(60, f"{en} {ru} {en}", None), (61, "日本", None)], df.schema)), model).collect()}
    assert got[0].lang_pred == "en" and got[20].lang_pred == "ru" and got[None].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == [] for i in (50, 51, 52))
    assert [s.lang for s in got[60].spans] == ["en", "ru", "en"]
    s = got[60].spans[1]
    assert f"{en} {ru} {en}"[s.start : s.end] == ru
    assert got[61].lang_pred in ("en", "ru")
    assert {r.doc_id for r in langid.keep_identified(df, model).collect()} == {r[0] for r in rows} - {50, 51, 52}
    assert [r.lang_pred for r in langid.identify(df.limit(2), langid.train(df.limit(0))).collect()] == ["und", "und"]


def check_packing(rows, tokens, capacity=1024):
    by_doc: dict = {}
    by_seq: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for a, n in sorted(places):
            assert a == at
            at += n
        assert at <= capacity
    for i, ids in tokens.items():
        pieces = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert sum(p.length for p in pieces) == len(ids) and all(p.length == capacity for p in pieces[1:])
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    assert not by_doc
    return len(by_seq)


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    df = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").limit(150)
    df = df.unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "x <|endoftext|> \u00a0 ½ don't  \n\n 12"), (10_003, "a" * 5000), (10_004, " " * 3000), (10_005, "word " * 1023)], df.schema)).cache()
    tokens = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    rows = packing.pack(df.repartition(2), queries.tokenizer_path()).collect()
    n = check_packing(rows, tokens)
    assert n <= 1.1 * sum(map(len, tokens.values())) / 1024 + 4
    check_packing(packing.pack(df.repartition(1), queries.tokenizer_path(), open_bins=2).collect(), tokens)
    assert packing.pack(df.limit(0), queries.tokenizer_path()).count() == 0


def test_fill_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    sequences = {n: packing.pack(docs.repartition(n), queries.tokenizer_path()) for n in (1, 64, 211)}
    found = {n: df.agg(F.count_distinct("sequence_id"), F.sum("length")).first() for n, df in sequences.items()}
    print({n: (r[0], -(-r[1] // 1024)) for n, r in found.items()})
    assert all(r[0] <= 1.02 * -(-r[1] // 1024) for r in found.values())


def test_open_bins():
    bins = packing.Bins(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.count == 0
    assert [bins.place(n) for n in (6, 7, 8)] == [(2, 0), (3, 0), (4, 0)]
    assert bins.place(4) == (2, 6)  # 3 was the fullest and closed


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(SF + "/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        stages.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found, unique, clean, redacted, packed = stages
    from test_nearcopies import kept

    rows = sorted((r.doc_id, r.text) for r in found.collect())
    keep = {i for _, i, _ in kept(rows)}
    assert {r.doc_id for r in unique.collect()} == keep
    dirty = {w[0] for w in contaminated([(i, t) for i, t in rows if i in keep], bench) if w[5]}
    assert dirty and {r.doc_id for r in clean.collect()} == keep - dirty
    assert redacted.count() == clean.count()
    assert all(not slow_spans(r.text) or "[" in r.text for r in redacted.collect())
    assert redacted.where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r.doc_id for r in packed.collect()} == keep - dirty
