"""WARC, top-k and URL filters."""

import base64
import hashlib
import struct

import numpy as np
import pytest
import zstandard
from oracle_check import compare, duck
from pyspark.sql import functions as F

from quirework.llm import queries, topk, urlfilter, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_twins(spark, name, sf):
    assert compare(spark, duck(sf), sf, name, queries.QUERIES[name], queries.SQL[name]) == ""


PAGES = [(1, "http://a.b/c", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://x y\r\n", None), (4, "u", ""), (9, "u", "long " * 5000), (5, "u", "long " * 5000), (9, "u", "long " * 5000), (None, "u", "solo"), (None, "u", "<p>é</p>")]


def expected(rows):
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        keep = max((r[0] for r in rows if (r[2] or "").encode() == h and r[0] is not None), default=None)
        again = i != keep
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string")
    monkeypatch.setattr(queries, "table", lambda s, d, n: pages)
    got = queries.op1_warc(spark, "").collect()
    assert all(r.error is None for r in got)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(PAGES)
    urls = {r.page_id: r.url for r in got}
    assert urls[2] is None and urls[3] == "http://x%20y%0D%0A"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_of_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF + "/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op1_warc(spark, SF).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)


def records(n=40):
    texts = [f"<html><body>page {i} of the same site, with the same words around it</body></html>".encode() * 3 for i in range(n)]
    return texts, [warc.record_bytes(i, f"http://h/{i}", t, warc.base32_sha1(t)) for i, t in enumerate(texts)]


def test_warc_files(spark, tmp_path):
    texts, recs = records()
    made = warc.archive(recs, dict_bytes=2048)
    assert made[:4] == struct.pack("<I", warc.DICT_MAGIC)
    (tmp_path / "a.warc.zst").write_bytes(made)
    size = struct.unpack("<I", made[4:8])[0]
    packed = zstandard.ZstdCompressor().compress(made[8 : 8 + size])  # the dictionary may be compressed itself
    (tmp_path / "b.warc.zst").write_bytes(struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + made[8 + size :])
    plain = zstandard.ZstdCompressor()
    (tmp_path / "c.warc.zst").write_bytes(b"".join(plain.compress(r) for r in recs))
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert len(got) == 3 * len(texts) and all(r.error is None and bytes(r.payload) == texts[r.page_id] for r in got)


def test_warc_errors():
    _, recs = records(6)
    c = zstandard.ZstdCompressor(write_checksum=True)
    frames = [c.compress(r) for r in recs]
    bad = [
        c.compress(recs[0].replace(b"WARC/1.1", b"JUNK/1.1")),
        c.compress(recs[0].replace(b"page 0", b"page X", 1)),
        c.compress(recs[0][:-2]),
        c.compress(recs[0].replace(b"WARC-Date", b"X-Date")),
        frames[0][:-1] + bytes([frames[0][-1] ^ 1]),
    ]
    for b in bad:
        got = list(warc.read_archive(frames[1] + b + frames[2]))
        assert [r["page_id"] for r in got] == [1, None, 2] and got[1]["error"]
    got = list(warc.read_archive(frames[1] + frames[2][:-9]))
    assert [bool(r["error"]) for r in got] == [False, True]
    got = list(warc.read_archive(frames[1] + b"garbage"))
    assert [bool(r["error"]) for r in got] == [False, True]
    assert list(warc.read_archive(b"")) == []


def brute_top(rows, k=20):
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in ok if i % 20 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("rows", [4096, 16])
def test_top_k(spark, rows):
    r = np.random.default_rng(5)
    data = [(i, [float(x) for x in r.normal(size=24)]) for i in range(130)]
    data += [(i, data[3][1]) for i in range(130, 165)]  # ties
    data += [(170, None), (171, [1.0, None]), (180, [float("nan")]), (181, [float("inf")]), (None, [1.0]), (200, [2.0]), (201, []), (220, [1e9] * 24), (221, [1e12] * 30), (240, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, rank int")
    data = [tuple(x) for x in df.select("vec_id", "embedding").collect()]
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, rows=rows, query_rows=4)
    assert sorted(tuple(x) for x in got.collect()) == [(q, n, i, min(s, (1 << 63) - 1)) for q, n, i, s in brute_top(data)]
    few = df.where("vec_id < 5")
    assert topk.top_k(few, F.col("vec_id") % 20 == 0).count() == 4
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?q#f"), (4, "http://net"), (5, "http://net/x"), (6, "https://xnet/"), (7, "ftp://EXAMPLE.com/de/a#/b"), (8, "x://y?ref=x"), (9, "x://example.org/fr/?utm_source=feed"), (9, "x://example.org/fr/?utm_source=feed"), (10, "http://shop.de/cart"), (None, "http://É.Net/ü?x"), (11, ""), (12, "a://b://c/d"), (13, "http://example.net:80/en/")]
    pages = spark.createDataFrame([(i, u, "mine", "r") for i, u in rows], "page_id long, url string, extra string, rule string")
    got = sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, queries.HOST_RULES, queries.PATTERN_RULES).collect()], key=str)
    want = [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "net", "", None, "allow"), (5, "net", "/x", "net/", "block"),
        (6, "xnet", "/", None, "allow"), (7, "example.com", "/de/a", "example.com/de/", "block"), (8, "y", "", None, "block"), (9, "example.org", "/fr/", "org/fr/", "allow"), (9, "example.org", "/fr/", "org/fr/", "allow"),
        (10, "shop.de", "/cart", None, "block"), (None, "É.net", "/ü", "net/", "block"), (11, "", "", None, "allow"), (12, "b:", "//c/d", None, "allow"), (13, "example.net:80", "/en/", None, "allow"),
    ]
    assert got == sorted(want, key=str)
    assert urlfilter.filter_urls(pages.limit(0), queries.HOST_RULES).count() == 0


def test_rarest_token(spark):
    urls = spark.createDataFrame([("http://h/aa/bb",), ("http://h/aa",), ("http://h/aa/cc",)], "url string")
    rules = [urlfilter.PatternRule("block", "/aa/bb", ("aa", "bb")), urlfilter.PatternRule("block", "/aa/cc", ("cc", "aa"))]
    assert sorted(r.token for r in urlfilter.rule_index(urls, rules).collect()) == ["bb", "cc"]
