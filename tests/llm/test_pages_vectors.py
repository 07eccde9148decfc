"""URL filters and neighbour search against brute force."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest

from loomlog.llm import neighbours, urls
from tests.conftest import SF

URLS = [
    "http://Example.ORG/es/x", "https://a.b.example.org/en/12?q#f", "http://example.org", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://spam-farm.net/x", "HTTP://Blog.Spam-Farm.io/", "http://x.net/a?sessionid=3", "http://x.net/asessionid=3",
    "http://10.0.0.1/x", "http://x.net/f.EXE", "no scheme", "", None, "://", "http://?x", "http://com/fr/", "http://x.net/tag/a/page/2", "http://x.net/casino/", "http://x.net/casinos/", "http://x.net/casino/", "http://ünï.com/de/é", "http://x.net/" + "a/b-c." * 40_000 + "?sessionid=1", "http://x.net/" + "cart checkout " * 9_000,
]


def duck(pages, sql):
    own = duckdb.connect()
    own.register("pages", pages.toPandas())
    return sorted((tuple("" if x is None or x != x else str(x) for x in r) for r in own.execute(sql).fetchall()))


def plain(df):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in df.collect())


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "extra", "extra") for k, u in enumerate(URLS)], "page_id bigint, url string, host string, verdict string")
    found = urls.judge(pages)
    assert plain(found) == duck(pages.select("page_id", "url"), urls.oracle())
    own = {r["page_id"]: r for r in found.collect()}
    assert [own[k]["verdict"] for k in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11)] == ["block", "block", "allow", "allow", "block", "block", "block", "block", "allow", "block", "block"]
    assert (own[0]["host"], own[0]["path"], own[0]["rule"]) == ("example.org", "/es/x", "example.org/es/")
    assert (own[12]["host"], own[12]["path"], own[14]["host"], own[14]["verdict"]) == ("", "", "", "allow")
    assert [own[k]["verdict"] for k in (18, 19, 20, 21)] == ["block", "block", "allow", "block"]
    assert urls.judge(pages.limit(0)).count() == 0


def test_patterns_without_index_agree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    patterns = (*urls.PATTERNS, "/en/[0-9]+$", "utm_source=", r"[?&]page=2")
    assert plain(urls.judge(pages, patterns=patterns)) == duck(pages.select("page_id", "url"), urls.oracle(patterns=patterns))


def test_patterns_are_indexed_by_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://x/wp-a",), ("http://x/wp-login.html",), ("http://x/login.php",), ("http://y.php",), (None,)], "url string")
    assert urls.rarest(pages, (r"/wp-login\.php", r"casino", r"/login/wp/")) == {"login": [0, 2]}
    plan = urls.judge(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_tokens_of():
    assert urls.tokens_of(r"[/.-]casino[/.-]") == ["casino"] and urls.tokens_of(r"casino") == []
    assert urls.tokens_of(r"/wp-login\.php$") == ["wp", "login", "php"] and urls.tokens_of(r"/a?b/") == []
    assert urls.tokens_of(r"//([^/]*\.)?spam-farm\.") == ["farm"]
    assert urls.tokens_of(r"/a|/b/") == [] and urls.tokens_of(r"[?&]x1=\d+[/]y\.$") == ["x1", "y"] and urls.tokens_of(r"/ab{2}/c/") == ["c"]


def brute(vectors, every, k):
    own = {i: np.array(v, np.float64) for i, v in vectors}
    out = {}
    for q in sorted(i for i in own if i % every == 0):
        scores = sorted(((-float((own[i] * own[q]).sum()), i) for i in own if i != q))[:k]
        out[q] = scores
    return out


def made(n, size, seed, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size)).astype(np.float32)
    if not scale:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(k, x[k].tolist()) for k in range(n)]


@pytest.mark.parametrize(("scale", "cell_rows", "query_rows", "upper"), [(False, 1 << 14, 1 << 14, 12), (True, 300, 40, 12), (False, 200, 5, 2)])
def test_recall(spark, monkeypatch, scale, cell_rows, query_rows, upper):
    monkeypatch.setattr(neighbours, "UPPER", upper)
    vectors = made(1500, 24, 3, scale)
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id bigint, embedding array<float>, rank int")
    found = neighbours.nearest(df, 20, cell_rows=cell_rows, query_rows=query_rows).collect()
    want = brute(vectors, 20, 20)
    by = {q: sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"]) for q in want}
    hits = 0
    for q, own in by.items():
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        exact = {i: -s for s, i in want[q]}
        hits += sum(r["vec_id"] in exact and abs(exact[r["vec_id"]] - r["score"]) < 1e-12 for r in own)
    assert hits >= 0.95 * 20 * len(want)


@pytest.mark.parametrize(("size", "cell_rows"), [(32, 1 << 14), (32, 500), (300, 1 << 14)])
def test_recall_beside_a_long_vector(spark, size, cell_rows):
    vectors = made(2500, size, 5)
    vectors[7] = (7, [100 * x for x in vectors[7][1]])
    found = neighbours.nearest(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"), 50, cell_rows=cell_rows).collect()
    want = brute(vectors, 50, 20)
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in found)
    assert hits >= 0.9 * 20 * len(want)


def test_equal_vectors_and_odd_rows(spark):
    one = made(1, 8, 1)[0][1]
    rows = [(k, one) for k in range(300)] + [(1000 + k, v) for k, v in made(50, 8, 2)] + [(40, one)]
    rows += [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] * 8), (5060, [1.0] * 7 + [None]), (5080, [1.0] * 9), (5100, [float("inf")] + [1.0] * 7), (None, one)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = neighbours.nearest(df, 20).collect()
    assert not {r["query_id"] for r in found} & {5000, 5020, 5040, 5060, 5080, 5100, None} and not {r["vec_id"] for r in found} & {5020, 5080}
    for q in range(0, 300, 20):
        own = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        assert own == [k for k in range(22) if k != q][:20]
    assert neighbours.nearest(df.limit(0), 20).count() == 0


def test_ids_with_several_vectors(spark):
    vectors = [(k, v) for k, v in made(60, 8, 6)] + [(20, v) for _, v in made(30, 8, 7)] + [(40, v) for _, v in made(25, 8, 8)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    for of in ({}, {"cell_rows": 64, "query_rows": 9}):
        found = neighbours.nearest(df, 20, **of).collect()
        for q, times in ((0, 1), (20, 31), (40, 26)):
            own = [r for r in found if r["query_id"] == q]
            assert len(own) == 20 * times and (q == 0 or q not in {r["vec_id"] for r in own})
    exact = {q: Counter() for q in (0, 20, 40)}
    for q, v in vectors:
        if q % 20 == 0:
            scores = sorted((-float((np.array(v, np.float64) * np.array(w, np.float64)).sum()), i) for i, w in vectors if i != q)[:20]
            exact[q].update(i for _, i in scores)
    near = neighbours.nearest(df, 20).collect()
    for q, want in exact.items():
        assert sum((Counter(r["vec_id"] for r in near if r["query_id"] == q) & want).values()) >= 0.97 * sum(want.values())


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame(made(5, 8, 4), "vec_id bigint, embedding array<float>")
    found = neighbours.nearest(df, 2).collect()
    assert len(found) == 3 * 4 and max(r["rank"] for r in found) == 4


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 2) - 5.991465) < 1e-5 and abs(neighbours.chi_square_quantile(0.9, 10) - 15.98718) < 1e-4
