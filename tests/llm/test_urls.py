from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import urls


def plain(url, rules=urls.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


EDGES = [None, "", "no scheme.com/en/", "http://com/en/", "http://a.COM/en/x?y", "http://acom/en/", "http://www.example.com/en/7", "http://www.example.com/en/8", "http://x.example.com/en/77/#f", "ftp://q.net/de/", "http://q.net/de", "http://a.example.net/de/81", "http://example.net/de/7", "http://b.org/es/?q", "http://b.org?/es/", "http://b.org#/es/", "http://", "://com/en/", "http://u://com/en/", "http://É.Com/en/", "http://..com/en/", "http://com./en/", "http://a.com//en/", "x" * 5000 + "://a.com/en/" + "y" * 50_000, "http://a.com/en/\nz"]


def test_edges_and_repeats(spark):
    rows = [(i, u, "own", 1) for i, u in enumerate([*EDGES, *EDGES])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, __size int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages).collect()}
    assert got == {i: plain(u) for i, u, *_ in rows}
    assert urls.judged(pages.limit(0)).collect() == []
    none = urls.judged(pages, spark.createDataFrame([("block", None, "/")], "verdict string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b.a", "c.b.a"]), st.sampled_from(["", "/", "/x", "/xy", "/xy/z"])), min_size=1, max_size=8), st.data())
def test_any_rules_equal_brute_force(spark, pairs, data):
    rules = [(data.draw(st.sampled_from(["block", "allow"])), h, p) for h, p in dict.fromkeys(pairs)]
    every = [f"http://{h}{p}{t}" for h in ("a", "b.a", "d.c.b.a", "xa") for p in ("", "/", "/x", "/xy/zz") for t in ("", "?q")]
    pages = spark.createDataFrame(list(enumerate(every)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(every)}


def test_of_equal_rules_block_wins(spark):
    rules = spark.createDataFrame([("allow", "a", "/"), ("block", "a", "/")], "verdict string, host string, path string")
    assert urls.judged(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), rules).first().verdict == "block"


def test_default_rules_start_no_python_worker(spark):
    pages = spark.createDataFrame([(None if i % 2 else i, None if i % 3 else f"http://a.com/en/{i}") for i in range(300)], "page_id long, url string")
    plan = urls.judged(spark.range(3).selectExpr("id AS page_id", "'http://a.com/en/' AS url"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan
    assert urls.judged(pages).groupBy("verdict").count().collect() and urls.judged(pages).count() == 300
    assert sorted(map(tuple, urls.default_rules(spark).select("verdict", "host", "path").collect())) == sorted(urls.RULES)
