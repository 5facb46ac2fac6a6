import time

from drayage.llm import queries, urls


def plain(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    "http://a.example.org/en/14?x=1", "https://EXAMPLE.org/es/1#t", "https://xexample.org/es/1", "http://a.b.com/fr/", "http://com/de/x", "http://a.com",
    "http://a.com/de", "no scheme", "", None, "://org/x", "http://org?y", "http://a.org/x\ny/z", "http://É.example.org/en/1", "http://a.net/fr/", "ftp://u@example.org:80/en/1",
    "http://a://b.org/c", "http://.org/", "http://example.org./en/1",
]


def test_verdicts_match_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS + URLS[:5])] + [(None, "http://a.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    for rules in (queries.RULES, queries.RULES + [("block", "a.org", "/"), ("allow", "org", "/x"), ("block", "org", "/x")]):
        got = urls.judge(pages, urls.rules_frame(spark, rules)).collect()
        found = sorted(((r.id is None, r.id or 0), r.host, r.path, r.rule or "", r.verdict) for r in got)
        assert found == sorted((((i is None, i or 0), *(x or "" for x in plain(u, rules))) for i, u, _ in rows), key=lambda r: r)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = urls.rules_frame(spark, [])
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [(1, "a.org", "/x", None, "allow")]
    assert urls.judge(pages.limit(0), urls.rules_frame(spark, queries.RULES)).isEmpty()


def test_hosts_of_very_many_labels(spark):
    hosts = ["a." * 100_000 + "example.org", "a." * 100_000 + "org", "." * 100_000]
    rows = [(i, f"http://{h}/es/1") for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    start = time.time()
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.rules_frame(spark, queries.RULES)).collect()}
    assert time.time() - start < 5
    assert got == {i: plain(u, queries.RULES) for i, u in rows}
