"""URL filter against a brute-force judge."""

import re

from adflow.llm import urlfilter


def brute(url, rules, default="allow"):
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]) if url and "://" in url else None
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else default)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("a.org", "", "block"),
         ("a.org", "/fr", "allow"), ("b.org", "/x", "allow"), ("b.org", "/x", "block"), ("c.d.e.org", "/q/r/s", "block")]
URLS = [None, "", "no scheme", "http://", "://net/", "HTTP://X.Example.NET/en/1?q#f", "http://net", "http://net/",
        "http://notnet/", "http://example.net/EN/", "http://example.net/en/", "ftp://www.a.org?x=/fr/", "http://a.org/fr",
        "http://a.org/fra", "http://b.org/x", "http://z.b.org/xyz", "http://c.d.e.org/q/r/s/t", "http://d.e.org/q/r/s",
        "http://a.net#://b.org/x", "http://..net//", "http://h/\n/x", "x://y://net/", "http://a.net:80/", "http://" + "a." * 5000 + "net/"]


def test_against_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://net/", None), (1, "http://net/", "r")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urlfilter.judge(pages, rules).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *brute(u, RULES))) for i, u, _ in rows)


def test_shuffled_rules_and_short_clashes(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 0)
    monkeypatch.setattr(urlfilter, "SHORT", 1)  # many expressions share a prefix; digests decide
    test_against_brute_force(spark)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urlfilter.judge(pages, rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in urlfilter.judge(one, rules).collect()] == [(1, "a.net", "/", None, "allow")]
