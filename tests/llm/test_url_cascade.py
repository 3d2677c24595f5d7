"""URL verdicts against plain Python, and exact answers from the cascade."""

import re

from pyspark.sql import functions as F

from castloom.llm import url_cascade

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/1", "https://www.example.com/en/2?x=/", "http://example.com/EN/",
    "http://a.example.com/en/", "http://www.example.com/en", "http://notexample.com/en/", "http://com/", "http://com", "ftp://x.net/es/1#a",
    "http://x.net/fr/?q", "http://x.net/de/", "http://spam-farm.example.org/a", "http://www.ads.example.org", "http://ÄBC.org/ß",
    "http://a.org?x=http://b.com/", "http://a.org#://", "x://casino.org\n/en/", "http://casino.com/x", "://bets.net/es/",
]
SCHEMA = "page_id bigint, url string, html string, host string, path string, rule string, listed string, key string"


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i if i % 7 else None, u, "h", "h", "p", "r", "l", "k") for i, u in enumerate(urls)], SCHEMA)


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best, said = None, None
    for verdict, rule in url_cascade.RULES:
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == name or host.endswith("." + name)) and path.startswith(start) and len(rule) > len(best or ""):
            best, said = rule, verdict
    listed = set(re.split("[.-]", host)) & set(url_cascade.LISTED_WORDS)
    return host, path, best, said or ("block" if listed else "allow")


def test_cases(spark):
    found = [tuple(r)[1:] for r in url_cascade.judge(pages(spark, URLS * 2)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, (judged(u) for u in URLS * 2)))


def keys(spark, n, every):
    return spark.range(n).select(F.concat(F.lit("host-"), "id").alias("key"), (F.col("id") % every == 0).alias("listed"))


def test_cascade_is_exact_for_its_universe(spark, monkeypatch):
    for bits, every in ((12, 10), (2, 10), (2, 2), (12, 1)):
        monkeypatch.setattr(url_cascade, "BITS_PER_KEY", bits)
        universe = keys(spark, 3000, every)
        levels = url_cascade.cascade(universe)
        assert every == 1 or bits > 2 or len(levels) > 2
        assert url_cascade.exact_keys(spark, levels, universe).count() == 0


def test_nothing_listed_and_empty(spark):
    assert url_cascade.cascade(keys(spark, 5, 10).where("not listed")) == []
    assert url_cascade.judge(pages(spark, [])).collect() == []
    assert [r["verdict"] for r in url_cascade.judge(pages(spark, ["http://x.org/"])).collect()] == ["allow"]


def test_no_python_and_no_join(spark):
    plan = url_cascade.judge(pages(spark).select("page_id", "url"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)
