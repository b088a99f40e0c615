from pyspark.sql import types as T

from lobloom.llm import urlfilter as uf
from lobloom.llm.queries import URL_RULES

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("prefix", T.StringType())])


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def urls():
    hosts = ["example.com", "a.example.com", "com", "EXAMPLE.COM", "notexample.com", "example.net", "x.example.net", "org", "w.org", "example.com:80", "u@example.com", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/76?x#y", "/EN/7", "/de/", "/de/8/a", "/de/9#/de/8", "/es/1", "?/en/", "#/en/7", "/es/\n2", "/en/é"]
    return [f"{s}{h}{p}" for s in ("http://", "https://") for h in hosts for p in paths] + [None, "", "no scheme/en/", "a://b://example.com/en/", "://com/en/7", "http://\nx.com/en/"]


def test_against_plain(spark):
    rows = [(i, u, "r", "p") for i, u in enumerate(urls())] * 2
    df = spark.createDataFrame(rows, PAGES)
    rules = [*URL_RULES, ("block", "x.example.net", ""), ("allow", "x.example.net", "/de/8/"), ("allow", "w.org", "/es/1"), ("block", "w.org", "/es/1")]
    got = uf.judge(df, uf.rules_table(spark, rules))
    assert got.columns == [*PAGES.names, "url_filter"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r.url_filter) == plain(r.url, rules), r.url


def test_empty_tables(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    df = spark.createDataFrame([(1, "http://a.com/en/", None, None)], PAGES)
    assert uf.judge(df, none, default="block").first().url_filter.verdict == "block"
    assert uf.judge(spark.createDataFrame([], PAGES), uf.rules_table(spark, URL_RULES)).count() == 0
