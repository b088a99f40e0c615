"""Input columns that carry the names of results and helpers."""

import pytest
from helpers import docs, prose

from lobloom.llm import decontaminate, licenses, linededup, simhash_similar, toxicity, urlfilter

NAMES = ["decontamination", "Toxicity", "licenses", "line_dedup", "url_filter", "__gone", "__GONE_", "__doc", "__removed", "__candidates", "__row",
         "row", "__of", "__best", "__url", "found", "key", "print", "component", "rep", "clean_text", "n", "hash"]


def texts():
    return [prose(i % 12, 40) + "\nrepeated line of text here\n" + ("idiot " * 3 if i % 4 == 0 else "") for i in range(60)]


@pytest.fixture(scope="module")
def rows(spark):
    return docs(spark, texts()).selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(NAMES)])


def same_extras(out, rows, drop=()):
    kept = [c for c in rows.columns if c not in drop]
    assert out.columns[: len(rows.columns)] == rows.columns
    for r in out.select(*[f"`{c}`" for c in kept]).limit(3).collect():
        assert list(r)[len(kept) - len(NAMES):] == list(range(len(NAMES)))


@pytest.mark.parametrize("held", [10_000, 0])
def test_decontamination(spark, rows, held):
    items = spark.createDataFrame([(1, prose(3, 40))], "item_id long, text string")
    out = decontaminate.scan(rows, items, broadcast_windows=held)
    assert out.columns[-1] == "decontamination_"
    same_extras(out, rows)
    assert out.where("decontamination_.n_hit > 0").count() == 5
    kept = decontaminate.decontaminate(rows, items)
    assert kept.columns == rows.columns and kept.count() == 55
    assert decontaminate.decontaminate(rows, items, remove="spans").columns == rows.columns


def test_toxicity(spark, rows):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int").selectExpr("doc_id", "1 AS quality", "toxic")
    kept = toxicity.without_toxic(rows, labels)
    same_extras(kept, rows)
    assert kept.columns == rows.columns


def test_licenses_and_lines(spark, rows):
    out = licenses.scan(rows)
    same_extras(out, rows)
    assert out.columns[-1] == "licenses_"
    cut = linededup.dedup_lines(rows)
    same_extras(cut, rows)
    assert cut.columns[-1] == "line_dedup_" and cut.where("line_dedup_.n_removed > 0").count() > 40


def test_near_duplicates(spark, rows):
    kept = simhash_similar.keep_one(rows)
    same_extras(kept, rows)
    assert kept.columns == rows.columns and kept.count() < 60


def test_urls(spark, rows):
    pages = rows.selectExpr("*", "CASE WHEN doc_id < 50 THEN concat('http://a.b.example.com/en/', doc_id) END AS url")
    out = urlfilter.judge(pages, urlfilter.rules_table(spark, [("block", "example.com", "/en/1")]))
    assert out.columns == [*pages.columns, "url_filter_"] and out.count() == 60
    assert out.where("url_filter_.verdict = 'block'").count() == 11
    assert {tuple(r) for r in out.select("url_filter", "`__best`").distinct().collect()} == {(4, 13)}


def test_hosts_of_very_many_labels(spark):
    hosts = ["a." * 60_000 + "com", "." * 50_000, "x" * 100_000 + ".org"]
    pages = spark.createDataFrame([(i, f"http://{h}/es/1") for i, h in enumerate(hosts)], "page_id long, url string")
    out = urlfilter.judge(pages, urlfilter.rules_table(spark, [("block", "com", "/es/"), ("allow", "org", "/es/")]))
    assert {r.page_id: r.url_filter.rule for r in out.collect()} == {0: "com/es/", 1: None, 2: "org/es/"}
