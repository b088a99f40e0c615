"""URL rules by expanded expressions and short hash prefixes.

Every URL is expanded into the expressions that could be a rule for it: each
suffix of its host that has as many labels as some rule's host, with each prefix of
its path that is as long as some rule's path. Expressions and rules meet in an equi-join on the first four
bytes of their SHA-256 digest; the full digest confirms; among the rules that
remain the longest wins (then the longer host, then block). Only DataFrame
functions are used.

Distinct URLs are judged once, so a URL that fills a third of the table is one
row; the verdict joins back on the URL, which Spark can split.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
takes the default verdict; an empty rule table gives the default everywhere;
repeated rows and further columns stay as they are; the struct of results gets
underscores after its name where the pages have such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import fresh, result_name

PREFIX_HEX = 8  # four bytes of the digest
A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules from (verdict, host, path), verdict ``allow`` or ``block``."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *A_TO_Z)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash and a rule's path begins with one or is empty.
    return F.sha2(F.concat(host, path), 256)


def expressions(host: Column, path: Column, lengths: Column, labels: Column) -> Column:
    """Array of (host, path): host suffixes of the given numbers of labels with path prefixes of the given lengths."""
    own = F.split(host, r"\.")
    suffixes = F.transform(
        F.filter(labels, lambda n: n <= F.size(own)),
        lambda n: F.array_join(F.slice(own, F.size(own) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(
        prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with struct ``url_filter`` (host, path, rule, verdict)."""
    known = rules.select(
        F.translate("host", *A_TO_Z).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null")
    # How long rules' paths are, and how many labels their hosts have: sets of small numbers, not of rules.
    sizes = known.agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
                      F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels")).first()
    table = known.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"), "verdict",
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"))
    table = table.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))

    urls = pages.select(F.col(url).alias("__url")).where(F.col("__url").contains("://")).distinct()
    urls = urls.select("__url", host_of(F.col("__url")).alias("h"), path_of(F.col("__url")).alias("p"))
    lengths, labels = (F.array(*[F.lit(n) for n in sizes[c]]).cast("array<int>") for c in ("lengths", "labels"))
    tried = urls.select("__url", F.explode(expressions(F.col("h"), F.col("p"), lengths, labels)).alias("e"))
    tried = tried.select("__url", _digest(F.col("e.host"), F.col("e.path")).alias("digest"))
    met = tried.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)).join(table, "prefix")
    confirmed = met.where("digest = rule_digest")
    best = confirmed.groupBy("__url").agg(F.max(F.struct(
        F.length("rule").alias("n"), "host_length", (F.col("verdict") == "block").alias("block"), "rule", "verdict")).alias("__best"))
    of, found = fresh(pages, "of"), fresh(pages, "best")
    best = best.withColumnsRenamed({"__url": of, "__best": found})
    # URLs that no rule can fit, null ones among them, take no part in the join.
    fits = F.coalesce(pages[url].contains("://"), F.lit(False))
    some = pages.where(fits).join(best, F.col(url) == F.col(of), "left").drop(of)
    out = some.unionByName(pages.where(~fits).withColumn(found, F.lit(None).cast(best.schema[found].dataType)))
    return out.withColumn(result_name(pages, "url_filter"), F.struct(
        host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(f"{found}.rule").alias("rule"),
        F.coalesce(f"{found}.verdict", F.lit(default)).alias("verdict"))).drop(found)
