"""The registered queries of this subpackage, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, embeddings, licenses, linededup, packing, personal, sharding, simhash, suffixdedup, toxicity, turntrie, urlfilter
from .ship import ensure_importable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ensure_importable(spark)
            return fn(spark, sf)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


_OP3 = r"""
WITH dw AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)),
iw AS (
  SELECT item_id, ws, len(ws) AS n, least(len(ws), 10) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[s : s + k - 1], ' ') AS words
  FROM iw, LATERAL (SELECT unnest(range(1, n - k + 2)) AS s)),
runs AS (
  SELECT doc_id, pos, kk.k,
    CASE WHEN max(pos) OVER (PARTITION BY doc_id, kk.k) - pos + 1 >= kk.k
      THEN string_agg(w, ' ') OVER (PARTITION BY doc_id, kk.k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) END AS words10
  FROM dw, (SELECT DISTINCT k FROM win) kk),
cut AS (
  SELECT doc_id, pos, k, CASE WHEN k = 10 THEN words10 ELSE array_to_string(string_split(words10, ' ')[1:k], ' ') END AS words
  FROM runs WHERE words10 IS NOT NULL),
hits AS (SELECT c.doc_id, c.pos, c.k, win.item_id FROM cut c JOIN win ON win.k = c.k AND win.words = c.words),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(pos, pos + k)) AS p) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id),
nw AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(nw.n, 0)::BIGINT AS n_words, coalesce(hw.n_hit, 0)::BIGINT AS n_hit,
       coalesce(hi.n_items, 0)::BIGINT AS n_items, sha256(coalesce(hi.ids, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN nw ON nw.doc_id = d.doc_id LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""


@query("op3_decontaminate", _OP3)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document inside windows of benchmark items."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    d = decontaminate.scan(docs, read(spark, sf, "benchmark"))
    items = F.array_sort(F.transform("decontamination.items", lambda i: i.cast("string")))
    return d.select(
        "doc_id", "decontamination.n_words", "decontamination.n_hit",
        F.size("decontamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("decontamination.n_hit") > 0).alias("contaminated"))


@query("op7_licenses")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Licence phrases, identifier tags and expressions of each document."""
    d = licenses.scan(read(spark, sf, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", "licenses.n_words", "licenses.n_base", "licenses.first_word", "licenses.last_word",
        F.array_join("licenses.base_labels", ",").alias("base_labels"),
        F.array_join("licenses.labels", ",").alias("labels"), "licenses.score")


# The rules of the query's contract.
URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

_OP8 = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
  ('block','example.net','/de/8'), ('block','org','/es/')),
best AS (
  SELECT page_id, host, path, max(length(rhost || rpath)) AS n FROM p JOIN r
  ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT DISTINCT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM p LEFT JOIN best b ON b.page_id = p.page_id AND b.host = p.host AND b.path = p.path
LEFT JOIN r ON (p.host = rhost OR suffix(p.host, '.' || rhost)) AND starts_with(p.path, rpath) AND length(rhost || rpath) = b.n
"""


@query("op8_url_filter", _OP8)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """The rule and verdict of each page's URL."""
    pages = read(spark, sf, "pages").select("page_id", "url")
    d = urlfilter.judge(pages, urlfilter.rules_table(spark, URL_RULES))
    return d.select("page_id", "url_filter.*")


@query("op6_simhash")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of 3-word shingles; components over at most 2 differing bits."""
    docs = read(spark, sf, "documents")
    d = simhash.near_duplicates(docs, k=2, words=3, seed=42)
    return d.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_sharding")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen shards of near-equal bytes; equal texts stay together."""
    d = sharding.shard(read(spark, sf, "documents"), shards=16)
    return d.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op1_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 2048 tokens as the search finds."""
    return packing.pack_documents(
        read(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Expected severity of every document, trained on a bounded sample of labels."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf, "labels"))
    return toxicity.score(docs, model).select("doc_id", "toxicity.*")


@query("op5_line_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after fuzzy line de-duplication: what stays, and how much was cut."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "text", "line_dedup.*")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of each document without 50-byte strings of earlier documents."""
    d = suffixdedup.dedup_substrings(read(spark, sf, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND n > 0 AND isfinite(n)),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON pairs.x = reach.y),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS k FROM pairs GROUP BY x)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN least ON least.x = vec_id
"""


@query("op10_embedding_dedup", _OP10)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9 or more."""
    return embeddings.near_duplicates(read(spark, sf, "embeddings"))


_OP11 = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384::BIGINT)) AS crc
  FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, base, xor(crc, 4294967295::BIGINT) % 4 AS h FROM c),
parts AS (
  SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.pos < h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos >= h.h),
seq AS (
  SELECT h.conv_id, coalesce(s, []) AS s FROM h LEFT JOIN (
    SELECT conv_id, list({'r': role, 't': text} ORDER BY part, pos) AS s FROM parts GROUP BY conv_id) p ON p.conv_id = h.conv_id),
pre AS (SELECT conv_id, d, s[1:d] AS s, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (
  SELECT min(conv_id) AS conv_id, d, s, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids
  FROM pre GROUP BY d, s),
up AS (
  SELECT a.*, b.conv_id AS parent, CASE WHEN a.d = 0 THEN 0 ELSE (a.n - 1) * len(regexp_extract_all(a.s[a.d].t, '[^\x20\x09-\x0D]+')) END AS own
  FROM node a LEFT JOIN node b ON b.d = a.d - 1 AND a.s[1:a.d - 1] = b.s),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS k FROM up WHERE d > 0 GROUP BY ALL),
u AS (SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids ON kids.conv_id = up.conv_id AND kids.d = up.d),
below AS (
  SELECT a.s, sum(CASE WHEN b.k = 0 THEN 1 ELSE 0 END) AS leaves, sum(b.own) AS saved FROM u a JOIN (
    SELECT k, own, unnest(list_transform(range(0, d + 1), lambda i: s[1:i])) AS top FROM u) b ON b.top = a.s GROUP BY a.s)
SELECT u.conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs, k::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN below ON below.s = u.s
"""


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from the conversation whose id is the next multiple of 20 below."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).cast("int")
    own = seqs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    heads = seqs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    return own.join(heads, "base", "left").select("conv_id", F.expr(
        "concat(coalesce(slice(head, 1, h), array()), slice(turns, h + 1, greatest(size(turns), 1)))").alias("turns"))


@query("op11_turn_trie", _OP11)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return turntrie.prefix_trie(rebuilt(turntrie.sequences(turns)))


_OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS ph FROM (
    SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(size))),
f AS (SELECT lang, size, ph, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, ph, f FROM f WHERE f >= 30),
c AS (SELECT lang, size, ph, string_split(ph, ' ') AS ws, f AS a FROM f WHERE size > 1 AND f >= 30),
parts AS (
  SELECT lang, ph, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
cut AS (
  SELECT p.lang, p.ph, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM parts p JOIN often x ON x.lang = p.lang AND x.ph = lp JOIN often y ON y.lang = p.lang AND y.ph = rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS ph, max(a) AS longer FROM (
    SELECT lang, ws, a, s, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM c)) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.ph = best.ph
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, ph) AS rank, ph AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""


@query("op13_collocations", _OP13)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.collocations(read(spark, sf, "documents").select("lang", "text"))


@query("op12_personal_data")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of each document: base spans, and those that their contexts reveal."""
    d = personal.scan(read(spark, sf, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) AS bigint) AS n_{k}") for i, k in enumerate(personal.KINDS)]
    return d.select("doc_id", *counts, F.sha2(personal.listed("base"), 256).alias("base_sha256"), personal.listed("spans").alias("spans"))
