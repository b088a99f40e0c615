"""Brute-force versions and small odd tables for the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

VOCAB = "the of and to in is that for it as with was on be at by this have from or Straße naïve über 数据 x1 y2".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        out.append(r.choice(VOCAB) + str(r.randrange(40)) * (r.random() < 0.7))
        out.append(r.choice([" ", " ", " ", ", ", ". ", "\n"]))
    return "".join(out)


def odd_texts() -> list[str | None]:
    long = prose(1, 6000)
    base = prose(2, 120)
    return [
        None, "", " ", "\n\n", "a", base, base, base, base.replace("the", "teh", 1), base + " tail", long, long + " more",
        prose(3, 40), prose(4, 9), "Released under the MIT License.", "word " * 3000, "Ångström İstanbul ΣΣ !.,, <|endoftext|> it's",
        "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\nApache License", "x" * 5000]


def docs(spark, texts=None, extra: bool = False):
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, None if i % 3 == 0 else "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        df = df.selectExpr("*", "1 AS shard", "'z' AS id", "2.5 AS length", "'q' AS fp", "0 AS rank", "'h' AS hash", "3 AS component", "'v' AS block")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def smallest_reachable(nodes, pairs):
    """component of each node by plain flooding."""
    near = {n: set() for n in nodes}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(near):
        if n in out:
            continue
        todo, seen = [n], {n}
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out |= dict.fromkeys(seen, n)
    return out
