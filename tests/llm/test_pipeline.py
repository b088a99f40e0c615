"""Each stage of the pipeline against a plain version on the same input."""

import sys

import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import plain as plain_hits
from test_linededup import plain as plain_lines
from tokenizers import Tokenizer

import corpus_pipeline
from lobloom.llm import toxicity
from lobloom.llm.textbatch import Words
from lobloom.session import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    """Rows of the documents before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [("documents", docs)]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        tables.append((name, docs))
    return {name: df for name, df in tables}


def by_id(df):
    return {r.doc_id: r for r in df.orderBy("doc_id").collect()}


def test_stage_list_and_columns(chain):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for n in names[:-1]:
        assert chain[n].dtypes == chain["documents"].dtypes
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxicity_keeps_what_the_model_does_not_reject(spark, chain):
    before, after = by_id(chain["documents"]), by_id(chain["toxicity"])
    model = toxicity.fit(chain["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    for i, r in before.items():
        _, bucket = toxicity._buckets(Words([r.text.encode()]))
        kinds, n = np.unique(bucket, return_counts=True)
        score = np.sum(model.weights[kinds] * (1 + np.log(n)) * (model.weights[kinds] != 0))
        p = model.above(np.array([score]))[0, 0]
        if abs(p - toxicity.REJECT) > 1e-6:
            assert (i in after) == (p < toxicity.REJECT)
    assert all(after[i] == before[i] for i in after)


def test_lines(chain):
    before, after = by_id(chain["toxicity"]), by_id(chain["line_dedup"])
    want = plain_lines([r.text for r in before.values()])
    assert list(after) == list(before)
    assert [r.text for r in after.values()] == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def shingles(text):
    w = Words([text.encode()])
    n = len(w.starts)
    return {w.text_of(i, min(5, n)) for i in range(max(1, n - 4) if n else 0)}


def test_near_duplicates(chain):
    before, after = by_id(chain["line_dedup"]), by_id(chain["simhash_near_dedup"])
    sets = {i: shingles(r.text) for i, r in before.items()}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ids = list(sets)
    pairs = {(a, b): s for k, a in enumerate(ids) for b in ids[k + 1 :] if (s := alike(sets[a], sets[b])) >= 0.7}
    for i in set(before) - set(after):
        assert any(i in p for p in pairs), "a document went that is like no other"
    close = [p for p, s in pairs.items() if s >= 0.85]
    assert sum(a in after and b in after for a, b in close) <= 0.05 * len(close)
    assert all(after[i] == before[i] for i in after)


def test_contamination(spark, chain):
    before, after = by_id(chain["simhash_near_dedup"]), by_id(chain["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = plain_hits([r.text for r in before.values()], items)
    assert set(after) == {i for i, h in zip(before, hits) if not h[1]}


def test_packing(chain):
    docs = by_id(chain["decontamination"])
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = {i: len(model.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in docs.items()}
    rows = chain["packing"].collect()
    got, used = {}, {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == length
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(used) <= -(-sum(length.values()) // 2048) + 1


def test_entry_registers_the_pipeline():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
