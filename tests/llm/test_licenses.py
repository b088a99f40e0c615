import re

from helpers import docs, empty, odd_texts, prose

from lobloom.llm import licenses as lc


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(t):
    w, places, labels = words(t), [], set()
    for phrase, label in lc.BASE_PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_shunting_yard():
    post = lambda s: lc.to_postfix(s.split())
    assert post("a or b and c") == "a b c and or".split()
    assert post("( a or b ) and c") == "a b or c and".split()
    assert post("a with x and b or c") == "a x with b and c or".split()
    assert post("( a") is None and post("a )") is None


def test_evaluation():
    assert lc.evaluate("mit or gpl-2.0-only".split()) == ({"mit", "gpl"}, 1.0)
    assert lc.evaluate("mit and gpl-2.0-only".split()) == ({"mit", "gpl"}, 0.3)
    names, score = lc.evaluate("gpl-2.0-only with classpath-exception-2.0".split())
    assert names == {"gpl"} and abs(score - 0.65) < 1e-12
    assert lc.evaluate("( mit and gpl".split()) == ({"mit", "gpl"}, 0.3)
    assert lc.evaluate([]) == (set(), 1.0)


def test_tokens_end_where_the_expression_does():
    text = b"SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH x this is prose\nBSD"
    assert lc.expression_tokens(text, text.index(b":")) == "( mit or apache-2.0 ) and gpl-2.0+ with x".split()
    assert lc.expression_tokens(b": MIT OR", 0) == ["mit"]
    assert lc.expression_tokens(b"", 0) == []


def test_scan_against_plain(spark):
    texts = [*odd_texts(), "The MIT  License, and the mit-license; Apache\nLicense. smit license mit licenses", "mit", "license mit", prose(9, 900) + "GNU General-Public License " + prose(8, 50),
             "spdx-license-identifier: GPL-3.0-only OR MIT", "spdx license identifier", "ümit license", "mit license" * 2]
    got = {r.doc_id: r.licenses for r in lc.scan(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, list(x.base_labels)) == base(t), t
        assert set(x.base_labels) <= set(x.labels) and list(x.labels) == sorted(set(x.labels)) and 0 <= x.score <= 1
    tagged = got[len(odd_texts()) + 4]
    assert list(tagged.labels) == ["gpl", "mit"] and tagged.score == 1.0 and list(tagged.expressions) == ["gpl-3.0-only or mit"]
    assert got[0].score == 1.0 and list(got[0].labels) == []


def test_empty_and_repeated(spark):
    assert lc.scan(empty(spark)).count() == 0
    twice = docs(spark, ["mit license"]).union(docs(spark, ["mit license"]))
    assert [r.licenses.n_base for r in lc.scan(twice).collect()] == [1, 1]
