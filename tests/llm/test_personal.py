import hashlib
import random
import re

from helpers import docs, empty, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from lobloom.llm import personal, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for no, (kind, regex) in enumerate(PLAIN.items()):
        for m in re.finditer(regex, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((no, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{personal.KINDS[k]}:{a}:{z}" for k, a, z in spans)


TEXTS = [
    "a.b+c@mail.example.com, x@y and z@q.r_s@t.u", "..@a.b@c.d@e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111", "12 34 56", "+1 (988) 555-2485 or +49-30-1234567.", "++1234567890", "+1 2", "ü@ß.de 😀 a@b.de 😀😀 10.0.0.1",
    "x" * 30_000 + "@" + "b." * 20_000 + "c", "7 " * 40_000, "+" * 20_000 + "4930123456789", "1.1.1." * 9_000, "é" * 9000 + " a@b.c",
    "a@b." + "c@d.e" * 3, "5500005555555559 5500005555555559", "\n\t+44 20 7946 0958\x00 a@b.c"]


def test_base_spans(spark):
    texts = [*odd_texts(), *TEXTS]
    got = {r.doc_id: r for r in personal.scan(docs(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == plain(t), t and t[:60]
        assert set(got[i].base) <= set(got[i].spans)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+ -(2)é😀\n", max_size=60), min_size=60, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    got = {r.doc_id: [tuple(s) for s in r.base] for r in personal.base_spans(docs(spark, texts)).selectExpr(
        "doc_id", "transform(base, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)) AS base").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def contexts():
    r = random.Random(5)
    out = [f"Hello all. Please contact me at user{i}@mail{i}.example.com before noon." for i in range(80)]
    out += ["Hello. Please contact me at root@localhost before noon.", "So contact me at host-4821-9937 before noon, 4821 of them."]
    # Two words that seldom hold a seed: their slot is mostly taken by plain words.
    out += [f"of the user{i}@rare{i}.example.org with it" for i in range(40)] + ["one of the people with it"] * 300 + ["of the serial-99887766 with it"]
    out += [f"nothing here {r.randrange(10**6)} of note" for i in range(30)]
    return out


def test_contexts_reveal_unseen_identifiers(spark):
    texts = contexts()
    got = {r.doc_id: r for r in personal.scan(docs(spark, texts)).collect()}
    a, b = texts[80], texts[81]
    at = a.index("root@"), b.index("host-")
    assert [tuple(s) for s in got[80].spans] == [(0, at[0], at[0] + len("root@localhost"))] and got[80].base == []
    assert [tuple(s) for s in got[81].spans] == [(0, at[1], at[1] + len("host-4821-9937"))]
    for i, t in enumerate(texts):
        if i not in (80, 81):
            assert [tuple(s) for s in got[i].spans] == plain(t), t


def test_copies_do_not_make_a_pattern(spark):
    texts = ["please contact me at only@one.example.com now"] * 200 + ["please contact me at odd-12345678 now"]
    got = personal.scan(docs(spark, texts)).where("doc_id = 200").first()
    assert got.spans == []


def test_later_rounds_use_found_instances(spark):
    # A second context holds instances that only the first one revealed.
    texts = [f"contact me at user{i}@mail{i}.example.com please do" for i in range(900)]
    texts += [f"contact me at node{i:05d}x please do" for i in range(60)] + [f"reach us under node{i:05d}x today" for i in range(60)]
    texts += ["reach us under gate77777z today"]
    got = {r.doc_id: r for r in personal.scan(docs(spark, texts)).collect()}
    assert [tuple(s) for s in got[900].spans] == [(0, 14, 24)]
    assert [tuple(s) for s in got[1020].spans] == [(0, 15, 25)]


def test_query_columns(spark, tmp_path):
    texts = [None, "a@b.de and +4930123456 then 1.2.3.4 and 4111111111111111"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op12_personal_data"](spark, str(tmp_path)).collect()}
    want = joined(plain(texts[1]))
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].spans == want
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_repeated_rows_null_ids_and_empty(spark):
    d = docs(spark, ["x a@b.c", "x a@b.c"]).selectExpr("cast(null AS long) AS doc_id", "text", "lang", "source", "n_chars")
    assert [len(r.spans) for r in personal.scan(d).collect()] == [1, 1]
    same = docs(spark, contexts())
    twice = personal.scan(same.union(same)).where("doc_id = 80").collect()
    assert len(twice) == 2 and twice[0] == twice[1] and len(twice[0].spans) == 1
    assert personal.scan(empty(spark)).count() == 0
