"""Licence scans: an Aho-Corasick automaton and a shunting-yard parser.

One automaton holds notice phrases and identifier tags. Phrases are found in the
normalised words of a text (A-Z lower-cased, one space between words), so a
phrase matches wherever its words stand consecutively. Behind each tag
(``SPDX-License-Identifier:``, ``License:`` …) stands a licence expression such as
``(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0``; its tokens
are put into postfix order by the shunting-yard method (``with`` binds tighter
than ``and``, ``and`` tighter than ``or``) and evaluated twice: to the set of
named licence families and to a permission score, where ``or`` takes the better
side, ``and`` the worse one, and an exception lifts its licence half-way to 1.

The score of a text is the least permission of all it mentions; 1 without any
mention. A malformed expression counts for the identifiers it names, joined by
``and``.

Each text is scanned where it is read; there is no shuffle. Defined cases: a null
or empty text has no words, no labels and score 1; rows are judged one by one;
other columns are carried through.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import result_name
from .textbatch import Words, column_chunks

# Phrases that the query's contract names.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notices, with the family that each names.
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl",
    "mozilla public license": "mpl", "bsd license": "bsd", "isc license": "isc", "creative commons": "cc",
    "cc by nc": "cc-nc", "cc by sa": "cc-sa", "cc by": "cc", "public domain": "public-domain", "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
}
TAGS = ("spdx license identifier", "license expression", "license identifier")
# Families by the beginning of an identifier; the first that fits counts.
FAMILIES = (
    ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("isc", "isc"),
    ("mpl", "mpl"), ("cc0", "public-domain"), ("unlicense", "public-domain"), ("cc-by-nc", "cc-nc"), ("cc-by-sa", "cc-sa"), ("cc-by", "cc"))
PERMISSION = {
    "public-domain": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 0.95, "cc": 0.9, "mpl": 0.6, "cc-sa": 0.5,
    "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-nc": 0.1, "proprietary": 0.0}
UNKNOWN_PERMISSION = 0.5
BINDING = {"or": 1, "and": 2, "with": 3}

_TOKEN = re.compile(rb"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_GAP = re.compile(rb"[ \t:=\"']*")
_BETWEEN = re.compile(rb"[ \t]*")


def expression_tokens(text: bytes, at: int) -> list[str]:
    """Tokens of the licence expression that begins at ``at``.

    It ends with the line, at a character that no expression holds, or where
    two identifiers follow each other.
    """
    at = _GAP.match(text, at).end()
    tokens: list[str] = []
    operand = True  # an identifier or "(" may come next
    while m := _TOKEN.match(text, at):
        token = m[0].decode().lower()
        opens = token == "(" or (token != ")" and token not in BINDING)
        if opens != operand:
            break
        tokens.append(token)
        operand = token == "(" or token in BINDING
        at = _BETWEEN.match(text, m.end()).end()
    while tokens and tokens[-1] in BINDING:
        tokens.pop()
    return tokens


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None where brackets or operands do not match."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token in BINDING:
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[token]:
                out.append(held.pop())
            held.append(token)
        elif token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            out.append(token)
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out


def family(identifier: str) -> str:
    return next((f for start, f in FAMILIES if identifier.startswith(start)), identifier)


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Families named by an expression, and its permission score."""
    names = [t for t in tokens if t not in BINDING and t not in "()"]
    postfix = to_postfix(tokens)
    stack: list[tuple[set[str], float]] = []
    for token in postfix or ():
        if token not in BINDING:
            stack.append(({family(token)}, PERMISSION.get(family(token), UNKNOWN_PERMISSION)))
            continue
        if len(stack) < 2:
            postfix = None
            break
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], (1.0 + left[1]) / 2))
        else:
            stack.append((left[0] | right[0], (max if token == "or" else min)(left[1], right[1])))
    if postfix is None or len(stack) != 1:
        known = {family(n) for n in names}
        return known, min((PERMISSION.get(f, UNKNOWN_PERMISSION) for f in known), default=1.0)
    return stack[0]


def automaton(base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]) -> ahocorasick.Automaton:
    """Matches whole words: every phrase has a space on both sides."""
    found: dict[str, list] = {}
    for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags, ""))):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((kind, label, len(phrase.split())))
    a = ahocorasick.Automaton()
    for phrase, meanings in found.items():
        a.add_word(phrase, (len(phrase), meanings))
    a.make_automaton()
    return a


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("expressions", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]


def _spaced(w: Words) -> tuple[str, np.ndarray]:
    """All words of a chunk behind one space each, two spaces between texts; where each word begins.

    The result holds one character for each byte, so places are byte places.
    """
    if len(w.starts) == 0:
        return "", np.zeros(0, np.int64)
    size = w.ends - w.starts
    gap = np.ones(len(size), np.int64)
    gap[w.first[:-1][w.per_doc > 0]] = 2
    begin = np.cumsum(gap + size) - size
    out = np.full(begin[-1] + size[-1] + 2, 32, np.uint8)
    shift = np.repeat(begin - w.starts, size)
    source = np.flatnonzero(_inside(w))
    out[source + shift] = w.low[source]
    return out.tobytes().decode("latin-1"), begin


def _inside(w: Words) -> np.ndarray:
    edge = np.zeros(len(w.low) + 1, np.int8)
    edge[w.starts] = 1
    edge[w.ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def scan(docs: DataFrame, text: str = "text", base: dict[str, str] | None = None,
         notices: dict[str, str] | None = None, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """Adds struct ``licenses`` (see ``_RESULT``) to ``docs``."""
    base = BASE_PHRASES if base is None else base
    notices = NOTICES if notices is None else notices
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(result_name(docs, "licenses"), _RESULT)])

    def judge(batches):
        machine = automaton(base, notices, tags)
        for b in batches:
            cols: list[list] = [[] for _ in _KINDS]
            for _, texts in column_chunks(b.column(at)):
                w = Words(texts)
                spaced, begin = _spaced(w)
                seen: dict[int, dict] = {}
                for end, (length, meanings) in machine.iter(spaced):
                    word = int(np.searchsorted(begin, end - length + 2))
                    k = int(w.doc_of(np.int64(word)))
                    own = seen.setdefault(k, {"base": [], "base_labels": set(), "labels": set(), "expressions": [], "places": set(), "score": 1.0})
                    for kind, label, n in meanings:
                        if kind == "base":
                            own["base"].append(word - int(w.first[k]))
                            own["base_labels"].add(label)
                        if kind == "tag":
                            place = int(w.ends[word + n - 1] - w.doc_at[k])
                            if place in own["places"]:  # a tag that ends in another tag
                                continue
                            own["places"].add(place)
                            tokens = expression_tokens(texts[k], place)
                            names, score = evaluate(tokens)
                            if tokens:
                                own["expressions"].append(" ".join(tokens))
                        else:
                            names, score = {label}, PERMISSION.get(label, UNKNOWN_PERMISSION)
                        own["labels"] |= names
                        own["score"] = min(own["score"], score)
                for k, n in enumerate(w.per_doc.tolist()):
                    own = seen.get(k)
                    if own is None:
                        row = (n, 0, None, None, [], [], [], 1.0)
                    else:
                        row = (n, len(own["base"]), min(own["base"], default=None), max(own["base"], default=None),
                               sorted(own["base_labels"]), sorted(own["labels"]), own["expressions"], own["score"])
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
            result = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_RESULT.names)
            yield pa.RecordBatch.from_arrays([*b.columns, result], names=schema.names)

    return docs.mapInArrow(judge, schema)
