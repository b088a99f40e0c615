"""Personal data by bootstrapped contextual extraction, with DataFrame and SQL functions only.

Seeds are the e-mail addresses, IP addresses, card and phone numbers that fixed
patterns find. The two words before a seed and the two words after it are lexical
patterns; other identifier-like tokens (with digits or an @) are instances that
the same patterns may hold. Patterns and instances form a graph of distinct edges,
scored in rounds: a pattern of a kind is taken if enough different instances speak
for it, if the lower bound of their share among all its instances is high, and if
its words are followed (or preceded) by such instances most of the times they
stand together at all. An instance is taken if the patterns around it leave little
doubt; taken instances speak for further patterns in the next round. Tokens in
taken patterns become spans of the pattern's kind; base spans always stay.

Counting is by different instances, so copies of a passage do not raise a score.
Edges are aggregated before any join; taken patterns are broadcast only when few.

Defined cases: null text is empty; rows are told apart by id and text, so repeated
rows get equal spans and null ids are kept; further columns are not looked at;
without seeds there are no patterns and no further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobloom.session import stage

KINDS = ["email", "ip", "card", "phone"]
# The query's patterns. A match starts where a run starts or a match ended, and runs are taken whole:
# both only spare attempts that cannot succeed.
_MAIL = "A-Za-z0-9._%+-"
REGEX = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^(?:0*{_BYTE}\.){{3}}0*{_BYTE}$"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
WORD = r"[\p{L}\p{N}]+"
NEAR = 80        # characters beside an instance in which its two words are looked for
SUPPORT = 20     # different instances that speak for a pattern
SHARE = 0.9      # lower 95 % bound of their share among the pattern's instances
SLOT = 0.5       # share of the places of the two words that hold such an instance
SURE = 0.9       # confidence of a taken instance
ROUNDS = 3
FEW = 100_000    # patterns (two words, a kind and a figure each) that are broadcast
BLOCK = 512


def running(values: str) -> str:
    """SQL: running sums of an array of longs, in blocks, so that work stays far below the square."""
    def sums(array: str) -> str:
        return (f"aggregate({array}, named_struct('s', 0L, 'l', cast(array() AS array<bigint>)), "
                "(a, x) -> named_struct('s', a.s + x, 'l', concat(a.l, array(a.s + x))), a -> a.l)")

    blocks = f"transform(sequence(0, (size({values}) - 1) div {BLOCK}), b -> slice({values}, b * {BLOCK} + 1, {BLOCK}))"
    before = f"concat(array(0L), slice({sums(f'transform({blocks}, b -> aggregate(b, 0L, (s, x) -> s + x))')}, 1, size({blocks}) - 1))"
    return f"flatten(zip_with({blocks}, {before}, (l, o) -> transform({sums('l')}, x -> x + o)))"


def _ends(text: str, regex: str, found: str) -> str:
    """SQL: the end of each match, in code points."""
    steps = (f"zip_with(slice(split({text}, {regex}, -1), 1, size({found})), {found}, "
             "(g, m) -> cast(char_length(g) + char_length(m) AS bigint))")
    return f"CASE WHEN size({found}) = 0 THEN cast(array() AS array<bigint>) ELSE {running(steps)} END"


def _quoted(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str) -> str:
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    size = f"length({digits})"
    if kind == "ip":
        return f"s.value rlike {_quoted(_IP)}"
    if kind == "phone":
        return f"{size} BETWEEN 8 AND 15"
    if kind == "card":
        digit = f"cast(substring({digits}, {size} - i + 1, 1) AS int)"
        luhn = (f"aggregate(sequence(1, {size}), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN {digit} "
                f"WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0")
        return f"CASE WHEN {size} BETWEEN 16 AND 19 THEN {luhn} ELSE false END"
    return "true"


def base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Adds ``out``: array of (kind number, start, end, value), by kind, then start. Null text has none."""
    cols = docs.columns
    found = {k: f"__found_{k}" for k in KINDS}
    d = docs.select("*", *[
        F.when(F.contains(F.col(text), F.lit({"email": "@", "phone": "+"}.get(k, ""))),
               F.regexp_extract_all(F.col(text), F.lit(REGEX[k]), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(found[k]) for k in KINDS])
    parts = []
    for no, k in enumerate(KINDS):
        ends = _ends(f"`{text}`", _quoted(REGEX[k]), found[k])
        parts.append(f"filter(zip_with({found[k]}, {ends}, (m, e) -> named_struct('kind', {no}, 'start', e - char_length(m), "
                     f"'end', e, 'value', m)), s -> {_valid(k)})")
    return d.select(*cols, F.expr(f"concat({', '.join(parts)})").alias(out))


def _words(side: str, last: bool) -> str:
    """SQL: the two words of ``side`` next to the instance, as a pattern; null where there are not two."""
    ws = f"regexp_extract_all(regexp_replace(lower({side}), '[0-9]', '0'), {_quoted(WORD)}, 0)"
    two = f"slice({ws}, -2, 2)" if last else f"slice({ws}, 1, 2)"
    return f"CASE WHEN size({ws}) > 1 THEN concat('{'<' if last else '>'} ', array_join({two}, ' ')) END"


def instances(docs: DataFrame, text: str = "text", base: str = "base") -> DataFrame:
    """Adds ``instances``: (kind number or null, start, end, value, before, after) of seeds and other identifier-like tokens."""
    cols = docs.columns
    t, q = f"`{text}`", _quoted(TOKEN)
    d = docs.withColumn("__tokens", F.expr(f"CASE WHEN {t} IS NULL THEN array() ELSE regexp_extract_all({t}, {q}, 0) END"))
    d = d.withColumn("__gaps", F.expr(f"CASE WHEN size(__tokens) > 0 THEN split({t}, {q}, -1) ELSE array() END"))
    ends = (f"CASE WHEN size(__tokens) = 0 THEN cast(array() AS array<bigint>) ELSE "
            f"{running('zip_with(slice(__gaps, 1, size(__tokens)), __tokens, (g, m) -> cast(char_length(g) + char_length(m) AS bigint))')} END")
    d = d.withColumn("__ends", F.expr(ends))
    # Four digits or an @ make a token identifier-like; seeds cover their own tokens.
    tokens = (
        "filter(transform(zip_with(zip_with(__tokens, __ends, (m, e) -> named_struct('m', m, 'e', e)), "
        "sequence(1, size(__tokens)), (t, i) -> named_struct('m', t.m, 'e', t.e, 'l', __gaps[i - 1], 'r', __gaps[i])), z -> "
        "named_struct('kind', cast(NULL AS int), 'start', z.e - char_length(z.m), 'end', z.e, 'value', lower(z.m), "
        f"'before', {_words(f'right(z.l, {NEAR})', True)}, 'after', {_words(f'left(z.r, {NEAR})', False)})), "
        "s -> (contains(s.value, '@') OR s.value rlike '(?:[^0-9]*[0-9]){4}') "
        f"AND NOT exists({base}, b -> b.start < s.end AND b.end > s.start))")
    tokens = f"CASE WHEN size(__tokens) = 0 THEN array() ELSE {tokens} END"
    before = f"substring({t}, cast(greatest(s.start - {NEAR}, 0) + 1 AS int), cast(least(s.start, {NEAR}) AS int))"
    after = f"substring({t}, cast(s.end + 1 AS int), {NEAR})"
    seeds = (f"transform({base}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'value', lower(s.value), "
             f"'before', {_words(before, True)}, 'after', {_words(after, False)}))")
    return d.select(*cols, F.expr(f"concat({seeds}, {tokens})").alias("instances"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _lower_bound(good: Column, n: Column) -> Column:
    """Lower end of the 95 % Wilson interval of good / n."""
    z2 = 3.84
    p = good / n
    return (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def _places(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places): how often the two words of each of ``patterns`` stand together."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower("text"), "[0-9]", "0"), F.lit(WORD), F.lit(0))
    pairs = texts.select(words.alias("w")).where("size(w) > 1").select(F.explode(F.expr(
        "zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b))")).alias("pair"))
    wanted = patterns.select("pattern", F.substring("pattern", 3, 1 << 20).alias("pair"))
    return pairs.join(_few(wanted), "pair").groupBy("pattern").agg(F.count(F.lit(1)).alias("places"))


def taken(edges: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(patterns(pattern, kind, score), found(value, kind, sure)) after the rounds; None if no pattern is taken.

    ``edges(pattern, value, kind, n)``: distinct; kind is null where the instance is no seed.
    """
    counted = None
    sure = edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("sure", F.lit(1.0))
    patterns = found = None
    for _ in range(ROUNDS):
        known = edges.where("kind IS NULL").select("pattern", "value", "n").join(
            sure.withColumnRenamed("kind", "k"), "value", "left") if found is not None else edges.where("kind IS NULL").select(
            "pattern", "value", "n", F.lit(None).cast("int").alias("k"), F.lit(0.0).alias("sure"))
        voices = edges.where("kind IS NOT NULL").select("pattern", "value", "n", F.col("kind").alias("k"), F.lit(1.0).alias("sure")).unionByName(known)
        per = voices.groupBy("pattern", "k").agg(
            F.sum(F.coalesce("sure", F.lit(0.0))).alias("good"), F.sum("n").alias("held"), F.count(F.lit(1)).alias("values"))
        of = per.groupBy("pattern").agg(F.sum("values").alias("all"), F.max(F.when(F.col("k").isNotNull(), F.struct("good", "held", "k"))).alias("best"))
        likely = stage(of.where((F.col("best.good") >= SUPPORT) & (_lower_bound(F.col("best.good"), F.col("all")) >= SHARE)).select(
            "pattern", "best.k", "best.good", "best.held", "all"), "patterns")
        if likely.isEmpty():
            break
        new = likely.select("pattern") if counted is None else likely.select("pattern").join(counted, "pattern", "left_anti")
        if not new.isEmpty():
            places = _places(texts, new)
            counted = stage(places if counted is None else counted.unionByName(places), "places")
        patterns = stage(likely.join(counted, "pattern", "left").where(
            F.col("held") >= SLOT * F.coalesce("places", F.lit(0))).select(
            "pattern", F.col("k").alias("kind"), (F.col("good") / F.col("all")).alias("score")), "taken")
        if patterns.isEmpty():
            return None
        joined = edges.where("kind IS NULL").select("pattern", "value").join(_few(patterns), "pattern")
        now = joined.groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("sure")).where(F.col("sure") >= SURE)
        last, found = found, stage(now, "found")
        if last is not None and found.count() == last.count():
            break
        sure = found.groupBy("value").agg(F.max(F.struct("sure", "kind")).alias("s")).select("value", "s.kind", "s.sure")
    return None if patterns is None or found is None else (patterns, found)


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of each row: base spans, and those with the discovered ones, as (kind number, start, end)."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")))
    seen = stage(instances(base_spans(rows)).select("doc_id", "key", F.transform("base", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"), "instances"), "instances")
    occurs = seen.select("key", F.explode("instances").alias("i")).select(
        "key", "i.kind", "i.start", "i.end", "i.value", F.explode(F.array("i.before", "i.after")).alias("pattern")).where("pattern IS NOT NULL")
    edges = stage(occurs.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "edges")
    more = taken(edges, rows)
    if more is None:
        return seen.select("doc_id", "base", F.col("base").alias("spans"))
    patterns, found = more
    spans = occurs.where("kind IS NULL").drop("kind").join(_few(patterns.select("pattern", "kind")), "pattern").join(
        found.select("value", "kind"), ["value", "kind"]).groupBy("key").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    return seen.join(spans, "key", "left").select(
        "doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(
            F.array_sort(F.concat("base", "added"))).alias("spans"))


def listed(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)), ',')")
