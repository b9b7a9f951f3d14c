"""Column functions on spans: everything here is a Catalyst expression, no Python runs on the data.

A span is struct<type, start, end, text, confidence, source>; offsets count code points from 0, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

SPAN = "struct<type:string,start:int,end:int,text:string,confidence:double,source:string>"
SPANS = f"array<{SPAN}>"
APPLIED = "array<struct<type:string,start:int,end:int,placeholder:string,confidence:double,source:string>>"
SEGMENTS = "array<struct<m_start:int,m_end:int,o_start:int,o_end:int,is_mask:boolean>>"
OFFSETS = "array<struct<start:int,end:int,text:string>>"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def let(value: Column, body) -> Column:
    """body(value), the value reckoned once: a lambda's variable, where a repeated column would be evaluated again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(type_: Column, start: Column, end: Column, text: Column, confidence: Column, source: Column) -> Column:
    return F.struct(type_.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), confidence.cast("double").alias("confidence"), source.alias("source"))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def gate(text: Column, needs: str | tuple, known: dict[str, Column] | None = None) -> Column:
    """Whether a text has what a rule needs; known: columns that hold the shared gates (and, as "lower", the text in lower case)."""
    known = known or {}
    if isinstance(needs, tuple):
        low = known.get("lower", F.lower(text))
        parts = [low.contains(n) if isinstance(n, str) else reduce(or_, (low.contains(x) for x in n)) for n in needs]
        return reduce(and_, parts)
    if needs in known:
        return known[needs]
    return text.contains(needs) if len(needs) == 1 else text.rlike(needs)


#: Stands around matches while offsets are taken; a text that holds it goes another way.
MARK = "\x01"


def matches(text: Column | str, pattern: str, group: str = "whole", needs: str | tuple | None = None, known: dict[str, Column] | None = None) -> Column:
    """Offsets of all matches.  One pass of the pattern puts marks around them, the text is cut at the marks, and a fold adds up the
    lengths of the pieces.  Texts without a match, nearly all of them, never reach the fold."""
    t, p = col(text), F.lit(pattern)
    start = F.struct(F.lit(0).alias("at"), empty(OFFSETS).alias("out"))

    def step(acc: Column, gap: Column, hit: Column, part: Column) -> Column:
        lo = acc["at"] + F.length(gap)
        hi = lo + F.length(hit)
        first = hi - F.length(part) if group == "suffix" else lo
        last = lo + F.length(part) if group == "prefix" else hi
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"), part.alias("text")))).alias("out"))

    # gap, hit (and part) by turns, then the rest
    wide = 2 if group == "whole" else 3
    marked = F.regexp_replace(t, pattern, MARK + "$0" + MARK + ("" if group == "whole" else "$1" + MARK))
    cuts = lambda v: F.aggregate(F.sequence(F.lit(0), F.size(v) - 2, F.lit(wide)), start, lambda acc, k: step(acc, F.get(v, k), F.get(v, k + 1), F.get(v, k + wide - 1)), lambda acc: acc["out"])
    quick = let(marked, lambda m: F.when(m.contains(MARK), let(F.split(m, MARK, -1), cuts)).otherwise(empty(OFFSETS)))
    # a text with marks of its own: the matches and the pieces between them, a pass for each
    whole = F.regexp_extract_all(t, p, F.lit(0))
    zipped = F.arrays_zip(F.slice(F.split(t, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("hit"), (whole if group == "whole" else F.regexp_extract_all(t, p, F.lit(1))).alias("part"))
    slow = F.when(t.rlike(pattern), F.aggregate(zipped, start, lambda acc, x: step(acc, x["gap"], x["hit"], x["part"]), lambda acc: acc["out"])).otherwise(empty(OFFSETS))
    return F.when(t.isNotNull() if needs is None else gate(t, needs, known), F.when(t.contains(MARK), slow).otherwise(quick)).otherwise(empty(OFFSETS))


def digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"\D", ""), ""), lambda x: x.try_cast("int"))


def luhn(text: Column | str) -> Column:
    """The card checksum; text without a digit fails."""

    def check(d: Column) -> Column:
        n = F.size(d)
        doubled = F.transform(d, lambda x, i: F.when((n - i) % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
        return (n > 0) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)

    return let(F.filter(digits(col(text)), lambda x: x.isNotNull()), check)


def rrn(text: Column | str) -> Column:
    """The weighted modulo-11 checksum of 13-digit resident numbers."""
    weights = F.array(*(F.lit(w) for w in (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)))

    def check(d: Column) -> Column:
        total = F.aggregate(F.zip_with(F.slice(d, 1, 12), weights, lambda a, b: a * b), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(d) == 13, (11 - total % 11) % 10 == F.get(d, F.lit(12))).otherwise(False)

    return let(F.filter(digits(col(text)), lambda x: x.isNotNull()), check)


def rule_spans(text: Column | str, rules: Sequence[R.Rule] = R.PII_RULES, source: str = "rule", known: dict[str, Column] | None = None) -> Column:
    """The spans of a rule table, in the table's order."""
    parts = [_rule_spans(text, rule, source, known) for rule in rules]
    return F.concat(*parts) if parts else empty(SPANS)


def _rule_spans(text: Column | str, rule: R.Rule, source: str, known: dict[str, Column] | None = None) -> Column:
    found = matches(text, rule.pattern, rule.group, rule.needs, known)
    if rule.validator:
        check = luhn if rule.validator == "luhn" else rrn
        found = F.filter(found, lambda x: check(x["text"]))
    return F.transform(found, lambda x: span(F.lit(rule.type), x["start"], x["end"], x["text"], F.lit(rule.confidence), F.lit(source)))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def claim(hits: Column) -> Column:
    """Hits in order of priority; one that overlaps an earlier one is dropped."""
    return let(hits, lambda v: F.aggregate(v, F.filter(v, lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x)))))


def without_overlap(items: Column, others: Column) -> Column:
    """The items that overlap none of the others."""
    return let(others, lambda o: F.filter(items, lambda x: ~F.exists(o, lambda y: overlap(x, y))))


def number_hits(text: Column | str) -> Column:
    """D3: the number rules' hits after claiming; two digits, which all of them need, are looked for once."""
    hits = claim(F.concat(*(_rule_spans(text, R.Rule(label, pattern, 0.9, needs=R.NUMBER_NEEDS.get(label)), "rule") for label, pattern in R.NUMBER_RULES)))
    return F.when(col(text).rlike(R.DIGITS), hits).otherwise(empty(SPANS))


def correct_entities(text: Column | str, entities: Column) -> Column:
    """D3: the hits, and the model's entities that overlap none, in the order (start, end, type)."""
    kept = let(number_hits(text), lambda hits: F.concat(without_overlap(entities, hits), hits))
    keyed = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["type"].alias("t"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def dedupe(items: Column) -> Column:
    """Sorted by (start, end, falling confidence, order), the first of each (type, start, end).  Equal ones are neighbours after a
    sort that has the type third, so each is compared with one other: n log n however many there are.  sort_array compares natively,
    where array_sort evaluates a lambda twice a comparison."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["type"].alias("t"), (-x["confidence"]).alias("c"), i.alias("i"), x.alias("x"))))
    same = lambda a, b: (a["s"] == b["s"]) & (a["e"] == b["e"]) & a["t"].eqNullSafe(b["t"])
    first = lambda v: F.filter(v, lambda k, i: (i == 0) | ~same(k, F.get(v, i - 1)))
    order = lambda k: F.struct(k["s"], k["e"], k["c"], k["i"], k["x"].alias("x"))
    return let(keyed, lambda v: F.transform(F.sort_array(F.transform(first(v), order)), lambda k: k["x"]))


def shift(items: Column, by: Column, text: Column) -> Column:
    """Chunk offsets to document offsets, the text cut again."""
    return F.transform(items, lambda x: span(x["type"], x["start"] + by, x["end"] + by, cut(text, x["start"] + by, x["end"] + by), x["confidence"], x["source"]))


def repair(text: Column | str, items: Column) -> Column:
    """Without text, coordinates in range are trusted and others dropped; else the text decides: in place, within five
    places (the leftmost first), else its first occurrence, else the item is dropped.  Without valid coordinates only the first
    occurrence counts."""
    t = col(text)
    n = F.length(t)

    def place(x: Column) -> Column:
        s, e, own = x["start"], x["end"], x["text"]
        valid = s.isNotNull() & e.isNotNull() & (s >= 0) & (e <= n) & (s < e)
        blank = F.coalesce(own, F.lit("")) == ""
        offsets = F.array(*(F.lit(k) for k in (0, *range(-5, 6))))
        near = F.get(F.filter(offsets, lambda k: (s + k >= 0) & (e + k <= n) & (cut(t, s + k, e + k) == own)), F.lit(0))
        found = F.position(own, t) - 1
        at = F.when(blank, F.when(valid, s)).when(valid & near.isNotNull(), s + near).when(found >= 0, found)
        size = F.when(blank | (valid & near.isNotNull()), e - s).otherwise(F.length(own))
        return span(x["type"], at, at + size, own, x["confidence"], x["source"])

    return F.filter(F.transform(items, place), lambda x: x["start"].isNotNull())


def _ordered(items: Column) -> Column:
    """Sorted by (start, falling length, order)."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(x["start"].alias("s"), (x["start"] - x["end"]).alias("l"), i.alias("i"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def merge(items: Column) -> Column:
    """Overlapping spans become one; touching ones stay apart.  The type of higher (confidence, length) stays, the
    length of what has been merged so far counting for it."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        c, d = F.coalesce(x["confidence"], F.lit(0.0)), F.coalesce(last["confidence"], F.lit(0.0))
        wins = (c > d) | ((c == d) & (x["end"] - x["start"] > last["end"] - last["start"]))
        both = span(F.when(wins, x["type"]).otherwise(last["type"]), last["start"], F.greatest(last["end"], x["end"]), F.lit(None).cast("string"), F.when(wins, x["confidence"]).otherwise(last["confidence"]), last["source"])
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(F.when(x["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x))))

    plain = F.transform(_ordered(items), lambda x: span(x["type"], x["start"], x["end"], x["text"], x["confidence"], x["source"]))
    return let(plain.cast(SPANS), lambda v: F.aggregate(v, empty(SPANS), lambda acc, x: step(acc, x).cast(SPANS)))


def merge_first_wins(items: Column) -> Column:
    """The review panel's variant: sorted by start alone, the first type stays."""
    keyed = F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x.alias("x")))), lambda k: k["x"])
    plain = F.transform(keyed, lambda x: span(x["type"], x["start"], x["end"], x["text"], x["confidence"], x["source"]))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        both = span(last["type"], last["start"], F.greatest(last["end"], x["end"]), last["text"], last["confidence"], last["source"])
        return F.when(x["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x))).cast(SPANS)

    return F.when(F.size(items) > 0, F.aggregate(F.slice(plain, 2, F.greatest(F.size(plain), F.lit(1))), F.slice(plain, 1, 1).cast(SPANS), step)).otherwise(empty(SPANS))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def entity_type(label: Column | str) -> Column:
    """P10: a model label's type."""
    return F.coalesce(F.try_element_at(_map(R.LABEL_TYPE), col(label)), F.lit("OTHER_PII"))


def placeholder(type_: Column | str) -> Column:
    """P11: "[label 마스킹]"; all injections share a label."""
    t = col(type_)
    label = F.when(t.isin(*R.INJECTION_TYPES), F.lit(R.INJECTION_LABEL)).otherwise(F.coalesce(F.try_element_at(_map(R.TYPE_LABEL), t), F.lit(R.UNKNOWN_LABEL)))
    return F.concat(F.lit("["), label, F.lit(" 마스킹]"))


def panel_label(type_: Column | str) -> Column:
    """The review panel's name of a type."""
    t = col(type_)
    return F.coalesce(F.try_element_at(_map(R.PANEL_LABEL), t), t)


def splice(text: Column | str, merged: Column, mark=placeholder) -> Column:
    """struct(masked_text, applied) for disjoint sorted spans."""
    t = col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(merged, start, lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], cut(t, acc["at"], x["start"]), mark(x["type"])).alias("out")), lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    applied = F.transform(merged, lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), mark(x["type"]).alias("placeholder"), x["confidence"].alias("confidence"), x["source"].alias("source")))
    return F.struct(masked.alias("masked_text"), applied.cast(APPLIED).alias("applied"))


def mask(text: Column | str, items: Column) -> Column:
    """Repair, merge, splice."""
    return let(merge(repair(text, items)), lambda m: splice(text, m))


def redaction(text: Column | str, items: Column) -> Column:
    """struct(text, segments, count): the text with placeholders and a gap-free cover of it that says where each part
    comes from."""
    t = col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("out"), empty(SEGMENTS).alias("seg"))

    def segment(m0: Column, m1: Column, o0: Column, o1: Column, is_mask: bool) -> Column:
        return F.array(F.struct(m0.alias("m_start"), m1.alias("m_end"), o0.alias("o_start"), o1.alias("o_end"), F.lit(is_mask).alias("is_mask")))

    def step(acc: Column, x: Column) -> Column:
        gap = x["start"] - acc["at"]
        mark = placeholder(x["type"])
        n = acc["n"] + gap
        plain = F.when(gap > 0, segment(acc["n"], n, acc["at"], x["start"], False)).otherwise(empty(SEGMENTS))
        return F.struct(x["end"].alias("at"), (n + F.length(mark)).alias("n"), F.concat(acc["out"], cut(t, acc["at"], x["start"]), mark).alias("out"), F.concat(acc["seg"], plain, segment(n, n + F.length(mark), x["start"], x["end"], True)).cast(SEGMENTS).alias("seg"))

    def finish(acc: Column) -> Column:
        rest = F.length(t) - acc["at"]
        tail = F.when(rest > 0, segment(acc["n"], acc["n"] + rest, acc["at"], F.length(t), False)).otherwise(empty(SEGMENTS))
        return F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))).alias("text"), F.concat(acc["seg"], tail).cast(SEGMENTS).alias("segments"), F.lit(0).alias("count"))

    return let(merge(repair(t, items)), lambda merged: F.aggregate(merged, start, step, lambda acc: finish(acc).withField("count", F.size(merged))))


def to_original(segments: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in the original text, or null; inside a placeholder the whole hidden span is meant."""
    total = F.coalesce(F.array_max(F.transform(segments, lambda s: s["m_end"])), F.lit(0))
    lo, hi = F.greatest(F.lit(0), F.least(start, total)), F.greatest(F.lit(0), F.least(end, total))
    at = lambda p: F.get(F.filter(segments, lambda s: (s["m_start"] <= p) & (p < s["m_end"])), F.lit(0))
    a, b = at(lo), at(hi - 1)
    first = F.when(a["is_mask"], a["o_start"]).otherwise(a["o_start"] + lo - a["m_start"])
    last = F.when(b["is_mask"], b["o_end"]).otherwise(b["o_start"] + hi - b["m_start"])
    return F.when((start < end) & (lo < hi) & first.isNotNull() & last.isNotNull() & (first < last), F.struct(first.cast("int").alias("start"), last.cast("int").alias("end")))


def map_back(segments: Column, ranges: Column) -> Column:
    """The distinct original ranges of masked ones, without the unmappable."""
    return F.array_distinct(F.filter(F.transform(ranges, lambda r: to_original(segments, r["start"], r["end"])), lambda x: x.isNotNull()))


def cover(text: Column | str, items: Column) -> Column:
    """The review panel's cover of the text: array of struct(kind, idx, type, text); items in order of start, a later one is
    clipped to what is free, or dropped."""
    t = col(text)
    kind = "array<struct<kind:string,idx:int,type:string,text:string>>"
    piece = lambda k, i, ty, x: F.array(F.struct(F.lit(k).alias("kind"), i.cast("int").alias("idx"), ty.cast("string").alias("type"), x.alias("text")))
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x.alias("x"))))
    start = F.struct(F.lit(0).alias("at"), empty(kind).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        x = k["x"]
        lo = F.greatest(x["start"], acc["at"])
        gap = F.when(lo > acc["at"], piece("text", F.lit(None), F.lit(None), cut(t, acc["at"], lo))).otherwise(empty(kind))
        return F.when(x["end"] > lo, F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, piece("item", k["i"], x["type"], cut(t, lo, x["end"]))).cast(kind).alias("out"))).otherwise(acc)

    def finish(acc: Column) -> Column:
        rest = F.when(F.length(t) > acc["at"], piece("text", F.lit(None), F.lit(None), F.substring(t, acc["at"] + 1, F.length(t)))).otherwise(empty(kind))
        return F.concat(acc["out"], rest).cast(kind)

    return F.aggregate(keyed, start, step, finish)


def remask(segments: Column, kept: Column) -> Column:
    """The cover's text with every item masked but those whose idx the user keeps."""
    part = lambda s: F.when((s["kind"] == "item") & ~F.array_contains(kept, s["idx"]), F.concat(F.lit("["), panel_label(s["type"]), F.lit(" 마스킹]"))).otherwise(s["text"])
    return F.array_join(F.transform(segments, part), "")


def escape_html(text: Column | str) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlight(segments: Column) -> Column:
    """The cover as HTML, items in <mark>."""
    part = lambda s: F.when(s["kind"] == "item", F.concat(F.lit('<mark title="'), escape_html(panel_label(s["type"])), F.lit('">'), escape_html(s["text"]), F.lit("</mark>"))).otherwise(escape_html(s["text"]))
    return F.array_join(F.transform(segments, part), "")


def highlight_masked(text: Column | str) -> Column:
    """Masked text as HTML, placeholders in <mark>."""
    return F.regexp_replace(escape_html(text), r"(\[[^\[\]]+ 마스킹\])", "<mark>$1</mark>")


def find_phrase(text: Column | str, phrase: Column | str) -> Column:
    """struct(start, end) of a phrase, exact or else with all white space ignored; null if absent or blank."""
    t, p = col(text), col(phrase)
    exact = F.position(p, t) - 1
    bare = F.regexp_replace(p, r"(?U)\s", "")
    marked = F.transform(F.split(t, ""), lambda c, i: F.when(~c.rlike(r"^(?U)\s$"), i))
    index = F.filter(marked, lambda i: i.isNotNull())
    at = F.position(bare, F.regexp_replace(t, r"(?U)\s", "")) - 1
    loose = let(index, lambda v: F.struct(F.get(v, at).cast("int").alias("start"), (F.get(v, at + F.length(bare) - 1) + 1).cast("int").alias("end")))
    return F.when(p.isNull() | t.isNull(), None).when(exact >= 0, F.struct(exact.cast("int").alias("start"), (exact + F.length(p)).cast("int").alias("end"))).when((F.length(bare) > 0) & (at >= 0), loose)


def answer_phrases(content: Column | str) -> Column:
    """The phrases of a localizer's answer.  Null: undecidable; an empty array: it said there are none."""
    c = F.regexp_extract(col(content), r"(?s)\{.*\}", 0)
    whole = F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
    valid = F.get_json_object(c, "$").isNotNull() & whole.isNotNull()
    strings = lambda x: F.from_json(x, "array<string>")
    is_list = lambda x: F.trim(x).startswith("[") & strings(x).isNotNull()
    texts_only = lambda x: is_list(x) & (F.size(strings(x)) > 0) & F.trim(x).rlike(r'^\[\s*"(?:[^"\\]|\\.)*"(?:\s*,\s*"(?:[^"\\]|\\.)*")*\s*\]$')
    named = F.try_element_at(whole, F.lit("spans"))
    lists = F.filter(F.map_values(whole), texts_only)
    chosen = F.when(named.isNotNull() & is_list(named), strings(named)).when(F.size(lists) == 1, strings(F.get(lists, F.lit(0))))
    return F.when(valid, F.filter(chosen, lambda x: x.isNotNull() & (x != "")))


def injection_spans(text: Column | str, phrases: Column, flagged: Column, type_: str = "OTHER_INJECTION", confidence: float | Column = 0.9) -> Column:
    """Three states: phrases found -> their places; an empty array -> nothing; null (undecidable) or nothing located -> the
    whole text.  Nothing for a text that the classifier didn't flag (or couldn't judge)."""
    t = col(text)
    score = F.lit(confidence) if isinstance(confidence, float) else confidence
    whole = F.array(span(F.lit(type_), F.lit(0), F.length(t), t, score, F.lit("llm")))
    places = F.array_distinct(F.filter(F.transform(phrases, lambda p: find_phrase(t, p)), lambda x: x.isNotNull()))
    located = F.transform(places, lambda x: span(F.lit(type_), x["start"], x["end"], cut(t, x["start"], x["end"]), score, F.lit("llm")))
    out = F.when(phrases.isNull(), whole).when(F.size(phrases) == 0, empty(SPANS)).when(F.size(places) == 0, whole).otherwise(located.cast(SPANS))
    return F.when(F.coalesce(flagged, F.lit(False)) & F.coalesce(t.rlike(r"(?U)\S"), F.lit(False)), out.cast(SPANS)).otherwise(empty(SPANS))


def cache_key(prompt: Column | str, redacted: Column | str) -> Column:
    """D27."""
    return F.sha2(F.concat(F.coalesce(col(prompt), F.lit("")), F.lit("\0"), col(redacted)), 256)


def extension(name: Column | str) -> Column:
    """The lower-case extension with its dot; leading dots are no extension."""
    return F.lower(F.regexp_extract(F.regexp_extract(col(name), r"([^/]*)$", 1), r"^\.*[^.].*(\.[^.]*)$|^$", 1))


def masked_name(name: Column | str, ext: str = "docx") -> Column:
    """K6: base_masked.ext."""
    n = F.coalesce(col(name), F.lit(""))
    base = F.regexp_replace(n, r"^(.+)\.[^.]*$", "$1")
    return F.when(n == "", F.lit(f"masked_document.{ext}")).otherwise(F.concat(base, F.lit(f"_masked.{ext}")))


def format_bytes(n: Column | str) -> Column:
    """Bytes for people."""
    x = col(n).cast("double")
    out = None
    for limit, unit, places in ((1024.0**3, "GB", 2), (1024.0**2, "MB", 1), (1024.0, "KB", 0)):
        text = F.concat(F.format_string(f"%.{places}f", x / limit), F.lit(f" {unit}"))
        out = F.when(x >= limit, text) if out is None else out.when(x >= limit, text)
    return out.otherwise(F.concat(col(n).cast("bigint").cast("string"), F.lit(" B")))


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_config(url: Column | str, table: dict[str, str]) -> Column:
    """The configuration of the first suffix in the table that the host ends with; null if there is none."""
    host = host_of(url)
    out = None
    for suffix, name in table.items():
        out = F.when(host.endswith(suffix), name) if out is None else out.when(host.endswith(suffix), name)
    return F.lit(None).cast("string") if out is None else out
