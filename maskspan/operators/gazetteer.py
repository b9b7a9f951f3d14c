"""Gazetteers: lists of known forms and suffixes, built by aggregation and matched with an automaton that travels with the tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of patterns up to which the automaton is sent to the workers.
AUTOMATON_BYTES = 128 << 20


def build(forms: DataFrame, least_suffix: int = 3) -> DataFrame:
    """(kind, label, pattern, n, rank): forms of 2 to 30 characters and their suffixes of 2 to 4 that occur often enough;
    the longest first."""
    good = forms.where(F.length("form").between(2, 30))
    exact = good.groupBy("label", F.col("form").alias("pattern")).agg(F.count("*").alias("n")).select(F.lit("exact").alias("kind"), "label", "pattern", "n")
    ends = F.array(*(F.when(F.length("form") > k, F.substring("form", -k, k)) for k in (2, 3, 4)))
    suffix = good.select("label", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("pattern")).groupBy("label", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least_suffix)
    both = exact.unionByName(suffix.select(F.lit("suffix").alias("kind"), "label", "pattern", "n"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "label").orderBy(F.desc(F.length("pattern")), "pattern")))


class Matcher:
    """D6, D7, D8 for one text."""

    def __init__(self, exact: list[tuple[str, str]], suffix: list[tuple[str, str, int]]):
        import ahocorasick

        self.exact = ahocorasick.Automaton()
        labels: dict[str, list[str]] = {}
        for label, pattern in exact:
            labels.setdefault(pattern, []).append(label)
        for pattern, names in labels.items():
            self.exact.add_word(pattern, (len(pattern), sorted(names)))
        self.exact.make_automaton()
        self.has_exact = bool(labels)
        self.suffix: dict[str, list[tuple[int, str]]] = {}
        for label, pattern, rank in suffix:
            self.suffix.setdefault(pattern, []).append((rank, label))
        self.sizes = sorted({len(p) for p in self.suffix})

    def match(self, text: str) -> list[tuple[str, int, int, str]]:
        """(label, start, end, kind): exact hits leftmost longest without overlap; suffix hits from the start of their word."""
        out = []
        if self.has_exact:
            longest: dict[int, tuple[int, list[str]]] = {}
            for stop, (n, names) in self.exact.iter(text):
                at = stop - n + 1
                if at not in longest or n > longest[at][0]:
                    longest[at] = (n, names)
            free = 0
            for at in sorted(longest):
                if at >= free:
                    n, names = longest[at]
                    free = at + n
                    out += [(name, at, free, "exact") for name in names]
        at = 0
        for word in text.split():
            begin = text.index(word, at)
            at = begin + len(word)
            best: dict[str, tuple[int, int]] = {}
            for n in self.sizes:
                for k in range(1, len(word) - n + 1):
                    for rank, label in self.suffix.get(word[k : k + n], ()):
                        # of a pattern the leftmost place counts, of a label the best rank
                        if label not in best or rank < best[label][0]:
                            best[label] = (rank, k + n)
            out += [(label, begin, begin + stop, "suffix") for label, (_, stop) in sorted(best.items())]
        return out


def hits(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, label, start, end, kind).  The patterns' size is checked; a longer list is joined with the texts' substrings,
    with the same rows."""
    size = patterns.agg(F.sum(F.octet_length("pattern") + 32)).first()[0] or 0
    if size > AUTOMATON_BYTES:
        return _hits_by_join(docs, patterns, text).unionByName(_suffixes_by_join(docs, patterns, text))
    rows = patterns.select("kind", "label", "pattern", "rank").collect()
    exact = [(r.label, r.pattern) for r in rows if r.kind == "exact"]
    suffix = [(r.label, r.pattern, r["rank"]) for r in rows if r.kind == "suffix"]

    def run(batches):
        matcher = Matcher(exact, suffix)
        for batch in batches:
            found = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"]) if isinstance(t, str) for m in matcher.match(t)]
            yield pd.DataFrame(found, columns=["doc_id", "label", "start", "end", "kind"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, "doc_id bigint, label string, start int, end int, kind string")


def _sizes(patterns: DataFrame, kind: str) -> list[int]:
    return [r[0] for r in patterns.where(F.col("kind") == kind).select(F.length("pattern").alias("n")).distinct().collect()]


def _hits_by_join(docs: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    """Exact hits of a list of any size: every substring of a known length is joined with the list, then claimed by row.  A row is
    told by its doc_id and text; equal rows are matched once and their hits repeated."""
    sizes = _sizes(patterns, "exact")
    t = F.col("text")
    grams = F.flatten(F.array(*(F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(0), F.length(t) - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.substring(t, i + 1, F.lit(n)).alias("pattern")))).otherwise(F.array().cast("array<struct<start:int,n:int,pattern:string>>")) for n in sizes)))
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, label string, start int, end int, kind string")
    named = patterns.where("kind = 'exact'").groupBy("pattern").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    rows = _counted(docs, text)
    found = rows.select("doc_id", "row", "times", F.explode(grams).alias("g")).select("doc_id", "row", "times", "g.*").join(named, "pattern")
    longest = found.groupBy("doc_id", "row", "times", "start").agg(F.max_by("labels", "n").alias("labels"), F.max("n").alias("n"))
    ordered = longest.groupBy("doc_id", "row", "times").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end"), "labels"))).alias("all"))
    claimed = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]), acc).otherwise(F.concat(acc, F.array(x))))
    each = ordered.select("doc_id", "times", F.explode(claimed).alias("h")).select("doc_id", "times", F.explode("h.labels").alias("label"), "h.start", "h.end")
    return _repeated(each, "exact")


def _suffixes_by_join(docs: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    """Suffix hits (D8) of a list of any size: the substrings behind a word's first character are joined with the list; of a label
    the best rank counts, of a pattern the leftmost place."""
    sizes = _sizes(patterns, "suffix")
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, label string, start int, end int, kind string")

    def words(batches):
        for batch in batches:
            out = []
            for doc_id, row, times, t in zip(batch["doc_id"], batch["row"], batch["times"], batch["text"]):
                at = 0
                for word in t.split():
                    begin = t.index(word, at)
                    at = begin + len(word)
                    places: dict[str, int] = {}
                    for n in sizes:
                        for k in range(1, len(word) - n + 1):
                            places.setdefault(word[k : k + n], begin + k + n)
                    out += [(doc_id, row, times, begin, stop, gram) for gram, stop in places.items()]
            yield pd.DataFrame(out, columns=["doc_id", "row", "times", "start", "end", "pattern"]).astype({"doc_id": "Int64"})

    grams = _counted(docs, text).mapInPandas(words, "doc_id bigint, row string, times bigint, start int, end int, pattern string")
    found = grams.join(patterns.where("kind = 'suffix'").select("label", "pattern", "rank"), "pattern")
    # ranks are unique within a label when build() made them; else the shorter and then the leftmost pattern wins, as in Matcher
    best = found.groupBy("doc_id", "row", "times", "start", "label").agg(F.min_by("end", F.struct("rank", F.length("pattern"), "end")).alias("end"))
    return _repeated(best, "suffix")


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, row, times, text): the distinct rows, a digest that tells those of one doc_id apart, and how often each occurs."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return rows.groupBy("doc_id", "text").agg(F.count("*").alias("times")).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("row"), "times", "text")


def _repeated(found: DataFrame, kind: str) -> DataFrame:
    again = found.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return again.select("doc_id", "label", "start", "end", F.lit(kind).alias("kind"))
