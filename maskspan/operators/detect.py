"""Detectors: rule tables, and the surface for models (vectorised, over Arrow batches)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import spans as S
from . import segment


#: Bytes up to which an input is dealt out anew: a small file can be one row group, which one core would scan alone.
SPREAD_BYTES = 256 << 20


def fresh(df: DataFrame, n: int, *taken: str) -> list[str]:
    """n column names that df doesn't have, in any case, and that aren't taken otherwise."""
    have = {c.lower() for c in (*df.columns, *taken)}
    return [name for k in range(n + len(have)) if (name := f"_own{k}") not in have][:n]


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input out to all cores before costly expressions; a large one has row groups enough and isn't shuffled.  A session
    that doesn't tell the plan's size (a remote one) scans it where it lies."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return df
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


class Detector:
    """gives a DataFrame's `text` column an array of spans.  ready() is False while a model's files are missing."""

    name = "detector"
    kind = "pii"

    def ready(self) -> bool:
        return True

    def spans(self, df: DataFrame, out: str = "spans") -> DataFrame:
        raise NotImplementedError


class RuleDetector(Detector):
    """A rule table; a Catalyst expression on whole documents, so nothing can straddle a chunk."""

    def __init__(self, name: str, kind: str, rules: tuple[R.Rule, ...]):
        self.name, self.kind, self.rules = name, kind, rules

    def spans(self, df: DataFrame, out: str = "spans") -> DataFrame:
        """What several rules need is looked for once a text, in columns of their own."""
        shared = {R.HANGUL: F.col("text").rlike(R.HANGUL), R.DIGITS: F.col("text").rlike(R.DIGITS), "lower": F.lower("text")}
        wanted = [r.needs if isinstance(r.needs, str) else "lower" for r in self.rules if r.needs is not None]
        names = {k: name for k, name in zip(shared, fresh(df, len(shared), out)) if wanted.count(k) > 1}
        gated = df.withColumns({name: shared[k] for k, name in names.items()}) if names else df
        found = S.dedupe(S.rule_spans("text", self.rules, known={k: F.col(name) for k, name in names.items()}))
        return gated.withColumn(out, F.when(F.col("text").rlike(r"(?U)\S"), found).otherwise(S.empty(S.SPANS))).drop(*names.values())


class NumberRuleDetector(Detector):
    """D3 with D18's mapping to types."""

    name, kind = "numbers", "pii"

    def spans(self, df: DataFrame, out: str = "spans") -> DataFrame:
        hits = S.number_hits("text")
        return df.withColumn(out, F.coalesce(F.transform(hits, lambda x: S.span(S.entity_type(x["type"]), x["start"], x["end"], x["text"], x["confidence"], x["source"])), S.empty(S.SPANS)))


class ModelDetector(Detector):
    """A model over windows of chunks.  predict: texts -> for each a list of (label, begin, end)."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], list[list[tuple[str, int, int]]]]], kind: str = "pii", ready: Callable[[], bool] = lambda: True, confidence: float = 0.9, batch: int = 8):
        self.name, self.kind, self.load, self._ready, self.confidence, self.batch = name, kind, load, ready, confidence, batch

    def ready(self) -> bool:
        return self._ready()

    def spans(self, df: DataFrame, out: str = "spans") -> DataFrame:
        """A document's windows go to the model as one array and its entities come back as one, in the same row: nothing is exploded,
        shuffled or sent twice.  The first window that finds an entity counts (J3)."""
        load, most = self.load, self.batch

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            predict = load()  # once a task, not once a batch
            for rows, size in batches:
                size = size.clip(lower=0).astype(int).tolist()
                flat = [w["text"] or "" for x in rows if x is not None for w in x]
                found = [y for at in range(0, len(flat), most) for y in predict(flat[at : at + most])]
                out, at = [], 0
                for x, n in zip(rows, size):
                    seen: dict = {}
                    for w, entities in zip(x if n else (), found[at : at + n]):
                        for t, begin, end in entities:
                            seen.setdefault((t, begin + w["offset"], end + w["offset"]), None)
                    at += n
                    out.append([{"type": t, "start": b, "end": e} for t, b, e in seen])
                yield pd.Series(out, dtype=object)

        model = F.pandas_udf(run, "array<struct<type:string,start:int,end:int>>")
        parts = F.flatten(F.transform(segment.chunk_structs(F.col("text"), segment.CHUNK, segment.CHUNK_OVERLAP), lambda c: F.transform(segment.chunk_structs(c["chunk_text"], segment.WINDOW, segment.WINDOW_OVERLAP), lambda w: F.struct((c["offset"] + w["offset"]).alias("offset"), w["chunk_text"].alias("text")))))
        # blank texts never reach the model
        given, found = fresh(df, 2, out)
        # the size beside the array makes it a column of its own: planned into the call, its nested lambdas are not extracted
        windows = df.withColumn(given, F.when(F.col("text").rlike(r"(?U)\S"), parts))
        judged = windows.withColumn(found, model(F.col(given), F.coalesce(F.size(given), F.lit(0))))
        own = F.transform(found, lambda x: S.span(S.entity_type(x["type"]), x["start"], x["end"], S.cut(F.col("text"), x["start"], x["end"]), F.lit(self.confidence), F.lit("encoder")))
        return judged.select(*df.columns, S.dedupe(own).alias(out))


def files_ready(*paths: str) -> Callable[[], bool]:
    """A readiness test: all of a model's files are there, each with some content."""
    return lambda: all(os.path.isfile(p) and os.path.getsize(p) > 0 for p in paths)


_REGISTRY: dict[str, Callable[[], Detector]] = {
    "rules_pii": lambda: RuleDetector("rules_pii", "pii", R.PII_RULES),
    "rules_injection": lambda: RuleDetector("rules_injection", "injection", R.INJECTION_RULES),
    "numbers": NumberRuleDetector,
}


def register(name: str, make: Callable[[], Detector]) -> None:
    _REGISTRY[name] = make


def detector(name: str) -> Detector:
    """F2."""
    if name not in _REGISTRY:
        raise ValueError(f"no detector {name!r}; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]()


def status() -> list[tuple[str, str, bool]]:
    """(name, kind, ready)."""
    return [(n, d.kind, d.ready()) for n in sorted(_REGISTRY) for d in [_REGISTRY[n]()]]


def contained(items: DataFrame, chunked: DataFrame, size: int = segment.CHUNK, overlap: int = segment.CHUNK_OVERLAP) -> DataFrame:
    """Spans that lie whole in a chunk, in the chunk's offsets.  The chunks that may hold a span follow from its start, so the
    interval join is an equi-join on (doc_id, chunk_index)."""
    step = max(1, size - overlap)
    first = F.greatest(F.lit(0), F.ceil((F.col("end") - size) / F.lit(step))).cast("int")
    last = F.floor(F.col("start") / F.lit(step)).cast("int")
    keyed = items.where(first <= last).withColumn("chunk_index", F.explode(F.sequence(first, last)))
    joined = keyed.join(chunked.select("doc_id", "chunk_index", "offset", F.length("chunk_text").alias("_n")), ["doc_id", "chunk_index"])
    inside = joined.where((F.col("start") >= F.col("offset")) & (F.col("end") <= F.col("offset") + F.col("_n")))
    return inside.withColumn("start", F.col("start") - F.col("offset")).withColumn("end", F.col("end") - F.col("offset")).drop("_n", "offset")


def explode_spans(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """One row a span.  The outer explode keeps the planner from deriving "the array isn't empty" and pushing that, the whole detector
    with it, below an exchange: spans would be found twice."""
    return df.select(*keys, F.posexplode_outer(spans).alias("ord", "_s")).where("ord is not null").select(*keys, "ord", "_s.*")


def hidden_text(html: Column) -> Column:
    """S1 for pages: script, style, comments and tags out, white space together."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))
