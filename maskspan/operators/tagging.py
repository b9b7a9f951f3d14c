"""Sequence tagging: constrained Viterbi decoding and entities from tags, as functions of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ILLEGAL = -10_000.0


def tag_names(labels: list[str]) -> list[str]:
    return ["O", *(f"{p}-{x}" for x in labels for p in "BI")]


def bio_constraints(tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start, transition) scores: an I- may only follow a B- or I- of its label."""
    inside = np.array([t[:2] == "I-" for t in tags])
    label = np.array([t[2:] for t in tags])
    start = np.where(inside, ILLEGAL, 0.0)
    fits = (label[:, None] == label[None, :]) & (np.array(tags) != "O")[:, None]
    return start, np.where(inside[None, :] & ~fits, ILLEGAL, 0.0)


def viterbi(emissions: np.ndarray, start: np.ndarray, transition: np.ndarray, end: np.ndarray | None = None) -> list[int]:
    """The best path; of equals the lower tag."""
    if not len(emissions):
        return []
    score, back = start + emissions[0], []
    for e in emissions[1:]:
        every = score[:, None] + transition
        back.append(every.argmax(axis=0))
        score = every.max(axis=0) + e
    if end is not None:
        score = score + end
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def log_likelihood(emissions: np.ndarray, tags: list[int], start: np.ndarray, transition: np.ndarray) -> float:
    """Log of the path's probability: its score less the partition function."""
    gold = start[tags[0]] + emissions[0][tags[0]] + sum(transition[a, b] + e[b] for a, b, e in zip(tags, tags[1:], emissions[1:]))
    alpha = start + emissions[0]
    for e in emissions[1:]:
        every = alpha[:, None] + transition
        top = every.max(axis=0)
        alpha = top + np.log(np.exp(every - top).sum(axis=0)) + e
    top = alpha.max()
    return float(gold - (top + np.log(np.exp(alpha - top).sum())))


def viterbi_batch(many: list[np.ndarray], start: np.ndarray, transition: np.ndarray) -> list[list[int]]:
    """D10 for sequences of any lengths at a time: one step of all sequences is one numpy operation; ended ones keep their state."""
    size = np.array([len(m) for m in many], np.int64)
    if not size.sum():
        return [[] for _ in many]
    n, k = int(size.max()), transition.shape[0]
    padded = np.zeros((len(many), n, k))
    padded[np.arange(n)[None, :] < size[:, None]] = np.concatenate([m.reshape(-1, k) for m in many])
    score, same = start + padded[:, 0], np.arange(k)
    back = np.empty((len(many), n, k), np.int32)
    for t in range(1, n):
        every = score[:, :, None] + transition
        live = (t < size)[:, None]
        back[:, t] = np.where(live, every.argmax(axis=1), same)
        score = np.where(live, every.max(axis=1) + padded[:, t], score)
    path = np.empty((len(many), n), np.int64)
    path[:, -1] = score.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[np.arange(len(many)), t, path[:, t]]
    return [p[:m].tolist() for p, m in zip(path, size.tolist())]


#: Sequences that are decoded at a time, which bounds the padded arrays.
BATCH = 256


def decode(emissions: Column | str, labels: list[str]) -> Column:
    """D10 for a column array<array<double>> of words x tags -> array<string>."""
    tags = tag_names(labels)
    start, transition = bio_constraints(tags)

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        live = [k for k, m in enumerate(column) if m is not None]
        # sequences of like length share a batch
        live.sort(key=lambda k: len(column.iloc[k]))
        out: list = [None] * len(column)
        for at in range(0, len(live), BATCH):
            own = live[at : at + BATCH]
            for k, path in zip(own, viterbi_batch([np.array([list(r) for r in column.iloc[k]], float).reshape(-1, len(tags)) for k in own], start, transition)):
                out[k] = [tags[x] for x in path]
        return pd.Series(out, dtype=object)

    return run(emissions)


def entities(text: str, tags: list[str]) -> list[tuple[str, int, int]]:
    """(label, start, end) from a tag a character; spaces inside an entity are bridged when an I- of its label follows."""
    out, at = [], 0
    while at < len(tags):
        tag = tags[at]
        if tag[:2] not in ("B-", "I-"):
            at += 1
            continue
        label, stop = tag[2:], at + 1
        while stop < len(tags):
            if tags[stop] == f"I-{label}":
                stop += 1
                continue
            ahead = stop
            while ahead < len(tags) and text[ahead] == " " and tags[ahead] == "O":
                ahead += 1
            if ahead == stop or ahead >= len(tags) or tags[ahead] != f"I-{label}":
                break
            stop = ahead + 1
        out.append((label, at, stop))
        at = stop
    return out


def entity_column(text: Column | str, tags: Column | str) -> Column:
    @F.pandas_udf("array<struct<label:string,start:int,end:int>>")
    def run(texts: pd.Series, all_tags: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or g is None else [{"label": a, "start": b, "end": c} for a, b, c in entities(t, list(g))] for t, g in zip(texts, all_tags)])

    return run(text, tags)


def merge_addresses(items: Column, text: Column, label: str = "LC_ADDRESS") -> Column:
    """Neighbouring addresses with nothing but spaces between them become one."""
    from ..functions.spans import cut, let, span

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (last["type"] == label) & (x["type"] == label) & cut(text, last["end"], x["start"]).rlike("^ +$")
        both = span(last["type"], last["start"], x["end"], cut(text, last["start"], x["end"]), last["confidence"], last["source"])
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    return let(items, lambda v: F.aggregate(v, F.filter(v, lambda x: F.lit(False)), step))


def word_spans(tokens):
    """(doc_id, word_id, start, end) tokens -> one row a word."""
    return tokens.groupBy("doc_id", "word_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
