"""The classifiers' own arithmetic on given arrays: token features, classifier heads, feature extraction.  Weights are arguments (none are
shipped); a batch of rows is one matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import col


def token_features(hits: Column | str, tokens: Column | str, labels: list[str]) -> Column:
    """array<array<double>>, tokens x labels: 1 where a hit (struct label, start, end) of the label overlaps the token (struct
    start, end); empty tokens have none."""
    one = lambda o, name: F.exists(col(hits), lambda h: (h["label"] == name) & (h["start"] < o["end"]) & (h["end"] > o["start"]) & (o["end"] > o["start"])).cast("double")
    return F.transform(col(tokens), lambda o: F.array(*(one(o, name) for name in labels)))


def compact(rows: Column | str, mask: Column | str) -> Column:
    """The rows whose mask is set, in order."""
    return F.transform(F.filter(F.arrays_zip(col(rows).alias("r"), col(mask).alias("m")), lambda x: x["m"]), lambda x: x["r"])


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.array([np.asarray(r, float) for r in x]) for x in column])


def token_logits(hidden: Column | str, features: Column | str, project: tuple[np.ndarray, np.ndarray], classify: tuple[np.ndarray, np.ndarray]) -> Column:
    """[hidden ; features P + p] C + c for every token: array<array<double>>.  All tokens of a batch go through one product."""
    (pw, pb), (cw, cb) = project, classify

    @F.pandas_udf("array<array<double>>")
    def run(states: pd.Series, feats: pd.Series) -> pd.Series:
        sizes = [0 if x is None else len(x) for x in states]
        if not sum(sizes):
            return pd.Series([None if x is None else [] for x in states], dtype=object)
        h, f = (np.array([np.asarray(r, float) for x in column if x is not None for r in x]) for column in (states, feats))
        logits = np.hstack([h, f @ pw + pb]) @ cw + cb
        ends = np.cumsum(sizes)
        return pd.Series([None if x is None else list(logits[b - n : b]) for x, n, b in zip(states, sizes, ends)], dtype=object)

    return run(col(hidden), col(features))


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps)


def gelu(x: np.ndarray) -> np.ndarray:
    """The exact one; erf by Abramowitz and Stegun 7.1.26, to 1.5e-7."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return 0.5 * x * (1 + np.sign(x) * erf)


def mlp(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], last: bool) -> np.ndarray:
    """Layer norm, then linear layers with GELU between them, and after the last unless it gives the logits."""
    x = layer_norm(x)
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if not last or k + 1 < len(layers):
            x = gelu(x)
    return x


def hybrid_head(pairs: Column | str, hidden: Column | str | None, weights: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Column:
    """Logits from attention pairs (array of vectors, averaged after their encoder) and, if given, a hidden vector with its own
    encoder; weights: attention, hidden, classifier."""
    with_hidden = hidden is not None

    @F.pandas_udf("array<double>")
    def run(many: pd.Series, one: pd.Series, _: pd.Series) -> pd.Series:
        live = [k for k, x in enumerate(many) if x is not None and len(x)]
        out: list = [None] * len(many)
        if live:
            sizes = [len(many.iloc[k]) for k in live]
            flat = np.array([np.asarray(r, float) for k in live for r in many.iloc[k]])
            a = np.add.reduceat(mlp(flat, weights["attention"], False), np.cumsum([0, *sizes[:-1]]), axis=0) / np.array(sizes)[:, None]
            if with_hidden:
                a = np.hstack([a, mlp(np.array([np.asarray(one.iloc[k], float) for k in live]), weights["hidden"], False)])
            for k, row in zip(live, mlp(a, weights["classifier"], True)):
                out[k] = row
        return pd.Series(out, dtype=object)

    # the size makes the hidden vector a column of its own before the call
    other = col(hidden) if with_hidden else col(pairs)
    return run(col(pairs), other, F.size(other))


def segment_means(rows: Column | str, parts: int = 3) -> Column:
    """The means of `parts` even segments of an array of vectors (bounds rounded half to even, each at least one wide), then the last
    vector: one flat array."""
    from .segment import even_bounds

    r = col(rows)
    width = F.size(F.get(r, F.lit(0)))
    mean = lambda b: F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.aggregate(F.slice(r, b["start"] + 1, b["end"] - b["start"]), F.lit(0.0), lambda a, x: a + F.get(x, j).cast("double")) / F.size(F.slice(r, b["start"] + 1, b["end"] - b["start"])))
    means = F.flatten(F.transform(even_bounds(F.size(r), parts), mean))
    return F.when(F.size(r) > 0, F.concat(means, F.transform(F.element_at(r, -1), lambda x: x.cast("double"))))


def standardize(values: Column | str, mean: list[float], deviation: list[float]) -> Column:
    """Z-scores against given statistics."""
    return F.zip_with(F.zip_with(col(values), F.array(*(F.lit(float(m)) for m in mean)), lambda x, m: x - m), F.array(*(F.lit(float(d)) for d in deviation)), lambda x, d: x / d)


def sample_pairs(rows: Column | str, seed: Column | str, n: int) -> Column:
    """N rows drawn with a seed a document, with replacement only where there are fewer than n, in their own order."""

    @F.pandas_udf("array<array<double>>")
    def run(many: pd.Series, seeds: pd.Series) -> pd.Series:
        out = []
        for x, s in zip(many, seeds):
            if x is None or not len(x) or s is None:
                out.append(None)
                continue
            pick = np.sort(np.random.default_rng(int(s)).choice(len(x), size=n, replace=len(x) < n))
            out.append([np.asarray(x[k], float) for k in pick])
        return pd.Series(out, dtype=object)

    return run(col(rows), col(seed))
