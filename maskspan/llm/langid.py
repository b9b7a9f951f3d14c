"""Language identification as multilingual mixture inference.

Each language has a model of its letters: smoothed probabilities of a byte given the two bytes before it, with a space at
either end of a word, counted over all documents that are labelled with it.  A word's likelihood in a language is the product
of its n-grams' probabilities; a document is a mixture of languages, its proportions estimated by expectation-maximisation over
its words.  The set of languages is the one of least penalised likelihood, -2 log L + PENALTY * k * log(words): starting from all
languages, the one that matters least is dropped as long as that lowers the criterion.

Defined results: a text without letters (null and empty ones too) has no language and zero words; a very long one is used whole;
equal texts have equal results; ties between languages go to the first in alphabetical order; with no labelled document there is no language;
every row is kept, also without doc_id; columns other than doc_id, text and lang are ignored; an empty table gives no rows.

Scale: a counting pass (the shuffle carries distinct n-grams a task, of a space bounded by BUCKETS), the model (BUCKETS x
languages floats) with the tasks, and a narrow inference pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import Words, chunks, fold, ranges

BUCKETS = 1 << 17
SMOOTHING = 0.1
PENALTY = 2.0
#: EM ends for a document when no share moves by more.
MOVED = 2e-3
#: Least share of a document that a language of its set has.
LEAST = 0.02


def ngrams(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, n-gram bucket of every byte of a word and of its closing space, where each word's n-grams begin)."""
    words = Words(column)
    low = fold(words.raw)
    size = words.end - words.start
    first = np.cumsum(size + 1) - (size + 1)
    total = int(size.sum() + len(size))
    letters = np.full(total + 2, 32, np.uint32)
    letters[ranges(first, size) + 2] = low[ranges(words.start, size)]
    # digits are no evidence for a language, and a word's first n-grams see spaces before it
    letters[(letters >= 48) & (letters < 58)] = 35
    one, two, three = letters[:-2], letters[1:-1], letters[2:]
    gap = two == 32
    context = np.where(gap, np.uint32(32 << 8 | 32), one << np.uint32(8) | two)
    key = (context << np.uint32(8) | three).astype(np.uint32)
    return words, (key * np.uint32(2654435761)) >> np.uint32(32 - 17), first


def _counts(batches):
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in chunks(batch, "text"):
            words, bucket, first = ngrams(part.column(1))
            langs = part.column(0).dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)
            owner = np.repeat(lang[words.doc], np.diff(np.append(first, len(bucket))))
            for k, name in enumerate(langs.dictionary.to_pylist()):
                held.setdefault(name, np.zeros(BUCKETS, np.int64))
                held[name] += np.bincount(bucket[owner == k], minlength=BUCKETS)
    for name, count in held.items():
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(count[at])], names=["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], log: np.ndarray):
        self.langs, self.log = langs, log

    def likelihoods(self, column: pa.Array) -> tuple[Words, np.ndarray]:
        """(words, log-likelihood of each word in each language, relative to the word's best language)."""
        words, bucket, first = ngrams(column)
        if not len(words):
            return words, np.zeros((0, len(self.langs)))
        log = np.column_stack([np.add.reduceat(self.log[k][bucket], first) for k in range(len(self.langs))])
        return words, log

    def infer(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, share of each language, log-likelihood) of each text."""
        words, log = self.likelihoods(column)
        count = np.diff(words.first)
        n, m = len(count), len(self.langs)
        share, total = np.zeros((n, m)), np.zeros(n)
        docs = np.flatnonzero(count)
        if not len(docs) or not m:
            return count, share, total
        top = log.max(axis=1)
        like = np.exp(np.maximum(log - top[:, None], -60)).astype(np.float32)
        offset = np.add.reduceat(top, words.first[docs])

        like = np.ascontiguousarray(like.T)

        def fit(own: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """EM for some documents (positions in docs) from the given shares; a share of 0 stays 0.  Each document has as many rounds
            as it needs, whatever its neighbours."""
            size = count[docs[own]]
            every = np.take(like, ranges(words.first[docs[own]], size), axis=1)
            out = np.ascontiguousarray(theta.T.astype(np.float32))
            place, x, now, n = np.arange(len(own)), every, out.copy(), size
            frozen = np.zeros(len(own), bool)
            while True:
                owner, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                while True:
                    part = np.take(now, owner, axis=1)
                    part *= x
                    part /= part.sum(axis=0)
                    new = np.add.reduceat(part, begin, axis=1) / n.astype(np.float32)
                    done = ~frozen & (np.abs(new - now).max(axis=0) < MOVED)
                    now = new
                    out[:, place[done]] = now[:, done]
                    frozen |= done
                    if 2 * frozen.sum() >= len(n):
                        break
                if frozen.all():
                    break
                keep = ~frozen
                place, x, now, n, frozen = place[keep], x[:, keep[owner]], now[:, keep], n[keep], frozen[keep]
            owner, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            mix = (np.take(out, owner, axis=1) * every).sum(axis=0)
            out[out < 1e-5] = 0
            return out.T.astype(float), np.add.reduceat(np.log(np.maximum(mix, 1e-38)), begin, dtype=float)

        def cost(value: np.ndarray, k: np.ndarray, own: np.ndarray) -> np.ndarray:
            return -2 * value + PENALTY * (k - 1) * np.log(count[docs[own]] + 1.0)

        # One language: no EM.  A document stays with its best one when even a perfect second language couldn't pay for itself.
        single = np.add.reduceat(np.log(like), words.first[docs], axis=1, dtype=float).T
        best = single.argmax(axis=1)
        value = single[np.arange(len(docs)), best]
        theta = np.zeros((len(docs), m))
        theta[np.arange(len(docs)), best] = 1
        # no mixture beats every word's own best language, whose relative log-likelihood is 0
        open_ = np.flatnonzero(cost(value, np.ones(len(docs)), np.arange(len(docs))) > cost(np.zeros(len(docs)), np.full(len(docs), 2), np.arange(len(docs))))
        if len(open_) and m > 1:
            now, have = fit(open_, np.full((len(open_), m), 1.0 / m))
            k = (now > 0).sum(axis=1)
            live = np.flatnonzero(k > 1)
            while len(live):
                own = live
                shares = np.where(now[own] > 0, now[own], np.inf)
                drop = shares.argmin(axis=1)
                less = now[own].copy()
                less[np.arange(len(own)), drop] = 0
                less /= less.sum(axis=1, keepdims=True)
                tried, got = fit(open_[own], less)
                better = (cost(got, k[own] - 1, open_[own]) <= cost(have[own], k[own], open_[own])) | (now[own, drop] < LEAST)
                took = own[better]
                now[took], have[took] = tried[better], got[better]
                k[took] = (now[took] > 0).sum(axis=1)
                live = took[k[took] > 1]
            wins = cost(have, k, open_) < cost(value[open_], np.ones(len(open_)), open_)
            theta[open_[wins]], value[open_[wins]] = now[wins], have[wins]
        share[docs], total[docs] = theta, value + offset
        return count, share, total


def train(docs: DataFrame) -> Model:
    _spark.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    got = rows.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    count = np.zeros((len(langs), BUCKETS))
    place = {x: k for k, x in enumerate(langs)}
    count[[place[x] for x in names], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    seen = max(1, int((count.sum(axis=0) > 0).sum())) if len(langs) else 1
    log = np.log((count + SMOOTHING) / (count.sum(axis=1, keepdims=True) + SMOOTHING * (seen + 1)))
    return Model(langs, log.astype(np.float32))


def _infer(model: Model):
    def run(batches):
        names = np.array(model.langs, object)
        for batch in batches:
            for part in chunks(batch, "text"):
                count, share, total = model.infer(part.column(1))
                kept = share > 0
                size = kept.sum(axis=1)
                # the largest share first, ties in alphabetical order
                order = np.argsort(-share, axis=1, kind="stable")
                flat = np.take_along_axis(kept, order, axis=1)
                ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                langs = pa.ListArray.from_arrays(ends, pa.array(names[order[flat]].tolist(), pa.string()))
                shares = pa.ListArray.from_arrays(ends, pa.array(np.take_along_axis(share, order, axis=1)[flat].round(4)))
                yield pa.RecordBatch.from_arrays([part.column(0), langs, shares, pa.array(count.astype(np.int32)), pa.array(total.round(3))], names=["doc_id", "langs", "shares", "words", "log_likelihood"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, langs, shares, words, log_likelihood) of every document, its languages by falling share."""
    model = train(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_infer(model), "doc_id bigint, langs array<string>, shares array<double>, words int, log_likelihood double")
