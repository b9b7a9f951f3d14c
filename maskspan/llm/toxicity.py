"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common (not necessarily contiguous) letter subsequences of length ORDER, each discounted by DECAY for
every letter it spans in either string, so an insult with gaps or inserted characters keeps most of its value.  Landmarks
are the substrings that set labelled toxic documents apart from labelled clean ones; a sentence is described by its words'
largest kernel value with each landmark, whitened by the landmarks' own kernel matrix (Nystroem), and a squared-hinge SVM
is fitted on labelled sentences.  A document is toxic when any of its sentences scores above zero.

A word is a white-space token's letters (so "id-iot" is "idiot"); neighbouring one-letter words are read as one
("i d i o t").  A word of more than SPAN letters is read in overlapping pieces of SPAN, which bounds a subsequence's span.

Training uses at most SAMPLE toxic and 3 x SAMPLE clean labelled documents (the least by a hash of doc_id); everything
else covers all documents.  Defined results: null, empty or letterless text is never toxic; without enough labelled
toxic documents no landmark is significant and nothing is toxic; repeated rows get equal verdicts; a row without doc_id
is judged like any other; columns other than doc_id and text are ignored; an empty table gives no rows.

Scale: two narrow passes over the documents (the sample, then scoring); no shuffle of texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import _BINV, _B, _power, buffers, chunks, fold, mix64, ranges

ORDER = 4
DECAY = 0.7
SPAN = 48
#: Labelled toxic documents (and a third as many as the clean ones) that the classifier is fitted on at most.
SAMPLE = 2000
MAX_LANDMARKS = 96
PRECISE = 0.9
#: Clean training documents that may be misjudged.
MISJUDGED = 0.001
#: A word whose kernel value with every landmark (relative to the landmark with itself) is below this counts as 0.
FLOOR = 0.4
#: Words of known value that a worker remembers (the others are reckoned again).
REMEMBER = 1_000_000
#: Letters that an insult may gain.
SLACK = 3

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True
_CLASS = np.arange(256, dtype=np.uint32) % 32


class Units:
    """The words of a batch of texts as slices of one buffer of folded letters."""

    def __init__(self, column: pa.Array):
        raw, offsets = buffers(column)
        low = fold(raw)
        n = len(raw)
        solid = raw > 32
        starts = solid.copy()
        if n:
            starts[1:] &= ~solid[:-1]
            inner = offsets[1:-1]
            inner = inner[inner < n]
            starts[inner] = solid[inner]
        at = np.flatnonzero(_LETTER[low])
        token = np.cumsum(starts)[at] if n else at
        self.letters = low[at]
        new = np.ones(len(at), bool)
        new[1:] = token[1:] != token[:-1]
        first = np.flatnonzero(new)
        where = at[first]
        doc = np.searchsorted(offsets, where, side="right") - 1
        size = np.diff(np.append(first, len(at)))
        points = np.add.reduceat(((self.letters & 0xC0) != 0x80).astype(np.int32), first) if len(first) else size
        single = points == 1
        joined = np.zeros(len(first), bool)
        if len(first):
            joined[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
        keep = ~joined
        self.first, self.where, self.doc = first[keep], where[keep], doc[keep]
        self.size = np.diff(np.append(self.first, len(at)))
        if (self.size > SPAN).any():
            self._cut()
        with np.errstate(over="ignore"):
            m = len(self.letters)
            sums = np.zeros(m + 1, np.uint64)
            np.cumsum((self.letters.astype(np.uint64) + np.uint64(1)) * _power(_B, "b", m), out=sums[1:])
            self.hash = mix64((sums[self.first + self.size] - sums[self.first]) * _power(_BINV, "i", m + 1)[self.first])
        self.raw, self.offsets, self.n_docs = raw, offsets, len(offsets) - 1

    def _cut(self) -> None:
        step = SPAN // 2
        pieces = np.maximum(1, -(-(self.size - SPAN) // step) + 1)
        owner = np.repeat(np.arange(len(pieces)), pieces)
        k = ranges(np.zeros(len(pieces), np.int64), pieces)
        first = self.first[owner] + k * step
        size = np.minimum(SPAN, self.first[owner] + self.size[owner] - first)
        self.first, self.size, self.where, self.doc = first, size, self.where[owner], self.doc[owner]

    def sentence(self, units: np.ndarray) -> np.ndarray:
        """A number for the sentence that each of the units lies in; equal numbers only within one document."""
        ends = np.flatnonzero(_END[self.raw])
        return np.searchsorted(np.union1d(ends, self.offsets[1:] - 1), self.where[units])

    def matrix(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letters padded with 0, lengths) of some units."""
        size = self.size[units]
        out = np.zeros((len(units), int(size.max(initial=1))), np.uint8)
        cell = ranges(np.arange(len(units)) * out.shape[1], size)
        out.ravel()[cell] = self.letters[ranges(self.first[units], size)]
        return out, size


class Landmarks:
    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.n = len(strings)
        self.width = max((len(s) for s in strings), default=1)
        self.text = np.zeros((self.n, self.width), np.uint8)
        for k, s in enumerate(strings):
            self.text[k, : len(s)] = np.frombuffer(s, np.uint8)
        self.mask = np.array([np.bitwise_or.reduce(np.uint32(1) << _CLASS[np.frombuffer(s, np.uint8)]) for s in strings], np.uint32)
        #: fewest letter classes that ORDER of the landmark's letters in order can have
        self.least = np.array([max(1, _fewest(s)) for s in strings], np.int64)
        self.match = np.zeros((self.n, 256), np.uint32)
        for k, s in enumerate(strings):
            for j, c in enumerate(s):
                self.match[k, c] |= np.uint32(1 << j)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.own = self._dp(self.text, self.sizes, self.text, np.arange(self.n)) if self.n else np.zeros(0)

    @staticmethod
    def _dp(text: np.ndarray, size: np.ndarray, targets: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The kernel of each row of text with the target of the same place in mark."""
        target = targets[mark]
        width = target.shape[1]
        gap = np.array([[DECAY ** (j - i - 1) if i < j else 0.0 for j in range(width)] for i in range(width)], np.float32)
        state = np.zeros((ORDER - 1, len(text), width), np.float32)
        total = np.zeros(len(text), np.float32)
        for c in range(int(size.max(initial=0))):
            letter = text[:, c]
            hit = (target == letter[:, None]) & (letter != 0)[:, None]
            square = np.float32(DECAY * DECAY) * hit
            total += ((state[ORDER - 2] @ gap) * square).sum(1)
            for i in range(ORDER - 2, 0, -1):
                state[i] = np.float32(DECAY) * state[i] + (state[i - 1] @ gap) * square
            state[0] = np.float32(DECAY) * state[0] + square
        return total

    def values(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, landmark, relative kernel value) of all pairs with a value of FLOOR at least."""
        if not self.n or not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        bits = np.where(text > 0, np.uint32(1) << _CLASS[text], np.uint32(0))
        mask = np.bitwise_or.reduce(bits, axis=1)
        rows, marks = [], []
        for k in range(self.n):
            r = np.flatnonzero((np.bitwise_count(mask & self.mask[k]) >= self.least[k]) & (size >= ORDER))
            rows.append(r)
            marks.append(np.full(len(r), k))
        row, mark = np.concatenate(rows), np.concatenate(marks)
        # common subsequence of ORDER letters or the kernel is 0: bit-parallel LCS
        v = np.full(len(row), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for c in range(text.shape[1]):
                m = self.match[mark, text[row, c]]
                u = v & m
                v = (v + u) | (v - u)
        valid = (np.uint64(1) << np.array([len(s) for s in self.strings], np.uint64)).astype(np.uint64) - np.uint64(1)
        keep = np.bitwise_count(~v & valid.astype(np.uint32)[mark]) >= ORDER
        row, mark = row[keep], mark[keep]
        if not len(row):
            return row, mark, np.zeros(0, np.float32)
        value = np.concatenate([self._dp(text[row[i : i + 65536]], size[row[i : i + 65536]], self.text, mark[i : i + 65536]) for i in range(0, len(row), 65536)]) / self.own[mark]
        keep = value >= FLOOR
        row, mark = row[keep], mark[keep]
        return row, mark, self._local(text, size, row, mark)

    def _local(self, text: np.ndarray, size: np.ndarray, row: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The largest cosine of the kernel between the landmark and any window of the word that is at most SLACK letters
        longer than it."""
        best = np.zeros(len(row), np.float32)
        long = self.sizes[mark]
        wide = np.pad(text, ((0, 0), (0, self.width + SLACK)))
        for extra in range(SLACK + 1):
            width = np.minimum(long + extra, size[row])
            count = np.where((extra == 0) | (width == long + extra), size[row] - width + 1, 0)
            pair = np.repeat(np.arange(len(row)), count)
            if not len(pair):
                continue
            at = ranges(np.zeros(len(row), np.int64), count)
            window = wide[row[pair][:, None], at[:, None] + np.arange(self.width + SLACK)]
            window[np.arange(self.width + SLACK) >= width[pair][:, None]] = 0
            for i in range(0, len(pair), 65536):
                p, w, n = pair[i : i + 65536], window[i : i + 65536], width[pair[i : i + 65536]]
                cross = self._dp(w, n, self.text, mark[p])
                live = np.flatnonzero(cross > FLOOR * self.own[mark[p]])
                own = self._dp(w[live], n[live], w[live], np.arange(len(live)))
                np.maximum.at(best, p[live], cross[live] / np.sqrt(np.maximum(own, 1e-30) * self.own[mark[p[live]]]))
        return best


def _fewest(s: bytes) -> int:
    from itertools import combinations

    return min((len({c % 32 for c in x}) for x in combinations(s, ORDER)), default=ORDER)


class Model:
    """Landmarks, the weights on their kernel values (the Nystroem map folded in) and the bias."""

    def __init__(self, marks: list[bytes], weights: np.ndarray, bias: float):
        self.marks, self.weights, self.bias = marks, weights.astype(np.float32), float(bias)
        self.ready = None

    def __getstate__(self):
        return self.marks, self.weights, self.bias

    def __setstate__(self, state):
        self.marks, self.weights, self.bias = state
        self.ready = None

    def features(self, units: Units, seen: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence-wise rows: document, sentence; landmark values) of every sentence with a value."""
        if self.ready is None:
            self.ready = Landmarks(self.marks)
        marks = self.ready
        value, first, back = np.unique(units.hash, return_index=True, return_inverse=True)
        known = seen.setdefault("hash", np.zeros(0, np.uint64))
        at = np.searchsorted(known, value)
        at[at == len(known)] = 0
        fresh = np.flatnonzero(known[at] != value) if len(known) else np.arange(len(value))
        rows = seen.setdefault("rows", {})
        order = fresh[np.argsort(units.size[first[fresh]], kind="stable")]
        for part in np.array_split(order, max(1, len(order) // 20000)):
            text, size = units.matrix(first[part])
            r, m, k = marks.values(text, size)
            for i, j, x in zip(value[part[r]].tolist(), m.tolist(), k.tolist()):
                rows.setdefault(i, {})[j] = x
        if len(known) < REMEMBER:
            seen["hash"] = np.union1d(known, value[fresh])
        hot = seen.get("hot")
        if hot is None or len(hot) != len(rows):
            hot = seen["hot"] = np.sort(np.fromiter(rows.keys(), np.uint64, len(rows)))
        if not len(hot):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, marks.n), np.float32)
        at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
        unit = np.flatnonzero((hot[at] == value)[back])
        if not len(unit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, marks.n), np.float32)
        sentence, inverse = np.unique(units.sentence(unit), return_inverse=True)
        out = np.zeros((len(sentence), marks.n), np.float32)
        doc = np.zeros(len(sentence), np.int64)
        doc[inverse] = units.doc[unit]
        for k, h in zip(inverse.tolist(), units.hash[unit].tolist()):
            for j, x in rows[h].items():
                if x > out[k, j]:
                    out[k, j] = x
        return doc, sentence, out

    def judge(self, column: pa.Array, seen: dict) -> tuple[np.ndarray, np.ndarray]:
        """(best sentence's score, number of toxic sentences) of each text; -1 for a text without any landmark value."""
        n = len(column)
        best, count = np.full(n, min(self.bias, -1.0)), np.zeros(n, np.int32)
        if self.marks:
            doc, _, x = self.features(Units(column), seen)
            score = x @ self.weights + self.bias
            np.maximum.at(best, doc, score)
            np.add.at(count, doc, (score > 0).astype(np.int32))
        return best, count


def _count_units(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            units = Units(part.column(1))
            toxic = part.column(0).to_numpy(zero_copy_only=False)
            h, none = units.hash, np.zeros(1, np.uint64)
            context = mix64(np.concatenate([none, h[:-1]])[: len(h)], 1) ^ mix64(np.concatenate([h[1:], none])[: len(h)], 2)
            _, pick = np.unique(mix64(h, 3) ^ context, return_index=True)
            pick = pick[units.size[pick] >= ORDER]
            if len(pick):
                whole = units.letters.tobytes()
                words = [whole[a : a + s] for a, s in zip(units.first[pick].tolist(), units.size[pick].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(context[pick].view(np.int64)), pa.array(toxic[units.doc[pick]].astype(np.int32))], names=["unit", "context", "toxic"])


def choose_landmarks(words: list[bytes], toxic: np.ndarray, clean: np.ndarray, ratio: float = 1.0) -> list[bytes]:
    """Substrings of 4 to 12 letters that set toxic documents apart, chosen greedily: the one in most toxic contexts
    (the longest of near equals) first, then again among the words that have none yet.  ratio: how many times rarer clean
    documents are among these than among all labelled ones; with one clean context more than was seen, PRECISE of a landmark's
    contexts must be toxic, so that a chance find condemns nobody."""
    left = np.ones(len(words), bool)
    chosen: list[bytes] = []
    if not toxic.sum() or not clean.sum():
        return chosen
    prior = toxic.sum() / (toxic.sum() + clean.sum())
    text = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    tables = []
    with np.errstate(over="ignore"):
        for length in range(ORDER, 13):
            count = np.maximum(0, size - length + 1)
            at = ranges(first, count)
            owner = np.repeat(np.arange(len(words)), count)
            h = np.zeros(len(at), np.uint64)
            for j in range(length):
                h = h * np.uint64(1_000_003) + text[at + j] + np.uint64(1)
            _, id_ = np.unique(mix64(h, length), return_inverse=True)
            t = np.bincount(id_, toxic[owner])
            c = np.bincount(id_, clean[owner])
            good = (t >= 3) & (t >= PRECISE * (t + ratio * (c + 1)))
            hit = good[id_]
            tables.append((length, at[hit], owner[hit], id_[hit]))
    total = sum(len(t[1]) for t in tables)
    need = 2 * math.log(max(2, total)) / -math.log(prior)
    while len(chosen) < MAX_LANDMARKS:
        best = None
        for length, at, owner, id_ in tables:
            live = left[owner]
            if not live.any():
                continue
            score = np.bincount(id_[live], toxic[owner[live]])
            k = int(score.argmax())
            if score[k] >= need and (best is None or score[k] >= 0.95 * best[0]):
                where = np.flatnonzero(live & (id_ == k))
                best = (float(score[k]), bytes(text[at[where[0]] : at[where[0]] + length].astype(np.uint8)), np.unique(owner[where]))
        if best is None:
            break
        chosen.append(best[1])
        left[best[2]] = False
    return sorted(set(chosen))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, gram: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton's method, classes weighted to equal mass, in the Nystroem space gram^-1/2 x; weights are
    returned in the space of x."""
    values, vectors = np.linalg.eigh(gram.astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3 * values.max()))) @ vectors.T
    z = np.hstack([x.astype(float) @ root, np.ones((len(x), 1))])
    mass = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    penalty = np.append(np.full(z.shape[1] - 1, ridge), 1e-9)
    loss = lambda v: (mass * np.maximum(0, 1 - y * (z @ v)) ** 2).sum() + (penalty * v * v).sum()
    w = np.zeros(z.shape[1])
    for _ in range(60):
        slack = 1 - y * (z @ w)
        live = slack > 0
        grad = -2 * z[live].T @ (mass * slack * y)[live] + 2 * penalty * w
        step = np.linalg.solve(2 * (z[live].T * mass[live]) @ z[live] + 2 * np.diag(penalty), grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now - 0.1 * size * (grad @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return root @ w[:-1], float(w[-1])


def _sample_features(model: Model):
    def run(batches):
        seen: dict = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, _, x = model.features(Units(part.column(1)), seen)
                if len(doc):
                    toxic = part.column(0).to_numpy(zero_copy_only=False)[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(toxic.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), part.column(2).take(pa.array(doc))], names=["toxic", "x", "key"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on labelled documents; (doc_id, toxic) labels, a document labelled both ways counts as toxic."""
    _spark.bound_batches(docs.sparkSession)
    clear = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    size = dict(clear.distinct().groupBy("toxic").agg(F.count("*")).collect())
    ratio = size.get(0, 0) / max(1, size.get(1, 0))
    # The least hashes of each class: a bounded sample, so a bounded broadcast.
    pick = lambda t, n: clear.where(F.col("toxic") == t).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, sample).unionByName(pick(0, 3 * sample)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Columns of the sample get names of their own: the documents may have columns called toxic too.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen.select(F.col("doc_id").alias("d"), F.col("toxic").alias("y"))), "d")
    rows = rows.select(F.col("y").alias("toxic"), "text", F.xxhash64("text").alias("key")).persist()
    try:
        n = dict(rows.groupBy("toxic").count().collect())
        n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
        if not n_toxic or not n_clean:
            return Model([], np.zeros(0), -1.0)
        # Copies of one document repeat each word in one context; contexts, not documents, are independent evidence.
        contexts = rows.mapInArrow(_count_units, "unit binary, context bigint, toxic int").groupBy("unit", "context").agg(F.min("toxic").alias("toxic"))
        counts = contexts.groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).toArrow()
        words = counts.column("unit").to_pylist()
        marks = choose_landmarks(words, counts.column("t").to_numpy().astype(float), counts.column("c").to_numpy().astype(float), max(1.0, ratio * n_toxic / n_clean))
        if not marks:
            return Model([], np.zeros(0), -1.0)
        got = rows.mapInArrow(_sample_features(Model(marks, np.zeros(len(marks)), -1.0)), "toxic int, x binary, key bigint").toArrow()
    finally:
        rows.unpersist()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, len(marks))
    y = got.column("toxic").to_numpy()
    all_x, clean, keys = x, y == 0, got.column("key").to_numpy()
    # A toxic document's sentence counts as labelled toxic when it holds a landmark whole; its other sentences tell nothing.
    use = (y == 0) | (x.max(axis=1, initial=0) >= 0.99)
    rows = np.unique(np.column_stack([x[use], np.where(y[use] > 0, 1, -1)]), axis=0)
    known = Landmarks(marks)
    # The landmarks with one letter put in, at a small cost, so that an insult's tolerance is wide unless clean words forbid it.
    gapped = [s[:i] + b"~" + s[i:] for s in marks for i in range(2, len(s) - 1)]
    gram, soft = (_dense(known, strings) for strings in (marks, gapped))
    x = np.vstack([rows[:, :-1], np.zeros((1, len(marks))), soft])
    y = np.concatenate([rows[:, -1], [-1], np.ones(len(soft))])
    cost = np.concatenate([np.ones(len(rows) + 1), np.full(len(soft), 0.2)])
    # A clean document that is condemned weighs more than a toxic sentence that is missed.
    cost[: len(rows)][rows[:, -1] < 0] = 10
    weights, bias = fit_svm(x, y, cost, (gram + gram.T) / 2 + 1e-6 * np.eye(len(marks)))
    _, place = np.unique(keys[clean], return_inverse=True)
    worst = np.full(place.max(initial=-1) + 1, -1.0)
    np.maximum.at(worst, place, all_x[clean] @ weights + bias)
    # and the bias gives way until no more than MISJUDGED of the clean documents (n_clean with those of no value) score above 0
    spare = int(MISJUDGED * n_clean)
    worst = np.sort(worst)[::-1]
    if len(worst) > spare and worst[spare] > 0:
        bias -= float(worst[spare]) + 1e-6
    return Model(marks, weights, bias)


def _dense(known: Landmarks, strings: list[bytes]) -> np.ndarray:
    """The kernel values of some words with all landmarks."""
    text = np.zeros((len(strings), max((len(s) for s in strings), default=1)), np.uint8)
    for k, s in enumerate(strings):
        text[k, : len(s)] = np.frombuffer(s, np.uint8)
    out = np.zeros((len(strings), known.n))
    r, m, k = known.values(text, np.array([len(s) for s in strings], np.int64))
    out[r, m] = k
    return out


def _flag(model: Model):
    def run(batches):
        seen: dict = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                score, count = model.judge(part.column(1), seen)
                keep = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(score[keep].round(4)), pa.array(count[keep])], names=["doc_id", "score", "toxic_sentences"])

    return run


def toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, toxic_sentences) of every toxic document."""
    model = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_flag(model), "doc_id bigint, score double, toxic_sentences int")


def _keep(model: Model, column: int):
    def run(batches):
        seen: dict = {}
        for batch in batches:
            for part in chunks(batch, batch.schema.field(column).name):
                _, count = model.judge(part.column(column), seen)
                yield part.filter(pa.array(count == 0))

    return run


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents without the toxic ones, all columns as they were: one narrow pass, no join."""
    model = train(docs, labels, sample)
    return docs.mapInArrow(_keep(model, docs.columns.index("text")), docs.schema)
