"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are normalised words.  The CGK embedding walks over a window: at step j it writes the symbol under the pointer and moves
on by a random bit that is a function of (j, symbol).  Windows at a small edit distance fall back into step with each other, so
they agree in many places, and a few sampled places are an LSH key.  A word's symbol is its first letters in half of the walks and its
last ones in the others, so that a changed letter leaves one of them as it was.  Items are put in CLASSES by their number of words;
a class's windows have fewer words than its least item, so that each item has several.  Documents are embedded at every stride-th word
and items at every word, so some document window begins exactly where an item window does.  WALKS walks a kind with SAMPLES keys of
PLACES places each make a candidate of an item and a place where AGREE keys collide.  Of items of 15 to 60 words within MAX_EDITS, with
single letters edited in 5, 10, 15 and 20 % of the places, 1.00, 0.99, 0.97 and 0.88 are found, with whole words edited more.

Candidates are verified exactly: the least edit distance, in characters of the normalised words, between the item and any part of the
aligned region must not exceed MAX_EDITS of the item's length.  Before that an item is cut into pieces of up to 64 letters: when none of
them is within MAX_EDITS of its own length around its place, the item can't be (one piece must have its share of the edits or fewer), and
this test runs for thousands of candidates at a time.  Items of 2 to MIN_ITEM_WORDS - 1 words match where their words occur as they are.

Defined results: null and empty texts hold nothing; items of one word (empty and null ones too) can't be told from chance and match
nothing; repeated documents or items give repeated rows; ties don't arise (every match is reported, the least distance of each); a
document without doc_id is judged, its rows have a null doc_id; other columns are ignored; an empty table on either side gives no rows.

Scale: one narrow pass over the documents, no shuffle.  The items' keys travel with the tasks, SLICE_BYTES of item text at a time: a
benchmark beyond that takes a further pass for each slice; the driver holds the texts of all slices, so a benchmark has to fit there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import Words, chunks, fold, mix64, ranges

#: Items of fewer words are found verbatim.
MIN_ITEM_WORDS = 5
#: (least words of an item, words of a window, distance of a document's windows) of each class.
CLASSES = ((MIN_ITEM_WORDS, 3, 1), (15, 8, 2))
#: Bytes at a word's either end that make a symbol.
ENDS = 3
WALKS = 2
SAMPLES = 8
PLACES = 6
#: Steps of a walk for a word of a window.
STEPS = 1.6
#: Keys that agree on a place, to so many words, before it is a candidate.
AGREE, APART = 3, 6
MAX_EDITS = 0.2
SLICE_BYTES = 1 << 20
#: Candidates' pieces that are compared at a time.
LANES = 4096
#: Letters that agreeing words can be out of step.
STEP_SLACK = 20


def symbols(words: Words, low: np.ndarray, last: bool) -> np.ndarray:
    """A 64-bit symbol of every word: its first ENDS bytes, or its last ones."""
    out = np.full(len(words), 1 if last else 2, np.uint64)
    size = words.end - words.start
    for k in range(ENDS):
        at = words.end - 1 - k if last else words.start + k
        letter = np.where(size > k, low[np.clip(at, 0, max(0, len(low) - 1))], 0) if len(low) else out
        out = (out << np.uint64(8)) | letter.astype(np.uint64)
    return mix64(out, 77)


def embed(symbol: np.ndarray, starts: np.ndarray, window: int, kind: int) -> list[np.ndarray]:
    """The LSH keys (one array a walk and sample) of the windows that begin at the given words."""
    steps = max(PLACES, int(STEPS * window))
    padded = np.concatenate([symbol, np.zeros(steps + 1, np.uint64)])
    starts = starts.astype(np.int64)
    out = []
    for walk in range(WALKS):
        rng = np.random.default_rng(1000 * window + 10 * walk + kind)
        places = [np.sort(rng.choice(steps, PLACES, replace=False)) for _ in range(SAMPLES)]
        pos, seen = starts.copy(), []
        for j in range(steps):
            if j % 64 == 0:
                bits = mix64(padded, 50 + walk * 1000 + kind * 500 + j // 64)
            if j % 8 == 0:
                byte = (bits >> np.uint64(j % 64)).astype(np.uint8)
            value = padded[pos]
            value[pos - starts >= window] = 0
            seen.append(value)
            pos += (byte[pos] >> np.uint8(j % 8)) & np.uint8(1)
        for s, at in enumerate(places):
            key = np.full(len(starts), 77 + (kind * WALKS + walk) * SAMPLES + s, np.uint64)
            with np.errstate(over="ignore"):
                for j in at.tolist():
                    key *= np.uint64(0xD6E8FEB86659FD93)
                    key += seen[j]
                    key ^= key >> np.uint64(29)
                key *= np.uint64(0xBF58476D1CE4E5B9)
            out.append(key)
    return out


#: A byte's code in the pieces' tables: letters and digits have one each, other bytes share some; 0 is no byte.
_CODE = np.zeros(256, np.uint8)
_CODE[97:123], _CODE[48:58], _CODE[32] = np.arange(1, 27), np.arange(27, 37), 37
_CODE[128:] = 38 + np.arange(128) % 26


class Letters:
    """The words of a batch in lower case with a space after each, as codes and bytes, and where each begins."""

    def __init__(self, words: Words, low: np.ndarray):
        size = words.end - words.start
        self.at = np.append(0, np.cumsum(size + 1))
        self.text = np.full(int(self.at[-1]), 32, np.uint8)
        self.text[ranges(self.at[:-1], size)] = low[ranges(words.start, size)]
        self.code = _CODE[self.text]


def near_pieces(table: np.ndarray, piece: np.ndarray, size: np.ndarray, most: np.ndarray, code: np.ndarray, lo: np.ndarray, steps: int) -> np.ndarray:
    """Whether the piece of each lane (its row in the table, its letters) is within `most` edits of a part of code[lo:lo + steps]:
    Myers' bit-parallel search, a step for all lanes at a time."""
    n = len(piece)
    flat, code = table.ravel(), np.append(code, np.zeros(steps + 1, np.uint8))
    row, at, one = piece.astype(np.int64) * 64, lo.astype(np.int64), np.uint64(1)
    top = (size - 1).astype(np.uint64)
    minus, plus = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
    score, best = size.astype(np.int64), size.astype(np.int64)
    here, eq, x, d, up = (np.empty(n, t) for t in (np.int64, np.uint64, np.uint64, np.uint64, np.uint64))
    for _ in range(steps):
        np.add(row, code[at], out=here)
        np.take(flat, here, out=eq)
        at += 1
        np.bitwise_or(eq, minus, out=x)
        np.bitwise_and(eq, plus, out=d)
        d += plus
        d ^= plus
        d |= x
        np.bitwise_or(d, plus, out=up)
        np.invert(up, out=up)
        up |= minus
        plus &= d
        # up and plus: where the distance grows and falls along the text
        np.right_shift(up, top, out=eq)
        eq &= one
        score += eq.view(np.int64)
        np.right_shift(plus, top, out=eq)
        eq &= one
        score -= eq.view(np.int64)
        np.minimum(best, score, out=best)
        up <<= one
        plus <<= one
        np.bitwise_and(up, x, out=minus)
        x |= up
        np.invert(x, out=x)
        plus |= x
    return best <= most


def least_distance(item: bytes, region: bytes) -> int:
    """The least edit distance between the item and any part of the region (Myers' bit-parallel algorithm)."""
    if item in region:
        return 0
    m = len(item)
    table: dict[int, int] = {}
    for i, c in enumerate(item):
        table[c] = table.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in region:
        eq = table.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        hp, hn = minus | ~(d | plus) & full, plus & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        plus = (hn << 1 | ~(x | hp)) & full
        minus = hp & x
        best = min(best, score)
    return best


class Index:
    """The items of a slice: their words, their windows' keys by class, and their pieces."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.large_string()))
        low = fold(words.raw)
        sizes = np.diff(words.first)
        letters = Letters(words, low)
        self.ids = np.array([-1 if i is None else i for i in ids], np.int64)
        self.sizes = sizes
        self.word_at = letters.at - np.append(np.repeat(letters.at[words.first[:-1]], sizes), 0)
        self.first = words.first
        self.text = [letters.text[letters.at[a] : max(letters.at[a], letters.at[b] - 1)].tobytes() for a, b in zip(words.first, words.first[1:])]
        self.classes = []
        edges = [*CLASSES, (np.inf, 0, 0)]
        for k, (least, window, stride) in enumerate(CLASSES):
            own = np.flatnonzero((sizes >= least) & (sizes < edges[k + 1][0]))
            if not len(own):
                continue
            count = sizes[own] - window + 1
            offset = ranges(np.zeros(len(own), np.int64), count)
            item = np.repeat(own, count)
            tables = []
            for kind in (0, 1):
                for key in embed(symbols(words, low, kind == 1), words.first[item] + offset, window, kind):
                    order = np.argsort(key, kind="stable")
                    shift = np.uint64(64 - min(21, max(16, int(len(key)).bit_length() + 3)))
                    bloom = np.zeros(1 << int(64 - shift), bool)
                    bloom[(key >> shift).astype(np.int64)] = True
                    tables.append((key[order], item[order].astype(np.int32), offset[order].astype(np.int32), bloom, shift))
            self.classes.append((window, stride, tables))
        #: verbatim items by their number of words: sorted hashes, items
        self.short = []
        for n in range(2, MIN_ITEM_WORDS):
            own = np.flatnonzero(sizes == n)
            if len(own):
                value, at = words.shingles(n)
                key = value[np.searchsorted(at, words.first[own])]
                order = np.argsort(key, kind="stable")
                self.short.append((n, key[order], own[order]))
        # pieces of 64 letters at most, of one size but for a letter
        size = np.array([len(t) for t in self.text], np.int64)
        self.most = (MAX_EDITS * size).astype(np.int64)
        self.n_pieces = np.where(sizes >= MIN_ITEM_WORDS, -(-size // 64), 0)
        self.piece = np.append(0, np.cumsum(self.n_pieces))
        item = np.repeat(np.arange(len(size)), self.n_pieces)
        turn = np.arange(len(item)) - self.piece[item]
        self.piece_at = turn * size[item] // self.n_pieces[item]
        self.piece_size = (turn + 1) * size[item] // self.n_pieces[item] - self.piece_at
        self.table = np.zeros((len(item), 64), np.uint64)
        at = letters.at[words.first[:-1]][item] + self.piece_at
        for j in range(64):
            own = np.flatnonzero(self.piece_size > j)
            self.table[own, letters.code[at[own] + j]] |= np.uint64(1) << np.uint64(j)

    def candidates(self, words: Words, low: np.ndarray) -> np.ndarray:
        """(document, item, document word, item word) of the places where AGREE keys collide."""
        count = np.diff(words.first)
        out = [np.zeros((0, 4), np.int64)]
        kinds = [symbols(words, low, last) for last in (False, True)]
        for window, stride, tables in self.classes:
            n = np.maximum(0, (count - window) // stride + 1)
            start = np.repeat(words.first[:-1], n) + ranges(np.zeros(len(n), np.int64), n) * stride
            # the last window of a document needs no stride
            rest = np.flatnonzero(n > 0)
            last = words.first[rest + 1] - window
            start = np.concatenate([start, last[(count[rest] - window) % stride > 0]])
            found = [np.zeros((0, 4), np.int64)]
            for kind in (0, 1):
                half = tables[kind * WALKS * SAMPLES : (kind + 1) * WALKS * SAMPLES]
                for key, (keys, items, offsets, bloom, shift) in zip(embed(kinds[kind], start, window, kind), half):
                    hit = np.flatnonzero(bloom[(key >> shift).astype(np.int64)])
                    lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                    live = hi > lo
                    hit, lo, hi = hit[live], lo[live], hi[live]
                    at = ranges(lo, hi - lo)
                    begin = np.repeat(start[hit], hi - lo)
                    found.append(np.column_stack([words.doc[begin], items[at], begin, offsets[at]]))
            rows = np.concatenate(found)
            place = rows[:, 2] - rows[:, 3]
            rows = rows[np.lexsort((place, rows[:, 1], rows[:, 0]))]
            place = rows[:, 2] - rows[:, 3]
            j = AGREE - 1
            agree = np.zeros(len(rows), bool)
            agree[j:] = (rows[j:, 0] == rows[: len(rows) - j, 0]) & (rows[j:, 1] == rows[: len(rows) - j, 1]) & (place[j:] - place[: len(rows) - j] <= APART)
            rows, place = rows[agree], place[agree]
            # one of those that agree on a place
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]) | (place[1:] // 3 != place[:-1] // 3)
            out.append(rows[new])
        return np.concatenate(out)

    def plausible(self, rows: np.ndarray, words: Words, letters: Letters) -> np.ndarray:
        """Whether a piece of the candidate's item is near its place.  On one side of the agreeing words at least, edits are no more than
        MAX_EDITS of the letters; there a piece has its share or fewer with no more than that before and in it, which bounds how far it
        is moved."""
        item = rows[:, 1]
        n = self.n_pieces[item]
        lane = np.repeat(np.arange(len(rows)), n)
        piece = ranges(self.piece[item], n)
        anchor = self.word_at[self.first[item] + rows[:, 3]][lane]
        a, size = self.piece_at[piece], self.piece_size[piece]
        reach = (MAX_EDITS * np.maximum(np.abs(a - anchor), np.abs(a + size - anchor))).astype(np.int64) + STEP_SLACK
        a = letters.at[rows[:, 2]][lane] - anchor + a
        lo, hi = letters.at[words.first[rows[:, 0]]][lane], letters.at[words.first[rows[:, 0] + 1]][lane]
        begin, end = np.clip(a - reach, lo, hi), np.clip(a + size + reach, lo, hi)
        out = np.zeros(len(rows), bool)
        order = np.argsort(end - begin, kind="stable")
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            near = near_pieces(self.table, piece[own], size[own], (MAX_EDITS * size[own]).astype(np.int64), letters.code, begin[own], int((end - begin)[own[-1]]))
            out[lane[own[near]]] = True
        return out

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, distance) of every verified match."""
        words = Words(column)
        low = fold(words.raw)
        best: dict[tuple[int, int], int] = {}
        letters = Letters(words, low)
        for n, keys, items in self.short:
            value, at = words.shingles(n)
            lo, hi = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
            hit = np.flatnonzero(hi > lo)
            for a, k in zip(np.repeat(at[hit], (hi - lo)[hit]).tolist(), items[ranges(lo[hit], (hi - lo)[hit])].tolist()):
                if letters.text[letters.at[a] : letters.at[a + n] - 1].tobytes() == self.text[k]:
                    best[int(words.doc[a]), k] = 0
        rows = self.candidates(words, low)
        rows = rows[self.plausible(rows, words, letters)]
        done: set[tuple[int, int, int]] = set()
        for doc, item, begin, offset in rows.tolist():
            if best.get((doc, item)) == 0:
                continue
            aligned, size = begin - offset, int(self.sizes[item])
            slack = max(2, size // 4)
            lo, hi = max(int(words.first[doc]), aligned - slack), min(int(words.first[doc + 1]), aligned + size + slack)
            # the aligned starts of one true match differ by its edits: one region for all of them
            if (doc, item, aligned // slack) in done:
                continue
            done.add((doc, item, aligned // slack))
            distance = least_distance(self.text[item], letters.text[letters.at[lo] : letters.at[hi] - 1].tobytes())
            if distance <= MAX_EDITS * len(self.text[item]):
                best[doc, item] = min(distance, best.get((doc, item), distance))
        return [(d, i, x) for (d, i), x in best.items()]


class _Slice:
    """A slice of the benchmark as it travels to the workers; each worker builds the index once."""

    ready: dict[str, Index] = {}

    def __init__(self, ids: list[int], texts: list[str]):
        import hashlib

        self.ids, self.texts = ids, texts
        self.key = hashlib.sha1(repr((ids, texts)).encode()).hexdigest()

    def index(self) -> Index:
        if self.key not in _Slice.ready:
            _Slice.ready.clear()
            _Slice.ready[self.key] = Index(self.ids, self.texts)
        return _Slice.ready[self.key]


def slices(benchmark: DataFrame, limit: int = SLICE_BYTES):
    """The benchmark in slices of about `limit` bytes of text, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id").collect() if total else []
        if part:
            yield _Slice([r[0] for r in part], [r[1] for r in part])


def _find(part: _Slice):
    def run(batches):
        index = part.index()
        for batch in batches:
            for piece in chunks(batch, "text"):
                rows = index.matches(piece.column(1))
                doc, item, distance = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc)), pa.array(index.ids[item]), pa.array(distance.astype(np.int32))], names=["doc_id", "item_id", "distance"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance) of every document that holds a benchmark item."""
    _spark.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = "doc_id bigint, item_id bigint, distance int"
    out = None
    for part in slices(benchmark):
        found = rows.mapInArrow(_find(part), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _clean(part: _Slice, column: int):
    def run(batches):
        index = part.index()
        for batch in batches:
            for piece in chunks(batch, batch.schema.field(column).name):
                keep = np.ones(piece.num_rows, bool)
                keep[[r[0] for r in index.matches(piece.column(column))]] = False
                yield piece.filter(pa.array(keep))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were."""
    _spark.bound_batches(docs.sparkSession)
    out = docs
    for part in slices(benchmark):
        out = out.mapInArrow(_clean(part, docs.columns.index("text")), docs.schema)
    return out
