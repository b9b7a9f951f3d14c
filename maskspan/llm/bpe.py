"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Texts are cut into pieces by the vocabulary's public splitting pattern.  Pieces that a worker hasn't met yet are bucketed by
length and become rows of a padded matrix of token ids; each round, every row merges its leftmost pair of least rank, found
with a hashed lookup of all neighbouring pairs, and the row is compacted; rows without a pair left leave the matrix.  Known
pieces are looked up, so a frequent word is merged once a worker.  Pieces of more than LONG bytes are merged with a heap
instead: a round of a matrix costs the row's whole length, a heap's step doesn't; the result is the same.

Decoding looks every id's bytes up and joins them; encode() decodes what it made and compares it with the text.

Defined results: a null text has null tokens and a null count; an empty one has none; any other text, however long, is encoded
whole; strings of special tokens are ordinary text; every row is kept, repeated ones too; columns other than doc_id and text
are ignored; an empty table gives no rows.  Ids that the vocabulary lacks decode to nothing.

Scale: one narrow pass, no shuffle; the vocabulary is read once a worker from a path that all machines have.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import buffers, chunks, ranges

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 512
#: Pieces that a worker remembers; beyond that it forgets them and starts again.
REMEMBER = 400_000

_NONE = np.iinfo(np.int32).max


class PairTable:
    """(left id, right id) -> rank of the pair: open addressing with linear probing."""

    BITS = 20

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(self.BITS, int(np.ceil(np.log2(max(2, len(rank)) * 3))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = key[todo[free]]  # of several for one slot the last wins
            won = self.keys[slot[todo]] == key[todo]
            self.ranks[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, _NONE where there is no such pair; a negative id is in no pair."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(key), _NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(key[todo])
        for _ in range(self.probes):
            have = self.keys[slot]
            hit = have == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (have != -1)
            todo, slot = todo[go], (slot[go] + 1) & self.mask
            if not len(todo):
                break
        return out.reshape(shape)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        top = max(self.ranks.values()) + 1
        pieces = [b""] * top
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.size = np.array([len(x) for x in pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for piece, r in self.ranks.items():
            for k in range(1, len(piece)):
                a, b = self.ranks.get(piece[:k]), self.ranks.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.pattern = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        sizes = np.array([len(x) for x in pieces], np.int64)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self._heap(pieces[k])
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 48, 64, 128, 256, LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            step = max(1, (1 << 20) // high)
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                for k, ids in zip(own.tolist(), self._matrix([pieces[k] for k in own.tolist()], sizes[own], high)):
                    out[k] = ids
        return out

    def _matrix(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[np.ndarray]:
        n = len(pieces)
        ids = np.full((n, width + 1), -1, np.int32)
        cell = ranges(np.arange(n) * (width + 1), sizes)
        ids.ravel()[cell] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        done = ids.copy()
        length = sizes.copy()
        row = np.arange(n)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width + 1)
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            live = best != _NONE
            if not live.all():
                stop = ~live
                done[row[stop], : ids.shape[1]] = ids[stop]
                row, ids, ranks, at, best = row[live], ids[live], ranks[live], at[live], best[live]
                if not len(row):
                    break
            length[row] -= 1
            mine = np.arange(len(row))
            # compaction: everything after the pair moves one place left; the last column falls away once it is empty
            shift = columns[: ids.shape[1]][None, :] > at[:, None]
            moved = np.concatenate([ids[:, 1:], np.full((len(row), 1), -1, np.int32)], axis=1)
            ids = np.where(shift, moved, ids)
            ids[mine, at] = best
            later = np.concatenate([ranks[:, 1:], np.full((len(row), 1), _NONE, np.int32)], axis=1)
            ranks = np.where(shift[:, : ranks.shape[1]], later, ranks)
            ranks[mine, at] = self.pairs.find(ids[mine, at], ids[mine, at + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.find(ids[before, at[before] - 1], ids[before, at[before]])
            used = int(length[row].max()) + 1
            if used < ids.shape[1]:
                ids, ranks = ids[:, :used], ranks[:, : used - 1]
                if ranks.shape[1] == 0:
                    done[row, :used] = ids
                    done[row, used:] = -1
                    break
        return [done[k, : length[k]] for k in range(n)]

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = [int(self.byte[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        words: list[bytes | None] = [bytes([b]) for b in piece]
        get = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if words[i] is None or j >= n or get(words[i] + words[j]) != r:
                continue
            words[i] += words[j]
            words[j] = None
            ids[i] = r
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(words[i] + words[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get(words[h] + words[i])) is not None:
                heapq.heappush(heap, (x, h))
        return np.array([ids[i] for i in range(n) if words[i] is not None], np.int32)

    def learn(self, new: list[str]) -> None:
        found = self.merge([x.encode() for x in new])
        at = len(self.known)
        need = sum(map(len, found))
        while self.used + need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while at + len(new) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        sizes = np.array([len(x) for x in found], np.int64)
        self.start[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.count[at : at + len(new)] = sizes
        if need:
            self.pool[self.used : self.used + need] = np.concatenate(found)
        self.used += need
        self.known.update(zip(new, range(at, at + len(new))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        pieces: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces += self.pattern.findall(text)
            ends[k] = len(pieces)
        different = set(pieces)
        new = [x for x in different if x not in self.known]
        if new:
            if len(self.known) + len(new) > REMEMBER:
                self.forget()
                new = list(different)
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        count = self.count[index]
        total = np.append(0, np.cumsum(count))
        return self.pool[ranges(self.start[index], count)], np.diff(total[np.append(0, ends)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, number of bytes of each)."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.size))
        size = np.where(known, self.size[np.where(known, ids, 0)], 0)
        return self.bytes[ranges(self.at[np.where(known, ids, 0)], size)], size


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _encode(path: str):
    def run(batches):
        book = vocabulary(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                column = part.column(1)
                ids, count = book.encode(column.fill_null("").to_pylist())
                raw, offsets = buffers(column)
                back, size = book.decode(ids)
                ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
                if np.array_equal(ends, offsets):
                    wrong = np.add.reduceat(np.append(raw != back, False), np.minimum(offsets[:-1], len(raw))) if len(offsets) > 1 else np.zeros(0)
                    same = (wrong == 0) | (np.diff(offsets) == 0)
                else:
                    same = np.array([back[ends[k] : ends[k + 1]].tobytes() == raw[offsets[k] : offsets[k + 1]].tobytes() for k in range(len(count))])
                null = column.is_null().to_numpy(zero_copy_only=False)
                bound = pa.array(np.append(0, np.cumsum(count)).astype(np.int32), mask=np.append(null, False))
                tokens = pa.ListArray.from_arrays(bound, pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), tokens, pa.array(count.astype(np.int32), mask=null), pa.array(same, mask=null)], names=["doc_id", "tokens", "n_tokens", "round_trip"])

    return run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): every document's ids, and whether they decode to its text."""
    _spark.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(path), "doc_id bigint, tokens array<int>, n_tokens int, round_trip boolean")


def _decode(path: str):
    def run(batches):
        book = vocabulary(path)
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            ids = np.where(flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(-1).to_numpy(zero_copy_only=False), -1)
            back, size = book.decode(ids)
            count = np.array(column.value_lengths().fill_null(0))
            ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
            whole = back.tobytes()
            null = column.is_null().to_pylist()
            texts = [None if x else whole[a:b].decode("utf-8", "replace") for x, a, b in zip(null, ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens); bytes that aren't UTF-8 become U+FFFD."""
    _spark.bound_batches(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens"))
    return rows.mapInArrow(_decode(path), "doc_id bigint, text string")
