"""Near-duplicate passages by compact windows.

A document's tokens are its overlapping runs of SHINGLE words.  Under each of HASHES hash functions, the subsequences of at
least WIDTH tokens that share a minimum form compact windows: the minimum's position c and its Cartesian-tree range [l, r],
inside which every subsequence through c has that minimum.  Windows of all documents are grouped by minimum.  In its group a
window is linked to the least document of the group and to the least ones that also have the same SIDE tokens before or after
the minimum, so that a line that many documents share hides no longer passage.  An interval join then looks, for each pair of
documents, for windows of NEED different hash functions that overlap in both documents, and such pairs are verified exactly: a
passage is a run of words of which at least SHARE of the tokens occur in the other document, with no more than GAP missing in
a row, and which has MIN_WORDS words.  A passage of Jaccard similarity 0.7 is found with probability 0.99.

Exact repeats are all found.  Any RUN tokens (MIN_WORDS words) have their minimum in a window of the first hash function, and one
of four blocks of BLOCK tokens around it lies within them: a window is also linked to the least document with an equal block.
Where that document fails to hold the whole run (an earlier fragment), the runs that have BLOCK of their tokens in it without
lying in a passage are looked up among those of all other documents in that position, by the hash of the whole run.

A passage's first occurrence (least doc_id) is the one that others are duplicates of; documents with equal texts are paired by
text beforehand.  A passage that repeats within one document is told with of_doc = doc_id, from its second occurrence on.

Defined results: null, empty and short texts have no passage; rows that share a doc_id aren't duplicates of one another (each
of their texts is judged); ties go to the least doc_id; a row without doc_id is left alone; columns other than doc_id and text
are ignored (cut() passes them on unchanged, n_chars excepted); an empty table gives no rows; a text may have any length.

Scale: windows are about 2 / WIDTH of the words a hash function, 36 bytes each, shuffled as packed buckets once, whose number
follows from the input's size; a window makes three links at most, with four more under the first hash function; texts travel
only for documents with a candidate, to several tasks where very many documents link to one.  A minimum in over HOT windows
(found on a sample, which changes no link's existence) is split by what surrounds it, and a task sends only the least document
of each such class on, linking its others to that one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import Words, _B, _BINV, _power, buffers, char_index, chunks, mix64, release

SHINGLE = 5
MIN_WORDS = 50
#: Least tokens of a window: those of MIN_WORDS words, less an allowance for words that one side lacks.
WIDTH = 42
HASHES = 6
NEED = 2
SHARE = 0.6
#: Tokens that two changed words a few places apart take away.
GAP = 2 * SHINGLE
#: Tokens at either side of a minimum that make a closer class of its group.
SIDE = 8
#: Tokens of MIN_WORDS words; those of a block around a minimum, and the blocks' distance.
RUN = MIN_WORDS - SHINGLE + 1
STEP = 12
BLOCK = RUN - STEP + 1
BLOCKS = -(-RUN // STEP)
#: Windows that a task packs at a time, which bounds its memory.
FLUSH = 400_000
#: Windows of one minimum beyond which it is split; documents of which one is looked at for that.
HOT, SAMPLE = 1 << 20, 128
#: Bytes of packed windows in a bucket, about.
BUCKET_BYTES = 64 << 20
#: Links to one document beyond which its text goes to several tasks.
SPLIT = 256

_LOW = np.uint64(0xFFFFFF)
_FIELDS = [("key", "<u8"), ("doc", "<i8"), ("c", "<u4"), ("left", "<u4"), ("right", "<u4"), ("before", "<u4"), ("after", "<u4")]
_WINDOW = np.dtype(_FIELDS)
#: A window of the first hash function, with its blocks' hashes (0: none).
_WIDE = np.dtype([*_FIELDS, ("blocks", "<u4", (BLOCKS,))])
#: Ranges in tokens; mask: the hash function's bit, or more bits than NEED for a link that is verified at once.
_LINK = np.dtype([("doc", "<i8"), ("of", "<i8"), ("a_lo", "<i4"), ("a_hi", "<i4"), ("b_lo", "<i4"), ("b_hi", "<i4"), ("mask", "<i4")])
_SURE = 0xFF
_KINDS = (_WINDOW, _WIDE, _LINK)


def _smaller(value: np.ndarray, step: int) -> np.ndarray:
    """For each element the index of the nearest smaller one to the left (step -1) or right (step 1); the first and last
    element must be the least."""
    at = np.clip(np.arange(len(value)) + step, 0, len(value) - 1)
    live = np.flatnonzero(value > 0)
    while len(live):
        live = live[value[at[live]] > value[live]]
        at[live] = at[at[live]]
    return at


def compact_windows(token: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r), both ends inclusive, of all compact windows of at least `width` tokens.  token: the values; first: where
    each document begins, and the end.  The least value wins, the leftmost of equals."""
    n = len(token)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    if n <= int(_LOW):
        value, place_of = (token & ~_LOW) | np.arange(n, dtype=np.uint64), None
    else:  # ranks, which tell any number of positions apart
        place_of = np.argsort(token & ~_LOW, kind="stable")
        value = np.empty(n, np.uint64)
        value[place_of] = np.arange(n, dtype=np.uint64)
    least, span = value, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    size = np.diff(first)
    inside = np.ones(n - width + 1, bool)
    # starts of windows that would cross into the next document
    cross = np.zeros(n + 1, np.int32)
    begin = np.maximum(first[1:] - width + 1, first[:-1])
    np.add.at(cross, begin, 1)
    np.add.at(cross, first[1:], -1)
    inside &= np.cumsum(cross)[: n - width + 1] == 0
    if not inside.any() or not len(size):
        return none, none, none
    least = least[inside]
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    # A minimum's windows are neighbours unless a document ends between them, so this has every position once.
    c = np.sort((least[new] & _LOW).astype(np.int64) if place_of is None else place_of[least[new].astype(np.int64)])
    # Any smaller value next to a window lies in a window that is wider still: the smaller ones are among these.
    doc = np.searchsorted(first, c, side="right") - 1
    turn = np.flatnonzero(np.diff(doc)) + 1
    at = np.arange(len(c)) + 1 + np.cumsum(np.isin(np.arange(len(c)), turn))
    line = np.zeros(len(c) + len(turn) + 2, np.uint64)
    place = np.full(len(line), -1)
    line[at], place[at] = value[c] + np.uint64(1), c
    before, after = place[_smaller(line, -1)[at]], place[_smaller(line, 1)[at]]
    left = np.where(before < 0, first[doc], before + 1)
    right = np.where(after < 0, first[doc + 1], after) - 1
    keep = right - left + 1 >= width
    return c[keep], left[keep], right[keep]


def _tokens(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, token of each word position that begins one, where each document's tokens begin)."""
    words = Words(column)
    token, at = words.shingles(SHINGLE)
    count = np.bincount(words.doc[at], minlength=words.n_docs)
    return words, token, np.append(0, np.cumsum(count))


class _Spans:
    """Hashes of runs of tokens, from sums over all tokens before a place."""

    def __init__(self, token: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(token) + 1, np.uint64)
            np.cumsum(token * _power(_B, "b", len(token)), out=self.sums[1:])

    def hash(self, lo: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[lo + size] - self.sums[lo]) * _power(_BINV, "i", len(self.sums))[lo])

    def short(self, lo: np.ndarray, size: int, fits: np.ndarray) -> np.ndarray:
        """32 bits, never 0, of the runs that fit; 0 for the others."""
        out = np.zeros(len(lo), np.uint32)
        out[fits] = (self.hash(lo[fits], size) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return out


def _rows(column: pa.Array, doc_id: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(windows of the hash functions after the first, those of the first) of a batch of texts."""
    _, token, first = _tokens(column)
    spans = _Spans(token)
    out: list[np.ndarray] = []
    for h in range(HASHES):
        key = mix64(token, 100 + h)
        c, left, right = compact_windows(key, first, WIDTH)
        doc = np.searchsorted(first, c, side="right") - 1
        rows = np.empty(len(c), _WINDOW if h else _WIDE)
        # the hash function's number in the lowest bits: windows of different functions never meet
        rows["key"] = (key[c] & ~np.uint64(7)) | np.uint64(h)
        rows["doc"], rows["c"], rows["left"], rows["right"] = doc_id[doc], c - first[doc], c - left, right - c
        rows["before"] = spans.short(c - SIDE + 1, SIDE, c - SIDE + 1 >= left)
        rows["after"] = spans.short(c, SIDE, c + SIDE - 1 <= right)
        for j in range(BLOCKS if h == 0 else 0):
            lo = c - j * STEP
            rows["blocks"][:, j] = spans.short(lo, BLOCK, (lo >= left) & (lo + BLOCK - 1 <= right))
        out.append(rows)
    return out[1:], out[0]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def _classes(rows: np.ndarray):
    """(salt, value of each row, sure) of the classes within a group, 0 where a row is in none."""
    yield 1, rows["before"], False
    yield 2, rows["after"], False
    for j in range(BLOCKS if "blocks" in rows.dtype.names else 0):
        yield 3 + j, rows["blocks"][:, j], True


def _class_key(rows: np.ndarray, salt: int, value: np.ndarray) -> np.ndarray:
    return mix64(rows["key"] ^ mix64(value.astype(np.uint64), 200 + salt))


def _link_rows(rows: np.ndarray, own: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray, sure: bool) -> np.ndarray:
    """Links of rows[own] to documents with ranges; of sure ones one for each pair of documents."""
    out = np.zeros(len(own), _LINK)
    x = rows[own]
    out["doc"], out["of"] = x["doc"], of
    if sure:
        out["mask"] = _SURE
        return np.unique(out)
    out["a_lo"], out["a_hi"], out["b_lo"], out["b_hi"] = x["c"].astype(np.int64) - x["left"], x["c"].astype(np.int64) + x["right"], lo, hi
    out["mask"] = 1 << (x["key"] & np.uint64(7)).astype(np.int32)
    return out


def _links_of(rows: np.ndarray):
    """Links of windows to the least documents of their groups and classes."""
    if not len(rows):
        return
    key = np.sort(rows["key"])
    twice = np.unique(key[1:][key[1:] == key[:-1]])
    if not len(twice):
        return
    at = np.searchsorted(twice, rows["key"])
    at[at == len(twice)] = 0
    rows = rows[twice[at] == rows["key"]]
    rows = rows[np.lexsort((rows["c"], rows["doc"], rows["key"]))]
    new = _starts(rows["key"], rows["doc"])
    member = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # a document's windows of one minimum count as one that spans them all, which can only add candidates
    middle = rows["c"].astype(np.int64)
    lo, hi = np.minimum.reduceat(middle - rows["left"], first), np.maximum.reduceat(middle + rows["right"], first)
    group = _starts(rows["key"])
    tried = [member[np.flatnonzero(group)[np.cumsum(group) - 1]]]
    other = np.flatnonzero(tried[0] != member)
    yield _link_rows(rows, other, rows["doc"][first[tried[0][other]]], lo[tried[0][other]], hi[tried[0][other]], False)
    for salt, value, sure in _classes(rows):
        own = np.flatnonzero(value)
        k = _class_key(rows[own], salt, value[own])
        order = np.argsort(k, kind="stable")
        start = _starts(k[order])
        least = member.copy()
        least[own[order]] = member[own[order[np.flatnonzero(start)[np.cumsum(start) - 1]]]] if len(order) else 0
        wanted = least != member
        if not sure:
            for x in tried:
                wanted &= least != x
            tried.append(least)
        other = np.flatnonzero(wanted)
        yield _link_rows(rows, other, rows["doc"][first[least[other]]], lo[least[other]], hi[least[other]], sure)


def _within(found: list[np.ndarray]) -> np.ndarray:
    """Links of documents to themselves where minima of NEED hash functions occur in them twice."""
    key, doc = (np.concatenate([x[name] for x in found]) for name in ("key", "doc"))
    mixed = mix64(key ^ mix64(doc.view(np.uint64), 8))
    order = np.argsort(mixed, kind="stable")
    again = order[1:][mixed[order[1:]] == mixed[order[:-1]]]
    pair = np.unique(np.column_stack([doc[again], (key[again] & np.uint64(7)).astype(np.int64)]), axis=0)
    ids, n = np.unique(pair[:, 0], return_counts=True)
    out = np.zeros(int((n >= NEED).sum()), _LINK)
    out["doc"] = out["of"] = ids[n >= NEED]
    out["mask"] = _SURE
    return out


def _split(rows: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(windows of other minima, stand-ins of the hot ones, links): each class of a hot minimum, and the minimum itself, becomes a
    group of its own, of which only the least document here goes on."""
    at = np.searchsorted(hot, rows["key"])
    at[at == len(hot)] = 0
    is_hot = hot[at] == rows["key"]
    own = rows[is_hot]
    h = own["key"] & np.uint64(7)
    sent, links = [], []
    for salt, value, sure in ((0, np.ones(len(own), np.uint32), False), *_classes(own)):
        has = np.flatnonzero(value)
        k = _class_key(own[has], salt, value[has]) & ~np.uint64(7) | h[has]
        order = has[np.lexsort((own["doc"][has], k))]
        k = np.sort(k)
        start = _starts(k)
        head = order[np.flatnonzero(start)[np.cumsum(start) - 1]] if len(order) else order
        other = own["doc"][order] != own["doc"][head]
        middle = own["c"].astype(np.int64)
        links.append(_link_rows(own, order[other], own["doc"][head[other]], (middle - own["left"])[head[other]], (middle + own["right"])[head[other]], sure))
        # stand-ins are wide when their links are sure: one block that all share
        out = np.zeros(int(start.sum()), _WIDE if sure else _WINDOW)
        for name, _ in _FIELDS[:5]:
            out[name] = own[name][order[start]]
        out["key"] = k[start]
        if sure:
            out["blocks"][:, 0] = 1
        sent.append(out)
    return rows[~is_hot], sent, np.concatenate(links)


def _windows(buckets: int, hot: np.ndarray):
    def run(batches):
        found: list[np.ndarray] = []
        for batch in batches:
            for part in chunks(batch, "text"):
                rest, wide = _rows(part.column(1), part.column(0).to_numpy(zero_copy_only=False))
                found += [*rest, wide]
            if sum(map(len, found)) > FLUSH:
                yield from _packed(found, buckets, hot)
                found = []
        yield from _packed(found, buckets, hot)

    return run


def _packed(found: list[np.ndarray], buckets: int, hot: np.ndarray):
    if not found:
        return
    kinds: list[list[np.ndarray]] = [[], [], [_within(found)]]
    for kind in (0, 1):
        rows = np.concatenate([x for x in found if x.dtype == _KINDS[kind]])
        if len(hot):
            rows, sent, links = _split(rows, hot)
            for x in sent:
                kinds[_KINDS.index(x.dtype)].append(x)
            kinds[2].append(links)
        kinds[kind].append(rows)
    for kind, parts in enumerate(kinds):
        rows = np.concatenate(parts)
        value = rows["key"] >> np.uint64(20) if kind < 2 else mix64(rows["doc"].view(np.uint64))
        bucket = (value % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, edges = rows[order], np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kind], pa.int32()), pa.array([rows[edges[k] : edges[k + 1]].tobytes()], pa.binary())], names=["bucket", "kind", "rows"])


_LINK_SCHEMA = "doc bigint, of bigint, a_lo int, a_hi int, b_lo int, b_hi int, mask int"


def _links(batches):
    """The links of each bucket's windows."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            kind = batch.column(1)[k].as_py()
            held.setdefault((batch.column(0)[k].as_py(), kind), []).append(np.frombuffer(batch.column(2)[k].as_buffer(), _KINDS[kind]))
    while held:
        (_, kind), blobs = held.popitem()
        rows = np.concatenate(blobs)
        blobs.clear()
        for out in (rows,) if kind == 2 else _links_of(rows):
            for at in range(0, len(out), FLUSH // 4):
                part = out[at : at + FLUSH // 4]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[name])) for name in _LINK.names], names=list(_LINK.names))
    release()


def overlapping(doc, of, a_lo, a_hi, b_lo, b_hi, mask) -> np.ndarray:
    """Where the pairs of documents begin that have overlapping windows of NEED hash functions: the interval join of a pair's
    links, which come in the order of (doc, of, a_lo).  A link looks back until no earlier one reaches it."""
    start = _starts(doc, of)
    begin = np.flatnonzero(start)
    pair = np.cumsum(start) - 1
    seen = mask.astype(np.uint8)
    good = np.bitwise_or.reduceat(seen == _SURE, begin)
    shift = pair * (np.int64(1) << 32)
    reach = np.maximum.accumulate(a_hi + shift) - shift
    live = np.flatnonzero(~good[pair])
    step = 1
    while len(live):
        live = live[live - step >= begin[pair[live]]]
        live = live[reach[live - step] >= a_lo[live]]
        back = live - step
        meet = (a_hi[back] >= a_lo[live]) & (b_lo[live] <= b_hi[back]) & (b_lo[back] <= b_hi[live])
        i, j = live[meet], back[meet]
        both = seen[i] | mask[j].astype(np.uint8)
        seen[j] |= mask[i].astype(np.uint8)
        seen[i] |= both
        good[pair[i[np.bitwise_count(seen[i]) >= NEED]]] = True
        good[pair[j[np.bitwise_count(seen[j]) >= NEED]]] = True
        live = live[~good[pair[live]]]
        step += 1
    return begin[good]


def _enough(batches):
    """The pairs of documents to verify, from sorted links, a few pairs in memory at a time."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [batch.column(k).to_numpy().astype(np.int64) for k in range(7)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        # the last pair may go on in the next batch
        last = int(np.flatnonzero(_starts(*rows[:2]))[-1])
        held = [x[last:] for x in rows]
        if last:
            at = overlapping(*(x[:last] for x in rows))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][at]), pa.array(rows[1][at])], names=["doc", "of"])
    if held is not None:
        at = overlapping(*held)
        yield pa.RecordBatch.from_arrays([pa.array(held[0][at]), pa.array(held[1][at])], names=["doc", "of"])
    release()


def match_runs(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first token, last token) of the runs of hits that make a passage: GAP misses between two at most, and where that
    brings too many misses in, half of it, then none."""
    at = np.flatnonzero(hit)
    doc = np.searchsorted(first, at, side="right") - 1
    found = [np.zeros((3, 0), np.int64)]
    for gap in (GAP, GAP // 2, 0):
        if not len(at):
            break
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > gap + 1)
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(at)) - 1
        lo, hi, hits = at[begin], at[stop], stop - begin + 1
        long = hi - lo + SHINGLE >= MIN_WORDS
        keep = long & (hits >= SHARE * (hi - lo + 1))
        found.append(np.stack([doc[begin[keep]], lo[keep], hi[keep]]))
        rest = np.repeat(long & ~keep, hits)
        at, doc = at[rest], doc[rest]
    out = np.concatenate(found, axis=1)
    return tuple(out[:, np.lexsort((out[1], out[0]))])


def _open(part: pa.RecordBatch, column: int, token: np.ndarray, pair: np.ndarray, hit: np.ndarray, settled: np.ndarray) -> pa.RecordBatch:
    """The runs that have BLOCK tokens in the other document and aren't settled, as rows of the document in the column."""
    sums = np.append(0, np.cumsum(hit))
    n = len(token) - RUN + 1
    run = np.flatnonzero((sums[RUN:] - sums[:-RUN] >= BLOCK) & (pair[:n] == pair[RUN - 1 :]) & ~settled[:n])
    pick, zero = pa.array(pair[run]), pa.array(np.zeros(len(run), np.int32))
    return pa.RecordBatch.from_arrays([part.column(column).take(pick), part.column(1).take(pick), zero, zero, zero, part.column(3).take(pick), zero, zero, pa.array(_Spans(token).hash(run, RUN).view(np.int64))], names=_FOUND)


def _verify(both: bool):
    """Passages (key null), and runs to look up elsewhere (key: their hash); both: also those of the earlier document, which is needed
    where links don't all lead to the least one of a class.  Rows with the same earlier text come together: it is read once for them."""

    def run(batches):
        for batch in batches:
            new = _starts(batch.column(3).to_numpy(), batch.column(5).to_numpy()) if batch.num_rows else np.zeros(0, bool)
            size = np.diff(buffers(batch.column(2))[1]) + np.diff(buffers(batch.column(4))[1]) * new
            step = np.cumsum(size) // (4 << 20)
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(step)) + 1):
                if not len(at):
                    continue
                part = batch.slice(int(at[0]), len(at))
                words, a, a_first = _tokens(part.column(2))
                of, b_key = part.column(3).to_numpy(), part.column(5).to_numpy()
                order = np.lexsort((b_key, of))
                new = _starts(of[order], b_key[order])
                text = np.empty(len(order), np.int64)
                text[order] = np.cumsum(new) - 1
                _, b, b_first = _tokens(part.column(4).take(pa.array(order[new])))
                salt = mix64(np.arange(part.num_rows, dtype=np.uint64), 9)
                a_pair = np.repeat(np.arange(part.num_rows), np.diff(a_first))
                own = (part.column(0).to_numpy() == part.column(3).to_numpy())[a_pair] if len(a) else np.zeros(0, bool)
                b_key = np.sort(b + salt[np.repeat(np.arange(len(b_first) - 1), np.diff(b_first))]) if len(b) else b
                key = a + salt[text[a_pair]]
                where = np.searchsorted(b_key, key)
                where[where == len(b_key)] = 0
                hit = b_key[where] == key if len(b_key) else np.zeros(len(key), bool)
                # within one document a token must have occurred before
                mine = np.flatnonzero(own)
                key = a + salt[a_pair]
                order = mine[np.argsort(key[mine], kind="stable")]
                hit[mine] = False
                hit[order[1:][key[order[1:]] == key[order[:-1]]]] = True
                pair, lo, hi = match_runs(hit, a_first)
                lead = words.first[pair] - a_first[pair]
                index = char_index(words.raw)
                base = index[words.offsets[pair]]
                begin, end = index[words.start[lo + lead]] - base, index[words.end[hi + lead + SHINGLE - 1]] - base
                pick = pa.array(pair)
                numbers = (begin, end, hi - lo + SHINGLE)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pick), part.column(1).take(pick), *(pa.array(x.astype(np.int32)) for x in numbers), part.column(3).take(pick), *(pa.array((x - a_first[pair]).astype(np.int32)) for x in (lo, hi)), pa.nulls(len(pair), pa.int64())],
                    names=_FOUND,
                )
                if len(a) >= RUN:
                    covered = np.zeros(len(a) + 1, np.int32)
                    whole = hi - lo + 1 >= RUN
                    np.add.at(covered, lo[whole], 1)
                    np.add.at(covered, hi[whole] - RUN + 2, -1)
                    yield _open(part, 0, a, a_pair, hit & ~own, np.cumsum(covered) > 0)
                if both and len(b) >= RUN:
                    _, b, b_first = _tokens(part.column(4))
                    b_pair = np.repeat(np.arange(part.num_rows), np.diff(b_first))
                    a_key, key = np.sort(key), b + salt[b_pair]
                    where = np.searchsorted(a_key, key)
                    where[where == len(a_key)] = 0
                    hit = (a_key[where] == key) & (part.column(0).to_numpy() != part.column(3).to_numpy())[b_pair] if len(a_key) else np.zeros(len(b), bool)
                    yield _open(part, 3, b, b_pair, hit, np.append(np.cumsum(hit)[RUN - 1 :] - np.append(0, np.cumsum(hit)[:-RUN]) == RUN, np.zeros(RUN, bool)))
            release()

    return run


_PASSAGE = "doc_id bigint, text_key bigint, start int, end int, words int, of_doc bigint"
_FOUND = ["doc_id", "text_key", "start", "end", "words", "of_doc", "lo", "hi", "key"]


def _whole(batches):
    """The single passage of a text that is equal to another's."""
    for batch in batches:
        for part in chunks(batch, "text"):
            words = Words(part.column(3))
            count = np.diff(words.first)
            d = np.flatnonzero(count >= MIN_WORDS)
            index = char_index(words.raw)
            base = index[words.offsets[d]]
            pick = pa.array(d)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pick), part.column(1).take(pick), pa.array((index[words.start[words.first[d]]] - base).astype(np.int32)), pa.array((index[words.end[words.first[d + 1] - 1]] - base).astype(np.int32)), pa.array(count[d].astype(np.int32)), part.column(2).take(pick)],
                names=["doc_id", "text_key", "start", "end", "words", "of_doc"],
            )


def _census(batches):
    """(key, windows) of a sample's minima; key 0: bytes of text."""
    for batch in batches:
        for part in chunks(batch, "text"):
            rest, wide = _rows(part.column(1), np.zeros(part.num_rows, np.int64))
            key, n = np.unique(np.concatenate([x["key"] for x in (*rest, wide)]), return_counts=True)
            key, n = np.append(key, np.uint64(0)), np.append(n, buffers(part.column(1))[1][-1])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def layout(fresh: DataFrame, hot: int = HOT) -> tuple[int, np.ndarray]:
    """(number of buckets, sorted hot minima) for the given texts, from one document in SAMPLE."""
    part = fresh.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = part.mapInArrow(_census, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    most = counts.where(f"key = 0 or n * {SAMPLE} >= {hot}").orderBy(F.desc("n")).limit(1 << 16).collect()
    size = sum(r.n for r in most if r.key == 0) * SAMPLE
    keys = np.sort(np.array([r.key for r in most if r.key], np.int64).view(np.uint64))
    return max(_spark.parallelism(fresh.sparkSession), -(-2 * size // BUCKET_BYTES)), keys


def passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, start, end, words, of_doc): text[start:end] of doc_id, in characters, has a near-duplicate in
    of_doc <= doc_id.  text_key is xxhash64 of the text, to tell rows with equal doc_id apart."""
    spark = docs.sparkSession
    _spark.bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and length(text) >= 2 * %d - 1" % MIN_WORDS)
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    # Equal texts: two 64-bit hashes and the length; the least doc_id stands for all.
    ids = keyed.select("doc_id", "text_key", F.xxhash64(F.lit(1), "text").alias("k2"), F.length("text").alias("k3"))
    least = ids.groupBy("text_key", "k2", "k3").agg(F.min("doc_id").alias("of_doc"), F.max("doc_id").alias("top")).where("top > of_doc")
    copies = _spark.cut(ids.join(least, ["text_key", "k2", "k3"]).where("doc_id > of_doc").select("doc_id", "text_key", "of_doc").distinct())
    copied = _spark.small(copies, copies.count(), 24)
    equal = keyed.join(copied, ["doc_id", "text_key"]).select("doc_id", "text_key", "of_doc", "text").mapInArrow(_whole, _PASSAGE)
    fresh = keyed.join(copied, ["doc_id", "text_key"], "left_anti").select("doc_id", "text")

    n, keys = layout(fresh, hot)
    packed = fresh.mapInArrow(_windows(n, keys), "bucket int, kind int, rows binary").repartitionById(n, F.col("bucket"))
    links = packed.mapInArrow(_links, _LINK_SCHEMA).repartition(n, "doc", "of").sortWithinPartitions("doc", "of", "a_lo")
    pairs = _spark.cut(links.mapInArrow(_enough, "doc bigint, of bigint"))
    found = _spark.cut(_verified(keyed, pairs, len(keys) > 0))
    # Runs that an earlier fragment hid: by their own hash, the least document of each with the others.
    runs = found.where("key is not null").select(F.col("doc_id").alias("doc"), "key").distinct()
    heads = runs.groupBy("key").agg(F.min("doc").alias("of"), F.max("doc").alias("top")).where("top > of")
    more = runs.join(heads, "key").where("doc > of").select("doc", "of").distinct().join(pairs, ["doc", "of"], "left_anti")
    again = _verified(keyed, _spark.cut(more), False).where("key is null")
    out = _spark.cut(found.where("key is null").unionByName(again).drop("key"))
    # A passage within one of an earlier document isn't told again.
    x, y = out.alias("x"), out.alias("y")
    same = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.text_key") == F.col("y.text_key"))
    inside = same & (F.col("y.of_doc") < F.col("x.of_doc")) & (F.col("y.lo") <= F.col("x.lo")) & (F.col("y.hi") >= F.col("x.hi"))
    return equal.unionByName(x.join(y, inside, "left_anti").drop("lo", "hi"))


def _verified(keyed: DataFrame, pairs: DataFrame, both: bool) -> DataFrame:
    members = _spark.cut(pairs.select(F.explode(F.array("doc", "of")).alias("id")).distinct())
    involved = keyed.join(_spark.small(members, members.count(), 8), F.col("doc_id") == F.col("id"), "left_semi")
    load = _spark.cut(pairs.groupBy("of").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")))
    heavy = load.where("parts > 1")
    spread = _spark.small(heavy, heavy.count(), 12)
    part = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    dealt = pairs.join(spread, "of", "left").select("doc", "of", part)
    b = involved.select(F.col("doc_id").alias("of"), F.col("text_key").alias("b_key"), F.col("text").alias("b_text"))
    b = b.join(spread, "of", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    a = involved.select(F.col("doc_id").alias("doc"), "text_key", F.col("text").alias("a_text"))
    work = dealt.join(a, "doc").join(b, ["of", "part"]).where("doc <> of or text_key = b_key").select("doc", "text_key", "a_text", "of", "b_text", "b_key")
    return work.mapInArrow(_verify(both), _PASSAGE + ", lo int, hi int, key bigint")


def _cut(column: int, size: int | None, extra: int):
    def run(batches):
        for batch in batches:
            texts, spans = batch.column(column), batch.column(extra)
            for_all = batch.select(range(extra))
            if spans.null_count < batch.num_rows:
                out = texts.to_pylist()
                for k in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    text, done, kept = out[k], 0, []
                    for s in sorted((s["start"], s["end"]) for s in spans[k].as_py()):
                        kept.append(text[done : max(done, s[0])])
                        done = max(done, s[1])
                    out[k] = "".join(kept) + text[done:]
                for_all = for_all.set_column(column, batch.schema.field(column), pa.array(out, texts.type))
                if size is not None:
                    lengths = [None if x is None else len(x) for x in out]
                    for_all = for_all.set_column(size, batch.schema.field(size), pa.array(lengths, batch.schema.field(size).type))
            yield for_all

    return run


def cut(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without the passages that occur in a document of smaller doc_id or earlier in their own; n_chars,
    if there is such a column, follows the text."""
    doc, key, spans = _spark.fresh(docs, 3)
    found = passages(docs).groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.collect_set(F.struct("start", "end")).alias(spans))
    found = _spark.cut(found)
    size = found.agg(F.sum(F.size(spans) * 32 + 64), F.count("*")).first()
    small = _spark.small(found, size[1], (size[0] or 0) // max(1, size[1]))
    joined = docs.join(small, (docs["doc_id"].cast("bigint") == F.col(doc)) & (F.xxhash64(docs["text"].cast("string")) == F.col(key)), "left").drop(doc, key)
    names = docs.columns
    numbers = ("bigint", "int")
    size_at = names.index("n_chars") if "n_chars" in names and dict(docs.dtypes)["n_chars"] in numbers else None
    return joined.mapInArrow(_cut(names.index("text"), size_at, len(names)), docs.schema)
