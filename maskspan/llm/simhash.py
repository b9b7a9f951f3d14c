"""SimHash near-duplicates by exact comparison.

Every document gets a 128-bit SimHash of its word bigrams.  Equal signatures collapse first.  Up to DIRECT signatures are
sorted by population count and packed into tiles; a pair of tiles is compared with numpy exclusive-or and bit counts unless
their population counts differ by more than the radius, when no pair of their rows can match.

More signatures are compared by parts.  If two differ in at most 26 bits, then one of their four quarters differs in at most
6, 6, 6 and 5 bits (one more in each were 27), and one half of that quarter in at most 3 and 2 (2 and 2 for the last).  So
for each of the eight parts of 16 bits the rows of each value meet those of all values within its bound, first by the
quarter's bits, then by all.  Nothing is skipped that could match, sampled or capped: either way the pairs within the radius
are all found, whatever the documents' lengths.

Defined results: a document whose text is null, empty or without a word has no signature and joins no group; a
one-word document is its word; ties and repeated rows go to the least doc_id; a row without doc_id is left alone;
columns other than doc_id and text are ignored; an empty table gives no rows.

Scale: by parts one pair of distinct signatures in 24 is looked at, by 32 bits, so the comparison stays quadratic with a
small factor.  The values of a part are dealt into cells of up to CELL rows, a pair of cells to a task; the shuffle carries
a row of 24 bytes once for each cell that its own cell meets, by part (40 times at 4 cells, about 100 at 16).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import Words, chunks, mix64, ranges, release

#: Signature bits that may differ.
RADIUS = 26
#: Signatures in a tile: 0.6 MB.
TILE = 16384
#: Signatures up to which all are compared with all; beyond, those that share a near part.
DIRECT = 160_000
#: Rows of a cell, about; pairs looked at in one step; rows that a task deals out at a time; pairs held before they are joined.
CELL, STEP, FLUSH, HELD = 1 << 20, 1 << 16, 1 << 18, 1 << 17


def _signature(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, high half, low half) of each document."""
    count = np.diff(words.first)
    single = np.flatnonzero(count == 1)
    pair, at = words.shingles(2)
    doc = np.concatenate([words.doc[at], single])
    value = np.concatenate([pair, words.hash[words.first[single]]])
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    n = np.bincount(doc, minlength=words.n_docs)
    high, low = np.zeros(words.n_docs, np.uint64), np.zeros(words.n_docs, np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        starts = np.concatenate([[0], np.cumsum(n[has])[:-1]])
        for out, seed in ((high, 1), (low, 2)):
            bits = np.unpackbits(mix64(value, seed).view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[has] = np.packbits(2 * ones > n[has][:, None], axis=1).view(np.uint64).ravel()
    return n, high, low


def _sign(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            n, high, low = _signature(Words(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], names=["doc_id", "n", "s0", "s1"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s0, s1) of every document with at least one word."""
    _spark.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(_sign, "doc_id bigint, n int, s0 bigint, s1 bigint").where("n > 0")


_ROW = np.dtype([("doc", "<i8"), ("s0", "<u8"), ("s1", "<u8")])


def _tiles(size: int):
    def pack(batches):
        part, serial, rest = TaskContext.get().partitionId(), 0, []
        have = 0

        def out(rows):
            pop = np.bitwise_count(rows["s0"]).astype(int) + np.bitwise_count(rows["s1"])
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part << 32 | serial, pa.int64()), (int(pop.min()), pa.int32()), (int(pop.max()), pa.int32()), (rows.tobytes(), pa.binary()))],
                names=["tile", "p_lo", "p_hi", "blob"],
            )

        for batch in batches:
            rows = np.empty(batch.num_rows, _ROW)
            for name, k in (("doc", 0), ("s0", 1), ("s1", 2)):
                x = batch.column(k).to_numpy(zero_copy_only=False)
                rows[name] = x.view(np.uint64) if x.dtype == np.int64 and name != "doc" else x
            rest.append(rows)
            have += len(rows)
            while have >= size:
                rows = np.concatenate(rest)
                yield out(rows[:size])
                serial += 1
                rest, have = [rows[size:]], have - size
        if have:
            yield out(np.concatenate(rest))

    return pack


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all rows within the radius; i < j when both tiles are one."""
    step = max(1, min(len(a), (1 << 17) // max(1, len(b))))
    a0, a1, b0, b1 = (np.ascontiguousarray(x[name]) for x in (a, b) for name in ("s0", "s1"))
    differ, bits, rest, near = (np.empty((step, len(b)), t) for t in (np.uint64, np.uint8, np.uint8, bool))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), step):
        n = min(step, len(a) - at)
        x, p, q, m = differ[:n], bits[:n], rest[:n], near[:n]
        np.bitwise_xor(a0[at : at + n, None], b0, out=x)
        np.bitwise_count(x, out=p)
        np.bitwise_xor(a1[at : at + n, None], b1, out=x)
        np.bitwise_count(x, out=q)
        p += q
        np.less_equal(p, radius, out=m)
        if not m.any():
            continue
        i, j = np.nonzero(m)
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components: at most one edge a node, however many pairs there are."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = back[: len(u)], back[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), _ROW) for c in (2, 3))
                i, j = close_pairs(a, b, radius, same)
                if len(i):
                    u, v = _forest(a["doc"][i], b["doc"][j])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def parts(radius: int) -> list[tuple[int, int, int, int]]:
    """(quarter, half, the half's bound, the quarter's bound): two signatures within the radius are within both bounds of one of
    them.  Bounds that add up to radius - 3 can't all be exceeded, nor two that add up to the quarter's less 1."""
    bounds = [(q, h, ((radius - 3 + q) // 4 - 1 + h) // 2, (radius - 3 + q) // 4) for q in range(4) for h in range(2)]
    return [x for x in bounds if x[2] >= 0]


def _quarter(rows: np.ndarray, quarter: int) -> np.ndarray:
    return (rows["s1" if quarter > 1 else "s0"] >> np.uint64(32 * (quarter % 2))).astype(np.uint32)


def _value(quarter: np.ndarray, half: int) -> np.ndarray:
    return (quarter >> np.uint32(16 * half)).astype(np.uint16)


def _tasks(radius: int, bits: int) -> list[tuple[int, int, int]]:
    """(part, cell, cell) of the pairs of cells that have values within the part's bound; a value's cell is its `bits` highest bits."""
    cells = range(1 << bits)
    return [(k, a, b) for k, (_, _, reach, _) in enumerate(parts(radius)) for a in cells for b in cells if a <= b and (a ^ b).bit_count() <= reach]


def _deal(radius: int, bits: int):
    """The rows of each cell, once for each task that needs them."""
    wanted: dict[tuple[int, int], list[int]] = {}
    for task, (k, a, b) in enumerate(_tasks(radius, bits)):
        for cell in {a, b}:
            wanted.setdefault((k, cell), []).append(task)

    def send(rows):
        for k, (quarter, half, _, _) in enumerate(parts(radius)):
            cell = (_value(_quarter(rows, quarter), half) >> np.uint16(16 - bits)).astype(np.int64)
            dealt, edges = rows[np.argsort(cell, kind="stable")], np.append(0, np.cumsum(np.bincount(cell, minlength=1 << bits)))
            for c in np.flatnonzero(np.diff(edges)).tolist():
                tasks, blob = wanted[k, c], dealt[edges[c] : edges[c + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array([blob] * len(tasks), pa.binary())], names=["task", "rows"])

    def run(batches):
        held, have = [], 0
        for batch in batches:
            rows = np.empty(batch.num_rows, _ROW)
            for name, k in (("doc", 0), ("s0", 1), ("s1", 2)):
                rows[name] = batch.column(k).to_numpy(zero_copy_only=False).view(rows.dtype[name])
            held.append(rows)
            have += len(rows)
            if have >= FLUSH:
                yield from send(np.concatenate(held))
                held, have = [], 0
        if have:
            yield from send(np.concatenate(held))
        release()

    return run


class _Joined:
    """Components of rows 0 to n - 1 under the pairs that are added."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.held: list[np.ndarray] = []
        self.have = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        pair = np.stack([self.label[i], self.label[j]])
        pair = pair[:, pair[0] != pair[1]]
        if pair.size:
            self.held.append(pair)
            self.have += pair.shape[1]
            if self.have > HELD:
                self.join()

    def join(self) -> None:
        if self.have:
            to = np.arange(len(self.label))
            node, root = _forest(*np.concatenate(self.held, axis=1))
            to[node] = root
            self.label = to[self.label]
            self.held, self.have = [], 0

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self.join()
        node = np.flatnonzero(self.label != np.arange(len(self.label)))
        return node, self.label[node]


def _by_part(rows: np.ndarray, part: tuple[int, int, int, int], cells: tuple[int, int], bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) star edges with the components of all pairs within the radius, and within the part's bounds, of a row of the first cell
    and one of the second.  rows: those of both cells."""
    quarter, half, reach, bound = part
    value = _value(_quarter(rows, quarter), half)
    rows = rows[np.argsort(value, kind="stable")]
    short, s0, s1 = _quarter(rows, quarter), np.ascontiguousarray(rows["s0"]), np.ascontiguousarray(rows["s1"])
    start = np.append(0, np.cumsum(np.bincount(value, minlength=1 << 16)))
    # a second row comes after the first: its value is greater, or the same and it is further on
    mask = np.arange(1 << 16)
    mask = mask[(np.bitwise_count(mask) <= reach) & (mask >> (16 - bits) == cells[0] ^ cells[1])]
    differ, count, near = (np.empty(STEP, t) for t in (np.uint32, np.uint8, bool))
    found = _Joined(len(rows))
    low = cells[0] << (16 - bits)
    for v in (low + np.flatnonzero(np.diff(start[low : low + (1 << (16 - bits)) + 1]))).tolist():
        other = mask ^ v
        other = other[other >= v]
        second = ranges(start[other], start[other + 1] - start[other])
        first, stop = int(start[v]), int(start[v + 1])
        for at in range(0, len(second), STEP):
            b = second[at : at + STEP]
            y, step = short[b], STEP // len(b)
            for top in range(first, stop, step):
                x = short[top : min(top + step, stop), None]
                n = len(x) * len(b)
                np.bitwise_xor(x, y, out=differ[:n].reshape(len(x), len(b)))
                np.bitwise_count(differ[:n], out=count[:n])
                np.less_equal(count[:n], bound, out=near[:n])
                i, j = np.divmod(np.flatnonzero(near[:n]), len(b))
                i, j = i + top, b[j]
                hit = (np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j]) <= radius) & (i < j)
                if hit.any():
                    found.add(i[hit], j[hit])
    u, v = found.edges()
    return rows["doc"][u], rows["doc"][v]


def _meet(radius: int, bits: int):
    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                held.setdefault(batch.column(0)[k].as_py(), []).append(np.frombuffer(batch.column(1)[k].as_py(), _ROW))
        while held:
            task, blobs = held.popitem()
            k, *cells = _tasks(radius, bits)[task]
            rows = np.concatenate(blobs)
            blobs.clear()
            u, v = _by_part(rows, parts(radius)[k], tuple(cells), bits, radius)
            for at in range(0, len(u), FLUSH):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + FLUSH]), pa.array(v[at : at + FLUSH])], names=["u", "v"])
        release()

    return run


def _edges_by_parts(reps: DataFrame, rows: int, radius: int) -> DataFrame:
    bits = min(16, max(2, (rows // CELL).bit_length()))
    dealt = reps.select("doc_id", "s0", "s1").mapInArrow(_deal(radius, bits), "task int, rows binary")
    return dealt.repartitionById(max(1, len(_tasks(radius, bits))), F.col("task")).mapInArrow(_meet(radius, bits), "u bigint, v bigint")


def near_edges(reps: DataFrame, radius: int = RADIUS, tile: int = TILE, direct: int = DIRECT) -> DataFrame:
    """(u, v) edges whose components are those of all pairs of signatures within the radius; beyond `direct` signatures by parts."""
    spark = reps.sparkSession
    count = reps.count()
    if count > direct:
        return _edges_by_parts(reps, count, radius)
    pop = F.bit_count("s0") + F.bit_count("s1")
    ordered = reps.select("doc_id", "s0", "s1", pop.alias("p")).orderBy("p", "doc_id")
    tiles = _spark.cut(ordered.select("doc_id", "s0", "s1").mapInArrow(_tiles(tile), "tile bigint, p_lo int, p_hi int, blob binary"))
    meta = tiles.drop("blob")
    a, b = (meta.select(*(F.col(c).alias(f"{s}_{c}") for c in meta.columns)) for s in "ab")
    # tiles in reach of each other share a step of population counts
    step = lambda c: F.floor(F.col(c) / (radius + 1))
    a = a.withColumn("step", F.explode(F.sequence(step("a_p_lo"), step("a_p_hi"))))
    b = b.withColumn("step", F.explode(F.sequence(step("b_p_lo") - 1, step("b_p_hi") + 1)))
    pairs = a.join(b, "step").where(f"a_tile <= b_tile and b_p_lo - a_p_hi <= {radius} and a_p_lo - b_p_hi <= {radius}")
    pairs = _spark.cut(pairs.select("a_tile", "b_tile").distinct())
    n = pairs.count()
    blobs = lambda s: tiles.select(F.col("tile").alias(s + "_tile"), F.col("blob").alias(s))
    work = pairs.join(blobs("a"), "a_tile").join(blobs("b"), "b_tile").select("a_tile", "b_tile", "a", "b")
    work = work.repartition(max(1, min(n, 64 * _spark.parallelism(spark))), "a_tile", "b_tile")
    return work.mapInArrow(_compare(radius), "u bigint, v bigint")


def duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, direct: int = DIRECT) -> DataFrame:
    """(doc_id, duplicate_of): every document of a group but its least doc_id, and that doc_id."""
    signed = _spark.cut(signatures(docs))
    reps = _spark.cut(signed.groupBy("s0", "s1").agg(F.min("doc_id").alias("doc_id")))
    roots = _spark.connected_components(near_edges(reps, radius, tile, direct))
    of = reps.join(roots, reps.doc_id == roots.node, "left").select("s0", "s1", F.coalesce("root", reps.doc_id).alias("duplicate_of"))
    groups = signed.join(of, ["s0", "s1"]).select("doc_id", "duplicate_of")
    return groups.where("doc_id <> duplicate_of").distinct()


def keep_one(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, direct: int = DIRECT) -> DataFrame:
    """The documents without the duplicates: of each group the one with the least doc_id stays."""
    return _spark.without(docs, duplicates(docs, radius, tile, direct))
