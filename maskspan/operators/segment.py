"""Row generators: overlapping chunks and windows, lines, words, paragraphs.  All narrow; offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import cut

CHUNK, CHUNK_OVERLAP = 1000, 100
WINDOW, WINDOW_OVERLAP = 400, 60
#: What ends a line, besides the pair CR LF.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def chunk_structs(text: Column, size: int, overlap: int) -> Column:
    """array<struct<offset, chunk_text>>; an empty text has one empty chunk; the first chunk that reaches the end is the last."""
    step = max(1, size - overlap)
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).cast("int").alias("offset"), cut(text, k * step, k * step + size).alias("chunk_text")))


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = CHUNK_OVERLAP, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """G1: (keys, chunk_index, total_chunks, offset, chunk_text)."""
    parts = docs.where(F.col(text).isNotNull()).select(*keys, chunk_structs(F.col(text), size, overlap).alias("_parts"))
    rows = parts.select(*keys, F.size("_parts").alias("total_chunks"), F.posexplode("_parts").alias("chunk_index", "_part"))
    return rows.select(*keys, "chunk_index", "total_chunks", F.col("_part.offset").alias("offset"), F.col("_part.chunk_text").alias("chunk_text"))


def windows(chunked: DataFrame, size: int = WINDOW, overlap: int = WINDOW_OVERLAP, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """Windows of chunks, offset within the chunk."""
    rows = chunked.select(*keys, F.posexplode(chunk_structs(F.col("chunk_text"), size, overlap)).alias("window_index", "_w"))
    return rows.select(*keys, "window_index", F.col("_w.offset").alias("window_offset"), F.col("_w.chunk_text").alias("window_text"))


def line_array(text: Column) -> Column:
    """Lines without their ends; a last line that is empty isn't one."""
    parts = F.split(text, _LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, line_no from 1, line)."""
    rows = docs.where(F.col(text).isNotNull()).select(*keys, F.posexplode(line_array(F.col(text))).alias("_at", "line"))
    return rows.select(*keys, (F.col("_at") + 1).alias("line_no"), "line")


def words(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, word_index, start, end, word): runs of anything but white space.

    Words and the gaps before them are exploded side by side, a running sum over the document's rows gives the offsets: linear
    however many words there are."""
    pattern = r"(?U)\S+"
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(t, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("word"))
    rows = docs.where(t.rlike(r"(?U)\S")).select(*keys, F.posexplode(pairs).alias("word_index", "_p"))
    before = Window.partitionBy(*keys).orderBy("word_index").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("_p.gap") + F.length("_p.word")).over(before)
    return rows.select(*keys, "word_index", (end - F.length("_p.word")).cast("int").alias("start"), end.cast("int").alias("end"), F.col("_p.word").alias("word"))


def paragraphs(text: Column) -> Column:
    """G5."""
    return F.split(text, "\n", -1)


def even_bounds(n: Column, k: int) -> Column:
    """K half-open ranges over n items, bounds rounded half to even, each at least one wide."""
    bound = lambda i: F.bround(n * i / F.lit(float(k)), 0).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(bound(i).alias("start"), F.greatest(bound(i + 1), bound(i) + 1).alias("end")))


def tokens_of(offsets: Column, start: Column, end: Column) -> Column:
    """The indices of the non-empty tokens (struct start, end) that overlap a span."""
    indexed = F.transform(offsets, lambda o, i: F.struct(o["start"].alias("start"), o["end"].alias("end"), i.alias("i")))
    return F.transform(F.filter(indexed, lambda o: (o["start"] < end) & (o["end"] > start) & (o["start"] != o["end"])), lambda o: o["i"])
