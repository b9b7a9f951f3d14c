"""Statistics over jobs, spans and events.  Every function takes its instant (`as_of`) as a parameter: results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let


def type_counts(spans: DataFrame, *keys: str) -> DataFrame:
    """A1: one row a key: type_counts map<type, n>; two aggregations on the same key prefix."""
    counted = spans.groupBy(*keys, "type").agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "_n")))).alias("type_counts"))


def totals(jobs: DataFrame) -> DataFrame:
    """A2."""
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return jobs.agg(F.count("*").alias("jobs"), some("pii_count"), some("injection_count"))


def periods(jobs: DataFrame, as_of: Column) -> DataFrame:
    """A3: today (since midnight), 7 and 30 days (rolling), all time: one scan."""
    since = {"today": F.date_trunc("day", as_of), "week": as_of - F.expr("interval 7 days"), "month": as_of - F.expr("interval 30 days"), "all": None}
    marked = F.array(*(F.struct(F.lit(k).alias("period"), (F.lit(True) if t is None else F.col("created_at") >= t).alias("inside")) for k, t in since.items()))
    rows = jobs.select("pii_count", "injection_count", F.explode(marked).alias("p"))
    inside = lambda x: F.sum(F.when(F.col("p.inside"), x).otherwise(0)).cast("bigint")
    return rows.groupBy(F.col("p.period").alias("period")).agg(inside(F.lit(1)).alias("jobs"), inside(F.col("pii_count")).alias("pii_count"), inside(F.col("injection_count")).alias("injection_count"))


def trend(jobs: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """A4: (date MM-DD, pii, injection) for each of the last days, without gaps; the spine has `days` rows, a broadcast of known size."""
    spine = jobs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(as_of.cast("date"), days - 1), as_of.cast("date"))).alias("day"))
    sums = jobs.where(F.col("created_at").cast("date") >= F.date_sub(as_of.cast("date"), days - 1)).groupBy(F.col("created_at").cast("date").alias("d")).agg(F.sum("pii_count").alias("p"), F.sum("injection_count").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return spine.join(sums, F.col("day") == F.col("d"), "left").select(F.date_format("day", "MM-dd").alias("date"), zero("p").alias("pii"), zero("i").alias("injection"))


def trend_share(trended: DataFrame) -> DataFrame:
    """The trend relative to its maximum; over `days` rows, so one partition is right."""
    top = F.greatest(F.max(F.greatest("pii", "injection")).over(Window.partitionBy()), F.lit(1))
    return trended.select("*", F.round(F.col("pii") / top, 6).alias("pii_share"), F.round(F.col("injection") / top, 6).alias("injection_share"))


def group_items(items: DataFrame, *keys: str) -> DataFrame:
    """Items by type, most frequent first, ties by first occurrence; needs idx, type and masked."""
    grouped = items.groupBy(*keys, "type").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.count_if("masked").alias("masked_n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_idx")
    return grouped.withColumn("position", F.row_number().over(order))


def folder(files: DataFrame) -> DataFrame:
    """Of one row a file (scan_status, detections)."""
    found = F.coalesce(F.sum("detections"), F.lit(0))
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("scan_status") != "ok").alias("skipped"), found.cast("bigint").alias("detections"), F.when(found > 0, "mask_before_upload").otherwise("allow").alias("recommended_action"))


def badge(n: Column) -> Column:
    """A9."""
    return F.when(n > 99, "99+").when(n > 0, n.cast("string")).otherwise("")


def latencies(runs: DataFrame) -> DataFrame:
    """A10: the median of repeated runs, and the first, by document."""
    return runs.groupBy("doc").agg(F.min_by("ms", "run").alias("first_ms"), F.median(F.when(F.col("run") > 0, F.col("ms"))).alias("warm_ms"))


def speedups(stages: DataFrame) -> DataFrame:
    """(position, stage, total_ms) with the speed-up over the stage before and over the first; a handful of rows."""
    w = Window.partitionBy().orderBy("position")
    return stages.select("position", "stage", "total_ms", F.round(F.lag("total_ms").over(w) / F.col("total_ms"), 4).alias("vs_previous"), F.round(F.first("total_ms").over(w) / F.col("total_ms"), 4).alias("vs_first"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """A12; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def drift(pairs: DataFrame) -> DataFrame:
    """(label_a, label_b, score_a, score_b) -> flip rate, mean and largest difference."""
    d = F.abs(F.col("score_a") - F.col("score_b"))
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label_a") != F.col("label_b")).cast("int")), 6).alias("flip_rate"), F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.max(d), 6).alias("max_delta"))


def quality(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Tp, fp, fn, precision, recall, F1."""
    counts = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def risk(fpr: Column, fnr: Column) -> Column:
    """A15."""
    return 0.25 * fpr + 0.75 * fnr


def best_bias(scored: DataFrame, biases: list[float]) -> DataFrame:
    """The bias of least risk for (score, actual); the grid is a literal, so no join."""
    rows = scored.select("actual", F.explode(F.array(*(F.struct(F.lit(float(b)).alias("bias"), (F.col("score") + b > 0).alias("hit")) for b in biases))).alias("x"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    hit, actual = F.col("x.hit"), F.col("actual")
    by = rows.groupBy(F.col("x.bias").alias("bias")).agg(rate(hit & ~actual, ~actual).alias("fpr"), rate(~hit & actual, actual).alias("fnr"))
    return by.select("bias", risk(F.col("fpr"), F.col("fnr")).alias("risk")).agg(F.min_by("bias", F.struct("risk", "bias")).alias("bias"), F.min("risk").alias("risk"))


def softmax(logits: Column, bias: Column | float = 0.0, biased: int = 0) -> Column:
    """Probabilities of logits after a bias on one of them.  The maximum and the total are reckoned once a row: inside the lambdas
    they would be reckoned for every number, within each other, and cost the cube of the width."""
    moved = F.transform(logits, lambda x, i: x + F.when(i == biased, F.lit(bias)).otherwise(0.0))
    powers = let(moved, lambda m: let(F.array_max(m), lambda top: F.transform(m, lambda x: F.exp(x - top))))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def sample_seed(key: Column, seed: int) -> Column:
    """The first eight bytes of SHA-256 as a number, xor a seed, modulo 2^32."""
    low = F.conv(F.substring(F.sha2(key, 256), 9, 8), 16, 10).cast("bigint")
    return low.bitwiseXOR(F.lit(seed & 0xFFFFFFFF).cast("bigint"))


def vote(spans: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Spans that at least so many seeds found."""
    return spans.groupBy(*keys).agg(F.count_distinct("seed").alias("seeds")).where(F.col("seeds") >= least)
