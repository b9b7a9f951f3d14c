"""The job history and event log: no table of it has a column of original text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORBIDDEN = {"text", "original_text", "masked_text", "content", "chunk_text"}
STAGE_OF_STEP = dict(zip((1, 2, 4, 5), "parse pii injection mask".split()))


def check_private(df: DataFrame) -> DataFrame:
    """The privacy rule of every persisted table: no text column, also not inside structs."""
    import re

    names = set(df.columns) | set(re.findall(r"(\w+):", df.schema.simpleString()))
    found = sorted(names & FORBIDDEN)
    if found:
        raise ValueError(f"a persisted table must not hold {', '.join(found)}")
    return df


def latest(log: DataFrame, key: str, *order: Column) -> DataFrame:
    """K1: of an append-only log the last row of each key; a partial maximum by key, so one row a key and task is shuffled."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def append_audit(rows: DataFrame, path: str) -> None:
    """K2."""
    check_private(rows).write.mode("append").json(path)


def write_jobs(rows: DataFrame, path: str) -> None:
    """K1 as a sink: appends; latest() reads."""
    check_private(rows).write.mode("append").parquet(path)


def numbered(log: DataFrame, key: str, *order: str) -> DataFrame:
    """O2: seq counts a key's events from 1."""
    return log.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def tail(log: DataFrame, after: int) -> DataFrame:
    """P14, R8."""
    return log.where(F.col("seq") > after)


def newest(jobs: DataFrame, n: int, *order: Column) -> DataFrame:
    """The newest n jobs: a top-k, no global window."""
    return jobs.orderBy(*order).limit(n)


def snapshot(events: DataFrame, key: str, order: Column, phase: str, finished: tuple[str, ...] = ("finish",)) -> DataFrame:
    """The last event of each key that hasn't finished."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("_r")).select(key, "_r.*")
    return last.where(~F.col(phase).isin(*finished))


def stage_of(step: Column) -> Column:
    """R2: the stage of a step; null for unknown steps."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in STAGE_OF_STEP.items() for x in pair)), step)


def progress(step: Column) -> Column:
    """Percent done by step."""
    steps = F.array(*(F.lit(k) for k in STAGE_OF_STEP))
    return F.when(F.array_contains(steps, step), F.round(100.0 * F.array_position(steps, step) / len(STAGE_OF_STEP)).cast("int"))


def running(events: DataFrame, key: str, order: list[str], change: Column) -> DataFrame:
    """The counter after each event, never below zero: a running sum less its least value so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("_s", F.sum(change).over(w))
    return summed.withColumn("active", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def busy_edges(counted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Only the rows at which busy (active > 0) changes; the state before the first is idle."""
    busy = F.col("active") > 0
    return counted.withColumn("busy", busy).withColumn("_was", F.coalesce(F.lag("busy").over(Window.partitionBy(key).orderBy(*order)), F.lit(False))).where(F.col("busy") != F.col("_was")).drop("_was")


def sessions(requests: DataFrame, key: str, ts: str, timeout: str = "10 minutes") -> DataFrame:
    """Residency sessions: each request keeps a model loaded for the timeout."""
    return requests.groupBy(key, F.session_window(ts, timeout).alias("w")).agg(F.count("*").alias("requests")).select(key, F.col("w.start").alias("loaded_at"), F.col("w.end").alias("unloaded_at"), "requests")


def dedupe_ttl(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """An event is dropped when an equal one came less than `seconds` before it."""
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(Window.partitionBy(*keys).orderBy(ts, "event_id"))
    return events.withColumn("_gap", gap).where("_gap is null or _gap >= %d" % seconds).drop("_gap")


def last_per_subscriber(events: DataFrame, key: str, order: Column, n: int = 64) -> DataFrame:
    """A bounded queue that drops its oldest: the newest n of each subscriber."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where(F.col("_n") <= n).drop("_n")


def step_events(scanned: DataFrame) -> DataFrame:
    """(doc_id, seq, type, step, done, scan_status, reason): the steps 1, 2, 4 and 5 of a scanned document, each with a start and an
    end; a document that wasn't scanned warns after the first.  There is no step 3."""
    event = lambda kind, step, done: F.struct(F.lit(kind).alias("type"), F.lit(step).cast("int").alias("step"), F.lit(done).cast("boolean").alias("done"))
    steps = lambda *numbers: [event("step", k, d) for k in numbers for d in (False, True)]
    whole, short = F.array(*steps(*STAGE_OF_STEP)), F.array(*steps(1), event("warning", None, None))
    rows = scanned.select("doc_id", "scan_status", "reason", F.posexplode(F.when(F.col("scan_status") == "ok", whole).otherwise(short)).alias("at", "e"))
    warns = F.col("e.type") == "warning"
    return rows.select("doc_id", (F.col("at") + 1).alias("seq"), "e.*", F.when(warns, F.col("scan_status")).alias("scan_status"), F.when(warns, F.col("reason")).alias("reason"))


def replay(log: DataFrame, key: str, after: int) -> DataFrame:
    """K9: of a numbered log what comes after a number, and a last row of type eof for each key that has any row."""
    rest = tail(log, after).select(key, "seq", "type")
    ends = log.groupBy(key).agg((F.max("seq") + 1).cast(log.schema["seq"].dataType).alias("seq")).withColumn("type", F.lit("eof"))
    return rest.unionByName(ends)


def from_pipeline(events: DataFrame, origin: str = "origin") -> DataFrame:
    """Only what opted in to the broadcast: scans, and no downloads."""
    return events.where(F.col(origin) == "pipeline")


def after_snapshots(events: DataFrame, subscriber: str = "subscriber") -> DataFrame:
    """(subscriber, job_id) in progress: a snapshot (active: array of job ids) replaces all that was known, events after it are folded
    onto it; (subscriber, seq, type, job_id, phase, active) of any number of subscribers.  Two shuffles by subscriber and job, no
    group is gathered."""
    last = events.where("type = 'snapshot'").groupBy(subscriber).agg(F.max_by("active", "seq").alias("active"), F.max("seq").alias("since"))
    known = last.select(subscriber, F.explode("active").alias("job_id"), F.col("since").alias("seq"), F.lit("progress").alias("phase"))
    later = events.where("type <> 'snapshot' and job_id is not null").join(last.select(subscriber, "since"), subscriber, "left").where("since is null or seq > since")
    rows = known.unionByName(later.select(subscriber, "job_id", "seq", "phase"))
    return rows.groupBy(subscriber, "job_id").agg(F.max_by("phase", "seq").alias("phase")).where("phase <> 'finish'").select(subscriber, "job_id")


def review_outcomes(opened: DataFrame, decided: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """(session_id, action, reason) of opened (session_id, opened_at) and decided (session_id, decided_at, action): a decision in time
    counts, else the session is cancelled.  The same plan serves streams with watermarks on both times: the outer join's
    time bound is the timer."""
    o, d = opened.alias("o"), decided.alias("d")
    in_time = (F.col("d.decided_at") >= F.col("o.opened_at")) & (F.col("d.decided_at") < F.col("o.opened_at") + F.expr(f"interval {timeout}"))
    both = o.join(d, (F.col("o.session_id") == F.col("d.session_id")) & in_time, "left")
    late = F.col("d.action").isNull()
    return both.select("o.session_id", F.coalesce("d.action", F.lit("cancel")).alias("action"), F.when(late, "timeout").alias("reason"))
