"""The activity stream: the last event of every job, and the stages of running jobs, as Structured Streaming queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a temporary one where that is unset (tests)."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='maskspan-')}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, folder: str, name: str = "*.parquet") -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 64).parquet(folder)


def last_events(events: DataFrame) -> DataFrame:
    """The state of each job is its last event; update mode emits the jobs that changed."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.event_id", "s.event_type", "s.ts")


def snapshot_from_files(spark: SparkSession, folder: str, name: str = "*.parquet", finished: tuple[str, ...] = ("purchase",)) -> DataFrame:
    """Runs the stream over the files there are; the sink is an append log that every trigger adds to, the snapshot its last
    rows.  A trigger that is repeated after a failure overwrites its own part."""
    out = shared_folder(spark)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/log/epoch={epoch:08d}")

    run = last_events(read_events(spark, folder, name)).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    run.awaitTermination()
    log = spark.read.schema("user_id bigint, event_id bigint, event_type string, ts timestamp_ntz").parquet(f"{out}/log/*")
    return jobs.snapshot(log, "user_id", F.struct("ts", "event_id"), "event_type", finished).select("user_id", "event_id", "event_type")


def sessions(events: DataFrame, timeout: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """R9 as a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", timeout).alias("w")).agg(F.count("*").alias("requests")).select("user_id", F.col("w.start").alias("loaded_at"), F.col("w.end").alias("unloaded_at"), "requests")


def dedupe(events: DataFrame, keys: list[str], ttl: str = "30 seconds") -> DataFrame:
    """R10 as a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def active_stages(events: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """(job_id, stage, phase) of (job_id, type, step, ts): a job that isn't known is started, an unknown step changes nothing,
    done or error finishes; a job that is silent for the timeout is dropped by a timer."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    stages = jobs.STAGE_OF_STEP

    def fold(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "stage": [None], "phase": ["stale"]})
            return
        stage, phase = state.get if state.exists else ("receive", "start")
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for kind, step in zip(rows["type"], rows["step"]):
            if kind in ("done", "error"):
                stage, phase = kind, "finish"
            elif not pd.isna(step) and int(step) in stages:
                stage, phase = stages[int(step)], "progress"
        if phase == "finish":
            state.remove()
        else:
            state.update((stage, phase))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "phase": [phase]})

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id string, stage string, phase string", "stage string, phase string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def frames(chunks: DataFrame, column: str = "value") -> DataFrame:
    """Server-sent events: blank lines separate frames, the data line holds JSON, broken frames go."""
    parts = chunks.select(F.explode(F.split(column, r"\r?\n\r?\n")).alias("frame"))
    data = parts.select(F.regexp_extract("frame", r"(?m)^data: ?(.*)$", 1).alias("data")).where("data <> ''")
    return data.where(F.try_parse_json("data").isNotNull())


def broadcast_frames(active: DataFrame, events: DataFrame) -> DataFrame:
    """(position, frame): a subscriber's first frame is the snapshot of the active jobs (active: job_id, phase), then the events by
    seq.  The active set is bounded by the jobs that run at a time."""
    jobs_ = active.agg(F.array_sort(F.collect_list(F.struct("job_id", "phase"))).alias("active"))
    first = jobs_.select(F.lit(0).cast("bigint").alias("position"), F.to_json(F.struct(F.lit("snapshot").alias("type"), "active")).alias("data"))
    rest = events.select(F.col("seq").cast("bigint").alias("position"), F.to_json(F.struct(F.lit("activity").alias("type"), "job_id", "phase")).alias("data"))
    return first.unionByName(rest).select("position", F.concat(F.lit("data: "), "data", F.lit("\n\n")).alias("frame"))


def broadcast_sink(path: str):
    """K10 as foreachBatch: every trigger's events as frames, in a folder of its own; one that is repeated after a failure overwrites it."""

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.to_json(F.struct("*")).alias("data"))
        rows.select(F.concat(F.lit("data: "), "data", F.lit("\n")).alias("value")).write.mode("overwrite").text(f"{path}/epoch={epoch:08d}")

    return sink
