"""Session helpers: the shared folder that survives lost executors, lineage cuts and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder named by spark.checkpoint.dir; a local session without one (tests) gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="maskspan-checkpoint-"))


#: Bytes of an Arrow batch: two tasks' batches, in the JVM and in Python, have to fit beside an executor's heap.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = spark.conf.get(name).strip().lower()
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = text.rstrip("b")
    now = int(number[:-1]) * scale[number[-1]] if number[-1:] in scale else int(number)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job wrote, whatever its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises df once in the shared checkpoint folder, so that later actions neither recompute it nor lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Bytes of a hashed relation up to which a join broadcasts it; more is joined by shuffling both sides.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """df, to be broadcast if its rows of `width` bytes, with the 40 that a hashed relation adds to each, are few enough."""
    return F.broadcast(df) if rows * (width + 40) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    return [name for k in range(n + len(have)) if (name := f"_own{k}") not in have][:n]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among the ids (doc_id bigint); rows without doc_id stay."""
    (gone,) = fresh(docs, 1)
    ids = cut(ids.select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small(ids, ids.count(), 8), docs["doc_id"].cast("bigint") == F.col(gone), "left_anti")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint edges -> (node, root), root the least node of the component.  Alternates large-star and small-star
    steps until nothing changes, O(log n) rounds, each a pair of shuffles on the edges alone; no node's neighbours are ever
    gathered in memory.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
