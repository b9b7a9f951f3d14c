"""Small sources and sinks: the job store, gazetteer files, labelled records, and path resolution."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.jobs import check_private


def resolve(path: str, root: str) -> str:
    """An absolute path without dots; a relative one is below the root."""
    return posixpath.normpath(path if path.startswith("/") or "://" in path else posixpath.join(root, path))


def read_jobs(spark: SparkSession, path: str, key: str = "job_id", order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The job store, each job's last row; a store that was never written gives no rows."""
    from ..operators.jobs import latest

    schema = "job_id string, file_name string, source string, created_at timestamp, scan_status string, reason string, blocked boolean, injection_policy string, pii_count int, injection_count int, type_counts map<string,bigint>, detections array<struct<type:string,start:int,end:int,source:string>>"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path) if hasattr(spark, "_jvm") else None
    if folder is not None and not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return latest(check_private(spark.read.parquet(path)), key, *(F.col(c) for c in order))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """{"exact": {label: [forms]}, "suffix": {label: [suffixes]}} files as (kind, label, pattern, rank); a suffix's rank is its place
    in the list."""
    lists = "map<string,array<string>>"
    rows = spark.read.schema(f"exact {lists}, suffix {lists}").json(path, multiLine=True)
    out = None
    for kind in ("exact", "suffix"):
        each = rows.select(F.explode(kind).alias("label", "forms")).select(F.lit(kind).alias("kind"), "label", F.posexplode("forms").alias("at", "pattern")).select("kind", "label", "pattern", (F.col("at") + 1).alias("rank"))
        out = each if out is None else out.unionByName(each)
    return out


def gazetteer_document(patterns: DataFrame) -> DataFrame:
    """One row with the two maps, each label's patterns by rank.  A gazetteer is a configuration file, so it may be one row."""
    lists = patterns.groupBy("kind", "label").agg(F.array_sort(F.collect_list(F.struct("rank", "pattern"))).alias("l")).select("kind", "label", F.transform("l", lambda x: x["pattern"]).alias("forms"))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("label", "forms"))))).alias(kind)
    return lists.agg(of("exact"), of("suffix"))


def write_gazetteer(patterns: DataFrame, path: str) -> None:
    gazetteer_document(patterns).coalesce(1).write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema with a name; blank lines are none.  A record without a name is called after its line: row0, row1 and so
    on, blank lines counted.  An evaluation set is small, so each file's lines may be numbered by one task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    numbered = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).where(F.col("value").rlike(r"\S"))
    rows = numbered.select(F.from_json("value", schema).alias("r"), "n").select("r.*", "n")
    return rows.withColumn("name", F.coalesce("name", F.concat(F.lit("row"), F.col("n").cast("string")))).drop("n")
