"""The scan: documents in, masked documents and job rows out; and the tools on top of it, as functions that give DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import spans as S
from ..operators import detect, segment


def scan(docs: DataFrame, pii: tuple[str, ...] = ("rules_pii",), injection: tuple[str, ...] = ("rules_injection",), policy: str = "mask") -> DataFrame:
    """Needs doc_id and text; scan_status and reason are optional.

    A document whose status isn't ok, or any document while a detector isn't ready, passes through: text unchanged, nothing counted.
    """
    if policy not in ("mask", "block"):
        raise ValueError("the policy is mask or block")
    df = detect.spread(docs)
    if "scan_status" not in df.columns:
        df = df.withColumn("scan_status", F.lit("ok"))
    if "reason" not in df.columns:
        df = df.withColumn("reason", F.lit(None).cast("string"))
    detectors = [detect.detector(n) for n in (*pii, *injection)]
    if not all(d.ready() for d in detectors):
        df = df.withColumn("scan_status", F.when(F.col("scan_status") == "ok", "models_not_ready").otherwise(F.col("scan_status")))
    active = (F.col("scan_status") == "ok") & F.col("text").isNotNull()
    kinds = {"pii": [], "injection": []}
    masked, *names = detect.fresh(df, len(detectors) + 1)
    for k, (d, name) in enumerate(zip(detectors, names)):
        df = d.spans(df, name) if all(x.ready() for x in detectors) else df.withColumn(name, S.empty(S.SPANS))
        kinds["pii" if k < len(pii) else "injection"].append(F.col(name))
    for kind, parts in kinds.items():
        found = F.concat(*parts) if parts else S.empty(S.SPANS)
        df = df.withColumn(f"{kind}_items", F.when(active, S.dedupe(found) if len(parts) > 1 else found).otherwise(S.empty(S.SPANS)))
    df = df.withColumn(masked, F.when(active, S.mask("text", F.concat("pii_items", "injection_items"))))
    blocked = (F.size("injection_items") > 0) & F.lit(policy == "block")
    return (
        df.withColumn("masked_text", F.coalesce(F.col(masked)["masked_text"], "text"))
        .withColumn("applied", F.coalesce(F.col(masked)["applied"], S.empty(S.APPLIED)))
        .withColumn("blocked", blocked)
        .withColumn("injection_policy", F.lit(policy))
        # counts are of what was found, before merging
        .withColumn("stats", F.struct(F.size("pii_items").alias("pii_count"), F.size("injection_items").alias("injection_count"), F.coalesce(F.length("text"), F.lit(0)).alias("original_length")))
        .drop(masked, *names)
    )


def type_map(items):
    """A1 within a row: map<type, n> of an array of spans."""
    kinds = lambda v: F.array_sort(F.array_distinct(F.transform(v, lambda x: x["type"])))
    return S.let(items, lambda v: F.map_from_entries(F.transform(kinds(v), lambda t: F.struct(t, F.size(F.filter(v, lambda x: x["type"] == t)).cast("bigint")))))


def safe_view(scanned: DataFrame) -> DataFrame:
    """No original text in any column."""
    both = F.concat("pii_items", "injection_items")
    bare = lambda c: F.transform(c, lambda x: x.dropFields("text"))
    n = F.size(both)
    return scanned.select(
        "doc_id", "masked_text", bare("pii_items").alias("pii_items"), bare("injection_items").alias("injection_items"), "scan_status", "reason", "blocked", "injection_policy", "stats",
        (F.size("pii_items") > 0).alias("has_pii"), (F.size("injection_items") > 0).alias("has_injection"), n.alias("detection_count"), F.when(n > 0, "mask_before_upload").otherwise("allow").alias("recommended_action"),
    )


def review_view(scanned: DataFrame) -> DataFrame:
    """For people: everything."""
    return scanned


def gate(scanned: DataFrame, binary=None) -> DataFrame:
    """Masked, clean or blocked.  Kept as it is known: neither the status nor the policy counts, only binary files are blocked."""
    is_binary = F.lit(False) if binary is None else binary
    n = F.size("pii_items") + F.size("injection_items")
    return scanned.select("*", F.when(is_binary, "blocked").when(n > 0, "masked").otherwise("clean").alias("decision"))


def job_rows(scanned: DataFrame, created_at, source: str = "prompt", file_name=None) -> DataFrame:
    """The persisted row of each document; no text in it."""
    both = F.concat("pii_items", "injection_items")
    return scanned.select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("job_id"), (F.lit(None).cast("string") if file_name is None else file_name).alias("file_name"), F.lit(source).alias("source"), created_at.cast("timestamp").alias("created_at"),
        "scan_status", "reason", "blocked", "injection_policy", F.col("stats.pii_count").alias("pii_count"), F.col("stats.injection_count").alias("injection_count"), type_map(both).alias("type_counts"),
        F.transform(both, lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["source"].alias("source"))).alias("detections"),
    )


def scan_text(spark, text: str, user_prompt: str | None = None) -> DataFrame:
    """one text."""
    return safe_view(scan(spark.createDataFrame([(0, text, user_prompt)], "doc_id bigint, text string, user_prompt string")))


def mask_text(docs: DataFrame, items: str = "items") -> DataFrame:
    """Masks given spans, detects nothing."""
    return docs.select("*", S.mask("text", F.col(items).cast(S.SPANS)).alias("_m")).select(*docs.columns, "_m.masked_text", "_m.applied")


def scan_folder(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files (path, text, scan_status); the limit counts files that were not skipped, in the order of their paths."""
    from ..operators.stats import folder

    chosen = files.where("scan_status = 'ok'").orderBy("path").limit(limit).unionByName(files.where("scan_status <> 'ok'")) if limit is not None else files
    done = scan(chosen.withColumn("doc_id", F.xxhash64("path")))
    return folder(done.select("scan_status", (F.col("stats.pii_count") + F.col("stats.injection_count")).alias("detections")))


def search_lines(docs: DataFrame, query: str, limit: int, keys: tuple[str, ...] = ("doc_id",), rules: tuple[R.Rule, ...] = R.PII_RULES + R.INJECTION_RULES) -> DataFrame:
    """The first `limit` lines that contain the query, masked by the rules; the limit comes before masking."""
    found = segment.lines(docs.where(F.col("text").contains(query)), keys=keys).where(F.col("line").contains(query)).orderBy(*keys, "line_no").limit(limit)
    return found.select(*keys, "line_no", S.mask("line", S.dedupe(S.rule_spans("line", rules)))["masked_text"].alias("line"))


def with_prompt(docs: DataFrame) -> DataFrame:
    """3.1 with a prompt: the prompt's personal data are masked by the same rules."""
    return docs.withColumn("user_prompt_masked", F.when(F.col("user_prompt").isNotNull(), S.mask("user_prompt", S.dedupe(S.rule_spans("user_prompt")))["masked_text"]))


def get_status(spark) -> DataFrame:
    """F4, F3."""
    return spark.createDataFrame(detect.status(), "name string, kind string, ready boolean")


def text_limit(docs: DataFrame, most: int = 100_000) -> DataFrame:
    """Too long a prompt is rejected, with the reason."""
    too_long = F.length("text") > most
    return docs.select("*", F.when(too_long, "unsupported").otherwise("ok").alias("scan_status"), F.when(too_long, F.concat(F.lit("more than "), F.lit(most), F.lit(" characters"))).cast("string").alias("reason"))


def _file(spark, path: str) -> DataFrame:
    """A single file, parsed; a path that leads to none is an error."""
    from ..sources import files

    rows = spark.read.format("binaryFile").load(path)
    named = rows.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), "length", "content")
    return files.parse(named.withColumn("mime_type", files.mime_type("file_name"))).withColumn("doc_id", F.xxhash64("path"))


def scan_file(spark, path: str) -> DataFrame:
    """a file's safe view, with its path."""
    done = scan(_file(spark, path))
    return safe_view(done).join(done.select("doc_id", "path"), "doc_id")


def secure_read_file(spark, path: str) -> DataFrame:
    """(path, decision, content, scan_status, reason, stats): the masked text of a document or a text file; nothing of a binary
    one."""
    from ..sources.files import file_kind

    done = gate(scan(_file(spark, path)), file_kind("file_name") == "binary")
    shut = F.col("decision") == "blocked"
    return done.select("path", "decision", F.when(shut, "").otherwise(F.col("masked_text")).alias("content"), "scan_status", F.when(shut, "a binary file's content is not given out").otherwise(F.col("reason")).alias("reason"), "stats")
