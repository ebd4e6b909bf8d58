"""Capture datasets: content dedupe, validation, batch counters, revisioned review labels, training snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST = 512 << 20
FAMILIES = ("PROTOCOL_FAILED", "EVSE_FAULT", "ISOLATION_FAULT", "EV_ERROR", "SESSION_ABORT", "SLAC_FAILURE", "COMM_FREEZE", "NO_POWER_DELIVERED")
# fixed values: the first four bytes of capture files
MAGICS = ("D4C3B2A1", "A1B2C3D4", "4D3CB2A1", "A1B23C4D", "0A0D0D0A")


def content_dedupe(files: DataFrame) -> DataFrame:
    """``files`` (batch, file_id, sha256) with kept (first of its content in the batch) and reused (known from an earlier batch)."""
    within = F.row_number().over(Window.partitionBy("batch", "sha256").orderBy("file_id"))
    first_batch = files.groupBy("sha256").agg(F.min("batch").alias("_first"))
    return files.withColumn("kept", within == 1).join(first_batch, "sha256").withColumn("reused", F.col("kept") & (F.col("_first") < F.col("batch"))).drop("_first")


# fixed values: ZIP methods that are read (stored, deflated), and the endings of capture files
METHODS = (0, 8)
ENDINGS = r"(?i)\.(pcap|pcapng|cap)$"


def rejection_reason(size: Column, ratio: Column, path: Column, magic: Column | None = None, encrypted: Column | None = None, linked: Column | None = None, method: Column | None = None) -> Column:
    """The first reason against a file, null for valid ones; "ignored" for files that are no captures by their ending, if they name one.

    Order: unsafe path, encrypted or linked entry, compression method, size, compression ratio above 64 KiB, first bytes.
    """
    no = F.lit(False)
    out = F.when(path.contains("..") | path.startswith("/") | path.contains("\\"), "unsafe_path")
    out = out.when(path.contains(".") & ~path.rlike(ENDINGS), "ignored")
    out = out.when((encrypted if encrypted is not None else no) | (linked if linked is not None else no), "encrypted_or_linked")
    if method is not None:
        out = out.when(~method.isin(*METHODS), "method")
    out = out.when(size <= 0, "empty").when(size > LARGEST, "too_large").when((size > 65536) & (ratio > 200), "ratio")
    return out if magic is None else out.when(~magic.isin(*MAGICS), "bad_magic")


def batch_counters(files: DataFrame) -> DataFrame:
    """(batch, files, kept, duplicates, reused, bytes, status) from deduped files with a reason column."""
    ok = F.col("reason").isNull()
    out = files.groupBy("batch").agg(F.count("*").alias("files"), F.count_if(ok & F.col("kept")).alias("kept"), F.count_if(ok & ~F.col("kept")).alias("duplicates"), F.count_if(F.col("reused")).alias("reused"), F.count_if(~ok).alias("rejected"), F.coalesce(F.sum(F.when(ok & F.col("kept"), F.col("size"))), F.lit(0)).alias("bytes"))
    return out.withColumn("status", F.when(F.col("kept") == 0, "failed").otherwise("ready"))


def current_labels(revisions: DataFrame) -> DataFrame:
    """The highest revision of each content; a family only for faults."""
    last = revisions.groupBy("sha256").agg(F.max_by(F.struct("classification", "fault_family", "reviewer"), "revision").alias("l"), F.max("revision").alias("revision"))
    return last.select("sha256", "revision", "l.classification", F.when(F.col("l.classification") == "fault", F.col("l.fault_family")).alias("fault_family"), "l.reviewer")


def label_violations(revisions: DataFrame) -> DataFrame:
    """(sha256, revision, rule) for revisions out of sequence, unknown classes, or families that do not belong."""
    before = F.lag("revision").over(Window.partitionBy("sha256").orderBy("revision"))
    fault = F.col("classification") == "fault"
    rules = F.array_compact(F.array(
        F.when(F.col("revision") != F.coalesce(before, F.lit(0)) + 1, "revision_gap"),
        F.when(~F.col("classification").isin("normal", "fault", "exclude"), "class"),
        F.when(fault & ~F.coalesce(F.col("fault_family").isin(*FAMILIES), F.lit(False)), "family"),
        F.when(~fault & F.col("fault_family").isNotNull(), "family_without_fault"),
    ))
    return revisions.withColumn("_r", rules).select("sha256", "revision", F.explode("_r").alias("rule"))


def label_progress(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(batch, contents, labelled, invalid, state) over the kept contents of each batch; a label of an unknown class is invalid and counts apart."""
    known = F.col("classification").isin("normal", "fault", "exclude")
    j = files.where("kept AND reason IS NULL").select("batch", "sha256").join(labels.select("sha256", "classification"), "sha256", "left")
    out = j.groupBy("batch").agg(F.count("*").alias("contents"), F.count_if(known).alias("labelled"), F.count_if(~known).alias("invalid"))
    return out.withColumn("state", F.when(F.col("labelled") == 0, "unlabeled").when(F.col("labelled") < F.col("contents"), "partially_reviewed").otherwise("reviewed"))


def training_snapshot(files: DataFrame, labels: DataFrame, least_share: float = 1.0) -> DataFrame:
    """(sha256, batch, classification): contents of reviewed batches, each once by the first batch, excluded ones gone."""
    ready = label_progress(files, labels).where(F.col("labelled") >= least_share * F.col("contents")).select("batch")
    chosen = files.where("kept AND reason IS NULL").join(ready, "batch", "left_semi").groupBy("sha256").agg(F.min("batch").alias("batch"))
    return chosen.join(labels.select("sha256", "classification"), "sha256").where("classification <> 'exclude'")


def store_totals(files: DataFrame) -> DataFrame:
    ok = files.where("reason IS NULL")
    unique = ok.groupBy("sha256").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    rejected = files.agg(F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return unique.agg(F.count("*").alias("contents"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).crossJoin(rejected)


def unreferenced(contents: DataFrame, references: DataFrame, manifests: DataFrame) -> DataFrame:
    """Contents that no reference names; none while any manifest is unreadable."""
    broken = manifests.where("NOT readable").agg((F.count("*") > 0).alias("_broken"))
    return contents.join(references.select("sha256"), "sha256", "left_anti").crossJoin(F.broadcast(broken)).where("NOT _broken").drop("_broken")


def next_window(day: Column) -> Column:
    return F.add_months(F.trunc(day, "MM"), 1)
