"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HELD_OUT_RESIDUE = 1
SAMPLE_ROWS = 3000


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for rows whose labels no training may see; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == HELD_OUT_RESIDUE, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) of both classes, in hash order of the id; never held-out rows.

    The ids, at most ``rows`` of them, are the small side of the join; only the chosen texts reach the driver.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", common.text_or_empty().alias("body")).join(F.broadcast(chosen), "doc_id")
    found = texts.groupBy("doc_id").agg(F.min(F.struct("body", "y")).alias("one")).select("doc_id", "one.*").collect()
    return [(r.body, r.y) for r in sorted(found, key=lambda r: r.doc_id)]
