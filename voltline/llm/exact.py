"""Exact duplicates by content-defined chunk recipes.

A text without ASCII white space is cut where a rolling hash of its last 16 bytes hits a pattern, so
equal passages are cut alike. A chunk's identifier is its SHA-256, verified: all chunks of one digest
must have the same bytes, which is checked over one copy of each chunk per map task. A document is then
its ordered list of identifiers, and only these lists meet in the comparison of documents; texts do not
move again. A digest that fails the check is replaced in the lists by the chunk itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 16
LEAST_CHUNK = 512
MOST_CHUNK = 16384
CUT_MASK = np.uint32(0x7FF << 20)  # one place in 2,048
MULTIPLIER = 2654435761
MOST_CLASHES = 10_000


def normalised(text: bytes) -> bytes:
    return b"".join(text.split())


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places p where the hash of the WINDOW bytes before p hits the mask, by doubling the hashed span."""
    h, power = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2246822519), MULTIPLIER
    span = 1
    while span < WINDOW:
        if len(h) <= span:
            return np.empty(0, np.int64)
        h = h[span:] + h[:-span] * np.uint32(power)
        power = power * power % 2**32
        span *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return np.flatnonzero((h & CUT_MASK) == 0) + WINDOW


def chunk_ends(n: int, places: list[int]) -> list[int]:
    """Chunk ends of a text of n bytes from its candidate places, none shorter than LEAST_CHUNK but the last, none longer than MOST_CHUNK."""
    ends, start = [], 0
    for p in places:
        while p - start > MOST_CHUNK:
            start += MOST_CHUNK
            ends.append(start)
        if p - start >= LEAST_CHUNK and p < n:
            ends.append(p)
            start = p
    while n - start > MOST_CHUNK:
        start += MOST_CHUNK
        ends.append(start)
    if n > start:
        ends.append(n)
    return ends


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each normalised text; empty texts have none."""
    out = []
    for text in texts:
        places = cut_places(np.frombuffer(text, np.uint8)).tolist() if len(text) > LEAST_CHUNK else []
        start, parts = 0, []
        for end in chunk_ends(len(text), places):
            parts.append(text[start:end])
            start = end
        out.append(parts)
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.sha256(chunk).digest()[:size]


def clashing_digests(docs: DataFrame, text_col: str = "text", digest_bytes: int = 32) -> list[bytes]:
    """Digests under which different chunks hide; none is expected at 32 bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {c for parts in chunks([normalised(t) for t in common.as_bytes(batch.column(0))]) for c in parts}
        contents = list(found)
        return pa.RecordBatch.from_arrays([pa.array([_digest(c, digest_bytes) for c in contents], pa.binary()), pa.array(contents, pa.binary())], ["digest", "chunk"])

    table = common.map_arrow(docs.select(F.col(text_col).cast("string")), run, "digest binary, chunk binary")
    different = table.groupBy("digest", "chunk").count().groupBy("digest").count().where("count > 1")
    found = [bytes(r.digest) for r in different.limit(MOST_CLASHES + 1).collect()]
    if len(found) > MOST_CLASHES:
        raise ValueError("the digest is too short for this table")
    return found


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clashes: list[bytes] = (), digest_bytes: int = 32) -> DataFrame:
    """(id, n_points, text_sha256, recipe) per row; recipe is the ordered list of chunk identifiers."""
    source = docs.select(F.col(id_col).alias("id"), F.char_length(common.text_or_empty(text_col)).cast("bigint").alias("n_points"), F.col(text_col).cast("string").alias("body"))
    id_type = source.schema["id"].dataType.simpleString()
    unsafe = frozenset(clashes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normalised(t) for t in common.as_bytes(batch.column("body"))]
        lists = []
        for parts in chunks(texts):
            digests = [_digest(c, digest_bytes) for c in parts]
            lists.append([b"\x01" + c if d in unsafe else b"\x00" + d for c, d in zip(parts, digests)])
        columns = [batch.column("id"), batch.column("n_points"), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(lists, pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_points", "text_sha256", "recipe"])

    return common.map_arrow(source, run, f"id {id_type}, n_points bigint, text_sha256 string, recipe array<binary>")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without ASCII white space; null counts as empty, and all empty texts are
    one group. The longest original text (code points) stays, then the smallest id, null ids last. Rows
    that repeat both id and text are one document in several rows: kept marks all of them. Empty tables
    give empty tables; further columns are ignored.
    """
    clashes = clashing_digests(docs, text_col, digest_bytes)
    rows, _ = common.written(recipes(docs, id_col, text_col, clashes, digest_bytes), "recipes")
    best = F.struct((-F.col("n_points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id"))
    # written first: the join is then a plain one, whose hot recipes Spark may split
    groups, _ = common.written(rows.groupBy("recipe").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
    joined = rows.join(groups, "recipe")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_points") == -F.col("best.p"))
    return joined.select("id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat id and text stay once.

    Null and empty texts are one group. Of rows of one id whose texts differ in white space only, the longest stays,
    of equals the least row. Null ids stay only where their group has no other. Empty tables give empty tables;
    columns may have any names.
    """
    key, bare_hash = (_free(docs, name) for name in ("key", "hash"))
    kept = duplicate_groups(docs, id_col, text_col).where("kept")
    kept = kept.select(F.xxhash64("id", "text_sha256").alias(key), F.col("text_sha256").alias(bare_hash)).distinct()
    bare = F.translate(common.text_or_empty(text_col), " \t\n\x0b\f\r", "")
    keyed = docs.withColumn(bare_hash, F.sha2(bare, 256)).withColumn(key, F.xxhash64(id_col, bare_hash))
    row = F.struct((-F.char_length(common.text_or_empty(text_col))).alias("n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(kept, [key, bare_hash], "left_semi").groupBy(key, bare_hash).agg(F.min(row).alias("one")).select("one.row.*")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_groups(common.documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS p, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(bare) AS text_sha256
FROM d WINDOW w AS (PARTITION BY bare ORDER BY p DESC, doc_id)
"""
