"""Duplicate passages by parsing every document relative to the whole table.

A window is WINDOW consecutive words. Its anchor is the least of the hashes of its 8-word runs, so equal
windows have equal anchors at equal places, and consecutive windows share one. The reference index is the
set of anchors that occur more than once, with the words around them hashed up to the last window that
uses them. A document is parsed anchor by anchor: while the words around its anchor also occur around
another, the factor goes on and all its windows are duplicates. At factor boundaries, where the anchor
occurs elsewhere but not all the words around it do, windows are looked up one by one; there a group of
anchors with equal surroundings sends one member only. Words under duplicate windows go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import Memo

WINDOW = 35
RUN = 8
M = np.uint64(0x9E3779B97F4A7C15)
M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_word_hash = Memo(lambda w: xxhash.xxh3_64_intdigest(w))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Passages:
    """Hashes of the passages of one text: a prefix sum of word hashes times powers of M, so any passage takes one subtraction."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        hashes = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
        powers = np.full(n + 1, M)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        inverse = np.full(n + 1, M_INVERSE)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[:n], dtype=np.uint64)))

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values, the place of the least, the first of equals."""
    least, place, size = values, np.arange(len(values)), 1
    while size * 2 <= span:
        left = least[:-size] <= least[size:]
        place = np.where(left, place[:-size], place[size:])
        least = np.where(left, least[:-size], least[size:])
        size *= 2
    shift = span - size
    if shift:
        left = least[:-shift] <= least[shift:]
        place = np.where(left, place[:-shift], place[shift:])
    return place


def anchors(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, hash of the words around it, first and last window that use it), or None if the text has no window."""
    n = len(words)
    if n < window:
        return None
    passages, run = Passages(words), min(RUN, window)
    at = np.arange(n - run + 1)
    values = passages.hashed(at, at + run)
    place = least_places(values, window - run + 1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    anchor = place[first]
    around = mixed(passages.hashed(first, last + window) ^ ((anchor - first).astype(np.uint64) << np.uint64(32)))
    return values[anchor], around, first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = common.text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("body"))


def _anchor_table(source: DataFrame, window: int) -> DataFrame:
    id_type = source.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, rows = [], []
        for i, text in enumerate(common.as_bytes(batch.column("body"))):
            if (got := anchors(text.split(), window)) is not None:
                found.append(got)
                rows.append(np.full(len(got[0]), i))
        if not found:
            return None
        rows = pa.array(np.concatenate(rows))
        columns = [_signed(np.concatenate(c)) for c in zip(*found)]
        return pa.RecordBatch.from_arrays([*columns, batch.column("id").take(rows), batch.column("th").take(rows)], ["a", "c", "lo", "hi", "id", "th"])

    return common.map_arrow(source, run, f"a bigint, c bigint, lo bigint, hi bigint, id {id_type}, th bigint")


def _same_row(left: DataFrame, right: DataFrame) -> F.Column:
    return left["id"].eqNullSafe(right["id"]) & (left["th"] == right["th"])


def _boundary_windows(source: DataFrame, probes: DataFrame, window: int) -> DataFrame:
    """(a, w, id, th, lo) for each single window that ``probes`` (id, th, a, lo, hi) name."""
    id_type = source.schema["id"].dataType.simpleString()
    asked = probes.groupBy("id", "th").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("asked"))
    texts = source.join(asked, _same_row(source, asked)).select(source["id"], source["th"], "body", "asked").dropDuplicates(["id", "th"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for i, (text, asked) in enumerate(zip(common.as_bytes(batch.column("body")), batch.column("asked").to_pylist())):
            a, lo, hi = (np.array([x[k] for x in asked], np.int64) for k in ("a", "lo", "hi"))
            n = hi - lo + 1
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            parts.append((np.repeat(a, n), Passages(text.split()).hashed(start, start + window), np.full(len(start), i), start))
        a, w, i, start = (np.concatenate(x) for x in zip(*parts))
        rows = pa.array(i)
        return pa.RecordBatch.from_arrays([_signed(a), _signed(w), batch.column("id").take(rows), batch.column("th").take(rows), _signed(start)], ["a", "w", "id", "th", "lo"])

    return common.map_arrow(texts, run, f"a bigint, w bigint, id {id_type}, th bigint, lo bigint")


def duplicate_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, lo, hi): ranges of window starts whose windows also start elsewhere; th is the text's hash."""
    source = _source(docs, id_col, text_col)
    table, table_path = common.written(_anchor_table(source, window), "anchors")
    # small sides are written first: joins with them are then plain ones, whose hot anchors Spark may split
    often, _ = common.written(table.groupBy("a").count().where("count > 1").select("a"), "often")
    index, _ = common.written(table.join(often, "a", "left_semi"), "index")
    common.drop_path(docs.sparkSession, table_path)
    around, _ = common.written(index.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "lo", "hi")).alias("one")), "around")
    shared = around.where("n > 1").select("a", "c")
    factors = index.join(shared, ["a", "c"], "left_semi").select("id", "th", "lo", "hi")
    mixed_anchors, _ = common.written(around.groupBy("a").count().where("count > 1").select("a"), "mixed-anchors")
    probes = around.join(mixed_anchors, "a", "left_semi").select("one.id", "one.th", "a", "one.lo", "one.hi")
    single, _ = common.written(_boundary_windows(source, probes, window), "windows")
    known, _ = common.written(single.groupBy("a", "w").count().where("count > 1").select("a", "w"), "known-windows")
    boundaries = single.join(known, ["a", "w"], "left_semi").select("id", "th", "lo", F.col("lo").alias("hi"))
    return factors.unionByName(boundaries)


def remove_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words that stay, joined by one blank).

    Every word under a window of ``window`` words that also starts elsewhere goes, in all its places. Null
    and empty texts have no words; texts shorter than a window stay. Rows that repeat id and text are
    copies of each other. Empty tables give empty tables. Columns of these three names are replaced.
    """
    spans = duplicate_windows(docs, id_col, text_col, window)
    spans = spans.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    text = common.text_or_empty(text_col)
    others = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    joined = rows.join(spans, _same_row(rows, spans), "left").select("row", "spans")
    body = joined.select("row", F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).alias("body"), "spans")
    row_type = body.schema["row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, kept = [], [], []
        for text, spans in zip(common.as_bytes(batch.column("body")), batch.column("spans").to_pylist()):
            words = text.split()
            stays = np.ones(len(words), bool)
            if spans:
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, [s["lo"] for s in spans], 1)
                np.add.at(edges, [s["hi"] + window for s in spans], -1)
                stays = np.cumsum(edges[:-1]) == 0
                words = [w for w, s in zip(words, stays.tolist()) if s]
            counts.append(len(stays))
            removed.append(len(stays) - len(words))
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept_text"])

    return common.map_arrow(body, run, f"row {row_type}, n_words bigint, n_removed bigint, kept_text string").select("row.*", "n_words", "n_removed", "kept_text")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return remove_duplicate_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
