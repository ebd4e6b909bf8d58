"""All links between texts whose sets of k-word shingles have a given Jaccard similarity, by a prefix-filtered join.

Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each, n its size, in any order
that holds for all sets. The order is by hash, shingles that many texts share last, so buckets of one shingle
stay small; which ones are last comes from a sample of texts and changes the work, never the links.

It completes what a caller has joined already: a bucket, the sets that share a shingle, whose members are all
joined is left alone. In the others members are first compared with up to four of their own bucket that they are not
joined with, and then, where this leaves several parts, across parts where sizes and places in the order leave the
similarity possible. One of the four is the bucket's center, the set with the fewest shingles before the shared one:
of copies of a text, with words of their own that come first in the order, it is the text or the copy closest to it.
Copies of its size that are not similar to it have so many shingles of their own that places rule the others out too.
So near copies of one text cost a number of comparisons in proportion to their number. A group without such a
center, whose copies are all just below the similarity of one another, still costs its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import Memo
from .substring import M, mixed

SAMPLE_SHARE = 16  # one text in so many is counted
HOT_COUNT = 3  # from so many of the counted texts on, a shingle is ordered last
BINS = 128
HOT_MOST = 500_000

_word = Memo(xxhash.xxh3_64_intdigest)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles, A-Z lower-cased; up to k words are one shingle."""
    words = text.lower().split() or [b""]
    h = np.fromiter(map(_word.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * M + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(out))


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit name for a set, as a signed long."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def prefix(shingles: np.ndarray, hot: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, of which similar sets share one."""
    if len(hot):
        last = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[: len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1]


def _hot_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts share, at most HOT_MOST."""
    part = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_SHARE)) == 0).select("body")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, k) for t in common.as_bytes(batch.column("body"))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["s"])

    counts, path = common.written(common.map_arrow(part, run, "s bigint").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_COUNT), "shared-shingles")
    least, held = None, 0
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        if (held := held + r.c) > HOT_MOST:
            break
        least = r.n
    hot = np.empty(0, np.uint64)
    if least is not None:
        hot = np.sort(counts.where(F.col("n") >= least).select("s").toArrow().column("s").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64))
    common.drop_path(docs.sparkSession, path)
    return hot


def keyed_sets(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(id, fp, code, n, bins, first) per (id, body): the set's name, SimHash, size, its shingles counted by the first bits
    of their hashes, and its first shingles; rows with a null id have none of these."""
    shared = docs.sparkSession.sparkContext.broadcast(_hot_shingles(docs, k))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hot = shared.value
        sets = [shingle_set(t, k) for t in common.as_bytes(batch.column("body"))]
        codes = np.fromiter(map(common.majority_bits, sets), np.uint64, len(sets)).view(np.int64)
        first = [prefix(s, hot, similarity).view(np.int64) if known else [] for s, known in zip(sets, batch.column("id").is_valid().to_pylist())]
        bins = [np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BINS).astype(np.int32) for s in sets]
        columns = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array(codes), pa.array(list(map(len, sets)), pa.int32()), pa.array(bins, pa.list_(pa.int32())), pa.array(first, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "fp", "code", "n", "bins", "first"])

    return common.map_arrow(docs, run, f"id {id_type}, fp bigint, code bigint, n int, bins array<int>, first array<bigint>")


def _possible(a: str, b: str, similarity: float):
    """True where sets of these sizes that first meet at these places can be similar."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (most >= similarity / (1 + similarity) * (na + nb) - 1e-6) & (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-6)


def _plausible(keyed: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` whose bins leave the similarity possible: sets share at most the lesser count of each bin. A set that many rows have counts once."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    known, path = common.written(keyed.where("id is not null").join(named, "fp", "left_semi").select("fp", "n", "bins").dropDuplicates(["fp"]), "bins")
    side = lambda x: known.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.aggregate(F.zip_with("binsa", "binsb", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    found, _ = common.written(j.where(most >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b"), "plausible-pairs")
    common.drop_path(keyed.sparkSession, path)
    return found


def verified(docs: DataFrame, keyed: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of the written ``pairs`` (a, b) of names whose sets have the similarity.

    One text stands for each name. What names the texts and pairs is written first, so Spark knows its size: while it is
    small it is broadcast and texts stay where they are, beyond that it is shuffled. Only the sets of a pair's two ends
    meet. Links may repeat where an id repeats.
    """
    pairs = _plausible(keyed, pairs, similarity)
    ends, _ = common.written(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp")), "ends")
    wanted = keyed.where("id is not null").join(ends.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id"))
    wanted, _ = common.written(wanted.select("id").distinct(), "wanted")
    bodies = docs.join(wanted, "id", "left_semi").select("body")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, k) for t in common.as_bytes(batch.column("body"))]
        return pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "set"])

    sets = common.map_arrow(bodies, run, "fp bigint, set array<bigint>")
    both = sets.join(ends, "fp").groupBy("a", "b").agg(F.min("set").alias("x"), F.max("set").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where("x <> y").where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _ordered(a: F.Column, b: F.Column) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends ``links`` do not join."""
    roots, _ = common.written(common.components(links), "roots")
    for x in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    return pairs.where("ra <> rb").select("a", "b")


def completed_links(docs: DataFrame, keyed: DataFrame, links: DataFrame, k: int, similarity: float) -> DataFrame:
    """``links`` (a, b) between names in ``keyed``, and more: the closure of all is that of all pairs of the similarity."""

    def placed(links: DataFrame, rows: DataFrame) -> DataFrame:
        roots, _ = common.written(common.components(links).select(F.col("node").alias("d"), F.col("root").alias("r")), "roots")
        return rows.join(roots, "d", "left").withColumn("r", F.coalesce("r", "d"))

    def open_buckets(entries: DataFrame, key: str) -> DataFrame:
        """Buckets whose members are not all joined; numbers only, so they are combined before the shuffle."""
        return common.written(entries.groupBy(key).agg(F.min("r").alias("r0"), F.max("r").alias("r1")).where("r0 < r1").select(key), "buckets")[0]

    rows = placed(links, keyed.where("size(first) > 0").select(F.col("fp").alias("d"), "n", "first"))
    # all entries are shuffled here only: by a short hash of the shingle first, which may open a bucket too many
    entries = rows.select("d", "n", F.posexplode("first").alias("pos", "s"), "r").withColumn("q", F.hash("s"))
    near, near_path = common.written(entries.join(open_buckets(entries.select("q", "r"), "q"), "q", "left_semi").drop("q"), "entries")
    members, members_path = common.written(near.join(open_buckets(near, "s"), "s", "left_semi"), "members")
    common.drop_path(docs.sparkSession, near_path)

    me = F.struct("d", "n", "pos", "r")
    heads = members.groupBy("s").agg(F.min(me).alias("low"), F.max(me).alias("high"), F.min(F.struct(F.xxhash64("d").alias("h"), me.alias("m"))).alias("any"), F.min(F.struct("pos", me.alias("m"))).alias("center"))
    heads, heads_path = common.written(heads.select("s", F.array_distinct(F.array("low", "high", "any.m", "center.m")).alias("c")), "heads")
    star = members.select("s", me.alias("m")).join(heads, "s").select("m", F.explode("c").alias("c")).where(F.col("m.r") != F.col("c.r"))
    star = star.where(_possible("m", "c", similarity)).groupBy(F.col("m.d").alias("d"), F.col("c.d").alias("c")).agg(F.count("*").alias("n"))
    star, star_path = common.written(star, "star")
    stars, _ = common.written(star.select(*_ordered(F.col("d"), F.col("c"))).distinct(), "stars")
    # each set is compared with the one that it meets most often; then only pairs that this has not joined
    first = star.groupBy("d").agg(F.max(F.struct("n", "c")).alias("m")).select(*_ordered(F.col("d"), F.col("m.c"))).distinct()
    first, _ = common.written(first, "first-pairs")
    common.drop_path(docs.sparkSession, star_path)
    found, _ = common.written(links.unionByName(verified(docs, keyed, first, k, similarity)), "links")
    second, _ = common.written(_apart(stars.join(first, ["a", "b"], "left_anti"), found), "second-pairs")
    found, _ = common.written(found.unionByName(verified(docs, keyed, second, k, similarity)), "links")

    again = placed(found, members.drop("r"))
    again, again_path = common.written(again.join(open_buckets(again, "s"), "s", "left_semi").select("s", me.alias("m")), "placed")
    other = again.select("s", F.col("m").alias("c"))
    rest = again.join(other, (again.s == other.s) & (F.col("m.r") < F.col("c.r")) & _possible("m", "c", similarity))
    rest = rest.select(*_ordered(F.col("m.d"), F.col("c.d"))).distinct().join(stars, ["a", "b"], "left_anti")
    rest, _ = common.written(rest, "pairs")
    for path in (members_path, heads_path, again_path):
        common.drop_path(docs.sparkSession, path)
    return found.unionByName(verified(docs, keyed, rest, k, similarity))
