"""SimHash near-duplicates through one Gray-order hierarchical index over the whole table.

The distinct fingerprints are sorted by Gray rank, which puts codes with long common patterns side by side, and cut
into ranges: the chunks. Every node of the tree holds the bits that all codes below it share (mask and pattern). The
upper nodes stand over the chunks; there are at most MOST_CHUNKS chunk roots, so they go to every task. A query walks
down from the top and leaves a node, with all its codes, as soon as its differences on the shared bits exceed the
radius; chunks that it reaches receive it, and go on with the lower nodes, which each chunk builds from its own codes.
A query only looks ahead in rank, so every pair is met once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard

FANOUT = 8
RADIUS = 3
SHINGLE_WORDS = 3
PAIRS_AT_ONCE = 400_000
CHUNK_CODES = 1 << 20  # 16 MB
LEAST_CHUNKS, MOST_CHUNKS = 64, 4096  # roots of chunks that are broadcast
QUERIES_A_CODE = 16  # a chunk with more queries for each of its codes is dealt to several tasks


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: A-Z lower-cased, k-word shingles with repeats, XXH64 seed 42; a bit is set where over half the hashes set it. No words: 0."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= k:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
        shingles = [joined[s:e] for s, e in zip(starts.tolist(), ends[k - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    return common.majority_bits(np.fromiter((digest(s, 42) for s in shingles), "<u8", len(shingles)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) per row; ``fp`` is the fingerprint's 64 bits as a signed long. Null text counts as empty."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, k) for t in common.as_bytes(batch.column("body"))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return common.map_arrow(source, run, f"id {id_type}, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_key(code: str = "fp") -> F.Column:
    """The Gray rank of a code as a long whose signed order is that of the ranks."""
    rank = F.col(code)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


class GrayIndex:
    """A tree over leaves in Gray order. A leaf is a code, or a node further down given by its shared bits."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray | None = None):
        n = len(pattern)
        mask = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)) if mask is None else mask
        self.levels = [(pattern, mask, np.arange(n), np.arange(1, n + 1))]  # pattern, mask, first and last-plus-one child
        self.spans = [(np.arange(n), np.arange(1, n + 1))]  # leaves below each node
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1][:2]
            starts = np.arange(0, len(pattern), FANOUT)
            ends = np.append(starts[1:], len(pattern))
            head = np.repeat(pattern[starts], ends - starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~np.bitwise_or.reduceat(pattern ^ head, starts)
            first, last = self.spans[-1]
            self.levels.append((pattern[starts], shared, starts, ends))
            self.spans.append((first[starts], last[ends - 1]))

    def chained(self, radius: int) -> np.ndarray:
        """Places i for which leaves i and i + 1 lie below one node whose codes differ in at most ``radius`` bits."""
        edges = np.zeros(len(self.levels[0][0]) + 1, np.int64)
        for (_, mask, _, _), (first, last) in zip(self.levels[1:], self.spans[1:]):
            tight = np.bitwise_count(~mask) <= radius
            np.add.at(edges, first[tight], 1)
            np.add.at(edges, last[tight] - 1, -1)
        return np.flatnonzero(np.cumsum(edges)[:-1] > 0)

    def search(self, queries: np.ndarray, first: np.ndarray, radius: int, whole_nodes: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) places within the radius on the leaf's bits, leaves from ``first`` of each query on.

        With ``whole_nodes``, a node all of whose codes lie within the radius of the query and of one another
        gives its last leaf only; ``chained`` connects the others to it.
        """
        if not len(self.levels[0][0]):
            return
        step = max(1, PAIRS_AT_ONCE // FANOUT // 4)
        for at in range(0, len(queries), step):
            query = np.arange(at, min(at + step, len(queries)))
            todo = [(len(self.levels) - 1, query, np.zeros(len(query), np.int64))]
            while todo:
                level, query, node = todo.pop()
                if len(query) > PAIRS_AT_ONCE:
                    half = len(query) // 2
                    todo += [(level, query[:half], node[:half]), (level, query[half:], node[half:])]
                    continue
                pattern, mask, child, past = self.levels[level]
                end = self.spans[level][1]
                differences = np.bitwise_count((queries[query] ^ pattern[node]) & mask[node])
                near = (differences <= radius) & (end[node] > first[query])
                query, node, differences = query[near], node[near], differences[near]
                if not len(query):
                    continue
                if level == 0:
                    yield query, node
                    continue
                if whole_nodes:
                    whole = differences.astype(int) + np.bitwise_count(~mask[node]) <= radius
                    if whole.any():
                        yield query[whole], end[node[whole]] - 1
                        query, node = query[~whole], node[~whole]
                n = past[node] - child[node]
                children = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(child[node], n)
                todo.append((level - 1, np.repeat(query, n), children))


def _forest(pairs: Iterator[tuple[int, int]], above: dict[int, int]) -> Iterator[tuple[int, int]]:
    """The pairs that join two parts of what ``above`` connects so far."""

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            yield a, b


def _chunked(codes: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(fp, g, chunk): ``chunk`` is the range between two of the ``cuts`` that holds the rank; equal ranks lie in one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        chunk = np.searchsorted(cuts, batch.column("g").to_numpy(zero_copy_only=False), side="right")
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk.astype(np.int32))], ["fp", "g", "chunk"])

    return common.map_arrow(codes, run, "fp bigint, g bigint, chunk int", rows=10_000)


def _routed(index: DataFrame, roots: list, radius: int) -> DataFrame:
    """(chunk, fp, g) for each chunk, the code's own or a later one, whose root the code reaches through the upper nodes."""
    unsigned = lambda name: np.array([r[name] for r in roots], np.int64).view(np.uint64)
    pattern, mask = unsigned("pattern"), unsigned("mask")
    chunk_of = np.array([r.chunk for r in roots], np.int32)
    upper = index.sparkSession.sparkContext.broadcast((pattern, mask, chunk_of))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        pattern, mask, chunk_of = upper.value
        codes = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        own = np.searchsorted(chunk_of, batch.column("chunk").to_numpy(zero_copy_only=False))
        found = list(GrayIndex(pattern, mask).search(codes, own, radius))
        if not found:
            return None
        query, leaf = (np.concatenate(x) for x in zip(*found))
        rows = pa.array(query)
        return pa.RecordBatch.from_arrays([pa.array(chunk_of[leaf]), batch.column("fp").take(rows), batch.column("g").take(rows)], ["chunk", "fp", "g"])

    return common.map_arrow(index, run, "chunk int, fp bigint, g bigint", rows=10_000)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, spanning: bool = True, chunk_codes: int = CHUNK_CODES) -> DataFrame:
    """Links (a, b) between distinct fingerprints in column ``fp`` that differ in at most ``radius`` bits.

    ``spanning``: each task returns only links that connect parts of its own (their closure is that of all
    links); otherwise every link is returned once. Null fingerprints link to nothing.
    """
    spark = fps.sparkSession
    n_chunks = min(MOST_CHUNKS, max(LEAST_CHUNKS, -(-fps.count() // chunk_codes)))
    codes, _ = common.written(fps.where("fp is not null").select("fp").distinct().withColumn("g", gray_key()), "gray-codes")
    cuts = codes.agg(F.percentile_approx("g", [i / n_chunks for i in range(1, n_chunks)], 10 * n_chunks)).first()[0] or []
    index, _ = common.written(_chunked(codes, np.unique(np.array(cuts, np.int64))), "gray-index")
    shared = F.bitwise_not(F.bit_and("fp").bitwiseXOR(F.bit_or("fp")))
    roots = index.groupBy("chunk").agg(F.bit_and("fp").alias("pattern"), shared.alias("mask")).orderBy("chunk").collect()  # at most MOST_CHUNKS rows
    routed, _ = common.written(_routed(index, roots, radius), "gray-queries")
    size = lambda df: df.groupBy("chunk").agg(F.count("*").alias("n"))
    parts = size(routed).withColumnRenamed("n", "q").join(size(index), "chunk").select("chunk", F.ceil(F.col("q") / (QUERIES_A_CODE * F.col("n"))).cast("int").alias("parts"))
    parts = F.broadcast(spark.createDataFrame(parts.collect() or [], "chunk int, parts int"))  # at most MOST_CHUNKS rows
    leaves = index.join(parts, "chunk").select("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "g", "fp")
    asked = routed.join(parts, "chunk").select("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "g", "fp")
    dealt = leaves.unionByName(asked).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "kind", "g")

    def links(tree: GrayIndex, ranks: np.ndarray, codes: np.ndarray, query: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in tree.search(query, np.searchsorted(ranks, rank, side="right"), radius, spanning):
            yield query[i], codes[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the chunk and part at hand
        leaf: list[np.ndarray] = []
        tree = ranks = codes = None
        above: dict[int, int] = {}

        def given(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in pairs:
                if spanning:
                    kept = list(_forest(zip(a.tolist(), b.tolist()), above))
                    a, b = (np.array([p[i] for p in kept], np.uint64) for i in (0, 1))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, part, kind, g, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "part", "kind", "g", "fp"))
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, len(chunk))):
                if held != (chunk[lo], part[lo]):
                    held, leaf, tree, above = (chunk[lo], part[lo]), [], None, {}
                if kind[lo] == 0:
                    leaf.append(np.stack([g[lo:hi], fp[lo:hi]]))
                    continue
                if tree is None:
                    ranks, codes = np.concatenate(leaf, axis=1)
                    codes = codes.view(np.uint64)
                    tree = GrayIndex(codes)
                    if spanning:
                        at = tree.chained(radius)
                        yield from given(iter([(codes[at], codes[at + 1])]))
                yield from given(links(tree, ranks, codes, fp[lo:hi].view(np.uint64), g[lo:hi]))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), fingerprint (hex), component_id.

    component_id is the smallest id that is reachable over links of at most ``radius`` differing bits,
    the row's own included. Null text counts as empty; rows without words have fingerprint zero and link
    like any other. Repeated rows get one row each; null ids are never chosen as a component's id unless
    the component has no other. Empty tables give empty tables; further columns are ignored.
    """
    fps, _ = common.written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    return label_components(fps, fingerprint_links(fps, radius))


def label_components(fps: DataFrame, links: DataFrame) -> DataFrame:
    """component_id for each (id, fp) from links between fingerprints."""
    roots = common.components(links)
    heads = fps.groupBy("fp").agg(F.min("id").alias("head"))
    linked = heads.join(roots, heads.fp == roots.node).select("fp", "root", "head")
    low = linked.groupBy("root").agg(F.min("head").alias("low"))
    named = linked.join(low, "root").select("fp", "low")
    # written first: the join with the rows is then a plain one, whose hot fingerprints Spark may split
    classes, _ = common.written(heads.join(named, "fp", "left").select("fp", F.coalesce("low", "head").alias("component_id")), "classes")
    return fps.join(classes, "fp").select("id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def code_links(source: DataFrame, keyed: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) between sets in one component of the Gray index's links, each set compared with its component's first and last."""
    sets = keyed.where("id is not null").select("fp", "code").distinct()
    roots = common.components(fingerprint_links(sets.select(F.col("code").alias("fp")), radius)).select(F.col("node").alias("code"), "root")
    grouped, _ = common.written(sets.join(roots, "code", "left").select("fp", F.coalesce("root", "code").alias("c")), "codes")
    ends, _ = common.written(grouped.groupBy("c").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high"), "ends")
    pairs = grouped.join(ends, "c").select("fp", F.explode(F.array("low", "high")).alias("end")).where("fp <> end")
    pairs, _ = common.written(pairs.select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct(), "code-pairs")
    return jaccard.verified(source, keyed, pairs, k, similarity)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns.

    Groups join texts that share ``similarity`` of their k-word shingles. SimHash codes of the sets go through the
    Gray index; sets in one component of its links are compared exactly with two of it. Codes of similar sets may
    lie further apart than the radius, so a prefix-filtered join adds the links that codes cannot show. Texts of up
    to k words are one shingle, so null and empty texts are one group. Rows that repeat an id stay or go together;
    rows with a null id stay. Empty tables give empty tables; further columns of any names are kept.
    """
    source = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("body"))
    keyed, _ = common.written(jaccard.keyed_sets(source, k, similarity), "sets")
    links, _ = common.written(code_links(source, keyed, k, similarity, radius), "code-links")
    found = label_components(keyed.select("id", "fp"), jaccard.completed_links(source, keyed, links, k, similarity))
    gone, _ = common.written(found.where("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "gone")
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
