"""How the sources of each language differ in their words, counted through minimal acyclic transducers.

A first pass finds the terms that enough documents of a language hold. They are sorted by range, and each run of at most
BLOCK_TERMS becomes a minimal acyclic automaton (built from sorted terms, with a register of finished states) whose arcs carry
counts, so that the outputs along a term's path add up to its lexicographic ordinal. A second pass streams all texts through them:
every term of a portion of text steps through its automaton together with the others, byte by byte. Counts are
kept by ordinal from there on, and ties are broken by ordinal. Automata travel in broadcasts of at most
BROADCAST_BYTES, checked before they are gathered; a larger vocabulary takes several passes over the texts. Shares are integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 1_000_000_000
BLOCK_TERMS = 1 << 16
BROADCAST_BYTES = 48 << 20
PORTION = 4 << 20
MOST_HELD = 1 << 20
TERMS_AT_ONCE, SOURCES_AT_ONCE = 1024, 256  # of a tile whose sources are compared in one step

IS_TERM = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
TO_TERMS = bytes(int(LOWER[b]) if IS_TERM[b] else 32 for b in range(256))


class Transducer:
    """The minimal acyclic automaton of sorted distinct terms; arcs are sorted by (state, byte) and hold target and output."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, finals: np.ndarray):
        self.keys, self.targets, self.outputs, self.finals = keys, targets, outputs, finals
        self.root = len(finals) - 1
        self.first = np.full(256, -1, np.int64)  # the root's arcs by byte
        own = np.flatnonzero(keys >> 8 == self.root)
        self.first[keys[own] & 255] = own

    @classmethod
    def of(cls, terms: Iterator[bytes]) -> Transducer:
        """Built term by term: what a term does not share with the one before is finished, and equal finished states become one."""
        register: dict[tuple, int] = {}
        path: list[tuple[list, list]] = [([False], [])]
        before = b""

        def finish(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                state = register.setdefault((final[0], tuple(arcs)), len(register))
                path[-1][1].append((before[len(path) - 1], state))

        for term in terms:
            shared = next((i for i, (a, b) in enumerate(zip(term, before)) if a != b), min(len(term), len(before)))
            finish(shared)
            path.extend(([False], []) for _ in term[shared:])
            path[-1][0][0] = True
            before = term
        finish(0)
        final, arcs = path[0]
        states = [*register, (final[0], tuple(arcs))]
        below = np.zeros(len(states), np.int64)
        keys, targets, outputs = [], [], []
        for s, (final, arcs) in enumerate(states):
            count = int(final)
            for byte, target in arcs:
                keys.append(s << 8 | byte)
                targets.append(target)
                outputs.append(count)
                count += int(below[target])
            below[s] = count
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), np.array([f for f, _ in states], bool))

    def ordinals(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ordinal of each term data[start:end] (lower case), -1 for those outside the vocabulary; all terms advance together."""
        found = np.full(len(start), -1, np.int64)
        if not len(self.keys) or not len(start):
            return found
        at = self.first[data[start]]
        alive = np.flatnonzero(at >= 0)
        at, place, end, total = at[alive], start[alive] + 1, end[alive], np.zeros(len(alive), np.int64)
        while len(alive):
            state, total = self.targets[at].astype(np.int64), total + self.outputs[at]
            done = place == end
            ends = done & self.finals[state]
            found[alive[ends]] = total[ends]
            go = np.flatnonzero(~done)
            alive, place, end, state, total = alive[go], place[go], end[go], state[go], total[go]
            key = state << 8 | data[place]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            alive, place, end, total, at = alive[hit], place[hit] + 1, end[hit], total[hit], at[hit]
        return found


def slices(text: bytes, most: int = PORTION) -> Iterator[bytes]:
    """``text`` in pieces of about ``most`` bytes that cut no term."""
    start = 0
    while len(text) - start > most:
        end = start + most
        while end < len(text) and IS_TERM[text[end]]:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[common.text_or_empty(c).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "body"))])


def kept_terms(texts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` rows of ``lang``; tasks count ahead of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "term", "n"])

        for batch in batches:
            for part in common.portions(batch, PORTION):
                held += part.nbytes
                for lang, text in zip(part.column("lang").to_pylist(), common.as_bytes(part.column("body"))):
                    terms = set()
                    for piece in slices(text):
                        terms.update(piece.translate(TO_TERMS).split(b" "))
                    terms.discard(b"")
                    counts.setdefault(lang, Counter()).update(terms)
                if held > 256 << 20 or sum(map(len, counts.values())) > MOST_HELD // 2:
                    yield from out()
                    counts, held = {}, 0
        yield from out()

    found = texts.select("lang", "body").mapInArrow(run, "lang string, term binary, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def transducers(kept: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per run of at most ``block_terms`` consecutive terms of a language: lang, first, n_terms, n_bytes, keys, targets, outputs, finals.

    ``kept`` is a written table of distinct (lang, term); it is sorted by range, and no task holds more than a block as terms.
    """
    ranged = kept.repartitionByRange(max(1, -(-kept.count() // block_terms)), "lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []

        def block() -> pa.RecordBatch:
            made = Transducer.of(terms)
            parts = [x.tobytes() for x in (made.keys, made.targets, made.outputs, made.finals)]
            columns = [pa.array([lang]), pa.array([terms[0]], pa.binary()), pa.array([len(terms)], pa.int64()), pa.array([sum(map(len, parts))], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([p], pa.binary()) for p in parts]], ["lang", "first", "n_terms", "n_bytes", "keys", "targets", "outputs", "finals"])

        for batch in batches:
            for now, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if terms and (now != lang or len(terms) >= block_terms):
                    yield block()
                    terms = []
                lang = now
                terms.append(term)
        if terms:
            yield block()

    return ranged.mapInArrow(run, "lang string, first binary, n_terms bigint, n_bytes bigint, keys binary, targets binary, outputs binary, finals binary")


def passes(blocks: DataFrame, most: int = BROADCAST_BYTES) -> list[list[tuple[str, bytes, int]]]:
    """(lang, first, ordinal of first) of all blocks in order, cut into lists of at most ``most`` bytes, a block at least.

    One row for BLOCK_TERMS terms reaches the driver here, without the automata.
    """
    out, size, base, before = [], 0, 0, None
    for r in blocks.select("lang", "first", "n_terms", "n_bytes").orderBy("lang", "first").toLocalIterator():
        if r.lang != before:
            base, before = 0, r.lang
        if not out or size + r.n_bytes > most:
            out.append([])
            size = 0
        out[-1].append((r.lang, bytes(r.first), base))
        size += r.n_bytes
        base += r.n_terms
    return out


class Vocabulary:
    """The automata of one pass by language, in order, with the ordinals of their first terms."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.blocks = rows, None

    def _loaded(self) -> dict[str, list[tuple[int, Transducer]]]:
        if self.blocks is None:
            self.blocks = {}
            for lang, base, keys, targets, outputs, finals in self.rows:
                made = Transducer(np.frombuffer(keys, np.int64), np.frombuffer(targets, np.int32), np.frombuffer(outputs, np.int32), np.frombuffer(finals, bool))
                self.blocks.setdefault(lang, []).append((base, made))
        return self.blocks

    def __getstate__(self):
        return {"rows": self.rows, "blocks": None}

    def langs(self) -> set[str]:
        return set(self._loaded())

    def ordinals(self, lang: str, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ordinals within the language; a block sees the terms whose first byte it knows."""
        found = np.full(len(start), -1, np.int64)
        first = data[start]
        order = np.argsort(first, kind="stable")
        edges = np.searchsorted(first[order], np.arange(257))
        for base, block in self._loaded().get(lang, ()):
            known = np.flatnonzero(block.first >= 0)
            mine = order[edges[known[0]] : edges[known[-1] + 1]] if len(known) else order[:0]
            got = block.ordinals(data, start[mine], end[mine])
            found[mine[got >= 0]] = got[got >= 0] + base
        return found


def _loaded_pass(blocks: DataFrame, chosen: list[tuple[str, bytes, int]]):
    """A broadcast of one pass; ``passes`` has checked its size."""
    place = F.struct("lang", "first")
    low, high = (F.struct(F.lit(lang).alias("lang"), F.lit(first).alias("first")) for lang, first, _ in (chosen[0], chosen[-1]))
    base = {(lang, first): b for lang, first, b in chosen}
    rows = [(r.lang, base[r.lang, bytes(r.first)], bytes(r.keys), bytes(r.targets), bytes(r.outputs), bytes(r.finals)) for r in blocks.where((place >= low) & (place <= high)).collect()]
    return blocks.sparkSession.sparkContext.broadcast(Vocabulary(sorted(rows, key=lambda r: r[:2])))


def recounted(texts: DataFrame, vocabulary) -> DataFrame:
    """(lang, source, ord, n): occurrences of the terms of a broadcast ``vocabulary`` in each group, all texts streamed through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, langs = vocabulary.value, vocabulary.value.langs()
        groups: dict[tuple[str, str], int] = {}
        keys, counts, waiting, n_waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def settle() -> None:
            nonlocal keys, counts, waiting, n_waiting
            if waiting:
                every = np.concatenate([keys, *waiting])
                weights = np.concatenate([counts, np.ones(n_waiting, np.int64)])
                keys, where = np.unique(every, return_inverse=True)
                counts = np.bincount(where, weights, len(keys)).astype(np.int64)  # exact: a task counts below 2**53
                waiting, n_waiting = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            names = list(groups)
            lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                group = pa.array(part >> 40)
                yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), pa.array(part & ((1 << 40) - 1)), pa.array(counts[at : at + (1 << 16)])], ["lang", "source", "ord", "n"])

        for batch in batches:
            for part in common.portions(batch, PORTION):
                rows = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist()))
                texts = common.as_bytes(part.column("body"))
                by_lang: dict[str, list[int]] = {}
                for i, (lang, _) in enumerate(rows):
                    if lang in langs:
                        by_lang.setdefault(lang, []).append(i)
                for lang, mine in by_lang.items():
                    group = np.array([groups.setdefault(rows[i], len(groups)) for i in mine], np.int64)
                    # a separator after each text: no term goes on in the next one
                    joined = b"\n".join([texts[i] for i in mine]) + b"\n"
                    edges = np.cumsum([len(texts[i]) + 1 for i in mine])
                    at = 0
                    for piece in slices(joined):
                        data = LOWER[np.frombuffer(piece, np.uint8)]
                        inside = np.diff(np.concatenate(([False], IS_TERM[data], [False])).astype(np.int8))
                        start, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
                        ordinal = known.ordinals(lang, data, start, end)
                        hit = np.flatnonzero(ordinal >= 0)
                        waiting.append(group[np.searchsorted(edges, start[hit] + at, "right")] << 40 | ordinal[hit])
                        n_waiting += len(hit)
                        at += len(piece)
                        if n_waiting > 4 * MOST_HELD:
                            settle()
                if len(keys) > MOST_HELD or len(groups) > MOST_HELD:
                    settle()
                    yield from out()
                    groups, keys, counts = {}, keys[:0], counts[:0]
        settle()
        yield from out()

    found = texts.mapInArrow(run, "lang string, source string, ord bigint, n bigint")
    return found.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def numbered(kept: DataFrame, vocabulary) -> DataFrame:
    """(lang, ord, term) of the kept terms that a broadcast ``vocabulary`` knows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        langs, terms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data = np.frombuffer(b"".join(terms), np.uint8)
        end = np.cumsum([len(t) for t in terms])
        start = end - [len(t) for t in terms]
        found = np.full(len(terms), -1, np.int64)
        for lang in set(langs):
            mine = np.array([i for i, x in enumerate(langs) if x == lang])
            found[mine] = vocabulary.value.ordinals(lang, data, start[mine], end[mine])
        hit = pa.array(np.flatnonzero(found >= 0))
        return pa.RecordBatch.from_arrays([batch.column(0).take(hit), pa.array(found).take(hit), batch.column(1).take(hit)], ["lang", "ord", "term"])

    return common.map_arrow(kept, run, "lang string, ord bigint, term binary")


def _share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)) in integers; decimals where longs may be too short."""
    above, below = f"({count} + {SMOOTHING}L)", f"({total} + {SMOOTHING} * {terms})"
    return F.expr(f"1 + CASE WHEN {count} < 9000000000 THEN ({UNIT}L * {above}) DIV {below} ELSE (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({above} AS DECIMAL(20, 0))) DIV CAST({below} AS DECIMAL(20, 0)) END")


def _tiles(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, tile, side, width, base, cells) per TERMS_AT_ONCE terms and SOURCES_AT_ONCE sources: base are the shares of absent terms, cells those of present ones."""
    cell = (F.col("i") % SOURCES_AT_ONCE) * F.lit(1 << 42) + (F.col("ord") % TERMS_AT_ONCE) * F.lit(1 << 32) + _share("n", "total", "v")
    tile = F.expr(f"ord DIV {TERMS_AT_ONCE}").alias("tile")
    # at most TERMS_AT_ONCE * SOURCES_AT_ONCE longs in a list
    cells = counts.join(groups, ["lang", "source"]).groupBy("lang", tile, "side").agg(F.collect_list(cell).alias("cells"))
    sides = groups.groupBy("lang", "side", "v").agg(F.sort_array(F.collect_list(F.struct("i", F.when(F.col("v") > 0, _share("0", "total", "greatest(v, 1)")).otherwise(0).alias("p")))).alias("base"))
    every = sides.select("lang", "side", "v", F.col("base.p").alias("base"), F.explode(F.expr(f"sequence(0L, greatest(v - 1, 0L) DIV {TERMS_AT_ONCE})")).alias("tile"))
    width = F.least(F.lit(TERMS_AT_ONCE), F.col("v") - F.col("tile") * TERMS_AT_ONCE)
    return every.join(cells, ["lang", "tile", "side"], "left").select("lang", "tile", "side", width.alias("width"), "base", F.coalesce("cells", F.array().cast("array<bigint>")).alias("cells"))


def distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): sums over all kept terms of the differences of two sources' shares, by the sources' numbers; both orders.

    Tiles of terms and sources are compared, not rows: a tile of one side meets each tile of the same terms whose side is no lower.
    """
    tiles, _ = common.written(_tiles(counts, groups), "tiles")
    left = tiles.select("lang", "tile", "width", F.col("side").alias("sa"), F.col("base").alias("ba"), F.col("cells").alias("ca"))
    right = tiles.select("lang", "tile", F.col("side").alias("sb"), F.col("base").alias("bb"), F.col("cells").alias("cb"))
    pairs = left.join(right, ["lang", "tile"]).where("sa <= sb").select("lang", "width", "sa", "ba", "ca", "sb", "bb", "cb")

    def dense(base, cells, width: int) -> np.ndarray:
        table = np.repeat(np.array(base, np.int64)[:, None], width, axis=1)
        cells = np.array(cells, np.int64)
        table[cells >> 42, (cells >> 32) & (TERMS_AT_ONCE - 1)] = cells & ((1 << 32) - 1)
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, width, sa, ba, ca, sb, bb, cb = (batch.column(k)[i] for k in range(8))
                one, other = (dense(b.values.to_numpy(), c.values.to_numpy(), width.as_py()) for b, c in ((ba, ca), (bb, cb)))
                sums = np.stack([np.abs(other - row).sum(axis=1) for row in one])
                a, b = (x.ravel() for x in np.indices(sums.shape))
                a, b, value = a + sa.as_py() * SOURCES_AT_ONCE, b + sb.as_py() * SOURCES_AT_ONCE, sums.ravel()
                if sa.as_py() != sb.as_py():
                    a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
                different = a != b
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * int(different.sum()), pa.string()), pa.array(a[different]), pa.array(b[different]), pa.array(value[different])], ["lang", "a", "b", "value"])

    return pairs.mapInArrow(run, "lang string, a bigint, b bigint, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) departs from the others of its language and from the language.

    Terms are runs of ASCII letters (lower-cased) and of any other characters beyond ASCII; a language keeps those in at least ``least`` of its
    rows. Part ``pair`` ranks every other source of the language by the summed differences of shares, part ``term`` the ``top`` terms whose share
    exceeds the language's. Nulls in the three columns count as ''; rows that repeat count each time; groups without terms have pairs only;
    a language without kept terms has pairs of value 0; one of a single source has no pairs. Further columns are ignored; an empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BYTES_AT_ONCE))
    texts = _texts(docs, text_col, lang_col, source_col)
    kept, _ = common.written(kept_terms(texts, least), "kept-terms")
    blocks, _ = common.written(transducers(kept, block_terms), "transducers")
    found, names = [], []
    for chosen in passes(blocks, broadcast_bytes):
        vocabulary = _loaded_pass(blocks, chosen)
        found.append(common.written(recounted(texts, vocabulary), "counts")[1])
        names.append(common.written(numbered(kept, vocabulary), "vocabulary")[1])
        vocabulary.destroy()
    counts = spark.read.schema("lang string, source string, ord bigint, n bigint").parquet(*found) if found else spark.createDataFrame([], "lang string, source string, ord bigint, n bigint")
    terms = spark.read.schema("lang string, ord bigint, term binary").parquet(*names) if names else spark.createDataFrame([], "lang string, ord bigint, term binary")

    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    groups = texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", zero("total"), zero("v"))
    groups = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1)
    groups, _ = common.written(groups.withColumn("side", F.expr(f"i DIV {SOURCES_AT_ONCE}")), "groups")

    pairs = distances(counts, groups)
    a, b = (groups.select("lang", F.col("i").alias(k), F.col("source").alias(n)) for k, n in (("a", "source"), ("b", "item")))
    pairs = pairs.join(a, ["lang", "a"]).join(b, ["lang", "b"])
    by_group = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_group.orderBy(F.desc("value"), "item")).alias("rank"))

    whole = counts.groupBy("lang", "ord").agg(F.sum("n").alias("lang_n"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    over = counts.join(whole, ["lang", "ord"]).join(groups, ["lang", "source"]).join(totals, "lang")
    over = over.select("lang", "source", "ord", (_share("n", "total", "v") - _share("lang_n", "lang_total", "v")).alias("value")).where("value > 0")
    best = over.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "ord"))).where(F.col("rank") <= top)
    best, _ = common.written(best, "best-terms")
    named = best.join(terms, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.unionByName(named)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
     t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
     c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
     v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
     p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
           FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
     l AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
           FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
     pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
              GROUP BY ALL),
     term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM term) WHERE rank <= 50
"""
