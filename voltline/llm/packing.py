"""Hierarchical packing of token sequences into windows of several lengths.

Each task streams its documents. Full longest windows are cut off long documents; what is left of a
document is routed to the shortest window that holds it. Windows are built from the longest pieces on:
a gap is filled with the longest piece that fits, which comes from a shorter window's pieces, and only
when none fits is one cut. So every window is full, and what is left when a task ends is laid out in
windows of powers of two, which need no padding either. Sequences are then dealt to step groups, the
longest first to the group with the fewest tokens.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import PIECES_KEPT, RUNS_KEPT, Memo, byte_letters, definition_bytes, lowered, pack_ids, split_pattern

WINDOWS = (256, 512, 1024, 2048)
END_ID = 1
POOL = 4096
STEP_TOKENS = 131_072
STEPS_AT_ONCE = 8

Piece = tuple  # (length, order, document, start, document's tokens, the piece's packed ids)


class LibraryEncoder:
    """Packed ids by the tokenizers library's model; a string between blanks, and a piece of one, go to it once while they are remembered."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition.decode())
        self.model = self.library.model
        self.split = split_pattern(json.loads(definition)).findall
        self.letters = byte_letters()
        self.added = tuple(t["content"][:2] for t in json.loads(definition)["added_tokens"])
        self.pieces = Memo(self.encode_piece, PIECES_KEPT)
        self.runs = Memo(self.encode_run, RUNS_KEPT)

    def encode_piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in piece.encode()]))]
        return pack_ids(ids)

    def encode_run(self, run: str) -> bytes:
        if any(start in run for start in self.added):
            return pack_ids(self.library.encode(run, add_special_tokens=False).ids)
        core = run.rstrip(".,!?:;")
        if core.isalpha() and "İ" not in core and unicodedata.is_normalized("NFC", run):  # one word, perhaps with a stop: two pieces
            tail = run[len(core) :]
            return self.pieces[lowered(core)] + self.pieces[tail] if tail else self.pieces[lowered(core)]
        return b"".join([self.pieces[p] for p in self.split(lowered(unicodedata.normalize("NFC", run)))])

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.runs.__getitem__, text.replace("\n", " ").split(" ")))


_library: dict[int, LibraryEncoder] = {}


def library_encoder(definition: bytes) -> LibraryEncoder:
    key = hash(definition)
    if key not in _library:
        _library[key] = LibraryEncoder(definition)
    return _library[key]


class Packer:
    """Takes documents one by one and gives finished sequences: (window, [(piece, offset), ...])."""

    def __init__(self, windows: tuple[int, ...] = WINDOWS, pool: int = POOL):
        self.windows, self.room = sorted(windows), pool
        self.pool: list[Piece] = []
        self.order = itertools.count()

    def add(self, document, ids: bytes) -> Iterator[tuple[int, list]]:
        n, longest, start = len(ids) // 4, self.windows[-1], 0
        while n - start >= longest:
            yield longest, [((longest, 0, document, start, n, ids[4 * start : 4 * (start + longest)]), 0)]
            start += longest
        if n > start:  # the pool keeps the ids of the piece alone
            bisect.insort(self.pool, (n - start, next(self.order), document, start, n, ids[4 * start :]), key=lambda p: p[:2])
        if len(self.pool) >= self.room:
            while len(self.pool) > self.room // 2:
                yield from self.window()

    def take(self, at: int, most: int) -> Piece:
        """The pool's piece at ``at``, or its first ``most`` tokens; the rest goes back."""
        n, order, document, start, total, ids = self.pool.pop(at)
        if n > most:
            bisect.insort(self.pool, (n - most, next(self.order), document, start + most, total, ids[4 * most :]), key=lambda p: p[:2])
        return (min(n, most), order, document, start, total, ids[: 4 * most])

    def window(self) -> Iterator[tuple[int, list]]:
        size = next(w for w in self.windows if w >= self.pool[-1][0])
        pieces, used = [], 0
        while used < size and self.pool:
            gap = size - used
            at = bisect.bisect_right(self.pool, gap, key=lambda p: p[0]) - 1
            pieces.append((self.take(max(at, 0), gap), used))
            used += pieces[-1][0][0]
        if used == size:
            yield size, pieces
        else:
            yield from powers(pieces)

    def finish(self) -> Iterator[tuple[int, list]]:
        while self.pool:
            yield from self.window()


def powers(pieces: list) -> Iterator[tuple[int, list]]:
    """Pieces that fill no window, as sequences of powers of two, the longest first."""
    left = [p for p, _ in pieces]
    total = sum(p[0] for p in left)
    while total:
        size = 1 << (total.bit_length() - 1)
        out, used = [], 0
        while used < size:
            n, order, document, start, tokens, ids = left.pop(0)
            cut = min(n, size - used)
            out.append(((cut, order, document, start, tokens, ids[: 4 * cut]), used))
            if n > cut:
                left.insert(0, (n - cut, order, document, start + cut, tokens, ids[4 * cut :]))
            used += cut
        yield size, out
        total -= size


def step_groups(sequences: list[int], n_groups: int) -> list[int]:
    """A group for each sequence length: the longest first, to the group with the fewest tokens."""
    loads = [(0, g) for g in range(n_groups)]
    group = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: -sequences[i]):
        load, g = heapq.heappop(loads)
        group[i] = g
        heapq.heappush(loads, (load + sequences[i], g))
    return group


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint, step_group bigint"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, windows: tuple[int, ...] = WINDOWS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    A document is its ids and a closing id 1, so null and empty texts have one token. Sequence ids and step
    groups are unique over the table (the task's number is in their upper bits). Rows that repeat an id are
    separate documents with equal ids; null ids stay null. Empty tables give empty tables; further columns
    are ignored. A task holds at most POOL unfinished pieces.
    """
    definition = definition_bytes(docs.sparkSession, vocabulary)
    source = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("body"))
    id_type = source.schema["id"].dataType
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.ROWS_PER_BATCH))
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = library_encoder(definition.value), Packer(windows)
        base = TaskContext.get().partitionId() << 33
        waiting, tokens, next_sequence, next_step = [], 0, 0, 0

        def rows() -> pa.RecordBatch:
            nonlocal waiting, tokens, next_sequence, next_step
            n_groups = max(1, round(tokens / step_tokens))
            groups = step_groups([w for w, _ in waiting], n_groups)
            out = []
            for (window, pieces), group in zip(waiting, groups):
                for (n, _, document, start, total, ids), offset in pieces:
                    crc = zlib.crc32(ids)
                    out.append((document, start, n, crc, total, base + next_sequence, offset, window, base + next_step + group))
                next_sequence += 1
            waiting, tokens, next_step = [], 0, next_step + n_groups
            columns = list(zip(*out))
            names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema_id), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        schema_id = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema_id = batch.schema.field("id").type
            for document, ids in zip(batch.column("id").to_pylist(), own.encode_batch(batch.column("body").to_pylist())):
                for sequence in packer.add(document, ids + end):
                    waiting.append(sequence)
                    tokens += sequence[0]
                if tokens >= step_tokens * STEPS_AT_ONCE:
                    yield rows()
        for sequence in packer.finish():
            waiting.append(sequence)
            tokens += sequence[0]
        if waiting:
            yield rows()

    return source.mapInArrow(run, f"id {id_type.simpleString()}, {SCHEMA}")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
