"""BPE encoding and decoding with a word-level byte vocabulary (tokenizers' JSON format).

A word's merges run over a doubly linked list of symbols with a heap of (rank, place); entries whose
symbols have changed meanwhile are stale and are skipped. White space never lies inside a piece, so
texts are cut at blanks first and each distinct string between blanks is encoded once per worker.
Decoding concatenates vocabulary strings, one blank between them, as a vocabulary without decoder asks.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS_KEPT = 200_000
PIECES_KEPT, RUNS_KEPT = 400_000, 600_000
BYTES_KEPT, ENTRY_BYTES = 64 << 20, 150


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Memo(dict):
    """Computes missing values; forgets everything when full of entries or bytes, so a worker's memory is bounded."""

    def __init__(self, compute, most: int = WORDS_KEPT, most_bytes: int = BYTES_KEPT):
        super().__init__()
        self.compute, self.most, self.most_bytes, self.bytes = compute, most, most_bytes, 0

    def __missing__(self, key):
        value = self.compute(key)
        self.bytes += ENTRY_BYTES + len(key) + (len(value) if hasattr(value, "__len__") else 0)
        if len(self) >= self.most or self.bytes > self.most_bytes:
            self.clear()
            self.bytes = ENTRY_BYTES + len(key)
        self[key] = value
        return value


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def split_pattern(spec: dict) -> regex.Pattern:
    """The pattern whose matches are a text's pieces."""
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return regex.compile(split["pattern"]["Regex"])


class Encoder:
    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.vocab[left], self.vocab[right]), (rank, self.vocab[left + right]))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for token, i in [*self.vocab.items(), *self.added.items()]:
            self.strings[i] = token.encode()
        self.pieces = split_pattern(spec).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.final = [self.vocab.get(c + self.suffix) for c in letters]
        self.piece_ids = Memo(lambda piece: pack_ids(self.merge(piece)), PIECES_KEPT)
        self.packed = Memo(self.encode_run, RUNS_KEPT)

    def merge(self, piece: str) -> list[int]:
        data = piece.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        heap = [(m[0], at, m[1]) for at in range(n - 1) if (m := merges.get((ids[at], ids[at + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, at, joined = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] is None or nxt < 0 or merges.get((ids[at], ids[nxt])) != (rank, joined):
                continue  # stale
            ids[at], ids[nxt] = joined, None
            after[at] = far = after[nxt]
            if far >= 0:
                before[far] = at
                if m := merges.get((joined, ids[far])):
                    heapq.heappush(heap, (m[0], at, m[1]))
            if (prev := before[at]) >= 0 and (m := merges.get((ids[prev], joined))):
                heapq.heappush(heap, (m[0], prev, m[1]))
        return [i for i in ids if i is not None]

    def encode_run(self, run: str) -> bytes:
        """Packed ids of a string without blanks."""
        core = run.rstrip(".,!?:;")
        if core.isalpha() and "İ" not in core and unicodedata.is_normalized("NFC", run):  # one word, perhaps with a stop: two pieces
            tail = run[len(core) :]
            return self.piece_ids[lowered(core)] + self.piece_ids[tail] if tail else self.piece_ids[lowered(core)]
        out = []
        for part in self.specials.split(run) if self.specials else [run]:
            if part in self.added:
                out.append(pack_ids([self.added[part]]))
            elif part:
                out += [self.piece_ids[piece] for piece in self.pieces(lowered(unicodedata.normalize("NFC", part)))]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def lowered(text: str) -> str:
    """Lower case letter by letter: a final capital sigma gets no special form."""
    return text.replace("Σ", "σ").lower()


_loaded: dict[int, Encoder] = {}


def encoder(definition: bytes) -> Encoder:
    """The worker's encoder; built once for a process."""
    key = hash(definition)
    if key not in _loaded:
        _loaded[key] = Encoder(definition)
    return _loaded[key]


def definition_bytes(spark: SparkSession, path: str | None):
    """The vocabulary file, read on the driver and broadcast: a fixed file of under 2 MB that executors need not have."""
    with open(path or default_vocabulary(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids) per row: ids packed as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Repeated rows and null ids give a row each; empty tables give empty
    tables; further columns are ignored. ``token_array`` unpacks ids.
    """
    definition = definition_bytes(docs.sparkSession, vocabulary)
    source = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("body"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(definition.value)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([own.encode(t) for t in batch.column("body").to_pylist()], pa.binary())], ["id", "ids"])

    return common.map_arrow(source, run, f"id {id_type}, ids binary")


def decode(tokens: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``tokens`` with a column ``decoded``, the text that its packed ids stand for; null ids decode to the empty text."""
    definition = definition_bytes(tokens.sparkSession, vocabulary)
    columns = [c for c in tokens.columns if c != "decoded"]
    source = tokens.select(*[F.col(f"`{c}`") for c in columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", decoded string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(definition.value)
        texts = [own.decode(x or b"") for x in batch.column(ids_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*columns, "decoded"])

    return common.map_arrow(source, run, schema)


def token_array(ids_col: str = "ids") -> F.Column:
    """Packed ids as array<int>, by built-in functions."""
    hexed = F.hex(ids_col)
    byte = lambda i, k: F.substring(hexed, i * 8 + 2 * k + 1, F.lit(2))
    number = lambda i: F.conv(F.concat(*[byte(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("int")
    n = (F.octet_length(ids_col) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), number))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(common.documents(spark, sf_dir)))
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
