"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A text is cut into blocks of BLOCK five-word shingles, and blocks join to spans of 8, 16, ... shingles, each of two
of the spans before. A template of n shingles belongs to the least span that holds n; windows of two neighbouring
spans overlap by half, so wherever a copy of the template begins, one window holds all of it. A window's signature is
the minima of its shingles under HASHES hash functions, each of which is a band, looked up in the templates' table.

A window of 2 s shingles that holds the share c of a template's n > s / 2 shingles has a Jaccard similarity of at
least c n / (2 s + n - c n), so it shares a band with a probability of at least ``least_recall()``. What is retrieved
is then compared exactly: at which places a run of the template's length holds CONTAINMENT of its shingles.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import Memo
from .license_texts import TEXTS
from .substring import M, mixed

SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 20
BLOCK = 4
SEED = 3

_EDGE = re.compile(rb"^[^\w]+|[^\w]+$")
_word = Memo(lambda w: xxhash.xxh3_64_intdigest(_EDGE.sub(b"", w.lower())))
_KEYS = np.random.default_rng(SEED).integers(1, 2**63, HASHES, dtype=np.uint64)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A hash for each run of five words, case and edge punctuation aside; fewer words: one run."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * M + h[i : len(h) - k + 1 + i]
    return mixed(out)


def least_recall(containment: float = CONTAINMENT) -> float:
    """The least probability that a window which holds so much of a template shares a band with it (n = s / 2, the worst case)."""
    similarity = containment / 2 / (2 + 0.5 - containment / 2)
    return 1 - (1 - similarity) ** HASHES


class Scanner:
    """Templates by span: for each band a sorted table of minima and the templates that have them."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = []
        by_span: dict[int, list[int]] = {}
        for name, text in templates:
            words = text.encode().split()
            wanted = np.unique(shingle_hashes(words))
            if len(wanted):
                span = BLOCK
                while span < max(1, len(words) - SHINGLE + 1):
                    span *= 2
                by_span.setdefault(span, []).append(len(self.templates))
                self.templates.append((name, len(words), wanted))
        self.spans = []
        for span, members in sorted(by_span.items()):
            bands = []
            for key in _KEYS:
                least = np.array([mixed(self.templates[t][2] ^ key).min() for t in members], np.uint64)
                order = np.argsort(least, kind="stable")
                bands.append((least[order], np.array(members)[order]))
            self.spans.append((span, bands))

    def retrieved(self, hashes: list[np.ndarray]) -> set[tuple[int, int, int, int]]:
        """(text, template, first, past) for windows of shingles that share a band with a template."""
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(hashes)), n_blocks)
        if not len(owner) or not self.spans:
            return set()
        first_block = np.cumsum(n_blocks) - n_blocks
        place = np.arange(len(owner)) - np.repeat(first_block, n_blocks)
        starts = np.repeat(np.cumsum(sizes) - sizes, n_blocks) + place * BLOCK
        values = np.concatenate(hashes)
        found = set()
        for band, key in enumerate(_KEYS):
            least, own, size, at = np.minimum.reduceat(mixed(values ^ key), starts), owner, BLOCK, 0
            while True:
                if at < len(self.spans) and self.spans[at][0] == size:
                    self._look_up(found, self.spans[at][1][band], least, own, size)
                    at += 1
                if at == len(self.spans):
                    break
                # two neighbours of one text join; the last of an odd number stays alone
                count = np.bincount(own, minlength=len(hashes))
                joined = -(-count // 2)
                new_own = np.repeat(np.arange(len(hashes)), joined)
                heads = np.repeat(np.cumsum(count) - count, joined) + 2 * (np.arange(len(new_own)) - np.repeat(np.cumsum(joined) - joined, joined))
                least, own, size = np.minimum.reduceat(least, heads), new_own, size * 2
        return found

    @staticmethod
    def _look_up(found: set, table: tuple[np.ndarray, np.ndarray], least: np.ndarray, own: np.ndarray, size: int) -> None:
        minima, members = table
        count = np.bincount(own)
        place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        pair = np.append(own[1:] == own[:-1], False)
        both = np.where(pair, np.minimum(least, np.append(least[1:], 0)), least)  # a window is a span and the next one
        lo, hi = np.searchsorted(minima, both), np.searchsorted(minima, both, side="right")
        for i in np.flatnonzero(hi > lo):
            for t in members[lo[i] : hi[i]]:
                found.add((int(own[i]), int(t), int(place[i]) * size, (int(place[i]) + 2) * size))

    def verified(self, hashes: np.ndarray, windows: dict[int, list[tuple[int, int]]]) -> list[tuple[str, int, int, float]]:
        """(licence, first word, end word, containment) of the best runs around retrieved ``windows``, none overlapping within a licence."""
        found = []
        for t, spans in windows.items():
            name, n_words, wanted = self.templates[t]
            run = max(1, n_words - SHINGLE + 1)
            for lo, hi in spans:
                lo, hi = max(0, lo - run), min(len(hashes), hi + run)
                part = hashes[lo:hi]
                inside = np.concatenate(([0], np.cumsum(np.isin(part, wanted))))
                size = min(run, len(part))
                near = np.flatnonzero(inside[size:] - inside[:-size] >= CONTAINMENT * len(wanted) - 1e-9)
                share = [np.isin(wanted, part[s : s + size]).mean() for s in near]
                found += [(x, name, lo + int(s), lo + int(s) + n_words) for s, x in zip(near, share) if x >= CONTAINMENT]
        best: list[tuple[str, int, int, float]] = []
        taken: dict[str, list[tuple[int, int]]] = {}  # by licence, in order: those that are kept do not overlap, so only neighbours count
        for share, name, start, end in sorted(set(found), key=lambda f: (-f[0], f[2] - f[3], f[2], f[1])):
            mine = taken.setdefault(name, [])
            at = bisect.bisect_left(mine, (start, end))
            if (at and mine[at - 1][1] > start) or (at < len(mine) and mine[at][0] < end):
                continue
            mine.insert(at, (start, end))
            best.append((name, start, end, share))
        return sorted(best, key=lambda f: (f[1], f[0]))

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        hashes = [shingle_hashes(t.split()) for t in texts]
        windows: dict[int, dict[int, list]] = {}
        for text, template, lo, hi in self.retrieved(hashes):
            windows.setdefault(text, {}).setdefault(template, []).append((lo, hi))
        return [self.verified(h, windows[i]) if i in windows else [] for i, h in enumerate(hashes)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, matches) per row; matches is an array of (license, first_word, end_word, containment).

    Null and empty texts have no matches. Repeated rows and null ids give a row each; empty tables give empty
    tables; further columns are ignored. ``templates`` are (licence, text), some hundreds of kilobytes at most:
    they go with the code to each task.
    """
    templates = list(templates or TEXTS)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    id_type = source.schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))
    names = ("license", "first_word", "end_word", "containment")
    made: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(templates))
        rows = [[dict(zip(names, f)) for f in found] for found in made[0].scan(common.as_bytes(batch.column("body")))]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "matches"])

    return common.map_arrow(source, run, f"id {id_type}, matches array<struct<license: string, first_word: bigint, end_word: bigint, containment: double>>")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_sort(F.array_distinct(F.col("matches.license"))).alias("licenses"),
        F.array_min(F.col("matches.first_word")).alias("first_word"),
    )
