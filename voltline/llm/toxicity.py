"""Toxicity classifier with a counterfactual penalty.

A sparse logistic model over distinct words and their character n-grams, of which training first picks those
that occur in toxic texts more than chance explains. In labelled sentences identity
terms are swapped for others (sentences without one get one in the place of a word); the squared change of
the score is a penalty in training, so that naming a group does not move the score. Words count once per
text, so long clean texts do not add up.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled
from .bpe import RUNS_KEPT, Memo
from .quality import pieces, scored

BUCKETS = 1 << 18
GRAMS = (4, 5)
WORD = 64
EVIDENCE = 16.0
EPOCHS = 400
RATE = 0.3
L2 = 1e-5
PENALTY = 1.0
SAMPLE_ROWS = 4000
WORDS_HELD = 50_000
SEED = 11
THRESHOLD = 0.7

# fixed values: common names of groups, the terms that are swapped
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants",
    "refugees", "gays", "lesbians", "transgender", "black", "white", "asian", "latino", "african", "american",
    "european", "arab", "chinese", "indian", "mexican", "elderly", "young", "disabled", "blind", "deaf", "frauen",
    "männer", "femmes", "hommes", "mujeres", "hombres", "musulmanes", "juden", "ausländer",
)
_EDGES = ".,;:!?\"'()[]{}<>*%$&#|-_«»¿¡"
_BETWEEN = re.compile(f"[{re.escape(_EDGES)}]+")


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


def distinct_words(words: list[str]) -> set[str]:
    """The bare words; one of over WORD characters as its parts between punctuation, and these in pieces, so all of it counts."""
    cores = {bare(w) for w in set(words)}
    long = {w for w in cores if len(w) > WORD}
    return cores - long | {p for w in long for p in pieces(_BETWEEN.split(w), WORD, GRAMS[-1] - 1)}


def word_features(word: str) -> list[int]:
    """Buckets of the lower-cased word, its beginnings and its character n-grams; none for bare punctuation."""
    core = bare(word)
    if not core:
        return []
    marked = f"<{core}>"
    text = marked.encode() if marked.isascii() else marked  # ASCII is cut as bytes, which are its letters
    parts = {text, *(text[:n] for n in range(4, min(8, len(text)))), *(text[i : i + n] for n in GRAMS for i in range(1, len(text) - n + 1))}
    return sorted({zlib.crc32(p if isinstance(p, bytes) else p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts})


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        known = {int(b): float(weights[b]) for b in np.flatnonzero(weights)}
        self.word_score = Memo(lambda w: sum([known[b] for b in word_features(w) if b in known]), RUNS_KEPT)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def score(self, text: str) -> float:
        """Probability of label 1; texts without words have the bias alone."""
        margin = self.bias + sum(map(self.word_score.__getitem__, sorted(distinct_words(text.split()))))
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def swapped(words: list[str], rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """The sentence and its counterfactual: each identity term becomes another; without one, a word gives its place to one."""
    terms = set(IDENTITY_TERMS)
    at = [i for i, w in enumerate(words) if bare(w) in terms]
    one, two = list(words), list(words)
    if not at and words:
        at = [int(rng.integers(len(words)))]
        one[at[0]] = IDENTITY_TERMS[rng.integers(len(IDENTITY_TERMS))]
    for i in at:
        others = [t for t in IDENTITY_TERMS if t != bare(one[i])]
        two[i] = others[rng.integers(len(others))]
    return one, two


def _features(words: set[str], memo: Memo) -> np.ndarray:
    """The features of a text's words, one for each word that has it."""
    return np.concatenate([memo[w] for w in sorted(words)]) if words else np.empty(0, np.int64)


def telling_features(sample: list[tuple[str, int]]) -> np.ndarray:
    """Buckets that occur in label 1's texts more than chance explains: a log-likelihood ratio of at least EVIDENCE."""
    memo, found, n = Memo(lambda w: np.array(word_features(w), np.int64), WORDS_HELD), np.zeros((2, BUCKETS)), np.zeros((2, 1))
    for text, label in sample:  # one text at a time: the driver holds counts, not features
        found[int(label), np.unique(_features(distinct_words(text.split()), memo))] += 1
        n[int(label)] += 1
    df = found.sum(axis=0)
    expected = df * n / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(o > 0, o * np.log(o / e), 0) for o, e in ((found, expected), (n - found, n - expected))]
    ratio = 2 * sum(t.sum(axis=0) for t in terms)
    return np.flatnonzero((ratio >= EVIDENCE) & (found[1] > expected[1]))


def train(sample: list[tuple[str, int]], penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of (text, 0 or 1) pairs; without both classes it scores their share."""
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in sample], np.float64)
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), bias)
    identity = sorted({b for term in IDENTITY_TERMS for b in word_features(term)})
    chosen = np.union1d(telling_features(sample), identity)
    place = {int(b): i for i, b in enumerate(chosen)}
    memo = Memo(lambda w: np.array([place[b] for b in word_features(w) if b in place], np.int64), WORDS_HELD)
    parts: list[tuple[np.ndarray, ...]] = []
    for text, _ in sample:
        words = text.split()
        # a sentence without an identity term takes part with an inserted one and with another in its place
        one, two = (distinct_words(s) for s in swapped(words, rng))
        parts.append((_features(distinct_words(words), memo), _features(one - two, memo), _features(two - one, memo)))
    columns = [[p[i] for p in parts] for i in range(3)]
    (rows, places), (row_a, place_a), (row_b, place_b) = ((np.repeat(np.arange(len(c)), [len(x) for x in c]), np.concatenate(c)) for c in columns)
    weights, size, n = np.zeros(len(chosen)), len(chosen), len(y)
    seen, seen_bias = np.full(size, 1e-8), 1e-8
    for _ in range(epochs):
        margin = bias + np.bincount(rows, weights[places], n)
        error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y
        change = np.bincount(row_a, weights[place_a], n) - np.bincount(row_b, weights[place_b], n)
        gradient = np.bincount(places, error[rows], size).astype(float)
        gradient += 2 * penalty * (np.bincount(place_a, change[row_a], size) - np.bincount(place_b, change[row_b], size))
        gradient = gradient / n + L2 * weights
        seen, g = seen + gradient**2, error.mean()
        weights -= RATE / np.sqrt(seen) * gradient
        seen_bias += g * g
        bias -= RATE / np.sqrt(seen_bias) * g
    out = np.zeros(BUCKETS, np.float32)
    out[chosen] = weights
    return Model(out, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity_score (0 to 1, higher: more toxic). Null counts as empty; a column of that name is replaced; empty tables give empty tables."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda: shared.value.score, "toxicity_score", text_col)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(labelled.training_sample(common.documents(spark, sf_dir), labels, "toxic", SAMPLE_ROWS))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, fitted(spark, sf_dir))
    return out.select("doc_id", labelled.held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))
