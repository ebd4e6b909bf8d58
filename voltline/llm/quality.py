"""Quality classifier: supervised subword embeddings.

A document's vector is the mean over its words of the mean of the word's and its character n-grams'
hashed vectors; a softmax layer reads it. Vectors and layer are trained together by stochastic gradient
descent in numpy, on a bounded labelled sample. Because the layer is linear, a word adds a fixed amount
to a document's score, which each worker computes once per distinct word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled
from .bpe import RUNS_KEPT, Memo

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)
WORD = 63
EPOCHS = 8
BATCH = 8
RATE = 4.0
SEED = 7
THRESHOLD = 0.5
WORDS_HELD = 50_000
AGAIN = "\x00again"


def pieces(words: list[str], most: int, shared: int) -> list[str]:
    """The words; those of over ``most`` characters as successive pieces, of which neighbours share ``shared`` characters, so
    that each n-gram of one more character lies in a piece. Pieces are short, so no memory holds long keys."""
    if len(max(words, key=len, default="")) <= most:
        return words
    step = most - shared
    return [p for w in words for p in ([w] if len(w) <= most else [w[i : i + most] for i in range(0, len(w) - shared, step)])]


def tokens(text: str) -> list[str]:
    """The text's words, long ones in pieces; one that repeats one of the two before it counts as AGAIN, so that any stutter looks alike."""
    words = pieces(text.split(), WORD, GRAMS[-1] - 1)
    return words[:1] + [AGAIN if w == p or w == q else w for q, p, w in zip(words[:1] + words, words, words[1:])]


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, its ends marked."""
    marked = f"<{word}>"
    text = marked.encode() if marked.isascii() else marked  # ASCII is cut as bytes, which are its letters
    parts = [text, *(text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1))]
    return [zlib.crc32(p if isinstance(p, bytes) else p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def _word_scores(bucket_score: np.ndarray) -> Memo:
    """What each word adds to a text's margin before the mean over words."""
    scores = bucket_score.tolist()

    def of(word: str) -> float:
        buckets = subwords(word)
        return sum([scores[b] for b in buckets]) / len(buckets)

    return Memo(of, RUNS_KEPT)


class Model:
    def __init__(self, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.bucket_score = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])
        self.word_score = _word_scores(self.bucket_score)

    def __reduce__(self):
        return _restored, (self.bucket_score, self.bias)

    def score(self, text: str) -> float:
        """Probability of label 1; texts without words have the bias alone."""
        words = tokens(text)
        margin = self.bias + (sum(map(self.word_score.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def _restored(bucket_score: np.ndarray, bias: float) -> Model:
    model = Model.__new__(Model)
    model.bucket_score, model.bias = bucket_score, bias
    model.word_score = _word_scores(bucket_score)
    return model


def _mean_features(text: str, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text with their weights in its mean."""
    counts: dict[str, int] = {}
    words = tokens(text)
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    lists = [memo[w] for w in counts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    weight = np.repeat(np.fromiter(counts.values(), np.float64, len(lists)) / sizes / len(words), sizes)
    buckets, at = np.unique(np.concatenate(lists), return_inverse=True)
    return buckets.astype(np.int32), np.bincount(at, weight).astype(np.float32)


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of (text, 0 or 1) pairs; without both classes it scores their share."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    y = np.array([label for _, label in sample], np.int64)
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    bias[1] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return Model(vectors, layer, bias)
    memo = Memo(lambda w: np.array(subwords(w), np.int32), WORDS_HELD)  # packed and few: the driver holds it beside the sample
    features = [_mean_features(text, memo) for text, _ in sample]
    memo.clear()
    steps, done = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            sizes = [len(features[i][0]) for i in part]
            buckets = np.concatenate([features[i][0] for i in part])
            weights = np.concatenate([features[i][1] for i in part])[:, None]
            owner = np.repeat(np.arange(len(part)), sizes)
            docs = np.zeros((len(part), DIM), np.float32)
            np.add.at(docs, owner, vectors[buckets] * weights)
            logits = docs @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ layer.T
            layer -= rate * docs.T @ p / len(part)
            bias -= 0.1 * rate * p.mean(axis=0)
            np.add.at(vectors, buckets, -rate * back[owner] * weights)
            done += 1
    return Model(vectors, layer, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score (0 to 1, higher: better). Null counts as empty; a column of that name is replaced; empty tables give empty tables."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda: shared.value.score, "quality_score", text_col)


def scored(docs: DataFrame, scorer, name: str, text_col: str) -> DataFrame:
    others = [c for c in docs.columns if c != name]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), common.text_or_empty(text_col).alias("body"))
    row_type = source.schema["row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = scorer()
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([own(t) for t in batch.column("body").to_pylist()], pa.float64())], ["row", name])

    return common.map_arrow(source, run, f"row {row_type}, `{name}` double").select("row.*", name)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(labelled.training_sample(common.documents(spark, sf_dir), labels, "quality"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, fitted(spark, sf_dir))
    return out.select("doc_id", labelled.held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
