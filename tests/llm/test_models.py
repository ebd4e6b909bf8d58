"""Both classifiers against plain loops: each gradient step, the penalty and the scores, number by number."""

import math
import random

import numpy as np

from voltline.llm import quality, toxicity


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-50, min(50, x))))


def texts(seed, n):
    rng = random.Random(seed)
    words = "good clean text women write about the black cat nonsense trash idiots buy now éclair 中文 a".split()
    return [(" ".join(rng.choices(words, k=rng.randint(1, 12))), i % 2) for i in range(n)]


def mean_vector(text, vectors):
    words = quality.tokens(text)
    out = np.zeros(vectors.shape[1])
    for w in words:
        buckets = quality.subwords(w)
        for b in buckets:
            out += vectors[b] / len(buckets) / len(words)
    return out


def plain_quality(sample, epochs):
    rng = np.random.default_rng(quality.SEED)
    vectors = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32).astype(float)
    layer, bias = np.zeros((quality.DIM, 2)), np.zeros(2)
    n = len(sample)
    share = (sum(y for _, y in sample) + 1) / (n + 2)
    bias[1] = math.log(share / (1 - share))
    steps, done = epochs * -(-n // quality.BATCH), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), -(-n // quality.BATCH)):
            rate = quality.RATE * (1 - done / steps)
            layer_step, bias_step, moves = np.zeros_like(layer), np.zeros(2), []
            for i in part:
                text, y = sample[i]
                x = mean_vector(text, vectors)
                e = np.exp(x @ layer + bias)
                wrong = e / e.sum() - np.eye(2)[y]
                layer_step += np.outer(x, wrong) / len(part)
                bias_step += wrong / len(part)
                words = quality.tokens(text)
                for w in words:
                    buckets = quality.subwords(w)
                    moves += [(b, layer @ wrong / len(buckets) / len(words)) for b in buckets]
            layer = layer - rate * layer_step
            bias = bias - 0.1 * rate * bias_step
            for b, move in moves:
                vectors[b] -= rate * move
            done += 1
    return vectors, layer, bias


def test_quality_equals_plain_descent():
    sample = texts(1, 21)
    model = quality.train(sample, epochs=2)
    vectors, layer, bias = plain_quality(sample, 2)
    for text, _ in [*texts(2, 10), ("", 0), ("unseen words entirely", 0)]:
        x = mean_vector(text, vectors)
        margins = x @ layer + bias
        assert abs(model.score(text) - sigmoid(margins[1] - margins[0])) < 1e-4


def plain_features(words):
    return [b for w in sorted(toxicity.distinct_words(words)) for b in toxicity.word_features(w)]


def plain_toxicity(sample, penalty, epochs):
    rng = np.random.default_rng(toxicity.SEED)
    identity = {b for term in toxicity.IDENTITY_TERMS for b in toxicity.word_features(term)}
    chosen = set(toxicity.telling_features(sample).tolist()) | identity
    n = len(sample)
    share = (sum(y for _, y in sample) + 1) / (n + 2)
    bias, weights = math.log(share / (1 - share)), dict.fromkeys(chosen, 0.0)
    seen, seen_bias = dict.fromkeys(chosen, 1e-8), 1e-8
    rows = []
    for text, y in sample:
        one, two = (toxicity.distinct_words(s) for s in toxicity.swapped(text.split(), rng))
        rows.append((plain_features(text.split()), [b for w in one - two for b in toxicity.word_features(w)], [b for w in two - one for b in toxicity.word_features(w)], y))
    for _ in range(epochs):
        step, bias_step = dict.fromkeys(chosen, 0.0), 0.0
        for whole, gone, come, y in rows:
            wrong = sigmoid(bias + sum(weights.get(b, 0.0) for b in whole)) - y
            change = sum(weights.get(b, 0.0) for b in gone) - sum(weights.get(b, 0.0) for b in come)
            bias_step += wrong / n
            # d/dw of the mean of log loss + penalty * change ** 2
            for part, factor in ((whole, wrong), (gone, 2 * penalty * change), (come, -2 * penalty * change)):
                for b in part:
                    if b in chosen:
                        step[b] += factor / n
        for b in chosen:
            g = step[b] + toxicity.L2 * weights[b]
            seen[b] += g * g
            weights[b] -= toxicity.RATE / math.sqrt(seen[b]) * g
        seen_bias += bias_step * bias_step
        bias -= toxicity.RATE / math.sqrt(seen_bias) * bias_step
    return weights, bias


def labelled(seed, n):
    rng = random.Random(seed)
    mild, rude = "the women and old men walk to a green market today".split(), "idiots trash scum vermin".split()
    return [(" ".join(rng.choices(mild, k=8) + (rng.choices(rude, k=3) if i % 2 else [])), i % 2) for i in range(n)]


def test_toxicity_equals_plain_descent_and_penalty():
    sample = labelled(3, 60)
    for penalty in (0.0, 1.0, 5.0):
        model = toxicity.train(sample, penalty=penalty, epochs=6)
        weights, bias = plain_toxicity(sample, penalty, 6)
        assert sum(abs(w) > 1e-6 for w in weights.values()) > 20
        for text, _ in [*labelled(4, 10), ("", 0), ("black women", 0), ("Vermin!", 1)]:
            due = sigmoid(bias + sum(weights.get(b, 0.0) for b in plain_features(text.split())))
            assert abs(model.score(text) - due) < 1e-5


def test_penalty_shrinks_the_change_under_swaps():
    sample = [(t + " women" if y else t, y) for t, y in labelled(5, 200)]
    changes = []
    for penalty in (0.0, 5.0):
        model = toxicity.train(sample, penalty=penalty)
        changes.append(abs(model.score("women walk today") - model.score("deaf walk today")))
    assert changes[1] < 0.5 * changes[0]
