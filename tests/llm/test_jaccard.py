"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from voltline.llm import jaccard, simhash


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) > k else {tuple(words)}


def kept(rows, similarity=0.8):
    """Ids that are the smallest of their group, over all pairs."""
    sets, above = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = top(i), top(j)
                above[max(x, y)] = min(x, y)
    return sorted(i for i in above if top(i) == i)


def planted(seed):
    """Originals of several lengths with copies at similarities about 0.8, a group of copies, and a passage that all share."""
    rng = random.Random(seed)
    passage, rows = [f"p{i}" for i in range(30)], []
    for n in (6, 20, 60, 150, 400):
        for at in range(12):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            rows.append(words + passage * (at % 2))
            for share in (0.75, 0.8, 0.85, 0.9, 0.95):
                copy = list(rows[-1])
                for i in rng.sample(range(len(copy)), max(1, round(len(copy) * (1 - share) / (1 + share) / 5))):
                    copy[i] = f"x{rng.randrange(10**9)}"
                rows.append(copy)
    base = [f"g{i}" for i in range(200)]
    rows += [[w if rng.random() > 0.012 else f"y{rng.randrange(10**9)}" for w in base] for _ in range(60)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("hot_count", [jaccard.HOT_COUNT, 1])
def test_near_duplicates_equal_brute_force(spark, hot_count, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_COUNT", hot_count)
    rows = planted(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == kept(rows)


def test_similar_sets_share_a_first_shingle_in_any_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9, 40, 333):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a[: -(-8 * n // 10)]  # a subset at similarity 0.8 or more
        hot = np.sort(rng.choice(a, n // 2, replace=False)) if n > 1 else np.empty(0, np.uint64)
        a, b = np.unique(a), np.unique(b)
        assert np.intersect1d(jaccard.prefix(a, hot, 0.8), jaccard.prefix(b, hot, 0.8)).size


def copies_of_one_text(seed, n, edits=(1, 2, 3, 4, 5)):
    """A text of 150 words and copies of it with a few words of their own: up to three leave the similarity to the text, not to all other copies."""
    rng, base = random.Random(seed), [f"g{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for at in rng.sample(range(150), rng.choice(edits)):
            words[at] = f"z{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_copies_of_one_text_are_compared_in_proportion_to_their_number(spark, monkeypatch):
    rows, asked, plain = copies_of_one_text(1, 600), [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda d, keyed, pairs, k, t: asked.append(pairs.count()) or plain(d, keyed, pairs, k, t))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == kept(rows)
    assert sum(asked) < 15 * len(rows)  # of 179,700 pairs
