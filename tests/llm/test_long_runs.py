"""Text without blanks is scored to its end."""

import random

from voltline.llm import quality, toxicity


def test_every_n_gram_of_a_long_run_counts():
    rng = random.Random(2)
    for n in (63, 64, 65, 123, 124, 1000):
        run = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
        words = quality.tokens(f"a {run} b")
        for size in quality.GRAMS:
            assert all(any(run[i : i + size] in w for w in words) for i in range(n - size + 1))
        words = toxicity.distinct_words(["a", run, "b"])
        for size in toxicity.GRAMS:
            assert all(any(run[i : i + size] in w for w in words) for i in range(n - size + 1))
        assert max(map(len, words)) <= toxicity.WORD


def test_quality_reads_a_long_run_to_its_end():
    rng = random.Random(3)
    good, bad = ("".join(chr(a + rng.randrange(12)) for _ in range(4000)) for a in (0x4E00, 0x6E00))
    model = quality.train([(good[i : i + 40], 1) for i in range(0, 4000, 40)] + [(bad[i : i + 40], 0) for i in range(0, 4000, 40)])
    assert model.score(good[:2000]) > 0.5 > model.score(good[:100] + bad[:2000])


def test_toxicity_reads_a_long_run_to_its_end():
    rng = random.Random(4)
    clean = [" ".join(f"word{rng.randrange(300)}" for _ in range(20)) for _ in range(200)]
    model = toxicity.train([(t, 0) for t in clean] + [(f"{t} idiot", 1) for t in clean])
    for joint in ",-_":
        run = joint.join(clean[0].split())
        assert model.score(run) < 0.5 < model.score(f"{run}{joint}idiot")
