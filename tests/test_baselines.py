"""Station baselines against the recurrence, session by session."""

import math
import random

import pytest

from voltline.operators import detection


def expected(sessions, default=60.0, alpha=0.25, least=3):
    mean, var, out = None, 0.0, []
    for seen, (healthy, x) in enumerate(sessions):
        out.append(default if mean is None or seen < least else max(mean + 3 * math.sqrt(var) + 0.25 * abs(mean), default / 2))
        if healthy and x is not None:
            if mean is None:
                mean = x
            else:
                d = x - mean
                mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
    return out


def test_baselines_keep_what_was_learned_long_ago(spark):
    rng = random.Random(6)
    given = {
        "long faulty": [(True, 40.0 + i) for i in range(5)] + [(False, 900.0)] * 450 + [(True, 50.0), (True, 10.0)],
        "one healthy": [(True, 100.0), (False, 5.0), (False, 5.0), (False, 5.0)],
        "none healthy": [(False, 5.0)] * 6,
        "mixed": [(rng.random() < 0.3, rng.choice([None, rng.uniform(20, 200)])) for _ in range(700)],
    }
    rows = [(s, 1, i, float(i), h, x) for s, part in given.items() for i, (h, x) in enumerate(part)]
    df = spark.createDataFrame(rows, "station string, connector int, sid bigint, t_start double, healthy boolean, seconds double")
    out = detection.station_baselines(df, "seconds", default=60.0)
    assert out.columns == [*df.columns, "expected"]
    got = {(r.station, r.sid): r.expected for r in out.collect()}
    assert len(got) == len(rows)
    for s, part in given.items():
        assert [got[s, i] for i in range(len(part))] == pytest.approx(expected(part))
