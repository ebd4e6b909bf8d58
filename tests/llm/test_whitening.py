"""Whitening against numpy's eigenvectors over plain integer sums."""

import math

import numpy as np
import pytest

from voltline.llm import whitening


def test_inertia_and_components_match_numpy():
    rng = np.random.default_rng(1)
    for t in range(60):
        n = int(rng.integers(1, 30))
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        drawn = [rng.standard_normal(n) ** 2, rng.choice([0, 1, 1 + 1e-9, 5, 7.0], n), rng.choice([1, 2.0], n)][t % 3]
        m = q @ np.diag(drawn) @ q.T
        m = (m + m.T) / 2
        values = np.linalg.eigvalsh(m)[::-1]
        for shift in rng.standard_normal(3):
            assert whitening.inertia_above(m, shift) == (values > shift).sum()
        found, vectors = whitening.leading_components(m, 4)
        assert np.allclose(found, values[: len(found)], atol=1e-11)
        assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-9)
        assert np.abs(m @ vectors.T - vectors.T * found).max() < 1e-10


def plain(rows):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array(distinct, float) - np.array(sums) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    return kept, n, sums, values[::-1], vectors[:, ::-1].T, np.trace(v)


def check(found, rows, k):
    kept, n, sums, values, vectors, trace = plain(rows)
    assert len(found) == k * len(kept)
    by_row = {}
    for r in found:
        by_row.setdefault((r.id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, x in kept:
        y = by_row[i, sum((n * c - s) ** 2 for c, s in zip(x, sums))]
        for j in range(k):
            due = (np.array(x) - np.array(sums) / n) @ vectors[j] / math.sqrt(values[j])
            got = y[j + 1][0]
            assert got.n == n and abs(got.explained - values[j] / trace) < 1e-9
            assert abs(abs(got.whitened) - abs(due)) < 1e-7
            if abs(due) > 1e-3:
                signs.setdefault(j, set()).add(np.sign(due) == np.sign(got.whitened))
            assert got.identity_error < 1e-6
    assert all(len(s) == 1 for s in signs.values())


def test_whole_table_matches_numpy(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(whitening.whiten(df).collect(), rows, 4)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(30)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (90, None), (91, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (92, [float("nan")] * 6), (93, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, x int, n string")
    check(whitening.whiten(df).collect(), rows, 4)


def test_flat_empty_and_short(spark):
    schema = "vec_id string, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained is None and r.identity_error is None for r in one)
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", None), ("b", [])], schema)).count() == 0
    ragged = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0]), ("c", []), ("d", [0.5, -4.0])], schema)).collect()
    assert {r.id for r in ragged} == set("abcd") and len(ragged) == 8 and ragged[0].n == 4
    line = whitening.whiten(spark.createDataFrame([("a", [1.0, 1.0]), ("b", [2.0, 2.0])], schema)).where("component = 2").collect()
    assert all(r.whitened is None and abs(r.explained) < 1e-12 for r in line)
    huge = whitening.whiten(spark.createDataFrame([("a", [1e300]), ("b", [-1e300]), ("c", [0.0])], schema)).collect()
    assert {r.deviation for r in huge if r.id != "c"} == {None}


def test_too_many_dimensions(spark):
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([("a", [0.0] * (whitening.MOST_DIMENSIONS + 1))], "vec_id string, embedding array<double>"))
