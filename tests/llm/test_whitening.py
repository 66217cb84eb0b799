"""Jacobi-Davidson against dense eigenvectors, and whitening against a brute-force version."""

import math

import numpy as np
import pytest

from factorloom.llm import whitening
from factorloom.llm.common import table


def brute(pairs, k=8):
    """(id, component) to what op11 defines, by a dense covariance of exact whole numbers."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in pairs], dtype=object)
    n, sums = len(x), x.sum(0)
    far = n * x - sums
    centred = far.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = centred @ axes / np.sqrt(values)
    trace = (centred**2).sum() / n
    return [((pairs[i][0], j + 1), n, int((far[i] ** 2).sum()), white[i, j], values[j] / trace) for i in range(n) for j in range(len(values))]


@pytest.mark.parametrize(("d", "k", "room"), [(64, 8, None), (64, 8, 30), (200, 8, 40), (5, 8, None), (1, 1, None)])
def test_against_dense(d, k, room):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((2000, d)) * 0.97 ** np.arange(d)
    v = x.T @ x / len(x)
    k = min(d, k)
    values, axes = whitening.jacobi_davidson(lambda b: v @ b, d, k, room=room)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:k]).max() < 1e-12 * values[0]
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-12 * values[0]
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12


def test_equal_eigenvalues_and_low_rank():
    values, axes = whitening.jacobi_davidson(lambda b: 3.0 * b, 40, 8)
    assert np.allclose(values, 3) and np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12
    low = np.zeros((30, 30))
    low[:3, :3] = np.diag([5.0, 4.0, 4.0])
    values, _ = whitening.jacobi_davidson(lambda b: low @ b, 30, 8)
    assert np.allclose(values, [5, 4, 4, 0, 0, 0, 0, 0], atol=1e-12)


def test_minres_solves():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((12, 12))
    a = a + a.T  # indefinite
    right = np.hstack([rng.standard_normal((12, 2)), np.zeros((12, 1))])
    assert np.abs(a @ whitening.minres(lambda b: a @ b, right, 12) - right).max() < 1e-8


def test_query_against_brute_force(spark, small):
    rows = whitening.op11_whitening(spark, small).collect()
    pairs = [(r.vec_id, r.embedding) for r in table(spark, small, "embeddings").collect()]
    expected = {key: rest for key, *rest in brute(pairs)}
    assert len(rows) == len(expected) == 8 * len(pairs)
    sign = {r.component: 1 if r.whitened * expected[r.vec_id, r.component][2] > 0 else -1 for r in rows if r.vec_id == pairs[0][0]}
    for r in rows:
        n, deviation, white, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened - sign[r.component] * white) < 1e-8 and abs(r.explained - explained) < 1e-10 and r.identity_error < 1e-9


SCHEMA = "vec_id long, embedding array<float>, component string, N int, label string"


def vectors(spark, given):
    return spark.createDataFrame([(i, v, "x", 7, "l") for i, v in given], SCHEMA).repartition(3)


def test_edges(spark):
    rng = np.random.default_rng(1)
    good = [(i if i else None, [float(c) for c in rng.standard_normal(3)]) for i in range(12)]
    good += [good[5]] * 2
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e20, 0.0, 0.0])]
    rows = whitening.whiten(vectors(spark, good + bad)).collect()
    assert len(rows) == 3 * len(good) and {r.n for r in rows} == {len(good)} and {r.label for r in rows} == {"l"}
    assert whitening.whiten(vectors(spark, good)).columns == ["vec_id", "label", *whitening.OUTPUT]
    assert sum(r.vec_id is None for r in rows) == 3 and sum(r.vec_id == 5 for r in rows) == 9
    float32 = [(i, list(np.float32(v))) for i, v in good]
    assert {r.deviation for r in rows} == {d for _, _, d, _, _ in brute(float32, 3)}
    for given in ([], bad[:5], [(1, [1.0, 2.0])] * 4):
        empty = whitening.whiten(vectors(spark, given))
        assert empty.columns == ["vec_id", "label", *whitening.OUTPUT] and empty.count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 4 and all(abs(r.explained - 1) < 1e-12 for r in line)
