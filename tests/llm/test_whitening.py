"""Whitening against eigenvectors computed by numpy, and its solver by itself."""

import numpy as np
import pytest

from tablemill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def frame(spark, vectors, parts=3):
    rows = [(k, v, "clash", "clash") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(vectors, components=16):
    """(n, S, eigenvalues, eigenvectors) of the distinct whole-number vectors."""
    x = np.array([[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    y = fit - fit.mean(axis=0)
    values, directions = np.linalg.eigh(y.T @ y / len(fit))
    return x, len(fit), fit.sum(axis=0), values[::-1], directions[:, ::-1]


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(7)
    own = (draw.normal(size=(300, 20)) @ draw.normal(size=(20, 20)) * 0.5).tolist()
    return own + own[:40] * 3


def test_equals_numpy(spark, vectors):
    bad = [None, [], [None, *vectors[0][1:]], [float("nan"), *vectors[0][1:]], [float("inf"), *vectors[0][1:]], [1.0, 2.0]]
    got = whitening.whiten(frame(spark, vectors + bad, 5)).collect()
    x, n, sums, values, directions = plain(vectors)
    assert len(got) == len(vectors) * 16 and {r["component"] for r in got} == set(range(1, 17)) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    mine = np.zeros((len(vectors), 16))
    for r in got:
        mine[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    want = (x - sums / n) @ directions[:, :16] / np.sqrt(values[:16])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * signs - want).max() < 1e-6


def test_partitions_and_repeats_change_nothing(spark, vectors):
    one = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in whitening.whiten(frame(spark, vectors, 1)).collect()}
    many = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in whitening.whiten(frame(spark, vectors, 40)).collect()}
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-8


def test_degenerate_tables(spark):
    assert whitening.whiten(frame(spark, [[1.0, 2.0]]).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [None, [float("nan")]])).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0  # no variance
    line = whitening.whiten(frame(spark, [[float(k), 3.0, -float(k)] for k in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)
    huge = whitening.whiten(frame(spark, [[3e38, 1.0], [-3e38, 2.0], [0.0, 1.5]])).collect()
    assert len(huge) in (3, 6) and any(r["deviation"] is None for r in huge)


def test_solver_is_accurate_relatively():
    q, e = 10.0 ** -np.arange(0, 16, 2), 0.5 * 10.0 ** -np.arange(0, 14, 2)
    want = np.linalg.svd(np.diag(q) + np.diag(e, 1))[1]
    assert np.abs(whitening.dqds(q, e) / want - 1).max() < 1e-10
    draw = np.random.default_rng(0)
    u, v = (np.linalg.qr(draw.normal(size=(32, 32)))[0] for _ in range(2))
    for values in (np.ones(32), np.repeat([3.0, 2.0, 1.0, 0.0], 8), np.linspace(1, 2, 32)):
        r = np.linalg.qr(u @ np.diag(values) @ v.T, mode="r")
        got, directions = whitening.directions(r)
        assert np.allclose(got, np.sort(values[values > 0])[::-1], rtol=1e-12)
        assert np.abs(directions.T @ directions - np.eye(len(got))).max() < 1e-11
        assert np.abs((r @ directions).T @ (r @ directions) - np.diag(got**2)).max() < 1e-11
