"""Whitening against a plain eigen solve: counts by inertia, clustered and missing eigenvalues, odd rows."""

import numpy as np
import pytest

from planmatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, width string"


def test_inertia():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40):
        for _ in range(5):
            a = rng.normal(size=(n, n))
            a = a + a.T
            assert whitening.positive(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert whitening.positive(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and whitening.positive(np.zeros((3, 3))) == 0


def rotated(values, seed=2):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    np.arange(40, 0, -1.0), np.r_[np.full(30, 5.0), np.arange(20) + 7.0], 10.0 ** -np.arange(12), np.r_[np.ones(3), np.zeros(9)], np.ones(50), np.r_[1e6, np.full(39, 1.0)],
    np.r_[1.0, 1.0 + 1e-13, 1.0 + 2e-13, np.linspace(0.1, 0.9, 40)], [3.0],
], ids=str)
def test_components(spark, values):
    values = np.sort(np.asarray(values, float))[::-1]
    v = rotated(values)
    e, x = whitening.components(spark, v, 32)
    want = values[values > values.sum() * len(values) * 1e-15][:32]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-13 * values.sum())
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12 and np.abs(v @ x - x * e).max() < 1e-12 * values.sum()
    assert (x[np.abs(x).argmax(0), np.arange(len(e))] > 0).all()


def test_table(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(6, 6)) + np.eye(6)
    rows = [(int(i), (rng.normal(size=6) @ mixed + 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(7, rows[0][1]), (None, rows[1][1]), (900, rows[2][1])]
    narrow = [(1000 + i, rng.normal(size=2).tolist()) for i in range(20)]
    bad = [(800, None), (801, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (802, [float("nan")] * 6), (803, [float("inf")] + [0.0] * 5), (804, []), (805, [1e30] * 6), (806, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 5, "w") for i, v in rows + narrow + bad], SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    for own, width in ((rows, 6), (narrow, 2)):
        x = np.floor(64 * np.array([np.asarray(v, np.float32) for _, v in own], float)).astype(int) + 1_000_000
        n = len(x)
        y = x - x.mean(0)
        e, u = np.linalg.eigh(y.T @ y / n)
        e, u = e[::-1], u[:, ::-1]
        mine = sorted((r for r in got if r["n"] == n), key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"], r["component"]))
        assert len(mine) == n * width
        z = n * x - x.sum(0)
        want = sorted(((i, int(d)) for (i, _), d in zip(own, (z * z).sum(1))), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [(r["vec_id"], r["deviation"]) for r in mine if r["component"] == 1] == want
        for k in range(width):
            ref = y @ u[:, k] / np.sqrt(e[k])
            w = [r["whitened"] for r in mine if r["component"] == k + 1]
            ref = sorted(ref if abs(np.sort(ref) - np.sort(w)).max() < 1e-6 else -ref)
            assert np.allclose(sorted(w), ref, atol=1e-9)
        assert max(abs(r["explained"] - e[r["component"] - 1] / e.sum()) for r in mine) < 1e-12 and max(r["identity_error"] for r in mine) < 1e-9
    # a single vector of its width varies in no direction
    assert {r["n"] for r in got} == {303, 20}


def test_no_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "") for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i], 1, "") for i in range(9)], SCHEMA)
    got = whitening.whiten(flat).collect()
    assert len(got) == 9 and abs(got[0]["explained"] - 1) < 1e-12


def test_deviation_beyond_a_long():
    y, rest = np.array([[3_000_000, -1], [2, 1]]), np.array([5, 0])
    assert whitening.exact(y, 10**6, rest).to_pylist() == [None, (2 * 10**6 - 5) ** 2 + 10**12]
    assert whitening.exact(y, 100, rest).to_pylist() == [(3 * 10**8 - 5) ** 2 + 10**4, 195**2 + 100**2]


def test_tiles_and_groups(spark):
    """A covariance of several tiles, from many tasks, equals a plain one."""
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (200, 11))
    rows = spark.createDataFrame([(11, r.tolist()) for r in x], "width int, x array<long>").repartition(9)
    n, s, p = whitening.scatter(rows, "x", {11: np.ones(11, int)}, tile=4)[11]
    y = x - 1.0
    assert n == 200 and (s == y.sum(0)).all() and (p == y.T @ y).all()
