"""Whitening against a plain eigendecomposition, and the spectra's updates by themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bicspark.llm import whitening
from bicspark.llm.common import ship_code
from bicspark.llm.whitening import Spectra


def plain(rows, components=4):
    """{(key, component): [(n, deviation, whitened, explained)]}, in one process."""
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [(k, [int(np.floor(256 * c)) for c in v] + [0] * (width - len(v))) for k, v in good]
    points = np.array(sorted({tuple(v) for _, v in x}), dtype=float)
    if not points.size:
        return {}
    n, sums = len(points), [int(s) for s in points.sum(axis=0)]
    apart = points - points.mean(axis=0)
    values, basis = np.linalg.eigh(apart.T @ apart / n)
    order = [k for k in np.argsort(-values)[:components] if values[k] > 1e-12 * values.sum()]
    found = {}
    for key, v in x:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for c, k in enumerate(order, start=1):
            whitened = (np.array(v, float) - np.array(sums) / n) @ basis[:, k] / np.sqrt(values[k])
            found.setdefault((key, c), []).append((n, deviation, whitened, values[k] / values.sum()))
    return found


def same(found, expected, close=1e-8):
    assert len(found) == sum(map(len, expected.values()))
    signs = {}
    for r in found:
        n, deviation, whitened, explained = expected[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["explained"] - explained) < 1e-9 and r["identity_error"] < 1e-9
        if abs(whitened) > 1e-6:
            assert signs.setdefault(r["component"], np.sign(whitened * r["whitened"])) == np.sign(whitened * r["whitened"])
        assert abs(abs(whitened) - abs(r["whitened"])) < close


@pytest.mark.parametrize("width, n", [(1, 5), (2, 7), (5, 3), (8, 100), (20, 300)])
@pytest.mark.parametrize("kind", ["full", "copies", "flat", "few directions", "graded", "one"])
def test_updates_and_joins(width, n, kind):
    random = np.random.default_rng(width + n)
    x = np.floor(random.standard_normal((n, width)) * 30)
    if kind == "copies":
        x = x[random.integers(0, max(n // 3, 1), n)]
    elif kind == "flat":
        x[:, width // 2 :] = 0
    elif kind == "few directions":
        x = np.floor(random.standard_normal((n, 2)) @ random.standard_normal((2, width)) * 1000)
    elif kind == "graded":
        x = x * 10.0 ** -np.arange(width)
    elif kind == "one":
        x[:] = x[0]
    lanes = Spectra.empty(3, width)
    for k in range(0, n, 3):
        lanes.add(x[k : k + 3])
    one = lanes[: int((lanes.n > 0).sum())].joined()
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    assert one.n[0] == n and np.allclose(one.mean[0], x.mean(axis=0))
    assert np.abs(one.basis[0] * one.values[0] @ one.basis[0].T - scatter).max() <= 1e-9 * max(1, np.abs(scatter).max())
    assert np.abs(one.basis[0].T @ one.basis[0] - np.eye(width)).max() < 1e-10


def test_secular_equation():
    poles = np.array([[0.0, 1.0, 1.0 + 1e-9, 5.0]])
    z = np.array([[1.0, 1e-4, 2.0, -3.0]])
    roots, turn = whitening.secular(poles, z, np.array([0.5]))
    whole = np.diag(poles[0]) + 0.5 * np.outer(z, z)
    assert np.allclose(roots[0], np.linalg.eigvalsh(whole), rtol=1e-9, atol=1e-9)
    assert np.allclose(turn[0] * roots[0] @ turn[0].T, whole, atol=1e-8)


def test_whitening_of_all_embeddings(spark):
    ship_code(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(11)
    same(whitening.whiten(table).collect(), plain([(r["vec_id"], r["embedding"]) for r in table.collect()]))


def test_odd_vectors(spark):
    ship_code(spark)
    nan, inf = float("nan"), float("inf")
    random = np.random.default_rng(2)
    rows = [(2**60 + k, [float(v) for v in random.standard_normal(3)]) for k in range(20)]
    rows += [(None, [0.0, 0.0, 0.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, []), (3, None), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [None, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.withColumns({c: F.lit("x") for c in ("x", "component", "n", "slot", "part", "dim")})
    found = whitening.whiten(table).collect()
    assert {r["component"] for r in found} == {1, 2, 3}
    same(found, plain(rows))
    assert whitening.whiten(table.where("false")).count() == 0
    assert whitening.whiten(table.where("vec_id = 1")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3.0, 2.0])], "vec_id long, embedding array<double>")
    assert all(r["deviation"] is None for r in whitening.whiten(huge).where("vec_id < 3").collect())
