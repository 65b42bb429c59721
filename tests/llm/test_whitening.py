import math
import random

import numpy as np
import pytest

from critiq.llm.whitening import bidiagonalise, fit_whitening, on_grid, whitened_rows

SCHEMA = "vec_id long, embedding array<double>, component string, place int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, "x") for i, v in rows], SCHEMA).repartition(3)


def fine(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def brute_force(rows, most=16):
    """{row: (n, deviation, projections, shares)} by a dense eigen-decomposition."""
    rows = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if fine(v)]
    dims = max(len(x) for _, x in rows)
    rows = [(i, x + [1000000] * (dims - len(x))) for i, x in rows]
    fit = [list(x) for x in {tuple(x) for _, x in rows}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    found = []
    for i, x in rows:
        exact = [n * a - s for a, s in zip(x, sums)]
        white = (np.array(exact) / n) @ vectors / np.sqrt(np.abs(values))
        found.append((i, n, sum(e * e for e in exact), white))
    return found, values / np.trace(centred.T @ centred / n)


def check(spark, rows, components=None, tolerance=1e-9, **options):
    got = whitened_rows(table(spark, rows), **options).collect()
    want, shares = brute_force(rows)
    components = len(shares) if components is None else components
    ours = {}
    for r in got:
        ours.setdefault((r.vec_id, r.deviation, r.n), {}).setdefault(r.component, []).append(r)
    assert sorted(ours, key=str) == sorted({(i, d, n) for i, n, d, _ in want}, key=str)
    assert len(got) == len(want) * components
    signs = np.zeros(components)
    for i, n, deviation, white in want:
        mine = ours[i, deviation, n]
        for c in range(components):
            value = min((r.whitened for r in mine[c + 1]), key=lambda v: abs(abs(v) - abs(white[c])))
            if abs(white[c]) > 1e-3:
                sign = np.sign(value * white[c])
                signs[c] = signs[c] or sign
                assert sign == signs[c]
            assert abs(value - signs[c] * white[c]) < tolerance or abs(white[c]) <= 1e-3
            assert abs(mine[c + 1][0].explained / shares[c] - 1) < 1e-9
            assert mine[c + 1][0].identity_error < 1e-9


def gaussian(n, dims, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    spread = np.linspace(2.0, 0.3, dims) if spread is None else spread
    return [(i, v) for i, v in enumerate((rng.standard_normal((n, dims)) * spread).tolist())]


@pytest.mark.parametrize("block", [1, 8])
def test_equals_dense_decomposition(spark, block):
    check(spark, gaussian(300, 24), block=block)


def test_repeats_count_once_and_ragged_and_bad_rows(spark):
    rows = gaussian(60, 5)
    rows += [(100, rows[0][1]), (101, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]),
             (102, [1.5, 2.0]), (103, []), (104, None), (105, [1.0, None, 1.0, 1.0, 1.0]),
             (106, [math.nan] * 5), (107, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    check(spark, rows)


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(3)
    steps = rng.integers(-50, 50, (200, 3)) @ rng.integers(-3, 4, (3, 20))
    check(spark, [(i, (v / 64).tolist()) for i, v in enumerate(steps)], components=3)


def test_equal_variances(spark):
    corners = [(i, [float(s * (j == k)) for k in range(12)])
               for i, (j, s) in enumerate((j, s) for j in range(12) for s in (-1, 1))]
    got = whitened_rows(table(spark, corners), components=12).collect()
    assert {r.component for r in got} == set(range(1, 13))
    assert all(abs(r.explained - 1 / 12) < 1e-12 and r.identity_error < 1e-12 for r in got)


def test_far_apart_spreads(spark):
    check(spark, gaussian(400, 20, 5, np.logspace(3, 0, 20)), tolerance=1e-7)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, []), (2, [])],
                                  [(1, [3.0, 1.0]), (2, [3.0, 1.0])]])
def test_tables_without_components(spark, rows):
    got = whitened_rows(table(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"]
    assert got.isEmpty()


def test_entries_beyond_64_bits(spark):
    random.seed(1)
    rows = [(i, [random.uniform(-3e38, 3e38), 1e300, float(i)]) for i in range(5)]
    got = whitened_rows(table(spark, rows)).collect()
    assert got and all(r.deviation is None for r in got)
    assert all(math.isfinite(r.whitened) for r in got)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(i * 2**30 + i * i), float(i % 7) * 2**28]) for i in range(40)]
    check(spark, rows)


def test_recurrence_alone():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 40)) * np.logspace(0, -3, 40)

    def product(a, w):
        y = x @ a
        return (x @ w).T @ y, y.T @ y, x.T @ y

    for width in (1, 3, 8):
        vectors, values = bidiagonalise(product, 40, 16, width, float((x * x).sum()))
        _, want, axes = np.linalg.svd(x, full_matrices=False)
        assert np.allclose(values[:16], want[:16], rtol=1e-12)
        assert np.allclose(np.abs((axes[:16] @ vectors[:, :16]).diagonal()), 1, atol=1e-12)


def test_fit_reads_grid_vectors(spark):
    model = fit_whitening(on_grid(table(spark, gaussian(50, 4)), "vec_id", "embedding"))
    assert model.rows == 50 and model.components.shape == (4, 4)
    assert np.allclose(model.components.T @ model.components, np.eye(4), atol=1e-13)
