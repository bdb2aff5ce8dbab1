"""Whitening against numpy's eigenvectors and Python's whole numbers."""

import math

import numpy as np
import pytest

from opslens.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, id string, whitened string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "i", "w", "n") for i, v in rows], SCHEMA)


def random_rows(seed, count=400, d=20):
    rng = np.random.default_rng(seed)
    found = rng.standard_normal((count, d)) @ rng.standard_normal((d, d)) * rng.uniform(0.01, 3, d)
    rows = [(n, [float(np.float32(c)) for c in v]) for n, v in enumerate(found)]
    return rows + [(count + n, rows[n % 7][1]) for n in range(150)]  # repeated vectors


ODD = [(9001, None), (9002, []), (9003, [1.0]), (9004, [None] * 20), (9005, [math.nan] * 20), (9006, [math.inf] * 20)]


def plain(rows, d):
    """n, sums, deviation by id, covariance; in whole numbers and fractions."""
    kept = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)}
    fit = [list(v) for v in {tuple(v) for v in kept.values()}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    apart = {i: [n * c - t for c, t in zip(x, s)] for i, x in kept.items()}
    centred = np.array([[float(n * c - t) / n for c, t in zip(x, s)] for x in fit])
    return n, apart, centred.T @ centred / n, centred


def test_like_plain(spark):
    rows = random_rows(1)
    found = whitening.whitening_report(vectors(spark, rows + ODD).repartition(5)).collect()
    n, apart, v, _ = plain(rows, 20)
    values, components = np.linalg.eigh(v)
    values, components = values[::-1], components[:, ::-1]
    assert len(found) == 16 * len(apart)
    assert {r.n for r in found} == {n}
    assert all(r.deviation == sum(c * c for c in apart[r.vec_id]) for r in found)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    for c in range(16):
        mine = {r.vec_id: r for r in found if r.component == c + 1}
        assert len(mine) == len(apart)
        theirs = {i: float(np.array(a, float) / n @ components[:, c]) / math.sqrt(values[c]) for i, a in apart.items()}
        sign = 1 if sum(mine[i].whitened * theirs[i] for i in mine) > 0 else -1
        assert max(abs(sign * mine[i].whitened - theirs[i]) for i in mine) < 1e-8
        assert abs(mine[0].explained - values[c] / values.sum()) < 1e-9 * mine[0].explained


@pytest.mark.parametrize("values", [
    [5, 5, 5, 5], [1, 1, 1, 2, 2, 3], [1e8, 1, 1e-6], [0, 0, 4, 9], list(range(40)), [3], [7, 7 + 1e-9, 7 - 1e-9, 1], [0, 0],
    [2.0**-k for k in range(30)],
])
def test_spectrum(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    v = q @ np.diag(np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    found, vectors = whitening.spectrum(v)
    scale = max(np.abs(v).max(), 1e-300)
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-13 * len(v) * scale, rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-13 * len(v)
    assert np.abs(v @ vectors - vectors * found).max() <= 1e-13 * len(v) * scale


def test_polar_is_orthogonal():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(u - vectors * np.sign(values) @ vectors.T).max() < 1e-12


def test_products_are_exact():
    rng = np.random.default_rng(4)
    for most in (5, 10**6, 2**30, 2**55):
        y = rng.integers(-most, most, (50, 4))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()


def test_large_numbers(spark):
    """Deviations beyond 63 bits are null; products are still exact."""
    rows = [(n, [float(2**54 * (n % 2)), float(n)]) for n in range(10)]
    found = whitening.whitening_report(vectors(spark, rows)).collect()
    assert len(found) == 20 and {r.deviation for r in found} == {None}
    assert found[0].identity_error < 1e-6


def test_flat_and_small_tables(spark):
    none = whitening.whitening_report(vectors(spark, []))
    assert none.count() == 0 and none.columns[:2] == ["vec_id", "component"]
    assert whitening.whitening_report(vectors(spark, ODD[:2] + ODD[3:])).count() == 0
    one = whitening.whitening_report(vectors(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whitening_report(vectors(spark, [(n, [float(n), 7.0]) for n in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    assert flat[0].identity_error < 1e-12
