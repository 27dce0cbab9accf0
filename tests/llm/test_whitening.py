from __future__ import annotations

import math

import numpy as np
import pytest

from demandflow.llm.whitening import Spectrum, WhitenParams, rank_one, whiten

SCHEMA = "vec_id long, embedding array<float>, n int, v string"


def plain(rows, components=32):
    """(ids, x, unit eigenvectors by falling eigenvalue, eigenvalues, trace) of the rows that take part."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good])
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return [i for i, _ in good], x, vectors[:, ::-1][:, :components], values[::-1][:components], values.sum()


def made(seed=3, n=300, size=10):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(size, size)) * np.geomspace(3, 0.05, size)[:, None]
    return [(i, [float(c) for c in row]) for i, row in enumerate(rng.normal(size=(n, size)) @ mix + rng.normal(size=size))]


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(parts)


def test_rank_one_updates_equal_a_dense_solver():
    rng = np.random.default_rng(1)
    for t in range(200):
        k = int(rng.integers(1, 12))
        d = np.sort(rng.choice([0, 0, 1, 1.5, 2, 1e6, 1e-9], k) if t % 2 else rng.normal(size=k) ** 2 * 1e3)
        z, weight = rng.normal(size=k) * rng.choice([0, 1, 1e-8, 1e3], k), float(rng.random() + 0.1)
        values, vectors = rank_one(d, z, weight)
        dense = np.diag(d) + weight * np.outer(z, z)
        want = np.linalg.eigvalsh(dense)
        size = max(np.abs(want).max(), 1e-300)
        assert np.abs(values - want).max() <= 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-8
        assert np.abs(vectors @ np.diag(values) @ vectors.T - dense).max() <= 1e-9 * size


@pytest.mark.parametrize("cuts", [(0, 40), (0, 1, 2, 3, 40), (0, 15, 39, 40)])
def test_spectrum_of_parts_is_that_of_all(cuts):
    x = np.random.default_rng(5).normal(size=(40, 6)) * [1, 2, 3, 4, 0, 1e-3] + 7
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        s = Spectrum.empty(6)
        s.add_block(x[a:b])
        parts.append(s)
    total = Spectrum.empty(6)
    for s in parts:
        total.join(s)
    centred = x - x.mean(axis=0)
    assert total.n == 40 and total.mean == pytest.approx(x.mean(axis=0))
    assert total.values == pytest.approx(np.linalg.eigvalsh(centred.T @ centred), abs=1e-9)
    back = total.vectors @ np.diag(total.values) @ total.vectors.T
    assert np.abs(back - centred.T @ centred).max() < 1e-9


@pytest.mark.parametrize("p", [WhitenParams(), WhitenParams(components=4, block_rows=7, fan_in=2)])
def test_equals_plain_whitening(spark, p):
    rows = made()
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[5][1])]  # repeated rows and a null id
    bad = [(900, None), (901, []), (902, [None] + [0.0] * 9), (903, [math.nan] + [0.0] * 9), (904, [math.inf] * 10), (905, [1.0] * 3)]
    ids, x, vectors, values, trace = plain(rows, p.components)
    got = whiten(table(spark, rows + bad), p).collect()
    assert len(got) == len(ids) * len(values)
    n, sums = len(x), x.sum(axis=0)
    want = {}
    for i, row in zip(ids, x):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
        for c, e in enumerate(values):
            want.setdefault((i, c + 1), []).append((deviation, float((row - sums / n) @ vectors[:, c] / math.sqrt(e))))
    seen = {}
    for r in got:
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9) and r.identity_error < 1e-8
        seen.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
    assert seen.keys() == want.keys()
    signs = {}
    for key, found in seen.items():
        assert sorted(d for d, _ in found) == sorted(d for d, _ in want[key])
        assert sorted(abs(w) for _, w in found) == pytest.approx(sorted(abs(w) for _, w in want[key]), abs=1e-7)
        if len(found) == 1 and abs(found[0][1]) > 1e-3:
            signs.setdefault(key[1], set()).add(found[0][1] * want[key][0][1] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_degenerate_tables(spark):
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    # One dimension is constant and two move together: one component is left.
    line = whiten(table(spark, [(i, [1.0, float(i), 2.0 * i]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9
    assert sum(r.whitened for r in line) == pytest.approx(0, abs=1e-9)
    assert sum(r.whitened**2 for r in line) / 9 == pytest.approx(1)
    # Equal eigenvalues: any basis of their space whitens.
    square = whiten(table(spark, [(i, v) for i, v in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])])).collect()
    assert {r.component for r in square} == {1, 2} and max(r.identity_error for r in square) < 1e-9
