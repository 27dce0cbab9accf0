from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from demandflow.llm import neighbours as nn

SHAPE = "vec_id long, embedding array<float>, rank int"


def plain(vectors, queries, k=5):
    good = {i: np.array(v, np.float64) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    out = {}
    for q in queries:
        if q in good:
            scored = [(-float(nn.exact_cosine(good[q][None], v[None])[0]), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def rows_of(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = (centres[rng.integers(20, size=n)] + 0.5 * rng.normal(size=(n, dim))).astype(np.float32)
    x[50:90] = x[50]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim", [2, 24])
def test_factor_one_is_exact(spark, dim):
    rows = rows_of(1, 900, dim)
    rows += [(900, None), (950, [0.0] * dim), (1000, [float("nan")] * dim), (1050, [None, *[1.0] * (dim - 1)]), (1100, []), (1150, [1.0]), (None, [1.0] * dim), (1200, [float("inf")] * dim)]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE)
    p = nn.SearchParams(relax=1.0, shard_rows=200, query_rows=7, leaf_rows=8)
    got = found(nn.nearest_neighbours(d, d.where("vec_id % 50 = 0"), p))
    want = plain([r for r in rows if r[0] is not None], [i for i, _ in rows if i is not None and i % 50 == 0])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    for q, v in got.items():
        assert [s for _, s in v] == [s for _, s in want[q]]


def test_recall_of_the_production_factor(spark):
    rows = rows_of(2, 4000, 64)
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE)
    queries = list(range(0, 4000, 50))
    got, want = found(nn.nearest_neighbours(d, d.where("vec_id % 50 = 0"))), plain(rows, queries)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in queries)
    assert hits >= 0.95 * 5 * len(queries)


def test_ties_by_direction_and_by_angle(spark):
    """Multiples of one vector tie exactly, as do vectors at the same angle: the smaller ids win."""
    rows = [(i, [2.0 ** ((7 * i) % 13 - 6), 2.0 ** ((7 * i) % 13 - 6)]) for i in range(1, 41)]
    rows += [(100 + i, [0.0, float(1 + i % 3)]) for i in range(20)] + [(200 + i, [0.0, -float(1 + i % 3)]) for i in range(20)]
    rows += [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (50, [3.0, 0.0])]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE)
    p = nn.SearchParams(relax=1.0, shard_rows=1000, leaf_rows=4)
    got = found(nn.nearest_neighbours(d, d.where("vec_id in (0, 50, 200)"), p))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[200]][:5] == [201, 202, 203, 204, 205]
    want = plain([(i, v) for i, v in rows if i], [50])[50]
    every = sorted([(i, s) for i, s in plain(rows, [50], 99)[50]], key=lambda x: (-x[1], x[0]))[:5]
    assert got[50][0][0] in (0, 1) and [s for _, s in got[50]] == [s for _, s in every]
    assert len(want) == 5


def test_few_and_no_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0], 0), (7, [1.0, 1.0], 0)], SHAPE)
    assert [i for i, _ in found(nn.nearest_neighbours(d, d.where("vec_id = 0")))[0]] == [7]
    assert nn.nearest_neighbours(d.limit(0), d).collect() == [] and nn.nearest_neighbours(d, d.limit(0)).collect() == []


@pytest.mark.parametrize("dim", [2, 16])
def test_gaps_of_cells_are_no_longer_than_distances(dim):
    """Vectors of a length without centres share a cell of their own; coinciding centres are one."""
    x = np.array([v for _, v in rows_of(4, 600, dim)], np.float64)
    cells = nn.Cells([v.tolist() for v in x[:40]] + [(2 * x[0]).tolist(), [1.0]])
    first, centres = cells.of[dim]
    home, far = cells.home(pd.Series([*x, [1.0, *[2.0] * dim]]))
    assert home[-1] == -1 and far[-1] == 0 and len(centres) == 40 and set(home[:-1]) <= set(range(first, first + 40))
    n = first + len(centres)
    own = [far[home == c] for c in range(n)]
    low, high = np.array([v.min(initial=2) for v in own]), np.array([v.max(initial=0) for v in own])
    u = nn.unit(x)
    gap = cells.gaps(u, first, centres, low, high)
    true = nn.chord(u @ u.T)
    for c in range(len(centres)):
        inside = home[:-1] == first + c
        if inside.any():
            assert (gap[:, c] <= true[:, inside].min(axis=1) + 1e-6).all()
    assert (gap > 0).mean() > 0.5
