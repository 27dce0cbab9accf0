"""Nearest neighbours by cosine with vantage-point trees, one tree a shard of bounded size.

Rows are put into cells by the nearest of a bounded sample of vectors, the centres, and each cell is cut into
shards. A query is searched in its own cell first; the distance of its last neighbour there tells which
other cells may hold nearer ones, and only those see it.

On unit vectors the chord length orders as the cosine does and keeps the triangle inequality. A node
holds a vantage point and, for each of its halves, the smallest and largest distance to it; a query
skips a half when its own distance to the vantage point shows that nothing there can be near enough.
`relax` scales that proof, for cells too: with 1 it is strict and the search exact, above 1 halves go earlier.
Shards and blocks of queries meet in bounded groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandflow.session import cut_lineage


@dataclass(frozen=True)
class SearchParams:
    nearest: int = 5
    relax: float = 1.05
    shard_rows: int = 2048  # vectors in a tree, about
    query_rows: int = 2048  # queries in a block, about
    centres: int = 1024  # cells at most, one for each shard's worth of rows up to that; a larger cell has more shards
    leaf_rows: int = 64
    seed: int = 11


#: Distances so much apart may be equal but for rounding.
SLACK = 1e-6
#: Candidates that are compared exactly at a time, about.
PAIRS = 50_000


class VantageTree:
    """Tree over unit vectors (rows of `points`)."""

    def __init__(self, points: np.ndarray, leaf_rows: int, seed: int):
        self.points, self.rng, self.leaf_rows = points, np.random.default_rng(seed), leaf_rows
        self.root = self._node(np.arange(len(points)))

    def _node(self, rows: np.ndarray):
        if len(rows) <= self.leaf_rows:
            return rows
        vantage = self.points[rows[self.rng.integers(len(rows))]]
        far = chord(self.points[rows] @ vantage)
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        sides = [order[:half], order[half:]]
        return vantage, [(far[s].min(), far[s].max(), self._node(rows[s])) for s in sides]

    def search(self, queries: np.ndarray, nearest: int, relax: float, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distance of the last, rows) of each query's `nearest` found, nearest first; its `reach` (else infinite) and -1 where fewer are within it."""
        n = len(queries)
        best, found = np.full((n, nearest), np.inf), np.full((n, nearest), -1)
        if reach is not None:
            best[:] = reach[:, None]
        slack = SLACK

        def visit(node, asked: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                far = chord(queries[asked] @ self.points[node].T)
                both = np.concatenate([best[asked], far], axis=1)
                rows = np.concatenate([found[asked], np.broadcast_to(node, far.shape)], axis=1)
                order = np.argsort(both, axis=1, kind="stable")[:, :nearest]
                best[asked], found[asked] = np.take_along_axis(both, order, 1), np.take_along_axis(rows, order, 1)
                return
            vantage, halves = node
            far = chord(queries[asked] @ vantage)
            gaps = [np.maximum(0, np.maximum(low - far, far - high)) for low, high, _ in halves]
            second = gaps[1] < gaps[0]
            second |= (gaps[0] == gaps[1]) & (np.abs(far - halves[1][0]) < np.abs(far - halves[0][1]))
            for turn in (0, 1):  # each query's nearer half, then the other if it may still hold something
                for side in (0, 1):
                    some = second == (side != turn)
                    some &= gaps[side] * relax <= best[asked, -1] + slack
                    if some.any():
                        visit(halves[side][2], asked[some])

        if n and len(self.points):
            visit(self.root, np.arange(n))
        return best[:, -1], found

    def within(self, queries: np.ndarray, reach: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all points no farther than each query's reach, so that ties at it are whole."""
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def visit(node, asked: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                at, row = np.nonzero(chord(queries[asked] @ self.points[node].T) <= reach[asked, None])
                pairs.append((asked[at], node[row]))
                return
            vantage, halves = node
            far = chord(queries[asked] @ vantage)
            for low, high, half in halves:
                some = np.maximum(0, np.maximum(low - far, far - high)) * relax <= reach[asked]
                if some.any():
                    visit(half, asked[some])

        if len(queries) and len(self.points):
            visit(self.root, np.arange(len(queries)))
        return tuple(np.concatenate(c) for c in zip(*pairs))


def chord(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors of that cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow on the way."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Cells:
    """Centres by the vectors' length; a vector of a length without centres belongs to cell -1."""

    def __init__(self, sample: list[list[float]]):
        self.of: dict[int, tuple[int, np.ndarray]] = {}  # number of the first cell, centres
        first = 0
        for size in sorted({len(v) for v in sample}):
            points = unit(np.array([v for v in sample if len(v) == size]))
            # Centres that nearly coincide part no cells.
            _, own = np.unique(np.round(points, 6), axis=0, return_index=True)
            self.of[size] = first, points[np.sort(own)]
            first += len(own)

    def by_length(self, vectors: pd.Series):
        """(places, first cell, centres, unit vectors) for each length, some hundred vectors at a time; no centres: None."""
        sizes = vectors.map(len).to_numpy()
        for size in np.unique(sizes):
            every = np.flatnonzero(sizes == size)
            for at in (every[i : i + 512] for i in range(0, len(every), 512)):
                yield at, *self.of.get(int(size), (-1, None)), unit(np.stack(vectors.to_numpy()[at]).astype(np.float64))

    def home(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centre) of each vector."""
        cell, far = np.full(len(vectors), -1), np.zeros(len(vectors))
        for at, first, centres, x in self.by_length(vectors):
            if centres is not None:
                d = chord(x @ centres.T)
                near = d.argmin(axis=1)
                cell[at], far[at] = first + near, d[np.arange(len(at)), near]
        return cell, far

    def gaps(self, x: np.ndarray, first: int, centres: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least possible distance of each vector (row) to what is in each cell of its length; 0 for its own cell.

        By the triangle inequality from the cell's nearest and farthest row, and from the plane between the
        cell's centre and the vector's own, beyond which the cell lies.
        """
        d = chord(x @ centres.T)
        near = d.argmin(axis=1)
        cells = slice(first, first + len(centres))
        apart = chord(centres @ centres.T)[near]
        plane = (d**2 - d.min(axis=1, keepdims=True) ** 2) / np.maximum(2 * apart, 1e-12)
        gap = np.maximum(np.maximum(low[cells] - d, d - high[cells]), np.maximum(plane, 0))
        gap[np.arange(len(x)), near] = 0
        return gap


def _runs(q: np.ndarray, many: np.ndarray):
    """Ranges of whole queries (`q` is sorted) with about `PAIRS` candidates each."""
    ends = np.append(np.flatnonzero(np.diff(q)) + 1, len(q)) if len(q) else np.zeros(0, np.int64)
    lo, held = 0, 0
    for first, end in zip(np.append(0, ends[:-1]), ends):
        held += int(many[first:end].sum())
        if held >= PAIRS:
            yield lo, end
            lo, held = end, 0
    if lo < len(q):
        yield lo, len(q)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of corresponding rows in double precision; equal rows give equal results wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and has finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, p: SearchParams = SearchParams(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): each query's nearest found, ties to the smaller vec_id.

    `queries` has the same two columns; a query is not compared with rows of its own id. Rows without
    id and vectors that `usable` refuses take no part. Vectors of another length than a query's are not
    its candidates. Repeated queries count once, repeated vectors of one id are candidates each. Fewer
    candidates give fewer rows, empty tables none. The centres, at most `centres` rows of smallest hash, reach the
    driver and the tasks; every row is indexed.
    """
    def both(t: DataFrame) -> DataFrame:
        # Single-precision vectors stay so until they are compared: half as many bytes are shuffled.
        x = F.col(vector) if t.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
        return usable(t.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")), "x").where("id is not null")

    spark, context = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = both(vectors)
    wanted = min(p.centres, math.ceil(rows.count() / p.shard_rows))
    cells = context.broadcast(Cells([r.x for r in rows.orderBy(F.xxhash64("x"), F.xxhash64("id")).select("x").limit(wanted).collect()]))

    def housed(batches):
        for t in batches:
            t["cell"], t["far"] = cells.value.home(t["x"])
            yield t

    kind = lambda t: t.schema["x"].dataType.simpleString()
    place = lambda t: cut_lineage(t.mapInPandas(housed, f"id long, x {kind(t)}, cell int, far double"))
    rows, asked = place(rows), place(both(queries).dropDuplicates(["id"]))
    # A row a cell: at most the number of centres and one.
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
    low, high = np.zeros(p.centres), np.full(p.centres, 2.0)
    for r in sizes:
        if r.cell >= 0:
            low[r.cell], high[r.cell] = r.low, r.high
    bounds = context.broadcast((low, high))
    layout = spark.createDataFrame([(r.cell, math.ceil(r.n / p.shard_rows)) for r in sizes], "cell int, shards int")
    nearest, leaf_rows, seed, relax = p.nearest, p.leaf_rows, p.seed, p.relax

    def search(here: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = here["x"].map(len), ask["x"].map(len)
        for size in np.intersect1d(sizes[0].unique(), sizes[1].unique()):
            h, a = here[sizes[0] == size].sort_values("id", kind="stable"), ask[sizes[1] == size]
            x, y = (np.stack(t["x"].to_numpy()).astype(np.float64) for t in (h, a))
            names, own = h["id"].to_numpy(np.int64), a["id"].to_numpy(np.int64)
            # Vectors of one direction are one point of the tree, and a query's own is one point more. All points up to
            # the distance of the last one count, and all vectors of a point: the exact cosine and the id decide.
            points, point = np.unique(unit(x), axis=0, return_inverse=True)
            members = np.argsort(point.ravel(), kind="stable")
            starts = np.searchsorted(point.ravel()[members], np.arange(len(points) + 1))
            tree, asked = VantageTree(points, leaf_rows, seed), unit(y)
            reach, _ = tree.search(asked, nearest + 1, relax, a["reach"].to_numpy(np.float64))
            q, at = tree.within(asked, reach + SLACK, relax)
            q, at = (v[np.argsort(q, kind="stable")] for v in (q, at))
            many = starts[at + 1] - starts[at]
            for lo, hi in _runs(q, many):
                n = many[lo:hi]
                rows = members[np.repeat(starts[at[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                of = np.repeat(q[lo:hi], n)
                of, rows = of[names[rows] != own[of]], rows[names[rows] != own[of]]
                score = exact_cosine(y[of], x[rows])
                best = np.lexsort((names[rows], -score, of))
                place = np.arange(len(best)) - np.searchsorted(of[best], of[best])
                best = best[place < nearest]
                out.append(pd.DataFrame({"query_id": own[of[best]], "vec_id": names[rows[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def met(asks: DataFrame) -> DataFrame:
        """Candidates of queries (id, x, reach) in the cells they ask: each shard once for every block of queries."""
        load = asks.groupBy("cell").agg(F.ceil(F.count("*") / p.query_rows).cast("int").alias("blocks")).join(layout, "cell")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.join(load, "cell").select("cell", F.pmod(F.xxhash64("id", "x"), F.col("shards")).alias("shard"), each("blocks").alias("block"), "id", "x")
        right = asks.join(load, "cell").select("cell", each("shards").alias("shard"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "x", "reach")
        right = right.withColumn("shard", F.col("shard").cast("long"))
        keys = ["cell", "shard", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    # A few rows a shard for each query; ranking keeps only the first of them in each task's sort buffer.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda t: t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    own = cut_lineage(ranked(met(asked.withColumn("reach", F.lit(float("inf"))))).drop("rank"))
    last = own.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == nearest, F.min("score")).alias("last"))
    farther = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("last"))), F.lit(float("inf")))

    def routed(batches):
        for t in batches:
            for at, first, centres, x in cells.value.by_length(t["x"]):
                if centres is not None:
                    gap = cells.value.gaps(x, first, centres, *bounds.value)
                    gap[np.arange(len(at)), t["cell"].to_numpy()[at] - first] = np.inf
                    q, to = np.nonzero(gap * relax <= t["reach"].to_numpy()[at, None] + SLACK)
                    for lo in range(0, len(q), 10_000):
                        yield t[["id", "x", "reach"]].iloc[at[q[lo : lo + 10_000]]].assign(cell=first + to[lo : lo + 10_000])

    others = asked.join(last, "id", "left").select("id", "x", "cell", farther.alias("reach")).mapInPandas(routed, f"id long, x {kind(asked)}, reach double, cell int")
    return ranked(own.unionByName(met(cut_lineage(others)))).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"op10_nearest_neighbours": (query, None)}
