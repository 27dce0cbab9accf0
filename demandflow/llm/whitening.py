"""Embedding whitening by an incremental eigendecomposition.

A spectrum is (n, mean, eigenvalues, eigenvectors) of a set of vectors. A partition adds its rows by rank-one
updates of the centred scatter matrix: in the eigenbasis that is a diagonal plus `weight * z z^T`, whose
eigenvalues are the roots of a secular equation, one between each pair of neighbours; entries that do not
move are deflated first. Rows come in blocks: the triangular factor of a centred block has the block's
scatter and as few rows as there are dimensions, so a block costs that many updates whatever its rows.
Spectra of partitions are combined by the same updates, a few at a time, until one is left. A Rayleigh-Ritz
step over all rows in the basis found so removes what rounding the updates left.

Only matrices of dimension by dimension leave the tasks. Whitened rows are centred, projected on a unit
eigenvector and divided by the root of its eigenvalue.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.llm.common import table
from demandflow.session import cut_lineage

EPS = np.finfo(float).eps


@dataclass(frozen=True)
class WhitenParams:
    components: int = 32
    scale: int = 64  # an entry c becomes floor(scale * c) + offset
    offset: int = 1_000_000
    block_rows: int = 4096  # rows reduced to a triangular factor at a time
    fan_in: int = 16  # spectra combined by a task
    least: float = 1e-12  # eigenvalues up to this share of the largest count as zero and have no component


@dataclass
class Spectrum:
    """n vectors with their mean and the eigenpairs of their scatter, the sum of centred outer products."""

    n: int
    mean: np.ndarray
    values: np.ndarray  # ascending
    vectors: np.ndarray  # columns

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add_direction(self, v: np.ndarray, weight: float) -> None:
        """The scatter grows by weight * v v^T."""
        self.values, turn = rank_one(self.values, self.vectors.T @ v, weight)
        self.vectors = self.vectors @ turn

    def add(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """n more vectors of that mean, whose scatter is rows^T rows."""
        if not n:
            return
        for v in rows:
            self.add_direction(v, 1.0)
        if self.n:
            self.add_direction(mean - self.mean, self.n * n / (self.n + n))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add_block(self, x: np.ndarray) -> None:
        """The rows of x; a block longer than wide is added as its triangular factor."""
        if not len(x):
            return
        mean = x.mean(axis=0)
        centred = x - mean
        self.add(len(x), mean, np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred)

    def join(self, other: Spectrum) -> None:
        self.add(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)


def rank_one(d: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of diag(d) + weight * z z^T, for ascending d and weight > 0."""
    size = len(d)
    z = z * np.sqrt(weight)
    turn = np.eye(size)
    norm = float(z @ z)
    tiny = 8 * EPS * max(np.abs(d).max(initial=0.0), norm)
    # Deflation: an entry of z next to nothing stays; of two equal entries of d a rotation clears one of z.
    z = np.where(z * z <= tiny * EPS, 0.0, z)
    live: list[int] = []
    for i in np.flatnonzero(z):
        if live and d[i] - d[live[-1]] <= tiny:
            j = live.pop()
            r = np.hypot(z[i], z[j])
            c, s = z[i] / r, z[j] / r
            z[i], z[j] = r, 0.0
            turn[:, [i, j]] = np.column_stack([c * turn[:, i] + s * turn[:, j], c * turn[:, j] - s * turn[:, i]])
        live.append(int(i))
    if live:
        at = np.array(live)
        roots, vectors = _secular(d[at], z[at])
        d = d.copy()
        d[at] = roots
        turn[:, at] = turn[:, at] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], turn[:, order]


def _secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(d) + z z^T for strictly ascending d and z without zeros.

    Root j lies between d[j] and d[j + 1] (the last below d[-1] + z z). It is kept as its distance from the
    nearer end, so that its distance to every entry of d is exact; the eigenvectors come from the z for
    which the roots found are exact, and so are orthogonal.
    """
    k, squares = len(d), z * z
    gaps = np.append(np.diff(d), squares.sum())
    middle = d + gaps / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        above = 1 + (squares / (d - middle[:, None])).sum(axis=1) < 0  # the root is in the upper half of its gap
    above[-1] = False
    origin = np.where(above, np.append(d[1:], d[-1]), d)
    from_origin = d - origin[:, None]
    low = np.where(above, -gaps / 2, 0.0)
    high = np.where(above, 0.0, np.where(np.arange(k) == k - 1, gaps, gaps / 2))
    for _ in range(60):
        at = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            below = 1 + (squares / (from_origin - at[:, None])).sum(axis=1) < 0
        low, high = np.where(below, at, low), np.where(below, high, at)
    at = (low + high) / 2
    away = from_origin - at[:, None]  # [root, entry]: d - root
    away = np.where(away == 0, np.finfo(float).tiny, away)
    # |z_i|^2 for which these are the roots: product over j of (root_j - d_i) / (d_j - d_i), paired so that no factor runs away.
    between = d[:, None] - d
    np.fill_diagonal(between, 1.0)
    factors = np.abs(away / between)
    fitted = np.sign(z) * np.exp(np.log(factors).sum(axis=0) / 2)
    vectors = (fitted / away).T
    return origin + at, vectors / np.linalg.norm(vectors, axis=0)


def _valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows whose vector has entries and no null, nan or infinity among them."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    d = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return d.where((F.size("v") > 0) & F.forall("v", finite))


def _blocks(batches: Iterator[pa.RecordBatch], size: int, p: WhitenParams) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x less the offset) in blocks of at most `block_rows` rows."""
    for whole in batches:
        for first in range(0, whole.num_rows, p.block_rows):
            batch = whole.slice(first, p.block_rows)
            flat = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False)
            yield batch.column("vec_id"), np.floor(p.scale * flat).reshape(-1, size)


PACKED = "n long, mean binary, w binary, q binary"


def _row(s: Spectrum) -> pa.RecordBatch:
    blobs = [pa.array([x.astype(float).tobytes()], pa.binary()) for x in (s.mean, s.values, s.vectors)]
    return pa.RecordBatch.from_arrays([pa.array([s.n], pa.int64()), *blobs], ["n", "mean", "w", "q"])


def _spectrum(n: int, *blobs: bytes) -> Spectrum:
    mean, w, q = (np.frombuffer(b, float) for b in blobs)
    return Spectrum(n, mean, w, q.reshape(len(w), len(w)))


def spectrum(valid: DataFrame, size: int, p: WhitenParams = WhitenParams()) -> Spectrum:
    """The spectrum of all vectors (less the offset): one a partition, then combined `fan_in` at a time.

    Each level is written to the shared folder, so a lost executor costs its own part of one level.
    """

    def own(batches):
        s = Spectrum.empty(size)
        for _, x in _blocks(batches, size, p):
            s.add_block(x)
        if s.n:
            yield _row(s)

    def joined(batches):
        s = Spectrum.empty(size)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "w", "q"))):
                s.join(_spectrum(*row))
        if s.n:
            yield _row(s)

    found = cut_lineage(valid.mapInArrow(own, PACKED))
    while (parts := found.count()) > 1:
        found = cut_lineage(found.repartition(-(-parts // p.fan_in)).mapInArrow(joined, PACKED))
    return _spectrum(*found.first())


def _summed(valid: DataFrame, size: int, p: WhitenParams, width: int, of) -> np.ndarray:
    """of(x), an array of `width` numbers, summed over all blocks; partial sums leave the tasks."""

    def run(batches):
        total = None
        for _, x in _blocks(batches, size, p):
            total = of(x) if total is None else total + of(x)
        if total is not None:
            kind = pa.int64() if total.dtype.kind == "i" else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, kind)], ["i", "t"])

    kind = "long" if of(np.zeros((1, size))).dtype.kind == "i" else "double"
    rows = valid.mapInArrow(run, f"i int, t {kind}").groupBy("i").agg(F.sum("t")).collect()
    out = np.zeros(width, np.int64 if kind == "long" else float)
    for i, t in rows:
        out[i] = t
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of x less the offset, by dimension
    values: np.ndarray  # of the covariance, falling, those of the components only
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float


def fit(valid: DataFrame, size: int, p: WhitenParams = WhitenParams()) -> Whitening:
    counted = _summed(valid, size, p, size + 1, lambda x: np.append(x.sum(axis=0), len(x)).astype(np.int64))
    sums, n = counted[:-1], int(counted[-1])
    mean = np.array([int(s) / n for s in sums])
    basis = np.linalg.qr(spectrum(valid, size, p).vectors[:, ::-1])[0]

    def gram(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ basis
        return (y.T @ y).ravel()

    h = _summed(valid, size, p, size * size, gram).reshape(size, size) / n
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    keep = min(p.components, int((values > p.least * max(values[0], 0)).sum()))
    return Whitening(n, [int(s) for s in sums], values[:keep], vectors[:, :keep], float(np.trace(h)))


def whiten(vectors: DataFrame, p: WhitenParams = WhitenParams(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component (1 is the one of largest eigenvalue): vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Null and empty vectors and those with a null, nan or infinite entry take no part, nor do vectors of
    another length than the commonest (of several, the longest). Eigenvalues of next to zero have no
    component, so vectors that are all equal, or a single one, give no rows; nor does an empty table. Equal
    eigenvalues leave their components free within the space they share; one basis of it holds for all rows.
    Repeated rows each count and each return. A null id stays null. `deviation` is exact, or null where it
    does not fit a long. Other columns are not looked at.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    valid = _valid(vectors, vec_id, vector)
    lengths = valid.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = lengths["size"]
    valid = valid.where(F.size("v") == size)
    found = fit(valid, size, p)
    n, sums, count = found.n, np.array(found.sums), len(found.values)
    mean = np.array([s / n for s in found.sums])
    onto = found.vectors / np.sqrt(found.values)
    explained = found.values / found.trace if count else found.values

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ onto
        return np.append(y.sum(axis=0), (y.T @ y).ravel())

    seen = _summed(valid, size, p, count + count * count, moments) / n
    first, second = seen[:count], seen[count:].reshape(count, count)
    error = float(np.abs(second - np.outer(first, first) - np.eye(count)).max(initial=0.0))

    def run(batches):
        for ids, x in _blocks(batches, size, p):
            apart = n * x.astype(np.int64) - sums
            fits = (apart.astype(float) ** 2).sum(axis=1) < 9.2e18
            deviation = [int(v) if ok else None for v, ok in zip((apart * apart).sum(axis=1), fits)]
            rows = len(x)
            again = pa.array(np.repeat(np.arange(rows), count))
            each = lambda v: pa.array(np.tile(v, rows))
            columns = [
                ids.take(again),
                each(np.arange(1, count + 1, dtype=np.int32)),
                pa.array(np.full(rows * count, n, np.int64)),
                pa.array(deviation, pa.int64()).take(again),
                pa.array(((x - mean) @ onto).ravel()),
                each(explained),
                pa.array(np.full(rows * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return valid.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": (query, None)}
