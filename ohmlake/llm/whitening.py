"""Embedding whitening (operator 11).

Three passes over the vectors, each adding up within a task and then by row of the matrix: sums, the scatter of
centred vectors, and the covariance of what came out. A matrix of dimension times dimension is all that reaches
the driver. There the covariance V is factored by Cholesky with the largest remaining diagonal entry as the next
pivot, P'VP = LL'; it ends at a pivot that is rounding, which gives the rank. One-sided Jacobi then rotates the
columns of L itself until they are orthogonal: no product is formed again, so small eigenvalues stay accurate. The
rotated columns' squared norms are the eigenvalues, and the normalised columns, with P undone, the components.

Entries c become whole numbers x = floor(scale * c) + offset. Sums are exact at any size (high and low halves), and a
vector is centred as n * x - S in whole numbers before anything is multiplied.

Vectors that are null, empty or hold null or non-finite entries, or entries whose x is no long, are dropped; all others
are fitted and whitened, repeated ones as often as they stand there. Where lengths differ, no covariance
exists: the length that most vectors have is kept (ties: the shorter), and others are dropped. A component beyond the rank has
eigenvalue 0: its whitened values are null, and it takes no part in identity_error. Equal vectors only (or one):
every component is such, and explained is null. No vectors: no rows. A deviation that exceeds a long is null.
Columns that are added replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import read

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32

#: Numbers of the matrices that one step of a task takes.
CELLS = 1 << 18
_LOW = (1 << 31) - 1


@dataclass
class Whitening:
    """n and sums (whole numbers) of the fitted vectors; components as rows, by falling eigenvalue; trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int = SCALE
    offset: int = OFFSET

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.eigenvalues]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers: longs where they fit, else Python's."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, z: np.ndarray, components: int) -> np.ndarray:
        """Of centred vectors; NaN for components without variance."""
        e = self.eigenvalues[:components]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(e > 0, (z.astype(float) / self.n) @ self.components[:components].T / np.sqrt(e), np.nan)


def _whole(vectors: pa.Array, dim: int | None, scale: int, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as rows) of the vectors that count, in steps; all of one length, ``dim`` if that is given."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in [dim] if dim else np.unique(sizes[sizes > 0]).tolist():
        rows, step = np.flatnonzero(sizes == d), max(1, CELLS // d)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            flat = vectors.take(pa.array(own)).flatten()
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(own), d))
                ok = (np.abs(x) < 2.0**62).all(axis=1)  # false for nulls, which are NaN here
            yield own[ok], x[ok].astype(np.int64) + offset


def _added(df: DataFrame, vector: str, start: Callable[[], dict], kind: str) -> DataFrame:
    """(key, values): arrays that tasks added up by key, added up over all tasks.

    start() gives a function from an Arrow array of vectors to (key, array) pairs.
    """

    def add(total: dict, key, values: np.ndarray) -> None:
        total[key] = total[key] + values if key in total else values

    def rows(total: dict) -> Iterator[pa.RecordBatch]:
        for key, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([values.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["key", "values"])

    def first(batches):
        total, work = {}, start()
        for batch in batches:
            for key, values in work(batch.column(0)):
                add(total, key, values)
        yield from rows(total)

    def second(batches):
        total = {}
        for batch in batches:
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                add(total, key, values.values.to_numpy(zero_copy_only=False))
        yield from rows(total)

    parts = df.select(vector).mapInArrow(first, f"key long, values array<{kind}>")
    return parts.repartition("key").mapInArrow(second, f"key long, values array<{kind}>")


def _dense(found: DataFrame, dim: int) -> np.ndarray:
    """The matrix of (key, values) rows: dimension times dimension at most."""
    out = np.zeros((dim, dim))
    for key, values in found.collect():
        out[key] = values
    return out


def fit(df: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """Fitted on every vector of df; None if there is none."""

    def sums():
        def work(vectors):
            for own, x in _whole(vectors, None, scale, offset):
                if len(own):  # count, then high and low halves; a step's low halves fit a long many times over
                    yield x.shape[1], np.concatenate([[len(own)], (x >> 31).sum(axis=0), (x & _LOW).sum(axis=0)])

        return work

    found = {key: list(map(int, values)) for key, values in _added(df, vector, sums, "long").collect()}
    if not found:
        return None
    dim = min(found, key=lambda d: (-found[d][0], d))
    n, high, low = found[dim][0], found[dim][1 : dim + 1], found[dim][dim + 1 :]
    model = Whitening(n, [(a << 31) + b for a, b in zip(high, low)], np.zeros((0, dim)), np.zeros(0), 0.0, scale, offset)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scatter():
        own = shared.value

        def work(vectors):
            for _, x in _whole(vectors, dim, scale, offset):
                z = own.centred(x).astype(float) / own.n
                yield from enumerate(z.T @ z)

        return work

    v = _dense(_added(df, vector, scatter, "double"), dim) / n
    shared.destroy()
    factor, pivots = cholesky(v)
    components, e = jacobi(factor)
    model.components = np.zeros((dim, dim))
    model.components[: len(e), pivots] = components
    model.eigenvalues = np.concatenate([e, np.zeros(dim - len(e))])
    if len(e) < dim:  # any orthonormal rest will do for what has no variance
        q = np.linalg.qr(np.concatenate([model.components[: len(e)].T, np.eye(dim)], axis=1))[0]
        model.components[len(e) :] = q[:, len(e) :].T
    model.trace = float(np.trace(v))
    return model


def cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, pivots): v[pivots][:, pivots] = L @ L.T, L lower triangular with as many columns as the rank; the largest pivot comes first."""
    a, d = v.astype(float), len(v)
    pivots, factor, rank = np.arange(d), np.zeros((d, d)), 0
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if not a[p, p] > least:
            break
        for m in (a, a.T, factor):  # rows and columns k and p change places
            m[[k, p]] = m[[p, k]]
        pivots[[k, p]] = pivots[[p, k]]
        factor[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
        rank += 1
    return factor[:, :rank], pivots


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, eigenvalues, falling) of factor @ factor.T, by rotating columns of the factor until all are orthogonal.

    Pairs are worked off as a tournament, so that those of one round share no column and are rotated at once.
    """
    g = factor.T.copy()  # a column is a row here
    n = len(g)
    ring = np.arange(n + n % 2)  # with an odd number one column rests each round
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            a, b = ring[:half], ring[half:][::-1]
            play = (a < n) & (b < n)
            a, b = a[play], b[play]
            p, q = g[a], g[b]
            pp, qq, pq = (p * p).sum(axis=1), (q * q).sum(axis=1), (p * q).sum(axis=1)
            off = np.abs(pq) > np.finfo(float).eps * np.sqrt(pp * qq)
            if off.any():
                turned = True
                a, b, p, q, pp, qq, pq = a[off], b[off], p[off], q[off], pp[off], qq[off], pq[off]
                zeta = (qq - pp) / (2 * pq)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = (1 / np.hypot(1.0, t))[:, None]
                s = c * t[:, None]
                g[a], g[b] = c * p - s * q, s * p + c * q
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    norms = np.sqrt((g * g).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    return g[order] / norms[order][:, None], norms[order] ** 2


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    k = int((model.eigenvalues[:components] > 0).sum())
    shared = df.sparkSession.sparkContext.broadcast(model)

    def products():
        own = shared.value

        def work(vectors):
            for _, x in _whole(vectors, len(own.sums), own.scale, own.offset):
                w = own.whitened(own.centred(x), k)
                yield k, w.sum(axis=0)  # what is left of the means, beside the products
                yield from enumerate(w.T @ w)

        return work

    if not k:
        return 0.0
    found = {key: np.array(values) for key, values in _added(df, vector, products, "double").collect()}
    shared.destroy()
    means = found[k] / model.n
    covariance = np.stack([found[i] for i in range(k)]) / model.n - np.outer(means, means)
    return float(np.abs(covariance - np.eye(k)).max())


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", components: int = COMPONENTS, drop_vector: bool = False) -> DataFrame:
    """The rows of df whose vectors count, with deviation (sum of squares of n * x - S, exact) and whitened (array, null without variance); no shuffle."""
    k = min(components, len(model.sums))
    shared = df.sparkSession.sparkContext.broadcast(model)
    base = df.drop(*[c for c in df.columns if c.lower() in ("deviation", "whitened") and c != vector])
    place = base.columns.index(vector)
    keep = [i for i, c in enumerate(base.columns) if i != place or not (drop_vector or c.lower() in ("deviation", "whitened"))]
    schema = StructType([base.schema.fields[i] for i in keep] + _parse_datatype_string("deviation long, whitened array<double>").fields)

    def run(batches):
        own = shared.value
        for batch in batches:
            for rows, x in _whole(batch.column(place), len(own.sums), own.scale, own.offset):
                z = own.centred(x)
                if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] >= 1 << 63:
                    z = z.astype(object)
                deviation = [int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1).tolist()]
                w = own.whitened(z, k).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(w, from_pandas=True))
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([out.column(i) for i in keep] + [pa.array(deviation, pa.int64()), lists], names=[f.name for f in schema])

    return base.mapInArrow(run, schema)


def op11_whitening(spark, sf_dir) -> DataFrame:
    """Per vector and component up to 32: exact deviation, whitened value, share of variance, and the error of the whole."""
    df = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(df)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = transform(df, model, drop_vector=True).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained[:COMPONENTS]])
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(df, model)).alias("identity_error"),
    )
