"""Embedding whitening by mixed-precision eigenvectors of the covariance (operator 12).

An entry c becomes the integer x = floor(scale c) + shift, so sums are exact. Four passes
read the embeddings; each sends the driver sums of the size of a vector or of a matrix
(dims x dims), whatever the number of rows:

1. n and the sum S of every dimension;
2. the second moments of y = x - round(S / n), exact integers: from them and S the
   covariance of x follows exactly, since ``n^2 V = n sum(y y') - r r'`` with r = sum(y);
3. the covariance of the whitened rows, centred, for the identity error;
4. the result, row by row.

Eigenvectors of V: ``numpy.linalg.eigh`` of V as float32, then Ogita and Aishima's
refinement in extended precision (numpy's long double): with R = I - X'X and S = X'VX,
X is corrected by X E, ``e_ij = (s_ij + l_j r_ij) / (l_j - l_i)``, matrix products alone and
convergence of second order. Eigenvalues closer than the error bound form a cluster, for
which the quotient means nothing: within it E only restores orthogonality, and then the
cluster's own eigenvectors come from a small problem, ``X_J' (V - mean I) X_J``, whose
entries are as small as the cluster is narrow, so that double precision tells them apart.

Every sum of the passes 1 and 2 is an integer sum, hence the same however rows are
partitioned and whichever tasks are run again.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped;
of vectors of several lengths the most frequent length is kept (the longer one of two
equally frequent), the others are dropped; x is held within +-2**52; repeated rows count and
appear as often as they occur; null ids are kept; with fewer than ``components`` dimensions
there are as many components as dimensions; a component without variance has null
``whitened`` (and is left out of the identity error); a deviation beyond 38 digits is
null; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_LIMIT = 1 << 52
_BIG = Decimal(10) ** 38


# ----------------------------------------------------------------- integers of a batch
def _whole_vectors(column: pa.Array, dims: int | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For each length (or the given one): (row numbers, x as int64 rows) of the vectors to keep."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = ~np.asarray(column.is_null())
    size = np.where(there, np.asarray(column.value_lengths().fill_null(0)), -1)
    values = column.flatten()  # entries of non-null rows, in order
    entries = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    first = np.r_[0, np.cumsum(np.maximum(size, 0))]
    out = []
    for width in np.unique(size[size >= 0]) if dims is None else [dims]:
        rows = np.flatnonzero(size == width)
        if not len(rows):
            continue
        block = entries[first[rows][:, None] + np.arange(width)]
        good = np.isfinite(block).all(axis=1)
        rows, block = rows[good], block[good]
        if len(rows):
            scaled = np.clip(np.floor(block * SCALE), -_LIMIT, _LIMIT).astype(np.int64)
            out.append((rows, scaled + SHIFT))
    return out


def _int_sum(x: np.ndarray) -> np.ndarray:
    """Exact column sums as Python integers."""
    step = max(1, (1 << 62) // (int(np.abs(x).max(initial=0)) + 1))
    return sum((x[lo:lo + step].sum(axis=0).astype(object) for lo in range(0, len(x), step)),
               np.zeros(x.shape[1], dtype=object))


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact y'y as Python integers; by floating-point products while these are exact."""
    top = int(np.abs(y).max(initial=0))
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    if top * top >= 1 << 53:
        wide = y.astype(object)
        return wide.T @ wide
    step = max(1, (1 << 53) // (top * top + 1))
    for lo in range(0, len(y), step):
        part = y[lo:lo + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _decimals(values) -> pa.Array:
    return pa.array([None if abs(v) >= _BIG else Decimal(int(v)) for v in values], pa.decimal128(38, 0))


# ----------------------------------------------------------------------------- passes
def _sums(batches):
    """(width, pos, n, s) for each length and dimension of a task."""
    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for rows, x in _whole_vectors(batch.column("v"), None):
            width = x.shape[1]
            count[width] = count.get(width, 0) + len(rows)
            total[width] = total.get(width, 0) + _int_sum(x)
    for width, n in count.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([width] * (width + 1), pa.int64()), pa.array(range(-1, width), pa.int64()),
             pa.array([n] * (width + 1), pa.int64()), _decimals([0, *total[width]])], names=["width", "pos", "n", "s"])


def _moments(dims: int, centre: np.ndarray):
    """Upper triangle of sum(y y') of a task."""
    upper = np.triu_indices(dims)

    def run(batches):
        total, seen = np.zeros((dims, dims), dtype=object), False
        for batch in batches:
            for _, x in _whole_vectors(batch.column("v"), dims):
                total += _gram(x - centre)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int64()), pa.array(upper[1], pa.int64()),
                                              _decimals(total[upper])], names=["i", "j", "s"])
    return run


@dataclass(frozen=True)
class Whitening:
    """What a worker needs to whiten rows; its size is that of the fitted components."""
    dims: int
    n: int
    centre: np.ndarray       # round(S / n)
    rest: np.ndarray         # n * centre - S, at most n / 2
    directions: np.ndarray   # dims x components: eigenvectors
    values: np.ndarray       # their eigenvalues, zero where there is no variance
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 while that is wide enough, else Python integers."""
        y = x - self.centre
        if self.n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
            return y * self.n + self.rest.astype(np.int64)
        return y.astype(object) * self.n + self.rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows x components; nan without variance."""
        centred = self.centred(x)
        exact = (centred / self.n).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (exact @ self.directions) / np.sqrt(self.values), np.nan)


def _squares(centred: np.ndarray) -> list[int]:
    top = int(np.abs(centred).max(initial=0))
    if top * top * max(centred.shape[1], 1) < 1 << 62:
        return (centred * centred).sum(axis=1).tolist()
    wide = centred.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def _whitened_moments(model: Whitening):
    k = len(model.values)

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, x in _whole_vectors(batch.column("v"), model.dims):
                w = np.nan_to_num(model.whiten(x))
                w = np.c_[w, np.ones(len(w))]
                total += w.T @ w
        at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel(), pa.int64()), pa.array(at[1].ravel(), pa.int64()),
                                          pa.array(total.ravel(), pa.float64())], names=["i", "j", "s"])
    return run


def _result(model: Whitening, error: float | None):
    k = len(model.values)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                for rows, x in _whole_vectors(batch.column("v"), model.dims):
                    deviation = _decimals(_squares(model.centred(x)))
                    w = model.whiten(x).ravel()
                    take = pa.array(np.repeat(np.arange(len(rows)), k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(np.repeat(rows, k))),
                         pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                         pa.array(np.full(len(w), model.n), pa.int64()), deviation.take(take),
                         pa.array(w, mask=np.isnan(w)), pa.array(np.tile(model.explained, len(rows)), from_pandas=True),
                         pa.array([error] * len(w), pa.float64())],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


# ---------------------------------------------------------------------- eigenvectors
def _extended(value: int, over: int) -> np.longdouble:
    """value / over in extended precision, from exact integers."""
    quotient, rest = divmod(value, over)
    high = float(quotient)
    low = float(quotient - int(high))
    return np.longdouble(high) + np.longdouble(low) + np.longdouble(rest / over)


def _norm(m: np.ndarray) -> np.longdouble:
    return np.sqrt((m * m).sum())


def _clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Index sets of two or more eigenvalues each within ``gap`` of the next."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def refine(matrix: np.ndarray, vectors: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a symmetric long double matrix from approximate eigenvectors.

    Each round is one step of Ogita and Aishima; once the corrections no longer shrink, the
    clusters that are left are split by sub-solves, and the steps go on until both are done.
    """
    a = np.asarray(matrix, dtype=np.longdouble)
    x = np.asarray(vectors, dtype=np.longdouble)
    eye = np.eye(len(a), dtype=np.longdouble)
    size = _norm(a)
    if not len(a) or size == 0:
        return np.zeros(len(a), np.longdouble), x
    tiny = np.finfo(np.longdouble).eps * len(a)
    last, solved = np.longdouble(np.inf), 0
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # so that corrections of close pairs are rotations
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        bound = 2 * (_norm(off) + size * _norm(r))
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ e
        step = _norm(e)
        if step > 0.5 * last or step <= tiny:
            # steps have settled: what is still closer than the bound is solved for itself
            open_ = [c for c in _clusters(values, max(bound, tiny * size))]
            if not open_ or solved >= 4:
                break
            solved += 1
            for c in open_:
                own = x[:, c]
                mean = values[c].mean()
                t = own.T @ (a @ own - mean * own)
                t = (t + t.T) / 2
                spread = np.abs(t).max()
                if spread > 0:
                    _, turn = np.linalg.eigh((t / spread).astype(float))
                    x[:, c] = own @ turn.astype(np.longdouble)
            step = np.longdouble(np.inf)
        last = step
    x = x + x @ (eye - x.T @ x) / 2
    return np.diag(x.T @ (a @ x)).copy(), x


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (largest entry positive) of a long double matrix."""
    if not len(matrix):
        return np.zeros(0, np.longdouble), np.zeros((0, 0), np.longdouble)
    scale = np.abs(matrix).max()  # float32 ends at 3e38
    _, start = np.linalg.eigh((matrix / (scale if scale > 0 else 1)).astype(np.float32))
    values, vectors = refine(matrix, start)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values, vectors * np.where(lead < 0, -1, 1)


# -------------------------------------------------------------------------- operator
def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit over all usable vectors (column v); None without any."""
    sums = vectors.mapInArrow(_sums, "width long, pos long, n long, s decimal(38,0)").groupBy("width", "pos").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).persist()
    try:
        chosen = sums.where("pos = -1").orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
        if not chosen:
            return None
        dims, n = chosen[0]["width"], chosen[0]["n"]
        total = np.zeros(dims, dtype=object)
        for row in sums.where((F.col("width") == dims) & (F.col("pos") >= 0)).collect():
            total[row["pos"]] = int(row["s"])
    finally:
        sums.unpersist()
    centre = np.array([(2 * int(t) + n) // (2 * n) for t in total], dtype=object)
    rest = centre * n - total              # -sum(y)
    second = np.zeros((dims, dims), dtype=object)
    moments = vectors.mapInArrow(_moments(dims, centre.astype(np.int64)), "i long, j long, s decimal(38,0)")
    for row in moments.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # dims x dims numbers
        second[row["i"], row["j"]] = second[row["j"], row["i"]] = int(row["s"])
    v = np.array([[_extended(n * int(second[i, j]) - int(rest[i]) * int(rest[j]), n * n) for j in range(dims)]
                  for i in range(dims)], dtype=np.longdouble).reshape(dims, dims)
    values, directions = eigenvectors(v)
    trace = np.trace(v) if dims else np.longdouble(0)
    k = min(components, dims)
    # below the rounding of the matrix itself there is no variance
    values = np.where(values > trace * dims * np.finfo(np.longdouble).eps * 4, values, 0)[:k]
    explained = (values / trace if trace > 0 else np.full(k, np.nan)).astype(float)
    return Whitening(dims, n, centre.astype(np.int64), rest, directions[:, :k].astype(float), values.astype(float), explained)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    k = len(model.values)
    rows = vectors.mapInArrow(_whitened_moments(model), "i long, j long, s double").groupBy("i", "j").agg(
        F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1, k + 1))
    for row in rows:
        total[row["i"], row["j"]] = row["s"]
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return None
    mean = total[k, :k] / model.n
    found = total[:k, :k] / model.n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(k))[np.ix_(live, live)].max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error of every row and component."""
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    vectors = embeddings.select(F.col(vector).alias("v"))
    model = fit(vectors, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.mapInArrow(_result(model, error), schema)
