"""Whitening of embeddings by block Lanczos, without a covariance matrix.

Entries become whole numbers of 1/256, so that the distinct vectors (the fit list), their sums and all
deviations are exact. The covariance V is only ever applied: each pass over the fit list centres its rows
and adds up (x - mean) ((x - mean)' Q) for a block Q of a few vectors; tasks send one d x b matrix a
partition, Spark adds them up by entry. Blocks are orthogonalised in full, twice, against all before them. A
block that loses rank has met an invariant subspace: the lost directions restart at random ones,
orthogonal to all found, until the space is exhausted. Rayleigh-Ritz values of the
basis have converged when their residuals |V q - e q|, taken from one more pass over the data, are small;
otherwise the basis grows, or restarts from its best vectors once it holds ``most_basis``.
The trace of V comes from the exact deviations, so explained shares need no other eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Stash, pick

_EPS = np.finfo(np.float64).eps


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    """Binary vectors of d longs as the rows of a matrix."""
    return np.frombuffer(b"".join(x.to_pylist()), "<i8").reshape(-1, d)


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("v").is_valid())
            v = b.column("v")
            if not len(v):
                continue
            ends = v.offsets.to_numpy().astype(np.int64) - v.offsets[0].as_py()
            c = v.flatten().to_numpy(zero_copy_only=False)  # null entries come as NaN
            wrong = np.append(0, np.cumsum(~np.isfinite(c)))
            good = np.flatnonzero(wrong[ends[1:]] == wrong[ends[:-1]])
            # beyond the range of a long, an entry is the nearest one
            whole = np.clip(np.floor(scale * np.nan_to_num(c)), -(2.0**63), np.nextafter(2.0**63, 0)).astype("<i8")
            x = pa.Array.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(8 * ends), pa.py_buffer(whole)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").take(good), x.take(good), pa.array(np.diff(ends)[good].astype(np.int32))], names=["id", "x", "d"])

    return run


def _sums(d: int):
    """A partition's exact sums by dimension, as high and low halves of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for b in batches:
            x = _matrix(b.column("x"), d)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], names=["k", "high", "low"])

    return run


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum, by place, of the partitions' arrays; collected is one array."""
    rows = parts.groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    return out


def _partial(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(v.size, dtype=np.int32)), pa.array(v.ravel())], names=["k", "v"])


class _Covariance:
    """V of the fit list, by passes over it."""

    def __init__(self, fit: DataFrame, n: int, mean: np.ndarray):
        self.fit, self.n, self.mean, self.passes = fit, n, mean, 0

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        mean, d = self.mean, len(self.mean)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros(q.shape)
            for b in batches:
                x = _matrix(b.column("x"), d) - mean
                y += x.T @ (x @ q)
            yield _partial(y)

        self.passes += 1
        return _added(self.fit.mapInArrow(run, "k int, v double"), q.size).reshape(q.shape) / self.n

    def of_projections(self, w: np.ndarray) -> np.ndarray:
        """The covariance of (x - mean) @ w, centred by its own mean."""
        mean, (d, k) = self.mean, w.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, square = np.zeros(k), np.zeros((k, k))
            for b in batches:
                z = (_matrix(b.column("x"), d) - mean) @ w
                total += z.sum(axis=0)
                square += z.T @ z
            yield _partial(np.append(total, square))

        v = _added(self.fit.mapInArrow(run, "k int, v double"), k + k * k) / self.n
        return v[k:].reshape(k, k) - np.outer(v[:k], v[:k])


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(orthonormal columns orthogonal to basis, how many were restarted): directions that the block has lost
    are replaced by random ones while the space has any left."""
    d, room = len(block), len(block) - basis.shape[1]
    found = np.empty((d, 0))
    restarted = 0
    columns = [block[:, i] for i in range(block.shape[1])]
    while columns and found.shape[1] < room:
        v = columns.pop(0)
        size = np.linalg.norm(v)
        for _ in range(3):  # full reorthogonalisation, more than once
            v = v - basis @ (basis.T @ v)
            v = v - found @ (found.T @ v)
        left = np.linalg.norm(v)
        if left <= max(size * 1e-10, scale * d * _EPS * 16):  # breakdown
            restarted += 1
            columns.insert(0, rng.standard_normal(d) * max(scale, 1.0))
            continue
        v /= left
        v -= basis @ (basis.T @ v)
        v -= found @ (found.T @ v)
        found = np.column_stack([found, v / np.linalg.norm(v)])
    return found, restarted


def lanczos(apply, d: int, k: int, block: int, tolerance: float = 1e-13, most_basis: int = 256, rounds: int = 1000, seed: int = 11) -> tuple[np.ndarray, np.ndarray, dict]:
    """(eigenvalues, unit eigenvectors, figures) of the k greatest eigenvalues of a symmetric d x d operator.

    apply(Q) gives V Q. Residuals are of the vectors returned, from a pass of their own.
    """
    k = min(k, d)
    block = min(max(block, k), d)
    most_basis = max(most_basis, 3 * block)
    rng = np.random.default_rng(seed)
    basis, image, restarts, thick = np.empty((d, 0)), np.empty((d, 0)), 0, 0
    q, scale = rng.standard_normal((d, block)), 0.0
    for _ in range(rounds):
        q, lost = _orthogonal(q, basis, scale, rng)
        restarts += lost
        y = apply(q)
        basis, image = np.column_stack([basis, q]), np.column_stack([image, y])
        h = basis.T @ image
        value, vector = np.linalg.eigh((h + h.T) / 2)
        value, vector = value[::-1], vector[:, ::-1]
        scale = max(scale, float(np.abs(value).max()))
        best = basis @ vector[:, :k]
        residual = np.linalg.norm(image @ vector[:, :k] - best * value[:k], axis=0)
        full = basis.shape[1] == d
        if basis.shape[1] >= k and (full or residual.max() <= tolerance * scale):
            # the vectors once more, and their residuals by the data themselves
            best, _ = np.linalg.qr(best)
            y = apply(best)
            h = best.T @ y
            value, turn = np.linalg.eigh((h + h.T) / 2)
            value, best, y = value[::-1], best @ turn[:, ::-1], y @ turn[:, ::-1]
            residual = np.linalg.norm(y - best * value, axis=0)
            if full or residual.max() <= 10 * tolerance * scale:
                return value, best, {"residual": float(residual.max()), "restarts": restarts, "thick_restarts": thick, "basis": basis.shape[1]}
        if not full and basis.shape[1] + block > most_basis and basis.shape[1] > 2 * block:
            keep = max(2 * k, block)  # a new basis of the best vectors
            rest = y - basis @ (basis.T @ y)
            basis, image, thick = basis @ vector[:, :keep], image @ vector[:, :keep], thick + 1
            q = rest
        else:
            q = y - basis @ (basis.T @ y)
    raise RuntimeError(f"no convergence: residual {residual.max():.3g} of {scale:.3g}")


def _rows(n: int, total: np.ndarray, mean: np.ndarray, w: np.ndarray, usable: np.ndarray, explained: list, error: float | None):
    d, k = w.shape
    bound = 2**63 - 1
    whole = np.array([int(s) for s in total], object)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def deviations(x: np.ndarray) -> list[int | None]:
        most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(abs(s) for s in whole)
        if most * most * d <= bound:
            far = n * x - total.astype(np.int64)
            return (far * far).sum(axis=1).tolist()
        far = n * x.astype(object) - whole
        return [v if v <= bound else None for v in (far * far).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), d)
            z = (x - mean) @ w
            rows = len(x)
            white = pa.array(z.ravel(), mask=np.tile(~usable, rows))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    white,
                    pa.array(np.tile(np.array(explained, np.float64), rows)),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                names=names,
            )

    return run, ", ".join(f"{c} {t}" for c, t in zip(names, ("long", "int", "long", "long", "double", "double", "double")))


def _squares(n: int, total: np.ndarray):
    """Sums of the deviations of a partition, exact, as text of a decimal number."""
    d = len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = 0
        for b in batches:
            if b.num_rows:
                far = n * _matrix(b.column("x"), d).astype(object) - total
                found += int((far * far).sum())
        # in parts below 10**18, as sums of many partitions must stay exact
        parts, i = [], 0
        while found or not i:
            found, part = divmod(found, 10**9)
            parts.append((i, part))
            i += 1
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.int64())], names=["k", "v"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, block: int = 8, tolerance: float = 1e-13) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    Vectors that are null or hold null or non-finite entries are dropped, as are those whose length is not
    the commonest (of equally common ones, the greatest). An entry c counts as floor(scale * c). The fit list holds
    each distinct vector once, so copies and repeated rows don't weigh; each row of the table is still returned.
    Components are unit eigenvectors of the fit list's covariance, numbered from 1 by falling eigenvalue e; a vector's
    whitened value is its centred projection over sqrt(e). Where e is zero within rounding, as for a single
    distinct vector, whitened is null and explained 0; with no usable component identity_error is null. deviation is
    null beyond the range of a long. Equal eigenvalues leave a choice of vectors, which is one and the same
    for all rows. Ids are cast to long and may be null or repeated; further columns are not read. An empty table,
    or vectors without entries, give an empty result.
    """
    spark = vectors.sparkSession
    stash = Stash(spark, "whitening")
    known = pick(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    known = known.mapInArrow(_quantised(scale), "id long, x binary, d int")
    out_type = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = known.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths["d"] == 0:
        return spark.createDataFrame([], out_type)
    d = lengths["d"]
    known = known.where(F.col("d") == d)
    fit = stash.put(known.select("x").distinct())
    sums = fit.mapInArrow(_sums(d), "k long, high long, low long").groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("k").collect()
    n = sums[d]["low"]
    total = np.array([(r["high"] << 32) + r["low"] for r in sums[:d]], object)
    mean = np.array([float(Fraction(int(s), n)) for s in total])
    squares = sum(r["v"] * 10 ** (9 * r["k"]) for r in fit.mapInArrow(_squares(n, total), "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect())
    trace = Fraction(squares, n**3)
    covariance = _Covariance(fit, n, mean)
    value, vector, _ = lanczos(covariance.__matmul__, d, components, block, tolerance)
    usable = value > max(float(trace), 0.0) * d * _EPS
    w = np.where(usable, vector / np.sqrt(np.where(usable, value, 1.0)), 0.0)
    explained = [float(e) / float(trace) if u else 0.0 for e, u in zip(value, usable)]
    error = None
    if usable.any():
        error = float(np.abs(covariance.of_projections(w[:, usable]) - np.eye(int(usable.sum()))).max())
    run, kind = _rows(n, total, mean, w, usable, explained, error)
    return known.select("id", "x").mapInArrow(run, kind)
