"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kondate.llm.common import Scratch

SCALE, SHIFT = 1024, 100_000
#: Parts of the largest eigenvalue below which an eigenvalue is rounding, so that its vector would be noise.
LEAST_EIGENVALUE = 1e-12
#: Parts of the largest singular value that a wanted triplet may be off before the space is large enough.
RESIDUAL = 1e-14
#: Steps from a new start that have to confirm what was found before all dimensions are used.
CONFIRM = 16


@dataclass
class Whitening:
    """n rows with the sums of their entries; unit components in rows with their deviations and the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    total: float


def integer_rows(embeddings: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id and x (longs) of the rows that take part, a written table.

    Rows without a vector, with null or non-finite entries, or with one that no long can hold are left out, and those
    whose length isn't the commonest (of several, the largest).
    """
    entry = lambda x: x.cast("double") * SCALE
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(entry(x)) & (F.abs(entry(x)) < float(1 << 62)), F.lit(False)))
    rows = embeddings.where(F.col("embedding").isNotNull() & fine)
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("size"))
    common = sizes.first()
    x = F.transform("embedding", lambda c: F.floor(entry(c)) + SHIFT)
    return scratch.table(rows.where(F.size("embedding") == (common["size"] if common else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), "rows")


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as longs where those hold it, else as Python's integers."""
    fits = len(x) == 0 or n * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 61
    return x * np.int64(n) - sums.astype("i8") if fits else x.astype(object) * n - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _scaled(x, n, sums).astype("f8") / n


def _summed(rows: DataFrame, of: str) -> list:
    """The sums of (place, value) rows in order of place: few rows from each task meet, one for each place comes to the driver."""
    return [r["value"] for r in sorted(rows.groupBy("place").agg(F.sum("value").cast(of).alias("value")).collect())]


def moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sums of their entries."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch, d)
            n += len(x)
            total += x.sum(0) if abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(0)
        values = [str(n), *map(str, total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(values)], ["place", "value"])

    found = _summed(rows.select("x").mapInArrow(part, "place int, value string").select("place", F.col("value").cast("decimal(38,0)").alias("value")), "string")
    found = [int(x) for x in found] or [0] * (d + 1)
    return found[0], np.array(found[1:], object)


def product(rows: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> tuple[float, float, np.ndarray]:
    """For u = Xq of the centred rows X: the square of its length, that of X, and the vector of X'u.

    Both products are made batch by batch, so u stays in the tasks; d + 2 numbers of each are added up.
    """
    d = len(q)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(d + 2)
        for batch in batches:
            x = _centred(_matrix(batch, d), n, sums)
            u = x @ q
            out += np.concatenate([[u @ u, np.einsum("ij,ij", x, x)], x.T @ u])
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 2), pa.int32()), pa.array(out)], ["place", "value"])

    found = np.array(_summed(rows.select("x").mapInArrow(part, "place int, value double"), "double") or [0.0] * (d + 2))
    return found[0], found[1], found[2:]


def _apart(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """w without what the basis has of it, twice, so that rounding leaves nothing."""
    for _ in range(2):
        for v in basis:
            w = w - (v @ w) * v
    return w


def components(rows: DataFrame, n: int, sums: np.ndarray, most: int = 8, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Up to `most` right singular vectors of the centred rows with their singular values, largest first, and the sum of squares of all entries.

    A step makes u = X v less what the earlier left vectors have of it, then X'u less what the earlier right vectors
    have of it, one pass over the rows. Left vectors are as long as the table, so they are never kept: u_j = X p_j for a
    short p_j, and the products u_i . X v, which full reorthogonalisation needs, are (X'u_i) . v. Where a direction runs
    out, a random one apart from all begins anew, and so it does when all wanted triplets have converged, to find
    repeated singular values: it ends if those don't change in the next steps, or with all dimensions. The small
    matrix U'XV, bidiagonal but where it begins anew, gives the vectors. Kept are as many vectors as steps, each as
    long as an embedding.
    """
    d = len(sums)
    random, rights, shorts, backs = np.random.default_rng(seed), [], [], []
    total, begun, before = 0.0, 0, None
    v = random.standard_normal(d)
    v /= np.linalg.norm(v)
    while True:
        rights.append(v)
        q = v.copy()
        for p, w in zip(shorts, backs, strict=True):
            q -= (w @ v) * p
        squares, total, back = product(rows, n, sums, q)
        if total == 0:
            return np.zeros((0, d)), np.zeros(0), 0.0
        alpha = np.sqrt(max(squares, 0.0))
        done = alpha <= 1e-9 * np.sqrt(total)  # nothing of X is left along v
        shorts.append(np.zeros(d) if done else q / alpha)
        backs.append(np.zeros(d) if done else back / alpha)
        right, left = np.array(rights), np.array(backs)
        a, sigma, b = np.linalg.svd(left @ right.T)
        k = len(rights)
        off = np.linalg.norm(a.T @ left - (sigma[:, None] * b) @ right, axis=1)[:most]
        wanted = min(most, d)
        found = k >= wanted and bool((off <= RESIDUAL * sigma[0]).all())
        if found and before is not None and k - begun >= CONFIRM and np.allclose(before, sigma[:wanted], rtol=1e-9):
            break
        if k == d:
            break
        w = _apart(back / alpha if not done else np.zeros(d), rights)
        if found and (before is None or k - begun >= CONFIRM):
            w, begun, before = np.zeros(d), k, sigma[:wanted]
        if np.linalg.norm(w) <= 1e-13 * np.sqrt(total):
            w = _apart(random.standard_normal(d), rights)
        v = w / np.linalg.norm(w)
    return (b @ right)[:most], sigma[:most], total


def fit(rows: DataFrame, most: int = 8) -> Whitening:
    """Components of the rows' covariance (divisor n) by falling variance; fewer than `most` where no more is varying."""
    first = rows.first()
    d = len(first["x"]) if first else 0
    n, sums = moments(rows, d) if d else (0, np.zeros(0, object))
    if not n:
        return Whitening(0, sums, np.zeros((0, d)), np.zeros(0), 0.0)
    vectors, sigma, total = components(rows, n, sums, most)
    varying = sigma**2 > LEAST_EIGENVALUE * (sigma[0] ** 2 if len(sigma) else 0)
    vectors, sigma = vectors[varying], sigma[varying]
    return Whitening(n, sums, vectors / np.linalg.norm(vectors, axis=1, keepdims=True), sigma / np.sqrt(n), total / n)


def _projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    return _centred(x, w.n, w.sums) @ (w.components / w.deviations[:, None]).T


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, at most, of all entries."""
    d, k = len(w.sums), len(w.deviations)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = _projected(_matrix(batch, d), w)
            mean, square = mean + y.sum(0), square + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([mean, square.ravel()]))], ["place", "value"])

    found = np.array(_summed(rows.select("x").mapInArrow(part, "place int, value double"), "double")) / w.n
    mean, square = found[:k], found[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, w: Whitening, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component.

    The deviation is exact; where no long holds it, it is null.
    """
    d, k = len(w.sums), len(w.deviations)
    explained = w.deviations**2 / w.total

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            apart = _scaled(x, w.n, w.sums)
            if apart.dtype != object and len(x) and max(abs(int(apart.min())), abs(int(apart.max()))) ** 2 * d >= 1 << 62:
                apart = apart.astype(object)
            squares = [int(s) for s in (apart * apart).sum(1)]
            m = len(x)
            columns = [
                pa.array(np.repeat(np.arange(m), k)).cast(pa.int64()),
                pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), m)),
                pa.array(np.full(m * k, w.n, "i8")),
                pa.array([s if s < 1 << 63 else None for s in squares for _ in range(k)], pa.int64()),
                pa.array(_projected(x, w).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            columns[0] = batch.column("vec_id").take(columns[0])
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten_embeddings(embeddings: DataFrame, most: int = 8) -> DataFrame:
    """The whitened vectors of all rows that take part, by components fitted on all of them.

    Rows that repeat count, and appear, as often as they stand there. One row, rows that are all alike, and an empty table
    give no rows, as nothing varies; fewer dimensions than `most`, or less that varies, give fewer components.
    """
    scratch = Scratch(embeddings.sparkSession, "whitening")
    rows = integer_rows(embeddings, scratch)
    w = fit(rows, most)
    if not len(w.deviations):
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(rows, w, identity_error(rows, w))
