"""Whitening of embeddings by shifted CholeskyQR.

The factorisation ``Y = Q R`` of the centred rows is found without ever holding ``Y``: a pass over
the rows sums their Gram matrix, whose (shifted) Cholesky factor joins the composed ``R``; the next
pass solves each row against it, which leaves rows closer to orthonormal, and sums again. After
three passes ``Q`` is orthonormal to rounding, and the singular values and right vectors of ``R``
are the standard deviations and directions of the rows.

Entries are taken as whole numbers, so sums, means and deviations are exact; rows are centred
before anything is multiplied. What reaches the driver is one ``d x d`` matrix and a sum per
dimension, whatever the number of rows; all rows stay in their partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import arrow, prepared, stored

# fixed values of the contract: an entry c becomes floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
PASSES = 3
# variances below this part of the largest one are rounding
RANK = 1e-12
LARGEST = (1 << 63) - 1
# entries from here on are no whole numbers of 53 bits once scaled, and count as not finite
FINITE = float(1 << 47)


def integers(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows whose vector is there and holds neither nulls nor entries beyond ``FINITE``, as whole numbers."""
    c = F.col("v").cast("array<double>")
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(c, lambda e: F.coalesce(F.abs(e) < FINITE, F.lit(False)))
    x = F.transform(c, lambda e: F.floor(e * SCALE).cast("bigint") + OFFSET)
    return embeddings.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).filter(fine).select("vec_id", x.alias("x"))


def uniform(rows: DataFrame) -> DataFrame:
    """The rows with the most frequent number of dimensions, of equally frequent ones the greatest; others fit no covariance with them."""
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).select("d")
    return rows.join(F.broadcast(most), F.size("x") == F.col("d"), "left_semi")


def matrix(part: pa.RecordBatch) -> np.ndarray:
    x = part.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""
    def work(parts: Iterator[pa.RecordBatch]):
        n, total = 0, None
        for part in parts:
            if part.num_rows:
                # batches are short, so their sums fit; what is added up over a partition may not
                s = matrix(part).sum(axis=0).astype(object)
                n, total = n + part.num_rows, s if total is None else total + s
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(-1, len(total))), "s": [str(n), *map(str, total)]}, schema=out)
    out = arrow("i int, s string")
    found = (rows.select("x").mapInArrow(work, "i int, s string")
             .groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect())
    return (int(found[0].s), [int(r.s) for r in found[1:]]) if found else (0, [])


def centred(n: int, s: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of whole numbers less their mean: the whole part of the mean is taken off before anything is rounded."""
    whole = np.array([t // n for t in s], np.int64)
    rest = np.array([t % n for t in s], float) / n
    return lambda x: (x - whole) - rest


def gram(rows: DataFrame, rotate: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum of the outer products of the rotated rows, one matrix per partition, then row by row of the matrix."""
    schema = "i int, j int, v double"
    out = arrow(schema)

    def work(parts: Iterator[pa.RecordBatch]):
        total = None
        for part in parts:
            if part.num_rows:
                y = rotate(matrix(part))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], schema=out)
    found = rows.select("x").mapInArrow(work, schema).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (c.to_numpy() for c in found.columns)
    g = np.zeros((d, d))
    g[i, j] = g[j, i] = v
    return g


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix; shifted where asked, or where rounding or a lacking rank needs it."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.norm(g, 2), np.finfo(float).tiny)
    shift = min(shift, np.trace(g) / d) if np.trace(g) else 1.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d) if shifted else g).T
        except np.linalg.LinAlgError:
            shift, shifted = shift * 10 if shifted else shift, True


def solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """The rows solved against each triangular factor in turn."""
    for r in factors:
        y = np.linalg.solve(r.T, y.T).T
    return y


def components(rows: DataFrame, n: int, s: list[int], most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions as columns, their variances, the total variance), by falling variance, without directions of no variance."""
    d = len(s)
    centre = centred(n, s)
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        done = list(factors)
        factors.append(factor(gram(rows, lambda x: solved(centre(x), done), d), n, shifted=k == 0))
    r = np.eye(d)
    for f in factors:
        r = f @ r
    if not np.isfinite(r).all():
        raise ArithmeticError("the factors of the rows are not finite")
    # what the last factor still holds of a lacking rank shows in the Gram matrix of the rows it leaves
    weights, axes = np.linalg.eigh(gram(rows, lambda x: solved(centre(x), factors), d))
    _, sigma, v = np.linalg.svd((np.sqrt(np.clip(weights, 0, None))[:, None] * axes.T) @ r)
    e = sigma ** 2 / n
    keep = min(most, int((e > RANK * e[0]).sum())) if e[0] > 0 else 0
    directions = v[:keep].T
    at = np.abs(directions).argmax(axis=0)
    return directions * np.where(directions[at, range(keep)] < 0, -1.0, 1.0), e[:keep], float(e.sum())


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """The exact sum of ``(n x - S)^2`` over the dimensions of each row; null where it is no 64-bit number."""
    whole = np.array([t // n for t in s], np.int64)
    rest = np.array([t % n for t in s], object)
    near = x - whole
    if float(n) * (float(np.abs(near).max(initial=0)) + 1) < 2 ** 31 / max(1, len(s)) ** 0.5:
        return ((n * near - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = [int(v) for v in ((n * near.astype(object) - rest) ** 2).sum(axis=1)]
    return [v if v <= LARGEST else None for v in exact]


SCHEMA = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whitened(embeddings: DataFrame) -> DataFrame:
    """One row per remaining vector and component, up to 32 components.

    Vectors that are null or empty or hold a null or non-finite entry are left out (an entry of 2^47
    or more counts as such), and so are vectors of another length than most have. A component of no variance cannot be whitened and has
    no rows: with equal vectors, or a single one, the result is empty, as for an empty table. There
    are fewer components than dimensions where the rows do not span them. Repeated rows count as
    often as they stand there; a null vec_id is kept; equal variances leave the choice of
    directions among them open; further columns play no part. ``deviation`` is null where the exact
    number needs more than 64 bits.
    """
    prepared(embeddings.sparkSession)
    rows = stored(uniform(integers(embeddings)), "whitening")
    n, s = sums(rows)
    directions, e, total = components(rows, n, s) if n else (np.zeros((0, 0)), np.zeros(0), 0.0)
    k = len(e)
    if not k:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    centre, scaled = centred(n, s), directions / np.sqrt(e)
    error = float(np.abs(gram(rows, lambda x: centre(x) @ scaled, k) / n - np.eye(k)).max())
    explained = e / total
    out = arrow(SCHEMA)

    def work(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            m = part.num_rows
            if not m:
                continue
            x = matrix(part)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n)), pa.array(deviations(x, n, s), pa.int64()).take(pa.array(at)),
                 pa.array((centre(x) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], schema=out)

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "x").mapInArrow(work, SCHEMA)
