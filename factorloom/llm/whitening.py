"""Whitening of embeddings by Jacobi-Davidson.

The covariance is never built. Vectors are packed into blocks of rows as whole numbers, written once, and a product of the
covariance with a few columns is one distributed job: each block is centred, multiplied and multiplied back, tasks add up
their blocks, and Spark adds up the tasks by place. Only those d by k sums reach the driver, where d is the dimension.
The search space is kept there, d by `room` numbers: Rayleigh-Ritz gives candidates, a few steps of MINRES solve each one's
projected correction equation (all of them share one job a step), and a candidate is locked when its residual, from a
fresh product, is at double precision (TOLERANCE times the largest eigenvalue).

Defined cases: a vector is dropped if it is null or empty, holds a null or non-finite entry or one beyond 2 ** 40, or has
another length than most vectors have (the longer of equally common ones). Components without variance (equal vectors, or
fewer directions than asked for) are left out, so a table of equal vectors gives no rows, as does an empty one. Rows that
repeat, and rows without an id, each get rows of their own. Equal eigenvalues get any orthonormal vectors of their space.
Columns of the input stay, but for the vector and those of OUTPUT. A deviation that doesn't fit a long raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, table, written

OUTPUT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
#: Fixed values of the whole numbers that vectors become.
STEPS, OFFSET = 1024.0, 100_000
#: Largest residual of a locked vector, in parts of the largest eigenvalue.
TOLERANCE = 2.0**-44
#: Bytes of a block of rows, about.
BLOCK = 1 << 20

Product = Callable[[np.ndarray], np.ndarray]


def usable(vector: str):
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**40)
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, entry), F.lit(False)) & (F.size(vector) > 0)


def dimension(vectors: DataFrame, vector: str) -> int | None:
    """The length that most usable vectors have."""
    found = vectors.where(usable(vector)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found and found["d"]


def packed(vectors: DataFrame, vector: str, d: int) -> DataFrame:
    """(rows, x, n): blocks of n usable vectors as whole numbers, 4 bytes each where they fit, and the other columns of their rows."""
    whole = F.transform(vector, lambda c: F.floor(F.lit(STEPS) * c.cast("double")) + F.lit(OFFSET).cast("long"))
    rows = vectors.where(usable(vector) & (F.size(vector) == d)).select(F.struct(*[F.col(c) for c in others(vectors, vector, *OUTPUT)]).alias("row"), whole.alias("x"))
    most = max(1, BLOCK // (4 * d))

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = part.column(1).flatten().to_numpy()
                x = x.astype(np.int32) if np.abs(x).max() < 2**31 else x
                rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([rows, pa.array([x.tobytes()], pa.binary()), pa.array([part.num_rows], pa.int32())], ["rows", "x", "n"])

    schema = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), T.StructField("x", T.BinaryType()), T.StructField("n", T.IntegerType())])
    return rows.mapInArrow(blocks, schema)


def unpacked(raw: bytes, n: int, d: int) -> np.ndarray:
    """The n rows of a block as longs."""
    return np.frombuffer(raw, np.int64 if len(raw) == 8 * n * d else np.int32).reshape(n, d).astype(np.int64)


def summed(blocks: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all blocks of part(rows), an array of one size: first within each task, then by place."""

    def added(batches):
        total = None
        for batch in batches:
            for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = part(unpacked(raw, n, d)).ravel()
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total]})

    places = blocks.select("x", "n").mapInArrow(added, f"v array<{kind}>").select(F.posexplode("v").alias("place", "v"))
    found = places.groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out = np.empty(found.num_rows, found["v"].to_numpy().dtype)
    out[found["place"].to_numpy()] = found["v"].to_numpy()
    return out


class Centre:
    """Rows less their mean: whole parts are taken off exactly, then what is left of the mean."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def off(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """x less its parts along the orthonormal columns of basis, taken off twice for rounding."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def minres(product: Product, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of product(x) = right, each column in its own Krylov space, all columns in one product a step."""
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    beta = np.linalg.norm(right, axis=0)
    v, v_old = over(right, np.broadcast_to(beta, right.shape)), np.zeros_like(right)
    x, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    cos, cos_old, sin, sin_old, left = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    carried = np.zeros_like(beta)
    for _ in range(steps):
        y = product(v)
        alpha = (v * y).sum(0)
        y = y - alpha * v - carried * v_old
        following = np.linalg.norm(y, axis=0)
        # The column (carried, alpha, following) of the tridiagonal matrix, turned by the last two rotations and a new one.
        upper, middle = sin_old * carried, cos * cos_old * carried + sin * alpha
        diagonal = cos * alpha - sin * cos_old * carried
        length = np.hypot(diagonal, following)
        cos_old, sin_old, cos, sin = cos, sin, over(np.abs(diagonal), length) * np.sign(diagonal), over(following, length)
        w, w_old = over(v - middle * w - upper * w_old, np.broadcast_to(length, v.shape)), w
        x = x + cos * left * w
        left = -sin * left
        v, v_old, carried = over(y, np.broadcast_to(following, y.shape)), v, following
    return x


def jacobi_davidson(product: Product, d: int, k: int, *, inner: int = 2, room: int | None = None, seed: int = 11, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix without negative ones, falling, and their unit vectors as columns."""
    room = min(d, room or 8 * k)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + 4))))[0]
    image = product(basis)
    locked, values = np.empty((d, 0)), []
    for _ in range(rounds):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, basis, image = theta[::-1], basis @ turn[:, ::-1], image @ turn[:, ::-1]
        wanted = k - len(values)
        limit = TOLERANCE * max([*values, theta[0], 0.0])
        residual = off(image[:, :wanted] - basis[:, :wanted] * theta[:wanted], locked)
        good = int(np.cumprod(np.linalg.norm(residual, axis=0) <= limit).sum())
        if good:
            fresh = product(basis[:, :good])
            value = (basis[:, :good] * fresh).sum(0)
            good = int(np.cumprod(np.linalg.norm(off(fresh - basis[:, :good] * value, locked), axis=0) <= limit).sum())
            locked, values = np.hstack([locked, basis[:, :good]]), [*values, *value[:good]]
            image[:, : len(value)] = fresh
            basis, image, theta, residual = basis[:, good:], image[:, good:], theta[good:], residual[:, good:]
            if len(values) == k:
                order = np.argsort(values)[::-1]
                return np.array(values)[order], locked[:, order]
        near = basis[:, : residual.shape[1]]
        shift = theta[: residual.shape[1]]

        def projected(t: np.ndarray, near=near, shift=shift) -> np.ndarray:
            t = off(t - near * (near * t).sum(0), locked)
            y = product(t) - shift * t
            y = off(y, locked)
            return y - near * (near * y).sum(0)

        more = minres(projected, -residual, inner)
        if basis.shape[1] + locked.shape[1] + more.shape[1] > room and basis.shape[1] > 2 * wanted:
            basis, image = basis[:, : 2 * wanted], image[:, : 2 * wanted]
        more = off(off(more / np.maximum(np.linalg.norm(more, axis=0), 1e-300), locked), basis)
        q, size, _ = np.linalg.svd(more, full_matrices=False)
        more = q[:, size > 1e-10][:, : d - basis.shape[1] - locked.shape[1]]
        more = np.linalg.qr(off(off(more, locked), basis))[0]
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)]) if more.shape[1] else image
    raise RuntimeError(f"{len(values)} of {k} eigenvectors reached double precision in {rounds} rounds")


def whiten(vectors: DataFrame, vector: str = "embedding", *, k: int = 8, inner: int = 2, room: int | None = None) -> DataFrame:
    """For each usable vector and component: the columns of the input and OUTPUT."""
    spark, d = vectors.sparkSession, dimension(vectors, vector)
    kept = [vectors.schema[c] for c in others(vectors, vector, *OUTPUT)]
    kinds = ["component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double"]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(kinds)).fields])
    if d is None:
        return spark.createDataFrame([], schema)
    blocks = written(packed(vectors, vector, d), f"vectors-{uuid.uuid4().hex}")
    n, *sums = map(int, summed(blocks, d, lambda x: np.concatenate([[len(x)], x.sum(0)]), "long"))
    centre = Centre(n, sums)

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centre(x)
            return y.T @ (y @ columns)

        return summed(blocks, d, part, "double").reshape(columns.shape) / n

    trace = float(summed(blocks, d, lambda x: (centre(x) ** 2).sum(0), "double").sum()) / n
    values, axes = jacobi_davidson(product, d, min(k, d), inner=inner, room=room)
    proper = values > max(1e-12 * trace, 0.0)
    values, axes = values[proper], axes[:, proper]
    if not len(values):
        return spark.createDataFrame([], schema)
    scaled, k = axes / np.sqrt(values), len(values)

    def square(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ scaled
        return w.T @ w

    error = float(np.abs(summed(blocks, d, square, "double").reshape(k, k) / n - np.eye(k)).max())
    total = np.array(sums, np.int64)

    def spread(batches):
        for batch in batches:
            for rows, raw, m in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, at = unpacked(raw, m, d), pa.array(np.repeat(np.arange(m), k))
                far = n * (x - centre.whole) - (total - n * centre.whole)
                if (far.astype(float) ** 2).sum(1).max() > 2.0**62:
                    raise OverflowError("a deviation doesn't fit a long")
                columns = [rows.values.field(i).take(at) for i in range(len(kept))]
                own = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), np.repeat((far**2).sum(1), k), (centre(x) @ scaled).ravel(), np.tile(values / trace, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, own)], schema.names)

    return blocks.mapInArrow(spread, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
