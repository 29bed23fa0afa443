"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Components of each vector become whole numbers, floor(scale * c). With A the
rows less their mean, the process builds orthonormal v_1, v_2, ... (as long as
a vector) and u_1, u_2, ... (as long as the table) with A V = U B and B upper
bidiagonal. Each step is one pass over the rows, which are kept as blocks of
narrow whole numbers: the rows of a block give their part of u (the product
A v), and that part, times the rows, its share of A^T u. The u lie in the
range of A, so the driver holds u_j as A g_j with g_j as long as a vector:
nothing as long as the table is stored, collected or lost with an executor.
Both sides are orthogonalised anew against all earlier vectors, twice
(U^T p = G^T (A^T p)). The singular values and right vectors of the small B
are the deviations and the components.

The process ends when the wanted components have no residual left and the
variance that no v has reached is below the smallest wanted eigenvalue, so
that no larger one can be missing; at the latest after as many steps as a
vector has dimensions, when B is the whole of A. An exhausted subspace (equal
eigenvalues) goes on with a new direction.

To the driver come a few vectors of one row's length per pass, summed by
Spark; the number of rows does not matter.

Defined results: rows whose vector is null or holds null or non-finite
components take no part and are not returned; repeated rows count each time;
null ids stay null; shorter vectors are filled up with zeros to the longest;
an empty table gives an empty result. Components without variance are not
returned: fewer than asked for come where the vectors span less (none, if all
are equal). Of equal eigenvalues any orthonormal directions may come. Whole
numbers saturate at 2^58; a deviation of more than 38 digits is null. Other
columns are passed through in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.llm.common import materialize
from mkpulse.llm.vectors import floors, matrix, narrow, whole, wide
from mkpulse.session import release

K = 8
SCALE = 1024
#: Entries of a block, whatever the length of its vectors.
BLOCK_ENTRIES = 1 << 20
#: Shares of the largest singular value (residuals) and of the total variance (nothing left) that count as zero.
RESIDUAL, NOTHING = 1e-13, 1e-14


@dataclass
class Whitening:
    """Components (rows), their eigenvalues by falling size, and how they came about."""

    n: int
    sums: list[int]
    scale: int
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def blocks(vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """n, dim, width, x: blocks of floor(scale * c) in the narrowest whole numbers that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = floors(matrix(b.column(0)), scale)
            size = max(1, BLOCK_ENTRIES // max(1, y.shape[1]))
            for part in (y[k : k + size] for k in range(0, len(y), size)):
                width, x = narrow(part)
                yield pa.RecordBatch.from_pydict({"n": [len(part)], "dim": [part.shape[1]], "width": [width], "x": [x]})

    e = F.col(f"`{embedding}`").cast("array<double>")
    return vectors.where(whole(e)).select(e.alias("e")).mapInArrow(run, "n long, dim long, width long, x binary")


def rows_of(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    """The whole numbers of each block of a batch, filled up with zeros to ``dim``."""
    for r in batch.to_pylist():
        y = wide(r["x"], r["width"], r["n"], r["dim"])
        yield y if y.shape[1] == dim else np.pad(y, ((0, 0), (0, dim - y.shape[1])))


def summed(held: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], size: int, exactly: bool = False) -> list:
    """The sum over all blocks of ``part(rows)``, a vector of ``size`` entries: summed in each task, then by Spark."""
    kind = pa.decimal128(38, 0) if exactly else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for y in rows_of(b, dim):
                total = part(y) if total is None else total + part(y)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), kind)], ["i", "v"])

    got = held.mapInArrow(run, f"i long, v {'decimal(38,0)' if exactly else 'double'}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    by = dict(got)
    return [by[i] for i in range(size)] if by else []


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less their mean; the whole part of the mean is subtracted exactly."""
    whole_part, rest = zip(*(divmod(s, n) for s in sums), strict=True) if sums else ((), ())
    return (y - np.array(whole_part, np.int64)).astype(np.float64) - np.array(rest, np.float64) / n


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum over the components of (n * y - sum)^2, exactly, for each row."""
    whole_part, rest = zip(*(divmod(s, n) for s in sums), strict=True) if sums else ((), ())
    a = y - np.array(whole_part, np.int64)
    most = int(np.abs(a).max(initial=0)) + 1
    kind = np.int64 if max(1, a.shape[1]) * most * max(n, most) < 1 << 62 else object
    a, r = a.astype(kind), np.array(rest, dtype=kind)
    own = sum(x * x for x in rest)
    return [n * n * int(s) - 2 * n * int(t) + own for s, t in zip((a * a).sum(axis=1), (a * r).sum(axis=1), strict=True)]


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``k`` largest singular values of A and their right vectors (rows), the squared Frobenius norm, and the steps made.

    ``product(q)`` gives A^T (A q) and the squared norm of all of A, by one pass over the rows.
    """
    rng = np.random.default_rng(0)

    def away(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - v @ (v.T @ w)
        return w

    def fresh(v: np.ndarray) -> np.ndarray:
        w = away(rng.standard_normal(dim), v)
        return w / np.linalg.norm(w)

    v, g, z = (np.zeros((dim, 0)) for _ in range(3))
    alpha: list[float] = []
    beta: list[float] = []
    new = fresh(v)
    while True:
        q = new - (beta[-1] * g[:, -1] if beta else 0)
        a, norm = product(q)
        for _ in range(2):  # p = A q away from all earlier u
            h = g.T @ a
            q, a = q - g @ h, a - z @ h
        square = max(float(q @ a), 0.0)
        own = np.sqrt(square) if square > NOTHING * norm else 0.0
        v = np.column_stack([v, new])
        g, z = (np.column_stack([m, x / own if own else np.zeros(dim)]) for m, x in ((g, q), (z, a)))
        alpha.append(own)
        w = away(z[:, -1] - own * new, v)
        step = float(np.linalg.norm(w))
        left, s, right = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        done, unreached = len(alpha), norm - float((s**2).sum())
        sure = np.all(step * np.abs(left[-1, :k]) <= RESIDUAL * s[0]) and (unreached <= RESIDUAL * norm or done >= k and unreached < s[k - 1] ** 2)
        if sure or done == dim or s[0] == 0:
            return s[:k], right[:k] @ v.T, norm, done
        beta.append(step if step > RESIDUAL * s[0] else 0.0)
        new = w / step if beta[-1] else fresh(v)


def fit(vectors: DataFrame, k: int = K, scale: int = SCALE, embedding: str = "embedding") -> Whitening | None:
    """The ``k`` first components of all vectors; None without a vector."""
    held = materialize(blocks(vectors, embedding, scale), "whitening-blocks")
    n, dim = held.agg(F.sum("n"), F.max("dim")).first()
    if not n:
        release(held)
        return None

    def totals(y: np.ndarray) -> np.ndarray:
        return (y if int(np.abs(y).max(initial=0)) * len(y) < 1 << 62 else y.astype(object)).sum(axis=0).astype(object)

    sums = [int(s) for s in summed(held, dim, lambda y: np.array([Decimal(int(s)) for s in totals(y)], dtype=object), dim, exactly=True)]

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def part(y: np.ndarray) -> np.ndarray:
            a = centred(y, n, sums)
            u = a @ q
            return np.append(u @ a, np.einsum("ij,ij->", a, a))

        got = np.array(summed(held, dim, part, dim + 1))
        return got[:dim], float(got[dim])

    if dim:
        s, components, norm, steps = bidiagonalise(product, dim, min(k, dim))
    else:
        s, components, norm, steps = np.zeros(0), np.zeros((0, 0)), 0.0, 0
    there = s**2 > NOTHING * norm
    out = Whitening(n, sums, scale, components[there], s[there] ** 2 / n, norm / n, steps)
    out.identity_error = identity_error(held, out)
    release(held)
    return out


def identity_error(held: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, from the rows themselves."""
    k, n = len(model.components), model.n
    if not k:
        return 0.0

    def white(y: np.ndarray) -> np.ndarray:
        return project(y, model)

    dim = len(model.sums)
    mean = np.array(summed(held, dim, lambda y: white(y).sum(axis=0), k)) / n

    def scatter(y: np.ndarray) -> np.ndarray:
        c = white(y) - mean
        return (c.T @ c).ravel()

    return float(np.abs(np.array(summed(held, dim, scatter, k * k)).reshape(k, k) / n - np.eye(k)).max())


def project(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates of rows of whole numbers."""
    return centred(y, model.n, model.sums) @ model.components.T / np.sqrt(model.eigenvalues)


def transform(vectors: DataFrame, model: Whitening, embedding: str = "embedding") -> DataFrame:
    """row (the other columns), deviation (decimal), whitened (array of doubles) for every whole vector.

    Meant for the vectors the model was fitted on: others must not be longer.
    """
    dim = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = floors(matrix(b.column(1), dim), model.scale)
            dev = [Decimal(x) if x < 10**38 else None for x in deviations(y, model.n, model.sums)]
            white = project(y, model)
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dev, pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, white.ravel())],
                                             ["row", "deviation", "whitened"])

    e = F.col(f"`{embedding}`").cast("array<double>")
    others = [F.col(f"`{c}`") for c in vectors.columns if c != embedding] or [F.col(f"`{embedding}`")]
    rows = vectors.where(whole(e)).select(F.struct(*others).alias("row"), e.alias("e"))
    schema = T.StructType([rows.schema["row"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, k: int = K, scale: int = SCALE, embedding: str = "embedding") -> DataFrame:
    """row, component (from 1), n, deviation, whitened, explained, identity_error: one row per vector and component."""
    model = fit(vectors, k, scale, embedding)
    empty = model is None
    model = model or Whitening(1, [], scale, np.zeros((0, 0)), np.zeros(0), 1.0, 0)
    rows = transform(vectors.limit(0) if empty else vectors, model, embedding)
    share = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    each = rows.select("row", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("row", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
