"""k-means in whole numbers with heap-ordered bounds.

Components become floor(scale * c). A vector's gap is the distance of its
second nearest centroid less that of its own. When centroids move, the gap of
a vector of cluster a shrinks by at most the drift of a plus the largest drift
of any other; these are added up per cluster since the start. A vector enters
its cluster's heap under its gap plus the drift so far, so that nothing is
updated while it stays: after each move only the heap's head is looked at, and
vectors are popped while their number is not above the cluster's drift. Only
those are compared with all centroids, exactly, and pushed again. Numbers in
the heap are lowered by more than any rounding of theirs; a tie has no gap and
is always compared, so it goes to the smaller number.

The table is kept as blocks. A block holds its vectors in narrow whole
numbers, their clusters, and one heap per cluster as arrays in heap order. A
round is one pass that sums the vectors of each cluster (k times the length of
a vector reaches the driver, whatever the number of rows) and one pass that
writes the blocks with their new heaps to the shared folder; the blocks before
are deleted then. A lost executor repeats blocks, nothing else.

Defined results: vectors that are null, of another length, or hold a null or
non-finite component take no part; repeated rows take part each; rows of null
id come last as starts, those of one id in the order of their vectors; with
fewer vectors than ``k`` every one is a start; a cluster without vectors keeps
its centroid; an empty table gives an empty result. Whole numbers saturate at
2^58, sums of squares beyond 38 digits are null. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mkpulse.llm.common import materialize
from mkpulse.llm.vectors import exact, floors, matrix, narrow, whole, wide
from mkpulse.session import release

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
BLOCK = 8192
#: Heap numbers are lowered by this share of the distances, and drifts raised, to cover rounding.
SLACK = 1e-9
BLOCKS = "n long, width long, ids binary, known binary, x binary, cluster binary, heap_key binary, heap_row binary, rescanned long"


@dataclass
class Clustering:
    """Final centroids, the number of vectors compared with all centroids in each pass, and sums by cluster."""

    centroids: list[list[int]]
    rescanned: list[int] = field(default_factory=list)
    inertia: dict[int, int | None] = field(default_factory=dict)
    total: int | None = 0


def starts(vectors: DataFrame, k: int, scale: int, vec_id: str, embedding: str) -> list[list[int]]:
    """The ``k`` vectors of least sha256 of ``1:<id>``, in that order."""
    i, e = F.col(f"`{vec_id}`"), F.col(f"`{embedding}`").cast("array<double>")
    first = vectors.select(F.sha2(F.concat(F.lit("1:"), i.cast("string")), 256).alias("h"), e.alias("e"))
    rows = first.orderBy(F.asc_nulls_last("h"), "e").limit(k).collect()
    return [[int(x) for x in floors(np.array(r.e), scale)] for r in rows]


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    x, c = exact(x, centroids, dim=x.shape[1])
    if x.dtype != np.float64:
        return np.stack([((x - r) ** 2).sum(axis=1) for r in c], axis=1)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def compare(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (of equal ones the smaller number), and the heap number it gets there."""
    d = squared(x, centroids)
    own = np.argmin(d, axis=1)
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    at = np.arange(len(x))
    near = np.sqrt(d[at, own].astype(np.float64))
    d[at, own] = d.max(axis=1)  # the largest stands for the own one: the least of the rest is unchanged
    other = np.sqrt(d.min(axis=1).astype(np.float64))
    return own, (other - near) * (1 - SLACK) - SLACK * (1 + other) + drift[own]


def advance(x: np.ndarray, cluster: np.ndarray, keys: np.ndarray, rows: np.ndarray, centroids: np.ndarray, drift: np.ndarray):
    """One block after its centroids moved: clusters, heaps, and how many rows were compared with all centroids.

    ``keys`` and ``rows`` hold the heaps of clusters 0, 1, ... one after the
    other; ``drift`` is what each cluster's gaps have lost since the start.
    Rows whose cluster is -1 are new.
    """
    k = len(centroids)
    cluster = cluster.copy()
    ends = np.cumsum(np.bincount(cluster[cluster >= 0], minlength=k))
    heaps = [list(zip(keys[b:e].tolist(), rows[b:e].tolist(), strict=True)) for b, e in zip([0, *ends[:-1]], ends, strict=True)]
    expired = np.flatnonzero(cluster < 0).tolist()
    for a, heap in enumerate(heaps):
        while heap and heap[0][0] <= drift[a]:
            expired.append(heapq.heappop(heap)[1])
    if expired:
        out = np.array(expired)
        cluster[out], new = compare(x[out], centroids, drift)
        for r, key in zip(expired, new.tolist(), strict=True):
            heapq.heappush(heaps[cluster[r]], (key, r))
    flat = [p for heap in heaps for p in heap]
    return cluster, np.array([p[0] for p in flat]), np.array([p[1] for p in flat], dtype=np.int32), len(expired)


def _written(n: int, width: int, ids: bytes, known: bytes, x: bytes, state) -> pa.RecordBatch:
    cluster, keys, rows, seen = state
    return pa.RecordBatch.from_pydict({
        "n": [n], "width": [width], "ids": [ids], "known": [known], "x": [x], "cluster": [cluster.astype("<i4").tobytes()],
        "heap_key": [keys.astype("<f8").tobytes()], "heap_row": [rows.astype("<i4").tobytes()], "rescanned": [seen]})


def blocks(vectors: DataFrame, centroids: np.ndarray, scale: int, vec_id: str, embedding: str, size: int = BLOCK) -> DataFrame:
    """Blocks of (id, vector), each vector in the heap of its nearest centroid."""
    dim, still = centroids.shape[1], np.zeros(len(centroids))
    none = np.array([], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = floors(matrix(b.column(1), dim), scale)
            known = np.asarray(b.column(0).is_valid())
            ids = np.asarray(b.column(0).fill_null(0)).astype("<i8")
            for s in (slice(at, at + size) for at in range(0, len(y), size)):
                width, x = narrow(y[s])
                state = advance(y[s], np.full(len(y[s]), -1, np.int32), none.astype(float), none, centroids, still)
                yield _written(len(y[s]), width, ids[s].tobytes(), known[s].tobytes(), x, state)

    return vectors.select(F.col(f"`{vec_id}`").cast("long"), F.col(f"`{embedding}`").cast("array<double>")).mapInArrow(run, BLOCKS)


def moved(held: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after the centroids moved."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                state = advance(wide(r["x"], r["width"], r["n"], dim), np.frombuffer(r["cluster"], "<i4"), np.frombuffer(r["heap_key"], "<f8"),
                                np.frombuffer(r["heap_row"], "<i4"), centroids, drift)
                yield _written(r["n"], r["width"], r["ids"], r["known"], r["x"], state)

    return held.mapInArrow(run, BLOCKS)


def means(held: DataFrame, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; an empty cluster stays where it was."""
    k, dim = before.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=np.int64)
        for b in batches:
            for r in b.to_pylist():
                x, c = wide(r["x"], r["width"], r["n"], dim), np.frombuffer(r["cluster"], "<i4")
                kind = np.int64 if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else object
                for a in np.unique(c):
                    total[a] += x[c == a].astype(kind).sum(axis=0).astype(object)
                count += np.bincount(c, minlength=k)
        a, i = np.indices((k, dim)).reshape(2, -1)
        there = np.flatnonzero(count[a])
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[there], pa.int32()), pa.array(i[there], pa.int32()), pa.array(count[a][there]),
             pa.array([Decimal(int(s)) for s in total.ravel()[there]], pa.decimal128(38, 0))], ["a", "i", "n", "s"])

    found = held.select("n", "width", "x", "cluster").mapInArrow(run, "a int, i int, n long, s decimal(38,0)")
    after = before.astype(object)
    for r in found.groupBy("a", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        after[r.a, r.i] = int(r.s) // r.n
    return after.astype(np.int64)


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What the gaps of each cluster's vectors may have lost by the move: its own way and the longest of the others."""
    way = np.array([float(sum((int(p) - int(q)) ** 2 for p, q in zip(a, b, strict=True))) ** 0.5 for a, b in zip(before, after, strict=True)])
    others = np.array([max(np.delete(way, a), default=0.0) for a in range(len(way))])
    return (way + others) * (1 + SLACK)


def assigned(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every vector in the blocks."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["cluster"], "<i4")
                x, c = exact(wide(r["x"], r["width"], r["n"], dim), centroids, dim=dim)
                far = [Decimal(int(d)) for d in ((x - c[own]) ** 2).sum(axis=1)]
                ids = pa.array(np.frombuffer(r["ids"], "<i8"), mask=~np.frombuffer(r["known"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(far, pa.decimal128(38, 0))], ["id", "cluster", "distance"])

    return held.select("n", "width", "x", "ids", "known", "cluster").mapInArrow(run, "id long, cluster int, distance decimal(38,0)")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
            vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Clustering]:
    """(id, cluster, distance) of every vector of ``dim`` components after ``rounds`` moves of the centroids, and the clustering."""
    e = F.col(f"`{embedding}`")
    kept = vectors.where((F.size(e) == dim) & whole(e.cast("array<double>")))
    first = starts(kept, k, scale, vec_id, embedding)
    if not first:
        none = kept.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.lit(0).alias("cluster"), F.lit(0).cast("decimal(38,0)").alias("distance"))
        return none, Clustering([])
    centroids = np.array(first, dtype=np.int64)
    held = materialize(blocks(kept, centroids, scale, vec_id, embedding), "clustering-blocks")
    drift = np.zeros(len(centroids))
    out = Clustering([], [held.agg(F.sum("rescanned")).first()[0]])
    for _ in range(rounds):
        after = means(held, centroids)
        drift, centroids = drift + drifts(centroids, after), after
        last, held = held, materialize(moved(held, centroids, drift), "clustering-blocks")
        release(last)
        out.rescanned.append(held.agg(F.sum("rescanned")).first()[0])
    rows = assigned(held, centroids)
    out.centroids = [[int(x) for x in c] for c in centroids]
    sums = rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()  # at most k rows
    out.inertia = {r.cluster: None if r.s is None else int(r.s) for r in sums}
    out.total = None if None in out.inertia.values() else sum(out.inertia.values())
    return rows, out


def by_cluster(values: dict[int, object], kind: str) -> Column:
    """The value of the row's cluster."""
    return F.get(F.array(*[F.lit(values.get(a)).cast(kind) for a in range(max(values, default=-1) + 1)]).cast(f"array<{kind}>"), F.col("cluster"))
