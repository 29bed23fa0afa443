"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put in order of locality (the nearest of a few pivot vectors, then
id) and cut into blocks by ranges of that order. A block keeps a forward index
(its vectors as a matrix) and, for each term (dimension), the largest and the
smallest value. For a query, the sum of each term's weight times the larger
side is an upper bound of every score in the block. A query visits blocks by
falling bound and stops when the next bound is below its k-th score; a bound
equal to it is still visited, for ties go to the smaller id.

Blocks lie in groups, queries in chunks of the same order, and whole groups
are skipped before they are sent anywhere:

1. From the term maxima alone each chunk finds the group that promises most.
2. It is scored there, which gives every query its first k-th score.
3. From the term maxima again: pairs of group and chunk in which no query has
   a bound as high as its k-th score are dropped. Only blocks and queries of
   the others meet, each pair in one bounded task that begins with the k-th
   scores of step 2, and each query leaves at most k rows for the final rank.

Defined results: vectors that are null, or hold a null or non-finite
component, and rows without an id take no part; every other row is a candidate
and, among the queries, a query of its own, also where rows share an id or are
equal (only a query's own row is left out); vectors of different lengths are
compared as if filled up with zeros; empty tables give an empty result; other
columns are ignored. Weights whose inner products may pass 2^53 are multiplied
as integers; weights saturate at 2^58, scores at the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mkpulse.llm.common import materialize
from mkpulse.llm.vectors import LIMIT, whole
from mkpulse.session import release

K = 20
BLOCK = 256
#: Candidate blocks and queries in one task.
GROUP_BLOCKS, CHUNK = 64, 512
#: Vectors that others are ordered around, chosen by hash: a bounded sample that only sets the order.
PIVOTS = 64
LONG = (1 << 63) - 1
FOUND = "uid long, query_id long, vec_id long, score long, scored long"
BLOCKS = "n long, dim long, width long, uids binary, ids binary, x binary, high binary, low binary"


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(uid, id, v): floor(scale * x) of every component. Write the result before it is searched: ``uid`` numbers its rows."""
    e = F.col(f"`{embedding}`")
    ints = F.transform(e, lambda x: F.least(F.greatest(F.floor(F.lit(scale) * x.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long"))
    rows = vectors.where(whole(e) & F.col(f"`{vec_id}`").isNotNull())
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{vec_id}`").cast("long").alias("id"), ints.alias("v"))


def rows_of(v: pa.Array) -> list[np.ndarray]:
    ends, values = v.offsets.to_numpy(), v.flatten().to_numpy(zero_copy_only=False)
    return np.split(values, ends[1:-1] - ends[0]) if len(ends) > 1 else []


def with_cells(vectors: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """(uid, id, v) with ``cell``: the number of the pivot at the smallest angle."""
    dim = max((len(p) for p in pivots), default=0)
    c = np.array([p + [0] * (dim - len(p)) for p in pivots], dtype=float).reshape(len(pivots), dim)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, dim))
            for i, v in enumerate(rows_of(b.column(2))):
                x[i, : min(dim, len(v))] = v[:dim]
            cell = (x @ c.T).argmax(axis=1) if len(c) and dim else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["uid", "id", "v", "cell"])

    return vectors.select("uid", "id", "v").mapInArrow(run, "uid long, id long, v array<long>, cell int")


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of (uid, id, v): ids, forward index, term maxima and minima, numbered within their partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []

        def cut(rows) -> pa.RecordBatch:
            dim = max(len(v) for _, _, v in rows)
            x = np.zeros((len(rows), dim), dtype="<i8")
            for i, (_, _, v) in enumerate(rows):
                x[i, : len(v)] = v
            uids, ids = (np.array([r[j] for r in rows], dtype="<i8") for j in (0, 1))
            high, low = (f(initial=0, axis=0) if dim == 0 else f(axis=0) for f in (x.max, x.min))
            # in the narrowest whole numbers that hold the block's values
            width = next(w for w in (1, 2, 4, 8) if x.size == 0 or -(1 << 8 * w - 1) <= low.min() and high.max() < 1 << 8 * w - 1)
            x, high, low = (m.astype(f"<i{width}").tobytes() for m in (x, high, low))
            return pa.RecordBatch.from_pydict({"n": [len(rows)], "dim": [dim], "width": [width], "uids": [uids.tobytes()], "ids": [ids.tobytes()],
                                               "x": [x], "high": [high], "low": [low]})

        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), rows_of(b.column(2)))
            while len(held) >= size:
                yield cut(held[:size])
                held = held[size:]
        if held:
            yield cut(held)

    return vectors.select("uid", "id", "v").mapInArrow(run, BLOCKS)


def _matrix(b, dim: int, col: str = "x") -> np.ndarray:
    out = np.zeros((b.n if col == "x" else 1, dim), dtype=np.int64)
    out[:, : b.dim] = np.frombuffer(getattr(b, col), dtype=f"<i{b.width}").reshape(len(out), b.dim)
    return out


def _queries(frame: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uid, id and weights of the queries in a chunk."""
    uid, qid = (np.concatenate([np.frombuffer(b, "<i8") for b in frame[c]]) for c in ("uids", "ids"))
    return uid, qid, np.concatenate([_matrix(b, dim) for b in frame.itertuples()])


def _exact(q: np.ndarray, *parts: np.ndarray) -> list[np.ndarray]:
    """In the fastest type in which inner products with ``q`` are exact."""
    dim, most = q.shape[1], max([0, *(int(np.abs(p).max(initial=0)) for p in parts)])
    bound = int(np.abs(q).max(initial=0)) * most * max(1, dim)
    kind = float if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    return [p.astype(kind) for p in (q, *parts)]


def _long(s: np.ndarray) -> np.ndarray:
    """Scores within the range of a long."""
    return np.clip(s, -LONG, LONG).astype(np.int64) if s.dtype == object else s


def bounds(q: np.ndarray, group: pd.DataFrame, dim: int) -> np.ndarray:
    """Upper bounds of the scores of each query in each block."""
    q, high, low = _exact(q, *(np.concatenate([_matrix(b, dim, c) for b in group.itertuples()]) for c in ("high", "low")))
    return _long(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)


def top_of(queries: pd.DataFrame, group: pd.DataFrame, k: int = K, least: dict[int, int] | None = None) -> tuple[pd.DataFrame, int]:
    """The k best of a group of blocks for each query of a chunk, and the number of (query, block) pairs scored.

    ``least`` gives the k-th score that a query has elsewhere: lower ones are not looked for.
    """
    dim = max([0, *queries.dim, *group.dim])
    uid, qid, q = _queries(queries, dim)
    index = [(np.frombuffer(b.uids, "<i8"), np.frombuffer(b.ids, "<i8"), _matrix(b, dim)) for b in group.itertuples()]
    bound = bounds(q, group, dim)
    q, *xs = _exact(q, *(x for _, _, x in index))
    order = np.argsort(-bound, axis=1, kind="stable")
    none = -np.inf if q.dtype == float else -LONG - 1
    kind = float if q.dtype == float else np.int64
    scores = np.full((len(q), k), none, dtype=kind)
    ids = np.full((len(q), k), LONG)
    floor = np.array([(least or {}).get(u, none) for u in uid.tolist()], dtype=kind)
    scored = 0
    alive = np.arange(len(q))
    for r in range(len(index)):
        at = order[alive, r]
        go = bound[alive, at] >= np.maximum(scores[alive, -1], floor[alive])
        alive, at = alive[go], at[go]
        if not len(alive):
            break
        for j in np.unique(at):
            own = alive[at == j]
            block_uids, block_ids, _ = index[j]
            scored += len(own)
            s = _long(q[own] @ xs[j].T)
            mine = uid[own][:, None] == block_uids[None, :]
            s[mine] = none
            better = np.flatnonzero(s.max(axis=1) >= scores[own, -1])
            own, s = own[better], np.concatenate([scores[own[better]], s[better]], axis=1)
            there = np.concatenate([ids[own] < LONG, ~mine[better]], axis=1)
            i = np.where(there, np.concatenate([ids[own], np.broadcast_to(block_ids, (len(own), len(block_ids)))], axis=1), LONG)
            best = np.lexsort((i, -s if kind is float else np.where(s == none, LONG, -np.maximum(s, -LONG))), axis=1)[:, :k]
            scores[own], ids[own] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
    found = (scores != none) & (scores >= floor[:, None])
    rows = found.sum(axis=1)
    return pd.DataFrame({"uid": np.repeat(uid, rows), "query_id": np.repeat(qid, rows), "vec_id": ids[found], "score": scores[found].astype(np.int64)}), scored


def _grouped(vectors: DataFrame, block: int, group_blocks: int, name: str) -> tuple[DataFrame, int]:
    """The blocks of ``vectors`` with the number of their group in column ``name``, and the number of groups (at least 1).

    A group holds neighbouring blocks, about ``group_blocks`` of them.
    """
    wanted = max(1, -(-vectors.count() // (block * group_blocks)))
    ranged = vectors.repartitionByRange(wanted, "cell", "id").sortWithinPartitions("cell", "id")
    held = materialize(blocks(ranged, block).select("*", F.shiftright(F.monotonically_increasing_id(), 33).alias("part")), "topk-blocks")
    parts = (held.agg(F.max("part")).first()[0] or 0) + 1
    groups = min(wanted, parts)
    numbered = held.withColumn(name, F.floor(F.col("part") * groups / parts).cast("int")).drop("part")
    numbered.materialized_at = held.materialized_at
    return numbered, groups


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, group_blocks: int = GROUP_BLOCKS, chunk: int = CHUNK,
           stats: bool = False):
    """For each row of ``queries`` (uid, id, v) its k best of ``vectors`` (uid, id, v) but itself: uid, query_id, rank, vec_id, score.

    With ``stats`` also a frame with the (query, block) pairs scored and all there are.
    """
    pivots = [list(r.v) for r in vectors.orderBy(F.xxhash64("v"), "v").select("v").limit(PIVOTS).collect()]
    docs, groups = _grouped(with_cells(vectors, pivots), block, group_blocks, "g")
    asked, chunks = _grouped(with_cells(queries, pivots), chunk, 1, "h")
    maxima = docs.select("g", "n", "dim", "width", "high", "low")  # no forward index
    every_group, every_chunk = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, chunks))
    meet = asked.select("*", every_group.alias("g")).groupBy("g", "h")

    def promise(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({"h": [], "g": [], "total": []})
        dim = max(*q.dim, *g.dim)
        best = bounds(_queries(q, dim)[2], g, dim).max(axis=1)
        return pd.DataFrame({"h": [int(q.h.iloc[0])], "g": [int(g.g.iloc[0])], "total": [float(best.astype(float).sum())]})

    promised = meet.cogroup(maxima.select("*", every_chunk.alias("h")).groupBy("g", "h")).applyInPandas(promise, "h int, g int, total double")
    first = materialize(promised.groupBy("h").agg(F.max_by("g", F.struct("total", -F.col("g"))).alias("g")), "topk-first")

    def known(q: pd.DataFrame) -> dict[int, int]:
        """The k-th scores of a chunk's queries, if they are packed beside them."""
        return {u: s for us, ss in zip(q.kth_uid, q.kth_score) for u, s in zip(us, ss)} if "kth_uid" in q else {}

    def score(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        """The rows found, and one without a query that counts the pairs scored."""
        found, scored = top_of(q, g, k, known(q)) if len(q) and len(g) else (pd.DataFrame(columns=["uid", "query_id", "vec_id", "score"]), 0)
        count = pd.DataFrame({c: pd.Series([None], dtype="Int64") for c in found.columns}).assign(scored=scored)
        return pd.concat([found.astype("Int64").assign(scored=0), count])

    near = asked.join(first, "h").groupBy("g", "h").cogroup(docs.join(first, "g").groupBy("g", "h")).applyInPandas(score, FOUND)
    near = materialize(near, "topk-near")
    kth = near.where("uid IS NOT NULL").groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("uid", "least")

    # every chunk with the k-th scores of its queries: uid is found in its block by membership
    members = asked.select("h", F.col("uids").alias("b")).mapInArrow(_members, "h int, uid long")
    scores = members.join(kth, "uid").groupBy("h").agg(F.collect_list("uid").alias("kth_uid"), F.collect_list("least").alias("kth_score"))
    armed = materialize(asked.join(scores, "h", "left").withColumns({
        "kth_uid": F.coalesce("kth_uid", F.array().cast("array<long>")), "kth_score": F.coalesce("kth_score", F.array().cast("array<long>"))}), "topk-armed")

    def survive(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({"h": [], "g": []})
        dim, least = max(*q.dim, *g.dim), known(q)
        uid, _, w = _queries(q, dim)
        best = bounds(w, g, dim).max(axis=1)
        some = any(u not in least or int(b) >= least[u] for u, b in zip(uid.tolist(), best.tolist()))
        return pd.DataFrame({"h": [int(q.h.iloc[0])], "g": [int(g.g.iloc[0])]} if some else {"h": [], "g": []})

    again = armed.select("*", every_group.alias("g")).join(first.withColumnRenamed("g", "done"), "h").where("g <> done").drop("done")
    pairs = again.groupBy("g", "h").cogroup(maxima.select("*", every_chunk.alias("h")).groupBy("g", "h")).applyInPandas(survive, "h int, g int")
    pairs = materialize(pairs, "topk-pairs")
    far = armed.join(pairs, "h").groupBy("g", "h").cogroup(docs.join(pairs, "g").groupBy("g", "h")).applyInPandas(score, FOUND)
    found = materialize(near.unionByName(far), "topk-found")
    all_pairs = docs.count() * queries.count() if stats else 0
    release(docs, asked, first, near, armed, pairs)
    ranked = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    out = found.where("uid IS NOT NULL").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    out = out.select("uid", "query_id", "rank", "vec_id", "score")
    return (out, found.agg(F.sum("scored").alias("scored")).withColumn("pairs", F.lit(all_pairs))) if stats else out


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for h, uids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            uid = np.frombuffer(uids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), h, np.int32)), pa.array(uid)], ["h", "uid"])
