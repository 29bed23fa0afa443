"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into sixteen 4-bit segments and mapped to the
vector of their bit counts. The Manhattan distance of two vectors never
exceeds the Hamming distance of the fingerprints, so it prunes safely. Two
integer vectors at Manhattan distance 2r or less share a grid cell within r
steps of both; each distinct fingerprint is placed in all cells within r
steps of its vector, and the range join becomes an equality of cells.
Fingerprints that share a cell are then compared bit by bit.

Copies never meet in a cell: equal fingerprints are one class from the start.
A cell gives at most one link less than its members (a spanning forest), and
a crowded cell is split again by single bits, which is linear in its size.

Defined results: null text counts as empty; a text without words has
fingerprint zero and links like any other; null ids are ignored when the
smallest id is taken (a component of null ids only has a null id); repeated
rows each get a row; an empty table gives an empty result; other columns are
passed through by ``keep_first`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.llm.common import TEXT_BATCH, materialize, packed

SEED = 42
SEGMENTS = 16
#: Cells with more fingerprints than this are split by single bits.
CROWDED = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8, dtype=np.int64) * 256)[None, :]


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text as an unsigned integer: a bit is set if it is set in over half the shingle hashes."""
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know ASCII letters and ASCII white space only
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = zip(*(w[k:] for k in range(shingle))) if len(w) >= shingle else [w]
    h = np.array([xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype="<u8")
    places = (h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel()
    ones = np.bincount(places, minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(2 * ones.ravel() > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``row`` (the input row as a struct) and ``fp`` (the fingerprint's 64 bits as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            fp = np.array([simhash(t.as_py(), shingle) for t in row.field(text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([row, pa.array(fp)], ["row", "fp"])

    rows = packed(docs)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))


def _steps(r: int) -> list[int]:
    """Packed vectors of at most ``r`` unit steps over the segments, as signed 64-bit numbers."""
    found = {0}
    for _ in range(r):
        found |= {x + s * (1 << 4 * k) for x in found for k in range(SEGMENTS) for s in (1, -1)}
    return sorted((x + 2**63) % 2**64 - 2**63 for x in found)


def _hex(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def cells(classes: DataFrame, max_bits: int) -> DataFrame:
    """Each distinct ``fp`` with every grid cell within half the distance of its bit-count vector.

    The vector is packed into one long, four bits a segment, moved up by the
    number of steps so that no segment goes below zero.
    """
    r = (max_bits + 1) // 2
    if r > 5:
        raise ValueError("4-bit segments hold at most 10 differing bits")
    x = F.col("fp")
    bits = [F.shiftrightunsigned(x, k).bitwiseAND(F.lit(0x1111111111111111)) for k in range(4)]
    quads = bits[0] + bits[1] + bits[2] + bits[3]
    return (classes.select("fp", quads.alias("v"))
            .select("fp", F.explode(F.array(*[F.lit(_hex(s + r * 0x1111111111111111)) for s in _steps(r)])).alias("step"), "v")
            .select(_wrapped_add("v", "step").alias("cell"), "fp"))


def _wrapped_add(a: str, b: str):
    """a + b modulo 2^64 without an overflow error: low and high halves are added apart."""
    low = F.expr(f"({a} & 4294967295L) + ({b} & 4294967295L)")
    high = F.expr(f"shiftrightunsigned({a}, 32) + shiftrightunsigned({b}, 32)") + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(4294967295)), 32).bitwiseOR(low.bitwiseAND(F.lit(4294967295)))


def _forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs that join two trees when taken one after another."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        if (p := root(x)) != (q := root(y)):
            up[max(p, q)] = min(p, q)
            yield x, y


def _links_in(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one cell."""
    x = fp.view(np.uint64)
    if len(x) > CROWDED and max_bits <= 2:
        # sharing x with one bit flipped (or cleared, for distance one): within the distance, all of them
        flip = [x ^ np.uint64(1 << k) for k in range(64)] if max_bits == 2 else [x & ~np.uint64(1 << k) for k in range(64)]
        keys, who = np.concatenate([x, *flip]), np.tile(np.arange(len(x)), 65)
        tag = np.zeros(len(keys), int) if max_bits == 2 else np.repeat(np.arange(65), len(x))
        order = np.lexsort((who, keys, tag))
        keys, who, tag = keys[order], who[order], tag[order]
        same = (keys[1:] == keys[:-1]) & (tag[1:] == tag[:-1]) & (who[1:] != who[:-1])
        a, b = fp[who[:-1][same]], fp[who[1:][same]]
    else:
        a, b = [], []
        for k in range(1, len(x)):
            near = np.bitwise_count(x[k:] ^ x[:-k]) <= max_bits
            a.append(fp[:-k][near])
            b.append(fp[k:][near])
        a, b = np.concatenate(a), np.concatenate(b)
    return list(_forest(a, b))


def links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints: enough of them to connect every pair that links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(runs_of: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(runs_of)) + 1
            start, end = np.r_[0, cut], np.r_[cut, len(fps)]
            size = end - start
            found: list[tuple[int, int]] = []
            pair = start[size == 2]  # most shared cells hold two
            near = np.bitwise_count(fps[pair].view(np.uint64) ^ fps[pair + 1].view(np.uint64)) <= max_bits
            a, b = fps[pair][near], fps[pair + 1][near]
            for s, e in zip(start[size > 2].tolist(), end[size > 2].tolist()):
                found += _links_in(fps[s:e], max_bits)
            more = np.array(found, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[a, more[:, 0]]), pa.array(np.r_[b, more[:, 1]])], ["a", "b"])

        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if len(cell) and cell[0] != cell[-1]:  # the last cell may go on in the next batch
                last = np.searchsorted(cell, cell[-1])
                yield out(cell[:last], fp[:last])
                cell, fp = cell[last:], fp[last:]
        if len(cell):
            yield out(cell, fp)

    placed = cells(classes, max_bits)
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (placed.repartition(n, "cell").sortWithinPartitions("cell", "fp")
            .mapInArrow(run, "a long, b long").where("a != b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): each node that is not a root with its ``root``, the smallest node.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, and the rounds end when the edges stay the same.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every edge now points to a smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k"))
        return small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(edges, "links")
    seen = mark(edges)
    while seen[0]:
        edges = materialize(stars(edges), "stars")
        if (now := mark(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes_with_components(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """One row per distinct ``fp``: ``first``, the smallest (is null, id, uid) struct of its component.

    ``rows`` has fp and ``who``, that struct for each document.
    """
    classes = materialize(rows.groupBy("fp").agg(F.min("who").alias("who")), "fingerprints")
    star = components(links(classes.select("fp"), max_bits))
    members = star.union(star.select("root", "root").distinct())
    linked = materialize(members.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "who"), "linked")
    first = linked.groupBy("root").agg(F.min("who").alias("first"))
    linked = linked.join(first, "root").select(F.col("fp").alias("node"), "first")
    return materialize(classes.join(linked, F.col("fp") == F.col("node"), "left")
                       .select("fp", F.coalesce("first", "who").alias("first")), "classes")


def _who(doc_id: str):
    return F.struct(F.col("row")[doc_id].isNull().alias("none"), F.col("row")[doc_id].alias("id"),
                    F.monotonically_increasing_id().alias("uid"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id that can be reached)."""
    rows = fingerprints(docs.select(doc_id, text), text, shingle).select(_who(doc_id).alias("who"), "fp")
    rows = materialize(rows, "simhash", TEXT_BATCH)
    found = classes_with_components(rows, max_bits).select(F.col("fp").alias("k"), "first")
    return rows.join(found, F.col("fp") == F.col("k")).select(
        F.col("who.id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.id").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, one per component: that with the smallest id."""
    rows = materialize(fingerprints(docs, text, shingle).select("row", _who(doc_id).alias("who"), "fp"), "simhash", TEXT_BATCH)
    found = classes_with_components(rows.select("who", "fp"), max_bits)
    winners = found.select(F.col("first.uid").alias("uid")).distinct()
    return rows.select("row", F.col("who.uid").alias("uid")).join(winners, "uid", "left_semi").select("row.*")
