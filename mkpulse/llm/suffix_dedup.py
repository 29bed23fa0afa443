"""Removal of repeated strings by a common-prefix-aware distributed merge sort of suffixes.

Every byte covered by a ``length``-byte string that also starts anywhere else
is removed. Which suffixes are sorted is decided by content: the gram (``GRAM``
bytes) of least hash in each window of ``length`` bytes is the window's
anchor, so equal windows have their anchors at equal places, and sorting the
suffixes at anchors, with the text before them, decides every window exactly.

1. Anchors of all texts; a gram hash found once in the corpus ends there.
2. Each task sorts the suffixes at its remaining anchors into runs, keyed by
   gram hash and suffix. A run is front-coded: an entry holds the length of
   the prefix it shares with the entry before, and its own rest.
3. Runs are exchanged by ranges of the key and merged by loser trees. A tree
   knows how much each entry shares with the last output; entries that differ
   in this number are never compared, others only from that byte on.
4. In the merged order, with the prefix lengths that the merge leaves behind,
   a window that begins x bytes before its anchor is repeated if another entry
   shares length - x bytes of the suffix and x bytes of the text before it.
5. The covered bytes of each text are removed.

Entries that agree in suffix and text before it are settled inside their run
and leave one entry, so copies and passages that many texts share do not pile
up. A gram of more than ``HOT`` occurrences is not merged in one task: its
windows are counted by their SHA-256 over the whole cluster instead.

The texts are read three times and exchanged twice, to meet their anchors and
to meet their spans; written are anchors, lists of those that repeat, and
spans, each deleted as soon as the next is there.

Defined results: null text counts as empty; texts shorter than ``length``
keep everything; repeated rows repeat each other; an empty table gives an
empty result; other columns stay in ``row`` whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.llm.common import materialize, packed
from mkpulse.session import release

LENGTH = 200
GRAM = 64
#: Bytes of text hashed at a time, and entries of a run.
SLICE, RUN = 1 << 20, 60_000
#: Occurrences of a gram up to which its entries meet in one task.
HOT = 300_000

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse powers modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every ``gram`` bytes of ``x``."""
    up, down = _power_tables(len(x) + 1)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(x) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, _M, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, gram hash) of all anchors."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, int, bytes]] = []  # text, offset of the slice, slice

    def flush():
        if not held:
            return
        x = np.frombuffer(b"".join(s for _, _, s in held), dtype=np.uint8)
        sizes = np.array([len(s) for _, _, s in held])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # windows that lie in one slice
        room = np.repeat(starts + sizes, sizes) - np.arange(len(x))
        ok = room[: len(x) - length + 1] >= length
        h = gram_hashes(x, gram)
        low = np.uint64((1 << 21) - 1)
        least = window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)[ok]
        at = np.unique((least & low).astype(np.int64)) if len(least) else np.empty(0, np.int64)
        slot = np.searchsorted(starts, at, side="right") - 1
        texts_, offsets = np.array([t for t, _, _ in held]), np.array([o for _, o, _ in held])
        found.append((texts_[slot], at - starts[slot] + offsets[slot], h[at].view(np.int64)))
        held.clear()

    total = 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), SLICE - length + 1):
            piece = t[at : at + SLICE]
            if len(piece) < length:
                break
            if total + len(piece) > SLICE:
                flush()
                total = 0
            held.append((i, at, piece))
            total += len(piece)
    flush()
    if not found:
        return (np.empty(0, np.int64),) * 3
    i, at, h = (np.concatenate([f[k] for f in found]) for k in range(3))
    # slices of one text overlap and may name an anchor twice
    twice = np.zeros(len(i), dtype=bool)
    order = np.lexsort((at, i))
    twice[order[1:]] = (np.diff(i[order]) == 0) & (np.diff(at[order]) == 0)
    return i[~twice], at[~twice], h[~twice]


def anchors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(uid, at, h) of (uid, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, at, h = anchors_of([t.as_py() for t in b.column(1)], length, gram)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(at), pa.array(h)], ["uid", "at", "h"])

    return rows.mapInArrow(run, "uid long, at long, h long")


# ---- runs ------------------------------------------------------------------

def shared_prefixes(keys: list[bytes]) -> np.ndarray:
    """How much each key shares with the one before it (the first: nothing)."""
    if not keys:
        return np.empty(0, np.int64)
    sizes = np.array([len(k) for k in keys])
    width = int(sizes.max(initial=0)) + 1
    x = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), dtype=np.uint8).reshape(-1, width)
    differ = np.ones((len(keys), width), dtype=bool)
    differ[1:] = x[1:] != x[:-1]
    differ[:, -1] = True
    out = differ.argmax(axis=1)
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def encode_run(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (key, text before it reversed, uid, place, count), front-coded."""
    keys = [e[0] for e in entries]
    lcp = shared_prefixes(keys)
    rest = [k[n:] for k, n in zip(keys, lcp.tolist())]
    cols = [np.array(c, dtype=d).tobytes() for c, d in (
        (lcp, "<u2"), ([len(r) for r in rest], "<u2"), ([len(e[1]) for e in entries], "<u2"),
        ([e[2] for e in entries], "<i8"), ([e[3] for e in entries], "<i8"), ([e[4] for e in entries], "u1"))]
    return b"".join([struct.pack("<I", len(entries)), *cols, b"".join(rest), b"".join(e[1] for e in entries)])


def decode_run(data: bytes) -> Iterator[tuple[int, tuple[bytes, bytes, int, int, int]]]:
    """The entries of a run, each with the prefix it shares with the one before."""
    (n,), at, cols = struct.unpack_from("<I", data), 4, []
    for d in ("<u2", "<u2", "<u2", "<i8", "<i8", "u1"):
        cols.append(np.frombuffer(data, d, n, at).tolist())
        at += n * np.dtype(d).itemsize
    lcp, sizes, before_sizes, uids, places, counts = cols
    left, key = at + sum(sizes), b""
    for k in range(n):
        key = key[: lcp[k]] + data[at : at + sizes[k]]
        at += sizes[k]
        yield lcp[k], (key, data[left : left + before_sizes[k]], uids[k], places[k], counts[k])
        left += before_sizes[k]


def common_from(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, which share ``start`` bytes."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    lo, hi = start, end  # shares lo, differs within hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class LoserTree:
    """Merges sorted runs; ``pops`` yields (prefix shared with the entry before, entry).

    ``share[r]`` is what run r's next entry shares with the last output. Of two
    entries the one that shares more is smaller; only on a tie bytes are
    compared, from the shared length on, and the loser keeps what it shares
    with the winner.
    """

    def __init__(self, runs: list[Iterator[tuple[int, tuple]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.entry: list[tuple | None] = [None] * self.k
        self.share = [0] * self.k
        self.compared = 0  # byte comparisons, for tests
        for r in range(len(runs)):
            self._next(r)
            self.share[r] = 0
        self.loser = [-1] * self.k
        self.winner = self._build(1)

    def _next(self, r: int) -> None:
        self.share[r], self.entry[r] = next(self.runs[r], (-1, None))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won = self._play(a, b)
        self.loser[node] = a + b - won
        return won

    def _play(self, a: int, b: int) -> int:
        x, y = self.entry[a], self.entry[b]
        if x is None or y is None:
            return b if x is None else a
        if self.share[a] != self.share[b]:
            return a if self.share[a] > self.share[b] else b
        self.compared += 1
        n = common_from(x[0], y[0], self.share[a])
        won = a if x[0][n : n + 1] <= y[0][n : n + 1] else b
        self.share[a + b - won] = n
        return won

    def pops(self) -> Iterator[tuple[int, tuple]]:
        while self.entry[self.winner] is not None:
            r = self.winner
            yield self.share[r], self.entry[r]
            self._next(r)
            won, node = r, (r + self.k) // 2
            while node:
                if self._play(self.loser[node], won) != won:
                    won, self.loser[node] = self.loser[node], won
                node //= 2
            self.winner = won


# ---- decisions ---------------------------------------------------------------

def span(place: int, first: int, last: int, length: int) -> tuple[int, int]:
    """The bytes covered by the windows that begin ``first`` to ``last`` bytes before ``place``."""
    return place - last, place + length - first


def whole_range(suffix: int, before: int, length: int, gram: int) -> tuple[int, int]:
    """The least and largest distance of a window's start before an anchor with so much text after and before it."""
    return max(0, length - suffix), min(length - gram, before)


#: Bytes of the gram hash before the suffix in a key.
HEAD = 8
#: Entries decided together; a gram's entries are never divided.
TOGETHER = 20_000


def by_grams(merged: Iterator[tuple[int, tuple]], gram: int, least: int = TOGETHER) -> Iterator[list[tuple[int, tuple]]]:
    """The merged entries in lists of at least ``least``, cut where a new gram begins."""
    held: list[tuple[int, tuple]] = []
    for n, entry in merged:
        if len(held) >= least and n < HEAD + gram:
            yield held
            held = []
        held.append((n if held else 0, entry))
    if held:
        yield held


def decide(merged: Iterator[tuple[int, tuple]], length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(uid, start, end) of the covered bytes around the entries of one key range, in merged order."""
    for part in by_grams(merged, gram):
        yield from decide_part(part, length, gram)


def decide_part(merged: list[tuple[int, tuple]], length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    texts: list[tuple[bytes, bytes]] = []
    places: list[list[tuple[int, int]]] = []
    counts: list[int] = []
    share: list[int] = []
    same: dict[bytes, int] = {}  # text before, of the entries with the last key
    least = 0
    for n, (key, before, uid, place, count) in merged:
        if not (texts and n == len(key) == len(texts[-1][0])):
            same.clear()
        least = min(least, n)
        k = same.get(before)
        if k is None:
            same[before] = len(texts)
            texts.append((key, before))
            share.append(least)
            places.append([])
            counts.append(0)
            k, least = len(texts) - 1, len(key)
        counts[k] += count
        if count == 1:
            places[k].append((uid, place))
    if not texts:
        return
    lcp, counts_, sizes = np.array(share) - HEAD, np.array(counts), np.array([len(k) - HEAD for k, _ in texts])
    befores = np.array([len(b) for _, b in texts])
    # entries found twice with the same surroundings
    for k in np.flatnonzero(counts_ >= 2).tolist():
        first, last = whole_range(sizes[k], befores[k], length, gram)
        if first <= last:
            for uid, place in places[k]:
                yield uid, *span(place, first, last, length)
    # of the others, those whose gram has other surroundings too
    lcp[0] = -HEAD
    near = lcp >= gram
    shared = near | np.append(near[1:], False)
    lcp = np.where(near, lcp, -1)
    kept = np.flatnonzero(shared)
    if not len(kept):
        return
    lcp, counts_, sizes, befores = lcp[kept], counts_[kept], sizes[kept], befores[kept]
    lefts = [texts[k][1] for k in kept.tolist()]
    by_left = sorted(range(len(kept)), key=lefts.__getitem__)
    left_lcp = shared_prefixes([lefts[k] for k in by_left])
    by_left = np.array(by_left)
    first, last = np.full(len(kept), length), np.full(len(kept), -1)
    left_class = np.empty(len(kept), dtype=np.int64)
    for x in range(0, length - gram + 1):
        can = (befores >= x) & (sizes >= length - x)
        right_class = np.cumsum(lcp < length - x)
        left_class[by_left] = np.cumsum(left_lcp < x) if x else 0
        key = (right_class * (len(kept) + 1) + left_class)[can]
        _, inverse = np.unique(key, return_inverse=True)
        hit = np.flatnonzero(can)[np.bincount(inverse, weights=counts_[can])[inverse] >= 2]
        first[hit], last[hit] = np.minimum(first[hit], x), x
    for j in np.flatnonzero((last >= 0) & (counts_ == 1)).tolist():
        for uid, place in places[kept[j]]:
            yield uid, *span(place, int(first[j]), int(last[j]), length)


def surroundings(text: bytes, at: int, length: int, gram: int) -> tuple[bytes, bytes]:
    """The suffix at an anchor, as far as a window can reach, and the text before it, reversed."""
    return text[at : at + length], text[max(0, at - (length - gram)) : at][::-1]


def coverage(hits: DataFrame, buckets: int, length: int = LENGTH, gram: int = GRAM, run_entries: int = RUN) -> DataFrame:
    """(uid, start, end) of repeated bytes, from (uid, bytes, ats, hs): the texts and their repeated anchors."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, bytes], list[int]] = {}
        settled: list[tuple[int, int, int]] = []
        fields = [("bucket", pa.int32()), ("run", pa.binary()), ("uid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]

        def flush() -> pa.RecordBatch:
            entries = sorted((key, before, *v) for (key, before), v in seen.items())
            bucket = [(int.from_bytes(e[0][:4]) * buckets) >> 32 for e in entries]
            out, at = [], 0
            while at < len(entries):
                to = bisect_left(bucket, bucket[at] + 1, at)
                out.append((bucket[at], encode_run(entries[at:to]), None, None, None))
                at = to
            out += [(u % buckets, None, u, s, e) for u, s, e in settled]
            seen.clear()
            settled.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(fields)], [f for f, _ in fields])

        def settle(uid: int, place: int, key: bytes, before: bytes):
            first, last = whole_range(len(key) - HEAD, len(before), length, gram)
            if first <= last:
                settled.append((uid, *span(place, first, last, length)))

        for b in batches:
            for uid, text, ats, hs in zip(*b.columns):
                uid, text = uid.as_py(), text.as_py()
                for at, h in zip(ats.as_py(), hs.as_py()):
                    suffix, before = surroundings(text, at, length, gram)
                    # anchors have small hashes; multiplied, they spread over the key range
                    key = (h * _BASE & _M).to_bytes(8) + suffix
                    held = seen.get((key, before))
                    if held is None:
                        seen[key, before] = [uid, at, 1]
                    else:  # the same surroundings twice in this run: both settled, one entry goes on
                        settle(uid, at, key, before)
                        if held[2] == 1:
                            settle(held[0], held[1], key, before)
                            held[2] = 2
                    if len(seen) >= run_entries or len(settled) >= 4 * run_entries:
                        yield flush()  # also inside a text: a very long one has millions of anchors
        if seen or settled:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
            x = np.array(spans, dtype=np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(3)], ["uid", "start", "end"])

        bucket, held = None, []
        for b in batches:
            spans = []
            for own, run, uid, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if run is None:
                    spans.append((uid, start, end))
                    continue
                if own != bucket and held:
                    spans += decide(LoserTree([decode_run(r) for r in held]).pops(), length, gram)
                    held = []
                bucket = own
                held.append(run)
            yield out(spans)
        if held:
            yield out(list(decide(LoserTree([decode_run(r) for r in held]).pops(), length, gram)))

    n = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = hits.mapInArrow(runs, "bucket int, run binary, uid long, start long, end long")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "uid long, start long, end long")


def owned_windows(text: bytes, ats: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Start of every window of ``text`` whose anchor is one of ``ats``."""
    found = [np.empty(0, np.int64)]
    low = np.uint64((1 << 21) - 1)
    for at in range(0, max(0, len(text) - length + 1), SLICE - length + 1):
        x = np.frombuffer(text, dtype=np.uint8)[at : at + SLICE]
        if len(x) < length:
            break
        h = gram_hashes(x, gram)
        owner = (window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low).astype(np.int64) + at
        found.append(np.flatnonzero(np.isin(owner, ats)) + at)
    return np.concatenate(found)


def hot_coverage(hits: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """As ``coverage``, for grams too frequent for one task: every window with such an anchor is counted by its SHA-256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text, ats, _ in zip(*b.columns):
                uid, text = uid.as_py(), text.as_py()
                start = owned_windows(text, np.array(ats.as_py()), length, gram)
                for at in range(0, len(start), RUN):
                    part = start[at : at + RUN]
                    digests = [hashlib.sha256(text[s : s + length]).digest() for s in part.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), uid)), pa.array(part), pa.array(digests, pa.binary())], ["uid", "start", "w"])

    windows = materialize(hits.mapInArrow(run, "uid long, start long, w binary"), "hot-windows")
    twice = materialize(windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select(F.col("w").alias("v")), "hot-twice")
    return windows.join(twice, F.col("w") == F.col("v"), "left_semi").select("uid", "start", (F.col("start") + length).alias("end"))


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, stable: bool = False) -> DataFrame:
    """``row`` (without the text), n_bytes, n_removed, n_spans, kept (bytes; null if ``text`` is kept whole), kept_sha256.

    ``stable`` says that ``docs`` gives the same rows in the same order when
    read again (a table); otherwise it is written once first.
    """
    if not stable:
        docs = materialize(docs, "suffix-input")
    body = F.coalesce(F.col("row")[text], F.lit("")).cast("binary")
    rows = packed(docs).select(F.monotonically_increasing_id().alias("uid"), "row", body.alias("bytes"))
    rows = rows.withColumn("row", F.col("row").dropFields(text)) if len(docs.columns) > 1 else rows
    found = materialize(anchors(rows.select("uid", "bytes"), length, gram), "anchors")
    twice = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("k"), "n"), "grams")
    hit = found.join(twice, F.col("h") == F.col("k"))
    lists = materialize(hit.groupBy(F.col("uid").alias("u")).agg(*[
        F.collect_list(F.when((F.col("n") > hot) if heat else (F.col("n") <= hot), F.struct("at", "h"))).alias(name)
        for name, heat in (("cool", False), ("hot", True))]), "repeated-anchors")
    heated = not twice.where(F.col("n") > hot).isEmpty()
    release(found, twice)

    def of(col: str) -> DataFrame:
        """The texts with repeated anchors, read again, and these anchors."""
        part = rows.select("uid", "bytes").join(lists.where(F.size(col) > 0), F.col("uid") == F.col("u"))
        return part.select("uid", "bytes", F.transform(col, lambda a: a["at"]).alias("ats"), F.transform(col, lambda a: a["h"]).alias("hs"))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = coverage(of("cool"), 4 * n, length, gram)
    if heated:
        spans = spans.union(hot_coverage(of("hot"), length, gram))
    spans = materialize(spans.groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeated-spans")
    release(lists)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())]
        for b in batches:
            out = []
            for data, spans in zip(*(c for c in b.columns[1:])):
                data, runs = data.as_py(), []
                for x in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([*x])
                if not runs:
                    out.append((len(data), 0, 0, None, hashlib.sha256(data).hexdigest()))
                    continue
                edges = [0, *(e for r in runs for e in r), len(data)]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], t) for k, (_, t) in enumerate(fields))],
                                             ["row", *(f for f, _ in fields)])

    done = rows.join(spans, F.col("uid") == F.col("u"), "left").select("row", "bytes", "spans")
    more = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return done.mapInArrow(cut, T.StructType([done.schema["row"], *more.fields]))
