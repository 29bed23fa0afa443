"""Packing documents into token sequences by best-fit decreasing.

A document is tokenized once, closed by an end id, and cut into full windows
and a rest. Full windows are sequences already. The rests are dealt out to
tasks by a hash of their row, longest first in each task, and each goes into
the open window with the least room that still holds it, which a segment tree
indexed by remaining capacity finds in log(capacity) steps.

Defined results: a null text counts as empty, an empty text is its end id
alone; repeated rows are packed each; an empty table gives no piece; other
columns are ignored. A task holds only the lengths of its share of rests
(``share`` of them), however long the texts are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.llm.common import TEXT_BATCH, materialize

CAPACITY = 1024
END_ID = 0
#: Rests in one task: enough for best fit to fill its windows, few enough for its memory.
SHARE = 200_000

_encoders: dict[str, object] = {}
_whole_encoders: dict[str, object] = {}


def encoder(path: str):
    """``encode(text) -> ids`` of a byte-level BPE file, special tokens read as ordinary text.

    ``tokenizers`` reads the file. Where the file's merges are in the order of
    the ids they make, the same ids come from a ``tiktoken`` encoding with
    those ids as ranks, about six times as fast (README); else ``tokenizers`` encodes.
    """
    if path not in _encoders:
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        file = json.load(open(path, encoding="utf-8"))
        vocab = file["model"].get("vocab", {})
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"].get("merges", [])]
        made = [vocab.get(a + b, -1) for a, b in merges]
        plain = file["pre_tokenizer"] and file["pre_tokenizer"].get("type") == "ByteLevel" and not file["pre_tokenizer"].get("add_prefix_space")
        if plain and not file.get("normalizer") and made == sorted(set(made)) and made[0] == 256:
            import tiktoken

            # the printable stand-ins of byte-level BPE: printable bytes stand for themselves, the rest from U+0100 on
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in shown]
            byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
            special = {t["content"] for t in file.get("added_tokens", [])}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
            _encoders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _encoders[path] = lambda text: tok.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def whole_encoder(path: str):
    """``encode(text) -> ids`` as ``tokenizers`` does by default: the file's added tokens in a text become their own ids.

    A process reads the file once, and keeps of it what the ids need.
    """
    if path in _whole_encoders:
        return _whole_encoders[path]
    file = json.load(open(path, encoding="utf-8"))
    added, normalizer = [t["content"] for t in file.get("added_tokens", [])], bool(file.get("normalizer"))
    del file  # before ``encoder`` reads it
    fast, own = encoder(path), []

    def encode(text: str) -> list[int]:
        # a normalizer may make an added token of other characters
        if not normalizer and not any(a in text for a in added):
            return fast(text)
        if not own:
            from tokenizers import Tokenizer

            own.append(Tokenizer.from_file(path))
        return own[0].encode(text, add_special_tokens=False).ids

    return _whole_encoders.setdefault(path, encode)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = whole_encoder(tokenizer)
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            kept: list[np.ndarray] = []
            for i, t in enumerate(b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), end_id], dtype="<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((i, at, len(part), zlib.crc32(part), len(ids)))
                    if with_ids:
                        kept.append(part)
            n = np.array(rows, dtype=np.int64).reshape(-1, 5)
            cols = [b.column(0).take(pa.array(n[:, 0])), *(pa.array(n[:, k]) for k in range(1, 5))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")),
                           *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.half)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        k = self.half + room
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, and that room; it is no longer open."""
        k = self.half + length
        if not self.any[k]:
            while k > 1 and not (k % 2 == 0 and self.any[k + 1]):  # up to a subtree with more room
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.half:
                k = 2 * k + (not self.any[2 * k])
        room = k - self.half
        window = self.at[room].pop()
        if not self.at[room]:
            self.any[k] = 0
            while (k := k >> 1) and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
        return window, room


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window number and offset for each length; the lengths come in falling order."""
    windows, offsets, n, free = [], [], 0, OpenWindows(capacity)
    for length in lengths:
        window, room = free.take(length) or (n, capacity)
        n += window == n
        windows.append(window)
        offsets.append(capacity - room)
        if room > length:
            free.put(room - length, window)
    return windows, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """``parts`` (of ``pieces``, materialized) with sequence_id and offset."""
    full = parts.where(F.col("length") == capacity).select("*", (2 * F.monotonically_increasing_id()).alias("sequence_id"),
                                                           F.lit(0).cast("long").alias("offset"))
    rests = parts.where(F.col("length") < capacity).withColumn("uid", F.monotonically_increasing_id())
    tasks = max(1, -(-rests.count() // share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        base = TaskContext.get().partitionId() << 33
        lengths = [x for b in got for x in b.column(b.schema.get_field_index("length")).to_pylist()]
        windows, offsets = best_fit(lengths, capacity)
        ids = 2 * (np.array(windows, dtype=np.int64) + base) + 1
        at = 0
        for b in got:
            to = at + b.num_rows
            cols = [c for c, name in zip(b.columns, b.schema.names) if name != "uid"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids[at:to]), pa.array(np.array(offsets[at:to], dtype=np.int64))],
                                             [*(x for x in b.schema.names if x != "uid"), "sequence_id", "offset"])
            at = to

    dealt = rests.repartition(tasks, F.xxhash64("uid")).sortWithinPartitions(F.col("length").desc(), "uid")
    return full.unionByName(dealt.mapInArrow(run, full.schema))


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
                   end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``capacity`` tokens."""
    return pack(materialize(pieces(docs, tokenizer, text, doc_id, capacity, end_id, with_ids), "pieces", TEXT_BATCH), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """Training sequences from pieces with ids: sequence_id, ids (padded to ``capacity``
    unless their number is a power of two), n_tokens."""
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    s = packed.groupBy("sequence_id").agg(joined.alias("ids")).select("sequence_id", "ids", F.size("ids").alias("n_tokens"))
    short = F.when(F.bit_count("n_tokens") == 1, F.lit(0)).otherwise(F.lit(capacity) - F.col("n_tokens"))
    return s.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), short)).alias("ids"), "n_tokens")
