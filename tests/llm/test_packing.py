import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge import clashing, documents
from tokenizers import Tokenizer

from mkpulse.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [np.array([*e.ids, 0], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def slow_best_fit(lengths, capacity):
    windows, out = [], []
    for n in lengths:
        fit = [(room, w) for w, room in enumerate(windows) if room >= n]
        if fit:
            room, w = min(fit)
        else:
            w = len(windows)
            windows.append(capacity)
            room = capacity
        out.append(room)
        windows[w] -= n
    return out, windows


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_takes_the_tightest_window(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 64, 100])
    lengths = sorted((rng.randint(1, cap) for _ in range(300)), reverse=True)
    windows, offsets = P.best_fit(lengths, cap)
    rooms, left = slow_best_fit(lengths, cap)
    assert [cap - o for o in offsets] == rooms
    used = [0] * len(left)
    for w, n in zip(windows, lengths):
        used[w] += n
    assert sorted(cap - u for u in used) == sorted(left)


def test_encoder_gives_the_files_ids(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["<|endoftext|> x", "\u0000\u200b\U0001F600 e\u0301 ①", "  \n\n\t x", "don't I'LL", "", "a" * 3000, "日本語テキスト" * 50]
    encode = P.encoder(PATH)
    assert [[*encode(t), 0] for t in texts] == [x.tolist() for x in ids_of(texts)]
    assert "tiktoken" in type(encode.__self__).__module__


def check(packed, docs, capacity=1024):
    got = packed.collect()
    spans, seqs = {}, {}
    for r in got:
        spans.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = {}
    for d, ids in zip(docs, ids_of([d.text for d in docs])):
        own = want.setdefault((d.doc_id, len(ids)), [])
        own += [(s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity])) for s in range(0, len(ids), capacity)]
    assert {k: sorted(v) for k, v in spans.items()} == {k: sorted(v) for k, v in want.items()}
    return seqs


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_edge_documents(spark, wrap):
    docs = wrap(documents(spark))
    check(P.pack_documents(docs, PATH), docs.collect())


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seqs = check(P.pack_documents(docs, PATH), docs.collect())
    total = sum(n for parts in seqs.values() for _, n in parts)
    assert total / (1024 * len(seqs)) > 0.99


def test_sequences_hold_the_ids(spark):
    docs = documents(spark)
    packed = P.pack_documents(docs, PATH, capacity=128, with_ids=True).cache()
    check(packed, docs.collect(), 128)
    for r in P.sequences(packed, 128).collect():
        assert len(r.ids) == (r.n_tokens if r.n_tokens.bit_count() == 1 else 128)
    seqs = {r.sequence_id: r.ids for r in P.sequences(packed, 128).collect()}
    for r in packed.collect():
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == r.ids and zlib.crc32(np.array(r.ids, dtype="<u4")) == r.ids_crc32


def test_empty_table(spark):
    assert P.pack_documents(documents(spark).limit(0), PATH).count() == 0


def test_added_tokens_in_a_text_get_their_own_ids(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> x", "<|endoftext|><|endoftext|>", "plain", "<|endoftext"]
    want = [[*Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, 0] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in P.pieces(docs, PATH, with_ids=True).collect()}
    assert [got[i] for i in range(4)] == want and want[1] == [50256, 50256, 0]


def test_a_process_reads_the_tokenizer_file_once(monkeypatch):
    reads, load = [], P.json.load
    monkeypatch.setattr(P, "_encoders", {})
    monkeypatch.setattr(P, "_whole_encoders", {}, raising=False)
    monkeypatch.setattr(P.json, "load", lambda f: reads.append(f.name) or load(f))
    first = P.whole_encoder(PATH)
    n = len(reads)
    assert P.whole_encoder(PATH) is first and len(reads) == n
    # what stays is the encoder, not the parsed file
    assert not any(isinstance(c.cell_contents, dict) for c in first.__closure__)


def test_tokenizing_workers_get_small_batches(spark, monkeypatch):
    held, real = [], P.materialize

    def materialize(df, tag, *bound):
        held.append((tag, bound))
        return real(df, tag, *bound)

    monkeypatch.setattr(P, "materialize", materialize)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text").coalesce(1)
    packed = P.pack_documents(docs, PATH)
    assert packed.selectExpr("sum(length)").first()[0] == sum(len(x) for x in ids_of(["word " * 2000])) * 3000
    assert held == [("pieces", ("4m",))]
