"""Secret scans: fixed patterns, and a character convolutional network over the other candidates.

The patterns (kinds assign, access, hex) always report. Every further long
run of key characters is a candidate; a small convolutional network in numpy
reads its characters and the text around it. The network is trained on the
patterns' own findings and on random keys in the places of candidates, against
those candidates that are less random than copies of themselves with other
letters (see :func:`learn`): a candidate that no pattern reports is unlabelled,
since a corpus holds keys that no pattern knows. Its scores are calibrated on
held-back rows. Every finding of the patterns in the corpus is then scored, and
the threshold is the highest one (in fine steps) that keeps the wanted recall
of them, and that of the held-back rows, which stand for the keys that no
pattern finds.

Weights and calibration come from at most ``SAMPLE`` labelled rows, those with
the smallest hash over the whole corpus; the threshold and the scan cover
every text in full.

Defined results: null text counts as empty; spans are in code points, end
exclusive; candidates that a pattern's span covers are not reported again,
those that go on beside one are, whole; a candidate longer than the network's
window is read in overlapping windows and has the score of the best;
repeated rows are scanned each; without both labels to learn from, the
network reports nothing; an empty table gives an empty result; other columns
stay in ``row`` whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.llm.common import TEXT_BATCH, materialize, packed

KINDS = ("assign", "access", "hex")
MODEL_KIND = "cnn"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
# a run is matched from its start only, so the shortest length can stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

#: Most labelled rows the network is fitted on; half secrets, half not.
SAMPLE = 4000
#: Least share of the corpus's labelled findings that the threshold must keep.
RECALL = 0.98
#: Copies of a candidate that it is compared with, and how often.
COPIES, ROUNDS = 8, 2
#: Score buckets for the threshold: so many to a unit of the network's output, which counts within the bound.
BUCKETS, BOUND = 256, 256
#: Characters of context on either side, and of the candidate.
CONTEXT, INSIDE = 16, 48

#: Documents whose marked texts a task holds at a time.
REDACTED = 500

SPAN = "struct<kind:string,start:int,end:int>"
#: A span has a window or, if it is long, several; label UNKNOWN: holds a pattern's span and more.
CANDIDATES = "struct<start:int,end:int,label:int,window:string>"
UNKNOWN = 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def window(text: str, start: int, end: int) -> str:
    """Context, at most ``INSIDE`` characters of a candidate, and context, each at fixed places; places without text hold NUL."""
    return (text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0") + text[start:end].ljust(INSIDE, "\0")
            + text[end : end + CONTEXT].ljust(CONTEXT, "\0"))


def windows_of(text: str, start: int, end: int) -> list[str]:
    """The windows of a candidate: each character lies in one at least, each run of ``INSIDE`` / 2 whole in one."""
    last = max(start, end - INSIDE)
    return [window(text, s, min(end, s + INSIDE)) for s in [*range(start, last, INSIDE // 2), last]]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label, window): every pattern's span (label 1) and every other candidate (label 0, or UNKNOWN
    where it holds key characters beside a pattern's span)."""
    found = [(s, e, 1, w) for _, s, e in base for w in windows_of(text, s, e)]
    for m in CANDIDATE.finditer(text):
        within = [(s, e) for _, s, e in base if s < m.end() and m.start() < e]
        at, rest = m.start(), ""
        for s, e in within:
            rest += text[at : max(at, s)]
            at = max(at, e)
        rest += text[at : m.end()]
        if any(c.isalnum() for c in rest):
            found += [(m.start(), m.end(), UNKNOWN if within else 0, w) for w in windows_of(text, *m.span())]
    return found


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, ``base`` (spans) and ``cands`` of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, cands = [], []
            for t in b.column(0).field(text):
                t = t.as_py() or ""
                base.append(base_spans(t))
                cands.append(candidates(t, base[-1]))
            base = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base]
            cands = [[{"start": s, "end": e, "label": y, "window": w} for s, e, y, w in x] for x in cands]
            kinds = (pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
                     pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("window", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kinds[0]), pa.array(cands, kinds[1])], ["row", "base", "cands"])

    rows = packed(docs)
    more = T.StructType.fromDDL(f"base array<{SPAN}>, cands array<{CANDIDATES}>")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more.fields]))


@dataclass
class Network:
    """Character embedding, one convolution, rectifier, maximum and mean over the window, one output."""
    embed: np.ndarray  # characters x 2 (inside the candidate or not), width
    conv: np.ndarray  # KERNEL * width, filters
    bias: np.ndarray
    out: np.ndarray  # 2 * filters + 1
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0

    KERNEL = 5

    @staticmethod
    def codes(windows: list[str]) -> np.ndarray:
        n = CONTEXT + INSIDE + CONTEXT
        x = np.frombuffer("".join(windows).encode("utf-32-le"), dtype="<u4").reshape(-1, n).astype(np.int64)
        x = np.where((x >= 32) & (x < 127), x - 30, np.where(x == 0, 0, 1))  # 0: no text, 1: any other character
        x[:, CONTEXT : CONTEXT + INSIDE] += 97
        return x

    def forward(self, x: np.ndarray):
        e = self.embed[x]
        n, length, width = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, self.KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.KERNEL + 1, -1)
        h = np.maximum(cols @ self.conv + self.bias, 0)
        top = h.argmax(axis=1)
        feats = np.concatenate([np.take_along_axis(h, top[:, None, :], 1)[:, 0], h.mean(axis=1), np.ones((n, 1))], axis=1)
        return cols, h, top, feats, feats @ self.out

    def outputs(self, windows: list[str]) -> np.ndarray:
        parts = [self.forward(self.codes(windows[k : k + 512]))[-1] for k in range(0, len(windows), 512)]
        return np.concatenate(parts) if parts else np.empty(0)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * z + self.scale[1])))

    def score(self, windows: list[str]) -> np.ndarray:
        """Calibrated probabilities."""
        return self.probability(self.outputs(windows))


def train(windows: list[str], labels: np.ndarray, epochs: int = 6, filters: int = 24, width: int = 8, seed: int = 7) -> Network:
    """Adam on the log loss; the seed fixes the result."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (2 * 97, width)), rng.normal(0, 0.2, (Network.KERNEL * width, filters)),
                  np.zeros(filters), np.zeros(2 * filters + 1))
    x, y = Network.codes(windows), labels.astype(float)
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    params = ["embed", "conv", "bias", "out"]
    m, v, t = {p: 0.0 for p in params}, {p: 0.0 for p in params}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 64):
            i = order[k : k + 64]
            cols, h, top, feats, z = net.forward(x[i])
            dz = (1 / (1 + np.exp(-z)) - y[i]) * weight[i] / len(i)
            df = dz[:, None] * net.out[None, :]
            dh = np.repeat(df[:, None, filters : 2 * filters] / h.shape[1], h.shape[1], axis=1)
            np.put_along_axis(dh, top[:, None, :], np.take_along_axis(dh, top[:, None, :], 1) + df[:, None, :filters], 1)
            dh *= h > 0
            flat = dh.reshape(-1, filters)
            dcols = (dh @ net.conv.T).reshape(len(i), h.shape[1], Network.KERNEL, width)
            de = np.zeros((len(i), x.shape[1], width))
            for j in range(Network.KERNEL):
                de[:, j : j + h.shape[1]] += dcols[:, :, j]
            demb = np.zeros_like(net.embed)
            np.add.at(demb, x[i].ravel(), de.reshape(-1, width))
            t += 1
            grads = {"embed": demb, "conv": cols.reshape(len(flat), -1).T @ flat, "bias": flat.sum(0), "out": feats.T @ dz}
            for p in params:
                m[p] = 0.9 * m[p] + 0.1 * grads[p]
                v[p] = 0.999 * v[p] + 0.001 * grads[p] ** 2
                setattr(net, p, getattr(net, p) - 0.01 * (m[p] / (1 - 0.9**t)) / (np.sqrt(v[p] / (1 - 0.999**t)) + 1e-8))
    return net


def calibrate(net: Network, windows: list[str], labels: np.ndarray, recall: float = RECALL) -> Network:
    """Platt scaling on held-back rows, then the highest threshold that keeps ``recall`` of their secrets."""
    z = net.outputs(windows)
    a, b = 1.0, 0.0
    n1, n0 = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(300):
        d = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - goal
        a, b = a - 0.05 * (d * z).mean(), b - 0.05 * d.mean()
    net.scale = (max(a, 1e-3), b)
    p = np.sort(net.score([w for w, y in zip(windows, labels) if y]))
    net.threshold = float(p[int((1 - recall) * len(p))])
    return net


def _seeded(w: str, salt: str) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32((salt + w).encode()))


def _inside(w: str, text: str) -> str:
    """The window with ``text`` as its candidate."""
    return w[:CONTEXT] + text[:INSIDE].ljust(INSIDE, "\0") + w[-CONTEXT:]


UPPERS, LOWERS, DIGITS = KEY_CHARACTERS[:26], KEY_CHARACTERS[26:52], KEY_CHARACTERS[52:]


def _some(rng: np.random.Generator, keys: str, n: int) -> str:
    return "".join(keys[k] for k in rng.integers(len(keys), size=n))


def random_secret(w: str) -> str:
    """The window with its candidate replaced by random key characters: of one of the usual alphabets, plain, after a
    short prefix, or in groups."""
    rng = _seeded(w, "")
    alphabets = (KEY_CHARACTERS, LOWERS + DIGITS, UPPERS + DIGITS, KEY_CHARACTERS + "+/", UPPERS, LOWERS, KEY_CHARACTERS + "_-")
    keys = alphabets[rng.choice(len(alphabets), p=(0.25, 0.2, 0.15, 0.1, 0.1, 0.1, 0.1))]
    n = max(len(w[CONTEXT : CONTEXT + INSIDE].rstrip("\0")), int(rng.integers(16, INSIDE + 1)))
    shape = rng.integers(4)
    if shape == 0:  # a prefix names the issuer
        mark = str(rng.choice(["_", "-"]))
        head = "".join(_some(rng, str(rng.choice([LOWERS, UPPERS])), int(rng.integers(2, 5))) + mark for _ in range(rng.integers(1, 3)))
        return _inside(w, head + _some(rng, keys, n))
    if shape == 1:  # groups
        mark = str(rng.choice(["_", "-", "/"]))
        return _inside(w, mark.join(_some(rng, keys if k else DIGITS + UPPERS, int(rng.integers(6, 14))) for k in range(int(rng.integers(2, 5)))))
    return _inside(w, _some(rng, keys, n))


def own_form(w: str, copy: int = 0) -> str | None:
    """The window with each letter and digit of its candidate replaced by a random one of its kind; what stands before
    a mark at the start is kept. None for a candidate that is almost without letters: its like would be numbers again."""
    rng, own = _seeded(w, f"own {copy}"), w[CONTEXT : CONTEXT + INSIDE].rstrip("\0")
    if sum(c.isalpha() for c in own) < 4:
        return None
    head = re.match(r"(?:[A-Za-z]{2,8}[_-]){0,2}", own)[0]
    return _inside(w, head + "".join(_some(rng, next((k for k in (UPPERS, LOWERS, DIGITS) if c in k), c), 1) for c in own[len(head) :]))


def harmless(w: str) -> str:
    """The window with its candidate replaced by what looks like a key and is none: dates, numbers, the candidate's
    own letters shouted, capitalised or as a path of parts."""
    rng = _seeded(w, "harmless")
    own = w[CONTEXT : CONTEXT + INSIDE].rstrip("\0")
    parts = [x for x in re.split(r"[^A-Za-z]+", own) if x] or ["run"]
    mark = str(rng.choice(["-", "_", "/", "="]))
    shape = rng.integers(5)
    if shape == 0:
        date = f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 32):02d}"
        return _inside(w, date + "".join(f"{mark}{rng.integers(0, 60):02d}" for _ in range(rng.integers(2, 5))))
    if shape == 1:
        return _inside(w, mark.join(str(rng.integers(10 ** int(rng.integers(1, 6)))).zfill(2) for _ in range(rng.integers(4, 9))))
    if shape == 2:
        return _inside(w, own.upper())
    if shape == 3:
        return _inside(w, "".join(x[:1].upper() + x[1:].lower() for x in parts for x in (x[: len(x) // 2], x[len(x) // 2 :])))
    cut = [x[k : k + 6] for x in parts for k in range(0, len(x), 6)]
    return _inside(w, mark.join(x.lower() for x in cut) + (mark + str(rng.integers(1000)) if rng.integers(2) else ""))


def labelled(extracted: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Windows of at most ``sample`` / 4 findings (1) and ``sample`` / 2 candidates that no pattern reports (0: unlabelled)."""
    found = extracted.select(F.explode("cands").alias("c")).select("c.window", "c.label").distinct().withColumn("h", F.xxhash64("window"))
    found = materialize(found, "secret-windows")
    held = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = []
    for label, most in ((0, sample // 2), (1, sample // 4)):  # UNKNOWN ones teach nothing
        # about twice as many as wanted pass the hash bound, however many partitions there are
        bound = int(-(2**63) + 2**64 * min(1.0, 2 * most / max(1, held.get(label, 0)))) - 1
        rows += found.where((F.col("label") == label) & (F.col("h") <= bound)).orderBy("h", "window").limit(most).collect()
    windows, labels = [r.window for r in rows], [r.label for r in rows]
    return windows, np.array(labels, dtype=int)


def finding_scores(extracted: DataFrame, net: Network) -> dict[int, int]:
    """How many of the corpus's labelled findings have their best window's output in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, windows = [], []
            for i, cands in enumerate(b.column(0).to_pylist()):
                for c in cands:
                    if c["label"] == 1:
                        owners.append((i, c["start"], c["end"]))
                        windows.append(c["window"])
            best: dict[tuple[int, int, int], float] = {}
            for k, z in zip(owners, net.outputs(windows)):
                best[k] = max(z, best.get(k, -np.inf))
            z = np.clip(np.array(list(best.values())), -BOUND, BOUND)
            buckets, n = np.unique(np.floor(z * BUCKETS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(n, pa.int64())], ["bucket", "n"])

    found = extracted.select("cands").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in found.collect()}


def part_of(windows: list[str]) -> np.ndarray:
    """0 to 4 by hash: 0 to 2 train, 3 calibrates, 4 is held out."""
    return np.array([zlib.crc32(w.encode()) % 5 for w in windows], dtype=int)


def learn(windows: list[str], labels: np.ndarray, sample: int = SAMPLE, recall: float = RECALL) -> Network | None:
    """Network and calibration from findings and unlabelled candidates; None without one of either.

    A candidate that no pattern reports is not known to be harmless: a corpus
    holds keys that no pattern finds. Secrets are the findings, random keys in
    the places of candidates, and a copy of every candidate in its own form
    with other letters and digits. A key is as random as its copies and scores
    like them; a word or path scores below. So a first network takes all
    candidates for harmless, and then only those count as harmless that score
    clearly below all of ``COPIES`` other copies of themselves; with these, and
    look-alikes made of them, the next network learns. ``ROUNDS`` times.
    """
    found, none = ([w for w, y in zip(windows, labels) if y == k] for k in (1, 0))
    if not found or not none:
        return None
    made = [random_secret(w) for w in none[: sample // 4]] + [c for c in map(own_form, none) if c]
    others = [[c for c in (own_form(w, k) for k in range(1, COPIES + 1)) if c] for w in none]

    def rows(plain: list[str], which) -> tuple[list[str], np.ndarray]:
        kept = [(w, y) for ws, y in ((found + made, 1), (plain, 0)) for w, k in zip(ws, part_of(ws)) if k in which]
        return [w for w, _ in kept], np.array([y for _, y in kept], dtype=int)

    plain = none
    for _ in range(ROUNDS):
        net = train(*rows(plain, (0, 1, 2)))
        like = iter(net.outputs([c for cs in others for c in cs]))
        least = [min(z) - np.std(z) if (z := [next(like) for _ in cs]) else np.inf for cs in others]
        plain = [w for w, z, lo in zip(none, net.outputs(none), least) if z < lo]
        plain += [harmless(w) for w in (plain or none)[: sample // 4]]
    train_w, train_y = rows(plain, (0, 1, 2))
    cal_w, cal_y = rows(plain, (3,))
    if min(train_y.sum(), (1 - train_y).sum(), cal_y.sum(), (1 - cal_y).sum()) == 0:
        return None
    return calibrate(train(train_w, train_y), cal_w, cal_y, recall)


def fit(extracted: DataFrame, sample: int = SAMPLE, recall: float = RECALL) -> Network | None:
    """The network of :func:`learn`; all findings of the corpus bound its threshold."""
    net = learn(*labelled(extracted, sample), sample, recall)
    if net is None:
        return None
    counts = finding_scores(extracted, net)
    total, kept = sum(counts.values()), 0
    for bucket in sorted(counts, reverse=True):
        kept += counts[bucket]
        if kept >= recall * total:
            own = float(net.probability(np.array(bucket / BUCKETS))) if bucket > -BOUND * BUCKETS else 0.0
            net.threshold = min(net.threshold, own)
            break
    return net


def spans_of(b: pa.RecordBatch, net: Network | None) -> list[list[dict]]:
    """For each row of a batch of :func:`extract` the patterns' spans and the network's, by start, then kind."""
    order = {k: i for i, k in enumerate((*KINDS, MODEL_KIND))}
    cands = [[c for c in x if c["label"] != 1] for x in b.column(2).to_pylist()]
    scores = iter(net.score([c["window"] for x in cands for c in x]) if net else ())
    spans = []
    for base, own in zip(b.column(1).to_pylist(), cands):
        # a candidate is secret if one of its windows is
        more = {(c["start"], c["end"]) for c in own if net and next(scores) >= net.threshold}
        spans.append(sorted(base + [{"kind": MODEL_KIND, "start": s, "end": e} for s, e in more], key=lambda x: (x["start"], order[x["kind"]])))
    return spans


def report(extracted: DataFrame, net: Network | None) -> DataFrame:
    """``row`` and ``spans``: the patterns' and the network's, by start, then kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans_of(b, net), kind)], ["row", "spans"])

    return extracted.mapInArrow(run, T.StructType([extracted.schema["row"], *T.StructType.fromDDL(f"spans array<{SPAN}>").fields]))


def scan(docs: DataFrame, text: str = "text", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """``row`` and ``spans`` of every document. The text itself is kept only if other columns of ``docs`` need it:
    what is written between fitting and scoring are spans and windows."""
    found = extract(docs, text)
    slim = found.withColumn("row", F.col("row").dropFields(text)) if len(docs.columns) > 1 else found
    slim = materialize(slim, "secrets", TEXT_BATCH)
    return report(slim, fit(slim, sample, recall))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[SECRET]", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``mark`` and ``n_chars``, if there, counted anew."""
    found = materialize(extract(docs, text), "secrets", TEXT_BATCH)
    net = fit(found, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = spans_of(b, net)
            # found and marked by one Python worker a task, a few texts at a time
            for at in range(0, b.num_rows, REDACTED):
                yield marked(b.column(0).slice(at, REDACTED), spans[at : at + REDACTED])

    def marked(row: pa.StructArray, spans: list[list[dict]]) -> pa.RecordBatch:
        texts = row.field(text).to_pylist()
        for i, found_here in enumerate(spans):
            if not found_here:
                continue
            parts, at = [], 0
            for s in found_here:  # by start; overlapping spans share a mark
                if s["start"] >= at:
                    parts += [texts[i][at : s["start"]], mark]
                at = max(at, s["end"])
            texts[i] = "".join([*parts, texts[i][at:]])
        names = [f.name for f in row.type]
        cols = [pa.array(texts, pa.string()) if c == text else row.field(c) for c in names]
        if n_chars in names:
            n = row.type.field(n_chars).type
            cols[names.index(n_chars)] = pa.array([None if t is None else len(t) for t in texts]).cast(n)
        return pa.RecordBatch.from_arrays(cols, names)

    return found.mapInArrow(run, docs.schema)
