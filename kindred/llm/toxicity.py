"""Toxicity by compression distance.

Two zstandard dictionaries are trained (zstandard's own trainer) on a bounded sample of labelled documents: one on windows of
ordinary documents, one on those and on the passages that set toxic documents apart. Every window of a text, a few whole
words, is compressed with both; the bytes that the toxic dictionary saves are its gain.

Most of a toxic document is ordinary text, so its dictionary learns from passages: byte runs whose share of toxic documents
is far above their share of ordinary ones (a likelihood-ratio test over all runs of GRAM bytes, where text copied between
documents counts once). Ordinary windows that these passages would shorten by chance are trained into the part that
both dictionaries share, so they stop to.

Thresholds are calibrated in steps: for each length of window, a gain weighs by how much more often toxic documents have it
than ordinary ones (none below the least gain that tells them apart); a logistic curve, fitted on a quarter of the
documents that the dictionaries never saw, maps the sum of weights and the number of windows to a score in [0, 1].

Defined results: a null or empty text has no window and gets the score of a text without evidence; without labels of both
classes, or where nothing sets them apart, every score is 0; so it is where all labelled texts of a class are longer than
LONGEST characters, since only shorter ones are sampled. Repeated rows are scored alike, a null doc_id counts as empty text for
the split, and columns other than doc_id and text are never read. Texts are scored whole, however long.
"""

from __future__ import annotations

import random

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import batches_of, crc_mod, durable, labelled_sample, map_batches, py_crc_mod, numbered, scanned, trimmed, without

#: A window has so many words and bytes at most.
WORDS, BYTES = 4, 56
#: Bytes of the dictionaries: ordinary text, ordinary text in each round of hard cases, toxic text.
ORDINARY, HARD, TOXIC, ROUNDS = 4096, 4096, 2048, 3
GRAM, SLOTS_LOG, PASSAGE = 5, 21, 8
#: A run of bytes sets toxic documents apart at this likelihood ratio (2 ln) and this many times the ordinary share.
RATIO, TIMES = 24.0, 3.0
MOST = 8  # larger gains count as this one
LENGTHS = (20, 36)  # of windows, in bytes: limits between the strata of gains
#: Put before each window and into both dictionaries: it pays for a frame's fixed cost, which hides small gains otherwise.
CARRIER = bytes(range(128, 160))
THRESHOLD = 0.7
#: Bounds of the sample that the model is fitted on: documents of each class, characters of a document (longer ones aren't used).
PER_CLASS, LONGEST = {0: 3000, 1: 1200}, 20_000
#: Texts in one Arrow batch of the pipeline's stage, and in one call of the model.
TEXTS = 512


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def windows_of(words: list[bytes]) -> list[bytes]:
    """Consecutive words, WORDS at a time; a window over BYTES is cut between words, and a word over BYTES within."""
    out = []
    for k in range(0, len(words), WORDS):
        w = b" " + b" ".join(words[k : k + WORDS])
        if len(w) <= BYTES:
            out.append(CARRIER + w)
            continue
        now = b""
        for word in words[k : k + WORDS]:
            for at in range(0, len(word), BYTES - 1):
                piece = b" " + word[at : at + BYTES - 1]
                if now and len(now) + len(piece) > BYTES:
                    out.append(CARRIER + now)
                    now = b""
                now += piece
        out.append(CARRIER + now)
    return out


def slots(data: bytes) -> np.ndarray:
    """A hash slot for each run of GRAM bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | a[k : k + n]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The last `size` bytes of a dictionary trained on samples; the best segments stand last."""
    try:
        data = zs.train_dictionary(size + 512, samples, k=segment, d=6).as_bytes()
    except zs.ZstdError:  # too little text for the trainer
        data = b"".join(samples)
    return data[-size:].rjust(size, b"\n")


class Pair:
    """Both dictionaries; gains() are the bytes that the toxic one saves on each window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self._both = None

    def __getstate__(self):
        return self.ordinary, self.toxic

    def __setstate__(self, s):
        self.__init__(*s)

    def gains(self, windows: list[bytes]) -> np.ndarray:
        if self._both is None:
            p = zs.ZstdCompressionParameters(
                window_log=16, hash_log=14, chain_log=14, search_log=5, min_match=5, target_length=64, strategy=zs.STRATEGY_LAZY2,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            self._both = []
            for data in (self.ordinary, self.toxic):
                d = zs.ZstdCompressionDict(data + CARRIER + b"\n" * 16, dict_type=zs.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=p)
                self._both.append(zs.ZstdCompressor(dict_data=d, compression_params=p).multi_compress_to_buffer)
        out = np.zeros(len(windows), np.int64)
        for at in range(0, len(windows), 20_000):
            some = windows[at : at + 20_000]
            a, b = (f(some, threads=0) for f in self._both)
            out[at : at + len(some)] = [len(a[k]) - len(b[k]) for k in range(len(some))]
        return out.clip(0, MOST)


def stratum(windows: list[bytes]) -> np.ndarray:
    return np.searchsorted(LENGTHS, np.fromiter(map(len, windows), np.int64, len(windows)) - len(CARRIER))


class Model:
    """Dictionaries, weights of gains (a row for each stratum of window length) and the curve; some kilobytes whatever the corpus."""

    def __init__(self, pair: Pair | None, weights: np.ndarray | None = None, noise: tuple[float, float] = (0.0, 0.0), curve: tuple[float, ...] | None = None):
        self.pair, self.weights, self.noise, self.curve = pair, weights, noise, curve

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: evidence against its expected noise, evidence, number of windows."""
        unique: dict[bytes, int] = {}
        seat = unique.setdefault
        numbers, sizes = [], []
        for t in texts:
            own = windows_of(words_of(t))
            numbers += [seat(w, len(unique)) for w in own]
            sizes.append(len(own))
        each = list(unique)
        weight = self.weights[stratum(each), self.pair.gains(each)] if each else np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(weight[np.array(numbers, np.int64)])])
        ends = np.cumsum(sizes)
        n = np.array(sizes, float)
        return self.described(np.maximum(total[ends] - total[ends - np.array(sizes, np.int64)], 0), n)

    def described(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        mean, var = self.noise
        z = (sums - n * mean) / np.sqrt(n * var + 1)
        return np.column_stack([np.minimum(z, 30) / 3, np.log1p(sums), np.log1p(n)])

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.curve is None:
            return [0.0] * len(texts)
        x = self.features(texts)
        return (1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -30, 30)))).tolist()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T * (weight * p * (1 - p)) @ x + ridge, x.T @ (weight * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def _novel(docs: list[list[bytes]]) -> list[np.ndarray]:
    """For each word, whether it and its neighbours stand nowhere before in these documents: copies teach once."""
    hashes = []
    for words in docs:
        h = np.array([0, *map(hash, words), 0], np.int64).view(np.uint64)
        hashes.append(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9))
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.zeros(len(every), bool)
    first[np.unique(every, return_index=True)[1]] = True
    return np.split(first, np.cumsum([len(h) for h in hashes])[:-1])


def passages(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """What sets toxic documents apart: the core of each stretch of significant runs of bytes, and some bytes after it."""
    counts, kept = [], []
    for docs in (ordinary, toxic):
        docs = [d for d in docs if d]
        count = np.zeros(1 << SLOTS_LOG, np.int32)
        kept = []
        for words, new in zip(docs, _novel(docs), strict=True):
            data = b" " + b" ".join(words) + b" "
            s = slots(data)
            ok = np.repeat(new, [len(w) + 1 for w in words])[: len(s)]
            s = s[: len(ok)]
            count[np.unique(s[ok])] += 1
            kept.append((data, s, ok))
        counts.append((count, len(docs)))
    (no, n0), (nt, n1) = counts
    if not n0 or not n1:
        return []
    at = np.flatnonzero(nt)
    a, c, q = nt[at].astype(float), no[at].astype(float), n1 / (n0 + n1)
    ratio = 2 * (a * np.log(a / ((a + c) * q)) + np.where(c > 0, c * np.log(np.maximum(c, 1) / ((a + c) * (1 - q))), 0))
    score = np.zeros(1 << SLOTS_LOG, np.float32)
    score[at] = np.where((ratio > RATIO) & (a * n0 > TIMES * c * n1), ratio, 0)
    out = []
    for data, s, ok in kept:
        own = np.where(ok, score[s], 0)
        reach = np.zeros(len(data) + 2, bool)
        for k in range(GRAM):
            reach[1 + k : 1 + k + len(own)] |= own > 0
        edge = np.flatnonzero(reach[1:] != reach[:-1])
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            part = own[start : end - GRAM + 1]
            core = np.flatnonzero(part >= 0.5 * part.max())
            x, y = start + int(core[0]), start + int(core[-1]) + GRAM
            out.append(data[x : max(y, x + PASSAGE)])
    return out


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Pair | None:
    found = passages(toxic, ordinary)
    if not found:
        return None
    rng = random.Random(7)
    signs = [*range(1, 9), *range(14, 32)]  # control characters: a segment that runs over the end of a passage matches no text
    apart = lambda: bytes(rng.choices(signs, k=8))
    rng.shuffle(found)
    own = trained([apart() + x + apart() for x in found], TOXIC, 16)
    plain = list(dict.fromkeys(w for words in ordinary for w in windows_of(words)))
    rng.shuffle(plain)
    shared = trained([w[len(CARRIER) :] for w in plain[:40_000]], ORDINARY, 16)
    for _ in range(ROUNDS):
        pair = Pair(shared + b"\n" * TOXIC, shared + own)
        hard = [plain[k][len(CARRIER) :] for k in np.flatnonzero(pair.gains(plain) >= 2)]
        if len(hard) < 20:
            break
        shared = trained(hard, HARD, 12) + shared
    return Pair(shared + b"\n" * TOXIC, shared + own)


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """rows: (doc_id, text, label). Dictionaries and weights from three quarters by hash, the curve from the rest."""
    seen: dict[int, list[list[bytes]]] = {0: [], 1: []}
    held: list[tuple[str, int]] = []
    for i, t, y in rows:
        if py_crc_mod(i, 4) == 0:
            held.append((t, y))
        else:
            seen[y].append(words_of(t))
    if not seen[0] or not seen[1]:
        return Model(None)
    pair = dictionaries(seen[1], seen[0])
    if pair is None:
        return Model(None)
    rates = np.zeros((2, len(LENGTHS) + 1, MOST + 1))
    for y, docs in seen.items():
        for words in docs:
            w = windows_of(words)
            if w:
                np.add.at(rates[y], (stratum(w), pair.gains(w)), 1)
    share = (rates + 0.5) / (rates.sum(2, keepdims=True) + 5)
    more = np.cumsum(share[:, :, ::-1], axis=2)[:, :, ::-1]  # of gains so large or larger
    weights = np.maximum.accumulate(np.log(more[1] / more[0]).clip(0, 8), axis=1)
    weights[:, 0] = 0
    plain = rates[0] / max(1.0, rates[0].sum())
    mean = float((plain * weights).sum())
    model = Model(pair, weights, (mean, float((plain * weights**2).sum() - mean**2)))
    if len({y for _, y in held}) < 2:  # too few labels to hold some back
        held = [(t, y) for _, t, y in rows]
    y = np.array([y for _, y in held], float)
    # Texts without evidence are ordinary, of whatever length: lengths that the sample lacks, as no text at all, are held to that.
    n = np.concatenate([[0.0], 2.0 ** np.arange(14)])
    x = np.concatenate([model.features([t for t, _ in held]), model.described(np.zeros(len(n)), n)])
    weight = np.concatenate([np.where(y == 1, 2.0, 1.0), np.full(len(n), max(1.0, len(held) / 50))])
    model.curve = _logistic(x, np.concatenate([y, np.zeros(len(n))]), weight)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1, within PER_CLASS and LONGEST."""
    model = fit(labelled_sample(docs, labels, "toxic", PER_CLASS, crc_mod(F.col("doc_id"), 3) != 1, "toxicity", LONGEST))
    trimmed()  # the sample and its windows, some hundred megabytes
    return model


def _slices(texts: list[str | None], chars: int = 2_000_000):
    """Ranges of texts with about so many characters, at least one text each."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each row of docs, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        m = shared.value
        for b in parts:
            for x, y in _slices(b["text"]):
                scores = m.scores(b["text"][x:y])
                yield [(i, py_crc_mod(i, 3) == 1, s, int(s >= THRESHOLD)) for i, s in zip(b["doc_id"][x:y], scores, strict=True)]

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id long, held_out boolean, score double, predicted int", run, rows=TEXTS)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score THRESHOLD or more; columns and order of columns stay.

    Python gets texts alone, TEXTS at a time, and gives the numbers of the rows to drop. Whole rows in batches of Spark's size
    take some hundred megabytes of an executor, and its Python workers keep them while later stages run.
    """
    docs = scanned(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        m = shared.value
        for b in parts:
            toxic = [s >= THRESHOLD for x, y in _slices(b["text"]) for s in m.scores(b["text"][x:y])]
            yield [(rid,) for rid, t in zip(b["rid"], toxic, strict=True) if t]
        trimmed()

    rows = numbered(docs.select(F.col("text").cast("string").alias("text"))).select("rid", "text")
    with batches_of(docs.sparkSession, TEXTS):
        gone = durable(map_batches(rows, "rid long", run, rows=TEXTS), "toxicity-gone")
    return without(docs, gone)
