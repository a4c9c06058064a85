"""Quality rules by line labelling: a linear-chain conditional random field marks each line content or boilerplate.

The field has two labels, a weight for each (label, line feature), and weights for starts and transitions. It is trained
here, on the driver, on lines of a bounded sample of labelled documents: lines of low-quality documents that look broken
(symbols glued to words, cell separators, shouting, repeats, rights notices) are boilerplate, lines of good documents are
content; a seed rule only proposes, the field generalises over neighbours. Viterbi decoding labels the lines of every
text, and the share of words in content lines decides retention.

Base rules of the contract stand beside it: word_chars, n_symbols, n_dup_lines, n_repeat_words.

Defined results: null and empty texts have no words and fail the base rules; lines without a word are not labelled;
without labelled rows the field falls back to its seed rule's weights. Rows are independent of each other.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import labelled_sample, map_batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
MIN_CONTENT_SHARE = 0.5
#: Bounds of the sample that the field is trained on: documents of each class, characters of a document (longer ones aren't used), lines.
PER_CLASS, LONGEST, MAX_LINES = {0: 600, 1: 600}, 6_000, 20_000
FEATURES = ("bias", "symbols", "bars", "shouting", "repeated", "short", "digits", "no_end", "bangs", "long_words", "rights", "plain")


def line_features(lines: list[str]) -> np.ndarray:
    """One row of FEATURES for each line."""
    seen = Counter(lines)
    out = np.zeros((len(lines), len(FEATURES)), np.float64)
    for k, s in enumerate(lines):
        n = len(s)
        sym = sum(map(s.count, SYMBOLS)) / n
        bars = s.count("|") / n
        up = s.isupper() and n > 12
        low = s.lower()
        words = s.count(" ") + 1
        out[k] = (
            1.0, min(1.0, 8 * sym), min(1.0, 20 * bars), up, seen[s] > 1, words < 3,
            min(1.0, 5 * sum(map(s.count, "0123456789")) / n), s.rstrip(BLANKS)[-1:] not in ".!?:;\"')", min(1.0, 10 * s.count("!") / n),
            n / words > 12, "rights reserved" in low or "licen" in low or "cookie" in low, sym == 0 and not up and words >= 5,
        )
    return out


def seed_labels(x: np.ndarray) -> np.ndarray:
    """1 (boilerplate) where a line of a low-quality document shows a fault."""
    f = {n: x[:, k] for k, n in enumerate(FEATURES)}
    return ((f["symbols"] > 0.3) | (f["bars"] > 0.3) | (f["shouting"] > 0) | (f["bangs"] > 0.5) | (f["repeated"] > 0) | (f["rights"] > 0)).astype(np.int64)


class Field:
    """Weights of a two-label chain: emission (features x 2), start (2), transition (2 x 2)."""

    def __init__(self, emission: np.ndarray, start: np.ndarray, trans: np.ndarray):
        self.emission, self.start, self.trans = emission, start, trans

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """Best labels of a sequence of lines."""
        e = x @ self.emission
        n = len(e)
        if not n:
            return np.zeros(0, np.int64)
        t00, t01, t10, t11 = self.trans.ravel().tolist()
        rows = e.tolist()
        a, b = rows[0][0] + self.start[0], rows[0][1] + self.start[1]
        back = []
        for u, v in rows[1:]:
            p, q = b + t10 > a + t00, b + t11 > a + t01
            back.append((p, q))
            a, b = (b + t10 if p else a + t00) + u, (b + t11 if q else a + t01) + v
        label = int(b > a)
        out = [label]
        for p, q in reversed(back):
            label = int(q if label else p)
            out.append(label)
        return np.array(out[::-1])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of the log likelihood of labels y, by forward and backward sums."""
        e = x @ self.emission
        n = len(e)
        f, g = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = self.start + e[0]
        for k in range(1, n):
            f[k] = np.logaddexp(f[k - 1, 0] + self.trans[0], f[k - 1, 1] + self.trans[1]) + e[k]
        for k in range(n - 2, -1, -1):
            nxt = self.trans + e[k + 1] + g[k + 1]
            g[k] = np.logaddexp(nxt[:, 0], nxt[:, 1])
        z = np.logaddexp(f[-1, 0], f[-1, 1])
        p = np.exp(f + g - z)
        own = np.eye(2)[y]
        dt = np.zeros((2, 2))
        if n > 1:
            pair = np.exp(f[:-1, :, None] + self.trans[None] + (e[1:] + g[1:])[:, None, :] - z)
            np.add.at(dt, (y[:-1], y[1:]), 1.0)
            dt -= pair.sum(0)
        return x.T @ (own - p), own[0] - p[0], dt


def seed_field() -> Field:
    e = np.zeros((len(FEATURES), 2))
    for name, w in (("bias", -1.5), ("symbols", 4.0), ("bars", 4.0), ("shouting", 3.0), ("repeated", 2.5), ("bangs", 3.0), ("rights", 2.0), ("plain", -2.0)):
        e[FEATURES.index(name), 1] = w
    return Field(e, np.zeros(2), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def worded_lines(text: str) -> list[str]:
    return [s for s in text.split("\n") if s.strip(BLANKS)]


def train_field(rows: list[tuple[int, str, int]], rounds: int = 25, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """rows: (doc_id, text, quality). Adagrad over documents as sequences."""
    data, total = [], 0
    for _, text, good in rows:
        lines = worded_lines(text)
        if lines and total + len(lines) <= MAX_LINES:
            x = line_features(lines)
            data.append((x, np.zeros(len(x), np.int64) if good else seed_labels(x)))
            total += len(x)
    field = seed_field()
    if not data:
        return field
    params = [field.emission, field.start, field.trans]
    past = [np.full(p.shape, 1e-6) for p in params]
    for k in range(rounds):
        grads = [np.zeros(p.shape) for p in params]
        lines = 0
        for x, y in data:
            for g, d in zip(grads, field.gradient(x, y), strict=True):
                g += d
            lines += len(x)
        for p, g, h in zip(params, grads, past, strict=True):
            g = g / lines - ridge * p
            h += g * g
            p += rate * g / np.sqrt(h)
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Field from at most PER_CLASS labelled documents of each quality, whole texts of up to LONGEST characters."""
    return train_field(labelled_sample(docs, labels, "quality", PER_CLASS, F.lit(True), "quality", LONGEST))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more in the text, the first occurrence included."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    total, upto = 0, 0
    for k, g in enumerate(grams):
        if seen[g] > 1:
            total += k + 3 - max(k, upto)
            upto = k + 3
    return total


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    blanks = sum(map(text.count, BLANKS))
    lines = worded_lines(text)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def content_share(field: Field, text: str) -> tuple[int, int, float]:
    """(lines with a word, boilerplate lines, share of words in content lines)."""
    lines = worded_lines(text)
    if not lines:
        return 0, 0, 0.0
    label = field.viterbi(line_features(lines))
    size = np.array([len(s.split()) or 1 for s in lines])
    return len(lines), int(label.sum()), float(size[label == 0].sum() / size.sum())


def judge_quality(docs: DataFrame, field: Field, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """doc_id, base columns, base_failed, n_lines, n_boilerplate, content_share, kept for each row, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(parts):
        f = shared.value
        for b in parts:
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                t = t or ""
                n, chars, sym, dup, rep = base_rules(t)
                lines, bad, share = content_share(f, t)
                failed = n < 50 or 100 * rep > 50 * n
                out.append((i, n, chars, sym, dup, rep, failed, lines, bad, share, not failed and share >= min_share))
            yield out

    return map_batches(
        docs.select("doc_id", "text"),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_boilerplate long, content_share double, kept boolean",
        run,
    )
