"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

One model of order ORDER for each language, fitted on a bounded sample: for each order a sorted array of n-gram hashes, and
beside it log probabilities and back-off weights. A text is reduced to lower-case letters and single blanks; all its
characters are looked up (binary search), and the language with the lowest cross-entropy per character wins. A language's
rejection limit is a high quantile of the cross-entropy of its own texts that were held back from the counts; `rejected`
marks texts beyond it. Where the models of all languages fit into JOINT_BYTES, each task merges them into one table with a
column for each language, so that a gram is looked up once for all; larger sets are looked up language by language, with
equal results. The model's size follows the sample's bound, CHARS_TOTAL characters however many languages there are.

Defined results: `und` with score 0 if a text is null or has no letter, or if no language was learned; rows with a null
lang or text teach nothing, and a language all of whose texts are longer than LONGEST characters isn't learned, so it is never predicted; a null doc_id counts as empty text for the split; repeated rows are scored alike, ties between
languages go to the first by name, and columns other than doc_id, text and lang are never read. Texts are scored whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import crc_mod, map_batches, py_crc_mod, unit_hash

ORDER = 5
#: Bounds of the fitting sample: characters for each language and for all, characters of one document (longer ones aren't used), held-back texts of a language.
CHARS_PER_LANG, CHARS_TOTAL, LONGEST, BACK_PER_LANG = 800_000, 16_000_000, 20_000, 1000
#: Above this size, models aren't merged into one table.
JOINT_BYTES = 256 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BLANK = 32
_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for everything that is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, BLANK, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def fold(text: str) -> np.ndarray:
    """Letters and single blanks, with a blank at either end; empty if there is no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.concatenate([[np.uint32(BLANK)], _fold_table()[codes], [np.uint32(BLANK)]])
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != BLANK) | (a[:-1] != BLANK)
    a = a[keep]
    return a if len(a) > 1 else a[:0]


def gram_hashes(a: np.ndarray, order: int) -> list[np.ndarray]:
    """[k - 1][i]: hash of the k characters that end at i; the first k - 1 places hold shorter grams and are not used."""
    x = a.astype(np.uint64) + np.uint64(1)
    out = [x * BASE]
    power = BASE
    for k in range(2, order + 1):
        power = np.uint64(int(power) * 0x100000001B3 % 2**64)
        h = out[-1].copy()
        if k <= len(x):
            h[k - 1 :] += x[: len(x) - k + 1] * power
        out.append(h)
    return [h ^ (h >> np.uint64(29)) for h in out]


def _at(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted array; any place for those that aren't there."""
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return at


def _table_logs(tables: list, unseen: np.ndarray, hs: list[np.ndarray], n: int) -> np.ndarray:
    """Log probability of every character but the first; shape (n - 1, columns of the tables)."""
    out = np.zeros((n - 1, len(unseen)), np.float32)
    todo = np.arange(1, n)
    for k in range(len(tables), 0, -1):
        if not len(todo):
            break
        keys, logp = tables[k - 1][:2]
        fits = todo >= k - 1
        now = todo[fits]
        h = hs[k - 1][now]
        at = _at(keys, h)
        hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        out[now[hit] - 1] += logp[at[hit]]
        miss = now[~hit]
        if k > 1 and len(miss):  # the weight of the context that didn't continue this way
            low, bow = tables[k - 2][0], tables[k - 2][2]
            h = hs[k - 2][miss - 1]
            at = _at(low, h)
            known = low[at] == h if len(low) else np.zeros(len(h), bool)
            out[miss[known] - 1] += bow[at[known]]
        todo = np.concatenate([todo[~fits], miss])
    if len(todo):
        out[todo - 1] += unseen
    return out


class Models:
    """A model for each language: for each order sorted hashes, log probabilities, back-off weights, and hashes of context and tail."""

    def __init__(self, langs: list[str], models: list[list[tuple[np.ndarray, ...]]], unseen: list[float], limits: np.ndarray, scale: float, joint_bytes: int = JOINT_BYTES):
        self.langs, self.models, self.unseen, self.limits, self.scale, self.joint_bytes = langs, models, unseen, limits, scale, joint_bytes
        self._tables: list | None = None

    def __getstate__(self):
        return self.langs, self.models, self.unseen, self.limits, self.scale, self.joint_bytes

    def __setstate__(self, s):
        self.__init__(*s)

    def _merge(self) -> list:
        """(tables, unseen) sets to look up: one for all languages, or one for each."""
        if self._tables is None:
            order = len(self.models[0]) if self.models else 0
            if sum(len(m[k][0]) for m in self.models for k in range(order)) * len(self.langs) * 8 > self.joint_bytes:
                self._tables = [([(t[0], t[1][:, None], t[2][:, None]) for t in m], np.array([u], np.float32)) for m, u in zip(self.models, self.unseen, strict=True)]
                return self._tables
            unseen = np.array(self.unseen, np.float32)
            tables: list = []
            for k in range(order):
                keys, first = np.unique(np.concatenate([m[k][0] for m in self.models]), return_index=True)
                ctx, tail = (np.concatenate([m[k][x] for m in self.models])[first] for x in (3, 4))
                logp, bow = np.full((len(keys), len(self.langs)), np.nan, np.float32), np.zeros((len(keys), len(self.langs)), np.float32)
                for j, m in enumerate(self.models):
                    at = np.searchsorted(keys, m[k][0])
                    logp[at, j], bow[at, j] = m[k][1], m[k][2]
                # Where a language lacks a gram that another has, its back-off value.
                back = unseen[None, :] if not k else tables[k - 1][2][_at(tables[k - 1][0], ctx)] + tables[k - 1][1][_at(tables[k - 1][0], tail)]
                tables.append((keys, np.where(np.isnan(logp), back, logp), bow))
            self._tables = [(tables, unseen)]
        return self._tables

    def char_logs(self, a: np.ndarray) -> np.ndarray:
        """Log probability of every character but the first, in each language; shape (len(a) - 1, languages)."""
        sets = self._merge()
        hs = gram_hashes(a, len(sets[0][0]))
        return np.concatenate([_table_logs(t, u, hs, len(a)) for t, u in sets], axis=1)

    def entropies(self, texts: list[str | None], chunk: int = 200_000) -> list[np.ndarray | None]:
        """Cross-entropy per character in each language; None for a text without letters."""
        out: list[np.ndarray | None] = []
        for t in texts:
            a = fold(t) if t else np.zeros(0, np.uint32)
            if not len(a):
                out.append(None)
                continue
            total = np.zeros(len(self.langs))
            for at in range(0, len(a) - 1, chunk):
                lead = min(at, ORDER)
                total += self.char_logs(a[at - lead : at + chunk + 1])[lead:].sum(0, dtype=np.float64)
            out.append(-total / (len(a) - 1))
        return out

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """(language or und, score, cross-entropy, rejected)."""
        e = self.entropies([text])[0] if self.langs else None
        if e is None:
            return "und", 0.0, None, True
        best = int(e.argmin())
        p = np.exp((e.min() - e) * self.scale)
        return self.langs[best], float(p[best] / p.sum()), float(e[best]), bool(e[best] > self.limits[best])


def _lang_model(arrays: list[np.ndarray], order: int):
    """(tables, unseen): interpolated Kneser-Ney of one language; a table for each order, as Models has them."""
    hs = [[] for _ in range(order)]
    for a in arrays:
        for k, h in enumerate(gram_hashes(a, order)):
            hs[k].append((h, a))
    grams = []  # per order: hash, context hash, hash without the first character, count
    for k in range(1, order + 1):
        full, ctx, tail = [], [], []
        for i, a in enumerate(arrays):
            if len(a) >= k + (k == 1):
                at = np.arange(max(k - 1, 1), len(a))
                full.append(hs[k - 1][i][0][at])
                ctx.append(hs[k - 2][i][0][at - 1] if k > 1 else np.zeros(len(at), np.uint64))
                tail.append(hs[k - 2][i][0][at] if k > 1 else np.zeros(len(at), np.uint64))
        f = np.concatenate(full) if full else np.zeros(0, np.uint64)
        keys, first, count = np.unique(f, return_index=True, return_counts=True)
        c = np.concatenate(ctx)[first] if full else f
        t = np.concatenate(tail)[first] if full else f
        grams.append([keys, c, t, count.astype(np.float64)])
    # Below the highest order, counts are continuation counts: how many characters stand before the gram.
    for k in range(order - 1, 0, -1):
        keys, _, _, count = grams[k - 1]
        tails, n = np.unique(grams[k][2], return_counts=True)
        at = np.searchsorted(tails, keys)
        at[at == len(tails)] = 0
        same = tails[at] == keys if len(tails) else np.zeros(len(keys), bool)
        grams[k - 1][3] = np.where(same, n[at] if len(tails) else 0, 1).astype(np.float64)
    found = []
    vocab = max(1, len(grams[0][0]))
    unseen = float(np.log(1e-6))
    lower_keys, lower_p = np.zeros(0, np.uint64), np.zeros(0)
    for k in range(1, order + 1):
        keys, ctx, tail, count = grams[k - 1]
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = min(max(d, 0.1), 0.9)
        contexts, inv = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(inv, count), np.bincount(inv)
        gamma = d * kinds / total
        if k == 1:
            low = np.full(len(keys), 1.0 / (vocab + 1))
            unseen = float(np.log(gamma[0] / (vocab + 1))) if len(gamma) else unseen
        else:
            low = lower_p[_at(lower_keys, tail)] if len(tail) else np.zeros(0)
        p = (count - d) / total[inv] + gamma[inv] * low
        found.append((keys, np.log(p), contexts, np.log(gamma), ctx, tail))
        lower_keys, lower_p = keys, p
    tables = []
    for k, (keys, logp, _, _, ctx, tail) in enumerate(found):
        contexts, gamma = (found[k + 1][2], found[k + 1][3]) if k + 1 < order else (np.zeros(0, np.uint64), np.zeros(0))
        own = np.union1d(keys, contexts)  # the blank at the start is a context only
        at, place = np.searchsorted(own, keys), np.searchsorted(own, contexts)
        table = [np.full(len(own), unseen, np.float32), np.zeros(len(own), np.float32), np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)]
        table[0][at], table[2][at], table[3][at] = logp, ctx, tail
        table[1][place] = gamma
        tables.append((own, *table))
    return tables, unseen


def fit(rows: list[tuple[int, str, str]], order: int = ORDER) -> Models:
    """rows: (doc_id, text, lang). A fifth of them is held back from the counts, for limits and scale."""
    by: dict[str, list[np.ndarray]] = {}
    back: dict[str, list[str]] = {}
    for i, text, lang in sorted(rows, key=lambda r: (r[2], str(r[0]), r[1])):
        a = fold(text)
        if not len(a):
            continue
        if py_crc_mod(i, 25) // 5 == 4 and by.get(lang):
            back.setdefault(lang, []).append(text)
        else:
            by.setdefault(lang, []).append(a)
    langs = sorted(by)
    if not langs:
        return Models([], [], [], np.zeros(0), 1.0)
    each = [_lang_model(by[x], order) for x in langs]
    models = Models(langs, [m for m, _ in each], [u for _, u in each], np.full(len(langs), np.inf), 1.0)
    _calibrate(models, back)
    return models


def _calibrate(models: Models, back: dict[str, list[str]]) -> None:
    """Limits and scale from the texts held back: of each language at most BACK_PER_LANG, evenly spread over its ids."""
    gaps = []
    for k, lang in enumerate(models.langs):
        own = []
        texts = back.get(lang, [])
        for text in texts[:: max(1, -(-len(texts) // BACK_PER_LANG))]:
            e = models.entropies([text])[0]
            own.append(float(e[k]))
            if len(e) > 1:
                two = np.partition(e, 1)[:2]
                gaps.append(two[1] - two[0])
        if len(own) >= 20:
            models.limits[k] = float(np.quantile(own, 0.995)) + 0.25
    models.scale = float(6.0 / max(np.median(gaps), 1e-3)) if gaps else 10.0


def train(docs: DataFrame) -> Models:
    """Fit on rows with a lang whose crc32(doc_id) mod 5 is not 0, sampled by hash within the bounds above."""
    text = F.col("text").cast("string")
    size = F.length(text)
    usable = docs.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & (size <= LONGEST)).select("doc_id", "lang", text.alias("text"), size.alias("size"))
    sums = usable.groupBy("lang").agg(F.sum("size").alias("n")).collect()  # a row for each language
    most = min(CHARS_PER_LANG, CHARS_TOTAL // max(1, len(sums)))
    large = {r["lang"]: most / r["n"] for r in sums if r["n"] > most}
    rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in large.items() for x in kv]), F.col("lang")), F.lit(1.0)) if large else F.lit(1.0)
    some = usable.where(unit_hash(F.col("doc_id"), "langid") < rate).select("doc_id", "text", "lang").distinct().toArrow().to_pydict()
    return fit(list(zip(some["doc_id"], some["text"], some["lang"])))


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for each row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the fitting sample

    def run(parts):
        m = shared.value
        for b in parts:
            yield [(i, py_crc_mod(i, 5) == 0, *m.predict(t)) for i, t in zip(b["doc_id"], b["text"], strict=True)]

    return map_batches(docs.select("doc_id", "text"), "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean", run)
