"""Language-model scoring by subword lattice likelihood.

The pieces and their order come from a published subword vocabulary. A piece weighs its share in the training corpus, as
the vocabulary's own tokenizer cuts it, smoothed with the vocabulary's scores (its ranks, as a Zipf law). The probability
of a word is the sum over all its segmentations, by forward recursion in log space; a text is its words and one end.

All corpus statistics come from one table of distinct words over all documents. The most frequent words,
never more than DICTIONARY, are broadcast; all other occurrences join the table by word.

Defined results: null counts as empty; an empty text has its end token alone; a null doc_id counts as empty text for the
split; without training documents every count is 0, and weights are the vocabulary's scores.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import crc_mod, durable, map_batches, most_frequent, py_crc_mod, scanned

DICTIONARY = 300_000
PRIOR_TOKENS = 10_000.0
SPACE = "▁"


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class Lattice:
    """Log weights of pieces and the forward recursion over all segmentations."""

    def __init__(self, weights: dict[str, float], byte_weights: list[float]):
        self.w, self.bytes = weights, byte_weights
        self.longest = max(map(len, weights), default=1)

    def log_marginal(self, word: str) -> float:
        s = SPACE + word
        n, w = len(s), self.w
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                v = w.get(s[i:j])
                if v is not None:
                    x, y = a + v, alpha[j]
                    if y is None:
                        alpha[j] = x
                    else:
                        alpha[j] = x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))
            if s[i] not in w:  # spelled in bytes
                x = a + sum(self.bytes[b] for b in s[i].encode())
                y = alpha[i + 1]
                alpha[i + 1] = x if y is None else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return alpha[n]


def build_lattice(model: bytes, counts: dict[int, float], ends: float) -> tuple[Lattice, float]:
    """(lattice, log weight of the end) from counts of piece ids in the training corpus."""
    sp = _processor(model)
    size = sp.get_piece_size()
    zipf = np.zeros(size)
    usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    for i in usable:
        zipf[i] = 1.0 / (3.0 + abs(sp.get_score(i)))
    zipf /= zipf.sum()
    share = PRIOR_TOKENS * zipf
    for i, n in counts.items():
        if zipf[i] > 0:
            share[i] += n
    total = share.sum() + ends + 1.0
    weights, by_byte = {}, [math.log(1e-9)] * 256
    for i in usable:
        lw, piece = math.log(share[i] / total), sp.id_to_piece(i)
        if sp.is_byte(i):
            by_byte[int(piece[3:5], 16)] = lw
        else:
            weights[piece] = lw
    return Lattice(weights, by_byte), math.log((ends + 1.0) / total)


def count_words(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """word, c (in training documents), n (in all) over every text."""

    def run(parts):
        both = (Counter(), Counter())
        for b in parts:
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                both[py_crc_mod(i, 7) == 2].update((t or "").encode().lower().split())
            if len(both[0]) + len(both[1]) > flush:
                yield _rows(both)
                both = (Counter(), Counter())
        yield _rows(both)

    def _rows(both):
        train, held = both
        return [(w, c, c + held.get(w, 0)) for w, c in train.items()] + [(w, 0, n) for w, n in held.items() if w not in train]

    part = map_batches(docs.select("doc_id", "text"), "word binary, c long, n long", run)
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def score_texts(docs: DataFrame, model: bytes, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    docs, spark = scanned(docs), docs.sparkSession
    words = durable(count_words(docs), "lm-words")
    ends = docs.where(crc_mod(F.col("doc_id"), 7) != 2).count()
    told = words.agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n_train = (told["c"] or 0) + ends
    distinct = (told["v"] or 0) + (1 if ends else 0)
    vocab = spark.sparkContext.broadcast(model)  # the vocabulary file, of fixed size

    def piece_counts(parts):
        sp = _processor(vocab.value)
        total: Counter = Counter()
        for b in parts:
            for ids, c in zip(sp.encode([w.decode() for w in b["word"]]), b["c"], strict=True):
                for i in ids:
                    total[i] += c
        yield list(total.items())

    pieces = map_batches(words.where("c > 0").select("word", "c"), "piece int, k double", piece_counts)
    counts = {r[0]: r[1] for r in pieces.groupBy("piece").agg(F.sum("k")).collect()}  # no more rows than pieces
    lattice, log_end = build_lattice(model, counts, float(ends))
    shared = spark.sparkContext.broadcast((lattice.w, lattice.bytes))

    def marginals(parts):
        net = Lattice(*shared.value)
        for b in parts:
            yield [(w, c, n, net.log_marginal(w.decode())) for w, c, n in zip(b["word"], b["c"], b["n"], strict=True)]

    lexicon = durable(map_batches(words, "word binary, c long, n long, lp double", marginals), "lm-lexicon")
    often = most_frequent(lexicon, "n", dictionary)
    # At most `dictionary` rows; as an Arrow table they take a few bytes each on the driver.
    top = spark.sparkContext.broadcast(lexicon.where(often).select("word", "c", "lp").toArrow())

    def partial(parts):
        """A head row for each document with its frequent words, and a row for each of its other distinct words."""
        names, c, lp = top.value.column("word").to_pylist(), top.value.column("c").to_numpy(), top.value.column("lp").to_numpy()
        at = {w: k for k, w in enumerate(names)}
        logc = np.append(np.log10(c + 1.0), 0.0)
        has = np.append(c > 0, False)
        lps = np.append(lp, 0.0)
        none = len(names)
        for b in parts:
            out = []
            for rid, i, t in zip(b["rid"], b["doc_id"], b["text"], strict=True):
                ws = (t or "").encode().lower().split()
                k = np.fromiter((at.get(w, none) for w in ws), np.int64, len(ws))
                rare = Counter(ws[x] for x in np.flatnonzero(k == none).tolist())
                # A blank is in no word, so heads have keys of their own and spread evenly.
                out.append((b" %d" % rid, rid, i, len(ws), 1, int(has[k].sum()), float(logc[k].sum()), float(lps[k].sum())))
                out += [(w, rid, None, 0, n, 0, 0.0, 0.0) for w, n in rare.items()]
            yield out

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    dealt = map_batches(rows, "word binary, rid long, doc_id long, n_words long, k long, known long, logc double, lp double", partial, rows=512)
    rest = lexicon.where(~often).select(F.col("word").alias("l_word"), F.col("c").alias("l_c"), F.col("lp").alias("l_lp"))
    met = dealt.join(rest, F.col("word") == F.col("l_word"), "left").select(
        "rid", "doc_id", "n_words",
        (F.col("known") + F.coalesce(F.when(F.col("l_c") > 0, F.col("k")), F.lit(0))).alias("known"),
        (F.col("logc") + F.coalesce(F.col("k") * F.log10(F.col("l_c") + 1.0), F.lit(0.0))).alias("logc"),
        (F.col("lp") + F.coalesce(F.col("k") * F.col("l_lp"), F.lit(0.0))).alias("lp"),
    )
    end_logc, unit = math.log10(ends + 1.0), math.log10(n_train + distinct + 1.0)
    by = met.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n"), F.sum("known").alias("known"), F.sum("logc").alias("logc"), F.sum("lp").alias("lp"))
    return by.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logc") + end_logc - (F.col("n") + 1) * F.lit(unit)).alias("base_score"),
        ((F.col("lp") + F.lit(log_end)) / math.log(10)).alias("score"),
    )
