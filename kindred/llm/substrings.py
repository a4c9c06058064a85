"""Substring dedup with suffix automata of reference shards.

A window is `width` consecutive words. A window that occurs earlier (in a document of smaller id, or further up in the same one)
is removed, with all words it covers.

The reference is the corpus itself, but for what can't repeat: every window has an anchor, the first of its
`gram`-word sequences by hash. Equal windows have equal anchors, so a window whose anchor is met once in the corpus is unique. Consecutive windows of one anchor make a
run; the words of a run whose anchor repeats are a fragment. Equal fragments are merged before they are shuffled, the
earliest of them standing for all, so a passage that a third of all documents hold is one row a task. Fragments
go to reference shards by their anchor, and a shard holds about SHARD_WORDS words, however large the corpus. The anchors that
have more fragments than fit are dealt by whole windows instead.

A task builds the suffix automaton of its shard, in which every state knows where its words occur first, and streams the
fragments past it, but for those that are alone with their anchor. The matching statistic of a position, followed up to the state of its last `width` words, tells whether
the fragment's own window is the first of its kind. Those windows are kept, and all other windows of repeated
anchors are removed. A literal broadcast of all automata to all tasks would send a share of the corpus to each of them;
here an automaton meets exactly the fragments that share an anchor with its shard. For a reference of a proven size, such as a
benchmark, matching_spans() does broadcast its automata and streams documents past them.

Defined results: a null text has no words; texts of fewer words than a window are kept whole; a null doc_id comes after all
others, and rows with equal ids in the order of the table's files, so of repeated rows the first is kept; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, durable, few, map_batches, numbered, scanned, shuffles_removed

WIDTH = 20
#: Words of an anchor.
GRAM = 8
#: Words of a reference shard, about, and occurrences of an anchor from which it is dealt by windows.
SHARD_WORDS, HOT = 200_000, 2_000
#: Words of a reference whose automata are broadcast at most, and of one automaton.
BROADCAST_WORDS, AUTOMATON_WORDS = 2_000_000, 200_000
#: Window starts handled at once.
AT_ONCE = 65_536
#: Bits of a place for the position in a document.
PLACE = 40


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at exactly the six white-space characters of a word's pattern


def runs(words: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, first window) of each run of consecutive windows with one anchor occurrence; the last run ends with the text."""
    import xxhash

    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    g = np.zeros(len(words) - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    spread = width - gram + 1
    places = np.lib.stride_tricks.sliding_window_view(g, spread)
    at = np.concatenate([places[s : s + AT_ONCE].argmin(1) + np.arange(s, min(n, s + AT_ONCE)) for s in range(0, n, AT_ONCE)])
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[starts]].view(np.int64), starts


class Automaton:
    """The suffix automaton of many word sequences; `first` is the least place at which the words of a state end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 62]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.first.append(1 << 62)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of p's words and `word`: q itself, or a part split off from it."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def add(self, words, place: int) -> None:
        """A sequence whose first word ends at `place`."""
        last, first = 0, self.first
        for k, word in enumerate(words):
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            if place + k < first[last]:
                first[last] = place + k

    def close(self) -> None:
        """What ends somewhere with more words before it ends there with fewer as well."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.first[s] < self.first[p]:
                self.first[p] = self.first[s]

    def stream(self, words) -> Iterator[tuple[int, int]]:
        """(state, matching statistic) after each word: the longest run of words up to it that the reference has."""
        state = n = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state = self.next[state].get(word, 0)
            n = n + 1 if state else 0
            yield state, n

    def of_last(self, state: int, width: int) -> int:
        """The state of the last `width` words of a state that has as many."""
        while self.length[self.link[state]] >= width:
            state = self.link[state]
        return state


def first_windows(fragments: list[tuple[list[bytes], int]], width: int = WIDTH) -> list[int]:
    """For each (words, place of the first word): a bit for each window that no fragment has at an earlier place."""
    automaton = Automaton()
    for words, place in fragments:
        automaton.add(words, place)
    automaton.close()
    out = []
    for words, place in fragments:
        bits = 0
        for k, (state, n) in enumerate(automaton.stream(words)):
            if n >= width and automaton.first[automaton.of_last(state, width)] == place + k:
                bits |= 1 << (k - width + 1)
        out.append(bits)
    return out


def _anchored(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """rid, anchors, starts, n (words) of each document that has a window."""

    def run(parts):
        for b in parts:
            out = []
            for rid, text in zip(b["rid"], b["text"], strict=True):
                words = words_of(text)
                anchors, starts = runs(words, width, gram)
                if len(anchors):
                    out.append((rid, anchors.tolist(), starts.tolist(), len(words)))
            yield out

    return map_batches(rows.select("rid", "text"), "rid long, anchors array<long>, starts array<int>, n int", run, rows=256)


def _fragments(rows: DataFrame, width: int) -> DataFrame:
    """key (what it is dealt by), body, id, rid, start for each fragment, or window of a hot anchor, of rows (rid, doc_id, text, found)."""

    def run(parts):
        for b in parts:
            out = []
            for rid, doc_id, text, found in zip(b["rid"], b["doc_id"], b["text"], b["found"], strict=True):
                words = words_of(text)
                for f in found:
                    start, count = f["start"], f["count"]
                    if f["hot"]:
                        out += [(None, b" ".join(words[s : s + width]).decode(), doc_id, rid, s) for s in range(start, start + count)]
                    else:
                        out.append((f["anchor"], b" ".join(words[start : start + count + width - 1]).decode(), doc_id, rid, start))
            yield out

    return map_batches(rows.select("rid", "doc_id", "text", "found"), "anchor long, body string, id long, rid long, start int", run, rows=64)


def _kept_windows(shards: DataFrame, width: int) -> DataFrame:
    """rid, start, bits: the windows, from `start` on, that are the first of their kind; rows of a shard and, in it, an anchor stand together.

    A fragment that is alone with its anchor has no rivals, and neither has a window that was dealt as a whole.
    """

    def run(parts):
        key, held = None, []

        def flush():
            alone, rivals = [], []
            for _, same in groupby(held, key=lambda row: row[0]):
                same = list(same)
                (alone if len(same) == 1 or same[0][0] is None else rivals).extend(same)
            order = sorted({(i is None, i or 0, rid) for _, _, i, rid, _ in rivals})
            rank = {x: k << PLACE for k, x in enumerate(order)}
            own = [(body.encode().split(b" "), rank[(i is None, i or 0, rid)] + start) for _, body, i, rid, start in rivals]
            out = [(rid, start, bits) for (_, _, _, rid, start), bits in zip(rivals, first_windows(own, width), strict=True) if bits]
            return out + [(rid, start, (1 << (body.count(" ") + 2 - width)) - 1) for _, body, _, rid, start in alone]

        for b in parts:
            out = []
            for shard, *row in zip(b["shard"], b["anchor"], b["body"], b["id"], b["rid"], b["start"], strict=True):
                if shard != key:
                    if held:
                        out += flush()
                    key, held = shard, []
                held.append(row)
            yield out
        if held:
            yield flush()

    return map_batches(shards.select("shard", "anchor", "body", "id", "rid", "start"), "rid long, start int, bits long", run)


def removed_words(n: int, found: list[dict], kept: list[dict], width: int) -> list[tuple[int, int]]:
    """Maximal spans (first word, end) that removed windows cover: all windows of the runs `found` but those in `kept`."""
    gone = np.zeros(n + 1, np.int32)
    for f in found:
        gone[f["start"] : f["start"] + f["count"]] = 1
    for k in kept:
        bits, at = k["bits"], k["start"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            gone[at + low] = 0
            bits &= bits - 1
    starts = np.flatnonzero(gone)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width) + 1  # windows that touch make one span
    firsts, lasts = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    return list(zip(firsts.tolist(), (lasts + width).tolist()))


def _repeats(docs: DataFrame, width: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(rid, found: runs of repeated anchors; rid, kept: windows of them that occur first), durable, one row for a document."""
    spark = docs.sparkSession
    rows = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    marked = durable(_anchored(rows, width, gram), "substrings-anchors")
    counts = marked.select(F.explode("anchors").alias("c_anchor")).groupBy("c_anchor").agg(F.count("*").alias("n")).where("n > 1")
    counts = durable(counts.select("c_anchor", (F.col("n") > hot).alias("hot")), "substrings-repeated")
    ends = F.transform("starts", lambda s, i: F.coalesce(F.get("starts", i + 1), F.col("n") - (width - 1)) - s)
    each = marked.select("rid", F.explode(F.arrays_zip("anchors", "starts", ends.alias("counts"))).alias("r")).select("rid", "r.anchors", "r.starts", "r.counts")
    # Both sides come from files, so adaptive execution may split the rows of a hot anchor.
    met = each.join(counts, F.col("anchors") == F.col("c_anchor"))
    run = F.struct(F.col("starts").alias("start"), F.col("counts").alias("count"), F.col("anchors").alias("anchor"), "hot")
    found = durable(met.groupBy("rid").agg(F.collect_list(run).alias("found")), "substrings-found")  # as many as the document has
    discard(marked, counts)
    own = few(found.withColumnRenamed("rid", "f_rid"), 20_000)
    parts = _fragments(rows.join(own, F.col("rid") == F.col("f_rid")), width)
    # One row for each fragment: its earliest occurrence.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid", "start"))
    merged = parts.groupBy("anchor", "body").agg(first.alias("at")).select("anchor", "body", "at.id", "at.rid", "at.start")
    merged = durable(merged, "substrings-fragments")
    size = merged.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * SHARD_WORDS)))
    shard = F.pmod(F.when(F.col("anchor").isNull(), F.xxhash64("body")).otherwise(F.xxhash64("anchor")), F.lit(shards)).cast("int")
    dealt = merged.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", "anchor")
    kept = _kept_windows(dealt, width).groupBy("rid").agg(F.collect_list(F.struct("start", "bits")).alias("kept"))
    kept = durable(kept, "substrings-kept")
    discard(merged)
    return found, kept


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, spans (array of start, end: maximal runs of removed words), kept (the other words, joined by a blank); one row for each row of docs."""
    docs = scanned(docs)
    with shuffles_removed(docs.sparkSession):
        found, kept = _repeats(docs, width, gram, hot)
    told = found.select(F.col("rid").alias("f_rid"), F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["count"].alias("count"))).alias("found"))
    told = told.join(kept.withColumnRenamed("rid", "k_rid"), F.col("f_rid") == F.col("k_rid"), "left").drop("k_rid")
    rows = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    both = rows.join(told, F.col("rid") == F.col("f_rid"), "left")

    def run(parts):
        for b in parts:
            out = []
            for doc_id, text, found, kept in zip(b["doc_id"], b["text"], b["found"], b["kept"], strict=True):
                words = words_of(text)
                spans = removed_words(len(words), found or [], kept or [], width)
                left, at = [], 0
                for s, e in spans:
                    left += words[at:s]
                    at = e
                out.append((doc_id, len(words), [{"start": s, "end": e} for s, e in spans], b" ".join([*left, *words[at:]]).decode()))
            yield out

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(both.select("doc_id", "text", "found", "kept"), f"doc_id {id_type}, n_words long, spans array<struct<start:int,end:int>>, kept string", run, rows=64)


def matching_spans(docs: DataFrame, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, spans: maximal spans of words that `reference` (a column text) has as well, each match `width` words or longer.

    The automata of the reference's shards are broadcast, so it may have BROADCAST_WORDS words at most; documents are read once.
    """
    spark = docs.sparkSession
    total = reference.agg(F.sum(F.size(F.split(F.trim(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if total > BROADCAST_WORDS:
        raise ValueError(f"the reference has {total} words; automata of {BROADCAST_WORDS} at most are broadcast")
    shards, size = [[]], 0
    for t in reference.select("text").toArrow()["text"].to_pylist():
        words = words_of(t)
        if size and size + len(words) > AUTOMATON_WORDS:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    sent = spark.sparkContext.broadcast(shards)

    def run(parts):
        automata = []
        for s in sent.value:
            automata.append(Automaton())
            for words in s:
                automata[-1].add(words, 0)
        for b in parts:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int32)
                for a in automata:
                    for k, (_, n) in enumerate(a.stream(words)):
                        if n >= width:
                            edge[k - n + 1] += 1
                            edge[k + 1] -= 1
                inside = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])
                moves = np.diff(inside)
                out.append((doc_id, len(words), [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(moves > 0), np.flatnonzero(moves < 0))]))
            yield out

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, spans array<struct<start:int,end:int>>", run, rows=256)


def remove_repeats_sql(width: int = WIDTH) -> str:
    """The digest columns of remove_repeats() for documents, in DuckDB's SQL."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(generate_series(1, len(ws) - {width - 1})) AS i, ws FROM d WHERE len(ws) >= {width}),
        w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + {width - 1}], ' ') ORDER BY doc_id, i) > 1 AS again FROM s),
        p AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM d),
        m AS (SELECT p.doc_id, p.i, word, coalesce(max(CASE WHEN again THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS {width - 1} PRECEDING), 0) > 0 AS gone FROM p LEFT JOIN w ON p.doc_id = w.doc_id AND p.i = w.i)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS body FROM m GROUP BY doc_id) x ON d.doc_id = x.doc_id"""


__all__ = ["Automaton", "matching_spans", "remove_repeats", "remove_repeats_sql"]
