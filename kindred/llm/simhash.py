"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at three or fewer differing bits. Split into two halves of 32 bits, a linked pair
differs in at most one bit of one half. The anchors of a half are the code words of the binary Hamming code of length 31
(2^26 words, covering radius 1); the 32nd bit of a half takes no part. Each distinct fingerprint is replicated to every
anchor within covering radius plus threshold (1 + 1 bits) of each half: the nearest, and the 15 at distance two if it is
no code word itself. Two halves that differ in at most one bit share their nearest anchor, or one has the other's nearest
within reach, so every linked pair meets at an anchor, and fingerprints are compared there, all 64 bits of them.

Only distinct fingerprints take part, so copies cost nothing. An anchor with more than BLOCK fingerprints is cut into
blocks, and pairs of blocks are compared in tasks of their own: nothing is capped, and no task holds more than two
blocks. A task returns a spanning forest of its links, not the links. Components come from alternating large and small
stars over that forest, with a durable table for each round.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like any other;
repeated rows share a component. The smallest doc_id of a component names it; null ids come out with their component.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import BROADCAST_ROWS, batches_of, discard, durable, few, map_batches, most_frequent, numbered, released, scanned, shuffles_removed, without

SHINGLE = 3
THRESHOLD = 3
SEED = 42
BLOCK = 2048


def fingerprint_of(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, k, 65_536):
        upto = min(k, at + 65_536)
        spans = zip(starts[at:upto].tolist(), ends[min(at + width, len(words)) - 1 : min(upto + width - 1, len(words))].tolist())
        h = np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, upto - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > k).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for each row of docs."""

    def run(parts):
        for b in parts:
            fp = np.array([fingerprint_of(t, width) for t in b["text"]], np.uint64).view(np.int64).tolist()
            yield list(zip(b["doc_id"], fp, strict=True))

    return map_batches(docs.select("doc_id", "text"), "doc_id long, fp long", run)


def _parity_table() -> np.ndarray:
    """syndrome[b, v]: the syndrome that byte v at byte b of a half contributes; bit k of 31 has syndrome k + 1."""
    table = np.zeros((4, 256), np.uint8)
    for b in range(4):
        for v in range(256):
            s = 0
            for k in range(8):
                if v >> k & 1 and 8 * b + k < 31:
                    s ^= 8 * b + k + 1
            table[b, v] = s
    return table


_SYNDROME = _parity_table()


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest code word, the 15 others within two bits or the nearest again) of 31-bit points; shapes (n,), (n, 15)."""
    half = half & np.uint64(0x7FFFFFFF)
    by = half.astype("<u4").view(np.uint8).reshape(-1, 4)
    s = _SYNDROME[0, by[:, 0]] ^ _SYNDROME[1, by[:, 1]] ^ _SYNDROME[2, by[:, 2]] ^ _SYNDROME[3, by[:, 3]]
    bit = np.where(s > 0, np.uint64(1) << np.maximum(s.astype(np.int64) - 1, 0).astype(np.uint64), np.uint64(0))
    nearest = half ^ bit
    # Flipping bits i and j gives a code word exactly if their syndromes add up to s: j = i ^ s.
    i = np.arange(1, 32, dtype=np.int64)[None, :]
    j = i ^ s.astype(np.int64)[:, None]
    pairs = (j > i) & (s > 0)[:, None]
    flip = (np.uint64(1) << (i - 1).astype(np.uint64)) ^ (np.uint64(1) << np.clip(j - 1, 0, 31).astype(np.uint64))
    far = np.repeat(nearest[:, None], 15, axis=1)
    rows, cols = np.nonzero(pairs)
    if len(rows):
        rank = (np.cumsum(pairs, axis=1) - 1)[rows, cols]
        far[rows, rank] = half[rows] ^ flip[rows, cols]
    return nearest, far


def replicate(nodes: DataFrame, fps: Sequence[str]) -> DataFrame:
    """anchor, node, fp, home: each node at every anchor of both halves of each of its fingerprints within reach."""
    out = pa.schema([("anchor", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                own = np.array(b.column(0)[at : at + 8192].to_numpy(zero_copy_only=False), np.int64)
                for k in range(len(fps)):
                    fp = np.array(b.column(k + 1)[at : at + 8192].to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                    for side in (0, 1):
                        near, far = anchors(fp >> np.uint64(32 * side))
                        tag = np.uint64(2 * k + side) << np.uint64(32)
                        rows, cols = np.nonzero(far != near[:, None])
                        a = np.concatenate([near, far[rows, cols]]) | tag
                        home = np.concatenate([np.ones(len(fp), bool), np.zeros(len(rows), bool)])
                        columns = [a.view(np.int64), np.concatenate([own, own[rows]]), np.concatenate([fp, fp[rows]]).view(np.int64), home]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out)

    return nodes.select("node", *fps).mapInArrow(run, "anchor long, node long, fp long, home boolean")


def close_pairs(fp: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, marks: np.ndarray | None, similar: float) -> np.ndarray:
    """close[x, y]: whether rows left[x] and right[y] link; marks: their sketches, which have to agree as well."""
    close = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(left), 256):
        l = left[at : at + 256]
        near = np.bitwise_count(fp[l][:, None] ^ fp[right][None, :]) <= THRESHOLD
        close[at : at + 256] = near & (home[l][:, None] | home[right][None, :])
    if marks is not None:
        xs, ys = np.nonzero(close)
        for at in range(0, len(xs), 16_384):
            x, y = xs[at : at + 16_384], ys[at : at + 16_384]
            close[x, y] = sketch_similarity(marks[left[x]], marks[right[y]]) >= similar
    return close


def stars(close: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(n, dtype=np.int32)
    none = np.int32(n)
    while True:
        new = label.copy()
        seen = np.full(len(right), none)
        for at in range(0, len(left), 256):
            c = close[at : at + 256]
            l = left[at : at + 256]
            new[l] = np.minimum(new[l], np.where(c, label[right][None, :], none).min(1, initial=none))
            seen = np.minimum(seen, np.where(c, label[l][:, None], none).min(0, initial=none))
        new[right] = np.minimum(new[right], seen)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _grouped(dealt: DataFrame, schema: str, work) -> DataFrame:
    """work(node, fp, home, part, i, j, marks) for each (anchor, i, j), whose rows stand together; marks may be None."""
    with_marks = "sketch" in dealt.columns

    def run(parts_in):
        key, rows = None, []

        def flush():
            node, f, h, p, m = zip(*rows)
            marks = np.frombuffer(b"".join(m), np.uint16).reshape(len(rows), -1) if with_marks else None
            return work(key, np.array(node, np.int64), np.array(f, np.int64).view(np.uint64), np.array(h), np.array(p), marks)

        for b in parts_in:
            out = []
            marks = b["sketch"] if with_marks else [b""] * len(b["fp"])
            for a, i, j, *row in zip(b["anchor"], b["i"], b["j"], b["node"], b["fp"], b["home"], b["part"], marks, strict=True):
                if key != (a, i, j):
                    if len(rows) > 1:
                        out += flush()
                    key, rows = (a, i, j), []
                rows.append(row)
            yield out
        if len(rows) > 1:
            yield flush()

    return map_batches(dealt.sortWithinPartitions("anchor", "i", "j", "node"), schema, run, rows=16_384)


def links(nodes: DataFrame, fps: Sequence[str] = ("fp",), sketches: DataFrame | None = None, similar: float = 0.0, block: int = BLOCK) -> DataFrame:
    """u, v: nodes whose chains are all chains of linked nodes; durable.

    Two nodes link where one of their fingerprints differs in three bits or fewer and, with `sketches` (node, sketch), the
    estimated similarity is `similar` or more. Sketches join only the rows that have a partner by fingerprint.
    """
    placed = durable(replicate(nodes, fps), "simhash-anchors")
    counts = placed.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    counts = durable(counts.select(F.col("anchor").alias("c_anchor"), "n"), "simhash-counts")
    sized = placed.join(counts, F.col("anchor") == F.col("c_anchor")).select("anchor", "node", "fp", "home", "n")
    small = sized.where(F.col("n") <= block).select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"), "node", "fp", "home")
    parts = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    # Each row of a large anchor goes to the block pairs that hold its block: (part, other) for every other block.
    large = (
        sized.where(F.col("n") > block)
        .select("anchor", "node", "fp", "home", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("anchor", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "fp", "home")
    )
    dealt = small.unionByName(large).repartition("anchor", "i", "j")

    def both(key, p):
        return np.flatnonzero(p == key[1]), np.flatnonzero(p == key[2])

    def partners(key, node, fp, home, p, marks):
        left, right = both(key, p)
        close = close_pairs(fp, home, left, right, None, 0.0)
        if key[1] == key[2]:
            np.fill_diagonal(close, False)
        keep = np.union1d(left[close.any(1)], right[close.any(0)])
        return [(*key, int(p[k]), int(node[k]), int(fp[k : k + 1].view(np.int64)[0]), bool(home[k])) for k in keep]

    def linked(key, node, fp, home, p, marks):
        left, right = both(key, p)
        close = close_pairs(fp, home, left, right, marks, similar)
        label = stars(close, len(node), left, right)
        if marks is not None:  # pairs to be confirmed: also the smallest partner itself
            direct = np.arange(len(node))
            none = len(node)
            np.minimum.at(direct, left, np.where(close, right[None, :], none).min(1, initial=none))
            np.minimum.at(direct, right, np.where(close, left[:, None], none).min(0, initial=none))
            label = np.concatenate([label, direct])
            node = np.concatenate([node, node])
        moved = np.flatnonzero(label != np.arange(len(node)))
        return list(zip(node[moved].tolist(), node[label[moved]].tolist()))

    met = None
    if sketches is not None:
        met = durable(_grouped(dealt, "anchor long, i int, j int, part int, node long, fp long, home boolean", partners), "simhash-partners")
        own = sketches.select(F.col("node").alias("s_node"), "sketch")
        dealt = met.join(own, F.col("node") == F.col("s_node")).drop("s_node").repartition("anchor", "i", "j")
    out = durable(_grouped(dealt, "u long, v long", linked).where("u <> v").distinct(), "simhash-links")
    for d in (placed, counts, met):
        discard(d)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, by alternating large and small stars until nothing changes."""
    now = durable(edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi <> lo").distinct(), "stars-0")

    def smallest(e: DataFrame) -> DataFrame:
        return durable(e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("c"), F.least("a", "b").alias("m")), "stars-min")

    before, k = None, 0
    while True:  # stars only ever move nodes to smaller ones, so this ends
        k += 1
        both = now.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(now.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        m = smallest(both)
        large = both.join(m, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.distinct(), "stars-large")
        m2 = durable(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c"), "stars-min")
        j = large.join(m2, F.col("a") == F.col("c"))
        small = j.select(F.greatest("b", "m").alias("hi"), F.least("b", "m").alias("lo")).where("hi <> lo").unionByName(m2.select(F.col("c").alias("hi"), F.col("m").alias("lo")))
        after = durable(small.distinct(), f"stars-{k}")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        for old in (now, m, large, m2):
            discard(old)
        now = after
        if mark == before:
            break
        before = mark
    out = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out._kindred_path = now._kindred_path  # for discard()
    return out


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links), for each row of docs."""
    marked = durable(fingerprints(docs, width), "simhash-fp")
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = links(distinct.select(F.col("fp").alias("node"), "fp"))
    comp = components(edges)
    rooted = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = durable(rooted, "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "g_root")
    by_fp = durable(rooted.join(named, F.col("root") == F.col("g_root")).select(F.col("fp").alias("g_fp"), "component_id"), "simhash-named")
    for d in (distinct, edges, comp, rooted):
        discard(d)
    return marked.join(by_fp, F.col("fp") == F.col("g_fp")).select("doc_id", "fp", "component_id")


# --- similar texts: candidates by the same covering, over fingerprints of distinct words, and by shared shingles; exact similarity

SIMILAR, LOOSE, WORDS_IN_SHINGLE, BINS, SEEDS = 0.8, 0.65, 5, 256, (1, 2, 3)
#: Bound of the list of hot shingles.
HOT = 50_000
#: A prefix is longer than it has to be by this share of its set and SPARE shingles, and as many more have to be shared.
LONGER, SPARE = 0.02, 2
#: Sets of so many shingles have their counts in more bins.
LONG_SET = 1500
#: Texts, sets or pairs of sets in one Arrow batch.
SETS = 256
#: A shingle in the prefixes of more nodes makes a crowd, whose sets are compared in one place instead of pair by pair.
CROWD = 16
#: Rows and shingles of half a crowd's task, and of an Arrow batch of its sets.
CROWD_ROWS, CROWD_SHINGLES, CROWD_SETS = 512, 250_000, 32
#: Pairs that are joined to their sketches, or to their sets, at once.
SKETCHED_AT_ONCE, SETS_AT_ONCE = 2_000_000, 200_000


def word_fingerprint(words: list[bytes], seed: int) -> int:
    """SimHash of the distinct words: near copies stay within a few bits, and other texts far away."""
    import xxhash

    if not words:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    total = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > len(words)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def shingle_set(words: list[bytes], width: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - width + 1)
    spans = zip(starts[:k].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in spans), np.uint64, k))


def sketch_of(h: np.ndarray) -> bytes:
    """One-permutation min-hash of a shingle set: 16 bits of the smallest hash of each of BINS bins, 0 for none."""
    out = np.zeros(BINS, np.uint16)
    bins, first = np.unique(h >> np.uint64(56), return_index=True)  # the smallest of each bin, since h is sorted
    out[bins.astype(np.int64)] = ((h[first] >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out.tobytes()


def bin_counts(h: np.ndarray) -> bytes:
    """How many shingles of a set fall into each bin of hashes: 256 bins, or 2048 for a long text."""
    bits = 8 if len(h) < LONG_SET else 11
    return np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).clip(max=65_535).astype("<u2").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only, from their bin counts."""
    x, y = (np.frombuffer(c, "<u2").astype(np.int64) for c in (a, b))
    if len(x) != len(y):
        x, y = (c.reshape(256, -1).sum(1) for c in (x, y))
    return int(np.abs(x - y).sum())


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches; two empty ones are equal."""
    same = (a == b) & (a != 0)
    either = (a != 0) | (b != 0)
    n = either.sum(1)
    return np.where(n == 0, 1.0, same.sum(1) / np.maximum(n, 1))


def prefix_of(h: np.ndarray, hot: np.ndarray, similar: float) -> np.ndarray:
    """The first shingles of a set, by hash and hot ones last: two sets at `similar` or more share some of theirs.

    Such a pair shares at least similar * n of the n shingles of either, so n - similar * n + k of each hold k shared ones;
    k is n's share LONGER and SPARE, and 1 at least. The pair shares the smaller k of the two: see `sharing`.
    """
    if len(hot) and len(h):
        is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        h = np.concatenate([h[~is_hot], h[is_hot]])
    least = int(np.ceil(similar * len(h) - 1e-9))
    return h[: len(h) - least + max(1, min(least, 1 + SPARE + int(LONGER * len(h))))]


def hot_shingles(rows: DataFrame, similar: float = SIMILAR) -> np.ndarray:
    """The shingles that stand in the prefixes of most texts, at most HOT of them, counted over the prefixes of all rows.

    Prefixes by hash alone, which is where a shingle would make a group. Any list gives the same links; this one, short groups.
    """
    none = np.zeros(0, np.uint64)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SETS):
                found = [prefix_of(shingle_set((t or "").encode().lower().split()), none, similar) for t in b.column("text").slice(at, SETS).to_pylist()]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "m"])

    with batches_of(rows.sparkSession, SETS):
        counts = rows.select("text").mapInArrow(run, "h long, m long").groupBy("h").agg(F.sum("m").alias("n")).where("n > 3")
        counts = durable(counts, "similar-hot")
    found = counts.where(most_frequent(counts, "n", HOT)).select("h").toArrow()["h"].to_numpy()
    discard(counts)
    return np.sort(np.array(found, np.int64).view(np.uint64))


def in_slices(pairs: DataFrame, at_once: int, label: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(pairs), durable, for about `at_once` pairs u, v at a time: what is joined to them never stands on disk for all."""
    k = max(1, -(-pairs.count() // at_once))
    if k == 1:
        return durable(work(pairs), label)
    slice_of = F.pmod(F.xxhash64(F.lit("slice"), "u", "v"), F.lit(k))
    done = [durable(work(pairs.where(slice_of == i)), label) for i in range(k)]
    out = durable(reduce(DataFrame.unionByName, done), label)
    for d in done:
        discard(d)
    return out


def keyed(marked: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """node, size, root, need, key: a row for each shingle of the prefixes; need: how many of them a similar set shares.

    roots: node, root; a node that isn't in it is its own root.
    """
    lacking = F.col("size") - F.ceil(F.lit(similar) * F.col("size") - F.lit(1e-9))
    need = (F.size("prefix") - lacking).cast("int").alias("need")
    met = marked.join(few(roots), F.col("rid") == F.col("node"), "left")
    return met.select(F.col("rid").alias("node"), "size", F.coalesce("root", "rid").alias("root"), need, F.explode("prefix").alias("key"))


def shared_keys(own: DataFrame) -> DataFrame:
    """c_key, n: the shingles of `keyed` in the prefixes of n nodes with unequal roots; durable."""
    counts = own.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return durable(counts.select(F.col("key").alias("c_key"), "n"), "similar-keys")


def symmetric_differences(sets: list[np.ndarray]) -> np.ndarray:
    """d[x, y]: how many shingles are in one of the sets x and y only.

    A shingle of most sets stands for those that lack it, so copies with a few changes have few entries each, and only
    entries that meet in a shingle are counted. Shingles of a single set meet nothing.
    """
    n = len(sets)
    size = np.array([len(h) for h in sets], np.int64)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    usual = 2 * often > n
    has = np.zeros((n, int(usual.sum())), bool)
    place = np.cumsum(usual) - 1
    mine = usual[column]
    has[owner[mine], place[column[mine]]] = True
    apart = size + has.shape[1] - 2 * has.sum(1)  # entries of each set
    lacks, at = np.nonzero(~has)
    other = ~mine & (often[column] > 1)
    column, owner = np.concatenate([column[other], at + len(often)]), np.concatenate([owner[other], lacks])
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
    length = np.diff(np.r_[starts, len(column)])
    both = np.zeros(n * n, np.int32)
    for m in np.unique(length[(length > 1) & (length <= 32)]).tolist():
        first = starts[length == m]
        for k in range(0, len(first), 1 + 250_000 // m**2):
            rows = owner[first[k : k + 1 + 250_000 // m**2, None] + np.arange(m)]
            np.add.at(both, (rows[:, :, None] * n + rows[:, None, :]).ravel(), 1)
    both = both.reshape(n, n)
    for s, m in zip(starts[length > 32].tolist(), length[length > 32].tolist()):
        rows = owner[s : s + m]
        both[rows[:, None], rows[None, :]] += 1
    apart = apart.astype(np.int32)
    both *= -2
    both += apart[:, None]
    both += apart[None, :]
    np.fill_diagonal(both, 0)
    return both


def crowds(rows: DataFrame, own: DataFrame, keys: DataFrame, similar: float, block: int = CROWD_ROWS) -> DataFrame:
    """u, v: nodes whose chains are all chains of similar nodes that share one of `keys`; durable.

    own, keys: as of `keyed` and `shared_keys`. The smallest of a shingle's nodes names their crowd, so a node with many such
    shingles goes to few crowds. Sets meet in the crowd's task, which decides all pairs on the whole sets and returns a
    spanning forest: rows grow with the nodes, not with their pairs. A crowd of more than `block` rows (or CROWD_SHINGLES) is
    cut into blocks, and pairs of blocks are compared in tasks of their own.
    """
    few_own = durable(own.join(few(keys), F.col("key") == F.col("c_key")).select("key", "node", "size"), "similar-crowded")
    name = F.min(F.struct("size", F.xxhash64("node"), "node"))["node"].alias("crowd")
    named = durable(few_own.groupBy(F.col("key").alias("n_key")).agg(name), "similar-named")
    placed = durable(few_own.join(few(named), F.col("key") == F.col("n_key")).select("crowd", "node", "size").distinct(), "similar-crowds")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / CROWD_SHINGLES)).cast("int").alias("parts")
    sized = durable(placed.groupBy(F.col("crowd").alias("c_crowd")).agg(parts), "similar-sized")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = placed.join(few(sized), F.col("crowd") == F.col("c_crowd")).select("crowd", "node", "parts", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    # The pairs inside a block are compared with those to any other.
    dealt = dealt.where("parts = 1 or part <> other").select("crowd", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node")
    ids = durable(placed.select(F.col("node").alias("s_node")).distinct(), "similar-ids")
    sets = shingle_sets(rows, ids)
    met = dealt.join(sets.select(F.col("node").alias("s_node"), "shingles"), F.col("node") == F.col("s_node")).drop("s_node").repartition("crowd", "i", "j")

    def linked(node, sets):
        size, every = np.array([len(h) for h in sets]), np.arange(len(sets))
        apart = symmetric_differences(sets)
        close = np.zeros(apart.shape, bool)
        for at in range(0, len(sets), 256):
            total = size[at : at + 256, None] + size[None, :]
            close[at : at + 256] = total - apart[at : at + 256] + 2e-9 >= similar * (total + apart[at : at + 256])
        label = stars(close, len(node), every, every)
        moved = np.flatnonzero(label != np.arange(len(node)))
        return list(zip(node[moved].tolist(), node[label[moved]].tolist()))

    def run(parts_in):
        key, got = None, []

        def flush():
            node, sets = zip(*got)
            return linked(np.array(node, np.int64), [np.frombuffer(h, np.uint64) for h in sets])

        for b in parts_in:
            for c, i, j, node, h in zip(b["crowd"], b["i"], b["j"], b["node"], b["shingles"], strict=True):
                if key != (c, i, j):
                    if len(got) > 1:
                        yield flush()
                    key, got = (c, i, j), []
                got.append((node, h))
        if len(got) > 1:
            yield flush()

    with batches_of(rows.sparkSession, CROWD_SETS):
        out = durable(map_batches(met.sortWithinPartitions("crowd", "i", "j", "node"), "u long, v long", run, rows=CROWD_SETS).distinct(), "similar-dense")
    for d in (few_own, named, placed, sized, ids, sets):
        discard(d)
    return out


def sharing(marked: DataFrame, roots: DataFrame, similar: float, block: int = BLOCK, keys: DataFrame | None = None) -> DataFrame:
    """u, v: pairs of nodes with unequal roots that share a shingle of their prefixes and whose sketches don't rule them out.

    roots: as of `keyed`. A prefix that is longer by k than the shingles a similar set may lack shares k with it at least, and
    pairs that share fewer are left out. A shingle with more than `block` nodes is cut into blocks, as anchors are. Bins that
    differ are so many shingles that only one of the two sets has, and so are the differences of bin counts (which tell long
    texts apart), so no pair at `similar` or more is lost to either. With `keys` (c_key, n), only those shingles are looked at;
    `crowds` has the pairs of all others.
    """
    own = keyed(marked, roots, similar)
    counts = shared_keys(own) if keys is None else keys
    parts = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = own.join(counts, F.col("key") == F.col("c_key")).select("key", "node", "size", "root", "need", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = durable(dealt.select("key", "node", "size", "root", "need", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")), "similar-dealt")
    columns = ("key", "i", "j", "node", "size", "root", "need", "part")
    a, b = (dealt.select(*[F.col(c).alias(f"{x}_{c}") for c in columns]) for x in "ab")
    met = a.where("a_part = a_i").join(b.where("b_part = b_j"), (F.col("a_key") == F.col("b_key")) & (F.col("a_i") == F.col("b_i")) & (F.col("a_j") == F.col("b_j")))
    near = (F.least("a_size", "b_size") + F.lit(1e-9) >= F.lit(similar) * F.greatest("a_size", "b_size")) & ((F.col("a_i") < F.col("a_j")) | (F.col("a_node") < F.col("b_node")))
    pairs = met.where((F.col("a_root") != F.col("b_root")) & near).groupBy(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v"))
    pairs = pairs.agg(F.count("*").alias("shared"), F.min(F.least("a_need", "b_need")).alias("need")).where("shared >= need")
    pairs = durable(pairs.select("u", "v"), "similar-pairs")
    discard(dealt)
    ids = durable(pairs.select(F.explode(F.array("u", "v")).alias("s_node")).distinct(), "similar-ids")
    picked = durable(marked.join(few(ids), F.col("rid") == F.col("s_node"), "left_semi").select("rid", "size", "sketch", "bins"), "similar-picked")
    u, v = (picked.select(F.col("rid").alias(f"{x}_node"), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"), F.col("bins").alias(f"{x}_bins")) for x in "uv")

    def possible(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("u_sketch", "v_sketch"))
            n = b.column("u_size").to_numpy(zero_copy_only=False).astype(np.int64) + b.column("v_size").to_numpy(zero_copy_only=False)
            most = (1 - similar) / (1 + similar) * n + 1e-9
            keep = (x != y).sum(1) <= most
            bins = zip(b.column("u_bins").to_pylist(), b.column("v_bins").to_pylist(), strict=True)
            keep &= np.fromiter((not k or least_difference(p, q) <= m for k, m, (p, q) in zip(keep, most, bins, strict=True)), bool, b.num_rows)
            yield b.select(["u", "v"]).filter(pa.array(keep))

    def both(some):
        met = some.join(u, F.col("u") == F.col("u_node")).join(v, F.col("v") == F.col("v_node"))
        return met.select("u", "v", "u_size", "v_size", "u_sketch", "v_sketch", "u_bins", "v_bins").mapInArrow(possible, "u long, v long")

    with batches_of(marked.sparkSession, SETS):  # sketch and bins of a pair are up to nine kilobytes
        out = in_slices(pairs, SKETCHED_AT_ONCE, "similar-possible", both)
    for d in (None if keys is not None else counts, pairs, ids, picked):
        discard(d)
    return out


def shingle_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """node, shingles of the rows whose ids are in s_node of `ids`, a durable frame; durable."""

    def sets(parts):
        for b in parts:
            yield [(rid, shingle_set((t or "").encode().lower().split()).tobytes()) for rid, t in zip(b["rid"], b["text"], strict=True)]

    texts = rows.join(few(ids), F.col("rid") == F.col("s_node"), "left_semi")
    with batches_of(rows.sparkSession, SETS):
        return durable(map_batches(texts, "node long, shingles binary", sets, rows=SETS), "similar-sets")


def confirmed(rows: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The pairs u, v of row ids whose texts' shingle sets have a Jaccard similarity of `similar` or more; durable.

    Only texts in a pair are needed: their ids are broadcast up to a checked size, so that texts aren't shuffled for them.
    """
    ids = durable(pairs.select(F.explode(F.array("u", "v")).alias("s_node")).distinct(), "similar-ids")
    own = shingle_sets(rows, ids)
    u, v = (own.select(F.col("node").alias(f"{x}_node"), F.col("shingles").alias(f"{x}_set")) for x in "uv")

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("u_set"), b.column("v_set"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both + 1e-9 >= similar * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def both(some):
        met = some.join(u, F.col("u") == F.col("u_node")).join(v, F.col("v") == F.col("v_node"))
        return met.select("u", "v", "u_set", "v_set").mapInArrow(compare, "u long, v long")

    with batches_of(rows.sparkSession, SETS):  # the set of a long text has some hundred kilobytes, and that of a hub stands in all its pairs
        out = in_slices(pairs, SETS_AT_ONCE, "similar-edges", both)
    for d in (ids, own):
        discard(d)
    return out


def similar_texts(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """rid, keep_rid: the smallest row id of each row's group of texts that are similar on five-word shingles.

    Texts link if the Jaccard similarity of their shingle sets is `similar` or more; those with the same set are one node.
    A first pass compares texts of which a fingerprint of the distinct words is within three bits; it joins large groups
    of copies cheaply and need not find all. The second compares all pairs that share a shingle of their prefixes, where
    the first has not joined them, so no link is missed; what shares a frequent one is compared in crowds. Row ids are those of
    the scan.
    """
    fps = [f"f{k}" for k in range(len(SEEDS))]

    def run(parts):
        import xxhash

        for b in parts:
            out = []
            for rid, t in zip(b["rid"], b["text"], strict=True):
                words = (t or "").encode().lower().split()
                distinct = list(dict.fromkeys(words))
                prints = np.array([word_fingerprint(distinct, s) for s in SEEDS], np.uint64).view(np.int64).tolist()
                h = shingle_set(words)
                out.append((rid, *prints, xxhash.xxh3_128_digest(h.tobytes()), len(h), sketch_of(h), bin_counts(h), prefix_of(h, hot, similar).view(np.int64).tolist()))
            yield out

    rows = numbered(scanned(docs).select(F.col("text").cast("string").alias("text"))).select("rid", "text")
    hot = hot_shingles(rows, similar)
    schema = "rid long, " + ", ".join(f"{f} long" for f in fps) + ", own binary, size int, sketch binary, bins binary, prefix array<long>"
    with batches_of(docs.sparkSession, SETS):
        every = durable(map_batches(rows, schema, run, rows=SETS), "similar-marks")
    least = every.groupBy("own").agg(F.min("rid").alias("node"))
    least = durable(least.select(F.col("own").alias("n_own"), "node"), "similar-least")
    # From here on a set of shingles stands once, under its first row; copies come back at the end.
    # Copies are few where nodes are many, so they are left out: a join of all nodes would shuffle prefixes, sketches and bins.
    members = durable(every.select("rid", "own"), "similar-members")
    copies = durable(members.join(least, F.col("own") == F.col("n_own")).where("rid <> node").select(F.col("rid").alias("copy")), "similar-copies")
    marked = every.join(few(copies), F.col("rid") == F.col("copy"), "left_anti")
    if copies.count() > BROADCAST_ROWS:
        marked = durable(marked, "similar-nodes")
        discard(every)
    released(docs.sparkSession)
    nodes = marked.select(F.col("rid").alias("node"), *fps, "sketch")
    met = links(nodes.select("node", *fps), fps, nodes.select("node", "sketch"), min(LOOSE, similar))
    edges = confirmed(rows, met, similar)
    first = components(edges)
    released(docs.sparkSession)
    keys = shared_keys(own := keyed(marked, first, similar))
    dense = crowds(rows, own, keys.where(F.col("n") > CROWD).select("c_key"), similar)
    released(docs.sparkSession)
    rest = sharing(marked, first, similar, keys=keys.where(F.col("n") <= CROWD))
    more = confirmed(rows, rest, similar)
    released(docs.sparkSession)
    last = components(edges.unionByName(dense).unionByName(more))
    comp = last.select(F.col("node").alias("c_node"), "root")
    rooted = durable(least.join(comp, F.col("node") == F.col("c_node"), "left").select("n_own", F.coalesce("root", "node").alias("keep_rid")), "similar-rooted")
    for d in (every, copies, marked, met, edges, first, keys, dense, rest, more, last, least):
        discard(d)
    return members.join(rooted, F.col("own") == F.col("n_own")).select("rid", "keep_rid")


def keep_dissimilar(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each group of similar texts, that with the largest doc_id, and their columns.

    A null id loses against any other; of rows with one id the first stays, by files and rows.
    """
    docs = scanned(docs)
    with shuffles_removed(docs.sparkSession):
        told = durable(similar_texts(docs, similar).where("rid <> keep_rid").select("rid", F.col("keep_rid").alias("root")), "similar-told")
        grouped = durable(told.unionByName(told.select(F.col("root").alias("rid"), "root").distinct()), "similar-grouped")
        own = numbered(docs.select("doc_id"), "own_rid")
        named = durable(own.join(few(grouped), F.col("own_rid") == F.col("rid")).select("rid", "root", "doc_id"), "similar-ids")
        best = F.max(F.struct("doc_id", (-F.col("rid")).alias("late")))["late"]  # nulls sort first
        stays = durable(named.groupBy(F.col("root").alias("s_root")).agg((-best).alias("stays")), "similar-stays")
        gone = durable(named.join(stays, F.col("root") == F.col("s_root")).where("rid <> stays").select("rid"), "similar-gone")
        discard(told, grouped, named, stays)
    return without(docs, gone)


def hexed(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """docs with one row for each component, the one with its smallest doc_id; the columns of docs.

    Rows without an id stay if no row of their component has one.
    """
    found = near_duplicates(docs, width)
    stay = durable(found.where(F.col("doc_id") == F.col("component_id")).select(F.col("component_id").alias("__stay")).distinct(), "simhash-stay")
    return docs.join(stay, F.col("doc_id") == F.col("__stay"), "left_semi")


__all__ = ["anchors", "components", "fingerprint_of", "fingerprints", "hexed", "keep_dissimilar", "keep_one", "links", "near_duplicates", "similar_texts"]
