"""Every operator over odd rows, empty tables and extra columns, and against brute force."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import bpe, common, dedup, langid, lattice, licences, mixing, quality, queries, secrets, simhash, toxicity
from tests.llm.conftest import odd_rows

public_tokenizers = pytest.importorskip("public_tokenizers")


def words(t):
    return (t or "").encode().split()


def clashing(df):
    """Extra columns with names that operators use inside."""
    return df.withColumns({n: F.lit("clash") for n in ("rid", "pos", "name", "word", "fp", "tokens", "topic", "line", "p", "score", "body", "label", "w", "ratio")})


# --- exact dedup


def check_dedup(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    got = dedup.exact_dedup(df).collect()
    assert len(got) == len(rows)
    size = Counter(t for _, t in rows)
    top = {}
    for i, t in rows:
        top[t] = max(top.get(t, -1), -1 if i is None else i)
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in size}
    back = {v: k for k, v in sha.items()}
    for r in got:
        t = back[r["text_sha256"]]
        assert r["group_size"] == size[t] and (-1 if r["keep_id"] is None else r["keep_id"]) == top[t]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(back[r["text_sha256"]] for r in got if r["kept"]) == Counter(size.keys())
    return got


def test_dedup_odd(odd, empty):
    check_dedup(odd)
    check_dedup(clashing(odd))
    assert dedup.exact_dedup(empty).count() == 0 and dedup.keep_distinct(empty).count() == 0
    assert sorted(dedup.keep_distinct(clashing(odd)).columns) == sorted(clashing(odd).columns)


def test_dedup_block_edges(table):
    rng = random.Random(3)
    base = "".join(rng.choice("ab😀") for _ in range(400))
    texts = [base[:n] for n in range(0, 400, 7)] * 3 + [base[:n] + "x" for n in range(0, 400, 31)] + ["a" * n for n in range(60)]
    df = table([(k, t) for k, t in enumerate(texts)])
    ids = dedup.identities(df, block_chars=16).collect()
    assert len(ids) == len(texts) and len({(r["level"], r["name"]) for r in ids}) == len(set(texts))
    assert dedup.keep_distinct(df, block_chars=16).count() == len(set(texts))


# --- SimHash


def brute_fp(t, width=3):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, limit=3):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= limit:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in fps}


def test_fingerprints():
    for _, t in odd_rows():
        assert simhash.fingerprint_of(t) == brute_fp(t)


def test_anchors_cover():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**31, 400, dtype=np.uint64)
    near, far = simhash.anchors(x)
    assert (np.bitwise_count(near ^ x) <= 1).all() and (np.bitwise_count(far ^ x[:, None]) <= 2).all()
    for bit in range(31):
        y_near, y_far = simhash.anchors(x ^ np.uint64(1 << bit))
        assert ((near == y_near) | (far == y_near[:, None]).any(1)).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_links_and_components(spark, block):
    rng = random.Random(block)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << b) for b in range(64)} | {hub}  # one large group of near copies
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(signed(f), signed(f)) for f in fps], "node long, fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, block=block)).collect()}
    want = brute_components(fps)
    mine, theirs = {}, {}
    for f in fps:
        mine.setdefault(got.get(signed(f), signed(f)), set()).add(f)
        theirs.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(clashing(odd)).collect()
    assert len(got) == len(odd_rows())
    comp = brute_components({brute_fp(t) for _, t in odd_rows()})
    least = {}
    for i, t in odd_rows():
        if i is not None:
            c = comp[brute_fp(t)]
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), least[comp[brute_fp(t)]]) for i, t in odd_rows())
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert simhash.keep_one(clashing(odd)).columns == clashing(odd).columns


def test_similar_texts(table, odd, empty):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, group = [], {}
    for g in range(60):
        base = [word() for _ in range(300)]
        for k in range(5):
            t = list(base)
            for _ in range(k):  # k words of 300 differ: similarity of (296 - 5k) / (296 + 5k)
                t[rng.randrange(300)] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(t)))
    docs = table(rows)
    ids = {r["__rid"]: r["doc_id"] for r in common.numbered(common.scanned(docs), "__rid").collect()}
    found = {}
    for r in simhash.similar_texts(docs).collect():
        found.setdefault(r["keep_rid"], set()).add(group[ids[r["rid"]]])
    assert all(len(g) == 1 for g in found.values())  # nothing else is linked
    assert 60 <= len(found) <= 63
    kept = simhash.keep_dissimilar(clashing(docs))
    assert kept.count() == len(found) and kept.columns == clashing(docs).columns
    assert simhash.keep_dissimilar(odd).count() > 0 and simhash.keep_dissimilar(empty).count() == 0


def set_similarity(a, b, width=5):
    a, b = ({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def edited():
    """(words, words with some replaced, whether they are similar at 0.8): short and long texts just above and below the limit."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    out = []
    for size in (40, 60, 400, 3000):
        for low, high in ((0.75, 0.8), (0.8, 0.85)) * 6:
            base = [vocabulary[min(int(rng.paretovariate(0.8)), 3000) - 1] for _ in range(size)]
            while True:
                near = list(base)
                while (now := set_similarity(base, near)) >= high:
                    near[rng.randrange(size)] = rng.choice(vocabulary)
                if now >= low:
                    break
            out.append((base, near, now >= 0.8))
    return out


def test_similar_texts_at_the_limit(table, edited):
    docs = table([(2 * k + j, " ".join(pair[j])) for k, pair in enumerate(edited) for j in (0, 1)])
    ids = {r["__rid"]: r["doc_id"] for r in common.numbered(common.scanned(docs), "__rid").collect()}
    keep = {ids[r["rid"]]: r["keep_rid"] for r in simhash.similar_texts(docs).collect()}
    assert [keep[2 * k] == keep[2 * k + 1] for k in range(len(edited))] == [x[2] for x in edited]
    assert max(Counter(keep.values()).values()) == 2


def test_confirmed_on_shingles(table, edited):
    rows = table([(2 * k + j, " ".join(pair[j])) for k, pair in enumerate(edited) for j in (0, 1)], "rid long, text string")
    pairs = table([(2 * k, 2 * k + 1) for k in range(len(edited))], "u long, v long")
    got = {r["u"] // 2 for r in simhash.confirmed(rows, pairs, 0.8).collect()}
    assert got == {k for k, x in enumerate(edited) if x[2]}


def test_bin_counts_never_overstate_the_difference():
    rng = np.random.default_rng(4)
    for n in (3, 200, 1400, 1700, 6000):
        for changed in (0, 1, n // 10, n // 2):
            a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**63, changed // 2, dtype=np.uint64) * np.uint64(2)]))
            a = np.unique(a)
            assert simhash.least_difference(simhash.bin_counts(a), simhash.bin_counts(b)) <= len(np.setxor1d(a, b))
    x, y = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) for n in (6000, 6000))
    assert simhash.least_difference(simhash.bin_counts(x), simhash.bin_counts(y)) > 12_000 / 9  # other texts are told apart


@pytest.mark.parametrize("block", [2048, 3])
def test_sharing_blocks(table, block):
    rows = [(k, [k, k + 1, 7], 10, k % 5) for k in range(0, 40, 2)]
    given = table(rows, "rid long, prefix array<long>, size int, root long")
    marked, roots = given.drop("root").withColumns({"sketch": F.lit(bytes(512)), "bins": F.lit(bytes(512))}), given.select(F.col("rid").alias("node"), "root")
    got = sorted((r["u"], r["v"]) for r in simhash.sharing(marked, roots, 0.8, block).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3])


def test_hot_shingles_are_counted_in_all_texts(table):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(5))
    often = [words(k) for k in range(40)]  # one shingle each, in four texts; every other one in one text
    rows = table([(k, often[k // 200] if k % 50 == 0 else words(k + 1000)) for k in range(8000)], "rid long, text string")
    assert simhash.hot_shingles(rows).tolist() == sorted(int(simhash.shingle_set(t.encode().split())[0]) for t in often)


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    for n in (1, 2, 3, 4, 5, 9, 10, 60, 400, 1000):
        for share in (0.0, 0.3, 0.5, 1.0):
            a = np.unique(draw(n))
            lost = int((1 - 0.8) / (1 + 0.8) * 2 * n * share / (1 + share)) if share else 0
            b = np.sort(np.concatenate([a[lost:], np.arange(int(0.2 * (n - lost) * (1 - share)), dtype=np.uint64)]))  # the worst place: the first hashes differ
            both = len(np.intersect1d(a, b))
            if both < 0.8 * (len(a) + len(b) - both):
                continue
            for hot in (np.zeros(0, np.uint64), np.sort(rng.choice(a, n // 3, replace=False))):
                p, q = simhash.prefix_of(a, hot, 0.8), simhash.prefix_of(b, hot, 0.8)
                need = [len(x) - (len(h) - int(np.ceil(0.8 * len(h) - 1e-9))) for x, h in ((p, a), (q, b))]
                assert min(need) >= 1 and len(np.intersect1d(p, q)) >= min(need)


def test_nodes_are_told_by_exceptions(table, monkeypatch):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    texts = [words(k) for k in range(30)]
    texts += [texts[0].upper(), texts[1] + " more"]  # a copy and a near copy
    joined, whole = [], simhash.few
    monkeypatch.setattr(simhash, "few", lambda ids: joined.append(ids.count()) or whole(ids))
    found = {r["rid"]: r["keep_rid"] for r in simhash.similar_texts(table(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(found.values())) == 30
    assert max(joined) <= 4  # ids of all nodes, joined to marks or texts, would be too many to broadcast


def test_sharing_leaves_out_pairs_that_share_too_few(table):
    rows = [(0, [1, 2, 3, 4], 10, 0), (1, [1, 2, 5, 6], 10, 1), (2, [1, 7, 8, 9], 10, 2), (3, [7, 10, 11], 10, 3)]
    given = table(rows, "rid long, prefix array<long>, size int, root long")
    marked, roots = given.drop("root").withColumns({"sketch": F.lit(bytes(512)), "bins": F.lit(bytes(512))}), given.select(F.col("rid").alias("node"), "root")
    # Ten shingles may lack two, so four in a prefix hold two shared ones, and three hold one.
    assert sorted((r["u"], r["v"]) for r in simhash.sharing(marked, roots, 0.8).collect()) == [(0, 1), (2, 3)]


def test_pairs_in_slices(table, edited, monkeypatch):
    rows = table([(2 * k + j, " ".join(pair[j])) for k, pair in enumerate(edited) for j in (0, 1)], "rid long, text string")
    pairs = table([(2 * k, 2 * k + 1) for k in range(len(edited))], "u long, v long")
    sizes = []
    write = simhash.durable
    monkeypatch.setattr(simhash, "SETS_AT_ONCE", 10)
    monkeypatch.setattr(simhash, "durable", lambda df, label: sizes.append(label) or write(df, label))
    got = sorted(r["u"] // 2 for r in simhash.confirmed(rows, pairs, 0.8).collect())
    assert got == [k for k, x in enumerate(edited) if x[2]]
    assert sizes.count("similar-edges") == 6  # 48 pairs by tens, and all of them


def test_shuffle_files_go_with_their_action(spark, table):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    docs = table([(k, f"some words of text {k}") for k in range(20)])
    seen = []
    write = simhash.durable
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "durable", lambda df, label: seen.append(spark.conf.get(name, None)) or write(df, label))
        assert simhash.keep_dissimilar(docs).count() == 20
    assert set(seen) == {"true"} and spark.conf.get(name, None) == before


def near_copies(n, size, edits, seed):
    """n copies of one text of `size` words, each with some of its words replaced."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(size), rng.choice(edits)):
            words[at] = f"x{k}y{at}"
        out.append(words)
    return out


def brute_groups(words):
    """The smallest index of each text's group of texts that are similar at 0.8."""
    parent = list(range(len(words)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(words)):
        for j in range(i):
            if set_similarity(words[i], words[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(words))]


def test_symmetric_differences():
    rng = np.random.default_rng(3)
    words = near_copies(70, 60, (0, 1, 3, 30), 1) + near_copies(3, 400, (2,), 2) + [[f"z{k}{j}" for j in range(9)] for k in range(4)]
    sets = [simhash.shingle_set(" ".join(w).encode().split()) for w in words]
    for some in (sets, sets[70:], sets[:1], sets[:2], [sets[k] for k in rng.permutation(len(sets))]):
        assert simhash.symmetric_differences(some).tolist() == [[len(np.setxor1d(a, b)) for b in some] for a in some]


@pytest.mark.parametrize("block", [1024, 8])
def test_large_groups_of_near_copies_make_no_row_for_each_pair(table, block, monkeypatch):
    """150 near copies, of which many are similar to none: groups as by brute force, rows in proportion to the texts."""
    words = near_copies(150, 150, (1, 2, 3, 4, 5), 5) + near_copies(40, 60, (1, 2), 6)
    docs = table([(k, " ".join(w)) for k, w in enumerate(words)])
    ids = {r["rid"]: r["doc_id"] for r in common.numbered(common.scanned(docs), "rid").collect()}
    written, write = {}, simhash.durable

    def counted(df, label):
        out = write(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "durable", counted)
    monkeypatch.setattr(simhash.crowds, "__defaults__", (block,))
    found, want = {}, {}
    for r in simhash.similar_texts(docs).collect():
        found.setdefault(r["keep_rid"], set()).add(ids[r["rid"]])
    for k, g in enumerate(brute_groups(words)):
        want.setdefault(g, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, found.values())) > 30 and sum(len(g) == 1 for g in found.values()) > 30
    assert written["similar-pairs"] + written["similar-possible"] < simhash.CROWD * len(words) / 2


def test_pairs_of_rare_and_of_crowded_shingles_are_all_found(table, edited, monkeypatch):
    """Shingles of two texts, of a few and of many: what goes to crowds and what to pairs make up all links."""
    words = [w for pair in edited for w in pair[:2]] + near_copies(20, 80, (1, 2, 3), 7)
    docs = table([(k, " ".join(w)) for k, w in enumerate(words)])
    ids = {r["rid"]: r["doc_id"] for r in common.numbered(common.scanned(docs), "rid").collect()}
    want = Counter(brute_groups(words)).values()
    for most in (0, 1, 3, 18):
        monkeypatch.setattr(simhash, "CROWD", most)
        got = {}
        for r in simhash.similar_texts(docs).collect():
            got.setdefault(r["keep_rid"], set()).add(ids[r["rid"]])
        assert sorted(map(len, got.values())) == sorted(want)


# --- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(queries.BPE_FILE))


def bpe_truth(ranks, t):
    import tiktoken

    ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(t or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("chars", [bpe.CHUNK, 1])
def test_bpe(odd, empty, ranks, chars):
    from array import array

    got = sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(clashing(odd), ranks, public_tokenizers.PATTERN, chars).collect())
    assert got == sorted((str(i), *bpe_truth(ranks, t)) for i, t in odd_rows())
    enc = bpe.encode(clashing(odd), ranks, public_tokenizers.PATTERN, chars)
    ids = sorted((str(r["doc_id"]), len(r["ids"]) // 4, hashlib.sha256(",".join(map(str, array("I", r["ids"]))).encode()).hexdigest()) for r in enc.collect())
    assert ids == [x[:3] for x in got]
    assert sorted(bytes(r["bytes"]) for r in bpe.decode(enc, ranks).collect()) == sorted((t or "").encode() for _, t in odd_rows())
    assert bpe.round_trip(empty, ranks, public_tokenizers.PATTERN, chars).count() == 0


def test_chunks_number_alike(table, ranks):
    """Each document's numbers, looked up in its chunk's words, give its pre-tokens, also where a partition has several chunks."""
    import regex

    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["ab", "cd", "x1", "--", "\n", "é"]) + str(rng.randrange(99)) for _ in range(rng.randrange(40)))) for k in range(1500)]
    docs = table(rows, partitions=1)
    words = {}
    for r in bpe.distinct_words(docs, public_tokenizers.PATTERN, 20_000).collect():
        (steps, sizes), data = bpe.unpack(r["body"])
        words.setdefault(r["chunk"], {}).update(zip(np.cumsum(steps).tolist(), [w.decode() for w in bpe.cut(data, sizes)]))
    assert len(words) > 1 and all(len(set(w.values())) == len(w) and sorted(w) == list(range(len(w))) for w in words.values())
    find, texts = regex.compile(public_tokenizers.PATTERN).findall, dict(rows)
    for r in bpe.numbered_documents(docs, public_tokenizers.PATTERN, 20_000).collect():
        (counts, numbers), _ = bpe.unpack(r["body"])
        ends = np.cumsum(counts).tolist()
        for i, x, y in zip(r["doc_ids"], [0, *ends[:-1]], ends):
            assert [words[r["chunk"]][n] for n in numbers[x:y].tolist()] == find(texts[i])


def test_chunks_match_many_words_in_one_go():
    """The pattern is not started once for each distinct word, and numbers still give the pre-tokens of every text."""
    splitter = bpe.Splitter(public_tokenizers.PATTERN)
    find, calls = splitter.findall, []
    splitter.findall = lambda t: calls.append(t) or find(t)
    rng = random.Random(8)
    bits = ["don't", "'s", "x1,", "é", "(a)b", "--", "12a", "the"]
    line = lambda: " ".join(rng.choice(bits) + rng.choice(bits) + str(rng.randrange(900)) for _ in range(rng.randint(1, 12)))
    texts = [rng.choice(["\n", "\n\n", "\n ", "  "]).join(line() for _ in range(rng.randrange(4))) for _ in range(400)] + [None, "", " ", "\n", "a", "a", "a\t\tb"]
    chunk = bpe.Chunk(splitter)
    added = [chunk.add(texts[:200]), chunk.add(texts[200:])]
    odd = {p for t in texts for p in splitter.pieces(t or "") if any(c.isspace() for c in p[1:]) or p.isspace()}
    assert len(calls) <= len(odd) + 4 < len(chunk.number) / 2
    words = list(chunk.number)
    sizes, numbers = (np.concatenate(x) for x in zip(*added))
    ends = np.cumsum(sizes).tolist()
    assert [[words[n] for n in numbers[x:y].tolist()] for x, y in zip([0, *ends[:-1]], ends)] == [find(t or "") for t in texts]


def test_unsteady_frames_are_written_first(table):
    from kindred.llm import common

    docs = table([(k, str(k)) for k in range(20)])
    assert common.scanned(docs.where("doc_id > 3").select("doc_id")) is not docs and common.scanned(docs) is docs
    again = common.scanned(docs.repartition(3))
    assert "__none" not in again.columns and sorted(r["doc_id"] for r in again.collect()) == list(range(20))


def test_splitter_equals_pattern():
    import regex

    s, find = bpe.Splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(11)
    bits = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", " ", "1", "'s", "'", "!", "é", "👍", "\r\n", " ", "​", "\x00", "x y", " \n", "\n "]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [w for p in s.pieces(t) for w in s.findall(p)] == find(t), repr(t)


# --- language model


def test_lattice_sums_all_segmentations():
    rng = random.Random(2)
    net = lattice.Lattice({"▁": -1.0, "▁a": -2.0, "a": -1.5, "b": -2.5, "ab": -2.2, "ba": -3.0, "aba": -4.0}, [math.log(0.001)] * 256)

    def brute(s):
        if not s:
            return 1.0
        out = sum(math.exp(net.w[s[:k]]) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in net.w)
        return out if s[0] in net.w else out + 0.001 ** len(s[0].encode()) * brute(s[1:])

    for _ in range(100):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 9)))
        assert net.log_marginal(word) == pytest.approx(math.log(brute("▁" + word)))


@pytest.mark.parametrize("size", [300_000, 5, 0])
def test_lm_scores(odd, empty, size):
    model = lattice.read_vocabulary(public_tokenizers.path(queries.PIECE_FILE))
    got = lattice.score_texts(clashing(odd), model, dictionary=size).collect()
    mod = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    low = lambda t: (t or "").encode().lower().split()
    train = [low(t) for i, t in odd_rows() if mod(i) != 2]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = []
    for i, t in odd_rows():
        ws = low(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((str(i), mod(i) == 2, len(ws) + 1, sum(w in c for w in ws) + 1, n, round(base, 4)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    assert lattice.score_texts(empty, model).count() == 0


def test_lm_score_of_whole_texts(table):
    """The score of a text is the sum of its words' marginals and the end's weight, with weights from the training documents."""
    import sentencepiece

    rng = random.Random(9)
    vocabulary = ["water", "house", "light", "straße", "числа", "a", "of", "zq9"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for k in range(60)] + [(100, None), (101, "")]
    model = lattice.read_vocabulary(public_tokenizers.path(queries.PIECE_FILE))
    got = {r["doc_id"]: r["score"] for r in lattice.score_texts(table(rows), model, dictionary=3).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    train = [(t or "").lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    pieces = Counter()
    for w, n in Counter(w for ws in train for w in ws).items():
        for i in sp.encode(w):
            pieces[i] += n
    net, end = lattice.build_lattice(model, pieces, float(len(train)))
    for i, t in rows:
        assert got[i] == pytest.approx((sum(net.log_marginal(w) for w in (t or "").lower().split()) + end) / math.log(10), rel=1e-9)


# --- quality


def test_base_rules():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "\n", "#", "c d e", "\t", "é|"]) for _ in range(rng.randint(0, 60)))
        w = [x for x in t.encode().split()]
        grams = Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k in range(len(w) - 2) for j in range(3) if grams[w[k], w[k + 1], w[k + 2]] > 1}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        assert quality.base_rules(t) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), dup, len(marked))


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    f = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        x = rng.normal(size=(n, len(quality.FEATURES)))
        e = x @ f.emission
        score = lambda y: f.start[y[0]] + sum(e[k, y[k]] for k in range(n)) + sum(f.trans[y[k - 1], y[k]] for k in range(1, n))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(f.viterbi(x)) == best


def test_gradient():
    rng = np.random.default_rng(2)
    f = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    x, y = rng.normal(size=(5, len(quality.FEATURES))), np.array([0, 1, 1, 0, 1])
    import itertools

    def ll(f):
        e = x @ f.emission
        s = lambda y: f.start[y[0]] + sum(e[k, y[k]] for k in range(5)) + sum(f.trans[y[k - 1], y[k]] for k in range(1, 5))
        return s(y) - np.log(sum(np.exp(s(z)) for z in itertools.product((0, 1), repeat=5)))

    g = f.gradient(x, y)
    h = 1e-5
    f.trans[0, 1] += h
    up = ll(f)
    f.trans[0, 1] -= 2 * h
    down = ll(f)
    f.trans[0, 1] += h
    assert g[2][0, 1] == pytest.approx((up - down) / (2 * h), abs=1e-5)


def test_quality_odd(odd, empty, labels):
    field = quality.train(odd, labels)
    got = quality.judge_quality(clashing(odd), field).collect()
    assert len(got) == len(odd_rows()) and not any(r["kept"] for r in got if r["n_words"] < 50)
    assert quality.judge_quality(empty, quality.train(empty, labels)).count() == 0


def test_judged_by_brute_force(table, odd, labels):
    rng = random.Random(6)
    bits = ["A clean line of prose, with words that end well.", "w1x %%% w2y ### w3z", "| a | b | c |", "BUY NOW AND SAVE BIG!! TODAY!!", "All rights reserved.", "", "the same line", "one two three one two three"]
    rows = [(k, "\n".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for k in range(80)] + odd_rows()
    docs = table(rows)
    field = quality.train(docs, labels)
    want = []
    for i, t in rows:
        t = t or ""
        n, chars, sym, dup, rep = quality.base_rules(t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        label = field.viterbi(quality.line_features(lines)) if lines else []
        content = sum(len(x.split()) or 1 for x, y in zip(lines, label) if y == 0)
        share = content / max(1, sum(len(x.split()) or 1 for x in lines))
        failed = n < 50 or 100 * rep > 50 * n
        want.append((str(i), n, chars, sym, dup, rep, failed, not failed and share >= 0.5))
    got = quality.judge_quality(clashing(docs), field).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) for r in got) == sorted(want)


def test_quality_separates(table):
    good = [(k, "\n".join(f"This is a clean line of prose number {k} {j}, with words that end well." for j in range(8))) for k in range(40)]
    bad = [(100 + k, "\n".join(" ".join(f"w{k}x{j}y{i}%%%" for i in range(12)) for j in range(8))) for k in range(40)]
    lab = table([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    docs = table(good + bad)
    got = {r["doc_id"]: r["content_share"] for r in quality.judge_quality(docs, quality.train(docs, lab)).collect()}
    assert min(got[i] for i, _ in good) > 0.9 and max(got[i] for i, _ in bad) < 0.1


# --- secrets


def test_base_spans():
    key = "AKIA" + "A1B2" * 4
    t = f"PassWord: 'abcdef' token=abc api_key => x secret=\"{'ab12' * 8}\" {key} AKIASHORT {'0f' * 12} {'0f' * 11}"
    got = [(k, t[s:e]) for s, e, k in secrets.base_spans(t)]
    assert ("assign", "PassWord: 'abcdef") in got and ("access", key) in got and ("hex", "0f" * 12) in got
    assert ("hex", "ab12" * 8) in got and sum(k == "assign" for k, _ in got) == 2
    assert secrets.base_spans("paſſword=abcdefgh") == []


BASE62 = "".join(secrets.ALPHABETS[5][1])


@pytest.mark.parametrize("name, classes, signs", secrets.ALPHABETS)
def test_battery_keeps_random_strings(name, classes, signs):
    rng = random.Random(name + classes[0])
    abc = "".join(classes) + signs
    for n in (20, 24, 32, 64):
        found = [secrets.tested("".join(rng.choice(abc) for _ in range(n)), 0) for _ in range(400)]
        assert np.mean([bool(x) and x[0]["bin"] <= secrets._bin(secrets.KEEP) for x in found]) >= 0.9, n


def test_battery_tells_random_from_prose():
    for w in ("prosewords" * 4, "aaaaaaaaaa" * 4, "thequickbrown" * 4, "some_quite_ordinary_identifier_name", "Customer000000000123Name", "/usr/local/lib/python3/site", "2021-03-04-05-06-07-08-09"):
        assert not any(x["bin"] <= secrets._bin(secrets.KEEP) for x in secrets.tested(w, 0)), w


def test_p_values_are_uniform_for_random_strings():
    rng = random.Random(4)
    ps = []
    for _ in range(3000):
        got = secrets.battery("".join(rng.choice(BASE62) for _ in range(60)))
        if got:
            ps.append(got[1])
    for q in (0.05, 0.25, 0.5, 0.75):
        assert np.mean(np.array(ps) <= q) == pytest.approx(q, abs=0.08)  # runs and serial correlation depend on each other a little
    assert secrets.combined_p((0.2, 0.5, 0.9)) == pytest.approx(sum(x * y * z <= 0.09 for x, y, z in np.random.default_rng(1).random((200_000, 3))) / 200_000, abs=0.01)


def test_limits_by_brute_force(spark):
    rng = random.Random(8)
    for _ in range(200):
        bins = [min(399, int(rng.expovariate(0.07))) if rng.random() < 0.6 else rng.randrange(400) for _ in range(rng.randint(1, 80))]
        least = secrets._bin(secrets.KEEP)
        expected = least
        for limit in range(least + 1, 400):
            accepted = sum(b <= limit for b in bins)
            truly = 2 * sum(b < 10 for b in bins) * (1 - 2 ** (-(limit + 1) / 10))
            if limit in bins and accepted - truly <= secrets.FDR * accepted:
                expected = limit
        assert secrets.limit_of(Counter(bins)) == expected
    scanned = spark.createDataFrame([(1, [(0, 30, 5, 3), (40, 70, 5, 90)]), (2, [(0, 90, 7, 399)]), (3, None)], "doc_id long, candidates array<struct<s:int,e:int,stratum:int,bin:int>>")
    assert secrets.discovery_limits(scanned) == {5: secrets.limit_of({3: 1, 90: 1}), 7: secrets.limit_of({399: 1})}


def test_outside_known_spans():
    rng = random.Random(5)
    for _ in range(300):
        known = secrets._merged(sorted((s, s + rng.randint(1, 30), "hex") for s in (rng.randrange(200) for _ in range(rng.randint(1, 6)))))
        s = rng.randrange(150)
        e = s + rng.randint(20, 100)
        free = [k for k in range(s, e) if not any(x <= k < y for x, y in known)]
        runs = [[]]
        for k in free:
            if runs[-1] and k != runs[-1][-1] + 1:
                runs.append([])
            runs[-1].append(k)
        assert secrets.outside(s, e, known) == [(r[0], r[-1] + 1) for r in runs if len(r) >= secrets.MIN_LENGTH]


def test_secrets_odd(odd, empty, table):
    got = secrets.find_secrets(clashing(odd)).collect()
    assert len(got) == len(odd_rows()) and sum(r["n_assign"] for r in got) == 1
    for r in got:
        assert r["n_random"] or r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert secrets.find_secrets(empty).count() == 0
    rng = random.Random(1)
    rows = [(k, "see " + "".join(rng.choice(BASE62) for _ in range(44)) + " here") for k in range(50)] + [(100 + k, "some_quite_ordinary_identifier_name here") for k in range(50)]
    found = {r["doc_id"]: r["n_random"] for r in secrets.find_secrets(table(rows)).collect()}
    assert sum(found[k] for k in range(50)) >= 40 and not any(found[100 + k] for k in range(50))


def test_secrets_in_assignments_and_paths(table):
    rng = random.Random(2)
    abc = BASE62
    forms = ("AWS_SECRET_ACCESS_KEY={}", "private_key={}", "SIGNING_KEY={}==", "https://x.example/a?sig={}&v=1", "path/sub_dir/{}", "path/some-other_directory_name/{}")
    keys = [("".join(rng.choice(abc) for _ in range(44)), f) for f in forms for _ in range(30)]
    rows = [(k, "see " + f.format(key) + " here") for k, (key, f) in enumerate(keys)] + [(1000, "the_name_of_some_setting=the/name/of/some_other/file_in_a_folder here")]
    got = {r["doc_id"]: (r["n_random"], r["spans"]) for r in secrets.find_secrets(table(rows)).collect()}
    for f in forms:
        hit = 0
        for k, (key, form) in enumerate(keys):
            spans = [tuple(map(int, x.split(":")[1:])) for x in got[k][1].split(",") if x.startswith("random:")]
            hit += form == f and any(key in rows[k][1][s:e] and e - s <= 52 for s, e in spans)
        assert hit >= 24, f
    assert got[1000][0] == 0


def test_spans_are_in_order(table):
    rng = random.Random(7)
    key = lambda: "".join(rng.choice(BASE62) for _ in range(40))
    rows = [(k, f"password=hunter{k}abc {key()} AKIA{'A1B2' * 4} {'0f' * 14} token: {key()} and {key()}") for k in range(20)]
    for r in secrets.find_secrets(table(rows)).collect():
        spans = [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in r["spans"].split(",")]
        base = [x for x in spans if x[0] != "random"]
        assert [x[1] for x in spans] == sorted(x[1] for x in spans) and [(s, e, k) for k, s, e in base] == secrets.base_spans(rows[r["doc_id"]][1])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r["n_random"] == len(spans) - len(base) and not any(x[1] < y[2] and y[1] < x[2] for x in spans if x[0] == "random" for y in base)


# --- language


def test_language(table, odd, empty):
    vocab = {"en": "the and of to with house water light".split(), "de": "der und von zu mit haus wasser licht straße".split(), "ru": "дом вода свет и с от".split()}
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(vocab[x]) for _ in range(rng.randint(5, 60))), x) for k, x in enumerate(list(vocab) * 80)]
    docs = table(rows + [(900, "12 34 !!", "en"), (901, None, "de"), (902, "the house", None)])
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in rows if got[i]["held_out"]]) > 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(odd)).collect()} == {"und"}
    assert langid.identify(empty, langid.train(empty)).count() == 0


def brute_kneser_ney(texts, order):
    """p(context, character) by the definition, over dicts; '#' stands for any character that was never seen."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = " " + t + " "
        for i in range(1, len(t)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    grams[k][t[i - k + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        before = Counter(g[1:] for g in {*grams[k + 1]})
        grams[k] = Counter({g: before.get(g, 1) for g in grams[k]})

    def p(context, c):
        k = len(context) + 1
        n1, n2 = (sum(n == x for n in grams[k].values()) for x in (1, 2))
        d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
        own = {g: n for g, n in grams[k].items() if g[:-1] == context}
        low = p(context[1:], c) if context else 1 / (len(grams[1]) + 1)
        if not own:
            return low
        total = sum(own.values())
        return (max(own.get(context + c, 0) - d, 0) + d * len(own) * low) / total

    return p


def test_kneser_ney_is_exact():
    texts = ["abcab cabba", "abba cab", "bacca abc", "a"]
    m = langid.fit([(k, t, "x") for k, t in enumerate(texts)] + [(50, "cab ddcab", "y")], order=3)
    apart = langid.Models(*m.__getstate__()[:-1], joint_bytes=0)
    for j, own in enumerate((texts, ["cab ddcab"])):
        p = brute_kneser_ney(own, 3)
        letters = sorted({c for t in own for c in t} | {" "})
        for context in ("ab", "ca", "bb", "zz", "az", " a", "cc"):
            total = 0.0
            for c in [*letters, "#"]:
                want = p(context, c)
                total += want
                for model in (m, apart):
                    got = math.exp(model.char_logs(np.array([*map(ord, context), ord(c)], np.uint32))[-1, j])
                    assert got == pytest.approx(want, rel=1e-4), (context, c)
            assert total == pytest.approx(1.0, abs=1e-6)


def test_short_and_rare_letters():
    m = langid.fit([(1, "a", "x"), (2, "b c", "y")])
    assert m.predict("a")[0] == "x" and m.predict("12 c 3")[0] == "y" and m.predict("12 3")[0] == "und"
    for t in ("\U0001d41a\U0001d41b", "\ud7b0", "\u3042", "\U00016800"):
        assert t[0].isalpha() and m.predict(t)[0] != "und"
    assert m.predict(None) == ("und", 0.0, None, True)


def test_long_texts_are_scored_whole():
    rng = random.Random(3)
    m = langid.fit([(k, " ".join(rng.choice(["ab", "bca", "cab", "dd"]) for _ in range(50)), "xy"[k % 2]) for k in range(40)])
    text = " ".join(rng.choice(["ab", "bca", "q", "dd"]) for _ in range(3000))
    assert m.entropies([text], chunk=500)[0] == pytest.approx(m.entropies([text])[0], rel=1e-6)


def test_every_language_is_calibrated():
    rng = random.Random(5)
    abc = "abcdefghijklmnop"
    rows = [(k, " ".join(rng.choice(abc[3 * (k % 5) : 3 * (k % 5) + 3]) * rng.randint(1, 4) for _ in range(30)), "lang%d" % (k % 5)) for k in range(1500)]
    m = langid.fit(rows)
    assert np.isfinite(m.limits).all() and m.predict("zzz yyy zyz")[3]


# --- mixing


def test_mixing_meets_targets(table):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randint(1, 30), rng.choice(["en", "de", None]), rng.choice(["s0"] * 5 + ["s1", "s2"]), None) for k in range(1500)]
    docs = table(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(r["tokens"] for r in got)
    for m in ("source", "lang"):
        had = Counter()
        raked = Counter()
        for r in got:
            had[r[m]] += r["tokens"]
            raked[r[m]] += r["tokens"] * r["ratio"]
        s = {k: v**mixing.TEMPER for k, v in had.items()}
        for k in had:
            assert raked[k] / total == pytest.approx(s[k] / sum(s.values()), abs=1e-6)
    assert sum(r["tokens"] * r["p"] for r in got) == pytest.approx(mixing.KEEP_SHARE * total, rel=1e-6)
    assert all(r["sample_weight"] * r["p"] == pytest.approx(r["ratio"]) for r in got)
    kept = {r["doc_id"] for r in got if r["sampled"]}
    assert {r["doc_id"] for r in mixing.keep_sampled(docs).collect()} == kept


def test_mixing_reads_texts_once(table, odd, monkeypatch):
    labels = []
    write = mixing.durable
    monkeypatch.setattr(mixing, "durable", lambda df, label: labels.append((label, "regexp_count" in df._jdf.queryExecution().toString())) or write(df, label))
    got = mixing.mix(odd, keep_share=0.4)
    assert [label for label, reads in labels if reads] == ["mix-rows"] and "regexp_count" not in got._jdf.queryExecution().toString()
    labels.clear()
    kept = mixing.keep_sampled(odd, keep_share=0.4)
    assert [label for label, reads in labels if reads] == ["mix-cells"]  # and once more for the rows themselves
    drawn = Counter(r["doc_id"] for r in got.collect() if r["sampled"])  # among them empty texts, whose cells weigh nothing
    assert Counter(r["doc_id"] for r in kept.collect()) == drawn and 0 < sum(drawn.values()) < odd.count()


def test_raking_round_has_one_join_a_margin(table, monkeypatch):
    cells = table([("a", "x", "t", 3.0), ("a", "y", "t", 1.0), ("b", "x", "t", 2.0), ("b", "y", "t", 2.0)], "source string, lang string, topic string, w double")
    goal = lambda **share: table(list(share.items()), "value string, share double")
    joins = {}
    write = mixing.durable
    monkeypatch.setattr(mixing, "durable", lambda df, label: joins.setdefault(label, df._jdf.queryExecution().analyzed().toString().count("Join Inner")) and None or write(df, label))
    got = mixing.rake(cells, {"source": goal(a=0.25, b=0.75), "lang": goal(x=0.5, y=0.5), "topic": goal(t=1.0)}).collect()
    assert joins["mix-1"] == 1 + 2 + 4  # the plan of a margin stands twice in that of the next
    assert sum(r["x"] for r in got if r["source"] == "a") == pytest.approx(2) and sum(r["x"] for r in got if r["lang"] == "x") == pytest.approx(4)


def test_mixing_odd(odd, empty):
    assert mixing.mix(clashing(odd)).count() == len(odd_rows())
    assert mixing.keep_sampled(clashing(odd)).columns == clashing(odd).columns
    assert mixing.mix(empty).count() == 0 and mixing.keep_sampled(empty).count() == 0


# --- licences


def test_licences(table, odd, empty):
    prose = "Some ordinary line of text about water and houses, with nothing else in it."
    rows = [(k, prose + f" {k}\n" + prose) for k in range(60)]
    rows += [(100, prose + "\nReleased under the MIT License.\n" + prose), (101, "All rights reserved."), (102, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.")]
    docs = table(rows)
    got = {r["doc_id"]: r for r in licences.scan_licences(docs, licences.train(docs)).collect()}
    assert got[100]["families"] == "mit" and got[101]["families"] == "proprietary" and got[102]["families"] == "apache,cc"
    assert not any(got[k]["families"] for k in range(60))
    assert licences.scan_licences(clashing(odd), licences.train(odd)).count() == len(odd_rows())
    assert licences.scan_licences(empty, licences.train(empty)).count() == 0


def test_wrapped_licences(table):
    import textwrap

    prose = "Some ordinary line of text about water and houses, with nothing else in it."
    rows, want = [(k, prose + f" {k}\n" + prose) for k in range(60)], {}
    for f in ("mit", "gpl", "bsd"):
        notice = max(licences.TEMPLATES[f], key=len)
        for width, mark in ((80, ""), (60, "# "), (40, "// ")):
            want[100 + len(want)] = f
            rows.append((99 + len(want), prose + "\n" + textwrap.fill(notice, width, initial_indent=mark, subsequent_indent=mark) + "\n" + prose))
    docs = table(rows)
    got = {r["doc_id"]: r for r in licences.scan_licences(docs, licences.train(docs)).collect()}
    assert {k: got[k]["families"] for k in want} == want and all(got[k]["n_notices"] >= got[k]["n_confirmed"] > 0 for k in want)
    assert not any(got[k]["families"] or got[k]["n_notices"] for k in range(60))


def test_licence_texts_and_unknown_families(table):
    import textwrap

    prose = "Some ordinary line of text about water and houses, with nothing else in it."
    texts, want = [prose + f" {k}\n" + prose for k in range(80)], {}
    full = {f: "\n\n".join(textwrap.fill(t, 72) for t in licences.TEMPLATES[f]) for f in ("mit", "bsd", "apache", "gpl")}
    for f, t in full.items():
        want[len(texts)] = f
        texts.append(f"{prose}\n\n{t}\n\n{prose}")
    want[len(texts)] = "isc"
    texts.append("/* " + textwrap.fill(licences.TEMPLATES["isc"][0], 60, subsequent_indent=" * ") + " */")
    strange = len(texts)
    texts.append("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.")
    docs = table(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in licences.scan_licences(docs, licences.train(docs)).collect()}
    assert all(f in got[k]["families"].split(",") for k, f in want.items())
    assert got[strange]["families"] == "" and got[strange]["n_confirmed"] == 0
    assert not any(got[k]["n_notices"] for k in range(80))


def test_licence_templates_are_constants(table):
    """Template shingles are worked out once, not by a lambda for every block; they and the signs are those of the columns."""
    import re

    docs = table([(1, "one\ntwo rights")])
    plan = licences.block_paragraphs(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 2  # the block's shingles, and where a held template's are
    ranges = re.compile(r"[\x00-,/:-@\[-`{-~-]")
    assert all(bool(ranges.match(chr(c))) == bool(re.match(licences.SIGNS, chr(c))) for c in range(0x3000))
    notices = [t for ts in licences.TEMPLATES.values() for t in ts]
    words = F.filter(licences.words_of(F.col("text")), lambda w: w != "")
    got = table(list(enumerate(notices))).select("doc_id", licences.shingles(words).alias("own"), words.alias("words")).collect()
    want = docs.select(*[licences.template_shingles(t) for t in notices]).first()
    assert all(r["own"] == want[r["doc_id"]] and r["words"] == licences.template_words(notices[r["doc_id"]]) for r in got) and len(got) == len(notices)


def test_licences_by_brute_force(table, odd):
    """Paragraphs, features, both models, limits and confirmation again, one paragraph after the other."""
    import re

    from pyspark.ml.feature import HashingTF

    rng = random.Random(3)
    prose = ["Water runs under the old house.", "Nobody knows the terms of this", "software that permission is granted for", "12 | 34 | 56", ""]
    notices = [t for ts in licences.TEMPLATES.values() for t in ts] + list(licences.UNTRAINED)
    docs = table([(k, "\n".join(rng.choice(prose) if rng.random() < 0.7 else rng.choice(notices) for _ in range(rng.randint(0, 6)))) for k in range(60)] + [(99, None), (99, "")])
    scanner = licences.train(docs)
    tf = HashingTF(numFeatures=licences.DIM, binary=True)
    slot = {}

    def words(t):
        return re.split(r"[\x00-,/:-@\[-`{-~-]+", t.lower())

    def sets(ws):
        return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}

    w0, b0 = scanner.notices.coefficients.toArray(), scanner.notices.intercept
    w1, b1 = scanner.families.coefficientMatrix.toArray(), scanner.families.interceptVector.toArray()
    names = list(licences.TEMPLATES)

    def judged(line):
        ws = words(line)
        at = {slot.setdefault(g, tf.indexOf(g)) for g in ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])]}
        if 1 / (1 + math.exp(-b0 - sum(w0[k] for k in at))) <= scanner.notice_limit:
            return None
        z = np.array([b1[f] + sum(w1[f, k] for k in at) for f in range(len(names))])
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if q.max() < scanner.family_limit:
            return "unknown", False
        own = [x for x in ws if x]
        for t in licences.TEMPLATES[names[q.argmax()]]:
            theirs = [x for x in words(t) if x]
            both = len(sets(own) & sets(theirs))
            if both >= 0.8 * len(sets(theirs)) or both >= 0.8 * len(sets(own)) or " ".join(x for x in words(t.rstrip(".")) if x) in " ".join(own):
                return names[q.argmax()], True
        return names[q.argmax()], False

    def blocks(t):
        for block in re.split(r"\n\s*\n", t):
            if "\n" in block.strip(" ") and re.search(licences.NEEDED, block):
                ws = [x for x in words(block) if x]
                own = sets(ws)
                for ts in licences.TEMPLATES.values():
                    if any(len(their := sets([x for x in words(t) if x])) > 1 and len(own & their) >= 0.8 * len(their) for t in ts):
                        every = set().union(*(sets([x for x in words(t) if x]) for t in ts))
                        at = [k for k in range(max(1, len(ws) - 4)) if " ".join(ws[k : k + 5]) in every]
                        found = judged(" ".join(ws[at[0] : at[-1] + 5]))
                        if found and found[1]:
                            yield found[0]

    want = []
    for r in docs.collect():
        t = r["text"] or ""
        found = [x for line in re.sub(licences.WRAP, r"\1 ", t).split("\n") if line and (x := judged(line))]
        by_line = {f for f, ok in found if ok}
        more = set(blocks(t)) - by_line
        want.append((r["doc_id"], len(found) + len(more), sum(ok for _, ok in found) + len(more), sum(f == "unknown" for f, _ in found), ",".join(sorted(by_line | more))))
    got = [tuple(r[c] for c in ("doc_id", "n_notices", "n_confirmed", "n_unknown", "families")) for r in licences.scan_licences(docs, scanner).collect()]
    assert sorted(got) == sorted(want) and sum(x[1] for x in want) > 30
    again = licences.train(docs.repartition(7))  # the sample is chosen by hash, so the model doesn't hang on the order of rows
    assert again.notice_limit == pytest.approx(scanner.notice_limit, abs=1e-6) and np.allclose(again.notices.coefficients.toArray(), w0, atol=1e-6)


# --- toxicity


def toxic_rows(rng, n, syllables, stems, every=6):
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    for k in range(n):
        t = [word() for _ in range(rng.randint(30, 80))]
        if k % every == 0:
            for _ in range(5):
                t[rng.randrange(len(t))] = rng.choice(stems) + rng.choice(["", *syllables])
        yield " ".join(t), int(k % every == 0)


def test_toxicity(table, odd, empty, labels):
    rng = random.Random(12)
    rows, lab, kind = [], [], {}
    for name, syll, stems in (("x", "the on er in an re at th".split(), ["blockhead", "zuckwurm", "quompf"]), ("y", "que la do ción mi tar".split(), ["brumasco", "vilño"]), ("z", "ein ung sch ver keit".split(), ["dröblich"])):
        for t, bad in toxic_rows(rng, 600, syll, stems):
            kind[len(rows)] = (name, bad)
            lab.append((len(rows), 1, bad))
            rows.append((len(rows), t))
    docs, labelled = table(rows), table(lab, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labelled)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    for name in "xyz":  # held-out recall of each language, and what is left alone
        held = [k for k in kind if kind[k][0] == name and got[k]["held_out"]]
        assert np.mean([got[k]["predicted"] for k in held if kind[k][1]]) >= 0.9, name
        assert np.mean([got[k]["predicted"] for k in held if not kind[k][1]]) <= 0.02, name
    assert toxicity.drop_toxic(docs, model).count() == sum(1 - r["predicted"] for r in got.values())
    out = toxicity.score_toxicity(clashing(odd), toxicity.train(odd, labels)).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(empty, toxicity.train(empty, labels)).count() == 0
    assert toxicity.drop_toxic(clashing(odd), model).columns == clashing(odd).columns
    odd_scores = {str(r["doc_id"]) + (r["score"] >= 0.7) * "!" for r in toxicity.score_toxicity(odd, model).collect()}
    assert not any("!" in x for x in odd_scores)


class Bad:
    """A model that finds texts toxic that begin with this word."""

    def scores(self, texts):
        return [float(t is not None and t.startswith("bad")) for t in texts]


def test_toxicity_stage_takes_small_batches_of_texts_alone(table, monkeypatch):
    """10,000 whole rows were one batch, which filled the executors' memory on large tables."""
    docs = table([(k, None if k % 50 == 7 else ("bad " if k % 3 == 0 else "good ") + f"word{k} " * 600, "en", "x" * 500, k) for k in range(6_000)], partitions=1)
    plain = type(docs).mapInArrow

    def watched(self, fn, schema, *rest):
        def run(batches):
            def small():
                for b in batches:
                    assert b.num_rows <= 512 and set(b.schema.names) == {"rid", "text"}
                    yield b

            yield from fn(small())

        return plain(self, run, schema, *rest)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    out = toxicity.drop_toxic(docs, Bad())
    assert out.columns == docs.columns and out.schema == docs.schema
    want = [r for r in docs.collect() if not (r["text"] or "").startswith("bad")]
    assert sorted(out.collect()) == sorted(want) and len(want) < 6_000


def test_released_frees_broadcasts(spark):
    used = lambda: spark._jvm.org.apache.spark.SparkEnv.get().memoryManager().storageMemoryUsed()
    common.released(spark)
    time.sleep(2)
    before = used()
    assert spark.range(10).join(F.broadcast(spark.range(300_000)), "id").count() == 10
    common.released(spark)
    end = time.time() + 20
    while used() > before + 1_000_000 and time.time() < end:
        time.sleep(0.2)
    assert used() <= before + 1_000_000


def test_toxicity_with_few_or_contradicting_labels(table):
    rng = random.Random(3)
    made = list(toxic_rows(rng, 90, "the on er in".split(), ["blockhead"], every=3))
    docs = table([(k, t) for k, (t, _) in enumerate(made)] * 2)
    both = table([(k, 1, y) for k, (_, y) in enumerate(made)] + [(k, 1, 1 - y) for k, (_, y) in enumerate(made)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.train(docs, both)).collect()  # every id counts as toxic, so nothing is learned
    assert {r["score"] for r in out} == {0.0} and len(out) == 180
    few = table([(0, 1, 1), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, toxicity.train(docs, few)).collect())


def test_sample_is_bounded(table):
    from kindred.llm import common

    docs = table([(k % 400, "t" * (k % 400)) for k in range(2000)])
    lab = table([(k % 400, 1, int(k % 4 == 0)) for k in range(800)], "doc_id long, quality int, toxic int")
    got = common.labelled_sample(docs, lab, "toxic", {0: 30, 1: 10}, F.lit(True), "s", 300)
    assert sum(y == 0 for _, _, y in got) <= 30 and sum(y == 1 for _, _, y in got) <= 10 and len(got) > 20
    assert len({i for i, _, _ in got}) == len(got) and all(len(t) == i <= 300 and y == int(i % 4 == 0) for i, t, y in got)


def test_windows_hold_every_word():
    rng = random.Random(1)
    for _ in range(200):
        words = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 3, 9, 200]))).encode() for _ in range(rng.randrange(12))]
        found = toxicity.windows_of(words)
        assert b"".join(w[len(toxicity.CARRIER) :] for w in found).replace(b" ", b"") == b"".join(words)
        assert all(len(w) <= toxicity.BYTES + len(toxicity.CARRIER) for w in found)


# --- pipeline


def test_pipeline_stages(spark, table, tmp_path, labels):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    base = " ".join(f"w{k % 131}" for k in range(400))
    rows = [(k, f"{base} {k // 2} tail{k // 2}", "en", "s", 1) for k in range(12)] + [(50, None, None, None, None)]
    docs = table(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        if name == "exact_dedup":
            assert out.where("doc_id < 50").count() == 6
        docs = out
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_pipeline_by_brute_force(spark, table, tmp_path, ranks):
    """Each stage on what the one before it kept, against plain code: scores, equal texts, similar texts, draws, tokens."""
    import corpus_pipeline

    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    made = list(toxic_rows(rng, 240, vocabulary[:40], ["blockhead", "zuckwurm"], every=4))
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, (t, _) in enumerate(made)]
    for g in range(12):  # equal texts, near copies above and below the limit
        base = [rng.choice(vocabulary) for _ in range(120)]
        for j, changes in enumerate((0, 0, 1, 2, 40)):
            t = list(base)
            for _ in range(changes):
                t[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((1000 + 10 * g + j, " ".join(t), None if g % 4 == 0 else "de", None if g % 3 == 0 else "s9", 1))
    rows += [(None, None, None, None, None), (5000, "", "en", "s0", 0), (5001, "", "en", "s0", 0), (None, "alone without an id", "en", "s0", 1), (7, "the row again", "en", "s1", 1), (7, "the row again", "en", "s1", 1), (5002, "x" * 30_000, "en", "s0", 1)]
    docs = clashing(table(rows))
    table([(k, 1, y) for k, (_, y) in enumerate(made)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, str(tmp_path)).write.parquet(path)
        kept[name] = (before, spark.read.parquet(path))
        before = kept[name][1]
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    had, has = kept["toxicity"]
    model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert has.columns == docs.columns and texts(has) == Counter((r["doc_id"], r["text"]) for r in had.collect() if model.score(r["text"]) < 0.7)
    assert sum(r["doc_id"] is not None and r["doc_id"] < 240 and made[r["doc_id"]][1] for r in has.collect()) <= 6

    had, has = kept["exact_dedup"]
    best = {}
    for r in had.collect():
        t = r["text"] or ""
        best[t] = max(best.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert Counter((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in has.collect()) == Counter((i, t) for t, i in best.items())

    had, has = kept["simhash_near_dedup"]
    own = [r["text"] or "" for r in had.collect()]
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in own]
    group = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    assert has.count() == len(set(group)) and len({group[own.index(r["text"] or "")] for r in has.collect()}) == has.count()
    assert len(set(group)) <= len(own) - 12  # the near copies are there

    had, has = kept["source_mixing"]
    drawn = Counter(r["doc_id"] for r in mixing.mix(had).collect() if r["sampled"])
    assert Counter(r["doc_id"] for r in has.collect()) == drawn and has.columns == docs.columns

    had, has = kept["byte_bpe"]
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in has.collect()) == sorted((str(r["doc_id"]), *bpe_truth(ranks, r["text"])) for r in had.collect())


def test_pipeline_of_an_empty_table(spark, empty, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
