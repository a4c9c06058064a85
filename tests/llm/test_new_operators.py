"""Substring dedup, hard negatives, filter audit and stable row numbers against brute force."""

import random
from itertools import permutations

import pytest
from tests.llm.conftest_llm import clashing, recored

from kindred.llm import audit, common, negatives, substrings
from pyspark.sql import functions as F


# --- row numbers


def test_row_numbers_hold_whatever_the_cores(table, spark):
    docs = table([(k, f"text {k}") for k in range(400)], partitions=7)
    with recored(spark, 24):
        one = {r["doc_id"]: r["rid"] for r in common.numbered(docs).collect()}
    with recored(spark, 2):
        two = {r["doc_id"]: r["rid"] for r in common.numbered(docs.select("doc_id")).collect()}
    assert one == two and len(set(one.values())) == 400
    again = common.scanned(docs.repartition(3))
    assert common.scanned(docs) is docs and again is not docs and common.numbered(again).count() == 400
    odd = docs.withColumns({"_metadata": F.lit(1), "__path": F.lit("x"), "__row": F.lit("y")})
    assert {r["doc_id"]: r["n"] for r in common.numbered(odd, "n").collect()} == one
    assert common.numbered(odd, "n").columns == [*odd.columns, "n"]


# --- substring dedup


def brute_removed(rows, width):
    """(n_words, kept words) by row number."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        words = (rows[k][1] or "").encode().split()
        gone = set()
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            if w in seen:
                gone.update(range(s, s + width))
            seen.add(w)
        out[k] = (len(words), [w.decode() for j, w in enumerate(words) if j not in gone])
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(25), text(40), text(19), text(20), ["same"] * 50]
    rows = []
    for k in range(120):
        words = text(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, rows[5][1]) for k in range(60)]  # a group of copies
    return rows


@pytest.mark.parametrize("hot", [3, 10_000])
def test_remove_repeats(table, spark, passages, hot):
    docs = table(passages)
    with recored(spark, 16):
        found = {r["doc_id"]: r for r in substrings.remove_repeats(clashing(docs), hot=hot).collect()}
    want = brute_removed(passages, 20)
    for k, (doc_id, text) in enumerate(passages):
        n, kept = want[k]
        r = found[doc_id]
        assert (r["n_words"], r["kept"]) == (n, " ".join(kept))
        assert sum(s["end"] - s["start"] for s in r["spans"]) == n - len(kept)
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    assert len(found) == len(passages)


def test_remove_repeats_odd_rows(odd, empty):
    rows = substrings.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 2
    assert all(r["kept"] == "" and r["n_words"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert [r["n_words"] for r in rows if r["doc_id"] == 6] == [60_000]
    assert substrings.remove_repeats(empty).count() == 0


def test_repeated_rows_keep_one(table):
    text = " ".join(f"w{k}" for k in range(30))
    rows = substrings.remove_repeats(table([(7, text), (7, text), (None, text), (9, text)], partitions=1)).collect()
    assert sorted(r["kept"] for r in rows) == ["", "", "", text] and [r["kept"] for r in rows if r["doc_id"] is None] == [""]


def test_automaton_knows_first_places():
    rng = random.Random(3)
    for _ in range(60):
        fragments = [([rng.choice("abc") for _ in range(rng.randrange(4, 12))], k << substrings.PLACE) for k in range(8)]
        seen, want = set(), []
        for words, _ in fragments:
            bits = 0
            for s in range(len(words) - 3):
                w = tuple(words[s : s + 4])
                bits |= (w not in seen) << s
                seen.add(w)
            want.append(bits)
        order = list(range(8))
        rng.shuffle(order)
        got = substrings.first_windows([fragments[k] for k in order], 4)
        assert [got[order.index(k)] for k in range(8)] == want


def test_matching_spans(table, spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(30)}" for _ in range(n)]
    reference = [words(30), words(5), words(60)]
    rows = [(0, None), (1, " ".join(words(40)))]
    for k in range(2, 30):
        a = rng.choice(reference)
        s = rng.randrange(len(a))
        rows.append((k, " ".join(words(9) + a[s : s + rng.randrange(20)] + words(9))))
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in substrings.matching_spans(table(rows), table([(0, " ".join(a)) for a in reference] + [(1, None)]), width=6).collect()}
    grams = {tuple(a[s : s + 6]) for a in reference for s in range(len(a) - 5)}
    for doc_id, text in rows:
        w = (text or "").split()
        covered = {j for s in range(len(w) - 5) if tuple(w[s : s + 6]) in grams for j in range(s, s + 6)}
        assert {j for s, e in found[doc_id] for j in range(s, e)} == covered
    with pytest.raises(ValueError):
        old, substrings.BROADCAST_WORDS = substrings.BROADCAST_WORDS, 10
        try:
            substrings.matching_spans(table(rows), table([(0, " ".join(reference[0]))]))
        finally:
            substrings.BROADCAST_WORDS = old


# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, positives=5, negatives_=10, low=30, high=90):
    import math

    fit = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        q = (y, [math.floor(256 * float(F32(x))) for x in v])
        fit[i] = min(fit.get(i, q), q)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (y, v) in fit.items():
        if a % 10:
            continue
        scored = sorted((-dot(v, w), b, z) for b, (z, w) in fit.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            p_score, rank = -s, 0
            for t, b, z in scored:
                if z != y and low * p_score <= 100 * -t <= high * p_score and rank < negatives_:
                    rank += 1
                    out.add((a, p, rank, b, p_score, -t))
    return out


def F32(x):
    import numpy as np

    return np.float32(x)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_hard_negatives(table, spark, spread):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        scale = 2.0 ** (rng.random() * spread)
        v = [rng.gauss(0.3, 1) * scale for _ in range(6)]
        rows.append((k, v if k % 9 else rows[0][1] if rows else v, k % 3))  # a ninth of all are one vector
    rows += [(None, [1.0], 1), (1001, None, 1), (1002, [float("nan")], 1), (1003, [float("inf")], 0), (1004, [None], 0), (1005, [1.0], None), (1006, [], 0), (1010, [0.5, 2.0], 1), (20, [0.0, 1.0], 0), (20, [0.0, 1.0], 0)]
    vectors = table(rows, VECTORS).withColumns({"query": F.lit("x"), "id": F.lit(1), "block": F.lit(2)})
    old = negatives.LEAST_CELL, negatives.ANCHORS
    negatives.LEAST_CELL, negatives.ANCHORS = 16, 20
    try:
        found = [tuple(r) for r in negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0).collect()]
    finally:
        negatives.LEAST_CELL, negatives.ANCHORS = old
    assert len(found) == len(set(found)) and set(found) == brute_negatives(rows)


def test_hard_negatives_of_nothing(table):
    assert negatives.hard_negatives(table([], VECTORS), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(table([(1, [1.0], 0), (10, [1.0], 0)], VECTORS), F.lit(False)).count() == 0


def test_products_are_exact():
    import numpy as np

    a, c = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0], [1.0, 1.0]])
    assert negatives.products(a, c).tolist() == [[2**60 + 15, 2**40 + 3]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_norm_bounds_skip_what_cant_help():
    """A cell whose norms are too small isn't multiplied at all."""
    import numpy as np

    cell = {"id": np.arange(5), "label": np.ones(5, np.int64), "v": [np.array([1.0, 0.0])] * 5, "norm2": np.ones(5)}
    one = {"query": np.array([7]), "id": np.array([99]), "label": np.array([0]), "v": [np.array([3.0, 4.0])], "norm2": np.array([25.0]), "low": np.array([6]), "high": np.array([100]), "kth": np.array([-(2**63)])}
    called = []
    old, negatives.products = negatives.products, lambda a, c: called.append(1)
    try:
        assert list(negatives.best_of_cell(one, cell, 3, False)) == [] and not called
    finally:
        negatives.products = old
    assert negatives._waves([(0, 10), (1, 10), (2, 100), (3, 5)], 8) == [(0, 0), (1, 1), (2, 2), (3, 3)]


# --- filter audit


def brute_audit(rows, told):
    fails = {}
    firsts = {}
    for r in rows:
        if r[0] is not None:
            firsts[r[1] or ""] = min(firsts.get(r[1] or "", r[0]), r[0])
    counts = {}
    for doc_id, text, source in rows:
        t = text or ""
        words = t.encode().split()
        m = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        m["E"] = doc_id is not None and firsts[t] < doc_id
        key = (source or "", frozenset(k for k, v in m.items() if v))
        n = counts.setdefault(key, [0, 0, 0])
        n[0] += 1
        n[1] += told.get(doc_id, (0, 0))[0] == 1
        n[2] += told.get(doc_id, (0, 0))[1] == 1
    out = {}
    for part in {k[0] for k in counts}:
        own = {k[1]: v for k, v in counts.items() if k[0] == part}
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                total = lambda which, j=0: sum(v[j] for m, v in own.items() if which(m))  # noqa: B023, E731
                gone = lambda m: f in m and not m & before  # noqa: B023, E731
                out[part, "".join(order), step] = [total(lambda m: f not in m and not m & before), total(gone), total(lambda m: f in m and m & before), total(lambda m: m == {f}), total(gone, 1), total(gone, 2)]  # noqa: B023
    sums = {}
    for (part, order, step), v in out.items():
        sums[part, order[step - 1]] = sums.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(table, spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["word", "Other", "THIRD", "x#", "long%", f"w{k}"]) for k in range(rng.randrange(1, 200))) for _ in range(30)]
    rows = [(k, rng.choice(base) if k % 3 else " ".join(f"u{k}v{j}" for j in range(80)), rng.choice(["a", "b", None, ""])) for k in range(150)]
    rows += [(None, None, "a"), (None, "", None), (200, None, "b"), (201, "", "b"), (202, "", "b"), (5, rows[5][1], "a"), (5, rows[5][1], "a"), (300, "y " * 30_000, "a"), (301, "y " * 30_000, "c"), (302, "y " * 29_999 + "z ", "c")]
    told = {k: (k % 2, int(k % 5 == 0)) for k in range(0, 210)}
    docs = table([(i, t, "en", s) for i, t, s in rows])
    labels = table([(i, *x) for i, x in told.items()] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    odd = clashing(docs).withColumns({"part": F.lit(1), "mask": F.lit(2), "body": F.lit("x")})
    with recored(spark, 16):
        found = audit.audit(odd, labels).collect()
    want = brute_audit(rows, told)
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == want and len(found) == len(want)


def test_audit_compares_texts_where_hashes_collide(table, monkeypatch):
    rows = [(k, "abc"[k % 3] * 10, None, "s") for k in range(9)]
    monkeypatch.setattr(audit, "_chain", lambda text, n: F.array(F.lit(1).cast("long")))
    counts, _ = audit.masks(table(rows), table([], "doc_id long, quality int, toxic int"))
    assert sum(r["n"] for r in counts.collect() if r["mask"] & 16) == 6


def test_audit_of_nothing(empty, table):
    assert audit.audit(empty, table([], "doc_id long, quality int, toxic int")).count() == 0


# --- stable row numbers in the operators that join what they find back to rows


def _texts():
    rng = random.Random(21)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 90))) for _ in range(150)]
    rows = [(k, base[k % 150] if k % 4 else base[k % 150] + f" x{k}") for k in range(450)]
    return [(k, t + ("\nReleased under the MIT License." if k % 9 == 0 else "")) for k, t in rows]


class Longer:
    """A stand-in for a trained model: texts with an odd number of words are toxic."""

    def scores(self, texts):
        return [float(len(x.split()) % 2) for x in texts]


@pytest.mark.parametrize("name", ["keep_distinct", "exact_dedup", "keep_dissimilar", "drop_toxic", "scan_licences", "round_trip", "keep_sampled"])
def test_results_hold_when_cores_change_between_scans(table, spark, name):
    from kindred.llm import bpe, dedup, licences, mixing, queries, simhash, toxicity

    docs = table([(k, t, "en", f"s{k % 3}") for k, t in _texts()], partitions=9)
    t = queries._tokenizers()
    ranks = bpe.read_ranks(t.path(queries.BPE_FILE)) if name == "round_trip" else None
    scanner = licences.train(docs) if name == "scan_licences" else None

    run = {
        "keep_distinct": lambda d: dedup.keep_distinct(d), "exact_dedup": lambda d: dedup.exact_dedup(d, 64), "keep_dissimilar": lambda d: simhash.keep_dissimilar(d), "drop_toxic": lambda d: toxicity.drop_toxic(d, Longer()),
        "scan_licences": lambda d: licences.scan_licences(d, scanner), "round_trip": lambda d: bpe.round_trip(d, ranks, t.PATTERN, 3000), "keep_sampled": lambda d: mixing.keep_sampled(d),
    }[name]
    tidy = lambda df: sorted(map(repr, df.collect()))
    still = tidy(run(docs))
    with recored(spark, 24):
        moved = tidy(run(clashing(docs).select(*docs.columns)))
        assert len(docs.collect()) == 450
    assert moved == still and still
    if name in ("keep_distinct", "keep_dissimilar", "drop_toxic", "keep_sampled"):
        odd = clashing(docs)
        kept = run(odd)
        assert kept.columns == odd.columns and tidy(kept.select(*docs.columns)) == still
        assert {r["__rid"] for r in kept.collect()} == {"mine"}


def test_near_copies_keep_the_largest_id(table):
    from kindred.llm import simhash

    text = " ".join(f"w{k}" for k in range(200))
    rows = [(5, text), (9, text + " end"), (7, "start " + text), (None, text + " a"), (1, "other words of another text " * 8)]
    assert sorted(r["doc_id"] for r in simhash.keep_dissimilar(table(rows)).collect()) == [1, 9]


def test_contradicting_targets_are_reported(table):
    from kindred.llm import mixing

    # Source b has all texts of language y and no other: both can't have the share of their own target.
    rows = [(k, "w " * 10, "x" if k % 2 else "y", "a" if k % 2 else "b") for k in range(100)]
    share = lambda **s: table(list(s.items()), "value string, share double")
    got = mixing.mix(table(rows), {"source": share(a=0.5, b=0.5), "lang": share(x=0.9, y=0.1)}).collect()
    assert min(r["margin_error"] for r in got) > 0.1
    fine = mixing.mix(table(rows), {"source": share(a=0.7, b=0.3), "lang": share(x=0.7, y=0.3)}).collect()
    assert max(r["margin_error"] for r in fine) < 1e-8


def test_long_mixed_candidates_take_linear_time():
    import time

    from kindred.llm import secrets

    rng = random.Random(5)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789") if rng.random() < 0.96 else rng.choice("-/") for _ in range(2_000_000))

    def all_pairs(s, at):
        out = [{"s": at + x, "e": at + y, "stratum": secrets.stratum(y - x), "bin": secrets._bin(got[1])} for x, y in secrets.parts(s) if (got := secrets.battery(s[x:y]))]
        chosen = []
        for c in sorted(out, key=lambda c: (c["bin"] > secrets._bin(secrets.KEEP), c["s"] - c["e"], c["bin"], c["s"])):
            if not any(c["s"] < d["e"] and d["s"] < c["e"] for d in chosen):
                chosen.append(c)
        return sorted(chosen, key=lambda c: c["s"])

    for k in range(0, 40_000, 4000):
        assert secrets.tested(line[k : k + 4000], 7) == all_pairs(line[k : k + 4000], 7)
    began = time.time()
    assert len(secrets.tested(line, 0)) > 1000 and time.time() - began < 120


# --- toxicity: windows, gains and scores again, one window after the other, from the model's two dictionaries


def test_toxicity_by_brute_force(table):
    import math

    import zstandard as zs

    from kindred.llm import toxicity

    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["the", "on", "er", "in", "an", "re"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for k in range(400):
        t = [word() for _ in range(rng.randint(5, 70))]
        if k % 5 == 0:
            for _ in range(6):
                t[rng.randrange(len(t))] = rng.choice(["blockhead", "zuckwurm", "quompf", "Zuckwurme"])
        rows.append((k, " ".join(t)))
        labels.append((k, 1, int(k % 5 == 0)))
    rows += [(500, None), (501, ""), (502, "x" * 700), (503, "blockhead " * 9), (504, "Ünï ☃ " * 40)]
    docs = table(rows)
    model = toxicity.train(docs, table(labels, "doc_id long, quality int, toxic int"))
    settings = zs.ZstdCompressionParameters(
        window_log=16, hash_log=14, chain_log=14, search_log=5, min_match=5, target_length=64, strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    packers = []
    for data in (model.pair.ordinary, model.pair.toxic):
        d = zs.ZstdCompressionDict(data + toxicity.CARRIER + b"\n" * 16, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=settings)
        packers.append(zs.ZstdCompressor(dict_data=d, compression_params=settings))

    def windows(text):
        words = (text or "").lower().encode().split()
        for k in range(0, len(words), toxicity.WORDS):
            now = b""
            whole = b"".join(b" " + w for w in words[k : k + toxicity.WORDS])
            pieces = [whole] if len(whole) <= toxicity.BYTES else [b" " + w[s : s + toxicity.BYTES - 1] for w in words[k : k + toxicity.WORDS] for s in range(0, len(w), toxicity.BYTES - 1)]
            for p in pieces:
                if now and len(now) + len(p) > toxicity.BYTES:
                    yield now
                    now = b""
                now += p
            yield now

    def score(text):
        total = n = 0.0
        for w in windows(text):
            gain = len(packers[0].compress(toxicity.CARRIER + w)) - len(packers[1].compress(toxicity.CARRIER + w))
            total += model.weights[sum(len(w) > x for x in toxicity.LENGTHS), min(max(gain, 0), toxicity.MOST)]
            n += 1
        mean, var = model.noise
        x = (min((total - n * mean) / math.sqrt(n * var + 1), 30) / 3, math.log1p(total), math.log1p(n))
        return 1 / (1 + math.exp(-(model.curve[0] + sum(b * v for b, v in zip(model.curve[1:], x)))))

    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(score(t), abs=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    assert sum(r["predicted"] for r in got.values()) > 50
