"""Secret scan: known forms, then a battery of randomness tests with false-discovery control.

Known forms are assignments to secret-like names, access keys and long hexadecimal runs. Beyond them, every run of
MIN_LENGTH or more key characters is a candidate, less what known spans take of it; '=' only pads its end, so NAME=VALUE
gives the value. One that mixes the signs of two encodings, as a path before a key may, is cut into parts, tested each.
Its encoding is inferred: the smallest alphabet that holds it and of which it shows every class of characters (words
show no digits). It is tested as a string over that alphabet: chi-squared uniformity of the characters and of their
classes, a runs test above and below the middle of the alphabet, and lag-1 serial correlation. Fisher's method combines
the three p-values into one, uniform for random strings and near 0 for others.

False discoveries are controlled on these p-values, inside length strata over the whole corpus (short strings give the
tests less power, so their share of false discoveries is another): random strings are twice those over 1/2, which no other
string reaches in number; what is accepted beyond their expected number is false. The limit of a stratum is the least
p-value down to which the share of false discoveries stays within FDR; it is never over KEEP, so that no more random strings are lost.

Defined results: null counts as empty; a null doc_id stays null; repeated rows and ties are scanned alike, and extra columns
are never read; spans are in code points, end exclusive; added spans never overlap known ones. Texts are scanned whole.
"""

from __future__ import annotations

import bisect
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import durable, map_batches

KINDS = ("assign", "access", "hex", "random")
# The three known forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_LENGTH = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}=*" % MIN_LENGTH)
#: Characters that only some alphabets have, and runs without one kind of them: the parts of a candidate that mixes both.
PLAIN = re.compile(r"[A-Za-z0-9]+=*")
MIXED = (re.compile(r"[A-Za-z0-9_-]+=*"), re.compile(r"[A-Za-z0-9+/]+=*"))
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings as classes of characters, in the order of their alphabets; a string shows all of them but for signs.
ALPHABETS = (
    ("hex", (DIGITS, "abcdef"), ""),
    ("hex", (DIGITS, "ABCDEF"), ""),
    ("base32", (UPPER, "234567"), ""),
    ("base36", (UPPER, DIGITS), ""),
    ("base36", (LOWER, DIGITS), ""),
    ("base62", (UPPER, LOWER, DIGITS), ""),
    ("base64", (UPPER, LOWER, DIGITS), "+/"),
    ("base64url", (UPPER, LOWER, DIGITS), "-_"),
)
FDR = 0.05  # share of false ones among the discoveries of a stratum
KEEP = 0.02  # the least limit's p-value: at most this share of random strings is lost
BINS = 400  # p-value bins: -10 log2 p, rounded down


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known forms, leftmost and non-overlapping within a kind, by start and then kind."""
    out = []
    low = None
    if ":" in text or "=" in text:
        low = text.lower()
        if "pass" in low or "secret" in low or "token" in low or "api" in low:
            out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def infer_alphabet(s: str) -> tuple[str, tuple[str, ...], str] | None:
    """(name, classes, signs) of the first encoding that holds the characters, with each of its classes among them."""
    body = set(s.rstrip("="))
    return next(((name, classes, signs) for name, classes, signs in ALPHABETS if body <= set("".join(classes) + signs) and all(body & set(c) for c in classes)), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(s: str, classes: tuple[str, ...]) -> float:
    """Uniformity over the alphabet: the smaller p-value over single characters and over their classes, for two tests.

    Short strings have far less than one of each character, where only classes tell.
    """
    n, k = len(s), sum(map(len, classes))
    expected = n / k
    counts = [s.count(c) for c in set(s)]
    single = _chi_squared_tail(sum((c - expected) ** 2 for c in counts) / expected + (k - len(counts)) * expected, k - 1)
    x = sum((sum(map(s.count, c)) - expected * len(c)) ** 2 / (expected * len(c)) for c in classes)
    return 1 - (1 - min(single, _chi_squared_tail(x, len(classes) - 1))) ** 2


def runs_p(values: list[int], k: int) -> float:
    """Two-sided Wald-Wolfowitz runs test above and below the middle of the alphabet."""
    up = [v >= k / 2 for v in values]
    a = sum(up)
    b = len(up) - a
    if not a or not b:
        return 0.0
    runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
    n = a + b
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(values: list[int]) -> float:
    """Two-sided test of the lag-1 serial correlation."""
    n = len(values)
    m = sum(values) / n
    var = sum((v - m) ** 2 for v in values)
    if not var:
        return 0.0
    r = sum((x - m) * (y - m) for x, y in zip(values, values[1:])) / var
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def combined_p(ps: tuple[float, ...]) -> float:
    """Fisher's method: upper tail of chi-squared with two degrees of freedom for each p-value."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for k in range(1, len(ps)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def battery(s: str) -> tuple[str, float] | None:
    """(encoding, combined p-value of the randomness tests), or None where no encoding fits."""
    found = infer_alphabet(s)
    body = s.rstrip("=")
    if not found or len(body) < MIN_LENGTH:
        return None
    name, classes, signs = found
    classes = (*classes, signs) if signs else classes
    at = {c: k for k, c in enumerate("".join(classes))}
    v = [at[c] for c in body]
    return name, combined_p((chi_squared_p(body, classes), runs_p(v, len(at)), serial_p(v)))


def parts(s: str) -> list[tuple[int, int]]:
    """Spans of a candidate to test: itself if it fits an alphabet, else what is left between signs of another alphabet.

    A candidate with signs of base64 and of base64url is cut at either kind, and at both, so that a key next to
    a path or a name is a part of its own; parts shorter than MIN_LENGTH are no candidates.
    """
    if infer_alphabet(s):
        return [(0, len(s))]
    found = {m.span() for cut in MIXED for m in cut.finditer(s)} | {m.span() for m in PLAIN.finditer(s)}
    return sorted(x for x in found if len(s[x[0] : x[1]].rstrip("=")) >= MIN_LENGTH)


def _bin(p: float) -> int:
    return BINS - 1 if p <= 0 else min(BINS - 1, int(-10 * math.log2(p)))


def stratum(length: int) -> int:
    return min(12, length.bit_length())


def tested(s: str, at: int) -> list[dict]:
    """The tested parts of a candidate at a place; of parts that overlap, the most random and then the longest stays."""
    out = []
    for x, y in parts(s):
        got = battery(s[x:y])
        if got:
            out.append({"s": at + x, "e": at + y, "stratum": stratum(y - x), "bin": _bin(got[1])})
    # Chosen parts are disjoint, so one can only overlap those that start next to it.
    starts: list[int] = []
    chosen: list[dict] = []
    for c in sorted(out, key=lambda c: (c["bin"] > _bin(KEEP), c["s"] - c["e"], c["bin"], c["s"])):
        k = bisect.bisect_left(starts, c["e"])
        if k == 0 or chosen[k - 1]["e"] <= c["s"]:
            starts.insert(k, c["s"])
            chosen.insert(k, c)
    return chosen


def outside(start: int, end: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted, disjoint known spans leave of a span, in pieces of MIN_LENGTH or more."""
    out, at = [], start
    for x, y in known[max(0, bisect.bisect_right(known, (start, start)) - 1) :]:
        if x >= end:
            break
        if y > at:
            out.append((at, x))
            at = max(at, y)
    out.append((at, end))
    return [(x, y) for x, y in out if y - x >= MIN_LENGTH]


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e, _ in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the kinds, base (spans as text), candidates: array of (start, end, stratum, bin)."""

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                t = t or ""
                base = base_spans(t)
                n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                known = _merged(base)
                cands = []
                for m in CANDIDATE.finditer(t):
                    for s, e in outside(*m.span(), known) if known else [m.span()]:
                        cands += tested(t[s:e], s)
                out.append((i, *n, [f"{k}:{s}:{e}" for s, e, k in base], cands))
            yield out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base array<string>, candidates array<struct<s:int,e:int,stratum:int,bin:int>>"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(rows, schema, run)


def limit_of(counts: dict[int, int], rate: float = FDR) -> int:
    """The largest bin that is accepted, from the numbers of a stratum's candidates by bin.

    A p-value over 1/2 stands for two random strings; of those, the part over a limit's p-value is expected.
    """
    least = _bin(KEEP)
    random = 2 * sum(n for b, n in counts.items() if b < 10)
    best, total = least, sum(n for b, n in counts.items() if b <= least)
    for b in sorted(x for x in counts if x > least):
        total += counts[b]
        if total - random * (1 - 2 ** (-(b + 1) / 10)) <= rate * total:
            best = b
    return best


def discovery_limits(scanned: DataFrame, rate: float = FDR) -> dict[int, int]:
    """stratum -> largest bin accepted, over all candidates of the corpus; a row for each (stratum, bin), 13 * BINS at most, reaches the driver."""
    counts: dict[int, dict[int, int]] = {}
    for r in scanned.select(F.explode("candidates").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), F.col("c.bin").alias("bin")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    return {k: limit_of(v, rate) for k, v in counts.items()}


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs."""
    scanned = durable(scan(docs), "secrets-scan")
    limits = discovery_limits(scanned)
    lit_limits = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<int,int>")
    found = F.filter("candidates", lambda x: x["bin"] <= F.coalesce(F.try_element_at(lit_limits, x["stratum"]), F.lit(-1)))
    added = F.transform(found, lambda x: F.concat_ws(":", F.lit("random"), x["s"].cast("string"), x["e"].cast("string")))
    # Added spans overlap no known span, so order by start alone decides between them.
    both = F.array_sort(F.concat("base", added), lambda a, b: F.when(_start(a) != _start(b), _start(a) - _start(b)).otherwise(_kind(a) - _kind(b)))
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.concat_ws(",", "base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", both).alias("spans"),
        F.size(found).cast("long").alias("n_random"),
    )


def _start(span):
    return F.split(span, ":")[1].cast("int")


def _kind(span):
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(span, ":")[0]).cast("int")


__all__ = ["battery", "base_spans", "discovery_limits", "find_secrets", "scan"]
