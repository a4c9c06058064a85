"""Jaro-Winkler similarity and the array comparators built on it, as Arrow-batched UDFs: all names of a batch are compared at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from kindred.functions.jaro import best_of_each, jaro_winkler, of_arrays, of_pairs

def _batched(f):
    """A vectorised UDF of doubles that Catalyst may not evaluate twice, as it does when it moves a filter on its result below it."""
    return F.pandas_udf(f, DoubleType()).asNondeterministic()


def _series(values) -> pd.Series:
    return pd.Series(values, dtype="float64")


def _similarities(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(of_arrays(a, b))


_jw = F.arrow_udf(_similarities, DoubleType()).asNondeterministic()


def jw(a: Column, b: Column) -> Column:
    """Jaro-Winkler of two strings; null counts as empty."""
    return _jw(F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit("")))


def _greatest(a: pa.Array, b: pa.Array) -> pa.Array:
    best, rows, _ = best_of_each(a, b)
    out = np.zeros(len(a))
    np.maximum.at(out, rows, best)
    return pa.array(out)


_jw_max = F.arrow_udf(_greatest, DoubleType()).asNondeterministic()


def shares_over(a: pa.Array, b: pa.Array, threshold: np.ndarray) -> pa.Array:
    """Share of each row's elements of a whose best match in b is over the row's threshold; 0 if a has none."""
    best, rows, size = best_of_each(a, b)
    return pa.array(np.bincount(rows[best > threshold[rows]], minlength=len(a)) / np.maximum(size, 1))


def jw_max(a: Column, b: Column) -> Column:
    """Largest Jaro-Winkler over the elements of two string arrays; 0 if either has none."""
    return _jw_max(a, b)


def jw_rate(a: Column, b: Column, threshold: float) -> Column:
    """Share of a's elements whose best match in b is over the threshold; 0 if a has none."""

    def rate(p: pa.Array, q: pa.Array) -> pa.Array:
        return shares_over(p, q, np.full(len(p), threshold))

    return F.arrow_udf(rate, DoubleType()).asNondeterministic()(a, b)


def _people(col: Column, **fields: str) -> list[Column]:
    """Parallel arrays of the named struct fields: plain arrays cross to Python without struct conversion."""
    def one(name: str) -> Column:
        return F.transform(col, lambda p: p[name])

    return [one(f) for f in fields.values()]


def _rows(*arrays) -> list[tuple]:
    return [] if any(x is None for x in arrays) else list(zip(*arrays))


def _gap(x, y) -> float:
    return float("inf") if x is None or y is None or x != x or y != y else abs(x - y)


def related_jw(a: Column, b: Column, threshold: float, years: float, name: str = "namefrst_std", birth: str = "birthyr", sex: str = "sex") -> Column:
    """How many people of b have somebody in a with a similar name, close birth year and the same sex."""

    @_batched
    def count(an: pd.Series, ab: pd.Series, asx: pd.Series, bn: pd.Series, bb: pd.Series, bsx: pd.Series) -> pd.Series:
        rows = [(_rows(*row[:3]), _rows(*row[3:])) for row in zip(an, ab, asx, bn, bb, bsx)]
        return _series(related_counts(rows, [threshold] * len(rows), [years] * len(rows)))

    fields = {"n": name, "b": birth, "s": sex}
    return count(*_people(a, **fields), *_people(b, **fields))


def _alike(rows: list[tuple], fits) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """((row, person of theirs, person of ours) for the pairs of people that fit, similarities of their names), all names of a batch at once."""
    where = [(k, j, i) for k, (ours, theirs) in enumerate(rows) for j, q in enumerate(theirs) for i, p in enumerate(ours) if fits(k, p, q)]
    names = [[rows[k][side][x][0] or "" for k, *both in where for x in (both[1 - side],)] for side in (0, 1)]
    return where, of_pairs(*names)


def related_counts(rows: list[tuple], thresholds: list[float], years: list[float]) -> np.ndarray:
    """For each (ours, theirs): how many of theirs have somebody in ours of the same sex, a close birth year and a similar name. People are (name, birth year, sex)."""
    where, x = _alike(rows, lambda k, p, q: p[2] == q[2] and _gap(q[1], p[1]) <= years[k])
    found = {(k, j) for (k, j, _), s in zip(where, x.tolist()) if s >= thresholds[k]}
    return np.bincount(np.array([k for k, _ in found], np.int64), minlength=len(rows)).astype(float)


def extra_counts(rows: list[tuple], years_b: list[float], thresholds: list[float], years: list[float]) -> np.ndarray:
    """For each (ours, theirs): children of theirs that match none of ours. People are (name, birth year, sex, relate).

    Matches are made best first; each child takes part in one at most.
    """
    child = lambda p: p[3] is not None and 300 <= p[3] < 400
    old = lambda p, year: p[1] is not None and year - p[1] >= 11
    kids = [([p for p in ours if child(p)], [p for p in theirs if child(p) and old(p, year)]) for (ours, theirs), year in zip(rows, years_b)]
    where, x = _alike(kids, lambda k, p, q: p[2] == q[2] and _gap(p[1], q[1]) <= years[k])
    used_a, used_b = set(), set()
    close = sorted((k, -s, n) for n, ((k, _, _), s) in enumerate(zip(where, x.tolist())) if s >= thresholds[k])
    for k, _, n in close:  # of equal matches the first
        _, j, i = where[n]
        if (k, i) not in used_a and (k, j) not in used_b:
            used_a.add((k, i))
            used_b.add((k, j))
    matched = np.bincount(np.array([k for k, _ in used_b], np.int64), minlength=len(rows))
    return np.array([len(theirs) for _, theirs in kids], np.int64) - matched


def count_extra_children(ours: list[tuple], theirs: list[tuple], year: float, threshold: float, years: float) -> float:
    """extra_counts() of one row."""
    return float(extra_counts([(ours, theirs)], [year], [threshold], [years])[0])


def extra_children(
    a: Column, b: Column, year_b: Column, relate_a: Column, relate_b: Column, threshold: float, years: float,
    name: str = "namefrst_std", birth: str = "birthyr", sex: str = "sex", relate: str = "relate",
) -> Column:
    """Children in b that no child in a matches; 0 where either person is no kin of the head (relate over 399).

    Children have relate codes 300 to 399 and are 11 or older in year_b.
    """

    @_batched
    def count(an: pd.Series, ab: pd.Series, asx: pd.Series, ar: pd.Series, bn: pd.Series, bb: pd.Series, bsx: pd.Series, br: pd.Series, yb: pd.Series, ra: pd.Series, rb: pd.Series) -> pd.Series:
        kin = [x is not None and y is not None and x <= 399 and y <= 399 for x, y in zip(ra, rb)]  # NaN compares false
        rows = [(_rows(*row[:4]), _rows(*row[4:])) if k else ([], []) for k, *row in zip(kin, an, ab, asx, ar, bn, bb, bsx, br)]
        return _series(extra_counts(rows, list(yb), [threshold] * len(rows), [years] * len(rows)))

    fields = {"n": name, "b": birth, "s": sex, "r": relate}
    return count(*_people(a, **fields), *_people(b, **fields), year_b.cast("long"), relate_a.cast("long"), relate_b.cast("long"))


def compare_rates(rows: list[tuple]) -> np.ndarray:
    """For each (ours, theirs): the share of theirs for whom somebody in ours scores over 3.9. People are (name, birth year, place, sex).

    A name over 0.8 counts 2, the others 1 each, so the name and two others have to agree.
    """
    where, x = _alike(rows, lambda k, p, q: sum(p[x] == q[x] for x in (1, 2, 3)) >= 2)
    found = {(k, j) for (k, j, _), s in zip(where, x.tolist()) if s > 0.8}
    hits = np.bincount(np.array([k for k, _ in found], np.int64), minlength=len(rows))
    return hits / np.maximum([len(theirs) for _, theirs in rows], 1)


def hh_compare_rate(a: Column, b: Column, name: str = "namefrst_std", birth: str = "birthyr", bpl: str = "bpl", sex: str = "sex") -> Column:
    """Share of b's people for whom somebody in a scores over 3.9: name over 0.8 counts 2, birth year, place and sex 1 each."""

    @_batched
    def rate(an: pd.Series, ab: pd.Series, ap: pd.Series, asx: pd.Series, bn: pd.Series, bb: pd.Series, bp: pd.Series, bsx: pd.Series) -> pd.Series:
        return _series(compare_rates([(_rows(*row[:4]), _rows(*row[4:])) for row in zip(an, ab, ap, asx, bn, bb, bp, bsx)]))

    fields = {"n": name, "b": birth, "p": bpl, "s": sex}
    return rate(*_people(a, **fields), *_people(b, **fields))


def has_matching_element(a: Column, b: Column) -> Column:
    """Whether two arrays share an element; false if either is null."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


# --- the same by name, for expressions in configurations


def _struct_rows(x, *names: str) -> list[tuple]:
    return [] if x is None else [tuple(p.get(n) for n in names) for p in x]


def _vectors(v: pd.DataFrame) -> list[list[float] | None]:
    """Vectors as they cross to Arrow, as frames of type (1: dense), size, indices and values; None for null."""
    out: list[list[float] | None] = []
    for kind, size, indices, values in zip(v["type"], v["size"], v["indices"], v["values"]):
        if values is None:
            out.append(None)
        elif indices is None:
            out.append([float(x) for x in values])
        else:
            full = [0.0] * int(size)
            for k, x in zip(indices, values):
                full[k] = float(x)
            out.append(full)
    return out


def register_functions(spark: SparkSession) -> None:
    """Make the comparators callable in SQL expressions (jw, jw_max, jw_rate, rel_jw, extra_children, ...).

    What Spark expresses itself becomes a SQL function, so it stays in the plan; the similarity family is Arrow-batched.
    """

    def over(a: pa.Array, b: pa.Array, t: pa.Array) -> pa.Array:
        return shares_over(a, b, t.to_numpy(zero_copy_only=False).astype("float64"))

    rate = F.arrow_udf(over, DoubleType()).asNondeterministic()

    @_batched
    def related(a: pd.Series, b: pd.Series, t: pd.Series, years: pd.Series, names: pd.Series) -> pd.Series:
        rows = []
        for x, y, m in zip(a, b, names):
            m = dict(m)
            cols = (m.get("name", "namefrst_std"), m.get("byr", "birthyr"), m.get("sex", "sex"))
            rows.append((_struct_rows(x, *cols), _struct_rows(y, *cols)))
        return _series(related_counts(rows, [float(u) for u in t], [float(v) for v in years]))

    @_batched
    def extra(a: pd.Series, b: pd.Series, year: pd.Series, ra: pd.Series, rb: pd.Series, t: pd.Series, years: pd.Series, names: pd.Series) -> pd.Series:
        rows = []
        for x, y, p, q, m in zip(a, b, ra, rb, names):
            m = dict(m)
            cols = (m.get("name", "namefrst_std"), m.get("byr", "birthyr"), m.get("sex", "sex"), m.get("relate", "relate"))
            kin = p is not None and q is not None and p <= 399 and q <= 399
            rows.append((_struct_rows(x, *cols), _struct_rows(y, *cols)) if kin else ([], []))
        return _series(extra_counts(rows, [float(z) for z in year], [float(u) for u in t], [float(v) for v in years]))

    @_batched
    def households(a: pd.Series, b: pd.Series) -> pd.Series:
        cols = ("namefrst_std", "birthyr", "bpl", "sex")
        return _series(compare_rates([(_struct_rows(x, *cols), _struct_rows(y, *cols)) for x, y in zip(a, b)]))

    @_batched
    def match_probability(v: pd.DataFrame) -> pd.Series:
        return _series([x[1] if x is not None and len(x) > 1 else 0.0 for x in _vectors(v)])

    @F.pandas_udf(StringType())
    def as_text(v: pd.DataFrame) -> pd.Series:
        return pd.Series([None if x is None else "[" + ",".join(map(str, x)) + "]" for x in _vectors(v)], dtype=object)

    for name, f in (("jw", _jw), ("jw_max", _jw_max), ("jw_rate", rate), ("rel_jw", related), ("extra_children", extra), ("hh_compare_rate", households), ("parseProbVector", match_probability), ("vector_to_string", as_text)):
        spark.udf.register(name, f)
    for text in (
        "has_matching_element(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN RETURN coalesce(arrays_overlap(a, b), false)",
        "array_to_string(a ARRAY<STRING>) RETURNS STRING RETURN concat('[', array_join(a, ','), ']')",
        "extract_neighbors(a ARRAY<STRUCT<serial: BIGINT, value: STRING>>, own BIGINT) RETURNS ARRAY<STRING> RETURN transform(filter(a, x -> x.serial <> own), x -> x.value)",
        "hh_rows_get_first_value(a ARRAY<STRUCT<serial: BIGINT, pernum: BIGINT, value: STRING>>) RETURNS STRUCT<serial: BIGINT, value: STRING> "
        "RETURN transform(array_sort(transform(a, x -> named_struct('pernum', x.pernum, 'serial', x.serial, 'value', x.value))), x -> named_struct('serial', x.serial, 'value', x.value))[0]",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


__all__ = ["extra_children", "has_matching_element", "hh_compare_rate", "jaro_winkler", "jw", "jw_max", "jw_rate", "register_functions", "related_jw"]
