"""Comparison features: a typed spec over the sides `a` and `b` of a pair gives a Column.

Every operand is a Column, so precedence is never a matter of text. Numeric comparisons of text columns cast with
try_cast, so that a value that is no number compares as null.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import similarity as sim

FEATURES: dict[str, Callable[[dict[str, Any]], Column]] = {}
AGGREGATES = ("hits", "hits2", "exact_mult", "exact_all_mult", "exact_all_mult2")
HOUSEHOLD_AGGREGATES = ("jw_max_a", "jw_max_b")


def feature(*names: str):
    def keep(f):
        for n in names:
            FEATURES[n] = f
        return f

    return keep


def _side(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def a(name: str) -> Column:
    return _side("a", name)


def b(name: str) -> Column:
    return _side("b", name)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _text(c: Column) -> Column:
    return c.cast("string")


def _filled(c: Column) -> Column:
    return c.isNotNull() & (_text(c) != "")


def _nested(spec: dict, key: str) -> Column:
    return raw_feature(spec[key])


def _all(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, parts)


@feature("sql_condition")
def _sql(s):
    return F.expr(s["condition"])


def _similar(s: dict[str, Any], x: str, y: str) -> Column:
    """Jaro-Winkler of a's column x and b's y: read from a's array at b's place, which the spec's `looked_up` names, else computed for the pair."""
    found = s.get("looked_up", {}).get((x, y))
    return F.get(a(found[0]), b(found[1])) if found else sim.jw(a(x), b(y))


def compared_names(s: dict[str, Any]) -> list[tuple[str, str]]:
    """(column of a, column of b) of each Jaro-Winkler similarity that the feature can look up."""
    kind = s.get("comparison_type")
    if kind == "jaro_winkler":
        return [(s["column_name"], s["column_name"])]
    if kind == "multi_jaro_winkler_search":
        names = [s["jw_col_template"].replace("{n}", str(k)) for k in range(1, int(s["num_cols"]) + 1)]
        return list(itertools.product(names, repeat=2))
    return []


@feature("jaro_winkler")
def _jw(s):
    return _similar(s, s["column_name"], s["column_name"])


@feature("maximum_jaro_winkler")
def _jw_greatest(s):
    pairs = [sim.jw(a(x), b(y)) for x, y in itertools.product(s["column_names"], repeat=2)]
    return pairs[0] if len(pairs) == 1 else F.greatest(*pairs)


@feature("jaro_winkler_street")
def _jw_street(s):
    n, edge = s["column_name"], s["boundary"]
    return F.when(a(edge) == b(edge), sim.jw(a(n), b(n))).otherwise(0.0)


@feature("max_jaro_winkler")
def _jw_arrays(s):
    return sim.jw_max(a(s["column_name"]), b(s["column_name"]))


@feature("jaro_winkler_rate")
def _jw_rate(s):
    return sim.jw_rate(a(s["column_name"]), b(s["column_name"]), float(s.get("jw_threshold", 0.8)))


@feature("rel_jaro_winkler")
def _rel_jw(s):
    n = s["column_name"]
    fields = {k: s.get(f"{k2}_col", d) for k, k2, d in (("name", "name", "namefrst_std"), ("birth", "birthyr", "birthyr"), ("sex", "sex", "sex"))}
    return sim.related_jw(a(n), b(n), float(s.get("jw_threshold", 0.8)), float(s.get("age_threshold") or 5), **fields)


@feature("extra_children")
def _extra(s):
    n, relate = s["column_name"], s.get("relate_col", "relate")
    fields = {k: s.get(f"{k2}_col", d) for k, k2, d in (("name", "name", "namefrst_std"), ("birth", "birthyr", "birthyr"), ("sex", "sex", "sex"))}
    year = F.expr(str(s.get("year_b", "year_b")))
    return sim.extra_children(a(n), b(n), year, a(relate), b(relate), float(s.get("jw_threshold", 0.8)), float(s.get("age_threshold") or 5), relate=relate, **fields)


@feature("hh_compare_rate")
def _hh_rate(s):
    return sim.hh_compare_rate(a(s["column_name"]), b(s["column_name"]))


@feature("multi_jaro_winkler_search")
def _multi_jw(s):
    """Whether any (i, j) of the numbered columns is similar enough, and equal where all templates say so."""
    found = []
    for i, j in itertools.product(range(1, int(s["num_cols"]) + 1), repeat=2):
        fill = lambda t, k: t.replace("{n}", str(k))
        hit = _similar(s, fill(s["jw_col_template"], i), fill(s["jw_col_template"], j)) >= float(s["jw_threshold"])
        for t in s.get("equal_and_not_null_templates", []):
            hit = hit & F.coalesce(a(fill(t, i)) == b(fill(t, j)), F.lit(False))
        found.append(hit)
    return _any(found)


@feature("has_matching_element")
def _overlap(s):
    return sim.has_matching_element(a(s["column_name"]), b(s["column_name"]))


@feature("equals")
def _eq(s):
    return a(s["column_name"]).eqNullSafe(b(s["column_name"]))


@feature("not_equals")
def _ne(s):
    return ~a(s["column_name"]).eqNullSafe(b(s["column_name"]))


@feature("equals_as_int")
def _eq_int(s):
    return (a(s["column_name"]) == b(s["column_name"])).cast("int")


@feature("all_equals")
def _all_eq(s):
    return _all([a(n) == b(n) for n in s["column_names"]])


@feature("any_equals")
def _any_eq(s):
    one, two = s["column_names"]
    filled = lambda n: F.coalesce(_text(a(n)), F.lit("")) != ""
    return (((a(one) == b(one)) | (a(one) == b(two))) & filled(one)) | ((a(two) == b(one)) & filled(two))


@feature("not_zero_and_not_equals")
def _nonzero_ne(s):
    x, y = a(s["column_name"]), b(s["column_name"])
    present = x.isNotNull() & y.isNotNull()
    return F.coalesce(present & ~_number(x).eqNullSafe(F.lit(0.0)) & ~_number(y).eqNullSafe(F.lit(0.0)) & ~x.eqNullSafe(y), F.lit(False))


@feature("f1_match")
def _f1(s):
    first, mids = s["first_init_col"], s["mid_init_cols"]
    return F.when(_any([a(first).eqNullSafe(b(n)) for n in (first, mids[0], mids[1])]), 1).otherwise(2)


@feature("f2_match")
def _f2(s):
    first, (m0, m1) = s["first_init_col"], s["mid_init_cols"][:2]
    second = a(m1).isNotNull()
    hit = _any([a(m0).eqNullSafe(b(n)) for n in (first, m0, m1)] + [second & a(m1).eqNullSafe(b(n)) for n in (first, m0, m1)])
    return F.when((a(m0) == "") | a(m0).isNull(), 0).when(hit, 1).otherwise(2)


def _operands(s: dict) -> list[Column]:
    return [_nested(s, k) for k in ("comp_a", "comp_b", "comp_c", "comp_d") if k in s]


@feature("or")
def _or(s):
    return _any(_operands(s))


@feature("and")
def _and(s):
    return _all(_operands(s))


@feature("times")
def _times(s):
    return _nested(s, "comp_a").cast("float") * _nested(s, "comp_b").cast("float")


@feature("caution_comp_3", "caution_comp_4")
def _caution(s):
    *some, last = _operands(s)
    return _any(some) & last


@feature("caution_comp_3_012", "caution_comp_4_012")
def _caution_012(s):
    *some, last = _operands(s)
    return F.when(~last, 2).when(_any(some) & last, 1).otherwise(0)


@feature("either_are_1")
def _one(s):
    return (a(s["column_name"]) == 1) | (b(s["column_name"]) == 1)


@feature("either_are_0")
def _zero(s):
    return (a(s["column_name"]) == 0) | (b(s["column_name"]) == 0)


@feature("second_gen_imm")
def _second_gen(s):
    return a(s["column_name"]).isin(2, 3, 4)


@feature("sum")
def _sum(s):
    return a(s["column_name"]) + b(s["column_name"])


@feature("length_b")
def _length_b(s):
    return F.size(b(s["column_name"]))


def _difference(s, wrap) -> Column:
    x, y = _int(a(s["column_name"])), _int(b(s["column_name"]))
    out = wrap(y - x)
    if s.get("not_equals", False):
        n = int(s["not_equals"])
        return F.when((y != n) & (x != n), out).otherwise(-1)
    return out


@feature("abs_diff")
def _abs_diff(s):
    return _difference(s, F.abs)


@feature("b_minus_a")
def _b_minus_a(s):
    return _difference(s, lambda c: c)


@feature("geo_distance")
def _geo(s):
    first = F.col(f"{s['table_name']}.{s['distance_col']}")
    if s.get("secondary_table_name"):
        return F.coalesce(first, F.col(f"{s['secondary_table_name']}.{s['secondary_distance_col']}"))
    return first


@feature("fetch_a")
def _fetch_a(s):
    return a(s["column_name"])


@feature("fetch_b")
def _fetch_b(s):
    return b(s["column_name"])


@feature("fetch_td")
def _fetch_td(s):
    return F.col(f"pm.{s['column_name']}")


@feature("new_marr", "existing_marr")
def _marriage(s):
    return _int(b(s["column_name"]))


@feature("parent_step_change")
def _step(s):
    return ~(_int(a(s["column_name"])) > 0).eqNullSafe(_int(b(s["column_name"])) > 0)


@feature("present_both_years")
def _present(s):
    x, y = a(s["column_name"]), b(s["column_name"])
    return x.isNotNull() & (_number(x) > 0) & y.isNotNull() & (_number(y) > 0)


@feature("neither_are_null")
def _neither_null(s):
    return _filled(a(s["column_name"])) & _filled(b(s["column_name"]))


@feature("present_and_matching_categorical")
def _matching(s):
    x, y = a(s["column_name"]), b(s["column_name"])
    return F.when(_filled(x) & _filled(y), F.when(x.eqNullSafe(y), 0).otherwise(1)).otherwise(2)


@feature("present_and_equal_categorical_in_universe")
def _in_universe(s):
    x, y = a(s["column_name"]), b(s["column_name"])
    niu = F.lit(s["NIU"])
    return F.when(_filled(x) & _filled(y) & (x != niu) & (y != niu) & (x == y), 1).otherwise(0)


@feature("present_and_not_equal")
def _present_ne(s):
    x, y = a(s["column_name"]), b(s["column_name"])
    return F.coalesce(_filled(x) & _filled(y) & (_number(x) > 0) & ~x.eqNullSafe(y), F.lit(False))


DEFAULT_THRESHOLD = {"new_marr": ("upper_threshold", 10), "existing_marr": ("lower_threshold", 10)}
_KINDS: tuple[tuple[str, Callable[[Column, Any], Column]], ...] = (
    ("threshold", lambda c, t: c >= t),
    ("lower_threshold", lambda c, t: c >= t),
    ("upper_threshold", lambda c, t: c <= t),
    ("gt_threshold", lambda c, t: c > t),
    ("btwn_threshold", lambda c, t: (c >= t[0]) & (c <= t[1])),
)


def raw_feature(spec: dict[str, Any]) -> Column:
    """The feature with its add-ons (power, one threshold, additional variable), without its alias.

    Of several thresholds the first kind in the table counts; a threshold of 0 counts as none.
    """
    kind = spec["comparison_type"]
    if kind not in FEATURES:
        raise ValueError(f"no comparison type is named {kind!r}")
    out = FEATURES[kind](spec)
    if spec.get("power"):
        out = F.pow(out.cast("int"), F.lit(spec["power"]))
    if kind in DEFAULT_THRESHOLD:
        key, value = DEFAULT_THRESHOLD[kind]
        spec = {key: value} | spec
    for key, test in _KINDS:
        if spec.get(key):
            out = out.isNotNull() & test(out, spec[key])
            break
    if spec.get("look_at_addl_var"):
        checked = F.expr(f"{spec['datasource']}.{spec['addl_var']} {spec['check_val_expr']}")
        other = spec["else_val"]
        out = F.when(checked, out).otherwise(F.expr(other) if isinstance(other, str) else F.lit(other))
    return out


def build_feature(spec: dict[str, Any]) -> Column:
    """The feature under its alias."""
    return raw_feature(spec).alias(spec["alias"])


def referenced_columns(spec: Any) -> set[str]:
    """Names of the input columns that a spec mentions, through all nested specs."""
    if isinstance(spec, list):
        return set().union(*map(referenced_columns, spec)) if spec else set()
    if not isinstance(spec, dict):
        return set()
    out: set[str] = set()
    for k, v in spec.items():
        if k in ("column_name", "boundary", "first_init_col", "addl_var") and isinstance(v, str):
            out.add(v)
        elif k in ("column_names", "mid_init_cols"):
            out |= set(v)
        elif k.startswith(("source_column", "secondary_source_column")):
            out.add(v)
        elif k.startswith("comp_"):
            out |= referenced_columns(v)
    return out
