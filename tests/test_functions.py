import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import features, similarity, trees
from kindred.functions.transforms import apply_transform
from kindred.operators import ml


def one(spark, value, *steps, is_a=True, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    col = F.col("c")
    for s in steps:
        col = apply_transform(col, s, is_a)
    return df.select(col.alias("v")).first()[0]


@pytest.mark.parametrize("a, b, want", [("Name", "Nameish", 0.9142857142857143), ("", "x", 0.0), ("same", "same", 1.0), ("zzzzzz", "sleepy", 0.0), ("martha", "marhta", 0.9611111111111111), ("dwayne", "duane", 0.84)])
def test_jaro_winkler(a, b, want):
    assert similarity.jaro_winkler(a, b) == pytest.approx(want)


@given(st.text(max_size=12), st.text(max_size=12))
@settings(max_examples=200, deadline=None)
def test_jaro_winkler_is_a_symmetric_similarity(a, b):
    x = similarity.jaro_winkler(a, b)
    assert 0 <= x <= 1 and x == pytest.approx(similarity.jaro_winkler(b, a))


def test_transforms(spark):
    t = lambda v, *s, **k: one(spark, v, *s, **k)
    assert t("75 Rev. Dr., [x]", {"type": "remove_punctuation"}) == "75 Rev Dr x"
    assert t("mary  ann jr", {"type": "remove_suffixes", "values": ["jr", "sr"]}) == "mary  ann"
    assert t("van der berg", {"type": "condense_prefixes", "values": ["van", "mc"]}) == "vander berg"
    assert t("a b carl", {"type": "remove_one_letter_names"}) == "carl"
    assert t("x y", {"type": "split"}, {"type": "array_index", "value": 5}) is None
    assert t("", {"type": "cast_as_int"}) is None
    assert t("northwest", {"type": "mapping", "mappings": {"north": "n", "west": "w"}}) == "northwest"
    assert t("1", {"type": "mapping", "mappings": {"1": "10", "2": ""}, "output_type": "int"}) == 10
    assert t("2", {"type": "mapping", "mappings": {"1": "10", "2": ""}, "output_type": "int"}) is None
    assert t("abcdef", {"type": "substring", "values": [0, 3]}) == "abc"
    assert t("6", {"type": "when_value", "value": 6, "if_value": 0, "else_value": 1}) == 0
    assert t("x", {"type": "concat_to_b", "value": "-b"}) == "x" and t("x", {"type": "concat_to_b", "value": "-b"}, is_a=False) == "x-b"
    assert one(spark, 5, {"type": "expand", "value": 1}, kind="int") == [4, 5, 6]
    with pytest.raises(ValueError):
        t("x", {"type": "substring", "values": [1]})
    with pytest.raises(ValueError):
        t("x", {"type": "nothing"})


def pair(spark, a, b, schema, spec):
    left, right = spark.createDataFrame([a], schema).alias("a"), spark.createDataFrame([b], schema).alias("b")
    return left.join(right, F.lit(True)).select(features.build_feature({"alias": "v"} | spec)).first()[0]


def test_features_nulls(spark):
    s = "x int, f string, m0 string, m1 string"
    eq = {"comparison_type": "equals", "column_name": "x"}
    assert pair(spark, (None, "", None, None), (None, "", None, None), s, eq) is True
    assert pair(spark, (1, "", None, None), (None, "", None, None), s, {"comparison_type": "equals_as_int", "column_name": "x"}) is None
    assert pair(spark, (1, None, None, None), (1, None, None, None), s, {"comparison_type": "any_equals", "column_names": ["f", "m0"]}) in (None, False)
    f2 = {"comparison_type": "f2_match", "first_init_col": "f", "mid_init_cols": ["m0", "m1"]}
    assert pair(spark, (1, "a", "", None), (1, "b", "c", None), s, f2) == 0
    assert pair(spark, (1, "a", "c", None), (1, "b", "c", None), s, f2) == 1
    assert pair(spark, (1, "a", "d", None), (1, "b", "c", None), s, f2) == 2
    gap = {"comparison_type": "abs_diff", "column_name": "x"}
    assert pair(spark, (1, "", "", ""), (4, "", "", ""), s, gap | {"threshold": 0}) == 3  # a threshold of 0 is none
    assert pair(spark, (1, "", "", ""), (4, "", "", ""), s, gap | {"threshold": 3, "upper_threshold": 1}) is True
    with pytest.raises(ValueError):
        pair(spark, (1, "", "", ""), (4, "", "", ""), s, {"comparison_type": "nothing"})


def test_array_features(spark):
    s = "n array<string>"
    assert pair(spark, (["mary", "x"],), (["marie"],), s, {"comparison_type": "max_jaro_winkler", "column_name": "n"}) == pytest.approx(similarity.jaro_winkler("mary", "marie"))
    assert pair(spark, ([],), (["marie"],), s, {"comparison_type": "max_jaro_winkler", "column_name": "n"}) == 0
    assert pair(spark, (["mary", "zzz"],), (["mary"],), s, {"comparison_type": "jaro_winkler_rate", "column_name": "n"}) == 0.5
    assert pair(spark, (["a", "b"],), (["b"],), s, {"comparison_type": "has_matching_element", "column_name": "n"}) is True
    assert pair(spark, (["a", "b"],), (["b", "c", "d"],), s, {"comparison_type": "length_b", "column_name": "n"}) == 3


def test_people_features(spark):
    s = "relate long, p array<struct<namefrst_std:string,birthyr:long,sex:long,relate:long,bpl:long>>"
    ours = (101, [("jane", 1890, 2, 301, 1), ("john", 1880, 1, 201, 1)])
    theirs = (101, [("jane", 1891, 2, 301, 1), ("paul", 1885, 1, 301, 1), ("anna", 1909, 2, 301, 1)])
    assert pair(spark, ours, theirs, s, {"comparison_type": "rel_jaro_winkler", "column_name": "p"}) == 1
    assert pair(spark, ours, theirs, s, {"comparison_type": "extra_children", "column_name": "p", "year_b": 1910}) == 1  # paul; anna is too young
    assert pair(spark, (401, ours[1]), theirs, s, {"comparison_type": "extra_children", "column_name": "p", "year_b": 1910}) == 0
    same = (101, [("jane", 1890, 2, 301, 1)])
    assert pair(spark, same, (101, [("jane", 1890, 2, 1, 1), ("bob", 1, 1, 1, 1)]), s, {"comparison_type": "hh_compare_rate", "column_name": "p"}) == 0.5


def test_multi_search(spark):
    spec = {"comparison_type": "multi_jaro_winkler_search", "num_cols": 2, "jw_col_template": "n{n}", "jw_threshold": 0.9, "equal_and_not_null_templates": ["b{n}"]}
    s = "n1 string, n2 string, b1 int, b2 int"
    assert pair(spark, ("ann", "bob", 1, 2), ("bob", "zed", 2, 3), s, spec) is True
    assert pair(spark, ("ann", "bob", 1, None), ("bob", "zed", 2, 3), s, spec) is False


def test_trees(spark):
    df = spark.createDataFrame([(1, 5), (3, 1)], "u int, v int")
    tree = {"operator": "AND", "comp_a": {"column_name": "u", "comparison_type": "threshold", "threshold": 2}, "comp_b": {"column_name": "v", "comparison_type": "threshold", "threshold_expr": "< 3"}}
    assert [r["u"] for r in df.where(trees.tree_condition(tree, {})).collect()] == [3]
    assert trees.tree_condition({}, {}) is None and trees.leaves({}) == []
    with pytest.raises(ValueError):
        trees.tree_condition({"operator": "XOR", "comp_a": {"column_name": "u"}, "comp_b": {"column_name": "v"}}, {})
    with pytest.raises(ValueError):
        trees.tree_condition({"feature_name": "nothing"}, {})


def test_metrics_golden():
    tp, fp, fn, tn = 60, 20, 15, 205
    assert ml.precision(tp, fp) == 0.75 and ml.recall(tp, fn) == 0.8
    assert ml.f_measure(tp, fp, fn) == pytest.approx(2 * 0.75 * 0.8 / 1.55)
    assert ml.mcc(tp, fp, fn, tn) == pytest.approx((60 * 205 - 20 * 15) / math.sqrt(80 * 75 * 225 * 220))


@given(*[st.integers(0, 10**6)] * 4)
@settings(deadline=None)
def test_metrics_ranges(tp, fp, fn, tn):
    for v in (ml.precision(tp, fp), ml.recall(tp, fn), ml.f_measure(tp, fp, fn)):
        assert math.isnan(v) or 0 <= v <= 1
    m = ml.mcc(tp, fp, fn, tn)
    assert math.isnan(m) or -1 <= m <= 1


def test_sql_functions(spark):
    similarity.register_functions(spark)
    q = """SELECT jw('Name', 'Nameish') AS a, jw_max(array('x', 'ann'), array('ann')) AS b, jw_rate(array('ann', 'zz'), array('ann'), '0.8') AS c,
        has_matching_element(array('a'), array('b', 'a')) AS d, array_to_string(array('a', 'b')) AS e,
        extract_neighbors(array(named_struct('serial', 1L, 'value', 'x'), named_struct('serial', 2L, 'value', 'y')), 1L) AS f,
        hh_rows_get_first_value(array(named_struct('serial', 7L, 'pernum', 2L, 'value', 'b'), named_struct('serial', 7L, 'pernum', 1L, 'value', 'a'))).value AS g,
        rel_jw(array(named_struct('n', 'ann', 'y', 1900L, 's', 2L)), array(named_struct('n', 'anne', 'y', 1901L, 's', 2L)), '0.8', '5', map('name', 'n', 'byr', 'y', 'sex', 's')) AS h"""
    r = spark.sql(q).first()
    assert r["a"] == pytest.approx(0.9142857142857143) and r["b"] == 1 and r["c"] == 0.5 and r["d"] and r["e"] == "[a,b]" and r["f"] == ["y"] and r["g"] == "a" and r["h"] == 1


def test_extra_children_takes_the_best_first():
    ours = [("anna", 1890, 2, 301), ("ann", 1890, 2, 301)]
    theirs = [("ann", 1890, 2, 301), ("anna", 1890, 2, 301), ("paul", 1885, 1, 302)]
    assert similarity.count_extra_children(ours, theirs, 1910, 0.8, 5) == 1
    assert similarity.count_extra_children([], theirs, 1910, 0.8, 5) == 3
