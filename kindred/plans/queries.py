"""Registered queries of the linkage operators over the driver's tables, and the same in DuckDB's SQL where SQL has it.

Key prefixes: map_ column transforms, filter_ row filters, block_ candidates, cmp_ comparison features, tree_ comparison
trees, agg_ and win_ aggregates and windows, fam_ households, sub_ substitutions, decide_ thresholds, hh_ household
rounds, report_ and export_ reports, feat_ feature selections, ml_ models.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.features import build_feature
from kindred.functions.transforms import apply_transform
from kindred.functions.trees import tree_condition
from kindred.operators import blocking, decide, households, ml, pairs, prepare, reports, selections
from kindred.plans import block_queries, name_queries
from kindred.plans.name_queries import jw_sql
from kindred.sources import io

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- column transforms: (key, table, id, column, transforms, is_a, SQL)

_T = "part"
_MAPS = [
    ("map_lowercase_strip", "part", "p_partkey", "p_type", [{"type": "lowercase_strip"}], True, "lower(trim(p_type))"),
    ("map_remove_punctuation", "customer", "c_custkey", "concat('o''', c_name, '. (', c_mktsegment, '), [x]')", [{"type": "remove_punctuation"}], True, "regexp_replace('o''' || c_name || '. (' || c_mktsegment || '), [x]', '[?\\-\\\\/\"'':,.\\[\\]{}]+', '', 'g')"),
    ("map_rationalize", "part", "p_partkey", "p_name", [{"type": "rationalize_name_words"}], True, "regexp_replace(p_name, '[^a-z?''*\\-]+', ' ', 'g')"),
    ("map_remove_qmark_hyphen", "orders", "o_orderkey", "o_orderpriority", [{"type": "remove_qmark_hyphen"}], True, "regexp_replace(o_orderpriority, '[?*\\-]+', '', 'g')"),
    ("map_replace_apostrophe", "customer", "c_custkey", "concat('d''', c_name)", [{"type": "replace_apostrophe"}], True, "regexp_replace('d''' || c_name, '''+', ' ', 'g')"),
    ("map_remove_alternate_names", "part", "p_partkey", "concat(p_type, ' or ', p_name)", [{"type": "remove_alternate_names"}], True, "regexp_replace(p_type || ' or ' || p_name, '^(\\w+) or .*$', '\\1')"),
    ("map_remove_suffixes", "part", "p_partkey", "p_name", [{"type": "remove_suffixes", "values": ["ring", "widget"]}], True, "regexp_replace(p_name, '\\s+(?:ring|widget)\\s*$', '')"),
    ("map_remove_stop_words", "part", "p_partkey", "p_name", [{"type": "remove_stop_words", "values": ["small", "red"]}], True, "regexp_replace(p_name, '\\b(?:small|red)\\b', '', 'g')"),
    ("map_remove_prefixes", "part", "p_partkey", "p_name", [{"type": "remove_prefixes", "values": ["small", "red"]}], True, "regexp_replace(p_name, '^(?:small|red) ', '')"),
    ("map_condense_prefixes", "part", "p_partkey", "p_name", [{"type": "condense_prefixes", "values": ["small", "red"]}], True, "regexp_replace(p_name, '^(small|red) ', '\\1')"),
    ("map_condense_whitespace", "part", "p_partkey", "concat('  ', p_name, '   ', p_type, ' ')", [{"type": "condense_strip_whitespace"}], True, "regexp_replace(trim('  ' || p_name || '   ' || p_type || ' '), '\\s\\s+', ' ', 'g')"),
    ("map_remove_one_letter", "part", "p_partkey", "concat('a b ', p_name)", [{"type": "remove_one_letter_names"}], True, "regexp_replace('a b ' || p_name, '^(?:\\w )+', '')"),
    ("map_split_index", "part", "p_partkey", "p_name", [{"type": "split"}, {"type": "array_index", "value": 1}], True, "string_split(p_name, ' ')[2]"),
    ("map_length", "part", "p_partkey", "p_name", [{"type": "length"}], True, "CAST(length(p_name) AS INTEGER)"),
    ("map_mapping_int", "orders", "o_orderkey", "o_orderstatus", [{"type": "mapping", "mappings": {"F": "1", "O": "2"}, "output_type": "int"}], True, "TRY_CAST(CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE o_orderstatus END AS BIGINT)"),
    ("map_swap_words", "part", "p_partkey", "p_name", [{"type": "swap_words", "values": {"small": "little", "ring": "loop"}}], True, "regexp_replace(regexp_replace(p_name, '\\bsmall\\b', 'little', 'g'), '\\bring\\b', 'loop', 'g')"),
    ("map_substring", "part", "p_partkey", "p_brand", [{"type": "substring", "values": [0, 3]}], True, "substr(p_brand, 1, 3)"),
    ("map_expand", "part", "p_partkey", "p_size", [{"type": "expand", "value": 2}], True, "generate_series(p_size - 2, p_size + 2)"),
    ("map_cast_as_int", "customer", "c_custkey", "regexp_replace(c_name, '^Customer#', '')", [{"type": "cast_as_int"}], True, "TRY_CAST(replace(c_name, 'Customer#', '') AS INTEGER)"),
    ("map_divide_floor", "part", "p_partkey", "p_size", [{"type": "divide_by_int", "value": 7}, {"type": "get_floor"}], True, "CAST(floor(p_size / 7) AS INTEGER)"),
    ("map_when_value", "part", "p_partkey", "p_size", [{"type": "when_value", "value": 6, "if_value": 0, "else_value": 1}], True, "CASE WHEN p_size = 6 THEN 0 ELSE 1 END"),
    ("map_add_to_a", "part", "p_partkey", "p_size", [{"type": "add_to_a", "value": 11}], True, "p_size + 11"),
    ("map_concat_to_b", "part", "p_partkey", "p_brand", [{"type": "concat_to_a", "value": "-a"}, {"type": "concat_to_b", "value": "-b"}], False, "p_brand || '-b'"),
    ("map_concat_two_cols", "part", "p_partkey", "p_brand", [{"type": "concat_two_cols", "column_to_append": "p_type"}], True, "p_brand || p_type"),
]


def _map_query(name, source, id_column, column, steps, is_a, sql):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).withColumn("raw", F.expr(column))
        out = prepare.map_columns(df, [{"column_name": "raw", "alias": "value", "transforms": steps}], id_column, is_a)
        if dict(out.dtypes)["value"].startswith("array"):
            out = out.withColumn("value", F.array_join(F.transform("value", lambda x: x.cast("string")), ","))
        return out.select(F.col(id_column).alias("id"), "value")

    value = f"array_to_string({sql}, ',')" if "generate_series" in sql else sql
    _QUERIES[name] = run
    _SQL[name] = f"SELECT {id_column} AS id, {value} AS value FROM {source}"


for _m in _MAPS:
    _map_query(*_m)


@query("map_alias_chain", "SELECT p_partkey, lower(p_type) AS kind, lower(p_type) || p_brand AS kind_brand, 7 AS side FROM part")
def map_alias_chain(spark, sf_dir):
    """A mapping that uses an earlier alias, and a literal for one side."""
    maps = [
        {"column_name": "p_type", "alias": "kind", "transforms": [{"type": "lowercase_strip"}]},
        {"column_name": "kind", "alias": "kind_brand", "transforms": [{"type": "concat_two_cols", "column_to_append": "p_brand"}]},
        {"column_name": "p_size", "alias": "side", "set_value_column_a": 7},
    ]
    return prepare.map_columns(table(spark, sf_dir, "part"), maps, "p_partkey", True)


@query("map_override", "SELECT p_partkey, upper(p_name) AS name FROM part")
def map_override(spark, sf_dir):
    """Side B reads another column, with transforms of its own."""
    df = table(spark, sf_dir, "part").withColumn("loud", F.upper("p_name"))
    return prepare.map_columns(df, [{"column_name": "p_name", "alias": "name", "transforms": [{"type": "lowercase_strip"}], "override_column_b": "loud"}], "p_partkey", False)


# --- filters


@query("filter_expression", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_expression(spark, sf_dir):
    return prepare.filter_rows(table(spark, sf_dir, "orders"), "o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("filter_household", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def filter_household(spark, sf_dir):
    return prepare.filter_households(table(spark, sf_dir, "lineitem"), "l_quantity >= 49", "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "filter_training_subset",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'error'))",
)
def filter_training_subset(spark, sf_dir):
    training = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id_a"))
    return prepare.filter_training_subset(table(spark, sf_dir, "orders"), training, "o_orderkey", "id_a", "o_custkey").select("o_orderkey", "o_custkey")


@query("filter_blank_columns", "SELECT 'c_name' AS column_name WHERE false UNION ALL SELECT 'blank_street'")
def filter_blank_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("blank_street", F.lit("   "))
    return spark.createDataFrame([(n,) for n in io.blank_text_columns(df)], "column_name string")


# --- candidates


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size")


@query("block_and", "SELECT a.p_partkey AS id_a, b.p_partkey AS id_b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_partkey < b.p_partkey")
def block_and(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return blocking.candidate_ids(p, p, [{"column_name": c} for c in ("p_brand", "p_type", "p_size")], "id", unordered=True)


@query(
    "block_or_groups",
    "SELECT DISTINCT c_custkey AS id_a, s_suppkey AS id_b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND (c_custkey % 10 = s_suppkey % 10 OR CAST(floor(c_acctbal / 100) AS BIGINT) = CAST(floor(s_acctbal / 100) AS BIGINT))",
)
def block_or_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("k1"), F.floor(F.col("c_acctbal") / 100).alias("k2"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 10).alias("k1"), F.floor(F.col("s_acctbal") / 100).alias("k2"))
    return blocking.candidate_ids(c, s, [{"column_name": "k1", "or_group": "k"}, {"column_name": "k2", "or_group": "k"}, {"column_name": "nation"}], "id")


@query("block_band_explode", "SELECT a.p_partkey AS id_a, b.p_partkey AS id_b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 3 WHERE a.p_partkey < b.p_partkey")
def block_band_explode(spark, sf_dir):
    p = _parts(spark, sf_dir)
    rules = [{"column_name": "p_brand"}, {"column_name": "p_type"}, {"column_name": "size_3", "explode": True, "expand_length": 3, "derived_from": "p_size", "dataset": "a"}]
    return blocking.candidate_ids(p, p, rules, "id", unordered=True)


_GRAMS = "(SELECT {id} AS id, unnest(list_distinct(list_transform(generate_series(1, length({c}) - 1), lambda i: substr({c}, i, 2)))) AS g FROM {t})"


@query("block_bigram_explode", f"SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM {_GRAMS.format(id='c_custkey', c='c_mktsegment', t='customer')} a JOIN {_GRAMS.format(id='r_regionkey', c='r_name', t='region')} b ON a.g = b.g")
def block_bigram_explode(spark, sf_dir):
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), grams("c_mktsegment").alias("g"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), grams("r_name").alias("g"))
    return blocking.candidate_ids(n, r, [{"column_name": "g", "explode": True}], "id")


@query("universe_filter", "SELECT a.p_partkey AS id_a, b.p_partkey AS id_b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand WHERE a.p_partkey < b.p_partkey AND a.p_size < 20 AND b.p_size < 20 AND a.p_type <> 'PROMO' AND b.p_type <> 'PROMO'")
def universe_filter(spark, sf_dir):
    p = blocking.universe(_parts(spark, sf_dir), ["p_size < 20", "p_type <> 'PROMO'"])
    return blocking.candidate_ids(p, p, [{"column_name": "p_name"}, {"column_name": "p_brand"}], "id", unordered=True)


# --- comparison features over customer x supplier pairs of one nation; nulls, zeros and blanks are planted on both sides


def _c(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"),
        F.when(k % 7 != 0, (k % 5).cast("int")).alias("x"), F.when(k % 11 != 0, (k % 3).cast("int")).alias("y"),
        F.when(k % 5 != 0, F.substring("c_mktsegment", 1, 1)).otherwise("").alias("f"), F.when(k % 3 != 0, F.substring("c_mktsegment", 2, 1)).alias("m0"), F.when(k % 4 != 0, F.substring("c_mktsegment", 3, 1)).alias("m1"),
        F.floor(F.col("c_acctbal") / 1000).cast("int").alias("bal"),
    )


def _s(spark, sf_dir):
    k = F.col("s_suppkey")
    seg = F.element_at(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "HOUSEHOLD")]), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"),
        F.when(k % 6 != 0, (k % 4).cast("int")).alias("x"), F.when(k % 9 != 0, (k % 2).cast("int")).alias("y"),
        F.when(k % 4 != 0, F.substring(seg, 1, 1)).otherwise("").alias("f"), F.when(k % 3 != 0, F.substring(seg, 2, 1)).alias("m0"), F.when(k % 5 != 0, F.substring(seg, 3, 1)).alias("m1"),
        F.floor(F.col("s_acctbal") / 1000).cast("int").alias("bal"),
    )


_A_SQL = """(SELECT c_custkey AS id, c_nationkey AS nation, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS x, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 3 AS INTEGER) END AS y,
    CASE WHEN c_custkey % 5 <> 0 THEN substr(c_mktsegment, 1, 1) ELSE '' END AS f, CASE WHEN c_custkey % 3 <> 0 THEN substr(c_mktsegment, 2, 1) END AS m0, CASE WHEN c_custkey % 4 <> 0 THEN substr(c_mktsegment, 3, 1) END AS m1,
    CAST(floor(c_acctbal / 1000) AS INTEGER) AS bal FROM customer)"""
_B_SQL = """(SELECT s_suppkey AS id, s_nationkey AS nation, s_name AS name, CASE WHEN s_suppkey % 6 <> 0 THEN CAST(s_suppkey % 4 AS INTEGER) END AS x, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 2 AS INTEGER) END AS y,
    CASE WHEN s_suppkey % 4 <> 0 THEN substr(seg, 1, 1) ELSE '' END AS f, CASE WHEN s_suppkey % 3 <> 0 THEN substr(seg, 2, 1) END AS m0, CASE WHEN s_suppkey % 5 <> 0 THEN substr(seg, 3, 1) END AS m1,
    CAST(floor(s_acctbal / 1000) AS INTEGER) AS bal FROM (SELECT *, (['AUTOMOBILE', 'BUILDING', 'HOUSEHOLD'])[s_suppkey % 3 + 1] AS seg FROM supplier))"""
_FROM_AB = f"FROM {_A_SQL} a JOIN {_B_SQL} b ON a.nation = b.nation"


def _compared(spark, sf_dir, specs, tree=None, wanted=None):
    a, b = _c(spark, sf_dir), _s(spark, sf_dir)
    return pairs.compare_blocked(spark, a, b, [{"column_name": "nation"}], "id", specs, tree, wanted)


_EQ_X, _EQ_Y, _EQ_F = ({"comparison_type": "equals", "column_name": n} for n in ("x", "y", "f"))
_SX, _SY, _SF = ("(a.%s IS NOT DISTINCT FROM b.%s)" % (n, n) for n in ("x", "y", "f"))
#: key -> list of (spec, SQL); the alias is v0, v1, ...
_CMP: dict[str, list[tuple[dict, str]]] = {
    "cmp_equals_nullsafe": [(_EQ_X, _SX), ({"comparison_type": "not_equals", "column_name": "x"}, f"NOT {_SX}"), ({"comparison_type": "equals_as_int", "column_name": "x"}, "CAST(a.x = b.x AS INTEGER)")],
    "cmp_any_equals": [({"comparison_type": "any_equals", "column_names": ["f", "m0"]}, "((a.f = b.f OR a.f = b.m0) AND coalesce(a.f, '') <> '') OR (a.m0 = b.f AND coalesce(a.m0, '') <> '')")],
    "cmp_all_equals": [({"comparison_type": "all_equals", "column_names": ["x", "y"]}, "a.x = b.x AND a.y = b.y")],
    "cmp_not_zero_and_not_equals": [({"comparison_type": "not_zero_and_not_equals", "column_name": "x"}, "coalesce(a.x IS NOT NULL AND b.x IS NOT NULL AND a.x <> 0 AND b.x <> 0 AND a.x <> b.x, false)")],
    "cmp_abs_diff_sentinel": [
        ({"comparison_type": "abs_diff", "column_name": "x"}, "abs(b.x - a.x)"),
        ({"comparison_type": "abs_diff", "column_name": "x", "not_equals": 2}, "CASE WHEN b.x <> 2 AND a.x <> 2 THEN abs(b.x - a.x) ELSE -1 END"),
        ({"comparison_type": "b_minus_a", "column_name": "x"}, "b.x - a.x"),
        ({"comparison_type": "b_minus_a", "column_name": "x", "not_equals": 1}, "CASE WHEN b.x <> 1 AND a.x <> 1 THEN b.x - a.x ELSE -1 END"),
    ],
    "cmp_f1_f2": [
        ({"comparison_type": "f1_match", "first_init_col": "f", "mid_init_cols": ["m0", "m1"]}, "CASE WHEN a.f IS NOT DISTINCT FROM b.f OR a.f IS NOT DISTINCT FROM b.m0 OR a.f IS NOT DISTINCT FROM b.m1 THEN 1 ELSE 2 END"),
        (
            {"comparison_type": "f2_match", "first_init_col": "f", "mid_init_cols": ["m0", "m1"]},
            "CASE WHEN a.m0 = '' OR a.m0 IS NULL THEN 0 WHEN a.m0 IS NOT DISTINCT FROM b.f OR a.m0 IS NOT DISTINCT FROM b.m0 OR a.m0 IS NOT DISTINCT FROM b.m1 OR (a.m1 IS NOT NULL AND (a.m1 IS NOT DISTINCT FROM b.f OR a.m1 IS NOT DISTINCT FROM b.m0 OR a.m1 IS NOT DISTINCT FROM b.m1)) THEN 1 ELSE 2 END",
        ),
    ],
    "cmp_boolean": [
        ({"comparison_type": "or", "comp_a": _EQ_X, "comp_b": _EQ_Y}, f"{_SX} OR {_SY}"),
        ({"comparison_type": "and", "comp_a": _EQ_X, "comp_b": _EQ_Y, "comp_c": _EQ_F}, f"{_SX} AND {_SY} AND {_SF}"),
        ({"comparison_type": "either_are_1", "column_name": "x"}, "a.x = 1 OR b.x = 1"),
        ({"comparison_type": "either_are_0", "column_name": "x"}, "a.x = 0 OR b.x = 0"),
        ({"comparison_type": "second_gen_imm", "column_name": "x"}, "a.x IN (2, 3, 4)"),
    ],
    "cmp_caution_012": [
        ({"comparison_type": "caution_comp_3", "comp_a": _EQ_X, "comp_b": _EQ_Y, "comp_c": _EQ_F}, f"({_SX} OR {_SY}) AND {_SF}"),
        ({"comparison_type": "caution_comp_3_012", "comp_a": _EQ_X, "comp_b": _EQ_Y, "comp_c": _EQ_F}, f"CASE WHEN NOT {_SF} THEN 2 WHEN {_SX} OR {_SY} THEN 1 ELSE 0 END"),
        ({"comparison_type": "caution_comp_4", "comp_a": _EQ_X, "comp_b": _EQ_Y, "comp_c": _EQ_X, "comp_d": _EQ_F}, f"({_SX} OR {_SY}) AND {_SF}"),
        ({"comparison_type": "caution_comp_4_012", "comp_a": _EQ_X, "comp_b": _EQ_Y, "comp_c": _EQ_X, "comp_d": _EQ_F}, f"CASE WHEN NOT {_SF} THEN 2 WHEN {_SX} OR {_SY} THEN 1 ELSE 0 END"),
    ],
    "cmp_arithmetic": [
        ({"comparison_type": "sum", "column_name": "bal"}, "a.bal + b.bal"),
        ({"comparison_type": "times", "comp_a": {"comparison_type": "fetch_a", "column_name": "bal"}, "comp_b": {"comparison_type": "fetch_b", "column_name": "bal"}}, "CAST(a.bal AS FLOAT) * CAST(b.bal AS FLOAT)"),
        ({"comparison_type": "b_minus_a", "column_name": "bal", "power": 2}, "CAST(pow(b.bal - a.bal, 2) AS DOUBLE)"),
        ({"comparison_type": "fetch_a", "column_name": "bal"}, "a.bal"),
        ({"comparison_type": "fetch_b", "column_name": "x"}, "b.x"),
        ({"comparison_type": "fetch_td", "column_name": "id_a"}, "a.id"),
    ],
    "cmp_categorical_012": [
        ({"comparison_type": "present_and_matching_categorical", "column_name": "f"}, "CASE WHEN a.f IS NOT NULL AND b.f IS NOT NULL AND a.f <> '' AND b.f <> '' THEN CASE WHEN a.f <> b.f THEN 1 ELSE 0 END ELSE 2 END"),
        ({"comparison_type": "present_and_equal_categorical_in_universe", "column_name": "x", "NIU": 0}, "CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL AND a.x <> 0 AND b.x <> 0 AND a.x = b.x THEN 1 ELSE 0 END"),
        ({"comparison_type": "present_and_not_equal", "column_name": "x"}, "coalesce(a.x IS NOT NULL AND b.x IS NOT NULL AND a.x > 0 AND a.x <> b.x, false)"),
        ({"comparison_type": "present_both_years", "column_name": "x"}, "a.x IS NOT NULL AND a.x > 0 AND b.x IS NOT NULL AND b.x > 0"),
        ({"comparison_type": "neither_are_null", "column_name": "f"}, "a.f IS NOT NULL AND b.f IS NOT NULL AND a.f <> '' AND b.f <> ''"),
        ({"comparison_type": "parent_step_change", "column_name": "x"}, "(a.x > 0) IS DISTINCT FROM (b.x > 0)"),
    ],
    "cmp_thresholds_addl_var": [
        ({"comparison_type": "abs_diff", "column_name": "bal", "upper_threshold": 3}, "abs(b.bal - a.bal) <= 3"),
        ({"comparison_type": "abs_diff", "column_name": "bal", "lower_threshold": 3}, "abs(b.bal - a.bal) >= 3"),
        ({"comparison_type": "abs_diff", "column_name": "bal", "gt_threshold": 3}, "abs(b.bal - a.bal) > 3"),
        ({"comparison_type": "abs_diff", "column_name": "x", "threshold": 1}, "abs(b.x - a.x) IS NOT NULL AND abs(b.x - a.x) >= 1"),
        ({"comparison_type": "abs_diff", "column_name": "bal", "btwn_threshold": [2, 4]}, "abs(b.bal - a.bal) BETWEEN 2 AND 4"),
        ({"comparison_type": "abs_diff", "column_name": "bal", "look_at_addl_var": True, "addl_var": "x", "check_val_expr": "> 1", "datasource": "a", "else_val": -9}, "CASE WHEN a.x > 1 THEN abs(b.bal - a.bal) ELSE -9 END"),
        ({"comparison_type": "new_marr", "column_name": "bal"}, "b.bal <= 10"),
        ({"comparison_type": "existing_marr", "column_name": "bal", "lower_threshold": 5}, "b.bal >= 5"),
    ],
    "cmp_sql_condition": [({"comparison_type": "sql_condition", "condition": "a.x + coalesce(b.x, 0) > 3 or a.f = 'B'"}, "a.x + coalesce(b.x, 0) > 3 OR a.f = 'B'")],
}


def _cmp_query(name, items):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _compared(spark, sf_dir, [s | {"alias": f"v{k}"} for k, (s, _) in enumerate(items)])

    _QUERIES[name] = run
    _SQL[name] = "SELECT a.id AS id_a, b.id AS id_b, " + ", ".join(f"{sql} AS v{k}" for k, (_, sql) in enumerate(items)) + " " + _FROM_AB


for _k, _v in _CMP.items():
    _cmp_query(_k, _v)


@query("cmp_jw_supplier", f"SELECT a.id AS id_a, b.id AS id_b, round(jaro_winkler_similarity(n.n_name, r.r_name), 6) AS jw FROM (SELECT n_nationkey AS id, n_name FROM nation) a JOIN (SELECT r_regionkey AS id, r_name FROM region) b ON true JOIN nation n ON n.n_nationkey = a.id JOIN region r ON r.r_regionkey = b.id WHERE n.n_regionkey = r.r_regionkey")
def cmp_jw_supplier(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    ids = blocking.candidate_ids(n, r, [{"column_name": "k"}], "id")
    out = pairs.compare(spark, ids, n, r, "id", [{"alias": "jw", "comparison_type": "jaro_winkler", "column_name": "name"}])
    return out.withColumn("jw", F.round("jw", 6))


_NAMES = "(SELECT DISTINCT p_type, p_name FROM part)"


@query(
    "cmp_jw_part",
    f"WITH n AS MATERIALIZED {_NAMES}, {jw_sql('jw', '(SELECT a.p_name AS x, b.p_name AS y FROM n a JOIN n b ON a.p_type = b.p_type AND a.p_name < b.p_name)')} "
    "SELECT a.p_type, a.p_name AS name_a, b.p_name AS name_b, round(jw, 9) AS jw FROM n a JOIN n b ON a.p_type = b.p_type AND a.p_name < b.p_name JOIN jw ON jw.x = a.p_name AND jw.y = b.p_name",
)
def cmp_jw_part(spark, sf_dir):
    """Jaro-Winkler of all distinct part names within a type: pairs of distinct values, not of rows."""
    names = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    a, b = names.alias("a"), names.alias("b")
    met = a.join(b, (F.col("a.p_type") == F.col("b.p_type")) & (F.col("a.p_name") < F.col("b.p_name")))
    return met.select(F.col("a.p_type").alias("p_type"), F.col("a.p_name").alias("name_a"), F.col("b.p_name").alias("name_b"), F.round(build_feature({"alias": "jw", "comparison_type": "jaro_winkler", "column_name": "p_name"}), 9).alias("jw"))


_WORDS = "(SELECT p_partkey AS id, p_brand, p_type, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_size FROM part)"


@query(
    "cmp_multi_jw",
    f"WITH p AS MATERIALIZED {_WORDS}, w AS (SELECT DISTINCT w1 AS w FROM p UNION SELECT DISTINCT w2 FROM p), {jw_sql('jw', '(SELECT a.w AS x, b.w AS y FROM w a, w b)')} "
    "SELECT a.id AS id_a, b.id AS id_b, a.p_size = b.p_size AND EXISTS (SELECT 1 FROM jw WHERE jw >= 0.9 AND x IN (a.w1, a.w2) AND y IN (b.w1, b.w2)) AS hit FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id",
)
def cmp_multi_jw(spark, sf_dir):
    words = lambda c: F.split(c, " ")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.get(words("p_name"), F.lit(0)).alias("w1"), F.get(words("p_name"), F.lit(1)).alias("w2"), F.col("p_size").alias("s1"), F.col("p_size").alias("s2"))
    rules = [{"column_name": "p_brand"}, {"column_name": "p_type"}]
    return pairs.compare_blocked(spark, p, p, rules, "id", unordered=True, specs=[{"alias": "hit", "comparison_type": "multi_jaro_winkler_search", "num_cols": 2, "jw_col_template": "w{n}", "jw_threshold": 0.9, "equal_and_not_null_templates": ["s{n}"]}])


_DIST = "(SELECT a.n_nationkey AS k0, b.n_nationkey AS k1, abs(a.n_nationkey - b.n_nationkey) * 10 AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)"


@query(
    "cmp_geo_distance",
    f"SELECT a.id AS id_a, b.id AS id_b, coalesce(d.distance, e.distance) AS distance FROM {_A_SQL} a JOIN {_B_SQL} b ON a.y = b.y AND a.bal = b.bal LEFT JOIN {_DIST} d ON d.k0 = a.nation AND d.k1 = b.nation "
    "LEFT JOIN (SELECT a.r_regionkey AS k0, b.r_regionkey AS k1, 1000 + abs(a.r_regionkey - b.r_regionkey) AS distance FROM region a CROSS JOIN region b) e ON e.k0 = a.nation % 5 AND e.k1 = b.nation % 5",
)
def cmp_geo_distance(spark, sf_dir):
    """A looked-up distance of nations in one region, else one of regions."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    near = n.alias("p").join(n.alias("q"), F.col("p.n_regionkey") == F.col("q.n_regionkey")).select(F.col("p.n_nationkey").alias("k0"), F.col("q.n_nationkey").alias("k1"), (F.abs(F.col("p.n_nationkey") - F.col("q.n_nationkey")) * 10).alias("distance"))
    codes = r.select(F.lit(1).alias("one"), "r_regionkey")
    far = codes.alias("p").join(codes.alias("q"), "one").select(F.col("p.r_regionkey").alias("k0"), F.col("q.r_regionkey").alias("k1"), (1000 + F.abs(F.col("p.r_regionkey") - F.col("q.r_regionkey"))).alias("distance"))
    a, b = _c(spark, sf_dir).withColumn("zone", F.col("nation") % 5), _s(spark, sf_dir).withColumn("zone", F.col("nation") % 5)
    rules = [{"column_name": "y"}, {"column_name": "bal"}]
    spec = {
        "alias": "distance", "comparison_type": "geo_distance", "key_count": 1, "table_name": "near", "column_name": "nation", "loc_a": "k0", "loc_b": "k1", "distance_col": "distance",
        "secondary_key_count": 1, "secondary_table_name": "far", "secondary_source_column": "zone", "secondary_loc_a": "k0", "secondary_loc_b": "k1", "secondary_distance_col": "distance",
    }
    return pairs.compare_blocked(spark, a, b, rules, "id", [spec], tables={"near": near, "far": far})


@query("cmp_geo_distance_two_keys", f"SELECT a.id AS id_a, b.id AS id_b, d.distance FROM {_A_SQL} a JOIN {_B_SQL} b ON a.y = b.y AND a.bal = b.bal LEFT JOIN (SELECT d.*, x.x AS x0, y.x AS x1 FROM {_DIST} d, (VALUES (0), (1)) x(x), (VALUES (0), (1)) y(x)) d ON d.k0 = a.nation AND d.k1 = b.nation AND d.x0 = a.y AND d.x1 = b.y")
def cmp_geo_distance_two_keys(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    near = n.alias("p").join(n.alias("q"), F.col("p.n_regionkey") == F.col("q.n_regionkey")).select(F.col("p.n_nationkey").alias("k0"), F.col("q.n_nationkey").alias("k1"), (F.abs(F.col("p.n_nationkey") - F.col("q.n_nationkey")) * 10).alias("distance"))
    zero_one = F.array(F.lit(0), F.lit(1))
    near = near.withColumn("x0", F.explode(zero_one)).withColumn("x1", F.explode(zero_one))
    a, b = _c(spark, sf_dir), _s(spark, sf_dir)
    rules = [{"column_name": "y"}, {"column_name": "bal"}]
    spec = {"alias": "distance", "comparison_type": "geo_distance", "key_count": 2, "table_name": "near", "source_column_a": "nation", "source_column_b": "y", "loc_a_0": "k0", "loc_a_1": "k1", "loc_b_0": "x0", "loc_b_1": "x1", "distance_col": "distance"}
    return pairs.compare_blocked(spark, a, b, rules, "id", [spec], tables={"near": near})


@query("tree_and_or", f"SELECT a.id AS id_a, b.id AS id_b, {_SX} AS same_x, abs(b.bal - a.bal) AS gap, {_SF} AS same_f {_FROM_AB} WHERE ({_SX} AND abs(b.bal - a.bal) <= 2) OR {_SF}")
def tree_and_or(spark, sf_dir):
    specs = [_EQ_X | {"alias": "same_x"}, {"alias": "gap", "comparison_type": "abs_diff", "column_name": "bal"}, _EQ_F | {"alias": "same_f"}]
    tree = {"operator": "OR", "comp_a": {"operator": "AND", "comp_a": {"feature_name": "same_x"}, "comp_b": {"feature_name": "gap", "comparison_type": "threshold", "threshold_expr": "<= 2"}}, "comp_b": {"feature_name": "same_f"}}
    return _compared(spark, sf_dir, specs, tree)


@query("tree_secondary", f"SELECT * FROM (SELECT a.id AS id_a, b.id AS id_b, abs(b.bal - a.bal) AS gap, a.bal + b.bal AS total {_FROM_AB}) WHERE gap >= 2 AND total >= 9")
def tree_secondary(spark, sf_dir):
    specs = [{"alias": "gap", "comparison_type": "abs_diff", "column_name": "bal"}, {"alias": "total", "comparison_type": "sum", "column_name": "bal"}]
    made = _compared(spark, sf_dir, specs)
    tree = {"secondary": True, "operator": "AND", "threshold_a": {"feature_name": "gap", "threshold": 2}, "threshold_b": {"feature_name": "total", "threshold": 9}}
    return made.where(tree_condition(tree, {}))


# --- aggregates over pairs


@query(
    "agg_hits",
    f"SELECT a.id AS id_a, b.id AS id_b, {_SX} AS exact, {_SX} AND {_SY} AS exact_all, count(b.id) OVER w AS hits, pow(count(b.id) OVER w, 2)::DOUBLE AS hits2, sum({_SX}::INTEGER) OVER w > 1 AS exact_mult, "
    f"CAST(sum(({_SX} AND {_SY})::INTEGER) OVER w AS BIGINT) AS exact_all_mult, pow(sum(({_SX} AND {_SY})::INTEGER) OVER w, 2)::DOUBLE AS exact_all_mult2 {_FROM_AB} WINDOW w AS (PARTITION BY a.id)",
)
def agg_hits(spark, sf_dir):
    specs = [_EQ_X | {"alias": "exact"}, {"alias": "exact_all", "comparison_type": "and", "comp_a": _EQ_X, "comp_b": _EQ_Y}]
    return _compared(spark, sf_dir, specs, wanted=["exact", "exact_all", "hits", "hits2", "exact_mult", "exact_all_mult", "exact_all_mult2"])


_HH_PAIRS = """(SELECT e.event_id AS id_a, f.event_id AS id_b, e.user_id AS serialp_a, f.user_id AS serialp_b, CAST(abs(e.event_id - f.event_id) % 15 AS INTEGER) AS byrdiff,
    e.event_type = f.event_type AS sexmatch, ((e.event_id * 7 + f.event_id * 13) % 100) / 100.0::DOUBLE AS namefrst_jw FROM events e JOIN events f ON e.user_id = f.user_id AND CAST(floor(e.value) AS BIGINT) = CAST(floor(f.value) AS BIGINT))"""


def _hh_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("v"))
    a, b = e.alias("e"), e.alias("f")
    met = a.join(b, (F.col("e.user_id") == F.col("f.user_id")) & (F.col("e.v") == F.col("f.v")))
    ea, eb = F.col("e.event_id"), F.col("f.event_id")
    return met.select(
        ea.alias("id_a"), eb.alias("id_b"), F.col("e.user_id").alias("serialp_a"), F.col("f.user_id").alias("serialp_b"), (F.abs(ea - eb) % 15).cast("int").alias("byrdiff"),
        (F.col("e.event_type") == F.col("f.event_type")).alias("sexmatch"), (((ea * 7 + eb * 13) % 100) / 100.0).alias("namefrst_jw"),
    )


_OTHERS = "coalesce(greatest(max({v}) OVER (PARTITION BY id_b, serialp_a, serialp_b ORDER BY id_a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max({v}) OVER (PARTITION BY id_b, serialp_a, serialp_b ORDER BY id_a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 0)"


@query("agg_jw_max_household", f"SELECT id_a, id_b, {_OTHERS.format(v='CASE WHEN byrdiff <= 10 THEN namefrst_jw ELSE 0 END')} AS jw_max_a, {_OTHERS.format(v='CASE WHEN byrdiff <= 10 AND sexmatch THEN namefrst_jw ELSE 0 END')} AS jw_max_b FROM {_HH_PAIRS}")
def agg_jw_max_household(spark, sf_dir):
    return pairs.household_aggregates(_hh_pairs(spark, sf_dir), "id", ["jw_max_a", "jw_max_b"]).select("id_a", "id_b", "jw_max_a", "jw_max_b")


# --- feature selections


@query("win_popularity_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ncount, count(*) OVER (PARTITION BY p_name) AS same_name FROM part")
def win_popularity_range(spark, sf_dir):
    df = selections.popularity(table(spark, sf_dir, "part"), "ncount", ["p_brand", "p_type"], "p_size", 3)
    return selections.popularity(df, "same_name", ["p_name"]).select("p_partkey", "ncount", "same_name")


@query("win_popularity_unpartitioned", "SELECT o_orderkey, count(*) OVER (ORDER BY CAST(floor(o_totalprice) AS BIGINT) RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS near FROM orders")
def win_popularity_unpartitioned(spark, sf_dir):
    """A band count over all rows, without a window that would sort them in one task."""
    df = table(spark, sf_dir, "orders").withColumn("price", F.floor("o_totalprice"))
    return selections.popularity(df, "near", None, "price", 50).select("o_orderkey", "near")


_PERSONS = """(SELECT l_orderkey AS serialp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pernum, l_partkey AS name, l_suppkey AS district,
    CAST(l_quantity AS INTEGER) AS relate, l_linenumber AS momloc FROM lineitem)"""


def _persons(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("serialp"), F.row_number().over(w).cast("long").alias("pernum"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("district"),
        F.col("l_quantity").cast("int").alias("relate"), F.col("l_linenumber").alias("momloc"),
    )


@query(
    "win_neighbor_aggregate",
    "WITH h AS (SELECT c_nationkey, c_custkey, c_acctbal FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM h) "
    "SELECT a.c_custkey, coalesce((SELECT string_agg(CAST(b.c_custkey * 3 AS VARCHAR), ',' ORDER BY b.r) FROM n b WHERE b.c_nationkey = a.c_nationkey AND b.r <> a.r AND abs(b.r - a.r) <= 2), '') AS neighbours FROM n a",
)
def win_neighbor_aggregate(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") * 3).alias("value"), F.lit(1).alias("pernum"))
    out = selections.neighbour_values(df, "value", "neighbours", "c_nationkey", "c_custkey", "pernum", 2)
    return out.select("c_custkey", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("fam_attach_pointer", f"WITH p AS MATERIALIZED {_PERSONS} SELECT a.serialp, a.pernum, b.name AS mother FROM p a LEFT JOIN p b ON a.serialp = b.serialp AND a.momloc = b.pernum AND a.momloc <> 0")
def fam_attach_pointer(spark, sf_dir):
    return selections.family_value(_persons(spark, sf_dir), "name", "mother", "momloc", "serialp", "pernum").select("serialp", "pernum", "mother")


@query(
    "fam_related_set",
    f"WITH p AS MATERIALIZED {_PERSONS}, s AS (SELECT a.serialp, a.pernum, array_to_string(list_sort(list_distinct(list(b.name))), ',') AS kin FROM p a JOIN p b ON a.serialp = b.serialp AND a.pernum <> b.pernum AND b.relate BETWEEN 20 AND 40 GROUP BY ALL) "
    "SELECT p.serialp, p.pernum, coalesce(kin, '') AS kin FROM p LEFT JOIN s USING (serialp, pernum)",
)
def fam_related_set(spark, sf_dir):
    p = _persons(spark, sf_dir).withColumn("id", F.col("serialp") * 100 + F.col("pernum"))
    out = selections.related_values(p, "name", "kin", "serialp", "relate", 20, 40, "id")
    return out.select("serialp", "pernum", F.coalesce(F.array_join(F.transform("kin", lambda x: x.cast("string")), ","), F.lit("")).alias("kin"))


@query(
    "fam_related_rows",
    f"WITH p AS MATERIALIZED {_PERSONS}, s AS (SELECT a.serialp, a.pernum, string_agg(b.name || ':' || b.relate, ',' ORDER BY b.pernum) AS kin FROM p a JOIN p b ON a.serialp = b.serialp AND a.pernum <> b.pernum AND b.relate BETWEEN 10 AND 45 AND b.momloc BETWEEN 1 AND 4 GROUP BY ALL) "
    "SELECT p.serialp, p.pernum, coalesce(kin, '') AS kin FROM p LEFT JOIN s USING (serialp, pernum)",
)
def fam_related_rows(spark, sf_dir):
    filters = [{"column": "relate", "min": 10, "max": 45}, {"column": "momloc", "min": 1, "max": 4}]
    out = selections.related_rows(_persons(spark, sf_dir), ["name", "relate"], "kin", "serialp", "pernum", filters)
    return out.select("serialp", "pernum", F.array_join(F.transform("kin", lambda r: F.concat_ws(":", r["name"].cast("string"), r["relate"].cast("string"))), ",").alias("kin"))


@query("feat_bigrams", "SELECT p_partkey, array_to_string(list_sort(list_transform(generate_series(1, length(p_name)), lambda i: substr(' ' || lower(p_name), i, 1) || ' ' || substr(' ' || lower(p_name), i + 1, 1))), '|') AS bigrams FROM part")
def feat_bigrams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(selections.bigrams(F.col("p_name")), "|").alias("bigrams"))


@query("feat_array_union_power", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, p_type, p_name])), '|') AS both_sets, pow(p_size, 2)::DOUBLE AS size2, p_size > 10 AS big FROM part")
def feat_array_union_power(spark, sf_dir):
    specs = [
        {"transform": "array", "input_columns": ["p_brand", "p_type"], "output_column": "one"},
        {"transform": "array", "input_columns": ["p_type", "p_name"], "output_column": "two"},
        {"transform": "union", "input_columns": ["one", "two"], "output_column": "both_sets"},
        {"transform": "power", "input_col": "p_size", "output_col": "size2", "exponent": 2},
        {"transform": "sql_condition", "condition": "p_size > 10", "output_col": "big"},
    ]
    out = selections.select_features(spark, table(spark, sf_dir, "part"), specs, "p_partkey", True)
    return out.select("p_partkey", F.array_join(F.sort_array("both_sets"), "|").alias("both_sets"), "size2", "big")


@query("feat_soundex")
def feat_soundex(spark, sf_dir):
    return selections.select_features(spark, table(spark, sf_dir, "part"), [{"transform": "soundex", "input_column": "p_name", "output_column": "code"}], "p_partkey", True).select("p_partkey", "code")


@query(
    "feat_minhash",
    "WITH g AS (SELECT p_partkey, list_transform(range(1, length(p_name) + 1), lambda i: lower(substr(' ' || p_name, CAST(i AS INTEGER), 1)) || ' ' || lower(substr(' ' || p_name, CAST(i AS INTEGER) + 1, 1))) AS t FROM part) "
    f"SELECT p_partkey, CAST(len(t) AS INTEGER) AS hashes_count, array_to_string({block_queries.minhash_sql('t', 4)}, ',') AS hashes FROM g",
)
def feat_minhash(spark, sf_dir):
    specs = [{"transform": "bigrams", "input_column": "p_name", "output_column": "grams"}, {"transform": "hash", "input_column": "grams", "output_column": "hashes", "number": 4}]
    return selections.select_features(spark, table(spark, sf_dir, "part"), specs, "p_partkey", True).select("p_partkey", F.col("hashes_count"), F.array_join(F.transform("hashes", lambda x: x.cast("string")), ",").alias("hashes"))


_KIN = [
    {"transform": "attach_family_col", "input_column": "name", "output_column": "mother", "person_pointer": "momloc", "family_id": "serialp", "person_id": "pernum"},
    {"transform": "attach_family_col", "input_column": "district", "output_column": "mother_district", "person_pointer": "momloc", "family_id": "serialp", "person_id": "pernum"},
    {"transform": "related_individuals", "input_column": "name", "output_column": "kin", "family_id": "serialp", "relate_col": "relate", "bottom_code": 20, "top_code": 40},
    {"transform": "related_individuals", "input_column": "district", "output_column": "elders", "family_id": "serialp", "relate_col": "relate", "bottom_code": 41, "top_code": 50},
    {"transform": "related_individual_rows", "input_cols": ["name", "relate"], "output_column": "rows", "family_id": "serialp", "person_id": "pernum", "filter_cols": [{"column": "relate", "min": 10, "max": 45}, {"column": "momloc", "min": 1, "max": 4}]},
]


@query(
    "fam_five_selections",
    f"WITH p AS MATERIALIZED {_PERSONS}, k AS (SELECT a.serialp, a.pernum, array_to_string(list_sort(list_distinct(list(b.name) FILTER (b.pernum <> a.pernum AND b.relate BETWEEN 20 AND 40))), ',') AS kin, "
    "array_to_string(list_sort(list_distinct(list(b.district) FILTER (b.pernum <> a.pernum AND b.relate BETWEEN 41 AND 50))), ',') AS elders, "
    "string_agg(b.name || ':' || b.relate, ',' ORDER BY b.pernum) FILTER (b.pernum <> a.pernum AND b.relate BETWEEN 10 AND 45 AND b.momloc BETWEEN 1 AND 4) AS kinrows FROM p a JOIN p b ON a.serialp = b.serialp GROUP BY ALL) "
    "SELECT p.serialp, p.pernum, m.name AS mother, m.district AS mother_district, coalesce(kin, '') AS kin, coalesce(elders, '') AS elders, coalesce(kinrows, '') AS kinrows "
    "FROM p JOIN k USING (serialp, pernum) LEFT JOIN p m ON m.serialp = p.serialp AND m.pernum = p.momloc AND p.momloc <> 0",
)
def fam_five_selections(spark, sf_dir):
    """Five selections over families, read from one grouping."""
    p = _persons(spark, sf_dir).withColumn("id", F.concat_ws("-", "serialp", "pernum"))
    out = selections.select_features(spark, p, _KIN, "id", True)
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    rows = F.array_join(F.transform("rows", lambda x: F.concat(x["name"].cast("string"), F.lit(":"), x["relate"].cast("string"))), ",")
    return out.select("serialp", "pernum", "mother", "mother_district", text("kin").alias("kin"), text("elders").alias("elders"), rows.alias("kinrows"))


# --- substitutions and lookups

_PAIRS = [("small", "little"), ("red", "crimson"), ("large", "big"), ("blue", "azure")]


@query(
    "sub_table",
    "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND m.t IS NOT NULL THEN m.t || coalesce(' ' || nullif(split_part(p_name, ' ', 2), ''), '') ELSE p_name END AS p_name FROM part LEFT JOIN (VALUES ('small', 'little'), ('red', 'crimson'), ('large', 'big'), ('blue', 'azure')) m(f, t) ON split_part(p_name, ' ', 1) = m.f",
)
def sub_table(spark, sf_dir):
    return prepare.substitute_table(table(spark, sf_dir, "part"), "p_name", _PAIRS, "p_type", "ECONOMY").select("p_partkey", "p_name")


@query("sub_regex", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name, '\\bsmall\\b', 'little', 'g'), '\\bred\\b', 'crimson', 'g'), '\\blarge\\b', 'big', 'g'), '\\bblue\\b', 'azure', 'g') AS p_name FROM part")
def sub_regex(spark, sf_dir):
    return prepare.substitute_words(table(spark, sf_dir, "part"), "p_name", _PAIRS).select("p_partkey", "p_name")


@query("attach_variable", "SELECT c_custkey, coalesce(n_regionkey, 99) AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def attach_variable(spark, sf_dir):
    lookup = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return prepare.attach_variable(table(spark, sf_dir, "customer"), lookup, "c_nationkey", "n_nationkey", "n_regionkey", "region", 99, "int").select("c_custkey", "region")


# --- decisions


def _scored(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("id_a"), F.col("o_orderkey").alias("id_b"), F.round(F.col("o_totalprice") / 500000, 4).alias("probability"))


_SCORED = "(SELECT o_custkey AS id_a, o_orderkey AS id_b, round(o_totalprice / 500000, 4) AS probability FROM orders)"
_RANKED = f"(SELECT *, rank() OVER w AS r, lead(probability) OVER w AS p2 FROM {_SCORED} WINDOW w AS (PARTITION BY id_a ORDER BY probability DESC, id_b))"


@query("decide_alpha", f"SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM {_SCORED}")
def decide_alpha(spark, sf_dir):
    return decide.by_alpha(_scored(spark, sf_dir), 0.5)


@query("decide_ratio", f"SELECT id_a, id_b, probability, CASE WHEN r = 1 AND probability >= 0.5 AND (p2 IS NULL OR p2 = 0 OR probability / p2 > 1.05) THEN 1 ELSE 0 END AS prediction FROM {_RANKED}")
def decide_ratio(spark, sf_dir):
    return decide.by_ratio(_scored(spark, sf_dir), 0.5, 1.05, "id")


@query("decide_best_of_a", f"SELECT id_a, id_b, probability, CASE WHEN row_number() OVER (PARTITION BY id_a ORDER BY probability DESC, id_b) = 1 AND probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM {_SCORED}")
def decide_best_of_a(spark, sf_dir):
    return decide.decide(_scored(spark, sf_dir), "drop_duplicate_a", 0.5, 1.3, "id")


_EVENT_PAIRS = "(SELECT event_id AS id_a, user_id AS id_b, CASE WHEN value > 200 THEN 1 ELSE 0 END AS prediction FROM events)"


@query("decide_one_to_one", f"SELECT id_a, id_b, prediction FROM (SELECT *, count(*) OVER (PARTITION BY id_b) AS n FROM {_EVENT_PAIRS} WHERE prediction = 1) WHERE n = 1")
def decide_one_to_one(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id_a"), F.col("user_id").alias("id_b"), F.when(F.col("value") > 200, 1).otherwise(0).alias("prediction"))
    return decide.one_to_one(e, "id")


# --- household rounds: orders are records, customers households; urgent orders link to the others of their customer


def _round_sides(spark, sf_dir):
    """Both sides, and as first round the pairs of one customer that alone share a status and price band on either side."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("serialp"), "o_orderstatus", F.floor(F.col("o_totalprice") / 10000).cast("int").alias("price"), urgent.alias("urgent"))
    a, b = o.where("urgent").drop("urgent"), o.where("not urgent").drop("urgent")
    alone = [d.groupBy("serialp", "o_orderstatus", "price").agg(F.min("id").alias(f"id_{x}"), F.count("*").alias(f"n_{x}")).where(f"n_{x} = 1") for x, d in (("a", a), ("b", b))]
    matches = alone[0].join(alone[1], ["serialp", "o_orderstatus", "price"]).select("id_a", "id_b")
    return a, b, matches


_SIDE = "SELECT o_orderkey AS id, o_custkey AS serialp, o_orderstatus, CAST(floor(o_totalprice / 10000) AS INTEGER) AS price FROM orders WHERE o_orderpriority {} ('1-URGENT', '2-HIGH')"
_ALONE = "(SELECT serialp, o_orderstatus, price, min(id) AS id FROM {} GROUP BY ALL HAVING count(*) = 1)"
_ROUND = f"""a AS MATERIALIZED ({_SIDE.format("IN")}), b AS MATERIALIZED ({_SIDE.format("NOT IN")}),
    m AS MATERIALIZED (SELECT x.id AS id_a, y.id AS id_b FROM {_ALONE.format("a")} x JOIN {_ALONE.format("b")} y USING (serialp, o_orderstatus, price)),
    hh AS (SELECT DISTINCT a.serialp AS serialp_a, b.serialp AS serialp_b FROM m JOIN a ON a.id = m.id_a JOIN b ON b.id = m.id_b),
    blocked AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b, serialp_a, serialp_b FROM hh JOIN a ON a.serialp = serialp_a JOIN b ON b.serialp = serialp_b WHERE a.id NOT IN (SELECT id_a FROM m) AND b.id NOT IN (SELECT id_b FROM m))"""


@query("hh_block_unmatched", f"WITH {_ROUND} SELECT * FROM blocked")
def hh_block_unmatched(spark, sf_dir):
    a, b, m = _round_sides(spark, sf_dir)
    return households.block_on_households(m, a, b, "id")


@query("hh_potential_filter", f"WITH {_ROUND} SELECT id_a, id_b, serialp_a, serialp_b, abs(b.price - a.price) AS gap, a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AS same FROM blocked JOIN a ON a.id = id_a JOIN b ON b.id = id_b WHERE abs(b.price - a.price) <= 5 AND a.o_orderstatus = b.o_orderstatus")
def hh_potential_filter(spark, sf_dir):
    a, b, m = _round_sides(spark, sf_dir)
    blocked = households.block_on_households(m, a, b, "id")
    specs = [{"alias": "gap", "comparison_type": "abs_diff", "column_name": "price"}, {"alias": "same", "comparison_type": "equals", "column_name": "o_orderstatus"}]
    tree = {"operator": "AND", "comp_a": {"feature_name": "gap", "comparison_type": "threshold", "threshold_expr": "<= 5"}, "comp_b": {"feature_name": "same"}}
    return pairs.compare(spark, blocked, a, b, "id", specs, tree)


@query("hh_block_all", f"WITH {_ROUND} SELECT DISTINCT a.id AS id_a, b.id AS id_b, serialp_a, serialp_b FROM hh JOIN a ON a.serialp = serialp_a JOIN b ON b.serialp = serialp_b")
def hh_block_all(spark, sf_dir):
    a, b, m = _round_sides(spark, sf_dir)
    return households.block_on_households(m, a, b, "id", records="all")


@query("hh_training_ids", f"WITH {_ROUND} SELECT m.id_a, m.id_b, a.serialp AS serialp_a, b.serialp AS serialp_b FROM m LEFT JOIN a ON a.id = id_a LEFT JOIN b ON b.id = id_b")
def hh_training_ids(spark, sf_dir):
    a, b, m = _round_sides(spark, sf_dir)
    return households.training_households(m, a, b, "id").select("id_a", "id_b", "serialp_a", "serialp_b")


@query("hh_families", f"WITH {_ROUND} SELECT DISTINCT id, serialp, o_orderstatus, price FROM a WHERE serialp IN (SELECT serialp FROM a WHERE id IN (SELECT id_a FROM m))")
def hh_families(spark, sf_dir):
    a, _, m = _round_sides(spark, sf_dir)
    return households.families_of(a, m.select(F.col("id_a").alias("id")), "id")


@query("hh_all_members", f"WITH {_ROUND} SELECT a.id, a.serialp, serialp_a, serialp_b, 'a' AS side FROM a JOIN hh ON a.serialp = serialp_a UNION ALL SELECT b.id, b.serialp, serialp_a, serialp_b, 'b' FROM b JOIN hh ON b.serialp = serialp_b")
def hh_all_members(spark, sf_dir):
    a, b, m = _round_sides(spark, sf_dir)
    linked = households.household_pairs(m, a, b, "id")
    return households.all_members(a.select("id", "serialp"), b.select("id", "serialp"), linked)


# --- reports


def _rounds(spark, sf_dir):
    a, b, m = _round_sides(spark, sf_dir)
    blocked = households.block_on_households(m, a, b, "id")
    near = pairs.compare(spark, blocked, a, b, "id", [{"alias": "gap", "comparison_type": "abs_diff", "column_name": "price"}], {"feature_name": "gap", "comparison_type": "threshold", "threshold_expr": "<= 3"})
    return a, b, m, near.select("id_a", "id_b")


_ROUNDS = _ROUND + ", m2 AS (SELECT id_a, id_b FROM blocked JOIN a ON a.id = id_a JOIN b ON b.id = id_b WHERE abs(b.price - a.price) <= 3), la AS (SELECT *, CASE WHEN id IN (SELECT id_a FROM m) THEN 1 WHEN id IN (SELECT id_a FROM m2) THEN 2 ELSE 0 END AS rnd FROM a), lb AS (SELECT *, CASE WHEN id IN (SELECT id_b FROM m) THEN 1 WHEN id IN (SELECT id_b FROM m2) THEN 2 ELSE 0 END AS rnd FROM b)"


@query(
    "report_percent_linked",
    f'WITH {_ROUNDS}, g AS (SELECT serialp, count(*) AS total, count(*) FILTER (rnd = 1) AS r1, count(*) FILTER (rnd = 2) AS r2 FROM la GROUP BY serialp) SELECT serialp, total, r1, r2, r1 / total AS "R1_pct", CASE WHEN total > r1 THEN r2 / (total - r1) END AS "R2_pct" FROM g WHERE r1 > 0',
)
def report_percent_linked(spark, sf_dir):
    a, _, m, second = _rounds(spark, sf_dir)
    return reports.percent_linked(a, m, second, "id")


@query("hh_drop_links", f"WITH {_ROUNDS} SELECT id, serialp FROM a WHERE id NOT IN (SELECT id_a FROM m) AND id NOT IN (SELECT id_a FROM m2)")
def hh_drop_links(spark, sf_dir):
    a, _, m, second = _rounds(spark, sf_dir)
    return households.drop_links(a, "id", "a", m, second).select("id", "serialp")


@query("report_mean_percent_linked", f'WITH {_ROUNDS}, g AS (SELECT serialp, count(*) AS total, count(*) FILTER (rnd = 1) AS r1, count(*) FILTER (rnd = 2) AS r2 FROM la GROUP BY serialp) SELECT round(avg(r1 / total), 9) AS "R1_mean", round(avg(CASE WHEN total > r1 THEN r2 / (total - r1) END), 9) AS "R2_mean" FROM g WHERE r1 > 0')
def report_mean_percent_linked(spark, sf_dir):
    a, _, m, second = _rounds(spark, sf_dir)
    means = reports.mean_percent_linked(reports.percent_linked(a, m, second, "id"))
    return means.select(F.round("R1_mean", 9).alias("R1_mean"), F.round("R2_mean", 9).alias("R2_mean"))


@query(
    "report_bucket_modes",
    "SELECT o_orderkey, CASE WHEN price < 20 THEN '1' ELSE '0' END AS low, CASE WHEN price > 30 AND price <> 40 THEN '1' ELSE '0' END AS high_dni, CASE WHEN price >= 25 THEN 'null' ELSE CAST(k - k % 5 AS VARCHAR) END AS low_group, "
    "CASE WHEN price > 25 THEN CAST(k - k % 5 AS VARCHAR) ELSE 'null' END AS high_group, CAST(CAST(price <> k AS INTEGER) AS VARCHAR) AS differs, CASE WHEN price <> k THEN CAST(k - k % 5 AS VARCHAR) ELSE 'null' END AS differs_group, "
    "CAST(CAST(sum(CASE WHEN price BETWEEN 20 AND 40 AND k > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS BIGINT) AS VARCHAR) AS children "
    "FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice / 10000) AS INTEGER) AS price, CAST(o_orderkey % 50 AS INTEGER) AS k FROM orders)",
)
def report_bucket_modes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 10000).cast("int").alias("price"), (F.col("o_orderkey") % 50).cast("int").alias("k"))
    return o.select(
        "o_orderkey", reports.below("price", 20).alias("low"), reports.above("price", 30, dni=40).alias("high_dni"), reports.low_by_group("price", 25, "k", 5).alias("low_group"),
        reports.high_by_group("price", 25, "k", 5).alias("high_group"), reports.differs("price", "k").alias("differs"), reports.differs_by_group("price", "k", "k", 5).alias("differs_group"),
        reports.children_over("price", "k", "o_custkey", 20, 40, 10).alias("children"),
    )


def _rep_sql() -> str:
    cells = "SELECT rnd, 'status' AS feature, o_orderstatus AS value FROM {t} UNION ALL SELECT rnd, 'price', CAST(price - price % 10 AS VARCHAR) FROM {t} UNION ALL SELECT rnd, 'dear', CASE WHEN price > 40 THEN '1' ELSE '0' END FROM {t} UNION ALL SELECT rnd, 'family size', CASE WHEN n <= 5 THEN '1-5' WHEN n <= 20 THEN '6-20' WHEN n <= 60 THEN '21-60' ELSE '61-' END FROM (SELECT *, count(*) OVER (PARTITION BY serialp) AS n FROM {t})"
    one = "(SELECT feature, value, count(*) AS n_{s}, count(*) FILTER (rnd = 1) AS n_{s}_r1, count(*) FILTER (rnd = 2) AS n_{s}_r2 FROM ({c}) GROUP BY ALL)"
    names = [f"n_{s}{r}" for s in ("a", "b") for r in ("", "_r1", "_r2")]
    counts = ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)
    rates = ", ".join(f"round(coalesce({n} / nullif(sum({n}) OVER (PARTITION BY feature), 0), 0), 9) AS {n.replace('n_', 'pct_', 1)}" for n in names)
    return f"WITH {_ROUNDS} SELECT feature, value, {counts}, {rates} FROM {one.format(s='a', c=cells.format(t='la'))} FULL JOIN {one.format(s='b', c=cells.format(t='lb'))} USING (feature, value)"


@query("report_representivity", _rep_sql())
def report_representivity(spark, sf_dir):
    a, b, m, second = _rounds(spark, sf_dir)
    features = {"status": reports.plain("o_orderstatus"), "price": reports.interval("price", 10), "dear": reports.above("price", 40), "family size": reports.commonality("serialp")}
    out = reports.representivity(a, b, m, second, features, "id")
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("pct_")})


_CROSS = f"WITH {_ROUNDS}, u AS (SELECT id_b, id_a, 1 AS round FROM m UNION ALL SELECT id_b, id_a, 2 FROM m2)"


@query("export_crosswalk", f"{_CROSS} SELECT id_b, id_a, round, a.price AS price_a, b.price AS price_b, b.serialp AS serialp_b FROM u JOIN a ON a.id = id_a JOIN b ON b.id = id_b")
def export_crosswalk(spark, sf_dir):
    a, b, m, second = _rounds(spark, sf_dir)
    return reports.crosswalk([m, second], a, b, "id", ["price"], ["price", "serialp"], with_round=True)


@query("export_fixed_width", f"{_CROSS} SELECT lpad(CAST(id_b AS VARCHAR), 10, ' ') || lpad(CAST(id_a AS VARCHAR), 10, ' ') || lpad(CAST(a.price AS VARCHAR), 15, ' ') AS value FROM u JOIN a ON a.id = id_a JOIN b ON b.id = id_b")
def export_fixed_width(spark, sf_dir):
    a, b, m, second = _rounds(spark, sf_dir)
    return io.fixed_width(reports.crosswalk([m, second], a, b, "id", ["price"], []), {"id_a": 10, "id_b": 10})


@query("export_marked_union", "SELECT c_nationkey AS nation, c_acctbal AS balance, true AS from_a FROM customer UNION ALL SELECT s_nationkey, s_acctbal, false FROM supplier")
def export_marked_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), "s_name")
    return io.marked_union(c, s, "from_a")


@query("export_as_text", "SELECT p_partkey, '[' || p_brand || ',' || p_type || ']' AS tags FROM part")
def export_as_text(spark, sf_dir):
    return io.as_text(table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type").alias("tags")))


@query("tab_summary", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def tab_summary(spark, sf_dir):
    return reports.tabulate(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


# --- models: pairs of parts of one brand and type; the label is one name

_LABELS = {
    "id_column": "id",
    "comparison_features": [
        {"alias": "jw", "comparison_type": "jaro_winkler", "column_name": "p_name"},
        {"alias": "gap", "comparison_type": "abs_diff", "column_name": "p_size"},
        {"alias": "same_type", "comparison_type": "equals_as_int", "column_name": "p_type", "categorical": True},
        {"alias": "y", "comparison_type": "equals_as_int", "column_name": "p_name"},
    ],
    "pipeline_features": [{"input_column": "gap", "output_column": "gap_bucket", "transformer_type": "bucketizer", "splits": [0, 2, 8, 100], "categorical": True}],
    "training": {
        "dependent_var": "y", "independent_vars": ["jw", "gap", "same_type", "gap_bucket"], "chosen_model": {"type": "logistic_regression", "maxIter": 20}, "decision": "drop_duplicate_with_threshold_ratio",
        "threshold": [0.5, 0.8], "threshold_ratio": [1.0, 1.3], "n_training_iterations": 3, "model_parameters": [{"type": "logistic_regression", "maxIter": [10]}, {"type": "decision_tree", "maxDepth": [3]}], "model_parameter_search": {"strategy": "grid"},
    },
}


def _labelled(spark, sf_dir, told=None):
    """told: __of and further columns of A records, which their pairs get with them."""
    p = _parts(spark, sf_dir)
    a = p if told is None else p.join(told, F.col("id") == F.col("__of"), "left").drop("__of")
    own = [] if told is None else [{"alias": c, "comparison_type": "fetch_a", "column_name": c} for c in told.columns if c != "__of"]
    return pairs.compare_blocked(spark, a, p, [{"column_name": "p_brand"}, {"column_name": "p_size"}], "id", [*_LABELS["comparison_features"], *own], unordered=True)


@query("ml_score_logistic")
def ml_score_logistic(spark, sf_dir):
    seen = ml.kinds(_labelled(spark, sf_dir), _LABELS).cache()
    model = ml.train(seen, _LABELS, weighted=True)
    scored = lambda told=None: model.score(_labelled(spark, sf_dir, told), seen)
    return decide.by_ratio_told(scored, 0.5, 1.0, "id").select("id_a", "id_b", "y", F.round("probability", 3).alias("probability"), "prediction")


@query(
    "ml_confusion_metrics",
    f"SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f_measure, round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 9) AS mcc FROM (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM (SELECT id_b % 3 = 0 AS y, probability >= 0.6 AS p FROM {_SCORED}))",
)
def ml_confusion_metrics(spark, sf_dir):
    df = _scored(spark, sf_dir).select((F.col("id_b") % 3 == 0).cast("int").alias("y"), "probability")
    made = ml.confusion(decide.by_alpha(df, 0.6), "y").withColumns(ml.metric_columns())
    return made.withColumn("mcc", F.round("mcc", 9))


@query("ml_explore_grid")
def ml_explore_grid(spark, sf_dir):
    return ml.summarize(ml.explore(_labelled(spark, sf_dir), _LABELS)).select("model", "alpha", "ratio", F.round("mcc_mean", 3).alias("mcc_mean"), F.round("pr_auc_mean", 3).alias("pr_auc_mean"))


_FOLDS = f"(SELECT *, CAST(id_b % 4 AS INTEGER) AS fold, CAST(id_b % 3 = 0 AS INTEGER) AS y FROM {_SCORED})"


def _folds(spark, sf_dir):
    return _scored(spark, sf_dir).select("id_a", "id_b", "probability", (F.col("id_b") % 4).cast("int").alias("fold"), (F.col("id_b") % 3 == 0).cast("int").alias("y"))


@query(
    "ml_threshold_cells",
    f"WITH r AS (SELECT *, rank() OVER w AS r, lead(probability) OVER w AS p2 FROM {_FOLDS} WINDOW w AS (PARTITION BY fold, id_a ORDER BY probability DESC, id_b)), "
    "c AS (SELECT * FROM (VALUES (0.4), (0.6), (0.8)) a(alpha), (VALUES (1.0), (1.3)) b(ratio)), "
    "p AS (SELECT fold, CAST(alpha AS DOUBLE) AS alpha, CAST(ratio AS DOUBLE) AS ratio, y = 1 AS y, r = 1 AND probability >= alpha AND coalesce(probability / nullif(p2, 0) > ratio, true) AS hit FROM r, c), "
    "m AS (SELECT fold, alpha, ratio, count(*) FILTER (y AND hit) AS tp, count(*) FILTER (NOT y AND hit) AS fp, count(*) FILTER (y AND NOT hit) AS fn, count(*) FILTER (NOT y AND NOT hit) AS tn FROM p GROUP BY ALL) "
    "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM m",
)
def ml_threshold_cells(spark, sf_dir):
    """All folds and threshold cells, counted in one aggregation over the pairs."""
    cells = spark.createDataFrame([(f, x, y) for f in range(4) for x in (0.4, 0.6, 0.8) for y in (1.0, 1.3)], "fold int, alpha double, ratio double")
    return ml.threshold_metrics(_folds(spark, sf_dir), "y", cells, "drop_duplicate_with_threshold_ratio", "id").drop("f_measure", "mcc")


@query(
    "ml_pr_areas",
    f"WITH g AS (SELECT fold, round(CAST(probability AS DECIMAL(9, 4)), 2) AS p, sum(y) AS pos, count(*) AS n FROM {_FOLDS} GROUP BY ALL), "
    "c AS (SELECT fold, p, sum(pos) OVER w / sum(pos) OVER (PARTITION BY fold) AS r, sum(pos) OVER w / sum(n) OVER w AS pre FROM g WINDOW w AS (PARTITION BY fold ORDER BY p DESC)), "
    "l AS (SELECT *, lag(r, 1, 0) OVER w AS r0, lag(pre, 1, 1) OVER w AS pre0 FROM c WINDOW w AS (PARTITION BY fold ORDER BY p DESC)) "
    "SELECT fold, round(sum((r - r0) * (pre + pre0) / 2), 9) AS pr_auc FROM l GROUP BY fold",
)
def ml_pr_areas(spark, sf_dir):
    return ml.pr_areas(_folds(spark, sf_dir), "y", "fold").withColumn("pr_auc", F.round("pr_auc", 9))


@query("ml_importances_boosted")
def ml_importances_boosted(spark, sf_dir):
    """Split counts and gains of a boosted model, by feature."""
    model = {"type": "gradient_boosted_trees", "maxIter": 5, "maxDepth": 3}
    return ml.train(_labelled(spark, sf_dir), _LABELS, model=model).importances(spark)


@query("ml_importances")
def ml_importances(spark, sf_dir):
    return ml.train(_labelled(spark, sf_dir), _LABELS).importances(spark)


# --- whole runs


@query(
    "link_parts",
    "SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, a.p_name = b.p_name AS same_name, abs(b.p_size - a.p_size) AS gap FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 1 WHERE a.p_partkey < b.p_partkey AND (a.p_name = b.p_name OR a.p_size = b.p_size)",
)
def link_parts(spark, sf_dir):
    """Map, block, compare, filter: links of parts within the part table."""
    maps = [{"column_name": "p_name", "alias": "name", "transforms": [{"type": "lowercase_strip"}]}, {"column_name": "p_brand"}, {"column_name": "p_type", "transforms": [{"type": "lowercase_strip"}]}, {"column_name": "p_size"}]
    source = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    a, b = prepare.map_columns(source, maps, "id", True), prepare.map_columns(source, maps, "id", False)
    rules = [{"column_name": "p_brand"}, {"column_name": "p_type"}, {"column_name": "size_1", "explode": True, "expand_length": 1, "derived_from": "p_size", "dataset": "a"}]
    specs = [{"alias": "same_name", "comparison_type": "equals", "column_name": "name"}, {"alias": "gap", "comparison_type": "abs_diff", "column_name": "p_size"}]
    tree = {"operator": "OR", "comp_a": {"feature_name": "same_name"}, "comp_b": {"feature_name": "gap", "comparison_type": "threshold", "threshold_expr": "<= 0"}}
    return pairs.compare_blocked(spark, a, b, rules, "id", specs, tree, unordered=True)


@query(
    "link_parts_jw",
    f"WITH p AS MATERIALIZED (SELECT p_partkey AS id, lower(trim(p_name)) AS name, p_brand, p_size FROM part), {jw_sql('jw', '(SELECT a.name AS x, b.name AS y FROM (SELECT DISTINCT name FROM p) a, (SELECT DISTINCT name FROM p) b)')} "
    "SELECT a.id AS id_a, b.id AS id_b, round(jw, 9) AS jw FROM p a JOIN p b ON a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 1 AND a.id < b.id JOIN jw ON jw.x = a.name AND jw.y = b.name WHERE jw >= 0.8",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map, block on brand and a band of sizes, Jaro-Winkler of names, threshold: the flagship."""
    source = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), apply_transform(F.col("p_name"), {"type": "lowercase_strip"}, True).alias("name"), "p_brand", "p_size")
    rules = [{"column_name": "p_brand"}, {"column_name": "size_1", "explode": True, "expand_length": 1, "derived_from": "p_size", "dataset": "a"}]
    specs = [{"alias": "jw", "comparison_type": "jaro_winkler", "column_name": "name"}]
    tree = {"feature_name": "jw", "comparison_type": "threshold", "threshold": 0.8}
    return pairs.compare_blocked(spark, source, source, rules, "id", specs, tree, unordered=True).withColumn("jw", F.round("jw", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | name_queries.queries() | block_queries.queries()


@cache
def _sql() -> dict[str, str]:
    return _SQL | name_queries.oracle_sql() | block_queries.oracle_sql()


def oracle_sql() -> dict[str, str]:
    return dict(_sql())
