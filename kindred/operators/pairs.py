"""Pairs: re-attached records, lookups, comparison features, filters and aggregates over candidates."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.features import AGGREGATES, HOUSEHOLD_AGGREGATES, build_feature, compared_names
from kindred.functions.jaro import of_pairs
from kindred.functions.trees import leaves, tree_condition
from kindred.operators.blocking import candidate_ids, expanded
from kindred.sources.io import read_csv

#: Distinct names of a column, at most, whose similarities are looked up; where there are more, each pair of records is compared.
NAMES = 256


def attach_records(pairs: DataFrame, a: DataFrame, b: DataFrame, id_column: str) -> DataFrame:
    """The pairs as `pm`, with both records as `a` and `b`."""
    p = pairs.alias("pm")
    out = p.join(a.alias("a"), F.col(f"pm.{id_column}_a") == F.col(f"a.{id_column}"))
    return out.join(b.alias("b"), F.col(f"pm.{id_column}_b") == F.col(f"b.{id_column}"))


def join_distance(df: DataFrame, table: DataFrame, name: str, conditions: list[tuple[str, str]]) -> DataFrame:
    """Left join of a distance table under its name on (side column, table column) pairs."""
    on = [F.col(side) == F.col(f"{name}.{key}") for side, key in conditions]
    return df.join(table.alias(name), on, "left")


def _distance_keys(spec: dict[str, Any], prefix: str = "") -> list[tuple[str, str]]:
    get = lambda k: spec[f"{prefix}{k}"]
    if int(get("key_count")) == 1:
        column = spec["secondary_source_column"] if prefix else spec["column_name"]
        return [(f"a.{column}", get("loc_a")), (f"b.{column}", get("loc_b"))]
    one, two = get("source_column_a"), get("source_column_b")
    return [(f"a.{one}", get("loc_a_0")), (f"a.{two}", get("loc_b_0")), (f"b.{one}", get("loc_a_1")), (f"b.{two}", get("loc_b_1"))]


def join_distances(spark: SparkSession, df: DataFrame, specs: list[dict[str, Any]], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """All distance tables that geo_distance features need, primary and secondary, each once."""
    tables, done = tables or {}, set()
    for s in specs:
        if s.get("comparison_type") != "geo_distance":
            continue
        for prefix, key, file in (("", "table_name", "distances_file"), ("secondary_", "secondary_table_name", "secondary_distances_file")):
            name = s.get(key)
            if name and name not in done:
                done.add(name)
                table = tables[name] if name in tables else read_csv(spark, s[file])
                df = join_distance(df, table, name, _distance_keys(s, prefix))
    return df


def aggregate_features(df: DataFrame, id_column: str, wanted: list[str]) -> DataFrame:
    """hits and its kin as windows over the A record, without a self-join."""
    w = Window.partitionBy(f"{id_column}_a")
    return df.withColumns(_aggregates(df, id_column, wanted, lambda c: c.over(w)))


def aggregate_totals(df: DataFrame, id_column: str, wanted: list[str]) -> DataFrame:
    """The same in a row for each A record, whose id is __of."""
    made = _aggregates(df, id_column, wanted, lambda c: c)
    return df.groupBy(F.col(f"{id_column}_a").alias("__of")).agg(*[c.alias(n) for n, c in made.items()])


def _aggregates(df: DataFrame, id_column: str, wanted: list[str], over: Callable[[Column], Column]) -> dict[str, Column]:
    hits = lambda: over(F.count(f"{id_column}_b"))
    total = lambda c: over(F.sum(F.col(c).cast("int")))
    build = {
        "hits": hits,
        "hits2": lambda: F.pow(hits(), F.lit(2)),
        "exact_mult": lambda: total("exact") > 1,
        "exact_all_mult": lambda: total("exact_all"),
        "exact_all_mult2": lambda: F.pow(total("exact_all"), F.lit(2)),
    }
    for name, needs in (("exact_mult", "exact"), ("exact_all_mult", "exact_all"), ("exact_all_mult2", "exact_all")):
        if name in wanted and needs not in df.columns:
            raise ValueError(f"{name} needs the feature {needs}")
    return {n: build[n]() for n in AGGREGATES if n in wanted}


def household_aggregates(
    df: DataFrame, id_column: str, wanted: list[str], serial: str = "serialp", jw: str = "namefrst_jw", born: str = "byrdiff", sex: str = "sexmatch", years: int = 10
) -> DataFrame:
    """jw_max_a and jw_max_b: the best first-name similarity among the *other* candidates of a B record in a household pair.

    Only candidates whose birth years are at most `years` apart count, for jw_max_b only those of equal sex too; 0 if
    there is none. The best of the group, how often it occurs and the best below it give the maximum over everyone else.
    """
    near = F.col(born) <= years
    w = Window.partitionBy(f"{id_column}_b", f"{serial}_a", f"{serial}_b")
    for name, ok in (("jw_max_a", near), ("jw_max_b", near & (F.col(sex).cast("int") == 1))):
        if name not in wanted:
            continue
        df = df.withColumn("__v", F.coalesce(F.when(ok, F.col(jw).cast("double")), F.lit(0.0))).withColumn("__top", F.max("__v").over(w))
        is_top = F.col("__v") == F.col("__top")
        df = df.withColumn("__tops", F.count_if(is_top).over(w)).withColumn("__next", F.max(F.when(~is_top, F.col("__v"))).over(w))
        alone = is_top & (F.col("__tops") == 1)
        df = df.withColumn(name, F.when(alone, F.coalesce("__next", F.lit(0.0))).otherwise(F.col("__top"))).drop("__v", "__top", "__tops", "__next")
    return df


def needed_features(tree: dict[str, Any] | None, specs: list[dict[str, Any]], extra: list[str] = ()) -> list[dict[str, Any]]:
    names = {leaf.get("feature_name") for leaf in leaves(tree)} | set(extra)
    return [s for s in specs if s["alias"] in names]


def compare(
    spark: SparkSession, pairs: DataFrame, a: DataFrame, b: DataFrame, id_column: str, specs: list[dict[str, Any]], tree: dict[str, Any] | None = None,
    wanted: list[str] | None = None, keep_records: bool = False, tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Ids and features of the pairs that the comparison tree accepts.

    Each feature is computed once, as a column; the tree reads the columns. Features that are on the pair table already
    are kept as they are; pair and household aggregates follow, over the accepted pairs.
    """
    wanted = [s["alias"] for s in specs] if wanted is None else list(wanted)
    out = _accepted(spark, attach_records(pairs, a, b, id_column), pairs.columns, a, b, id_column, specs, tree, wanted, keep_records, tables)
    if aggregates := [n for n in wanted if n in AGGREGATES]:
        out = aggregate_features(out, id_column, aggregates)
    if household := [n for n in wanted if n in HOUSEHOLD_AGGREGATES]:
        out = household_aggregates(out, id_column, household)
    return out


def _accepted(spark, both, columns, a, b, id_column, specs, tree, wanted, keep_records, tables) -> DataFrame:
    """compare() without aggregates; both: the pairs as `pm`, with their records as `a` and `b`; columns: those of the pair table."""
    ready = {n for n in columns if n in wanted}
    by = {s["alias"]: s for s in specs}
    plain = [by[n] for n in dict.fromkeys([*wanted, *(leaf.get("feature_name") for leaf in leaves(tree))]) if n in by and n not in ready]
    both = join_distances(spark, both, plain, tables)
    ids = [F.col(f"pm.{c}").alias(c) for c in columns]
    records = []
    if keep_records:
        records = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s, df in (("a", a), ("b", b)) for c in df.columns if c != id_column]
    out = both.select(*ids, *records, *[build_feature(s) for s in plain])
    condition = tree_condition(tree, by, {s["alias"] for s in plain} | set(columns))
    return out if condition is None else out.where(condition)


def _few_names(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The distinct names, null as empty, of the columns that have at most NAMES."""
    found = {}
    for c in columns:
        names = df.select(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")).distinct().limit(NAMES + 1).collect()
        if 0 < len(names) <= NAMES:
            found[c] = sorted(r["name"] for r in names)
    return found


def looked_up_names(spark: SparkSession, a: DataFrame, b: DataFrame, specs: list[dict[str, Any]]) -> tuple[DataFrame, DataFrame, list[dict[str, Any]]]:
    """a, b and specs with the similarities of few distinct names made ready: each is computed once, not once for a pair of records.

    A record of a carries its name's similarities to all names of b, and one of b the place of its own name among them.
    """
    wanted = list(dict.fromkeys(n for s in specs for n in compared_names(s)))
    ours, theirs = (_few_names(df, list(dict.fromkeys(n[k] for n in wanted))) for k, df in enumerate((a, b)))
    found = {(x, y): (f"__jw_{x}_{y}", f"__at_{y}") for x, y in wanted if x in ours and y in theirs}

    def told(df: DataFrame, column: str, rows: list[tuple], added: str) -> DataFrame:
        table = F.broadcast(spark.createDataFrame(rows, f"__name string, {added}"))
        return df.join(table, F.coalesce(F.col(column).cast("string"), F.lit("")) == F.col("__name")).drop("__name")

    for x in dict.fromkeys(x for x, _ in found):
        to = [y for v, y in found if v == x]
        made = [of_pairs([n for n in ours[x] for _ in theirs[y]], theirs[y] * len(ours[x])).reshape(len(ours[x]), -1).tolist() for y in to]
        a = told(a, x, list(zip(ours[x], *made)), ", ".join(f"{found[x, y][0]} array<double>" for y in to))
    for y in dict.fromkeys(y for _, y in found):
        b = told(b, y, [(n, k) for k, n in enumerate(theirs[y])], f"__at_{y} int")
    return a, b, [s | {"looked_up": found} if compared_names(s) else s for s in specs]


#: Words of specifications that say that pairs of equal records can differ.
_OF_PAIRS = {"rand", "randn", "random", "uuid", "shuffle"}


def _read_of_b(b: DataFrame, id_column: str, *specs: Any) -> list[str] | None:
    """The columns of b that the specs name as a word anywhere; None if that can't tell what is read, if ids are, or if equal values can differ (as 0.0 and -0.0)."""
    text = repr(specs).lower()
    words = set(re.findall(r"\w+", text))
    if words & ({id_column.lower(), f"{id_column}_b".lower()} | _OF_PAIRS) or "{n}" in text or "extra_children" in text or re.search(r"\bb\b(?!\.\w)", text):
        return None
    if not all(re.fullmatch(r"\w+", c) for c in b.columns):
        return None
    read = {c: kind for c, kind in b.dtypes if c.lower() in words}
    plain = all(re.fullmatch(r"tinyint|smallint|int|bigint|boolean|date|string|binary|timestamp(_ntz)?|decimal\(.*\)", kind) for kind in read.values())
    return list(read) if plain else None


def compare_blocked(
    spark: SparkSession, a: DataFrame, b: DataFrame, blocking: list[dict[str, Any]], id_column: str, specs: list[dict[str, Any]], tree: dict[str, Any] | None = None,
    wanted: list[str] | None = None, tables: dict[str, DataFrame] | None = None, unordered: bool = False,
) -> DataFrame:
    """compare() of the pairs that the blocking rules make, in the join that makes them: pairs are never shuffled or joined to their records.

    hits and its kin are counted for each A record in a pass of their own, and its pairs get them with its record. Features that read
    few distinct records of b are computed once for each of these, and the pairs are made of what the tree accepts.
    """
    wanted = [s["alias"] for s in specs] if wanted is None else list(wanted)
    a, b, specs = looked_up_names(spark, a, b, specs)
    read = _read_of_b(b, id_column, specs, tree)

    def made(left: DataFrame, more: list[str]) -> DataFrame:
        met = candidate_ids(left, b, blocking, id_column, unordered=unordered, records=True, read=read).alias("pm")
        own = [{"alias": n, "comparison_type": "fetch_a", "column_name": n} for n in more]
        columns = [c for c in met.columns if c not in ("a", "b")]
        return expanded(_accepted(spark, met, columns, left, b, id_column, [*specs, *own], tree, [*wanted, *more], False, tables), id_column, unordered)

    aggregates = [n for n in wanted if n in AGGREGATES]
    out = made(a, [])
    if aggregates:
        totals = aggregate_totals(out, id_column, aggregates)
        out = made(a.join(totals, F.col(id_column) == F.col("__of"), "left").drop("__of"), aggregates)
    if household := [n for n in wanted if n in HOUSEHOLD_AGGREGATES]:
        out = household_aggregates(out, id_column, household)
    return out
