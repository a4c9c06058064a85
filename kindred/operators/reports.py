"""Reports: share of households linked in round two, representivity, crosswalks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _round(df: DataFrame, first: DataFrame, second: DataFrame, id_column: str, side: str) -> DataFrame:
    """The records with linked_round 0, 1 or 2; the first round wins."""
    one = first.select(F.col(f"{id_column}_{side}").alias("__r1")).distinct()
    two = second.select(F.col(f"{id_column}_{side}").alias("__r2")).distinct()
    out = df.join(one, F.col(id_column) == F.col("__r1"), "left").join(two, F.col(id_column) == F.col("__r2"), "left")
    return out.withColumn("linked_round", F.when(F.col("__r1").isNotNull(), 1).when(F.col("__r2").isNotNull(), 2).otherwise(0)).drop("__r1", "__r2")


def percent_linked(records: DataFrame, first: DataFrame, second: DataFrame, id_column: str = "histid", serial: str = "serialp") -> DataFrame:
    """For households with anybody linked in round 1: R1_pct = R1 / all, R2_pct = R2 / (all - R1); null if nobody is left."""
    marked = _round(records.select(serial, id_column), first, second, id_column, "a")
    by = marked.groupBy(serial).agg(F.count("*").alias("total"), F.count_if(F.col("linked_round") == 1).alias("r1"), F.count_if(F.col("linked_round") == 2).alias("r2"))
    return by.where("r1 > 0").select(serial, "total", "r1", "r2", (F.col("r1") / F.col("total")).alias("R1_pct"), F.try_divide(F.col("r2"), F.col("total") - F.col("r1")).alias("R2_pct"))


def mean_percent_linked(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("R1_pct").alias("R1_mean"), F.avg("R2_pct").alias("R2_mean"))


# --- representivity: each feature is a label and an expression that gives its bucket


def interval(column: str, width: int) -> Column:
    x = F.col(column).try_cast("int")
    return (x - x % width).cast("string")


def below(column: str, limit: int) -> Column:
    return F.when(F.col(column).try_cast("int") < limit, 1).otherwise(0).cast("string")


def above(column: str, limit: int, dni: int | None = None) -> Column:
    """1 over the limit, 0 else; the "does not inquire" code never counts as over it."""
    x = F.col(column).try_cast("int")
    ok = x > limit
    return F.when(ok if dni is None else ok & (x != dni), 1).otherwise(0).cast("string")


def low_by_group(column: str, limit: int, group: str, width: int) -> Column:
    """Intervals of the group column for rows under the limit, "null" for others."""
    return F.when(F.col(column).try_cast("int") >= limit, "null").otherwise(interval(group, width))


def high_by_group(column: str, limit: int, group: str, width: int, dni: int | None = None) -> Column:
    x = F.col(column).try_cast("int")
    ok = x > limit
    return F.when(ok if dni is None else ok & (x != dni), interval(group, width)).otherwise("null")


def differs(column: str, other: str) -> Column:
    return (F.col(column).try_cast("int") != F.col(other).try_cast("int")).cast("int").cast("string")


def differs_by_group(column: str, other: str, group: str, width: int) -> Column:
    return F.when(F.col(column).try_cast("int") != F.col(other).try_cast("int"), interval(group, width)).otherwise("null")


def commonality(column: str) -> Callable[[DataFrame, str], DataFrame]:
    """How common a name is: 1-5, 6-20, 21-60 or 61- bearers. A function that adds the column, since names are counted first and joined then."""

    def add(df: DataFrame, name: str) -> DataFrame:
        bearers = df.groupBy(F.col(column).alias("__name")).agg(F.count("*").alias("__n"))
        n = F.col("__n")
        size = F.when(n <= 5, "1-5").when(n <= 20, "6-20").when(n <= 60, "21-60").otherwise("61-")
        return df.join(bearers, F.col(column).eqNullSafe(F.col("__name")), "left").withColumn(name, size).drop("__name", "__n")

    return add


def children_over(relate: str, age: str, serial: str, low: int = 300, high: int = 399, years: int = 10) -> Column:
    """Members of the household who are children older than `years`."""
    return F.sum((F.col(relate).between(low, high) & (F.col(age) > years)).cast("int")).over(Window.partitionBy(serial)).cast("string")


def plain(column: str) -> Column:
    return F.col(column).cast("string")


def representivity(a: DataFrame, b: DataFrame, first: DataFrame, second: DataFrame, features: dict[str, Column | Callable], id_column: str = "histid") -> DataFrame:
    """feature, value, then count and percent of each side in all records and those linked in round 1 and in round 2.

    Both sides are unpivoted to (feature, value) and counted in one aggregation each.
    """
    sides = []
    for side, df in (("a", a), ("b", b)):
        marked = _round(df, first, second, id_column, side)
        for k, f in enumerate(features.values()):
            marked = marked.withColumn(f"__f{k}", f) if isinstance(f, Column) else f(marked, f"__f{k}")
        cells = marked.select("linked_round", *[f"__f{k}" for k in range(len(features))])
        pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(f"__f{k}"), F.lit("null")).alias("value")) for k, n in enumerate(features)])
        long = cells.select("linked_round", F.inline(pairs))
        sums = long.groupBy("feature", "value").agg(F.count("*").alias(f"n_{side}"), F.count_if(F.col("linked_round") == 1).alias(f"n_{side}_r1"), F.count_if(F.col("linked_round") == 2).alias(f"n_{side}_r2"))
        w = Window.partitionBy("feature")
        names = [f"n_{side}", f"n_{side}_r1", f"n_{side}_r2"]
        sides.append(sums.withColumns({n.replace("n_", "pct_", 1): F.try_divide(F.col(n), F.sum(n).over(w)) for n in names}))
    out = sides[0].join(sides[1], ["feature", "value"], "full")
    counts = [c for c in out.columns if c.startswith("n_")]
    rates = [c for c in out.columns if c.startswith("pct_")]
    return out.na.fill(0, counts).na.fill(0.0, rates)


def crosswalk(matches: list[DataFrame], raw_a: DataFrame, raw_b: DataFrame, id_column: str, vars_a: list[str], vars_b: list[str], with_round: bool = False) -> DataFrame:
    """Ids of all matches with the wanted raw variables of both sides, suffixed _a and _b."""
    out = None
    for k, m in enumerate(matches, 1):
        part = m.select(f"{id_column}_b", f"{id_column}_a", *([F.lit(k).alias("round")] if with_round else []))
        out = part if out is None else out.unionByName(part)
    left = raw_a.select(F.col(id_column).alias("__ia"), *[F.col(v).alias(f"{v}_a") for v in vars_a])
    right = raw_b.select(F.col(id_column).alias("__ib"), *[F.col(v).alias(f"{v}_b") for v in vars_b])
    return out.join(left, F.col(f"{id_column}_a") == F.col("__ia")).join(right, F.col(f"{id_column}_b") == F.col("__ib")).drop("__ia", "__ib")


# The features of the report where a configuration names none.
DEFAULT_FEATURES = (
    {"label": "sex", "kind": "plain", "column": "sex"},
    {"label": "age", "kind": "interval", "column": "age", "width": 10},
    {"label": "race", "kind": "plain", "column": "race_div_100"},
    {"label": "relationship to household head", "kind": "plain", "column": "relate_div_100"},
    {"label": "marst", "kind": "plain", "column": "marst"},
    {"label": "married", "kind": "below", "column": "marst", "limit": 3},
    {"label": "married, by age", "kind": "low_by_group", "column": "marst", "limit": 3, "group": "age", "width": 10},
    {"label": "marriage duration at least ten years", "kind": "above", "column": "durmarr", "limit": 9, "dni": 99},
    {"label": "marriage duration at least 10 years, by age", "kind": "high_by_group", "column": "durmarr", "limit": 9, "group": "age", "width": 10, "dni": 99},
    {"label": "region of residence", "kind": "plain", "column": "region_of_residence"},
    {"label": "region of birth", "kind": "plain", "column": "region"},
    {"label": "socioeconomic status", "kind": "interval", "column": "sei", "width": 15},
    {"label": "lifetime migrant", "kind": "differs", "column": "bpl_clean", "other": "statefip"},
    {"label": "lifetime migrant by age", "kind": "differs_by_group", "column": "bpl_clean", "other": "statefip", "group": "age", "width": 10},
    {"label": "namefrst_unstd commonality", "kind": "commonality", "column": "namefrst_unstd"},
    {"label": "namefrst_std commonality", "kind": "commonality", "column": "namefrst_std"},
    {"label": "namelast_clean commonality", "kind": "commonality", "column": "namelast_clean"},
)


def default_features(columns: list[str]) -> list[dict[str, Any]]:
    """Those of DEFAULT_FEATURES whose columns are there."""
    have = {c.lower() for c in columns}
    return [s for s in DEFAULT_FEATURES if {s[k] for k in ("column", "other", "group") if k in s} <= have]


def tabulate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows for each combination of values."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def report_features(spec: list[dict[str, Any]]) -> dict[str, Column | Callable]:
    """Features of a configuration: [{label, kind, ...arguments of the builder named kind}]."""
    kinds = {f.__name__: f for f in (plain, interval, below, above, low_by_group, high_by_group, differs, differs_by_group, commonality, children_over)}
    return {s["label"]: kinds[s["kind"]](**{k: v for k, v in s.items() if k not in ("label", "kind")}) for s in spec}
