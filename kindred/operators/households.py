"""Household rounds: candidates among the unmatched members of households that a first round has linked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched(df: DataFrame, matches: DataFrame, id_column: str, side: str) -> DataFrame:
    ids = matches.select(F.col(f"{id_column}_{side}").alias("__id"))
    return df.join(ids, F.col(id_column) == F.col("__id"), "left_anti")


def household_pairs(matches: DataFrame, a: DataFrame, b: DataFrame, id_column: str, serial: str = "serialp") -> DataFrame:
    """Distinct (serial_a, serial_b) of the matches; serials come from the records if the matches don't carry them."""
    if f"{serial}_a" in matches.columns and f"{serial}_b" in matches.columns:
        return matches.select(f"{serial}_a", f"{serial}_b").distinct()
    left = a.select(F.col(id_column).alias("__ia"), F.col(serial).alias(f"{serial}_a"))
    right = b.select(F.col(id_column).alias("__ib"), F.col(serial).alias(f"{serial}_b"))
    m = matches.join(left, F.col(f"{id_column}_a") == F.col("__ia")).join(right, F.col(f"{id_column}_b") == F.col("__ib"))
    return m.select(f"{serial}_a", f"{serial}_b").distinct()


def block_on_households(matches: DataFrame, a: DataFrame, b: DataFrame, id_column: str, serial: str = "serialp", records: str = "unmatched_only") -> DataFrame:
    """({id}_a, {id}_b, serial_a, serial_b) of members of linked households: of the unmatched ones, or of all."""
    if records not in ("unmatched_only", "all"):
        raise ValueError(f"records_to_match is unmatched_only or all, not {records!r}")
    pairs = household_pairs(matches, a, b, id_column, serial)
    if records == "unmatched_only":
        a, b = unmatched(a, matches, id_column, "a"), unmatched(b, matches, id_column, "b")
    left = a.select(F.col(id_column).alias(f"{id_column}_a"), F.col(serial).alias(f"{serial}_a"))
    right = b.select(F.col(id_column).alias(f"{id_column}_b"), F.col(serial).alias(f"{serial}_b"))
    return pairs.join(left, f"{serial}_a").join(right, f"{serial}_b").select(f"{id_column}_a", f"{id_column}_b", f"{serial}_a", f"{serial}_b").distinct()


def training_households(training: DataFrame, a: DataFrame, b: DataFrame, id_column: str, serial: str = "serialp") -> DataFrame:
    """Labelled pairs with the household ids of both sides."""
    left = a.select(F.col(id_column).alias("__ia"), F.col(serial).alias(f"{serial}_a"))
    right = b.select(F.col(id_column).alias("__ib"), F.col(serial).alias(f"{serial}_b"))
    base = training.drop(f"{serial}_a", f"{serial}_b")
    return base.join(left, F.col(f"{id_column}_a") == F.col("__ia"), "left").join(right, F.col(f"{id_column}_b") == F.col("__ib"), "left").drop("__ia", "__ib")


def families_of(df: DataFrame, ids: DataFrame, id_column: str, serial: str = "serialp") -> DataFrame:
    """All members of the households of the given ids (one column named as the id)."""
    picked = ids.select(F.col(id_column).alias("__id"))
    serials = df.join(picked, F.col(id_column) == F.col("__id"), "left_semi").select(F.col(serial).alias("__serial")).distinct()
    return df.join(serials, F.col(serial) == F.col("__serial"), "left_semi").distinct()


def drop_links(df: DataFrame, id_column: str, side: str, *matches: DataFrame) -> DataFrame:
    """The records that none of the match tables links."""
    for m in matches:
        df = unmatched(df, m, id_column, side)
    return df


def all_members(a: DataFrame, b: DataFrame, pairs: DataFrame, serial: str = "serialp") -> DataFrame:
    """Members of both sides of linked households, with their pair of serials and a `side`."""
    common = [c for c in a.columns if c in set(b.columns)]
    out = []
    for side, df in (("a", a), ("b", b)):
        own = pairs.select(F.col(f"{serial}_{side}").alias("__serial"), f"{serial}_a", f"{serial}_b").distinct()
        out.append(df.select(*common).join(own, F.col(serial) == F.col("__serial")).select(*common, f"{serial}_a", f"{serial}_b", F.lit(side).alias("side")))
    return out[0].unionByName(out[1])
