"""Preparation of one side: filters, column mappings, substitutions, lookups."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.transforms import apply_transform
from kindred.sources.io import read_csv, read_substitutions, substitution_table


LITERAL_PAIRS = 1000


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    return df.filter(F.expr(expression))


def filter_households(df: DataFrame, expression: str, serial: str) -> DataFrame:
    """All members of households in which somebody qualifies; a semi join, so no row is multiplied."""
    chosen = df.filter(F.expr(expression)).select(F.col(serial).alias("__serial")).distinct()
    return df.join(chosen, F.col(serial) == F.col("__serial"), "left_semi")


def filter_training_subset(df: DataFrame, training: DataFrame, id_column: str, training_id: str, serial: str) -> DataFrame:
    """All members of households of anybody whose id is in the training data."""
    ids = training.select(F.col(training_id).alias("__id")).distinct()
    serials = df.join(ids, F.col(id_column) == F.col("__id"), "left_semi").select(F.col(serial).alias("__serial")).distinct()
    return df.join(serials, F.col(serial) == F.col("__serial"), "left_semi")


def map_columns(df: DataFrame, mappings: list[dict[str, Any]], id_column: str, is_a: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id and the mapped columns; a mapping may use the alias of an earlier one.

    Independent mappings share one projection; a new one starts only where an alias is used again.
    """
    fresh: dict[str, Column] = {}
    done: list[str] = []
    out = df

    def flush():
        nonlocal out, fresh
        if fresh:
            out = out.withColumns(fresh)
            fresh = {}

    for m in mappings:
        alias = m.get("alias", m["column_name"])
        override = m.get("override_column_a" if is_a else "override_column_b")
        source = override or m["column_name"]
        steps = m.get("override_transforms", []) if override else m.get("transforms", [])
        used = {source, *(s.get("column_to_append") for s in steps)}
        if used & fresh.keys() or alias in fresh:
            flush()
        constant = m.get("set_value_column_a" if is_a else "set_value_column_b")
        column = F.lit(constant) if constant is not None else reduce(lambda c, s: apply_transform(c, s, is_a), steps, F.col(f"`{source}`"))
        fresh[alias] = column
        if alias not in done:
            done.append(alias)
    flush()
    return out.select(*dict.fromkeys([id_column, *keep, *done]))


def substitute_table(df: DataFrame, column: str, pairs: list[tuple[str, str]] | DataFrame, join_column: str | None = None, join_value: Any = None) -> DataFrame:
    """Where the first word is a `from` (and the join column has its value): its `to`, then the second word; others stay.

    A list of pairs is a map literal, so nothing is joined; a frame (__from, __to) is joined by the first word.
    """
    if isinstance(pairs, list) and not pairs:
        return df
    if isinstance(pairs, list) and len(pairs) > LITERAL_PAIRS:
        pairs = df.sparkSession.createDataFrame(list(dict(pairs).items()), "__from string, __to string")
    words = F.split(F.col(column), " ")
    if isinstance(pairs, list):
        table = F.create_map(*[F.lit(x) for p in dict(pairs).items() for x in p])
        new = F.try_element_at(table, F.get(words, F.lit(0)))
    else:
        df = df.join(pairs, F.get(words, F.lit(0)) == F.col("__from"), "left")
        new = F.col("__to")
    hit = new.isNotNull()
    if join_column is not None:
        hit = hit & (F.col(join_column) == F.lit(join_value))
    second = F.get(words, F.lit(1))
    return df.withColumn(column, F.when(hit, F.when(second.isNotNull(), F.concat_ws(" ", new, second)).otherwise(new)).otherwise(F.col(column))).drop("__from", "__to")


def substitute_words(df: DataFrame, column: str, pairs: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Every whole word that is a `from` becomes its `to`: pair by pair for a list, where a later pair finds what an earlier one made.

    A frame (__from, __to), which may have any number of pairs, is looked up once for each word of the distinct values.
    """
    if isinstance(pairs, list):
        out = F.col(column)
        for old, new in pairs:
            out = F.regexp_replace(out, rf"\b{re.escape(old)}\b", new.replace("\\", "\\\\").replace("$", "\\$"))
        return df.withColumn(column, out)
    values = df.select(F.col(column).alias("__value")).where("__value IS NOT NULL").distinct()
    pieces = values.select("__value", F.posexplode(F.regexp_extract_all("__value", F.lit(r"\w+|\W+"), F.lit(0))).alias("__at", "__piece"))
    met = pieces.join(pairs, F.col("__piece") == F.col("__from"), "left").select("__value", F.struct("__at", F.coalesce("__to", "__piece").alias("p")).alias("s"))
    made = met.groupBy("__value").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["p"]), "").alias("__made"))
    return df.join(made, F.col(column) == F.col("__value"), "left").withColumn(column, F.coalesce("__made", F.col(column))).drop("__value", "__made")


def substitute(spark: SparkSession, df: DataFrame, specs: list[dict[str, Any]]) -> DataFrame:
    """All substitution_columns of a configuration; KeyError for a spec that names neither a join nor a word replacement.

    Files of up to LITERAL_PAIRS pairs become literals of the plan; longer ones stay frames, and are joined.
    """
    for spec in specs:
        for s in spec["substitutions"]:
            path = s["substitution_file"]
            pairs = read_substitutions(spark, path, LITERAL_PAIRS)
            table = substitution_table(spark, path) if pairs is None else pairs
            if s.get("regex_word_replace"):
                df = substitute_words(df, spec["column_name"], table)
            elif "join_column" in s and "join_value" in s:
                df = substitute_table(df, spec["column_name"], table, s["join_column"], s["join_value"])
            else:
                raise KeyError(f"a substitution of {spec['column_name']} needs join_column and join_value, or regex_word_replace")
    return df


def attach_variable(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, value: str, output: str, filler: Any = None, kind: str | None = None) -> DataFrame:
    """A lookup's value by key, a filler where there is none; Spark broadcasts the lookup where its size allows."""
    side = lookup.select(F.col(lookup_key).alias("__key"), F.col(value).alias("__value")).dropDuplicates(["__key"])
    found = F.col("__value") if filler is None else F.coalesce("__value", F.lit(filler))
    found = found.try_cast(kind) if kind else found
    return df.join(side, F.col(key) == F.col("__key"), "left").withColumn(output, found).drop("__key", "__value")


def attach_variable_file(spark: SparkSession, df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    lookup = read_csv(spark, spec["region_dict"])
    return attach_variable(df, lookup, spec["input_column"], spec["col_to_join_on"], spec["col_to_add"], spec["output_column"], spec.get("null_filler"), spec.get("col_type"))
