"""Feature selections: new columns from single rows, from households and from neighbourhoods."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.operators.prepare import attach_variable_file


def bigrams(text: Column, pad: bool = True) -> Column:
    """Sorted two-grams of the lower-cased characters, joined by a blank; one blank stands before the text unless pad is off."""
    s = F.lower(F.concat(F.lit(" "), text) if pad else text)
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.concat(F.substring(s, i, F.lit(1)), F.lit(" "), F.substring(s, i + 1, F.lit(1))))
    return F.when(F.length(s) > 1, F.sort_array(pairs)).otherwise(F.when(s.isNotNull(), F.array().cast("array<string>")))


#: Min-hashes are (x * h + y) modulo this prime, with h from the first eight hex digits of a token's md5: any SQL engine can do the same.
MINHASH_PRIME = 2**31 - 1


def minhash_factors(number: int, seed: int = 445123) -> list[tuple[int, int]]:
    """(x, y) of each hash function."""
    digits = [hashlib.md5(f"{seed}:{k}".encode()).hexdigest() for k in range(number)]
    return [(1 + int(d[:8], 16) % (MINHASH_PRIME - 1), int(d[8:16], 16) % MINHASH_PRIME) for d in digits]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once for a row; named inside a lambda, it would be made anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def minhash(tokens: Column, number: int, seed: int = 445123) -> Column:
    """`number` min-hashes of a set of tokens; without a fitted vocabulary, so hashes of both sides compare."""
    hashes = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % MINHASH_PRIME)
    factors = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in minhash_factors(number, seed)])
    return _bound(hashes, lambda own: F.transform(factors, lambda f: F.array_min(F.transform(own, lambda h: (f["x"] * h + f["y"]) % MINHASH_PRIME))))


def bands(hashes: Column, rows: int) -> Column:
    """A key for every `rows` min-hashes, of which two sets with similarity s share one with probability s^rows.

    As a blocking column that is exploded, k bands find a pair with probability 1 - (1 - s^rows)^k.
    """
    return _bound(hashes, lambda own: F.transform(F.sequence(F.lit(1), F.size(own) - (rows - 1), F.lit(rows)), lambda i: F.xxhash64(i, F.slice(own, i, F.lit(rows)))))


def popularity(df: DataFrame, output: str, columns: list[str] | None = None, range_column: str | None = None, reach: int | None = None) -> DataFrame:
    """How many rows share the columns' values, within `reach` of the range column if given.

    A band count is computed on distinct values: counts per (columns, value), each put into its own bucket of `reach` values
    and the two beside it, a window over each bucket, and a join back. So no group of rows is ever sorted in one task,
    also without columns to partition by, and a wide reach costs no more than a narrow one.
    """
    columns = list(columns or [])
    if not columns and not (range_column and reach):
        return df.withColumn(output, F.lit(df.count()))
    if not (range_column and reach):
        counts = df.groupBy(*[F.col(c).alias(f"__{c}") for c in columns]).agg(F.count("*").alias(output))
        return df.join(counts, _same(columns), "left").drop(*[f"__{c}" for c in columns])
    value = F.col(range_column).cast("long")
    n = df.groupBy(*columns, value.alias("__at")).agg(F.count("*").alias("__n"))
    own = F.floor(F.col("__at") / reach)
    near = F.when(own.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(own - 1, own, own + 1))
    spread = n.withColumn("__home", own).withColumn("__bucket", F.explode(near))
    band = Window.partitionBy(*columns, "__bucket").orderBy("__at").rangeBetween(-reach, reach)
    summed = spread.withColumn(output, F.sum("__n").over(band)).where(F.col("__bucket").eqNullSafe(F.col("__home")))
    sums = summed.select(*[F.col(c).alias(f"__{c}") for c in columns], F.col("__at").alias("__to"), output)
    on = _same(columns) & value.eqNullSafe(F.col("__to")) if columns else value.eqNullSafe(F.col("__to"))
    return df.join(sums, on, "left").drop("__to", *[f"__{c}" for c in columns])


def _same(columns: list[str]) -> Column:
    out = F.lit(True)
    for k, c in enumerate(columns):
        hit = F.col(c).eqNullSafe(F.col(f"__{c}"))
        out = hit if k == 0 else out & hit
    return out


def neighbour_values(df: DataFrame, value: str, output: str, neighbourhood: str, household: str, person: str, reach: int) -> DataFrame:
    """The values of the first person of every household within `reach` households in the neighbourhood, its own left out."""
    heads = df.groupBy(neighbourhood, household).agg(F.min_by(value, person).alias("__value"))
    w = Window.partitionBy(neighbourhood).orderBy(household)
    around = heads.select(
        F.col(neighbourhood).alias("__nbhd"),
        F.col(household).alias("__hh"),
        F.concat(F.collect_list("__value").over(w.rowsBetween(-reach, -1)), F.collect_list("__value").over(w.rowsBetween(1, reach))).alias(output),
    )
    return df.join(around, F.col(neighbourhood).eqNullSafe(F.col("__nbhd")) & F.col(household).eqNullSafe(F.col("__hh")), "left").drop("__nbhd", "__hh")


def neighbour_band(df: DataFrame, value: str, output: str, neighbourhood: str, number: str, household: str, person: str, reach: float) -> DataFrame:
    """The values of the first person of every other household of the neighbourhood whose number is within `reach`, by number and household.

    Households stand in buckets as wide as `reach`, and in both beside their own, so a record reads all its neighbours from one sorted
    array; records and households are shuffled, never pairs or lists. Number is numeric or a date; a null number has no neighbours.
    """
    from kindred.operators.blocking import as_number

    spark = df.sparkSession
    first = df.groupBy(F.col(neighbourhood).alias("__nbhd"), F.col(household).alias("__hh")).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(number).alias("n")), person).alias("__h"))
    heads = first.withColumn("__at", as_number(F.col("__h.n"), dict(df.dtypes)[number]))
    at = F.col("__at") / reach if reach else F.col("__at")
    margin = F.greatest(F.lit(1.0), F.abs(at)) * 1e-9  # rounding
    place = lambda c: F.floor(c).cast("long")
    home, around = (place(at), F.sequence(place(at - 1 - margin), place(at + 1 + margin))) if reach else (at, F.array(at))
    # Lists cost more than the bytes they are made of tell: a given number of partitions is not merged.
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    finite = heads.where(F.abs("__at") < float("inf"))
    spread = finite.select(F.col("__nbhd").alias("__of"), F.explode(around).alias("__bucket"), F.struct(F.col("__h.n").alias("n"), F.col("__hh").alias("h"), F.col("__h.v").alias("v"), F.col("__at").alias("x")).alias("__near"))
    lists = spread.repartition(n, "__of", "__bucket").groupBy("__of", "__bucket").agg(F.array_sort(F.collect_list("__near")).alias("__list"))
    told = df.join(finite.select("__nbhd", "__hh", "__at", home.alias("__home")), (F.col(neighbourhood) == F.col("__nbhd")) & (F.col(household) == F.col("__hh")), "left")
    met = told.repartition(n, neighbourhood, "__home").join(lists, (F.col(neighbourhood) == F.col("__of")) & (F.col("__home") == F.col("__bucket")), "left")
    near = F.filter("__list", lambda o: (F.abs(o["x"] - F.col("__at")) <= reach) & ~o["h"].eqNullSafe(F.col(household)))
    found = F.transform(near, lambda o: o["v"])
    return met.withColumn(output, F.coalesce(found, F.array().cast(f"array<{dict(df.dtypes)[value]}>"))).select(*[c for c in df.columns if c != output], output)


def family_value(df: DataFrame, value: str, output: str, pointer: str, family: str, person: str) -> DataFrame:
    """The value of the family member that the pointer names; null for pointer 0 and for nobody."""
    members = df.select(F.col(family).alias("__family"), F.col(person).alias("__person"), F.col(value).alias("__value")).dropDuplicates(["__family", "__person"])
    on = (F.col(family) == F.col("__family")) & (F.col(pointer) == F.col("__person")) & (F.col(pointer) != 0)
    return df.join(members, on, "left").withColumn(output, F.col("__value")).drop("__family", "__person", "__value")


def related_values(df: DataFrame, value: str, output: str, family: str, relate: str, low: int, high: int, id_column: str) -> DataFrame:
    """The set of values of the other members of the family whose relate code is in [low, high]; sorted."""
    fit = df.where(F.col(relate).between(low, high) & F.col(value).isNotNull())
    members = fit.groupBy(F.col(family).alias("__family")).agg(F.collect_list(F.struct(F.col(id_column).alias("i"), F.col(value).alias("v"))).alias("__members"))
    others = F.filter("__members", lambda m: m["i"] != F.col(id_column))
    found = F.array_sort(F.array_distinct(F.transform(others, lambda m: m["v"])))
    return df.join(members, F.col(family) == F.col("__family"), "left").withColumn(output, F.coalesce(found, F.filter(found, lambda x: F.lit(False)))).drop("__family", "__members")


def related_rows(df: DataFrame, columns: list[str], output: str, family: str, person: str, filters: list[dict[str, Any]]) -> DataFrame:
    """Structs of `columns` of the other members of the family that pass every min / max filter."""
    keep = F.lit(True)
    for f in filters:
        keep = keep & F.col(f["column"]).between(f["min"], f["max"])
    members = df.where(keep).groupBy(F.col(family).alias("__family")).agg(F.array_sort(F.collect_list(F.struct(F.col(person).alias("__p"), F.struct(*columns).alias("__row")))).alias("__members"))
    others = F.filter("__members", lambda m: m["__p"] != F.col(person))
    rows = F.transform(others, lambda m: m["__row"])
    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in df.select(*columns).dtypes) + ">>"
    return df.join(members, F.col(family) == F.col("__family"), "left").withColumn(output, F.coalesce(rows, F.array().cast(kind))).drop("__family", "__members")


#: Members of a family that its one grouped row holds; families with more are looked up by joins.
LARGEST_FAMILY = 1000
#: Selections that look at a person's family, and the keys of their specifications that name columns of its members.
FAMILY = ("attach_family_col", "related_individuals", "related_individual_rows")


def family_selections(df: DataFrame, specs: list[dict[str, Any]], id_column: str, is_a: bool, largest: int = LARGEST_FAMILY) -> DataFrame:
    """Several selections of FAMILY kinds over one family column, from one grouping: records are shuffled once.

    A family's records meet in one row, as an array; each is then taken out of it beside the array, from which all
    selections are read. Records without a family, and those of families with more than `largest` records, which no row should
    hold, go the way of one join for each selection.
    """
    (family,) = {s["family_id"] for s in specs}
    sizes = df.groupBy(F.col(family).alias("__f")).agg(F.count("*").alias("__n")).where((F.col("__n") > largest) | F.col("__f").isNull())
    apart = [r["__f"] for r in sizes.limit(LARGEST_FAMILY + 1).collect()]
    if len(apart) > LARGEST_FAMILY:
        return _one_by_one(df, specs, id_column, is_a)
    known = [x for x in apart if x is not None]
    alone = F.col(family).isNull() | (F.col(family).isin(known) if known else F.lit(False))
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    grouped = (df.where(~alone) if apart else df).groupBy(F.col(family).alias("__family")).agg(F.collect_list(own).alias("__members"))
    each = grouped.select("__members", F.explode("__members").alias("__me")).select("__members", "__me.*")
    out = each
    for s in specs:
        out = out.withColumn(_target(s), _from_members(df, s, id_column, is_a))
    out = out.drop("__members")
    return out.unionByName(_one_by_one(df.where(alone), specs, id_column, is_a).select(*out.columns)) if apart else out


def _from_members(df: DataFrame, spec: dict[str, Any], id_column: str, is_a: bool) -> Column:
    """A selection's value for the record in the columns, from the array of its family."""
    kind, members = spec["transform"], F.col("__members")
    if kind == "attach_family_col":
        pointer, person, value = spec["person_pointer"], spec["person_id"], _source(spec, is_a)
        found = F.filter(members, lambda m: (m[person] == F.col(pointer)) & (F.col(pointer) != 0))
        return F.get(F.transform(found, lambda m: m[value]), F.lit(0))
    if kind == "related_individuals":
        value, relate = _source(spec, is_a), spec["relate_col"]
        fit = F.filter(members, lambda m: m[relate].between(int(spec["bottom_code"]), int(spec["top_code"])) & m[value].isNotNull())
        # As in related_values(): null where nobody of the family, the record itself included, has such a code.
        others = F.array_sort(F.array_distinct(F.transform(F.filter(fit, lambda m: m[id_column] != F.col(id_column)), lambda m: m[value])))
        return F.when(F.size(fit) > 0, others)
    person, columns = spec["person_id"], spec["input_cols"]
    keep = [f for f in spec.get("filter_cols", []) if f.get("dataset", "a" if is_a else "b") == ("a" if is_a else "b")]
    kept = members
    for f in keep:
        kept = _between(kept, f)
    rows = F.array_sort(F.transform(kept, lambda m: F.struct(m[person].alias("__p"), F.struct(*[m[c].alias(c) for c in columns]).alias("__row"))))
    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in df.select(*columns).dtypes) + ">>"
    return F.transform(F.filter(rows, lambda m: m["__p"] != F.col(person)), lambda m: m["__row"]).cast(kind)


def _between(members: Column, f: dict[str, Any]) -> Column:
    return F.filter(members, lambda m: m[f["column"]].between(f["min"], f["max"]))


def _one_by_one(df: DataFrame, specs: list[dict[str, Any]], id_column: str, is_a: bool) -> DataFrame:
    for s in specs:
        df = _one(df.sparkSession, df, s, id_column, is_a)
    return df


def _source(spec: dict[str, Any], is_a: bool) -> str:
    name = spec.get("input_column") or spec.get("input_col")
    return spec.get("override_column_a" if is_a else "override_column_b") or name


def _target(spec: dict[str, Any]) -> str:
    return spec.get("output_column") or spec.get("output_col")


def select_features(spark: SparkSession, df: DataFrame, specs: list[dict[str, Any]], id_column: str, is_a: bool) -> DataFrame:
    """All feature_selections of a configuration: first those of rows, then households, then what is marked post_agg_feature."""
    household = ("neighbor_aggregate", "attach_family_col", "related_individual_rows")
    live = [s for s in specs if not s.get("skip")]
    rank = lambda s: 2 if s.get("post_agg_feature") else 1 if s["transform"] in household else 0
    todo = sorted(live, key=rank)
    while todo:
        together = _together(todo, is_a)
        if len(together) > 1:
            df = family_selections(df, together, id_column, is_a)
        else:
            df = _one(spark, df, todo[0], id_column, is_a)
            if todo[0].get("checkpoint"):
                df = df.checkpoint()
        todo = todo[len(together) :]
    return df


def _together(specs: list[dict[str, Any]], is_a: bool) -> list[dict[str, Any]]:
    """The first selection, and those after it that look at the same families and at no result of one before."""
    out: list[dict[str, Any]] = []
    for s in specs:
        plain = s["transform"] in FAMILY and not s.get("checkpoint") and s.get("set_value_column_a" if is_a else "set_value_column_b") is None
        made = {_target(x) for x in out}
        reads = {str(v) for v in s.values()} | set(s.get("input_cols", [])) | {f["column"] for f in s.get("filter_cols", [])}
        if not plain or (out and (s["family_id"] != out[0]["family_id"] or reads & made)):
            break
        out.append(s)
    return out or specs[:1]


def _one(spark: SparkSession, df: DataFrame, spec: dict[str, Any], id_column: str, is_a: bool) -> DataFrame:
    kind, out = spec["transform"], _target(spec)
    constant = spec.get("set_value_column_a" if is_a else "set_value_column_b")
    if constant is not None:
        return df.withColumn(out, F.lit(constant))
    if kind == "bigrams":
        return df.withColumn(out, bigrams(F.col(_source(spec, is_a)), not spec.get("no_first_pad")))
    if kind == "sql_condition":
        return df.withColumn(out, F.expr(spec["condition"]))
    if kind == "array":
        return df.withColumn(out, F.array(*spec["input_columns"]))
    if kind == "union":
        return df.withColumn(out, F.array_union(*spec["input_columns"]))
    if kind == "hash":
        tokens = F.col(_source(spec, is_a))
        kept = df.where(F.size(tokens) > 0)  # as documented, rows without tokens leave
        kept = kept.withColumn(f"{out}_count", F.size(tokens)).withColumn(out, minhash(tokens, int(spec["number"])))
        return kept.withColumn(f"{out}_bands", bands(F.col(out), int(spec["rows_per_band"]))) if spec.get("rows_per_band") else kept
    if kind == "soundex":
        return df.withColumn(out, F.soundex(F.col(_source(spec, is_a))))
    if kind == "power":
        return df.withColumn(out, F.pow(F.col(_source(spec, is_a)), F.lit(spec["exponent"])))
    if kind == "popularity":
        return popularity(df, out, spec.get("input_cols"), spec.get("range_col"), spec.get("range_val"))
    if kind == "attach_variable":
        return attach_variable_file(spark, df, spec)
    if kind == "neighbor_aggregate" and spec.get("range_column"):
        return neighbour_band(df, _source(spec, is_a), out, spec["neighborhood_column"], spec["range_column"], spec["sort_column"], spec.get("person_id", "pernum"), float(spec["range"]))
    if kind == "neighbor_aggregate":
        return neighbour_values(df, _source(spec, is_a), out, spec["neighborhood_column"], spec["sort_column"], spec.get("person_id", "pernum"), int(spec["range"]))
    if kind == "attach_family_col":
        return family_value(df, _source(spec, is_a), out, spec["person_pointer"], spec["family_id"], spec["person_id"])
    if kind == "related_individuals":
        return related_values(df, _source(spec, is_a), out, spec["family_id"], spec["relate_col"], int(spec["bottom_code"]), int(spec["top_code"]), id_column)
    if kind == "related_individual_rows":
        filters = [f for f in spec.get("filter_cols", []) if f.get("dataset", "a" if is_a else "b") == ("a" if is_a else "b")]
        return related_rows(df, spec["input_cols"], out, spec["family_id"], spec["person_id"], filters)
    raise ValueError(f"no feature selection is named {kind!r}")
