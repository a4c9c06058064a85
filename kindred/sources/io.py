"""Readers, writers and the table registry."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataError(Exception):
    """Input data breaks a rule that linking relies on."""


def datasource_path(spec: dict[str, Any]) -> tuple[str, str]:
    """(format, path) of a datasource: parquet_file wins over file; the name has to end in .csv or .parquet."""
    path = spec.get("parquet_file") or spec.get("file")
    if not path:
        raise ValueError("a datasource has a parquet_file or a file")
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in ("csv", "parquet"):
        raise ValueError(f"{path}: a datasource is a .csv or a .parquet file")
    return kind, path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; the schema is inferred only where none is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_datasource(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    kind, path = datasource_path(spec)
    df = spark.read.parquet(path) if kind == "parquet" else read_csv(spark, path, spec.get("schema"))
    return ints_to_longs(df) if spec.get("convert_ints_to_longs") else df


def ints_to_longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if t == "int" else F.col(f"`{n}`") for n, t in df.dtypes])


def blank_text_columns(df: DataFrame) -> list[str]:
    """String columns named like names or streets that hold nothing but spaces; one pass for all of them."""
    names = [n for n, t in df.dtypes if t == "string" and ("name" in n.lower() or "street" in n.lower())]
    if not names:
        return []
    row = df.agg(*[F.min(F.col(f"`{n}`").rlike("^ +$")).alias(n) for n in names]).first()
    return [n for n in names if row[n]]


def check_text_columns(df: DataFrame) -> DataFrame:
    """The frame itself, or DataError if a name or street column is all spaces."""
    if bad := blank_text_columns(df):
        raise DataError(f"only spaces in: {', '.join(bad)}")
    return df


def as_text(df: DataFrame) -> DataFrame:
    """Arrays as [a,b], vectors and maps as text, the rest as it is: what a CSV file can hold."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            inner = c if isinstance(f.dataType.elementType, T.StringType) else F.transform(c, lambda x: x.cast("string"))
            c = F.concat(F.lit("["), F.array_join(inner, ",", "null"), F.lit("]"))
        elif isinstance(f.dataType, T.UserDefinedType):
            from pyspark.ml.functions import vector_to_array

            c = F.concat(F.lit("["), F.array_join(F.transform(vector_to_array(c), lambda x: x.cast("string")), ","), F.lit("]"))
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, partitions: int | None = 1) -> None:
    """Quoted CSV with a header; one file unless told otherwise (a single file is for small results)."""
    out = as_text(df)
    out = out.coalesce(partitions) if partitions else out
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    read_csv(spark, source).na.fill("").write.mode("overwrite").parquet(target)


def fixed_width(df: DataFrame, widths: dict[str, int] | None = None, default: int = 15) -> DataFrame:
    """One text column `value`, every variable padded on the left to its width."""
    widths = widths or {}
    cells = [F.lpad(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")), widths.get(n, default), " ") for n in df.columns]
    return df.select(F.concat(*cells).alias("value"))


def substitution_table(spark: SparkSession, path: str) -> DataFrame:
    """__from, __to of a headerless `to,from` file of any size, in lower case, a byte-order mark dropped; of repeated froms the last one counts."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^\ufeff+", "")))
    rows = spark.read.schema("to string, from string").csv(path).select(clean("from").alias("__from"), clean("to").alias("__to"), F.monotonically_increasing_id().alias("__line"))
    return rows.groupBy("__from").agg(F.max_by("__to", "__line").alias("__to"))


def read_substitutions(spark: SparkSession, path: str, most: int | None = None) -> list[tuple[str, str]] | None:
    """(from, to) pairs of a headerless `to,from` file, in lower case and in order; a byte-order mark is dropped. None if there are more than `most`."""
    rows = spark.read.schema("to string, from string").csv(path)
    rows = (rows if most is None else rows.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        return None
    clean = lambda x: (x or "").lstrip("\ufeff").strip().lower()
    return [(clean(r["from"]), clean(r["to"])) for r in rows]


@dataclass
class TableInfo:
    name: str
    description: str = ""
    hidden: bool = False


#: Tables that a run can produce, in the order of its tasks.
KNOWN_TABLES = {
    t.name: t
    for t in (
        TableInfo("raw_df_a", "records of A as read"), TableInfo("raw_df_b", "records of B as read"),
        TableInfo("prepped_df_a", "records of A, cleaned"), TableInfo("prepped_df_b", "records of B, cleaned"),
        TableInfo("match_universe_df_a", "records of A that may match"), TableInfo("match_universe_df_b", "records of B that may match"),
        TableInfo("exploded_df_a", "blocking keys of A", True), TableInfo("exploded_df_b", "blocking keys of B", True),
        TableInfo("potential_matches", "candidate pairs with features"), TableInfo("scored_potential_matches", "candidate pairs with probabilities"),
        TableInfo("predicted_matches", "one-to-one matches"), TableInfo("training_data", "labelled pairs"),
        TableInfo("training_features", "labelled pairs with features"), TableInfo("training_feature_importances", "weights of the model"),
        TableInfo("training_results", "scores of the models that were explored"), TableInfo("hh_blocked_matches", "pairs of matched households' members"),
        TableInfo("hh_potential_matches", "household pairs with features"), TableInfo("scored_hh_potential_matches", "household pairs with probabilities"),
        TableInfo("predicted_hh_matches", "matches inside households"), TableInfo("hh_training_data", "labelled household pairs"),
        TableInfo("hh_training_features", "labelled household pairs with features"), TableInfo("hh_training_feature_importances", "weights of the household model"),
        TableInfo("hh_training_results", "scores of the household models that were explored"),
    )
}


#: Records for each partition of a large step, and the most partitions; Spark's own setting is the least.
ROWS_IN_PARTITION, MOST_PARTITIONS = 25_000, 10_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """How many partitions or buckets so many rows are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-rows // ROWS_IN_PARTITION)))


class StepTables:
    """Tables of a run's steps in its warehouse folder, in versions.

    A table is a folder with a version folder and a pointer to it. A version is written whole before the pointer is
    replaced by a rename, so a step that breaks off leaves the table as it was, and a table can be made from itself. Tables may be
    bucketed by a column: the catalog then knows how their rows are dealt out, and joins on the column move only the
    other side. The pointer holds what another process needs to open the table.
    """

    POINTER = "_current"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        path = self._path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def write(self, name: str, df: DataFrame, bucket_by: str | None = None, buckets: int | None = None) -> DataFrame:
        """The table as it reads from now on. buckets: by the number of rows, where it isn't given; they are counted once the rows are written."""
        version = f"v-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}/{version}"
        about = {"version": version, "schema": df.schema.json()}
        if bucket_by is None:
            df.write.parquet(path)
        else:
            if buckets is None:
                draft = f"{path}-draft"
                df.write.parquet(draft)
                df = self.spark.read.schema(df.schema).parquet(draft)
                buckets = partitions_for(self.spark, df.count())
            about |= {"bucket_by": bucket_by, "buckets": buckets}
            dealt = df.repartition(buckets, F.col(f"`{bucket_by}`"))  # one file for a bucket
            dealt.write.format("parquet").bucketBy(buckets, bucket_by).sortBy(bucket_by).option("path", path).saveAsTable(self._table(name, version))
        before = self._about(name)
        self._point(name, about)
        for old in [f"{path}-draft"] + ([f"{self.folder}/{name}/{before['version']}"] if before else []):
            self._fs.delete(self._path(old), True)
        if before:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name, before['version'])}")
        return self.read(name)

    def _table(self, name: str, version: str) -> str:
        return f"kindred_{''.join(c if c.isalnum() else '_' for c in name)}_{version.replace('-', '_')}"

    def _point(self, name: str, about: dict[str, Any]) -> None:
        new, now = (self._path(f"{self.folder}/{name}/{x}") for x in (f"_new-{uuid.uuid4().hex}", self.POINTER))
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context.rename(new, now, options)

    def _about(self, name: str) -> dict[str, Any] | None:
        path = self._path(f"{self.folder}/{name}/{self.POINTER}")
        if not self._fs.exists(path):
            return None
        text = self._fs.open(path)
        try:
            return json.loads(bytes(text.readAllBytes()))
        finally:
            text.close()

    def exists(self, name: str) -> bool:
        return self._about(name) is not None

    def read(self, name: str) -> DataFrame:
        about = self._about(name)
        if about is None:
            raise KeyError(f"no table is named {name}")
        schema, path = T.StructType.fromJson(json.loads(about["schema"])), f"{self.folder}/{name}/{about['version']}"
        if "buckets" not in about:
            return self.spark.read.schema(schema).parquet(path)
        table = self._table(name, about["version"])
        if not self.spark.catalog.tableExists(table):  # another process has written it
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            key = f"`{about['bucket_by']}`"
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)


@dataclass
class Registry:
    """Named frames of a run: tables in the warehouse folder, or lazy views without one."""

    spark: SparkSession
    warehouse: str | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def stored(self) -> StepTables | None:
        return StepTables(self.spark, self.warehouse) if self.warehouse else None

    def put(self, name: str, df: DataFrame, persist: bool = False, bucket_by: str | None = None) -> DataFrame:
        name = name.lower()
        if persist and self.stored:
            df = self.stored.write(name, df, bucket_by)
        df.createOrReplaceTempView(name)
        self.frames[name] = df
        return df

    def get(self, name: str) -> DataFrame:
        name = name.lower()
        if name in self.frames:
            return self.frames[name]
        if self.stored and self.stored.exists(name):
            return self.put(name, self.stored.read(name))
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise KeyError(f"no table is named {name}")

    def exists(self, name: str) -> bool:
        """Whether this run has the frame, or a run before it has left it in the warehouse folder, or the catalog has it."""
        name = name.lower()
        return name in self.frames or bool(self.stored and self.stored.exists(name)) or self.spark.catalog.tableExists(name)

    def drop(self, name: str) -> None:
        self.frames.pop(name.lower(), None)
        self.spark.catalog.dropTempView(name.lower())

    def names(self, hidden: bool = False) -> list[str]:
        return [n for n in self.frames if hidden or not KNOWN_TABLES.get(n, TableInfo(n)).hidden]

    def borrow(self, folder: str) -> list[str]:
        """Register every Parquet folder below `folder`; those that can't be read are left out."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(folder)
        found = []
        for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            name = s.getPath().getName()
            if not s.isDirectory() or name.startswith(("_", ".")):
                continue
            own = StepTables(self.spark, folder)
            try:
                self.put(name.removesuffix(".parquet"), own.read(name) if own.exists(name) else self.spark.read.parquet(s.getPath().toString()))
                found.append(name.removesuffix(".parquet"))
            except Exception:  # noqa: BLE001  a folder that is no table
                continue
        return found


def marked_union(left: DataFrame, right: DataFrame, mark: str) -> DataFrame:
    """Rows of both frames over their common columns, with a flag for the first frame's."""
    common = [c for c in left.columns if c in set(right.columns)]
    return left.select(*common, F.lit(True).alias(mark)).unionByName(right.select(*common, F.lit(False).alias(mark)))
