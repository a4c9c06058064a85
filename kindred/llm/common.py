"""Shared pieces: durable intermediates, id hashing, bounded label samples, Arrow row mapping."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
#: Frames of a few numbers a row are broadcast up to this many rows, some megabytes.
BROADCAST_ROWS = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own only where that is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="kindred-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet in the shared checkpoint folder and read back: lineage ends, lost executors cost nothing."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _file_system(df.sparkSession, path).deleteOnExit(_hadoop_path(df.sparkSession, path))  # unless discard() comes first
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*frames: DataFrame | None) -> None:
    """Delete durable() tables that nothing reads any more; those that results still read go when the driver ends."""
    for df in frames:
        path = getattr(df, "_kindred_path", None)
        if path:
            _file_system(df.sparkSession, path).delete(_hadoop_path(df.sparkSession, path), True)


#: Steps of a plan that give a row of the file scan below one row at most.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "View", "Relation"}


def scanned(docs: DataFrame) -> DataFrame:
    """docs, if its plan is a scan of Parquet files (with projections and filters); else a written copy of it.

    Operators join what they find out about a row back to it by its number, see numbered(). Only a row of a file has one that
    holds however often the row is read.
    """
    plan = docs._jdf.queryExecution().analyzed()
    names, todo = set(), [plan]
    while todo:
        node = todo.pop()
        names.add(node.getClass().getSimpleName())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    if names <= _ROW_BY_ROW:
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
        except AnalysisException:  # files of another format have no row numbers
            pass
        else:
            return docs
    return durable(docs, "scanned")


def unused(columns: list[str], stem: str) -> str:
    """stem, or the first of stem_, stem__, ... that is none of the columns."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: Bits of a row number that count rows within a file; 2^23 files of 2^40 rows fit into a long.
ROW_BITS = 40


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """`docs`, as scanned() returns it, with a column `name`: the place of a row's file among the files by path, and of the row in its file.

    So a row has one number in every scan, whatever tasks, executors and cores read it.
    """
    meta = docs.metadataColumn("_metadata")
    path, row = unused([*docs.columns, name], "__path"), unused([*docs.columns, name], "__row")
    found = getattr(docs, "_kindred_files", None)
    if found is None:  # as many names as the driver has listed to plan the scan
        found = docs._kindred_files = sorted(r[0] for r in docs.select(meta["file_path"].alias("p")).distinct().collect())
    if len(found) < 2:
        return docs.withColumn(name, meta["row_index"])
    files = docs.sparkSession.createDataFrame([(p, k << ROW_BITS) for k, p in enumerate(found)], f"{path}_of string, {name} long")
    own = docs.withColumns({path: meta["file_path"], row: meta["row_index"]})
    side = F.broadcast(files) if len(found) <= BROADCAST_ROWS else files
    return own.join(side, F.col(path) == F.col(f"{path}_of")).select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(name) + F.col(row)).alias(name))


def few(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`ids`, a durable frame, marked for broadcast if it has at most `rows` rows; else for a sort-merge join, which holds at any size."""
    return F.broadcast(ids) if ids.count() <= rows else ids.hint("merge")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, as scanned() returns it, without the rows whose numbers are in the one column of `gone`, a durable frame."""
    name = unused(docs.columns, "__rid")
    (own,) = gone.columns
    left = gone.select(F.col(own).alias(unused([*docs.columns, name], "__gone")))
    return numbered(docs, name).join(few(left), F.col(name) == F.col(left.columns[0]), "left_anti").drop(name)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """The shuffle files of each action inside are deleted when it ends: durable tables stand for them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most in the actions inside: wide rows then take little memory on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def pinned_scans(spark: SparkSession):
    """Actions inside cut files into the same pieces each time they scan them.

    Spark sizes the pieces by the cores that are registered when a scan is planned, which change as executors come and go; here
    by those that are registered now.
    """
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def released(spark: SparkSession) -> None:
    """What no frame refers to any more leaves the driver and the executors, and the room it took goes back to the system.

    Executors keep broadcast relations until the driver collects its garbage, and their heaps stay as large as the largest
    step has made them. A task for each core collects them, which takes some tenths of a second; no result depends on it.
    """
    spark._jvm.java.lang.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def trimmed() -> None:
    """What this process has freed goes back to the system, where its allocators would keep it for later."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def py_crc_mod(doc_id, k: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % k


def unit_hash(col: Column, salt: str) -> Column:
    """A reproducible number in [0, 1) from the first eight hex digits of md5 (the same in any SQL engine)."""
    text = F.concat(F.lit(salt + ":"), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, flag: str, per_class: dict[int, int], keep: Column, salt: str, longest: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most per_class[c] labelled ids of each class c, chosen by hash, in id order.

    Whole texts; ids whose text has more than `longest` characters, or none, are left out. Of repeated ids one text is
    taken (the least), and an id with both labels counts as 1. Null ids and labels teach nothing. What reaches the driver
    is bounded by the parameters, as Arrow tables.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(flag).isin(*per_class) & keep).select("doc_id", F.col(flag).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # Some more than is needed pass the hash; the least hashes are taken, so that the bound holds.
    rate = {c: min(1.0, 1.2 * per_class[c] / k + 50.0 / k) for c, k in n.items()}
    draw = unit_hash(F.col("doc_id"), salt)
    some = rows.where(draw < max(rate.values(), default=0.0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    wanted = F.lit(False)
    for c, x in rate.items():
        wanted = wanted | ((F.col("label") == c) & (draw < x))
    found = some.where(wanted).select("doc_id", "label", draw.alias("draw")).toArrow().to_pydict()
    order = sorted(zip(found["draw"], found["doc_id"], found["label"]))
    chosen = [(i, y) for c, k in per_class.items() for _, i, y in [x for x in order if x[2] == c][:k]]
    picked = spark.createDataFrame(chosen, f"__id {docs.schema['doc_id'].dataType.simpleString()}, __label int")  # at most the sum of per_class rows
    text = F.col("text").cast("string")
    texts = (
        docs.where(F.length(text) <= longest)
        .select("doc_id", text.alias("text"))
        .join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
        .groupBy("doc_id", "__label")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .to_pydict()
    )
    return sorted(zip(texts["doc_id"], texts["text"], texts["__label"]))


def most_frequent(counts: DataFrame, column: str, k: int) -> Column:
    """The condition that picks the rows with the largest counts, never more than k of them.

    Counts are compared by steps of a sixteenth of a doubling, so the driver sees some hundred sums whatever the corpus.
    """
    step = F.floor(F.log2(F.col(column).cast("double")) * 16).cast("int")
    sums = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect() if r["s"] is not None}
    least, total = None, 0
    for s in sorted(sums, reverse=True):
        total += sums[s]
        if total > k:
            break
        least = s
    return F.lit(False) if least is None else F.coalesce(step >= least, F.lit(False))


def map_batches(df: DataFrame, schema: str, fn: Callable[[Iterator[dict]], Iterator[list]], rows: int = 2048) -> DataFrame:
    """mapInArrow over dicts of Python lists; fn yields lists of rows in the order of `schema`."""
    out = T._parse_datatype_string(schema)
    names = [f.name for f in out]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def parts():
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    yield b.slice(at, rows).to_pydict()

        for chunk in fn(parts()):
            for at in range(0, len(chunk), 50_000):
                cols = list(zip(*chunk[at : at + 50_000], strict=True))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(n).type) for n, c in zip(names, cols, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)
