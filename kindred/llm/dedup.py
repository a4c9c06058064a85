"""Exact dedup by deterministic block naming (after Karp, Miller and Rosenberg).

Each text is cut into fixed-size blocks. Equal blocks get one integer name: blocks are hashed to partitions, sorted there,
and a name is the position of a block's first row. Then adjacent pairs of names are named in the same way, level by level,
until every text has one name. Names compare whole keys, never digests of them, so two texts have one (level, name)
exactly if they are equal.

Texts are shuffled once, for the names of their blocks. A hot block (a third of all rows may be copies of one text) is
found by a first count of block hashes, is dealt out over salts, and its salts' first rows, of which there are few, meet
under the block; hashes only choose the salts. All other steps move integers. What is dropped is a list of row numbers: it is
broadcast up to a checked size, and joined to the documents by sort and merge beyond it.

Row ids come from the rows' places in their files (common.numbered), so they hold in every scan; anything else than a scan of
Parquet files is written out first.

Defined results: a null text counts as empty; a null doc_id is kept as null and loses against any other id; of equal
texts the largest doc_id stays, and of repeated rows with that id one; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import discard, durable, numbered, scanned, without

BLOCK_CHARS = 4096


def _numbered(docs: DataFrame) -> DataFrame:
    return numbered(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")))


def _named(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """rid, pos, n, name for rows (rid, pos, n, *key): one integer for each distinct key."""
    spark = rows.sparkSession
    places = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    digest = F.xxhash64(*key)
    counts = durable(rows.groupBy(digest.alias("hash")).agg(F.count("*").alias("copies")), f"{label}-hashes")
    total = counts.agg(F.sum("copies")).first()[0] or 0
    # At most 4 * places hashes can have more than this share of all rows.
    hot = F.broadcast(counts.where(F.col("copies") > max(1000, total // (4 * places))).select("hash"))
    salted = rows.withColumn("digest", digest).join(hot, F.col("digest") == F.col("hash"), "left")
    salted = salted.withColumn("salt", F.when(F.col("hash").isNotNull(), F.pmod(F.xxhash64("rid", "pos"), F.lit(places)).cast("int")).otherwise(-1))
    here = Window.partitionBy(*key, "salt")
    sorted_rows = salted.repartition(*key, "salt").sortWithinPartitions(*key, "salt")
    named = sorted_rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("name", F.min("seq").over(here))
    # The first row of each salt of a hot key carries the key, to meet those of its other salts.
    heads = [F.when((F.col("salt") >= 0) & (F.col("seq") == F.col("name")), F.col(k)).alias(k) for k in key]
    first = durable(named.select("rid", "pos", "n", "name", (F.col("salt") >= 0).alias("hot"), (F.col("seq") == F.col("name")).alias("head"), *heads), f"{label}-first")
    discard(counts)
    by_key = Window.partitionBy(*key)
    met = first.where("hot and head").withColumn("all", F.min("name").over(by_key)).select(F.col("name").alias("own"), "all")
    # Odd names for hot keys, even ones for the others: both count positions of rows.
    cold = first.where("not hot").select("rid", "pos", "n", (F.col("name") * 2).alias("name"))
    warm = first.where("hot").join(met, F.col("name") == F.col("own")).select("rid", "pos", "n", (F.col("all") * 2 + 1).alias("name"))
    out = durable(cold.unionByName(warm), label)
    discard(first)
    return out


def _levels(docs: DataFrame, block_chars: int) -> list[DataFrame]:
    """rid, pos, n, name of each level, durable; rows with n = 1 have their text's name."""
    cut = F.regexp_extract_all("body", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))  # linear, also in very long texts
    blocks = F.when(F.length("body") == 0, F.array(F.lit(""))).otherwise(cut)
    rows = _numbered(docs).select("rid", blocks.alias("blocks")).select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    done = [_named(rows, ["block"], "dedup-0")]
    while (done[-1].agg(F.max("n")).first()[0] or 0) > 1:
        pairs = (
            done[-1]
            .where("n > 1")
            .groupBy("rid", F.expr("pos div 2").cast("int").alias("pos"), F.expr("(n + 1) div 2").cast("int").alias("n"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),  # -1 is no name
            )
        )
        done.append(_named(pairs, ["left", "right"], f"dedup-{len(done)}"))
    return done


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """rid, level, name: one row for each row of docs; equal texts, and only those, agree in level and name."""
    return _united(_levels(scanned(docs), block_chars))


def _united(levels: list[DataFrame]) -> DataFrame:
    out = None
    for k, d in enumerate(levels):
        own = d.where("n = 1").select("rid", F.lit(k).alias("level"), "name")
        out = own if out is None else out.unionByName(own)
    return out


def _decided(docs: DataFrame, block_chars: int) -> DataFrame:
    """rid, keep_rid, keep_id, group_size."""
    levels = _levels(docs, block_chars)
    ids = _united(levels)
    own = _numbered(docs).select(F.col("rid").alias("own_rid"), "doc_id")
    rows = durable(ids.join(own, F.col("rid") == F.col("own_rid")).select("rid", "doc_id", "level", "name"), "dedup-ids")
    for d in levels:
        discard(d)
    best = F.max(F.struct(F.col("doc_id"), (-F.col("rid")).alias("late")))  # nulls sort first, the first of equal rows wins
    groups = durable(rows.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "dedup-groups")
    g = groups.select(F.col("level").alias("g_level"), F.col("name").alias("g_name"), "best", "group_size")
    # Both sides come from files, so adaptive execution may split the partition of a hot group.
    out = rows.join(g, (F.col("level") == F.col("g_level")) & (F.col("name") == F.col("g_name"))).select(
        "rid", (-F.col("best.late")).alias("keep_rid"), F.col("best.doc_id").alias("keep_id"), "group_size"
    )
    out = durable(out, "dedup-decided")
    for d in (rows, groups):
        discard(d)
    return out


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs."""
    docs = scanned(docs)
    told = _decided(docs, block_chars).withColumnRenamed("rid", "d_rid")
    own = _numbered(docs).select("rid", "doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    return own.join(told, F.col("rid") == F.col("d_rid")).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )


def keep_distinct(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that stay, with its columns."""
    docs = scanned(docs)
    told = _decided(docs, block_chars)
    gone = durable(told.where("rid <> keep_rid").select("rid"), "dedup-gone")
    discard(told)
    return without(docs, gone)


__all__ = ["exact_dedup", "identities", "keep_distinct"]
