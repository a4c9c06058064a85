"""Incremental linking: records of A that arrive as a stream, against a table B."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import blocking, pairs

#: Ids of B in a batch's pairs are broadcast up to so many pairs.
BROADCAST_PAIRS = 500_000


def link_stream(stream: DataFrame, b: DataFrame, config: dict[str, Any], target: str, checkpoint: str) -> StreamingQuery:
    """Candidate pairs with features of each micro-batch, appended as Parquet; a batch that is replayed replaces its own folder.

    B is read anew for each batch, so that it may grow, but isn't shuffled where the batch is small: the batch's size is known before
    keys are joined, and of B only the records in its candidate pairs, told by their ids, go on to the comparison.
    """
    specs = pairs.needed_features(config.get("comparisons"), config.get("comparison_features", []))

    def one(batch: DataFrame, epoch: int) -> None:
        id_column = config["id_column"]
        batch = batch.persist()
        batch.count()
        ids = blocking.candidate_ids(batch, b, config["blocking"], id_column).persist()
        wanted = ids.select(F.col(f"{id_column}_b").alias("__b")).distinct()
        wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_PAIRS else wanted
        some = b.join(wanted, F.col(id_column) == F.col("__b"), "left_semi")
        out = pairs.compare(batch.sparkSession, ids, batch, some, id_column, specs, config.get("comparisons"))
        out.write.mode("overwrite").parquet(f"{target}/batch={epoch}")
        for d in (ids, batch):
            d.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
