"""Helpers of several test modules."""

from contextlib import contextmanager

from pyspark.sql import functions as F

NAME = "spark.sql.leafNodeDefaultParallelism"


@contextmanager
def recored(spark, first):
    """Scans see another number of cores before and after each durable table, as when executors come and go."""
    from kindred.llm import common

    old = common.scratch_dir
    state = {"n": first}
    sizes = {"spark.sql.files.openCostInBytes": "1024", NAME: str(first)}

    def turned(s):
        state["n"] = first + 3 if state["n"] == first else max(1, first // 3)
        spark.conf.set(NAME, str(state["n"]))
        return old(s)

    before = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    common.scratch_dir = turned
    try:
        yield
    finally:
        common.scratch_dir = old
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def clashing(docs):
    """docs with further columns whose names operators use themselves."""
    names = ("rid", "__rid", "__gone", "__source", "__lang", "__topic", "found", "kept", "class", "n", "name")
    return docs.withColumns({c: F.lit("mine") for c in names if c not in docs.columns})
