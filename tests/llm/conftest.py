import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def table(spark, tmp_path_factory):
    """table(rows, schema) as a file scan, which is what operators read; rows of documents may be (doc_id, text)."""

    def make(rows, schema=COLUMNS, partitions=3):
        full = [tuple(r) + (None,) * (len(schema.split(",")) - len(r)) for r in rows]
        path = str(tmp_path_factory.mktemp("t") / "t.parquet")
        spark.createDataFrame(full, schema).repartition(partitions).write.parquet(path)
        return spark.read.parquet(path)

    return make


def odd_rows():
    """Nulls in any column, empty and blank texts, repeated rows, ties, a very long text, one without white space."""
    long_text = " ".join(f"word{k % 977} tail{k % 13}," for k in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"),
        (None, "one two three four five six"), (None, None), (6, long_text), (7, "x" * 20_000), (8, "Ünï ☃ çödé 👍🏽 the’s don't 123  456\r\n\n  end "), (9, "the the the the the the"),
        (10, "line\nline\nother | cell | cell\n\nline"), (11, "password = hunter2hunter2"),
    ]


@pytest.fixture()
def odd(table):
    return table([r + (None, None, None) for r in odd_rows()])


@pytest.fixture()
def empty(table):
    return table([])


@pytest.fixture()
def labels(table):
    return table([(k, k % 2, int(k % 5 == 0)) for k in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
