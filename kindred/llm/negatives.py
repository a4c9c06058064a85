"""Hard negatives by norm-bucketed search.

Candidates are sorted into buckets by norm, largest first, and buckets are cut into cells of a bounded number of rows. The
inner product of an anchor with a candidate is at most the product of their norms (Cauchy-Schwarz), so a bucket whose largest
norm, times the anchor's, lies below what the anchor still needs holds nothing for it. What it needs is the running kth
score, once k are found, and for hard negatives at least the lower limit of the window that the positive sets.

Buckets are taken in waves, each with about as many rows as all before, so the kth scores of earlier waves prune later
ones: blocks of anchors that need nothing of a bucket aren't sent to it at all. Within a task the same bounds skip single anchors, cell by cell.
Anchors come in blocks, so a task holds one block and one cell and multiplies them as matrices; it returns the
best k of its cell for each query, and Spark keeps the best k of all tasks (rank limits run before the shuffle).

Products are exact: doubles hold integers up to 2^53, which the product of the norms bounds; beyond that, tasks count in
Python's integers, and a score that no long can hold raises an error.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that share an
id count once, with the smallest label and then vector. Vectors of different lengths are compared as if filled up with
zeros. Anchors without positives, and positives without negatives in their window, give no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import discard, durable, shuffles_removed

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's has to lie.
LOW, HIGH = 30, 90
#: Rows of a cell and of a block of anchors at most; smaller where that is needed to occupy all partitions.
CELL, ANCHORS, LEAST_CELL = 65_536, 16_384, 256
#: Buckets for a doubling of the squared norm.
STEPS = 8
#: Products that a task holds at once.
AT_ONCE = 2_000_000
EXACT = float(2**53)


def quantised(vectors: DataFrame, id_column: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """id, label, v (integers as doubles), norm2 and bucket (0 for the largest norms) of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    fit = F.col(id_column).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(fit).select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("v"))
    once = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c * c)
    return once.withColumn("norm2", norm2).withColumn("bucket", -F.floor(F.log2(F.greatest("norm2", F.lit(0.5))) * STEPS).cast("int"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, x in enumerate(column):
        out[k, : len(x)] = x
    return out


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact, as longs."""
    if len(a) and len(c) and np.sqrt((a * a).sum(1).max() * (c * c).sum(1).max()) * 1.01 >= EXACT:
        whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in c], object).T
        if max(abs(int(whole.max())), abs(int(whole.min()))) >= 2**63:
            raise OverflowError("a score is no long")
        return whole.astype(np.int64)
    return (a @ c.T).astype(np.int64)


def best_of_cell(queries: dict, cell: dict, k: int, same_label: bool) -> Iterator[tuple]:
    """(query, id, score) of the best k of the cell for each query: scores within [low, high], of the wanted label, not the anchor itself."""
    if not len(queries["id"]) or not len(cell["id"]):
        return
    order = np.lexsort((cell["id"], -cell["norm2"]))
    ids, labels, norm = cell["id"][order], cell["label"][order], np.sqrt(cell["norm2"][order])
    width = max(max(map(len, queries["v"])), max(map(len, cell["v"])), 1)
    c = _matrix([cell["v"][o] for o in order], width)
    # Queries of one anchor stand together and share its products.
    anchors, first, anchor_of = np.unique(queries["id"], return_index=True, return_inverse=True)
    a = _matrix([queries["v"][f] for f in first], width)
    a_norm, a_label = np.sqrt(queries["norm2"][first]), queries["label"][first]
    # What each query needs at least: its lower limit, or its kth score so far.
    need, high = np.maximum(queries["low"], queries["kth"]), queries["high"]
    best: dict[int, list] = {}
    rows = max(1, AT_ONCE // max(len(a), 1))
    for at in range(0, len(ids), rows):
        upto = min(len(ids), at + rows)
        bound = a_norm * norm[at] * (1 + 1e-9)  # the largest norm of the slice comes first
        live = np.flatnonzero(need <= bound[anchor_of])
        if not len(live):
            break  # norms only become smaller
        used, slot = np.unique(anchor_of[live], return_inverse=True)
        scores = products(a[used], c[at:upto])
        fit = (labels[None, at:upto] == a_label[used][:, None]) == same_label
        fit &= ids[None, at:upto] != anchors[used][:, None]
        for q, s in zip(live.tolist(), slot.tolist()):
            row = scores[s]
            hit = np.flatnonzero(fit[s] & (row >= need[q]) & (row <= high[q]))
            if not len(hit):
                continue
            if len(hit) > 4 * k:  # only what can be among the best k, ties included
                hit = hit[row[hit] >= np.partition(row[hit], len(hit) - k)[len(hit) - k]]
            both = best.get(q, []) + [(-int(row[h]), int(ids[at + h])) for h in hit]
            both.sort()
            best[q] = both[:k]
            if len(both) >= k:
                need[q] = max(need[q], -both[k - 1][0])
    for q, found in best.items():
        for score, i in found:
            yield int(queries["query"][q]), i, -score


_OUT = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _search_task(k: int, same_label: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def plain(t: pa.Table, names) -> dict:
            return {n: t[n].to_numpy() if n != "v" else [np.asarray(x, np.float64) for x in t[n].to_numpy()] for n in names}

        queries = plain(left, ("query", "id", "label", "v", "norm2", "low", "high", "kth"))
        rows = list(best_of_cell(queries, plain(right, ("id", "label", "v", "norm2")), k, same_label))
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_OUT)

    return run


def _waves(sizes: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(first, last) bucket of each wave: each has about as many rows as all before it, and `least` rows."""
    out, first, here, before = [], None, 0, 0
    for bucket, n in sizes:
        first = bucket if first is None else first
        here += n
        if here >= max(before, least):
            out.append((first, bucket))
            first, before, here = None, before + here, 0
    return [*out, (first, sizes[-1][0])] if first is not None else out


def search(queries: DataFrame, candidates: DataFrame, k: int, same_label: bool) -> DataFrame:
    """query, id, score, rank of the best k candidates of each query; durable.

    queries: query, id (the anchor, which is no result), label, v, norm2, low, high; candidates as of quantised(), durable.
    """
    spark = candidates.sparkSession
    sizes = sorted((r["bucket"], r["n"]) for r in candidates.groupBy("bucket").agg(F.count("*").alias("n")).collect())  # STEPS rows for a doubling
    total = sum(n for _, n in sizes)
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = max(LEAST_CELL, min(CELL, -(-total // (2 * places))))
    blocks = max(1, -(-queries.count() // ANCHORS))
    # Queries of one anchor meet in one block.
    asked = durable(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "negatives-asked")
    found = None
    for first, last in _waves(sizes, cell):
        known = asked.withColumn("kth", F.lit(-(2**63)).cast("long"))
        if found is not None:
            kth = found.where(F.col("rank") == k).select(F.col("query").alias("k_query"), F.col("score").alias("k_score"))
            known = asked.join(kth, F.col("query") == F.col("k_query"), "left").withColumn("kth", F.coalesce("k_score", F.lit(-(2**63)).cast("long"))).drop("k_query", "k_score")
        here = [(b, max(1, -(-n // cell))) for b, n in sizes if first <= b <= last]
        upper = {b: 2.0 ** (-b / STEPS + 1 / STEPS) for b, _ in here}  # no squared norm in the bucket is over this
        buckets = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("cells"), F.lit(float(upper[b]) ** 0.5).alias("norm")) for b, s in here]))
        needs = F.greatest("low", "kth").cast("double")
        sent = known.withColumn("b", buckets).where(needs <= F.sqrt("norm2") * F.col("b.norm") * (1 + 1e-9))
        sent = sent.select("query", "id", "label", "v", "norm2", "low", "high", "kth", "block", "b.bucket", F.explode(F.sequence(F.lit(0), F.col("b.cells") - 1)).alias("cell"))
        # Only the blocks that still need something of a bucket get its rows.
        wanted = durable(sent.groupBy("bucket").agg(F.collect_set("block").alias("blocks")), "negatives-wanted")
        count_of = F.element_at(F.create_map(*[x for b, s in here for x in (F.lit(b), F.lit(s))]), F.col("bucket"))
        rows = candidates.where(F.col("bucket").between(first, last)).join(wanted.withColumnRenamed("bucket", "w_bucket"), F.col("bucket") == F.col("w_bucket"))
        rows = rows.select("id", "label", "v", "norm2", "bucket", F.pmod(F.xxhash64("id"), count_of).cast("int").alias("cell"), F.explode("blocks").alias("block"))
        keys = ("block", "bucket", "cell")
        got = sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_search_task(k, same_label), "query long, id long, score long")
        both = got if found is None else found.select("query", "id", "score").unionByName(got)
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        before, found = found, durable(ranked, "negatives-found")
        discard(before, wanted)
    discard(asked)
    return found if found is not None else spark.createDataFrame([], "query long, id long, score long, rank int")


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column | None = None, id_column: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: the condition on rows of `vectors` that makes one an anchor. Its positives are the best other rows of its label;
    its negatives, for each positive, the best rows of other labels between low and high percent of the positive's score.
    """
    label = F.col("label") if label is None else label
    with shuffles_removed(vectors.sparkSession):
        rows = durable(quantised(vectors, id_column, vector, label, scale), "negatives-rows")
        chosen = vectors.where(anchors).select(F.col(id_column).cast("long").alias("a_id")).distinct()
        heads = durable(rows.join(chosen, F.col("id") == F.col("a_id"), "left_semi"), "negatives-anchors")
        least, most = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
        near = search(heads.select(F.col("id").alias("query"), "id", "label", "v", "norm2", least.alias("low"), most.alias("high")), rows, positives, True)
        pairs = near.select(F.col("query").alias("p_anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        # low * p <= 100 * n <= high * p, in integers: n from the ceiling of low * p / 100 to the floor of high * p / 100.
        from_, upto = F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100)) div 100)"), F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")
        windows = pairs.withColumn("low", from_).withColumn("high", upto).where("low <= high")
        windows = durable(windows.withColumn("query", F.xxhash64("p_anchor", "positive_id")), "negatives-windows")
        asked = windows.join(heads, F.col("p_anchor") == F.col("id")).select("query", "id", "label", "v", "norm2", "low", "high")
        found = search(asked, rows, negatives, False).select(F.col("query").alias("f_query"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        discard(rows, heads, near)
    return windows.join(found, F.col("query") == F.col("f_query")).select(F.col("p_anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives_sql(positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> str:
    """hard_negatives() of embeddings as its query calls it, in DuckDB's SQL."""
    return f"""WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {positives}),
        n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {low} * positive_score <= 100 * s.score AND 100 * s.score <= {high} * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""


__all__ = ["hard_negatives", "hard_negatives_sql", "search"]
