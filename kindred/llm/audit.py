"""How filters of documents interact: what each removes in every order of application, and what it alone would have caught.

Duplicates come from partition refinement. Rows are split by the length of their text, then by the hash of its first block,
of its next block, and so on, with blocks that grow fourfold; a class of one row leaves at once, so most rows move only a
few integers once or twice. The full texts of what survives are compared: each with the smallest id of its class, and those
that differ (their hashes collided) among themselves again, until none is left. Classes are never gathered: a class is a
key of counts and of a join whose other side has one row for it, so a group with a third of all rows is spread by
adaptive execution.

Each row then has a mask of the filters that it fails. Masks are counted within a part, and all orders are read from these
counts, at most 2^k for a part and k filters; no order scans documents again.

Defined results: a null text counts as empty; a null source, or any null part, as the empty string. A row is a duplicate if
its text is that of a row with a smaller doc_id, so repeated rows with one id are none of each other, and a row without id
neither is one nor makes one. Labels of repeated ids count if any row has them; null labels count as 0. An empty table gives
no rows. Other columns are never read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, durable, few, numbered, scanned, shuffles_removed

#: Code points of the first block; each further block has four times as many.
FIRST_BLOCK = 64
DUPLICATE = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails filters A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def _chain(text: Column, n: Column) -> Column:
    """A hash for each block: of the text's length and of all blocks up to it. Block i has FIRST_BLOCK * 4^i code points."""
    size = lambda i: F.pow(F.lit(4.0), i).cast("int") * FIRST_BLOCK
    start = lambda i: F.floor((size(i) - FIRST_BLOCK) / 3).cast("int") + 1
    blocks = F.greatest(F.lit(1), F.ceil(F.log(4.0, n.cast("double") * 3 / FIRST_BLOCK + 1)).cast("int"))
    hashes = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.xxhash64(F.substring(text, start(i), size(i))))
    return F.transform(F.sequence(F.lit(1), F.size(hashes)), lambda i: F.xxhash64(n, F.slice(hashes, F.lit(1), i)))


def _refined(rows: DataFrame) -> DataFrame:
    """rid, doc_id, class of the rows (rid, doc_id, n, chain) that share length and all block hashes with another one; durable."""
    deepest = rows.agg(F.max(F.size("chain"))).first()[0] or 0
    now = rows
    for k in range(deepest + 1):
        key = F.col("n").cast("long") if k == 0 else F.element_at("chain", F.least(F.lit(k), F.size("chain")))
        shared = durable(now.groupBy(key.alias("class_of")).agg(F.count("*").alias("rows")).where("rows > 1").select("class_of"), f"audit-classes-{k}")
        before, now = now, durable(now.join(shared, key == F.col("class_of"), "left_semi"), f"audit-alive-{k}")
        discard(shared, before if before is not rows else None)
    out = durable(now.select("rid", "doc_id", F.element_at("chain", -1).alias("class")), "audit-survivors")
    discard(now if now is not rows else None)
    return out


def _duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """dup: numbers of the rows whose text is that of a row with a smaller doc_id; durable."""
    alive = _refined(rows)
    own = alive.select(F.col("rid").alias("s_rid"), "class")
    body = numbered(docs.select("doc_id", "text")).select("rid", "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    todo = durable(body.join(few(own), F.col("rid") == F.col("s_rid")).drop("s_rid"), "audit-texts")
    found = []
    while not todo.isEmpty():
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("r")))
        leads = todo.groupBy(F.col("class").alias("l_class")).agg(first.alias("least")).select("l_class", F.col("least.id").alias("l_id"), F.col("least.r").alias("l_rid"))
        leads = durable(leads.join(todo, F.col("rid") == F.col("l_rid")).select("l_class", "l_id", F.col("body").alias("l_body")), "audit-leads")
        # Both sides come from files, so adaptive execution may split the rows of a hot class.
        held = durable(todo.join(leads, F.col("class") == F.col("l_class")).select("rid", "doc_id", "class", "l_id", (F.col("body") == F.col("l_body")).alias("same")), "audit-held")
        found.append(durable(held.where("same and doc_id > l_id").select(F.col("rid").alias("dup")), "audit-marks"))
        rest = held.where("not same").select(F.col("rid").alias("r_rid"))  # another text with the same hashes
        before, todo = todo, durable(todo.join(rest, F.col("rid") == F.col("r_rid"), "left_semi"), "audit-texts")
        discard(before, leads, held)
    discard(todo, alive)
    out = found[0] if found else rows.where("false").select(F.col("rid").alias("dup"))
    for d in found[1:]:
        out = out.unionByName(d)
    return out


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", filters=text_filters) -> tuple[DataFrame, list[str]]:
    """(part, mask, n, good, toxic: rows of the part that fail just the filters in the mask; the filters' names by bit)."""
    docs = scanned(docs)
    fails = filters(F.col("body"))
    names = [*fails, DUPLICATE]
    bits = F.lit(0)
    for k, c in enumerate(fails.values()):
        bits = bits + F.when(c, 1 << k).otherwise(0)
    with shuffles_removed(docs.sparkSession):
        seen = numbered(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")))
        facts = durable(seen.select("rid", "doc_id", "part", bits.alias("bits"), F.length("body").alias("n"), _chain(F.col("body"), F.length("body")).alias("chain")), "audit-facts")
        dup = _duplicates(docs, facts.select("rid", "doc_id", "n", "chain"))
        told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("t_id"))
        told = durable(told.agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")), "audit-labels")
        full = facts.select("rid", "doc_id", "part", "bits").join(few(dup), F.col("rid") == F.col("dup"), "left").join(told, F.col("doc_id") == F.col("t_id"), "left")
        mask = F.col("bits") + F.when(F.col("dup").isNotNull(), 1 << len(fails)).otherwise(0)
        counts = full.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        out = durable(counts, "audit-masks")
        discard(facts, told)
    return out, names


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", filters=text_filters) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order of all filters and step: `filters` gives the conditions on a text, by name, under which it
    fails; DUPLICATE is added to them. shapley is the sum, over all orders, of what the step's filter removes.
    """
    counts, names = masks(docs, labels, part, filters)
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(names[j] for j in order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(1 << k).alias("bit")))
            before |= 1 << k
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^k at most
    rows = cells.select("part", "cells", F.explode(F.array(*steps)).alias("s")).select("part", "cells", "s.*")
    fails, left, earlier = (lambda m: m.bitwiseAND(F.col("bit")) > 0), (lambda m: m.bitwiseAND(F.col("before")) == 0), (lambda m: m.bitwiseAND(F.col("before")) > 0)

    def total(name: str, which) -> Column:
        return F.aggregate(F.filter("cells", lambda c: which(c["mask"])), F.lit(0).cast("long"), lambda acc, c: acc + c[name])

    # In a share of 1 / m of all orders a filter comes first among the m that a row fails.
    orders = factorial(len(names))
    shapley = F.aggregate(F.filter("cells", lambda c: fails(c["mask"])), F.lit(0).cast("long"), lambda acc, c: acc + (c["n"] * orders / F.bit_count(c["mask"])).cast("long"))
    gone = lambda m: fails(m) & left(m)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & left(m)).alias("kept"), total("n", gone).alias("removed"), total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"), total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit_sql() -> str:
    """audit() of documents and labels with the standard filters, in DuckDB's SQL."""
    return """WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        m AS (SELECT w.doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
            + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        f AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
        o AS (SELECT [a.k, b.k, d.k, e.k, g.k] AS ks FROM f a, f b, f d, f e, f g WHERE len(list_distinct([a.k, b.k, d.k, e.k, g.k])) = 5),
        s AS (SELECT array_to_string(list_transform(ks, lambda k: substr('ABCDE', k + 1, 1)), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, ks FROM o),
        r AS (SELECT filter_order, step, 1 << ks[step] AS bit, coalesce(list_sum(list_transform(ks[1:step - 1], lambda k: 1 << k)), 0)::INT AS before FROM s),
        x AS (SELECT part, filter_order, step,
            sum(n) FILTER ((mask & (before | bit)) = 0) AS kept, sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS removed, sum(n) FILTER ((mask & before) > 0 AND (mask & bit) > 0) AS redundant,
            sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS good_lost, sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS toxic_lost FROM c, r GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
            CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
            CAST(coalesce(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)), 0) AS BIGINT) AS shapley FROM x"""


__all__ = ["audit", "audit_sql", "masks", "text_filters"]
