"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Documents weigh their tokens. Token sums per cell (source x language x topic) are raked to the target share of every
margin in turn until no margin is off by more than TOLERANCE; a cell's ratio is its raked over its own weight. A document
is drawn with probability min(1, c * ratio), c such that KEEP_SHARE of all tokens is expected; with `sample_weight` =
ratio / p the drawn tokens have the raked margins in expectation, also where p was cut at 1. The draw is a hash of doc_id.

Only cell sums are shuffled, after map-side combining, so a hot source costs nothing more; margins join by key, and
adaptive execution broadcasts them where their size allows.

Default targets are the observed shares to the power TEMPER (rescaled), per margin; other targets are a frame (value, share).

Defined results: nulls are a value of their own ("?") in every margin; empty texts weigh 0, so their cells may have ratio
1 and are drawn by it; repeated rows have the same hash and are drawn or left together; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import WORD, discard, durable, unit_hash, unused

log = logging.getLogger(__name__)

TEMPER = 0.7
KEEP_SHARE = 0.9
TOLERANCE = 1e-9
#: Raking ends unmet where SPAN rounds have not brought the largest miss below this part of what it was.
STALLED, SPAN = 0.9, 10
MARGINS = ("source", "lang", "topic")
#: What a document is about is told from its make-up, in order of precedence: (topic, signs counted, percent of all characters).
SIGNS = (("markup", "{}()[]<>=;#*$%&|~^", 3), ("figures", "0123456789", 5), ("capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 40))
LIST_LINES, LIST_CHARS, LONG_CHARS = 3, 60, 2000


def topic_of(text: Column) -> Column:
    """Coarse topic of a text from the characters and lines it is made of: no word lists, so it holds for any language.

    Other topics, as those of a classifier, are a column: see `topic` of mix().
    """
    n = F.length(text)
    number = lambda signs: n - F.length(F.translate(text, signs, ""))
    lines = number("\n") + 1
    out = F.when(n == 0, "empty")
    for name, signs, percent in SIGNS:
        out = out.when(number(signs) * 100 >= n * percent, name)
    return out.when((lines >= LIST_LINES) & (n < lines * LIST_CHARS), "lists").when(n < LONG_CHARS, "notes").otherwise("prose")


def _topic(text: Column, topic: str | None) -> Column:
    return topic_of(text) if topic is None else F.coalesce(F.col(topic).cast("string"), F.lit("?"))


def weighed(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens for each row of docs; topics from the column `topic`, or by topic_of()."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"),
        _topic(text, topic).alias("topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """value, share: observed token shares to the power `temper`, summing to 1."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("w"), F.lit(temper)).alias("s"))
    total = sums.agg(F.sum("s")).first()[0]
    return sums.select("value", (F.col("s") / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """cells (margins, w) with x, weights that meet all target shares, and off, by which factor the cell's margins missed them before the last round.

    Rounds go on until no margin is off by more than `tolerance`. Where the targets contradict the cells that are there, no
    weights can meet them: raking ends when it makes no more headway, and `off` says by how much which cells miss.
    """
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    # Cells carry their goals, so a round has one join a margin; cells without a goal are left out.
    aimed = cells.withColumn("x", F.col("w")).withColumn("off", F.lit(0.0))
    for m, t in targets.items():
        goal = t.select(F.col("value").alias("g_value"), (F.col("share") * F.lit(float(total))).alias(f"goal_{m}"))
        aimed = aimed.join(goal, F.col(m) == F.col("g_value")).drop("g_value")
    goals = [f"goal_{m}" for m in MARGINS]
    history: list[float] = []
    now = durable(aimed, "mix-0")
    for k in count(1):
        step = now.withColumn("off", F.lit(0.0))
        for m in MARGINS:
            sums = step.groupBy(F.col(m).alias("g_value")).agg(F.sum("x").alias("had"))
            factor = F.col(f"goal_{m}") / F.col("had")
            step = step.join(sums, F.col(m) == F.col("g_value")).select(
                *MARGINS, "w", *goals, (F.col("x") * factor).alias("x"), F.greatest("off", F.abs(factor - 1.0)).alias("off")
            )
        before, now = now, durable(step, f"mix-{k}")
        discard(before)
        history.append(now.agg(F.max("off")).first()[0] or 0.0)
        if history[-1] <= tolerance:
            break
        if k > 2 * SPAN and history[-1] > STALLED * history[-1 - SPAN]:
            log.warning("after %d rounds a margin is off by the factor %.2g: its targets contradict the cells that are there", k, history[-1])
            break
    return now.select(*MARGINS, "w", "x", "off")


def draw_rate(cells: DataFrame, keep_share: float, steps: int = 60) -> float:
    """c with sum of w * min(1, c * ratio) = keep_share * sum of w; Newton steps on a concave, piecewise linear function."""
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    c = 0.0
    for _ in range(steps):
        full = F.lit(c) * F.col("ratio") >= 1.0
        a, b = cells.agg(F.sum(F.when(full, F.col("w")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w") * F.col("ratio")))).first()
        if not b:
            break
        new = (keep_share * total - (a or 0.0)) / b
        if new <= c * (1 + 1e-12):
            break
        c = new
    return c


def fit_cells(rows: DataFrame, targets: dict[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE, temper: float = TEMPER) -> tuple[DataFrame, float]:
    """(margins, ratio of each cell that weighs something; the draw rate c) of rows as those of weighed()."""
    cells = durable(rows.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("w")), "mix-cells")
    heavy = cells.where("w > 0")
    goals = {m: (targets or {}).get(m) if (targets or {}).get(m) is not None else tempered(heavy, m, temper) for m in MARGINS}
    raked = durable(rake(heavy, goals).withColumn("ratio", F.col("x") / F.col("w")), "mix-raked")
    return raked, draw_rate(raked, keep_share)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE, temper: float = TEMPER, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, ratio, p, sample_weight, sampled, margin_error for each row of docs.

    margin_error: by which factor a margin of the row's cell misses its target; 0 but for TOLERANCE unless targets contradict each other.
    Texts are read once: their topics and token counts are written out, for the cells and for the result.
    """
    rows = durable(weighed(docs, topic), "mix-rows")
    raked, c = fit_cells(rows, targets, keep_share, temper)
    fit = raked.select(*[F.col(m).alias(f"c_{m}") for m in MARGINS], "ratio", "off")
    on = [F.col(m) == F.col(f"c_{m}") for m in MARGINS]
    ratio = F.coalesce("ratio", F.lit(1.0))
    p = F.least(F.lit(1.0), F.lit(c) * F.col("ratio"))
    joined = rows.join(fit, on, "left").select("doc_id", *MARGINS, "tokens", ratio.alias("ratio"), F.coalesce("off", F.lit(0.0)).alias("margin_error"))
    return joined.withColumn("p", p).select(
        "doc_id", *MARGINS, "tokens", "ratio", "p",
        F.when(F.col("p") > 0, F.col("ratio") / F.col("p")).alias("sample_weight"),
        (unit_hash(F.col("doc_id"), "mix") < F.col("p")).alias("sampled"), "margin_error",
    )


def keep_sampled(docs: DataFrame, topic: str | None = None, **kw) -> DataFrame:
    """The drawn rows of docs, with its columns. Cells, not documents, carry the probability, so no text is shuffled."""
    raked, c = fit_cells(weighed(docs, topic), **kw)
    names = {m: unused(docs.columns, f"__{m}") for m in MARGINS}
    fit = {m: unused(docs.columns, f"__c_{m}") for m in MARGINS}
    rate = unused(docs.columns, "__p")
    p = raked.select(*[F.col(m).alias(fit[m]) for m in MARGINS], F.least(F.lit(1.0), F.lit(c) * F.col("ratio")).alias(rate))
    own = docs
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for m in ("source", "lang"):
        own = own.withColumn(names[m], F.coalesce(F.col(m).cast("string"), F.lit("?")))
    own = own.withColumn(names["topic"], _topic(text, topic))
    met = own.join(p, [F.col(names[m]) == F.col(fit[m]) for m in MARGINS], "left")
    # Cells of empty texts only have ratio 1.
    return met.where(unit_hash(F.col("doc_id"), "mix") < F.coalesce(rate, F.lit(min(1.0, c)))).select(*[F.col(f"`{name}`") for name in docs.columns])


def mix_sql(rounds: int = 25, newton: int = 12, keep_share: float = KEEP_SHARE, temper: float = TEMPER) -> str:
    """The same in one DuckDB statement, with a fixed number of rounds."""
    count = lambda signs: f"(length(t) - length(translate(t, '{signs}', '')))"
    lines = "(length(t) - length(replace(t, chr(10), '')) + 1)"
    makeup = " ".join(f"WHEN {count(signs)} * 100 >= length(t) * {percent} THEN '{name}'" for name, signs, percent in SIGNS)
    topic = f"CASE WHEN length(t) = 0 THEN 'empty' {makeup} WHEN {lines} >= {LIST_LINES} AND length(t) < {lines} * {LIST_CHARS} THEN 'lists' WHEN length(t) < {LONG_CHARS} THEN 'notes' ELSE 'prose' END"
    word = "[^\\x20\\x09-\\x0D]+"
    parts = [
        f"""r AS MATERIALIZED (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, {topic} AS topic,
            CAST(len(regexp_extract_all(t, '{word}')) AS BIGINT) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS w FROM r GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for m in MARGINS:
        parts.append(f"g_{m} AS MATERIALIZED (SELECT {m}, s / sum(s) OVER () * (SELECT sum(w) FROM c) AS goal FROM (SELECT {m}, pow(sum(w), {temper}) AS s FROM c GROUP BY {m}))")
    parts.append("x0 AS MATERIALIZED (SELECT *, w AS x FROM c)")
    last = "x0"
    for k in range(1, rounds + 1):
        for m in MARGINS:
            name = f"x{k}_{m}"
            off = "" if k < rounds else f", greatest({'0' if m == MARGINS[0] else 'a.off'}, abs(g.goal / sum(a.x) OVER (PARTITION BY a.{m}) - 1)) AS off"
            parts.append(f"{name} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.w, a.x * g.goal / sum(a.x) OVER (PARTITION BY a.{m}) AS x{off} FROM {last} a JOIN g_{m} g ON a.{m} = g.{m})")
            last = name
    parts.append(f"f AS MATERIALIZED (SELECT source, lang, topic, w, x / w AS ratio, off FROM {last})")
    parts.append("n0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS c)")
    for k in range(1, newton + 1):
        full = f"(SELECT c FROM n{k - 1}) * ratio >= 1"
        parts.append(
            f"n{k} AS MATERIALIZED (SELECT coalesce(({keep_share} * sum(w) - sum(CASE WHEN {full} THEN w ELSE 0 END)) / nullif(sum(CASE WHEN {full} THEN 0 ELSE w * ratio END), 0), (SELECT c FROM n{k - 1})) AS c FROM f)"
        )
    return f"""WITH {", ".join(parts)},
        d AS (SELECT r.*, coalesce(ratio, 1.0) AS ratio, coalesce(off, 0.0) AS off, least(1.0, (SELECT c FROM n{newton}) * coalesce(ratio, 1.0)) AS p FROM r LEFT JOIN f USING (source, lang, topic))
        SELECT doc_id, source, lang, topic, tokens, round(ratio, 6) AS ratio, round(p, 6) AS p,
            round(CASE WHEN p > 0 THEN ratio / p END, 6) AS sample_weight,
            ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0 < p AS sampled, round(off, 6) AS margin_error FROM d"""
