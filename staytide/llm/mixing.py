"""Source mixing by iterative proportional fitting, with built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.text import filled, kept_rows, lookup
from staytide.sources.tables import checkpointed

MARGINS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of a text; the first that fits counts."""
    return (F.when(F.length(text) == 0, "empty")
            .when(text.rlike(r"(?i)\b(licen[sc]ed?|copyright|rights reserved)\b"), "legal")
            .when(F.instr(text, " | ") > 0, "tabular")
            .when(F.instr(text, "@") > 0, "contact")
            .when(F.length(text) < 1000, "note")
            .when(F.length(text) < 5000, "article").otherwise("long form"))


def _targets(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None, power: float) -> DataFrame:
    """Target share of each value of a margin, normalised over the values that
    occur: from ``wanted`` (values not named: 0), else tokens to ``power``."""
    totals = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    if wanted is None:
        raw = F.pow(F.col("t"), F.lit(power))
    else:
        raw = F.lit(0.0)
        for value, share in wanted.items():
            raw = F.when(F.col(margin) == value, F.lit(float(share))).otherwise(raw)
    totals = totals.select(F.col(margin).alias("k"), raw.alias("raw"))
    whole = totals.agg(F.sum("raw").alias("whole"))
    return totals.crossJoin(F.broadcast(whole)).select("k", F.try_divide("raw", "whole").alias("target"))


def rake(cells: DataFrame, wanted: Mapping[str, Mapping[str, float]] | None = None, power: float = 0.7,
         tolerance: float = 1e-4, max_rounds: int = 40) -> DataFrame:
    """Iterative proportional fitting of ``tokens`` over ``source``, ``lang``, ``topic``.

    Adds ``weight``, the cell's share of the mix. Each round scales the weights to
    the targets of one margin after the other and is written to the checkpoint
    folder; rounds stop when no margin is off by more than ``tolerance`` of its
    target, or after ``max_rounds`` (targets that the empty cells rule out never
    settle; the last round then stands). Values with a target of 0 get weight 0.
    """
    goals = {m: checkpointed(_targets(cells, m, (wanted or {}).get(m), power)) for m in MARGINS}
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(max_rounds):
        for margin in MARGINS:
            sums = now.groupBy(F.col(margin).alias("k")).agg(F.sum("weight").alias("s"))
            factor = (sums.join(goals[margin].withColumnRenamed("k", "g"), F.col("k").eqNullSafe(F.col("g")))
                      .select("k", F.coalesce(F.try_divide("target", "s"), F.lit(0.0)).alias("factor")))
            now = (now.join(factor, F.col(margin).eqNullSafe(F.col("k")))
                   .select(*MARGINS, "tokens", (F.col("weight") * F.col("factor")).alias("weight")))
        now = checkpointed(now)
        off = [now.groupBy(F.col(m).alias("k")).agg(F.sum("weight").alias("s"))
               .join(goals[m].withColumnRenamed("k", "g"), F.col("k").eqNullSafe(F.col("g")))
               .select(F.coalesce(F.try_divide(F.abs(F.col("s") - F.col("target")), F.col("target")), F.col("s")).alias("off"))
               for m in MARGINS]
        worst = off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return now


def inclusion(cells: DataFrame, rate: float, max_rounds: int = 50) -> DataFrame:
    """Adds ``probability`` so that the expected tokens are ``rate`` of all tokens
    and follow the weights as far as no probability exceeds 1. Cells that reach 1
    are fixed and the rest is scaled up again until nothing changes."""
    ratio = F.try_divide("weight", "tokens")
    cells = cells.withColumn("ratio", F.coalesce(ratio, F.lit(0.0)))
    scale = 0.0
    for _ in range(max_rounds):
        full = F.col("ratio") * F.lit(scale) >= 1
        total, fixed, open_ = cells.agg(F.sum("tokens"), F.sum(F.when(full, F.col("tokens")).otherwise(0)),
                                        F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not total or not open_:
            break
        later = (rate * float(total) - float(fixed)) / float(open_)
        if later <= scale * (1 + 1e-12):
            break
        scale = later
    return cells.withColumn("probability", F.least(F.col("ratio") * F.lit(scale), F.lit(1.0))).drop("ratio")


def mix(docs: DataFrame, wanted: Mapping[str, Mapping[str, float]] | None = None, power: float = 0.7, rate: float = 0.5,
        seed: int = 17, topic: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``): its cell, tokens, raked weight, inclusion
    probability and whether it is ``sampled``.

    Tokens are estimated as a quarter of the text's bytes, rounded up. Documents
    are drawn independently, by a hash of id and text, with the probability of
    their cell (source, language, topic), so that a repeated task draws alike.
    Null languages and sources are values of their own; repeated rows are drawn
    together; empty texts have no tokens and are never drawn. An empty table
    gives no rows.
    """
    text = filled(F.col("text"))
    rows = checkpointed(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (topic if topic is not None else topic_of(text)).alias("topic"),
        F.ceil(F.octet_length(text) / 4).cast("bigint").alias("n_tokens"),
        (F.pmod(F.xxhash64("doc_id", text, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("draw")))
    cells = checkpointed(rows.filter("n_tokens > 0").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    cells = checkpointed(inclusion(rake(cells, wanted, power), rate))
    table = cells.select(*[F.col(m).alias(f"c_{m}") for m in MARGINS], "weight", "probability")
    same = [F.col(m).eqNullSafe(F.col(f"c_{m}")) for m in MARGINS]
    return (rows.join(lookup(table), same[0] & same[1] & same[2], "left")
            .select("doc_id", *MARGINS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("cell_weight"),
                    F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0).alias("probability"), "draw")
            .withColumn("sampled", F.col("draw") < F.col("probability")))


def sample(docs: DataFrame, seed: int = 17, **settings: object) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` draws, with all their columns."""
    drawn = mix(docs, seed=seed, **settings)
    cells = checkpointed(drawn.filter("probability > 0").groupBy(*[F.col(m).alias(f"c_{m}") for m in MARGINS])
                         .agg(F.max("probability").alias("probability")))
    text = filled(F.col("doc.text"))
    rows = kept_rows(docs).withColumns({
        "topic": topic_of(text),
        "draw": F.pmod(F.xxhash64("doc.doc_id", text, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)})
    same = (F.col("doc.source").cast("string").eqNullSafe(F.col("c_source"))
            & F.col("doc.lang").cast("string").eqNullSafe(F.col("c_lang")) & (F.col("topic") == F.col("c_topic")))
    return rows.join(lookup(cells), same).filter((F.col("draw") < F.col("probability")) & (F.length(text) > 0)).select("doc.*")
