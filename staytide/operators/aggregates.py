"""Pivots, flag roll-ups and one-pass summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import literal

_STATS = {"min": "min", "max": "max", "mean": "avg"}


def pivot_agg(df: DataFrame, keys: list[str], label: str, value: str, labels: Iterable[str],
              stats: list[str], prefix: str = "") -> DataFrame:
    """One ``<label>_<stat>`` column per label and statistic.

    Input rows are first reduced per (keys, label), map-side combined and with
    one buffer per statistic; the wide step then sees one row per key and
    label. The explicit label list saves a job that discovers labels. Keys
    that have only unlabelled rows stay, with NULLs.
    """
    rows = df.selectExpr(*keys, f"{label} as _label", f"{value} as _value")
    tall = rows.groupBy(*keys, "_label").agg(*[F.expr(f"{_STATS[s]}(_value) as _{s}") for s in stats])
    return tall.groupBy(*keys).agg(*[
        F.expr(f"max(if(_label = {literal(name)}, _{s}, null)) as {prefix}{name}_{s}")
        for name in labels for s in stats])


def rollup_flags(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(f"max({f}) as {f}") for f in flags])


def stage_summary(df: DataFrame, stage: str, key: str = "icustay_id") -> DataFrame:
    """Rows per stage 0..3, rows without a stage, distinct keys, in one pass."""
    counts = [F.expr(f"count_if({stage} = {s} and {key} is not null) as stage_{s}") for s in range(4)]
    return df.agg(F.countDistinct(key).alias("episodes"), *counts,
                  F.expr(f"count_if({stage} is null) as missing"))


def count_distinct(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(key).alias("n_distinct"))


def class_counts(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
