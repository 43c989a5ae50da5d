"""Standardisation fitted on one set of rows and applied to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def fit_scaler(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of each column, one row (per group). A
    deviation of zero becomes one."""
    stats = [f"avg({c}) as _mean_{c}" for c in columns]
    stats += [f"coalesce(nullif(stddev_pop({c}), 0D), 1D) as _sd_{c}" for c in columns]
    return df.groupBy(*(by or [])).agg(*map(F.expr, stats))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str],
                 by: list[str] | None = None) -> DataFrame:
    """Columns replaced by their standardised values. An ungrouped scaler has
    exactly one row, so broadcasting it is safe at any input size. A grouped one
    is written first: the planner then knows its size and sends it to the rows
    if it is below the broadcast limit, so that no row is shuffled on a handful
    of groups; only a larger one is joined by shuffle."""
    if by:  # NULL groups are groups
        scaler = checkpointed(scaler).selectExpr(*[f"{c} as _k_{c}" for c in by], *[c for c in scaler.columns if c not in by])
        joined = df.join(scaler, F.expr(" and ".join(f"{c} <=> _k_{c}" for c in by)))
    else:
        joined = df.join(F.broadcast(scaler))
    return joined.selectExpr(*[
        f"({c} - _mean_{c}) / _sd_{c} as {c}" if c in columns else c for c in df.columns])
