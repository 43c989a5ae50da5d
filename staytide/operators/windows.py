"""Trailing aggregates and row selection per key."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_micros, micros, slot_start


@dataclass(frozen=True)
class Trailing:
    """``fn`` (min, max or sum) of ``value`` over the last ``span`` of the same key.

    The window starts at ``t - span`` (included). ``closed="both"`` includes
    ``t`` itself, ``closed="left"`` stops just before it.
    """

    fn: str
    value: str
    span: timedelta
    closed: str = "both"


def trailing_agg(df: DataFrame, keys: list[str], ts: str, outputs: Mapping[str, Trailing],
                 slot: timedelta | None = None, distinct: bool = False) -> DataFrame:
    """Add one trailing aggregate per output column; rows are kept as they are, or with ``distinct`` one of each.

    Every key is cut into time slots, by default four times as wide as the
    widest span, and a (key, slot) is a window partition of its own: its rows
    and, without their other columns, those of earlier slots that its windows
    reach back to. One shuffle and one sort serve all outputs, as RANGE frames
    over microseconds; a frame meets the same rows in the same order whatever
    the slots, so sums agree to the last digit. No self join, hence no fan-out,
    and a task's work follows the slot, not the key. Undated rows have no window.
    """
    if any(o.span <= timedelta(0) for o in outputs.values()):
        raise ValueError("every span must be positive")
    widest = max(as_micros(o.span) for o in outputs.values())
    width = as_micros(slot) if slot else 4 * widest
    alias = {v: f"_v{i}" for i, v in enumerate(sorted({o.value for o in outputs.values()}))}
    rest = [c for c in df.columns if c not in keys]
    # Undated rows of one key are spread; nothing is looked up for them.
    undated = "array(-1L - pmod(xxhash64(_row), 64L))"
    placed = df.selectExpr(*keys, f"{micros(ts)} as _t", f"struct({', '.join(rest)}) as _row", *[f"{v} as {a}" for v, a in alias.items()])
    placed = placed.selectExpr("*", f"{slot_start('_t', width)} as _home").selectExpr(
        *keys, "_t", "_home", "_row", *alias.values(),
        f"explode(if(_t is null, {undated}, sequence(_home, {slot_start(f'(_t + {widest})', width)}, {width}L))) as _slot")
    placed = placed.selectExpr(*keys, "_slot", "_t", *alias.values(), "if(_t is null or _slot = _home, _row, null) as _row")
    over = f"over (partition by {', '.join(keys)}, _slot order by _t range between"
    frames = [f"if(_t is null, null, {o.fn}({alias[o.value]}) {over} {as_micros(o.span)}L preceding and "
              f"{'1L preceding' if o.closed == 'left' else 'current row'})) as {name}" for name, o in outputs.items()]
    own = placed.selectExpr(*keys, "_slot", "_row", *frames).where("_row is not null")
    result = own.selectExpr(*keys, "_slot", *[f"_row.{c} as {c}" for c in rest], *outputs)
    # With the slot among the columns the window's partitioning also serves ``distinct``.
    return (result.distinct() if distinct else result).select(*df.columns, *outputs)


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in ``order``.

    The rank filter is applied before the shuffle as well (partial group
    limit), so a hot key sends one row per input task, not all its rows.
    """
    rank = f"row_number() over (partition by {', '.join(keys)} order by {', '.join(order)}) as _rn"
    return df.selectExpr("*", rank).where("_rn = 1").drop("_rn")


def worst_rows(df: DataFrame, keys: list[str], worst: list[str], ts: str, columns: list[str],
               within: Mapping[str, str]) -> DataFrame:
    """Per key and output of ``within`` (name to condition) the ``columns`` of its
    row with the largest ``worst`` values (NULL largest), then the earliest
    ``ts``, as a struct; NULL without a row.

    One aggregate serves all outputs and combines before the shuffle, so a hot
    key sends one row per input task.
    """
    order = ", ".join([f"{c} is null, {c}" for c in worst] + [f"-{micros(ts)}"])
    row = ", ".join([ts, *columns])
    return df.groupBy(*keys).agg(*[
        F.expr(f"max_by(struct({row}), struct({order})) filter (where {test})").alias(name) for name, test in within.items()])
