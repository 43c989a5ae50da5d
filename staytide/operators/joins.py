"""Time-aware joins between episodes, events and validity intervals."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROSECOND, in_window, interval, one_of, slot, slot_start, whole_days


#: Column with the slot of days of an event.
SLOT = "_slot"


def slot_days(before: timedelta, after: timedelta) -> int:
    return whole_days((before + after) / 2)


def with_slot(events: DataFrame, ts: str, before: timedelta, after: timedelta) -> DataFrame:
    """Events with the slot by which :func:`attach_window` joins them for these windows."""
    return events.selectExpr("*", f"{slot(ts, slot_days(before, after))} as {SLOT}")


def attach_window(episodes: DataFrame, events: DataFrame, on: list[str], ts: str, anchor: str,
                  before: timedelta, after: timedelta, closed: str = "both",
                  how: str = "inner", episode_key: str = "icustay_id", stored: bool = False) -> DataFrame:
    """Events of each episode within ``anchor - before .. anchor + after``.

    The join is an equi join on ``on`` and a slot of days about half as wide as
    the window, so an episode row is repeated at most three times and one key's
    events spread over slots. Being an inner join on every row, a slot that is
    still too large can be divided by adaptive execution, and the episode side
    is broadcast only when its measured size allows.

    ``how="left"`` joins the episodes, one row per ``episode_key``, to the
    matched rows once more, which adds those without an event.

    ``stored=True`` takes events that carry their slot already (see
    :func:`with_slot`). Where they come from a table bucketed by ``on`` and
    slot, only the episodes are shuffled.
    """
    days = slot_days(before, after)
    first, last = (slot(f"({anchor} {move})", days)
                   for move in (f"- {interval(before)}", f"+ {interval(after)}"))
    windows = episodes.selectExpr(
        "*", f"explode(sequence({first}, {last}, {days})) as _slot")
    slotted = events if stored else with_slot(events, ts, before, after)
    matched = (windows.join(slotted, [*on, SLOT])
               .where(in_window(ts, anchor, before, after, closed)).drop("_slot"))
    if how == "inner":
        return matched
    others = [c for c in episodes.columns if c != episode_key]
    rest = [c for c in matched.columns if c not in others]
    return episodes.join(matched.select(*rest), episode_key, "left").select(*matched.columns)


def _nodes(ts: str, levels: list[int]) -> str:
    """The time nodes that hold an instant, one per level."""
    day = slot(ts)
    return "array(" + ", ".join(f"struct({i} as level, {slot_start(day, w)} as node)" for i, w in enumerate(levels)) + ")"


def _tiles(start: str, end: str, levels: list[int]) -> str:
    """Time nodes that tile the days of ``[start, end)``: of every level the whole nodes inside, next to the ends, that
    no node of the level above covers."""
    first, last = slot(start), f"({slot(f'({end} - {interval(MICROSECOND)})')} + 1)"
    tiles = []
    for i, width in enumerate(levels):
        up = lambda x, w=width: f"(-{slot_start(f'(-{x})', w)})"  # noqa: E731  the next node's edge at or after x
        low, high = up(first), slot_start(last, width)
        steps = lambda a, b, w=width: f"if({a} < {b}, sequence({a}, {b} - 1, {w}), array())"
        if i + 1 < len(levels):
            wide = levels[i + 1]
            next_low, next_high = up(first, wide), slot_start(last, wide)
            covered = f"({next_low} < {next_high})"
            parts = [steps(low, f"if({covered}, {next_low}, {high})"), f"if({covered}, {steps(next_high, high)}, array())"]
        else:
            parts = [steps(low, high)]
        tiles += [f"transform(cast({p} as array<int>), x -> struct({i} as level, x as node))" for p in parts]
    return f"concat({', '.join(tiles)})"


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, start: str,
                  end: str, base: int = 16, levels: int = 5) -> DataFrame:
    """Left join of points to the intervals ``[start, end)`` that hold them.

    Hierarchical time index: level i has nodes of ``base``**i days. An interval
    is stored under the few nodes that tile its days, so its copies grow with
    the logarithm of its length; an instant probes the one node per level that
    holds it, and the exact test stays. Tiles do not overlap, so no match is
    repeated. A task meets the instants and intervals of a (key, node), not of
    a key. The matches of the distinct instants are joined back to the points.
    """
    widths = [base**i for i in range(levels)]
    payload = [c for c in intervals.columns if c not in keys]
    named = {c: f"_i_{c}" for c in payload}
    tiled = (intervals.where(f"{start} < {end}")
             .selectExpr(*keys, *[f"{c} as {a}" for c, a in named.items()], f"inline({_tiles(start, end, widths)}) as (_level, _node)"))
    probes = (points.where(f"{ts} is not null").selectExpr(*keys, f"{ts} as _ts").distinct()
              .selectExpr(*keys, "_ts", f"inline({_nodes('_ts', widths)}) as (_level, _node)"))
    hits = (probes.join(tiled, [*keys, "_level", "_node"]).where(f"_ts >= {named[start]} and _ts < {named[end]}")
            .selectExpr(*[f"{k} as _k_{k}" for k in keys], "_ts", *named.values()))
    same = " and ".join([f"{k} = _k_{k}" for k in keys] + [f"{ts} = _ts"])
    return points.join(hits, F.expr(same), "left").selectExpr(*points.columns, *[f"{a} as {c}" for c, a in named.items()])


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``other``; keys of ``other`` are
    de-duplicated before they are shuffled."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def align_series(left: DataFrame, right: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """All instants of two series side by side, undated rows of a key with each other.

    A full outer join on (key, instant) gives the rows a de-duplicated spine
    with two left joins would give, without building the spine; each series is
    evaluated once.
    """
    theirs = right.selectExpr(*[f"{c} as _r_{c}" if c in [*keys, ts] else c for c in right.columns])
    same = " and ".join([f"{k} = _r_{k}" for k in keys] + [f"{ts} <=> _r_{ts}"])
    own = [c for c in left.columns if c not in [*keys, ts]]
    return left.join(theirs, F.expr(same), "full").selectExpr(
        *[f"coalesce({c}, _r_{c}) as {c}" for c in [*keys, ts]], *own, *[c for c in right.columns if c not in [*keys, ts]])


def time_spine(*series: DataFrame, keys: list[str], ts: str, distinct: bool = True) -> DataFrame:
    """The instants at which any series has a row."""
    spine = series[0].select(*keys, ts)
    for other in series[1:]:
        spine = spine.unionByName(other.select(*keys, ts))
    return spine.distinct() if distinct else spine


def has_code(rows: DataFrame, coded: DataFrame, key: str, code: str, codes: list[object],
             out: str) -> DataFrame:
    """Flag rows whose key has any of the codes."""
    hits = coded.where(one_of(code, codes)).select(key).distinct().selectExpr(key, f"true as {out}")
    return rows.join(hits, key, "left").withColumn(out, F.expr(f"coalesce({out}, false)"))
