"""Points on a time line turned into validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import slot

# Undated rows sort last, hence the largest slot. The rows at the edges of a key's slots meet in a part of their own.
_LAST_SLOT, _EDGES = (1 << 31) - 1, -(1 << 31)


def _slotted(df: DataFrame, ts: str, days: int) -> DataFrame:
    return df.selectExpr("*", f"coalesce({slot(ts, days)}, {_LAST_SLOT}) as _slot")


def _over(keys: list[str], order: list[str]) -> str:
    return f"over (partition by {', '.join(keys)} order by {', '.join(f'{c} asc nulls last' for c in order)})"


def in_order(df: DataFrame, keys: list[str], ts: str, ties: list[str], days: int = 32) -> DataFrame:
    """Add ``_next``, the key's next ``ts`` in the order of (``ts``, ``ties``), and ``_first``, true for its first row.

    Rows are ordered within time slots of ``days``; then a slot's first and last
    rows are ordered once more per key, where the last row of a slot finds the
    first one of the key's next slot. So a task sorts a slot's rows or a key's
    slots, never all rows of a key, and the input is read once.
    """
    order = [ts, *ties]
    inside = _over([*keys, "_slot"], order)
    placed = _slotted(df, ts, days).selectExpr(
        "*", f"lead({ts}) {inside} as _ahead", f"lead(_slot) {inside} is null as _tail", f"row_number() {inside} as _rn")
    edges = placed.selectExpr("*", f"if(_rn = 1 or _tail, {_EDGES}, _slot) as _part")
    across = _over([*keys, "_part"], [*order, "_rn"])
    found = edges.selectExpr("*", f"lead({ts}) {across} as _later", f"row_number() {across} as _place")
    return found.selectExpr(*df.columns, "if(_tail, _later, _ahead) as _next", "_rn = 1 and _place = 1 as _first")


def mark_first(df: DataFrame, keys: list[str], ts: str, ties: list[str], out: str) -> DataFrame:
    """Flag the earliest row per key."""
    return in_order(df, keys, ts, ties).selectExpr(*df.columns, f"_first as {out}")


def to_intervals(df: DataFrame, keys: list[str], start: str, fallback_end: str, ties: list[str],
                 out: str = "endtime", first: str | None = None) -> DataFrame:
    """Add the end of each row's validity: the key's next start, else the
    fallback; and with ``first`` a flag of the key's earliest row."""
    return in_order(df, keys, start, ties).selectExpr(
        *df.columns, f"coalesce(_next, {fallback_end}) as {out}", *([f"_first as {first}"] if first else []))


def backfill_first(df: DataFrame, first: str, due: str, start: str, end: str,
                   from_time: str) -> DataFrame:
    """Repeat a key's first interval from an earlier time up to its start.

    ``first`` marks the row and ``due`` says whether the gap exists. Both rows
    come from one pass over the input.
    """
    keep = f"struct({start} as s, {end} as e)"
    spans = f"if({first} and {due}, array({keep}, struct({from_time} as s, {start} as e)), array({keep}))"
    others = [c for c in df.columns if c not in (start, end)]
    return df.selectExpr(*others, f"inline({spans}) as ({start}, {end})")


def fallback_intervals(primary: DataFrame, secondary: DataFrame, key: str, ts: str, days: int = 32) -> DataFrame:
    """Distinct primary intervals, and secondary ones for keys the primary lacks.

    Both sides are evaluated once: whether a key has a primary row is found per
    time slot of ``ts``, then from one row per slot, and handed back to the
    slot's rows, so no task meets all rows of a key.
    """
    both = primary.selectExpr("*", "true as _primary").unionByName(
        secondary.selectExpr("*", "false as _primary"))
    inside = _over([key, "_slot"], [ts])
    placed = _slotted(both, ts, days).selectExpr(
        "*", f"max(_primary) over (partition by {key}, _slot) as _any", f"row_number() {inside} as _rn")
    heads = placed.selectExpr("*", f"if(_rn = 1, {_EDGES}, _slot) as _part").selectExpr(
        "*", f"max(_any) over (partition by {key}, _part) as _known")
    told = heads.selectExpr("*", f"max(if(_rn = 1, _known, null)) over (partition by {key}, _slot) as _has_primary")
    kept = told.where("_primary or not _has_primary").select(*primary.columns, "_slot")
    return kept.distinct().select(*primary.columns)


def preferred_intervals(points: DataFrame, keys: list[str], start: str, fallback_end: str, ties: list[str], preferred: str,
                        out: str = "endtime", first: str = "_first", days: int = 32) -> DataFrame:
    """:func:`to_intervals` of the ``preferred`` points of each key, and of its
    others where it has none. Adds the slot's number as ``_slot``, by which the
    rows lie.

    Both kinds are put in order together, preferred first: what finds the next
    start across slots also tells a slot's first row whether its key has a
    preferred point, and the slot's other rows learn it from there.
    """
    order = [start, *ties]
    inside = _over([*keys, preferred, "_slot"], order)
    placed = _slotted(points, start, days).selectExpr(
        "*", f"lead({start}) {inside} as _ahead", f"lead(_slot) {inside} is null as _tail", f"row_number() {inside} as _rn")
    edges = placed.selectExpr("*", f"if(_rn = 1 or _tail, {_EDGES}, _slot) as _part", f"not {preferred} as _other")
    part = f"partition by {', '.join(keys)}, _part"
    across = _over([*keys, "_part"], ["_other", *order, "_rn"])
    found = edges.selectExpr(
        "*", f"if(lead(_other) {across} = _other, lead({start}) {across}, null) as _later", f"row_number() {across} as _place",
        f"max({preferred}) over ({part}) as _known")
    told = found.selectExpr("*", f"max(if(_rn = 1, _known, null)) over (partition by {', '.join(keys)}, {preferred}, _slot) as _has")
    return told.where(f"{preferred} or not _has").selectExpr(
        *points.columns, "_slot", f"coalesce(if(_tail, _later, _ahead), {fallback_end}) as {out}", f"_rn = 1 and _place = 1 as {first}")
