"""Weight timeline: which body weight is valid for a stay at which time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.columns import interval, ladder, not_flagged, one_of
from ..functions.text import add_time_of_day, extract_fields
from ..operators.intervals import backfill_first, mark_first, preferred_intervals, to_intervals

LEAD_IN = interval(timedelta(hours=2))
_DIRECT = C.WEIGHT_ADMIT_ITEMS + C.WEIGHT_DAILY_ITEMS
_NEONATE = [C.NEONATE_KG, C.NEONATE_LB, C.NEONATE_OZ]
_BIRTH = [C.BIRTH_TEXT_ITEM, C.BIRTH_NUM_ITEM]
_KEYS = ["icustay_id", "charttime"]
_OUT = ["icustay_id", "starttime", "endtime", "weight"]


def _charted(chart: DataFrame, items: list[int]) -> DataFrame:
    return chart.where(f"{one_of('itemid', items)} and icustay_id is not null and {not_flagged('error')}")


def _maxima() -> list:
    """Largest usable kg, lb and oz value of a group."""
    named = {"wt_kg": C.NEONATE_KG, "wt_lb": C.NEONATE_LB, "wt_oz": C.NEONATE_OZ}
    return [F.expr(f"max(if(itemid = {item} and valuenum > 0, valuenum, null)) as {name}")
            for name, item in named.items()]


_NEONATE_KG = f"coalesce(wt_kg, wt_lb * {C.KG_PER_LB}D + wt_oz * {C.KG_PER_OZ}D)"
# Text weights above 100 are grams, below 10 kilograms, others unusable.
_TEXT_KG = "if(value rlike '[^0-9.]', null, try_cast(value as double))"
_BIRTH_KG = ladder([
    (f"itemid = {C.BIRTH_TEXT_ITEM} and {_TEXT_KG} > 100", f"{_TEXT_KG} / 1000"),
    (f"itemid = {C.BIRTH_TEXT_ITEM} and {_TEXT_KG} < 10", _TEXT_KG),
    (f"itemid = {C.BIRTH_NUM_ITEM} and valuenum < 10", "valuenum")])


def neonate_weight(chart: DataFrame) -> DataFrame:
    rows = _charted(chart, _NEONATE).where("valuenum > 0")
    return rows.groupBy(*_KEYS).agg(*_maxima()).selectExpr("*", f"{_NEONATE_KG} as weight")


def birth_weight(chart: DataFrame) -> DataFrame:
    return _charted(chart, _BIRTH).groupBy(*_KEYS).agg(F.expr(f"max({_BIRTH_KG}) as wt_kg"))


def weight_points(chart: DataFrame) -> DataFrame:
    """Every charted weight with its type ``admit`` or ``daily``.

    The chart table is read once: rows are grouped by (stay, time, kind) for
    the two kinds that need a maximum, and the directly charted weights, whose
    value is part of the group key, are counted and repeated.
    """
    kind = ladder([(one_of("itemid", _DIRECT), "'direct'"), (one_of("itemid", _NEONATE), "'neonate'")],
                  "'birth'")
    admit = one_of("itemid", C.WEIGHT_ADMIT_ITEMS + _BIRTH)
    rows = (_charted(chart, _DIRECT + _NEONATE + _BIRTH)
            .where(f"valuenum > 0 or {one_of('itemid', _BIRTH)}")
            .selectExpr(*_KEYS, "itemid", "value", "valuenum", f"{kind} as kind",
                        f"if({admit}, 'admit', 'daily') as weight_type",
                        f"if({one_of('itemid', _DIRECT)}, valuenum, null) as direct"))
    grouped = rows.groupBy(*_KEYS, "kind", "weight_type", "direct").agg(
        *_maxima(), F.expr(f"max({_BIRTH_KG}) as birth"), F.expr("count(1) as n"))
    weight = ladder([("kind = 'direct'", "direct"), ("kind = 'neonate'", _NEONATE_KG)], "birth")
    return grouped.selectExpr(
        *_KEYS, "weight_type", f"{weight} as weight",
        "explode(sequence(1L, if(kind = 'direct', n, 1L))) as _copy").drop("_copy")


def weight_starts(points: DataFrame, icustays: DataFrame) -> DataFrame:
    """Start of each weight; a stay's first admission weight counts from two
    hours before the stay."""
    stays = icustays.select("icustay_id", "dbsource", "intime", "outtime")
    known = points.where("weight is not null").join(stays, "icustay_id")
    ranked = mark_first(known, ["icustay_id", "weight_type"], "charttime", ["weight"], "_first")
    return ranked.selectExpr(
        "icustay_id", "intime", "outtime", "dbsource",
        f"if(weight_type = 'admit' and _first, intime - {LEAD_IN}, charttime) as starttime", "weight")


def weight_intervals(starts: DataFrame, first: str | None = None) -> DataFrame:
    return to_intervals(starts, ["icustay_id"], "starttime", f"outtime + {LEAD_IN}", ["weight"], first=first)


def charted_intervals(chart: DataFrame, icustays: DataFrame) -> DataFrame:
    """Intervals from charted weights; the stay's first weight also counts from
    two hours before the stay when it starts after the stay began."""
    spans = weight_intervals(weight_starts(weight_points(chart), icustays), "_first")
    return backfill_first(spans, "_first", "intime < starttime", "starttime", "endtime",
                          f"intime - {LEAD_IN}").select(*_OUT)


def echo_to_stay(notes: DataFrame, icustays: DataFrame) -> DataFrame:
    """Echo weights in kg at the stays of the note's admission."""
    echo = note_fields(notes).where("weight is not null").selectExpr(
        "hadm_id", "charttime as starttime", f"weight * {C.KG_PER_LB_NOTE}D as weight")
    stays = icustays.select("icustay_id", "hadm_id", "intime", "outtime")
    return echo.join(stays, "hadm_id").drop("hadm_id")


def echo_intervals(echo: DataFrame) -> DataFrame:
    begin = f"intime - {LEAD_IN}"
    return backfill_first(weight_intervals(echo, "_first"), "_first", f"starttime > {begin}", "starttime", "endtime",
                          begin).select(*_OUT)


def weight_durations(chart: DataFrame, notes: DataFrame, icustays: DataFrame) -> DataFrame:
    """Weight intervals ``[starttime, endtime)`` per stay; echo weights only
    for stays without any charted weight."""
    columns = ["icustay_id", "intime", "outtime", "starttime", "weight"]
    starts = weight_starts(weight_points(chart), icustays).selectExpr(*columns, "true as charted")
    starts = starts.unionByName(echo_to_stay(notes, icustays).selectExpr(*columns, "false as charted"))
    spans = preferred_intervals(starts, ["icustay_id"], "starttime", f"outtime + {LEAD_IN}", ["weight"], "charted")
    begin = f"intime - {LEAD_IN}"
    filled = backfill_first(spans, "_first", f"if(charted, intime < starttime, starttime > {begin})", "starttime", "endtime", begin)
    # With the columns of the last shuffle kept, ``distinct`` needs none.
    return filled.select(*_OUT, "charted", "_slot").distinct().select(*_OUT)


def note_fields(notes: DataFrame) -> DataFrame:
    """Labelled fields of echo notes, with the note's time of day on its date."""
    echo = notes.where("category = 'Echo'")
    fields = extract_fields(
        echo, ["row_id", "subject_id", "hadm_id", "chartdate"], "text",
        {"clock": C.NOTE_TIME, **C.NOTE_TEXT_FIELDS}, C.NOTE_NUMBER_FIELDS)
    return add_time_of_day(fields, "chartdate", "clock", "charttime").drop("clock")
