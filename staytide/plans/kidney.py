"""Kidney injury staging from creatinine and urine output."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.columns import hours_between, in_window, interval, ladder, one_of, round_half_up
from ..operators.joins import align_series, attach_window, interval_join, time_spine, without
from ..operators.windows import Trailing, trailing_agg, worst_rows
from .weights import weight_durations

HOURS_48, DAYS_7 = timedelta(hours=48), timedelta(days=7)
HOURS_6 = timedelta(hours=6)
# Output column suffix -> hours looked back; the current value stands for one more hour.
URINE_HORIZONS = {"6hr": 5, "12hr": 11, "24hr": 23}
_STAY = ["icustay_id", "dbsource", "intime"]
_CREAT = ["icustay_id", "dbsource", "charttime", "creat", "aki_stage_creat"]
_RATES = [f"uo_rt_{h}" for h in URINE_HORIZONS]


# --- creatinine ------------------------------------------------------------------

def _creatinine_labs(labevents: DataFrame) -> DataFrame:
    rows = labevents.where(f"itemid = {C.CREATININE_ITEM} and valuenum is not null")
    return rows.selectExpr("subject_id", "charttime", "valuenum as creat")


def creatinine_series(icustays: DataFrame, labevents: DataFrame, how: str = "left") -> DataFrame:
    """Creatinine of the stay's patient within seven days around its start."""
    stays = icustays.select("icustay_id", "subject_id", "dbsource", "intime", "outtime")
    return attach_window(stays, _creatinine_labs(labevents), ["subject_id"], "charttime", "intime",
                         DAYS_7, DAYS_7, how=how).drop("subject_id")


def creatinine_baseline(icustays: DataFrame, labevents: DataFrame, how: str = "left",
                        slot: timedelta | None = None) -> DataFrame:
    """Lowest creatinine of the past 48 hours and 7 days, the present excluded;
    one row per (stay, time, value), as equal ones agree in every column."""
    series = creatinine_series(icustays, labevents, "inner")
    lows = trailing_agg(
        series.select(*_STAY, "charttime", "creat"), ["icustay_id"], "charttime",
        {"creat_low_past_48hr": Trailing("min", "creat", HOURS_48, "left"),
         "creat_low_past_7day": Trailing("min", "creat", DAYS_7, "left")}, slot, distinct=True)
    if how == "inner":
        return lows
    return icustays.select(*_STAY).join(lows.drop("dbsource", "intime"), "icustay_id", "left")


def stage_creatinine(baseline: DataFrame) -> DataFrame:
    """Stage ladder against the two lows; a missing low never raises a stage."""
    stage = ladder([
        ("creat >= creat_low_past_7day * 3.0D", "3"),
        ("creat >= 4 and (creat_low_past_48hr <= 3.7D or creat >= creat_low_past_7day * 1.5D)", "3"),
        ("creat >= creat_low_past_7day * 2.0D", "2"),
        ("creat >= creat_low_past_48hr + 0.3D", "1"),
        ("creat >= creat_low_past_7day * 1.5D", "1"),
    ], "0")
    return baseline.selectExpr("*", f"{stage} as aki_stage_creat")


def staged_creatinine(icustays: DataFrame, labevents: DataFrame, how: str = "inner") -> DataFrame:
    return stage_creatinine(creatinine_baseline(icustays, labevents, how))


# --- urine -----------------------------------------------------------------------

def urine_output(outputevents: DataFrame) -> DataFrame:
    """Urine volume per stay and time; irrigant put in counts negative."""
    rows = outputevents.where(f"{one_of('itemid', C.URINE_ITEMS)} and value < {C.URINE_VALUE_BELOW}"
                              " and icustay_id is not null")
    return rows.groupBy("icustay_id", "charttime").agg(
        F.expr(f"sum(if(itemid = {C.URINE_NEGATED}, -value, value)) as value"))


def urine_trailing(urine: DataFrame, slot: timedelta | None = None) -> DataFrame:
    """Volume over the last 6, 12 and 24 hours and hours since the window's first value."""
    outputs: dict[str, Trailing] = {}
    for name, hours in URINE_HORIZONS.items():
        span = timedelta(hours=hours)
        outputs[f"urineoutput_{name}"] = Trailing("sum", "value", span)
        outputs[f"_since_{name}"] = Trailing("min", "charttime", span)
    windowed = trailing_agg(urine, ["icustay_id"], "charttime", outputs, slot)
    elapsed = [f"{round_half_up(hours_between('charttime', f'_since_{n}'))} as uo_tm_{n}"
               for n in URINE_HORIZONS]
    return windowed.selectExpr("icustay_id", "charttime",
                               *[f"urineoutput_{n}" for n in URINE_HORIZONS], *elapsed)


def urine_rates(trailing: DataFrame, weights: DataFrame) -> DataFrame:
    """Volume per kg and hour, with the weight valid at the time."""
    weighed = interval_join(trailing, weights, ["icustay_id"], "charttime", "starttime", "endtime")
    rates = [f"try_divide(try_divide(urineoutput_{n}, weight), uo_tm_{n} + 1) as uo_rt_{n}"
             for n in URINE_HORIZONS]
    volumes, hours = ([f"{c}_{n}" for n in URINE_HORIZONS] for c in ("urineoutput", "uo_tm"))
    return weighed.selectExpr("icustay_id", "charttime", "weight", *volumes, *rates, *hours).selectExpr(
        "icustay_id", "charttime", "weight", *volumes,
        *[f"{round_half_up(c)} as {c}" for c in _RATES], *hours)


def stage_urine(rates: DataFrame, icustays: DataFrame) -> DataFrame:
    """Stage ladder on the rates. The first six hours of a stay are stage 0."""
    stage = ladder([
        ("uo_rt_6hr is null", "null"),
        (f"charttime <= intime + {interval(HOURS_6)}", "0"),
        ("uo_tm_24hr >= 11 and uo_rt_24hr < 0.3D", "3"),
        ("uo_tm_12hr >= 5 and uo_rt_12hr = 0", "3"),
        ("uo_tm_12hr >= 5 and uo_rt_12hr < 0.5D", "2"),
        ("uo_tm_6hr >= 2 and uo_rt_6hr < 0.5D", "1"),
    ], "0")
    rated = rates.join(icustays.select(*_STAY), "icustay_id")
    return rated.selectExpr(*_STAY, "charttime", "weight", *_RATES, f"{stage} as aki_stage_uo")


def staged_urine(outputevents: DataFrame, weights: DataFrame, icustays: DataFrame) -> DataFrame:
    trailing = urine_trailing(urine_output(outputevents))
    return stage_urine(urine_rates(trailing, weights), icustays)


# --- from source tables ----------------------------------------------------------

@dataclass(frozen=True)
class StayTables:
    """The source tables of one data set; unused ones may be left out."""

    icustays: DataFrame
    labevents: DataFrame
    outputevents: DataFrame | None = None
    chartevents: DataFrame | None = None
    noteevents: DataFrame | None = None
    admissions: DataFrame | None = None
    patients: DataFrame | None = None
    diagnoses_icd: DataFrame | None = None


def staged_series(t: StayTables) -> tuple[DataFrame, DataFrame]:
    """Staged creatinine and urine of every stay."""
    weights = weight_durations(t.chartevents, t.noteevents, t.icustays)
    return staged_creatinine(t.icustays, t.labevents), staged_urine(t.outputevents, weights, t.icustays)


def stage_48h(t: StayTables) -> DataFrame:
    return worst_stage(t.icustays, *staged_series(t), {"48hr": HOURS_48})


def stage_7day(t: StayTables) -> DataFrame:
    return worst_stage(t.icustays, *staged_series(t), {"7day": DAYS_7})


def stage_horizons(t: StayTables) -> DataFrame:
    """Worst stages of both horizons from one evaluation of the series."""
    return worst_stage(t.icustays, *staged_series(t), {"48hr": HOURS_48, "7day": DAYS_7})


def stage_7day_creatinine(t: StayTables) -> DataFrame:
    return worst_stage(t.icustays, staged_creatinine(t.icustays, t.labevents), None, {"7day": DAYS_7})


def stages_all_times(t: StayTables) -> DataFrame:
    weights = weight_durations(t.chartevents, t.noteevents, t.icustays)
    return stages(staged_creatinine(t.icustays, t.labevents, "left"), staged_urine(t.outputevents, weights, t.icustays))


# --- stages at every time -----------------------------------------------------------

def stages(creat: DataFrame, urine: DataFrame) -> DataFrame:
    """Both stages and the larger of them at every time either is known.

    ``creat`` has an undated row for every stay without a value
    (``how="left"``), ``urine`` at most one undated row per stay; a stay with
    either has one row with NULL time.
    """
    cr = creat.selectExpr("icustay_id", "charttime", "dbsource as cr_source", "creat",
                          "if(charttime is null, null, aki_stage_creat) as aki_stage_creat")
    uo = urine.selectExpr("icustay_id", "charttime", "dbsource as uo_source", *_RATES, "aki_stage_uo")
    return align_series(cr, uo, ["icustay_id"], "charttime").selectExpr(
        "icustay_id", "coalesce(cr_source, uo_source) as dbsource", "charttime", "creat",
        "aki_stage_creat", *_RATES, "aki_stage_uo",
        "greatest(aki_stage_creat, aki_stage_uo) as aki_stage")


def stages_creatinine(creat: DataFrame, icustays: DataFrame) -> DataFrame:
    """Creatinine stage at every time. The spine of times is not
    de-duplicated: n values at one instant give n * n rows."""
    dated = creat.where("charttime is not null").select(*_CREAT)
    spine = time_spine(dated, keys=["icustay_id"], ts="charttime", distinct=False)
    repeats = spine.groupBy("icustay_id", "charttime").count()
    rows = dated.join(repeats, ["icustay_id", "charttime"]).selectExpr(
        *_CREAT, "explode(sequence(1L, count)) as _copy").drop("_copy")
    missing = without(icustays.select("icustay_id", "dbsource"), dated, "icustay_id")
    rows = rows.unionByName(missing, allowMissingColumns=True)
    return rows.selectExpr("*", "aki_stage_creat as aki_stage")


# --- worst stage per horizon ----------------------------------------------------------

Horizons = Mapping[str, timedelta]


def _within(horizons: Horizons) -> dict[str, str]:
    return {name: in_window("charttime", "intime", HOURS_6, span, "right") for name, span in horizons.items()}


def worst_creatinine(creat: DataFrame, horizons: Horizons) -> DataFrame:
    """Per stay and horizon the time, value and stage of its worst creatinine, as one struct each."""
    return worst_rows(creat, ["icustay_id"], ["aki_stage_creat", "creat"], "charttime", ["creat", "aki_stage_creat"], _within(horizons))


def worst_urine(urine: DataFrame, horizons: Horizons) -> DataFrame:
    """Per stay and horizon the time, rates and stage of its worst urine output, as one struct each."""
    return worst_rows(urine.where("aki_stage_uo is not null"), ["icustay_id"],
                      ["aki_stage_uo", "uo_rt_24hr", "uo_rt_12hr", "uo_rt_6hr"], "charttime", [*_RATES, "aki_stage_uo"], _within(horizons))


def worst_stage(icustays: DataFrame, creat: DataFrame, urine: DataFrame | None, horizons: Horizons) -> DataFrame:
    """Worst stage of each stay in ``(intime - 6 h, intime + horizon]``, for one
    or more horizons from one evaluation; with several, the columns of a
    horizon's rows end in its name.

    The two series are ranked directly: joining them at every instant first
    would not change either's worst row. Stays without one keep NULLs and
    flag 0.
    """
    named = {h: f"_{h}" if len(horizons) > 1 else "" for h in horizons}
    sides = {"creat": (worst_creatinine(creat, horizons), ["creat", "aki_stage_creat"])}
    if urine is not None:
        sides["uo"] = (worst_urine(urine, horizons), [*_RATES, "aki_stage_uo"])
    result = icustays.select("icustay_id", "dbsource")
    for side, (found, _) in sides.items():
        result = result.join(found.selectExpr("icustay_id", *[f"`{h}` as {side}_{h}" for h in horizons]), "icustay_id", "left")
    columns = []
    for h, end in named.items():
        columns += [f"{side}_{h}.{c} as {c if c != 'charttime' else f'charttime_{side}'}{end}"
                    for side, (_, cs) in sides.items() for c in ["charttime", *cs]]
        level = ", ".join(f"{side}_{h}.aki_stage_{side}" for side in sides)
        level = f"greatest({level})" if len(sides) > 1 else level
        columns += [f"{level} as aki_stage_{h}", f"if({level} > 0, 1, 0) as aki_{h}"]
    return result.selectExpr("icustay_id", "dbsource", *columns)
