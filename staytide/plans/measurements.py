"""First-week laboratory values and vital signs, one wide row per stay."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame

from ..functions import codes as C
from ..functions.columns import (code_label, guarded_label, not_flagged, null_outliers, one_of,
                                 to_celsius)
from ..operators.aggregates import pivot_agg
from ..operators.joins import SLOT, attach_window, with_slot
from ..sources.tables import store_bucketed

BEFORE, AFTER = timedelta(hours=6), timedelta(days=7)
STAY_KEYS = ["subject_id", "hadm_id", "icustay_id", "dbsource"]


def _stays(icustays: DataFrame) -> DataFrame:
    return icustays.select(*STAY_KEYS, "intime")


def lab_events(labevents: DataFrame) -> DataFrame:
    """Listed lab items with a positive value."""
    items = list(C.lab_item_labels())
    return labevents.where(f"{one_of('itemid', items)} and valuenum > 0").select(
        "subject_id", "hadm_id", "itemid", "charttime", "valuenum")


def store_labs(labevents: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """The lab events as a table bucketed by admission and slot of days, for
    any number of :func:`attach_labs` and :func:`lab_pivot` with ``stored=True``."""
    return store_bucketed(with_slot(lab_events(labevents), "charttime", BEFORE, AFTER), name,
                          ["subject_id", "hadm_id", SLOT], ["charttime"], buckets)


def attach_labs(icustays: DataFrame, labevents: DataFrame, how: str = "left", stored: bool = False) -> DataFrame:
    """Listed lab items of the stay's admission with a positive value, from
    six hours before to seven days after the start of the stay. ``stored``:
    ``labevents`` is a table of :func:`store_labs`."""
    labs = labevents if stored else lab_events(labevents)
    return attach_window(_stays(icustays), labs, ["subject_id", "hadm_id"], "charttime", "intime",
                         BEFORE, AFTER, how=how, stored=stored).drop("intime")


def lab_pivot(icustays: DataFrame, labevents: DataFrame, stored: bool = False) -> DataFrame:
    """Minimum and maximum of 19 laboratory values. Stays without labs come
    from the final left join, so the event join itself can stay inner."""
    wide = pivot_agg(attach_labs(icustays, labevents, "inner", stored), ["icustay_id"],
                     code_label("itemid", C.lab_item_labels()),
                     null_outliers("itemid", "valuenum", C.lab_item_limits()),
                     C.LABS, ["min", "max"], "lab_")
    return icustays.select(*STAY_KEYS).join(wide, "icustay_id", "left")


def attach_vitals(icustays: DataFrame, chartevents: DataFrame) -> DataFrame:
    """Listed vital sign items of the stay that are not marked as errors."""
    chart = chartevents.where(f"{one_of('itemid', C.vital_items())} and {not_flagged('error')}")
    keys = ["subject_id", "hadm_id", "icustay_id"]
    return attach_window(_stays(icustays),
                         chart.select(*keys, "itemid", "charttime", "valuenum"), keys,
                         "charttime", "intime", BEFORE, AFTER).drop("intime")


def vitals_pivot(icustays: DataFrame, chartevents: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of 8 vital signs; only stays with a listed
    item, which stay with NULLs when no value is in range."""
    return pivot_agg(attach_vitals(icustays, chartevents), STAY_KEYS,
                     guarded_label("itemid", "valuenum", C.VITALS),
                     to_celsius("itemid", "valuenum", C.FAHRENHEIT_ITEMS),
                     C.VITALS, ["min", "max", "mean"], "vital_")
