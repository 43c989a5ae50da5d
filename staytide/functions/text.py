"""Labelled fields in free text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from .columns import literal


def capture(text: str, pattern: str) -> str:
    """First group of the first match; NULL without a match, '' for an empty
    group. ``(?s)`` lets ``.`` cross a carriage return."""
    return f"get(regexp_extract_all({text}, {literal('(?s)' + pattern)}, 1), 0)"


def number(text: str) -> str:
    """Numeric text as double; NULL if masked with ``*`` or not numeric."""
    return f"if(contains({text}, '*'), null, try_cast({text} as double))"


def add_time_of_day(df: DataFrame, day: str, clock: str, out: str) -> DataFrame:
    """Adds ``day`` at the ``H:mm`` of the clock text, whatever follows the
    minutes ignored; NULL when the text is no time of day."""
    parts = df.selectExpr("*", f"try_cast(split_part({clock}, ':', 1) as int) as _hour",
                          f"try_cast(left(split_part({clock}, ':', 2), 2) as int) as _minute")
    midnight = f"cast(cast(cast({day} as timestamp_ntz) as date) as timestamp_ntz)"
    time = f"if(_hour < 24 and _minute < 60, {midnight} + make_dt_interval(0, _hour, _minute), null)"
    return parts.selectExpr(*df.columns, f"{time} as {out}")


def extract_fields(notes: DataFrame, keep: list[str], text: str, text_fields: Mapping[str, str],
                   number_fields: Mapping[str, str]) -> DataFrame:
    """One row per note: ``keep`` columns plus every labelled field."""
    fields = {**text_fields, **number_fields}
    captured = notes.selectExpr(*keep, *[f"{capture(text, p)} as {n}" for n, p in fields.items()])
    return captured.selectExpr(*keep, *text_fields, *[f"{number(n)} as {n}" for n in number_fields])
