"""SQL expressions shared by every operator.

Each function returns the text of one built-in expression over column names,
for ``selectExpr``, ``where`` or ``F.expr``. Text composes freely, is parsed
once per query and stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import timedelta

MICROSECOND = timedelta(microseconds=1)


def as_micros(span: timedelta) -> int:
    return span // MICROSECOND


def interval(span: timedelta) -> str:
    return f"interval '{as_micros(span)}' microsecond"


def literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def one_of(x: str, values: Iterable[object]) -> str:
    return f"{x} in ({', '.join(map(literal, values))})"


def micros(ts: str) -> str:
    """Microseconds since 1970 of a zone-free timestamp.

    Whole seconds plus the rest of the interval since 1970: unlike
    ``timestampdiff`` this never passes through the session time zone, so no
    hour is lost at a clock change.
    """
    since = f"({ts} - timestamp_ntz'1970-01-01')"
    whole = f"cast({since} as bigint)"
    return (f"({whole} * 1000000"
            f" + cast(({since} - interval '1' second * {whole}) * 1000000 as bigint))")


def slot(ts: str, days: int = 1) -> str:
    """First day number of the slot of ``days`` days that holds ``ts``."""
    day = f"unix_date(cast({ts} as date))"
    return day if days == 1 else slot_start(day, days)


def whole_days(span: timedelta) -> int:
    return max(1, -(-span // timedelta(days=1)))


def slot_start(t: str, width: int) -> str:
    return f"({t} - pmod({t}, {width}))"


def hours_between(later: str, earlier: str) -> str:
    return f"(({micros(later)} - {micros(earlier)}) / 3.6e9D)"


def round_half_up(x: str, digits: int = 4) -> str:
    """Decimal rounding of a double; values too large for the decimal have no
    fraction and are returned unchanged."""
    return f"coalesce(cast(round(try_cast({x} as decimal(38,10)), {digits}) as double), {x})"


def in_window(ts: str, anchor: str, before: timedelta, after: timedelta,
              closed: str = "both") -> str:
    """``[anchor - before, anchor + after]``; ``closed="right"`` opens the low end."""
    above = ">" if closed == "right" else ">="
    return (f"({ts} {above} {anchor} - {interval(before)} and {ts} <= {anchor} + {interval(after)})")


def not_flagged(flag: str, value: int = 1) -> str:
    """True unless ``flag`` equals ``value``; a NULL flag counts as not flagged."""
    return f"not ({flag} <=> {value})"


def plausible(value: str, above: float | None = None, below: float | None = None,
              at_most: float | None = None) -> str:
    """Strict lower and upper bounds, or an inclusive upper bound; NULL never passes."""
    bounds = ((">", above), ("<", below), ("<=", at_most))
    tests = [f"{value} {sign} {bound}" for sign, bound in bounds if bound is not None]
    return f"({' and '.join(tests) or f'{value} is not null'})"


def ladder(rules: Iterable[tuple[str, str]], otherwise: str = "null") -> str:
    """First matching rule wins."""
    return f"case {' '.join(f'when {test} then {result}' for test, result in rules)} else {otherwise} end"


def _grouped(mapping: Mapping[int, object]) -> dict[object, list[int]]:
    groups: dict[object, list[int]] = {}
    for item, value in mapping.items():
        groups.setdefault(value, []).append(item)
    return groups


def code_label(code: str, labels: Mapping[int, str]) -> str:
    """Label of an item code, NULL when the code is not listed."""
    return ladder((one_of(code, items), literal(label)) for label, items in _grouped(labels).items())


def null_outliers(code: str, value: str, limits: Mapping[int, float]) -> str:
    """NULL where the value exceeds the limit of its item code."""
    over = ((f"{value} > {limit} and {one_of(code, items)}", "null")
            for limit, items in _grouped(limits).items())
    return ladder(over, value)


def guarded_label(code: str, value: str, rules: Mapping[str, list[tuple]]) -> str:
    """Label of an item whose value lies in the label's range, else NULL."""
    tests = []
    for label, ranges in rules.items():
        for codes, low, high, inclusive in ranges:
            bound = {"at_most": high} if inclusive else {"below": high}
            tests.append((f"{one_of(code, codes)} and {plausible(value, above=low, **bound)}",
                          literal(label)))
    return ladder(tests)


def to_celsius(code: str, value: str, fahrenheit_items: list[int]) -> str:
    return ladder([(one_of(code, fahrenheit_items), f"({value} - 32) / 1.8D")], value)


def prefix_flag(code: str, whole: list[str], four: list[str], three: list[str]) -> str:
    """1 when the code, its first four or its first three characters are listed."""
    tests = [one_of(f"substring({code}, 1, {n})" if n else code, values)
             for n, values in ((0, whole), (4, four), (3, three)) if values]
    return ladder([(" or ".join(tests), "1")], "0")


def literal_map(value: str, groups: Mapping[int, list[str]], unlisted: int | None) -> str:
    return ladder(((one_of(value, names), str(code)) for code, names in groups.items()),
                  literal(unlisted))


def all_finite(columns: list[str]) -> str:
    """True when every number is finite: zero times an infinity or NaN is NaN,
    times NULL is NULL. One small sum instead of a test per column."""
    return f"({' + '.join(f'{c} * 0D' for c in columns)}) = 0"
