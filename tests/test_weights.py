"""Hand-computed cases for the weight timeline and note fields."""

import random
from datetime import datetime, timedelta

import pytest

from staytide.operators import intervals as I
from staytide.plans import weights as W

T0 = datetime(2024, 1, 1)
CHART = ("subject_id long, hadm_id long, icustay_id long, itemid int, charttime timestamp_ntz, value string, "
         "valuenum double, error int")
STAYS = "icustay_id long, hadm_id long, dbsource string, intime timestamp_ntz, outtime timestamp_ntz"
NOTES = "row_id long, subject_id long, hadm_id long, chartdate timestamp_ntz, category string, text string"


def h(n):
    return T0 + timedelta(hours=n)


def chart(stay, item, at, num, text=None, error=0):
    return (1, 1, stay, item, at, text, num, error)


def echo(hadm, at, pounds, row=1):
    text = f"Date/Time: [**2024-1-1**] at {at}\nWeight (lb): {pounds}\n"
    return (row, 1, hadm, T0, "Echo", text)


def spans(df):
    return sorted(((r["icustay_id"], r["starttime"], r["endtime"], round(r["weight"], 4)) for r in df.collect()), key=str)


def test_timeline(table):
    stays = table(STAYS, *[(i, 10 * i, "x", h(0), h(48)) for i in range(1, 7)], (7, 70, "x", h(0), None))
    charted = table(
        CHART,
        chart(1, 762, h(3), 80.0),                            # admission weight only
        chart(2, 763, h(5), 70.0),                            # daily only: back-filled
        chart(3, 226512, h(4), 60.0), chart(3, 224639, h(30), 61.0), chart(3, 226512, h(31), 62.0),
        chart(3, 763, h(31), 99.0, error=1), chart(3, 763, h(32), 0.0), chart(3, 763, h(33), 63.0, error=None),
        chart(6, 763, h(5), 50.0), chart(6, 763, h(5), 50.0),  # a repeated row
        chart(7, 762, h(3), 80.0))
    notes = table(NOTES, echo(10, "09:30", 150), echo(40, "09:30", 100), echo(40, "20:00", 110, 2),
                  echo(50, "xx", 100), (9, 1, 40, T0, "Other", "Weight (lb): 7\n"))
    got = spans(W.weight_durations(charted, notes, stays))
    assert got == sorted([
        (1, h(-2), h(50), 80.0),
        (2, h(5), h(50), 70.0), (2, h(-2), h(5), 70.0),
        (3, h(-2), h(30), 60.0), (3, h(30), h(31), 61.0), (3, h(31), h(33), 62.0), (3, h(33), h(50), 63.0),
        (4, h(9.5), h(20), 45.3592), (4, h(20), h(50), 49.8951), (4, h(-2), h(9.5), 45.3592),
        (5, None, h(50), 45.3592),
        (6, h(5), h(5), 50.0), (6, h(5), h(50), 50.0), (6, h(-2), h(5), 50.0),
        (7, h(-2), None, 80.0),
    ], key=str)


def test_intervals_do_not_overlap(table):
    stays = table(STAYS, (1, 10, "x", h(0), h(48)))
    charted = table(CHART, *[chart(1, 763, h(3 * i), 70.0 + i) for i in range(12)], chart(1, 762, h(9), 50.0))
    notes = table(NOTES)
    got = sorted(spans(W.weight_durations(charted, notes, stays)), key=lambda s: s[1])
    assert all(a[2] <= b[1] for a, b in zip(got, got[1:])) and got[0][1] == h(-2)


def test_birth_weight(table):
    texts = {"3.2": 3.2, "3200": 3.2, "50": None, "3,2": None, "": None, None: None}
    df = table(CHART, *[chart(1, 4183, h(i), 5.0, t) for i, t in enumerate(texts)], chart(1, 3723, h(20), 4.0),
               chart(1, 3723, h(21), 11.0))
    got = {r["charttime"]: r["wt_kg"] for r in W.birth_weight(df).collect()}
    assert [got[h(i)] for i in range(len(texts))] == list(texts.values())
    assert (got[h(20)], got[h(21)]) == (4.0, None)


def test_neonate_weight(table):
    df = table(CHART, chart(1, 3580, h(0), 3.0), chart(1, 3581, h(0), 9.0), chart(1, 3581, h(1), 6.0),
               chart(1, 3582, h(1), 8.0), chart(1, 3581, h(2), 6.0), chart(1, 3580, h(3), -1.0))
    got = {r["charttime"]: r["weight"] for r in W.neonate_weight(df).collect()}
    assert got == {h(0): 3.0, h(1): pytest.approx(6 * 0.45359237 + 8 * 0.0283495231), h(2): None}


def test_note_fields(table):
    text = ("Date/Time: [**2024-1-1**] at 09:15:33\nIndication: chest\rpain\nHeight: (in) **\nWeight (lb): 1*0\n"
            "BSA (m2): 1.91 m2\nBP (mm Hg): 120/80\nHR (bpm): 77\nTest: \nStatus: Inpatient\nStatus: Outpatient\n")
    other = "Date/Time: [**2024-1-1**] at 25:00\nHeight: (in) tall\nBP (mm Hg): 120/x\n"
    got = W.note_fields(table(NOTES, (1, 1, 1, datetime(2024, 3, 10, 5), "Echo", text), (2, 1, 1, T0, "Echo", other),
                              (3, 1, 1, T0, "Nursing", text))).orderBy("row_id").collect()
    a, b = got
    assert a["charttime"] == datetime(2024, 3, 10, 9, 15) and a["indication"] == "chest\rpain"
    assert (a["height"], a["weight"], a["bsa"]) == (None, None, 1.91)
    assert (a["bp"], a["bpsys"], a["bpdias"], a["hr"]) == ("120/80", 120.0, 80.0, 77.0)
    assert (a["test"], a["status"], a["doppler"]) == ("", "Inpatient", None)
    assert (b["charttime"], b["height"], b["bp"], b["bpsys"]) == (None, None, "120/x", None)


@pytest.mark.parametrize("days", [1, 3, 32, 4096])
def test_order_across_slots_equals_brute_force(table, days):
    """NULL keys are a key; undated rows come last; repeated rows each have a place."""
    draw = random.Random(days)
    data = [(draw.choice([1, 2, None]), None if draw.random() < 0.05 else T0 + timedelta(hours=draw.randint(0, 900)), draw.randint(0, 3), i)
            for i in range(150)]
    data += [(3, T0, 1, 900), (3, T0, 1, 901), (3, T0 + timedelta(days=40), 1, 902)]
    got = I.in_order(table("k int, t timestamp_ntz, w int, id int", *data), ["k"], "t", ["w", "id"], days).collect()
    want = {}
    for k in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is None, r[1] or T0, r[2], r[3]))
        for i, r in enumerate(own):
            want[r[3]] = (own[i + 1][1] if i + 1 < len(own) else None, i == 0)
    assert {r["id"]: (r["_next"], r["_first"]) for r in got} == want and len(got) == len(data)


def test_equal_rows_end_once_at_the_next_slot(table):
    """Of equal rows in a slot one lasts until the first row of the key's next slot."""
    df = table("k int, t timestamp_ntz, end timestamp_ntz", *[(1, T0, h(999))] * 3, (1, T0 + timedelta(days=90), h(9999)))
    got = sorted(r["endtime"] for r in I.to_intervals(df, ["k"], "t", "end", [], first="_f").collect())
    assert got == [T0, T0, T0 + timedelta(days=90), h(9999)]


@pytest.mark.parametrize("days", [1, 32])
def test_fallback_is_decided_per_key(table, days):
    kind = "k int, t timestamp_ntz, v int"
    first = table(kind, (1, h(0), 1), (1, h(0), 1), (1, h(4000), 2), (None, h(5), 3))
    second = table(kind, (1, h(2000), 9), (2, h(0), 7), (2, h(5000), 8), (2, None, 6), (None, h(9), 5))
    got = [tuple(r) for r in I.fallback_intervals(first, second, "k", "t", days).collect()]
    assert sorted(got, key=str) == sorted([(1, h(0), 1), (1, h(4000), 2), (None, h(5), 3), (2, h(0), 7), (2, h(5000), 8), (2, None, 6)], key=str)
