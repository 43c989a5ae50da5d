"""Hand-computed cases for creatinine and urine staging."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from staytide.operators.windows import Trailing, trailing_agg
from staytide.plans import kidney as K

T0 = datetime(2024, 3, 10, 0, 0)  # a day with a clock change in New York
US = timedelta(microseconds=1)
STAYS = ("icustay_id long, subject_id long, hadm_id long, dbsource string, "
         "intime timestamp_ntz, outtime timestamp_ntz")
LABS = "subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, valuenum double"


def hours(n):
    return timedelta(hours=n)


def stay(stay_id=1, subject=1, intime=T0, outtime=T0 + timedelta(days=9), source="carevue"):
    return (stay_id, subject, 10 * subject, source, intime, outtime)


def lab(at, value, subject=1):
    return (subject, 10 * subject, 50912, at, value)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("slot", [None, timedelta(days=1), timedelta(hours=7), timedelta(days=400)])
def test_baseline_boundaries(table, slot):
    now = T0 + timedelta(days=5)
    values = {now - timedelta(days=7): 0.5, now - timedelta(days=7) - US: 0.1,
              now - hours(48): 0.9, now - hours(48) - US: 0.7, now: 2.0, now - US: 1.5}
    labs = table(LABS, *[lab(at, v) for at, v in values.items()])
    df = K.creatinine_baseline(table(STAYS, stay()), labs, slot=slot)
    got = {r["charttime"]: (r["creat_low_past_48hr"], r["creat_low_past_7day"]) for r in df.collect()}
    assert got[now] == (0.9, 0.5)
    assert got[now - US] == (0.7, 0.1)  # both lows exactly on its own borders
    assert got[now - timedelta(days=7)] == (0.1, 0.1)
    assert got[now - timedelta(days=7) - US] == (None, None)


def test_series_window_is_inclusive_and_keeps_stays(table):
    week = timedelta(days=7)
    labs = table(LABS, lab(T0 - week, 1.0), lab(T0 - week - US, 2.0), lab(T0 + week, 3.0), lab(T0 + week + US, 4.0))
    df = K.creatinine_series(table(STAYS, stay(), stay(2, 2)), labs)
    assert rows(df, "icustay_id", "creat") == [(1, 1.0), (1, 3.0), (2, None)]


def test_equal_instants(table):
    labs = table(LABS, lab(T0, 1.0), lab(T0, 1.0), lab(T0, 3.0), lab(T0 + hours(1), 1.2))
    stays = table(STAYS, stay())
    creat = K.staged_creatinine(stays, labs)
    assert rows(creat, "creat", "creat_low_past_48hr") == [(1.0, None), (1.2, 1.0), (3.0, None)]
    spread = K.stages_creatinine(creat, stays)
    assert rows(spread, "creat") == [(1.0,), (1.0,), (1.2,), (3.0,), (3.0,)]


def test_creatinine_ladder(table):
    cases = [(3.0, 2.0, 1.0, 3), (4.0, 3.7, 3.9, 3), (4.0, 3.8, 2.6, 3), (4.0, 3.8, 3.0, 0),
             (2.0, 1.9, 1.0, 2), (1.3, 1.0, 1.3, 1), (1.5, 1.4, 1.0, 1), (1.0, 1.0, 1.0, 0),
             (9.0, None, None, 0)]
    df = table("creat double, creat_low_past_48hr double, creat_low_past_7day double, want int", *cases)
    for r in K.stage_creatinine(df).collect():
        assert r["aki_stage_creat"] == r["want"], r


def test_stay_without_labs(table):
    """Its only time is unknown: stage NULL, flag 0."""
    stays = table(STAYS, stay())
    labs = table(LABS, lab(T0, 1.0, subject=5))
    series = K.stages_creatinine(K.staged_creatinine(stays, labs), stays)
    assert rows(series, "charttime", "creat", "aki_stage") == [(None, None, None)]
    worst = K.stage_7day_creatinine(K.StayTables(stays, labs)).collect()[0]
    assert (worst["aki_stage_7day"], worst["aki_7day"]) == (None, 0)


def test_worst_row_window_and_ties(table):
    schema = ("icustay_id long, dbsource string, intime timestamp_ntz, charttime timestamp_ntz, "
              "creat double, aki_stage_creat int")
    make = lambda at, creat, stage: (1, "x", T0, at, creat, stage)
    df = table(schema, make(T0 - hours(6), 9.0, 3), make(T0 + hours(48) + US, 9.0, 3),
               make(T0 + hours(2), 2.0, 2), make(T0 + hours(1), 2.0, 2), make(T0 + hours(48), 1.0, 2))
    got = K.worst_creatinine(df, {"short": K.HOURS_48, "long": K.DAYS_7, "none": -hours(7)}).first()
    assert (got["short"]["charttime"], got["short"]["creat"]) == (T0 + hours(1), 2.0)
    assert got["long"]["creat"] == 9.0 and got["none"] is None


def test_worst_urine_puts_null_rates_first(table):
    schema = ("icustay_id long, dbsource string, intime timestamp_ntz, charttime timestamp_ntz, "
              "uo_rt_6hr double, uo_rt_12hr double, uo_rt_24hr double, aki_stage_uo int")
    df = table(schema, (1, "x", T0, T0 + hours(7), 0.1, 0.2, 0.4, 2), (1, "x", T0, T0 + hours(8), 0.1, 0.2, None, 2),
               (1, "x", T0, T0 + hours(9), None, None, None, None))
    assert K.worst_urine(df, {"w": K.HOURS_48}).first()["w"]["charttime"] == T0 + hours(8)


OUTPUT = "icustay_id long, itemid int, charttime timestamp_ntz, value double"


def test_urine_output(table):
    df = table(OUTPUT, (1, 40055, T0, 100.0), (1, 227488, T0, 150.0), (1, 226559, T0, 20.0), (1, 40055, T0, 5000.0),
               (1, 40055, T0 + hours(1), 4999.0), (None, 40055, T0, 1.0), (1, 12345, T0, 1.0))
    assert rows(K.urine_output(df), "charttime", "value") == [(T0, -30.0), (T0 + hours(1), 4999.0)]


@pytest.mark.parametrize("slot", [None, timedelta(hours=1), timedelta(hours=24)])
def test_urine_trailing(table, slot):
    at = [0, 1, 5, 6, 12, 23, 24]
    urine = table("icustay_id long, charttime timestamp_ntz, value double", *[(1, T0 + hours(h), 10.0 + h) for h in at])
    got = {r["charttime"]: r for r in K.urine_trailing(urine, slot).collect()}
    for h in at:
        r = got[T0 + hours(h)]
        for name, span in K.URINE_HORIZONS.items():
            inside = [x for x in at if h - span <= x <= h]
            assert r[f"urineoutput_{name}"] == sum(10.0 + x for x in inside)
            assert r[f"uo_tm_{name}"] == h - min(inside)


def test_rates_and_urine_ladder(table):
    trailing = table(
        "icustay_id long, charttime timestamp_ntz, urineoutput_6hr double, urineoutput_12hr double, "
        "urineoutput_24hr double, uo_tm_6hr double, uo_tm_12hr double, uo_tm_24hr double",
        (1, T0 + hours(6), 1.0, 1.0, 1.0, 5.0, 11.0, 23.0),      # still in the first six hours
        (1, T0 + hours(7), 100.0, 100.0, 100.0, 5.0, 11.0, 23.0),  # 24 h rate 100/70/24 < 0.3
        (1, T0 + hours(8), 0.0, 0.0, 900.0, 5.0, 11.0, 23.0),    # nothing in 12 h
        (1, T0 + hours(9), -5.0, -5.0, 900.0, 5.0, 11.0, 23.0),  # negative is not zero
        (1, T0 + hours(10), 70.0, 900.0, 900.0, 2.0, 11.0, 23.0),  # 6 h rate 1/3
        (1, T0 + hours(11), 700.0, 900.0, 900.0, 2.0, 11.0, 23.0),
        (1, T0 + hours(30), 1.0, 1.0, 1.0, 5.0, 11.0, 23.0))     # no weight then
    weights = table("icustay_id long, starttime timestamp_ntz, endtime timestamp_ntz, weight double",
                    (1, T0, T0 + hours(30), 70.0), (1, T0 + hours(30), T0 + hours(30), 50.0))
    rates = K.urine_rates(trailing, weights)
    staged = K.stage_urine(rates, table(STAYS, stay()))
    got = [r["aki_stage_uo"] for r in staged.orderBy("charttime").collect()]
    assert got == [0, 3, 3, 2, 1, 0, None]
    assert rates.where("uo_tm_6hr = 2 and urineoutput_6hr = 70").first()["uo_rt_6hr"] == 0.3333


def test_zero_weight_gives_no_rate(table):
    trailing = table(
        "icustay_id long, charttime timestamp_ntz, urineoutput_6hr double, urineoutput_12hr double, "
        "urineoutput_24hr double, uo_tm_6hr double, uo_tm_12hr double, uo_tm_24hr double",
        (1, T0, 1.0, 1.0, 1.0, 5.0, 11.0, 23.0))
    weights = table("icustay_id long, starttime timestamp_ntz, endtime timestamp_ntz, weight double",
                    (1, T0, T0 + hours(1), 0.0))
    assert K.urine_rates(trailing, weights).first()["uo_rt_6hr"] is None


def test_stages_align(table):
    creat = table("icustay_id long, dbsource string, intime timestamp_ntz, charttime timestamp_ntz, creat double, aki_stage_creat int",
                  (1, "carevue", T0, T0, 1.0, 0), (1, "carevue", T0, T0, 3.0, 2), (2, "carevue", T0, None, None, 0), (3, "carevue", T0, None, None, 0))
    urine = table("icustay_id long, dbsource string, intime timestamp_ntz, charttime timestamp_ntz, weight double, "
                  "uo_rt_6hr double, uo_rt_12hr double, uo_rt_24hr double, aki_stage_uo int",
                  (1, "carevue", T0, T0, 70.0, 1.0, 1.0, 1.0, 1), (2, "carevue", T0, T0 + hours(1), 70.0, 1.0, 1.0, 1.0, 1),
                  (2, "carevue", T0, None, 70.0, None, None, None, None))
    got = rows(K.stages(creat, urine), "icustay_id", "charttime", "aki_stage")
    assert got == sorted([(1, T0, 1), (1, T0, 2), (2, None, None), (2, T0 + hours(1), 1), (3, None, None)], key=str)


def test_all_times_with_undated_urine(table):
    """One undated row per stay, whether urine is undated or labs are missing."""
    chart = table("subject_id long, hadm_id long, icustay_id long, itemid int, charttime timestamp_ntz, value string, "
                  "valuenum double, error int")
    notes = table("row_id long, subject_id long, hadm_id long, chartdate timestamp_ntz, category string, text string")
    tables = K.StayTables(table(STAYS, stay(), stay(2, 2), stay(3, 3)), table(LABS, lab(T0, 1.0)),
                          table(OUTPUT, (2, 40055, None, 5.0), (1, 40055, None, 5.0), (1, 40055, T0, 5.0), (9, 40055, None, 1.0)),
                          chart, notes)
    got = rows(K.stages_all_times(tables), "icustay_id", "charttime", "aki_stage")
    assert got == sorted([(1, T0, 0), (1, None, None), (2, None, None), (3, None, None)], key=str)


def test_trailing_windows_equal_brute_force_for_every_slot(table):
    """NULL keys are a key, undated rows have no window, equal instants see each other, repeated rows stay."""
    draw = random.Random(4)
    data = [(draw.choice([0, 1, None]), T0 + timedelta(minutes=draw.randint(0, 3000)), draw.choice([None, draw.randint(0, 99)])) for _ in range(300)]
    data += [data[0]] * 2 + [(0, None, 5)] * 3
    df = table("k int, t timestamp_ntz, v int", *data)
    outputs = {"low": Trailing("min", "v", timedelta(minutes=90)), "total": Trailing("sum", "v", timedelta(minutes=100), "left"),
               "top": Trailing("max", "v", timedelta(minutes=700), "left")}

    def want(k, t, fn, span, closed):
        inside = [v for j, u, v in data if t is not None and u is not None and j == k and v is not None
                  and t - span <= u and (u < t if closed == "left" else u <= t)]
        return fn(inside) if inside else None
    expected = Counter((k, t, v, want(k, t, min, timedelta(minutes=90), "both"), want(k, t, sum, timedelta(minutes=100), "left"),
                        want(k, t, max, timedelta(minutes=700), "left")) for k, t, v in data)
    for slot in (None, timedelta(minutes=13), timedelta(days=30)):
        assert Counter(map(tuple, trailing_agg(df, ["k"], "t", outputs, slot).collect())) == expected
    assert set(map(tuple, trailing_agg(df, ["k"], "t", outputs, distinct=True).collect())) == set(expected)
    assert len(trailing_agg(df, ["k"], "t", outputs, distinct=True).collect()) == len(expected)


def test_float_sums_do_not_depend_on_the_slots(table):
    draw = random.Random(5)
    df = table("k int, t timestamp_ntz, v double", *[(i % 2, T0 + timedelta(minutes=7 * i), draw.uniform(-1e6, 1e6)) for i in range(400)])
    sums = [Counter(map(tuple, trailing_agg(df, ["k"], "t", {"s": Trailing("sum", "v", hours(9))}, slot).collect()))
            for slot in (None, hours(1), timedelta(days=9))]
    assert sums[0] == sums[1] == sums[2]


def test_plans_are_made_without_a_job(spark, table):
    """Nothing is measured or written while a query is built."""
    chart = table("subject_id long, hadm_id long, icustay_id long, itemid int, charttime timestamp_ntz, value string, valuenum double, error int")
    notes = table("row_id long, subject_id long, hadm_id long, chartdate timestamp_ntz, category string, text string")
    tables = K.StayTables(table(STAYS, stay()), table(LABS, lab(T0, 1.0)), table(OUTPUT, (1, 40055, T0, 5.0)), chart, notes)
    spark.sparkContext.setJobGroup("built", "built")
    for build in (K.stage_7day, K.stage_48h, K.stages_all_times, K.stage_7day_creatinine):
        build(tables)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("built")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
