"""Diagnosis flags, admission facts, labels, labs, vital signs and encodings."""

from datetime import datetime, timedelta

import pytest

from staytide.functions import codes as C
from staytide.functions.columns import guarded_label, literal_map, null_outliers, round_half_up, to_celsius
from staytide.plans import cohort as P
from staytide.plans import features as X
from staytide.plans import measurements as M

T0 = datetime(2024, 1, 1)
DX = "subject_id long, hadm_id long, seq_num int, icd9_code string"


def test_comorbidities(table):
    dx = table(DX, (1, 1, 1, "4280"), (1, 2, 2, "25000"), (1, 2, 3, "25040"), (1, 2, None, "4280"), (1, 2, 4, None),
               (1, 3, 2, "40391"), (1, 3, 3, "V420"), (1, 4, 2, "4019"))
    got = {r["hadm_id"]: r for r in P.comorbidities(table("hadm_id long", *[(i,) for i in range(1, 5)]), dx).collect()}
    assert got[1]["congestive_heart_failure"] is None and got[1]["hypertension"] == 0
    assert (got[2]["diabetes_uncomplicated"], got[2]["diabetes_complicated"]) == (0, 1)
    assert got[2]["congestive_heart_failure"] == 0
    assert (got[3]["hypertension"], got[3]["renal_failure"]) == (1, 1)
    assert (got[4]["hypertension"], got[4]["renal_failure"]) == (1, 0)
    assert len(got[1]) == 14


def test_histories_match_whole_codes(table):
    rows = table("hadm_id long", (1,), (2,), (3,), (4,))
    dx = table(DX, (1, 1, 1, "5849"), (1, 2, 1, "5848"), (1, 3, 1, "5859"), (1, 4, 2, "5855"))
    flag = lambda df, c: [r[c] for r in df.orderBy("hadm_id").collect()]
    assert flag(P.has_prior_aki(rows, dx), "has_prior_aki") == [False, True, False, False]
    assert flag(P.has_ckd(rows, dx), "has_ckd") == [False, False, False, True]


@pytest.mark.parametrize("renal,prior,ckd,want", [(1, 1, 1, 4), (0, 1, 1, 3), (0, 0, 1, 2), (0, 0, 0, 1), (None, 0, 0, 1)])
def test_label_override(table, renal, prior, ckd, want):
    df = table("has_renal_failure boolean, has_prior_aki boolean, has_ckd boolean, aki_7day int",
               (None if renal is None else bool(renal), bool(prior), bool(ckd), 1))
    assert df.selectExpr(f"{P.COHORT_LABEL} as aki").first()["aki"] == want


def test_admission_info(table):
    admissions = table("subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, ethnicity string",
                       *[(i, i, T0, T0 + timedelta(hours=36), "WHITE") for i in range(1, 6)])
    births = {1: 1724, 2: 2030, 3: 2006, 4: 1934}
    patients = table("subject_id long, gender string, dob timestamp_ntz",
                     *[(i, "F", datetime(y, 6, 1)) for i, y in births.items()], (5, None, None))
    stays = table("subject_id long, hadm_id long, icustay_id long, dbsource string, intime timestamp_ntz, outtime timestamp_ntz",
                  *[(i, i, 10 * i, "x", T0 + timedelta(hours=1), T0 + timedelta(hours=3)) for i in range(1, 7)],
                  (1, 1, 11, "x", T0 + timedelta(hours=9), T0 + timedelta(hours=10)))
    got = {r["icustay_id"]: r for r in P.admission_info(admissions, patients, stays).collect()}
    assert [got[10 * i]["age"] for i in range(1, 7)] == [90, 90, 18, 90, None, None]
    a = got[10]
    assert (a["staytime"], a["time_go_icu"], a["time_in_icu"], a["time_after_go_icu"]) == (36.0, 1.0, 2.0, 35.0)
    assert (a["count_times_go_icu"], got[20]["count_times_go_icu"], got[60]["admittime"]) == (2, 1, None)


def test_egfr(table):
    df = table("creat double, age int, gender string, ethnicity string", (1.0, 1, "M", "WHITE"),
               (1.0, 1, "F", "BLACK/AFRICAN AMERICAN"), (1.0, 1, None, "BLACK/AFRICAN"), (None, 1, "F", None), (0.0, 1, "M", None))
    got = [r[0] for r in df.selectExpr(P.EGFR).collect()]
    assert got[:4] == [186.0, pytest.approx(186 * 0.742 * 1.21), 186.0, None] and got[4] == float("inf")


STAYS = "subject_id long, hadm_id long, icustay_id long, dbsource string, intime timestamp_ntz, outtime timestamp_ntz"


def test_lab_pivot(table):
    stays = table(STAYS, (1, 1, 1, "x", T0, T0), (2, 2, 2, "x", T0, T0))
    at = lambda hours: T0 + timedelta(hours=hours)
    labs = table("subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, valuenum double",
                 (1, 1, 50809, at(-6), 90.0), (1, 1, 50931, at(168), 120.0), (1, 1, 50931, at(169), 500.0),
                 (1, 1, 50862, at(0), 11.0), (1, 1, 50862, at(0), 0.0), (1, 9, 50809, at(0), 1.0))
    got = {r["icustay_id"]: r for r in M.lab_pivot(stays, labs).collect()}
    assert (got[1]["lab_glucose_min"], got[1]["lab_glucose_max"], got[1]["lab_albumin_max"]) == (90.0, 120.0, None)
    assert got[2]["lab_glucose_min"] is None and len(got[2]) == 4 + 38


def test_vitals(table):
    stays = table(STAYS, (1, 1, 1, "x", T0, T0), (2, 2, 2, "x", T0, T0), (3, 3, 3, "x", T0, T0))
    make = lambda stay, item, value, error=0: (stay, stay, stay, item, T0, value, error)
    chart = table("subject_id long, hadm_id long, icustay_id long, itemid int, charttime timestamp_ntz, valuenum double, error int",
                  make(1, 211, 0.0), make(1, 211, 300.0), make(1, 220045, 100.0), make(1, 211, 80.0, None), make(1, 211, 90.0, 1),
                  make(1, 678, 99.5), make(1, 676, 37.0), make(1, 678, 120.0), make(1, 646, 100.0), make(1, 646, 100.5),
                  make(2, 211, 999.0), make(3, 1, 5.0))
    got = {r["icustay_id"]: r for r in M.vitals_pivot(stays, chart).collect()}
    a = got[1]
    assert (a["vital_heartrate_min"], a["vital_heartrate_max"], a["vital_heartrate_mean"]) == (80.0, 100.0, 90.0)
    assert (a["vital_tempc_min"], a["vital_tempc_max"], a["vital_spo2_max"]) == (37.0, 37.5, 100.0)
    assert set(got) == {1, 2} and got[2]["vital_heartrate_min"] is None and len(a) == 4 + 24


def test_column_rules(table):
    df = table("code int, v double", (50862, 10.0), (50862, 10.5), (51144, -1.0), (223761, 212.0), (807, 1e9), (646, 100.0))
    got = df.selectExpr(null_outliers("code", "v", C.lab_item_limits()), guarded_label("code", "v", C.VITALS),
                        to_celsius("code", "v", C.FAHRENHEIT_ITEMS)).collect()
    assert [tuple(r) for r in got] == [(10.0, None, 10.0), (None, None, 10.5), (-1.0, None, -1.0), (212.0, None, 100.0),
                                       (1e9, "glucose", 1e9), (100.0, "spo2", 100.0)]
    numbers = table("x double", (0.00005,), (-0.00005,), (2.00015,), (1e300,), (float("inf"),), (None,))
    assert [r[0] for r in numbers.selectExpr(round_half_up("x")).collect()] == [0.0001, -0.0001, 2.0002, 1e300, float("inf"), None]


def test_encodings_and_exclusions(table):
    df = table("ethnicity string, gender string, dbsource string, aki int, age int",
               ("WHITE - RUSSIAN", "F", "carevue", 1, 18), ("ASIAN - THAI", None, "metavision", None, None),
               ("PLUTO", "M", "paper", 0, 50), (None, "m", None, 0, 90), ("WHITE", "F", "both", 0, 50),
               ("WHITE", "F", "carevue", 3, 50), ("WHITE", "F", "carevue", 0, 17))
    kept = X.encode_categories(X.cohort_exclusions(df))
    assert [tuple(r)[:3] for r in kept.collect()] == [(0, 0, 0), (2, 1, 1), (0, 1, None), (0, 1, None)]
    groups = {code: name for name, code in C.SOURCE_CODES.items()}
    assert df.selectExpr(literal_map("dbsource", {k: [v] for k, v in groups.items()}, None) + " as c").collect()[0]["c"] == 0


def test_fill_and_finite(table):
    df = table("id int, a double, b double, s int", (1, 1.0, None, 0), (2, float("nan"), 2.0, 1), (3, float("inf"), 1.0, 0),
               (4, -float("inf"), 1.0, 0), (5, 1.0, 1.0, None))
    filled = X.fill_zero(df, ["s"])
    assert [tuple(r) for r in filled.where("id < 3").orderBy("id").collect()] == [(1, 1.0, 0.0, 0), (2, 0.0, 2.0, 1)]
    assert [r["id"] for r in X.drop_non_finite(filled).orderBy("id").collect()] == [1, 2]


def test_feature_lists():
    creat, urine = C.feature_columns("creatinine"), C.feature_columns("urine")
    assert (len(creat), len(urine)) == (79, 82)
    assert len(set(urine)) == 82 and set(urine) - set(creat) == {"uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr"}
