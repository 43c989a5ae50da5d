"""Admission facts, diagnosis flags and the wide row per stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.columns import hours_between, ladder, one_of, prefix_flag
from ..operators.aggregates import rollup_flags
from ..operators.joins import has_code
from ..operators.windows import first_per
from .kidney import StayTables, stage_7day, stage_7day_creatinine
from .measurements import lab_pivot, vitals_pivot


def admission_info(admissions: DataFrame, patients: DataFrame, icustays: DataFrame) -> DataFrame:
    """One row per stay: lengths in hours, age by calendar year, stays per admission."""
    adm = admissions.select("subject_id", "hadm_id", "admittime", "dischtime", "ethnicity")
    adm = adm.join(patients.select("subject_id", "gender", "dob"), "subject_id", "left").drop(
        "subject_id")
    stay_columns = ["subject_id", "hadm_id", "icustay_id", "intime", "outtime"]
    stays = icustays.select(*stay_columns, *[c for c in ["los"] if c in icustays.columns])
    returns = stays.where("hadm_id is not null").groupBy("hadm_id").agg(
        F.count("icustay_id").alias("count_times_go_icu"))
    years = "year(admittime) - year(dob)"
    return stays.join(adm, "hadm_id", "left").join(returns, "hadm_id", "left").selectExpr(
        "*", f"if({years} > 89 or {years} < 0, 90, {years}) as age",
        f"{hours_between('dischtime', 'admittime')} as staytime",
        f"{hours_between('intime', 'admittime')} as time_go_icu",
        f"{hours_between('outtime', 'intime')} as time_in_icu",
        f"{hours_between('dischtime', 'intime')} as time_after_go_icu")


def first_stay_row(info: DataFrame) -> DataFrame:
    return first_per(info, ["icustay_id"], [f"{c} asc nulls last" for c in
                                            ("subject_id", "hadm_id", "icustay_id")])


# --- diagnoses ----------------------------------------------------------------------

def icd_flags(diagnoses: DataFrame) -> DataFrame:
    """17 comorbidity flags per secondary diagnosis."""
    flags = [f"{prefix_flag('icd9_code', *lists)} as {flag}"
             for flag, lists in C.COMORBIDITY_CODES.items()]
    return diagnoses.where("seq_num <> 1").selectExpr("hadm_id", "seq_num", "icd9_code", *flags)


def comorbidity_flags(diagnoses: DataFrame) -> DataFrame:
    return rollup_flags(icd_flags(diagnoses), ["hadm_id"], list(C.COMORBIDITY_CODES))


def comorbidities(admissions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """13 conditions per admission. Without secondary diagnoses the two derived
    conditions are 0 and the other 11 NULL."""
    flags = admissions.select("hadm_id").join(comorbidity_flags(diagnoses), "hadm_id", "left")
    return flags.selectExpr(
        "hadm_id", *[f"{flag} as {name}" for name, flag in C.COMORBIDITY_OUTPUTS.items()],
        "if(htn = 1 or htncx = 1, 1, 0) as hypertension",
        f"{ladder([('dmcx = 1', '0'), ('dm = 1', '1')], '0')} as diabetes_uncomplicated")


def has_prior_aki(rows: DataFrame, diagnoses: DataFrame) -> DataFrame:
    return has_code(rows, diagnoses, "hadm_id", "icd9_code", C.PRIOR_AKI_CODES, "has_prior_aki")


def has_ckd(rows: DataFrame, diagnoses: DataFrame) -> DataFrame:
    return has_code(rows, diagnoses, "hadm_id", "icd9_code", C.CKD_CODES, "has_ckd")


def has_renal_failure(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    return has_code(rows, conditions, "hadm_id", "renal_failure", [1], "has_renal_failure")


# --- rules on the wide row --------------------------------------------------------------

# Estimated filtration rate from creatinine, age, gender and ethnicity.
EGFR = (f"{C.EGFR_FACTOR}D * pow(creat, {C.EGFR_CREAT_POWER}D) * pow(age, {C.EGFR_AGE_POWER}D)"
        f" * if(gender = 'F', {C.EGFR_FEMALE}D, 1D)"
        f" * if(ethnicity = '{C.EGFR_BLACK_GROUP}', {C.EGFR_BLACK}D, 1D)")
# Stage flag, replaced by 4 for renal failure, else 3 for an earlier kidney
# injury, else 2 for chronic kidney disease.
COHORT_LABEL = ladder([("has_renal_failure", "4"), ("has_prior_aki", "3"), ("has_ckd", "2")], "aki_7day")


def cohort_base(info: DataFrame, stage: DataFrame) -> DataFrame:
    """Admission facts of the stays that have a stage."""
    staged = stage.where("aki_stage_7day is not null")
    return first_stay_row(info).join(staged, "icustay_id")


def labelled(base: DataFrame, diagnoses: DataFrame, conditions: DataFrame) -> DataFrame:
    """Adds kidney function, the three history flags and the final label.

    The three histories are joined as one row per admission.
    """
    history = diagnoses.groupBy("hadm_id").agg(
        F.expr(f"max({one_of('icd9_code', C.PRIOR_AKI_CODES)}) as prior_aki"),
        F.expr(f"max({one_of('icd9_code', C.CKD_CODES)}) as ckd"))
    rows = base.join(history, "hadm_id", "left").join(conditions, "hadm_id", "left")
    kept = [c for c in rows.columns if c not in ("prior_aki", "ckd")]
    flagged = rows.selectExpr(*kept, "coalesce(prior_aki, false) as has_prior_aki",
                              "coalesce(ckd, false) as has_ckd",
                              "coalesce(renal_failure = 1, false) as has_renal_failure")
    return flagged.selectExpr("*", f"{COHORT_LABEL} as aki", f"{EGFR} as egfr")


def exclusion_tallies(rows: DataFrame) -> DataFrame:
    """Stays with each exclusion, split by the stage flag.

    Counted on the flag before it is overwritten, so that "as aki" tallies
    can differ from zero.
    """
    columns = ["count_if(aki_7day = 1) as aki", "count_if(aki_7day = 0) as normal"]
    for out in ("ckd", "prior_aki", "renal_failure"):
        columns += [f"count_if(has_{out} and aki_7day = 1) as {out}_as_aki",
                    f"count_if(has_{out} and aki_7day = 0) as {out}_as_normal"]
    return rows.agg(*map(F.expr, columns))


def labelled_cohort(t: StayTables, variant: str = "urine") -> DataFrame:
    """Label, stage, kidney function, admission facts and conditions of each
    stay with a stage."""
    stage = stage_7day(t) if variant == "urine" else stage_7day_creatinine(t)
    info = admission_info(t.admissions, t.patients, t.icustays)
    conditions = comorbidities(t.admissions, t.diagnoses_icd)
    return labelled(cohort_base(info, stage), t.diagnoses_icd, conditions)


def cohort_wide(t: StayTables, variant: str = "urine") -> DataFrame:
    """The full wide row per stay. Lab and vital glucose keep their prefix."""
    keys = ["subject_id", "hadm_id", "dbsource"]
    rows = labelled_cohort(t, variant)
    for wide in (lab_pivot(t.icustays, t.labevents), vitals_pivot(t.icustays, t.chartevents)):
        rows = rows.join(wide.drop(*keys), "icustay_id", "left")
    return rows
