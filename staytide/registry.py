"""Named queries over a data directory, each with its equivalent SQL.

Every query reads whole tables. Doubles that come from averages or powers are
rounded here, on both sides, so that the last bit does not decide equality.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import check_sql as S
from .functions import codes as C
from .functions.columns import (code_label, guarded_label, in_window, literal_map, not_flagged,
                                null_outliers, round_half_up, to_celsius)
from .operators import aggregates as A
from .operators import intervals as I
from .operators import metrics as E
from .operators import neighbours as N
from .operators import ordering as O
from .operators import scaling as L
from .operators.aggregates import count_distinct, stage_summary
from .operators.joins import interval_join, time_spine, without
from .plans import cohort as P
from .plans import features as X
from .plans import kidney as K
from .plans import measurements as M
from .plans import scenarios as Z
from .plans import weights as W
from .sources.fixtures import stay_tables
from .sources.tables import MALFORMED, SCHEMAS, checkpoint_folder, checkpointed, load, write_result

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = S.sql_for(sql)
        return fn
    return register


def on_stays(name: str, sql: str | None = None) -> Callable:
    """Registers a function of the derived stay tables."""
    def register(fn: Callable[[K.StayTables], DataFrame]) -> Callable:
        query(name, sql)(lambda spark, sf_dir: fn(stay_tables(spark, sf_dir)))
        return fn
    return register


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.selectExpr(*[f"{round_half_up(c, digits)} as {c}" if c in columns else c
                           for c in df.columns])


def rounded_sql(source: str, columns: list[str], digits: int = 4) -> str:
    return f"select * replace ({', '.join(f'{S.r(c, digits)} as {c}' for c in columns)}) from {source}"


# --- scans -------------------------------------------------------------------------

on_stays("scan_icustays", "select * from icustays")(lambda t: t.icustays)
on_stays("scan_admissions", "select * from admissions")(lambda t: t.admissions)
on_stays("scan_patients",
         "select subject_id, gender, cast(dob as timestamp) as dob from patients")(lambda t: t.patients)
on_stays("scan_diagnoses", "select * from diagnoses_icd")(lambda t: t.diagnoses_icd)
on_stays("count_episodes", "select count(*) as n from icustays")(
    lambda t: t.icustays.agg(F.count(F.lit(1)).alias("n")))


def _stay_files(t: K.StayTables) -> str:
    """Folder with the stays as a CSV table in its full layout; every seventh has a length that is no number."""
    columns = {"row_id": "icustay_id", "los": "if(icustay_id % 7 = 0, 'n/a', cast(icustay_id % 30 / 4 as string))"}
    known = t.icustays.columns
    full = t.icustays.selectExpr(*[f"{columns.get(c, c if c in known else 'cast(null as string)')} as {c}" for c in SCHEMAS["icustays"].fieldNames()])
    folder = f"{checkpoint_folder(t.icustays.sparkSession)}/{uuid.uuid4()}"
    write_result(full, f"{folder}/ICUSTAYS.csv", "csv")
    return folder


@on_stays("scan_csv_malformed", """
select subject_id::int as subject_id, hadm_id::int as hadm_id, icustay_id::int as icustay_id, dbsource, intime, outtime,
       if(icustay_id % 7 = 0, null, icustay_id % 30 / 4) as los, icustay_id % 7 = 0 as malformed from icustays""")
def _(t):
    return load(t.icustays.sparkSession, _stay_files(t), "icustays", bad="keep").withColumn(MALFORMED, F.col(MALFORMED).isNotNull())


@on_stays("count_csv_malformed", """
select count(*) as n, count(*) filter (where icustay_id % 7 = 0) as malformed from icustays""")
def _(t):
    rows = load(t.icustays.sparkSession, _stay_files(t), "icustays", bad="keep")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(MALFORMED).alias(MALFORMED))


# --- predicates and labels -----------------------------------------------------------

@on_stays("chart_not_flagged", "select * from chartevents where error is distinct from 1")
def _(t):
    return t.chartevents.where(not_flagged("error"))


@on_stays("lab_in_window", """
select s.icustay_id, x.itemid, x.charttime, x.valuenum from icustays s join labevents x
 on x.subject_id = s.subject_id and x.hadm_id = s.hadm_id
where x.charttime between s.intime - interval 6 hour and s.intime + interval 7 day""")
def _(t):
    joined = t.icustays.join(t.labevents, ["subject_id", "hadm_id"])
    return joined.where(in_window("charttime", "intime", M.BEFORE, M.AFTER)).select(
        "icustay_id", "itemid", "charttime", "valuenum")


@on_stays("lab_null_outliers", f"""
select subject_id, hadm_id, itemid, charttime, {S._LAB_LABEL} as label, {S._LAB_VALUE} as valuenum
from labevents""")
def _(t):
    return t.labevents.selectExpr(
        "subject_id", "hadm_id", "itemid", "charttime",
        f"{code_label('itemid', C.lab_item_labels())} as label",
        f"{null_outliers('itemid', 'valuenum', C.lab_item_limits())} as valuenum")


@on_stays("vitals_label", f"""
select icustay_id, itemid, charttime, valuenum, {S._vital_case()} as vital from chartevents""")
def _(t):
    return t.chartevents.selectExpr("icustay_id", "itemid", "charttime", "valuenum",
                                    f"{guarded_label('itemid', 'valuenum', C.VITALS)} as vital")


@on_stays("vitals_to_celsius", f"""
select icustay_id, itemid, charttime, {S.r(S._CELSIUS, 6)} as value_c from chartevents""")
def _(t):
    value = round_half_up(to_celsius("itemid", "valuenum", C.FAHRENHEIT_ITEMS), 6)
    return t.chartevents.selectExpr("icustay_id", "itemid", "charttime", f"{value} as value_c")


for _name, _column, _groups, _unlisted in (
        ("encode_ethnicity", "ethnicity", C.ETHNICITY_GROUPS, C.ETHNICITY_UNLISTED),
        ("encode_source", "dbsource", {v: [k] for k, v in C.SOURCE_CODES.items()}, None)):
    _whens = " ".join(f"when {_column} in {S._in(names)} then {code}" for code, names in _groups.items())
    _table, _key = ("admissions", "hadm_id") if _column == "ethnicity" else ("icustays", "icustay_id")

    def _encode(t, table=_table, key=_key, column=_column, groups=_groups, unlisted=_unlisted):
        return getattr(t, table).selectExpr(
            key, column, f"{literal_map(column, groups, unlisted)} as code")

    on_stays(_name, f"select {_key}, {_column}, case {_whens} else {'null' if _unlisted is None else _unlisted} "
                    f"end as code from {_table}")(_encode)


@on_stays("encode_gender", "select subject_id, gender, if(gender = 'F', 0, 1) as code from patients")
def _(t):
    return t.patients.select("subject_id", "gender",
                             F.when(F.col("gender") == "F", 0).otherwise(1).alias("code"))


# --- creatinine --------------------------------------------------------------------

on_stays("attach_creatinine", "select * from creat_series")(
    lambda t: K.creatinine_series(t.icustays, t.labevents))
on_stays("creatinine_baseline", "select * from creat_lows")(
    lambda t: K.creatinine_baseline(t.icustays, t.labevents))
on_stays("creatinine_baseline_split", "select * from creat_lows")(
    lambda t: K.creatinine_baseline(t.icustays, t.labevents, slot=timedelta(days=1)))
on_stays("stage_creatinine", "select * from creat_stage")(
    lambda t: K.staged_creatinine(t.icustays, t.labevents, "left"))
on_stays("stages_creatinine", "select * from stage_series_creat")(
    lambda t: K.stages_creatinine(K.staged_creatinine(t.icustays, t.labevents), t.icustays))
on_stays("stage_7day_creatinine", "select * from worst7c")(K.stage_7day_creatinine)


@on_stays("worst_creatinine", "select icustay_id, dbsource, charttime, creat, aki_stage_creat from icustays join "
          + S._worst("stage_series", "aki_stage_creat", ["creat"], "7 day") + " w using (icustay_id)")
def _(t):
    worst = K.worst_creatinine(K.staged_creatinine(t.icustays, t.labevents), {"found": K.DAYS_7}).where("found is not null")
    return t.icustays.select("icustay_id", "dbsource").join(worst, "icustay_id").select("icustay_id", "dbsource", "found.*")


# --- weights -----------------------------------------------------------------------

def _starts(t: K.StayTables) -> DataFrame:
    return W.weight_starts(W.weight_points(t.chartevents), t.icustays)


def _durations(t: K.StayTables) -> DataFrame:
    return W.weight_durations(t.chartevents, t.noteevents, t.icustays)


on_stays("weight_neonate", "select * from weight_newborn")(lambda t: W.neonate_weight(t.chartevents))
on_stays("weight_birth", "select * from weight_at_birth")(lambda t: W.birth_weight(t.chartevents))
on_stays("weight_points", "select * from weight_stack")(lambda t: W.weight_points(t.chartevents))
on_stays("weight_starts", "select * from weight_begin")(_starts)
on_stays("weight_intervals", "select * from weight_until")(lambda t: W.weight_intervals(_starts(t)))
on_stays("weight_backfill", "select * from weight_charted")(
    lambda t: W.charted_intervals(t.chartevents, t.icustays).distinct())
on_stays("weight_durations", "select * from weight_spans")(_durations)
on_stays("weight_durations_split", "select * from weight_spans")(lambda t: I.fallback_intervals(
    W.charted_intervals(t.chartevents, t.icustays), W.echo_intervals(W.echo_to_stay(t.noteevents, t.icustays)),
    "icustay_id", "starttime", days=1))
on_stays("echo_to_stay", rounded_sql("echo_weight", ["weight"], 6))(
    lambda t: rounded(W.echo_to_stay(t.noteevents, t.icustays), ["weight"], 6))
on_stays("echo_only_stays", """
select distinct icustay_id from echo_span where icustay_id not in (select icustay_id from weight_charted)""")(
    lambda t: without(W.echo_to_stay(t.noteevents, t.icustays).select("icustay_id").distinct(),
                      _starts(t), "icustay_id"))


# --- urine -------------------------------------------------------------------------

_VOLUMES = [f"urineoutput_{h}" for h in K.URINE_HORIZONS]


def _urine_series(t: K.StayTables) -> DataFrame:
    return K.staged_series(t)[1]


def _trailing_urine(t: K.StayTables, slot: timedelta | None = None) -> DataFrame:
    return K.urine_trailing(K.urine_output(t.outputevents), slot)


on_stays("urine_output", rounded_sql("urine", ["value"]))(
    lambda t: rounded(K.urine_output(t.outputevents), ["value"]))
on_stays("urine_trailing", rounded_sql("urine_windows", _VOLUMES))(
    lambda t: rounded(_trailing_urine(t), _VOLUMES))
on_stays("urine_trailing_split", rounded_sql("urine_windows", _VOLUMES))(
    lambda t: rounded(_trailing_urine(t, timedelta(hours=5)), _VOLUMES))
_WEIGHT_AT = """
select u.icustay_id, u.charttime, d.weight from urine u left join weight_spans d
 on d.icustay_id = u.icustay_id and u.charttime >= d.starttime and u.charttime < d.endtime"""
for _name, _base in (("weight_at_time", 16), ("weight_at_time_slotted", 2)):
    on_stays(_name, _WEIGHT_AT)(lambda t, base=_base: interval_join(
        K.urine_output(t.outputevents).drop("value"), _durations(t), ["icustay_id"], "charttime",
        "starttime", "endtime", base).drop("starttime", "endtime"))
on_stays("urine_rates", rounded_sql("urine_rate", _VOLUMES))(
    lambda t: rounded(K.urine_rates(_trailing_urine(t), _durations(t)), _VOLUMES))
on_stays("stage_urine", "select * from urine_stage")(_urine_series)


@on_stays("worst_urine", "select icustay_id, dbsource, charttime, uo_rt_6hr, uo_rt_12hr, uo_rt_24hr, aki_stage_uo from icustays join "
          + S._worst("stage_series", "aki_stage_uo", ["uo_rt_24hr", "uo_rt_12hr", "uo_rt_6hr"], "7 day") + " w using (icustay_id)")
def _(t):
    worst = K.worst_urine(_urine_series(t), {"found": K.DAYS_7}).where("found is not null")
    return t.icustays.select("icustay_id", "dbsource").join(worst, "icustay_id").select("icustay_id", "dbsource", "found.*")


# --- combined stages ---------------------------------------------------------------

on_stays("stages_all_times", "select * from stage_series")(K.stages_all_times)
on_stays("stage_48h", "select * from worst48")(K.stage_48h)
on_stays("stage_7day", "select * from worst7")(lambda t: K.stage_7day(t))
on_stays("stage_7day_split", "select * from worst7")(lambda t: K.worst_stage(
    t.icustays, K.stage_creatinine(K.creatinine_baseline(t.icustays, t.labevents, "inner", timedelta(days=2))),
    K.stage_urine(K.urine_rates(_trailing_urine(t, timedelta(hours=7)), _durations(t)), t.icustays), {"7day": K.DAYS_7}))
_BOTH = [f"{c}_{h}" for c in ("charttime_creat", "creat", "aki_stage_creat", "charttime_uo", *K._RATES, "aki_stage_uo") for h in ("48hr", "7day")]
on_stays("stage_horizons", "select icustay_id, a.dbsource, "
         + ", ".join(f"{'a' if c.endswith('48hr') else 'b'}.{c.rpartition('_')[0]} as {c}" for c in _BOTH)
         + ", aki_stage_48hr, aki_48hr, aki_stage_7day, aki_7day from worst48 a join worst7 b using (icustay_id)")(K.stage_horizons)
on_stays("stage_dropna", "select * from worst7 where aki_stage_7day is not null")(
    lambda t: K.stage_7day(t).na.drop(subset=["aki_stage_7day"]))
on_stays("ordered_stages", "select * from worst7c order by icustay_id")(
    lambda t: K.stage_7day_creatinine(t).orderBy("icustay_id"))


@on_stays("stage_spine", "select * from spine")
def _(t):
    creat = K.staged_creatinine(t.icustays, t.labevents, "left")
    return time_spine(creat, _urine_series(t), keys=["icustay_id"], ts="charttime")


_SUMMARY = ", ".join(f"count(*) filter (where aki_stage_7day = {s}) as stage_{s}" for s in range(4))
on_stays("stage_summary", f"""
select count(distinct icustay_id) as episodes, {_SUMMARY},
       count(*) filter (where aki_stage_7day is null) as missing from worst7c""")(
    lambda t: stage_summary(K.stage_7day_creatinine(t), "aki_stage_7day"))


# --- labs and vitals ---------------------------------------------------------------

_VITAL_COLUMNS = [f"vital_{v}_{s}" for v in C.VITALS for s in ("min", "max", "mean")]
on_stays("attach_labs", "select * from stay_labs")(lambda t: M.attach_labs(t.icustays, t.labevents))
on_stays("attach_vitals", "select * from stay_vitals")(
    lambda t: M.attach_vitals(t.icustays, t.chartevents))
on_stays("lab_pivot", "select * from lab_wide")(lambda t: M.lab_pivot(t.icustays, t.labevents))
# Two uses of one stored table.
_stored_labs = lambda t: M.store_labs(t.labevents, "labs_by_admission_and_slot")
on_stays("attach_labs_bucketed", "select * from stay_labs")(lambda t: M.attach_labs(t.icustays, _stored_labs(t), stored=True))
on_stays("lab_pivot_bucketed", "select * from lab_wide")(lambda t: M.lab_pivot(t.icustays, _stored_labs(t), stored=True))
on_stays("vitals_pivot", "select * from vital_wide")(
    lambda t: rounded(M.vitals_pivot(t.icustays, t.chartevents), _VITAL_COLUMNS, 6))

# --- notes -------------------------------------------------------------------------

on_stays("note_fields", "select * from note_values")(lambda t: W.note_fields(t.noteevents))
on_stays("note_time", "select row_id, chartdate, charttime from note_values")(
    lambda t: W.note_fields(t.noteevents).select("row_id", "chartdate", "charttime"))
_NUMBERS = list(C.NOTE_NUMBER_FIELDS)
on_stays("note_vitals", f"select row_id, {', '.join(_NUMBERS)} from note_values")(
    lambda t: W.note_fields(t.noteevents).select("row_id", *_NUMBERS))

# --- diagnoses ---------------------------------------------------------------------

on_stays("icd_flags", "select * from dx_flags")(lambda t: P.icd_flags(t.diagnoses_icd))
on_stays("comorbidity_flags", "select * from dx_admission")(
    lambda t: P.comorbidity_flags(t.diagnoses_icd))
on_stays("comorbidities", "select * from conditions")(
    lambda t: P.comorbidities(t.admissions, t.diagnoses_icd))


def _has(column: str, subquery: str) -> str:
    return (f"select icustay_id, hadm_id, hadm_id in ({subquery}) as {column} from icustays")


def _ids(t: K.StayTables) -> DataFrame:
    return t.icustays.select("icustay_id", "hadm_id")


_DX = "select hadm_id from diagnoses_icd where icd9_code in "
on_stays("has_prior_aki", _has("has_prior_aki", _DX + S._in(C.PRIOR_AKI_CODES)))(
    lambda t: P.has_prior_aki(_ids(t), t.diagnoses_icd))
on_stays("has_ckd", _has("has_ckd", _DX + S._in(C.CKD_CODES)))(
    lambda t: P.has_ckd(_ids(t), t.diagnoses_icd))
on_stays("has_renal_failure",
         _has("has_renal_failure", "select hadm_id from conditions where renal_failure = 1"))(
    lambda t: P.has_renal_failure(_ids(t), P.comorbidities(t.admissions, t.diagnoses_icd)))

# --- cohort ------------------------------------------------------------------------


def _info(t: K.StayTables) -> DataFrame:
    return P.admission_info(t.admissions, t.patients, t.icustays)


on_stays("admission_info", "select * from stay_info")(_info)
on_stays("first_stay_row", """
select * from stay_info qualify row_number() over (partition by icustay_id order by subject_id, hadm_id) = 1""")(
    lambda t: P.first_stay_row(_info(t)))
on_stays("max_icu_returns", "select max(count_times_go_icu) as n from stay_info")(
    lambda t: _info(t).agg(F.max("count_times_go_icu").alias("n")))
on_stays("cohort_base", "select * from base_creat")(
    lambda t: P.cohort_base(_info(t), K.stage_7day_creatinine(t)))
on_stays("egfr", f"select icustay_id, {S.r('egfr', 6)} as egfr from labelled_creat")(
    lambda t: rounded(P.labelled_cohort(t, "creatinine").select("icustay_id", "egfr"), ["egfr"], 6))
_HISTORY = ["icustay_id", "aki_7day", "has_ckd", "has_prior_aki", "has_renal_failure", "aki"]
on_stays("cohort_label", f"select {', '.join(_HISTORY)} from labelled_urine")(
    lambda t: P.labelled_cohort(t).select(*_HISTORY))
on_stays("stays_per_label", "select aki, count(distinct icustay_id) as n_distinct from labelled_urine group by aki")(
    lambda t: count_distinct(P.labelled_cohort(t), "icustay_id", ["aki"]))
_TALLY = ", ".join(
    f"count(*) filter (where {flag} and aki_7day = {v}) as {out}_as_{name}"
    for out, flag in (("ckd", "has_ckd"), ("prior_aki", "has_prior_aki"), ("renal_failure", "has_renal_failure"))
    for v, name in ((1, "aki"), (0, "normal")))
on_stays("exclusion_tallies", f"""
select count(*) filter (where aki_7day = 1) as aki, count(*) filter (where aki_7day = 0) as normal, {_TALLY}
from labelled_urine""")(lambda t: P.exclusion_tallies(P.labelled_cohort(t)))
on_stays("cohort_wide", rounded_sql("wide_urine", ["egfr"], 6))(
    lambda t: rounded(P.cohort_wide(t), ["egfr", *_VITAL_COLUMNS], 6))
on_stays("cohort_wide_creatinine", rounded_sql("wide_creat", ["egfr"], 6))(
    lambda t: rounded(P.cohort_wide(t, "creatinine"), ["egfr", *_VITAL_COLUMNS], 6))


# --- features ----------------------------------------------------------------------

def _wide(t: K.StayTables, variant: str) -> DataFrame:
    return rounded(P.cohort_wide(t, variant), ["egfr", *_VITAL_COLUMNS], 6)


def _features(t: K.StayTables, variant: str, keep: list[str] | None = None) -> DataFrame:
    return X.feature_matrix(X.clean_cohort(_wide(t, variant)), variant, keep)


on_stays("cohort_exclusions", "select * from kept_creat")(
    lambda t: X.cohort_exclusions(_wide(t, "creatinine")))
on_stays("features_fill_zero", "select * from filled_creat")(
    lambda t: X.fill_zero(X.encode_categories(X.cohort_exclusions(_wide(t, "creatinine"))),
                          ["dbsource"]).select(
        "icustay_id", *C.LABEL_COLUMNS, *S.RAW_FEATURES["creat"], "dbsource"))
for _v, _variant in (("creat", "creatinine"), ("urine", "urine")):
    on_stays(f"feature_matrix_{_v}", f"select * exclude (icustay_id) from features_{_v}")(
        lambda t, variant=_variant: _features(t, variant))
on_stays("features_finite", "select icustay_id, egfr, creat, dbsource from features_creat")(
    lambda t: _features(t, "creatinine", ["icustay_id"]).select("icustay_id", "egfr", "creat", "dbsource"))
on_stays("clean_cohort", "select * from features_urine")(
    lambda t: _features(t, "urine", ["icustay_id"]))


# --- splits, scaling, evaluation ------------------------------------------------------

def reads(table: str) -> Callable:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet")


_labels, _events, _embeddings = reads("labels"), reads("events"), reads("embeddings")
_ORDER = "row_number() over (order by md5('{seed}:' || {key}), {key})"


@query("split_exact", f"""
select doc_id, quality, toxic, pos <= round_even(n * 0.2, 0) as is_test
from (select *, {_ORDER.format(seed=1234, key='doc_id')} as pos, count(*) over () as n from labels) z""")
def _(spark, sf_dir):
    return O.split_exact(_labels(spark, sf_dir), "doc_id", 0.2, 1234)


@query("folds", f"""
select doc_id, cast({_ORDER.format(seed=1234, key='doc_id')} % 5 as int) as fold from labels""")
def _(spark, sf_dir):
    return O.assign_folds(_labels(spark, sf_dir).select("doc_id"), "doc_id", 5, 1234)


@query("size_ladder", f"""
select test_fraction, cast(round_even(n * test_fraction, 0) as bigint) as n_test,
       n - cast(round_even(n * test_fraction, 0) as bigint) as n_train
from (select count(*) as n from events) z,
     (select cast(unnest({Z.TEST_SIZES}) as double) as test_fraction) f""")
def _(spark, sf_dir):
    return O.size_ladder(_events(spark, sf_dir).select("event_id"), "event_id", Z.TEST_SIZES, 1234)


def _transfer_sets(t: K.StayTables) -> DataFrame:
    code = literal_map("ethnicity", C.ETHNICITY_GROUPS, C.ETHNICITY_UNLISTED)
    stays = t.icustays.select("icustay_id", "hadm_id").join(t.admissions, "hadm_id").selectExpr(
        "icustay_id", f"{code} as ethnicity")
    sets = Z.transfer_sets(stays, "ethnicity", 0, {"group 1": 1, "group 3": 3, "not group 0": None})
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
            for name, df in sets.items()]
    return reduce(DataFrame.unionByName, rows)


on_stays("transfer_sets", """
select 'train' as part, n - t as n from grp where g = 0 union all
select 'test', t from grp where g = 0 union all select 'group 1', t from grp where g = 1 union all
select 'group 3', t from grp where g = 3 union all select 'not group 0', sum(n)::bigint from grp where g <> 0""")(
    _transfer_sets)


@query("standardize", f"""
select event_id, {S.r('(value - m) / if(s = 0, 1, s)', 6)} as value
from events, (select avg(value) as m, stddev_pop(value) as s from events) z""")
def _(spark, sf_dir):
    df = _events(spark, sf_dir).select("event_id", "value")
    return rounded(L.apply_scaler(df, L.fit_scaler(df, ["value"]), ["value"]), ["value"], 6)


@query("standardize_by_group", f"""
select event_id, event_type,
       {S.r('(value - avg(value) over w) / if(stddev_pop(value) over w = 0, 1, stddev_pop(value) over w)', 6)} as value
from events window w as (partition by event_type)""")
def _(spark, sf_dir):
    df = _events(spark, sf_dir).select("event_id", "event_type", "value")
    scaler = L.fit_scaler(df, ["value"], ["event_type"])
    return rounded(L.apply_scaler(df, scaler, ["value"], ["event_type"]), ["value"], 6)


def on_labels(name: str, sql: str, fn: Callable[..., DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: fn(_labels(spark, sf_dir), "quality", "toxic"))


on_labels("confusion_matrix",
          "select quality as truth, toxic as predicted, count(*) as n from labels group by all", E.confusion)
on_labels("confusion_normalized", f"""
select truth, predicted, n, {S.r('n / sum(n) over (partition by truth)', 6)} as share
from (select quality as truth, toxic as predicted, count(*) as n from labels group by all) z""",
          lambda *a: rounded(E.confusion_normalized(*a), ["share"], 6))
on_labels("accuracy", f"select {S.r('avg(if(quality = toxic, 1.0::double, 0.0::double))', 6)} as accuracy from labels",
          lambda *a: rounded(E.accuracy(*a), ["accuracy"], 6))
_SHARES = ["precision", "recall", "f1"]
on_labels("class_report", f"""
select label, {', '.join(f'{S.r(c, 6)} as {c}' for c in _SHARES)}, support::bigint as support from report""",
          lambda *a: rounded(E.class_report(*a), _SHARES, 6))
on_labels("macro_auc", f"""
select {S.r('avg((tp / pos + (n - pos - (hit - tp)) / (n - pos)) / 2)', 6)} as macro_auc from class_tallies""",
          lambda *a: rounded(E.macro_auc_hard(*a), ["macro_auc"], 6))


@query("roc_auc", f"""
select {S.r('(sum(rk) filter (where y) - count(*) filter (where y) * (count(*) filter (where y) + 1) / 2)'
            ' / (count(*) filter (where y) * count(*) filter (where not y))', 6)} as roc_auc
from (select event_type = 'purchase' as y,
             rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0::double as rk
      from events) z""")
def _(spark, sf_dir):
    df = _events(spark, sf_dir).select(
        (F.col("event_type") == "purchase").cast("int").alias("y"), "value")
    return rounded(E.roc_auc(df, "y", "value"), ["roc_auc"], 6)


@query("class_counts", "select toxic, quality, count(*) as n from labels group by all")
def _(spark, sf_dir):
    return A.class_counts(_labels(spark, sf_dir), "quality", ["toxic"])


_DIMENSIONS = [f"f{i}" for i in range(64)]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_DIMENSIONS)])


# Distances and draws over the whole table by brute force, from the rule.
_NEAREST = """
select *, row_number() over (partition by k order by dist, near) as rn
from (select a.k, b.k as near, list_distance(a.x, b.x) as dist
      from {points} a join {points} b on a.label = b.label and a.k <> b.k) z
qualify rn <= 5"""
_VECTORS = "select vec_id, vec_id::varchar as k, label, embedding::double[] as x from embeddings"


def _drawn(use: str) -> str:
    return f"('0x' || substr(md5('0:{use}:' || k || ':' || turn), 1, 13))::bigint"


@query("nearest_neighbours", f"""
with points as ({_VECTORS})
select k as vec_id, near as near_id, rn::int as rank, {S.r('dist', 6)} as distance
from ({_NEAREST.format(points='points')}) n""")
def _(spark, sf_dir):
    points = _embeddings(spark, sf_dir).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_dist", "_near")).alias("rank")
    return rounded(N.nearest_neighbours(points, "vec_id", "label", "x", 5).select(
        F.col("_key").alias("vec_id"), F.col("_near").alias("near_id"), rank, F.col("_dist").alias("distance")), ["distance"], 6)


@query("smote_rows", f"""
with points as ({_VECTORS}),
sizes as (select label, n, max(n) over () - n as need from (select label, count(*) as n from points group by label) z),
small as (select p.*, n, need, row_number() over (partition by p.label order by md5('0:' || k), vec_id) as pos
          from points p join sizes s on s.label = p.label where need > 0),
nears as (select k, list(near order by near) as nears from ({_NEAREST.format(points='small')}) n group by k),
turns as (select s.k, s.label, s.x, coalesce(nears, [s.k]) as nears, unnest(range(need // n + (pos <= need % n)::int)) as turn
          from small s left join nears e on e.k = s.k),
drawn as (select label, x, {_drawn('gap')} / {1 << 52}::double as gap, nears[{_drawn('pick')} % len(nears) + 1] as near from turns),
grown as (select d.label, [d.x[i] + d.gap * (o.x[i] - d.x[i]) for i in range(1, 65)] as x, true as is_synthetic
          from drawn d join points o on o.k = d.near)
select label, {', '.join(f'x[{i + 1}] as {c}' for i, c in enumerate(_DIMENSIONS))}, is_synthetic
from (select label, x, false as is_synthetic from points union all select * from grown) z""")
def _smote(spark, sf_dir):
    return N.smote(_points(spark, sf_dir), "vec_id", "label", _DIMENSIONS)


@query("smote_counts", "select label, max(count(*)) over () as n from embeddings group by label")
def _(spark, sf_dir):
    return _smote(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- scenarios -----------------------------------------------------------------------


def _model_input(t: K.StayTables, variant: str = "urine") -> DataFrame:
    return checkpointed(_features(t, variant, ["icustay_id"]))


@on_stays("predict_stage")
def _(t):
    df = _model_input(t)
    return Z.predict(Z.train(df), df)


on_stays("cross_validation")(lambda t: Z.cross_validate(_model_input(t, "creatinine"), {"regParam": [0.001, 0.01, 0.1]}, max_iter=100))
on_stays("fold_classes", f"""
select fold, aki_stage_7day, count(*) as n
from (select aki_stage_7day, cast({_ORDER.format(seed=Z.SEED, key='icustay_id')} % 5 as int) as fold from features_creat) z
group by all""")(lambda t: A.class_counts(Z.with_folds(_model_input(t, "creatinine")), Z.LABEL, [Z.FOLD]))
_HELD = "{pos} <= round_even({n} * {size}, 0)"


def _by_group(column: str) -> str:
    place = f"row_number() over (partition by {column} order by md5('{Z.SEED}:' || icustay_id), icustay_id)"
    return _HELD.format(pos=place, n=f"count(*) over (partition by {column})", size=0.2)


_SETS = [("ethnicity", "train", "ethnicity = 0 and not by_ethnicity"), ("ethnicity", "test", "ethnicity = 0 and by_ethnicity"),
         ("ethnicity", "group 1", "ethnicity = 1 and by_ethnicity"), ("ethnicity", "group 3", "ethnicity = 3 and by_ethnicity"),
         ("ethnicity", "not group 0", "ethnicity <> 0"),
         *[row for a, b in ((0, 1), (1, 0)) for row in (
             (f"system {a} to {b}", "train", f"dbsource = {a} and not by_dbsource"),
             (f"system {a} to {b}", "test", f"dbsource = {a} and by_dbsource"), (f"system {a} to {b}", "other system", f"dbsource = {b}"))],
         ("overall", "train", f"not {_HELD.format(pos='pos', n='n', size=0.2)}"), ("overall", "test", _HELD.format(pos="pos", n="n", size=0.2)),
         *[(f"test size {size}", part, f"{no}{_HELD.format(pos='pos', n='n', size=size)}")
           for size in Z.TEST_SIZES for part, no in (("train", "not "), ("test", ""))]]
on_stays("scenario_sets", f"""
select s.scenario, s.test_set, aki_stage_7day, count(*) as n
from (select aki_stage_7day, unnest([{', '.join(f"struct_pack(scenario := '{s}', test_set := '{p}', inside := {rule})" for s, p, rule in _SETS)}]) as s
      from (select *, {_ORDER.format(seed=Z.SEED, key='icustay_id')} as pos, count(*) over () as n,
                   {_by_group('ethnicity')} as by_ethnicity, {_by_group('dbsource')} as by_dbsource
            from features_urine) y) z
where s.inside group by all""")(    lambda t: Z.set_classes(_model_input(t)))
on_stays("scenario_overall")(lambda t: Z.overall(_model_input(t)))
on_stays("scenario_ethnicity")(lambda t: Z.by_ethnicity(_model_input(t)))
on_stays("scenario_system")(lambda t: Z.by_system(_model_input(t)))
on_stays("scenario_system_oversampled")(lambda t: Z.by_system(_model_input(t), oversample="train"))
on_stays("scenario_sizes")(lambda t: Z.by_size(_model_input(t)))
