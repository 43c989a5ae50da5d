"""The driver contract, and registered queries against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from staytide import registry
from compare import difference, duck

SF = "/root/testdata/sf0.001"
NAMES = ["creatinine_baseline", "creatinine_baseline_split", "stage_creatinine", "weight_durations", "stages_all_times",
         "stage_7day_split", "vitals_pivot", "note_fields", "comorbidities", "cohort_wide", "split_exact", "class_report", "roc_auc"]
ROWS_ONLY = {"cross_validation", "predict_stage", "scenario_overall", "scenario_ethnicity", "scenario_system",
             "scenario_system_oversampled", "scenario_sizes"}


def test_contract(spark):
    own = set(registry.QUERIES)
    assert own <= set(entry.queries()) and own - set(entry.oracle_sql()) == ROWS_ONLY
    df = entry.entry(spark)
    assert df.count() == 45 and "aki_stage_7day" in df.columns


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])) is None
