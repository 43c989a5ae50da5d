"""From the wide cohort to model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

from ..functions import codes as C
from ..functions.columns import all_finite, literal_map, one_of

EXCLUDED_LABELS = [2, 3, 4]
ADULT_AGE = 18


def cohort_exclusions(wide: DataFrame) -> DataFrame:
    """Drops stays with an excluded label, minors and stays recorded in both
    source systems; an unknown value is no reason to drop a stay."""
    reasons = [one_of("aki", EXCLUDED_LABELS), f"age < {ADULT_AGE}", "dbsource = 'both'"]
    return wide.where(" and ".join(f"not coalesce({r}, false)" for r in reasons))


def encode_categories(df: DataFrame) -> DataFrame:
    """Ethnicity, gender and source system as numbers; an unlisted source is NULL."""
    sources = {code: [name] for name, code in C.SOURCE_CODES.items()}
    codes = {"ethnicity": literal_map("ethnicity", C.ETHNICITY_GROUPS, C.ETHNICITY_UNLISTED),
             "gender": "if(gender = 'F', 0, 1)",
             "dbsource": literal_map("dbsource", sources, None)}
    return df.selectExpr(*[f"{codes[c]} as {c}" if c in codes else c for c in df.columns])


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def fill_zero(df: DataFrame, keep_null: list[str]) -> DataFrame:
    """NULL and NaN numbers become 0, except in the named columns."""
    return df.na.fill(0, subset=[n for n in _numeric(df) if n not in keep_null])


def drop_non_finite(df: DataFrame) -> DataFrame:
    """Drops rows with an infinite, NaN or NULL number."""
    return df.where(all_finite(_numeric(df)))


def clean_cohort(wide: DataFrame) -> DataFrame:
    """Exclusions, encodings, zero filling, and one meaning per column name:
    laboratory minimum and maximum, vital sign minimum, maximum and mean, with
    glucose extremes from the laboratory and its mean from the vital signs."""
    encoded = fill_zero(encode_categories(cohort_exclusions(wide)), ["dbsource"])
    labs = {f"lab_{n}_{s}": f"{n}_{s}" for n in C.LABS for s in ("min", "max")}
    vitals = {f"vital_{n}_{s}": f"{n}_{s}" for n in C.VITALS for s in ("min", "max", "mean")
              if n != "glucose" or s == "mean"}
    dropped = ["vital_glucose_min", "vital_glucose_max", "admittime", "dischtime", "intime",
               "outtime", "dob", "charttime_creat", "charttime_uo", "aki_stage_creat", "aki_7day",
               "has_prior_aki", "has_ckd", "has_renal_failure"]
    return encoded.drop(*dropped).withColumnsRenamed({**labs, **vitals})


def feature_matrix(clean: DataFrame, variant: str, keep: list[str] | None = None) -> DataFrame:
    """The two labels and the 79 or 82 features of the variant."""
    return drop_non_finite(clean).select(*(keep or []), *C.LABEL_COLUMNS, *C.feature_columns(variant))
