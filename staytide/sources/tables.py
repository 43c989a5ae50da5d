"""Typed readers, writers and named intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_INT, _STR, _TS, _DBL = T.IntegerType(), T.StringType(), T.TimestampNTZType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# Full file layouts, in file order; the leading row_id is dropped by the reader.
SCHEMAS = {
    "admissions": _struct(
        row_id=_INT, subject_id=_INT, hadm_id=_INT, admittime=_TS, dischtime=_TS, deathtime=_TS,
        admission_type=_STR, admission_location=_STR, discharge_location=_STR, insurance=_STR,
        language=_STR, religion=_STR, marital_status=_STR, ethnicity=_STR, edregtime=_TS,
        edouttime=_TS, diagnosis=_STR, hospital_expire_flag=T.ByteType(),
        has_chartevents_data=T.ByteType()),
    "icustays": _struct(
        row_id=_INT, subject_id=_INT, hadm_id=_INT, icustay_id=_INT, dbsource=_STR,
        first_careunit=_STR, last_careunit=_STR, first_wardid=T.ShortType(),
        last_wardid=T.ShortType(), intime=_TS, outtime=_TS, los=_DBL),
    "d_icd_diagnoses": _struct(row_id=_INT, icd9_code=_STR, short_title=_STR, long_title=_STR),
    "d_items": _struct(
        row_id=_INT, itemid=_INT, label=_STR, abbreviation=_STR, dbsource=_STR, linksto=_STR,
        category=_STR, unitname=_STR, param_type=_STR, conceptid=_INT),
    "d_labitems": _struct(
        row_id=_INT, itemid=_INT, label=_STR, fluid=_STR, category=_STR, loinc_code=_STR),
    "patients": _struct(
        row_id=_INT, subject_id=_INT, gender=_STR, dob=_TS, dod=_TS, dod_hosp=_TS, dod_ssn=_TS,
        expire_flag=_STR),
    "diagnoses_icd": _struct(
        row_id=_INT, subject_id=_INT, hadm_id=_INT, seq_num=_INT, icd9_code=_STR),
}

# Columns each reader returns; tables not listed return all but row_id.
COLUMNS = {
    "admissions": ["subject_id", "hadm_id", "admittime", "dischtime", "ethnicity"],
    "icustays": ["subject_id", "hadm_id", "icustay_id", "dbsource", "intime", "outtime", "los"],
    "d_items": ["itemid", "label", "dbsource", "param_type"],
    "d_labitems": ["itemid", "label", "fluid", "category"],
    "patients": ["subject_id", "gender", "dob"],
    "diagnoses_icd": ["subject_id", "hadm_id", "icd9_code", "seq_num"],
}


#: Column with the text of a malformed line, where it is asked for.
MALFORMED = "malformed"


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType,
                   columns: list[str] | None = None, bad: str = "null") -> DataFrame:
    """CSV with a header; types come from the schema, never from a scan of the
    data, and a header that does not agree with the schema is an error.

    ``bad`` says what becomes of a line whose values do not fit the schema or
    that has too few or too many: ``"null"`` leaves NULL in place of a value,
    and column pruning reaches the parser, so columns that are not read are not
    looked at; ``"keep"`` also returns the line's text in a last column
    ``malformed`` (NULL for a good line); ``"fail"`` ends the job. The parser
    judges a line by the columns read, so the last two parse all of them once
    and write the rows to the checkpoint folder before columns are selected.
    """
    if bad not in ("null", "keep", "fail"):
        raise ValueError(f"bad: {bad}")
    kept = columns or [c for c in schema.fieldNames() if c != "row_id"]
    reader = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", False)
    if bad == "fail":
        reader = reader.option("mode", "FAILFAST")
    if bad == "keep":
        schema = T.StructType([*schema.fields, T.StructField(MALFORMED, _STR)])
        reader = reader.option("columnNameOfCorruptRecord", MALFORMED)
        kept = [*kept, MALFORMED]
    rows = reader.schema(schema).csv(path)
    return (rows if bad == "null" else checkpointed(rows)).select(*kept)


def load(spark: SparkSession, directory: str, table: str, fmt: str = "csv", bad: str = "null") -> DataFrame:
    """One of the documented source tables from ``<directory>/<TABLE>.csv`` or
    ``<directory>/<table>.parquet``; ``bad`` as in :func:`read_csv_table`."""
    if fmt == "csv":
        return read_csv_table(spark, f"{directory}/{table.upper()}.csv", SCHEMAS[table],
                              COLUMNS.get(table), bad)
    df = spark.read.format(fmt).load(f"{directory}/{table}.{fmt}")
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.select(*COLUMNS[table]) if table in COLUMNS else df.drop("row_id")


def read_table(spark: SparkSession, name: str, url: str | None = None,
               props: dict[str, str] | None = None, **partitioning: object) -> DataFrame:
    """A catalog table, or with ``url`` a database table over JDBC.

    Pass ``column``, ``lowerBound``, ``upperBound`` and ``numPartitions`` for
    large tables: without them the database is read through one connection.
    """
    if url is None:
        return spark.table(name)
    return spark.read.jdbc(url, name, properties=props or {}, **partitioning)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write from the executors. ``mode="ignore"`` keeps existing output. CSV
    keeps times to the microsecond."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(header=True, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    writer.format(fmt).save(path)


def materialize(df: DataFrame, name: str, how: str = "view") -> DataFrame:
    """Drop and rebuild a named intermediate.

    ``view``: a temporary view, evaluated where used. For results read more
    than once, ``table`` writes to the warehouse and ``checkpoint`` to the
    session's checkpoint folder; both survive lost executors.
    """
    spark = df.sparkSession
    if how == "table":
        df.write.mode("overwrite").saveAsTable(name)
        return spark.table(name)
    if how == "checkpoint":
        df = checkpointed(df)
    df.createOrReplaceTempView(name)
    return spark.table(name)


def store_bucketed(df: DataFrame, name: str, keys: list[str], order: list[str] | None = None,
                   buckets: int | None = None) -> DataFrame:
    """Drop and rebuild a named table whose files are bucketed by ``keys`` and
    sorted by them, then by ``order``.

    Joins and aggregates by all of ``keys`` read it without a shuffle of its
    rows, as often as it is used. One shuffle writes one file per bucket
    (``buckets``: by default as many as shuffle partitions) to the checkpoint
    folder. A bucket is read by one task, so the keys should hold a part, such
    as a slot of days, that divides a key with many rows.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, *keys).write.mode("overwrite").option("path", f"{checkpoint_folder(spark)}/{uuid.uuid4()}")
     .bucketBy(n, *keys).sortBy(*keys, *(order or [])).saveAsTable(name))
    return spark.table(name)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only a local session without
    that setting gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="staytide-")
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the rows, once, to the checkpoint folder.

    Reading them back keeps column pruning and file sizes for the planner, and
    a lost executor costs no recomputation. The folder's owner cleans it up.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_tables(spark: SparkSession) -> list[str]:
    """Tables and views of every schema; those outside the current one come
    with their schema's name."""
    current, catalog = spark.catalog.currentDatabase(), spark.catalog
    found = {t.name for t in catalog.listTables()}
    for schema in (d.name for d in catalog.listDatabases() if d.name != current):
        found |= {f"{schema}.{t.name}" for t in catalog.listTables(schema) if not t.isTemporary}
    return sorted(found)


def preview_tables(spark: SparkSession, n: int = 5) -> dict[str, DataFrame]:
    """First rows of every user table and view; each is a lazy ``limit``."""
    return {name: spark.table(name).limit(n) for name in list_tables(spark)}
