"""Readers, writers, named intermediates and equality of plans."""

from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from staytide.operators import joins as J
from staytide.operators.windows import Trailing, trailing_agg
from staytide.sources import tables as S

T0 = datetime(2024, 1, 1)


def test_csv_reader(spark, tmp_path):
    (tmp_path / "ADMISSIONS.csv").write_text(
        "ROW_ID,SUBJECT_ID,HADM_ID,ADMITTIME,DISCHTIME,DEATHTIME,ADMISSION_TYPE,ADMISSION_LOCATION,DISCHARGE_LOCATION,"
        "INSURANCE,LANGUAGE,RELIGION,MARITAL_STATUS,ETHNICITY,EDREGTIME,EDOUTTIME,DIAGNOSIS,HOSPITAL_EXPIRE_FLAG,"
        "HAS_CHARTEVENTS_DATA\n"
        '1,22,165315,2196-04-09 12:26:00,2196-04-10 15:54:00,,EMERGENCY,X,Y,Private,,U,MARRIED,WHITE,,,"A, B",0,1\n')
    df = S.load(spark, str(tmp_path), "admissions")
    assert df.columns == ["subject_id", "hadm_id", "admittime", "dischtime", "ethnicity"]
    assert tuple(df.first()) == (22, 165315, datetime(2196, 4, 9, 12, 26), datetime(2196, 4, 10, 15, 54), "WHITE")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "religion" not in plan.lower()


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "PATIENTS.csv").write_text(
        "ROW_ID,SUBJECT_ID,GENDER,DOB,DOD,DOD_HOSP,DOD_SSN,EXPIRE_FLAG\n"
        "1,10,F,2100-01-01 00:00:00,,,,0\n2,x,M,2100-01-01 00:00:00,,,,0\n3,30,M,2100-01-01 00:00:00,sometime,,,0\n4,40,M\n")
    load = lambda **how: S.load(spark, str(tmp_path), "patients", **how)
    kept = load(bad="keep").orderBy("subject_id").collect()
    assert [(r["subject_id"], r["malformed"] is None) for r in kept] == [(None, False), (10, True), (30, False), (40, False)]
    assert kept[0]["malformed"].startswith("2,x,M") and load(bad="keep").columns == [*load().columns, "malformed"]
    assert load().count() == 4 and load().where("subject_id is null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        load(bad="fail").collect()
    with pytest.raises(ValueError):
        load(bad="drop")


@pytest.mark.parametrize("table", sorted(S.SCHEMAS))
def test_every_table_has_a_reader(spark, tmp_path, table):
    spark.createDataFrame([], S.SCHEMAS[table]).coalesce(1).write.option("header", True).csv(str(tmp_path / f"{table.upper()}.csv"))
    df = S.load(spark, str(tmp_path), table)
    assert df.count() == 0 and "row_id" not in df.columns


def test_round_trips(table, tmp_path):
    df = table("id long, at timestamp_ntz, x double, s string", (1, T0, 1.5, "a,b"), (2, None, None, None))
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        S.write_result(df, path, fmt)
        S.write_result(df.limit(0), path, fmt, mode="ignore")
        back = S.read_csv_table(df.sparkSession, path, df.schema) if fmt == "csv" else df.sparkSession.read.parquet(path)
        assert back.orderBy("id").collect() == df.orderBy("id").collect()


def test_intermediates(spark, table):
    df = table("id long", (1,), (2,))
    for how in ("view", "checkpoint", "table"):
        name = f"kept_{how}"
        assert S.materialize(df, name, how).count() == 2
        assert S.materialize(df.limit(1), name, how).count() == 1  # rebuilt
        assert S.read_table(spark, name).count() == 1
    assert {"kept_view", "kept_table"} <= set(S.list_tables(spark))
    assert S.preview_tables(spark, 5)["kept_view"].count() == 1


def test_preview_of_all_schemas(spark):
    spark.sql("create database if not exists other_schema")
    spark.range(9).write.mode("overwrite").saveAsTable("other_schema.numbers")
    assert "other_schema.numbers" in S.list_tables(spark)
    assert S.preview_tables(spark, 5)["other_schema.numbers"].count() == 5


def _series(spark, n=300, stays=4):
    rng = random.Random(11)
    rows = [(rng.randrange(stays) if i % 3 else 0, T0 + timedelta(minutes=rng.randrange(20000)), float(rng.randrange(50))) for i in range(n)]
    return spark.createDataFrame(rows + [(1, None, 3.0)], "k long, at timestamp_ntz, v double")


@pytest.mark.parametrize("closed", ["left", "both"])
def test_windows_equal_self_join(spark, closed):
    df = _series(spark)
    spans = {"h1": timedelta(hours=1), "h5": timedelta(hours=5), "d2": timedelta(days=2)}
    outputs = {f"{fn}_{n}": Trailing(fn, "v", s, closed) for n, s in spans.items() for fn in ("min", "max", "sum")}
    plain, cut = (trailing_agg(df, ["k"], "at", outputs, slot) for slot in (None, timedelta(hours=3)))
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(plain.collect()) == key(cut.collect())
    rows = df.collect()
    for r in plain.collect():
        for n, s in spans.items():
            inside = [x["v"] for x in rows if x["k"] == r["k"] and x["at"] and r["at"] and r["at"] - s <= x["at"]
                      and (x["at"] <= r["at"] if closed == "both" else x["at"] < r["at"])]
            assert (r[f"min_{n}"], r[f"sum_{n}"]) == ((min(inside), sum(inside)) if inside else (None, None))


@pytest.mark.parametrize("base, levels", [(16, 5), (2, 3), (3, 9)])
def test_interval_join_equals_a_range_join(spark, base, levels):
    """Overlapping, empty, reversed and open intervals, lengths of minutes to centuries, repeated points, NULL keys and times."""
    points = _series(spark).withColumnRenamed("v", "p")
    points = points.unionByName(points.limit(20)).unionByName(spark.sql("select null as k, timestamp_ntz'2024-01-02' as at, 1.0D as p"))
    spans = _series(spark, 60).where("at is not null").selectExpr(
        "k", "at as s", "at + make_dt_interval(0, cast(v as int), 7, 0) as e", "v as w")
    spans = spans.unionByName(spark.sql("""select * from values
        (1L, timestamp_ntz'1500-01-01', timestamp_ntz'2400-07-09', 1.0D), (2L, timestamp_ntz'1969-12-31 23:00:00', timestamp_ntz'2024-01-05', 2.0D),
        (2L, timestamp_ntz'2024-01-03', timestamp_ntz'2024-01-03', 3.0D), (2L, timestamp_ntz'2024-01-09', timestamp_ntz'2024-01-01', 4.0D),
        (3L, null, timestamp_ntz'2024-01-09', 5.0D), (3L, timestamp_ntz'2024-01-01', null, 6.0D), (3L, timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-02', 7.0D),
        (null, timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-09', 8.0D) as v(k, s, e, w)"""))
    key = lambda df: sorted(map(str, df.collect()))
    p, i = points.alias("p"), spans.alias("i")
    want = p.join(i, F.expr("p.k = i.k and p.at >= i.s and p.at < i.e"), "left").select("p.*", "i.s", "i.e", "i.w")
    got = J.interval_join(points, spans, ["k"], "at", "s", "e", base, levels)
    assert got.columns == want.columns and key(got) == key(want) and got.count() > points.count()


def test_long_intervals_have_few_tiles(spark):
    """Copies grow with the logarithm of an interval's length, and cover its days once."""
    for days in (1, 9, 300, 40_000):
        tiles = spark.sql(f"select timestamp_ntz'2001-03-05 07:00:00' as s, timestamp_ntz'2001-03-05 07:00:00' + interval '{days}' day as e").selectExpr(
            f"inline({J._tiles('s', 'e', [16**i for i in range(5)])}) as (level, node)").collect()
        covered = [d for t in tiles for d in range(t["node"], t["node"] + 16 ** t["level"])]
        first = (T0.replace(year=2001, month=3, day=5) - T0.replace(year=1970, month=1, day=1)).days
        assert sorted(covered) == list(range(first, first + days + 1)) and len(tiles) <= 30 * 5


def test_attach_window_left(spark):
    events = _series(spark).where("at is not null")
    stays = spark.createDataFrame([(10 * k + j, k, T0 + timedelta(days=4 * j)) for k in range(6) for j in range(2)],
                                  "icustay_id long, k long, intime timestamp_ntz")
    before, after = timedelta(hours=6), timedelta(days=2)
    got = J.attach_window(stays, events, ["k"], "at", "intime", before, after, how="left")
    want = stays.join(events, (stays.k == events.k) & (events.at >= stays.intime - F.lit(before))
                      & (events.at <= stays.intime + F.lit(after)), "left").select("icustay_id", "at", "v")
    key = lambda d: sorted(map(str, d.select("icustay_id", "at", "v").collect()))
    assert key(got) == key(want)


def test_bucketed_events_are_not_shuffled(spark):
    """Two joins read one stored table; only the stays move."""
    events = _series(spark).where("at is not null")
    stays = spark.createDataFrame([(10 * k + j, k, T0 + timedelta(days=4 * j)) for k in range(6) for j in range(2)],
                                  "icustay_id long, k long, intime timestamp_ntz")
    before, after = timedelta(hours=6), timedelta(days=2)
    kept = S.store_bucketed(J.with_slot(events, "at", before, after), "kept_bucketed", ["k", J.SLOT], ["at"], 5)
    key = lambda d: sorted(map(str, d.select("icustay_id", "at", "v").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left"):
            got = J.attach_window(stays, kept, ["k"], "at", "intime", before, after, how=how, stored=True)
            plan = got._jdf.queryExecution().executedPlan().toString()
            side = plan[:plan.index("kept_bucketed")].split("SortMergeJoin")[-1]
            assert side.count("Exchange") == 1 and "Bucketed: true" in plan
            assert key(got) == key(J.attach_window(stays, events, ["k"], "at", "intime", before, after, how=how))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = S.store_bucketed(J.with_slot(events.limit(7), "at", before, after), "kept_bucketed", ["k", J.SLOT])
    assert again.count() == 7 and kept.columns == again.columns
