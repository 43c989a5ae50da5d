"""Stay tables derived from the driver's event and customer tables.

The texts are plain SQL that Spark and DuckDB both accept; each is built over
the whole input tables. ``{name}`` marks an input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.kidney import StayTables

_BLOCK = "cast(floor((extract(day from ts)-1)/10) as int)"
_HADM = f"user_id*10 + least({_BLOCK},1)"
_STAY = f"user_id*10 + {_BLOCK}"

VIEWS = {
    "icustays": f"""
select user_id as subject_id, user_id*10 + least(k,1) as hadm_id, user_id*10 + k as icustay_id,
       case when user_id % 10 = 9 then 'both' when user_id % 2 = 0 then 'carevue' else 'metavision' end as dbsource,
       min(ts) as intime, max(ts) as outtime
from (select user_id, ts, {_BLOCK} as k from {{events}}) z
group by user_id, k""",
    "admissions": """
select i.hadm_id, i.subject_id, i.admittime - interval '1' day as admittime, i.dischtime + interval '2' day as dischtime,
       case c.c_mktsegment when 'BUILDING' then 'WHITE' when 'AUTOMOBILE' then 'BLACK/AFRICAN AMERICAN'
            when 'MACHINERY' then 'HISPANIC OR LATINO' when 'HOUSEHOLD' then 'ASIAN' else 'NOT IN MAP' end as ethnicity
from (select hadm_id, subject_id, min(intime) as admittime, max(outtime) as dischtime from {icustays} group by hadm_id, subject_id) i
left join {customer} c on c.c_custkey = i.subject_id""",
    "patients": """
select c_custkey as subject_id, case when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
       make_date(cast(1700 + (c_custkey * 7) % 320 as int), 1, 1) as dob
from {customer}""",
    "labevents": f"""
select user_id as subject_id, {_HADM} as hadm_id,
       case when event_type in ('click','view') then 50912
            when event_id % 5 = 0 then 50868 when event_id % 5 = 1 then 51265 when event_id % 5 = 2 then 50971
            when event_id % 5 = 3 then 51006 else 51301 end as itemid,
       ts as charttime,
       case when event_type not in ('click','view') then value
            when event_id % 9 = 0 then 1 + value / 25 else 1 + value / 250 end as valuenum
from {{events}}""",
    "outputevents": f"""
select {_STAY} as icustay_id,
       case when event_id % 7 = 0 then 227488 else 40055 end as itemid, ts as charttime, value
from {{events}}""",
    "chartevents": f"""
select user_id as subject_id, {_HADM} as hadm_id, {_STAY} as icustay_id,
       case when event_id % 25 = 0 then 763 when event_id % 25 = 1 then 762
            when event_id % 25 = 2 then 3580 when event_id % 25 = 3 then 4183
            when event_id % 8 = 0 then 211 when event_id % 8 = 1 then 51 when event_id % 8 = 2 then 8368
            when event_id % 8 = 3 then 456 when event_id % 8 = 4 then 618 when event_id % 8 = 5 then 223761
            when event_id % 8 = 6 then 646 else 807 end as itemid,
       ts as charttime,
       case when event_id % 50 = 3 then 'n/a' else cast(cast(value * 30 as decimal(12,2)) as string) end as value,
       case when event_id % 25 < 2 then 50 + event_id % 50 else value end as valuenum,
       case when event_id % 97 = 0 then 1 when event_id % 97 = 1 then cast(null as int) else 0 end as error
from {{events}}""",
    "diagnoses_icd": f"""
select user_id as subject_id, {_HADM} as hadm_id,
       1 + cast(floor(event_id / 10) as bigint) % 5 as seq_num,
       case event_id % 290
            when 0 then '5851' when 1 then '5845' when 2 then '40391' when 3 then 'V420' when 4 then '4280' when 5 then '42731'
            when 6 then '4019' when 7 then '25000' when 8 then '25040' when 9 then '2449' when 10 then '27800' when 11 then '4240'
            when 12 then '4400' when 13 then '5712' when 14 then '30500' when 15 then '3042' else '78650' end as icd9_code
from {{events}}""",
    "noteevents": f"""
select event_id as row_id, user_id as subject_id, {_HADM} as hadm_id,
       date_trunc('day', ts) as chartdate,
       case when event_type = 'view' then 'Echo' else 'Other' end as category,
       concat('Date/Time: [**2024-1-1**] at 09:', cast(10 + event_id % 50 as string), chr(10),
              'Indication: reason ', event_type, chr(10),
              'Height: (in) ', case when event_id % 11 = 0 then '**' else cast(60 + event_id % 20 as string) end, chr(10),
              'Weight (lb): ', case when event_id % 13 = 0 then '**' else cast(100 + event_id % 150 as string) end, chr(10),
              case when event_id % 4 = 0 then '' else concat('BP (mm Hg): ', cast(100 + event_id % 60 as string), '/', cast(60 + event_id % 30 as string), chr(10)) end,
              'Status: Inpatient', chr(10)) as text
from {{events}}""",
}


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
# date_trunc and make_date leave session-zone or date types behind.
_ZONE_FREE = {"noteevents": "chartdate", "patients": "dob"}


class DerivedTables:
    """``StayTables`` whose tables are planned when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark = spark
        self._built: dict[str, DataFrame] = {
            "events": spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"),
            "customer": spark.read.schema(CUSTOMER).parquet(f"{sf_dir}/customer.parquet")}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in ("events", "customer"):
            raise AttributeError(name)
        if name not in self._built:
            inputs = re.findall(r"\{(\w+)\}", VIEWS[name])
            df = self._spark.sql(VIEWS[name], **{i: getattr(self, i) for i in inputs})
            if name in _ZONE_FREE:
                column = _ZONE_FREE[name]
                df = df.withColumn(column, F.col(column).cast("timestamp_ntz"))
            self._built[name] = df
        return self._built[name]


def stay_tables(spark: SparkSession, sf_dir: str) -> StayTables:
    return DerivedTables(spark, sf_dir)
