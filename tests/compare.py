"""Runs registered queries in Spark and their SQL in DuckDB and compares rows.

``python tests/compare.py [sf] [name ...]``
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NA or v != v
                              else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype")
                              else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df, rel) -> str | None:
    """None when both results hold the same rows."""
    left, right = spark_df.toPandas(), rel.df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(set(left.columns) ^ set(right.columns))}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = normal(left), normal(right)
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    if bad:
        row = int((a[bad[0]] != b[bad[0]]).idxmax())
        return f"values in {bad[:6]}; e.g. {a.loc[row, bad[:3]].to_dict()} != {b.loc[row, bad[:3]].to_dict()}"
    kinds = lambda d: {c: "n" if pd.api.types.is_numeric_dtype(t) and not pd.api.types.is_bool_dtype(t)
                       else str(t)[:4] for c, t in d.dtypes.items()}
    ka, kb = kinds(left), kinds(right)
    odd = {c: (str(left[c].dtype), str(right[c].dtype)) for c in ka if ka[c] != kb[c]}
    exact = {c: (str(left[c].dtype), str(right[c].dtype)) for c in ka
             if str(left[c].dtype) != str(right[c].dtype) and c not in odd}
    if odd or exact:
        print("   dtypes:", odd, exact)
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    broadcast = os.environ.get("BROADCAST_THRESHOLD", "10MB")  # -1 plans joins as for large tables
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.autoBroadcastJoinThreshold", broadcast)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, sql, failed = duck(sf_dir), entry.oracle_sql(), []
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        begin = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in sql:
                diff = difference(df, con.sql(sql[name]))
                status = "ok" if diff is None else "DIFF " + diff
            else:
                status = f"rows {df.count()}"
                diff = None
        except Exception as error:  # report and go on with the other queries
            diff = status = "ERROR " + str(error)[:500]
        if diff:
            failed.append(name)
        print(f"{name:28s} {time.time() - begin:6.2f}s {status}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} good; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
