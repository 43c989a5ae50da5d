"""Exact positions without a single-task sort: splits, folds, running counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hash prefix length: 16^4 buckets. Their counts are one row per bucket, a
# table of fixed size however long the input is.
_PREFIX = 4


def with_position(df: DataFrame, key: str, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Adds ``_pos`` (1..N per ``by`` group) in a seeded random order.

    The order is that of ``md5(seed:key)``, so it does not depend on how rows
    are distributed, and re-running a lost task gives the same positions. A
    position is the number of rows in smaller hash buckets plus the rank
    inside the bucket; ``key`` must identify a row;
    NULL keys and groups are values like others. ``_n`` is the group size.
    """
    by = by or []
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, _PREFIX))
    counts = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_o"),
                            F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_hash", key))
    offsets = offsets.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_bucket"]], "_o", "_n")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_bucket"]])
    return (hashed.withColumn("_r", rank)
            .join(offsets if by else F.broadcast(offsets), same)
            .withColumn("_pos", F.col("_o") + F.col("_r"))
            .select(*df.columns, "_n", "_pos"))


def held_out_rows(n: Column, size: float) -> Column:
    """Number of test rows: a fraction below 1 of ``n``, else a count; halves
    go to the even number."""
    return F.bround(n * F.lit(size)) if size < 1 else F.lit(round(size))


def split_exact(df: DataFrame, key: str, test: float, seed: int = 0,
                by: list[str] | None = None) -> DataFrame:
    """Adds ``is_test`` for an exact-size random split (within each ``by`` group)."""
    placed = with_position(df, key, seed, by)
    return placed.withColumn("is_test", F.col("_pos") <= held_out_rows(F.col("_n"), test)).drop("_pos", "_n")


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold`` 0..k-1; fold sizes differ by at most one."""
    placed = with_position(df, key, seed)
    return placed.withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_pos", "_n")


def size_ladder(df: DataFrame, key: str, sizes: list[float], seed: int = 0) -> DataFrame:
    """Train and test counts for several test sizes, as cuts of one order."""
    placed = with_position(df, key, seed)
    rows = placed.select("_pos", "_n", F.explode(F.array(*map(F.lit, sizes))).alias("test_fraction"))
    is_test = F.col("_pos") <= F.bround(F.col("_n") * F.col("test_fraction"))
    return rows.groupBy("test_fraction").agg(F.count_if(is_test).alias("n_test"),
                                             F.count_if(~is_test).alias("n_train"))
