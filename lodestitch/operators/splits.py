"""Deterministic samples, splits and folds: rows are ordered by an MD5 of seed and id, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, column: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column).cast("string"))), 1, 8), 16, 10).cast("long")


def sample(ids: DataFrame, n: int, seed: int = 42, column: str = "s1_id") -> DataFrame:
    """`n` ids without replacement, those of smallest hash."""
    return ids.select(column).distinct().orderBy(hash_order(seed, column), column).limit(n)


def split(ids: DataFrame, fraction: float = 0.2, seed: int = 42, column: str = "s1_id") -> DataFrame:
    """(id, split): 1 (validation) for the share `fraction` of smallest hash, at least one id; 0 (train) for the others."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    every = ids.select(column).distinct().withColumn("h", hash_order(seed, column))
    if not (n := every.count()):
        raise ValueError("nothing to split")
    k = max(1, int(n * fraction))
    last = every.orderBy("h", column).limit(k).agg(F.max(F.struct("h", column)).alias("x")).first()["x"]
    inside = (F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col(column) <= last[column]))
    return every.select(column, inside.cast("int").alias("split"))


def folds(ids: DataFrame, k: int = 5, seed: int = 42, column: str = "s1_id") -> DataFrame:
    """(id, fold): places in the order of hashes modulo `k`; places are counted by ranges, without one task for all rows."""
    every = ids.select(column).distinct().withColumn("h", hash_order(seed, column)).withColumn("slot", F.shiftright("h", 22))
    sizes = every.groupBy("slot").agg(F.count("*").alias("n"))  # 1,024 rows at most
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    by = Window.partitionBy("slot").orderBy("h", column)
    return every.join(F.broadcast(before), "slot").select(column, ((F.col("before") + F.row_number().over(by) - 1) % k).cast("int").alias("fold"))


def stratified(rows: DataFrame, share: float, label: str = "label", seed: int = 42) -> DataFrame:
    """All positive rows and the share of the negative ones."""
    return rows.sampleBy(label, {1: 1.0, 0: share}, seed)
