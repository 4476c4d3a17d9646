"""Window-like logic over ordered collections without putting a whole group into one task.

A group is cut into buckets of the order column (order div width). Row-level windows stay inside (key, bucket); what crosses
a bucket border comes from one row per bucket. A group that holds a third of all rows is so spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1024


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def positions(df: DataFrame, key: str, order: str, tie: str, width: int = WIDTH) -> DataFrame:
    """df with position (1-based rank by order, tie) and total of its group."""
    x = df.withColumn("_b", _bucket(order, width))
    counts = x.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_k").orderBy("_kb")
    counts = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("_n").over(Window.partitionBy("_k")),
    })
    local = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order, tie))
    out = x.withColumn("_r", local).join(counts, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")))
    return out.withColumn("position", (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_k", "_kb", "_n", "_before")


def neighbours(df: DataFrame, key: str, order: str, value: str, width: int = WIDTH) -> DataFrame:
    """df with prev_<value> and next_<value>: the values of the nearest row below and above in order."""
    x = df.withColumn("_b", _bucket(order, width))
    ends = x.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    by = Window.partitionBy("_k").orderBy("_kb")
    ends = ends.select("_k", "_kb", F.lag("_last").over(by).alias("_below"), F.lead("_first").over(by).alias("_above"))
    inside = Window.partitionBy(key, "_b").orderBy(order)
    out = x.withColumns({"_p": F.lag(value).over(inside), "_n": F.lead(value).over(inside)})
    out = out.join(ends, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")))
    out = out.withColumns({f"prev_{value}": F.coalesce("_p", "_below"), f"next_{value}": F.coalesce("_n", "_above")})
    return out.drop("_b", "_k", "_kb", "_below", "_above", "_p", "_n")


def running_max(df: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """df with high: the greatest value of the group up to and including this row of the order."""
    x = df.withColumn("_b", _bucket(order, width))
    tops = x.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.max(value).alias("_top"))
    by = Window.partitionBy("_k").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_k", "_kb", F.max("_top").over(by).alias("_before"))
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = x.withColumn("_here", F.max(value).over(inside))
    out = out.join(tops, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")))
    return out.withColumn("high", F.greatest("_here", "_before")).drop("_b", "_k", "_kb", "_before", "_here")


def last_by_key(df: DataFrame, keys: list[str], order: list[Column], first: bool = False) -> DataFrame:
    """One row per key: the last in order (or the first). An aggregate, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_x"))
    return best.select(*keys, "_x.*").select(*df.columns)


def numbered(df: DataFrame, key: str, order: str, base: DataFrame | None = None) -> DataFrame:
    """df with new_seq: 0, 1, 2, ... in order within the group, after the group's base (key, base) where given."""
    out = positions(df, key, order, order).withColumn("new_seq", F.col("position") - 1)
    if base is not None:
        out = out.join(base, key, "left").withColumn("new_seq", F.col("new_seq") + F.coalesce("base", F.lit(0))).drop("base")
    return out.drop("position", "total")
