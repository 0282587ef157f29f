"""Ordinal ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage


def ordinal_rank(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "rank",
                 rows_per_task: int = 1_000_000, slices: int = 256) -> DataFrame:
    """``row_number`` over (keys, order by value, tie) that never sorts a large group in one task.

    Groups above ``rows_per_task`` are cut at quantiles of ``value``. Rows equal to a cut point are a
    bucket of their own, cut again at quantiles of the numeric ``tie``, so one value held by a third
    of the rows is split as well. Ranks inside a bucket plus the sizes of the buckets before it are
    exact, wherever the cut points fall. They are checkpointed once because quantile sketches need not
    repeat, and there is one row of them per large group only. A NULL key is a group like any other; NULL
    values rank first, NaN last, as Spark sorts them.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    steps = [k / slices for k in range(1, slices)]
    big = null_safe_join(df, sizes.drop("_n"), keys, "left_semi")
    cuts = cut_lineage(big.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, steps, 10000)).alias("_cuts"),
        F.array_distinct(F.percentile_approx(tie, steps, 10000)).alias("_tie_cuts")))
    if cuts.isEmpty():
        w = W.partitionBy(*keys).orderBy(value, tie)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    marked = null_safe_join(df, cuts.withColumn("_cut", F.lit(True)), keys, "left")
    cut_points = F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType))
    tie_points = F.coalesce("_tie_cuts", F.array().cast(cuts.schema["_tie_cuts"].dataType))
    below = F.size(F.filter(cut_points, lambda c: c < F.col(value)))
    on_cut = F.coalesce(F.array_contains(cut_points, F.col(value)), F.col(value).isNull())
    # a group of NULL values only has no cut points; its rows are split by the tie alone
    major = F.when(F.col("_cut").isNull(), 0).when(F.col(value).isNull(), -1).otherwise(2 * below + on_cut.cast("int"))
    minor = F.when(F.col("_cut") & on_cut, F.size(F.filter(tie_points, lambda c: c < F.col(tie)))).otherwise(0)
    marked = marked.withColumn("_major", major).withColumn("_minor", F.coalesce(minor, F.lit(0))).drop("_cuts", "_tie_cuts", "_cut")
    bucket = [*keys, "_major", "_minor"]
    inside = marked.withColumn("_inside", F.row_number().over(W.partitionBy(*bucket).orderBy(value, tie)))
    counts = marked.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_count"))
    # at most slices * (slices + 1) buckets per group reach this window
    before = F.sum("_count").over(W.partitionBy(*keys).orderBy("_major", "_minor").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_count")
    return null_safe_join(inside, offsets, bucket, "inner").withColumn(out, F.col("_inside") + F.col("_before")).drop(
        "_major", "_minor", "_inside", "_before")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys meet."""
    renamed = right.select([F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"_r_{k}" for k in keys])
