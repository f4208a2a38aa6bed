"""Running sums over tables of any size: range sort, partition totals, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def range_sorted(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df in range partitions by group and order, with the partition's number in `_part`.

    Written once, because the bounds of a range partitioning are sampled: two evaluations
    of the plan could cut at different rows.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*group, *order]])
    return written(ranged.withColumn("_part", F.spark_partition_id()))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, inclusive: bool = True, ranged: bool = False) -> DataFrame:
    """df with the sum of `value` over the rows of its group up to this one in `out`.

    A group may hold any share of the rows: it is cut by range partitions, each of which
    sums its own piece; the pieces' totals (one row a group and partition) become offsets.
    Rows that are equal in `order` are summed in an arbitrary order; put a unique column
    last where that matters. Null values count 0; null groups form a group. `df` must not
    have columns `_part`, `_off` or `_here`, but for ranged=True, which says that range_sorted() made it.
    """
    ranged = df if ranged else range_sorted(df, group, order)
    piece = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_here"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_off"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = F.coalesce(F.sum(value).over(piece), F.lit(0)) - (F.lit(0) if inclusive else F.coalesce(F.col(value), F.lit(0)))
    summed = ranged.withColumn(out, own).join(offsets, same)
    return summed.withColumn(out, F.col(out) + F.col("_off")).drop("_part", "_p", "_off", *[f"_g{i}" for i in range(len(group))])
