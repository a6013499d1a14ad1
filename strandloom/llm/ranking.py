"""Exact places within groups of any size, by one range-partitioned sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace, shuffle_partitions


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, where null equals null; the keys come once."""
    cond = F.lit(True)
    for c in keys:
        right = right.withColumnRenamed(c, f"__k_{c}")
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    out = left.join(right, cond, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"__k_{c}" for c in keys])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], space: Workspace) -> DataFrame:
    """The rows with ``__pos``, their place from 0 on within ``keys`` in the given order.

    ``keys`` and ``order`` together must tell all rows apart. Ranges are cut by keys
    and order at once, so a group with a third of all rows lies in many partitions and
    no task holds it; a place is the place in the partition plus the rows of the group
    in the partitions before, of which there is one count per group and partition.
    """
    cols = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    s = df.repartitionByRange(shuffle_partitions(df.sparkSession), *cols).sortWithinPartitions(*cols)
    s = space.save(s.withColumn("__part", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % F.lit(1 << 33)))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = s.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    return null_safe(s, counts, [*keys, "__part"], "inner").withColumn("__pos", F.col("__i") + F.col("__before")).drop("__part", "__i", "__before")
