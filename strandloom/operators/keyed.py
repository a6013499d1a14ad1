"""Per-key results when a few keys hold most of the rows.

Every step is an algebraic aggregate, so each map task folds its rows into a hash
table (which spills when full) and only one partial state per key and task is
shuffled. A key with a third of all rows costs the reducers as much as any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace


def keyed_totals(
    df: DataFrame,
    key: str,
    *,
    entity: str | None = None,
    distinct_on: Sequence[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """``(key, n_rows[, n_entities])`` for every value of ``key``.

    distinct_on: columns in which a row sent again agrees; such rows count once.
        They are grouped by all these columns at once, so a hot key is spread over
        its other columns.
    entity: also count the distinct non-null values of this column per key. The
        pairs (key, entity) are folded first, so no task sees all entities of a key.
    where: rows to count. Null keys never count. Empty input gives no rows; other
        columns, whatever their names, are pruned.
    """
    keep = list(dict.fromkeys([key, *([entity] if entity else []), *(distinct_on or [])]))
    rows = df.filter(F.col(key).isNotNull())
    if where is not None:
        rows = rows.filter(where)
    rows = rows.select(*keep)
    if distinct_on:
        rows = rows.groupBy(*dict.fromkeys([key, *distinct_on])).agg(*([F.first(entity).alias(entity)] if entity and entity not in {key, *distinct_on} else [F.lit(1).alias("__one")]))
    if entity is None or entity == key:
        out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
        return out.withColumn("n_entities", F.lit(1).cast("long")) if entity else out
    pairs = rows.groupBy(key, entity).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy(key).agg(F.sum("__n").alias("n_rows"), F.count(entity).alias("n_entities"))


def heavy_keys(totals: DataFrame, key: str, per_mille: int) -> DataFrame:
    """Keys of ``keyed_totals`` that hold at least ``per_mille`` thousandths of the rows.

    The totals are written once and read twice: for their sum and for the filter.
    The comparison is exact in whole numbers; with no rows there are no keys. The least
    number of rows is worked out here, as a total below 2^31 is an INT literal, whose
    product overflows from 86 million rows on at 25 thousandths.
    """
    kept = Workspace(totals.sparkSession, "heavy").save(totals.select(key, "n_rows"))
    total = kept.agg(F.sum("n_rows")).first()[0] or 0
    return kept.filter(F.col("n_rows") >= F.lit(-(-total * per_mille // 1000)))
