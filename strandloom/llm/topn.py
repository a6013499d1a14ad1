"""The N best items of every group by descending score bands.

Scores are cut into bands at quantiles of the whole column, and the table is written
band by band. From the top band down, the groups whose places are taken are struck
from a band by an anti-join; of the rest, a group that still fits takes the whole
band without any order. Only bands in which places run out are ranked, all of them
in one range-partitioned sort over (group, score, item). So a group of a million
items sorts none but its boundary band, and that in as many tasks as the sort has,
also where all scores are equal or the limit is large.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace
from .ranking import null_safe, ranked


def banded_top_n(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    score: str,
    limits: DataFrame,
    limit_on: Sequence[str],
    limit: str,
    *,
    bands: int = 8,
) -> DataFrame:
    """``(*group, item, score)`` for the ``limit`` highest scores of each group.

    limits: one row per value of ``limit_on`` (columns of ``group``); a null limit,
        or no row at all, means every item.
    Rows with a null or NaN score, or a null item, have no place; null group values
    form groups of their own. An item that occurs again in its group counts once,
    by its best score. Equal scores: the smaller item first. Empty tables give no
    rows; further columns are pruned, so their names cannot clash.
    """
    keys = list(group)
    rows = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    once = rows.groupBy(*keys, item).agg(F.max(score).alias("__s"))
    lim = limits.select(*limit_on, F.col(limit).cast("long").alias("__lim")).groupBy(*limit_on).agg(F.max("__lim").alias("__lim"))
    # Band edges: quantiles over all scores, in bounded memory. Equal scores share a band.
    edges = rows.agg(F.percentile_approx(score, F.array(*[F.lit(i / bands) for i in range(1, bands)]), 2000)).first()[0] or []
    edges = sorted(set(edges))
    band = reduce(lambda b, e: b + (F.col("__s") >= F.lit(float(e))).cast("int"), edges, F.lit(0))
    space = Workspace(df.sparkSession, "topn")
    banded = space.save(null_safe(once, lim, limit_on, "left").withColumn("__band", band), by="__band")

    free = banded.filter(F.col("__lim").isNull()).select(*keys, item, "__s")
    held = banded.filter(F.col("__lim").isNotNull())
    sizes: list[DataFrame] = []
    for b in range(len(edges), -1, -1):
        here = held.filter(F.col("__band") == b)
        if sizes:
            taken = reduce(DataFrame.unionByName, sizes).groupBy(*keys).agg(F.sum("__n").alias("__taken"), F.max("__lim").alias("__of"))
            here = null_safe(here, taken.filter("__taken >= __of").select(*keys), keys, "left_anti")
        size = here.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max("__lim").alias("__lim"))
        size = null_safe(size, taken.select(*keys, "__taken"), keys, "left") if sizes else size.withColumn("__taken", F.lit(0).cast("long"))
        size = space.save(size.withColumn("__left", F.col("__lim") - F.coalesce("__taken", F.lit(0))).drop("__taken"))
        sizes.append(size)
    # A group that was filled above a band has no row for it in `sizes`: its items of that band drop out here.
    places = reduce(DataFrame.unionByName, [s.withColumn("__band", F.lit(b)) for b, s in zip(range(len(edges), -1, -1), sizes)]).filter("__left > 0")
    live = space.save(null_safe(held.drop("__lim"), places.drop("__lim"), [*keys, "__band"], "inner"))
    whole = live.filter("__n <= __left").select(*keys, item, "__s")
    cut = ranked(live.filter("__n > __left").select(*keys, item, "__s", "__left"), keys, [F.desc("__s"), F.col(item)], space).filter("__pos < __left").select(*keys, item, "__s")
    return reduce(DataFrame.unionByName, [free, whole, cut]).withColumnRenamed("__s", score)
