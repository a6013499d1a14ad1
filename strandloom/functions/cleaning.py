"""Column rules for dirty sketch tables: usable numbers, markers, file names, stand-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER_BITS = 42
MARKER_ROW = ["genome_id", "contig_index", "pos", "marker"]


def is_marker(c: str | Column) -> Column:
    """A marker is a whole number of at most 42 bits."""
    c = F.col(c) if isinstance(c, str) else c
    return c.between(0, (1 << MARKER_BITS) - 1)


def usable(c: str | Column) -> Column:
    """Neither null, NaN nor negative (Spark ranks NaN above every number)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (c >= 0)


def percent_at_least(c: str, least: float) -> Column:
    """Usable and at least ``least`` per cent, where a value up to 1 is a fraction."""
    x = F.col(c)
    return usable(c) & F.when(x <= 1, x >= least / 100).otherwise(x >= least)


def bare_name(c: str | Column) -> Column:
    """File name without white space around it and without leading ``./``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^(\./)+", "")


def resolve_names(df: DataFrame, cols: list[str], known: DataFrame, name: str) -> DataFrame:
    """Replace the file names in ``cols`` by the spelling that ``known.name`` has.

    An exact spelling stands; otherwise the smallest known name with the same bare
    name; a name that is not known stays, bare. Only distinct names are joined.
    """
    spellings = known.filter(F.col(name).isNotNull()).select(F.col(name).alias("__known")).distinct()
    bare = spellings.groupBy(bare_name("__known").alias("__bare")).agg(F.min("__known").alias("__best"), F.collect_set("__known").alias("__all"))
    for c in cols:
        j = df.withColumn("__raw", F.col(c)).withColumn("__bare", bare_name(c)).join(bare, "__bare", "left")
        df = j.withColumn(c, F.when(F.array_contains("__all", F.col("__raw")), F.col("__raw")).otherwise(F.coalesce("__best", "__bare"))).drop("__raw", "__bare", "__best", "__all")
    return df
