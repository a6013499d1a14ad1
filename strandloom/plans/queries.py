"""Queries of the core operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import MARKER_ROW, is_marker
from ..operators.keyed import heavy_keys, keyed_totals
from ..runtime import read_table
from . import queries_ani, queries_sketch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_sketch.QUERIES, **queries_ani.QUERIES}
ORACLE: dict[str, str] = {**queries_sketch.ORACLE, **queries_ani.ORACLE}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 4 -- a few keys holding most records


def _marker_totals(spark: SparkSession, sf: str, entity: str | None) -> DataFrame:
    return keyed_totals(read_table(spark, sf, "markers"), "marker", entity=entity, distinct_on=MARKER_ROW, where=is_marker("marker"))


def _repeat_totals(spark: SparkSession, sf: str, entity: str | None) -> DataFrame:
    return keyed_totals(read_table(spark, sf, "genomes"), "repetitive_kmers", entity=entity, where=F.col("repetitive_kmers") >= 0)


def _named(df: DataFrame, key: str, *cols: str) -> DataFrame:
    return df.select(F.lit(key).alias("key_name"), F.col(key).cast("long").alias("key_value"), *cols)


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values of marker and of repetitive_kmers that hold at least 2.5 % of the rows."""
    return _named(heavy_keys(_marker_totals(spark, sf, None), "marker", 25), "marker").unionByName(_named(heavy_keys(_repeat_totals(spark, sf, None), "repetitive_kmers", 25), "repetitive_kmers"))


@query
def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and genomes of every value of marker and of repetitive_kmers."""
    return _named(_marker_totals(spark, sf, "genome_id"), "marker", "n_rows", "n_entities").unionByName(_named(_repeat_totals(spark, sf, "genome_id"), "repetitive_kmers", "n_rows", "n_entities"))


_M = "(SELECT DISTINCT genome_id, contig_index, pos, marker FROM markers WHERE marker BETWEEN 0 AND 4398046511103)"
_P4 = f"""
SELECT 'marker' AS key_name, marker AS key_value, count(*) AS n_rows, count(DISTINCT genome_id) AS n_entities FROM {_M} GROUP BY marker
UNION ALL
SELECT 'repetitive_kmers', repetitive_kmers, count(*), count(DISTINCT genome_id) FROM genomes WHERE repetitive_kmers >= 0 GROUP BY repetitive_kmers
"""
ORACLE["p4_values"] = _P4
ORACLE["p4_found"] = f"SELECT key_name, key_value FROM (SELECT *, sum(n_rows) OVER (PARTITION BY key_name) AS total FROM ({_P4})) WHERE n_rows * 1000 >= total * 25"
