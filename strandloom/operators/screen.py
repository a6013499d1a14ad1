"""Screening: which pairs of genomes share enough markers to be compared.

Markers that nearly every genome has would make a join on markers quadratic. For
genomes that need t shared markers, the rarest n - t + 1 of the smaller one's n
markers must already contain one that is shared; only those are joined and counted
by pair. The t - 1 frequent ones that are left are looked up for the candidate pairs
that can still reach t. Nowhere does a pair carry a whole set of markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MARKER_K, MARKER_K_AA, RESCUE_MARKERS
from ..runtime import Workspace


def marker_index(markers: DataFrame) -> DataFrame:
    """``(marker, n_genomes, first_genome, last_genome)``: the inverted index, summed up per marker."""
    return markers.groupBy("marker").agg(F.count(F.lit(1)).alias("n_genomes"), F.min("genome_id").alias("first_genome"), F.max("genome_id").alias("last_genome"))


def threshold(smaller: Column, identity: float, aa: bool) -> Column:
    """floor(identity^k * smaller set), at least 1."""
    share = identity ** (MARKER_K_AA if aa else MARKER_K)
    return F.greatest(F.floor(F.lit(share) * smaller), F.lit(1)).cast("long")


def _ranked(markers: DataFrame, freq: DataFrame, identity: float, aa: bool, indexed: bool, space: Workspace) -> DataFrame:
    """One row per genome: how many markers, how many a pair of which it is the smaller needs, and its rare and frequent ones."""
    m = markers.join(freq, "marker").groupBy("genome_id").agg(F.sort_array(F.collect_list(F.struct("n_genomes", "marker"))).alias("m"))
    n = F.size("m")
    need = threshold(n, identity, aa) + (1 if indexed else 0)
    rare = F.greatest(n - need + 1, F.lit(0)).cast("int")
    return space.save(m.select("genome_id", n.alias("n"), need.alias("need"), F.slice("m.marker", 1, rare).alias("rare"), F.slice("m.marker", rare + 1, n).alias("frequent")))


def _counted(small: DataFrame, large: DataFrame, fits: Column, space: Workspace) -> DataFrame:
    """``(small_id, large_id, shared)`` of the pairs that share enough; ``fits`` says which genome of a pair is the smaller."""
    known = large.select(F.explode(F.concat("rare", "frequent")).alias("marker"), F.col("genome_id").alias("large_id"), F.col("n").alias("large_n"))
    rare = small.select(F.explode("rare").alias("marker"), F.col("genome_id").alias("small_id"), F.col("n").alias("small_n"))
    begun = rare.join(known, "marker").filter(fits).groupBy("small_id", "large_id").agg(F.count(F.lit(1)).alias("shared"))
    rest = small.select(F.col("genome_id").alias("small_id"), "need", "frequent")
    begun = space.save(begun.join(rest, "small_id").filter(F.col("shared") + F.size("frequent") >= F.col("need")).select("small_id", "large_id", "shared", "need"))
    more = begun.select("small_id", "large_id").join(rest, "small_id").select("small_id", "large_id", F.explode("frequent").alias("marker"))
    more = more.join(known.select("large_id", "marker"), ["large_id", "marker"]).groupBy("small_id", "large_id").agg(F.count(F.lit(1)).alias("more"))
    whole = begun.join(more, ["small_id", "large_id"], "left").withColumn("shared", F.col("shared") + F.coalesce("more", F.lit(0)))
    return whole.filter(F.col("shared") >= F.col("need")).select("small_id", "large_id", "shared")


def screen_pairs(queries: DataFrame, refs: DataFrame, *, identity: float, aa: bool = False, indexed: bool = True, rescue: bool = False, query_genomes: DataFrame | None = None, ref_genomes: DataFrame | None = None, triangle: bool = False) -> DataFrame:
    """``(query_id, ref_id, shared)`` of the pairs that pass.

    queries, refs: ``(genome_id, marker)``, distinct. indexed: pairs need more than the
    threshold, otherwise at least it. triangle: both sides are one collection and only
    query_id < ref_id by code point comes out. rescue: a query with fewer than 20
    markers (or, if not indexed, either side) passes against every genome of the
    other side given in ``*_genomes``; these are few, and their pairs are asked for.
    A genome without markers passes only by rescue.
    """
    space = Workspace(queries.sparkSession, "screen")
    both = refs if triangle else queries.unionByName(refs)
    freq = both.groupBy("marker").agg(F.count(F.lit(1)).alias("n_genomes"))
    r = _ranked(refs, freq, identity, aa, indexed, space)
    smaller, same = F.col("small_n") < F.col("large_n"), F.col("small_n") == F.col("large_n")
    if triangle:
        found = _counted(r, r, smaller | same & (F.col("small_id") < F.col("large_id")), space)
        out = found.select(F.least("small_id", "large_id").alias("query_id"), F.greatest("small_id", "large_id").alias("ref_id"), "shared")
    else:
        q = _ranked(queries, freq, identity, aa, indexed, space)
        by_query, by_ref = _counted(q, r, smaller | same, space), _counted(r, q, smaller, space)
        out = by_query.select(F.col("small_id").alias("query_id"), F.col("large_id").alias("ref_id"), "shared").unionByName(by_ref.select(F.col("large_id").alias("query_id"), F.col("small_id").alias("ref_id"), "shared"))
    if not rescue:
        return out
    few = F.coalesce("n_markers", F.lit(0)) < RESCUE_MARKERS
    qg = query_genomes.select(F.col("genome_id").alias("query_id"), few.alias("q_few"))
    rg = ref_genomes.select(F.col("genome_id").alias("ref_id"), few.alias("r_few"))
    lost = qg.filter("q_few").join(rg, F.col("query_id") < F.col("ref_id") if triangle else F.lit(True)).select("query_id", "ref_id")
    if not indexed:
        lost = lost.unionByName(qg.filter("NOT q_few").join(rg.filter("r_few"), F.lit(True)).select("query_id", "ref_id"))
    return out.unionByName(lost.join(out, ["query_id", "ref_id"], "left_anti").withColumn("shared", F.lit(None).cast("long")))
