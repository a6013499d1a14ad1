"""One group identifier for everything linked directly or through others: hash-to-min.

State: rows (v, u), "u is in the cluster set of v". In each round v sends its set to
the smallest member m of the set, and m to every member. When no row changes, the
smallest vertex of a component holds the whole set and every other vertex holds
only that smallest vertex. Sets are kept as rows, never as arrays. The few vertices
that hold very many of the rows are joined with their smallest member by broadcast, so
the set of a component with a third of all vertices stays spread over the tasks that
read it; the rest is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace

#: A vertex is hot if it holds so many rows, and more than one in so many of all: no more vertices than that can be.
HOT_ROWS, HOT_VERTICES = 100_000, 4096


def hash_to_min(pairs: DataFrame, a: str, b: str, *, max_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(node, group_id)`` for every value that occurs in a pair; group_id is the smallest of its group.

    Direction, repeats and self pairs make no difference; a value with only self
    pairs is a group of one; a pair with a null is no link, but its other end is a
    node. Empty input gives no rows. Further columns are pruned.
    """
    spark = pairs.sparkSession
    space = Workspace(spark, "hash-to-min")
    both = pairs.select(F.col(a).alias("v"), F.col(b).alias("u"))
    links = both.filter("v IS NOT NULL AND u IS NOT NULL")
    loops = F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))
    lone = both.filter("(v IS NULL) <> (u IS NULL)").select(F.coalesce("v", "u").alias("v"), F.coalesce("v", "u").alias("u"))
    state = links.select(F.explode(loops).alias("p")).select("p.v", "p.u").unionByName(lone).distinct()
    state = space.save(state)
    mark = _fingerprint(state)
    for _ in range(max_rounds):
        seen = _with_least(state, mark[0], hot_rows, space)
        # m receives every u of the set, every u receives m; m is a member of its own set
        sent = F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        new = space.save(seen.distinct().select(F.explode(sent).alias("p")).select("p.v", "p.u").distinct())
        now = _fingerprint(new)
        space.drop(state)
        state = new
        if now == mark:
            return state.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("group_id"))
        mark = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _with_least(state: DataFrame, rows: int, hot_rows: int, space: Workspace) -> DataFrame:
    """``(u, m)`` of every row (v, u), m being the smallest member of v's set."""
    least = state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    if rows < hot_rows:  # no vertex can be hot
        return state.join(least, "v").select("u", "m")
    least = space.save(least)
    hot = F.col("n") >= max(hot_rows, rows // HOT_VERTICES)
    marked = state.join(F.broadcast(least.filter(hot).select("v", F.col("m").alias("h"))), "v", "left")
    return marked.filter("h IS NOT NULL").select("u", F.col("h").alias("m")).unionByName(marked.filter("h IS NULL").select("v", "u").join(least.filter(~hot), "v").select("u", "m"))


def _fingerprint(state: DataFrame) -> tuple:
    """Order-free digest of a state: rows and two independent sums of row hashes."""
    h = F.xxhash64("v", "u")
    return tuple(state.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(F.hash("v", "u"), F.lit(1 << 30)).cast("long"))).first())
