"""Most frequent items among billions of rows: a three-phase threshold top-k.

The rows are dealt to nodes; each node keeps the counts of its own rows in a
spilling hash aggregate. Where rows sent again count once, all rows are first dealt by
the columns in which they agree, which is one exchange of them; after that, and
without that condition from the start, only leaders travel:

1. every node sends its k largest local counts; the k-th largest sum is a lower
   bound for the k-th count;
2. every node sends the items whose local count reaches an equal share of that
   bound; an item that no node sends cannot be among the first k. Upper bounds
   (sum sent + what silent nodes may still hold) prune the rest;
3. the counts of the few survivors are looked up on all nodes and summed exactly.

Memory is bounded by the aggregate's pages and by nodes * leaders, never by the
number of distinct items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace, shuffle_partitions


def local_counts(df: DataFrame, item: str, distinct_on: Sequence[str] | None, nodes: int) -> DataFrame:
    """``(node, item, n)``: one exchange, then both folds stay within a node.

    Rows that agree in ``distinct_on`` land on one node and count once. The node is
    drawn from all these columns, so neither a hot item nor a hot source is on one.
    """
    cols = list(dict.fromkeys([item, *(distinct_on or [])]))
    if not distinct_on:
        # No repeats to find: a first fold before the exchange, in shares that follow the input splits.
        dealt = df.select(item, F.pmod(F.spark_partition_id(), F.lit(nodes)).alias("node"))
        return dealt.groupBy("node", item).agg(F.count(F.lit(1)).alias("n"))
    dealt = df.select(*cols).withColumn("node", F.pmod(F.xxhash64(*cols), F.lit(nodes)).cast("int"))
    once = dealt.repartitionById(nodes, "node").groupBy("node", *cols).agg(F.lit(1).alias("one"))
    return once.groupBy("node", item).agg(F.count(F.lit(1)).alias("n"))


def threshold_topk(df: DataFrame, item: str, k: int, *, distinct_on: Sequence[str] | None = None, nodes: int | None = None) -> DataFrame:
    """``(item, n_rows, rank)`` of the k items with most rows, exactly.

    Null items do not count. Equal counts: the smaller item first. Fewer than k
    items: all of them; an empty table gives no rows. Columns other than ``item``
    and ``distinct_on`` are pruned, whatever their names.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = df.sparkSession
    nodes = nodes or shuffle_partitions(spark)
    counts = Workspace(spark, "topk").save(local_counts(df.filter(F.col(item).isNotNull()), item, distinct_on, nodes))

    def bound(sums: DataFrame) -> int:
        """The k-th largest sum; 0 if there are fewer."""
        row = sums.orderBy(F.desc("n")).limit(k).agg(F.count(F.lit(1)), F.min("n")).first()
        return int(row[1]) if row[0] == k else 0

    lead = Window.partitionBy("node").orderBy(F.desc("n"), item)
    leaders = counts.withColumn("r", F.row_number().over(lead)).filter(F.col("r") <= k)
    first = bound(leaders.groupBy(item).agg(F.sum("n").alias("n")))
    share = max(1, -(-first // nodes))  # a count of at least `first` has this much on some node
    sent = counts.filter(F.col("n") >= share).groupBy(item).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("heard"))
    second = bound(sent)
    alive = sent.filter(F.col("n") + (nodes - F.col("heard")) * (share - 1) >= second).select(item)
    exact = counts.join(alive, item, "left_semi").groupBy(item).agg(F.sum("n").alias("n_rows"))
    top = exact.orderBy(F.desc("n_rows"), item).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_rows"), item)))  # k rows
