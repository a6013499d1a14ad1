"""Filling containers with items under several limits at once: vector bin packing.

An item is a vector (tokens, segments, loss-bearing tokens), a container a vector of
limits. The open container takes, again and again, the item that fits and has the
largest dot product with the room left in it, each dimension in shares of its
limit. Items are dealt to shards of a bounded number of items, so each task packs a
bounded set and leaves at most a container or two of each shard part empty.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace

SHARD_ITEMS = 20_000


def dot_product_fill(items: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item (row). An item beyond a limit opens a container in which nothing else fits."""
    kinds, kind = np.unique(-items, axis=0, return_inverse=True)  # the largest first dimension first
    kinds, kind = -kinds, kind.reshape(-1)
    left = np.bincount(kind, minlength=len(kinds))
    queue = np.argsort(kind, kind="stable")  # items by kind, in order
    at = np.append(0, np.cumsum(left))[:-1].copy()
    where = np.full(len(items), -1, np.int64)
    bin, f, gone = 0, 0, 0
    falling, share = -kinds[:, 0], kinds / limits
    while True:
        while f < len(left) and left[f] == 0:
            f += 1
        if f == len(left):
            return where
        if gone * 2 > len(left):  # kinds used up are left out of the search
            some = left > 0
            kinds, left, at, falling, share, f, gone = kinds[some], left[some], at[some], falling[some], share[some], 0, 0
        room, k = limits.astype(float).copy(), f
        while True:
            where[queue[at[k]]] = bin
            at[k] += 1
            left[k] -= 1
            gone += left[k] == 0
            room -= kinds[k]
            lo = max(f, int(np.searchsorted(falling, -room[0])))  # kinds before take more room than is left
            fits = (left[lo:] > 0) & (kinds[lo:, 1:] <= room[1:]).all(axis=1)
            if not fits.any():
                break
            k = lo + int(np.where(fits, share[lo:] @ (room / limits), -1.0).argmax())
        bin += 1


def pack(
    items: DataFrame,
    id: str,
    tokens: str,
    capacities: Sequence[int],
    *,
    loss: str | None = None,
    loss_share: float = 1.0,
    tokens_per_segment: int = 16,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """``(capacity_tokens, id, piece, first_token, n_tokens, n_loss, container_id)``.

    For each capacity, every item is placed whole; only one that exceeds the capacity
    is split, into full containers and a rest that is packed like any item.
    loss: column with the number of loss-bearing tokens of an item, which are its last
        ones (an answer after its prompt); without it, all but the first.
    A container of c tokens holds at most c tokens, max(1, c // tokens_per_segment)
    segments and c * loss_share loss-bearing tokens; a piece that has more of these
    has a container to itself. Items of null, zero or negative size come out with a
    null container, null or negative loss counts as 0, more than the size as the size.
    Items are known by id: rows that repeat an id are pieces of their own. Without
    capacities or items there are no rows.
    """
    spark = items.sparkSession
    caps = sorted({int(c) for c in capacities if c is not None and c > 0})
    cap = F.explode(F.array(*[F.lit(c) for c in caps])) if caps else F.explode(F.array().cast("array<int>"))
    n = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    given = n - 1 if loss is None else F.coalesce(F.col(loss).cast("long"), F.lit(0))
    sized = items.select(F.col(id).alias("id"), n.alias("n"), F.least(F.greatest(given, F.lit(0)), n).alias("loss"))
    sized = Workspace(spark, "pack").save(sized)
    shards = max(1, -(-sized.count() // shard_items))
    each = sized.select("id", "n", "loss", cap.alias("cap"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / F.col("cap")) - 1, F.lit(0).cast("long")))
    each = each.select("*", F.explode(pieces).alias("piece")).withColumn("first", F.col("piece") * F.col("cap")).withColumn("size", F.least(F.col("cap"), F.col("n") - F.col("first")))
    each = each.withColumn("loss", F.least(F.col("size"), F.greatest(F.col("first") + F.col("size") - (F.col("n") - F.col("loss")), F.lit(0))))
    whole = (F.col("size") == F.col("cap")) | (F.col("size") <= 0)
    # A full container needs no packing: its id is made of its item's.
    full = each.filter(whole).select(F.col("cap").alias("capacity_tokens"), "id", "piece", F.col("first").alias("first_token"), F.col("size").alias("n_tokens"), F.col("loss").alias("n_loss"), F.when(F.col("size") > 0, F.concat_ws("-", F.lit("f"), "id", "piece")).alias("container_id"))
    shard = F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int")
    rest = each.filter(~whole).withColumn("shard", shard)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, s = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
        size, bear = pdf["size"].to_numpy(np.int64), pdf["loss"].to_numpy(np.int64)
        vectors = np.stack([size, np.ones(len(size), np.int64), bear], axis=1)
        bins = dot_product_fill(vectors, np.array([c, max(1, c // tokens_per_segment), max(1, int(c * loss_share))]))
        return pd.DataFrame({"capacity_tokens": np.int32(c), "id": pdf["id"], "piece": pdf["piece"], "first_token": pdf["first"], "n_tokens": size, "n_loss": bear, "container_id": [f"s{s}-{b}" for b in bins]})

    kind = dict(sized.dtypes)["id"]
    packed = rest.groupBy("cap", "shard").applyInPandas(fill, f"capacity_tokens int, id {kind}, piece long, first_token long, n_tokens long, n_loss long, container_id string")
    return full.unionByName(packed).withColumnRenamed("id", id)
