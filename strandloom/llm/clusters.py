"""Grouping records into clusters of mutually similar records by hierarchical density.

1. Distance of two similar records: how little their neighbourhoods share (one minus
   the Jaccard index of the closed neighbourhoods). Shared neighbours are counted by
   triangles over edges that point to the endpoint of higher degree, so a hub is
   never the middle of a pair of neighbours.
2. Mutual reachability: the larger of the distance and both core distances (distance
   to the `min_points`-th neighbour), exact.
3. Distributed Boruvka: every component takes its smallest edge, trees of chosen edges
   collapse by pointer jumping, edges are relabelled and parallel ones dropped, until
   the contracted graph has at most `FEW_EDGES` edges, which one task can finish. The
   edges of the minimum spanning tree are kept.
4. Condensed hierarchy from the tree edges in order of distance: a component of
   `min_size` or more is born, goes on, or joins others and ends; its stability is its
   size summed over the similarity it spans. Trees of up to `TREE_EDGES` edges are
   dealt to tasks whole; a longer one goes on in blocks of that many edges, after each
   of which only the states of its components are left. Edges of one distance are one
   event, in one block or several.
5. Selection from the top: a cluster stands if it is at least as stable as all below.

No step gathers a component. The rounds are written to the shared folder and so
survive lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace
from .ranking import ranked

#: Contracted edges that one task may join to trees, and tree edges of which one task builds a hierarchy.
FEW_EDGES, TREE_EDGES = 100_000, 500_000


def similarity_graph(pairs: DataFrame, a: str, b: str, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """``nodes (id, name, degree)`` and ``edges (x, y)`` with x < y; ids ascend by degree, then name."""
    x, y = F.least(a, b), F.greatest(a, b)
    named = space.save(pairs.filter(F.col(a) != F.col(b)).select(x.alias("a"), y.alias("b")).distinct())
    degree = named.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    nodes = space.save(degree.orderBy("degree", "name").select(F.monotonically_increasing_id().alias("id"), "name", "degree"))
    e = named.join(nodes.select(F.col("name").alias("a"), F.col("id").alias("ia")), "a").join(nodes.select(F.col("name").alias("b"), F.col("id").alias("ib")), "b")
    return nodes, space.save(e.select(F.least("ia", "ib").alias("x"), F.greatest("ia", "ib").alias("y")))


def reachability(nodes: DataFrame, edges: DataFrame, min_points: int) -> DataFrame:
    """``(x, y, d)``: mutual reachability of every edge, from 0 to 1."""
    second = edges.select("x", F.col("y").alias("z"))
    wedges = edges.join(second, "x").filter("y < z")
    triangles = wedges.join(edges.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"])
    sides = F.array(F.struct("x", "y"), F.struct("x", F.col("z").alias("y")), F.struct(F.col("y").alias("x"), F.col("z").alias("y")))
    shared = triangles.select(F.explode(sides).alias("e")).groupBy("e.x", "e.y").agg(F.count(F.lit(1)).alias("t"))
    deg = nodes.select("id", "degree")
    d = edges.join(shared, ["x", "y"], "left").join(deg.withColumnsRenamed({"id": "x", "degree": "dx"}), "x").join(deg.withColumnsRenamed({"id": "y", "degree": "dy"}), "y")
    common = F.coalesce("t", F.lit(0)) + 2  # each is in its own neighbourhood and the other's
    d = d.select("x", "y", (1 - common / (F.col("dx") + F.col("dy") + 2 - common)).alias("d"))
    ends = d.select(F.explode(F.array("x", "y")).alias("v"), "d")
    near = ends.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d"))).filter(F.col("r") <= min_points)
    core = near.groupBy("v").agg(F.max("d").alias("core"))
    m = d.join(core.withColumnsRenamed({"v": "x", "core": "cx"}), "x").join(core.withColumnsRenamed({"v": "y", "core": "cy"}), "y")
    return m.select("x", "y", F.greatest("d", "cx", "cy").alias("d"))


def _roots(parents: DataFrame, space: Workspace) -> DataFrame:
    """``(c, root)`` of a forest of pointers (c, p) in which two nodes may point at each other."""
    up = parents.select(F.col("c").alias("p"), F.col("p").alias("q"))
    now = space.save(parents.join(up, "p", "left").select("c", F.when((F.col("q") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
    while True:
        # three times, pointers double their length; the last time shows whether any is still under way
        jump = now.select("c", "p")
        for _ in range(3):
            up = jump.select(F.col("c").alias("p"), F.col("p").alias("q"))
            jump = jump.select("c", "p").join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("p").alias("was"))
        jump = space.save(jump)
        space.drop(now)
        now = jump
        if jump.filter("p <> was").isEmpty():
            return jump.select("c", F.col("p").alias("root"))


def _forest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kruskal over the contracted edges (a, b, d, x, y) of one task: tree edges, and the root of every component."""
    e = pd.concat(list(it) or [pd.DataFrame(columns=["a", "b", "d", "x", "y"])]).sort_values(["d", "x", "y"], kind="stable")
    up: dict[int, int] = {}

    def find(c: int) -> int:
        while (p := up.setdefault(c, c)) != c:
            up[c] = c = up[p]
        return c

    keep = []
    for i, (a, b) in enumerate(zip(e["a"].tolist(), e["b"].tolist())):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(i)
    t = e.iloc[keep]
    yield pd.DataFrame({"c": None, "root": None, "x": t["x"], "y": t["y"], "d": t["d"]}).astype({"c": "Int64", "root": "Int64"})
    yield pd.DataFrame({"c": list(up), "root": [find(c) for c in list(up)], "x": None, "y": None, "d": None}).astype({"x": "Int64", "y": "Int64", "d": "float64"})


def spanning_forest(weighted: DataFrame, space: Workspace, few: int = FEW_EDGES) -> DataFrame:
    """``(tree, x, y, d)``: the edges of the minimum spanning trees of ``(x, y, d)``, in order of (d, x, y), with a number of their tree."""
    edges = space.save(weighted.select(F.col("x").alias("a"), F.col("y").alias("b"), "d", "x", "y"))
    chosen, maps = [], []
    n = edges.count()
    while n:
        if maps and n <= few:
            rest = space.save(edges.coalesce(1).mapInPandas(_forest, "c long, root long, x long, y long, d double"))
            chosen.append(rest.filter("x IS NOT NULL").select("x", "y", "d"))
            maps.append(rest.filter("c IS NOT NULL").select("c", "root"))
            break
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("p"), "d", "x", "y"), F.struct(F.col("b").alias("c"), F.col("a").alias("p"), "d", "x", "y"))).alias("e")).select("e.*")
        first = space.save(both.groupBy("c").agg(F.min(F.struct("d", "x", "y", "p")).alias("m")).select("c", "m.*"))
        chosen.append(first.select("x", "y", "d").distinct())
        roots = _roots(first.select("c", "p"), space)
        maps.append(roots)
        here = edges.join(roots.withColumnsRenamed({"c": "a", "root": "ra"}), "a").join(roots.withColumnsRenamed({"c": "b", "root": "rb"}), "b").filter("ra <> rb")
        here = here.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), F.struct("d", "x", "y").alias("e"))
        left = space.save(here.groupBy("a", "b").agg(F.min("e").alias("e")).select("a", "b", "e.*"))  # the first of parallel ones
        space.drop(edges)
        edges, n = left, left.count()
    tree = reduce(DataFrame.unionByName, chosen, weighted.sparkSession.createDataFrame([], "x long, y long, d double")).withColumn("tree", F.col("x"))
    for m in maps:  # a component without edges to others is in no later map
        tree = tree.join(m.select(F.col("c").alias("tree"), "root"), "tree", "left").select(F.coalesce("root", "tree").alias("tree"), "x", "y", "d")
    return space.save(tree)


class Hierarchy:
    """Condensed hierarchy of a forest whose edges come in order of distance.

    A component is known by a label; its state is [size, cluster (None while small),
    stability so far, worth of the clusters below, distance since which these hold,
    records while small]. While more edges of one distance may follow, a label has the
    states of all that they have joined so far, and ``at`` the distance.
    """

    def __init__(self, min_size: int, number: int):
        self.min_size, self.number = min_size, number
        self.up: dict[int, int] = {}
        self.state: dict[int, list[list]] = {}
        self.at: dict[int, float] = {}
        self.came: list[tuple[int, int, float]] = []  # record, cluster, distance at which it came in
        self.ended: list[tuple[int, int | None, float, float]] = []  # cluster, parent, stability, below; parents last

    def find(self, c: int) -> int:
        up = self.up
        while (p := up.setdefault(c, c)) != c:
            up[c] = c = up[p]
        return c

    def add(self, a: list[int], b: list[int], d: list[float], more: float | None = None) -> None:
        """Join the ends of edges; those of one distance are one event, which is not over if the next edge to be added has that distance (``more``)."""
        i, n = 0, len(d)
        while i < n:
            now, parts = d[i], {}
            while i < n and d[i] == now:
                x, y = self.find(a[i]), self.find(b[i])
                if x != y:
                    px, py = parts.pop(x, [x]), parts.pop(y, [y])
                    if len(px) < len(py):
                        px, py, x, y = py, px, y, x
                    self.up[y] = x
                    px.extend(py)
                    parts[x] = px
                i += 1
            for root, old in parts.items():
                joined = [s for c in old for s in self.parts(c, now)]
                if i < n or now != more:
                    self.merge(root, joined, now)
                else:
                    small = [s for s in joined if s[1] is None]
                    both = [sum(s[0] for s in small), None, 0.0, 0.0, now, [i for s in small for i in s[5]]]
                    self.state[root] = [s for s in joined if s[1] is not None] + [both] * bool(small)
                    self.at[root] = now

    def parts(self, c: int, now: float) -> list[list]:
        """What a component brings to an event: one state, or more if it is in this event already."""
        at = self.at.pop(c, None)
        if at is not None and at < now:
            self.merge(c, self.state.pop(c), at)
        return self.state.pop(c, None) or [[1, None, 0.0, 0.0, now, [c]]]

    def merge(self, root: int, old: list[list], d: float) -> None:
        size, small = sum(s[0] for s in old), [i for s in old for i in s[5]]
        kids = [s for s in old if s[1] is not None]
        for s in kids:
            s[2] += s[0] * (d - s[4])
        if size < self.min_size:
            self.state[root] = [[size, None, 0.0, 0.0, d, small]]
            return
        if len(kids) == 1:
            cluster, stability, below = kids[0][1:4]
        else:
            self.number += 1
            cluster, stability, below = self.number, 0.0, fsum(max(s[2], s[3]) for s in kids)  # in any order
            self.ended.extend((s[1], cluster, s[2], s[3]) for s in kids)
        self.came.extend((i, cluster, d) for i in small)
        self.state[root] = [[size, cluster, stability, below, d, []]]

    def close(self) -> dict[int, int | None]:
        """End what is open at distance 1; the topmost winner among every cluster and those above it."""
        for ((size, cluster, stability, below, since, _),) in self.state.values():
            if cluster is not None:
                self.ended.append((cluster, None, stability + size * (1.0 - since), below))
        top: dict[int, int | None] = {}
        for cluster, parent, stability, below in reversed(self.ended):
            top[cluster] = top.get(parent) or (cluster if round(stability, 9) >= round(below, 9) else None)
        return top


_PARTS = "kind int, tree long, a long, b long, size long, v double, w double, since double, small array<long>, at double"
_MEMBER, _CLUSTER, _STATE, _MAP = range(4)


def _rows(h: Hierarchy, tree: int, whole: bool) -> pd.DataFrame:
    """What a task hands on, rows of ``_PARTS``: member (record, cluster, selected, joined), cluster (cluster, parent, stability, below), and, of a tree that goes on, states and labels."""
    top = h.close() if whole else {}
    out = [(_MEMBER, tree, i, c, top.get(c), d, None, None, None, None) for i, c, d in h.came]
    out += [(_CLUSTER, tree, c, p, top.get(c), s, w, None, None, None) for c, p, s, w in h.ended]
    if not whole:
        out += [(_STATE, tree, label, c, n, s, w, d, small, h.at.get(label)) for label, parts in h.state.items() for n, c, s, w, d, small in parts]
        out += [(_MAP, tree, c, h.find(c), None, None, None, None, None, None) for c in list(h.up)]
    df = pd.DataFrame(out, columns=[c.split()[0] for c in _PARTS.split(", ")])
    return df.astype({"a": "Int64", "b": "Int64", "size": "Int64", "v": "float64", "w": "float64", "since": "float64", "at": "float64"})


def condensed(tree: DataFrame, min_size: int, space: Workspace, task_edges: int = TREE_EDGES) -> tuple[DataFrame, DataFrame]:
    """``members (id, cluster, joined, selected)`` and ``clusters (cluster, parent, stability)`` of spanning trees.

    members: every record that a cluster holds, with the first one that held it, the
    distance at which it came in (small is persistent), and the selected cluster it is
    in, if any.
    """
    sizes = tree.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    long = space.save(sizes.filter(F.col("n") > task_edges))
    short = tree.join(long, "tree", "left_anti")
    buckets = max(1, -(-tree.count() // max(task_edges // 8, 1)))

    def whole(key: tuple, e: pd.DataFrame) -> pd.DataFrame:
        h = Hierarchy(min_size, int(key[0]) << 32)
        e = e.sort_values(["d", "x", "y"], kind="stable")
        h.add(e["x"].tolist(), e["y"].tolist(), e["d"].tolist())
        return _rows(h, int(key[0]), True)

    parts = space.save(short.groupBy(F.pmod(F.xxhash64("tree"), F.lit(buckets)).alias("bucket")).applyInPandas(whole, _PARTS))
    members = parts.filter(F.col("kind") == _MEMBER).select(F.col("a").alias("id"), F.col("b").alias("cluster"), F.col("v").alias("joined"), F.col("size").alias("selected"))
    clusters = parts.filter(F.col("kind") == _CLUSTER).select(F.col("a").alias("cluster"), F.col("b").alias("parent"), F.col("v").alias("stability"))
    if long.isEmpty():
        return members, clusters
    more, up = _long_trees(tree.join(long.select("tree"), "tree"), min_size, space, task_edges, buckets)
    return members.unionByName(more), clusters.unionByName(up)


def _long_trees(tree: DataFrame, min_size: int, space: Workspace, task_edges: int, first_number: int) -> tuple[DataFrame, DataFrame]:
    """The same for trees of more edges than one task takes, in blocks of that many."""
    names = [c.split()[0] for c in _PARTS.split(", ")]
    number = ranked(tree.select("tree").distinct(), [], [F.col("tree")], space).select("tree", (F.col("__pos") + first_number).alias("number"))
    rest = ranked(tree, ["tree"], [F.col("d"), F.col("x"), F.col("y")], space).withColumn("block", F.floor(F.col("__pos") / task_edges)).join(number, "tree")
    after = rest.groupBy("tree", (F.col("block") - 1).alias("block")).agg(F.min("d").alias("more"))
    rest = space.save(rest.join(after, ["tree", "block"], "left").select("tree", "number", "block", F.col("x").alias("a"), F.col("y").alias("b"), "d", "x", "y", "more"))
    states = tree.sparkSession.createDataFrame([], _PARTS)

    def step(key: tuple, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(e):
            return pd.DataFrame(columns=names)
        # an edge ends up to two events of the block before besides its own
        h = Hierarchy(min_size, (int(e["number"].iloc[0]) << 32) + int(e["block"].iloc[0]) * 3 * (task_edges + 1))
        for label, c, n, v, w, since, small, at in zip(s["a"], s["b"], s["size"], s["v"], s["w"], s["since"], s["small"], s["at"]):
            h.state.setdefault(int(label), []).append([int(n), None if pd.isna(c) else int(c), v, w, since, [int(i) for i in small]])
            if not pd.isna(at):
                h.at[int(label)] = at
        e = e.sort_values(["d", "x", "y"], kind="stable")
        h.add(e["a"].tolist(), e["b"].tolist(), e["d"].tolist(), e["more"].iloc[0])
        return _rows(h, int(key[0]), False)

    done, block = [], 0
    while not rest.isEmpty():
        here = rest.filter(F.col("block") == block)
        touched = states.join(here.select(F.explode(F.array("a", "b")).alias("a")).distinct(), "a", "left_semi").select(*names)
        out = space.save(here.groupBy("tree").cogroup(touched.groupBy("tree")).applyInPandas(step, _PARTS))
        done.append(out.filter(F.col("kind") <= _CLUSTER))
        now = out.filter(F.col("kind") == _MAP).select("a", F.col("b").alias("root"))
        left = rest.filter(F.col("block") > block)
        for side in ("a", "b"):
            left = left.join(now.withColumnRenamed("a", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        rest, states = space.save(left), space.save(states.join(now, "a", "left_anti").unionByName(out.filter(F.col("kind") == _STATE)))
        block += 1
    every = space.save(reduce(DataFrame.unionByName, done))
    top = states.filter("b IS NOT NULL").select(F.col("b").alias("cluster"), F.lit(None).cast("long").alias("parent"), (F.col("v") + F.col("size") * (1 - F.col("since"))).alias("stability"), F.col("w").alias("below"))
    clusters = space.save(every.filter(F.col("kind") == _CLUSTER).select(F.col("a").alias("cluster"), F.col("b").alias("parent"), F.col("v").alias("stability"), F.col("w").alias("below")).unionByName(top))
    # The topmost winner among a cluster and those above it, by pointer doubling.
    wins = F.when(F.round("stability", 9) >= F.round("below", 9), F.col("cluster"))
    walk = space.save(clusters.select("cluster", F.col("parent").alias("next"), wins.alias("top")))
    while not walk.filter("next IS NOT NULL").isEmpty():
        up = walk.select(F.col("cluster").alias("next"), F.col("next").alias("n2"), F.col("top").alias("t2"))
        walk = space.save(walk.join(up, "next", "left").select("cluster", F.col("n2").alias("next"), F.coalesce("t2", "top").alias("top")))
    members = every.filter(F.col("kind") == _MEMBER).select(F.col("a").alias("id"), F.col("b").alias("cluster"), F.col("v").alias("joined"))
    members = members.join(walk.select("cluster", F.col("top").alias("selected")), "cluster", "left").select("id", "cluster", "joined", "selected")
    return space.save(members), clusters.select("cluster", "parent", "stability")


def density_clusters(pairs: DataFrame, a: str, b: str, *, min_size: int = 3, min_points: int = 2, few: int = FEW_EDGES, task_edges: int = TREE_EDGES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, tree, members, clusters)`` of the similarity pairs.

    members and clusters are those of ``condensed``. Direction, repeats and self pairs
    make no difference; pairs with a null are dropped; without pairs all are empty.
    """
    space = Workspace(pairs.sparkSession, "density")
    nodes, edges = similarity_graph(pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, space)
    tree = spanning_forest(reachability(nodes, edges, min_points), space, few)
    return nodes, edges, tree, *condensed(tree, min_size, space, task_edges)


#: Outsiders similar to more than one in so many members are in the region of a group.
NEAR = 4


def _moved(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups after single moves within their regions, rows ``(id, cluster)``; an odd cluster takes in before it gives out.

    The links ``(cluster, id, inside, other)`` of the regions come in order of cluster
    and id, with every record as an ``other`` of its own. Only one region is held.
    """
    held: list[list[np.ndarray]] = []

    def region(cluster: int) -> pd.DataFrame:
        ids, inside, other = (np.concatenate(x) for x in zip(*held))
        held.clear()
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ids, inside, other = ids[first], inside[first], np.searchsorted(ids[first], other)
        similar = np.add.reduceat(inside[other].astype("int64"), first) - inside
        near, n, grow = np.split(other, first[1:]), int(inside.sum()), bool(cluster % 2)
        unseen = n // NEAR  # similar members that an outsider beyond the region may have
        while n:
            worst, best = int(np.where(inside, similar, len(ids)).argmin()), int(np.where(inside, -1, similar).argmax())
            most = -1 if inside[best] else int(similar[best])
            fails, enters = 2 * similar[worst] <= n - 1, 2 * most > n
            if (grow or not fails) and 2 * unseen > n and most <= unseen or not fails and not enters:
                break
            v, step = (worst, -1) if fails and not (grow and enters) else (best, 1)
            inside[v] = step > 0
            similar[near[v]] += step
            similar[v] -= step
            n += step
            unseen += step > 0
        return pd.DataFrame({"id": ids[inside], "cluster": np.full(n, cluster)})

    now = None
    for e in it:
        c, out = e["cluster"].to_numpy(), []
        for rows in np.split(np.arange(len(c)), np.flatnonzero(c[1:] != c[:-1]) + 1) if len(c) else []:
            if held and c[rows[0]] != now:
                out.append(region(now))
            now = int(c[rows[0]])
            held.append([e[x].to_numpy()[rows] for x in ("id", "inside", "other")])
        if out:
            yield pd.concat(out)
    if held:
        yield region(now)


def _once(groups: DataFrame) -> DataFrame:
    """The groups, equal ones of one parity once, with their size."""
    marks = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"))
    return groups.join(marks.groupBy("size", "least", "h1", "h2", F.pmod("cluster", F.lit(2))).agg(F.min("cluster").alias("cluster")).select("cluster", "size"), "cluster").select("id", "cluster", "size")


def _settled(groups: DataFrame, around: DataFrame, min_size: int, space: Workspace) -> DataFrame:
    """``(id, cluster, similar, size)`` of the groups of ``min_size`` or more that the given ones ``(id, cluster)`` settle on.

    Each start goes the way of ``_settle``, with either kind of move first. Edges less
    half of all pairs never fall by such a move, and where they stay the group gets
    smaller, so every group settles and no cap is needed.
    A round moves each group as far as its region tells the next move: its members and
    the outsiders similar to more than one in ``NEAR`` of them. It is then checked
    against the whole graph, and goes on in the next round where it was left.
    """
    done = []
    both = groups.select("id", F.explode(F.array(F.col("cluster") * 2, F.col("cluster") * 2 + 1)).alias("cluster"))
    open_ = space.save(_once(both))
    while not open_.isEmpty():
        sizes = open_.groupBy("cluster").agg(F.max("size").alias("size"))
        seen = around.join(open_.select("id", "cluster"), "id").groupBy(F.col("other").alias("id"), "cluster").agg(F.count(F.lit(1)).alias("similar"))
        judged = seen.join(open_.select("id", "cluster", F.lit(True).alias("inside")), ["id", "cluster"], "full").join(sizes, "cluster").withColumn("inside", F.coalesce("inside", F.lit(False))).withColumn("similar", F.coalesce("similar", F.lit(0)))
        judged = judged.filter(F.col("inside") | (F.col("similar") * NEAR > F.col("size")))
        stays = F.col("similar") * 2 > F.when(F.col("inside"), F.col("size") - 1).otherwise(F.col("size"))
        judged = space.save(judged.withColumn("moves", F.bool_or(stays != F.col("inside")).over(Window.partitionBy("cluster"))))
        done.append(judged.filter(~F.col("moves") & F.col("inside") & (F.col("size") >= min_size)).select("id", "cluster", "similar", "size"))
        region = judged.filter("moves").select("cluster", "id", "inside")
        links = region.join(around, "id").join(region.select("cluster", F.col("id").alias("other")), ["cluster", "other"]).select("cluster", "id", "inside", "other")
        links = links.unionByName(region.withColumn("other", F.col("id"))).repartition("cluster").sortWithinPartitions("cluster", "id")
        moved = space.save(links.mapInPandas(_moved, "id long, cluster long"))
        open_ = space.save(_once(moved))
    empty = around.sparkSession.createDataFrame([], "id long, cluster long, similar long, size long")
    return space.save(reduce(DataFrame.unionByName, done, empty))


def _settle(group: set[int], near: dict[int, set[int]], grow: bool) -> frozenset[int]:
    """The group after single moves: the worst failing member out, or the best outsider in; of equal ones the smallest id. ``grow``: in before out."""
    group = set(group)
    similar: dict[int, int] = dict.fromkeys(group, 0)
    for v in group:
        for u in near[v]:
            similar[u] = similar.get(u, 0) + 1
    while group:
        n = len(group)
        out = min(((similar[v], v) for v in group if 2 * similar[v] <= n - 1), default=None)
        into = None if out and not grow else min(((-k, v) for v, k in similar.items() if 2 * k > n and v not in group), default=None)
        if not out and not into:
            break
        leaves = bool(out) and not (grow and into)
        v = (out if leaves else into)[1]
        (group.discard if leaves else group.add)(v)
        for u in near[v]:
            similar[u] = similar.get(u, 0) + (-1 if leaves else 1)
    return frozenset(group)


def component_groups(near: dict[int, set[int]], starts: list[set[int]], min_size: int) -> list[frozenset[int]]:
    """``majority_groups`` of one component, known by the neighbours of its records."""
    def settled(starts) -> set[frozenset[int]]:
        return {g for s in starts for grow in (False, True) if len(g := _settle(s, near, grow)) >= min_size}

    found = settled(starts)
    left = {v for v in near if len(near[v]) * 2 > min_size - 1}
    while True:
        stand, used = [], set()
        for g in sorted(found, key=lambda g: (-len(g), min(g), sorted(g))):
            if used.isdisjoint(g):
                stand.append(g)
                used |= g
        fresh = left - used
        left -= fresh
        hoods = {frozenset(near[v] | {v}) for v in fresh}
        for v in fresh:
            for u in near[v]:
                mine, other = near[v] | {v}, near[u] | {u}
                hoods |= {frozenset(mine & other), frozenset(mine | other)}
        new = settled(hoods) - found
        if not new:
            return stand
        found |= new


def majority_groups(members: DataFrame, edges: DataFrame, tree: DataFrame, *, min_size: int = 3, task_edges: int = TREE_EDGES) -> DataFrame:
    """Exact check of clusters ``(id, cluster)`` against the graph ``edges (x, y)`` with spanning trees ``tree (tree, x, y)``.

    Members that are not similar to more than half of the others leave, records
    outside that are similar to more than half of the group come in, until nothing
    changes; a group that falls below ``min_size`` is none. Of
    groups that share a record the one with more members stands (then the one whose
    least linked member, by name, comes first). Records that are in no group after that start again, each
    from its neighbourhood and from what that shares and makes together with each
    neighbour's, and what comes of it competes too. Gives ``(id, cluster, similar)``.

    Components of up to ``task_edges`` edges are dealt to tasks whole; in larger ones
    the groups are settled as rows, side by side, by the same moves, so they are the same.
    """
    space = Workspace(members.sparkSession, "majority")
    place = tree.select("tree", F.explode(F.array("x", "y")).alias("id")).distinct()
    placed = space.save(edges.join(place.withColumnRenamed("id", "x"), "x"))
    size = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    short = size.filter(F.col("n") <= task_edges).select("tree")
    long = space.save(size.filter(F.col("n") > task_edges).select("tree"))
    starts = members.select("id", "cluster").join(place, "id")
    buckets = max(1, -(-placed.count() // max(task_edges // 32, 1)))
    bucket = F.pmod(F.xxhash64("tree"), F.lit(buckets)).alias("bucket")

    def whole(key: tuple, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        begun: dict[int, dict[int, set[int]]] = {}
        for t, c, i in zip(s["tree"].tolist(), s["cluster"].tolist(), s["id"].tolist()):
            begun.setdefault(t, {}).setdefault(c, set()).add(i)
        rows = []
        for t, g in e.groupby("tree"):
            near: dict[int, set[int]] = {}
            for x, y in zip(g["x"].tolist(), g["y"].tolist()):
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
            for group in component_groups(near, list(begun.get(t, {}).values()), min_size):
                rows += [(v, min(group), len(near[v] & group)) for v in group]
        return pd.DataFrame(rows, columns=["id", "cluster", "similar"])

    few = placed.join(short, "tree").select(bucket, "tree", "x", "y")
    begin = starts.select(bucket, "tree", "id", "cluster")
    # numbered partitions, which are not merged for having few bytes: the work of a bucket is not in its bytes
    few, begin = few.repartition(buckets, "bucket"), begin.repartition(buckets, "bucket")
    done = space.save(few.groupBy("bucket").cogroup(begin.groupBy("bucket")).applyInPandas(whole, "id long, cluster long, similar long"))
    if long.isEmpty():
        return done
    big = placed.join(long, "tree").select("x", "y")
    return done.unionByName(_large_groups(starts.join(long, "tree").select("id", "cluster"), big, min_size, space))


def _large_groups(members: DataFrame, edges: DataFrame, min_size: int, space: Workspace) -> DataFrame:
    """The same where a component is too large for one task; cluster is the smallest member."""
    around = space.save(edges.select(F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("other")), F.struct(F.col("y").alias("id"), F.col("x").alias("other")))).alias("e")).select("e.*"))
    done = _settled(members.distinct(), around, min_size, space)
    stand = _standing(done, space)
    # A member of a group of min_size or more has more than (min_size - 1) / 2 neighbours.
    left = around.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") * 2 > min_size - 1).select("id")
    part = 0
    while True:
        fresh = space.save(left.join(stand.select("id"), "id", "left_anti"))
        if fresh.isEmpty():
            break
        left = space.save(left.join(fresh, "id", "left_anti"))  # every record starts once
        found = _settled(_starts(fresh, edges, around, part, space), around, min_size, space)
        part += 1
        if found.isEmpty():
            break
        done = space.save(done.unionByName(found))
        stand = _standing(done, space)
    return stand.withColumn("cluster", F.min("id").over(Window.partitionBy("cluster")))


def _starts(fresh: DataFrame, edges: DataFrame, around: DataFrame, part: int, space: Workspace) -> DataFrame:
    """``(id, cluster)``: the closed neighbourhood of every record, and what those of both ends of each of its edges share and make together; cluster < 0."""
    own = fresh.select(F.col("id").alias("v"))
    hood = around.select(F.col("id").alias("v"), F.col("other").alias("id")).join(own, "v").unionByName(own.select("v", F.col("v").alias("id")))
    hood = hood.select("id", (-3 - 3 * F.col("v")).alias("cluster"))
    marked = edges.join(own.select(F.col("v").alias("x"), F.lit(True).alias("mx")), "x", "left").join(own.select(F.col("v").alias("y"), F.lit(True).alias("my")), "y", "left").filter("mx OR my")
    number = F.lit(part) * F.lit(1 << 52) + 3 * F.monotonically_increasing_id() + 4
    marked = space.save(marked.select("x", "y", (-number).alias("cluster")))
    ends = marked.select("cluster", F.explode(F.array("x", "y")).alias("id"))
    each = ends.join(around, "id").select("cluster", F.col("other").alias("id")).unionByName(ends).groupBy("cluster", "id").agg(F.count(F.lit(1)).alias("n"))
    # an end counts once for itself and once as the other's neighbour
    return hood.unionByName(each.filter("n = 2").select("id", "cluster")).unionByName(each.select("id", (F.col("cluster") - 1).alias("cluster")))


def _standing(done: DataFrame, space: Workspace) -> DataFrame:
    """Competition: the groups that are first choice of all their members stand; what they take is struck."""
    key = done.groupBy("cluster").agg((-F.count(F.lit(1))).alias("n"), F.min("id").alias("least"), F.array_sort(F.collect_list("id")).alias("ids"))
    # groups of one size and least member in order of their members; equal ones by number, so that one of them stands
    key = key.withColumn("tie", F.row_number().over(Window.partitionBy("n", "least").orderBy("ids", "cluster")))
    done = space.save(done.join(key.select("cluster", F.struct("n", "least", "tie").alias("rank")), "cluster"))
    stand = None
    while True:
        first = done.groupBy("id").agg(F.min("rank").alias("first"))
        lost = done.join(first, "id").filter("rank <> first").select("cluster").distinct()
        won = space.save(done.join(lost, "cluster", "left_anti"))
        stand = won if stand is None else space.save(stand.unionByName(won))
        rest = done.join(won.select("cluster").distinct(), "cluster", "left_anti")
        struck = rest.join(won.select("id").distinct(), "id", "left_semi").select("cluster").distinct()
        done = space.save(rest.join(struck, "cluster", "left_anti"))
        if done.isEmpty():
            return stand.select("id", "cluster", "similar")
