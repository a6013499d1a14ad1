"""Components and density clusters against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm.clusters import _settled, condensed, density_clusters, majority_groups, spanning_forest
from strandloom.llm.components import hash_to_min
from strandloom.runtime import Workspace

SCHEMA = "a string, b string"


def groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        elif a or b:
            find(a or b)
    return {x: find(x) for x in up}


def test_hash_to_min(spark):
    rnd = random.Random(1)
    pairs = [(f"n{rnd.randint(0, 150):03}", f"n{rnd.randint(0, 150):03}") for _ in range(90)]
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(80)]  # a chain and a star
    pairs += [("self", "self"), (None, "lone"), ("lone2", None), (None, None)] + pairs[:20]
    df = spark.createDataFrame(pairs, SCHEMA).withColumn("v", F.lit(1)).withColumn("u", F.lit("x"))
    want = groups(pairs) | {"self": "self"}
    assert {r.node: r.group_id for r in hash_to_min(df, "a", "b").collect()} == want
    assert {r.node: r.group_id for r in hash_to_min(df, "a", "b", hot_rows=40).collect()} == want  # hot vertices broadcast
    assert hash_to_min(df.limit(0), "a", "b").count() == 0


def neighbours(pairs):
    adj = {}
    for a, b in pairs:
        if a and b and a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    return adj


def is_group(c, adj):
    return len(c) >= 3 and all(2 * len(adj[v] & c) > len(c) - (v in c) for v in c) and not any(2 * len(adj[v] & c) > len(c) for v in adj if v not in c)


def competing(groups, adj):
    """The larger first; of equal ones that with the smallest member by (links, name)."""
    out, used = [], set()
    for g in sorted(groups, key=lambda g: (-len(g), sorted((len(adj[v]), v) for v in g))):
        if used.isdisjoint(g):
            out.append(g)
            used |= g
    return set(out)


def all_groups(adj):
    """The groups of a small graph by the definition, out of all subsets."""
    return competing((g for k in range(3, len(adj) + 1) for g in map(frozenset, itertools.combinations(adj, k)) if is_group(g, adj)), adj)


def found(spark, pairs, hierarchy=True, **sizes):
    df = pairs if not isinstance(pairs, list) else spark.createDataFrame(pairs, SCHEMA)
    nodes, edges, tree, members, _ = density_clusters(df, "a", "b", **sizes)
    starts = members.filter("selected IS NOT NULL" if hierarchy else "false").select("id", F.col("selected").alias("cluster"))
    got = majority_groups(starts, edges, tree, **{k: v for k, v in sizes.items() if k == "task_edges"}).join(nodes, "id")
    got = got.groupBy("cluster").agg(F.collect_set("name").alias("n")).collect()
    out = [frozenset(r.n) for r in got]
    assert len(out) == len(set(out)) and sum(map(len, out)) == len(frozenset().union(*out))
    return set(out)


#: Everything in tasks, or every step in rows, as for components that no task takes.
SIZES = [{}, {"few": 0, "task_edges": 25}]


@pytest.mark.parametrize("sizes", SIZES)
def test_clusters_with_bridges(spark, sizes):
    rnd = random.Random(4)
    pairs, blocks = set(), []
    for g, size in enumerate([3, 4, 5, 7, 12, 25, 3, 8]):
        names = [f"f{g}_{i:02}" for i in range(size)]
        blocks.append(names)
        for i in range(size):
            for j in range(i):
                if size < 6 or rnd.random() < 0.85:
                    pairs.add((names[i], names[j]))
    for _ in range(9):
        x, y = rnd.sample(blocks, 2)
        pairs.add((rnd.choice(x), rnd.choice(y)))
    pairs.add(("pair1", "pair2"))
    rows = list(pairs) + [(b, a) for a, b in list(pairs)[:30]] + [("f0_00", "f0_00"), (None, "f0_01")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(0)).withColumn("cluster", F.lit("clash"))
    assert found(spark, df, **sizes) == {frozenset(b) for b in blocks if is_group(set(b), neighbours(pairs))}


def tree_weight(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for d, x, y in sorted(edges):
        a, b = find(x), find(y)
        if a != b:
            up[a] = b
            out.append((d, x, y))
    return out


@pytest.mark.parametrize("few", [0, 1000])
def test_spanning_forest_is_that_of_kruskal(spark, few):
    rnd = random.Random(few)
    edges = {(x, y): rnd.choice([0.1, 0.2, 0.25, 0.7]) for x, y in {tuple(sorted(rnd.sample(range(80), 2))) for _ in range(150)}} | {(100 + i, 101 + i): i / 99 for i in range(60)}
    df = spark.createDataFrame([(x, y, d) for (x, y), d in edges.items()], "x long, y long, d double")
    tree = spanning_forest(df, Workspace(spark, "t"), few).collect()
    want = tree_weight([(d, x, y) for (x, y), d in edges.items()])
    assert sorted((r.d, r.x, r.y) for r in tree) == want
    parts = groups([(r.x, r.y) for r in tree])
    assert len({r.tree for r in tree}) == len(set(parts.values())) == len({(r.tree, parts[r.x]) for r in tree})


def test_hierarchy_in_blocks_is_that_of_whole_trees(spark):
    rnd = random.Random(3)
    rows = [(1, i, rnd.randrange(i), rnd.choice([0.0, 0.1, 0.3, 0.5, 0.8])) for i in range(1, 120)] + [(2, 200, 201, 0.5), (3, 300, 301, 0.1), (3, 301, 302, 0.1)]
    tree = spark.createDataFrame(rows, "tree long, x long, y long, d double")
    out = []
    for task_edges in (1000, 40):
        members, clusters = condensed(tree, 3, Workspace(spark, "t"), task_edges)
        m = members.toPandas()
        chosen = {frozenset(g.id) for _, g in m[m.selected.notna()].groupby("selected")}
        out.append((sorted((r.id, round(r.joined, 9)) for r in m.itertuples()), chosen, sorted(round(r.stability, 6) for r in clusters.filter("stability > 0").collect())))
    assert out[0] == out[1] and len(out[0][1]) > 1 and len(out[0][2]) > 3


@pytest.mark.parametrize("sizes", [{}, {"task_edges": 8}])
def test_noisy_small_graphs_against_all_subsets(spark, sizes):
    pairs, want = [], set()
    for seed in range(240):
        rnd = random.Random(seed)
        n, p = rnd.randint(6, 9), rnd.choice([0.3, 0.4, 0.5, 0.6, 0.7])
        mine = [(f"g{seed:03}_{i}", f"g{seed:03}_{j}") for i in range(n) for j in range(i) if rnd.random() < p]
        pairs += mine
        want |= all_groups(neighbours(mine))
    got = found(spark, pairs, **sizes)
    adj = neighbours(pairs)
    assert all(is_group(g, adj) for g in got)
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got), (len(want), len(got), len(got & want))


def test_no_pairs(spark):
    nodes, edges, tree, members, clusters = density_clusters(spark.createDataFrame([], SCHEMA), "a", "b")
    assert [x.count() for x in (nodes, edges, tree, members, clusters)] == [0] * 5
    assert majority_groups(members.select("id", "cluster"), edges, tree).count() == 0


def test_competition_keeps_the_larger_group(spark):
    # two cliques of 4 and 5 that share one record: it goes to the larger one, and the other is no group without it
    five, four = [f"a{i}" for i in range(5)], ["a0", "b1", "b2", "b3"]
    pairs = [(x, y) for g in (five, four) for i, x in enumerate(g) for y in g[:i]]
    got = found(spark, pairs)
    assert got == all_groups(neighbours(pairs))


def planted(seed, groups, size, inside, across):
    rnd = random.Random(seed)
    names = [(g, f"s{seed}g{g}_{i:02}") for g in range(groups) for i in range(size)]
    pairs = [(a, b) for i, (g, a) in enumerate(names) for h, b in names[:i] if rnd.random() < (inside if g == h else across)]
    return pairs, [{n for g, n in names if g == k} for k in range(groups)]


def test_groups_that_swing_settle(spark):
    # 70 per cent of pairs inside and 20 across: moved all at once, these groups swing between two states for ever
    pairs = [p for seed in (8, 17, 24, 26) for p in planted(seed, 2, 12, 0.7, 0.2)[0]]
    got, adj = found(spark, pairs), neighbours(pairs)
    assert all(is_group(g, adj) for g in got) and len({min(g).split("g")[0] for g in got}) == 4


@pytest.mark.parametrize("hierarchy", [True, False])
def test_groups_below_a_selected_parent(spark, hierarchy):
    # four groups of 30 with some similar pairs between them: the parent of 120 is no group, those in it are
    pairs, blocks = planted(1, 4, 30, 0.85, 0.2)
    adj = neighbours(pairs)
    groups = {frozenset(b) for b in blocks if is_group(b, adj)}
    assert len(groups) == 4 and found(spark, pairs, hierarchy) == groups


def test_groups_do_not_depend_on_the_size_of_the_component(spark):
    # groups that move many times, in tasks and as rows
    pairs = []
    for seed in (4, 8, 29, 39):
        rnd = random.Random(seed)
        blocks, size = rnd.randint(2, 4), rnd.randint(5, 12)
        pairs += planted(seed, blocks, size, 0.7, 0.2)[0] if seed % 2 else [(f"r{seed}_{i:02}", f"r{seed}_{j:02}") for i in range(16) for j in range(i) if rnd.random() < 0.4]
    for hierarchy in (True, False):
        assert found(spark, pairs, hierarchy) == found(spark, pairs, hierarchy, few=0, task_edges=25)


def test_sparse_start_of_many_links(spark):
    # one start of 1,500 records with over a million edge ends that are less than half of all pairs: the clique in it stays
    n, clique = 1500, 900
    pairs = spark.range(n).toDF("id").crossJoin(spark.range(n).toDF("other")).filter("id <> other")
    noise = F.pmod(F.xxhash64(F.least("id", "other"), F.greatest("id", "other")), F.lit(100)) < 17
    space = Workspace(spark, "t")
    around = space.save(pairs.filter((F.greatest("id", "other") < clique) | noise))
    assert 1_000_000 < around.count() < n * (n - 1) / 2
    got = _settled(spark.range(n).withColumn("cluster", F.lit(1).cast("long")), around, 3, space).groupBy("cluster").agg(F.collect_set("id").alias("ids")).collect()
    assert {frozenset(r.ids) for r in got} == {frozenset(range(clique))}


def test_hierarchy_in_blocks_that_end_between_equal_distances(spark):
    rnd, rows = random.Random(5), []
    for t in range(0, 6000, 100):
        ties = rnd.choice([[0.1, 0.3, 0.5, 0.8], [0.2, 0.6]])
        rows += [(t, t + i, t + rnd.randrange(max(0, i - rnd.choice([3, 100])), i), rnd.choice(ties)) for i in range(1, rnd.randint(20, 60))]
    tree = spark.createDataFrame(rows, "tree long, x long, y long, d double")
    out = []
    for task_edges in (1000, 9):
        m = condensed(tree, 3, Workspace(spark, "t"), task_edges)[0].toPandas()
        out.append({frozenset(g.id) for _, g in m[m.selected.notna()].groupby("selected")})
    assert out[0] == out[1] and len(out[0]) > 60
