"""Top-k, top-n, set joins and survivors against brute force, with nulls, ties, repeats and empty tables."""

import random
from collections import Counter
from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strandloom.llm.ranking import ranked
from strandloom.llm.setjoin import expand_pairs, set_classes, similar_sets
from strandloom.llm.survivor import accession, accession_in, elected_records, is_stand_in
from strandloom.llm.topk import threshold_topk
from strandloom.llm.topn import banded_top_n
from strandloom.runtime import Workspace


def test_topk(spark):
    rnd = random.Random(2)
    rows = [(int(rnd.paretovariate(0.7)) % 400, f"g{rnd.randint(0, 5)}", rnd.randint(0, 400)) for _ in range(4000)] + [(None, "g", 1)] * 9
    rows += rows[:500]
    df = spark.createDataFrame(rows, "item long, g string, pos int").withColumn("node", F.lit(3)).withColumn("n", F.lit(1))
    once = Counter(r[0] for r in set(rows) if r[0] is not None)
    want = sorted(once.items(), key=lambda x: (-x[1], x[0]))[:15]
    assert [(r.item, r.n_rows) for r in threshold_topk(df, "item", 15, distinct_on=["g", "pos"], nodes=5).orderBy("rank").collect()] == want
    every = Counter(r[0] for r in rows if r[0] is not None)
    assert [(r.item, r.n_rows) for r in threshold_topk(df, "item", 3).orderBy("rank").collect()] == sorted(every.items(), key=lambda x: (-x[1], x[0]))[:3]
    ties = spark.createDataFrame([(i,) for i in range(9)], "item long")
    assert [r.item for r in threshold_topk(ties, "item", 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert threshold_topk(ties, "item", 50).count() == 9 and threshold_topk(ties.limit(0), "item", 5).count() == 0
    with pytest.raises(ValueError):
        threshold_topk(ties, "item", 0)


def test_topn(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice(["q1", "q1", "q2", None]), f"r{rnd.randint(0, 200)}", rnd.choice([90.0, 95.0, 99.0, rnd.random() * 100, None, float("nan")])) for _ in range(3000)]
    rows += rows[:200]
    lims = [(1, 25), (2, 1), (3, None), (4, 10_000)]
    df = spark.createDataFrame(rows, "run int, q string, ref string, ani double").withColumn("__band", F.lit(9)).withColumn("lim", F.lit("clash"))
    limits = spark.createDataFrame(lims, "run int, lim long").withColumn("ani", F.lit(0))
    best = {}
    for run, q, ref, ani in rows:
        if ani is not None and ani == ani:
            best[run, q, ref] = max(best.get((run, q, ref), -1.0), ani)
    want = set()
    for g in {k[:2] for k in best}:
        items = sorted((-s, k[2]) for k, s in best.items() if k[:2] == g)
        n = dict(lims).get(g[0])
        want |= {(*g, ref, -s) for s, ref in (items if n is None else items[:n])}
    top = banded_top_n(df, ["run", "q"], "ref", "ani", limits, ["run"], "lim")
    got = [tuple(r) for r in top.select("run", "q", "ref", "ani").collect()]
    assert set(got) == want and len(got) == len(want)
    assert banded_top_n(df.limit(0), ["run", "q"], "ref", "ani", limits, ["run"], "lim").count() == 0


def test_topn_of_equal_scores(spark):
    # one group holds nearly all rows, all of one score, and its limit is large: the smallest items by code point stay
    df = spark.range(60_000).select(F.lit(1).alias("run"), F.lit(None).cast("string").alias("q"), F.format_string("r%06d", F.pmod(F.col("id") * 7919, F.lit(60_000))).alias("ref"), F.lit(5.0).alias("ani"))
    df = df.unionByName(spark.createDataFrame([(2, "q", "x", 5.0), (2, "q", "y", 6.0)], "run int, q string, ref string, ani double"))
    limits = spark.createDataFrame([(1, 25_000), (2, 1)], "run int, lim long")
    top = banded_top_n(df, ["run", "q"], "ref", "ani", limits, ["run"], "lim")
    got = {r.run: (r.n, r.a, r.b) for r in top.groupBy("run").agg(F.count_distinct("ref").alias("n"), F.min("ref").alias("a"), F.max("ref").alias("b")).collect()}
    assert got == {1: (25_000, "r000000", "r024999"), 2: (1, "y", "y")}


def test_places_spread_a_hot_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.pmod(F.col("id") * 31, F.lit(20_000)).alias("v")).unionByName(spark.createDataFrame([(None, 5), (None, 3), ("z", 1)], "k string, v long"))
    out = ranked(df, ["k"], [F.desc("v")], Workspace(spark, "t"))
    assert out.filter("k = 'hot' AND __pos <> 19999 - v").isEmpty() and out.filter("k = 'hot'").count() == 20_000
    assert sorted((r.k or "", r.v, r["__pos"]) for r in out.filter("k IS NULL OR k = 'z'").collect()) == [("", 3, 1), ("", 5, 0), ("z", 1, 0)]
    sizes = [r.n for r in df.repartitionByRange(4, F.col("k").asc_nulls_first(), F.desc("v")).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 0.5 * 20_003


@pytest.mark.parametrize("t", ["0.6", "0.8", "0.34"])
def test_set_join(spark, t):
    rnd = random.Random(int(t[2:]))
    base = [rnd.sample(range(500), rnd.randint(1, 30)) for _ in range(25)]
    sets = [b for b in base] + [[x for x in b if rnd.random() > 0.15] + rnd.sample(range(500), rnd.randint(0, 3)) for b in base * 4]
    sets += [[1, 2, 3]] * 40 + [[1, 2, 3, 4, 5]] * 2 + [[], None, [None], [None, 7, 7], [-5]] + [rnd.sample(range(9), rnd.randint(1, 6)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, vals array<long>").withColumn("rep", F.lit("clash"))
    members, classes = set_classes(df, "id", "vals", lambda v: v >= 0)
    got = expand_pairs(similar_sets(classes, t), members).collect()
    clean = {i: frozenset(x for x in (s or []) if x is not None and x >= 0) for i, s in enumerate(sets)}
    want = {(a, b) for a in clean for b in clean if a < b and clean[a] and clean[b] and Fraction(len(clean[a] & clean[b]), len(clean[a] | clean[b])) >= Fraction(t)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_set_join_edges(spark):
    members, classes = set_classes(spark.createDataFrame([], "id long, vals array<long>"), "id", "vals")
    assert members.count() == 0 and similar_sets(classes, "0.6").count() == 0
    with pytest.raises(ValueError):
        similar_sets(classes, "0")


def test_accessions(spark):
    names = ["refs/KVA_000010000105.1.fna.gz", "kva-10000105_1 ctg2 x", "KVA%5F000010000105v1_c1", "gnl|SKB|kva000010000105.1_c9", "NODE_1_length_2486", "contig_7", "batch_1007/contigs.fasta", "mirror/2026/KVA_000010000105.2.fa", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(accession_in(F.col("n"))).collect()]
    assert got == ["kva_10000105.1"] * 4 + [None] * 3 + ["kva_10000105.2"] + [None] * 2
    both = spark.createDataFrame([("x.fa", ["contig_1", None, "ORB_000000123.4_c1"]), (None, None), ("TMS_1234.1.fa", [])], "f string, c array<string>")
    assert [r[0] for r in both.select(accession("f", "c")).collect()] == ["orb_123.4", None, "tms_1234.1"]


def test_stand_ins(spark):
    t = spark.createDataFrame([(" NA ",), ("batch_1/contigs.fasta",), (None,), ("  ",)], "t string")
    assert [r[0] for r in t.select(is_stand_in("t")).collect()] == [True, False, True, True]


def elected(df):
    ok = [F.coalesce(F.col("name").isNotNull() & (F.col("name") != "NA"), F.lit(False)), F.coalesce(F.col("len") > 0, F.lit(False))]
    return elected_records(df, ["acc", "ord"], "id", {"name": (ok[0], F.lower("name")), "len": (ok[1], F.col("len"))}, F.col("trust"), F.col("at"))


RECORDS = "acc string, ord int, id long, name string, len long, trust int, at timestamp"


def test_survivors(spark):
    d = lambda n: datetime(2026, 1, n)
    rows = [("a", 0, 1, "x.fa", 10, 5, d(1)), ("a", 0, 2, "NA", 10, 9, d(9)), ("a", 0, 3, "y.fa", 12, 5, d(2)), ("a", 0, 4, "Y.fa", 12, 5, d(2)), ("b", 0, 5, None, None, None, None), ("b", 0, 9, None, 0, None, None), (None, 0, 6, "z", 1, 1, d(1)), ("a", 1, 7, "q.fa", 3, 1, d(3)), ("a", None, 8, "n.fa", 3, 1, d(3))]
    df = spark.createDataFrame(rows + rows[:2], RECORDS).withColumn("vote", F.lit("clash")).withColumn("field", F.lit(1))
    got = {(r.acc, r.ord): tuple(r)[2:] for r in elected(df).collect()}
    # 3 and 4 tie to the smaller id, 2 is more trusted but less filled; 5 + 9 votes for a length of 10 outweigh 5 + 5 for 12
    assert got == {("a", 0): (3, 4, "y.fa", 10), ("b", 0): (5, 2, None, None), ("a", 1): (7, 1, "q.fa", 3), ("a", None): (8, 1, "n.fa", 3)}
    assert elected(df.limit(0)).count() == 0


def test_votes_of_any_age(spark):
    old, new, late = datetime(2005, 3, 1), datetime(2019, 1, 1), datetime(2041, 1, 1)
    rows = [("dated", 0, 1, "x", 1, 5, None), ("dated", 0, 2, "y", 2, 5, new)]  # an undated value does not beat a dated one
    rows += [("trust", 0, 3, "x", 1, 9, old), ("trust", 0, 4, "y", 2, 1, old)]  # votes of old values do not vanish
    rows += [("late", 0, 5, "x", 1, 5, late), ("late", 0, 6, "y", 2, 5, new)]
    rows += [("none", 0, 7, "x", 1, None, None), ("none", 0, 8, "y", 2, 3, None)]
    got = {r.acc: (r.keep_id, r.name, r.len) for r in elected(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {"dated": (2, "y", 2), "trust": (3, "x", 1), "late": (5, "x", 1), "none": (8, "y", 2)}


def test_accession_counts_digits_before_zeros_are_stripped(spark):
    names = ["GCA_000000042.1", "gca-42.1", "gca_000000042v2.fa", "GCA_00012345.3", "gca_12345.3", "x_000.1", "x_0000.1", "ab_12.1"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(accession_in(F.col("n"))).collect()]
    assert got[0] == "gca_42.1" and got[1] is None and got[2] == "gca_42.2" and got[3] == got[4] == "gca_12345.3" and got[5] == got[6] is not None and got[7] is None
