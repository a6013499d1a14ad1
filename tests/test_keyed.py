from collections import Counter

from pyspark.sql import functions as F

from strandloom.functions.cleaning import bare_name, is_marker, percent_at_least, resolve_names, usable
from strandloom.operators.keyed import heavy_keys, keyed_totals


def test_totals_with_a_hot_key(spark):
    rows = [(7 if i % 3 else i, f"g{i % 11}", i % 50) for i in range(3000)] + [(None, "g1", 1), (5, None, 2)]
    df = spark.createDataFrame(rows, "key long, g string, pos int").withColumn("n_rows", F.lit("clash"))
    got = {r.key: (r.n_rows, r.n_entities) for r in keyed_totals(df, "key", entity="g", distinct_on=["key", "g", "pos"]).collect()}
    once = {r for r in rows if r[0] is not None}
    n = Counter(r[0] for r in once)
    assert got == {k: (n[k], len({r[1] for r in once if r[0] == k and r[1]})) for k in n}
    assert {r.key for r in heavy_keys(keyed_totals(df, "key"), "key", 25).collect()} == {7}
    assert heavy_keys(keyed_totals(df.limit(0), "key"), "key", 25).count() == 0
    assert keyed_totals(df, "key", where=F.col("pos") > 48).agg(F.sum("n_rows")).first()[0] == sum(1 for r in rows if r[0] is not None and r[2] > 48)


def test_heavy_keys_of_many_rows(spark):
    for total in (100_000_000, 2_000_000_000, 2**31 - 1, 9 * 10**15):
        least = -(-total * 25 // 1000)
        totals = spark.createDataFrame([(1, least), (2, least - 1), (3, total - 2 * least + 1)], "key long, n_rows long")
        assert {r.key for r in heavy_keys(totals, "key", 25).collect()} == {1, 3}


def test_cleaning(spark):
    df = spark.createDataFrame([(0.95, 95.0), (0.9499, 94.0), (float("nan"), float("nan")), (-1.0, -1.0), (None, None), (100.0, 1.0)], "a double, b double")
    assert [bool(r[0]) for r in df.select(percent_at_least("a", 95)).collect()] == [True, False, False, False, False, True]
    assert [bool(r[0]) for r in df.select(usable("a")).collect()] == [True, True, False, False, False, True]
    names = spark.createDataFrame([("x/a.fa",), ("./x/b.fa",), ("./x/a.fa",), (None,)], "file_name string")
    noisy = spark.createDataFrame([(" x/a.fa",), ("./x/b.fa \t",), ("./x/a.fa",), ("x/b.fa",), ("new",)], "f string")
    assert sorted(r.f for r in resolve_names(noisy, ["f"], names, "file_name").collect()) == sorted(["./x/a.fa", "./x/b.fa", "./x/a.fa", "./x/b.fa", "new"])
    m = spark.createDataFrame([(-1,), (0,), (2**42 - 1,), (2**42,), (None,)], "m long")
    assert [bool(r[0]) for r in m.select(is_marker("m")).collect()] == [False, True, True, False, False]
    assert spark.createDataFrame([("././a ",)], "a string").select(bare_name("a")).first()[0] == "a"
