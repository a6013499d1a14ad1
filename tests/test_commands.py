"""Commands end to end on generated genomes: files, databases, reports, streams."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import output
from strandloom.operators.ani import debias, eligible, nearest_model
from strandloom.operators.screen import screen_pairs
from strandloom.operators.sketch import sketch
from strandloom.params import MapParams, SketchParams
from strandloom.plans.commands import dist, search, triangle
from strandloom.runtime import shared_dir
from strandloom.sources.fasta import CONTIGS, parse_records, read_fasta, read_file_list
from strandloom.sources.sketch_db import is_db, read_db, write_db
from strandloom.streaming.search_stream import search_stream

P = SketchParams(c=30, marker_c=200)


def mutate(s, rate, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") if rnd.random() < rate else c for c in s)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("fasta")
    base = "".join(random.Random(9).choices("ACGT", k=45_000))
    other = "".join(random.Random(10).choices("ACGT", k=30_000))
    comp = base[::-1].translate(str.maketrans("ACGT", "TGCA"))
    wrap = lambda s: "\n".join(s[i : i + 70] for i in range(0, len(s), 70))
    (d / "a.fa").write_text(f">a one first\n{wrap(base)}\n>tiny\nACGT\n")
    (d / "b.fa").write_text(f">b1 second\n{wrap(mutate(base, 0.01, 1)[:25000])}\n>b2\n{wrap(mutate(base, 0.01, 1)[25000:])}\n")
    (d / "c.fa.gz").write_bytes(gzip.compress(f">c\n{wrap(mutate(base, 0.04, 2))}\n".encode()))
    (d / "d.fq").write_text(f"@d\n{other}\n+\n{'I' * len(other)}\n")
    (d / "e.fa").write_text(f">e\n{wrap(comp)}\n")
    (d / "bad.fa").write_text("no sequence at all")
    (d / "short.fa").write_text(">s\nACGT\n")
    (d / "n.fa").write_text(f">n\n{'N' * 1320}\n")
    return d


@pytest.fixture(scope="module")
def genomes(spark, files):
    s = sketch(read_fasta(spark, str(files)), P)
    return s


def name(c):
    return F.element_at(F.split(c, "/"), -1)


def test_files(spark, files, genomes):
    rows = {r.f: r for r in genomes.genomes.withColumn("f", name(F.col("file_name"))).collect()}
    assert sorted(rows) == ["a.fa", "b.fa", "c.fa.gz", "d.fq", "e.fa", "n.fa"]
    assert rows["a.fa"].contigs == ["a one first"] and rows["b.fa"].contig_lengths == [25000, 20000] and rows["n.fa"].n_markers == 0
    assert read_fasta(spark, str(files / "b.fa"), individual=True).count() == 2
    (files / "list.txt").write_text("x \n\ny\n")
    assert read_file_list(str(files / "list.txt")) == ["x", "", "y"]
    with pytest.raises(ValueError):
        parse_records(b"@a\nAC\nx\n")


def test_triangle(spark, genomes):
    r = {(x.r, x.q): x for x in triangle(genomes, MapParams(), ci=True).select(name(F.col("ref_file")).alias("r"), name(F.col("query_file")).alias("q"), "ani", "af_ref", "af_query", "ci_lower", "std").collect()}
    assert set(r) == {("a.fa", "b.fa"), ("a.fa", "c.fa.gz"), ("b.fa", "c.fa.gz"), ("a.fa", "e.fa"), ("b.fa", "e.fa"), ("c.fa.gz", "e.fa")}
    assert r["a.fa", "e.fa"].ani == 1.0 and 0.985 < r["a.fa", "b.fa"].ani < 0.999 and 0.95 < r["a.fa", "c.fa.gz"].ani < 0.98
    assert r["a.fa", "b.fa"].ani > r["a.fa", "c.fa.gz"].ani and r["a.fa", "b.fa"].af_ref > 0.9


def test_dist_equals_search_in_a_database(spark, genomes, tmp_path):
    path = str(tmp_path / "db")
    write_db(genomes, path)
    assert is_db(spark, path) and not is_db(spark, str(tmp_path))
    db = read_db(spark, path)
    assert db.params == P
    key = lambda d: sorted((r.ref_file, r.query_file, round(r.ani, 9)) for r in d.collect())
    a, b = key(dist(genomes, genomes, MapParams(min_ani=0.5))), key(search(db, db))
    assert a == b and len(a) >= 17 - 4
    with pytest.raises(Exception):
        write_db(genomes, path)
    with pytest.raises(FileNotFoundError):
        read_db(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        dist(sketch(spark.createDataFrame([], CONTIGS), SketchParams(c=60)), genomes)


def test_rescue_and_fractions(spark, genomes):
    g = genomes
    none = screen_pairs(g.markers.limit(0), g.markers, identity=0.8).count()
    few = screen_pairs(g.markers.limit(0), g.markers, identity=0.8, rescue=True, query_genomes=g.genomes.withColumn("n_markers", F.lit(0)), ref_genomes=g.genomes).count()
    assert (none, few) == (0, 36)
    assert triangle(g, MapParams(both_min_af=99.9)).filter(F.col("af_ref") < 0.999).count() == 0


def test_reports(spark, genomes, tmp_path):
    r = triangle(genomes, MapParams(), ci=True)
    out = output.report(r, detailed=True, short=True)
    assert out.columns == output.header(detailed=True, ci=True) and len(out.columns) == 20 and len(output.header(ci=True)) == 9
    assert output.header(aa=True)[2] == "AAI"
    both = output.sparse_pairs(r, output.self_rows(genomes.genomes, F.col("contigs")[0]))
    assert both.count() == r.count() + 6 and output.report(both, detailed=True).count() == both.count()
    assert output.top_per_query(r, 1).groupBy("query_name").count().filter("count > 1").isEmpty()
    cells = output.matrix_cells(genomes.genomes, "file_name", r.withColumn("ani", F.col("ani") * 100), "ref_file", "query_file", "ani", full=True, diagonal=True, distance=True)
    assert cells.count() == 36 and cells.filter("row_name = col_name AND value <> 0").isEmpty()
    ani, af = (sorted((x.row_no, x.line) for x in m.collect()) for m in output.matrix_lines(genomes.genomes, "genome_id", "file_name", r, "ref_id", "query_id"))
    assert ani[0] == af[0] == (0, "6") and [len(x.split("\t")) for _, x in ani[1:]] == [1, 2, 3, 4, 5, 6] and {len(x.split("\t")) for _, x in af[1:]} == {7}
    assert [x.split("\t")[i] for i, x in af[1:]] == ["100.00"] * 6
    output.write_tsv(output.report(r), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).columns == output.BASIC


def test_learned_correction(spark, genomes):
    assert eligible(125, False, False, False) and not eligible(30, False, False, False) and not eligible(125, True, False, False)
    assert [nearest_model(c) for c in (70, 162, 163, 300)] == [125, 125, 200, 200]
    r = triangle(genomes, MapParams(), ci=True)
    assert debias(r) is r
    import pandas as pd

    def less(ani: pd.Series, std: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return ani - 1

    got = debias(r.withColumn("total_bases", F.lit(200_000)), less).join(r.select("ref_id", "query_id", F.col("ani").alias("old")), ["ref_id", "query_id"])
    assert got.filter("old > 0.9 AND abs(old - ani - 0.01) > 1e-9").isEmpty()


def test_residue_mode(spark, files, tmp_path):
    # genes of 900 residues between stops; synonymous changes leave the residues as they are
    rnd = random.Random(5)
    codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in ("TAA", "TAG", "TGA")]
    last = {"GG": "ACGT", "CC": "ACGT", "GC": "ACGT", "GT": "ACGT", "CT": "ACGT", "AC": "ACGT"}
    gene = [rnd.choice(codons) for _ in range(2700)]
    other = [c[:2] + rnd.choice(last[c[:2]]) if c[:2] in last else c for c in gene]
    join = lambda g: "".join("TAA" + "".join(g[i : i + 900]) for i in range(0, 2700, 900)) + "TAA"
    for n, g in (("x", gene), ("y", other)):
        (tmp_path / f"{n}.fa").write_text(f">{n}\n{join(g)}\n")
    p = SketchParams(c=5, k=6, marker_c=20, use_aa=True)
    s = sketch(read_fasta(spark, str(tmp_path)), p)
    assert s.seeds.count() > 100
    r = triangle(s, MapParams(min_af=0.01)).collect()
    assert len(r) == 1 and r[0].ani > 0.9
    few = sketch(read_fasta(spark, [str(files / "a.fa"), str(files / "d.fq")]), p)
    assert triangle(few, MapParams(min_af=0.01)).filter("ani > 0.8").isEmpty()


def test_layouts_agree_and_ids_stay_texts(spark, tmp_path):
    base = "".join(random.Random(3).choices("ACGT", k=12_000))
    rows = [(i, f"f{i}", 0, 0, f"c{i}", mutate(base, 0.002 * j, j).encode(), 12_000) for j, i in enumerate(["007", "7", "0042", "a/b=c", "1e3"])]
    s = sketch(spark.createDataFrame(rows, CONTIGS), P)
    write_db(s, str(tmp_path / "plain"))
    write_db(s, str(tmp_path / "apart"), separate=True)
    dbs = [read_db(spark, str(tmp_path / n)) for n in ("plain", "apart")]
    key = lambda d: sorted((r.ref_id, r.query_id, round(r.ani, 9)) for r in d.collect())
    a, b, c = key(search(dbs[0], dbs[0])), key(search(dbs[1], dbs[1])), key(dist(s, s, MapParams(min_ani=0.5, rescue=False)))
    assert a == b == c and len(a) == 25 and {x[0] for x in a} == {"007", "7", "0042", "a/b=c", "1e3"}
    assert sorted(d.count() for d in (x.seeds for x in dbs)) == [s.seeds.count()] * 2
    again = str(tmp_path / "again")
    write_db(dbs[1], again)  # from one layout into the other
    assert key(search(s, read_db(spark, again))) == a


def test_search_reads_only_the_buckets_of_survivors(spark, tmp_path, monkeypatch):
    from strandloom.operators import sketch as module
    from strandloom.sources import sketch_db

    monkeypatch.setattr(sketch_db, "BUCKET_GENOMES", 2)
    rows = [(f"g{i}", f"f{i}", 0, 0, f"c{i}", "".join(random.Random(i).choices("ACGT", k=3000)).encode(), 3000) for i in range(40)]
    write_db(sketch(spark.createDataFrame(rows, CONTIGS), P), str(tmp_path / "db"))
    db = read_db(spark, str(tmp_path / "db"))
    assert db.buckets == 20
    ids = spark.createDataFrame([("g3",), ("g4",), ("none",)], "genome_id string")
    got = db.seeds_of(ids)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(genome_id" in plan
    assert {r.genome_id for r in got.collect()} == {"g3", "g4"} and "n_places" in got.columns
    monkeypatch.setattr(module, "PUSHED_IDS", 1)
    assert sorted(map(tuple, db.seeds_of(ids).select(*got.columns).collect())) == sorted(map(tuple, got.collect()))


def test_missing_blank_and_useless_files_are_left_out(spark, files, caplog):
    paths = [str(files / "a.fa"), "", "  ", str(files / "nowhere.fa"), str(files / "bad.fa"), str(files / "short.fa"), str(files / "n.fa")]
    with caplog.at_level("WARNING"):
        got = read_fasta(spark, paths)
        assert {r.genome_id.split("/")[-1] for r in got.collect()} == {"a.fa", "n.fa"}
        assert read_fasta(spark, ["", str(files / "nowhere.fa")]).count() == 0
    assert "blank path" in caplog.text and "nowhere.fa is missing" in caplog.text
    assert dist(sketch(read_fasta(spark, [str(files / "nowhere.fa")]), P), sketch(read_fasta(spark, str(files / "a.fa")), P)).count() == 0
    assert {r.genome_id.split("/")[-1] for r in read_fasta(spark, str(files / "*.fa")).collect()} == {"a.fa", "b.fa", "e.fa", "n.fa"}


@pytest.mark.parametrize("individual", [False, True])
def test_large_files_are_read_by_record(spark, files, tmp_path, individual):
    text = (files / "b.fa").read_text().replace("\n", "\r\n") + ">b3 a > b\r\n" + "ACGT" * 200 + "\r\n>tiny\r\nAC\r\n"
    (tmp_path / "crlf.fa").write_bytes(text.encode())
    (tmp_path / "z.fa.gz").write_bytes(gzip.compress(text.encode()))
    key = lambda d: sorted(map(tuple, d.collect()))
    paths = [str(tmp_path / "crlf.fa"), str(tmp_path / "z.fa.gz")]
    assert key(read_fasta(spark, paths, individual=individual, whole_bytes=100)) == key(read_fasta(spark, paths, individual=individual)) and read_fasta(spark, paths).count() == 6


def test_matrix_has_every_genome_and_tells_equal_names_apart(spark):
    g = spark.createDataFrame([("1", "same"), ("2", "same"), ("3", "z"), ("4", "a")], "genome_id string, name string")
    pairs = spark.createDataFrame([("1", "3", 0.95, 0.8, 0.4), ("2", "3", 0.97, 0.9, 0.5), ("1", "2", -1.0, 0.1, 0.1), ("4", "3", float("nan"), 0.3, 0.3)], "ref_id string, query_id string, ani double, af_ref double, af_query double")
    lines = lambda d: [r.line for r in d.orderBy("row_no").collect()]
    ani, af = output.matrix_lines(g, "genome_id", "name", pairs, "ref_id", "query_id")
    assert lines(ani) == ["4", "a", "same\t0.00", "same\t0.00\t0.00", "z\t0.00\t95.00\t97.00"]
    assert lines(af) == ["4", "a\t100.00\t0.00\t0.00\t0.00", "same\t0.00\t100.00\t0.00\t80.00", "same\t0.00\t0.00\t100.00\t90.00", "z\t0.00\t40.00\t50.00\t100.00"]
    full, _ = output.matrix_lines(g, "genome_id", "name", pairs, "ref_id", "query_id", full=True, distance=True)
    assert lines(full)[4] == "z\t100.00\t5.00\t3.00\t0.00"
    assert lines(output.matrix_lines(g, "genome_id", "name", pairs, "ref_id", "query_id", diagonal=True)[0])[1] == "a\t100.00"
    assert lines(output.matrix_lines(g.limit(0), "genome_id", "name", pairs, "ref_id", "query_id")[0]) == ["0"]


def test_short_records_against_each_other(spark, tmp_path):
    # three records of 9,000 bases: one of 0.5 % difference, one of 0.04 %; with and without the rescue of small genomes
    base = "".join(random.Random(21).choices("ACGT", k=9000))
    (tmp_path / "v.fa").write_text(f">v1\n{base}\n>v2\n{mutate(base, 0.0066, 1)}\n>v3\n{mutate(base, 0.0005, 2)}\n")
    s = sketch(read_fasta(spark, str(tmp_path / "v.fa"), individual=True), SketchParams(c=30, marker_c=200))
    for rescue in (True, False):
        r = {(x.ref_name, x.query_name): x for x in triangle(s, MapParams(rescue=rescue), individual=True).collect()}
        assert 0.99 < r["v1", "v2"].ani < 0.999 < r["v1", "v3"].ani and r["v1", "v3"].af_ref > 0.5


def test_correction_only_where_it_is_meant(spark, monkeypatch):
    from strandloom.plans import commands

    f, g = object(), object()
    p, mp = SketchParams(), MapParams()
    pick = commands._learned
    assert pick(f, p, mp, False) is f and pick({125: f, 200: g}, SketchParams(c=180), mp, False) is g
    assert pick(f, SketchParams(c=30), mp, False) is pick(f, p, mp, True) is pick(f, p, MapParams(median=True), False) is pick(None, p, mp, False) is None


def test_interval_of_a_pair_of_many_fragments(spark):
    base = "".join(random.Random(31).choices("ACGT", k=260_000))
    rows = [(n, n, 0, 0, n, s.encode(), len(s)) for n, s in (("a", base), ("b", mutate(base, 0.02, 3)))]
    r = triangle(sketch(spark.createDataFrame(rows, CONTIGS), SketchParams(c=60)), ci=True).collect()
    assert len(r) == 1 and 0.9 < r[0].ci_lower < r[0].ani < r[0].ci_upper < 1


def test_stream(spark, files, genomes, tmp_path):
    src = str(tmp_path / "in")
    read_fasta(spark, str(files / "b.fa")).write.parquet(src)
    seen = []
    q = search_stream(spark.readStream.schema(CONTIGS).parquet(src), genomes, lambda d, i: seen.append(d.count()), str(tmp_path / "ck"))
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    q.awaitTermination()
    assert sum(seen) == 4  # itself, and three relatives
    assert {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x not in before} <= before  # a batch leaves nothing


def test_plans_push_down_and_stay_in_the_jvm(spark):
    from strandloom.plans.queries import QUERIES

    for n in ("contig_quantiles", "inverted_index", "topn_per_query", "weighted_identity", "p4_values"):
        plan = QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
        assert "ReadSchema" in plan


def test_command_line(spark, files, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr("strandloom.__main__.AF_MATRIX", str(tmp_path / "strandloom_matrix.af"))
    from strandloom.__main__ import main, mapped, parser, sampled

    a = parser().parse_args(["dist", "-q", "x", "-r", "y", "--small-genomes", "-c", "40", "-s", "90"])
    assert sampled(a) == SketchParams(c=40, marker_c=200) and mapped(a).rescue is False and mapped(a).screen_identity(False) == 0.9
    db = str(tmp_path / "db")
    main(["sketch", str(files / "a.fa"), str(files / "b.fa"), "-o", db, "-c", "30", "-m", "200"])
    main(["search", str(files / "b.fa"), "-d", db, "-n", "1", "--short-header"])
    rows = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert rows[0] == output.BASIC and len(rows) == 2 and rows[1][2] == "100.00" and rows[1][5] == "b1"
    main(["triangle", str(files / "a.fa"), str(files / "b.fa"), "-c", "30", "-m", "200", "--full-matrix", "--diagonal", "--distance"])
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert len(lines) == 3 and lines[0] == ["2"] and lines[1][1] == "0.00" and 0 < float(lines[1][2]) < 2
    fractions = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "strandloom_matrix.af")).collect()]
    assert fractions[0] == ["2"] and fractions[1][1] == "100.00" and float(fractions[1][2]) > 50
    main(["search", "-q", str(files / "b.fa"), str(tmp_path / "none.fa"), "-d", db, "--keep-refs", "--no-learned-ani", "-o", str(tmp_path / "hits")])
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "hits")).count() == 2
    main(["triangle", str(files / "a.fa"), "-E", "--diagonal", "-a", "-c", "5", "-k", "6"])
    assert capsys.readouterr().out.splitlines()[0].split("\t")[2] == "AAI"
    main(["dist", "-q", str(files / "a.fa"), "-r", db, "--detailed", "-o", str(tmp_path / "out")])
    assert len(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).columns) == 20


def test_command_queries_use_the_default_screen(spark, monkeypatch):
    from strandloom.plans import queries_ani

    seen = {}
    for name in ("dist", "search", "triangle"):

        def kept(*sketches, _name=name, **how):
            mp = next((s for s in sketches if isinstance(s, MapParams)), MapParams())
            seen[_name] = (mp.screen_identity(False), mp.rescue)
            return spark.createDataFrame([], "ref_file string, query_file string, ani double, af_ref double, af_query double, total_bases long, ci_lower double, ci_upper double")

        monkeypatch.setattr(queries_ani, name, kept)
    for q in ("dist_ani", "search_ani", "triangle_ani"):
        queries_ani.QUERIES[q](spark, "/root/testdata/sf0.001")
    assert seen == {n: (0.8, True) for n in ("dist", "search", "triangle")}
