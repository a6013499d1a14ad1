"""Command line: ``python -m strandloom sketch|dist|triangle|search``, run by spark-submit or alone."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import output
from .operators.sketch import Sketches, sketch
from .params import PRESETS, MapParams, SketchParams, with_presets
from .plans.commands import dist, search, triangle
from .runtime import ship_package
from .sources.fasta import read_fasta, read_file_list
from .sources.sketch_db import is_db, read_db, write_db


#: Folder of the matrix of aligned fractions when the other one goes to standard output.
AF_MATRIX = "strandloom_matrix.af"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    sub = top.add_subparsers(dest="command", required=True)

    def sampling(p: argparse.ArgumentParser, presets: list[str]) -> None:
        for name in presets:
            p.add_argument(f"--{name.replace('_', '-')}", action="store_true", help=f"preset {PRESETS[name]}")
        p.add_argument("-c", type=int, help="one seed in so many")
        p.add_argument("-k", type=int, help="length of a seed")
        p.add_argument("-m", type=int, help="one marker in so many")
        p.add_argument("-a", "--amino-acid", action="store_true")

    def running(p: argparse.ArgumentParser) -> None:
        p.add_argument("-t", type=int, help="threads of a local session; a cluster has its own")
        p.add_argument("-v", "--debug", action="store_true", help="log more")
        p.add_argument("--trace", action="store_true", help="log most")

    def mapping(p: argparse.ArgumentParser) -> None:
        running(p)
        p.add_argument("--no-learned-ani", action="store_true", help="no learned correction; without a model there is none")
        p.add_argument("-s", type=float, default=0.0, help="screening identity in per cent")
        p.add_argument("--min-af", type=float, default=0.0)
        p.add_argument("--both-min-af", type=float, default=0.0)
        for flag in ("--ci", "--detailed", "--short-header", "--robust", "--median"):
            p.add_argument(flag, action="store_true")
        p.add_argument("-o", help="folder of the result; without it rows go to standard output")

    p = sub.add_parser("sketch", help="write a sketch database")
    p.add_argument("files", nargs="*")
    p.add_argument("-l", help="file of paths")
    p.add_argument("-o", required=True)
    p.add_argument("-i", action="store_true", help="every record is a genome")
    p.add_argument("--separate-sketches", action="store_true")
    running(p)
    sampling(p, ["fast", "slow", "medium"])

    p = sub.add_parser("dist", help="queries against references")
    for side in "qr":
        p.add_argument(f"-{side}", nargs="*", default=[])
        p.add_argument(f"--{side}l", help="file of paths")
        p.add_argument(f"--{side}i", action="store_true", help="every record is a genome")
    p.add_argument("-n", type=int)
    p.add_argument("--no-marker-index", action="store_true")
    p.add_argument("--faster-small", action="store_true", help="no rescue of genomes with few markers")
    sampling(p, list(PRESETS))
    mapping(p)

    p = sub.add_parser("triangle", help="all pairs of one collection")
    p.add_argument("files", nargs="*")
    p.add_argument("-l", help="file of paths")
    p.add_argument("-i", action="store_true")
    p.add_argument("-E", "--sparse", action="store_true", help="rows instead of a matrix")
    for flag in ("--full-matrix", "--diagonal", "--distance", "--faster-small"):
        p.add_argument(flag, action="store_true")
    sampling(p, list(PRESETS))
    mapping(p)

    p = sub.add_parser("search", help="queries against a sketch database")
    p.add_argument("queries", nargs="*")
    p.add_argument("-q", nargs="*", default=[], help="queries")
    p.add_argument("-d", required=True, help="database")
    p.add_argument("--keep-refs", action="store_true", help="accepted; survivors of all queries are read once anyway")
    p.add_argument("--ql", help="file of paths")
    p.add_argument("--qi", action="store_true")
    p.add_argument("-n", type=int)
    p.add_argument("--no-marker-index", action="store_true")
    mapping(p)
    return top


def sampled(a: argparse.Namespace) -> SketchParams:
    """Sketch parameters of the arguments: defaults, presets, then single values."""
    p = SketchParams.amino_acid() if a.amino_acid else SketchParams()
    given = {f: v for f, v in (("c", a.c), ("k", a.k), ("marker_c", a.m)) if v is not None}
    return replace(with_presets(p, *[n for n in PRESETS if getattr(a, n, False)]), **given)


def mapped(a: argparse.Namespace) -> MapParams:
    small = getattr(a, "faster_small", False) or getattr(a, "small_genomes", False)
    return MapParams(min_af=a.min_af, both_min_af=a.both_min_af, screen=a.s, robust=a.robust, median=a.median, rescue=not small)


def load(spark: SparkSession, files: list[str], listed: str | None, individual: bool, p: SketchParams) -> Sketches:
    """A database if one is named, else the sketch of the files."""
    paths = files + (read_file_list(listed) if listed else [])
    if len(paths) == 1 and is_db(spark, paths[0]):
        return read_db(spark, paths[0])
    if not paths:
        raise SystemExit("no input files")
    return sketch(read_fasta(spark, paths, individual=individual), p)


def show(df: DataFrame, out: str | None) -> None:
    """Rows to a folder, or a line each to standard output."""
    if out:
        output.write_tsv(df, out)
        return
    print("\t".join(df.columns))
    for r in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def write_lines(lines: DataFrame, out: str | None) -> None:
    """Lines of a matrix to a folder, or to standard output."""
    lines = lines.orderBy("row_no").select("line")
    if out:
        lines.coalesce(1).write.text(out)
        return
    for r in lines.toLocalIterator():
        print(r.line)


def report(a: argparse.Namespace, r: DataFrame, p: SketchParams) -> DataFrame:
    return output.report(r, ci=a.ci, detailed=a.detailed, short=a.short_header, aa=p.use_aa)


def grouped(a: argparse.Namespace, r: DataFrame, p: SketchParams) -> DataFrame:
    return report(a, output.top_per_query(r, a.n).orderBy("query_name", "rank"), p)


def main(argv: list[str] | None = None, predict=None) -> None:
    """Run a command; ``predict`` is a learned correction, or one for each compression (``commands.compare``)."""
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("strandloom")
    spark = (builder.master(f"local[{a.t}]") if a.t else builder).getOrCreate()
    spark.sparkContext.setLogLevel("TRACE" if a.trace else "DEBUG" if a.debug else "WARN")
    if getattr(a, "no_learned_ani", False):
        predict = None
    ship_package(spark)
    ci = getattr(a, "ci", False) or getattr(a, "detailed", False)
    if a.command == "sketch":
        write_db(load(spark, a.files, a.l, a.i, sampled(a)), a.o, separate=a.separate_sketches)
    elif a.command == "dist":
        p = sampled(a)
        refs = load(spark, a.r, a.rl, a.ri, p)
        queries = load(spark, a.q, a.ql, a.qi, refs.params)
        r = dist(queries, refs, mapped(a), individual=a.qi, individual_refs=a.ri, indexed=False if a.no_marker_index else None, ci=ci, predict=predict)
        show(grouped(a, r, refs.params), a.o)
    elif a.command == "search":
        db = read_db(spark, a.d)
        queries = load(spark, a.queries + a.q, a.ql, a.qi, db.params)
        r = search(queries, db, mapped(a), individual=a.qi, indexed=False if a.no_marker_index else None, ci=ci, predict=predict)
        show(grouped(a, r, db.params), a.o)
    else:
        g = load(spark, a.files, a.l, a.i, sampled(a))
        r = triangle(g, mapped(a), individual=a.i, ci=ci, predict=predict)
        if a.sparse:
            show(report(a, output.sparse_pairs(r, output.self_rows(g.genomes, F.col("contigs")[0]) if a.diagonal else None), g.params), a.o)
        else:
            named = g.genomes.select("genome_id", (F.col("contigs")[0] if a.i else F.col("file_name")).alias("name"))
            ani, af = output.matrix_lines(named, "genome_id", "name", r, "ref_id", "query_id", full=a.full_matrix, diagonal=a.diagonal, distance=a.distance)
            write_lines(ani, a.o)
            write_lines(af, f"{a.o}.af" if a.o else AF_MATRIX)


if __name__ == "__main__":
    main(sys.argv[1:])
