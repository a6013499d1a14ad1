"""Queries of chaining, identities, reports and commands, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import resolve_names, usable
from ..operators import output
from ..operators.anchors import orient
from ..operators.ani import bootstrap_ci, chunk_identity, rejected, weighted_ani
from ..operators.blocks import chain_rows, chunk_rows
from ..operators.screen import screen_pairs
from ..operators.sketch import sketch
from ..params import INDEX_QUERIES, MapParams, SketchParams, chain_params
from ..runtime import Workspace, read_table
from ..sources.sketch_db import read_db, write_db
from . import sql_chain
from .commands import dist, pieces_of, search, triangle
from .queries_sketch import DOC_PARAMS, _seed_stats, doc_contigs
from .queries_sketch import ORACLE as SKETCH_ORACLE

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CP = chain_params(DOC_PARAMS)
HIT_CP = chain_params(SketchParams())


def query(f):
    QUERIES[f.__name__] = f
    return f


# order-dependent operators over sequences of documents: every hundredth against all


def _doc_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Oriented pairs, the packed seeds of their genomes, and how many queries and references there are."""
    db, q = _docs(spark, sf), _docs(spark, sf, True)
    pairs = screen_pairs(q.markers, db.markers, identity=0.97, indexed=True)
    space = Workspace(spark, "pairs")
    oriented = space.save(orient(pairs.select("query_id", "ref_id"), q.genomes, db.genomes, DOC_PARAMS.c).select("query_id", "ref_id", "switched"))
    return oriented, pieces_of(oriented, db, db, space), (q.genomes.count(), db.genomes.count())


@query
def chunk_anchors(spark, sf):
    """Seeds of every fragment of every pair."""
    return chunk_rows(*_doc_pairs(spark, sf), CP)


@query
def chain_intervals(spark, sf):
    """Best chains of every fragment, before they compete."""
    return chain_rows(*_doc_pairs(spark, sf), CP, compete=False)


@query
def nonoverlap_chains(spark, sf):
    """Chains that keep their place on both genomes."""
    return chain_rows(*_doc_pairs(spark, sf), CP)


_DOCS_97 = f"WITH RECURSIVE {sql_chain.pairs_sql(0.97, DOC_PARAMS, 'shared > t')}, {sql_chain.chunks_sql(DOC_PARAMS)}"
ORACLE["chunk_anchors"] = f"{_DOCS_97} SELECT q::VARCHAR AS query_id, r::VARCHAR AS ref_id, chunk::INT AS chunk_id, count(*) AS n_seeds, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM owned GROUP BY q, r, chunk"
_CHAIN_COLUMNS = "q::VARCHAR AS query_id, r::VARCHAR AS ref_id, chunk::INT AS chunk_id, score::DOUBLE AS score, anchors::INT AS num_anchors, qs::INT AS q_start, qe::INT AS q_end, rs::INT AS r_start, re::INT AS r_end, 0 AS ref_contig, 0 AS query_contig, rev AS reverse"
ORACLE["chain_intervals"] = f"{_DOCS_97}, {sql_chain.chains_sql(DOC_PARAMS)} SELECT {_CHAIN_COLUMNS} FROM best"
ORACLE["nonoverlap_chains"] = f"{_DOCS_97}, {sql_chain.chains_sql(DOC_PARAMS)}, {sql_chain.free_sql()} SELECT {_CHAIN_COLUMNS} FROM won"


# identities over search_hits, whose rows stand for fragments of a (run, query file) pair


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    h = read_table(spark, sf, "search_hits").filter(usable("ani") & usable("align_fraction_ref") & usable("align_fraction_query"))
    n = F.length("ref_file").cast("long")
    cols = {"anchors": F.floor("ani"), "seeds": 100 + n, "in_intervals": F.floor("ani") + 1, "in_range": 95 + F.floor(F.col("align_fraction_query") / 20), "q_range": F.floor(F.col("align_fraction_ref") * 200), "covered": F.floor(F.col("align_fraction_ref") * 100), "bases": F.floor(F.col("align_fraction_query") * 100), "chain_bases": n, "n_chains": F.lit(1)}
    return h.select(F.col("run_id").cast("string").alias("query_id"), F.col("query_file").alias("ref_id"), n.cast("int").alias("chunk_id"), *[v.cast("long").alias(k) for k, v in cols.items()])


_CHUNKS_SQL = """c AS (SELECT run_id::VARCHAR AS query_id, query_file AS ref_id, floor(ani)::BIGINT AS anchors, 100 + length(ref_file) AS seeds, floor(ani)::BIGINT + 1 AS in_intervals,
  95 + floor(align_fraction_query / 20)::BIGINT AS in_range, floor(align_fraction_ref * 200)::BIGINT AS q_range, floor(align_fraction_ref * 100)::BIGINT AS covered, floor(align_fraction_query * 100)::BIGINT AS bases
  FROM search_hits WHERE ani >= 0 AND NOT isnan(ani) AND align_fraction_ref >= 0 AND NOT isnan(align_fraction_ref) AND align_fraction_query >= 0 AND NOT isnan(align_fraction_query)),
i AS (SELECT *, CASE WHEN pow(anchors / in_intervals, 1.0::DOUBLE / 15) > 0.95 AND covered > 500 AND q_range < 18000 AND seeds > in_range * 1.05 THEN in_range ELSE seeds END AS w FROM c WHERE anchors > 0 AND q_range >= 500),
e AS (SELECT *, pow(least(anchors / w, 1), 1.0::DOUBLE / 15) AS ani FROM i)"""


@query
def chunk_identities(spark, sf):
    """Identity and weight of every fragment of 500 bases or more."""
    return chunk_identity(_chunks(spark, sf), HIT_CP).groupBy("query_id", "ref_id", "w", F.round("ani", 6).alias("ani")).agg(F.count(F.lit(1)).alias("n"))


ORACLE["chunk_identities"] = f"WITH {_CHUNKS_SQL} SELECT query_id, ref_id, w, round(ani, 6) AS ani, count(*) AS n FROM e GROUP BY query_id, ref_id, w, round(ani, 6)"


@query
def weighted_identity(spark, sf):
    """Weighted mean identity of every pair."""
    return weighted_ani(chunk_identity(_chunks(spark, sf), HIT_CP), ["query_id", "ref_id"]).withColumn("ani", F.round("ani", 6))


ORACLE["weighted_identity"] = f"WITH {_CHUNKS_SQL} SELECT query_id, ref_id, round(sum(ani * w) / sum(w), 6) AS ani FROM e GROUP BY query_id, ref_id"


def _trimmed_sql(lower: float, upper: float) -> str:
    return f"""WITH {_CHUNKS_SQL}, s AS (SELECT *, sum(w) OVER (PARTITION BY query_id, ref_id ORDER BY ani, w ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY query_id, ref_id) AS total FROM e)
SELECT query_id, ref_id, round(sum(ani * w) / sum(w), 6) AS ani FROM s WHERE run >= floor(total * {lower}) AND run - w < floor(total * {upper}) GROUP BY query_id, ref_id"""


@query
def trimmed_identity(spark, sf):
    """Weighted mean between the 10th and 90th percentile of weight."""
    return weighted_ani(chunk_identity(_chunks(spark, sf), HIT_CP), ["query_id", "ref_id"], 0.1, 0.9).withColumn("ani", F.round("ani", 6))


@query
def median_identity(spark, sf):
    """Weighted median."""
    return weighted_ani(chunk_identity(_chunks(spark, sf), HIT_CP), ["query_id", "ref_id"], 0.499, 0.501).withColumn("ani", F.round("ani", 6))


ORACLE["trimmed_identity"], ORACLE["median_identity"] = _trimmed_sql(0.1, 0.9), _trimmed_sql(0.499, 0.501)


@query
def identity_spread(spark, sf):
    """Population standard deviation of the fragments of a pair."""
    return chunk_identity(_chunks(spark, sf), HIT_CP).groupBy("query_id", "ref_id").agg(F.round(F.stddev_pop("ani"), 6).alias("std"), F.count(F.lit(1)).alias("n"))


ORACLE["identity_spread"] = f"WITH {_CHUNKS_SQL} SELECT query_id, ref_id, round(stddev_pop(ani), 6) AS std, count(*) AS n FROM e GROUP BY query_id, ref_id"


@query
def aligned_fraction(spark, sf):
    """Covered bases of a pair over a length of 20 kb, at most 1."""
    c = _chunks(spark, sf).groupBy("query_id", "ref_id").agg(F.sum("bases").alias("total_bases"))
    return c.withColumn("af", F.round(F.least(F.lit(1.0), F.col("total_bases") / 20_000), 6))


ORACLE["aligned_fraction"] = f"WITH {_CHUNKS_SQL} SELECT query_id, ref_id, sum(bases)::BIGINT AS total_bases, round(least(1, sum(bases) / 20000), 6) AS af FROM c GROUP BY query_id, ref_id"


@query
def af_cutoff(spark, sf):
    """Rows that the three rules for aligned fractions reject."""
    h = read_table(spark, sf, "search_hits").filter(usable("align_fraction_ref") & usable("align_fraction_query"))
    h = h.select("run_id", "query_file", "ref_file", (F.col("align_fraction_ref") / 100).alias("af_ref"), (F.col("align_fraction_query") / 100).alias("af_query"))
    return h.select("run_id", "query_file", "ref_file", rejected(0.5, 0, False).alias("dna"), rejected(0.5, 0, True).alias("aa"), rejected(0.5, 0.6, False).alias("both"))


ORACLE["af_cutoff"] = """
SELECT run_id, query_file, ref_file, align_fraction_query / 100 < 0.5 AND align_fraction_ref / 100 < 0.5 AS dna, align_fraction_query / 100 < 0.5 OR align_fraction_ref / 100 < 0.5 AS aa,
  align_fraction_query / 100 < 0.6 OR align_fraction_ref / 100 < 0.6 AS both
FROM search_hits WHERE align_fraction_ref >= 0 AND NOT isnan(align_fraction_ref) AND align_fraction_query >= 0 AND NOT isnan(align_fraction_query)
"""


@query
def bootstrap_interval(spark, sf):
    """Resampled 5 to 95 per cent interval of the identity of every pair."""
    return bootstrap_ci(chunk_identity(_chunks(spark, sf), HIT_CP), ["query_id", "ref_id"])


@query
def bootstrap_bounds(spark, sf):
    """Of every pair, its fragments, and whether its interval is that of the unknown or lies within its identities."""
    c = chunk_identity(_chunks(spark, sf), HIT_CP)
    keys = ["query_id", "ref_id"]
    j = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ani").alias("lo"), F.max("ani").alias("hi")).join(bootstrap_ci(c, keys), keys)
    tiny = 1e-9
    return j.select(*keys, "n", ((F.col("ci_lower") == 0) & (F.col("ci_upper") == 1)).alias("unknown"), ((F.col("ci_lower") >= F.col("lo") - tiny) & (F.col("ci_upper") <= F.col("hi") + tiny) & (F.col("ci_lower") <= F.col("ci_upper"))).alias("within"))


ORACLE["bootstrap_bounds"] = f"WITH {_CHUNKS_SQL} SELECT query_id, ref_id, count(*) AS n, count(*) < 10 AS unknown, count(*) >= 10 AS within FROM e GROUP BY query_id, ref_id"


# reports


def _results(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """Result rows of a test table as fractions, a row sent again once."""
    t = read_table(spark, sf, table)
    cols = [c for c in t.columns if c not in ("loaded_at", "finished_at")]
    return t.select(*cols).distinct().withColumn("ani", F.col("ani") / 100).withColumnRenamed("align_fraction_ref", "af_ref").withColumnRenamed("align_fraction_query", "af_query").withColumn("af_ref", F.col("af_ref") / 100).withColumn("af_query", F.col("af_query") / 100)


@query
def result_rows(spark, sf):
    """Results as they are written, with two decimals."""
    r = output.reported(_results(spark, sf, "search_hits")).filter(F.col("af_ref").isNotNull() & F.col("af_query").isNotNull())
    return output.report(r, short=True)


ORACLE["result_rows"] = r"""
SELECT ref_file AS "Ref_file", query_file AS "Query_file", printf('%.2f', ani / 100 * 100) AS "ANI", printf('%.2f', align_fraction_ref / 100 * 100) AS "Align_fraction_ref", printf('%.2f', align_fraction_query / 100 * 100) AS "Align_fraction_query",
  regexp_split_to_array(trim(ref_name), '\s+')[1] AS "Ref_name", regexp_split_to_array(trim(query_name), '\s+')[1] AS "Query_name"
FROM (SELECT DISTINCT run_id, ref_file, query_file, ani, align_fraction_ref, align_fraction_query, ref_name, query_name, ani_5_percentile, ani_95_percentile FROM search_hits
WHERE ani >= 0 AND NOT isnan(ani) AND align_fraction_ref IS NOT NULL AND align_fraction_query IS NOT NULL)
"""


@query
def topn_per_query(spark, sf):
    """Five best references of every query's first contig name."""
    r = output.top_per_query(_results(spark, sf, "search_hits"), 5)
    return r.select("query_name", "query_file", "ref_file", F.round("ani", 6).alias("ani"), "rank")


ORACLE["topn_per_query"] = """
SELECT query_name, query_file, ref_file, round(ani, 6) AS ani, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY ani DESC, ref_file, query_file) AS rank FROM (
    SELECT DISTINCT run_id, ref_file, query_file, ani / 100 AS ani, align_fraction_ref, align_fraction_query, ref_name, query_name, ani_5_percentile, ani_95_percentile FROM search_hits WHERE ani >= 0 AND NOT isnan(ani)))
WHERE rank <= 5
"""


@query
def sparse_pairs(spark, sf):
    """Pairs with an identity, and every genome with itself."""
    g = read_table(spark, sf, "genomes").filter(F.size("contigs") > 0).select("file_name", "contigs", "n_contigs", "total_len")
    r = output.sparse_pairs(_results(spark, sf, "triangle_basic"), output.self_rows(g, F.col("contigs")[0]))
    return r.select("ref_file", "query_file", F.round("ani", 6).alias("ani"), "ref_name", "query_name")


ORACLE["sparse_pairs"] = """
SELECT ref_file, query_file, round(ani / 100, 6) AS ani, ref_name, query_name FROM (SELECT DISTINCT ref_file, query_file, ani, align_fraction_ref, align_fraction_query, ref_name, query_name, run_id FROM triangle_basic WHERE ani >= 0 AND NOT isnan(ani))
UNION ALL SELECT file_name, file_name, 1.0, contigs[1], contigs[1] FROM genomes WHERE len(contigs) > 0
"""


def _source_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of triangle_detailed by the source of their genomes: the matrix of a fixed number of sources."""
    g = read_table(spark, sf, "genomes")
    src = g.filter(F.col("source_db").isNotNull()).groupBy("file_name").agg(F.min(F.lower(F.trim("source_db"))).alias("s"))
    t = resolve_names(output.reported(read_table(spark, sf, "triangle_detailed")), ["ref_file", "query_file"], g, "file_name")
    p = t.join(src.withColumnsRenamed({"file_name": "ref_file", "s": "a"}), "ref_file").join(src.withColumnsRenamed({"file_name": "query_file", "s": "b"}), "query_file")
    return read_table(spark, sf, "registries"), p.select("a", "b", "ani", F.col("align_fraction_ref").alias("fa"), F.col("align_fraction_query").alias("fb")).filter("a <> b")


def _source_sql(least: str, distance: bool) -> str:
    from ..functions import sql_names

    return f"""
WITH {sql_names.NAMES}, src AS (SELECT file_name, min(lower(trim(source_db))) AS s FROM genomes WHERE source_db IS NOT NULL GROUP BY file_name),
t AS (SELECT {sql_names.known('ref_file')} AS r, {sql_names.known('query_file')} AS q, ani FROM triangle_detailed WHERE ani >= 0 AND NOT isnan(ani)),
p AS (SELECT greatest(a.s, b.s) AS x, least(a.s, b.s) AS y, max(ani) AS v FROM t JOIN src a ON a.file_name = r JOIN src b ON b.file_name = q WHERE a.s <> b.s GROUP BY 1, 2)
SELECT i.source_db AS row_name, j.source_db AS col_name, {'100 - ' if distance else ''}coalesce(v, 0) AS value FROM registries i JOIN registries j ON i.source_db {least} j.source_db
LEFT JOIN p ON x = greatest(i.source_db, j.source_db) AND y = least(i.source_db, j.source_db)
"""


@query
def dense_matrix(spark, sf):
    """Lower triangle of the best identities between sources."""
    n, p = _source_pairs(spark, sf)
    return output.matrix_cells(n, "source_db", p, "a", "b", "ani")


@query
def distance_matrix(spark, sf):
    """Full matrix of distances between sources."""
    n, p = _source_pairs(spark, sf)
    return output.matrix_cells(n, "source_db", p, "a", "b", "ani", full=True, distance=True)


ORACLE["dense_matrix"], ORACLE["distance_matrix"] = _source_sql(">", False), _source_sql("<>", True)


def _source_matrix(spark: SparkSession, sf: str, **how) -> tuple[DataFrame, DataFrame]:
    """Lines of both matrices of the sources: best identity, and of either source the best aligned fraction, against the other."""
    _, p = _source_pairs(spark, sf)
    first = F.col("a") < F.col("b")
    p = p.groupBy(F.least("a", "b").alias("r"), F.greatest("a", "b").alias("q")).agg((F.max("ani") / 100).alias("ani"), (F.max(F.when(first, F.col("fa")).otherwise(F.col("fb"))) / 100).alias("af_ref"), (F.max(F.when(first, F.col("fb")).otherwise(F.col("fa"))) / 100).alias("af_query"))
    return output.matrix_lines(read_table(spark, sf, "registries"), "source_db", "source_db", p, "r", "q", **how)


@query
def matrix_lines(spark, sf):
    """The lower triangle of the sources as it is written, number of rows first."""
    return _source_matrix(spark, sf)[0]


@query
def distance_lines(spark, sf):
    """The full matrix of distances of the sources as it is written."""
    return _source_matrix(spark, sf, full=True, distance=True)[0]


@query
def af_lines(spark, sf):
    """The matrix of aligned fractions that is written beside it: full, asymmetric, 100 in the diagonal."""
    return _source_matrix(spark, sf)[1]


def _lines_sql(value: str, cells: str, missing: str, perfect: str) -> str:
    from ..functions import sql_names

    return f"""
WITH {sql_names.NAMES}, src AS (SELECT file_name, min(lower(trim(source_db))) AS s FROM genomes WHERE source_db IS NOT NULL GROUP BY file_name),
t AS (SELECT {sql_names.known('ref_file')} AS r, {sql_names.known('query_file')} AS q, ani, align_fraction_ref AS fr, align_fraction_query AS fq FROM triangle_detailed WHERE ani >= 0 AND NOT isnan(ani)),
d AS (SELECT a.s AS x, b.s AS y, ani, fr AS f FROM t JOIN src a ON a.file_name = r JOIN src b ON b.file_name = q WHERE a.s <> b.s
      UNION ALL SELECT b.s, a.s, ani, fq FROM t JOIN src a ON a.file_name = r JOIN src b ON b.file_name = q WHERE a.s <> b.s),
p AS (SELECT x, y, {value} AS v FROM d GROUP BY x, y),
n AS (SELECT source_db AS s, row_number() OVER (ORDER BY source_db)::INT AS i FROM (SELECT DISTINCT source_db FROM registries)),
c AS (SELECT a.i, a.s, string_agg(printf('%.2f', CASE WHEN b.i IS NULL THEN NULL WHEN b.i = a.i THEN {perfect} ELSE coalesce(v, {missing}) END), chr(9) ORDER BY b.i) AS l
      FROM n a LEFT JOIN n b ON {cells} LEFT JOIN p ON x = a.s AND y = b.s GROUP BY a.i, a.s)
SELECT 0 AS row_no, (SELECT count(*) FROM n)::VARCHAR AS line UNION ALL SELECT i, concat_ws(chr(9), s, l) FROM c
"""


ORACLE["matrix_lines"] = _lines_sql("max(ani / 100 * 100)", "b.i < a.i", "0.0::DOUBLE", "100.0::DOUBLE")
ORACLE["distance_lines"] = _lines_sql("100 - max(ani / 100 * 100)", "true", "100.0::DOUBLE", "0.0::DOUBLE")
ORACLE["af_lines"] = _lines_sql("max(f / 100 * 100)", "true", "0.0::DOUBLE", "100.0::DOUBLE")


@query
def af_matrix(spark, sf):
    """Aligned fraction of every row's file against the column's, in both directions."""
    t = output.reported(read_table(spark, sf, "triangle_basic"))
    return output.af_cells(t, "ref_file", "query_file", "align_fraction_ref", "align_fraction_query")


ORACLE["af_matrix"] = """
SELECT row_name, col_name, max(value) AS value FROM (
  SELECT ref_file AS row_name, query_file AS col_name, align_fraction_ref AS value FROM triangle_basic WHERE ani >= 0 AND NOT isnan(ani)
  UNION ALL SELECT query_file, ref_file, align_fraction_query FROM triangle_basic WHERE ani >= 0 AND NOT isnan(ani)) GROUP BY row_name, col_name
"""

# commands, over sequences of documents


_databases: dict[tuple[str, str, bool], str] = {}


def _docs(spark: SparkSession, sf: str, queries: bool = False):
    c = doc_contigs(spark, sf)
    return sketch(c.filter(F.col("genome_id").cast("long") % 100 == 0) if queries else c, DOC_PARAMS)


def database(spark: SparkSession, sf: str, separate: bool = False) -> str:
    """Folder of the sketch database of all documents, written once a session."""
    key = (spark.sparkContext.applicationId, sf, separate)
    if key not in _databases:
        path = Workspace(spark, "db").root
        write_db(_docs(spark, sf), path, separate=separate)
        _databases[key] = path
    return _databases[key]


def _short(r: DataFrame) -> DataFrame:
    return r.select("ref_file", "query_file", F.round("ani", 6).alias("ani"), F.round("af_ref", 6).alias("af_ref"), F.round("af_query", 6).alias("af_query"), "total_bases")


@query
def db_roundtrip(spark, sf):
    """Seeds of every sequence after a sketch database was written and read again."""
    return _seed_stats(read_db(spark, database(spark, sf)).seeds)


ORACLE["db_roundtrip"] = SKETCH_ORACLE["seed_sketch"]


@query
def dist_ani(spark, sf):
    """Every hundredth document against all, with resampled intervals where there are ten fragments."""
    r = dist(_docs(spark, sf, True), _docs(spark, sf), MapParams(), ci=True)
    return r.select("ref_file", "query_file", "ani", "ci_lower", "ci_upper")


@query
def search_ani(spark, sf):
    """Every hundredth document searched in the database of all."""
    return _short(search(_docs(spark, sf, True), read_db(spark, database(spark, sf))))


@query
def search_separate(spark, sf):
    """The same in a database with a folder for every document."""
    return _short(search(_docs(spark, sf, True), read_db(spark, database(spark, sf, True))))


def _results_sql(rescue: bool, least_ani: float) -> str:
    """A comparison at the default screen; one shared marker more is asked for with more than 50 queries, and then only queries of few markers are rescued."""
    many = f"(SELECT count(*) FROM g WHERE {sql_chain.QUERY}) > {INDEX_QUERIES}"
    few = f"{sql_chain.few_sql(False)} OR NOT {many} AND ({sql_chain.few_sql(True)})" if rescue else None
    pairs = sql_chain.pairs_sql(0.8, DOC_PARAMS, f"shared > t OR shared = t AND NOT {many}", few)
    return f"WITH RECURSIVE {pairs}, {sql_chain.chunks_sql(DOC_PARAMS)}, {sql_chain.chains_sql(DOC_PARAMS)}, {sql_chain.free_sql()}, {sql_chain.results_sql(DOC_PARAMS, 0.15, least_ani)}"


ORACLE["search_ani"] = ORACLE["search_separate"] = f"{_results_sql(False, 0.5)} SELECT r::VARCHAR AS ref_file, q::VARCHAR AS query_file, round(ani, 6) AS ani, round(af_r, 6) AS af_ref, round(af_q, 6) AS af_query, total AS total_bases FROM res"
# No document has the ten fragments that an interval needs, so all have that of the unknown.
ORACLE["dist_ani"] = f"{_results_sql(True, 0.1)} SELECT r::VARCHAR AS ref_file, q::VARCHAR AS query_file, ani, 0.0::DOUBLE AS ci_lower, 1.0::DOUBLE AS ci_upper FROM res"


@query
def triangle_ani(spark, sf):
    """All pairs of documents."""
    return _short(triangle(_docs(spark, sf)))
