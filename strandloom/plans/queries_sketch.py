"""Queries of scalar functions, scans, sketching and screening, with their SQL.

Nucleotide sequences are derived from documents: two bases per byte of text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import is_marker
from ..functions.kmers import FULL, RESIDUES, decode_expr, encode_expr, mix64_steps, open_frames, residues_expr, revcomp_expr, short_name
from ..operators.anchors import anchor_rows, orient, with_multiplicity
from ..operators.ani import length_quantile
from ..operators.screen import marker_index, screen_pairs
from ..operators.sketch import genome_rows, seed_rows, sketch
from ..params import MIN_CONTIG, ChainParams, SketchParams
from ..runtime import Workspace, read_table
from ..sources.fasta import contigs_from_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BASES, WITH_N = "ACGTACGTACGTACGT", "ACGTACGTACGTACGN"
DOC_PARAMS = SketchParams(c=30, k=15, marker_c=120)
AA_PARAMS = SketchParams(c=15, k=6, marker_c=60, use_aa=True)


def query(f):
    QUERIES[f.__name__] = f
    return f


def dna(spark: SparkSession, sf: str, bases: str = BASES) -> DataFrame:
    docs = read_table(spark, sf, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", "source", F.translate(F.hex(F.col("text").cast("binary")), "0123456789ABCDEF", bases).alias("seq"))


def doc_contigs(spark: SparkSession, sf: str, bases: str = BASES) -> DataFrame:
    """Every document a genome of one contig."""
    d = dna(spark, sf, bases).filter(F.length("seq") >= MIN_CONTIG)
    g = F.col("doc_id").cast("string")
    return d.select(g.alias("genome_id"), g.alias("file_name"), F.lit(0).alias("contig_order"), F.lit(0).alias("contig_index"), F.concat(F.lit("doc "), g).alias("contig_name"), F.col("seq").cast("binary").alias("seq"), F.length("seq").cast("int").alias("len"))


def dna_sql(bases: str = BASES) -> str:
    return f"(SELECT doc_id, source, translate(hex(text), '0123456789ABCDEF', '{bases}') AS seq FROM documents WHERE text IS NOT NULL)"


@query
def contig_filter(spark, sf):
    """Contigs of at least 500 bases."""
    return dna(spark, sf).filter(F.length("seq") >= MIN_CONTIG).select("doc_id", F.length("seq").cast("long").alias("len"))


ORACLE["contig_filter"] = f"SELECT doc_id, length(seq)::BIGINT AS len FROM {dna_sql()} WHERE length(seq) >= 500"


@query
def genome_stats(spark, sf):
    """Total length, contigs and mean contig length of genomes made of several contigs (a paper's pages)."""
    c = contigs_from_table(dna(spark, sf), "source", "doc_id", "doc_id", "seq")
    return genome_rows(c).select("genome_id", "total_len", F.col("n_contigs").cast("long").alias("n_contigs"), F.round("mean_contig_len", 6).alias("mean_contig_len"))


ORACLE["genome_stats"] = f"SELECT source AS genome_id, sum(length(seq))::BIGINT AS total_len, count(*) AS n_contigs, round(avg(length(seq)), 6) AS mean_contig_len FROM {dna_sql()} WHERE length(seq) >= 500 GROUP BY source"


@query
def contig_quantiles(spark, sf):
    """Contig lengths at 10, 50 and 90 per cent, without interpolation."""
    g = read_table(spark, sf, "genomes").filter(F.size("contig_lengths") > 0)
    return g.select("record_id", *[length_quantile(F.col("contig_lengths"), p).cast("long").alias(f"q{p}") for p in (10, 50, 90)])


ORACLE["contig_quantiles"] = "SELECT record_id, " + ", ".join(f"list_sort(contig_lengths)[len(contig_lengths) * {p} // 100 + 1]::BIGINT AS q{p}" for p in (10, 50, 90)) + " FROM genomes WHERE len(contig_lengths) > 0"


@query
def base_encode(spark, sf):
    """Code of the first 21 bases, and the bases of that code again."""
    d = dna(spark, sf).filter(F.length("seq") >= 21).select("doc_id", encode_expr(F.substring("seq", 1, 21)).alias("code"))
    return d.withColumn("bases", decode_expr(F.col("code"), 21))


ORACLE["base_encode"] = f"SELECT doc_id, list_reduce(list_prepend(0::BIGINT, [instr('ACGT', x)::BIGINT - 1 FOR x IN string_split(substr(seq, 1, 21), '')]), lambda a, x: a * 4 + x) AS code, substr(seq, 1, 21) AS bases FROM {dna_sql()} WHERE length(seq) >= 21"


@query
def revcomp(spark, sf):
    """Reverse complement of every sequence, by its digest."""
    return dna(spark, sf).select("doc_id", F.md5(revcomp_expr(F.col("seq")).cast("binary")).alias("digest"))


ORACLE["revcomp"] = f"SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM {dna_sql()}"


@query
def mix_hash(spark, sf):
    """64-bit mix of every distinct marker, as a signed number."""
    m = read_table(spark, sf, "markers").filter(is_marker("marker")).select("marker").distinct()
    return mix64_steps(m, "marker", "hash")


def mix_sql(cte: str, c: str, keep: str) -> str:
    """CTEs h1 to h7 over ``cte``; h7.h is the mixed value as an unsigned number."""
    w, m = 1 << 64, FULL
    steps = [f"({m} - ((x + x * 2097152) % {w}))", "xor(h, h // 16777216)", f"((h * 265) % {w})", "xor(h, h // 16384)", f"((h * 21) % {w})", "xor(h, h // 268435456)", f"((h + h * 2147483648) % {w})"]
    out = [f"h0 AS (SELECT {keep}, {c}::UHUGEINT AS x FROM {cte})"]
    for i, s in enumerate(steps):
        out.append(f"h{i + 1} AS (SELECT {keep}, {s} AS h FROM h{i})")
    return ", ".join(out)


ORACLE["mix_hash"] = f"WITH m AS (SELECT DISTINCT marker FROM markers WHERE marker BETWEEN 0 AND 4398046511103), {mix_sql('m', 'marker', 'marker')} SELECT marker, (CASE WHEN h >= {1 << 63} THEN h::HUGEINT - {1 << 64} ELSE h::HUGEINT END)::BIGINT AS hash FROM h7"


@query
def codon_translate(spark, sf):
    """Residues of every sequence in its first frame, by length and digest."""
    r = dna(spark, sf).select("doc_id", residues_expr(F.col("seq")).alias("r"))
    return r.select("doc_id", F.length("r").cast("long").alias("n_residues"), F.md5(F.col("r").cast("binary")).alias("digest"))


_CODONS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
ORACLE["codon_translate"] = f"""
WITH d AS (SELECT doc_id, [instr('ACGT', x) - 1 FOR x IN string_split(seq, '')] AS b, length(seq) // 3 AS n FROM {dna_sql()}),
r AS (SELECT doc_id, n, list_aggregate([substr('{_CODONS}', (b[3 * i + 1] * 16 + b[3 * i + 2] * 4 + b[3 * i + 3] + 1)::BIGINT, 1) FOR i IN range(n)], 'string_agg', '') AS r FROM d)
SELECT doc_id, n::BIGINT AS n_residues, md5(coalesce(r, '')) AS digest FROM r
"""


@query
def short_header(spark, sf):
    """Headers up to their first white space."""
    return read_table(spark, sf, "triangle_basic").select("ref_name").distinct().select("ref_name", short_name(F.col("ref_name")).alias("short"))


ORACLE["short_header"] = r"SELECT DISTINCT ref_name, regexp_split_to_array(trim(ref_name), '\s+')[1] AS short FROM triangle_basic"

# sketching


def seeds_sql(bases: str, p: SketchParams) -> str:
    """CTE h7 of all windows (doc_id, pos, kmer, canonical, marker, near), h being the mixed seed."""
    mask = (1 << (2 * p.k)) - 1
    w = "OVER (PARTITION BY doc_id ORDER BY p)"
    return f"""
d AS (SELECT doc_id, seq FROM {dna_sql(bases)} WHERE length(seq) >= 500),
b AS (SELECT doc_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS ch FROM d),
c AS (SELECT doc_id, p, greatest(instr('ACGT', ch)::BIGINT - 1, 0) AS f1, max(CASE WHEN ch = 'N' THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS n FROM b),
c2 AS (SELECT *, f1 * 4 + lead(f1, 1) {w} AS f2, (3 - f1) + 4 * (3 - lead(f1, 1) {w}) AS r2 FROM c),
c4 AS (SELECT *, f2 * 16 + lead(f2, 2) {w} AS f4, r2 + 16 * lead(r2, 2) {w} AS r4 FROM c2),
c8 AS (SELECT *, f4 * 256 + lead(f4, 4) {w} AS f8, r4 + 256 * lead(r4, 4) {w} AS r8 FROM c4),
c21 AS (SELECT doc_id, p + 20 AS pos, lead(n, 20) {w} AS near,
  ((f8 * 65536 + lead(f8, 8) {w}) * 256 + lead(f4, 16) {w}) * 4 + lead(f1, 20) {w} AS f,
  r8 + 65536 * lead(r8, 8) {w} + {4**16} * lead(r4, 16) {w} + {4**20} * (3 - lead(f1, 20) {w}) AS r FROM c8),
k AS (SELECT doc_id, pos, near, least(f & {mask}, r & {mask}) AS kmer, (f & {mask}) < (r & {mask}) AS canonical, least(f, r) AS marker FROM c21 WHERE f IS NOT NULL AND (near IS NULL OR pos - near >= {p.mask_span})),
{mix_sql('k', 'kmer', 'doc_id, pos, kmer, canonical, marker')}
"""


def _seed_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("genome_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_seeds"), F.sum("kmer").alias("sum_kmer"), F.sum(F.col("pos").cast("long")).alias("sum_pos"), F.count_if("canonical").alias("n_canonical"))


def _seed_stats_sql(bases: str) -> str:
    return f"WITH {seeds_sql(bases, DOC_PARAMS)} SELECT doc_id, count(*) AS n_seeds, sum(kmer)::BIGINT AS sum_kmer, sum(pos)::BIGINT AS sum_pos, count_if(canonical)::BIGINT AS n_canonical FROM h7 WHERE h < {FULL // DOC_PARAMS.c} GROUP BY doc_id"


@query
def seed_sketch(spark, sf):
    """Sampled seeds of every sequence."""
    return _seed_stats(seed_rows(doc_contigs(spark, sf), DOC_PARAMS))


@query
def n_mask(spark, sf):
    """Sampled seeds where unknown bases mask the windows that hold them."""
    return _seed_stats(seed_rows(doc_contigs(spark, sf, WITH_N), DOC_PARAMS))


ORACLE["seed_sketch"], ORACLE["n_mask"] = _seed_stats_sql(BASES), _seed_stats_sql(WITH_N)


@query
def marker_sketch(spark, sf):
    """Distinct markers of every sequence."""
    m = seed_rows(doc_contigs(spark, sf), DOC_PARAMS).filter("marker IS NOT NULL").select("genome_id", "marker").distinct()
    return m.groupBy(F.col("genome_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_markers"), F.sum("marker").alias("sum_marker"))


ORACLE["marker_sketch"] = f"WITH {seeds_sql(BASES, DOC_PARAMS)} SELECT doc_id, count(*) AS n_markers, sum(marker)::BIGINT AS sum_marker FROM (SELECT DISTINCT doc_id, marker FROM h7 WHERE h < {FULL // DOC_PARAMS.marker_c}) GROUP BY doc_id"


@query
def orf_find(spark, sf):
    """Open reading frames of both strands: their number and extent per sequence."""
    import pyarrow as pa

    def frames(it):
        for b in it:
            rows = [(i, *f) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in open_frames(s)]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "end", "phase"])

    d = dna(spark, sf).filter(F.length("seq") >= MIN_CONTIG).select("doc_id", F.col("seq").cast("binary").alias("seq"))
    o = d.mapInArrow(frames, "doc_id long, start long, end long, phase long")
    return o.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_orfs"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"), F.sum("phase").alias("sum_phase"), F.max(F.col("end") - F.col("start")).alias("longest"))


_FRAMES_SQL = f"""
d AS (SELECT doc_id, seq FROM {dna_sql()} WHERE length(seq) >= 500),
b AS (SELECT doc_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS ch FROM d),
c AS (SELECT doc_id, p, ch || lead(ch, 1) OVER w || lead(ch, 2) OVER w AS codon, (p + 2) % 3 AS phase FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT *, codon IN ('TAA', 'TAG', 'TGA') AS f FROM c WHERE codon IN ('TAA', 'TAG', 'TGA', 'TTA', 'CTA', 'TCA')),
t AS (SELECT *, lag(p) OVER (PARTITION BY doc_id, phase, f ORDER BY p) AS prev, max(CASE WHEN f THEN p END) OVER (PARTITION BY doc_id, phase ORDER BY p ROWS UNBOUNDED PRECEDING) AS lastf FROM s),
o AS (SELECT doc_id, prev AS a, p AS b, phase FROM t WHERE f AND prev > 0 AND p - prev > 30
  UNION ALL SELECT doc_id, coalesce(prev, 0), p, phase + 3 FROM t WHERE NOT f AND lastf > 0 AND p - coalesce(prev, 0) > 45)
"""
ORACLE["orf_find"] = f"""
WITH {_FRAMES_SQL}
SELECT doc_id, count(*) AS n_orfs, sum(a)::BIGINT AS sum_start, sum(b)::BIGINT AS sum_end, sum(phase)::BIGINT AS sum_phase, max(b - a)::BIGINT AS longest FROM o GROUP BY doc_id
"""


@query
def aa_seed_sketch(spark, sf):
    """Sampled residue seeds inside the open frames of every sequence."""
    return _seed_stats(seed_rows(doc_contigs(spark, sf), AA_PARAMS))


def _residue_sql(code: str) -> str:
    return f"([{', '.join(str(RESIDUES[a]) for a in _CODONS)}])[{code} + 1]"


_LAST_SIX = [f"lag(res, {5 - j}) OVER w" if j < 5 else "res" for j in range(6)]
_AA_WORDS = f"""{_FRAMES_SQL},
n AS (SELECT doc_id, p, instr('ACGT', ch) - 1 AS x FROM b),
cd AS (SELECT doc_id, p, x * 16 + lead(x, 1) OVER w * 4 + lead(x, 2) OVER w AS f, (3 - x) + 4 * (3 - lead(x, 1) OVER w) + 16 * (3 - lead(x, 2) OVER w) AS r FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
fr AS (SELECT doc_id, a, phase, unnest(range(a, o.b + 1, 3)) AS p FROM o),
rs AS (SELECT t.doc_id, a, phase, t.p, CASE WHEN phase < 3 THEN {_residue_sql('f')} ELSE {_residue_sql('r')} END AS res FROM fr t JOIN cd ON cd.doc_id = t.doc_id AND cd.p = t.p WHERE f IS NOT NULL),
wd AS (SELECT doc_id, phase < 3 AS canonical, p + 2 AS pos, row_number() OVER w AS i, {" + ".join(f"{32 ** (5 - j)} * ({c})" for j, c in enumerate(_LAST_SIX))} AS fw, {" + ".join(f"{32**j} * ({c})" for j, c in enumerate(_LAST_SIX))} AS bw
  FROM rs WINDOW w AS (PARTITION BY doc_id, a, phase ORDER BY p)),
k AS (SELECT doc_id, pos, canonical, CASE WHEN canonical THEN fw ELSE bw END AS kmer FROM wd WHERE i >= 10), {mix_sql('k', 'kmer', 'doc_id, pos, kmer, canonical')}"""
ORACLE["aa_seed_sketch"] = f"WITH {_AA_WORDS} SELECT doc_id, count(*) AS n_seeds, sum(kmer)::BIGINT AS sum_kmer, sum(pos)::BIGINT AS sum_pos, count_if(canonical)::BIGINT AS n_canonical FROM h7 WHERE h < {FULL // AA_PARAMS.c} GROUP BY doc_id"


# screening, over the marker sets that the test tables give


def marker_sets(spark: SparkSession, sf: str) -> DataFrame:
    g = read_table(spark, sf, "genomes").select("genome_id", F.explode("marker_seeds").alias("marker"))
    return g.filter(is_marker("marker")).distinct()


def sketch_genomes(spark: SparkSession, sf: str) -> DataFrame:
    """Genomes with lengths taken from their contigs and counted markers."""
    n = marker_sets(spark, sf).groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_markers"))
    g = read_table(spark, sf, "genomes").filter(F.size("contig_lengths") > 0)
    total = F.aggregate("contig_lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    g = g.select("genome_id", "record_id", F.coalesce("file_name", "genome_id").alias("file_name"), total.alias("total_len"), (total / F.size("contig_lengths")).alias("mean_contig_len"))
    return g.join(n, "genome_id", "left").withColumn("n_markers", F.coalesce("n_markers", F.lit(0).cast("long")))


def query_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Marker sets of the query genomes: every record whose id is divisible by 100."""
    q = read_table(spark, sf, "genomes").filter(F.col("record_id") % 100 == 0).select("genome_id")
    return marker_sets(spark, sf).join(q, "genome_id", "left_semi")


SETS = "m AS (SELECT DISTINCT genome_id, marker FROM (SELECT genome_id, unnest(marker_seeds) AS marker FROM genomes) WHERE marker BETWEEN 0 AND 4398046511103), n AS (SELECT genome_id, count(*) AS n FROM m GROUP BY genome_id), mq AS (SELECT m.* FROM m JOIN genomes g USING (genome_id) WHERE g.record_id % 100 = 0)"


def screen_sql(identity: float, op: str, *, triangle: bool = False) -> str:
    q, cond = ("m", "AND q.genome_id < r.genome_id") if triangle else ("mq", "")
    return f"""SELECT q.genome_id AS query_id, r.genome_id AS ref_id, count(*) AS shared FROM {q} q JOIN m r ON q.marker = r.marker {cond}
JOIN n a ON a.genome_id = q.genome_id JOIN n b ON b.genome_id = r.genome_id GROUP BY q.genome_id, r.genome_id, a.n, b.n
HAVING count(*) {op} greatest(floor({identity**21!r}::DOUBLE * least(a.n, b.n)), 1)"""


@query
def marker_cardinality(spark, sf):
    """Distinct markers of every genome."""
    return marker_sets(spark, sf).groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_markers"))


ORACLE["marker_cardinality"] = f"WITH {SETS} SELECT genome_id, n AS n_markers FROM n"


@query
def inverted_index(spark, sf):
    """Genomes of every marker."""
    return marker_index(marker_sets(spark, sf))


ORACLE["inverted_index"] = f"WITH {SETS} SELECT marker, count(*) AS n_genomes, min(genome_id) AS first_genome, max(genome_id) AS last_genome FROM m GROUP BY marker"


@query
def flagship_screen_topn(spark, sf):
    """Every query's five most contained genomes, by shared markers of the smaller set."""
    from pyspark.sql import Window

    pairs = screen_pairs(query_sets(spark, sf), marker_sets(spark, sf), identity=0.9, indexed=True)
    n = marker_sets(spark, sf).groupBy("genome_id").agg(F.count(F.lit(1)).alias("n"))
    p = pairs.join(n.select(F.col("genome_id").alias("query_id"), F.col("n").alias("nq")), "query_id").join(n.select(F.col("genome_id").alias("ref_id"), F.col("n").alias("nr")), "ref_id")
    p = p.withColumn("least", F.least("nq", "nr"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.col("shared") / F.col("least")), F.desc("shared"), "ref_id")
    p = p.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    return p.select("query_id", "ref_id", "shared", F.round(F.pow(F.col("shared") / F.col("least"), F.lit(1 / 21)), 6).alias("identity"), F.col("rank").cast("int").alias("rank"))


ORACLE["flagship_screen_topn"] = f"""
WITH {SETS}, p AS ({screen_sql(0.9, '>')}), s AS (SELECT p.*, least(a.n, b.n) AS l FROM p JOIN n a ON a.genome_id = query_id JOIN n b ON b.genome_id = ref_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared / l DESC, shared DESC, ref_id) AS rank FROM s)
SELECT query_id, ref_id, shared, round(pow(shared / l, 1.0::DOUBLE / 21), 6) AS identity, rank::INT AS rank FROM r WHERE rank <= 5
"""


@query
def screen_indexed(spark, sf):
    """Queries against all genomes by the inverted index: more shared markers than the threshold."""
    return screen_pairs(query_sets(spark, sf), marker_sets(spark, sf), identity=0.9, indexed=True)


@query
def screen_pairwise(spark, sf):
    """The same pair by pair: at least as many as the threshold."""
    return screen_pairs(query_sets(spark, sf), marker_sets(spark, sf), identity=0.9, indexed=False)


@query
def screen_search(spark, sf):
    """Queries against a database at the default identity, without rescue."""
    return screen_pairs(query_sets(spark, sf), marker_sets(spark, sf), identity=0.8, indexed=True)


@query
def screen_triangle(spark, sf):
    """All pairs of one collection."""
    m = marker_sets(spark, sf)
    return screen_pairs(m, m, identity=0.97, indexed=True, triangle=True)


ORACLE["screen_indexed"] = f"WITH {SETS} {screen_sql(0.9, '>')}"
ORACLE["screen_pairwise"] = f"WITH {SETS} {screen_sql(0.9, '>=')}"
ORACLE["screen_search"] = f"WITH {SETS} {screen_sql(0.8, '>')}"
ORACLE["screen_triangle"] = f"WITH {SETS} {screen_sql(0.97, '>', triangle=True)}"


@query
def screen_rescue(spark, sf):
    """Queries with fewer than 20 markers pass against every genome."""
    g = read_table(spark, sf, "genomes").select("genome_id", "record_id")
    n = marker_sets(spark, sf).groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_markers"))
    g = Workspace(spark, "rescue").save(g.join(n, "genome_id", "left"))
    return screen_pairs(query_sets(spark, sf), marker_sets(spark, sf), identity=0.95, indexed=True, rescue=True, query_genomes=g.filter(F.col("record_id") % 100 == 0), ref_genomes=g)


ORACLE["screen_rescue"] = f"""
WITH {SETS}, p AS ({screen_sql(0.95, '>')})
SELECT query_id, ref_id, shared FROM p UNION ALL
SELECT q.genome_id, r.genome_id, NULL FROM genomes q LEFT JOIN n ON n.genome_id = q.genome_id, genomes r
WHERE q.record_id % 100 = 0 AND coalesce(n.n, 0) < 20 AND NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = q.genome_id AND p.ref_id = r.genome_id)
"""

# anchors, over marker places as seeds


def place_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Marker places as seeds; odd positions stand for the other strand."""
    m = read_table(spark, sf, "markers").filter(is_marker("marker")).select("genome_id", "contig_index", "pos", F.col("marker").alias("kmer")).distinct()
    return m.withColumn("canonical", F.col("pos") % 2 == 0)


@query
def seed_multiplicity(spark, sf):
    """In how many places of its genome every k-mer lies: number of k-mers by that."""
    m = place_seeds(spark, sf).groupBy("genome_id", "kmer").agg(F.count(F.lit(1)).alias("n_places"))
    return m.groupBy("n_places").agg(F.count(F.lit(1)).alias("n_kmers"))


@query
def repetitive_mask(spark, sf):
    """Seeds of every genome that stay and that are masked, at a band of two places."""
    m = with_multiplicity(place_seeds(spark, sf))
    return m.groupBy("genome_id").agg(F.count_if(F.col("n_places") <= 2).alias("kept"), F.count_if(F.col("n_places") > 2).alias("masked"))


PLACES = "s AS (SELECT DISTINCT genome_id, contig_index, pos, marker AS kmer FROM markers WHERE marker BETWEEN 0 AND 4398046511103), sn AS (SELECT *, count(*) OVER (PARTITION BY genome_id, kmer) AS n_places FROM s)"
ORACLE["seed_multiplicity"] = f"WITH {PLACES} SELECT n_places, count(*) AS n_kmers FROM (SELECT DISTINCT genome_id, kmer, n_places FROM sn) GROUP BY n_places"
ORACLE["repetitive_mask"] = f"WITH {PLACES} SELECT genome_id, count_if(n_places <= 2)::BIGINT AS kept, count_if(n_places > 2)::BIGINT AS masked FROM sn GROUP BY genome_id"


def oriented_pairs(spark: SparkSession, sf: str) -> DataFrame:
    g = Workspace(spark, "genomes").save(sketch_genomes(spark, sf))
    pairs = screen_pairs(query_sets(spark, sf), marker_sets(spark, sf), identity=0.95, indexed=True)
    return Workspace(spark, "oriented").save(orient(pairs.select("query_id", "ref_id"), g, g, 125))


@query
def pair_orientation(spark, sf):
    """Which genome of every screened pair is cut into fragments."""
    return oriented_pairs(spark, sf)


ORIENTED = f"""{SETS}, p AS ({screen_sql(0.95, '>')}),
g AS (SELECT genomes.genome_id, coalesce(file_name, genomes.genome_id) AS f, list_sum(contig_lengths)::BIGINT AS t, list_sum(contig_lengths)::DOUBLE / len(contig_lengths) AS mean, coalesce(n, 0) AS nm FROM genomes LEFT JOIN n ON n.genome_id = genomes.genome_id WHERE len(contig_lengths) > 0),
sc AS (SELECT query_id, ref_id, q.f AS qf, r.f AS rf,
  (CASE WHEN q.t > 100000 AND r.t > 100000 THEN q.nm * 125 ELSE q.t END)::DOUBLE * least(q.mean, 300000.0::DOUBLE) AS sq,
  (CASE WHEN q.t > 100000 AND r.t > 100000 THEN r.nm * 125 ELSE r.t END)::DOUBLE * least(r.mean, 300000.0::DOUBLE) AS sr
  FROM p JOIN g q ON q.genome_id = query_id JOIN g r ON r.genome_id = ref_id),
o AS (SELECT query_id, ref_id, CASE WHEN sq = sr THEN qf > rf ELSE sq > sr END AS switched FROM sc),
oc AS (SELECT *, CASE WHEN switched THEN ref_id ELSE query_id END AS cut_id, CASE WHEN switched THEN query_id ELSE ref_id END AS whole_id FROM o)"""
ORACLE["pair_orientation"] = f"WITH {ORIENTED} SELECT * FROM oc"
BAND = ChainParams(125, 15, False)


@query
def anchor_join(spark, sf):
    """Anchors of every screened pair: places of common seeds that are repetitive on neither side."""
    s = place_seeds(spark, sf)
    a, _ = anchor_rows(oriented_pairs(spark, sf), s, s, BAND)
    return a.groupBy("query_id", "ref_id").agg(F.count(F.lit(1)).alias("n_anchors"), F.sum(F.col("query_pos").cast("long")).alias("sum_query"), F.sum(F.col("ref_pos").cast("long")).alias("sum_ref"), F.count_if("reverse_match").alias("n_reverse"))


@query
def query_seed_denominator(spark, sf):
    """Seeds of the cut genome that count for every pair, with or without a partner."""
    s = place_seeds(spark, sf)
    _, kept = anchor_rows(oriented_pairs(spark, sf), s, s, BAND)
    return kept.groupBy("query_id", "ref_id").agg(F.count(F.lit(1)).alias("n_seeds"))


_KEPT = f"""{ORIENTED}, {PLACES},
kept AS (SELECT oc.query_id, oc.ref_id, oc.whole_id, c.kmer, c.contig_index, c.pos FROM oc JOIN sn c ON c.genome_id = oc.cut_id AND c.n_places <= 20
  WHERE NOT EXISTS (SELECT 1 FROM sn r WHERE r.genome_id = oc.whole_id AND r.kmer = c.kmer AND r.n_places > 20))"""
ORACLE["query_seed_denominator"] = f"WITH {_KEPT} SELECT query_id, ref_id, count(*) AS n_seeds FROM kept GROUP BY query_id, ref_id"
ORACLE["anchor_join"] = f"WITH {_KEPT} SELECT query_id, ref_id, count(*) AS n_anchors, sum(k.pos)::BIGINT AS sum_query, sum(r.pos)::BIGINT AS sum_ref, count_if((k.pos % 2 = 0) <> (r.pos % 2 = 0))::BIGINT AS n_reverse FROM kept k JOIN sn r ON r.genome_id = k.whole_id AND r.kmer = k.kmer GROUP BY query_id, ref_id"
