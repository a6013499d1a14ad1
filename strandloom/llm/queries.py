"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql_names
from ..functions.cleaning import MARKER_ROW, bare_name, is_marker, percent_at_least, resolve_names, usable
from ..runtime import Workspace, read_table
from .clusters import density_clusters, majority_groups
from .components import hash_to_min
from .packing import pack
from .sentences import sentence_ends
from .setjoin import expand_pairs, set_classes, similar_sets
from .survivor import STAND_INS, accession, elected_records, is_stand_in
from .tokens import decode_corpus, encode_corpus
from .topk import threshold_topk
from .topn import banded_top_n

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 2 -- consolidating pairwise matches into groups


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files linked by matches of at least 95 per cent; groups of two or more."""
    rows = read_table(spark, sf, "triangle_basic").filter(percent_at_least("ani", 95))
    pairs = rows.select("ref_file", "query_file").distinct()
    pairs = resolve_names(pairs, ["ref_file", "query_file"], read_table(spark, sf, "genomes"), "file_name")
    groups = hash_to_min(pairs.filter("ref_file <> query_file"), "ref_file", "query_file")
    return groups.select(F.col("node").alias("file_name"), "group_id")


ORACLE["p2_found"] = f"""
WITH RECURSIVE {sql_names.NAMES},
links AS (SELECT DISTINCT a, b FROM (SELECT {sql_names.known('ref_file')} AS a, {sql_names.known('query_file')} AS b FROM triangle_basic
          WHERE ani IS NOT NULL AND NOT isnan(ani) AND ani >= 0 AND CASE WHEN ani <= 1 THEN ani >= 0.95 ELSE ani >= 95 END) WHERE a <> b),
two AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS v, a AS u FROM two UNION SELECT r.v, t.b FROM reach r JOIN two t ON r.u = t.a)
SELECT v AS file_name, min(u) AS group_id FROM reach GROUP BY v
"""

# 3 -- most frequent items


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 markers with the most rows; rows sent again count once."""
    return p3_topk(spark, sf).select("marker")


@query
def p3_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same with counts and ranks."""
    rows = read_table(spark, sf, "markers").filter(is_marker("marker"))
    return threshold_topk(rows, "marker", 20, distinct_on=MARKER_ROW)


MARKERS_SQL = "(SELECT DISTINCT genome_id, contig_index, pos, marker FROM markers WHERE marker BETWEEN 0 AND 4398046511103)"
ORACLE["p3_topk"] = f"""
SELECT marker, count(*) AS n_rows, cast(row_number() OVER (ORDER BY count(*) DESC, marker) AS int) AS rank
FROM {MARKERS_SQL} GROUP BY marker ORDER BY n_rows DESC, marker LIMIT 20
"""
ORACLE["p3_found"] = f"SELECT marker FROM {MARKERS_SQL} GROUP BY marker ORDER BY count(*) DESC, marker LIMIT 20"

# 5 -- top n of every group


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's max_results references of highest usable ani for every query file."""
    hits = read_table(spark, sf, "search_hits").filter(usable("ani"))
    runs = read_table(spark, sf, "command_params")
    top = banded_top_n(hits, ["run_id", "query_file"], "ref_file", "ani", runs, ["run_id"], "max_results")
    return top.select("run_id", "query_file", "ref_file")


ORACLE["p5_found"] = """
SELECT run_id, query_file, ref_file FROM (
  SELECT h.*, p.max_results, row_number() OVER (PARTITION BY h.run_id, query_file ORDER BY ani DESC, ref_file) AS r
  FROM (SELECT run_id, query_file, ref_file, max(ani) AS ani FROM search_hits
        WHERE ani IS NOT NULL AND NOT isnan(ani) AND ani >= 0 GROUP BY ALL) h
  LEFT JOIN command_params p ON h.run_id = p.run_id)
WHERE max_results IS NULL OR r <= max_results
"""

# 6 -- similar pairs between set-valued records


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of genomes whose distinct markers share at least 0.6 of their union."""
    members, classes = set_classes(read_table(spark, sf, "genomes"), "record_id", "marker_seeds", is_marker)
    members = Workspace(spark, "members").save(members)
    return expand_pairs(similar_sets(classes, "0.6"), members)


@query
def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The same without expanding copies: each record, its set's representative and that set's links to other sets."""
    members, classes = set_classes(read_table(spark, sf, "genomes"), "record_id", "marker_seeds", is_marker)
    pairs = similar_sets(classes, "0.6")
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "rep", "left").select(F.col("id").alias("record_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


_SETS_SQL = "sets AS (SELECT record_id, list_distinct(list_filter(marker_seeds, lambda x: x BETWEEN 0 AND 4398046511103)) AS v FROM genomes)"
ORACLE["p6_found"] = f"""
WITH {_SETS_SQL}, t AS (SELECT record_id, len(v) AS n, unnest(v) AS m FROM sets)
SELECT a.record_id AS record_a, b.record_id AS record_b FROM t a JOIN t b ON a.m = b.m AND a.record_id < b.record_id
GROUP BY a.record_id, b.record_id, a.n, b.n HAVING count(*) * 5 >= (a.n + b.n - count(*)) * 3
"""
ORACLE["p6_classes"] = f"""
WITH {_SETS_SQL}, c AS (SELECT record_id, list_sort(v) AS v, min(record_id) OVER (PARTITION BY list_sort(v)) AS rep FROM sets WHERE len(v) > 0),
t AS (SELECT DISTINCT rep, len(v) AS n, unnest(v) AS m FROM c),
p AS (SELECT a.rep AS ra, b.rep AS rb FROM t a JOIN t b ON a.m = b.m AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) * 5 >= (a.n + b.n - count(*)) * 3),
l AS (SELECT rep, count(*) AS n FROM (SELECT ra AS rep FROM p UNION ALL SELECT rb FROM p) GROUP BY rep)
SELECT record_id, c.rep AS class_id, coalesce(n, 0) AS n_links FROM c LEFT JOIN l ON c.rep = l.rep
"""

# 7 -- best representative of each duplicate group


def _assemblies(spark: SparkSession, sf: str) -> DataFrame:
    """Genomes with their accession and the trust of their source."""
    trust = read_table(spark, sf, "registries").groupBy(F.lower(F.trim("source_db")).alias("__source")).agg(F.max("trust").alias("trust"))
    rows = read_table(spark, sf, "genomes").select("record_id", "file_name", "contig_order", "contigs", "contig_lengths", "total_len", "n_contigs", "source_db", "sketched_at")
    return rows.withColumn("accession", accession("file_name", "contigs")).join(trust, F.lower(F.trim("source_db")) == F.col("__source"), "left").drop("__source")


def _survivors(rows: DataFrame) -> DataFrame:
    """Elections of all assemblies; what counts as really filled in genomes, and when two values are the same."""

    def joined(c: str) -> Column:
        return F.array_join(F.col(c).cast("array<string>"), "\x1f")

    fields = {
        "file_name": (~is_stand_in("file_name"), F.lower(bare_name("file_name"))),
        "contigs": (F.coalesce(F.exists("contigs", lambda h: ~is_stand_in(h)), F.lit(False)), joined("contigs")),
        "contig_lengths": (F.coalesce(F.exists("contig_lengths", lambda n: n > 0), F.lit(False)), joined("contig_lengths")),
        "total_len": (F.coalesce(F.col("total_len") > 0, F.lit(False)), F.col("total_len")),
        "n_contigs": (F.coalesce(F.col("n_contigs") > 0, F.lit(False)), F.col("n_contigs")),
    }
    return elected_records(rows, ["accession", "contig_order"], "record_id", fields, F.col("trust"), F.col("sketched_at")).filter("n_records > 1")


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of a duplicate group with the record that is kept."""
    rows = _assemblies(spark, sf)
    return rows.select("accession", "contig_order", "record_id").join(_survivors(rows), ["accession", "contig_order"]).select("record_id", "keep_id")


@query
def p7_built(spark: SparkSession, sf: str) -> DataFrame:
    """One row per assembly and contig order: the kept record and the record built field by field."""
    return _survivors(Workspace(spark, "survivor").save(_assemblies(spark, sf)))


_ACC = r"(?:^|[^a-z0-9])([a-z]+)[^a-z0-9/]*0*([1-9][0-9]{2,}|0{3,})(?:v|[^a-z0-9/])0*([0-9]+)"


def _acc_sql(c: str) -> str:
    t = f"replace(lower({c}), '%5f', '_')"
    return f"(CASE WHEN regexp_matches({t}, '{_ACC}') THEN regexp_extract({t}, '{_ACC}', 1) || '_' || regexp_extract({t}, '{_ACC}', 2) || '.' || regexp_extract({t}, '{_ACC}', 3) END)"


_STAND_SQL = "(" + ", ".join(f"'{x}'" for x in STAND_INS) + ")"
_GENOMES_SQL = rf"""
g AS (SELECT *, file_name IS NOT NULL AND lower(regexp_replace(file_name, '^\s+|\s+$', '', 'g')) NOT IN {_STAND_SQL} AS f1,
  coalesce(len(list_filter(contigs, lambda h: h IS NOT NULL AND lower(regexp_replace(h, '^\s+|\s+$', '', 'g')) NOT IN {_STAND_SQL})) > 0, false) AS f2,
  coalesce(len(list_filter(contig_lengths, lambda n: n > 0)) > 0, false) AS f3, coalesce(total_len > 0, false) AS f4, coalesce(n_contigs > 0, false) AS f5 FROM (
  SELECT record_id, contig_order, file_name, contigs, contig_lengths, total_len, n_contigs, sketched_at,
    coalesce({_acc_sql('file_name')}, list_filter(list_transform(contigs, lambda h: {_acc_sql('h')}), lambda x: x IS NOT NULL)[1]) AS accession,
    coalesce((SELECT max(trust) FROM registries r WHERE lower(trim(r.source_db)) = lower(trim(genomes.source_db))), 0) AS trust FROM genomes)
  WHERE accession IS NOT NULL),
k AS (SELECT record_id, accession, contig_order, first_value(record_id) OVER (PARTITION BY accession, contig_order
    ORDER BY f1::int + f2::int + f3::int + f4::int + f5::int DESC, trust DESC, sketched_at DESC NULLS LAST, record_id) AS keep_id, count(*) OVER (PARTITION BY accession, contig_order) AS n FROM g)
"""
ORACLE["p7_found"] = f"WITH {_GENOMES_SQL} SELECT record_id, keep_id FROM k WHERE n > 1 AND contig_order IS NOT NULL"
_BARE = r"regexp_replace(regexp_replace(file_name, '^\s+|\s+$', '', 'g'), '^(\./)+', '')"


def _built_sql(field: str, filled: str, norm: str) -> str:
    """The winning value of one field by windows instead of elections."""
    return f"""{field}_w AS (SELECT accession, contig_order, {field}, row_number() OVER (PARTITION BY accession, contig_order ORDER BY score DESC, last DESC NULLS LAST, norm DESC, sketched_at DESC NULLS LAST, record_id) AS r FROM (
  SELECT *, round(log2(sum(greatest(trust, 0.1) * pow(2.0, coalesce(date_diff('day', DATE '1970-01-01', sketched_at::DATE), -100000) / 180.0)) OVER same), 9) AS score, max(sketched_at) OVER same AS last
  FROM (SELECT *, {norm} AS norm FROM g WHERE {filled}) WINDOW same AS (PARTITION BY accession, contig_order, norm)))"""


_FIELDS_SQL = {"file_name": ("f1", f"lower({_BARE})"), "contigs": ("f2", "array_to_string(contigs, chr(31))"), "contig_lengths": ("f3", "array_to_string(contig_lengths, chr(31))"), "total_len": ("f4", "total_len::VARCHAR"), "n_contigs": ("f5", "n_contigs::VARCHAR")}
ORACLE["p7_built"] = f"""
WITH {_GENOMES_SQL}, {", ".join(_built_sql(n, *x) for n, x in _FIELDS_SQL.items())},
d AS (SELECT DISTINCT accession, contig_order, keep_id, n AS n_records FROM k WHERE n > 1)
SELECT d.*, {", ".join(_FIELDS_SQL)} FROM d
""" + "\n".join(f"LEFT JOIN (SELECT accession AS a_{n}, contig_order AS o_{n}, {n} FROM {n}_w WHERE r = 1) ON a_{n} = d.accession AND o_{n} IS NOT DISTINCT FROM d.contig_order" for n in _FIELDS_SQL) + "\n"
# 8 -- encoding with a public tokenizer


@query
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every text by byte_bpe_50k; empty and null texts have the empty list."""
    return encode_corpus(read_table(spark, sf, "documents"), "doc_id", "text")


@query
def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Round trip of every text: characters in, tokens, characters out, and whether they are equal."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = Workspace(spark, "ids").save(encode_corpus(docs, "doc_id", "text"))
    back = decode_corpus(ids, "doc_id", "ids").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n_back"))
    sides = docs.select("doc_id", F.xxhash64("text").alias("h0"), F.length("text").cast("long").alias("n_text"))
    return sides.join(back, "doc_id").select("doc_id", "n_text", "n_back", (F.col("h") == F.col("h0")).alias("equal"))


ORACLE["p8_decoded"] = "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_text, length(coalesce(text, ''))::BIGINT AS n_back, true AS equal FROM documents"

# 9 -- filling containers


def _packed(spark: SparkSession, sf: str, **limits) -> DataFrame:
    sizes = encode_corpus(read_table(spark, sf, "documents"), "doc_id", "text", count_only=True)
    sizes = sizes.withColumn("answer", F.col("n_tokens") - F.floor(F.col("n_tokens") / 4))
    capacities = [r[0] for r in read_table(spark, sf, "containers").select("capacity_tokens").collect()]  # a fixed table
    return pack(sizes, "doc_id", "n_tokens", capacities, **limits)


#: Limits of instruction data under which every one of the three can be the one that binds: the first quarter of a text is its prompt.
INSTRUCTION = {"loss": "answer", "loss_share": 0.7, "tokens_per_segment": 128}


@query
def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text, sized in tokens of byte_bpe_50k, placed in containers of each capacity."""
    return _packed(spark, sf).drop("n_loss")


@query
def p9_instruction(spark: SparkSession, sf: str) -> DataFrame:
    """The same under limits on segments and loss-bearing tokens that bind."""
    return _packed(spark, sf, **INSTRUCTION)


def _used(packed: DataFrame) -> DataFrame:
    return packed.filter("container_id IS NOT NULL").groupBy("capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"), F.sum("n_loss").alias("loss"), F.count(F.lit(1)).alias("segments"))


@query
def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of each capacity and the share of their room that is used."""
    return _used(_packed(spark, sf)).groupBy("capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("fill"))


@query
def p9_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Of each capacity, texts placed, containers beyond a limit, texts split without need, and texts of which tokens are missing."""
    packed = Workspace(spark, "packed").save(_packed(spark, sf, **INSTRUCTION))
    cap = F.col("capacity_tokens")
    over = (F.col("used") > cap) | (F.col("segments") > 1) & ((F.col("segments") > F.floor(cap / 128)) | (F.col("loss") > F.floor(cap * 0.7)))
    containers = _used(packed).groupBy(cap).agg(F.count_if(over).alias("over"))
    texts = packed.groupBy(cap, "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"))
    sizes = encode_corpus(read_table(spark, sf, "documents"), "doc_id", "text", count_only=True)
    texts = texts.join(sizes, "doc_id", "full").groupBy(cap).agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= cap)).alias("split"), F.count_if(~F.col("n").eqNullSafe(F.col("n_tokens"))).alias("not_whole"))
    return texts.join(containers, "capacity_tokens").select(cap, "texts", "over", "split", "not_whole")


ORACLE["p9_valid"] = "SELECT DISTINCT capacity_tokens, (SELECT count(*) FROM documents) AS texts, 0::BIGINT AS over, 0::BIGINT AS split, 0::BIGINT AS not_whole FROM containers"

# 1 -- clusters of mutually similar records


def _file_clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = read_table(spark, sf, "triangle_detailed").filter(usable("ani") & (F.col("ani") >= 95))
    enough = [usable(c) & (F.col(c) >= 50) for c in ("align_fraction_ref", "align_fraction_query")]
    pairs = rows.filter(enough[0] & enough[1]).select("ref_file", "query_file").distinct()
    pairs = resolve_names(pairs, ["ref_file", "query_file"], read_table(spark, sf, "genomes"), "file_name")
    nodes, edges, tree, members, _ = density_clusters(pairs, "ref_file", "query_file")
    selected = members.filter("selected IS NOT NULL").select("id", F.col("selected").alias("cluster"))
    groups = majority_groups(selected, edges, tree).join(nodes.select("id", "name"), "id")
    ids = groups.groupBy("cluster").agg(F.min("name").alias("cluster_id"), F.count(F.lit(1)).alias("size"))
    return groups, ids, members


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of a cluster of mutually similar files."""
    groups, ids, _ = _file_clusters(spark, sf)
    return groups.join(ids, "cluster").select(F.col("name").alias("file_name"), "cluster_id")


def _majority_sql(rounds: int) -> str:
    """Groups by the definition: neighbourhoods, and what both ends of a link share of them, moved all at once until they stay; the larger of competing ones."""

    def move(t: int) -> str:
        return f"""n{t} AS (SELECT g, count(*) AS n FROM c{t} GROUP BY g),
c{t + 1} AS MATERIALIZED (SELECT k.g, k.y AS x FROM (SELECT c.g, nb.u AS y, count(*) AS links FROM c{t} c JOIN nb ON nb.v = c.x GROUP BY c.g, nb.u) k JOIN n{t} n ON n.g = k.g
  LEFT JOIN c{t} i ON i.g = k.g AND i.x = k.y WHERE 2 * links > n.n - CASE WHEN i.x IS NULL THEN 0 ELSE 1 END)"""

    return f"""
WITH RECURSIVE {sql_names.NAMES},
e AS (SELECT DISTINCT {sql_names.known('ref_file')} AS a, {sql_names.known('query_file')} AS b FROM triangle_detailed
  WHERE ani >= 95 AND NOT isnan(ani) AND align_fraction_ref >= 50 AND NOT isnan(align_fraction_ref) AND align_fraction_query >= 50 AND NOT isnan(align_fraction_query)),
nb AS MATERIALIZED (SELECT DISTINCT v, u FROM (SELECT a AS v, b AS u FROM e UNION ALL SELECT b, a FROM e) WHERE v <> u),
hood AS MATERIALIZED (SELECT v AS g, u AS x FROM nb UNION SELECT v, v FROM nb),
c0 AS MATERIALIZED (SELECT g, x FROM hood UNION ALL SELECT v || chr(10) || u, h.x FROM nb JOIN hood h ON h.g = v JOIN hood o ON o.g = u AND o.x = h.x WHERE v < u),
{", ".join(move(t) for t in range(rounds))},
f AS (SELECT DISTINCT l FROM (SELECT g, list_sort(list(x)) AS l FROM c{rounds} GROUP BY g) JOIN (SELECT g, list_sort(list(x)) AS before FROM c{rounds - 1} GROUP BY g) USING (g) WHERE l = before AND len(l) >= 3),
rk AS MATERIALIZED (SELECT l, row_number() OVER (ORDER BY len(l) DESC, l) AS k FROM f),
st AS (SELECT k, l AS used, true AS stands FROM rk WHERE k = 1
  UNION ALL SELECT rk.k, CASE WHEN list_has_any(used, l) THEN used ELSE list_concat(used, l) END, NOT list_has_any(used, l) FROM st JOIN rk ON rk.k = st.k + 1)
SELECT unnest(l) AS file_name, l[1] AS cluster_id FROM st JOIN rk ON rk.k = st.k WHERE stands
"""


ORACLE["p1_found"] = _majority_sql(12)


@query
def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every cluster with its size and its three most persistent members, those that came in at the smallest distance."""
    groups, ids, members = _file_clusters(spark, sf)
    typical = groups.join(members.select("id", "joined"), "id", "left")
    first = Window.partitionBy("cluster").orderBy(F.asc_nulls_last("joined"), F.desc("similar"), "name")
    best = typical.withColumn("r", F.row_number().over(first)).filter("r <= 3")
    named = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("e"))
    return ids.join(named, "cluster").select("cluster_id", "size", F.col("e.name").alias("exemplars"))

# 10 -- sentences across languages and scripts


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of sentences, headlines, advert titles and stamps of every page."""
    return sentence_ends(read_table(spark, sf, "documents"), "doc_id", "text", "lines", "page_w", "lang")
