"""Readers, run on lines made from the fixture views; files are covered by tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import names as N
from ..sources import bed, fasta, labelled, scores, shards, text
from . import views
from .core import query

_KEEP = 'SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY row_idx) - 1 AS row_idx, chrom, start, "end" FROM iv_sample'


def _bed_lines(spark, d):
    """An interval a line, a comment after every tenth."""
    s = views.iv_sample(spark, d)
    text = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("extra"))
    rows = s.select("set_id", (F.col("row_idx") * 2).alias("line_no"), text.alias("value"))
    notes = s.filter("row_idx % 10 = 0").select("set_id", (F.col("row_idx") * 2 + 1).alias("line_no"), F.lit("# a comment").alias("value"))
    return rows.unionByName(notes)


def _messy_lines(spark, d):
    """As _bed_lines, with blank and header lines and bad rows."""
    s = views.iv_sample(spark, d)
    k = F.col("row_idx") % 50
    bad = F.when(k == 0, F.lit("")).when(k == 1, F.lit("track name=x")).when(k == 2, F.lit("browser position")).when(k == 3, F.lit("chr1\t5")).when(k == 4, F.lit("chr1\tx\t9")).when(k == 5, F.lit("chr1\t-4\t9")).when(k == 6, F.lit("chr1\t9\t4"))
    text = F.coalesce(bad, F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")))
    return s.select("set_id", F.col("row_idx").alias("line_no"), text.alias("value"))


@query(_KEEP)
def scan_bed(spark, d):
    return bed.parse(_bed_lines(spark, d))


@query(f"SELECT * FROM ({_KEEP}) WHERE row_idx < 7")
def scan_bed_limit(spark, d):
    return bed.parse(_bed_lines(spark, d), limit=7)


@query(f"""WITH k AS ({_KEEP}), o AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY md5(set_id || '_' || row_idx || '_42'), row_idx) - 1 AS place FROM k)
SELECT * FROM o WHERE place < 20""")
def scan_bed_shuffle(spark, d):
    return bed.shuffled(bed.parse(_bed_lines(spark, d)), 20)


@query("""SELECT set_id, row_idx AS line_no, CASE row_idx % 50 WHEN 3 THEN 'columns' WHEN 4 THEN 'integer' WHEN 5 THEN 'negative' WHEN 6 THEN 'order' END AS bad_reason
FROM iv_sample WHERE row_idx % 50 NOT IN (0, 1, 2)""")
def scan_bed_clean(spark, d):
    return bed.parse_lenient(_messy_lines(spark, d)).select("set_id", "line_no", "bad_reason")


@query("""WITH l AS (SELECT set_id, row_idx, CASE WHEN row_idx % 50 = 5 THEN 13 ELSE "end" - start END AS length FROM iv_sample WHERE row_idx % 50 NOT IN (0, 1, 2, 3, 4, 6)),
n AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY row_idx) - 1 AS row_idx, length FROM l) SELECT * FROM n WHERE row_idx < 500""")
def scan_lengths(spark, d):
    return bed.lengths(_messy_lines(spark, d), limit=500)


@query(_KEEP)
def scan_bed_ws(spark, d):
    rows = _bed_lines(spark, d).filter(~F.col("value").startswith("#")).withColumn("value", F.concat(F.lit("  "), F.replace("value", F.lit("\t"), F.lit("   "))))
    return bed.parse_whitespace(rows)


def _records(spark, d):
    s = views.sequences(spark, d)
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.length("seq"), F.lit(60)), lambda i: F.substring("seq", i + 1, F.lit(60))), "\n")
    return s.select(F.concat(F.lit(">"), "chrom", F.lit(" a note\n"), body, F.lit("\n")).alias("value"))


@query("SELECT chrom, seq FROM sequences")
def scan_fasta(spark, d):
    return fasta.parse(_records(spark, d))


def _sequence_lines(spark, d):
    """Files of many records: a header, then 60 letters a line."""
    rows = views.sequences(spark, d).withColumn("id", F.substring("chrom", 4, 20).cast("long"))
    body = F.transform(F.sequence(F.lit(0), F.length("seq"), F.lit(60)), lambda i: F.substring("seq", i + 1, F.lit(60)))
    text = F.concat(F.array(F.concat(F.lit(">"), F.col("chrom"), F.lit(" a note"))), body)
    return rows.select(F.concat(F.lit("file"), (F.col("id") % 4).cast("string")).alias("set_id"), "id", F.posexplode(text).alias("k", "value")).select("set_id", (F.col("id") * 4096 + F.col("k")).alias("line_no"), "value")


@query("SELECT chrom, b AS block, substr(seq, (b * 64 + 1)::BIGINT, 96) AS letters, length(seq)::BIGINT AS size FROM sequences, unnest(range(0, (length(seq) + 63) // 64)) AS t(b)")
def fasta_blocks(spark, d):
    """Blocks of 64 letters and the first 32 of the next, cut from lines: records go over several segments, segments over several records."""
    found = fasta.parse_blocks(_sequence_lines(spark, d), 64, 32)
    return found.letters.join(found.sizes, "chrom")


@query("SELECT chrom, length(seq)::BIGINT AS length FROM sequences")
def fasta_shape(spark, d):
    return fasta.shape(fasta.parse(_records(spark, d)))


@query("""SELECT chrom, row_number() OVER (ORDER BY chrom) - 1 AS idx, length(seq)::BIGINT AS size, (sum(length(seq)) OVER (ORDER BY chrom) - length(seq))::BIGINT AS "offset",
[instr('ATCG', x) - 1 FOR x IN string_split(seq, '') IF x <> '']::INT[] AS tokens FROM (SELECT chrom, replace(seq, 'N', '') AS seq FROM sequences)""")
def fasta_tokens(spark, d):
    return fasta.tokens(views.sequences(spark, d).withColumn("seq", F.replace("seq", F.lit("N"), F.lit(""))), "chrom")


@query('SELECT chrom, (sum(n) OVER (ORDER BY chrom) - n)::BIGINT AS "offset" FROM (SELECT chrom, length(seq) AS n FROM sequences)')
def chrom_offsets(spark, d):
    return fasta.tokens(views.sequences(spark, d), "chrom").select("chrom", "offset")


def _seqpare_lines(spark, d, gap):
    v = views.vecs(spark, d).select(F.concat(F.lit("set"), F.col("label").cast("string")).alias("set_id"), (F.col("row_idx") + 1).alias("line_no"), F.round(F.abs(F.col("vec")[0]), 4).cast("string").alias("x"), "row_idx")
    text = F.when((F.col("row_idx") % 20 == 0) & F.lit(gap != "\t"), F.lit("too few")).otherwise(F.concat_ws(gap, F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"), "x", F.concat(F.lit("a/b.c/name"), F.col("row_idx").cast("string"), F.when(F.col("row_idx") % 2 == 0, ".bed.gz").otherwise(".bed"))))
    rows = v.select("set_id", "line_no", text.alias("value"))
    return rows.unionByName(rows.select("set_id").distinct().select("set_id", F.lit(0).cast("long").alias("line_no"), F.lit("a header").alias("value")))


_SEQPARE = "SELECT 'set' || label AS label, 'name' || row_idx AS other, round(abs(vec[1]), 4) AS similarity FROM vecs"


@query(_SEQPARE + " WHERE row_idx % 20 <> 0")
def scan_seqpare(spark, d):
    return scores.parse_seqpare(_seqpare_lines(spark, d, "  "))


@query(_SEQPARE)
def scan_seqpare_strict(spark, d):
    return scores.parse_seqpare(_seqpare_lines(spark, d, "\t"), strict=True)


@query("SELECT 'name' || row_idx AS set_id, row_idx AS id, round(vec[1], 4) AS score FROM vecs WHERE row_idx % 2 = 0")
def scan_scores(spark, d):
    v = views.vecs(spark, d)
    lines = v.select(F.lit("f").alias("set_id"), (F.col("row_idx") + 1).alias("line_no"), F.concat_ws("\t", F.concat(F.lit("dir/name"), F.col("row_idx").cast("string"), F.lit(".bed.gz")), F.round(F.col("vec")[0], 4).cast("string")).alias("value"))
    known = v.filter("row_idx % 2 = 0").select(F.concat(F.lit("name"), F.col("row_idx").cast("string")).alias("set_id"), F.col("row_idx").alias("id"))
    return scores.parse_scores(lines, known, extensions=2)


def _ranks(spark, d):
    v = views.vecs(spark, d).withColumn("set_id", F.concat(F.lit("base"), F.col("label").cast("string")))
    rows = v.select("set_id", (F.col("row_idx") + 1).alias("line_no"), F.when(F.col("row_idx") % 30 == 0, "# a comment").otherwise(F.concat_ws("\t", F.concat(F.lit("dir/name"), F.col("row_idx").cast("string"), F.lit(".bed.gz")), F.lit("x"), F.round(F.col("vec")[0], 1).cast("string"))).alias("value"))
    return rows.unionByName(v.select("set_id").distinct().select("set_id", F.lit(0).cast("long").alias("line_no"), F.lit("file\tother\tcombo_score").alias("value")))


@query("""WITH s AS (SELECT 'base' || label AS base, 'name' || row_idx AS other, round(vec[1], 1) AS score, row_idx FROM vecs WHERE row_idx % 30 <> 0)
SELECT base, other, score, row_number() OVER (PARTITION BY base ORDER BY score DESC, row_idx)::INT AS rank FROM s""")
def scan_legacy_ranks(spark, d):
    return scores.parse_legacy_ranks(_ranks(spark, d))


@query("""WITH h AS (SELECT *, row_idx // 10 AS g FROM iv_sample) SELECT set_id, 'chrq' || max(CASE WHEN row_idx % 10 = 0 THEN row_idx END) OVER (PARTITION BY set_id ORDER BY row_idx) AS query, chrom, start, "end" FROM h
QUALIFY row_idx % 10 <> 0""")
def scan_legacy_hits(spark, d):
    s = views.iv_sample(spark, d)
    text = F.when(F.col("row_idx") % 10 == 0, F.concat(F.lit("##chrq"), F.col("row_idx").cast("string"))).otherwise(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")))
    return scores.parse_legacy_hits(s.select("set_id", F.col("row_idx").alias("line_no"), text.alias("value")))


@query("""SELECT 'sample' || (row_idx % 4) || '_' || CASE row_idx % 3 WHEN 0 THEN 'Enhancers' WHEN 1 THEN 'Heterochromatin' ELSE 'Quiescent_Low' END AS set_id, chrom, start, "end" FROM iv_sample""")
def split_by_state(spark, d):
    s = views.iv_sample(spark, d)
    label = F.concat(F.lit("s"), (F.col("row_idx") % 3).cast("string"))
    lines = s.select(F.concat(F.lit("E"), (F.col("row_idx") % 4).cast("string"), F.lit("_15_core")).alias("set_id"), F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), label).alias("value"))
    samples = spark.range(4).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("sample_id"), F.concat(F.lit("sample"), F.col("id").cast("string")).alias("sample"))
    states = spark.sql("SELECT * FROM VALUES ('s0', 'Enhancers'), ('s1', 'Heterochromatin'), ('s2', 'Quiescent_Low') AS t(label, state)")
    return bed.demultiplex(lines, samples, states)


@query("""SELECT row_idx, 'cell_' || label AS cell, CASE row_idx % 3 WHEN 0 THEN 'Enhancers' WHEN 1 THEN 'Genic_enhancers' ELSE 'Flanking_Active_TSS' END AS state FROM vecs""")
def name_split(spark, d):
    v = views.vecs(spark, d)
    k = F.col("row_idx") % 3
    name = F.concat(F.lit("cell_"), F.col("label").cast("string"), F.lit("_"), F.when(k == 0, "Enhancers").when(k == 1, "Genic_enhancers").otherwise("Flanking_Active_TSS"))
    return v.select("row_idx", N.split_name(name).alias("s")).select("row_idx", "s.cell", "s.state")


@query("SELECT row_idx, 'name' || row_idx || '.v1' AS base, 'gz' AS ext, 'name' || row_idx || '.v1' AS cleaned FROM vecs")
def ext_strip(spark, d):
    name = F.concat(F.lit("dir/name"), F.col("row_idx").cast("string"), F.lit(".v1.bed.gz"))
    return views.vecs(spark, d).select("row_idx", N.strip_extensions(name, 2).alias("base"), N.extension(name).alias("ext"), N.clean_name(F.substring_index(name, "/", -1)).alias("cleaned"))


@query("SELECT row_idx, CASE WHEN contains(t, '.') THEN list_extract(string_split(t, '.'), -1) ELSE '' END AS ext FROM (SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN 'a.b' || row_idx ELSE 'ab' END AS t FROM vecs)")
def file_ext(spark, d):
    name = F.when(F.col("row_idx") % 2 == 0, F.concat(F.lit("a.b"), F.col("row_idx").cast("string"))).otherwise(F.lit("ab"))
    return views.vecs(spark, d).select("row_idx", N.extension(name).alias("ext"))


@query("SELECT DISTINCT 'cell' || label || '_Enhancers' AS name FROM vecs")
def known_names(spark, d):
    v = views.vecs(spark, d).select(F.explode(F.array(F.concat(F.lit("cell"), F.col("label").cast("string"), F.lit("_Enhancers.bed")), F.lit("cell1_Unknown.bed"))).alias("file")).distinct()
    name = N.strip_extensions(F.col("file"))
    ok = F.lit(False)
    for state in N.CHROMATIN_STATES:
        ok = ok | name.endswith(f"_{state}")
    return v.filter(ok).select(name.alias("name")).orderBy("name")


@query("SELECT s.row_idx, n.n_nationkey AS id, r.r_name AS category FROM iv_sample s JOIN nation n ON n.n_nationkey = s.row_idx % 25 JOIN region r ON r.r_regionkey = n.n_regionkey")
def category_of(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = F.broadcast(n.select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("category")))  # 25 rows, whatever the scale
    return views.iv_sample(spark, d).select("row_idx", (F.col("row_idx") % 25).alias("k")).join(dim, F.col("k") == F.col("id")).select("row_idx", "id", "category")


_CATEGORY = "CASE row_idx % 6 WHEN 0 THEN 'Brain' WHEN 1 THEN 'Blood & T-cell' WHEN 2 THEN 'Skin' WHEN 3 THEN 'Fetal lung' WHEN 4 THEN 'Digestive' END"


@query(f"SELECT row_idx, CASE WHEN regexp_matches(lower({_CATEGORY}), 'brain|skin|lung|digestive') THEN {_CATEGORY} END AS category FROM vecs")
def category_filter(spark, d):
    return views.vecs(spark, d).select("row_idx", N.plot_category(F.expr(_CATEGORY)).alias("category"))


_STATE = "CASE row_idx % 3 WHEN 0 THEN 'Enhancers' WHEN 1 THEN 'Genic_enhancers' ELSE 'Flanking_Active_TSS' END"
_STATE_ID = "CASE row_idx % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 1 END"
_CELLS = [f"cell_{i}" for i in range(25)]


def _numbers(spark, d, column, name):
    cell = F.concat(F.lit("cell_"), (F.col("row_idx") % 25).cast("string"))
    state = F.expr(_STATE)
    return views.iv_sample(spark, d).select("row_idx", column(cell, state).alias(name))


@query(f"SELECT row_idx, ({_STATE_ID})::BIGINT AS state_id FROM iv_sample")
def chro_state_id(spark, d):
    return _numbers(spark, d, lambda cell, state: N.state_number(state), "state_id")


@query("SELECT row_idx, row_idx % 25 AS cell_id FROM iv_sample")
def cell_type_id(spark, d):
    return _numbers(spark, d, lambda cell, state: N.number_of(cell, _CELLS), "cell_id")


@query(f"SELECT row_idx, (row_idx % 25) * 15 + {_STATE_ID} AS bed_id FROM iv_sample")
def bed_id(spark, d):
    return _numbers(spark, d, lambda cell, state: N.set_number(F.concat_ws("_", cell, state), _CELLS), "bed_id")


@query("""WITH f AS (SELECT 'root/train/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, coalesce(lang, 'none') AS label, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents),
t AS (SELECT path, label, dense_rank() OVER (ORDER BY label) - 1 AS label_idx, left(CASE WHEN substr(md5(path || '_42'), 1, 1) < '8' THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END, 100) AS seq FROM f)
SELECT path, label, label_idx::INT AS label_idx, seq, list_append([instr('ATCG', x) - 1 FOR x IN string_split(seq, '') IF x <> ''], 4)::INT[] AS tokens FROM t""")
def scan_labelled_dirs(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    path = F.concat(F.lit("root/train/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = t.select(path.alias("path"), F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("value"))
    return labelled.parse(files, 100, augment=True)


def _folder(spark) -> str:
    """A new folder that all executors reach: under the checkpoint folder of the session, or, in local mode without one, of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{top}/{uuid.uuid4().hex}" if top else tempfile.mkdtemp(prefix="round")


@query("SELECT row_idx, vec FROM vecs")
def shards_round_trip(spark, d):
    """Vectors through the shard source: written by seven tasks that take turns, read again by ranges."""
    path = _folder(spark)
    shards.write(views.vecs(spark, d).select("row_idx", "vec"), path, 7)
    return shards.read(spark, path)


@query("SELECT set_id, row_idx, vec::FLOAT[]::DOUBLE[] AS vec FROM set_vecs")
def embeddings_round_trip(spark, d):
    path = f"{_folder(spark)}/embeddings"
    scores.write_embeddings(views.set_vecs(spark, d), path)
    return scores.read_embeddings(spark, path)


@query("SELECT 'name' || row_idx AS set_id, row_idx AS id, round(vec[1], 4) AS score FROM vecs")
def scores_round_trip(spark, d):
    path = f"{_folder(spark)}/scores"
    v = views.vecs(spark, d).select(F.concat(F.lit("name"), F.col("row_idx").cast("string")).alias("name"), F.round(F.col("vec")[0], 4).alias("cmodel_delta"), F.round(F.col("vec")[1], 4).alias("foundation_model_delta"), "row_idx")
    scores.write_scores(v, path)
    files = text.lines(spark, path)
    return scores.parse_scores(files, v.select(F.col("name").alias("set_id"), F.col("row_idx").alias("id")), extensions=0)
