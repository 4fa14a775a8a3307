"""Files in and out, and the golden pipeline over them."""

import gzip

import pytest
from pyspark.sql import functions as F

from spanforge.functions.names import with_bed_extension
from spanforge.functions.vectors import vector_mean
from spanforge.operators import aggregates as A
from spanforge.operators import embed as E
from spanforge.operators import joins as J
from spanforge.operators import partitioning as P
from spanforge.sources import bed, fasta, scores
from spanforge.sources.text import lines

#: Intervals, sequences and the vectors that they must give.
ROWS = [("chr1", 0, 1), ("chr1", 0, 40), ("chr1", 5, 15), ("chr1", 10, 20), ("chr1", 15, 25), ("chr1", 10, 30), ("chr2", 10, 30), ("chr2", 30, 40), ("chr2", 20, 25), ("chr3", 0, 5), ("chr3", 5, 10)]
SEQ = {"chr1": "ACGTAGCTTAGACTACGCAGCATATAGCGCGCTAGCTACC", "chr2": "TTTTAGCGAAAATCGCGTCGTAAATATGCGCGCTATAAAA", "chr3": "AAAAATTTTT"}
GOLDEN = [[1, 0, 0, 0], [2.75, 3, 2.25, 2], [3, 2, 2, 3], [3, 3, 3, 1], [3, 3, 2, 2], [3, 3, 2.5, 1.5], [3, 2, 2.5, 2.5], [5, 2, 1, 2], [3, 0, 0, 2], [5, 0, 0, 0], [0, 0, 0, 5]]


@pytest.fixture
def files(tmp_path):
    text = "# a comment\n" + "".join(f"{c}\t{s}\t{e}\tx\n" for c, s, e in ROWS)
    (tmp_path / "a.bed").write_text(text)
    with gzip.open(tmp_path / "b.bed.gz", "wt") as out:
        out.write(text)
    (tmp_path / "x.fa").write_text("".join(f">{k} note\n{v[:15]}\n{v[15:]}\n" for k, v in SEQ.items()))
    return tmp_path


def test_bed(spark, files):
    rows = bed.read(spark, [f"{files}/a.bed", f"{files}/b.bed.gz"]).orderBy("set_id", "row_idx").collect()
    assert [(r["chrom"], r["start"], r["end"]) for r in rows] == ROWS * 2 and [r["set_id"] for r in rows] == ["a"] * 11 + ["b"] * 11
    assert bed.read(spark, f"{files}/a.bed", limit=3).count() == 3 and bed.read(spark, f"{files}/a.bed", limit=0).count() == 11
    with pytest.raises(ValueError):
        bed.read(spark, f"{files}/x.fa")
    (files / "c.bed").write_text("chr1\t5\tx\n")
    with pytest.raises(Exception, match="not an interval"):
        bed.read(spark, f"{files}/c.bed").collect()


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "l.bed").write_text("".join(f"chr1\t{i}\t{i + 1}\n" for i in range(5000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = bed.parse(lines(spark, f"{tmp_path}/l.bed")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert all(r["row_idx"] == r["start"] for r in rows) and len(rows) == 5000


def test_extensions():
    there = {"a.bed", "b.bed.gz"}
    assert [with_bed_extension(p, there.__contains__) for p in ("a.bed", "a.bed.gz", "b.bed", "b", "a")] == ["a.bed", "a.bed", "b.bed.gz", "b.bed.gz", "a.bed"]
    with pytest.raises(FileNotFoundError):
        with_bed_extension("c", there.__contains__)


def test_fasta(spark, files):
    got = {r["chrom"]: r["seq"] for r in fasta.read(spark, f"{files}/x.fa").collect()}
    assert got == SEQ
    two = spark.createDataFrame([("a", "ATCG"), ("b", "GCTA")], "chrom string, seq string")
    rows = fasta.tokens(two, "chrom").orderBy("idx").collect()
    assert [(r["offset"], r["size"], r["tokens"]) for r in rows] == [(0, 4, [0, 1, 2, 3]), (4, 4, [3, 2, 1, 0])]


def test_pipeline_golden(spark, files):
    out = E.embed(bed.read(spark, f"{files}/a.bed"), fasta.read(spark, f"{files}/x.fa"), E.CountAcgt(10)).orderBy("row_idx").collect()
    assert [r["vec"] for r in out] == GOLDEN
    count = lambda texts: [[float(t.count(x)) for x in "ACGT"] for t in texts]
    out = E.embed_with(bed.read(spark, f"{files}/a.bed"), fasta.read(spark, f"{files}/x.fa"), E.FunctionModel(count, 10, 4), batch=2).orderBy("row_idx").collect()
    assert [r["vec"] for r in out] == GOLDEN


def test_lookup_errors(spark, files):
    seq = fasta.read(spark, f"{files}/x.fa")
    for bad in (("chr9", 0, 1), ("chr3", -1, 3), ("chr3", 0, 11)):
        with pytest.raises(Exception, match="sequence"):
            E.look_up(spark.createDataFrame([(0, *bad)], "row_idx long, chrom string, start long, end long"), seq).collect()


def test_dechunk(spark):
    from spanforge.functions.sequences import count_letter

    df = spark.createDataFrame([(0, "aaaBBBcccD"), (1, "bb"), (2, "")], "idx long, seq string")
    got = {r["idx"]: r["vec"] for r in E.dechunk_mean(df, 3, lambda p: F.array(count_letter(p, "B") + F.length(p))).collect()}
    assert got == {0: [(3 + 6 + 3 + 1) / 4], 1: [2.0], 2: None}


def test_scatter_mean(spark):
    df = spark.createDataFrame([(0, [10.0, 1.0]), (1, [20.0, 2.0]), (0, [30.0, 3.0]), (0, [40.0, 4.0]), (3, [1.0, 1.0])], "i int, vec array<double>")
    got = {r["i"]: r["vec"] for r in A.scatter_mean(df, "i", "vec", 2).collect()}
    assert got == {0: [80 / 3, 8 / 3], 1: [20, 2], 2: [0, 0], 3: [1, 1]}


def test_union_places(spark):
    lists = spark.createDataFrame([(0, 5), (1, 20), (2, 8), (3, 13)], "list int, size int")
    rows = J.locate(lists, spark.range(46).withColumnRenamed("id", "idx")).orderBy("idx").collect()
    assert [(r["list"], r["offset"]) for r in rows] == [(k, i) for k, n in enumerate((5, 20, 8, 13)) for i in range(n)]


def test_writers(spark, files, tmp_path):
    rows = bed.read(spark, [f"{files}/a.bed", f"{files}/b.bed.gz"])
    bed.write(rows, f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out")
    assert back.count() == 22 and {r["set_id"] for r in back.select("set_id").distinct().collect()} == {"a", "b"}
    vec = spark.createDataFrame([("s", 0, [1.0, 2.0]), ("s", 1, [3.0, 4.0]), ("t", 0, [0.5, 0.5])], "set_id string, row_idx long, vec array<double>")
    scores.write_embeddings(vec, f"{tmp_path}/emb")
    got = scores.read_embeddings(spark, f"{tmp_path}/emb")
    assert sorted(map(tuple, got.select("set_id", "row_idx").collect())) == [("s", 0), ("s", 1), ("t", 0)]
    assert {r["set_id"]: r["vec"] for r in vector_mean(got, ["set_id"]).collect()} == {"s": [2.0, 3.0], "t": [0.5, 0.5]}
    scores.write_scores(spark.createDataFrame([("a", 0.5, 1.5)], "name string, cmodel_delta double, foundation_model_delta double"), f"{tmp_path}/scores")
    known = spark.createDataFrame([("a", 7)], "set_id string, id long")
    parsed = scores.parse_scores(lines(spark, f"{tmp_path}/scores"), known, extensions=0)
    assert [tuple(r) for r in parsed.collect()] == [("a", 7, 0.5)]
    with pytest.raises(Exception, match="missing"):
        scores.parse_scores(lines(spark, f"{tmp_path}/scores"), known.withColumn("set_id", F.lit("z")), extensions=0).collect()


def test_demultiplex_errors(spark):
    samples = spark.createDataFrame([("E1", "liver")], "sample_id string, sample string")
    states = spark.createDataFrame([("1_Tss", "TSS")], "label string, state string")
    df = lambda v: spark.createDataFrame([("E1_x", 0, v)], "set_id string, line_no long, value string")
    assert bed.demultiplex(df("chr1\t1\t2\t1_Tss"), samples, states).first()["set_id"] == "liver_TSS"
    for bad in ("chr1\t1\t2", "chr1\t1\t2\tother"):
        with pytest.raises(Exception, match="under 4|unknown"):
            bed.demultiplex(df(bad), samples, states).collect()


def test_block_split_with_few_items(spark):
    rows = spark.range(3).select(P.block_split(F.col("id"), F.lit(3), 7).alias("x")).collect()
    assert [r["x"] for r in rows] == [0, 1, 2]

def test_letters_from_blocks(spark):
    """Sequences cut into small blocks give the letters that the whole ones give, for short and long, repeated and empty intervals."""
    import random

    draw = random.Random(5)
    seqs = {f"c{i}": "".join(draw.choice("ACGTn") for _ in range(n)) for i, n in enumerate((0, 1, 7, 8, 40, 101))}
    rows = []
    for c, s in seqs.items():
        for _ in range(40):
            a = draw.randint(0, len(s) + 3)
            rows.append((len(rows) // 2, c, a, a + draw.randint(0, len(s))))
    rows += rows[-30:]
    iv = spark.createDataFrame(rows, "row_idx long, chrom string, start long, end long")
    seq = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    got = sorted(tuple(r) for r in E.look_up(iv, seq, block=8, margin=5).select("row_idx", "chrom", "start", "end", "letters").collect())
    assert got == sorted((*r, seqs[r[1]][r[2] : r[3]]) for r in rows)


def test_labelled_folders(spark, tmp_path):
    from spanforge.sources import labelled

    for label, name, text in (("pos", "a.txt", "ACGTN\n"), ("neg", "b.txt", "\n"), ("neg", "c.txt", "TTTTTTTT"), ("neg", "d.txt", ""), ("neg", "_SUCCESS", "")):
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_text(text)
    rows = {r["path"][-5]: r for r in labelled.parse(labelled.read(spark, str(tmp_path)), 5).collect()}
    assert {k: (r["label"], r["label_idx"], r["seq"]) for k, r in rows.items()} == {"a": ("pos", 1, "ACGTN"), "b": ("neg", 0, ""), "c": ("neg", 0, "TTTTT"), "d": ("neg", 0, "")}
    assert rows["a"]["tokens"] == [0, 2, 3, 1, None, 4] and rows["b"]["tokens"] == [4]


def test_unknown_names_are_errors(spark):
    from spanforge.functions import names as N

    df = spark.createDataFrame([("b",), (None,)], "name string")
    assert [r[0] for r in df.select(N.number_of(F.col("name"), ["a", "b"])).collect()] == [1, None]
    with pytest.raises(Exception, match="unknown name: b"):
        df.select(N.number_of(F.col("name"), ["a"])).collect()
