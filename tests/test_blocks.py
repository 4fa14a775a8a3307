"""Files read in splits of any size: line numbers, carried headers and blocks of letters."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from spanforge.operators import embed as E
from spanforge.sources import blocks, fasta, scores
from spanforge.sources import text as X


@contextmanager
def splits_of(spark, size):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, size)
    try:
        yield
    finally:
        for k, v in zip(keys, was, strict=True):
            spark.conf.set(k, v)


def records(rng, sizes):
    return {f"s{i}": "".join(rng.choice("ACGTNacgt") for _ in range(n)) for i, n in enumerate(sizes)}


def write(path, seqs, width, end="\n"):
    lines = []
    for name, seq in seqs.items():
        lines.append(f">{name} note >x")
        lines += [seq[i : i + width] for i in range(0, len(seq), width)]
        lines.append("")
    path.write_bytes(end.join(lines).encode())


def joined(found):
    """Whole sequences again, by the first `block` letters of each block; margins are checked on the way."""
    out = {}
    rows = {(r["chrom"], r["block"]): r["letters"] for r in found.letters.collect()}
    for (chrom, b), letters in sorted(rows.items()):
        assert letters[found.block :] == rows.get((chrom, b + 1), "")[: found.margin]
        out[chrom] = out.get(chrom, "") + letters[: found.block]
    return out


@pytest.mark.parametrize(("size", "width", "end", "block", "margin"), [("2k", 60, "\n", 64, 64), ("300b", 7, "\r\n", 100, 10), ("4k", 100_000, "\n", 1000, 500), ("1m", 60, "\n", 64, 1)])
def test_fasta_in_blocks(spark, tmp_path, size, width, end, block, margin):
    rng = random.Random(width)
    n = 1200 if size == "300b" else 6000
    a, b = records(rng, (0, 1, n, 64, 0, 3)), {f"t{k}": v for k, v in records(rng, (2 * n, 128)).items()}
    write(tmp_path / "a.fa", a, width, end)
    write(tmp_path / "b.fa", b, width, end)
    with splits_of(spark, size):
        found = fasta.read_blocks(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa"], block, margin)
        assert joined(found) == {k: v for k, v in (a | b).items() if v}
        assert {r["chrom"]: r["size"] for r in found.sizes.collect()} == {k: len(v) for k, v in (a | b).items()}
        if size == "4k":
            stored = found.store(f"{tmp_path}/stored")
            assert (stored.block, stored.margin) == (block, margin)
            assert joined(blocks.load(spark, f"{tmp_path}/stored")) == joined(found)


def test_one_long_record_is_read_by_many_tasks(spark, tmp_path):
    seqs = records(random.Random(1), (400_000,))
    write(tmp_path / "one.fa", seqs, 60)
    with splits_of(spark, "16k"):
        lines = X.split_lines(spark, f"{tmp_path}/one.fa")
        assert lines.select(F.spark_partition_id()).distinct().count() > 20
        assert joined(fasta.cut_lines(lines, 4096, 100)) == seqs


def test_blocks_of_a_table(spark):
    seqs = records(random.Random(2), (10, 0, 500, 77))
    lines, n = [], 0
    for name, seq in seqs.items():
        for value in [f">{name}", *[seq[i : i + 9] for i in range(0, len(seq), 9)]]:
            lines.append(("f", n, value))
            n += 20_000  # so that there are several segments
    rows = spark.createDataFrame(lines, "set_id string, line_no long, value string").orderBy(F.rand(3))
    assert joined(fasta.parse_blocks(rows, 32, 8)) == {k: v for k, v in seqs.items() if v}
    empty = fasta.parse_blocks(rows.filter("false"))
    assert empty.letters.count() == 0 and empty.sizes.count() == 0


@pytest.mark.parametrize(("text", "message"), [("ACGT\n>a\nAC\n", "before the first header"), (">a\nAC\n>b\n>a\nGT\n", "given twice"), (">a\nACÄ\n", "beyond ASCII")])
def test_bad_sequences_are_errors(spark, tmp_path, text, message):
    (tmp_path / "x.fa").write_text(text)
    with pytest.raises(Exception, match=message):
        fasta.read_blocks(spark, f"{tmp_path}/x.fa").sizes.collect()


def test_look_up_in_stored_blocks(spark, tmp_path):
    rng = random.Random(4)
    seqs = records(rng, (3000, 17, 1))
    write(tmp_path / "x.fa", seqs, 60)
    rows = []
    for _ in range(200):
        c = rng.choice(list(seqs))
        a = rng.randint(0, len(seqs[c]) + 2)
        rows.append((rng.randrange(50), c, a, a + rng.randint(0, min(200, len(seqs[c]))), "x"))
    iv = spark.createDataFrame(rows, "row_idx long, chrom string, start long, end long, _block string")
    want = sorted((r[0], *r[1:4], seqs[r[1]][r[2] : r[3]]) for r in rows)
    with splits_of(spark, "500b"):
        found = fasta.read_blocks(spark, f"{tmp_path}/x.fa", 64, 32)
        got = E.look_up(iv, found)
        assert sorted(tuple(r) for r in got.select("row_idx", "chrom", "start", "end", "letters").collect()) == want
        short = iv.filter("end - start <= 32")
        got = E.look_up(short, found, longest=32).select("row_idx", "chrom", "start", "end", "letters").collect()
        assert sorted(map(tuple, got)) == [w for w in want if w[3] - w[2] <= 32]
        with pytest.raises(Exception, match="longer than 32"):
            E.look_up(iv, found, longest=32).collect()
    with pytest.raises(ValueError, match="margin"):
        E.look_up(iv, found, longest=33)


def test_line_numbers_and_carried_values(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    text = {}
    for name in ("a", "b"):
        text[name] = [f"# {name}{rng.randrange(99)}" if rng.random() < 0.02 else f"chr1\t{i}\t{i + 1}" for i in range(3000)]
        (tmp_path / f"{name}.bed").write_text("\n".join(text[name]) + "\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.tsv").write_text("p\nq\n")
    with splits_of(spark, "2k"):
        rows = X.lines(spark, [f"{tmp_path}/a.bed", f"{tmp_path}/b.bed"])
        got = sorted(map(tuple, rows.collect()))
        assert got == sorted((n, i, v) for n, ls in text.items() for i, v in enumerate(ls))
        assert sorted(r["line_no"] for r in X.lines(spark, [f"{tmp_path}/a.bed", f"{tmp_path}/sub/a.tsv"]).filter("value IN ('p', 'q')").collect()) == [0, 1]
        monkeypatch.setattr(X, "PIECE", 5)
        hits = sorted((r["set_id"], r["start"], r["query"]) for r in scores.parse_legacy_hits(rows).collect())
        numbers = X.numbered(rows.filter(~F.col("value").startswith("#")))
        numbers = sorted((r["set_id"], r["row_idx"], r["value"]) for r in numbers.collect())
    want, plain = [], []
    for n, ls in text.items():
        head, k = None, 0
        for i, v in enumerate(ls):
            if v.startswith("#"):
                head = v[2:]
            else:
                want.append((n, i, head))
                plain.append((n, k, v))
                k += 1
    assert hits == sorted(want, key=lambda w: (w[0], w[1])) and numbers == sorted(plain)
    one = spark.createDataFrame([(None, 3, "x"), (None, 70_000, "y"), ("s", 1, "z")], "set_id string, line_no long, value string")
    assert sorted((r["value"], r["row_idx"]) for r in X.numbered(one).collect()) == [("x", 0), ("y", 1), ("z", 0)]


def test_no_stage_has_a_whole_set(spark):
    rows = spark.range(400_000).select(F.lit("s").alias("set_id"), F.col("id").alias("line_no"), F.lit("v").alias("value"))
    was = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        per_task = X.numbered(rows).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was[0])
        spark.conf.set("spark.sql.shuffle.partitions", was[1])
    assert per_task <= 3 * 65_536
