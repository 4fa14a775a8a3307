"""Models in stages, transforms of one's own, and the shard source."""

import json
import random

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from spanforge.operators import embed as E
from spanforge.operators import stages as G
from spanforge.operators import transforms as T
from spanforge.sources import bed, fasta, shards

from .test_sources import GOLDEN, ROWS, SEQ


class Counts:
    wants, embed_dim, max_seq_len = "sequence", 4, 10

    def collate(self, items):
        assert items and None not in items
        return [s.encode() for s in items]

    def __call__(self, batch):
        return [[float(s.count(x)) for x in (b"A", b"C", b"G", b"T")] for s in batch]


class Lengths:
    wants, embed_dim, max_seq_len = "interval", 1, None

    def collate(self, items):
        return items

    def __call__(self, batch):
        return [[e - s] for _, s, e in batch]


def tables(spark):
    iv = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "row_idx long, chrom string, start long, end long").coalesce(1)
    return iv, spark.createDataFrame(list(SEQ.items()), "chrom string, seq string")


@pytest.mark.parametrize("batch", [1, 2, 3, 64])
def test_golden_vectors_through_all_stages(spark, tmp_path, batch):
    iv, seq = tables(spark)

    def consume(part, found):
        with open(f"{tmp_path}/{part}", "a") as out:
            out.writelines(json.dumps(v) + "\n" for v in found)

    out = E.embed_with(iv, seq, Counts(), batch=batch, consume=consume).collect()
    assert [r["vec"] for r in sorted(out, key=lambda r: r["row_idx"])] == GOLDEN
    told = [json.loads(line) for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert sorted(told) == sorted(GOLDEN)
    assert [r["vec"] for r in E.embed_with(iv, None, Lengths(), batch=batch).orderBy("row_idx").collect()] == [[float(e - s)] for _, s, e in ROWS]


def test_batches_go_over_the_borders_of_rows(spark):
    sizes = spark.sparkContext.accumulator(0)

    def forward(batch):
        sizes.add(1)
        return [[float(len(x))] for x in batch]

    rows = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(40)], "k int, s string").coalesce(1)
    hooks = G.Hooks(forward, lambda r: list(r["s"]), postprocess=lambda v: [float(len(v))])
    got = {r["k"]: r["vec"] for r in G.staged(rows, ["k"], hooks, 16, 1).collect()}
    assert got == {i: [float(i % 5)] for i in range(40)} and sizes.value == 5  # 80 letters in batches of 16


def test_nulls_pass_the_model_by(spark):
    rows = spark.createDataFrame([(0, "ab"), (1, None), (2, ""), (3, None), (4, "c")], "k int, s string").coalesce(1)

    def forward(batch):
        assert batch and None not in batch
        return [[float(len(x))] for x in batch]

    got = {r["k"]: r["vec"] for r in G.staged(rows, ["k"], G.Hooks(forward, lambda r: [r["s"]]), 2).collect()}
    assert got == {0: [2.0], 1: None, 2: [0.0], 3: None, 4: [1.0]}
    got = {r["k"]: r["vec"] for r in G.staged(rows, ["k"], G.Hooks(forward, lambda r: [r["s"], None], postprocess=G.mean_of_present), 2).collect()}
    assert got == {0: [2.0], 1: None, 2: [0.0], 3: None, 4: [1.0]}
    assert G.staged(rows.filter("s IS NULL"), ["k"], G.Hooks(forward, lambda r: [r["s"]]), 2).filter("vec IS NULL").count() == 2


@pytest.mark.parametrize(("hooks", "message"), [
    (G.Hooks(lambda b: [[1.0]] * len(b), lambda r: ["a", "b"]), "2 items; a postprocess hook"),
    (G.Hooks(lambda b: [[1.0]] * len(b), lambda r: []), "0 items; a postprocess hook"),
    (G.Hooks(lambda b: [[1.0]] * (len(b) + 1)), "vectors for"),
    (G.Hooks(lambda b: [[1.0, 2.0]] * len(b)), "a vector of 2, not 1"),
])
def test_stages_that_do_not_fit_are_errors(spark, hooks, message):
    with pytest.raises(Exception, match=message):
        G.staged(spark.range(3), ["id"], hooks, 2, 1).collect()


class Multiply:
    def __init__(self, count):
        self.count = count

    def __call__(self, interval):
        for _ in range(self.count):
            yield interval


def test_transforms_of_ones_own(spark):
    iv, _ = tables(spark)
    for count in (1, 3):
        new = T.apply(iv, T.UserTransform(Multiply(count)), numbered=True).orderBy("new_idx").collect()
        assert [(r["chrom"], r["start"], r["end"]) for r in new] == [r for r in ROWS for _ in range(count)]
        assert [r["base_idx"] for r in new] == [i for i in range(len(ROWS)) for _ in range(count)]
    moved = T.UserTransform(lambda iv: [(iv[0] + "x", iv[1] + k, iv[2]) for k in range(iv[2] - iv[1]) if k < 2])
    new = T.apply(iv, T.split(2), moved, T.translate(1)).collect()
    want = []
    for i, (c, s, e) in enumerate(ROWS):
        half = (e - s) - (e - s) // 2
        parts = [(s, e)] if e - s < 2 else [(s, s + half), (s + half, e)]
        want += [(i, c + "x", a + k + 1, b + 1) for a, b in parts for k in range(min(2, b - a))]
    assert sorted((r["base_idx"], r["chrom"], r["start"], r["end"]) for r in new) == sorted(want)
    base = spark.createDataFrame([(0, "", 0, 0), (1, "", 1, 1), (2, "", 2, 2)], "row_idx long, chrom string, start long, end long")
    new = T.apply(base, T.UserTransform(Multiply(3)), numbered=True)
    values = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 0, 1, 1, 1, 10, 10, 10])], "new_idx long, value int")
    assert {r["row_idx"]: r["value"] for r in T.backward(base, new, values, F.sum).collect()} == {0: 0, 1: 3, 2: 30}


def numbers(n, seed=0):
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return [(i, [float(i), -1.0]) for i in order]


def test_shards_come_back_in_order(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame(numbers(2000), "row_idx long, vec array<double>")
    shards.write(df, path, 7, group=64)
    got = shards.read(spark, path, 300)
    assert got.rdd.getNumPartitions() > 3
    parts = got.withColumn("part", F.spark_partition_id()).collect()
    assert [r["row_idx"] for r in parts] == list(range(2000)) and [r["part"] for r in parts] == sorted(r["part"] for r in parts)
    assert all(r["vec"] == [r["row_idx"], -1.0] for r in parts)
    shards.write(df.filter("row_idx < 10"), path, 2, append=True)
    assert [r["row_idx"] for r in shards.read(spark, path).collect()] == sorted([*range(2000), *range(10)])
    shards.write(df.filter("row_idx < 10"), path, 2)
    assert [r["row_idx"] for r in shards.read(spark, path).collect()] == list(range(10))
    assert shards.delete(path) and not shards.delete(path)


def test_rows_of_tasks_that_failed_are_not_read(tmp_path):
    """A task's first attempt leaves a file without a message; the second one's is committed."""
    path = str(tmp_path / "store")
    batch = lambda *ids: pa.RecordBatch.from_pydict({"row_idx": pa.array(ids, pa.int64())})
    writer = shards._Writer(path, "row_idx", True)
    lost = writer.write(iter([batch(0, 2, 4)]))
    again, other, empty = writer.write(iter([batch(0, 2), batch(4)])), writer.write(iter([batch(1, 3)])), writer.write(iter([]))
    with pytest.raises(FileNotFoundError):
        shards._Reader(path)
    writer.commit([again, other, empty, None])
    reader = shards._Reader(path)
    read = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("row_idx").to_pylist()]
    assert read == [0, 1, 2, 3, 4] and lost.file not in {f["file"] for f in reader.of["files"]}
    assert len(list((tmp_path / "store").glob("part-*"))) == 3
    with pytest.raises(ValueError, match="in the order"):
        writer.write(iter([batch(3, 1)]))
    with pytest.raises(ValueError, match="in the order"):
        writer.write(iter([batch(3), batch(2)]))
    writer.abort([other])
    assert len(list((tmp_path / "store").glob("part-*"))) >= 2


def test_a_task_that_is_run_again_leaves_no_rows_twice(spark, tmp_path):
    """One task dies after its rows are written, as an executor might; Spark runs the job's tasks again in a session that allows it."""
    path = str(tmp_path / "store")
    shards.write(spark.createDataFrame(numbers(100), "row_idx long, vec array<double>"), path, 3)

    def broken(batches):
        for b in batches:
            yield b
        if TaskContext.get().partitionId() == 1:
            raise RuntimeError("lost")

    df = spark.createDataFrame(numbers(50), "row_idx long, vec array<double>").repartition(3).sortWithinPartitions("row_idx")
    with pytest.raises(Exception, match="lost"):
        df.mapInArrow(broken, df.schema).write.format(shards.NAME).mode("append").save(path)
    assert [r["row_idx"] for r in shards.read(spark, path).collect()] == list(range(100))


def test_names_without_their_extension(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t1\t2\n")
    for name in ("a", "a.bed", "a.bed.gz"):
        assert [tuple(r) for r in bed.read(spark, f"{tmp_path}/{name}").collect()] == [("a", 0, "chr1", 1, 2)]
    with pytest.raises(FileNotFoundError):
        bed.read(spark, f"{tmp_path}/b")


def test_stored_blocks_and_stages(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">{k}\n{v}\n" for k, v in SEQ.items()))
    iv, _ = tables(spark)
    stored = fasta.read_blocks(spark, f"{tmp_path}/x.fa", 16, 8).store(f"{tmp_path}/stored")
    assert [r["vec"] for r in E.embed_with(iv, stored, Counts()).orderBy("row_idx").collect()] == GOLDEN
    assert [r["vec"] for r in E.embed(iv, stored, E.CountAcgt(10)).orderBy("row_idx").collect()] == GOLDEN
