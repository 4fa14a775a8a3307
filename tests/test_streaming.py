from spanforge.operators.joins import overlap_count_by_set
from spanforge.streaming import beds


def test_hits_of_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, spans in (("a", [(0, 10), (5, 20)]), ("b", [(100, 200)])):
        (tmp_path / "in" / f"{name}.bed").write_text("# x\n" + "".join(f"chr1\t{s}\t{e}\n" for s, e in spans))
    query = spark.createDataFrame([(1, "chr1", 8, 9), (2, "chr1", 150, 160)], "row_idx long, chrom string, start long, end long")
    beds.append_hits(beds.stream(spark, f"{tmp_path}/in", 1), query, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("row_idx", "set_id", "hits")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2), (2, "b", 1)]
    assert overlap_count_by_set(query, query.withColumnRenamed("row_idx", "k").selectExpr("'s' AS set_id", "chrom", "start", "end")).count() == 2
