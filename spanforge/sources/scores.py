"""Score, rank and hit files, and embedding stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_name, strip_extensions
from .text import carried, require


def _bed_name(path) -> Column:
    """The last part of a path up to its last .bed; empty if there is none."""
    parts = F.split(F.substring_index(path, "/", -1), r"\.bed")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".bed")


def parse_seqpare(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(label, other, similarity): header left out, white-space fields 5 and 6; under 6 fields are passed over (strict: an error)."""
    f = F.split(F.trim("value"), "\t" if strict else r"\s+")
    rows = rows.filter("line_no > 0")
    rows = rows.filter(require(F.size(f) >= 6, "under 6 fields") if strict else F.size(f) >= 6)
    name = _bed_name(F.get(f, F.lit(5)))
    rows = rows.select(F.col("set_id").alias("label"), name.alias("other"), F.get(f, F.lit(4)).try_cast("double").alias("similarity"))
    return rows.filter(require(F.col("other") != "", "no .bed name"))


def parse_scores(rows: DataFrame, known: DataFrame, name_field: int = 0, score_field: int = 1, extensions: int = 1) -> DataFrame:
    """(set_id, id, score) for each known name (set_id, id); other names are passed over. A known name given twice, one that is missing, or a score that is no number is an error."""
    f = F.split("value", "\t")
    got = rows.filter("line_no > 0").select(strip_extensions(F.get(f, F.lit(name_field)), extensions).alias("set_id"), F.get(f, F.lit(score_field)).alias("text"))
    got = got.groupBy("set_id").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    out = known.join(got, "set_id", "left")
    ok = require(F.coalesce(F.col("n"), F.lit(0)) == 1, F.concat(F.lit("missing or given twice: "), F.col("set_id")))
    return out.filter(ok).select("set_id", "id", F.col("text").cast("double").alias("score"))


def parse_legacy_ranks(rows: DataFrame) -> DataFrame:
    """(base, other, score, rank) by the column named combo_score, larger first, ties in file order."""
    f = F.split("value", "\t")
    header = rows.filter("line_no = 0").select("set_id", F.array_position(f, "combo_score").cast("int").alias("at"))
    body = rows.filter((F.col("line_no") > 0) & ~F.col("value").startswith("#")).join(F.broadcast(header), "set_id")
    body = body.select(F.col("set_id").alias("base"), clean_name(F.substring_index(F.get(f, F.lit(0)), "/", -1)).alias("other"), F.get(f, F.col("at") - 1).try_cast("double").alias("score"), "line_no")
    w = Window.partitionBy("base").orderBy(F.col("score").desc(), "line_no")
    return body.select("base", "other", "score", F.row_number().over(w).alias("rank"))


def parse_legacy_hits(rows: DataFrame) -> DataFrame:
    """(set_id, query, chrom, start, end): a line that starts with # opens a query (its first two characters are dropped), the lines after it are its hits."""
    head = F.when(F.col("value").startswith("#"), F.expr("substring(value, 3)"))
    rows = carried(rows, head, "query").filter(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    return rows.select("set_id", "query", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"))


#: The header of a score file.
SCORE_COLUMNS = ("name", "cmodel_delta", "foundation_model_delta")


def write_scores(df: DataFrame, path: str) -> None:
    df.select(*SCORE_COLUMNS).write.csv(path, sep="\t", header=True)


def write_embeddings(df: DataFrame, path: str) -> None:
    """(set_id, row_idx, vec) by set, rows in order within a file; a large set is several files, each with a range of its rows."""
    rows = df.select("set_id", "row_idx", F.col("vec").cast("array<float>").alias("vec"))
    rows.repartitionByRange("set_id", "row_idx").sortWithinPartitions("set_id", "row_idx").write.partitionBy("set_id").parquet(path)


def read_embeddings(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("set_id").cast("string").alias("set_id"), "row_idx", F.col("vec").cast("array<double>").alias("vec"))
