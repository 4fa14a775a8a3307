"""Folders of examples: one text file each, the folder above it names its label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import digest
from ..functions.sequences import AS_TOKEN, letter_numbers, reverse_complement


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of all files below path, whole. Spark's scan passes over empty files, so those come from the folder's listing, which the
    driver reads as it does for any scan; names that start with _ or . are no examples."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select("path", F.decode("content", "UTF-8").alias("value"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, empty = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listed.hasNext():
        one = listed.next()
        if one.getLen() == 0 and not one.getPath().getName().startswith(("_", ".")):
            empty.append((one.getPath().toString(), ""))
    return found.unionByName(spark.createDataFrame(empty, "path string, value string")) if empty else found


def parse(files: DataFrame, max_length: int, augment: bool = False, seed: int = 42) -> DataFrame:
    """(path, label, label_idx, seq, tokens): labels are numbered by name; with augment about half of the files, drawn by hash of
    their path, are reverse-complemented; then max_length letters are kept. tokens numbers the letters, null for others, and ends
    with one more number, the end token."""
    rows = files.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), F.regexp_replace("value", r"\s+$", "").alias("seq"))
    if augment:
        turned = F.substring(digest(F.col("path"), seed), 1, 1) < "8"
        rows = rows.withColumn("seq", F.when(turned, reverse_complement(F.col("seq"), keep_case=True)).otherwise(F.col("seq")))
    labels = rows.select("label").distinct().withColumn("label_idx", F.row_number().over(Window.orderBy("label")) - 1)  # a row a label
    rows = rows.withColumn("seq", F.substring("seq", 1, max_length)).join(labels, "label")
    tokens = F.concat(letter_numbers(F.upper("seq"), AS_TOKEN), F.array(F.lit(len(AS_TOKEN))))
    return rows.select("path", "label", "label_idx", "seq", tokens.alias("tokens"))
