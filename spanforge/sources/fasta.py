"""Sequence files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import AS_TOKEN, letter_numbers
from .blocks import BLOCK, MARGIN, SequenceBlocks
from .text import segmented, split_lines, with_starts


def parse(records: DataFrame) -> DataFrame:
    """(chrom, seq) of records (value) that start at a >: the name is the first word of the first line, the rest is joined."""
    text = F.regexp_replace("value", "^>", "")
    name = F.get(F.split(F.substring_index(text, "\n", 1), r"\s"), F.lit(0))
    seq = F.regexp_replace(F.when(text.contains("\n"), F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)")).otherwise(F.lit("")), r"\s", "")
    return records.filter(F.trim(text) != "").select(name.alias("chrom"), seq.alias("seq"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA file, a record a row: files are split at the records. Long records are better read in blocks."""
    return parse(spark.read.option("lineSep", "\n>").text(path))


class _Runs:
    """The lines of a batch as runs: the lines of one record in one segment. Letters of a run are one slice of bytes."""

    def __init__(self, batch: pa.RecordBatch):
        value = batch.column("value")
        header = pc.starts_with(value, ">")
        self.header = header.to_numpy(zero_copy_only=False).astype(bool)
        letters = pc.cast(pc.replace_substring_regex(pc.if_else(header, "", value), r"\s+", ""), pa.large_binary())
        if pc.any(pc.match_substring_regex(letters, rb"[^\x00-\x7F]")).as_py():
            raise ValueError("a sequence has letters beyond ASCII")
        _, offsets, data = letters.buffers()
        self.at = np.frombuffer(offsets, np.int64)[letters.offset : letters.offset + len(letters) + 1]
        self.data = memoryview(data) if data is not None else memoryview(b"")
        file, segment = batch.column("file"), batch.column("segment").to_numpy()
        new = np.ones(len(value), bool)
        new[1:] = (segment[1:] != segment[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        self.new = new
        self.first = np.flatnonzero(new | self.header)
        self.last = np.append(self.first[1:], len(value))
        self.file, self.segment, self.value = file, segment, value

    def __iter__(self) -> Iterator[tuple[int, str | None, bool, bytes]]:
        """(first line, the name that a header gives, whether a segment begins, letters)."""
        for lo, hi in zip(self.first.tolist(), self.last.tolist(), strict=True):
            name = (self.value[lo].as_py()[1:].split() or [""])[0] if self.header[lo] else None
            yield lo, name, bool(self.new[lo]), self.data[self.at[lo] : self.at[hi]]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, segment, k, chrom, letters): how many letters each record has in a segment; k = 0 is the rest of an earlier one."""
    key, k = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        found = []
        runs = _Runs(batch)
        for lo, name, begins, letters in runs:
            now = (runs.file[lo].as_py(), int(runs.segment[lo]))
            if begins and now != key:
                key, k = now, 0
                found.append((*key, 0, None, 0))
            if name is not None:
                k += 1
            found.append((*key, k, name, len(letters)))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["file", "segment", "k", "chrom", "letters"])


def _cut(block: int, margin: int):
    """Pieces of blocks (chrom, block, at, letters) of lines that know what record their segment starts in, and where."""

    def pieces(name: str, offset: int, letters: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(letters):
            b, place = divmod(offset + at, block)
            n = min(block - place, len(letters) - at)
            yield name, b, place, letters[at : at + n]
            if b and place < margin:
                yield name, b - 1, block + place, letters[at : at + min(n, margin - place)]
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, offset = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found, runs = [], _Runs(batch)
            for lo, own, begins, letters in runs:
                now = (runs.file[lo].as_py(), int(runs.segment[lo]))
                if begins and now != key:
                    key, name, offset = now, batch.column("entering")[lo].as_py(), batch.column("offset")[lo].as_py()
                if own is not None:
                    name, offset = own, 0
                found += [(n, b, at, bytes(x).decode("ascii")) for n, b, at, x in pieces(name, offset, letters)]
                offset += len(letters)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["chrom", "block", "at", "letters"])

    return run


def cut_lines(lines: DataFrame, block: int = BLOCK, margin: int = MARGIN) -> SequenceBlocks:
    """Blocks of the sequences in the lines of files: (file, segment, value), a segment's lines together and in order, or with line_no.

    A first scan counts letters by record and segment; running totals over the segments then tell each what record it starts
    in and at which letter; a second scan cuts. So a record of any length is read by as many tasks as it has segments. Letters before the first
    header, beyond ASCII, or a name given twice are errors. White space is left out; a name is the first word after >.
    """
    ordered = lines.repartition("file", "segment").sortWithinPartitions("file", "segment", "line_no") if "line_no" in lines.columns else lines
    counts = ordered.select("file", "segment", "value").mapInArrow(_records, "file string, segment long, k long, chrom string, letters long")
    counts = counts.groupBy("file", "segment", "k").agg(F.max("chrom").alias("chrom"), F.sum("letters").alias("letters"))
    ends = counts.groupBy("file", "segment").agg(F.max("k").alias("headers"), F.max_by("chrom", "k").alias("chrom"), F.max_by("letters", "k").alias("tail"))
    by_file = Window.partitionBy("file").orderBy("segment")
    ends = ends.withColumn("records", F.sum((F.col("headers") > 0).cast("long")).over(by_file))
    ends = ends.withColumn("length", F.sum("tail").over(Window.partitionBy("file", "records").orderBy("segment")))
    ends = ends.withColumn("name", F.last(F.when(F.col("headers") > 0, F.col("chrom")), True).over(by_file))
    starts = ends.select("file", "segment", F.lag("name").over(by_file).alias("entering"), F.coalesce(F.lag("length").over(by_file), F.lit(0)).alias("offset"))
    named = counts.join(starts, ["file", "segment"]).withColumn("chrom", F.when(F.col("k") > 0, F.col("chrom")).otherwise(F.col("entering")))
    sizes = named.filter("chrom IS NOT NULL OR letters > 0").groupBy("chrom").agg(F.sum("letters").alias("size"), F.count_if(F.col("k") > 0).alias("times"))
    bad = F.when(F.col("chrom").isNull(), F.raise_error(F.lit("letters before the first header"))).when(F.col("times") > 1, F.raise_error(F.concat(F.lit("a name given twice: "), F.col("chrom"))))
    sizes = sizes.select("chrom", F.coalesce(bad.cast("long"), F.col("size")).alias("size"))
    parts = with_starts(lines, starts).select("file", "segment", "value", "entering", "offset").mapInArrow(_cut(block, margin), "chrom string, block long, at long, letters string")
    whole = parts.groupBy("chrom", "block").agg(F.array_sort(F.collect_list(F.struct("at", "letters"))).alias("parts"))
    letters = whole.select("chrom", "block", F.array_join(F.transform("parts", lambda x: x["letters"]), "").alias("letters"))
    return SequenceBlocks(letters, sizes, block, margin)


def read_blocks(spark: SparkSession, path: str | list[str], block: int = BLOCK, margin: int = MARGIN) -> SequenceBlocks:
    """The sequences of FASTA files in blocks. Files may be split anywhere; store the result to read it more than once."""
    return cut_lines(split_lines(spark, path), block, margin)


def parse_blocks(rows: DataFrame, block: int = BLOCK, margin: int = MARGIN) -> SequenceBlocks:
    """As read_blocks, of lines (set_id, line_no, value) of a table."""
    return cut_lines(segmented(rows), block, margin)


def shape(sequences: DataFrame) -> DataFrame:
    return sequences.select("chrom", F.length("seq").cast("long").alias("length"))


def tokens(sequences: DataFrame, order: str) -> DataFrame:
    """(chrom, idx, offset, size, tokens): places in the concatenation of all sequences, and each one's tokens."""
    sized = sequences.withColumn("size", F.length("seq").cast("long"))
    w = Window.orderBy(order)
    places = sized.select("chrom", "size", (F.row_number().over(w) - 1).alias("idx"), (F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("offset"))
    return places.join(sequences.select("chrom", letter_numbers(F.col("seq"), AS_TOKEN).alias("tokens")), "chrom")
