"""Numbered vectors in sorted shards, with a commit: a Spark data source.

Each writing task sorts nothing and sends nothing through the driver: its rows are in order, and it writes them as one file under a name of
its own. When all tasks have succeeded, the commit writes a manifest that lists one file a task with its first and last number.
Only what the manifest lists is ever read, so what a failed or repeated task has left is not. The reader cuts the numbers
into ranges, and merges in each range the rows of all files that reach into it: rows come in the order of their numbers, from
partition to partition, without a sort of the whole.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME, MANIFEST = "shards", "_manifest.json"
#: Rows of a row group, and of a reading partition, about.
GROUP, RANGE = 8192, 65_536


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that all executors reach: file:, hdfs:, s3: and what else pyarrow knows."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int
    first: int | None
    last: int | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, order: str, overwrite: bool, group: int = GROUP):
        self.path, self.order, self.overwrite, self.group = path, order, overwrite, group

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _place(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.parquet"
        out, rows, first, last = None, 0, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                at = batch.column(self.order)
                lowest, highest = at[0].as_py(), at[-1].as_py()
                if at.null_count or not pc.all(pc.greater_equal(at[1:], at[:-1]), min_count=0).as_py() or last is not None and lowest < last:
                    raise ValueError(f"rows of a task must be in the order of {self.order}, without nulls")
                first, last, rows = lowest if first is None else first, highest, rows + batch.num_rows
                out = out or pq.ParquetWriter(posixpath.join(root, name), batch.schema, filesystem=files, compression="zstd")
                for i in range(0, batch.num_rows, self.group):
                    out.write_batch(batch.slice(i, self.group))
        finally:
            if out:
                out.close()
        return _Written(name, rows, first, last)

    def commit(self, messages: list) -> None:
        files, root = _place(self.path)
        listed = [vars(m) for m in messages if m and m.rows]
        if not self.overwrite and files.get_file_info(posixpath.join(root, MANIFEST)).type == fs.FileType.File:
            listed = _manifest(self.path)["files"] + listed
        files.create_dir(root, recursive=True)
        temporary = posixpath.join(root, f"_{uuid.uuid4().hex}")
        with files.open_output_stream(temporary) as out:
            out.write(json.dumps({"order": self.order, "files": listed}).encode())
        files.move(temporary, posixpath.join(root, MANIFEST))

    def abort(self, messages: list) -> None:
        files, root = _place(self.path)
        for m in messages:
            if m and m.rows:
                files.delete_file(posixpath.join(root, m.file))


def _manifest(path: str) -> dict:
    files, root = _place(path)
    with files.open_input_stream(posixpath.join(root, MANIFEST)) as read:
        return json.loads(read.read())


@dataclass
class _Range(InputPartition):
    low: int
    high: int  # exclusive
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int = RANGE):
        self.path, self.of, self.rows = path, _manifest(path), rows

    def partitions(self) -> list[_Range]:
        listed = self.of["files"]
        if not listed:
            return [_Range(0, 0, [])]
        low, high, rows = min(f["first"] for f in listed), max(f["last"] for f in listed) + 1, sum(f["rows"] for f in listed)
        parts = max(1, min(high - low, -(-rows // self.rows)))
        ends = [low + (high - low) * i // parts for i in range(parts + 1)]
        return [_Range(a, b, [f["file"] for f in listed if f["first"] < b and f["last"] >= a]) for a, b in zip(ends, ends[1:], strict=False)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, root = _place(self.path)
        order = self.of["order"]

        def groups(name: str) -> Iterator[pa.RecordBatch]:
            with pq.ParquetFile(posixpath.join(root, name), filesystem=files) as file:
                at = file.schema_arrow.get_field_index(order)
                for g in range(file.num_row_groups):
                    bounds = file.metadata.row_group(g).column(at).statistics
                    if bounds.max >= partition.low and bounds.min < partition.high:
                        rows = file.read_row_group(g)
                        keep = pc.and_(pc.greater_equal(rows[order], partition.low), pc.less(rows[order], partition.high))
                        yield from (b for b in rows.filter(keep).to_batches() if b.num_rows)

        yield from _merged([groups(f) for f in partition.files], order)


def _merged(sorted_runs: list[Iterator[pa.RecordBatch]], order: str) -> Iterator[pa.RecordBatch]:
    """Batches of sorted runs in one order. Of each run one batch is held; what is below the least of their last numbers can go."""
    held = [[next(run, None), run] for run in sorted_runs]
    held = [h for h in held if h[0] is not None]
    while held:
        limit = min(h[0].column(order)[-1].as_py() for h in held)
        ready = []
        for h in held:
            n = int(pc.sum(pc.less_equal(h[0].column(order), limit)).as_py())
            if n:
                ready.append(h[0].slice(0, n))
            h[0] = h[0].slice(n) if n < h[0].num_rows else next(h[1], None)
        held = [h for h in held if h[0] is not None]
        found = pa.Table.from_batches(ready)
        yield from found.take(pc.sort_indices(found, [(order, "ascending")])).combine_chunks().to_batches()


class ShardSource(DataSource):
    """Options: path; order, the column of numbers (row_idx); group, rows of a row group; range, rows of a reading partition, about."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        path = self.options["path"]
        files, root = _place(path)
        listed = _manifest(path)["files"]
        if not listed:
            raise ValueError("no rows were written; give a schema to read an empty store")
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(pq.read_schema(posixpath.join(root, listed[0]["file"]), filesystem=files))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("order", "row_idx"), overwrite, int(self.options.get("group", GROUP)))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


def write(df: DataFrame, path: str, shards: int, order: str = "row_idx", append: bool = False, group: int = GROUP) -> None:
    """Rows dealt by their number over `shards` files, each in order: row n is in shard n mod shards, as ranks that take turns leave them."""
    df.sparkSession.dataSource.register(ShardSource)
    dealt = df.repartition(shards, df[order] % shards).sortWithinPartitions(order)
    dealt.write.format(NAME).options(order=order, group=group).mode("append" if append else "overwrite").save(path)


def read(spark: SparkSession, path: str, rows: int = RANGE) -> DataFrame:
    """All committed rows: partitions follow each other in the order of the numbers, and so do the rows in each."""
    spark.dataSource.register(ShardSource)
    return spark.read.format(NAME).option("range", rows).load(path)


def delete(path: str) -> bool:
    """Whether there was anything to delete."""
    files, root = _place(path)
    there = files.get_file_info(root).type == fs.FileType.Directory
    if there:
        files.delete_dir(root)
    return there
