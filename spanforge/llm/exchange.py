"""Round trips between units of documents and shards of hashes.

A unit is a slice of a task's rows. Units send sorted arrays of hashes to the shards that own them; a shard works on what all
units sent it and answers each; the answers meet the unit's documents again. What crosses the shuffle are a few binary rows
a unit and shard, never a row a word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import mix64, sliced, text_bytes

SCHEMA = "to int, kind int, unit long, tag long, body binary"
#: Kinds sort by number; a unit's documents come after every answer to it.
DOCUMENTS = 1000
#: Most text of a unit, about. The larger the units, the fewer hashes are sent twice and the fewer bits tell sorted ones apart.
UNIT_BYTES = 12 << 20


def rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["to", "kind", "unit", "tag", "body"])


def _evenly(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about the same size, so that none is a small rest."""
    size = len(text_bytes(batch.column("text"))[0])
    return sliced(iter([batch]), limit=math.ceil(size / max(1, math.ceil(size / UNIT_BYTES)) * 1.05))


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(unit, tag, slice): the unit's number comes from the task and the slice, so that each scan of a stored table finds the
    same units; the tag is a hash of what is in it, by which a scan that does not is noticed."""
    task = TaskContext.get().partitionId()
    for k, batch in enumerate(piece for b in batches for piece in _evenly(b)):
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.uint64)
        ids = pc.fill_null(batch.column("doc_id"), -1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        tag = mix64(mix64(ids) + size * np.uint64(3) + np.arange(len(ids), dtype=np.uint64)).sum(dtype=np.uint64)
        yield task << 32 | k, int(tag.astype(np.int64)), batch


def home(unit: int, parts: int) -> int:
    return int(mix64(np.array([unit], np.uint64))[0] % np.uint64(parts))


def owner(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each shard's share of sorted hashes."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _documents(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, tag, batch in units(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield rows([(home(unit, parts), DOCUMENTS, unit, tag, sink.getvalue().to_pybytes())])

    return run


def ask(docs: DataFrame, send: Callable, answer: Callable, parts: int) -> DataFrame:
    """Answers to what `send` (unit, tag, batch → rows) says, worked out by `answer` (all rows of a shard → rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, tag, batch in units(batches):
            yield rows(list(send(unit, tag, batch)))

    return answered(docs.mapInArrow(run, SCHEMA), answer, parts)


def answered(messages: DataFrame, answer: Callable, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in answer(batches):
            yield rows(found)

    return messages.repartitionById(parts, "to").mapInArrow(run, SCHEMA)


def meet(docs: DataFrame, answers: DataFrame, work: Callable, schema: str, parts: int) -> DataFrame:
    """`work` (unit, tag, batch, its answers as (kind, body) → record batches) on each unit, next to the answers to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[int, bytes]] = []
        at, tags = None, set()
        for batch in batches:
            for i in range(batch.num_rows):
                kind, unit, tag = (batch.column(c)[i].as_py() for c in ("kind", "unit", "tag"))
                if unit != at:
                    at, tags, got = unit, set(), []
                tags.add(tag)
                if kind != DOCUMENTS:
                    got.append((kind, batch.column("body")[i].as_py()))
                    continue
                if len(tags) > 1:
                    raise RuntimeError("the documents were not read in the same order twice; give a stored table")
                with pa.ipc.open_stream(batch.column("body")[i].as_buffer()) as stream:
                    for piece in stream:
                        yield from work(unit, tag, piece, got)

    both = docs.mapInArrow(_documents(parts), SCHEMA).unionByName(answers)
    return both.repartitionById(parts, "to").sortWithinPartitions("unit", "kind").mapInArrow(run, schema)


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of an array by byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.zeros(0, np.uint8)
    return len(values).to_bytes(8, "little") + (_ZSTD.compress(planes.tobytes(), asbytes=True) if len(values) else b"")


def expand(body: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(body[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_ZSTD.decompress(body[8:], decompressed_size=n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """A sorted uint64 array by its differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def expand_sorted(body: bytes) -> np.ndarray:
    return np.cumsum(expand(body, np.uint64), dtype=np.uint64)


def join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return out
