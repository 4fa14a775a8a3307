"""A model in Python, run in stages on the rows of a partition.

Each row is taken apart into items, items of many rows make up a batch, the model runs on the batch, and what it gives is put together again by
row. Batches go over the borders of rows, so a model sees full ones whatever the rows hold; a task keeps a batch and the rows that wait
for it, no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


class Model(Protocol):
    """What a model in Python has to offer. wants is sequence or interval; max_seq_len is None if any length will do."""

    wants: str
    embed_dim: int
    max_seq_len: int | None

    def collate(self, items: list) -> Any:
        """A batch of items, in the form that the model takes."""

    def __call__(self, batch: Any) -> Any:
        """What `decollate` can take apart into a vector an item, in order."""


def only_one(items: Sequence) -> Any:
    """The default end of a row: what was never taken apart need not be put together."""
    if len(items) != 1:
        raise ValueError(f"a row has {len(items)} items; a postprocess hook must say what they make")
    return items[0]


def mean_of_present(items: Sequence) -> list[float] | None:
    """The mean of the vectors that are there; null if none is."""
    found = [v for v in items if v is not None]
    return [sum(x) / len(found) for x in zip(*found, strict=True)] if found else None


@dataclass(frozen=True)
class Hooks:
    """The stages. preprocess: a row (a dict) -> its items; collate: items -> a batch; forward: the model; decollate: its output -> a vector an item;
    postprocess: the vectors of a row -> its vector; consume, if given, gets (partition, vectors of some rows) before they are sent on. A
    task that is run again consumes again, so a consumer must replace what its partition has left before."""

    forward: Callable[[Any], Any]
    preprocess: Callable[[dict], Iterable] = lambda row: [row]
    collate: Callable[[list], Any] = list
    decollate: Callable[[Any], Iterable] = iter
    postprocess: Callable[[list], Any] = only_one
    consume: Callable[[int, list], None] | None = None


class _Run:
    """Rows in their order, with the items that the model still owes them."""

    def __init__(self, hooks: Hooks, batch: int, width: int | None):
        self.hooks, self.size, self.width = hooks, batch, width
        self.rows: list[list] = []  # keys, vectors so far, and how many are to come; None marks a null item
        self.items: list[tuple[list, int, Any]] = []

    def add(self, keys: tuple, row: dict) -> None:
        items = list(self.hooks.preprocess(row))
        state = [keys, [None] * len(items), sum(i is not None for i in items)]
        self.rows.append(state)
        self.items += [(state, k, item) for k, item in enumerate(items) if item is not None]

    def step(self, last: bool = False) -> Iterator[list]:
        """Rows that are complete, as (keys, vector)."""
        while len(self.items) >= self.size or last and self.items:
            some, self.items = self.items[: self.size], self.items[self.size :]
            out = list(self.hooks.decollate(self.hooks.forward(self.hooks.collate([item for _, _, item in some]))))
            if len(out) != len(some):
                raise ValueError(f"the model gave {len(out)} vectors for {len(some)} items")
            for (state, k, _), vec in zip(some, out, strict=True):
                vec = [float(x) for x in vec]
                if self.width is not None and len(vec) != self.width:
                    raise ValueError(f"the model gave a vector of {len(vec)}, not {self.width}")
                state[1][k] = vec
                state[2] -= 1
        done = next((n for n, state in enumerate(self.rows) if state[2]), len(self.rows))
        found, self.rows = self.rows[:done], self.rows[done:]
        if found:
            yield [(keys, self.hooks.postprocess(items)) for keys, items, _ in found]


def staged(rows: DataFrame, keys: list[str], hooks: Hooks, batch: int = 64, width: int | None = None) -> DataFrame:
    """(keys…, vec) of rows, through the hooks. An item that is None passes the model by and stays None; a batch holds items only
    and is never empty. Errors: several items (or none) in a row without a postprocess hook, another number of vectors than items, a vector of
    another length than `width`."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Run(hooks, batch, width)
        part = TaskContext.get().partitionId()

        def told(found: list, schema: pa.Schema) -> pa.RecordBatch:
            if hooks.consume:
                hooks.consume(part, [vec for _, vec in found])
            columns = [pa.array([k[i] for k, _ in found], schema.field(c).type) for i, c in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v for _, v in found], pa.list_(pa.float64()))], names=[*keys, "vec"])

        schema = None
        for some in batches:
            schema = some.schema
            for row in some.to_pylist():
                state.add(tuple(row[k] for k in keys), row)
                if len(state.items) >= batch:
                    for found in state.step():
                        yield told(found, schema)
        for found in state.step(last=True):
            yield told(found, schema)

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", vec array<double>")


def hooks_of(model: Model, postprocess: Callable[[list], Any] = mean_of_present, consume: Callable[[int, list], None] | None = None) -> Hooks:
    """The stages of a model: letters (or an interval) are cut into chunks of its length, and its vectors of a row are averaged. A row
    without letters has one null item."""
    size = model.max_seq_len

    def chunks(row: dict) -> Iterator:
        if model.wants == "interval":
            yield None if row["start"] is None or row["end"] is None else (row["chrom"], row["start"], row["end"])
        elif not (letters := row["letters"]) or size is None:
            yield letters
        else:
            yield from (letters[i : i + size] for i in range(0, len(letters), size))

    return Hooks(model, chunks, model.collate, iter, postprocess, consume)
