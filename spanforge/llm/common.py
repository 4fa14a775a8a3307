"""Shared helpers: lineage cuts, bounded Arrow slices, and vectorised word splitting and hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based operator here, as a Java regex class body.
WS = r"\x20\x09-\x0D"
WORD_RE = rf"[^{WS}]+"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder that the session names. Without one, a folder of this machine
    will do if driver and executors are one process (local mode); elsewhere it is an error, as executors could not share it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should not hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices whose `column` holds about `limit` bytes at most (or one row), so that numpy temporaries stay bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    _give_back()


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the row offsets into them; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


_IS_WS = np.zeros(256, bool)
_IS_WS[[0x20, *range(0x09, 0x0E)]] = True
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow["p"]) < n:
        size = max(n, 1 << 19)
        for key, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words of a slice of texts: byte ranges, 64-bit hashes and, by row, the range of word numbers."""

    def __init__(self, arr: pa.Array, lower: bool = False, trim: bool = False):
        self.raw, offs = text_bytes(arr)
        n = len(self.raw)
        solid = ~_IS_WS[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~solid[:-1]
            before |= edge[:n]
            after[-1] = True
            after[:-1] = ~solid[1:]
            after |= edge[1:]
        self.starts = np.flatnonzero(solid & before)
        self.ends = np.flatnonzero(solid & after) + 1
        self.rows = np.searchsorted(self.starts, offs)  # len(arr) + 1 word offsets
        if trim:
            self._trim()
        self.hash = self._hash(_BYTE_LOWER if lower else _BYTE)

    def _trim(self) -> None:
        """Take outer ASCII punctuation off the words; a word of nothing else keeps its last character."""
        while len(at := np.flatnonzero((self.ends - self.starts > 1) & _IS_PUNCT[self.raw[self.starts]])):
            self.starts[at] += 1
        while len(at := np.flatnonzero((self.ends - self.starts > 1) & _IS_PUNCT[self.raw[self.ends - 1]])):
            self.ends[at] -= 1

    def _hash(self, values: np.ndarray, block: int = 1 << 19) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        w = 0
        while w < len(out):
            end = max(int(np.searchsorted(self.ends, self.starts[w] + block, side="right")), w + 1)
            lo, hi = int(self.starts[w]), int(self.ends[end - 1])
            p, inv = _powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[self.raw[lo:hi]] * p[: hi - lo], out=sums[1:])
            s, e = self.starts[w:end] - lo, self.ends[w:end] - lo
            out[w:end] = (sums[e] - sums[s]) * inv[s]
            w = end
        return mix64(out)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def text(self, w: int) -> bytes:
        return self.raw[self.starts[w] : self.ends[w]].tobytes()


def grams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words starting at each word number (as many as len(words) - n + 1)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += words[j : j + m] * _GRAM[(j + salt) % 64]
    return mix64(total + np.uint64(n + 97 * salt))
