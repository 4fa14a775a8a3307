"""Substring deduplication by recompression: equal passages get equal interior symbols, which show where to look."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from .common import Words, cut, grams, mix64, partitions

#: Rounds of naming runs and pairs.
ROUNDS = 2
_ANCHORS, _WINDOWS = 0, 1
_TOP = np.uint64(2**64 - 1)


def recompress(symbols: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, last word + 1 that decide it, words it stands for) of each symbol left after some rounds over each row's words.

    A round names maximal runs of one symbol, then pairs: a symbol's hash says whether it is a left or a right one, and each
    left symbol before a right one is named with it as a pair. Names are hashes of what they stand for, so that every task gives
    equal passages equal names. `first` and `last` span all the words that the symbol's borders hang on (its neighbours, as
    they could have joined it), so any passage that holds them holds the same symbol. At a row's end a border hangs on a
    word beyond the row: no passage inside has it.
    """
    n = len(symbols)
    first, last, stands = np.arange(n), np.arange(1, n + 1), np.ones(n, np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    for r in range(rounds):
        if not len(symbols):
            break
        # runs: a run's ends hang on the neighbours being other symbols
        new = np.ones(len(symbols), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(symbols)))
        lo, hi = first[at], last[at + size - 1]
        before, after = _neighbours(row[at])
        f = np.where(before, np.minimum(lo, np.concatenate(([0], first[at - 1][1:]))), rows[row[at]] - 1)
        e = np.where(after, np.maximum(hi, np.concatenate((last[(at + size)[:-1]], [0]))), rows[row[at] + 1] + 1)
        name = np.where(size > 1, mix64(symbols[at] + size.astype(np.uint64) * np.uint64(0xD6E8_FEB8_6659_FD93)), symbols[at])
        symbols, row, first, last, stands = name, row[at], f, e, np.add.reduceat(stands, at)
        # pairs
        left = (mix64(symbols + np.uint64((r + 1) * 0xA24B_AED4_963E_E407 % 2**64)) & np.uint64(1)).astype(bool)
        before, after = _neighbours(row)
        joins = np.zeros(len(symbols), bool)  # with the next
        joins[:-1] = left[:-1] & ~left[1:] & after[:-1]
        joined = np.zeros(len(symbols), bool)  # to the one before
        joined[1:] = joins[:-1]
        # a left symbol's own name hangs on its right neighbour, a right one's on its left neighbour
        f, e = first.copy(), last.copy()
        e[:-1] = np.where(left[:-1] & after[:-1], np.maximum(last[:-1], last[1:]), e[:-1])
        f[1:] = np.where(~left[1:] & before[1:], np.minimum(first[1:], first[:-1]), f[1:])
        e = np.where(left & ~after, rows[row + 1] + 1, e)
        f = np.where(~left & ~before, rows[row] - 1, f)
        keep = ~joined
        at = np.flatnonzero(keep)
        pair = joins[at]
        nxt = np.minimum(at + 1, len(symbols) - 1)
        name = np.where(pair, mix64(mix64(symbols[at] ^ np.uint64(0x8EBC_6AF0_9C88_C6E3)) + symbols[nxt]), symbols[at])
        f2 = np.where(pair, np.minimum(f[at], f[nxt]), f[at])
        e2 = np.where(pair, np.maximum(e[at], e[nxt]), e[at])
        symbols, row, first, last, stands = name, row[at], f2, e2, stands[at] + np.where(pair, stands[nxt], 0)
    return symbols, first, last, stands


def _neighbours(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each symbol has one before it and one after it in its row."""
    same = row[1:] == row[:-1]
    return np.concatenate(([False], same)), np.concatenate((same, [False]))


class _Unit:
    """Words of a unit, its windows, and the anchor of each window: of the symbols that the window decides alone, one that
    stands for the most words (it is shared least by chance), the least-named of those."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.words = w = Words(batch.column("text"))
        rows = w.rows
        n = len(w.hash)
        doc = batch.column("doc_id").to_pylist()
        none = [i for i, d in enumerate(doc) if d is None]
        self.doc = np.array([0 if d is None else d for d in doc], np.int64)
        inside = np.zeros(max(n - width + 1, 0), bool)
        row = w.row_of()
        if len(inside):
            inside = row[: len(inside)] == row[width - 1 :]
            if none:
                inside &= ~np.isin(row[: len(inside)], none)
        self.at = np.flatnonzero(inside)  # first words of windows
        self.row = row[self.at]
        both = grams(w.hash, width)[self.at]
        self.window = both
        names, first, last, stands = recompress(w.hash, rows)
        fits = (last - first <= width) & (last <= n) & (first >= 0)
        first, last = first[fits], last[fits]
        names = (15 - np.minimum(stands[fits], 15)).astype(np.uint64) << np.uint64(60) | names[fits] >> np.uint64(4)
        least = np.full(n + 1, _TOP)
        # windows that start at last − width … first hold the symbol
        for back in range(width):
            ok = first - back >= np.maximum(last - width, 0)
            if not ok.any():
                break
            np.minimum.at(least, first[ok] - back, names[ok])
        anchor = least[self.at]
        # a window without a symbol of its own (one long run, or borders everywhere) is its own anchor
        self.anchor = np.where(anchor == _TOP, mix64(both ^ np.uint64(0x6C62_272E_07BB_0142)), mix64(anchor))

    def candidates(self, repeated: np.ndarray) -> None:
        """Keep the windows whose anchor occurs in several documents."""
        if len(repeated) and len(self.anchor):
            at = np.minimum(np.searchsorted(repeated, self.anchor), len(repeated) - 1)
            keep = repeated[at] == self.anchor
        else:
            keep = np.zeros(len(self.anchor), bool)
        self.at, self.row, self.window = self.at[keep], self.row[keep], self.window[keep]


def _first_docs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest document of each, and whether it has several."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    if not len(keys):
        return keys, docs, np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    last = np.append(first[1:], len(keys)) - 1
    return keys[first], docs[first], docs[first] != docs[last]


def _send_anchors(width: int, parts: int):
    def send(unit: int, tag: int, batch: pa.RecordBatch) -> Iterator[tuple]:
        u = _Unit(batch, width)
        keys, _, several = _first_docs(u.anchor, u.doc[u.row])
        cuts = X.owner(keys, parts)
        for p in np.flatnonzero(np.diff(cuts)):
            mine = slice(cuts[p], cuts[p + 1])
            yield int(p), _ANCHORS, unit, tag, X.join([X.squeeze_sorted(keys[mine]), X.squeeze(several[mine].astype(np.uint8))])

    return send


def _asked(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int, list[bytes]]]:
    out = []
    for batch in batches:
        for unit, tag, body in zip(batch.column("unit").to_pylist(), batch.column("tag").to_pylist(), batch.column("body"), strict=True):
            out.append((unit, tag, X.parted(body.as_py())))
    return out


def _answer_anchors(parts: int):
    """To each unit, which of its anchors occur in several documents (in it or, as units share no document, with another)."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        asked = _asked(batches)
        if not asked:
            return
        keys = np.concatenate([X.expand_sorted(b[0]) for *_, b in asked])
        several = np.concatenate([X.expand(b[1], np.uint8) for *_, b in asked])
        order = np.argsort(keys)
        keys, several = keys[order], several[order].astype(bool)
        same = keys[1:] == keys[:-1]
        several[1:] |= same
        several[:-1] |= same
        repeated = np.unique(keys[several])
        del keys, several, order
        for unit, tag, body in asked:
            mine = X.expand_sorted(body[0])
            yield [(X.home(unit, parts), _ANCHORS, unit, tag, X.squeeze_sorted(mine[_in(mine, repeated)]))]

    return answer


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _repeated(got: list[tuple[int, bytes]]) -> np.ndarray:
    found = [X.expand_sorted(body) for kind, body in got if kind == _ANCHORS]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _send_windows(width: int, parts: int):
    """Distinct candidate windows of a unit with their smallest documents, and the unit's candidates to itself."""

    def work(unit: int, tag: int, batch: pa.RecordBatch, got: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        u = _Unit(batch, width)
        repeated = _repeated(got)
        u.candidates(repeated)
        keys, docs, _ = _first_docs(u.window, u.doc[u.row])
        cuts = X.owner(keys, parts)
        out = [(int(p), _WINDOWS, unit, tag, X.join([X.squeeze_sorted(keys[cuts[p] : cuts[p + 1]]), X.squeeze(docs[cuts[p] : cuts[p + 1]])])) for p in np.flatnonzero(np.diff(cuts))]
        yield X.rows(out)

    return work


def _answer_windows(parts: int):
    """To each unit, by shard, a bit for each of its windows in order: a smaller document than the unit's smallest has it."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        asked = _asked(batches)
        if not asked:
            return
        keys, docs, _ = _first_docs(np.concatenate([X.expand_sorted(b[0]) for *_, b in asked]), np.concatenate([X.expand(b[1], np.int64) for *_, b in asked]))
        for unit, tag, body in asked:
            mine, own = X.expand_sorted(body[0]), X.expand(body[1], np.int64)
            earlier = docs[np.searchsorted(keys, mine)] < own
            yield [(X.home(unit, parts), _WINDOWS, unit, tag, X.squeeze_sorted(mine[earlier]))]

    return answer


def _apply(width: int, with_text: bool):
    def work(unit: int, tag: int, batch: pa.RecordBatch, got: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        u = _Unit(batch, width)
        u.candidates(_repeated(got))
        found = [X.expand_sorted(body) for kind, body in got if kind == _WINDOWS]
        earlier = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        keys, docs, _ = _first_docs(u.window, u.doc[u.row])
        gone = _in(u.window, earlier)
        if len(keys):
            gone |= docs[np.searchsorted(keys, u.window)] < u.doc[u.row]
        n = len(u.words.hash)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, u.at[gone], 1)
        np.add.at(edge, u.at[gone] + width, -1)
        covered = np.cumsum(edge)[:n] > 0
        counts, removed, shas, texts = [], [], [], []
        raw, starts, ends = u.words.raw.tobytes(), u.words.starts.tolist(), u.words.ends.tolist()
        for lo, hi in zip(u.words.rows[:-1].tolist(), u.words.rows[1:].tolist(), strict=True):
            kept = np.flatnonzero(~covered[lo:hi]) + lo
            text = b" ".join([raw[starts[i] : ends[i]] for i in kept.tolist()])
            counts.append(hi - lo)
            removed.append(hi - lo - len(kept))
            shas.append(hashlib.sha256(text).hexdigest())
            if with_text:
                texts.append(text.decode())
        cols = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array(texts, pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return work


def remove_repeats(docs: DataFrame, width: int = 13, with_text: bool = True) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_removed, kept_sha256 and (with_text) kept_text.

    A word goes if a window of `width` words that covers it also starts in a document with a smaller doc_id; all windows are judged on the
    input. First every unit of documents tells the shards the anchors of its windows: symbols of the recompressed text
    that a window decides alone, so that equal windows have equal anchors. Windows whose anchor is in several documents are then compared whole,
    by 64-bit fingerprint, and each unit learns which of them an earlier document has. docs should be a stored table, for it is
    read three times. A unit sends a passage once however often it holds it.
    Null or empty text: no words. Null doc_id: its windows neither remove nor are removed. Rows with one doc_id are one document, which does not
    remove from itself. An empty table gives no rows; other columns are not read.
    """
    from pyspark.sql import functions as F

    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = cut(X.ask(rows, _send_anchors(width, parts), _answer_anchors(parts), parts))
    windows = X.meet(rows, anchors, _send_windows(width, parts), X.SCHEMA, parts)
    earlier = X.answered(windows, _answer_windows(parts), parts)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return X.meet(rows, anchors.unionByName(earlier), _apply(width, with_text), schema, parts)


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM p),
m AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (g) WHERE m.lo < g.doc_id),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
             array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ws[i]), ' ') AS kept
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
