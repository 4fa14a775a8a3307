"""Exact deduplication with Patricia tries that own the smallest representative of each text."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, partitions, unused

_SCHEMA = "n_bytes long, sha string, body binary, n_points long, doc_id long, copies long"
_NO_ID = (1 << 63) - 1


def _better(a: tuple, b: tuple) -> tuple:
    """Owner of two (−code points, doc_id, copies): more code points, then the smaller id (null last); copies add up."""
    best = a if a[:2] <= b[:2] else b
    return (best[0], best[1], a[2] + b[2])


class Trie:
    """Compressed radix trie over (length, byte string); a terminal node stores (−code points, smallest doc_id, copies, extra).

    When the bytes held exceed `budget`, the path from the root that holds most of them is followed to where it branches, and the
    subtrees there go to FILES files in turn, however many they are. A stub is left in each one's place, so that later strings
    of that subtree are appended to its file. Once the rest has been read, each file is worked through by a trie of its own.
    Equal strings meet in one file, and no file holds all strings of a trie. `budget` None: nothing is spilled.
    """

    FILES = 16

    def __init__(self, budget: int | None = 64 << 20):
        self.root: list = [b"", {}, None]  # label, children by first byte, value; a stub has no children and a file's number
        self.budget, self.limit, self.held, self.strings, self.turn = budget, budget, 0, 0, 0
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files: dict[int, object] = {}

    def insert(self, body: bytes, value: tuple, extra=None) -> None:
        key = len(body).to_bytes(8, "big") + body
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                self.held += len(key) - at + 200
                node = child
                break
            if child[1] is None:
                pickle.dump((body, value, extra), self.files[child[2]])
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            common = len(os.path.commonprefix((label, key[at : at + len(label)])))
            middle = [label[:common], {label[common]: child}, None]
            child[0] = label[common:]
            node[1][key[at]] = middle
            node, at = middle, at + common
        if node[2] is None:
            node[2] = (*value, extra)
            self.strings += 1
        else:
            node[2] = (*_better(node[2][:3], value), node[2][3])
        if self.limit is not None and self.held > self.limit:
            self._spill()

    def _sizes(self) -> tuple[dict[int, int], set[int]]:
        """Bytes of each subtree, by the identity of its node, and the nodes with a stub below them."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [x for x in node[1].values() if x[1] is not None]
        sizes: dict[int, int] = {}
        stubs: set[int] = set()
        for node in reversed(order):
            sizes[id(node)] = len(node[0]) + 200 + sum(sizes[id(x)] for x in node[1].values() if x[1] is not None)
            if any(x[1] is None or id(x) in stubs for x in node[1].values()):
                stubs.add(id(node))
        return sizes, stubs

    def _spill(self) -> None:
        if self.strings < 2:
            self.limit = 2 * self.held  # a single long string stays
            return
        sizes, stubs = self._sizes()
        node, path = self.root, b""
        while True:
            big = max((x for x in node[1].values() if x[1] is not None), key=lambda x: sizes[id(x)], default=None)
            if big is None or not big[1] or 2 * sizes[id(big)] <= self.held:
                break
            node, path = big, path + big[0]
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory()
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            for byte, child in list(node[1].items()):
                if child[1] is None:
                    continue
                if id(child) in stubs:  # a file has part of it already: what hangs below goes, by subtree
                    stack.append((child, path + child[0]))
                    continue
                number, self.turn = self.turn % self.FILES, self.turn + 1
                if number not in self.files:
                    self.files[number] = open(f"{self.folder.name}/{number}", "wb")
                for key, value, extra in self._walk(child, path):
                    pickle.dump((key[8:], value, extra), self.files[number])
                    self.strings -= 1
                node[1][byte] = [b"", None, number]
                self.held -= sizes[id(child)]
        self.limit = max(self.budget, self.held + self.budget // 2)

    @staticmethod
    def _walk(node: list, key: bytes) -> Iterator[tuple]:
        stack = [(node, key)]
        while stack:
            node, key = stack.pop()
            if node[1] is None:
                continue
            key += node[0]
            if node[2] is not None:
                yield key, node[2][:3], node[2][3]
            stack += [(x, key) for x in node[1].values()]

    def items(self) -> Iterator[tuple]:
        """(string, (−code points, doc_id, copies), extra) of each distinct string; the trie is used up."""
        for key, value, extra in self._walk(self.root, b""):
            yield key[8:], value, extra
        self.root = None
        for out in self.files.values():
            out.close()
        for number in self.files:
            sub, path = Trie(self.budget), f"{self.folder.name}/{number}"
            with open(path, "rb") as spilled:
                while True:
                    try:
                        sub.insert(*pickle.load(spilled))
                    except EOFError:
                        break
            os.unlink(path)
            yield from sub.items()


def _tries(budget: int, with_body: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct strings of this task; before the shuffle a full trie is simply sent on, after it subtrees are spilled."""

        def out(trie: Trie) -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[], [], [], [], [], []]
            size = 0
            for key, (points, doc, copies), sha in trie.items():
                for c, v in zip(cols, (len(key), sha, key if with_body else b"", -points, None if doc == _NO_ID else doc, copies), strict=True):
                    c.append(v)
                size += len(key) + 100
                if size > 8 << 20:
                    yield _batch(cols)
                    cols, size = [[], [], [], [], [], []], 0
            if cols[0]:
                yield _batch(cols)

        trie = Trie(None if with_body else budget)
        for batch in batches:
            shas, points, docs, copies = (batch.column(c).to_pylist() for c in ("sha", "n_points", "doc_id", "copies"))
            body = batch.column("body")
            for i, sha in enumerate(shas):
                trie.insert(body[i].as_py(), (-points[i], _NO_ID if docs[i] is None else docs[i], copies[i]), sha)
                if with_body and trie.held > budget:
                    yield from out(trie)
                    trie = Trie(None)
        yield from out(trie)

    return run


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ("n_bytes", "sha", "body", "n_points", "doc_id", "copies")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")


def text_classes(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """One row a distinct normalised text: text_sha256, keep_id, group_size.

    Each task first folds its own copies in a trie, so a text that a third of all rows repeat leaves each task once. The
    distinct strings are dealt out by length and content hash, and the trie there compares them whole.
    """
    norm = normalised(F.col("text"))
    rows = docs.select(norm.alias("norm"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.select(F.octet_length("norm").cast("long").alias("n_bytes"), F.sha2("norm", 256).alias("sha"), F.col("norm").cast("binary").alias("body"), "n_points", "doc_id", F.lit(1).cast("long").alias("copies"))
    local = rows.mapInArrow(_tries(budget, True), _SCHEMA)
    whole = local.repartition(partitions(docs.sparkSession), "n_bytes", "sha").mapInArrow(_tries(budget, False), _SCHEMA)
    return whole.select(F.col("sha").alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"))


def exact_dedup(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """One row a row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. The row with the most code points in its original text stays,
    then the smallest doc_id (null last). Null text counts as empty. Rows that repeat the keeper's doc_id within its group
    are the same document, so all of them are marked kept (`keep_exact` returns one). No rows in, no rows out; other columns
    are not read.
    """
    rows = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    out = rows.join(text_classes(docs, budget), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, one a distinct text. The join on text and doc_id deals no hot key.
    Of rows that share the keeper's doc_id and text, the one with the most code points, then that whose columns hash lowest."""
    key, n, sha, keep_id = (unused(docs, x) for x in ("key", "n", "sha", "keep"))
    keep = text_classes(docs).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep_id))
    rows = docs.withColumn(key, F.sha2(normalised(F.col("text")), 256))
    rows = rows.join(keep, (F.col(key) == F.col(sha)) & F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)), "left_semi")
    first = Window.partitionBy(key, "doc_id").orderBy(F.length("text").desc_nulls_last(), F.xxhash64(F.to_json(F.struct(*docs.columns))))
    return rows.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).drop(n, key)


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
