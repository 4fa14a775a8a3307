"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment of the passages they point at.

A long item's seeds are pairs of words up to three apart. Every passage that aligns well enough keeps a known number of them, so an
item can do without as many of its most common ones, less the two or three that a passage is then asked to have: only rare pairs are
looked up, and no passage that the alignment accepts is missed.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, mix64, sliced

#: Words of a short item's seeds; alignment scores; the share of an item's best possible score from which a passage counts as a copy.
SEED_WORDS = 3
MATCH, MISMATCH, GAP = 1.0, -0.25, -0.25
THRESHOLD = 0.6
#: Items from so many words on are found by pairs of words at most REACH apart.
LONG_ITEM, REACH = 8, 3
#: Words of a document that an alignment with an item of n words can take up: m matches cost nothing, each word more 0.25.
SPREAD = 1 + (1 - THRESHOLD) / -GAP
BLOCK_BYTES = 16 << 20
#: Places of seeds that are looked at together.
HITS = 1 << 20


def least_pairs(n: int) -> int:
    """Pairs of words, next to each other among the matches and at most REACH apart both in the item and in the document, that every alignment of
    THRESHOLD or more with an item of n words has.

    With m matches there are m - 1 pairs. An alignment may skip n - m words of the item and, at 0.25 each, 4 (m - 0.6 n) of the document; REACH
    skipped words break one pair. What is left is least at any m alike: 7/15 n - 1.
    """
    return max(1, math.ceil(n * (1 - (1 - THRESHOLD) / -GAP / REACH) - 1 - 1e-9))


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score of two word sequences, and where it starts and ends in the window.

    Row by row; a gap along the row is a running maximum of (value − gap x column). Starts travel with the scores.
    """
    n = len(window)
    along = -GAP * np.arange(n + 1)
    score, start = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(window == word, MATCH, MISMATCH)
        down = score[1:] + GAP
        value, begin = np.zeros(n + 1), np.arange(n + 1)
        value[1:] = np.maximum(np.maximum(diagonal, down), 0)
        begin[1:] = np.where(value[1:] <= 0, begin[1:], np.where(diagonal >= down, start[:-1], start[1:]))
        lifted = value + along
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        score, start = top - along, begin[source]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (float(score[at]), int(start[at]), at)
    return best


def pair_hashes(words: np.ndarray, apart: int) -> np.ndarray:
    """A hash of the words at each place and `apart` places later, whatever their distance."""
    return mix64(words[:-apart] * _FIRST + words[apart:] * _SECOND) if apart < len(words) else np.zeros(0, np.uint64)


_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Seeds:
    """The seeds of a block of benchmark items as flat arrays: sorted hashes, and for each the places (item, position) it stands at.

    An item of LONG_ITEM words or more has pairs of words, those that begin at its rarest places; a passage must have `need` of them, at different
    places, within `span` words. A shorter one has runs of SEED_WORDS words, or all of its words, of which one will do.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        n = np.array([len(words) for _, words in items], np.int64)
        self.lengths = sorted({min(int(x), SEED_WORDS) for x in n if x < LONG_ITEM})
        self.pairs = bool((n >= LONG_ITEM).any())
        self.need = np.array([min(3, least_pairs(int(x))) if x >= LONG_ITEM else 1 for x in n], np.int64)
        self.span = np.ceil(n * SPREAD).astype(np.int64) + REACH
        hashes, item, pos = self._all()
        order = np.argsort(hashes, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.hashes & np.uint64((1 << 22) - 1)] = True

    def _all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        pairs = []
        for k, (_, words) in enumerate(self.items):
            if len(words) < LONG_ITEM:
                h = grams(words, min(len(words), SEED_WORDS))
                found.append((h, np.full(len(h), k), np.arange(len(h))))
            else:
                for apart in range(1, REACH + 1):
                    h = pair_hashes(words, apart)
                    pairs.append((h, np.full(len(h), k), np.arange(len(h))))
        if pairs:
            h, item, pos = (np.concatenate(x) for x in zip(*pairs, strict=True))
            # how common a place is: its most common pair among all items, and the most common words of it
            _, at, times = np.unique(h, return_inverse=True, return_counts=True)
            common = times[at].astype(np.float64)
            words = np.concatenate([w for _, w in self.items if len(w) >= LONG_ITEM])
            single, of = np.unique(words, return_counts=True)
            for k in np.unique(item).tolist():
                mine = slice(*np.searchsorted(item, [k, k + 1]))
                w = self.items[k][1]
                share = of[np.searchsorted(single, w)] / len(words)
                place = pos[mine]
                worst = np.zeros(len(w))
                np.maximum.at(worst, place, common[mine] + share[place])
                spare = least_pairs(len(w)) - int(self.need[k])
                drop = np.argsort(-worst[: len(w) - 1], kind="stable")[:spare]
                keep = ~np.isin(place, drop)
                found.append((h[mine][keep], item[mine][keep], place[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among hashes that are seeds, and the seeds' numbers."""
        hit = np.flatnonzero(self.sieve[hashes & np.uint64((1 << 22) - 1)])
        if not len(self.hashes) or not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[hit]
        return hit[same], at[same]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word number, seed) of all seeds in the rows of a slice, by word number."""
        row, found = w.row_of(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size, hashes in [(n, grams(w.hash, n)) for n in self.lengths] + [(d + 1, pair_hashes(w.hash, d)) for d in range(1, REACH + 1) if self.pairs]:
            hit, seed = self.find(hashes)
            inside = row[hit] == row[hit + size - 1]
            found.append((hit[inside], seed[inside]))
        hit, seed = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(hit, kind="stable")
        return hit[order], seed[order]

    def windows(self, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first and last + 1 word of the row) of the passages that have enough seeds of an item, in order and apart from
        each other. Hits go through in parts of HITS places; a part keeps places, once each, and no more than the last `span` words go on to the
        next, so a text of one word over and over needs no more memory than any other."""
        hit, seed = self.hits(w)
        if not len(hit):
            return
        row = w.row_of()
        times = np.diff(self.first)[seed]
        upto = np.cumsum(times)
        merged: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        held = np.zeros((2, 0), np.int64)  # items and word numbers
        lo = 0
        while lo < len(hit):
            done = int(upto[lo - 1]) if lo else 0
            hi = max(int(np.searchsorted(upto, done + HITS, side="right")), lo + 1)
            count = times[lo:hi]
            place = np.repeat(self.first[seed[lo:hi]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            now = np.stack((self.item[place], np.repeat(hit[lo:hi], count)))
            both = np.concatenate((held, now), axis=1)
            key = np.unique(both[0].astype(np.uint64) << np.uint64(40) | both[1].astype(np.uint64))
            item, at = (key >> np.uint64(40)).astype(np.int64), (key & np.uint64((1 << 40) - 1)).astype(np.int64)
            need, span = self.need[item], self.span[item]
            other = np.arange(len(key)) + need - 1
            k = np.flatnonzero(other < len(key))
            end = other[k]
            k = k[(item[end] == item[k]) & (row[at[end]] == row[at[k]]) & (at[end] - at[k] <= span[k])]
            if len(k):
                begin, stop = at[k + need[k] - 1] - span[k], at[k] + span[k] + 1
                r, of = row[at[k]], item[k]
                begin, stop = np.maximum(begin, w.rows[r]), np.minimum(stop, w.rows[r + 1])
                # spans of one row and item that touch become one
                new = np.ones(len(k), bool)
                new[1:] = (of[1:] != of[:-1]) | (r[1:] != r[:-1]) | (begin[1:] > stop[:-1])
                cuts = np.flatnonzero(new)
                for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(k)], strict=True):
                    spans, b, e = merged[int(r[i]), int(of[i])], int(begin[i]), int(stop[j - 1])
                    if spans and b <= spans[-1][1]:
                        spans[-1] = [min(b, spans[-1][0]), max(e, spans[-1][1])]
                    else:
                        spans.append([b, e])
            last = int(hit[hi - 1])
            keep = at > last - span
            held, lo = np.stack((item[keep], at[keep])), hi
        for (r, k), spans in sorted(merged.items()):
            for b, e in spans:
                yield r, k, b - int(w.rows[r]), e - int(w.rows[r])

    def matches(self, w: Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item_id, share of the best possible score, first and last + 1 word) of the best passage of each row and item that reaches THRESHOLD."""
        best: tuple | None = None
        for r, k, lo, hi in self.windows(w):
            if best and best[:2] != (r, k):
                yield best[0], self.items[best[1]][0], *best[2]
                best = None
            item, start = self.items[k][1], int(w.rows[r])
            window = w.hash[start + lo : start + hi]
            # no alignment can score more than the words it shares, within the words that it can take up
            shared = np.cumsum(np.concatenate(([0], np.isin(window, item))))
            reach = min(int(self.span[k]), len(window))
            if (shared[reach:] - shared[: len(shared) - reach]).max() < THRESHOLD * len(item):
                continue
            score, a, b = align(item, window)
            if score >= THRESHOLD * len(item) and (best is None or (score / len(item), lo + a, lo + b) > best[2]):
                best = r, k, (score / len(item), lo + a, lo + b)
        if best:
            yield best[0], self.items[best[1]][0], *best[2]


def _words(texts: pa.Array) -> Words:
    return Words(texts, lower=True, trim=True)


def blocks(benchmark: DataFrame, least_words: int = 1) -> Iterator[Seeds]:
    """Seeds of the benchmark's items of least_words words or more, in blocks of about BLOCK_BYTES of text, so that what goes to the
    tasks (some 4 times that, as arrays) is bounded however long the benchmark is. Each block is a scan of the documents."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // BLOCK_BYTES)
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id").toArrow()
        if not rows.num_rows:
            continue
        w = _words(rows.column("text").combine_chunks())
        ids = rows.column("item_id").to_pylist()
        seeds = Seeds([(ids[i], w.hash[w.rows[i] : w.rows[i + 1]].copy()) for i in range(len(ids)) if w.rows[i + 1] - w.rows[i] >= least_words])
        if len(seeds.hashes):
            yield seeds


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = SEED_WORDS) -> DataFrame:
    """One row a document and benchmark item it holds a copy of: doc_id, item_id, score, first_word, last_word.

    Words are compared without ASCII case and outer ASCII punctuation. Score is the best alignment's share of the item's best
    possible one, 0.6 or more. Every passage that reaches it is found for items of 8 words or more (`least_pairs`), also if no two of
    its words still stand side by side; one of a shorter item must keep 3 words in a row. Items under
    least_words words are not searched for: by default those of one or two, too short to tell a leak from chance; with 1 they are found
    where all their words stand in a row. Null or empty texts on either side
    match nothing; null ids stay null; repeated rows give a row each; empty tables give no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, score double, first_word long, last_word long"
    out = None
    for seeds in blocks(benchmark, least_words):

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                rows, found = [], []
                for r, *m in seeds.matches(_words(batch.column("text"))):
                    rows.append(r)
                    found.append(m)
                cols = [pa.array([m[i] for m in found], k) for i, k in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *cols], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_words: int = SEED_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no copy of a benchmark item of least_words words or more: a word or two in
    common with a benchmark is no sign of a leak, so shorter items condemn no document unless asked to. No shuffle."""
    for seeds in blocks(benchmark, least_words):

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                good = np.ones(batch.num_rows, bool)
                good[[r for r, *_ in seeds.matches(_words(batch.column("text")))]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
