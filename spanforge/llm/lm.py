"""Language-model scoring with an n-gram trie in Elias-Fano levels, dealt out over shards by context."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import Words, mix64, partitions

#: Absolute discount of counts after a context; width of a quantisation step of log10 probabilities; hashes of the end of a
#: text (a token) and of the context at its start.
DISCOUNT, STEP = 0.75, 0.05
END, START = np.uint64(0x517C_C1B7_2722_0A95), np.uint64(0x9216_D5D9_8979_FB1B)
_ONE, _CHAIN = np.uint64(1), np.uint64(0xD6E8_FEB8_6659_FD93)


def _mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays memory-mapped from one temporary file, which goes when they do."""
    out = tempfile.TemporaryFile()
    places = []
    for a in arrays:
        places.append((out.tell(), a.dtype, len(a)))
        out.write(np.ascontiguousarray(a).tobytes())
        out.write(b"\0" * (-out.tell() % 8))
    out.flush()
    return [np.memmap(out, dtype, "r", at, (n,)) if n else np.zeros(0, dtype) for at, dtype, n in places]


class EliasFano:
    """A sorted sequence below `universe`: lower bits packed, upper bits in unary, with counts of ones and zeros by word."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = n = len(values)
        self.width = max(0, (universe // max(n, 1)).bit_length() - 1)
        w = np.uint64(self.width)
        self.buckets = (universe >> self.width) + 1
        high = (values >> w).astype(np.int64)
        bits = np.zeros((n + self.buckets) // 64 + 1, np.uint64)
        at = high + np.arange(n)
        np.bitwise_or.at(bits, at >> 6, _ONE << (at & 63).astype(np.uint64))
        low = values & ((_ONE << w) - _ONE)
        packed = np.zeros(n * self.width // 64 + 2, np.uint64)
        if self.width:
            start = np.arange(n) * self.width
            word, off = start >> 6, (start & 63).astype(np.uint64)
            np.bitwise_or.at(packed, word, low << off)
            spill = off + w > 64
            np.bitwise_or.at(packed, word[spill] + 1, low[spill] >> (np.uint64(64) - off[spill]))
        ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
        self.levels = _mapped([bits, packed, np.concatenate(([0], ones[:-1])), 64 * np.arange(len(bits)) - np.concatenate(([0], ones[:-1]))])

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero in the upper bits."""
        bits, _, before_ones, before_zeros = self.levels
        before = before_ones if ones else before_zeros
        word = np.searchsorted(before, k, side="right") - 1
        value = bits[word] if ones else ~bits[word]
        rest = k - before[word]
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (value >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)
            here = np.bitwise_count(part).astype(np.int64)
            go = here <= rest
            rest = np.where(go, rest - here, rest)
            at = np.where(go, at + half, at)
        return word * 64 + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        start = i * self.width
        word, off = start >> 6, (start & 63).astype(np.uint64)
        packed = self.levels[1]
        above = np.where(off > 0, packed[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return ((packed[word] >> off) | above) & ((_ONE << np.uint64(self.width)) - _ONE)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.width) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= x among those with x's upper bits (else where they would end), and whether it is x."""
        high = (x >> np.uint64(self.width)).astype(np.int64)
        low = x & ((_ONE << np.uint64(self.width)) - _ONE)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        end = self._select(high, False) - high
        hi = end.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        found = np.zeros(len(x), bool)
        some = np.flatnonzero(lo < end)
        found[some] = self._low(lo[some]) == low[some]
        return lo, found


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes 1 … 255 of probabilities in steps of log10."""
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP) + 1, 1, 255).astype(np.uint8)


CODES = np.concatenate(([0.0], 10.0 ** (-STEP * np.arange(255))))  # code 0: not in the trie


class ContextTrie:
    """Two trie levels of a shard: contexts; their successors, as (context number, word) so that one monotone sequence holds
    all of them; pointers from the one to the other. Successors carry quantised discounted probabilities, contexts the
    quantised weight of the order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        contexts, at, kinds = np.unique(keys >> np.uint64(32), return_index=True, return_counts=True)
        total = np.add.reduceat(counts, at) if len(keys) else np.zeros(0)
        number = np.repeat(np.arange(len(contexts)), kinds)
        self.contexts = EliasFano(contexts, 1 << 32)
        self.pointers = EliasFano(np.append(at, len(keys)).astype(np.uint64), len(keys) + 1)
        self.successors = EliasFano(number.astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFF_FFFF), max(len(contexts), 1) << 32)
        codes = quantised((counts - DISCOUNT) / total[number]) if len(keys) else np.zeros(0, np.uint8)
        self.codes, self.weights = _mapped([codes, quantised(DISCOUNT * kinds / total) if len(keys) else np.zeros(0, np.uint8)])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of sorted keys, and codes of their distinct contexts' weights in order; 0 where the trie has none."""
        contexts, first, count = np.unique(keys >> np.uint64(32), return_index=True, return_counts=True)
        codes, weights = np.zeros(len(keys), np.uint8), np.zeros(len(contexts), np.uint8)
        if not self.contexts.n or not len(keys):
            return codes, weights
        number, known = self.contexts.successor(contexts)
        weights[known] = self.weights[number[known]]
        ask = np.flatnonzero(np.repeat(known, count))
        mine = np.repeat(number, count)[ask].astype(np.uint64)
        at, found = self.successors.successor(mine << np.uint64(32) | keys[ask] & np.uint64(0xFFFF_FFFF))
        begin, end = self.pointers.get(np.repeat(number, count)[ask]), self.pointers.get(np.repeat(number, count)[ask] + 1)
        found &= (at >= begin.astype(np.int64)) & (at < end.astype(np.int64))
        codes[ask[found]] = self.codes[at[found]]
        return codes, weights


class _Unit:
    """Tokens of a unit: words and an end a text, with the tokens before each."""

    def __init__(self, batch: pa.RecordBatch):
        w = Words(batch.column("text"), lower=True)
        n = len(w.rows) - 1
        self.rows = w.rows + np.arange(n + 1)
        total = self.rows[-1]
        tokens = np.empty(total, np.uint64)
        is_end = np.zeros(total, bool)
        is_end[self.rows[1:] - 1] = True
        tokens[~is_end] = w.hash
        tokens[is_end] = END
        del w
        self.train = np.repeat(~np.array([bool(x) for x in batch.column("held_out").to_pylist()], bool), np.diff(self.rows))
        self.words, self.word_of, _ = _counted(tokens)
        self.word_counts = np.bincount(self.word_of, self.train, len(self.words)).astype(np.uint32)

    def _back(self, before: np.ndarray) -> np.ndarray:
        """The token before each of these, which is the start's within a text's first ones."""
        out = np.empty_like(before)
        out[1:] = before[:-1]
        out[self.rows[:-1]] = START
        return out

    def levels(self, order: int, parts: int) -> Iterator[Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
        """For contexts of 1 … order − 1 tokens, by shard: (shard, distinct keys, training counts, token numbers, key number of each)."""
        tokens = self.words[self.word_of]
        before, context = tokens, np.full(len(tokens), 0x2545_F491_4F6C_DD1D, np.uint64)
        low = mix64(tokens) & np.uint64(0xFFFF_FFFF)
        for _ in range(1, order):
            before = self._back(before)
            context = mix64(before ^ context * _CHAIN)
            # an n-gram's shard comes from the upper half of its context's hash, its key from the lower halves of both
            part = ((context >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            yield self._by_shard(part, context << np.uint64(32) | low, parts)

    def _by_shard(self, part: np.ndarray, key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[cuts[p] : cuts[p + 1]]
            keys, of, _ = _counted(key[mine])
            yield p, keys, np.bincount(of, self.train[mine], len(keys)).astype(np.uint32), mine, of


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    found, of = np.unique(values, return_inverse=True)
    return found, of, len(found)


_COUNTS = 0


def _send(parts: int, order: int):
    def send(unit: int, tag: int, batch: pa.RecordBatch) -> Iterator[tuple]:
        u = _Unit(batch)
        cuts = X.owner(u.words, parts)
        bodies = [[X.squeeze_sorted(u.words[cuts[p] : cuts[p + 1]]), X.squeeze(u.word_counts[cuts[p] : cuts[p + 1]])] for p in range(parts)]
        for level in u.levels(order, parts):
            for p, keys, counts, _, _ in level:
                bodies[p] += [X.squeeze_sorted(keys), X.squeeze(counts)]
        for p, body in enumerate(bodies):
            yield p, _COUNTS, unit, tag, X.join(body)

    return send


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys that were seen in training, sorted, with their counts over all units."""
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    seen = c > 0
    k, c = k[seen], c[seen]
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _answer(parts: int, order: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        asked: list[tuple[int, int, list[bytes]]] = []
        for batch in batches:
            for unit, tag, body in zip(batch.column("unit").to_pylist(), batch.column("tag").to_pylist(), batch.column("body"), strict=True):
                asked.append((unit, tag, X.parted(body.as_py())))
        if not asked:
            return
        words, counts = _merged([X.expand_sorted(b[0]) for *_, b in asked], [X.expand(b[1], np.uint32) for *_, b in asked])
        # one order at a time: a finished level is mapped from disk
        tries = [ContextTrie(*_merged([X.expand_sorted(b[k]) for *_, b in asked], [X.expand(b[k + 1], np.uint32) for *_, b in asked])) for k in range(2, 2 * order, 2)]
        here = np.array([counts.sum(), len(words)], np.int64).tobytes()
        for unit, tag, body in asked:
            mine = X.expand_sorted(body[0])
            c = np.zeros(len(mine), np.int64)
            if len(words) and len(mine):
                at = np.minimum(np.searchsorted(words, mine), len(words) - 1)
                c = np.where(words[at] == mine, counts[at], 0)
            told = [X.squeeze(a) for k, trie in enumerate(tries, 1) for a in trie.look_up(X.expand_sorted(body[2 * k]))]
            # part of the shard's number: kinds 0 … parts − 1 bring the answers back in the order of the shards
            yield [(X.home(unit, parts), _shard(), unit, tag, X.join([here, X.squeeze(c), *told]))]

    return answer


def _shard() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _score(parts: int, order: int):
    def score(unit: int, tag: int, batch: pa.RecordBatch, got: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        u = _Unit(batch)
        answers = [X.parted(body) for _, body in sorted(got, key=lambda x: x[0])]
        n, v = np.sum([np.frombuffer(a[0], np.int64) for a in answers], axis=0)
        counts = np.concatenate([X.expand(a[1], np.int64) for a in answers])
        token_base = ((counts + 0.5) / (n + 0.5 * (v + 1)))[u.word_of]
        p = token_base.copy()
        for k, level in enumerate(u.levels(order, parts), 1):
            for shard, keys, _, mine, of in level:
                codes, weights = (X.expand(answers[shard][2 * k + i], np.uint8) for i in (0, 1))
                _, context = np.unique(keys >> np.uint64(32), return_inverse=True)
                weight = np.where(weights > 0, CODES[weights], 1.0)
                p[mine] = CODES[codes][of] + weight[context][of] * p[mine]
        yield _scored(u, batch, n, counts, token_base, np.minimum(p, 1.0))

    return score


def _scored(u: _Unit, batch: pa.RecordBatch, n: int, counts: np.ndarray, token_base: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    starts = u.rows[:-1]
    cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(u.rows), pa.int64()), pa.array(np.add.reduceat((counts > 0)[u.word_of].astype(np.int64), starts)), pa.array(np.full(len(starts), n), pa.int64())]
    cols += [pa.array(np.add.reduceat(np.log10(token_base), starts)), pa.array(np.add.reduceat(np.log10(p), starts))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, held_out: F.Column, order: int = 3) -> DataFrame:
    """One row a row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learned from the rows that are not held out: n-grams of up to `order` tokens, interpolated by absolute
    discounting down to add-half unigrams. Every n-gram is counted. For each context length a shard holds the contexts that hash
    to it, and answers the units of documents that ask for them with 8-bit codes, so no table is broadcast and a common
    context's successors are counted by unit before the shuffle. Single words are compared by 64-bit hash. An n-gram is known by its
    shard, 32 bits of its context's hash and 32 of its word's: of n contexts in a shard about n² / 2³³ share their successors
    with another, 2 in 10⁴ contexts at n = 10⁶. docs should be a stored table, for it is read twice.
    Null text counts as empty: one token, the end. Null doc_id: not held out (as the caller's expression is null); repeated
    rows count and score each; an empty table gives no rows; other columns are not read.
    """
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    answers = X.ask(rows, _send(parts, order), _answer(parts, order), parts)
    return X.meet(rows, answers, _score(parts, order), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", parts)
