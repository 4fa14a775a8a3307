"""Token counts of every prefix by dynamic programming over a public subword vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: A text falls apart before each run of spaces (no piece of the vocabulary holds a space mark after another character) and
#: around line feeds (no piece holds one).
_SEGMENTS = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+|\n").findall
_MARK = "▁"


class PrefixCounter:
    """Counts for all prefixes of a text under a byte-fallback BPE model.

    A valid BPE encoding is one whose neighbouring pieces are each the encoding of their own concatenation, so the encoding
    of a prefix ends in exactly one piece p that is valid after the last piece of the prefix that p leaves:
    count[i] = count[i − |p|] + 1. Counts of distinct segments are kept (up to `keep` of them).
    """

    def __init__(self, model_file: str, keep: int = 500_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(self.sp.get_piece_size())
        self.score = {self.sp.id_to_piece(i): self.sp.get_score(i) for i in ids if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))}
        self.pieces = list(self.score)
        self.ends: dict = {}  # trie of the pieces read from their ends; key 0 holds a piece's number
        for k, piece in enumerate(self.pieces):
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[0] = k
        self.spines: dict[str, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, bytes]] = {}
        self.keep = keep

    def _spine(self, piece: str) -> tuple[list, list]:
        """Symbols at the right and at the left end of a piece while it is merged, each with the score of the merge that ends it."""
        found = self.spines.get(piece)
        if found is None:
            parts = list(piece)
            right, left = [[parts[-1], float("-inf")]], [[parts[0], float("-inf")]]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == len(parts) - 1:
                    right[-1][1] = best
                    right.append([parts[-1], float("-inf")])
                if at == 0:
                    left[-1][1] = best
                    left.append([parts[0], float("-inf")])
            found = self.spines[piece] = (right, left)
        return found

    def _valid(self, a: str, b: str) -> bool:
        """Whether no merge across the border of a and b comes before the merges that build them."""
        for x, end_x in self._spine(a)[0]:
            for y, end_y in self._spine(b)[1]:
                s = self.score.get(x + y)
                if s is not None and s > end_x and s >= end_y:
                    return False
        return True

    def _counts(self, segments: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(segment, count of each of its prefixes); sorted segments share the work on common prefixes."""
        pieces, pairs, ends, score = self.pieces, self.pairs, self.ends, self.score
        count, last, was = [0], [-1], ""
        for segment in segments:
            s = segment.replace(" ", _MARK)
            same = 0
            for x, y in zip(s, was, strict=False):
                if x != y:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            for i in range(same + 1, len(s) + 1):
                node, j, found = ends, i, []
                while j:
                    j -= 1
                    node = node.get(s[j])
                    if node is None:
                        break
                    if 0 in node:
                        found.append((j, node[0]))
                for j, piece in reversed(found):
                    before = last[j]
                    if before >= 0:
                        key = before << 20 | piece
                        ok = pairs.get(key)
                        if ok is None:
                            if len(pairs) > 1_000_000:
                                pairs.clear()
                            ok = pairs[key] = self._valid(pieces[before], pieces[piece])
                        if not ok:
                            continue
                    count.append(count[j] + 1)
                    last.append(piece)
                    break
                else:
                    c = s[i - 1]
                    count.append(count[i - 1] + (1 if c in score else len(c.encode())))
                    last.append(-1)  # bytes merge with nothing
            was = s
            yield segment, count

    def learn(self, segments: set[str]) -> dict:
        """(count, the count's step at each character) of new segments."""
        found = {}
        for segment, count in self._counts(sorted(segments)):
            steps = np.diff(np.array(count, np.int32))
            found[segment] = (count[-1], steps.astype(np.int8).tobytes())
        return found

    def count_all(self, texts: list[str | None]) -> list[tuple[int, bytes]]:
        """(tokens, the count's steps by character, the first for the mark ahead of the text) of each text."""
        parts = [_SEGMENTS(" " + t) if t else [] for t in texts]
        every = set().union(*parts)
        missing = every.difference(self.memo)
        if len(self.memo) + len(missing) > self.keep:
            self.memo, missing = {}, every
        self.memo.update(self.learn(missing))
        memo = self.memo
        return [(sum([memo[s][0] for s in p]), b"".join([memo[s][1] for s in p])) for p in parts]

    def count(self, text: str) -> tuple[int, bytes]:
        return self.count_all([text])[0]


@lru_cache(1)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def prefix_token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_tokens, over_limit and steps.

    `steps` holds a signed byte a character: tokens gained (or lost, where a merge completes) by each character, after the step
    of the mark that the model puts ahead of a text (a character adds 4 at most, and takes a piece's length less one at most). Their running
    sum at character i is the exact count of the first i characters, so `fits` answers truncation and budget questions without
    encoding again; n_tokens is the last of these counts. The library's encoder is not called: tests hold it against the counts.
    Null text counts as empty: 0 bytes and tokens, no steps. Null doc_id, repeated rows and other columns: a row each, only
    doc_id and text are read. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for batch in sliced(batches):
            found = c.count_all(batch.column("text").to_pylist())
            cols = [batch.column("doc_id"), batch.column("n_bytes"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "steps"])

    rows = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, steps binary")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "steps")


def fits(steps: bytes, budget: int) -> int:
    """Characters in the longest prefix that has at most `budget` tokens, from stored steps."""
    counts = np.cumsum(np.frombuffer(steps, np.int8).astype(np.int64))[1:]
    ok = np.flatnonzero(counts <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def count_at(steps: bytes, chars: int) -> int:
    """Exact token count of the first `chars` characters, from stored steps."""
    return int(np.frombuffer(steps, np.int8)[: chars + 1].astype(np.int64).sum()) if chars else 0
