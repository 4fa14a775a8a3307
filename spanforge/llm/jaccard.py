"""N-gram Jaccard self-join by parity sketches: links and their components."""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, cut, grams, mix64, partitions, sliced, unused
from .graph import components

#: Sketches of up to WHOLE members of a bucket that links have not joined are compared with each other; up to PAIRED members
#: of a hub that share a token are paired. Entries of one flush that share a block key more often than HOT leave their task as
#: one; a task forgets the sets it has seen after SEEN of them.
WHOLE, PAIRED, HOT, FLUSH, SEEN = 4096, 16, 64, 200_000, 200_000
#: Members of a hub that one copy of the hub's text serves; rounds of hubs before what is left is compared sketch by sketch.
SALTED, ROUNDS = 512, 4
#: One text in SAMPLE tells which shingles are common; up to COMMON of them are known as such. This only orders shingles.
SAMPLE, COMMON = 16, 200_000
#: Up to so many documents with candidates are told to the scan of the texts; more are joined in the shuffle alone.
TOLD = 500_000
_NONE = np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; with fewer words the whole sequence is one; no words, none."""
    w = Words(texts, lower=True)
    hashes = grams(w.hash, n)
    out = []
    for lo, hi in zip(w.rows[:-1], w.rows[1:], strict=True):
        if hi - lo >= n:
            s = np.sort(hashes[lo : hi - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(grams(w.hash[lo:hi], int(hi - lo)) if hi > lo else _NONE)
    return out


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers."""
    pair = (mix64(s ^ np.uint64(0xA5A5_0F0F_3C3C_9696)).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5DEE_CE66_D1CE_4E5B)).sum(dtype=np.uint64))
    return tuple(int(np.int64(x)) if x < 1 << 63 else int(x) - (1 << 64) for x in map(int, pair))


def parity(s: np.ndarray) -> list[int]:
    """A bit a shingle or more (512 at least, a power of two), one flipped by each shingle: two sets differ in no fewer shingles
    than their bits, and the halves of a longer sketch XORed are the next shorter one."""
    size = max(512, 1 << (len(s) - 1).bit_length() if len(s) else 0)
    at = mix64(s ^ np.uint64(0x3C6E_F372_FE94_F82B)) & np.uint64(size - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size) & 1).view(">i8").tolist()


@dataclass(frozen=True)
class Bands:
    """Size bands for similarity num/den. Sets of sizes a <= b that are that similar lie in one band or in neighbouring
    ones, and are joined in the band of the larger: their symmetric difference is at most
    (den − num) (a + b) / (den + num), so at most `differ` of the band's blocks differ and at least `spare` agree."""

    num: int
    den: int
    lows: tuple[int, ...]
    differ: tuple[int, ...]
    spare: tuple[int, ...]

    def of(self, size: int) -> list[int]:
        k = bisect_right(self.lows, size) - 1
        return [k, k + 1] if size * self.den // self.num >= self.lows[k + 1] else [k]


@lru_cache
def bands(num: int, den: int, most: int = 1 << 34) -> Bands:
    lows, differ, spare = [1], [], []
    while lows[-1] < most:
        low = max(lows[-1] + 1, -(-lows[-1] * den * den // (num * num)))
        d = (den - num) * 2 * (low - 1) // (den + num)
        differ.append(d)
        spare.append(3 + -(-d * 15 // 100))
        lows.append(low)
    return Bands(num, den, tuple(lows), tuple(differ), tuple(spare))


_BAND = np.uint64(0xFFF)


def block_keys(s: np.ndarray, b: Bands) -> np.ndarray:
    """Keys of the parity sketch's blocks in each band the set takes part in.

    A shingle's upper bits choose a block, which its 64-bit hash is XORed into: a shingle that only one of two sets has
    changes one block at most. A key's lowest 12 bits name its band. Blocks without shingles
    are alike in many sets and count too; as the most common blocks of a set they are the first to be left out.
    """
    out = []
    for k in b.of(len(s)):
        if b.differ[k] == 0:  # only equal sets are that similar
            continue
        n = b.differ[k] + b.spare[k]
        at = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        word = np.bitwise_xor.reduceat(mix64(s ^ np.uint64(0x632B_E59B_D9B4_E019)), first)
        block = at[first]
        if len(block) < n:
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), block)
            block, word = np.concatenate((block, empty)), np.concatenate((word, np.zeros(len(empty), np.uint64)))
        out.append(mix64(mix64(block + np.uint64(k << 40)) ^ word) & ~_BAND | np.uint64(k))
    return np.concatenate(out) if out else _NONE


_BUCKET = "part int, kind int, a long, b long, body binary"
_ENTRIES, _PAIR, _MEMBERS, _CENTRES, _GROUP = 0, 1, 2, 3, 4
#: A member's token: place in its list, length of the list, size of its set, whether it is in the long and in the short list.
_MEMBER = np.dtype([("key", np.uint64), ("handle", np.int64), ("at", np.int32), ("differ", np.int32), ("size", np.int64), ("full", bool), ("short", bool)])


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "kind", "a", "b", "body"])


def _runs(keys: np.ndarray, handles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, handle) in order, and where each key's run starts and how long it is."""
    order = np.lexsort((handles, keys))
    keys, handles = keys[order], handles[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (handles[1:] != handles[:-1])
    keys, handles = keys[new], handles[new]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys, handles, first, np.diff(np.append(first, len(keys)))


def _members(part: int, key: np.uint64, handles: np.ndarray) -> Iterator[tuple]:
    for i in range(0, len(handles), 1 << 16):
        yield part, _MEMBERS, int(key.astype(np.int64)), None, handles[i : i + (1 << 16)].tobytes()


def _emit(n: int, num: int, den: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bands(num, den)
        seen: set[tuple[int, int]] = set()
        keys, handles, held, turn = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, handles, held, turn
            k, h, first, count = _runs(np.concatenate(keys), np.concatenate(handles))
            keys, handles, held = [], [], 0
            rows, centre_k, centre_h = [], [], []
            keep = np.ones(len(k), bool)
            for i in np.flatnonzero(count > HOT):
                mine = slice(first[i], first[i] + count[i])
                keep[mine] = False
                centre_k.append(k[first[i]])
                centre_h.append(h[first[i]])
                turn += 1
                rows += _members(turn % parts, k[first[i]], h[mine])
            for kind, kk, hh in ((_ENTRIES, k[keep], h[keep]), (_CENTRES, np.array(centre_k, np.uint64), np.array(centre_h, np.uint64))):
                part = ((kk >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # grows with the key
                cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(cuts)):
                    mine = slice(cuts[p], cuts[p + 1])
                    rows.append((int(p), kind, None, None, kk[mine].tobytes() + hh[mine].tobytes()))
            for i in range(0, len(rows), 4096):
                yield _out(rows[i : i + 4096])

        for batch in sliced(batches):
            for s in shingle_sets(batch.column("text"), n):
                if not len(s) or (both := set_hashes(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()  # copies further apart than that fall together in the shuffle
                seen.add(both)
                found = block_keys(s, b)
                if len(found):
                    keys.append(found)
                    handles.append(np.full(len(found), both[0], np.int64).view(np.uint64))
                    held += len(found)
            if held >= max(FLUSH, 256 * parts):
                yield from flush()
        if held:
            yield from flush()

    return run


_GROUPS = "kind int, bucket long, members array<long>"


def _lists(kind: int, keys: np.ndarray, sizes: np.ndarray, handles: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, list of handles), some 64 thousand handles a batch."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(keys):
        end = min(max(int(np.searchsorted(ends, ends[at] + (1 << 16), side="right")) - 1, at + 1), len(keys))
        lists = pa.ListArray.from_arrays(pa.array((ends[at : end + 1] - ends[at]).astype(np.int32)), pa.array(handles[ends[at] : ends[end]].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(end - at, kind, np.int32)), pa.array(keys[at:end].view(np.int64)), lists], names=["kind", "bucket", "members"])
        at = end


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets: the handles that share a block key. A key that was hot in some task has several rows."""
    keys, handles, hot = [], [], []
    for batch in batches:
        kinds, bodies = batch.column("kind").to_numpy(), batch.column("body")
        for i in np.flatnonzero(kinds == _MEMBERS):
            h = np.frombuffer(bodies[int(i)].as_py(), np.uint64)
            yield from _lists(_GROUP, np.array([batch.column("a")[int(i)].as_py()], np.int64).view(np.uint64), np.array([len(h)]), h)
        for i in np.flatnonzero((kinds == _ENTRIES) | (kinds == _CENTRES)):
            both = np.frombuffer(bodies[int(i)].as_py(), np.uint64).reshape(2, -1)
            keys.append(both[0])
            handles.append(both[1])
            if kinds[i] == _CENTRES:
                hot.append(both[0])
    if not keys:
        return
    k, h, first, count = _runs(np.concatenate(keys), np.concatenate(handles))
    del keys, handles
    known = np.isin(k[first], np.concatenate(hot)) if hot else np.zeros(len(first), bool)
    keep = (count > 1) | known
    yield from _lists(_GROUP, k[first][keep], count[keep], h[np.repeat(keep, count)])


def _common(texts: DataFrame, n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of the texts have, sorted, and how many have each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text"), n)
            k, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (_NONE, _NONE)
            cuts = np.searchsorted(((k >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            yield _out([(int(p), _ENTRIES, None, None, k[cuts[p] : cuts[p + 1]].tobytes() + c[cuts[p] : cuts[p + 1]].astype(np.uint64).tobytes()) for p in np.flatnonzero(np.diff(cuts))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(body.as_py(), np.uint64).reshape(2, -1) for batch in batches for body in batch.column("body")]
        if not got:
            return
        k, c = np.concatenate(got, axis=1)
        order = np.argsort(k)
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        total = np.add.reduceat(c, first)
        keep = total >= 3
        yield pa.RecordBatch.from_arrays([pa.array(k[first][keep].view(np.int64)), pa.array(total[keep].astype(np.int64))], names=["token", "n"])

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    rows = some.mapInArrow(count, _BUCKET).repartitionById(parts, "part").mapInArrow(add, "token long, n long").orderBy(F.col("n").desc(), "token").limit(COMMON).toArrow()
    token = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows.column("n").to_numpy()[order]


def _verify(n: int, num: int, den: int, parts: int, common: tuple[np.ndarray, np.ndarray]):
    """Rows by (a, salt): the text of hub a, then those of its members b. Of each pair the link if they are similar; for a
    star also the tokens by which the member can be told from the hub, dealt out by token.

    Let D(u) be the shingles in which member u differs from hub a, added ones before missing ones, those that by a sample of
    the corpus few members differ in first. Two members differ by
    |D(u)| + |D(v)| − 2 |D(u) ∩ D(v)|, so similar ones have a first common token of D among the first k(u) + 1 of each, with
    k(u) the most that u can differ from a similar set. If u is not linked to a, then |D(u)| > r (|u| + |a|) with
    r = (den − num) / (den + num), so they share over (|D(v)| + r (|a| − |v|)) / 2, and the first of those is among as many less
    of v's. So unlinked members are looked up by their k(u) + 1 tokens among all members' shorter lists:
    members that differ from the hub in ways of their own never meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, held = [], 0
        hub, hubs = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal entries, held
            e = np.concatenate(entries)
            entries, held = [], 0
            e = e[np.argsort(e["key"], kind="stable")]
            cuts = np.searchsorted(((e["key"] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            yield _out([(int(p), _ENTRIES, None, None, e[cuts[p] : cuts[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(cuts))])

        for batch in sliced(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column("text"), n)
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "h_a", "h_b", "member", "star"))
            links = []
            for y, a, b, ha, hb, member, star in zip(sets, *columns, strict=True):
                if a != hub:
                    hub, hubs = a, {}
                # rows that repeat a doc_id with another text are told apart by their set's hash
                if set_hashes(y)[0] != hb:
                    continue
                if not member:
                    hubs[hb] = y
                    continue
                x = hubs[ha]
                if not star and min(len(x), len(y)) * den < max(len(x), len(y)) * num:
                    continue
                added = y[~np.isin(y, x, assume_unique=True)]
                same = len(y) - len(added)
                if ok := same * den >= num * (len(x) + len(y) - same):
                    links.append((0, _PAIR, a, b, None))
                if star:
                    tokens = np.concatenate((added, x[~np.isin(x, y, assume_unique=True)]))
                    if len(common[0]):
                        at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1)
                        held_by = np.where(common[0][at] == tokens, common[1][at], 0)
                        held_by[len(added) :] = (1 << 62) - held_by[len(added) :]  # of the hub's own: what many have, few lack
                        tokens = tokens[np.argsort(held_by, kind="stable")]
                    most = (den - num) * (len(y) + len(y) * den // num) // (den + num) + 1
                    short = min(most, len(tokens) - max(0, (den + num) * len(tokens) + (den - num) * (len(x) - len(y))) // (2 * (den + num)))
                    differ = len(tokens)
                    tokens = tokens[: short if ok else most]
                    e = np.zeros(len(tokens), _MEMBER)
                    e["key"] = mix64(tokens ^ mix64(np.array([ha], np.int64).view(np.uint64)))
                    e["handle"], e["at"], e["differ"], e["size"] = hb, np.arange(len(tokens)), differ, len(y)
                    e["full"], e["short"] = not ok, e["at"] < short
                    entries.append(e)
                    held += len(tokens)
            if links:
                yield _out(links)
            if held >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def _meet_members(num: int, den: int):
    """Pairs of handles, at least one of them unlinked to the hub, that share a token of their lists (for one side, of the
    shorter one). If it is the first that they share, they share no more than what is left of either list from there on; a
    pair is only passed on by a token that leaves enough. Where many share a token, they are a bucket of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(body.as_py(), _MEMBER) for batch in batches for body in batch.column("body")]
        if not got:
            return
        e = np.concatenate(got)
        e = e[np.argsort(e["key"], kind="stable")]
        first = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
        count = np.diff(np.append(first, len(e)))
        full = np.add.reduceat(e["full"].astype(np.int64), first)
        pairs, groups, held = [], {}, 0

        def paired() -> Iterator[pa.RecordBatch]:
            _, b, at, size = _runs(*np.concatenate(pairs, axis=1).astype(np.int64).view(np.uint64))
            a = np.repeat(_[at], size)
            both = np.stack((a, b), axis=1).ravel()
            yield from _lists(_PAIR, np.zeros(len(a), np.uint64), np.full(len(a), 2), both)

        for i in np.flatnonzero((count > 1) & (full > 0)):
            mine = e[first[i] : first[i] + count[i]]
            if len(mine) > PAIRED:
                members = np.unique(mine["handle"])
                groups[int(mix64(members.view(np.uint64)).sum(dtype=np.uint64))] = (mine["key"][0], members)
                continue
            u, v = mine[mine["full"]], mine[mine["short"]]
            a, b = np.repeat(u, len(v)), np.tile(v, len(u))
            apart = (den - num) * (a["size"] + b["size"]) // (den + num)
            share = -((apart - a["differ"] - b["differ"]) // 2)
            ok = (np.minimum(a["differ"] - a["at"], b["differ"] - b["at"]) >= share) & (a["handle"] != b["handle"])
            a, b = a["handle"][ok], b["handle"][ok]
            pairs.append(np.stack((np.minimum(a, b), np.maximum(a, b))))
            held += len(a)
            if held > 1 << 20:
                yield from paired()
                pairs, held = [], 0
        if held:
            yield from paired()
        for key, members in groups.values():
            yield from _lists(_GROUP, np.array([key], np.uint64), np.array([len(members)]), members.view(np.uint64))

    return run


def _pair_whole(num: int, den: int, first: bool):
    """Rows by bucket (bucket, h, n, comp, bits): pairs of different components whose sizes and sketches allow a link (with
    `first`, in a bucket of over PAIRED members, for each member only one with the first other one). Members meet in numpy; only
    those pairs become rows."""

    def possible(n: np.ndarray, comp: np.ndarray, bits: np.ndarray, of: slice) -> tuple[np.ndarray, np.ndarray]:
        apart = np.bitwise_count(bits[of, None, :] ^ bits[None, : of.stop, :]).sum(2, dtype=np.int64)
        x, y = n[of, None], n[None, : of.stop]
        ok = (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (apart * (den + num) <= (x + y) * (den - num)) & (comp[of, None] != comp[None, : of.stop])
        ok &= np.arange(of.start, of.stop)[:, None] > np.arange(of.stop)[None, :]
        if first and len(n) > PAIRED:
            some = np.flatnonzero(ok.any(1))
            return some + of.start, ok[some].argmax(1)
        i, j = np.nonzero(ok)
        return i + of.start, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                cols = kept
            else:
                lists = batch.column("bits")
                mine = [batch.column(c).to_numpy() for c in ("bucket", "h", "n", "comp")]
                mine += [np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(np.uint64)]
                cols = mine if kept is None else [np.concatenate(x) for x in zip(kept, mine, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            bucket, h, n, comp, length, words = cols
            ends = np.concatenate(([0], np.cumsum(length)))
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            whole = cuts if batch is None else cuts[:-1]
            left, right = [], []
            for lo, hi in zip(whole[:-1].tolist(), whole[1:].tolist(), strict=True):
                if hi - lo < 2 or comp[lo:hi].min() == comp[lo:hi].max():
                    continue
                short = int(length[lo:hi].min())
                if (length[lo:hi] == short).all():
                    bits = words[ends[lo] : ends[hi]].reshape(-1, short)
                else:
                    bits = np.stack([np.bitwise_xor.reduce(words[ends[i] : ends[i + 1]].reshape(-1, short), 0) for i in range(lo, hi)])
                step = max(1, (1 << 18) // ((hi - lo) * short))
                for at in range(0, hi - lo, step):
                    i, j = possible(n[lo:hi], comp[lo:hi], bits, slice(at, min(at + step, hi - lo)))
                    left.append(h[lo + i])
                    right.append(h[lo + j])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a)], names=["a", "b"])
            rest = whole[-1]
            kept = [x[rest:] for x in cols[:5]] + [words[ends[rest] :]]

    return run


def _thinned(groups: DataFrame, b: Bands) -> DataFrame:
    """Buckets without what no pair needs: similar sets agree in `spare` blocks of a band, so that each may leave its
    spare − 1 most common ones out, and the rarest block that they share is left in both. Passages that many texts share fill
    a few blocks of each, and go. Lists are of some 4,096 members at most, however large a bucket is."""
    sizes = groups.groupBy("bucket").agg(F.sum(F.size("members")).alias("size"))
    band = F.col("bucket").bitwiseAND(F.lit(int(_BAND))).cast("int")
    rows = groups.join(sizes, "bucket").select("bucket", "size", F.explode("members").alias("h"))
    common_first = Window.partitionBy("h", band).orderBy(F.col("size").desc(), "bucket")
    rows = rows.withColumn("at", F.row_number().over(common_first)).filter(F.col("at") >= F.element_at(F.array(*[F.lit(x) for x in b.spare]), band + 1))
    rows = cut(rows.select("bucket", "h"))
    left = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    rows = rows.join(left, "bucket").withColumn("salt", F.pmod(F.xxhash64("h"), F.ceil(F.col("size") / 4096)))
    return rows.groupBy("bucket", "salt").agg(F.collect_set("h").alias("members")).select("bucket", "members")


def _hubs(groups: DataFrame) -> DataFrame:
    """(bucket, hub): the member that is in most buckets. Where copies were made from one text, that text is in all of them."""
    rows = groups.select("bucket", F.explode("members").alias("h"))
    degree = rows.groupBy("h").agg(F.count("*").alias("degree"))
    return rows.join(degree, "h").groupBy("bucket").agg(F.max_by("h", F.struct("degree", "h")).alias("hub"))


def _best_hubs(groups: DataFrame) -> DataFrame:
    """(a, b): for each member b the hub a of most of its buckets. Lists of members meet their hub before they are unpacked, so
    no bucket is a key of the shuffle by row."""
    starred = groups.join(_hubs(groups), "bucket").select("hub", F.explode("members").alias("h")).filter("h != hub")
    return starred.groupBy("h", "hub").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("hub", F.struct("n", "hub")).alias("a")).select("a", F.col("h").alias("b"))


class _Search:
    """Links found so far over sets that are known by handle (64-bit hash), and what is still to be looked at."""

    def __init__(self, classes: DataFrame, texts: DataFrame, n: int, num: int, den: int):
        self.classes, self.texts, self.n, self.num, self.den = classes, texts, n, num, den
        self.parts = partitions(texts.sparkSession)
        self.links: DataFrame | None = None
        self.nodes = classes.select(F.col("h1").alias("h"), "rep", "n", "bits", F.col("rep").alias("comp"))
        self.common: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, links: DataFrame) -> None:
        """Take up links (a, b) between representatives; `nodes` then has the components they make."""
        if links.isEmpty():
            return
        self.links = components(links if self.links is None else links.unionByName(self.links.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        at = self.links.withColumnRenamed("node", "rep")
        self.nodes = cut(self.classes.join(at, "rep", "left").select(F.col("h1").alias("h"), "rep", "n", "bits", F.coalesce("component", "rep").alias("comp")))

    def verified(self, pairs: DataFrame, star: bool = False) -> DataFrame:
        """Pairs of handles (a: hub, b) against their whole texts: links between representatives, and with `star` the hub's tokens.
        A pair that is no star is left out if links have joined it or if sizes or parities rule it out. A text goes through the
        shuffle once a pair for b, and once for up to about SALTED pairs for the hub."""
        num, den = self.num, self.den
        rep = self.nodes.select(F.col("h").alias("h_a"), F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("comp").alias("c_a"))
        other = self.nodes.select(F.col("h").alias("h_b"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), F.col("comp").alias("c_b"))
        named = pairs.select(F.col("a").alias("h_a"), F.col("b").alias("h_b")).distinct().join(other, "h_b").join(rep, "h_a").filter("a != b")
        if not star:
            half = lambda x: F.zip_with(F.slice(x, 1, F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda p, q: p.bitwiseXOR(q))
            as_short = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)  # noqa: E731  (sizes this near differ by one halving at most)
            bits = F.zip_with(as_short(F.col("bits_a"), F.col("bits_b")), as_short(F.col("bits_b"), F.col("bits_a")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
            near = (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (F.aggregate(bits, F.lit(0), lambda t, x: t + x) * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num))
            named = named.filter((F.col("c_a") != F.col("c_b")) & near)
        named = cut(named.select("a", "b", "h_a", "h_b"))
        if named.isEmpty():
            return self.texts.sparkSession.createDataFrame([], _BUCKET)
        heavy = named.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > SALTED)
        salt = F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / SALTED)), F.lit(0)).cast("int")
        named = named.join(heavy, "a", "left").select("a", "b", "h_a", "h_b", salt.alias("salt"))
        texts = self.texts
        ids = cut(named.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        if ids.count() <= TOLD:
            texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
        members = named.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", F.lit(True).alias("member"), "b", "h_a", "h_b", "text")
        hubs = named.select("a", "salt", "h_a").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(False).alias("member"), F.col("a").alias("b"), "h_a", F.col("h_a").alias("h_b"), "text")
        rows = hubs.unionByName(members).withColumn("star", F.lit(star)).repartition(self.parts, "a", "salt").sortWithinPartitions("a", "salt", "member")
        if star and self.common is None:
            self.common = _common(self.texts, self.n, self.parts)
        return cut(rows.mapInArrow(_verify(self.n, num, den, self.parts, self.common if star else (_NONE, _NONE)), _BUCKET))

    def open(self, groups: DataFrame) -> DataFrame:
        """The buckets whose members links have not joined into one component: bucket, members, size."""
        rows = groups.select("bucket", F.explode("members").alias("h")).join(self.nodes.select("h", "comp"), "h")
        apart = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
        return cut(groups.join(apart.select("bucket", "size"), "bucket"))

    def centres(self, groups: DataFrame) -> DataFrame:
        """(bucket, hub): the smallest set of the component that the bucket has most members of. A hub need not be a member:
        buckets of one group of near copies so have one hub, and each member is compared with it once."""
        rows = groups.select("bucket", F.explode("members").alias("h")).join(self.nodes.select("h", "comp"), "h")
        counts = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        chosen = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("rep"))
        return chosen.join(self.nodes.groupBy("rep").agg(F.min("h").alias("hub")), "rep").select("bucket", "hub")

    def link(self, pairs: DataFrame) -> None:
        self.add(self.verified(pairs).filter(f"kind = {_PAIR}").select("a", "b"))

    def compare(self, groups: DataFrame) -> None:
        """All members of open buckets by their sketches: first one possible partner of each, then what that has not joined."""
        for first in (True, False):
            rows = groups.select("bucket", F.explode("members").alias("h")).distinct().join(self.nodes, "h").select("bucket", "h", "n", "comp", "bits")
            met = rows.repartition(self.parts, "bucket").sortWithinPartitions("bucket", "h").mapInArrow(_pair_whole(self.num, self.den, first), "a long, b long")
            self.link(met)
            if first:
                groups = self.open(groups.filter(F.col("size") > PAIRED).drop("size"))
                if groups.isEmpty():
                    return

    def run(self, groups: DataFrame) -> None:
        """Work off buckets (bucket, members), any two similar sets being in one at least."""
        self.link(_best_hubs(groups))
        for turn in range(ROUNDS + 1):
            groups = self.open(groups)
            if groups.isEmpty():
                return
            self.compare(groups if turn == ROUNDS else groups.filter(F.col("size") <= WHOLE))
            large = groups.filter(F.col("size") > WHOLE)
            if turn == ROUNDS or large.isEmpty():
                return
            seen = self.verified(large.join(self.centres(large), "bucket").select(F.col("hub").alias("a"), F.explode("members").alias("b")).filter("a != b"), star=True)
            self.add(seen.filter(f"kind = {_PAIR}").select("a", "b"))
            met = cut(seen.filter(f"kind = {_ENTRIES}").repartitionById(self.parts, "part").mapInArrow(_meet_members(self.num, self.den), _GROUPS))
            self.link(met.filter(f"kind = {_PAIR}").select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b")))
            groups = met.filter(f"kind = {_GROUP}").select("bucket", "members")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id. Rows whose shingle sets have Jaccard similarity of num/den or
    more are linked, and component_id is the smallest doc_id that links reach.

    1. Equal sets fall together by hash. 2. Parity sketches of distinct sets, banded by size, meet where a block agrees;
    copies within a task, and keys that one task holds many times, are folded before the shuffle, and each set leaves its most common blocks out as
    far as similar sets must agree in more. 3. Each set is verified on
    whole texts against one set first, the hub of most of its buckets. 4. A bucket whose members these links join is done. In another one
    with up to WHOLE members all sketches are compared, and pairs of different components that sizes and sketches allow are
    verified: one a member first, then what is still apart. In a larger one all members are compared with its
    hub, and members not linked to it meet those whose differences from the hub overlap theirs enough (see `_verify`); where many do, they
    are a bucket of the next round. So no link between components is lost. Rows grow with the members of a group of near
    copies, not with their square; sets that are nearly but not quite similar to each other, all of them, are verified in pairs, and those
    grow with the square of their number. Buckets still that large after ROUNDS rounds are compared by sketches too (there, time grows with the square).
    Null or empty text: no shingles, linked with nothing. Null doc_id: counted, linked with nothing, component_id null. Rows that share a doc_id
    are one node of the graph. No rows in, none out; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = shingle_sets(batch.column("text"), words)
            both = [set_hashes(s) for s in found]
            cols = [pa.array([len(s) for s in found], pa.int64()), pa.array([x for x, _ in both], pa.int64()), pa.array([y for _, y in both], pa.int64()), pa.array([parity(s) for s in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n", "h1", "h2", "bits"])

    rows = cut(texts.mapInArrow(sets, "doc_id long, n long, h1 long, h2 long, bits array<long>"))
    classes = cut(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.min("bits").alias("bits")))
    parts = partitions(spark)
    met = texts.filter("doc_id IS NOT NULL").select("text").mapInArrow(_emit(words, num, den, parts), _BUCKET).repartitionById(parts, "part").mapInArrow(_meet, _GROUPS)
    search = _Search(classes, texts, words, num, den)
    search.run(cut(_thinned(cut(met.select("bucket", "members")), bands(num, den))))
    named = search.classes.select("h1", "h2", "n", "rep")
    if search.links is None:
        named = named.withColumnRenamed("rep", "component_id")
    else:
        named = named.join(search.links.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("bits").join(named, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, one of each component: that with the smallest doc_id. Rows without doc_id stay."""
    name = unused(docs, "keep")
    keep = near_duplicates(docs, words, num, den).filter("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id) SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n_shingles, r.component_id FROM n JOIN r ON r.doc_id = n.doc_id
"""
