"""Phrase collocations by hashed counting (PCY / DHP).

A pass over the documents for each phrase length. While a pass counts the phrases of its length, it also counts the next longer ones
in hash buckets. A bucket that stays below the least count rules out all its phrases, so the next pass counts exactly only
phrases whose bucket is frequent and whose two parts, all words but the last and all but the first, are frequent too
(Apriori). Both are told by bitmaps of a fixed size, the only things that are broadcast. Buckets and bitmaps say only what
need not be counted: counts are of whole phrases and exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _GRAM, Words, _give_back, cut, mix64, partitions, sliced, text_bytes
from .exchange import expand, join, parted, squeeze

#: Buckets of a pass (a bitmap has one bit each) and the segments that are summed up apart.
BUCKETS, SEGMENTS = 1 << 24, 64
#: Tasks whose counters are added up in one.
MERGED = 1024
#: Phrases that a task holds before it sends their counts on.
HELD = 400_000
#: Shares of a language that are ranked apart; the most languages whose totals are broadcast.
SHARES, LANGUAGES = 64, 10_000
#: Bytes that end a word, and those that end a piece as well.
SPACES, STOPS = (0x20, 0x09), (0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D)
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[*SPACES, *STOPS]] = False
_STOP = np.zeros(256, np.int64)
_STOP[list(STOPS)] = 1


class Pieces(Words):
    """Words of a slice of texts in lower case, the piece that each lies in, and hashes that the language has a part in."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offs = text_bytes(texts)
        self.raw, n = _LOWER[raw], len(raw)
        solid = _SOLID[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:n]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.rows = np.searchsorted(self.starts, offs)
        row = self.row_of()
        self.piece = np.cumsum(_STOP[self.raw])[self.starts] + row if n else np.zeros(0, np.int64)
        self.langs, self.lang = np.unique(np.array(langs.fill_null(UNKNOWN).to_pylist(), object).astype(str), return_inverse=True)
        self.lang = self.lang[row] if len(row) else np.zeros(0, np.int64)
        salts = lang_salts(self.langs)
        self.hash = self._hash(_BYTE)
        self.salt = salts[self.lang] if len(self.lang) else np.zeros(0, np.uint64)

    def runs(self, k: int) -> np.ndarray:
        """Numbers of the first words of all runs of k words in one piece."""
        m = len(self.starts) - k + 1
        return np.flatnonzero(self.piece[:m] == self.piece[k - 1 :]) if m > 0 else np.zeros(0, np.int64)

    def grams(self, at: np.ndarray, k: int) -> np.ndarray:
        return gram_hash([self.hash[at + j] for j in range(k)], self.salt[at])

    def phrase(self, w: int, k: int) -> str:
        return b" ".join(self.text(i) for i in range(w, w + k)).decode("utf-8")


def lang_salts(langs: np.ndarray) -> np.ndarray:
    """A number for each language, the same in every task."""
    out = np.zeros(len(langs), np.uint64)
    for i, lang in enumerate(langs):
        h = np.uint64(len(lang))
        for b in str(lang).encode():
            h = mix64(np.array([h ^ np.uint64(b + 1)], np.uint64))[0]
        out[i] = h
    return out


def gram_hash(words: list[np.ndarray], salt: np.ndarray) -> np.ndarray:
    total = salt.copy()
    for j, h in enumerate(words):
        total += h * _GRAM[j]
    return mix64(total + np.uint64(len(words)))


def _bit(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes & np.uint64(buckets - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes, len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


ROWS = "lang string, phrase string, f long, segment int, body binary"


def _rows(langs: list, phrases: list, counts: list, segments: list, bodies: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary())
    columns = (langs, phrases, counts, segments, bodies)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "phrase", "f", "segment", "body"])


class Counted:
    """Counts of a task's phrases by language; their texts are read once. In a task, phrases are told apart by 64 bits (two of HELD
    would share them once in 10^8 tasks), between tasks by their texts."""

    def __init__(self) -> None:
        self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts, self.names = np.zeros(0, np.int64), []

    def add(self, text: Pieces, at: np.ndarray, hashes: np.ndarray, k: int) -> None:
        keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        self.counts[self.order[place[known]]] += counts[known]
        if (new := np.flatnonzero(~known)).size:
            number = np.arange(len(self.counts), len(self.counts) + len(new))
            self.names += [(str(text.langs[text.lang[w]]), text.phrase(int(w), k)) for w in at[first[new]]]
            self.counts = np.concatenate((self.counts, counts[new]))
            both = np.concatenate((self.keys, keys[new]))
            numbers = np.concatenate((self.order, number))
            order = np.argsort(both, kind="stable")
            self.keys, self.order = both[order], numbers[order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.names), 50_000):
            names = self.names[i : i + 50_000]
            none = [None] * len(names)
            yield _rows([n[0] for n in names], [n[1] for n in names], self.counts[i : i + 50_000].tolist(), none, none)


def _segments(buckets: np.ndarray) -> pa.RecordBatch:
    """The counters that are not zero, a row a segment: all of it where many are, else places and counts."""
    step = max(1, len(buckets) // SEGMENTS)
    full, bodies = [], []
    at = np.flatnonzero(buckets)
    ends = np.searchsorted(at, np.arange(0, len(buckets) + 1, step))
    for s in range(len(ends) - 1):
        place = at[ends[s] : ends[s + 1]]
        if len(place):
            dense = 8 * len(place) > step
            parts = [squeeze(buckets[s * step : (s + 1) * step])] if dense else [squeeze(np.diff(place, prepend=s * step).astype(np.uint32)), squeeze(buckets[place])]
            full.append(s)
            bodies.append(join(parts))
    none = [None] * len(full)
    return _rows(none, none, none, full, bodies)


def _add(sums: np.ndarray, body: bytes, least: int) -> None:
    parts = parted(body)
    at = np.cumsum(expand(parts[0], np.uint32)) if len(parts) == 2 else slice(None)
    sums[at] = np.minimum(sums[at] + expand(parts[-1], np.uint16), least)


def _pass(k: int, last: int, least: int, buckets: int, text_col: str, lang_col: str, hashed, parts) -> Callable:
    """Exact counts of phrases of k words that the bitmaps leave, and bucket counts of those of k + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, totals = Counted(), {}
        sums = np.zeros(buckets, np.uint16) if k < last else None
        for batch in sliced(batches, text_col):
            text = Pieces(batch.column(text_col), batch.column(lang_col))
            at = text.runs(k)
            if k == 1:
                for i, n in enumerate(np.bincount(text.lang, minlength=len(text.langs))):
                    totals[str(text.langs[i])] = totals.get(str(text.langs[i]), 0) + int(n)
            else:
                known = np.zeros(len(text.starts) + 1, bool)
                shorter = text.runs(k - 1)
                known[shorter[_has(parts.value, text.grams(shorter, k - 1))]] = True
                at = at[known[at] & known[at + 1]]
                at = at[_has(hashed.value, text.grams(at, k))]
            counted.add(text, at, text.grams(at, k), k)
            if sums is not None:
                left = np.zeros(len(text.starts) + 1, bool)
                left[at] = True
                longer = text.runs(k + 1)
                longer = longer[left[longer] & left[longer + 1]]
                where, n = np.unique(_bit(text.grams(longer, k + 1), buckets), return_counts=True)
                sums[where] = np.minimum(sums[where] + np.minimum(n, least), least)
            if len(counted.names) > HELD:
                yield from counted.rows()
                counted = Counted()
        yield from counted.rows()
        if totals:
            yield _rows(list(totals), [None] * len(totals), list(totals.values()), [None] * len(totals), [None] * len(totals))
        if sums is not None:
            yield _segments(sums)
        _give_back()

    return run


def _known(least: int, buckets: int) -> Callable:
    """Buckets of phrases that are told as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.uint16)
        for batch in batches:
            text = Pieces(batch.column("phrase"), batch.column("lang"))
            if len(text.starts):
                at, k = text.rows[:-1], np.diff(text.rows)
                for size in np.unique(k):
                    rows = at[k == size]
                    sums[_bit(gram_hash([text.hash[rows + j] for j in range(size)], text.salt[rows]), buckets)] = least
        yield _segments(sums)

    return run


def _bitmaps(rows: list[DataFrame], least: int, buckets: int) -> list[np.ndarray]:
    """For each table of counters one bit a bucket: whether its counts add up to `least`. The counters of MERGED tasks are added at a time, in as
    many rounds as that takes, so that no task reads those of all. The driver gets buckets / 8 bytes a table."""
    step = max(1, buckets // SEGMENTS)

    def added(final: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for s, body in zip(batch.column("segment").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    _add(sums.setdefault(s, np.zeros(step, np.uint16)), body, least)
            for s, counts in sums.items():
                body = squeeze(np.packbits(counts >= least, bitorder="little")) if final else join([squeeze(counts)])
                yield _rows([None], [None], [None], [s], [body])

        return run

    tables = [r.filter("segment IS NOT NULL").withColumn("segment", F.col("segment") + i * SEGMENTS) for i, r in enumerate(rows)]
    told, tasks = tables[0], max(r.rdd.getNumPartitions() for r in rows)
    for t in tables[1:]:
        told = told.unionByName(t)
    while tasks > MERGED:
        tasks = -(-tasks // MERGED)
        told = told.repartition(F.col("segment"), F.spark_partition_id() % tasks).mapInArrow(added(False), ROWS)
    out = [np.zeros(buckets // 8, np.uint8) for _ in rows]
    for r in told.repartition("segment").mapInArrow(added(True), ROWS).select("segment", "body").collect():
        i, s = divmod(r["segment"], SEGMENTS)
        out[i][s * step // 8 : (s + 1) * step // 8] = expand(bytes(r["body"]), np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, buckets: int = BUCKETS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to `longest` words that occur `least` times or more in their language, stored in the
    shared folder, and, with no phrase and 0 words, the number of all word occurrences of each language."""
    if not 1 <= least < 1 << 15 or buckets & (buckets - 1) or buckets < 8 * SEGMENTS:
        raise ValueError(f"least must be from 1 to {(1 << 15) - 1}, buckets a power of two of {8 * SEGMENTS} or more")
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    hashed = parts = out = None
    for k in range(1, longest + 1):
        rows = cut(texts.mapInArrow(_pass(k, longest, least, buckets, "text", "lang", hashed, parts), ROWS))
        sums = rows.filter("segment IS NULL").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull())
        # a hundredth of the words at most, so fewer partitions
        found = cut(sums.select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(k).alias("words"), "f").coalesce(max(1, partitions(spark) // 8)))
        out = found if out is None else out.unionByName(found)
        if k < longest:
            phrases = found.filter(F.col("phrase").isNotNull()).select("phrase", "lang")
            hashed, parts = map(sc.broadcast, _bitmaps([rows, phrases.mapInArrow(_known(least, buckets), ROWS)], least, buckets))
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, buckets: int = BUCKETS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language by how much more often they occur than their parts would by chance.

    A text is cut into pieces at . , ; : ! ? and line ends, and into words at spaces and tabs; only A-Z are lowered. A null text is
    empty, a null language `und`. Of a phrase with count a, each cut into parts with counts l and r scores floor(1000 a n / (l r)), n being the
    language's words; the lowest counts, ties by the shorter first part. A phrase in a longer one of at least its
    count is left out. Ties in rank: higher a, then the smaller phrase by bytes. Repeated rows count again. An empty
    table gives an empty one; other columns are not read. All numbers are exact (decimal(38) in between).
    """
    all_counts = frequent_phrases(docs, least, longest, buckets, text_col, lang_col)
    n = all_counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    counts = all_counts.filter("words > 0")
    found = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda lo, size: F.array_join(F.slice("w", lo, size), " ")
    inner = found.filter("words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "f")
    # a longer phrase of at least the same count has one of one word more in it, with a count between them
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = found.join(inner, ["lang", "phrase"], "left").filter("within IS NULL OR 100 * CAST(within AS DECIMAL(20, 0)) < 100 * CAST(f AS DECIMAL(20, 0))")
    cuts = kept.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    n = F.broadcast(n) if n.count() <= LANGUAGES else n
    told = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(n, "lang")
    # an integer division of decimals is exact; a is at most l and r, so that the score is a long
    told = told.withColumn("score", F.expr("(CAST(1000 * CAST(a AS DECIMAL(18, 0)) AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"))
    lowest = told.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the best of each share first, so that no task ranks a whole language
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    shares = lowest.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def oracle(least: int, longest: int, top: int) -> str:
    """The same in SQL, by counting every phrase."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH pieces AS MATERIALIZED (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, w[i : i + k - 1] AS p, count(*) AS f FROM pieces, range(1, {longest + 1}) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT * FROM f WHERE len(p) > 1),
inner_of AS (SELECT DISTINCT c.lang, c.p FROM c JOIN (SELECT lang, f, p[i : i + k - 1] AS q FROM c, range(2, {longest}) AS s(k), unnest(range(1, len(p) - k + 2)) AS t(i) WHERE k < len(p)) AS d
  ON c.lang = d.lang AND c.p = d.q AND 100 * d.f >= 100 * c.f),
cuts AS (SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, n.n, CAST(1000 * CAST(c.f AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c, unnest(range(1, len(c.p))) AS t(k), f AS l, f AS r, n WHERE l.lang = c.lang AND r.lang = c.lang AND n.lang = c.lang AND l.p = c.p[1:k] AND r.p = c.p[k + 1 :]
  AND (c.lang, c.p) NOT IN (SELECT (lang, p) FROM inner_of)),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS best FROM cuts)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase,
  a, l, r, CAST(n AS BIGINT) AS n, score FROM lowest WHERE best = 1) WHERE rank <= {top}"""


ORACLE = oracle(100, 5, 2000)
