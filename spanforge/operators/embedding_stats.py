"""Statistics of how well embeddings reflect the genome. Samples are drawn by hash, so that every run draws the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import digest, fraction, number
from ..functions.intervals import genome_distance, signed_overlap
from ..functions.vectors import cosine, dot, l2, vector_mean
from ..sources.text import numbered
from .aggregates import confidence_95
from .cells import Cell, by_cell, square
from .knn import knn
from .lineage import cut
from .transforms import tile_sizes


#: The most points of a test that compares points with all others, and the most pairs that are broadcast.
POINTS, PAIRS = 10_000, 1_000_000


def some_points(rows: DataFrame, points: int, seed: int = 42) -> DataFrame:
    """At most `points` rows, drawn by hash of row_idx."""
    return rows.orderBy(digest(F.col("row_idx"), seed), "row_idx").limit(points)


def ctt(points: DataFrame, test_share: int = 10, most: int = POINTS) -> DataFrame:
    """(ctt, points): sum of nearest distances of uniform points over that and the sum of those of test points (every test_share-th
    row_idx), among `most` points drawn by hash.

    A uniform point's coordinates come from md5(row_idx, position), scaled to the range of each position.
    """
    points = some_points(points.select("row_idx", "vec"), most)
    p = points.select(F.col("row_idx").alias("id"), "vec")
    test = p.filter(F.col("id") % test_share == 0)
    real = knn(test, p, 1, "l2", skip_self=True).agg(F.sum("score").alias("t"), F.count("*").alias("n"))
    ends = points.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = ends.agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("ends"))
    draw = lambda id_, pos: F.conv(F.substring(F.md5(F.concat_ws("_", id_.cast("string"), pos.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    uniform = test.crossJoin(F.broadcast(ends)).select("id", F.transform("ends", lambda e: e["lo"] + draw(F.col("id"), e["pos"]) * (e["hi"] - e["lo"])).alias("vec"))
    random = knn(uniform, p, 1, "l2").agg(F.sum("score").alias("r"))
    return real.join(random).select((F.col("r") / (F.col("r") + F.col("t"))).alias("ctt"), F.col("n").alias("points"))


def sampled_pairs(rows: DataFrame, pairs: int, seed: int = 42) -> DataFrame:
    """(pair, a, b): the row_idx of two different rows of one chromosome, as many times as `pairs` says. rows: (row_idx, chrom).

    A chromosome of two rows or more is drawn uniformly, then one of its n (n - 1) / 2 pairs by number; the number is taken apart into two places, and
    those are looked up. No pair that is not drawn is ever listed. Draws are by hash.
    """
    keys = rows.select("chrom", "row_idx")
    placed = numbered(keys, order="row_idx", by="chrom", out="k")
    sizes = keys.groupBy("chrom").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.withColumn("c", F.row_number().over(Window.orderBy("chrom")) - 1)  # a row a chromosome
    chroms = sizes.agg(F.count("*").alias("chroms"))
    drawn = rows.sparkSession.range(pairs).crossJoin(F.broadcast(chroms)).filter("chroms > 0").select(F.col("id").alias("pair"), (number(F.col("id"), seed) % F.col("chroms")).alias("c"))
    drawn = drawn.join(sizes, "c").withColumn("t", F.floor(fraction(F.col("pair"), seed + 1) * (F.col("n") * (F.col("n") - 1) / 2)))
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("t").cast("double"))) / 2)
    first = lambda x: F.floor(x * (x - 1) / 2)
    drawn = drawn.withColumn("j", j).withColumn("j", F.col("j") - F.when(first(F.col("j")) > F.col("t"), 1).otherwise(0))
    drawn = drawn.withColumn("i", F.col("t") - first(F.col("j")))
    asked = drawn.select("pair", "chrom", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("i").alias("k")), F.struct(F.lit("b").alias("side"), F.col("j").alias("k")))).alias("x")).select("pair", "chrom", "x.side", "x.k")
    found = placed.join(F.broadcast(asked) if pairs <= PAIRS else asked, ["chrom", "k"])
    return found.groupBy("pair").agg(*[F.max(F.when(F.col("side") == s, F.col("row_idx"))).alias(s) for s in ("a", "b")])


def gdst(rows: DataFrame, pairs: int = 100_000, seed: int = 42) -> DataFrame:
    """(pairs, slope, r) of embedding distance on genome distance over drawn pairs (`sampled_pairs`). rows: (row_idx, chrom, start, end, vec)."""
    drawn = sampled_pairs(rows, pairs, seed)
    sides = drawn.select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("row_idx")), F.struct(F.lit("b").alias("side"), F.col("b").alias("row_idx")))).alias("x")).select("pair", "x.side", "x.row_idx")
    met = rows.select("row_idx", "chrom", "start", "end", "vec").join(F.broadcast(sides) if pairs <= PAIRS else sides, "row_idx")
    both = met.groupBy("pair").agg(*[F.max(F.when(F.col("side") == s, F.struct("chrom", "start", "end", "vec"))).alias(s) for s in ("a", "b")])
    both = both.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("chrom", "start", "end", "vec")])
    both = both.select(genome_distance("a_", "b_").alias("g"), l2(F.col("a_vec"), F.col("b_vec")).alias("e"))
    return both.agg(F.count("*").alias("pairs"), F.regr_slope("e", "g").alias("slope"), F.corr("g", "e").alias("r"))


def _moments(x: Cell, y: Cell) -> Iterator[pa.RecordBatch]:
    """Number, means and centred products of genome distance (g) and embedding distance (e) over pairs of two blocks of rows."""
    (s, e), (t, f) = ([c.rows.column(k).to_numpy(zero_copy_only=False) for k in ("start", "end")] for c in (x, y))
    a, b = (x.vec * x.vec).sum(1), (y.vec * y.vec).sum(1)
    for lo in range(0, len(x), 256):
        at = slice(lo, lo + 256)
        d = a[at, None] - 2 * (x.vec[at] @ y.vec.T) + b[None, :]
        r, c = np.nonzero(d < 1e-6 * (a[at].max() + b.max()))  # too near for the matrix product
        d[r, c] = ((x.vec[at][r] - y.vec[c]) ** 2).sum(1)
        far = np.sqrt(d)
        gap = np.fmax(np.fmax(t[None, :] - e[at, None], s[at, None] - f[None, :]), 0) / 1e6
        if x is y:  # equal ids are in one block
            before = x.id[at, None] < y.id[None, :]
            far, gap = far[before], gap[before]
        far, gap = far.ravel(), gap.ravel()
        if len(far):
            g, h = gap.mean(), far.mean()
            gap -= g
            far -= h
            yield pa.RecordBatch.from_pydict({"n": [float(len(far))], "g": [g], "e": [h], "gg": [gap @ gap], "ee": [far @ far], "ge": [gap @ far]})


def gdst_all(rows: DataFrame, block: int = 4096) -> DataFrame:
    """As gdst, over all pairs of different row_idx of a chromosome. Pairs grow with the square, and are worked out by cells of blocks of a
    chromosome's rows, of which only sums leave: no pair is a row. A slope or r that is not defined is null."""
    keyed = rows.select("chrom", F.col("row_idx").cast("long").alias("id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("vec").cast("array<double>").alias("vec")).dropna(subset=["chrom", "id"])
    ids = keyed.groupBy("chrom", "id").agg(F.count("*").alias("c")).groupBy("chrom").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
    pairs = ids.agg(F.coalesce(F.sum(F.expr("(n * n - own) div 2")), F.lit(0)).cast("long").alias("pairs"))
    parts = square(keyed.filter("vec IS NOT NULL"), ["chrom"], block, True).mapInArrow(by_cell(["chrom"], _moments), "n double, g double, e double, gg double, ee double, ge double")
    g, e = F.col("g") - F.lit(1.0), F.col("e") - F.lit(1.0)
    of = lambda own, p, q: F.sum(F.col(own) + F.col("n") * p * q).alias(own)
    sums = parts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * g).alias("g"), F.sum(F.col("n") * e).alias("e"), of("gg", g, g), of("ee", e, e), of("ge", g, e))
    gg, ee, ge = (F.col(p + q) - F.try_divide(F.col(p) * F.col(q), F.col("n")) for p, q in ("gg", "ee", "ge"))
    return pairs.crossJoin(sums.select(F.try_divide(ge, gg).alias("slope"), F.try_divide(ge, F.sqrt(gg * ee)).alias("r")))


def npt(rows: DataFrame, k: int, share: int = 10, most: int = POINTS) -> DataFrame:
    """(queries, npr): mean share of k nearest neighbours by embedding that are also among the k nearest by (start, end), for every
    share-th row_idx, `most` of them at most (drawn by hash), among all rows."""
    by_vec = rows.select(F.col("row_idx").alias("id"), "vec")
    by_place = rows.select(F.col("row_idx").alias("id"), F.array(F.col("start").cast("double"), F.col("end").cast("double")).alias("vec"))
    test = some_points(rows.select("row_idx").filter(F.col("row_idx") % share == 0), most).select(F.col("row_idx").alias("id"))
    a = knn(by_vec.join(test, "id"), by_vec, k, "l2", skip_self=True).select("query", "found")
    b = knn(by_place.join(test, "id"), by_place, k, "l2", skip_self=True).select("query", "found")
    shared = a.join(b, ["query", "found"]).agg(F.count("*").alias("n"))
    return shared.crossJoin(test.agg(F.count("*").alias("queries"))).select("queries", (F.col("n") / (F.col("queries") * k)).alias("npr"))


def npt_baseline(rows: DataFrame, k: int, share: int = 10) -> DataFrame:
    """(queries, npr, random, snpr): npt, the same of uniform vectors of that width drawn by md5(row_idx, position), and log10 of
    the one over the other (null if either is 0)."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws("_", F.col("row_idx").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    random = rows.withColumn("vec", F.transform("vec", lambda x, i: draw(i)))
    both = npt(rows, k, share).join(npt(random, k, share).select(F.col("npr").alias("random")))
    return both.withColumn("snpr", F.log10(F.nullif("npr", F.lit(0.0)) / F.nullif("random", F.lit(0.0))))


def project(rows: DataFrame, dims: int = 2) -> DataFrame:
    """(row_idx, point): principal components of centred vectors, as coordinates to plot. The driver gets the covariance only (the
    square of the vectors' width). The sign of a component is that of its largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=dims, inputCol="v", outputCol="p").fit(rows.select(array_to_vector("vec").alias("v")))
    loadings = model.pc.toArray()
    loadings = loadings * [1 if abs(max(c)) >= abs(min(c)) else -1 for c in loadings.T]
    means = vector_mean(rows.select(F.lit(0).alias("all"), "vec"), ["all"], out="mean").select("mean")
    centred = F.zip_with("vec", "mean", lambda x, m: x - m)
    return rows.crossJoin(F.broadcast(means)).select("row_idx", centred.alias("c")).select("row_idx", F.array(*[dot(F.col("c"), F.array(*[F.lit(float(x)) for x in c])) for c in loadings.T]).alias("point"))


def cct_intersection(rows: DataFrame, points: int = 8, width: int = 2000) -> DataFrame:
    """(pairs, share): pairs i < j of which one of the points of i (evenly spread) lies in j, over all pairs.

    The points of i that lie in j follow one another, so a pair counts at the first of them, and pairs are counted where they are
    made. Only pairs of a row_idx that several rows have are made distinct: they are kept apart by it, all others are one group.
    """
    place = lambda k: F.floor(F.col("start") + (F.col("end") - F.col("start")) * (k + 0.5) / points)
    rows = rows.withColumn("many", F.count("*").over(Window.partitionBy("row_idx")) > 1)
    k = F.sequence(F.lit(0), F.lit(points - 1))
    at = F.transform(F.array_sort(F.transform(k, place)), lambda x, i: F.struct(x.alias("at"), i.alias("k")))
    p = rows.select(F.col("row_idx").alias("i"), "chrom", F.col("many").alias("i_many"), at.alias("places"))
    p = p.select("i", "chrom", "i_many", F.explode(F.transform("places", lambda x: F.struct(x["at"].alias("at"), F.get(F.col("places"), x["k"] - 1)["at"].alias("before")))).alias("x"))
    p = p.select("i", "chrom", "i_many", "x.at", "x.before").filter("before IS NULL OR before < at").withColumn("bin", F.floor(F.col("at") / width))
    b = rows.filter("end >= start").select(F.col("row_idx").alias("j"), "chrom", "start", "end", F.col("many").alias("j_many"))
    b = b.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    met = p.join(b, ["chrom", "bin"]).filter("i < j AND at >= start AND at <= end AND (before IS NULL OR before < start)")
    apart = F.col("i_many") | F.col("j_many")
    hits = met.groupBy(F.when(apart, F.col("i")).alias("i"), F.when(apart, F.col("j")).alias("j")).agg(F.count("*").alias("n"))
    hits = hits.agg(F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("n")).otherwise(1)), F.lit(0)).alias("pairs"))
    n = rows.agg(F.count("*").alias("n"))
    return hits.crossJoin(n).select("pairs", (F.col("pairs") / (F.col("n") * (F.col("n") - 1) / 2)).alias("share"))


def _unlike(pool: Broadcast, least: float) -> Callable:
    """Rows without a later row of the pool of cosine above `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = pool.value
        with np.errstate(invalid="ignore", divide="ignore"):
            far = vecs / np.sqrt((vecs * vecs).sum(1))[:, None]
            for batch in batches:
                keep = []
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    i = part.column("i").to_numpy()
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1)
                    like = (v / np.sqrt((v * v).sum(1))[:, None]) @ far.T > least
                    keep.append(~(like & (ids[None, :] > i[:, None])).any(1))
                yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return run


#: Rows of the first pool, and of the largest.
POOL, LARGEST_POOL = 4096, 32768


def cct_similarity(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """(found, share): rows with any later row of cosine above `least`, over all pairs (the pairs are the divisor, as defined).

    Rounds: a pool of the last rows, of a fixed size, goes to all tasks; a row that is like a later one of the pool leaves. The next
    pool lies before it and meets only what is left. It ends when nothing is left before the pool, so rows that find a match soon cost
    one round. Rows without row_idx or vector are left out.
    """
    spark = rows.sparkSession
    left = rows.select(F.col("row_idx").cast("long").alias("i"), F.col("vec").cast("array<double>").alias("v")).dropna()
    every, found, before, size = left, 0, None, POOL
    n = left.count()
    while True:
        earlier = every if before is None else every.filter(F.col("i") < before)
        pool = earlier.orderBy(F.desc("i")).limit(size).collect()  # `size` rows
        if not pool:
            break
        sent = spark.sparkContext.broadcast((np.array([r["i"] for r in pool]), np.array([r["v"] for r in pool], float).reshape(len(pool), -1)))
        was = left.count()
        left = cut(left.mapInArrow(_unlike(sent, least), "i long, v array<double>"))
        found += was - left.count()
        before = min(r["i"] for r in pool)
        left, size = left.filter(F.col("i") < before), min(2 * size, LARGEST_POOL)
        if left.isEmpty():
            break
    share = F.lit(float(found)) / F.nullif(F.lit(n * (n - 1) / 2), F.lit(0.0))
    return spark.range(1).select(F.lit(found).cast("long").alias("found"), share.alias("share"))


def swt_overlap(base: DataFrame, moved: DataFrame) -> DataFrame:
    """(tick, overlap): mean signed overlap of displaced windows with their origin."""
    a = base.select("row_idx", F.col("chrom").alias("a_chrom"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = moved.select("row_idx", "tick", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return a.join(b, "row_idx").groupBy("tick").agg(F.avg(signed_overlap("a_", "b_")).alias("overlap"))


def subsample_error(rows: DataFrame, rates: list[float]) -> DataFrame:
    """(rate, error): mean L2 over sets between the mean of a share of the rows (in the order of md5) and the mean of all."""
    w = Window.partitionBy("set_id").orderBy(F.md5(F.col("row_idx").cast("string")), "row_idx")
    every = Window.partitionBy("set_id")
    ranked = rows.withColumn("place", F.row_number().over(w)).withColumn("n", F.count("*").over(every))
    ranked = ranked.withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates]))).filter(F.col("place") <= F.floor(F.col("n") * F.col("rate")))
    part = vector_mean(ranked, ["set_id", "rate"], "vec", "p")
    whole = vector_mean(rows, ["set_id"], "vec", "w")
    return part.join(whole, "set_id").groupBy("rate").agg(F.avg(l2(F.col("p"), F.col("w"))).alias("error"))


def entropy_by_distance(rows: DataFrame) -> DataFrame:
    """(set_id, entropy): entropy of the softmax of cosines to the set's mean, over ln n."""
    mean = vector_mean(rows, ["set_id"], "vec", "m")
    e = rows.join(mean, "set_id").select("set_id", F.exp(cosine(F.col("vec"), F.col("m"))).alias("e"))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("set_id")))
    return p.groupBy("set_id").agg((-F.sum(F.col("p") * F.ln("p")) / F.ln(F.count("*").cast("double"))).alias("entropy"))


def entropy_by_components(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(set_id, entropy): per position, the density of a histogram at the mean; entropy of their softmax over ln of their number."""
    x = rows.select("set_id", F.posexplode("vec").alias("pos", "x"))
    ends = x.groupBy("set_id", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / width), F.lit(bins - 1))
    same = x.join(ends, ["set_id", "pos"]).filter("hi > lo").withColumn("w", width).withColumn("hit", (at("x") == at("m")).cast("double"))
    d = same.groupBy("set_id", "pos").agg((F.sum("hit") / (F.first("n") * F.first("w"))).alias("d"))
    top = Window.partitionBy("set_id")
    p = d.withColumn("e", F.exp(F.col("d") - F.max("d").over(top))).withColumn("p", F.col("e") / F.sum("e").over(top)).filter("p > 0")
    return p.groupBy("set_id").agg((-F.sum(F.col("p") * F.ln("p"))).alias("h")).join(d.groupBy("set_id").agg(F.count("*").alias("k")), "set_id").select("set_id", (F.col("h") / F.ln(F.col("k").cast("double"))).alias("entropy"))


def merge_recall(points: DataFrame, k: int) -> DataFrame:
    """(a, b, recall) for neighbouring pairs of rows (2i, 2i + 1): how many of the k nearest of both the 2k nearest of their mean hold."""
    p = points.select(F.col("row_idx").alias("id"), "vec")
    pair = p.withColumn("pair", F.floor(F.col("id") / 2).cast("long"))
    full = pair.groupBy("pair").agg(F.count("*").alias("n")).filter("n = 2").select("pair")
    pair = pair.join(full, "pair")
    mean = vector_mean(pair, ["pair"]).select(F.col("pair").alias("id"), "vec")
    single = knn(pair.select("id", "vec"), p, k, "l2").select(F.floor(F.col("query") / 2).cast("long").alias("pair"), "found").distinct()
    merged = knn(mean, p, 2 * k, "l2").select(F.col("query").alias("pair"), "found")
    total = single.groupBy("pair").agg(F.count("*").alias("n"))
    shared = single.join(merged, ["pair", "found"]).groupBy("pair").agg(F.count("*").alias("hit"))
    return total.join(shared, "pair", "left").select("pair", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def _sums(folds: int, seed: int) -> Callable:
    """Sums of products of (1, vec) with itself and with the targets, of the targets and of their squares, by fold and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fold = batch.column("fold").to_numpy()
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = batch.column("target").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            x = np.concatenate((np.ones((n, 1)), x), axis=1)
            for f in np.unique(fold).tolist():
                a, b = x[fold == f], y[fold == f]
                new = [np.array([len(a)], float), a.T @ a, a.T @ b, b.sum(0), (b * b).sum(0)]
                sums[f] = [o + m for o, m in zip(sums[f], new, strict=True)] if f in sums else new
        for f, parts in sums.items():
            flat = np.concatenate([p.reshape(-1) for p in parts])
            size = np.full(len(flat), parts[1].shape[0], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), f)), pa.array(size), pa.array(np.arange(len(flat))), pa.array(flat)], names=["fold", "width", "pos", "x"])

    return run


def _scores(ridge: float) -> Callable:
    def run(found):
        import pandas as pd

        width = int(found["width"].iloc[0])
        parts = {}
        for fold, rows in found.groupby("fold"):
            flat = rows.sort_values("pos")["x"].to_numpy()
            targets = (len(flat) - 1 - width * width) // (width + 2)
            ends = np.cumsum([1, width * width, width * targets, targets, targets])
            n, xx, xy, y, yy = np.split(flat, ends[:-1])
            parts[int(fold)] = n[0], xx.reshape(width, width), xy.reshape(width, targets), y, yy
        total = [sum(p[i] for p in parts.values()) for i in range(5)]
        penalty = ridge * np.eye(width)
        penalty[0, 0] = 0  # the intercept is free
        out = []
        for fold, (n, xx, xy, y, yy) in sorted(parts.items()):
            beta = np.linalg.lstsq(total[1] - xx + penalty, total[2] - xy, rcond=None)[0]
            error = yy - 2 * (beta * xy).sum(0) + (beta * (xx @ beta)).sum(0)
            spread = yy - y * y / n
            r2 = np.where(spread > 1e-9 * np.maximum(yy, 1e-300), 1 - error / np.where(spread == 0, 1, spread), np.where(error > 1e-9 * n, 0.0, 1.0))
            out.append((fold, int(n), float(r2.mean())))
        return pd.DataFrame(out, columns=["fold", "rows", "r2"])

    return run


def rct(rows: DataFrame, folds: int = 5, ridge: float = 1.0, seed: int = 42) -> DataFrame:
    """(fold, rows, r2): how well a ridge regression tells targets, such as the letters of a sequence as numbers, from the embedding: the
    mean of R² over the targets, on each fold of a regression on the others. rows: (row_idx, vec, target), all of one width each.

    One pass adds up products by fold. A fold's regression comes from all sums less its own, and its errors from its own, so rows
    are not read again; what meets in one task are sums, as many as the square of the vector's width. Folds are drawn by hash. A target that never
    changes in a fold scores 1 if it is told exactly, else 0. Rows with a null are left out.
    """
    data = rows.dropna(subset=["row_idx", "vec", "target"]).select((number(F.col("row_idx"), seed) % folds).alias("fold"), F.col("vec").cast("array<double>").alias("vec"), F.col("target").cast("array<double>").alias("target"))
    sums = data.mapInArrow(_sums(folds, seed), "fold long, width int, pos long, x double")
    sums = sums.groupBy("fold", "width", "pos").agg(F.sum("x").alias("x"))
    return sums.groupBy(F.lit(0).alias("all")).applyInPandas(_scores(ridge), "fold long, rows long, r2 double")


def tiling_error(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], octaves: int = 1, offsets: int = 1) -> DataFrame:
    """(size, error, error95, sets): by tile size, the mean over sets of the L2 distance from the mean vector of a set's intervals to the
    mean of its tiles' vectors times their weights, and the 95 % error of that mean.

    Sizes go from a tenth of the mean length (rounded) in steps of that to 1.2 times it. All sizes are tiled in one pass; a place that
    several tiles or intervals share is embedded once, and carries who uses it: (set_id, size, weight, times), without a size for the
    intervals themselves. So rows are worked out once, and embed is called once. embed takes (chrom, start, end, uses) and gives
    (uses, vec). rows: (set_id, row_idx, chrom, start, end). Sets without tiles of a size do not count there; a mean length under 10 gives no sizes.
    """
    rows = cut(rows.select("set_id", "row_idx", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    mean = F.rint(F.avg(F.col("end") - F.col("start"))).cast("long")
    step = F.floor(F.col("m") / 10)
    stop = F.rint(F.col("m") * 1.2).cast("long")
    sizes = rows.agg(mean.alias("m")).select(F.when((step > 0) & (stop > step), F.sequence(step, stop - 1, step)).otherwise(F.array().cast("array<bigint>")).alias("sizes"))
    tiles = tile_sizes(rows.crossJoin(F.broadcast(sizes)), "sizes", octaves, offsets)  # one row
    own = rows.withColumn("size", F.lit(None).cast("long")).withColumn("weight", F.lit(1.0))
    place = ["chrom", "start", "end"]
    used = tiles.unionByName(own).filter("set_id IS NOT NULL").groupBy(*place, "set_id", "size").agg(F.sum("weight").alias("weight"), F.count("*").alias("times"))
    places = used.groupBy(*place).agg(F.collect_list(F.struct("set_id", "size", "weight", "times")).alias("uses"))
    # outer, since else the vector would be worked out again to see whether it has any components
    x = embed(places).select("uses", F.posexplode_outer("vec").alias("pos", "x")).filter("x IS NOT NULL")
    x = x.select(F.inline("uses"), "pos", "x").groupBy("set_id", "size", "pos").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("times")).alias("x"))
    whole = F.max(F.when(F.col("size").isNull(), F.col("x"))).over(Window.partitionBy("set_id", "pos"))
    apart = x.withColumn("whole", whole).filter("size IS NOT NULL AND whole IS NOT NULL").groupBy("set_id", "size").agg(F.sqrt(F.sum((F.col("x") - F.col("whole")) ** 2)).alias("d"))
    return apart.groupBy("size").agg(F.avg("d").alias("error"), confidence_95("d").alias("error95"), F.count("*").alias("sets"))
