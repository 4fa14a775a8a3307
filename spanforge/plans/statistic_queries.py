"""Embedding-quality statistics and synthetic data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import embedding_stats as S
from ..operators import synthesis as Y
from . import views
from .core import query


def _r(df, *cols):
    return df.select(*[rounded(c, 6).alias(c) if c in cols else c for c in df.columns])


_FRACTION = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_SOME = "ORDER BY md5(row_idx || '_42'), row_idx LIMIT 10000"


@query(f"""WITH s AS (SELECT * FROM vecs {_SOME}), e AS (SELECT i, min(vec[i]) AS lo, max(vec[i]) AS hi FROM s, (SELECT unnest(range(1, 65)) AS i) GROUP BY i),
t AS (SELECT * FROM s WHERE row_idx % 10 = 0),
u0 AS (SELECT t.row_idx, i, lo + ('0x' || substr(md5(t.row_idx || '_' || (i - 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (hi - lo) AS x FROM t, e), u AS (SELECT row_idx, list(x ORDER BY i) AS vec FROM u0 GROUP BY 1),
dt AS (SELECT t.row_idx, min(list_distance(t.vec, s.vec)) AS d FROM t JOIN s ON s.row_idx <> t.row_idx GROUP BY 1), dr AS (SELECT u.row_idx, min(list_distance(u.vec, s.vec)) AS d FROM u, s GROUP BY 1)
SELECT round((SELECT sum(d) FROM dr) / ((SELECT sum(d) FROM dr) + (SELECT sum(d) FROM dt)), 6) AS ctt, (SELECT count(*) FROM t) AS points""")
def ctt(spark, d):
    return _r(S.ctt(views.vecs(spark, d)), "ctt")


_GDST = """WITH p AS (SELECT greatest(b.start - a."end", a.start - b."end", 0) / 1e6 AS g, list_distance(a.vec, b.vec) AS e FROM vec_iv a JOIN vec_iv b ON a.chrom = b.chrom AND a.row_idx < b.row_idx)
SELECT count(*) AS pairs, round(regr_slope(e, g), 6) AS slope, round(corr(g, e), 6) AS r FROM p"""


@query(_GDST)
def gdst(spark, d):
    return _r(S.gdst_all(views.vec_iv(spark, d)), "slope", "r")


@query(_GDST)
def gdst_all(spark, d):
    return gdst(spark, d)


_NEAR = "row_number() OVER (PARTITION BY q ORDER BY round({0}, 9), f)"


@query(f"""WITH t AS (SELECT * FROM vec_iv), p AS (SELECT a.row_idx AS q, b.row_idx AS f, list_distance(a.vec, b.vec) AS e, sqrt((a.start - b.start)::DOUBLE ** 2 + (a."end" - b."end")::DOUBLE ** 2) AS g FROM t a JOIN t b ON a.row_idx <> b.row_idx WHERE a.row_idx IN (SELECT row_idx FROM t WHERE row_idx % 10 = 0 {_SOME})),
r AS (SELECT *, {_NEAR.format('e')} AS re, {_NEAR.format('g')} AS rg FROM p)
SELECT count(DISTINCT q) AS queries, round(count(*) FILTER (re <= 20 AND rg <= 20) / (count(DISTINCT q) * 20), 6) AS npr FROM r""")
def npt(spark, d):
    return _r(S.npt(views.vec_iv(spark, d), 20), "npr")


def _shared(vecs: str) -> str:
    return f"""(SELECT count(*) FROM (SELECT a.row_idx AS q, b.row_idx AS f, list_distance(a.vec, b.vec) AS e, sqrt((a.start - b.start)::DOUBLE ** 2 + (a."end" - b."end")::DOUBLE ** 2) AS g
FROM {vecs} a JOIN {vecs} b ON a.row_idx <> b.row_idx WHERE a.row_idx IN (SELECT row_idx FROM t WHERE row_idx % 10 = 0 {_SOME}) QUALIFY greatest({_NEAR.format("e")}, {_NEAR.format("g")}) <= 20))"""


@query(f"""WITH t AS (SELECT * FROM vec_iv), z0 AS (SELECT row_idx, i, ('0x' || substr(md5(row_idx || '_' || (i - 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM t, (SELECT unnest(range(1, 65)) AS i)),
z1 AS (SELECT row_idx, list(x ORDER BY i) AS vec FROM z0 GROUP BY 1), z AS (SELECT t.row_idx, t.start, t."end", z1.vec FROM t JOIN z1 USING (row_idx)),
n AS (SELECT count(*) AS queries FROM (SELECT row_idx FROM t WHERE row_idx % 10 = 0 {_SOME})), w AS (SELECT queries, {_shared("t")} / (queries * 20) AS npr, {_shared("z")} / (queries * 20) AS random FROM n)
SELECT queries, round(npr, 6) AS npr, round(random, 6) AS random, round(log10(nullif(npr, 0) / nullif(random, 0)), 6) AS snpr FROM w""")
def npt_baseline(spark, d):
    return _r(S.npt_baseline(views.vec_iv(spark, d), 20), "npr", "random", "snpr")


@query()
def pca_projection(spark, d):
    return S.project(views.vecs(spark, d))


@query("""WITH p AS (SELECT row_idx AS i, chrom, floor(start + ("end" - start) * (k + 0.5) / 8.0::DOUBLE) AS pt FROM iv_sample, (SELECT unnest(range(0, 8)) AS k)),
h AS (SELECT DISTINCT i, row_idx AS j FROM p JOIN iv_sample s ON s.chrom = p.chrom AND i < row_idx AND pt >= s.start AND pt <= s."end")
SELECT count(*) AS pairs, round(count(*) / ((SELECT count(*) * (count(*) - 1) / 2 FROM iv_sample)), 9) AS share FROM h""")
def cct_intersection(spark, d):
    return S.cct_intersection(views.iv_sample(spark, d)).select("pairs", rounded("share", 9).alias("share"))


@query("""WITH f AS (SELECT count(*) AS found FROM vecs a WHERE EXISTS (SELECT 1 FROM vecs b WHERE a.row_idx < b.row_idx AND list_cosine_similarity(a.vec, b.vec) > 0.3))
SELECT found, round(found / (SELECT count(*) * (count(*) - 1) / 2 FROM vecs), 9) AS share FROM f""")
def cct_similarity(spark, d):
    return S.cct_similarity(views.vecs(spark, d), 0.3).select("found", rounded("share", 9).alias("share"))


@query("""WITH r AS (SELECT label::VARCHAR AS set_id, vec, row_number() OVER (PARTITION BY label ORDER BY md5(row_idx::VARCHAR), row_idx) AS p, count(*) OVER (PARTITION BY label) AS n FROM vecs),
q AS (SELECT unnest([1.0, 0.5, 0.2]::DOUBLE[]) AS rate), w0 AS (SELECT set_id, i, avg(vec[i]) AS x FROM r, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), w AS (SELECT set_id, list(x ORDER BY i) AS w FROM w0 GROUP BY 1),
p0 AS (SELECT set_id, rate, i, avg(vec[i]) AS x FROM r JOIN q ON p <= floor(n * rate), (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3), p AS (SELECT set_id, rate, list(x ORDER BY i) AS p FROM p0 GROUP BY 1, 2)
SELECT rate, round(avg(list_distance(p, w)), 6) AS error FROM p JOIN w USING (set_id) GROUP BY 1""")
def subsample_error(spark, d):
    v = views.vecs(spark, d).select(F.col("label").cast("string").alias("set_id"), "row_idx", "vec")
    return _r(S.subsample_error(v, [1.0, 0.5, 0.2]), "error")


@query("""WITH w0 AS (SELECT label, i, avg(vec[i]) AS x FROM vecs, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), w AS (SELECT label, list(x ORDER BY i) AS m FROM w0 GROUP BY 1),
e AS (SELECT v.label, exp(list_cosine_similarity(v.vec, w.m)) AS e FROM vecs v JOIN w USING (label)), p AS (SELECT label, e / sum(e) OVER (PARTITION BY label) AS p FROM e)
SELECT label::VARCHAR AS set_id, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p GROUP BY label""")
def entropy_distance(spark, d):
    v = views.vecs(spark, d).select(F.col("label").cast("string").alias("set_id"), "vec")
    return _r(S.entropy_by_distance(v), "entropy")


@query("""WITH x AS (SELECT label, i, vec[i] AS x FROM vecs, (SELECT unnest(range(1, 65)) AS i)), e AS (SELECT label, i, min(x) AS lo, max(x) AS hi, avg(x) AS m, count(*) AS n, (max(x) - min(x)) / 10 AS w FROM x GROUP BY 1, 2),
d AS (SELECT x.label, x.i, sum((least(floor((x - lo) / w), 9) = least(floor((m - lo) / w), 9))::INT) / (any_value(n) * any_value(w)) AS d FROM x JOIN e ON e.label = x.label AND e.i = x.i WHERE hi > lo GROUP BY 1, 2),
s AS (SELECT label, exp(d - max(d) OVER (PARTITION BY label)) AS e FROM d), p AS (SELECT label, e / sum(e) OVER (PARTITION BY label) AS p FROM s)
SELECT label::VARCHAR AS set_id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) END) / ln(count(*)), 6) AS entropy FROM p GROUP BY label""")
def entropy_components(spark, d):
    v = views.vecs(spark, d).select(F.col("label").cast("string").alias("set_id"), "vec")
    return _r(S.entropy_by_components(v), "entropy")


@query("""WITH v AS (SELECT row_idx AS id, vec FROM vecs), s AS (SELECT a.id // 2 AS pair, b.id AS f, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.vec, b.vec), 9), b.id) AS r FROM v a, v b),
m AS (SELECT a.id // 2 AS pair, list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] + z[2]) / 2) AS vec FROM v a JOIN v b ON b.id = a.id + 1 AND a.id % 2 = 0),
t AS (SELECT m.pair, b.id AS f, row_number() OVER (PARTITION BY m.pair ORDER BY round(list_distance(m.vec, b.vec), 9), b.id) AS r FROM m, v b),
x AS (SELECT DISTINCT pair, f FROM s WHERE r <= 5)
SELECT x.pair, round(count(t.f) / count(*), 6) AS recall FROM x LEFT JOIN (SELECT pair, f FROM t WHERE r <= 10) t ON t.pair = x.pair AND t.f = x.f GROUP BY 1""")
def merge_recall(spark, d):
    return _r(S.merge_recall(views.vecs(spark, d), 5), "recall")


@query()
def rct(spark, d):
    """The first 40 letters of sequences as numbers, told from the vectors of the same number."""
    from ..functions.sequences import letter_numbers

    seq = views.sequences(spark, d).filter(F.length("seq") >= 40)
    letters = seq.select(F.substring("chrom", 4, 20).cast("long").alias("row_idx"), letter_numbers(F.substring("seq", 1, 40)).alias("target"))
    return S.rct(views.vecs(spark, d).join(letters, "row_idx"))


@query("""WITH s AS (SELECT substr(chrom, 4)::BIGINT AS row_idx, seq FROM sequences WHERE length(seq) > 400),
w AS (SELECT row_idx, tick, substr(seq, tick + 1, 50) AS w FROM s, (SELECT unnest([0, 10, 50, 100, 300]) AS tick)),
c AS (SELECT row_idx, tick, list_transform(['A', 'C', 'G', 'T'], lambda x: (length(w) - length(replace(w, x, '')))::DOUBLE) AS v FROM w),
d AS (SELECT a.tick, list_distance(a.v, b.v) AS d FROM c a JOIN c b ON b.row_idx = a.row_idx AND b.tick = 0)
SELECT tick, round(avg(d), 6) AS mean, round(2 * 1.96 * stddev_pop(d) / sqrt(count(*)), 6) AS error FROM d GROUP BY 1""")
def swt(spark, d):
    """Mean L2 of the letter counts of displaced windows to those at the origin, with the 95 % error."""
    from ..functions.sequences import count_acgt
    from ..functions.vectors import l2
    from ..operators.aggregates import confidence_95
    from ..operators.embed import look_up
    from ..operators.transforms import displaced

    seq = views.sequences(spark, d).filter(F.length("seq") > 400)
    base = seq.select(F.substring("chrom", 4, 20).cast("long").alias("row_idx"), "chrom", F.lit(0).cast("long").alias("start"), F.lit(50).cast("long").alias("end"))
    at = look_up(displaced(base, [0, 10, 50, 100, 300], 50), seq, 50).select("row_idx", "tick", count_acgt(F.col("letters")).alias("vec"))
    own = at.filter("tick = 0").select("row_idx", F.col("vec").alias("w"))
    found = at.join(own, "row_idx").withColumn("dist", l2(F.col("vec"), F.col("w"))).groupBy("tick").agg(F.avg("dist").alias("mean"), (2 * confidence_95("dist")).alias("error"))
    return _r(found, "mean", "error")


_SIZES = ", ".join(f"('{c}', {n})" for c, n in sorted((f"chr{c}", round(m * 1e6)) for c, m in zip([*map(str, range(1, 23)), "X", "Y"], Y.MEGABASES, strict=True)))
_SYNTHETIC = f"""WITH z AS (SELECT *, row_number() OVER (ORDER BY chrom) - 1 AS o FROM (VALUES {_SIZES}) t(chrom, size)),
i0 AS (SELECT i, floor({_FRACTION.format("i || '_42'")} * 24) AS o, floor(50 + {_FRACTION.format("i || '_43'")} * 4951)::BIGINT AS n, {_FRACTION.format("i || '_44'")} AS u FROM (SELECT unnest(range(0, N)) AS i)),
iv AS (SELECT i AS row_idx, chrom, floor(u * (size - n + 1))::BIGINT AS start, floor(u * (size - n + 1))::BIGINT + n AS "end" FROM i0 JOIN z ON z.o = i0.o)"""
_LETTERS = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(_SYNTHETIC.replace("N))", "1000))") + " SELECT * FROM iv")
def synthesize(spark, d):
    return Y.intervals(spark, 1000, 50, 5000)


_BLOCKS = _SYNTHETIC.replace("N))", "50))") + f""", b AS (SELECT DISTINCT chrom, unnest(range(start // 1000, ("end" - 1) // 1000 + 1)) AS block FROM iv),
s AS (SELECT chrom, block, substr(array_to_string(list_transform(range(0, 32), lambda i: {_LETTERS.format("chrom || '_' || block || '_' || i || '_42'")}), ''), 1, 1000) AS seq FROM b)"""


@query(_BLOCKS + " SELECT * FROM s")
def synthesize_blocks(spark, d):
    return Y.blocks(Y.intervals(spark, 50, 50, 5000), 1000)


@query(f"""WITH z AS (SELECT chrom, floor(size / 1e6::DOUBLE)::BIGINT AS n FROM (VALUES {_SIZES}) t(chrom, size))
SELECT chrom, substr(array_to_string(list_transform(range(0, (n - 1) // 32 + 1), lambda i: {_LETTERS.format("chrom || '_' || i || '_42'")}), ''), 1, n) AS seq FROM z""")
def random_fasta(spark, d):
    return Y.random_fasta(spark)
