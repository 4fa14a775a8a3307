"""Neighbours, rankings and their evaluation."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.columns import rounded
from ..operators import knn as K
from ..operators import ranking as R
from ..operators import search as X
from . import views
from .core import query


def _r(df, *cols):
    return df.select(*[rounded(c, 6).alias(c) if c in cols else c for c in df.columns])


def _id(df):
    return df.select(F.col("row_idx").alias("id"), "vec")


_KNN = """WITH p AS (SELECT q.row_idx AS query, s.row_idx AS found, list_inner_product(q.vec, s.vec) / sqrt(list_inner_product(s.vec, s.vec)) AS x FROM vecs q, vecs s WHERE q.row_idx % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(x, 9) DESC, found) AS rank FROM p) """


@query(_KNN + "SELECT query, found, round(x, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_ip(spark, d):
    v = views.vecs(spark, d)
    sample = v.select(F.col("row_idx").alias("id"), V.unit(F.col("vec")).alias("vec"))
    return _r(K.knn(_id(v.filter("row_idx % 10 = 0")), sample, 10), "score")


_MODERN = """WITH q AS (SELECT * FROM vec_iv), p AS (SELECT a.row_idx AS query, s.row_idx AS found, list_inner_product(a.vec, s.vec) / sqrt(list_inner_product(s.vec, s.vec)) AS x FROM q a, q s WHERE a.row_idx % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(x, 9) DESC, found) AS rank FROM p),
h AS (SELECT DISTINCT query, found FROM r JOIN q a ON a.row_idx = query JOIN q s ON s.row_idx = found WHERE rank <= 50 AND a.chrom = s.chrom AND a.start < s."end" + 100000 AND s.start - 100000 < a."end") """


def _wide(spark, d):
    v = views.vec_iv(spark, d)
    return v.select(F.col("row_idx").alias("id"), F.col("row_idx").alias("base_idx"), "vec", "chrom", "start", "end")


def _modern(spark, d):
    v = _wide(spark, d)
    sample = v.withColumn("start", F.col("start") - 100000).withColumn("end", F.col("end") + 100000)
    return K.knn_overlap(v.filter("id % 5 = 0"), sample, 50)


@query(_MODERN + "SELECT query AS q_row_idx, found AS s_row_idx FROM h")
def knn_overlap(spark, d):
    return _modern(spark, d).select("q_row_idx", "s_row_idx")


@query(_MODERN + """, t AS (SELECT a.row_idx AS query, s.row_idx AS found FROM q a JOIN q s ON a.row_idx % 5 = 0 AND a.chrom = s.chrom AND a.start < s."end" + 100000 AND s.start - 100000 < a."end")
SELECT count(*) AS truth, count(h.query) AS found, round(count(h.query) / count(*), 6) AS recall FROM t LEFT JOIN h ON h.query = t.query AND h.found = t.found""")
def search_benchmark(spark, d):
    v = _wide(spark, d)
    cols = [F.col("base_idx").alias("row_idx"), "chrom"]
    q, s = v.filter("id % 5 = 0").select(*cols, "start", "end"), v.select(*cols, (F.col("start") - 100000).alias("start"), (F.col("end") + 100000).alias("end"))
    return X.compare(X.true_pairs(q, s), X.found_pairs(q, s, _modern(spark, d))).select("truth", "found", rounded("recall", 6).alias("recall"))


def _experiment_sql(name: str, e: X.Experiment) -> str:
    def side(tag, start, end, shift, swell, parts):
        size = f"round_even((e0 - s0) * {float(swell)!r}::DOUBLE, 0)"
        return f"""{tag}0 AS (SELECT row_idx AS base, chrom, {start} + {shift} AS s0, {end} + {shift} AS e0 FROM vec_iv),
{tag}1 AS (SELECT base, chrom, round_even((s0 + e0) / 2.0::DOUBLE - {size} / 2, 0)::BIGINT AS s1, {size}::BIGINT AS n FROM {tag}0),
{tag}2 AS (SELECT base, chrom, s1, n, unnest(range(0, CASE WHEN n < {parts} THEN 1 ELSE {parts} END)) AS i FROM {tag}1),
{tag}3 AS (SELECT base, i, CASE WHEN n < {parts} THEN s1 ELSE s1 + i * (n // {parts}) + least(i, n % {parts}) END AS s, CASE WHEN n < {parts} THEN s1 + n ELSE s1 + (i + 1) * (n // {parts}) + least(i + 1, n % {parts}) END AS e FROM {tag}2),
{tag} AS (SELECT base, row_number() OVER (ORDER BY base, i) - 1 AS id, [1.0::DOUBLE, s / 1e6::DOUBLE, e / 1e6::DOUBLE, (e - s) / 1e5::DOUBLE] AS vec FROM {tag}3)"""

    wide = "s.start - 100000", 's."end" + 100000'
    return f"""SELECT '{name}' AS name, * FROM (WITH {side("q", "start", '"end"', e.query_shift, e.query_swell, e.query_parts)},
{side("s", "start - 100000", '"end" + 100000', 0, e.sample_swell, e.sample_parts)},
r AS (SELECT q.base AS qb, s.base AS sb, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.vec, s.vec) / sqrt(list_inner_product(s.vec, s.vec)), 9) DESC, s.id) AS rank FROM q, s),
h AS (SELECT DISTINCT qb, sb FROM r WHERE rank <= {e.k}),
t AS (SELECT a.row_idx AS qb, s.row_idx AS sb FROM vec_iv a JOIN vec_iv s ON a.chrom = s.chrom AND a.start < {wide[1]} AND {wide[0]} < a."end")
SELECT count(*) AS truth, count(h.qb) AS found, round(count(h.qb) / nullif(count(*), 0), 6) AS recall FROM t LEFT JOIN h ON h.qb = t.qb AND h.sb = t.sb)"""


@query("SELECT * FROM (" + " UNION ALL ".join(_experiment_sql(n, e) for n, e in X.EXPERIMENTS.items()) + ")")
def search_experiments(spark, d):
    """All named experiments with a model of four numbers an interval."""
    q = views.vec_iv(spark, d).select("row_idx", "chrom", "start", "end")
    s = q.withColumn("start", F.col("start") - 100000).withColumn("end", F.col("end") + 100000)
    model = lambda a, b: F.array(F.lit(1.0), a / 1e6, b / 1e6, (b - a) / 1e5)
    return X.compare(X.true_pairs(q, s), X.run(q, s, model, X.EXPERIMENTS)).select("name", "truth", "found", rounded("recall", 6).alias("recall"))


_MEAN = """WITH m0 AS (SELECT set_id, i, avg(vec[i]) AS x FROM set_vecs, (SELECT unnest(range(1, 65)) AS i) GROUP BY set_id, i), m AS (SELECT set_id, list(x ORDER BY i) AS vec FROM m0 GROUP BY set_id),
k AS (SELECT a.set_id AS base, b.set_id AS other, list_distance(a.vec, b.vec) AS dist FROM m a, m b), rk AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY round(dist, 9), other)::INT AS rank FROM k) """


def _ranked(spark, d):
    return R.rank_all(V.vector_mean(views.set_vecs(spark, d), ["set_id"]))


def _keywords(spark, d):
    part = lambda c, i: F.get(F.split(c, "_"), F.lit(i))
    r = _ranked(spark, d)
    return r.select("base", "other", "rank", part(F.col("base"), 0).alias("cell"), part(F.col("base"), 1).alias("state"), part(F.col("other"), 0).alias("other_cell"), part(F.col("other"), 1).alias("other_state"))


@query(_MEAN + "SELECT base, other, round(dist, 6) AS dist, rank FROM rk")
def rank_l2(spark, d):
    return _r(_ranked(spark, d), "dist")


@query(_MEAN + "SELECT base, list(other ORDER BY rank) AS others, list(round(dist, 6) ORDER BY rank) AS dists FROM rk GROUP BY base")
def all_pairs(spark, d):
    """The ranking of all sets for each set, as one row: names from the nearest on, and how far they are."""
    ranking = F.array_sort(F.collect_list(F.struct("rank", "other", "dist")))
    rows = _r(_ranked(spark, d), "dist").groupBy("base").agg(ranking.alias("r"))
    return rows.select("base", F.transform("r", lambda x: x["other"]).alias("others"), F.transform("r", lambda x: x["dist"]).alias("dists"))


@query(_MEAN + "SELECT other, round(dist, 6) AS dist, rank FROM rk WHERE base = 'cell1_state1'")
def one_to_many(spark, d):
    return _r(R.one_to_many(V.vector_mean(views.set_vecs(spark, d), ["set_id"]), "cell1_state1"), "dist")


@query("SELECT row_idx, round(max(vec[1]) OVER () - vec[1], 6) AS score FROM vecs")
def invert_scores(spark, d):
    return _r(R.invert(views.vecs(spark, d).select("row_idx", F.col("vec")[0].alias("score")), "score"), "score")


@query("SELECT label, row_idx, row_number() OVER (PARTITION BY label ORDER BY round(vec[1], 1) DESC, row_idx DESC) - 1 AS place FROM vecs")
def scores_to_ranks(spark, d):
    v = views.vecs(spark, d).select("label", "row_idx", rounded(F.col("vec")[0], 1).alias("s"))
    return R.scores_to_ranks(v, ["label"], "row_idx", "s").select("label", "row_idx", "place")


@query(_MEAN + """, e AS (SELECT base, 1.0::DOUBLE / rank AS x, unnest(string_split(other, '_')) AS keyword FROM rk), s AS (SELECT base, keyword, sum(x) AS total FROM e GROUP BY 1, 2)
SELECT base, keyword, round(total, 6) AS total, row_number() OVER (PARTITION BY base ORDER BY round(total, 9) DESC, keyword)::INT AS place FROM s""")
def reciprocal_rank(spark, d):
    rows = _keywords(spark, d)
    known = rows.select(F.explode(F.array("cell", "state")).alias("keyword")).distinct().withColumn("ord", F.col("keyword"))
    return _r(R.reciprocal_rank(rows.select("base", "rank", "other_cell", "other_state"), ["other_cell", "other_state"], known), "total").select("base", "keyword", "total", "place")


@query(_MEAN + f""", g AS (SELECT base, rank, (string_split(base, '_')[1] = string_split(other, '_')[1])::INT + (string_split(base, '_')[2] = string_split(other, '_')[2])::INT AS gain FROM rk)
SELECT base, round(sum(gain / log2(rank + 1)) / {R.ideal_gain(10, 5)!r}::DOUBLE, 6) AS ndcg FROM g GROUP BY base""")
def ndcg_keyword(spark, d):
    return _r(R.ndcg(_keywords(spark, d), 10, 5), "ndcg")


def _orders(spark, d):
    sets = V.vector_mean(views.set_vecs(spark, d), ["set_id"])
    return R.rank_all(sets).filter(F.col("base").like("%state0")).select(F.col("base").alias("name"), F.col("other").alias("item"), F.col("rank").alias("place"))


@query(_MEAN + """, o AS (SELECT base AS name, other AS item, rank AS place FROM rk WHERE base LIKE '%state0'), p AS (SELECT x.name, x.item AS i, y.item AS j, sign(x.place - y.place) AS s FROM o x JOIN o y ON x.name = y.name AND x.item < y.item)
SELECT a.name AS a, b.name AS b, round(avg(a.s * b.s), 6) AS tau FROM p a JOIN p b ON a.i = b.i AND a.j = b.j GROUP BY 1, 2""")
def kendall_tau(spark, d):
    return _r(R.kendall_tau(_orders(spark, d)), "tau")


@query(_MEAN + """, x AS (SELECT other AS item, rank FROM rk WHERE base = 'cell1_state0'), y AS (SELECT other AS item, rank FROM rk WHERE base = 'cell2_state0'),
c AS (SELECT item, row_number() OVER (ORDER BY x.rank) AS x, row_number() OVER (ORDER BY y.rank) AS y FROM x JOIN y USING (item)),
r AS (SELECT item, run, x, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN run = 0 THEN y END, CASE WHEN run > 0 THEN md5(item || '_' || run || '_42') END, item) AS y FROM c, (SELECT unnest(range(0, 10000)) AS run)),
t AS (SELECT a.run, avg(sign(b.y - a.y)) AS tau FROM r a JOIN r b ON a.run = b.run AND a.x < b.x GROUP BY 1), o AS (SELECT tau FROM t WHERE run = 0)
SELECT (SELECT count(*) FROM c) AS items, round((SELECT tau FROM o), 6) AS tau, round((1 + count(*) FILTER (run > 0 AND tau >= (SELECT tau FROM o))) / 10000.0::DOUBLE, 6) AS p FROM t""")
def kendall_pvalue(spark, d):
    o = _orders(spark, d)
    pick = lambda n: o.filter(F.col("name") == n).select("item", F.col("place").alias("rank"))
    return _r(R.kendall_pvalue(pick("cell1_state0"), pick("cell2_state0")), "tau", "p")


@query("SELECT a.row_idx AS i, b.row_idx AS j, round(list_distance(a.vec, b.vec), 6) AS dist FROM vecs a JOIN vecs b ON b.row_idx = a.row_idx + 1")
def l2_dist(spark, d):
    v = views.vecs(spark, d)
    b = v.select((F.col("row_idx") - 1).alias("row_idx"), F.col("vec").alias("w"))
    return v.join(b, "row_idx").select(F.col("row_idx").alias("i"), (F.col("row_idx") + 1).alias("j"), rounded(V.l2(F.col("vec"), F.col("w")), 6).alias("dist"))


@query('SELECT set_id, row_idx, chrom, start, "end" FROM iv_sample')
def sort_beds(spark, d):
    return views.iv_sample(spark, d).repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end")


@query("WITH r AS (SELECT set_id, row_idx, row_number() OVER (PARTITION BY set_id ORDER BY row_idx) AS n FROM iv_sample) SELECT set_id, row_idx FROM r WHERE n <= 100")
def top_n_rows(spark, d):
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("row_idx"))
    return views.iv_sample(spark, d).select("set_id", "row_idx", rank.alias("n")).filter("n <= 100").select("set_id", "row_idx")


@query("SELECT max_by('run_' || strftime(ts, '%Y%m%d_%H%M%S'), ts) AS path FROM (SELECT date_trunc('second', max(ts)) AS ts FROM events)")
def latest_checkpoint(spark, d):
    name = F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    paths = spark.read.parquet(f"{d}/events.parquet").select(name.alias("path"))
    return paths.agg(F.max_by("path", F.to_timestamp(F.substring("path", 5, 15), "yyyyMMdd_HHmmss")).alias("path"))


@query("""WITH c AS (SELECT (row_idx * 7919) % 1000003 AS t, vec FROM vecs)
SELECT (row_number() OVER (ORDER BY t) - 1) * 100 AS step, round(vec[1], 6) AS train_loss, round(vec[2], 6) AS eval_loss FROM c""")
def loss_curve(spark, d):
    v = views.vecs(spark, d)
    name = F.date_format(F.timestamp_seconds(1704067200 + (F.col("row_idx") * 7919) % 1000003), R.CHECKPOINT_TIME)
    return _r(R.loss_curve(v.select(name.alias("name"), F.col("vec")[0].alias("train_loss"), F.col("vec")[1].alias("eval_loss"))), "train_loss", "eval_loss")
