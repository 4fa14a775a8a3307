"""Transforms, predicates, sequence functions and the embedding pipeline."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import sequences as S
from ..functions import vectors as V
from ..functions.columns import rounded
from ..operators import embed as E
from ..operators import transforms as T
from ..sources import bed
from . import views
from .core import query

_IV = ["row_idx", "chrom", "start", "end"]


def _base(spark, d):
    return views.iv_sample(spark, d).select(*_IV)


def _sql(start: str, end: str, extra: str = "") -> str:
    return f'SELECT row_idx AS base_idx, chrom, ({start})::BIGINT AS start, ({end})::BIGINT AS "end" FROM iv_sample {extra}'


def _new(df):
    return df.select("base_idx", "chrom", "start", "end")


_CHUNK = """WITH c AS (SELECT row_idx AS base_idx, chrom, start AS s, "end" AS e, unnest(range(0, "end" - start, {0})) AS o FROM iv_sample)
SELECT base_idx, chrom, s + o AS start, least(s + o + {0}, e) AS "end" FROM c"""


@query(_CHUNK.format(300))
def chunk_max(spark, d):
    return _new(T.apply(_base(spark, d), T.chunk_max(300)))


@query('WITH i AS (SELECT * FROM iv_sample UNION ALL SELECT set_id, -row_idx - 1, chrom, start, start FROM iv_sample WHERE row_idx % 10 = 0), c AS (SELECT row_idx AS base_idx, chrom, start AS s, "end" AS e, unnest(range(0, greatest("end" - start, 1), 300)) AS o FROM i) SELECT base_idx, chrom, s + o AS start, least(s + o + 300, e) AS "end" FROM c')
def chunk_keep(spark, d):
    b = _base(spark, d)
    empty = b.filter("row_idx % 10 = 0").select((-F.col("row_idx") - 1).alias("row_idx"), "chrom", "start", F.col("start").alias("end"))
    return _new(T.apply(b.unionByName(empty), T.chunk_keep(300)))


@query(_sql("start - 5000", '"end" - 5000'))
def translate(spark, d):
    return _new(T.apply(_base(spark, d), T.translate(-5000)))


@query("""WITH z AS (SELECT *, round_even((("end" - start) * 1.1::DOUBLE), 0) AS n FROM iv_sample),
y AS (SELECT *, round_even((start + "end") / 2.0::DOUBLE - n / 2, 0) AS s FROM z) SELECT row_idx AS base_idx, chrom, s::BIGINT AS start, (s + n)::BIGINT AS "end" FROM y""")
def swell(spark, d):
    return _new(T.apply(_base(spark, d), T.swell(1.1)))


_SPLIT = """WITH p AS (SELECT row_idx AS base_idx, chrom, start AS s, "end" AS e, ("end" - start) // 3 AS b, ("end" - start) % 3 AS r, unnest(CASE WHEN "end" - start < 3 THEN [0] ELSE [0, 1, 2] END) AS i FROM iv_sample)
SELECT base_idx, chrom, s + i * b + least(i, CASE WHEN e - s < 3 THEN 0 ELSE r END) AS start,
       CASE WHEN e - s < 3 THEN e ELSE s + (i + 1) * b + least(i + 1, r) END AS "end" FROM p"""


@query(_SPLIT)
def split(spark, d):
    return _new(T.apply(_base(spark, d), T.split(3)))


@query("""WITH p AS (SELECT row_idx AS base_idx, chrom, start AS s, "end" AS e, ("end" - start) / 4.0::DOUBLE * CASE WHEN start % 2 = 1 THEN -1 ELSE 1 END AS st, unnest(range(0, 5)) AS i FROM iv_sample)
SELECT base_idx, chrom, round_even(s + i * st, 0)::BIGINT AS start, round_even(e + i * st, 0)::BIGINT AS "end" FROM p""")
def slide(spark, d):
    return _new(T.apply(_base(spark, d), T.slide(5)))


_TILE = """WITH RECURSIVE f(row_idx, chrom, s, e, t, z) AS (
  SELECT row_idx, chrom, start, "end", NULL::BIGINT, NULL::BIGINT FROM iv_sample
  UNION ALL
  SELECT row_idx, chrom, unnest([s, a + z2]) AS s, unnest([a, e]) AS e, a, z2 FROM (
    SELECT *, round_even(round_even((s + e) / 2.0::DOUBLE / (z2 / 4.0::DOUBLE), 0) * (z2 / 4.0::DOUBLE) - z2 / 2.0::DOUBLE, 0)::BIGINT AS a FROM (
      SELECT row_idx, chrom, s, e, (64 * pow(2, greatest(least(floor(log2((e - s) / 64.0::DOUBLE)), 3), 0)))::BIGINT AS z2 FROM f WHERE e > s))
  WHERE (least(e, a + z2) - greatest(s, a)) * 2 >= z2)
"""


@query(_TILE + 'SELECT DISTINCT row_idx, chrom, t AS start, t + z AS "end" FROM f WHERE t IS NOT NULL')
def tile(spark, d):
    return T.tile(_base(spark, d), 64, 4, 4)


@query(_TILE + """, t AS (SELECT DISTINCT row_idx, chrom, t AS start, t + z AS "end" FROM f WHERE t IS NOT NULL),
w AS (SELECT t.*, least(t."end", b."end") - greatest(t.start, b.start) AS bp FROM t JOIN iv_sample b USING (row_idx))
SELECT row_idx, start, "end", bp, round(bp / sum(bp) OVER (PARTITION BY row_idx), 6) AS weight FROM w""")
def tile_weights(spark, d):
    b = _base(spark, d)
    return T.tile_weights(b, T.tile(b, 64, 4, 4)).select("row_idx", "start", "end", "bp", rounded("weight", 6).alias("weight"))


_TWICE = """WITH c AS (SELECT row_idx AS base_idx, chrom, start AS s, "end" AS e, o // 300 AS k1, o FROM (SELECT *, unnest(range(0, "end" - start, 300)) AS o FROM iv_sample)),
a AS (SELECT base_idx, chrom, k1, s + o AS s, least(s + o + 300, e) AS e FROM c),
p AS (SELECT *, unnest(CASE WHEN e - s < 2 THEN [0] ELSE [0, 1] END) AS i FROM a),
n AS (SELECT base_idx, chrom, k1, i, s + i * ((e - s) // 2) + CASE WHEN e - s < 2 THEN 0 ELSE least(i, (e - s) % 2) END AS start,
       CASE WHEN e - s < 2 THEN e ELSE s + (i + 1) * ((e - s) // 2) + least(i + 1, (e - s) % 2) END AS "end" FROM p) """


@query(_TWICE + 'SELECT base_idx, chrom, start, "end" FROM n')
def compose(spark, d):
    return _new(T.apply(_base(spark, d), T.chunk_max(300), T.split(2)))


@query(_TWICE + 'SELECT row_number() OVER (ORDER BY base_idx, k1, i) - 1 AS new_idx, base_idx, start, "end" FROM n')
def lineage(spark, d):
    return T.apply(_base(spark, d), T.chunk_max(300), T.split(2), numbered=True).select("new_idx", "base_idx", "start", "end")


@query('SELECT row_idx AS base_idx, chrom, start, "end" FROM iv_sample WHERE row_idx < 100')
def length_limit(spark, d):
    return _new(T.apply(_base(spark, d), T.translate(0), limit=100))


@query('SELECT sum(CASE WHEN "end" - start < 3 THEN 1 ELSE 3 END)::BIGINT AS n FROM iv_sample')
def transformed_len(spark, d):
    return T.apply(_base(spark, d), T.split(3)).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT row_idx, start AS s, "end" AS e, unnest(range(0, "end" - start, 300)) AS o FROM iv_sample)
SELECT row_idx, [round(avg(least(300, e - s - o)), 6), round(avg((s + o) % 7), 6)] AS vec FROM c GROUP BY row_idx
UNION ALL SELECT -row_idx - 1, NULL FROM iv_sample WHERE row_idx % 10 = 0""")
def backward_transform(spark, d):
    b = _base(spark, d)
    b = b.unionByName(b.filter("row_idx % 10 = 0").select((-F.col("row_idx") - 1).alias("row_idx"), "chrom", "start", F.col("start").alias("end")))
    new = T.apply(b, T.chunk_max(300)).withColumn("vec", F.array((F.col("end") - F.col("start")).cast("double"), (F.col("start") % 7).cast("double")))
    return T.backward_mean(b, new).select("row_idx", F.transform("vec", lambda x: rounded(x, 6)).alias("vec"))


@query('SELECT row_idx AS base_idx, chrom, start, "end" FROM iv_sample, (VALUES (1), (2), (3)) t(k)')
def multiply(spark, d):
    return _new(T.apply(_base(spark, d), T.repeat(3)))


class Multiply:
    def __init__(self, count: int):
        self.count = count

    def __call__(self, interval):
        return [interval] * self.count


@query('WITH m AS (SELECT row_idx AS base_idx, chrom, start + least(150, "end" - start) * k AS start, CASE k WHEN 0 THEN start + least(150, "end" - start) ELSE "end" END AS "end", k, i FROM iv_sample, (VALUES (0), (1)) t(i), (VALUES (0), (1)) u(k)) SELECT base_idx, chrom, start, "end", [i, k] AS ord FROM m WHERE "end" > start')
def user_transform(spark, d):
    """A class of one's own between built-in transforms, with the lineage of all."""
    halves = T.UserTransform(lambda iv: [x for x in ((iv[0], iv[1], min(iv[1] + 150, iv[2])), (iv[0], min(iv[1] + 150, iv[2]), iv[2])) if x[2] > x[1]])
    return T.apply(_base(spark, d), T.UserTransform(Multiply(2)), halves).select("base_idx", "chrom", "start", "end", "ord")


@query("""SELECT row_idx, t.i AS place, chrom, start, "end" FROM iv_sample, (VALUES (0), (1), (2)) t(i)""")
def user_transform_sql(spark, d):
    """The same class called from SQL."""
    T.UserTransform(Multiply(3)).register(spark, "multiply")
    return spark.sql("SELECT i.row_idx, m.place, m.chrom, m.start, m.`end` FROM {iv} i, LATERAL multiply(i.chrom, i.start, i.`end`) m", iv=views.iv_sample(spark, d))


@query("""SELECT row_idx, chrom, tick, start + tick AS start, start + tick + 50 AS "end" FROM iv_sample, (VALUES (0), (10), (100)) t(tick)""")
def swt_samples(spark, d):
    return T.displaced(_base(spark, d), [0, 10, 100], 50)


@query("SELECT chrom, i AS k, substr(seq, i * 8 + 1, 16) AS piece FROM sequences, (SELECT unnest(range(0, 3)) AS i)")
def slide_sequence(spark, d):
    return views.sequences(spark, d).select("chrom", F.posexplode(S.half_windows(F.col("seq"), 16, 0.5)).alias("k", "piece"))


@query("SELECT row_idx AS base, row_idx * 4 + i AS idx FROM iv_sample, (SELECT unnest(range(0, 4)) AS i)")
def scaled_transform(spark, d):
    return _base(spark, d).select(F.col("row_idx").alias("base"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("base", (F.col("base") * 4 + F.col("i")).alias("idx"))


# predicates on pairs: each query interval next to the sample interval of the same number

_PAIR = """WITH p AS (SELECT q.row_idx, q.chrom AS qc, q.start AS qs, q."end" AS qe, CASE WHEN q.row_idx % 3 = 0 THEN s.chrom ELSE q.chrom END AS sc,
  q.start + (s."end" - s.start) % 900 - 450 AS ss, q.start + (s."end" - s.start) % 900 - 450 + (s."end" - s.start) AS se FROM iv_query q JOIN iv_sample s USING (row_idx)),
o AS (SELECT *, least(qe, se) - greatest(qs, ss) AS ov FROM p) """


def _pairs(spark, d):
    q = views.iv_query(spark, d).select("row_idx", F.col("chrom").alias("q_chrom"), F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    s = views.iv_sample(spark, d).select("row_idx", F.col("chrom").alias("c"), (F.col("end") - F.col("start")).alias("n"))
    start = F.col("q_start") + F.col("n") % 900 - 450
    return q.join(s, "row_idx").select("row_idx", "q_chrom", "q_start", "q_end", F.when(F.col("row_idx") % 3 == 0, F.col("c")).otherwise(F.col("q_chrom")).alias("s_chrom"), start.alias("s_start"), (start + F.col("n")).alias("s_end"))


@query(_PAIR + 'SELECT row_idx, CASE WHEN qc = sc AND ov > 0 THEN qc END AS chrom, CASE WHEN qc = sc AND ov > 0 THEN greatest(qs, ss) END AS start, CASE WHEN qc = sc AND ov > 0 THEN least(qe, se) END AS "end" FROM o')
def intersect(spark, d):
    return _pairs(spark, d).select("row_idx", I.intersection("q_", "s_").alias("i")).select("row_idx", "i.chrom", "i.start", "i.end")


@query(_PAIR + "SELECT row_idx, CASE WHEN qc = sc THEN greatest(ov, 0) ELSE 0 END AS bp FROM o")
def overlap_bp(spark, d):
    return _pairs(spark, d).select("row_idx", I.overlap_bp("q_", "s_").alias("bp"))


@query(_PAIR + "SELECT row_idx, round(CASE WHEN qc = sc AND ov > 0 THEN ov / least(qe - qs, se - ss) ELSE 0 END, 6) AS share FROM o")
def overlap_fraction(spark, d):
    return _pairs(spark, d).select("row_idx", rounded(I.overlap_fraction("q_", "s_"), 6).alias("share"))


@query(_PAIR + "SELECT row_idx, qc = sc AND ov > 0 AS hit FROM o")
def intersects(spark, d):
    return _pairs(spark, d).select("row_idx", I.intersects("q_", "s_").alias("hit"))


@query(_PAIR + "SELECT row_idx, round(CASE WHEN qc = sc THEN greatest(-ov, 0) / 1e6 ELSE 'inf'::DOUBLE END, 6) AS mb FROM o")
def genome_distance(spark, d):
    return _pairs(spark, d).select("row_idx", rounded(I.genome_distance("q_", "s_"), 6).alias("mb"))


@query(_PAIR + "SELECT row_idx, qc = sc AS same FROM o")
def same_chrom(spark, d):
    return _pairs(spark, d).select("row_idx", I.same_chrom("q_", "s_").alias("same"))


@query("""WITH n AS (SELECT row_idx, CASE row_idx % 23 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' WHEN 2 THEN 'chrMT' ELSE chrom END AS c FROM iv_sample)
SELECT row_idx, CASE lower(substr(c, 4)) WHEN 'x' THEN 22 WHEN 'y' THEN 23 WHEN 'mt' THEN 25 ELSE try_cast(substr(c, 4) AS INT) - 1 END AS id FROM n""")
def chrom_id(spark, d):
    k = F.col("row_idx") % 23
    name = F.when(k == 0, "chrX").when(k == 1, "chrY").when(k == 2, "chrMT").otherwise(F.col("chrom"))
    return _base(spark, d).select("row_idx", I.chrom_id(name).alias("id"))


@query('SELECT row_idx, round(log2("end" - start), 6) AS log2_len FROM iv_sample')
def log2_len(spark, d):
    return _base(spark, d).select("row_idx", rounded(I.log2_length(), 6).alias("log2_len"))


# sequences

#: Letters of the longest interval of seq_iv, by its definition.
_LONGEST = 60


@query('SELECT i.row_idx, substr(s.seq, i.start + 1, i."end" - i.start) AS letters FROM seq_iv i JOIN sequences s USING (chrom)')
def seq_lookup(spark, d):
    return E.look_up(views.seq_iv(spark, d), views.sequences(spark, d), _LONGEST).select("row_idx", "letters")


@query("SELECT row_idx, substr(seq, start + 1, \"end\" - start) AS letters FROM (SELECT row_idx, chrom, start // 2 AS start, \"end\" FROM seq_iv) JOIN sequences USING (chrom)")
def seq_lookup_long(spark, d):
    """Intervals over several blocks of 64 letters."""
    iv = views.seq_iv(spark, d).withColumn("start", F.floor(F.col("start") / 2))
    return E.look_up(iv, views.sequences(spark, d), block=64, margin=32).select("row_idx", "letters")


@query("SELECT chrom, [(length(seq) - length(replace(seq, x, '')))::DOUBLE FOR x IN ['A', 'C', 'G', 'T']] AS vec FROM sequences")
def count_acgt(spark, d):
    return views.sequences(spark, d).select("chrom", S.count_acgt(F.col("seq")).alias("vec"))


@query('SELECT row_idx, [("end" - start)::DOUBLE] AS vec FROM iv_sample')
def interval_len_model(spark, d):
    return E.embed(_base(spark, d), None, E.IntervalLength())


@query("SELECT chrom, translate(reverse(upper(seq)), 'ATCG', 'TAGC') AS rc FROM sequences")
def rev_comp_upper(spark, d):
    return views.sequences(spark, d).select("chrom", S.reverse_complement(F.col("seq")).alias("rc"))


@query("WITH l AS (SELECT chrom, replace(seq, 'A', 'a') AS seq FROM sequences) SELECT chrom, translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') AS rc FROM l")
def rev_comp_case(spark, d):
    return views.sequences(spark, d).select("chrom", S.reverse_complement(F.replace("seq", F.lit("A"), F.lit("a")), keep_case=True).alias("rc"))


@query("SELECT chrom, i // 50 AS k, substr(seq, i + 1, 50) AS piece, ceil(length(seq) / 50.0)::BIGINT AS n FROM (SELECT *, unnest(range(0, length(seq), 50)) AS i FROM sequences)")
def chunk_seq(spark, d):
    rows = views.sequences(spark, d).withColumn("n", F.ceil(F.length("seq") / 50))
    return rows.select("chrom", F.posexplode(S.chunks(F.col("seq"), 50)).alias("k", "piece"), "n")


_ACGT = "(length(p) - length(replace(p, '{0}', '')))::DOUBLE"


@query("WITH c AS (SELECT chrom, unnest(range(0, length(seq), 50)) AS i, seq FROM sequences), p AS (SELECT chrom, substr(seq, i + 1, 50) AS p FROM c) SELECT chrom AS idx, [" + ", ".join(f"round(avg({_ACGT.format(x)}), 6)" for x in "ACGT") + "] AS vec FROM p GROUP BY chrom UNION ALL SELECT chrom, NULL FROM sequences WHERE seq = ''")
def dechunk_mean(spark, d):
    s = views.sequences(spark, d).select(F.col("chrom").alias("idx"), "seq")
    return E.dechunk_mean(s, 50, E.CountAcgt()).select("idx", F.transform("vec", lambda x: rounded(x, 6)).alias("vec"))


@query("SELECT chrom, [instr('ACGTN', x) - 1 FOR x IN string_split(seq, '') IF x <> '']::INT[] AS numbers FROM sequences")
def dna_to_float(spark, d):
    return views.sequences(spark, d).select("chrom", S.letter_numbers(F.col("seq")).alias("numbers"))


@query("SELECT chrom, left(lpad(upper(seq), 800, 'N'), 800) AS padded, greatest(800 - length(seq), 0)::BIGINT AS masked FROM sequences")
def upper_tokens(spark, d):
    return views.sequences(spark, d).select("chrom", S.padded(F.col("seq"), 800).alias("padded"), F.greatest(800 - F.length("seq"), F.lit(0)).cast("long").alias("masked"))


@query('WITH p AS (SELECT i.row_idx, substr(s.seq, i.start + o + 1, least(10, i."end" - i.start - o)) AS p FROM (SELECT *, unnest(range(0, "end" - start, 10)) AS o FROM seq_iv) i JOIN sequences s USING (chrom)) SELECT row_idx, [' + ", ".join(f"round(avg({_ACGT.format(x)}), 6)" for x in "ACGT") + "] AS vec FROM p GROUP BY row_idx")
def embed_pipeline(spark, d):
    out = E.embed(views.seq_iv(spark, d), views.sequences(spark, d), E.CountAcgt(10), longest=_LONGEST)
    return out.select("row_idx", F.transform("vec", lambda x: rounded(x, 6)).alias("vec"))


def _count_letters(texts):
    return [[float(t.count(x)) for x in "ACGT"] for t in texts]


@query('WITH p AS (SELECT i.row_idx, substr(s.seq, i.start + o + 1, least(10, i."end" - i.start - o)) AS p FROM (SELECT *, unnest(range(0, "end" - start, 10)) AS o FROM seq_iv) i JOIN sequences s USING (chrom)) SELECT row_idx, [' + ", ".join(f"round(avg({_ACGT.format(x)}), 6)" for x in "ACGT") + "] AS vec FROM p GROUP BY row_idx")
def embed_plugin(spark, d):
    out = E.embed_with(views.seq_iv(spark, d), views.sequences(spark, d), E.FunctionModel(_count_letters, 10, 4), longest=_LONGEST)
    return out.select("row_idx", F.transform("vec", lambda x: rounded(x, 6)).alias("vec"))


def _waves(pos: str) -> str:
    return "[" + ", ".join(f"round({g}({pos} * {math.exp(2 * i * -math.log(3e9) / 32)!r}::DOUBLE), 6)" for i in range(16) for g in ("sin", "cos")) + "]"


def _rounded(vec):
    return F.transform(vec, lambda x: rounded(x, 6))


@query(f"SELECT row_idx, {_waves('start')} AS vec FROM iv_sample")
def sinusoid_pe(spark, d):
    return _base(spark, d).select("row_idx", _rounded(V.sinusoid(F.col("start"))).alias("vec"))


@query(f"""SELECT row_idx, substr(chrom, 4)::INT - 1 AS chrom_id, list_concat({_waves('start')}, {_waves('"end"')}) AS vec FROM iv_sample""")
def locus_encoding(spark, d):
    both = F.concat(V.sinusoid(F.col("start")), V.sinusoid(F.col("end")))
    return _base(spark, d).select("row_idx", I.chrom_id(F.col("chrom")).alias("chrom_id"), _rounded(both).alias("vec"))


@query("""WITH w AS (SELECT i.row_idx, list_transform(['A', 'C', 'G', 'T'], lambda x: (length(substr(s.seq, i.start + 1, i."end" - i.start)) - length(replace(substr(s.seq, i.start + 1, i."end" - i.start), x, '')))::DOUBLE) AS w FROM seq_iv i JOIN sequences s USING (chrom)),
p AS (SELECT i.row_idx, substr(s.seq, i.start + o + 1, least(10, i."end" - i.start - o)) AS p FROM (SELECT *, unnest(range(0, "end" - start, 10)) AS o FROM seq_iv) i JOIN sequences s USING (chrom)),
m AS (SELECT row_idx, [""" + ", ".join(f"avg({_ACGT.format(x)})" for x in "ACGT") + """] AS m FROM p GROUP BY row_idx)
SELECT round(avg(list_distance(w, m)), 6) AS error, count(*) AS n FROM w JOIN m USING (row_idx)""")
def chunk_mean_error(spark, d):
    rows = E.look_up(views.seq_iv(spark, d), views.sequences(spark, d), _LONGEST)
    whole, parts = (E.of_letters(F.col("letters"), model) for model in (E.CountAcgt(), E.CountAcgt(10)))
    return rows.select(V.l2(whole, parts).alias("e")).agg(rounded(F.avg("e"), 6).alias("error"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT i.row_idx, substr(s.seq, i.start + 1, i."end" - i.start) AS l, i."end" - i.start AS n FROM seq_iv i JOIN sequences s USING (chrom)),
w AS (SELECT row_idx, list_transform(['A', 'C', 'G', 'T'], lambda x: (length(l) - length(replace(l, x, '')))::DOUBLE) AS w FROM l),
p AS (SELECT row_idx, CASE WHEN n < 3 THEN l ELSE substr(l, i * (n // 3) + least(i, n % 3) + 1, n // 3 + (i < n % 3)::INT) END AS p FROM (SELECT *, unnest(CASE WHEN n < 3 THEN [0] ELSE [0, 1, 2] END) AS i FROM l)),
m AS (SELECT row_idx, [""" + ", ".join(f"avg({_ACGT.format(x)})" for x in "ACGT") + """] AS m FROM p GROUP BY row_idx)
SELECT round(avg(list_distance(w, m)), 6) AS error, count(*) AS n FROM w JOIN m USING (row_idx)""")
def split_mean_error(spark, d):
    """As chunk_mean_error, of three near-equal parts: the intervals are looked up once, and cut by the transform."""
    rows = E.look_up(views.seq_iv(spark, d), views.sequences(spark, d), _LONGEST)
    at = T.split(3)(F.lit(0).cast("long"), F.col("end") - F.col("start"))
    pieces = F.transform(at, lambda x: F.substring("letters", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    whole, parts = E.of_letters(F.col("letters"), E.CountAcgt()), V.mean_of(F.transform(pieces, lambda x: S.count_acgt(x)))
    return rows.select(V.l2(whole, parts).alias("e")).agg(rounded(F.avg("e"), 6).alias("error"), F.count("*").alias("n"))


_TILE_SIZES = """WITH RECURSIVE iv AS (SELECT row_idx % 5 AS set_id, row_idx, chrom, start, "end" FROM seq_iv), m AS (SELECT round_even(avg("end" - start), 0)::BIGINT AS m FROM iv),
z AS (SELECT unnest(range(m // 10, round_even(m * 1.2::DOUBLE, 0)::BIGINT, m // 10)) AS z FROM m),
f(row_idx, chrom, z, s, e, t) AS (
  SELECT row_idx, chrom, z, start, "end", NULL::BIGINT FROM iv, z
  UNION ALL
  SELECT row_idx, chrom, z, unnest([s, a + z]) AS s, unnest([a, e]) AS e, a FROM (
    SELECT *, round_even(round_even((s + e) / 2.0::DOUBLE / z, 0) * z - z / 2.0::DOUBLE, 0)::BIGINT AS a FROM f WHERE e > s)
  WHERE (least(e, a + z) - greatest(s, a)) * 2 >= z),
t AS (SELECT DISTINCT row_idx, chrom, z, t AS start, t + z AS "end" FROM f WHERE t IS NOT NULL),
w AS (SELECT t.*, iv.set_id, least(t."end", iv."end") - greatest(t.start, iv.start) AS bp FROM t JOIN iv USING (row_idx)),
x AS (SELECT *, bp / sum(bp) OVER (PARTITION BY row_idx, z) AS weight FROM w),
l AS (SELECT x.set_id, x.z, weight, substr(seq, greatest(x.start, 0) + 1, x."end" - greatest(x.start, 0)) AS p FROM x JOIN sequences USING (chrom)),
tv AS (SELECT set_id, z, [""" + ", ".join(f"avg(weight * {_ACGT.format(x)})" for x in "ACGT") + """] AS v FROM l GROUP BY 1, 2),
bl AS (SELECT set_id, substr(seq, start + 1, "end" - start) AS p FROM iv JOIN sequences USING (chrom)),
bv AS (SELECT set_id, [""" + ", ".join(f"avg({_ACGT.format(x)})" for x in "ACGT") + """] AS v FROM bl GROUP BY 1),
dd AS (SELECT z, list_distance(tv.v, bv.v) AS d FROM tv JOIN bv USING (set_id))
SELECT z AS size, round(avg(d), 6) AS error, round(1.96 * stddev_pop(d) / sqrt(count(*)), 6) AS error95, count(*) AS sets FROM dd GROUP BY z"""


@query(_TILE_SIZES)
def tiling_error(spark, d):
    """Letter counts of tiles of a tenth to 1.2 times the mean length, against those of the intervals. A tile's part outside its sequence is cut off."""
    from ..operators.embedding_stats import tiling_error as run

    iv = views.seq_iv(spark, d).select((F.col("row_idx") % 5).alias("set_id"), *_IV)
    embed = lambda rows: E.embed(rows.withColumn("start", F.greatest("start", F.lit(0))), views.sequences(spark, d), E.CountAcgt(), longest=2 * _LONGEST, keys=("uses",), anywhere=True)
    return run(iv, embed).select("size", rounded("error", 6).alias("error"), rounded("error95", 6).alias("error95"), "sets")


@query("""WITH n AS (SELECT row_idx AS base_idx, unnest(range(0, greatest(("end" - start + 499) // 500, 0))) AS k, start, "end" FROM iv_sample)
SELECT i.row_idx, max(least(n."end" - n.start - k * 500, 500))::BIGINT AS value FROM iv_sample i LEFT JOIN n ON n.base_idx = i.row_idx GROUP BY 1""")
def backward_aggregate(spark, d):
    base = _base(spark, d)
    new = T.apply(base, T.chunk_max(500), numbered=True)
    return T.backward(base, new, new.select("new_idx", (F.col("end") - F.col("start")).alias("value")), F.max)


@query("WITH p AS (SELECT chrom, substr(seq, (greatest(length(seq) - 1, 0) // 50) * 50 + 1, 50) AS p, seq FROM sequences) SELECT chrom, CASE WHEN seq <> '' THEN [" + ", ".join(_ACGT.format(x) for x in "ACGT") + "] END AS vec FROM p")
def last_token_pool(spark, d):
    return views.sequences(spark, d).select("chrom", V.last_of(F.transform(S.chunks(F.col("seq"), 50), lambda x: S.count_acgt(x))).alias("vec"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY md5(set_id || '_' || row_idx || '_42'), row_idx) AS n FROM iv_sample)
SELECT set_id, [avg("end" - start)] AS vec FROM o WHERE n <= 64 GROUP BY 1""")
def embed_sampled_sets(spark, d):
    some = bed.shuffled(views.iv_sample(spark, d), 64)
    return V.vector_mean(E.embed(some, None, E.IntervalLength()), ["set_id"])
