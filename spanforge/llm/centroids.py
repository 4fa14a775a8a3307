"""Centroid clustering by sort-means.

Vectors are packed once into blocks of rows that never move again: no round shuffles them. A round orders, for each centroid, the
others by their distance from it; a vector scans them from its previous centroid on and stops at the first that is strictly
further than twice the vector's distance from the previous one, since by the triangle inequality none beyond can be nearer or
tie. Each task sends one row of exact sums a cluster; only centroids (k rows) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unused
from .exchange import expand, squeeze
from .vectors import exact_type, grouped, is_usable, largest, packed, scaled, unpacked

RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _squares(x: np.ndarray, norms: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a centroid: integers, exact in the type they have."""
    centroid = centroid.astype(x.dtype)
    return norms - 2 * (x @ centroid) + centroid @ centroid


class Scan:
    """Nearest centroids, found from previous ones. `evaluated` counts the distances that were worked out."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.near, self.evaluated, self.most = centroids, {}, 0, largest(centroids)

    def order(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The other centroids by distance from `a`, and the squared distances."""
        if a not in self.near:
            apart = ((self.centroids - self.centroids[a]) ** 2).sum(1)
            rest = np.flatnonzero(np.arange(len(apart)) != a)
            rest = rest[np.argsort(apart[rest], kind="stable")]
            self.near[a] = rest, apart[rest]
        return self.near[a]

    def assign(self, x: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row; ties go to the smaller number."""
        x = x.astype(exact_type(max(self.most, largest(x)), x.shape[1]))
        cluster, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
        for a in np.unique(was):
            at = np.flatnonzero(was == a)
            norms = np.einsum("ij,ij->i", x[at], x[at])
            first = _squares(x[at], norms, self.centroids[a])
            self.evaluated += len(at)
            far_first = np.argsort(-first, kind="stable")
            at, norms, first = at[far_first], norms[far_first], first[far_first]
            rows, best, which = x[at], first.copy(), np.full(len(at), a, np.int32)
            for c, apart in zip(*self.order(int(a)), strict=True):
                still = int(np.searchsorted(-4 * first, -apart, side="right"))  # those not strictly closer than half of it
                if not still:
                    break
                found = _squares(rows[:still], norms[:still], self.centroids[c])
                self.evaluated += still
                better = (found < best[:still]) | ((found == best[:still]) & (c < which[:still]))
                best[:still][better], which[:still][better] = found[better], c
            cluster[at], distance[at] = which, best.astype(np.int64)
        return cluster, distance


def _pack(id_col: str, vector_col: str, scale: int, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in grouped(batch, vector_col, scale, dim):
                ids = batch.column(id_col).take(pa.array(rows))
                start = squeeze(np.zeros(len(rows), np.int32))
                yield _rows(ids.type, [(-1, len(rows), None, None, ids, packed(matrix), start, None)])

    return run


def _rows(id_type: pa.DataType, found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary())
    names = ("part", "n", "inertia", "sums", "ids", "body", "cluster", "distance")
    columns = [pa.array([r[i].to_pylist() if isinstance(r[i], pa.Array) else r[i] for r in found], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _round(centroids: np.ndarray) -> Callable:
    """Blocks with their new assignments, then a row of sums for each cluster that the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, sums, kind = Scan(centroids), {}, pa.int64()
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                n, body = batch.column("n")[i].as_py(), batch.column("body")[i].as_py()
                x = unpacked(body, n)
                cluster, distance = scan.assign(x, expand(batch.column("cluster")[i].as_py(), np.int32))
                for c in np.unique(cluster).tolist():
                    mine = cluster == c
                    old = sums.get(c, (0, 0, 0))
                    sums[c] = old[0] + int(mine.sum()), old[1] + int(distance[mine].sum()), old[2] + x[mine].sum(0)
                yield _rows(kind, [(-1, n, None, None, batch.column("ids")[i].values, body, squeeze(cluster), squeeze(distance))])
        if sums:
            yield _rows(kind, [(c, n, inertia, total.tolist(), None, None, None, None) for c, (n, inertia, total) in sums.items()])

    return run


def sort_means(df: DataFrame, k: int, rounds: int, dim: int, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector: its id, cluster, squared distance, the inertia of its cluster and of all, and the sha256 of its
    centroid's components.

    Vectors are usable if they have exactly `dim` components, none null, NaN or infinite; others are left out. A component x counts
    as the integer floor(scale * x), below 2^31 (else an error); everything after that is exact. Centroids start as the vectors
    with the smallest sha256 of seed + id (equal ids by their vectors, null ids last); fewer vectors than k give fewer centroids.
    After each round a centroid is the floor of its vectors' mean; one without vectors stays where it is. Repeated rows are vectors
    of their own. Columns other than the two named are not read. An empty table gives an empty one.
    """
    spark, id_type = df.sparkSession, dict(df.dtypes)[id_col]
    hashed = unused(df, "hash")
    usable = df.select(id_col, vector_col).filter(is_usable(vector_col, dim))
    seeds = usable.withColumn(hashed, F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256))
    first = seeds.orderBy(F.col(hashed).asc_nulls_last(), vector_col).limit(k).select(vector_col).collect()
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, {RESULT}")
    centroids = scaled(np.array([r[0] for r in first], np.float64), scale)
    schema = f"part int, n long, inertia long, sums array<long>, ids array<{id_type}>, body binary, cluster binary, distance binary"
    blocks = usable.mapInArrow(_pack(id_col, vector_col, scale, dim), schema)
    for step in range(rounds + 1):
        blocks = cut(blocks.filter("part < 0").mapInArrow(_round(centroids), schema))
        parts = blocks.filter("part >= 0").groupBy("part")
        if step < rounds:
            total = parts.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dim)]).alias("sums"))
            centroids = centroids.copy()
            for r in total.collect():
                centroids[r["part"]] = [int(s) // r["n"] for s in r["sums"]]
    inertia = {r["part"]: r["inertia"] for r in parts.agg(F.sum("inertia").alias("inertia")).collect()}
    whole = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array([inertia.get(c, 0) for c in range(len(digests))], np.int64)
        names = pa.array(digests)
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, distance = expand(batch.column("cluster")[i].as_py(), np.int32), expand(batch.column("distance")[i].as_py(), np.int64)
                columns = [batch.column("ids")[i].values, pa.array(cluster), pa.array(distance), pa.array(of[cluster]), pa.array(np.full(len(cluster), whole)), names.take(pa.array(cluster))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.filter("part < 0").mapInArrow(run, f"`{id_col}` {id_type}, {RESULT}")


def oracle(k: int, rounds: int, dim: int, scale: int, seed: str) -> str:
    """The same in SQL: a query for each round over a row a component."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, embedding,
  row_number() OVER (ORDER BY sha256('{seed}' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) - 1 AS place
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT row, i, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dim + 1}) AS t(i))",
        f"c0 AS MATERIALIZED (SELECT place AS c, i, x FROM v JOIN kept USING (row) WHERE place < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT row, c, d FROM (SELECT row, c, d, row_number() OVER (PARTITION BY row ORDER BY d, c) AS best
  FROM (SELECT v.row, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{r} AS c USING (i) GROUP BY v.row, c.c)) WHERE best = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{r} AS o LEFT JOIN
  (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (row) GROUP BY c, i)) AS m USING (c, i))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} AS a JOIN kept USING (row) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) AS h ON h.c = a.c"""


ORACLE = oracle(40, 5, 64, 256, "2:")
