"""The search benchmark: transform both sides, embed, find neighbours, and compare what they come from with the true overlaps."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import intersects
from . import transforms as T
from .boxes import hits
from .joins import overlap_count
from .lineage import cut


@dataclass(frozen=True)
class Experiment:
    """Neighbours a query, and what is done to the intervals before they are embedded."""

    k: int = 100
    query_swell: float = 1
    query_parts: int = 1
    sample_swell: float = 1
    sample_parts: int = 1
    query_shift: int = 0


#: The named experiments.
EXPERIMENTS = {
    "all-chunk": Experiment(300, query_parts=3, sample_parts=3),
    "all-thirds": Experiment(300, query_swell=3, query_parts=3, sample_swell=3, sample_parts=3),
    "query-chunk": Experiment(100, query_parts=3),
    "query-chunk-highk": Experiment(300, query_parts=3),
    "query-shrink-light": Experiment(90, query_swell=0.9),
    "query-swell": Experiment(200, query_swell=2),
    "query-swell-light": Experiment(110, query_swell=1.1),
    "query-thirds": Experiment(100, query_swell=3, query_parts=3),
    "straight": Experiment(100),
    "straight-highpad": Experiment(100),
    "translate": Experiment(100, query_shift=10),
}

Model = Callable[[Column, Column], Column]


def _side(rows: DataFrame, model: Model, shift: int, swell: float, parts: int) -> DataFrame:
    """(id, base_idx, vec, chrom, start, end): a row a transformed interval, with the coordinates of the one it comes from."""
    new = T.apply(rows.select("row_idx", "chrom", "start", "end"), T.translate(shift), T.swell(swell), T.split(parts), numbered=True)
    new = new.select(F.col("new_idx").alias("id"), "base_idx", model(F.col("start"), F.col("end")).alias("vec"))
    return new.join(rows.select(F.col("row_idx").alias("base_idx"), "chrom", "start", "end"), "base_idx")


def true_pairs(query: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: truth, the pairs of rows that meet, counted by rank and never made. Both sides are (row_idx, chrom, start, end)."""
    return overlap_count(query, sample).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("truth"))


def found_pairs(query: DataFrame, sample: DataFrame, hits: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of `by`: found, the true pairs whose q_row_idx and s_row_idx are among the hits, a few a query, which are joined with the intervals."""
    q, s = (x.select(*[F.col(c).alias(f"{p}{c}") for c in ("row_idx", "chrom", "start", "end")]) for x, p in ((query, "q_"), (sample, "s_")))
    full = (F.col("q_start") < F.col("q_end")) & (F.col("s_start") < F.col("s_end"))
    return hits.select(*by, "q_row_idx", "s_row_idx").distinct().join(q, "q_row_idx").join(s, "s_row_idx").filter(full & intersects("q_", "s_")).groupBy(*by).agg(F.count("*").alias("found"))


def compare(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Each row of found with truth, a row, and recall."""
    return found.crossJoin(F.broadcast(truth)).withColumn("recall", F.col("found") / F.nullif(F.col("truth"), F.lit(0)))


def run(query: DataFrame, sample: DataFrame, model: Model, experiments: dict[str, Experiment]) -> DataFrame:
    """(name, found) of each experiment. Both sides are (row_idx, chrom, start, end); vectors of the model are of few numbers.
    A pair is found if any transformed interval of the one is among the k neighbours of any of the other and the two meet.
    Experiments that are the same are run once, and those of one sample side meet one copy of it. Sides and hits are kept by checkpoints,
    so that no plan holds all of it."""
    query, sample = cut(query), cut(sample)
    runs = list(dict.fromkeys(experiments.values()))
    parts = []
    for side in dict.fromkeys((e.sample_swell, e.sample_parts) for e in runs):
        mine = [(i, e) for i, e in enumerate(runs) if (e.sample_swell, e.sample_parts) == side]
        q = [_side(query, model, e.query_shift, e.query_swell, e.query_parts).withColumn("run", F.lit(i)) for i, e in mine]
        q = cut(functools.reduce(DataFrame.unionByName, q))
        parts.append(cut(hits(q, cut(_side(sample, model, 0, *side)), [e.k for e in runs])))
    found = found_pairs(query, sample, functools.reduce(DataFrame.unionByName, parts), "run")
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(runs.index(e)).alias("run")) for n, e in experiments.items()])).alias("n")
    every = query.sparkSession.range(1).select(names).select("n.*")
    return every.join(found, "run", "left").select("name", F.coalesce("found", F.lit(0).cast("long")).alias("found"))
