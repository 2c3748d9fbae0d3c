"""Vector search: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.functions.vectors import cosine, rescaled
from loomgrain.runtime import arrow_map
from loomgrain.thresholds import Minima


def centroid_gate(rows: DataFrame, key: str, vector: str, label: str, minimum: float) -> DataFrame:
    """(key, score, passed) of each vector against the mean vector of its label, rescaled to 0..1.

    Means are taken element by element with partial sums; one centroid per label.
    """
    flat = rows.select(label, F.posexplode(vector).alias("pos", "x"))
    means = flat.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))
    score = rescaled(cosine(F.col(vector), F.col("centre")))
    return rows.join(centre, label).select(key, score.alias("score"), (score >= minimum).alias("passed"))


def gate_codes(rows: DataFrame, key: str, scores: dict[str, str], minima: Minima, stage: str) -> DataFrame:
    """failing codes from score columns, by dimension."""
    codes = [F.when(F.col(c) < getattr(minima, dim), F.lit(f"{stage}_{dim}_fail")) for dim, c in scores.items()]
    return rows.select(key, F.array_compact(F.array(*codes)).alias("codes"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, block: int = 4096) -> DataFrame:
    """(query, match, rank, similarity): the ``k`` rows of greatest cosine for each query, itself left out; ties by key.

    Queries come in blocks of ``block`` vectors. A block is a bounded matrix that
    every task holds once; it goes over all rows as one product per batch of rows, and each task
    keeps ``k`` rows of every query. The candidates of a query then meet in one
    ranking: at most ``k`` per task. The pairs themselves are never rows.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-asked.count() // block))
    x = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("x"))
    found = None
    for b in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b)
        got = part.toArrow()  # one block
        names = got.column("q").to_numpy()
        m = np.array(got.column("v").to_pylist(), np.float64).reshape(len(names), -1)
        size = np.linalg.norm(m, axis=1)
        shared = spark.sparkContext.broadcast((names, m / np.where(size > 0, size, 1)[:, None], size > 0))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, m, real = shared.value
            best = np.full((len(names), k), -np.inf)
            ids = np.zeros((len(names), k), names.dtype)
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                i, y = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), np.float64)
                norm = np.linalg.norm(y, axis=1)
                sim = m @ (y / np.where(norm > 0, norm, 1)[:, None]).T
                sim[(names[:, None] == i[None, :]) | ~real[:, None] | ~(norm > 0)[None, :]] = -np.inf
                sim, i = np.hstack([best, sim]), np.hstack([ids, np.broadcast_to(i, sim.shape)])
                order = np.lexsort((i, -sim), axis=1)[:, :k]
                best, ids = np.take_along_axis(sim, order, 1), np.take_along_axis(i, order, 1)
            at = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(names[at[0]]), pa.array(ids[at]), pa.array(best[at])], names=["query", "match", "similarity"])

        one = arrow_map(x, search, f"query {kind}, match {kind}, similarity double")
        found = one if found is None else found.unionByName(one)
    r = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "match"))
    return found.withColumn("rank", r).where(F.col("rank") <= k).select("query", "match", "rank", F.round("similarity", 6).alias("similarity"))
