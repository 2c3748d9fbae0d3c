"""Positions in a global order without a single-task window.

Rows are range-partitioned and sorted, staged with their partition and position,
and numbered with prefix sums over the partitions' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.runtime import arrow_map, broadcast_if_small, staged

PID, POS = "__pid", "__pos"
_LOW = (1 << 33) - 1


def range_sorted(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, staged with ``__pid`` and ``__pos``.

    ``order`` should end with a unique column: then equal keys can be split
    between partitions and the order is total.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    out = out.withColumn(PID, F.shiftright("__row", 33).cast("int")).withColumn(POS, F.col("__row").bitwiseAND(F.lit(_LOW)))
    return staged(out.drop("__row"), name)


def group_offsets(sorted_df: DataFrame, group: list[str]) -> DataFrame:
    """One row per (partition, group): first position, rows, and rows of the group before it.

    At most (partitions + groups) rows, since groups are contiguous.
    """
    per = sorted_df.groupBy(PID, *group).agg(F.min(POS).alias("__start"), F.count(F.lit(1)).alias("__n"))
    w = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(PID)
    return per.withColumn("__before", F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def with_rank(sorted_df: DataFrame, offsets: DataFrame, group: list[str], rank: str) -> DataFrame:
    """Adds ``rank``, counted from 1 within the group over all partitions."""
    joined = sorted_df.join(offsets, [PID, *group])
    return joined.withColumn(rank, F.col("__before") + F.col(POS) - F.col("__start") + 1).drop("__before", "__start", "__n", PID, POS)


def numbered(df: DataFrame, order: list[Column], column: str, group: list[str] | None = None, name: str = "numbered") -> DataFrame:
    """``df`` with its position in ``order`` from 1, over all rows or within ``group`` (not null).

    ``order`` is a total order; within a group it starts with the group's columns.
    """
    rows = range_sorted(df, order, name)
    offsets = broadcast_if_small(staged(group_offsets(rows, group or []), name + "-offsets"))
    return with_rank(rows, offsets, group or [], column)


def dealt(df: DataFrame, order: list[Column], n: int, column: str = "worker") -> DataFrame:
    """``column`` 0 .. n-1 in turns, in ``order``."""
    return numbered(df, order, column, name="dealt").withColumn(column, F.pmod(F.col(column) - 1, F.lit(n)))


def range_cumulated(df: DataFrame, order: list[Column], group: list[str], value: str, name: str) -> DataFrame:
    """``df`` range-sorted by ``order`` with ``total``: sum of ``value`` over the rows of the group up to this one.

    ``order`` starts with the columns of ``group`` and ends with a unique one.
    Running sums within each partition are taken in the pass that sorts it, then
    prefix sums of the partitions' totals are added; a group may span any number
    of partitions.  ``value`` is a bigint without nulls.
    """
    cols = df.columns
    at = [cols.index(g) for g in group]
    val = cols.index(value)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(val).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(b.num_rows, bool)
            for i in at:
                c = b.column(i)
                new[1:] |= ~pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            key = tuple(b.column(i)[0].as_py() for i in at)
            new[0] = key != last
            cum = np.cumsum(v)
            starts = np.flatnonzero(new)
            base = np.full(b.num_rows, total, np.int64)
            if len(starts):
                run = np.cumsum(new) - 1
                base = np.where(run >= 0, -(cum - v)[starts][np.maximum(run, 0)], total)
            out = cum + base
            last, total = tuple(b.column(i)[-1].as_py() for i in at), int(out[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "__run"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __run bigint"
    rows = arrow_map(df.repartitionByRange(*order).sortWithinPartitions(*order), running, schema)
    rows = staged(rows.withColumn(PID, F.spark_partition_id()), name)
    per = rows.groupBy(PID, *group).agg(F.max("__run").alias("__sum"))
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__sum").over(w.orderBy(PID).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = broadcast_if_small(staged(per.select(PID, *group, before.alias("__before")), name + "-offsets"))
    return rows.join(offsets, [PID, *group]).withColumn("total", F.col("__before") + F.col("__run")).drop(PID, "__before", "__run")
