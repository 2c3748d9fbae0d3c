"""Distributed order statistics: range-sort, count per partition, prefix-sum.

A table is range-partitioned by (group, order keys) and written with the number
of its partition and the position of each row in it.  Ranks, quantile rows and
boundaries then follow from one small table of counts per (partition, group):
no group has to fit into one task, and ties and hot groups are split as the
range bounds fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.operators.ordering import PID, POS, group_offsets, range_cumulated, range_sorted, with_rank
from loomgrain.runtime import arrow_map, broadcast_if_small, staged

__all__ = ["PID", "POS", "group_offsets", "kth_rows", "neighbours", "range_cumulated", "range_sorted", "run_counts", "run_members", "with_rank"]


def kth_rows(sorted_df: DataFrame, offsets: DataFrame, wanted: DataFrame, group: list[str], k: str) -> DataFrame:
    """The ``k``-th row of each group; ``wanted`` has one row per group with its ``k``.

    The prefix sums locate the partition and the position; only those rows are read.
    """
    at = (
        offsets.join(wanted, group)
        .where((F.col(k) > F.col("__before")) & (F.col(k) <= F.col("__before") + F.col("__n")))
        .select(PID, (F.col("__start") + F.col(k) - F.col("__before") - 1).alias(POS), k)
    )
    return sorted_df.join(at, [PID, POS])


def neighbours(df: DataFrame, order: list[str], key: str, ident: str, name: str) -> DataFrame:
    """(a, b): the ``ident`` values of rows next to each other in ``order`` that have the same ``key``.

    ``order`` starts with ``key`` and ends with ``ident`` (bigint).  The scan runs
    within range partitions; the last row of a partition meets the first of the
    next through two rows per partition, so a key may span any number of them.
    """
    rows = df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.spark_partition_id().alias("p"))
    kind = rows.schema["k"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pid, names = None, 0, ["p", "edge", "k", "a", "b"]
        for x in batches:
            if not x.num_rows:
                continue
            k, i = x.column(0), x.column(1)
            one = lambda v, t: pa.array([v], t)
            pid = x.column(2)[0].as_py()
            edge = last is None
            if edge:
                yield pa.RecordBatch.from_arrays([one(pid, pa.int32()), one(0, pa.int32()), k[:1], i[:1], pa.nulls(1, pa.int64())], names=names)
            elif last[0] == k[0].as_py():
                yield pa.RecordBatch.from_arrays([one(pid, pa.int32()), pa.nulls(1, pa.int32()), k[:1], one(last[1], pa.int64()), i[:1]], names=names)
            same = pc.equal(k[1:], k[:-1])
            a, b, kk = i[:-1].filter(same), i[1:].filter(same), k[1:].filter(same)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), pid, np.int32)), pa.nulls(len(a), pa.int32()), kk, a, b], names=names)
            last = (k[-1].as_py(), i[-1].as_py())
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([1], pa.int32()), pa.array([last[0]], x.schema.field(0).type), pa.array([last[1]], pa.int64()), pa.nulls(1, pa.int64())], names=names)

    found = staged(arrow_map(rows, scan, f"p int, edge int, k {kind}, a bigint, b bigint"), name)
    # two rows per partition, in order of the partitions
    w = W.orderBy("p", "edge")
    edges = found.where(F.col("edge").isNotNull()).select("p", "edge", "k", "a", F.lead("k").over(w).alias("k2"), F.lead("a").over(w).alias("b"))
    across = edges.where((F.col("edge") == 1) & (F.col("k") == F.col("k2"))).select("a", "b")
    return found.where(F.col("edge").isNull()).select("a", "b").unionByName(across)


_RUNS = "pid int, kind string, first_id bigint, item_id bigint, n bigint, key string"


def _scan(members: bool):
    """Arrow scan of sorted partitions.

    Emits per partition: kind 'H' and 'T' (key, first id and size of its first
    and last run), 'h' / 'm' members (of the first run / of later ones; the first
    row of a later run is left out) or, without ``members``, 'r' one row per inner run.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_key = None  # key of the open run
        run_first, run_n, head, pid = 0, 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column(2)[0].as_py()
            keys, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            new = np.empty(len(ids), bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = keys[0].as_py() != run_key
            starts = np.flatnonzero(new)
            if run_key is None:
                run_key, run_first, run_n = keys[0].as_py(), int(ids[0]), 0
                starts = starts[1:]
            # rows before the first start belong to the open run
            cuts = np.append(starts, len(ids))
            firsts = np.concatenate([[run_first], ids[starts]]).astype(np.int64)
            sizes = np.diff(np.concatenate([[0], cuts])).astype(np.int64)
            if members:
                owner = np.repeat(firsts, sizes)
                is_head = np.zeros(len(ids), bool)
                if head is None:
                    is_head[: cuts[0]] = True
                keep = is_head | (owner != ids)
                if keep.any():
                    yield _batch(pid, np.where(is_head[keep], "h", "m"), owner[keep], ids[keep], None, None)
            sizes[0] += run_n
            if len(starts):
                if head is None:
                    head = (run_key, run_first, int(sizes[0]))
                    inner = slice(1, -1)
                else:
                    inner = slice(0, -1)
                if not members and len(firsts[inner]):
                    yield _batch(pid, np.full(len(firsts[inner]), "r"), firsts[inner], None, sizes[inner], None)
                run_key, run_first, run_n = keys[int(starts[-1])].as_py(), int(firsts[-1]), int(sizes[-1])
            else:
                run_n = int(sizes[0])
        if run_key is not None:
            tail = (run_key, run_first, run_n)
            ends = [("H", *head), ("T", *tail)] if head else [("B", *tail)]
            yield _batch(pid, np.array([e[0] for e in ends]), np.array([e[2] for e in ends]), None, np.array([e[3] for e in ends]), [e[1] for e in ends])

    return scan


def _batch(pid, kind, first, item, n, key) -> pa.RecordBatch:
    size = len(kind)
    none = lambda t: pa.nulls(size, t)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(size, pid, np.int32)), pa.array(kind.astype(object), pa.string()), pa.array(first, pa.int64()),
            none(pa.int64()) if item is None else pa.array(item, pa.int64()),
            none(pa.int64()) if n is None else pa.array(n, pa.int64()),
            none(pa.string()) if key is None else pa.array(key, pa.string()),
        ],
        names=["pid", "kind", "first_id", "item_id", "n", "key"],
    )


def _runs(keyed: DataFrame, members: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """(scanned rows, boundary runs with the first id of the record each belongs to)."""
    order = [F.col("key").asc(), F.col("item_id").asc()]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("key", "item_id", F.spark_partition_id().alias("pid"))
    scanned = staged(arrow_map(rows, _scan(members), _RUNS), name)
    # At most two rows per partition: the same key in neighbouring partitions is one record.
    ends = scanned.where(F.col("kind").isin("H", "T", "B"))
    w = W.partitionBy("key")
    ends = ends.withColumn("record", F.min("first_id").over(w)).withColumn("total", F.sum("n").over(w)).drop("key", "item_id")
    return scanned, staged(ends, name + "-ends")


def run_members(keyed: DataFrame, name: str) -> DataFrame:
    """(first_id, item_id) for every row of ``keyed`` (item_id, key) but the first of its key, smallest id first."""
    scanned, ends = _runs(keyed, True, name)
    first_of = broadcast_if_small(ends.select("pid", F.col("first_id").alias("local"), "record").distinct())
    m = scanned.where(F.col("kind").isin("h", "m")).select("pid", F.col("first_id").alias("local"), "item_id")
    m = m.join(first_of, ["pid", "local"], "left")
    return m.select(F.coalesce("record", "local").alias("first_id"), "item_id").where(F.col("first_id") != F.col("item_id"))


def run_counts(keyed: DataFrame, name: str) -> DataFrame:
    """(first_id, n_rows) for every key of ``keyed``."""
    scanned, ends = _runs(keyed, False, name)
    inner = scanned.where(F.col("kind") == "r").select("first_id", F.col("n").alias("n_rows"))
    edge = ends.groupBy("record").agg(F.max("total").alias("n_rows")).select(F.col("record").alias("first_id"), "n_rows")
    return inner.unionByName(edge)
