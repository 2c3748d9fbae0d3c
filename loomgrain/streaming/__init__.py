"""Streaming forms: rounds by count, dedup and bans by state, and event-time monitors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgrain.runtime import grouped

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Rounds(StatefulProcessor):
    """Closes a round each ``size`` outcomes of its key."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "round_id bigint, processed bigint, accepted bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        r, n, ok = self.state.get() if self.state.exists() else (1, 0, 0)
        out = []
        for b in rows:
            for accepted in b.sort_values("seq")["accepted"]:
                n, ok = n + 1, ok + int(accepted)
                if n == self.size:
                    out.append((key[0], r, n, ok, n - ok, round(ok / n, 6)))
                    r, n, ok = r + 1, 0, 0
        self.state.update((r, n, ok))
        yield pd.DataFrame(out, columns=["shard", "round_id", "processed", "accepted", "rejected", "pass_rate"])

    def close(self) -> None:
        pass


ROUND = "shard string, round_id bigint, processed bigint, accepted bigint, rejected bigint, pass_rate double"


def rounds(outcomes: DataFrame, size: int = 1000) -> DataFrame:
    """Closed rounds of a stream of (shard, seq, accepted). One state per shard: a shard's rounds are counted apart."""
    x = outcomes.select("shard", "seq", "accepted")
    return grouped(x, "shard").transformWithStateInPandas(_Rounds(size), ROUND, "append", "None")


class _FirstKeep(StatefulProcessor):
    """Kept hashes of a scope, with the first path of each."""

    def __init__(self, distance: int):
        self.distance = distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "hash bigint", "path string, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        known = {k[0]: v for k, v in self.kept.iterator()}
        for b in rows:
            for r in b.sort_values("seq").itertuples(index=False):
                hits = [v for h, v in known.items() if ((h ^ r.hash) & (1 << 64) - 1).bit_count() <= self.distance]
                if hits:
                    out.append((key[0], r.seq, r.path, min(hits, key=lambda v: v[1])[0]))
                else:
                    known[r.hash] = (r.path, r.seq)
                    self.kept.updateValue((r.hash,), (r.path, r.seq))
                    out.append((key[0], r.seq, r.path, None))
        yield pd.DataFrame(out, columns=["scope", "seq", "path", "dup_of"])

    def close(self) -> None:
        pass


def keep_first(rows: DataFrame, distance: int = 3) -> DataFrame:
    """G1 on a stream of (scope, seq, path, hash): greedy first-keep with the kept hashes of a scope as state; rows without a hash are kept."""
    none = rows.where("hash IS NULL").select("scope", "seq", "path", F.lit(None).cast("string").alias("dup_of"))
    x = rows.where("hash IS NOT NULL").select("scope", "seq", "path", "hash")
    return grouped(x, "scope").transformWithStateInPandas(_FirstKeep(distance), "scope string, seq bigint, path string, dup_of string", "append", "None").unionByName(none)


class _Bans(StatefulProcessor):
    """Failures of a host since its last ban, and the end of the ban."""

    def __init__(self, failures: int, ban_s: float):
        self.failures, self.ban_s = failures, ban_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fails", "n bigint, until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, until = self.state.get() if self.state.exists() else (0, 0.0)
        out = []
        for b in rows:
            for r in b.sort_values("seq").itertuples(index=False):
                out.append((key[0], r.seq, bool(r.t < until)))
                if r.t >= until and not r.ok:
                    n += 1
                    if n >= self.failures:
                        n, until = 0, r.t + self.ban_s
        self.state.update((n, until))
        yield pd.DataFrame(out, columns=["host", "seq", "banned"])

    def close(self) -> None:
        pass


def host_bans(log: DataFrame, failures: int = 15, ban_s: float = 90.0) -> DataFrame:
    """G12 on a stream of (host, seq, t in seconds, ok): a ban ends by the time of the requests, so no timer is kept."""
    return grouped(log.select("host", "seq", "t", "ok"), "host").transformWithStateInPandas(_Bans(failures, ban_s), "host string, seq bigint, banned boolean", "append", "None")


def windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts by event time, with a watermark; ``ts`` may be without a zone."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def matched(tasks: DataFrame, results: DataFrame, wait: str = "30 seconds") -> DataFrame:
    """J3 on streams of tasks and results (job_id, at): results within ``wait`` of their task; tasks left over come with nulls."""
    t = tasks.withColumnRenamed("at", "task_at").withWatermark("task_at", wait)
    r = results.withColumnsRenamed({"at": "result_at", "job_id": "result_job"}).withWatermark("result_at", wait)
    on = F.expr(f"job_id = result_job AND result_at BETWEEN task_at AND task_at + INTERVAL {wait}")
    return t.join(r, on, "left_outer")


def distinct_items(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
