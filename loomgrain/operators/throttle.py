"""Rate, concurrency and host-ban policies as folds over an ordered log.

They are sequential by nature: the log is grouped by worker or host, and each
group is folded in order of time with state carried over its batches. A log that has one hot
host keeps one task busy with it, in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomgrain.runtime import pandas_map


def _folded(df: DataFrame, key: str, order: list[str], schema: str, start, step) -> DataFrame:
    """Per ``key``, rows in ``order``: ``step(state, row)`` gives an output tuple; state is ``start()`` for a new key."""
    cols = df.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, state = object(), None
        at, names = cols.index(key), [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r[at] != k:
                    k, state = r[at], start()
                out.append(step(state, r))
            yield pd.DataFrame(out, columns=names)

    ordered = df.repartition(key).sortWithinPartitions(key, *order)
    return pandas_map(ordered, fold, schema)


def adaptive_concurrency(log: DataFrame, start: int = 8, low: int = 2, high: int = 32, every: int = 80) -> DataFrame:
    """``log`` (worker, seq, ok): after every ``every`` reports the level falls by 2 under half success in total, rises by 2 over 0.8."""

    def step(s: dict, r) -> tuple:
        s["n"] += 1
        s["ok"] += bool(r.ok)
        if s["n"] % every == 0:
            rate = s["ok"] / s["n"]
            s["level"] = max(low, s["level"] - 2) if rate < 0.5 else min(high, s["level"] + 2) if rate > 0.8 else s["level"]
        return r.worker, r.seq, s["level"]

    return _folded(log.select("worker", "seq", "ok"), "worker", ["seq"], "worker string, seq bigint, level int", lambda: {"n": 0, "ok": 0, "level": start}, step)


def token_bucket(log: DataFrame, rate: float) -> DataFrame:
    """``log`` (worker, seq, t in seconds): the wait of each request under ``rate`` tokens a second, capacity ``rate``."""

    def step(s: dict, r) -> tuple:
        t = max(r.t, s["free"])
        s["tokens"] = rate if s["last"] is None else min(rate, s["tokens"] + (t - s["last"]) * rate)
        s["last"] = t
        wait = t - r.t
        if s["tokens"] < 1:
            more = (1 - s["tokens"]) / rate
            wait += more
            s["tokens"], s["last"] = 1.0, t + more
        s["tokens"] -= 1
        s["free"] = s["last"]
        return r.worker, r.seq, float(wait)

    return _folded(log.select("worker", "seq", "t"), "worker", ["t", "seq"], "worker string, seq bigint, wait double", lambda: {"tokens": rate, "last": None, "free": float("-inf")}, step)


def host_bans(log: DataFrame, failures: int = 15, ban_s: float = 90.0, timeouts: int = 3, rapid_s: float = 45.0) -> DataFrame:
    """``log`` (host, seq, t, outcome of ok / fail / timeout): whether each request met a ban.

    ``failures`` failures since the last expiry ban a host for ``ban_s``;
    ``timeouts`` timeouts without any success ban it for ``rapid_s``. A request to a banned host is not made.
    """

    def step(s: dict, r) -> tuple:
        if r.t < s["until"]:
            return r.host, r.seq, True
        if s["until"] and r.t >= s["until"]:
            s["fails"] = s["timeouts"] = 0
            s["until"] = 0.0
        if r.outcome == "ok":
            s["ok"] += 1
        else:
            s["fails"] += 1
            s["timeouts"] += r.outcome == "timeout"
            if s["fails"] >= failures:
                s["until"] = r.t + ban_s
            elif s["timeouts"] >= timeouts and not s["ok"]:
                s["until"] = r.t + rapid_s
        return r.host, r.seq, False

    return _folded(log.select("host", "seq", "t", "outcome"), "host", ["t", "seq"], "host string, seq bigint, banned boolean", lambda: {"fails": 0, "timeouts": 0, "ok": 0, "until": 0.0}, step)


def cooldown(attempt: int, jitter: float = 1.0) -> float:
    """Seconds to wait after a refusal."""
    return min(60.0, 2.0 ** min(attempt, 5) * jitter)


def stalled(seconds_without_progress: float, limit: float) -> bool:
    """G15."""
    return seconds_without_progress > limit
