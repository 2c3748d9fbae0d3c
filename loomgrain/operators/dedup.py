"""Near-duplicate detection over 64-bit perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions.hashes import hamming
from loomgrain.runtime import broadcast_if_small, scratch, staged

BITS = 64
HOT = 2_000  # rows that share a band, beyond which it is split


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _masks(d: int) -> list[tuple[int, list[int]]]:
    """d + 1 disjoint bands of the 64 bits, each with d + 1 parts of the bits outside it, as masks.

    Of two hashes within ``d`` bits at least one band is equal, and with it at least one of its parts.
    """
    cut = lambda bits: [sum(1 << x for x in bits[round(i * len(bits) / (d + 1)) : round((i + 1) * len(bits) / (d + 1))]) for i in range(d + 1)]
    out = []
    for band in cut(list(range(BITS))):
        rest = [x for x in range(BITS) if not band >> x & 1]
        out.append((band, [band | part for part in cut(rest)]))
    return out


def _meeting(left: DataFrame, right: DataFrame, scope: list[str], d: int, hot: int, name: str) -> DataFrame:
    """Rows of ``left`` (scope.., h, x) and ``right`` (scope.., g, y) that agree in a band and lie within ``d`` bits.

    A band that more than ``hot`` rows of ``right`` share is split by its parts:
    no row is left out, and no crowded bucket meets itself as a whole. A pair may come several times.
    """
    masks = _masks(d)
    cut = lambda t, h: t.select("*", F.posexplode(F.array(*[F.col(h).bitwiseAND(F.lit(_signed(m))) for m, _ in masks])).alias("band", "key"))
    a, b = cut(left, "h"), cut(right, "g")
    on = [*scope, "band", "key"]
    crowded = staged(b.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(*on, F.lit(True).alias("hot")), name + "-crowded")
    crowded = broadcast_if_small(crowded)

    def split(t: DataFrame, h: str) -> DataFrame:
        t = t.join(crowded, on, "left")
        parts = F.array(*[F.array(*[F.col(h).bitwiseAND(F.lit(_signed(m))) for m in ms]) for _, ms in masks])
        fine = t.where("hot").select("*", F.posexplode(F.get(parts, F.col("band"))).alias("part", "bits"))
        plain = t.where("hot IS NULL").select("*", F.lit(-1).alias("part"), F.col("key").alias("bits"))
        return plain.unionByName(fine).drop("hot", "key")

    met = split(a, "h").join(split(b, "g"), [*scope, "band", "part", "bits"])
    return met.where(hamming(F.col("h"), F.col("g")) <= d).drop("band", "part", "bits")


def representatives(rows: DataFrame, scope: list[str], order: str, value: str = "hash") -> DataFrame:
    """(scope.., hash, first, n): each distinct hash of a scope once; rows without a hash are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*scope, value).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def near_pairs(reps: DataFrame, scope: list[str], max_distance: int = 3, value: str = "hash", hot: int = HOT, name: str = "near") -> DataFrame:
    """(scope.., a, b, distance) of the pairs of distinct hashes within ``max_distance`` bits, a < b by ``first``.

    Banded equi-join: hashes meet where one of d + 1 bands is equal, and are then
    compared in full. Equal hashes are collapsed before, so copies make no pairs.
    """
    left = reps.select(*scope, F.col(value).alias("h"), F.col("first").alias("a"))
    right = left.withColumnsRenamed({"h": "g", "a": "b"})
    x = _meeting(left, right, scope, max_distance, hot, name).where(F.col("a") < F.col("b"))
    return x.select(*scope, "a", "b", hamming(F.col("h"), F.col("g")).alias("distance")).distinct()


def keep_first(rows: DataFrame, scope: list[str], order: str, max_distance: int = 3, releases: str | None = None, value: str = "hash", name: str = "keep") -> DataFrame:
    """``order`` of every row with ``dup_of``, null for rows that are kept.

    In ``order`` (unique), a row is a duplicate if an earlier row that occupies
    its hash lies within ``max_distance`` in the same scope; a kept row occupies
    its hash unless ``releases`` says that it is rejected later on. A row without
    a hash is kept and occupies nothing.

    Rows are decided in rounds: a row is kept once no earlier neighbour is open or
    occupying, a duplicate once one is occupying. The first open row of a chain is
    always decided, and each round is staged. The result is that of one row after another.
    ``dup_of`` is the first row in order with the matching hash, that hash being the one taken earliest.
    """
    free = F.coalesce(F.col(releases), F.lit(False)) if releases else F.lit(False)
    all_rows = rows.select(*scope, F.col(order).alias("i"), F.col(value).alias("h"), free.alias("free"))
    hashed = staged(all_rows.where(F.col("h").isNotNull()), name + "-rows")
    # Equal hashes: rows that release their place do not block, so the first that does not release decides for the others.
    holder = hashed.where(~F.col("free")).groupBy(*scope, "h").agg(F.min("i").alias("first"))
    nodes = staged(holder.withColumnRenamed("h", value), name + "-nodes")
    pairs = staged(near_pairs(nodes, scope, max_distance, value).select("a", "b"), name + "-pairs")
    # Among holders: greedy over the pairs of distinct hashes, earlier first. Pairs of what is decided are left out, so a round costs what is open.
    open_ = staged(pairs.select(F.col("b").alias("i")).distinct(), name + "-open-0")
    taken_now = staged(nodes.select(F.col("first").alias("i")).join(open_, "i", "left_anti"), name + "-taken-0")
    path, n = scratch(rows.sparkSession, name + "-occupied"), 0
    taken_now.write.parquet(path)
    while open_.limit(1).count():
        n += 1
        gone = staged(pairs.join(broadcast_if_small(taken_now.withColumnRenamed("i", "a")), "a", "left_semi").select(F.col("b").alias("i")).distinct(), f"{name}-gone-{n}")
        decided = broadcast_if_small(gone)
        left = pairs.join(decided.withColumnRenamed("i", "b"), "b", "left_anti").join(decided.withColumnRenamed("i", "a"), "a", "left_anti")
        pairs = staged(left.select("a", "b"), f"{name}-pairs-{n}")
        waiting = staged(pairs.select(F.col("b").alias("i")).distinct(), f"{name}-waiting-{n}")
        taken_now = staged(open_.join(decided, "i", "left_anti").join(broadcast_if_small(waiting), "i", "left_anti"), f"{name}-taken-{n}")
        taken_now.write.mode("append").parquet(path)
        open_ = waiting
    occupied = rows.sparkSession.read.schema(nodes.select(F.col("first").alias("i")).schema).parquet(path)
    # Every row against the occupied hashes that came before it.
    taken = nodes.join(occupied.withColumnRenamed("i", "first"), "first", "left_semi")
    values = hashed.groupBy(*scope, "h").agg(F.min("i").alias("first")).withColumnRenamed("h", value)
    close = near_values(values, taken, scope, max_distance, value)
    found = hashed.join(close, [*scope, "h"]).where(F.col("by") < F.col("i")).groupBy("i").agg(F.min("by").alias("dup_of"))
    return all_rows.select("i").join(found, "i", "left").select(F.col("i").alias(order), "dup_of")


def near_values(values: DataFrame, taken: DataFrame, scope: list[str], max_distance: int, value: str = "hash", hot: int = HOT, name: str = "taken") -> DataFrame:
    """(scope.., h, by): for each distinct value the ``first`` of every taken value within the distance (equal ones too)."""
    left = values.select(*scope, F.col(value).alias("h"))
    right = taken.select(*scope, F.col(value).alias("g"), F.col("first").alias("by"))
    return _meeting(left, right, scope, max_distance, hot, name).select(*scope, "h", "by").distinct()


def cleaned(rows: DataFrame, scope: list[str], order: str, value: str = "hash") -> DataFrame:
    """The first row of each exact hash in its scope; rows without a hash stay. Rows without a scope are a scope of their own."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*scope, value).agg(F.min(order).alias(order))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*scope, value, order)]
    return rows.alias("r").join(first.alias("f"), on, "left_semi").unionByName(rows.where(F.col(value).isNull()))


def stats(decided: DataFrame, *by: str) -> DataFrame:
    """Rows and duplicates per group."""
    return decided.groupBy(*by).agg(F.count(F.lit(1)).alias("total_processed"), F.count("dup_of").alias("duplicates_found"))


def commit_outcome(path: Column, known_path: Column, known_hash: Column, staged_path: Column) -> Column:
    """What moving a staged path into the index amounts to."""
    return (
        F.when(known_hash.isNull() & known_path.isNull() & staged_path.isNull(), "hash_failed")
        .when(known_path == path, "already_committed").when(staged_path.isNotNull(), "migrated")
        .when(known_hash.isNotNull(), "committed_to_existing_bucket").otherwise("committed")
    )


def upserted(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the new rows; of a (scope, path) the new one holds. Reserved paths (``__*``) are left out."""
    new = new.where(~F.col("path").startswith("__"))
    old = index.where(~F.col("path").startswith("__")).join(new.select("scope", "path"), ["scope", "path"], "left_anti")
    return old.unionByName(new.select(*old.columns))
