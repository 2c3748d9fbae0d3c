"""Consolidating very many small record files into few files of good size (problem 2).

Sorted-run consolidation.  The small files are parsed into runs: files sorted by
(image_path, ts_ms, digest of the record), one per task.  A sparse index of the
runs (the first key of every block of rows) is prefix-summed by bytes, which
cuts the key space into parts of about the wanted size; each part is merged from
its blocks of all runs, k ways, as streams, and written as one file.  Nothing is
sorted again.  Where there are more runs than one merge takes, groups of runs are
merged into longer ones first.  A table of the files' key ranges is written for
each version, and a pointer names the version that holds: a reader never sees
half of a change.
"""
from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.operators.ordering import range_cumulated
from loomgrain.runtime import arrow_map, broadcast_if_small, scratch, staged

TARGET = 128 << 20  # bytes of JSON text in a file
BLOCK_ROWS = 4_096  # rows between two entries of the sparse index
FAN_IN = 256  # runs that one merge reads at a time

RECORD = "image_path string, ts_ms bigint, record string"
ROW = RECORD + ", digest bigint, n_bytes bigint, pos bigint"
_NAMES = ["image_path", "ts_ms", "record"]
_KEY = ("image_path", "ts_ms", "digest")
_AT = ("k0", "k1", "k2", "run", "pos")
_PLACE = (1 << 32) - 1  # of a position: the row in its file; the bits above tell the file
UNIQUE = (None, "record", "key")


def epoch_ms(ts) -> int | None:
    """Epoch milliseconds of a number of seconds, its text, or an ISO time; without a zone it is UTC."""
    if isinstance(ts, bool) or ts is None:
        return None
    try:
        if isinstance(ts, str):
            text = ts.strip()
            try:
                ts = float(text)
            except ValueError:
                at = datetime.fromisoformat(text)
                at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
                days = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
                return (days.days * 86_400 + days.seconds) * 1000 + round(days.microseconds / 1000)
        ms = round(float(ts) * 1000)
        return ms if -(1 << 63) <= ms < 1 << 63 else None
    except (ValueError, OverflowError, TypeError):
        return None


def whole_records(content: str | None) -> Iterator[tuple[str, int, str]]:
    """(image_path, ts_ms, JSON) of every complete record in a file's text, in any layout.

    Objects are decoded one after another wherever one starts; an object that
    does not decode is a fragment, and the search goes on behind its brace.  An
    object without image_path and ts is no record, but what it holds is searched.
    """
    if not content:
        return
    decoder, at = json.JSONDecoder(strict=False), content.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(content, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            todo = [value]
            while todo:
                x = todo.pop()
                if isinstance(x, list):
                    todo += reversed(x)
                elif isinstance(x, dict):
                    path, ms = x.get("image_path"), epoch_ms(x.get("ts"))
                    if isinstance(path, str) and ms is not None:
                        yield path, ms, json.dumps(x, ensure_ascii=False, sort_keys=True)
                    else:
                        todo += reversed([v for v in x.values() if isinstance(v, dict | list)])
        at = content.find("{", end)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # unpaired surrogates of broken escapes cannot be stored as UTF-8
    clean = lambda x: [s.encode("utf-8", "replace").decode() for s in x]
    for b in batches:
        rows = [r for text in b.column(0).to_pylist() for r in whole_records(text)]
        for i in range(0, len(rows), 10_000):
            paths, ms, text = zip(*rows[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(clean(paths)), pa.array(ms, pa.int64()), pa.array(clean(text))], names=_NAMES)


def parsed_records(files: DataFrame) -> DataFrame:
    """(image_path, ts_ms, record): every whole record of ``files`` (column ``content``), repeats included.

    Null, empty and broken files and records without image_path or ts give no rows.
    """
    return arrow_map(files.select(F.col("content").cast("string").alias("content")), _parse, RECORD)


def _without_repeats(unique: str):
    """Drops the rows of a sorted partition that equal the one before."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = (0, 1) if unique == "key" else (0, 1, 2)
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            same = np.ones(b.num_rows, bool)
            for i in cols:
                c = b.column(i)
                same[1:] &= pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            same[0] = tuple(b.column(i)[0].as_py() for i in cols) == last
            last = tuple(b.column(i)[-1].as_py() for i in cols)
            yield b.filter(pa.array(~same))

    return drop


def _sorted_runs(records: DataFrame, path: str, unique: str | None, *extra: str) -> None:
    """Writes each partition of ``records`` as one sorted file; ``pos`` is the place of a row in its file.

    Repeats that are not wanted are dropped here already, so a record that was written very often counts once per run.
    """
    x = records.select(*_NAMES, F.xxhash64("record").alias("digest"), (F.octet_length("record") + 1).cast("bigint").alias("n_bytes"), *extra)
    x = x.sortWithinPartitions(*_KEY, "record")
    if unique:
        x = arrow_map(x, _without_repeats(unique), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema))
    _write(x.withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))), path)


def _write(rows: DataFrame, path: str) -> None:
    # small row groups: a merge reads only those that its part needs
    rows.write.mode("overwrite").option("parquet.block.size", 4 << 20).option("maxRecordsPerFile", 0).parquet(path)


def _blocks(files: DataFrame, *by: str) -> DataFrame:
    """The sparse index of sorted files (``by``, file, pos, key columns): a row per ``BLOCK_ROWS`` rows, with the first key and the last."""
    key = F.struct(*_KEY, "pos")
    per = files.groupBy(*by, "file", F.expr(f"pos div {BLOCK_ROWS}").alias("block"))
    x = per.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.min(key).alias("first"), F.max(key).alias("last"))
    return x.withColumn("first_pos", F.col("first.pos")).drop("block")


def _cut(at, unique: str | None):
    """A bound between parts: where equal records must meet, it does not part them."""
    if not unique:
        return at
    low = lambda kind: F.lit(-1 if kind != "k2" else -(1 << 63)).cast("bigint")
    return F.struct(at["k0"].alias("k0"), at["k1"].alias("k1"), (at["k2"] if unique == "record" else low("k2")).alias("k2"), low("run").alias("run"), low("pos").alias("pos"))


def _planned(blocks: DataFrame, target_bytes: int, unique: str | None, name: str, bounds: DataFrame | None = None) -> DataFrame:
    """(grp, part, lo, hi, sources): which blocks of which files each part is merged from.

    ``blocks``: grp, run, file and those of ``_blocks``.  In the order of their first keys the bytes of a
    group's blocks are summed up; a part begins with the first block behind each multiple of
    ``target_bytes`` and takes the keys from there (``lo``) to the next part's (``hi``), at the ends of a group those of ``bounds``
    (grp, glo, ghi), if given.  A block goes to all parts from that of its first key to that of the
    next block's of its run, or of its last key.  Keys end with run and pos, no two rows have the same: of
    identical records some can be in the next part.
    """
    row = lambda end: [
        "grp", *[F.col(f"{end}.{c}").alias(k) for c, k in zip(_KEY, _AT)], "run", F.col(f"{end}.pos").alias("pos"), "file", "first_pos",
        F.col("n_rows"), (F.col("n_bytes") if end == "first" else F.lit(0).cast("bigint")).alias("n_bytes"), F.lit(int(end == "last")).alias("end"),
    ]
    ends = blocks.groupBy("grp", "run").agg(F.max_by(F.struct("last", "file", "first_pos", "n_rows", "n_bytes"), F.struct("last.image_path", "last.ts_ms", "last.digest", "last.pos")).alias("x")).select("grp", "run", "x.*")
    keys = blocks.select(*row("first")).unionByName(ends.select(*row("last")))
    summed = range_cumulated(keys, [F.col(c).asc() for c in ("grp", *_AT, "end")], ["grp"], "n_bytes", name + "-cumulated")
    summed = summed.withColumn("part", F.expr(f"(total - n_bytes) div {int(target_bytes)}"))
    if unique:  # blocks of one key are all counted to the last part they begin
        same = ["grp", "k0", "k1"] + ["k2"] * (unique == "record")
        moved = summed.groupBy(*same).agg(F.max("part").alias("to"), F.min("part").alias("from")).where(F.col("to") > F.col("from")).drop("from")
        summed = summed.join(broadcast_if_small(staged(moved, name + "-moved")), same, "left").withColumn("part", F.coalesce("to", "part")).drop("to")
    w = W.partitionBy("grp").orderBy("part")
    starts = summed.groupBy("grp", "part").agg(_cut(F.min(F.struct(*_AT)), unique).alias("lo"))
    starts = starts.select("grp", "part", F.when(F.row_number().over(w) > 1, F.col("lo")).alias("lo"), F.lead("lo").over(w).alias("hi"))
    if bounds is not None:
        starts = starts.join(bounds, "grp", "left").select("grp", "part", F.coalesce("lo", "glo").alias("lo"), F.coalesce("hi", "ghi").alias("hi"))
    of_run = W.partitionBy("grp", "run").orderBy(*_AT[:3], "pos", "end")
    spans = summed.withColumn("upto", F.coalesce(F.lead("part").over(of_run), "part")).where(F.col("end") == 0)
    source = F.struct("run", "file", "first_pos", "n_rows")
    gathered = spans.withColumn("p", F.explode(F.sequence("part", "upto"))).groupBy("grp", F.col("p").alias("part")).agg(F.collect_list(source).alias("sources"))
    return staged(starts.join(gathered, ["grp", "part"]), name + "-plan")


def _open(file: str):
    """A Parquet file of the shared folder, for a task that merges."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", file))
    return pq.ParquetFile(path, filesystem=system)


def _stream(sources: list[tuple[str, int, int]], run: int, lo: tuple | None, hi: tuple | None) -> Iterator[tuple]:
    """The rows of one run that belong to a part, in order: (key, record, n_bytes)."""
    spans: dict[str, list[int]] = {}
    for file, first, n in sources:
        s = spans.setdefault(file, [first, first + n])
        s[0], s[1] = min(s[0], first), max(s[1], first + n)
    for file, (start, stop) in sorted(spans.items(), key=lambda x: x[1]):
        start, stop = start & _PLACE, ((stop - 1) & _PLACE) + 1
        parquet = _open(file)
        try:
            groups, at, skip = [], 0, 0
            for g in range(parquet.num_row_groups):
                n = parquet.metadata.row_group(g).num_rows
                if at < stop and at + n > start:
                    skip = at if not groups else skip
                    groups.append(g)
                at += n
            at = skip
            for b in parquet.iter_batches(1_024, row_groups=groups, columns=["image_path", "ts_ms", "digest", "pos", "record", "n_bytes"]):
                if at + b.num_rows > start and at < stop:
                    for path, ms, digest, pos, record, size in zip(*(c.to_pylist() for c in b.columns)):
                        key = (path.encode(), ms, digest, run, pos)  # by bytes, as the engine orders texts
                        if hi is not None and key >= hi:
                            return
                        if lo is None or key >= lo:
                            yield key, record, size
                at += b.num_rows
        finally:
            parquet.close()


def _merging(unique: str | None):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = lambda x: x and (x["k0"].encode(), *(x[c] for c in _AT[1:]))
        for b in batches:
            for row in b.to_pylist():
                runs: dict[int, list] = {}
                for s in row["sources"]:
                    runs.setdefault(s["run"], []).append((s["file"], s["first_pos"], s["n_rows"]))
                lo, hi = bound(row["lo"]), bound(row["hi"])
                merged = heapq.merge(*(_stream(x, run, lo, hi) for run, x in sorted(runs.items())), key=itemgetter(0))
                out, pos, last = [], row["part"] << 32, None
                for key, record, size in merged:
                    if unique:
                        same = key[:2] if unique == "key" else (*key[:2], record)
                        if same == last:
                            continue
                        last = same
                    out.append((key[0].decode(), key[1], record, key[2], size, pos))
                    pos += 1
                    if len(out) == 4_096:
                        yield _rows(row, out)
                        out = []
                if out:
                    yield _rows(row, out)

    return merge


def _rows(row: dict, out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    named = ("image_path", "ts_ms", "record", "digest", "n_bytes", "pos")
    cols = [pa.array([row["grp"]] * len(out), pa.int64()), pa.array([row["part"]] * len(out), pa.int64())]
    return pa.RecordBatch.from_arrays(cols + [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["grp", "part", *named])


def _merge(plan: DataFrame, path: str, unique: str | None) -> None:
    """Merges every part of ``plan`` in a task of its own, which writes it as one file."""
    order = F.row_number().over(W.orderBy("grp", "part")) - 1  # a row per file to be written
    numbered = plan.select("*", order.cast("int").alias("task"))
    tasks = numbered.repartitionById(max(1, plan.count()), F.col("task")).select("grp", "part", "lo", "hi", "sources")
    _write(arrow_map(tasks, _merging(unique), "grp bigint, part bigint, " + ROW), path)


def _files(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """The rows of the Parquet files of ``path``, without the records, and the file of each."""
    schema = ROW + "".join(f", {c} bigint" for c in extra)
    return spark.read.schema(schema).parquet(path).select(*_KEY, "n_bytes", "pos", *extra, F.col("_metadata.file_path").alias("file"))


def _merged(spark: SparkSession, runs: str, path: str, target_bytes: int, unique: str | None, fan_in: int, name: str) -> None:
    """Merges the run files of ``runs`` into part files below ``path``, in as many rounds as ``fan_in`` asks for."""
    blocks = staged(_blocks(_files(spark, runs)), name + "-blocks")
    number = blocks.select("file").distinct().select("file", (F.row_number().over(W.orderBy("file")) - 1).cast("bigint").alias("run"))
    blocks, level = blocks.join(broadcast_if_small(staged(number, name + "-runs")), "file"), 0
    while (blocks.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]) >= fan_in:
        level += 1
        at = scratch(spark, f"{name}-level")
        grouped = blocks.withColumn("grp", F.expr(f"run div {int(fan_in)}"))
        _merge(_planned(grouped, target_bytes, unique, f"{name}-{level}"), at, unique)
        blocks = staged(_blocks(_files(spark, at, "grp"), "grp"), f"{name}-blocks-{level}").withColumnRenamed("grp", "run")
    _merge(_planned(blocks.withColumn("grp", F.lit(0).cast("bigint")), target_bytes, unique, name + "-last"), path, unique)


# ---- tables of versions ---------------------------------------------------------------------------


def _versions(spark: SparkSession, path: str) -> tuple[int, int]:
    """(the version that holds, the last one begun); 0 if there is none. A version holds once its range table has been committed."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/ranges")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0, 0
    begun = [int(s.getPath().getName()[1:]) for s in system.listStatus(folder) if re.fullmatch(r"v\d+", s.getPath().getName())]
    done = [v for v in begun if system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/ranges/v{v}/_SUCCESS"))]
    return max(done, default=0), max(begun, default=0)


RANGES = "part bigint, file string, n_rows bigint, n_bytes bigint, first_path string, first_ts_ms bigint, first_digest bigint, last_path string, last_ts_ms bigint, last_digest bigint"


def _ranges(files: DataFrame) -> DataFrame:
    """Rows of a range table, without their numbers, for the rows of written files."""
    key = F.struct(*_KEY)
    x = files.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.min(key).alias("first"), F.max(key).alias("last"))
    ends = [F.col(f"{e}.{c}").alias(f"{e}_{n}") for e in ("first", "last") for c, n in zip(_KEY, ("path", "ts_ms", "digest"))]
    return x.select("file", "n_rows", "n_bytes", *ends)


def _commit(table: DataFrame, path: str, version: int, unique: str | None) -> DataFrame:
    """Writes the range table of a version; with that the version holds."""
    spark = table.sparkSession
    spark.createDataFrame([(unique,)], "`unique` string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings/v{version}")
    # a row per file
    order = F.row_number().over(W.orderBy("first_path", "first_ts_ms", "first_digest", "last_path", "last_ts_ms", "last_digest", "file")) - 1
    table.select(order.cast("bigint").alias("part"), *[c.split()[0] for c in RANGES.split(", ")[1:]]).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges/v{version}")
    return ranges(spark, path)


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """The range table that holds: part, file, n_rows, n_bytes, and the first and last path, ts_ms and digest of each file."""
    version, _ = _versions(spark, path)
    return spark.read.schema(RANGES).parquet(f"{path}/ranges/v{version}") if version else spark.createDataFrame([], RANGES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, ts_ms, record) of all files that the range table names; those of unfinished or past versions are not read as rows."""
    live = broadcast_if_small(ranges(spark, path).select("file"))
    rows = spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(f"{path}/data")
    return rows.select(*_NAMES, F.col("_metadata.file_path").alias("file")).join(live, "file", "left_semi").drop("file")


def consolidate(files: DataFrame, path: str, target_bytes: int = TARGET, unique: str | None = None, fan_in: int = FAN_IN, name: str = "merged") -> DataFrame:
    """Writes the records of ``files`` (column ``content``) to ``path`` in files of about ``target_bytes`` and returns their range table.

    Every whole record is kept, also one that was written several times.  ``unique``
    = "record" keeps one of those equal in full, "key" one (the least by digest) of those with equal
    image_path and ts.  Null, empty and broken files and records without image_path or ts give no
    rows; no records give an empty table.  Sizes count JSON text before compression and, give or take a block of each run, before repeats are dropped.
    A task that merges reads up to ``fan_in`` runs at a time, a few row groups of each.
    Below ``path`` lie ``data``, ``settings`` and ``ranges``, by versions; what was there before is no longer named by the range table.
    """
    if unique not in UNIQUE:
        raise ValueError(f"unique is one of {UNIQUE}")
    spark = files.sparkSession
    runs, version = scratch(spark, name + "-runs"), max(_versions(spark, path)) + 1
    _sorted_runs(parsed_records(files), runs, unique)
    _merged(spark, runs, f"{path}/data/v{version}", target_bytes, unique, fan_in, name)
    return _commit(_ranges(_files(spark, f"{path}/data/v{version}")), path, version, unique)


def extend(files: DataFrame, path: str, target_bytes: int = TARGET, name: str = "extend") -> DataFrame:
    """Merges the records of new ``files`` into what ``consolidate`` wrote; returns the new range table.

    Repeats are kept or dropped as ``consolidate`` was told.  Records and the first keys of the files
    are put into one order, in which the number of files begun so far tells the file of a
    record; only files that get a record are read, merged and written anew, in several where they
    have grown.  The new files and range table are a version of their own: until it is complete the one before holds, whole.
    """
    spark = files.sparkSession
    now, begun = _versions(spark, path)
    if not now:
        return consolidate(files, path, target_bytes, name=name)
    unique, version = spark.read.parquet(f"{path}/settings/v{now}").first()[0], begun + 1
    table = staged(ranges(spark, path), name + "-ranges")
    new = staged(parsed_records(files).select("*", F.xxhash64("record").alias("k2"), F.monotonically_increasing_id().alias("row")), name + "-new")
    low = F.col("first_digest") if unique != "key" else F.lit(-(1 << 63)).cast("bigint")
    start = table.select(F.col("first_path").alias("image_path"), F.col("first_ts_ms").alias("ts_ms"), F.lit(None).cast("string").alias("record"), low.alias("k2"), F.lit(-1).cast("bigint").alias("row"), "part", F.lit(1).cast("bigint").alias("begun"))
    both = start.unionByName(new.select("*", F.lit(None).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("begun")))
    placed = range_cumulated(both, [F.col(c).asc() for c in ("image_path", "ts_ms", "k2", "row", "part")], [], "begun", name + "-placed")
    placed = placed.where("begun = 0").select(*_NAMES, F.greatest(F.col("total") - 1, F.lit(0)).cast("bigint").alias("grp"))
    runs = scratch(spark, name + "-runs")
    _sorted_runs(placed, runs, unique, "grp")
    blocks = staged(_blocks(_files(spark, runs, "grp"), "grp"), name + "-blocks")
    touched = broadcast_if_small(staged(blocks.select("grp").distinct(), name + "-touched"))
    if not touched.limit(1).count():
        return ranges(spark, path)
    old = table.join(touched, table["part"] == touched["grp"]).select("grp", "file")
    rows = spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(f"{path}/data").select(*_KEY, "n_bytes", "pos", F.col("_metadata.file_path").alias("file"))
    known = _blocks(rows.join(broadcast_if_small(old), "file"), "grp")
    number = blocks.select("grp", "file").distinct().select("grp", "file", F.row_number().over(W.partitionBy("grp").orderBy("file")).cast("bigint").alias("run"))
    blocks = known.withColumn("run", F.lit(0).cast("bigint")).unionByName(blocks.join(number, ["grp", "file"]).select(*known.columns, "run"))
    bound = F.struct(F.col("first_path").alias("k0"), F.col("first_ts_ms").alias("k1"), F.col("first_digest").alias("k2"), F.lit(-1).cast("bigint").alias("run"), F.lit(-1).cast("bigint").alias("pos"))
    edge = table.select("part", _cut(bound, unique).alias("b"))
    w = W.orderBy("part")  # a row per file
    bounds = edge.select(F.col("part").alias("grp"), F.when(F.col("part") > 0, F.col("b")).alias("glo"), F.lead("b").over(w).alias("ghi"))
    _merge(_planned(staged(blocks, name + "-all"), target_bytes, unique, name + "-plan", bounds), f"{path}/data/v{version}", unique)
    written = _ranges(_files(spark, f"{path}/data/v{version}"))
    kept = table.join(touched, table["part"] == touched["grp"], "left_anti").select(*written.columns)
    return _commit(kept.unionByName(written), path, version, unique)


def expire(spark: SparkSession, path: str) -> int:
    """Deletes the files of ``path``/data that the range table no longer names; gives their number. No reader of an older version may be left."""
    files = spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(f"{path}/data").select(F.col("_metadata.file_path").alias("file")).distinct()
    dead = files.join(ranges(spark, path).select("file"), "file", "left_anti")
    jvm, n = spark.sparkContext._jvm, 0
    for (file,) in dead.toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(file)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)
        n += 1
    return n


def found_records(files: DataFrame, name: str = "found") -> DataFrame:
    """(image_path, ts_ms, n_copies): each distinct whole record once, read back from consolidated files that keep repeats."""
    spark = files.sparkSession
    path = scratch(spark, name)
    consolidate(files, path, name=name)
    return records(spark, path).groupBy("image_path", "ts_ms").agg(F.count(F.lit(1)).alias("n_copies"))
