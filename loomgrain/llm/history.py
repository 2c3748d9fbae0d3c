"""Checking new batches of images against everything accepted before (problem 3).

The index is stored in the shared folder, a shard for each segment or batch: its new keys (digests, files and
hashes) by bucket, the places of its new hashes by slot, and the links it brought.  A batch reads the buckets of its
keys and the slots its places fall into, and adds a shard; after ``STORED_SHARDS`` of them they are compacted into one.
Keys and places are stored in order, and the tasks that hold the batch's keys and places read their ranges from the files: what is stored is not
shuffled, but for places so crowded that they are split.

Near hashes are found in graph index shards: small-world graphs over distinct 64-bit hashes.  A hash sits on four rings, ordered by the hash rotated by
0, 16, 32 and 48 bits; its links on a ring of n nodes are the neighbours and the nodes
1, 2, 4, ... n/2 places on.  A query is routed greedily along the longest link that does not
pass its place, which takes at most log2(n) hops, and a beam is laid around the
place; the beam is widened for as long as its last node shares the leading 16
bits.  Two hashes that differ in at most 3 bits agree in one of four groups of 16
bits, so on one ring the widened beam holds the neighbour: the search loses none,
as an exhaustive one would find.  What the beam holds is reranked by the exact
distance.  Links of equal offset need no storage: a shard is its sorted hashes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm.components import components
from loomgrain.runtime import broadcast_if_small, grouped, scratch, staged

DISTANCE, RINGS, GROUP = 3, 4, 16
PIECE_ROWS = 40_000  # nodes of a ring that one group of rows is meant to hold
HOT_ROWS = 2_000  # nodes with equal leading 16 bits, beyond which they go on finer rings
MAX_SHARDS = 4  # shards of a piece before they are compacted into one
STORED_SHARDS = 8  # shards of a stored index before they are compacted into one
SLOT_ROWS = 2_000_000  # of a stored index: places in a slot when it is laid out, some 30 MB
RANGE_ROWS = 250_000  # stored places or keys that one group of rows is meant to read
GROUP_BYTES = 1 << 20  # of a row group of stored places or keys, so that a range reads little besides


def digest(c: Column) -> Column:
    """The 40 hex digits a digest is written with, in lower case; null if there are none."""
    return F.nullif(F.regexp_extract(F.lower(c), r"(?:^|[^0-9a-f])([0-9a-f]{40})[^0-9a-f]*$", 1), F.lit(""))


def file_name(c: Column) -> Column:
    """The path without escapes, backslashes, doubled slashes and dots; null for null and blank."""
    slashes = F.replace(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c), F.lit("\\"), F.lit("/"))
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    walked = F.array_join(F.aggregate(F.split(slashes, "/"), F.array().cast("array<string>"), step), "/")
    clean = F.when(F.startswith(slashes, F.lit("/")), F.concat(F.lit("/"), walked)).otherwise(walked)
    odd = c.rlike(r"[%\\]|//|(?:^|/)\.\.?(?:/|$)|/$")
    return F.nullif(F.trim(F.when(odd, clean).otherwise(c)), F.lit(""))


# ---- the graph ------------------------------------------------------------------------------------


def rotated(h: np.ndarray, ring: int) -> np.ndarray:
    """Unsigned hashes rotated so that the ring's 16 bits lead."""
    r = np.uint64(ring * GROUP)
    return (h << r) | (h >> np.uint64(64 - ring * GROUP)) if ring else h


def route(nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Place of each query on the ring: the last node not beyond it, -1 if all are.

    All queries hop together, along ever shorter links.
    """
    at = np.full(len(queries), -1, np.int64)
    hop = 1 << max(len(nodes).bit_length() - 1, 0)
    while hop:
        to = at + hop
        ok = to < len(nodes)
        ok[ok] = nodes[to[ok]] <= queries[ok]
        at[ok] = to[ok]
        hop >>= 1
    return at


def beam(nodes: np.ndarray, queries: np.ndarray, lead: int, width: int | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) places of all pairs within ``distance`` whose first ``lead`` bits agree.

    The beam grows by one node to each side per step, for the queries whose
    outermost node still agrees; ``width`` stops it earlier (to measure recall).
    """
    shift = np.uint64(64 - lead)
    start, key = route(nodes, queries), queries >> shift
    out_q, out_n = [], []
    for side in (-1, 1):
        q = np.arange(len(queries))
        at = start + (side == 1)
        step = 0
        while len(q) and (width is None or step < width):
            ok = (at >= 0) & (at < len(nodes))
            q, at = q[ok], at[ok]
            x = nodes[at]
            ok = (x >> shift) == key[q]
            q, at, x = q[ok], at[ok], x[ok]
            near = np.bitwise_count(x ^ queries[q]) <= distance
            out_q.append(q[near])
            out_n.append(at[near])
            at = at + side
            step += 1
    return np.concatenate(out_q or [np.zeros(0, np.int64)]), np.concatenate(out_n or [np.zeros(0, np.int64)])


def recall(hashes: np.ndarray, queries: np.ndarray, widths: tuple[int | None, ...] = (1, 2, 4, 8, 16, None), distance: int = DISTANCE) -> dict[int | None, float]:
    """Share of the pairs an exhaustive search finds that beams of each width find; None widens as in use.

    A hash that meets itself is no pair.  The exhaustive search is quadratic: for a sample of ``queries``.
    """
    exact = set()
    for k in range(0, len(queries), 64):
        apart = np.bitwise_count(hashes[None, :] ^ queries[k : k + 64, None])
        near = (apart <= distance) & (apart > 0)
        exact |= {(k + int(q), int(n)) for q, n in zip(*np.nonzero(near))}
    out = {}
    for width in widths:
        got = set()
        for ring in range(RINGS):
            x = rotated(hashes, ring)
            order = np.argsort(x, kind="stable")
            q, n = beam(x[order], rotated(queries, ring), GROUP, width, distance)
            n = order[n]
            q, n = q[hashes[n] != queries[q]], n[hashes[n] != queries[q]]
            got |= set(zip(q.tolist(), n.tolist()))
        assert got <= exact
        out[width] = len(got) / len(exact) if exact else 1.0
    return out


def compacted(shards: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One ring of several: sorted runs, merged."""
    h, i = np.concatenate([s[0] for s in shards]), np.concatenate([s[1] for s in shards])
    order = np.argsort(h, kind="stable")
    return h[order], i[order]


class Piece:
    """The part of a ring that one group of rows holds: its shards, oldest first."""

    def __init__(self, lead: int, max_shards: int = MAX_SHARDS):
        self.lead, self.max_shards = lead, max_shards
        self.shards: list[tuple[np.ndarray, np.ndarray]] = []
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        p = self.parent
        while p.get(x, x) != x:
            p[x] = p.get(p[x], p[x])
            x = p[x]
        return x

    def _link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The links that join two parts not yet joined within this piece."""
        kept = []
        for x, y in zip(a.tolist(), b.tolist()):
            r, s = self._root(x), self._root(y)
            if r != s:
                self.parent[max(r, s)] = min(r, s)
                kept.append((x, y))
        return kept

    def arrive(self, h: np.ndarray, ids: np.ndarray, match: bool = True) -> list[tuple[int, int]]:
        """Matches a batch with all shards and with itself, adds it as a new shard, compacts on schedule."""
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        links = []
        if match:
            for nodes, names in self.shards:
                q, n = beam(nodes, h, self.lead)
                links += self._link(ids[q], names[n])
            q, n = beam(h, h, self.lead)
            once = q < n
            links += self._link(ids[q[once]], ids[n[once]])
        self.shards.append((h, ids))
        if len(self.shards) > self.max_shards:
            self.shards = [compacted(self.shards)]
        return links


# ---- on tables ------------------------------------------------------------------------------------


def _placed(nodes: DataFrame, hot_rows: int, piece_rows: int) -> DataFrame:
    """(ring, piece, lead, turn, hash, item_id, batch_no): every node once per ring, with the piece that holds its place.

    A piece is a range of leading bits, of about ``piece_rows`` nodes.  Where more
    than ``hot_rows`` nodes share the leading 16 bits, the other 48 are again split
    into four, and the nodes sit on four finer rings, where 28 leading bits agree
    within the beam: the same guarantee, so a dense place is split and no node left
    out, and the beam stays narrow however many hashes there are.
    """
    n = nodes.count()
    log = lambda x: F.greatest(F.lit(0), F.ceil(F.log2(x / F.lit(float(piece_rows)))))
    bits = max(0, min(GROUP, int(np.ceil(np.log2(n / piece_rows))))) if n > piece_rows else 0
    at = nodes.withColumn("ring", F.explode(F.array(*[F.lit(r) for r in range(RINGS)])))
    at = at.withColumn("lead16", F.expr("cast(shiftrightunsigned(hash, 48 - 16 * ring) & 65535 as bigint)"))
    # at most 4 x 65,536 rows
    dense = at.groupBy("ring", "lead16").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    dense = staged(dense.select("ring", "lead16", F.least(F.lit(12), log(F.col("n"))).cast("int").alias("fine")), "dense-places")
    at = at.join(broadcast_if_small(dense, 4 << GROUP), ["ring", "lead16"], "left")
    fine = _finer(at.where(F.col("fine").isNotNull()))
    plain = at.where(F.col("fine").isNull()).select("ring", F.shiftright("lead16", GROUP - bits).alias("piece"), F.lit(16).alias("lead"), F.lit(0).alias("turn"), "hash", "item_id", "batch_no")
    return plain.unionByName(fine)


def _finer(at: DataFrame) -> DataFrame:
    """Nodes of crowded places, once per finer ring, with the piece that holds them; ``fine``: the bits a place is cut by."""
    fine = at.withColumn("turn", F.explode(F.array(*[F.lit(r) for r in range(4)])))
    # the 48 bits behind the leading 16, as the ring is turned, and the 12 of them that lead on the finer ring
    fine = fine.withColumn("rest", F.expr("(case when ring = 0 then hash else (shiftleft(hash, 16 * ring) | shiftrightunsigned(hash, 64 - 16 * ring)) end) & 281474976710655L"))
    sub = F.expr("shiftrightunsigned(shiftrightunsigned(rest, 36 - 12 * turn) & 4095L, 12 - fine)")
    return fine.select("ring", (F.lit(1 << 40) + F.col("lead16") * 4096 + sub).alias("piece"), F.lit(28).alias("lead"), "turn", "hash", "item_id", "batch_no")


def _ring_order(h: np.ndarray, ring: int, lead: int, turn: int) -> np.ndarray:
    """Hashes permuted so that the bits a piece agrees in lead; distances are those of the hashes."""
    x = rotated(h, ring)
    if lead == 16 or not turn:
        return x
    low, mask = x & np.uint64((1 << 48) - 1), np.uint64((1 << 48) - 1)
    t = np.uint64(12 * turn)
    low = ((low << t) | (low >> np.uint64(48 - 12 * turn))) & mask
    return (x & ~mask) | low


def _search(settled: int | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One piece: its batches arrive in order; yields the links found."""
        t = pa.Table.from_batches(list(batches))
        ring, lead, turn = (t.column(c)[0].as_py() for c in ("ring", "lead", "turn"))
        h = _ring_order(t.column("hash").to_numpy().view(np.uint64), ring, lead, turn)
        ids, no = t.column("item_id").to_numpy(), t.column("batch_no").to_numpy()
        piece, links = Piece(lead), []
        for b in np.unique(no):
            links += piece.arrive(h[no == b], ids[no == b], match=settled is None or b > settled)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return search


def near_links(nodes: DataFrame, hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS, settled: int | None = None) -> DataFrame:
    """(a, b): links between ``nodes`` (hash, item_id, batch_no) that differ in at most 3 bits.

    Of the links found within a piece, those are kept that join parts not joined
    there yet: the components are those of all links, without all pairs of a dense
    place.  Batches up to ``settled`` are only loaded as shards: they are searched by later
    ones and not compared with each other again.
    """
    placed = _placed(nodes, hot_rows, piece_rows)
    return grouped(placed, "ring", "piece", "turn").applyInArrow(_search(settled), "a bigint, b bigint").distinct()


def rows_of(items: DataFrame, hashes: DataFrame) -> DataFrame:
    """(item_id, batch_no, digest, file, hash) of all items; an item with several hashes has a row for each."""
    x = items.where(F.col("item_id").isNotNull()).select(
        "item_id", "batch_no", digest(F.col("content_sha1")).alias("digest"),
        F.when(F.col("shard").isNotNull(), F.concat("shard", F.lit("\u0000"), file_name(F.col("image_path")))).alias("file"),
    )
    return x.join(hashes.where(F.col("item_id").isNotNull()).select("item_id", "hash"), "item_id", "left")


def _keys(rows: DataFrame) -> DataFrame:
    """(item_id, key): digest, file and hash of each row, those that are there."""
    keys = F.array(F.concat(F.lit("d"), F.base64(F.unhex("digest"))), F.concat(F.lit("f"), "file"), F.concat(F.lit("h"), F.col("hash").cast("string")))
    return rows.select("item_id", F.explode(keys).alias("key")).where(F.col("key").isNotNull())


# ---- the stored index -----------------------------------------------------------------------------

_PARTS = {"keys": "key string, item_id bigint, n bigint, h bigint, shard string, bucket int", "places": "hash bigint, item_id bigint, ring int, lead16 bigint, shard string, slot int", "links": "a bigint, b bigint", "labels": "item_id bigint, image bigint"}


@dataclass
class State:
    """What an index holds: its shards, and the leading bits of a place that make its slot (and of a key its bucket)."""

    begun: int = 0
    shards: list[str] = field(default_factory=list)
    labelled: list[str] = field(default_factory=list)  # those of the shards that have labels
    bits: int | None = None


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _held(spark: SparkSession, path: str) -> State:
    """The state that holds: the last one whose file is there in full."""
    folder, system = _folder(spark, f"{path}/state")
    if not system.exists(folder):
        return State()
    last = max((int(x.getPath().getName()[1:]) for x in system.listStatus(folder) if x.getPath().getName().startswith("v")), default=0)
    if not last:
        return State()
    stream = system.open(_folder(spark, f"{path}/state/v{last}")[0])
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return State(**json.loads(text))


def _hold(spark: SparkSession, path: str, state: State) -> None:
    """Makes ``state`` the one that holds: its file is written under another name and then renamed."""
    draft, system = _folder(spark, f"{path}/state/draft-{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    stream.write(bytearray(json.dumps(state.__dict__).encode()))
    stream.close()
    if not system.rename(draft, _folder(spark, f"{path}/state/v{state.begun}")[0]):
        raise RuntimeError(f"another batch was added to {path} at the same time")


def _part(spark: SparkSession, path: str, part: str, shards: list[str]) -> DataFrame:
    """A part of the given shards as one table."""
    if not shards:
        return spark.createDataFrame([], _PARTS[part])
    read = spark.read.schema(_PARTS[part]).option("basePath", f"{path}/{part}")
    return read.parquet(*[f"{path}/{part}/shard={x}" for x in shards])


def _write_keys(keys: DataFrame, path: str, shard: str) -> None:
    x = keys.select("key", "item_id", "n", "h", "bucket").repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h")
    x.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(f"{path}/keys/shard={shard}")


def _write_places(places: DataFrame, path: str, shard: str) -> None:
    # by ranges, so that a crowded slot is no single task's
    x = places.select("hash", "item_id", "ring", "lead16", "slot").repartitionByRange("slot", "lead16", "hash").sortWithinPartitions("slot", "lead16", "hash")
    x.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("slot").parquet(f"{path}/places/shard={shard}")


def _write(rows: DataFrame, path: str, part: str, shard: str) -> DataFrame:
    """Writes links or labels of a shard and reads them back."""
    rows.write.mode("overwrite").parquet(f"{path}/{part}/shard={shard}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{part}/shard={shard}")


def _bits(n: int) -> int:
    """Leading bits by which ``n`` places of a ring are cut into slots."""
    return max(0, min(GROUP, int(np.ceil(np.log2(max(1, n / SLOT_ROWS))))))


def _bucketed(keys: DataFrame, bits: int) -> DataFrame:
    return keys.withColumn("h", F.xxhash64("key")).withColumn("bucket", F.pmod("h", F.lit(1 << bits)).cast("int"))


def old_places(spark: SparkSession, path: str, shards: list[str], places: DataFrame) -> DataFrame:
    """The stored places in the slots that ``places`` (ring, lead16, slot) fall into; other slots are not read."""
    slots = [r[0] for r in places.select("slot").distinct().collect()]  # as many as there are slots at most
    return _part(spark, path, "places", shards).where(F.col("slot").isin(slots))


def _slots(nodes: DataFrame, bits: int) -> DataFrame:
    """Every node on each ring, with its place and slot."""
    x = nodes.withColumn("ring", F.explode(F.array(*[F.lit(r) for r in range(RINGS)])))
    x = x.withColumn("lead16", F.expr("cast(shiftrightunsigned(hash, 48 - 16 * ring) & 65535 as bigint)"))
    return x.withColumn("slot", (F.col("ring") * (1 << bits) + F.shiftright("lead16", GROUP - bits)).cast("int"))


def _files(spark: SparkSession, path: str, part: str, shards: list[str]) -> dict[int, list[str]]:
    """The files of each slot or bucket."""
    out: dict[int, list[str]] = {}
    for x in shards:
        folder, system = _folder(spark, f"{path}/{part}/shard={x}")
        found = system.listFiles(folder, True)
        while found.hasNext():
            at = found.next().getPath()
            if at.getName().endswith(".parquet") and "=" in (place := at.getParent().getName()):
                out.setdefault(int(place.partition("=")[2]), []).append(re.sub("^file:/+", "file:///", at.toString()))
    return out


def _stored(files: list[str], column: str, lo: int, hi: int, columns: list[str]) -> Iterator[pa.Table]:
    """The rows of each file with ``column``, by which they are sorted, from ``lo`` to ``hi``; other row groups are not read."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    for f in files:
        system, at = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", f))
        with pq.ParquetFile(at, filesystem=system) as file:
            k = file.schema_arrow.get_field_index(column)
            kept = []
            for g in range(file.num_row_groups):
                x = file.metadata.row_group(g).column(k).statistics
                if x is None or not x.has_min_max or x.min <= hi and x.max >= lo:
                    kept.append(g)
            if kept:
                t = file.read_row_groups(kept, columns=columns)
                yield t.filter(pc.and_(pc.greater_equal(t.column(column), lo), pc.less_equal(t.column(column), hi)))


def _cut_bits(n: int, most: int = GROUP) -> int:
    """Leading bits by which ``n`` stored rows are cut into ranges."""
    return max(0, min(most, int(np.ceil(np.log2(max(1, n / RANGE_ROWS))))))


def _looked_up(files: dict[int, list[str]], bits: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of one range of a bucket that are stored, with the stored item and the batch's first."""
        t = pa.Table.from_batches(list(batches))
        bucket, at = t.column("bucket")[0].as_py(), t.column("range")[0].as_py()
        lo = at << (64 - bits) if bits else -(1 << 63)
        first, hashes = dict(zip(t.column("key").to_pylist(), t.column("first").to_pylist())), t.column("h").to_numpy()
        out = []
        for x in _stored(files.get(bucket, []), "h", lo, lo + (1 << (64 - bits)) - 1, ["h", "key", "item_id"]):
            x = x.filter(pa.array(np.isin(x.column("h").to_numpy(), hashes)))
            out += [(k, i, first[k]) for k, i in zip(x.column("key").to_pylist(), x.column("item_id").to_pylist()) if k in first]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["key", "a", "b"])

    return look


def known_keys(spark: SparkSession, path: str, shards: list[str], first: DataFrame, bits: int) -> DataFrame:
    """(key, a, b): the keys of ``first`` (key, item_id, h, bucket) that are stored, with the stored item and that of ``first``."""
    cut = _cut_bits(_part(spark, path, "keys", shards).count() >> bits)
    at = first.select("key", F.col("item_id").alias("first"), "h", "bucket", (F.shiftright("h", 64 - cut) if cut else F.lit(0).cast("bigint")).alias("range"))
    return grouped(at, "bucket", "range").applyInArrow(_looked_up(_files(spark, path, "keys", shards), cut), "key string, a bigint, b bigint")


def _search_stored(files: dict[int, list[str]], bits: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range of a ring: the batch's nodes arrive at those stored in its places; yields the links found."""
        t = pa.Table.from_batches(list(batches))
        ring, slot, at = (t.column(c)[0].as_py() for c in ("ring", "slot", "range"))
        lo, piece, links = at << (GROUP - bits), Piece(GROUP), []
        places = t.column("lead16").to_numpy()
        for x in _stored(files.get(slot, []), "lead16", lo, lo + (1 << (GROUP - bits)) - 1, ["lead16", "hash", "item_id"]):
            x = x.filter(pa.array(np.isin(x.column("lead16").to_numpy(), places)))
            if len(x):
                piece.arrive(rotated(x.column("hash").to_numpy().view(np.uint64), ring), x.column("item_id").to_numpy(), match=False)
        links = piece.arrive(rotated(t.column("hash").to_numpy().view(np.uint64), ring), t.column("item_id").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return search


def stored_links(spark: SparkSession, path: str, shards: list[str], new: DataFrame, bits: int, name: str) -> DataFrame:
    """(a, b): links between the places ``new`` (hash, item_id, ring, lead16, slot) and those stored, and among the new ones.

    Each range of a ring reads what is stored there, on this ring only.  Places that are crowded together with
    what is stored are split, old nodes and new, as in ``near_links``.
    """
    old = old_places(spark, path, shards, new)
    at = staged(new.groupBy("ring", "lead16").agg(F.count(F.lit(1)).alias("n_new")), name + "-at")  # at most 4 x 65,536 rows
    there = old.select("ring", "lead16").join(broadcast_if_small(at.select("ring", "lead16"), 4 << GROUP), ["ring", "lead16"]).groupBy("ring", "lead16").agg(F.count(F.lit(1)).alias("n_old"))
    dense = at.join(there, ["ring", "lead16"], "left").withColumn("n", F.col("n_new") + F.coalesce("n_old", F.lit(0))).where(F.col("n") > HOT_ROWS)
    fine = F.least(F.lit(12), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(PIECE_ROWS)))))).cast("int")
    dense = staged(dense.select("ring", "lead16", fine.alias("fine")), name + "-dense")
    crowded = broadcast_if_small(dense, 4 << GROUP)
    cut = max(bits, _cut_bits(_part(spark, path, "places", shards).count() // RINGS))
    plain = new.join(crowded, ["ring", "lead16"], "left_anti").select("ring", "slot", F.shiftright("lead16", GROUP - cut).alias("range"), "lead16", "hash", "item_id")
    links = grouped(plain, "ring", "slot", "range").applyInArrow(_search_stored(_files(spark, path, "places", shards), cut), "a bigint, b bigint")
    if not dense.isEmpty():
        node = lambda x, b: x.select("ring", "lead16", "hash", "item_id", F.lit(b).alias("batch_no")).join(crowded, ["ring", "lead16"])
        both = _finer(node(new, 1).unionByName(node(old, 0)))
        links = links.unionByName(grouped(both, "ring", "piece", "turn").applyInArrow(_search(0), "a bigint, b bigint"))
    return links.distinct()


def _add(path: str, rows: DataFrame, labelled: bool, bits: int | None, max_shards: int, name: str) -> DataFrame | None:
    """Adds ``rows`` (item_id, digest, file, hash) as a shard; gives the labels of its items, if asked for.

    Its links join the rows with each other and with all that is stored.
    """
    spark = rows.sparkSession
    state = _held(spark, path)
    shards, shard = state.shards, f"s{state.begun + 1}-{uuid.uuid4().hex[:8]}"
    each = _keys(rows)
    bits = state.bits if state.bits is not None else bits if bits is not None else _bits(rows.count())
    first = _bucketed(each.groupBy("key").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n")), bits)
    if shards:
        first = staged(first, name + "-keys")
    else:
        _write_keys(first, path, shard)
        first = _part(spark, path, "keys", [shard])
    links = each.join(broadcast_if_small(first.where(F.col("n") > 1).select("key", F.col("item_id").alias("first"))), "key")
    links = links.where(F.col("item_id") != F.col("first")).select(F.col("first").alias("a"), F.col("item_id").alias("b"))
    if shards:
        known = staged(known_keys(spark, path, shards, first, bits), name + "-known")
        links = links.unionByName(known.select("a", "b"))
        _write_keys(first.join(broadcast_if_small(known.select("key")), "key", "left_anti"), path, shard)
    # a hash that is known already has its links
    nodes = _part(spark, path, "keys", [shard]).where(F.startswith("key", F.lit("h"))).select(F.expr("cast(substring(key, 2) as bigint)").alias("hash"), "item_id")
    _write_places(_slots(nodes, bits), path, shard)
    if shards:
        near = stored_links(spark, path, shards, _part(spark, path, "places", [shard]), bits, name)
    else:
        near = near_links(staged(nodes.withColumn("batch_no", F.lit(0)), name + "-nodes"))
    links = _write(links.unionByName(near), path, "links", shard)
    labels = _write(_labels(spark, path, state.labelled, links, name), path, "labels", shard) if labelled else None
    _hold(spark, path, State(state.begun + 1, [*shards, shard], state.labelled + [shard] * labelled, bits))
    if len(shards) + 1 > max_shards:
        compact(spark, path)
    return labels


def compact(spark: SparkSession, path: str) -> None:
    """Rewrites all shards as one, in as many slots as they need by now.

    The state before holds until the new one is complete; the files of old shards stay for its readers.
    """
    state = _held(spark, path)
    shard = f"s{state.begun + 1}-{uuid.uuid4().hex[:8]}"
    keys = _part(spark, path, "keys", state.shards).select("key", "item_id", "n")
    bits = max(state.bits, _bits(keys.count() // RINGS))
    _write_keys(_bucketed(keys, bits), path, shard)
    nodes = _part(spark, path, "places", state.shards).where(F.col("ring") == 0).select("hash", "item_id")
    _write_places(_slots(nodes, bits), path, shard)
    _write(_part(spark, path, "links", state.shards).select("a", "b"), path, "links", shard)
    _write(_part(spark, path, "labels", state.labelled).groupBy("item_id").agg(F.min("image").alias("image")), path, "labels", shard)
    _hold(spark, path, State(state.begun + 1, [shard], [shard], bits))


def _labels(spark: SparkSession, path: str, shards: list[str], links: DataFrame, name: str) -> DataFrame:
    """(item_id, image) of what the links of a batch join: its items, and the images known before that they join with others."""
    stored = _part(spark, path, "labels", shards).select("item_id", "image")
    ends = links.select(F.col("a").alias("item_id")).union(links.select("b")).distinct()
    known = staged(ends.withColumn("image", F.col("item_id")), name + "-ends")
    for n in range(len(shards)):  # an image that was joined with another leads on to that
        to = stored.groupBy(F.col("item_id").alias("image")).agg(F.min("image").alias("to"))
        on = known.join(broadcast_if_small(known.select("image").distinct()).join(to, "image"), "image", "left")
        known = staged(on.select("item_id", F.coalesce("to", "image").alias("image")), f"{name}-known-{n}")
    edges = links.unionByName(known.where(F.col("item_id") != F.col("image")).select(F.col("image").alias("a"), F.col("item_id").alias("b")))
    return components(edges, name + "-images").select("item_id", F.col("first_id").alias("image"))


def accept(path: str, items: DataFrame, hashes: DataFrame, bits: int | None = None, max_shards: int = STORED_SHARDS, name: str = "accept") -> DataFrame:
    """(kept_id, item_id) of the rows of one batch that repeat an image of the index at ``path`` or an earlier row of the batch.

    The batch becomes a shard of the index, whatever its batch_no; an empty or missing folder starts one.  Of what is
    stored only the buckets and slots of the batch's own keys and places are read.  A batch can join two known images: ``images`` gives them as they
    are after all batches.  If it fails, the index is as before.
    """
    rows = staged(rows_of(items, hashes), name + "-rows")
    labels = _add(path, rows, True, bits, max_shards, name)
    found = labels.join(rows.select("item_id").distinct(), "item_id").where(F.col("image") < F.col("item_id"))
    return found.select(F.col("image").alias("kept_id"), "item_id")


def images(spark: SparkSession, path: str, name: str = "images") -> DataFrame:
    """(item_id, first_id) of every row of the index but the first of its image."""
    return components(_part(spark, path, "links", _held(spark, path).shards), name)


def repeats(items: DataFrame, hashes: DataFrame, path: str | None = None, name: str = "history") -> DataFrame:
    """(kept_id, item_id) of each row of a later batch that shows an image of a row with a smaller item_id.

    ``items``: item_id, batch_no, content_sha1, shard, image_path; ``hashes``:
    item_id, hash; other columns are ignored.  Rows show the same image by equal digests, by the
    same shard and file, or by hashes within 3 bits; this is carried on over any
    number of rows, and kept_id is the smallest item_id of the image.  A null
    digest, shard, path or hash links nothing; a null batch_no is history (0);
    rows without item_id are left out.  Empty tables: no rows.

    The batches arrive one after another at a stored index (``path``, by default in the run's folder).
    """
    spark = items.sparkSession
    path = path or scratch(spark, name + "-index")
    rows = staged(rows_of(items, hashes).withColumn("batch_no", F.coalesce("batch_no", F.lit(0))), name + "-rows")
    for (b,) in rows.select("batch_no").distinct().orderBy("batch_no").toLocalIterator():
        _add(path, rows.where(F.col("batch_no") == b), False, None, STORED_SHARDS, f"{name}-{b}")
    later = rows.where(F.col("batch_no") >= 1).select("item_id").distinct()
    return images(spark, path, name + "-images").join(later, "item_id").select(F.col("first_id").alias("kept_id"), "item_id")
