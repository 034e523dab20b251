"""Centroid clustering of vectors over Hilbert-ordered zone maps, exact in integers.

Components become integers, floor(scale * x). The vectors are sorted along a Hilbert
curve through the box of all of them and cut into blocks of ``BLOCK``, so a block
holds vectors near one another. A block is one row: its vectors, ids, the smallest
and largest value of each component, and the sum of its vectors.

A round gives each task the centroids. For a block, the squared distance from its box
to a centroid is at least ``low`` and at most ``high``; a centroid whose ``low`` is above
the least ``high`` is nearest to no vector of the block, not even in a tie. What is
left are the block's candidates, compared with every vector exactly, by one matrix
product. With one candidate nothing is compared: the block's stored sum counts. Tasks
send one partial sum for each centroid and component, which Spark adds up; the driver
sees k * (dims + 1) numbers a round, whatever the number of vectors.

The curve only decides which vectors share a block, so the result does not depend on
it, on the number of tasks or on the order of rows. Blocks are read anew each round
from the shared checkpoint folder, so a lost executor costs its blocks of one round.

Defined results: vectors that are null, of another length or hold a null or non-finite
component are left out; a null id is kept and returned but never starts a centroid;
rows that repeat an id are vectors of their own, and start centroids in the order of
their components; equal vectors are all kept, however many; fewer than k vectors give
fewer centroids; an empty table, or one without ids, gives no rows; other columns are
ignored. Components beyond 2^27 after scaling count as 2^27, as their squared
distances would not fit a long; an inertia that does not fit one is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import cut

#: Vectors of a block, and bits of a component in the curve's key.
BLOCK = 256
CURVE_BITS = 4
LIMIT = 1 << 27
#: Up to this size all sums of a squared distance are whole numbers of a double.
FLOAT_LIMIT = 1 << 21
RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass(frozen=True)
class Rule:
    """k centroids started by the least sha256 of ``salt`` and the id, moved ``rounds`` times."""

    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    salt: str = "2:"


def to_bytes(values: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes whose order is that of the numbers."""
    raw = (values + (1 << 31)).astype(">u4").tobytes()
    width = 4 * values.shape[1]
    return [raw[i:i + width] for i in range(0, len(raw), width)]


def from_bytes(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, ">u4").reshape(-1, dims).astype(np.int64) - (1 << 31)


def kept_vectors(rows: DataFrame, rule: Rule, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the usable vectors as whole numbers."""
    ident = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), rule.dims), False))
            flat = batch.column("v").flatten()
            gaps = np.asarray(flat.is_null()).reshape(-1, rule.dims).any(axis=1)
            x = np.asarray(flat.fill_null(0.0), np.float64).reshape(-1, rule.dims)
            good = ~gaps & np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(rule.scale * x[good]), -LIMIT, LIMIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), pa.array(to_bytes(q), pa.binary())], names=["id", "v"])

    source = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return source.mapInArrow(run, f"id {ident}, v binary")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (0 to 2^bits - 1), as rows of bytes in the curve's order.

    Skilling's transform, for all rows at once: undo the turns of each level from the
    highest bit down, Gray-encode, and deal the bits out level by level.
    """
    x = cells.astype(np.uint32).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dims):
            upper = (x[:, i] & q) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & below).astype(np.uint32)
            x[:, 0] ^= np.where(upper, below, swap).astype(np.uint32)
            x[:, i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(len(x), np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn[:, None]
    levels = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels, axis=1).astype(np.uint8), axis=1)


def _bounds(kept: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Smallest and largest value of each component over all vectors: one row a component reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                q = from_bytes(b"".join(batch.column("v").to_pylist()), dims)
                low = q.min(0) if low is None else np.minimum(low, q.min(0))
                high = q.max(0) if high is None else np.maximum(high, q.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    found = kept.select("v").mapInArrow(run, "dim int, low long, high long").groupBy("dim").agg(F.min("low"), F.max("high")).collect()
    if not found:
        return None
    table = np.array(sorted(map(tuple, found)), np.int64)
    return table[:, 1], table[:, 2]


def zone_blocks(kept: DataFrame, low: np.ndarray, high: np.ndarray, dims: int) -> DataFrame:
    """(ids, vectors, low, high, total): blocks of up to ``BLOCK`` neighbours on the curve.

    Rows are dealt by ranges of (key, row number), so equal vectors spread over tasks as well.
    """
    ident = kept.schema["id"].dataType.simpleString()
    width = np.maximum(high - low + 1, 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = from_bytes(b"".join(batch.column("v").to_pylist()), dims)
            key = hilbert_keys(((q - low) << CURVE_BITS) // width, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in key], pa.binary())], names=[*batch.schema.names, "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None

        def blocks(rows: pa.Table, all_of_it: bool) -> Iterator[pa.RecordBatch]:
            at = 0
            while rows.num_rows - at >= (1 if all_of_it else BLOCK):
                part = rows.slice(at, BLOCK).combine_chunks()
                raw = b"".join(part.column("v").to_pylist())
                q = from_bytes(raw, dims)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id").combine_chunks())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([raw], pa.binary()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (q.min(0), q.max(0), q.sum(0)))],
                    names=["ids", "vectors", "low", "high", "total"])
                at += BLOCK

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            if waiting.num_rows >= BLOCK:
                yield from blocks(waiting, False)
                waiting = waiting.slice(waiting.num_rows // BLOCK * BLOCK)
        if waiting is not None:
            yield from blocks(waiting, True)

    numbered = kept.withColumn("row", F.monotonically_increasing_id())
    placed = numbered.mapInArrow(keys, f"id {ident}, v binary, row long, key binary")
    ordered = placed.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    return ordered.select("id", "v").mapInArrow(
        pack, f"ids array<{ident}>, vectors binary, low array<bigint>, high array<bigint>, total array<bigint>")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector of the box, in ascending order."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(centroids - low), np.abs(centroids - high)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the nearest centroid, squared distance) of each vector, exact; the first of equal ones."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= FLOAT_LIMIT:
        x, c = q.astype(np.float64), centroids.astype(np.float64)
        far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    else:
        far = np.stack([((q - c) ** 2).sum(1) for c in centroids], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(q)), best].astype(np.int64)


def _block_rows(batch: pa.RecordBatch, centroids: np.ndarray):
    for at in range(batch.num_rows):
        low, high = (np.array(batch.column(name)[at].as_py(), np.int64) for name in ("low", "high"))
        yield at, candidates(low, high, centroids)


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floor means of their vectors; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for at, near in _block_rows(batch, centroids):
                if len(near) == 1:
                    total[near[0], 0] += len(batch.column("vectors")[at].as_buffer()) // (4 * dims)
                    total[near[0], 1:] += batch.column("total")[at].as_py()
                    continue
                q = from_bytes(batch.column("vectors")[at].as_py(), dims)
                best, _ = nearest(q, centroids[near])
                for place in np.unique(best):
                    mine = q[best == place]
                    total[near[place], 0] += len(mine)
                    total[near[place], 1:] += mine.sum(0)
        held = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(held)), pa.int32()),
             pa.array(total[held].ravel(), pa.int64())], names=["cluster", "place", "total"])

    sums = blocks.select("vectors", "low", "high", "total").mapInArrow(run, "cluster int, place int, total long")
    table: dict[int, dict[int, int]] = {}
    for cluster, place, total in sums.groupBy("cluster", "place").agg(F.sum("total")).collect():
        table.setdefault(cluster, {})[place] = total
    out = centroids.copy()
    for cluster, row in table.items():
        out[cluster] = [row[i + 1] // row[0] for i in range(dims)]
    return out


def _assigned(blocks: DataFrame, centroids: np.ndarray, ident: str) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, near in _block_rows(batch, centroids):
                best, far = nearest(from_bytes(batch.column("vectors")[at].as_py(), dims), centroids[near])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[at].values, pa.array(near[best], pa.int32()), pa.array(far, pa.int64())],
                                                 names=["id", "cluster", "distance"])

    return blocks.select("ids", "vectors", "low", "high").mapInArrow(run, f"id {ident}, cluster int, distance long")


def cluster_vectors(rows: DataFrame, rule: Rule = Rule(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    spark = rows.sparkSession
    ident = rows.schema[id_col].dataType.simpleString()
    kept = cut(kept_vectors(rows, rule, id_col, vector_col))
    bounds = _bounds(kept, rule.dims)
    hashed = F.sha2(F.concat(F.lit(rule.salt), F.col("id").cast("string")), 256)
    first = kept.where("id is not null").select(hashed.alias("h"), "v").orderBy("h", "v").limit(rule.k).collect()
    if bounds is None or not first:
        return spark.createDataFrame([], f"{id_col} {ident}, {RESULT}")
    blocks = cut(zone_blocks(kept, *bounds, rule.dims))
    centroids = np.concatenate([from_bytes(bytes(r["v"]), rule.dims) for r in first])
    for _ in range(rule.rounds):
        centroids = _moved(blocks, centroids)
    assigned = cut(_assigned(blocks, centroids, ident))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()
    fits = lambda n: int(n) if n < 1 << 63 else None
    whole = sum(s for _, s in sums)
    facts = [(c, fits(s), fits(whole), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return assigned.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
