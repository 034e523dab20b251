"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated at random and kept as one bit per dimension, with a
correction factor f = <code, vector>. The rotated vector itself is kept in 8-bit
steps as a query. <code, query> / f is an unbiased estimate of the cosine, whose
error is bounded with high confidence by BOUND * sqrt((1 - f^2) / f^2 / (d - 1)).
Both directions are averaged. Only pairs whose upper bound reaches the threshold
are computed again, exactly, in double precision.

Candidates share a label and, in one of several tables, the bits of a random
subset of rotated dimensions. The subset's size follows the logarithm of the
label's number of vectors and the number of tables the wanted recall at the
threshold, so a vector meets about as many others at every size. A bucket above
``LEAF`` vectors is cut into blocks that meet in pairs; nothing is capped.

Equal vectors of a label are one class; the pairs are between classes, and a
class's links count its partners' members.

Defined results: null and zero vectors, vectors with a null or non-finite
component, null labels and null ids link with nothing; vectors of different
lengths are not compared; rows that repeat an id are vectors of their own and
share the id's component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import connected_components, cut
from ledgerlens.llm.jaccard_join import _grouped

BOUND = 4.0
LEAF = 1024
BUCKET = 64
RECALL = 0.9999
SEED = 20240607


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task up to rounding."""
    rng = np.random.default_rng([SEED, dim, number])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(vectors: int, threshold: float, dim: int, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for a label of so many vectors."""
    bits = max(0, min(dim, math.ceil(math.log2(max(vectors, 1) / BUCKET)) if vectors > BUCKET else 0))
    if not bits:
        return 0, 1
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    hit = same ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    return [None if v is None else np.array(v, np.float64) for v in column.to_pylist()]


def _read(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, k1, k2, v): usable vectors with a 128-bit key of their components; dim is null for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("vec_id"), batch.column("label")
            dims, k1, k2, out = [], [], [], []
            for at, v in enumerate(_vectors(batch.column("v"))):
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any() or not ids[at].is_valid or not labels[at].is_valid:
                    dims.append(None)
                    k1.append(None)
                    k2.append(None)
                    out.append(None)
                    continue
                v = v + 0.0  # minus zero is zero
                key = hashlib.md5(v.tobytes()).digest()
                dims.append(len(v))
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                out.append(v)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(dims, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "label", "dim", "k1", "k2", "v"])

    return rows.mapInArrow(run, "vec_id long, label string, dim int, k1 long, k2 long, v array<double>")


def coded(classes: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id, code, query, low, step, factor): one row per table of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[tuple[int, int], np.ndarray] = {}

        def matrix(dim: int, number: int) -> np.ndarray:
            if (dim, number) not in turned:
                turned[dim, number] = rotation(dim, number)
            return turned[dim, number]

        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("bucket", "id", "code", "query", "low", "step", "factor")}
            for i, label, dim, n, v in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "dim", "vectors", "v"))):
                x = np.array(v)
                top = np.abs(x).max()
                x = x / top  # no overflow in the norm
                x = matrix(dim, 0) @ (x / np.linalg.norm(x))
                sign = x >= 0
                factor = float(np.abs(x).sum() / math.sqrt(dim))
                low, step = float(x.min()), float((x.max() - x.min()) / 255) or 1.0
                query = np.rint((x - low) / step).astype(np.uint8).tobytes()
                code = np.packbits(sign).tobytes()
                bits, tables = table_plan(n, threshold, dim)
                for t in range(tables):
                    turn, place = divmod(t * bits, dim)
                    chosen = np.arange(place, place + bits)
                    # the bits of a table come from further rotations of the vector, each used once
                    near = (matrix(dim, turn + 1) @ x)[chosen[chosen < dim]] >= 0
                    if place + bits > dim:
                        near = np.concatenate((near, (matrix(dim, turn + 2) @ x)[:place + bits - dim] >= 0))
                    name = f"{label}:{dim}:{t}:".encode() + np.packbits(near).tobytes()
                    out["bucket"].append(int.from_bytes(hashlib.md5(name).digest()[:8], "little", signed=True))
                    for c, value in (("id", i), ("code", code), ("query", query), ("low", low), ("step", step), ("factor", factor)):
                        out[c].append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], names=list(out))

    return classes.select("id", "label", "dim", "vectors", "v").mapInArrow(
        run, "bucket long, id long, code binary, query binary, low double, step double, factor double")


def met(rows: DataFrame) -> DataFrame:
    """Rows with their meeting and side: a bucket of at most LEAF rows meets itself; a larger one is cut into blocks that meet in pairs."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    placed = rows.join(sizes, "bucket").withColumn("m", F.ceil(F.col("k") / LEAF).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    meeting = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    # the later block of a meeting is the guest; a block that meets itself has none
    return placed.select(meeting.alias("meeting"), (F.col("block") > F.col("other")).alias("guest"), "id", "code", "query", "low", "step", "factor")


def candidate_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of a meeting whose upper bound reaches the threshold, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "meeting"):
            guest = group.column("guest").to_numpy(zero_copy_only=False)
            ids, low, step, f = (group.column(c).to_numpy() for c in ("id", "low", "step", "factor"))
            query = np.frombuffer(b"".join(group.column("query").to_pylist()), np.uint8).reshape(len(ids), -1)
            dim = query.shape[1]
            query = (query * step[:, None] + low[:, None]).astype(np.float32)
            code = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            code = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
            width = BOUND ** 2 * np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1)
            slack = step * math.sqrt(dim) / 2  # rounding of the query, at most
            a, b = np.flatnonzero(~guest), np.flatnonzero(guest)
            itself = not len(b)
            if itself:
                b = a
            if not len(a) or not len(b):
                continue
            forward = code[a] @ query[b].T / math.sqrt(dim) / f[a][:, None]
            back = query[a] @ code[b].T / math.sqrt(dim) / f[b][None, :]
            upper = (forward + back) / 2 + np.sqrt(width[a][:, None] + width[b][None, :]) / 2
            upper += (slack[b][None, :] / f[a][:, None] + slack[a][:, None] / f[b][None, :]) / 2 + 1e-4
            x, y = np.nonzero(upper >= threshold)
            if itself:
                x, y = x[x < y], y[x < y]
            if len(x):
                one, two = ids[a[x]], ids[b[y]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], names=["a", "b"])

    placed = rows.repartition("meeting").sortWithinPartitions("meeting")
    return placed.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def exact(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) with a cosine of at least the threshold, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("va", "vb")]
            sizes = [np.diff(np.asarray(side.offsets)) for side in sides]
            keep = np.zeros(batch.num_rows, bool)
            same = sizes[0] == sizes[1]
            for dim in np.unique(sizes[0][same]).tolist():  # one length as a rule
                rows = np.flatnonzero(same & (sizes[0] == dim))
                chosen = pa.array(rows)
                p, q = (side.take(chosen).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim) for side in sides)
                keep[rows] = cosines(p, q) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(keep))

    vectors = classes.select("id", "v")
    both = (pairs.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
            .join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b"))
    return both.select("a", "b", "va", "vb").mapInArrow(run, "u long, v long")


def cosines(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row; rows whose squares leave the range of doubles are scaled first."""
    def sizes() -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q))

    with np.errstate(over="ignore", under="ignore"):
        size = sizes()
        if not (np.isfinite(size).all() and (size > 1e-300).all()):
            p, q = (v / np.abs(v).max(axis=1, keepdims=True) for v in (p, q))
            size = sizes()
    return np.einsum("ij,ij->i", p, q) / size


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    read = cut(_read(rows))
    same = ["label", "dim", "k1", "k2"]
    classes = read.where("dim is not null").groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("members"), F.first("v").alias("v"))
    classes = cut(classes)
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("vectors"))
    pairs = candidate_pairs(met(coded(classes.join(sizes, ["label", "dim"]), threshold)), threshold)
    links = cut(exact(pairs, classes, threshold))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counts = (both.join(classes.select(F.col("id").alias("v"), "members"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("members").alias("partners")))
    named = (classes.select(*same, "id", "members").join(counts, "id", "left").join(connected_components(links), "id", "left")
             .select(*same, (F.col("members") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    return read.select("vec_id", *same).join(named, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
