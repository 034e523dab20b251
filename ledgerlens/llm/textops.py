"""Helpers on whole Arrow text columns: words and rolling hashes as numpy arrays.

All hashes are 64-bit, computed from UTF-8 bytes, and equal on every machine.
Texts are taken whole; long columns are cut into runs of documents, never
inside a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The base of the polynomial hash is odd, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text at work at once; the hashes take some fifty times that.
CHUNK_BYTES = 1 << 18
SLICE_ROWS = 256


def small_batches(spark, rows: int = 1000) -> None:
    """Let the session send Python at most ``rows`` rows at once: documents are long, and Spark's 10,000 of them fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type in (pa.large_string(), pa.large_binary()):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    off = np.frombuffer(offsets, width)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = off[:-1], off[1:].copy()
    if column.null_count:
        missing = np.asarray(column.is_null())
        ends[missing] = starts[missing]
    return raw, starts, ends


def document_runs(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``limit`` bytes: (first, last, bytes, offsets).

    The documents stand one behind another in ``bytes``, each followed by a line
    feed; ``offsets[i]`` is where document first+i begins, ``offsets[-1]`` the end.
    """
    raw, starts, ends = byte_views(column)
    n = len(starts)
    first = 0
    while first < n:
        last, size = first, 0
        while last < n and (last == first or size + ends[last] - starts[last] < limit):
            size += ends[last] - starts[last] + 1
            last += 1
        out = np.full(size, 10, np.uint8)
        offsets = np.zeros(last - first + 1, np.int64)
        at = 0
        for i in range(first, last):
            k = ends[i] - starts[i]
            out[at:at + k] = raw[starts[i]:ends[i]]
            at += k + 1
            offsets[i - first + 1] = at
        yield first, last, out, offsets
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without x20 and x09-x0D."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below n, kept between batches of a task."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        for other in [k for k in _POWERS if k != size and k > 1 << 21]:
            del _POWERS[other]
    return _POWERS[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; ``span_hash`` reads any span from them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of_run(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each document and the end) of a run of documents."""
    low = lower_ascii(data)
    starts, ends = word_bounds(low)
    hashes = span_hash(prefix_hash(low), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-word shingles of one document; fewer words make one shingle, none none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(BASE) + words[i:len(words) - k + 1 + i])
    return out


def map_texts(rows, keep: list[str], text_col: str, fn, result: str, slice_rows: int = SLICE_ROWS):
    """``fn(text) -> tuple`` over a text column; the result's columns follow the kept ones.

    The kept columns pass through as they are (64-bit ids stay exact, nulls stay
    null). Texts are turned into Python strings ``slice_rows`` at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    more = StructType.fromDDL(result) if hasattr(StructType, "fromDDL") else rows.sparkSession.createDataFrame([], result).schema
    kept = StructType([f for k in keep for f in rows.schema.fields if f.name == k])
    schema = StructType(kept.fields + more.fields)
    types = [f.type for f in to_arrow_schema(more)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                found = list(zip(*map(fn, part.column(text_col).to_pylist())))
                arrays = [part.column(k) for k in keep] + [pa.array(list(c), t) for c, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.select(*keep, text_col).mapInArrow(run, schema)


def filter_texts(docs, text_col: str, fn):
    """The rows for whose text ``fn`` is true; columns stay. Texts become Python strings a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield part.filter(pa.array([bool(fn(t)) for t in part.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def rewrite_texts(docs, text_col: str, fn):
    """The same rows and columns with ``fn`` of each text in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = pa.array([fn(t) for t in part.column(place).to_pylist()], part.column(place).type)
                yield part.set_column(place, part.schema.field(place), texts)

    return docs.mapInArrow(run, docs.schema)
