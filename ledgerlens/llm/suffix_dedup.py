"""Exact substring deduplication by blockwise sorting of cover-sampled suffixes.

A byte goes when a 100-byte string that covers it also starts earlier, in a
document with a smaller id or further left in the same one.

Blockwise suffix sorting needs a cover: sample positions such that the windows
of two equal suffixes contain samples at equal offsets, whose ranks then settle
long ties. A difference cover modulo v takes at least a square-root share of all
positions; here the cover is local to the content: of every 100-byte window, the
least 32-byte hash inside it. Equal windows have equal samples, and about 3 % of
all positions are sampled.

* Suffix buckets: samples go to buckets by their hash; a bucket is sorted by the
  context that the sample's windows span, and read once, in order, in bounded
  memory. Equal contexts are long ties: all but the earliest are repeats. Each
  task sends only its earliest of equal contexts.
* Where one sample stands in different contexts or a context is periodic, the windows of the earliest
  occurrence of each context are sorted by their own hash in the same way.

Strings are compared by 119 bits (context) and 64 bits (window) of hash.

Defined results: a null text is empty; texts under 100 bytes lose nothing; rows
that repeat an id and text are one document and get the same result; rows with a
null id lose nothing and take nothing; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import cut
from ledgerlens.llm.textops import byte_views, mix, prefix_hash, span_hash

WINDOW = 100
GRAM = 32
PIECE = WINDOW - GRAM + 1
HELD_SAMPLES = 1 << 21
LEAF = 1024
#: Ids that may be broadcast: about 8 MB. Beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
U64 = np.uint64


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    out, k = h, 1
    while k * 2 <= width:
        out = np.minimum(out[:len(out) - k], out[k:])
        k *= 2
    rest = width - k
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def samples(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sample hash, context hash, first window, number of windows, periodic) of one text's runs of windows with one least gram.

    One gram lies in PIECE windows, so only runs that hold their least gram more
    than once are longer; they are cut, and called periodic: only in them can two
    windows be equal.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty.astype(U64), empty.astype(U64), empty, empty, empty.astype(bool)
    prefix = prefix_hash(data)
    grams = np.arange(len(data) - GRAM + 1)
    hashes = span_hash(prefix, grams, grams + GRAM)
    least = window_minima(hashes, WINDOW - GRAM + 1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    if sizes.max() > PIECE:  # one gram repeated, as in a run of one letter
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(starts)), pieces)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, sizes = starts[owner] + PIECE * step, np.minimum(PIECE, sizes[owner] - PIECE * step)
    reach = sizes + WINDOW - GRAM
    begin = np.cumsum(reach) - reach
    inside = hashes[np.arange(reach.sum()) + np.repeat(starts - begin, reach)] == np.repeat(least[starts], reach)
    periodic = np.add.reduceat(inside.astype(np.int32), begin) > 1
    return least[starts], span_hash(prefix, starts, starts + sizes + WINDOW - 1), starts, sizes, periodic


def _documents(column: pa.Array, low: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    raw, starts, ends = byte_views(column)
    for k in range(len(starts)):
        if ends[k] - starts[k] >= low:
            yield k, raw[starts[k]:ends[k]]


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def sampled(docs: DataFrame, bits: int) -> DataFrame:
    """(h, x, at): a task's earliest of equal contexts, x = context, periodic bit and window count; x < 0 is a repeat of -x bytes at ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def out() -> pa.RecordBatch:
            h, x, at, size = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((at, x, h))
            h, x, at, size = h[order], x[order], at[order], size[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
            first = at[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            again = at > first
            at2, end = merged(at[again], at[again] + size[again] + WINDOW - 1)
            return _rows(h=np.concatenate((h[new].view(np.int64), at2)), x=np.concatenate((x[new].view(np.int64), at2 - end)),
                         at=np.concatenate((at[new], at2)))

        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for k, data in _documents(batch.column("text"), WINDOW):
                h, c, start, size, periodic = samples(data)
                x = (c >> U64(9) << U64(8)) | periodic.astype(U64) << U64(7) | size.astype(U64)
                held.append((h, x, (int(ids[k]) << bits) + start, size))
                count += len(h)
                if count >= HELD_SAMPLES:
                    yield out()
                    held.clear()
                    count = 0
        if held:
            yield out()

    return docs.select("doc", "text").mapInArrow(run, "h long, x long, at long")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as one; ``start`` need not be sorted."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    where = np.flatnonzero(new)
    return start[where], np.concatenate((end[where[1:] - 1], end[-1:]))


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """(h, at, n) of the buckets in order: n > 0 is a repeat of n bytes, n < 0 the earliest of a context that needs its -n windows sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the rows read, only the last context and its earliest place are kept.
        last_h = last_x = last_at = None
        waiting = False
        for batch in batches:
            h, x, at = (batch.column(c).to_numpy() for c in ("h", "x", "at"))
            if not len(h):
                continue
            ready = x < 0
            out = [(h[ready], at[ready], -x[ready])]
            h, x, at = h[~ready], x[~ready], at[~ready]
            if len(h):
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
                if last_h is not None and h[0] == last_h and x[0] == last_x:
                    new[0] = False
                where = np.flatnonzero(new)
                owner = np.cumsum(new) - 1
                least = np.concatenate((at[where], [last_at if last_at is not None else 0]))[owner]
                again = at > least
                out.append((h[again], at[again], (x[again] & 127) + WINDOW - 1))
                if len(where):
                    bucket = h[where]
                    before = np.zeros(len(where), bool)
                    before[1:] = bucket[1:] == bucket[:-1]
                    before[0] = last_h is not None and bucket[0] == last_h
                    several = before | ((x[where] & 128) > 0)
                    several[:-1] |= before[1:]
                    if waiting and before[0]:
                        out.append((np.array([last_h]), np.array([last_at]), np.array([-(last_x & 127)])))
                    out.append((bucket[several], at[where[several]], -(x[where[several]] & 127)))
                    waiting = not several[-1]
                    last_h, last_x, last_at = int(bucket[-1]), int(x[where[-1]]), int(at[where[-1]])
            h, at, n = (np.concatenate(c) for c in zip(*out))
            yield _rows(h=h, at=at, n=n)

    return rows.repartition("h").sortWithinPartitions("h", "x", "at").mapInArrow(run, "h long, at long, n long")


SUFFIXES = "key long, at long, context binary"


def suffixes(docs: DataFrame, several: DataFrame, bits: int) -> DataFrame:
    """(key, at, context): the contexts to sort, by sample; of a bucket above LEAF contexts, every window by its own hash.

    The bytes of a context are sent once, where its windows would be some fifty rows.
    """
    low = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = batch.column("doc").to_numpy(), batch.column("runs").to_pylist()
            keys, places, contexts = [], [], []
            for k, data in _documents(batch.column("text"), WINDOW):
                large = []
                raw = data.tobytes()
                for r in runs[k]:
                    start = r["at"] & low
                    if r["large"]:
                        large.append((start, -r["n"]))
                        continue
                    keys.append(r["h"])
                    places.append(r["at"])
                    contexts.append(raw[start:start - r["n"] + WINDOW - 1])
                if large:
                    prefix = prefix_hash(data)
                    first, size = np.unique(np.array(large, np.int64), axis=0).T
                    start = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                    found = span_hash(prefix, start, start + WINDOW).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array((int(ids[k]) << bits) + start), pa.nulls(len(found), pa.binary())],
                                                     names=["key", "at", "context"])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(contexts, pa.binary())],
                                             names=["key", "at", "context"])

    # Large buckets are few, LEAF contexts make one; while they are, their rows are not dealt by bucket to be marked.
    large = cut(several.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > LEAF).select("h", F.lit(True).alias("large")))
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    marked = several.join(large, "h", "left").select("h", "at", "n", F.coalesce("large", F.lit(False)).alias("large"))
    runs = marked.groupBy(F.shiftright("at", bits).alias("doc")).agg(F.collect_list(F.struct("h", "at", "n", "large")).alias("runs"))
    return docs.select("doc", "text").join(runs, "doc").mapInArrow(run, SUFFIXES)


def _bucket_repeats(keys: np.ndarray, places: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the windows that stand earlier in the same bucket; whole buckets, several at a time."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    count = sizes - WINDOW + 1
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(begin, count) + inside
    # within a bucket the rows come by place, so a stable sort leaves equal windows by place
    w = span_hash(prefix_hash(data), start, start + WINDOW) ^ mix(np.repeat(keys, count).astype(U64))
    at = np.repeat(places, count) + inside
    order = np.argsort(w, kind="stable")
    w, at = w[order], at[order]
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    least = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    again = at > least
    return merged(at[again], at[again] + WINDOW)


def repeated_suffixes(rows: DataFrame) -> DataFrame:
    """(at, n): windows that are not the earliest with their bytes, as spans. Buckets are sorted one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_w = last_at = None
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        count = 0

        def settle(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if not count:
                return
            keys, places = (np.concatenate(c) for c in (list(zip(*held))[:2]))
            contexts = [c for h in held for c in h[2]]
            # the last bucket may go on in the next batch; it has LEAF contexts at most
            upto = len(keys) if all_of_it else int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if upto:
                start, end = _bucket_repeats(keys[:upto], places[:upto], contexts[:upto])
                yield _rows(at=start, n=end - start)
            held = [(keys[upto:], places[upto:], contexts[upto:])]
            count = len(keys) - upto

        for batch in batches:
            whole = np.asarray(batch.column("context").is_null())
            w, at = (batch.column(c).to_numpy()[whole] for c in ("key", "at"))
            if len(w):
                new = np.ones(len(w), bool)
                new[1:] = w[1:] != w[:-1]
                new[0] = last_w is None or w[0] != last_w
                where = np.flatnonzero(new)
                least = np.concatenate((at[where], [last_at if last_at is not None else 0]))[np.cumsum(new) - 1]
                again = at > least
                if len(where):
                    last_w, last_at = int(w[-1]), int(at[where[-1]])
                start, end = merged(at[again], at[again] + WINDOW)
                yield _rows(at=start, n=end - start)
            rest = batch.filter(pa.array(~whole))
            if rest.num_rows:
                held.append((rest.column("key").to_numpy(), rest.column("at").to_numpy(), rest.column("context").to_pylist()))
                count += rest.num_rows
                if count >= 8 * LEAF:
                    yield from settle(False)
        yield from settle(True)

    return rows.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, "at long, n long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with a column ``doc`` in the order of doc_id, such that doc and byte position fit one long, and the position's bits."""
    low, high, longest = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
    bits = max(int(longest or 0).bit_length(), 7)
    if low is not None and (low < 0 or high >= 1 << (62 - bits)):
        from ledgerlens.operators.rank import dense_rank_keys
        ranks = dense_rank_keys(docs.where("doc_id is not null").select("doc_id"), "doc_id")
        name = next(c for c in ranks.columns if c != "doc_id")
        return docs.join(ranks.select("doc_id", F.col(name).cast("long").alias("doc")), "doc_id", "left"), bits
    return docs.withColumn("doc", F.col("doc_id")), bits


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) per document: the spans of bytes to remove, some of which may overlap."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, bits = _numbered(rows)
    usable = rows.where("doc is not null")
    found = cut(sorted_buckets(sampled(usable, bits)))
    several = found.where("n < 0")
    touched = cut(several.select(F.shiftright("at", bits).alias("doc")).distinct())
    spans = found.where("n > 0").select("at", "n").unionByName(repeated_suffixes(suffixes(_only(usable, touched), several, bits)))
    low = F.lit((1 << bits) - 1)
    per_doc = spans.groupBy(F.shiftright("at", bits).alias("doc")).agg(
        F.collect_list(F.struct(F.col("at").bitwiseAND(low).alias("start"), F.col("n").alias("n"))).alias("spans"))
    per_doc = cut(per_doc)
    ids = per_doc.select("doc")
    if ids.count() > BROADCAST_ROWS:
        return rows.join(per_doc, "doc", "left").select("doc_id", "text", "spans")
    # texts without a repeat need no shuffle
    without = rows.join(F.broadcast(ids), "doc", "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<start:long,n:long>>").alias("spans"))
    return _only(rows, ids).join(per_doc, "doc").select("doc_id", "text", "spans").unionByName(without)


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc is among the ids, filtered before any shuffle while the ids are few enough."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc", "left_semi")


def remove_repeats(spans: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): what is left of each document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            flat = lists.flatten()
            places, sizes = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = np.concatenate(([0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])))
            out = []
            for k, data in _documents(batch.column("text")):
                a, b = edges[k], edges[k + 1]
                start, end = merged(places[a:b], places[a:b] + sizes[a:b])
                keep = np.ones(len(data), bool)
                for s, e in zip(start, end):
                    keep[s:e] = False
                left = data[keep].tobytes()
                out.append((len(data), len(data) - len(left), len(start), hashlib.sha256(left).hexdigest(), left)[:5 if with_text else 4])
            columns = list(zip(*out)) if out else [()] * (4 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=names)

    return spans.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
