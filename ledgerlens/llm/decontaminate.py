"""Benchmark decontamination by spaced-seed hashing.

A fixed mask selects token positions of a span and ignores the others. Test items
and documents are hashed under every mask at every position; equal hashes place
an item beside a document (a diagonal), and the tokens around the hit are
compared one by one. A document leaks an item when some stretch of ``WINDOW``
item tokens (the whole of a shorter item) agrees in at least 80 % of its tokens.
The masks hit every stretch of 20 tokens with up to four substitutions; items of
fewer than 20 tokens have a short mask more, with the same guarantee.

A benchmark of at most ``BROADCAST_TOKENS`` tokens (counted first) goes to every
task as sorted hash arrays, so documents are read once and never shuffled. A
larger one is joined by hash in a shuffle; both ways share seeds and check.

Defined results: tokens are white-space runs with A-Z in lower case; null and
empty texts hold nothing and leak nothing; items under ``MIN_TOKENS`` tokens are
too short to tell a leak and never match; repeated items count under each id;
null ids are kept for documents and dropped for items; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import cut
from ledgerlens.llm.textops import BASE, document_runs, mix, words_of_run
from ledgerlens.operators.rank import free_name

#: Fixed masks, weight 7: any 20 positions with 4 mismatches hold one of them (tests/llm/test_decontaminate.py).
MASKS = ((0, 1, 2, 4, 5, 6, 7), (0, 2, 5, 8, 10, 11, 12), (0, 1, 3, 4, 7, 8, 9), (0, 2, 4, 6, 9, 10, 11), (0, 1, 2, 3, 5, 10, 14))
SHORT_MASK = (0, 1, 2)
WINDOW = 20
AGREE = 0.8
MIN_TOKENS = 8
BROADCAST_TOKENS = 2_000_000
FILTER_BITS = 22


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the mask's positions at every start."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, sum((k + 1) * 31 ** i for i, k in enumerate(mask)) & 0xFFFFFFFF, np.uint64)
    for k in mask:
        out = out * np.uint64(BASE) + words[k:k + n]
    return mix(out)


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    return MASKS if n >= WINDOW else (*MASKS, SHORT_MASK)


def item_tokens(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in document_runs(pa.array(texts, pa.string())):
        words, first = words_of_run(data, offsets)
        out += [words[a:b] for a, b in zip(first, first[1:])]
    return out


def agreement(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(agreeing tokens, first, end) of the best stretch of the item laid at ``diagonal``; first and end in doc tokens."""
    size = min(WINDOW, len(item))
    begin, end = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if end - begin < size:
        return 0, 0, 0
    same = doc[begin + diagonal:end + diagonal] == item[begin:end]
    sums = np.concatenate(([0], np.cumsum(same)))
    windows = sums[size:] - sums[:-size]
    best = int(windows.max())
    good = np.flatnonzero(windows >= leak_at(size))
    if not len(good):
        return best, 0, 0
    return best, begin + diagonal + int(good[0]), begin + diagonal + int(good[-1]) + size


def leak_at(size: int) -> int:
    return -(-size * 8 // 10)


class Index:
    """Sorted seed hashes of the items, with their item and position."""

    def __init__(self, ids: list[int], tokens: list[np.ndarray]):
        keep = [k for k, t in enumerate(tokens) if len(t) >= MIN_TOKENS]
        self.ids, self.tokens = [ids[k] for k in keep], [tokens[k] for k in keep]
        self.masks = (*MASKS, SHORT_MASK)
        self.tables = []
        for mask in self.masks:
            hashes = [seed_hashes(t, mask) if mask in masks_of(len(t)) else np.zeros(0, np.uint64) for t in self.tokens]
            owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(flat >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((flat[order], owner[order], place[order], bits))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, diagonal offset) of every seed shared with an item."""
        found = []
        for mask, (flat, owner, place, bits) in zip(self.masks, self.tables):
            if not len(flat):
                continue
            h = seed_hashes(words, mask)
            at = np.flatnonzero(bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            left, right = np.searchsorted(flat, h[at], "left"), np.searchsorted(flat, h[at], "right")
            count = right - left
            at, left, count = at[count > 0], left[count > 0], count[count > 0]
            row = np.repeat(left - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(at) else left
            pos = np.repeat(at, count)
            found.append((pos, owner[row], pos - place[row]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


LEAKS = "array<struct<item_id:long,agree:int,start:int,end:int>>"
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("agree", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _best(found: list[tuple[int, int, int, int]]) -> list[dict]:
    """One entry per item: its best stretch, the first of equals."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for f in found:
        if f[0] not in best or (-f[1], f[2]) < (-best[f[0]][1], best[f[0]][2]):
            best[f[0]] = f
    return [dict(zip(("item_id", "agree", "start", "end"), best[k])) for k in sorted(best)]


def _leaks_by_broadcast(rows: DataFrame, items: list) -> DataFrame:
    ids, texts = [r[0] for r in items], [r[1] for r in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(ids, item_tokens(texts))
        for batch in batches:
            for first, last, data, offsets in document_runs(batch.column("text")):
                words, starts = words_of_run(data, offsets)
                pos, item, diagonal = index.hits(words)
                doc = np.searchsorted(starts, pos, "right") - 1
                # a seed that began in one document may end in the next; the check below sees one document only
                cases = np.unique(np.column_stack((doc, item, diagonal)), axis=0) if len(pos) else np.zeros((0, 3), np.int64)
                found: list[list] = [[] for _ in range(last - first)]
                for d, i, g in cases.tolist():
                    own, item_words = words[starts[d]:starts[d + 1]], index.tokens[i]
                    best, a, b = agreement(own, item_words, g - int(starts[d]))
                    if b > a:
                        found[d].append((index.ids[i], best, a, b))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array([_best(f) for f in found], _LEAKS)],
                                                 names=["doc_id", "leaks"])

    return rows.mapInArrow(run, f"doc_id long, leaks {LEAKS}")


def _seeds(rows: DataFrame, id_name: str, only_items: bool) -> DataFrame:
    """(id, hash, pos): every seed of every text; ``only_items`` leaves out short texts and their needless masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in document_runs(batch.column("text")):
                words, starts = words_of_run(data, offsets)
                for d, (a, b) in enumerate(zip(starts, starts[1:])):
                    if only_items and b - a < MIN_TOKENS:
                        continue
                    for mask in masks_of(b - a) if only_items else (*MASKS, SHORT_MASK):
                        h = seed_hashes(words[a:b], mask)
                        yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(id_name)[first + d], len(h)), pa.array(h.view(np.int64)),
                                                          pa.array(np.arange(len(h), dtype=np.int64))], names=["id", "hash", "pos"])

    return rows.mapInArrow(run, "id long, hash long, pos long")


def _leaks_by_shuffle(rows: DataFrame, items: DataFrame) -> DataFrame:
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # written, so that no lost task numbers its rows anew
    mine = _seeds(rows.select("row", "text"), "row", False)
    theirs = _seeds(items.select("item_id", "text"), "item_id", True).withColumnRenamed("id", "item_id").withColumnRenamed("pos", "item_pos")
    cases = mine.join(theirs, "hash").select(F.col("id").alias("row"), "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()

    @F.pandas_udf("struct<agree:int,start:int,end:int>")
    def check(doc, item, diagonal):
        import pandas as pd
        out = []
        for d, i, g in zip(doc, item, diagonal):
            a, b = item_tokens([d, i])
            out.append(agreement(a, b, g))
        return pd.DataFrame(out, columns=["agree", "start", "end"])

    texts = items.select("item_id", F.col("text").alias("item_text")).distinct()
    found = (cases.join(texts, "item_id").join(rows.select("row", "text"), "row")
             .select("row", "item_id", check("text", "item_text", "diagonal").alias("c")).where("c.end > c.start"))
    best = found.groupBy("row", "item_id").agg(F.min(F.struct((-F.col("c.agree")).alias("k"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))).alias("b"))
    leaks = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "item_id", (-F.col("b.k")).alias("agree"), F.col("b.start").alias("start"), F.col("b.end").alias("end")))).alias("leaks"))
    return rows.select("row", "doc_id").join(leaks, "row", "left").select(
        "doc_id", F.coalesce("leaks", F.array().cast(LEAKS)).cast(LEAKS).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(doc_id, leaks) per document: the items it holds, with the agreeing stretch in document tokens."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and length(text) > 0")
    # an upper bound of the tokens, by characters: a token takes two at least, with its space
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size <= 2 * broadcast_tokens:
        return _leaks_by_broadcast(rows, items.collect())
    return _leaks_by_shuffle(rows, items)


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; columns stay. Without a row id of its own, a document is judged by its text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and length(text) > 0")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 2 * BROADCAST_TOKENS:
        row = free_name(docs, "_row")
        numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        bad = _leaks_by_shuffle(numbered.select(F.col(row).alias("doc_id"), "text"), items).where("size(leaks) > 0")
        return numbered.join(bad.select(F.col("doc_id").alias(row)), row, "left_anti").drop(row)
    pairs = items.collect()
    ids, texts = [r[0] for r in pairs], [r[1] for r in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(ids, item_tokens(texts))
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, _, data, offsets in document_runs(batch.column("text")):
                words, starts = words_of_run(data, offsets)
                pos, item, diagonal = index.hits(words)
                doc = np.searchsorted(starts, pos, "right") - 1
                for d, i, g in set(zip(doc.tolist(), item.tolist(), diagonal.tolist())):
                    if keep[first + d]:
                        _, a, b = agreement(words[starts[d]:starts[d + 1]], index.tokens[i], g - int(starts[d]))
                        keep[first + d] = b <= a
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
