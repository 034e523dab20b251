"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, but two unrelated documents lie at a distance near
one from each other and from every document pivot, where the triangle inequality
separates nothing. So the space is cut twice:

1. Pivots of the first level are one-shingle sets. A set's nearest ones are its
   own shingles, ties ordered by rarity in the corpus (a counter sketch over all
   documents). A partner at similarity t must share one of the first
   n - ceil(t n) + 1 of them, so a set is placed in those cells and no link is lost.
2. Every cell names its most central document as pivot; cells with the same pivot
   form its Voronoi region. Coordinates of a set are its counts in 256 fixed
   parts of the shingle universe; their L1 distance never exceeds the symmetric
   difference. A region above ``LEAF`` documents is cut into shells by distance to
   its pivot, a shell into blocks; two blocks meet only where the triangle
   inequality leaves room for a link.

A first join inside each block proposes stars around leaders, one edge for each
document; they are checked on the sets, and links merge documents into classes.
A second join then proposes every pair of a region that the coordinates allow
and that is not yet in one class, and checks it too. The result is exact for the
classes, and dense groups are never expanded into all pairs. Sets are compared
by 64-bit shingle hashes, equal sets found by a 128-bit sum.

Defined results: words are white-space runs with A-Z in lower case; null, empty
and wordless texts have an empty set and link with nothing; texts of fewer words
than a shingle are one shingle; rows with a null id get a null component; rows
that repeat an id are classed by their own text; an empty table gives no rows; other
columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import connected_components, cut
from ledgerlens.llm.textops import document_runs, shingles, words_of_run
from ledgerlens.operators.rank import free_name

SKETCH_BITS = 20
PARTS = 256
LEAF = 512
#: Rows of (long, long) that may be broadcast: about 8 MB. Beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
#: Regions above LEAF documents, with coordinates, that may be broadcast: about 3 MB.
BROADCAST_REGIONS = 10_000


@dataclass(frozen=True)
class Rule:
    """Link when ``whole * intersection >= part * union`` of the sets of ``words``-word shingles."""

    words: int = 5
    part: int = 80
    whole: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.part * n // self.whole) + 1


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a column."""
    for first, _, data, offsets in document_runs(column):
        hashes, starts = words_of_run(data, offsets)
        for k, (a, b) in enumerate(zip(starts, starts[1:])):
            yield first + k, np.unique(shingles(hashes[a:b], words))


def frequency_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """2^SKETCH_BITS counters of the documents' distinct shingles, over all documents.

    A task sends its counters in 32 pieces; they are added in two steps, so no
    task holds more than the pieces of a few hundred others. 4 MB reach the driver.
    """
    size, pieces = 1 << SKETCH_BITS, 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        held: list[np.ndarray] = []

        def add() -> None:
            nonlocal total
            if held:
                total += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
                held.clear()

        for batch in batches:
            for _, s in _sets(batch.column(0), words):
                held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                if len(held) >= 2000:
                    add()
        add()
        if total.any():
            salt = int(total[:997].sum() % 16)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces)), pa.repeat(salt, pieces),
                                              pa.array([p.tobytes() for p in total.reshape(pieces, -1)])], names=["piece", "salt", "counts"])

    def summed(key, part):
        total = np.zeros(size // pieces, np.uint64)
        for c in part["counts"]:
            total += np.frombuffer(c, np.uint32)
        total = np.minimum(total, np.uint64(2 ** 32 - 1)).astype(np.uint32)  # a full counter stays full
        return pd.DataFrame({"piece": [key[0]], "salt": [0], "counts": [total.tobytes()]})

    schema = "piece long, salt long, counts binary"
    sent = docs.select("text").mapInArrow(count, schema)
    whole = sent.groupBy("piece", "salt").applyInPandas(summed, schema).groupBy("piece").applyInPandas(summed, schema)
    out = np.zeros((pieces, size // pieces), np.uint32)
    for row in whole.collect():
        out[row.piece] = np.frombuffer(row.counts, np.uint32)
    return out.reshape(-1)


def signatures(docs: DataFrame, sketch: np.ndarray, rule: Rule) -> DataFrame:
    """(doc_id, n, fp1, fp2, weight, parts, cells) per document: set size, fingerprint, centrality, coordinates, first-level cells.

    A shingle whose counter is one stands in a single document; it takes its place among the cells but is not sent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in batches:
            n, fp1, fp2, weight, parts, cells = [], [], [], [], [], []
            for _, s in _sets(batch.column("text"), rule.words):
                n.append(len(s))
                fp1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                fp2.append(int((s * (s | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)))
                if not len(s):
                    weight.append(0.0)
                    parts.append(bytes(PARTS))
                    cells.append([])
                    continue
                seen = counters[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                weight.append(float(np.log2(seen.astype(float) + 1).mean()))
                parts.append(np.minimum(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes())
                first = np.lexsort((s, seen))[:rule.prefix(len(s))]
                cells.append(s[first[seen[first] > 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()),
                 pa.array(weight, pa.float64()), pa.array(parts, pa.binary()), pa.array(cells, pa.list_(pa.int64()))],
                names=["doc_id", "n", "fp1", "fp2", "weight", "parts", "cells"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, weight double, parts binary, cells array<long>")


def regions(classes: DataFrame) -> DataFrame:
    """(pivot, id): the documents of every cell that more than one shares, under the cell's most central document.

    Cells are counted first, by key alone, so the many that one document holds are gone before ids are joined.
    """
    placed = classes.select(F.explode("cells").alias("cell"), "id")
    several = placed.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1").select("cell")
    shared = cut(placed.join(several, "cell"))
    weighed = shared.join(classes.select("id", "weight"), "id")
    centre = weighed.groupBy("cell").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("best"))
    return shared.join(centre.select("cell", (-F.col("best.id")).alias("pivot")), "cell").select("pivot", "id").distinct()


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by it. A group is a block of a region, so its size is bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16)


def _near(x: np.ndarray, nx: int, others: np.ndarray, n: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether the coordinates allow a link: sizes within the ratio, L1 within the largest symmetric difference."""
    size = (rule.whole * np.minimum(n, nx) >= rule.part * np.maximum(n, nx))
    out = np.zeros(len(n), bool)
    k = np.flatnonzero(size)
    if len(k):
        l1 = np.abs(others[k] - x).sum(1, dtype=np.int64)
        out[k] = (rule.whole + rule.part) * l1 <= (rule.whole - rule.part) * (n[k] + nx)
    return out


def _pair_frame(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def block_stars(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): in each block, leaders by centrality and the documents that the coordinates allow beside them; one edge each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "block"):
            if group.num_rows < 2:
                continue
            ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
            at = _matrix(group.column("parts"))
            open_ = np.lexsort((ids, -group.column("weight").to_numpy()))
            a, b = [], []
            while len(open_) > 1:
                lead, open_ = open_[0], open_[1:]
                near = _near(at[lead], n[lead], at[open_], n[open_], rule)
                a += ids[open_[near]].tolist()
                b += [int(ids[lead])] * int(near.sum())
                open_ = open_[~near]
            if a:
                yield _pair_frame(a, b)

    placed = rows.repartition("block").sortWithinPartitions("block")
    return placed.select("block", "id", "n", "weight", "parts").mapInArrow(run, "a long, b long").distinct()


def block_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): of each meeting of two blocks, the pairs that the coordinates allow and that are not in one class yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "meeting"):
            guest = group.column("guest").to_numpy(zero_copy_only=False)
            ids, n, found = (group.column(c).to_numpy() for c in ("id", "n", "component"))
            if (found == found[0]).all():
                continue
            at = _matrix(group.column("parts"))
            home, others = np.flatnonzero(~guest), np.flatnonzero(guest)
            a, b = [], []
            for i, k in enumerate(home):
                # a block that meets itself has no guests; each pair is seen once
                rest = others if len(others) else home[i + 1:]
                rest = rest[(found[rest] != found[k])]
                near = rest[_near(at[k], n[k], at[rest], n[rest], rule)]
                a += ids[near].tolist()
                b += [int(ids[k])] * len(near)
            if a:
                yield _pair_frame(a, b)

    placed = rows.repartition("meeting").sortWithinPartitions("meeting")
    return placed.select("meeting", "guest", "id", "n", "component", "parts").mapInArrow(run, "a long, b long").distinct()


def linked(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) whose sets link, checked on the whole sets."""
    pairs = cut(pairs)
    count = pairs.count()
    small = count <= BROADCAST_ROWS

    def sets_of(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = [s.view(np.int64) for _, s in _sets(part.column("text"), rule.words)]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

        chosen = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if small else ids, "id")
        return chosen.mapInArrow(run, "id long, s array<long>")

    left = sets_of(pairs.select(F.col("a").alias("id")).distinct()).withColumnRenamed("s", "sa")
    wide = left.join(F.broadcast(pairs) if small else pairs, F.col("id") == F.col("a")).select("a", "b", "sa")
    right = sets_of(pairs.select(F.col("b").alias("id")).distinct()).select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = wide.join(right.hint("merge"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.lit(rule.whole) * F.col("i") >= F.lit(rule.part) * (F.size("sa") + F.size("sb") - F.col("i"))).select(
        F.col("a").alias("u"), F.col("b").alias("v"))


def _shells(members: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(pivot, id, n, weight, shell, far, window, part, block): a region of at most LEAF documents is one block.

    Only the larger regions need distances to the pivot, so only their members carry coordinates here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16)
                           for c in ("parts", "pivot_parts"))
            far = np.abs(mine - pivot).sum(1, dtype=np.int64)
            keep = [c for c in batch.schema.names if c not in ("parts", "pivot_parts")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(far)], names=[*keep, "far"])

    # Large regions are few, LEAF documents make one; while they are, no join deals a region's rows by its pivot.
    large = cut(members.groupBy("pivot").agg(F.count("*").alias("k")).where(F.col("k") > LEAF).select("pivot"))
    few = large.count() <= BROADCAST_REGIONS
    beside = F.broadcast if few else (lambda x: x)
    wide = members.join(classes.select("id", "n", "weight"), "id").join(beside(large.withColumn("large", F.lit(True))), "pivot", "left")
    zero = F.lit(0).cast("long")
    small = wide.where("large is null").select("pivot", zero.alias("shell"), "id", "n", "weight", zero.alias("far"), zero.alias("window"), zero.alias("part"))
    block = F.xxhash64("pivot", "shell", "part").alias("block")
    reach = F.lit((rule.whole - rule.part) / (rule.whole + rule.part) * (1 + rule.whole / rule.part))
    big = wide.where("large").select("pivot", "id", "n", "weight").join(classes.select("id", "parts"), "id")
    pivots = classes.select(F.col("id").alias("pivot"), F.col("parts").alias("pivot_parts"), F.col("n").alias("pivot_n")).join(beside(large), "pivot")
    big = big.join(beside(pivots), "pivot").select("pivot", "id", "n", "weight", "pivot_n", "parts", "pivot_parts")
    big = big.mapInArrow(run, "pivot long, id long, n long, weight double, pivot_n long, far long")
    big = cut(big.select("pivot", "id", "n", "weight", "far", F.ceil(reach * F.col("n")).cast("long").alias("window"),
                         F.floor(F.col("far") / F.greatest(F.ceil(reach * F.col("pivot_n")), F.lit(1))).cast("long").alias("shell")))
    counts = big.groupBy("pivot", "shell").agg(F.count("*").alias("k"))
    big = big.join(beside(counts), ["pivot", "shell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / LEAF))).drop("k")
    return big.unionByName(small).select("*", block)


def _meetings(placed: DataFrame) -> DataFrame:
    """(meeting, block, guest): which blocks of a region meet, by the triangle inequality on distances to the pivot."""
    blocks = placed.groupBy("pivot", "shell", "part", "block").agg(
        F.min("far").alias("near"), F.max("far").alias("far"), F.max("window").alias("window"),
        F.min("component").alias("c1"), F.max("component").alias("c2"))
    mine, other = blocks.alias("x"), blocks.alias("y")
    pairs = mine.join(other, F.col("x.pivot") == F.col("y.pivot")).where(
        "(x.shell < y.shell or (x.shell = y.shell and x.part <= y.part)) and y.near - y.window <= x.far "
        "and not (x.c1 = x.c2 and y.c1 = y.c2 and x.c1 = y.c1)")
    key = F.xxhash64("x.block", "y.block").alias("meeting")
    home = pairs.select(key, F.col("x.block").alias("block"), F.lit(False).alias("guest"))
    return home.unionByName(pairs.where("x.block <> y.block").select(key, F.col("y.block").alias("block"), F.lit(True).alias("guest")))


def _labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    return rows.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))


def jaccard_classes(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document: the smallest doc_id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(signatures(docs, frequency_sketch(docs, rule.words), rule))
    same = ["fp1", "fp2", "n"]
    usable = signed.where("n > 0 and doc_id is not null")
    least = cut(usable.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count("*").alias("k")))
    # The other members of a class take its result; a class is represented by its smallest id.
    others = usable.select("doc_id", *same).join(least.where("k > 1").drop("k"), same).where("doc_id <> id").select("doc_id", "fp1").distinct()
    others = cut(others)
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    classes = usable.join(others, ["doc_id", "fp1"], "left_anti").select(F.col("doc_id").alias("id"), "n", "weight", "parts", "cells")
    placed = cut(_shells(cut(regions(classes)), classes, rule))
    parts = classes.select("id", "parts")
    first = cut(linked(block_stars(placed.select("block", "id", "n", "weight").join(parts, "id"), rule), docs, rule))
    named = cut(_labelled(placed.drop("weight"), connected_components(first)))
    met = named.select("block", "id", "n", "component").join(_meetings(named), "block")
    second = cut(linked(block_pairs(met.join(parts, "id"), rule), docs, rule))
    final = connected_components(first.unionByName(second)) if second.head(1) else connected_components(first)
    named = _labelled(least.drop("k"), final).select(*same, F.col("component").alias("component_id"))
    return signed.select("doc_id", *same).join(named, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _anti(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")


def keep_one(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with the smallest id; columns stay. Rows with a null id or an empty set stay.

    Where ids repeat, each row is judged by its own text, under a row number that
    the frame is written with first: of rows that share id and class one stays, and
    a text of its own stays whatever became of another row with its id.
    """
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    if not ids.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").head(1):
        found = cut(jaccard_classes(docs, rule, id_col, text_col))
        return _anti(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), id_col)
    row = free_name(docs, "_row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    named = numbered.where(F.col(id_col).isNotNull())
    found = jaccard_classes(named.select(row, text_col), rule, row, text_col).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    placed = cut(found.join(named.select(F.col(row).alias("row"), F.col(id_col).alias("id")), "row"))
    kept = placed.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    gone = cut(placed.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row)))
    return _anti(numbered, gone, row).drop(row)
