"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The normaliser (prefix, white space as a visible mark), the pieces and the byte
fallback are compiled once, on the driver, from a model file; the tables are
bounded by the vocabulary. Composed with a text, a state is (position, last
piece); arcs are pieces, and the path of least weight is the encoding:

* unigram models: an arc weighs minus the piece's score (tropical semiring);
* BPE models: an arc weighs minus the score where the piece may follow the last
  one, and infinity where merging in score order would not leave the two side
  by side. Exactly one path of finite weight remains, and it is the BPE encoding.

White space and characters that no longer piece holds cut a text into parts that
share no arc; the paths of distinct parts are found once per batch, in sorted
order, so that parts with a common prefix share its states.

Defined results: a null or empty text has no ids and decodes to an empty text;
characters without a piece become bytes, so decoding gives the text back, but
that U+2581 in a text comes back as a space; repeated rows are encoded each;
null ids pass; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.textops import byte_views

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = 1 << 60
KEPT_PARTS = 150_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = raw[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, raw[at:at + size]
        at += size


class Compiled:
    """Tables of a model file: pieces by string and id, merge splits, and the parts pattern."""

    def __init__(self, model: bytes):
        self.kind, self.fallback = UNIGRAM, False
        self.prefix, self.squeeze = True, True
        pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("only the identity normaliser is supported")
        if self.kind not in (UNIGRAM, BPE) or any(k == USER for _, _, k in pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.strings = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN, UNUSED) else p.replace(MARK, " ").encode()
                    for p, _, k in pieces]
        self.low = min((s for _, s, k in pieces if k == NORMAL), default=0.0) - 10.0
        self.rank: dict[str, int] = {}
        self.split: dict[str, tuple[str, str]] = {}
        if self.kind == BPE:
            order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-self.scores[self.ids[p]], self.ids[p]))
            self.rank = {p: i for i, p in enumerate(order)}
            for p in order:
                merged, last = self._merge(p)
                if merged == [p]:
                    self.split[p] = last
        self.usable = {p for p in self.ids if len(p) == 1 or self.kind == UNIGRAM or p in self.split}
        # The pieces of two characters or more, read from their end: a state per common suffix.
        self.suffixes: dict = {}
        for p in self.usable:
            if len(p) > 1:
                node = self.suffixes
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = p
        # Characters side by side in some piece are of one group; parts are runs of one group
        # behind white space. With pieces across white space, the text is one part.
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                c = group[c]
            return c

        for p in self.usable:
            body = p.lstrip(MARK)
            for a, b in zip(body, body[1:]):
                group[root(a)] = root(b)
            if len(p) > len(body) == 1:
                root(body)
        runs: dict[str, list[str]] = {}
        for c in list(group):
            runs.setdefault(root(c), []).append(c)
        largest = sorted(("".join(sorted(g)) for g in runs.values()), key=lambda g: (-len(g), g))
        spans = any(MARK in p.lstrip(MARK) for p in self.usable)
        self.pattern = (".+" if spans or not runs else
                        rf"{MARK}*(?:{'|'.join('[' + re.escape(g) + ']+' for g in largest)})|{MARK}+|.")

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """Greedy merging in score order, leftmost first; the symbols left and the last pair merged."""
        symbols, last = list(text), ("", "")
        while len(symbols) > 1:
            best = min((self.rank.get(a + b, INFINITE), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best[0] == INFINITE:
                break
            k = best[1]
            last = symbols[k], symbols[k + 1]
            symbols[k:k + 2] = [last[0] + last[1]]
        return symbols, last

    def follows(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b in score order leaves a and b side by side.

        The merges that made a and b are undone, latest first; at each step the
        two symbols at the border must not merge before the undone merge does.
        """
        limit, left_side = INFINITE, True
        while True:
            rank = self.rank.get(a + b, INFINITE)
            if rank < limit or (rank == limit and not left_side and rank < INFINITE):
                return False
            ra, rb = self.rank.get(a, -1) if len(a) > 1 else -1, self.rank.get(b, -1) if len(b) > 1 else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of equal merges the right one is the later
                limit, left_side, a = ra, True, self.split[a][1]
            else:
                limit, left_side, b = rb, False, self.split[b][0]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)


class Encoder:
    """Shortest paths over a compiled model; keeps the paths of recent parts and of piece pairs."""

    def __init__(self, model: Compiled):
        self.model = model
        self.parts = re.compile(model.pattern, re.S)
        self.paths: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _single(self, c: str) -> list[int]:
        m = self.model
        if (i := m.ids.get(c)) is not None:
            return [i]
        return [m.bytes[b] for b in c.encode()] if m.fallback else [m.unknown]

    def _follows(self, a: str, b: str) -> bool:
        if len(self.pairs) > KEPT_PARTS:
            self.pairs.clear()
        known = self.pairs[a, b] = self.model.follows(a, b)
        return known

    def solve(self, parts: list[str]) -> None:
        """Find the paths of sorted, distinct parts; states of a shared prefix are kept from part to part."""
        m = self.model
        bpe = m.kind == BPE
        suffixes, ids, scores, pairs, paths, pack = m.suffixes, m.ids, m.scores, self.pairs, self.paths, struct.pack
        before = ""
        last: list[str] = [""]
        cost: list[float] = [0.0]
        for part in parts:
            keep, most = 0, min(len(before), len(part))
            while keep < most and before[keep] == part[keep]:
                keep += 1
            del last[keep + 1:], cost[keep + 1:]
            for j in range(keep + 1, len(part) + 1):
                piece = c = part[j - 1]
                node = suffixes.get(c)
                i = j - 1
                if bpe:
                    while node and i:
                        i -= 1
                        node = node.get(part[i])
                        if node and (t := node.get("")):
                            pair = (last[i], t)
                            if not i or (pairs[pair] if pair in pairs else self._follows(*pair)):
                                piece = t
                                break
                else:
                    least = cost[j - 1] - (scores[ids[c]] if c in ids else m.low)
                    while node and i:
                        i -= 1
                        node = node.get(part[i])
                        if node and (t := node.get("")) and cost[i] - scores[ids[t]] < least:
                            least, piece = cost[i] - scores[ids[t]], t
                    cost.append(least)
                last.append(piece)
            before = part
            path: list[int] = []
            j = len(part)
            while j:
                piece = last[j]
                path += [ids[piece]] if len(piece) > 1 else self._single(piece)[::-1]
                j -= len(piece)
            path.reverse()
            paths[part] = pack(f"={len(path)}i", *path)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        cut = [self.parts.findall(self.model.normalise(t)) if t else [] for t in texts]
        seen = set(chain.from_iterable(cut))
        fresh = seen.difference(self.paths)
        if len(self.paths) + len(fresh) > KEPT_PARTS:
            self.paths.clear()
            fresh = seen
        self.solve(sorted(fresh))
        get = self.paths.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()


def decode_ids(model: Compiled, ids: list[int]) -> str:
    """The text of ids; bytes that are not UTF-8 become replacement characters, unknown and control ids nothing."""
    text = b"".join(map(model.raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def compile_model(path: str) -> Compiled:
    with open(os.fspath(path), "rb") as file:
        return Compiled(file.read())


def encode(docs: DataFrame, model: Compiled, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False,
           slice_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, ids) per document, and with ``decoded`` the text that the ids give back. Nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            _, first, last = byte_views(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size + last[end] - first[end] < slice_bytes):
                    size += last[end] - first[end]
                    end += 1
                found = encoder.encode_all(batch.column("text").slice(at, end - at).to_pylist())
                values = np.frombuffer(b"".join(found), np.int32)
                offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
                columns = [batch.column("doc_id").slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
                if decoded:
                    columns.append(pa.array([decode_ids(model, np.frombuffer(f, np.int32).tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][:len(columns)])
                at = end

    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: Compiled, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``text`` decoded from their ids; null ids decode to an empty text, ids out of range fail."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([decode_ids(model, [] if x is None else list(x)) for x in ids], dtype=object)

    return encoded.withColumn("text", text(F.col(ids_col)))


def path_weight(model: Compiled, ids: list[int]) -> float:
    """The tropical weight of a path: minus the sum of its scores, bytes at the lowest."""
    return -math.fsum(model.low if model.strings[i] not in model.ids else model.scores[i] for i in ids)
