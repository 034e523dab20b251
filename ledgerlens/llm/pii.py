"""Personal data: base patterns and information-theoretic sanitisation.

Base spans (email, ip, card, phone) are protected entities. Corpus co-occurrence
says how much a term near an entity tells about it: with the share of documents
that hold the term, the entity, and the entity with that term beside it, the
pointwise mutual information is set against the entity's own information. A term
that discloses at least ``generalise_at`` of it, seen in at least ``min_joint``
documents, becomes a span of kind ``term``; it is generalised to its shape, or
removed from ``remove_at`` on.

Counts cover all documents. A document passes its distinct words, summed in the
task before the shuffle, so a hot word moves one row per task.

A term is a word of any length without the punctuation at its edges. Only the
lower-case function words of FUNCTION_WORDS, all under four letters, are no terms.

Defined results: a null text is empty; repeated rows count as documents of their
own; a null doc_id is kept; an empty table gives no rows; equal shares count as
reached; a long text is read whole, in time that grows with its length and its number
of entities; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import cut
from ledgerlens.llm.textops import document_runs, lower_ascii, map_texts, prefix_hash, span_hash, word_bounds

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "term")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: a later start is never further left.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
REACH = 8
#: Lower-case function words of English, German, French and Spanish under four letters; they name nobody.
FUNCTION_WORDS = frozenset(
    "a an the at by to of in on or and as is be am are was has had it its he she his her him we us our my me you i if so no not but for do did can may up out off "
    "der die das den dem des ein und im am an zu von vom mit auf aus bei bis ist er sie es ich wir ihr um für zur zum als wie so ob wo "
    "le la les un une de du des et en au aux ou où à il on ce ces se sa son ses ne pas par est que qui sur "
    "el los las uno una del al y o e u con por sin su sus lo si se no es que más mi tu".split())
#: Punctuation that is cut from the edges of a word: ASCII, and what Latin and Chinese texts add.
PUNCTUATION = "".join(chr(c) for a, b in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xA1, 0xA1), (0xAB, 0xAB), (0xB7, 0xB7), (0xBB, 0xBB),
                                          (0xBF, 0xBF), (0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3003), (0x3008, 0x3011), (0xFF01, 0xFF0F),
                                          (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)) for c in range(a, b + 1))
_CODES = {n: np.array(sorted(int.from_bytes(c.encode()) for c in PUNCTUATION if len(c.encode()) == n)) for n in (1, 2, 3)}
_LEADS = {n: np.isin(np.arange(256), [c.encode()[0] for c in PUNCTUATION if len(c.encode()) == n]) for n in (1, 2, 3)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then start."""
    if not text:
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) < 256 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def entity_key(kind: str, value: str) -> str:
    """Spellings of one entity share a key: letter case of emails, separators of numbers."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def _lower(word: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in word)


def hash_words(words: list[str]) -> list[int]:
    """The same 64-bit hashes that the corpus counts use, as signed longs."""
    if not words:
        return []
    raw = [_lower(w).encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    return span_hash(prefix_hash(data), starts, starts + sizes).view(np.int64).tolist()


def _near(text: str, spans: list[tuple[str, int, int]]) -> list[tuple]:
    """(entity, term, start, end) of the words within REACH words of each span; words that touch a span are left out."""
    covered = sorted((s, e) for _, s, e in spans)
    starts = [s for s, _ in covered]
    reach = list(itertools.accumulate((e for _, e in covered), max))
    words = [m.span() for m in _WORD.finditer(text)]
    begins = [a for a, _ in words]
    out: list[tuple[str, str, int, int]] = []
    for kind, s, e in spans:
        key = entity_key(kind, text[s:e])
        first = max(bisect.bisect_left(begins, s) - 1 - REACH, 0)  # the word before the span, and REACH more
        last = bisect.bisect_left(begins, e) + REACH
        for begin, end in words[first:last]:
            upto = bisect.bisect_left(starts, end)
            if upto and reach[upto - 1] > begin:  # touches a span
                continue
            word = text[begin:end]
            term = word.strip(PUNCTUATION)
            if term and term not in FUNCTION_WORDS:
                start = begin + len(word) - len(word.lstrip(PUNCTUATION))
                out.append((key, term, start, start + len(term)))
    return out


CONTEXTS = "array<struct<entity:string,term:long,start:int,end:int>>"
BASE = "array<struct<kind:string,start:int,end:int>>"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, base, contexts): base spans and the hashed words near them; row tells repeated rows apart."""

    def one(text: str | None) -> tuple:
        base = base_spans(text)
        near = _near(text, base) if base else []
        terms = hash_words([n[1] for n in near])
        return ([{"kind": k, "start": s, "end": e} for k, s, e in base],
                [{"entity": n[0], "term": t, "start": n[2], "end": n[3]} for n, t in zip(near, terms)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, ["doc_id"], "text", one, f"base {BASE}, contexts {CONTEXTS}")


def _terms_of_run(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words without the punctuation at their edges, document of each)."""
    low = lower_ascii(data)
    starts, ends = word_bounds(low)
    mark = _LEADS[1][low]
    for n in (2, 3):
        at = np.flatnonzero(_LEADS[n][low])
        at = at[at + n <= len(low)]
        code = np.zeros(len(at), np.int64)
        for i in range(n):
            code = code << 8 | low[at + i]
        at = at[np.isin(code, _CODES[n])]
        for i in range(n):
            mark[at + i] = True
    plain = np.flatnonzero(~mark)
    first, last = np.searchsorted(plain, starts), np.searchsorted(plain, ends)
    held = last > first  # words of punctuation alone go
    starts, ends = plain[first[held]], plain[last[held] - 1] + 1
    return span_hash(prefix_hash(low), starts, ends), np.searchsorted(offsets, starts, "right") - 1


def word_document_counts(docs: DataFrame, text_col: str = "text", hold: int = 1 << 20) -> DataFrame:
    """(term, n): in how many documents each word stands, without the punctuation at its edges. Words are summed in the task, ``hold`` at a time at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def merge() -> None:
            nonlocal terms, counts
            new = np.concatenate(fresh) if fresh else np.zeros(0, np.uint64)
            fresh.clear()
            terms, where = np.unique(np.concatenate((terms, new)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, np.ones(len(new), np.int64))), len(terms)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "n"])

        for batch in batches:
            for _, _, data, offsets in document_runs(batch.column(0)):
                words, owner = _terms_of_run(data, offsets)
                order = np.lexsort((words, owner))
                w, o = words[order], owner[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
                fresh.append(w[new])
                if sum(map(len, fresh)) >= hold:
                    merge()
                    if len(terms) >= 4 * hold:
                        yield out()
                        terms, counts = terms[:0], counts[:0]
        merge()
        yield out()

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_pairs(scanned: DataFrame, docs: DataFrame, text_col: str = "text", generalise_at: float = 0.8,
                     min_joint: int = 2) -> DataFrame:
    """(entity, term, share): terms that disclose at least ``generalise_at`` of an entity's information."""
    near = scanned.select("row", F.explode("contexts").alias("c")).select("row", "c.entity", "c.term").distinct()
    joint = near.groupBy("entity", "term").agg(F.count("*").alias("n_joint")).where(F.col("n_joint") >= min_joint)
    entities = near.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = scanned.agg(F.count("*")).first()[0]
    n = F.lit(float(max(total, 1)))
    out = joint.join(entities, "entity").join(word_document_counts(docs, text_col).withColumnRenamed("n", "n_term"), "term")
    # An entity in every document carries no information; nothing discloses it.
    own = F.log2(n / F.col("n_entity"))
    pmi = F.log2(F.col("n_joint") * n / (F.col("n_entity") * F.col("n_term")))
    share = F.when(own > 0, pmi / own).otherwise(F.lit(0.0))
    return out.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise_at)


SPANS = "array<struct<kind:string,start:int,end:int,share:double>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = 0.8,
                       min_joint: int = 2) -> DataFrame:
    """(doc_id, spans): base spans by kind and start, then term spans with the share they disclose."""
    scanned = cut(scan_documents(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    pairs = disclosing_pairs(scanned, docs, text_col, generalise_at, min_joint)
    found = (scanned.select("row", F.explode("contexts").alias("c")).select("row", "c.*").join(pairs, ["entity", "term"])
             .groupBy("row", "start", "end").agg(F.max("share").alias("share"))
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("double").alias("share")))
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["share"].alias("share")))
    empty = F.array().cast(SPANS)
    return scanned.join(found, "row", "left").select("doc_id", F.concat(base, F.coalesce(terms, empty)).alias("spans"))


def shape(word: str) -> str:
    """A term generalised to its shape: letters and digits by class, runs shortened."""
    return re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word))


def sanitise(text: str | None, spans: list, remove_at: float = 0.95) -> str | None:
    """The text with base spans as [KIND] and terms by shape, or removed from ``remove_at`` on; null stays null."""
    if not text:
        return text
    parts, at = [], 0
    for kind, start, end, share in sorted((tuple(s) for s in spans), key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]" if kind != "term" else "" if share >= remove_at else shape(text[start:end])]
        at = max(at, end)
    return "".join(parts) + text[at:]
