"""Secret scans with a guess-cost model of credential values.

Base patterns (assignments, access key ids, long hex runs) are found over the
whole text. The method adds values in further credential contexts (``pwd``,
``passphrase``, ``bearer`` ...), and those behind the base names that the base
alphabet does not read to their end (its own span stays): a value counts when the
cheapest way to guess it, as a segmentation into words, dates, repeats, keyboard
walks and brute-force spans, costs at least ``min_log10_guesses``. ``bearer`` may
be followed by spaces alone; a plain word after it is prose, not a value. The cost is found by dynamic
programming over the value, left to right, with spans of bounded length, so it
is linear in the value's length. Words come from a ranked lexicon: the password
words, and after them a public vocabulary or the corpus's own frequent words, so
that a plain word behind a credential name is cheap to guess and no secret.

Defined results: a null text is empty; an empty text or table has no secrets;
repeated rows are scanned each on its own; a null doc_id is kept; other columns
of the input are ignored by ``find_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.textops import map_texts, rewrite_texts

KINDS = ("assign", "access", "hex", "cred")
MIN_LOG10_GUESSES = 8.0

# The credential names of the base pattern.
BASE_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Names that the method adds.
MORE_NAMES = ("pwd", "pass", "passphrase", "passcode", "credential", "credentials", "auth", "bearer",
              "private_key", "access_key", "client_key", "auth_key")

_VALUE = re.compile(r"""\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_LOOSE_VALUE = re.compile(r"""\x20*["']?([^\s"',;<>]{6,})""")
_BEARER = re.compile(r"""(?<![^\W_])(?i:bearer)\x20+["']?(?![:=])([^\s"',;<>]{6,})""")
_PROSE = re.compile(r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*[^\w\s]*")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAME_END = 16

#: Frequent password words, most frequent first; a word's rank is its guess count.
WORDS = ("password", "admin", "welcome", "login", "letmein", "dragon", "monkey", "master", "sunshine", "shadow",
         "football", "baseball", "princess", "qwerty", "secret", "love", "iloveyou", "hello", "freedom", "whatever",
         "trustno", "superman", "batman", "user", "test", "guest", "root", "pass", "changeme", "default", "summer",
         "winter", "spring", "autumn", "monday", "friday", "money", "coffee", "flower", "cookie", "server", "system",
         "access", "computer", "internet", "public", "private", "example", "sample", "demo", "temp", "token", "key")
LEET = str.maketrans("01345$@7", "oieassat")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEIGHBOURS = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
SEGMENT_COST = 0.3
MAX_SPAN = 32


@dataclass(frozen=True)
class Lexicon:
    """Words that a guesser tries, by rank: a word's rank is its guess count."""

    ranks: dict[str, int]

    @functools.cached_property
    def lengths(self) -> list[int]:
        return sorted({len(w) for w in self.ranks}, reverse=True)


def lexicon(words: Iterable[str] = (), size: int = 60_000) -> Lexicon:
    """The password words, then at most ``size`` of ``words`` (most frequent first), lower-cased; the first place of a word counts."""
    ranks: dict[str, int] = {}
    for w in itertools.chain(WORDS, itertools.islice(words, size)):
        ranks.setdefault(w.lower(), len(ranks) + 2)
    return Lexicon(ranks)


def vocabulary_words(path: str) -> list[str]:
    """Whole words of three letters or more of a public word-end BPE vocabulary file, in the order of its ids.

    Merges are numbered by frequency, so the order is that of a ranked word list; the list is as long as the file allows.
    """
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    ended = (t[:-4] for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
    return [w for w in ended if len(w) >= 3 and w.isalpha()]


def corpus_words(docs: DataFrame, size: int = 50_000, min_docs: int = 20, text_col: str = "text") -> list[str]:
    """The ``size`` words of 3 to 24 letters that most documents hold, of those in ``min_docs`` at least; counted over all documents.

    Each task sums its documents before the exchange; ``size`` words reach the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?<!\p{L})(\p{L}{3,24})(?!\p{L})"), 1))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(size).collect()]


#: The password words alone.
BASIC = lexicon()


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26)
    return math.log10(33)


def log10_guesses(value: str, words: Lexicon = BASIC) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs; 0 for an empty value.

    Ties between segmentations do not matter: only the least cost is returned.
    """
    n = len(value)
    low = value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    ranks, lengths = words.ranks, words.lengths
    best = [0.0] + [math.inf] * n
    spans: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for m in _DATE.finditer(value):
        spans[m.start()].append((m.end(), math.log10(365 * 60) if len(m.group()) > 4 else math.log10(60)))
    i = 0
    while i < n:  # keyboard walks and sequences: maximal runs
        j, kind = i + 1, None
        while j < n:
            step = ord(low[j]) - ord(low[j - 1])
            this = "walk" if (low[j - 1], low[j]) in NEIGHBOURS else step if step in (1, -1) and low[j].isalnum() else None
            if this is None or (kind is not None and this != kind):
                break
            kind, j = this, j + 1
        if j - i >= 3:
            for end in range(i + 3, min(j, i + MAX_SPAN) + 1):
                spans[i].append((end, math.log10(47 * 2 * (end - i))))
            if j - i > MAX_SPAN:
                spans[i].append((j, math.log10(47 * 2 * (j - i))))
            i = j - 1
        else:
            i += 1
    for unit in (1, 2, 3, 4):  # repeats of a short unit: maximal runs
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            count = (j - i) // unit
            if count >= (3 if unit == 1 else 2):
                spans[i].append((i + count * unit, sum(map(_char_cost, value[i:i + unit])) + math.log10(count)))
                i = max(i + 1, j - unit)
            else:
                i += 1
    for i in range(n):
        here = best[i]
        # brute force goes on character by character; a segment is charged when another kind begins
        cost = here + _char_cost(value[i])
        if cost < best[i + 1]:
            best[i + 1] = cost
        for size in lengths:
            if i + size <= n and (word := plain[i:i + size]) in ranks:
                upper = sum(a != b for a, b in zip(value[i:i + size], word))
                best[i + size] = min(best[i + size], here + math.log10(ranks[word]) + 0.3 * upper + SEGMENT_COST)
        for end, cost in spans[i]:
            best[end] = min(best[end], here + cost + SEGMENT_COST)
    return best[n]


def _name_before(text: str, sep: int, floor: int, names: tuple[str, ...]) -> int:
    """Start of the credential name that ends right before the separator (quote and spaces between), or -1."""
    end = sep
    while end > floor and text[end - 1] == " ":
        end -= 1
    if end > floor and text[end - 1] in "\"'":
        end -= 1
    tail = text[max(floor, end - _NAME_END):end]
    tail = "".join(c.lower() if c.isascii() else c for c in tail)
    found = [end - len(name) for name in names if tail.endswith(name)]
    return min(found, default=-1)


def _separators(text: str) -> list[int]:
    out = []
    for mark in ":=":
        at = text.find(mark)
        while at >= 0:
            out.append(at)
            at = text.find(mark, at + 1)
    return sorted(out)


def scan(text: str | None, min_log10_guesses: float = MIN_LOG10_GUESSES, words: Lexicon = BASIC) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 guesses) of one text, in code points, by start and then kind."""
    if not text:
        return []
    out = []
    done = done_more = 0
    for sep in _separators(text):
        start = _name_before(text, sep, done, BASE_NAMES)
        base = _VALUE.match(text, sep + 1) if start >= 0 else None
        assigned = 0
        if base:
            done = base.end()
            if len(base.group(1)) >= 6:
                out.append(("assign", start, done, log10_guesses(base.group(1), words)))
                assigned = done
        if sep >= done_more:
            start = _name_before(text, sep, done_more, BASE_NAMES)
            if start < 0:
                start = _name_before(text, sep, done_more, MORE_NAMES)
                if start > 0 and text[start - 1].isalnum():
                    start = -1
            if start >= 0 and (m := _LOOSE_VALUE.match(text, sep + 1)) and m.end() > assigned:
                cost = log10_guesses(m.group(1), words)
                if cost >= min_log10_guesses:
                    out.append(("cred", start, m.end(), cost))
                    done_more = m.end()
        done_more = max(done_more, assigned)
    for m in _BEARER.finditer(text):
        value = m.group(1)
        word = _PROSE.fullmatch(value) and (value.islower() or value.isupper() or value[1:].islower())
        if not word and (cost := log10_guesses(value, words)) >= min_log10_guesses:
            out.append(("cred", m.start(), m.end(), cost))
    out += [("access", m.start(), m.end(), log10_guesses(m.group(), words)) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), log10_guesses(m.group(), words)) for m in _HEX.finditer(text)]
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def redact(text: str | None, min_log10_guesses: float = MIN_LOG10_GUESSES, words: Lexicon = BASIC) -> str | None:
    """The text with each secret as [SECRET:kind]; overlapping secrets become one; null stays null."""
    found = scan(text, min_log10_guesses, words)
    if not found:
        return text
    parts, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            parts += [text[at:start], f"[SECRET:{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


SECRETS = "array<struct<kind:string,start:int,end:int,log10_guesses:double>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_log10_guesses: float = MIN_LOG10_GUESSES, words: Lexicon = BASIC) -> DataFrame:
    """One row per document: (doc_id, secrets). No shuffle; each text is scanned whole in its task."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def one(text: str | None) -> tuple:
        return ([dict(zip(("kind", "start", "end", "log10_guesses"), x)) for x in scan(text, min_log10_guesses, shared.value)],)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, ["doc_id"], "text", one, f"secrets {SECRETS}")


def redact_secrets(docs: DataFrame, text_col: str = "text", min_log10_guesses: float = MIN_LOG10_GUESSES, words: Lexicon = BASIC) -> DataFrame:
    """The same rows and columns; each secret in the text becomes [SECRET:kind]. Overlapping secrets become one."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    return rewrite_texts(docs, text_col, lambda t: redact(t, min_log10_guesses, shared.value))
