"""Toxicity by a weighted finite-state pattern grammar.

Words go through a lexical transducer (insult stems learned from labels, threat
and target words, negation, reporting verbs) to classes; transducers for
negation, reported speech and target are composed with it into one machine that
reads a clause and emits weighted events: plain, targeted, negated or reported
insults, threats, and graded hits. A document's score is a logistic model of its
clauses' event weights, not of isolated words.

Learning uses at most ``training_rows`` labelled rows, near copies once: insult
stems by a binomial test against the share of toxic rows, event weights by
logistic regression with a prior. A significant stem that clean rows hold too is
kept with a graded weight, its log odds; its hits are an event of their own, so
that one hit says little and repeated ones much. Scoring reads every text whole, in
time that grows with its length; a clause counts three hits at most in each forty words.

Defined results: null, empty and wordless texts get the score of a text without
events; a document without a label is scored alike; labels with null ids or null
marks are ignored, repeated ones by their maximum; with no usable labels the
prior grammar alone scores. Labels, ids and other columns never enter a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import cut
from ledgerlens.llm.textops import filter_texts, map_texts, mix, words_of_run

TRAINING_ROWS = 8_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
MIN_PRECISION = 0.97
REACH = 3  # tokens that a negation covers

# Closed classes of the grammar, small and the same for every corpus.
CLOSED = {
    "N": "not no never neither nor without isn't aren't wasn't don't doesn't didn't nicht kein keine nie niemals ne pas jamais nunca sin".split(),
    "R": "said says say told called wrote writes claimed quoted reported sagte sagt schrieb dit disait écrit appelé dijo dice llamó escribió".split(),
    "Y": "you your yours yourself u ya du dich dir dein euch ihr tu toi vous votre usted tú ti vosotros him her them they".split(),
    "T": "kill murder stab shoot strangle lynch hang töten umbringen erschießen tuer égorger buter matar degollar asesinar".split(),
}
EVENTS = ("insult", "targeted", "negated", "reported", "threat", "graded")
#: Prior of the logistic weights: intercept, then one weight per event.
PRIOR = np.array([-3.0, 3.0, 3.5, 1.0, 1.0, 2.0, 2.0])

_CLAUSE = re.compile(r"[^.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Transducer:
    """A deterministic weighted transducer: arcs[state, symbol] = (state, symbol out, weight).

    The symbol ``*`` stands for any symbol not listed, and as an output for the
    symbol read; a symbol without an arc passes.
    """

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        to, out, weight = self.arcs.get((state, symbol)) or self.arcs.get((state, "*")) or (state, symbol, 0.0)
        return to, symbol if out == "*" else out, weight

    def compose(self, other: Transducer, alphabet: str) -> Transducer:
        """The machine that feeds this one's output to ``other``; weights add (tropical semiring)."""
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for symbol in alphabet:
                a, mid, w = self.step(state[0], symbol)
                b, out, v = other.step(state[1], mid)
                arcs[state, symbol] = ((a, b), out, w + v)
                todo.append((a, b))
        return Transducer(arcs, (self.start, other.start))


def grammar() -> Transducer:
    """Negation, reported speech and target, composed. I insult, T threat; n negated, r reported, t targeted."""
    negation = {}
    for k in range(REACH + 1):
        negation[k, "N"] = (REACH, "N", 0.0)
        negation[k, "I"] = (max(k - 1, 0), "n" if k else "I", 0.0)
        negation[k, "T"] = (max(k - 1, 0), "n" if k else "T", 0.0)
        negation[k, "*"] = (max(k - 1, 0), "*", 0.0)
    reported = {(0, "R"): (1, "R", 0.0)} | {(1, s): (1, "r", 0.0) for s in "ITn"}
    target = {(0, "Y"): (1, "Y", 0.0), (1, "I"): (1, "t", 0.0), (2, "Y"): (1, "t", 0.0), (0, "I"): (2, "I", 0.0)}
    alphabet = "INRYTo"
    return Transducer(negation).compose(Transducer(reported), alphabet).compose(Transducer(target), alphabet)


#: A clause saturates at MOST hits in each stretch of STRETCH words, so repeating a word in one breath adds little and a
#: long text without a clause mark still counts by its length.
STRETCH, MOST = 40, 3.0
OUT = {"I": 0, "t": 1, "n": 2, "r": 3, "T": 4}
GRADED = {"I": 5, "t": 5, "n": 2, "r": 3}


class Grammar:
    """The compiled machine with its learned lexicon: ``stems`` maps a word start to its weight, graded below MIN_PRECISION."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.closed = {w: c for c, words in CLOSED.items() for w in words}
        self.lengths = sorted({len(s) for s in stems})
        self.machine = grammar()
        literals = sorted({*stems, *CLOSED["T"]}, key=lambda s: (len(s), s))
        self.any = re.compile("|".join(map(re.escape, literals)))

    def word(self, token: str) -> tuple[str, float]:
        found = [self.stems[token[:n]] for n in self.lengths if len(token) >= n and token[:n] in self.stems]
        return ("I", max(found)) if found else (self.closed.get(token, "o"), 1.0)

    def events(self, text: str | None) -> tuple[float, ...]:
        """Summed clause weights per event of one text."""
        total = [0.0] * len(EVENTS)
        low = (text or "").lower()
        at, mark = 0, -1  # mark: the last clause mark before at
        while m := self.any.search(low, at):
            begin = max(mark, *(low.rfind(c, at, m.start()) for c in ".!?;\n")) + 1
            clause = _CLAUSE.match(low, begin) if begin <= m.start() else None
            end = clause.end() if clause else m.end()
            state, first = self.machine.start, [0.0] * len(EVENTS)
            for k, token in enumerate(_TOKEN.findall(low[begin:end])):
                if k and k % STRETCH == 0:
                    total = [t + min(v, MOST) for t, v in zip(total, first)]
                    first = [0.0] * len(EVENTS)
                symbol, weight = self.word(token)
                state, out, _ = self.machine.arcs[state, symbol]
                if out in OUT:
                    first[(OUT if weight >= MIN_PRECISION else GRADED)[out]] += weight
            total = [t + min(v, MOST) for t, v in zip(total, first)]
            mark = max(begin - 1, *(low.rfind(c, max(at, begin), max(end, m.end())) for c in ".!?;\n"))
            at = max(end, m.end())
        return tuple(math.log1p(v) for v in total)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, holdout=None) -> DataFrame:
    """(doc_id, toxic, text) of at most about ``rows`` labelled documents, chosen by a hash of the id.

    ``holdout`` is a condition on doc_id whose rows are never used. The chosen
    labels number ``rows`` at most, whatever the size of the tables, so they are broadcast.
    """
    marks = labels.where("doc_id is not null and toxic is not null")
    if holdout is not None:
        marks = marks.where(~holdout)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    total = marks.count()
    if total > rows:
        share = int((1 << 32) * rows / total)
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks.limit(2 * rows)), "doc_id")


def _family(text: str) -> int:
    """Least hash of the text's 3-word windows: near copies mostly share it."""
    data = np.frombuffer(text.encode() + b"\n", np.uint8)
    words, _ = words_of_run(data, np.array([0, len(data)]))
    if len(words) > 2:
        words = mix(words[:-2] * np.uint64(3) + mix(words[1:-1]) + mix(mix(words[2:])))
    return int(words.min().view(np.int64)) if len(words) else 0


def _odds(clean: float, toxic: float, rate: float) -> float:
    """Log odds of a toxic row among those counted, above the odds of all rows."""
    return math.log((toxic + 0.5) / (clean + 0.5)) - math.log(rate / (1 - rate))


def _stem_counts(rows: DataFrame, without: frozenset[str] = frozenset()) -> DataFrame:
    """(stem, clean, toxic): the rows that hold a word with that start; words with a start in ``without`` do not count."""
    lengths = sorted({len(s) for s in without})

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(part["text"], part["toxic"]):
                seen = set()
                for w in set(_TOKEN.findall((text or "").lower())):
                    if not any(w[:n] in without for n in lengths):
                        seen.update(w[:n] for n in STEM_LENGTHS if len(w) >= n)
                for f in seen:
                    counts.setdefault(f, [0, 0])[toxic] += 1
            yield pd.DataFrame([(f, a, b) for f, (a, b) in counts.items()], columns=["stem", "clean", "toxic"])

    table = rows.select("text", "toxic").mapInPandas(features, "stem string, clean long, toxic long")
    return table.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn_stems(sample: DataFrame, min_precision: float = MIN_PRECISION, significance: float = 0.05) -> dict[str, float]:
    """Word starts that are more frequent in toxic rows than chance allows for so many candidates, with their weights.

    Precise ones weigh their share of toxic rows. A graded one is significant
    among the words that no precise start covers; it weighs its log odds against
    those of a start just precise, and takes in the precise starts that only
    cover a lesser part of its family. A start whose shorter start is kept alike
    is left out. Only the survivors of the test reach the driver; their number is
    bounded by the sample.
    """
    single = cut(sample.groupBy("family").agg(F.min(F.struct("doc_id", "toxic", "text")).alias("d")).select("d.*"))
    n = single.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n[0] or not n[1] or n[0] == n[1]:
        return {}
    rate = n[1] / n[0]
    table = cut(_stem_counts(single))
    # A precise candidate's binomial tail is at most choose(n, toxic) * rate^toxic.
    strong = table.where((F.col("toxic") >= 4) & (F.col("toxic") >= min_precision * (F.col("toxic") + F.col("clean"))))
    rows = [(r.stem, r.clean, r.toxic) for r in strong.collect()]
    candidates = max(table.count(), 1)
    kept: dict[str, float] = {}
    held: dict[str, int] = {}
    for stem, clean, toxic in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        tail = sum(math.comb(clean + toxic, k) * rate ** k * (1 - rate) ** (clean + toxic - k) for k in range(toxic, clean + toxic + 1))
        if tail * candidates <= significance and not any(stem.startswith(k) for k in kept):
            kept[stem], held[stem] = min(1.0, toxic / (toxic + clean)), toxic
    # The tail of the others by Chernoff's bound, exp(-n * divergence from the rate).
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    bound = F.col("toxic") * F.log(share / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    rest = _stem_counts(single, frozenset(kept)).where((F.col("toxic") >= 4) & (share > rate)).where(bound >= math.log(candidates / significance))
    rows = rest.select("stem", F.col("toxic").alias("rest")).join(table, "stem").collect()
    precise = min(min_precision, 0.999)
    scale = max(math.log(precise / (1 - precise)) - math.log(rate / (1 - rate)), 1.0)
    graded: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.stem), r.stem)):
        if not any(r.stem.startswith(k) for k in graded):
            weight = _odds(r.clean, r.toxic, rate) / scale
            if weight > 0:
                graded[r.stem] = min(weight, 0.99 * MIN_PRECISION)
                kept = {k: v for k, v in kept.items() if not k.startswith(r.stem) or held[k] >= r.rest}
    return kept | graded


def fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton steps with a normal prior around ``prior``."""
    x = np.column_stack((np.ones(len(x)), x))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray):
        self.grammar, self.weights = Grammar(stems), [float(w) for w in weights]

    def score(self, text: str | None) -> float:
        events = self.grammar.events(text)
        z = self.weights[0] + sum(w * e for w, e in zip(self.weights[1:], events))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, holdout=None) -> Model:
    """The grammar and its weights from a bounded sample of labelled rows."""
    sample = training_sample(docs, labels, rows, holdout)
    family = F.pandas_udf(lambda t: pd.Series([_family(x or "") for x in t], dtype="int64"), "long")
    sample = sample.withColumn("family", family("text"))
    stems = learn_stems(sample)
    reader = Grammar(stems)
    events = map_texts(sample.select("toxic", "text"), ["toxic"], "text", lambda t: (list(reader.events(t)),), "events array<double>")
    seen = events.toPandas()  # six numbers per row of the bounded sample
    if not len(seen):
        return Model(stems, PRIOR)
    return Model(stems, fit_weights(np.array(seen["events"].tolist()), seen["toxic"].to_numpy(float)))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, events) per document, without a shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, ["doc_id"], "text", lambda t: (model.score(t), list(model.grammar.events(t))), "score double, events array<double>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``threshold``; columns stay."""
    return filter_texts(docs, text_col, lambda t: model.score(t) < threshold)
