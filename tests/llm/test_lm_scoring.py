import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import lm_scoring as lm
from ledgerlens.llm.queries import QUERIES

def marked():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


SMALL = lm.Rule(words=5, suffixes=7, context=2, dims=4, noise=3, batch=16, rounds=2)
SCHEMA = "doc_id long, text string, held boolean, words string, numbers int, part string, class int"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base(rows):
    """Unigram scores by a counter of tokens; the end is one of them."""
    count = Counter(t for i, text in rows if not is_held(i) for t in [*tokens(text), "\0end"])
    n, v = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        mine = [*tokens(text), "\0end"]
        out.append((i, is_held(i), len(mine), sum(count[t] > 0 for t in mine), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in mine)))
    return out


def rows(seed=1, n=150):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "cat", "ÉTÉ", "été", "x", "sat-on", "漢字", "don't", "\x1cq", " "] + [f"w{k}é" for k in range(60)]
    out = [(i, "".join(str(rng.choice(words)) + str(rng.choice([" ", "\n", "\t \x0b", "\r\n"])) for _ in range(rng.integers(0, 60)))) for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, "the cat"), (None, "the cat"), (3, "same id"), (3, "same id"), (n + 3, "the cat sat " * 5000)]
    return out


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, True, "a", 1, "b", 2) for i, t in pairs], SCHEMA)


@pytest.mark.parametrize("part_bytes,row_words", [(24 << 20, 20000), (90, 4), (1, 1000)])
def test_counts_and_base_score(spark, monkeypatch, part_bytes, row_words):
    monkeypatch.setattr(lm, "PART_BYTES", part_bytes)
    monkeypatch.setattr(lm, "ROW_WORDS", row_words)
    pairs = rows()
    got = lm.score_documents(frame(spark, pairs).repartition(3), marked(), SMALL)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = sorted((tuple(r[:5]) + (round(r.base_score, 6),) for r in got.collect()), key=str)
    assert found == sorted((b[:5] + (round(b[5], 6),) for b in base(pairs)), key=str)


def test_scores_are_the_model_s_probabilities(spark):
    """Each score again, token by token, from the weights and a dictionary of counts."""
    pairs = rows(2, 60)
    numbered = lm.cut(lm.numbered(frame(spark, pairs), marked(), "doc_id", "text"))
    counts = lm.count_words(numbered, SMALL)
    classes = lm.cut(lm.classified(numbered, counts, SMALL))
    weights, _ = lm.parts_of(lm.fit(classes, counts, SMALL), SMALL)
    count = Counter(t for i, text in pairs if not is_held(i) for t in tokens(text))
    often = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:SMALL.words]]
    group = {w: often.index(w) if w in often else SMALL.words + zlib.crc32(w[-2:].encode()) % SMALL.suffixes for _, t in pairs for w in tokens(t)}
    total, size = Counter(), Counter()
    for w, c in count.items():
        total[group[w]] += c
        size[group[w]] += 1
    assert [total[g] for g in range(SMALL.end)] == counts.totals[:-1].tolist() and [size[g] for g in range(SMALL.end)] == counts.sizes[:-1].tolist()

    def logp(context, target):
        seen = sum(weights["embed"][c] @ weights["turn"][j * SMALL.dims:(j + 1) * SMALL.dims] for j, c in enumerate(context))
        z = [float(seen @ weights["vector"][k] + weights["bias"][k]) for k in range(SMALL.classes)]
        return z[target] - math.log(sum(map(math.exp, z)))

    def score(text):
        seq = [group[w] for w in tokens(text)] + [SMALL.end]
        padded = [SMALL.classes] * SMALL.context + seq
        out = sum(logp(padded[k + SMALL.context - 1:k - 1 if k else None:-1][:SMALL.context], g) for k, g in enumerate(seq)) / math.log(10)
        return out + sum(math.log10((count[w] + 0.5) / (total[group[w]] + 0.5 * (size[group[w]] + 1))) for w in tokens(text) if group[w] >= SMALL.words)

    sequences = [lm._unpacked(bytes(r["classes"]), np.uint16) for r in classes.collect()]
    got = sorted((lm.sequence_scores(weights, sequences, SMALL) / math.log(10) + np.array([r["within"] for r in classes.collect()])).tolist())
    want = sorted(score(t) for _, t in pairs)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, SMALL.classes).astype(float)
    sequences = [rng.integers(0, SMALL.classes, 30).astype(np.uint16) for _ in range(20)]
    used, state = lm.train(lm.start(SMALL, counts), iter([sequences, [], sequences]), counts, SMALL, [1])
    weights, _ = lm.parts_of(state, SMALL)
    contexts = rng.integers(0, SMALL.classes + 1, (500, SMALL.context))
    assert used == 1200 and np.allclose(np.exp(lm.log_probabilities(weights, contexts)).sum(1), 1, atol=1e-5)
    # within a class: the counts plus 1/2 and one slot for unknown words
    for c in ([], [1], [4, 1, 9]):
        assert abs(sum((x + 0.5) / (sum(c) + 0.5 * (len(c) + 1)) for x in [*c, 0]) - 1) < 1e-12


def test_gradient_is_that_of_the_noise_contrastive_loss():
    rng = np.random.default_rng(5)
    rule = lm.Rule(words=3, suffixes=3, context=2, dims=3, noise=4, batch=8)
    counts = np.arange(1.0, rule.classes + 1)
    log_noise = np.log(rule.noise * lm.noise_shares(counts))
    contexts, truth, drawn = rng.integers(0, rule.classes + 1, (8, 2)), rng.integers(0, rule.classes, 8), rng.integers(0, rule.classes, 4)

    def loss(w):
        guess = w["embed"][contexts].reshape(8, -1) @ w["turn"]
        up = (guess * w["vector"][truth]).sum(1) + w["bias"][truth] - log_noise[truth]
        down = guess @ w["vector"][drawn].T + w["bias"][drawn] - log_noise[drawn]
        return np.log1p(np.exp(-up)).sum() + np.log1p(np.exp(down)).sum()

    state = lm.start(rule, counts)
    wide = {k: v.astype(float) for k, v in lm.parts_of(state, rule)[0].items()}
    weights, squares = lm.parts_of(state, rule)
    before = {k: v.copy() for k, v in weights.items()}
    held = {k: v.copy() for k, v in squares.items()}
    lm.nce_step(weights, squares, contexts, truth, drawn, log_noise.astype(np.float32), rule)
    for name, shape in rule.shapes.items():
        for at in np.ndindex(*shape):
            nudged = {k: v.copy() for k, v in wide.items()}
            nudged[name][at] += 1e-5
            up = loss(nudged)
            nudged[name][at] -= 2e-5
            slope = (up - loss(nudged)) / 2e-5 / np.sqrt(8)
            moved = -rule.rate * slope / np.sqrt(held[name][at] + slope * slope)
            assert abs(float(weights[name][at] - before[name][at]) - moved) < 1e-3, name


def test_states_add_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 3)
    parts = [(k, np.arange(4.0) * k) for k in range(1, 30)]
    got = lm._added(spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in parts], "tokens long, state binary").repartition(11))
    assert got[0] == sum(range(1, 30)) and np.allclose(got[1], np.arange(4.0) * sum(range(1, 30)))
    assert lm._added(spark.createDataFrame([], "tokens long, state binary")) is None


def test_empty_and_untrained(spark):
    assert lm.score_documents(frame(spark, []), marked(), SMALL).count() == 0
    held = [(i, t) for i, t in rows() if is_held(i)]
    got = lm.score_documents(frame(spark, held), marked(), SMALL).collect()
    assert len(got) == len(held) and all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert all(abs(r.score + r.n_tokens * math.log10(SMALL.classes)) < 1e-3 * r.n_tokens for r in got)
    one = lm.score_documents(frame(spark, [(None, None)]), F.lit(None).cast("boolean"), SMALL).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in one] == [(1, 1, 1, False)]


def test_held_out_documents_of_the_table(spark):
    got = QUERIES["op13_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert (got[0] - got[1]) / got[2] > 0.2 and got[3] > 0.95
