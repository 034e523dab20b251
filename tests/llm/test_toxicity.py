import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity as tx
from llm_docs import docs_of  # noqa: F401

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abdegiklmnoprsu"), rng.integers(3, 9))) for _ in range(400)]
    bad = ["zornbik" + s for s in ("a", "en", "ung", "ier")] + ["vextor"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, 60)).replace(words[7], words[7] + ".")
        toxic = i % 9 == 0
        if toxic:
            parts = text.split()
            for b in rng.choice(bad, 3):
                parts.insert(int(rng.integers(len(parts))), b)
            text = " ".join(parts)
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_and_generalises(spark, docs_of):
    docs, labels = corpus()
    held = "doc_id % 5 = 0"
    frame, marks = docs_of(docs), spark.createDataFrame(labels, LABELS)
    model = tx.train(frame, marks, holdout=F.expr(held))
    assert any(s.startswith("zorn") for s in model.grammar.stems) and any("vextor".startswith(s) for s in model.grammar.stems)
    scored = tx.score_documents(frame, model).join(marks, "doc_id").where(held)
    right = scored.where("(score >= 0.5) = (toxic = 1)").count()
    assert right >= 0.97 * scored.count()
    # an unseen ending of a learned stem counts, in any case
    assert model.score("der ZORNBIKALE hat") > model.score("der kalender hat")
    kept = tx.keep_clean(frame, model)
    assert kept.columns == frame.columns and kept.where("doc_id % 9 <> 0").count() == frame.where("doc_id % 9 <> 0").count()


def test_insult_family_that_clean_texts_hold_once(spark, docs_of):
    docs, labels = corpus()
    rng = np.random.default_rng(9)
    ends = ["".join(rng.choice(list("abdegiklmnoprsu"), 5)) for _ in range(200)]
    frame = []
    for i, text in docs:
        parts = [w for w in text.split() if not w.startswith(("zornbik", "vextor"))]
        for e in rng.choice(ends, 5 if i % 9 == 0 else int(i % 9 == 1)):
            parts.insert(int(rng.integers(len(parts))), "quarmel" + e)
        frame.append((i, " ".join(parts)))
    held = "doc_id % 5 = 0"
    marks = spark.createDataFrame(labels, LABELS)
    model = tx.train(docs_of(frame), marks, holdout=F.expr(held))
    assert any("quarmel".startswith(s) and w < tx.MIN_PRECISION for s, w in model.grammar.stems.items())
    scored = tx.score_documents(docs_of(frame), model).join(marks, "doc_id").where(held)
    assert scored.where("toxic = 1 and score >= 0.5").count() >= 0.9 * scored.where("toxic = 1").count()
    assert scored.where("toxic = 0 and score >= 0.5").count() <= 0.02 * scored.count()


@pytest.fixture(scope="module")
def model():
    return tx.Model({"idiot": 1.0}, tx.PRIOR)


def test_clauses_not_words(model):
    events = lambda t: [k for k, v in zip(tx.EVENTS, model.grammar.events(t)) if v > 0]
    assert events("what an idiot.") == ["insult"]
    assert events("you are an idiot") == ["targeted"]
    assert events("they are no idiot") == ["negated"]
    assert events("he said: an idiot lives here") == ["reported"]
    assert events("he said so. an idiot lives here") == ["insult"]
    assert events("no. an idiot") == ["insult"]
    assert events("i will kill it") == ["threat"]
    score = model.score
    assert score("you idiot") > score("some idiot") > score("he said some idiot") and score("some idiot") > score("no idiot") > score("")


def test_machine_is_a_composition():
    whole = tx.grammar()
    assert all(len(v) == 3 for v in whole.arcs.values())
    state, out = whole.start, []
    for symbol in "NoooI":                            # out of the negation's reach
        state, o, _ = whole.arcs[state, symbol]
        out.append(o)
    assert out[-1] == "I"


def test_cases(spark, docs_of, model):
    docs = docs_of([(1, None), (2, ""), (3, "!!! ..."), (4, "x " * 300_000 + "idiot"), (4, "x " * 300_000 + "idiot"), (None, "an idiot")])
    s = [r.score for r in tx.score_documents(docs, model).collect()]
    assert s[0] == s[1] == s[2] < s[3] == s[4] == s[5] and all(0 <= x <= 1 for x in s)
    assert tx.score_documents(docs.where("false"), model).count() == 0
    nothing = tx.train(docs, spark.createDataFrame([(None, 1, 1), (7, 1, None), (99, 0, 1)], LABELS))
    assert nothing.grammar.stems == {} and nothing.score("you") < 0.5
    assert tx.keep_clean(docs.where("false"), model).count() == 0


def test_held_out_labels_do_not_matter(spark, docs_of):
    docs, labels = corpus(300)
    frame = docs_of(docs)
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    import zlib
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (tx.train(frame, spark.createDataFrame(x, LABELS), holdout=held) for x in (labels, flipped))
    assert one.grammar.stems == two.grammar.stems and one.weights == two.weights


def test_long_texts_take_time_by_their_length():
    import time
    machine = tx.Grammar({"idiot": 1.0, "trash": 0.7})

    def seconds(text):
        start = time.perf_counter()
        machine.events(text)
        return time.perf_counter() - start

    for part in ("you idiot. fine words here; ", "trash ", "no mark and no hit "):
        seconds(part * 1000)
        assert min(seconds(part * 80_000) for _ in range(3)) < 2.6 * min(seconds(part * 40_000) for _ in range(3)) + 0.02


def test_a_clause_without_an_end_counts_by_its_length():
    machine = tx.Grammar({"idiot": 1.0})
    plain = lambda n: machine.events("you idiot " * n)
    assert plain(4) == plain(20) and max(plain(200)) > max(plain(20))
    mixed = "fine; you idiot. he said idiot; and more idiot\nthen idiot, idiot"
    assert machine.events(mixed + " " + mixed) == tuple(machine.events(f"{mixed}. {mixed}"))
