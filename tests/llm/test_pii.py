import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import pii
from llm_docs import docs_of  # noqa: F401


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


pieces = st.sampled_from(["@", ".", "a", "b-c", "a.b@c.de", "1", "255", "256", "0001", "1.2.3.4", "4111 1111 1111 1111", "4785380592391139", "+49", " ", "-", "(0)", "+", "555 1234", "é", "\n", "%", "@@", "300.1.1.1"])


@settings(max_examples=500, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs():
    for text in ("1" * 100_000, "a" * 100_000 + "@", "1." * 50_000, "+1" * 50_000, "a@" * 50_000, "1 " * 50_000):
        assert pii.base_spans(text) == brute(text) if len(set(text)) > 1 or "1" not in text else pii.base_spans(text) == []


def docs_with_terms():
    rows = [(i, f"Report by Quentzal Vornik at q.v@corp.org about things number {i}") for i in range(3)]
    rows += [(10 + i, f"ordinary things about report by number {i} and more") for i in range(40)]
    return rows + [(60, "write to other@corp.org about report"), (61, None), (62, ""), (None, "q.v@corp.org Vornik"), (10, "ordinary things about report by number 0 and more")]


def test_terms_that_disclose(spark, docs_of):
    docs = docs_of(docs_with_terms())
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    text = docs_with_terms()[0][1]
    assert [text[s.start:s.end] for s in found[0] if s.kind == "email"] == ["q.v@corp.org"]
    assert {text[s.start:s.end] for s in found[0] if s.kind == "term"} == {"Quentzal", "Vornik"}
    assert [s.kind for s in found[60]] == ["email"] and found[61] == [] and found[10] == []
    spans = [tuple(s) for s in found[0]]
    clean = pii.sanitise(text, spans)
    assert "[EMAIL]" in clean and "q.v@" not in clean and "about things number 0" in clean
    assert "Xx" in pii.sanitise(text, spans, remove_at=2.0) and pii.sanitise(None, []) is None
    assert pii.find_personal_data(docs.where("false")).count() == 0


def test_short_terms_and_punctuation(spark, docs_of):
    names = "Bob", "Li", "Vornik", "王芳", "407"
    marked = [("Bob,", "(Li)", "Vornik.", "“王芳”", "407;"), ("Bob", "Li,", "'Vornik'", "王芳。", "#407")]
    rows = [(i, " ".join(m) + " writes as q.v@corp.org about things") for i, m in enumerate(marked)]
    docs = docs_of(rows + [(10 + i, "ordinary things about writes as number and - more") for i in range(40)])
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    for i, text in rows:
        assert [text[s.start:s.end] for s in found[i] if s.kind == "term"] == list(names)
        assert all(abs(s.share - 1) < 1e-9 for s in found[i] if s.kind == "term")
    assert found[10] == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aÄ.,(“”。，»é-王_1'€…\t "), max_size=12), max_size=4))
def test_counted_words_are_the_near_words(texts):
    import numpy as np
    data = "".join(t + "\n" for t in texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])
    hashes, owner = pii._terms_of_run(np.frombuffer(data, np.uint8), offsets)
    want = [(i, w.strip(pii.PUNCTUATION)) for i, t in enumerate(texts) for w in re.split("[\x20\x09-\x0D]+", t) if w.strip(pii.PUNCTUATION)]
    assert list(zip(owner.tolist(), hashes.view(np.int64).tolist())) == list(zip((i for i, _ in want), pii.hash_words([w for _, w in want])))


def test_disclosure_counts_match_brute_force(spark, docs_of):
    import math
    rows = docs_with_terms()
    docs = docs_of(rows)
    scanned = pii.scan_documents(docs).withColumn("row", __import__("pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id())
    got = {(r.entity, r.term): r.share for r in pii.disclosing_pairs(scanned.cache(), docs, generalise_at=-99, min_joint=1).collect()}
    n = len(rows)
    words = [set((t or "").encode().lower().split()) for _, t in rows]
    near = [{(e, t) for e, w, _, _ in pii._near(t_, pii.base_spans(t_)) for t in [w.lower()]} if t_ else set() for _, t_ in rows]
    for entity, term in set().union(*near):
        joint = sum((entity, term) in x for x in near)
        one = sum(any(e == entity for e, _ in x) for x in near)
        other = sum(term.encode() in w for w in words)
        share = math.log2(joint * n / one / other) / math.log2(n / one)
        assert abs(got[entity, pii.hash_words([term])[0]] - share) < 1e-9


def test_query_digest(spark):
    from ledgerlens.llm import queries
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.personal_data(spark, sf).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]


def test_words_near_spans_against_every_word():
    """The same by looking at every word for every span."""
    import random

    def plain(text, spans):
        words = [m.span() for m in pii._WORD.finditer(text)]
        out = []
        for kind, s, e in spans:
            before = [k for k, (a, _) in enumerate(words) if a < s]
            first = max((before[-1] if before else -1) - pii.REACH, 0)
            after = [k for k, (a, _) in enumerate(words) if a >= e]
            last = after[0] + pii.REACH if after else len(words)
            for a, b in words[first:last]:
                if any(x < b and a < y for _, x, y in spans):
                    continue
                term = text[a:b].strip(pii.PUNCTUATION)
                if term and term not in pii.FUNCTION_WORDS:
                    at = a + len(text[a:b]) - len(text[a:b].lstrip(pii.PUNCTUATION))
                    out.append((pii.entity_key(kind, text[s:e]), term, at, at + len(term)))
        return out

    rng = random.Random(2)
    parts = ["Bob", "Ana,", "a.b@c.de", "1.2.3.4", "+44 20 7946 0958", "4111 1111 1111 1111", "the", "x@y.z,q@w.e", "\n", " ", "  ", ".", "(word);", "hello"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randrange(0, 50)))
        spans = pii.base_spans(text)
        assert pii._near(text, spans) == plain(text, spans)


def test_many_entities_in_one_text_take_time_by_its_length():
    import time

    def seconds(n, part):
        text, start = part * n, time.perf_counter()
        pii._near(text, pii.base_spans(text))
        return time.perf_counter() - start

    for part in ("mail some.one@site.example and so on, ", "a@b.cd,"):
        seconds(500, part)
        assert min(seconds(16_000, part) for _ in range(3)) < 2.6 * min(seconds(8_000, part) for _ in range(3)) + 0.02
