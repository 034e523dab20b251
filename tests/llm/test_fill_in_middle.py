import hashlib
import random
import re

import pytest

from ledgerlens.llm import fill_in_middle as fim
from ledgerlens.llm.queries import QUERIES
from llm_docs import docs_of  # noqa: F401

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc_id, text, rule):
    """The rule read off its definition: units by finditer, strings joined unit by unit."""
    text = text or ""
    units = [m.group() for m in UNIT.finditer(text)]
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in rule.marks) or h3 % 100 >= rule.plain_percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < rule.spm_percent else "psm"
    out = (rule.suffix + s + rule.prefix + p + rule.middle + m) if form == "spm" else (rule.prefix + p + rule.suffix + s + rule.middle + m)
    return doc_id, n, form, len(p), len(p) + len(m), out


def texts(count=400, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "ß", "é", "漢", "\U0001f600", " ", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", "\x00", "<", ">", "P", "S", "M", "\\E"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))) for i in range(count)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a <P> b"), (1004, "x<S>"), (1005, "<M>"), (1006, "< P>"), (1007, "one"), (None, "no id here"),
             (None, "no id here"), (7, "same id, other text"), (7, "same id, other text"), (-5, "minus"), (1008, "word " * 200000)]
    return rows + [(2000 + i, "ends with <" + "<" * (i % 3) + " <S and more <P " * 3) for i in range(60)]


@pytest.mark.parametrize("rule", [fim.Rule(), fim.Rule(seed=7, plain_percent=100, spm_percent=30, prefix="[p", suffix="(s)", middle="{m}")])
def test_against_the_definition(spark, docs_of, rule):
    rows = texts()
    got = fim.restore(fim.fill_in_middle(docs_of(rows), rule), rule).collect()
    found = sorted((tuple(r[:6]) for r in got), key=str)
    assert found == sorted((plain_form(i, t, rule) for i, t in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)


def test_other_columns_and_empty_tables(spark):
    schema = "id long, body string, n string, form int, output string, h1 string, restored string, prefix_end string"
    frame = spark.createDataFrame([(1, "a b c", "x", 1, "y", "z", "w", "v")] * 3, schema)
    out = fim.restore(fim.fill_in_middle(frame, id_col="id", text_col="body"))
    assert out.columns == ["id", "n", "form", "prefix_end", "middle_end", "output", "restored"]
    assert [r.n for r in out.collect()] == [3, 3, 3]
    assert fim.restore(fim.fill_in_middle(frame.limit(0), id_col="id", text_col="body")).count() == 0


def test_marks_that_could_run_into_the_text_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aa", "b", "c"), ("<P>", "P<", "<M>")):
        with pytest.raises(ValueError):
            fim.Rule(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_time_grows_with_the_text():
    import time

    def seconds(text):
        return min(_timed(text) for _ in range(3))

    def _timed(text):
        start = time.perf_counter()
        fim.transform(text, 1 << 30, 1 << 31, 1, 1, fim.Rule())
        return time.perf_counter() - start

    assert seconds("word and space " * 200000) < 5 * seconds("word and space " * 100000)


def test_query_runs_over_the_whole_table(spark):
    out = QUERIES["op11_fill_in_middle"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F
    assert out.join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")), "doc_id").where("s = restored_sha256").count() == docs.count()
