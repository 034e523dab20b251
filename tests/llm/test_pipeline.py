from pyspark.sql import functions as F

import corpus_pipeline as cp
import __spark_entry__ as entry
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as classes
from test_secrets import brute as secret_spans

from ledgerlens.llm import secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in cp.STAGES][0] == "toxicity" and len(cp.STAGES) == 5


def test_stages_against_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents")
    benchmark = [r.text for r in read("benchmark").collect()]
    stage = dict(cp.STAGES)
    pick = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = toxicity.train(docs, read("labels"), holdout=F.expr(cp.HELD_OUT))
    one = stage["toxicity"](spark, docs, SF).cache()
    assert one.columns == docs.columns and pick(one) == {d: t for d, t in pick(docs).items() if model.score(t) < 0.5}

    two = stage["ngram_jaccard_join"](spark, one, SF).cache()
    found = classes(sorted(pick(one).items()), cp.NEAR)
    assert two.columns == docs.columns and set(pick(two)) == {d for d, _, c in found if d == c}

    three = stage["benchmark_decontamination"](spark, two, SF).cache()
    assert three.columns == docs.columns and set(pick(three)) == {d for d, t in pick(two).items() if not any(leaks(t, b) for b in benchmark)}

    four = stage["secret_scans"](spark, three, SF).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    after, words = pick(four), secrets.lexicon(secrets.vocabulary_words(cp.WORDS))
    for d, t in pick(three).items():
        assert after[d] == secrets.redact(t, words=words) and (after[d] == t) == (not secret_spans(t) and not secrets.scan(t, words=words))
    assert all(r.n_chars == len(r.text) for r in four.collect())

    five = stage["sentencepiece"](spark, four, SF)
    assert {r.doc_id: r.n_chars for r in five.collect()} == {d: len(t) for d, t in after.items()}
    assert sorted(r.doc_id for r in cp.run(spark, SF).collect()) == sorted(after)


def test_odd_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a", "en", "s", 1), (4, "a", None, None, 1), (5, "z " * 50_000, "x", "y", 100_000)]
    for name, data in (("some", rows), ("none", []), ("bare", rows)):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):  # "bare": both are empty
            spark.read.parquet(f"{folder}/{t}.parquet").where(F.lit(name != "bare")).write.parquet(f"{folder}/{name}/{t}.parquet")
        got = sorted(str(r.doc_id) for r in cp.run(spark, f"{folder}/{name}").collect())
        assert got == (["1", "2", "3", "5", "None"] if data else [])
