"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go,
secrets are redacted, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's docs; all but the last return the
columns of documents. A stage is judged on the documents it gets.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, jaccard_join, secrets, sentencepiece_fst, toxicity
from ledgerlens.llm.catalog import table
from ledgerlens.llm.textops import small_batches
from ledgerlens.session import ensure_checkpoint_dir

#: A public BPE model with byte fallback.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: A public vocabulary of words in the order of their frequency.
WORDS = "/opt/tokenizers/word_bpe_49k.json"
#: Five-word shingles, similarity 0.8 or more.
NEAR = jaccard_join.Rule(words=5, part=80, whole=100)
#: Rows that the evaluation of the toxicity query holds out are not learned from here either.
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned grammar scores at 0.5 or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), holdout=F.expr(HELD_OUT)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    return jaccard_join.keep_one(docs, NEAR)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become marks; n_chars follows the text."""
    out = secrets.redact_secrets(docs, words=secrets.lexicon(secrets.vocabulary_words(WORDS)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the length of the text they decode to."""
    out = sentencepiece_fst.encode(docs, sentencepiece_fst.compile_model(PIECES), decoded=True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.length("decoded").cast("long").alias("n_chars"))


def in_small_batches(stage):
    """The stage, with a bounded number of documents sent to Python at once."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("ngram_jaccard_join", in_small_batches(drop_near_duplicates)),
    ("benchmark_decontamination", in_small_batches(drop_benchmark_leaks)),
    ("secret_scans", in_small_batches(redact_secrets)),
    ("sentencepiece", in_small_batches(encode)),
]

#: The stages learn, join by similarity and encode; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written below the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
