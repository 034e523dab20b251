"""The queries ``opN_<name>``: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import decontaminate, embedding_dedup, fill_in_middle, html_extract, jaccard_join, lm_scoring, pii, secrets, sentencepiece_fst, suffix_dedup, toxicity, warc, zone_clustering
from ledgerlens.llm.catalog import ORACLE_SQL, QUERIES, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


@query("op1_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), holdout=held_out)
    return toxicity.score_documents(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op2_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"),
                        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"))


@query("op3_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), jaccard_join.Rule(words=3, part=90, whole=100))


@query("op4_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(F.size(of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(joined_spans(of_kinds(F.col("spans"), pii.BASE_KINDS)), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


OP6_SQL = """
with p as (
  select page_id, coalesce(html, '') as payload from pages
), h as (
  select page_id, octet_length(encode(payload))::bigint as payload_bytes, sha1(payload) as hex from p
), g as (
  select *, min(page_id) over (partition by hex) as least from h
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint) >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest,
  case when page_id is null or page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id <> least then least end as refers_to
from g
"""


@query("op6_warc", OP6_SQL)
def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archives(warc.resolve_revisits(table(spark, sf_dir, "pages"), min_bytes=0), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A public BPE model with byte fallback; another path can be given to ``compile_model``.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op7_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = sentencepiece_fst.encode(docs, sentencepiece_fst.compile_model(PIECES), decoded=True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.length("decoded").cast("long").alias("n_chars"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


OP8_SQL = """
with e as (
  select vec_id, label, embedding from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as u, b.vec_id as v from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.93
), n as (
  select vec_id, count(u) as n_links from embeddings left join l on vec_id = u group by vec_id
), r as (
  with recursive w(id, seen) as (
    select vec_id, vec_id from embeddings union select l.v, w.seen from w join l on l.u = w.id and w.seen < l.v
  ) select id, min(seen) as component_id from w group by id
)
select n.vec_id, n.n_links::bigint as n_links, r.component_id, n.vec_id = r.component_id as kept from n join r on r.id = n.vec_id
"""


@query("op8_embedding_near_dedup", OP8_SQL)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op9_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")), with_text=False)


#: A public vocabulary of words in the order of their frequency; another path can be given to ``vocabulary_words``.
WORDS = "/opt/tokenizers/word_bpe_49k.json"


@query("op10_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.lexicon(secrets.vocabulary_words(WORDS))
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), words=words)
    base = of_kinds(F.col("secrets"), ("assign", "access", "hex"))
    return found.select(
        "doc_id", *(F.size(of_kinds(F.col("secrets"), (k,))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["log10_guesses"] >= secrets.MIN_LOG10_GUESSES)).cast("long").alias("n_hard"))


OP11_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    sha256('42:' || coalesce(doc_id::varchar, '')) as hex from documents
), h as (
  select doc_id, text, units, len(units) as n, ('0x' || substr(hex, 1, 8))::bigint as h1, ('0x' || substr(hex, 9, 8))::bigint as h2,
    ('0x' || substr(hex, 17, 8))::bigint as h3, ('0x' || substr(hex, 25, 8))::bigint as h4 from t
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
         when h4 % 100 < 80 then 'spm' else 'psm' end as form from h
), p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
  case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""


@query("op11_fill_in_middle", OP11_SQL)
def fill_in_the_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", F.col("prefix_end").alias("prefix_chars"), (F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"),
                      F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_OP12_NEAREST = """select id, arg_min(num, row(d, num)) as num, min(d) as d from (
  select q.id, c.num, list_sum(list_transform(list_zip(q.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from q cross join c{round} c
) group by id"""

OP12_SQL = """
with q as (
  select row_number() over () as id, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by sha256('2:' || vec_id::varchar), v) - 1 as num, v as c from q where vec_id is not null
  qualify num < 40
)""" + "".join(f""", a{i} as ({_OP12_NEAREST.format(round=i)}
), m{i} as (
  select num, list((s - ((s % n) + n) % n) // n order by i) as c from (
    select a.num, p.i, sum(q.v[p.i])::bigint as s, count(*)::bigint as n from a{i} a join q using (id) cross join (select unnest(range(1, 65)) as i) p group by all
  ) group by num
), c{i + 1} as (
  select c.num, coalesce(m.c, c.c) as c from c{i} c left join m{i} m using (num)
)""" for i in range(5)) + f""", last as ({_OP12_NEAREST.format(round=5)})
select q.vec_id, last.num::int as cluster, last.d as distance, (sum(last.d) over (partition by last.num))::bigint as cluster_inertia,
  (sum(last.d) over ())::bigint as inertia, sha256(array_to_string(c5.c, ',')) as centroid_sha256
from last join q using (id) join c5 using (num)
"""


@query("op12_centroid_clustering", OP12_SQL)
def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clustering.cluster_vectors(table(spark, sf_dir, "embeddings"), zone_clustering.Rule(k=40, rounds=5, dims=64, scale=256, salt="2:"))


@query("op13_lm_scoring")
def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
