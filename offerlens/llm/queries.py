"""The queries of this subpackage, one for each operator, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, embeddings, html_text, lexical, lines, mixing, quality, simhash, substring, token_counts, token_files, urls, vector_codes
from .storage import kept, new_path, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = quality.judged(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *(F.col("q")[c].alias(c) for c in counts), "kept")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    new = lines.without_recurring(docs, extra=True)
    return new.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: every document is inserted, later exact copies are deleted, and counts are revised
    where white space is normalised; the second batch is sent twice."""
    version = "byte_bpe_multi_50k"
    counter = token_counts.byte_bpe_counter(public_tokenizers.path(f"{version}.tiktoken"), public_tokenizers.PATTERN)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.sha2("text", 256).alias("sha"), F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).alias("clean"))
    counted = kept(token_counts.with_token_counts(docs, counter, ("text", "clean"), ("doc_id", "source", "lang", "sha")), "token-counts")
    first = kept(counted.filter("sha is not null").groupBy("sha").agg(F.min("doc_id").alias("first")), "token-first")
    copies = counted.join(first, "sha").filter("doc_id > first")
    rest = counted.join(first, "sha").filter("doc_id = first")
    one, n = F.lit(1), F.col("text_tokens")
    rollup = token_counts.Rollup(spark, new_path(spark, "token-rollup"))
    rollup.commit("inserted", token_counts.deltas(counted, version, one, n))
    for _ in range(2):
        rollup.commit("deleted", token_counts.deltas(copies, version, -one, -n))
    rollup.commit("revised", token_counts.deltas(rest, version, F.lit(0), F.col("clean_tokens") - n))
    return rollup.totals()


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, token_files.word_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    with small_batches(spark):
        return kept(token_files.read_tokens(spark, path, with_ids=False), "token-rows")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(_table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_embeddings, op4_substring, op5_mixing, op6_urls, op7_line_dedup, op8_token_counts, op9_bpe, op10_token_files, op11_html, op12_vector_codes, op13_lexical)}

EMBEDDINGS_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
e as materialized (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(c, vec_id)) component_id, vec_id = least(vec_id, coalesce(c, vec_id)) kept
from embeddings left join (select a, count(*) n from e group by 1) n on n.a = vec_id left join (select a, min(b) c from r group by 1) r on r.a = vec_id"""

ORACLES = {"op3_embeddings": EMBEDDINGS_SQL, "op5_mixing": mixing.SQL, "op6_urls": urls.SQL, "op7_line_dedup": lines.SQL, "op12_vector_codes": vector_codes.SQL, "op13_lexical": lexical.SQL}
