"""The registered corpus queries: thin wrappers that run an operator over its whole table and return digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import context_tree, html_text, packing, prefix_bpe, quality, sharding, shingle_join, token_store, toxicity, vector_forest

#: Production parameters.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
SEQUENCE, END_ID, SHARDS = 1024, 2, 40


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_quality_rules(spark, d):
    return quality.judge(_table(spark, d, "documents"), _table(spark, d, "labels")).drop("failed_rules")


def op2_context_tree(spark, d):
    return context_tree.score(_table(spark, d, "documents"))


def op3_projection_forest(spark, d):
    return vector_forest.near_duplicates(_table(spark, d, "embeddings"))


def op4_ngram_jaccard(spark, d):
    return shingle_join.jaccard_join(_table(spark, d, "documents")).drop("th")


def op5_best_fit_packing(spark, d):
    return packing.pack_documents(_table(spark, d, "documents"), public_tokenizers.path(BYTE_BPE), SEQUENCE, END_ID)


def op6_crf_toxicity(spark, d):
    return toxicity.tag(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op7_histogram_sort(spark, d):
    out = sharding.histogram_shards(_table(spark, d, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_composite_density(spark, d):
    return html_text.extract(_table(spark, d, "pages"))


def op9_prefix_bpe(spark, d):
    return prefix_bpe.encode_decode(_table(spark, d, "documents"), public_tokenizers.path(WORD_BPE))


def op10_token_store(spark, d):
    return token_store.encode_and_store(_table(spark, d, "documents"), public_tokenizers.path(WORD_BPE), END_ID)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_context_tree, op3_projection_forest, op4_ngram_jaccard, op5_best_fit_packing, op6_crf_toxicity, op7_histogram_sort, op8_composite_density, op9_prefix_bpe, op10_token_store)}
#: The rest have no SQL: fitted models, tokenizers, and placements that more than one answer satisfies.
ORACLES: dict[str, str] = {"op1_quality_rules": quality.oracle(), "op3_projection_forest": vector_forest.oracle(), "op4_ngram_jaccard": shingle_join.oracle()}
