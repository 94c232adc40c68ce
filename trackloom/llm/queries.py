"""The queries of the operators: thin forms over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import exact, languages, mixing, packing, pii, quality, runs, search, sharding, simhash, spotsigs, suffixes, toxicity
from trackloom.llm.common import documents, shared_folder

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir)).drop("kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    return sharding.write_shards(documents(spark, sf_dir), path).select("doc_id", "slot", "shard")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shuffled(mixing.replicated(documents(spark, sf_dir)))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.without_runs(documents(spark, sf_dir), rewrite=runs.made_periodic))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_sharding, op3_exact_dedup, op4_packing, op5_quality_classifier, op6_toxicity, op7_pii,
        op8_document_fingerprints, op9_mixing, op10_simhash_near_dedup, op11_ranked_search,
        op12_language_id, op13_periodic_runs,
    )
}

EXACT_SQL = r"""
with rows as (
    select doc_id, sha256(content) as text_sha256, content
    from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents)
)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = min(doc_id) over same as kept, text_sha256
from rows window same as (partition by content)
"""

ORACLE = {
    "op2_sharding": sharding.SQL,
    "op3_exact_dedup": EXACT_SQL,
    "op9_mixing": mixing.sql(columns="doc_id, text, lang, source, n_chars"),
    "op11_ranked_search": search.SQL,
}
