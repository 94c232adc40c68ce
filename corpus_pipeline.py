"""A training corpus from the documents: five stages, each one operator, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import exact, mixing, near_copies, packing, quality, simhash
from trackloom.llm.common import documents, settle
from trackloom.llm.queries import labels, tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.good_documents(docs, labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, white space aside."""
    return exact.first_of_each(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near duplicates: SimHash fingerprints within four bits, as op10 links them, or shingle sets of similarity 0.8.

    Fingerprints of 64 bits miss most pairs of the second sort, so both sorts of links count, and groups are closed over all of them.
    """
    return simhash.one_of_each(docs, further=near_copies.groups(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated for the target weights of their sources, in the order of the global shuffle."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality", good), ("exact_dedup", distinct), ("simhash_near_dedup", dissimilar), ("mixing", mixed), ("packing", packed)]

#: Ids of a tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
