"""Exact duplicates: local, then salted, then global combining, with the whole content compared at every stage.

Each stage groups by digest and content, so two texts under one digest never meet.  The first stage is the partial
aggregation of each task, the second merges the salted groups, so a text that a third of all rows share is dealt to
``SALTS`` tasks and reaches the last stage as at most that many rows.  Documents meet their group again by digest alone;
should one digest ever stand for two contents, the job stops instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import keep_rows, row_key, settle, text_or_empty

SALTS = 16


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Per distinct content: text_sha256, keep_id (smallest doc_id), group_size."""
    content = normalised(text_or_empty())
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(content, 256).alias("text_sha256"), content.alias("content"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("text_sha256", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    merged = salted.groupBy("text_sha256", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    whole = merged.groupBy("text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("contents")
    )
    stop = F.raise_error(F.concat(F.lit("one digest for two contents: "), F.col("text_sha256"))).cast("long")
    return whole.select("text_sha256", F.when(F.col("contents") > 1, stop).otherwise(F.col("keep_id")).alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per row, dropped ones too.

    Null texts are empty texts.  A null doc_id is kept only where its group has no id at all (keep_id is null then).  Rows that
    repeat the kept doc_id with an equal text are all marked kept here; ``first_of_each`` keeps one row.  No rows give no rows.
    """
    groups = settle(winners(docs, salts), "winners").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(text_or_empty()), 256).alias("text_sha256"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    return rows.join(groups, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def first_of_each(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One whole row per distinct content: the smallest doc_id, of equal ids the smallest hash of the row."""
    content = normalised(text_or_empty())
    a, b = row_key(docs.columns)
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), a, b)
    rows = docs.select(
        rank.alias("rank"), F.sha2(content, 256).alias("text_sha256"), content.alias("content"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("text_sha256", "salt", "content").agg(F.min("rank").alias("rank"))
    merged = salted.groupBy("text_sha256", "content").agg(F.min("rank").alias("rank"))
    return keep_rows(docs, merged.select("rank.key_a", "rank.key_b"))
