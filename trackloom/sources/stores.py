"""Results per video on disk, their manifest, and what can be reused from an earlier run."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_key(config: dict, version: int) -> str:
    """Text that identifies a configuration; equal settings give equal text."""
    return json.dumps({"version": version, "config": config}, sort_keys=True, separators=(",", ":"))


def write_results(rows: DataFrame, path: str, config: dict, version: int, fmt: str = "parquet") -> None:
    """Rows partitioned by video with the hash of their configuration; only written partitions are replaced.

    The rows of a video are brought together first, a large one in several tasks, so a video has few files.
    """
    stamped = rows.hint("rebalance", "video_id").withColumn("config_hash", F.sha2(F.lit(config_key(config, version)), 256))
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("video_id")
        .format(fmt)
        .save(path)
    )


def manifest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("video_id", "config_hash").agg(F.count("*").alias("rows"))


def pending(videos: DataFrame, stored: DataFrame, config: dict, version: int) -> DataFrame:
    """Videos without a stored result of this version and configuration."""
    key = F.sha2(F.lit(config_key(config, version)), 256)
    done = stored.filter(F.col("config_hash") == key).select("video_id")
    return videos.join(done, "video_id", "left_anti")


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """Stored results, or nothing when no run has written any."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
