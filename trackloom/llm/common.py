"""What the operators share: reading, tables written between stages, and Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one step inside a task looks at together.
BLOCK_BYTES = 2 << 20
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a session on one machine gets a folder of its own if that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="trackloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return shared_folder(spark)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def only(df: DataFrame, **columns: Column) -> DataFrame:
    """Just these columns, so that further columns of the input can't clash with names used inside."""
    return df.select(*[c.alias(name) for name, c in columns.items()])


def modest_batches(spark: SparkSession) -> None:
    """Texts may be long: from now on a batch of this session on its way to Python holds about four megabytes at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES or int(spark.conf.get(key).rstrip("b")) <= 0:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def per_block(
    df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Maps Arrow batches, cut so that a block holds few texts even where they are very long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, block_bytes):
                yield make(piece)

    modest_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, block_bytes: int) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * block_bytes / max(batch.nbytes, 1))))
    for at in range(0, rows, step):
        yield batch.slice(at, min(step, rows - at))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def row_key(columns: list[str]) -> list[Column]:
    """128 bits of a whole row as two longs; rows equal in all columns share them."""
    return [F.xxhash64(*columns).alias("key_a"), F.xxhash64(F.lit("again"), *columns).alias("key_b")]


def keep_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The whole rows whose key (key_a, key_b) is chosen; rows equal in all columns become one.

    The keys grow with the input and are not broadcast: equal rows have to be dealt together by key anyway.
    """
    a, b = row_key(docs.columns)
    keyed = docs.withColumns({"__key_a": a, "__key_b": b})
    wanted = chosen.select(F.col("key_a").alias("__key_a"), F.col("key_b").alias("__key_b"))
    return keyed.join(wanted.hint("merge"), ["__key_a", "__key_b"], "left_semi").dropDuplicates(["__key_a", "__key_b"]).drop("__key_a", "__key_b")
