"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; callers may pass any other path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that the cluster shares.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, local
    masters use /tmp/checkpoints and others a folder of the warehouse.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            local = context.master.startswith("local") and not context.master.startswith("local-cluster")
            place = "/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(place)
    return df.checkpoint()


#: Bytes of a batch of texts between Spark and Python. A batch stands on either side, and twice on Spark's while its buffer grows.
BATCH = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """Batches that Arrow passes to Python within are of about `size` bytes, however long the texts are, in place of a number of rows alone. Of what runs within, not of what is only declared there."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(spark: SparkSession, wait: float = 0.3) -> None:
    """Lets the driver find plans that nothing refers to any more, so that Spark's cleaner removes their shuffle files before the next job writes its own.

    The bridge to the JVM lets go of collected objects in a thread of its own, which looks for them once a second: after a shorter `wait` they may go at the next call only.
    """
    gc.collect()
    time.sleep(wait)
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 1 on division by 3. A null id counts as the empty text."""
    return F.expr(f"crc32(encode(coalesce(cast({doc_id} as string), ''), 'UTF-8')) % 3 = 1")


def whole_texts(documents: DataFrame) -> DataFrame:
    """doc_id as text (pandas would turn a long column with a null into floats) and text, null read as empty. Further columns are dropped."""
    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def long_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL: unsigned crc32 of an ASCII text, bit by bit."""
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: ascii(c)::ubigint)"
    bits = "list_reduce(list_prepend(xor(crc, b), range(8)::ubigint[]), lambda x, y: if(x & 1 = 1, xor(x >> 1, 3988292384::ubigint), x >> 1))"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {codes}), lambda crc, b: {bits}), 4294967295::ubigint)"
