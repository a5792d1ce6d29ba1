"""Bounded samples that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def _lot(*columns) -> F.Column:
    """A number below 2**30 that a row draws by its own content."""
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1 << 30))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """`most` different rows at the most, those that draw the least numbers: the same ones each time, however often a row or an id occurs.

    Rows that draw too much fall out where they are read; equal ones are reduced before they are moved.
    """
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*rows.columns), 0.02)).first()[0]
    drawn = rows.withColumn("_lot", _lot(*rows.columns))
    if n > most:
        drawn = drawn.where(F.col("_lot") < F.lit(int(min(1.0, 1.2 * most / n) * (1 << 30)) + 1))
    return drawn.distinct().orderBy("_lot", *rows.columns).limit(most).select(*rows.columns)


def labelled(documents: DataFrame, labels: DataFrame, column: str, most: int, wanted: int | None = None) -> DataFrame:
    """doc_id, text and label of `most` labelled ids at the most outside the held-out third. An id labelled twice has its larger label; of an id's texts the least counts.

    The ids are `most` at the most whatever the input, so they are broadcast.
    """
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    if wanted is not None:
        rows = rows.where(F.col(column) == wanted)
    of_id = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    ids = of_id.orderBy(_lot("doc_id"), "doc_id").limit(most)
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
