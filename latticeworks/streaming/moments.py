"""Gram matrices over micro-batches: they add, so a stream of design rows needs no state but one matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticeworks.operators.regression import gram_rows


def merged(total: DataFrame | None, part: DataFrame) -> DataFrame:
    """The sum of two tables (i, j, g)."""
    return part if total is None else total.unionByName(part).groupBy("i", "j").agg(F.sum("g").alias("g"))


def append_to(path: str):
    """A foreachBatch function that appends each batch's Gram rows under its batch id: a batch that runs twice overwrites itself."""

    def add(batch: DataFrame, batch_id: int) -> None:
        gram_rows(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return add


def stream_gram(design: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream of design rows (phi, t) into Gram rows at path, one pass over what is there now."""
    return design.writeStream.foreachBatch(append_to(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_gram(spark, path: str) -> DataFrame:
    """The sum of all batches."""
    return spark.read.parquet(path).groupBy("i", "j").agg(F.sum("g").alias("g"))
