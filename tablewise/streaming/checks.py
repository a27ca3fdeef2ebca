"""Contracts on a stream: every micro-batch is checked like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewise.operators.quality import Rule, check


def check_stream(stream: DataFrame, rules: list[Rule], output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch's results, with its number, to a Parquet folder.

    A batch that is tried again overwrites its own partition, so results count once."""

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            check(batch, rules).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
