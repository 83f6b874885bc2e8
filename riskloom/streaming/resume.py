"""An event log followed by a stream that may stop and start again at any time: each event is in the table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.sources.formats import register


def follow(spark: SparkSession, log: str, table: str, checkpoint: str, schema: str, until_now: bool = True, seconds: float = 1.0) -> StreamingQuery:
    """Starts (again) the stream that writes the events of the log files at `log` to a table.

    Batches are folders named by their number, and a batch that is run again after a failure overwrites its own. until_now:
    stop at what is there; else go on, looking for new lines every few seconds.
    """
    register(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    stream = spark.readStream.format("riskloom_events").schema(schema).load(log).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if until_now else stream.trigger(processingTime=f"{seconds} seconds")).start()


def since(spark: SparkSession, table: str, seq: int, by: str = "seq") -> DataFrame:
    """The events of a followed log after a sequence number, in order: what a reader that knows all up to it still needs."""
    return spark.read.option("basePath", table).parquet(table).drop("batch").where(F.col(by) > seq).orderBy(by)
