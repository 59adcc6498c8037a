"""Incremental ingestion of episode rows, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_new(stream: DataFrame, target: str, checkpoint: str, key: str, time: str) -> StreamingQuery:
    """Append the rows of a stream whose key is not in ``target`` yet; runs until the input is used up.

    Of the rows with one key in a batch the earliest by ``time`` counts; later repeats are dropped by an anti join with what
    was written. No row is too late: the stream has neither watermark nor state. Null is a key like others. A batch that is tried
    again is found written and adds nothing. A checkpoint of a stream with state can't be resumed; with a new one all input is
    read again, and what ``target`` lacks is added.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        at = F.struct(F.col(time).cast("timestamp"))
        rows = batch.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*batch.columns), at).alias("_row"))
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.parquet(target).select(F.col(key).alias("_done"))
            rows = rows.join(done, F.col("_key").eqNullSafe(F.col("_done")), "left_anti")
        rows.select("_row.*").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
