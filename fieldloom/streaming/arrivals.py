"""Months as they arrive: a stream of pixel files kept as monthly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.indices import with_indices
from ..operators.zonal import zonal_stats
from ..sources.files import write_months


def ingest(pixels: DataFrame, history: str, stats: str, checkpoint: str) -> StreamingQuery:
    """pixels: a stream of (parcel_id, month, bands). Each batch is added to history, and the statistics of the months
    that it touches are computed anew from all their pixels. A batch has a folder of its own there, which a replay after a failure
    writes anew, so its pixels count once. Ends when what is there has been read."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.withColumn("batch", F.lit(number)).write.option("partitionOverwriteMode", "dynamic").partitionBy("batch", "month").mode("overwrite").parquet(history)
        touched = [r["month"] for r in rows.select("month").distinct().collect()]  # a row for each month
        all_rows = spark.read.schema(T.StructType([*rows.schema, T.StructField("batch", T.LongType())])).parquet(history).drop("batch").where(f"month in ({', '.join(map(str, touched)) or 'null'})")
        write_months(zonal_stats(with_indices(all_rows)), stats)

    return pixels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
