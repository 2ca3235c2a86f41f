"""Late-arriving panel rows as a Structured Streaming job (U1, incremental).

The reference appends a late extract to the panel in one batch.  When late
extracts keep arriving as files, the same append runs as a file-source
stream: each new file is picked up once (the source's file log lives in the
checkpoint), written to a Parquet sink, and the current panel is the union
by name of the base panel and the sink.  ``availableNow`` processes what is
there and stops, so the job can be scheduled like a batch job and restarted
after a failure without duplicating rows (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.joins import append_panel
from ..session import scratch_path

LATE_SCHEMA = T.StructType([
    T.StructField("series", T.LongType()),
    T.StructField("county", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("t", T.DateType()),
    T.StructField("density", T.DoubleType()),
])


def ingest_late(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                schema: T.StructType = LATE_SCHEMA) -> int:
    """Move every late file under ``source_dir`` not yet seen into the Parquet
    sink; returns the number of micro-batches run."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    query = (stream.writeStream.format("parquet")
             .option("path", sink_dir)
             .option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
    return len(query.recentProgress)


def panel_with_late(spark: SparkSession, panel: DataFrame, sink_dir: str,
                    schema: T.StructType = LATE_SCHEMA) -> DataFrame:
    """The base panel plus every late row ingested so far (by column name;
    columns missing from the late rows are NULL)."""
    late = spark.read.schema(schema).parquet(sink_dir)
    return append_panel(panel, late)


def stream_append(spark: SparkSession, panel: DataFrame, late: DataFrame) -> DataFrame:
    """End to end in the shared folder: land ``late`` as source files, run the
    stream once, return the appended panel."""
    src = scratch_path(spark, "late-src")
    late.write.parquet(src)
    sink = scratch_path(spark, "late-sink")
    ingest_late(spark, src, sink, scratch_path(spark, "late-ckpt"), late.schema)
    return panel_with_late(spark, panel, sink, late.schema)
