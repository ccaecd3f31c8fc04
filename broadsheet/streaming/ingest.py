"""Incremental ingest: new page files to a growing table of lines, each file once.

The checkpoint keeps which files were read, also those without text; a restarted query goes on where it stopped.  Batches
are appended as Parquet partitioned by year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import xml

FILES = "path string, modificationTime timestamp, length long, content binary"


def pages(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, content) of page files."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", per_batch)
    return reader.load(root).where(F.col("path").rlike(r"/fulltext/[^/]+\.xml$")).select("path", "content")


def append_lines(stream: DataFrame, target: str, checkpoint: str, issues: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Start the ingest; with ``once`` it ends when all present files are read."""

    def write(batch: DataFrame, epoch: int) -> None:
        lines = xml.with_metadata(xml.raw_lines(batch), issues).withColumn("_epoch", F.lit(epoch))
        # a repeated epoch overwrites its own folders
        lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("_epoch", "year").parquet(target)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(stream: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts per window and key, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))
