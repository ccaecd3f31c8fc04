"""Image files: checks by header, coverage and summaries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 1024
CHECKED = "file_path string, is_valid boolean, file_size long, width int, height int, format string, error string"


def dimensions(data: bytes) -> tuple[str, int, int]:
    """Format, width and height as the header tells; ValueError for anything else."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return "PNG", *struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "GIF", *struct.unpack("<HH", data[6:10])
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    break
                marker = data[at + 1]
                if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD7:
                    at += 1 if marker == 0xFF else 2
                    continue
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "JPEG", width, height
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[:4] in (b"II*\0", b"MM\0*"):
            order = "<" if data[:1] == b"I" else ">"
            at = struct.unpack(order + "I", data[4:8])[0]
            found = {}
            for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
                tag, kind = struct.unpack(order + "HH", data[at + 2 + 12 * i : at + 6 + 12 * i])
                found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), data[at + 10 + 12 * i : at + (12 if kind == 3 else 14) + 12 * i])[0]
            return "TIFF", found[256], found[257]
    except (struct.error, KeyError):
        pass
    raise ValueError("no image header")


def check(data: bytes, least: int = LEAST) -> tuple[bool, int | None, int | None, str | None, str | None]:
    """valid, width, height, format, error."""
    if len(data) < least:
        return False, None, None, None, f"too small: {len(data)} bytes"
    try:
        kind, width, height = dimensions(data)
    except ValueError as e:
        return False, None, None, None, str(e)
    return (True, width, height, kind, None) if width and height else (False, width, height, kind, "no area")


def validate(spark: SparkSession, path, least: int = LEAST) -> DataFrame:
    """A row per file: is_valid, size, width, height, format, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *check(c.as_py(), least)) for p, c in zip(batch["path"].to_pylist(), batch["content"], strict=True)]
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string())
            cells = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([cells[0], cells[1], batch["length"], *cells[2:]], names=["file_path", "is_valid", "file_size", "width", "height", "format", "error"])

    checked = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content").mapInArrow(run, CHECKED)
    none = [(p, False, 0, None, None, None, "too small: 0 bytes") for p in empty_files(spark, path)]
    return checked.unionByName(spark.createDataFrame(none, CHECKED)) if none else checked


def empty_files(spark: SparkSession, path) -> list[str]:
    """Files of no bytes below a path, which Spark's readers leave out."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for root in [path] if isinstance(path, str) else path:
        place = jvm.org.apache.hadoop.fs.Path(root)
        found = place.getFileSystem(conf).listFiles(place, True)
        while found.hasNext():
            status = found.next()
            if status.getLen() == 0:
                out.append(status.getPath().toString())
    return out


def large_enough(listing: DataFrame, least: int = LEAST) -> DataFrame:
    return listing.withColumn("large_enough", F.col("length") >= least)


def validation_summary(checked: DataFrame) -> DataFrame:
    bad = ~F.col("is_valid")
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~bad, 1)).alias("valid"), F.count(F.when(bad, 1)).alias("invalid"))


def coverage(targets: DataFrame, present: DataFrame) -> DataFrame:
    """Total, present, missing and percent of expected pictures; targets: target, present: path."""
    rows = targets.join(present.select(F.col("path").alias("target"), F.lit(1).alias("_p")).distinct(), "target", "left")
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.count("_p").alias("downloaded"), (n - F.count("_p")).alias("missing"), F.coalesce(F.try_divide(F.count("_p") * 100.0, n), F.lit(0.0)).alias("percent"))
