"""OCR page XML (ALTO) and issue metadata XML (METS with MODS), parsed on the executors.

Files come from Spark's ``binaryFile`` reader, so any store that Spark reads will do.  A file that can't be parsed gives
no rows; it never fails the job.  Parsing is streaming per file: a task holds one file's bytes at a time.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..schemas import ISSUES

RAW_LINES = "path string, filename string, block_id string, own_id string, text string, x int, y int, width int, height int, ordinal int"
RAW_BLOCKS = "path string, page int, block_order int, text string"
IMAGES = "path string, file_id string, url string, mimetype string, extension string"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def integer(value: str | None) -> int | None:
    """Whole part of a number in any float notation; null for junk and what no int holds."""
    try:
        n = int(float(value))
        return n if -(2**31) <= n < 2**31 else None
    except (TypeError, ValueError, OverflowError):
        return None


def alto_lines(content: bytes) -> list[tuple]:
    """(block id, line id, text, x, y, width, height) in document order; nothing for files without a namespace."""
    root = ET.fromstring(content)
    if not root.tag.startswith("{"):
        return []
    rows = []
    for block in (b for b in root.iter() if local(b.tag) == "TextBlock" and b.get("ID")):
        for line in (x for x in block.iter() if local(x.tag) == "TextLine" and x.get("ID")):
            words = [w for s in line.iter() if local(s.tag) == "String" and (w := s.get("SUBS_CONTENT") or s.get("CONTENT"))]
            text = " ".join(" ".join(words).split())
            if text:
                rows.append((block.get("ID"), line.get("ID"), text, *(integer(line.get(k)) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))))
    return rows


def alto_blocks(content: bytes) -> list[tuple]:
    """(page number, place of the block, text) of blocks within print spaces, lines kept apart, long s written as s."""
    root = ET.fromstring(content)
    rows = []
    for number, page in enumerate((p for p in root.iter() if local(p.tag) == "Page"), 1):
        own = page.get("PHYSICAL_IMG_NR") or ""
        number = int(own) if re.fullmatch(r"\s*[+-]?\d+\s*", own) else number
        space = next((x for x in page.iter() if local(x.tag) == "PrintSpace"), None)
        for place, block in enumerate(b for b in space.iter() if local(b.tag) == "TextBlock") if space is not None else ():
            lines = []
            for line in (x for x in block.iter() if local(x.tag) == "TextLine"):
                words = [s.get("CONTENT").replace("ſ", "s") for s in line if local(s.tag) == "String" and s.get("CONTENT")]
                if words:
                    lines.append(" ".join(words))
            if text := "\n".join(lines).strip():
                rows.append((number, place, text))
    return rows


def first_text(root: ET.Element, *steps: Callable[[ET.Element], bool]) -> str | None:
    """Text of the first element at the end of a chain of descendants that meet the conditions."""
    level = [root]
    for step in steps:
        level = [x for parent in level for x in parent.iter() if x is not parent and step(x)]
    return next((t for x in level if (t := (x.text or "").strip())), None)


def named(name: str, **attributes: str) -> Callable[[ET.Element], bool]:
    return lambda x: local(x.tag) == name and all(x.get(k) == v for k, v in attributes.items())


def mets_issue(content: bytes) -> dict:
    """Fields of ``schemas.ISSUES`` but for the file's name and path."""
    from datetime import datetime

    root = ET.fromstring(content)
    day = first_text(root, named("dateIssued", encoding="iso8601"))
    try:
        date = datetime.fromisoformat(day).replace(tzinfo=None) if day else None
    except ValueError:
        date = None
    issue = first_text(root, named("detail", type="issue"), named("number"))
    extent = first_text(root, named("physicalDescription"), named("extent"))
    number, pages = re.search(r"Nr\.\s*(\d+)", issue or ""), re.search(r"(\d+)\s*Seiten?", extent or "")
    host = named("relatedItem", type="host")
    return {
        "date": date, "issue_string": issue, "issue_number": integer(number[1]) if number else None, "edition": first_text(root, named("partNumber")),
        "year_volume": first_text(root, named("detail", type="volume"), named("number")), "page_count": integer(pages[1]) if pages else None,
        "newspaper_title": first_text(root, host, named("title")), "newspaper_subtitle": None, "newspaper_id": first_text(root, host, named("identifier", type="zdb")),
        "language": first_text(root, named("languageTerm", type="code")),
    }


def mets_images(content: bytes) -> list[tuple]:
    """(file id, url, mimetype, extension) of the group of full-size images."""
    root = ET.fromstring(content)
    rows = []
    for group in (g for g in root.iter() if local(g.tag) == "fileGrp" and g.get("USE") == "MAX"):
        for file in (f for f in group.iter() if local(f.tag) == "file"):
            for place in (x for x in file.iter() if local(x.tag) == "FLocat"):
                url = next((v for k, v in place.attrib.items() if local(k) == "href"), None)
                if url:
                    rows.append((file.get("ID"), url, file.get("MIMETYPE"), PurePosixPath(re.sub(r"[?#].*$", "", url)).suffix or ".jpg"))
                    break
    return rows


def parsed(parse: Callable[[str, bytes], list[tuple]], names: list[str], kinds: list[pa.DataType]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    rows = parse(path, content.as_py())
                except (ET.ParseError, ValueError, TypeError, LookupError):
                    continue  # a damaged file gives no rows
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    table = {"string": pa.string(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC")}
    pairs = [x.split() for x in schema.split(", ")]
    return [n for n, _ in pairs], [table[k] for _, k in pairs]


def files(spark: SparkSession, paths: str | list[str], limit: int | None = None, fulltext: bool = True) -> DataFrame:
    """(path, content) of XML files: those in ``fulltext`` folders, or those of paths without that word."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(paths).select("path", "content")
    found = found.where(F.col("path").rlike(r"/fulltext/[^/]+\.xml$") if fulltext else ~F.contains("path", F.lit("fulltext")))
    if limit is not None:
        first = found.select("path").orderBy(D.natural_key(F.col("path"))).limit(limit)
        found = found.join(first, "path", "left_semi")
    return found


def pending(spark: SparkSession, root: str | list[str], seen: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """path and filename of the page files whose name isn't in ``seen`` (column filename), the first ``limit`` in natural order."""
    rows = listing(spark, root, "*.xml").where(F.col("path").rlike(r"/fulltext/[^/]+\.xml$")).select("path", "filename")
    if seen is not None:
        rows = rows.join(seen.select("filename").distinct(), "filename", "left_anti").select("path", "filename")
    return rows if limit is None else rows.orderBy(D.natural_key(F.col("path")), "path").limit(limit)


def raw_lines(found: DataFrame) -> DataFrame:
    def parse(path: str, content: bytes) -> list[tuple]:
        return [(path, PurePosixPath(path).name, *row, i) for i, row in enumerate(alto_lines(content))]

    return found.mapInArrow(parsed(parse, *_columns(RAW_LINES)), RAW_LINES)


def scan_issues(found: DataFrame) -> DataFrame:
    names, kinds = _columns(ISSUES)

    def parse(path: str, content: bytes) -> list[tuple]:
        row = {"filename": PurePosixPath(path).name, "path": path} | mets_issue(content)
        return [tuple(row[n] for n in names)]

    return found.mapInArrow(parsed(parse, names, kinds), ISSUES)


def scan_images(found: DataFrame) -> DataFrame:
    def parse(path: str, content: bytes) -> list[tuple]:
        return [(path, *row) for row in mets_images(content)]

    return found.mapInArrow(parsed(parse, *_columns(IMAGES)), IMAGES)


def scan_blocks(found: DataFrame) -> DataFrame:
    """Block-level rows with the issue that the folder tells: uid, year, month, day, issue."""

    def parse(path: str, content: bytes) -> list[tuple]:
        return [(path, *row) for row in alto_blocks(content)]

    rows = found.mapInArrow(parsed(parse, *_columns(RAW_BLOCKS)), RAW_BLOCKS)
    return rows.withColumn("_i", D.fulltext_issue(F.col("path"))).select("path", "_i.*", "page", "block_order", "text")


def with_metadata(rows: DataFrame, issues: DataFrame | None) -> DataFrame:
    """Lines with the columns of ``schemas.LINES``: what the name tells, and the issue's metadata (left join by path)."""
    base = rows.withColumn("_n", D.alto_name(F.col("filename"))).withColumn("_m", D.mets_path(F.col("path")))
    base = base.withColumn("page_id", D.page_id(F.col("filename"), F.col("_n.date"), F.col("_n.issue_number"), F.col("_n.daily_issue_number"), F.col("_n.page_number")))
    if issues is not None:
        own = issues.select(F.col("path").alias("_m"), "year_volume", "page_count", "newspaper_title", "newspaper_subtitle")
        base = base.join(own, "_m", "left")
    else:
        base = base.selectExpr("*", "cast(null as string) year_volume", "cast(null as int) page_count", "cast(null as string) newspaper_title", "cast(null as string) newspaper_subtitle")
    date = F.col("_n.date")
    return base.select(
        F.concat_ws("_", "filename", "block_id", "own_id").alias("line_id"), "text", F.concat_ws("_", "page_id", "block_id").alias("text_block_id"), "page_id", "filename", date.alias("date"),
        F.year(date).alias("year"), F.month(date).alias("month"), F.day(date).alias("day"), "x", "y", "width", "height", F.col("_n.newspaper_id").alias("newspaper_id"), F.col("_n.issue_number").alias("issue_number"),
        F.col("_n.daily_issue_number").alias("daily_issue_number"), F.col("_n.page_number").alias("page_number"), "year_volume", "page_count", "newspaper_title", "newspaper_subtitle",
    )


def scan_lines(spark: SparkSession, root: str | list[str], limit: int | None = None, seen: DataFrame | None = None, issues: bool = True, chosen: DataFrame | None = None) -> DataFrame:
    """All lines below ``root``, or those of the ``chosen`` files (column path).

    Files whose name is in ``seen`` (column filename) are left out first, then the first ``limit`` of the others are taken.
    """
    found = files(spark, root)
    if chosen is None and (seen is not None or limit is not None):
        chosen = pending(spark, root, seen, limit)
    if chosen is not None:
        found = found.join(chosen.select("path"), "path", "left_semi")
    metadata = scan_issues(files(spark, root, fulltext=False)) if issues else None
    return with_metadata(raw_lines(found), metadata)


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of named files, without metadata."""
    if not paths:
        return spark.createDataFrame([], "line_id string, text string")
    return with_metadata(raw_lines(spark.read.format("binaryFile").load(paths).select("path", "content")), None)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, filename, length of files; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length")


def empty_files(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Files of a listing without any line."""
    return found.join(lines.select("filename").distinct(), "filename", "left_anti")


def expected_files(images: DataFrame) -> DataFrame:
    """What an issue's images lead to expect: the picture and the page's XML (null for ids that are no page numbers)."""
    number = F.regexp_extract("file_id", r"(\d+)", 1)
    folder, stem = F.regexp_replace("path", r"/[^/]+$", ""), D.stem(F.col("path"))
    suffix = F.when(F.contains(F.lower("mimetype"), F.lit("tif")), ".tif").otherwise(".jpg")
    page = F.format_string("%s/fulltext/%s_%03d.xml", folder, stem, number.try_cast("int"))
    return images.select("path", "file_id", F.concat(folder, F.lit("/"), "file_id", suffix).alias("image"), F.when(number.try_cast("int").isNotNull(), page).alias("alto"))


def completeness(images: DataFrame, present: DataFrame) -> DataFrame:
    """Per issue: expected and found pictures and pages; present: a listing with column path."""
    expected = expected_files(images)
    have = present.select("path").distinct()
    rows = expected.join(have.withColumnRenamed("path", "image").withColumn("_i", F.lit(1)), "image", "left").join(have.withColumnRenamed("path", "alto").withColumn("_a", F.lit(1)), "alto", "left")
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("expected"), F.count("_i").alias("images_found"), F.count("_a").alias("alto_found"),
        F.sort_array(F.collect_list(F.when(F.col("_a").isNull() & F.col("alto").isNotNull(), F.col("alto")))).alias("missing_alto"),
        F.sort_array(F.collect_list(F.when(F.col("_i").isNull(), F.col("image")))).alias("missing_images"),
    )


def image_targets(images: DataFrame, images_root: str, mets_root: str) -> DataFrame:
    """Where each picture belongs: the images root, the issue's folder below the METS root, id and extension."""
    relative = F.regexp_replace(F.regexp_replace("path", r"/[^/]+$", ""), "^.*?" + re.escape(mets_root.rstrip("/")) + "/?", "")
    return images.withColumn("target", F.concat_ws("/", F.lit(images_root.rstrip("/")), relative, F.concat("file_id", "extension")))
