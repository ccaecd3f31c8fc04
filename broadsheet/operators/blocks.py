"""Lines to text blocks, sentences, chunks and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

METADATA = ("page_id", "date", "filename", "newspaper_id", "newspaper_title", "year", "month", "day")


def need(df: DataFrame, columns) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")


def text_blocks(lines: DataFrame, group_by=("text_block_id",), sort_by=("y", "x"), separator: str = " ") -> DataFrame:
    """Lines of a block in reading order joined to one text, with counts, places and the metadata of its first line."""
    need(lines, ["text", *group_by, *sort_by])
    order = F.struct(*sort_by)
    ordered = ", ".join(f"`{c}` ASC NULLS FIRST" for c in sort_by)
    made = [F.expr(f"listagg(`text`, '{separator}') WITHIN GROUP (ORDER BY {ordered})").alias("text"), F.count(F.lit(1)).cast("int").alias("line_count")]
    for name, how in (("avg", F.avg), ("min", F.min), ("max", F.max)):
        made += [how(c).alias(f"{name}_{c}") for c in ("x", "y") if c in lines.columns]
    made += [F.min_by(c, order).alias(c) for c in METADATA if c in lines.columns and c not in group_by]
    return lines.groupBy(*group_by).agg(*made)


def sentences(df: DataFrame, column: str = "text") -> DataFrame:
    """A row per sentence with its number from 0 and their count; texts without one have no row."""
    need(df, [column])
    parts = df.withColumn("_s", T.sentences(F.col(column)))
    return parts.select(*df.columns, F.posexplode("_s").alias("sentence_id", "sentence"), F.size("_s").alias("sentence_count"))


def chunks(df: DataFrame, column: str = "text", size: int = 5, least: int = 100) -> DataFrame:
    """Chunks of ``size`` sentences with at least so many characters: chunk_id, chunk."""
    need(df, [column])
    return df.select(*df.columns, F.posexplode(T.sentence_windows(F.col(column), size, least)).alias("chunk_id", "chunk"))


def documents(df: DataFrame, column: str = "text", enough: int = 3) -> DataFrame:
    """Representative documents of an issue's text: part, doc."""
    return df.select(*df.columns, F.posexplode(T.split_into_docs(F.col(column), enough)).alias("part", "doc"))


def issue_texts(pages: DataFrame, keys=("date", "issue"), page: str = "page", column: str = "text", least: int = 100) -> DataFrame:
    """Pages of at least ``least`` characters joined per issue in page order."""
    need(pages, [*keys, page, column])
    long = pages.where(F.length(column) >= least)
    return long.groupBy(*keys).agg(F.expr(f"listagg(`{column}`, ' ') WITHIN GROUP (ORDER BY `{page}`)").alias("text"), F.count(F.lit(1)).alias("num_pages"))


def issue_export(blocks: DataFrame, key: str = "uid") -> DataFrame:
    """(key, value): text of an issue with page headings, blocks in order, blank lines between; blocks: page, block_order, text."""
    need(blocks, [key, "page", "block_order", "text"])
    page = blocks.groupBy(key, "page").agg(F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY block_order)").alias("t"))
    page = page.withColumn("t", F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n\n"), "t"))
    return page.groupBy(key).agg(F.expr("listagg(t, '\n\n') WITHIN GROUP (ORDER BY page)").alias("value"))
