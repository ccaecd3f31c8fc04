"""Archive tables derived from the test tables, as DataFrames and as the same in DuckDB SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import regex_entities


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per non-blank line of a document; dates spread over 1900-1920."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("y", "text")).where(F.trim("text") != "")
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("y").cast("string")).alias("line_id"), F.col("doc_id").cast("string").alias("text_block_id"), "y", (F.col("y") % 3).cast("int").alias("x"), "text",
        "lang", "source", F.expr("cast(date_add(date'1900-01-01', cast(doc_id * 37 % 7670 AS int)) AS timestamp)").alias("date"), F.concat(F.col("source"), F.lit(".xml")).alias("filename"),
    )


def entities(spark: SparkSession, sf_dir: str, method: str = "a") -> DataFrame:
    kind = F.element_at(F.array(F.lit("person"), F.lit("location"), F.lit("organization")), F.length("entity_text") % 3 + 1)
    return regex_entities(lines(spark, sf_dir), {"a": "[A-Z][a-z]{3,}", "b": "[A-Z][a-z]{6,}"}[method], kind, F.length("entity_text") / 20.0)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lines(spark, sf_dir).groupBy("text_block_id").agg(F.min_by(F.struct("line_id", "lang"), "y").alias("x"))
    return first.select("x.line_id", F.col("x.lang").alias("primary_topic"))


def emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the events' values per day."""
    day = F.to_date("ts")
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    rows = table(spark, sf_dir, "events").groupBy(day.alias("day")).agg(
        mean("click").alias("mean_Joy"), mean("view").alias("mean_Love"), mean("signup").alias("mean_Fear"), mean("error").alias("mean_Anger"), mean("purchase").alias("mean_Sadness")
    )
    d = F.dayofmonth("day")
    return rows.select(
        F.concat(F.lit("N_"), F.date_format("day", "yyyy-MM-dd")).alias("id"), *(c for c in rows.columns if c != "day"), F.year("day").alias("year"),
        F.when(d <= 10, "pre war").when(d <= 20, "war").otherwise("post war").alias("era1"), F.when(d <= 15, "pre").otherwise("post").alias("era2"),
    )


def topic_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date and topics joined by bars, of documents."""
    return table(spark, sf_dir, "documents").select(
        F.expr("cast(date_add(date'1900-01-01', cast(doc_id % 30 AS int)) AS timestamp)").alias("date"), F.concat(F.col("lang"), F.lit("| "), F.col("source"), F.lit("| |"), F.col("lang")).alias("topics")
    )


def blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(date, block) and (block, entity, type)."""
    e = entities(spark, sf_dir, "b")
    mentioned = e.select(F.regexp_extract("line_id", r"^(\d+)_", 1).alias("block"), F.col("entity_text").alias("entity"), F.col("entity_type").alias("type"))
    return lines(spark, sf_dir).select("date", F.col("text_block_id").alias("block")).distinct(), mentioned


LINES = """lines AS (SELECT doc_id || '_' || pos AS line_id, CAST(doc_id AS VARCHAR) AS text_block_id, CAST(pos AS INT) AS y, CAST(pos % 3 AS INT) AS x, line AS text, lang, source,
  CAST(DATE '1900-01-01' + CAST(doc_id * 37 % 7670 AS INT) AS TIMESTAMP) AS date, source || '.xml' AS filename
  FROM (SELECT doc_id, lang, source, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> '')"""


def entities_cte(name: str, least: int) -> str:
    return f"""{name} AS (SELECT line_id, e AS entity_text, CASE length(e) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'location' ELSE 'organization' END AS entity_type, length(e) / 20.0 AS confidence
  FROM (SELECT line_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{{least},}}')) AS e FROM lines))"""


ENTITIES_A, ENTITIES_B = entities_cte("ea", 3), entities_cte("eb", 6)
TOPICS = "topics AS (SELECT line_id, lang AS primary_topic FROM (SELECT line_id, lang, row_number() OVER (PARTITION BY text_block_id ORDER BY y) AS rn FROM lines) WHERE rn = 1)"
EMOTIONS = """em AS (SELECT 'N_' || strftime(d, '%Y-%m-%d') AS id, mean_Joy, mean_Love, mean_Fear, mean_Anger, mean_Sadness, CAST(year(d) AS INT) AS year,
  CASE WHEN day(d) <= 10 THEN 'pre war' WHEN day(d) <= 20 THEN 'war' ELSE 'post war' END AS era1, CASE WHEN day(d) <= 15 THEN 'pre' ELSE 'post' END AS era2
  FROM (SELECT CAST(ts AS DATE) AS d, avg(CASE WHEN event_type = 'click' THEN value END) AS mean_Joy, avg(CASE WHEN event_type = 'view' THEN value END) AS mean_Love,
    avg(CASE WHEN event_type = 'signup' THEN value END) AS mean_Fear, avg(CASE WHEN event_type = 'error' THEN value END) AS mean_Anger, avg(CASE WHEN event_type = 'purchase' THEN value END) AS mean_Sadness
    FROM events GROUP BY 1))"""
LONG = "em_long AS (SELECT id, year, era1, era2, substr(e, 6) AS emotion, value FROM (UNPIVOT em ON mean_Joy, mean_Love, mean_Fear, mean_Anger, mean_Sadness INTO NAME e VALUE value))"
TOPIC_LISTS = "tl AS (SELECT CAST(DATE '1900-01-01' + CAST(doc_id % 30 AS INT) AS TIMESTAMP) AS date, lang || '| ' || source || '| |' || lang AS topics FROM documents)"
BLOCKS = """contains_ AS (SELECT DISTINCT date, text_block_id AS block FROM lines),
mentioned AS (SELECT split_part(line_id, '_', 1) AS block, entity_text AS entity, entity_type AS type FROM eb)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture-caption pairs: one per document with its whole text, and one without a text or with a blank one.

    Dated names but for each seventh, confidences but for each fifth, pictures for each third.
    """
    day = F.expr("date_format(date_add(date'1900-01-01', cast(doc_id * 37 % 7670 AS int)), 'yyyy-MM-dd')")
    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("doc_id") % 50).cast("double").alias("x2"), (F.col("doc_id") % 30).cast("double").alias("y2"), (F.col("doc_id") % 50).cast("double").alias("width"), (F.col("doc_id") % 30).cast("double").alias("height"))
    said = F.when(F.col("kind") == 0, F.col("text")).when(F.col("doc_id") % 2 == 1, " ")
    return table(spark, sf_dir, "documents").withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("odd"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("N_"), day, F.lit("_"), F.col("doc_id").cast("string"), F.when(F.col("kind") == 1, "b").otherwise(""))).alias("fulltext_basename"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("img/p"), F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("source_image"),
        F.concat(F.lit("a/p"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("source_fulltext"),
        F.struct(F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 100) / 100.0).alias("confidence"), box.alias("bbox")).alias("picture"), F.struct(said.alias("text_content")).alias("caption"), "source",
    )


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a page per document, each with its whole text: a text, and a picture and a title on even pages."""
    one = lambda c, p, x: f"named_struct('class', '{c}', 'confidence', {p}D, 'bbox', named_struct('x1', {x}D, 'y1', 0D, 'x2', {x + 10}D, 'y2', 10D), 'text_content', text)"
    kind = "array<struct<class:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text_content:string>>"
    made = F.expr(f"CASE WHEN doc_id % 2 = 0 THEN array({one('Picture', 0.75, 0)}, {one('Text', 0.25, 10)}, {one('Title', 0.5, 20)}) ELSE array({one('Text', 0.25, 5)}) END").cast(kind)
    day = F.expr("date_format(date_add(date'1900-01-01', cast(doc_id * 37 % 7670 AS int)), 'yyyy-MM-dd')")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("a/p"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_file"), day.alias("date"), F.lit(None).cast("int").alias("total_detections"),
        F.lit(None).cast("struct<by_class:map<string,int>>").alias("summary"), made.alias("detections"),
    )


def ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, entity and type of the longer entities."""
    rows = entities(spark, sf_dir, "b").join(lines(spark, sf_dir).select("line_id", "date"), "line_id")
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("entity_text").alias("entity"), F.col("entity_type").alias("type"))


PAIRS = """pairs AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'odd' || doc_id ELSE 'N_' || strftime(DATE '1900-01-01' + CAST(doc_id * 37 % 7670 AS INT), '%Y-%m-%d') || '_' || doc_id || CASE kind WHEN 1 THEN 'b' ELSE '' END END AS fulltext_basename,
  CASE WHEN doc_id % 3 = 0 THEN 'img/p' || doc_id || '.jpg' END AS source_image, CASE WHEN doc_id % 7 > 0 THEN CAST(DATE '1900-01-01' + CAST(doc_id * 37 % 7670 AS INT) AS TIMESTAMP) END AS date, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 100) / 100.0 END AS confidence,
  CAST(doc_id % 50 AS DOUBLE) * CAST(doc_id % 30 AS DOUBLE) AS area, CASE WHEN kind = 0 THEN text WHEN doc_id % 2 = 1 THEN ' ' END AS caption, source, doc_id FROM documents, (VALUES (0), (1)) k(kind))"""
NER = "ner AS (SELECT strftime(date, '%Y-%m-%d') AS date, entity_text AS entity, entity_type AS type FROM eb JOIN lines USING (line_id))"


# -- page and issue files rendered from documents, for the parsers

XML_NAME = "3074409X_%s_000_%d_H_1_%03d.xml"


def escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a page file per document, a line element per line, in folders of the documents' days."""
    day = F.expr("date_add(date'1900-01-01', cast(doc_id * 37 % 7670 AS int))")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda x: F.trim(x["l"]) != "")
    each = F.transform(kept, lambda x: F.concat(F.lit('<TextLine ID="l'), x["i"].cast("string"), F.lit('" HPOS="'), (x["i"] % 3).cast("string"), F.lit('.7" VPOS="'), x["i"].cast("string"), F.lit('"><String CONTENT="'), escaped(x["l"]), F.lit('"/></TextLine>')))
    made = F.concat(F.lit('<alto xmlns="urn:alto"><Layout><Page><PrintSpace><TextBlock ID="b">'), F.array_join(each, ""), F.lit("</TextBlock></PrintSpace></Page></Layout></alto>"))
    folder = F.concat(F.lit("/d/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/01/fulltext/"))
    name = F.format_string(XML_NAME, F.date_format(day, "yyyy-MM-dd"), F.col("doc_id") + 1, (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, name).alias("path"), made.cast("binary").alias("content"))


def issue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a metadata file for each page of an even document, with two pictures of the full size."""
    day = F.expr("date_add(date'1900-01-01', cast(doc_id * 37 % 7670 AS int))")
    name = F.format_string("3074409X_%s_000_%d_H_1.xml", F.date_format(day, "yyyy-MM-dd"), F.col("doc_id") + 1)
    number = F.col("doc_id").cast("string")
    made = F.concat(
        F.lit('<mets xmlns="urn:m" xmlns:x="urn:x"><dateIssued encoding="iso8601">'), F.date_format(day, "yyyy-MM-dd"), F.lit('</dateIssued><detail type="issue"><number>Nr. '), number,
        F.lit('</number></detail><physicalDescription><extent>'), (F.col("doc_id") % 9).cast("string"), F.lit(' Seiten</extent></physicalDescription><relatedItem type="host"><title>'), F.col("source"),
        F.lit('</title></relatedItem><fileGrp USE="MAX">'), *(F.concat(F.lit(f'<file ID="F{i}" MIMETYPE="image/{kind}"><FLocat x:href="http://h/'), number, F.lit(f'_{i}{end}"/></file>')) for i, kind, end in ((1, "jpeg", ".jpg?x=1"), (2, "tiff", ""))),
        F.lit('</fileGrp><fileGrp USE="MIN"><file ID="no"><FLocat x:href="http://h/no.jpg"/></file></fileGrp></mets>'),
    )
    folder = F.concat(F.lit("/d/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/01/"))
    return table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.concat(folder, name).alias("path"), made.cast("binary").alias("content"))
