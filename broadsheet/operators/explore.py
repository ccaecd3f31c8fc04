"""Exploration: picture captions, layouts, mentions in captions, two-hop graph queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T



def caption() -> Column:
    return F.coalesce(F.col("caption.text_content"), F.lit(""))


def with_caption(pairs: DataFrame, present: bool = True) -> DataFrame:
    has = F.trim(caption()) != ""
    return pairs.where(has if present else ~has)


def confident(pairs: DataFrame, least: float) -> DataFrame:
    return pairs.where(F.coalesce(F.col("picture.confidence"), F.lit(0.0)) >= least)


def dated_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("date", D.basename_date(F.col("fulltext_basename")))


def caption_search(pairs: DataFrame, query: str, newest: bool = True, limit: int = 50) -> DataFrame:
    """Pairs whose caption contains the query in any case; ``marked`` has exact-case hits highlighted."""
    hits = dated_pairs(pairs).where(F.contains(F.lower(caption()), F.lit(query.lower())))
    order = F.desc_nulls_last("date") if newest else F.asc_nulls_first("date")
    return hits.withColumn("marked", T.highlight(caption(), query)).orderBy(order, "fulltext_basename").limit(limit)


def gallery(pairs: DataFrame, by: str = "date", descending: bool = True, page: int = 1, size: int = 12) -> DataFrame:
    """A page of pairs by date or confidence; a missing one counts as the least."""
    key = F.col("date") if by == "date" else F.coalesce(F.col("picture.confidence"), F.lit(0.0))
    rows = dated_pairs(pairs)
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "fulltext_basename").offset((page - 1) * size).limit(size)


def caption_coverage(pairs: DataFrame) -> DataFrame:
    has = F.trim(caption()) != ""
    n = F.count(F.lit(1))
    return pairs.agg(n.alias("total"), F.count(F.when(has, 1)).alias("with_caption"), F.round(F.coalesce(F.try_divide(F.count(F.when(has, 1)) * 100.0, n), F.lit(0.0)), 6).alias("percent"))


def picture_area(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("area", F.col("picture.bbox.width") * F.col("picture.bbox.height"))


def match_rate(rows: DataFrame, matched: Column, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(matched, 1)).alias("matched"), F.round(F.count(F.when(matched, 1)) * 100.0 / F.count(F.lit(1)), 6).alias("percent"))


def selected_classes(layouts: DataFrame, classes: list[str]) -> DataFrame:
    return layouts.withColumn("detections", F.filter("detections", lambda d: d["class"].isin(classes)))


def detection_stats(layouts: DataFrame) -> DataFrame:
    """Per page: total, by_class, has_pictures, text_regions, avg_confidence (0 without detections)."""
    d = F.coalesce(F.col("detections"), F.array().cast(layouts.schema["detections"].dataType))
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + F.coalesce(x["confidence"], F.lit(0.0)), lambda a: F.coalesce(F.try_divide(a, F.size(d)), F.lit(0.0)))
    return layouts.select(
        "image_file", F.coalesce("total_detections", F.size(d)).alias("total"), F.col("summary.by_class").alias("by_class"), F.exists(d, lambda x: x["class"] == "Picture").alias("has_pictures"),
        F.size(F.filter(d, lambda x: x["class"] == "Text")).alias("text_regions"), mean.alias("avg_confidence"),
    )


def region_text(layouts: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Texts of detections that properly meet a box, joined by blank lines."""
    meets = F.filter("detections", lambda d: (d["bbox"]["x1"] < x2) & (d["bbox"]["x2"] > x1) & (d["bbox"]["y1"] < y2) & (d["bbox"]["y2"] > y1) & (F.coalesce(d["text_content"], F.lit("")) != ""))
    return layouts.select("image_file", F.array_join(F.transform(meets, lambda d: d["text_content"]), "\n\n").alias("text"))


PIECE = 64
SPACE = r"\s+"
FEW = 500_000  # names up to which they are broadcast, as the size of exploded pieces can't be estimated


def places(text: Column, width: int, size: int) -> Column:
    """The pieces of up to ``size`` letters from each place with ``width`` letters behind it; short ones once."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (width - 1), F.lit(1)))
    pieces = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return pieces if size == PIECE else F.array_distinct(pieces)


CLASSES = {6: (PIECE, 6, PIECE), 3: (5, 3, 5), 2: (2, 2, 2), 1: (1, 1, 1), PIECE + 1: (None, PIECE, PIECE)}  # least length: greatest, letters of the key, letters of a piece


def containing(texts: DataFrame, key: str, column: str, names: DataFrame, name: str) -> DataFrame:
    """Distinct rows of key and all columns of ``names``: which non-empty ``name`` stands anywhere in which texts.

    A name without white space stands in a text only within one of its words, so the distinct words of all texts are
    searched, and what they hold is joined back to the texts by word; other names are searched in the texts themselves.
    Names are counted by kind first, so that only what they need is searched.
    """
    length = F.length(F.col(name))
    kind = F.when(length <= 2, length).when(length <= 5, 3).when(length <= PIECE, 6).otherwise(PIECE + 1)
    counted = names.groupBy(F.col(name).rlike(SPACE).alias("spaced"), kind.alias("least")).agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("shortest")).collect()
    few, out = sum(r.n for r in counted) <= FEW, texts.select(key).join(names, F.lit(False))
    for spaced in (False, True):
        kinds = sorted(r.least for r in counted if r.spaced == spaced)
        if not kinds:
            continue
        some = names.where(F.col(name).rlike(SPACE) == spaced)
        if spaced:
            found = searched(texts, key, column, some, name, kinds, few)
        else:
            shortest = min(r.shortest for r in counted if not r.spaced)
            words = texts.select(key, F.explode(F.array_distinct(F.split(F.col(column), SPACE))).alias("_word")).where(F.length("_word") >= shortest)
            held = searched(words.select("_word").distinct().withColumn("_in", F.col("_word")), "_word", "_in", some, name, kinds, few)
            found = words.join(held, "_word").select(key, *names.columns)
        out = out.unionByName(found)
    return out.distinct()


def searched(texts: DataFrame, key: str, column: str, names: DataFrame, name: str, kinds: list[int], few: bool) -> DataFrame:
    """Rows of key and all columns of ``names``: which names stand anywhere in which texts; kinds: the ``CLASSES`` there are.

    A text contains a name only where the name's first letters stand, so pieces of each text, of at most ``PIECE``
    letters from every place, are joined by their first 6 letters with the first 6 of the names, and what meets is
    compared; names of 3 to 5 letters by their first 3, shorter ones by all.  Names longer than a piece are compared with
    the whole text where their first ``PIECE`` letters stand.  Up to ``FEW`` names are broadcast, more are shuffled.
    """
    length, out = F.length(F.col(name)), None
    for least in kinds:
        most, width, size = CLASSES[least]
        some = names.where(length >= least if most is None else length.between(least, most)).withColumn("_key", F.substring(name, 1, width))
        some = F.broadcast(some) if few else some.hint("shuffle_hash")
        pieces = places(F.col(column), width, size)
        found = texts.select(key, F.explode(pieces).alias("_piece")).withColumn("_key", F.substring("_piece", 1, width)).join(some, "_key")
        if most is None:
            found = found.select(key, *names.columns).distinct().join(texts.select(F.col(key), F.col(column).alias("_text")), key).where(F.contains(F.col("_text"), F.col(name)))
        else:
            found = found.where(F.startswith(F.col("_piece"), F.col(name)))
        found = found.select(key, *names.columns)
        out = found if out is None else out.unionByName(found)
    return out


def captions(pairs: DataFrame) -> DataFrame:
    return pairs.select("fulltext_basename", F.lower(caption()).alias("_cap")).where("_cap <> ''")


def caption_names(pairs: DataFrame, ner: DataFrame) -> DataFrame:
    """(fulltext_basename, _ent): which lower-cased entity texts stand in which caption, in any case."""
    names = ner.select(F.lower("entity").alias("_ent")).where("_ent <> ''").distinct()
    return containing(captions(pairs), "fulltext_basename", "_cap", names, "_ent")


def caption_entities(pairs: DataFrame, ner: DataFrame) -> DataFrame:
    """Entities whose text occurs in a caption, in any case; a row per caption and entity row."""
    return caption_names(pairs, ner).join(ner.withColumn("_ent", F.lower("entity")), "_ent").drop("_ent")


def caption_entity_counts(pairs: DataFrame, ner: DataFrame) -> DataFrame:
    """fulltext_basename, entity, n: the rows of ``caption_entities``, counted without making them."""
    counts = ner.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).withColumn("_ent", F.lower("entity")).where("_ent <> ''")
    return containing(captions(pairs), "fulltext_basename", "_cap", counts, "_ent").select("fulltext_basename", "entity", "n")


def multimodal_index(layouts: DataFrame, emotions: DataFrame, ner: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per page: page_id, date, image_file, total_detections, has_picture, dominant_emotion, emotion_score, entity_count, top_entity.

    A page without date takes the second part of its id; its pictures are the pairs whose ``source_image`` holds its id.
    Of equally frequent emotions and entities the least counts; ``unknown`` and 0 stand for absent emotions.
    """
    own = F.col("stem") if "stem" in layouts.columns else D.stem(F.col("image_file"))
    page = layouts.withColumn("page_id", own).select(
        "page_id", F.coalesce(F.nullif("date", F.lit("")), F.get(F.split("page_id", "_"), F.lit(1))).alias("date"), "image_file", F.coalesce("total_detections", F.lit(0)).alias("total_detections")
    )
    emotion = emotions.groupBy("page_id").agg(F.mode("emotion", True).alias("_emotion"), F.avg("confidence").alias("_score"))
    people = ner.groupBy("date").agg(F.count(F.lit(1)).alias("_count"), F.mode("entity", True).alias("top_entity"))
    paths = pairs.select(F.col("source_image").alias("_path"), F.col("source_image").alias("_where")).where("_path <> ''").distinct()
    seen = containing(paths, "_path", "_where", page.select(F.col("page_id").alias("_id")).where("_id <> ''").distinct(), "_id")
    seen = seen.select(F.col("_id").alias("page_id"), F.lit(True).alias("_seen")).distinct()
    out = page.join(emotion, "page_id", "left").join(people, "date", "left").join(seen, "page_id", "left")
    return out.select(
        "page_id", "date", "image_file", "total_detections", F.coalesce("_seen", F.lit(False)).alias("has_picture"), F.coalesce("_emotion", F.lit("unknown")).alias("dominant_emotion"),
        F.coalesce("_score", F.lit(0.0)).alias("emotion_score"), F.coalesce("_count", F.lit(0)).alias("entity_count"), "top_entity",
    )


# -- the graph (Date)-[CONTAINS]->(TextBlock)-[MENTIONS]->(Entity), (Date)-[CONTAINS]->(Concept), as edge tables --------


def date_entities(contains: DataFrame, mentioned: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    """date, block, entity, type of both hops; contains: date, block; mentioned: block, entity, type."""
    rows = contains
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    out = rows.join(mentioned, "block").select("date", "block", "entity", "type").orderBy("date", "block", "entity", "type")
    return out if limit is None else out.limit(limit)


def graph_cooccurrence(mentioned: DataFrame, kind: str | None = None, limit: int | None = 100) -> DataFrame:
    """Pairs of entities by the number of blocks that mention both."""
    from .entities import co_occurrence

    m = mentioned.where(F.col("type") == kind) if kind else mentioned
    once = m.select("block", F.col("entity").alias("entity_text")).distinct()
    return co_occurrence(once, "block", None, limit)


def entity_timeline(contains: DataFrame, mentioned: DataFrame, name: str) -> DataFrame:
    return contains.join(mentioned.where(F.col("entity") == name), "block").groupBy("date").agg(F.count(F.lit(1)).alias("count")).orderBy("date")


def concept_network(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("date", "concept", "type").agg(F.count(F.lit(1)).alias("count"))


def entity_counts(rows: DataFrame) -> DataFrame:
    """Counts by Date and Type of rows whose date can be read."""
    return rows.withColumn("date", F.try_to_date("Date", "yyyy-MM-dd")).where("date is not null").groupBy("date", "Type").agg(F.count(F.lit(1)).alias("count"))


def date_graph(rows: DataFrame) -> DataFrame:
    """Distinct undirected date-entity edges of weight 1."""
    return rows.select(F.col("date").cast("string").alias("source"), F.col("entity").alias("target")).where("source is not null and target is not null").distinct().withColumn("weight", F.lit(1))


def line_counts(lines: DataFrame, by: str = "month") -> DataFrame:
    if by == "month":
        return lines.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("line_count"), F.countDistinct("text_block_id").alias("block_count"))
    return lines.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("total_lines"), F.countDistinct("date").alias("unique_dates"))
