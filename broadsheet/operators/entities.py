"""Entities: extraction, mentions, frequencies, comparison of methods."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import RESPONSES

# Labels of a German entity model and our types.
LABELS = {"Person": "person", "Organisation": "organization", "Ereignis": "event", "Ort": "location"}


def entity_type(label: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, label), F.lower(label))


def regex_entities(lines: DataFrame, pattern: str = "[A-Z][a-z]{3,}", typed: Column | None = None, confidence: Column | None = None) -> DataFrame:
    """The built-in extractor: matches of a pattern; type and confidence are expressions over entity_text."""
    found = lines.select("line_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("entity_text"))
    return found.select("line_id", "entity_text", (F.lit("person") if typed is None else typed).alias("entity_type"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"))


def model_entities(
    lines: DataFrame, model: Callable[[], Callable[[list[str]], list[list[tuple[str, str, float]]]]], least: int = 100, most: int = 500, threshold: float = 0.5, batch: int = 32
) -> DataFrame:
    """Entities of an injected model: ``model()`` is called once per task and returns a function of a list of texts.

    Its results are (text, label, score) per text.  Texts under ``least`` characters are left out, longer ones cut at
    ``most``; scores below ``threshold`` are dropped.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = model()
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                rows = [(i, t, label, float(s)) for i, found in zip(part["line_id"].to_pylist(), extract(part["text"].to_pylist()), strict=True) for t, label, s in found if s >= threshold]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["line_id", "entity_text", "label", "confidence"])

    long = lines.where(F.length("text") >= least).select("line_id", T.truncate(T.collapse(T.normalize(F.col("text"))), most).alias("text"))
    return long.mapInArrow(run, "line_id string, entity_text string, label string, confidence double").select("line_id", "entity_text", entity_type(F.col("label")).alias("entity_type"), "confidence")


def response_entities(responses: DataFrame, column: str = "response") -> DataFrame:
    """Entities from a language model's JSON answers; nulls count as empty lists, unreadable answers give no rows."""
    r = F.from_json(F.col(column), RESPONSES["entities"], {"mode": "PERMISSIVE"})

    def listed(field: str, kind: str) -> Column:
        return F.transform(F.coalesce(r[field], F.array().cast("array<string>")), lambda x: F.struct(x.alias("entity_text"), F.lit(kind).alias("entity_type")))

    every = F.concat(listed("persons", "person"), listed("locations", "location"), listed("organizations", "organization"))
    return responses.select("line_id", F.explode(every).alias("e")).select("line_id", "e.entity_text", "e.entity_type", F.lit(None).cast("double").alias("confidence"))


def grouped_entities(entities: DataFrame, labels=("person", "location", "organization")) -> DataFrame:
    """Per line_id a map of every label to its lower-cased texts, each once, in the order of first sight (by ``pos``)."""
    pos = "pos" if "pos" in entities.columns else None
    first = entities.groupBy("line_id", "entity_type", F.lower("entity_text").alias("t")).agg((F.min(pos) if pos else F.min(F.lower("entity_text"))).alias("p"))
    lists = first.groupBy("line_id", "entity_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]).alias("texts"))
    by = lists.groupBy("line_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "texts"))).alias("m"))
    none = F.array().cast("array<string>")
    full = F.map_from_entries(F.array(*(F.struct(F.lit(x).alias("k"), F.coalesce(F.try_element_at("m", F.lit(x)), none).alias("v")) for x in labels)))
    return by.select("line_id", full.alias("entities"))


def mentions(entities: DataFrame, lines: DataFrame, name: str, kind: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Mentions of one entity with their lines, by date; dates inclusive."""
    e = entities.where(F.col("entity_text") == name)
    if kind:
        e = e.where(F.col("entity_type") == kind)
    s = between(lines, start, end).select(*(c for c in ("line_id", "text", "date", "filename", "text_block_id") if c in lines.columns))
    return e.join(s, "line_id").select("entity_text", "entity_type", "confidence", *s.columns).orderBy("date", "line_id")


def between(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Rows of dates within both ends, each of which may be left out."""
    if start is not None:
        df = df.where(F.col(column) >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.where(F.col(column) <= F.to_timestamp(F.lit(end)))
    return df


def time_period(by: str) -> Column:
    if by not in ("year", "month", "date"):
        raise ValueError(f"group_by must be year, month or date, not {by!r}")
    return {"year": F.year("date"), "month": F.date_trunc("month", "date"), "date": F.col("date")}[by]


def entity_frequency(entities: DataFrame, lines: DataFrame, group_by: str = "year", min_mentions: int = 5, kind: str | None = None) -> DataFrame:
    """Mentions per period, text and type of at least ``min_mentions``, most frequent first within a period."""
    e = entities.where(F.col("entity_type") == kind) if kind else entities
    joined = e.select("line_id", "entity_text", "entity_type").join(lines.select("line_id", "date"), "line_id")
    counts = joined.groupBy(time_period(group_by).alias("time_period"), "entity_text", "entity_type").agg(F.count(F.lit(1)).alias("mention_count"))
    return counts.where(F.col("mention_count") >= min_mentions).orderBy("time_period", F.desc("mention_count"), "entity_text", "entity_type")


def topic_distribution(topics: DataFrame, lines: DataFrame, group_by: str = "year") -> DataFrame:
    joined = topics.select("line_id", "primary_topic").join(lines.select("line_id", "date"), "line_id")
    return joined.groupBy(time_period(group_by).alias("time_period"), "primary_topic").agg(F.count(F.lit(1)).alias("count")).orderBy("time_period", F.desc("count"), "primary_topic")


def compare_methods(a: DataFrame, b: DataFrame, lines: DataFrame, kind: str | None = None) -> DataFrame:
    """What one method found on a line and the other didn't: two anti joins instead of a full outer one."""
    on = ["line_id", "entity_text"]
    only = a.join(b, on, "left_anti").select("line_id", F.col("entity_text").alias("method1_entity"), F.col("entity_type").alias("method1_type"), F.lit(None).cast("string").alias("method2_entity"), F.lit(None).cast("string").alias("method2_type"))
    other = b.join(a, on, "left_anti").select("line_id", F.lit(None).cast("string").alias("method1_entity"), F.lit(None).cast("string").alias("method1_type"), F.col("entity_text").alias("method2_entity"), F.col("entity_type").alias("method2_type"))
    both = only.unionByName(other)
    if kind:
        both = both.where((F.col("method1_type") == kind) | (F.col("method2_type") == kind))
    return both.join(lines.select("line_id", "text", "date"), "line_id")


def coverage(a: DataFrame, b: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines covered by both methods, each, either alone: one row."""
    flags = lines.select("line_id").distinct()
    flags = flags.join(a.select("line_id").distinct().withColumn("a", F.lit(1)), "line_id", "left").join(b.select("line_id").distinct().withColumn("b", F.lit(1)), "line_id", "left")
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    # null line ids count as no line
    named = flags.where(F.col("line_id").isNotNull())
    count = lambda c: F.count(F.when(c, 1))
    return named.agg(
        F.count(F.lit(1)).alias("total_lines"), count(has_a).alias("llm_coverage"), count(has_b).alias("gliner_coverage"), count(has_a & has_b).alias("both_methods"),
        count(has_a & ~has_b).alias("llm_only"), count(~has_a & has_b).alias("gliner_only"),
    )


def method_statistics(methods: dict[str, DataFrame]) -> DataFrame:
    """Entities, distinct texts and lines per method."""
    out = None
    for name, e in methods.items():
        row = e.agg(F.count(F.lit(1)).alias("total_entities"), F.countDistinct("entity_text").alias("unique_entities"), F.countDistinct("line_id").alias("lines_with_entities")).select(F.lit(name).alias("method"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def type_distribution(methods: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, e in methods.items():
        rows = e.groupBy("entity_type").agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("method"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("method", "entity_type")


def keyed(e: DataFrame) -> DataFrame:
    return e.select(T.match_key(F.col("entity_text")).alias("key"), "entity_type", "entity_text").distinct()


def agreement(a: DataFrame, b: DataFrame, limit: int = 50, by_mentions: bool = False) -> DataFrame:
    """Entities that both methods name, up to case and blanks; ``by_mentions`` counts mentions instead of spellings."""
    left = keyed(a).withColumnRenamed("entity_text", "llm_text")
    right = keyed(b).withColumnRenamed("entity_text", "gliner_text")
    if by_mentions:
        left = a.groupBy(T.match_key(F.col("entity_text")).alias("key"), "entity_type").agg(F.min("entity_text").alias("llm_text"), F.count(F.lit(1)).alias("n1"))
        right = b.groupBy(T.match_key(F.col("entity_text")).alias("key"), "entity_type").agg(F.min("entity_text").alias("gliner_text"), F.count(F.lit(1)).alias("n2"))
        joined = left.join(right, ["key", "entity_type"]).select("llm_text", "gliner_text", "entity_type", F.least("n1", "n2").alias("agreement_count"))
    else:
        joined = left.join(right, ["key", "entity_type"]).groupBy("llm_text", "gliner_text", "entity_type").agg(F.count(F.lit(1)).alias("agreement_count"))
    return joined.orderBy(F.desc("agreement_count"), "llm_text", "gliner_text", "entity_type").limit(limit)


def only_in(a: DataFrame, b: DataFrame, limit: int = 25) -> DataFrame:
    """Entities of the first method that the second doesn't name."""
    rest = keyed(a).join(keyed(b).select("key", "entity_type").distinct(), ["key", "entity_type"], "left_anti")
    return rest.groupBy("entity_text", "entity_type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "entity_text", "entity_type").limit(limit)


def method_counts(a: DataFrame, b: DataFrame, kind: str = "person", more_than: int = 10) -> DataFrame:
    """Mentions by the first method and how many of them pair with the second's on the same line."""
    other = b.groupBy("line_id", "entity_text").agg(F.count(F.lit(1)).alias("n"))
    rows = a.where(F.col("entity_type") == kind).join(other, ["line_id", "entity_text"], "left")
    # a left join repeats a row for each partner
    sums = rows.groupBy("entity_text").agg(F.sum(F.coalesce("n", F.lit(1))).alias("gliner_count"), F.sum(F.coalesce("n", F.lit(0))).alias("llm_count"))
    return sums.where(F.col("gliner_count") > more_than).orderBy(F.desc("gliner_count"), "entity_text")


def co_occurrence(entities: DataFrame, key: str = "line_id", more_than: int | None = 5, limit: int | None = 20, kind: str | None = None) -> DataFrame:
    """Pairs of texts on one line (or block), counted; a line's repeats of a text count as often as they pair."""
    e = entities.where(F.col("entity_type") == kind) if kind else entities
    # repeats within a line are counted before the join, so that it makes a row per pair of different texts
    per = e.groupBy(key, "entity_text").agg(F.count(F.lit(1)).alias("n"))
    a = per.select(key, F.col("entity_text").alias("entity1"), F.col("n").alias("n1"))
    b = per.select(key, F.col("entity_text").alias("entity2"), F.col("n").alias("n2"))
    counts = a.join(b, key).where("entity1 < entity2").groupBy("entity1", "entity2").agg(F.sum(F.col("n1") * F.col("n2")).alias("co_occurrences"))
    if more_than is not None:
        counts = counts.where(F.col("co_occurrences") > more_than)
    counts = counts.orderBy(F.desc("co_occurrences"), "entity1", "entity2")
    return counts if limit is None else counts.limit(limit)


def top_entities(entities: DataFrame, kind: str | None = None, limit: int | None = 10, digits: int = 9) -> DataFrame:
    e = entities.where(F.col("entity_type") == kind) if kind else entities
    out = e.groupBy("entity_text").agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg("confidence"), digits).alias("avg_confidence"), F.max("confidence").alias("max_confidence")).orderBy(F.desc("mentions"), "entity_text")
    return out if limit is None else out.limit(limit)


def first_last_mention(entities: DataFrame, lines: DataFrame, more_than: int = 100) -> DataFrame:
    joined = entities.select("line_id", "entity_text", "entity_type").join(lines.select("line_id", "date"), "line_id")
    out = joined.groupBy("entity_text", "entity_type").agg(F.min("date").alias("first_mention"), F.max("date").alias("last_mention"), F.count(F.lit(1)).alias("total_mentions"))
    return out.where(F.col("total_mentions") > more_than).orderBy(F.desc("total_mentions"), "entity_text", "entity_type")


def yearly_entities(entities: DataFrame, lines: DataFrame) -> DataFrame:
    joined = entities.select("line_id", "entity_text", "entity_type").join(lines.select("line_id", "date"), "line_id")
    return joined.groupBy(F.year("date").alias("year"), "entity_type").agg(F.countDistinct("entity_text").alias("unique_entities"), F.count(F.lit(1)).alias("total_mentions")).orderBy("year", "entity_type")


def entity_summary(entities: DataFrame, digits: int = 9) -> DataFrame:
    """Per type and, with a null type, over all: counts, distinct texts, confidence."""
    return entities.rollup("entity_type").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("entity_text").alias("unique_entities"), F.round(F.avg("confidence"), digits).alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
    )


def entity_mentions_view(entities: DataFrame, lines: DataFrame) -> DataFrame:
    return entities.join(lines.select("line_id", "text", "date", "text_block_id"), "line_id")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *columns)


def timeline(df: DataFrame, column: str, value: str, date: str = "date") -> DataFrame:
    return df.where(F.lower(column) == value.lower()).groupBy(date).agg(F.count(F.lit(1)).alias("count")).orderBy(date)


def validated(responses: DataFrame, kind: str, column: str = "response") -> tuple[DataFrame, DataFrame]:
    """Answers that fit their schema, parsed in ``parsed``, and the rest."""
    allowed = {"sentiment": ("positive", "negative", "neutral", "mixed"), "ocr_errors": ("low", "medium", "high"), "coherence": ("low", "medium", "high")}
    parsed = responses.withColumn("parsed", F.from_json(F.col(column), RESPONSES[kind], {"mode": "PERMISSIVE"}))
    fine = F.get_json_object(column, "$").isNotNull() & F.col("parsed").isNotNull()
    for name in (f.name for f in parsed.schema["parsed"].dataType.fields):
        value = F.col(f"parsed.{name}")
        if name in ("confidence", "intensity", "quality_score"):
            fine = fine & F.coalesce(value.between(0, 1), F.lit(name == "confidence"))
        elif name in allowed:
            fine = fine & F.coalesce(value.isin(*allowed[name]), F.lit(False))
        elif name in ("primary_topic", "main_theme", "summary"):
            fine = fine & value.isNotNull()
        elif name == "relationships":
            kinds = ("leads_to", "causes", "contradicts", "supports")
            fine = fine & F.coalesce(F.forall(value, lambda x: x["type"].isin(*kinds)), F.lit(True))
    judged = parsed.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    return judged.where("_fine").drop("_fine"), judged.where("not _fine").drop("_fine", "parsed")

