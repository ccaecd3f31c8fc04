"""Annotation by a language model: prompts, a client with retries, and answers as columns.

The transport is injected, so that any service can stand behind it and tests need none: a function of the request's
payload that returns the answer's text and raises ``Refused`` with a status, or an OSError.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from . import entities, topics

AGAIN = (429, 500, 502, 503, 504)


class Refused(Exception):
    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(message or f"status {status}")
        self.status = status


@dataclass(frozen=True)
class Client:
    """Chat requests with ``retries`` attempts; waits delay, 2 delay, 4 delay ... between them."""

    transport: Callable[[dict], str]
    model: str = "default"
    temperature: float = 0.0
    max_tokens: int = 1000
    retries: int = 3
    delay: float = 1.0
    sleep: Callable[[float], None] = time.sleep

    def complete(self, prompt: str, system: str | None = None, as_json: bool = False, **more) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        payload = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens} | more
        if as_json:
            payload["response_format"] = {"type": "json_object"}
        for attempt in range(self.retries):
            try:
                return self.transport(payload)
            except Refused as e:
                if e.status not in AGAIN or attempt + 1 == self.retries:
                    raise
            except OSError:
                if attempt + 1 == self.retries:
                    raise
            self.sleep(self.delay * 2**attempt)
        raise ValueError("retries must be at least 1")


@dataclass(frozen=True)
class Prompt:
    """System text and template; {names} are columns, ``kind`` names the answer's schema in ``schemas.RESPONSES``."""

    kind: str
    system: str
    template: str

    def column(self, **columns: Column) -> Column:
        return T.prompt(self.template, **columns)


ANSWER = " Answer with one JSON object and nothing else."
PROMPTS = {
    "entities": Prompt("entities", "You find named entities in historical newspapers." + ANSWER, "Source: {source}\nDate: {date}\n\nText:\n{text}\n\nList what is named, as keys persons, locations and organizations, each a list of strings."),
    "topic": Prompt("topic", "You sort newspaper texts by topic." + ANSWER, "Topics to choose from: {topics}\n\nText:\n{text}\n\nGive primary_topic, secondary_topics and confidence between 0 and 1."),
    "topics": Prompt("topics", "You name the topics of newspaper texts." + ANSWER, "Text:\n{text}\n\nGive topics, short phrases, and main_theme."),
    "emotion": Prompt("emotion", "You judge the emotional tone of newspaper texts." + ANSWER, "Text:\n{text}\n\nGive sentiment (positive, negative, neutral or mixed), emotions, intensity between 0 and 1, and tone."),
    "concepts": Prompt("concepts", "You find concepts and how they are connected." + ANSWER, "Text:\n{text}\n\nGive concepts and relationships, each with source, target and type (leads_to, causes, contradicts or supports)."),
    "summary": Prompt("summary", "You summarise newspaper texts." + ANSWER, "Text:\n{text}\n\nGive summary, key_points and historical_context."),
    "quality": Prompt("quality", "You judge how well a text was recognised." + ANSWER, "Text:\n{text}\n\nGive quality_score between 0 and 1, ocr_errors and coherence (low, medium or high), issues, and readable."),
}


def answers(df: DataFrame, prompt: Column, client: Callable[[], Client], system: str | None = None, out: str = "response", pause: float = 0.0, partitions: int | None = None) -> DataFrame:
    """``df`` with the model's answers to ``prompt``; null where the client gave up.

    ``client()`` is called once per task; ``partitions`` bounds how many ask at the same time.
    """
    rows = df.withColumn("_prompt", prompt)
    rows = rows.repartition(partitions) if partitions else rows
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        for batch in batches:
            got = []
            for p in batch["_prompt"].to_pylist():
                try:
                    got.append(own.complete(p, system, True) if p is not None else None)
                except (Refused, OSError):
                    got.append(None)
                if pause:
                    own.sleep(pause)
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(got, pa.string())], names=[*names, out])

    return rows.mapInArrow(run, K.StructType([*df.schema.fields, K.StructField(out, K.StringType())]))


def ask(df: DataFrame, name: str, client: Callable[[], Client], most: int | None = None, **columns: Column) -> tuple[DataFrame, DataFrame]:
    """Parsed answers (column ``parsed``) to one of ``PROMPTS``, and the rows whose answers don't fit the schema."""
    import re

    prompt = PROMPTS[name]
    given = {"text": F.col("text")} | columns
    filled = {n: given.get(n, F.lit("")) for n in re.findall(r"\{(\w+)\}", prompt.template)}
    if most is not None:
        filled["text"] = T.truncate(filled["text"], most)
    return entities.validated(answers(df, prompt.column(**filled), client, prompt.system), prompt.kind)


def extract_entities(lines: DataFrame, client: Callable[[], Client], least: int = 50, source: str = "") -> DataFrame:
    """Entities of lines with at least ``least`` characters besides blanks at the ends, by a language model."""
    long = lines.where(T.within_length(T.collapse_ends(F.col("text")), least))
    date = F.col("date").cast("string") if "date" in lines.columns else F.lit("")
    asked = long.select("line_id", PROMPTS["entities"].column(text=F.col("text"), source=F.lit(source), date=date).alias("prompt"))
    return entities.response_entities(answers(asked, F.col("prompt"), client, PROMPTS["entities"].system))


def extract_topics(texts: DataFrame, client: Callable[[], Client], most: int = 8000) -> DataFrame:
    """``texts`` with ``topics`` from the model's answer of one per line."""
    prompt = T.prompt("Name the main topics of this issue, one per line, in two to eight words each.\n\n{text}", text=T.truncate(F.col("text"), most))
    asked = answers(texts, prompt, client, "You name the topics of newspaper issues.")
    return asked.withColumn("topics", F.array_join(T.topic_lines(F.coalesce("response", F.lit(""))), "|"))


def issue_topics(docs: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Topics and subtopics of each issue without a model: the most frequent pairs, and words filled up by further terms."""
    terms = topics.ngram_keywords(docs, key, k=4 * k)
    listed = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("x")).select(key, F.transform("x", lambda x: x["term"]).alias("t"))  # 4 k terms per issue
    pairs = F.filter("t", lambda t: F.contains(t, F.lit(" ")))
    single = F.filter("t", lambda t: ~F.contains(t, F.lit(" ")))
    return listed.select(key, F.array_join(topics.padded(pairs, F.col("t"), k), "|").alias("topics"), F.array_join(topics.padded(single, F.col("t"), k), "|").alias("subtopics"), F.lit("keywords").alias("method"))


def nested(entities_: DataFrame) -> DataFrame:
    """The older layout of entities: id and a struct of text, label and score."""
    return entities_.select(F.col("line_id").alias("id"), F.struct(F.col("entity_text").alias("text"), F.col("entity_type").alias("label"), F.col("confidence").alias("score")).alias("entity"))
