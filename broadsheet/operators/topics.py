"""Topics and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def exploded(rows: DataFrame, column: str = "topics", keep_blank: bool = False) -> DataFrame:
    """A row per topic of a list joined by bars."""
    out = rows.withColumn("topic", F.explode(F.split(column, r"\|"))).withColumn("topic", T.collapse_ends(F.col("topic")))
    return out if keep_blank else out.where("topic <> ''")


def topic_counts(rows: DataFrame, by=("date",), column: str = "topics", keep_blank: bool = False) -> DataFrame:
    return exploded(rows, column, keep_blank).groupBy(*by, "topic").agg(F.count(F.lit(1)).alias("count"))


def topic_totals(rows: DataFrame, min_mentions: int = 1, top: int | None = None, column: str = "topics") -> DataFrame:
    """Total per topic with its place in the order of totals."""
    totals = exploded(rows, column).groupBy("topic").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_mentions).orderBy(F.desc("total"), "topic")
    return totals if top is None else totals.limit(top)


def topic_order(totals: DataFrame) -> DataFrame:
    """Dense places from 0 by total; totals hold a row per topic."""
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "topic")) - 1)


def topic_timeline(rows: DataFrame, top: int = 10, by=("date",), column: str = "topics") -> DataFrame:
    """Counts per period of the most frequent topics."""
    return topic_counts(rows, by, column).join(topic_totals(rows, top=top, column=column).select("topic"), "topic", "left_semi")


def keywords(df: DataFrame, key: str, column: str = "text", k: int = 12) -> DataFrame:
    """The k most frequent words of each text that are no stop words; ties by first appearance."""
    words = df.select(key, F.posexplode(T.keyword_tokens(F.col(column))).alias("pos", "word"))
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "word", "n")


def ngram_keywords(df: DataFrame, key: str, column: str = "text", k: int = 5, least: int = 1) -> DataFrame:
    """The k most frequent words and pairs of words of each text; ties in alphabetical order."""

    def both(w):
        pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: i < F.size(w)), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        return F.when(F.size(w) > 0, F.concat(w, pairs))

    terms = df.select(key, F.explode(T.let(T.keyword_tokens(F.col(column)), both)).alias("term"))
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "term", "n")


def padded(own, others, n: int = 5):
    """The first n of one list, filled up from another without repeats."""
    return F.slice(F.array_distinct(F.concat(own, others)), 1, n)


def topic_model(df: DataFrame, column: str = "text", topics: int = 5, vocabulary: int = 5000, seed: int = 7, iterations: int = 10):
    """Latent Dirichlet allocation over words and pairs: the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover

    parts = [
        RegexTokenizer(inputCol=column, outputCol="_tokens", pattern=r"[A-Za-zÄÖÜäöüß\-]{3,}", gaps=False),
        StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=T.KEYWORD_STOPS),
        CountVectorizer(inputCol="_words", outputCol="features", vocabSize=vocabulary),
        LDA(k=topics, seed=seed, maxIter=iterations, optimizer="online"),
    ]
    return Pipeline(stages=parts).fit(df)


def model_topics(model, k: int = 2) -> DataFrame:
    """topic, label: the words of most weight in each topic of a fitted model."""
    words = model.stages[2].vocabulary
    found = model.stages[3].describeTopics(k)
    table = F.array(*(F.lit(w) for w in words))
    return found.select("topic", T.topic_label(F.transform("termIndices", lambda i: F.get(table, i)), k).alias("label"))
