"""Query façade over Spark SQL: named tables, bound parameters, canned queries.  Results are lazy DataFrames."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as E
from ..sources import tables
from ..sources.registry import Registry


_ANALYSIS = threading.RLock()


class QueryEngine:
    """Tables ``source_lines`` and ``lines`` of a source, ``entities`` and ``entities_<method>``, ``topics``.

    Tables are given as DataFrames, or found by name through a registry.  They belong to the engine: their names are
    views only while ``query`` has a statement analysed, so engines of one session don't see each other's.  ``database``
    makes results of ``save`` catalog tables of that name space; without it they are tables of the engine.
    """

    def __init__(self, spark: SparkSession, source: str | None = None, lines: DataFrame | None = None, entities: dict[str, DataFrame] | None = None, topics: DataFrame | None = None, registry: Registry | None = None, database: str | None = None) -> None:
        self.spark, self.source, self.database = spark, source, database
        self.registry = registry or Registry()
        self.methods: dict[str, DataFrame] = {}
        self.tables: dict[str, DataFrame] = {}
        if database:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        if lines is None and source is not None:
            lines = tables.existing(spark, self.registry.paths(source)["lines"])
        if lines is not None:
            self._name(lines, "source_lines", "lines")
        for name, df in (entities or {}).items():
            self.add_entities(name, df)
        self.topics = topics
        if topics is not None:
            self._name(topics, "topics")

    def _name(self, df: DataFrame, *names: str) -> None:
        self.tables |= dict.fromkeys(names, df)

    def add_entities(self, method: str, df: DataFrame) -> None:
        """Register a method's entities; the first one is also ``entities``."""
        if "confidence" not in df.columns:
            df = df.withColumn("confidence", F.lit(None).cast("double"))
        self._name(df, f"entities_{method}", *([] if self.methods else ["entities"]))
        self.methods[method] = df

    def add_table(self, name: str, path: str) -> None:
        self._name(self.spark.read.parquet(path), name)

    @property
    def lines(self) -> DataFrame:
        if "source_lines" not in self.tables:
            raise ValueError("no lines are registered")
        return self.tables["source_lines"]

    def entities(self, method: str | None = None) -> DataFrame:
        if method is None:
            if not self.methods:
                raise ValueError("no entities are registered")
            return next(iter(self.methods.values()))
        if method not in self.methods:
            raise ValueError(f"unknown method {method!r}; there are: {', '.join(self.methods) or 'none'}")
        return self.methods[method]

    def query(self, sql: str, params: list | None = None) -> DataFrame:
        """The statement over this engine's tables; views of the session by the same names are hidden and come back."""
        with _ANALYSIS:
            hidden = {v.name: self.spark.table(v.name) for v in self.spark.catalog.listTables() if v.isTemporary and v.name in self.tables}
            try:
                for name, df in self.tables.items():
                    df.createOrReplaceTempView(name)
                return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)
            finally:
                for name in self.tables:
                    if name in hidden:
                        hidden[name].createOrReplaceTempView(name)
                    else:
                        self.spark.catalog.dropTempView(name)

    def get_line(self, line_id: str) -> dict | None:
        row = self.lines.where(F.col("line_id") == line_id).first()
        return row.asDict() if row else None

    def search_text(self, query: str, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
        """Lines that contain the query in any case; % and _ in it are wildcards."""
        rows = E.between(self.lines.where(F.col("text").ilike(f"%{query}%")), start, end)
        return rows.orderBy("date", "line_id").limit(limit)

    def find_entity_mentions(self, name: str, entity_type: str | None = None, start: str | None = None, end: str | None = None, method: str | None = None) -> DataFrame:
        return E.mentions(self.entities(method), self.lines, name, entity_type, start, end)

    def compare_entity_methods(self, first: str, second: str, entity_type: str | None = None) -> DataFrame:
        return E.compare_methods(self.entities(first), self.entities(second), self.lines, entity_type)

    def entity_frequency(self, group_by: str = "year", min_mentions: int = 5, entity_type: str | None = None, method: str | None = None) -> DataFrame:
        return E.entity_frequency(self.entities(method), self.lines, group_by, min_mentions, entity_type)

    def topic_distribution(self, group_by: str = "year") -> DataFrame:
        if self.topics is None:
            raise ValueError("no topics are registered")
        return E.topic_distribution(self.topics, self.lines, group_by)

    def compare(self, first: str, second: str) -> dict[str, DataFrame]:
        """Coverage, statistics, types and agreement of two methods side by side."""
        a, b = self.entities(first), self.entities(second)
        both = {first: a, second: b}
        return {
            "coverage": E.coverage(a, b, self.lines), "statistics": E.method_statistics(both), "types": E.type_distribution(both), "agreement": E.agreement(a, b),
            "first_only": E.only_in(a, b), "second_only": E.only_in(b, a),
        }

    def loading_status(self) -> DataFrame:
        return loading_status(self.lines)

    def save(self, df: DataFrame, name: str) -> None:
        if self.database:
            df.write.mode("overwrite").saveAsTable(f"`{self.database}`.`{name}`")
        else:
            self._name(df, name)

    def close(self) -> None:
        self.tables.clear()
        self.methods.clear()

    def __enter__(self) -> QueryEngine:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def loading_status(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("total_lines"), F.countDistinct("filename").alias("unique_files"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def file_coverage(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Files with lines, files there are, percent."""
    a = lines.agg(F.countDistinct("filename").alias("loaded"))
    b = files.agg(F.countDistinct("filename").alias("files"))
    both = a.select(F.lit(1).alias("_k"), "loaded").join(b.select(F.lit(1).alias("_k"), "files"), "_k").drop("_k")  # one row each
    return both.withColumn("percent", F.coalesce(F.try_divide(F.col("loaded") * 100.0, "files"), F.lit(0.0)))
