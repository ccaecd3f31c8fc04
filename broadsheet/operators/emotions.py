"""Emotion means: shares, years, months, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D


def mean_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith("mean_")]


def tolerant(raw: DataFrame) -> DataFrame:
    """Text columns of means as numbers; junk counts as 0."""
    return raw.select(*(D.tolerant_double(F.col(c)).alias(c) if c.startswith("mean_") else (F.col(c).try_cast("int").alias(c) if c == "year" else F.col(c)) for c in raw.columns))


def with_year(wide: DataFrame) -> DataFrame:
    year = D.year_in(F.col("id"))
    return wide.withColumn("year", F.coalesce(F.col("year").try_cast("int"), year) if "year" in wide.columns else year)


def shares(wide: DataFrame, digits: int = 9) -> DataFrame:
    """Mean per emotion and its share of the sum of all means, 0 where that is not positive."""
    sums = wide.agg(*(F.avg(c).alias(c) for c in mean_columns(wide)))
    long = sums.unpivot([], mean_columns(wide), "emotion", "mean").withColumn("emotion", F.expr("substring(emotion, 6)"))
    total = F.sum("mean").over(Window.partitionBy())  # one row per emotion
    return long.select("emotion", F.round("mean", digits).alias("mean"), F.round(F.when(total > 0, F.col("mean") / total).otherwise(0.0), digits).alias("share"))


def yearly(wide: DataFrame, digits: int = 9) -> DataFrame:
    """Means per year; missing values count as 0, rows without a year don't count."""
    rows = with_year(wide).where(F.col("year").isNotNull())
    return rows.groupBy("year").agg(*(F.round(F.avg(F.coalesce(c, F.lit(0.0))), digits).alias(c) for c in mean_columns(wide)))


def monthly(wide: DataFrame, digits: int = 9) -> DataFrame:
    rows = wide.select("*", D.year_in(F.col("id")).alias("_y"), D.month_in(F.col("id")).alias("_m")).where("_y is not null and _m is not null")
    return rows.groupBy(F.col("_y").alias("year"), F.col("_m").alias("month")).agg(*(F.round(F.avg(F.coalesce(c, F.lit(0.0))), digits).alias(c) for c in mean_columns(wide)))


def period_shares(wide: DataFrame, by: str = "month", digits: int = 9) -> DataFrame:
    """Each emotion's sum over a period's sum of all emotions, 0 where that is not positive."""
    if by not in ("month", "year"):
        raise ValueError(f"by must be month or year, not {by!r}")
    key = D.year_in(F.col("id")).cast("string") if by == "year" else F.regexp_extract("id", r"(\d{4}-\d{2})-\d{2}", 1)
    rows = wide.withColumn("period", key).where("period is not null and period <> ''")
    columns = mean_columns(wide)
    sums = rows.groupBy("period").agg(*(F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns))
    total: Column = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return sums.select("period", *(F.round(F.when(total > 0, F.col(c) / total).otherwise(0.0), digits).alias(c.replace("mean_", "share_")) for c in columns))


def by_date(rows: DataFrame, columns, digits: int = 9) -> DataFrame:
    return rows.groupBy("date").agg(*(F.round(F.avg(c), digits).alias(c) for c in columns))
