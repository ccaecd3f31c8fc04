"""Non-parametric statistics and outliers per group. A key (there may be few) is never sorted or held by one task."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
VARIANCE_FLOOR = 1e-12
PIECES = 512  # ranges that a key's values are cut into for ranks and quantiles
QUARTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}


def unpivoted(wide: DataFrame, prefix: str = "mean_", keep=("id", "year", "era1", "era2")) -> DataFrame:
    """A row per id and emotion: emotion, value."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    ids = [c for c in keep if c in wide.columns]
    return wide.unpivot(ids, columns, "emotion", "value").withColumn("emotion", F.expr(f"substring(emotion, {len(prefix) + 1})"))


def _joined(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Left join on columns that may be null (null equals null)."""
    named = right.select(*(F.col(c).alias(f"_of_{c}") if c in by else F.col(c) for c in right.columns))
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by), F.lit(True))
    return left.join(named, on, "left").drop(*(f"_of_{c}" for c in by))


def _pieces(df: DataFrame, rows: DataFrame, value: str, by) -> DataFrame:
    """``rows`` with _piece: which of at most PIECES + 1 ranges of its key's values in ``df`` a value lies in.

    The ranges are cut at the values of least hash in each of PIECES classes: a uniform sample of the different values,
    which combines before the shuffle, doesn't depend on the order of rows, and is an array of bounded length per key.
    """
    h = F.xxhash64(value)
    least = df.where(F.col(value).isNotNull()).groupBy(*by, F.pmod(h, F.lit(PIECES)).alias("_class")).agg(F.min_by(value, h).alias("_least"))
    cuts = least.groupBy(*by).agg(F.array_sort(F.collect_list("_least")).alias("_cuts"))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(PIECES.bit_length()))))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(value), at + step).otherwise(at))  # binary search
    return _joined(rows, cuts, by).withColumn("_piece", below).drop("_cuts")


def _before(pieces: DataFrame, by, running: dict[str, str]) -> DataFrame:
    """Per key and piece, from sums that run within a piece (``running``: sum -> name): what lies in the pieces before, and (<name>_all) in all.

    Reads the same shuffle as the running sums, so that both see the same rows.
    """
    totals = pieces.groupBy(*by, "_piece").agg(*(F.max(c).alias(n) for c, n in running.items()))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = (c for n in running.values() for c in (F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n), F.sum(n).over(Window.partitionBy(*by)).alias(f"{n}_all")))
    return totals.select(*by, "_piece", *sums)


def cumulated(df: DataFrame, value: str, by, counts: dict[str, Column]) -> DataFrame:
    """A row per key and different value: the ``counts`` (aggregates of rows, by name) and, as <name>_before and <name>_all, their sums over all smaller values and over all.

    Rows are counted per value first; the sums run over ranges of values (see _pieces), so that no task holds a key.
    """
    counted = _pieces(df, df.groupBy(*by, value).agg(*(c.alias(n) for n, c in counts.items())), value, by)
    inside = Window.partitionBy(*by, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counted.select("*", *(F.sum(n).over(inside).alias(f"_run_{n}") for n in counts))
    out = _joined(run, _before(run, by, {f"_run_{n}": f"_first_{n}" for n in counts}), [*by, "_piece"])
    return out.select(*by, value, *counts, *(F.col(f"_first_{n}_all").alias(f"{n}_all") for n in counts), *((F.coalesce(f"_first_{n}", F.lit(0)) + F.col(f"_run_{n}") - F.col(n)).alias(f"{n}_before") for n in counts))


def average_rank(df: DataFrame, value: str = "value", by=("emotion",), out: str = "avg_rank") -> DataFrame:
    """Ranks from 1 (nulls first); ties get the mean of their ranks. Equal values meet in one task, a key's don't."""
    rows = _pieces(df, df, value, by)
    order = Window.partitionBy(*by, "_piece").orderBy(value)
    run = rows.select("*", F.rank().over(order).alias("_rank"), F.count(F.lit(1)).over(order).alias("_upto"))
    ranked = _joined(run, _before(run, by, {"_upto": "_first"}), [*by, "_piece"])
    mean = F.coalesce("_first", F.lit(0)) + (F.col("_rank") + F.col("_upto")) / 2
    return ranked.withColumn(out, mean).drop("_piece", "_rank", "_upto", "_first", "_first_all")


def mann_whitney_pairs(df: DataFrame, group: str, pairs, value: str = "value", by=("emotion",), with_p: bool = True) -> DataFrame:
    """A row per key and pair of groups (first, second; pair: its place in ``pairs``) with values in either of them.

    n1, n2, u1, z, p (two-sided, with tie and continuity correction) and Cliff's delta. Where one side is empty: u1 and
    delta 0, p 1. All pairs come from one table of counts per value.
    """
    at = {g: f"_n{i}" for i, g in enumerate(dict.fromkeys(g for pair in pairs for g in pair))}
    rows = df.where(F.col(group).isin(*at) & F.col(value).isNotNull())
    counted = cumulated(rows, value, by, {n: F.count(F.when(F.col(group) == g, 1)) for g, n in at.items()})

    def sums(i: int, first: str, second: str) -> Column:
        one, two = F.col(at[first]), F.col(at[second])
        tied = (one + two).cast("double")
        rank = F.col(f"{at[first]}_before") + F.col(f"{at[second]}_before") + (tied + 1) / 2
        return F.struct(
            F.lit(i).alias("pair"), F.lit(first).alias("first"), F.lit(second).alias("second"), F.sum(one).alias("n1"), F.sum(two).alias("n2"),
            F.sum(one * rank).alias("r1"), F.sum(tied * tied * tied - tied).alias("ties"),
        )

    found = counted.groupBy(*by).agg(F.array(*(sums(i, a, b) for i, (a, b) in enumerate(pairs))).alias("_pairs"))
    out = found.select(*by, F.inline("_pairs")).where("n1 + n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    variance = F.greatest(n1 * n2 / 12 * (n + 1 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))), F.lit(VARIANCE_FLOOR))
    shift = u1 - n1 * n2 / 2
    z = F.greatest(F.abs(shift) - 0.5, F.lit(0.0)) / F.sqrt(variance)
    out = out.select(
        *by, "pair", "first", "second", "n1", "n2", F.when(empty, 0.0).otherwise(u1).alias("u1"), F.when(empty, 0.0).otherwise(z).alias("z"),
        F.when(empty, 0.0).otherwise(2 * u1 / (n1 * n2) - 1).alias("cliffs_delta"),
    )
    return out.withColumn("p", F.when((F.col("n1") == 0) | (F.col("n2") == 0), 1.0).otherwise(2 * upper_tail(F.col("z")))) if with_p else out


def mann_whitney(df: DataFrame, group: str, first: str, second: str, value: str = "value", by=("emotion",), with_p: bool = True) -> DataFrame:
    """``mann_whitney_pairs`` of one pair."""
    return mann_whitney_pairs(df, group, [(first, second)], value, by, with_p).drop("pair", "first", "second")


def upper_tail(z: Column) -> Column:
    """Probability of a standard normal value beyond z >= 0, by the continued fraction or the series of erf (no UDF).

    The two expansions agree to about 1e-12 where they meet.
    """

    def tail(x):
        # struct of the n-th term and the sum so far, from n = 0
        kind = "struct<t:double,s:double>"

        def step(a, n):
            t = a["t"] * (-(x * x)) / n
            return F.struct(t.alias("t"), (a["s"] + t / (2 * n + 1)).alias("s")).cast(kind)

        start = F.struct(x.alias("t"), x.alias("s")).cast(kind)
        series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda a: 0.5 - a["s"] / math.sqrt(math.pi))
        fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, k: x + (k / 2) / a)
        return F.when(x < 2.5, series).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * fraction) / 2)

    return F.element_at(F.transform(F.array(z.cast("double") / math.sqrt(2)), tail), 1)


def best_pair(df: DataFrame, pairs, group: str = "era1", value: str = "value", by=("emotion",)) -> DataFrame:
    """The pair of groups of least p below 1; null names where there is none."""
    order = Window.partitionBy(*by).orderBy("p", "pair")
    ranked = mann_whitney_pairs(df, group, pairs, value, by).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    some = F.col("p") < 1
    return ranked.select(*by, *(F.when(some, F.col(c)).alias(c) for c in ("first", "second")), "u1", "p", "cliffs_delta", nlog10(F.col("p")).alias("nlog10_p"))


def nlog10(p: Column) -> Column:
    return -F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)))


def order_statistics(df: DataFrame, levels: dict[str, float], value: str = "value", by=("emotion",)) -> DataFrame:
    """Exact quantiles per key, interpolated between neighbours, by name; keys without values are left out."""
    rows = cumulated(df.where(F.col(value).isNotNull()), value, by, {"_n": F.count(F.lit(1))})

    def held(place: Column) -> Column:
        return F.max(F.when((F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n")), F.col(value))).cast("double")

    place = {name: (F.col("_n_all") - 1) * F.lit(level) for name, level in levels.items()}
    found = rows.groupBy(*by).agg(*(c for n, p in place.items() for c in (F.max(p).alias(f"_{n}_at"), held(F.floor(p)).alias(f"_{n}_low"), held(F.ceil(p)).alias(f"_{n}_high"))))

    def between(n: str) -> Column:
        at, low, high = F.col(f"_{n}_at"), F.col(f"_{n}_low"), F.col(f"_{n}_high")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*by, *(between(n).alias(n) for n in levels))


def outlier_scores(long: DataFrame, by=("emotion",), value: str = "value") -> DataFrame:
    """z_mad and iqr_outlier per value; exact percentiles, interpolated. Rows of a null key are left out."""
    rows = long.join(order_statistics(long, QUARTILES, value, by), list(by))
    deviations = rows.select(*by, F.abs(F.col(value) - F.col("med")).alias("_deviation"))
    mad = order_statistics(deviations, {"mad_n": 0.5}, "_deviation", by).withColumn("mad_n", F.col("mad_n") * MAD_SCALE)
    rows = rows.join(mad, list(by))
    z = F.when(F.col("mad_n") == 0, 0.0).otherwise((F.col(value) - F.col("med")) / F.col("mad_n"))
    spread = F.col("q3") - F.col("q1")
    outside = (F.col(value) < F.col("q1") - 1.5 * spread) | (F.col(value) > F.col("q3") + 1.5 * spread)
    return rows.withColumn("z_mad", z).withColumn("iqr_outlier", outside.cast("int"))


def top_outliers(long: DataFrame, top: int = 10, by=("emotion",), value: str = "value") -> DataFrame:
    """The ``top`` values per key by absolute z, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs("z_mad")), "id")
    return outlier_scores(long, by, value).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def outlier_report(wide: DataFrame, top: int = 10, snippet: int = 80) -> DataFrame:
    """emotion, rank, id, date, year, era1, era2, value, z_mad, iqr_outlier, text_snippet; numbers formatted as text."""
    long = unpivoted(wide, keep=("id", "year", "era1", "era2", "text"))
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in long.columns else F.lit("")
    rows = top_outliers(long, top)
    return rows.select(
        "emotion", "rank", "id", F.regexp_extract("id", r"(\d{4}-\d{2}-\d{2})", 1).alias("date"), "year", "era1", "era2", F.format_string("%.6f", "value").alias("value"),
        F.format_string("%.3f", "z_mad").alias("z_mad"), "iqr_outlier", F.when(F.length(text) > snippet, F.concat(F.substring(text, 1, snippet), F.lit("…"))).otherwise(text).alias("text_snippet"),
    )


def highlighted(scores: DataFrame, least: float = 3.0) -> DataFrame:
    return scores.withColumn("highlight", (F.abs("z_mad") >= least) | (F.col("iqr_outlier") == 1))


def peaks(report: DataFrame, emotion: str, n: int = 10) -> DataFrame:
    """The first peaks of one emotion of an outlier table, with the absolute score."""
    return report.where(F.col("emotion") == emotion).withColumn("abs_z", F.abs(F.col("z_mad").cast("double"))).orderBy("rank").limit(n)


def quantiles(long: DataFrame, by=("emotion", "era1"), value: str = "value", digits: int = 9) -> DataFrame:
    """Quartiles, bounds and count of each box of a box plot."""
    rows = long.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    rows = _joined(rows, order_statistics(long, QUARTILES, value, by), by)
    named = (("q1", "q1"), ("med", "median"), ("q3", "q3"), ("low", "low"), ("high", "high"))
    return rows.select(*by, *(F.round(c, digits).alias(n) for c, n in named), "n")


def summary(long: DataFrame, by=("era1", "emotion"), value: str = "value", digits: int = 9) -> DataFrame:
    rows = long.groupBy(*by)
    return rows.agg(*(F.round(f(value), digits).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))
