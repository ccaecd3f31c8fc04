"""Cleaning steps by name, chained into one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: A step that needs a model or a service: a function of DataFrame, input and output column, registered by the user.
External = Callable[[DataFrame, str, str], DataFrame]

STEPS: dict[str, Callable[..., Column]] = {
    "normalize": T.normalize,
    "normalize-whitespace": T.normalize_whitespace,
    "lowercase": T.lowercase,
    "remove-diacritics": T.remove_diacritics,
    "remove-punctuation": T.remove_punctuation,
    "remove-numbers": T.remove_numbers,
    "remove-stopwords": T.remove_stopwords,
    "clean-ocr": T.clean_ocr,
    "dehyphenate": T.dehyphenate,
}
MODEL_STEPS = ("lemmatize-spacy", "lemmatize", "normalize-transnormer", "normalize-dtacab")


class Cleaner:
    """``Cleaner("text").run(df, ["normalize", "lowercase"])``.

    Steps are those of ``STEPS``, ``filter-length``, and the model-backed ones of ``MODEL_STEPS``, which take a
    per-batch function from ``register``; without one they raise.  ``options`` gives a step's keyword arguments.
    """

    def __init__(self, column: str = "text") -> None:
        self.column = column
        self.external: dict[str, Callable] = {}

    def register(self, step: str, function: Callable[[list[str]], list[str]]) -> Cleaner:
        """``function`` maps a list of texts to one of results; it runs in Arrow batches on distinct texts only."""
        if step not in MODEL_STEPS:
            raise ValueError(f"{step!r} takes no function")
        self.external[step] = function
        return self

    def run(self, df: DataFrame, steps: list[str], output: str = "text_processed", options: dict[str, dict] | None = None) -> DataFrame:
        known = {*STEPS, *MODEL_STEPS, "filter-length"}
        if unknown := [s for s in steps if s not in known]:
            raise ValueError(f"unknown step {unknown[0]!r}; there are: {', '.join(sorted(known))}")
        options = options or {}
        now = F.col(self.column)
        for step in steps:
            own = options.get(step, {})
            if step == "filter-length":
                df = df.where(T.within_length(now, **own))
            elif step in STEPS:
                now = STEPS[step](now, **own)
            else:
                if step not in self.external:
                    raise ValueError(f"step {step!r} needs a function: register() it first")
                df = by_distinct_text(df.withColumn(output, now), output, self.external[step])
                now = F.col(output)
        return df.withColumn(output, now)


#: What a service may fail with; anything else is an error of the function and stops the job.
FAILURES = (OSError, TimeoutError)


def by_distinct_text(df: DataFrame, column: str, function: Callable[[list[str]], list[str]], failures: tuple = FAILURES) -> DataFrame:
    """Replace ``column`` by ``function`` of it, computed once per distinct text; where a service fails the text stays."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch["_in"].to_pylist()
            try:
                out = function(texts)
            except failures:  # a failing service must not stop the job: the original text is the defined result
                out = texts
            yield pa.RecordBatch.from_arrays([batch["_in"], pa.array(out, pa.string())], names=["_in", "_out"])

    distinct = df.select(F.col(column).alias("_in")).where(F.col(column).isNotNull()).distinct()
    mapped = distinct.mapInArrow(run, "_in string, _out string")
    return df.join(mapped, df[column] == mapped["_in"], "left").withColumn(column, F.col("_out")).drop("_in", "_out")


def filter_by_length(df: DataFrame, column: str = "text", least: int = 10, most: int | None = None) -> DataFrame:
    return df.where(T.within_length(F.col(column), least, most))
