"""Language identification as inference of a mixture of languages.

Each language has a distribution over hashed byte trigrams of lower-cased words, learned from labelled rows.  A
document's words come each from one language of a mixture; expectation-maximisation over its words estimates the
proportions, until none of a document's moves by more than ``TOLERANCE``.  Sets of languages are compared by penalised
likelihood: the k languages of largest share are fitted again on their own for k = 1, 2, ..., as long as a larger set
can still win, and each language beyond the first has to gain ``PENALTY`` times half the logarithm of the number of
words.  The prediction is the language of largest share within the chosen set (of equal ones the first by name), and its
score is that share.

Learning takes a bounded sample: of each label about ``PER_LANGUAGE`` rows, chosen by a hash of their ids.  The model,
labels x 2^``BITS`` log-probabilities, is all that is sent to the tasks; more than ``LABELS`` labels are refused.

Defined cases: null, empty and letterless texts are ``und`` with score 0, as is everything where there is nothing to
learn from; rows without label or id are not learned from; a text of any length is read as a whole; repeated rows are
predicted alike, whatever they are in a batch with; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_rows, bounded_batches, mix64, tidy, word_bounds
from .segments import doc_groups

PER_LANGUAGE = 1000
BITS = 15
CELLS = 1 << 21  # words' bytes x languages handled at once
TOLERANCE = 1e-4
ROUNDS = 500  # of a document whose shares still move by more
PENALTY = 6.0
LABELS = 2000  # 0.5 GB of counts on the driver, half of that in the model

# letters: ASCII letters, lower-cased, and all bytes beyond ASCII; the rest separates words
LETTER = np.zeros(256, np.uint8)
LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[128:] = np.arange(128, 256)
NO_LETTER = LETTER == 0


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around each byte of the words (edges count as 0), and where each word's begin."""
    b = LETTER[data].astype(np.uint64)
    before, after = np.zeros_like(b), np.zeros_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    code = mix64((before << np.uint64(16)) | (b << np.uint64(8)) | after) >> np.uint64(64 - BITS)
    inside = ~NO_LETTER[data]
    lengths = ends - starts
    return code[inside].astype(np.int64), np.cumsum(lengths) - lengths


def counted(labels: list[str]) -> Callable:
    number = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), 1 << BITS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binary_rows(batch["bin"])
            label = [number[x] for x in batch["lang"].to_pylist()]
            for i in range(len(label)):
                sub = data[offsets[i] : offsets[i + 1]]
                starts, ends, _ = word_bounds(sub, np.array([0, len(sub)]), NO_LETTER)
                if len(starts):
                    total[label[i]] += np.bincount(grams(sub, starts, ends)[0], minlength=1 << BITS)
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where[0].astype(np.int32)), pa.array(where[1].astype(np.int32)), pa.array(total[where])], names=["label", "gram", "n"])

    return tidy(run)


def learn(docs: DataFrame, is_labelled: Column, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Labels and log-probabilities [2^BITS, labels]."""
    rows = docs.where(is_labelled & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per label
    labels = sorted(sizes)
    if not labels:
        return [], np.zeros((1 << BITS, 0), np.float32)
    if len(labels) > LABELS:
        raise ValueError(f"{len(labels)} labels; at most {LABELS} can be learned")
    share = F.create_map(*(F.lit(x) for label in labels for x in (label, min(1.0, per_language / sizes[label]))))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000
    sample = rows.where(chosen).select("lang", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bin"))
    counts = sample.mapInArrow(counted(labels), "label int, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((1 << BITS, len(labels)), 0.5)
    np.add.at(table, (counts["gram"].to_numpy(), counts["label"].to_numpy()), counts["n"].to_numpy())
    return labels, np.log(table / table.sum(0)).astype(np.float32)


def fit(like: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods (above the words' best languages) by EM from ``share``.

    All documents go through rounds together; each keeps the shares of the round in which it has settled.
    """
    out, live, now, words, sizes = share.copy(), np.arange(len(counts)), share, like, counts
    open_ = np.ones(len(counts), bool)
    for _ in range(ROUNDS):
        heads = np.cumsum(sizes) - sizes
        given = words * np.repeat(now, sizes, axis=0)
        given /= given.sum(1, keepdims=True) + 1e-30
        fresh = np.add.reduceat(given, heads, axis=0) / sizes[:, None]
        still = np.abs(fresh - now).max(1) > TOLERANCE
        out[live[open_]] = fresh[open_]
        open_ &= still
        now = fresh
        if not open_.any():
            break
        if open_.mean() < 0.7:  # go on with the others
            words, live, now, sizes = words[np.repeat(open_, sizes)], live[open_], now[open_], sizes[open_]
            open_ = np.ones(len(live), bool)
    heads = np.cumsum(counts) - counts
    return out, np.add.reduceat(np.log((like * np.repeat(out, counts, axis=0)).sum(1) + 1e-30).astype(np.float64), heads)


def mixtures(logs: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares [documents, languages] of the chosen sets and of all languages together, from the words' log-likelihoods."""
    n, languages = len(counts), logs.shape[1]
    best = logs.max(1)
    like = np.exp(logs - best[:, None])
    share, full = fit(like, counts, np.full((n, languages), 1 / languages, np.float32))
    alone = np.add.reduceat((logs - best[:, None]).astype(np.float64), heads, axis=0)
    one = alone.argmax(1)
    chosen = np.zeros((n, languages))
    chosen[np.arange(n), one] = 1
    value = alone[np.arange(n), one]
    cost = PENALTY / 2 * np.log(counts + 1)
    order = np.argsort(-share, axis=1, kind="stable")
    for k in range(2, languages + 1):
        todo = np.flatnonzero(full - (k - 1) * cost > value)  # no set gains more than all languages do
        if not len(todo):
            break
        mask = np.zeros((len(todo), languages), np.float32)
        np.put_along_axis(mask, order[todo, :k], 1, 1)
        c = counts[todo]
        rows = np.repeat(np.isin(np.arange(n), todo), counts)
        start = (share[todo] + 1e-3) * mask
        s, l = fit(like[rows], c, (start / start.sum(1, keepdims=True)).astype(np.float32))
        better = l - (k - 1) * cost[todo] > value[todo]
        chosen[todo[better]], value[todo[better]] = s[better], (l - (k - 1) * cost[todo])[better]
    return chosen, share


def predicted(labels: list[str], table: np.ndarray, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1 << 14, CELLS // max(1, len(labels)))
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binary_rows(batch["bin"])
            n = batch.num_rows
            pred, score = np.full(n, -1), np.zeros(n)
            sets: list[list[str]] = [[] for _ in range(n)]
            shares: list[list[float]] = [[] for _ in range(n)]
            for i, j in doc_groups(offsets, step) if labels else ():
                sub, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, before = word_bounds(sub, bounds, NO_LETTER)
                counts = np.diff(before)
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                code, heads = grams(sub, starts, ends)
                logs = np.concatenate([np.add.reduceat(table[code[heads[a] : heads[b] if b < len(heads) else None]], heads[a:b] - heads[a], axis=0) for a in range(0, len(heads), step) for b in (min(a + step, len(heads)),)])
                counts = counts[full]
                chosen, _ = mixtures(logs, np.cumsum(counts) - counts, counts)
                top = chosen.argmax(1)
                pred[i + full], score[i + full] = top, chosen[np.arange(len(top)), top]
                for row, x in zip((i + full).tolist(), chosen, strict=True):
                    order = np.argsort(-x, kind="stable")
                    order = order[x[order] > 0]
                    sets[row], shares[row] = [labels[o] for o in order], x[order].tolist()
            fine = np.asarray(batch["letters"]) & (pred >= 0)
            names = pa.array([labels[p] if f else "und" for p, f in zip(pred, fine, strict=True)], pa.string())
            empty: list = []
            out = [
                names, pa.array(np.clip(np.where(fine, score, 0.0), 0, 1)), pa.array([s if f else empty for s, f in zip(sets, fine, strict=True)], pa.list_(pa.string())),
                pa.array([s if f else empty for s, f in zip(shares, fine, strict=True)], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *out], names=[*keep, "lang_pred", "score", "languages", "shares"])

    return tidy(run)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])


def identified(docs: DataFrame, is_labelled: Column | None, keep: list[str]) -> DataFrame:
    """(doc, lang_pred, score, languages, shares); ``doc`` is a struct of the columns to keep, whatever their names."""
    bounded_batches(docs.sparkSession)
    labels, table = learn(docs, ~held_out() if is_labelled is None else is_labelled)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bin"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    schema = T.StructType([rows.schema["doc"], *FOUND.fields])
    return rows.mapInArrow(predicted(labels, table, ["doc"]), schema)


def identify(docs: DataFrame, is_labelled: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score (share of that language), and the chosen set: languages, shares.

    ``is_labelled`` selects the rows to learn from (default: those that aren't held out); the new columns take the place
    of kept ones of the same name.
    """
    fresh = ("lang_pred", "score", "languages", "shares")
    found = identified(docs, is_labelled, list(keep))
    return found.select(*(F.col("doc")[c].alias(c) for c in keep if c not in fresh), *fresh)


def keep_identified(docs: DataFrame, is_labelled: Column | None = None) -> DataFrame:
    """``docs`` without those in which no language is found; ``lang`` becomes the prediction.

    So null, empty and letterless texts go, and all of them where nothing can be learned; rows that are there twice both
    stay; an empty table gives an empty result.
    """
    found = identified(docs, is_labelled, docs.columns).where(F.col("lang_pred") != "und")
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col("doc")[c].alias(c) for c in docs.columns))
