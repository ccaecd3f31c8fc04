"""Exact top-k inner products, pruned with segment statistics at several resolutions.

A vector of d components is cut into s segments of n components each; with the segments' means m and deviations t,
q.x <= sum over segments of n (m_q m_x + t_q t_x), by Cauchy and Schwarz; in terms of squared distance,
|q|^2 + |x|^2 - 2 q.x, this bounds it from below.  Every bound is itself an inner product of 2 s numbers.  Bounds go
from coarse to fine; pairs whose bound falls below what the query's k-th best is known to reach are dropped, and the
survivors' scores are computed exactly, in integers.

Queries come in blocks of at most ``BLOCK`` rows, which are sent to all tasks; each task holds one batch of candidates
and its own k best per query.  A first threshold per query comes from ``SAMPLE`` candidates; any subset gives a valid one.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as filled
up with zeros; rows with the query's id are no candidates; null ids take no part; a repeated query id is one query (its
least vector), a repeated candidate row counts as often as it stands there; a score that 64 bits can't hold raises; empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, tidy

BLOCK = 4096
SAMPLE = 2048
BATCH = 2048
AT_ONCE = 16  # blocks of queries in one plan; beyond, results are written group by group
FEW = 0.02  # share of pairs below which survivors are listed
USEFUL = 0.8  # share of pairs that a level may leave to be worth its cost
LEVELS = (2, 8, 16)
FOUND = "query_id long, vec_id long, score long"


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(64 x) of each component, rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.diff(column.offsets.to_numpy())
    flat = np.floor(64.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = max(int(counts.max(initial=0)), width or 0)
    if len(counts) and (counts == width).all():
        return flat.reshape(len(counts), width)
    out = np.zeros((len(counts), width))
    out[np.repeat(np.arange(len(counts)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    out = []
    for part in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1):
        root = np.sqrt(part.shape[1])
        out += [part.mean(1) * root, part.std(1) * root]
    return np.stack(out, 1) if x.shape[1] else np.zeros((len(x), 2))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``q`` and ``x``, in the narrowest floats that hold them exactly, else in Python's integers."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if size < 2**53:
        kind = np.float32 if size < 2**24 else np.float64
        return q.astype(kind) @ x.astype(kind).T
    rows = [[int(v) for v in r] for r in x]
    return np.array([[sum(a * b for a, b in zip(u, v, strict=True)) for v in rows] for u in ([int(v) for v in r] for r in q)], object)


def paired(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of ``q`` and j of ``x``."""
    return np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    head = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(head, np.arange(len(query)), 0)) if len(query) else np.zeros(0, int)
    keep = rank < k
    return query[keep], ids[keep], score[keep], rank[keep]


def search(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Callable:
    """For mapInArrow over (vec_id, embedding): the task's k best of each query, as far as they reach its ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = floor.astype(np.float64).copy()
        useful = dict.fromkeys(LEVELS, True)
        of_q: dict = {}
        held = [np.zeros(0, np.int64)] * 3
        for batch in (b.slice(a, BATCH) for b in batches for a in range(0, b.num_rows, BATCH)):
            own = batch["vec_id"].to_numpy()
            x = matrix(batch["embedding"], q.shape[1])
            if x.shape[1] not in of_q:
                queries = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
                of_q = {x.shape[1]: (queries, {s: statistics(queries, s).astype(np.float32) for s in LEVELS})}
            queries, stats = of_q[x.shape[1]]
            # float32 rounds a sum of 2 s products by less than this share of |q| |x|
            slack = 1e-5 * (1 + np.sqrt((queries**2).sum(1)) * np.sqrt((x**2).sum(1).max(initial=0)))
            least = (known - slack).astype(np.float32)
            pairs, among = None, len(ids) * len(own)
            for s in LEVELS:
                if not useful[s]:
                    continue
                of_x = statistics(x, s).astype(np.float32)
                if pairs is None:
                    possible = stats[s] @ of_x.T >= least[:, None]
                    left = int(np.count_nonzero(possible))
                    if left < FEW * possible.size:
                        pairs = np.nonzero(possible)
                else:
                    i, j = pairs
                    keep = paired(stats[s], of_x, i, j) >= least[i]
                    pairs, left = (i[keep], j[keep]), int(keep.sum())
                useful[s] = left < USEFUL * among  # a level that drops little here is left out in what follows
                among = max(1, left)
            if pairs is None:
                score = exact(queries, x)
                i, j = np.nonzero(score >= known[:, None])
                score = score[i, j]
            else:
                i, j = pairs
                whole = np.unique(i)  # exact() of the queries that have survivors, then of these pairs
                if float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53:
                    score = paired(queries, x, i, j)
                else:
                    score = exact(queries[whole], x)[np.searchsorted(whole, i), j]
                fine = score >= known[i]
                i, j, score = i[fine], j[fine], score[fine]
            other = ids[i] != own[j]
            i, j = i[other], j[other]
            score = np.array(list(score[other]), np.int64) if score.dtype == object else score[other].astype(np.int64)  # OverflowError beyond 64 bits
            i, c, score, rank = best(*(np.concatenate(p) for p in zip(held, (i, own[j], score), strict=True)), k)
            held = [i, c, score]
            last = rank == k - 1
            known[i[last]] = np.maximum(known[i[last]], score[last])
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

    return tidy(run)


def usable(df: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id."""
    from pyspark.sql import Window

    spark = vectors.sparkSession
    rows = usable(vectors)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = -(-queries.count() // BLOCK)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample_ids, sample_x = sample["vec_id"].to_numpy(), matrix(sample["embedding"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def searched(b: int) -> DataFrame:
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about BLOCK rows
        ids, q = block["vec_id"].to_numpy(), matrix(block["embedding"], sample_x.shape[1])
        x = np.pad(sample_x, ((0, 0), (0, q.shape[1] - sample_x.shape[1])))
        score = q @ x.T - 1e-6 * np.abs(q) @ np.abs(x.T)  # no more than the true score, whatever the rounding
        score[ids[:, None] == sample_ids[None, :]] = -np.inf
        floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(ids), -np.inf)
        return rows.mapInArrow(search(ids, q, np.floor(floor), k), FOUND)

    path = scratch_path(spark, "topk")
    out = None
    for first in range(0, blocks, AT_ONCE):  # a block's queries have seen all rows, so each group of blocks is complete
        found = reduce(DataFrame.unionByName, [searched(b) for b in range(first, min(first + AT_ONCE, blocks))])
        out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > AT_ONCE:
            out.write.mode("append").parquet(path)
    return out if blocks <= AT_ONCE else spark.read.schema(out.schema).parquet(path)
