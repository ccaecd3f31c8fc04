"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al. 2014).

Before each round tasks replace ``AT_ONCE`` edges at a time by a star for each component among them, which changes no
component and leaves few rounds; there are as many tasks as that many edges need.  Each step is a grouped minimum, joined back to the edges; nothing is collected, and
neighbours of a node are never brought together in one row.  The edges are written to the shared folder after each round,
until every node has one root only and no root has one: each step lowers the sum of all edges' ends or is at that end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stored, tidy

AT_ONCE = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the least of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches_of(batches, AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(t["a"].to_numpy(), t["b"].to_numpy())], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v.  Large: to all larger neighbours the least of the closed neighbourhood; small: to the smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
    out = out.where("u <> v")
    return out if large else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots; root: the component's least node."""
    now = edges.select("a", "b").where("a <> b")
    while True:
        tasks = 1 + now.count() // AT_ONCE
        now = stored(now.coalesce(tasks).mapInArrow(tidy(contracted), "u long, v long"), "edges")
        ends = now.select(F.col("u").alias("x"), "v").unionByName(now.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v")))
        # rows of x as the smaller end have no v
        open_ = ends.groupBy("x").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.col("v").isNull()).alias("root")).where("least < most or (root and least is not null)")
        if open_.isEmpty():
            return now.distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = stored(_star(_star(now, True), False), "edges").select(F.col("u").alias("a"), F.col("v").alias("b"))
