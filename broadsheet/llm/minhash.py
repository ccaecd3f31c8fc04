"""Near-duplicates by BagMinHash signatures of five-word shingles, banded and verified as multisets.

A text is the bag of its shingles: runs of ``SHINGLE`` words (lower-cased, split at white space), with counts; a text of
fewer words is one shingle.  The signature's components are minima of Poisson processes over (weight, time): each
shingle has processes over the dyadic weight intervals [0,1), [1,2), [2,4), ..., of rate components x length, whose
points go to a random component and a random unit of weight; a bag meets the points below the shingle's count, so two
bags share a component's minimum with the probability of their weighted Jaccard similarity.  Only points that come
before a time which all components reach with near certainty are drawn; documents that then lack one go on.

Bags that are equal become one node.  Nodes that share a band are candidates:

1. each node of a bucket against the bucket's least node, so that a group costs as many comparisons as it has nodes;
2. after connected components, the nodes of a bucket that are in different components, so that no link that bands find
   between different components is lost; links within a component change nothing.  Large buckets are compared block by
   block without listing pairs.

Candidates are verified by the exact weighted Jaccard similarity of their bags.  Classes are the connected components.

Defined cases: null and empty texts, and those of white space, have no shingles and are classes of their own (by id);
copies, ties and repeated rows share a class; a text of any length is one bag of all its shingles; rows of one id count
as one document; a row without id has a null class; other columns are ignored or, in ``keep_first``, kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEVEL_ODD, binary_rows, bounded_batches, mix64, stored, tidy, times, word_bounds, word_hashes
from .components import components
from .segments import doc_groups

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares no band with probability 3e-6
SMALL = 16  # nodes of a bucket up to which pairs are listed one by one
BLOCK = 256  # nodes of larger buckets that are compared with as many others at once
GROUP = 512  # comparisons with one node, of each of its bands, that a task makes in a row
CHUNK = 1 << 19
ROUNDING = 1e-9

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the number of each document's."""
    lowered = LOWER[data]
    starts, ends, bounds = word_bounds(lowered, offsets)
    h = word_hashes(lowered, starts, ends)
    n = np.diff(bounds)
    joined = h
    for level in range(1, SHINGLE):
        joined = joined[: max(0, len(h) - level)] * LEVEL_ODD[level] + h[level:]
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out = np.zeros(counts.sum(), np.uint64)
    where = np.cumsum(counts) - counts
    long = n >= SHINGLE
    at = np.repeat(bounds[:-1][long] - where[long], counts[long]) + (np.flatnonzero(np.repeat(long, counts)))
    out[np.repeat(long, counts)] = joined[at]
    for i in np.flatnonzero((n > 0) & ~long).tolist():
        x = np.array([n[i]], np.uint64)
        for w in h[bounds[i] : bounds[i + 1]]:
            x = mix64(x * LEVEL_ODD[20] + w)
        out[where[i]] = x[0]
    return mix64(out), counts


def bags(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in order, their counts, and the number of distinct ones per document."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(head)
    return h[heads], np.diff(np.append(heads, len(h))), np.bincount(doc[heads], minlength=len(counts))


def bag_minhash(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures [documents, m] of bags given as for ``bags``; infinite for empty ones."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    out = np.full((n, m), np.inf)
    total = np.bincount(doc, weights=weights, minlength=n)
    todo = np.flatnonzero(total)
    reach = (np.log(m) + 6) / np.maximum(total, 1)
    flat = out.reshape(-1)
    while len(todo):
        among = np.zeros(n, bool)
        among[todo] = True
        rows = among[doc]
        e, w, d = elements[rows], weights[rows], doc[rows]
        low, high, block = 0, 1, 0
        while len(e):
            rate = float(m * (high - low))
            seed = mix64(e ^ times(LEVEL_ODD[50], block + 1))
            own, weight, time, key, step = d, w, np.zeros(len(e)), seed, 0
            while len(own):
                step += 1
                draw = mix64(key + times(LEVEL_ODD[30], step))
                time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
                live = time <= reach[own]
                own, weight, time, key, draw = own[live], weight[live], time[live], key[live], draw[live]
                other = mix64(draw ^ LEVEL_ODD[31])
                component = (other >> np.uint64(32)).astype(np.int64) % m
                unit = low + (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % (high - low)
                hit = unit < weight
                np.minimum.at(flat, own[hit] * m + component[hit], time[hit])
            more = w > high
            e, w, d = e[more], w[more], d[more]
            low, high, block = high, high * 2, block + 1
        todo = todo[np.isinf(out[todo]).any(1)]
        reach[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """[documents, BANDS] keys of the bands."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.zeros(bits.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64) * LEVEL_ODD[33]
    for r in range(ROWS):
        key = mix64(key * LEVEL_ODD[34 + r] + bits[:, :, r])
    return key.view(np.int64)


SIGNED = "doc_id long, d1 long, d2 long, keys array<long>"


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = binary_rows(batch["bin"])
        for i, j in doc_groups(offsets, CHUNK):
            h, counts = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            digests = []
            for c in (38, 39):
                sums = np.zeros(len(counts), np.uint64)
                full = counts > 0
                if full.any():
                    sums[full] = np.add.reduceat(mix64(h ^ LEVEL_ODD[c]), (np.cumsum(counts) - counts)[full])
                digests.append(sums.view(np.int64))
            keys = band_keys(bag_minhash(*bags(h, counts)))
            offs = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[counts > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(digests[0]), pa.array(digests[1]), listed], names=["doc_id", "d1", "d2", "keys"])


VERIFY = "a long, b long"


def verified(similarity: float) -> Callable:
    """Over (a, salt, b, bin) sorted by a, salt, with the rows of a itself (b null) first: the pairs of which any texts are similar."""

    def alike(left, e, w) -> bool:
        if not len(left[0]) or not len(e):
            return False
        at = np.searchsorted(left[0], e)
        at[at == len(left[0])] = 0
        same = left[0][at] == e
        both = np.minimum(left[1][at], w)[same].sum()
        return both >= similarity * (left[2] + w.sum() - both) - ROUNDING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, left_a, paired = [], None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binary_rows(batch["bin"])
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            pairs = []
            for i, j in doc_groups(offsets, CHUNK):
                h, counts = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                e, w, sizes = bags(h, counts)
                stop = np.cumsum(sizes)
                for x in range(i, j):
                    own = slice(stop[x - i] - sizes[x - i], stop[x - i])
                    if b[x] is None:
                        if left_a != a[x] or paired:
                            lefts, left_a, paired = [], a[x], False
                        lefts.append((e[own], w[own], w[own].sum()))
                        continue
                    if left_a != a[x]:
                        raise RuntimeError("a row of the pair's first document is missing")
                    paired = True
                    if any(alike(left, e[own], w[own]) for left in lefts):
                        pairs.append((a[x], b[x]))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return tidy(run)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, salt, b) whose bags are similar; ``texts``: (node, bin) of all of them, several for ids with several texts.

    The pairs of one node are dealt out by salt; its text goes to each salt once.
    """
    left = pairs.select("a", "salt").distinct().withColumn("b", F.lit(None).cast("long"))
    sides = left.withColumn("node", F.col("a")).unionByName(pairs.withColumn("node", F.col("b")))
    full = sides.join(texts, "node").select("a", "salt", "b", "bin")
    return full.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).mapInArrow(verified(similarity), VERIFY)


def overlaps(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[documents, documents]: sizes of the multiset intersections of different bags, as products of 0/1 matrices.

    The diagonal counts what other bags have too.
    """
    n = len(sizes)
    doc = np.repeat(np.repeat(np.arange(n), sizes), weights)
    copy = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)  # the k-th of a shingle is an element of its own
    _, column, often = np.unique(np.repeat(elements, weights) + copy.astype(np.uint64) * LEVEL_ODD[32], return_inverse=True, return_counts=True)
    shared = often[column] > 1
    doc, column = doc[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = max(1, (1 << 22) // max(1, n))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((n, width), np.float32)
        part[doc[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out


def linked_blocks(similarity: float) -> Callable:
    """Over (key, i, j, node, root, bin) sorted by key, i, j: a similar pair of each two components in a pair of blocks."""

    def links(nodes: list, roots: list, texts: list) -> list[tuple[int, int]]:
        data, offsets = binary_rows(pa.array(texts, pa.binary()))
        e, w, sizes = bags(*shingles(data, offsets))
        both = overlaps(e, w, sizes)
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=w, minlength=len(sizes))
        root = np.array(roots)
        x, y = np.nonzero((both >= similarity * (total[:, None] + total[None, :] - both) - ROUNDING) & (both > 0) & (root[:, None] < root[None, :]))
        found = {(roots[p], roots[q]): (nodes[p], nodes[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)}
        return [(min(p), max(p)) for p in found.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, i, j, *row in zip(*(batch[c].to_pylist() for c in ("key", "i", "j", "node", "root", "bin")), strict=True):
                if (key, i, j) != now:
                    if held[0]:
                        yield out(links(*held))
                    now, held = (key, i, j), ([], [], [])
                for h, x in zip(held, row, strict=True):
                    h.append(x)
        if held[0]:
            yield out(links(*held))

    return tidy(run)


def blockwise(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between components within large buckets; members: (key, node, root, n).

    A bucket is dealt to blocks of about ``BLOCK`` nodes, and each pair of blocks is compared as a whole by matrix
    products in one task, which returns a link for two components at most; so there is no row per pair of nodes.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(texts, "node").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "bin")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(linked_blocks(similarity), VERIFY)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, class_id (least id of its class), node (least id with an equal bag, null without words)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bin"))
    some = rows.where(F.col("doc_id").isNotNull())
    sign = stored(some.mapInArrow(tidy(signed), SIGNED), "signatures")
    nodes = sign.where(F.size("keys") > 0).groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("leader < last")
    buckets = stored(banded.join(shared.select("key", "leader", "n"), "key"), "buckets")  # (key, node, leader, n) of what shares a band
    texts = stored(some.join(buckets.select("node").distinct(), F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "bin").distinct(), "texts")
    first = buckets.where("node > leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n"))
    first = stored(first.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).cast("int").alias("salt"), "b"), "pairs")
    labels = components(stored(verify(first, texts, similarity), "links"))
    rooted = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_1"), F.max("root").alias("_2"), F.count(F.lit(1)).alias("n")).where("_1 < _2").select("key", "n")
    mixed = stored(rooted.join(mixed, "key"), "mixed")  # (key, node, root, n)
    more = None
    if not mixed.isEmpty():
        small = mixed.where(F.col("n") <= SMALL)
        second = small.select("key", F.col("node").alias("a"), F.col("root").alias("r1")).join(small.select("key", F.col("node").alias("b"), F.col("root").alias("r2")), "key").where("a < b and r1 <> r2")
        second = second.select("a", F.lit(0).alias("salt"), "b").distinct().join(first, ["a", "b"], "left_anti").select("a", "salt", "b")
        between = verify(stored(second, "pairs"), texts, similarity).unionByName(blockwise(mixed.where(F.col("n") > SMALL), texts, similarity))
        more = stored(between, "links")
    member = sign.where(F.size("keys") > 0).join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
    # rows of one id are one document: ids that stand for several bags tie their nodes together
    member = stored(member.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("last")), "ids")
    several = None if member.where("node < last").isEmpty() else stored(all_nodes_of_ids(sign, nodes), "links")
    known = labels.select(F.col("node").alias("a"), F.col("root").alias("b"))  # has all links so far
    added = [x for x in (more, several) if x is not None and not x.isEmpty()]
    for x in added:
        known = known.unionByName(x)
    labels = components(known) if added else labels
    member = member.select("doc_id", "node")
    out = rows.select("doc_id").join(member, "doc_id", "left").join(labels, "node", "left")
    return out.select("doc_id", F.coalesce("root", "node", "doc_id").alias("class_id"), "node")


def all_nodes_of_ids(sign: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of each id that stands for several."""
    each = sign.where(F.size("keys") > 0).join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node").distinct()
    least = each.groupBy("doc_id").agg(F.min("node").alias("a"))
    return each.join(least, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents of a class but that of least id.

    Rows without id stay, null and empty texts are classes of their own, rows that repeat the kept id all stay; an empty
    table gives an empty result.
    """
    classes = near_duplicates(docs.where(F.col("doc_id").isNotNull()), similarity)
    dropped = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
