"""Exact removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a smaller doc_id, or earlier in the
same document); strings are judged on the input, overlaps count, matches never cross documents.

The suffixes that can share ``length`` bytes meet in one place (see ``segments``); of segments that are equal byte for
byte only one is sorted there, and the others share its buckets.  Suffixes are put in buckets by their first 8 bytes,
numbered in their order.  A bucket of suffixes that agree in d bytes is refined by sorting them by the bucket of the
suffix d bytes later, and then agrees in as many bytes more as that bucket does.  Buckets are refined in groups, those
that windows reach least far behind first, and each group takes over its new numbers at once: later groups of the same
pass sort by what earlier ones have refined, so the depth more than doubles from pass to pass.  A bucket is done when it
has one member or windows reach no further; neighbours in the order of the buckets that still agree in ``length`` bytes
are one class, and all of a class but the first are repeats.

Defined cases: a null or empty text is an empty document; texts shorter than ``length`` stay whole; a row without id
stays whole and takes no part; rows that repeat id and text all get the result of one; different texts of one id come
one after the other in the order of their digests; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, binary_rows, tidy, with_parts
from .segments import Spec, removed_runs, runs_of, unpack, with_runs

LENGTH = 100
GRAM = 32
GROUPS = 3  # groups of buckets in a pass


def bytes_as_symbols(data: np.ndarray, offsets: np.ndarray):
    places = np.arange(len(data) + 1)
    return BYTE_HASH[data], offsets, places[:-1], places[1:]


def first_bytes(data: np.ndarray) -> np.ndarray:
    """At each place its 8 bytes as a number that sorts like them; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def refined_buckets(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class of each of ``starts``: equal for two of them just if the ``length`` bytes from there are equal.

    Classes are numbered in the sort order of the bytes; data[start:start + length] must lie within ``data``.
    """
    n = len(data)
    words = first_bytes(data)
    place = np.arange(n, dtype=np.int32)
    need = np.zeros(n, np.int32)
    need[starts] = starts + length
    need = np.maximum.accumulate(need) - place  # how many bytes from each place the windows reach
    order = np.argsort(words)
    head = np.ones(n, bool)
    head[1:] = words[order[1:]] != words[order[:-1]]
    bucket = np.full(n + 1, -1, np.int32)  # the place of the bucket's first member in sorted order; -1 behind the end
    bucket[order] = np.maximum.accumulate(np.where(head, place, 0))
    depth = np.full(n, 8, np.int32)  # bytes in which the members of a place's bucket agree
    todo = np.flatnonzero(need > 8)
    todo = order[np.isin(bucket[order], bucket[todo])]
    sizes = np.bincount(bucket[:n])
    todo = todo[sizes[bucket[todo]] > 1].astype(np.int32)
    while len(todo):
        own = bucket[todo]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        far = np.maximum.reduceat(need[todo], heads)
        group = np.where(far > depth[todo[heads]], (far - 1) * GROUPS // length, -1)
        group = np.repeat(group, np.diff(np.append(heads, len(todo))))
        kept = []
        for g in range(GROUPS):
            pos = todo[group == g]
            if not len(pos):
                continue
            own, agree = bucket[pos], depth[pos]
            later = np.minimum(pos + agree, n)
            pointer = bucket[later]
            place = np.argsort(own * np.int64(n + 1) + pointer + 1)
            pos, own, agree, pointer = pos[place], own[place], agree[place], pointer[place]
            first = np.r_[True, own[1:] != own[:-1]]
            new = first | np.r_[True, pointer[1:] != pointer[:-1]]
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(pos)))
            at = np.arange(len(pos), dtype=np.int32)
            fresh = (own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))).astype(np.int32)
            # the depth of the bucket that a pointer names, read once for each new bucket
            then = np.minimum(pos[heads] + agree[heads], n - 1)
            grown = np.repeat(agree[heads] + np.where(pointer[heads] >= 0, depth[then], length), size)
            alone = np.repeat(size == 1, size)
            bucket[pos], depth[pos] = fresh, grown
            pos = pos[~alone]
            kept.append(pos)
        todo = np.concatenate(kept) if kept else todo[:0]
        todo = todo[np.argsort(bucket[todo])]
    # buckets may tell suffixes apart by what follows the window
    order = np.argsort(bucket[starts], kind="stable")
    at = starts[order]
    fresh = np.r_[True, bucket[at[1:]] != bucket[at[:-1]]] if len(at) else np.zeros(0, bool)
    same = np.flatnonzero(fresh[1:]) + 1
    for step in range(0, length, 8):
        here = min(step, max(0, length - 8))
        x, y = words[at[same] + here], words[at[same - 1] + here]
        same = same[x == y] if length >= 8 else same[x >> np.uint64(64 - 8 * length) == y >> np.uint64(64 - 8 * length)]
    fresh[same] = False
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def repeated_windows(t: pa.Table):
    """Windows of the fetched segments that occur earlier, as intervals of removed bytes."""
    doc, packed = t["doc_id"].to_numpy(), t["packed"].to_numpy()
    data, offsets = binary_rows(t["seg"].combine_chunks() if isinstance(t["seg"], pa.ChunkedArray) else t["seg"])
    _, part, pos, back, span = unpack(packed)
    many = span + 1
    first = np.cumsum(many) - many
    shift = np.arange(many.sum()) - np.repeat(first, many)
    starts = np.repeat(offsets[:-1], many) + shift
    at = np.repeat(pos - back, many) + shift
    doc, part = np.repeat(doc, many), np.repeat(part, many)
    bucket = refined_buckets(data, starts, LENGTH)
    shared = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    bucket, doc, part, at = (x[shared] for x in (bucket, doc, part, at))
    order = np.lexsort((at, part, doc, bucket))
    bucket, doc, part, at = (x[order] for x in (bucket, doc, part, at))
    head = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    again = (doc != doc[first]) | (part != part[first]) | (at != at[first])
    doc, part, at = doc[again], part[again], at[again]
    return doc, part, at, at + LENGTH


SPEC = Spec(LENGTH, GRAM, bytes_as_symbols, False, repeated_windows)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _kept(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bins = batch["doc_id"], batch["bin"]
            size, gone, spans, digests, kept = [], [], [], [], []
            for i, start, stop in runs_of(batch):
                text = bins[i].as_py()
                if len(start):
                    edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(text)]
                    text, whole = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(text)
                else:
                    whole = len(text)
                size.append(whole)
                gone.append(whole - len(text))
                spans.append(len(start))
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text if with_bytes else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return tidy(run)


def suffix_dedup(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining bytes ``kept``."""
    texts = with_parts(docs)
    out = with_runs(texts, removed_runs(texts, SPEC)).mapInArrow(_kept(with_bytes), RESULT)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    lost = docs.where(F.col("doc_id").isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(whole, 256).alias("kept_sha256"), (whole if with_bytes else F.lit(None).cast("binary")).alias("kept"),
    )
    out = out.unionByName(lost)
    return out if with_bytes else out.drop("kept")
