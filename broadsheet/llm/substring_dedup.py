"""Exact removal of repeated word passages with suffix automata of reference shards.

A word goes if a window of ``length`` consecutive words that covers it also starts in a document with a smaller doc_id;
windows are judged on the input.

The corpus of references is sharded by content: a shard holds the segments under one key (see ``segments``), so every
document has to be streamed through those shards alone that can hold a match of it, instead of all shards being
broadcast to all documents, which would take time with the square of the corpus.  Documents pass a shard in the order of
their ids: each is streamed through the suffix automaton of the smaller ones, which yields the matching statistics
(length of the longest match that ends at each word); where they reach ``length``, the span goes; then the document is
added to the automaton.

Defined cases: a null or empty text has no words; documents shorter than ``length`` stay whole; repeats within one
document, or between rows of one doc_id, stay; a row without id stays whole and takes no part; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, tidy, with_parts, word_bounds, word_hashes
from .segments import Spec, removed_runs, runs_of, unpack, with_runs

LENGTH = 13
GRAM = 8


def words_as_symbols(data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), bounds, starts, ends


class SuffixAutomaton:
    """Suffix automaton of a growing set of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, words: list) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._split(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, words: list) -> Iterator[int]:
        """Length of the longest substring of the set that ends at each word."""
        nxt, link, length = self.next, self.link, self.len
        state = matched = 0
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            yield matched


def repeated_windows(t: pa.Table):
    """Windows of the fetched segments that start in a smaller document too, as intervals of removed words."""
    order = np.lexsort((t["packed"].to_numpy(), t["doc_id"].to_numpy(), t["k"].to_numpy()))
    k, doc, packed = (t[c].to_numpy()[order].tolist() for c in ("k", "doc_id", "packed"))
    segs = t["seg"].take(pa.array(order)).to_pylist()
    _, parts, pos, back, _ = unpack(t["packed"].to_numpy()[order])
    at = (pos - back).tolist()
    found: list[tuple[int, int, int, int]] = []
    n, i = len(k), 0
    while i < n:
        automaton, key = SuffixAutomaton(), k[i]
        while i < n and k[i] == key:
            j = i
            while j < n and k[j] == key and doc[j] == doc[i]:
                j += 1
            sequences = [segs[x].split() for x in range(i, j)]
            for x, words in zip(range(i, j), sequences, strict=True):
                stop = None
                for place, matched in enumerate(automaton.statistics(words), 1):
                    if matched >= LENGTH:
                        if stop != place - 1:
                            if stop is not None:
                                found.append((doc[x], int(parts[x]), at[x] + begin, at[x] + stop))
                            begin = place - LENGTH
                        stop = place
                if stop is not None:
                    found.append((doc[x], int(parts[x]), at[x] + begin, at[x] + stop))
            for words in sequences:
                automaton.add(words)
            i = j
    out = np.array(found, np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def words_only(segs: pa.Array) -> pa.Array:
    """The words of each segment joined by single blanks."""
    return pa.array([b" ".join(x.split()) for x in segs.to_pylist()], pa.binary())


SPEC = Spec(LENGTH, GRAM, words_as_symbols, True, repeated_windows, words_only, True)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bins = batch["doc_id"], batch["bin"]
            size, gone, digests, kept = [], [], [], []
            for i, start, stop in runs_of(batch):
                words = bins[i].as_py().split()
                size.append(len(words))
                if len(start):
                    edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(words)]
                    words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                text = b" ".join(words)
                gone.append(size[-1] - len(words))
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return tidy(run)


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the remaining words ``kept``."""
    texts = with_parts(docs)
    out = with_runs(texts, removed_runs(texts, SPEC)).mapInArrow(_kept(with_text), RESULT)
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lost = docs.where(F.col("doc_id").isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"), (F.array_join(words, " ") if with_text else F.lit(None).cast("string")).alias("kept"),
    )
    out = out.unionByName(lost)
    return out if with_text else out.drop("kept")


__all__ = ["SuffixAutomaton", "substring_dedup"]
