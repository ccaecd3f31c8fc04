"""Repeated windows of symbols, found without shipping the texts.

Both exact deduplicators ask which windows of L consecutive symbols (bytes or words) occur earlier in the corpus.  A
window is represented by its *anchor*, the run of q symbols in it with the least hash (leftmost on ties), which depends
on the window's symbols alone, so equal windows have equal anchors at equal offsets.  The windows that share an anchor
occurrence form a *segment* of at most 2L - q symbols; only a key and a fingerprint of each segment are shuffled:

1. ``announce``: each task emits its segments' (anchor key, fingerprint, document, place); segments equal to an earlier
   one of the same task, symbol by symbol, are settled on the spot (``UNIT`` segments at a time), so that a passage of
   very many documents makes a row per task and distinct segment, not per document.
2. ``settle``: with a key's rows together, segments that share their key are asked for.  (With ``trusting``, copies are
   settled by their fingerprints here, and only keys of several different segments are asked for.)  Where a key has more
   than ``HOT`` different segments, each window of them gets a key of its own instead; where it has more rows than that,
   they are dealt out by a salt.  A key of more than ``MOST`` rows passes through without being held.
3. ``fetch``: the asked-for segments are cut out of the texts.
4. ``judge``: of segments with equal symbols the earliest stands for all, and the others are settled; the operator's own
   comparison (bucket-pointer refinement, suffix automata) judges the windows of those that are left under a key.  Salted
   keys are judged twice: each salt on its own, which leaves one of equal segments, and then what is left.
5. ``runs``: all settled windows, merged to runs of removed symbols per document, meet the texts again.

Work and shuffle are linear in the corpus; no step holds more than a bounded chunk, one text, or about ``MOST`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEVEL_ODD, batches_of, binary_rows, bounded_batches, doubled, mix64, stored, tidy, whole_keys

CHUNK = 1 << 19  # symbols or bytes handled at once
INDEX_BITS = 22
UNIT = 500_000  # segments settled within a task at once
HELD = 32 << 20  # bytes of text after which they are settled, too
HOT = 4096  # different segments of one key beyond which its windows are dealt out one by one, and rows beyond which they are salted
JUDGED = 4_000  # segments compared at once, if a key has no more
MOST = 1_000_000  # rows of one key that are held at once

RUN, ASK, HOT_ASK = 1, 0, 2
ANNOUNCED = "k long, seg long, doc_id long, packed long"
SETTLED = "k long, doc_id long, packed long, aux long"
FETCHED = "k long, doc_id long, packed long, aux long, seg binary"
RUNS = "doc_id long, part long, start long, stop long"


@dataclass(frozen=True)
class Spec:
    """What the two operators differ in."""

    length: int  # symbols of a window
    gram: int  # symbols of an anchor, a power of two
    symbolise: Callable  # (data, offsets) -> (symbol hashes, offsets, first byte of each symbol, end byte of each symbol)
    by_document: bool  # earlier: in a smaller document only; else also earlier in the same document
    compare: Callable  # table of whole keys -> (doc, part, start, stop) of windows that occur earlier
    plain: Callable = lambda segs: segs  # binary column of segments -> equal ones for equal symbols
    trusting: bool = False  # equal keys and fingerprints of segments in different tasks count as equal symbols


def fitting(part):
    """``part``, if its 16 bits hold it."""
    if np.any(np.asarray(part) >> 16):
        raise ValueError("more than 65,536 different texts of one doc_id")
    return part


def pack(part, pos, back, span, kind=0):
    return (np.int64(kind) << 61) | (fitting(part) << 45) | (pos << 14) | (back << 7) | span


def unpack(packed):
    return packed >> 61, (packed >> 45) & 0xFFFF, (packed >> 14) & 0x7FFFFFFF, (packed >> 7) & 127, packed & 127


def pack_run(part, stop):
    return (np.int64(RUN) << 61) | (fitting(part) << 45) | stop


def anchored(symbols: np.ndarray, bounds: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """Segments of the pieces bounds[i]..bounds[i + 1]: anchor, first and last window start, key, fingerprint."""
    length, gram = spec.length, spec.gram
    n, whole = len(symbols), 1 << (length.bit_length() - 1)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h = doubled(symbols, (gram, whole))
    grams, wholes = mix64(h[gram]), h[whole]
    mask = np.uint64((1 << INDEX_BITS) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    valid = np.zeros(n + 1, np.int32)
    long = bounds[1:] - bounds[:-1] >= length
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: n - length + 1]) > 0)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = (least[starts] & mask).astype(np.int64)
    head = np.ones(len(starts), bool)
    head[1:] = (starts[1:] != starts[:-1] + 1) | (at[1:] != at[:-1])
    heads = np.flatnonzero(head)
    lo, hi, at = starts[heads], starts[np.append(heads[1:], len(starts)) - 1], at[heads]
    tail = hi + length - whole
    middle = np.minimum(lo + whole, tail)
    seg = wholes[lo] * LEVEL_ODD[40] + wholes[middle] * LEVEL_ODD[41] + wholes[tail] * LEVEL_ODD[42]
    seg = mix64(seg + (at - lo).astype(np.uint64) * LEVEL_ODD[43] + (hi - lo).astype(np.uint64) * LEVEL_ODD[44])
    return at, lo, hi, grams[at], seg


def merged(doc, part, start, stop) -> tuple[np.ndarray, ...]:
    """Union of intervals per (doc, part)."""
    if not len(doc):
        return doc, part, start, stop
    order = np.lexsort((start, part, doc))
    doc, part, start, stop = doc[order], part[order], start[order], stop[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    base = np.cumsum(other).astype(np.int64) << 40
    far = np.maximum.accumulate(base + stop)
    head = other.copy()
    head[1:] |= (base + start)[1:] > far[:-1]
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(doc)) - 1
    return doc[heads], part[heads], start[heads], (far - base)[tails]


def copies(k, seg, doc, packed, by_document: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (key, fingerprint, document, place); in that order, which rows repeat an earlier segment, and where it is."""
    order = np.lexsort((packed, doc, seg, k))
    k, seg, doc = k[order], seg[order], doc[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (seg[1:] != seg[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
    if by_document:
        return order, doc > doc[first], first
    place = packed[order]  # a row that is there twice doesn't repeat itself
    return order, (doc != doc[first]) | (place != place[first]), first


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a + length] equals data[b:b + length], for each of the places; lengths are at least 8."""
    if not len(a):
        return np.zeros(0, bool)
    words = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), strides=(1,))  # the 8 bytes from each place on
    out = np.ones(len(a), bool)
    for at in range(0, int(length.max()), 8):
        rows = np.flatnonzero(out & (length > at))
        here = np.minimum(at, length[rows] - 8)
        out[rows] = words[a[rows] + here] == words[b[rows] + here]
    return out


def same_symbols(spec: Spec, data: np.ndarray, a: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_stop: np.ndarray) -> np.ndarray:
    """Whether two places of the text hold equal symbols: equal bytes, or what ``spec.plain`` makes equal of them."""
    out = np.zeros(len(a), bool)
    level = np.flatnonzero((a_stop - a == b_stop - b) & (a_stop - a >= 8))
    out[level] = same_bytes(data, a[level], b[level], (a_stop - a)[level])
    rest = np.flatnonzero(~out)
    if len(rest):
        left, right = (spec.plain(cut_out(data, x[rest], y[rest])) for x, y in ((a, a_stop), (b, b_stop)))
        out[rest] = pc.equal(left, right).to_numpy(zero_copy_only=False)
    return out


def run_rows(doc, packed, length: int) -> tuple[np.ndarray, ...]:
    """Merged runs of the windows of settled segments, as (doc, part, start, stop)."""
    _, part, pos, back, span = unpack(packed)
    return merged(doc, part, pos - back, pos - back + span + length)


def doc_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def announce(spec: Spec) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[np.ndarray] = []
        n = size = 0

        def flush():
            k, seg, doc, packed, begin, end = (np.concatenate(x) for x in zip(*held, strict=True))
            data = np.concatenate(texts)
            order, again, first = copies(k, seg, doc, packed, spec.by_document)
            where = np.flatnonzero(again)
            one, other = order[where], order[first[where]]
            again[where] = same_symbols(spec, data, begin[one], end[one], begin[other], end[other])
            d, part, start, stop = run_rows(doc[order[again]], packed[order[again]], spec.length)
            keep = order[~again]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in ((k[keep], mix64(d.astype(np.uint64)).view(np.int64)), (seg[keep], start), (doc[keep], d), (packed[keep], pack_run(part, stop)))],
                names=["k", "seg", "doc_id", "packed"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binary_rows(batch["bin"])
            ids, parts = batch["doc_id"].to_numpy(), batch["part"].to_numpy()
            for i, j in doc_groups(offsets, CHUNK):
                sub = data[offsets[i] : offsets[j]]
                symbols, bounds, begins, ends = spec.symbolise(sub, offsets[i : j + 1] - offsets[i])
                for a, b, cut in pieces(bounds, spec.length):
                    at, lo, hi, k, seg = anchored(symbols[a:b], cut - a, spec)
                    at, lo, hi = at + a, lo + a, hi + a
                    which = np.searchsorted(bounds, lo, "right") - 1
                    place = pack(parts[i + which], at - bounds[which], at - lo, hi - lo)
                    held.append((k.view(np.int64), seg.view(np.int64), ids[i + which], place, size + begins[lo], size + ends[hi + spec.length - 1]))
                    n += len(at)
                texts.append(sub)
                size += len(sub)
                if n >= UNIT or size >= HELD:
                    if n:
                        yield from flush()
                    held.clear()
                    texts.clear()
                    n = size = 0
        if n:
            yield from flush()

    return tidy(run)


def pieces(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches to handle at once, with the bounds of the texts in them; a very long text comes in overlapping pieces."""
    if bounds[-1] - bounds[0] <= 2 * CHUNK:
        yield int(bounds[0]), int(bounds[-1]), bounds
        return
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for s in range(a, max(a + 1, b - length + 1), CHUNK):
            e = min(b, s + CHUNK + length - 1)
            yield s, e, np.array([s, e])


def bounded_keys(batches: Iterator[pa.RecordBatch], key: str, rows: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """As ``whole_keys``, but a key of more than about ``most`` rows comes in several tables of its own, marked as such."""
    held, open_key = None, None  # the last key so far; a key that has come in parts already
    for t in batches_of(batches, rows):
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        held = None
        k = t[key].to_numpy()
        if open_key is not None:
            own = int(np.searchsorted(k != open_key, True))
            if own:
                yield t.slice(0, own).combine_chunks(), True
                t, k = t.slice(own), k[own:]
            if not len(k):
                continue
            open_key = None
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if cut:
            yield t.slice(0, cut).combine_chunks(), False
        if len(k) - cut > most:
            open_key = k[-1]
            yield t.slice(cut).combine_chunks(), True
        else:
            held = t.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held, False


def salted(doc: np.ndarray, groups: np.ndarray | int) -> np.ndarray:
    """A salt from 1 to ``groups``, by document."""
    return 1 + (mix64(doc.astype(np.uint64) ^ LEVEL_ODD[49]) % np.asarray(groups, np.uint64)).astype(np.int64)


def settle(spec: Spec) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, part_of_key in bounded_keys(batches, "k", 400_000, MOST):
            k, seg, doc, packed = (t[c].to_numpy() for c in ("k", "seg", "doc_id", "packed"))
            done = packed >> 61 == RUN
            d0, p0, s0 = doc[done], packed[done], seg[done]
            k, seg, doc, packed = (x[~done] for x in (k, seg, doc, packed))
            d, part, start, stop = (np.zeros(0, np.int64),) * 4
            if spec.trusting:
                order, again, _ = copies(k, seg, doc, packed, spec.by_document)
                k, seg, doc, packed = (x[order] for x in (k, seg, doc, packed))
                d, part, start, stop = run_rows(doc[again], packed[again], spec.length)
                k, seg, doc, packed = (x[~again] for x in (k, seg, doc, packed))
            elif len(k):
                order = np.lexsort((seg, k))
                k, seg, doc, packed = (x[order] for x in (k, seg, doc, packed))
            aux = np.zeros(len(k), np.int64)
            if part_of_key and len(k):
                packed, aux = packed | (np.int64(HOT_ASK) << 61), salted(doc, HOT)
            elif len(k):
                key_head = np.r_[True, k[1:] != k[:-1]]
                seg_head = key_head | np.r_[True, seg[1:] != seg[:-1]]
                key = np.cumsum(key_head) - 1
                rows = np.bincount(key)
                kinds = np.bincount(key, weights=seg_head).astype(np.int64)
                heads = np.flatnonzero(key_head)
                several = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads) if spec.by_document else rows > 1
                ask = (several & ((kinds > 1) | (not spec.trusting)))[key]
                k, doc, packed, key = k[ask], doc[ask], packed[ask], key[ask]
                packed = packed | np.where(kinds[key] > HOT, np.int64(HOT_ASK) << 61, 0)
                aux = np.where(rows[key] > HOT, salted(doc, -(-rows[key] // HOT)), 0)
            columns = ((np.zeros(len(d0) + len(d), np.int64), k), (d0, d, doc), (p0, pack_run(part, stop), packed), (s0, start, aux))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["k", "doc_id", "packed", "aux"])

    return tidy(run)


def cut_out(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Binary column of data[begin[i]:end[i]]."""
    lengths = end - begin
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def fetch(spec: Spec) -> Callable:
    """Cuts the asked-for segments out of the texts; of keys that are hot, single windows under keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binary_rows(batch["bin"])
            ids = batch["doc_id"].to_numpy()
            asks = batch["asks"]
            counts = np.diff(asks.offsets.to_numpy())
            flat = asks.flatten()
            ks, packs, salts = (flat.field(c).to_numpy() for c in ("k", "packed", "aux"))
            first = np.concatenate([[0], np.cumsum(counts)])
            for i, j in doc_groups(offsets, CHUNK):
                sub = data[offsets[i] : offsets[j]]
                symbols, bounds, begins, ends = spec.symbolise(sub, offsets[i : j + 1] - offsets[i])
                rows = slice(first[i], first[j])
                k, packed, salt = ks[rows], packs[rows], salts[rows]
                base = np.repeat(bounds[:-1], counts[i:j])
                doc = np.repeat(ids[i:j], counts[i:j])
                kind, part, pos, back, span = unpack(packed)
                lo, stop = pos - back, pos - back + span + spec.length
                plain = kind == ASK
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[plain]), pa.array(doc[plain]), pa.array(packed[plain]), pa.array(salt[plain]), cut_out(sub, begins[(base + lo)[plain]], ends[(base + stop)[plain] - 1])],
                    names=["k", "doc_id", "packed", "aux", "seg"],
                )
                if plain.all():
                    continue
                many = span[~plain] + 1
                lo = np.repeat(lo[~plain], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                base, doc, part, salt = (np.repeat(x[~plain], many) for x in (base, doc, part, salt))
                wholes = doubled(symbols, (1 << (spec.length.bit_length() - 1),))[1 << (spec.length.bit_length() - 1)]
                tail = base + lo + spec.length - (1 << (spec.length.bit_length() - 1))
                own = mix64(wholes[base + lo] * LEVEL_ODD[45] + wholes[tail] * LEVEL_ODD[46]).view(np.int64)
                begin, end = begins[base + lo], ends[base + lo + spec.length - 1]
                packed = pack(part, lo, 0, 0)
                order, again, one = copies(own, own, doc, packed, spec.by_document)
                where = np.flatnonzero(again)
                x, y = order[where], order[one[where]]
                again[where] = same_symbols(spec, sub, begin[x], end[x], begin[y], end[y])
                keep = order[~again]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[keep]), pa.array(doc[keep]), pa.array(packed[keep]), pa.array(salt[keep]), cut_out(sub, begin[keep], end[keep])],
                    names=["k", "doc_id", "packed", "aux", "seg"],
                )
                d, p, s, e = run_rows(doc[order[again]], packed[order[again]], spec.length)
                empty = np.zeros(len(d), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mix64(d.astype(np.uint64)).view(np.int64)), pa.array(d), pa.array(pack_run(p, e)), pa.array(s), cut_out(sub, empty, empty)], names=["k", "doc_id", "packed", "aux", "seg"])

    return tidy(run)


def judge(spec: Spec, last: bool = True) -> Callable:
    """Runs of removed symbols, from rows sorted by k and, unless it is the ``last`` time, aux.

    The first time, salted rows come as the first of those with equal symbols under a key and a salt, and runs in the
    form of the other rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, "k", JUDGED, *(() if last else ("aux",))):
            doc, packed, aux = (t[c].to_numpy() for c in ("doc_id", "packed", "aux"))
            done = packed >> 61 == RUN
            found = [(doc[done], (packed[done] >> 45) & 0xFFFF, aux[done], packed[done] & ((1 << 45) - 1))]
            t = t.filter(pa.array(~done)).combine_chunks()
            if t.num_rows:
                k, doc, packed, salt = (t[c].to_numpy() for c in ("k", "doc_id", "packed", "aux"))
                group = k if last else mix64(k.view(np.uint64) + salt.astype(np.uint64) * LEVEL_ODD[48]).view(np.int64)
                symbols = pc.dictionary_encode(spec.plain(t["seg"].combine_chunks())).indices.to_numpy().astype(np.int64)
                order, again, _ = copies(group, symbols, doc, packed, spec.by_document)
                found.append(run_rows(doc[order[again]], packed[order[again]], spec.length))
                rest = order[~again]
                if not last:
                    dealt = salt[rest] > 0
                    yield from t.take(pa.array(rest[dealt])).combine_chunks().to_batches()
                    rest = rest[~dealt]
                kinds = np.unique(np.stack([group[rest], symbols[rest]]), axis=1)[0] if len(rest) else group[:0]
                several = np.isin(group[rest], kinds[:-1][kinds[1:] == kinds[:-1]])
                if several.any():
                    found.append(spec.compare(t.take(pa.array(rest[several])).combine_chunks()))
            doc, part, start, stop = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, part, start, stop)], names=["doc_id", "part", "start", "stop"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(doc), np.int64)), pa.array(doc), pa.array(pack_run(part, stop)), pa.array(start), pa.nulls(len(doc), pa.binary())], names=["k", "doc_id", "packed", "aux", "seg"])

    return tidy(run)


def removed_runs(texts: DataFrame, spec: Spec) -> DataFrame:
    """(doc_id, part, start, stop): symbols covered by windows that occur earlier; ``texts`` as of ``with_parts``."""
    bounded_batches(texts.sparkSession)
    announced = texts.mapInArrow(announce(spec), ANNOUNCED)
    known = stored(announced.repartition("k").sortWithinPartitions("k").mapInArrow(settle(spec), SETTLED), "segments", free=True)
    kind = F.shiftright("packed", 61)
    asks = known.where(kind != RUN).groupBy("doc_id", part_of("packed").alias("part")).agg(F.collect_list(F.struct("k", "packed", "aux")).alias("asks"))
    cut = texts.join(asks.hint("shuffle_hash"), ["doc_id", "part"]).mapInArrow(fetch(spec), FETCHED)
    judged = stored(cut.repartition("k", "aux").sortWithinPartitions("k", "aux").mapInArrow(judge(spec, False), FETCHED), "judged", free=True)
    left = judged.where(kind != RUN).repartition("k").sortWithinPartitions("k").mapInArrow(judge(spec), RUNS)
    early = known.select("doc_id", "packed", "aux").unionByName(judged.select("doc_id", "packed", "aux")).where(kind == RUN)
    return early.select("doc_id", part_of("packed").alias("part"), F.col("aux").alias("start"), F.expr(f"packed & {(1 << 45) - 1}").alias("stop")).unionByName(left)


def part_of(column: str):
    return F.shiftright(column, 45).bitwiseAND(F.lit(0xFFFF)).cast("long")


def with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Each text with its runs, null if it has none."""
    grouped = runs.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return texts.join(grouped.hint("shuffle_hash"), ["doc_id", "part"], "left")


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``with_runs``: its number and its runs, merged."""
    lists = batch["runs"]
    for i, x in enumerate(lists):
        pairs = x.as_py()
        if not pairs:
            yield i, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        zero = np.zeros(len(pairs), np.int64)
        _, _, start, stop = merged(zero, zero, np.array([p["start"] for p in pairs]), np.array([p["stop"] for p in pairs]))
        yield i, start, stop


__all__ = ["Spec", "batches_of", "removed_runs", "runs_of", "with_runs"]
