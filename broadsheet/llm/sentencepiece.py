"""Encoding and decoding with a piece table, as a lattice over words.

Text is normalised as the model says (a dummy prefix, spaces as U+2581) and cut into words before each U+2581 that
follows another character; no piece of the table may cross such a cut, which is checked.  The distinct words of a stretch
of rows make the relation (word, start, length) of all substrings of at most ``longest`` characters; it is joined with
the piece table on the substring's 64-bit hash, the piece's characters being compared afterwards; the edges found are
grouped by word and folded to the word's best segmentation.

Which segmentation is best depends on the model.  For unigram models it is the path of the greatest sum of scores
(Viterbi).  For BPE models, as the public ones here, that path differs from the library's result; the fold then joins
the adjacent pair of pieces whose union is the edge of the greatest score, leftmost first, until none is left.  All words
of a length are folded at once.  Characters that no piece covers become byte pieces or the unknown piece.

Defined cases: a null or empty text has no pieces and decodes to the empty text; repeated rows are encoded alike; rows
without id are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LEVEL_ODD, bounded_batches, mix64, tidy, times

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MATRIX = 48  # characters of a word up to which words are folded together
CACHE = 400_000  # words whose pieces a task remembers
NONE = np.int32(2**31 - 1)


class PieceTable:
    """The pieces of a SentencePiece model; its size is that of the vocabulary."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool, dummy_prefix: bool) -> None:
        self.pieces, self.scores, self.kinds, self.bpe, self.dummy_prefix = pieces, scores, kinds, bpe, dummy_prefix
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.ids = {pieces[i]: i for i in normal}
        self.unknown = kinds.index("unknown") if "unknown" in kinds else 0
        self.bytes = [0] * 256
        self.has_bytes = "byte" in kinds
        for i, k in enumerate(kinds):
            if k == "byte":
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on after a space aren't supported")
        # best first, as BPE joins them
        order = sorted(normal, key=lambda i: -scores[i])
        self.rank = {i: r for r, i in enumerate(order)}
        lengths = np.array([len(pieces[i]) for i in order])
        chars = np.zeros((len(order), self.longest), np.uint32)
        for r, i in enumerate(order):
            chars[r, : lengths[r]] = [ord(c) for c in pieces[i]]
        hashes = np.zeros(len(order), np.uint64)
        for k in range(self.longest):
            inside = lengths > k
            hashes[inside] = hashes[inside] * LEVEL_ODD[1] + mix64(chars[inside, k].astype(np.uint64) + LEVEL_ODD[2])
        hashes += times(LEVEL_ODD[3], 1) * lengths.astype(np.uint64)
        by = np.argsort(hashes)
        self.keys, self.key_rank, self.chars, self.order = hashes[by], by.astype(np.int32), chars, np.array(order, np.int32)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(hashes >> np.uint64(44)).astype(np.int64)] = True
        surface = [self._surface(i) for i in range(len(pieces))]
        self.surface_size = np.array([len(x) for x in surface])
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface_data = np.frombuffer(b"".join(surface), np.uint8)

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == "byte":
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == "control":
            return b""
        return b" \xe2\x81\x87 " if self.kinds[i] == "unknown" else self.pieces[i].replace(SPACE, " ").encode()

    @classmethod
    def load(cls, path: str) -> PieceTable:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        kinds = ["unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "byte" if model.is_byte(i) else "unused" if model.is_unused(i) else "normal" for i in range(n)]
        # a model of merges has the scores 0, -1, -2, ...; log-probabilities aren't whole numbers
        scores = [model.get_score(i) for i in range(n)]
        bpe = all(s == round(s) for s, k in zip(scores, kinds, strict=True) if k == "normal")
        return cls([model.id_to_piece(i) for i in range(n)], scores, kinds, bpe, True)

    # -- the lattice ---------------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        text = text.replace(" ", SPACE)
        return _WORDS.findall(SPACE + text if self.dummy_prefix else text) if text else []

    def edges(self, chars: np.ndarray) -> np.ndarray:
        """[words, starts, lengths - 1]: the rank of the piece that each substring is, or ``NONE``."""
        count, n = chars.shape
        out = np.full((count, n, min(n, self.longest)), NONE, np.int32)
        mixed = mix64(chars.astype(np.uint64) + LEVEL_ODD[2])
        h = np.zeros((count, n), np.uint64)
        for k in range(out.shape[2]):
            h = h[:, : n - k] * LEVEL_ODD[1] + mixed[:, k:]
            key = h + times(LEVEL_ODD[3], k + 1)
            w, s = np.nonzero(self.filter[(key >> np.uint64(44)).astype(np.int64)])
            found = key[w, s]
            at = np.searchsorted(self.keys, found)
            at[at == len(self.keys)] = 0
            same = self.keys[at] == found
            w, s, rank = w[same], s[same], self.key_rank[at[same]]
            true = np.ones(len(w), bool)
            for c in range(k + 1):
                true &= chars[w, s + c] == self.chars[rank, c]
            out[w[true], s[true], k] = rank[true]
        return out

    def fold_bpe(self, edges: np.ndarray) -> np.ndarray:
        """[words, starts]: lengths of the pieces that begin there, by joining the best adjacent pair until none is left."""
        count, n, most = edges.shape
        size = np.ones((count, n), np.int32)
        left = np.broadcast_to(np.arange(n, dtype=np.int32) - 1, (count, n)).copy()  # start of the piece before
        best = np.full((count, n), NONE, np.int32)
        if n > 1 and most > 1:
            best[:, : n - 1] = edges[:, : n - 1, 1]
        live = np.flatnonzero((best != NONE).any(1))
        while len(live):
            s = best[live].argmin(1)
            fine = best[live, s] != NONE
            live, s = live[fine], s[fine]
            t = s + size[live, s]
            total = size[live, s] + size[live, t]
            size[live, s], size[live, t], best[live, t] = total, 0, NONE
            after = s + total
            inner = after < n
            left[live[inner], after[inner]] = s[inner]
            best[live, s] = self._pair(edges, live, s, total, np.where(inner, size[live, np.minimum(after, n - 1)], 0))
            before = left[live, s]
            has = before >= 0
            w, p = live[has], before[has]
            best[w, p] = self._pair(edges, w, p, size[w, p], total[has])
        return size

    @staticmethod
    def _pair(edges, w, s, first, second):
        total = first + second
        fits = (second > 0) & (total <= edges.shape[2])
        return np.where(fits, edges[w, s, np.where(fits, total, 1) - 1], NONE)

    def fold_viterbi(self, edges: np.ndarray) -> np.ndarray:
        """[words, starts]: lengths of the pieces on the path of the greatest sum of scores."""
        count, n, most = edges.shape
        score = np.array([self.scores[i] for i in self.order])
        penalty = score.min(initial=0.0) - 10.0
        value = np.full((count, n + 1), -np.inf)
        value[:, 0] = 0
        back = np.ones((count, n + 1), np.int32)
        for end in range(1, n + 1):
            for k in range(1, min(end, most) + 1):
                rank = edges[:, end - k, k - 1]
                own = np.where(rank != NONE, score[np.where(rank != NONE, rank, 0)], penalty if k == 1 else -np.inf)
                better = value[:, end - k] + own > value[:, end]
                value[:, end] = np.where(better, value[:, end - k] + own, value[:, end])
                back[better, end] = k
        size = np.zeros((count, n), np.int32)
        at = np.full(count, n)
        rows = np.arange(count)
        while len(rows):
            k = back[rows, at]
            at = at - k
            size[rows, at] = k
            rows, at = rows[at > 0], at[at > 0]
        return size

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Pieces of distinct words."""
        out: dict[str, tuple[int, ...]] = {}
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths).tolist():
            same = [words[i] for i in np.flatnonzero(lengths == n).tolist()]
            step = max(1, (1 << 20) // (n * min(n, self.longest)))
            for a in range(0, len(same), step):
                part = same[a : a + step]
                if n > MATRIX and self.bpe:
                    out |= {w: self._long(w) for w in part}
                    continue
                chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                edges = self.edges(chars)
                size = self.fold_bpe(edges) if self.bpe else self.fold_viterbi(edges)
                w, s = np.nonzero(size)
                rank = edges[w, s, size[w, s] - 1]
                ids = np.where(rank != NONE, self.order[np.where(rank != NONE, rank, 0)], -1)
                stops = np.searchsorted(w, np.arange(len(part)), "right").tolist()
                starts, ids, at = [0, *stops[:-1]], ids.tolist(), s.tolist()
                plain = np.ones(len(part), bool)
                plain[w[rank == NONE]] = False
                for word, i, j, known in zip(part, starts, stops, plain.tolist(), strict=True):
                    out[word] = tuple(ids[i:j]) if known else tuple(chain.from_iterable((x,) if x >= 0 else self.spelled(word[p]) for x, p in zip(ids[i:j], at[i:j], strict=True)))
        return out

    def spelled(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass")) if self.has_bytes else (self.unknown,)

    def _long(self, word: str) -> tuple[int, ...]:
        """A long word, with a heap of pairs: n log n steps instead of n folds over all of it."""
        import heapq

        n = len(word)
        size, before = [1] * n, list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(s: int) -> None:
            t = s + size[s]
            if s >= 0 and t < n and size[s] + size[t] <= self.longest:
                i = self.ids.get(word[s : t + size[t]])
                if i is not None:
                    heapq.heappush(heap, (self.rank[i], s, t + size[t]))

        for s in range(n - 1):
            offer(s)
        while heap:
            _, s, e = heapq.heappop(heap)
            if not size[s] or (t := s + size[s]) >= n or t + size[t] != e:
                continue
            size[s], size[t] = e - s, 0
            if e < n:
                before[e] = s
                offer(s)
            if before[s] >= 0:
                offer(before[s])
        out: list[int] = []
        s = 0
        while s < n:
            i = self.ids.get(word[s : s + size[s]])
            out += (i,) if i is not None else self.spelled(word[s])
            s += size[s]
        return tuple(out)

    def surfaces(self, ids: np.ndarray) -> tuple[bytes, list[int]]:
        """The pieces' bytes one after the other, and where each ends (from 0)."""
        lengths = self.surface_size[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.repeat(self.surface_start[ids] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.surface_data[inside].tobytes(), ends

    def text_of(self, raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids) -> str:
        """The text of pieces: bytes joined, U+2581 as space, without the dummy prefix."""
        return self.text_of(self.surfaces(np.asarray(ids, np.int64))[0])


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
ENCODED = "n_chars long, n_words long, n_pieces long, n_bytes_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean, ids array<int>"


def encoder(table: PieceTable, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}  # ids as 32-bit integers
        first_byte, last_byte = (min(table.bytes), max(table.bytes)) if table.has_bytes else (-1, -1)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            texts = [t or "" for t in batch["text"].to_pylist()]
            words = [table.words(t) for t in texts]
            fresh = set(chain.from_iterable(words)).difference(known)
            if len(known) + len(fresh) > CACHE:
                known = {}
                fresh = set(chain.from_iterable(words))
            known |= {w: array("i", ids).tobytes() for w, ids in table.encode_words(list(fresh)).items()}
            own = [b"".join(map(known.__getitem__, w)) for w in words]
            counts = np.array([len(x) // 4 for x in own])
            flat = np.frombuffer(b"".join(own), np.int32)
            stop = np.cumsum(counts)
            spelled = np.concatenate([[0], np.cumsum((flat >= first_byte) & (flat <= last_byte))])
            raw, ends = table.surfaces(flat)
            cells: list[list] = [[] for _ in range(8)]
            for i, text in enumerate(texts):
                a, b = int(stop[i] - counts[i]), int(stop[i])
                back = table.text_of(raw[ends[a] : ends[b]])
                row = (
                    len(text), len(words[i]), b - a, int(spelled[b] - spelled[a]) if table.has_bytes else 0, hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest(),
                    hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text.replace(SPACE, " "), flat[a:b] if with_ids else None,
                )
                for c, x in zip(cells, row, strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=["doc_id", "n_chars", "n_words", "n_pieces", "n_bytes_pieces", "ids_sha256", "decoded_sha256", "lossless", "ids"])

    return tidy(run)


def encode(docs: DataFrame, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, counts, ``ids`` and its digest, the digest of the decoded text and whether it is the text.

    A text that holds U+2581 itself decodes to spaces there, as with the library.
    """
    bounded_batches(docs.sparkSession)
    out = docs.select("doc_id", "text").mapInArrow(encoder(PieceTable.load(model), with_ids), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ENCODED}")
    return out if with_ids else out.drop("ids")


def decoder(table: PieceTable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([table.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return tidy(run)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, ids)."""
    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(decoder(PieceTable.load(model)), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
