"""Byte and word passage removal against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest

from broadsheet.llm import common, segments, suffix_dedup, substring_dedup
from broadsheet.llm.common import word_bounds, word_hashes

DOCS = "doc_id long, text string"


def brute_bytes(docs):
    """docs: (order key, bytes)."""
    seen, out = {}, {}
    for key in sorted(docs):
        b = docs[key]
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen[w] = key
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(docs):
    first = {}
    words = {k: (t or "").encode().split() for k, t in docs.items()}
    for k, w in words.items():
        for i in range(len(w) - 12):
            s = tuple(w[i : i + 13])
            first[s] = min(first.get(s, k), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        out[k] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def corpus(seed, n=30):
    rng = random.Random(seed)
    vocabulary = ["a", "bc", "def", "é", "中文", "x" * 30, "the", "of"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)) + rng.choice(["", "\n", "  ", "\t"])
    shared = [text(60) for _ in range(4)]
    docs = {}
    for i in range(n):
        parts = [text(rng.randint(0, 40)) if rng.random() < 0.6 else rng.choice(shared)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 6))]
        docs[i * 3] = "".join(parts)
    docs[1], docs[4], docs[7], docs[1000] = "", "a" * 700, "ab" * 200 + "a" * 150, "a " * 300
    docs[2000] = docs[0]
    return docs


@pytest.mark.parametrize("seed,chunk,hot,unit", [(0, 1 << 19, 4096, 10**6), (1, 200, 4096, 10**6), (2, 1 << 19, 1, 50), (3, 150, 2, 20)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, hot, unit):
    docs = corpus(seed)
    for name, value in (("CHUNK", chunk), ("HOT", hot), ("UNIT", unit)):
        monkeypatch.setattr(segments, name, value)
    frame = spark.createDataFrame(list(docs.items()), DOCS).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame).collect()}
    assert got == brute_bytes({k: v.encode() for k, v in docs.items()})
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(frame).collect()}
    assert got == brute_words(docs)


def run_local(spec, docs, settings):
    """The steps in this process, so that settings hold: announce, settle, fetch and both times judge as one task each."""
    import pyarrow as pa

    ids = sorted(docs)
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "part": [0] * len(ids), "bin": [docs[i] for i in ids]})
    announced = [segments.announce(spec)(iter([batch.slice(i, 2)])) for i in range(0, len(ids), 2)]
    rows = pa.Table.from_batches([b for a in announced for b in a]).sort_by("k")
    settled = pa.Table.from_batches(list(segments.settle(spec)(iter(rows.to_batches(max_chunksize=7)))))
    kind = np.array(settled["packed"]) >> 61
    asks = {}
    for k, d, p, a in zip(*(np.array(settled[c])[kind != 1].tolist() for c in ("k", "doc_id", "packed", "aux")), strict=True):
        asks.setdefault(d, []).append({"k": k, "packed": p, "aux": a})
    runs = [tuple(np.array(settled[c])[kind == 1] for c in ("doc_id", "aux", "packed"))]
    removed = {i: set() for i in ids}
    for d, s, p in zip(*runs[0], strict=True):
        removed[d].update(range(s, p & ((1 << 45) - 1)))
    if asks:
        need = pa.RecordBatch.from_pydict({"doc_id": list(asks), "part": [0] * len(asks), "bin": [docs[i] for i in asks], "asks": list(asks.values())})
        cut = pa.Table.from_batches(list(segments.fetch(spec)(iter([need])))).sort_by([("k", "ascending"), ("aux", "ascending")])
        judged = pa.Table.from_batches(list(segments.judge(spec, False)(iter(cut.to_batches(max_chunksize=5)))))
        settings.append(judged.num_rows)
        kind = np.array(judged["packed"]) >> 61
        for d, s, p in zip(*(np.array(judged[c])[kind == 1].tolist() for c in ("doc_id", "aux", "packed")), strict=True):
            removed[d].update(range(s, p & ((1 << 45) - 1)))
        left = judged.filter(pa.array(kind != 1)).sort_by("k")
        settings.append(left.num_rows)
        for b in segments.judge(spec)(iter(left.to_batches(max_chunksize=5))):
            for d, s, e in zip(*(b[c].to_pylist() for c in ("doc_id", "start", "stop")), strict=True):
                removed[d].update(range(s, e))
    return {i: len(r) for i, r in removed.items()}


@pytest.mark.parametrize("chunk,hot,unit", [(1 << 19, 4096, 10**6), (130, 4096, 10**6), (1 << 19, 1, 10**6), (140, 1, 5)])
def test_steps_with_small_bounds(monkeypatch, chunk, hot, unit):
    for name, value in (("CHUNK", chunk), ("HOT", hot), ("UNIT", unit)):
        monkeypatch.setattr(segments, name, value)
    docs = corpus(9)
    encoded = {k: v.encode() for k, v in docs.items()}
    sizes = []
    assert run_local(suffix_dedup.SPEC, encoded, sizes) == {k: v[1] for k, v in brute_bytes(encoded).items()}
    assert run_local(substring_dedup.SPEC, encoded, sizes) == {k: v[1] for k, v in brute_words(docs).items()}
    assert sizes[0] > 0 and (sizes[1] > 0) == (hot == 1)  # only salted rows are judged twice


@pytest.mark.parametrize("most", [2, 50])
def test_keys_of_more_rows_than_are_held(monkeypatch, most):
    monkeypatch.setattr(segments, "MOST", most)
    monkeypatch.setattr(segments, "batches_of", lambda batches, rows: common.batches_of(batches, 7))
    docs = corpus(11)
    encoded = {k: v.encode() for k, v in docs.items()}
    assert run_local(suffix_dedup.SPEC, encoded, []) == {k: v[1] for k, v in brute_bytes(encoded).items()}
    assert run_local(substring_dedup.SPEC, encoded, []) == {k: v[1] for k, v in brute_words(docs).items()}


def test_equal_fingerprints_of_other_bytes_settle_nothing(monkeypatch):
    # every key and fingerprint the same: whatever is removed is removed because of its bytes
    honest = segments.anchored

    def blind(*args):
        at, lo, hi, k, seg = honest(*args)
        return at, lo, hi, np.zeros_like(k), np.zeros_like(seg)

    monkeypatch.setattr(segments, "anchored", blind)
    docs = {k: v.encode() for k, v in corpus(12, 12).items() if len(v) < 600}
    assert run_local(suffix_dedup.SPEC, docs, []) == {k: v[1] for k, v in brute_bytes(docs).items()}


def test_bounded_keys():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 2, 2, 2, 2, 3, 4, 4], "n": list(range(10))})
    for size in (1, 2, 3, 100):
        for most in (1, 2, 4, 100):
            tables = list(segments.bounded_keys((rows.slice(i, 1) for i in range(10)), "k", size, most))
            assert [x for t, _ in tables for x in t["n"].to_pylist()] == list(range(10))
            whole = [set(t["k"].to_pylist()) for t, part in tables if not part]
            parts = [set(t["k"].to_pylist()) for t, part in tables if part]
            assert all(len(p) == 1 for p in parts) and not set().union(*whole) & set().union(*parts)
            assert sum(map(len, whole)) == len(set().union(*whole))


def test_same_bytes():
    data = np.frombuffer(b"abcdefgh_abcdefgh_abcdefgx0123456789" * 2, np.uint8)
    a, b, n = np.array([0, 0, 0, 0, 10]), np.array([9, 18, 36, 36, 19]), np.array([8, 8, 36, 30, 9])
    assert segments.same_bytes(data, a, b, n).tolist() == [True, False, True, True, False]


def test_defined_cases(spark):
    text = "x1 " * 5 + "y z " * 60
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (3, None, "e"), (4, "short", "f"), (4, text + "tail", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, bin string").withColumnRenamed("bin", "runs")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(frame).collect())
    inside = brute_bytes({1: text.encode()})[1][1]  # the text repeats itself
    n = len(text)
    assert got[:4] == [(-1, n, 0), (1, n, inside), (1, n, inside), (2, n, n)] and got[4] == (3, 0, 0) and (4, 5, 0) in got and len(got) == 7
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame).collect())
    assert got == [(-1, 125, 0), (1, 125, 0), (1, 125, 0), (2, 125, 125), (3, 0, 0), (4, 1, 0), (4, 126, 125)]
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup):
        assert f(frame.limit(0)).count() == 0


def test_refined_buckets():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[200:330] = data[20:150]
    for length in (3, 8, 20, 100):
        starts = np.arange(len(data) - length + 1)
        bucket = suffix_dedup.refined_buckets(data, starts, length)
        windows = [bytes(data[s : s + length]) for s in starts]
        order = sorted(range(len(starts)), key=lambda i: windows[i])
        assert [windows[i] for i in np.argsort(bucket, kind="stable")] == [windows[i] for i in order]
        assert len(set(bucket.tolist())) == len(set(windows))
        assert all((bucket[i] == bucket[j]) == (windows[i] == windows[j]) for i, j in zip(order, order[1:], strict=False))


def test_suffix_automaton():
    rng = random.Random(2)
    for _ in range(200):
        known = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        machine = substring_dedup.SuffixAutomaton()
        for k in known:
            machine.add(k)
        text = [rng.choice("abcd") for _ in range(20)]
        subs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        wanted = [max((n for n in range(1, e + 1) if tuple(text[e - n : e]) in subs), default=0) for e in range(1, 21)]
        assert list(machine.statistics(text)) == wanted


def test_words():
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab é\t\n\x0b\x1f中") for _ in range(rng.randint(0, 30))).encode() for _ in range(50)] + [b"", b"w" * 9000 + b" " + b"w" * 4904]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.cumsum([0, *map(len, rows)])
    starts, ends, bounds = word_bounds(data, offsets)
    assert [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(bounds, bounds[1:], strict=False)] == [r.split() for r in rows]
    h = word_hashes(data, starts, ends)
    words = [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)]
    assert len(set(h.tolist())) == len(set(words)) == len({(w, x) for w, x in zip(words, h.tolist(), strict=True)})


def test_more_texts_of_an_id_than_its_field_holds():
    parts = np.array([0, 65_535], np.int64)
    assert segments.unpack(segments.pack(parts, 7, 1, 2))[1].tolist() == parts.tolist()
    for parts in (parts + 1, parts + (1 << 17)):
        with pytest.raises(ValueError):
            segments.pack(parts, 7, 1, 2)
        with pytest.raises(ValueError):
            segments.pack_run(parts, 7)


@pytest.mark.parametrize("spec", [suffix_dedup.SPEC, substring_dedup.SPEC])
def test_shuffle_files_go_once_a_scratch_table_is_written(spark, spec):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    line = " ".join(f"word{i}" for i in range(40))
    texts = common.with_parts(spark.createDataFrame([(i, f"{i} {line} {i * 7} {line[i:]}") for i in range(20)], DOCS))
    before, setting = shuffles(), spark.conf.get(common.CLEANUP)
    runs = segments.removed_runs(texts, spec)
    for _ in range(50):  # they go in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.CLEANUP) == setting
    assert {r.doc_id for r in runs.collect()} >= set(range(1, 20))
