"""Benchmark decontamination with a hash set of normalised test n-grams; DataFrame functions only.

Text is normalised by lower-casing A-Z; words are maximal runs of 0-9, a-z and characters beyond ASCII.  A test window
is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window.

The windows' 64-bit hashes are kept in a hash set that goes to all tasks: a table of bits, 64 for each window, in which
``PROBES`` bits stand for a hash, so that it lets pass one other window in 65,000.  It grows up to ``SET_LIMIT`` windows
(8 MB) and not beyond; a larger benchmark lets more windows pass, but takes the same path.  Each document is scanned once
against it, from hashes of its words: all windows of ``n`` words, and shorter ones only where a short item's first word
stands.  What passes is verified by the SHA-256 of the window's words, which is joined to the benchmark's, so neither
hashes nor bits that collide mark anything, and no window but these is shuffled.

Defined cases: null and empty texts have no words, neither in documents nor in items; a text of any length is one row,
scanned window by window; repeated rows are judged alike; a null item id counts as no item, although its windows hit;
other columns are ignored or, in ``remove_spans``, kept; an empty benchmark leaves everything clean, and empty documents
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import stored

N = 10
SET_LIMIT = 1 << 20  # windows up to which the set grows, at 64 bits a window
PROBES = 4
HIT = "struct<i:int,n:int,d:string>"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def digest(window: Column) -> Column:
    return F.sha2(F.array_join(window, " "), 256)


def hashed(w: Column) -> Column:
    """The words' hashes; a window's hash is that of its part of them."""
    return F.transform(w, lambda x: F.xxhash64(x))


def test_windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, n, h, first, d): the windows of the items, their hashes, their first words' hashes and their digests."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(n)))
    w = w.select("item_id", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("x"))
    return w.select("item_id", "n", F.xxhash64(hashed(F.col("x"))).alias("h"), F.xxhash64(F.get("x", F.lit(0))).alias("first"), digest(F.col("x")).alias("d")).distinct()


def probes(h: Column, longs: int) -> list[Column]:
    """The places of a hash in a table of 64 ``longs`` bits, a power of two."""
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return [(low + j * high).bitwiseAND(F.lit(64 * longs - 1).cast("long")) for j in range(PROBES)]


def hash_set(hashes: DataFrame, longs: int) -> Column:
    """The table of bits for column h, as an array of ``longs`` numbers: a scalar that Spark computes once."""
    bits = hashes.select(F.explode(F.array(*probes(F.col("h"), longs))).alias("p"))
    filled = bits.select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    every = filled.unionByName(hashes.sparkSession.range(longs).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("b")))
    whole = every.groupBy("i").agg(F.bit_or("b").alias("b"))  # a row per number: SET_LIMIT at most
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("t")).scalar()


def contains(table: Column, h: Column, longs: int) -> Column:
    out = None
    for p in probes(h, longs):
        hit = F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        out = hit if out is None else out & hit
    return out


def candidates(w: Column, table: Column, longs: int, whole: bool, short: list[int], n: int) -> Column:
    """Array of (i, n, d) of the windows of ``w`` that pass the set: those of n words, if ``whole``, and of the ``short`` lengths."""
    def found(hashes):
        out = []
        if whole:
            each = F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, n))))
            places = F.array_compact(F.transform(each, lambda h, i: F.when(contains(table, h, longs), i + 1)))
            out.append(F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), digest(F.slice(w, i, n)).alias("d")).cast(HIT)))
        if short:
            places = F.array_compact(F.transform(hashes, lambda h, i: F.when(contains(table, h, longs), i + 1)))

            def at(i):
                fits = lambda k: (i + (k - 1) <= F.size(w)) & contains(table, F.xxhash64(F.slice(hashes, i, k)), longs)
                return F.array_compact(F.array(*(F.when(fits(k), F.struct(i.alias("i"), F.lit(k).alias("n"), digest(F.slice(w, i, k)).alias("d")).cast(HIT)) for k in short)))

            out.append(F.flatten(F.transform(places, at)))
        return F.concat(*(F.coalesce(x, F.expr(f"cast(array() as array<{HIT}>)")) for x in out))

    return let(hashed(w), found)


def marked(docs: DataFrame, windows: DataFrame, n: int, set_limit: int) -> DataFrame:
    """``docs`` with _n (words) and _candidates (array of (i, n, d), which may or may not be in the benchmark)."""
    sizes = {r["n"]: r["c"] for r in windows.groupBy("n").agg(F.count_distinct("h").alias("c")).collect()}  # at most n rows
    size = lambda w: F.size(w).cast("long").alias("n")
    if sizes:
        short = sorted(k for k in sizes if k < n)
        # short items are also told by their first words
        hashes = windows.select("h").unionByName(windows.where(F.col("n") < n).select(F.col("first").alias("h"))).distinct()
        longs = 1 << (min(sum(sizes.values()), set_limit) - 1).bit_length()
        # one use of _set, so that Catalyst puts the scalar in its place instead of a copy into each row
        set_ = docs.select("*", hash_set(hashes, longs).alias("_set"))
        found = let(F.col("_set"), lambda t: let(words(F.col("text")), lambda w: F.struct(size(w), candidates(w, t, longs, n in sizes, short, n).alias("c"))))
    else:
        set_ = docs
        found = let(words(F.col("text")), lambda w: F.struct(size(w), F.expr(f"cast(array() as array<{HIT}>)").alias("c")))
    once = set_.select(*docs.columns, found.alias("_x"))
    both = once.select(*docs.columns, F.explode(F.array("_x")).alias("_x"))  # a generator's result is computed once, however often it is used
    return both.select(*docs.columns, F.col("_x.n").alias("_n"), F.col("_x.c").alias("_candidates"))


def runs(hits: Column) -> Column:
    """The hit words as disjoint runs (s, e) in order, e exclusive."""
    spans = F.sort_array(F.transform(hits, lambda x: F.struct(x["i"].alias("s"), (x["i"] + x["n"]).alias("e"))))

    def join(acc, x):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))).cast(kind))
        return F.when(F.size(acc) == 0, F.array(x)).when(last["e"] >= x["s"], longer).otherwise(F.concat(acc, F.array(x))).cast(kind)

    kind = "array<struct<s:int,e:int>>"
    empty = F.expr("array()").cast(kind)
    return F.when(F.size(hits) == 0, empty).otherwise(F.aggregate(spans, empty, join))


def n_hit(hits: Column) -> Column:
    return F.aggregate(runs(hits), F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])


def contamination(docs: DataFrame, items: DataFrame, n: int = N, set_limit: int = SET_LIMIT) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the ids ``items`` that occur."""
    windows = stored(test_windows(items, n), "windows")
    rows = marked(docs.select("doc_id", "text"), windows, n, set_limit).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select("_row", "doc_id", "_n", F.explode_outer("_candidates").alias("c"))
    known = windows.select("d", "item_id").distinct().withColumn("known", F.lit(True))
    judged = rows.select("_row", "doc_id", "_n", "c.i", "c.n", "c.d").join(known, "d", "left")
    out = judged.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("_n").alias("n_words"), F.array_sort(F.collect_set("item_id")).alias("items"), F.collect_set(F.when(F.col("known"), F.struct("i", "n"))).alias("hits")
    )
    out = out.withColumn("n_hit", n_hit(F.col("hits")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def remove_spans(docs: DataFrame, items: DataFrame, n: int = N, set_limit: int = SET_LIMIT, most: float = 0.5) -> DataFrame:
    """``docs`` without the hit words; documents that consist of them for more than ``most`` go, clean ones stay as they are.

    Characters between words stay; a removed word leaves the white space around it.  Documents without a word, null
    texts among them, stay; rows that are there twice are treated alike; empty documents give an empty result.
    """
    windows = stored(test_windows(items, n), "windows")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")  # no name can clash
    scanned = stored(marked(packed, windows, n, set_limit).select(F.monotonically_increasing_id().alias("_row"), "doc", "_n", "_candidates"), "scanned")
    clean = scanned.where(F.size("_candidates") == 0).select(*(F.col("doc")[c].alias(c) for c in docs.columns))
    # only documents with candidates are moved
    suspect = scanned.where(F.size("_candidates") > 0)
    hits = suspect.select("_row", F.explode("_candidates").alias("c")).select("_row", "c.*").join(windows.select("d").distinct(), "d", "left_semi").groupBy("_row").agg(F.collect_set(F.struct("i", "n")).alias("_hits"))
    rows = suspect.join(hits, "_row", "left").select("doc", F.col("doc")["text"].alias("text"), "_n", F.coalesce("_hits", F.expr("cast(array() as array<struct<i:int,n:int>>)")).alias("_hits"))

    def rest(gaps, cased, gone):
        kept = F.transform(cased, lambda w, i: F.concat(F.when(F.exists(gone, lambda r: (i + 1 >= r["s"]) & (i + 1 < r["e"])), F.lit("")).otherwise(w), F.get(gaps, i + 1)))
        return F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))

    def cut(gone):
        parts = F.struct(F.split("text", CASED_WORD, -1).alias("g"), F.regexp_extract_all("text", F.lit(f"({CASED_WORD})"), F.lit(1)).alias("w"))
        hit = F.aggregate(gone, F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])
        return F.struct(hit.alias("hit"), F.when(F.size(gone) > 0, let(parts, lambda x: rest(x["g"], x["w"], gone))).alias("text"))

    # a generator instead of a filter: Catalyst would push the filter down and compute the hits twice
    judged = rows.select("doc", "text", "_n", F.explode(F.array(let(runs(F.col("_hits")), cut))).alias("_x"))
    fine = F.filter(F.array("_x"), lambda x: (x["hit"] == 0) | (x["hit"] <= most * F.col("_n")))
    judged = judged.select("doc", "text", F.explode(fine).alias("_x"))
    return clean.unionByName(with_text(docs, judged, F.col("_x.text"), F.col("_x.hit") > 0))


def with_text(docs: DataFrame, rows: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``rows`` (doc, text): changed texts are new, and so are their lengths in n_chars."""
    rows = rows.withColumn("text", F.when(changed, text).otherwise(F.col("text"))).withColumn("_changed", changed)
    out = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*(v.alias(c) for c, v in out.items()))
