"""The lattice of words as relations: the same segmentation as ``sentencepiece``, in DataFrame functions only.

Distinct words are exploded to their substrings of at most ``longest`` characters, which are equi-joined with the piece
table; the edges found are grouped by word again (the words are dealt out by word before, so grouping them moves
nothing) and folded with Spark's ``aggregate``: by Viterbi for unigram models, and for BPE models by joining the best
adjacent pair as often as the word has characters.  Pieces are then joined back to the words' places in the documents.

It needs a row per substring and one per word occurrence and moves the latter, so ``sentencepiece.encode`` does the same
per batch instead; see the README for figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .sentencepiece import MODEL, SPACE, PieceTable


BROADCAST = 1_000_000  # pieces
LONGEST = 63  # characters of a piece, as the fold numbers edges by start and length


def pieces(spark: SparkSession, table: PieceTable) -> DataFrame:
    """(piece, id, rank, score) of the normal pieces: as many rows as the vocabulary has."""
    rows = [(p, i, table.rank[i], float(table.scores[i])) for p, i in table.ids.items()]
    out = spark.createDataFrame(rows, "piece string, id int, rank int, score double")
    return F.broadcast(out) if len(rows) <= BROADCAST else out  # beyond, Spark joins by shuffling


def words(text: Column) -> Column:
    """The words of a text as the model sees them: in front of each a run of U+2581."""
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(f"({SPACE}*[^{SPACE}]+|{SPACE}+)"), F.lit(1)))


def edges(distinct: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """word and its edges (start, length, id, rank, score), starts from 1; an empty list where no piece fits."""
    starts = distinct.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    parts = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("s") + 1))).alias("l"))
    found = parts.withColumn("piece", F.substring(F.col("word"), F.col("s"), F.col("l"))).join(table, "piece", "left")
    edge = F.when(F.col("id").isNotNull(), F.struct("s", "l", "id", "rank", "score"))
    return found.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def fold_bpe(word: Column, found: Column) -> Column:
    """Starts of the pieces, then the word's end."""

    def fold(by):
        def best(bounds):
            # (rank, place) of the best pair that is a piece: pieces from bounds[k] to bounds[k + 2]
            pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(bounds) - 2, F.lit(1))), lambda k: F.struct(F.try_element_at(by, F.get(bounds, k - 1) * 64 + F.get(bounds, k + 1) - F.get(bounds, k - 1)).alias("r"), k.alias("k")))
            return F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))

        def step(bounds, _):
            kept = lambda b: F.concat(F.slice(bounds, F.lit(1), b["k"]), F.slice(bounds, b["k"] + 2, F.size(bounds)))
            return F.when(F.size(bounds) < 3, bounds).otherwise(let(best(bounds), lambda b: F.when(b.isNull(), bounds).otherwise(kept(b))))

        n = F.length(word)
        return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(1), n + 1), step)

    # a piece is told by its start and length; lengths stay below 64
    return let(F.map_from_entries(F.transform(found, lambda e: F.struct(e["s"] * 64 + e["l"], e["rank"]))), fold)


def fold_viterbi(word: Column, found: Column, penalty: float) -> Column:
    """Starts of the pieces of the path of the greatest sum of scores, then the word's end."""
    kind = "struct<v:double,p:array<int>>"

    def step(states, end):
        def via(e):
            before = F.get(states, e["s"] - 1)
            return F.struct((before["v"] + e["score"]).alias("v"), F.concat(before["p"], F.array(end + 1)).alias("p")).cast(kind)

        before = F.get(states, end - 1)
        spelled = F.struct((before["v"] + penalty).alias("v"), F.concat(before["p"], F.array(end + 1)).alias("p")).cast(kind)
        ways = F.concat(F.array(spelled), F.transform(F.filter(found, lambda e: e["s"] + e["l"] == end + 1), via))
        return F.concat(states, F.array(F.array_max(ways)))

    first = F.array(F.struct(F.lit(0.0).alias("v"), F.array(F.lit(1)).alias("p")).cast(kind))
    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step), -1)["p"]


def encode_relational(docs: DataFrame, model: str | PieceTable = MODEL) -> DataFrame:
    """doc_id and ids, as ``sentencepiece.encode`` has them, a row per row; a null or empty text has no ids."""
    table = model if isinstance(model, PieceTable) else PieceTable.load(model)
    if table.longest > LONGEST:
        raise ValueError(f"a piece of {table.longest} characters; at most {LONGEST} are allowed")
    spark = docs.sparkSession
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    places = docs.select("_row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    lattice = edges(places.select("word").where(F.col("word").isNotNull()).distinct(), pieces(spark, table), table.longest)
    bounds = fold_bpe(F.col("word"), F.col("edges")) if table.bpe else fold_viterbi(F.col("word"), F.col("edges"), min(table.scores[i] for i in table.ids.values()) - 10.0)
    byte = F.array(*(F.lit(i) for i in table.bytes))

    def spelled(char: Column) -> Column:
        if not table.has_bytes:
            return F.array(F.lit(table.unknown))
        raw = F.hex(F.encode(char, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.get(byte, F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int")))

    def ids(b):
        def piece(k):
            start, length = F.get(b, k - 1), F.get(b, k) - F.get(b, k - 1)
            own = F.filter("edges", lambda e: (e["s"] == start) & (e["l"] == length))
            return F.when(F.size(own) > 0, F.array(F.get(own, F.lit(0))["id"])).otherwise(spelled(F.substring(F.col("word"), start, F.lit(1))))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(b) - 1), piece))

    coded = lattice.select("word", let(bounds, ids).alias("ids"))
    rows = places.join(coded, "word", "left").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("x"))
    return rows.select("doc_id", F.flatten(F.transform(F.filter("x", lambda x: x["ids"].isNotNull()), lambda x: x["ids"])).alias("ids"))
