import math
import random
import re

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import blocks, emotions, entities, explore, statistics, topics
from broadsheet.plans.engine import QueryEngine, file_coverage, loading_status

LINE = "text string, text_block_id string, page_id string, date string, x int, y int, filename string, newspaper_id string, newspaper_title string, year int, month int, day int"


def line(text, block, x, y, page="page1"):
    return (text, block, page, "2001-01-01", x, y, "test.xml", "123", "Test Paper", 2001, 1, 1)


def test_text_blocks(frame):
    df = frame(LINE, line("Line 2", "block1", 100, 20), line("Line 1", "block1", 100, 10), line("Line 4", "block2", 100, 60), line("Line 3", "block2", 100, 50))
    rows = {r.text_block_id: r for r in blocks.text_blocks(df).collect()}
    assert {k: (r.text, r.line_count, r.min_y, r.max_y, r.avg_x, r.date, r.page_id) for k, r in rows.items()} == {
        "block1": ("Line 1 Line 2", 2, 10, 20, 100.0, "2001-01-01", "page1"), "block2": ("Line 3 Line 4", 2, 50, 60, 100.0, "2001-01-01", "page1")
    }
    assert sum(r.line_count for r in rows.values()) == df.count()


def test_text_blocks_by_other_keys(frame):
    df = frame(LINE, line("A", "1", 0, 10), line("B", "2", 0, 20), line("C", "3", 0, 30, "page2"), line(None, "4", 0, 40, "page2"))
    rows = {r.page_id: (r.text, r.line_count) for r in blocks.text_blocks(df, ("page_id", "date"), ("y",)).collect()}
    assert rows == {"page1": ("A B", 2), "page2": ("C", 2)}
    with pytest.raises(ValueError, match="missing columns: nope"):
        blocks.text_blocks(df, ("nope",))


def test_sentences(frame):
    df = frame("text_block_id string, text string", ("block1", "Das ist Satz eins. Das ist Satz zwei."), ("block2", "Ein einzelner Satz."), ("block3", " "), ("block4", None))
    rows = [(r.text_block_id, r.sentence_id, r.sentence_count) for r in blocks.sentences(df).orderBy("text_block_id", "sentence_id").collect()]
    assert rows == [("block1", 0, 2), ("block1", 1, 2), ("block2", 0, 1)]
    with pytest.raises(ValueError, match="missing"):
        blocks.sentences(df, "body")


def test_issue_texts(frame):
    pages = frame("date string, issue string, page int, text string", ("d", "1", 2, "b" * 100), ("d", "1", 1, "a" * 100), ("d", "1", 3, "short"))
    r = blocks.issue_texts(pages).first()
    assert r.text == "a" * 100 + " " + "b" * 100 and r.num_pages == 2
    rows = frame("uid string, page int, block_order int, text string", ("u", 2, 0, "c"), ("u", 1, 1, "b"), ("u", 1, 0, "a"))
    assert blocks.issue_export(rows).first()["value"] == "=== PAGE 1 ===\n\na\n\nb\n\n=== PAGE 2 ===\n\nc"


ENTITY = "line_id string, entity_text string, entity_type string, confidence double"


def test_compare_methods_like_full_outer(spark, frame):
    rng = random.Random(5)
    rows = lambda n: [(rng.choice(["l1", "l2", "l3", None]), rng.choice("ABC"), rng.choice(["person", "location"]), 0.5) for _ in range(n)]
    a, b = frame(ENTITY, *rows(25)), frame(ENTITY, *rows(20))
    lines = frame("line_id string, text string, date string", ("l1", "x", "d"), ("l2", "y", "d"), ("l3", "z", "d"))
    a.createOrReplaceTempView("_a"), b.createOrReplaceTempView("_b"), lines.createOrReplaceTempView("_l")
    wanted = spark.sql(
        "SELECT coalesce(e1.line_id, e2.line_id) line_id, e1.entity_text, e1.entity_type, e2.entity_text, e2.entity_type, s.text, s.date FROM _a e1 FULL OUTER JOIN _b e2 "
        "ON e1.line_id = e2.line_id AND e1.entity_text = e2.entity_text JOIN _l s ON coalesce(e1.line_id, e2.line_id) = s.line_id WHERE e1.entity_text IS NULL OR e2.entity_text IS NULL"
    )
    key = lambda rs: sorted(str(tuple(r)) for r in rs)
    assert key(entities.compare_methods(a, b, lines).collect()) == key(wanted.collect())


def test_co_occurrence_counts_pairs(frame):
    e = frame(ENTITY, *[("l", t, "person", 1.0) for t in "AABB"], ("m", "A", "person", 1.0), ("m", "B", "person", 1.0), ("n", "A", "person", 1.0))
    assert [tuple(r) for r in entities.co_occurrence(e, more_than=4).collect()] == [("A", "B", 5)]
    assert entities.co_occurrence(e).count() == 0


def test_responses(frame):
    rows = frame("line_id string, response string", ("1", '{"persons":["A","B"],"locations":null}'), ("2", "no json"), ("3", None), ("4", '{"organizations":["C"]}'))
    got = sorted((r.line_id, r.entity_text, r.entity_type) for r in entities.response_entities(rows).collect())
    assert got == [("1", "A", "person"), ("1", "B", "person"), ("4", "C", "organization")]
    q = frame("response string", ('{"sentiment":"positive","emotions":[],"intensity":0.5,"tone":"x"}',), ('{"sentiment":"odd","intensity":0.5}',), ('{"sentiment":"mixed","intensity":1.5}',), ("junk",))
    fine, bad = entities.validated(q, "emotion")
    assert fine.count() == 1 and bad.count() == 3


def test_model_entities(frame):
    lines = frame("line_id string, text string", ("1", "Anna wohnt in Berlin. " * 10), ("2", "kurz"))

    def model():
        return lambda texts: [[("Anna", "Person", 0.9), ("Berlin", "Ort", 0.8), ("Rest", "Neu", 0.7), ("weak", "Ort", 0.1)] for _ in texts]

    got = sorted((r.line_id, r.entity_text, r.entity_type) for r in entities.model_entities(lines, model).collect())
    assert got == [("1", "Anna", "person"), ("1", "Berlin", "location"), ("1", "Rest", "neu")]


def test_grouped_entities(frame):
    e = frame("line_id string, entity_text string, entity_type string, pos int", ("1", "B", "person", 0), ("1", "A", "person", 1), ("1", "b", "person", 2))
    assert entities.grouped_entities(e).first()["entities"] == {"person": ["b", "a"], "location": [], "organization": []}


# A published table of daily means (date, Joy, Anger) and the ten outliers of each that it was published with
# (date, value, score, whether beyond the whiskers).
MEANS = """1913-02-01 0.02081165452653486 0.037460978147762745
1913-11-01 0.09126594700686948 0.016683022571148183
1914-01-01 0.05106382978723404 0.02553191489361702
1914-05-01 0.0343811394891945 0.022593320235756387
1915-04-01 0.0647921760391198 0.03178484107579462
1915-12-01 0.0491183879093199 0.022670025188916875
1916-02-01 0.029171528588098017 0.03733955659276546
1916-03-01 0.03816793893129771 0.04198473282442748
1917-10-01 0.040625 0.028125
1917-12-01 0.029900332225913623 0.021040974529346623
1918-02-01 0.032908704883227176 0.03821656050955414
1918-10-01 0.01950162513542795 0.024918743228602384
1919-01-01 0.04 0.06
1919-07-01 0.04433497536945813 0.014778325123152709"""
OUTLIERS = """Joy 1913-11-01 0.091266 3.686 1
Joy 1915-04-01 0.064792 1.816 0
Joy 1918-10-01 0.019502 -1.383 0
Joy 1913-02-01 0.020812 -1.291 0
Joy 1914-01-01 0.051064 0.846 0
Joy 1915-12-01 0.049118 0.709 0
Joy 1916-02-01 0.029172 -0.700 0
Joy 1917-12-01 0.029900 -0.649 0
Joy 1918-02-01 0.032909 -0.436 0
Joy 1919-07-01 0.044335 0.371 0
Anger 1919-01-01 0.060000 2.809 1
Anger 1916-03-01 0.041985 1.283 0
Anger 1919-07-01 0.014778 -1.020 0
Anger 1918-02-01 0.038217 0.964 0
Anger 1913-02-01 0.037461 0.900 0
Anger 1916-02-01 0.037340 0.890 0
Anger 1913-11-01 0.016683 -0.859 0
Anger 1917-12-01 0.021041 -0.490 0
Anger 1915-04-01 0.031785 0.420 0
Anger 1914-05-01 0.022593 -0.359 0"""


def test_published_outliers(frame):
    rows = [("N_" + d, float(j), float(a), int(d[:4]), "war", "pre") for d, j, a in (x.split() for x in MEANS.splitlines())]
    report = statistics.outlier_report(frame("id string, mean_Joy double, mean_Anger double, year int, era1 string, era2 string", *rows)).orderBy("emotion", "rank")
    got = {(r.emotion, r.rank): (r.date, r.value, r.z_mad, str(r.iqr_outlier)) for r in report.collect()}
    wanted = {}
    for x in OUTLIERS.splitlines():
        emotion, *rest = x.split()
        wanted[emotion, sum(k[0] == emotion for k in wanted) + 1] = tuple(rest)
    assert got == wanted
    assert [r.id for r in statistics.peaks(report, "Joy", 2).collect()] == ["N_1913-11-01", "N_1915-04-01"]


def mann_whitney(x, y):
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return 0.0, 1.0
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    n = n1 + n2
    ties = sum(t**3 - t for t in ((x + y).count(v) for v in set(x + y)))
    s2 = max(1e-12, n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(s2)
    return u, 2 * (1 - 0.5 * (1 + math.erf(z / math.sqrt(2))))


@pytest.mark.parametrize("seed", range(4))
def test_mann_whitney(frame, seed):
    rng = random.Random(seed)
    rows = [(e, g, float(rng.randint(0, 6)) + (2 if g == "a" else 0)) for e in ("J", "K") for g in "ab" for _ in range(rng.randint(1, 30))]
    out = {r.emotion: r for r in statistics.mann_whitney(frame("emotion string, g string, value double", *rows), "g", "a", "b").collect()}
    for e in ("J", "K"):
        x, y = ([v for e2, g2, v in rows if (e2, g2) == (e, g)] for g in "ab")
        u, p = mann_whitney(x, y)
        assert out[e].u1 == pytest.approx(u) and out[e].p == pytest.approx(p, abs=1e-9)
        delta = sum((a > b) - (a < b) for a in x for b in y) / (len(x) * len(y))
        assert out[e].cliffs_delta == pytest.approx(delta)


def test_mann_whitney_empty_side(frame):
    r = statistics.mann_whitney(frame("emotion string, g string, value double", ("J", "a", 1.0)), "g", "a", "b").first()
    assert (r.u1, r.p, r.cliffs_delta) == (0.0, 1.0, 0.0)


def test_upper_tail(spark):
    zs = [0.0, 0.1, 1.0, 2.0, 3.0, 3.5355, 3.54, 5.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(statistics.upper_tail(F.col("z"))).collect()]
    for z, p in zip(zs, got, strict=True):
        assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("pieces", [1, 4, 512])
def test_ranks_and_quantiles_in_pieces(frame, monkeypatch, pieces):
    monkeypatch.setattr(statistics, "PIECES", pieces)
    rng = random.Random(pieces)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.5, float(rng.randrange(9)), rng.gauss(0, 1)])) for i in range(400)]
    df = frame("id long, emotion string, value double", *rows)
    at = {}
    for k in ("a", "b", None):
        nulls = sum(x == k and v is None for _, x, v in rows)
        values = sorted(v for _, x, v in rows if x == k and v is not None)
        at |= {(k, v): nulls + values.index(v) + (values.count(v) + 1) / 2 for v in values} | {(k, None): (nulls + 1) / 2}
    got = statistics.average_rank(df).collect()
    assert len(got) == len(rows) and all(r.avg_rank == at[r.emotion, r.value] for r in got)
    plain = df.groupBy("emotion").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()
    boxes = {r.emotion: (r.q1, r.median, r.q3) for r in statistics.quantiles(df, ("emotion",)).collect()}
    assert boxes == {r.emotion: tuple(round(x, 9) for x in r.q) for r in plain}


def test_quantiles_of_a_key_without_values(frame):
    df = frame("emotion string, value double", ("a", None), ("b", 2.0))
    assert sorted((r.emotion, r.median, r.n) for r in statistics.quantiles(df, ("emotion",)).collect()) == [("a", None, 0), ("b", 2.0, 1)]
    assert statistics.quantiles(df.limit(0), ("emotion",)).count() == 0 and statistics.average_rank(df.limit(0)).count() == 0


def test_no_task_sorts_a_key(frame):
    df = frame("id long, emotion string, value double", (1, "a", 1.0), (2, "a", 2.0))
    for out in (statistics.average_rank(df), statistics.quantiles(df, ("emotion",)), statistics.outlier_scores(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan
        assert not re.search(r"windowspecdefinition\(emotion#\d+, value#", plan) and re.search(r"windowspecdefinition\(emotion#\d+, _piece#\d+, (value|_deviation)#", plan)


def test_best_pair(frame):
    rows = [("J", era, float(v + 10 * i)) for i, era in enumerate(("pre war", "war", "post war")) for v in range(8)]
    r = statistics.best_pair(frame("emotion string, era1 string, value double", *rows), (("pre war", "war"), ("pre war", "post war"))).first()
    assert (r.first, r.second) == ("pre war", "war") and r.nlog10_p == pytest.approx(-math.log10(r.p))


def test_shares_sum_to_one(frame):
    wide = frame("id string, mean_A double, mean_B double", ("N_1901-01-01", 1.0, 3.0), ("N_1901-02-01", 3.0, None), ("junk", 1.0, 1.0))
    assert sum(r.share for r in emotions.shares(wide).collect()) == pytest.approx(1)
    assert [(r.year, r.mean_A, r.mean_B) for r in emotions.yearly(wide).collect()] == [(1901, 2.0, 1.5)]
    assert {r.period: r.share_A for r in emotions.period_shares(wide).collect()} == {"1901-01": 0.25, "1901-02": 1.0}
    zero = frame("id string, mean_A double, mean_B double", ("N_1901-01-01", 0.0, 0.0))
    assert [r.share for r in emotions.shares(zero).collect()] == [0.0, 0.0]


def test_mad_zero(frame):
    long = frame("id string, emotion string, value double", *[(str(i), "J", 1.0) for i in range(5)], ("9", "J", 7.0))
    rows = statistics.outlier_scores(long).collect()
    assert {r.z_mad for r in rows} == {0.0} and [r.id for r in rows if r.iqr_outlier] == ["9"]


def test_topics(frame):
    rows = frame("date string, topics string", ("d1", "a| b |"), ("d1", "a"), ("d2", "b|a"))
    assert {(r.date, r.topic): r["count"] for r in topics.topic_counts(rows).collect()} == {("d1", "a"): 2, ("d1", "b"): 1, ("d2", "a"): 1, ("d2", "b"): 1}
    assert [(r.topic, r.place) for r in topics.topic_order(topics.topic_totals(rows)).orderBy("place").collect()] == [("a", 0), ("b", 1)]
    docs = frame("id long, text string", (1, "Haus Baum Haus Maus und Baum"), (2, None), (3, "ab"))
    assert [(r.word, r.n) for r in topics.keywords(docs, "id").orderBy("rank").collect()] == [("haus", 2), ("baum", 2), ("maus", 1)]
    assert topics.ngram_keywords(docs, "id").where("id = 1").count() == 5


def test_topic_model(frame):
    docs = frame("id long, text string", *[(i, ("hafen schiff wasser meer " if i % 2 else "kaiser krieg armee front ") * 5) for i in range(20)])
    labels = topics.model_topics(topics.topic_model(docs, topics=2)).collect()
    assert len(labels) == 2 and all(len(r.label.split()) == 2 for r in labels)


PAIR = "fulltext_basename string, source_fulltext string, picture struct<confidence:double,bbox:struct<width:double,height:double>>, caption struct<text_content:string>"


def test_pairs(frame):
    pairs = frame(
        PAIR, ("N_1901-01-02_x", "a/p1.xml", (0.9, (2.0, 3.0)), ("Der Kaiser in Berlin",)), ("N_1901-01-01_x", "a/p2.xml", (None, None), (" ",)), ("bad", "a/p3.xml", (0.4, None), None)
    )
    assert explore.with_caption(pairs).count() == 1 and explore.with_caption(pairs, False).count() == 2
    assert explore.confident(pairs, 0.5).count() == 1
    assert [r.marked for r in explore.caption_search(pairs, "kaiser").collect()] == ["Der Kaiser in Berlin"]
    assert [r.fulltext_basename for r in explore.gallery(pairs, "date", False).collect()] == ["bad", "N_1901-01-01_x", "N_1901-01-02_x"]
    assert tuple(explore.caption_coverage(pairs).first()) == (3, 1, pytest.approx(33.333333))
    assert explore.picture_area(pairs).first()["area"] == 6.0
    ner = frame("date string, entity string, type string", ("d", "berlin", "LOC"), ("d", "Berlin", "LOC"), ("d", "in", "X"), ("d", "Paris", "LOC"))
    got = sorted((r.fulltext_basename, r.entity) for r in explore.caption_entities(pairs, ner).collect())
    assert got == [("N_1901-01-02_x", "Berlin"), ("N_1901-01-02_x", "berlin"), ("N_1901-01-02_x", "in")]


def test_names_are_searched_in_distinct_words(spark, monkeypatch):
    texts = ["das neue berlin, in neu berlin", "berlin" * 30 + " x", "neu\tberlin\n\nin  ulm", " in", "\u00a0a\u2003b", "ab" * 80 + "c ulm", "", "a"]
    words = ["in", "berlin", "neu berlin", "neu\tberlin", "n", "ulm", " in", "in ", "  ", "\u00a0a", "a\u2003b", "ab" * 40, "ab" * 79 + "abc", "ab" * 79 + "abc ulm", "inber", "zz"]
    seen, own = [], explore.searched
    monkeypatch.setattr(explore, "searched", lambda t, key, column, *more: seen.append((t, column)) or own(t, key, column, *more))
    frame = spark.createDataFrame([(f"{i}.{j}", x) for i, x in enumerate(texts) for j in range(3)], "key string, said string").where("said <> ''")
    names = spark.createDataFrame([(x,) for x in words], "name string")
    got = sorted((r["key"], r["name"]) for r in explore.containing(frame, "key", "said", names, "name").collect())
    assert got == sorted((f"{i}.{j}", w) for i, x in enumerate(texts) for j in range(3) for w in words if w in x)
    plain = sorted(r[0] for r in seen[0][0].select(seen[0][1]).collect())
    assert plain == sorted({w for x in texts for w in re.split(r"[ \t\n]+", x) if w})  # once each, however many texts hold them
    assert explore.containing(frame, "key", "said", names.limit(0), "name").collect() == []


def test_layouts(spark):
    kind = "image_file string, date string, total_detections int, summary struct<by_class:map<string,int>>, detections array<struct<class:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text_content:string>>"
    d = [("Picture", 0.5, (0.0, 0.0, 1.0, 1.0), None), ("Text", 1.0, (1.0, 0.0, 2.0, 2.0), "eins"), ("Text", 0.9, (1.5, 0.5, 3.0, 2.0), "zwei")]
    rows = spark.createDataFrame([("a/p1.jpg", "d", 3, None, d), ("a/p2.jpg", "d", None, None, None)], kind)
    r = {x.image_file: x for x in explore.detection_stats(rows).collect()}
    assert (r["a/p1.jpg"].has_pictures, r["a/p1.jpg"].text_regions) == (True, 2) and r["a/p1.jpg"].avg_confidence == pytest.approx(0.8)
    assert (r["a/p2.jpg"].total, r["a/p2.jpg"].avg_confidence) == (0, 0.0)
    assert explore.region_text(rows, 0, 0, 1, 1).first()["text"] == ""  # touching is not meeting
    assert explore.region_text(rows, 0, 0, 1.6, 1).first()["text"] == "eins\n\nzwei"
    assert len(explore.selected_classes(rows, ["Text"]).first()["detections"]) == 2
    emotion = spark.createDataFrame([("p1", "joy", 0.5), ("p1", "anger", 0.7)], "page_id string, emotion string, confidence double")
    ner = spark.createDataFrame([("d", "x")], "date string, entity string")
    pairs = spark.createDataFrame([("img/p1_crop.jpg",), ("img/p1_crop.jpg",), (None,), ("",)], "source_image string")
    got = {x.page_id: (x.date, x.has_picture, x.dominant_emotion, round(x.emotion_score, 6), x.entity_count, x.top_entity) for x in explore.multimodal_index(rows, emotion, ner, pairs).collect()}
    assert got == {"p1": ("d", True, "anger", 0.6, 1, "x"), "p2": ("d", False, "unknown", 0.0, 1, "x")}
    undated = rows.withColumn("date", F.lit(None).cast("string")).withColumn("image_file", F.lit("a/N_1901-02-03_7.jpg"))
    r = explore.multimodal_index(undated, emotion, ner, pairs).first()
    assert (r.page_id, r.date, r.entity_count, r.top_entity) == ("N_1901-02-03_7", "1901-02-03", 0, None)


def test_containing(frame):
    texts = frame("k int, t string", (1, "abcdefgh abcdefgh"), (2, "xabcdeyz"), (3, "b"), (4, ""), (5, None))
    long = "".join(chr(97 + i * i % 26) for i in range(90))
    texts = texts.union(frame("k int, t string", (6, f"x {long} y"), (7, long[:70])))
    names = [long, long[:70], long[5:80], "a", "ab", "abc", "abcde", "abcdef", "abcdefgh a", "h a", "yz", "b", "zz", "abcdefgi"]
    got = sorted((r.k, r.n) for r in explore.containing(texts, "k", "t", frame("n string", *((n,) for n in names)), "n").collect())
    assert got == sorted((k, n) for k, t in ((1, "abcdefgh abcdefgh"), (2, "xabcdeyz"), (3, "b"), (6, f"x {long} y"), (7, long[:70])) for n in names if n in t)


def test_engines_of_one_session(spark, frame):
    schema = "line_id string, text string, date timestamp"
    one, two = (frame(schema, (i, f"hello {i}", None)) for i in "ab")
    frame("line_id string", ("own",)).createOrReplaceTempView("lines")
    a, b = QueryEngine(spark, lines=one), QueryEngine(spark, lines=two)
    later = a.query("SELECT line_id FROM lines")
    assert [r.line_id for r in a.search_text("hello").collect()] == ["a"] and b.query("SELECT line_id FROM lines").first()[0] == "b"
    b.close()
    assert a.get_line("a")["text"] == "hello a" and a.get_line("b") is None and later.first()[0] == "a"
    assert spark.table("lines").first()[0] == "own"
    spark.catalog.dropTempView("lines")
    with pytest.raises(ValueError, match="lines"):
        b.search_text("x")


def test_engine(spark, frame):
    lines = spark.createDataFrame(
        [("l1", "Der Kaiser kam", "1901-01-01", "a.xml", "b1"), ("l2", "nach BERLIN", "1901-02-01", "b.xml", "b2")], "line_id string, text string, date string, filename string, text_block_id string"
    ).withColumn("date", F.to_timestamp("date"))
    e = frame("line_id string, entity_text string, entity_type string", ("l1", "Kaiser", "person"), ("l2", "Berlin", "location"))
    with QueryEngine(spark, lines=lines, entities={"llm": e, "other": e.where("line_id = 'l1'")}) as q:
        assert q.get_line("l1")["text"] == "Der Kaiser kam" and q.get_line("x") is None
        assert [r.line_id for r in q.search_text("berlin").collect()] == ["l2"]
        assert [r.line_id for r in q.search_text("%", end="1901-01-15").collect()] == ["l1"]
        assert q.find_entity_mentions("Kaiser").first()["confidence"] is None
        assert q.query("SELECT count(*) n FROM lines WHERE text LIKE ?", ["%Kaiser%"]).first()["n"] == 1
        assert q.query("SELECT count(*) n FROM entities_other").first()["n"] == 1
        assert q.compare_entity_methods("llm", "other").first()["method1_entity"] == "Berlin"
        assert q.entity_frequency(min_mentions=1).count() == 2
        assert q.compare("llm", "other")["coverage"].first()["both_methods"] == 1
        with pytest.raises(ValueError):
            q.entities("none")
        with pytest.raises(ValueError, match="group_by"):
            q.entity_frequency("week")
    assert not spark.catalog.tableExists("lines")
    assert loading_status(lines).first()["unique_files"] == 2
    assert file_coverage(lines, lines.limit(1)).first()["percent"] == 200.0


def test_frequency_pushes_its_filter_below_the_join(spark, tmp_path):
    e = spark.createDataFrame([("l1", "A", "person", 0.5)], ENTITY)
    e.write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([("l1", "1901-01-01")], "line_id string, date string").write.parquet(str(tmp_path / "l"))
    plan = entities.entity_frequency(spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "l")), "date", 1, "person")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(entity_type,person)" in plan and "confidence" not in plan.split("ReadSchema")[1]
