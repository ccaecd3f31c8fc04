import pytest
from pyspark.sql import functions as F

from broadsheet.functions import dates as D
from broadsheet.functions import text as T
from broadsheet.functions.cleaning import Cleaner, filter_by_length


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "function,given,wanted",
    [
        (T.normalize, "Daſs wir ẞußen, paſſen, Waſſer ſs", "Dass wir SSussen, passen, Wasser ss"),
        (T.normalize_whitespace, "  a \t\n b c  ", "a b c"),
        (T.lowercase, "ÄÖÜ ẞ", "äöü ß"),
        (T.remove_diacritics, "Café ñandú Straße Łódź œuvre", "Cafe nandu Strasse Lodz oeuvre"),
        (T.remove_punctuation, "Was? Ja, «é» 12-3.", "Was Ja 123"),
        (T.remove_numbers, "am 12. Mai 1901 ٣", "am . Mai"),
        (T.clean_ocr, "a§b ©c; d", "ab c; d"),
        (T.dehyphenate, "Zei-\n tung und-  so", "Zeitung undso"),
        (T.long_s, "ſie", "sie"),
        (T.match_key, "  Berlin ", "berlin"),
        (T.page_text, "Source: x\nDate: y\n=== PAGE 1 ===\n a \n\n--- Block 1\nPosition: 2\nb", "a b"),
    ],
)
def test_steps(spark, function, given, wanted):
    assert value(spark, function(F.lit(given))) == wanted


def test_null_and_empty(spark):
    assert value(spark, T.remove_diacritics(F.lit(None).cast("string"))) == ""
    assert value(spark, T.normalize_whitespace(F.lit("   "))) == ""
    assert value(spark, T.within_length(F.lit(None).cast("string"))) is False
    for f in (T.normalize, T.lowercase, T.remove_punctuation, T.clean_ocr, T.dehyphenate):
        assert value(spark, f(F.lit(None).cast("string"))) is None


def test_whitespace_is_idempotent(spark):
    once = T.normalize_whitespace(F.lit(" a \n\n b  c "))
    assert value(spark, once) == value(spark, T.normalize_whitespace(once))


def test_keep_and_replace(spark):
    assert value(spark, T.remove_punctuation(F.lit("a-b]c^d"), keep="-]")) == "a-b]cd"
    assert value(spark, T.clean_ocr(F.lit("a§b"), "[a-z]", "$")) == "a$b"


def test_stopwords(spark):
    assert value(spark, T.remove_stopwords(F.lit("Der Hund und die Katze"))) == "Hund Katze"
    assert value(spark, T.remove_stopwords(F.lit("the dog and a cat"), "en")) == "dog cat"
    with pytest.raises(ValueError, match="de, en"):
        T.remove_stopwords(F.lit("x"), "fr")


def test_cleaner(spark, frame):
    df = frame("id long, text string", (1, "Daſs 12 Tage!"), (2, "kurz"), (3, None))
    out = Cleaner().run(df, ["filter-length", "normalize", "lowercase", "remove-numbers", "remove-punctuation"])
    assert [(r.id, r.text_processed) for r in out.collect()] == [(1, "dass tage")]
    assert out.columns == ["id", "text", "text_processed"]
    # a filter in the last place keeps the column as it is
    assert Cleaner().run(df, ["lowercase", "filter-length"], "t").first()["t"] == "daſs 12 tage!"
    with pytest.raises(ValueError, match="unknown step"):
        Cleaner().run(df, ["no-such-step"])


def test_cleaner_is_one_projection(spark, frame):
    df = frame("id long, text string", (1, "x"))
    plan = Cleaner().run(df, ["normalize", "lowercase", "remove-numbers"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") == 1 and "Python" not in plan


def test_model_steps(spark, frame):
    df = frame("id long, text string", (1, "a b"), (2, "a b"), (3, None))
    with pytest.raises(ValueError, match="register"):
        Cleaner().run(df, ["lemmatize"])
    out = Cleaner().register("lemmatize", lambda texts: [t.upper() for t in texts]).run(df, ["lowercase", "lemmatize"], "t")
    assert sorted((r.id, r.t) for r in out.collect()) == [(1, "A B"), (2, "A B"), (3, None)]

    def broken(texts):
        raise OSError("no service")

    out = Cleaner().register("normalize-dtacab", broken).run(df, ["normalize-dtacab"], "t")
    assert sorted((r.id, r.t) for r in out.collect()) == [(1, "a b"), (2, "a b"), (3, None)]


def test_filter_by_length(spark, frame):
    df = frame("id long, text string", (1, "x" * 9), (2, "x" * 10), (3, "é" * 20), (4, None))
    assert [r.id for r in filter_by_length(df).collect()] == [2, 3]
    assert [r.id for r in filter_by_length(df, most=10).collect()] == [2]
    assert filter_by_length(df.limit(0)).count() == 0


def test_sentences_and_chunks(spark):
    assert value(spark, T.sentences(F.lit("Eins. Zwei!  Drei? "))) == ["Eins.", "Zwei!", "Drei?"]
    text = " ".join(f"Satz {i} hat einige Worte mehr als sonst." for i in range(7))
    chunks = value(spark, T.sentence_windows(F.lit(text), 5, 50))
    assert len(chunks) == 2 and chunks[0].startswith("Satz 0") and chunks[1].startswith("Satz 5")


def test_split_into_docs(spark):
    page = "Wort " * 50
    text = "=== PAGE 1 ===\n" + "\n=== PAGE 2 ===\n".join([page] * 1) + f"\n=== PAGE 2 ===\n{page}\n=== PAGE 3 ===\n{page}"
    assert [len(d) for d in value(spark, T.split_into_docs(F.lit(text)))] == [249, 249, 249]
    short = "Ein Satz der lang genug ist um etwas zu sagen und noch mehr. " * 5
    assert len(value(spark, T.split_into_docs(F.lit(short)))) == 1


def test_snippets_and_topic_lines(spark):
    docs = F.array(*(F.lit(f"doc{i} " + "w " * 100) for i in range(5)))
    out = value(spark, T.snippets(docs))
    assert [x.split()[0] for x in out] == ["doc0", "doc2", "doc4"] and all(len(x.split()) == 64 for x in out)
    assert value(spark, T.snippets(F.array().cast("array<string>"))) == []
    assert value(spark, T.topic_lines(F.lit("1. War and peace\n- New trade law\nx\n"))) == ["War and peace", "New trade law"]
    assert value(spark, T.topic_lines(F.lit("one\ntwo"))) == ["one", "two"]
    assert value(spark, T.topic_label(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a b"


def test_file_names(spark, frame):
    df = frame("f string", ("3074409X_1901-02-15_000_415_H_2_009.xml",), ("3074409X_1901-02-31_000_415_H_2_009.xml",), ("invalid.xml",), ("3074409X_1901-02-15_000_0_H_2_009.xml",))
    f = F.col("f")
    n = D.alto_name(f)
    rows = df.select(n.alias("n"), D.page_id(f, n["date"], n["issue_number"], n["daily_issue_number"], n["page_number"]).alias("p")).collect()
    assert (rows[0].n.newspaper_id, str(rows[0].n.date), rows[0].n.issue_number, rows[0].n.daily_issue_number, rows[0].n.page_number) == ("3074409X", "1901-02-15 00:00:00", 415, 2, 9)
    assert rows[0].p == "1901-02-15_415_H_2_009"
    assert rows[1].n.date is None and rows[1].n.issue_number == 415 and rows[1].p == "3074409X_1901-02-31_000_415_H_2_009"
    assert tuple(rows[2].n) == (None,) * 5 and rows[2].p == "invalid"
    assert rows[3].p == "3074409X_1901-02-15_000_0_H_2_009"


def test_dates(spark):
    assert value(spark, D.mets_path(F.lit("/a/1901/02/15/01/fulltext/N_415_009.xml"))) == "/a/1901/02/15/01/N_415.xml"
    assert value(spark, D.mets_path(F.lit("/a/other/N_415_009.xml"))) is None
    assert tuple(value(spark, D.fulltext_issue(F.lit("/x/1901/02/15/01/fulltext/a.xml")))) == ("1901", "02", "15", "01", "1901-02-15-i01")
    assert value(spark, D.fulltext_issue(F.lit("/x/fulltext"))) is None
    assert [value(spark, D.tolerant_double(F.lit(x))) for x in ("1,5", " 2.5 ", "x", "")] == [1.5, 2.5, 0.0, 0.0]
    assert value(spark, D.tolerant_double(F.lit(None).cast("string"))) == 0.0
    assert value(spark, D.path_date(F.lit("1901/02/15/01/x"))) == "1901-02-15"
    assert str(value(spark, D.basename_date(F.lit("N_1901-02-15_x")))) == "1901-02-15"
    assert value(spark, D.basename_date(F.lit("N"))) is None
    assert sorted(["p10", "p9", "p1"], key=lambda x: value(spark, D.natural_key(F.lit(x)))) == ["p1", "p9", "p10"]


def test_prompt(spark):
    assert value(spark, T.prompt("A {x} b {y}", x=F.lit("1"), y=F.lit(None))) == "A 1 b "
