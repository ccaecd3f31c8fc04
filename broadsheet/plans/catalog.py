"""The queries by name and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions.cleaning import Cleaner, filter_by_length
from ..operators import blocks, emotions, entities, explore, statistics, topics
from . import derive as V
from .engine import QueryEngine, loading_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def on_lines(name: str, sql: str, *ctes: str):
    return entry(name, V.with_(V.LINES, *ctes) + sql)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents")


A = lambda s, d: V.entities(s, d, "a")
B = lambda s, d: V.entities(s, d, "b")

# -- string functions and cleaning steps ------------------------------------------------------------------------------

W = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def text_step(name: str, column: Callable, sql: str) -> None:
    @entry(name, f"SELECT doc_id, {sql} AS result FROM documents")
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", column(F.col("text")).alias("result"))


text_step("p1_normalize", T.normalize, "replace(replace(replace(replace(text, 'ẞ', 'SS'), 'ß', 'ss'), 'ſs', 'ss'), 'ſ', 's')")
text_step("p2_normalize_whitespace", T.normalize_whitespace, W.format("text"))
text_step("p3_lowercase", T.lowercase, "lower(text)")
text_step("p4_remove_diacritics", T.remove_diacritics, "strip_accents(replace(text, 'ß', 'ss'))")
text_step("p5_remove_punctuation", T.remove_punctuation, W.format(r"regexp_replace(text, '[^a-zA-ZäöüÄÖÜß0-9\s]', '', 'g')"))
text_step("p6_remove_numbers", T.remove_numbers, W.format(r"regexp_replace(text, '\d+', '', 'g')"))
text_step("p9_clean_ocr", T.clean_ocr, W.format(r"regexp_replace(text, '[^a-zA-ZäöüÄÖÜß0-9\s.,;:!?()\-]', '', 'g')"))
text_step("p10_dehyphenate", T.dehyphenate, r"regexp_replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), '-\s{2,}', '', 'g')")
text_step("c1_truncate", lambda c: T.truncate(c, 500), "substr(text, 1, 500)")
text_step("c2_long_s", T.long_s, "replace(text, 'ſ', 's')")
text_step("c3_match_key", T.match_key, "lower(trim(text, ' '))")
text_step("c10_highlight", lambda c: T.highlight(c, "the"), "replace(text, 'the', '**the**')")
text_step("c11_prompt", lambda c: T.prompt("Text:\n{text}\n\nAnswer as JSON.", text=c), "'Text:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Answer as JSON.'")
text_step("h1_sha256", lambda c: F.sha2(c, 256), "sha256(text)")
text_step("h1_md5", F.md5, "md5(text)")


def german_stops() -> str | None:
    """Spark's German stop list as an SQL list, read from its archive; None where that isn't beside the Python package."""
    for jar in Path(pyspark.__file__).parent.glob("jars/spark-mllib_*.jar"):
        with zipfile.ZipFile(jar) as z:
            words = z.read("org/apache/spark/ml/feature/stopwords/german.txt").decode().split()
        return "['" + "','".join(sorted({w.lower() for w in words})) + "']"
    return None


STOPS = german_stops()
TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\s\p{Z}]"


@entry("p7_remove_stopwords", STOPS and f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '{TOKEN}'), lambda w: NOT list_contains({STOPS}, lower(w))), ' ') AS result FROM documents")
def p7(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.remove_stopwords(F.col("text")).alias("result"))


@entry("p7_keyword_tokens", "SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß\\-]{3,}'), lambda x: lower(x)), lambda x: NOT list_contains(['" + "','".join(T.KEYWORD_STOPS) + "'], x)), ' ') AS result FROM documents")
def p7_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.keyword_tokens(F.col("text")), " ").alias("result"))


@entry("p8_filter_length", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 500 AND 5000")
def p8(spark, sf_dir):
    return filter_by_length(docs(spark, sf_dir), least=500, most=5000).select("doc_id", F.length("text").cast("long").alias("n"))


@entry("p_pipeline", "SELECT doc_id, " + W.format(r"regexp_replace(" + W.format(r"regexp_replace(lower(replace(replace(replace(replace(text, 'ẞ', 'SS'), 'ß', 'ss'), 'ſs', 'ss'), 'ſ', 's')), '[^a-zA-ZäöüÄÖÜß0-9\s]', '', 'g')") + r", '\d+', '', 'g')") + " AS text_processed FROM documents WHERE length(text) >= 10")
def p_pipeline(spark, sf_dir):
    return Cleaner().run(docs(spark, sf_dir), ["filter-length", "normalize", "lowercase", "remove-punctuation", "remove-numbers"]).select("doc_id", "text_processed")


@entry("c5_sentence_counts", r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS BIGINT) AS n FROM documents")
def c5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@entry("c6_chunks", r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
c AS (SELECT doc_id, regexp_replace(array_to_string(p[5 * k + 1:5 * k + 5], ' '), '^\s+|\s+$', '', 'g') AS chunk FROM (SELECT doc_id, p, unnest(range(0, (len(p) + 4) // 5)) AS k FROM s))
SELECT doc_id, chunk FROM c WHERE length(chunk) >= 100""")
def c6(spark, sf_dir):
    return blocks.chunks(docs(spark, sf_dir)).select("doc_id", "chunk")


SPLIT = r"""WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
f AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 200) AS a,
list_filter(list_transform(range(0, (len(p) + 4) // 5), lambda k: regexp_replace(array_to_string(p[5 * k + 1:5 * k + 5], ' '), '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 150) AS b FROM s),
d AS (SELECT doc_id, CASE WHEN len(a) < 3 THEN b ELSE a END AS docs FROM f)
"""


@entry("c7_split_into_docs", SPLIT + "SELECT doc_id, CAST(unnest(range(0, len(docs))) AS INT) AS part, unnest(docs) AS doc FROM d")
def c7(spark, sf_dir):
    return blocks.documents(docs(spark, sf_dir)).select("doc_id", "part", "doc")


@entry("c8_snippets", SPLIT + r", i AS (SELECT doc_id, docs, list_filter([CASE WHEN len(docs) > 0 THEN 1 END, CASE WHEN len(docs) > 1 THEN len(docs) // 2 + 1 END, CASE WHEN len(docs) > 2 THEN len(docs) END], lambda x: x IS NOT NULL) AS i FROM d) SELECT doc_id, array_to_string(list_transform(i, lambda k: array_to_string(list_slice(string_split(trim(regexp_replace(docs[k], '\s+', ' ', 'g')), ' '), 1, 64), ' ')), '|') AS snippets FROM i")
def c8(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.snippets(T.split_into_docs(F.col("text"))), "|").alias("snippets"))


@entry("c4_page_text", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(Source:|Date:|Total blocks:|===|--- Block|Position:)')), ' ') AS result FROM documents")
def c4(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.page_text(F.col("text")).alias("result"))


@entry("c9_topic_lines", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^([-*•]+|\d+[.)])\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM documents),
f AS (SELECT doc_id, a, list_filter(a, lambda x: len(regexp_split_to_array(x, '\s+')) BETWEEN 2 AND 8) AS b FROM l)
SELECT doc_id, array_to_string(CASE WHEN len(b) > 0 THEN b[1:10] ELSE a[1:5] END, '|') AS result FROM f""")
def c9(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.topic_lines(F.col("text")), "|").alias("result"))


@entry("a_token_frequency", r"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(string_split(" + W.format("lower(text)") + ", ' '), lambda x: x <> '')) AS token FROM documents) GROUP BY token")
def token_frequency(spark, sf_dir):
    words = F.filter(F.split(T.collapse(F.lower("text")), " "), lambda w: w != "")
    return docs(spark, sf_dir).select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# -- scans, filters, sorts --------------------------------------------------------------------------------------------


@on_lines("s1_lines", "SELECT line_id, text_block_id, y, x, text, lang, source, date, filename FROM lines")
def s1(spark, sf_dir):
    return V.lines(spark, sf_dir)


@on_lines("f1_query_params", "SELECT line_id, text, date FROM lines WHERE text LIKE '%the%' AND year(date) = 1905")
def f1(spark, sf_dir):
    engine = QueryEngine(spark, lines=V.lines(spark, sf_dir))
    return engine.query("SELECT line_id, text, date FROM lines WHERE text LIKE ? AND year(date) = ?", ["%the%", 1905])


@on_lines("f2_get_line", "SELECT line_id, text, date FROM lines WHERE line_id = '7_0'")
def f2(spark, sf_dir):
    row = QueryEngine(spark, lines=V.lines(spark, sf_dir)).get_line("7_0")
    return spark.createDataFrame([tuple(row[c] for c in ("line_id", "text", "date"))] if row else [], "line_id string, text string, date timestamp")


@on_lines("f3_search_text", "SELECT line_id, text, date FROM lines WHERE text ILIKE '%thth%' AND date >= '1902-01-01' AND date <= '1912-12-31' ORDER BY date, line_id LIMIT 100")
def f3(spark, sf_dir):
    return QueryEngine(spark, lines=V.lines(spark, sf_dir)).search_text("thth", "1902-01-01", "1912-12-31").select("line_id", "text", "date")


@on_lines("f4_date_range", "SELECT line_id, date FROM lines WHERE date BETWEEN DATE '1905-03-01' AND DATE '1906-02-28'")
def f4(spark, sf_dir):
    return entities.between(V.lines(spark, sf_dir), "1905-03-01", "1906-02-28").select("line_id", "date")


@on_lines("f6_min_text", "SELECT line_id FROM lines WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50")
def f6(spark, sf_dir):
    return V.lines(spark, sf_dir).where(T.within_length(T.collapse_ends(F.col("text")), 50)).select("line_id")


@on_lines("f7_first_n", "SELECT line_id, text FROM lines ORDER BY line_id LIMIT 50")
def f7(spark, sf_dir):
    return V.lines(spark, sf_dir).orderBy("line_id").limit(50).select("line_id", "text")


@on_lines("f13_valid_dates", "SELECT line_id, try_strptime(d, '%Y-%m-%d') AS date FROM (SELECT line_id, CASE WHEN y % 5 = 0 THEN '1901-02-31' ELSE strftime(date, '%Y-%m-%d') END AS d FROM lines) WHERE try_strptime(d, '%Y-%m-%d') IS NOT NULL")
def f13(spark, sf_dir):
    raw = V.lines(spark, sf_dir).select("line_id", F.when(F.col("y") % 5 == 0, "1901-02-31").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("d"))
    return raw.select("line_id", F.try_to_date("d", "yyyy-MM-dd").cast("timestamp").alias("date")).where("date is not null")


@on_lines("f16_like", "SELECT line_id, entity_text FROM ea WHERE entity_text LIKE '%tion%'", V.ENTITIES_A)
def f16(spark, sf_dir):
    return A(spark, sf_dir).where(F.col("entity_text").like("%tion%")).select("line_id", "entity_text")


@on_lines("f17_year_between", "SELECT CAST(year(date) AS INT) AS year, count(*) AS total_lines, count(DISTINCT date) AS unique_dates FROM lines WHERE year(date) BETWEEN 1900 AND 1905 GROUP BY 1")
def f17(spark, sf_dir):
    return explore.line_counts(V.lines(spark, sf_dir).where(F.year("date").between(1900, 1905)), "year")


@entry("f15_top_topics_only", V.with_(V.TOPIC_LISTS) + ", x AS (SELECT date, trim(unnest(string_split(topics, '|'))) AS topic FROM tl), y AS (SELECT * FROM x WHERE topic <> ''), top AS (SELECT topic FROM y GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 5) SELECT date, topic, count(*) AS count FROM y WHERE topic IN (SELECT topic FROM top) GROUP BY date, topic")
def f15(spark, sf_dir):
    return topics.topic_timeline(V.topic_lists(spark, sf_dir), 5).select("date", "topic", "count")


@entry("w12_page", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 12 OFFSET 24")
def w12(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "source").orderBy("source", "doc_id").offset(24).limit(12)


@entry("t5_natural_order", "SELECT source, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(source, '\\d+') AS INT)) AS INT) AS place FROM (SELECT DISTINCT source FROM documents)")
def t5(spark, sf_dir):
    from pyspark.sql import Window

    return docs(spark, sf_dir).select("source").distinct().withColumn("place", F.row_number().over(Window.orderBy(D.natural_key(F.col("source")))))  # a row per source


# -- joins and comparisons --------------------------------------------------------------------------------------------


@on_lines("j1_entity_mentions", "SELECT entity_text, entity_type, confidence, ea.line_id, text, date, filename, text_block_id FROM ea JOIN lines ON ea.line_id = lines.line_id WHERE entity_text = 'Thereon'", V.ENTITIES_A)
def j1(spark, sf_dir):
    return entities.mentions(A(spark, sf_dir), V.lines(spark, sf_dir), "Thereon").select("entity_text", "entity_type", "confidence", "line_id", "text", "date", "filename", "text_block_id")


@on_lines("j1_frequent_mentions", "SELECT entity_text, entity_type, round(confidence, 9) AS confidence, ea.line_id, date FROM ea JOIN lines ON ea.line_id = lines.line_id WHERE entity_text = 'Tion' AND entity_type = 'location' AND date >= DATE '1901-01-01' AND date <= DATE '1919-12-31'", V.ENTITIES_A)
def j1b(spark, sf_dir):
    return entities.mentions(A(spark, sf_dir), V.lines(spark, sf_dir), "Tion", "location", "1901-01-01", "1919-12-31").select("entity_text", "entity_type", F.round("confidence", 9).alias("confidence"), "line_id", "date")


@on_lines("j2_compare_methods", "SELECT coalesce(ea.line_id, eb.line_id) AS line_id, ea.entity_text AS method1_entity, ea.entity_type AS method1_type, eb.entity_text AS method2_entity, eb.entity_type AS method2_type, text, date FROM ea FULL OUTER JOIN eb ON ea.line_id = eb.line_id AND ea.entity_text = eb.entity_text JOIN lines ON coalesce(ea.line_id, eb.line_id) = lines.line_id WHERE ea.entity_text IS NULL OR eb.entity_text IS NULL", V.ENTITIES_A, V.ENTITIES_B)
def j2(spark, sf_dir):
    return entities.compare_methods(A(spark, sf_dir), B(spark, sf_dir), V.lines(spark, sf_dir))


@on_lines("j3_coverage", """, flags AS (SELECT line_id, line_id IN (SELECT line_id FROM ea) AS a, line_id IN (SELECT line_id FROM eb) AS b FROM (SELECT DISTINCT line_id FROM lines))
SELECT count(*) AS total_lines, count(*) FILTER (a) AS llm_coverage, count(*) FILTER (b) AS gliner_coverage, count(*) FILTER (a AND b) AS both_methods, count(*) FILTER (a AND NOT b) AS llm_only, count(*) FILTER (b AND NOT a) AS gliner_only FROM flags""", V.ENTITIES_A, V.ENTITIES_B)
def j3(spark, sf_dir):
    return entities.coverage(A(spark, sf_dir), B(spark, sf_dir), V.lines(spark, sf_dir))


KEYED = """, l AS (SELECT DISTINCT lower(trim(entity_text)) AS k, entity_type, entity_text AS t FROM ea), g AS (SELECT DISTINCT lower(trim(entity_text)) AS k, entity_type, entity_text AS t FROM eb)
"""


@on_lines("j4_agreement", KEYED + "SELECT l.t AS llm_text, g.t AS gliner_text, l.entity_type, count(*) AS agreement_count FROM l JOIN g ON l.k = g.k AND l.entity_type = g.entity_type GROUP BY ALL ORDER BY agreement_count DESC, llm_text, gliner_text, l.entity_type LIMIT 50", V.ENTITIES_A, V.ENTITIES_B)
def j4(spark, sf_dir):
    return entities.agreement(A(spark, sf_dir), B(spark, sf_dir))


@on_lines("j4_agreement_mentions", """, l AS (SELECT lower(trim(entity_text)) AS k, entity_type, min(entity_text) AS t, count(*) AS n FROM ea GROUP BY ALL), g AS (SELECT lower(trim(entity_text)) AS k, entity_type, min(entity_text) AS t, count(*) AS n FROM eb GROUP BY ALL)
SELECT l.t AS llm_text, g.t AS gliner_text, l.entity_type, least(l.n, g.n) AS agreement_count FROM l JOIN g ON l.k = g.k AND l.entity_type = g.entity_type ORDER BY 4 DESC, 1, 2, 3 LIMIT 50""", V.ENTITIES_A, V.ENTITIES_B)
def j4b(spark, sf_dir):
    return entities.agreement(A(spark, sf_dir), B(spark, sf_dir), by_mentions=True)


ONLY = "SELECT {x}.t AS entity_text, {x}.entity_type, count(*) AS count FROM {x} LEFT JOIN {y} ON {x}.k = {y}.k AND {x}.entity_type = {y}.entity_type WHERE {y}.k IS NULL GROUP BY ALL ORDER BY count DESC, entity_text, {x}.entity_type LIMIT 25"


@on_lines("j5_only_first", KEYED + ONLY.format(x="l", y="g"), V.ENTITIES_A, V.ENTITIES_B)
def j5(spark, sf_dir):
    return entities.only_in(A(spark, sf_dir), B(spark, sf_dir))


@on_lines("j6_only_second", KEYED + ONLY.format(x="g", y="l"), V.ENTITIES_A, V.ENTITIES_B)
def j6(spark, sf_dir):
    return entities.only_in(B(spark, sf_dir), A(spark, sf_dir))


@on_lines("j7_co_occurrence", "SELECT e1.entity_text AS entity1, e2.entity_text AS entity2, count(*) AS co_occurrences FROM eb e1 JOIN eb e2 ON e1.line_id = e2.line_id AND e1.entity_text < e2.entity_text GROUP BY ALL HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 20", V.ENTITIES_B)
def j7(spark, sf_dir):
    return entities.co_occurrence(B(spark, sf_dir), more_than=1)


@on_lines("j21_person_pairs", "SELECT e1.entity_text AS entity1, e2.entity_text AS entity2, count(*) AS co_occurrences FROM ea e1 JOIN ea e2 ON e1.line_id = e2.line_id AND e1.entity_text < e2.entity_text WHERE e1.entity_type = 'person' AND e2.entity_type = 'person' GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 20", V.ENTITIES_A)
def j21(spark, sf_dir):
    return entities.co_occurrence(A(spark, sf_dir), more_than=None, kind="person")


@on_lines("j8_method_counts", """, found AS (SELECT line_id, entity_text, count(*) AS n FROM eb GROUP BY ALL),
named AS (SELECT ea.entity_text, coalesce(n, 0) AS n FROM ea LEFT JOIN found USING (line_id, entity_text) WHERE ea.entity_type = 'person')
SELECT entity_text, CAST(sum(greatest(n, 1)) AS BIGINT) AS gliner_count, CAST(sum(n) AS BIGINT) AS llm_count FROM named GROUP BY entity_text HAVING sum(greatest(n, 1)) > 3""", V.ENTITIES_A, V.ENTITIES_B)
def j8(spark, sf_dir):
    return entities.method_counts(A(spark, sf_dir), B(spark, sf_dir), more_than=3)


@on_lines("j10_resume", "SELECT DISTINCT filename FROM lines WHERE filename NOT IN (SELECT filename FROM lines WHERE lang = 'de' AND y = 3)")
def j10(spark, sf_dir):
    seen = V.lines(spark, sf_dir).where("lang = 'de' and y = 3").select("filename")
    return V.lines(spark, sf_dir).select("filename").distinct().join(seen, "filename", "left_anti")


@on_lines("j16_date_entities", "SELECT date, block, entity, type FROM contains_ JOIN mentioned USING (block) WHERE date BETWEEN DATE '1903-01-01' AND DATE '1908-12-31'", V.ENTITIES_B, V.BLOCKS)
def j16(spark, sf_dir):
    contains, mentioned = V.blocks(spark, sf_dir)
    return explore.date_entities(contains, mentioned, "1903-01-01", "1908-12-31")


@on_lines("j17_graph_cooccurrence", ", m AS (SELECT DISTINCT block, entity FROM mentioned) SELECT a.entity AS entity1, b.entity AS entity2, count(*) AS co_occurrences FROM m a JOIN m b ON a.block = b.block AND a.entity < b.entity GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 100", V.ENTITIES_B, V.BLOCKS)
def j17(spark, sf_dir):
    return explore.graph_cooccurrence(V.blocks(spark, sf_dir)[1])


@on_lines("j19_entity_mentions_view", "SELECT ea.line_id, entity_text, entity_type, round(confidence, 9) AS confidence, text_block_id, date FROM ea JOIN lines ON ea.line_id = lines.line_id", V.ENTITIES_A)
def j19(spark, sf_dir):
    return entities.entity_mentions_view(A(spark, sf_dir), V.lines(spark, sf_dir)).select("line_id", "entity_text", "entity_type", F.round("confidence", 9).alias("confidence"), "text_block_id", "date")


@on_lines("j20_person_lines", "SELECT date, entity_text, entity_type FROM lines JOIN ea USING (line_id) WHERE entity_type = 'person' ORDER BY date, entity_text, line_id LIMIT 10", V.ENTITIES_A)
def j20(spark, sf_dir):
    engine = QueryEngine(spark, lines=V.lines(spark, sf_dir), entities={"patterns": A(spark, sf_dir)})
    return engine.query("SELECT l.date, e.entity_text, e.entity_type FROM lines l JOIN entities e ON l.line_id = e.line_id WHERE e.entity_type = ? ORDER BY l.date, e.entity_text, l.line_id LIMIT 10", ["person"])


# -- aggregations -----------------------------------------------------------------------------------------------------


@on_lines("a1_text_blocks", "SELECT text_block_id, string_agg(text, ' ' ORDER BY y NULLS FIRST, x NULLS FIRST) AS text, CAST(count(*) AS INT) AS line_count, avg(x) AS avg_x, min(x) AS min_x, max(x) AS max_x, avg(y) AS avg_y, min(y) AS min_y, max(y) AS max_y, min(filename) AS filename, min(date) AS date FROM lines GROUP BY text_block_id")
def a1(spark, sf_dir):
    return blocks.text_blocks(V.lines(spark, sf_dir)).select("text_block_id", "text", "line_count", "avg_x", "min_x", "max_x", "avg_y", "min_y", "max_y", "filename", "date")


@on_lines("a34_blocks_by_file", "SELECT filename, text_block_id, string_agg(text, ' ' ORDER BY y, x) AS text, CAST(count(*) AS INT) AS line_count FROM lines GROUP BY ALL")
def a34(spark, sf_dir):
    return blocks.text_blocks(V.lines(spark, sf_dir), ("filename", "text_block_id")).select("filename", "text_block_id", "text", "line_count")


@on_lines("a2_entity_frequency", "SELECT CAST(year(date) AS INT) AS time_period, entity_text, entity_type, count(*) AS mention_count FROM ea JOIN lines USING (line_id) GROUP BY ALL HAVING count(*) >= 5", V.ENTITIES_A)
def a2(spark, sf_dir):
    return entities.entity_frequency(A(spark, sf_dir), V.lines(spark, sf_dir))


@on_lines("a2_entity_frequency_month", "SELECT CAST(date_trunc('month', date) AS TIMESTAMP) AS time_period, entity_text, entity_type, count(*) AS mention_count FROM ea JOIN lines USING (line_id) WHERE entity_type = 'person' GROUP BY ALL HAVING count(*) >= 3", V.ENTITIES_A)
def a2m(spark, sf_dir):
    return entities.entity_frequency(A(spark, sf_dir), V.lines(spark, sf_dir), "month", 3, "person")


@on_lines("a2_entity_frequency_date", "SELECT date AS time_period, entity_text, entity_type, count(*) AS mention_count FROM ea JOIN lines USING (line_id) GROUP BY ALL HAVING count(*) >= 2", V.ENTITIES_A)
def a2d(spark, sf_dir):
    return entities.entity_frequency(A(spark, sf_dir), V.lines(spark, sf_dir), "date", 2)


@on_lines("a3_topic_distribution", "SELECT CAST(year(date) AS INT) AS time_period, primary_topic, count(*) AS count FROM topics JOIN lines USING (line_id) GROUP BY ALL", V.TOPICS)
def a3(spark, sf_dir):
    return entities.topic_distribution(V.topics(spark, sf_dir), V.lines(spark, sf_dir))


@on_lines("a4_method_statistics", "SELECT 'LLM' AS method, count(*) AS total_entities, count(DISTINCT entity_text) AS unique_entities, count(DISTINCT line_id) AS lines_with_entities FROM ea UNION ALL SELECT 'GLiNER', count(*), count(DISTINCT entity_text), count(DISTINCT line_id) FROM eb", V.ENTITIES_A, V.ENTITIES_B)
def a4(spark, sf_dir):
    return entities.method_statistics({"LLM": A(spark, sf_dir), "GLiNER": B(spark, sf_dir)})


@on_lines("a5_type_distribution", "SELECT 'LLM' AS method, entity_type, count(*) AS count FROM ea GROUP BY ALL UNION ALL SELECT 'GLiNER', entity_type, count(*) FROM eb GROUP BY ALL", V.ENTITIES_A, V.ENTITIES_B)
def a5(spark, sf_dir):
    return entities.type_distribution({"LLM": A(spark, sf_dir), "GLiNER": B(spark, sf_dir)})


@on_lines("a6_top_persons", "SELECT entity_text, count(*) AS mentions, round(avg(confidence), 9) AS avg_confidence, CAST(max(confidence) AS DOUBLE) AS max_confidence FROM ea WHERE entity_type = 'person' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", V.ENTITIES_A)
def a6(spark, sf_dir):
    return entities.top_entities(A(spark, sf_dir), "person")


@on_lines("a6_top_locations", "SELECT entity_text, count(*) AS mentions, round(avg(confidence), 9) AS avg_confidence, CAST(max(confidence) AS DOUBLE) AS max_confidence FROM ea WHERE entity_type = 'location' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", V.ENTITIES_A)
def a6b(spark, sf_dir):
    return entities.top_entities(A(spark, sf_dir), "location")


@on_lines("a7_first_last", "SELECT entity_text, entity_type, min(date) AS first_mention, max(date) AS last_mention, count(*) AS total_mentions FROM ea JOIN lines USING (line_id) GROUP BY ALL HAVING count(*) > 10", V.ENTITIES_A)
def a7(spark, sf_dir):
    return entities.first_last_mention(A(spark, sf_dir), V.lines(spark, sf_dir), 10)


@on_lines("a8_monthly_lines", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS line_count, count(DISTINCT text_block_id) AS block_count FROM lines GROUP BY 1")
def a8(spark, sf_dir):
    return explore.line_counts(V.lines(spark, sf_dir), "month")


@on_lines("a9_yearly_lines", "SELECT CAST(year(date) AS INT) AS year, count(*) AS total_lines, count(DISTINCT date) AS unique_dates FROM lines GROUP BY 1")
def a9(spark, sf_dir):
    return explore.line_counts(V.lines(spark, sf_dir), "year")


@on_lines("a10_yearly_entities", "SELECT CAST(year(date) AS INT) AS year, entity_type, count(DISTINCT entity_text) AS unique_entities, count(*) AS total_mentions FROM lines JOIN ea USING (line_id) GROUP BY ALL", V.ENTITIES_A)
def a10(spark, sf_dir):
    return entities.yearly_entities(A(spark, sf_dir), V.lines(spark, sf_dir))


@on_lines("a11_entity_summary", "SELECT entity_type, count(*) AS total, count(DISTINCT entity_text) AS unique_entities, round(avg(confidence), 9) AS mean_confidence, CAST(min(confidence) AS DOUBLE) AS min_confidence, CAST(max(confidence) AS DOUBLE) AS max_confidence FROM ea GROUP BY ROLLUP (entity_type)", V.ENTITIES_A)
def a11(spark, sf_dir):
    return entities.entity_summary(A(spark, sf_dir))


@on_lines("a12_loading_status", "SELECT count(*) AS total_lines, count(DISTINCT filename) AS unique_files, min(date) AS min_date, max(date) AS max_date FROM lines")
def a12(spark, sf_dir):
    return loading_status(V.lines(spark, sf_dir))


@on_lines("a14_grouped_entities", "SELECT line_id, entity_type, array_to_string(list_sort(list(DISTINCT lower(entity_text))), ',') AS texts FROM ea GROUP BY ALL", V.ENTITIES_A)
def a14(spark, sf_dir):
    rows = entities.grouped_entities(A(spark, sf_dir)).select("line_id", F.explode("entities").alias("entity_type", "t"))
    return rows.where(F.size("t") > 0).select("line_id", "entity_type", F.array_join("t", ",").alias("texts"))


@on_lines("a15_entities_by_date", "SELECT date, entity_type, count(*) AS count FROM ea JOIN lines USING (line_id) GROUP BY ALL", V.ENTITIES_A)
def a15(spark, sf_dir):
    return A(spark, sf_dir).join(V.lines(spark, sf_dir), "line_id").groupBy("date", "entity_type").agg(F.count(F.lit(1)).alias("count"))


@on_lines("a16_value_counts", "SELECT entity_text, count(*) AS count FROM ea GROUP BY 1", V.ENTITIES_A)
def a16(spark, sf_dir):
    return entities.value_counts(A(spark, sf_dir), "entity_text")


@on_lines("a18_entity_timeline", "SELECT date, count(*) AS count FROM ea JOIN lines USING (line_id) WHERE lower(entity_text) = 'tion' GROUP BY 1", V.ENTITIES_A)
def a18(spark, sf_dir):
    return entities.timeline(A(spark, sf_dir).join(V.lines(spark, sf_dir), "line_id"), "entity_text", "Tion")


@on_lines("a18_graph_timeline", "SELECT date, count(*) AS count FROM contains_ JOIN mentioned USING (block) WHERE entity = 'Thereon' GROUP BY 1", V.ENTITIES_B, V.BLOCKS)
def a18b(spark, sf_dir):
    return explore.entity_timeline(*V.blocks(spark, sf_dir), "Thereon")


@on_lines("a19_concept_network", "SELECT date, entity AS concept, type, count(*) AS count FROM contains_ JOIN mentioned USING (block) GROUP BY ALL", V.ENTITIES_B, V.BLOCKS)
def a19(spark, sf_dir):
    contains, mentioned = V.blocks(spark, sf_dir)
    return explore.concept_network(contains.join(mentioned, "block").withColumnRenamed("entity", "concept"))


@entry("a21_topic_counts", V.with_(V.TOPIC_LISTS) + "SELECT date, topic, count(*) AS count FROM (SELECT date, trim(unnest(string_split(topics, '|'))) AS topic FROM tl) WHERE topic <> '' GROUP BY ALL")
def a21(spark, sf_dir):
    return topics.topic_counts(V.topic_lists(spark, sf_dir))


@entry("a21_topic_counts_blank", V.with_(V.TOPIC_LISTS) + "SELECT date, topic, count(*) AS count FROM (SELECT date, trim(unnest(string_split(topics, '|'))) AS topic FROM tl) GROUP BY ALL")
def a21b(spark, sf_dir):
    return topics.topic_counts(V.topic_lists(spark, sf_dir), keep_blank=True)


@entry("a22_topic_totals", V.with_(V.TOPIC_LISTS) + "SELECT topic, total, CAST(row_number() OVER (ORDER BY total DESC, topic) - 1 AS INT) AS place FROM (SELECT topic, count(*) AS total FROM (SELECT trim(unnest(string_split(topics, '|'))) AS topic FROM tl) WHERE topic <> '' GROUP BY 1 HAVING count(*) >= 3)")
def a22(spark, sf_dir):
    return topics.topic_order(topics.topic_totals(V.topic_lists(spark, sf_dir), 3))


EMO = V.with_(V.EMOTIONS)
NAMES = ("Joy", "Love", "Fear", "Anger", "Sadness")


@entry("emotion_means", EMO + "SELECT id, round(mean_Joy, 9) AS mean_Joy, round(mean_Love, 9) AS mean_Love, round(mean_Fear, 9) AS mean_Fear, round(mean_Anger, 9) AS mean_Anger, round(mean_Sadness, 9) AS mean_Sadness, year, era1, era2 FROM em")
def emotion_means(spark, sf_dir):
    em = V.emotions(spark, sf_dir)
    return em.select(*(F.round(c, 9).alias(c) if c.startswith("mean_") else c for c in em.columns))


@entry("a17_emotions_by_date", EMO + "SELECT id, round(avg(mean_Joy), 9) AS mean_Joy, round(avg(mean_Fear), 9) AS mean_Fear FROM em GROUP BY id")
def a17(spark, sf_dir):
    return emotions.by_date(V.emotions(spark, sf_dir).withColumn("date", F.col("id")), ["mean_Joy", "mean_Fear"]).withColumnRenamed("date", "id")


@entry("a23_emotion_shares", V.with_(V.EMOTIONS, V.LONG) + ", m AS (SELECT emotion, avg(value) AS mean FROM em_long GROUP BY 1) SELECT emotion, round(mean, 6) AS mean, round(CASE WHEN sum(mean) OVER () > 0 THEN mean / sum(mean) OVER () ELSE 0 END, 6) AS share FROM m")
def a23(spark, sf_dir):
    return emotions.shares(V.emotions(spark, sf_dir), 6)


@entry("a24_yearly_emotions", EMO + "SELECT year, " + ", ".join(f"round(avg(coalesce(mean_{e}, 0)), 6) AS mean_{e}" for e in NAMES) + " FROM em GROUP BY year")
def a24(spark, sf_dir):
    return emotions.yearly(V.emotions(spark, sf_dir), 6)


@entry("a25_monthly_emotions", EMO + "SELECT CAST(substr(id, 3, 4) AS INT) AS year, CAST(substr(id, 8, 2) AS INT) AS month, " + ", ".join(f"round(avg(coalesce(mean_{e}, 0)), 6) AS mean_{e}" for e in NAMES) + " FROM em GROUP BY 1, 2")
def a25(spark, sf_dir):
    return emotions.monthly(V.emotions(spark, sf_dir), 6)


TOTAL = " + ".join(f"sum(coalesce(mean_{e}, 0))" for e in NAMES)


@entry("a26_period_shares", EMO + "SELECT substr(id, 3, 7) AS period, " + ", ".join(f"round(CASE WHEN {TOTAL} > 0 THEN sum(coalesce(mean_{e}, 0)) / ({TOTAL}) ELSE 0 END, 6) AS share_{e}" for e in NAMES) + " FROM em GROUP BY 1")
def a26(spark, sf_dir):
    return emotions.period_shares(V.emotions(spark, sf_dir), digits=6)


@entry("a27_era_summary", V.with_(V.EMOTIONS, V.LONG) + "SELECT era1, emotion, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM em_long GROUP BY 1, 2")
def a27(spark, sf_dir):
    return statistics.summary(statistics.unpivoted(V.emotions(spark, sf_dir)), digits=6)


@entry("a28_box_plot", V.with_(V.EMOTIONS, V.LONG) + "SELECT emotion, era1, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(min(value), 6) AS low, round(max(value), 6) AS high, count(value) AS n FROM em_long GROUP BY 1, 2")
def a28(spark, sf_dir):
    return statistics.quantiles(statistics.unpivoted(V.emotions(spark, sf_dir)), digits=6)


KEYWORDS = "SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß\\-]{3,}'), lambda x: lower(x)) AS w FROM documents"


@entry("a32_keywords", "WITH k AS (" + KEYWORDS + "), t AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM k), c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM t WHERE word NOT IN ('" + "','".join(T.KEYWORD_STOPS) + "') GROUP BY 1, 2), r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INT) AS rank, word, n FROM c) SELECT * FROM r WHERE rank <= 12")
def a32(spark, sf_dir):
    return topics.keywords(docs(spark, sf_dir), "doc_id")


@entry("x8_ngram_keywords", "WITH k AS (SELECT doc_id, list_filter(w, lambda x: NOT list_contains(['" + "','".join(T.KEYWORD_STOPS) + "'], x)) AS w FROM (" + KEYWORDS + ")), t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM k WHERE len(w) > 0), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS INT) AS rank, term, n FROM c) SELECT * FROM r WHERE rank <= 5")
def x8(spark, sf_dir):
    return topics.ngram_keywords(docs(spark, sf_dir), "doc_id")


# -- statistics -------------------------------------------------------------------------------------------------------

LONG_ = V.with_(V.EMOTIONS, V.LONG)


@entry("w1_average_rank", LONG_ + "SELECT id, emotion, rank() OVER (PARTITION BY emotion ORDER BY value) + (count(*) OVER (PARTITION BY emotion, value) - 1) / 2 AS avg_rank FROM em_long")
def w1(spark, sf_dir):
    return statistics.average_rank(statistics.unpivoted(V.emotions(spark, sf_dir)).where("value is not null")).select("id", "emotion", "avg_rank")


U = """, d AS (SELECT * FROM em_long WHERE era2 IN ('pre', 'post')), r AS (SELECT emotion, era2, rank() OVER (PARTITION BY emotion ORDER BY value) + (count(*) OVER (PARTITION BY emotion, value) - 1) / 2 AS k FROM d)
SELECT emotion, count(*) FILTER (era2 = 'pre') AS n1, count(*) FILTER (era2 = 'post') AS n2,
round(sum(k) FILTER (era2 = 'pre') - count(*) FILTER (era2 = 'pre') * (count(*) FILTER (era2 = 'pre') + 1) / 2, 6) AS u1,
round(2 * (sum(k) FILTER (era2 = 'pre') - count(*) FILTER (era2 = 'pre') * (count(*) FILTER (era2 = 'pre') + 1) / 2) / (count(*) FILTER (era2 = 'pre') * count(*) FILTER (era2 = 'post')) - 1, 6) AS cliffs_delta FROM r GROUP BY emotion"""


@entry("w2_mann_whitney_u", LONG_ + U)
def w2(spark, sf_dir):
    rows = statistics.mann_whitney(statistics.unpivoted(V.emotions(spark, sf_dir)), "era2", "pre", "post", with_p=False)
    return rows.select("emotion", "n1", "n2", F.round("u1", 6).alias("u1"), F.round("cliffs_delta", 6).alias("cliffs_delta"))


BEST = """, pairs AS (SELECT * FROM (VALUES (0, 'pre war', 'war'), (1, 'pre war', 'post war'), (2, 'war', 'post war')) v(pair, one, two)),
r AS (SELECT pair, one, two, emotion, era1 = one AS a, rank() OVER w + (count(*) OVER (PARTITION BY pair, emotion, value) - 1) / 2 AS k, count(*) OVER (PARTITION BY pair, emotion, value) AS t
  FROM em_long JOIN pairs ON era1 IN (one, two) WINDOW w AS (PARTITION BY pair, emotion ORDER BY value)),
s AS (SELECT pair, one, two, emotion, CAST(count(*) FILTER (a) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS n2, sum(k) FILTER (a) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY ALL),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS v FROM s WHERE n1 > 0 AND n2 > 0),
x AS (SELECT *, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(greatest(v, 1e-12)) / sqrt(2) AS x FROM u),
p AS (SELECT pair, one, two, emotion, u AS u1, 2 * u / (n1 * n2) - 1 AS d, CASE
  WHEN x < 2.5 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 61), lambda i: (-1) ** i * x ** (2 * i + 1) / (gamma(i + 1) * (2 * i + 1))))
  ELSE exp(-x * x) / sqrt(pi()) / list_reduce(list_prepend(x, list_transform(range(60, 0, -1), lambda i: i / 2)), lambda f, h: x + h / f) END AS p FROM x
  UNION ALL SELECT pair, one, two, emotion, 0, 0, 1 FROM s WHERE n1 = 0 OR n2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY p, pair) AS place FROM p)
SELECT emotion, CASE WHEN p < 1 THEN one END AS first, CASE WHEN p < 1 THEN two END AS second, round(u1, 6) AS u1, round(p, 9) AS p, round(d, 6) AS cliffs_delta,
round(-log10(greatest(least(p, 1), 1e-300)), 6) AS nlog10_p FROM b WHERE place = 1"""


@entry("w4_best_era_pair", LONG_ + BEST)
def w4(spark, sf_dir):
    pairs = (("pre war", "war"), ("pre war", "post war"), ("war", "post war"))
    best = statistics.best_pair(statistics.unpivoted(V.emotions(spark, sf_dir)), pairs)
    digits = {"u1": 6, "p": 9, "cliffs_delta": 6, "nlog10_p": 6}
    return best.withColumns({c: F.round(c, n) for c, n in digits.items()})


SCORES = """, q AS (SELECT emotion, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM em_long GROUP BY 1),
m AS (SELECT emotion, quantile_cont(abs(value - med), 0.5) * 1.4826 AS mad FROM em_long JOIN q USING (emotion) GROUP BY 1),
z AS (SELECT id, emotion, value, CASE WHEN mad = 0 THEN 0 ELSE (value - med) / mad END AS z, CAST(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS INT) AS iqr_outlier FROM em_long JOIN q USING (emotion) JOIN m USING (emotion))
"""


@entry("w6_outlier_scores", LONG_ + SCORES + "SELECT id, emotion, round(z, 6) AS z_mad, iqr_outlier, abs(z) >= 3 OR iqr_outlier = 1 AS highlight FROM z")
def w6(spark, sf_dir):
    rows = statistics.highlighted(statistics.outlier_scores(statistics.unpivoted(V.emotions(spark, sf_dir))))
    return rows.select("id", "emotion", F.round("z_mad", 6).alias("z_mad"), "iqr_outlier", "highlight")


@entry("w9_outlier_report", LONG_ + SCORES + "SELECT emotion, rank, id, printf('%.6f', value) AS value, printf('%.3f', z) AS z_mad, iqr_outlier FROM (SELECT *, CAST(row_number() OVER (PARTITION BY emotion ORDER BY abs(z) DESC, id) AS INT) AS rank FROM z) WHERE rank <= 10")
def w9(spark, sf_dir):
    return statistics.outlier_report(V.emotions(spark, sf_dir)).select("emotion", "rank", "id", "value", "z_mad", "iqr_outlier")


@entry("f18_peaks", LONG_ + SCORES + "SELECT rank, id, abs_z FROM (SELECT id, round(abs(z), 3) AS abs_z, CAST(row_number() OVER (ORDER BY abs(z) DESC, id) AS INT) AS rank FROM z WHERE emotion = 'Joy') WHERE rank <= 10")
def f18(spark, sf_dir):
    return statistics.peaks(statistics.outlier_report(V.emotions(spark, sf_dir)), "Joy").select("rank", "id", F.round("abs_z", 3).alias("abs_z"))


# -- dates, rows from rows, JSON, set operations ----------------------------------------------------------------------


@on_lines("g1_sentences", ", s AS (SELECT text_block_id, line_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM lines), f AS (SELECT line_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM s) SELECT line_id, unnest(p) AS sentence, CAST(unnest(range(0, len(p))) AS INT) AS sentence_id, CAST(len(p) AS INT) AS sentence_count FROM f")
def g1(spark, sf_dir):
    return blocks.sentences(V.lines(spark, sf_dir)).select("line_id", "sentence", "sentence_id", "sentence_count")


@on_lines("g2_entities", "SELECT line_id, entity_text, entity_type, CAST(confidence AS DOUBLE) AS confidence FROM ea", V.ENTITIES_A)
def g2(spark, sf_dir):
    return A(spark, sf_dir)


@entry("g5_unpivot", LONG_ + "SELECT id, emotion, round(value, 9) AS value FROM em_long")
def g5(spark, sf_dir):
    return statistics.unpivoted(V.emotions(spark, sf_dir)).where("value is not null").select("id", "emotion", F.round("value", 9).alias("value"))


@entry("g3_response_entities", "SELECT CAST(doc_id AS VARCHAR) AS line_id, source AS entity_text, 'person' AS entity_type FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, 'location' FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, 'location' FROM documents WHERE doc_id % 2 = 0")
def g3(spark, sf_dir):
    answer = F.when(F.col("doc_id") % 2 == 0, F.format_string('{"persons":["%s"],"locations":["%s","%s"],"organizations":null}', "source", "lang", "lang")).otherwise(F.format_string('{"persons":["%s"],"locations":["%s"]}', "source", "lang"))
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("line_id"), answer.alias("response"))
    return entities.response_entities(rows).select("line_id", "entity_text", "entity_type")


@entry("n1_json_field", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def n1(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@on_lines("d_dates", "SELECT line_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day, strftime(date, '%Y-%m') AS period, CAST(date_trunc('month', date) AS TIMESTAMP) AS first FROM lines")
def d_dates(spark, sf_dir):
    return V.lines(spark, sf_dir).select("line_id", F.year("date").alias("year"), F.month("date").alias("month"), F.day("date").alias("day"), F.date_format("date", "yyyy-MM").alias("period"), F.date_trunc("month", "date").alias("first"))


@entry("d4_make_date", "SELECT event_id, CAST(make_date(CAST(year(ts) AS BIGINT), CAST(month(ts) AS BIGINT), 1) AS TIMESTAMP) AS date FROM events")
def d4(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", D.from_parts(F.year("ts").cast("string"), F.month("ts").cast("string"), F.lit("1")).cast("timestamp").alias("date"))


@entry("d9_date_parts_of_id", EMO + "SELECT id, regexp_extract(id, '\\d{4}-\\d{2}-\\d{2}') AS date, CAST(substr(id, 3, 4) AS INT) AS year, CAST(substr(id, 8, 2) AS INT) AS month, CAST(substr(id, 11, 2) AS INT) AS day FROM em")
def d9(spark, sf_dir):
    i = F.col("id")
    return V.emotions(spark, sf_dir).select("id", D.date_in(i).alias("date"), D.year_in(i).alias("year"), D.month_in(i).alias("month"), D.day_in(i).alias("day"))


@entry("s15_tolerant_float", "SELECT event_id, coalesce(TRY_CAST(replace(trim(v), ',', '.') AS DOUBLE), 0) AS value FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL WHEN 2 THEN ' 1,5 ' ELSE '2.25' END AS v FROM events)")
def s15(spark, sf_dir):
    v = F.when(F.col("event_id") % 4 == 0, "n/a").when(F.col("event_id") % 4 == 2, " 1,5 ").when(F.col("event_id") % 4 == 3, "2.25")
    return V.table(spark, sf_dir, "events").select("event_id", D.tolerant_double(v).alias("value"))


@on_lines("s6_file_names", "SELECT line_id, '3074409X' AS newspaper_id, CAST(date AS TIMESTAMP) AS date, 415 AS issue_number, 2 AS daily_issue_number, 9 AS page_number, strftime(date, '%Y-%m-%d') || '_415_H_2_009' AS page_id FROM lines WHERE y > 0 UNION ALL SELECT line_id, NULL, NULL, NULL, NULL, NULL, 'scan' FROM lines WHERE y = 0")
def s6(spark, sf_dir):
    name = F.when(F.col("y") > 0, F.concat(F.lit("3074409X_"), F.date_format("date", "yyyy-MM-dd"), F.lit("_000_415_H_2_009.xml"))).otherwise(F.lit("scan.xml"))
    rows = V.lines(spark, sf_dir).select("line_id", name.alias("filename")).withColumn("n", D.alto_name(F.col("filename")))
    return rows.select("line_id", "n.*", D.page_id(F.col("filename"), F.col("n.date"), F.col("n.issue_number"), F.col("n.daily_issue_number"), F.col("n.page_number")).alias("page_id"))


@on_lines("s8_locate_mets", "SELECT line_id, '/d/' || strftime(date, '%Y/%m/%d') || '/01/N_1.xml' AS mets FROM lines WHERE y > 0 UNION ALL SELECT line_id, NULL FROM lines WHERE y = 0")
def s8(spark, sf_dir):
    path = F.when(F.col("y") > 0, F.concat(F.lit("/d/"), F.date_format("date", "yyyy/MM/dd"), F.lit("/01/fulltext/N_1_007.xml"))).otherwise(F.lit("/d/other/N_1_007.xml"))
    return V.lines(spark, sf_dir).select("line_id", D.mets_path(path).alias("mets"))


@entry("u1_union_all", "SELECT source AS name FROM documents UNION ALL SELECT lang FROM documents")
def u1(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select(F.col("source").alias("name")).unionByName(d.select(F.col("lang").alias("name")))


@entry("u3_distinct", "SELECT DISTINCT source, lang FROM documents")
def u3(spark, sf_dir):
    return docs(spark, sf_dir).select("source", "lang").distinct()


@entry("u4_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").distinct().join(V.table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@on_lines("r3_label_map", "SELECT entity_type AS label, CASE entity_type WHEN 'Person' THEN 'person' ELSE lower(entity_type) END AS type, count(*) AS n FROM ea GROUP BY ALL", V.ENTITIES_A)
def r3(spark, sf_dir):
    return A(spark, sf_dir).groupBy(F.col("entity_type").alias("label"), entities.entity_type(F.col("entity_type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@entry("a20_detection_stats", "SELECT doc_id AS image_file, 3 AS total, true AS has_pictures, 1 AS text_regions, CAST(0.5 AS DOUBLE) AS avg_confidence FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, false, 1, CAST(0.25 AS DOUBLE) FROM documents WHERE doc_id % 2 = 1")
def a20(spark, sf_dir):
    kind = "array<struct<class:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text_content:string>>"
    one = lambda c, p: f"named_struct('class', '{c}', 'confidence', {p}D, 'bbox', named_struct('x1', 0D, 'y1', 0D, 'x2', 1D, 'y2', 1D), 'text_content', 't')"
    made = F.expr(f"CASE WHEN doc_id % 2 = 0 THEN array({one('Picture', 0.75)}, {one('Text', 0.25)}, {one('Title', 0.5)}) ELSE array({one('Text', 0.25)}) END").cast(kind)
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("image_file"), F.lit(None).cast("int").alias("total_detections"), F.lit(None).cast("struct<by_class:map<string,int>>").alias("summary"), made.alias("detections"))
    return explore.detection_stats(rows).drop("by_class")


# -- exploration: captions, layouts, files ----------------------------------------------------------------------------

P = V.with_(V.PAIRS)


@entry("s3_path_scan", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def s3(spark, sf_dir):
    return spark.sql(f"SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM parquet.`{sf_dir}/documents.parquet` GROUP BY lang")


@entry("f8_with_caption", P + "SELECT fulltext_basename FROM pairs WHERE trim(coalesce(caption, '')) <> ''")
def f8(spark, sf_dir):
    return explore.with_caption(V.pairs(spark, sf_dir)).select("fulltext_basename")


@entry("f8_without_caption", P + "SELECT fulltext_basename FROM pairs WHERE trim(coalesce(caption, '')) = ''")
def f8b(spark, sf_dir):
    return explore.with_caption(V.pairs(spark, sf_dir), False).select("fulltext_basename")


@entry("f9_confident", P + "SELECT fulltext_basename FROM pairs WHERE coalesce(confidence, 0) >= 0.5")
def f9(spark, sf_dir):
    return explore.confident(V.pairs(spark, sf_dir), 0.5).select("fulltext_basename")


@entry("f10_caption_search", P + "SELECT fulltext_basename, date, replace(caption, 'the', '**the**') AS marked FROM pairs WHERE contains(lower(caption), 'the') ORDER BY date DESC NULLS LAST, fulltext_basename LIMIT 50")
def f10(spark, sf_dir):
    return explore.caption_search(V.pairs(spark, sf_dir), "the").select("fulltext_basename", F.col("date").cast("timestamp").alias("date"), "marked")


@entry("t4_gallery", P + "SELECT fulltext_basename FROM pairs ORDER BY date NULLS FIRST, fulltext_basename LIMIT 12 OFFSET 12")
def t4(spark, sf_dir):
    return explore.gallery(V.pairs(spark, sf_dir), "date", False, 2).select("fulltext_basename")


@entry("t4_gallery_by_confidence", P + "SELECT fulltext_basename FROM pairs ORDER BY coalesce(confidence, 0) DESC, fulltext_basename LIMIT 12")
def t4b(spark, sf_dir):
    return explore.gallery(V.pairs(spark, sf_dir), "confidence").select("fulltext_basename")


@entry("a31_caption_coverage", P + "SELECT count(*) AS total, count(*) FILTER (trim(coalesce(caption, '')) <> '') AS with_caption, round(count(*) FILTER (trim(coalesce(caption, '')) <> '') * 100.0::DOUBLE / count(*), 6) AS percent FROM pairs")
def a31(spark, sf_dir):
    return explore.caption_coverage(V.pairs(spark, sf_dir))


@entry("a31_match_rate", P + "SELECT source, count(*) AS total, count(*) FILTER (confidence >= 0.5) AS matched, round(count(*) FILTER (confidence >= 0.5) * 100.0::DOUBLE / count(*), 6) AS percent FROM pairs GROUP BY source")
def a31b(spark, sf_dir):
    return explore.match_rate(V.pairs(spark, sf_dir), F.col("picture.confidence") >= 0.5, "source")


@entry("m2_picture_area", P + "SELECT fulltext_basename, area FROM pairs")
def m2(spark, sf_dir):
    return explore.picture_area(V.pairs(spark, sf_dir)).select("fulltext_basename", "area")


@entry("j13_caption_entities", V.with_(V.LINES, V.ENTITIES_B, V.NER, V.PAIRS) + """, names AS (SELECT entity, lower(entity) AS k, count(*) AS n FROM ner GROUP BY ALL)
SELECT fulltext_basename, entity, CAST(sum(n) AS BIGINT) AS n FROM (SELECT fulltext_basename, lower(caption) AS c FROM pairs WHERE caption <> '') JOIN names ON contains(c, k) GROUP BY ALL""")
def j13(spark, sf_dir):
    return explore.caption_entity_counts(V.pairs(spark, sf_dir), V.ner(spark, sf_dir))


@entry("j14_region_text", "SELECT 'a/p' || doc_id || '.jpg' AS image_file, CASE WHEN coalesce(text, '') = '' THEN '' WHEN doc_id % 2 = 0 THEN text || chr(10) || chr(10) || text ELSE text END AS text FROM documents")
def j14(spark, sf_dir):
    return explore.region_text(V.layouts(spark, sf_dir), 4, 2, 12, 3)


@entry("f11_selected_classes", "SELECT 'a/p' || doc_id || '.jpg' AS image_file, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM documents")
def f11(spark, sf_dir):
    return explore.selected_classes(V.layouts(spark, sf_dir), ["Text", "Title"]).select("image_file", F.size("detections").alias("n"))


@entry("j15_multimodal_index", V.with_(V.LINES, V.ENTITIES_B, V.NER, V.PAIRS) + """, pages AS (SELECT doc_id, 'p' || doc_id AS page_id, CASE WHEN doc_id % 4 > 0 THEN strftime(DATE '1900-01-01' + CAST(doc_id * 37 % 7670 AS INT), '%Y-%m-%d') END AS date FROM documents),
felt AS (SELECT 'p' || text_block_id AS page_id, CASE WHEN y % 3 = 0 THEN lang ELSE substr(text, 1, 1) END AS emotion, y % 4 / 4.0 AS confidence FROM lines WHERE lang <> 'de'),
often AS (SELECT page_id, emotion, count(*) AS n FROM felt GROUP BY ALL), mood AS (SELECT page_id, emotion FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, emotion) AS r FROM often) WHERE r = 1),
score AS (SELECT page_id, avg(confidence) AS s FROM felt GROUP BY 1), named AS (SELECT date, entity, count(*) AS n FROM ner GROUP BY ALL),
top AS (SELECT date, entity FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, entity) AS r FROM named) WHERE r = 1), total AS (SELECT date, CAST(sum(n) AS BIGINT) AS n FROM named GROUP BY 1),
pictures AS (SELECT DISTINCT source_image FROM pairs WHERE source_image IS NOT NULL), seen AS (SELECT DISTINCT page_id FROM pages JOIN pictures ON contains(source_image, page_id))
SELECT page_id, pages.date, 'a/' || page_id || '.jpg' AS image_file, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE CAST(doc_id % 5 AS INT) END AS total_detections, seen.page_id IS NOT NULL AS has_picture, coalesce(mood.emotion, 'unknown') AS dominant_emotion,
round(coalesce(s, 0), 9) AS emotion_score, coalesce(total.n, 0) AS entity_count, top.entity AS top_entity
FROM pages LEFT JOIN mood USING (page_id) LEFT JOIN score USING (page_id) LEFT JOIN total ON total.date = pages.date LEFT JOIN top ON top.date = pages.date LEFT JOIN seen USING (page_id)""")
def j15(spark, sf_dir):
    rows = V.lines(spark, sf_dir).where("lang <> 'de'")
    felt = rows.select(F.concat(F.lit("p"), "text_block_id").alias("page_id"), F.when(F.col("y") % 3 == 0, F.col("lang")).otherwise(F.substring("text", 1, 1)).alias("emotion"), (F.col("y") % 4 / 4.0).alias("confidence"))
    number = F.regexp_extract("image_file", r"(\d+)", 1).cast("int")
    pages = V.layouts(spark, sf_dir).withColumn("date", F.when(number % 4 > 0, F.col("date"))).withColumn("total_detections", F.when(number % 5 > 0, number % 5))
    return explore.multimodal_index(pages, felt, V.ner(spark, sf_dir), V.pairs(spark, sf_dir)).withColumn("emotion_score", F.round("emotion_score", 9))


@on_lines("f12_type_ignoring_case", "SELECT line_id, entity_text FROM ea WHERE lower(entity_type) = lower('PERSON')", V.ENTITIES_A)
def f12(spark, sf_dir):
    return A(spark, sf_dir).where(F.lower("entity_type") == "PERSON".lower()).select("line_id", "entity_text")


@on_lines("a15_dated_counts", "SELECT date, type, count(*) AS count FROM (SELECT try_strptime(CASE WHEN length(entity_text) % 5 = 0 THEN 'unknown' ELSE strftime(date, '%Y-%m-%d') END, '%Y-%m-%d') AS date, entity_type AS type FROM eb JOIN lines USING (line_id)) WHERE date IS NOT NULL GROUP BY ALL", V.ENTITIES_B)
def a15b(spark, sf_dir):
    rows = V.ner(spark, sf_dir).select(F.when(F.length("entity") % 5 == 0, "unknown").otherwise(F.col("date")).alias("Date"), F.col("type").alias("Type"))
    return explore.entity_counts(rows).select(F.col("date").cast("timestamp").alias("date"), F.col("Type").alias("type"), "count")


@on_lines("k6_date_graph", "SELECT DISTINCT strftime(date, '%Y-%m-%d') AS source, entity_text AS target, 1 AS weight FROM eb JOIN lines USING (line_id)", V.ENTITIES_B)
def k6(spark, sf_dir):
    return explore.date_graph(V.ner(spark, sf_dir))


@on_lines("k7_issue_export", """, b AS (SELECT strftime(date, '%Y-%m') AS uid, CAST(text_block_id AS BIGINT) AS page, string_agg(text, chr(10) || chr(10) ORDER BY y) AS t FROM lines GROUP BY ALL)
SELECT uid, string_agg('=== PAGE ' || page || ' ===' || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY page) AS value FROM b GROUP BY uid""")
def k7(spark, sf_dir):
    rows = V.lines(spark, sf_dir).select(F.date_format("date", "yyyy-MM").alias("uid"), F.col("text_block_id").cast("long").alias("page"), F.col("y").alias("block_order"), "text")
    return blocks.issue_export(rows)


@on_lines("c10_issue_texts", ", b AS (SELECT strftime(date, '%Y-%m') AS issue, lang AS date, CAST(text_block_id AS BIGINT) AS page, string_agg(text, ' ' ORDER BY y) AS t FROM lines GROUP BY ALL) SELECT date, issue, string_agg(t, ' ' ORDER BY page) AS text, count(*) AS num_pages FROM b WHERE length(t) >= 100 GROUP BY ALL")
def c10(spark, sf_dir):
    page = V.lines(spark, sf_dir).groupBy(F.date_format("date", "yyyy-MM").alias("issue"), F.col("lang").alias("date"), F.col("text_block_id").cast("long").alias("page")).agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY y)").alias("text"))
    return blocks.issue_texts(page)


@on_lines("j9_metadata_join", ", m AS (SELECT source, count(*) AS page_count FROM documents GROUP BY source) SELECT line_id, page_count FROM lines LEFT JOIN m ON m.source = lines.source AND m.source <> 'src3'")
def j9(spark, sf_dir):
    issues = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("page_count")).where("source <> 'src3'")
    return V.lines(spark, sf_dir).join(issues, "source", "left").select("line_id", "page_count")


@on_lines("j11_empty_files", "SELECT DISTINCT source || '.xml' AS filename FROM documents WHERE source || '.xml' NOT IN (SELECT filename FROM lines WHERE y > 60)")
def j11(spark, sf_dir):
    from ..sources.xml import empty_files

    return empty_files(docs(spark, sf_dir).select(F.concat("source", F.lit(".xml")).alias("filename")).distinct(), V.lines(spark, sf_dir).where("y > 60"))


@entry("j12_completeness", """WITH e AS (SELECT '/d/' || source || '.xml' AS path, doc_id % 3 = 0 AS i, doc_id % 2 = 0 AND doc_id % 10 > 0 AS a, doc_id % 10 > 0 AS named FROM documents)
SELECT path, count(*) AS expected, count(*) FILTER (i) AS images_found, count(*) FILTER (a) AS alto_found, CAST(count(*) FILTER (named AND NOT a) AS INT) AS missing_alto, CAST(count(*) FILTER (NOT i) AS INT) AS missing_images FROM e GROUP BY path""")
def j12(spark, sf_dir):
    from ..sources.xml import completeness

    d = docs(spark, sf_dir)
    number = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    made = d.select(F.concat(F.lit("/d/"), "source", F.lit(".xml")).alias("path"), F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("X"), F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij"))).otherwise(F.concat(F.lit("F"), number)).alias("file_id"), F.lit("image/jpeg").alias("mimetype"), "doc_id", "source")
    present = made.where("doc_id % 3 = 0").select(F.concat(F.lit("/d/"), "file_id", F.lit(".jpg")).alias("path"))
    pages = made.where("doc_id % 2 = 0 and doc_id % 10 > 0").select(F.format_string("/d/fulltext/%s_%03d.xml", "source", "doc_id").alias("path"))
    out = completeness(made.select("path", "file_id", "mimetype"), present.unionByName(pages))
    return out.withColumn("missing_alto", F.size("missing_alto")).withColumn("missing_images", F.size("missing_images"))


@on_lines("a13_file_coverage", "SELECT count(DISTINCT filename) FILTER (y > 60) AS loaded, count(DISTINCT filename) AS files, count(DISTINCT filename) FILTER (y > 60) * 100.0::DOUBLE / count(DISTINCT filename) AS percent FROM lines")
def a13(spark, sf_dir):
    from .engine import file_coverage

    rows = V.lines(spark, sf_dir)
    return file_coverage(rows.where("y > 60"), rows)


@entry("a29_image_coverage", "SELECT count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS downloaded, count(*) FILTER (doc_id % 3 > 0) AS missing, count(*) FILTER (doc_id % 3 = 0) * 100.0::DOUBLE / count(*) AS percent FROM documents")
def a29(spark, sf_dir):
    from ..sources.images import coverage

    target = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("/i/"), F.col("doc_id").cast("string")).alias("target"))
    return coverage(target.select("target"), target.where("doc_id % 3 = 0").select(F.col("target").alias("path")))


@entry("c14_topic_label", "SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS label FROM documents")
def c14(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.topic_label(F.split("text", " ")).alias("label"))


@entry("c15_image_target", "SELECT doc_id, '/img/1901/' || source || '/F' || doc_id || '.jpg' AS target FROM documents")
def c15(spark, sf_dir):
    from ..sources.xml import image_targets

    rows = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("/raw/x/1901/"), "source", F.lit("/m.xml")).alias("path"), F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("file_id"), F.lit(".jpg").alias("extension"))
    return image_targets(rows, "/img", "/raw/x").select("doc_id", "target")


@entry("u2_append", "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, CAST(quality AS VARCHAR) FROM labels")
def u2(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang").unionByName(V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("lang")))


@on_lines("t3_top_entities", "SELECT entity_text, count(*) AS count FROM ea GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", V.ENTITIES_A)
def t3(spark, sf_dir):
    return entities.value_counts(A(spark, sf_dir), "entity_text").limit(20)


@on_lines("a30_validation_summary", "SELECT count(*) AS total, count(*) FILTER (length(text) >= 50) AS valid, count(*) FILTER (length(text) < 50) AS invalid FROM lines")
def a30(spark, sf_dir):
    from ..sources.images import validation_summary

    return validation_summary(V.lines(spark, sf_dir).select((F.length("text") >= 50).alias("is_valid")))


# -- parsers of pages and issues, readers and writers of files ----------------------------------------------------------

NAMED = """, p AS (SELECT lines.*, CAST(text_block_id AS BIGINT) AS doc, strftime(date, '%Y-%m-%d') AS d FROM lines),
q AS (SELECT *, '3074409X_' || d || '_000_' || (doc + 1) || '_H_1_00' || (doc % 7 + 1) || '.xml' AS file, d || '_' || lpad(CAST(doc + 1 AS VARCHAR), CAST(greatest(3, length(CAST(doc + 1 AS VARCHAR))) AS INT), '0') || '_H_1_00' || (doc % 7 + 1) AS page FROM p)
"""


@on_lines("s5_page_lines", NAMED + r"SELECT file || '_b_l' || y AS line_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, page || '_b' AS text_block_id, page AS page_id, date, x, y, CAST(doc + 1 AS INT) AS issue_number, CASE WHEN doc % 2 = 0 THEN CAST(doc % 9 AS INT) END AS page_count, CASE WHEN doc % 2 = 0 THEN source END AS newspaper_title FROM q")
def s5(spark, sf_dir):
    from ..sources import xml

    rows = xml.with_metadata(xml.raw_lines(V.page_files(spark, sf_dir).select("path", "content")), xml.scan_issues(V.issue_files(spark, sf_dir).select("path", "content")))
    return rows.select("line_id", "text", "text_block_id", "page_id", "date", "x", "y", "issue_number", "page_count", "newspaper_title")


ISSUE = "SELECT doc_id, strftime(DATE '1900-01-01' + CAST(doc_id * 37 % 7670 AS INT), '%Y-%m-%d') AS d, source FROM documents WHERE doc_id % 2 = 0"


@entry("s7_issue_metadata", f"SELECT '3074409X_' || d || '_000_' || (doc_id + 1) || '_H_1.xml' AS filename, CAST(d AS TIMESTAMP) AS date, CAST(doc_id AS INT) AS issue_number, CAST(doc_id % 9 AS INT) AS page_count, source AS newspaper_title FROM ({ISSUE})")
def s7(spark, sf_dir):
    from ..sources import xml

    return xml.scan_issues(V.issue_files(spark, sf_dir).select("path", "content")).select("filename", "date", "issue_number", "page_count", "newspaper_title")


@entry("s9_issue_pictures", f"SELECT 'F' || i AS file_id, 'http://h/' || doc_id || CASE i WHEN 1 THEN '_1.jpg?x=1' ELSE '_2' END AS url, CASE i WHEN 1 THEN 'image/jpeg' ELSE 'image/tiff' END AS mimetype, '.jpg' AS extension FROM ({ISSUE}), (VALUES (1), (2)) v(i)")
def s9(spark, sf_dir):
    from ..sources import xml

    return xml.scan_images(V.issue_files(spark, sf_dir).select("path", "content")).drop("path")


@on_lines("s26_page_blocks", r""", b AS (SELECT date, string_agg(regexp_replace(text, '[\t\r]', ' ', 'g'), chr(10) ORDER BY y) AS t FROM lines GROUP BY date, text_block_id)
SELECT strftime(date, '%Y-%m-%d') || '-i01' AS uid, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM b""")
def s26(spark, sf_dir):
    from ..sources import xml

    return xml.scan_blocks(V.page_files(spark, sf_dir).select("path", "content")).select("uid", "text")


def shared(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, or, in local mode alone, below a temporary one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not (spark.conf.get("spark.master", None) or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.gettempdir() + '/broadsheet').rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@entry("k1_parquet_by_language", "SELECT doc_id, lang, source FROM documents WHERE lang = 'de'")
def k1(spark, sf_dir):
    from ..sources import tables

    path = shared(spark, "k1")
    tables.write_parquet(docs(spark, sf_dir).select("doc_id", "lang", "source"), path, ("lang",), ("doc_id",))
    return tables.partitioned(spark, path).where("lang = 'de'").select("doc_id", "lang", "source")


@entry("k4_s14_csv_round_trip", "SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def k4(spark, sf_dir):
    from ..sources import tables

    path = shared(spark, "k4")
    rows = docs(spark, sf_dir).where("text <> ''").select("text", "source", "doc_id")
    rows.write.option("escape", '"').csv(path, header=True)
    return tables.union_csv(spark, path, "doc_id bigint, source string, text string")  # by the header's names


@on_lines("k3_s13_grouped_json", "SELECT line_id, entity_type, array_to_string(list_sort(list(DISTINCT lower(entity_text))), ',') AS texts FROM ea GROUP BY ALL", V.ENTITIES_A)
def k3(spark, sf_dir):
    from ..sources import tables

    path = shared(spark, "k3")
    tables.write_grouped_json(A(spark, sf_dir), path)
    rows = spark.read.schema("line_id string, entities map<string,array<string>>").json(path).select("line_id", F.explode("entities").alias("entity_type", "t"))
    return rows.where(F.size("t") > 0).select("line_id", "entity_type", F.array_join("t", ",").alias("texts"))


@entry("k2_stored_result", "SELECT 'labels' AS analysis_type, 'rules' AS method_type, count(*) AS line_count FROM labels")
def k2(spark, sf_dir):
    from ..sources import tables

    path = shared(spark, "k2")
    tables.write_result(V.table(spark, sf_dir, "labels"), path, "labels", "rules", "v1", "test")
    return spark.read.schema("analysis_type string, method_type string, line_count long").json(f"{path}/metadata").select("analysis_type", "method_type", "line_count")


@on_lines("j18_methods_side_by_side", ", a AS (SELECT DISTINCT line_id FROM ea), b AS (SELECT DISTINCT line_id FROM eb) SELECT (SELECT count(*) FROM a JOIN b USING (line_id)) AS both_methods, (SELECT count(*) FROM a ANTI JOIN b USING (line_id)) AS first_only, (SELECT count(*) FROM ea) AS n_first, (SELECT count(*) FROM eb) AS n_second", V.ENTITIES_A, V.ENTITIES_B)
def j18(spark, sf_dir):
    engine = QueryEngine(spark, lines=V.lines(spark, sf_dir), entities={"a": A(spark, sf_dir), "b": B(spark, sf_dir)})
    both = engine.compare("a", "b")
    counts = both["statistics"].groupBy().pivot("method", ["a", "b"]).agg(F.first("total_entities"))
    one = both["coverage"].select(F.lit(1).alias("k"), "both_methods", F.col("llm_only").alias("first_only"))
    return one.join(counts.select(F.lit(1).alias("k"), F.col("a").alias("n_first"), F.col("b").alias("n_second")), "k").drop("k")  # one row each


@on_lines("k8_file_report", "SELECT DISTINCT filename AS value FROM lines")
def k8(spark, sf_dir):
    from ..sources import tables

    path = shared(spark, "k8")
    tables.write_report(V.lines(spark, sf_dir).select("filename").distinct(), path, "filename")
    return spark.read.text(path)
