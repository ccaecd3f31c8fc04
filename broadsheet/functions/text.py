"""Text cleaning as Column functions: each takes and returns a column, so a chain of them is one projection.

White space and digits are those of Unicode ((?U) in the patterns).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where sentences end, the characters that OCR cleaning keeps, heading lines of exported pages, keywords.
SENTENCE_END = r"(?<=[.!?])\s+"
OCR_KEPT = r"a-zA-ZäöüÄÖÜß0-9\s.,;:!?()\-"
PAGE_HEADING = r"^(?:Source:|Date:|Total blocks:|===|--- Block|Position:)"
KEYWORD = r"[A-Za-zÄÖÜäöüß\-]{3,}"

# A small German and English stop list for keywords.
KEYWORD_STOPS = (
    "der die das ein eine eines einer einem einen und oder aber denn sondern zu zum zur von vom vor nach über unter mit ohne für auf aus bei "
    "durch gegen ist sind war waren wird werden sein haben hatte hatten hat in im ins am an als auch noch nur schon sehr mehr weniger ich du er "
    "sie es wir ihr sie the a an and or but for of on in at by from to into over under with without"
).split()

# Letters that a decomposition leaves as they are, and their plain spellings.
PLAIN_LETTERS = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ſ": "s", "ı": "i"}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once per row even where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def normalize(c: Column) -> Column:
    """Historical spelling: capital and small sharp s and long s."""
    for old, new in (("ẞ", "SS"), ("ß", "ss"), ("ſs", "ss"), ("ſ", "s")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def long_s(c: Column) -> Column:
    return F.translate(c, "ſ", "s")


def normalize_whitespace(c: Column) -> Column:
    return collapse(c)


def lowercase(c: Column) -> Column:
    return F.lower(c)


def remove_diacritics(c: Column) -> Column:
    """Plain letters for accented Latin ones; null gives the empty text."""
    import unicodedata

    # composed letters of the Latin blocks whose decomposition is one letter and marks: a rule instead of a table
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain != chr(code):
            pairs[chr(code)] = plain
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{Mn}+", "")
    for old, new in PLAIN_LETTERS.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.translate(c, "".join(pairs), "".join(pairs.values()))


def remove_punctuation(c: Column, keep: str = "") -> Column:
    import re

    kept = "".join(re.sub(r"([\\\]\[^&-])", r"\\\1", x) for x in keep)
    return collapse(F.regexp_replace(c, rf"(?U)[^a-zA-ZäöüÄÖÜß0-9\s{kept}]", ""))


def remove_numbers(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"(?U)\d+", ""))


def clean_ocr(c: Column, allowed: str = OCR_KEPT, replace_with: str = "") -> Column:
    """Only characters of the class ``allowed`` (brackets around it may stand) stay."""
    inner = allowed[1:-1] if allowed.startswith("[") and allowed.endswith("]") else allowed
    return collapse(F.regexp_replace(c, f"(?U)[^{inner}]", replace_with.replace("\\", r"\\").replace("$", r"\$")))


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)-\s*\n\s*", ""), r"(?U)-\s{2,}", "")


def tokens(c: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(c, F.lit(r"((?U)\w+|[^\w\s])"), F.lit(1))


def stop_words(language: str) -> list[str]:
    """Spark's own stop list of a language (de, en)."""
    from pyspark.ml.feature import StopWordsRemover

    names = {"de": "german", "en": "english"}
    if language not in names:
        raise ValueError(f"no stop list for language {language!r}; there are: {', '.join(sorted(names))}")
    return [w.lower() for w in StopWordsRemover.loadDefaultStopWords(names[language])]


def remove_stopwords(c: Column, language: str = "de", extra: tuple[str, ...] = ()) -> Column:
    stops = sorted({*stop_words(language), *extra})
    return F.array_join(F.filter(tokens(c), lambda w: ~F.lower(w).isin(stops)), " ")


def within_length(c: Column, least: int = 10, most: int | None = None) -> Column:
    """Number of characters within bounds; false for null."""
    n = F.length(c)
    fits = n >= least if most is None else n.between(least, most)
    return F.coalesce(fits, F.lit(False))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def match_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def sentences(c: Column) -> Column:
    """Stripped sentences that aren't blank."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), collapse_ends), lambda s: s != "")


def collapse_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sentence_windows(c: Column, size: int = 5, least: int = 150) -> Column:
    """Windows of ``size`` sentences, joined, of at least so many characters."""

    def windows(parts):
        starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(size))
        pieces = F.transform(starts, lambda i: collapse_ends(F.array_join(F.slice(parts, i + 1, size), " ")))
        return F.filter(pieces, lambda p: F.length(p) >= least)

    return let(F.split(c, SENTENCE_END), windows)


def split_into_docs(c: Column, enough: int = 3) -> Column:
    """Pages, or else paragraphs, of 200 characters and more; sentence windows if there are fewer than ``enough``."""
    chunks = F.when(F.contains(c, F.lit("=== PAGE")), F.split(c, r"(?m)^=== PAGE .*?===$")).otherwise(F.split(c, r"\n\s*\n"))
    docs = F.filter(F.transform(chunks, collapse), lambda d: F.length(d) >= 200)
    return let(docs, lambda d: F.when(F.size(d) < enough, sentence_windows(c)).otherwise(d))


def snippets(docs: Column, n: int = 3, words: int = 64) -> Column:
    """First, middle and last document, cut to so many words."""

    def chosen(d):
        size = F.size(d)
        places = F.array_compact(F.array(F.when(size > 0, F.lit(0)), F.when(size > 1, F.floor(size / 2).cast("int")), F.when(size > 2, size - 1)))
        return F.transform(F.slice(places, 1, n), lambda i: F.array_join(F.slice(F.split(collapse(F.get(d, i)), " "), 1, words), " "))

    return let(docs, chosen)


def page_text(c: Column) -> Column:
    """Exported page text without its heading lines, in one line."""
    lines = F.transform(F.split(c, "\n"), collapse_ends)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_HEADING)), " ")


def topic_lines(c: Column, most: int = 10) -> Column:
    """Topics from an answer of one per line: no bullets or numbers, two to eight words; else its first five lines."""
    bare = F.transform(F.split(c, "\n"), lambda x: collapse_ends(F.regexp_replace(collapse_ends(x), r"^(?:[-*•]+|\d+[.)])\s*", "")))
    lines = F.filter(bare, lambda x: x != "")

    def chosen(own):
        fine = F.filter(own, lambda x: F.size(F.split(x, r"\s+")).between(2, 8))
        return let(fine, lambda f: F.when(F.size(f) > 0, F.slice(f, 1, most)).otherwise(F.slice(own, 1, 5)))

    return let(lines, chosen)


def topic_label(words: Column, k: int = 2) -> Column:
    return F.array_join(F.slice(words, 1, k), " ")


def keyword_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"({KEYWORD})"), F.lit(1)), F.lower), lambda w: ~w.isin(KEYWORD_STOPS))


def highlight(c: Column, query: str, before: str = "**", after: str = "**") -> Column:
    return F.replace(c, F.lit(query), F.lit(f"{before}{query}{after}"))


def prompt(template: str, **columns: Column) -> Column:
    """``template`` with {names} filled from columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(columns[p].cast("string"), F.lit("")) for i, p in enumerate(parts)))
