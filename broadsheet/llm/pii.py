"""Personal data by aggregated weak supervision; DataFrame functions only.

Candidates are spans of four kinds.  *Base* spans follow the fixed patterns below, found from left to right without
overlaps per kind, and are always kept.  *Weak* spans are looser: written-out e-mail addresses, telephone numbers
without country code, card-like groups that fail their check digit; those that meet a base span are left out.

Four labelers vote +1, -1 or 0 on each candidate: the strict pattern, a gazetteer (domain endings, country and area
codes, card issuers, public address ranges), words in the context before it, and its borders.  The votes are counted per
pattern over the whole corpus; expectation-maximisation (Dawid and Skene, per kind) on these counts, of which there are
at most 4 x 3^4, estimates the labelers' reliabilities and each pattern's probability.  A logistic classifier of votes,
kind, length and digits is trained on the so labelled counts; it is a sum of weights in the final plan and decides about
the weak spans.

Positions are code points, ends exclusive.  Defined cases: null and empty texts have no spans; all kinds of one text are
independent of each other, so spans may overlap; a text of any length is searched as a whole; repeated rows get equal results; without any candidate nothing is
learned and nothing found; other columns are ignored or, in ``redact``, kept.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import stored
from .decontaminate import with_text

KINDS = ("email", "ip", "card", "phone")

# The patterns of base spans.  Possessive repeats and the look-behind keep them linear; they match what
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+){3}, [0-9]([ -]?[0-9])+ and
# \+[0-9][ ().0-9-]+[0-9] match from left to right.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WEAK = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9\x20-])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
TRIGGER = {"email": "@", "ip": ".", "phone": "+"}
CARD = r"[0-9](?:[\x20-]?[0-9]){13}"  # every valid card has it
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|biz|int|mil|de|fr|es|uk|it|nl|at|ch|us|ca|eu|io|pl|se|pt|br|mx|ar|jp|cn|in|au|ru)$",
    "ip": r"^(?!0*(?:0|10|127|22[4-9]|2[34][0-9]|25[0-5])\.)(?!0*192\.0*168\.)(?!0*169\.0*254\.)(?!0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.)",
    "card": r"^[\x20-]?(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|69|80|85|88|96|97|99)|\(?[2-9][0-9]{2})",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|reach|schreib|correo|courriel)\W*\w*\W*$",
    "ip": r"(?i)(?:\bip\b|host|server|addr|client|from|login|ping)\W*\w*\W*$",
    "card": r"(?i)(?:card|credit|visa|master|amex|debit|karte|carte|tarjeta|pay)\W*\w*\W*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|anruf|appel|llam)\W*\w*\W*$",
}
AGAINST = r"(?i)(?:version|isbn|issn|build|order|invoice|article|release|chapter|section|\bv|\bid|\bno)\W*$"
CANDIDATE = "struct<s:int,k:int,e:int,base:boolean,v:string,size:int,digits:int>"
EMPTY = f"cast(array() as array<{CANDIDATE}>)"


def located(text: Column, pattern: str, trigger: Column) -> Column:
    """All matches as (s, e, t, before, after): text and the characters around them."""
    kind = "struct<p:int,a:array<struct<s:int,e:int,t:string,before:string,after:string>>>"

    def places(x):
        def add(acc, i):
            gap, match = F.get(x["g"], i), F.get(x["m"], i)
            s = acc["p"] + F.length(gap)
            e = s + F.length(match)
            row = F.struct(s.alias("s"), e.alias("e"), match.alias("t"), F.right(gap, F.lit(32)).alias("before"), F.left(F.get(x["g"], i + 1), F.lit(1)).alias("after"))
            return F.struct(e.alias("p"), F.concat(acc["a"], F.array(row)).alias("a")).cast(kind)

        zero = F.struct(F.lit(0).alias("p"), F.expr("array()").alias("a")).cast(kind)
        return F.when(F.size(x["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), zero, add)["a"])

    both = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.coalesce(F.when(trigger, let(both, places)), F.expr("cast(array() as array<struct<s:int,e:int,t:string,before:string,after:string>>)"))


def only_digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    def digit(d, i):
        n = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    return let(F.reverse(only_digits(t)), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + digit(d, i)) % 10 == 0)


def valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return t.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(only_digits(t)).between(14, 19), luhn(t)).otherwise(False)
    if kind == "phone":
        return F.length(only_digits(t)).between(10, 15)
    return F.lit(True)


def votes(kind: str, x: Column, base: bool) -> Column:
    """The labelers' votes as a string of + - 0."""
    strict = F.lit("+" if base else "-")
    gazetteer = F.when(x["t"].rlike(GAZETTEER[kind]), "+").otherwise("-")
    context = F.when(x["before"].rlike(CONTEXT[kind]), "+").when(x["before"].rlike(AGAINST), "-").otherwise("0")
    border = F.when(x["before"].rlike(r"[\p{L}\p{N}_]$") | x["after"].rlike(r"^[\p{L}\p{N}_]"), "-").otherwise("+")
    return F.concat(strict, gazetteer, context, border)


def candidate(kind: str, x: Column, base: bool) -> Column:
    return F.struct(
        x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(base).alias("base"), votes(kind, x, base).alias("v"),
        F.least(F.lit(7), F.floor((x["e"] - x["s"]) / 5)).cast("int").alias("size"), F.least(F.lit(7), F.floor(F.length(only_digits(x["t"])) / 3)).cast("int").alias("digits"),
    ).cast(CANDIDATE)


def found(text: Column, kind: str, base: bool) -> Column:
    if base:
        trigger = F.contains(text, F.lit(TRIGGER[kind])) if kind in TRIGGER else text.rlike(CARD)
    else:
        trigger = text.rlike(r"[\[(]at[\])]" if kind == "email" else "[0-9]{3}")
    spans = located(text, (BASE if base else WEAK)[kind], trigger)
    if base and kind != "email":
        spans = F.filter(spans, lambda x: valid(kind, x["t"]))
    return F.transform(spans, lambda x: candidate(kind, x, base))


def candidates(text: Column) -> Column:
    """All base spans and the weak ones that meet none of them, in order."""
    text = F.coalesce(text, F.lit(""))

    def both(base):
        weak = F.concat(*(found(text, k, False) for k in WEAK))
        free = F.filter(weak, lambda w: ~F.exists(base, lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
        return F.sort_array(F.concat(base, free))

    return let(F.concat(*(found(text, k, True) for k in KINDS)), both)


# -- learning, on counts of vote patterns -----------------------------------------------------------------------------


def reliabilities(counts: dict[tuple, float], rounds: int = 30) -> dict[tuple, float]:
    """Probability that a span is personal data, per (kind, votes), by EM on the counts of these patterns."""
    out: dict[tuple, float] = {}
    for kind in {k for k, _ in counts}:
        rows = [(v, n) for (k, v), n in counts.items() if k == kind]
        belief = {v: min(0.95, max(0.05, (1 + v.count("+") - v.count("-") + 2) / (len(v) + 2))) for v, _ in rows}
        for _ in range(rounds):
            total = [1.0, 1.0]
            seen = [defaultdict(lambda: 0.3), defaultdict(lambda: 0.3)]
            for v, n in rows:
                for y, p in ((1, belief[v]), (0, 1 - belief[v])):
                    total[y] += n * p
                    for i, x in enumerate(v):
                        seen[y][i, x] += n * p
            for v, _ in rows:
                odds = math.log(total[1] / total[0])
                for i, x in enumerate(v):
                    odds += math.log(seen[1][i, x] / (total[1] + 0.9)) - math.log(seen[0][i, x] / (total[0] + 0.9))
                belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, v): p for v, p in belief.items()}
    return out


def features(k: int, v: str, size: int, digits: int) -> list[str]:
    return [f"kind{k}", *(f"vote{i}{x}" for i, x in enumerate(v)), f"size{size}", f"digits{digits}"]


def train(patterns: list[tuple], rounds: int = 200, rate: float = 0.5, shrink: float = 0.01) -> dict[str, float]:
    """Weights of a logistic classifier; patterns: (kind, votes, size, digits, count).  At most some thousand of them."""
    votes_only: dict[tuple, float] = defaultdict(float)
    for k, v, _, _, n in patterns:
        votes_only[k, v] += n
    target = reliabilities(votes_only)
    rows = [(features(k, v, s, d), target[k, v], math.log1p(n)) for k, v, s, d, n in patterns]
    total = sum(n for *_, n in rows) or 1.0
    weight: dict[str, float] = defaultdict(float)
    for _ in range(rounds):
        step: dict[str, float] = defaultdict(float)
        for names, y, n in rows:
            p = 1 / (1 + math.exp(-sum(weight[x] for x in names)))
            for x in names:
                step[x] += n * (y - p) / total
        for x, g in step.items():
            weight[x] += rate * (g - shrink * weight[x] / len(rows))
    return dict(weight)


def learn(spans: DataFrame) -> dict[str, float]:
    """The classifier of all candidates in column ``_c``; what reaches the driver is a row per distinct pattern."""
    rows = spans.select(F.explode("_c").alias("c")).groupBy("c.k", "c.v", "c.size", "c.digits").agg(F.count(F.lit(1)).alias("n")).collect()
    return train(sorted((r["k"], r["v"], r["size"], r["digits"], r["n"]) for r in rows))


def accepted(spans: Column, weight: dict[str, float]) -> Column:
    """Base spans, and weak ones that the classifier takes for personal data."""
    if not weight:
        return spans

    def score(x):
        total = F.lit(0.0)
        for name, value in (("k", "kind"), ("size", "size"), ("digits", "digits")):
            for j in range(8):
                if f"{value}{j}" in weight:
                    total = total + F.when(x[name] == j, weight[f"{value}{j}"]).otherwise(0.0)
        for i in range(4):
            for v in "+-0":
                if f"vote{i}{v}" in weight:
                    total = total + F.when(F.substring(x["v"], i + 1, 1) == v, weight[f"vote{i}{v}"]).otherwise(0.0)
        return total

    return F.filter(spans, lambda x: x["base"] | (score(x) > 0))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of base spans) and spans (of all)."""
    spans = stored(docs.select("doc_id", candidates(F.col("text")).alias("_c")), "spans")
    base = F.filter("_c", lambda x: x["base"])
    counts = [count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(accepted(F.col("_c"), learn(spans))).alias("spans"))


def count_of(k: int) -> Column:
    return F.size(F.filter("_c", lambda x: x["base"] & (x["k"] == k))).cast("long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span replaced by its kind, as in <EMAIL>; of overlapping spans, one label for all.

    The candidates are found once and stored with the documents.  Null and empty texts and texts without spans stay as
    they are, rows that are there twice are treated alike, empty documents give an empty result.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), candidates(F.col("text")).alias("_c"))  # no name can clash
    marked = stored(packed, "spans").select("doc", F.col("doc")["text"].alias("text"), "_c")
    weight = learn(marked)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    kind = "struct<p:int,t:array<string>>"

    def rest(text, spans):
        def cut(acc, x):
            gap = F.substring(text, acc["p"] + 1, F.greatest(x["s"] - acc["p"], F.lit(0)))
            fresh = F.struct(F.greatest(x["e"], acc["p"]).alias("p"), F.concat(acc["t"], F.array(gap, F.get(names, x["k"]))).alias("t")).cast(kind)
            return F.when(x["s"] < acc["p"], F.struct(F.greatest(x["e"], acc["p"]).alias("p"), acc["t"].alias("t")).cast(kind)).otherwise(fresh)

        zero = F.struct(F.lit(0).alias("p"), F.expr("array()").alias("t")).cast(kind)
        return let(F.aggregate(spans, zero, cut), lambda a: F.concat(F.array_join(a["t"], ""), F.substring(text, a["p"] + 1, F.length(text))))

    marked = marked.withColumn("_c", accepted(F.col("_c"), weight))
    return with_text(docs, marked, rest(F.col("text"), F.col("_c")), F.size("_c") > 0)
