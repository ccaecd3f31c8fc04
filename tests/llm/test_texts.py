"""Language, licences, pieces, personal data, decontamination and archives."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import decontaminate, language, license, pii, sentencepiece, warc

SYLLABLES = {"xx": "ka ro mi tu pe".split(), "yy": "schl ung eit ach ver".split(), "zz": "é ção ñ ou eau".split()}


def words(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(0)
    rows = [(i, words(x, rng.randint(3, 80), rng), x) for i, x in enumerate(rng.choice("xyz") * 2 for _ in range(400))]
    rows = [(i, t, None if i % 17 == 0 else x) for i, t, x in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    got = language.identify(frame).withColumn("held", language.held_out()).collect()
    right = [r.lang_pred == {i: x for i, _, x in rows}[r.doc_id] for r in got if r.held and {i: x for i, _, x in rows}[r.doc_id]]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(9001, None, "xx"), (9002, "", "xx"), (9003, "123 ?! …", None), (9005, words("xx", 60, rng) + " " + words("yy", 40, rng), None), (None, words("zz", 30, rng), "xx"), (9007, words("zz", 60000, rng), None)], "doc_id long, text string, lang string")
    both = frame.select("doc_id", "text", "lang").unionByName(odd)
    got = {r.doc_id: r for r in language.identify(both).where("doc_id is null or doc_id > 9000").collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    assert got[9005].languages == ["xx", "yy"] and got[9005].shares[0] == pytest.approx(0.6, abs=0.08)
    assert got[None].lang_pred == "zz" and got[9007].lang_pred == "zz"
    assert {r.lang_pred for r in language.identify(odd.where("lang is null")).collect()} == {"und"}  # nothing to learn from
    assert language.identify(frame.limit(0)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rng = random.Random(1)
    rows = [(i, words("xx", 30, rng), "xx") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = frame.withColumn("lang", F.when(language.held_out(), "secret").otherwise(F.col("lang")))
    assert {r.lang_pred for r in language.identify(wrong).collect()} == {"xx"}


def test_mixture_of_six_languages():
    # 600 words, 100 of each of the first six of seven languages; a second document of one language
    logs = np.full((700, 7), -20.0, np.float32)
    logs[np.arange(600), np.arange(600) % 6] = -2.0
    logs[600:, 6] = -2.0
    chosen, _ = language.mixtures(logs, np.array([0, 600]), np.array([600, 100]))
    assert (chosen[0] > 0).tolist() == [True] * 6 + [False] and np.allclose(chosen[0, :6], 1 / 6, atol=0.01)
    assert chosen[1].tolist() == [0.0] * 6 + [1.0]


def naive_mixture(text, labels, count):
    """One document by plain loops: EM over words for each set, penalised likelihood. count: label -> trigram -> n."""
    import math

    letters = lambda b: chr(b).lower() if chr(b).isascii() and chr(b).isalpha() else (b if b > 127 else None)
    found, now = [], []
    for b in [*text.encode(), 32]:
        x = letters(b)
        if x is None:
            if now:
                found.append(now)
            now = []
        else:
            now.append(x)
    grams = [[(w[i - 1] if i else 0, w[i], w[i + 1] if i + 1 < len(w) else 0) for i in range(len(w))] for w in found]
    total = {x: sum(count[x].values()) + 0.5 * (1 << language.BITS) for x in labels}
    logs = [{x: sum(math.log((count[x].get(g, 0) + 0.5) / total[x]) for g in w) for x in labels} for w in grams]
    like = [{x: math.exp(v - max(w.values())) for x, v in w.items()} for w in logs]

    def em(names, share):
        for _ in range(2000):
            fresh = dict.fromkeys(names, 0.0)
            for w in like:
                whole = sum(w[x] * share[x] for x in names)
                for x in names:
                    fresh[x] += w[x] * share[x] / whole / len(like)
            moved, share = max(abs(fresh[x] - share[x]) for x in names), fresh
            if moved < 1e-7:
                break
        return share, sum(math.log(sum(w[x] * share[x] for x in names)) for w in like)

    every, _ = em(labels, dict.fromkeys(labels, 1 / len(labels)))
    order = sorted(labels, key=lambda x: (-every[x], x))
    sets = [({x: 1.0}, sum(math.log(max(w[x], 1e-300)) for w in like)) for x in labels]
    best = max(sets, key=lambda s: s[1])
    for k in range(2, len(labels) + 1):
        share, value = em(order[:k], {x: (every[x] + 1e-3) for x in order[:k]})
        value -= (k - 1) * language.PENALTY / 2 * math.log(len(like) + 1)
        best = max(best, (share, value), key=lambda s: s[1])
    return best[0]


def test_mixtures_equal_a_naive_fit(spark):
    rng = random.Random(11)
    rows = [(i, words(x, 40, rng), x) for i, x in enumerate(["xx", "yy", "zz"] * 15)]
    mixed = [(1000 + i, " ".join(words(x, n, rng) for x, n in parts)) for i, parts in enumerate([[("xx", 40)], [("xx", 30), ("yy", 30)], [("zz", 50), ("xx", 3)], [("xx", 20), ("yy", 25), ("zz", 30)], [("yy", 5)], [("zz", 1)]])]
    frame = spark.createDataFrame([*rows, *((i, t, None) for i, t in mixed)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(frame, F.col("doc_id") < 1000).where("doc_id >= 1000").collect()}
    count = {x: {} for x in SYLLABLES}
    for _, text, x in rows:
        for w in text.split():
            b = [chr(c) if c < 128 else c for c in w.encode()]
            for i in range(len(b)):
                g = (b[i - 1] if i else 0, b[i], b[i + 1] if i + 1 < len(b) else 0)
                count[x][g] = count[x].get(g, 0) + 1
    for i, text in mixed:
        share = naive_mixture(text, sorted(SYLLABLES), count)
        assert set(got[i].languages) == set(share), (text, share, got[i])
        assert got[i].shares == pytest.approx([share[x] for x in got[i].languages], abs=0.01)
        assert got[i].lang_pred == max(sorted(share), key=lambda x: share[x]) and got[i].score == pytest.approx(max(share.values()), abs=0.01)


def test_more_labels_than_can_be_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "LABELS", 2)
    frame = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        language.identify(frame)


def test_licences(spark):
    rows = [
        (1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY 4.0."),
        (5, "a licence to kill\nnothing else"), (6, None), (7, ""), (8, "This work is licensed under the GNU General Public License, version 3.\n\nx\ny\nz\nq\nLicensed under CC BY-SA 4.0."),
        (9, "This work is licensed under the GNU General Public License, version 2."), (10, "w " * 20000 + "Licensed under the Apache License, Version 2.0. " + "v " * 20000), (None, "MIT License"), (2, "Released under the MIT License."),
        (11, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use"),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = [(r.doc_id, r.n_blocks, r.licenses) for r in license.scan_licenses(frame).collect()]
    wanted = {1: ["Apache-2.0"], 2: ["MIT"], 3: ["CC-BY-NC-4.0"], 4: ["CC-BY-4.0"], 5: [], 6: [], 7: [], 8: ["CC-BY-SA-4.0", "GPL-3.0"], 9: ["GPL-2.0"], 10: ["Apache-2.0"], 11: ["MIT"]}
    assert {i: n for i, _, n in got if i is not None} == wanted and len(got) == 13
    assert {i: b for i, b, _ in got if i in (5, 6, 8)} == {5: 1, 6: 0, 8: 2}
    assert license.scan_licenses(frame.limit(0)).count() == 0


def test_every_licence_template_is_a_candidate(spark):
    rows = [(i, f"some text\n{text}\nmore") for i, (_, _, text) in enumerate(license.TEMPLATES)]
    rows += [(100, "prose\nAll rights reserved.\nprose"), (101, "small rights reserved"), (102, "prose, all rights\nreserved. prose"), (103, "x\nReleased under the MIT\nLicense.\nx")]
    got = {r.doc_id: (r.n_blocks, r.licenses) for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _, _) in enumerate(license.TEMPLATES):
        assert got[i][0] == 1 and name in got[i][1], (name, got[i])
    assert got[100] == (1, ["Proprietary"]) and got[101] == (0, []) and got[102][0] == 1 and got[103] == (1, ["MIT"])


def test_licence_in_a_long_line():
    import random

    rng, scan = random.Random(5), license.Scanner()
    for size in (2_000, 5_000, 12_000, 64_000):
        prose = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(size))
        for name, _, text in license.TEMPLATES:
            found = dict(scan.scan(f"{prose} {text} {prose[::-1]}"))
            assert name in found and found[name] > license.GAIN, (size, name)
    assert set(dict(scan.scan(prose + " Released under the MIT License. " + prose + " All rights reserved. Copyright " + prose))) == {"MIT", "Proprietary"}
    assert scan.scan(prose + " a licence, a copyright " + prose) == []


def test_licence_titles_and_tags():
    scan = license.Scanner()
    names = lambda text: sorted(dict(x for a, b in license.blocks(text) for x in scan.scan(text[a:b])))
    for text, wanted in (
        ("# SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: Apache-2.0 */", ["Apache-2.0"]), ("SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"]),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: MIT-0", []), ("SPDX-License-Identifier: BSD-3-Clause-Clear", []), ("SPDX-License-Identifier: CC-BY-4.0.", ["CC-BY-4.0"]),
        ("MIT License\n\nCopyright (c) 2020 A. Person", ["MIT"]), ("BSD 3-Clause License", ["BSD-3-Clause"]), ("This is licensed under the GPLv3.", ["GPL-3.0"]),
        ("They talked about the permission and the MIT building", []), ("an omit license", []),
        ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["BSD-2-Clause"]),
    ):
        assert names(text) == wanted, text
        assert names("prose\n" * 300 + text + "\nmore prose" * 300) == wanted, text


def test_licences_equal_brute_force(spark):
    """Every template against every block, without marks in Spark, caches, ranking or early ends."""
    import difflib

    import zstandard

    rng = random.Random(9)
    notices = [t for _, _, t in license.TEMPLATES] + ["a licence", "copyright 2001 by me", "all rights reserved to all", "the mit license", "no warranty", "SPDX-License-Identifier: MIT-0"]
    other = ["plain words stand here", "and more of them, many more", "", "x y z"]
    texts = ["\n".join(rng.choice(notices if rng.random() < 0.3 else other) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [" ".join(rng.choice(notices + other * 4) for _ in range(12)) for _ in range(20)]

    def saved(template, text):
        given = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        return 1 - len(given.compress(text.encode())) / len(zstandard.ZstdCompressor(level=3).compress(text.encode()))

    def licences(text):
        lines, marked = text.split("\n"), set()
        at = np.cumsum([0, *(len(x) + 1 for x in lines)])
        for pattern in [license.WORDING, *(license.whole(k) for _, k, _ in license.TEMPLATES)]:
            for m in re.finditer("(?i)" + pattern, text):
                marked |= set(range(int(np.searchsorted(at, m.start(), "right")) - 1, int(np.searchsorted(at, m.end() - 1, "right"))))
        blocks, out = [], set()
        for i in sorted(marked):
            if blocks and i - blocks[-1][1] <= license.BETWEEN + 1:
                blocks[-1][1] = i
            else:
                blocks.append([i, i])
        for a, b in blocks:
            block = "\n".join(lines[a : b + 1])
            found, here = license.words(block), {}
            for name, key, template in license.TEMPLATES:
                pattern, own = "(?i)" + license.whole(key), license.words(template)
                m = re.search(pattern, template)
                gains = [saved(template, block[max(0, x.start() - m.start()) : x.end() + len(template) - m.end()]) for x in re.finditer(pattern, block)]
                short = len(found) <= 2 * len(own)
                gains += [saved(template, block)] if gains and short else []
                same = sum(x.size for x in difflib.SequenceMatcher(None, own, found, autojunk=False).get_matching_blocks())
                if gains and (max(gains) >= license.GAIN or not short) and same >= (1 - license.LOST) * len(own):
                    here[name] = 1
            out |= {x for x in here if license.WITHIN.get(x) not in here}
        return len(blocks), sorted(out)

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_blocks, r.licenses) for r in license.scan_licenses(frame).collect()}
    for i, text in enumerate(texts):
        assert got[i] == licences(text), text


def test_licence_ranking():
    scan = license.Scanner()
    for name, _, text in license.TEMPLATES:
        gain, best = scan.ranked(text)[0]
        assert gain > license.GAIN and license.TEMPLATES[best][0] == name
        assert name in dict(scan.scan(text))


def test_every_licence_template_is_ranked_by_compression():
    import zstandard

    scan = license.Scanner()
    block = "Licensed under the Apache License, Version 2.1."  # no template's key phrase but the closest wording of one
    prose = "plain words stand here and more of them, many more " * 200
    for text in (block, "a licence to kill", prose + block + prose, "SPDX tags: licence"):
        ranked = scan.ranked(text)
        assert sorted(i for _, i in ranked) == list(range(len(license.TEMPLATES))) and ranked == sorted(ranked, key=lambda x: (-x[0], x[1]))
        assert scan.scan(text) == []
    for text in (block, prose + block + prose):
        assert license.TEMPLATES[scan.ranked(text)[0][1]][0] == "Apache-2.0"
    for gain, i in scan.ranked(block):
        raw = zstandard.ZstdCompressionDict(license.TEMPLATES[i][2].lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        whole = 1 - len(zstandard.ZstdCompressor(level=3, dict_data=raw).compress(block.lower().encode())) / len(zstandard.ZstdCompressor(level=3).compress(block.lower().encode()))
        assert gain >= whole - 0.01 or len(license.TEMPLATES[i][2]) < len(block), i


def test_licences_in_capitals():
    scan = license.Scanner()
    for name, _, text in license.TEMPLATES:
        assert name in dict(scan.scan(text.upper())), text
        assert name in dict(scan.scan("x " * 2000 + text.upper() + " y" * 2000)), text


MODEL = sentencepiece.MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model")


@needs_model
def test_pieces_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    texts = ["", " ", "a", "Hello  world", "x" * 300, "的" * 100, " " * 70, "a▁b", "\n\t\x00é😀", "theing" * 40] + ["".join(rng.choice("ab  ▁é中😀\n,.tThe ing01") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x")], "doc_id long, text string, ids string")
    out = sentencepiece.encode(frame)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t), t
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(sp.encode(t)).encode()).hexdigest()
        assert got[i].lossless and got[i].n_pieces == len(got[i].ids)
    assert got[None].ids == [] and got[None].lossless
    back = {r.doc_id: r.text for r in sentencepiece.decode(out).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in enumerate(texts)} | {None: ""}
    assert sentencepiece.encode(frame.limit(0)).count() == 0


def test_unigram_fold_is_the_best_path():
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))).lstrip() for _ in range(60)} | set("abc▁"))
    pieces = [p for p in pieces if "▁" not in p.lstrip("▁")]
    scores = [-rng.random() * 5 - 0.1 for _ in pieces]
    table = sentencepiece.PieceTable(["<unk>", *pieces], [0.0, *scores], ["unknown", *["normal"] * len(pieces)], False, True)
    score = dict(zip(pieces, scores, strict=True))

    def best(word):
        value = [0.0] + [-1e9] * len(word)
        for e in range(1, len(word) + 1):
            value[e] = max(value[s] + score[word[s:e]] for s in range(e) if word[s:e] in score and value[s] > -1e9)
        return value[-1]

    words_ = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    for w, ids in table.encode_words(sorted(set(words_))).items():
        parts = [table.pieces[i] for i in ids]
        assert "".join(parts) == w and sum(score[p] for p in parts) == pytest.approx(best(w))
    assert table.encode_words(["▁aé"])["▁aé"][-1] == 0  # unknown


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    n = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(n)) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x.y@z-1.org", "@", ".", "+1 (383) 555-6083", "+49 30 123456", "4111 1111 1111 1111", "4111-1111-1111-1112", "79.156.100.90", "256.1.1.1", "1.2.3.4.5.6.7.8", "é", "😀", " ", "\n", "12", "-", "+", "_", "call 555-123-4567", "mail joe [at] web [dot] org", "5500005555555559"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 15))) for _ in range(400)] + ["", None, "a" * 50000, "1" * 50000, "1 " * 9000 + "a@b.c", "a@b.c_x@d.e", "é" * 30000 + "q@w.ee"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "y")], "doc_id long, text string, spans string")
    rows = pii.personal_data(frame).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        wanted = base_spans(texts[r.doc_id])
        listed = [f"{kind}:{s}:{e}" for s, _, e, kind in wanted]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _, _ in wanted) for j in range(4)]
        assert set(listed) <= set(r.spans.split(",")) | {""} - {""} or not listed
    assert pii.personal_data(frame.limit(0)).count() == 0
    plan = pii.personal_data(frame)._jdf.queryExecution().executedPlan().toString() + frame.select(pii.candidates(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_cards_without_three_digits_together(spark):
    rng = random.Random(6)
    bits = ["41 11 11 11 11 11 11 11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "4 1-1 1-1 1-1 1-1 1-1 1-1 1-1 1", "41 11 11 11 11 11 11 12", "42", "4", " ", "-", "  ", "x", "é"]
    texts = bits + ["card 41 11 11 11 11 11 11 11 end"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(frame).collect():
        wanted = [f"{kind}:{s}:{e}" for s, _, e, kind in base_spans(texts[r.doc_id])]
        assert r.n_card == len(wanted) and r.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
    assert {r.doc_id: r.text for r in pii.redact(frame).collect()}[len(bits)] == "card <CARD> end"


def test_weak_spans_and_redaction(spark):
    rows = [(i, f"Please call 555-123-45{i:02d} or mail joe{i} [at] web [dot] com, tel +1 (383) 555-60{i:02d}", 3) for i in range(30)] + [(99, "nothing here, no 12 of 3.4", 5), (100, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.personal_data(frame).collect()}
    assert {s.split(":")[0] for s in got[3].spans.split(",")} == {"email", "phone"} and got[3].n_email == 0 and got[99].spans == ""
    clean = {r.doc_id: r for r in pii.redact(frame).collect()}
    assert clean[3].text == "Please call <PHONE> or mail <EMAIL>, tel <PHONE>" and clean[3].n_chars == len(clean[3].text)
    assert (clean[99].text, clean[99].n_chars, clean[100].text) == (rows[30][1], 5, None)


def test_reliabilities():
    # three labelers, two of them right nine times in ten, one that guesses
    rng = random.Random(5)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.5
        v = "".join("+" if (rng.random() < a) == y else "-" for a in (0.9, 0.9, 0.5)) + "0"
        counts[0, v] = counts.get((0, v), 0) + 1
    p = pii.reliabilities(counts)
    assert p[0, "+++0"] > 0.9 > 0.1 > p[0, "--+0"]


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows_of(text, n=10):
    w = re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
    k = min(n, len(w))
    return w, ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())


def contamination(docs, items):
    known = {i: windows_of(t)[1] for i, t in items.items()}
    out = {}
    for d, t in docs.items():
        w = windows_of(t)[0]
        hit, found = set(), []
        for i, own in known.items():
            places = [s for x in own for s in range(len(w) - len(x) + 1) if tuple(w[s : s + len(x)]) == x]
            length = len(next(iter(own))) if own else 0
            if places:
                found.append(str(i))
                hit |= {p for s in places for p in range(s, s + length)}
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [20_000, 1])
def test_contamination(spark, limit):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(["ab", "C", "dé", "9", "中"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = {i: text(rng.choice([0, 1, 3, 9, 10, 11, 30])) for i in range(12)} | {2: "zz", 10: None, 11: "!!"}
    docs = {i: text(rng.randint(0, 60)) + (items[rng.randint(0, 9)] or "") + text(5) for i in range(60)} | {100: None, 101: "", 102: "ZZ top", 103: text(4000)}
    d = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, n int").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items.items()], "item_id long, text string, n int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b, set_limit=limit).collect()}
    assert got == contamination(docs, items)
    if limit == 1:
        return
    plan = decontaminate.contamination(d, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert decontaminate.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


@pytest.mark.parametrize("limit", [20_000, 1])
def test_span_removal(spark, limit):
    passage = "One two three four five six seven eight nine ten eleven"
    clean = "Some other text, which has nothing in common with it; " * 3
    docs = spark.createDataFrame([(1, clean + passage + ". End!", 1), (2, clean, 7), (3, passage, 8), (4, None, None), (None, clean, 7), (2, clean, 7)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    rows = decontaminate.remove_spans(docs, items, set_limit=limit).collect()
    got = {r.doc_id: (r.text, r.n_chars) for r in rows}
    assert len(rows) == 5 and 3 not in got and got[2] == (clean, 7) == got[None] and got[4] == (None, None)
    assert got[1] == (clean + " " * 10 + ". End!", len(clean) + 16)


def test_archives(spark):
    rows = [(3, "http://a/x", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (5, "http://c\r\nX: y", ""), (4, "http://d", "z" * 3_000_000), (None, "http://e", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (9, "http://f", "WARC/1.1\r\n\r\n\r\n")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(2)
    got = sorted(((r.page_id or -1), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(frame).collect())
    assert got == [(-1, 9, "response", None), (1, 9, "response", None), (1, 9, "response", None), (2, 0, "response", None), (3, 9, "revisit", 1), (4, 3_000_000, "response", None), (5, 0, "revisit", 2), (9, 14, "response", None)]
    index = warc.write_archive(frame, warc.scratch_path(spark, "warc"), min_bytes=5)
    records = {r.page_id: r for r in warc.resolved(warc.read_records(index)).collect()}
    assert records[3].payload == "<p>é</p>".encode() and records[5].record_type == "response" and records[4].payload == b"z" * 3_000_000
    assert records[9].payload_digest == warc.digest32(b"WARC/1.1\r\n\r\n\r\n") and records[5].url == "http://c%0D%0AX:%20y"
    few = warc.read_records(index.where("page_id in (4, 9)"))
    assert few.count() == 2
    assert warc.archive_round_trip(frame.limit(0)).count() == 0


def test_archive_files_are_standard(spark, tmp_path):
    import gzip

    frame = spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archive(frame, f"file://{tmp_path}/w").orderBy("offset").collect()
    raw = b"".join((tmp_path / "w" / n).read_bytes() for n in sorted(os.listdir(tmp_path / "w")) if not n.startswith("."))
    text = gzip.decompress(raw)
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Type: revisit" in text and b"WARC-Refers-To: <urn:page:1>" in text
    assert sum(r.length for r in index) == len(raw)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(warc.record(1, "u", b"payload", None)[0].replace(b"payload", b"pay1oad"))


def test_ranges_are_joined(spark):
    index = spark.createDataFrame([("f", 0, 10), ("f", 10, 10), ("f", 5_000_000, 10), ("g", 0, 10)], "file string, offset long, length long")
    got = sorted((r.file, r.begin, r.stop, len(r.records)) for r in warc.ranges(index).collect())
    assert got == [("f", 0, 20, 2), ("f", 5_000_000, 5_000_010, 1), ("g", 0, 10, 1)]


def test_archives_are_read_by_several_tasks(spark):
    index = spark.range(400).selectExpr("concat('f', id % 3) AS file", "id * 1000000 AS offset", "1000000L AS length")
    reads = warc.ranges(index)
    some = warc.dealt(reads, 400_000_000)
    wanted = max(spark.sparkContext.defaultParallelism, 6)
    assert len({r.p for r in some.select(F.spark_partition_id().alias("p")).collect()}) > wanted // 2
    assert some.rdd.getNumPartitions() == wanted
    assert warc.dealt(reads, 10_000).rdd.getNumPartitions() == 1
    assert warc.dealt(reads, 64 << 30).rdd.getNumPartitions() == 1024
    assert sorted(map(str, some.collect())) == sorted(map(str, reads.collect()))


@needs_model
def test_relational_lattice_equals_the_batches(spark):
    from broadsheet.llm.lattice import encode_relational

    rng = random.Random(7)
    texts = ["", None, "Hello  world", "的é😀", "x" * 40, " a"] + ["".join(rng.choice("ab  é中,.tThe ing01") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {r.doc_id: r.ids for r in sentencepiece.encode(frame).collect()}
    assert {r.doc_id: r.ids for r in encode_relational(frame).collect()} == wanted
    again = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "another")], "doc_id long, text string")
    pairs = lambda df: sorted((r.doc_id or 0, r.ids) for r in df.select("doc_id", "ids").collect())
    assert pairs(encode_relational(again)) == pairs(sentencepiece.encode(again))
    table = sentencepiece.PieceTable(["<unk>", "a" * 64], [0.0, -1.0], ["unknown", "normal"], False, True)
    with pytest.raises(ValueError, match="64 characters"):
        encode_relational(frame, table)


def test_relational_viterbi(spark):
    from broadsheet.llm.lattice import encode_relational

    pieces = ["▁", "a", "b", "▁a", "ab", "ba", "aba"]
    table = sentencepiece.PieceTable(["<unk>", *pieces], [0.0, -3.0, -2.0, -2.5, -2.2, -2.1, -2.3, -4.9], ["unknown", *["normal"] * 7], False, True)
    texts = ["ab aba", "bbaab", "aéb", "abababa ba"]
    got = {r.doc_id: r.ids for r in encode_relational(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table).collect()}
    for i, t in enumerate(texts):
        score = lambda ids: sum(table.scores[x] if x else -14.9 for x in ids)
        coded = table.encode_words(sorted(set(table.words(t))))
        assert score(got[i]) == pytest.approx(score([x for w in table.words(t) for x in coded[w]]))
