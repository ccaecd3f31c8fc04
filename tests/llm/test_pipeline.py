import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model")


def test_pipeline(spark, tmp_path):
    rng = random.Random(0)
    vocabulary = {"en": [f"word{i}ing" for i in range(300)], "de": [f"wört{i}ung" for i in range(300)]}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    item = text("en", 30)
    rows = [(i, text(x, 120), x, "s", 0) for i, x in enumerate(["en", "de"] * 20)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " tail", "de", "s", 0), (102, "12 34 ?!", "en", "s", 0), (103, None, None, None, None)]
    rows += [(104, text("en", 100) + " " + item + " " + text("en", 20), "en", "s", 0), (105, item, "en", "s", 0), (106, text("de", 100) + " mail a.b@c.de now", "de", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("score", "lang_pred", "_c", "_n", "_hits", "_row", "_runs", "_changed", "doc", "bin", "part", "ids", "node", "class_id", "a b")
    docs = docs.select("*", *(F.lit(c).alias(c) for c in clashing))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id: r for r in now.collect()}
    assert all(r[c] == c for r in kept.values() for c in clashing)
    assert set(kept) == {*range(40), 104, 106}
    assert item not in kept[104].text and kept[104].n_chars == len(kept[104].text)
    assert kept[106].text.endswith("mail <EMAIL> now") and kept[3].text == rows[3][1]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(kept) and all(r.lossless and r.n_pieces == len(r.ids) for r in out.values())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_empty_pipeline(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
