"""Every pipeline stage on rows that are hard to handle, and on none at all."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common

from ..compare import SMALL

LONG = "calm water under the old bridge " * 8000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, "en", "a", len(LONG)),
    (4, "one plain sentence of several words", "en", "a", 35),
    (4, "one plain sentence of several words", "en", "a", 35),
    (4, "something else entirely under the same number", "en", None, 45),
    (5, "password = hunter22secret and more words", "en", "b", 40),
    (None, "this row has no number at all", "en", "b", 29),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hard(spark):
    return common.materialize(spark.createDataFrame(ROWS, SCHEMA).withColumns({"score": F.lit(9.0), "_h": F.lit("x"), "hits": F.lit(1)}), "hard-rows")


def rows(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in df.collect())


def test_stages_on_hard_rows(spark, hard):
    stages = dict(corpus_pipeline.STAGES)
    everything = rows(hard)
    for name in ("toxicity", "decontamination"):
        out = stages[name](spark, hard, SMALL)
        assert rows(out) == everything and out.columns == hard.columns and out.where("score <> 9 or _h <> 'x' or hits <> 1").count() == 0
    out = stages["near_duplicates"](spark, hard, SMALL)
    assert out.columns == hard.columns and sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in out.collect()) == [(0, "this row "), (1, ""), (3, "calm wate"), (4, "one plain"), (4, "something"), (5, "password ")]
    out = stages["secrets"](spark, hard, SMALL)
    assert out.columns == hard.columns and out.count() == len(ROWS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.where("doc_id in (1, 3, 5)").collect()}
    assert got == {1: (None, None), 3: (LONG, len(LONG)), 5: ("<SECRET> and more words", len("<SECRET> and more words"))}
    pieces = stages["packing"](spark, hard, SMALL).toPandas()
    whole = pieces.groupby(["doc_id", "doc_tokens"], dropna=False).length.sum()
    assert (pieces.start == 0).sum() == len(ROWS) and whole[(1, 1)] == 1 and pieces[pieces.doc_id == 4].shape[0] == 3 and (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def test_stages_on_an_empty_table(spark, hard):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, hard.limit(0), SMALL)
        assert out.count() == 0 and (name == "packing" or out.columns == hard.columns)
