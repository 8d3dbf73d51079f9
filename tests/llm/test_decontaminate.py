"""Decontamination against substring search and exhaustive scores, with items of any length and several shards."""

import numpy as np
import pytest

from plumbline.llm import common, decontaminate

from ..compare import SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def bench(spark):
    return common.table(spark, SMALL, "benchmark")


def pairs(docs, bench):
    return sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())


def test_equals_substring_search(spark, docs, bench):
    items, texts = bench.toPandas(), docs.toPandas()
    want = sorted((d, i) for d, t in zip(texts.doc_id, texts.text) for i, b in zip(items.item_id, items.text) if b in t)
    assert pairs(docs, bench) == want and want
    text = items.text[0]
    rows = [(1, "noise " * 500 + text.upper().replace(",", " ;") + " noise" * 500), (2, text[: len(text) // 4]), (3, None), (4, " ".join(reversed(text.split()))), (5, "")]
    assert pairs(spark.createDataFrame(rows, "doc_id long, text string"), bench) == [(1, items.item_id[0])]
    assert pairs(docs, bench.limit(0)) == [] and pairs(docs.limit(0), bench) == []


def test_several_shards_find_what_one_does(docs, bench, monkeypatch):
    one = decontaminate.with_hits(docs, bench).toPandas()
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 10)
    assert decontaminate.indexes(bench).count() > 3
    many = decontaminate.with_hits(docs, bench).toPandas()
    hits = lambda t: {d: sorted((h["item_id"], h["question_overlap"], h["answer_overlap"]) for h in x) for d, x in zip(t.doc_id, t.hits)}
    assert hits(one) == hits(many) and sum(map(len, hits(one).values())) > 0


def test_short_items_and_scripts_without_spaces(spark):
    long = "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸"
    items = [(1, "two words"), (2, "What is it?"), (3, long), (4, "  ... "), (5, None), (1, "two words"), (None, "Null id here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(10, "there are TWO  words; here"), (11, "two other words"), (12, "so what is it then"), (13, "x" + long + "y"), (14, long[:8]), (15, "a null id, here"), (16, "..."), (17, "two words"), (17, "two words")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in got) == [(10, 1), (12, 2), (13, 3), (15, 0), (17, 1), (17, 1)]


def test_clashing_columns(spark, bench, monkeypatch):
    text = bench.orderBy("item_id").first()["text"]
    df = spark.createDataFrame([(1, text, "a", 2), (2, "clean", "b", 3), (None, None, None, None)], "doc_id long, text string, hits string, _key int")
    for shards in (20_000, 10):
        monkeypatch.setattr(decontaminate, "SHARD_ITEMS", shards)
        kept = decontaminate.clean(df, bench)
        assert kept.columns == df.columns and sorted(tuple(r) for r in kept.where("doc_id is not null").collect()) == [(2, "clean", "b", 3)] and kept.count() == 2
        out = decontaminate.with_hits(df, bench)
        assert sorted(out.columns) == sorted(df.columns) and out.where("size(hits) = 1").count() == 1


def test_block_max_wand_equals_exhaustive_scores():
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 20) % 200)) for i in range(120)]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, t in items for w in t.split()}))}
    cls = decontaminate.LengthClass(items, 32, 1.2, 0.75, 5, vocabulary)
    weights = [{t: w for t, p in enumerate(cls.postings) for j, w in p if j == i} for i in range(120)]
    for _ in range(60):
        q = sorted(rng.choice(len(cls.vocab), 25, replace=False).tolist())
        for th in (0.02, 0.1, 0.3):
            assert sorted(i for i, _ in cls.search(q, th)) == [i for i, w in enumerate(weights) if sum(w.get(t, 0) for t in q) >= th]
