"""The pipeline's near-duplicate stage against brute-force five-word similarity."""

import corpus_pipeline
import numpy as np

from plumbline.llm import common, similar

from ..compare import SMALL


def slow_set(text):
    w = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(texts, ids):
    """Least id of each row's group, from all pairs."""
    sets, label = [slow_set(t) for t in texts], list(ids)
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    before = None
    while label != before:
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label, pairs


def test_stage_equals_brute_force(spark):
    docs = common.table(spark, SMALL, "documents")
    rows = docs.toPandas()
    label, pairs = slow_groups(rows.text, rows.doc_id.tolist())
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()]
    assert sorted(kept) == sorted(set(label))
    at = {d: k for d, k in zip(rows.doc_id, label)}
    assert all((at[d] == d) == (d in set(kept)) for d in at) and len(pairs) > 0


def edited(rng, n, words=120):
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, words, 3):
            w[k] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_edited_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_SETS", 4)  # a large group is cut into blocks
    rng = np.random.default_rng(5)
    texts = [t for _ in range(12) for t in edited(rng, 12)] + [None, "", " ", "two words", "Two  words", "other words"]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = similar.assign(df).toPandas().sort_values("doc_id").component_id.tolist()
    assert got == slow_groups(texts, ids)[0]
