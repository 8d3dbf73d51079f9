"""The trained operators written out by hand, and their recall on texts they didn't learn from."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import common, language_id, secret_scan, toxicity

from ..compare import SMALL

TEXTS = ["You ARE awful, awful!", "", "  -- ", "a lovely day; a lovely walk", "Ünï cödé 123 ß 😀 x", "tiny", "x" * 300 + " awful"]


def grams(text, sizes, bits):
    """(n, bucket) of every n-gram of the cleaned text, one by one."""
    s = re.sub(" +", " ", " " + "".join(c if ord(c) >= 0x10000 or c.isalnum() else " " for c in text.lower()) + " ")
    word = 1 << 32
    for n in sizes:
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x01000193 + (ord(c) + 1) * 0x9E3779B1) % word
            m = ((h ^ h >> 15) * 0x85EBCA6B + n * 0x27D4EB2F) % word
            yield n, ((m ^ m >> 13) * 0xC2B2AE35 % word) >> (32 - bits)


def test_toxicity_scores_by_hand():
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}e" for a in "bdfg" for b in "aiou" for c in "lmnr"]
    texts = [" ".join(rng.choice(words, 30)) + (" awful trash" if k % 2 else " lovely tree") for k in range(80)]
    toxic = np.arange(80) % 2
    model = toxicity.fit(texts, toxic, min_z=3.0)
    for t, got in zip(TEXTS, model.score(TEXTS)):
        found = {int(model.slot[b]) for _, b in grams(t, toxicity.SIZES, toxicity.BITS)} - {0}
        assert math.isclose(got, 1 / (1 + math.exp(-model.bias - sum(model.weight[k] for k in found))), rel_tol=1e-9)
    # a kept feature's ratio has the sign of the class it is more frequent in, and so has its part of the score
    score = dict(zip(("awful trash", "lovely tree"), model.score(["awful trash", "lovely tree"])))
    assert score["awful trash"] > 0.9 and score["lovely tree"] < 0.1
    count = [{b: sum(b in {x for _, x in grams(t, toxicity.SIZES, toxicity.BITS)} for t, y in zip(texts, toxic) if y == c) for b in np.flatnonzero(model.slot)[:40].tolist()} for c in (0, 1)]
    for b in count[0]:
        z = abs(count[1][b] - (count[0][b] + count[1][b]) / 2) / math.sqrt((count[0][b] + count[1][b]) / 4)
        assert count[0][b] + count[1][b] >= 3 and z >= 3.0


def test_toxicity_finds_what_it_did_not_learn(spark):
    folder = SMALL.replace("0.001", "0.1")
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    held = docs.join(labels, "doc_id").where(common.held_out(F.col("doc_id")))
    s = toxicity.with_score(held, toxicity.train(docs, labels)).select("toxic", "score").toPandas()
    assert (s[s.toxic == 1].score >= 0.5).mean() >= 0.9 and (s[s.toxic == 0].score < 0.5).mean() > 0.99


def test_language_decoding_by_hand():
    rng = np.random.default_rng(2)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "adgjm"}
    make = lambda k: " ".join("".join(rng.choice(list(alphabets[k]), 5)) for _ in range(20))
    langs = [k for k in alphabets for _ in range(25)]
    model = language_id.fit([make(k) for k in langs], langs, rounds=60)
    texts = [*TEXTS, *[make(k) for k in alphabets]]
    names, scores, close = model.predict(texts)
    for t, name, score, flag in zip(texts, names, scores, close):
        x = np.zeros(1 << language_id.BITS)
        for _, b in grams(t, language_id.SIZES, language_id.BITS):
            x[b] += 1
        x = np.sqrt(x / max(x.sum(), 1))
        margin = x @ model.weight + model.bias
        loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margin)) for word in model.code]
        first, second = sorted(loss)[:2]
        if not any(map(str.isalpha, t)):
            assert (name, score, flag) == ("und", 0.0, False)
            continue
        assert name == model.names[int(np.argmin(loss))] and math.isclose(score, 1 / sum(math.exp(first - v) for v in loss), rel_tol=1e-4)
        assert abs(second - first - model.margin) < 1e-3 or flag == (second - first < model.margin)
    assert names[len(TEXTS) :] == list(alphabets)


def test_language_fit_in_blocks_is_the_dense_one():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefgh "), 80)) for _ in range(600)]
    rows = language_id.Sparse(texts)
    dense = np.concatenate([m for _, m in language_id.features(texts)])
    assert all((x == dense[a : a + len(x)]).all() for a, x in rows.blocks()) and rows.at.nbytes < dense.nbytes / 20


def test_secret_chains_by_hand(spark):
    samples = secret_scan.labelled_samples(spark, 300)
    model = secret_scan.train(samples)
    place = {c: k + 1 for k, c in enumerate(secret_scan.ALPHABET)}
    n = {True: {}, False: {}}
    rows = samples.toPandas()
    for token, random in zip(rows.token, rows.random):
        for a, b in zip([0, *[place.get(c, 0) for c in token]], [place.get(c, 0) for c in token]):
            n[random][a, b] = n[random].get((a, b), 0) + 1

    def ratio(token):
        chars, total = [place.get(c, 0) for c in token], 0
        for a, b in zip([0, *chars], chars):
            p, q = ((n[k].get((a, b), 0) + 0.5) / (sum(v for (x, _), v in n[k].items() if x == a) + 0.5 * secret_scan.WIDTH) for k in (True, False))
            total += round(1000 * math.log(p / q))
        return total

    tokens = ["getUserAccountName1", "wJalrXUtnFEMIK7MDENGbPx", "2024-01-01-00-00-0001", "aB3/xY9+zz00Qr=="]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(secret_scan.ratio(F.col("t"), model)).collect()
    assert [r[0] for r in got] == [ratio(t) for t in tokens]


def test_secret_recall_on_samples_it_did_not_learn(spark):
    """Planted in the whole small corpus: nearly all random strings are found, hardly any identifier, and no word of the corpus itself."""
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    held = secret_scan.labelled_samples(spark, 200, first=50_000).withColumn("i", F.monotonically_increasing_id())
    docs = common.table(spark, SMALL, "documents").where("text is not null")
    plain = secret_scan.with_spans(docs, model)
    assert plain.where(F.exists("all_spans", lambda s: s["kind"] == 3)).count() == 0
    text = docs.orderBy("doc_id").first()["text"][:500]
    planted = held.withColumn("text", F.concat(F.lit(text + " ("), F.col("token"), F.lit(") end.")))
    base = F.size("base_spans") == 0  # hexadecimal strings are found by a base pattern
    s = secret_scan.with_spans(planted, model).select("random", base.alias("new"), F.exists("all_spans", lambda x: x["kind"] == 3).alias("found")).toPandas()
    assert s[s.random & s.new].found.mean() >= 0.95 and s[~s.random].found.mean() <= 0.03


def test_many_matches_in_one_text(spark):
    model = secret_scan.train(secret_scan.labelled_samples(spark, 500))
    n = 3000
    df = spark.createDataFrame([(1, "é token=abcdefgh1 " * n)], "doc_id long, text string")
    r = secret_scan.redact(secret_scan.with_spans(df, model)).first()
    assert [(s["start"], s["end"]) for s in r["base_spans"]] == [(18 * k + 2, 18 * k + 17) for k in range(n)] and r["text"] == "é <SECRET> " * n
