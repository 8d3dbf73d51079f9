"""The corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, secret redaction, packing.

Every stage takes null ids and texts, empty and very long texts, repeated rows,
extra columns and an empty table; what it then does is stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, fst_tokenizer, packing, secret_scan, similar, toxicity
from plumbline.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    A null or empty text has the score of the intercept and, with labels that are
    mostly clean, stays; repeated rows share their fate; without labels all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, out="_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word shingle similarity of 0.8 or more stays, the one of the smallest id.

    Texts without a word, null ones too, are one group; of repeated rows one
    stays; rows that share an id but no group all stay; a null id stays only
    where its group has no other.
    """
    return similar.keep_one(docs, least=0.8, words=5).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go.

    Null and empty texts hold none and stay; repeated rows share their fate;
    without benchmark items all stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; found spans are replaced in their text, and n_chars follows.

    A text without a span stays as it is, a null one null; repeated rows stay.
    """
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    found = secret_scan.redact(secret_scan.with_spans(docs, model, base="_base", out="_spans"), spans="_spans")
    changed = F.size("_spans") > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each for
    itself; an empty table has no piece.
    """
    return packing.pack(docs, fst_tokenizer.default_path(), end_id=1, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]

# No SQL: a trained classifier, shingle sets and a tokenizer aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
