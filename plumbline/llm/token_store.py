"""Token ids as Parquet list columns that can be read selectively.

Documents are put in ascending id order by ranges; each task encodes its range
and writes one run of files: the ids as a dictionary-encoded (bit-packed) list
column, the metadata delta-encoded (format v2), in row groups and pages of set
sizes with page indexes, so a reader can fetch a few documents' ids, or all
counts without any id.  The global start of a document is its range's base plus
its place in the range; bases come from the counts column alone.

Ids come from one of two engines that give the same: the compiled transducer of
the vocabulary file (see fst_tokenizer), or the tokenizers library, which is
slower here even if it encodes each different pre-token once (see word_ids).
Ranges are cut by id and text hash, so one id of many rows is no
single range.  Defined results: a null text
counts as empty and has the end id only; rows with a null id come first;
repeated rows keep their own entries, equal ids in an order of their texts' hashes;
other columns than id and text aren't stored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fst_tokenizer, word_ids
from .common import byte_parts, text_or_empty, texts_of

ENGINES = {"transducer": fst_tokenizer.load, "library": word_ids.load}
SCHEMA = "part int, doc_id long, place long, n_tokens int, ids array<int>"


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, doc_id, text) by ascending id: the order of parts, and within a part of rows."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")


def encode_ordered(batches, tokenizer: str, end_id: int, engine: str):
    """(part, doc ids, texts' ids with the end id one after another, counts) for runs of an ordered partition."""
    machine = ENGINES[engine](tokenizer)
    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else 0
        names, at = batch.column(1), 0
        for texts in byte_parts(texts_of(batch.column(2)), 1_000_000):
            ids, offsets = machine.encode(texts)
            out = np.insert(ids, offsets[1:], end_id)
            yield part, names.slice(at, len(texts)), out.astype(np.int32), np.diff(offsets) + 1
            at += len(texts)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group_mb: int = 32, page_kb: int = 128, engine: str = "transducer", doc_id: str = "doc_id", text: str = "text") -> None:
    def encode(batches):
        place = 0
        for part, names, ids, counts in encode_ordered(batches, tokenizer, end_id, engine):
            before = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part, np.int32)),
                    names,
                    pa.array(place + before),
                    pa.array(counts.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.append(before, len(ids)).astype(np.int32)), pa.array(ids)),
                ],
                ["part", "doc_id", "place", "n_tokens", "ids"],
            )
            place += int(counts.sum())

    writer = in_order(docs, doc_id, text).mapInArrow(encode, SCHEMA).write
    for key, value in {
        "compression": "zstd",
        "parquet.writer.version": "v2",  # delta encodings where there is no dictionary
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.dictionary.page.size": 1 << 20,  # holds every id of a vocabulary of 2^18
        "parquet.block.size": row_group_mb << 20,
        "parquet.page.size": page_kb << 10,
        "parquet.page.row.count.limit": 2000,
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def bases(stored: DataFrame) -> DataFrame:
    """(part, base): ids stored before each range.  One row per range reaches the driver."""
    sums = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    rows, total = [], 0
    for part, n in sums:
        rows.append((part, total))
        total += n
    return stored.sparkSession.createDataFrame(rows, "part int, base long")


def _crc32(ids: pa.Array) -> pa.Array:
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    bounds = (np.asarray(ids.offsets) - ids.offsets[0].as_py()).tolist()
    raw = memoryview(flat.tobytes())
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])], pa.int64())


def summary(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document."""
    based = stored.join(F.broadcast(bases(stored)), "part")
    return based.select("doc_id", (F.col("base") + F.col("place")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), F.arrow_udf(_crc32, "long")("ids").alias("ids_crc32"))
