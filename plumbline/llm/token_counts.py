"""Token counts by a compiled finite-state tokenizer (see fst_tokenizer).

The splitting transducer's chunk state maps are composed by a parallel prefix
scan; the merging transducer's transitions carry the emitted-token counts.  No
token is built.  Defined results: a null text counts as empty (0 bytes, 0
tokens); other columns pass through, but input columns named n_bytes, n_tokens
or over_limit are replaced; one row out for each row in, none for an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fst_tokenizer
from .common import texts_of


def with_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit; `tokenizer` is the vocabulary file's path on every machine."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(np.asarray(fst_tokenizer.load(tokenizer).counts(t or "" for t in texts_of(texts))), pa.int64())

    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
        .withColumn("n_tokens", count(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
