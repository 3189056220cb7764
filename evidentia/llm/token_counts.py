"""Token counts of documents (whole-token shortcut)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._shared import bound_batches, large, slices, utf8


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: path of a vocabulary file of the tokenizers library. Which vocabulary strings encode
    alone as one token is proven beforehand, on the driver, with the library itself; pre-tokens among them
    are counted directly, all others are merged by the library and remembered in a bounded cache.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give a row each; an empty table
    gives none. Long texts are read whole. Other columns are not read and cannot clash.
    """
    bound_batches(docs.sparkSession)
    proof = docs.sparkSession.sparkContext.broadcast(_tokens.prove(tokenizer))

    def count(batches):
        held = _tokens.encoder(tokenizer, proof.value)
        for batch in batches:
            data, offsets = utf8(large(batch.column(1)))
            n = np.zeros(batch.num_rows, np.int64)
            for a, b in slices(offsets, _tokens.STEP_BYTES):
                n[a:b] = held.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes = pa.array(offsets[1:] - offsets[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n)], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
