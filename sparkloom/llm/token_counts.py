"""Token counts of whole texts by the compiled tokenizer of tokenizer.py."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T
from . import tokenizer as K

LIMIT = 1024


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit.

    A null text is empty and has no tokens. Special strings in a text count as one
    token each, as the library has it. Texts of any length are read whole; repeated
    rows stay; other columns of docs are not read; an empty table gives no rows.
    """
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            size = T.flat(texts)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size[1:] - size[:-1]), pa.array(K.count_tokens(texts, path))], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
