"""Token counts of whole texts, huge ones in overlapping pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing, word_encoding
from .shared import map_arrow

#: Characters above which a text is encoded in pieces, and by which neighbouring pieces overlap.
CHUNK, OVERLAP = 1 << 15, 256


def _count(batches, path: str, chunk: int, overlap: int):
    encoder = word_encoding.load(path)
    for batch in batches:
        texts = batch.column(2)
        counts = np.zeros(len(texts), np.int64)
        long = pc.greater(pc.utf8_length(texts), chunk).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(long):
            counts[i] = len(tokenizing.encode_spliced(encoder.tokenizer, texts[i].as_py(), chunk, overlap))
        places, short = np.flatnonzero(~long), texts.filter(pa.array(~long))
        for a, n in tokenizing.slices(short):
            counts[places[a : a + n]] = encoder.encode(short.slice(a, n), chunk, overlap)[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a tokenizers file; its defaults hold for special strings inside
    texts, none are added, nothing is cut or padded. Texts above ``chunk`` characters are encoded
    in overlapping pieces and spliced, with the count of the whole text; others from the ids of their
    distinct words where that is exact. Null and empty texts have
    no bytes and no tokens. There is no shuffle; a worker holds one run of texts at a time.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    counted = rows.transform(map_arrow, lambda it: _count(it, tokenizer, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
