"""Token ids of a public byte-level BPE for every text of a corpus.

Defined results: a null text and an empty text both get an empty list; a blank text is encoded as
stored. Repeated texts get equal lists. Other columns pass through; an existing column of the
result's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.llm.bpe import ByteBPE, parse_ranks
from leafsift.session import ship, spread

VOCABULARY = "byte_bpe_50k.tiktoken"
_encoders: dict[int, ByteBPE] = {}


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The vocabulary file's bytes and the word pattern; by default of the installed public one."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path(VOCABULARY)
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return f.read(), pattern


def _encoder(shared, pattern: str) -> ByteBPE:
    """One encoder, with its cache of words, per Python worker."""
    key = hash((shared.value[:64], len(shared.value), pattern))
    if key not in _encoders:
        _encoders[key] = ByteBPE(parse_ranks(shared.value), pattern)
    return _encoders[key]


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    """The vocabulary file (under 1 MB, whatever the corpus) is broadcast once per session."""
    raw, pattern = vocabulary(path, pattern)
    held = getattr(spark, "_leafsift_vocab", {})
    key = (path, pattern)
    if key not in held:
        held[key] = spark.sparkContext.broadcast(raw)
        spark._leafsift_vocab = held
    return held[key], pattern


def token_ids(spark: SparkSession, text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    ship(spark)
    shared, pattern = _shared(spark, path, pattern)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = _encoder(shared, pattern)
        flat: list[int] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int32)
        for i, t in enumerate(texts.to_pylist()):
            if t:
                enc.encode_into(t, flat)
            ends[i + 1] = len(flat)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.asarray(flat, dtype=np.int32)))

    return ids(text)


def token_count(spark: SparkSession, text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    ship(spark)
    shared, pattern = _shared(spark, path, pattern)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        enc = _encoder(shared, pattern)
        return pa.array([enc.count(t) for t in texts.to_pylist()], pa.int64())

    return count(text)


def encode_corpus(
    df: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``df`` with the list of token ids of ``text_col`` in ``out``."""
    return spread(df).withColumn(out, token_ids(df.sparkSession, F.col(text_col), path, pattern))


def count_tokens(
    df: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``df`` with the number of token ids of ``text_col`` in ``out``; 0 for null and empty texts."""
    return spread(df).withColumn(out, token_count(df.sparkSession, F.col(text_col), path, pattern))
