"""Counting the tokens of texts with a public byte-pair vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.bounded import use_all_cores

#: Folder of the vocabulary files.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[tuple[str, str], object] = {}


def encoding(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """The encoder of a vocabulary, made once per worker process."""
    import tiktoken

    at = (folder, vocabulary)
    if at not in _encodings:
        with open(os.path.join(folder, vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[at] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[at]


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, ``n_tokens``) of each whole text.  An empty text has none; rows with a null text or key are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    rows = use_all_cores(df.select(key, F.col(text).cast("string").alias(text)).dropna())
    return rows.mapInArrow(count, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_tokens bigint")
