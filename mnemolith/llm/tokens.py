"""Token counts by a public byte-level BPE vocabulary; its file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's makers split text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def count(batches):
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item"], pa.array(n, pa.int64())], names=["item", "tokens"])

    return count


def token_counts(documents: DataFrame, *, item: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(item, tokens) of every text; null and empty texts have none."""
    return documents.select(documents[item].cast("bigint").alias("item"), documents[text].alias("text")).mapInArrow(_count(vocabulary), "item bigint, tokens bigint")
