"""Token counts by public tokenizers. Vocabulary files stay where they are; their path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(data: bytes):
    """The tokenizer of a rank file's content; built once per Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; a null text has 0 tokens, like an empty one.

    The rank file (about 1 MB, a fixed size) is read on the driver and sent along, so
    workers need no copy of it. Whole texts are encoded, however long."""
    with open(vocabulary, "rb") as f:
        data = f.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(data).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")
