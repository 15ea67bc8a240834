"""Sizes of texts in tokens of a public byte-level tokenizer. Its vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: File of ranks; the folder is read where the tasks run.
VOCABULARY = os.environ.get("LEXQUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache(4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in batches:
            n = [None if t is None else len(e.encode_ordinary(t)) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], [*keep, "tokens"])

    return run


def with_tokens(df: DataFrame, column: str, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``; null for a null text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, df[column].alias("__text")).mapInArrow(_count(path, list(keep)), f"{fields}, tokens bigint")
