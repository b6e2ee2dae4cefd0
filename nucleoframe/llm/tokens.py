"""Encoding of text with a public byte-level tokenizer inside Arrow batches."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that the vocabulary was made with (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are cut at safe places before encoding.
LONG = 65_536
#: Between these a token can't reach across: a visible character, then a blank before a letter.
_SAFE = regex.compile(r"(?<=\S)(?= \p{L})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?= ?\p{L})")


@functools.lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The tokenizer of a rank file, once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> list[str]:
    """Parts of about ``size`` characters whose encodings add up to the encoding of the text.

    Where no safe place follows, the part runs on to the end.
    """
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m or m.start() >= len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(text: str, vocabulary: str) -> np.ndarray:
    enc = encoding(vocabulary)
    if len(text) <= LONG:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text)])



def _text(value) -> str:
    return "" if value is None else value


def encode_column(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``ids``, the token ids of the text without special tokens.

    Null and empty texts have the empty list. Strings of special tokens are ordinary text. Whole
    texts are encoded, however long. Repeated rows are encoded like others; an empty table gives
    an empty result. No shuffle.
    """
    keep = keep or []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode(_text(t), vocabulary) for t in part.column("__text").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*keep, "ids"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``n_tokens``; 0 for null and empty texts."""
    keep = keep or []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([len(encode(_text(t), vocabulary)) for t in batch.column("__text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n)], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode_bytes(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The raw bytes of a list of ids; any cut of a list decodes, also inside a character. Null gives null."""

    @F.pandas_udf(T.BinaryType())
    def run(lists):
        enc = encoding(vocabulary)
        return lists.map(lambda v: None if v is None else enc.decode_bytes([int(i) for i in v]))

    return run(ids)
