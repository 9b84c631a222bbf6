"""Byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts above this many characters are cut at safe boundaries before encoding.
LONG_CHARS = 1 << 16
#: Where the pre-split pattern always ends one match and begins another, whatever
#: stands around: a letter before a space or newline, and letter against digit.
SAFE = re.compile(r"(?<=[^\W\d_])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
SCHEMA = "ids binary, decoded binary"


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, long_chars: int = LONG_CHARS) -> Iterator[str]:
    """Cut a long text at the first safe boundary after each long_chars characters."""
    start = 0
    while len(text) - start > long_chars:
        cut = SAFE.search(text, start + long_chars)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, long_chars: int = LONG_CHARS) -> np.ndarray:
    """Token ids of one text as the library gives them, whatever its length."""
    if len(text) <= long_chars:
        return enc.encode_to_numpy(text, disallowed_special=())
    found = []
    for piece in safe_pieces(text, long_chars):
        if len(piece) <= 4 * long_chars:
            found.append(enc.encode_to_numpy(piece, disallowed_special=()))
        else:  # one run without any safe boundary: match by match, as the pattern would
            for match in regex.finditer(enc._pat_str, piece):
                found.append(np.array(enc._encode_single_piece(match[0]), dtype=np.uint32))
    return np.concatenate(found)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, long_chars: int = LONG_CHARS) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns one row per input row: id_col, ids (binary: the token ids as
    little-endian unsigned 32-bit integers), decoded (binary: the bytes the ids
    stand for). A narrow operator: no shuffle, each task holds one Arrow batch.

    Defined cases: a null or empty text has empty ids and empty bytes; repeated
    rows give repeated rows; null ids pass; other columns are ignored; an empty
    table gives an empty table; special tokens do not exist, so their strings are
    ordinary text. `ranks` names a file of the installed public vocabularies, or a
    path that every executor can open."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(public_tokenizers.path(ranks), pattern)
        for batch in it:
            for at in range(0, batch.num_rows, 512):  # output is larger than the input: in parts
                part = batch.slice(at, 512)
                ids, raw = [], []
                for text in part.column(1).to_pylist():
                    tokens = encode_text(enc, text, long_chars) if text else np.empty(0, np.uint32)
                    ids.append(tokens.astype("<u4", copy=False).tobytes())
                    raw.append(enc.decode_bytes(tokens.tolist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, {SCHEMA}")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents")))
