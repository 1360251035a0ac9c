"""Byte-level BPE over a whole corpus, encoding each distinct word once, and decoding.

Texts are cut into units (white space with the word after it), which hold whole matches of
public_tokenizers.PATTERN. Each block of documents sends its distinct units to buckets by hash;
a bucket encodes each of its units once with tiktoken; the ids go back to the blocks and are put
together by position. Decoding looks ids up in the table of token bytes, which is bounded by the
vocabulary (50,256 entries) and travels with the task.

Null and empty texts have no ids and decode to no bytes. A null key stays null; repeated rows
are encoded as any others; a table without rows gives none.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from voltloom.llm.distinct import assemble, ids_table, once_per_word, ragged_bytes, staged_blocks
from voltloom.llm.kept import once_per_worker
from voltloom.llm.spans import units

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@once_per_worker
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@once_per_worker
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@once_per_worker
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in the order of ids, and where each starts."""
    table = ranks(path)
    tokens = [b""] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of every row."""
    path = path or vocabulary_path()

    def work(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        one = encoder(path).encode_ordinary
        got = [one(w.decode()) for w in words]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(counts.sum())), counts

    doc_rows, words = staged_blocks(docs, key, text, units)
    return assemble(doc_rows, once_per_word(words, work), lambda keys, out, counts: ids_table(keys, out, counts, key),
                    f"{key} bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """The rows with the bytes of their ids as a further column; null ids decode to no bytes."""
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                got = ragged_bytes(token_bytes(path), part.column(at)).cast(pa.binary())
                yield pa.record_batch([*part.columns, got], names=[*part.schema.names, out])

    if out in encoded.columns:
        raise ValueError(f"the rows have a column {out} already")
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded bytes."""
    return decode(encoded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                  F.sha2("decoded", 256).alias("decoded_sha256"))
