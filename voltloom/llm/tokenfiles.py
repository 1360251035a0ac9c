"""Token ids of a corpus in files of byte-aligned variable-length numbers.

Ids are replaced by their rank of frequency over the whole corpus, so frequent ids take one byte.
A document's ranks are stored as data bytes (1 to 4 per rank, little-endian) and separate control
bytes (two bits per rank: bytes less one; four ranks per control byte), and read back with a
256-row table of lengths and a gather per byte. Each distinct word of the corpus is encoded once
by the tokenizers library (voltloom.llm.distinct), which gives the whole text's ids because this
vocabulary's pattern never matches across white space and its special tokens hold none.

Files: documents in ascending key order over all files (range partitions, sorted), frames of about
FRAME_TOKENS ids, each with its checksum; the rank table; a manifest with the first position of
every file. Files get their name when they are complete; readers go by the manifest.

Null and empty texts hold the end id only. Null keys come first. Rows that repeat a key are
documents of their own, in the order of their bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltloom.llm.distinct import assemble, drop_blocks, once_per_word, staged_blocks
from voltloom.llm.files import Shard, discard, new_folder, opened
from voltloom.llm.kept import once_per_worker
from voltloom.llm.spans import arrow_binary, flat, ragged, unpack, words
from voltloom.session import stage

VOCABULARY, END, SPLIT = "word_bpe_49k.json", 2, "<|endoftext|>"
FRAME_TOKENS = 1 << 20
#: Text of a block.
BLOCK_BYTES = 8 << 20
MAGIC = b"RVB1"
MANIFEST = "shard int, name string, documents bigint, tokens bigint, bytes bigint"
#: Lengths of the four numbers of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@once_per_worker
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_words(batch: list[bytes], path: str, many: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the words and how many each has. Words go through the library `many` at a time,
    with a special token between them, at which it cuts a text first; words with such a token go alone."""
    tok = tokenizer(path)
    split = tok.token_to_id(SPLIT)
    flat_ids, counts = [], np.zeros(len(batch), np.int64)
    texts = [w.decode() for w in batch]
    for at in range(0, len(texts), many):
        part = texts[at:at + many]
        if any("<|" in w or "|>" in w for w in part):
            for i, w in enumerate(part):
                ids = tok.encode(w, add_special_tokens=False).ids
                counts[at + i] = len(ids)
                flat_ids.append(np.array(ids, np.uint32))
            continue
        ids = np.array(tok.encode(SPLIT.join(part), add_special_tokens=False).ids, np.uint32)
        cut = np.flatnonzero(ids == split)
        counts[at:at + len(part)] = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
        flat_ids.append(np.delete(ids, cut))
    return np.concatenate(flat_ids or [np.empty(0, np.uint32)]), counts


def vbytes(ranks: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control bytes and data bytes of each document."""
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    ends = np.cumsum(counts)
    place = np.arange(len(ranks)) - np.repeat(ends - counts, counts)
    fours = np.flatnonzero(place & 3 == 0)
    code = (size - 1).astype(np.uint8) << (2 * (place & 3)).astype(np.uint8)
    control = np.add.reduceat(code, fours, dtype=np.uint8) if len(fours) else np.empty(0, np.uint8)
    raw = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    at = np.concatenate(([0], np.cumsum((counts + 3) // 4))), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[np.concatenate(([0], ends))]
    return arrow_binary(control, at[0]), arrow_binary(data, at[1])


def vbytes_decoded(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents of `counts` numbers, by table lookup."""
    whole = (counts + 3) // 4
    start = 4 * (np.cumsum(whole) - whole)
    size = LENGTHS[control].reshape(-1)[ragged(counts, start)]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def rank_table(tally: DataFrame, n_docs: int, end: int) -> np.ndarray:
    """All ids that occur, most frequent first: at most one row per entry of the vocabulary."""
    def run(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                ids, counts = unpack(payload)
                yield pa.record_batch([pa.array(ids.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["id", "n"])

    rows = tally.select("payload").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect()
    often = {r[0]: r[1] for r in rows}
    often[end] = often.get(end, 0) + n_docs
    return np.array(sorted(often, key=lambda i: (-often[i], i)), "<u4")


def write(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", path: str | None = None,
          end: int = END) -> tuple[str, DataFrame]:
    """Encode every text, append `end`, write the files; the folder and its manifest."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    folder = folder or new_folder(spark, "tokens")
    doc_rows, word_rows = staged_blocks(docs, key, text, words, lambda keys: np.ones(len(keys)), BLOCK_BYTES)
    results = stage(once_per_word(word_rows, lambda w: encode_words(w, path), tally=True), "token_words")
    order = rank_table(results.filter("block = -1"), docs.count(), end)
    ranks = np.zeros(int(order.max()) + 1, np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)

    def finish(keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
        all_ids = np.insert(ids, np.cumsum(counts), end)
        control, data = vbytes(ranks[all_ids], counts + 1)
        return pa.table({"doc": keys, "n": pa.array(counts + 1), "control": control.cast(pa.binary()), "data": data.cast(pa.binary())})

    coded = stage(assemble(doc_rows, results.filter("block >= 0"), finish, "doc bigint, n bigint, control binary, data binary"), "token_bytes")
    drop_blocks(doc_rows)
    discard(results)
    dealt = coded.repartitionByRange("doc", "n").sortWithinPartitions("doc", "n", "control", "data")

    def run(batches):
        shard, out, tokens, documents = TaskContext.get().partitionId(), None, 0, 0
        name = f"tokens-{shard:05d}.rvb"
        for batch in batches:
            n = batch.column(1).to_numpy()
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // FRAME_TOKENS)) + 1):
                if not len(part):
                    continue
                if out is None:
                    out = Shard(folder, name)
                    out.write(MAGIC)
                rows = batch.slice(int(part[0]), len(part))
                present = rows.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                arrays = [rows.column(0).fill_null(0).to_numpy().astype("<i8"), present, n[part].astype("<i8"), flat(rows.column(2))[0], flat(rows.column(3))[0]]
                body = b"".join(a.tobytes() for a in arrays)
                out.write(np.array([len(part), *(a.nbytes for a in arrays), zlib.crc32(body)], "<i8").tobytes() + body)
                tokens, documents = tokens + int(n[part].sum()), documents + len(part)
        if out is not None:
            out.commit()
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name]), pa.array([documents]), pa.array([tokens]), pa.array([out.size])],
                                  names=["shard", "name", "documents", "tokens", "bytes"])

    table = Shard(folder, "ranks.bin")
    table.write(order.tobytes())
    table.commit()
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return folder, spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def frames(stream):
    """doc keys, their validity, counts, control bytes and data bytes of each frame of a file."""
    if stream.read(4) != MAGIC:
        raise ValueError("not a token file")
    while head := stream.read(56):
        _, *sizes, crc = np.frombuffer(head, "<i8").tolist()
        body = stream.read(sum(sizes))
        if len(body) != sum(sizes) or zlib.crc32(body) != crc:
            raise ValueError("damaged frame")
        at = np.cumsum([0, *sizes])
        yield [np.frombuffer(body[a:b], kind) for a, b, kind in zip(at, at[1:], ("<i8", np.uint8, "<i8", np.uint8, np.uint8), strict=False)]


def read(spark: SparkSession, folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    files = manifest.withColumn("first", F.coalesce(F.sum("tokens").over(  # a row per file
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))).select("name", "first")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        fs, top = opened(folder)
        order = None
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if order is None:
                    with fs.open_input_stream(f"{top}/ranks.bin") as s:
                        order = np.frombuffer(s.read(), "<u4")
                with fs.open_input_stream(f"{top}/{name}") as s:
                    for keys, present, counts, control, data in frames(s):
                        ids = order[vbytes_decoded(control, data, counts)]
                        ends = np.cumsum(counts)
                        yield pa.record_batch([pa.array(keys, mask=present == 0), pa.array(first + ends - counts), pa.array(counts),
                                               arrow_binary(ids.view(np.uint8), np.concatenate(([0], ends)) * 4).cast(pa.binary())],
                                              names=[key, "start", "n_tokens", "ids"])
                        first += int(ends[-1])

    return files.repartition(spread, "name").mapInArrow(run, f"{key} bigint, start bigint, n_tokens bigint, ids binary")


def digests(docs: DataFrame) -> DataFrame:
    folder, manifest = write(docs)
    return read(docs.sparkSession, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
