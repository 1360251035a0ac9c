"""Work on each distinct word of a corpus once, wherever and how often it occurs.

A block is a slice of documents with its own word dictionary: the documents hold places in the
dictionary (their positions), so a word travels once per block and not once per occurrence.
The dictionaries are dealt by word to buckets; a bucket works on each of its words once and
sends the results back to the blocks, where they are put in place.

A word that makes up a third of all text is still one entry per block, so no bucket is hot.
A block is bounded by SLICE_BYTES of text (or one longer document).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.spans import (SLICE_BYTES, Coded, arrow_binary, flat, hashes, narrow, pack, pack_binary, ragged, slices, unpack,
                                unpack_binary)

#: Items (words or units) that are put in place at once.
PART_ITEMS = 1 << 18
ROW = "block long, bucket int, keys array<bigint>, payload binary"
ROW_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("payload", pa.binary())])


def blocks_table(rows: DataFrame) -> str | None:
    """The name of the table that rows of staged_blocks() lie in; None if there are no rows."""
    files = rows.inputFiles()
    return next(part for part in files[0].split("/") if part.startswith("llm_blocks_")) if files else None


def drop_blocks(doc_rows: DataFrame) -> None:
    """Drop the table of staged_blocks() when nothing reads it any more."""
    if name := blocks_table(doc_rows):
        doc_rows.sparkSession.sql(f"DROP TABLE {name}")


def drop_words(word_rows: DataFrame) -> None:
    """Drop the dictionaries of staged_blocks() when nothing reads them any more; the documents stay."""
    if name := blocks_table(word_rows):
        word_rows.sparkSession.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (kind = 'words')")


def n_buckets(spark) -> int:
    """As many as shuffle partitions, which a session sets by its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row(block: int, bucket: int, payload: bytes, keys=None) -> pa.RecordBatch:
    keys = pa.array([None], ROW_ARROW.field("keys").type) if keys is None else pa.ListArray.from_arrays(
        pa.array([0, len(keys)], pa.int32()), keys)
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), keys,
                            pa.array([payload], pa.binary())], schema=ROW_ARROW)


def by_bucket(coded: Coded, buckets: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The dictionary in order of buckets, the codes that fit it, and the buckets' bounds."""
    bucket = (hashes(coded.distinct) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.codes], coded.distinct.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1))


def staged_blocks(docs: DataFrame, key: str, text: str, split: Callable[[pa.Array], Coded],
                  counted: Callable[[pa.Array], np.ndarray] | None = None, block_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Document rows (one per block, bucketed by block) and dictionary rows (one per block and
    bucket; with `counted`, a weight of each document by its key: and the word's occurrences by
    weight) in one table of the warehouse."""
    spark = docs.sparkSession
    buckets = n_buckets(spark)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, block_bytes):
                coded = split(part.column(1))
                codes, distinct, at = by_bucket(coded, buckets)
                yield row(block, -1, pack(narrow(codes), narrow(np.diff(coded.bounds))), part.column(0))
                often = np.bincount(codes, np.repeat(counted(part.column(0)), np.diff(coded.bounds)), len(distinct)).astype(
                    np.int64) if counted else None
                for b in np.flatnonzero(np.diff(at)):
                    more = [narrow(often[at[b]:at[b + 1]])] if counted else []
                    yield row(block, int(b), pack_binary(distinct.slice(at[b], at[b + 1] - at[b]), *more))
                block += 1

    name = f"llm_blocks_{uuid.uuid4().hex}"
    (docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, ROW)
     .withColumn("kind", F.when(F.col("bucket") < 0, "docs").otherwise("words"))
     .write.format("parquet").option("compression", "uncompressed").partitionBy("kind").bucketBy(buckets, "block")
     .saveAsTable(name))
    table = spark.table(name)
    return table.filter("kind = 'docs'").drop("kind"), table.filter("kind = 'words'").drop("kind")


def once_per_word(word_rows: DataFrame, work: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], tally: bool = False) -> DataFrame:
    """work(distinct words) -> (flat results, number of results of each word), per bucket; the
    results come back as one row per block and bucket, in the order of its dictionary. `tally`
    (for counted dictionaries): a row of block -1 per bucket holds how often each result occurs."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [unpack_binary(r["payload"]) for r in rows]
        values = [v for v, _ in parts]
        every = pa.concat_arrays(values).dictionary_encode()
        out, counts = work(every.dictionary.to_pylist())
        starts, codes, at, made = np.cumsum(counts) - counts, every.indices.to_numpy(), 0, []
        if tally:
            often = np.bincount(codes, np.concatenate([c for _, c in parts]), len(counts))
            total = np.bincount(out, np.repeat(often, counts)).astype(np.int64)  # exact below 2^53
            made.append(row(-1, rows[0]["bucket"], pack(np.flatnonzero(total), total[total > 0])))
        for r, v in zip(rows, values, strict=True):
            mine = codes[at:at + len(v)]
            at += len(v)
            made.append(row(r["block"], r["bucket"], pack(narrow(counts[mine]), narrow(out[ragged(counts[mine], starts[mine])]))))
        return pa.Table.from_batches(made, ROW_ARROW)

    return word_rows.groupBy("bucket").applyInArrow(run, ROW)


def in_order(parts: pa.Table) -> list[list[np.ndarray]]:
    """The payloads of a block's rows in the order of buckets."""
    return [unpack(p) for _, p in sorted((r["bucket"], r["payload"]) for r in parts.to_pylist())]


def assemble(doc_rows: DataFrame, results: DataFrame,
             finish: Callable[[pa.Array, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Put the results of each block's words in place: finish(keys, flat results of the block's
    documents in order, number of results of each document) -> table."""
    def run(docs: pa.Table, parts: pa.Table) -> pa.Table:
        both = in_order(parts)
        counts = np.concatenate([c.astype(np.int64) for c, _ in both] or [np.empty(0, np.int64)])
        out = np.concatenate([o.astype(np.uint32) for _, o in both] or [np.empty(0, np.uint32)])
        starts, tables = np.cumsum(counts) - counts, []
        for i in range(docs.num_rows):
            codes, n_items = unpack(docs.column("payload")[i].as_py())
            keys, at = docs.column("keys")[i].values, np.concatenate(([0], np.cumsum(n_items, dtype=np.int64)))
            first = 0
            while first < len(keys):  # a part of the documents at a time, for memory
                last = max(first + 1, int(np.searchsorted(at, at[first] + PART_ITEMS, "right")) - 1)
                own = codes[at[first]:at[last]]
                lengths = counts[own]
                ends = np.concatenate(([0], np.cumsum(lengths)))[at[first:last + 1] - at[first]]
                tables.append(finish(keys.slice(first, last - first), out[ragged(lengths, starts[own])], np.diff(ends)))
                first = last
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(tables)

    return doc_rows.groupBy("block").cogroup(results.groupBy("block")).applyInArrow(run, schema)


def ids_table(keys: pa.Array, out: np.ndarray, counts: np.ndarray, key: str = "doc_id") -> pa.Table:
    """One row per document: its ids as little-endian unsigned 32-bit integers."""
    ends = np.concatenate(([0], np.cumsum(counts))) * 4
    return pa.table({key: keys, "n_tokens": pa.array(counts, pa.int64()),
                     "ids": arrow_binary(out.astype("<u4", copy=False).view(np.uint8), ends).cast(pa.binary())})


def ragged_bytes(table: tuple[np.ndarray, np.ndarray], column: pa.Array) -> pa.Array:
    """Each row's ids (little-endian unsigned 32-bit) replaced by the bytes of those entries of a
    table given as (bytes, offsets), one after the other."""
    data, off = table
    raw, at = flat(column)
    ids = raw.view("<u4") if len(raw) else np.empty(0, np.uint32)
    if len(ids) and int(ids.max()) >= len(off) - 1:
        raise ValueError(f"id {int(ids.max())} is beyond the token table")
    lengths = np.diff(off)[ids]
    ends = np.concatenate(([0], np.cumsum(lengths)))[at // 4]
    return arrow_binary(data[ragged(lengths, off[ids])], ends)
