"""WARC archives from a table of pages, written by sorted shards, and read back.

Records are ordered by key, payload and url and cut into shards at exact positions of that order,
so the cuts are those of the data, whatever its order, its partitions and the session's settings.
Each shard is one task, which writes its records, one gzip member each, into files that are closed
once they have `roll_bytes` compressed bytes. Headers, record ids and digests depend on the record
alone, so every run gives the same files. A file is written under a temporary name and moved; the
manifest (one row per file: name, bytes, records, SHA-256) is written last, and readers go by it.

Of records with equal payloads of at least `least` bytes the one with the smallest key is the
response, and the others are revisits that name it and hold no payload; smaller payloads are
responses always. The owner of a payload comes from a grouped minimum over digests, so copies
that make up a third of all pages do not meet in one task.

A null payload is empty. A null url is named after the key. Pages without a key are responses
without one. Rows that repeat a key are records of their own; rows that repeat key, url and payload
are numbered, and beyond `REPEATS` of them travel as one row with a count and are written in parts.
A table without rows gives no file. Columns besides key, url and payload are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.files import Shard, new_folder, opened
from voltloom.session import stage

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, part int, name string, bytes bigint, records bigint, sha256 string"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, record_id string"


#: Rows of one record that may travel as rows.
REPEATS = 4096
#: Payload of a shard, and the most shards there are (their cuts are sent to every task).
SHARD_BYTES, SHARDS = 16 << 20, 1 << 16
ORDER = ["page", "version", "place", "chunk"]


def names(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """What tells records apart: the key, a hash of the payload and one of the url, with both."""
    return pages.select(F.col(key).cast("bigint").alias("page"), F.xxhash64(F.coalesce(payload, F.lit(""))).alias("version"), F.xxhash64(F.col(url).cast("string")).alias("place"),
                        F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))


def payload_facts(rows: DataFrame, least: int) -> DataFrame:
    """page, version, place, digest, size, n (rows), owner and owner_place (null for responses) of every record."""
    facts = stage(rows.groupBy("page", "version", "place", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("size"))
                  .agg(F.count(F.lit(1)).alias("n")), "warc_facts")
    owners = facts.filter((F.col("size") >= least) & F.col("page").isNotNull()).groupBy("digest").agg(
        F.min(F.struct("page", "place")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    later = F.col("page") > F.col("first.page")
    return facts.join(owners.select("digest", "first"), "digest", "left").select(
        "page", "version", "place", "digest", "size", "n", F.when(later, F.col("first.page")).alias("owner"), F.when(later, F.col("first.place")).alias("owner_place"))


def ordered_facts(facts: DataFrame) -> DataFrame:
    """The facts in parts of at most REPEATS rows (chunk, times), written in order; part and at are places in what was written."""
    last = F.floor((F.col("n") - 1) / REPEATS).cast("bigint")
    parts = facts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    parts = parts.withColumn("times", F.least(F.lit(REPEATS), F.col("n") - F.col("chunk") * REPEATS))
    dealt = parts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return stage(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "warc_order")


def cuts(ordered: DataFrame, shard_bytes: int) -> list:
    """First record of every shard but the first: each shard has the same number of records, and the last the rest."""
    sizes = {r["part"]: (r["c"], r["b"]) for r in ordered.groupBy("part").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("size") * F.col("times")).alias("b")).collect()}
    total, weight = (sum(x) for x in zip(*sizes.values(), strict=True)) if sizes else (0, 0)
    step = max(1, -(-total // max(1, min(SHARDS, -(-weight // shard_bytes)))))
    before, wanted = 0, []
    for part in sorted(sizes):
        count = sizes[part][0]
        wanted.append((part, -before % step))
        before += count
    if not wanted:
        return []
    begins = ordered.sparkSession.createDataFrame(wanted, "part int, begin bigint")
    found = ordered.join(begins, "part").filter((F.col("at") >= F.col("begin")) & (F.pmod(F.col("at") - F.col("begin"), F.lit(step)) == 0))
    rows = found.select("part", "at", *ORDER).collect()
    return [tuple(r[c] for c in ORDER) for r in sorted(rows, key=lambda r: (r["part"], r["at"]))][1:]


def with_shard(rows: DataFrame, bounds: list) -> DataFrame:
    """The number of bounds that are not beyond the row, by bisection."""
    fields = "none boolean, page bigint, version bigint, place bigint, chunk bigint"
    table = json.dumps([dict(zip(["none", *ORDER], (p is not None, p or 0, *rest), strict=True)) for p, *rest in bounds])
    known = F.from_json(F.lit(table), f"array<struct<{fields}>>")
    own = F.struct(F.col("page").isNotNull().alias("none"), F.coalesce("page", F.lit(0).cast("bigint")).alias("page"), "version", "place", "chunk")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))]) if bounds else None
    if steps is None:
        return rows.withColumn("shard", F.lit(0))
    return rows.withColumn("shard", F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.try_element_at(known, at + step) <= own), at + step).otherwise(at)))


def record_id(page: int | None, digest: str, place: int, number: int = 0) -> str:
    """Names the record of a page, payload and url, and the how manieth of its kind it is."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}:{digest}:{place}:{number}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, place: int, number: int,
           owner: int | None, owner_place: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = payload if owner is None else b""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    block = hashlib.sha256(http)
    block.update(body)
    head = ["WARC/1.1", f"WARC-Type: {'response' if owner is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest, place, number)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{block.hexdigest()}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(http) + len(body)}"]
    if page is not None:
        head.append(f"Page-Id: {page}")
    if owner is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(owner, digest, owner_place)}", f"Refers-To-Page-Id: {owner}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html",
          least: int = 100, roll_bytes: int = 256 << 20, level: int = 4, shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Write all rows; the folder and its manifest."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = names(pages, key, url, payload)
    facts = ordered_facts(payload_facts(rows, least))
    bounds = cuts(facts, shard_bytes)
    many = facts.filter(F.col("n") > REPEATS)
    sent = rows.withColumns({"chunk": F.lit(0).cast("bigint"), "times": F.lit(1).cast("bigint")})
    if many.take(1):  # records repeated very often: one row for each part of their rows
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ORDER[:3]]
        hot = many.filter("chunk = 0").select(*ORDER[:3]).alias("m")
        one = rows.alias("r").join(hot, same, "left_semi").groupBy(*ORDER[:3]).agg(F.first("url").alias("url"), F.first("payload").alias("payload"))
        parts = one.alias("r").join(many.select(*ORDER, "times").alias("m"), same).select("r.*", "m.chunk", "m.times")
        sent = sent.alias("r").join(hot, same, "left_anti").unionByName(parts)
    # a record and its facts travel together and meet as neighbours, facts first
    own = ["digest", "size", "owner", "owner_place"]
    both = facts.select(*ORDER, *own, F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(0).cast("bigint").alias("times")).unionByName(
        sent.withColumns({c: F.lit(None).cast("string" if c == "digest" else "bigint") for c in own}))
    shards = len(bounds) + 1
    dealt = with_shard(both, bounds).repartitionById(shards, "shard").sortWithinPartitions(*ORDER, "times")
    wanted = ["shard", *ORDER, "url", "payload", "times", *own]

    def run(batches):
        shard, part, out, count, sha, facts_, number = None, 0, None, 0, None, None, 0

        def close():
            out.commit()
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([name]),
                                    pa.array([out.size], pa.int64()), pa.array([count], pa.int64()), pa.array([sha.hexdigest()])],
                                   names=["shard", "part", "name", "bytes", "records", "sha256"])

        try:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in wanted]
                for i in range(batch.num_rows):
                    shard, page, _, place, chunk, address, body, times, *more = (c[i].as_py() for c in columns)
                    if not times:
                        facts_, number = more, chunk * REPEATS
                        continue
                    digest, size, owner, owner_place = facts_
                    for _ in range(times):
                        if out is None:
                            name, count, sha = f"pages-{shard:05d}-{part:05d}.warc.gz", 0, hashlib.sha256()
                            out = Shard(folder, name)
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        data = pack.compress(record(page, address, body, digest, size, place, number, owner, owner_place)) + pack.flush()
                        out.write(data)
                        sha.update(data)
                        count, number = count + 1, number + 1
                        if out.size >= roll_bytes:
                            done, out = close(), None
                            part += 1
                            yield done
            if out is not None:
                done, out = close(), None
                yield done
        finally:
            if out is not None:  # the task failed
                out.abandon()

    dealt.select(*wanted).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return folder, pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(stream, size: int = 1 << 20):
    """The uncompressed records of a file, one gzip member each."""
    unpack, got, data = zlib.decompressobj(31), [], b""
    while data := data or stream.read(size):
        got.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(got)
            unpack, got = zlib.decompressobj(31), []
    if got and any(got):
        raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> dict:
    """The facts of one record; a wrong digest or length is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if x is not None else None
    return {"page_id": number(fields.get("Page-Id")), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number(fields.get("Refers-To-Page-Id")), "url": fields["WARC-Target-URI"],
            "record_id": fields["WARC-Record-ID"], "payload": payload}


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the files that the manifest names."""
    columns = [x.split()[0] for x in READ.split(", ")]

    def run(batches):
        fs, top = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        rows.append(parse(raw))
                        rows[-1].pop("payload")
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in READ.split(", "))])
    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name").repartition(spread, "name").mapInArrow(run, READ).select(*columns)


def digests(pages: DataFrame) -> DataFrame:
    return read(*write(pages)).drop("url", "record_id")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > owner THEN owner END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""
