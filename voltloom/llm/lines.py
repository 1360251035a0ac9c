"""Line deduplication by range-partitioned hashes, with built-in functions only.

Lines are hashed (128 bits), dealt by range of (hash, slice of the document ids) and sorted by
document and position inside each group, so that a stream meets the first document of every
group first; a line held by a third of all documents is spread over SALTS groups. The first
documents of a hash's groups, at most SALTS of them, then settle its owner. What comes back is
one sparse bitmap per document: the 64-line words that have a dropped line. Text does not move
until the bitmaps are applied.

Rules. A line's key is the line without white space at both ends and with A-Z in lower case. Keys
of at least `least` code points found in two or more documents lose all their lines except in the
smallest key of a document. Null and empty texts are one empty line. Rows without a document key
hold no lines of others back and keep all their own. Rows that repeat a document key count as one
document. Other columns of the rows are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.rows import new_names, quoted, unwrapped, wrapped
from voltloom.session import stage

SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; `lower` is the faster way where no other characters are met."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """h1, h2 (128 bits of the line's key), doc, version (of the text) and pos."""
    lines = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(line_array(F.col(text))).alias("pos", "line"))
    keys = lines.select("doc", "version", "pos", F.btrim("line", F.lit(" \t\n\x0b\f\r")).alias("line")).filter(
        F.char_length("line") >= least).withColumn("line", ascii_lower(F.col("line")))
    return keys.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "version", "pos")


def drop_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """doc, version, dropped (map of 64-line word to its bits), n_dropped: documents that lose lines."""
    hashed = stage(line_hashes(docs, key, text, least), "line_hashes")
    group = Window.partitionBy("h1", "h2", "salt")
    streamed = (hashed.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
                .repartitionByRange("h1", "h2", "salt")
                .withColumn("first_doc", F.first("doc").over(group.orderBy("doc", "pos"))))
    later = streamed.filter("doc > first_doc")
    # first documents only: at most SALTS per hash
    owners = (streamed.filter("doc = first_doc")
              .withColumn("owner", F.min("doc").over(Window.partitionBy("h1", "h2"))).filter("doc > owner"))
    lost = later.select("doc", "version", "pos").unionByName(owners.select("doc", "version", "pos"))
    bits = lost.groupBy("doc", "version", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return bits.groupBy("doc", "version").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """The rows with `text` reduced to the lines kept (null becomes empty), and n_lines, n_dropped."""
    new_names(docs, "n_lines", "n_dropped")
    maps = drop_bitmaps(docs, key, text, least)
    both = wrapped(docs, k=F.col(key), v=F.xxhash64(text)).join(maps, (F.col("k") == F.col("doc")) & (F.col("v") == F.col("version")), "left")
    body = f"row.{quoted(text)}"
    kept = F.expr(f"array_join(filter(split(coalesce({body}, ''), '\\n', -1), (l, i) -> "
                  "(shiftright(coalesce(dropped[shiftright(i, 6)], 0L), i & 63) & 1L) = 0L), '\\n')")
    whole = F.expr(f"coalesce({body}, '')")
    n_lines = (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"))) + 1).cast("bigint").alias("n_lines")
    dropped = F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped")
    return unwrapped(both, docs, n_lines, dropped, **{text: F.when(F.col("dropped").isNull(), whole).otherwise(kept)})


def digests(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.*, coalesce(k.doc_id > o.owner, false) AS lost FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
