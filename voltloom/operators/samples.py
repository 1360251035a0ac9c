"""Reproducible samples by hash: the rows of the n lowest hashes per key.

The sample of a union is the sample of the samples, so chunks can be drawn from on their own
and merged. No key is put in order: counts per range of hashes give a cutoff per key, and the
ranges grow with the hash, so hardly more rows than are wanted pass it at any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordered import up_to_here
from voltloom.operators.ranks import value_bin

RANGES_PER_OCTAVE = 64   # 60 octaves; the last range of a key holds about 1 % of the rows below it


def hash60(*parts: str | Column, seed: int = 42) -> Column:
    """The first 60 bits of the MD5 of the seed and the parts as text, divided by '|'; a NULL part
    is a backslash."""
    texts = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\\")) for c in texts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sample(df: DataFrame, ids: list[str], n: int, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Up to n rows per key, those of the lowest hashes of `ids`; without keys of the whole table.

    Ties of the hash go to the smaller ids, and of rows alike in them one is as good as another.
    NULL keys are a key of their own. A key with up to n rows stays whole.
    """
    keys = list(keys or [])
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                  *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)],
                  F.struct(hash60(*[F.col(f"`{c}`") for c in ids], seed=seed).alias("h"), *[
                      F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(ids)]).alias("_h"))
    d = d.withColumn("_range", value_bin(F.col("_h.h") + 1, RANGES_PER_OCTAVE))
    by = [f"_k{i}" for i in range(len(keys))] or [F.lit(0)]
    counts = d.groupBy(*(by if keys else []), "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(up_to_here(Window.partitionBy(*by).orderBy("_range"))) - F.col("_n")   # 3,840 ranges a key
    cut = counts.withColumn("_before", before).filter(F.col("_before") < n).groupBy(*(by if keys else [])).agg(F.max("_range").alias("_last"))
    c = cut.select(F.col("_last"), *[F.col(f"_k{i}").alias(f"_c{i}") for i in range(len(keys))])
    near = F.col("_range") <= F.col("_last")
    for i in range(len(keys)):
        near = near & F.col(f"_k{i}").eqNullSafe(F.col(f"_c{i}"))
    if keys:
        few = d.join(c, near)
    else:
        last = c.first()._last   # one number
        few = d.filter(F.col("_range") <= last) if last is not None else d.limit(0)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    return few.withColumn("_r", rank).filter(F.col("_r") <= n).select("_row.*")


def merge_samples(parts: list[DataFrame], ids: list[str], n: int, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """The sample of all chunks from the samples of each, drawn with the same arguments."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return sample(out, ids, n, keys, seed)
