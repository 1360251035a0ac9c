"""Exact top-k inner products with a vector-approximation file.

Every vector is replaced by the numbers of the cells its components fall into (2^bits equal cells
between each component's least and largest value, one byte each). A cell's corners lie equally far to
both sides of its middle, so a scan of the cells bounds the scores of a block of queries against a block
of cells from both sides by one matrix product and a margin per query; the product is in single precision,
and the margin holds what its rounding may add. A first scan gives each query's limit, the k-th best
lower bound over all vectors; in the second a vector stays a candidate while its upper bound is not below
the limit. Then exact vectors are read in the order of their upper bounds: first the `first_read` * k best
of every query, whose k-th exact score is a new limit, and then those left that reach it; after that the
k-th result is certain.

The queries are a stated set. Blocks of them and of the cells are dealt to a grid, each to one row or one
column of it, so that copies grow with the root of the number of tasks; a task holds the cells of its column
and reads its queries block by block. No join may be made by broadcast, as sizes estimated from compressed
files, or before rows are copied, say little of what the driver would hold. Of equal vectors in an Arrow
batch only the rows of the k + 1 smallest distinct ids are searched (k rows of each id at most), as no
others can be among k results (one id may be the query's). Ties go to the smaller id. Vectors that are
null, or hold null or non-finite components, or have another length than most, take no part. Rows that
repeat an id are vectors of their own, as candidates and as queries: every row has a number, by which it
is found again. Rows with the query's id are no candidates of it; the results of a query id are the k best
pairs of any of its rows with a vector, as the SQL states it. k larger than the table gives all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.spans import flat
from voltloom.session import stage

BLOCK = 1024
QUERY_BLOCK = 512
#: Pairs worth a task of its own, tasks that small tables get and tasks a core gets, bytes of cells or of queries a task gets at most.
PAIRS, TASKS, CORE_TASKS, TASK_BYTES = 1 << 28, 32, 8, 32 << 20
#: Candidates that are held before they are given out.
HELD = 1 << 20


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> tuple[DataFrame, int]:
    """row (a number of its own), id and floor(scale * x) of the components (array of long) of the
    vectors that take part, and how many these are."""
    v = F.col(vector)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~wrong).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("x"))
    rows = stage(rows, "va_integers")
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == (common["n"] if common else 0)), common["count"] if common else 0


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def narrowest(least: int, most: int) -> int:
    """Bytes, 2, 4 or 8, of whole numbers that hold both."""
    return next((n for n in (2, 4) if -(1 << 8 * n - 1) <= least and most < 1 << 8 * n - 1), 8)


def grid(vectors: int, queries: int, dims: int, parts: int, cores: int) -> tuple[int, int]:
    """Columns, for the cells, and lines, for the queries, of the grid of tasks, with the fewest bytes copied."""
    tasks = min(parts, max(TASKS, min(vectors * queries // PAIRS, CORE_TASKS * cores)))
    cells, asked = vectors * (dims + 16), queries * (2 * dims + 24)
    lines = max(1, -(-asked // TASK_BYTES), min(tasks, round((tasks * asked / max(1, cells)) ** 0.5)))
    return max(1, -(-cells // TASK_BYTES), -(-tasks // lines)), lines


def blocks(rows: DataFrame, size: int, lanes: int, kind: str) -> DataFrame:
    """lane (a number below `lanes`, in turn), row numbers, ids, packed components and limits of blocks of at most `size` rows."""
    def run(batches):
        turn = None
        for batch in batches:
            bounds = np.linspace(0, batch.num_rows, -(-batch.num_rows // size) + 1).astype(int)
            for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                b = batch.slice(at, end - at)
                turn = hash((b.column(0)[0].as_py(), lanes)) if turn is None else turn + 1
                if kind == "cells":
                    data, limits = flat(b.column(2))[0], b""
                else:
                    x, limits = matrix(b.column(2)), b.column(3).to_numpy().astype("<f8").tobytes()
                    data = x.astype(f"<i{narrowest(int(x.min()), int(x.max()))}")
                yield pa.record_batch([pa.array([turn % lanes], pa.int32()), *(pa.array([x], pa.binary()) for x in (*(b.column(j).to_numpy().astype("<i8").tobytes() for j in (0, 1)), data.tobytes(), limits))],
                                      names=["lane", "rows", "ids", "data", "limits"])

    return rows.mapInArrow(run, "lane int, rows binary, ids binary, data binary, limits binary")


def unpacked(batches, dims: int):
    """Of blocks sorted by the place in the grid, cells first: a list of (row numbers, ids, cells), and each (row numbers, ids, queries, limits) that meets them."""
    part, held = None, []
    for batch in batches:
        at = {n: batch.column(j) for j, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            if at["part"][i].as_py() != part:
                part, held = at["part"][i].as_py(), []
            rows, ids = (np.frombuffer(at[n][i].as_py(), "<i8") for n in ("rows", "ids"))
            data = at["data"][i].as_py()
            if at["asks"][i].as_py():
                yield held, (rows, ids, np.frombuffer(data, f"<i{len(data) // (len(rows) * dims)}").reshape(-1, dims), np.frombuffer(at["limits"][i].as_py(), "<f8"))
            else:
                held.append((rows, ids, np.frombuffer(data, np.uint8).reshape(-1, dims)))


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10,
           scale: int = 1024, bits: int = 6, first_read: int = 2) -> DataFrame:
    """query_id, rank, id, score: the k best vectors of each query id, other ids than its own."""
    (base, count), (asked, asked_count) = (integers(x, key, vector, scale) for x in (vectors, queries))
    edges = base.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.min("x"), F.max("x")).orderBy("d").collect()  # a row per dimension
    if not edges:
        return base.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    low, high = (np.array([e[j] for e in edges], np.int64) for j in (1, 2))
    width = np.maximum(1, -(-(high - low + 1) // (1 << bits)))
    dims = len(low)

    def approximate(batches):
        for batch in batches:
            cells = ((matrix(batch.column(2)) - low) // width).astype(np.uint8)
            # of equal vectors in the batch, the k + 1 smallest distinct ids, and k rows of each
            ids, x = batch.column(1).to_numpy(), matrix(batch.column(2))
            rows = np.ascontiguousarray(x).view(f"V{x.itemsize * dims}").reshape(-1)
            _, same = np.unique(rows, return_inverse=True)
            order = np.lexsort((ids, same))
            group, own = same[order], ids[order]
            new = np.ones(len(order), bool)
            new[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
            nth = np.cumsum(new)  # of the pair of vector and id
            place, repeat = nth - nth[np.searchsorted(group, group)], np.arange(len(order)) - np.flatnonzero(new)[nth - 1]
            keep = np.sort(order[(place <= k) & (repeat < k)])
            yield pa.record_batch([batch.column(0).take(pa.array(keep)), pa.array(ids[keep]), pa.array([r.tobytes() for r in cells[keep]], pa.binary())],
                                  names=["row", "id", "cells"])

    def terms(q):
        """A block of queries, so that product = steps @ cells, and lower, upper = product + shift -+ margin."""
        q = q.astype(np.float64)
        weight, steps, shift = np.abs(q), q * width, q @ (low + (width - 1) / 2)
        most = (weight * width).sum(1) * (1 << bits)
        rounding = most * (dims + 4) * 2.0 ** -22 + weight @ np.abs(low) * dims * 2.0 ** -50
        return steps.astype(np.float32 if most.max() < 1e37 else np.float64), shift, weight @ (width - 1) / 2 + rounding

    def reached(product, bar):
        """Query and vector of the products that are `bar` or more, and maybe some that round to it."""
        at = np.flatnonzero(product >= np.nextafter(bar.astype(product.dtype), product.dtype.type(-np.inf))[:, None])
        return at // product.shape[1], at % product.shape[1]

    def nearest(query, lower):
        """The k best of each query, in order."""
        order = np.lexsort((-lower, query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        return query[order], lower[order]

    def best(batches):
        """The k best lower bounds of each query in the column."""
        for cells, (qrows, qids, q, _) in unpacked(batches, dims):
            steps, shift, margin = terms(q)
            limit, query, lower = np.full(len(q), -np.inf), np.empty(0, np.int64), np.empty(0)
            for _, ids, c in cells:
                product = steps @ c.T.astype(steps.dtype)
                new = np.flatnonzero(np.isneginf(limit))
                if len(new) and len(ids) > k:
                    others = np.where(qids[new, None] == ids[None, :], -np.inf, product[new])
                    limit[new] = np.partition(others, len(ids) - k, axis=1)[:, len(ids) - k] + (shift - margin)[new]
                a, b = reached(product, limit - shift + margin)
                other = qids[a] != ids[b]
                a, b = a[other], b[other]
                query, lower = np.concatenate((query, a)), np.concatenate((lower, product[a, b] + (shift - margin)[a]))
                if len(query) > 3 * k * len(q):
                    query, lower = nearest(query, lower)
                    full = np.flatnonzero(np.bincount(query, minlength=len(q)) == k)
                    limit[full] = np.maximum(limit[full], lower[np.searchsorted(query, full, "right") - 1])
            query, lower = nearest(query, lower)
            yield pa.record_batch([pa.array(qrows[query]), pa.array(lower)], names=["query", "lower"])

    def bound(batches):
        """The pairs whose upper bound reaches the query's limit."""
        for cells, (qrows, qids, q, limit) in unpacked(batches, dims):
            (steps, shift, margin), held = terms(q), []
            for at, (rows, ids, c) in enumerate(cells):
                product = steps @ c.T.astype(steps.dtype)
                a, b = reached(product, limit - shift - margin)
                upper = product[a, b] + (shift + margin)[a]
                good = (upper >= limit[a]) & (qids[a] != ids[b])
                held.append((qrows[a[good]], qids[a[good]], rows[b[good]], ids[b[good]], upper[good]))
                if at + 1 == len(cells) or sum(len(x[0]) for x in held) > HELD:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["query", "query_id", "row", "id", "upper"])
                    held = []

    spark = base.sparkSession
    columns, lines = grid(count, asked_count, dims, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = ("rows", "ids", "data", "limits")

    def dealt(asked: DataFrame) -> DataFrame:
        """Blocks of the cells, before blocks of the queries with their limits, each place of the grid in one task."""
        cells = blocks(base.mapInArrow(approximate, "row bigint, id bigint, cells binary"), BLOCK, columns, "cells")
        queries = blocks(asked, QUERY_BLOCK, lines, "exact")
        return (cells.select(F.col("lane").alias("column"), number(lines).alias("line"), F.lit(0).alias("asks"), *packed)
                .unionByName(queries.select(number(columns).alias("column"), F.col("lane").alias("line"), F.lit(1).alias("asks"), *packed))
                .select((F.col("column") * lines + F.col("line")).alias("part"), "asks", *packed)
                .repartitionById(columns * lines, "part").sortWithinPartitions("part", "asks"))

    by_query = Window.partitionBy("query")

    def kth(pairs: DataFrame, score: str) -> DataFrame:
        return pairs.withColumn("r", F.row_number().over(by_query.orderBy(F.desc(score)))).filter(F.col("r") == k).select("query", F.col(score).alias("limit")).hint("merge")

    limits = kth(dealt(asked.withColumn("limit", F.lit(float("-inf")))).mapInArrow(best, "query bigint, lower double"), "lower")
    limited = asked.withColumnRenamed("row", "query").join(limits, "query", "left").select("query", "id", "x", F.coalesce("limit", F.lit(float("-inf"))).alias("limit"))
    found = dealt(limited).mapInArrow(bound, "query bigint, query_id bigint, row bigint, id bigint, upper double")
    ranked = stage(found.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("upper"), "id", "row"))), "va_ranked")

    x = F.col("x").cast({2: "array<smallint>", 4: "array<int>", 8: "array<bigint>"}[narrowest(int(low.min()), int(high.max()))])

    def exact(pairs: DataFrame) -> DataFrame:
        q = asked.select(F.col("row").alias("query"), F.col("x").alias("q"))
        score = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return pairs.join(base.select("row", x.alias("x")).hint("merge"), "row").join(q.hint("merge"), "query").select("query", "query_id", "id", "row", score.alias("score"))

    early = stage(exact(ranked.filter(F.col("r") <= first_read * k).select("query", "query_id", "row", "id")), "va_early")
    late = ranked.filter(F.col("r") > first_read * k).join(kth(early, "score"), "query", "left").filter(
        F.col("limit").isNull() | (F.col("upper") >= F.col("limit"))).select("query", "query_id", "row", "id")
    every = early.unionByName(exact(late))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top10(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.filter("vec_id % 100 = 0")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
