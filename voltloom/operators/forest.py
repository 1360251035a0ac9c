"""Model D: a random forest of every key at once, grown over cells of equal features.

A tree cannot tell rows with the same hour, weekday, month, flags and occupancy bin apart, so the
rows are summed into such cells first: per tree, the bootstrap weights (Poisson, drawn from the MD5
of the row's key and time) and the weighted target. The sums are combined before they are shuffled,
and the cells of a key are bounded by its features and BINS, whatever the number of rows; so one
tree of one key is a small group, and all trees of all keys grow side by side in one job. There is
no loop over keys, trees or depths on the driver.

A tree grows level by level for all its nodes together: histograms of weight and target by (node,
feature, value), the split with the largest gain in squared error of every node, ties to the first
column in FEATURES' order. The same trees give the answers of every depth asked for: each cell
carries the mean of the node it has come down to. Rows without weight (validation, test, left out of
the draw) come down with their cells, so predictions are a join by cell and no tree is walked.

Splits are on single dummy columns, the flags, and occupancy at the edges of its exact quantile bins
(every value is an edge if there are no more than BINS). A key without training rows has no forest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.config import WEEKDAYS
from voltloom.operators.ranks import COUNT
from voltloom.session import stage

BINARIES = ("is_weekend", "is_semester", "is_working_day")
FEATURES = (*[f"hour_{h}" for h in range(1, 24)], *[f"weekday_{d}" for d in WEEKDAYS[1:]],
            *[f"month_{m}" for m in range(2, 13)], *BINARIES, "occupancy")
BINS, MIN_LEAF = 64, 5
DEPTHS = (2, 4, 6, 8, 12, 16, 24, None)
#: Values of the parts of a cell's number, from the last: occupancy bin, flags, month, weekday, hour.
PARTS = (("occupancy", 128), *[(b, 2) for b in BINARIES[::-1]], ("month", 13), ("weekday", 7), ("hour", 24))
#: A draw of 16 bits is a weight of as many as it reaches of these (Poisson with mean 1).
POISSON = tuple(int(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8))


def edges(train: DataFrame, keys) -> DataFrame:
    """Per key, the occupancies that bins end at: exact quantiles, on counted values."""
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    counted = train.groupBy(*keys, F.col("occupancy").cast("double").alias("_v")).agg(F.count(F.lit(1)).alias(COUNT))
    return counted.groupBy(*keys).agg(F.array_distinct(F.percentile("_v", probs, F.col(COUNT))).alias("_edges"))


def cell_code() -> Column:
    value = {"hour": F.col("hour"), "month": F.col("month"), "occupancy": F.size(F.filter("_edges", lambda e: e < F.col("occupancy"))),
             "weekday": F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.col("weekday")) - 1, **{b: F.col(b).cast("int") for b in BINARIES}}
    code = F.lit(0).cast("bigint")
    for name, size in reversed(PARTS):
        code = code * size + value[name]
    return code


def with_cells(rows: DataFrame, keys) -> DataFrame:
    """The rows with `cell`, by the occupancy bins of the training rows."""
    return rows.join(edges(rows.filter("split = 'train'"), keys), list(keys)).withColumn("cell", cell_code()).drop("_edges")


def weighted(rows: DataFrame, keys, trees: int, target: str, seed: int) -> DataFrame:
    """Per key, tree and cell: drawn training rows `w` and their target `wy`."""
    ident = [F.col(k).cast("string") for k in keys]
    drawn = (rows.select(*keys, "cell", F.col(target).cast("double").alias("_y"), (F.col("split") == "train").alias("_t"),
                         F.concat_ws("|", F.lit(str(seed)), *ident, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("_id"))
             .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // 8))))
             .withColumn("_h", F.md5(F.concat_ws("|", "_id", F.col("_j").cast("string"))))
             .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(7)))).filter(F.col("_j") * 8 + F.col("_i") < trees))
    u = F.conv(F.substr("_h", F.col("_i") * 4 + 1, F.lit(4)), 16, 10).cast("int")
    w = F.when(F.col("_t"), sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))).otherwise(0).cast("double")
    return drawn.withColumn("_w", w).groupBy(*keys, (F.col("_j") * 8 + F.col("_i")).alias("tree"), "cell").agg(
        F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wy"))


def histograms(part: dict[str, np.ndarray], node: np.ndarray, nodes: int, x: np.ndarray) -> np.ndarray:
    """Sums of x that a column's split takes out of every node: (nodes, columns)."""
    out = []
    for name, size in reversed(PARTS):
        h = np.bincount(node * size + part[name], x, nodes * size).reshape(nodes, size)
        first = {"hour": 1, "weekday": 1, "month": 2}.get(name, 1)
        out.append(np.cumsum(h, 1)[:, :-1] if name == "occupancy" else h[:, first:])
    return np.hstack(out)


def columns() -> list[tuple[str, int]]:
    """(part, value) of every column of `histograms`."""
    out = []
    for name, size in reversed(PARTS):
        out += [(name, v) for v in (range(size - 1) if name == "occupancy" else range(2 if name == "month" else 1, size))]
    return out


def grown(cell: np.ndarray, w: np.ndarray, wy: np.ndarray, depths) -> tuple[np.ndarray, np.ndarray]:
    """(cells, depths) means of the nodes that cells come down to, and each column's total gain."""
    part, rest = {}, cell.copy()
    for name, size in PARTS:
        rest, part[name] = np.divmod(rest, size)
    split_on = columns()
    names = np.array([p for p, _ in split_on])
    mean = np.full(len(cell), wy.sum() / w.sum())
    scale = max(mean[0] * wy.sum(), 1e-300)
    gains, out, last = np.zeros(len(split_on)), np.empty((len(cell), len(depths))), max((d for d in depths if d is not None), default=0)
    node, live, level = np.zeros(len(cell), np.int64), np.arange(len(cell)), 0
    while True:
        for i, d in enumerate(depths):
            if d == level:
                out[:, i] = mean
        if not len(live) or (level >= last and None not in depths):
            break
        at, here = np.unique(node[live], return_inverse=True)
        own = {k: v[live] for k, v in part.items()}
        n, s = (np.bincount(here, x[live], len(at))[:, None] for x in (w, wy))
        ni, si = (histograms(own, here, len(at), x[live]) for x in (w, wy))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = si * si / ni + (s - si) ** 2 / (n - ni) - s * s / n
        gain = np.where((ni >= MIN_LEAF) & (n - ni >= MIN_LEAF), np.round(gain / scale, 9), 0)
        best = gain.argmax(1)
        ok = gain[np.arange(len(at)), best] > 0
        np.add.at(gains, best[ok], gain[ok, best[ok]])
        value = np.array([v for _, v in split_on])[best][here]
        inside = np.zeros(len(live), bool)
        for name in part:
            mine = (names[best] == name)[here]
            inside |= mine & (own[name] <= value if name == "occupancy" else own[name] == value)
        live, here, inside = live[ok[here]], here[ok[here]], inside[ok[here]]
        node[live] = 2 * here + inside
        fresh = np.bincount(node[live], wy[live], 2 * len(at)) / np.maximum(np.bincount(node[live], w[live], 2 * len(at)), 1e-300)
        mean[live] = fresh[node[live]]
        level += 1
    for i, d in enumerate(depths):
        if d is None or d > level:
            out[:, i] = mean
    total = {f: 0.0 for f in FEATURES}
    for (name, v), g in zip(split_on, gains, strict=True):
        label = {"hour": f"hour_{v}", "weekday": f"weekday_{WEEKDAYS[v] if v < len(WEEKDAYS) else ''}", "month": f"month_{v}"}.get(name, name)
        total[label] += g
    return out, np.array([total[f] for f in FEATURES])


def grow(split: DataFrame, keys, trees: int = 120, depths=(12,), target: str = "power_w", seed: int = 42) -> DataFrame:
    """Staged rows of every tree: key, tree, cell and `means` (one per depth), and for each feature its
    `importance` (share of the tree's gain; at the largest depth)."""
    keys = list(keys)
    kinds = dict(split.dtypes)
    names = [*keys, "tree", "cell", "means", "feature", "importance"]
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["tree int", "cell bigint", "means array<double>", "feature string", "importance double"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        w, wy = pdf["w"].to_numpy(), pdf["wy"].to_numpy()
        if not w.sum():
            return pd.DataFrame(columns=names)
        means, gains = grown(pdf["cell"].to_numpy(), w, wy, depths)
        head = {c: pdf[c].iloc[0] for c in (*keys, "tree")}
        cells = pd.DataFrame({**head, "cell": pdf["cell"].to_numpy(), "means": list(means), "feature": None, "importance": np.nan})
        shares = pd.DataFrame({**head, "cell": pd.array([None] * len(FEATURES), "Int64"), "means": None, "feature": FEATURES,
                               "importance": gains / gains.sum() if gains.sum() else gains})
        return pd.concat([cells.astype({"cell": "Int64"}), shares])[names]

    sums = weighted(with_cells(split, keys), keys, trees, target, seed)
    return stage(sums.groupBy(*keys, "tree").applyInPandas(build, schema), "forest")


def importances(trees: DataFrame, keys) -> DataFrame:
    """One row per key and encoded column; those of a key add up to one."""
    mean = trees.filter("feature is not null").groupBy(*keys, "feature").agg(F.avg("importance").alias("importance"))
    total = mean.groupBy(*keys).agg(F.sum("importance").alias("_all"))
    return mean.join(total, list(keys)).select(*keys, "feature", F.coalesce(F.try_divide("importance", F.col("_all")), F.lit(0.0)).alias("importance"))


def predictions(trees: DataFrame, split: DataFrame, keys, at: int = 0, target: str = "power_w") -> DataFrame:
    """Rows with the forest's mean over all trees, at the `at`-th of its depths."""
    keys = list(keys)
    means = trees.filter("cell is not null").groupBy(*keys, "cell").agg(F.avg(F.get("means", F.lit(at))).alias("predicted_w"))
    return with_cells(split, keys).join(means, [*keys, "cell"]).select(*keys, "ts", "split", target, "predicted_w", F.lit("D").alias("model"))


def depth_curve(trees: DataFrame, split: DataFrame, keys, depths=DEPTHS, target: str = "power_w") -> DataFrame:
    """Train and validation MAE per key and depth, all depths from one pass over the rows."""
    keys = list(keys)
    mean = trees.filter("cell is not null").groupBy(*keys, "cell").agg(*[F.avg(F.get("means", F.lit(i))).alias(f"_p{i}") for i in range(len(depths))])
    rows = with_cells(split, keys).filter("split <> 'test'").join(mean, [*keys, "cell"])
    error = lambda i, s: F.avg(F.when(F.col("split") == s, F.abs(F.col(target) - F.col(f"_p{i}"))))
    curve = rows.groupBy(*keys).agg(*[F.struct(
        F.lit("unlimited" if d is None else str(d)).alias("max_depth"), error(i, "train").alias("train_mae_w"),
        error(i, "validation").alias("val_mae_w")).alias(f"_d{i}") for i, d in enumerate(depths)])
    return curve.select(*keys, F.explode(F.array(*[f"_d{i}" for i in range(len(depths))])).alias("_c")).select(*keys, "_c.*")
