"""k-means of every key at once.

The centres are a small table, one row per key. A round joins them to the points, gives each point
the nearest one, and takes new means as a grouped aggregate; it is written to the shared folder, so
the plan does not grow and a lost executor costs one round at most. All keys share the rounds, which
end when no centre of any key moves. No key's points meet in one task.

The start is farthest-first: the point with the smallest MD5 of seed, key and id, then, as often as
needed, the point farthest from the centres so far (the larger MD5 of equals). Reruns agree, whatever
the partitioning. A key with fewer distinct points than `k` has as many clusters as those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.session import stage

#: Centres that move less than this share of the largest coordinate have come to rest.
REST = 1e-12


def distances(centres: str = "_centres", point: str = "_f") -> Column:
    """Squared distance to every centre."""
    square = lambda a, b: (a - b) * (a - b)
    return F.transform(centres, lambda c: F.aggregate(F.zip_with(c, F.col(point), square), F.lit(0.0), lambda s, x: s + x))


def nearest(points: DataFrame, centres: DataFrame, keys) -> DataFrame:
    """The points with `_d`, their squared distances, and `cluster`, the first of the nearest centres."""
    d = points.join(centres.select(*keys, "_centres"), list(keys)).withColumn("_d", distances())
    return d.withColumn("cluster", F.array_position("_d", F.array_min("_d")).cast("int") - 1)


def farthest_first(points: DataFrame, keys, k: int) -> DataFrame:
    """keys, _centres: the start of every key."""
    centres = points.groupBy(*keys).agg(F.array(F.min_by("_f", "_h")).alias("_centres"))
    for _ in range(k - 1):
        reach = points.join(centres, list(keys)).withColumn("_r", F.array_min(distances()))
        far = reach.groupBy(*keys).agg(F.max("_r").alias("_r"), F.max_by("_f", F.struct("_r", "_h")).alias("_next"), F.first("_centres").alias("_centres"))
        centres = stage(far.select(*keys, F.when(F.col("_r") > 0, F.concat("_centres", F.array("_next"))).otherwise(F.col("_centres")).alias("_centres")), "centres")
    return centres


def k_means(rows: DataFrame, keys, features, ident: str, k: int = 4, seed: int = 42, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """The rows (null features left out) with `cluster`, numbered from 0 per key, and the centres:
    keys, cluster, centre. `ident` tells the rows of a key apart."""
    keys, features = list(keys), list(features)
    rows = rows.dropna(subset=features)
    points = stage(rows.select(*keys, F.array(*[F.col(f).cast("double") for f in features]).alias("_f"), F.md5(F.concat_ws(
        "|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*keys, ident)])).alias("_h")), "points")
    centres = farthest_first(points, keys, k)
    far = F.array_max(F.flatten(F.transform("_centres", lambda c: F.transform(c, F.abs))))
    for _ in range(rounds):
        means = nearest(points, centres, keys).groupBy(*keys, "cluster").agg(F.array(*[F.avg(F.get("_f", i)) for i in range(len(features))]).alias("_m"))
        per_key = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "_m"))).alias("_means"))  # k entries
        # a centre that lost all its points stays where it is
        moved = centres.join(per_key, keys).withColumn("_new", F.transform("_centres", lambda c, i: F.coalesce(F.get(F.array(F.col("_means")[i]), F.lit(0)), c)))
        steps = F.flatten(F.zip_with("_centres", "_new", lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y))))
        after = stage(moved.select(*keys, F.col("_new").alias("_centres"), (F.array_max(steps) > REST * far).alias("_moved")), "centres")
        centres = after.select(*keys, "_centres")
        if not after.filter("_moved").limit(1).count():
            break
    mine = rows.withColumn("_f", F.array(*[F.col(f).cast("double") for f in features]))
    return (nearest(mine, centres, keys).drop("_f", "_d", "_centres"),
            centres.select(*keys, F.posexplode("_centres").alias("cluster", "centre")))
