"""A stored vector index: inverted lists around centroids, searched by probing the nearest lists and ranking their rows exactly.

A folder holds `centers` (one row a list) and `vectors` (the rows, partitioned by list). Centroids are fitted on a bounded sample;
every row that has a vector of the index's size is stored, in the list of its nearest centroid. New rows are appended; the centroids stay.
A search reads only the partitions of the lists that its queries probe. Probing all lists gives the exact result; how many
are needed for a wanted recall depends on how the vectors cluster, and `probes_for` measures it on a bounded sample of queries.

At most MOST_LISTS centroids exist, whatever the number of rows, so they travel to the tasks. A list of any size is dealt to
several files and tasks: rows are written with a part number that grows with the list, and both sides of the search meet by list and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.retrieval import MOST_TASKS, TILE_QUERIES, knn_batch, tile_search, usable
from quillspark.session import shipped

#: Vectors that centroids are fitted on at most, lists at most, rounds of fitting, queries that recall is measured on at most.
SAMPLE, MOST_LISTS, ROUNDS, SAMPLE_QUERIES = 16_384, 4_096, 12, 500
#: Rows of a list that one file and one task of a search hold, about.
PART_ROWS = 100_000


def nearest(points: np.ndarray, centers: np.ndarray, n: int = 1) -> np.ndarray:
    """Indices of the n nearest centers of every point, nearest first."""
    far = (centers**2).sum(1) - 2 * points @ centers.T
    if n == 1:
        return far.argmin(1)[:, None]
    some = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centers) else np.tile(np.arange(len(centers)), (len(points), 1))
    return np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(1, kind="stable"), 1)


def centroids(points: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Rounds of k-means; a center that nothing is near to moves to the point that is farthest off."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), n, replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        own = nearest(points, centers)[:, 0]
        counts = np.bincount(own, minlength=n)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            off = ((points - centers[own]) ** 2).sum(1)
            centers[empty] = points[np.argsort(-off)[: len(empty)]]
    return centers


def near_lists(centers: np.ndarray, vector: Column, n: int = 1) -> Column:
    """array<int>: the n nearest lists."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series(list(nearest(np.stack(some.to_list()).astype(np.float64), centers, n).astype(np.int32)) if len(some) else [], dtype=object)

    return F.pandas_udf(shipped(run), "array<int>")(vector)


def drawn(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose keys have the smallest hashes."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def build(rows: DataFrame, key: str, vector: str, folder: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Fit centroids on at most `sample` vectors (by hashed key) and store all rows. lists: by default the root of the number of rows."""
    first = rows.filter(F.size(vector) > 0).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None:
        raise ValueError("no vectors to index")
    good = rows.filter(usable(vector, first.n))
    n = good.count()
    points = np.stack([r[0] for r in drawn(good, key, sample).select(vector).collect()]).astype(np.float64)
    lists = min(lists or round(n**0.5), MOST_LISTS, len(points))
    found = [(i, c.tolist()) for i, c in enumerate(centroids(points, max(1, lists)))]
    rows.sparkSession.createDataFrame(found, "list int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centers")
    add(rows, key, vector, folder)


def centers_of(spark: SparkSession, folder: str) -> np.ndarray:
    return np.array([r.center for r in spark.read.parquet(f"{folder}/centers").orderBy("list").collect()])


def add(rows: DataFrame, key: str, vector: str, folder: str, part_rows: int = PART_ROWS) -> None:
    """Append rows to the lists of their nearest centroids."""
    centers = centers_of(rows.sparkSession, folder)
    placed = rows.filter(usable(vector, centers.shape[1])).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    placed = placed.withColumn("list", near_lists(centers, F.col("vector"))[0])
    # a list's rows are counted by task first, so a hot list is known before it is dealt
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("_n"))
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("_n") / part_rows)).cast("int"))
    dealt.select("key", "vector", "part", "list").repartition("list", "part").write.mode("append").partitionBy("list").parquet(f"{folder}/vectors")


def search(queries: DataFrame, query_key: str, vector: str, folder: str, k: int, probes: int) -> DataFrame:
    """query_key, key, distance (L2), rank: the k nearest rows of the probed lists, ties by key. queries without a usable vector get no rows."""
    spark = queries.sparkSession
    centers = centers_of(spark, folder)
    asked = queries.filter(usable(vector, centers.shape[1])).select(query_key, F.col(vector).alias("_q"))
    asked = asked.withColumn("list", F.explode(near_lists(centers, F.col("_q"), min(probes, len(centers)))))
    probed = [r.list for r in asked.select("list").distinct().collect()]  # at most as many as there are lists
    stored = spark.read.parquet(f"{folder}/vectors").filter(F.col("list").isin(probed))
    parts = stored.groupBy("list").agg(F.max("part").alias("_last"))
    # a part of a list and a block of queries are a tile
    blocks = max(1, -(-queries.count() // TILE_QUERIES))
    asked = asked.join(F.broadcast(parts), "list").select(query_key, "_q", "list", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("part"), F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int").alias("block"))
    rows = stored.select("key", F.col("vector").alias("_x"), "list", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    tasks = max(spark.sparkContext.defaultParallelism, min(len(probed) * blocks // 4, MOST_TASKS))
    pairs = tile_search(rows, asked, ["list", "part", "block"], "key", query_key, k, tasks)
    best = Window.partitionBy(query_key).orderBy("distance", "key")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def probes_for(rows: DataFrame, key: str, vector: str, folder: str, k: int, recall: float = 0.9, sample: int = SAMPLE_QUERIES, margin: float = 0.03) -> int:
    """The fewest lists to probe so that sampled rows, taken as queries, find their exact k nearest with that recall and a margin."""
    spark = rows.sparkSession
    centers = centers_of(spark, folder)
    some = drawn(rows.filter(usable(vector, centers.shape[1])), key, sample).select(F.col(key).alias("_query"), vector)
    exact = knn_batch(rows.filter(usable(vector, centers.shape[1])), some, key, "_query", vector, k).select("_query", F.col(key).alias("key"))
    order = some.select("_query", near_lists(centers, F.col(vector), len(centers)).alias("_order"))
    lists = spark.read.parquet(f"{folder}/vectors").select("key", "list")
    place = exact.join(lists, "key").join(order, "_query").select(F.array_position("_order", F.col("list")).alias("place"))
    needed = sorted(r.place for r in place.collect())  # k rows a sampled query
    return int(needed[min(len(needed) - 1, int(np.ceil(min(1.0, recall + margin) * len(needed))) - 1)]) if needed else 1
