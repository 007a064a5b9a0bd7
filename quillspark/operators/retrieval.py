"""Ranking: BM25, exact vector search, reciprocal rank fusion, relevance filter, ticker resolution."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.session import shipped

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, key, tf), (key, dl) and one row of corpus figures (n, avgdl)."""
    tokens = docs.select(key, T.space_tokens(F.col(text)).alias("_t"))
    tf = tokens.select(key, F.explode("_t").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    lengths = tokens.select(key, F.size("_t").alias("dl"))
    return tf, lengths, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf_table(tf: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, idf: ln(n - df + .5) - ln(df + .5); a negative one is replaced by EPSILON of the mean over all terms."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(corpus))
    raw = df.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, F.col("mean") * EPSILON).otherwise(F.col("idf")).alias("idf"))


def bm25(docs: DataFrame, key: str, text: str, query: str, k: int, boosted: Column | None = None, boost: float = 2.0) -> DataFrame:
    """key, score: the k best documents; repeated query terms count again, documents without any of them score 0.

    Only postings of the query's terms are scored; corpus figures are one row, the query's terms a handful of literals.
    """
    tf, lengths, corpus = postings(docs, key, text)
    times = Counter(query.lower().split())
    if not times:
        return docs.select(key, F.lit(0.0).alias("score")).orderBy(key).limit(k)
    weight = F.create_map(*[x for t, n in times.items() for x in (F.lit(t), F.lit(n))])
    hits = tf.filter(F.col("term").isin(*times)).join(F.broadcast(idf_table(tf, corpus).filter(F.col("term").isin(*times))), "term")
    scored = hits.join(lengths, key).crossJoin(F.broadcast(corpus))
    part = F.col("idf") * weight[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    summed = scored.groupBy(key).agg(F.sum(part).alias("score"))
    flags = docs.select(key, boosted.alias("_b")) if boosted is not None else docs.select(key, F.lit(False).alias("_b"))
    # sums in another order differ in their last digits: scores equal to 9 digits are ties
    every = flags.join(summed, key, "left").select(key, F.round(F.coalesce("score", F.lit(0.0)) * F.when(F.col("_b"), boost).otherwise(1.0), 9).alias("score"))
    return every.orderBy(F.desc("score"), key).limit(k)


def knn(df: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """key, distance of the k nearest vectors; rows without one are left out. The query travels as a literal."""
    q = V.literal(query)
    distance = V.l2(F.col(vector), q) if metric == "l2" else 1 - V.cosine(F.col(vector), q)
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query))).select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


#: Rows and queries of a tile at most; queries and pairs of a tile that are looked at at a time.
TILE_ROWS, TILE_QUERIES, SOME_QUERIES, SOME_PAIRS = 32_768, 8_192, 1_024, 2_000_000
#: Tasks that tiles are dealt to at most.
MOST_TASKS = 2_000


def usable(vector: str, size: int | None = None) -> Column:
    """Vectors (of the size, if one is given) whose components are all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0 if size is None else F.size(vector) == size) & finite, F.lit(False))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def tile_best(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of queries and of their k nearest rows, and the distances; ties to the smaller index of a row. A matrix product says which
    rows may be among the k best, within its rounding; these are measured component by component, in order, as a sum over the array would be."""
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (qq + xx.max())
    step, out = max(k + 1, SOME_PAIRS // SOME_QUERIES), []
    for at in range(0, len(q), SOME_QUERIES):
        some, size, wide = q[at : at + SOME_QUERIES], qq[at : at + SOME_QUERIES, None], slack[at : at + SOME_QUERIES]
        bound = np.full(len(some), np.inf)
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for row in range(0, len(x), step):
            near = size + xx[row : row + step] - 2 * some @ x[row : row + step].T
            if near.shape[1] > k:
                bound = np.minimum(bound, np.partition(near, k - 1, axis=1)[:, k - 1] + wide) if row == 0 else bound
            i, j = np.nonzero(~(near > (bound + wide)[:, None]))
            far = [np.sqrt(np.cumsum((x[row + j[n : n + 100_000]] - some[i[n : n + 100_000]]) ** 2, axis=1)[:, -1]) for n in range(0, len(i), 100_000)]
            i, j, d = (np.concatenate(both) for both in zip(kept, (i, row + j, np.concatenate(far) if far else np.empty(0)), strict=True))
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == k - 1
            bound[i[last]] = d[last] ** 2 + wide[i[last]]
            kept = (i[place < k], j[place < k], d[place < k])
        out.append((kept[0] + at, *kept[1:]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def tile_search(rows: DataFrame, queries: DataFrame, tile: list[str], key: str, query_key: str, k: int, tasks: int) -> DataFrame:
    """query_key, key, distance (L2): the k nearest rows of every tile for each of the tile's queries. rows: tile, key, _x; queries: tile,
    query_key, _q; vectors of a tile are usable and of one size."""

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        if len(some) == 0 or len(asked) == 0:
            return pa.table({query_key: asked[query_key].slice(0, 0), key: some[key].slice(0, 0), "distance": pa.array([], pa.float64())})
        some = some.take(pc.sort_indices(some, sort_keys=[(key, "ascending")], null_placement="at_start"))
        i, j, d = tile_best(matrix(some["_x"]), matrix(asked["_q"]), k)
        return pa.table({query_key: asked[query_key].take(pa.array(i)), key: some[key].take(pa.array(j)), "distance": pa.array(d)})

    kind = StructType([queries.schema[query_key], rows.schema[key], StructField("distance", DoubleType())])
    dealt = [df.repartition(tasks, *tile).groupBy(*tile) for df in (rows.select(*tile, key, "_x"), queries.select(*tile, query_key, "_q"))]
    return dealt[0].cogroup(dealt[1]).applyInArrow(shipped(run), kind)


def knn_batch(df: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str, k: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """query_key, key, distance: the k nearest of every query among the rows whose vectors have its size. Rows and queries are dealt to
    tiles of bounded size, each a group of its own, so a task holds one tile; only every tile's k best of a query are shuffled on. Vectors that
    are null or hold null or non-finite components have no distance and take no part."""
    asked = queries.filter(usable(vector)).select(F.col(query_key), F.col(vector).alias("_q"), F.size(vector).alias("_d"))
    good = df.filter(usable(vector)).select(F.col(key), F.col(vector).alias("_x"), F.size(vector).alias("_d"))
    shards = max(-(-df.count() // tile_rows), df.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-queries.count() // TILE_QUERIES))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    rows = good.select(key, "_x", "_d", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("_s"), every(blocks, "_b"))
    visits = asked.select(query_key, "_q", "_d", F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int").alias("_b"), every(shards, "_s"))
    pairs = tile_search(rows, visits, ["_d", "_s", "_b"], key, query_key, k, min(shards * blocks, MOST_TASKS))
    best = Window.partitionBy(query_key).orderBy("distance", key)
    return pairs.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """A retrieved list (a few hundred rows) with rank from 0."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(lists: list[DataFrame], key: str, k: int = 60, boosted: Column | None = None, boost: float = 2.0) -> DataFrame:
    """key, score: sum of 1 / (k + rank + 1) over the lists, times the boost where it applies; ties keep the first-seen order."""
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    if boost < 1.0:
        raise ValueError(f"boost must be at least 1, not {boost}")
    every = None
    for i, df in enumerate(lists):
        one = df.select(key, *(c for c in df.columns if c not in (key, "_list")), F.lit(i).alias("_list"))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    part = 1.0 / (k + F.col("rank") + 1) * (F.when(boosted, boost).otherwise(1.0) if boosted is not None else 1.0)
    fused = every.withColumn("_p", part).groupBy(key).agg(F.sum("_p").alias("score"), F.min(F.struct("_list", "rank")).alias("_seen"))
    return fused.orderBy(F.desc("score"), "_seen").select(key, "score")


def relevance_filter(chunks: DataFrame, text: str, question: str, least: float = 0.15, least_length: int = 50, group: list[str] | None = None) -> DataFrame:
    """Chunks that are long enough and share key words with the question; if none is, the best one of the group."""
    asked = T.keywords(F.lit(question))
    scored = chunks.withColumn("_o", T.overlap(asked, T.keywords(F.coalesce(F.col(text), F.lit("")))))
    scored = scored.withColumn("_k", (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least_length) & (F.col("_o") >= least))
    if group:
        best = scored.groupBy(*group).agg(F.max("_k").alias("_any"), F.max_by("_id", F.struct("_o", -F.col("_id"))).alias("_best")) if "_id" in scored.columns else None
        if best is None:
            raise ValueError("grouped filtering needs a numeric _id column")
        return scored.join(best, group).filter(F.col("_k") | (~F.col("_any") & (F.col("_id") == F.col("_best")))).drop("_o", "_k", "_any", "_best")
    kept = scored.filter("_k")
    return (scored.orderBy(F.desc("_o")).limit(1) if kept.isEmpty() else kept).drop("_o", "_k")


def keyword_fallback(docs: DataFrame, key: str, text: str, question: str, k: int, most_words: int = 10) -> DataFrame:
    """Documents that hold any of the question's first words of four letters and more, in the order of their keys."""
    words = [w for w in question.lower().split() if len(w) >= 4][:most_words]
    return docs.filter(T.holds_any(F.col(text), words) if words else F.lit(False)).orderBy(key).limit(k)


def rerank(candidates: DataFrame, score: Column, key: str, k: int) -> DataFrame:
    """The k best by any scorer given as a column."""
    return candidates.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), key).limit(k)


def facts_as_text(facts: DataFrame, keys: list[str], line: Column, order: Column, n: int) -> DataFrame:
    """keys, text: the first n lines of each key, one a row of facts, joined. Each key has its own quota."""
    w = Window.partitionBy(*keys).orderBy(order)
    top = facts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).withColumn("_l", line)
    listed = F.array_sort(F.collect_list(F.struct("_r", "_l")))
    return top.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_l"]), "\n").alias("text"))
