"""Exact top-k search: tiled matrix products of queries and shards, selection within each tile, lists merged as a tree.

Vectors are turned to integers, floor(scale * x), and packed into small blobs of 16-bit (or, where they don't fit, 64-bit)
matrices, once for candidates and once for queries. Candidate blobs are dealt to shards of bounded size; every query blob
visits every shard. A task reads one shard after the other, holds the shard's matrix, and streams the query blobs by it: each
meets the shard tile by tile, and a tile passes on only what reaches the query's k-th best so far. So a shard and a query
have one list, and the lists are merged in steps of FAN.

Products are exact: by Cauchy-Schwarz every partial sum is at most the product of the norms, so single precision is
used where that is below 2^24, double precision below 2^53, and Python's integers beyond.

Defined cases: vectors that are null, hold a null or a component that isn't finite, and rows with a null id, take no part.
Only vectors with the same number of components are compared; empty ones score 0 with each other. A query's own row is every
row with its id. Rows that repeat an id are candidates one by one, and queries one by one. Ties go to the smaller id. Scores
beyond the range of a long stop at its ends. Fewer candidates than k: all of them. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, cut, frame

#: Bytes of a blob, bytes of blobs that a packing task holds, bytes of a shard, candidates of a tile, lists merged at once.
BLOB, HELD, SHARD, TILE, FAN = 1 << 16, 1 << 23, 1 << 27, 8192, 64
MOST = 2**63 - 1

PACKED = pa.schema([("blob", pa.int64()), ("is_query", pa.bool_()), ("size", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])
PACKED_SQL = "blob long, is_query boolean, size int, width int, ids binary, matrix binary"


def whole_numbers(b: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, is_query and floored vectors of a batch (vec_id, is_query, embedding), apart by number of components and by width."""
    vectors = b.column(2)
    taking = np.logical_and(b.column(0).is_valid(), vectors.is_valid()).astype(bool)
    rows = b.filter(pa.array(taking))
    vectors = rows.column(2)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls turn to nan
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    odd = np.append(0, np.cumsum(~np.isfinite(values)))
    ids, asked = rows.column(0).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
    good = odd[begins + sizes] == odd[begins]
    for size in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == size))
        with np.errstate(over="ignore"):
            floored = np.nan_to_num(np.floor(scale * values[begins[at][:, None] + np.arange(size)]))
        narrow = (np.abs(floored) <= 32767).all(1)
        yield ids[at[narrow]], asked[at[narrow]], floored[narrow].astype(np.int16)
        yield ids[at[~narrow]], asked[at[~narrow]], floored[~narrow]


def pack_batches(batches: Iterator[pa.RecordBatch], scale: int, blob: int) -> Iterator[pa.RecordBatch]:
    """Blobs of candidates (all rows) and of queries."""
    first, made = TaskContext.get().partitionId() << 33, 0
    held: dict[tuple, list] = defaultdict(list)
    bytes_held: dict[tuple, int] = defaultdict(int)

    def out(key: tuple) -> pa.RecordBatch:
        nonlocal made
        is_query, size, width = key
        ids, matrix = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        made, _ = made + 1, bytes_held.pop(key)
        return frame({"blob": [first + made - 1], "is_query": [is_query], "size": [size], "width": [width], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()]}, PACKED)

    for b in batches:
        for ids, asked, matrix in whole_numbers(b, scale):
            step = max(1, blob // max(1, matrix.shape[1] * matrix.itemsize))
            for is_query, some in ((False, np.arange(len(ids))), (True, np.flatnonzero(asked))):
                key = (is_query, matrix.shape[1], matrix.itemsize)
                for i in range(0, len(some), step):
                    part = some[i : i + step]
                    held[key].append((ids[part], matrix[part]))
                    bytes_held[key] += matrix[part].nbytes + 8 * len(part)
                    if bytes_held[key] >= blob:
                        yield out(key)
        while sum(bytes_held.values()) > HELD:
            yield out(max(bytes_held, key=bytes_held.get))
    for key in list(held):
        yield out(key)


def norm(matrix: np.ndarray) -> float:
    """The largest norm of a row, at least."""
    m = matrix.astype(np.float64)
    with np.errstate(over="ignore"):
        return float(np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0.0))) * (1 + 1e-9)


def level(bound: float) -> type:
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def products(q: np.ndarray, c: np.ndarray, kind: type) -> np.ndarray:
    """Exact inner products of rows: of floating type, or long for Python's integers."""
    if kind is not object:
        return q.astype(kind) @ c.astype(kind).T
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    found = exact(q) @ exact(c).T if q.shape[1] else np.zeros((len(q), len(c)), object)
    return np.clip(found, -MOST, MOST).astype(np.int64)


def first_k(row: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's first k entries by falling score, then key, in that order."""
    order = np.lexsort((key, -score, row))
    at = row[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return order[place < k]


def best(q: np.ndarray, q_ids: np.ndarray, shard: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, id, score of each query's k best of the shard: matrices with ids in ascending order and their norm."""
    kind = level(norm(q) * max((n for _, _, n in shard), default=0.0))
    none = -MOST - 1 if kind is object else -np.inf
    row, key, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if kind is object else kind)
    for ids, matrix, _ in shard:
        for i in range(0, len(ids), TILE):
            s, some = products(q, matrix[i : i + TILE], kind), ids[i : i + TILE]
            begin, end = np.searchsorted(some, q_ids), np.searchsorted(some, q_ids, "right")
            for r in np.flatnonzero(begin < end):
                s[r, begin[r] : end[r]] = none
            least = np.full(len(q), none, s.dtype)
            full = np.bincount(row, minlength=len(q)) >= k
            if len(row):
                np.minimum.at(known := np.full(len(q), np.inf if kind is not object else MOST, s.dtype), row, score)
                least[full] = known[full]
            tall = ~full if len(some) > k else np.zeros(len(q), bool)
            if tall.any():
                least[tall] = np.partition(s[tall], -k, axis=1)[:, -k]
            hit = (s >= least[:, None]) & (s > none)
            many = hit.sum(1) > 2 * k
            if many.any():  # of what equals the least only the first k can count, as ids ascend
                equal = s[many] == least[many][:, None]
                hit[many] &= ~equal | (np.cumsum(equal, axis=1) <= k)
            r, c = np.nonzero(hit)
            row, key, score = np.concatenate((row, r)), np.concatenate((key, some[c])), np.concatenate((score, s[r, c]))
            kept = first_k(row, score, key, k)
            row, key, score = row[kept], key[kept], score[kept]
    return row, key, score.astype(np.int64)


FOUND = pa.schema([("shard", pa.int32()), ("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, blob, is_query, size, width, ids, matrix), by shard, candidates first."""
    current, blobs, shard = None, defaultdict(list), None

    def ready() -> dict[int, list]:
        out: dict[int, list] = defaultdict(list)
        for (size, _), parts in blobs.items():
            ids, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(ids, kind="stable")
            out[size].append((ids[order], matrix[order], norm(matrix)))
        blobs.clear()
        return out

    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for place, blob, is_query, size, width, ids, matrix in zip(*columns, strict=True):
            if place != current:
                current, shard = place, None
                blobs.clear()
            ids = np.frombuffer(ids, np.int64)
            matrix = np.frombuffer(matrix, np.int16 if width == 2 else np.float64).reshape(len(ids), size)
            if not is_query:
                blobs[size, width].append((ids, matrix))
                continue
            shard = ready() if shard is None else shard
            row, key, score = best(matrix, ids, shard.get(size, []), k)
            yield frame({"shard": np.full(len(row), place, np.int32), "query_row": (blob << 20) + row, "query_id": ids[row], "vec_id": key, "score": score}, FOUND)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", blob: int = BLOB, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every query row. is_query: a condition on the vectors' columns."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector_col).alias("embedding"))
    packed = cut(arrow_map(rows, lambda it: pack_batches(it, scale, blob), PACKED_SQL))
    size = packed.filter("not is_query").agg(F.sum(F.length("matrix") + F.length("ids")).alias("bytes"), F.count(F.lit(1)).alias("blobs")).first()
    shards = max(1, -(-(size.bytes or 0) // shard), min(size.blobs, rows.sparkSession.sparkContext.defaultParallelism))
    dealt = F.pmod(F.xxhash64("blob"), F.lit(shards)).cast("int")
    columns = ["shard", *PACKED.names]
    stored = packed.filter("not is_query").withColumn("shard", dealt).select(*columns)
    asked = packed.filter("is_query").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*columns)
    met = stored.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "is_query")
    found, lists = arrow_map(met, lambda it: search_batches(it, k), "shard int, query_row long, query_id long, vec_id long, score long"), shards
    while lists > fan:
        lists = -(-lists // fan)
        found = first_of(found.withColumn("shard", F.pmod("shard", F.lit(lists))), ["query_row", "shard"], k).drop("rank")
    return first_of(found, ["query_row"], k).select("query_id", "rank", "vec_id", "score")


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Each list's k best; Spark limits within tasks before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10
"""
