"""Target-distribution importance resampling: hashed n-gram counts of a corpus and of a target, gains, a seeded draw.

Features are all runs of 1 to n consecutive words. Words are what is left between all ASCII characters but digits and letters,
after A-Z are lower-cased. A feature's bucket is the crc32 of its bytes modulo the number of buckets; a bucket's gain is the
scaled logarithm of its share in the target over its share in the corpus, both smoothed by one a bucket. A document's weight
is the floored mean gain of its features; scores add seeded Gumbel noise, and the highest are drawn.

Long texts are cut at word boundaries into chunks of about CHUNK bytes, which are dealt out evenly. A chunk owns the
features that start in it and carries n - 1 words of what follows, so that each is counted once; chunk counts and gains are
summed by document. So no task holds more than one long text, and only while it cuts it.

Defined cases: a null text, one that is empty or one without words has no features, weight 0 and is never drawn unless
least_words is 0. Repeated rows, and rows that share an id, are documents of their own; those that agree in id and text get the same
weight and score, and ranks one after the other. A null id is hashed as an empty one and comes last among ties. An empty
corpus gives an empty result; an empty target leaves every gain to the smoothing. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import md5
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, cut, frame, id_type, small_batches, typed

#: Texts of more bytes are cut into chunks of about so many.
CHUNK = 1 << 16
#: Features whose buckets a task remembers at most.
REMEMBERED = 400_000

_lower = bytes(range(256)).lower()
WORD_BYTES = bytes(c if (c >= 0x80 or bytes([c]).isalnum()) else 0x20 for c in _lower)
_WORD = re.compile(rb"[^ ]+")


class Buckets(dict):
    """Bucket of a feature, remembered."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = crc32(feature) % self.n
        return found


def chunks(data: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[list[bytes], int]]:
    """Words of each chunk of a text with its carry, and how many of them it owns; one chunk at least."""
    data, start = data.translate(WORD_BYTES), 0
    while True:
        end = data.find(b" ", start + size)
        own = data[start : end if end >= 0 else len(data)].split()
        yield own + ([m[0] for m in islice(_WORD.finditer(data, end), n - 1)] if end >= 0 else []), len(own)
        if end < 0:
            return
        start = end


def features(words: list[bytes], own: int, n: int) -> Iterator[bytes]:
    """Runs of 1 to n words that start among the first own words."""
    yield from words[:own]
    for size in range(2, n + 1):
        for i in range(min(own, len(words) - size + 1)):
            yield b" ".join(words[i : i + size])


def codes(words: list[bytes], own: int, n: int, buckets: Buckets) -> np.ndarray:
    return np.fromiter(map(buckets.__getitem__, features(words, own, n)), np.int64)


CUT = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("part", pa.int32()), ("own", pa.int32()), ("text", pa.binary())])


def cut_batches(batches: Iterator[pa.RecordBatch], n: int, size: int) -> Iterator[pa.RecordBatch]:
    """Chunks of every text as rows; a text's digest and size stand for it."""
    for b in small_batches(batches):
        for row in range(b.num_rows):
            data = b.column(1)[row].as_py().encode()
            digest = md5(data).digest() + len(data).to_bytes(8, "big")
            for part, (words, own) in enumerate(chunks(data, n, size)):
                key = b.column(0).slice(row, 1)
                yield frame({"doc_id": key, "digest": [digest], "part": [part], "own": [own], "text": [b" ".join(words)]}, typed(CUT, b))


COUNTED = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def held_words(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], int]]:
    """Words of each row of (doc_id, digest, part, own, text), and how many it owns. own: null for a whole text."""
    for own, data in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
        words = (data or b"").split() if own is not None else (data or b"").translate(WORD_BYTES).split()
        yield words, len(words) if own is None else own


def count_batches(batches: Iterator[pa.RecordBatch], n: int, size: int) -> Iterator[pa.RecordBatch]:
    """Features by bucket, over all rows of a task."""
    total, buckets = np.zeros(size, np.int64), Buckets(size)
    for b in small_batches(batches):
        for words, own in held_words(b):
            total += np.bincount(codes(words, own, n, buckets), minlength=size)
    there = np.flatnonzero(total)
    yield frame({"bucket": there, "n": total[there]}, COUNTED)


WEIGHED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("part", pa.int32()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("gain", pa.int64())])


def weigh_batches(batches: Iterator[pa.RecordBatch], n: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    buckets = Buckets(len(gains))
    for b in small_batches(batches):
        rows = [(own, len(c := codes(words, own, n, buckets)), int(gains[c].sum())) for words, own in held_words(b)]
        columns = dict(zip(WEIGHED.names[3:], zip(*rows, strict=True), strict=True)) | {name: b.column(i) for i, name in enumerate(WEIGHED.names[:3])}
        yield frame(columns, typed(WEIGHED, b))


def pieces(docs: DataFrame, n: int, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Texts that are one chunk, and the chunks of all others dealt out evenly: doc_id, digest, part, own, text (bytes)."""
    kind = id_type(docs)
    long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    nothing = lambda t: F.lit(None).cast(t)
    whole = docs.filter(~long).select("doc_id", nothing("binary").alias("digest"), nothing("int").alias("part"), nothing("int").alias("own"), F.col("text").cast("binary").alias("text"))
    parts = arrow_map(docs.filter(long), lambda it: cut_batches(it, n, size), f"doc_id {kind}, digest binary, part int, own int, text binary")
    spark = docs.sparkSession
    return whole, parts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def bucket_counts(rows: tuple[DataFrame, DataFrame], n: int, buckets: int) -> np.ndarray:
    """Features by bucket; every task adds its own up first, and no more than one row a bucket reaches the driver."""
    counted = [arrow_map(r, lambda it: count_batches(it, n, buckets), "bucket int, n long") for r in rows]
    total = np.zeros(buckets, np.int64)
    for r in counted[0].unionByName(counted[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains_of(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln((t + 1)(S + b) / ((s + 1)(T + b)))) of every bucket."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log(float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, chunk: int = CHUNK, scale: int = 1000) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of docs (doc_id, text); target: text."""
    docs = docs.select("doc_id", "text")
    asked = target.select(F.lit(0).cast("long").alias("doc_id"), "text")
    rows = pieces(docs, n, chunk)
    gains = gains_of(bucket_counts(rows, n, buckets), bucket_counts(pieces(asked, n, chunk), n, buckets), scale)
    shape = f"doc_id {id_type(docs)}, digest binary, part int, n_words long, n_features long, gain long"
    whole, parts = (arrow_map(r, lambda it: weigh_batches(it, n, gains), shape) for r in rows)
    sums = ["n_words", "n_features", "gain"]
    # rows that agree in id and text come as so many first chunks
    met = parts.groupBy("doc_id", "digest").agg(F.count_if(F.col("part") == 0).alias("copies"), *[F.sum(c).alias(c) for c in sums])
    apart = met.select("doc_id", *[F.expr(f"{c} div copies").alias(c) for c in sums], F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy")
    mean = F.expr("CASE WHEN n_features > 0 THEN (gain - pmod(gain, n_features)) div n_features ELSE 0L END")
    return whole.select("doc_id", *sums).unionByName(apart).select("doc_id", "n_words", "n_features", mean.alias("weight"))


def noise(id_col: str, seed: int, scale: int = 1000) -> Column:
    """Seeded Gumbel noise of an id, scaled and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their places 1, 2, ... in a total order: sorted in ranges and written; the ranges' sizes, a row a partition, give what lies before."""
    written = cut(rows.orderBy(*order)).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = written.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return written.join(F.broadcast(ahead), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every row of docs (doc_id, text)."""
    rows = cut(weights(docs, target, n, buckets, chunk)).withColumns({"score": F.col("weight") + noise("doc_id", seed), "_tie": F.monotonically_increasing_id()})
    fit = F.col("n_words") >= least_words
    drawn = rows.filter(fit).count() * percent // 100
    ranked = placed(rows.filter(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_tie")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    every = ranked.unionByName(rows.filter(~fit).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank")
