"""Shared helpers of the corpus operators: table access, lineage cuts, sized joins."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import ship, spread  # noqa: F401

#: A side of at most this many rows of ids may be broadcast (8 to 40 bytes a row).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir). Only a local master, as in tests, may do without one and gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: lost executors cost no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Shared:
    """Parquet tables in the shared folder of spark.checkpoint.dir, for what is read more than once; dropped at the end of the with block."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.root = spark, f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def __enter__(self) -> Shared:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: str) -> DataFrame:
    """mapInArrow with this package on the executors and memory given back after each task."""
    ship(rows.sparkSession)
    return rows.mapInArrow(lambda batches: trimmed(work(batches)), shape)


def fold5(col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id falls in no fold (null)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5))


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose row count was measured and is within the limit; else leave a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is not in dropped (one column, the id). Rows with a null id stay."""
    ids = cut(dropped.select(F.col(dropped.columns[0]).alias(id_col)))
    return docs.join(sized_broadcast(ids, ids.count()), id_col, "left_anti").select(*docs.columns)


def small_batches(batches: Iterator[pa.RecordBatch], text_col: str = "text", chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that one slice holds about so many bytes of text, or a single row."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(b.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > chars:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield b.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Small Arrow batches put together to about so many bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def trimmed(results: Iterator) -> Iterator:
    """The results; after the last, memory that the task has freed goes back to the system, as Python workers live on for other tasks."""
    try:
        yield from results
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def frame(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of Python lists or arrays in the schema's order and types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def id_type(rows: DataFrame) -> str:
    """SQL type of doc_id, which operators pass on as it is."""
    return rows.schema["doc_id"].dataType.simpleString()


def typed(schema: pa.Schema, batch: pa.RecordBatch) -> pa.Schema:
    """The schema with its first column, the id, of the type that it has in the batch."""
    return schema.set(0, pa.field(schema.names[0], batch.schema.field(0).type))


def share_of(id_col: str, share: float | Column) -> Column:
    """True for about this share of the rows, by the whole range of the 64-bit hash of the id, so that tiny shares stay what they are."""
    return F.shiftrightunsigned(F.xxhash64(id_col), 1).cast("double") < F.lit(2.0**63) * share


def quantile_threshold(scores: pd.Series, recall: float) -> float:
    """The largest threshold at which at least this share of the scores is at or above it."""
    s = scores.sort_values(ascending=False).to_numpy()
    return float(s[min(len(s) - 1, max(0, int(-(-len(s) * recall // 1)) - 1))]) if len(s) else 0.5


def space_words(texts: pa.Array, newline: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts split at single spaces, line feeds replaced before: where each text's words begin (and the last end), a code for each word, the words by code."""
    lists = pa.compute.split_pattern(pa.compute.replace_substring(pa.compute.fill_null(texts, "").cast(pa.large_string()), "\n", newline), " ")
    words = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy(), words.indices.to_numpy(), words.dictionary.to_pylist()


def ragged(parts: list[bytes], codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The parts that the codes name, one after another as an array of that type, and where each part of it ends."""
    flat, width = np.frombuffer(b"".join(parts), kind), np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    begins = np.cumsum(sizes) - sizes
    taken = sizes[codes]
    ends = np.cumsum(taken)
    return flat[np.repeat(begins[codes] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)], ends
