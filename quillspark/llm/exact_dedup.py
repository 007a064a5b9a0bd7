"""Exact duplicates: 128-bit content hash groups, verified by comparing bytes; JVM-side expressions only.

Defined cases: a null text counts as the empty text; all empty texts are equal. Of equal texts the row with the largest
id stays (ids are the stable order). Repeated rows (same id, same text) count in group_size and share one decision. A row
with a null id counts in group_size and is kept only if no row of its group has an id (keep_id is then null). Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_ROWS, cut, sized_broadcast


def content_hash(text: Column) -> Column:
    """128 bits of content, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One decision a row: doc_id, keep_id, group_size, kept, text_sha256.

    Hashes, ids and counts meet first, without texts; copies collapse on the map side, so a group of any size costs a row a
    task. Only texts whose hash occurs again are then compared byte by byte, as keys (hash, text) of a hash aggregate that
    collapses copies on the map side too: where these hashes are few enough to be broadcast (measured), other texts never
    leave their task; beyond that all texts meet. Hashes that two different texts share are resolved by joining on the text
    itself. Rows look up their group by hash alone, in a join whose hot keys adaptive execution splits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), hash_fn(text).alias("_h"))
    light = rows.select("doc_id", "_h", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    groups = cut(rows.groupBy("_h").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    n_groups = groups.count()
    again = rows.join(F.broadcast(groups.select("_h")), "_h", "left_semi") if n_groups <= BROADCAST_ROWS else rows
    texts = again.groupBy("_h", "_text").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    shared = cut(texts.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("_h"))
    result = light.join(sized_broadcast(groups, n_groups), "_h", "left")
    if n_shared := shared.count():
        ours = sized_broadcast(shared, n_shared)
        hard = rows.join(ours, "_h", "left_semi")
        split = hard.groupBy("_h", "_text").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        sha = F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
        result = result.join(ours, "_h", "left_anti").unionByName(hard.join(split, ["_h", "_text"]).select("_h", "doc_id", sha, "_keep", "_n"))
    grouped = F.col("_n").isNotNull()
    keep = F.when(grouped, F.col("_keep")).otherwise(F.col("doc_id"))
    return result.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
