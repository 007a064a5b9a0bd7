"""Companies that a store lacks, filled in from what is offered for them; companies that it has stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import append, exists

#: What became of a company in a store.
KEPT, ADDED, NONE = "kept", "added", "none"


def lacking(companies: DataFrame, stored: DataFrame | None, key: str) -> DataFrame:
    """Companies of the list, each once, without a row in the store; null is no company."""
    listed = companies.select(key).filter(F.col(key).isNotNull()).distinct()
    return listed if stored is None else listed.join(stored.select(key), key, "left_anti")


def offered_for(companies: DataFrame, stored: DataFrame | None, offered: DataFrame, key: str) -> DataFrame:
    """Rows that are offered for the lacking companies; those of other companies are left out."""
    return offered.join(lacking(companies, stored, key), key, "left_semi")


def fill_missing(spark: SparkSession, companies: DataFrame, key: str, offered: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Append to each store below the folder (a Parquet table by name, made if it isn't there) what is offered for the companies
    that it lacks. Stores are filled one by one, and one that fails doesn't keep the others from being filled: returns the
    errors by store. A run over stores that are filled appends nothing, so a run that broke off is simply repeated. Offered
    rows may be read from anything but the store itself."""
    failed = {}
    for name, rows in offered.items():
        path = f"{folder}/{name}"
        try:
            stored = spark.read.parquet(path) if exists(spark, path) else None
            append(offered_for(companies, stored, rows, key), path)
        except Exception as e:  # noqa: BLE001  the others go on; the caller gets it
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return failed


def coverage(companies: DataFrame, key: str, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """A row a company of the list: per store what became of it (kept, added, none) and how many rows it has; a store that isn't in before was empty."""
    out = companies.select(key).filter(F.col(key).isNotNull()).distinct()
    for name, rows in after.items():
        had = before.get(name)
        told = rows.select(key, F.lit(1).alias("_now"), F.lit(0).alias("_had"))
        if had is not None:
            told = told.unionByName(had.select(key, F.lit(0).alias("_now"), F.lit(1).alias("_had")))
        counted = told.groupBy(key).agg(F.sum("_now").alias(f"{name}_rows"), F.max("_had").alias("_had"))
        state = F.when(F.col("_had") == 1, KEPT).when(F.col(f"{name}_rows") > 0, ADDED).otherwise(NONE)
        out = out.join(counted, key, "left").withColumns({f"{name}_state": state, f"{name}_rows": F.coalesce(f"{name}_rows", F.lit(0).cast("long"))}).drop("_had")
    return out
