"""Versioned layouts of stored tables: what differs from an older one, and reads over files of several versions.

A table's folder has one folder a version (v1, v2, ...); files are written once, in the layout of their time, and never rewritten. A later layout may
add columns, with a default for older rows, and widen types; it can't drop or narrow. A read gives all rows in one layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from quillspark.sources.tables import exists

#: What a type may become.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "float", "double", "string"),
    "smallint": ("int", "bigint", "float", "double", "string"),
    "int": ("bigint", "double", "string"),
    "bigint": ("string",),
    "float": ("double", "string"),
    "double": ("string",),
    "date": ("timestamp", "timestamp_ntz", "string"),
    "boolean": ("string",),
}


@dataclass(frozen=True)
class Column:
    """A column and the SQL expression that older rows have in its place."""

    name: str
    type: str
    default: str = "NULL"


def name_of(t: DataType) -> str:
    return t.simpleString()


def difference(old: StructType, layout: list[Column]) -> tuple[list[Column], list[Column]]:
    """Columns to add and columns to widen, so that rows of the old schema fit the layout. Names are compared without case."""
    there = {f.name.lower(): name_of(f.dataType) for f in old}
    gone = set(there) - {c.name.lower() for c in layout}
    if gone:
        raise ValueError(f"a layout keeps all columns; missing: {sorted(gone)}")
    fresh = [c for c in layout if c.name.lower() not in there]
    other = [c for c in layout if there.get(c.name.lower(), c.type) != c.type]
    narrowed = [c.name for c in other if c.type not in WIDER.get(there[c.name.lower()], ())]
    if narrowed:
        raise ValueError(f"types may only be widened: {narrowed}")
    return fresh, other


def migrated(rows: DataFrame, layout: list[Column]) -> DataFrame:
    """The rows in the layout; only the columns that differ are computed."""
    fresh, _ = difference(rows.schema, layout)
    names = {c.name for c in fresh}
    return rows.select(*[(F.expr(c.default) if c.name in names else F.col(c.name)).cast(c.type).alias(c.name) for c in layout])


def write_version(rows: DataFrame, folder: str, versions: list[list[Column]], version: int) -> None:
    """Append rows that are in the layout of a version (counted from 1)."""
    fresh, other = difference(rows.schema, versions[version - 1])
    if fresh or other:
        raise ValueError(f"not in layout {version}: {[c.name for c in [*fresh, *other]]}")
    rows.select(*[c.name for c in versions[version - 1]]).write.mode("append").parquet(f"{folder}/v{version}")


def read_versions(spark: SparkSession, folder: str, versions: list[list[Column]]) -> DataFrame:
    """All rows of all versions in the last layout. Filters and column lists reach every version's files."""
    last, found = versions[-1], None
    for i, layout in enumerate(versions, 1):
        if exists(spark, f"{folder}/v{i}"):
            rows = migrated(spark.read.schema(", ".join(f"`{c.name}` {c.type}" for c in layout)).parquet(f"{folder}/v{i}"), last)
            found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], ", ".join(f"`{c.name}` {c.type}" for c in last))
