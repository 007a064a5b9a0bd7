"""Bulk copies into a database: bounded batches into a staging table, then one insert of what the target lacks.

    spark.dataSource.register(BulkCopy)
    df.write.format("bulk_copy").options(driver="psycopg", target=dsn, table="chunks", batch=1000).mode("append").save()

Tasks write in batches, each committed by itself, and mark rows with their attempt. When all tasks are done, one transaction
of the Spark driver copies the rows of the attempts that Spark counts; rows whose key the target has stay as they are there
(ON CONFLICT DO NOTHING), repeated rows of the copy count once. Retried and speculative tasks leave rows that no one copies. A job
that fails drops its staging table and leaves the target as it was. Works with any DB-API module whose database knows
ON CONFLICT, with a unique index on the target's key.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quillspark.session import ship

#: Rows of one batch.
BATCH = 1000
#: Column types of the staging table; others go as JSON text.
TYPES = {"long": "bigint", "integer": "integer", "short": "smallint", "double": "double precision", "float": "real", "boolean": "boolean", "string": "text", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def quoted(name: str) -> str:
    """A name as SQL takes it; dots part schema and table."""
    parts = name.split(".")
    if not all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_ ]*", p) for p in parts):
        raise ValueError(f"not a plain name: {name}")
    return ".".join(f'"{p}"' for p in parts)


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    rows: int


class BulkWriter(DataSourceArrowWriter):
    """Options: driver (DB-API module, sqlite3 by default), target (what its connect takes), table, batch."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.module, self.target = options.get("driver", "sqlite3"), options["target"]
        self.table, self.batch = options["table"], int(options.get("batch", str(BATCH)))
        if self.batch < 1:
            raise ValueError("a batch has one row or more")
        self.stage = f"{self.table}_stage_{uuid.uuid4().hex[:12]}"
        self.names = [f.name for f in schema]
        self.as_text = [f.dataType.typeName() not in TYPES for f in schema]
        columns = ", ".join(f"{quoted(f.name)} {TYPES.get(f.dataType.typeName(), 'text')}" for f in schema)
        with closing(self.connect()) as db:
            cursor = db.cursor()
            cursor.execute(f"CREATE TABLE {quoted(self.stage)} ({columns}, attempt_ text)")
            cursor.execute(f"CREATE TABLE {quoted(self.stage + '_done')} (attempt_ text)")
            db.commit()

    def connect(self) -> Any:
        module = import_module(self.module)
        return module.connect(self.target, timeout=600) if self.module == "sqlite3" else module.connect(self.target)

    def marks(self, n: int) -> str:
        return ", ".join(["?" if import_module(self.module).paramstyle == "qmark" else "%s"] * n)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        attempt, rows = uuid.uuid4().hex, 0
        insert = f"INSERT INTO {quoted(self.stage)} VALUES ({self.marks(len(self.names) + 1)})"
        with closing(self.connect()) as db:
            for arrow in iterator:
                for start in range(0, arrow.num_rows, self.batch):
                    some = arrow.slice(start, self.batch)
                    columns = [[json.dumps(v, default=str) if text and v is not None else v for v in c.to_pylist()] for c, text in zip(some.columns, self.as_text, strict=True)]
                    db.cursor().executemany(insert, list(zip(*columns, [attempt] * some.num_rows, strict=True)))
                    db.commit()
                    rows += some.num_rows
        return Written(attempt, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [(m.attempt,) for m in messages if isinstance(m, Written) and m.rows]
        names = ", ".join(quoted(n) for n in self.names)
        with closing(self.connect()) as db:
            cursor = db.cursor()
            if done:
                cursor.executemany(f"INSERT INTO {quoted(self.stage + '_done')} VALUES ({self.marks(1)})", done)
            # WHERE tells the parser of some databases that ON CONFLICT is none of the join's
            cursor.execute(f"INSERT INTO {quoted(self.table)} ({names}) SELECT {names} FROM {quoted(self.stage)} JOIN {quoted(self.stage + '_done')} USING (attempt_) WHERE true ON CONFLICT DO NOTHING")
            self.drop(cursor)
            db.commit()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        with closing(self.connect()) as db:
            self.drop(db.cursor())
            db.commit()

    def drop(self, cursor: Any) -> None:
        for name in (self.stage, f"{self.stage}_done"):
            cursor.execute(f"DROP TABLE IF EXISTS {quoted(name)}")


class BulkCopy(DataSource):
    """The format bulk_copy; it writes only, and only in mode append: a copy never empties its target."""

    @classmethod
    def name(cls) -> str:
        return "bulk_copy"

    def writer(self, schema: StructType, overwrite: bool) -> BulkWriter:
        if overwrite:
            raise ValueError("bulk copies append")
        return BulkWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(BulkCopy)
