"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes each result as Parquet and reads it
back for the next. All stages but the last return the columns of documents, extra ones too, whatever their names.

Defined cases, for all stages: an empty table gives an empty result. Very long texts are taken whole. Repeated rows and null
or repeated doc_ids are rows like others: a decision hits exactly its row. Null or empty texts, and others without a letter,
have no language and go in the first stage; a stage that is given some all the same keeps one of them as copies of each
other (exact), keeps all (near), leaves them as they are (secrets), and packs the end id alone (packing). Ties are told apart
by doc_id, then by text: rows that agree in both are alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from quillspark.llm.common import Shared, drop_ids, spread, table
from quillspark.llm.queries import vocabulary
from quillspark.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language can be recognised (und); learned from this input's own tags."""
    return language_id.keep_known(docs)


def keyed(docs: DataFrame, order: Column, shared: Shared) -> tuple[DataFrame, str]:
    """The documents and a column that tells rows apart: doc_id where it is unique and not null, else a written row number in
    the given order, and by text where ids are equal."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if ids.isEmpty():
        return docs, "doc_id"
    name = "_row"
    while name in docs.columns:
        name = f"_{name}"
    return shared(docs.orderBy(order, F.md5("text")).withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without(docs: DataFrame, rows: DataFrame, key: str, decide: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The documents whose row the decision keeps. decide: doc_id (the row's key) and kept of the rows."""
    return drop_ids(rows, decide(rows, key).filter("not kept").select("doc_id"), key).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty are equal) one row stays, that with the largest id."""
    rows, key = keyed(docs, F.asc_nulls_first("doc_id"), Shared(spark))  # the rows belong to the result, which is read later
    return without(docs, rows, key, lambda r, k: exact_dedup.exact_dedup(r, k))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays, that with the smallest id."""
    rows, key = keyed(docs, F.asc_nulls_last("doc_id"), Shared(spark))
    return without(docs, rows, key, lambda r, k: near_dedup.near_dedup(r, id_col=k))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found by a mark; all documents stay."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), lean=True)


def staged(f: Stage) -> Stage:
    """The stage, with this package sent to the executors first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", staged(identify_language)),
    ("exact_dedup", staged(drop_exact_copies)),
    ("near_dedup", staged(drop_near_copies)),
    ("secret_scan", staged(redact_secrets)),
    ("packing", staged(pack_sequences)),
]

#: Learned stages and tokenizers are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each but the last written to the shared folder and read again."""
    docs = spread(table(spark, sf_dir, "documents"))
    with Shared(spark) as shared:
        for name, stage in STAGES[:-1]:
            docs = shared(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)  # holds its pieces itself, so the tables can go
