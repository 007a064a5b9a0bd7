"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A letter n-gram is the product of its letters' vectors, each permuted (rotated)
by its place from the end; a text is the sum of its n-grams' vectors, and a language the sum over its sample texts. The
prediction is the language whose prototype has the largest cosine with the text.

Defined cases: a null or empty text and one without a letter are 'und' with score 0. Training rows with a null language,
a null id or no letter are left out; with no language learned every document is 'und'. Ties go to the language that
sorts first. Very long texts are profiled whole. Repeated rows give repeated results, rows with a null id too. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, fold5, frame, id_type, share_of, small_batches, trimmed, typed
from quillspark.session import ship

UNKNOWN = "und"
DIMENSIONS, SEED = 1024, 20240501
#: Bound of the training sample: about so many documents a language, taken by hashed id.
SAMPLE_DOCS = 1500
#: Vectors of letters and of bound pairs that a Python worker keeps; beyond it the store starts afresh.
KEPT_VECTORS = 40_000
LAST = 0x10FFFF


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(LAST + 1)), bool, LAST + 1)


def letter(point: int, dimensions: int) -> np.ndarray:
    """The random bipolar vector of a code point (0: a gap between words), from a generator seeded with it."""
    return np.random.default_rng((SEED, point)).integers(0, 2, dimensions, np.int8) * 2 - 1


class Store:
    """Vectors by key: of single letters, and of pairs of letters in the first two places of an n-gram (key: 21 bits each), bound."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.row, self.vectors = dimensions, {}, np.zeros((256, dimensions), np.int8)

    def vector(self, key: int) -> np.ndarray:
        if key <= LAST:
            return letter(key, self.dimensions)
        pair = (key >> 21) - 1, key & 0x1FFFFF
        return np.roll(letter(pair[0], self.dimensions), 2) * np.roll(letter(pair[1], self.dimensions), 1)

    def rows(self, keys: list[int]) -> list[int]:
        """Places in vectors of these keys."""
        row = self.row
        if len(row) > KEPT_VECTORS:
            row.clear()
        for k in keys:
            if k not in row:
                if len(row) == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[len(row)] = self.vector(k)
                row[k] = len(row)
        return [row[k] for k in keys]


@cache
def store() -> Store:
    return Store()


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of the lower-cased text, word ends included, as three code points of 21 bits each, and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    points = np.where(is_letter()[points], points, 0)
    points = np.concatenate([[0], points, [0]]).astype(np.uint64)
    points = points[np.append(True, (points[1:] != 0) | (points[:-1] != 0))]
    if len(points) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique((points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:], return_counts=True)


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the n-grams' vectors: whole numbers, so sums of bundles don't depend on their order."""
    kept = store()
    total = np.zeros(kept.dimensions, np.int64)
    for i in range(0, len(grams), 1024):
        g, n = grams[i : i + 1024], counts[i : i + 1024]
        pairs, first = np.unique((g >> np.uint64(21)) + np.uint64(1 << 21), return_inverse=True)  # counted from 1 in the first letter, so that no pair looks like a letter
        lasts, last = np.unique(g & np.uint64(0x1FFFFF), return_inverse=True)
        rows = np.array(kept.rows([*pairs.tolist(), *lasts.tolist()]))
        bound = kept.vectors[rows[first]] * kept.vectors[rows[len(pairs) + last]]
        small = np.float32 if n.sum() < 1 << 24 else np.float64
        total += (n.astype(small) @ bound.astype(small)).astype(np.int64)
    return total


@dataclass
class Profiles:
    langs: list[str]
    prototypes: np.ndarray  # unit rows

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = trigrams(text or "")
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        v = bundle(grams, counts).astype(np.float64)
        norm = float(np.sqrt(v @ v))
        if not norm:
            return UNKNOWN, 0.0
        cosines = self.prototypes @ (v / norm)
        k = int(cosines.argmax())
        return self.langs[k], float(min(1.0, max(0.0, cosines[k])))


SUMS = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("n", pa.int64())])


def bundle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bundle of a task's texts for each language, a row a dimension."""
    sums: dict[str, np.ndarray] = {}
    for b in small_batches(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = bundle(*trigrams(text or ""))
            sums[lang] = sums[lang] + v if lang in sums else v
    for lang, v in sums.items():
        yield frame({"lang": [lang] * len(v), "place": np.arange(len(v)), "n": v}, SUMS)


def train_profiles(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Profiles:
    """docs: doc_id, text, lang. Bundles are summed by the cluster; DIMENSIONS numbers a language reach the driver, however many documents there are."""
    spark = docs.sparkSession
    labelled = docs.filter("lang is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    rates = spark.createDataFrame([(r["lang"], min(1.0, sample_docs / r["count"])) for r in sizes], "lang string, rate double")
    drawn = labelled.join(F.broadcast(rates), "lang").filter(share_of("doc_id", F.col("rate"))).select("lang", "text")
    rows = arrow_map(drawn, bundle_batches, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    sums = {lang: x.sort_values("place")["n"].to_numpy(np.float64) for lang, x in rows.groupby("lang")}
    langs = sorted(lang for lang, v in sums.items() if v.any())
    return Profiles(langs, np.array([sums[x] / np.sqrt(sums[x] @ sums[x]) for x in langs]).reshape(-1, DIMENSIONS))


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict_batches(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        found = [profiles.predict(t) for t in b.column(2).to_pylist()]
        yield frame({"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}, typed(PREDICTED, b))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, held_out (not used in training by train_and_identify), lang_pred, score (cosine, at least 0)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold5(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(rows, lambda it: predict_batches(it, profiles), f"doc_id {id_type(rows)}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text_col: str = "text") -> DataFrame:
    """The documents in which a language is recognised, columns unchanged; decided row by row, without a join."""
    profiles = train_profiles(docs.filter(fold5("doc_id") != 0), sample_docs)
    ship(docs.sparkSession)

    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([profiles.predict(t)[0] != UNKNOWN for t in texts], dtype=bool)

    def tidy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return trimmed(known(batches))

    return docs.filter(F.pandas_udf(tidy, "boolean")(text_col))


def train_and_identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the documents outside fold 0 and predict all."""
    return identify(docs, train_profiles(docs.filter(fold5("doc_id") != 0), sample_docs))
