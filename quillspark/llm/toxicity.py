"""Toxicity scores from a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows that hashes of the word and of its first 4 and 5 letters select, so that words
of one stem are alike and words that share a row by chance share only a part.
Filters of widths 1, 2 and 3 slide over the words, each keeps its largest response in the whole text, and a logistic
output scores these. Decision thresholds are calibrated for each language, as the hyperdimensional profiles recognise it
from the text, on labelled documents that the fit did not see; a score of 0.5 stands at the language's threshold.

Defined cases: a null or empty text, or one without words, scores as a text of one neutral word. Very long texts are
scored whole. Labels that are null, or of rows with a null id, teach nothing; a document with several labels counts as
toxic if one says so. Without both classes every score is 0.25. Repeated rows give repeated results, rows with a null id
too. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, fold5, frame, id_type, small_batches, space_words, typed
from quillspark.llm.language_id import Profiles, train_profiles

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 17, 12, 12, (1, 2, 3)
#: Rows a word: itself and its beginnings of these lengths.
STEMS = (4, 5)
ROWS = 1 + len(STEMS)
#: Bounds of the training sample: documents of either class (by hashed id), and words of all of them together: in the order
#: of the hashed id, documents are taken whole, whatever their length, until about this many words (of six characters) are reached.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WORDS = 2000, 3000, 4_000_000
#: Parts of the sample, each scored by a fit on the others to set the thresholds.
FOLDS = 3
#: A language needs so many toxic calibration documents for a threshold of its own.
LEAST_TOXIC = 8
#: Rows of the table that fewer sample documents use stay zero: they could only learn single documents by heart.
LEAST_DOCS = 3
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"


def word_codes(words: list[str]) -> np.ndarray:
    """Bucket numbers of each word, lower case and without signs at its ends; a part that the word is too short for has bucket 0."""
    plain = [w.lower().strip(EDGES) for w in words]
    code = lambda parts: np.fromiter(((xxhash.xxh3_64_intdigest(p) % (BUCKETS - 1) + 1 if p else 0) for p in parts), np.int32, len(plain))
    return np.stack([code(plain), *[code([f"{w[:n]}^{n}" if len(w) >= n else "" for w in plain]) for n in STEMS]], 1)


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's words begin (and the last end), the words' codes, the buckets by code. Texts have a word at least: the empty one."""
    at, codes, words = space_words(texts, " ")
    return at, codes, word_codes(words)


@dataclass
class Classifier:
    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    usual: float = 0.0
    trained: bool = False

    @classmethod
    def fresh(cls, seed: int = 9) -> Classifier:
        rng = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        table = f32(rng.normal(0, 0.03, (BUCKETS, SIZE)))
        return cls(table, {w: f32(rng.normal(0, 0.5, (w, SIZE, FILTERS))) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, f32(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)), -2.0)

    def responses(self, embedded: np.ndarray, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each width the largest response of every filter in every text, and, of the texts' words, where it starts.
        embedded: a row a distinct word. Texts shorter than a width are padded with nothing (zero)."""
        sizes = np.diff(at)
        for w in WIDTHS:
            parts = [embedded @ self.filters[w][j] for j in range(w)]
            act = parts[0][codes]
            short, long = sizes < w, sizes >= w
            for j in range(1, w):
                act[:-j] += parts[j][codes[j:]]
                for d in range(1, j + 1):  # what short texts have of the next text, zero counts instead
                    p = at[1:][short & (sizes >= d)] - d
                    p = p[p + j < len(codes)]
                    act[p] -= parts[j][codes[p + j]]
            for j in range(1, w):  # long texts have no responses that reach into the next text
                act[at[1:][long] - j] = -np.inf
            yield w, act + self.bias[w], sizes

    def pooled(self, embedded: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(np.maximum.reduceat(act, at[:-1], axis=0), 0) for _, act, _ in self.responses(embedded, codes, at)], 1)

    def logits(self, at: np.ndarray, codes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        return self.pooled(self.table[buckets].sum(1), codes, at) @ self.out + self.offset

    def logits_of(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of texts given as the buckets of their words."""
        if not texts:
            return np.zeros(0)
        flat = np.concatenate(texts)
        return self.logits(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.arange(len(flat)), flat)

    def fit(self, texts: list[np.ndarray], y: np.ndarray, steps: int = 400, batch: int = 16, rate: float = 0.01, decay: float = 1e-4, seed: int = 4) -> None:
        """Adam on the logistic loss; rows of the table move only when a largest response came from them."""
        rng, moments, step = np.random.default_rng(seed), {}, 0
        used = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=BUCKETS) >= LEAST_DOCS
        used[0] = False
        self.table[~used] = 0
        table_m, table_v = np.zeros_like(self.table), np.zeros_like(self.table)

        def move(name, value, g):
            m, v = moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(value.dtype)

        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).clip(0, 4)
        for _ in range(min(60, max(4, round(steps * batch / len(texts))))):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                step += 1
                flat = np.concatenate([texts[k] for k in some])
                at = np.concatenate([[0], np.cumsum([len(texts[k]) for k in some])])
                embedded, codes = self.table[flat].sum(1), np.arange(len(flat))
                tops, found = [], []
                for w, act, _ in self.responses(embedded, codes, at):
                    top = np.stack([act[a:b].argmax(0) + a for a, b in zip(at[:-1], at[1:], strict=True)])
                    found.append(np.maximum(np.take_along_axis(act, top, 0), 0))
                    tops.append((w, top))
                h = np.concatenate(found, 1)
                z = h @ self.out + self.offset
                dz = ((1 / (1 + np.exp(-z)) - y[some]) * weight[some] / len(some)).astype(np.float32)
                dh = dz[:, None] * self.out * (h > 0)
                gradients = {"out": h.T @ dz + decay * self.out}
                grown, rows = [], []
                for n, (w, top) in enumerate(tops):
                    d = dh[:, n * FILTERS : (n + 1) * FILTERS]
                    gf = np.zeros_like(self.filters[w])
                    for j in range(w):
                        where = top + j
                        inside = where < at[1:, None]
                        where = np.where(inside, where, 0)
                        dj = d * inside
                        gf[j] = np.einsum("bfs,bf->sf", embedded[where], dj)
                        grown.append((dj[:, :, None] * self.filters[w][j].T[None]).reshape(-1, SIZE))
                        rows.append(where.ravel())
                    gradients[f"f{w}"], gradients[f"b{w}"] = gf + decay * self.filters[w], d.sum(0)
                for n, w in enumerate(WIDTHS):
                    move(f"f{w}", self.filters[w], gradients[f"f{w}"])
                    move(f"b{w}", self.bias[w], gradients[f"b{w}"])
                move("out", self.out, gradients["out"])
                self.offset -= rate * float(dz.sum())
                grown, rows = np.concatenate(grown), np.concatenate(rows)
                live = np.abs(grown).sum(1) > 0
                buckets = flat[rows[live]].ravel()
                unique, back = np.unique(buckets, return_inverse=True)
                g = np.zeros((len(unique), SIZE), np.float32)
                np.add.at(g, back.ravel(), np.repeat(grown[live], ROWS, axis=0))
                g[~used[unique]] = 0
                table_m[unique] += 0.1 * (g - table_m[unique])
                table_v[unique] += 0.01 * (g * g - table_v[unique])
                self.table[unique] -= rate * (table_m[unique] / (1 - 0.9**step)) / (np.sqrt(table_v[unique] / (1 - 0.99**step)) + 1e-7)
        self.trained = True

    def calibrate(self, logits: np.ndarray, y: np.ndarray, langs: list[str]) -> None:
        """For each language the threshold of the best F1, in the middle of the gap where it is reached."""

        def best(z: np.ndarray, t: np.ndarray) -> float:
            order = np.argsort(-z, kind="stable")
            z, t = z[order], t[order]
            f1 = 2 * np.cumsum(t) / (np.arange(1, len(t) + 1) + t.sum())
            k = int(f1.argmax())
            return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k]) - 0.1

        if y.sum():
            self.usual = best(logits, y)
        for lang in sorted(set(langs)):
            mine = np.array([x == lang for x in langs])
            if y[mine].sum() >= LEAST_TOXIC:
                self.thresholds[lang] = best(logits[mine], y[mine])

    def scores(self, logits: np.ndarray, langs: list[str]) -> np.ndarray:
        if not self.trained:
            return np.full(len(logits), 0.25)
        return 1 / (1 + np.exp(-np.clip(logits - np.array([self.thresholds.get(x, self.usual) for x in langs]), -30, 30)))


SAMPLE = pa.schema([("place", pa.int64()), ("toxic", pa.int32()), ("lang_pred", pa.string()), ("codes", pa.binary())])


def sample_batches(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, chars=4_000_000):
        at, codes, buckets = encoded(b.column(1))
        texts = [buckets[codes[i:j]].astype("<i4").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        langs = [profiles.predict(t)[0] for t in b.column(1).to_pylist()]
        yield frame({"place": b.column(0), "toxic": b.column(2), "lang_pred": langs, "codes": texts}, SAMPLE)


def train(docs: DataFrame, labels: DataFrame, profiles: Profiles) -> Classifier:
    """docs: doc_id, text; labels: doc_id, toxic. Thresholds come from scores of documents that a fit on the other folds gave;
    the model itself is fitted on the whole sample."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    place = F.xxhash64(F.col("doc_id").cast("string"))
    draw = lambda which, n: known.filter(F.col("toxic") == which).orderBy(place, "doc_id").limit(n)
    chosen = draw(1, SAMPLE_TOXIC).unionByName(draw(0, SAMPLE_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(place.alias("place"), "text", "toxic")
    sizes = rows.select("place", (F.coalesce(F.length("text"), F.lit(0)) / 6 + 1).alias("words")).collect()  # at most as many as the sample has
    total, last = 0.0, None
    for r in sorted(sizes):
        total += r.words
        if total > SAMPLE_WORDS and last is not None:
            break
        last = r.place
    rows = rows.filter(F.col("place") <= last) if last is not None else rows
    rows = arrow_map(rows, lambda it: sample_batches(it, profiles), "place long, toxic int, lang_pred string, codes binary").collect()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r.place)), r.codes))
    model, y = Classifier.fresh(), np.array([r.toxic for r in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        return model
    texts = [np.frombuffer(r.codes, "<i4").reshape(-1, ROWS) for r in rows]
    fold, y_hat = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for k in range(FOLDS):
        apart, part = fold == k, Classifier.fresh()
        if y[~apart].min() == y[~apart].max():  # too few documents for folds: the fit judges itself
            part.fit(texts, y)
        else:
            part.fit([t for t, a in zip(texts, apart, strict=True) if not a], y[~apart])
        y_hat[apart] = part.logits_of([t for t, a in zip(texts, apart, strict=True) if a])
    model.fit(texts, y)
    model.calibrate(y_hat, y, [r.lang_pred for r in rows])
    return model


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_batches(batches: Iterator[pa.RecordBatch], model: Classifier, profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, chars=4_000_000):
        at, codes, buckets = encoded(b.column(2))
        langs = [profiles.predict(t)[0] for t in b.column(2).to_pylist()] if model.thresholds else [""] * b.num_rows
        scores = model.scores(model.logits(at, codes, buckets), langs)
        yield frame({"doc_id": b.column(0), "held_out": b.column(1), "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}, typed(SCORED, b))


def score_toxicity(docs: DataFrame, model: Classifier, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold5(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(rows, lambda it: score_batches(it, model, profiles), f"doc_id {id_type(rows)}, held_out boolean, score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents outside fold 0 and score all."""
    learnable = docs.filter(fold5("doc_id") != 0)
    profiles = train_profiles(learnable)
    return score_toxicity(docs, train(learnable, labels.filter(fold5("doc_id") != 0), profiles), profiles)
