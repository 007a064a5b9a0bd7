"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its surroundings.

A candidate is a maximal run of 12 or more of [A-Za-z0-9+/_.=-]. The network sees the run and the bytes around it (of a long
run, overlapping windows over the whole of it, of which the highest score counts). It is trained in numpy on labelled
findings: candidates of a bounded sample of documents, labelled by the fixed patterns, and seeded examples of secrets by
kind and of harmless runs. It is calibrated by Platt scaling on held-out findings. The threshold is set on held-out secrets
of the kinds that no pattern describes (UNPATTERNED), as the patterns' own findings stay anyway: the largest one that keeps
RECALL of every single kind. So it does not move with what the patterns find in a corpus. What the patterns find always stays; accepted
candidates that no pattern's span holds in full are added as kind 'model'.

Defined cases: a null or empty text has no findings. Offsets are code points, ends exclusive. Very long texts are
scanned whole. Repeated rows give repeated results, rows with a null id too. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, cut, frame, id_type, quantile_threshold, share_of, small_batches, trimmed, typed
from quillspark.session import ship

#: Fixed values of the scan's contract: kinds in order, patterns, least lengths.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}+")

#: Bounds of the training sample: about so many documents read for it, and about so many findings used.
SAMPLE_DOCS, SAMPLE_FINDINGS = 20_000, 2_000
RECALL = 0.95
#: Weight in training of runs that no pattern marks.
UNMARKED = 0.1
#: Seeded findings to learn from, and others that are held out.
SEEDED, SEEDED_HELD = 2400, 1600
BEFORE, INSIDE, AFTER = 28, 44, 8
WIDTH = BEFORE + INSIDE + AFTER


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """start, end, kind index in bytes: leftmost non-overlapping per kind, failing matches dropped."""
    spans = []
    if b"=" in data or b":" in data:
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(data)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def candidates(data: bytes) -> list[tuple[int, int]]:
    """Runs, in bytes."""
    return [m.span() for m in CANDIDATE.finditer(data)]


def stretches(start: int, end: int) -> list[tuple[int, int]]:
    """What one window each shows of a run: the run, or overlapping pieces of a long one, the last up to its end."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]]


def window(data: bytes, start: int, end: int) -> bytes:
    """Context before, a stretch of at most INSIDE bytes, context after; padded with zero bytes."""
    return data[max(0, start - BEFORE) : start].rjust(BEFORE, b"\0") + data[start:end].ljust(INSIDE, b"\0") + data[end : end + AFTER].ljust(AFTER, b"\0")


def apart(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[bool]:
    """For each run whether no span overlaps it. spans: by start."""
    starts = [a for a, _, _ in spans]
    reach = list(accumulate((b for _, b, _ in spans), max))
    return [not (k := bisect_left(starts, end)) or reach[k - 1] <= start for start, end in runs]


def held(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[bool]:
    """For each run whether one span holds the whole of it. spans: by start."""
    starts = [a for a, _, _ in spans]
    reach = list(accumulate((b for _, b, _ in spans), max))
    return [bool(k := bisect_left(starts, start + 1)) and reach[k - 1] >= end for start, end in runs]


#: Kinds of seeded secrets that no fixed pattern describes.
UNPATTERNED = ("prefixed", "jwt", "letters", "bearer", "url")


def seeded_by_kind(n: int = SEEDED, seed: int = 7) -> tuple[list[bytes], list[int], list[str]]:
    """Windows of made-up secrets (1) and of harmless runs (0), each inside made-up prose, and their kinds."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    between = lambda a, b: int(rng.integers(a, b))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, between(2, 9))
    words = lambda: " ".join(word() for _ in range(6))
    one = lambda *options: options[between(0, len(options))]
    secret = {
        "hex": lambda: ("", pick("0123456789abcdef", between(24, 64)), " "),
        "access": lambda: ("", "AKIA" + pick(up + num, 16), " "),
        "assign": lambda: (one("password=", "token = ", "secret: ", "api_key="), pick(low + up + num + "+/", between(16, 44)), " "),
        "prefixed": lambda: ("", one("ghp_", "gho_", "xoxb-", "sk-", "glpat-", "npm_") + pick(low + up + num, between(24, 40)), " "),
        "jwt": lambda: ("", "eyJ" + pick(low + up + num, between(14, 30)) + "." + "eyJ" + pick(low + up + num, between(14, 40)) + "." + pick(low + up + num + "_-", between(30, 44)), " "),
        "letters": lambda: ("", "".join(rng.permutation(list(pick(low, 5) + pick(up, 5) + pick(low + up, between(6, 22))))), " "),
        "bearer": lambda: (one("Authorization: Bearer ", "private key ", "credential "), pick(low + up + num + "+/", between(18, 44)), " "),
        "url": lambda: (f"{one('postgres', 'mysql', 'amqp', 'https')}://{word()}:", pick(low + up + num, between(14, 30)), f"@{word()}.{word()}.com "),
    }
    harmless = {
        "ip": lambda: ("", ".".join(str(between(100, 256)) for _ in range(4)), " "),
        "mail": lambda: ("", f"{word()}.{word()}{between(0, 99)}", f"@mail{between(0, 99)}.{pick(low, 7)}.com "),
        "host": lambda: ("@", f"mail{between(0, 99)}.{pick(low, 7)}.com", " "),
        "date": lambda: ("", f"20{between(10, 30)}-0{between(1, 9)}-{between(10, 28)}T{between(10, 23)}.{between(10, 59)}", " "),
        "version": lambda: ("", f"{pick(low, 6)}-{pick(low, 5)}-v{between(1, 9)}.{between(0, 20)}", " "),
        "link": lambda: ("//", f"{pick(low, 8)}.com/{pick(low, 5)}/{between(1, 9999)}", " "),
        "phone": lambda: ("+", f"{between(10, 99)}-{between(100, 999)}-{between(1000, 9999)}", " "),
        "numbered": lambda: ("", pick(low, between(10, 18)) + pick(num, 2), " "),
        "lower": lambda: ("", pick(low, between(12, 20)), " "),
        "upper": lambda: ("", pick(up, between(12, 20)), " "),
        "hyphens": lambda: ("", "-".join(word() for _ in range(4)).ljust(12, "a") + one(".", "", "..."), " "),
        "title": lambda: ("", pick(up, 1) + pick(low, between(11, 16)) + one(".", "", "."), " "),
        "joined": lambda: ("", "".join(word().capitalize() for _ in range(between(3, 5))).ljust(12, "a"), " "),
        "path": lambda: ("/", "/".join(word() for _ in range(4)).ljust(12, "a"), " "),
        "rule": lambda: ("", one("-", "=", "_", ".") * between(12, 60), " "),
        "amount": lambda: ("", f"{between(1, 999)}.{between(100, 999)}.{between(100, 999)}.{between(100, 999)}", " "),
        "snake": lambda: ("", "_".join(word() for _ in range(4)).ljust(12, "a"), " "),
    }
    rows, labels, kinds = [], [], []
    for i in range(n):
        label = i % 2
        makers = secret if label else harmless
        kind = list(makers)[i // 2 % len(makers)]
        lead, run, tail = makers[kind]()
        before = f"{words()} {lead}".encode()
        data = before + run.encode() + f"{tail}{words()}".encode()
        for piece in stretches(len(before), len(before) + len(run)):
            rows.append(window(data, *piece))
            labels.append(label)
            kinds.append(kind)
    return rows, labels, kinds


def seeded_findings(n: int = SEEDED, seed: int = 7) -> tuple[list[bytes], list[int]]:
    return seeded_by_kind(n, seed)[:2]


@dataclass
class Network:
    """Byte embedding, convolutions of several widths, max pooling over positions, a logistic output; all in numpy."""

    params: dict[str, np.ndarray]
    widths: tuple[int, ...] = (3, 5)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 3, size: int = 10, filters: int = 20, widths: tuple[int, ...] = (3, 5)) -> Network:
        rng = np.random.default_rng(seed)
        p = {"emb": rng.normal(0, 0.3, (256, size)), "out": rng.normal(0, 0.1, (2 * filters * len(widths),)), "bias": np.zeros(1)}
        for w in widths:
            p[f"w{w}"], p[f"b{w}"] = rng.normal(0, (w * size) ** -0.5, (w * size, filters)), np.zeros(filters)
        return cls({k: v.astype(np.float32) for k, v in p.items()}, widths)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Logits of windows (n, WIDTH), and what the backward pass needs. Context and run are pooled apart."""
        p, kept, pooled = self.params, [], []
        e = p["emb"][x]
        for w in self.widths:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - w + 1, -1)
            act = np.maximum(cols @ p[f"w{w}"] + p[f"b{w}"], 0)
            for a, b in ((0, BEFORE), (BEFORE, WIDTH - w + 1)):
                top = act[:, a:b].argmax(1)
                pooled.append(np.take_along_axis(act[:, a:b], top[:, None], 1)[:, 0])
                kept.append((w, cols, top + a))
        h = np.concatenate(pooled, 1)
        return h @ p["out"] + p["bias"], [h, kept]

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        p = self.params
        z, (h, kept) = self.forward(x)
        dz = ((1 / (1 + np.exp(-z)) - y) * weight / len(x)).astype(np.float32)
        g = {"out": h.T @ dz, "bias": dz.sum(keepdims=True), "emb": np.zeros_like(p["emb"])} | {f"{c}{w}": np.zeros_like(p[f"{c}{w}"]) for w in self.widths for c in "wb"}
        dh = dz[:, None] * p["out"] * (h > 0)
        size, at = p["emb"].shape[1], 0
        for w, cols, top in kept:
            d = dh[:, at : at + top.shape[1]]
            at += top.shape[1]
            picked = cols[np.arange(len(x))[:, None], top]  # (n, filters, w*size)
            g[f"w{w}"] += np.einsum("nf,nfk->kf", d, picked)
            g[f"b{w}"] += d.sum(0)
            de = (d[:, :, None] * p[f"w{w}"].T[None]).reshape(len(x), -1, w, size)
            index = x[np.arange(len(x))[:, None, None], top[:, :, None] + np.arange(w)]
            np.add.at(g["emb"], index, de)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 5) -> None:
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        weight = np.ones(len(x), np.float32) if weight is None else weight
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                some = order[i : i + batch]
                for k, g in self.gradient(x[some], y[some], weight[some]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.params[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def score(self, rows: list[bytes]) -> np.ndarray:
        """Calibrated probabilities."""
        if not rows:
            return np.zeros(0)
        x = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH)
        z = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]).astype(np.float64)  # near 1, single precision rounds to 1
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def calibrate(self, rows: list[bytes], y: np.ndarray, recall: float, kinds: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps, then the largest threshold that keeps the recall of the positives, or of those of
        each unpatterned kind."""
        self.slope, self.shift = 1.0, 0.0
        p = np.clip(self.score(rows), 1e-9, 1 - 1e-9)
        z = np.log(p / (1 - p))
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = q * (1 - q) + 1e-6
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, [((q - goal) * z).sum(), (q - goal).sum()])
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.shift = max(float(a), 0.05), float(b)
        scores = self.score(rows)
        groups = [y > 0] if kinds is None else [kinds == k for k in UNPATTERNED]
        self.threshold = min(quantile_threshold(pd.Series(scores[g]), recall) for g in groups)


FINDING = pa.schema([("place", pa.int64()), ("window", pa.binary()), ("label", pa.int32())])


def sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        places, rows, labels = [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            pieces = [piece for run in candidates(data) for piece in stretches(*run)]
            for piece, free in zip(pieces, apart(pieces, base_spans(data)) if pieces else [], strict=True):
                places.append(int.from_bytes(blake2b(f"{key}:{piece[0]}".encode(), digest_size=8).digest(), "big", signed=True))
                rows.append(window(data, *piece))
                labels.append(int(not free))
        yield frame({"place": places, "window": rows, "label": labels}, FINDING)


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, findings: int = SAMPLE_FINDINGS) -> list[tuple[bytes, int]]:
    """At most so many windows with their labels, of about so many documents, in an order of their own."""
    drawn = docs.filter(share_of("doc_id", min(1.0, sample_docs / max(1, docs.count()))))
    found = cut(arrow_map(drawn, sample_batches, "place long, window binary, label int"))
    some = found.filter(share_of("place", min(1.0, findings / max(1, found.count()))))  # no task sends more than its share
    return sorted((bytes(r.window), r.label) for r in some.limit(findings).collect())


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, findings: int = SAMPLE_FINDINGS, recall: float = RECALL) -> Network:
    """docs: doc_id, text. The sample is taken by hashed id and place, so it is the same on every run."""
    found = sample(docs, sample_docs, findings)
    rows, labels = seeded_findings()
    made = len(rows)
    rows, labels = rows + [w for w, _ in found], np.array(labels + [label for _, label in found], np.float32)
    corpus = np.arange(len(rows)) >= made
    held = (np.random.default_rng(11).random(len(rows)) < 0.2) & corpus & (labels > 0)
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH)
    network = Network.fresh()
    network.fit(x[~held], labels[~held], np.where(corpus & (labels == 0), UNMARKED, 1.0).astype(np.float32)[~held])
    apart, apart_labels, kinds = seeded_by_kind(SEEDED_HELD, seed=8)
    apart, kinds = apart + [r for r, h in zip(rows, held, strict=True) if h], np.array(kinds + [""] * int(held.sum()))
    network.calibrate(apart, np.concatenate([np.array(apart_labels, np.float32), labels[held]]), recall, kinds)
    return network


ITEM = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
SCANNED = pa.schema([("doc_id", pa.int64()), ("findings", pa.list_(ITEM))])


def scan_batches(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        spans, windows, owner, firsts = [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            data = (text or "").encode()
            base = base_spans(data)
            runs = candidates(data)
            every = sorted([*base, *[(*c, 3) for c, inside in zip(runs, held(runs, base), strict=True) if not inside]], key=lambda s: (s[0], s[2]))
            if not every:
                continue
            points = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))  # code points before each byte
            for s in every:
                pieces = stretches(s[0], s[1])
                firsts.append(len(windows))
                windows += [window(data, *piece) for piece in pieces]
                owner.append(i)
                spans.append((KINDS[s[2]], int(points[s[0]]), int(points[s[1]])))
        found: list[list] = [[] for _ in range(b.num_rows)]
        scores = np.maximum.reduceat(network.score(windows), firsts) if firsts else np.zeros(0)
        for i, (kind, start, end), score in zip(owner, spans, scores.tolist(), strict=True):
            if kind != "model" or score >= network.threshold:
                found[i].append({"kind": kind, "start": start, "end": end, "score": score})
        yield frame({"doc_id": b.column(0), "findings": found}, typed(SCANNED, b))


def scan_secrets(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, findings array<struct<kind, start, end, score>> by start, then kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    network = network or train(rows)
    return arrow_map(rows, lambda it: scan_batches(it, network), f"doc_id {id_type(rows)}, findings array<struct<kind string, start int, end int, score double>>")


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return scanned.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, network: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every finding replaced by the mark; overlapping findings become one. Columns and order stay;
    n_chars, where there is such a column, follows the text."""
    network = network or train(docs.select("doc_id", "text"))
    ship(docs.sparkSession)

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            b = pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(texts), pa.int64()), "text": pa.array(texts, pa.string(), from_pandas=True)})
            out = []
            for text, found in zip(b.column(1).to_pylist(), (f for s in scan_batches(iter([b]), network) for f in s.column(1).to_pylist()), strict=True):
                parts, at = [], 0
                for f in found:
                    if f["end"] <= at:
                        continue
                    if f["start"] >= at:
                        parts += [text[at : f["start"]], mark]
                    at = f["end"]
                out.append(text if text is None or not found else "".join([*parts, text[at:]]))
            yield pd.Series(out, dtype=object)

    def tidy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return trimmed(clean(batches))

    cleaned = docs.withColumn("text", F.pandas_udf(tidy, "string")("text"))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
