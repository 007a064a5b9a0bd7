"""Corpus operators on cases that shortcuts would lose."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillspark.llm import license_scan, quality, secret_scan

PROSE = "the quick brown fox jumps over a lazy dog while many small birds sing in old trees near our river".split()


@pytest.mark.parametrize("text, license", [("Released under the MIT Licence.", "mit-notice"), ("Distributed under CC BY-NC 4.0.", "cc-by-nc-4.0-notice"), ("Released under the BSD License.", "bsd-notice"), ("Licensed under CC BY 4.0.", "cc-by-4.0-notice"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0-notice")])
def test_license_without_key_word(text, license):
    assert [f["license"] for f in license_scan.scan(f"Some words. {text} More words.")] == [license]


@pytest.mark.parametrize("name", [t.name for t in license_scan.templates()])
def test_no_copy_is_skipped(name):
    """Copies with any words replaced or left out, as many as the coverage allows, the key words among them."""
    t = next(t for t in license_scan.templates() if t.name == name)
    rng, m = random.Random(name), len(t.words)
    for i in range(2 if m > 400 else 12):
        gone = set(rng.sample(range(m), m - t.need))
        copy = [f"x{k}" if i % 2 else None for k in range(m)]
        copy = [c if k in gone else w for k, (w, c) in enumerate(zip(t.words, copy, strict=True))]
        lead = [rng.choice(PROSE[9:]) for _ in range(rng.randint(0, 60))]
        text = " ".join([*lead, *[w for w in copy if w], *PROSE])
        begin, end = len(" ".join(lead)), len(text) - len(" ".join(PROSE))
        assert any(f["start"] < end and f["end"] > begin for f in license_scan.scan(text)), text[:500]


@pytest.mark.parametrize("name", [t.name for t in license_scan.templates()])
def test_each_license_is_itself(name):
    found = license_scan.scan("Prose before. " + (license_scan.TEMPLATES | license_scan.TEXTS)[name] + " Prose after.")
    assert name in [f["license"] for f in found if f["coverage"] == 1.0]


class Fixed:
    """A network that accepts windows with the word zqj in the run."""

    threshold = 0.3

    def score(self, rows):
        return np.array([0.4 * (b"zqj" in r[secret_scan.BEFORE : secret_scan.BEFORE + secret_scan.INSIDE]) for r in rows])


def findings(text):
    [out] = secret_scan.scan_batches(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})]), Fixed())
    return [(f["kind"], f["start"], f["end"]) for f in out.column(1).to_pylist()[0]]


@pytest.mark.parametrize("text, want", [("a AbzqjKLmnOPqrs b", [("model", 2, 16)]), ("a " + "p/" * 60 + "1zqj" + "/p" * 60 + " b", [("model", 2, 246)]), ("a zqj-24be64439e3e49cf46b2 b", [("model", 2, 26), ("hex", 6, 26)]), ("token=zqj456789012345 b", [("assign", 0, 21)])])
def test_every_run_is_scored_whole(text, want):
    assert findings(text) == want


def test_recall_decides_the_threshold():
    rows, labels = secret_scan.seeded_findings(200)
    network, y = secret_scan.Network.fresh(), np.array(labels, np.float32)
    network.calibrate(rows, y, 0.98)  # not trained: many positives score below 0.5
    assert (network.score(rows)[y > 0] >= network.threshold).mean() >= 0.98


def test_no_reference_without_support(spark):
    good = [f"the {w} and the {x} went to the old house by the river near " * 12 for w in PROSE for x in PROSE[:3]]
    junk = "zx9 #qq 77$ kk|| " * 60
    rows = [(i, t + str(i), "en") for i, t in enumerate(good)] + [(900, junk, "xx"), (901, junk, None), (902, junk + "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality.references(docs).langs == ["en"]
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].nearest == "en" and got[i].char_divergence > quality.MAX_CHAR_DIVERGENCE for i in (900, 901, 902))
    assert got[0].nearest == "en" and got[0].char_divergence <= quality.MAX_CHAR_DIVERGENCE


@pytest.mark.parametrize("stage", ["exact_dedup", "near_dedup"])
def test_a_decision_hits_its_row(spark, stage):
    one, two = " ".join(PROSE), " ".join(reversed(PROSE))
    rows = [(1, one), (1, one), (None, one), (2, one), (2, two), (3, "another text that nobody copies at all"), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)[stage](spark, docs, "").collect()
    assert sorted((r.text, r.doc_id) for r in kept) == sorted([(one, 2 if stage == "exact_dedup" else 1), (two, 2), rows[5][::-1]])


@pytest.mark.parametrize("name", [t.name for t in license_scan.templates()])
def test_copies_with_words_put_in(name):
    """A foreign word after each word, after every second, and deletions together with insertions: all found, with their true coverage."""
    t = next(t for t in license_scan.templates() if t.name == name)
    m, rng = len(t.words), random.Random(len(name))
    foreign = lambda: "zq" + rng.choice("bdfgk") + str(rng.randrange(10_000))
    around = " ".join(foreign() for _ in range(60))
    for kind in ("each", "second", "both"):
        gone = set(rng.sample(range(m), (m - t.need) // 2)) if kind == "both" else set()
        said, left = [], [w for i, w in enumerate(t.words) if i not in gone]
        for i, w in enumerate(left):
            said += [w] + [foreign()] * (kind == "each" or (kind == "second" and i % 2 == 1)) + [foreign() for _ in range(rng.choice((0, 0, 1, 2)) if kind == "both" else 0)]
        text = f"{around} {' '.join(said)} {around}"
        found = license_scan.scan(text)
        best = max((f["matched"] for f in found), default=0)
        assert best >= len(left) * 0.995, (kind, best, len(left), m)  # another template that shares the words may claim them
