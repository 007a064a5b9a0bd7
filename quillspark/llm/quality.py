"""Quality rules: plain counts, and Jensen-Shannon distance of a document's histograms from language references.

The references come from the whole corpus: for every language that at least REFERENCE_DOCS documents and REFERENCE_WORDS words
are tagged with (of more than REFERENCES such tags those with the most documents), the share of each character class and of each common
word (those of at least COMMON_SHARE of the language's words). A document is compared with every language and judged by
the nearest, so a wrong or missing language tag costs nothing. Divergences are in bits (0 to 1), distances their roots.

A document of a language without a reference is not measured by the words of another one: where the nearest reference's common
words make up less than FOREIGN of the share that they have in that language, the document is foreign to all references, and
only its shape counts: character classes with letters of any script as one, against the nearest reference's, with the fixed limit
MAX_SHAPE_DIVERGENCE (letters of scripts without capitals are 0.025 off; symbols, rules and shouting much further).

The limits come from the corpus too: of the documents nearest to a language and of about the same length (powers of two, as short
histograms are noisy), the quartiles of either distance are taken over all documents. A document is rejected beyond the
third quartile plus FENCE interquartile ranges, or twice the median if that is more. Where fewer than REFERENCE_DOCS documents
are alike the limits are those of documents of that length in any language, if these are larger than the roots of MAX_CHAR_DIVERGENCE and
MAX_WORD_DIVERGENCE.

Defined cases: a null or empty text has no words, fails the base rule and has no divergence (null). The character test
needs MIN_CHARS characters in words and the word test MIN_WORDS words; shorter documents pass the test. Documents with a
null language or one with less support are judged like all others, but make no reference; without any reference there is no divergence. Very long texts are processed whole. Repeated rows are each counted and
judged, rows with a null id too. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, cut, frame, id_type, small_batches, typed

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
COMMON_SHARE = 0.004
MIN_CHARS, MIN_WORDS = 200, 50
#: Limits where too few documents are alike to derive one.
MAX_CHAR_DIVERGENCE, MAX_WORD_DIVERGENCE = 0.10, 0.20
#: Interquartile ranges beyond the third quartile at which a document is rejected.
FENCE = 4.0
#: Steps of a distance (0 to 1) in which quartiles are taken, rounded up.
BINS = 1000
#: Support that a language needs to be a reference: documents, words; and references at most, which bounds what tasks are sent.
REFERENCE_DOCS, REFERENCE_WORDS, REFERENCES = 20, 2_000, 1_000
#: A document with a smaller part of the common words than this is foreign; limit for the shape of foreign documents.
FOREIGN, MAX_SHAPE_DIVERGENCE = 0.25, 0.036
#: Distinct words that a counting task holds before it hands on its counts.
HELD_WORDS = 200_000

#: Character classes of single bytes; bytes of longer characters count once, by their first byte.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other", "wide")
_class = np.full(256, CLASSES.index("other"))
_class[ord("a") : ord("z") + 1], _class[ord("A") : ord("Z") + 1], _class[ord("0") : ord("9") + 1] = 0, 1, 2
_class[list(b" \t\r\x0b\x0c")], _class[10], _class[list(b".,;:!?'\"()-")], _class[list(SYMBOLS)] = 3, 4, 5, 6
_class[0xC0:] = CLASSES.index("wide")
_class[0x80:0xC0] = len(CLASSES)  # later bytes of a character


def classes(data: bytes) -> np.ndarray:
    return np.bincount(_class[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n, mixed, factor = len(words) - window + 1, np.zeros(len(words) - window + 1, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for j in range(window):
        mixed = mixed * factor + codes[j : j + n]
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(mixed, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def shape(counts: np.ndarray) -> np.ndarray:
    """Shares of character classes, lower-case letters and those of other scripts as one."""
    folded = counts[..., :-1].astype(float)
    folded[..., 0] += counts[..., -1]
    return folded / np.maximum(folded.sum(-1, keepdims=True), 1e-12)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of a distribution p from each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return (a + b) / 2


#: Name under which documents are counted.
DOCS = " docs"
COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of character classes and documents under names that no word has, per language."""
    words: dict[str, Counter] = defaultdict(Counter)
    chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
    docs: Counter = Counter()

    def rows():
        for lang, counter in words.items():
            yield frame({"lang": [lang] * len(counter), "word": list(counter), "n": list(counter.values())}, COUNTS)
        words.clear()

    for b in small_batches(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            words[lang or ""].update(data.lower().split())
            chars[lang or ""] += classes(data)
            docs[lang or ""] += 1
        if sum(map(len, words.values())) > HELD_WORDS:
            yield from rows()
    yield from rows()
    for lang, counts in chars.items():
        yield frame({"lang": [lang] * (len(CLASSES) + 1), "word": [*[f" {c}" for c in CLASSES], DOCS], "n": [*counts.tolist(), docs[lang]]}, COUNTS)


class References:
    """Histograms of every language: character classes, and common words with the rest as last entry."""

    def __init__(self, rows: list):
        self.langs = sorted({r.lang for r in rows})
        self.words = {w: i for i, w in enumerate(sorted({r.word.encode() for r in rows if r.word[0] != " "}))}
        self.chars = np.zeros((len(self.langs), len(CLASSES)))
        self.common = np.zeros((len(self.langs), len(self.words) + 1))
        for r in rows:
            k = self.langs.index(r.lang)
            if r.word[0] == " ":
                self.chars[k, CLASSES.index(r.word[1:])] = r.n
            else:
                self.common[k, self.words[r.word.encode()]] = r.share
        self.shapes = shape(self.chars)
        self.chars /= np.maximum(self.chars.sum(1, keepdims=True), 1)
        self.known = self.common.sum(1)
        self.common[:, -1] = 1 - self.common.sum(1)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = COMMON_SHARE) -> References:
    """Counts over all documents; only words above the share, at most 1/share a language, reach the driver."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    counts = cut(arrow_map(rows, count_batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.filter("not startswith(word, ' ')").groupBy("lang").agg(F.sum("n").alias("total"))
    docs_of = counts.filter(F.col("word") == DOCS).select("lang", F.col("n").alias("docs"))
    langs = docs_of.join(totals, "lang").filter((F.col("lang") != "") & (F.col("docs") >= REFERENCE_DOCS) & (F.col("total") >= REFERENCE_WORDS))
    langs = langs.orderBy(F.desc("docs"), "lang").limit(REFERENCES)
    kept = counts.filter(F.col("word") != DOCS).join(F.broadcast(langs.select("lang", "total")), "lang").withColumn("share", F.col("n") / F.col("total"))
    found = kept.filter(F.col("word").startswith(" ") | (F.col("share") >= share)).select("lang", "word", "n", "share").collect()
    return References(found)


JUDGED = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("char_divergence", pa.float64()), ("word_divergence", pa.float64()), ("nearest", pa.string()), ("is_foreign", pa.bool_()), ("shape_divergence", pa.float64())]
)
JUDGED_SQL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_divergence double, word_divergence double, nearest string, is_foreign boolean, shape_divergence double"


def judge(text: str, refs: References) -> tuple:
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    repeats = repeated_words(words)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    by_char = by_word = nearest = by_shape = None
    foreign = False
    if words and refs.langs:
        far = divergence((c := classes(data)) / c.sum(), refs.chars)
        lowered = data.lower().split()
        index = refs.words
        hits = np.bincount([index.get(w, -1) + 1 for w in lowered], minlength=len(index) + 1)
        far_words = divergence(np.append(hits[1:], hits[0]) / len(words), refs.common)
        k = int((np.sqrt(far) + np.sqrt(far_words)).argmin())
        by_char, by_word, nearest = float(far[k]), float(far_words[k]), refs.langs[k]
        by_shape = float(divergence(shape(c), refs.shapes).min())
        met = np.where(refs.common[:, :-1] > 0, hits[1:], 0).sum(1) / len(words)
        foreign = bool((met < FOREIGN * refs.known).all())
    return len(words), word_chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, by_char, by_word, nearest, foreign, by_shape


def judge_batches(batches: Iterator[pa.RecordBatch], refs: References) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        rows = [(key, *judge(text or "", refs)) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield frame(dict(zip(JUDGED.names, map(list, zip(*rows, strict=True)), strict=True)), typed(JUDGED, b))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row a document: its counts, base_failed, kept, and the divergences and distances from its nearest language."""
    refs = references(docs, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    judged = arrow_map(rows, lambda it: judge_batches(it, refs), f"doc_id {id_type(rows)}, {JUDGED_SQL}")
    distance = lambda kind: F.sqrt(F.greatest(F.col(f"{kind}_divergence"), F.lit(0.0))).alias(f"{kind}_distance")
    alike = F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int").alias("_length")
    judged = cut(judged.select("*", distance("char"), distance("word"), alike))
    # at most REFERENCES languages, by about 30 lengths
    own = judged.filter("nearest is not null and not base_failed and not is_foreign")
    found = judged.join(F.broadcast(limits(own)), ["nearest", "_length"], "left").join(F.broadcast(limits(own, False)), ["_length"], "left")
    limit = lambda kind, most: F.coalesce(f"_{kind}", F.greatest(f"_any_{kind}", F.lit(most**0.5)))
    beyond = lambda kind, most: F.coalesce(F.col(f"{kind}_distance") > limit(kind, most), F.lit(False))
    far = (beyond("char", MAX_CHAR_DIVERGENCE) & (F.col("word_chars") >= MIN_CHARS)) | (beyond("word", MAX_WORD_DIVERGENCE) & (F.col("n_words") >= MIN_WORDS))
    far = F.when(F.col("is_foreign"), (F.col("shape_divergence") > MAX_SHAPE_DIVERGENCE) & (F.col("word_chars") >= MIN_CHARS)).otherwise(far)
    kept = (~F.col("base_failed") & ~far).alias("kept")
    return found.select(*[n for n in JUDGED.names[:7]], kept, *JUDGED.names[7:], "char_distance", "word_distance")


def limits(judged: DataFrame, by_language: bool = True) -> DataFrame:
    """nearest, _length, _char, _word: the distances beyond which a document is unlike its kind, where enough are alike; or
    _length, _any_char, _any_word, over all languages. Quartiles come from counts of distances in BINS steps, so a kind of any size is a few rows a task before the shuffle."""
    keys, lead = (["nearest", "_length"], "_") if by_language else (["_length"], "_any_")
    step = lambda kind: F.struct(F.lit(kind).alias("kind"), F.ceil(F.col(f"{kind}_distance") * BINS).alias("bin"))
    counts = judged.select(*keys, F.inline(F.array(step("char"), step("word")))).groupBy(*keys, "kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(*keys, "kind")
    summed = counts.withColumns({"upto": F.sum("n").over(one.orderBy("bin")), "all": F.sum("n").over(one)}).filter(F.col("all") >= REFERENCE_DOCS)
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / BINS
    fence = F.greatest(quartile(0.75) + FENCE * (quartile(0.75) - quartile(0.25)), 2 * quartile(0.5))
    by_kind = summed.groupBy(*keys, "kind").agg(fence.alias("fence"))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("fence"))).alias(f"{lead}{kind}")
    return by_kind.groupBy(*keys).agg(pick("char"), pick("word"))
