"""Text analytics: lexicon sentiment, table detection, sentence and topic chunks, HTML to text, sections."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import shipped

CATEGORIES = ("positive", "negative", "uncertainty", "litigious", "constraining", "strong_modal", "weak_modal")
#: A small lexicon of our own; pass a full one for production.
LEXICON = {
    "positive": ["achieve", "benefit", "gain", "growth", "improve", "improved", "profitable", "strength", "strong", "success"],
    "negative": ["adverse", "decline", "deficit", "impairment", "loss", "losses", "restated", "shortfall", "weak", "weakness"],
    "uncertainty": ["approximately", "believe", "contingency", "depends", "estimate", "may", "risk", "uncertain", "uncertainty", "variable"],
    "litigious": ["claim", "court", "defendant", "lawsuit", "litigation", "plaintiff", "settlement", "statute", "sued", "verdict"],
    "constraining": ["bound", "commit", "covenant", "limit", "obligation", "prohibit", "require", "required", "restrict", "restriction"],
    "strong_modal": ["always", "definitely", "highest", "must", "never", "strongly", "undoubtedly", "will"],
    "weak_modal": ["could", "maybe", "might", "perhaps", "possibly", "seldom", "sometimes", "suggest"],
}


def scores(n_words: Column, counts: dict[str, Column]) -> dict[str, Column]:
    """net and tone: differences of the category counts over the number of words."""
    words = F.greatest(n_words, F.lit(1))
    net = counts["positive"] - counts["negative"]
    return {"net_sentiment": F.round(net / words, 6), "tone_score": F.round((net - counts["uncertainty"]) / words, 6)}


def sentiment(df: DataFrame, text: str, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """total_words, a count a category (distinct words of it that occur), net_sentiment, tone_score of every row."""
    tokens = T.lexicon_tokens(F.coalesce(F.col(text), F.lit("")))
    counted = df.withColumn("_t", tokens).withColumn("total_words", F.size("_t").cast("long")).withColumn("_d", F.array_distinct("_t"))
    counted = counted.withColumns({c: F.size(F.array_intersect("_d", T.array_of(lexicon.get(c, [""])))).cast("long") for c in CATEGORIES})
    return counted.withColumns(scores(F.col("total_words"), {c: F.col(c) for c in CATEGORIES})).drop("_t", "_d")


def section_sentiment(df: DataFrame, keys: list[str], text: str, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """As sentiment, of each section's texts together: a word counts once a section. Distinct (section, word) pairs are
    counted instead of joining the texts, so a section of any size is only ever held as partial aggregates."""
    tokens = df.select(*keys, F.explode(T.lexicon_tokens(F.coalesce(F.col(text), F.lit("")))).alias("_w"))
    category = F.coalesce(*[F.when(F.col("_w").isin(lexicon[c]), c) for c in CATEGORIES if lexicon.get(c)])
    per_word = tokens.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n"))
    counted = per_word.withColumn("_c", category).groupBy(*keys).agg(F.sum("_n").alias("total_words"), *[F.count_if(F.col("_c") == c).alias(c) for c in CATEGORIES])
    return counted.withColumns(scores(F.col("total_words"), {c: F.col(c) for c in CATEGORIES}))


def is_table(text: Column) -> Column:
    """At least three filled lines, and pipes in 60 % of them, or over a quarter of numeric tokens, or equally aligned gaps."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    piped = F.size(F.filter(lines, lambda x: x.contains("|"))) >= n * 0.6
    tokens = T.all_matches(text, r"[^ \t\n\r\f\x0B]+")
    numeric = F.size(F.filter(tokens, lambda x: x.rlike(r"^[$(]?[0-9][0-9,.]*[%)]?$")))
    gaps = F.transform(lines, lambda x: F.size(T.all_matches(x, r"[ \t]{3,}")))
    aligned = (F.size(F.array_distinct(gaps)) == 1) & (F.element_at(gaps, 1) >= 2)
    return F.coalesce((n >= 3) & (piped | (numeric > F.size(tokens) * 0.25) | aligned), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences and paragraphs, trimmed, blank ones dropped."""
    parts = F.split(text, r"(?<=[.!?])[ \t\n\r\f]+(?=[A-Z0-9])|\n{2,}")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")), lambda x: x != "")


_END = re.compile(r"(?<=[.!?])[ \t\n\r\f]+(?=[A-Z0-9])|\n{2,}")
_TOPIC, _STOPS = re.compile("[a-z]{3,}"), frozenset(T.TOPIC_STOPS)


def topic_chunks(text: str | None, most: int = 1500, least: int = 200, similarity: float = 0.15) -> list[str]:
    """Chunks of consecutive sentences: cut where the next one would exceed the size, or where the topic changes and the
    chunk is large enough; a small tail joins the chunk before. A text up to the size stays whole."""
    parts = [p for p in (x.strip(" \t\n\r\f") for x in _END.split(text or "")) if p]
    if not parts or len(text) <= most:
        return [text] if parts else []
    ends = [0, *accumulate(map(len, parts))]  # characters before each sentence
    topics = [frozenset(_TOPIC.findall(p.lower())) - _STOPS for p in parts]
    turns = [i for i, (a, b) in enumerate(pairwise(topics), 1) if len(a & b) < similarity * len(a | b) or not a & b]
    cuts = [0]
    while cuts[-1] < len(parts):
        at = cuts[-1]
        full = bisect_right(ends, ends[at] + most) - 1
        turn = bisect_left(turns, max(at + 1, bisect_left(ends, ends[at] + least)))
        cuts.append(min(max(at + 1, full), *turns[turn : turn + 1], len(parts)))
    if len(cuts) > 2 and len(" ".join(parts[cuts[-2] :])) < least:
        del cuts[-2]
    return [" ".join(parts[a:b]) for a, b in pairwise(cuts)]


def semantic_chunks(text: Column, most: int = 1500, least: int = 200, similarity: float = 0.15) -> Column:
    """topic_chunks as a column; each boundary depends on the one before, so the texts go through Arrow batches."""

    def chunk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([topic_chunks(t, most, least, similarity) for t in texts], dtype=object)

    return F.pandas_udf(shipped(chunk), "array<string>")(text)


def fixed_chunks(df: DataFrame, keys: list[str], text: str, width: int = 2000) -> DataFrame:
    """keys, chunk_index, chunk_text: slices of a fixed width."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width))
    rows = df.filter(F.length(text) > 0).select(*keys, text, F.posexplode(starts).alias("chunk_index", "_at"))
    return rows.select(*keys, "chunk_index", F.substring(F.col(text), F.col("_at") + 1, F.lit(width)).alias("chunk_text"))


class _Text(HTMLParser):
    SKIPPED = ("script", "style", "head", "ix:header", "ix:hidden")
    BLOCKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "article", "section", "nav", "ul", "ol", "footer")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.depth += 1
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.depth = max(0, self.depth - 1)
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def plain_text(html: str | None) -> str:
    """Visible text, runs of blanks as one, at most one empty line in a row."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = [re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(parser.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_to_text(html: Column) -> Column:
    """Visible text of pages by a parser, in Arrow batches."""

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([plain_text(x) for x in pages], dtype=object)

    return F.pandas_udf(shipped(parse), "string")(html)


def visible_text(html: Column) -> Column:
    """The same in built-in expressions, for pages whose scripts and styles are well formed: comments, scripts, styles and heads go, tags become spaces."""
    gone = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(gone, r"<[^>]*>", " "), r"[ \t\n\r\f]+", " "))


#: Section label to type for annual reports, and for foreign ones.
SECTION_TYPES = {"item_1": "business", "item_1a": "risk_factors", "item_3": "legal", "item_7": "mda", "item_7a": "market_risk", "item_8": "financial_statements"}
FOREIGN_SECTION_TYPES = {"item_3": "risk_factors", "item_4": "business", "item_5": "mda", "item_7": "shareholders", "item_18": "financial_statements"}


def section_type(label: Column, form: Column) -> Column:
    """By form: the same label means different things in domestic and foreign reports; each map falls back to the other."""
    pick = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[label]
    home, foreign = pick(SECTION_TYPES), pick(FOREIGN_SECTION_TYPES)
    return F.coalesce(F.when(F.upper(form).contains("20-F"), F.coalesce(foreign, home)).otherwise(F.coalesce(home, foreign)), F.lit("narrative"))


def longest_section(text: Column, header: str, following: str, least: int = 200) -> Column:
    """The longest stretch from a header to the next one, null if none is longer than the least length."""
    found = T.all_matches(text, f"(?is){header}.*?(?={following}|$)")
    best = F.element_at(F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), 1)["x"]
    return F.when(F.length(best) > least, best)


def longest_narrative(chunks: DataFrame, text: str, key: str, most: int, kind: str = "content_type") -> DataFrame:
    """The longest chunks that are no tables, of equal ones by key; the cap bounds what is read closely of a filing."""
    told = chunks.filter((F.coalesce(kind, F.lit("narrative")) != "table") & F.col(text).isNotNull())
    return told.orderBy(F.desc(F.length(text)), key).limit(most)


def normal_section(label: Column) -> Column:
    """'Item 7' and 'item_7' alike."""
    return F.lower(F.replace(label, F.lit(" "), F.lit("_")))
