"""From filing pages to chunk rows: sections by headers, tables apart from prose, topic chunks, vectors from a pluggable embedder."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import texts
from quillspark.operators.relational import prefix_sums
from quillspark.session import ship, shipped

#: Headers of the sections that are kept, by label.
ANNUAL_HEADERS = {"item_1": r"item\s+1\b(?!\d|a)", "item_1a": r"item\s+1a\b", "item_3": r"item\s+3\b", "item_7": r"item\s+7\b(?!a)", "item_7a": r"item\s+7a\b", "item_8": r"item\s+8\b"}
PROSPECTUS_HEADERS = {
    "prospectus_summary": r"prospectus\s+summary",
    "risk_factors": r"risk\s+factors",
    "use_of_proceeds": r"use\s+of\s+proceeds",
    "capitalization": r"capitalization",
    "dilution": r"dilution",
    "md_and_a": r"management['’]?s\s+discussion\s+and\s+analysis",
    "business": r"business(?:\s+overview)?",
}
#: What a table looks like, in the order in which spans are claimed: piped rows, columns apart by blanks, labels with two figures, lines with amounts.
TABLE_PATTERNS = [
    r"(?:^|\n)\s*\|.+\|(?:\s*\n\s*\|.+\|)+",
    r"(?:^|\n)(?:\S+(?:\s{3,}\S+){2,}\s*\n){2,}",
    r"(?:^|\n)(?:[^\n]{3,60})\s{2,}[\d,.$()%-]+\s{2,}[\d,.$()%-]+(?:\s*\n(?:[^\n]{3,60})\s{2,}[\d,.$()%-]+\s{2,}[\d,.$()%-]+)+",
    r"(?:^|\n)(?:.*\$\s*[\d,]+.*\n){3,}",
]
LEAST_SECTION, LEAST_COVERAGE, LEAST_TABLE = 200, 0.15, 100
_TABLES = [re.compile(p, re.M) for p in TABLE_PATTERNS]


def sections(text: str, headers: dict[str, str], any_header: str | None = None) -> list[tuple[str, str]]:
    """(label, body) of the longest stretch from a header line to the next one. Short stretches are contents lines; without
    sections worth LEAST_COVERAGE of the text the whole text is one, full_text. any_header ends sections too."""
    marks = [(m.start(), label) for label, h in headers.items() for m in re.finditer(rf"(?im)^[ \t]*{h}[^\n]{{0,80}}$", text)]
    if any_header:
        marks += [(m.start(), "") for m in re.finditer(rf"(?im)^[ \t]*{any_header}", text) if m.start() not in {p for p, _ in marks}]
    marks.sort()
    longest: dict[str, str] = {}
    for (start, label), (end, _) in pairwise([*marks, (len(text), "")]):
        body = text[start:end].strip()
        if label and len(body) > max(LEAST_SECTION, len(longest.get(label, ""))):
            longest[label] = body
    if sum(map(len, longest.values())) < LEAST_COVERAGE * len(text) or not longest:
        return [("full_text", text)]
    return [(label, longest[label]) for label in headers if label in longest]


def table_spans(text: str) -> list[tuple[int, int]]:
    """Spans of tables, in order, none overlapping: patterns claim theirs one after the other, and what comes later yields.
    Matches of at most LEAST_TABLE characters, blanks around not counted, claim nothing."""
    taken: list[tuple[int, int]] = []
    for pattern in _TABLES:
        for m in pattern.finditer(text):
            k = bisect_left(taken, m.span())
            free = (k == 0 or taken[k - 1][1] <= m.start()) and (k == len(taken) or m.end() <= taken[k][0])
            if free and len(m[0].strip()) > LEAST_TABLE:
                taken.insert(k, m.span())
    return taken


def segments(text: str) -> list[tuple[str, str]]:
    """(kind, text) in order: tables, and the narrative around them; blank stretches are left out."""
    spans = table_spans(text)
    edges = [0, *(x for span in spans for x in span), len(text)]
    kinds = ["narrative", *["table", "narrative"] * len(spans)]
    return [(kind, body) for kind, (a, b) in zip(kinds, pairwise(edges), strict=True) if (body := text[a:b].strip())]


class TableSpans:
    """Table function: start, end, body of every table of a text, for LATERAL joins."""

    def eval(self, text: str):
        for a, b in table_spans(text or ""):
            yield a, b, text[a:b].strip()


class TextSegments:
    """Table function: place, kind, body of what a text is made of."""

    def eval(self, text: str):
        for i, (kind, body) in enumerate(segments(text or "")):
            yield i, kind, body


def register_table_functions(spark: SparkSession) -> None:
    """table_spans(text) and text_segments(text) for SQL, as in SELECT id, t.* FROM texts, LATERAL table_spans(text) t."""
    ship(spark)
    spark.udtf.register("table_spans", F.udtf(TableSpans, returnType="start int, end int, body string"))
    spark.udtf.register("text_segments", F.udtf(TextSegments, returnType="place int, kind string, body string"))


BLANKS = " \t\n\r\f\x0b"


def titled_sections(filings: DataFrame, keys: list[str], text: str, headers: dict[str, str] = PROSPECTUS_HEADERS, least: int = LEAST_SECTION) -> DataFrame:
    """keys, label, body of titled sections, by built-in functions alone; keys name a filing.

    A header is a line that begins with a title and has at most 80 characters after it. Lines become rows with their place,
    headers are kept, and each one's stretch ends at the next (`lead`). Contents lists repeat the titles, so of a label the
    longest stretch stays, the first of equally long ones. A filing without a stretch of more than `least` characters is one section, full_text.
    Only places go through windows; texts are cut once, at the end."""
    line = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = filings.select(*keys, F.posexplode(line).alias("_n", "_line"))
    label = F.coalesce(*[F.when(F.col("_line").rlike(rf"(?i)^[ \t]*{p}[^\n]{{0,80}}\z"), F.lit(n)) for n, p in headers.items()])
    measured = rows.select(*keys, "_n", (F.length("_line") + 1).cast("long").alias("_size"), label.alias("label"))
    before = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    marks = measured.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).filter(F.col("label").isNotNull())
    ends = marks.withColumn("_end", F.lead("_start").over(Window.partitionBy(*keys).orderBy("_n")))
    listed = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_start", "_end", "label"))).alias("_marks"))
    named = listed.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    joined = filings.join(named, [filings[k].eqNullSafe(named[f"_k_{k}"]) for k in keys], "left")
    body = lambda m: F.btrim(F.substr(F.col(text), (m["_start"] + 1).cast("int"), (F.coalesce(m["_end"], F.length(text).cast("long")) - m["_start"]).cast("int")), F.lit(BLANKS))
    labelled = lambda name: lambda c: c["label"] == name
    cut = F.transform("_marks", lambda m: F.struct(m["label"].alias("label"), body(m).alias("body")))
    per_label = [F.array_max(F.transform(F.filter("_cut", labelled(name)), lambda c, i: F.struct(F.length(c["body"]).alias("size"), (-i).alias("first"), c["label"].alias("label"), c["body"].alias("body")))) for name in headers]
    longest = F.filter(F.array(*per_label), lambda s: s["size"] > least)
    found = joined.withColumn("_cut", cut).withColumn("_found", longest)
    whole = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("first"), F.lit("full_text").alias("label"), F.col(text).alias("body")))
    return found.select(*keys, F.explode(F.when(F.size("_found") > 0, F.col("_found")).otherwise(whole)).alias("_s")).select(*keys, "_s.label", "_s.body")


def chunks_of(text: str, headers: dict[str, str], any_header: str | None = r"item\s+\d") -> Iterator[tuple[str, str, str]]:
    """section, content type, chunk text; tables stay whole, narrative is cut by topic."""
    for label, body in sections(text, headers, any_header):
        for kind, segment in segments(body):
            for chunk in [segment] if kind == "table" else texts.topic_chunks(segment):
                yield label, kind, chunk


CHUNK = "section_id string, content_type string, chunk_index int, total_chunks int, text string"


def chunk_filings(filings: DataFrame, keys: list[str], text: str = "text", form: str | None = None, headers: dict[str, str] = ANNUAL_HEADERS) -> DataFrame:
    """keys, section_id, section_type, content_type, chunk_index, total_chunks (within the section), text."""

    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for filed in batches:
            yield pd.Series([numbered_chunks(x or "", headers) for x in filed], dtype=object)

    rows = filings.withColumn("_c", F.pandas_udf(shipped(split), "array<struct<s:string,k:string,i:int,n:int,t:string>>")(text))
    exploded = rows.select(*keys, F.col(form).alias("form_type") if form else F.lit("10-K").alias("form_type"), F.explode("_c").alias("_c"))
    return exploded.select(
        *keys,
        F.col("_c.s").alias("section_id"),
        texts.section_type(F.col("_c.s"), F.col("form_type")).alias("section_type"),
        F.col("_c.k").alias("content_type"),
        F.col("_c.i").alias("chunk_index"),
        F.col("_c.n").alias("total_chunks"),
        F.col("_c.t").alias("text"),
    )


def numbered_chunks(text: str, headers: dict[str, str]) -> list[dict]:
    """The chunks of a filing with their place in the section and the section's number of chunks."""
    found = list(chunks_of(text, headers))
    total, seen, out = Counter(s for s, _, _ in found), Counter(), []
    for s, k, t in found:
        out.append({"s": s, "k": k, "i": seen[s], "n": total[s], "t": t})
        seen[s] += 1
    return out


def with_vectors(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], prefix: str = "", text: str = "text") -> DataFrame:
    """embedding: vectors of the texts from any function on lists, scaled to unit length; matrices (token vectors) are averaged first."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for some in batches:
            out = []
            for v in embed([prefix + (t or "") for t in some]):
                a = np.asarray(v, np.float32)
                a = a.mean(0) if a.ndim == 2 else a
                out.append((a / max(float(np.linalg.norm(a)), 1e-12)).tolist())
            yield pd.Series(out, dtype=object)

    return chunks.withColumn("embedding", F.pandas_udf(shipped(run), "array<float>")(text))


def described(companies: DataFrame, name: str, description: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """text ("name: description", the name alone without one) and embedding of every company."""
    text = F.when(F.coalesce(F.trim(description), F.lit("")) == "", F.col(name)).otherwise(F.concat(F.col(name), F.lit(": "), F.col(description)))
    return with_vectors(companies.withColumn("text", text), embed, "search_document: ")


def hashed_vectors(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in embedder: signed hashes of words."""

    def embed(some: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in some:
            v = [0.0] * size
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out

    return embed


def retag(chunks: DataFrame, keys: list[str], anchors: DataFrame, width: int = 1000) -> DataFrame:
    """Chunks of full_text with the section in whose stretch they begin. Places are running lengths within a filing.
    anchors: keys, section, start (few rows a filing); a chunk takes the last anchor at or before it. keys and chunk_index
    name a chunk. Only lengths are summed up, in ranges of chunk indices; texts stay out of windows and sorts."""
    size = F.coalesce(F.length("text") + 2, F.lit(0)).cast("long")
    sizes = chunks.select(*keys, "chunk_index", size.alias("_size"))
    placed = prefix_sums(sizes, keys, [F.floor(F.col("chunk_index") / width)], [F.col("chunk_index")], {"_end": F.col("_size")})
    marks = anchors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "section"))).alias("_marks"))
    passed = F.filter("_marks", lambda m: m["start"] <= F.col("_end") - F.col("_size"))
    held = placed.join(marks, keys, "left").select(*keys, "chunk_index", F.try_element_at(passed, F.lit(-1))["section"].alias("_h"))
    fresh = F.when((F.col("section_id") == "full_text") & F.col("_h").isNotNull(), F.col("_h")).otherwise(F.col("section_id"))
    return chunks.join(held, [*keys, "chunk_index"], "left").withColumn("section_id", fresh).select(*chunks.columns)
