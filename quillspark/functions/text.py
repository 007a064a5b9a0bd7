"""Text columns: tokens, numbers, stems, keys. Patterns stay within what Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword extraction leaves out (retrieval), and those that topic comparison leaves out (chunking).
KEYWORD_STOPS = (
    "the and for that this with from are was were been have has had will would could should may might can shall not but what "
    "which who when where how than then also about after before between during into through each every both few more most other "
    "some such only own same very just because does"
).split()
TOPIC_STOPS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on "
    "with at by from as into through during before after above below between and but or nor not so yet both either neither each "
    "every all any few more most other some such no only own same than too very just because if when where how what which who "
    "whom this that these those i me my we our you your he him his she her it its they them their"
).split()

SPACE = r"[ \t\n\r\f\x0B]"


def array_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def space_tokens(c: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(c), SPACE + "+"), lambda x: x != "")


def lexicon_tokens(c: Column) -> Column:
    """Lower-case words of letters; hyphens and apostrophes inside stay, numbers go."""
    return F.transform(all_matches(c, r"(?i)[a-z][a-z\-']*[a-z]|[a-z]"), F.lower)


def keywords(c: Column) -> Column:
    """Distinct words of four letters and more that say something."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-z]{4,}$"))
    return F.array_except(F.array_distinct(words), array_of(KEYWORD_STOPS))


def topic_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(all_matches(F.lower(c), "[a-z]{3,}")), array_of(TOPIC_STOPS))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets, 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, whatever the case."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.coalesce(c.rlike("(?i)" + p), F.lit(False))
    return found


def first_match(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern is found; null if none is."""
    return F.coalesce(*[F.when(c.rlike("(?i)" + p), F.lit(v)) for p, v in rules])


def holds_any(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds any phrase."""
    low, found = F.lower(c), F.lit(False)
    for p in phrases:
        found = found | F.coalesce(low.contains(p.lower()), F.lit(False))
    return found


def scaled_number(c: Column) -> Column:
    """The first number with a scale word, times that scale; else the first number; else null. Scale words in any case."""
    scaled = r"(?i)\$?([0-9,]+(?:\.[0-9]+)?)" + SPACE + r"*(trillion|t|billion|b|million|m|thousand|k)\b"
    word = F.lower(F.regexp_extract(c, scaled, 2))
    factor = F.when(word.isin("trillion", "t"), 1e12).when(word.isin("billion", "b"), 1e9).when(word.isin("million", "m"), 1e6).when(word.isin("thousand", "k"), 1e3)
    number = lambda p: F.regexp_replace(F.regexp_extract(c, p, 1), ",", "").try_cast("double")
    return F.coalesce(number(scaled) * factor, number(r"\$?([0-9,]*[0-9][0-9,]*(?:\.[0-9]+)?)"))


def figures(c: Column) -> Column:
    """Distinct figures of a text without dollar signs, separators and percent signs."""
    raw = all_matches(c, r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?")
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.regexp_replace(x, "[$,%]", "")), lambda x: x != ""))


def accession_url(accession: Column) -> Column:
    """The filing's index page, empty if the number is too short."""
    clean = F.regexp_replace(F.coalesce(accession, F.lit("")), "-", "")
    dashed = F.concat_ws("-", F.substring(clean, 1, 10), F.substring(clean, 11, 2), F.substring(clean, 13, 100))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.ltrim(F.substring(clean, 1, 10), F.lit("0")), F.lit("/"), clean, F.lit("/"), dashed, F.lit("-index.htm"))
    return F.when(F.length(clean) >= 18, url).otherwise("")


def padded_cik(c: Column) -> Column:
    return F.lpad(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 10, "0")


def chunk_id(ticker: Column, accession: Column, index: Column) -> Column:
    """ticker:accession:index, '-' for a missing index."""
    return F.concat_ws(":", ticker, accession, F.coalesce(index.cast("string"), F.lit("-")))


def upper_snake(c: Column) -> Column:
    """Predicate names; RELATED_TO if nothing is left."""
    name = F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("RELATED_TO"))


def compact_money(v: Column) -> Column:
    """1.234B, 5.6M or a plain rounded number."""
    return F.when(F.abs(v) >= 1e9, F.format_string("%.3fB", v / 1e9)).when(F.abs(v) >= 1e6, F.format_string("%.1fM", v / 1e6)).otherwise(F.format_number(v, 0))


def spaced_words(c: Column) -> Column:
    """PascalCase to words."""
    return F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", " ")


def clean_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-z]*\n", ""), r"\n```$", ""))


def string_list(c: Column) -> Column:
    """A JSON list of strings; an empty list for what can't be read."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def percent_encoded(c: Column) -> Column:
    return F.regexp_replace(F.url_encode(c), r"\+", "%20")
