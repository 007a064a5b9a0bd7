"""Guardrail predicates on messages and answers: ordered rules as data, evaluated as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Patterns of attempts to override instructions, with the reason given; the first that is found counts.
INJECTION = [
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)", "Attempted system prompt override"),
    (r"disregard\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)", "Attempted system prompt override"),
    (r"forget\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)", "Attempted system prompt override"),
    (r"you\s+are\s+now\s+(a|an)\s+", "Attempted role hijacking"),
    (r"new\s+instructions?\s*:", "Attempted instruction injection"),
    (r"system\s*:\s*", "Attempted system message injection"),
    (r"\[system\]", "Attempted system message injection"),
    (r"<\s*system\s*>", "Attempted system message injection"),
    (r"do\s+anything\s+now", "DAN-style jailbreak attempt"),
    (r"jailbreak", "Jailbreak attempt (explicit mention)"),
    (r"bypass\s+(all\s+)?(safety|content|security)\s+(filters?|restrictions?|rules?)", "Safety bypass attempt"),
    (r"(reveal|show|print|output|repeat)\s+(your|the)\s+(system|initial|original)\s+(prompt|instructions?)", "Prompt leaking attempt"),
    (r"what\s+(are|is)\s+your\s+(system|initial|original)\s+(prompt|instructions?)", "Prompt leaking attempt"),
    (r"repeat\s+(everything|all)\s+(above|before)", "Prompt leaking attempt"),
    (r"(base64|rot13|hex)\s+(encode|decode)", "Encoding-based evasion attempt"),
]
#: Words of attempts.
JAILBREAK_WORDS = ["DAN", "jailbreak", "prompt injection", "ignore previous", "ignore instructions", "you are now", "act as if"]

#: Patterns of questions for advice.
ADVICE = [
    r"\bshould i (buy|sell|hold|invest|short|trade|purchase|dump|own|add)\b",
    r"\b(do|would|can|should) (you|u) recommend\b",
    r"\bis (it|now|this|that|the stock)\b.{0,40}\b(a good|a bad)\b.{0,15}\b(buy|investment|time to (buy|sell|invest))\b",
    r"\b(good|bad|great|smart|safe|risky) (investment|buy|stock to (buy|own|pick))\b",
    r"\bworth (buying|investing|owning|the investment)\b",
    r"\bprice target\b",
    r"\bwhat should i do with my (money|portfolio|shares|investment|stocks|savings)\b",
    r"\b(what|which|any) (stock|stocks|shares|companies)\b.{0,20}\b(should i |to )?(buy|invest in|pick)\b",
    r"\b(buy or sell|sell or buy)\b",
    r"\bshould i put my (money|cash|savings)\b",
    r"\bwill (the |this )?(stock|price|share price|it)\b.{0,30}\b(go up|go down|rise|fall|drop|crash|tank|moon|double|skyrocket|rebound|recover)\b",
    r"\b(is it|good time) (a good time )?to (buy|sell|invest)\b",
]
#: Words that make a question financial.
FINANCIAL = [
    "revenue", "income", "profit", "loss", "earnings", "margin", "cost", "expense", "cash flow", "operating", "net income", "gross profit", "ebitda",
    "free cash flow", "fcf", "capex", "capital expenditure", "depreciation", "amortization", "sga", "r&d", "research and development", "dividend",
    "buyback", "share repurchase", "eps", "earnings per share", "assets", "liabilities", "equity", "debt", "cash", "inventory", "receivable",
    "payable", "goodwill", "intangible", "current ratio", "debt to equity", "leverage", "liquidity", "solvency", "10-k", "10-q", "8-k", "sec filing",
    "edgar", "xbrl", "gaap", "non-gaap", "restatement", "amendment", "annual report", "quarterly report", "form type", "accession", "cik", "stock",
    "share", "ticker", "market cap", "valuation", "p/e", "price to earnings", "portfolio", "sector", "industry", "competitor", "market share",
    "revenue growth", "profit margin", "operating margin", "net margin", "return on equity", "roe", "return on assets", "roa", "quick ratio",
    "working capital", "fiscal year", "fiscal quarter", "segment", "subsidiary", "acquisition", "merger", "spinoff", "ipo", "offering", "gpu",
    "data center", "gaming", "ai chip", "semiconductor", "wafer", "fab", "foundry", "chip", "asic", "fpga", "dram", "nand", "memory",
    "microcontroller", "analog", "test equipment", "packaging", "substrate", "euv lithography", "risk", "risks", "risk factor",
    "management discussion", "md&a", "material weakness", "going concern", "contingency", "litigation",
]
#: Patterns of other topics.
OFF_TOPIC = [
    r"\b(recipe|cook|bake|ingredient)\b",
    r"\b(weather|temperature|forecast|rain|snow)\b",
    r"\b(sports|football|basketball|soccer|baseball|game score)\b",
    r"\b(movie|tv show|netflix|youtube|music|song|album)\b",
    r"\b(politics|election|president|senator|congress|democrat|republican)\b",
    r"\b(joke|riddle|poem|story|tale|novel)\b",
    r"\b(homework|exam|quiz|assignment|essay)\b",
    r"\b(travel|hotel|flight|vacation|restaurant|food)\b",
    r"\b(dating|relationship|love|romance|marriage)\b",
    r"\b(medical|doctor|symptom|disease|medication|health advice)\b",
]
#: Personal data, in the order in which it is masked: name, pattern, replacement. A bare nine-digit number counts as SSN,
#: and cards of 15 digits are missed: the patterns are kept as they are, as masked texts must agree.
PERSONAL = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "***-**-****"),
    ("SSN (raw)", r"\b\d{9}\b", "***-**-****"),
    ("Credit card", r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))\d{12,15}\b", "****-****-****-****"),
    ("Email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL REDACTED]"),
    ("Phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE REDACTED]"),
    ("API key", r"\b(?:sk-[a-zA-Z0-9]{20,}|api[_-]?key[_-]?[a-zA-Z0-9]{20,})\b", "[API KEY REDACTED]"),
]
#: Phrases that no answer should hold; callers add sentences of their own prompts.
LEAKS = ["system prompt", "system instructions", "your instructions are"]

#: Words of questions over several years.
TREND = ["trend", "cagr", "year over year", "year-over-year", "yoy", "growth rate", "over the past", "over the last", "since 20", "compared to last year", "5-year", "five-year", "3-year", "three-year", "annual change", "historical", "trajectory", "each year", "every year", "from 20"]
#: Words of comparisons.
COMPARISON = [" vs ", " vs.", "versus", "compare", "comparison", "peers", "competitors", "relative to", "compared against", "industry average"]
#: Words of risk.
RISK = ["risk factor", "compliance", "regulat", "litigation", "lawsuit", "investigation", "material weakness", "internal control", "controls and procedures", "going concern", "covenant", "restatement", "non-reliance", "impairment", "contingenc", "sanction", "penalt", "default", "fraud", "related party", "disclosure control", "sec inquiry", "subpoena"]

#: Words that cite a filing.
CITES = ["section", "item ", "10-k", "10k", "10-q", "10q", "8-k", "md&a", "form ", "filing", "edgar", "accession", "annual report", "quarterly report", "according to", "per the", "as disclosed", "as stated in"]
#: Words that tell of a check.
VERIFIES = ["verif", "corroborat", "cross-check", "cross check", "audited", "reconcil", "confirmed against", "checked against"]
#: Words of caution.
CAVEATS = ["caveat", "unverified", "not verified", "not independently verified", "unconfirmed", "not corroborated", "could not verify", "cannot confirm", "should be confirmed", "treat with caution", "approximate", "approximately", "not available", "no figure", "uncertain", "may not", "could not be confirmed"]
#: Pattern of a figure.
FIGURE = r"\$\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?%|\d[\d,]*(?:\.\d+)?\s?(?:thousand|million|billion|trillion|bn|mn)\b|\d{1,3}(?:,\d{3})+(?:\.\d+)?|(?:\d+\.\d+[kmbt]|\d{3,}[kmbt])(?:\b|[\s,;:!?)]|$)"


def injection_reason(message: Column, longest: int = 4000) -> Column:
    """Why a message is blocked: too long, a pattern, a word; null if it isn't."""
    word = F.coalesce(*[F.when(F.lower(message).contains(w.lower()), F.lit(f"Jailbreak keyword detected: {w}")) for w in JAILBREAK_WORDS])
    return F.coalesce(F.when(F.length(message) > longest, "Input too long"), T.first_match(message, INJECTION), word)


def needs_deep_check(message: Column) -> Column:
    """Long or many-lined messages, which a model looks at too."""
    return (F.length(message) > 200) | (F.size(F.split(message, "\n")) > 2)


def dialog_topic(message: Column) -> Column:
    """investment_advice, then financial, then off_topic, else general."""
    financial = F.lower(message).rlike(r"\b(?:" + "|".join(FINANCIAL) + r")\b")
    return F.when(F.coalesce(F.trim(message), F.lit("")) == "", "general").when(T.matches_any(message, ADVICE), "investment_advice").when(financial, "financial").when(T.matches_any(message, OFF_TOPIC), "off_topic").otherwise("general")


def masked(answer: Column) -> Column:
    for _, pattern, mark in PERSONAL:
        answer = F.regexp_replace(answer, pattern, mark.replace("$", r"\$"))
    return answer


def personal_kinds(answer: Column) -> Column:
    """Names of the kinds found, each on the text that the ones before have masked."""
    found, text = [], answer
    for name, pattern, mark in PERSONAL:
        found.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, mark)
    return F.array_compact(F.array(*found))


def leaks(answer: Column, phrases: list[str] = LEAKS) -> Column:
    """Whether an answer holds prompt text. phrases: in lower case."""
    return T.holds_any(answer, phrases)


def entities(text: Column) -> Column:
    """Distinct figures and capitalised names."""
    return F.array_distinct(F.concat(T.all_matches(text, r"\$?[0-9][0-9,.]+%?"), T.all_matches(text, r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b")))


def ungrounded(answer: Column, context: Column) -> Column:
    """Share of the answer's entities that the context lacks, 0 without any."""
    a, k = entities(answer), entities(context)
    return F.when((F.size(a) > 0) & (context != ""), 1 - F.size(F.array_intersect(a, k)) / F.size(a)).otherwise(0.0)


def unsafe(answer: Column, context: Column, most: float = 0.7, phrases: list[str] = LEAKS) -> Column:
    """Prompt text, or mostly ungrounded with figures that the context lacks."""
    figures = lambda t: F.array_distinct(T.all_matches(t, r"\$?[0-9][0-9,.]+%?"))
    loose = (ungrounded(answer, context) > most) & (F.size(F.array_except(figures(answer), figures(context))) > 0)
    return leaks(answer, phrases) | loose


def consensus_reason(question: Column, route: Column) -> Column:
    """Why a second opinion is asked for; null if it isn't."""
    years = F.array_distinct(T.all_matches(question, r"\b(?:19|20)[0-9]{2}\b"))
    return F.coalesce(
        F.when(F.upper(route).isin("SAMPLED_REVIEW", "ESCALATE"), "route"),
        F.when((F.size(years) >= 2) | T.holds_any(question, TREND), "multi-year"),
        F.when(T.holds_any(question, COMPARISON), "comparison"),
        F.when(T.holds_any(question, RISK), "risk"),
    )


def divergence(primary: Column, secondary: Column) -> Column:
    """Share of the first answer's figures that the second lacks."""
    p = T.figures(primary)
    return F.when(F.size(p) > 0, F.size(F.array_except(p, T.figures(secondary))) / F.size(p)).otherwise(0.0)


def missed_needs(role: Column, answer: Column, status: Column) -> Column:
    """What an answer lacks for a role; an empty list for roles without needs."""
    cites = T.holds_any(answer, CITES) | F.lower(answer).rlike(r"\b(item|part)\s+[0-9ivx]+")
    verified = F.upper(F.trim(status)).isin("PASS", "VERIFIED")
    figure = answer.rlike("(?i)" + FIGURE)
    rules = [
        ("compliance_officer", "cite source filing / section", F.lit(True), cites),
        ("compliance_officer", "surface verification status", F.lit(True), T.holds_any(answer, VERIFIES) | verified),
        ("equity_research_analyst", "cite the filing section", F.lit(True), cites),
        ("credit_analyst", "source / verification for figures", figure, cites | T.holds_any(answer, VERIFIES) | verified),
        ("credit_analyst", "caveat any unverified number", figure, verified | T.holds_any(answer, CAVEATS)),
    ]
    return F.array_compact(F.array(*[F.when((role == r) & applies & ~F.coalesce(met, F.lit(False)), F.lit(name)) for r, name, applies, met in rules]))


def rate_limit_bound(requests: DataFrame, key: str, ts: str, seconds: int = 60, most: int = 60) -> DataFrame:
    """Requests with the number of the key's requests in the window that ends with them, themselves included, and whether
    that exceeds the limit. An upper bound: refused requests count too; the exact replay is the streaming limiter."""
    at = F.col(ts).cast("timestamp").cast("long")
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-(seconds - 1), 0)
    return requests.withColumn("_at", at).withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("over", F.col("in_window") > most).drop("_at")
