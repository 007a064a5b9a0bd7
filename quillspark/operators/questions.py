"""What a question asks for: intent, kind, chart, comparison, horizon, concepts. Ordered rules over the text column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import dictionary

#: Signal words of intents and kinds.
COMPARISON = ["compare", "comparison", "versus", " vs ", " vs.", "over the years", "year over year", "year-over-year", "y-o-y", "yoy", "trend", "historically", "history", "last 3 years", "last 5 years", "last two years", "last three years", "how has", "changed over", "change over", "growth over", "quarter over quarter", "quarter-over-quarter", "q-o-q", "qoq", "multi-year", "multiyear"]
#: Words for the latest period.
LATEST = ["latest", "most recent", "current", "most recently", "last quarter", "last fiscal", "this year", "this quarter"]
#: Words of questions for numbers.
NUMERIC = ["gross margin", "gross profit margin", "gross margin growth", "operating margin", "operating income margin", "net margin", "profit margin", "net income margin", "free cash flow", "fcf", "current ratio", "liquidity ratio", "debt to equity", "debt-to-equity", "d/e ratio", "net debt", "net cash position", "r&d", "research and development", "rd intensity", "revenue", "net sales", "total revenue", "net income", "net earnings", "calculate", "compute", "percentage", "ratio", "growth rate", "yoy", "year over year"]
#: Words of questions for text.
QUALITATIVE = [
    "sentiment", "tone", "risk", "management discussion", "md&a", "highlighted by management", "strategy", "outlook", "competitive landscape", "threat", "challenge", "opportunities", "strengths", "weaknesses",
    "how does the company", "why did the company", "mentioned", "stated", "noted", "warned", "cautioned", "material weakness", "going concern", "contingency", "litigation", "regulation", "regulatory", "compliance",
    "acquisition", "merger", "divestiture", "business model", "market position", "competitive advantage", "segment", "break down", "breakdown", "broken down", "by product", "by category", "by geography", "by region",
    "by end market", "by business", "by division", "by line of business", "composition", "split by", "split between", "product mix", "revenue mix", "sources of revenue", "source of revenue", "revenue source", "main sources",
    "where does the revenue", "where did the revenue", "come from", "made up of", "driven by", "data center", "gaming", "policy", "recognition", "structure", "compensation", "plan", "definition", "accounting", "treatment",
    "standard", "guidance", "methodology", "approach", "technique", "method", "process", "capitalization", "amortization", "depreciation", "call", "transcript", "conference",
]
#: Words that rule a chart out.
CHART_VETO = ["policy", "recognition", "structure", "compensation", "plan", "definition", "accounting", "treatment", "standard", "guidance", "methodology", "approach", "technique", "method", "process", "regulation", "rule", "requirement", "disclosure"]
#: Phrases and the chart they ask for, the first that fits.
CHART_METRICS = [("gross margin|gross profit margin", "gross_margin"), ("operating margin", "operating_margin"), ("net margin|profit margin", "net_margin"), ("gross profit", "gross_profit"), ("operating income", "operating_income"), ("r&d|research and development", "rd_expense"), ("net income|earnings|profit", "net_income"), ("revenue|sales|top line", "revenue")]
#: Words for several years.
HISTORY = ["over the years", "over time", "trend", "history", "historical", "each year", "year by year", "year-by-year", "annually", "past few years", "last few years", "over the past", "over the last"]
#: Words of answers that decline.
REFUSALS = ["don't have", "do not have", "insufficient", "no information", "does not contain", "not contain", "cannot answer", "can't answer", "no financial", "no revenue", "no numerical", "would need"]
#: Numbers in words.
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
#: Words and the concepts they ask for.
CONCEPTS = [
    (["gross margin", "gross profit"], ["GrossProfit", "Revenues", "RevenueFromContractWithCustomer", "CostOfGoodsAndServicesSold", "CostOfRevenue"]),
    (["revenue", "sales", "net sales"], ["Revenues", "RevenueFromContractWithCustomer"]),
    (["operating income", "operating margin"], ["OperatingIncomeLoss"]),
    (["net income", "earnings", "net earnings"], ["NetIncomeLoss"]),
    (["r&d", "research and development"], ["ResearchAndDevelopmentExpense"]),
    (["free cash", "fcf"], ["NetCashProvidedByUsedInOperatingActivities", "PaymentsToAcquirePropertyPlantAndEquipment"]),
    (["long[- ]?term debt", "debt"], ["LongTermDebt"]),
    (["assets"], ["Assets"]),
]
#: Concepts where nothing was asked for.
DEFAULT_CONCEPTS = ["Revenues", "NetIncomeLoss", "OperatingIncomeLoss"]


def intent(question: Column) -> Column:
    return F.when(T.holds_any(question, COMPARISON), "comparison").when(T.holds_any(question, LATEST), "latest").otherwise("general")


def candidates_for(question: Column) -> Column:
    """How many sources an intent needs: 8 to compare, 2 for the latest, else 3."""
    i = intent(question)
    return F.when(i == "comparison", 8).when(i == "latest", 2).otherwise(3)


def kind(question: Column) -> Column:
    """numeric or qualitative; a qualitative sign overrides numeric ones."""
    return F.when(T.holds_any(question, NUMERIC) & ~T.holds_any(question, QUALITATIVE), "numeric").otherwise("qualitative")


def chart_metric(question: Column) -> Column:
    """The metric to chart, null for conceptual questions and those without one."""
    words = lambda alternatives: rf"\b(?:{alternatives})\b"
    return F.when(~T.matches_any(question, [words("|".join(CHART_VETO))]), T.first_match(question, [(words(p), m) for p, m in CHART_METRICS]))


def year_horizon(question: Column, most: int = 8) -> Column:
    """Years asked for in digits or words, clamped to 2..most; null if none."""
    q = F.lower(question)
    digits = F.regexp_extract(q, r"([0-9]+)[ \t]*[- \t]?[ \t]*(?:year|yr|fiscal year)", 1).try_cast("int")
    word = F.coalesce(*[F.when(q.rlike(rf"\b{w}\b[ \t-]+(?:year|yr|fiscal)"), F.lit(n)) for w, n in NUMBER_WORDS.items()])
    n = F.coalesce(digits, word)
    return F.when(n.isNotNull(), F.greatest(F.lit(2), F.least(n, F.lit(most))))


def wants_history(question: Column) -> Column:
    return year_horizon(question).isNotNull() | T.holds_any(question, HISTORY)


def asked_concepts(question: Column) -> Column:
    """Concept parts that the question's words call for, in rule order; a default set if there are none."""
    q = F.lower(question)
    parts = [F.when(q.rlike(r"\b(?:" + "|".join(words) + r")\b"), F.array(*[F.lit(c) for c in concepts])).otherwise(F.array().cast("array<string>")) for words, concepts in CONCEPTS]
    found = F.array_distinct(F.concat(*parts))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(c) for c in DEFAULT_CONCEPTS]))


def named_companies(questions: DataFrame, key: str | list[str], text: str, aliases: DataFrame, name: str = "named") -> DataFrame:
    """All questions with the distinct tickers that they name as whole words, in the order of first mention. aliases: alias, value, cased."""
    return dictionary.in_order(questions, key, text, aliases, name)


def aliases_of(spark, names: dict[str, list[str]]) -> DataFrame:
    """Names and symbols of three letters and more as a table of aliases; the name 'on' counts in capitals only."""
    known = {(n, t) for t, ns in names.items() for n in [*ns, *([t.lower()] if len(t) >= 3 else [])]}
    return spark.createDataFrame([("ON" if n == "on" else n, t, n == "on") for n, t in sorted(known)], "alias string, value string, cased boolean")


def comparison_mode(question: Column, named: Column, subject: Column) -> Column:
    """explicit with two companies and more, peer with one and a word for peers, else null."""
    peers = T.holds_any(question, ["competitor", "peers", "industry", "rivals"])
    return F.when(F.size(named) >= 2, "explicit").when(peers & F.coalesce(F.get(named, 0), subject).isNotNull(), "peer")


def period_key(period: Column) -> Column:
    """Sort key of ISO dates and quarter labels (with two-digit quarters); other labels come last."""
    quarter = F.concat(F.regexp_extract(period, r"^([0-9]{4})[^0-9]?[Qq]([0-9]+)", 1), F.lit("-Q"), F.lpad(F.regexp_extract(period, r"^([0-9]{4})[^0-9]?[Qq]([0-9]+)", 2), 2, "0"))
    iso = period.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(iso, F.struct(F.lit(0).alias("o"), period.alias("k"))).when(F.length(quarter) > 4, F.struct(F.lit(0).alias("o"), quarter.alias("k"))).otherwise(F.struct(F.lit(1).alias("o"), period.alias("k")))


#: Well-known companies that the corpus doesn't cover.
UNCOVERED = [
    "tesla", "apple", "amazon", "alphabet", "google", "microsoft", "meta", "facebook", "netflix", "oracle", "salesforce", "adobe", "walmart", "costco", "jpmorgan",
    "goldman sachs", "berkshire", "coca cola", "pepsi", "disney", "boeing", "ford", "general motors", "exxon", "chevron", "pfizer", "moderna", "palantir", "uber",
    "airbnb", "spotify", "openai", "anthropic", "stripe", "blue origin", "rivian", "lucid", "snowflake",
]


def uncovered(questions: DataFrame, key: str | list[str], text: str, aliases: DataFrame, name: str = "company") -> DataFrame:
    """All questions with the uncovered company that they name as a whole word, null if none; the longest name first, then by alphabet.
    aliases: alias, value."""
    return dictionary.longest_value(questions, key, text, aliases, name)


def shows_figure(answer: Column) -> Column:
    """Whether an answer states a figure and isn't a refusal."""
    return answer.rlike(r"[$0-9]") & ~T.holds_any(answer, REFUSALS)


#: The group of each concept.
CONCEPT_GROUP = {
    "Revenues": "revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "SalesRevenueNet": "revenue",
    "SalesRevenueGoodsNet": "revenue",
    "RevenueFromContractWithCustomerIncludingAssessedTax": "revenue",
    "NetIncomeLoss": "profitability",
    "GrossProfit": "profitability",
    "OperatingIncomeLoss": "profitability",
    "EarningsPerShareBasic": "profitability",
    "EarningsPerShareDiluted": "profitability",
    "CostOfGoodsAndServicesSold": "profitability",
    "CostOfRevenue": "profitability",
    "ResearchAndDevelopmentExpense": "profitability",
    "SellingGeneralAndAdministrativeExpense": "profitability",
    "OperatingExpenses": "profitability",
    "InterestExpense": "profitability",
    "IncomeTaxExpenseBenefit": "profitability",
    "Assets": "leverage",
    "Liabilities": "leverage",
    "StockholdersEquity": "leverage",
    "LongTermDebt": "leverage",
    "LongTermDebtCurrent": "leverage",
    "LiabilitiesCurrent": "leverage",
    "AssetsCurrent": "leverage",
    "DebtInstrumentCarryingAmount": "leverage",
    "CashAndCashEquivalentsAtCarryingValue": "liquidity",
    "OperatingCashFlow": "liquidity",
    "NetCashProvidedByUsedInOperatingActivities": "liquidity",
    "NetCashProvidedByUsedInInvestingActivities": "liquidity",
    "NetCashProvidedByUsedInFinancingActivities": "liquidity",
    "PaymentsToAcquirePropertyPlantAndEquipment": "liquidity",
    "FreeCashFlow": "liquidity",
    "CommonStockSharesOutstanding": "valuation",
    "CommonStockSharesIssued": "valuation",
    "TreasuryStockSharesAcquired": "valuation",
    "MarketCapitalization": "valuation",
    "InterestIncomeExpenseNet": "banking",
    "ProvisionForLoanLeaseAndOtherLosses": "banking",
    "InvestmentIncomeNet": "banking",
    "LoansAndLeasesReceivableNetReportedAmount": "banking",
    "Deposits": "banking",
    "TradingAccountAssets": "banking",
}
#: Words of questions, and the group that each leads to.
WORD_GROUP = {
    "revenue": "revenue",
    "sales": "revenue",
    "top line": "revenue",
    "income": "profitability",
    "gross profit": "profitability",
    "gross margin": "profitability",
    "net income": "profitability",
    "profit": "profitability",
    "earnings": "profitability",
    "eps": "profitability",
    "operating income": "profitability",
    "operating margin": "profitability",
    "r&d": "profitability",
    "research": "profitability",
    "expense": "profitability",
    "cost": "profitability",
    "margin": "profitability",
    "debt": "leverage",
    "leverage": "leverage",
    "liability": "leverage",
    "equity": "leverage",
    "balance sheet": "leverage",
    "asset": "leverage",
    "cash": "liquidity",
    "liquidity": "liquidity",
    "free cash": "liquidity",
    "cash flow": "liquidity",
    "capex": "liquidity",
    "capital expenditure": "liquidity",
    "operating cash": "liquidity",
    "share": "valuation",
    "outstanding": "valuation",
    "market cap": "valuation",
    "loan": "banking",
    "deposit": "banking",
    "interest income": "banking",
    "net interest": "banking",
    "provision": "banking",
}


def by_group(table: dict[str, str]) -> dict[str, list[str]]:
    """What belongs to each group, in the table's order."""
    found: dict[str, list[str]] = {}
    for name, group in table.items():
        found.setdefault(group, []).append(name)
    return found


GROUPS = by_group(CONCEPT_GROUP)
#: Groups by relevance to a group.
GROUP_ORDER = {
    "revenue": ["revenue", "profitability", "liquidity", "leverage"],
    "profitability": ["profitability", "revenue", "liquidity", "leverage"],
    "liquidity": ["liquidity", "profitability", "leverage", "revenue"],
    "leverage": ["leverage", "liquidity", "profitability", "revenue"],
    "valuation": ["valuation", "profitability", "revenue", "liquidity"],
    "banking": ["banking", "profitability", "liquidity", "leverage"],
}
#: Named margins and profits, and the concept of each.
PRIORITIES = [("gross margin", "GrossProfit"), ("gross profit", "GrossProfit"), ("operating margin", "OperatingIncomeLoss"), ("operating income", "OperatingIncomeLoss"), ("net margin", "NetIncomeLoss"), ("profit margin", "NetIncomeLoss"), ("net income", "NetIncomeLoss")]
NEWEST = re.compile(r"(?i)\b(?:latest|most recent|current|newest|last reported)\b")


def question_group(question: str) -> str:
    """The group with most matching words; of equally many the one whose longest word comes first in the order of length."""
    q, votes = question.lower(), {}
    words = sorted(WORD_GROUP.items(), key=lambda x: -len(x[0]))
    for w, g in words:
        if re.search(r"\b" + re.escape(w) + r"\b", q):
            votes[g] = votes.get(g, 0) + 1
    return max(votes, key=votes.get) if votes else "profitability"


def fact_period(period_end: Column, fiscal_year: Column, fiscal_period: Column, filed: Column) -> Column:
    """The period's date, else FY and the year (with the quarter), else the filing date, else empty."""
    shown = F.nullif(F.trim(F.regexp_replace(period_end, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ].*$", "$1")), F.lit(""))
    part = F.when(F.upper(fiscal_period) == "FY", "").otherwise(F.coalesce(fiscal_period, F.lit("")))
    return F.coalesce(shown, F.trim(F.concat(F.lit("FY"), fiscal_year.cast("string"), F.lit(" "), part)), F.nullif(F.trim(filed), F.lit("")), F.lit(""))


def fact_year(fiscal_year: Column, period: Column) -> Column:
    year = lambda c: F.regexp_extract(c.cast("string"), r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    return F.coalesce(year(fiscal_year), year(period))


def relevant_facts(facts: DataFrame, question: str, n: int = 3) -> DataFrame:
    """The n facts that explain a question best. facts: concept, value, year, id.

    A question for the latest keeps the newest year. A named margin or profit keeps its own components, each in its latest
    year; else facts rank by how near their group is, those without a value far behind, larger values first."""
    if NEWEST.search(question):
        newest = facts.agg(F.max("year").alias("_y"))
        facts = facts.crossJoin(F.broadcast(newest)).filter(F.col("_y").isNull() | (F.col("year") == F.col("_y"))).drop("_y")
    named = next((c for p, c in PRIORITIES if p in question.lower()), None)
    wanted = [*GROUPS["revenue"], named] if named else None
    empty = F.when(F.col("value").isNull(), 50).otherwise(0)
    if wanted:
        rank = F.array_position(F.array(*[F.lit(c) for c in wanted]), F.col("concept")) + empty
        facts = facts.filter(F.col("concept").isin(wanted))
        best = facts.groupBy("concept").agg(F.max_by("id", F.struct(F.coalesce("year", F.lit(-1)), F.abs(F.coalesce("value", F.lit(0.0))), -F.col("id"))).alias("id"))
        facts = facts.join(best, ["concept", "id"], "left_semi")
    else:
        order = GROUP_ORDER[question_group(question)]
        place = {c: order.index(g) if g in order else 99 for g, cs in GROUPS.items() for c in cs}
        rank = F.coalesce(F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("concept")], F.lit(99)) + empty
    return facts.withColumn("_rank", rank).orderBy("_rank", F.desc(F.abs(F.coalesce("value", F.lit(0.0)))), "id").limit(n).drop("_rank")


def fact_links(cik: Column, taxonomy: Column, concept: Column, unit: Column, frame: Column) -> tuple[Column, Column]:
    """Addresses of the concept's and the frame's raw data, empty where a part is missing."""
    e = T.percent_encoded
    one = F.concat(F.lit("https://data.sec.gov/api/xbrl/companyconcept/CIK"), T.padded_cik(cik), F.lit("/"), e(taxonomy), F.lit("/"), e(concept), F.lit(".json"))
    many = F.concat(F.lit("https://data.sec.gov/api/xbrl/frames/"), e(taxonomy), F.lit("/"), e(concept), F.lit("/"), e(unit), F.lit("/"), e(frame), F.lit(".json"))
    return F.coalesce(one, F.lit("")), F.coalesce(many, F.lit(""))
