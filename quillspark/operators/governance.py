"""Product and review analytics: conjoint counts, route shares, evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

c = F.col


def route_shares(decisions: DataFrame, route: str = "route") -> DataFrame:
    """route (upper case), n, share of all."""
    counted = decisions.groupBy(F.upper(route).alias("route")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy()))


def conjoint_counts(responses: DataFrame, attributes: list[str]) -> DataFrame:
    """attribute, level, appearances, wins, utility from choices between two profiles.
    responses: profile_a, profile_b (JSON), chosen ('A' or 'B'; others are left out)."""
    shape = ", ".join(f"{a} string" for a in attributes)
    chosen = responses.filter(c("chosen").isin("A", "B"))
    shown = chosen.select(F.explode(F.array(F.struct(F.from_json("profile_a", shape).alias("p"), (c("chosen") == "A").alias("won")), F.struct(F.from_json("profile_b", shape).alias("p"), (c("chosen") == "B").alias("won")))).alias("s"))
    levels = shown.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), c(f"s.p.{a}").alias("level"), c("s.won").alias("won")) for a in attributes])).alias("l")).select("l.*")
    counted = levels.filter(c("level").isNotNull()).groupBy("attribute", "level").agg(F.count(F.lit(1)).alias("appearances"), F.count_if(c("won")).alias("wins"))
    return counted.withColumn("utility", c("wins") / c("appearances"))


def importance(counts: DataFrame) -> DataFrame:
    """attribute, importance: the range of its utilities in percent of all ranges."""
    spread = counts.groupBy("attribute").agg((F.max("utility") - F.min("utility")).alias("_r"))
    return spread.select("attribute", F.coalesce(F.round(F.try_divide(c("_r"), F.sum("_r").over(Window.partitionBy())) * 100, 2), F.lit(0.0)).alias("importance"))


def preferred(counts: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """attribute, level with the largest utility; ties go to the level that is listed first."""
    order = F.create_map(*[x for a, names in levels.items() for i, n in enumerate(names) for x in (F.lit(f"{a}::{n}"), F.lit(i))])
    ranked = counts.withColumn("_o", order[F.concat_ws("::", "attribute", "level")])
    return ranked.groupBy("attribute").agg(F.max_by("level", F.struct("utility", -c("_o"))).alias("level"))


def valid_profile(profile: Column, levels: dict[str, list[str]]) -> Column:
    """Exactly the known attributes, each with a known level."""
    as_map = F.from_json(profile, "map<string,string>")
    keys = F.sort_array(F.map_keys(as_map)) == F.array(*[F.lit(a) for a in sorted(levels)])
    ok = keys
    for a, names in levels.items():
        ok = ok & F.coalesce(as_map[a].isin(names), F.lit(False))
    return F.coalesce(ok, F.lit(False))


#: Phrases of an answer that declines.
ABSTENTIONS = ["not disclosed", "can't verify", "cannot verify", "unable to", "insufficient", "not available", "abstain", "no data", "not reported", "don't have", "do not have", "not found", "no information", "not in the filing", "not mentioned"]
KEYWORD_STOPS = ["was", "is", "the", "a", "an", "for", "in", "of", "and", "or", "usd", "billion", "million", "its", "that", "at", "had"]


def declines(answer: Column) -> Column:
    return T.holds_any(answer, ABSTENTIONS)


def asks_abstention(expected: Column) -> Column:
    return F.lower(F.trim(expected)).startswith("abstain")


def correctness(expected: Column, answer: Column) -> Column:
    """1 or 0 for abstentions, percentages within 0.5 points and numbers within 2 %; else the share of key words, else 0.5."""
    plain = lambda x: T.scaled_number(F.regexp_replace(x, "%", ""))
    e, a = T.scaled_number(expected), T.scaled_number(answer)
    ep, ap = plain(expected), plain(answer)
    words = F.filter(T.all_matches(F.lower(expected), "[a-z0-9_]+"), lambda w: (F.length(w) > 3) & ~w.isin(KEYWORD_STOPS))
    share = F.when(F.size(words) > 0, F.round(F.size(F.filter(words, lambda w: F.lower(answer).contains(w))) / F.size(words), 2)).otherwise(0.5)
    return (
        F.when(asks_abstention(expected), declines(answer).cast("double"))
        .when(expected.contains("%") & ep.isNotNull() & ap.isNotNull(), (F.abs(ep - ap) <= 0.5).cast("double"))
        .when(e.isNotNull() & a.isNotNull() & (e != 0), (F.abs(e - a) / F.abs(e) <= 0.02).cast("double"))
        .otherwise(share)
    )


def judge_score(said: Column, key: str = "score") -> Column:
    """A judge's score: the key of a JSON answer, else the key anywhere in the text, else the first bare 0, 1 or fraction; null without any."""
    pick = lambda pattern: F.regexp_extract(said, pattern, 1).try_cast("double")
    return F.coalesce(F.get_json_object(said, f"$.{key}").try_cast("double"), pick(rf'"{key}"\s*:\s*([0-9.]+)'), pick(r"\b(0\.[0-9]+|1\.0|0|1)\b"))


#: Words of an answer that declines, and the least length of one.
GATE_ABSTAINS, GATE_LENGTH = ["I cannot answer", "I don't have enough"], 20


def gate(answer: Column, n_sources: Column) -> Column:
    """pass, or why an answer fails: too short, abstention, no sources."""
    short = F.length(F.coalesce(answer, F.lit(""))) < GATE_LENGTH
    return F.when(short, "too short").when(T.holds_any(answer, GATE_ABSTAINS), "abstention").when(F.coalesce(n_sources, F.lit(0)) == 0, "no sources").otherwise("pass")


def xbrl_axis(concept: Column, status: Column) -> Column:
    """1 without a concept or when verified, 0 on a mismatch, else 0.5."""
    return F.when(F.coalesce(concept, F.lit("")).isin("", "N/A") | status.isin("PASS", "verified"), 1.0).when(status.isin("FAIL", "mismatch"), 0.0).otherwise(0.5)


def abstention_axis(expected: Column, answer: Column) -> Column:
    return F.when(asks_abstention(expected), declines(answer).cast("double")).otherwise(1.0)


def evaluate(rows: DataFrame) -> DataFrame:
    """Scores of rows with expected, answer, concept, status, n_sources: four axes and their mean (overall).
    The abstention axis counts only where no abstention was asked for."""
    scored = rows.withColumns(
        {
            "correctness": correctness(c("expected"), c("answer")),
            "xbrl": xbrl_axis(c("concept"), c("status")),
            "sources": (c("n_sources") > 0).cast("double"),
            "abstention": abstention_axis(c("expected"), c("answer")),
        }
    )
    three = c("correctness") + c("xbrl") + c("sources")
    return scored.withColumn("overall", F.round(F.when(asks_abstention(c("expected")), three / 3).otherwise((three + c("abstention")) / 4), 3))


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, the mean of every axis and the share that passes (0.75 and more)."""
    axes = ["correctness", "xbrl", "sources", "abstention", "overall"]
    return scored.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(a), 4).alias(f"mean_{a}") for a in axes], F.round(F.avg((c("overall") >= 0.75).cast("double")), 4).alias("pass_rate"))


def choice_tasks(n: int, levels: dict[str, list[str]], seed: int, spark) -> DataFrame:
    """task_index, profile_a, profile_b: pairs of random profiles that differ, the same for the same seed.
    The second profile is drawn among those other than the first."""
    total = 1
    for names in levels.values():
        total *= len(names)
    pick = lambda number: F.to_json(F.struct(*_digits(number, levels)))
    first = F.pmod(F.xxhash64(F.lit(seed), "task_index", F.lit("a")), F.lit(total))
    other = F.pmod(first + 1 + F.pmod(F.xxhash64(F.lit(seed), "task_index", F.lit("b")), F.lit(total - 1)), F.lit(total))
    return spark.range(n).withColumnRenamed("id", "task_index").select("task_index", pick(first).alias("profile_a"), pick(other).alias("profile_b"))


def _digits(number: Column, levels: dict[str, list[str]]) -> list[Column]:
    out = []
    for name, names in levels.items():
        out.append(F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(number, F.lit(len(names))) + 1).cast("int")).alias(name))
        number = F.floor(number / len(names))
    return out


def call_health(calls: DataFrame, last: int = 50) -> DataFrame:
    """n, success_rate and the number of errors among the last calls. calls: ts, id, ok."""
    recent = calls.orderBy(F.desc("ts"), F.desc("id")).limit(last)
    return recent.agg(F.count(F.lit(1)).alias("n"), F.avg(c("ok").cast("double")).alias("success_rate"), F.count_if(~c("ok")).alias("errors"))
