"""Chart series: levels and ratios a company and period, gaps in revenue filled from their parts, and Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most points of a chart.
YEARS, QUARTERS = 8, 20


def recovered(revenue: DataFrame, gross_profit: DataFrame, cogs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: revenue, and gross profit plus cost of goods where both are known and revenue isn't."""
    named = lambda df, n: df.select(*keys, F.col("value").alias(n))
    parts = named(gross_profit, "_g").join(named(cogs, "_c"), keys)
    return named(revenue, "value").join(parts, keys, "full_outer").select(*keys, F.coalesce("value", F.col("_g") + F.col("_c")).alias("value"))


def ratio_points(numerator: DataFrame, revenue: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value in percent where both series have the key and revenue isn't zero."""
    named = lambda df, n: df.select(*keys, F.col("value").alias(n))
    both = named(numerator, "_n").join(named(revenue, "_d"), keys).filter("_d <> 0")
    return both.select(*keys, F.round(F.col("_n") / F.col("_d") * 100, 2).alias("value"))


def chart_points(points: DataFrame, keys: list[str], period: str, most: int = YEARS, least: int = 2) -> DataFrame:
    """The latest points of each key that has enough of them, with the first and last period shown; a few dozen a key."""
    each = Window.partitionBy(*keys)
    ranked = points.withColumns({"_r": F.row_number().over(each.orderBy(F.desc(period))), "_all": F.count(F.lit(1)).over(each)}).filter(F.col("_all") >= least).filter(F.col("_r") <= most)
    return ranked.withColumns({"first": F.min(period).over(each), "last": F.max(period).over(each)}).drop("_r", "_all")


def chart_title(ticker: Column, label: Column | str, first: Column, last: Column) -> Column:
    return F.concat(ticker, F.lit(" — "), F.lit(label) if isinstance(label, str) else label, F.lit(" ("), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(")"))


def chart_specs(annual: DataFrame, quarterly: DataFrame, label: str, unit: str, kind: str = "line") -> DataFrame:
    """A chart a ticker with two annual points or more: ticker, type, title, label, unit, annual and quarterly arrays of (period, value).
    annual, quarterly: ticker, period (text), value."""
    listed = F.array_sort(F.collect_list(F.struct("period", F.round("value", 2).alias("value"))))
    years = chart_points(annual, ["ticker"], "period").groupBy("ticker").agg(listed.alias("annual"), F.min("first").alias("first"), F.max("last").alias("last"))
    quarters = chart_points(quarterly, ["ticker"], "period", QUARTERS, 1).groupBy("ticker").agg(listed.alias("quarterly"))
    both = years.join(quarters, "ticker", "left")
    none = F.array().cast("array<struct<period:string,value:double>>")
    return both.select("ticker", F.lit(kind if kind in ("line", "bar") else "line").alias("type"), chart_title(F.col("ticker"), label, F.col("first"), F.col("last")).alias("title"), F.lit(label).alias("label"), F.lit(unit).alias("unit"), "annual", F.coalesce("quarterly", none).alias("quarterly"))


def markdown_row(cells: list[Column]) -> Column:
    """| a | b |, with bars inside cells escaped and nothing shown as a dash."""
    shown = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("—")), r"\|", r"\\|") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def markdown_table(df: DataFrame, keys: list[str], header: list[str], cells: list[Column], order: Column) -> DataFrame:
    """keys, table: one Markdown table a key (tens of rows each), rows in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), markdown_row(cells).alias("l")))), lambda x: x["l"])
    head = "| " + " | ".join(header) + " |\n|" + "---|" * len(header) + "\n"
    return df.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("table"))


def markdown_cells(line: Column) -> Column:
    """Trimmed cells of a table row; an escaped bar belongs to its cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.regexp_replace(c, r"\\\|", "|")))


def is_delimiter(line: Column) -> Column:
    return line.contains("-") & F.forall(markdown_cells(line), lambda c: c.rlike("^:?-+:?$"))


def markdown_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line, cells: the body rows of the Markdown tables of a text. A table is a line with a bar, a delimiter row and
    the lines with bars that follow; short rows are filled up to the header's width, long ones cut."""
    lines = F.split(F.col(text), "\n")
    at = lambda i: F.get(F.col("_l"), i)
    every = F.sequence(F.lit(0), F.size("_l") - 1)
    heads = F.filter(every, lambda i: at(i).contains("|") & ~is_delimiter(at(i)) & F.coalesce(is_delimiter(at(i + 1)), F.lit(False)))
    split = df.withColumn("_l", lines).withColumn("_h", heads).filter(F.size("_h") > 0).withColumn("_o", F.filter(every, lambda i: ~at(i).contains("|")))
    # a table ends at the first line without a bar, or where the next table's body begins; each goes on with its own lines only
    stop = lambda h: F.least(F.coalesce(F.array_min(F.filter("_o", lambda o: o > h)), F.size("_l")), F.coalesce(F.array_min(F.filter("_h", lambda x: x > h)) + 2, F.size("_l")))
    tables = F.transform("_h", lambda h: F.struct(h.alias("head"), F.size(markdown_cells(at(h))).alias("wide"), F.slice("_l", h + 3, F.greatest(stop(h) - h - 2, F.lit(0))).alias("body")))
    one = split.select(*keys, F.explode(tables).alias("_t"))
    rows = one.select(*keys, "_t.head", "_t.wide", F.posexplode("_t.body").alias("_i", "_line")).withColumn("line", F.col("_i") + F.col("head") + 2)
    cells = F.slice(F.concat(markdown_cells(F.col("_line")), F.array_repeat(F.lit(""), F.col("wide"))), F.lit(1), F.col("wide"))
    return rows.select(*keys, "line", cells.alias("cells"))


def precise_number(v: Column) -> Column:
    """Four decimals below 10, two below 1000, else none; thousands apart."""
    return F.when(F.abs(v) < 10, F.format_number(v, 4)).when(F.abs(v) < 1000, F.format_number(v, 2)).otherwise(F.format_number(v, 0))


def compact_cell(v: Column) -> Column:
    """Billions and millions with two decimals, thousands apart, small values with two decimals."""
    a = F.abs(v)
    return F.when(a >= 1e9, F.concat(F.format_number(v / 1e9, 2), F.lit("B"))).when(a >= 1e6, F.concat(F.format_number(v / 1e6, 2), F.lit("M"))).when(a >= 1e3, F.format_number(v, 0)).otherwise(F.format_number(v, 2))


def metric_value(v: Column, unit: Column) -> Column:
    """A table's value by unit: %, USD, else a plain ratio; n/a without one."""
    a = F.abs(v)
    usd = F.when(a >= 1e9, F.concat(F.lit("$"), F.format_string("%.2f", v / 1e9), F.lit("B"))).when(a >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", v / 1e6), F.lit("M"))).otherwise(F.concat(F.lit("$"), F.format_number(v, 0)))
    return F.when(v.isNull(), "n/a").when(unit == "%", F.concat(F.format_string("%.1f", v), F.lit("%"))).when(unit == "USD", usd).otherwise(F.format_string("%.2f", v))
