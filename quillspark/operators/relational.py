"""Relational building blocks: keyed latest rows, last-n periods, keyed first rows, patches, theta links, pagination."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_any(col: Column, needles: list[str]) -> Column:
    """LIKE '%x%' OR ...; no needles: nothing is filtered."""
    return reduce(or_, [col.contains(n) for n in needles]) if needles else F.lit(True)


def ilike_any(cols: list[Column], needles: list[str]) -> Column:
    """Case-insensitive containment of any needle in any column."""
    return reduce(or_, [F.coalesce(F.lower(c).contains(n.lower()), F.lit(False)) for c in cols for n in needles]) if needles else F.lit(False)


def first_text(*cols: Column | str) -> Column:
    """The first column that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in cols])


def optional_filter(df: DataFrame, **values) -> DataFrame:
    """Equality filters for the given values; None means all rows."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def paginate(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page, its size clamped to 1..most."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def facts_of(facts: DataFrame, company_col: str, company, concept_col: str, concepts: list[str] | None = None) -> DataFrame:
    """The facts of one company whose concept holds any of the given parts; all of them without parts. Both filters reach the scan."""
    return facts.filter(F.col(company_col) == company).filter(contains_any(F.col(concept_col), concepts or []))


def prefixed(c: Column, prefix: str, but: str) -> Column:
    """Starts with one prefix and not with a longer one."""
    return c.startswith(prefix) & ~c.startswith(but)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark limits within every task before the shuffle, so hot keys arrive reduced."""
    return numbered(df, keys, order).filter(F.col("_rank") <= n).drop("_rank")


def last_periods(df: DataFrame, period: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of the n latest distinct periods (of each key, if keys are given)."""
    periods = df.select(*(keys or []), period).filter(F.col(period).isNotNull()).distinct()
    if keys:
        latest = top_per_key(periods, keys, [F.col(period).desc()], n)
    else:
        latest = periods.orderBy(F.col(period).desc()).limit(n)
    return df.join(latest, [*(keys or []), period], "left_semi")


def recover(left: DataFrame, right: DataFrame, on: list[str], value: str, fallback: Column) -> DataFrame:
    """Full outer join on the keys; where the left value is missing, the fallback of the right columns."""
    return left.join(right, on, "full_outer").withColumn(value, F.coalesce(F.col(value), fallback))


def patch(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """UPDATE by key: non-null values of the changes replace those of the rows."""
    renamed = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*df.columns)


def keyed_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """INSERT OR REPLACE: of all rows of a key the latest stays; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return top_per_key(both, keys, [F.col(order).desc_nulls_last(), F.col("_new").desc()]).drop("_new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of new whose key is not in old, one a key: the first in the given order, by default that of all other columns."""
    order = order or [F.col(c) for c in new.columns if c not in keys] or [F.lit(1)]
    return top_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti")


def prefix_sums(df: DataFrame, keys: list[str], coarse: list[Column], fine: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums (0 where all is null so far) within each key in the order coarse, then fine, the row itself included; without keys, over the whole table.

    In two steps, so that no key is ordered in one task: rows are summed up within (keys, coarse), and the totals of these
    ranges, one small row each, give what lies before. Choose coarse so that a range holds a bounded number of rows, such
    as a row number divided by a constant.
    """
    ranges = [f"_c{i}" for i in range(len(coarse))]
    ranked = df.withColumns({n: c for n, c in zip(ranges, coarse, strict=True)})
    inside = Window.partitionBy(*keys, *ranges).orderBy(*fine).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranked.groupBy(*keys, *ranges).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    offsets = totals.select(*keys, *ranges, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = ranked.withColumns({n: F.sum(v).over(inside) for n, v in sums.items()})
    joined = local.join(offsets.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, *ranges]}), [local[k].eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, *ranges]])
    return joined.select(*df.columns, *[(F.coalesce(n, F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums])


def ordered_ranges(df: DataFrame, value: Column, tie: Column, n: int = 256, width: int = 10_000) -> list[Column]:
    """Coarse columns for prefix_sums in the order of value, then tie (a number): n ranges of about as many rows each, by approximate
    quantiles. A value that fills more than a range, however often it occurs, is split further by tie, width numbers a part."""
    edges = df.select(value.cast("double").alias("_v")).approxQuantile("_v", [i / n for i in range(1, n)], 0.25 / n)
    hot = sorted({a for a, b in pairwise(edges) if a == b})
    cuts = sorted(set(edges))
    if not cuts:
        return [F.lit(0), F.lit(0)]
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value.cast("double")))
    part = F.when(value.cast("double").isin(hot), F.floor(tie / width)) if hot else F.lit(None).cast("long")
    return [F.coalesce(place, F.lit(-1)), F.coalesce(part, F.lit(-(2**62)))]


def replace_partitions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DELETE by key, then INSERT: rows of old whose key new does not bring, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def stem(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def grams(c: Column, n: int = 4) -> Column:
    """Distinct parts of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))


def contained_links(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 4) -> DataFrame:
    """Pairs of rows of which one's text holds the other's; texts of fewer than least characters link nothing.
    What holds a text holds its last characters too, so candidates meet in plain equi-joins on these."""
    left, right = left.filter(F.length(a) >= least), right.filter(F.length(b) >= least)
    last = lambda c: F.substring(c, -least, least)
    parts = lambda df, c: df.withColumn("_g", F.explode(grams(F.col(c), least)))
    holds = parts(left, a).join(right.withColumn("_g", last(b)), "_g").filter(F.col(a).contains(F.col(b)))
    lies = parts(right, b).join(left.withColumn("_g", last(a)), "_g").filter(F.col(b).contains(F.col(a)) & (F.length(a) < F.length(b)))
    columns = [*left.columns, *right.columns]
    return holds.select(*columns).unionByName(lies.select(*columns))


def resolve_columns(df: DataFrame, candidates: dict[str, list[str]]) -> dict[str, str]:
    """Logical name to the first existing column among its candidates, ignoring case."""
    present = {c.lower(): c for c in reversed(df.columns)}
    return {k: present[n.lower()] for k, names in candidates.items() for n in reversed(names) if n.lower() in present}
