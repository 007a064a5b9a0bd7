"""Temporal URL filter: dated list entries become validity intervals, and every capture meets those active when it was fetched.

An entry is (list_key, action, since): from that day on the host (or any host below it) is 'block'ed, or 'allow'ed again.
Consecutive entries of a key become half-open intervals; an as-of lookup finds, for each of a host's own name and its
parent domains, the interval that holds the fetch day. The most specific key decides.

Defined cases: a capture whose url is null or has no host, or whose fetch day is null, meets no entry and is kept.
Keys and hosts are compared in lower case and without final dots; an IPv4 address has no parent domains.
Of several entries of a key and day, 'block' wins. Entries with a null key or day, or an action that is neither 'block' nor
'allow' (in any case), are ignored. Repeated captures are
each evaluated. Empty tables give an empty result or all kept. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, sized_broadcast


def host_of(url: Column) -> Column:
    """Lower-case host without port and final dots, empty if there is none."""
    return F.coalesce(folded(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def folded(name: Column) -> Column:
    """A host name as the list and the captures are compared: lower case, no final dots."""
    return F.lower(F.regexp_replace(name, r"\.+$", ""))


def domain_keys(host: Column) -> Column:
    """The host and every parent domain of at least two labels, with the number of labels as rank. An IPv4 address has no parents."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.lit(1)).otherwise(F.greatest(n - 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("labels")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list_key, action, since, until (exclusive; null: still active)."""
    known = entries.select(folded(F.col("list_key")).alias("list_key"), F.lower("action").alias("action"), "since").filter("list_key <> '' and since is not null and action in ('allow', 'block')")
    days = known.groupBy("list_key", "since").agg(F.max("action").alias("action"))
    later = Window.partitionBy("list_key").orderBy("since")
    return days.withColumn("until", F.lead("since").over(later))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """A row a capture: page_id, host, fetched, list_key, action, active_since, kept.

    Hosts meet the list once each, as a set of host intervals; captures then join these by host and day, so a host with a
    large share of the captures costs one equi-join key that adaptive execution splits, and a list row is never repeated
    per capture. The list side is broadcast only when its measured size is within the limit.
    """
    seen = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("fetched"))
    hosts = seen.select("host").filter("host <> ''").distinct()
    keys = hosts.select("host", F.explode(domain_keys(F.col("host"))).alias("_k")).select("host", F.col("_k.key").alias("list_key"), F.col("_k.labels").alias("labels"))
    active = cut(keys.join(validity_intervals(entries), "list_key").select("host", "labels", "list_key", "action", "since", "until"))
    active = sized_broadcast(active, active.count(), 200_000)
    same_time = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    best = F.max(F.when(F.col("list_key").isNotNull(), F.struct("labels", "list_key", "action", "since")))
    hit = seen.withColumn("_row", F.monotonically_increasing_id()).alias("s").join(active.alias("a"), (F.col("s.host") == F.col("a.host")) & same_time, "left")
    found = hit.groupBy("s._row", "s.page_id", "s.host", "s.fetched").agg(best.alias("_b"))
    return found.select(
        "page_id",
        "host",
        "fetched",
        F.col("_b.list_key").alias("list_key"),
        F.col("_b.action").alias("action"),
        F.col("_b.since").alias("active_since"),
        (F.coalesce(F.col("_b.action"), F.lit("")) != "block").alias("kept"),
    )
