"""Dictionary matching: aliases as a table, found in texts as whole words by one equi-join on word n-grams.

A text is split where word characters meet others; n-grams run from a word to a word with what stands between, so a
joined n-gram is exactly the text of a mention, punctuation included. Only n-grams with as many pieces as some alias has are
made, and only from words that some alias begins with (where these are few enough to travel with the plan). The work grows with the text, not with the number of aliases; nothing in the plan depends on them but the sizes.
An alias begins and ends with a word character; others can't be whole words and are never found. Keys name rows: of rows that share
one, all texts count together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import shipped

#: Word characters; aliases that are broadcast at most (beyond it both sides are shuffled), pieces of an alias at most.
WORD, ASCII_WORD = r"\p{L}\p{N}_", "0-9A-Za-z_"
BROADCAST_ALIASES, MOST_PIECES = 200_000, 31
#: Different first words of aliases up to which n-grams are made from these words only.
FIRST_WORDS = 10_000


def pieces(text: Column, word: str = WORD) -> Column:
    """A text's words and what stands between them, in turn."""
    return F.split(text, f"(?<=[{word}])(?=[^{word}])|(?<=[^{word}])(?=[{word}])")


def mentions(rows: DataFrame, key: str | list[str], text: str, aliases: DataFrame, word: str = WORD) -> DataFrame:
    """Every mention of every alias: the key, place (pieces before it), size (its pieces), alias, value.

    aliases: alias, value, and optionally cased (true: only as it is written). Case doesn't matter otherwise. An alias that
    stands for several values is found for each."""
    keys = [key] if isinstance(key, str) else key
    cased = F.coalesce(F.col("cased"), F.lit(False)) if "cased" in aliases.columns else F.lit(False)
    known = aliases.select(F.lower("alias").alias("_gram"), "alias", "value", cased.alias("_cased"), F.size(pieces(F.col("alias"), word)).alias("size"))
    known = known.filter(F.col("alias").rlike(f"^[{word}](?:.*[{word}])?$") & (F.col("size") <= MOST_PIECES)).distinct()
    figures = known.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(figures.sizes) or [1]
    folded = lambda piece: F.upper(F.lower(piece))  # noqa: E731  one form of letters whose small form depends on what follows
    firsts = [r[0] for r in known.select(folded(pieces(F.col("alias"), word)[0])).distinct().limit(FIRST_WORDS + 1).collect()]
    split = rows.select(*keys, pieces(F.coalesce(F.col(text), F.lit("")), word).alias("_p"))
    at = F.sequence(F.lit(1), F.size("_p"))
    if len(firsts) <= FIRST_WORDS:
        at = F.filter(at, lambda i: F.coalesce(folded(F.get("_p", i - 1)).isin(firsts), F.lit(False)))
    # pieces are picked one by one: slices would copy the whole array each
    said = lambda i, n: F.concat(*[F.get("_p", i + (j - 1)) for j in range(n)])
    gram = lambda i, n: F.when(F.get("_p", i - 1).rlike(f"^[{word}]"), F.struct((i - 1).alias("place"), F.lit(n).alias("size"), said(i, n).alias("text")))
    grams_of = lambda n: F.filter(F.transform("_at", lambda i: gram(i, n)), lambda g: g["text"].isNotNull())
    made = F.flatten(F.array(*map(grams_of, sizes)))
    grams = split.withColumn("_at", at).select(*keys, F.explode(made).alias("_g")).select(*keys, "_g.place", "_g.text", F.col("_g.size").alias("size"), F.lower("_g.text").alias("_gram"))
    found = grams.join(F.broadcast(known) if figures.n <= BROADCAST_ALIASES else known, ["_gram", "size"])
    return found.filter(~F.col("_cased") | (F.col("text") == F.col("alias"))).select(*keys, "place", "size", "alias", "value")


def leftmost_longest(found: DataFrame, key: str | list[str]) -> DataFrame:
    """Of overlapping mentions of a text the one that begins first, of those the longest, then the first by alias and value."""
    keys = [key] if isinstance(key, str) else key
    kind = "array<struct<place:int,size:int,alias:string,value:string>>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            out = []
            for hits in some:
                kept, free = [], 0
                for h in sorted(hits, key=lambda h: (h["place"], -h["size"], h["alias"], h["value"])):
                    if h["place"] >= free:
                        kept.append(h)
                        free = h["place"] + h["size"]
                out.append(kept)
            yield pd.Series(out, dtype=object)

    hit = F.struct("place", "size", "alias", F.col("value").cast("string").alias("value"))
    grouped = found.groupBy(*keys).agg(F.collect_list(hit).alias("_h"))
    return grouped.select(*keys, F.explode(F.pandas_udf(shipped(run), kind)("_h")).alias("_m")).select(*keys, "_m.*")


def joined_back(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """All rows with the columns found for their keys; null keys are keys like others."""
    named = found.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [rows[k].eqNullSafe(named[f"_k_{k}"]) for k in keys]
    return rows.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])


def longest_value(rows: DataFrame, key: str | list[str], text: str, aliases: DataFrame, name: str, word: str = WORD) -> DataFrame:
    """All rows with the value of the longest alias in their text, of equally long ones the first by alphabet; null if there is none."""
    keys = [key] if isinstance(key, str) else key
    order = F.struct((-F.length("alias")).alias("_n"), F.lower("alias").alias("_a"), F.col("value").alias("_v"))
    best = mentions(rows, keys, text, aliases, word).groupBy(*keys).agg(F.min_by("value", order).alias(name))
    return joined_back(rows, best, keys)


def in_order(rows: DataFrame, key: str | list[str], text: str, aliases: DataFrame, name: str, word: str = WORD) -> DataFrame:
    """All rows with the distinct values in their text, in the order of first mention (then by value)."""
    keys = [key] if isinstance(key, str) else key
    first = mentions(rows, keys, text, aliases, word).groupBy(*keys, "value").agg(F.min("place").alias("place"))
    listed = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias(name))
    return joined_back(rows, listed, keys).withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
