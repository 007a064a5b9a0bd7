"""Knowledge graph as an edge table: candidate checks, ids, linking, search, peers, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import relational as R

#: Node types of the vocabulary.
NODE_TYPES = ["Company", "Product", "Person", "Metric", "Risk", "Segment", "Competitor", "Regulator"]


def triple_id() -> Column:
    """sha1 over ticker, chunk and lower-cased subject, predicate and object, parted by the unit separator."""
    return F.sha1(F.concat_ws("\x1f", "ticker", "chunk_id", F.lower("subject"), F.lower("predicate"), F.lower("object")))


def valid_triples(candidates: DataFrame, types: list[str] = NODE_TYPES, least: float = 0.5, per_chunk: int = 8) -> DataFrame:
    """Named, typed and confident triples: clamped confidence, cut names, upper-snake predicates, at most so many a chunk."""
    clean = candidates.withColumns(
        {
            "subject": F.substring(F.trim("subject"), 1, 255),
            "object": F.substring(F.trim("object"), 1, 255),
            "predicate": F.substring(T.upper_snake(F.col("predicate")), 1, 64),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double"))),
        }
    )
    good = clean.filter((F.col("subject") != "") & (F.col("object") != "") & F.col("subject_type").isin(types) & F.col("object_type").isin(types) & (F.col("confidence") >= least))
    return R.top_per_key(good.withColumn("id", triple_id()), ["chunk_id"], [F.desc("confidence"), F.col("id")], per_chunk)


def new_triples(old: DataFrame, new: DataFrame) -> DataFrame:
    return R.insert_ignore(old, new, ["id"])


def metric_links(triples: DataFrame, concepts: DataFrame) -> DataFrame:
    """metric, concept: metric nodes of either side linked to the first concept whose stem holds theirs or lies in it.
    Both sides are vocabularies (distinct names), not rows of facts."""
    side = lambda node, kind: triples.filter(F.col(kind) == "Metric").select(F.col(node).alias("metric"))
    metrics = side("subject", "subject_type").union(side("object", "object_type")).distinct().withColumn("_m", R.stem(F.col("metric")))
    tags = concepts.select("concept").distinct().withColumn("_c", R.stem(F.col("concept")))
    return R.contained_links(metrics, tags, "_m", "_c").groupBy("metric").agg(F.min("concept").alias("concept"))


def entity_search(triples: DataFrame, names: list[str], limit: int = 500) -> DataFrame:
    """Triples whose subject or object holds one of up to three names, the most confident first."""
    hit = R.ilike_any([F.col("subject"), F.col("object")], names[:3])
    return triples.filter(hit).orderBy(F.desc_nulls_last("confidence"), "id").limit(limit)


def degrees(triples: DataFrame) -> DataFrame:
    """node, degree over both ends."""
    return triples.select(F.col("subject").alias("node")).unionByName(triples.select(F.col("object").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def seed_nodes(triples: DataFrame, n: int) -> DataFrame:
    return degrees(triples).orderBy(F.desc("degree"), "node").limit(n)


def peers(edges: DataFrame, sectors: DataFrame, most: int = 4) -> DataFrame:
    """ticker, peer, rank: competitors named by a company first, then those that name it, then others of its sector.
    edges: ticker, object (a ticker); sectors: ticker, sector. The sector step takes each sector's first most + 1 members only."""
    out = edges.select("ticker", F.col("object").alias("peer"), F.lit(0).alias("way"))
    back = edges.select(F.col("object").alias("ticker"), F.col("ticker").alias("peer"), F.lit(1).alias("way"))
    some = R.top_per_key(sectors, ["sector"], [F.col("ticker")], most + 1).select("sector", F.col("ticker").alias("peer"))
    kin = sectors.join(some, "sector").select("ticker", "peer", F.lit(2).alias("way"))
    every = out.unionByName(back).unionByName(kin).filter(F.col("ticker") != F.col("peer"))
    first = every.groupBy("ticker", "peer").agg(F.min("way").alias("way"))
    w = Window.partitionBy("ticker").orderBy("way", "peer")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("ticker", "peer", "rank")


def listed(column: Column, name: str) -> Column:
    """Whether a comma-separated list holds a name, whatever the case and blanks."""
    return F.array_contains(F.transform(F.split(F.lower(column), ","), lambda x: F.trim(x)), name.lower())
