"""XBRL instances as facts, by Spark's XML source: facts meet their contexts and units, dimensional ones are told apart.

An instance is one record (its root element), a file of its own or a text in a column. Facts are child elements named after their concept, so they
are columns of the record: those asked for, or all that Spark infers. Contexts and units are arrays of the same record, so
nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the instance schema, whatever concepts a filing uses.
ROOT, CONTEXT, UNIT = "xbrli:xbrl", "xbrli:context", "xbrli:unit"
CONTEXT_SHAPE = (
    "array<struct<_id:string,`xbrli:entity`:struct<`xbrli:identifier`:struct<_VALUE:string>,`xbrli:segment`:struct<`xbrldi:explicitMember`:array<struct<_dimension:string,_VALUE:string>>>>,"
    "`xbrli:scenario`:struct<`xbrldi:explicitMember`:array<struct<_dimension:string,_VALUE:string>>>,`xbrli:period`:struct<`xbrli:startDate`:string,`xbrli:endDate`:string,`xbrli:instant`:string>>>"
)
UNIT_SHAPE = "array<struct<_id:string,`xbrli:measure`:array<string>,`xbrli:divide`:struct<`xbrli:unitNumerator`:struct<`xbrli:measure`:string>,`xbrli:unitDenominator`:struct<`xbrli:measure`:string>>>>"
FACT_SHAPE = "array<struct<_VALUE:string,_contextRef:string,_unitRef:string,_decimals:string,`_xsi:nil`:string>>"


def concepts_in(spark: SparkSession, path: str) -> list[str]:
    """Concepts of the instances, as prefix:name: the child elements that refer to a context."""
    found = spark.read.format("xml").option("rowTag", ROOT).option("inferSchema", False).load(path).schema
    element = lambda t: t.elementType if t.typeName() == "array" else t
    return [f.name for f in found if element(f.dataType).typeName() == "struct" and "_contextRef" in element(f.dataType).names]


def picked(rows: Column, key: str, value: Column) -> Column:
    return F.get(F.filter(rows, lambda x: x[key] == value), 0)


def shape_of(concepts: list[str]) -> str:
    if not concepts:
        raise ValueError("no concepts to read")
    return ", ".join([f"`{CONTEXT}` {CONTEXT_SHAPE}", f"`{UNIT}` {UNIT_SHAPE}", *[f"`{c}` {FACT_SHAPE}" for c in concepts]])


def instance_facts(spark: SparkSession, path: str, concepts: list[str] | None = None) -> DataFrame:
    """Facts of instance files, of the given concepts (prefix:name) or of all."""
    concepts = concepts_in(spark, path) if concepts is None else concepts
    return facts_of(spark.read.format("xml").option("rowTag", ROOT).schema(shape_of(concepts)).load(path), concepts)


def column_facts(rows: DataFrame, text: str, concepts: list[str]) -> DataFrame:
    """Facts of instances that are texts of a column; what is no instance has none."""
    return facts_of(rows.select(F.from_xml(text, shape_of(concepts)).alias("_x")).select("_x.*"), concepts)


def facts_of(rows: DataFrame, concepts: list[str]) -> DataFrame:
    """taxonomy, concept, value (text), number, unit, decimals, cik, context, period_start, period_end, dimensions (array of dimension and member).

    An instant is a period's end. A fact is plain if it has no dimensions. nil facts have no value; facts of an unknown context keep
    null in its place. Of a unit that divides, both measures are shown as a/b; prefixes of measures go."""
    fact = lambda name: lambda f: F.struct(F.lit(name.rpartition(":")[0]).alias("taxonomy"), F.lit(name.rpartition(":")[2]).alias("concept"), f["_VALUE"].alias("value"), f["_contextRef"].alias("context"), f["_unitRef"].alias("_unit"), f["_decimals"].alias("decimals"), f["_xsi:nil"].alias("_nil"))
    every = F.flatten(F.array(*[F.coalesce(F.transform(F.col(f"`{c}`"), fact(c)), F.array().cast("array<struct<taxonomy:string,concept:string,value:string,context:string,_unit:string,decimals:string,_nil:string>>")) for c in concepts]))
    each = rows.select(F.col(f"`{CONTEXT}`").alias("_c"), F.col(f"`{UNIT}`").alias("_u"), F.explode(every).alias("_f"))
    met = each.select("_f.*", picked(F.col("_c"), "_id", F.col("_f.context")).alias("_c"), picked(F.col("_u"), "_id", F.col("_f._unit")).alias("_u"))
    entity, period = F.col("_c")["xbrli:entity"], F.col("_c")["xbrli:period"]
    members = lambda c: F.coalesce(c["xbrldi:explicitMember"], F.array().cast("array<struct<_dimension:string,_VALUE:string>>"))
    dimensions = F.transform(F.concat(members(entity["xbrli:segment"]), members(F.col("_c")["xbrli:scenario"])), lambda m: F.struct(m["_dimension"].alias("dimension"), m["_VALUE"].alias("member")))
    bare = lambda c: F.regexp_replace(c, "^.*:", "")
    ratio = F.col("_u")["xbrli:divide"]
    divided = F.concat(bare(ratio["xbrli:unitNumerator"]["xbrli:measure"]), F.lit("/"), bare(ratio["xbrli:unitDenominator"]["xbrli:measure"]))
    value = F.when(F.coalesce(F.lower("_nil"), F.lit("")).isin("true", "1"), F.lit(None)).otherwise(F.col("value"))
    return met.select(
        "taxonomy", "concept", value.alias("value"), value.try_cast("double").alias("number"), F.coalesce(F.array_join(F.transform(F.col("_u")["xbrli:measure"], bare), "*"), divided).alias("unit"), "decimals",
        entity["xbrli:identifier"]["_VALUE"].alias("cik"), "context", period["xbrli:startDate"].alias("period_start"), F.coalesce(period["xbrli:endDate"], period["xbrli:instant"]).alias("period_end"), F.coalesce(dimensions, F.array().cast("array<struct<dimension:string,member:string>>")).alias("dimensions"),
    )


def plain(facts: DataFrame) -> DataFrame:
    """Facts about the whole company."""
    return facts.filter(F.size("dimensions") == 0)
