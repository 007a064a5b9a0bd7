"""Sources and sinks on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import filings, tables


def test_company_facts_and_lookup(spark, tmp_path):
    row = lambda end, val, form="10-K": {"start": "2023-01-01", "end": end, "val": val, "accn": "a", "fy": 2024, "fp": "FY", "form": form, "filed": end}
    data = {"cik": 7, "entityName": "x", "facts": {"us-gaap": {"Assets": {"label": "A", "units": {"USD": [row("2023-12-31", 5.0), row("2023-12-31", 6.0, "10-Q")]}}}, "dei": {"Assets": {"label": "A", "units": {"USD": [row("2023-12-31", 9.0)]}}}, "other": {"Assets": {"label": "A", "units": {"USD": [row("2023-12-31", 1.0)]}}}}}
    (tmp_path / "f.json").write_text(json.dumps(data))
    facts = filings.company_facts(spark, str(tmp_path / "f.json"))
    assert facts.count() == 4 and filings.company_facts(spark, str(tmp_path / "f.json"), ["10-Q"]).count() == 1
    wanted = spark.createDataFrame([(7, "Assets", "2023-12-31", "10-K"), (8, "Assets", "2023-12-31", "10-K")], "cik long, concept string, period_end string, form_type string")
    assert {r.cik: r.filed_value for r in filings.point_lookup(facts, wanted).collect()} == {7: 5.0, 8: None}


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"edges": [{"source": "A", "target": "B", "relation": "r", "confidence": 0.9}, {"source": " ", "target": "B"}, {"source": "A"}]}))
    assert [(r.subject, r.predicate, r.object) for r in filings.graph_edges(spark, str(tmp_path / "g.json")).collect()] == [("A", "r", "B")]


def test_golden_set(spark, tmp_path):
    names = [c.split()[0] for c in filings.SCHEMAS["golden"].split(", ")]
    lines = [",".join(names), '1,x,T,1,10-K,2024,"a, b?",5,Revenues,baseline,easy,', "2,x,T,1,10-K,2024,q,5,N/A,segment,hard,"]
    (tmp_path / "g.csv").write_text("\n".join(lines))
    assert filings.golden_set(spark, str(tmp_path / "g.csv")).count() == 2
    assert filings.golden_set(spark, str(tmp_path / "g.csv"), id=1).first().question == "a, b?"
    assert filings.golden_set(spark, str(tmp_path / "g.csv"), mode="segment").first().id == 2


def test_snapshot_append_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.snapshot({"t": df}, str(tmp_path))
    assert tables.exists(spark, str(tmp_path / "t")) and not tables.exists(spark, str(tmp_path / "none"))
    assert tables.restore(spark, str(tmp_path), "t", df.limit(1)).count() == 1
    assert tables.restore(spark, str(tmp_path), "t").count() == 2
    tables.append(df, str(tmp_path / "log"))
    tables.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    tables.export(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == spark.read.json(str(tmp_path / "out/json")).count() == 2


def test_vector_sizes(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "k int, v array<float>")
    assert tables.mixed_sizes(df, "v") and not tables.mixed_sizes(df.filter("k <> 2"), "v")
    assert tables.reset_if_mixed(df, "v", 3).count() == 0
    assert tables.reset_if_mixed(df, "v", 3, keep_rows=True).filter(F.col("v").isNotNull()).count() == 0
    assert tables.reset_if_mixed(df.filter("k <> 2"), "v", 2).count() == 2
    assert {r.k for r in tables.to_embed(df, "v", 3).collect()} == {1, 3}


def test_catalogue_and_schemas(spark):
    spark.range(1).createOrReplaceTempView("listed_here")
    assert "listed_here" in {r.name for r in tables.listed(spark).collect()}
    for shape in filings.SCHEMAS.values():
        assert spark.createDataFrame([], shape).count() == 0


@pytest.mark.parametrize("keys", [["ticker"], ["ticker", "accession"]])
def test_replaced_partitions(spark, tmp_path, keys):
    rows = spark.createDataFrame([("A", "1", 1), ("A", "2", 2), ("B", "1", 3)], "ticker string, accession string, v int")
    tables.replace_partitions(rows, str(tmp_path / "p"), keys)
    tables.replace_partitions(spark.createDataFrame([("A", "1", 9)], rows.schema), str(tmp_path / "p"), keys)
    left = sorted(r.v for r in spark.read.parquet(str(tmp_path / "p")).collect())
    assert left == ([3, 9] if len(keys) == 1 else [2, 3, 9])


def test_xbrl_instances(spark, tmp_path):
    from quillspark.sources import xbrl

    (tmp_path / "a.xml").write_text(
        """<?xml version="1.0" encoding="utf-8"?>
<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2023" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:xsi="urn:xsi">
<xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="http://www.sec.gov/CIK">0000320193</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:entity><xbrli:identifier scheme="http://www.sec.gov/CIK">0000320193</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="us-gaap:X">us-gaap:Y</xbrldi:explicitMember><xbrldi:explicitMember dimension="us-gaap:Z">us-gaap:W</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2023-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>
<xbrli:unit id="eps"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>
<us-gaap:Revenues contextRef="c1" unitRef="usd" decimals="-6">100</us-gaap:Revenues>
<us-gaap:Revenues contextRef="c2" unitRef="usd" decimals="-6">40</us-gaap:Revenues>
<us-gaap:Eps contextRef="c1" unitRef="eps">2.5</us-gaap:Eps>
<us-gaap:Goodwill contextRef="c1" unitRef="usd" xsi:nil="true"/>
<us-gaap:Note contextRef="gone">text &amp; more</us-gaap:Note>
</xbrli:xbrl>"""
    )
    facts = xbrl.instance_facts(spark, f"file://{tmp_path}/a.xml")
    got = ((r.concept, r.value, r.number, r.unit, r.cik, r.period_start, r.period_end, [tuple(d) for d in r.dimensions]) for r in facts.collect())
    got = sorted(got, key=str)
    cik = "0000320193"
    assert got == sorted(
        [
            ("Revenues", "100", 100.0, "USD", cik, "2023-01-01", "2023-12-31", []),
            ("Revenues", "40", 40.0, "USD", cik, None, "2023-12-31", [("us-gaap:X", "us-gaap:Y"), ("us-gaap:Z", "us-gaap:W")]),
            ("Eps", "2.5", 2.5, "USD/shares", cik, "2023-01-01", "2023-12-31", []),
            ("Goodwill", None, None, "USD", cik, "2023-01-01", "2023-12-31", []),
            ("Note", "text & more", None, None, None, None, None, []),
        ],
        key=str,
    )
    assert xbrl.plain(facts).count() == 4 and {r.taxonomy for r in facts.collect()} == {"us-gaap"}
    assert xbrl.instance_facts(spark, f"file://{tmp_path}/a.xml", ["us-gaap:Eps", "dei:None"]).count() == 1


def test_merged_table(spark, tmp_path, monkeypatch):
    from quillspark.streaming.merge import KEPT, LEAST_SECONDS, MergedTable

    frame = lambda rows: spark.createDataFrame(rows, "k string, at int, v int")
    merged = MergedTable(spark, f"file://{tmp_path}/t", ["k"], "at", buckets=4)
    assert merged.read() is None
    assert merged.upsert(frame([("a", 1, 1), ("b", 1, 1), (None, 1, 1), ("a", 2, 5)]), 0)
    assert merged.upsert(frame([("a", 1, 9), ("b", 1, 2), ("c", 3, 3)]), 1)
    want = [("a", 2, 5), ("b", 1, 2), ("c", 3, 3)]
    got = {tuple(r) for r in merged.read().collect()}
    assert got == {*want, (None, 1, 1)}
    # a replayed batch changes nothing, whatever it holds
    assert not merged.upsert(frame([("a", 99, 99)]), 1) and not merged.upsert(frame([("a", 99, 99)]), 0)
    assert {tuple(r) for r in merged.read().collect()} == got
    # a broken batch leaves the old snapshot, and can be delivered again
    with monkeypatch.context() as m:
        m.setattr(MergedTable, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            merged.upsert(frame([("a", 3, 7)]), 2)
    assert {tuple(r) for r in merged.read().collect()} == got
    assert merged.upsert(frame([("a", 3, 7)]), 2)
    assert ("a", 3, 7) in {tuple(r) for r in merged.read().collect()}
    for i in range(3, 8):
        merged.upsert(frame([("b", i, i)]), i)
    assert len(merged.batches()) <= KEPT + 1 and ("c", 3, 3) in {tuple(r) for r in merged.read().collect()}
    assert merged.upsert(frame([]), 8) and merged.read().count() == 4
    asked = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k string, at int, v int").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(type(stream.writeStream), "trigger", lambda self, **how: (asked.append(how), self)[1])
    monkeypatch.setattr(type(stream.writeStream), "start", lambda self: None)
    for seconds in (1, 90, None):
        merged.follow(stream, f"file://{tmp_path}/c", seconds)
    assert LEAST_SECONDS == 60 and asked == [{"processingTime": "60 seconds"}, {"processingTime": "90 seconds"}, {"availableNow": True}]


def test_layouts_of_several_versions(spark, tmp_path):
    from quillspark.sources.layouts import Column, difference, migrated, read_versions, write_version

    versions = [[Column("id", "int"), Column("v", "float")], [Column("id", "bigint"), Column("v", "double"), Column("kind", "string", "concat('k', id)"), Column("n", "int")]]
    folder = f"file://{tmp_path}/t"
    assert read_versions(spark, folder, versions).count() == 0
    write_version(spark.createDataFrame([(1, 0.5), (2, None)], "id int, v float"), folder, versions, 1)
    write_version(spark.createDataFrame([("x", 2**40, 1.5, 7)], "kind string, id bigint, v double, n int"), folder, versions, 2)
    assert sorted(map(tuple, read_versions(spark, folder, versions).collect())) == [(1, 0.5, "k1", None), (2, None, "k2", None), (2**40, 1.5, "x", 7)]
    plan = read_versions(spark, folder, versions).filter("v > 1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(v)") == 2 and "kind" not in plan
    old = spark.createDataFrame([], "ID int, v double").schema
    assert [c.name for c in difference(old, versions[1])[0]] == ["kind", "n"] and [c.name for c in difference(old, versions[1])[1]] == ["id"]
    with pytest.raises(ValueError):
        difference(old, versions[0])  # v would be narrowed
    with pytest.raises(ValueError):
        migrated(spark.createDataFrame([], "id int, v float, more int"), versions[1])  # a column would be lost
    with pytest.raises(ValueError):
        write_version(spark.createDataFrame([], "id int, v float"), folder, versions, 2)
