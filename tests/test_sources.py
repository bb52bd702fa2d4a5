"""Files in and out."""

import datetime as dt
import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import filings
from ledgerlake.operators import xbrl as xb
from ledgerlake.operators.evaluate import require_columns
from ledgerlake.plans import registry
from ledgerlake.sources import instances, tables, xml


def test_companies_keep_zeros_and_lose_the_byte_order_mark(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿market,symbol\ncn,000750\n".encode())
    assert [tuple(r) for r in tables.read_companies(spark, str(tmp_path / "c.csv")).collect()] == [("cn", "000750")]


def test_facts_in_document_order(spark):
    text = """<r xmlns:g="u"><context id="a"><entity/><period><startDate>2023-01-01</startDate><endDate>2023-12-31</endDate></period></context>
    <context id="b"><entity><segment>s</segment></entity><period><instant>2023-12-31</instant></period></context>
    <g:X contextRef='a' unitRef="u">1</g:X><g:Y contextRef="b">2</g:Y><g:X contextRef="b" xsi:nil="true"/></r>"""
    docs = spark.createDataFrame([(1, text)], "filing_id int, xml string")
    assert [(r["fact_seq"], r["tag"], r["value_raw"]) for r in xml.read_facts(docs).orderBy("fact_seq").collect()] == [(0, "X", "1"), (1, "Y", "2"), (2, "X", "")]
    assert xml.read_facts(docs, drop_empty=True).count() == 2
    rows = {r["context_id"]: (r["duration_days"], r["is_consolidated"]) for r in xml.read_contexts(docs).collect()}
    assert rows == {"a": (364, True), "b": (None, False)}


def test_required_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"], {"flag": 1}).first()["flag"] == 1
    with pytest.raises(ValueError, match="missing columns: x"):
        require_columns(df, ["id", "x"])


def test_statements_and_reports_round_trip(spark, tmp_path):
    rows = spark.sql("SELECT 'us' AS market, 2023 AS fiscal_year, 1.5 AS net_income")
    tables.write_statements(rows, str(tmp_path / "s"))
    tables.write_report(rows, str(tmp_path / "r"))
    tables.write_anomalies(rows, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == spark.read.json(str(tmp_path / "a")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["market"] == "us"


INSTANCE = """<?xml version="1.0" encoding="UTF-8"?><r xmlns:g="u"><context id="a"><entity/><period><startDate>2023-01-01</startDate><endDate>2023-12-31</endDate></period></context>
<context id="b"><entity><segment>s</segment></entity><period><instant>2023-12-31</instant></period></context>
<g:X contextRef='a' unitRef="u" decimals="-3"> 1 </g:X><g:Y contextRef="b">2</g:Y><g:X contextRef="b" xsi:nil="true" xmlns:xsi="v"/></r>"""


def test_files_and_archives_give_what_columns_give(spark, tmp_path):
    """Facts and contexts of an XML file, and of the right document of an archive, equal those of the text as a column."""
    (tmp_path / "one_htm.xml").write_text(INSTANCE)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("XBRL/AuditDoc/a.xbrl", "<r/>")
        z.writestr("XBRL/PublicDoc/jpcrp-long-name.xbrl", "<r/>")
        z.writestr("S1/XBRL/PublicDoc/jpcrp-asr-001.xbrl", INSTANCE)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "cut_htm.xml").write_text(INSTANCE[: INSTANCE.index("<g:Y")] + "<g:Y contextRef=")
    (tmp_path / "empty.xml").write_text("")
    files = instances.instance_files(spark, str(tmp_path))
    docs = spark.createDataFrame([("one", INSTANCE), ("two", INSTANCE)], "filing_id string, xml string")
    rows = lambda df: sorted(map(str, df.filter("filing_id in ('one', 'two')").drop("path").collect()))
    assert rows(instances.read_facts(files)) == rows(xml.read_facts(docs)) and len(rows(instances.read_facts(files))) == 6
    assert rows(instances.read_contexts(files)) == rows(xml.read_contexts(docs)) and len(rows(instances.read_contexts(files))) == 4
    cut = instances.read_facts(files).filter("filing_id not in ('one', 'two')").collect()
    assert [(r["filing_id"], r["tag"], r["value_raw"]) for r in cut] == [("cut", "X", "1")]


def test_a_fact_ends_at_its_first_child():
    text = '<r><a contextRef="c">x<b contextRef="d">y</b>z</a><t contextRef="e">1 &amp; 2</t></r>'
    [rows] = list(instances._rows_of(io.BytesIO(text.encode()), instances._Facts))
    assert sorted((r[0], r[1], r[5]) for r in rows) == [(0, "a", "x"), (1, "b", "y"), (2, "t", "1 & 2")]


def test_a_very_large_document_stays_in_little_memory():
    """100 MB of facts leave the parser in batches, the document itself aside."""

    class Endless(io.RawIOBase):
        left = 100

        def read(self, n):
            self.left -= 1
            if self.left == 99:
                return b"<r>"
            return b'<f contextRef="c">12345</f>' * (n // 27) if self.left > 0 else b"</r>" if self.left == 0 else b""

    tracemalloc.start()
    n = sum(len(rows) for rows in instances._rows_of(Endless(), instances._Facts))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 98 * ((1 << 20) // 27) and peak < 40e6


def test_listings_read_no_contents(spark, tmp_path):
    for name in ("000750_2021_annual.pdf", "000750_2022_annual.pdf", "600000_2022_annual.pdf", "x.zip"):
        (tmp_path / name).write_bytes(b"12345")
    files = tables.list_files(spark, str(tmp_path), "*.pdf")
    scans = [line for line in files._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line]
    assert scans and all("content" not in line[line.index("ReadSchema") :] for line in scans)
    companies = spark.createDataFrame([("000750",), ("600000",), ("1",)], "symbol string")
    got = {r["symbol"]: r for r in filings.pdf_manifest(companies, files).collect()}
    assert got["000750"]["path"].endswith("000750_2022_annual.pdf") and got["600000"]["length"] == 5 and got["1"]["status"] == "missing"
    archives = filings.zip_manifest(spark.createDataFrame([("x",)], "symbol string"), tables.list_files(spark, str(tmp_path), "*.zip")).collect()
    assert [(r["symbol"], r["length"], r["status"]) for r in archives] == [("x", 5, "ok")]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    """Writing a market's year again leaves other markets and years as they are; what is done is read from the folders."""
    path = str(tmp_path / "s")
    row = lambda market, year, v: spark.sql(f"SELECT '{market}' AS market, {year} AS fiscal_year, {v} AS v")
    tables.write_statements(row("us", 2022, 1).union(row("us", 2023, 1)).union(row("jp", 2023, 1)), path)
    tables.write_statements(row("us", 2023, 2), path)
    assert sorted((r["market"], r["fiscal_year"], r["v"]) for r in spark.read.parquet(path).collect()) == [("jp", 2023, 1), ("us", 2022, 1), ("us", 2023, 2)]
    wanted = row("us", 2023, 0).union(row("cn", 2023, 0))
    assert [r["market"] for r in filings.not_done(wanted, tables.written_partitions(spark, path), ["market", "fiscal_year"]).collect()] == ["cn"]


def test_metrics_come_from_the_writing_job(spark, tmp_path):
    """One write, its counts right, and the input computed once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(50).select(F.lit("us").alias("market"), F.lit(2023).alias("fiscal_year"), counted(F.col("id").cast("int")).alias("v"))
    got = tables.write_observed(rows, str(tmp_path / "o"), {"n": F.count(F.lit(1)), "odd": F.count_if(F.col("v") % 2 == 1), "total": F.sum("v")})
    assert [tuple(r) for r in got.select("n", "odd", "total").collect()] == [(50, 25, 1225)] and seen.value == 50


def _shuffles(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning")


def test_dates_meet_contexts_before_facts_are_joined(spark):
    """Facts whose context neither ends nor stands at a date of their filing are not written."""
    day = dt.date(2023, 12, 31)
    facts = spark.createDataFrame([(1, 0, "Assets", "c", "USD", "1"), (1, 1, "Assets", "far", "USD", "2"), (1, 2, "Assets", "open", "USD", "3")], "filing_id long, fact_seq long, tag string, context_ref string, unit_ref string, value_raw string")
    contexts = spark.createDataFrame([(1, "c", None, None, day, True), (1, "far", None, None, dt.date(2020, 1, 1), True), (1, "open", None, None, dt.date(2022, 12, 31), True)], "filing_id long, context_id string, start_date date, end_date date, instant date, is_consolidated boolean")
    date = lambda d: spark.createDataFrame([(1, d)], "filing_id long, report_date date")
    specs = spark.createDataFrame([("BS", "total_assets", "instant", ["usd"], ["Assets"])], "stmt string, field string, period_type string, unit_keywords array<string>, tags array<string>")
    now, before = xb.dated_facts(facts, contexts, date(day), date(dt.date(2022, 12, 31)), specs)
    assert [[r["fact_seq"] for r in df.collect()] for df in (now, before)] == [[0], [2]]
    assert [r["value"] for r in xb.choose_facts(xb.scored_facts(now, None, None, specs)).collect()] == [1.0]


def test_cases_read_one_table_of_scored_facts(spark, sf_dir):
    """They joined and scored all facts three times."""
    assert _shuffles(registry.QUERIES["v2_build_cases_us_jp"](spark, sf_dir)) <= 12


def test_bundles_hold_many_documents_a_file(spark, tmp_path):
    """A file for each filing cost its listing and opening; documents with line breaks and broken ones keep their rows."""
    xml_ = '<r>\n<g:A xmlns:g="u" contextRef="c">é "q" {i}</g:A></r>'
    docs = spark.createDataFrame([*((i, xml_.replace("{i}", str(i))) for i in range(50)), (50, "<r><a contextRef='c'>1</a><")], "filing_id long, xml string").coalesce(2)
    instances.write_bundles(docs, str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part-*.json"))) <= 2
    rows = instances.read_facts(instances.instance_bundles(spark, str(tmp_path / "b"))).collect()
    assert {(r["filing_id"], r["value_raw"]) for r in rows} == {*((str(i), f'é "q" {i}') for i in range(50)), ("50", "1")}
