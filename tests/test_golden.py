"""Hand-made rows for text rules that SQL engines read differently."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import scalars as sc
from ledgerlake.operators import anomaly, matching, pages, tables, verify, xbrl
from ledgerlake.plans import registry, specs
from ledgerlake.sources import shared


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("一、营业收入：", "营业收入"), ("一年内到期的非流动资产", "年内到期的非流动资产"), ("加：其他 收益", "其他收益")])
def test_clean_item_name(spark, text, want):
    assert value(spark, sc.clean_item_name(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("(1,234)", -1234.0), ("—", None), ("0.85", 0.85), ("12", 12.0), ("8.2062", 2062.0)])
def test_parse_number_cn(spark, text, want):
    assert value(spark, sc.parse_number_cn(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("△1,234", -1234.0), ("―", None), ("12", 12.0)])
def test_parse_number_jp(spark, text, want):
    assert value(spark, sc.parse_number_jp(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("2024年3月5日", "2024-03-05"), ("2024/3/5", "2024-03-05"), ("none", None)])
def test_parse_iso_date(spark, text, want):
    assert value(spark, sc.parse_iso_date(F.lit(text))) == want


@pytest.mark.parametrize("market, symbol, want", [("cn", "750", "000750"), ("cn", "1234567", "1234567"), ("jp", "72030", "72030"), ("us", "aapl", "AAPL")])
def test_normalize_symbol(spark, market, symbol, want):
    assert value(spark, sc.normalize_symbol(F.lit(market), F.lit(symbol))) == want


def test_confidence_and_formats(spark):
    yes, no = F.lit(True), F.lit(False)
    assert value(spark, sc.confidence(F.lit(1.0), yes, no, yes, no)) == 0.42
    assert value(spark, sc.short_currency(F.lit(1.5e12), "$")) == "$1.50T"
    assert value(spark, sc.short_currency(F.lit(-2.5e6), "¥")) == "¥-2.50M"
    assert value(spark, sc.short_currency(F.lit(None).cast("double"), "$")) == "N/A"


def test_fuzz_ratio(spark):
    assert round(value(spark, matching.indel_ratio(F.lit("kitten"), F.lit("sitting"))), 2) == 61.54


def test_merged_line(spark):
    assert value(spark, anomaly.merged_line(F.lit("应收账款"), F.lit(1)))


def test_section_imbalance(spark):
    sections = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, None)], "section_id int, parent_value double")
    items = spark.createDataFrame([(1, 40.0), (1, None), (1, 60.0)], "section_id int, value double")
    rows = {r["section_id"]: (r["children_sum"], r["diff"], r["is_imbalance"]) for r in anomaly.section_imbalance(sections, items).collect()}
    assert rows == {1: (100.0, 0.0, False), 2: (None, None, True), 3: (None, None, False)}


def test_noop_repair(spark):
    rows = spark.createDataFrame([("REPAIR", 5.0, "MISSING", 5.0, 1, True)], "decision string, rule_value double, rule_status string, proposed_value double, n_evidence int, supported boolean")
    got = verify.repair_guardrails(rows).first()
    assert (got["guard_fail"], got["final_decision"], got["final_value"]) == ("noop_repair_same_as_rule", "NEED_REVIEW", 5.0)


def test_toc_line(spark):
    lines = spark.createDataFrame([(1, "第十节 财务报告 ........ 152"), (1, "152")], "doc_id int, line string")
    assert [(r["title"], r["page"]) for r in pages.toc_items(lines).collect()] == [("第十节 财务报告", 152)]


def test_decision_json(spark):
    got = value(spark, verify.parse_decision(F.lit('```json\n{"decision": "keep", "evidence_item_codes": [" A ", "A", ""]}\n```')))
    assert (got["decision"], got["codes"], got["proposed_status"]) == ("KEEP", ["A"], "UNCHANGED")


def test_japanese_chains(spark):
    """The first tag of a chain with a readable value counts, whatever the scores."""
    facts = spark.createDataFrame([(1, 0, "NetSales", "c", "JPY", "-"), (1, 1, "OperatingRevenue1", "c", "JPY", "1,000"), (1, 2, "Revenue", "c", "JPY", "7")], "filing_id long, fact_seq long, tag string, context_ref string, unit_ref string, value_raw string")
    contexts = spark.sql("SELECT 1L AS filing_id, 'c' AS context_id, DATE '2023-04-01' AS start_date, DATE '2024-03-31' AS end_date, CAST(NULL AS DATE) AS instant, true AS is_consolidated")
    filings = spark.sql("SELECT 1L AS filing_id, DATE '2024-03-31' AS report_date")
    single, chains = specs.chain_specs(spark)
    rows = xbrl.chain_values(xbrl.scored_facts(facts, contexts, filings, single, xbrl.ANNUAL_JP), chains).collect()
    assert [(r["field"], r["value"]) for r in rows] == [("IS_total_revenue", 1000.0)]


def test_anomaly_documents(spark):
    """Flags, differences, merged lines and anchors of a document, told from items that are gathered once."""
    sections = spark.createDataFrame([(1, 7, "s", "p", 100.0), (2, 7, "s", "p", 5.0), (3, 8, "s", "p", None)], "section_id int, doc_id int, section string, parent_item string, parent_value double")
    items = spark.createDataFrame(
        [(1, 2, " 应收 账款", 1, ["-"], 60.0), (1, 1, "a", 1, ["-"], 40.0), (1, 3, "特殊归并_非流动资产", 1, ["-"], 9.0), (1, 4, "特殊格式_流动资产", 1, ["-"], None), (3, 1, "特殊格式_流动资产", 1, ["7"], None), (9, 1, "a", 1, ["-"], 1.0)],
        "section_id int, seq int, item_raw string, n_codes int, cells array<string>, value double",
    )
    anchors = spark.createDataFrame(list(enumerate("abcd")), "ordinal int, anchor string")
    out = anomaly.anomaly_documents(sections, items, anchors)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
    rows = {r["doc_id"]: r for r in out.collect()}
    one, two = rows[7]["sections"]
    assert one["flags"] == ["FORMAT", "AGGREGATION"] and (one["children_sum"], one["diff"]) == (100.0, 0.0) and one["missing_anchors"] == ["b", "c", "d"]
    assert [(m["seq"], m["codes"]) for m in one["merged"]] == [(2, ["NOTESRECE", "ACCORECE"])] and [x["is_marker"] for x in one["items"]] == [False, False, True, True]
    assert two["flags"] == ["IMBALANCE"] and (two["items"], two["merged"], two["missing_anchors"], two["diff"]) == ([], [], None, None)
    assert [tuple(f) for f in rows[7]["report"]["sections_flagged"]] == [(1, ["FORMAT", "AGGREGATION"]), (2, ["IMBALANCE"])]
    (three,) = rows[8]["sections"]
    assert three["flags"] == ["FORMAT"] and [x["is_marker"] for x in three["items"]] == [False]


def test_clean_tables_sorts_bounded_parts(spark, monkeypatch):
    """Cells are shuffled once, into parts by their number; columns keep the names of their header, ragged ones have none."""
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    grid = [["项目", "本期", "本期", " "], ["a", "1", "2", ""], ["b", "", "3", ""]]
    ragged = [["甲", "乙"], ["c", "4", "5"]]
    cells = [(t, r, c, x) for t, rows in [(1, grid), (2, ragged)] for r, row in enumerate(rows, 1) for c, x in enumerate(row)]
    out = tables.clean_tables(spark.createDataFrame(cells, "table_id int, row_no int, col_no int, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "hashpartitioning(table_id#" in plan and ", 2), REPARTITION_BY_NUM" in plan
    got = {(r["table_id"], r["row_no"], r["col_no"]): (r["name"], r["text"]) for r in out.collect()}
    want = {(1, 2, 0): ("项目", "a"), (1, 2, 1): ("本期", "1"), (1, 2, 2): ("本期_1", "2"), (1, 3, 0): ("项目", "b"), (1, 3, 1): ("本期", None), (1, 3, 2): ("本期_1", "3")}
    want |= {(2, 1, 0): ("col_0", "甲"), (2, 1, 1): ("col_1", "乙"), (2, 2, 0): ("col_0", "c"), (2, 2, 1): ("col_1", "4"), (2, 2, 2): (None, "5")}
    assert got == want


def test_section_children(spark, sf_dir, monkeypatch):
    rows = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (1, 3, "P", True), (1, 4, "Q", True), (1, 5, "c", False), (1, 6, "R", True), (1, 7, "d", False), (2, 1, "e", False)], "chart int, ordinal int, item_code string, is_parent boolean")
    got = anomaly.section_children(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("+- Window [") == 1
    assert sorted(map(tuple, got.collect())) == [(1, "P", "a", 1), (1, "P", "b", 2), (1, "R", "c", 5)]
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    plan = registry.QUERIES["w13_bs_section_children"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
