"""Chinese statements from readings of several sources, by hand."""

import datetime

import pytest

from ledgerlake.operators import chinese as zh

#: The columns that a statement row has, by statement; metadata and anomaly columns are the same in all three.
SHARED = "country symbol company_id form_type fiscal_year_end_date filing_date fiscal_year fiscal_period source_filing_id is_amendment accounting_standard taxonomy_version statement_scope currency reported_unit unit_scale anomaly_flag anomaly_type anomaly_score anomaly_detail".split()
COLUMNS = {
    "IS": "total_revenue cost_of_revenue gross_profit taxes_and_surcharges selling_expense admin_expense rnd_expense finance_expense operating_expenses operating_income non_operating_income_expense_net "
    "other_income income_before_income_taxes provision_for_income_taxes net_income net_income_per_share_basic net_income_per_share_diluted net_income_per_share_basic_status net_income_per_share_diluted_status "
    "net_income_per_share_basic_raw_text net_income_per_share_diluted_raw_text finance_result_source_label shares_outstanding_basic shares_outstanding_diluted",
    "BS": "total_assets cash_and_cash_equivalents short_term_investments total_cash_and_short_term_investments inventories accounts_receivable other_current_assets total_current_assets property_plant_and_equipment_net "
    "goodwill intangible_assets other_noncurrent_assets accounts_payable short_term_debt other_current_liabilities total_current_liabilities long_term_debt other_noncurrent_liabilities total_liabilities "
    "total_shareholders_equity accumulated_other_comprehensive_income_or_loss common_stock additional_paid_in_capital retained_earnings noncontrolling_interests total_liabilities_and_shareholders_equity",
    "CF": "net_income net_cash_operating net_cash_investing net_cash_financing effect_of_exchange_rates_on_cash net_change_in_cash cash_beginning_of_period cash_end_of_period",
}
ROWS = [
    # filing, stmt, code, source, seq, value, status, raw_text, label
    (1, "IS", "BIZINCO", "line", 1, 900.0, "OK", None, None), (1, "IS", "BIZTOTINCO", "table", 2, 1000.0, "OK", "1,000", None), (1, "IS", "BIZTOTINCO", "derived", 3, 1.0, None, None, None),
    (1, "IS", "BIZTOTCOST", "table", 4, -600.0, "OK", None, None), (1, "IS", "FINEXPE", "table", 5, 20.0, "OK", None, "利息"), (1, "IS", "FINEXPE", "line", 6, -7.0, "OK", None, "财务收入"),
    (1, "IS", "SALESEXPE", "table", 7, 10.0, "OK", None, None), (1, "IS", "NONOEXPE", "table", 8, -4.0, "OK", None, None), (1, "IS", "INCOTAXEXPE", "other", 9, -3.0, "OK", None, None),
    (1, "IS", "BASICEPS", "table", 10, None, "PARSE_ERROR", "n/a", None), (1, "IS", "BASICEPS", "line", 11, None, "NOT_APPLICABLE", None, None), (1, "IS", "DILUTEDEPS", "table", 12, None, "MISSING", "-", None),
    (1, "IS", "NETPROFIT", "table", 13, 5.0, "OK", None, None), (1, "BS", "TOTASSET", "line", 14, 500.0, "OK", None, None), (1, "BS", "TOTLIABSHAREQUI", "table", 15, 400.0, "OK", None, None),
    (1, "BS", "TOTALCURRLIAB", "table", 16, 30.0, "OK", None, None), (1, "BS", "CURFDS", "table", 17, 8.0, "OK", None, None), (1, "BS", "TRADFINASSET", "table", 18, 2.0, "OK", None, None),
    (1, "CF", "MANANETR", "table", 19, 50.0, "OK", None, None), (1, "CF", "MANANETR", "table", 20, 60.0, "OK", None, None), (1, "CF", "UNKNOWN", "table", 21, 60.0, "OK", None, None),
    (2, "BS", "TOTLIABSHAREQUI", "table", 1, 70.0, "OK", None, None), (3, "IS", "NETPROFIT", "table", 1, None, "MISSING", None, None), (9, "IS", "NETPROFIT", "table", 1, 1.0, "OK", None, None),
]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(ROWS, "filing_id long, stmt string, item_code string, source string, seq long, value double, status string, raw_text string, label string").repartition(3)


@pytest.fixture(scope="module")
def filings(spark):
    rows = [(i, "000750", "gs1", f"id{i}", "2023年年度报告" + ("（更正后）" if i == 2 else ""), datetime.date(2023, 12, 31), datetime.date(2024, 4, 1), "人民币千元") for i in (1, 2, 3, 4)]
    return spark.createDataFrame(rows, "filing_id long, symbol string, company_id string, source_filing_id string, title string, report_date date, filing_date date, reported_unit string")


def test_columns(values, filings):
    table = zh.statement_table(values, filings)
    want = [*SHARED, *(f"{s}_{c}" for s, cs in COLUMNS.items() for c in cs.split())]
    assert sorted(table.columns) == sorted(["filing_id", *want]) and len(set(SHARED) | {c for cs in COLUMNS.values() for c in cs.split()}) == 77


def test_rows(values, filings):
    rows = {r["filing_id"]: r.asDict() for r in zh.statement_table(values, filings).collect()}
    assert set(rows) == {1, 2, 3}  # 4 has no reading, 9 no filing
    one = rows[1]
    assert (one["IS_total_revenue"], one["IS_cost_of_revenue"], one["IS_gross_profit"]) == (1000.0, 600.0, 400.0)  # the first code, though a line has the second
    assert (one["IS_finance_expense"], one["IS_finance_result_source_label"], one["IS_operating_expenses"]) == (-7.0, "财务收入", 3.0)  # the line before the table
    assert (one["IS_non_operating_income_expense_net"], one["IS_provision_for_income_taxes"]) == (-4.0, 3.0)
    assert (one["IS_net_income_per_share_basic_status"], one["IS_net_income_per_share_basic_raw_text"], one["IS_net_income_per_share_diluted_status"]) == ("NOT_APPLICABLE", "n/a", "MISSING")
    assert (one["BS_total_assets"], one["BS_total_liabilities_and_shareholders_equity"], one["BS_total_liabilities"], one["BS_total_cash_and_short_term_investments"]) == (500.0, 500.0, 30.0, 10.0)
    assert (one["CF_net_cash_operating"], one["CF_net_income"]) == (50.0, 5.0)  # the first of equal sources; the income statement's
    assert (rows[2]["BS_total_assets"], rows[2]["is_amendment"], rows[1]["is_amendment"]) == (70.0, 1, 0)
    assert rows[3]["IS_net_income"] is None and rows[3]["symbol"] == "000750" and rows[3]["anomaly_type"] is None


def test_sources(values):
    got = {(r["filing_id"], r["field"]): (r["value"], r["item_code"], r["source"]) for r in zh.field_values(values).collect()}
    assert got[1, "total_revenue"] == (1000.0, "BIZTOTINCO", "table") and got[1, "provision_for_income_taxes"] == (-3.0, "INCOTAXEXPE", "other") and got[3, "net_income"] == (None, None, None)
    other = {(r["filing_id"], r["field"]): r["source"] for r in zh.field_values(values, sources=("derived", "table", "line")).collect()}
    assert other[1, "total_revenue"] == "derived" and other[1, "finance_expense"] == "table"


def test_one_exchange_by_filing(values, filings):
    """The readings are shuffled once, however many fields and statements there are."""
    plan = zh.field_values(values)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty(values, filings):
    assert zh.statement_table(values.limit(0), filings).count() == 0 and zh.field_values(values.limit(0)).count() == 0
