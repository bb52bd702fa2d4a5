"""Registered queries of whole Chinese statements with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import parse_number_us
from ..operators import chinese as zh
from .fixtures import oracle, view
from .statement_queries import _HEADER, OPEN, named_filings

SPEC = [(s, c, f, i) for s, fields in zh.FIELDS.items() for f, codes in fields.items() for i, c in enumerate(codes)]
CODES = list(dict.fromkeys((s, c) for s, c, _, _ in SPEC))
_SAID = [("table", "OK", "财务费用"), ("line", "NOT_APPLICABLE", "财务收入"), ("derived", "", None), ("line", "", "利息费用"), ("table", "PARSE_ERROR", None)]


def _values(s, d):
    """The facts as readings of all codes in turn, by one of five kinds of readings."""
    codes = s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CODES)], "i int, stmt string, item_code string")
    kinds = s.createDataFrame([(k, *x) for k, x in enumerate(_SAID)], "k int, source string, status string, label string")
    facts = view(s, d, "fx_facts").withColumns({"i": (F.col("fact_seq") * 7 + F.col("filing_id")) % len(CODES), "k": (F.col("fact_seq") * 3 + F.col("filing_id")) % len(_SAID)})
    rows = facts.join(F.broadcast(codes), "i").join(F.broadcast(kinds), "k")  # two fixed lists
    return rows.select("filing_id", "stmt", "item_code", "source", F.col("fact_seq").alias("seq"), parse_number_us(F.col("value_raw")).alias("value"), "status", F.col("value_raw").alias("raw_text"), "label")


def _filings(s, d):
    unit = F.element_at(F.array(F.lit("人民币元"), F.lit("人民币千元")), (F.col("company_key") % 2 + 1).cast("int"))
    return named_filings(s, d).withColumns({"title": F.concat(F.year("report_date").cast("string"), F.lit("年年度报告"), F.when(F.col("company_key") % 10 == 0, "(更正后)").otherwise("")), "reported_unit": unit})


_TEXT = lambda x: "NULL" if x is None else f"'{x}'"
_INPUT = f"""spec(stmt, item_code, field, code_pos) AS (VALUES {', '.join(map(str, SPEC))}),
v AS (SELECT filing_id, stmt, item_code, source, fact_seq AS seq, CASE WHEN regexp_full_match(value_raw, '[0-9.]+') THEN CAST(value_raw AS DOUBLE) END AS value, nullif(status, '') AS status, value_raw AS raw_text, label
  FROM {{fx_facts}} JOIN (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(CODES))}) c(i, stmt, item_code) ON (fact_seq * 7 + filing_id) % {len(CODES)} = i
  JOIN (VALUES {', '.join(f"({k}, {', '.join(map(_TEXT, x))})" for k, x in enumerate(_SAID))}) t(k, source, status, label) ON (fact_seq * 3 + filing_id) % {len(_SAID)} = k),
o AS (SELECT v.*, field, row_number() OVER (PARTITION BY filing_id, v.stmt, field ORDER BY value IS NULL, code_pos, CASE source WHEN 'line' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, seq) AS rn FROM v JOIN spec ON spec.stmt = v.stmt AND spec.item_code = v.item_code),
f AS (SELECT filing_id, stmt, field, max(value) FILTER (rn = 1) AS value, max(item_code) FILTER (rn = 1 AND value IS NOT NULL) AS item_code, max(source) FILTER (rn = 1 AND value IS NOT NULL) AS source,
  max(status) FILTER (source = 'line') AS line_status, max(status) FILTER (source = 'table') AS table_status, max(raw_text) FILTER (source = 'table') AS raw_text, max(label) FILTER (source = 'line') AS label FROM o GROUP BY ALL)"""
_NAMES = [f"{s}_{f}" for s, fields in zh.FIELDS.items() for f in fields]
_GIVEN = ("IS_selling_expense", "IS_admin_expense", "IS_rnd_expense", "IS_finance_expense", "IS_taxes_and_surcharges")
_SPECIAL = {
    "IS_cost_of_revenue": "abs(IS_cost_of_revenue)", "IS_provision_for_income_taxes": "abs(IS_provision_for_income_taxes)", "BS_total_assets": "coalesce(BS_total_assets, BS_total_liabilities_and_shareholders_equity)",
    "BS_total_liabilities": "coalesce(BS_total_liabilities, CASE WHEN coalesce(BS_total_current_liabilities, BS_total_noncurrent_liabilities) IS NOT NULL THEN coalesce(BS_total_current_liabilities, 0) + coalesce(BS_total_noncurrent_liabilities, 0) END)",
    "BS_total_liabilities_and_shareholders_equity": """CASE WHEN BS_total_assets IS NOT NULL AND (BS_total_liabilities_and_shareholders_equity IS NULL OR abs(BS_total_liabilities_and_shareholders_equity - BS_total_assets) > greatest(1, abs(BS_total_assets) * 1e-8))
      THEN BS_total_assets ELSE BS_total_liabilities_and_shareholders_equity END""",
    "CF_net_income": "coalesce(CF_net_income, IS_net_income)", "IS_gross_profit": "IS_total_revenue - abs(IS_cost_of_revenue)",
    "IS_operating_expenses": f"CASE WHEN coalesce({', '.join(_GIVEN)}) IS NOT NULL THEN {' + '.join(f'coalesce({g}, 0)' for g in _GIVEN)} END",
    "IS_non_operating_income_expense_net": "CASE WHEN coalesce(IS_non_operating_income, IS_non_operating_expense) IS NOT NULL THEN coalesce(IS_non_operating_income, 0) - abs(coalesce(IS_non_operating_expense, 0)) END",
    "BS_total_cash_and_short_term_investments": "BS_cash_and_cash_equivalents + BS_short_term_investments",
    "IS_finance_result_source_label": "CASE WHEN finance_label IN ('财务费用', '财务收入') THEN finance_label END",
}
for _kind in ("basic", "diluted"):
    _SPECIAL[f"IS_net_income_per_share_{_kind}_status"] = f"CASE WHEN IS_net_income_per_share_{_kind} IS NOT NULL THEN 'OK' ELSE coalesce({_kind}_line, {_kind}_table, 'MISSING') END"
    _SPECIAL[f"IS_net_income_per_share_{_kind}_raw_text"] = f"{_kind}_raw"
    _SPECIAL[f"IS_shares_outstanding_{_kind}"] = "CAST(NULL AS DOUBLE)"
_SHARES = ", ".join(f"max({c}) FILTER (stmt = 'IS' AND field = 'net_income_per_share_{k}') AS {k}_{n}" for k in ("basic", "diluted") for n, c in (("line", "line_status"), ("table", "table_status"), ("raw", "raw_text")))
_TABLE = f"""WITH {_INPUT}, w AS (SELECT filing_id, {', '.join(f"max(value) FILTER (stmt = '{n[:2]}' AND field = '{n[3:]}') AS {n}" for n in _NAMES)}, {_SHARES},
  max(label) FILTER (stmt = 'IS' AND field = 'finance_expense') AS finance_label FROM f GROUP BY filing_id)
SELECT {_HEADER.replace('f.form_type', "year(f.report_date) || '年年度报告' || CASE WHEN f.company_key % 10 = 0 THEN '(更正后)' ELSE '' END AS form_type")},
  CASE WHEN f.company_key % 2 = 0 THEN '人民币元' ELSE '人民币千元' END AS reported_unit, CAST(f.company_key % 10 = 0 AS INT) AS is_amendment,
  {', '.join(n for n in _NAMES if n not in _SPECIAL and n not in zh.HIDDEN)}, {', '.join(f'{x} AS {n}' for n, x in _SPECIAL.items())},
  'CN' AS country, 'FY' AS fiscal_period, 'CN_GAAP' AS accounting_standard, 'CONSOLIDATED' AS statement_scope, 'CNY' AS currency, {OPEN}
FROM w JOIN {{fx_filings}} f ON f.filing_id = w.filing_id"""


def _overlay(s, d):
    """The tables' raw values over the statements."""
    names = [f"IS_{f}" for f in zh.FIELDS["IS"] if f"IS_{f}" not in zh.HIDDEN]
    rows = zh.statement_table(_values(s, d), _filings(s, d)).select("filing_id", *(F.col(n).alias(n[3:]) for n in names))
    return zh.display_overlay(rows, _values(s, d).filter("stmt = 'IS' AND source = 'table'").select("filing_id", "item_code", "value", "seq"))


_OVER = {f: f"coalesce({', '.join(f'{c}_raw' for c in zh.FIELDS['IS'][f])}, {f})" for f in zh.OVERLAID}
_SHOWN = [f for f in zh.FIELDS["IS"] if f"IS_{f}" not in zh.HIDDEN]
_RAW = ", ".join(f"arg_max(value, seq) FILTER (item_code = '{c}' AND value IS NOT NULL) AS {c}_raw" for f in zh.OVERLAID for c in zh.FIELDS["IS"][f])
_OVERLAY = f"""WITH {_INPUT}, w AS (SELECT filing_id, {', '.join(f"max(value) FILTER (stmt = 'IS' AND field = '{f}') AS {f}" for f in _SHOWN)} FROM f GROUP BY filing_id),
x AS (SELECT * REPLACE (abs(cost_of_revenue) AS cost_of_revenue, abs(provision_for_income_taxes) AS provision_for_income_taxes) FROM w),
r AS (SELECT filing_id, {_RAW} FROM v WHERE stmt = 'IS' AND source = 'table' GROUP BY filing_id)
SELECT x.filing_id, {', '.join(f'{_OVER[f]} AS {f}' if f in _OVER else f for f in _SHOWN)} FROM x LEFT JOIN r ON r.filing_id = x.filing_id"""

QUERIES = {
    "c5_cn_field_sources": (lambda s, d: zh.field_values(_values(s, d)), f"WITH {_INPUT} SELECT * FROM f"),
    "c5_cn_statement_table": (lambda s, d: zh.statement_table(_values(s, d), _filings(s, d)), _TABLE),
    "c6_display_overlay_fields": (_overlay, _OVERLAY),
}
ORACLES = {k: oracle(v[1]) for k, v in QUERIES.items()}
QUERIES = {k: v[0] for k, v in QUERIES.items()}
