"""Registered queries of the line, canonical and source operators with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import canonical as cn
from ..operators import filings as fl
from ..operators import lines as ln
from ..sources import tables as st
from ..sources import xml
from .fixtures import oracle, view

#: Labels of the part lines below: two plain ones, one that overrides, one per-share one.
LABELS = [("red", "R", "first"), ("blue", "B", "last"), ("redgear", "RG", "last"), ("hot", "H", "per_share")]


def _lines(s, d):
    """Statement lines made of parts: a label, an amount with comma groups, and for hot ones a per-share figure or a dash."""
    amount = F.format_number(F.floor(F.col("p_retailprice")).cast("long") * 1000 + F.col("p_partkey") % 1000, 0)
    share = F.when(F.col("p_partkey") % 40 == 13, "--").otherwise(F.concat((F.col("p_partkey") % 90).cast("string"), F.lit(".25")))
    text = F.when(F.col("p_name").startswith("hot"), F.concat("p_name", F.lit(" "), share)).otherwise(F.concat("p_name", F.lit(" "), amount))
    return view(s, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("line_no"), text.alias("line"))


_AMOUNT = "CAST(floor(p_retailprice) AS BIGINT) * 1000 + p_partkey % 1000"
_LINE = f"""ln AS (SELECT p_brand AS doc_id, p_partkey AS line_no, replace(p_name, ' ', '') AS nm, starts_with(p_name, 'hot') AS hot, {_AMOUNT} AS amount, p_partkey % 40 = 13 AS dash, CAST((p_partkey % 90) || '.25' AS DOUBLE) AS share FROM {{part}})"""
_HIT = f"{_LINE}, h AS (SELECT ln.*, l.*, CASE WHEN kind = 'per_share' THEN CASE WHEN hot AND NOT dash THEN share END WHEN NOT hot THEN CAST(amount AS DOUBLE) END AS value FROM ln JOIN (VALUES {', '.join(f'{x}' for x in LABELS)}) l(label, code, kind) ON contains(nm, label))"


def _hits(s, d):
    return ln.label_hits(_lines(s, d), s.createDataFrame(LABELS, "label string, code string, kind string"))


_W5 = f"""WITH {_HIT}, t AS (SELECT *, min(line_no) FILTER (kind = 'per_share' AND hot AND dash) OVER (PARTITION BY doc_id, code) AS latch FROM h), k AS (SELECT * FROM t WHERE latch IS NULL OR line_no <= latch)
SELECT doc_id, code, kind, CASE WHEN kind = 'first' THEN arg_min(value, line_no) FILTER (value IS NOT NULL) ELSE arg_max(value, line_no) FILTER (value IS NOT NULL) END AS value,
  CASE WHEN bool_or(latch = line_no) THEN 'NOT_APPLICABLE' WHEN bool_or(value IS NOT NULL) THEN 'OK' END AS status FROM k GROUP BY 1, 2, 3 HAVING bool_or(value IS NOT NULL) OR bool_or(coalesce(latch = line_no, false))"""

CODES = [c for cs in (*cn.IS_CODES.values(), *cn.BS_CODES.values(), *cn.CF_CODES.values()) for c in cs]


def _values(s, d):
    """Item values of suppliers as filings: every code of the canonical rows, many missing."""
    codes = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(dict.fromkeys(CODES)))))
    rows = view(s, d, "supplier").select(F.col("s_suppkey").alias("filing_id"), codes.alias("x"))
    return rows.filter((F.col("filing_id") * 7 + F.col("x.i") * 3) % 5 > 1).select("filing_id", F.col("x.c").alias("item_code"), ((F.col("filing_id") * 13 + F.col("x.i") * 17) % 1000 - 100).cast("double").alias("value"))


_VAL = f"v AS (SELECT s_suppkey AS filing_id, c AS item_code, CAST((s_suppkey * 13 + i * 17) % 1000 - 100 AS DOUBLE) AS value FROM {{supplier}} CROSS JOIN (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(dict.fromkeys(CODES)))}) x(i, c) WHERE (s_suppkey * 7 + i * 3) % 5 > 1)"


def _wide(codes, name, ids="v"):
    cols = ", ".join("coalesce(" + ", ".join(f"max(value) FILTER (item_code = '{c}')" for c in cs) + f", NULL) AS {f}" for f, cs in codes.items())
    return f"{name} AS (SELECT filing_id, {cols} FROM v GROUP BY 1)"


_OPEX = ("selling_expense", "admin_expense", "rnd_expense", "finance_expense", "taxes_and_surcharges")
_IS = f"""{_VAL}, {_wide(cn.IS_CODES, 'w')}, i AS (SELECT * REPLACE (abs(cost_of_revenue) AS cost_of_revenue), total_revenue - abs(cost_of_revenue) AS gross_profit,
  CASE WHEN coalesce({', '.join(_OPEX)}) IS NOT NULL THEN {' + '.join(f'coalesce({c}, 0)' for c in _OPEX)} END AS operating_expenses FROM w)"""
_BS = f"""{_wide(cn.BS_CODES, 'wb')}, b AS (SELECT * REPLACE (coalesce(total_liabilities, CASE WHEN coalesce(current_liabilities, noncurrent_liabilities) IS NOT NULL THEN coalesce(current_liabilities, 0) + coalesce(noncurrent_liabilities, 0) END) AS total_liabilities,
  CASE WHEN total_assets IS NULL THEN liabilities_and_equity WHEN liabilities_and_equity IS NULL OR abs(liabilities_and_equity - total_assets) > greatest(1, abs(total_assets) * 1e-8) THEN total_assets ELSE liabilities_and_equity END AS liabilities_and_equity,
  coalesce(total_assets, liabilities_and_equity) AS total_assets) FROM wb)"""
_CF = f"""{_wide(cn.CF_CODES, 'wc')}, c AS (SELECT wc.* REPLACE (coalesce(wc.net_income, i.net_income) AS net_income) FROM wc LEFT JOIN i ON i.filing_id = wc.filing_id)"""


def _metrics(s, d):
    income, balance = cn.income_rows(_values(s, d)), cn.balance_rows(_values(s, d))
    cash = cn.cash_flow_rows(_values(s, d), income).select("filing_id", "net_cash_operating", "net_cash_investing")
    return cn.key_metrics(income.join(balance, "filing_id").join(cash, "filing_id"))


def _documents(s, d):
    """One instance document per supplier, with two contexts and facts of two tags in turn."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit('<x:xbrl xmlns:x="u"><x:context id="c1"><x:entity><x:identifier>'), k, F.lit("</x:identifier></x:entity><x:period><x:startDate>2023-01-01</x:startDate><x:endDate>2023-12-31</x:endDate></x:period></x:context>"),
        F.lit('<x:context id="c2"><x:entity><x:segment>a</x:segment></x:entity><x:period><x:instant>2023-12-31</x:instant></x:period></x:context>'),
        F.lit('<g:Assets contextRef="c1" unitRef="USD" decimals="-3">'), k, F.lit('</g:Assets><g:Sales unitRef="USD" contextRef="c2">5,000</g:Sales><g:Assets contextRef="c2"/></x:xbrl>'),
    )
    return view(s, d, "supplier").select(F.col("s_suppkey").alias("filing_id"), text.alias("xml"))


_FACT_ROWS = """SELECT s_suppkey AS filing_id, CAST(k AS BIGINT) AS fact_seq, tag, ctx AS context_ref, unit AS unit_ref, dec AS decimals, coalesce(val, CAST(s_suppkey AS VARCHAR)) AS value_raw FROM {supplier}
        CROSS JOIN (VALUES (0, 'Assets', 'c1', 'USD', '-3', NULL), (1, 'Sales', 'c2', 'USD', NULL, '5,000'), (2, 'Assets', 'c2', NULL, NULL, '')) v(k, tag, ctx, unit, dec, val)"""
_CONTEXT_ROWS = """SELECT s_suppkey AS filing_id, c AS context_id, CAST(a AS DATE) AS start_date, CAST(b AS DATE) AS end_date, CAST(i AS DATE) AS instant, x AS is_consolidated, CAST(n AS INT) AS duration_days FROM {supplier}
        CROSS JOIN (VALUES ('c1', '2023-01-01', '2023-12-31', NULL, true, 364), ('c2', NULL, NULL, '2023-12-31', false, NULL)) v(c, a, b, i, x, n)"""


def s4(s, d):
    index = view(s, d, "fx_filings").groupBy("company_key").agg(F.array_sort(F.collect_list("form_type")).alias("form"), F.array_sort(F.collect_list(F.col("report_date").cast("string"))).alias("reportDate"))
    index = index.withColumns({"filingDate": F.col("reportDate"), "accessionNumber": F.col("reportDate"), "primaryDocument": F.col("form")})
    return fl.submissions(index).select("company_key", F.col("seq").cast("long").alias("seq"), "form", "reportDate")


def s6(s, d):
    head = s.createDataFrame([("BS", 3, "Field Code", "Field Name"), ("BS", 1, "title", None), ("IS", 2, "Field Code", "Field Name")], "sheet string, row_no int, code string, name string")
    body = view(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "BS").otherwise("IS").alias("sheet"), (F.col("p_partkey") + 4).cast("int").alias("row_no"), F.concat(F.lit(" C"), "p_partkey").alias("code"), F.col("p_name").alias("name"))
    return st.chart_of_accounts(head.union(body))


def t6(s, d):
    files = view(s, d, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("f"), "l_linenumber", F.when(F.col("l_quantity") > 40, "_htm.xml").when(F.col("l_quantity") > 20, ".xml").otherwise(".txt")).alias("name"), "l_partkey", "l_suppkey")
    one = files.groupBy("filing_id", "seq").agg(F.max("name").alias("name"))
    return fl.instance_file(one).select("filing_id", "name")


def s11(s, d):
    files = view(s, d, "part").select(F.concat(F.lit("/pdf/"), F.col("p_partkey") % 60, F.lit("_"), F.col("p_size").cast("string"), F.lit("_annual.pdf")).alias("path"))
    companies = view(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return fl.pdf_manifest(companies, files)


QUERIES = {
    "f3_parse_eps_number": (
        lambda s, d: view(s, d, "part").select("p_partkey", ln.parse_per_share(F.concat(F.lit("x "), (F.col("p_partkey") % 1000).cast("string"), F.lit("，25"))).alias("value")),
        "WITH x AS (SELECT p_partkey, p_partkey % 1000 AS n FROM {part}) SELECT p_partkey, CASE WHEN n < 200 THEN n ELSE n % 10 END + 0.25::DOUBLE AS value FROM x",
    ),
    "f4_parse_amount_from_line": (lambda s, d: _lines(s, d).select("doc_id", "line_no", ln.parse_amount(F.col("line")).alias("value")), f"WITH {_LINE} SELECT doc_id, line_no, CASE WHEN NOT hot THEN CAST(amount AS DOUBLE) END AS value FROM ln"),
    "f5_parse_xbrl_number": (lambda s, d: view(s, d, "fx_facts").select("filing_id", "fact_seq", sc.parse_number_us(F.col("value_raw")).alias("value")), "SELECT filing_id, fact_seq, try_cast(value_raw AS DOUBLE) AS value FROM {fx_facts}"),
    "f6_parse_number_jp": (
        lambda s, d: _lines(s, d).select("line_no", sc.parse_number_jp(F.concat(F.lit("△"), ((F.col("line_no") + 1) * 1000).cast("string"))).alias("value"), sc.parse_number_jp(F.when(F.col("line_no") % 2 == 0, "―").otherwise("5")).alias("dash")),
        "SELECT p_partkey AS line_no, CAST(-1000 * (p_partkey + 1) AS DOUBLE) AS value, CAST(CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 5 END AS DOUBLE) AS dash FROM {part}",
    ),
    "f7_parse_iso_date": (
        lambda s, d: view(s, d, "orders").select("o_orderkey", sc.parse_iso_date(F.concat(F.lit("at "), F.date_format("o_orderdate", "yyyy年M月d日"))).alias("day")),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM {orders}",
    ),
    "f9_fiscal_year_from_title": (
        lambda s, d: view(s, d, "orders").select("o_orderkey", sc.fiscal_year_from_title(F.concat((2000 + F.col("o_orderkey") % 120).cast("string"), F.lit("年年度报告"))).alias("fiscal_year")),
        "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 120 < 100 THEN 2000 + o_orderkey % 120 END AS INT) AS fiscal_year FROM {orders}",
    ),
    "f10_reported_unit": (
        lambda s, d: view(s, d, "part").select("p_partkey", ln.reported_unit(F.concat(F.lit("单位： 人民币"), F.element_at(F.array(*map(F.lit, ("元", "千元", "百万元", "斤"))), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("unit")),
        "SELECT p_partkey, ['人民币元', '人民币千元', '人民币百万元', NULL][p_partkey % 4 + 1] AS unit FROM {part}",
    ),
    "f11_not_applicable_text": (
        lambda s, d: _lines(s, d).select("line_no", ln.is_not_applicable(F.col("line")).alias("na"), ln.na_before_number(F.col("line")).alias("na_first")),
        f"WITH {_LINE} SELECT line_no, hot AND dash AS na, hot AND dash AS na_first FROM ln",
    ),
    "f13_normalize_sec_code": (lambda s, d: view(s, d, "orders").select("o_orderkey", sc.normalize_sec_code(F.concat(F.lit("E"), "o_orderkey")).alias("code")), "SELECT o_orderkey, left(CAST(o_orderkey AS VARCHAR), 4) AS code FROM {orders}"),
    "f14_normalize_label": (
        lambda s, d: view(s, d, "fx_facts").select("tag").distinct().select("tag", sc.normalize_label(F.col("tag")).alias("label")),
        "SELECT DISTINCT tag, trim(regexp_replace(lower(regexp_replace(tag, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS label FROM {fx_facts}",
    ),
    "f18_short_currency": (
        lambda s, d: view(s, d, "orders").select("o_orderkey", sc.short_currency(F.floor("o_totalprice") * 1e6, "$").alias("text")),
        """SELECT o_orderkey, CASE WHEN floor(o_totalprice) >= 1e6 THEN format('${:.2f}T', floor(o_totalprice) / 1e6) WHEN floor(o_totalprice) >= 1e3 THEN format('${:.2f}B', floor(o_totalprice) / 1e3)
          WHEN floor(o_totalprice) >= 1 THEN format('${:.2f}M', floor(o_totalprice)) ELSE '$0.00' END AS text FROM {orders}""",
    ),
    "f19_ratio": (lambda s, d: view(s, d, "lineitem").select("l_orderkey", "l_linenumber", sc.ratio(F.col("l_quantity"), F.col("l_discount")).alias("ratio")), "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) AS ratio FROM {lineitem}"),
    "f20_sum_non_null": (
        lambda s, d: view(s, d, "fx_decisions").select("case_id", sc.sum_given(F.col("rule_value"), F.col("proposed_value")).alias("total"), F.coalesce("rule_value", "proposed_value").alias("first")),
        "SELECT case_id, CASE WHEN coalesce(rule_value, proposed_value) IS NOT NULL THEN coalesce(rule_value, 0) + coalesce(proposed_value, 0) END AS total, coalesce(rule_value, proposed_value) AS first FROM {fx_decisions}",
    ),
    "f27_coerce_value": (
        lambda s, d: _lines(s, d).select("line_no", sc.coerce_number(F.when(F.col("line_no") % 3 == 0, "NaN").when(F.col("line_no") % 3 == 1, F.col("line_no").cast("string"))).alias("value")),
        "SELECT p_partkey AS line_no, CAST(CASE WHEN p_partkey % 3 = 1 THEN p_partkey END AS DOUBLE) AS value FROM {part}",
    ),
    "f28_token_usage": (
        lambda s, d: view(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), F.coalesce(F.get_json_object("props", "$.total").cast("long"), F.get_json_object("props", "$.k").cast("long") + 7).alias("total_tokens")),
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens, coalesce(CAST(json_extract_string(props, '$.total') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT) + 7) AS total_tokens FROM {events}",
    ),
    "j5_line_label_match": (lambda s, d: _hits(s, d).select("doc_id", "line_no", "label", "code"), f"WITH {_HIT} SELECT doc_id, line_no, label, code FROM h"),
    "w5_map_conflict_policy": (lambda s, d: ln.line_values(_hits(s, d)), _W5),
    "w16_total_assets_row": (
        lambda s, d: ln.total_assets(_lines(s, d), ("redring", "bluering"), "smallgear", "greenbolt"),
        f"""WITH {_LINE}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY doc_id) AS c
          FROM ln), p AS (SELECT *, CASE WHEN contains(nm, 'redring') THEN 1 WHEN contains(nm, 'bluering') THEN 2 WHEN contains(nm,
          'smallgear') AND line_no - 1 >= floor(c * 0.6) THEN 3 END AS pr FROM n WHERE NOT contains(nm, 'greenbolt') AND NOT hot)
        SELECT doc_id, CAST(amount AS DOUBLE) AS total_assets FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pr, CASE WHEN pr = 3 THEN -line_no ELSE line_no END) AS rn FROM p WHERE pr IS NOT NULL) WHERE rn = 1""",
    ),
    "w16_total_liabilities_row": (
        lambda s, d: ln.total_liabilities(_lines(s, d), "red", "blue", "small", "gear"),
        f"""WITH {_LINE}, n AS (SELECT *, coalesce(bool_or(contains(nm, 'blue')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 8 PRECEDING
          AND 1 PRECEDING), false) AS b, coalesce(bool_or(contains(nm, 'small')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING
          AND 11 FOLLOWING), false) AS a FROM ln)
        SELECT doc_id, CAST(arg_min(amount, line_no) AS DOUBLE) AS total_liabilities FROM n WHERE contains(nm, 'red') AND NOT contains(nm, 'gear') AND a AND b AND NOT hot GROUP BY 1""",
    ),
    "c5_cn_income_rows": (lambda s, d: cn.income_rows(_values(s, d)), f"WITH {_IS} SELECT * FROM i"),
    "c5_cn_balance_rows": (lambda s, d: cn.balance_rows(_values(s, d)), f"WITH {_VAL}, {_BS} SELECT * FROM b"),
    "j12_cf_net_income_fallback": (lambda s, d: cn.cash_flow_rows(_values(s, d), cn.income_rows(_values(s, d))), f"WITH {_IS}, {_CF} SELECT * FROM c"),
    "c6_display_overlay": (
        lambda s, d: cn.display_overlay(cn.income_rows(_values(s, d)).select("filing_id", "net_income", "eps_basic"), cn.balance_rows(_values(s, d)).select("filing_id", F.col("cash").alias("net_income")), ["net_income"]),
        f"WITH {_IS}, {_BS} SELECT i.filing_id, coalesce(b.cash, i.net_income) AS net_income, eps_basic FROM i LEFT JOIN b ON b.filing_id = i.filing_id",
    ),
    "c7_key_metrics": (
        _metrics,
        f"""WITH {_IS}, {_BS}, {_CF} SELECT i.filing_id, operating_income / nullif(total_revenue, 0) AS operating_margin, i.net_income / nullif(total_revenue, 0) AS net_margin, current_assets / nullif(current_liabilities, 0) AS current_ratio,
        total_liabilities / nullif(total_assets, 0) AS debt_ratio, net_cash_operating / nullif(i.net_income, 0) AS cash_conversion, net_cash_operating + net_cash_investing AS free_cash_flow FROM i JOIN b ON i.filing_id = b.filing_id JOIN c ON c.filing_id = i.filing_id""",
    ),
    "c8_readable_report": (
        lambda s, d: cn.readable(cn.income_rows(_values(s, d)), {"net_income": "Net income", "total_revenue": "Revenue"}, "¥").select("filing_id", F.col("ordinal").cast("int").alias("ordinal"), "label", "raw", (F.col("text") == "N/A").alias("missing")),
        f"WITH {_IS} SELECT filing_id, 0 AS ordinal, 'Net income' AS label, net_income AS raw, net_income IS NULL AS missing FROM i UNION ALL SELECT filing_id, 1, 'Revenue', total_revenue, total_revenue IS NULL FROM i",
    ),
    "s2_read_xbrl_facts": (
        lambda s, d: xml.read_facts(_documents(s, d)),
        _FACT_ROWS,
    ),
    "s3_read_xbrl_contexts": (
        lambda s, d: xml.read_contexts(_documents(s, d)),
        _CONTEXT_ROWS,
    ),
    "s4_read_submissions_index": (
        s4,
        """WITH a AS (SELECT company_key, list_sort(list(form_type)) AS f, list_sort(list(CAST(report_date AS VARCHAR))) AS r FROM {fx_filings} GROUP BY 1)
        SELECT company_key, i - 1 AS seq, f[i] AS form, r[i] AS "reportDate" FROM a, range(1, len(f) + 1) AS g(i)""",
    ),
    "s6_read_chart_of_accounts": (s6, "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'BS' ELSE 'IS' END AS sheet, CAST(row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey) AS INT) AS ordinal, 'C' || p_partkey AS item_code, p_name AS item_name_std FROM {part}"),
    "s11_build_pdf_manifest": (
        s11,
        """WITH f AS (SELECT CAST(p_partkey % 60 AS VARCHAR) AS symbol, max('/pdf/' || (p_partkey % 60) || '_' || p_size || '_annual.pdf') AS path
          FROM {part} GROUP BY 1) SELECT CAST(s_suppkey AS VARCHAR) AS symbol, path, CASE WHEN path IS NULL THEN 'missing' ELSE 'ok' END AS status
          FROM {supplier} LEFT JOIN f ON symbol = CAST(s_suppkey AS VARCHAR)""",
    ),
    "t6_instance_file_pick": (
        t6,
        """WITH g AS (SELECT l_orderkey AS filing_id, l_linenumber AS seq, max('f' || l_linenumber || CASE WHEN l_quantity > 40 THEN '_htm.xml' WHEN l_quantity > 20 THEN '.xml' ELSE '.txt' END) AS name FROM {lineitem} GROUP BY 1, 2),
        r AS (SELECT *, CASE WHEN suffix(name, '_htm.xml') THEN 0 WHEN suffix(name, '.xml') THEN 1 END AS k FROM g) SELECT filing_id, name FROM (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY k, seq) AS rn FROM r WHERE k IS NOT NULL) WHERE rn = 1""",
    ),
}
ORACLES = {k: oracle(v[1]) for k, v in QUERIES.items() if v[1]}
QUERIES = {k: v[0] for k, v in QUERIES.items()}
