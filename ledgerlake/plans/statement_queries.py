"""Registered queries of whole statement tables and market rules, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import anomaly as an
from ..operators import canonical as cn
from ..operators import evaluate as ev
from ..operators import filings as fl
from ..operators import lines as ln
from ..operators import pages as pg
from ..operators import tables as tb
from ..operators import verify as vf
from ..operators import xbrl as xb
from ..sources import tables as st
from ..sources.shared import scratch_path
from . import specs
from .fixtures import oracle, view
from .xbrl_queries import _VALUE, _best, _inputs
from .xbrl_queries import _ctes as _xbrl_ctes


def _values(rows) -> str:
    return ", ".join(f"('{s}', '{f}', '{p}', '{'|'.join(u)}', {i}, '{t}')" for s, f, ts, p, u in rows for i, t in enumerate(ts))


def _ctes(rows, facts: str) -> str:
    """The specs, contexts (c), facts with them (j), report dates (r) and durations that end on them (w)."""
    return f"""spec(stmt, field, period_type, units, tag_pos, tag) AS (VALUES {_values(rows)}),
c AS (SELECT *, date_diff('day', start_date, end_date) AS duration_days FROM {{fx_contexts}}),
j AS (SELECT f.*, c.start_date, c.end_date, c.instant, c.is_consolidated, c.duration_days, {_VALUE} AS value FROM {{{facts}}} f JOIN c ON f.filing_id = c.filing_id AND f.context_ref = c.context_id),
r AS (SELECT DISTINCT filing_id, report_date FROM {{fx_filings}}),
w AS (SELECT c.* FROM c JOIN r ON c.filing_id = r.filing_id AND end_date = report_date WHERE duration_days > 0)"""


def _scored(days: str, annual: int) -> str:
    return f"""SELECT j.*, s.stmt, s.field, s.tag_pos,
  CASE WHEN is_consolidated THEN 100 ELSE 0 END
  + CASE WHEN period_type = 'duration' AND duration_days IS NOT NULL THEN CASE WHEN duration_days BETWEEN 300 AND 380 THEN {annual} ELSE -5 END ELSE 0 END
  + CASE WHEN regexp_matches(lower(unit_ref), units) THEN 10 ELSE 0 END + greatest(0, 5 - tag_pos) AS score
FROM j JOIN spec s ON j.tag = s.tag JOIN {days} d ON d.filing_id = j.filing_id
WHERE CASE period_type WHEN 'duration' THEN end_date = report_date AND start_date IS NOT NULL ELSE coalesce(instant = report_date, false) OR coalesce(end_date = report_date, false) END"""


def _by_tag(days: str, where: str) -> str:
    rows = f"(SELECT j.*, s.stmt, s.field, s.tag_pos FROM j JOIN spec s ON j.tag = s.tag AND {where} JOIN {days} d ON d.filing_id = j.filing_id WHERE coalesce(end_date, instant) = report_date)"
    return f"""SELECT filing_id, stmt, field, arg_min(value, tag_pos) AS value
FROM {_best(rows, 'filing_id, stmt, field, tag_pos', "is_consolidated DESC, contains(upper(unit_ref), 'USD') DESC, fact_seq")} z WHERE value IS NOT NULL GROUP BY ALL"""


US_DEBTS = ("debt_current", "debt_noncurrent", "debt_general")
US_HIDDEN = {("BS", f) for f in US_DEBTS} | {("CF", f) for f in ("minority_share", "effect_of_exchange_rates_on_cash", "net_income")}
_HEADER = "f.filing_id, f.symbol_raw AS symbol, CAST(f.company_key AS VARCHAR) AS company_id, CAST(f.filing_id AS VARCHAR) AS source_filing_id, f.form_type, f.report_date AS fiscal_year_end_date, f.filing_date, CAST(year(f.report_date) AS INT) AS fiscal_year"


#: The columns that no statement fills yet.
OPEN = "CAST(NULL AS VARCHAR) AS taxonomy_version, CAST(NULL AS VARCHAR) AS anomaly_type, CAST(NULL AS DOUBLE) AS anomaly_score, CAST(NULL AS VARCHAR) AS anomaly_detail, 1 AS unit_scale, 0 AS anomaly_flag"


def named_filings(s, d):
    """fx_filings with the identifiers that statements carry."""
    return view(s, d, "fx_filings").withColumns({"symbol": F.col("symbol_raw"), "company_id": F.col("company_key"), "source_filing_id": F.col("filing_id")})


def us_table(s, d):
    inputs = view(s, d, "fx_us_facts"), view(s, d, "fx_contexts"), named_filings(s, d)
    return xb.us_statement_table(*inputs, specs.fields(s), specs.EXCHANGE_LABELS)


_NORMAL = "trim(regexp_replace(lower(regexp_replace(tag, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_PICK = ", ".join(f"max(value) FILTER (stmt = '{s}' AND field = '{f}') AS {s}_{f}" for s, f, *_ in specs.US_FIELDS)
_US_WIDE = f"""{_ctes(specs.US_FIELDS, 'fx_us_facts')},
q AS ({_scored('r', 30)}), b AS {_best("(SELECT * FROM q WHERE stmt <> 'CF')", 'filing_id, stmt, field', 'score DESC, fact_seq')},
p AS (SELECT filing_id, start_date - INTERVAL 1 DAY AS report_date FROM {_best('w', 'filing_id', 'is_consolidated DESC, duration_days DESC, start_date DESC')} z),
l AS (SELECT j.*, {_NORMAL} AS label FROM j JOIN r ON r.filing_id = j.filing_id WHERE coalesce(end_date, instant) = report_date AND value IS NOT NULL),
a AS (SELECT l.*, CASE WHEN is_consolidated THEN 100 ELSE 0 END + CASE WHEN contains(upper(unit_ref), 'USD') THEN 20 ELSE 0 END + CASE WHEN starts_with(label, alias) THEN 10 ELSE 0 END AS score
      FROM l JOIN (VALUES {', '.join(f"('{x}')" for x in specs.EXCHANGE_LABELS)}) n(alias) ON contains(label, alias)),
v AS (SELECT filing_id, stmt, field, value, CASE WHEN value IS NOT NULL THEN tag END AS tag FROM b UNION ALL SELECT *, NULL FROM ({_by_tag('r', "s.stmt = 'CF'")})
      UNION ALL SELECT filing_id, 'CF', 'cash_beginning_of_period', value, NULL FROM ({_by_tag('p', "s.stmt = 'CF' AND s.field = 'cash_end_of_period'")})
      UNION ALL SELECT filing_id, 'CF', 'exchange_by_label', value, NULL FROM {_best('a', 'filing_id', 'score DESC, fact_seq')} z),
x AS (SELECT filing_id, {_PICK}, max(value) FILTER (field = 'cash_beginning_of_period') AS CF_cash_beginning_of_period, max(value) FILTER (field = 'exchange_by_label') AS label_effect,
      {', '.join(f"max(tag) FILTER (field = '{f}') AS {f}_tag" for f in (*US_DEBTS, 'commercial_paper_current'))} FROM v GROUP BY filing_id)"""
_US = f"""WITH {_US_WIDE}
SELECT {_HEADER}, {', '.join(f'{s}_{f}' for s, f, *_ in specs.US_FIELDS if (s, f) not in US_HIDDEN)},
  CF_net_income + coalesce(CF_minority_share, 0) AS CF_net_income, coalesce(CF_effect_of_exchange_rates_on_cash, label_effect) AS CF_effect_of_exchange_rates_on_cash, CF_cash_beginning_of_period,
  BS_debt_current AS BS_short_term_debt, coalesce(BS_debt_noncurrent, BS_debt_general) AS BS_long_term_debt,
  CASE WHEN coalesce(BS_debt_current, BS_debt_noncurrent, BS_debt_general) IS NOT NULL THEN coalesce(BS_debt_current, 0) + coalesce(BS_debt_noncurrent, BS_debt_general, 0) END AS BS_term_debt_total,
  debt_current_tag AS short_term_debt_source_tag, CASE WHEN BS_debt_noncurrent IS NOT NULL THEN debt_noncurrent_tag ELSE debt_general_tag END AS long_term_debt_source_tag,
  commercial_paper_current_tag AS commercial_paper_current_source_tag,
  CAST(BS_debt_current IS NULL AND coalesce(BS_debt_noncurrent, BS_debt_general) IS NOT NULL AS INT) AS term_debt_total_imputed_current_zero,
  CAST(BS_debt_current IS NOT NULL AND coalesce(BS_debt_noncurrent, BS_debt_general) IS NULL AS INT) AS term_debt_total_imputed_noncurrent_zero,
  CAST(BS_debt_noncurrent IS NULL AND BS_debt_general IS NOT NULL AS INT) AS term_debt_noncurrent_proxy_from_generic_long_term_tag,
  'US' AS country, 'FY' AS fiscal_period, 'US_GAAP' AS accounting_standard, 'CONSOLIDATED' AS statement_scope, 'USD' AS currency, {OPEN}, 0 AS is_amendment
FROM x JOIN {{fx_filings}} f ON f.filing_id = x.filing_id"""

JP_FLAT = [(s, f"{s}_{f}#{i}", ts, p, u) for s, f, choices, p, u in specs.JP_CHAINS for i, ts in enumerate(choices)]
JP_HIDDEN = {"IS_non_operating_income", "IS_non_operating_expenses", "CF_cash_beginning_of_period", "CF_cash_end_of_period", "CF_cash_at_date"}
JP_NAMES = [f"{s}_{f}" for s, f, *_ in specs.JP_CHAINS]


def jp_table(s, d):
    filings = named_filings(s, d).withColumn("is_amendment", F.endswith("form_type", F.lit("/A")))
    return xb.jp_statement_table(view(s, d, "fx_jp_facts"), view(s, d, "fx_contexts"), filings, *specs.chain_specs(s))


def _chained(days: str, where: str = "true") -> str:
    rows = f"(SELECT * FROM ({_scored(days, 20)}) q WHERE value IS NOT NULL AND {where})"
    return f"SELECT filing_id, string_split(field, '#')[1] AS field, arg_min(value, CAST(string_split(field, '#')[2] AS INT)) AS value FROM {_best(rows, 'filing_id, stmt, field', 'score DESC, fact_seq')} z GROUP BY ALL"


_JP = f"""WITH {_ctes(JP_FLAT, 'fx_jp_facts')},
p AS (SELECT filing_id, start_date - INTERVAL 1 DAY AS report_date FROM {_best('w', 'filing_id', 'duration_days DESC, start_date DESC')} z),
v AS ({_chained('r')} UNION ALL SELECT filing_id, 'CF_cash_at_prior_end', value FROM ({_chained('p', "field = 'CF_cash_at_date#0'")})),
x AS (SELECT filing_id, {', '.join(f"max(value) FILTER (field = '{n}') AS {n}" for n in [*JP_NAMES, 'CF_cash_at_prior_end'])} FROM v GROUP BY filing_id)
SELECT {_HEADER}, CAST(f.form_type = '10-K/A' AS INT) AS is_amendment, {', '.join(n for n in JP_NAMES if n not in JP_HIDDEN)},
  {', '.join(f'{a} AS {b}' for b, a in xb.OTHERS_JP.items())},
  IS_non_operating_income - IS_non_operating_expenses AS IS_non_operating_income_expense_net,
  coalesce(CF_cash_beginning_of_period, CF_cash_at_prior_end, coalesce(CF_cash_end_of_period, CF_cash_at_date) - CF_net_change_in_cash) AS CF_cash_beginning_of_period,
  coalesce(CF_cash_end_of_period, CF_cash_at_date) AS CF_cash_end_of_period,
  'JP' AS country, 'FY' AS fiscal_period, 'JP_GAAP' AS accounting_standard, 'CONSOLIDATED' AS statement_scope, 'JPY' AS currency, {OPEN}
FROM x JOIN {{fx_filings}} f ON f.filing_id = x.filing_id"""


CHECKED = [(s, f) for s, fs in specs.CHECKED_FIELDS.items() for f in fs]


def checklist(s, d):
    runs = view(s, d, "fx_filings").select("filing_id", "market", F.when(F.col("company_key") % 6 == 0, "check_failed").otherwise("success").alias("status"))
    return ev.checklist(us_table(s, d), runs, {f"{s_}.{f}": (s_, f"{s_}_{f}") for s_, f in CHECKED}, ("fiscal_year_end_date", "filing_date", "form_type"))


_CHECKLIST = f"""WITH t AS ({_US}), g AS (SELECT filing_id, market FROM {{fx_filings}} WHERE company_key % 6 <> 0)
SELECT g.filing_id, g.market, fiscal_year_end_date, filing_date, form_type, i.statement, i.field_name, i.extracted_value
FROM g JOIN (SELECT filing_id, fiscal_year_end_date, filing_date, form_type, unnest([{', '.join(f"{{'statement': '{s}', 'field_name': '{f}', 'extracted_value': {s}_{f}}}" for s, f in CHECKED)}]) AS i FROM t) k ON k.filing_id = g.filing_id"""


# --- market rules ---------------------------------------------------------------------------------------------------
def _index(s, d):
    return view(s, d, "fx_filings").withColumn("seq", F.pmod(F.col("filing_id") * 7919, F.lit(10007)))


_INDEX = "g AS (SELECT *, filing_id * 7919 % 10007 AS seq FROM {fx_filings})"


def _pick(source: str, keys: str, order: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) z WHERE rn = 1"


def t6_jp(s, d):
    parts = ["XBRL/PublicDoc/jpcrp030000-asr-001_E0.xbrl", "XBRL/AuditDoc/jpaud-aar-cn-001.xbrl", "XBRL/PublicDoc/jpcrp-long-name-0001.xbrl", "XBRL/PublicDoc/manifest.xml", "other.XBRL"]
    name = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "S1/").otherwise(""), F.element_at(F.array(*map(F.lit, parts)), (F.col("l_partkey") % 5 + 1).cast("int")))
    rows = view(s, d, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("seq"), name.alias("name"))
    return fl.instance_file_jp(rows.groupBy("filing_id", "seq").agg(F.max("name").alias("name"))).select("filing_id", "name")


_T6_JP = """WITH n AS (SELECT l_orderkey AS filing_id, l_linenumber AS seq, max(CASE WHEN l_orderkey % 2 = 0 THEN 'S1/' ELSE '' END
  || ['XBRL/PublicDoc/jpcrp030000-asr-001_E0.xbrl', 'XBRL/AuditDoc/jpaud-aar-cn-001.xbrl', 'XBRL/PublicDoc/jpcrp-long-name-0001.xbrl', 'XBRL/PublicDoc/manifest.xml', 'other.XBRL'][l_partkey % 5 + 1]) AS name FROM {lineitem} GROUP BY 1, 2)
""" + _pick("(SELECT * FROM n WHERE suffix(lower(name), '.xbrl'))", "filing_id", "NOT contains(name, 'XBRL/PublicDoc/'), NOT contains(lower(name), '-asr-'), length(name), lower(name), seq", "filing_id, name")


def p2_hints(s, d):
    key = F.col("c_custkey")
    docs = view(s, d, "orders").select(
        F.col("o_orderkey").alias("docID"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("sec_code"),
        F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("E"), F.col("o_orderkey") % 3)).alias("edinetCode"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("株式会社"), F.col("o_orderkey") % 2, F.lit("製作所"))).alias("filerName"),
    )
    companies = view(s, d, "customer").select(
        F.lpad(key.cast("string"), 6, "0").alias("symbol"), F.when(key % 2 == 0, F.concat(F.lit("E"), key % 3)).alias("edinet_code"),
        F.when(key % 3 == 0, "1製作").otherwise("").alias("company_name"),
    )
    return fl.filings_of_companies(docs, companies).select("docID", "symbol")


_P2 = """SELECT o_orderkey AS docID, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol FROM {orders} JOIN {customer} ON c_custkey = o_custkey
WHERE (c_custkey % 2 <> 0 OR (o_orderkey % 4 > 0 AND o_orderkey % 3 = c_custkey % 3)) AND (c_custkey % 3 <> 0 OR o_orderkey % 5 = 0 OR o_orderkey % 2 = 1)"""


# --- tables and pages -----------------------------------------------------------------------------------------------
def _grids(s, d):
    """One table a part: giant rows, headers with repeated names, headers without the anchor, empty rows and columns."""
    key = F.col("p_partkey")
    kind = key % 4
    lines = lambda stem: F.array_join(F.transform(F.sequence(F.lit(1), (10 + key % 5).cast("int")), lambda i: F.concat(F.lit(stem), i)), "\n")
    head = F.array(F.when(kind == 2, "甲").otherwise(" 项 目 "), F.lit("本期"), F.when(kind == 1, "").otherwise("本期"), F.lit(" "))
    giant = F.array(lines("科"), lines("1"), F.lit("x"), F.lit(""))
    plain = F.array(F.col("p_name"), F.col("p_size").cast("string"), F.when(kind == 1, "").otherwise("7"), F.lit(" "))
    rows = F.when(kind == 0, F.array(head, giant)).otherwise(F.array(head, plain, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.lit("  ")), plain))
    cells = view(s, d, "part").select(key.alias("table_id"), F.posexplode(rows).alias("r", "row")).select("table_id", (F.col("r") + 1).alias("row_no"), F.posexplode("row").alias("col_no", "text"))
    return cells


def p12(s, d):
    return tb.clean_tables(_grids(s, d)).select("table_id", "row_no", "col_no", "name", F.col("text"))


_P12 = """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_name, CAST(p_size AS VARCHAR) AS sz, 10 + p_partkey % 5 AS n FROM {part}),
g AS (SELECT k, CAST(unnest(range(1, n + 1)) AS INT) AS i, n FROM p WHERE kind = 0),
cells AS (
  SELECT k AS table_id, 1 + i AS row_no, c.col_no, c.name, CASE c.col_no WHEN 0 THEN '科' || i WHEN 1 THEN '1' || i ELSE CASE WHEN i = 1 THEN 'x' END END AS text
  FROM g CROSS JOIN (VALUES (0, '项 目'), (1, '本期'), (2, '本期_1')) c(col_no, name) WHERE n >= 12
  UNION ALL
  SELECT k, 2, c.col_no, c.name, CASE c.col_no WHEN 0 THEN array_to_string([('科' || x) FOR x IN range(1, n + 1)], chr(10)) WHEN 1 THEN array_to_string([('1' || x) FOR x IN range(1, n + 1)], chr(10)) ELSE 'x' END
  FROM p CROSS JOIN (VALUES (0, '项 目'), (1, '本期'), (2, '本期_1')) c(col_no, name) WHERE kind = 0 AND n < 12
  UNION ALL
  SELECT k, r.row_no, c.col_no, CASE WHEN kind = 2 THEN 'col_' || c.col_no ELSE [ '项 目', '本期', '本期_1'][c.col_no + 1] END,
         CASE WHEN r.row_no = 1 THEN ['甲', '本期', '本期'][c.col_no + 1] ELSE CASE c.col_no WHEN 0 THEN p_name WHEN 1 THEN sz ELSE '7' END END
  FROM p CROSS JOIN (VALUES (1), (2), (4)) r(row_no) CROSS JOIN (VALUES (0), (1), (2)) c(col_no) WHERE kind > 0 AND (kind = 2 OR r.row_no > 1) AND (kind <> 1 OR c.col_no < 2))
SELECT table_id, CAST(row_no AS INT) AS row_no, CAST(col_no AS INT) AS col_no, name, text FROM cells"""


def _balance(s, d):
    """Balance sheets with two to four amount columns whose headers give dates and scopes in turn."""
    key = F.col("p_partkey")
    heads = ["2023年12月31日 合并", "2022年12月31日 合并", "2023年12月31日 公司", "2023年12月31日"]
    turned = lambda i: F.element_at(F.array(*map(F.lit, heads)), (F.pmod(key + i, F.lit(4)) + 1).cast("int"))
    row = lambda *xs: F.array(*xs)
    rows = F.array(row(F.lit("项目"), *(turned(i) for i in range(3))), *(row(F.col("p_name"), *(F.format_number(F.col("p_retailprice") * i, 2) for i in (1, 2, 3))) for _ in range(7)))
    return view(s, d, "part").select(key.alias("table_id"), F.posexplode(rows).alias("r", "row")).select("table_id", (F.col("r") + 1).alias("row_no"), F.posexplode("row").alias("col_no", "text"))


_W17_BS = """WITH h AS (SELECT p_partkey AS table_id, i + 1 AS col_no, (p_partkey + i) % 4 AS h FROM {part} CROSS JOIN (VALUES (0), (1), (2)) c(i)),
x AS (SELECT *, CASE WHEN h = 1 THEN DATE '2022-12-31' ELSE DATE '2023-12-31' END AS day, [2, 2, 0, 1][h + 1] AS scope FROM h)
""" + _pick("x", "table_id", "day DESC, scope DESC, col_no", "table_id, CAST(col_no AS INT) AS col_no, day, CAST(scope AS INT) AS scope")


def c10_eps(s, d):
    key = F.col("p_partkey")
    texts = lambda i: F.element_at(F.array(F.lit("0.35"), F.lit("不适用"), F.lit(""), F.lit("abc"), F.lit("(1.20)")), (F.pmod(key * (i + 2) + i, F.lit(5)) + 1).cast("int"))
    label = F.when(key % 3 == 0, "稀释每股收益").otherwise("基本每股收益")
    cells = view(s, d, "part").select(key.alias("table_id"), F.lit(1).alias("row_no"), F.posexplode(F.array(label, *(texts(i) for i in range(2)))).alias("col_no", "text"))
    columns = view(s, d, "part").select(key.alias("table_id"), F.explode(F.array(*(F.struct(F.lit(c).alias("col_no"), F.when(key % 2 == 0, c).otherwise(3 - c).alias("priority")) for c in (1, 2)))).alias("x")).select("table_id", "x.*")
    matches = s.createDataFrame([("基本每股收益", "BASICEPS"), ("稀释每股收益", "DILUTEDEPS")], "raw_item string, item_code string")
    return tb.eps_items(cells, columns, matches, ["BASICEPS", "DILUTEDEPS"]).select("table_id", "item_code", "value", "status", "fixup_reason")


_C10 = """WITH t AS (SELECT p_partkey AS k, ['0.35', '不适用', '', 'abc', '(1.20)'][p_partkey * 2 % 5 + 1] AS a, ['0.35', '不适用', '', 'abc', '(1.20)'][(p_partkey * 3 + 1) % 5 + 1] AS b FROM {part}),
o AS (SELECT k, CASE WHEN k % 2 = 0 THEN a ELSE b END AS a, CASE WHEN k % 2 = 0 THEN b ELSE a END AS b FROM t),
v AS (SELECT *, CASE a WHEN '0.35' THEN 0.35 WHEN '(1.20)' THEN -1.2 END::DOUBLE AS x, CASE b WHEN '0.35' THEN 0.35 WHEN '(1.20)' THEN -1.2 END::DOUBLE AS y FROM o)
SELECT k AS table_id, CASE WHEN k % 3 = 0 THEN 'DILUTEDEPS' ELSE 'BASICEPS' END AS item_code, coalesce(x, y) AS value,
  CASE WHEN coalesce(x, y) IS NOT NULL THEN 'OK' WHEN a = '不适用' OR b = '不适用' THEN 'NOT_APPLICABLE' ELSE 'PARSE_ERROR' END AS status,
  CASE WHEN x IS NULL AND y IS NOT NULL THEN 'COLUMN_ROLE_SWAP' END AS fixup_reason
FROM v WHERE coalesce(x, y) IS NOT NULL OR a <> '' OR b <> ''"""


def _statement_pages(s, d):
    """Documents of twelve pages made of orders: titles, table words, parent-only statements and plain text in turn."""
    texts = ["合并资产负债表 流动资产 合计", "流动资产 非流动资产", "附注", "资产负债表 流动资产", "合并资产负债表", "目录"]
    page = view(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page_no")).distinct()
    return page.select("doc_id", "page_no", F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.col("doc_id") * 5 + F.floor(F.col("page_no") * (F.col("doc_id") % 7 + 1) / 3), F.lit(6)) + 1).cast("int")).alias("text"))


_SP = """sp AS (SELECT doc_id, page_no, ['合并资产负债表 流动资产 合计', '流动资产 非流动资产', '附注', '资产负债表 流动资产', '合并资产负债表', '目录'][(doc_id * 5 + page_no * (doc_id % 7 + 1) // 3) % 6 + 1] AS text
FROM (SELECT DISTINCT o_custkey AS doc_id FROM {orders}) CROSS JOIN range(1, 13) r(page_no)),
kw AS (SELECT *, len(regexp_extract_all(text, '流动资产|合计')) AS kw FROM sp), nx AS (SELECT *, coalesce(lead(kw) OVER (PARTITION BY doc_id ORDER BY page_no), 0) AS nx FROM kw),
st AS (SELECT doc_id, page_no AS start_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kw + nx * 0.5 DESC, page_no) AS rn FROM nx WHERE contains(text, '合并资产负债表') AND kw + nx * 0.5 + 1 >= 2) WHERE rn = 1),
fr AS (SELECT st.doc_id, start_page, coalesce(min(page_no) FILTER (NOT ((kw > 0 OR contains(text, '合并资产负债表')) AND NOT (contains(text, '资产负债表') AND NOT contains(text, '合并资产负债表')))) - 1, max(page_no), start_page) AS end_page
       FROM st LEFT JOIN kw ON kw.doc_id = st.doc_id AND page_no BETWEEN start_page + 1 AND start_page + 7 GROUP BY 1, 2)"""
_BS_TITLE = ("合并资产负债表", "流动资产|合计", "资产负债表", "合并资产负债表")


def _ranges(s, d):
    return pg.fallback_ranges(_statement_pages(s, d), *_BS_TITLE)


def v11(s, d):
    pages = _statement_pages(s, d)
    docs = pages.select("doc_id").distinct()
    located = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("BS").alias("stmt"), (F.col("doc_id") % 3 + 1).alias("start_page"), (F.col("doc_id") % 5 + 1).alias("end_page")), F.struct(F.lit("IS").alias("stmt"), F.lit(2).alias("start_page"), (F.col("doc_id") % 14).cast("int").alias("end_page")))).alias("x")).select("doc_id", "x.*")
    fallback = _ranges(s, d).select("doc_id", F.lit("BS").alias("stmt"), "start_page", "end_page")
    return pg.trusted_ranges(pages, located, {"BS": "合并资产负债表", "IS": "流动资产|附注"}, fallback).select("doc_id", "stmt", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), "source")


_V11 = f"""WITH {_SP}, lo AS (SELECT DISTINCT doc_id, 'BS' AS stmt, doc_id % 3 + 1 AS start_page, doc_id % 5 + 1 AS end_page FROM sp UNION ALL SELECT DISTINCT doc_id, 'IS', 2, doc_id % 14 FROM sp),
ok AS (SELECT lo.doc_id FROM lo LEFT JOIN sp ON sp.doc_id = lo.doc_id AND sp.page_no = lo.start_page GROUP BY 1
  HAVING count(DISTINCT (start_page, end_page)) > 1 AND bool_and(start_page >= 1 AND end_page <= 12 AND end_page >= start_page AND CASE stmt WHEN 'BS' THEN contains(text, '合并资产负债表') ELSE contains(text, '流动资产') OR contains(text, '附注') END))
SELECT doc_id, stmt, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page, 'locator' AS source FROM lo WHERE doc_id IN (SELECT doc_id FROM ok)
UNION ALL SELECT doc_id, 'BS', start_page, end_page, 'fallback' FROM fr WHERE doc_id NOT IN (SELECT doc_id FROM ok)"""


def f10(s, d):
    key = F.col("o_orderkey")
    texts = ["单位：元", "单位: 人民币 千元", "（单位：万元）", "附注", "单位：百万元 币种", "单位 亿元"]
    line = F.element_at(F.array(*map(F.lit, texts)), (key * 7 % 6 + 1).cast("int"))
    lines = view(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), (key % 60 + 1).alias("page_no"), key.alias("line_no"), line.alias("line"))
    ranges = lines.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 40 + 1).alias("start_page"))
    return ln.document_units(lines, ranges)


_F10 = """WITH l AS (SELECT o_custkey AS doc_id, o_orderkey % 60 + 1 AS page_no, o_orderkey AS line_no, ['人民币元', '人民币千元', '人民币万元', NULL, '人民币百万元', '人民币亿元'][o_orderkey * 7 % 6 + 1] AS unit FROM {orders}),
n AS (SELECT *, unit IS NOT NULL AND CASE WHEN doc_id % 2 = 0 THEN page_no IN (doc_id % 40 + 1, doc_id % 40 + 2) ELSE page_no <= 30 END AS hit FROM l)
SELECT doc_id, coalesce(arg_min(unit, (page_no, line_no)) FILTER (hit), '人民币元') AS unit FROM n GROUP BY 1"""


# --- figures, formats, cases ----------------------------------------------------------------------------------------
def w14_mismatch(s, d):
    rows = view(s, d, "orders").groupBy(F.col("o_custkey").alias("filing_id")).agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    one = F.explode(F.array(*(F.struct(F.lit(st).alias("stmt"), F.lit(f).alias("field"), v.alias("value")) for st, f, v in (("IS", "net_income", F.col("a")), ("CF", "net_income", F.when(F.col("filing_id") % 3 > 0, F.col("b"))), ("IS", "total_revenue", F.col("a"))))))
    rows = rows.select("filing_id", one.alias("x")).select("filing_id", "x.*").withColumns({"candidate_rank": F.lit(1), "score": F.lit(100), "tag_priority": F.lit(5), "is_consolidated": F.lit(True), "aligned": F.lit(True), "unit_match": F.lit(True)})
    return vf.low_confidence(rows)


_W14 = """WITH g AS (SELECT o_custkey AS filing_id, min(o_totalprice) AS a, CASE WHEN o_custkey % 3 > 0 THEN max(o_totalprice) END AS b FROM {orders} GROUP BY 1)
SELECT filing_id, 'IS' AS stmt, 'net_income' AS field, CASE WHEN a <> b THEN 'net_income_mismatch' END AS reason FROM g
UNION ALL SELECT filing_id, 'CF', 'net_income', CASE WHEN b IS NULL THEN 'missing' WHEN a <> b THEN 'net_income_mismatch' END FROM g UNION ALL SELECT filing_id, 'IS', 'total_revenue', NULL FROM g"""


def f28(s, d):
    k = F.col("event_id")
    shape = (
        F.when(k % 4 == 0, F.to_json(F.struct(F.struct(k.alias("prompt_tokens"), (k % 7).alias("completion_tokens"), (k + 100).alias("total_tokens")).alias("usage"))))
        .when(k % 4 == 1, F.to_json(F.struct(F.struct(k.alias("input_tokens"), (k % 5).alias("output_tokens")).alias("usage"))))
        .when(k % 4 == 2, F.to_json(F.struct(F.struct(k.alias("prompt_tokens")).alias("usage")))).otherwise('{"id": 1}')
    )
    return view(s, d, "events").select("event_id", sc.token_usage(shape).alias("u")).select("event_id", "u.*")


_F28 = """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id END AS prompt_tokens, CASE event_id % 4 WHEN 0 THEN event_id % 7 WHEN 1 THEN event_id % 5 END AS completion_tokens,
CASE event_id % 4 WHEN 0 THEN event_id + 100 WHEN 1 THEN event_id + event_id % 5 WHEN 2 THEN event_id END AS total_tokens FROM {events}"""


def f18(s, d):
    x = F.when(F.col("o_orderkey") % 11 > 0, F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, -1.0).otherwise(1.0) * F.element_at(F.array(F.lit(0.0625), F.lit(1.0), F.lit(1e4), F.lit(0.0)), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return view(s, d, "orders").select("o_orderkey", sc.raw_currency(x, "$").alias("raw"), sc.plain_number(x).alias("number"), sc.millions(x).alias("millions"))


_F18 = """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN floor(o_totalprice) * CASE WHEN o_orderkey % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE * [0.0625, 1.0, 1e4, 0.0][o_orderkey % 4 + 1]::DOUBLE END + 0.0 AS x FROM {orders})
SELECT o_orderkey, coalesce('$' || format('{:,}', CAST(round_even(x, 0) AS BIGINT)), 'N/A') AS raw,
  CASE WHEN x IS NULL THEN 'N/A' WHEN abs(x) >= 1000 THEN format('{:,}', CAST(round_even(x, 0) AS BIGINT)) ELSE regexp_replace(format('{:,.4f}', x), '\\.?0+$', '') END AS number,
  CASE WHEN x IS NULL THEN 'N/A' WHEN abs(x) >= 1e9 THEN '$' || format('{:.2f}', x / 1e9) || 'B' ELSE '$' || format('{:.2f}', x / 1e6) || 'M' END AS millions FROM x"""


def c8(s, d):
    rows = view(s, d, "orders").select(F.col("o_orderkey").alias("filing_id"), F.when(F.col("o_orderkey") % 3 > 0, F.floor("o_totalprice") * 1e6).alias("net_income"), F.when(F.col("o_orderkey") % 5 > 0, F.floor("o_totalprice") * 1e3).alias("eps"))
    statuses = view(s, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("filing_id"), F.lit("每股收益").alias("label"), F.lit("NOT_APPLICABLE").alias("status"))
    out = cn.readable_report(rows, {"net_income": "净利润", "eps": "每股收益"}, "¥", "CNY", statuses)
    return out.withColumn("ordinal", F.col("ordinal").cast("int"))


_AMOUNT = """CASE WHEN abs(x) >= 1e12 THEN format('¥{:.2f}T', x / 1e12) WHEN abs(x) >= 1e9 THEN format('¥{:.2f}B', x / 1e9)
  WHEN abs(x) >= 1e6 THEN format('¥{:.2f}M', x / 1e6) ELSE format('¥{:,.2f}', x) END"""
_C8 = f"""WITH r AS (SELECT o_orderkey AS filing_id, 0 AS ordinal, '净利润' AS label, CASE WHEN o_orderkey % 3 > 0 THEN floor(o_totalprice) * 1e6 END AS x FROM {{orders}}
UNION ALL SELECT o_orderkey, 1, '每股收益', CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice) * 1e3 END FROM {{orders}})
SELECT filing_id, ordinal, label, CASE WHEN x IS NULL AND ordinal = 1 AND filing_id % 2 = 0 THEN 'Not applicable' WHEN x IS NULL THEN 'N/A' ELSE {_AMOUNT} END AS text,
CASE WHEN x IS NULL AND ordinal = 1 AND filing_id % 2 = 0 THEN 'Not applicable' WHEN x IS NULL THEN 'N/A' ELSE '¥' || format('{{:,}}', CAST(x AS BIGINT)) END AS raw_text, 'CNY' AS unit FROM r"""


def c5_eps(s, d):
    key = F.col("p_partkey")
    values = view(s, d, "part").filter(key % 3 > 0).select(key.alias("filing_id"), F.when(key % 2 == 0, "BASICEPS").otherwise("DILUTEDEPS").alias("item_code"), F.when(key % 5 > 0, F.col("p_size") / 4).alias("value"))
    statuses = view(s, d, "part").filter(key % 4 > 0).select(key.alias("filing_id"), F.when(key % 7 < 4, "BASICEPS").otherwise("DILUTEDEPS").alias("item_code"), F.when(key % 4 == 1, "NOT_APPLICABLE").otherwise("").alias("by_line"), F.when(key % 4 == 2, "PARSE_ERROR").alias("by_item"))
    return cn.eps_rows(values, statuses)


_C5 = """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 > 0 THEN p_size / 4.0 END::DOUBLE AS v, CASE WHEN p_partkey % 4 = 1 THEN 'NOT_APPLICABLE' WHEN p_partkey % 4 = 2 THEN 'PARSE_ERROR' ELSE 'MISSING' END AS t FROM {part} WHERE p_partkey % 3 > 0),
w AS (SELECT *, CASE WHEN k % 2 = 0 THEN v END AS b, CASE WHEN k % 2 = 1 THEN v END AS l FROM p)
SELECT k AS filing_id, b AS net_income_per_share_basic, CASE WHEN b IS NOT NULL THEN 'OK' WHEN k % 7 < 4 THEN t ELSE 'MISSING' END AS net_income_per_share_basic_status,
l AS net_income_per_share_diluted, CASE WHEN l IS NOT NULL THEN 'OK' WHEN k % 7 >= 4 THEN t ELSE 'MISSING' END AS net_income_per_share_diluted_status FROM w"""


def c7(s, d):
    t = us_table(s, d)
    return cn.debt_to_equity(t.select("filing_id", F.col("BS_total_liabilities").alias("total_liabilities"), F.col("BS_total_shareholders_equity").alias("total_shareholders_equity")))


def v3(s, d):
    rows = view(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("IS").alias("stmt"), F.lit("net_income").alias("field"), "o_orderkey", "o_totalprice")
    cases = rows.groupBy("doc_id", "stmt", "field").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("rank"), F.concat(F.lit("C"), "o_orderkey").alias("item_code")))).alias("candidates"))
    return vf.request_payload(cases.withColumns({"rule_value": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), "rule_status": F.lit("OK")}))


_V3 = """SELECT o_custkey AS doc_id, 'IS' AS stmt, 'net_income' AS field, '{"stmt":"IS","field":"net_income",' || CASE WHEN o_custkey % 2 = 0 THEN '"rule_value":' || o_custkey || ',' ELSE '' END || '"rule_status":"OK","candidates":[' ||
string_agg('{"rank":' || o_orderkey || ',"item_code":"C' || o_orderkey || '"}', ',' ORDER BY o_orderkey) || ']}' AS payload FROM {orders} GROUP BY o_custkey"""


def a8_headers(s, d):
    words = ["项目", "附注", "期末余额", "期初余额", "金额", "甲"]
    text = lambda i: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.col("l_partkey") * (i + 1) + i, F.lit(6)) + 1).cast("int"))
    heads = view(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.ceil(F.col("l_linenumber") / 2)).alias("table_id"), F.concat(text(0), F.lit(" "), text(1)).alias("header"))
    return an.header_abnormal(heads)


def _distinct_hits() -> str:
    """Hits of a header of two words: the expected words that either holds."""
    words = ["项目", "附注", "期末余额", "期初余额", "金额", "甲"]
    both = [[sum(w in f"{a} {b}" for w in an.HEADER_WORDS) for b in words] for a in words]
    return "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in both) + "]"


_A8 = f"SELECT l_orderkey * 10 + CAST(ceil(l_linenumber / 2) AS BIGINT) AS table_id, CAST(sum({_distinct_hits()}[l_partkey % 6 + 1][(l_partkey * 2 + 1) % 6 + 1]) AS BIGINT) AS hits, sum({_distinct_hits()}[l_partkey % 6 + 1][(l_partkey * 2 + 1) % 6 + 1]) < 2 AS header_abnormal FROM {{lineitem}} GROUP BY 1"


def f1(s, d):
    texts = ["1. 收入", "一、 1.收入", "1、收入", "其中 ：存货", "（一）货币 资金：", "一年内到期的非流动负债", "加：营业外收入", " 二. 负债合计", "减:所得税", "12应付账款"]
    return view(s, d, "part").select("p_partkey", sc.clean_item_name(F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 10 + 1).cast("int")), F.lit(" "), F.col("p_size").cast("string"))).alias("clean"))


_F1 = "SELECT p_partkey, ['.收入', '1.收入', '、收入', '其中存货', '货币资金', '年内到期的非流动负债', '营业外收入', '负债合计', '所得税', '应付账款'][p_partkey % 10 + 1] || p_size AS clean FROM {part}"

# --- files out and in ------------------------------------------------------------------------------------------------
def s7(s, d):
    """The fact pool, written and read back as candidates."""
    path = scratch_path(s)
    top = xb.top_facts(_small(s, d), 3).select("filing_id", "stmt", "field", "candidate_rank", "score", "tag", "value_raw", "unit_ref", "context_ref")
    top.write.parquet(path)
    return st.read_candidates(s, path).select("filing_id", "stmt", "field", "candidate_rank", "raw_text")


def _small(s, d):
    return xb.scored_facts(*_inputs(s, d))


_S7 = f"""WITH {_xbrl_ctes()}, d AS {_best('q', 'filing_id, stmt, field, tag, context_ref, value', 'fact_seq')}, k AS (SELECT *, row_number() OVER (PARTITION BY filing_id, stmt, field ORDER BY score DESC, fact_seq) AS rk FROM d)
SELECT filing_id, stmt, field, CAST(rk AS INT) AS candidate_rank, concat_ws(' ', tag, value_raw, unit_ref, context_ref) AS raw_text FROM k WHERE rk <= 3"""


def s8(s, d):
    """The US statement table, written by market and year and read back."""
    path = scratch_path(s)
    st.write_statements(us_table(s, d).withColumn("market", F.lit("us")), path)
    return s.read.parquet(path).select("filing_id", F.col("market").cast("string").alias("market"), F.col("fiscal_year").cast("int").alias("fiscal_year"), "BS_total_assets", "IS_net_income")


_S8 = f"WITH {_US_WIDE} SELECT f.filing_id, 'us' AS market, CAST(year(f.report_date) AS INT) AS fiscal_year, BS_total_assets, IS_net_income FROM x JOIN {{fx_filings}} f ON f.filing_id = x.filing_id"


def s9(s, d):
    """A report of filings by market and form, written as one file and read back."""
    path = scratch_path(s)
    rows = view(s, d, "fx_filings").groupBy("market", "form_type").agg(F.count("*").alias("n"), F.max("filing_date").alias("latest"))
    st.write_report(rows, path)
    return s.read.schema("market string, form_type string, n long, latest date").option("header", True).csv(path)


def s10(s, d):
    """Sections with their items and lacking anchors as nested documents, written and read back."""
    path = scratch_path(s)
    words = view(s, d, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.struct(F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("value")).alias("item"))
    rows = words.groupBy("section_id").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumn("report", F.struct((F.size("items") < 3).alias("is_anomaly"), F.size("items").alias("n_items")))
    st.write_anomalies(rows, path)
    back = s.read.schema("section_id long, items array<struct<seq: long, value: double>>, report struct<is_anomaly: boolean, n_items: int>").json(path)
    return back.select("section_id", "report.is_anomaly", "report.n_items", F.aggregate("items", F.lit(0.0), lambda a, x: a + x["value"]).alias("total"))


QUERIES = {
    "s7_read_candidates": (s7, _S7),
    "s8_write_statements": (s8, _S8),
    "s9_write_report_csv": (s9, "SELECT market, form_type, count(*) AS n, max(filing_date) AS latest FROM {fx_filings} GROUP BY 1, 2"),
    "s10_write_anomaly_json": (s10, "SELECT l_orderkey AS section_id, count(*) < 3 AS is_anomaly, CAST(count(*) AS INT) AS n_items, CAST(sum(l_quantity) AS DOUBLE) AS total FROM {lineitem} GROUP BY 1"),
    "c1_us_statement_table": (us_table, _US),
    "c4_jp_statement_table": (jp_table, _JP),
    "c11_checklist_of_18_fields": (checklist, _CHECKLIST),
    "t2_us_first_in_index": (lambda s, d: fl.first_filings(_index(s, d)).select("company_key", "filing_id"), f"WITH {_INDEX} " + _pick("g", "company_key", "seq", "company_key, filing_id")),
    "t2_us_exact_report_date": (
        lambda s, d: fl.first_filings(_index(s, d), "1995-12-31").select("company_key", "filing_id"),
        f"WITH {_INDEX} " + _pick("(SELECT * FROM g WHERE report_date = DATE '1995-12-31')", "company_key", "seq", "company_key, filing_id"),
    ),
    "t2_jp_latest_in_window": (
        lambda s, d: fl.latest_in_window(_index(s, d), "1997-06-30").select("company_key", "filing_id", "filing_date"),
        f"WITH {_INDEX} " + _pick("(SELECT * FROM g WHERE filing_date BETWEEN DATE '1997-06-30' - INTERVAL 400 DAY AND DATE '1997-06-30')", "company_key", "filing_date DESC, seq", "company_key, filing_id, filing_date"),
    ),
    "t6_instance_file_pick_jp": (t6_jp, _T6_JP),
    "p2_company_hints_jp": (p2_hints, _P2),
    "p12_clean_tables": (p12, _P12),
    "w17_balance_column": (lambda s, d: tb.balance_columns(_balance(s, d)).select("table_id", F.col("col_no").cast("int").alias("col_no"), "day", "scope"), _W17_BS),
    "c10_eps_column_swap": (c10_eps, _C10),
    "w15_fallback_ranges": (_ranges, f"WITH {_SP} SELECT doc_id, start_page, end_page FROM fr"),
    "v11_trusted_ranges": (v11, _V11),
    "f10_document_units": (f10, _F10),
    "w14_net_income_mismatch": (w14_mismatch, _W14),
    "f28_token_usage_shapes": (f28, _F28),
    "f27_coerce_date": (
        lambda s, d: view(s, d, "orders").select("o_orderkey", sc.coerce_date(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 10:11:12"))).when(F.col("o_orderkey") % 3 == 1, "NaT").otherwise(F.col("o_orderdate").cast("date").cast("string"))).alias("day")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM {orders}",
    ),
    "f18_raw_and_million_formats": (f18, _F18),
    "c8_readable_report_texts": (c8, _C8),
    "c5_eps_status_chain": (c5_eps, _C5),
    "c7_debt_to_equity": (c7, f"WITH {_US_WIDE} SELECT filing_id, BS_total_liabilities / nullif(BS_total_shareholders_equity, 0) AS debt_to_equity FROM x WHERE filing_id IN (SELECT filing_id FROM {{fx_filings}})"),
    "v3_request_payload": (v3, _V3),
    "a8_header_abnormal": (a8_headers, _A8),
    "f1_clean_item_name_cases": (f1, _F1),
}
ORACLES = {k: oracle(v[1]) for k, v in QUERIES.items() if v[1]}
QUERIES = {k: v[0] for k, v in QUERIES.items()}
