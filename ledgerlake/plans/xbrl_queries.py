"""Registered queries of the fact and filing operators with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filings as fl
from ..operators import xbrl as xb
from . import specs
from .fixtures import oracle, view

#: Specs over the fixture tags; the SQL below has the same rows.
ROWS = [
    ("IS", "net_income", ["NetIncomeLoss", "ProfitLoss"], "duration", ["usd"]),
    ("BS", "total_assets", ["Assets"], "instant", ["usd"]),
    ("BS", "total_liabilities", ["Liabilities"], "instant", ["usd/shares"]),
    ("CF", "net_cash_operating", ["NetCashProvidedByUsedInOperatingActivities"], "duration", ["usd"]),
    ("CF", "net_cash_investing", ["NetCashProvidedByUsedInInvestingActivities"], "duration", ["eur"]),
]
_SPEC = "spec(stmt, field, period_type, unit, tag_pos, tag) AS (VALUES " + ", ".join(f"('{s}', '{f}', '{p}', '{u[0]}', {i}, '{t}')" for s, f, ts, p, u in ROWS for i, t in enumerate(ts)) + ")"
_VALUE = "CASE WHEN regexp_full_match(value_raw, '[0-9.]+') THEN CAST(value_raw AS DOUBLE) END"


def _ctes(annual: int = 30) -> str:
    return f"""{_SPEC},
c AS (SELECT *, date_diff('day', start_date, end_date) AS duration_days FROM {{fx_contexts}}),
j AS (SELECT f.*, c.start_date, c.end_date, c.instant, c.is_consolidated, c.duration_days FROM {{fx_facts}} f JOIN c ON f.filing_id = c.filing_id AND f.context_ref = c.context_id),
r AS (SELECT DISTINCT filing_id, report_date FROM {{fx_filings}}),
q AS (SELECT j.*, s.stmt, s.field, s.period_type, s.tag_pos, s.unit, r.report_date, {_VALUE} AS value,
        CASE WHEN is_consolidated THEN 100 ELSE 0 END
        + CASE WHEN period_type = 'duration' AND duration_days IS NOT NULL THEN CASE WHEN duration_days BETWEEN 300 AND 380 THEN {annual} ELSE -5 END ELSE 0 END
        + CASE WHEN contains(lower(unit_ref), s.unit) THEN 10 ELSE 0 END + greatest(0, 5 - tag_pos) AS score
      FROM j JOIN spec s ON j.tag = s.tag JOIN r ON r.filing_id = j.filing_id
      WHERE CASE period_type WHEN 'duration' THEN end_date = report_date AND start_date IS NOT NULL ELSE coalesce(instant = report_date, false) OR coalesce(end_date = report_date, false) END)"""


def _best(source: str, keys: str, order: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) x WHERE rn = 1)"


_CHOSEN = _best("q", "filing_id, stmt, field", "score DESC, fact_seq")


def _inputs(spark, d):
    return view(spark, d, "fx_facts"), view(spark, d, "fx_contexts"), view(spark, d, "fx_filings"), specs.fields(spark, ROWS)


def _scored(spark, d, annual=30):
    return xb.scored_facts(*_inputs(spark, d), annual)


def w1_choose_fact(spark, d):
    return xb.choose_facts(_scored(spark, d)).select("filing_id", "stmt", "field", "tag", "fact_seq", "value", F.col("score").cast("int").alias("score"))


def c1_us_statement_rows(spark, d):
    return xb.statement_rows(xb.choose_facts(_scored(spark, d)), [f"{s}_{f}" for s, f, *_ in ROWS])


def a10_report_date(spark, d):
    return xb.infer_report_dates(view(spark, d, "fx_contexts"))


def c2_debt(spark, d):
    facts, contexts, filings, _ = _inputs(spark, d)
    rows = [("BS", "debt_current", ["NetIncomeLoss"], "duration", ["usd"]), ("BS", "debt_noncurrent", ["Assets"], "instant", ["usd"]), ("BS", "debt_general", ["Liabilities"], "instant", ["usd"])]
    return xb.debt_split(xb.choose_facts(xb.scored_facts(facts, contexts, filings, specs.fields(spark, rows))))


def c3_net_income(spark, d):
    wide = xb.choose_facts(_scored(spark, d)).groupBy("filing_id").pivot("field", ["net_income", "total_assets"]).agg(F.first("value"))
    return xb.consolidated_net_income(wide.select("filing_id", "net_income", F.col("total_assets").alias("minority_share")))


def c4_chains(spark, d):
    chains = spark.createDataFrame([("liquid", 0, "total_assets"), ("liquid", 1, "total_liabilities"), ("flow", 0, "net_cash_investing"), ("flow", 1, "net_income")], "field string, chain_pos int, source string")
    return xb.chain_values(_scored(spark, d, xb.ANNUAL_JP), chains)


def c15_batch(spark, d):
    filings = view(spark, d, "fx_filings")
    values = xb.choose_facts(_scored(spark, d)).filter("field = 'net_cash_operating'").select("filing_id", "value")
    wanted = view(spark, d, "supplier").select(F.col("s_suppkey").alias("company_key"), F.make_date(F.lit(1998), F.lit(12), F.lit(31)).alias("report_date"), F.lit("10-K").alias("form_type"))
    return xb.cash_flow_batch(wanted, filings, values)


def _text_tags(spark):
    return spark.createDataFrame([("ProfitLoss", 0), ("NetIncomeLoss", 1)], "tag string, tag_pos int")


def p2_annual_jp(spark, d):
    docs = view(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("docID"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.col("o_custkey").cast("string"), F.lit("0"))).alias("secCode"),
        F.element_at(F.array(F.lit("030000"), F.lit("030001"), F.lit("120000")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("formCode"),
        F.when(F.col("o_orderkey") % 7 == 0, "訂正有価証券報告書").when(F.col("o_orderkey") % 7 == 1, "四半期報告書").otherwise("有価証券報告書").alias("docDescription"),
        F.when(F.col("o_orderkey") % 4 == 0, "0").otherwise("1").alias("xbrlFlag"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("periodEnd"), F.lit("2024-06-20 10:00").alias("submitDateTime"),
    )
    return fl.annual_filings_jp(docs).select("docID", "sec_code", "is_amendment")


def p4_annual_cn(spark, d):
    rows = view(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("announcementId"), F.col("o_orderkey").alias("announcementTime"),
        F.concat(F.lit("公司"), (F.lit(2000) + F.col("o_orderkey") % 30).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "年度报告摘要").when(F.col("o_orderkey") % 4 == 1, "年年度报告").otherwise("年度报告")).alias("announcementTitle"),
    )
    return fl.annual_filings_cn(rows).select("announcementId", "fiscal_year")


def j3_cik(spark, d):
    companies = view(spark, d, "supplier").select(F.col("s_suppkey").alias("company_key"), F.concat(F.lit(" t"), F.col("s_suppkey") % 50).alias("symbol"), F.when(F.col("s_suppkey") % 7 == 0, F.col("s_suppkey").cast("string")).alias("cik"))
    tickers = view(spark, d, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey") % 20).alias("ticker"), F.col("n_nationkey").alias("cik"), F.col("n_nationkey").alias("seq"))
    return fl.with_cik(companies, tickers).select("company_key", "cik", "status")


def v12_status(spark, d):
    s = F.col("s_suppkey")
    runs = view(spark, d, "supplier").select(
        s.alias("company_key"), F.element_at(F.array(F.lit("us"), F.lit("jp"), F.lit("cn")), (s % 3 + 1).cast("int")).alias("market"), (s % 11 > 0).alias("symbol_ok"), F.when(s % 4 > 0, s).alias("cik"),
        (s % 5 > 0).alias("has_key"), (s % 7 > 0).alias("extracted"), (s % 13 > 0).alias("checked"), F.repeat(F.col("s_name"), 200).alias("error"),
    )
    return fl.batch_status(runs)


_V12 = """SELECT company_key, market, CASE WHEN NOT symbol_ok THEN 'skipped_invalid_symbol' WHEN market = 'us' AND cik IS NULL THEN 'skipped_missing_cik'
  WHEN market = 'jp' AND NOT has_key THEN 'skipped_missing_edinet_key' WHEN NOT extracted THEN 'extract_failed' WHEN NOT checked THEN 'check_failed' ELSE 'success' END AS status,
  symbol_ok, cik, has_key, extracted, checked, left(error, 2000) AS error
FROM (SELECT s_suppkey AS company_key, ['us', 'jp', 'cn'][s_suppkey % 3 + 1] AS market, s_suppkey % 11 > 0 AS symbol_ok, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey END AS cik,
  s_suppkey % 5 > 0 AS has_key, s_suppkey % 7 > 0 AS extracted, s_suppkey % 13 > 0 AS checked, repeat(s_name, 200) AS error FROM {supplier})"""

QUERIES = {
    "j1_facts_x_contexts": (
        lambda s, d: xb.facts_x_contexts(view(s, d, "fx_facts"), view(s, d, "fx_contexts")).select("filing_id", "fact_seq", "context_ref", "tag", "duration_days", "is_consolidated"),
        "SELECT f.filing_id, fact_seq, context_ref, tag, CAST(date_diff('day', start_date, end_date) AS INT) AS duration_days, is_consolidated FROM {fx_facts} f JOIN {fx_contexts} c ON f.filing_id = c.filing_id AND f.context_ref = c.context_id",
    ),
    "j2_facts_x_field_specs": (
        lambda s, d: xb.facts_x_fields(view(s, d, "fx_facts"), specs.fields(s, ROWS)).select("filing_id", "fact_seq", "stmt", "field", "tag_pos"),
        f"WITH {_SPEC} SELECT filing_id, fact_seq, stmt, field, CAST(tag_pos AS INT) AS tag_pos FROM {{fx_facts}} f JOIN spec s ON f.tag = s.tag",
    ),
    "p5_period_filter": (
        lambda s, d: _scored(s, d).select("filing_id", "fact_seq", "stmt", "field", F.col("score").cast("int").alias("score")),
        f"WITH {_ctes()} SELECT filing_id, fact_seq, stmt, field, CAST(score AS INT) AS score FROM q",
    ),
    "w1_choose_fact": (w1_choose_fact, f"WITH {_ctes()} SELECT filing_id, stmt, field, tag, fact_seq, value, CAST(score AS INT) AS score FROM {_CHOSEN} z"),
    "w2_choose_value_jp": (
        lambda s, d: xb.choose_facts(_scored(s, d, xb.ANNUAL_JP), parse_first=True).select("filing_id", "stmt", "field", "tag", "value"),
        f"WITH {_ctes(20)}, v AS (SELECT * FROM q WHERE value IS NOT NULL) SELECT filing_id, stmt, field, tag, value FROM {_best('v', 'filing_id, stmt, field', 'score DESC, fact_seq')} z",
    ),
    "t1_top_k_facts": (
        lambda s, d: xb.top_facts(_scored(s, d), 3).select("filing_id", "candidate_id", "candidate_rank", "tag", "context_ref", "value"),
        f"""WITH {_ctes()}, d AS {_best('q', 'filing_id, stmt, field, tag, context_ref, value', 'fact_seq')},
        k AS (SELECT *, row_number() OVER (PARTITION BY filing_id, stmt, field ORDER BY score DESC, fact_seq) AS rk FROM d)
        SELECT filing_id, stmt || '.' || field || '.fact.' || rk AS candidate_id, CAST(rk AS INT) AS candidate_rank, tag, context_ref, value FROM k WHERE rk <= 3""",
    ),
    "t3_first_tag_with_value": (
        lambda s, d: xb.first_tag_values(*_inputs(s, d)).select("filing_id", "stmt", "field", "value", "tag_pos"),
        f"""WITH {_ctes()}, e AS (SELECT j.*, s.stmt, s.field, s.tag_pos, {_VALUE} AS value FROM j JOIN spec s ON j.tag = s.tag JOIN r ON r.filing_id = j.filing_id WHERE coalesce(end_date, instant) = report_date),
        b AS {_best('e', 'filing_id, stmt, field, tag_pos', "is_consolidated DESC, contains(upper(unit_ref), 'USD') DESC, fact_seq")}
        SELECT filing_id, stmt, field, arg_min(value, tag_pos) AS value, CAST(min(tag_pos) AS INT) AS tag_pos FROM b WHERE value IS NOT NULL GROUP BY ALL""",
    ),
    "t4_label_alias_search": (
        lambda s, d: xb.label_alias_values(view(s, d, "fx_facts"), view(s, d, "fx_contexts"), view(s, d, "fx_filings"), s.createDataFrame([("net cash",), ("Investing Activities",)], "alias string")),
        f"""WITH {_ctes()}, l AS (SELECT j.*, {_VALUE} AS value, trim(regexp_replace(lower(regexp_replace(tag, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS label FROM j JOIN r ON r.filing_id = j.filing_id WHERE coalesce(end_date, instant) = report_date),
        h AS (SELECT *, CASE WHEN is_consolidated THEN 100 ELSE 0 END + CASE WHEN contains(upper(unit_ref), 'USD') THEN 20 ELSE 0 END + CASE WHEN starts_with(label, alias) THEN 10 ELSE 0 END AS score
              FROM l JOIN (VALUES ('net cash'), ('investing activities')) a(alias) ON contains(label, alias) WHERE value IS NOT NULL)
        SELECT filing_id, tag, value, score FROM {_best('h', 'filing_id', 'score DESC, fact_seq')} z""",
    ),
    "t5_text_fact_pick": (
        lambda s, d: xb.text_facts(view(s, d, "fx_facts"), view(s, d, "fx_contexts"), _text_tags(s)),
        f"""WITH {_ctes()}, t AS (SELECT j.*, 100 - p + CASE WHEN is_consolidated THEN 10 ELSE 0 END AS score FROM j JOIN (VALUES ('ProfitLoss', 0), ('NetIncomeLoss', 1)) v(vt, p) ON tag = vt)
        SELECT filing_id, tag, value_raw AS text, score FROM {_best('t', 'filing_id', 'score DESC, fact_seq')} z""",
    ),
    "a10_report_date_inference": (
        a10_report_date,
        """WITH c AS (SELECT *, date_diff('day', start_date, end_date) AS dd FROM {fx_contexts}),
        v AS (SELECT filing_id, end_date AS day, 2 + CASE WHEN is_consolidated THEN 8 ELSE 0 END + CASE WHEN dd BETWEEN 300 AND 380 THEN 10 WHEN dd > 0 THEN 1 ELSE 0 END AS s FROM c WHERE end_date IS NOT NULL
              UNION ALL SELECT filing_id, instant, 1 + CASE WHEN is_consolidated THEN 4 ELSE 0 END FROM c WHERE instant IS NOT NULL),
        g AS (SELECT filing_id, day, CAST(sum(s) AS BIGINT) AS score FROM v GROUP BY ALL)
        SELECT filing_id, day AS report_date, score FROM (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY score DESC, day DESC) AS rn FROM g) WHERE rn = 1""",
    ),
    "w4_longest_duration_context": (
        lambda s, d: xb.longest_durations(view(s, d, "fx_contexts"), view(s, d, "fx_filings")),
        f"""WITH {_ctes()}, w AS (SELECT c.* FROM c JOIN r ON c.filing_id = r.filing_id AND end_date = report_date WHERE duration_days > 0)
        SELECT filing_id, start_date, CAST(duration_days AS INT) AS duration_days, CAST(start_date - INTERVAL 1 DAY AS DATE) AS prior_end FROM {_best('w', 'filing_id', 'is_consolidated DESC, duration_days DESC, start_date DESC')} z""",
    ),
    "j11_prior_period_lookup": (
        lambda s, d: xb.prior_period_values(*_inputs(s, d)).select("filing_id", "stmt", "field", "value"),
        f"""WITH {_ctes()}, w AS (SELECT c.* FROM c JOIN r ON c.filing_id = r.filing_id AND end_date = report_date WHERE duration_days > 0),
        p AS (SELECT filing_id, start_date - INTERVAL 1 DAY AS day FROM {_best('w', 'filing_id', 'is_consolidated DESC, duration_days DESC, start_date DESC')} z),
        e AS (SELECT j.*, s.stmt, s.field, s.tag_pos, {_VALUE} AS value FROM j JOIN spec s ON j.tag = s.tag JOIN p ON p.filing_id = j.filing_id WHERE coalesce(end_date, instant) = day),
        b AS {_best('e', 'filing_id, stmt, field, tag_pos', "is_consolidated DESC, contains(upper(unit_ref), 'USD') DESC, fact_seq")}
        SELECT filing_id, stmt, field, arg_min(value, tag_pos) AS value FROM b WHERE value IS NOT NULL GROUP BY ALL""",
    ),
    "c1_us_statement_rows": (c1_us_statement_rows, f"WITH {_ctes()}, b AS {_CHOSEN} SELECT filing_id, " + ", ".join(f"max(value) FILTER (stmt = '{s}' AND field = '{f}') AS {s}_{f}" for s, f, *_ in ROWS) + " FROM b GROUP BY filing_id"),
    "c1_us_statements_by_rule": (
        lambda s, d: xb.us_statements(*_inputs(s, d)),
        f"""WITH {_ctes()}, b AS {_CHOSEN}, e AS (SELECT j.*, s.stmt, s.field, s.tag_pos, {_VALUE} AS value FROM j JOIN spec s ON j.tag = s.tag AND s.stmt = 'CF' JOIN r ON r.filing_id = j.filing_id WHERE coalesce(end_date, instant) = report_date),
        t AS {_best('e', 'filing_id, stmt, field, tag_pos', "is_consolidated DESC, contains(upper(unit_ref), 'USD') DESC, fact_seq")}
        SELECT filing_id, stmt, field, value FROM b WHERE stmt <> 'CF' UNION ALL SELECT filing_id, stmt, field, arg_min(value, tag_pos) FROM t WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "c2_us_debt_split": (
        c2_debt,
        f"""WITH {_ctes().replace(_SPEC, "spec(stmt, field, period_type, unit, tag_pos, tag) AS (VALUES ('BS', 'debt_current', 'duration', 'usd', 0, 'NetIncomeLoss'), ('BS', 'debt_noncurrent', 'instant', 'usd', 0, 'Assets'), ('BS', 'debt_general', 'instant', 'usd', 0, 'Liabilities'))")},
          b AS {_CHOSEN},
        p AS (SELECT filing_id, max(value) FILTER (field = 'debt_current') AS cur, max(value) FILTER (field = 'debt_noncurrent') AS non, max(value) FILTER (field = 'debt_general') AS gen FROM b GROUP BY filing_id)
        SELECT filing_id, cur AS debt_current, coalesce(non, gen) AS long_term, CAST(non IS NULL AND gen IS NOT NULL AS INT) AS is_proxy,
          CASE WHEN coalesce(cur, non, gen) IS NOT NULL THEN coalesce(cur, 0) + coalesce(non, gen, 0) END AS total_debt,
          CAST(coalesce(cur, non, gen) IS NOT NULL AND (cur IS NULL OR coalesce(non, gen) IS NULL) AS INT) AS is_imputed FROM p""",
    ),
    "c3_us_consolidated_net_income": (
        c3_net_income,
        f"WITH {_ctes()}, b AS {_CHOSEN}, p AS (SELECT filing_id, max(value) FILTER (field = 'net_income') AS net_income, max(value) FILTER (field = 'total_assets') AS minority_share FROM b GROUP BY filing_id) SELECT *, net_income + coalesce(minority_share, 0) AS consolidated_net_income FROM p",
    ),
    "c4_jp_chains": (
        c4_chains,
        f"""WITH {_ctes(20)}, v AS (SELECT * FROM q WHERE value IS NOT NULL), b AS {_best('v', 'filing_id, stmt, field', 'score DESC, fact_seq')}
        SELECT filing_id, f AS field, arg_min(value, p) AS value FROM b JOIN (VALUES ('liquid', 0, 'total_assets'), ('liquid', 1, 'total_liabilities'), ('flow', 0, 'net_cash_investing'), ('flow', 1, 'net_income')) ch(f, p, src) ON field = src GROUP BY ALL""",
    ),
    "c15_us_cash_flow_batch": (
        c15_batch,
        f"""WITH {_ctes()}, b AS (SELECT filing_id, value, true AS has FROM {_CHOSEN} z WHERE field = 'net_cash_operating'), w AS (SELECT s_suppkey AS company_key, DATE '1998-12-31' AS report_date, '10-K' AS form_type FROM {{supplier}})
        SELECT w.*, f.filing_id, b.value, CASE WHEN f.filing_id IS NULL THEN 'filing_not_found' WHEN has IS NULL THEN 'no_values' END AS error
        FROM w LEFT JOIN {{fx_filings}} f ON w.company_key = f.company_key AND w.report_date = f.report_date AND w.form_type = f.form_type LEFT JOIN b ON b.filing_id = f.filing_id""",
    ),
    "p1_annual_filing_filter_us": (lambda s, d: fl.annual_filings_us(view(s, d, "fx_filings")).select("filing_id", "company_key"), "SELECT filing_id, company_key FROM {fx_filings} WHERE form_type = '10-K'"),
    "p2_annual_filing_filter_jp": (
        p2_annual_jp,
        """SELECT CAST(o_orderkey AS VARCHAR) AS docID, CASE WHEN o_orderkey % 5 > 0 THEN left(CAST(o_custkey AS VARCHAR) || '0', 4) END AS sec_code, o_orderkey % 7 = 0 OR o_orderkey % 3 = 1 AS is_amendment
        FROM {orders} WHERE (o_orderkey % 3 < 2 OR o_orderkey % 7 <> 1) AND o_orderkey % 4 > 0 AND o_orderdate IS NOT NULL""",
    ),
    "p4_annual_filing_filter_cn": (p4_annual_cn, "SELECT CAST(o_orderkey AS VARCHAR) AS announcementId, CAST(2000 + o_orderkey % 30 AS INT) AS fiscal_year FROM {orders} WHERE o_orderkey % 4 > 0 AND o_orderkey > 0"),
    "t2_latest_filing_per_company": (
        lambda s, d: fl.latest_filings(fl.annual_filings_us(view(s, d, "fx_filings"))).select("company_key", "filing_id", "filing_date"),
        "SELECT company_key, filing_id, filing_date FROM (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY filing_date DESC, filing_id) AS rn FROM {fx_filings} WHERE form_type = '10-K') WHERE rn = 1",
    ),
    "j3_ticker_to_cik": (
        j3_cik,
        """WITH t AS (SELECT 'T' || (n_nationkey % 20) AS ticker, max(n_nationkey) AS k FROM {nation} GROUP BY 1)
        SELECT s_suppkey AS company_key, lpad(CAST(CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey ELSE k END AS VARCHAR), 10, '0') AS cik,
          CASE WHEN s_suppkey % 7 = 0 OR k IS NOT NULL THEN 'ok' ELSE 'skipped_missing_cik' END AS status FROM {supplier} LEFT JOIN t ON ticker = 'T' || (s_suppkey % 50)""",
    ),
    "j10_skip_existing": (
        lambda s, d: fl.not_done(view(s, d, "fx_filings").select("company_key", "market").distinct(), fl.annual_filings_us(view(s, d, "fx_filings")).filter("market = 'jp'").select("company_key", "market").distinct(), ["company_key", "market"]),
        "SELECT DISTINCT company_key, market FROM {fx_filings} f WHERE NOT EXISTS (SELECT 1 FROM {fx_filings} g WHERE g.company_key = f.company_key AND g.market = 'jp' AND g.form_type = '10-K')",
    ),
    "s1_read_companies": (
        lambda s, d: fl.limit_per_market(view(s, d, "fx_filings").select("company_key", "market").distinct().withColumn("input_order", F.col("company_key")), 5),
        "SELECT company_key, market, company_key AS input_order FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY company_key) AS rn FROM (SELECT DISTINCT company_key, market FROM {fx_filings})) WHERE rn <= 5",
    ),
    "v12_batch_status": (v12_status, _V12),
    "a14_run_summary": (
        lambda s, d: fl.run_summary(v12_status(s, d)),
        f"WITH v AS ({_V12}) SELECT market, count(*) AS total, count(*) FILTER (status = 'success') AS success, CAST(grouping(market) AS BIGINT) AS level FROM v GROUP BY ROLLUP (market)",
    ),
}
ORACLES = {k: oracle(v[1]) for k, v in QUERIES.items() if v[1]}
QUERIES = {k: v[0] for k, v in QUERIES.items()}
