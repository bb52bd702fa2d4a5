"""Registered queries of the evaluation, anomaly and verification operators with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import anomaly as an
from ..operators import evaluate as ev
from ..operators import verify as vf
from ..operators import xbrl as xb
from ..sources.shared import dealt
from . import xbrl_queries as xq
from .fixtures import oracle, view

_M = "CASE WHEN lower(trim({0})) IN ('1','y','yes','true','t','pass','correct','ok') THEN 1 WHEN lower(trim({0})) IN ('0','n','no','false','f','fail','wrong','ng') THEN 0 END"
_B = "CASE WHEN lower(trim({0})) IN ('y','yes','true','t','on') THEN 1 WHEN abs(coalesce(try_cast({0} AS DOUBLE), 0)) >= 1 THEN 1 ELSE 0 END"
_div = "{0} / nullif({1}, 0)"

SYSTEMS = {"rule": ("is_match_rule", None), "repair": ("is_match_repair", "repair_review_required"), "verify": ("is_match_rule", "repair_applied")}


def _list(s, d):
    return view(s, d, "fx_checklist")


def _audit(s, d):
    """An audit with repeated and missing rows from the checklist itself."""
    rows = _list(s, d).filter("cast(symbol as bigint) % 3 > 0")
    twice = rows.withColumn("input_seq", F.lit(1)).withColumn("final_value", F.lit(1.0)).unionByName(rows.filter("cast(symbol as bigint) % 2 = 0").withColumn("input_seq", F.lit(2)).withColumn("final_value", F.lit(None).cast("double")))
    return twice.select("market", F.concat(F.lit(" "), F.col("symbol")).alias("symbol"), F.lower("statement").alias("statement"), "field_name", "input_seq", "final_value", F.col("input_seq").alias("review_required"))


_NORM = "CASE market WHEN 'cn' THEN CASE WHEN length(symbol) < 6 THEN lpad(symbol, 6, '0') ELSE symbol END WHEN 'jp' THEN CASE WHEN length(symbol) < 4 THEN lpad(symbol, 4, '0') ELSE symbol END ELSE symbol END"
_J7 = f"""SELECT market, {_NORM} AS symbol, statement, field_name, extracted_value,
  CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN extracted_value WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN NULL ELSE 1.0 END AS final_value,
  CAST(CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN 9 WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN 2 ELSE 1 END AS INT) AS review_required FROM {{fx_checklist}} WHERE field_name IS NOT NULL"""


def j7(s, d):
    out = ev.with_audit(_list(s, d).filter("field_name is not null"), _audit(s, d), {"final_value": F.col("extracted_value"), "review_required": 9})
    return out.select("market", "symbol", "statement", "field_name", "extracted_value", "final_value", "review_required")


def j8(s, d):
    other = _audit(s, d).filter("input_seq = 1")
    out = ev.multi_system_template(_list(s, d).filter("field_name is not null"), {"verify": _audit(s, d), "repair": other})
    return out.select("market", "symbol", "statement", "field_name", "verify_value", "verify_review_required", "repair_value", "repair_review_required")


_J8 = f"""SELECT market, {_NORM} AS symbol, statement, field_name, CASE WHEN k % 3 > 0 AND k % 2 = 1 THEN 1.0 END::DOUBLE AS verify_value, CAST(CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN 2 ELSE 1 END AS INT) AS verify_review_required,
  CASE WHEN k % 3 > 0 THEN 1.0 END::DOUBLE AS repair_value, 1 AS repair_review_required FROM (SELECT *, CAST(symbol AS BIGINT) AS k FROM {{fx_checklist}}) WHERE field_name IS NOT NULL"""


def a5(s, d):
    rows = _list(s, d).select(
        F.col("extracted_value").alias("a_value"), F.col("repair_review_required").alias("a_review_required"), F.col("is_match_rule").alias("is_match_a"), F.lit("0.25").alias("a_cost"),
        F.when(F.col("market") == "us", "").otherwise("x").alias("b_value"), F.col("repair_applied").alias("b_review_required"), F.col("is_match_repair").alias("is_match_b"), F.when(F.col("market") == "jp", "bad").otherwise("1.5").alias("b_cost"),
    )
    return ev.backbone_metrics(rows, ["a", "b"])


_A5 = f"""WITH l AS (SELECT 'a' AS model_key, CAST(extracted_value AS VARCHAR) AS v, {_B.format('repair_review_required')} AS rv, {_M.format('is_match_rule')} AS m, 0.25 AS c FROM {{fx_checklist}}
  UNION ALL SELECT 'b', CASE WHEN market = 'us' THEN NULL ELSE 'x' END, {_B.format('repair_applied')}, {_M.format('is_match_repair')}, CASE WHEN market = 'jp' THEN 0 ELSE 1.5 END FROM {{fx_checklist}}),
g AS (SELECT model_key, count(*) AS total_rows, count(v) AS filled_rows, CAST(sum(rv) AS BIGINT) AS review_required_rows, count(m) AS reviewed_rows, count(*) FILTER (m = 1) AS correct_rows, CAST(sum(CAST(c AS DECIMAL(20,9))) AS DOUBLE) AS cost_total FROM l GROUP BY 1)
SELECT *, filled_rows / total_rows AS filled_rate, review_required_rows / total_rows AS conflict_rate, correct_rows / nullif(reviewed_rows, 0) AS accuracy, cost_total / total_rows AS cost_per_field FROM g"""

_A2 = f"""WITH l AS (SELECT market, 'rule' AS system, {_M.format('is_match_rule')} AS h, 1 AS r FROM {{fx_checklist}} UNION ALL SELECT market, 'repair', {_M.format('is_match_repair')}, {_B.format('repair_review_required')} FROM {{fx_checklist}}
  UNION ALL SELECT market, 'verify', {_M.format('is_match_rule')}, {_B.format('repair_applied')} FROM {{fx_checklist}}),
g AS (SELECT market, system, count(*) AS total_rows, count(h) AS reviewed_rows, count(*) FILTER (h = 1) AS correct_rows, CAST(sum(r) AS BIGINT) AS review_required_rows, CAST(grouping(market) AS INT) AS level FROM l GROUP BY GROUPING SETS ((market, system), (system))),
w AS (SELECT *, correct_rows / nullif(reviewed_rows, 0) AS accuracy, review_required_rows / nullif(total_rows, 0) AS workload_rate FROM g)
SELECT *, 1 - workload_rate / nullif(max(workload_rate) FILTER (system = 'rule') OVER p, 0) AS workload_reduction, accuracy - max(accuracy) FILTER (system = 'rule') OVER p AS accuracy_delta FROM w WINDOW p AS (PARTITION BY market, level)"""

_A3 = f"""WITH x AS (SELECT {_M.format('is_match_repair')} AS h, {_B.format('repair_applied')} = 1 AS o FROM {{fx_checklist}})
SELECT count(*) FILTER (o) AS repair_applied_rows, count(*) FILTER (o AND h IS NOT NULL) AS repair_reviewed_rows, count(*) FILTER (o AND h = 0) AS false_repair_rows, count(*) FILTER (o AND h = 0) / nullif(count(*) FILTER (o AND h IS NOT NULL), 0) AS false_repair_rate FROM x"""

_A4 = f"""WITH x AS (SELECT market, {_M.format('is_match_rule')} AS r, {_M.format('is_match_repair')} AS f, {_B.format('repair_applied')} = 1 AS o, {_B.format('repair_review_required')} AS v FROM {{fx_checklist}}),
g AS (SELECT market, count(*) AS total_rows, count(r) AS reviewed_rule, count(*) FILTER (r = 1) AS correct_rule, count(f) AS reviewed_final, count(*) FILTER (f = 1) AS correct_final, CAST(sum(v) AS BIGINT) AS review_required_rows,
  count(*) FILTER (o) AS repair_applied_rows, count(*) FILTER (o AND f IS NOT NULL) AS repair_reviewed_rows, count(*) FILTER (o AND f = 0) AS false_repair_rows, CAST(grouping(market) AS INT) AS level FROM x GROUP BY ROLLUP (market)),
h AS (SELECT *, correct_rule / nullif(reviewed_rule, 0) AS accuracy_rule, correct_final / nullif(reviewed_final, 0) AS accuracy_final, review_required_rows / nullif(total_rows, 0) AS workload_rate, false_repair_rows / nullif(repair_reviewed_rows, 0) AS false_repair_rate FROM g)
SELECT *, accuracy_final - accuracy_rule AS accuracy_delta, 1 - workload_rate AS workload_reduction FROM h"""


def c11(s, d):
    wide = xq.QUERIES["c1_us_statement_rows"](s, d)
    runs = view(s, d, "fx_filings").select("filing_id", "market", F.when(F.col("company_key") % 6 == 0, "check_failed").otherwise("success").alias("status"))
    return ev.checklist(wide, runs, {"net_income": ("IS", "IS_net_income"), "total_assets": ("BS", "BS_total_assets"), "net_cash_operating": ("CF", "CF_net_cash_operating")})


_C11 = f"""WITH {xq._ctes()}, b AS {xq._CHOSEN}, k AS (SELECT DISTINCT filing_id FROM b), w AS (SELECT f.filing_id, f.market FROM {{fx_filings}} f JOIN k ON k.filing_id = f.filing_id WHERE company_key % 6 <> 0)
SELECT w.filing_id, w.market, x.statement, x.field_name, b.value AS extracted_value FROM w CROSS JOIN (VALUES ('IS', 'net_income'), ('BS', 'total_assets'), ('CF', 'net_cash_operating')) x(statement, field_name)
LEFT JOIN b ON b.filing_id = w.filing_id AND b.stmt = x.statement AND b.field = x.field_name"""


def _sections(s, d):
    return view(s, d, "fx_sections"), view(s, d, "fx_section_items")


_A6 = """WITH c AS (SELECT section_id, CAST(sum(CAST(round(value * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 AS t, count(value) AS n FROM {fx_section_items} GROUP BY 1),
x AS (SELECT s.section_id, parent_value AS p, t, coalesce(n, 0) AS n FROM {fx_sections} s LEFT JOIN c ON c.section_id = s.section_id)"""


def _words(s, d):
    """Sections of items for the anchor and flag operators: the parts of an order by name."""
    parts = view(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.element_at(F.split("p_name", " "), 1).alias("item"))
    return view(s, d, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("seq"), "item")


ANCHORS = ["small", "red", "blue", "hot", "green"]


def a8(s, d):
    anchors = s.createDataFrame(list(enumerate(ANCHORS)), "ordinal int, anchor string").select("anchor", "ordinal")
    return an.format_anomalies(_words(s, d), anchors)


_W = "w AS (SELECT l_orderkey AS section_id, l_linenumber AS seq, split_part(p_name, ' ', 1) AS item FROM {lineitem} JOIN {part} ON l_partkey = p_partkey)"
_A8 = f"""WITH {_W}, a AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(ANCHORS))}) v(o, anchor)), s AS (SELECT DISTINCT section_id FROM w), h AS (SELECT DISTINCT section_id, item FROM w)
SELECT s.section_id, string_agg(anchor, ',' ORDER BY o) AS missing_anchors, CAST(count(*) AS INT) AS n_missing, count(*) >= 3 AS is_anomaly FROM s CROSS JOIN a LEFT JOIN h ON h.section_id = s.section_id AND h.item = a.anchor WHERE h.item IS NULL GROUP BY 1"""


def w13(s, d):
    lines = dealt(view(s, d, "lineitem").select(F.col("l_suppkey").alias("chart"), "l_orderkey", "l_linenumber", "l_partkey"), "chart")
    rows = lines.select("chart", F.row_number().over(Window.partitionBy("chart").orderBy("l_orderkey", "l_linenumber", "l_partkey")).alias("ordinal"), (F.col("l_linenumber") == 7).alias("is_parent"))
    return an.section_children(rows.withColumn("item_code", F.concat(F.lit("C"), "ordinal"))).select("chart", "parent_code", "child_code")


_W13 = """WITH r AS (SELECT l_suppkey AS chart, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS o, l_linenumber = 7 AS p FROM {lineitem}),
n AS (SELECT *, coalesce(sum(CAST(p AS INT)) OVER (PARTITION BY chart ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r)
SELECT chart, parent_code, child_code FROM (SELECT chart, p, 'C' || o AS child_code, max(CASE WHEN p THEN 'C' || o END) OVER (PARTITION BY chart, k) AS parent_code FROM n) WHERE NOT p AND parent_code IS NOT NULL"""


def _labelled(s, d):
    """Labels made of fixed texts by key, so that every branch occurs."""
    texts = ["特殊不平_流动资产", " 特殊格式_非流动 资产", "应收账款", "货币资金", "存货及其他", "特殊归并_其他流动资产项", "固定资产"]
    return view(s, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("label"), (F.col("p_size") % 3).alias("n_codes"))


_L = "l AS (SELECT p_partkey, ['特殊不平_流动资产', ' 特殊格式_非流动 资产', '应收账款', '货币资金', '存货及其他', '特殊归并_其他流动资产项', '固定资产'][p_partkey % 7 + 1] AS label, p_size % 3 AS n_codes FROM {part})"


def f24(s, d):
    return _labelled(s, d).withColumn("m", an.marker_flag(F.col("label"))).select("p_partkey", "m.section", "m.flag")


def _decisions(s, d):
    rows = view(s, d, "fx_decisions").withColumn("rule_status", F.when(F.col("rule_value").isNull(), "MISSING").otherwise("OK"))
    return rows.withColumn("supported", sc.close(F.col("proposed_value"), F.col("candidate_value")) & (F.col("n_evidence") > 0))


_close = "coalesce(abs({0} - {1}) <= 1e-9 OR abs({0} - {1}) / greatest(abs({0}), abs({1}), 1) <= 1e-6, false)"
_D = f"d AS (SELECT *, CASE WHEN rule_value IS NULL THEN 'MISSING' ELSE 'OK' END AS rule_status, {_close.format('proposed_value', 'candidate_value')} AND n_evidence > 0 AS supported FROM {{fx_decisions}})"
_GUARD = f"""CASE WHEN decision = 'REPAIR' THEN CASE WHEN {{0}} THEN 'repair_not_allowed_for_rule_status' WHEN {_close.format('proposed_value', 'rule_value')} THEN 'noop_repair_same_as_rule'
  WHEN n_evidence = 0 THEN 'missing_evidence' WHEN proposed_value IS NULL THEN 'missing_proposed_value' WHEN NOT supported THEN 'unsupported_repair_value' END END"""


def _v5_sql(only: str) -> str:
    return f"""WITH {_D}, g AS (SELECT *, {_GUARD.format(only)} AS guard_fail FROM d)
SELECT case_id, guard_fail, decision = 'REPAIR' AND guard_fail IS NULL AS repair_applied, CASE WHEN guard_fail IS NOT NULL THEN 'NEED_REVIEW' ELSE decision END AS final_decision,
  CASE WHEN decision = 'REPAIR' AND guard_fail IS NULL THEN proposed_value ELSE rule_value END AS final_value,
  guard_fail IS NOT NULL OR decision = 'NEED_REVIEW' OR (decision = 'KEEP' AND n_evidence = 0) AS review_required FROM g"""


_V5 = ["case_id", "guard_fail", "repair_applied", "final_decision", "final_value", "review_required"]


def _contract(s, d):
    codes = F.when(F.col("n_evidence") > 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    two = F.array(F.struct(F.lit("A").alias("item_code"), F.col("candidate_value").alias("value")), F.struct(F.lit("B").alias("item_code"), F.when(F.col("case_id") % 4 == 0, F.col("rule_value")).alias("value")))
    return view(s, d, "fx_decisions").withColumn("errors", vf.contract_errors(F.col("decision"), F.lit("OK"), F.col("proposed_value"), F.col("rule_value"), codes, two))


def v4(s, d):
    return _contract(s, d).select("case_id", F.array_join("errors", ",").alias("errors"))


_V4 = f"""SELECT case_id, concat_ws(',', CASE WHEN decision = 'bogus' THEN 'decision_invalid' END,
  CASE WHEN decision IN ('KEEP', 'REPAIR') AND n_evidence = 0 THEN 'missing_evidence_item_codes' END,
  CASE WHEN decision = 'KEEP' AND NOT ((proposed_value IS NULL AND rule_value IS NULL) OR {_close.format('proposed_value', 'rule_value')}) THEN 'keep_value_must_equal_rule_value' END,
  CASE WHEN decision = 'KEEP' AND case_id % 4 = 0 AND rule_value IS NOT NULL AND NOT {_close.format('candidate_value', 'rule_value')} THEN 'keep_not_allowed_with_conflicting_candidates' END,
  CASE WHEN decision = 'REPAIR' AND proposed_value IS NULL THEN 'repair_requires_proposed_value' END,
  CASE WHEN decision = 'REPAIR' AND proposed_value IS NOT NULL AND NOT (n_evidence > 0 AND {_close.format('candidate_value', 'proposed_value')}) THEN 'repair_value_not_supported_by_evidence_item_codes' END,
  CASE WHEN decision = 'NEED_REVIEW' AND proposed_value IS NOT NULL THEN 'need_review_requires_null_proposed_value' END) AS errors FROM {{fx_decisions}}"""


def v6(s, d):
    rows = _decisions(s, d).withColumn("decision", F.when(F.col("decision") == "KEEP", "EXTRACT").otherwise(F.col("decision")))
    rows = rows.withColumn("proposed_status", F.when(F.col("case_id") % 4 == 0, "NOT_APPLICABLE").when(F.col("case_id") % 13 == 0, "bad").otherwise("OK")).withColumn("supports_na", F.col("case_id") % 8 == 0)
    return vf.extract_guardrails(rows).select("case_id", "guard_fail", "final_decision", "final_value", "final_source", "review_required")


_V6 = f"""WITH {_D}, e AS (SELECT * REPLACE (CASE WHEN decision = 'KEEP' THEN 'EXTRACT' ELSE decision END AS decision), CASE WHEN case_id % 4 = 0 THEN 'NOT_APPLICABLE' WHEN case_id % 13 = 0 THEN 'bad' ELSE 'OK' END AS st FROM d),
g AS (SELECT *, CASE WHEN decision = 'EXTRACT' THEN CASE WHEN n_evidence = 0 THEN 'missing_evidence' WHEN st = 'OK' AND proposed_value IS NULL THEN 'missing_proposed_value' WHEN st = 'OK' AND NOT supported THEN 'unsupported_extract_value'
  WHEN st = 'NOT_APPLICABLE' AND case_id % 8 <> 0 THEN 'unsupported_not_applicable' WHEN st = 'bad' THEN 'invalid_extract_status' END END AS guard_fail FROM e),
k AS (SELECT *, CASE WHEN guard_fail IS NOT NULL THEN 'NEED_REVIEW' ELSE decision END AS final_decision FROM g)
SELECT case_id, guard_fail, final_decision, CASE WHEN final_decision = 'EXTRACT' AND st = 'OK' THEN proposed_value END AS final_value, CASE WHEN final_decision = 'EXTRACT' THEN 'llm_only' ELSE 'llm_only_review' END AS final_source,
  final_decision <> 'EXTRACT' AS review_required FROM k"""


def v10(s, d):
    rows = _contract(s, d).select(F.col("company_key").alias("case_id"), F.col("input_seq").alias("attempt"), F.col("decision").alias("response"), "errors")
    return vf.first_valid_attempts(rows, 3)


_V10 = f"""WITH e AS ({_V4}), a AS (SELECT f.company_key AS case_id, f.input_seq AS attempt, f.decision AS response FROM {{fx_decisions}} f JOIN e ON e.case_id = f.case_id WHERE e.errors = '' AND f.input_seq <= 3)
SELECT case_id, arg_min(response, attempt) AS response, min(attempt) AS attempt FROM a GROUP BY 1"""


def v9(s, d):
    cases = view(s, d, "fx_decisions").select("case_id", "rule_value", F.when(F.col("rule_value").isNull(), "MISSING").otherwise("OK").alias("rule_status"))
    made = _decisions(s, d).filter("case_id % 9 > 0").select("case_id", "decision", "proposed_value", "n_evidence", "supported", (F.col("case_id") % 1000).alias("prompt_tokens"), F.lit(50).alias("completion_tokens"))
    return vf.audit_table(cases, made, 0.5, 1.5).select(*_V5, "cost_usd")


_V9 = f"""WITH {_D}, g AS (SELECT *, {_GUARD.format('false')} AS gf, case_id % 9 > 0 AS found FROM d)
SELECT case_id, CASE WHEN found THEN gf ELSE 'llm_call_failed' END AS guard_fail, found AND decision = 'REPAIR' AND gf IS NULL AS repair_applied, CASE WHEN NOT found OR gf IS NOT NULL THEN 'NEED_REVIEW' ELSE decision END AS final_decision,
  CASE WHEN found AND decision = 'REPAIR' AND gf IS NULL THEN proposed_value ELSE rule_value END AS final_value,
  NOT found OR gf IS NOT NULL OR decision = 'NEED_REVIEW' OR (decision = 'KEEP' AND n_evidence = 0) AS review_required,
  CASE WHEN found THEN (case_id % 1000) / 1e6 * 0.5 + 50 / 1e6 * 1.5 END AS cost_usd FROM g"""


def _items(s, d):
    """Extracted items of documents: parts of a brand as item codes."""
    return view(s, d, "part").select(F.col("p_brand").alias("doc_id"), F.lit("BS").alias("stmt"), F.element_at(F.split("p_name", " "), 1).alias("item_code"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).alias("value"), F.when(F.col("p_size") % 4 > 0, "OK").when(F.col("p_size") % 8 == 0, "PARSE_ERROR").otherwise("MISSING").alias("status"), F.col("p_partkey").alias("seq"))


def v1(s, d):
    first = _items(s, d).groupBy("doc_id", "stmt", "item_code").agg(F.min_by(F.struct("value", "status"), "seq").alias("x")).select("doc_id", "stmt", "item_code", "x.*")
    config = s.createDataFrame([("BS", "coat", ["red", "blue", "small"]), ("BS", "heat", ["hot"])], "stmt string, field string, codes array<string>")
    cases = vf.build_cases(config, first)
    return cases.select("doc_id", "stmt", "field", F.array_join(F.transform("candidates", lambda c: c["item_code"]), ",").alias("codes"), "rule_value", "rule_status")


_V1 = """WITH i AS (SELECT p_brand AS doc_id, split_part(p_name, ' ', 1) AS item_code, arg_min({{'v': CASE WHEN p_size % 4 > 0 THEN p_retailprice END, 's': CASE WHEN p_size % 4 > 0 THEN 'OK' WHEN p_size % 8 = 0 THEN 'PARSE_ERROR' ELSE 'MISSING' END}}, p_partkey) AS x FROM {part} GROUP BY 1, 2),
c AS (SELECT * FROM (VALUES ('coat', 0, 'red'), ('coat', 1, 'blue'), ('coat', 2, 'small'), ('heat', 0, 'hot')) v(field, pos, code)),
g AS (SELECT doc_id, 'BS' AS stmt, field, string_agg(item_code, ',' ORDER BY pos) AS codes, arg_min(x.v, pos) FILTER (x.v IS NOT NULL) AS rule_value, bool_or(x.s = 'PARSE_ERROR') AS pe FROM i JOIN c ON i.item_code = c.code GROUP BY 1, 2, 3)
SELECT doc_id, stmt, field, codes, rule_value, CASE WHEN rule_value IS NOT NULL THEN 'OK' WHEN pe THEN 'PARSE_ERROR' ELSE 'MISSING' END AS rule_status FROM g""".replace("{{", "{").replace("}}", "}")


def w14(s, d):
    return triggers(xb.top_facts(xq._scored(s, d), 3))


def triggers(top):
    unit = F.exists("unit_keywords", lambda k: F.contains(F.lower("unit_ref"), k))
    aligned = F.when(F.col("period_type") == "duration", F.coalesce(F.col("duration_days").between(330, 400), F.lit(False))).otherwise(True)
    cols = top.withColumn("unit_match", unit).withColumn("aligned", aligned).withColumn("tag_priority", F.greatest(F.lit(0), 5 - F.col("tag_pos")))
    return vf.low_confidence(cols)


_W14 = f"""WITH {xq._ctes()}, d AS {xq._best('q', 'filing_id, stmt, field, tag, context_ref, value', 'fact_seq')},
k AS (SELECT *, row_number() OVER (PARTITION BY filing_id, stmt, field ORDER BY score DESC, fact_seq) AS rk, contains(lower(unit_ref), unit) AS um, CASE WHEN period_type = 'duration' THEN coalesce(duration_days BETWEEN 330 AND 400, false) ELSE true END AS al FROM d),
t AS (SELECT * FROM k WHERE rk <= 3), w AS (SELECT *, score - lead(score) OVER (PARTITION BY filing_id, stmt, field ORDER BY rk) AS gap, bool_or(is_consolidated) OVER p AS ac, bool_or(al) OVER p AS aa, bool_or(um) OVER p AS au FROM t WINDOW p AS (PARTITION BY filing_id, stmt, field))
SELECT filing_id, stmt, field, CASE WHEN value IS NULL THEN 'missing' WHEN gap < 15 THEN 'score_gap' WHEN greatest(0, 5 - tag_pos) <= 1 THEN 'tag_priority'
  WHEN NOT is_consolidated AND ac THEN 'not_consolidated' WHEN NOT al AND aa THEN 'period' WHEN NOT um AND au THEN 'unit' END AS reason
  FROM w WHERE rk = 1"""


def j9(s, d):
    rows = view(s, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.when(F.col("o_orderkey") % 2 == 0, "IS").otherwise("CF").alias("stmt"), F.lit("net_income").alias("field"), F.col("o_totalprice").alias("value"), "o_orderkey")
    one = rows.groupBy("filing_id", "stmt", "field").agg(F.min_by("value", "o_orderkey").alias("value"))
    return vf.cross_statement(one)


_J9 = f"""WITH o AS (SELECT o_custkey AS filing_id, CASE WHEN o_orderkey % 2 = 0 THEN 'IS' ELSE 'CF' END AS stmt, arg_min(o_totalprice, o_orderkey) AS value FROM {{orders}} GROUP BY 1, 2)
SELECT a.filing_id, a.stmt, a.value, b.value AS other_value, a.value IS NOT NULL AND b.value IS NOT NULL AND NOT {_close.format('a.value', 'b.value')} AS mismatch FROM o a LEFT JOIN o b ON a.filing_id = b.filing_id AND a.stmt <> b.stmt"""

QUERIES = {
    "a1_coverage_accuracy": (
        lambda s, d: ev.coverage_accuracy(_list(s, d), "is_match_rule"),
        f"""WITH g AS (SELECT market, statement, field_name, count(field_name) AS total, count(extracted_value) AS extracted, count({_M.format('is_match_rule')}) AS reviewed, count(*) FILTER ({_M.format('is_match_rule')} = 1) AS correct,
        CAST(grouping(market, statement, field_name) AS BIGINT) AS level FROM {{fx_checklist}} GROUP BY ROLLUP (market, statement, field_name)) SELECT *, extracted / greatest(total, 1) AS coverage, correct / nullif(reviewed, 0) AS accuracy FROM g""",
    ),
    "a2_four_way_metrics": (lambda s, d: ev.system_metrics(_list(s, d), SYSTEMS), _A2),
    "a3_false_repair": (lambda s, d: ev.false_repairs(_list(s, d), "is_match_repair", "repair_applied"), _A3),
    "a4_llm_ablation_summary": (lambda s, d: ev.ablation_summary(_list(s, d), "is_match_rule", "is_match_repair", "repair_review_required", "repair_applied"), _A4),
    "a5_backbone_metrics": (a5, _A5),
    "j7_canonical_left_join_audit": (j7, _J7),
    "j8_multi_system_template": (j8, _J8),
    "c11_checklist": (c11, _C11),
    "u1_merge_audits": (
        lambda s, d: ev.merge_audits(_list(s, d).filter("market = 'us'").select("market", "symbol"), _list(s, d).filter("market = 'cn'").select("market", "symbol", "extracted_value")),
        "SELECT market, symbol, CASE WHEN market = 'cn' THEN extracted_value END AS extracted_value FROM {fx_checklist} WHERE market IN ('us', 'cn')",
    ),
    "p14_false_repair_details": (
        lambda s, d: ev.repaired_rows(_list(s, d), "repair_applied", ["market", "symbol", "field_name", "is_match_repair"]),
        "SELECT market, symbol, field_name, is_match_repair FROM {fx_checklist} WHERE repair_applied = '1'",
    ),
    "f15_parse_match": (
        lambda s, d: _list(s, d).select("symbol", sc.parse_match(F.col("is_match_rule")).alias("hit"), sc.parse_flag(F.col("repair_review_required")).alias("flag")),
        f"SELECT symbol, CAST({_M.format('is_match_rule')} AS INT) AS hit, CAST({_B.format('repair_review_required')} AS INT) AS flag FROM {{fx_checklist}}",
    ),
    "f12_normalize_symbol": (lambda s, d: _list(s, d).select("market", "symbol", sc.normalize_symbol(F.col("market"), F.col("symbol")).alias("normal")), f"SELECT market, symbol, {_NORM} AS normal FROM {{fx_checklist}}"),
    "a6_section_imbalance": (
        lambda s, d: an.section_imbalance(*_sections(s, d)),
        _A6 + """ SELECT section_id, p AS parent_value, CASE WHEN p IS NOT NULL AND n > 0 THEN t END AS children_sum, CASE WHEN n > 0 THEN p - t END AS diff,
        CASE WHEN p IS NULL THEN false WHEN n > 0 THEN abs(p - t) > greatest(1, abs(p) * 1e-4) ELSE true END AS is_imbalance FROM x""",
    ),
    "a7_imbalance_value_fill": (lambda s, d: an.imbalance_values(*_sections(s, d)), _A6 + " SELECT section_id, p AS marker_value FROM x WHERE n > 0 AND abs(p - t) > greatest(1, abs(p) * 1e-4)"),
    "a8_format_anomaly": (a8, _A8),
    "a9_section_flag_rollup": (
        lambda s, d: an.flag_rollup(_words(s, d).withColumnRenamed("item", "flag")),
        f"WITH {_W}, f AS (SELECT section_id, item, min(seq) AS q FROM w GROUP BY 1, 2) SELECT section_id, string_agg(item, ',' ORDER BY q, item) AS flags, CAST(count(*) AS INT) AS n_flags FROM f GROUP BY 1",
    ),
    "w13_bs_section_children": (w13, _W13),
    "f17_confidence": (
        lambda s, d: view(s, d, "part").select("p_partkey", sc.confidence(F.lit(1.0), F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 7 == 0).alias("confidence")),
        """SELECT p_partkey, CAST(round_even(greatest(0, least(1, CAST(1 AS DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN CAST(0.7 AS DOUBLE)
          ELSE 1 END * CASE WHEN p_partkey % 3 = 0 THEN CAST(0.8 AS DOUBLE) ELSE 1 END * CASE WHEN p_partkey % 5 = 0 THEN CAST(0.6 AS DOUBLE)
          ELSE 1 END * CASE WHEN p_partkey % 7 = 0 THEN CAST(0.85 AS DOUBLE) ELSE 1 END)), 4) AS DOUBLE) AS confidence FROM {part}""",
    ),
    "f23_merged_line_detect": (
        lambda s, d: _labelled(s, d).select("p_partkey", an.merged_line(F.col("label"), F.col("n_codes")).alias("is_merged")),
        f"WITH {_L}, k AS (SELECT *, replace(label, ' ', '') AS key FROM l) SELECT p_partkey, contains('应收票据及应收账款', key) OR contains('其他应收款及应收利息', key) OR contains(key, '应收票据及应收账款') OR (regexp_matches(label, '[及和与以合并计其中包含、]') AND n_codes > 1) AS is_merged FROM k",
    ),
    "f24_marker_to_section_flag": (
        f24,
        f"""WITH {_L}, k AS (SELECT *, replace(label, ' ', '') AS key FROM l) SELECT p_partkey, CASE WHEN key = '特殊不平_流动资产' THEN 'current_assets' WHEN key = '特殊格式_非流动资产' THEN 'noncurrent_assets' WHEN starts_with(key, '特殊归并') THEN 'current_assets' END AS section,
        CASE WHEN key = '特殊不平_流动资产' THEN 'IMBALANCE' WHEN key = '特殊格式_非流动资产' THEN 'FORMAT' WHEN starts_with(key, '特殊归并') THEN 'AGGREGATION' END AS flag FROM k""",
    ),
    "p10_is_anomaly_marker_row": (
        lambda s, d: an.marker_rows(_labelled(s, d).withColumn("cells", F.array(F.when(F.col("n_codes") == 0, "1,0").otherwise("—")))).select("p_partkey"),
        f"WITH {_L} SELECT p_partkey FROM l WHERE p_partkey % 7 IN (0, 1) AND n_codes <> 0",
    ),
    "c9_cash_flow_consistency": (
        lambda s, d: view(s, d, "lineitem").select("l_orderkey", "l_linenumber", an.cash_flow_consistent(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")), F.col("l_quantity")).alias("passed")),
        "SELECT l_orderkey, l_linenumber, coalesce(abs(l_quantity + l_discount + l_tax + CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE 0 END - l_quantity) < abs(l_quantity) * CAST(0.01 AS DOUBLE), false) AS passed FROM {lineitem}",
    ),
    "f16_float_close": (
        lambda s, d: view(s, d, "fx_decisions").select("case_id", sc.close(F.col("proposed_value"), F.col("candidate_value")).alias("is_close"), sc.same_or_both_null(F.col("rule_value"), F.col("proposed_value")).alias("same")),
        f"SELECT case_id, {_close.format('proposed_value', 'candidate_value')} AS is_close, (rule_value IS NULL AND proposed_value IS NULL) OR {_close.format('rule_value', 'proposed_value')} AS same FROM {{fx_decisions}}",
    ),
    "v1_build_cases_cn": (v1, _V1),
    "v4_validate_contract": (v4, _V4),
    "v5_repair_guardrails": (lambda s, d: vf.repair_guardrails(_decisions(s, d)).select(*_V5), _v5_sql("rule_status NOT IN ('MISSING', 'PARSE_ERROR')")),
    "v6_extract_guardrails": (v6, _V6),
    "v9_audit_table": (v9, _V9),
    "v10_contract_attempts": (v10, _V10),
    "w14_low_confidence_trigger": (w14, _W14),
    "j9_cross_statement_candidate": (j9, _J9),
    "a15_cost_rollup": (
        lambda s, d: view(s, d, "events").groupBy("event_type").agg(F.sum(sc.token_cost(F.col("user_id"), F.when(F.col("event_id") % 3 > 0, F.lit(10)), 1.0, 2.0).cast("decimal(38,12)")).cast("double").alias("cost")),
        "SELECT event_type, CAST(sum(CAST(user_id / 1e6 * 1 + 10 / 1e6 * 2 AS DECIMAL(38,12))) AS DOUBLE) AS cost FROM {events} WHERE event_id % 3 > 0 GROUP BY 1",
    ),
    "u4_evidence_subset_check": (
        lambda s, d: view(s, d, "part").select("p_partkey", (F.size(F.array_except(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"), F.lit("hot")))) > 0).alias("outside")),
        "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'ring', 'hot'))) > 0 AS outside FROM {part}",
    ),
}
ORACLES = {k: oracle(v[1]) for k, v in QUERIES.items() if v[1]}
QUERIES = {k: v[0] for k, v in QUERIES.items()}
