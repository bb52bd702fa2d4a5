"""Registered queries of the remaining operators: manifests, fallbacks, cases, decisions, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import evaluate as ev
from ..operators import filings as fl
from ..operators import matching as mt
from ..operators import pages as pg
from ..operators import tables as tb
from ..operators import verify as vf
from ..operators import xbrl as xb
from ..sources.shared import written
from . import page_queries as pq
from . import review_queries as rq
from . import xbrl_queries as xq
from .fixtures import oracle, view

LINES = {k: [v.replace(" ", "")] for k, v in pq.TITLES.items()}


def w12(s, d):
    found = pq._starts(s, d).filter("is_consolidated").select("doc_id", "stmt")
    return pg.title_fallback(pq._pages(s, d), found, pq.TITLES, LINES, **pq.TABLE)


_W12 = f"""WITH {pq._ST}, ll AS (SELECT doc_id, page_no, regexp_replace(line, '\\s+', '', 'g') AS x FROM {{fx_lines}}),
tl AS (SELECT doc_id, page_no, {', '.join(f"bool_or(length(x) <= 28 AND contains(x, '{v}')) AS t_{k}" for k, v in pq.TITLES.items())} FROM ll GROUP BY 1, 2),
r AS (SELECT h.*, {', '.join(f't_{k}' for k in pq.TITLES)}, max(h.page_no) OVER (PARTITION BY h.doc_id) AS last FROM h JOIN tl ON tl.doc_id = h.doc_id AND tl.page_no = h.page_no),
u AS ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS stmt, page_no, last, h_{k} AS hit, h_{k} AND tab AND t_{k} AS start FROM r" for k in pq.TITLES)}),
s0 AS (SELECT doc_id, stmt, last, min(page_no) AS start_page FROM u WHERE start GROUP BY 1, 2, 3),
s1 AS (SELECT s0.* FROM s0 WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = s0.doc_id AND st.stmt = s0.stmt AND st.is_consolidated))
SELECT s1.doc_id, s1.stmt, start_page, coalesce(min(u.page_no) - 1, least(start_page + 5, s1.last)) AS end_page FROM s1 LEFT JOIN u ON u.doc_id = s1.doc_id AND u.stmt <> s1.stmt AND u.hit AND u.page_no BETWEEN start_page + 1 AND start_page + 9 GROUP BY 1, 2, 3, s1.last"""


def w10(s, d):
    """Contents items seen in the first page only (scope 0) or in all (scope 1)."""
    toc = pq._toc(s, d)
    items = pg.toc_items(toc.filter("seq <= 3")).withColumn("scope", F.lit(0)).unionByName(pg.toc_items(toc).withColumn("scope", F.lit(1))).withColumn("seq", F.col("title"))
    totals = pq._pages(s, d).groupBy("doc_id").agg((F.max("page_no") * 3).cast("int").alias("total_pages"))
    return pg.financial_sections(items, totals, word="the", header="^(Of|And)")


_W10 = f"""WITH {pq._TOC}, n AS (SELECT doc_id, CAST(max(page_no) * 3 AS INT) AS tp FROM {{fx_lines}} GROUP BY 1),
i AS (SELECT DISTINCT doc_id, trim(title) AS title, page, scope FROM t JOIN (VALUES (0, 3), (1, 1000000)) v(scope, most) ON seq <= most WHERE length(trim(title)) >= 2 AND NOT regexp_full_match(trim(title), '[0-9]+')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scope ORDER BY page, title) AS rk FROM i), s AS (SELECT doc_id, scope, min(rk) AS rk, arg_min(page, rk) AS sp FROM r WHERE contains(title, 'the') GROUP BY 1, 2),
x AS (SELECT r.doc_id, r.scope, arg_min(r.page, r.rk) AS stop FROM r JOIN s ON r.doc_id = s.doc_id AND r.scope = s.scope WHERE r.rk > s.rk AND (regexp_matches(title, '^(Of|And)') OR page > sp + 5) GROUP BY 1, 2),
e AS (SELECT s.doc_id, s.scope, greatest(1, least(sp, tp)) AS a, greatest(greatest(1, least(sp, tp)), least(coalesce(greatest(stop - 1, sp), tp), tp)) AS b FROM s JOIN n ON n.doc_id = s.doc_id LEFT JOIN x ON x.doc_id = s.doc_id AND x.scope = s.scope)
SELECT doc_id, arg_min(a, scope) AS start_page, arg_min(b, scope) AS end_page FROM e GROUP BY 1"""


def v2(s, d):
    # the pool, its first facts and the chosen ones are ranked from one table
    scored = written(xq._scored(s, d).drop("start_date", "end_date", "instant", "report_date", "value_raw"))
    top = written(xb.top_facts(scored, 3))
    chosen = xb.choose_facts(scored).withColumn("field", F.when(F.col("stmt") == "CF", "net_income").otherwise(F.col("field"))).groupBy("filing_id", "stmt", "field").agg(F.max("value").alias("value"))
    out = vf.cross_candidates(rq.triggers(top), top, chosen, 2)
    return out.select("filing_id", "stmt", "field", "reason", F.array_join(F.transform("candidates", lambda c: c["item_code"]), ",").alias("codes"))


_V2 = f"""WITH ca AS ({rq._W14}), cx AS (WITH {xq._ctes()}, d AS {xq._best('q', 'filing_id, stmt, field, tag, context_ref, value', 'fact_seq')},
  k AS (SELECT *, row_number() OVER (PARTITION BY filing_id, stmt, field ORDER BY score DESC, fact_seq) AS rk FROM d) SELECT filing_id, stmt, field, rk AS pos, stmt || '.' || field || '.fact.' || rk AS code, value FROM k WHERE rk <= 2),
va AS (WITH {xq._ctes()}, b AS {xq._CHOSEN} SELECT filing_id, stmt, CASE WHEN stmt = 'CF' THEN 'net_income' ELSE field END AS field, max(value) AS value FROM b GROUP BY ALL),
ro AS (SELECT cx.* FROM cx JOIN ca USING (filing_id, stmt, field) WHERE reason IS NOT NULL UNION ALL SELECT filing_id, stmt, field, 100, stmt || '.' || field, value FROM va
  UNION ALL SELECT filing_id, CASE stmt WHEN 'IS' THEN 'CF' ELSE 'IS' END, field, 101, stmt || '.' || field, value FROM va WHERE field = 'net_income' AND stmt IN ('IS', 'CF')),
fo AS (SELECT filing_id, stmt, field, string_agg(code, ',' ORDER BY pos, code) AS codes FROM (SELECT filing_id, stmt, field, code, min(pos) AS pos FROM ro WHERE value IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3)
SELECT ca.filing_id, ca.stmt, ca.field, reason, codes FROM ca LEFT JOIN fo USING (filing_id, stmt, field)"""


def v3(s, d):
    return rq.v1(s, d).select("doc_id", "stmt", "field", F.to_json(F.struct("stmt", "field", "codes")).alias("payload"))


def v7(s, d):
    rows = rq._decisions(s, d).withColumn("decision", F.when(F.col("decision") == "KEEP", "EXTRACT").otherwise(F.col("decision")))
    rows = rows.withColumn("proposed_status", F.when(F.col("case_id") % 4 == 0, "NOT_APPLICABLE").otherwise("OK")).withColumn("na_quoted", F.col("case_id") % 8 == 0)
    done = vf.doc_guardrails(rows.filter("case_id % 6 > 0")).select("case_id", "guard_fail", "final_decision", "final_value", "review_required")
    return vf.fill_missing_fields(rows.select("case_id"), done, ["case_id"], "no_result_for_field")


_V7 = f"""WITH {rq._D}, e AS (SELECT * REPLACE (CASE WHEN decision = 'KEEP' THEN 'EXTRACT' ELSE decision END AS decision), case_id % 4 = 0 AS na FROM d),
g AS (SELECT *, CASE WHEN decision = 'EXTRACT' THEN CASE WHEN n_evidence = 0 THEN 'missing_evidence' WHEN NOT na AND proposed_value IS NULL THEN 'missing_proposed_value' WHEN na AND case_id % 8 <> 0 THEN 'unsupported_not_applicable' END END AS gf, case_id % 6 > 0 AS has FROM e),
k AS (SELECT *, CASE WHEN NOT has OR gf IS NOT NULL THEN 'NEED_REVIEW' ELSE decision END AS fd FROM g)
SELECT case_id, CASE WHEN has THEN gf ELSE 'no_result_for_field' END AS guard_fail, fd AS final_decision, CASE WHEN fd = 'EXTRACT' AND NOT na THEN proposed_value END AS final_value, fd <> 'EXTRACT' AS review_required FROM k"""


def v8(s, d):
    two = F.array(F.struct(F.lit("A").alias("item_code"), F.col("event_id").cast("double").alias("value")), F.struct(F.lit("B").alias("item_code"), F.lit(None).cast("double").alias("value")))
    rows = view(s, d, "events").select("event_id", vf.evidence(F.array(F.lit("B"), F.lit("C")), two, F.when(F.col("event_id") % 2 == 0, "because")).alias("e"))
    return rows.select("event_id", F.size("e").alias("n"), F.col("e")[0]["quote"].alias("quote"), F.col("e")[0]["why"].alias("why"))


def v13(s, d):
    rows = rq._decisions(s, d).withColumn("decision", F.when(F.col("decision") == "KEEP", "EXTRACT").otherwise(F.col("decision"))).withColumn("proposed_status", F.lit("OK")).withColumn("supports_na", F.lit(False))
    done = vf.extract_guardrails(rows.filter("case_id % 5 > 0")).select("case_id", "guard_fail", "final_decision", "final_value", "review_required")
    return vf.fill_missing_fields(rows.select("case_id"), done, ["case_id"], "llm_call_failed")


_V13 = f"""WITH {rq._D}, e AS (SELECT * REPLACE (CASE WHEN decision = 'KEEP' THEN 'EXTRACT' ELSE decision END AS decision) FROM d),
g AS (SELECT *, CASE WHEN decision = 'EXTRACT' THEN CASE WHEN n_evidence = 0 THEN 'missing_evidence' WHEN proposed_value IS NULL THEN 'missing_proposed_value' WHEN NOT supported THEN 'unsupported_extract_value' END END AS gf, case_id % 5 > 0 AS has FROM e),
k AS (SELECT *, CASE WHEN NOT has OR gf IS NOT NULL THEN 'NEED_REVIEW' ELSE decision END AS fd FROM g)
SELECT case_id, CASE WHEN has THEN gf ELSE 'llm_call_failed' END AS guard_fail, fd AS final_decision, CASE WHEN fd = 'EXTRACT' THEN proposed_value END AS final_value, fd <> 'EXTRACT' AS review_required FROM k"""


def f21(s, d):
    text = F.concat(F.lit('```json\n{"decision": " keep", "proposed_value": '), F.col("user_id").cast("string"), F.lit(', "evidence_item_codes": ["A ", "", "B", "A"]}\n```'))
    old = F.lit('{"decision": "REPAIR", "evidence": [{"item_code": " C"}, {"item_code": "C"}]}')
    rows = view(s, d, "events").select("event_id", vf.parse_decision(F.when(F.col("event_id") % 2 == 0, text).otherwise(old)).alias("p"))
    return rows.select("event_id", "p.decision", "p.proposed_value", "p.proposed_status", F.array_join("p.codes", ",").alias("codes"))


def f22(s, d):
    states = F.array(*(F.element_at(F.array(F.lit("ok"), F.lit(" parse_error"), F.lit("NOT_APPLICABLE"), F.lit("x")), ((F.col("event_id") / k).cast("long") % 4 + 1).cast("int")) for k in (1, 4)))
    return view(s, d, "events").select("event_id", vf.rule_status(F.when(F.col("event_id") % 3 == 0, F.col("value")), states).alias("status"))


def c10(s, d):
    chart = view(s, d, "fx_coa").filter("ordinal % 5 < 4")
    cells = pq._cells(s, d).withColumn("text", F.when((F.col("col_no") == 2) & (F.col("row_no") % 18 == 0), "").otherwise(F.col("text")))
    matches = mt.match_items(cells.filter("col_no = 0").select(F.trim("text").alias("raw_item")).distinct(), chart)
    best = tb.best_columns(tb.content_scores(pq._cells(s, d)).select("table_id", "col_no", F.round("score", 3).alias("score")))
    return tb.extract_items(cells, best, matches).select("table_id", "row_no", "item_code", "value", "status", "is_fallback")


_C10 = f"""WITH n AS (SELECT DISTINCT trim(text) AS raw_item, replace(trim(text), ' ', '') AS clean FROM {{fx_cells}} WHERE col_no = 0), {pq._TIERS},
a AS (SELECT table_id, col_no, abs({pq._NUM}) AS v FROM {{fx_cells}}), g AS (SELECT table_id, col_no, count(v) AS n, count(*) FILTER (v >= 10000) AS big, count(*) FILTER (v <= 999) AS small, CAST(sum(CAST(least(12, log10(v + 1)) AS DECIMAL(38,6))) AS DOUBLE) AS m FROM a GROUP BY 1, 2),
s AS (SELECT table_id, col_no, round(CASE WHEN n = 0 THEN -200 ELSE n * 6 + big * 10 - small * 2 + m - CASE WHEN big = 0 AND small / greatest(n, 1) >= 0.7 THEN 140 ELSE 0 END END, 3) AS score FROM g),
b AS (SELECT table_id, arg_min(col_no, (-score, col_no)) AS best FROM s GROUP BY 1),
t AS (SELECT table_id, row_no, col_no, CASE WHEN col_no = 2 AND row_no % 18 = 0 THEN '' ELSE text END AS text FROM {{fx_cells}} WHERE col_no > 0),
x AS (SELECT t.table_id, row_no, text, CASE WHEN col_no = best THEN -1 ELSE col_no END AS o, {pq._NUM} AS v FROM t JOIN b ON b.table_id = t.table_id),
y AS (SELECT table_id, row_no, arg_min(v, o) FILTER (v IS NOT NULL) AS v, min(o) FILTER (v IS NOT NULL) AS o, max(trim(text)) FILTER (o = -1) AS raw FROM x GROUP BY 1, 2)
SELECT q.table_id, q.row_no, m.item_code, v AS value, CASE WHEN v IS NOT NULL THEN 'OK' WHEN coalesce(raw, '') <> '' THEN 'PARSE_ERROR' ELSE 'MISSING' END AS status, coalesce(o > -1, false) AS is_fallback
FROM {{fx_cells}} q JOIN n ON n.raw_item = trim(q.text) JOIN m ON m.clean = n.clean AND m.item_code IS NOT NULL LEFT JOIN y ON y.table_id = q.table_id AND y.row_no = q.row_no WHERE q.col_no = 0"""


def c12(s, d):
    facts, contexts, _, _ = xq._inputs(s, d)
    tags = lambda t: xb.text_facts(facts, contexts, s.createDataFrame([(t, 0)], "tag string, tag_pos int"))
    filings = view(s, d, "fx_filings").select(
        "filing_id", F.when(F.col("filing_id") % 2 == 0, F.concat(F.lit("S"), (F.col("filing_id") + 10000000000).cast("string"), F.lit(".zip"))).otherwise(F.concat(F.lit("doc"), "filing_id", F.lit(".zip"))).alias("file_name"),
        F.when(F.col("filing_id") % 3 == 0, F.col("symbol_raw")).alias("given_symbol"), F.when(F.col("filing_id") % 5 == 0, "2020/3/31").alias("given_period_end"), F.when(F.col("filing_id") % 7 == 0, "訂正有価証券報告書").otherwise("有価証券報告書").alias("description"),
    )
    texts = {"sec_code": tags("Assets"), "filer_name": tags("ProfitLoss"), "period_end": tags("Liabilities").withColumn("text", F.lit(None).cast("string")), "filing_date": tags("Assets").withColumn("text", F.lit("2021年6月1日"))}
    return fl.jp_filing_metadata(filings, texts, xb.infer_report_dates(contexts))


_C12 = f"""WITH {xq._ctes()}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, tag ORDER BY is_consolidated DESC, fact_seq) AS rn FROM j WHERE tag IN ('Assets', 'ProfitLoss')) WHERE rn = 1),
m AS (SELECT filing_id, 'x' AS x FROM {{fx_filings}}), rd AS ({{a10}})
SELECT f.filing_id, nullif(left(regexp_replace(CASE WHEN f.filing_id % 3 = 0 THEN symbol_raw ELSE a.value_raw END, '[^0-9]', '', 'g'), 4), '') AS sec_code, p.value_raw AS filer_name,
  CASE WHEN f.filing_id % 5 = 0 THEN '2020-03-31' ELSE CAST(rd.report_date AS VARCHAR) END AS period_end, CASE WHEN a.filing_id IS NOT NULL THEN '2021-06-01' END AS filing_date,
  CASE WHEN f.filing_id % 2 = 0 THEN 'S' || (f.filing_id + 10000000000) ELSE 'LOCAL_doc' || f.filing_id END AS doc_id, f.filing_id % 7 = 0 AS is_amendment
FROM {{fx_filings}} f LEFT JOIN t a ON a.filing_id = f.filing_id AND a.tag = 'Assets' LEFT JOIN t p ON p.filing_id = f.filing_id AND p.tag = 'ProfitLoss' LEFT JOIN rd ON rd.filing_id = f.filing_id"""
_A10 = """WITH c2 AS (SELECT *, date_diff('day', start_date, end_date) AS dd FROM {fx_contexts}), v2 AS (SELECT filing_id, end_date AS day, 2 + CASE WHEN is_consolidated THEN 8 ELSE 0 END + CASE WHEN dd BETWEEN 300 AND 380 THEN 10 WHEN dd > 0 THEN 1 ELSE 0 END AS s FROM c2 WHERE end_date IS NOT NULL
 UNION ALL SELECT filing_id, instant, 1 + CASE WHEN is_consolidated THEN 4 ELSE 0 END FROM c2 WHERE instant IS NOT NULL),
   g2 AS (SELECT filing_id, day, sum(s) AS score FROM v2 GROUP BY ALL) SELECT filing_id, day AS report_date FROM (SELECT *,
   row_number() OVER (PARTITION BY filing_id ORDER BY score DESC, day DESC) AS rn FROM g2) WHERE rn = 1"""


def s12(s, d):
    files = view(s, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("/zip/"), F.col("p_partkey") % 200, F.lit(".zip")).alias("path"))
    return fl.zip_manifest(view(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol")), files)


QUERIES = {
    "w12_title_fallback_search": (w12, _W12),
    "w10_toc_scope_cascade": (w10, _W10),
    "v2_build_cases_us_jp": (v2, _V2),
    "v3_build_request_payload": (v3, "WITH r AS (" + rq._V1 + """) SELECT doc_id, stmt, field, '{"stmt":"' || stmt || '","field":"' || field || '","codes":"' || codes || '"}' AS payload FROM r"""),
    "v7_doc_guardrails": (v7, _V7),
    "v8_evidence_rendering": (v8, "SELECT event_id, 1 AS n, 'value: None' AS quote, CASE WHEN event_id % 2 = 0 THEN 'because' ELSE 'Supported by candidate evidence.' END AS why FROM {events}"),
    "v13_llm_only_audit": (v13, _V13),
    "f8_latest_header_date": (
        lambda s, d: view(s, d, "orders").select("o_orderkey", sc.latest_header_date(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("期末 2001年1月5日 "), F.date_format("o_orderdate", "yyyy.M.d"))).otherwise(F.concat((2000 + F.col("o_orderkey") % 20).cast("string"), F.lit("年度 2003年")))).alias("day")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN year(o_orderdate) >= 2000 THEN greatest(DATE '2001-01-05', CAST(o_orderdate AS DATE)) ELSE DATE '2001-01-05' END ELSE make_date(greatest(2003, CAST(2000 + o_orderkey % 20 AS INT)), 12, 31) END AS day FROM {orders}",
    ),
    "f21_parse_decision_json": (
        f21,
        "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'KEEP' ELSE 'REPAIR' END AS decision, CAST(CASE WHEN event_id % 2 = 0 THEN user_id END AS DOUBLE) AS proposed_value, 'UNCHANGED' AS proposed_status, CASE WHEN event_id % 2 = 0 THEN 'A,B' ELSE 'C' END AS codes FROM {events}",
    ),
    "f22_derive_rule_status": (
        f22,
        "SELECT event_id, CASE WHEN event_id % 3 = 0 AND value IS NOT NULL THEN 'OK' WHEN event_id % 4 = 1 OR (event_id // 4) % 4 = 1 THEN 'PARSE_ERROR' WHEN event_id % 4 = 2 OR (event_id // 4) % 4 = 2 THEN 'NOT_APPLICABLE' ELSE 'MISSING' END AS status FROM {events}",
    ),
    "c10_extract_current_year_items": (c10, _C10),
    "c12_jp_filing_metadata": (c12, _C12.replace("{a10}", _A10)),
    "s12_jp_zip_manifest": (
        s12,
        """WITH f AS (SELECT DISTINCT CAST(p_partkey % 200 AS VARCHAR) AS symbol FROM {part} WHERE p_partkey % 3 = 0) SELECT CAST(s_suppkey AS VARCHAR) AS symbol,
          CASE WHEN f.symbol IS NOT NULL THEN '/zip/' || f.symbol || '.zip' END AS path, CASE WHEN f.symbol IS NULL THEN 'missing'
          ELSE 'ok' END AS status FROM {supplier} LEFT JOIN f ON f.symbol = CAST(s_suppkey AS VARCHAR)""",
    ),
    "t7_max_fields_limit": (
        lambda s, d: fl.first_per_group(view(s, d, "fx_decisions").select("company_key", "input_seq", "case_id"), "company_key", "input_seq", 4),
        "SELECT company_key, input_seq, case_id FROM {fx_decisions} WHERE input_seq <= 4",
    ),
    "u3_markets_union": (
        lambda s, d: fl.markets_union(*(view(s, d, "fx_filings").filter(f"market = '{m}'").select("filing_id", "market", *cols) for m, cols in (("us", ["form_type"]), ("jp", ["symbol_raw"]), ("cn", [])))),
        "SELECT filing_id, market, CASE WHEN market = 'us' THEN form_type END AS form_type, CASE WHEN market = 'jp' THEN symbol_raw END AS symbol_raw FROM {fx_filings}",
    ),
    "p3_default_columns": (
        lambda s, d: ev.require_columns(view(s, d, "fx_checklist").select("market", "symbol"), ["market"], {"review_required": 1, "repair_applied": 0}),
        "SELECT market, symbol, 1 AS review_required, 0 AS repair_applied FROM {fx_checklist}",
    ),
}
ORACLES = {k: oracle(v[1]) for k, v in QUERIES.items() if v[1]}
QUERIES = {k: v[0] for k, v in QUERIES.items()}
