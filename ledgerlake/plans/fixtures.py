"""Views that give the filing operators realistic input from the driver's tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import specs

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

VIEWS = {
    "fx_filings": """
SELECT DISTINCT l_suppkey * 10000 + year(l_shipdate) AS filing_id, l_suppkey AS company_key,
  CASE l_suppkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'jp' ELSE 'cn' END AS market,
  CAST(l_suppkey AS STRING) AS symbol_raw,
  CASE WHEN l_suppkey % 10 = 0 THEN '10-K/A' ELSE '10-K' END AS form_type,
  make_date(year(l_shipdate), 12, 31) AS report_date,
  make_date(year(l_shipdate) + 1, CAST(1 + l_suppkey % 3 AS INT), 15) AS filing_date
FROM {lineitem}""",
    "fx_facts": """
SELECT l_suppkey * 10000 + year(l_shipdate) AS filing_id,
  CAST(row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate)
                          ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS BIGINT) AS fact_seq,
  CASE l_returnflag || l_linestatus
    WHEN 'AF' THEN 'NetIncomeLoss' WHEN 'AO' THEN 'ProfitLoss' WHEN 'NF' THEN 'Assets' WHEN 'NO' THEN 'Liabilities'
    WHEN 'RF' THEN 'NetCashProvidedByUsedInOperatingActivities' ELSE 'NetCashProvidedByUsedInInvestingActivities' END AS tag,
  'c' || CAST(l_linenumber AS STRING) || CASE WHEN l_discount < 0.05 THEN 'C' ELSE 'S' END AS context_ref,
  CASE WHEN l_tax < 0.03 THEN 'USD' WHEN l_tax < 0.06 THEN 'usd/shares' ELSE 'EUR' END AS unit_ref,
  CASE WHEN l_quantity >= 48 THEN '-' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS value_raw
FROM {lineitem}""",
    "fx_contexts": """
SELECT filing_id, context_ref AS context_id,
  CASE WHEN k <= 3 THEN make_date(y, 1, 1) WHEN k = 4 THEN make_date(y, 10, 1) WHEN k = 5 THEN make_date(y - 1, 1, 1) END AS start_date,
  CASE WHEN k <= 4 THEN make_date(y, 12, 31) WHEN k = 5 THEN make_date(y - 1, 12, 31) END AS end_date,
  CASE WHEN k = 6 THEN make_date(y, 12, 31) WHEN k = 7 THEN make_date(y - 1, 12, 31) END AS instant,
  cons = 'C' AS is_consolidated
FROM (SELECT DISTINCT filing_id, context_ref, CAST(filing_id % 10000 AS INT) AS y,
             CAST(substr(context_ref, 2, 1) AS INT) AS k, substr(context_ref, 3, 1) AS cons
      FROM {fx_facts}) s
WHERE NOT (filing_id % 17 = 0 AND k = 2)""",
    "fx_section_items": """
SELECT l_orderkey AS section_id, l_linenumber AS child_no, l_partkey AS item_key,
  CASE WHEN l_quantity >= 48 THEN NULL ELSE l_extendedprice * (1 - l_discount) * (1 + l_tax) END AS value
FROM {lineitem}""",
    "fx_sections": """
SELECT o.o_orderkey AS section_id, o.o_custkey AS doc_id,
  CASE WHEN o.o_orderkey % 10 = 0 THEN NULL WHEN o.o_orderkey % 3 = 0 THEN o.o_totalprice
       ELSE CAST(coalesce(t.s, 0) AS DOUBLE) END AS parent_value
FROM {orders} o LEFT JOIN (
  SELECT section_id, sum(CAST(round(value * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS s FROM {fx_section_items} GROUP BY section_id) t ON t.section_id = o.o_orderkey""",
    "fx_checklist": """
SELECT CASE d.lang WHEN 'en' THEN 'us' WHEN 'de' THEN 'cn' ELSE 'jp' END AS market, CAST(d.doc_id AS STRING) AS symbol,
  CASE d.doc_id % 3 WHEN 0 THEN 'IS' WHEN 1 THEN 'BS' ELSE 'CF' END AS statement, d.source AS field_name,
  CASE WHEN d.n_chars % 10 = 0 THEN NULL ELSE CAST(d.n_chars AS DOUBLE) END AS extracted_value,
  CASE l.quality WHEN 1 THEN ' Yes' WHEN 0 THEN 'NG' END AS is_match_rule,
  CASE l.toxic WHEN 0 THEN 'true' WHEN 1 THEN '0' END AS is_match_repair,
  CASE WHEN d.doc_id % 4 = 0 THEN '1.0' WHEN d.doc_id % 4 = 1 THEN 'no' END AS repair_review_required,
  CASE WHEN d.doc_id % 5 = 0 THEN '1' ELSE '0' END AS repair_applied
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "fx_decisions": """
SELECT event_id AS case_id, user_id AS company_key,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS input_seq,
  CASE event_type WHEN 'error' THEN 'NEED_REVIEW' WHEN 'purchase' THEN 'REPAIR' WHEN 'signup' THEN 'bogus' ELSE 'KEEP' END AS decision,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS rule_value,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS proposed_value,
  CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS candidate_value,
  CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS n_evidence, props
FROM {events}""",
    "fx_cells": """
SELECT p_brand AS table_id, row_no, col_no, CASE col_no
    WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS STRING)
    WHEN 2 THEN CASE WHEN row_no % 9 = 0 THEN '-' ELSE CAST(CAST(p_retailprice * 100 AS DECIMAL(18,2)) AS STRING) END
    ELSE '(' || CAST(CAST(p_retailprice * 90 AS DECIMAL(18,2)) AS STRING) || ')' END AS text
FROM (SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS row_no, p_name, p_size, p_retailprice FROM {part}) r
CROSS JOIN (SELECT 0 AS col_no UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c""",
    "fx_labels": "SELECT DISTINCT p_name AS raw_item FROM {part}",
    "fx_coa": """
SELECT CAST(row_number() OVER (ORDER BY nm) AS BIGINT) AS ordinal, 'C_' || upper(replace(nm, ' ', '_')) AS item_code, nm AS item_name_std
FROM (SELECT DISTINCT p_name AS nm FROM {part} WHERE p_name < 'n'
      UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM {part} WHERE split_part(p_name, ' ', 2) < 'n') u""",
}


def _tags(values) -> str:
    """The distinct tags, numbered, as a VALUES list."""
    return ", ".join(f"({i}, '{t}')" for i, t in enumerate(dict.fromkeys(values)))


_US_TAGS = _tags([*(t for f in specs.US_FIELDS for t in f[2]), "OtherEffectOfExchangeRateChangesOnCash"])
_JP_TAGS = _tags(t for f in specs.JP_CHAINS for choice in f[2] for t in choice)
#: The facts above under all official tags in turn, and with the units that the specs ask for.
VIEWS["fx_us_facts"] = f"""
SELECT f.filing_id, f.fact_seq, t.tag, f.context_ref, CASE WHEN f.unit_ref = 'EUR' AND f.fact_seq % 2 = 0 THEN 'shares' ELSE f.unit_ref END AS unit_ref, f.value_raw
FROM {{fx_facts}} f JOIN (VALUES {_US_TAGS}) AS t(i, tag) ON (f.fact_seq * 7 + f.filing_id) % {_US_TAGS.count("(")} = t.i"""
VIEWS["fx_jp_facts"] = f"""
SELECT f.filing_id, f.fact_seq, t.tag, f.context_ref, CASE f.unit_ref WHEN 'USD' THEN 'JPY' WHEN 'EUR' THEN 'JPY/shares' ELSE 'shares' END AS unit_ref, f.value_raw
FROM {{fx_facts}} f JOIN (VALUES {_JP_TAGS}) AS t(i, tag) ON (f.fact_seq * 7 + f.filing_id) % {_JP_TAGS.count("(")} = t.i"""
#: One line a row; a page is three lines. The only view whose text differs between the engines.
_LINES = {
    "spark": r"SELECT doc_id, CAST(pos + 1 AS BIGINT) AS line_no, CAST(pos DIV 3 + 1 AS BIGINT) AS page_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) AS pos, line",
    "duckdb": "SELECT doc_id, i AS line_no, (i - 1) // 3 + 1 AS page_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) AS r(i)",
}
_PAGES = "SELECT doc_id, page_no, {joined} AS text FROM {fx_lines} GROUP BY doc_id, page_no"


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of the views, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "fx_lines":
        sql = _LINES["spark"]
    elif name == "fx_pages":
        sql = _PAGES.replace("{joined}", r"array_join(transform(array_sort(collect_list(struct(line_no, line))), x -> x.line), '\n')")
    else:
        sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _names(sql)})


def oracle(sql: str) -> str:
    """DuckDB text: {names} of views become CTEs in front, {names} of tables stand for the tables."""
    ctes: dict[str, str] = {}

    def add(text: str) -> str:
        for n in _names(text):
            if n not in TABLES and n not in ctes:
                body = _LINES["duckdb"] if n == "fx_lines" else _PAGES.replace("{joined}", "string_agg(line, chr(10) ORDER BY line_no)") if n == "fx_pages" else VIEWS[n]
                ctes[n] = add(body)
        return re.sub(r"\{(\w+)\}", r"\1", text)

    main = add(sql).strip()
    head = ", ".join(f"{n} AS ({body.strip()})" for n, body in ctes.items())
    if not head:
        return main
    return f"WITH {head}, {main[5:]}" if main.upper().startswith("WITH ") else f"WITH {head} {main}"
