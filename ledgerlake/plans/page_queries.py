"""Registered queries of the page and table operators with their SQL oracles. Latin stand-ins serve as patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import matching as mt
from ..operators import pages as pg
from ..operators import tables as tb
from .fixtures import oracle, view

WORDS, WORD_SQL = "(tion|que|schaft)", "regexp_matches(text, '(tion|que|schaft)')"
TITLES = {"one": "thea", "two": "onen", "three": "ered"}
CONS = {"one": "the thea", "two": "of onen", "three": "in ered"}
TABLE = {"words": "ingth"}
_TAB = "coalesce(regexp_matches(text, 'ingth') OR (dg > 40 AND dg / greatest(length(text), 1) > 0.08), false)"
_PG = f"pg AS (SELECT *, {_TAB} AS tab FROM (SELECT *, length(regexp_replace(text, '[^0-9]', '', 'g')) AS dg FROM {{fx_pages}}))"


def _pages(s, d):
    return view(s, d, "fx_pages")


def _starts(s, d):
    return pg.statement_starts(_pages(s, d), TITLES, CONS, **TABLE)


_ST = f"""{_PG}, h AS (SELECT doc_id, page_no, tab, {', '.join(f"regexp_matches(text, '{p}') AS h_{k}, regexp_matches(text, '{CONS[k]}') AS c_{k}" for k, p in TITLES.items())} FROM pg),
k AS (SELECT * FROM h WHERE CAST(h_one AS INT) + CAST(h_two AS INT) + CAST(h_three AS INT) < 2 OR tab),
f AS ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS stmt, page_no, c_{k} AS cons FROM k WHERE h_{k} OR c_{k}" for k in TITLES)}),
st AS (SELECT doc_id, stmt, page_no AS start_page, cons AS is_consolidated FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stmt ORDER BY cons DESC, page_no) AS rn FROM f) WHERE rn = 1)"""
_EX = f"""{_ST}, e AS (SELECT st.*, page_no, tab, NOT tab AND NOT coalesce(lag(tab) OVER (PARTITION BY st.doc_id, stmt ORDER BY page_no), true) AS gone FROM st JOIN pg ON pg.doc_id = st.doc_id AND page_no >= start_page),
z AS (SELECT *, min(page_no) FILTER (gone) OVER (PARTITION BY doc_id, stmt) AS stop FROM e),
ex AS (SELECT doc_id, stmt, start_page, is_consolidated, coalesce(max(page_no) FILTER (tab), start_page) AS end_page, count(*) FILTER (tab) AS table_pages FROM z WHERE stop IS NULL OR page_no < stop GROUP BY 1, 2, 3, 4)"""
_TI = f"{_EX}, ti AS (SELECT * REPLACE (greatest(start_page, least(end_page, coalesce(lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page, stmt) - 1, end_page), start_page + 9)) AS end_page) FROM ex)"


def _blocks(s, d):
    return pg.expand_blocks(_starts(s, d), _pages(s, d), **TABLE)


def _lines(s, d):
    return view(s, d, "fx_lines")


def _toc(s, d):
    """Contents lines made of page lines: a title of two words and the page times three."""
    line = F.concat(F.substring_index("line", " ", 2), F.lit(" ..... "), (F.col("page_no") * 3).cast("string"))
    return _lines(s, d).filter("line_no % 3 = 1").select("doc_id", line.alias("line"), F.col("line_no").alias("seq"))


_TOC = "t AS (SELECT doc_id, array_to_string(string_split(line, ' ')[1:2], ' ') AS title, CAST(page_no * 3 AS INT) AS page, line_no AS seq FROM {fx_lines} WHERE line_no % 3 = 1)"


def w9(s, d):
    items = pg.toc_items(_toc(s, d)).withColumn("seq", F.col("title"))
    totals = _pages(s, d).groupBy("doc_id").agg((F.max("page_no") * 3).cast("int").alias("total_pages"))
    return pg.financial_sections(items, totals, word="the", header="^(Of|And)")


_W9 = f"""WITH {_TOC}, i AS (SELECT DISTINCT doc_id, trim(title) AS title, page FROM t WHERE length(trim(title)) >= 2 AND NOT regexp_full_match(trim(title), '[0-9]+')), n AS (SELECT doc_id, CAST(max(page_no) * 3 AS INT) AS tp FROM {{fx_lines}} GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, title) AS rk FROM i), s AS (SELECT doc_id, min(rk) AS rk, arg_min(page, rk) AS sp FROM r WHERE contains(title, 'the') GROUP BY 1),
x AS (SELECT r.doc_id, arg_min(r.page, r.rk) AS stop FROM r JOIN s ON r.doc_id = s.doc_id WHERE r.rk > s.rk AND (regexp_matches(title, '^(Of|And)') OR page > sp + 5) GROUP BY 1)
SELECT s.doc_id, greatest(1, least(sp, tp)) AS start_page, greatest(greatest(1, least(sp, tp)), least(coalesce(greatest(stop - 1, sp), tp), tp)) AS end_page FROM s JOIN n ON n.doc_id = s.doc_id LEFT JOIN x ON x.doc_id = s.doc_id"""


def _cells(s, d):
    return view(s, d, "fx_cells")


_NUM = """CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN CASE WHEN starts_with(text, '(') THEN -1 ELSE 1 END * CAST(regexp_extract(text, '[0-9]{4,}([.][0-9]+)?') AS DOUBLE)
  WHEN regexp_matches(text, '[0-9]+[.][0-9]+') THEN CASE WHEN starts_with(text, '(') THEN -1 ELSE 1 END * CAST(regexp_extract(text, '[0-9]+[.][0-9]+') AS DOUBLE) WHEN regexp_full_match(text, '[0-9]+') THEN CAST(text AS DOUBLE) END"""


def _headed(s, d):
    """Tables with a header row: dated ones (k 0, 1), ones with period words (2), bare ones (3)."""
    k = F.substring("table_id", 7, 9).cast("int") % 4
    dated = F.when(F.col("col_no") == 1, "2019年").when((F.col("col_no") == 2) & (k == 0), "2021年12月31日").when(k == 0, "2020年").when(F.col("col_no") == 2, "2020年度").otherwise("2022年")
    words = F.when(F.col("col_no") == 3, "本期金额").otherwise("上期金额")
    head = F.when(F.col("col_no") == 0, "项目").when(k < 2, dated).when(k == 2, words).otherwise("x")
    return _cells(s, d).withColumn("text", F.when(F.col("row_no") == 1, head).otherwise(F.col("text")))


def _contents_pages(s, d):
    """Pages of part lines: with dots and a number, with a number, with dots only, and bare ones."""
    k = F.col("p_partkey") % 4
    line = F.concat("p_name", F.when(k == 0, F.concat(F.lit(" ... "), F.col("p_size").cast("string"))).when(k == 1, F.concat(F.lit("  "), F.col("p_size").cast("string"))).when(k == 2, "...").otherwise(""))
    rows = view(s, d, "part").select(F.col("p_brand").alias("doc_id"), (F.col("p_size") % 10).alias("page_no"), F.struct("p_partkey", line.alias("line")).alias("x"))
    return rows.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


_CONTENTS = """SELECT p_brand AS doc_id, CAST(p_size % 10 AS INT) AS page_no, bool_or(contains(p_name, 'red')) AND (count(*) FILTER (p_partkey % 4 = 0) >= 2 OR count(*) FILTER (p_partkey % 4 < 2) >= 6) AS is_toc
FROM {part} GROUP BY 1, 2"""


def _dated_year(c):
    """The year over column c of a table, from its number."""
    return 2000 + (F.substring("table_id", 7, 9).cast("int") * (3 * c + 1)) % 23


def _dated(s, d):
    """Tables whose header row has a day over most columns; over some only a word."""
    n = F.substring("table_id", 7, 9).cast("int")
    day = F.when(F.col("col_no") == 1, _dated_year(1)).when(F.col("col_no") == 2, _dated_year(2)).otherwise(_dated_year(3))
    head = F.when(F.col("col_no") == 0, "项目").when((F.col("col_no") == 2) & (n % 3 == 0), "金额").otherwise(F.concat(day.cast("string"), F.lit("年12月31日")))
    return _cells(s, d).withColumn("text", F.when(F.col("row_no") == 1, head).otherwise(F.col("text")))


_DATED = """WITH h AS (SELECT DISTINCT table_id, CAST(substr(table_id, 7) AS INT) AS n, col_no FROM {fx_cells} WHERE col_no > 0),
y AS (SELECT table_id, col_no, CASE WHEN col_no = 2 AND n % 3 = 0 THEN -1 ELSE 2000 + (n * (3 * col_no + 1)) % 23 END AS year FROM h)
SELECT table_id, CAST(col_no AS INT) AS col_no, 'date' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY year DESC, col_no) AS rn FROM y) z WHERE rn = 1"""


def _items(s, d):
    p = F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ("OK", "MISSING", "PARSE_ERROR", "NOT_APPLICABLE"))), (p % 4 + 1).cast("int"))
    return view(s, d, "part").select(F.col("p_brand").alias("doc_id"), F.when(F.col("p_size") % 2 == 0, "BS").otherwise("IS").alias("stmt"), F.element_at(F.split("p_name", " "), 2).alias("item_code"), F.when(p % 4 == 0, F.col("p_retailprice")).alias("value"), status.alias("status"), p.alias("seq"), F.when(p % 3 == 0, "stream").otherwise("lattice").alias("method"))


_I = """i AS (SELECT p_brand AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'BS' ELSE 'IS' END AS stmt, split_part(p_name, ' ', 2) AS item_code,
  CASE WHEN p_partkey % 4 = 0 THEN p_retailprice END AS value, ['OK', 'MISSING', 'PARSE_ERROR', 'NOT_APPLICABLE'][p_partkey % 4 + 1] AS status,
  p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'stream' ELSE 'lattice' END AS method FROM {part})"""
_BESTI = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stmt, item_code ORDER BY CASE status WHEN 'OK' THEN 4 WHEN 'NOT_APPLICABLE' THEN 3 WHEN 'PARSE_ERROR' THEN 2 WHEN 'MISSING' THEN 1 ELSE 0 END DESC, seq) AS rn FROM i) WHERE rn = 1)"


def j4_tiers(s, d):
    chart = view(s, d, "fx_coa").filter("ordinal % 5 < 4")
    labels = view(s, d, "fx_labels").select(F.when(F.length("raw_item") % 3 == 0, F.replace("raw_item", F.lit("e"), F.lit("i"))).otherwise(F.col("raw_item")).alias("raw_item"))
    return mt.match_items(labels, chart)


def j4(s, d):
    """The two exact tiers, as in the SQL; j4_tiers has all three."""
    return j4_tiers(s, d).select("raw_item", F.when(F.col("score") >= 0.95, F.col("item_code")).alias("item_code"), (F.col("score") >= 0.95).alias("decided"))


_J4 = """WITH c AS (SELECT replace(item_name_std, ' ', '') AS name, arg_max(item_code, ordinal) AS item_code, min(ordinal) AS o FROM {fx_coa} WHERE ordinal % 5 < 4 GROUP BY 1),
l AS (SELECT DISTINCT CASE WHEN length(raw_item) % 3 = 0 THEN replace(raw_item, 'e', 'i') ELSE raw_item END AS raw_item FROM {fx_labels}), n AS (SELECT raw_item, replace(raw_item, ' ', '') AS clean FROM l),
e AS (SELECT clean, item_code FROM (SELECT DISTINCT clean FROM n) JOIN c ON clean = name),
p AS (SELECT clean, arg_min(item_code, o) AS item_code FROM (SELECT DISTINCT clean FROM n WHERE length(clean) >= 3 AND clean NOT IN (SELECT clean FROM e)) JOIN c ON length(name) >= 3 AND (contains(clean, name) OR contains(name, clean)) GROUP BY 1)
SELECT raw_item, coalesce(e.item_code, p.item_code) AS item_code, coalesce(e.item_code, p.item_code) IS NOT NULL AS decided FROM n LEFT JOIN e ON e.clean = n.clean LEFT JOIN p ON p.clean = n.clean"""


def f26(s, d):
    """The best name of every label by ratio, over the whole chart."""
    chart = view(s, d, "fx_coa").select("item_code", F.col("item_name_std").alias("name"), "ordinal")
    best = mt.best_names(view(s, d, "fx_labels").select(F.col("raw_item").alias("label")), chart)
    return best.select(F.col("label").alias("raw_item"), "item_code", F.round("ratio", 4).alias("ratio"))


def _lcs(x: str, y: str) -> str:
    """SQL text of the longest common subsequence of two words: rows of the table folded over the letters of one."""
    cells = f"list_concat([[0]], list_transform(range(1, length({y}) + 1), lambda j: [prev[j + 1], prev[j] + CASE WHEN ord({y}[j]) = c[1] THEN 1 ELSE 0 END]))"
    row = f"list_reduce({cells}, lambda acc, e: list_append(acc, greatest(acc[-1], e[1], e[2])))"
    start = f"list_concat([list_transform(range(0, length({y}) + 1), lambda z: 0)], list_transform(range(1, length({x}) + 1), lambda i: [CAST(ord({x}[i]) AS INT)]))"
    return f"list_reduce({start}, lambda prev, c: {row})[-1]"


_F26 = f"""WITH l AS (SELECT DISTINCT raw_item FROM {{fx_labels}}), p AS (SELECT raw_item, item_code, ordinal, 200.0 * {_lcs('raw_item', 'item_name_std')} / (length(raw_item) + length(item_name_std)) AS ratio FROM l CROSS JOIN {{fx_coa}})
SELECT raw_item, item_code, CAST(round(ratio, 4) AS DOUBLE) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY raw_item ORDER BY CAST(ratio AS DOUBLE) DESC, ordinal) AS rn FROM p) WHERE rn = 1"""
#: All three tiers over labels n(raw_item, clean) and the chart c(name, item_code, o): m(clean, item_code, name, score).
_TIERS = f"""c AS (SELECT replace(item_name_std, ' ', '') AS name, arg_max(item_code, ordinal) AS item_code, min(ordinal) AS o FROM {{fx_coa}} WHERE ordinal % 5 < 4 GROUP BY 1),
e AS (SELECT DISTINCT clean, item_code, name, 1.0::DOUBLE AS score FROM n JOIN c ON clean = name),
p AS (SELECT clean, arg_min(item_code, o) AS item_code, arg_min(name, o) AS name, 0.95::DOUBLE AS score FROM (SELECT DISTINCT clean FROM n WHERE length(clean) >= 3 AND clean NOT IN (SELECT clean FROM e)) JOIN c ON length(name) >= 3 AND (contains(clean, name) OR contains(name, clean)) GROUP BY 1),
fz AS (SELECT clean, item_code, name, o, 200.0::DOUBLE * {_lcs('clean', 'name')} / (length(clean) + length(name)) AS ratio FROM (SELECT DISTINCT clean FROM n WHERE clean NOT IN (SELECT clean FROM e) AND clean NOT IN (SELECT clean FROM p)) CROSS JOIN c),
fb AS (SELECT clean, CASE WHEN ratio >= 75 THEN item_code END AS item_code, name, ratio / 100 AS score FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY ratio DESC, o) AS rn FROM fz) WHERE rn = 1),
m AS (SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM fb)"""
_J4_TIERS = f"""WITH l AS (SELECT DISTINCT CASE WHEN length(raw_item) % 3 = 0 THEN replace(raw_item, 'e', 'i') ELSE raw_item END AS raw_item FROM {{fx_labels}}), n AS (SELECT raw_item, replace(raw_item, ' ', '') AS clean FROM l),
{_TIERS} SELECT raw_item, item_code, name AS matched_name, score FROM n LEFT JOIN m ON m.clean = n.clean"""


_U2 = f"""WITH {_I}, c AS (SELECT doc_id, stmt, count(*) FILTER (method = 'stream') AS ns, count(*) FILTER (method = 'lattice') AS nl, count(DISTINCT item_code) AS nu FROM i GROUP BY 1, 2),
k AS (SELECT doc_id, stmt, CASE WHEN stmt = 'BS' AND nu > greatest(ns, nl) THEN 'union' WHEN ns > 0 AND ns >= nl THEN 'stream' ELSE 'lattice' END AS chosen FROM c),
r AS (SELECT i.*, chosen, row_number() OVER (PARTITION BY i.doc_id, i.stmt, item_code ORDER BY method = 'stream' DESC, seq) AS rn FROM i JOIN k ON i.doc_id = k.doc_id AND i.stmt = k.stmt WHERE chosen = 'union' OR chosen = method)
SELECT doc_id, stmt, item_code, seq, chosen FROM r WHERE chosen <> 'union' OR rn = 1"""

QUERIES = {
    "s5_read_page_text": (
        lambda s, d: _pages(s, d).select("doc_id", "page_no", pg.normalize_page(F.col("text")).alias("text")).withColumn("is_empty", pg.is_empty_page(F.col("text"))),
        "WITH n AS (SELECT doc_id, page_no, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM {fx_pages}) SELECT *, length(text) < 10 AS is_empty FROM n".replace("{3,}", "\x00"),
    ),
    "a11_looks_scanned": (lambda s, d: pg.looks_scanned(_pages(s, d)), "SELECT doc_id, avg(CASE WHEN length(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) < 10 THEN 1 ELSE 0 END) > 0.6 AS looks_scanned FROM {fx_pages} GROUP BY 1"),
    "p6_is_table_like_page": (lambda s, d: _pages(s, d).select("doc_id", "page_no", pg.is_table_like(F.col("text"), **TABLE).alias("is_table")), f"WITH {_PG} SELECT doc_id, page_no, tab AS is_table FROM pg"),
    "p7_is_toc_page": (
        lambda s, d: _pages(s, d).select("doc_id", "page_no", pg.is_toc_page(F.concat("text", F.lit(" ... 12 ... 7")), "the").alias("is_toc")),
        "SELECT doc_id, page_no, contains(text, 'the') AS is_toc FROM {fx_pages}",
    ),
    "p7_contents_pages": (lambda s, d: _contents_pages(s, d).select("doc_id", F.col("page_no").cast("int").alias("page_no"), pg.is_toc_page(F.col("text"), "red").alias("is_toc")), _CONTENTS),
    "w17_dated_columns": (lambda s, d: tb.period_columns(_dated(s, d)).withColumn("col_no", F.col("col_no").cast("int")), _DATED),
    "p8_has_statement_title_line": (
        lambda s, d: _pages(s, d).select("doc_id", "page_no", pg.has_title_line(F.col("text"), ["the", "que"]).alias("has_title")),
        "WITH l AS (SELECT doc_id, page_no, regexp_replace(line, '\\s+', '', 'g') AS x FROM {fx_lines}) SELECT doc_id, page_no, bool_or(length(x) <= 28 AND (contains(x, 'the') OR contains(x, 'que'))) AS has_title FROM l GROUP BY 1, 2",
    ),
    "f25_toc_line_parse": (
        lambda s, d: pg.toc_items(_toc(s, d)),
        f"WITH {_TOC} SELECT DISTINCT doc_id, trim(title) AS title, page FROM t WHERE length(trim(title)) >= 2 AND NOT regexp_full_match(trim(title), '[0-9]+')",
    ),
    "w9_next_section_boundary": (w9, _W9),
    "w3_statement_start_page": (_starts, f"WITH {_ST} SELECT * FROM st"),
    "w7_expand_statement_block": (_blocks, f"WITH {_EX} SELECT * FROM ex"),
    "w8_tighten_ranges": (lambda s, d: pg.tighten(_blocks(s, d)), f"WITH {_TI} SELECT * FROM ti"),
    "w11_statement_page_range": (
        lambda s, d: pg.page_range(_pages(s, d), "thea", "onen", **TABLE),
        f"""WITH {_PG}, s AS (SELECT doc_id, min(page_no) AS start_page FROM pg WHERE regexp_matches(text, 'thea') AND tab GROUP BY 1) SELECT s.doc_id,
          start_page, coalesce(min(page_no - 1) FILTER (regexp_matches(text, 'onen') AND page_no > start_page), max(page_no)) AS end_page
          FROM s JOIN pg ON pg.doc_id = s.doc_id GROUP BY 1, 2""",
    ),
    "w15_best_title_page_scored": (
        lambda s, d: pg.best_title_pages(_pages(s, d), "thea", "tion"),
        """WITH k AS (SELECT doc_id, page_no, regexp_matches(text, 'thea') AS t, len(regexp_extract_all(text, 'tion')) AS kw FROM {fx_pages}), n AS (SELECT *, coalesce(lead(kw) OVER (PARTITION BY doc_id ORDER BY page_no), 0) AS nx FROM k),
        c AS (SELECT doc_id, page_no, CAST(kw + nx * 0.5 + 1.0 AS DOUBLE) AS score FROM n WHERE t) SELECT doc_id, page_no, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_no) AS rn FROM c WHERE score >= 2) WHERE rn = 1""",
    ),
    "c13_statement_locations": (
        lambda s, d: pg.statement_locations(_pages(s, d), _blocks(s, d), list(TITLES)),
        f"""WITH {_EX}, w AS (SELECT * FROM (SELECT DISTINCT doc_id FROM pg) CROSS JOIN (VALUES ('one'), ('two'), ('three')) v(stmt)) SELECT w.doc_id,
          w.stmt, start_page, end_page, CAST(CASE WHEN start_page IS NULL THEN 0 ELSE round(0.6 + least(0.4, table_pages * 0.1),
          3) END AS DOUBLE) AS confidence FROM w LEFT JOIN ex ON ex.doc_id = w.doc_id AND ex.stmt = w.stmt""",
    ),
    "v11_locator_usable": (
        lambda s, d: pg.locator_usable(_blocks(s, d), _pages(s, d).groupBy("doc_id").agg(F.max("page_no").alias("total_pages"))),
        f"WITH {_EX} SELECT doc_id, count(*) >= 2 AND count(DISTINCT (start_page, end_page)) > 1 AS usable FROM ex GROUP BY 1",
    ),
    "a16_statement_text_block": (
        lambda s, d: pg.text_blocks(_pages(s, d), pg.tighten(_blocks(s, d)).select("doc_id", "stmt", "start_page", "end_page"), 400),
        f"WITH {_TI} SELECT ti.doc_id, stmt, left(string_agg('[PAGE ' || page_no || ']' || chr(10) || text, chr(10) ORDER BY page_no), 400) AS block FROM ti JOIN pg ON pg.doc_id = ti.doc_id AND page_no BETWEEN start_page AND end_page GROUP BY 1, 2",
    ),
    "f1_clean_item_name": (lambda s, d: view(s, d, "part").select("p_partkey", sc.clean_item_name(F.concat(F.lit("一、 "), "p_name", F.lit("："))).alias("clean")), "SELECT p_partkey, replace(p_name, ' ', '') AS clean FROM {part}"),
    "f2_parse_number_cn": (lambda s, d: _cells(s, d).select("table_id", "row_no", "col_no", sc.parse_number_cn(F.col("text")).alias("number")), f"SELECT table_id, row_no, col_no, {_NUM} AS number FROM {{fx_cells}}"),
    "a12_numeric_density": (
        lambda s, d: tb.numeric_density(_cells(s, d)),
        f"WITH n AS (SELECT table_id, col_no, {_NUM} AS v FROM {{fx_cells}} WHERE row_no > 3) SELECT table_id, col_no, count(*) AS n_cells, count(v) AS n_numbers, count(v) / count(*) AS density FROM n GROUP BY 1, 2",
    ),
    "a13_column_content_score": (
        lambda s, d: tb.content_scores(_cells(s, d)).select("table_id", "col_no", "n", "big", "small", F.round("score", 3).alias("score")),
        f"""WITH n AS (SELECT table_id, col_no, abs({_NUM}) AS v FROM {{fx_cells}}), g AS (SELECT table_id, col_no, count(v) AS n, count(*) FILTER (v >= 10000) AS big, count(*) FILTER (v <= 999) AS small, CAST(sum(CAST(least(12, log10(v + 1)) AS DECIMAL(38,6))) AS DOUBLE) AS m FROM n GROUP BY 1, 2)
        SELECT table_id, col_no, n, big, small, round(CASE WHEN n = 0 THEN -200 ELSE n * 6 + big * 10 - small * 2 + m - CASE WHEN big = 0 AND small / greatest(n, 1) >= 0.7 THEN 140 ELSE 0 END END, 3) AS score FROM g""",
    ),
    "w17_period_column_choice": (
        lambda s, d: tb.best_columns(tb.content_scores(_cells(s, d)).select("table_id", "col_no", F.round("score", 3).alias("score"))),
        f"""WITH n AS (SELECT table_id, col_no, abs({_NUM}) AS v FROM {{fx_cells}}), g AS (SELECT table_id, col_no, count(v) AS n, count(*) FILTER (v >= 10000) AS big, count(*) FILTER (v <= 999) AS small, CAST(sum(CAST(least(12, log10(v + 1)) AS DECIMAL(38,6))) AS DOUBLE) AS m FROM n GROUP BY 1, 2),
        c AS (SELECT table_id, col_no, round(CASE WHEN n = 0 THEN -200 ELSE n * 6 + big * 10 - small * 2 + m - CASE WHEN big = 0 AND small / greatest(n, 1) >= 0.7 THEN 140 ELSE 0 END END, 3) AS score FROM g)
        SELECT table_id, col_no, score FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, col_no) AS rn FROM c) WHERE rn = 1""",
    ),
    "w17_period_columns": (
        lambda s, d: tb.period_columns(_headed(s, d)),
        f"""WITH b AS (SELECT DISTINCT table_id, CAST(substr(table_id, 7) AS INT) % 4 AS k FROM {{fx_cells}}), n AS (SELECT table_id, col_no, abs({_NUM}) AS v FROM {{fx_cells}} WHERE col_no > 0 AND row_no > 1),
        g AS (SELECT table_id, col_no, count(v) * 6 + count(*) FILTER (v >= 10000) * 10 - count(*) FILTER (v <= 999) * 2 + sum(least(12, log10(v + 1))) - CASE WHEN count(*) FILTER (v >= 10000) = 0 AND count(*) FILTER (v <= 999) / count(v) >= 0.7 THEN 140 ELSE 0 END AS sc FROM n GROUP BY 1, 2),
        t AS (SELECT table_id, col_no FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY sc DESC, col_no) AS rn FROM g) WHERE rn = 1)
        SELECT b.table_id, CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE t.col_no END AS col_no, CASE WHEN k < 2 THEN 'date' WHEN k = 2 THEN 'period' ELSE 'content' END AS rule FROM b JOIN t ON t.table_id = b.table_id""",
    ),
    "w18_header_blob": (
        lambda s, d: tb.header_blobs(_cells(s, d), "(gear|ring)"),
        """WITH a AS (SELECT table_id, min(row_no) AS at_row FROM {fx_cells} WHERE col_no = 0 AND row_no <= 12 AND regexp_matches(text, '(gear|ring)') GROUP BY 1)
        SELECT c.table_id, col_no, string_agg(text, ' ' ORDER BY row_no) AS blob FROM {fx_cells} c LEFT JOIN a ON a.table_id = c.table_id WHERE row_no BETWEEN coalesce(greatest(1, at_row - 2), 1) AND coalesce(at_row, 3) GROUP BY 1, 2""",
    ),
    "p9_is_likely_cf_table": (
        lambda s, d: tb.likely_cash_flow(_cells(s, d), ["red gear", "hot ring"], ["green bolt"], 20),
        "SELECT table_id, bool_or(contains(text, 'red gear') OR contains(text, 'hot ring')) AND NOT bool_or(contains(text, 'green bolt')) AS is_cash_flow FROM {fx_cells} WHERE col_no = 0 AND row_no <= 20 GROUP BY 1",
    ),
    "p11_skip_category_headers": (
        lambda s, d: tb.drop_category_headers(view(s, d, "fx_labels"), ["redgear", "hotring"]).select("raw_item"),
        "SELECT raw_item FROM {fx_labels} WHERE replace(raw_item, ' ', '') NOT IN ('redgear', 'hotring')",
    ),
    "p12_drop_empty_rows_and_columns": (
        lambda s, d: tb.without_empty(_cells(s, d).withColumn("text", F.when((F.col("row_no") % 5 == 0) | (F.col("col_no") == 1), "  ").otherwise(F.col("text")))),
        "SELECT table_id, row_no, col_no, text FROM {fx_cells} WHERE row_no % 5 <> 0 AND col_no <> 1",
    ),
    "j4_item_match": (j4, _J4),
    "j4_item_match_tiers": (j4_tiers, _J4_TIERS),
    "f26_fuzz_ratio": (f26, _F26),
    "w6_keep_best_status": (lambda s, d: tb.keep_best_status(_items(s, d)).select("doc_id", "stmt", "item_code", "status", "seq"), f"WITH {_I}, {_BESTI} SELECT doc_id, stmt, item_code, status, seq FROM b"),
    "j6_schema_completion": (
        lambda s, d: tb.complete_schema(tb.keep_best_status(_items(s, d)), s.createDataFrame([(t, c) for t in ("BS", "IS") for c in ("ring", "gear", "none")], "stmt string, item_code string")),
        f"""WITH {_I}, {_BESTI}, w AS (SELECT * FROM (SELECT DISTINCT doc_id, stmt FROM b) CROSS JOIN (VALUES ('ring'), ('gear'), ('none')) v(item_code))
          SELECT w.doc_id, w.stmt, w.item_code, b.value, CASE WHEN b.value IS NOT NULL AND b.status = 'MISSING' THEN 'OK' ELSE coalesce(b.status,
          'MISSING') END AS status FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND b.stmt = w.stmt AND b.item_code = w.item_code""",
    ),
    "p13_repair_eligibility": (
        lambda s, d: tb.repair_eligible(_items(s, d), ["ring", "gear"]).select("seq", "llm_repair_eligible"),
        f"WITH {_I} SELECT seq, CAST(item_code IN ('ring', 'gear') AND status IN ('MISSING', 'PARSE_ERROR') AS INT) AS llm_repair_eligible FROM i",
    ),
    "u2_lattice_stream_choice": (lambda s, d: tb.choose_method(_items(s, d)).select("doc_id", "stmt", "item_code", "seq", "chosen"), _U2),
    "c14_item_lookup_layer": (
        lambda s, d: tb.item_lookup(_items(s, d)).select("doc_id", "stmt", "item_code", "value", "status"),
        f"WITH {_I} SELECT doc_id, stmt, item_code, value, status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stmt, item_code ORDER BY seq DESC) AS rn FROM i) WHERE rn = 1",
    ),
}
ORACLES = {k: oracle(v[1]).replace("\x00", "{3,}") for k, v in QUERIES.items() if v[1]}
QUERIES = {k: v[0] for k, v in QUERIES.items()}
