"""Extracted tables as long cells: column scores, label matching, status rules, schema completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BLANK, clean_item_name, latest_header_date, parse_number_cn
from .lines import is_not_applicable, parse_per_share
from ..sources.shared import dealt, small_side

HEADER_ROWS = 3
#: Status order, core codes' repairable states.
STATUS_RANK = {"OK": 4, "NOT_APPLICABLE": 3, "PARSE_ERROR": 2, "MISSING": 1}


def numeric_density(cells: DataFrame, header_rows: int = HEADER_ROWS) -> DataFrame:
    """Share of non-empty cells that hold a number, by column, after the header rows (all rows if none remain)."""
    has_body = F.max(F.col("row_no") > header_rows).over(Window.partitionBy("table_id", "col_no"))
    rows = cells.withColumn("_body", has_body).filter((F.col("row_no") > header_rows) | ~F.col("_body")).filter(F.trim("text") != "")
    return rows.groupBy("table_id", "col_no").agg(F.count("*").alias("n_cells"), F.count(parse_number_cn(F.col("text"))).alias("n_numbers")).withColumn("density", F.col("n_numbers") / F.col("n_cells"))


def content_scores(cells: DataFrame) -> DataFrame:
    """Score of each column as an amount column, from its cells alone."""
    value = F.abs(parse_number_cn(F.col("text")))
    rows = cells.filter(F.trim("text") != "").withColumn("v", value)
    out = rows.groupBy("table_id", "col_no").agg(
        F.count("v").alias("n"), F.count_if(F.col("v") >= 10000).alias("big"), F.count_if(F.col("v") <= 999).alias("small"),
        F.sum(F.least(F.lit(12.0), F.log10(F.col("v") + 1)).cast("decimal(38,6)")).cast("double").alias("magnitude"), F.avg(F.col("text").rlike("[一-鿿]").cast("int")).alias("cjk"),
    )
    notes = (F.col("big") == 0) & (F.col("small") / F.greatest("n", F.lit(1)) >= 0.7)
    score = F.when(F.col("n") == 0, -200.0).otherwise(F.col("n") * 6 + F.col("big") * 10 - F.col("small") * 2 + F.col("magnitude") - F.when(notes, 140).otherwise(0) - F.when(F.col("cjk") >= 0.2, 100).otherwise(0))
    return out.select("table_id", "col_no", "n", "big", "small", score.alias("score"))


def best_columns(scores: DataFrame) -> DataFrame:
    """The column of the highest score, leftmost on ties."""
    best = scores.groupBy("table_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "col_no")).alias("b"))
    return best.select("table_id", F.col("b.col_no").alias("col_no"), (-F.col("b.n")).alias("score"))


#: Header words of the current and the prior period, of notes, and of consolidated amounts.
CURRENT = "(报告期末|本期末|期末余额|期末数|期末|年末|报告期|本期|本年|当期)"
PRIOR = "(期初余额|期初数|期初|上年年末|上期期末|上期末|上年|上期|上年度|去年|同期|前期)"
LEAST_DENSITY = 0.2


def period_columns(cells: DataFrame) -> DataFrame:
    """The amount column of each table: of the columns with enough numbers (all if none has), the one of the latest header
    date; without dates the one whose header speaks most for the current period; else the best content. Leftmost on ties."""
    amounts = cells.filter("col_no > 0")
    dense = numeric_density(amounts).filter(F.col("density") >= LEAST_DENSITY).select("table_id", "col_no", F.lit(True).alias("dense"))
    heads = header_blobs(cells).filter("col_no > 0").withColumn("day", F.unix_date(latest_header_date(F.col("blob")))).withColumn("bare", F.regexp_replace("blob", BLANK, ""))
    period = F.when(F.col("bare").rlike(CURRENT), 100).otherwise(0) - F.when(F.col("bare").rlike(PRIOR), 100).otherwise(0)
    hints = (
        F.when(F.col("bare").rlike("(本年|本期|期末|12月31日|当期)"), 120).otherwise(0) - F.when(F.col("bare").rlike("(附注|注释|注)"), 120).otherwise(0) - F.when(F.col("bare").rlike("(上年|上期|期初|去年)"), 80).otherwise(0)
        + F.when(F.contains("bare", F.lit("合并")) & F.col("bare").rlike("(本年|本期|期末|金额|余额)"), 60).otherwise(0)
    )
    rows = content_scores(amounts).join(heads, ["table_id", "col_no"], "left").join(dense, ["table_id", "col_no"], "left")
    by = Window.partitionBy("table_id")
    rows = rows.withColumn("_any", F.max("dense").over(by)).filter(F.col("dense") | F.col("_any").isNull()).withColumn("period", F.coalesce(period, F.lit(0)))
    rank = F.when(F.max("day").over(by).isNotNull(), F.coalesce("day", F.lit(-1)).cast("double")).when(F.max("period").over(by) > 0, F.col("period").cast("double")).otherwise(F.col("score") + F.coalesce(hints, F.lit(0)))
    rule = F.when(F.max("day").over(by).isNotNull(), "date").when(F.max("period").over(by) > 0, "period").otherwise("content")
    best = rows.withColumn("rank", rank).withColumn("rule", rule).groupBy("table_id", "rule").agg(F.min(F.struct((-F.col("rank")).alias("n"), "col_no")).alias("b"))
    return best.select("table_id", F.col("b.col_no").alias("col_no"), "rule")


def header_blobs(cells: DataFrame, anchor: str = "(项目|科目)", header_rows: int = HEADER_ROWS, probe: int = 12) -> DataFrame:
    """Header text of each column: the rows up to the anchor row of column 0 (at most header_rows), else the first ones."""
    at = cells.filter((F.col("col_no") == 0) & (F.col("row_no") <= probe) & F.regexp_replace("text", r"\s+", "").rlike(anchor)).groupBy("table_id").agg(F.min("row_no").alias("at"))
    rows = cells.join(at, "table_id", "left").filter(F.col("row_no").between(F.coalesce(F.greatest(F.lit(1), F.col("at") - header_rows + 1), F.lit(1)), F.coalesce("at", F.lit(header_rows))))
    out = rows.groupBy("table_id", "col_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("h"))
    return out.select("table_id", "col_no", F.array_join(F.transform("h", lambda x: x["text"]), " ").alias("blob"))


def likely_cash_flow(cells: DataFrame, anchors: list[str], exclusions: list[str], rows: int = 200) -> DataFrame:
    """Tables whose first item cells hold an anchor and none of the exclusions."""
    rank = F.row_number().over(Window.partitionBy("table_id").orderBy("row_no"))
    items = cells.filter((F.col("col_no") == 0) & (F.trim("text") != "")).withColumn("_rank", rank).filter(F.col("_rank") <= rows)
    hit = lambda words: F.max(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w)))
    return items.groupBy("table_id").agg((hit(anchors) & ~hit(exclusions)).alias("is_cash_flow"))


def without_empty(cells: DataFrame) -> DataFrame:
    """Cells of rows and columns that hold any text; blank cells become null."""
    rows = cells.withColumn("text", F.nullif(F.trim("text"), F.lit("")))
    held = lambda *keys: F.count("text").over(Window.partitionBy("table_id", *keys)) > 0
    return rows.withColumn("_r", held("row_no")).withColumn("_c", held("col_no")).filter("_r and _c").drop("_r", "_c")


def expand_giant_rows(cells: DataFrame, anchor: str = "(项目|科目)", least_lines: int = 12) -> DataFrame:
    """Tables of a header with the anchor and one row whose cells hold many lines, as a row for each line; others as they are."""
    by = Window.partitionBy("table_id")
    lines = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("\n")), "\n")
    rows = cells.withColumn("_first", F.min("row_no").over(by)).withColumn("_last", F.max("row_no").over(by)).withColumn("_lines", lines)
    head = F.col("row_no") == F.col("_first")
    rows = rows.withColumn("_anchor", F.max((head & F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "").rlike(anchor)).cast("int")).over(by))
    rows = rows.withColumn("_most", F.max(F.when(~head, F.size("_lines"))).over(by))
    between = F.max((F.col("row_no") > F.col("_first")) & (F.col("row_no") < F.col("_last"))).over(by)
    rows = rows.withColumn("_two", (F.col("_first") < F.col("_last")) & ~between)
    giant = F.col("_two") & (F.col("_anchor") == 1) & (F.col("_most") >= least_lines) & ~head
    parts = F.when(giant, F.transform(F.sequence(F.lit(0), F.col("_most") - 1), lambda i: F.trim(F.coalesce(F.get("_lines", i), F.lit(""))))).otherwise(F.array("text"))
    out = rows.select("table_id", "row_no", "col_no", F.posexplode(parts).alias("at", "text"))
    return out.select("table_id", (F.col("row_no") + F.col("at")).alias("row_no"), "col_no", "text")


def promote_headers(cells: DataFrame, anchor: str = "(项目|科目)") -> DataFrame:
    """Cells with their column's name: the first row's text where it holds the anchor (that row goes; repeated names are
    numbered), else col_<n>."""
    by = Window.partitionBy("table_id")
    rows = cells.withColumn("_head", F.col("row_no") == F.min("row_no").over(by))
    rows = rows.withColumn("_promote", F.max((F.col("_head") & F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "").rlike(anchor)).cast("int")).over(by) == 1)
    title = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("col"))
    rows = rows.withColumn("_title", F.when(F.col("_head"), title))
    place = F.row_number().over(Window.partitionBy("table_id", "_head").orderBy("col_no")) - 1
    again = F.row_number().over(Window.partitionBy("table_id", "_title").orderBy("col_no")) - 1
    named = F.when(~F.col("_promote"), F.concat(F.lit("col_"), place)).when(again == 0, F.col("_title")).otherwise(F.concat_ws("_", "_title", again))
    rows = rows.withColumn("_named", F.when(F.col("_head"), named)).withColumn("name", F.max("_named").over(Window.partitionBy("table_id", "col_no")))
    return rows.filter(~F.col("_head") | ~F.col("_promote")).select("table_id", "row_no", "col_no", "name", "text")


def clean_tables(cells: DataFrame) -> DataFrame:
    """Extracted tables made regular: giant rows split, empty rows and columns dropped, headers promoted. A table's cells are
    shuffled once, to one task; how many tables a task gets depends on their cells."""
    return promote_headers(without_empty(expand_giant_rows(dealt(cells, "table_id"))))


def balance_columns(cells: DataFrame, header_rows: int = 8) -> DataFrame:
    """The period-end column of each balance sheet: of the columns with enough numbers (all if none has), those of the latest
    header date; of these consolidated before unspecified before company-only, leftmost. Tables without dates are left to
    period_columns."""
    amounts = cells.filter("col_no > 0")
    dense = numeric_density(amounts, 6).filter(F.col("density") >= LEAST_DENSITY).select("table_id", "col_no", F.lit(True).alias("dense"))
    head = amounts.filter(F.col("row_no") <= header_rows).groupBy("table_id", "col_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]), " ").alias("blob"))
    rows = head.join(dense, ["table_id", "col_no"], "left").withColumn("_any", F.max("dense").over(Window.partitionBy("table_id"))).filter(F.col("dense") | F.col("_any").isNull())
    bare = F.regexp_replace("blob", r"\s+", "")
    scope = F.when(F.contains(bare, F.lit("合并")), 2).when(F.contains(bare, F.lit("公司")), 0).otherwise(1)
    dated = rows.withColumn("day", latest_header_date(F.col("blob"))).filter("day is not null")
    best = dated.groupBy("table_id").agg(F.max(F.struct("day", scope.alias("scope"), (-F.col("col_no")).alias("left"))).alias("b"))
    return best.select("table_id", (-F.col("b.left")).alias("col_no"), F.col("b.day").alias("day"), F.col("b.scope").alias("scope"))


def eps_items(cells: DataFrame, columns: DataFrame, matches: DataFrame, codes: list[str]) -> DataFrame:
    """Per-share rows: the first readable per-share number in the table's columns, current period first (columns: table_id,
    col_no, priority); NOT_APPLICABLE where the row says so; COLUMN_ROLE_SWAP where another column than the first had it."""
    labels = cells.filter("col_no = 0").select("table_id", "row_no", F.trim("text").alias("raw_item")).join(matches.filter(F.col("item_code").isin(codes)).select("raw_item", "item_code"), "raw_item")
    rows = cells.filter("col_no > 0").join(columns, ["table_id", "col_no"]).withColumn("v", parse_per_share(F.col("text")))
    given = F.when(F.col("v").isNotNull(), F.struct("priority", "v"))
    found = rows.groupBy("table_id", "row_no").agg(F.min(given).alias("g"), F.min("priority").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "text"))), lambda x: F.trim(x["text"])), " ").alias("texts"))
    out = labels.join(found, ["table_id", "row_no"], "left")
    status = F.when(F.col("g").isNotNull(), "OK").when(is_not_applicable(F.concat_ws(" ", "raw_item", "texts")), "NOT_APPLICABLE").when(F.trim("texts") != "", "PARSE_ERROR")
    note = F.when(F.col("g.priority") > F.col("first"), "COLUMN_ROLE_SWAP")
    return out.select("table_id", "row_no", "item_code", F.col("g.v").alias("value"), status.alias("status"), note.alias("fixup_reason")).filter("status is not null")


def drop_category_headers(items: DataFrame, headers: list[str]) -> DataFrame:
    return items.withColumn("clean", clean_item_name(F.col("raw_item"))).filter(~F.col("clean").isin(headers) & (F.length("clean") >= 2))


def status_rank(status: Column) -> Column:
    out = None
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank) if out is None else out.when(status == name, rank)
    return out.otherwise(0)


def keep_best_status(items: DataFrame) -> DataFrame:
    """One row per document, statement and code: the best status, the first of equal ones."""
    order = Window.partitionBy("doc_id", "stmt", "item_code").orderBy(status_rank(F.col("status")).desc(), "seq")
    return items.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def complete_schema(items: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every document with every account of its statement; missing ones MISSING, filled values never so."""
    wanted = items.select("doc_id", "stmt").distinct().join(small_side(accounts), "stmt")
    rows = wanted.join(items.select("doc_id", "stmt", "item_code", "value", "status"), ["doc_id", "stmt", "item_code"], "left")
    status = F.coalesce("status", F.lit("MISSING"))
    return rows.withColumn("status", F.when(F.col("value").isNotNull() & (status == "MISSING"), "OK").otherwise(status))


def repair_eligible(items: DataFrame, core: list[str]) -> DataFrame:
    return items.withColumn("llm_repair_eligible", (F.col("item_code").isin(core) & F.col("status").isin("MISSING", "PARSE_ERROR")).cast("int"))


def choose_method(items: DataFrame) -> DataFrame:
    """Of two extractions (method lattice, stream) of a statement the stream one if it has as many items; for balance sheets
    the union, stream first, if that has more."""
    counts = items.groupBy("doc_id", "stmt").agg(*(F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("stream", "lattice")), F.count_distinct("item_code").alias("n_union"))
    counts = counts.withColumn("chosen", F.when((F.col("n_stream") > 0) & (F.col("n_stream") >= F.col("n_lattice")), "stream").otherwise("lattice"))
    best = F.greatest("n_stream", "n_lattice")
    counts = counts.withColumn("chosen", F.when((F.col("stmt") == "BS") & (F.col("n_union") > best), "union").otherwise(F.col("chosen")))
    rows = items.join(counts.select("doc_id", "stmt", "chosen"), ["doc_id", "stmt"]).filter("chosen = 'union' or chosen = method")
    order = Window.partitionBy("doc_id", "stmt", "item_code").orderBy((F.col("method") == "stream").desc(), "seq")
    return rows.withColumn("_rank", F.row_number().over(order)).filter("chosen <> 'union' or _rank = 1").drop("_rank")


def item_lookup(items: DataFrame) -> DataFrame:
    """Value, status and raw text of each document, statement and code; blank codes dropped, the last of repeats counts."""
    last = Window.partitionBy("doc_id", "stmt", "item_code").orderBy(F.desc("seq"))
    rows = items.filter(F.trim("item_code") != "").withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")
    return rows.withColumn("status", F.upper("status"))


def extract_items(cells: DataFrame, value_columns: DataFrame, matches: DataFrame) -> DataFrame:
    """One item per table row whose label (column 0) has an account: the value of the table's chosen column, else of the first
    other column from the left with a number; its status, and whether a later column had to serve."""
    labels = cells.filter("col_no = 0").select("table_id", "row_no", F.trim("text").alias("raw_item")).join(matches.filter("item_code is not null").select("raw_item", "item_code"), "raw_item")
    chosen = cells.filter("col_no > 0").join(value_columns.select("table_id", F.col("col_no").alias("best")), "table_id")
    rows = chosen.withColumn("v", parse_number_cn(F.col("text"))).withColumn("order", F.when(F.col("col_no") == F.col("best"), -1).otherwise(F.col("col_no")))
    given = F.when(F.col("v").isNotNull(), F.struct("order", "v"))
    values = rows.groupBy("table_id", "row_no").agg(F.min(given).alias("g"), F.max(F.when(F.col("order") == -1, F.trim("text"))).alias("raw_text"))
    out = labels.join(values, ["table_id", "row_no"], "left")
    status = F.when(F.col("g").isNotNull(), "OK").when(F.coalesce("raw_text", F.lit("")) != "", "PARSE_ERROR").otherwise("MISSING")
    return out.select("table_id", "row_no", "raw_item", "item_code", F.col("g.v").alias("value"), status.alias("status"), F.coalesce(F.col("g.order") > -1, F.lit(False)).alias("is_fallback"))
