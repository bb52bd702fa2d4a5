"""Report pages: text clean-up, table of contents, statement titles, page ranges. Patterns are arguments; defaults are Chinese."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import location_confidence

#: Patterns of tables, titles and sections.
TABLE_WORDS = "(项目|本期金额|上期金额|期末余额|期初余额)"
TITLES = {"balance_sheet": "(合并及公司|合并|母公司|公司)?资产负债表", "income_statement": "(合并及公司|合并|母公司|公司)?利润表", "cash_flow_statement": "(合并及公司|合并|母公司|公司)?现金流量表"}
CONSOLIDATED = {"balance_sheet": "合并(及公司)?资产负债表", "income_statement": "合并(及公司)?利润表", "cash_flow_statement": "合并(及公司)?现金流量表"}
SECTION_HEADER = r"^\s*第[一二三四五六七八九十百0-9]+节\s+.+$"
TOC_LINE = r"^\s*(.+?)\s*(?:\.{2,}|…{2,}|·{2,}|_{2,}|-{2,})?\s*(\d{1,4})\s*(?:-\s*\d{1,4}\s*-\s*)?\s*$"
MOST_PAGES = 10


def normalize_page(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def is_empty_page(text: Column) -> Column:
    return F.length(text) < 10


def looks_scanned(pages: DataFrame) -> DataFrame:
    """Documents and whether over 60 % of their pages are empty."""
    return pages.groupBy("doc_id").agg((F.avg(is_empty_page(normalize_page(F.col("text"))).cast("int")) > 0.6).alias("looks_scanned"))


def is_table_like(text: Column, words: str = TABLE_WORDS, density: float = 0.08, least_digits: int = 40, strict: bool = False) -> Column:
    """Table words, or many digits (strict: both); pages of an audit opinion are none."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    opinion = F.contains(text, F.lit("审计报告")) & F.contains(text, F.lit("审字"))
    dense = (digits > least_digits) if strict else (digits > least_digits) & (digits / F.greatest(F.length(text), F.lit(1)) > density)
    hit = text.rlike(words) & dense if strict else text.rlike(words) | dense
    return F.coalesce(hit & ~opinion, F.lit(False))


def is_toc_page(text: Column, word: str = "目录") -> Column:
    leaders = F.regexp_count(text, F.lit(r"(\.{3,}|…{3,})\s*\d{1,4}"))
    ends = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\d{1,4}\s*$")))
    return F.coalesce(F.contains(text, F.lit(word)) & ((leaders >= 2) | (ends >= 6)), F.lit(False))


def has_title_line(text: Column, titles: list[str]) -> Column:
    """A short line among the first 60 that holds a title once white space is gone."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 60), lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.exists(lines, lambda x: (F.length(x) <= 28) & F.exists(F.array(*map(F.lit, titles)), lambda t: F.contains(x, t)))


def toc_items(lines: DataFrame) -> DataFrame:
    """(doc_id, title, page) of contents lines; short and numeric titles are dropped, repeats kept once."""
    part = lambda i: F.regexp_extract(F.trim("line"), TOC_LINE, i)
    rows = lines.filter(F.trim("line").rlike(TOC_LINE)).select("doc_id", F.trim(F.regexp_replace(part(1), r"\s{2,}", " ")).alias("title"), part(2).cast("int").alias("page"))
    return rows.filter((F.length("title") >= 2) & ~F.col("title").rlike("^[0-9]+$") & F.col("page").between(1, 9999)).distinct()


def financial_sections(items: DataFrame, totals: DataFrame, word: str = "财务报告", header: str = SECTION_HEADER, scopes: int = 1) -> DataFrame:
    """Each document's financial section: from the first contents item with the word to before the next section header or an
    item over five pages on. items: doc_id, title, page, seq, and scope if several are tried; the first that works counts."""
    items = items if "scope" in items.columns else items.withColumn("scope", F.lit(0))
    ranked = items.withColumn("rk", F.row_number().over(Window.partitionBy("doc_id", "scope").orderBy("page", "seq")))
    start = ranked.filter(F.contains("title", F.lit(word))).groupBy("doc_id", "scope").agg(F.min(F.struct("rk", "page")).alias("s")).select("doc_id", "scope", "s.rk", F.col("s.page").alias("start"))
    later = ranked.select("doc_id", "scope", F.col("rk").alias("rk2"), "title", F.col("page").alias("page2")).join(start, ["doc_id", "scope"])
    stops = later.filter((F.col("rk2") > F.col("rk")) & (F.col("title").rlike(header) | (F.col("page2") > F.col("start") + 5)))
    stop = stops.groupBy("doc_id", "scope").agg(F.min(F.struct("rk2", "page2"))["page2"].alias("stop"))
    rows = start.join(stop, ["doc_id", "scope"], "left").join(totals, "doc_id")
    first = F.greatest(F.lit(1), F.least("start", "total_pages"))
    end = F.coalesce(F.greatest(F.col("stop") - 1, F.col("start")), F.col("total_pages"))
    out = rows.select("doc_id", "scope", first.alias("start_page"), F.greatest(first, F.least(end, F.col("total_pages"))).alias("end_page"))
    return out.groupBy("doc_id").agg(F.min_by(F.struct("start_page", "end_page"), "scope").alias("s")).select("doc_id", "s.*")


def statement_starts(pages: DataFrame, titles: dict[str, str] = TITLES, consolidated: dict[str, str] = CONSOLIDATED, **table) -> DataFrame:
    """(doc_id, stmt, start_page, is_consolidated): the first page with a consolidated title, else with any; pages with
    several titles and no table are skipped."""
    hits = F.array(*(F.struct(F.lit(k).alias("stmt"), F.col("text").rlike(p).alias("hit"), F.col("text").rlike(consolidated[k]).alias("cons")) for k, p in titles.items()))
    rows = pages.withColumn("_hits", hits).withColumn("_n", F.size(F.filter("_hits", lambda h: h["hit"]))).filter((F.col("_n") < 2) | is_table_like(F.col("text"), **table))
    found = rows.select("doc_id", "page_no", F.explode("_hits").alias("h")).filter("h.hit or h.cons")
    best = found.groupBy("doc_id", "h.stmt").agg(F.min(F.struct((~F.col("h.cons")).alias("other"), "page_no")).alias("b"))
    return best.select("doc_id", "stmt", F.col("b.page_no").alias("start_page"), (~F.col("b.other")).alias("is_consolidated"))


def expand_blocks(starts: DataFrame, pages: DataFrame, **table) -> DataFrame:
    """Each start with the last table-like page before the second page in a row that is none."""
    flags = pages.select("doc_id", "page_no", is_table_like(F.col("text"), **table).alias("table"))
    rows = starts.join(flags, "doc_id").filter("page_no >= start_page")
    by = Window.partitionBy("doc_id", "stmt").orderBy("page_no")
    rows = rows.withColumn("_gone", ~F.col("table") & ~F.coalesce(F.lag("table").over(by), F.lit(True)))
    stop = F.min(F.when(F.col("_gone"), F.col("page_no"))).over(Window.partitionBy("doc_id", "stmt"))
    rows = rows.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("page_no") < F.col("_stop")))
    return rows.groupBy(*starts.columns).agg(F.coalesce(F.max(F.when(F.col("table"), F.col("page_no"))), F.first("start_page")).alias("end_page"), F.count_if("table").alias("table_pages"))


def tighten(locations: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """End pages no later than before the next statement, most pages long, never before the start."""
    following = F.lead("start_page").over(Window.partitionBy("doc_id").orderBy("start_page", "stmt"))
    end = F.greatest("start_page", F.least("end_page", F.coalesce(following - 1, F.col("end_page")), F.col("start_page") + most - 1))
    return locations.withColumn("end_page", end)


def statement_locations(docs: DataFrame, blocks: DataFrame, statements: list[str]) -> DataFrame:
    """Every document with every statement: range and confidence, or nulls and 0."""
    wanted = docs.select("doc_id").distinct().withColumn("stmt", F.explode(F.array(*map(F.lit, statements))))
    rows = wanted.join(blocks, ["doc_id", "stmt"], "left")
    conf = F.when(F.col("start_page").isNull(), 0.0).otherwise(location_confidence(F.lit(True), F.col("table_pages")))
    return rows.select("doc_id", "stmt", "start_page", "end_page", conf.alias("confidence"))


def page_range(pages: DataFrame, begin: str, end: str, **table) -> DataFrame:
    """From the first table-like page that matches begin to before the first later one that matches end, else the last page."""
    flags = pages.select("doc_id", "page_no", (F.col("text").rlike(begin) & is_table_like(F.col("text"), **table)).alias("a"), F.col("text").rlike(end).alias("b"))
    rows = flags.withColumn("start_page", F.min(F.when(F.col("a"), F.col("page_no"))).over(Window.partitionBy("doc_id")))
    out = rows.filter("start_page is not null").groupBy("doc_id", "start_page").agg(F.min(F.when(F.col("b") & (F.col("page_no") > F.col("start_page")), F.col("page_no") - 1)).alias("e"), F.max("page_no").alias("last"))
    return out.select("doc_id", "start_page", F.coalesce("e", "last").alias("end_page"))


def best_title_pages(pages: DataFrame, title: str, words: str, least: float = 2.0) -> DataFrame:
    """The title page whose own and next page hold most table words, earliest on ties."""
    kw = F.regexp_count("text", F.lit(words))
    rows = pages.select("doc_id", "page_no", F.col("text").rlike(title).alias("t"), kw.alias("kw")).withColumn("nx", F.coalesce(F.lead("kw").over(Window.partitionBy("doc_id").orderBy("page_no")), F.lit(0)))
    scored = rows.filter("t").withColumn("score", F.col("kw") + F.col("nx") * 0.5 + 1.0).filter(F.col("score") >= least)
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "page_no")).alias("b"))
    return best.select("doc_id", F.col("b.page_no").alias("page_no"), (-F.col("b.n")).alias("score"))


def fallback_ranges(pages: DataFrame, title: str, words: str, bare: str, full: str, span: int = 8) -> DataFrame:
    """From the best title page over at most span pages: on while a page holds table words or the title, up to the first that
    doesn't, or that has the bare title without the full one (a statement of the parent company alone)."""
    starts = best_title_pages(pages, title, words).select("doc_id", F.col("page_no").alias("start_page"))
    text = F.col("text")
    on = (text.rlike(words) | text.rlike(title)) & ~(F.contains(text, F.lit(bare)) & ~F.contains(text, F.lit(full)))
    rows = pages.join(starts, "doc_id").filter(F.col("page_no").between(F.col("start_page") + 1, F.col("start_page") + span - 1)).withColumn("on", on)
    stop = F.min(F.when(~F.col("on"), F.col("page_no"))).alias("stop")
    ends = rows.groupBy("doc_id").agg(stop, F.max("page_no").alias("last"))
    return starts.join(ends, "doc_id", "left").select("doc_id", "start_page", F.coalesce(F.col("stop") - 1, "last", "start_page").alias("end_page"))


def text_blocks(pages: DataFrame, locations: DataFrame, most_chars: int) -> DataFrame:
    """The numbered page texts of each location in order, cut to most_chars."""
    rows = pages.join(locations, "doc_id").filter(F.col("page_no").between(F.col("start_page"), F.col("end_page")))
    marked = F.concat(F.lit("[PAGE "), F.col("page_no").cast("string"), F.lit("]\n"), F.col("text"))
    joined = rows.groupBy("doc_id", "stmt").agg(F.array_sort(F.collect_list(F.struct("page_no", marked.alias("m")))).alias("p"))
    return joined.select("doc_id", "stmt", F.substring(F.array_join(F.transform("p", lambda x: x["m"]), "\n"), 1, most_chars).alias("block"))


def locator_usable(locations: DataFrame, totals: DataFrame) -> DataFrame:
    """Documents whose ranges can be trusted: two statements or more, not all the same, within the document."""
    rows = locations.filter("start_page is not null").join(totals, "doc_id")
    ok = (F.count("*") >= 2) & (F.count_distinct("start_page", "end_page") > 1) & F.bool_and((F.col("start_page") >= 1) & (F.col("end_page") <= F.col("total_pages")))
    return rows.groupBy("doc_id").agg(ok.alias("usable"))


def trusted_ranges(pages: DataFrame, located: DataFrame, titles: dict[str, str], fallback: DataFrame) -> DataFrame:
    """Each document's located ranges if they can be trusted (locator_usable, ends not before starts, every statement's title
    on its start page), else the fallback's (doc_id, stmt, start_page, end_page)."""
    totals = pages.groupBy("doc_id").agg(F.max("page_no").alias("total_pages"))
    pattern = F.create_map(*(F.lit(x) for kv in titles.items() for x in kv))
    starts = located.join(pages.select("doc_id", F.col("page_no").alias("start_page"), "text"), ["doc_id", "start_page"], "left")
    titled = starts.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.regexp("text", F.try_element_at(pattern, F.col("stmt"))), F.lit(False)) & (F.col("end_page") >= F.col("start_page"))).alias("titled"))
    good = locator_usable(located, totals).join(titled, "doc_id").filter("usable and titled").select("doc_id")
    columns = ["doc_id", "stmt", "start_page", "end_page"]
    first = located.join(good, "doc_id", "left_semi").select(*columns, F.lit("locator").alias("source"))
    return first.unionByName(fallback.join(good, "doc_id", "left_anti").select(*columns, F.lit("fallback").alias("source")))


def title_fallback(pages: DataFrame, found: DataFrame, titles: dict[str, str], lines: dict[str, list[str]], **table) -> DataFrame:
    """Statements not found yet: the first table-like page with the title in a title line; it ends before another statement
    within nine pages, else five pages on, within the document."""
    hits = F.array(*(F.struct(F.lit(k).alias("stmt"), F.col("text").rlike(p).alias("any"), (F.col("text").rlike(p) & is_table_like(F.col("text"), **table) & has_title_line(F.col("text"), lines[k])).alias("start")) for k, p in titles.items()))
    rows = pages.withColumn("last", F.max("page_no").over(Window.partitionBy("doc_id"))).select("doc_id", "page_no", "last", F.explode(hits).alias("h")).select("doc_id", "page_no", "last", "h.*")
    starts = rows.filter("start").groupBy("doc_id", "stmt", "last").agg(F.min("page_no").alias("start_page")).join(found, ["doc_id", "stmt"], "left_anti")
    others = rows.filter("any").select("doc_id", F.col("stmt").alias("other"), F.col("page_no").alias("page2"))
    near = (starts["doc_id"] == others["doc_id"]) & (starts["stmt"] != others["other"]) & others["page2"].between(F.col("start_page") + 1, F.col("start_page") + 9)
    stop = starts.join(others, near, "left").groupBy(starts["doc_id"], "stmt", "start_page", "last").agg(F.min("page2").alias("stop"))
    return stop.select("doc_id", "stmt", "start_page", F.coalesce(F.col("stop") - 1, F.least(F.col("start_page") + 5, F.col("last"))).alias("end_page"))
