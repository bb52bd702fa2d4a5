"""Filing lists: annual reports of three markets, the latest of each company, identifiers, files, run status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fiscal_year_from_title, normalize_sec_code, parse_iso_date


def annual_filings_us(filings: DataFrame, form: str = "10-K") -> DataFrame:
    return filings.filter((F.col("form_type") == form) & ~F.endswith(F.col("form_type"), F.lit("/A")) & F.col("report_date").isNotNull())


def annual_filings_jp(docs: DataFrame) -> DataFrame:
    """Annual securities reports with XBRL, period, submission and id; amendments are flagged."""
    annual = F.col("formCode").isin("030000", "030001") | F.contains(F.col("docDescription"), F.lit("有価証券報告書"))
    given = F.col("periodEnd").isNotNull() & F.col("submitDateTime").isNotNull() & F.col("docID").isNotNull()
    amended = F.contains(F.coalesce("docDescription", F.lit("")), F.lit("訂正")) | F.endswith(F.coalesce("formCode", F.lit("")), F.lit("1"))
    rows = docs.filter(annual & given & F.col("xbrlFlag").isin("1", "true", "True", "TRUE"))
    return rows.withColumn("sec_code", normalize_sec_code(F.col("secCode"))).withColumn("is_amendment", amended)


def annual_filings_cn(announcements: DataFrame) -> DataFrame:
    title = F.col("announcementTitle")
    kept = F.contains(title, F.lit("年度报告")) & ~F.contains(title, F.lit("摘要")) & ~F.contains(title, F.lit("英文"))
    rows = announcements.withColumn("fiscal_year", fiscal_year_from_title(title))
    return rows.filter(kept & F.col("fiscal_year").isNotNull() & F.col("announcementId").isNotNull() & (F.col("announcementTime") > 0))


def latest_filings(filings: DataFrame) -> DataFrame:
    """Each company's latest filing by filing date; ties go to the lower filing_id."""
    newest = Window.partitionBy("company_key").orderBy(F.desc("filing_date"), "filing_id")
    return filings.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def first_filings(filings: DataFrame, report_date: str | None = None) -> DataFrame:
    """US rule: each company's first filing in index order (seq), of the exact report date if one is given."""
    rows = filings.filter(F.col("report_date") == F.to_date(F.lit(report_date))) if report_date else filings
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("company_key").orderBy("seq"))).filter("_rank = 1").drop("_rank")


def latest_in_window(filings: DataFrame, today: str, days: int = 400) -> DataFrame:
    """Japanese rule: each company's filing of the latest date within the days up to today, the first seen (seq) on ties. A scan
    backwards that stops some time after its first find comes to the same."""
    end = F.to_date(F.lit(today))
    rows = filings.filter(F.col("filing_date").between(F.date_sub(end, days), end))
    newest = Window.partitionBy("company_key").orderBy(F.desc("filing_date"), "seq")
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def filings_of_companies(docs: DataFrame, companies: DataFrame) -> DataFrame:
    """Annual Japanese filings (with sec_code) of the companies wanted (symbol, edinet_code, company_name): a given EDINET code
    must be the filer's, a given name must be part of the filer's where that is known."""
    rows = docs.join(companies, docs["sec_code"] == companies["symbol"])
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    code = ~given("edinet_code") | F.coalesce(F.col("edinetCode") == F.col("edinet_code"), F.lit(False))
    name = ~given("company_name") | ~given("filerName") | F.contains("filerName", "company_name")
    return rows.filter(code & name)


def submissions(index: DataFrame) -> DataFrame:
    """A submissions index of parallel arrays as one row per filing, in order."""
    names = ["form", "reportDate", "filingDate", "accessionNumber", "primaryDocument"]
    return index.select("company_key", F.posexplode(F.arrays_zip(*names)).alias("seq", "f")).select("company_key", "seq", *(f"f.{n}" for n in names))


def limit_per_market(companies: DataFrame, n: int) -> DataFrame:
    """The first n companies of each market in input order; 0 keeps all."""
    if not n:
        return companies
    rank = F.row_number().over(Window.partitionBy("market").orderBy("input_order"))
    return companies.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def with_cik(companies: DataFrame, tickers: DataFrame) -> DataFrame:
    """Explicit cik, else the ticker map's (the last of repeated tickers), ten digits; else skipped_missing_cik."""
    last = tickers.withColumn("ticker", F.upper(F.trim("ticker"))).groupBy("ticker").agg(F.max_by("cik", "seq").alias("map_cik"))
    joined = companies.withColumn("ticker", F.upper(F.trim("symbol"))).join(last, "ticker", "left")
    cik = F.coalesce(F.nullif(F.trim("cik"), F.lit("")), F.col("map_cik").cast("string"))
    return joined.withColumn("cik", F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)).withColumn("status", F.when(F.col("cik").isNull(), "skipped_missing_cik").otherwise("ok")).drop("map_cik")


def not_done(companies: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return companies.join(done, keys, "left_anti")


def instance_file(files: DataFrame) -> DataFrame:
    """Each filing's instance document: the first *_htm.xml, else the first .xml."""
    rank = F.when(F.endswith(F.lower("name"), F.lit("_htm.xml")), 0).when(F.endswith(F.lower("name"), F.lit(".xml")), 1)
    order = Window.partitionBy("filing_id").orderBy(rank, "seq")
    return files.filter(rank.isNotNull()).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def instance_file_jp(files: DataFrame) -> DataFrame:
    """Each package's .xbrl file: those of the public documents if there are any, then annual reports, the shortest name, A to Z."""
    low = F.lower("name")
    rank = [~F.contains("name", F.lit("XBRL/PublicDoc/")), ~F.contains(low, F.lit("-asr-")), F.length("name"), low, F.col("seq")]
    rows = files.filter(F.endswith(low, F.lit(".xbrl"))).withColumn("_rank", F.row_number().over(Window.partitionBy("filing_id").orderBy(*rank)))
    return rows.filter("_rank = 1").drop("_rank")


#: Where a file's path has its company: annual reports by the name's beginning, archives by their whole name.
ANNUAL_PDF, ARCHIVE = r"([^/_]+)_[^/]*_annual\.pdf$", r"([^/]+)\.zip$"


def _found(files: DataFrame, pattern: str) -> DataFrame:
    return files.withColumn("symbol", F.regexp_extract("path", pattern, 1)).filter("symbol <> ''")


def pdf_manifest(companies: DataFrame, files: DataFrame, pattern: str = ANNUAL_PDF) -> DataFrame:
    """Each company's last annual file by name, or missing. files: path, and what else a listing has, which is kept."""
    last = _found(files, pattern).groupBy("symbol").agg(F.max(F.struct("path", *(c for c in files.columns if c != "path"))).alias("f"))
    return companies.join(last.select("symbol", "f.*"), "symbol", "left").withColumn("status", F.when(F.col("path").isNull(), "missing").otherwise("ok"))


def batch_status(runs: DataFrame) -> DataFrame:
    """One status per company from its stage results, the error text cut to 2000 characters."""
    status = (
        F.when(~F.col("symbol_ok"), "skipped_invalid_symbol").when((F.col("market") == "us") & F.col("cik").isNull(), "skipped_missing_cik")
        .when((F.col("market") == "jp") & ~F.col("has_key"), "skipped_missing_edinet_key").when(~F.col("extracted"), "extract_failed").when(~F.col("checked"), "check_failed")
        .otherwise("success")
    )
    return runs.withColumn("status", status).withColumn("error", F.left("error", F.lit(2000)))


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs and successes by market, and over all (market null)."""
    return runs.rollup("market").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.grouping_id().alias("level"))


def zip_manifest(companies: DataFrame, files: DataFrame, pattern: str = ARCHIVE) -> DataFrame:
    """Each company's archive (path .../<symbol>.zip), or missing. files: path, and what else a listing has, which is kept."""
    first = _found(files, pattern).groupBy("symbol").agg(F.min(F.struct("path", *(c for c in files.columns if c != "path"))).alias("f"))
    return companies.join(first.select("symbol", "f.*"), "symbol", "left").withColumn("status", F.when(F.col("path").isNull(), "missing").otherwise("ok"))


def jp_filing_metadata(filings: DataFrame, texts: dict[str, DataFrame], report_dates: DataFrame) -> DataFrame:
    """Metadata of local filings (filing_id, file_name, given_symbol, given_period_end, description): what the caller gave, else
    the text facts of texts (sec_code, filer_name, period_end, filing_date: filing_id, text), else what the contexts say."""
    out = filings
    for name, rows in texts.items():
        out = out.join(rows.select("filing_id", F.col("text").alias(f"_{name}")), "filing_id", "left")
    out = out.join(report_dates.select("filing_id", F.col("report_date").alias("_inferred")), "filing_id", "left")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return out.select(
        "filing_id", F.coalesce(normalize_sec_code(F.col("given_symbol")), normalize_sec_code(F.col("_sec_code"))).alias("sec_code"), F.col("_filer_name").alias("filer_name"),
        F.coalesce(parse_iso_date(F.col("given_period_end")), parse_iso_date(F.col("_period_end")), F.col("_inferred").cast("string")).alias("period_end"), parse_iso_date(F.col("_filing_date")).alias("filing_date"),
        F.coalesce(F.nullif(F.regexp_extract("file_name", r"(S\d{8,})", 1), F.lit("")), F.concat(F.lit("LOCAL_"), stem)).alias("doc_id"), F.contains("description", F.lit("訂正")).alias("is_amendment"),
    )


def first_per_group(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; 0 keeps all."""
    if not n:
        return rows
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_rank") <= n).drop("_rank")


def markets_union(*rows: DataFrame) -> DataFrame:
    """Rows of several markets under one schema; columns that a market lacks are null."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
