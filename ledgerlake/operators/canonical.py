"""Canonical Chinese statements from item codes, key metrics, and readable reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, raw_currency, short_currency, sum_given

#: Canonical fields and the item codes that fill them, in order.
IS_CODES = {
    "total_revenue": ["BIZTOTINCO", "BIZINCO"], "cost_of_revenue": ["BIZTOTCOST", "BIZCOST"], "taxes_and_surcharges": ["BIZTAX"], "selling_expense": ["SALESEXPE"], "admin_expense": ["MANAEXPE"], "rnd_expense": ["DEVEEXPE"],
    "finance_expense": ["FINEXPE", "FININCO"], "operating_income": ["PERPROFIT"], "other_income": ["OTHERINCO"], "income_before_income_taxes": ["TOTPROFIT"], "net_income": ["NETPROFIT", "PARENETP"], "eps_basic": ["BASICEPS"],
}
BS_CODES = {
    "total_assets": ["TOTASSET"], "total_liabilities": ["TOTLIAB"], "current_liabilities": ["TOTALCURRLIAB"], "noncurrent_liabilities": ["TOTALNONCLIAB"], "liabilities_and_equity": ["TOTLIABSHAREQUI"], "cash": ["CURFDS"], "inventories": ["INVE"],
    "accounts_receivable": ["ACCORECE", "NOTESACCORECE"], "current_assets": ["TOTCURRASSET"], "equity": ["PARESHARRIGH", "RIGHAGGR"],
}
CF_CODES = {"net_income": ["NETPROFIT", "PARENETP"], "net_cash_operating": ["MANANETR"], "net_cash_investing": ["INVNETCASHFLOW"], "net_cash_financing": ["FINNETCFLOW"], "net_change_in_cash": ["CASHNETR"]}


def _wide(values: DataFrame, codes: dict[str, list[str]]) -> DataFrame:
    """values (filing_id, item_code, value) as one row per filing with a column per code, then per field."""
    every = sorted({c for cs in codes.values() for c in cs})
    wide = values.groupBy("filing_id").pivot("item_code", every).agg(F.first("value"))
    return wide.select("filing_id", *(F.coalesce(*cs).alias(f) for f, cs in codes.items()))


def income_rows(values: DataFrame, codes: dict[str, list[str]] = IS_CODES) -> DataFrame:
    """Gross profit where both parts are given; operating expenses the sum of what is given; costs and taxes unsigned."""
    rows = _wide(values, codes).withColumn("cost_of_revenue", F.abs("cost_of_revenue"))
    parts = ("selling_expense", "admin_expense", "rnd_expense", "finance_expense", "taxes_and_surcharges")
    return rows.withColumn("gross_profit", F.col("total_revenue") - F.col("cost_of_revenue")).withColumn("operating_expenses", sum_given(*map(F.col, parts)))


def balance_rows(values: DataFrame, codes: dict[str, list[str]] = BS_CODES) -> DataFrame:
    """Liabilities fall back to their parts; liabilities and equity yield to total assets where they differ, and each stands in
    for the other where missing."""
    rows = _wide(values, codes)
    assets, both = F.col("total_assets"), F.col("liabilities_and_equity")
    agreed = F.when(assets.isNull(), both).when(both.isNull() | (F.abs(both - assets) > F.greatest(F.lit(1.0), F.abs(assets) * 1e-8)), assets).otherwise(both)
    rows = rows.withColumn("total_liabilities", F.coalesce("total_liabilities", sum_given(F.col("current_liabilities"), F.col("noncurrent_liabilities"))))
    return rows.withColumn("liabilities_and_equity", agreed).withColumn("total_assets", F.coalesce("total_assets", "liabilities_and_equity"))


def cash_flow_rows(values: DataFrame, income: DataFrame, codes: dict[str, list[str]] = CF_CODES) -> DataFrame:
    """Net income falls back to the income statement's."""
    rows = _wide(values, codes).join(income.select("filing_id", F.col("net_income").alias("_is")), "filing_id", "left")
    return rows.withColumn("net_income", F.coalesce("net_income", "_is")).drop("_is")


def display_overlay(canonical: DataFrame, raw: DataFrame, fields: list[str]) -> DataFrame:
    """Raw values over canonical ones where given."""
    joined = canonical.join(raw.select("filing_id", *(F.col(f).alias(f"_{f}") for f in fields)), "filing_id", "left")
    return joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*(f"_{f}" for f in fields))


def eps_status(value: Column, by_line: Column, by_item: Column) -> Column:
    """OK where there is a value, else what the line search says, else the extracted item, else MISSING."""
    return F.when(value.isNotNull(), "OK").otherwise(F.coalesce(F.nullif(by_line, F.lit("")), F.nullif(by_item, F.lit("")), F.lit("MISSING")))


def eps_rows(values: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per-share values of each filing with their statuses (statuses: filing_id, item_code, by_line, by_item)."""
    codes = {"basic": "BASICEPS", "diluted": "DILUTEDEPS"}
    wide = _wide(values, {k: [c] for k, c in codes.items()})
    told = statuses.groupBy("filing_id").agg(*(F.max(F.when(F.col("item_code") == c, F.col(s))).alias(f"{k}_{s}") for k, c in codes.items() for s in ("by_line", "by_item")))
    rows = wide.join(told, "filing_id", "left")
    return rows.select("filing_id", *(c for k in codes for c in (F.col(k).alias(f"net_income_per_share_{k}"), eps_status(F.col(k), F.col(f"{k}_by_line"), F.col(f"{k}_by_item")).alias(f"net_income_per_share_{k}_status"))))


def debt_to_equity(rows: DataFrame) -> DataFrame:
    """Liabilities by equity, the leverage figure of US and Japanese reports."""
    return rows.select("filing_id", ratio(F.col("total_liabilities"), F.col("total_shareholders_equity")).alias("debt_to_equity"))


def key_metrics(rows: DataFrame) -> DataFrame:
    c: dict[str, Column] = {n: F.col(n) for n in rows.columns}
    return rows.select(
        "filing_id", ratio(c["operating_income"], c["total_revenue"]).alias("operating_margin"), ratio(c["net_income"], c["total_revenue"]).alias("net_margin"),
        ratio(c["current_assets"], c["current_liabilities"]).alias("current_ratio"), ratio(c["total_liabilities"], c["total_assets"]).alias("debt_ratio"),
        ratio(c["net_cash_operating"], c["net_income"]).alias("cash_conversion"), (c["net_cash_operating"] + c["net_cash_investing"]).alias("free_cash_flow"),
    )


def readable(rows: DataFrame, labels: dict[str, str], symbol: str) -> DataFrame:
    """(filing_id, ordinal, label, text, raw) of the labelled fields, amounts in short form."""
    items = F.posexplode(F.array(*(F.struct(F.lit(text).alias("label"), F.col(name).cast("double").alias("raw")) for name, text in labels.items())))
    long = rows.select("filing_id", items.alias("ordinal", "i")).select("filing_id", "ordinal", "i.*")
    return long.withColumn("text", short_currency(F.col("raw"), symbol))


def readable_report(rows: DataFrame, labels: dict[str, str], symbol: str, currency: str, statuses: DataFrame) -> DataFrame:
    """readable with the raw amount in full, its unit, and Not applicable where a field's status (filing_id, label, status)
    says so and there is no value."""
    told = readable(rows, labels, symbol).join(statuses.select("filing_id", "label", "status"), ["filing_id", "label"], "left")
    none = F.col("raw").isNull() & F.coalesce(F.col("status") == "NOT_APPLICABLE", F.lit(False))
    shown = lambda text: F.when(none, "Not applicable").otherwise(text)
    return told.select("filing_id", "ordinal", "label", shown(F.col("text")).alias("text"), shown(raw_currency(F.col("raw"), symbol)).alias("raw_text"), F.lit(currency).alias("unit"))
