"""Whole Chinese statements: several readings of a filing's items merged by priority into one canonical row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sum_given
from .xbrl import statement_constants, statement_header

#: By statement, the canonical fields and the item codes that fill them, in order.
FIELDS = {
    "IS": {
        "total_revenue": ["BIZTOTINCO", "BIZINCO"], "cost_of_revenue": ["BIZTOTCOST", "BIZCOST"], "taxes_and_surcharges": ["BIZTAX"],
        "selling_expense": ["SALESEXPE"], "admin_expense": ["MANAEXPE"], "rnd_expense": ["DEVEEXPE"], "finance_expense": ["FINEXPE", "FININCO"],
        "operating_income": ["PERPROFIT"], "non_operating_income": ["NONOREVE"], "non_operating_expense": ["NONOEXPE"], "other_income": ["OTHERINCO"],
        "income_before_income_taxes": ["TOTPROFIT"], "provision_for_income_taxes": ["INCOTAXEXPE"], "net_income": ["NETPROFIT", "PARENETP"],
        "net_income_per_share_basic": ["BASICEPS"], "net_income_per_share_diluted": ["DILUTEDEPS"],
    },
    "BS": {
        "total_assets": ["TOTASSET"], "cash_and_cash_equivalents": ["CURFDS"], "short_term_investments": ["TRADFINASSET"], "inventories": ["INVE"],
        "accounts_receivable": ["ACCORECE", "NOTESACCORECE"], "other_current_assets": ["OTHERCURRASSE"], "total_current_assets": ["TOTCURRASSET"],
        "property_plant_and_equipment_net": ["FIXEDASSENETW", "FIXEDASSEIMMO"], "goodwill": ["GOODWILL"], "intangible_assets": ["INTAASSET"],
        "other_noncurrent_assets": ["OTHERNONCASSE", "OTHENONCASSE"], "accounts_payable": ["ACCOPAYA", "NOTESACCOPAYA"], "short_term_debt": ["SHORTTERMBORR", "SHORTBORR"],
        "other_current_liabilities": ["OTHERCURRELIABI", "OTHERCURLIAB"], "total_current_liabilities": ["TOTALCURRLIAB"], "long_term_debt": ["LONGBORR"],
        "other_noncurrent_liabilities": ["OTHERNONCLIABI", "OTHENONCLIAB"], "total_noncurrent_liabilities": ["TOTALNONCLIAB"], "total_liabilities": ["TOTLIAB"],
        "total_shareholders_equity": ["PARESHARRIGH", "RIGHAGGR"], "accumulated_other_comprehensive_income_or_loss": ["OTHERCOMPINCO"], "common_stock": ["PAIDINCAPI"],
        "additional_paid_in_capital": ["CAPISURP"], "retained_earnings": ["UNDIPROF"], "noncontrolling_interests": ["MINYSHARRIGH"],
        "total_liabilities_and_shareholders_equity": ["TOTLIABSHAREQUI"],
    },
    "CF": {
        "net_income": ["NETPROFIT", "PARENETP"], "net_cash_operating": ["MANANETR"], "net_cash_investing": ["INVNETCASHFLOW"], "net_cash_financing": ["FINNETCFLOW"],
        "effect_of_exchange_rates_on_cash": ["CHGEXCHGCHGS"], "net_change_in_cash": ["CASHNETR"], "cash_beginning_of_period": ["INICASHBALA"], "cash_end_of_period": ["FINALCASHBALA"],
    },
}
#: Labels that tell which side of the finance result a line gave; what marks an amended filing's title.
FINANCE_LABELS = ("财务费用", "财务收入")
AMENDED = "更正"
#: Readings in order of trust: lines of the page text, extracted tables, figures derived from others.
SOURCES = ("line", "table", "derived")
_PARTS = ("selling_expense", "admin_expense", "rnd_expense", "finance_expense", "taxes_and_surcharges")


def field_values(values: DataFrame, fields=FIELDS, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """filing_id, stmt and field with value, item_code and source of the reading that wins, and what the readings say besides.

    values: filing_id, stmt, item_code, source, seq, value, status, raw_text, label; one row a reading. A field takes its first
    code that any source has a value for, of its readings the most trusted source's, there the first by seq; sources that
    aren't listed come last. line_status, table_status, raw_text (of tables) and label (of lines) are kept of readings
    without a value too. The values are exchanged once, by filing, for this and for statement_table.
    """
    spark = values.sparkSession
    spec = spark.createDataFrame([(s, c, f, i) for s, of in fields.items() for f, cs in of.items() for i, c in enumerate(cs)], "stmt string, item_code string, field string, code_pos int")
    rank = F.coalesce(F.nullif(F.array_position(F.lit(list(sources)), F.col("source")), F.lit(0)), F.lit(len(sources) + 1))
    rows = values.join(F.broadcast(spec), ["stmt", "item_code"]).repartition("filing_id")  # the spec: one row a code
    said = lambda source, c: F.max(F.when(F.col("source") == source, F.nullif(F.col(c), F.lit(""))))
    order = F.when(F.col("value").isNotNull(), F.struct("code_pos", rank.alias("rank"), "seq", "value"))
    found = rows.groupBy("filing_id", "stmt", "field").agg(
        F.min_by(F.struct("value", "item_code", "source"), order).alias("best"), said("line", "status").alias("line_status"),
        said("table", "status").alias("table_status"), said("table", "raw_text").alias("raw_text"), said("line", "label").alias("label"),
    )
    return found.select("filing_id", "stmt", "field", F.when(F.col("best.value").isNotNull(), F.col("best")).alias("best"), "line_status", "table_status", "raw_text", "label").select(
        "filing_id", "stmt", "field", "best.value", "best.item_code", "best.source", "line_status", "table_status", "raw_text", "label"
    )


def _derived(of) -> dict[str, Column]:
    """The statements' columns that are not just a field's value; of(name) is the value of <statement>_<field>."""
    cost, revenue = F.abs(of("IS_cost_of_revenue")), of("IS_total_revenue")
    gain, loss = of("IS_non_operating_income"), F.abs(of("IS_non_operating_expense"))
    cash, invested = of("BS_cash_and_cash_equivalents"), of("BS_short_term_investments")
    assets, both = of("BS_total_assets"), of("BS_total_liabilities_and_shareholders_equity")
    apart = F.abs(both - assets) > F.greatest(F.lit(1.0), F.abs(assets) * 1e-8)
    return {
        "IS_cost_of_revenue": cost, "IS_gross_profit": revenue - cost, "IS_operating_expenses": sum_given(*(of(f"IS_{p}") for p in _PARTS)),
        "IS_non_operating_income_expense_net": F.when(F.coalesce(gain, loss).isNotNull(), F.coalesce(gain, F.lit(0.0)) - F.coalesce(loss, F.lit(0.0))),
        "IS_provision_for_income_taxes": F.abs(of("IS_provision_for_income_taxes")),
        "BS_total_cash_and_short_term_investments": cash + invested,
        "BS_total_liabilities": F.coalesce(of("BS_total_liabilities"), sum_given(of("BS_total_current_liabilities"), of("BS_total_noncurrent_liabilities"))),
        "BS_total_liabilities_and_shareholders_equity": F.when(assets.isNotNull() & (both.isNull() | apart), assets).otherwise(both),
        "BS_total_assets": F.coalesce(assets, both), "CF_net_income": F.coalesce(of("CF_net_income"), of("IS_net_income")),
    }


#: Fields that only serve others.
HIDDEN = {"IS_non_operating_income", "IS_non_operating_expense", "BS_total_noncurrent_liabilities"}


def statement_table(values: DataFrame, filings: DataFrame) -> DataFrame:
    """One row per filing with any reading: all fields as <statement>_<field>, the derived ones, status and raw text of the
    per-share values, the finance result's label, reported_unit, the filing's metadata and the (empty) anomaly columns.

    values as in field_values; filings also has title and reported_unit. A per-share value has status OK where it is given,
    else what its lines say, else its table, else MISSING. Revenue and cost prefer the totals, costs and taxes are unsigned;
    where assets and the other side differ, assets count; a cash-flow statement without net income takes the income
    statement's.
    """
    found = field_values(values)
    entry = F.struct(F.concat_ws("_", "stmt", "field").alias("key"), F.struct("value", "line_status", "table_status", "raw_text", "label").alias("of"))
    rows = found.groupBy("filing_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # some fifty fields a filing
    of = lambda name: F.col("m")[name]["value"]
    derived = _derived(of)
    names = [f"{s}_{f}" for s, fs in FIELDS.items() for f in fs]
    plain = {n: of(n) for n in names if n not in HIDDEN} | derived
    for kind in ("basic", "diluted"):
        share = F.col("m")[f"IS_net_income_per_share_{kind}"]
        plain[f"IS_net_income_per_share_{kind}_status"] = F.when(share["value"].isNotNull(), "OK").otherwise(F.coalesce(share["line_status"], share["table_status"], F.lit("MISSING")))
        plain[f"IS_net_income_per_share_{kind}_raw_text"] = share["raw_text"]
        plain[f"IS_shares_outstanding_{kind}"] = F.lit(None).cast("double")
    label = F.col("m")["IS_finance_expense"]["label"]
    plain["IS_finance_result_source_label"] = F.when(label.isin(*FINANCE_LABELS), label)
    header = statement_header(filings.withColumn("form_type", F.col("title"))).join(filings.select("filing_id", "reported_unit", F.contains("title", F.lit(AMENDED)).cast("int").alias("is_amendment")), "filing_id")
    return header.join(rows.select("filing_id", *(c.alias(n) for n, c in plain.items())), "filing_id").withColumns(statement_constants("CN", "CN_GAAP", "CNY"))


def display_overlay(canonical: DataFrame, raw: DataFrame) -> DataFrame:
    """canonical (filing_id and the income statement's fields by name) with the raw reading's values over it, where it has any.

    raw: filing_id, item_code, value and seq of the income statement's table as extracted; the last row of a code counts.
    """
    fields = {f: FIELDS["IS"][f] for f in OVERLAID}
    last = raw.filter("value is not null").groupBy("filing_id", "item_code").agg(F.max_by("value", "seq").alias("value"))
    said = last.groupBy("filing_id").agg(F.map_from_entries(F.collect_list(F.struct("item_code", "value"))).alias("m"))
    rows = canonical.join(said, "filing_id", "left")
    return rows.withColumns({f: F.coalesce(*(F.col("m")[c] for c in cs), F.col(f)) for f, cs in fields.items()}).drop("m")


#: The fields whose raw reading is shown.
OVERLAID = (
    "total_revenue", "cost_of_revenue", "taxes_and_surcharges", "selling_expense", "admin_expense", "rnd_expense", "finance_expense", "net_income",
    "net_income_per_share_basic", "net_income_per_share_diluted",
)
