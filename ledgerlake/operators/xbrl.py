"""Tagged facts to canonical fields: joins with contexts and field specs, scoring, ranking, fallback chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_label, parse_number_us
from ..sources.shared import small_side, written

#: Score parts of a fact.
CONSOLIDATED, ANNUAL_US, ANNUAL_JP, NOT_ANNUAL, UNIT, TAG_STEPS = 100, 30, 20, -5, 10, 5
ANNUAL_DAYS = (300, 380)


def with_durations(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("duration_days", F.datediff("end_date", "start_date"))


def facts_x_contexts(facts: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """Facts with their context; facts of an unknown context are dropped. Without contexts, facts are such rows already."""
    if contexts is None:
        return facts
    return facts.join(with_durations(contexts).withColumnRenamed("context_id", "context_ref"), ["filing_id", "context_ref"])


def facts_x_fields(facts: DataFrame, specs: DataFrame) -> DataFrame:
    """Facts with each (stmt, field) that lists their tag, and the tag's place there."""
    tags = specs.select("stmt", "field", "period_type", "unit_keywords", F.posexplode("tags").alias("tag_pos", "tag"))
    return facts.join(small_side(tags), "tag")


def in_period(report_date: Column) -> Column:
    """Durations end on the report date and have a start; instants are, or end on, the report date."""
    duration = (F.col("end_date") == report_date) & F.col("start_date").isNotNull()
    instant = (F.col("instant") == report_date) | (F.col("end_date") == report_date)
    return F.coalesce(F.when(F.col("period_type") == "duration", duration).when(F.col("period_type") == "instant", instant), F.lit(False))


def reported(facts: DataFrame, filings: DataFrame | None) -> DataFrame:
    """Facts with each report date of their filing. Without filings, facts are such rows already."""
    return facts if filings is None else facts.join(filings.select("filing_id", "report_date").distinct(), "filing_id")


def fact_score(annual: int = ANNUAL_US) -> Column:
    days = F.when(F.col("duration_days").between(*ANNUAL_DAYS), annual).otherwise(NOT_ANNUAL)
    unit = F.exists("unit_keywords", lambda k: F.contains(F.lower(F.coalesce("unit_ref", F.lit(""))), F.lower(k)))
    return (
        F.when(F.col("is_consolidated"), CONSOLIDATED).otherwise(0)
        + F.when((F.col("period_type") == "duration") & F.col("duration_days").isNotNull(), days).otherwise(0)
        + F.when(unit, UNIT).otherwise(0) + F.greatest(F.lit(0), TAG_STEPS - F.col("tag_pos"))
    )


def scored_facts(facts: DataFrame, contexts: DataFrame | None, filings: DataFrame | None, specs: DataFrame, annual: int = ANNUAL_US) -> DataFrame:
    """All facts that qualify for a field of their filing, with value and score."""
    rows = reported(facts_x_fields(facts_x_contexts(facts, contexts), specs), filings).filter(in_period(F.col("report_date")))
    return rows.withColumn("value", parse_number_us(F.col("value_raw"))).withColumn("score", fact_score(annual))


def _best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


FIELD = ["filing_id", "stmt", "field"]


def choose_facts(scored: DataFrame, parse_first: bool = False) -> DataFrame:
    """The best fact of each filing and field; ties go to the earliest. parse_first drops unreadable values before ranking."""
    rows = scored.filter("value is not null") if parse_first else scored
    return _best(rows, FIELD, F.desc("score"), F.asc("fact_seq"))


def top_facts(scored: DataFrame, k: int = 10) -> DataFrame:
    """Up to k facts of each filing and field, equal (tag, context, value) counted once, with rank and id."""
    single = _best(scored, [*FIELD, "tag", "context_ref", "value"], F.asc("fact_seq"))
    rank = F.row_number().over(Window.partitionBy(*FIELD).orderBy(F.desc("score"), "fact_seq"))
    ranked = single.withColumn("candidate_rank", rank).filter(F.col("candidate_rank") <= k)
    return ranked.withColumn("candidate_id", F.concat_ws(".", "stmt", "field", F.lit("fact"), "candidate_rank"))


def first_tag_values(facts: DataFrame, contexts: DataFrame | None, filings: DataFrame | None, specs: DataFrame) -> DataFrame:
    """The value of the first tag that has a readable one; within a tag consolidated, then dollars, then the earliest fact."""
    ends = F.coalesce("end_date", "instant")
    rows = reported(facts_x_fields(facts_x_contexts(facts, contexts), specs), filings).filter(ends == F.col("report_date"))
    dollars = F.contains(F.upper(F.coalesce("unit_ref", F.lit(""))), F.lit("USD"))
    per_tag = _best(rows, [*FIELD, "tag_pos"], F.desc("is_consolidated"), dollars.desc(), F.asc("fact_seq"))
    readable = per_tag.withColumn("value", parse_number_us(F.col("value_raw"))).filter("value is not null")
    return readable.groupBy(*FIELD).agg(F.min_by("value", "tag_pos").alias("value"), F.min("tag_pos").alias("tag_pos"))


def label_alias_values(facts: DataFrame, contexts: DataFrame | None, filings: DataFrame | None, aliases: DataFrame) -> DataFrame:
    """The best value of each filing whose normalised tag holds an alias; an exact prefix counts a little more."""
    names = small_side(aliases.select(normalize_label(F.col("alias")).alias("alias")).filter("alias <> ''").distinct())
    labels = facts.select("tag").distinct().withColumn("label", normalize_label(F.col("tag")))  # far fewer than facts
    labels = small_side(written(labels.join(names, F.contains(F.col("label"), F.col("alias")))))
    rows = reported(facts_x_contexts(facts.join(labels, "tag"), contexts), filings).filter(F.coalesce("end_date", "instant") == F.col("report_date"))
    hits = rows.withColumn("value", parse_number_us(F.col("value_raw"))).filter("value is not null")
    score = (
        F.when(F.col("is_consolidated"), 100).otherwise(0) + F.when(F.contains(F.upper("unit_ref"), F.lit("USD")), 20).otherwise(0)
        + F.when(F.col("label").startswith(F.col("alias")), 10).otherwise(0)
    )
    return _best(hits.withColumn("score", score), ["filing_id"], F.desc("score"), F.asc("fact_seq")).select("filing_id", "tag", "value", "score")


def text_facts(facts: DataFrame, contexts: DataFrame, tags: DataFrame) -> DataFrame:
    """The text of each filing's best fact among tags (tag, tag_pos): early tags first, consolidated a little ahead."""
    rows = facts_x_contexts(facts, contexts).join(small_side(tags), "tag").filter(F.trim("value_raw") != "")
    score = 100 - F.col("tag_pos") + F.when(F.col("is_consolidated"), 10).otherwise(0)
    return _best(rows.withColumn("score", score), ["filing_id"], F.desc("score"), F.asc("fact_seq")).select("filing_id", "tag", F.trim("value_raw").alias("text"), "score")


def infer_report_dates(contexts: DataFrame) -> DataFrame:
    """Each filing's likeliest report date: end dates and instants vote, annual and consolidated contexts count more."""
    rows = with_durations(contexts)
    cons = F.col("is_consolidated")
    annual = F.when(F.col("duration_days").between(*ANNUAL_DAYS), 10).when(F.col("duration_days") > 0, 1).otherwise(0)
    ends = rows.filter("end_date is not null").select("filing_id", F.col("end_date").alias("day"), (2 + F.when(cons, 8).otherwise(0) + annual).alias("score"))
    points = rows.filter("instant is not null").select("filing_id", F.col("instant").alias("day"), (1 + F.when(cons, 4).otherwise(0)).alias("score"))
    votes = ends.union(points).groupBy("filing_id", "day").agg(F.sum("score").alias("score"))
    return votes.groupBy("filing_id").agg(F.max(F.struct("score", "day")).alias("best")).select("filing_id", F.col("best.day").alias("report_date"), F.col("best.score").alias("score"))


def longest_durations(contexts: DataFrame, filings: DataFrame, prefer_consolidated: bool = True) -> DataFrame:
    """Each filing's longest context that ends on the report date (consolidated first if preferred, then latest start), and
    the day before it starts."""
    rows = with_durations(contexts).join(filings.select("filing_id", "report_date").distinct(), "filing_id")
    rows = rows.filter("end_date = report_date and duration_days > 0")
    rank = F.struct(*([F.col("is_consolidated")] if prefer_consolidated else []), "duration_days", "start_date")
    best = rows.groupBy("filing_id").agg(F.max(rank).alias("best"))
    return best.select("filing_id", F.col("best.start_date").alias("start_date"), F.col("best.duration_days").alias("duration_days"), F.date_sub("best.start_date", 1).alias("prior_end"))


def prior_period_values(facts: DataFrame, contexts: DataFrame, filings: DataFrame, specs: DataFrame) -> DataFrame:
    """Opening values: the first-tag value at the day before the longest duration starts."""
    before = longest_durations(contexts, filings).select("filing_id", F.col("prior_end").alias("report_date"))
    return first_tag_values(facts, contexts, before, specs)


def statement_rows(chosen: DataFrame, fields: list[str]) -> DataFrame:
    """One wide row per filing; the fixed list spares the job that would look for the fields."""
    return chosen.withColumn("_f", F.concat_ws("_", "stmt", "field")).groupBy("filing_id").pivot("_f", fields).agg(F.first("value"))


def debt_split(chosen: DataFrame) -> DataFrame:
    """Long-term debt from the strict field, else the general one (flagged); the total imputes a missing side as 0 (flagged)."""
    wide = chosen.groupBy("filing_id").pivot("field", ["debt_current", "debt_noncurrent", "debt_general"]).agg(F.first("value"))
    long = F.coalesce("debt_noncurrent", "debt_general")
    wide = wide.withColumn("long_term", long).withColumn("is_proxy", (F.col("debt_noncurrent").isNull() & F.col("debt_general").isNotNull()).cast("int"))
    both_missing = F.col("debt_current").isNull() & F.col("long_term").isNull()
    total = F.when(~both_missing, F.coalesce("debt_current", F.lit(0.0)) + F.coalesce("long_term", F.lit(0.0)))
    return wide.select("filing_id", "debt_current", "long_term", "is_proxy", total.alias("total_debt"), (~both_missing & (F.col("debt_current").isNull() | F.col("long_term").isNull())).cast("int").alias("is_imputed"))


def consolidated_net_income(rows: DataFrame) -> DataFrame:
    """Net income with the minority share added where there is one."""
    return rows.withColumn("consolidated_net_income", F.col("net_income") + F.coalesce("minority_share", F.lit(0.0)))


def chain_values(scored: DataFrame, chains: DataFrame) -> DataFrame:
    """Fields as chains of single tags (field, chain_pos, source): the first source of a chain with a value."""
    best = choose_facts(scored, parse_first=True).select("filing_id", F.col("field").alias("source"), "value")
    joined = best.join(small_side(chains), "source")
    return joined.groupBy("filing_id", "field").agg(F.min_by("value", "chain_pos").alias("value"))


def cash_flow_batch(requests: DataFrame, filings: DataFrame, values: DataFrame) -> DataFrame:
    """Requests (company_key, report_date, form_type) with their filing's values, or the reason why there are none."""
    found = requests.join(filings.select("company_key", "report_date", "form_type", "filing_id").distinct(), ["company_key", "report_date", "form_type"], "left")
    error = F.when(F.col("filing_id").isNull(), "filing_not_found").when(F.col("_has").isNull(), "no_values")
    return found.join(values.withColumn("_has", F.lit(True)), "filing_id", "left").withColumn("error", error).drop("_has")


def us_values(facts: DataFrame, contexts: DataFrame | None, filings: DataFrame | None, specs: DataFrame) -> DataFrame:
    """Long canonical values with their tag: income statement and balance sheet by the best fact, cash flow by the first tag
    with a value (tag null)."""
    by_fact = choose_facts(scored_facts(facts, contexts, filings, specs.filter("stmt <> 'CF'"))).select(*FIELD, "value", F.when(F.col("value").isNotNull(), F.col("tag")).alias("tag"))
    by_tag = first_tag_values(facts, contexts, filings, specs.filter("stmt = 'CF'")).select(*FIELD, "value", F.lit(None).cast("string").alias("tag"))
    return by_fact.unionByName(by_tag)


def us_statements(facts: DataFrame, contexts: DataFrame, filings: DataFrame, specs: DataFrame) -> DataFrame:
    return us_values(facts, contexts, filings, specs).drop("tag")


def statement_constants(country: str, standard: str, currency: str) -> dict[str, Column]:
    """What is the same in all rows of a market; anomalies are found later."""
    text = {"country": country, "fiscal_period": "FY", "accounting_standard": standard, "statement_scope": "CONSOLIDATED", "currency": currency}
    open_ = {"taxonomy_version": "string", "anomaly_type": "string", "anomaly_score": "double", "anomaly_detail": "string"}
    return {k: F.lit(v) for k, v in text.items()} | {k: F.lit(None).cast(t) for k, t in open_.items()} | {"unit_scale": F.lit(1), "anomaly_flag": F.lit(0)}


def statement_header(filings: DataFrame) -> DataFrame:
    """A filing's metadata; symbol, company_id and source_filing_id (its accession number or document id) are null where
    filings has no such column."""
    known = [F.col(c).cast("string").alias(c) if c in filings.columns else F.lit(None).cast("string").alias(c) for c in ("symbol", "company_id", "source_filing_id")]
    return filings.select("filing_id", *known, "form_type", F.col("report_date").alias("fiscal_year_end_date"), "filing_date", F.year("report_date").alias("fiscal_year"))


def dated_facts(facts: DataFrame, contexts: DataFrame, filings: DataFrame, before: DataFrame, specs: DataFrame, aliases: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Facts with their contexts and a report_date on which these end or stand: a report date of filings, and the opening date
    of before (filing_id, report_date). Facts of the specs' tags, and those whose label holds an alias.

    Contexts meet the dates first, so only facts of some use are joined, once, and written; what ranks them by field, by tag,
    by label or at the opening date reads this table and joins no more.
    """
    tags = [t for r in specs.select("tags").collect() for t in r["tags"]]  # a dictionary
    wanted = F.col("tag").isin(sorted(set(tags)))
    if aliases:
        wanted |= F.exists(F.array(*(normalize_label(F.lit(a)) for a in aliases)), lambda a: F.contains(normalize_label(F.col("tag")), a))
    dates = [d.select("filing_id", "report_date").distinct().withColumn("is_opening", F.lit(o)) for d, o in ((filings, False), (before, True))]
    at = (F.col("end_date") == F.col("report_date")) | (F.col("instant") == F.col("report_date"))
    rows = written(facts_x_contexts(facts.filter(wanted), contexts.join(dates[0].unionByName(dates[1]), "filing_id").filter(at)))
    return rows.filter("not is_opening"), rows.filter("is_opening")


def us_statement_table(facts: DataFrame, contexts: DataFrame, filings: DataFrame, specs: DataFrame, exchange_labels: list[str]) -> DataFrame:
    """One row per filing with any value: every field as <statement>_<field>, the debt split with its source tags and flags,
    consolidated net income, opening cash, the exchange effect by label where no tag has it, and the filing's metadata.

    A filing's values are gathered in one aggregation over the long values; nothing is pivoted by a query of its own.
    """
    before = longest_durations(contexts, filings).select("filing_id", F.col("prior_end").alias("report_date"))
    facts, earlier = dated_facts(facts, contexts, filings, before, specs, exchange_labels)
    values = us_values(facts, None, None, specs)
    opening = first_tag_values(earlier, None, None, specs.filter("stmt = 'CF' and field = 'cash_end_of_period'"))
    opening = opening.select("filing_id", F.lit("CF").alias("stmt"), F.lit("cash_beginning_of_period").alias("field"), "value", F.lit(None).cast("string").alias("tag"))
    labels = facts.sparkSession.createDataFrame([(x,) for x in exchange_labels], "alias string")
    by_label = label_alias_values(facts, None, None, labels).select("filing_id", F.lit("CF").alias("stmt"), F.lit("exchange_by_label").alias("field"), "value", F.lit(None).cast("string").alias("tag"))
    names = [(r["stmt"], r["field"]) for r in specs.select("stmt", "field").collect()]  # a dictionary
    is_field = lambda s, f: (F.col("stmt") == s) & (F.col("field") == f)
    value = lambda s, f: F.max(F.when(is_field(s, f), F.col("value"))).alias(f"{s}_{f}")
    tag = lambda s, f: F.max(F.when(is_field(s, f), F.col("tag"))).alias(f"{f}_tag")
    debts = ("debt_current", "debt_noncurrent", "debt_general", "commercial_paper_current")
    wide = values.unionByName(opening).unionByName(by_label).groupBy("filing_id").agg(
        *(value(s, f) for s, f in [*names, ("CF", "cash_beginning_of_period"), ("CF", "exchange_by_label")]), *(tag("BS", f) for f in debts)
    )
    now, strict, general = (F.col(f"BS_{f}") for f in debts[:3])
    long = F.coalesce(strict, general)
    any_debt = F.coalesce(now, long).isNotNull()
    flag = lambda c: c.cast("int")
    wide = wide.select(
        "filing_id", *(f"{s}_{f}" for s, f in names if f not in (*debts[:3], "minority_share", "effect_of_exchange_rates_on_cash") and (s, f) != ("CF", "net_income")),
        (F.col("CF_net_income") + F.coalesce("CF_minority_share", F.lit(0.0))).alias("CF_net_income"),
        F.coalesce("CF_effect_of_exchange_rates_on_cash", "CF_exchange_by_label").alias("CF_effect_of_exchange_rates_on_cash"), "CF_cash_beginning_of_period",
        now.alias("BS_short_term_debt"), long.alias("BS_long_term_debt"), F.when(any_debt, F.coalesce(now, F.lit(0.0)) + F.coalesce(long, F.lit(0.0))).alias("BS_term_debt_total"),
        F.col("debt_current_tag").alias("short_term_debt_source_tag"), F.when(strict.isNotNull(), F.col("debt_noncurrent_tag")).otherwise(F.col("debt_general_tag")).alias("long_term_debt_source_tag"),
        F.col("commercial_paper_current_tag").alias("commercial_paper_current_source_tag"),
        flag(any_debt & now.isNull()).alias("term_debt_total_imputed_current_zero"), flag(any_debt & long.isNull()).alias("term_debt_total_imputed_noncurrent_zero"),
        flag(strict.isNull() & general.isNotNull()).alias("term_debt_noncurrent_proxy_from_generic_long_term_tag"),
    )
    return statement_header(filings).join(wide, "filing_id").withColumns(statement_constants("US", "US_GAAP", "USD") | {"is_amendment": F.lit(0)})


#: Japanese names of residual items, and the fields that they repeat.
OTHERS_JP = {
    "BS_current_assets_other_jp": "BS_other_current_assets", "BS_current_liabilities_other_jp": "BS_other_current_liabilities",
    "BS_noncurrent_liabilities_other_jp": "BS_other_noncurrent_liabilities",
}


def jp_statement_table(facts: DataFrame, contexts: DataFrame, filings: DataFrame, single: DataFrame, chains: DataFrame) -> DataFrame:
    """One row per filing with any value: every chain's field as <statement>_<field>, non-operating net where both sides are
    given, cash at the period's ends (opening cash by its tag, else the instant value at the prior end, else closing cash less
    its change), and the filing's metadata. chains' fields are named <statement>_<field>."""
    before = longest_durations(contexts, filings, False).select("filing_id", F.col("prior_end").alias("report_date"))
    facts, earlier = dated_facts(facts, contexts, filings, before, single)
    chosen = chain_values(scored_facts(facts, None, None, single, ANNUAL_JP), chains)
    at_date = chains.filter("field = 'CF_cash_at_date'")
    prior = chain_values(scored_facts(earlier, None, None, single.join(small_side(at_date.select(F.col("source").alias("field"))), "field"), ANNUAL_JP), at_date)
    chosen = chosen.unionByName(prior.withColumn("field", F.lit("CF_cash_at_prior_end")))
    names = [r["field"] for r in chains.select("field").distinct().orderBy("field").collect()]  # a dictionary
    wide = chosen.groupBy("filing_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in [*names, "CF_cash_at_prior_end"]))
    closing = F.coalesce("CF_cash_end_of_period", "CF_cash_at_date")
    opening = F.coalesce(F.col("CF_cash_beginning_of_period"), F.col("CF_cash_at_prior_end"), closing - F.col("CF_net_change_in_cash"))
    sides = ("IS_non_operating_income", "IS_non_operating_expenses")
    ends = ("CF_cash_beginning_of_period", "CF_cash_end_of_period", "CF_cash_at_date")
    wide = wide.select(
        "filing_id", *(n for n in names if n not in (*sides, *ends)), *(F.col(a).alias(b) for b, a in OTHERS_JP.items() if a in names), (F.col(sides[0]) - F.col(sides[1])).alias("IS_non_operating_income_expense_net"),
        opening.alias("CF_cash_beginning_of_period"), closing.alias("CF_cash_end_of_period"),
    )
    amended = F.col("is_amendment").cast("int") if "is_amendment" in filings.columns else F.lit(0)
    header = statement_header(filings).join(filings.select("filing_id", amended.alias("is_amendment")).distinct(), "filing_id")
    return header.join(wide, "filing_id").withColumns(statement_constants("JP", "JP_GAAP", "JPY"))
