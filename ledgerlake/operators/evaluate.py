"""Review templates and metrics: coverage, accuracy, workload, false repairs, cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, normalize_symbol, parse_flag, parse_match, to_double


def require_columns(df: DataFrame, required: list[str], defaults: dict | None = None) -> DataFrame:
    """df with missing columns of defaults added; a missing required one is an error."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.lit(v) for c, v in (defaults or {}).items() if c not in df.columns})


def coverage_accuracy(checklist: DataFrame, match: str = "is_match") -> DataFrame:
    """Totals, extracted, reviewed and correct fields with their rates at four grains: all, market, statement, field.

    level (0 finest, 7 all) tells a subtotal from a group whose key is null.
    """
    rows = checklist.withColumn("_match", parse_match(F.col(match)))
    out = rows.rollup("market", "statement", "field_name").agg(
        F.count("field_name").alias("total"), F.count("extracted_value").alias("extracted"), F.count("_match").alias("reviewed"),
        F.count_if(F.col("_match") == 1).alias("correct"), F.grouping_id().alias("level"),
    )
    return out.withColumn("coverage", F.col("extracted") / F.greatest("total", F.lit(1))).withColumn("accuracy", F.try_divide("correct", "reviewed"))


def system_metrics(rows: DataFrame, systems: dict[str, tuple[str, str | None]], base: str = "rule") -> DataFrame:
    """Accuracy and workload of each system (name: match column, review column or None for all rows), overall (market null,
    level 1) and by market, and both against the base system."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("system"), parse_match(F.col(m)).alias("hit"), (parse_flag(F.col(r)) if r else F.lit(1)).alias("review")) for n, (m, r) in systems.items())))
    long = rows.select("market", each.alias("s")).select("market", "s.*")
    out = long.groupingSets([["market", "system"], ["system"]], "market", "system").agg(
        F.count("*").alias("total_rows"), F.count("hit").alias("reviewed_rows"), F.count_if(F.col("hit") == 1).alias("correct_rows"), F.sum("review").alias("review_required_rows"), F.grouping("market").cast("int").alias("level"),
    )
    out = out.withColumn("accuracy", F.try_divide("correct_rows", "reviewed_rows")).withColumn("workload_rate", F.try_divide("review_required_rows", "total_rows"))
    of_base = lambda c: F.max(F.when(F.col("system") == base, F.col(c))).over(Window.partitionBy("market", "level"))
    return out.withColumn("workload_reduction", 1 - F.try_divide(F.col("workload_rate"), of_base("workload_rate"))).withColumn("accuracy_delta", F.col("accuracy") - of_base("accuracy"))


def false_repairs(rows: DataFrame, match: str, applied: str) -> DataFrame:
    hit, on = parse_match(F.col(match)), parse_flag(F.col(applied)) == 1
    counts = rows.agg(F.count_if(on).alias("repair_applied_rows"), F.count_if(on & hit.isNotNull()).alias("repair_reviewed_rows"), F.count_if(on & (hit == 0)).alias("false_repair_rows"))
    return counts.withColumn("false_repair_rate", F.try_divide("false_repair_rows", "repair_reviewed_rows"))


def ablation_summary(rows: DataFrame, rule: str, final: str, review: str, applied: str) -> DataFrame:
    """Rule against final accuracy, workload and false repairs: overall (level 1) and by market (level 0)."""
    r, f, on = parse_match(F.col(rule)), parse_match(F.col(final)), parse_flag(F.col(applied)) == 1
    out = rows.rollup("market").agg(
        F.count("*").alias("total_rows"), F.count(r).alias("reviewed_rule"), F.count_if(r == 1).alias("correct_rule"), F.count(f).alias("reviewed_final"), F.count_if(f == 1).alias("correct_final"),
        F.sum(parse_flag(F.col(review))).alias("review_required_rows"), F.count_if(on).alias("repair_applied_rows"), F.count_if(on & f.isNotNull()).alias("repair_reviewed_rows"),
        F.count_if(on & (f == 0)).alias("false_repair_rows"), F.grouping("market").cast("int").alias("level"),
    )
    out = out.withColumn("accuracy_rule", F.try_divide("correct_rule", "reviewed_rule")).withColumn("accuracy_final", F.try_divide("correct_final", "reviewed_final"))
    out = out.withColumn("accuracy_delta", F.col("accuracy_final") - F.col("accuracy_rule")).withColumn("workload_rate", F.try_divide("review_required_rows", "total_rows"))
    return out.withColumn("workload_reduction", 1 - F.col("workload_rate")).withColumn("false_repair_rate", F.try_divide("false_repair_rows", "repair_reviewed_rows"))


def backbone_metrics(rows: DataFrame, models: list[str]) -> DataFrame:
    """Filled, review and accuracy rates and the cost of each model (columns <m>_value, <m>_review_required, is_match_<m>, <m>_cost)."""
    require_columns(rows, [c for m in models for c in (f"{m}_value", f"{m}_review_required", f"is_match_{m}", f"{m}_cost")])
    part = lambda m: F.struct(
        F.lit(m).alias("model_key"), blank_to_null(F.col(f"{m}_value").cast("string")).alias("value"), parse_flag(F.col(f"{m}_review_required").cast("string")).alias("review"),
        parse_match(F.col(f"is_match_{m}")).alias("hit"), F.coalesce(to_double(F.col(f"{m}_cost").cast("string")), F.lit(0.0)).cast("decimal(38,9)").alias("cost"),
    )
    out = rows.select(F.explode(F.array(*map(part, models))).alias("m")).select("m.*").groupBy("model_key").agg(
        F.count("*").alias("total_rows"), F.count("value").alias("filled_rows"), F.sum("review").alias("review_required_rows"), F.count("hit").alias("reviewed_rows"),
        F.count_if(F.col("hit") == 1).alias("correct_rows"), F.sum("cost").cast("double").alias("cost_total"),
    )
    rates = {"filled_rate": ("filled_rows", "total_rows"), "conflict_rate": ("review_required_rows", "total_rows"), "accuracy": ("correct_rows", "reviewed_rows"), "cost_per_field": ("cost_total", "total_rows")}
    return out.withColumns({k: F.try_divide(*v) for k, v in rates.items()})


KEYS = ["market", "symbol", "statement", "field_name"]


def _keyed(df: DataFrame) -> DataFrame:
    market = F.lower(F.trim("market"))
    return df.withColumns({"market": market, "symbol": normalize_symbol(market, F.col("symbol")), "statement": F.upper(F.trim("statement")), "field_name": F.trim("field_name")})


def with_audit(checklist: DataFrame, audit: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The checklist with the audit's columns. Of repeated audit rows the last (by input_seq) counts; defaults (values or
    columns) stand only where no audit row matches, so an empty audit value stays empty."""
    last = Window.partitionBy(*KEYS).orderBy(F.desc("input_seq"))
    rows = _keyed(audit).filter(reduce(lambda a, b: a & b, (F.col(k) != "" for k in KEYS))).withColumn("_rank", F.row_number().over(last)).filter("_rank = 1")
    rows = rows.select(*KEYS, F.lit(True).alias("_matched"), *(F.col(c).alias(f"_{c}") for c in defaults))
    joined = _keyed(checklist).join(rows, KEYS, "left")
    filled = {c: F.when(F.col("_matched"), F.col(f"_{c}")).otherwise(v if hasattr(v, "cast") else F.lit(v)) for c, v in defaults.items()}
    return joined.withColumns(filled).drop("_matched", *(f"_{c}" for c in defaults))


def multi_system_template(checklist: DataFrame, audits: dict[str, DataFrame]) -> DataFrame:
    """The checklist with final_value and review flag of each system, 1 where a system has no row."""
    out = checklist
    for name, audit in audits.items():
        rows = audit.withColumnsRenamed({"final_value": f"{name}_value", "review_required": f"{name}_review_required"})
        out = with_audit(out, rows, {f"{name}_value": F.lit(None).cast("double"), f"{name}_review_required": 1})
    return out


def checklist(wide: DataFrame, runs: DataFrame, fields: dict[str, tuple[str, str]], metadata: tuple[str, ...] = ()) -> DataFrame:
    """One row per successful run and field (name, or statement and name joined by a dot: statement, column of wide), with
    metadata columns of wide."""
    items = F.explode(F.array(*(F.struct(F.lit(s).alias("statement"), F.lit(n.rpartition(".")[2]).alias("field_name"), F.col(c).cast("double").alias("extracted_value")) for n, (s, c) in fields.items())))
    return runs.filter("status = 'success'").join(wide, "filing_id").select("filing_id", "market", *metadata, items.alias("i")).select("filing_id", "market", *metadata, "i.*")


def merge_audits(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def repaired_rows(rows: DataFrame, applied: str, columns: list[str]) -> DataFrame:
    return rows.filter(parse_flag(F.col(applied)) == 1).select(*columns)
