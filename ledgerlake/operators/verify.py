"""Cases, recorded decisions, contract checks and deterministic guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import close, same_or_both_null, token_cost
from ..sources.shared import small_side

#: Decisions and statuses of the contract.
DECISIONS = ["KEEP", "REPAIR", "NEED_REVIEW"]
STATUSES = ["OK", "MISSING", "PARSE_ERROR", "NOT_APPLICABLE", "UNCHANGED"]
DECISION_TYPE = "decision string, proposed_value double, proposed_status string, evidence_item_codes array<string>, evidence array<struct<item_code:string>>, reason_code string, reason string"


def parse_decision(response: Column) -> Column:
    """A recorded response as a struct: code fences stripped, evidence codes trimmed and distinct (new or legacy form)."""
    body = F.regexp_replace(F.regexp_replace(F.trim(response), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    parsed = F.from_json(body, DECISION_TYPE)
    codes = F.coalesce(parsed["evidence_item_codes"], F.transform(parsed["evidence"], lambda e: e["item_code"]), F.array().cast("array<string>"))
    tidy = F.array_distinct(F.filter(F.transform(codes, lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != "")))
    return F.struct(
        F.upper(F.trim(parsed["decision"])).alias("decision"), parsed["proposed_value"].alias("proposed_value"),
        F.coalesce(F.upper(F.trim(parsed["proposed_status"])), F.lit("UNCHANGED")).alias("proposed_status"), tidy.alias("codes"), parsed["reason"].alias("reason"),
    )


def rule_status(value: Column, statuses: Column) -> Column:
    known = lambda s: F.array_contains(F.transform(statuses, lambda x: F.upper(F.trim(x))), s)
    return F.when(value.isNotNull(), "OK").when(known("PARSE_ERROR"), "PARSE_ERROR").when(known("NOT_APPLICABLE"), "NOT_APPLICABLE").otherwise("MISSING")


def build_cases(config: DataFrame, items: DataFrame) -> DataFrame:
    """One case per document and configured field (stmt, field, codes): its candidates in configured order, value and status."""
    codes = config.select("stmt", "field", F.posexplode("codes").alias("pos", "item_code"))
    rows = items.join(small_side(codes), ["stmt", "item_code"])
    candidates = F.array_sort(F.collect_list(F.struct("pos", "item_code", "value", "status")))
    cases = rows.groupBy("doc_id", "stmt", "field").agg(candidates.alias("candidates"))
    value = F.element_at(F.filter(F.transform("candidates", lambda c: c["value"]), lambda v: v.isNotNull()), 1)
    first = F.when(F.size(F.filter("candidates", lambda c: c["value"].isNotNull())) > 0, value)
    return cases.withColumn("rule_value", first).withColumn("rule_status", rule_status(F.col("rule_value"), F.transform("candidates", lambda c: c["status"])))


def request_payload(cases: DataFrame) -> DataFrame:
    return cases.select("doc_id", "stmt", "field", F.to_json(F.struct("stmt", "field", "rule_value", "rule_status", "candidates")).alias("payload"))


def conflicting(values: Column) -> Column:
    given = F.filter(values, lambda v: v.isNotNull())
    return F.exists(F.slice(given, 2, F.greatest(F.size(given), F.lit(1))), lambda v: ~close(F.element_at(given, 1), v)) & (F.size(given) > 1)


def contract_errors(decision: Column, status: Column, proposed: Column, rule: Column, codes: Column, candidates: Column) -> Column:
    """The error codes of a decision; candidates: array of struct(item_code, value)."""
    known = F.transform(candidates, lambda c: c["item_code"])
    supported = F.exists(candidates, lambda c: F.array_contains(codes, c["item_code"]) & close(c["value"], proposed))
    error = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(
        error(F.coalesce(~decision.isin(DECISIONS), F.lit(True)), "decision_invalid"), error(~status.isin(STATUSES), "proposed_status_invalid"),
        error(F.size(F.array_except(codes, known)) > 0, "evidence_item_codes_out_of_candidates"),
        error(decision.isin("KEEP", "REPAIR") & (F.size(codes) == 0), "missing_evidence_item_codes"),
        error((decision == "KEEP") & ~same_or_both_null(proposed, rule), "keep_value_must_equal_rule_value"),
        error((decision == "KEEP") & conflicting(F.transform(candidates, lambda c: c["value"])), "keep_not_allowed_with_conflicting_candidates"),
        error((decision == "REPAIR") & proposed.isNull(), "repair_requires_proposed_value"),
        error((decision == "REPAIR") & proposed.isNotNull() & ~supported, "repair_value_not_supported_by_evidence_item_codes"),
        error((decision == "NEED_REVIEW") & proposed.isNotNull(), "need_review_requires_null_proposed_value"),
    ))


def repair_guardrails(rows: DataFrame, only_missing: bool = True, disable_repair: bool = False) -> DataFrame:
    """Decisions joined with their case (decision, rule_value, rule_status, proposed_value, n_evidence, supported): the first
    failing guard turns a repair into a review that keeps the rule value; a KEEP without evidence is reviewed."""
    allowed = F.col("rule_status").isin("MISSING", "PARSE_ERROR") if only_missing else F.lit(True)
    guard = F.when(
        F.col("decision") == "REPAIR",
        F.when(F.lit(disable_repair), "verify_only_mode").when(~allowed, "repair_not_allowed_for_rule_status").when(close(F.col("proposed_value"), F.col("rule_value")), "noop_repair_same_as_rule")
        .when(F.col("n_evidence") == 0, "missing_evidence").when(F.col("proposed_value").isNull(), "missing_proposed_value").when(~F.col("supported"), "unsupported_repair_value"),
    )
    out = rows.withColumn("guard_fail", guard).withColumn("repair_applied", (F.col("decision") == "REPAIR") & F.col("guard_fail").isNull())
    out = out.withColumn("final_decision", F.when(F.col("guard_fail").isNotNull(), "NEED_REVIEW").otherwise(F.col("decision")))
    out = out.withColumn("final_value", F.when(F.col("repair_applied"), F.col("proposed_value")).otherwise(F.col("rule_value")))
    review = (F.col("final_decision") == "NEED_REVIEW") | ((F.col("decision") == "KEEP") & (F.col("n_evidence") == 0))
    return out.withColumn("final_source", F.when(F.col("repair_applied"), "llm_repair").otherwise("rule")).withColumn("review_required", review)


def extract_guardrails(rows: DataFrame) -> DataFrame:
    """The same for extraction without a rule value (decision, proposed_status, proposed_value, n_evidence, supported, supports_na)."""
    ok, na = F.col("proposed_status") == "OK", F.col("proposed_status") == "NOT_APPLICABLE"
    guard = F.when(
        F.col("decision") == "EXTRACT",
        F.when(F.col("n_evidence") == 0, "missing_evidence").when(ok & F.col("proposed_value").isNull(), "missing_proposed_value").when(ok & ~F.col("supported"), "unsupported_extract_value")
        .when(na & ~F.col("supports_na"), "unsupported_not_applicable").when(~ok & ~na, "invalid_extract_status"),
    )
    out = rows.withColumn("guard_fail", guard).withColumn("final_decision", F.when(F.col("guard_fail").isNotNull(), "NEED_REVIEW").otherwise(F.col("decision")))
    kept = F.col("final_decision") == "EXTRACT"
    return out.withColumn("final_value", F.when(kept & ok, F.col("proposed_value"))).withColumn("final_source", F.when(kept, "llm_only").otherwise("llm_only_review")).withColumn("review_required", ~kept)


def first_valid_attempts(attempts: DataFrame, most: int) -> DataFrame:
    """Each case's first attempt without errors among the first ones; cases without are left out."""
    valid = attempts.filter((F.size("errors") == 0) & (F.col("attempt") <= most))
    return valid.groupBy("case_id").agg(F.min_by("response", "attempt").alias("response"), F.min("attempt").alias("attempt"))


def audit_table(cases: DataFrame, decisions: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Cases with their decision after guardrails and its cost; without one: NEED_REVIEW, llm_call_failed, rule value kept."""
    joined = cases.join(decisions.withColumn("_found", F.lit(True)), "case_id", "left")
    rows = repair_guardrails(joined.withColumn("decision", F.coalesce("decision", F.lit("NEED_REVIEW"))), only_missing=False)
    rows = rows.withColumn("guard_fail", F.when(F.col("_found").isNull(), "llm_call_failed").otherwise(F.col("guard_fail")))
    return rows.withColumn("cost_usd", token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), price_in, price_out)).drop("_found")


def low_confidence(candidates: DataFrame) -> DataFrame:
    """Why each field's first candidate needs a wider look, the first reason that holds; null if none does.

    candidates: filing_id, stmt, field, candidate_rank, score, tag_priority, is_consolidated, aligned, unit_match, value.
    """
    by = Window.partitionBy("filing_id", "stmt", "field")
    rows = candidates.withColumn("_gap", F.col("score") - F.lead("score").over(by.orderBy("candidate_rank")))
    any_other = lambda c: F.max(F.col(c).cast("int")).over(by) == 1
    rows = rows.withColumns({"_cons": any_other("is_consolidated"), "_aligned": any_other("aligned"), "_unit": any_other("unit_match")}).filter("candidate_rank = 1")
    reason = (
        F.when(F.col("value").isNull(), "missing").when(F.col("_gap") < 15, "score_gap").when(F.col("tag_priority") <= 1, "tag_priority").when(~F.col("is_consolidated") & F.col("_cons"), "not_consolidated")
        .when(~F.col("aligned") & F.col("_aligned"), "period").when(~F.col("unit_match") & F.col("_unit"), "unit")
    )
    income = lambda s: F.max(F.when((F.col("stmt") == s) & (F.col("field") == "net_income"), F.col("value"))).over(Window.partitionBy("filing_id"))
    rows = rows.withColumns({"_is": income("IS"), "_cf": income("CF")})
    apart = (F.col("field") == "net_income") & F.col("_is").isNotNull() & F.col("_cf").isNotNull() & ~close(F.col("_is"), F.col("_cf"))
    return rows.select("filing_id", "stmt", "field", F.coalesce(reason, F.when(apart, "net_income_mismatch")).alias("reason"))


def cross_statement(values: DataFrame, one: str = "IS", other: str = "CF", field: str = "net_income") -> DataFrame:
    """The field's value in either statement next to the other's, and whether they differ."""
    rows = values.filter((F.col("field") == field) & F.col("stmt").isin(one, other))
    swapped = rows.select("filing_id", F.when(F.col("stmt") == one, other).otherwise(one).alias("stmt"), F.col("value").alias("other_value"))
    joined = rows.join(swapped, ["filing_id", "stmt"], "left")
    return joined.select("filing_id", "stmt", "value", "other_value", (F.col("value").isNotNull() & F.col("other_value").isNotNull() & ~close(F.col("value"), F.col("other_value"))).alias("mismatch"))


def cross_candidates(cases: DataFrame, top: DataFrame, values: DataFrame, most: int = 6) -> DataFrame:
    """Cases of the fact pool: where low_confidence gave a reason, the field's first facts; always the field's own value; for
    net income also the other statement's. Empty candidates are left out, equal codes counted once, in that order."""
    own = values.select("filing_id", "stmt", "field", F.lit(100).alias("pos"), F.concat_ws(".", "stmt", "field").alias("item_code"), "value")
    other = F.when(F.col("stmt") == "IS", "CF").when(F.col("stmt") == "CF", "IS")
    swapped = values.filter("field = 'net_income' and stmt in ('IS', 'CF')").select("filing_id", other.alias("stmt"), "field", F.lit(101).alias("pos"), F.concat_ws(".", "stmt", "field").alias("item_code"), "value")
    pool = top.join(cases.filter("reason is not null").select("filing_id", "stmt", "field"), ["filing_id", "stmt", "field"], "left_semi").filter(F.col("candidate_rank") <= most)
    pool = pool.select("filing_id", "stmt", "field", F.col("candidate_rank").alias("pos"), F.col("candidate_id").alias("item_code"), "value")
    rows = pool.unionByName(own).unionByName(swapped).filter("value is not null").groupBy("filing_id", "stmt", "field", "item_code").agg(F.min(F.struct("pos", "value")).alias("c"))
    found = rows.groupBy("filing_id", "stmt", "field").agg(F.array_sort(F.collect_list(F.struct("c.pos", "item_code", "c.value"))).alias("candidates"))
    return cases.join(found, ["filing_id", "stmt", "field"], "left")


def doc_guardrails(rows: DataFrame) -> DataFrame:
    """Extraction from page quotes (decision, proposed_status, proposed_value, n_evidence, na_quoted): values need no support."""
    rows = rows.withColumn("supported", F.lit(True)).withColumn("supports_na", F.col("na_quoted"))
    out = extract_guardrails(rows).drop("supported", "supports_na")
    return out.withColumn("final_source", F.when(F.col("final_decision") == "EXTRACT", "llm_doc_only").otherwise("llm_doc_only_review"))


def fill_missing_fields(wanted: DataFrame, results: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Every wanted field with its guarded result; without one: NEED_REVIEW for the reason, no value, to be reviewed."""
    joined = wanted.join(results.withColumn("_found", F.lit(True)), keys, "left")
    gone = F.col("_found").isNull()
    return joined.withColumns({
        "final_decision": F.when(gone, "NEED_REVIEW").otherwise(F.col("final_decision")), "guard_fail": F.when(gone, reason).otherwise(F.col("guard_fail")), "review_required": F.coalesce("review_required", F.lit(True)),
    }).drop("_found")


def evidence(codes: Column, candidates: Column, reason: Column) -> Column:
    """Cited candidates as (item_code, quote, why)."""
    hits = F.filter(candidates, lambda c: F.array_contains(codes, c["item_code"]))
    why = F.coalesce(F.nullif(reason, F.lit("")), F.lit("Supported by candidate evidence."))
    return F.transform(hits, lambda c: F.struct(c["item_code"].alias("item_code"), F.concat(F.lit("value: "), F.coalesce(c["value"].cast("string"), F.lit("None"))).alias("quote"), why.alias("why")))


#: Keys of a decision that have a column of their own.
DECISION_KEYS = ("decision", "proposed_value", "proposed_status", "evidence_item_codes", "evidence", "reason_code", "reason")


def open_decisions(responses: DataFrame) -> DataFrame:
    """case_id, decision, proposed_value, codes, and whole (a VARIANT with all that the response holds) of responses (case_id,
    response) of any shape: code fences stripped; null where a text is no JSON or a field isn't of its type.

    evidence may be a list of codes, of objects with item_code, or one code; codes are trimmed, distinct, in order.
    """
    body = F.regexp_replace(F.regexp_replace(F.trim("response"), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    rows = responses.select("case_id", F.try_parse_json(body).alias("whole"))
    get = lambda path, kind: F.try_variant_get(F.col("whole"), path, kind)
    listed = F.coalesce(get("$.evidence_item_codes", "array<variant>"), get("$.evidence", "array<variant>"), F.when(get("$.evidence", "string").isNotNull(), F.array(F.variant_get("whole", "$.evidence", "variant"))), F.array().cast("array<variant>"))
    codes = F.transform(listed, lambda e: F.trim(F.coalesce(F.try_variant_get(e, "$.item_code", "string"), F.try_variant_get(e, "$", "string"))))
    return rows.select(
        "case_id", F.upper(F.trim(get("$.decision", "string"))).alias("decision"), get("$.proposed_value", "double").alias("proposed_value"),
        F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != "") & ~c.startswith("{"))).alias("codes"), "whole",
    )


def unknown_keys(decisions: DataFrame) -> DataFrame:
    """case_id, key and value (as JSON text) of what open_decisions has no column for, so that nothing a response says is lost."""
    rows = decisions.select("case_id", "whole").filter(F.schema_of_variant("whole").startswith("OBJECT"))
    keys = rows.sparkSession.sql("SELECT case_id, key, to_json(value) AS value FROM {rows}, LATERAL variant_explode(whole)", rows=rows)
    return keys.filter(~F.col("key").isin(*DECISION_KEYS))
