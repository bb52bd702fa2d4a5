"""Instance documents (one XML text per filing) as fact and context rows, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FACT = r"(?s)<(?:[\w.-]+:)?([\w.-]+)((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s+contextRef\s*=\s*(?:\"[^\"]*\"|'[^']*')(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?:/>|>([^<]*)</)"
_CONTEXTS = "context array<struct<_id:string,entity:struct<segment:string>,period:struct<startDate:string,endDate:string,instant:string>>>"


def _attribute(name: str):
    return F.nullif(F.regexp_extract("element", rf"\b{name}\s*=\s*[\"']([^\"']*)", 1), F.lit(""))


def read_facts(documents: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Facts (elements with a contextRef) in document order, their namespace stripped; drop_empty leaves out nil and empty ones."""
    found = documents.select("filing_id", F.posexplode(F.regexp_extract_all("xml", F.lit(_FACT), F.lit(0))).alias("fact_seq", "element"))
    rows = found.select(
        "filing_id", F.col("fact_seq").cast("long").alias("fact_seq"), F.regexp_extract("element", _FACT, 1).alias("tag"), _attribute("contextRef").alias("context_ref"), _attribute("unitRef").alias("unit_ref"),
        _attribute("decimals").alias("decimals"), F.trim(F.regexp_extract("element", _FACT, 3)).alias("value_raw"), F.col("element").rlike(r"\bnil\s*=\s*[\"'](true|1)").alias("_nil"),
    )
    return (rows.filter("not _nil and value_raw <> ''") if drop_empty else rows).drop("_nil")


def read_contexts(documents: DataFrame) -> DataFrame:
    """Contexts with their dates, duration, and whether they are consolidated (no segment)."""
    parsed = F.from_xml("xml", _CONTEXTS, {"ignoreNamespace": "true"})
    rows = documents.select("filing_id", F.explode(parsed["context"]).alias("c"))
    day = lambda n: F.try_to_date(F.trim(f"c.period.{n}"), "yyyy-MM-dd")
    out = rows.select("filing_id", F.col("c._id").alias("context_id"), day("startDate").alias("start_date"), day("endDate").alias("end_date"), day("instant").alias("instant"), F.col("c.entity.segment").isNull().alias("is_consolidated"))
    return out.withColumn("duration_days", F.datediff("end_date", "start_date"))
