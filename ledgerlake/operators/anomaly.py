"""Balance sheet anomalies: imbalance, missing anchors, merged lines, markers, cash-flow consistency."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BLANK
from ..sources.shared import small_side

TOLERANCE = 1e-4
#: A section that lacks so many anchors is flagged.
LEAST_MISSING = 3
#: Marker texts, their section and flag.
MARKERS = [
    ("特殊不平_流动资产", "current_assets", "IMBALANCE"), ("特殊格式_流动资产", "current_assets", "FORMAT"), ("特殊归并_流动资产", "current_assets", "AGGREGATION"),
    ("特殊不平_非流动资产", "noncurrent_assets", "IMBALANCE"), ("特殊格式_非流动资产", "noncurrent_assets", "FORMAT"), ("特殊归并_非流动资产", "noncurrent_assets", "AGGREGATION"),
]
#: Known merged lines with their codes, and the characters that join names.
MERGED = [("应收票据及应收账款", ["NOTESRECE", "ACCORECE"]), ("其他应收款及应收利息", ["OTHERRECE", "INTERECE"])]
CONNECTORS = "[及和与以合并计其中包含、]"
HEADER_WORDS = ["项目", "本年年末", "上年年末", "期末", "期初", "附注"]


def _sums(items: DataFrame) -> DataFrame:
    return items.groupBy("section_id").agg((F.sum(F.round(F.col("value") * 1e6).cast("decimal(30,0)")).cast("double") / 1e6).alias("children_sum"), F.count("value").alias("n_children"))


def _apart(parent: Column, total: Column) -> Column:
    return F.abs(parent - total) > F.greatest(F.lit(1.0), F.abs(parent) * TOLERANCE)


def section_imbalance(sections: DataFrame, items: DataFrame) -> DataFrame:
    """Children sum, difference and flag of each section: nulls skipped, no parent no flag, no children flagged."""
    rows = sections.join(_sums(items), "section_id", "left")
    has, parent = F.col("n_children") > 0, F.col("parent_value")
    total = F.when(parent.isNotNull() & has, F.col("children_sum"))
    flag = F.when(parent.isNull(), False).when(has, _apart(parent, F.col("children_sum"))).otherwise(True)
    return rows.select("section_id", "parent_value", total.alias("children_sum"), (parent - total).alias("diff"), flag.alias("is_imbalance"))


def imbalance_values(sections: DataFrame, items: DataFrame) -> DataFrame:
    """The parent value of imbalanced sections; here a section without children is not flagged."""
    rows = sections.join(_sums(items), "section_id").filter((F.col("n_children") > 0) & _apart(F.col("parent_value"), F.col("children_sum")))
    return rows.select("section_id", F.col("parent_value").alias("marker_value"))


def format_anomalies(items: DataFrame, anchors: DataFrame, least_missing: int = LEAST_MISSING) -> DataFrame:
    """Sections (section_id, item) with their missing anchors in order; flagged from least_missing on."""
    wanted = anchors.select("ordinal", F.col("anchor").alias("item"))
    every = wanted.agg(F.array_sort(F.collect_list(F.struct("ordinal", "item"))).alias("every"))  # one row
    held = items.select("section_id", "item").distinct().join(small_side(wanted), "item", "left")
    held = held.groupBy("section_id").agg(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "item"))).alias("held"))
    rows = held.crossJoin(F.broadcast(every)).withColumn("m", F.array_except("every", "held")).filter(F.size("m") > 0)
    return rows.select("section_id", F.array_join(F.transform("m", lambda x: x["item"]), ",").alias("missing_anchors"), F.size("m").alias("n_missing"), (F.size("m") >= least_missing).alias("is_anomaly"))


def header_abnormal(headers: DataFrame) -> DataFrame:
    """Tables whose headers hold fewer than two of the expected words."""
    hits = F.size(F.filter(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.contains(F.col("header"), w)))
    return headers.groupBy("table_id").agg(F.sum(hits).alias("hits")).withColumn("header_abnormal", F.col("hits") < 2)


def flag_rollup(flags: DataFrame) -> DataFrame:
    """Each section's distinct flags in the order they were first seen."""
    first = flags.groupBy("section_id", "flag").agg(F.min("seq").alias("seq"))
    rows = first.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("seq", "flag"))).alias("f"))
    return rows.select("section_id", F.array_join(F.transform("f", lambda x: x["flag"]), ",").alias("flags"), F.size("f").alias("n_flags"))


def section_children(accounts: DataFrame) -> DataFrame:
    """Children of each subtotal (is_parent) of an ordered chart: the rows since the parent before it."""
    upwards = Window.partitionBy("chart").orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parent = F.last(F.when(F.col("is_parent"), F.struct("item_code")), ignorenulls=True).over(upwards)["item_code"]
    rows = accounts.withColumn("parent_code", parent).filter(~F.col("is_parent") & F.col("parent_code").isNotNull())
    return rows.select("chart", "parent_code", F.col("item_code").alias("child_code"), "ordinal")


def _known_merged(key: Column) -> Column:
    return reduce(or_, (F.contains(key, F.lit(p)) | F.contains(F.lit(p), key) for p, _ in MERGED))


def merged_line(label: Column, n_codes: Column) -> Column:
    """Whether a label is a known merged line (either holds the other) or joins names and matches several codes."""
    return _known_merged(F.regexp_replace(label, BLANK, "")) | (label.rlike(CONNECTORS) & (n_codes > 1))


def marker_flag(label: Column) -> Column:
    """struct(section, flag) of a marker text, null for other labels; the generic branch never yields noncurrent."""
    key = F.regexp_replace(label, BLANK, "")
    out = None
    for text, section, flag in MARKERS:
        pair = F.struct(F.lit(section).alias("section"), F.lit(flag).alias("flag"))
        hit = F.contains(key, F.lit(text))
        out = F.when(hit, pair) if out is None else out.when(hit, pair)
    generic = key.startswith("特殊") & F.contains(key, F.lit("流动资产"))
    for word, flag in (("不平", "IMBALANCE"), ("格式", "FORMAT"), ("归并", "AGGREGATION")):
        out = out.when(generic & F.contains(key, F.lit(word)), F.struct(F.lit("current_assets").alias("section"), F.lit(flag).alias("flag")))
    return out


def is_marker_row(label: Column, cells: Column) -> Column:
    """Whether a label is exactly a marker and the cells hold no number."""
    key = F.regexp_replace(label, BLANK, "")
    return key.isin([m for m, *_ in MARKERS]) & ~F.exists(cells, lambda c: F.coalesce(c.rlike(r"[\d.]"), F.lit(False)))


def marker_rows(rows: DataFrame) -> DataFrame:
    """Rows whose label is exactly a marker and whose cells hold no number."""
    return rows.filter(is_marker_row(F.col("label"), F.col("cells")))


def cash_flow_consistent(cfo: Column, cfi: Column, cff: Column, fx: Column, change: Column) -> Column:
    """Whether the parts add up to the change in cash within one per cent; missing parts fail."""
    return F.coalesce(F.abs(cfo + cfi + cff + F.coalesce(fx, F.lit(0.0)) - change) < F.abs(change) * 0.01, F.lit(False))


def anomaly_documents(sections: DataFrame, items: DataFrame, anchors: DataFrame) -> DataFrame:
    """One nested row per document: sections with their items, and the report on them.

    sections: section_id, doc_id, section, parent_item, parent_value; items: section_id, seq, item_raw, n_codes (of how many
    accounts the label tells), cells, value. A section's flags come in the order IMBALANCE (children against parent), FORMAT
    (missing anchors), AGGREGATION (a merged line), then those of marker rows by seq; a marker's row is no child. report has
    the flagged sections, the differences, merged lines with their codes, and the missing anchors. Sections without items have
    none; items of unknown sections are left out. Items are gathered by section once, and everything else is told from there. A document's sections and items come together in one row, so they are
    bounded by what one report can hold.
    """
    wanted = anchors.agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("anchor").alias("item")))).alias("wanted"))  # one row
    rows = items.withColumn("label", F.regexp_replace("item_raw", BLANK, "")).select(
        "section_id", "seq", "item_raw", "value", "label", F.coalesce(is_marker_row(F.col("item_raw"), F.col("cells")), F.lit(False)).alias("is_marker"),
        F.coalesce(_known_merged(F.col("label")) | (F.col("item_raw").rlike(CONNECTORS) & (F.col("n_codes") > 1)), F.lit(False)).alias("is_merged"),
    )
    codes = F.array().cast("array<string>")
    for text, own_codes in reversed(MERGED):
        codes = F.when(F.contains("label", F.lit(text)) | F.contains(F.lit(text), F.col("label")), F.array(*map(F.lit, own_codes))).otherwise(codes)
    rows = rows.withColumns({"codes": F.when(F.col("is_merged"), codes), "flag": F.when(F.col("is_marker"), marker_flag(F.col("item_raw"))["flag"])})
    own = F.when(~F.col("is_marker"), F.col("value"))
    fields = ("seq", "item_raw", "value", "is_marker", "is_merged")
    held = rows.groupBy("section_id").agg(
        (F.sum(F.round(own * 1e6).cast("decimal(30,0)")).cast("double") / 1e6).alias("total"), F.count(own).alias("n_values"),
        F.array_sort(F.collect_list(F.struct(*fields, "label", "codes", "flag"))).alias("held"),
    )
    every = sections.join(held, "section_id", "left").crossJoin(F.broadcast(wanted))
    parent, has = F.col("parent_value"), F.col("n_values") > 0
    pick = lambda names: lambda x: F.struct(*(x[n].alias(n) for n in names))
    every = every.withColumns({
        "is_imbalance": F.when(parent.isNull(), False).when(has, _apart(parent, F.col("total"))).otherwise(True), "children_sum": F.when(parent.isNotNull() & has, F.col("total")),
        "items": F.transform("held", pick(fields)), "labels": F.transform(F.filter("held", lambda x: ~x["is_marker"]), lambda x: x["label"]),
        "merged": F.transform(F.filter("held", lambda x: x["is_merged"] & ~x["is_marker"]), pick(("seq", "item_raw", "codes"))), "marks": F.transform(F.filter("held", lambda x: x["is_marker"]), lambda x: x["flag"]),
    }).drop("held")
    missing = F.array_distinct(F.filter("wanted", lambda a: ~F.coalesce(F.array_contains("labels", a["item"]), F.lit(False))))
    every = every.withColumn("missing", F.when(F.size("labels") > 0, missing))
    few = F.size("missing") >= LEAST_MISSING
    first = F.array_compact(F.array(F.when(F.col("is_imbalance"), "IMBALANCE"), F.when(few, "FORMAT"), F.when(F.size("merged") > 0, "AGGREGATION")))
    nothing = lambda c: F.coalesce(F.col(c), F.array().cast(dict(every.dtypes)[c]))
    section = F.struct(
        "section_id", "section", "parent_item", "parent_value", "children_sum", (parent - F.col("children_sum")).alias("diff"), F.array_distinct(F.concat(first, nothing("marks"))).alias("flags"),
        nothing("items").alias("items"), nothing("merged").alias("merged"), F.when(few, F.transform("missing", lambda x: x["item"])).alias("missing_anchors"),
    )
    documents = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    s = F.col("sections")
    report = F.struct(
        F.transform(F.filter(s, lambda x: F.size(x["flags"]) > 0), lambda x: F.struct(x["section_id"], x["flags"])).alias("sections_flagged"),
        F.transform(F.filter(s, lambda x: x["diff"].isNotNull()), lambda x: F.struct(x["section_id"], x["diff"])).alias("imbalance_diffs"),
        F.flatten(F.transform(s, lambda x: x["merged"])).alias("merged_candidates"),
        F.transform(F.filter(s, lambda x: x["missing_anchors"].isNotNull()), lambda x: F.struct(x["section_id"], x["missing_anchors"])).alias("missing_anchors"),
    )
    return documents.select("doc_id", "sections", report.alias("report"))
