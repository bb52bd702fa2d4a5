"""Statement lines of page text: amounts and per-share figures, label matching, and how a new value meets an old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BLANK, to_double
from ..sources.shared import small_side
from .matching import grams

#: Tokens of amounts, plain integers and decimals; words for not applicable.
AMOUNT = r"\(?-?\d{1,6}(?:,\d{3}){1,4}\)?"
PLAIN = r"\(?-?\d{4,}\)?"
DECIMAL = r"\(?-?\d+[.,，．]\d{1,4}\)?"
MOST_PER_SHARE = 200.0
UNITS = [("百万元", "人民币百万元"), ("亿元", "人民币亿元"), ("万元", "人民币万元"), ("千元", "人民币千元"), ("元", "人民币元")]


def _signed(token: Column, digits: Column) -> Column:
    number = to_double(digits)
    return F.when(token.startswith("(") & token.endswith(")") & (number > 0), -number).otherwise(number)


def _readings(token: Column) -> Column:
    """The values an amount token may stand for: as it is, or with one or two digits of a note number stuck to its head."""
    bare = F.regexp_replace(token, "[()]", "")
    head, tail = F.substring_index(bare, ",", 1), F.replace(F.substring(bare, F.instr(bare, ",") + 1, F.length(bare)), F.lit(","), F.lit(""))
    heads = F.when(F.length(head) >= 3, F.array(head, F.substring(head, 3, 9), F.substring(head, 2, 9))).otherwise(F.array(head))
    fits = F.filter(heads, lambda h: (h == head) | F.length(h).between(1, 3))
    return F.when(head.rlike(r"^\d+$"), F.transform(fits, lambda h: _signed(token, F.concat(h, tail)))).otherwise(F.array().cast("array<double>"))


def _largest(values: Column) -> Column:
    return F.array_min(F.transform(values, lambda v, i: F.struct((-F.abs(v)).alias("n"), i.alias("i"), v.alias("v"))))["v"]


def parse_amount(line: Column) -> Column:
    """The line's first amount: of its readings the one nearest in magnitude to the second amount, else the largest; without
    comma groups the first integer of four digits or more."""
    tokens = F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(0))
    first, second = _readings(F.get(tokens, F.lit(0))), F.coalesce(_readings(F.get(tokens, F.lit(1))), F.array().cast("array<double>"))
    ref = F.abs(_largest(second))
    gap = lambda v: F.abs(F.log10((F.abs(v) + 1) / (ref + 1)))
    near = F.array_min(F.transform(first, lambda v, i: F.struct(gap(v).alias("n"), i.alias("i"), v.alias("v"))))["v"]
    plain = F.regexp_extract(line, PLAIN, 0)
    return F.coalesce(F.when(ref > 0, near).otherwise(_largest(first)), _signed(plain, F.regexp_replace(plain, "[()]", "")))


def parse_per_share(text: Column, cuts: tuple[int, ...] = (2, 1, 3)) -> Column:
    """The first decimal of at most MOST_PER_SHARE; of larger ones, digits stuck to the front are cut off."""
    tokens = F.regexp_extract_all(F.regexp_replace(text, BLANK, ""), F.lit(DECIMAL), F.lit(0))

    def options(token: Column) -> Column:
        bare = F.translate(F.regexp_replace(token, "[()]", ""), "，．,", "...")
        left, right = F.substring_index(bare, ".", 1), F.substring_index(bare, ".", -1)
        cut = lambda n: F.when((F.length(left) >= 3) & (F.length(left) > n), _signed(token, F.concat(F.substring(left, n + 1, 99), F.lit("."), right)))
        return F.array(_signed(token, bare), *(cut(n) for n in cuts))

    return F.get(F.filter(F.flatten(F.transform(tokens, options)), lambda v: F.abs(v) <= MOST_PER_SHARE), F.lit(0))


def is_not_applicable(text: Column) -> Column:
    t = F.upper(F.regexp_replace(text, BLANK, ""))
    return F.coalesce(t.rlike(r"不适用|不存在|(?<![A-Z])N/?A(?![A-Z])|--|—") | (t == "无"), F.lit(False))


def na_before_number(text: Column) -> Column:
    """Whether a word for not applicable comes before the line's first decimal, or there is no decimal."""
    t = F.upper(F.regexp_replace(text, BLANK, ""))
    head = F.regexp_extract(t, r"^(.*?)(\d+[.,，．]\d{1,4}|$)", 1)
    return F.coalesce(head.rlike("不适用|不存在|N/A|NA|—|--"), F.lit(False))


def reported_unit(line: Column) -> Column:
    """The canonical unit of a unit line, null for other lines."""
    t = F.regexp_replace(line, BLANK, "")
    unit = F.regexp_extract(t, "单位[:：]?(?:人民币)?(百万元|亿元|万元|千元|元)", 1)
    out = None
    for name, canonical in UNITS:
        out = F.when(unit == name, canonical) if out is None else out.when(unit == name, canonical)
    return out


DEFAULT_UNIT, FIRST_PAGES = "人民币元", 30


def document_units(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each document's unit: that of the first unit line on a statement's start page or the page after (lines: doc_id, page_no,
    line_no, line; ranges: doc_id, start_page), on the first pages where no statement was found, else the default."""
    starts = ranges.filter("start_page is not null").select("doc_id", F.explode(F.array(F.col("start_page"), F.col("start_page") + 1)).alias("page_no"), F.lit(True).alias("near")).distinct()
    found = ranges.filter("start_page is not null").select("doc_id", F.lit(True).alias("found")).distinct()
    rows = lines.join(starts, ["doc_id", "page_no"], "left").join(found, "doc_id", "left")
    searched = F.when(F.col("found"), F.coalesce("near", F.lit(False))).otherwise(F.col("page_no") <= FIRST_PAGES)
    unit = F.when(searched, reported_unit(F.col("line")))
    first = F.min(F.when(unit.isNotNull(), F.struct("page_no", "line_no", unit.alias("unit"))))["unit"]
    return rows.groupBy("doc_id").agg(F.coalesce(first, F.lit(DEFAULT_UNIT)).alias("unit"))


#: Labels are found by their first letters, so many at most.
LEAD = 3
#: Patterns of cash-flow lines, with what every match of each holds, and their item codes.
CASH_FLOW_LINES = [
    (r"经营活动(?:产生|使用)的现金流量净额", "的现金流量净额", "MANANETR"), (r"投资活动(?:产生|使用)(?:/\(使用\))?的现金流量净额", "的现金流量净额", "INVNETCASHFLOW"),
    (r"筹资活动(?:产生|使用)(?:/\(使用\))?的现金流量净额", "的现金流量净额", "FINNETCFLOW"), (r"汇率变动对现金及现金等价物的影响", "汇率变动对现金", "CHGEXCHGCHGS"),
    (r"现金及现金等价物净.*增加额", "现金及现金等价物净", "CASHNETR"), (r"(?:年初|期初)现金及现金等价物余额", "现金及现金等价物余额", "INICASHBALA"),
    (r"(?:年末|期末)现金及现金等价物余额", "现金及现金等价物余额", "FINALCASHBALA"),
]


def _holding(lines: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Lines (bare) with each name whose text in `column` they hold, once.

    One pass over a line yields its runs of letters, which are looked up among the names' first letters; what is found is
    compared in full. A line costs its length and what begins like a name in it, however many names there are.
    """
    names = names.withColumn("lead", F.substring(F.col(column), 1, LEAD))
    sizes = [r["n"] for r in names.select(F.length("lead").alias("n")).distinct().filter("n > 0").collect()]  # LEAD numbers at most
    runs = [F.coalesce(grams(F.col("bare"), n), F.array().cast("array<string>")) for n in sizes]
    every = F.concat(*runs) if runs else F.array().cast("array<string>")
    return lines.withColumn("lead", F.explode(every)).join(small_side(names), "lead").filter(F.contains("bare", F.col(column))).drop("lead")


def label_hits(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Lines with every label (label, code, kind) they hold, white space apart; longer labels come first. labels is a dictionary;
    empty and null ones are held by no line."""
    names = labels.withColumn("label_order", F.row_number().over(Window.orderBy(F.length("label").desc(), "label")))
    return _holding(lines.withColumn("bare", F.regexp_replace("line", BLANK, "")), names, "label")


def pattern_hits(lines: DataFrame, patterns=CASH_FLOW_LINES) -> DataFrame:
    """Lines with every pattern they match, white space apart, as label_hits of kind first: what all matches of a pattern hold
    is looked up, and only then the pattern tried. patterns: (pattern, held, code)."""
    kind = "label string, held string, code string, kind string, label_order int"
    names = lines.sparkSession.createDataFrame([(*p, "first", i) for i, p in enumerate(patterns)], kind)
    return _holding(lines.withColumn("bare", F.regexp_replace("line", BLANK, "")), names, "held").filter("bare RLIKE label").drop("held")


def line_values(hits: DataFrame) -> DataFrame:
    """One value per document and code by the kind of its code: first (first value wins), last (last one wins), per_share (last
    one wins until a not-applicable line, which ends the search and, without a value, is the status)."""
    per_share = F.col("kind") == "per_share"
    value = F.when(per_share, F.when(~na_before_number(F.col("bare")), parse_per_share(F.col("bare"), (2, 1)))).otherwise(parse_amount(F.col("bare")))
    rows = hits.withColumn("value", value).withColumn("na", per_share & F.col("value").isNull() & is_not_applicable(F.col("bare")))
    place = F.struct("line_no", "label_order")
    rows = rows.withColumn("place", place).withColumn("latch", F.min(F.when(F.col("na"), place)).over(Window.partitionBy("doc_id", "code")))
    rows = rows.filter(F.col("latch").isNull() | (F.col("place") <= F.col("latch")))
    given = F.col("value").isNotNull()
    return rows.groupBy("doc_id", "code", "kind").agg(
        F.when(F.col("kind") == "first", F.min_by("value", F.when(given, F.col("place")))).otherwise(F.max_by("value", F.when(given, F.col("place")))).alias("value"),
        F.when(F.bool_or("na"), "NOT_APPLICABLE").when(F.bool_or(given), "OK").alias("status"),
    ).filter("value is not null or status is not null")


def merge_values(table_values: DataFrame, found: DataFrame) -> DataFrame:
    """Table values with those of lines: first only fills gaps, last and per_share override."""
    joined = table_values.withColumnRenamed("value", "old").join(found.withColumnRenamed("value", "new"), ["doc_id", "code"], "full_outer")
    value = F.when(F.col("kind") == "first", F.coalesce("old", "new")).otherwise(F.coalesce("new", "old"))
    return joined.select("doc_id", "code", value.alias("value"), "status")


#: Labels of grand totals in order of trust, and what excludes a line.
TOTAL_LABELS = ("资产总计", "资产总额", "总资产")
LAST_LABEL = "资产合计"
SUBTOTALS = "流动资产合计|流动资产总计|非流动资产合计|非流动资产总计|其中"


def total_assets(lines: DataFrame, labels: tuple[str, ...] = TOTAL_LABELS, last_label: str = LAST_LABEL, excluded: str = SUBTOTALS) -> DataFrame:
    """Each document's grand total: the most trusted label, earliest; the last label only in the last 40 % of lines, latest."""
    t = F.regexp_replace("line", BLANK, "")
    rows = lines.withColumn("bare", t).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    priority = None
    for i, label in enumerate(labels):
        hit = F.contains("bare", F.lit(label))
        priority = F.when(hit, i + 1) if priority is None else priority.when(hit, i + 1)
    priority = priority.when(F.contains("bare", F.lit(last_label)) & (F.col("line_no") - 1 >= F.floor(F.col("n") * 0.6)), len(labels) + 1)
    rows = rows.filter(~F.col("bare").rlike(excluded)).withColumn("priority", priority).withColumn("value", parse_amount(F.col("bare"))).filter("priority is not null and value is not null")
    order = F.struct("priority", F.when(F.col("priority") > len(labels), -F.col("line_no")).otherwise(F.col("line_no")))
    return rows.groupBy("doc_id").agg(F.min_by("value", order).alias("total_assets"))


def total_liabilities(lines: DataFrame, label: str = "负债合计", before: str = "非流动负债合计", after: str = "股东权益|所有者权益", excluded: str = "第一层次|第二层次|第三层次|公允价值") -> DataFrame:
    """Each document's first liabilities total with the subtotal in the eight lines before it and equity in the eleven after."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    seen = lambda pattern, a, b: F.coalesce(F.max(F.col("bare").rlike(pattern)).over(by.rowsBetween(a, b)), F.lit(False))
    rows = lines.withColumn("bare", F.regexp_replace("line", BLANK, "")).withColumn("_b", seen(before, -8, -1)).withColumn("_a", seen(after, 1, 11))
    rows = rows.filter(F.contains("bare", F.lit(label)) & ~F.col("bare").rlike(excluded) & F.col("_b") & F.col("_a")).withColumn("value", parse_amount(F.col("bare")))
    return rows.filter("value is not null").groupBy("doc_id").agg(F.min_by("value", "line_no").alias("total_liabilities"))
