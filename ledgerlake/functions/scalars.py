"""Column expressions of the filing operators: numbers, dates, labels, symbols, ratios and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it; Java's own class is ASCII only.
BLANK = r"[\s  -     　]"
_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def to_double(x: Column) -> Column:
    """The number a plain numeric text holds, else null; Spark's suffixes as in 1d are no numbers."""
    text = F.trim(x)
    return F.when(text.rlike(_PLAIN), text.try_cast("double"))


def parse_number_us(x: Column) -> Column:
    """Commas dropped, cast; decimals never scale."""
    return to_double(F.replace(x, F.lit(","), F.lit("")))


def parse_number_jp(x: Column) -> Column:
    """Dashes are null; triangles and wide minus signs are negative."""
    text = F.regexp_replace(F.trim(x), "[,\\s円]", "")
    return F.when(~text.rlike("^[-―—－ー]*$"), to_double(F.translate(text, "△▲−－", "----")))


def clean_item_name(x: Column) -> Column:
    """A line label without its leading numeral, sign words, white space and colons. White space goes last: it keeps what
    stands behind it from being read as a prefix."""
    text = F.regexp_replace(F.coalesce(x, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")
    text = F.regexp_replace(text, r"^[一二三四五六七八九十]+[、．.]", "")
    text = F.regexp_replace(text, r"^[（(]?[一二三四五六七八九十0-9]+[)）]?", "")
    text = F.regexp_replace(text, r"^(加|减|其中)[：:]", "")
    return F.regexp_replace(F.regexp_replace(text, BLANK, ""), "[：:]", "")


_MONEY = r"\(?-?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{4,}(?:\.\d+)?)\)?"
_DECIMAL = r"\(?-?\d+\.\d+\)?"


def parse_number_cn(x: Column) -> Column:
    """First money token (comma groups or four digits), else first decimal, else a plain number; brackets are negative."""
    text = F.trim(F.translate(x, "（），−", "(),-"))

    def value(token: Column) -> Column:
        number = to_double(F.regexp_replace(token, r"[(),]", ""))
        return F.when(token.startswith("(") & token.endswith(")"), -F.abs(number)).otherwise(number)

    token = F.coalesce(F.nullif(F.regexp_extract(text, _MONEY, 0), F.lit("")), F.nullif(F.regexp_extract(text, _DECIMAL, 0), F.lit("")))
    return F.when(~text.rlike("^[-—–―]*$"), F.coalesce(value(token), value(text)))


def parse_iso_date(x: Column) -> Column:
    """The first date of the text written with dashes, else with slashes, else with year, month and day signs."""

    def found(pattern: str) -> Column:
        part = lambda i: F.regexp_extract(x, pattern, i)
        return F.when(x.rlike(pattern), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))

    return F.coalesce(found(r"(\d{4})-(\d{2})-(\d{2})"), found(r"(\d{4})/(\d{1,2})/(\d{1,2})"), found(r"(\d{4})年(\d{1,2})月(\d{1,2})日"))


def fiscal_year_from_title(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(20\d{2})\s*年\s*年?度报告", 1), F.lit("")).cast("int")


def normalize_symbol(market: Column, symbol: Column) -> Column:
    """CN digits padded to six, JP digits to four (longer ones stay), US upper case; without digits unchanged."""
    text, digits = F.trim(symbol), F.regexp_replace(symbol, r"\D", "")
    padded = lambda n: F.when(digits == "", text).when(F.length(digits) < n, F.lpad(digits, n, "0")).otherwise(digits)
    return F.when(market == "cn", padded(6)).when(market == "jp", padded(4)).otherwise(F.upper(text))


def normalize_sec_code(x: Column) -> Column:
    return F.nullif(F.left(F.regexp_replace(x, r"\D", ""), F.lit(4)), F.lit(""))


def normalize_label(x: Column) -> Column:
    """camelCase split, lower case, anything else than letters and digits one blank."""
    text = F.regexp_replace(F.coalesce(x, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def parse_match(x: Column) -> Column:
    """A reviewer's free text as 1, 0 or null."""
    text = F.lower(F.trim(x))
    return F.when(text.isin("1", "y", "yes", "true", "t", "pass", "correct", "ok"), 1).when(text.isin("0", "n", "no", "false", "f", "fail", "wrong", "ng"), 0)


def parse_flag(x: Column) -> Column:
    """A review flag as 0 or 1: words, else any number whose whole part is not zero; the rest is 0."""
    text = F.lower(F.trim(x))
    return F.when(text.isin("y", "yes", "true", "t", "on"), 1).when(F.abs(F.coalesce(to_double(text), F.lit(0.0))) >= 1, 1).otherwise(0)


def close(a: Column, b: Column) -> Column:
    """Both given and equal up to 1e-9, or to 1e-6 of the larger (at least 1)."""
    gap = F.abs(a - b)
    return F.coalesce((gap <= 1e-9) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= 1e-6), F.lit(False))


def same_or_both_null(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | close(a, b)


def confidence(base: Column, by_format: Column, aggregated: Column, imbalanced: Column, embedded: Column) -> Column:
    factor = lambda flag, x: F.when(flag, F.lit(x)).otherwise(1.0)
    product = base * factor(by_format, 0.7) * factor(aggregated, 0.8) * factor(imbalanced, 0.6) * factor(embedded, 0.85)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)), 4)


def location_confidence(has_title: Column, table_pages: Column) -> Column:
    return F.bround(F.when(has_title, 0.6).otherwise(0.0) + F.least(F.lit(0.4), table_pages * 0.1), 3)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def short_currency(x: Column, symbol: str) -> Column:
    """T, B or M with two decimals, the sign behind the symbol; N/A for null."""
    size = F.abs(x)
    text = lambda unit, mark: F.concat(F.lit(symbol), F.replace(F.format_number(x / unit, 2), F.lit(","), F.lit("")), F.lit(mark))
    return (
        F.when(x.isNull(), "N/A").when(size >= 1e12, text(1e12, "T")).when(size >= 1e9, text(1e9, "B")).when(size >= 1e6, text(1e6, "M"))
        .otherwise(F.concat(F.lit(symbol), F.format_number(x, 2)))
    )


def raw_currency(x: Column, symbol: str) -> Column:
    """Whole units with thousands separators, half to even; N/A for null."""
    return F.coalesce(F.concat(F.lit(symbol), F.format_number(F.bround(x, 0), 0)), F.lit("N/A"))


def plain_number(x: Column) -> Column:
    """From 1000 on whole with separators, else up to four decimals without closing zeros; N/A for null."""
    small = F.regexp_replace(F.format_number(x, 4), r"\.?0+$", "")
    return F.when(x.isNull(), "N/A").when(F.abs(x) >= 1000, F.format_number(F.bround(x, 0), 0)).otherwise(small)


def millions(x: Column, symbol: str = "$") -> Column:
    """M, from 1000 of them B, with two decimals; N/A for null."""
    text = lambda v, mark: F.concat(F.lit(symbol), F.replace(F.format_number(v, 2), F.lit(","), F.lit("")), F.lit(mark))
    return F.when(x.isNull(), "N/A").when(F.abs(x) >= 1e9, text(x / 1e9, "B")).otherwise(text(x / 1e6, "M"))


def coerce_date(x: Column) -> Column:
    """A timestamp or date in text as an ISO date; null where it is none."""
    return F.date_format(x.try_cast("timestamp"), "yyyy-MM-dd")


def token_usage(response: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, total_tokens) of a response in JSON, whichever of two shapes its usage has; the
    total is the sum where it isn't given."""
    at = lambda *paths: F.coalesce(*(F.get_json_object(response, f"$.usage.{p}").try_cast("long") for p in paths))
    prompt, completion = at("prompt_tokens", "input_tokens"), at("completion_tokens", "output_tokens")
    total = F.coalesce(at("total_tokens"), F.when(F.coalesce(prompt, completion).isNotNull(), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))))
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens"))


#: Where responses of several providers keep their usage, and what they call its parts.
USAGE_ROOTS = ("$.usage", "$.response.usage", "$.body.usage", "$")
PROMPT_NAMES, COMPLETION_NAMES, TOTAL_NAMES = ("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens"), ("total_tokens",)


def open_token_usage(response: Column, roots: tuple[str, ...] = USAGE_ROOTS) -> Column:
    """token_usage of a response of any shape, parsed once as a VARIANT: the first root that has a part counts, numbers may be
    texts, what is no number or no JSON is null."""

    def at(names: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.try_variant_get(F.try_parse_json(response), f"{r}.{n}", "long") for r in roots for n in names))

    prompt, completion = at(PROMPT_NAMES), at(COMPLETION_NAMES)
    total = F.coalesce(at(TOTAL_NAMES), F.when(F.coalesce(prompt, completion).isNotNull(), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))))
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens"))


def sum_given(*parts: Column) -> Column:
    """The sum of what is given; null if nothing is."""
    total = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def coerce_number(x: Column) -> Column:
    number = x.try_cast("double")
    return F.when(~F.isnan(number), number)


def token_cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    return prompt / 1e6 * price_in + completion / 1e6 * price_out


def latest_header_date(x: Column) -> Column:
    """The latest full date of a header text, else the last day of its latest year (20xx)."""
    whole = F.regexp_extract_all(x, F.lit(r"20\d{2}\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2}"), F.lit(0))
    part = lambda t, i: F.regexp_extract(t, r"(20\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})", i)
    days = F.transform(whole, lambda t: F.try_to_date(F.concat_ws("-", part(t, 1), F.lpad(part(t, 2), 2, "0"), F.lpad(part(t, 3), 2, "0")), "yyyy-MM-dd"))
    years = F.transform(F.regexp_extract_all(x, F.lit(r"(20\d{2})(?=\s*年|\b)"), F.lit(1)), lambda t: t.cast("int"))
    return F.coalesce(F.array_max(days), F.make_date(F.array_max(years), F.lit(12), F.lit(31)))
