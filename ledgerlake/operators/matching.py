"""Labels to the names of a chart: exact, by part, and by the best ratio, through inverted indexes instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_item_name
from ..sources.shared import small_side, written

#: Shortest label of the substring tier, least ratio of the fuzzy tier.
LEAST_PART, LEAST_RATIO = 3, 75.0
#: A first guess looks at so many names of each pair of letters, and compares so many names of a label.
GUESS_NAMES, GUESSES = 16, 3


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def common_letters(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of its table folded over the letters of a."""
    ys = _letters(b)
    zero = F.transform(ys, lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            diagonal = F.when(i == 0, F.lit(0)).otherwise(F.get(before, i - 1))
            left = F.coalesce(F.get(acc, i - 1), F.lit(0))
            return F.concat(acc, F.array(F.when(F.get(ys, i) == x, diagonal + 1).otherwise(F.greatest(F.get(before, i), left))))

        return F.aggregate(F.transform(ys, lambda _, i: i), F.array().cast("array<int>"), cell)

    last = F.aggregate(_letters(a), zero, row)
    return F.coalesce(F.array_max(last), F.lit(0))


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (both lengths)."""
    return F.try_divide(F.lit(200.0) * common_letters(a, b), F.length(a) + F.length(b))


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n letters of a text of so many at least."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def _numbered(text: Column) -> Column:
    """Letters with how often each stood before: two texts share as many of these as they share letters, repeats counted."""
    of = _letters(text)
    return F.transform(of, lambda c, i: F.concat(c, F.size(F.filter(F.slice(of, F.lit(1), i), lambda x: x == c)).cast("string")))


def _guesses(labels: DataFrame, names: DataFrame) -> DataFrame:
    """label with common and total, letters shared and of both, of the best of a few names that share pairs of letters with it."""
    few = Window.partitionBy("gram").orderBy("name")
    index = names.select("name", F.explode(grams(F.col("name"), 2)).alias("gram")).withColumn("k", F.row_number().over(few)).filter(F.col("k") <= GUESS_NAMES)
    shared = labels.select("label", F.explode(grams(F.col("label"), 2)).alias("gram")).join(small_side(index.drop("k")), "gram").groupBy("label", "name").agg(F.count("*").alias("shared"))
    near = Window.partitionBy("label").orderBy((F.col("shared") / (F.length("label") + F.length("name"))).desc(), "name")
    some = shared.withColumn("k", F.row_number().over(near)).filter(F.col("k") <= GUESSES)
    some = some.select("label", common_letters(F.col("label"), F.col("name")).alias("common"), (F.length("label") + F.length("name")).alias("total"))
    return some.groupBy("label").agg(F.max_by(F.struct("common", "total"), F.col("common") / F.col("total")).alias("g")).select("label", "g.common", "g.total")


def candidates(labels: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs (label, name) whose letters alone leave room for the label's best ratio; both sides hold distinct texts.

    A first guess gives each label a ratio that its best name reaches or exceeds, so that pair needs a number of letters in
    common that their lengths tell. Texts that share so many share one of their rarest letters, within as many as may be
    missing: only those letters are indexed, rarest first, each with its number among its like. What a shared letter's places
    leave, and then all shared letters, must still suffice. Labels without a letter in common with any name have no pair.
    """
    guess = written(labels.join(_guesses(labels, names), "label", "left").select("label", F.coalesce("common", F.lit(0)).alias("common"), F.coalesce("total", F.lit(1)).alias("total")))
    of_names = written(names.select("name", F.explode(_numbered(F.col("name"))).alias("letter")))
    often = of_names.groupBy("letter").agg(F.count("*").alias("often"))
    rare = lambda key: Window.partitionBy(key).orderBy("often", "letter")
    index = of_names.join(small_side(often), "letter").withColumn("at", F.row_number().over(rare("name")) - 1).select("name", "letter", "at", F.length("name").alias("size"))
    asked = guess.select("*", F.explode(_numbered(F.col("label"))).alias("letter")).join(small_side(often), "letter")
    asked = asked.withColumns({"place": F.row_number().over(rare("label")) - 1, "known": F.count("*").over(Window.partitionBy("label"))})
    need = F.greatest(F.lit(1), F.ceil((F.col("common") * (F.length("label") + F.col("size"))) / F.col("total") - 1e-9))
    left = F.least(F.col("known") - F.col("place"), F.col("size") - F.col("at"))
    met = asked.join(small_side(index), "letter").withColumn("need", need).filter((left >= F.col("need")) & (F.col("place") <= F.col("known") - F.col("need")) & (F.col("at") <= F.col("size") - F.col("need")))
    pairs = met.select("label", "name", "need").distinct()
    return pairs.filter(F.size(F.array_intersect(_numbered(F.col("label")), _numbered(F.col("name")))) >= F.col("need")).select("label", "name")


def best_names(labels: DataFrame, chart: DataFrame) -> DataFrame:
    """label, item_code, name and ratio: the name of the highest ratio for each distinct label; equal ones by ordinal, then code.

    labels: label; chart: name, ordinal, item_code. A label without a letter of any name gets the chart's first name, with
    ratio 0 (null where both are empty); an empty chart gives no row. Labels and names may be null: those match nothing.
    """
    distinct = written(labels.select("label").filter("label is not null").distinct())
    chart = written(chart.select("name", "ordinal", "item_code").filter("name is not null"))
    pairs = candidates(distinct, chart.select("name").distinct()).withColumn("ratio", indel_ratio(F.col("label"), F.col("name")))
    scored = written(pairs).join(small_side(chart), "name")
    least = F.min(F.struct((-F.col("ratio")).alias("n"), "ordinal", "item_code", "name")).alias("b")
    found = written(scored.groupBy("label").agg(least).select("label", "b.item_code", "b.name", (-F.col("b.n")).alias("ratio")))
    first = chart.agg(F.min(F.struct("ordinal", "item_code", "name")).alias("b")).filter("b is not null")  # one row
    rest = distinct.join(found.select("label"), "label", "left_anti").join(F.broadcast(first), F.lit(True))
    return found.unionByName(rest.select("label", "b.item_code", "b.name", indel_ratio(F.col("label"), F.col("b.name")).alias("ratio")))


def parts(labels: DataFrame, chart: DataFrame) -> DataFrame:
    """label, item_code and name: the chart's first name that holds the label or is part of it, both of LEAST_PART letters.

    The shorter text's first letters are among the longer one's runs of letters: an index of runs finds the pairs.
    """
    runs, first = lambda c: F.explode(grams(F.col(c), LEAST_PART)).alias("gram"), lambda c: F.substring(F.col(c), 1, LEAST_PART)
    labels, chart = labels.filter(F.length("label") >= LEAST_PART), small_side(chart.filter(F.length("name") >= LEAST_PART))
    inside = labels.select("label", runs("label")).join(chart.withColumn("gram", first("name")), "gram").filter(F.contains("label", F.col("name")))
    outside = labels.withColumn("gram", first("label")).join(chart.select("*", runs("name")), "gram").filter(F.contains("name", F.col("label")))
    both = inside.unionByName(outside)
    return both.groupBy("label").agg(F.min(F.struct("ordinal", "item_code", "name")).alias("b")).select("label", "b.item_code", "b.name")


def match_items(labels: DataFrame, accounts: DataFrame) -> DataFrame:
    """raw_item to account: exact on clean names (1.0), substring either way in chart order (0.95), best ratio (score/100).

    Works on distinct clean labels; each tier sees what the one before left. The chart is a dictionary and broadcast where
    its counted size allows. Of accounts with one clean name the last code counts. Below LEAST_RATIO no code, but name and score.
    """
    names = written(labels.select("raw_item").distinct().withColumn("label", clean_item_name(F.col("raw_item"))))
    chart = accounts.withColumn("name", clean_item_name(F.col("item_name_std")))
    chart = written(chart.groupBy("name").agg(F.max_by("item_code", "ordinal").alias("item_code"), F.min("ordinal").alias("ordinal")))
    clean = written(names.select("label").filter("label is not null").distinct())
    exact = written(clean.join(small_side(chart), F.col("label") == F.col("name")).select("label", "item_code", "name", F.lit(1.0).alias("score")))
    rest = written(clean.join(exact.select("label"), "label", "left_anti"))
    part = written(parts(rest, chart).withColumn("score", F.lit(0.95)))
    fuzzy = best_names(rest.join(part.select("label"), "label", "left_anti"), chart)
    fuzzy = fuzzy.select("label", F.when(F.col("ratio") >= LEAST_RATIO, F.col("item_code")).alias("item_code"), "name", (F.col("ratio") / 100).alias("score"))
    return names.join(exact.unionByName(part).unionByName(fuzzy), "label", "left").select("raw_item", "item_code", F.col("name").alias("matched_name"), "score")
