"""Mixing sources to target weights by Pareto order sampling.

A source's target of words gives each of its documents an expected number of copies. Its whole part is certain; for the
rest, documents are ranked by their random odds divided by their inclusion odds, and the lowest ranks are taken until the
source's words are used up (a sample of fixed size in words). Inclusion odds differ between documents: longer ones get a
somewhat larger share, set so that the expected words still equal the target and no document exceeds max_copies.

What is left of a source's target then is less than the next document. One more document, chosen by size and not by rank,
closes it as nearly as any can: the one departure from Pareto order, one document a source, which leaves the others' odds
as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, repeated, small_side, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
#: A document's tilt rises from 0 to TILT_UNIT with its size; TILT_HALF words give half.
TILT_UNIT, TILT_HALF, MOST_TILT = 1000, 500, 0.5
#: Ranks are counted in so many intervals of a source; the one where the words run out is cut again until at most
#: SORTED_ROWS rows are left to sort, or DEEPEST times (then its ranks are equal).
INTERVALS, SORTED_ROWS, DEEPEST = 64, 4096, 8
#: Sources up to this number are broadcast (one narrow row each); more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: What makes repeated rows one group: they share their luck, and are taken one by one.
GROUP = ("src", "doc_id", "luck", "size")


def _facts() -> list[Column]:
    """src (orders like source, null last), doc_id, luck (a hash that only doc_id and text decide) and size in words."""
    return [
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("src"), F.col("doc_id"),
        F.xxhash64(F.lit("mix"), F.col("doc_id"), F.lit(0), F.col("text")).alias("luck"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ]


def _tilt() -> Column:
    return F.floor(F.col("size") * TILT_UNIT / (F.col("size") + TILT_HALF)).cast("long")


def source_targets(groups: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source of groups (src, size, n rows each): src, source_size, target and the mean tilt of its words.

    Sources by code point, null last, take the weights in turn and split share x all words; a target stops at max_copies
    x the source's words, and the excess goes to the others by weight until none is above.
    """
    words = F.col("size") * F.col("n")
    sources = groups.groupBy("src").agg(F.sum(words).alias("source_size"), F.sum(words * _tilt()).alias("tilted"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_place"), F.lit(len(weights))) + 1).cast("int"))
    sources = written(numbered(sources, [], ("src",)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_copies))
    everything, level, before = share * (sources.agg(F.sum("source_size")).first()[0] or 0), 0.0, None
    while level != before:  # it only rises, and each round but the last brings a source to its cap
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        capped, free = sources.agg(F.sum(F.when(full & F.lit(before is not None), F.col("cap"))), F.sum(F.when(~full | F.lit(before is None), F.col("weight")))).first()
        before, level = level, max(level, (everything - (capped or 0)) / free) if free else float("inf")
    target = F.when(F.col("cap") <= F.col("weight") * F.lit(level), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("src", "source_size", target.alias("target"), (F.try_divide(F.col("tilted"), F.col("source_size")) / TILT_UNIT).alias("mean_tilt"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: a lambda's variable isn't copied into the generated code wherever it is named."""
    return F.transform(F.array(value), body)[0]


def _with_odds(rows: DataFrame, max_copies: int) -> DataFrame:
    """rows (GROUP and the source's plan) with certain copies and, where a further one is open, place: x rises with the rank."""

    def copies(rate: Column) -> Column:
        room = F.try_divide(F.lit(float(max_copies)) / rate - 1, 1 - F.col("mean_tilt"))
        spread = F.greatest(F.lit(0.0), F.least(F.lit(MOST_TILT), F.coalesce(room, F.lit(0.0))))
        most = F.least(F.lit(float(max_copies)), rate * (1 + spread * (_tilt() / TILT_UNIT - F.col("mean_tilt"))))
        return F.when((rate > 0) & (F.col("size") > 0), most).otherwise(0.0)

    def place(p: Column) -> Column:
        odds = _let((F.shiftrightunsigned("luck", 11) + F.lit(0.5)) / F.lit(float(1 << 53)), lambda u: u / (1 - u)) * ((1 - p) / p)
        return F.when(p > 0, F.struct(_let(odds, lambda r: r / (1 + r)).alias("x"), "doc_id", "luck", "size"))

    odds = _let(_let(F.try_divide(F.col("target"), F.col("source_size")), copies), lambda c: F.struct(F.floor(c).alias("certain"), _let(c - F.floor(c), place).alias("place")))
    return rows.withColumn("_odds", odds).withColumn("certain", F.col("_odds.certain")).withColumn("place", F.col("_odds.place")).drop("_odds")


def _plan(groups: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """targets with each source's cut: the place where its words run out, the rows of that group still taken (cut_rows),
    and the place of the document that closes the gap (fill). Without a cut all its further copies are taken."""
    rows = _with_odds(groups.join(small_side(targets, BROADCAST_SOURCES), "src"), max_copies)
    words = F.col("place.size") * F.col("n")
    ranked = written(rows.select("src", "place", "n", (F.col("certain") * F.col("size") * F.col("n")).alias("sure"), "target"))
    left = ranked.groupBy("src").agg((F.first("target") - F.sum("sure")).alias("left"))
    bounds, live = written(left.withColumn("low", F.lit(0.0)).withColumn("width", F.lit(1.0))), ranked.filter("place is not null").select("src", "place", "n")
    for _ in range(DEEPEST):
        part = F.least(F.lit(INTERVALS - 1), F.floor((F.col("place.x") - F.col("low")) / F.col("width") * INTERVALS)).cast("int")
        dealt = live.join(small_side(bounds, BROADCAST_SOURCES), "src").withColumn("part", part)
        sums = dealt.groupBy("src", "part").agg(F.sum(words).alias("words"), F.count("*").alias("rows"), F.first("left").alias("left"), F.first("low").alias("low"), F.first("width").alias("width"))
        sums = sums.withColumn("before", F.sum("words").over(Window.partitionBy("src").orderBy("part")) - F.col("words"))
        split = sums.filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        width = F.col("width") / INTERVALS
        split = written(split.select("src", F.col("part").alias("split"), "rows", (F.col("left") - F.col("before")).alias("left"), (F.col("low") + F.col("part") * width).alias("low"), width.alias("width")))
        live = written(dealt.join(small_side(split.select("src", "split"), BROADCAST_SOURCES), "src").filter("part = split").select("src", "place", "n"))
        bounds = split.drop("split", "rows")
        if split.filter(F.col("rows") > SORTED_ROWS).isEmpty():
            break
    so_far = F.sum(words).over(Window.partitionBy("src").orderBy("place")) - words
    last = live.join(small_side(bounds, BROADCAST_SOURCES), "src").withColumn("so_far", so_far).filter((F.col("so_far") <= F.col("left")) & (F.col("so_far") + words > F.col("left")))
    rows_left = F.floor((F.col("left") - F.col("so_far")) / F.col("place.size")).cast("long")
    last = last.select("src", F.col("place").alias("cut"), F.col("n").alias("cut_n"), rows_left.alias("cut_rows"), (F.col("left") - F.col("so_far") - rows_left * F.col("place.size")).alias("gap"))
    last = written(last)
    rest = ranked.join(small_side(last, BROADCAST_SOURCES), "src").filter(F.col("place") >= F.col("cut"))
    misfit = F.abs(F.col("place.size") - F.col("gap"))
    fill = rest.filter(misfit < F.col("gap")).groupBy("src").agg(F.min_by(F.struct(F.col("place").alias("fill"), F.col("n").alias("fill_n")), F.struct(misfit, "place")).alias("f")).select("src", "f.fill", "f.fill_n")
    return written(targets.join(last.drop("gap"), "src", "left").join(fill, "src", "left"))


def _further() -> Column:
    """How many rows of the group at place get a further copy; null: all of them."""

    def of(place: Column) -> Column:
        at_cut, at_fill = F.coalesce(place == F.col("cut"), F.lit(False)), F.coalesce(place == F.col("fill"), F.lit(False))
        some = F.when(at_cut, F.col("cut_rows")).otherwise(0) + at_fill.cast("long")
        return F.when(at_cut | at_fill, some).when(F.coalesce(place > F.col("cut"), F.lit(False)), 0)

    return F.when(F.col("place").isNull(), F.lit(0).cast("long")).otherwise(_let(F.col("place"), of))


def _groups(docs: DataFrame) -> DataFrame:
    return written(docs.select(*_facts()).groupBy(*GROUP).agg(F.count("*").alias("n")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per row of docs: row (a struct of its columns), size, source_size, target, copies (0 to max_copies).

    size: the words of the whole text (null: 0); copies: how often the mix takes the row. A null source is a source of its
    own, a null doc_id an id like any other. Documents without words are never taken. doc_id and text alone decide a
    document's luck, so that reruns agree; rows that repeat both in a source share it, and where the source's words run out
    among them, some are taken and the others not. Ties of rank are ordered by doc_id, luck and size. An empty table gives
    an empty result.
    """
    groups = _groups(docs)
    plan = _plan(groups, source_targets(groups, weights, share, max_copies), max_copies)
    rows = docs.select(F.struct("*").alias("row"), *_facts()).join(small_side(plan, BROADCAST_SOURCES), "src")
    rows = _with_odds(rows, max_copies).withColumn("further", _further())
    out = ["row", "size", "source_size", "target"]
    whole = rows.select(*out, (F.col("certain") + F.coalesce(F.col("further") > 0, F.lit(True)).cast("long")).cast("long").alias("copies"), "place", "cut", "cut_n", "fill", "fill_n", "further", "certain")
    parted = (F.coalesce(F.col("place") == F.col("cut"), F.lit(False)) & (F.col("cut_n") > 1)) | (F.coalesce(F.col("place") == F.col("fill"), F.lit(False)) & (F.col("fill_n") > 1))
    if plan.filter("cut_n > 1 or fill_n > 1").isEmpty():
        return whole.select(*out, "copies")
    some = numbered(whole.filter(parted).select(*out, "certain", "further", F.col("place.luck").alias("luck"), F.col("place.doc_id").alias("doc_id")), ["luck", "doc_id", "size"])
    some = some.select(*out, (F.col("certain") + (F.col("_place") < F.col("further")).cast("long")).cast("long").alias("copies"))
    return whole.filter(~parted).select(*out, "copies").unionByName(some)


def mix_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted); from the groups of repeated
    rows, so that the texts are read once."""
    groups = _groups(docs)
    plan = _plan(groups, source_targets(groups), MAX_COPIES)
    rows = _with_odds(groups.join(small_side(plan, BROADCAST_SOURCES), "src"), MAX_COPIES).withColumn("more", F.coalesce(_further(), F.col("n")))
    deal = F.inline(F.array(F.struct(F.col("more").alias("rows"), (F.col("certain") + 1).alias("copies")), F.struct((F.col("n") - F.col("more")).alias("rows"), F.col("certain").alias("copies"))))
    dealt = rows.select("doc_id", "size", "source_size", "target", deal)
    return repeated(dealt, "rows").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, with the columns of docs."""
    return repeated(mix(docs).select("row", "copies"), "copies").select("row.*")
