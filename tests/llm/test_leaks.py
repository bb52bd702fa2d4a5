"""Paraphrased benchmark items against the longest common subsequence of all words, at several sizes of the table."""

import numpy as np
import pytest

from ledgerlake.llm import decontamination
from ledgerlake.llm.common import read_table

from .test_brute_force import _longest, words


def _paraphrased(spark, sf_dir, share, seed):
    """Documents that hold an item with so many of its words replaced, by brute force those that count as leaks; and all items."""
    rng = np.random.default_rng(seed)
    items = [(r["item_id"], words(r["text"])) for r in read_table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]
    pool = [w for r in read_table(spark, sf_dir, "documents").orderBy("doc_id").collect() if len(w := words(r["text"])) > 200]
    rows, want = [], set()
    for n, (k, item) in enumerate(items):
        around, other = pool[n % len(pool)][:150], pool[(n + 7) % len(pool)]
        said = [other[int(rng.integers(len(other)))] if rng.random() < share else x for x in item]
        at = int(rng.integers(len(around)))
        rows.append((n, " ".join([*around[:at], *said, *around[at:]])))
        at, number = decontamination.common(_numbers(item, said)[0], _numbers(item, said)[1]), len(item)
        answer = number - max(1, round(number * decontamination.ANSWER_PART))
        assert len(at) == _longest(item, said)
        if len(at) >= 0.6 * number and sum(p >= answer for p in at) >= 0.5 * (number - answer):
            want.add((n, k))
    return rows, want, items, pool


def _numbers(*texts):
    known = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    return [np.array([known[w] for w in t]) for t in texts]


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_replaced_words(spark, sf_dir, share):
    """Recall against brute force over all words, among 8,000 other documents' worth of passages."""
    sf_dir = "/root/testdata/sf0.01"
    rows, want, _, _ = _paraphrased(spark, sf_dir, share, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(read_table(spark, sf_dir, "documents").selectExpr("doc_id + 100000 AS doc_id", "text"))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, read_table(spark, sf_dir, "benchmark")).collect() if r["doc_id"] < 100000}
    print(f"{share:.0%} replaced: {len(got & want)} of {len(want)} found, {len(got - want)} others")
    assert len(want) >= 20 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_small_and_large_tables_agree(spark):
    """The same documents are leaks in a table of 8 rows and in the whole table; half an item is none, nor are common words."""
    sf_dir = "/root/testdata/sf0.01"
    table = read_table(spark, sf_dir, "documents")
    rows, _, items, pool = _paraphrased(spark, sf_dir, 0.25, 6)
    fixed = [(200_000 + i, t) for i, (_, t) in enumerate(rows[:4])]
    fixed += [(200_010, " ".join(pool[3][:80] + items[5][1][: len(items[5][1]) // 2] + pool[3][80:160])), (200_011, " ".join(pool[4][:200]))]
    few = spark.createDataFrame([*fixed, (1, "a b c"), (2, "the of and")], "doc_id long, text string")
    common = " ".join((["the", "of", "and", "to", "in", "is"] * 7)[:40])
    benchmark = read_table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame([(9_999_999, common)], "item_id long, text string"))
    found = lambda df: {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, benchmark).collect() if r["doc_id"] >= 200_000}
    small, large = found(few), found(few.unionByName(table.select("doc_id", "text")))
    assert small == large and {d for d, _ in small} <= {200_000 + i for i in range(4)} and len(small) >= 2


def test_windows():
    """The best stretch of twice an item's length, wherever the item begins; scattered words are none."""
    item = np.arange(30)
    for at in range(0, 200, 13):
        passage = np.full(260, -1)
        passage[at : at + 30] = item
        assert decontamination.best_window(item, passage) == (1.0, 1.0)
    scattered = np.full(300, -1)
    scattered[::10] = item
    assert decontamination.best_window(item, scattered)[0] < 0.3
