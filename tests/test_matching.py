"""Label matching in its three tiers and the items it leads to, against brute force over whole fixtures."""

import collections
import random

from pyspark.sql import functions as F

from ledgerlake.operators import matching
from ledgerlake.plans import registry
from ledgerlake.plans.fixtures import view


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return 200 * row[-1] / (len(a) + len(b)) if a or b else None


def match(label, chart):
    """(code, name, score) by the three tiers; chart: name -> (code, ordinal), names without blanks."""
    if label in chart:
        return chart[label][0], label, 1.0
    part = [(o, c, n) for n, (c, o) in chart.items() if min(len(n), len(label)) >= 3 and (n in label or label in n)]
    if part:
        return min(part)[1], min(part)[2], 0.95
    best = min((-ratio(label, n), o, c, n) for n, (c, o) in chart.items())
    return best[2] if -best[0] >= 75 else None, best[3], -best[0] / 100


def _chart(spark, sf_dir):
    """As fx_coa.filter(ordinal % 5 < 4): of one clean name the last code and the first place."""
    out = {}
    for r in sorted(view(spark, sf_dir, "fx_coa").filter("ordinal % 5 < 4").collect(), key=lambda r: r["ordinal"]):
        name = r["item_name_std"].replace(" ", "")
        out[name] = (r["item_code"], out[name][1] if name in out else r["ordinal"])
    return out


def test_three_tiers(spark, sf_dir):
    chart = _chart(spark, sf_dir)
    rows = registry.QUERIES["j4_item_match_tiers"](spark, sf_dir).collect()
    for r in rows:
        code, name, score = match(r["raw_item"].replace(" ", ""), chart)
        assert (r["item_code"], r["matched_name"], round(r["score"], 9)) == (code, name, round(score, 9))
    assert any(r["item_code"] and r["score"] < 0.95 for r in rows) and any(r["item_code"] is None for r in rows)


def test_items_of_fuzzy_labels(spark, sf_dir):
    """Every row whose label has an account in any tier is an item."""
    chart = _chart(spark, sf_dir)
    codes = lambda rows: collections.Counter(rows)
    labels = view(spark, sf_dir, "fx_cells").filter("col_no = 0").collect()
    known = {r["text"]: match(r["text"].strip(" ").replace(" ", ""), chart) for r in labels}
    want = codes((r["table_id"], r["row_no"], known[r["text"]][0]) for r in labels if known[r["text"]][0])
    got = codes((r["table_id"], r["row_no"], r["item_code"]) for r in registry.QUERIES["c10_extract_current_year_items"](spark, sf_dir).collect())
    assert got == want


def test_best_name_of_any_first_letter(spark, sf_dir):
    names = [(r["item_name_std"], r["ordinal"], r["item_code"]) for r in view(spark, sf_dir, "fx_coa").collect()]
    labels = {r["raw_item"] for r in view(spark, sf_dir, "fx_labels").collect()}
    want = {}
    for label in labels:
        n, _, code = min((-ratio(label, n), o, c) for n, o, c in names)
        want[label] = (code, round(-n, 4))
    got = registry.QUERIES["f26_fuzz_ratio"](spark, sf_dir).collect()
    assert len(got) == len(labels) and all(r["item_code"] == want[r["raw_item"]][0] and abs(r["ratio"] - want[r["raw_item"]][1]) < 1e-3 for r in got)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_few_pairs_are_compared(spark, sf_dir):
    """Every best name is among the candidates, which are a small part of all pairs and come from no nested loop."""
    names = view(spark, sf_dir, "fx_coa").select(F.col("item_name_std").alias("name")).distinct()
    labels = view(spark, sf_dir, "fx_labels").select(F.col("raw_item").alias("label")).distinct()
    pairs = matching.candidates(labels, names)
    met, every = pairs.count(), labels.count() * names.count()
    print(f"{met} of {every} pairs are compared letter by letter")
    assert met < every / 5
    assert "NestedLoop" not in _plan(pairs) and "Cartesian" not in _plan(pairs)
    assert "NestedLoop" not in _plan(matching.parts(labels, names.select("name", F.lit(1).alias("ordinal"), F.lit("c").alias("item_code"))))


def test_random_names(spark):
    """Best names below any bound, of repeated letters, ties, one letter or none, against all pairs."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aabcde 资产") for _ in range(rng.randrange(n)))
    chart = [(word(9), rng.randrange(5), f"c{i % 7}") for i in range(40)] + [(None, 1, "x")]
    labels = [(word(9),) for _ in range(80)] + [("zzz",), ("",), (None,), ("a",), ("a" * 40,), ("aaaab",), ("aaaab",)]
    table = spark.createDataFrame(chart, "name string, ordinal int, item_code string")
    got = {r["label"]: (r["item_code"], r["name"], r["ratio"]) for r in matching.best_names(spark.createDataFrame(labels, "label string"), table).collect()}
    want = {}
    for (label,) in labels:
        if label is not None:
            n, o, c, name = min((-(ratio(label, n) or 0), o, c, n) for n, o, c in chart if n is not None)
            want[label] = (c, name, -n)
    assert {k: (a, b, round(r or 0, 9)) for k, (a, b, r) in got.items()} == {k: (a, b, round(r, 9)) for k, (a, b, r) in want.items()}
    assert matching.best_names(spark.createDataFrame(labels, "label string"), table.limit(0)).count() == 0
