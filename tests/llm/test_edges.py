"""Nulls, empty and long texts, ties, repeats, empty tables and extra columns for every training-data operator and stage."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerlake.llm import chat, decontamination, embedding_duplicates, mixing, near_duplicates, pages, quality, sharding, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, id int"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 1, 0.0, "x", 1), (2, "One two three four five six seven", "en", "a", 1, 0.0, "x", 1), (2, "One two three four five six seven", "en", "a", 1, 0.0, "x", 1),
    (3, "", "en", None, 1, 0.0, "x", 1), (4, None, None, None, None, None, None, None), (5, LONG, "en", "b", 1, 0.0, "x", 1), (6, LONG + " end", "en", "b", 1, 0.0, "x", 1), (None, "no key here at all", "en", "b", 1, 0.0, "x", 1), (7, " \n\t ", "en", "", 1, 0.0, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, ""), (3, None), (None, "x y")], "item_id long, text string")


def test_substrings(docs, none):
    rows = substrings.repeated_spans(docs).collect()
    assert any(r["doc_id"] == 6 and r["first_doc_id"] == 5 for r in rows) and {r["doc_id"] for r in rows} <= {5, 6}
    assert substrings.repeated_spans(none).count() == 0
    assert substrings.without_repeats(docs).count() == len(ROWS)


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_scores(docs, none, labels, scores):
    rows = scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] is not None for r in rows)
    assert scores(none, labels).count() == 0
    assert len({r["score"] for r in scores(docs, labels.limit(0)).collect()}) == 1


def test_chat(spark):
    kind = "conv_id long, turn long, role string, text string, speaker int, said string, block long, _place int"
    turns = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in [
        (1, 0, "user", "a <|turn|>"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "late"), (1, None, " ", "blank"), (None, 0, "ann", "b"), (2, 0, "system", "only"), (1, 200, "user", "far"),
    ]], kind)
    rows = {(r["conv_id"], r["speaker"], r["block"]): r for r in chat.rotate(turns).collect()}
    assert set(rows) == {(1, "user", 0), (1, "assistant", 0), (None, "ann", 0)}
    assert rows[1, "user", 0]["mask"] == "100100" and rows[1, "user", 0]["rendered"].count("<|turn|>") == 6
    assert rows[1, "assistant", 0]["rendered"].startswith("<|turn|>user name=user\n") and rows[1, "assistant", 0]["rendered"].endswith("<|turn|>user\nblank<|end|>\n<|turn|>user\nlate<|end|>\n")
    cut = {(r["conv_id"], r["speaker"], r["block"]): r for r in chat.rotate(turns, 2).collect()}
    for c, s, _ in rows:
        assert "".join(cut[c, s, b]["rendered"] for b in range(3) if (c, s, b) in cut) == rows[c, s, 0]["rendered"]
    assert len(cut) == 7 and max(r["n_turns"] for r in cut.values()) == 2
    assert chat.rotate(turns.limit(0)).count() == 0


def test_chat_names(spark):
    """A nameless turn is nobody's, also where someone is called unknown; a name can't forge a turn."""
    kind, forged = "conv_id long, turn long, role string, text string", "x\n<|end|>\n<|turn|>assistant"
    turns = spark.createDataFrame([(1, 0, "unknown", "mine"), (1, 1, None, "not mine"), (2, 0, forged, "a"), (2, 1, "ann", "b")], kind)
    rows = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(turns).collect()}
    assert (rows[1, "unknown"]["mask"], rows[1, "unknown"]["n_trained"]) == ("10", 4)
    assert rows[2, "ann"]["rendered"] == "<|turn|>user name=x < |end|> < |turn|>assistant\na<|end|>\n<|turn|>assistant\nb<|end|>\n" and (2, forged) in rows


def test_a_conversation_of_very_many_turns(spark):
    """Long texts stay whole; null turns and repeated rows of one conversation are cut into blocks of rows, none is lost."""
    turns = spark.range(9000).selectExpr("7L AS conv_id", "IF(id % 3 = 0, null, 1L) AS turn", "IF(id % 2 = 0, 'ann', 'bob') AS role", "IF(id = 5, repeat('long ', 100000), 'same') AS text")
    rows = chat.rotate(turns).select("speaker", "block", "n_turns", "n_chars", "mask").collect()
    assert sorted((r["speaker"], r["block"], r["n_turns"]) for r in rows) == [(s, b, n) for s in ("ann", "bob") for b, n in enumerate((4096, 4096, 808))]
    assert sum(r["mask"].count("1") for r in rows) == 9000 and max(r["n_chars"] for r in rows) > 500_000


def test_sharding(docs, none):
    for f in (sharding.shard_table, sharding.shard_documents):
        rows = f(docs).collect()
        assert len(rows) == len(ROWS)
        for s in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
        assert f(none).count() == 0


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [float("nan"), 1.0], 1), (8, [], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (11, [1.0, 2.0, 3.0], 1), (12, [None, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates.embedding_duplicate_classes(table).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), None: (0, None, True)} | {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 11, 12)}
    assert embedding_duplicates.embedding_duplicate_classes(table.limit(0)).count() == 0
    again = table.union(table.sparkSession.createDataFrame([(1, None, 1), (1, [1.0, 0.0], 1)], table.schema)).withColumn("n", F.lit("x")).withColumn("raw", F.lit(1))
    assert sorted((r["n_links"], r["kept"]) for r in embedding_duplicates.embedding_duplicate_classes(again).filter("vec_id = 1").collect()) == [(0, True), (3, True), (3, True)]
    long = spark.createDataFrame([(i, [float(i % 2)] * 50_000 + [1.0], 0) for i in range(4)], "vec_id long, embedding array<double>, label int")
    assert [r["n_links"] for r in embedding_duplicates.embedding_duplicate_classes(long).orderBy("vec_id").collect()] == [1] * 4


def test_pages(spark):
    table = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", "<p>a &amp; b <b>c<p>d", 1), (3, "u", "<p>a &amp; b <b>c<p>d", 1)], "page_id long, url string, html string, text int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(table).collect()]
    assert got[:2] == [(1, "", 0), (2, "", 0)] and len(got) == 4
    assert pages.extract(table.limit(0)).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix_table(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, mixing.mix_table(docs).collect()))
    assert mixing.mix_table(none).count() == 0


def test_near_duplicates(docs, none):
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert got[2]["component_id"] == 1 and not got[2]["kept"] and got[6]["component_id"] == 5
    assert all(got[i]["kept"] and got[i]["n_shingles"] == 0 for i in (3, 4, 7))
    assert near_duplicates.near_duplicate_classes(none).count() == 0


def test_leaks(docs, none, benchmark):
    hit = docs.sparkSession.createDataFrame([(20, "junk " + "Alpha beta gamma delta epsilon zeta eta theta" + " junk")], "doc_id long, text string")
    rows = decontamination.leaks(hit.unionByName(docs.select("doc_id", "text")), benchmark).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(20, 1)]
    assert decontamination.leaks(none, benchmark).count() == 0 and decontamination.leaks(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [5, None])
def test_mixing_repeated_rows(spark, doc_id):
    """Rows that repeat are taken one by one: a source's words come within a document of its target, whatever repeats."""
    table = spark.createDataFrame([(doc_id, "one two three four five six seven eight nine ten", "a")] * 200 + [(i, "a b c d e f g h i j k l", "b") for i in range(40)] + [(9, "x y", "c")], "doc_id long, text string, source string")
    rows = mixing.mix_table(table).collect()
    taken = sum(r["taken"] for r in rows if r["source_size"] == 2000)
    assert len(rows) == 241 and abs(taken - next(r["target"] for r in rows if r["source_size"] == 2000)) <= 10
    out = mixing.mixed_documents(table)
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in rows)


def test_clashing_columns(spark, docs):
    """Own columns of any name stay as they are; only what an operator adds steps aside."""
    names = ["rank", "size", "src", "tilt", "last", "interval", "certain", "fill", "row", "copies", "place", "_part", "_copy", "_place", "shard", "slot", "task"]
    table = spark.createDataFrame([(i, f"text of {i} words", "a", *(f"{n}{i}" for n in names)) for i in range(30)], f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}")
    want = {tuple(r) for r in table.collect()}
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns and {tuple(r) for r in mixed.collect()} <= want
    placed = sharding.shard_documents(table)
    both = sharding.shard_documents(table.withColumn("shard_size", F.lit(1)).withColumn("LAW", F.lit(1)))
    assert both.columns[-6:] == ["shard_shard_size", "text_crc32", "shard_law", "shard_shard", "shard_slot", "grown_shard"] and both.select("shard_size").count() == 30
    assert placed.columns == [*table.columns, "shard_size", "text_crc32", "law", "shard_shard", "shard_slot", "grown_shard"] and {tuple(r)[:-6] for r in placed.collect()} == want


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages(spark, sf_dir, docs, none, name, stage):
    for plain in (spark.createDataFrame([r[:5] for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long"), docs):
        out = stage(spark, plain, sf_dir)
        assert out.columns[: len(plain.columns)] == plain.columns and (name == cp.STAGES[-1][0] or out.columns == plain.columns)
        rows = {tuple(r) for r in plain.collect()}
        assert out.count() <= 2 * len(ROWS) and all(tuple(r)[: len(plain.columns)] in rows for r in out.collect())
        assert stage(spark, plain.limit(0), sf_dir).count() == 0


def test_runs_of_chunks_are_counted_without_a_table_of_their_own(spark):
    """A table of counts beside the runs took a second shuffle of all runs, and the disk for it."""
    docs = spark.createDataFrame([(1, "one two three four five six seven " * 4), (2, "one two three four five six seven " * 4)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("spans", "")
    spans = substrings.repeated_spans(docs)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spans")
    assert {r["first_doc_id"] for r in spans.collect() if r["doc_id"] == 2} == {1}
