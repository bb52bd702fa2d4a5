"""The character models against Kneser-Ney sums by dictionaries, and their predictions on the held-out fold."""

import collections
import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import languages
from ledgerlake.llm.common import read_table
from ledgerlake.llm.queries import queries


def letters(text):
    said = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return " ".join(said.split()) + " " if said.strip() else ""


class Brute:
    """Interpolated Kneser-Ney of one language by its definition."""

    def __init__(self, texts):
        self.n = [None, *(collections.Counter() for _ in range(5))]
        for t in texts:
            s = "\0" * 4 + letters(t)
            self.n[5].update(s[i - 4 : i + 1] for i in range(4, len(s)))
        for k in range(4, 0, -1):
            self.n[k].update(g[1:] for g in self.n[k + 1])
        self.off, self.total, self.follow = [0.0], [None], [None]
        for k in range(1, 6):
            c = collections.Counter(self.n[k].values())
            self.off.append(max(0.1, min(0.9, c[1] / (c[1] + 2 * c[2]))) if c[1] + c[2] else 0.5)
            self.total.append(collections.Counter())
            self.follow.append(collections.Counter())
            for g, n in self.n[k].items():
                self.total[k][g[:-1]] += n
                self.follow[k][g[:-1]] += 1

    def p(self, gram, size):
        out = 1 / (size + 1)
        for k in range(1, 6):
            g, d = gram[5 - k :], self.off[k]
            if total := self.total[k][g[:-1]]:
                out = max(self.n[k][g] - d, 0) / total + d * self.follow[k][g[:-1]] / total * out
        return out


TEXTS = [("aa", "the cat and the hat, the THE end 12"), ("aa", "that hat ate a tea"), ("bb", "le chât et le thé"), ("bb", "où est l'été"), ("cc", "это кот и дом")]


def test_probabilities(spark):
    rows = spark.createDataFrame([(t, g) for g, t in TEXTS], "text string, lang string")
    model = languages._model(languages.discounted(languages.gram_counts(rows)).toArrow())
    own = [Brute([t for g, t in TEXTS if g == lang]) for lang in model.langs]
    size = len({c for b in own for c in b.n[1]})
    assert model.langs == ["aa", "bb", "cc"] and model.letters == size
    for text in ("the thé cat", "кот!!x", "q", "Où the"):
        s = "\0" * 4 + letters(text)
        want = [-sum(math.log2(b.p(s[i - 4 : i + 1], size)) for i in range(4, len(s))) / (len(s) - 4) for b in own]
        bits, n, has = model.entropies([text])
        assert np.allclose(bits[0], want, rtol=1e-5) and n[0] == len(s) - 4 and has[0]
    for lang, b in enumerate(own):  # a context's probabilities and those of an unseen letter sum to 1
        every = sorted({c for x in own for c in x.n[1]}) + ["一"]
        for context in ("\0\0th", "xxxx", " the"):
            window = [np.array([ord((context + c)[j]) for c in every], np.uint32) for j in range(5)]
            assert abs(model.probabilities(window)[:, lang].sum() - 1) < 1e-6, context
            assert np.allclose(model.probabilities(window)[:, lang], [b.p(context + c, size) for c in every])


def test_fewest_grams(spark, monkeypatch):
    """Where a model keeps the most frequent n-grams only, probabilities still sum to 1."""
    monkeypatch.setattr(languages, "MOST_GRAMS", 40)
    rows = spark.createDataFrame([(t, g) for g, t in TEXTS] * 3, "text string, lang string")
    kept = languages.discounted(languages.gram_counts(rows))
    assert 0 < kept.count() <= 40
    model = languages._model(kept.toArrow())
    every = sorted({c for r in kept.filter("k = 1").collect() for c in r["gram"]})
    window = [np.array([ord(("\0 th" + c)[j]) for c in every], np.uint32) for j in range(5)]
    assert (model.probabilities(window).sum(axis=0) <= 1 + 1e-6).all()


@pytest.mark.parametrize("most", [0, 40])
def test_models_beyond_memory(spark, monkeypatch, most):
    """A model of more n-grams than a task holds gives the definition's entropies all the same, seen n-grams or not."""
    rows = spark.createDataFrame([(t, g) for g, t in TEXTS], "text string, lang string")
    counts = languages.gram_counts(rows)
    monkeypatch.setattr(languages, "MOST_GRAMS", most)
    model = languages._large_model(counts)
    assert len(model.known.values) <= most
    own = [Brute([t for g, t in TEXTS if g == lang]) for lang in model.langs]
    size = len({c for b in own for c in b.n[1]})
    texts = ["the thé cat the thé", "кот!!x", "q", "Où the", "12", None, "q"]
    got = languages._joined_entropies(model, spark.createDataFrame(list(enumerate(texts)), "at int, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        s = "\0" * 4 + letters(texts[r["at"]] or "")
        want = [-sum(math.log2(b.p(s[i - 4 : i + 1], size)) for i in range(4, len(s))) / (len(s) - 4) for b in own] if len(s) > 4 else r["bits"]
        assert np.allclose(r["bits"], want, rtol=1e-5) and r["letters"] == (len(s) > 4)


def test_cap_changes_no_prediction(spark, sf_dir, monkeypatch):
    docs = read_table(spark, sf_dir, "documents")
    key = lambda: {r["doc_id"]: r for r in languages.language_predictions(docs).collect()}
    want = key()
    monkeypatch.setattr(languages, "MOST_GRAMS", 500)
    got = key()
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r["lang_pred"], r["held_out"], r["rejected"]) == (want[k]["lang_pred"], want[k]["held_out"], want[k]["rejected"])
        assert r["bits"] is None and want[k]["bits"] is None or abs(r["bits"] - want[k]["bits"]) < 1e-4 and abs(r["score"] - want[k]["score"]) < 1e-3


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    table = languages.Table(keys[::-1].copy(), np.arange(len(keys))[::-1, None].copy())
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()
    assert (table.find(np.array([0, 2**64 - 1], np.uint64)) == -1).all()


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r for r in read_table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = queries()["op11_kneser_ney"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out) >= 0.985 * len(out)
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)


def test_held_out_rows_teach_nothing(spark, sf_dir):
    """Other langs, sources and ids of held-out rows change no prediction."""
    docs = read_table(spark, sf_dir, "documents")
    out = languages.fold(F.col("doc_id"), 4) == 2
    changed = docs.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    key = lambda df: sorted(map(tuple, languages.language_predictions(df).collect()))
    assert key(docs) == key(changed)


def test_rejection(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    strange = spark.createDataFrame([(1, "Быстрая бурая лиса прыгает через ленивую собаку " * 5), (2, "zxq wvk jjh qqp " * 9)], "doc_id long, text string")
    assert all(r["rejected"] for r in languages.identify(strange, languages.train(docs)).collect())


ROWS = [(1, "the cat", "aa", 1), (1, "the cat", "aa", 1), (2, None, "aa", 1), (3, "", "bb", 1), (8, "le chat", "bb", 1), (9, "le chien", "bb", 1), (11, "le lapin", "bb", 1), (4, "12 !? \0", "bb", 1), (None, "Ü", "bb", 1), (5, "le chat " * 100_000, "bb", 1), (6, "the hat", None, 1), (7, "😀 le", "bb", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b.encode("utf-16", "surrogatepass").decode("utf-16") if b else b, c, d) for a, b, c, d in ROWS], "doc_id long, text string, lang string, bits int")


def test_edges(docs):
    rows = languages.language_predictions(docs).collect()
    assert len(rows) == len(ROWS) and languages.language_predictions(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 4} and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in rows} <= {"aa", "bb", "und"} and {r["lang_pred"] for r in rows if r["doc_id"] == 5} == {"bb"}
    assert {r["lang_pred"] for r in languages.language_predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
