"""Collocations against their SQL and against counts by dictionaries."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import phrases
from ledgerlake.llm.queries import oracle_sql, queries

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {g: c for g, c in f.items() if c >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in often.items():
        inside = lambda x: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
        if len(w) > 1 and not any(g == lang and len(x) > len(w) and c >= a and inside(x) for (g, x), c in often.items()):
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_oracle(spark, d):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.sql(oracle_sql()["op13_collocations"])
    got = queries()["op13_collocations"](spark, d)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("bits", [26, 7])
def test_random_texts(spark, monkeypatch, bits):
    """With few bits nearly all pairs share one with a frequent pair: more edges, the same counts."""
    monkeypatch.setattr(phrases, "PAIR_BITS", bits)
    rng = random.Random(2)
    words = ["a", "b", "c", "d", "É", "X", "y-z", "日本"]
    rows = [(" ".join(rng.choice(words[: rng.randrange(1, 9)]) + rng.choice(["", "", "", ".", ",", "\n", "\x0b", " \t"]) for _ in range(rng.randrange(40))), rng.choice(["en", "fr", None])) for _ in range(150)]
    rows += [("same old passage of seven words here. " * 3, "en")] * 9
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, 6).collect()))
    assert got == brute(rows, 6) and any(r[2].count(" ") == 4 for r in got)
    assert sorted(map(tuple, phrases.collocations(docs, 6, 5).collect())) == brute(rows, 6, 5)


def test_held_counts(monkeypatch):
    """A task that passes on its counts early, from texts in small slices, gives the same sums."""
    rows = [("en", f"one two three {i % 3} four. Two three five") for i in range(200)] + [("fr", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "text"])

    def sums(work):
        out, parts = collections.Counter(), list(work(iter([batch.slice(0, 90), batch.slice(90)])))
        for part in parts:
            for *key, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out.update({(*key, e): k for e, k in collections.Counter(n).items()} if isinstance(n, list) else {tuple(key): n})
        return out, len(parts)

    edges = phrases._edges(np.full(1 << 20, 2**64 - 1, np.uint64), 5)
    want = sums(phrases._first_counts), sums(edges)
    monkeypatch.setattr(phrases, "HELD_PAIRS", 2)
    monkeypatch.setattr(phrases, "HELD_WORDS", 2)
    monkeypatch.setattr(phrases.tx.slices, "__defaults__", (64,))
    got = sums(phrases._first_counts), sums(edges)
    assert all(g[0] == w[0] and g[1] > w[1] for g, w in zip(got, want, strict=True))


def test_edges(spark):
    kind = "text string, lang string, n int, k int, phrase string"
    rows = [(None, "en", 1, 1, "x"), ("", None, 1, 1, "x"), (" .,;\n", "en", 1, 1, "x"), ("alone", "en", 1, 1, "x"), ("a b " * 200_000, None, 1, 1, "x"), ("und too " * 60, "und", 1, 1, "x"), ("und too " * 60, "und", 1, 1, "x")]
    docs = spark.createDataFrame(rows, kind)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute([r[:2] for r in rows], 100)
    assert phrases.collocations(docs.limit(0)).count() == 0 and phrases.collocations(docs.filter("text = 'alone'")).count() == 0
