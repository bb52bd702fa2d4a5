"""Periodic runs against their definition, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerlake.llm import runs
from ledgerlake.llm.common import read_table
from ledgerlake.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(w):
    """Every maximal stretch for every lag, kept where no smaller lag holds in the same stretch."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - first + q >= max(6, 4 * q):
                out.setdefault((first - q, i - first + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def digests(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = by_definition(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_random_texts():
    rng = random.Random(3)
    for _ in range(1500):
        w = [rng.randrange(rng.choice((1, 2, 3, 5, 40))) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p, a = rng.randrange(1, 9), rng.randrange(len(w) + 1)
            w[a:a] = ([rng.randrange(4) for _ in range(p)] * 9)[: rng.randrange(1, 9 * p)]
        got = runs.find_runs(np.array(w, np.uint64) + np.uint64(7), np.array([0, len(w)]))
        assert [tuple(r[1:]) for r in got.tolist()] == by_definition(w), w


def test_texts_side_by_side():
    one, two = [1, 2] * 4, [2, 1] * 3 + [9]
    got = runs.find_runs(np.array(one + two, np.uint64), np.array([0, 0, 8, 15, 15]))
    assert got.tolist() == [[1, 0, 8, 2]]


def test_query(spark, sf_dir):
    got = queries()["op12_periodic_runs"](spark, sf_dir)
    want = sorted(digests(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect())
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] > 0 for r in want) > 10


ROWS = [(1, "a b " * 5, 1, 1), (1, "a b " * 5, 1, 1), (2, None, 1, 1), (3, "", 1, 1), (None, "x\x0by z " * 4, 1, 1), (5, "é " * 6 + "e é", 1, 1), (6, "word " * 300_000, 1, 1), (7, "A a " * 3, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, start long, n int")


def test_edges(docs):
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted(map(tuple, runs.periodic_runs(docs).collect()), key=key)
    assert got == [(None, 0, 12, 3), (1, 0, 10, 2), (1, 0, 10, 2), (5, 0, 6, 1), (6, 0, 300_000, 1)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0 and runs.run_digests(docs.limit(0)).count() == 0
    rows = {r["doc_id"]: tuple(r)[1:6] for r in runs.run_digests(docs).collect()}
    assert rows[6] == (1, 0, 300_000, 1, 300_000_000) and rows[2] == rows[3] == rows[7] == (0, None, None, None, None)


def test_collapsed_documents(docs):
    out = runs.without_periodic_runs(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("1", "a b"), ("1", "a b"), ("2", None), ("3", ""), ("5", "é e é"), ("6", "word"), ("7", "A a " * 3), ("None", "x y z")]


def test_planted(spark):
    """Null ids, null texts and texts without words aren't rewritten; the rest as digests() does."""
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(200)] + [(8, None), (None, "a b c"), (9, " \t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, runs.run_digests(runs.with_planted_runs(docs)).collect())))
    assert got == sorted(str(digests(*r)) for r in rows)
