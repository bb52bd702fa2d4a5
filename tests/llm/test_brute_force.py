"""Operators that SQL can't express, against brute force on whole small tables."""

import collections
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgerlake.llm import decontamination, embedding_duplicates, mixing, near_duplicates, pages, quality, sharding, substrings, toxicity
from ledgerlake.llm.queries import ORACLE_NAMES, oracle_sql, queries
from ledgerlake.llm.common import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries()) == set(ORACLE_NAMES)


def test_chat_oracle(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = queries()["op3_chat_rotation"](spark, sf_dir)
    want = con.sql(oracle_sql()["op3_chat_rotation"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_sharding(spark, sf_dir):
    def jump(key, n):
        j, b, step = 0, 0, 1
        while j < n:
            b = j
            seed = xxhash.xxh64(struct.pack("<q", key), 42).intdigest()
            draw = ((xxhash.xxh64(struct.pack("<q", step), seed).intdigest() >> 33) + 1) / 2**31
            j, step = int((b + 1) / draw), step + 1
        return b

    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf_dir, "documents").collect()}
    for r in sharding.shard_table(read_table(spark, sf_dir, "documents")).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), jump(r["doc_id"], 8), jump(r["doc_id"], 9))


def test_mixing_targets(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = mixing.mix_table(docs).collect()
    size, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 2 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        for s in full or free:
            target[s] = 2 * size[s] if full else weight[s] * level
        left -= sum(2 * size[s] for s in full)
        free = free - full if full else set()
    for r in rows:
        assert abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)


def test_pareto_selection(spark, sf_dir):
    """The documents taken, recomputed: certain copies, then the lowest ranks until the words run out, then one that fits."""
    docs = read_table(spark, sf_dir, "documents")
    text = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    rows = {r["doc_id"]: r for r in mixing.mix_table(docs).collect()}
    of = collections.defaultdict(list)
    for d, r in rows.items():
        of[text[d][0]].append((d, r["size"], math.floor(r["size"] * 1000 / (r["size"] + 500)) / 1000))
    for source, members in of.items():
        target, words_all = rows[members[0][0]]["target"], sum(n for _, n, _ in members)
        mean, rate = sum(n * t for _, n, t in members) / words_all, target / words_all
        spread = max(0, min(0.5, (2 / rate - 1) / (1 - mean)))
        copies, left, ranked = {}, target, []
        for d, n, t in members:
            expected = min(2, rate * (1 + spread * (t - mean))) if n else 0
            copies[d] = math.floor(expected)
            left -= copies[d] * n
            p, u = expected - copies[d], ((_hash(d, text[d][1]) >> 11) + 0.5) / 2**53
            if p > 0:
                ranked.append((u / (1 - u) * (1 - p) / p, d, n))
        ranked.sort()
        for k, (_, d, n) in enumerate(ranked):
            if n > left:
                _, best = min((abs(m - left), (q, e)) for q, e, m in ranked[k:])
                if abs(next(m for _, e, m in ranked if e == best[1]) - left) < left:
                    copies[best[1]] += 1
                break
            left -= n
            copies[d] += 1
        assert {d: rows[d]["taken"] for d in copies} == {d: c * rows[d]["size"] for d, c in copies.items()}, source


def _hash(doc_id, text):
    h = xxhash.xxh64(b"mix", 42).intdigest()
    for part in (struct.pack("<q", doc_id), struct.pack("<i", 0), None if text is None else text.encode()):
        h = h if part is None else xxhash.xxh64(part, h).intdigest()
    return h


def test_mixing_cuts_again(spark, sf_dir, monkeypatch):
    """Intervals cut several times give the rows of intervals cut once."""
    docs = read_table(spark, sf_dir, "documents")
    once = sorted((r["doc_id"], r["taken"]) for r in mixing.mix_table(docs).collect())
    monkeypatch.setattr(mixing, "SORTED_ROWS", 2)
    monkeypatch.setattr(mixing, "INTERVALS", 3)
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix_table(docs).collect()) == once


def test_near_duplicates(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    sets = {}
    for r in docs.collect():
        w = words(r["text"])
        sets[r["doc_id"]] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert got == {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


def test_hot_group_of_near_copies(spark):
    """A chain in one crowded bucket, whose ends are far apart, stays one component; strangers near it stay out."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{i}" if i // 3 * 5 <= j < i // 3 * 5 + 1 else w for j, w in enumerate(base))) for i in range(120)]
    rows += [(1000 + i, " ".join(f"y{i}_{j}" if j % 16 == i % 16 else w for j, w in enumerate(base))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert {got[i] for i in range(120)} == {0} and all(got[1000 + i] == 1000 + i for i in range(120))


def test_rarest_shingles():
    """Every pair of similar sets shares one of its rarest shingles, and the bound on what comes from it onward holds."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 60, 80)
    sets = [np.unique(np.where(rng.random(80) < share, rng.integers(0, 1 << 60, 80), base)) for share in np.linspace(0, 0.3, 60)]
    sets += [np.unique(base[:n]) for n in (1, 2, 7, 70, 79)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), pa.array(range(len(sets)))], names=["id", "members", "at"])
    counts = np.zeros(1 << near_duplicates.COUNT_BITS, np.int64)
    [total] = near_duplicates._shingle_counts(iter([batch.select(["members"])]))
    counts[total["cell"].to_numpy()] = total["n"].to_numpy()
    [rare] = near_duplicates._rarest(counts, 85)(iter([batch]))
    first = collections.defaultdict(dict)
    for r in rare.to_pylist():
        first[r["id"]][r["shingle"]] = r["onward"]
    linked = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                linked += 1
                assert any(min(first[i][k], first[j][k]) * 185 >= (len(x) + len(y)) * 85 for k in first[i].keys() & first[j].keys())
    assert linked > 50


def test_a_crowd_that_shares_a_template(spark):
    """Texts that share two thirds of their words crowd the same bands; only the few that are near copies link."""
    rng = np.random.default_rng(12)
    base = [f"t{i}" for i in range(150)]
    own = lambda i: [f"o{i}_{j}" for j in range(20)]
    text = {i: " ".join(base + own(i)) for i in range(400)}
    for i in range(0, 400, 40):
        near = own(i)
        near[3] = "changed"
        text[1000 + i] = " ".join(base + near)
    docs = spark.createDataFrame([(i, text[i]) for i in rng.permutation(list(text)).tolist()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i in text}


def test_embeddings(spark, sf_dir):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    near = np.repeat(base[:20], 12, 0) + rng.normal(size=(240, 16)) * 0.08
    x = np.concatenate([base, near, base[:5]])
    label = (np.concatenate([np.arange(60), np.repeat(np.arange(20), 12), np.arange(5)]) % 3).tolist()
    table = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_duplicates.embedding_duplicate_classes(table).collect()}
    assert sum(got.values()) >= 0.99 * linked.sum() and all(got[i] <= linked[i].sum() for i in got)


@pytest.mark.parametrize("list_rows", [2000, 40, 5])
def test_embedding_recall(spark, monkeypatch, list_rows):
    """Links, components and kept against brute force, many cosines just above and below the threshold, for 16 to 512 lists."""
    monkeypatch.setattr(embedding_duplicates, "LIST_ROWS", list_rows)
    rng = np.random.default_rng(21)
    base = rng.normal(size=(250, 24))
    near = np.repeat(base, 9, 0) + rng.normal(size=(2250, 24)) * np.tile(np.linspace(0.05, 0.35, 9), 250)[:, None]
    x = np.concatenate([base, near, near[:30]])
    label = (np.concatenate([np.arange(250), np.repeat(np.arange(250), 9), np.repeat(np.arange(250), 9)[:30]]) % 2).tolist()
    table = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates.embedding_duplicate_classes(table).collect()}
    found = sum(n for n, _, _ in got.values())
    assert len(got) == len(x) and found % 2 == 0 and linked.sum() * 0.99 <= found <= linked.sum() and all(got[i][0] <= linked[i].sum() for i in got)
    low = np.arange(len(x))
    while True:
        least = np.minimum(low, np.where(linked, low, len(x)).min(1))
        if (least == low).all():
            break
        low = least
    assert sum(got[i][1] != low[i] for i in got) <= 0.01 * len(x) and all(k == (i == c) for i, (_, c, k) in got.items())


def test_embeddings_of_several_lengths(spark):
    """Vectors link within their own length, whatever the rows of the others; a shorter vector is no near one."""
    rng = np.random.default_rng(5)
    vectors = [v for width, n in ((16, 30), (8, 20), (24, 3)) for v in np.repeat(rng.normal(size=(n, width)), 3, 0) + rng.normal(size=(3 * n, width)) * 0.03]
    vectors += [np.append(vectors[0], [0.0] * 8), np.append(vectors[90], [0.0] * 16)]
    table = spark.createDataFrame([(i, v.tolist(), i // 3 % 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else 0
    want = {i: sum(cosine(a, b) >= 0.93 for j, b in enumerate(vectors) if j != i and j // 3 % 2 == i // 3 % 2) for i, a in enumerate(vectors)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_duplicates.embedding_duplicate_classes(table).collect()}
    assert {i: n for i, (n, _) in got.items()} == want and sum(want.values()) >= 6 * 53
    assert all(got[i][1] == i // 3 * 3 for i in range(159))


def test_leaks(spark, sf_dir):
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    bench = {r["item_id"]: five(words(r["text"])) for r in items.collect()}
    want = {(r["doc_id"], k) for r in docs.collect() for k, g in bench.items() if len(g & five(words(r["text"]))) > 0.5 * len(g)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()} == want


def test_paraphrase():
    item = np.arange(20)
    assert decontamination.check(item, np.delete(item, [3, 9, 16])) == (0.85, 0.8)
    assert decontamination.check(item, item[:14])[1] == 0


def _longest(x, y):
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_common_subsequence(monkeypatch):
    """Positions of a true common subsequence, of the greatest length, whole or halved."""
    rng = np.random.default_rng(6)
    for cells in (1 << 20, 16):
        monkeypatch.setattr(decontamination, "MOST_CELLS", cells)
        for _ in range(40):
            x, y = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(0, 30))
            at = decontamination.common(x, y)
            rest = iter(y.tolist())
            assert len(at) == _longest(x, y) and at == sorted(set(at)) and all(v in rest for v in x[at].tolist())


def test_randomised_svd(spark):
    """The distributed two-stage SVD against numpy's on the dense passage matrix."""
    rng = np.random.default_rng(8)
    n, topics = 60, rng.random((5, 60)) ** 8
    idf, rows = rng.random(n) + 0.5, []
    for d in range(300):
        p = topics[d % 5] / topics[d % 5].sum()
        rows.append((d, rng.choice(n, 40, p=p).tolist(), list(range(40))))
    a = np.zeros((300, n))
    for d, terms, _ in rows:
        np.add.at(a[d], terms, idf[terms])
        a[d] /= np.sqrt(sum(idf[t] ** 2 for t in terms))
    table = spark.createDataFrame(rows, "doc_id long, terms array<int>, places array<int>").repartition(3)
    basis, singular = decontamination.latent_basis(table, idf, 8)
    _, want, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(singular[:5], want[:5], rtol=0.03) and (singular[:5] <= want[:5] * (1 + 1e-6)).all() and np.allclose(basis.T @ basis, np.eye(8), atol=1e-3)
    assert np.linalg.svd(right[:5] @ basis)[1].min() > 0.95


def test_leak_paraphrases(spark, sf_dir):
    """Items with words put in, left out or replaced are found by the latent search; shuffled ones and other passages aren't."""
    rng = np.random.default_rng(9)
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf_dir, "benchmark").collect()]
    pool = [r["text"] for r in read_table(spark, sf_dir, "documents").collect() if len(words(r["text"])) > 50][:80]
    rows, want = [], set()
    for n, (k, text) in enumerate(items):
        w = text.split()
        keep = [x for i, x in enumerate(w) if i % 9 != 4]
        put = [y for i, x in enumerate(keep) for y in ((x, "really") if i % 11 == 5 else (x,))]
        around = pool[n % len(pool)].split()[:120]
        rows.append((2 * n, " ".join(around[:60] + put + around[60:])))
        rows.append((2 * n + 1, " ".join(around[:60] + rng.permutation(w).tolist() + around[60:])))
        want.add((2 * n, k))
    docs = spark.createDataFrame(rows + [(10_000 + i, t) for i, t in enumerate(pool)], "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (None, items[0][1]), (777, items[0][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()}
    assert {p for p in got if p[0] < 10_000 and p[1] not in (None, 777)} == want and {k for d, k in got if d == 0} == {items[0][0], None, 777}


def test_leaks_refuse_a_benchmark_that_is_too_large(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.range(2000).selectExpr("id AS item_id", "concat('word', id, ' other', id) AS text")
    monkeypatch.setattr(decontamination, "MOST_TERMS", 3999)
    with pytest.raises(ValueError, match="4000 terms"):
        decontamination.leaks(docs, items)
    monkeypatch.setattr(decontamination, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="bytes of distinct text"):
        decontamination.leaks(docs, items)


def test_repeats(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(5000)]
    draw = lambda n: rng.choice(vocabulary, n).tolist()
    passage = draw(60)
    rows = [(i, " ".join(draw(80) + (passage if i % 10 == 3 else []) + draw(80))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substrings.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in spans} == set(range(13, 100, 10)) and {r["first_doc_id"] for r in spans} == {3}
    text = dict(rows)
    assert all(text[r["doc_id"]].encode()[r["start"] : r["start"] + r["n_bytes"]].decode() in text[3] for r in spans)
    clean = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs).collect()}
    assert clean[3] == text[3] and len(clean[13].split()) < 190


def test_spans_by_plain_runs(spark, sf_dir):
    """Every span of the table, from runs of chunks kept as bytes in a dictionary (equal chunk by chunk)."""
    docs = read_table(spark, sf_dir, "documents")
    where, cut = collections.defaultdict(list), {}
    for r in docs.orderBy("doc_id").collect():
        raw = (r["text"] or "").encode()
        first = substrings.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() if raw else []
        ends, runs = [*first[1:], len(raw)], set()
        for i in range(len(first)):
            runs |= {(i, j) for j in [next((j for j in range(i, len(first)) if ends[j] - first[i] >= 64), None)] if j is not None}
            runs |= {(j, i) for j in [next((j for j in range(i, -1, -1) if ends[i] - first[j] >= 64), None)] if j is not None}
        cut[r["doc_id"]] = first
        for i, j in sorted(runs):
            where[tuple(raw[first[k] : ends[k]] for k in range(i, j + 1))].append((r["doc_id"], first[i], ends[j]))
    repeats = collections.defaultdict(list)
    for places in where.values():
        for d, a, b in places[1:]:
            repeats[d].append((a, b, places[0][0]))
    want = []
    for d, found in repeats.items():
        spans = []
        for a, b, source in sorted(found):
            if spans and a <= spans[-1][1]:
                spans[-1] = [spans[-1][0], max(b, spans[-1][1]), min(source, spans[-1][2])]
            else:
                spans.append([a, b, source])
        want += [(d, a, b - a, sum(a <= f < b for f in cut[d]), source) for a, b, source in spans]
    got = substrings.repeated_spans(docs).select("doc_id", "start", "n_bytes", "n_chunks", "first_doc_id").collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(want)


def test_chance_repeats_are_no_spans(spark):
    """Frequent words and short phrases repeat everywhere; only a passage that stands as a whole elsewhere is a span, all of it."""
    rng = np.random.default_rng(2)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(1000)])
    weight = 1 / np.arange(1, 1001)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=weight / weight.sum()))
    passage = draw(40)
    text = {i: " ".join([draw(150), *([passage] if i in (7, 300) else []), draw(150)]) for i in range(400)}
    mosaic = np.frombuffer(draw(300).encode(), np.uint8)
    first = substrings.chunks(mosaic, np.array([0, len(mosaic)]))[0].tolist()
    for i, (f, e) in enumerate(zip(first, first[1:], strict=False)):  # every short chunk of the last document stands in one of its own before
        if f >= 32 and e - f < 30:
            text[1000 + i] = " ".join([draw(20), mosaic[f - 32 : e].tobytes().decode() + draw(20)])
    text[9999] = mosaic.tobytes().decode()
    spans = substrings.repeated_spans(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["first_doc_id"]) for r in spans] == [(300, 7)]
    span = text[300][spans[0]["start"] :][: spans[0]["n_bytes"]]
    assert span in text[7] and len(span) > len(passage) - 100
    raw = np.frombuffer(text[300].encode(), np.uint8)
    inside = [spans[0]["start"] <= f < spans[0]["start"] + len(span) for f in substrings.chunks(raw, np.array([0, len(raw)]))[0]]
    assert sum(inside) == spans[0]["n_chunks"]


def test_repeats_without_white_space(spark):
    """Passages without white space are found at any offset, and what is left of the texts is whole characters."""
    rng = np.random.default_rng(4)
    han = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n)))
    code = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), n))
    text, passage = {}, {0: han(400), 1: code(1200)}
    for i in range(40):
        draw = (han, code)[i % 2]
        text[i] = draw(500 + 7 * i) + (passage[i % 2] if i in (4, 5, 24, 25) else "") + draw(700)
    text[50], text[51] = "\u00e9" * 3001, "x" + "\u00e9" * 3001
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    spans = {(r["doc_id"], r["first_doc_id"]): text[r["doc_id"]].encode()[r["start"] :][: r["n_bytes"]].decode() for r in substrings.repeated_spans(docs).collect() if r["doc_id"] < 50}
    assert set(spans) == {(24, 4), (25, 5)} and all(s in passage[k[0] % 2] and len(s.encode()) > 900 for k, s in spans.items())
    kept = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs).collect()}
    assert all(kept[d] == text[d].replace(s, "") for (d, _), s in spans.items()) and set(kept[51]) <= set("x\u00e9")


def test_chunks_survive_an_insertion():
    text = np.frombuffer(" ".join(f"word{i * 7919 % 1009}" for i in range(400)).encode(), np.uint8)
    moved = np.concatenate([np.frombuffer(b"new words in front ", np.uint8), text])
    cut = lambda raw: {bytes(p) for p in np.split(raw, substrings.chunks(raw, np.array([0, len(raw)]))[0][1:])}
    assert len(cut(text) - cut(moved)) <= 2


def _held_out(spark, frame, label):
    labels = {r["doc_id"]: r[label] for r in read_table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [(r["predicted"], labels[r["doc_id"]]) for r in frame.collect() if r["held_out"] and r["doc_id"] in labels]
    return sum(p == y for p, y in rows) / len(rows)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    assert _held_out(spark, toxicity.toxicity_scores(read_table(spark, d, "documents"), read_table(spark, d, "labels")), "toxic") > 0.93


def test_log_count_ratios(spark, sf_dir):
    """The n-grams of texts, their ratios and the fit, against plain counting and a dense gradient."""
    rows = [(r["text"] or "", r["doc_id"] % 2) for r in read_table(spark, sf_dir, "documents").collect() if len(r["text"] or "") < 2000][:60]
    table = spark.createDataFrame(rows, "text string, y int").repartition(3)
    n_toxic = sum(y for _, y in rows)
    got = {r["bucket"]: r["ratio"] for r in toxicity.log_count_ratios(table, len(rows) - n_toxic, n_toxic).collect()}
    seen, held = (collections.Counter(), collections.Counter()), []
    for text, y in rows:
        joined = f" {' '.join(text.lower().split())} "
        pieces = {joined[i : i + n] for n in toxicity.ORDERS for i in range(len(joined) - n + 1)}
        buckets = set()
        for g in pieces:
            h = sum(ord(c) * int(k) for c, k in zip(g, toxicity._KEYS[len(g)], strict=True)) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            h ^= h >> 12
            buckets.add(h >> (32 - toxicity.BUCKET_BITS))
        seen[y].update(buckets)
        held.append(buckets)
    want = {}
    for b in seen[0].keys() | seen[1].keys():
        other, toxic = seen[0][b] + 1, seen[1][b] + 1
        ratio = math.log(toxic / (n_toxic + 2)) - math.log(other / (len(rows) - n_toxic + 2))
        if other + toxic - 2 >= toxicity.LEAST_TEXTS and abs(ratio) >= toxicity.LEAST_ERRORS * math.sqrt(1 / other + 1 / toxic):
            want[b] = ratio
    assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-9 for b in want)


def test_logistic_fit():
    """The sparse fit takes the steps of a dense one and lowers the loss."""
    rng = np.random.default_rng(15)
    held = rng.random((200, 12)) < 0.3
    ratio = rng.normal(size=12) * 2
    y = (rng.random(200) < 1 / (1 + np.exp(-(held @ ratio)))).astype(float)
    x = held * ratio / 4
    w, b, sw, sb = np.zeros(12), math.log(y.sum() / (1 - y).sum()), np.full(12, 1e-8), 1e-8
    for _ in range(toxicity.ROUNDS):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g, h = x.T @ e + toxicity.DECAY * w / len(y), e.sum()
        sw, sb = sw + g * g, sb + h * h
        w, b = w - toxicity.RATE * g / np.sqrt(sw), b - toxicity.RATE * h / np.sqrt(sb)
    got, bias = toxicity.fit([np.flatnonzero(r) for r in held], y, ratio)
    loss = lambda w, b: np.mean(np.log1p(np.exp(-(2 * y - 1) * (held @ w + b))))
    assert np.allclose(got, w * ratio / 4) and np.isclose(bias, b) and loss(got, bias) < 0.7 * loss(0 * got, 0.0)


def test_forward_backward_by_enumeration():
    """Marginals of lines and of neighbouring lines against the sum over all 2 ** n labellings, several texts side by side."""
    import itertools

    rng = np.random.default_rng(16)
    sizes = [1, 5, 0, 7, 3, 1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    unit, moves = rng.normal(size=(at[-1], 2)) * 2, rng.normal(size=(2, 2))
    good, pair = quality._forward_backward(unit, moves, at)
    row = 0
    for a, n in zip(at, sizes, strict=False):
        total, one, two = 0.0, np.zeros(n), np.zeros((max(n - 1, 0), 2, 2))
        for labels in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(unit[a + i, k] for i, k in enumerate(labels)) + sum(moves[j, k] for j, k in zip(labels, labels[1:], strict=False)))
            total += p
            one += p * np.array(labels)
            for i, (j, k) in enumerate(zip(labels, labels[1:], strict=False)):
                two[i, j, k] += p
        assert np.allclose(good[a : a + n], one / total) and np.allclose(pair[row : row + len(two)], two / total)
        row += len(two)
    assert row == len(pair)


def test_quality_gradient():
    """The field's fit reaches a higher likelihood than no field, and its neighbours' features tell mixed texts apart."""
    rng = np.random.default_rng(17)
    sizes = rng.integers(2, 6, 60)
    at = np.concatenate([[0], np.cumsum(sizes)])
    y = np.arange(60) % 2.0
    x = np.column_stack([rng.normal(size=(at[-1], 3)) + np.repeat(y, sizes)[:, None], np.ones(at[-1])])
    model = quality.fit(x, np.ones(at[-1]), at, y)
    score = quality.model_quality(model, x, np.ones(at[-1]), at)
    assert ((score > 0) == (y == 1)).mean() > 0.9


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    assert _held_out(spark, quality.quality_scores(read_table(spark, d, "documents"), read_table(spark, d, "labels")), "quality") > 0.95


def test_pages():
    long = "The story of the town is that it was by the river and that the people of it have been there for as long as anyone can tell. " * 2
    page = f"""<html><head><title>t</title><script>var a="<p>x</p>"</script></head><body><header>Site</header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies on this site</div><div id=content><h2>Short head</h2><p>{long}<p>Short &eacute;nd</p></div>
    <div class="comments"><p>{long}</p></div><form><p>Sign up</p></form><aside>{long}</aside><footer>&copy; us</footer></body>"""
    assert pages.main_text(page) == f"Short head\n{long.strip()}\nShort énd"


def test_pages_class_names():
    body = "The words of the text are in the page and they are of use to the reader of it, as it was to be. " * 2
    page = f'<body class="has-sidebar"><div class="content no-sidebar"><div class="entry-header"><h1>Head</h1></div><p>{body}</p><ul><li>one<li>two</ul><div class="post-comments"><p>{body}</p></div></div><div role=navigation>Menu</div></body>'
    assert pages.main_text(page) == f"Head\n{body.strip()}\none\ntwo"
    assert pages.main_text("<article><header><h1>T</h1></header><p>a &lt; b<br>c&nbsp;&#100;</p><!-- <p>x</p> --><pre> k\n  l </pre><div class='share-bar'>Share</div></article>") == "T\na < b c d\nk l"


def test_pages_text_outside_an_article():
    """An article elsewhere on the page deletes neither a main text in plain blocks nor a headline above it."""
    body = "The words of the text are in the page and they are of use to the reader of it, as it was to be. " * 2
    page = f"<body><h1>Head</h1><div><p>{body}</p><p>{body}</p></div><article><h3>Teaser</h3></article><div class=sidebar>{body}</div><footer>us</footer></body>"
    assert pages.main_text(page) == f"Head\n{body.strip()}\n{body.strip()}\nTeaser"
    assert pages.main_text(f"<body><nav>Menu</nav><h1>Head</h1><article><p>{body}</p></article></body>") == f"Head\n{body.strip()}"


BODY = "The words of the text are in the page and they are of use to the reader of it, as it was to be. " * 2


def test_pages_names_and_comments():
    """Class words mark furniture by whole names only; comments are known by their section's heading or type."""
    page = f"""<article><h1>Head</h1><p class="side-effects">{BODY}</p><p class="social-history">Short one</p><p id="related">Another</p><div class="menu-planning">{BODY}</div>
    <p><a href=x>All of it a link</a></p><h2>Comments</h2><p>{BODY}</p></article>
    <section class="thread"><h3>Reader comments</h3><p>{BODY}</p></section><section><header><h2>12 Comments</h2></header><ol><li>{BODY}</ol></section>
    <div><div itemscope itemtype="https://schema.org/Comment"><p>{BODY}</p></div></div><div class="related-posts">{BODY}</div><ul id=main-nav><li>{BODY}</ul>"""
    body = BODY.strip()
    assert pages.main_text(page) == f"Head\n{body}\nShort one\nAnother\n{body}\nAll of it a link\nComments\n{body}"


def test_page_densities_decide(sf_dir):
    """Stop words and links label blocks inside articles too, and the second pass has blocks to decide there."""
    import pyarrow.parquet as pq

    labels = collections.Counter()
    for page in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist():
        labels.update((pages.first_pass(b), b.in_article) for b in pages.blocks(page) if not b.furniture)
    assert labels[pages.GOOD, True] > 50 and labels[pages.OPEN, True] > 50
    soup = " ".join(f"<a href={i}>tag{i}</a>" for i in range(40))
    assert pages.main_text(f"<article><p>{BODY}</p><p>Short.</p><p>{soup}</p></article>") == f"{BODY.strip()}\nShort."
    assert pages.main_text(f"<div><p>{BODY}</p><p>Short.</p><p>Lorem ipsum {'dolor sit amet consectetur ' * 5}</p></div>") == f"{BODY.strip()}\nShort."
    foreign = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor."
    assert pages.main_text(f"<p>x</p><article><p>{foreign}</p><p>Short</p></article>") == f"{foreign}\nShort"


def test_second_pass_by_brute_force():
    rng = np.random.default_rng(14)
    for _ in range(300):
        n = int(rng.integers(0, 12))
        found = [pages.Block("x", 0, bool(rng.random() < 0.2), bool(rng.random() < 0.5)) for _ in range(n)]
        labels = [pages.BAD if b.furniture else int(rng.integers(-1, 2)) for b in found]
        want = []
        for i in range(n):
            asked = [j for j in range(n) if labels[j] and not found[j].furniture and (found[j].in_article or not found[i].in_article)]
            sides = [labels[j] for j in (max((j for j in asked if j < i), default=-1), min((j for j in asked if j > i), default=-1)) if j >= 0]
            want.append(labels[i] == 1 or (labels[i] == 0 and (1 in sides or (found[i].in_article and not sides))))
        assert pages.second_pass(labels, found) == want


def test_pages_in_proportion():
    """A megabyte of tags that nobody closes takes a few seconds at most."""
    import time

    began = time.time()
    for tag in ("<font>", "<div class=a>", "<p>x", "<a href=x>y", "<section><h2>Comments</h2>", "<a title='x>"):
        pages.main_text(tag * ((1 << 20) // len(tag)) + "end")
    assert time.time() - began < 30
