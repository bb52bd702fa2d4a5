"""Collocations of two to five words from a weighted de Bruijn graph.

The graph's edges are the longest grams (LONGEST words; fewer where a piece ends), its nodes the phrases they share. Only
edges are counted from the texts. A node's count is the weight of the edges that leave it, plus the pieces that end in it;
so every shorter phrase's count follows from the next longer ones. A phrase that a single edge carries whole, in front or
behind, is an inner point of an unary path: the path's longest phrase stands for it.

A phrase of LEAST occurrences consists of pairs and triples of words of as many. So those are counted first, by hash, and
an edge ends before the first too rare one: no phrase of LEAST occurrences loses one, and texts leave few different edges to
count. Which pairs and triples are frequent is a table of 2 ** PAIR_BITS bits, whatever their number; others that share a
bit only cost edges, never a count.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import small_side, written

#: Bytes that end a piece.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
LONGEST, LEAST, TOP = 5, 100, 2000
UNKNOWN = "und"
PAIR_BITS = 26
#: Counting tasks pass on what they have beyond so many pairs and triples, or words.
HELD_PAIRS, HELD_WORDS = 1_000_000, 300_000
#: Counts of up to so many phrases are broadcast; more are joined by shuffle.
BROADCAST_PHRASES = 300_000
#: A language's candidates are ranked in so many parts first.
DEALS = 64

_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_FIRST = np.uint64(0x9E3779B97F4A7C15)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """By slice of (lang, text): langs, each text's bytes (lower case, blanks for ends), its words' offsets, and of every pair
    of neighbouring words its hash with the language and whether it lies within a piece; of every triple the same."""
    langs = batch.column(0).to_pylist()
    for row, raw, at in tx.slices(batch.column(1)):
        end = _END[raw]
        said = np.where(end, np.uint8(32), tx._LOWER[raw])
        hashes, first, word_at = tx.words(said, at, lower=False)
        own, passed = langs[row : row + len(at) - 1], np.cumsum(end, dtype=np.int32)
        inside = passed[first[1:]] == passed[first[:-1]]
        opens = word_at[1:-1]
        inside[opens[(opens > 0) & (opens < len(first))] - 1] = False
        salt = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big")) for x in set(own)}
        of = np.repeat(np.array([salt[x] for x in own], np.uint64), np.diff(word_at))
        pairs = tx.mix64(hashes[:-1] * _FIRST + hashes[1:] + of[1:]) if len(first) else hashes
        triples = tx.mix64(pairs[:-1] * _FIRST + pairs[1:])
        yield own, [said[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], word_at, (pairs, inside), (triples, inside[:-1] & inside[1:])


def _first_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of the counts of words (lang, phrase, null, n) and of hashed pairs and triples (null, null, pair, n)."""
    words: dict[str, Counter] = defaultdict(Counter)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def word_rows() -> pa.RecordBatch:
        langs, said = [x for x, c in words.items() for _ in range(len(c))], [w for c in words.values() for w in c]
        n = [k for c in words.values() for k in c.values()]
        words.clear()
        columns = [pa.array(langs, pa.string()), pa.array(said, pa.binary()).cast(pa.string()), pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "pair", "n"])

    def merged() -> None:
        key, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key)
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        held[:] = [(key[order][first], np.add.reduceat(n[order], first))]

    def pair_rows() -> pa.RecordBatch:
        [(key, n)] = held
        held.clear()
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.string()), pa.nulls(len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "phrase", "pair", "n"])

    for batch in batches:
        for langs, texts, _, *grams in _pieces(batch):
            for lang, text in zip(langs, texts, strict=True):
                words[lang].update(text.tobytes().split())
            if sum(map(len, words.values())) > HELD_WORDS:
                yield word_rows()
            held += [tuple(np.unique(h[inside], return_counts=True)) for h, inside in grams if inside.any()]
            if sum(len(k) for k, _ in held) > HELD_PAIRS:
                merged()
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield pair_rows()
    yield word_rows()
    if held:
        merged()
        yield pair_rows()


def _edges(bits: np.ndarray, longest: int):
    """Each text's edges (lang, edges): from each frequent pair on, the longest gram of frequent triples."""

    def often(hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - PAIR_BITS)
        return ((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, texts, word_at, (pairs, inside), (triples, within) in _pieces(batch):
                goes_on = np.append(within & often(triples), np.zeros(longest, bool))
                kept = np.flatnonzero(inside & often(pairs))
                size, on = np.full(len(kept), 2), np.ones(len(kept), bool)
                for j in range(longest - 2):
                    on &= goes_on[kept + j]
                    size += on
                cut, out = np.searchsorted(kept, word_at), []
                for t in np.flatnonzero(np.diff(cut)):
                    first = kept[cut[t] : cut[t + 1]] - word_at[t]
                    words = texts[t].tobytes().split()
                    out += [b" ".join(words[a:b]) for a, b in zip(first.tolist(), (first + size[cut[t] : cut[t + 1]]).tolist(), strict=True)]
                edges = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(out, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), edges], names=["lang", "edges"]).filter(pa.array(np.diff(cut) > 0))

    return work


def _frequent_pairs(pairs: DataFrame) -> np.ndarray:
    """A bit for every class of hashes that holds a pair or triple of LEAST occurrences; 2 ** (PAIR_BITS - 6) rows of 64 bits at most."""
    bit = F.shiftrightunsigned("pair", 64 - PAIR_BITS)
    rows = pairs.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (PAIR_BITS - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _first(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase and n of every phrase of k words, 1 to longest, that occurs least times; lang and words of every language)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    seen = rows.mapInArrow(tx.freed(_first_counts), "lang string, phrase string, pair long, n long")
    seen = seen.repartition("lang", "phrase", "pair").groupBy("lang", "phrase", "pair").agg(F.sum("n").alias("n"))  # tasks have summed theirs already
    seen = written(seen.filter(F.col("phrase").isNotNull() | (F.col("n") >= least)))
    words = seen.filter("phrase is not null").select("lang", "phrase", "n")
    sizes = written(words.groupBy("lang").agg(F.sum("n").alias("words")))
    bits = _frequent_pairs(seen.filter("pair is not null"))
    edges = rows.mapInArrow(tx.freed(_edges(bits, longest)), "lang string, edges array<string>")
    edges = edges.select("lang", F.explode("edges").alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("n"))
    edges = written(edges.withColumn("k", F.size(F.split("phrase", " "))))
    flow, found = edges.filter(F.col("k") == longest).select("lang", "phrase", "n"), [words.withColumn("k", F.lit(1))]
    for k in range(longest, 1, -1):
        if k < longest:
            ends = edges.filter(F.col("k") == k).select("lang", "phrase", "n")
            flow = written(flow.select("lang", _first(F.col("phrase"), k).alias("phrase"), "n").unionByName(ends).groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
        found.append(flow.withColumn("k", F.lit(k)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return written(out.filter(F.col("n") >= least).select("lang", "k", "phrase", "n")), sizes


def path_ends(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """counts without the words and without the phrases that one phrase longer by a word carries whole (and so any longer one)."""
    long = counts.filter("k > 2")
    sides = [F.expr(f"substring_index(phrase, ' ', {sign}(k - 1))") for sign in ("", "-")]
    carried = long.select("lang", F.explode(F.array(*sides)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    held = counts.filter("k > 1").join(carried, ["lang", "phrase"], "left")
    return held.filter(F.col("most").isNull() | (F.col("most") < F.col("n"))).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a (occurrences), l, r (those of the parts at the cut of
    the lowest score), n (words of the language) and score, floor(1000 a n / (l r)), exact; by score and a descending, then phrase.

    Texts are lower-cased (A-Z) and split into pieces and words, whole; a null text has none, a null lang is `und`. Ties of
    cuts go to the shorter first part. Repeated rows count each; other columns are ignored; an empty table, or one without a
    phrase of `least` occurrences, gives an empty result. No task holds more than a slice of texts, one text, and HELD_PAIRS.
    """
    counts, sizes = phrase_counts(docs, least)
    ends = written(path_ends(counts))
    cuts = [F.struct(F.lit(j).alias("j"), F.lit(side).alias("side"), F.expr(f"IF(k > {j}, substring_index(phrase, ' ', {j if side == 'l' else f'{j} - k'}), null)").alias("part")) for j in range(1, LONGEST) for side in "lr"]
    asked = ends.select("lang", "phrase", "k", F.col("n").alias("a"), F.inline(F.array(*cuts))).filter("part is not null")
    parts = small_side(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("of")), BROADCAST_PHRASES)
    of = [F.max(F.when((F.col("j") == j) & (F.col("side") == side), F.col("of"))).alias(f"{side}{j}") for j in range(1, LONGEST) for side in "lr"]
    both = asked.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "k", "a").agg(*of)
    both = both.join(small_side(sizes.withColumnRenamed("words", "n"), 100_000), "lang")
    whole = lambda *c: " * ".join(f"CAST({x} AS DECIMAL(19, 0))" for x in c)
    score = [F.when(F.col("k") > j, F.struct(F.expr(f"({whole('a', 'n')} * 1000) div ({whole(f'l{j}', f'r{j}')})").alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))) for j in range(1, LONGEST)]
    scored = both.select("lang", "phrase", "a", "n", F.least(*score).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for groups in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALS))], ["lang"]):  # dealt out first: one language may have most phrases
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by DuckDB, with every phrase counted from the texts.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), sizes AS (
    SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang
), places AS (
    SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists
), grams AS (
    SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM places, range(1, 6) AS t(k) WHERE i + k - 1 <= len(ws)
), counts AS (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), ends AS (
    SELECT * FROM counts AS c WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM counts AS x WHERE x.lang = c.lang AND x.k > c.k AND x.f >= c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
    SELECT e.*, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS p, array_to_string(string_split(phrase, ' ')[j + 1 : k], ' ') AS q
    FROM ends AS e, range(1, 5) AS t(j) WHERE j < k
), scores AS (
    SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, (1000 * c.f::HUGEINT * n::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score, j
    FROM cuts AS c JOIN counts AS x ON x.lang = c.lang AND x.phrase = p JOIN counts AS y ON y.lang = c.lang AND y.phrase = q JOIN sizes AS s ON s.lang = c.lang
), least AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least QUALIFY rank <= 2000
"""
