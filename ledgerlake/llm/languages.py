"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ORDER characters over its letters, everything between letters being one blank. Spark counts the
longest n-grams of all training documents; a shorter one counts in how many longer ones it ends (its continuations). A
probability is the discounted count plus what the context's discounts leave, times the probability by the shorter context.
Scoring looks n-grams up in sorted arrays of 64-bit hashes, one array an order with a column for each language. A model of
more than MOST_GRAMS n-grams stays in tables: tasks hold the probabilities of the most frequent longest n-grams only, and
what else the texts hold is joined with the whole model by shuffles.

The language of the lowest cross-entropy a character wins. A fold of the training documents that is not counted calibrates
two things on pieces of several lengths: the temperature that makes a probability of the entropies, and for each language
the entropy that only REJECTED_SHARE of its own pieces exceed; a text above it is rejected as of no known language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import small_side, written
from .labelled import MOST_BYTES, fold

ORDER = 5
PARTS, HELD_OUT = 4, 2
#: One training document in so many calibrates and isn't counted; of those, at most PER_LANGUAGE a language are used.
CALIBRATE, PER_LANGUAGE = 20, 300
#: Calibration pieces: lengths in characters, and so many of each length a document.
LENGTHS, PIECES = (16, 64, 256), 4
REJECTED_SHARE = 0.005
#: A task holds so many n-grams of all languages and orders at most; a larger model is joined by shuffles.
MOST_GRAMS = 1 << 20
#: Joined log probabilities are summed in whole parts of this size, so that sums don't depend on the order.
FIXED = 1 << 24
#: Counting tasks pass on what they have beyond so many n-grams.
HELD_GRAMS = 400_000
UNKNOWN = "und"

_KEYS = tx.random64(ORDER, 17)
_PAD = "\0" * (ORDER - 1)


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks on them, 0 for all else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, which end an n-gram, text of each): a text is its padding, then letters, all between as one blank."""
    raw = np.frombuffer("".join(f"{_PAD}{t.lower().replace('\0', ' ')} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    pad, inside = raw == 0, _kinds()[raw] > 0
    keep = inside | pad
    keep[1:] |= inside[:-1]  # the first of what stands between letters
    points = np.where(inside | pad, raw, np.uint32(32))[keep]
    starts = (np.cumsum(pad) - 1) // len(_PAD)
    ends = points != 0
    return points, np.flatnonzero(ends), starts[keep][ends]


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams given character by character; n-grams of different lengths differ."""
    total = np.full(len(columns[0]) if columns else 1, len(columns), np.uint64)
    for key, points in zip(_KEYS[ORDER - len(columns) :], columns, strict=True):
        total += key * (points.astype(np.uint64) + np.uint64(1))
    return tx.mix64(total)


def _windows(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [points[at - (ORDER - 1 - j)] for j in range(ORDER)]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    for row, _, at in tx.slices(batch.column(column)):
        yield row, [t or "" for t in batch.column(column).slice(row, len(at) - 1).to_pylist()]


def _merged(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Parts (key, count, language, n-gram) summed by key."""
    key, n, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(key)
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    return [key[order][first], np.add.reduceat(n[order], first), *(c[order[first]] for c in rest)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of the counts (lang, gram, n) of the longest n-grams in (text, lang)."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, ...]] = []

    def rows() -> pa.RecordBatch:
        _, n, lang, grams = held[0]
        said = grams.tobytes().decode("utf-32-le")
        known = list(names)
        return pa.RecordBatch.from_arrays([pa.array([known[k] for k in lang]), pa.array([said[k : k + ORDER] for k in range(0, len(said), ORDER)]), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        langs = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
        for row, texts in _texts(batch, 0):
            points, at, owner = _points(texts)
            if not len(at):
                continue
            window, lang = _windows(points, at), langs[row + owner]
            key = _hash(window) + tx.mix64(lang.astype(np.uint64) + np.uint64(1))
            order = np.argsort(key)
            first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            one = order[first]
            held.append((key[one], np.diff(np.append(first, len(order))), lang[one], np.stack([w[one] for w in window], axis=1)))
            if sum(len(h[0]) for h in held) > HELD_GRAMS:
                held = [tuple(_merged(held))]
                if len(held[0][0]) > HELD_GRAMS // 2:
                    yield rows()
                    held = []
    if held:
        held = [tuple(_merged(held))]
        yield rows()


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, k, gram and n of docs (text, lang): occurrences of the longest n-grams, continuations of shorter ones."""
    level = written(docs.select("text", "lang").mapInArrow(tx.freed(_counted), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    levels = [level.withColumn("k", F.lit(ORDER))]
    for k in range(ORDER - 1, 0, -1):
        level = written(level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
        levels.append(level.withColumn("k", F.lit(k)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _kept_from(counts: DataFrame) -> int:
    """The class of counts (eight to a doubling) from which on at most MOST_GRAMS n-grams are left."""
    sizes = counts.groupBy(_class()).agg(F.count("*").alias("rows")).collect()  # some 400 classes at most
    kept, left = 0, MOST_GRAMS
    for c, rows in sorted(map(tuple, sizes), reverse=True):
        left -= rows
        if left < 0:
            return c + 1
        kept = c
    return kept


def _class() -> Column:
    return F.floor(8 * F.log2("n")).cast("int")


def _totals(counts: DataFrame) -> DataFrame:
    """lang, k, context: its occurrences (total), how many n-grams follow it (follow), and the discount of that order (off)."""
    once, twice = F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
    off = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5))))
    discounts = written(counts.groupBy("lang", "k").agg(off.alias("off")))
    totals = counts.groupBy("lang", "k", _context().alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("follow"))
    return totals.join(small_side(discounts, 100_000), ["lang", "k"])


def _context() -> Column:
    return F.substring(F.col("gram"), F.lit(1), F.col("k") - 1)


def _parts(counts: DataFrame, totals: DataFrame) -> DataFrame:
    rows = counts.withColumn("context", _context()).join(totals, ["lang", "k", "context"])
    return rows.select("lang", "k", "gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("part"))


def discounted(counts: DataFrame) -> DataFrame:
    """lang, k, gram and part: the discounted share of the n-gram in its context, of the MOST_GRAMS most frequent n-grams."""
    return _parts(counts.filter(_class() >= _kept_from(counts)), _totals(counts))


@dataclass
class Spread:
    """A whole model of any size in tables, each with an array by language."""

    parts: DataFrame  # k, gram, part: discounted shares of n-grams
    rests: DataFrame  # k, context, rest: what a context leaves to shorter ones
    n_langs: int
    letters: int

    def logs(self, grams: DataFrame) -> DataFrame:
        """gram and logs (base 2 of P(last character | those before), by language) of distinct longest n-grams, seen or not."""
        every = F.sequence(F.lit(0), F.lit(self.n_langs - 1))
        out = None
        for k in range(1, ORDER + 1):
            rows = grams.select(F.substring("gram", ORDER - k + 1, k).alias("gram")).distinct() if k < ORDER else grams
            rows = rows.withColumns({"context": F.substring("gram", 1, k - 1), "shorter": F.substring("gram", 2, k - 1)})
            rows = rows.join(self.parts.filter(F.col("k") == k).drop("k"), "gram", "left").join(self.rests.filter(F.col("k") == k).drop("k"), "context", "left")
            if out is None:
                rows = rows.withColumn("lower", F.array_repeat(F.lit(1 / (self.letters + 1)), self.n_langs))
            else:
                rows = rows.join(out.select(F.col("gram").alias("shorter"), F.col("p").alias("lower")), "shorter")
            p = F.transform(every, lambda i: F.coalesce(F.col("part")[i], F.lit(0.0)) + F.coalesce(F.col("rest")[i], F.lit(1.0)) * F.col("lower")[i])
            out = rows.select("gram", p.alias("p"))
        return out.select("gram", F.transform("p", F.log2).alias("logs"))


def _spread(counts: DataFrame, langs: list[str]) -> Spread:
    totals = written(_totals(counts))

    def by_lang(rows: DataFrame, key: str, value: str, default: float) -> DataFrame:
        held = rows.groupBy("k", key).agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("held"))
        each = F.transform(F.array(*map(F.lit, langs)), lambda x: F.coalesce(F.try_element_at(F.col("held"), x), F.lit(default)))
        return written(held.select("k", key, each.alias(value)))

    rest = F.greatest(F.lit(1e-9), F.col("off") * F.col("follow") / F.col("total"))
    parts = by_lang(_parts(counts, totals), "gram", "part", 0.0)
    return Spread(parts, by_lang(totals.withColumn("rest", rest), "context", "rest", 1.0), len(langs), parts.filter("k = 1").count())


class Table:
    """A sorted array of hashes with rows of values; a hash's place is guessed from its leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        bits = max(1, len(keys).bit_length())
        self.keys, self.values, self.shift = np.append(keys[order], np.uint64(2**64 - 1)), values[order], np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 for none."""
        at = self.first[hashes >> self.shift]
        late = np.flatnonzero(self.keys[at] < hashes)
        while len(late):
            at[late] += 1
            late = late[self.keys[at[late]] < hashes[late]]
        return np.where((self.keys[at] == hashes) & (at < len(self.values)), at, -1)

    def get(self, hashes: np.ndarray, default: float) -> np.ndarray:
        at = self.find(hashes)
        out = np.full((len(hashes), self.values.shape[1]), default)
        out[at >= 0] = self.values[at[at >= 0]]
        return out


@dataclass
class LanguageModel:
    langs: list[str]
    letters: int
    parts: list[Table]  # by order: discounted shares of n-grams
    rests: list[Table]  # by order: what a context leaves to shorter ones
    known: Table | None = None  # log probabilities of the longest n-grams
    temperature: float = 1.0
    limits: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # by language and length: bits a character
    spread: Spread | None = None  # the whole model where parts and rests can't hold it

    def light(self) -> LanguageModel:
        """The model as tasks get it, without tables."""
        return replace(self, spread=None)

    def probabilities(self, window: list[np.ndarray]) -> np.ndarray:
        """P(last character | those before) of n-grams given character by character; a column for each language."""
        p = np.full((len(window[0]), len(self.langs)), 1 / (self.letters + 1))
        for k in range(1, ORDER + 1):
            context = _hash(window[ORDER - k : -1]) if k > 1 else np.repeat(_hash([]), len(p))
            p = self.parts[k - 1].get(_hash(window[ORDER - k :]), 0.0) + self.rests[k - 1].get(context, 1.0) * p
        return p

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits a character by text and language, characters, whether the text has a letter)."""
        points, at, owner = _points(texts)
        window = _windows(points, at)
        h = _hash(window) if len(at) else np.zeros(0, np.uint64)
        row = self.known.find(h)
        new = np.flatnonzero(row < 0)
        _, one, which = np.unique(h[new], return_index=True, return_inverse=True)
        fresh = np.log2(self.probabilities([w[new[one]] for w in window])) if len(new) else np.zeros((0, len(self.langs)))
        n, total = np.bincount(owner, minlength=len(texts)), np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            each = np.append(self.known.values[:, k], np.float32(0))[row]
            total[:, k] = np.bincount(owner, each, len(texts)) + np.bincount(owner[new], fresh[which, k], len(texts))
        return -total / np.maximum(n, 1)[:, None], n, np.bincount(owner, _kinds()[points[at]] == 2, len(texts)) > 0

    def looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]], list[list[int]]]:
        """(log probabilities of known n-grams summed by text and language, characters, whether the text has a letter, and each
        text's other n-grams with how often it has them)."""
        points, at, owner = _points(texts)
        window = _windows(points, at)
        h = _hash(window) if len(at) else np.zeros(0, np.uint64)
        row = self.known.find(h)
        each = np.append(self.known.values, np.zeros((1, len(self.langs)), np.float32), axis=0)
        total = np.stack([np.bincount(owner, each[row, k], len(texts)) for k in range(len(self.langs))], axis=1)
        new = np.flatnonzero(row < 0)
        new = new[np.lexsort((h[new], owner[new]))]
        first = np.flatnonzero(np.append(True, (np.diff(h[new]) != 0) | (np.diff(owner[new]) != 0))[: len(new)])
        said = np.stack([w[new[first]] for w in window], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
        grams, times = [said[k : k + ORDER] for k in range(0, len(said), ORDER)], np.diff(np.append(first, len(new))).tolist()
        cut = np.searchsorted(owner[new[first]], np.arange(len(texts) + 1))
        has = np.bincount(owner, _kinds()[points[at]] == 2, len(texts)) > 0
        return total, np.bincount(owner, minlength=len(texts)), has, [grams[a:b] for a, b in zip(cut, cut[1:])], [times[a:b] for a, b in zip(cut, cut[1:])]

    def chances(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities of the languages of texts of n characters."""
        x = -self.temperature * np.sqrt(n)[:, None] * (bits - bits.min(axis=1, keepdims=True))
        x = np.exp(np.maximum(x, -700))
        return x / x.sum(axis=1, keepdims=True)

    def rejected(self, bits: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        size = np.searchsorted(LENGTHS, n, "right") - 1
        return (size >= 0) & (bits[np.arange(len(n)), best] > self.limits[best, np.maximum(size, 0)])


def _model(rows: pa.Table) -> LanguageModel:
    langs = sorted(set(rows["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(langs)}
    lang, order, part = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64), rows["k"].to_numpy(), rows["part"].to_numpy()
    said = np.array(rows["gram"].to_pylist(), object)
    parts, rests, longest = [], [], []
    for k in range(1, ORDER + 1):
        own = np.flatnonzero(order == k)
        grams = np.frombuffer("".join(said[own]).encode("utf-32-le"), np.uint32).reshape(-1, k)
        columns = [grams[:, j] for j in range(k)]
        keys, one, row = np.unique(_hash(columns) if len(own) else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        share = np.zeros((len(keys), len(langs)))
        share[row, lang[own]] = part[own]
        parts.append(Table(keys, share))
        contexts, at = np.unique(_hash(columns[:-1]) if k > 1 and len(own) else np.repeat(_hash([]), len(own)), return_inverse=True)
        rest = np.ones((len(contexts), len(langs)))
        np.add.at(rest, (at, lang[own]), -part[own])
        rests.append(Table(contexts, np.maximum(rest, 1e-9)))
        longest = [c[one] for c in columns]
    model = LanguageModel(langs, len(parts[0].values), parts, rests)
    keys = _hash(longest) if len(longest[0]) else np.zeros(0, np.uint64)
    model.known = Table(keys, np.log2(model.probabilities(longest)).astype(np.float32) if len(keys) else np.zeros((0, len(langs)), np.float32))
    model.limits = np.full((len(langs), len(LENGTHS)), np.inf)
    return model


def _large_model(counts: DataFrame) -> LanguageModel:
    """A model of any size: its tables, and the probabilities of the most frequent longest n-grams, MOST_GRAMS at most."""
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    spread = _spread(counts, langs)
    longest = written(counts.filter(F.col("k") == ORDER).groupBy("gram").agg(F.sum("n").alias("n")))
    frequent = written(longest.filter(_class() >= _kept_from(longest)).select("gram"))
    rows = spread.logs(frequent).select("gram", F.col("logs").cast("array<float>").alias("logs")).toArrow()  # MOST_GRAMS rows at most
    grams = np.frombuffer("".join(rows["gram"].to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    values = rows["logs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, len(langs))
    known = Table(_hash([grams[:, j] for j in range(ORDER)]) if len(grams) else np.zeros(0, np.uint64), values)
    return LanguageModel(langs, spread.letters, [], [], known, limits=np.full((len(langs), len(LENGTHS)), np.inf), spread=spread)


def _joined_entropies(model: LanguageModel, docs: DataFrame) -> DataFrame:
    """docs without text, with n, letters and bits as LanguageModel.entropies gives them, for a model in tables.

    A row's n-grams that tasks don't hold are written with it once, looked up all together, each distinct one once, and summed
    by row."""
    light, columns = model.light(), [c for c in docs.columns if c != "text"]
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, texts in _texts(batch, place):
                total, n, letters, grams, times = light.looked_up(texts)
                cut = pa.array(np.arange(len(texts) + 1) * len(light.langs), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(batch.schema.get_field_index(c)).slice(row, len(texts)) for c in columns), pa.array(np.arange(task, task + len(texts))), pa.array(n), pa.array(letters),
                    pa.ListArray.from_arrays(cut, pa.array(total.ravel())), pa.array(grams, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64())),
                ], names=[*columns, "_row", "n", "letters", "_held", "_grams", "_times"])
                task += len(texts)

    kinds = "".join(f"`{c}` {t}, " for c, t in docs.dtypes if c != "text")
    rows = written(docs.mapInArrow(tx.freed(work), kinds + "_row long, n long, letters boolean, _held array<double>, _grams array<string>, _times array<long>"))
    logs = written(model.spread.logs(written(rows.select(F.explode("_grams").alias("gram")).distinct())))
    each = rows.select("_row", F.inline(F.arrays_zip(F.col("_grams").alias("gram"), F.col("_times").alias("times")))).toDF("_row", "gram", "times").join(small_side(logs, 100_000), "gram")
    sums = each.groupBy("_row").agg(F.array(*(F.sum(F.col("times") * F.round(F.col("logs")[k] * FIXED).cast("long")) for k in range(len(model.langs)))).alias("_joined"))
    bits = F.zip_with("_held", F.coalesce("_joined", F.array_repeat(F.lit(0).cast("long"), len(model.langs))), lambda a, b: -(a + b / FIXED) / F.greatest(F.col("n"), F.lit(1)))
    return rows.join(sums, "_row", "left").select(*columns, "n", "letters", bits.alias("bits"))


def _pieces(docs: DataFrame) -> DataFrame:
    """lang, length and text of PIECES pieces of each length in each of docs (text, lang), spread evenly; bounded like docs."""
    cuts = [F.struct(F.lit(n).alias("length"), F.substring(F.col("text"), (F.greatest(F.length("text") - n, F.lit(0)) * F.lit(j / max(1, PIECES - 1)) + 1).cast("int"), F.lit(n)).alias("text")) for n in LENGTHS for j in range(PIECES)]
    return docs.select("lang", F.inline(F.array(*cuts)))


def _calibrated(model: LanguageModel, docs: DataFrame) -> LanguageModel:
    """model with temperature and limits from docs (text, lang), at most PER_LANGUAGE a language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _texts(batch, 2):
                bits, n, _ = model.entropies(texts)
                cut = pa.array(np.arange(len(texts) + 1) * len(model.langs), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), batch.column(1).slice(row, len(texts)), pa.array(n), pa.ListArray.from_arrays(cut, pa.array(bits.ravel()))], names=["lang", "length", "n", "bits"])

    if model.spread:
        rows = _joined_entropies(model, _pieces(docs)).select("lang", "length", "n", "bits")
    else:
        rows = _pieces(docs).mapInArrow(tx.freed(work), "lang string, length int, n long, bits array<double>")
    rows = rows.filter("n > 1").toArrow()
    known = [k for k, x in enumerate(rows["lang"].to_pylist()) if x in model.langs]
    if not known:
        return model
    rows = rows.take(known)
    own, n = np.array([model.langs.index(x) for x in rows["lang"].to_pylist()]), rows["n"].to_numpy()
    bits, length = np.array(rows["bits"].to_pylist()), rows["length"].to_numpy()
    least = None
    for t in np.geomspace(0.1, 10, 41):
        model.temperature = float(t)
        loss = -np.log(np.maximum(model.chances(bits, n)[np.arange(len(own)), own], 1e-12)).mean()
        if least is None or loss < least[0]:
            least = (loss, float(t))
    model.temperature = least[1]
    for k in range(len(model.langs)):
        for j, size in enumerate(LENGTHS):
            if len(found := bits[(own == k) & (length == size), k]):
                model.limits[k, j] = np.quantile(found, 1 - REJECTED_SHARE)
    return model


def train(docs: DataFrame) -> LanguageModel | None:
    """The languages of docs (doc_id, text, lang) outside the held-out fold; None if it has none. Rows without lang, text or
    doc_id are not learned from, nor is a language whose few documents all fall into the calibrating part."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), PARTS) != HELD_OUT))
    order = F.xxhash64(F.lit("calibrate"), "doc_id")
    apart = F.pmod(order, F.lit(CALIBRATE)) == 0
    counts = gram_counts(known.filter(~apart))
    if counts.limit(MOST_GRAMS + 1).count() > MOST_GRAMS:
        model = _large_model(counts)
    else:
        rows = discounted(counts).toArrow()  # MOST_GRAMS rows at most
        if not len(rows):
            return None
        model = _model(rows)
    return _calibrated(model, written(_calibration_sample(known.filter(apart & (F.octet_length("text") <= MOST_BYTES)))))


def _calibration_sample(docs: DataFrame) -> DataFrame:
    """lang and text of the PER_LANGUAGE documents of lowest hash in each language; of a repeated doc_id its least text."""
    few, last = docs.select("lang", "doc_id").distinct().withColumn("luck", F.xxhash64(F.lit("calibrate"), "doc_id")), [F.col("luck"), F.col("doc_id")]
    for groups in (["lang", F.pmod(F.xxhash64(F.lit("deal"), "doc_id"), F.lit(64))], ["lang"]):  # dealt out first: one language may have most rows
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*last))).filter(F.col("rank") <= PER_LANGUAGE)
    few = written(few.select("lang", "doc_id"))
    return docs.join(small_side(few, 1_000_000), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def _decided(model: LanguageModel, bits: np.ndarray, n: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
    """lang_pred, score, bits and rejected from the entropies of texts."""
    best = bits.argmin(axis=1)
    at = np.arange(len(bits)), best
    score, out = np.where(letters, model.chances(bits, n)[at], 0.0), model.rejected(bits, n, best) & letters
    lang = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return [pa.array(lang, pa.string()), pa.array(score), pa.array(bits[at], mask=~letters), pa.array(out)]


def _judged(model: LanguageModel):
    """Predictions from the joined entropies (doc_id, n, letters, bits)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(model.langs))
                found = _decided(model, bits, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    return work


def _scored(model: LanguageModel | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _texts(batch, 1):
                if model:
                    found = _decided(model, *model.entropies(texts))
                else:
                    found = [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts))), pa.nulls(len(texts), pa.float64()), pa.array(np.zeros(len(texts), bool))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), *found], names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    return work


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """One row per document: doc_id, lang_pred (a language of the model, `und` where the text is null or has no letter), score
    (the calibrated probability of that language, 0 for `und`), bits (its cross-entropy a character; null for `und`) and
    rejected (true if bits exceed what the language's own texts of that length reach: likely none of the model's languages).

    Texts are read whole, lower-cased; letters and marks of any script count. Equal entropies go to the first language by
    code point. Rows are scored one by one, repeats and null ids alike; a text costs a task some 100 bytes a character.
    Without a model (nothing to learn from) all rows are `und`. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, lang_pred string, score double, bits double, rejected boolean"
    if model and model.spread:
        return _joined_entropies(model, rows).mapInArrow(tx.freed(_judged(model.light())), schema)
    return rows.mapInArrow(tx.freed(_scored(model)), schema)


def language_predictions(docs: DataFrame) -> DataFrame:
    """identify() by a model of docs themselves (outside the held-out fold), with held_out: a null doc_id is in no fold."""
    return identify(docs, train(docs)).select("doc_id", F.coalesce(fold(F.col("doc_id"), PARTS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits", "rejected")
