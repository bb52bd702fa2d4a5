"""Every pipeline stage against brute force on its own input, and run() against the stages one by one."""

import collections

import corpus_pipeline as cp
from ledgerlake.llm import mixing, sharding, toxicity
from ledgerlake.llm.common import read_table, written

from .test_brute_force import words


def _rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages_by_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    into, out = {}, {}
    for name, stage in cp.STAGES:
        into[name] = docs
        out[name] = docs = written(stage(spark, docs, sf_dir))

    scores = toxicity.toxicity_scores(into["toxicity"], read_table(spark, sf_dir, "labels"))
    rejected = {r["doc_id"] for r in scores.collect() if r["predicted"]}
    assert {r["doc_id"] for r in out["toxicity"].collect()} == {r["doc_id"] for r in into["toxicity"].collect()} - rejected

    sets = {}
    for r in into["near_duplicates"].collect():
        w = words(r["text"])
        sets[r["doc_id"]] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert {r["doc_id"] for r in out["near_duplicates"].collect()} == {d for d in sets if group[d] == d}

    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    bench = [five(words(r["text"])) for r in read_table(spark, sf_dir, "benchmark").collect()]
    leaked = {r["doc_id"] for r in into["decontamination"].collect() if any(len(g & five(words(r["text"]))) > 0.5 * len(g) for g in bench)}
    assert {r["doc_id"] for r in out["decontamination"].collect()} == {r["doc_id"] for r in into["decontamination"].collect()} - leaked

    copies = {r["row"]["doc_id"]: r["copies"] for r in mixing.mix(into["mixing"]).collect()}
    assert _rows(out["mixing"]) == collections.Counter({tuple(r): copies[r["doc_id"]] for r in into["mixing"].collect() if copies[r["doc_id"]]})

    placed = out["sharding"].collect()
    law = {r["doc_id"]: r["shard"] for r in sharding.shard_table(into["sharding"]).collect()}
    assert len(placed) == into["sharding"].count() and all(r["shard"] == law[r["doc_id"]] for r in placed)
    for s in {r["shard"] for r in placed}:
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sum(r["shard"] == s for r in placed)))

    key = ["doc_id", "text", "shard"]
    assert _rows(cp.run(spark, sf_dir).select(key)) == _rows(out["sharding"].select(key))
