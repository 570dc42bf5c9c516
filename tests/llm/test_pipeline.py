"""run() against a plain version of every stage, each on what the stage before it kept."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from oracle import connect

import corpus_pipeline
from sievework.llm import mixing, packing, quality, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_groups(rows):
    sets = []
    for r in rows:
        w = WORD.findall(r.text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r.doc_id)
    return {min(g) for g in groups.values()}


def plain_mix(rows):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    target, left, open_ = {}, float(sum(sizes.values())), dict(weights)
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            del open_[s]
    out = Counter()
    for source, size in sizes.items():
        epochs, rest = divmod(int(target[source] + 1e-6), size)
        own = [r for r in rows if r.source == source]
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        for r in sorted(own, key=lambda r: md5(f"{mixing.SEED}|{r.doc_id}|{md5(r.text)}")):
            n = len(WORD.findall(r.text))
            out[r.doc_id] += epochs * n + min(n, max(0, rest))
            rest -= n
    return out


def test_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, con = docs.columns, connect(data)
    stages = dict(corpus_pipeline.STAGES)
    step = {}
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, data).cache()
        assert docs.columns == columns
        step[name] = docs.collect()
    assert {r.doc_id for r in step["quality_rules"]} == {x for (x,) in con.sql(f"SELECT doc_id FROM ({quality.oracle()}) WHERE kept").fetchall()}
    assert {r.doc_id for r in step["ngram_jaccard_join"]} == near_groups(step["quality_rules"])

    before, after = {r.doc_id: r.text for r in step["ngram_jaccard_join"]}, {r.doc_id: r.text for r in step["substring_dedup"]}
    windows = defaultdict(set)
    for i, text in before.items():
        w = WORD.findall(text)
        for k in range(len(w) - 49):
            windows[tuple(w[k : k + 50])].add(i)
    shared = {i for g in windows.values() if len(g) > 1 for i in g}
    left = defaultdict(set)
    for i, text in after.items():
        w = WORD.findall(text)
        for k in range(len(w) - 49):
            left[tuple(w[k : k + 50])].add(i)
    assert not any(len(g) > 1 for g in left.values())
    changed = {i for i in before if after.get(i) != before[i]}
    assert shared and any(i not in changed for i in shared)
    for i in changed:  # what goes was words of the text, in its order
        kept = iter(WORD.findall(before[i]))
        assert all(w in kept for w in WORD.findall(after.get(i, "")))

    taken = Counter()
    for r in step["mix_sources"]:
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert +taken == +plain_mix(step["substring_dedup"])

    enc = tokens.Encoder(tokens.public(packing.TOKENIZER))
    want = Counter()
    for r in step["mix_sources"]:
        ids = enc.encode(r.text) + np.array([1], "<u4").tobytes()
        n, at = len(ids) // 4, 0
        for length in [2048] * (n // 2048) + [1 << b for b in range(10, -1, -1) if n % 2048 >> b & 1]:
            want[r.doc_id, at, length, ids[4 * at : 4 * (at + length)]] += 1
            at += length
    packed = corpus_pipeline.run(spark, data).collect()
    assert Counter((r.doc_id, r.start, r.length, bytes(r.ids)) for r in packed) == want
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
