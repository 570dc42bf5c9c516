"""Each operator against brute force, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from sievework.llm import bitpack, chat, components, embeddings, html, jaccard, licenses, mixing, packing, passages, quality, queries, shingles, tokens
from sievework.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, __size string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with what no operator may stumble over."""
    long = prose(1, 6000)
    texts = [None, "", "  \n\t ", "one", prose(2, 80), prose(2, 80), prose(2, 79) + " changed", long, long + " end", "a a a a a a a a a a a a", prose(3, 60), prose(3, 60)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    rows += [(None, prose(4, 70), None, None, 1, None, None), rows[4], (4, prose(5, 70), "en", "s0", 3, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    same(queries.queries()[name](spark, data), connect(data), queries.oracle_sql()[name])


def test_quality_edges(spark, odd, empty):
    got = quality.quality_rules(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.n_words for r in got if r.doc_id in (0, 1, 2, 3)} == {0: 0, 1: 0, 2: 0, 3: 1}
    assert next(r for r in got if r.doc_id == 9).n_repeat_words == 12
    assert quality.quality_rules(empty).count() == 0 and quality.keep_clean(empty).columns == empty.columns
    assert quality.keep_clean(odd).count() == sum(r.kept for r in got)


def test_sketches_merge(spark, data):
    m = quality.with_metrics(table(spark, data, "documents").select("doc_id", "text", "lang", "source"))
    a, b = quality.sketches(m.where("doc_id % 2 = 0")), quality.sketches(m.where("doc_id % 2 = 1"))
    both = quality.merge(a.unionByName(b), "lang", "source")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, quality.merge(quality.sketches(m), "lang", "source").collect()))


def test_limits_are_the_groups_own_quantiles(spark, data):
    m = quality.with_metrics(table(spark, data, "documents").select("doc_id", "text", "lang", "source"))
    values = m.where("not __base_failed").select("lang", "source", *[v.alias(k) for k, v in quality._values().items()]).collect()
    got = {(r["__lang"], r["__source"]): r.asDict() for r in quality.limits(quality.sketches(m), prior=0).collect()}
    floor = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    by = defaultdict(list)
    for r in values:
        by[r.lang, r.source].append(r)
    for g, rows in by.items():
        for k, (tail, spread, two_sided) in quality.METRICS.items():
            v = sorted(floor(r[k]) for r in rows)
            at = lambda q: v[max(0, -(-q * len(v) // 100) - 1)]  # noqa: B023, E731
            assert got[g][f"__hi_{k}"] == at(tail) + spread * (at(tail) - at(50))
            if two_sided:
                assert got[g][f"__lo_{k}"] == at(100 - tail) - spread * (at(50) - at(100 - tail))
    assert all(len({r[f"__hi_{k}"] for r in got.values()}) > 3 for k in ("repeats", "word_len", "length"))


def test_limits_change_smoothly_with_size(spark, data):
    """Every source's limits lie between its own quantiles and those of coarser levels; no size has a switch."""
    m = quality.with_metrics(table(spark, data, "documents").select("doc_id", "text", "lang", "source"))
    s = quality.sketches(m)
    weighed, own, lang = ({(r["__lang"], r["__source"]): r.asDict() for r in quality.limits(s, prior=n).collect()} for n in (100, 0, 10**9))
    assert weighed.keys() == own.keys() and len({g for g in weighed if weighed[g] != lang[g]}) > len(weighed) / 2

def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|user x|>"), (1, 2, "bob", None), (1, 300, "ann", "late"), (None, 0, None, "lost"), (2, 0, "system", "alone"), (1, 1, "ann", "hi <|user x|>")]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, speaker string, no long")
    got = chat.render(df).collect()
    assert {(r.conv_id, r.speaker, r.part) for r in got} == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0)}
    for r in got:
        for s in r.spans:
            assert r.text[s.start : s.end] in ("hi <\\|user x|>", "", "late", "lost")
    assert {r.speaker: r.mask for r in got if r.conv_id} == {"ann": "01101", "bob": "00010"}
    assert chat.render(df.limit(0)).count() == 0


def test_chat_in_parts(spark):
    """A long dialogue, one of repeated null turns and a very long text: parts in order are the whole rendering of each speaker."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["a", "b", "system"]), f"t{i}") for i in range(95)] + [(2, None, "a", "same")] * 40 + [(None, 1, "c", "x" * 2_000_000), (3, 0, "d", "one"), (3, 1, "e", "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = defaultdict(list)
    for r in sorted(chat.render(df, part_turns=16).collect(), key=lambda r: r.part):
        got[r.conv_id, r.speaker].append(r)
        assert r.n_turns == len(r.mask) <= 16
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (None, "c"), (3, "d"), (3, "e")}
    for (conv, speaker), parts in got.items():
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[2], r[3]))
        head = lambda r: "<|assistant|>" if r[2] == speaker else "<|system|>" if r[2] == "system" else f"<|user {r[2]}|>"  # noqa: B023, E731
        assert "".join(p.text for p in parts) == "".join(f"{head(r)}\n{r[3]}\n" for r in own)
        assert "".join(p.mask for p in parts) == "".join(str(int(r[2] == speaker)) for r in own)
        assert [p.text[s.start : s.end] for p in parts for s in p.spans] == [r[3] for r in own if r[2] == speaker]


def test_mixing_ties(spark):
    rows = [(1, "a b c d", "en", "s", k) for k in range(6)] + [(2, "e f g", "en", "r", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mark long")
    runs = {tuple(sorted(map(tuple, mixing.mixed(df.repartition(n), weights=(5, 1)).collect()))) for n in (1, 3, 4)}
    assert len(runs) == 1


def test_mixing(spark, data, odd, empty):
    rows = mixing.mix(table(spark, data, "documents")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for (_, target), rs in by.items():
        assert sum(r.taken for r in rs) == int(target)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(odd).collect())


def test_mixing_targets(spark):
    sizes = [("a", 100), ("b", 10), ("c", 50), ("d", 1), (None, 400)]
    df = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()
    got = {r["__skey"]: r["target"] for r in df}
    want, weights = {}, dict(zip(["sa", "sb", "sc", "sd", "n"], [1, 2, 3, 1, 2]))
    caps = {("s" + s if s else "n"): 3 * n for s, n in sizes}
    left, open_ = 561.0, dict(weights)
    while True:  # share by weight, stop those above their cap, share the rest again
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k in open_ if share[k] > caps[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = float(caps[k])
            left -= caps[k]
            del open_[k]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_equal_the_tokenizer(spark, data, name):
    enc = tokens.Encoder(tokens.public(name))
    texts = [r.text for r in table(spark, data, "documents").select("text").limit(150).collect()]
    texts += ["a\n\nb \n c  d\t e f don't I'LL  \n", "", "  ", " x", "x \n", "　a b", "<|endoftext|> hi", "a\x1cb", "é, ö.", "Hello, WORLD! ÀÉ. it's x' 's", "ß,ÿ! ſ İ.", "a_b c-d e/f (g) \"h\" i;j", " ,", "x" * 300 + " y", None]
    for text, got in zip(texts, enc.encode_many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bit_packing(spark, data, odd, empty):
    rng = np.random.default_rng(3)
    for bits in (1, 7, 13, 16, 17):
        ids = rng.integers(0, 1 << bits, 1001).astype("<u4")
        assert (bitpack.unpack(bitpack.pack(ids, bits), len(ids), bits) == ids).all()
    tok = tokens.Encoder(tokens.public("word_bpe_49k.json"))
    docs = table(spark, data, "documents")
    rows = sorted(bitpack.op4_bit_packing(spark, data).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = tok.encode(d.text) + np.array([1], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    from sievework.llm.common import scratch

    for df in (odd, empty):
        folder = scratch(spark, "test")
        man = bitpack.write_shards(df, folder, tokens.public("word_bpe_49k.json"), shard_bytes=5_000)
        got = bitpack.read_documents(man, folder).orderBy("start").collect()
        assert len(got) == df.count() and [g.start for g in got] == [0, *np.cumsum([len(g.ids) // 4 for g in got]).tolist()][: len(got)]
        assert [g.doc_id for g in got] == sorted((g.doc_id for g in got), key=lambda x: (x is not None, x))


def test_random_access(tmp_path):
    path = tmp_path / "a.swbp"
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (3, 0, 5000, 1, 9000)]
    with path.open("wb") as f:
        w = bitpack.ShardWriter(f, 17, 64)
        for i, d in enumerate(docs):
            w.add(None if i == 1 else i, d)
        w.close()
    with path.open("rb") as f:
        s = bitpack.Shard(f)
        assert all((s.document(i) == d).all() and len(s.document(i)) == len(d) for i, d in enumerate(docs))


def test_packing(spark, data, odd, empty):
    tok = tokens.Encoder(tokens.public(packing.TOKENIZER))
    rows = packing.op5_packing(spark, data).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    for d in table(spark, data, "documents").collect():
        ids = tok.encode(d.text) + np.array([1], "<u4").tobytes()
        got = sorted(by[d.doc_id], key=lambda r: r.start)
        assert sum(r.length for r in got) == len(ids) // 4 == got[0].doc_tokens
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in got)
    assert packing.pack(empty, tokens.public(packing.TOKENIZER)).count() == 0
    odd_rows = packing.pack(odd, tokens.public(packing.TOKENIZER)).collect()
    assert sum(r.length for r in odd_rows) == sum(len(tok.encode(r.text)) // 4 + 1 for r in odd.collect())


def jaccard_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    return links


def test_jaccard(spark, data, odd, empty):
    for df in (table(spark, data, "documents"), odd):
        texts = df.select("doc_id", "text").collect()
        links = jaccard_links([r.text for r in texts])
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in jaccard.jaccard_join(df).collect())
        assert got == sorted((-1 if r.doc_id is None else r.doc_id, len(links[i])) for i, r in enumerate(texts))
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    links = jaccard_links([r.text for r in kept.collect()])
    assert not any(links.values()) and kept.where("text is null").count() == 1
    assert jaccard.jaccard_join(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_jaccard_recall_at_the_threshold(spark):
    """Pairs whose similarity lies between 0.8 and 0.83: measured recall, and none below."""
    rng = random.Random(31)
    texts = []
    for k in range(400):
        w = prose(5000 + k, 120).split()
        v = list(w)
        for at in rng.sample(range(4), 2):
            v[12 + 30 * at] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(w), " ".join(v[: 120 - rng.choice((0, 1, 2))])]
    links = jaccard_links(texts[:80])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.n_links for r in jaccard.jaccard_join(df).orderBy("doc_id").collect()]
    assert got[:80] == [len(links[i]) for i in range(80)] or sum(got[:80]) >= 0.95 * sum(map(len, links.values()))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = [int(len(sets[i] & sets[i ^ 1]) / len(sets[i] | sets[i ^ 1]) >= 0.8) for i in range(800)]
    assert sum(want) > 300 and all(g <= w for g, w in zip(got, want, strict=True)) and sum(got) >= 0.99 * sum(want)


def test_jaccard_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    w = prose(61, 150).split()
    texts = [" ".join([*w[:75], f"n{i}", *w[76:]]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.jaccard_join(df).collect()
    assert [r.n_links for r in got] == [59] * 60 and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_jaccard_matrix_equals_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(200) > 0.06], rng.integers(0, 1 << 60, 5).astype(np.uint64)]) for _ in range(60)]
    i, j = np.nonzero(np.tri(60, k=-1, dtype=bool))
    whole = jaccard.verified(sets, i, j)
    assert 0 < whole.sum() < len(i)
    assert (whole == np.concatenate([jaccard.verified(sets, i[k : k + 1], j[k : k + 1]) for k in range(len(i))])).all()


def test_passages(spark, odd, empty):
    shared = prose(77, 60)
    w = shared.split()
    fuzzy = " ".join(w[:20] + ["new"] + w[21:40] + w[42:])
    rows = [(i, f"{prose(100 + i, 90)} {shared} {prose(200 + i, 40)}") for i in range(12)] + [(50, f"{prose(300, 30)} {fuzzy} {prose(301, 70)}"), (60, prose(400, 300)), (61, prose(401, 49)), (62, prose(401, 49)), (63, prose(402, 55)), (64, prose(402, 55))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    found = {r.doc_id for r in got} | {r.match_doc_id for r in got}
    assert found == {*range(12), 50, 63, 64}
    assert all(r.n_words >= 50 for r in got)
    left = passages.remove_repeats(df).collect()
    assert sum(shared in r.text for r in left) == 1 and len(left) == len(rows) - 1
    assert {r.doc_id: r.text for r in left}[60] == prose(400, 300)
    assert passages.remove_repeats(odd).columns == odd.columns and passages.repeated_passages(empty).count() == 0 and passages.remove_repeats(empty).count() == 0
    assert passages.remove_repeats(odd).where("text is null").count() == 1


def test_chains_take_the_best_order():
    own, other = np.array([0, 10, 20, 30, 15]), np.array([100, 110, 120, 130, 5])
    best = passages.chains(own, other)
    assert sorted(map(list, best), key=len)[-1] == [0, 1, 2, 3]
    assert passages.without("a  b c\nd", [(1, 3)]) == "a  \nd"


def test_stretches_with_an_edit_towards_one_end():
    laid = lambda *parts: [(at, at, n) for at, n in parts]
    assert passages.similar_stretches(laid((0, 46), (48, 6))) == [(0, 54, 0, 54, 52)]
    assert passages.similar_stretches(laid((0, 15), (19, 49))) == [(0, 68, 0, 68, 64)]
    assert passages.similar_stretches(laid((0, 49))) == [] == passages.similar_stretches([]) and passages.similar_stretches(laid((0, 30), (45, 30))) == [(0, 75, 0, 75, 60)]
    rng = random.Random(8)
    for _ in range(300):
        blocks, i, j = [], 0, 0
        for _ in range(rng.randint(1, 9)):
            n = rng.randint(1, 40)
            blocks.append((i, j, n))
            i, j = i + n + rng.randint(0, 12), j + n + rng.randint(0, 12)
        fits = []
        for s in range(len(blocks)):
            for e in range(s, len(blocks)):
                equal = sum(b[2] for b in blocks[s : e + 1])
                edited = sum(max(b[c] - a[c] - a[2] for c in (0, 1)) for a, b in zip(blocks[s:e], blocks[s + 1 : e + 1]))
                size = min(blocks[e][c] + blocks[e][2] - blocks[s][c] for c in (0, 1))
                if size >= 50 and 10 * equal >= 8 * (equal + edited):
                    fits.append((blocks[s][0], blocks[e][0] + blocks[e][2], size))
        got = passages.similar_stretches(blocks)
        assert bool(got) == bool(fits) and all(any(a < f and s < b for a, b, *_ in got) for s, f, _ in fits)
        assert {g[:2] for g in got} <= {f[:2] for f in fits}
        assert not fits or min(got[0][1] - got[0][0], got[0][3] - got[0][2]) == max(f[2] for f in fits)


def test_passages_whose_parts_stand_elsewhere(spark):
    shared = prose(78, 60)
    w = shared.split()
    parts = [" ".join(w[:30]), " ".join(w[30:])]
    texts = [f"{prose(500 + i, 80)} {x} {prose(600 + i, 80)}" for i, x in enumerate([shared] * 4 + [parts[i % 2] for i in range(40)])]
    texts += [f"{parts[0]} {prose(700 + i, 200)} {parts[1]}" for i in range(20)]  # both parts, far from each other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tids = [r.t for r in df.orderBy("doc_id").select(F.xxhash64("text").alias("t")).collect()]
    assert min(tids[:4]) > min(tids[4:44:2]) and min(tids[:4]) > min(tids[5:44:2])  # parts are the heads of all seeds of one side
    got = passages.repeated_passages(df).collect()
    top = min(range(4), key=lambda i: tids[i])
    assert {r.doc_id for r in got if r.match_doc_id == top} == {0, 1, 2, 3} - {top} and {r.doc_id for r in got} | {r.match_doc_id for r in got} == {0, 1, 2, 3}
    assert all(r.n_words == r.equal_words == 60 and (r.start, r.match_start) == (80, 80) for r in got)
    assert sum(shared in r.text for r in passages.remove_repeats(df).collect()) == 1


def test_passages_of_copies_with_null_ids(spark):
    t = prose(801, 60)
    df = spark.createDataFrame([(5, t), (None, t), (None, t), (6, prose(802, 70)), (6, prose(802, 70))], "doc_id long, text string")
    got = [(r.doc_id, r.match_doc_id, r.n_words) for r in passages.repeated_passages(df).collect()]
    assert got == [(None, 5, 60)]
    assert sorted(r.doc_id for r in passages.remove_repeats(df).collect()) == [5, 6, 6]


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                longest[i + 1][j + 1] = max(longest[i][j + 1], longest[i + 1][j], longest[i][j] + (a[i] == b[j]))
        got = passages.common(a, b)
        assert len(got) == longest[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))


def test_passages_recall_by_similarity(spark):
    """Edited passages of 60 words and more, beside a brute-force alignment: those with 80 % equal words and more are found, others not."""
    rng = random.Random(71)
    rows, whole = [], []
    for k in range(240):
        rate, n = (0.05, 0.1, 0.14, 0.17)[k % 4], (60, 80, 120)[k % 3]
        p = prose(9000 + k, n).split()
        q = [x for w in p for x in ([w] if rng.random() >= rate else [[f"q{rng.randrange(10**6)}"], [], [w, f"q{rng.randrange(10**6)}"]][rng.choice((0, 0, 0, 1, 2))])]
        pairs, last, edited = passages.common(p, q), (-1, -1), 0
        for at in [*pairs, (len(p), len(q))]:
            edited += max(at[0] - last[0] - 1, at[1] - last[1] - 1)
            last = at
        whole.append(len(pairs) >= 0.8 * (len(pairs) + edited) and min(len(p), len(q)) >= 55)
        rows += [(2 * k, f"{prose(20_000 + k, 90)} {' '.join(p)} {prose(30_000 + k, 60)}"), (2 * k + 1, f"{prose(40_000 + k, 70)} {' '.join(q)} {prose(50_000 + k, 90)}")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {min(r.doc_id, r.match_doc_id) // 2 for r in got if r.doc_id ^ 1 == r.match_doc_id}
    assert all(r.doc_id ^ 1 == r.match_doc_id and r.equal_words >= 0.6 * r.n_words for r in got)
    wanted = {k for k, w in enumerate(whole) if w}
    assert len(wanted) > 150 and len(found & wanted) >= 0.95 * len(wanted)


def test_passages_against_brute_force(spark):
    """All pairs of a small corpus aligned by dynamic programming: texts with a shared passage, and no others."""
    rng = random.Random(72)
    shared = [prose(700 + i, 55).split() for i in range(4)]
    texts = []
    for i in range(40):
        parts = [prose(60_000 + i, rng.randint(20, 60)).split()]
        for s in rng.sample(shared, rng.choice((0, 0, 1, 2))):
            cut = s if rng.random() < 0.7 else s[: rng.randint(10, 40)]
            parts += [cut, prose(61_000 + 100 * i + len(parts), rng.randint(15, 40)).split()]
        texts.append([w for p in parts for w in p])
    linked = set()
    for i in range(40):
        for j in range(i):
            run = 0
            for shift in range(-len(texts[j]), len(texts[i])):
                run = 0
                for x in range(max(0, shift), min(len(texts[i]), len(texts[j]) + shift)):
                    run = run + 1 if texts[i][x] == texts[j][x - shift] else 0
                    if run == 50:
                        linked |= {i, j}
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} | {r.match_doc_id for r in got} == linked and len(linked) > 5


def test_embeddings(spark, data, empty):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base, base[:10] + 0.12 * rng.standard_normal((10, 16)), base[:5], 3 * base[5:8]])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, []), (104, [1.0, None]), (None, [float(x) for x in base[20]]), (105, [1.0, 0.0]), (105, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1))
    u = np.array([r[1] for r in rows[: len(v)]], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    want = near.sum(axis=1)
    want[20] += 1
    assert [got[i].n_links for i in range(len(v))] == want.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103, 104)) and got[105].n_links == 1
    assert all(got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i in range(len(v)))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def components_of(near):
    root = list(range(len(near)))
    while True:
        low = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(near))]
        if low == root:
            return root
        root = low


def test_embeddings_table_against_all_pairs(spark, data):
    rows = table(spark, data, "embeddings").orderBy("vec_id").collect()
    u = np.array([r.embedding for r in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = embeddings.op7_embedding_near_dedup(spark, data).orderBy("vec_id").collect()
    found, want = np.array([r.n_links for r in got]), near.sum(axis=1)
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    if (found == want).all():
        assert [r.component_id for r in got] == components_of(near) and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings_at_the_threshold(spark):
    """Pairs and chains of known cosines just below, at and above 0.9: recall of the tables, nothing below, components by brute force."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((300, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((300, 24))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = np.where(np.arange(300) % 3 == 0, 0.8999, np.where(np.arange(300) % 3 == 1, 0.9001, 0.93))[:, None]
    v = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side])
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(7)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    found, want = np.array([got[i].n_links for i in range(600)]), near.sum(axis=1)
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    own = components_of(near & (found > 0)[:, None] & (found > 0)[None, :])
    assert [got[i].component_id for i in range(600)] == own
    # one signature table a bucket of any size: many equal directions in small blocks
    crowd = np.repeat(base[:2], 40, axis=0) + 0.01 * rng.standard_normal((80, 24))
    small = spark.createDataFrame([(f"{i:016d}".encode(), 1, x.tolist()) for i, x in enumerate(crowd)], "cls binary, n long, v array<double>")
    counted, edges = embeddings.links(small, block=16)
    assert [r.n_links for r in counted.collect()] == [39] * 80 and edges.count() > 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><header>top</header><div class="cookie-notice">ok?</div>
    <article><h1>Head &amp; more</h1><p>One <b>bold</b>\n word.<br>Two<p>Three &lt;x&gt;<div class="ad">buy</div><form>f</form><script>var t="</p>";</script><section class="comments"><p>hey</p></section></article><aside>side</aside><footer>foot</footer>"""
    assert html.main_text(page) == "Head & more\nOne bold word.\nTwo\nThree <x>"
    assert html.main_text(None) == "" == html.main_text("") and html.main_text("plain  text") == "plain text"
    assert html.main_text("<div><p>a<p>b") == "a\nb"


def test_html_broken_markup():
    text = html.main_text
    for raw in ('<svg width="1"/>', "<noscript>", '<script src="x"/>', "<iframe>"):
        assert text(f"<article><p>before</p>{raw}<p>after the icon</p></article>") == "before\nafter the icon"
    assert text('<article class="post no-sidebar"><p>kept</p></article>') == text('<div class="share-price"><article><p>kept</p></article></div>') == "kept"
    assert text('<p class="x>broken</p><p class="y">more</p>') == "broken\nmore" and text("<p title='it>quoted</p>") == "quoted"
    assert text('<p data-x="<b>1</b>">a > b</p><p>cut <i') == "a > b\ncut"
    assert text("<html><head><title>t</title><p>no body tag</p>") == "no body tag" == text("<head><meta a=b><body><p>no body tag")
    assert text("<article><p>a<a href=x>linked<p>b</article>") == "alinked\nb"
    long = "<p class='" * 20_000 + "<article><p>" + "word " * 200_000
    assert len(text(long)) > 900_000


def test_html_templates(spark):
    rows = [(i, "http://h.example/x", f"<html><body><div>Site name</div><div>All pages say so</div><div><p>{prose(i, 20)}</p></div></body></html>") for i in range(5)] + [(9, None, None), (10, "bad url", "<p>x"), (9, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert all(got[i].text == prose(i, 20) and got[i].n_chars == len(prose(i, 20)) for i in range(5))
    assert got[9].text == "" and got[10].text == "x" and html.extract(df).count() == 8 and html.extract(df.limit(0)).count() == 0


def test_html_template_decides(spark):
    """Template text inside articles, an article without an article tag, teasers with one, and copies of one article."""
    bio = "<section class='about-me'><p>Ann writes here</p><p>Follow Ann every day</p></section>"
    inside = [f"<body><article><h1>{prose(i, 4)}</h1><p>{prose(50 + i, 60)}</p>{bio}<p>{prose(90 + i, 30)}</p></article></body>" for i in range(6)]
    soup = [f"<body><div class=top><a href=/>Home</a></div><div class=x1><p>{prose(200 + i, 9)}</p></div><div class=x2><h2>{prose(300 + i, 3)}</h2><div><p>{prose(400 + i, 70)}</p></div></div><div class=x3><article><p>{prose(500 + i, 6)}</p></article></div></body>" for i in range(4)]
    copies = [f"<body><div>{i}</div><article><p>{prose(600, 50)}</p><p>{prose(601, 50)}</p></article></body>" for i in range(4)]
    rows = [(f"http://{h}.example/{i}", p) for h, pages in (("inside", inside), ("soup", soup), ("copies", copies)) for i, p in enumerate(pages)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = [r.text for r in html.extract(df).orderBy("page_id").collect()]
    assert got[:6] == ["\n".join([prose(i, 4), prose(50 + i, 60), prose(90 + i, 30)]) for i in range(6)]
    assert got[6:10] == ["\n".join([prose(300 + i, 3), prose(400 + i, 70)]) for i in range(4)]
    assert got[10:] == ["\n".join([prose(600, 50), prose(601, 50)])] * 4
    assert all(html.main_text(p) == p.replace(bio, "").replace("<p>", "").replace("</p>", "\n").replace("</h1>", "\n")[len("<body><article><h1>") : -len("\n</article></body>")] for p in [x.replace(bio, "") for x in inside])


def test_html_keeps_what_articles_share(spark):
    """Shared headings, notes and sub-titles of articles stand, whatever the number of pages; a box of template alone goes."""
    body = lambda i: f"<h1>Head</h1><p>{prose(700 + i, 40)}</p><h2>Details</h2><p>All prices in euro.</p><p>{prose(720 + i, 40)}</p><p>Another shared line of the article.</p>"
    bio = "<div class=who><p>Ann writes here</p><ul><li>more of Ann</li></ul></div>"
    rows = [(f"http://n{n}.example/{i}", f"<body><div class=nav2><a href=/>Home</a></div><article>{body(i)}{bio if n > 2 else ''}</article><div class=foot2>Imprint</div></body>") for n in (1, 2, 3, 5) for i in range(n)]
    rows += [(f"http://math.example/{i}", f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>{i}</mn><annotation>x</annotation></math> be so.</p><div class='search'>{prose(740 + i, 30)}</div></article>") for i in range(4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = [r.text for r in html.extract(df).orderBy("page_id").collect()]
    want = ["\n".join(["Head", prose(700 + i, 40), "Details", "All prices in euro.", prose(720 + i, 40), "Another shared line of the article."]) for n in (1, 2, 3, 5) for i in range(n)]
    assert got[:11] == want
    assert got[11:] == [f"Let x={i} be so.\n{prose(740 + i, 30)}" for i in range(4)]


def test_pages_against_plain_reading(spark, data):
    """The query's rows against the articles read by plain patterns."""
    got = {r.page_id: r for r in html.op8_html_extraction(spark, data).collect()}
    pages = table(spark, data, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        body = re.sub(r"<br>|</?p>|</?h1>", "\n", re.sub(r"</?b>", "", body))
        lines = [" ".join(html.entities.unescape(x).split()) for x in body.split("\n")]
        text = "\n".join(x for x in lines if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_licenses(spark, odd, empty):
    model = licenses._model(())
    assert model.gate_accuracy > 0.93 and model.kind_accuracy > 0.75  # on notices, names and families that the fitted models had not seen
    filler = prose(8, 200)
    rows = [(1, f"{prose(6, 40)}\nReleased under the MIT License.\n{prose(7, 40)}"), (2, filler), (3, "Licensed under CC BY-NC 4.0."), (4, f"{filler} Licensed under the Apache License, Version 2.0. {filler}"), (5, "Distributed under the Frobnitz Reciprocal Source Covenant"), (6, None), (7, ""), (8, "dual-licensed under the MIT License and the Apache License"), (9, "License: GPLv3"), (10, "MIT License"), (11, "Licensed under the GNU Lesser General Public License, version 2.1"), (None, "All rights reserved."), (12, "Published under the European Union Public Licence")]
    got = sorted((r.doc_id or 0, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), sample_lines=0).collect())
    assert got == [(0, "proprietary"), (1, "MIT"), (3, "CC-BY-NC"), (4, "Apache-2.0"), (5, "unknown"), (8, "Apache-2.0"), (8, "MIT"), (9, "GPL"), (10, "MIT"), (11, "LGPL"), (12, "unknown")]
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == 0


def test_licenses_on_the_corpus(spark, data):
    """Each line with a licence's words gives its family, and next to no other line gives anything."""
    said = {"MIT": "MIT License", "Apache-2.0": "Apache License", "CC-BY-NC": "CC BY-NC", "GPL": "GNU General Public License", "proprietary": "All rights reserved"}
    docs = table(spark, data, "documents").collect()
    want = {(r.doc_id, k, f) for r in docs for k, line in enumerate((r.text or "").split("\n"), 1) for f, x in said.items() if x in line}
    got = {(r.doc_id, r.line, r.family) for r in licenses.op10_license_scan(spark, data).collect()}
    assert want and want <= got and len(got - want) <= 0.01 * len(docs)


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b a", None, "", " x\ty\n", "a", "é a"] + [prose(3, 2000)] * 3
    got = {k: h for k, h in shingles.word_hashes(pa.array(texts)[1:]) for k in [k + 1]}
    assert all(len(got[i]) == len(WORD.findall(t or "")) for i, t in enumerate(texts) if i)
    assert got[4][0] == got[5][1] != got[5][0]
    assert len(Counter(got[6].tolist())) == len(set(texts[6].split()))


def test_codes_against_each_pair():
    """The rows that codes leave are those with a pair near enough that no earlier table holds, in buckets of any size."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, (6, 4), np.uint64)[rng.integers(0, 6, 400)] ^ (np.uint64(1) << rng.integers(0, 64, (400, 4), np.uint64))
    at = np.r_[0, np.cumsum([1, 2, 5, 30, 150, 1, 200, 11])]
    t = np.repeat([0, 3, 1, 7, 2, 0, 30, 5], np.diff(at))
    crossed, mine = np.repeat([False, False, True, True, False, False, True, False], np.diff(at)), rng.integers(0, 2, 400)
    got = embeddings.suspects(at, t, crossed, mine, codes, 6, 20)
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little").reshape(400, -1)
    want = np.zeros(400, bool)
    for s, e in zip(at[:-1], at[1:], strict=True):
        for i in range(s, e):
            for j in range(s, i):
                before = any((bits[i, 20 * k : 20 * k + 20] == bits[j, 20 * k : 20 * k + 20]).all() for k in range(min(t[i], 12)))
                if (not crossed[i] or mine[i] != mine[j]) and (bits[i] != bits[j]).sum() <= 6 and not before:
                    want[i] = want[j] = True
    assert (got == want).all() and 0 < want.sum() < 400
    # signs don't depend on the rows beside a vector or on the number of planes
    units = rng.standard_normal((50, 24))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    assert (embeddings.signs(units, 512)[7:8, :64] == embeddings.signs(units[7:8], 64)).all()
