"""Search, phrases and mixing against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import collocations, lexical, mixing
from strandline.llm import quotient_filter as qf
from strandline.llm.shared import sums_before

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", " \n\t", "New York, New York!", "the new york times; The NEW York post\x0bnew york", "Été à Paris. été À paris? é́", "a.b.c a b c\ra b c a b c", "x" * 50_000,
    "big apple " * 3000, "\x00one\x7ftwo three-four 5six", "日本語 テスト 日本語 テスト", "the the the the the",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts at odds, repeated rows, a null id, a null language and source, and columns whose names the operators use."""
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, "x", 1.5, 7) for k, t in enumerate(TEXTS * 2)]
    rows += [(3, TEXTS[3], "en", "s3", "x", 1.5, 7), (None, "new york without an id", "en", "", "x", 1.5, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, score double, size int").repartition(3)


def ranked(docs, text, k):
    terms = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    found = []
    for (doc, _), own, size in zip(docs, terms, sizes, strict=True):
        m = 75 + 25 * size * n // total
        score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if own[t])
        if score > 0:
            found.append((-score, doc is None, doc or 0))
    return [(None if none else doc, -score) for score, none, doc in sorted(found)[:k]]


@pytest.mark.parametrize(("pairs", "queries_at_once"), [(4_000_000, 2000), (6, 2)])
def test_search_odd_texts(spark, odd, monkeypatch, pairs, queries_at_once):
    monkeypatch.setattr(lexical, "SHARD_PAIRS", pairs)
    monkeypatch.setattr(lexical, "TEXT_BYTES", 64 if pairs == 6 else lexical.TEXT_BYTES)
    monkeypatch.setattr(lexical, "QUERIES", queries_at_once)
    asked = [(1, "New york NEW york"), (2, None), (3, ""), (4, "apple five 5six two"), (5, "nothing known"), (6, "été テスト"), (1, "the"), (None, "paris")]
    items = spark.createDataFrame([(i, t, 9) for i, t in asked], "item_id int, text string, rank int")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    index = lexical.build(odd)
    got = lexical.search(index, items, 5).collect()
    expected = [(i, r, d, s) for i, t in asked for r, (d, s) in enumerate(ranked(docs, t, 5), 1)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert lexical.search(lexical.build(odd.where("false")), items).count() == 0
    assert lexical.search(index, items.where("false")).count() == 0


def test_maxscore_equals_all_scores_and_skips_blocks():
    """Long lists of common terms beside short ones of rare terms: equal to plain sums, with blocks left alone."""
    rng = np.random.default_rng(5)
    n, lists = 20_000, {}
    m = rng.integers(75, 400, n).astype(np.int64)
    import pyarrow as pa

    names, codes, docs, tfs = [f"t{k}" for k in range(12)], [], [], []
    for k in range(12):
        own = np.sort(rng.choice(n, 15_000 if k < 6 else 40 * (k - 5), replace=False))
        codes.append(np.full(len(own), k))
        docs.append(own)
        tfs.append(np.where(rng.random(len(own)) < 0.01, rng.integers(1, 70_000, len(own)), 1))
    rows = next(lexical.shard_rows(0, pa.array(names, pa.large_string()), np.concatenate(codes), np.concatenate(docs), np.concatenate(tfs), pa.array(range(n)), m)).to_pandas()
    lists = {r.term: lexical.Postings(r) for r in rows.itertuples()}
    for k, name in enumerate(names):
        got = lists[name].read(np.arange(len(lists[name].firsts)))
        assert np.array_equal(got[0], docs[k]) and np.array_equal(got[1], tfs[k])
    total_blocks = 0
    for trial in range(20):
        weights = {t: int(rng.integers(2, 60)) if int(t[1:]) < 6 else int(rng.integers(3000, 9000)) for t in rng.choice(names, 7, replace=False)}
        searcher = lexical.Searcher(lists, m)
        at, score = searcher.best(weights, 10)
        every = np.zeros(n, np.int64)
        for t, w in weights.items():
            k = int(t[1:])
            every[docs[k]] += w * lexical.impact(tfs[k].astype(np.int64), m[docs[k]])
        best = np.lexsort((np.arange(n), -every))[:10]
        best = best[every[best] > 0]
        order = np.lexsort((at, -score))[:10]
        assert np.array_equal(at[order], best) and np.array_equal(score[order], every[best])
        total_blocks += sum(len(lists[t].firsts) for t in weights) - searcher.blocks_read
    assert total_blocks > 500


@pytest.mark.parametrize("bits", [1, 2, 5, 26, 47, 63, 64])
def test_quotient_filter_round_trip(bits):
    rng = np.random.default_rng(bits)
    p = qf.Permutation(bits)
    keys = np.unique(rng.integers(0, 1 << min(bits, 62), 3000).astype(np.uint64))
    mixed = p(keys)
    assert np.array_equal(p.inverse(mixed), keys) and len(np.unique(mixed)) == len(keys) and (bits == 64 or int(mixed.max()) < 1 << bits)
    mixed.sort()
    counts = np.where(rng.random(len(keys)) < 0.2, rng.integers(1, 1 << 40, len(keys)), 1).astype(np.uint64)
    data = qf.to_bytes(mixed, counts, bits)
    got = qf.items(data)
    assert np.array_equal(got[0], mixed) and np.array_equal(got[1], counts)
    both = qf.merged([got, (mixed[::2], counts[::2]), (mixed[:0], counts[:0])])
    assert np.array_equal(both[0], mixed) and int(both[1].sum()) == int(counts.sum()) + int(counts[::2].sum())
    assert len(qf.items(qf.to_bytes(mixed[:0], counts[:0], bits))[0]) == 0
    if bits == 26:
        assert len(qf.to_bytes(mixed, np.ones(len(mixed), np.uint64), bits)) < 3 * len(mixed)  # 8 bytes each as plain numbers


def phrases(docs, least, longest, share=100, most=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    f[lang][tuple(words[k : k + n])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in often.items())
            if not inside:
                score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, _, p, k) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, " ".join(p), -a, counts[p[:k]], counts[p[k:]], total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("shard", "least", "share", "longest"), [(8 << 20, 2, 100, 5), (40, 2, 60, 4), (40, 100, 100, 5)])
def test_collocations_of_odd_texts(spark, odd, monkeypatch, shard, least, share, longest):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "BUCKET", 10 if shard == 40 else collocations.BUCKET)
    monkeypatch.setattr(collocations, "RANGE", 40 if shard == 40 else collocations.RANGE)
    got = collocations.collocations(odd, least=least, share=share, longest=longest, most=30).collect()
    assert sorted(map(tuple, got)) == phrases([(r.lang, r.text) for r in odd.collect()], least, longest, share, 30)
    assert collocations.collocations(odd.where("false")).count() == 0
    assert collocations.collocations(odd, least=10**6).count() == 0


def test_numbers_of_over_32_bits(spark):
    """Pairs of numbers that don't fit 64 bits: what is left over becomes a lane."""
    ids = np.array([1 << 35, (1 << 36) - 1, 7, (3 << 34) + 5], np.uint64)
    stream = np.array([1, 2, 1, 2, 0, 3, 4, 1, 2, 0], np.uint64)  # local numbers
    streams = spark.createDataFrame([(k, bytearray(collocations.squeezed(stream))) for k in range(3)], "shard long, data binary")
    told = spark.createDataFrame([(k, bytearray(collocations.squeezed(np.arange(1, 5), ids))) for k in range(3)], "shard long, data binary")
    counted = collocations._counted(streams, told, 0, 36, 4)
    rows = collocations._merged(counted.where("range is not null"), 36, 4, 3).collect()
    found = {(r.prefix, r.suffix): r.f for r in rows if r.shard is None}
    a, b, c, d = (int(x) for x in ids)
    assert found == {(a, b): 9, (b, a): 3, (c, d): 3, (d, a): 3}
    assert len({r.id for r in rows if r.shard is None}) == 4 and sum(r.shard is not None for r in rows) > 0


@pytest.mark.parametrize(("weights", "most"), [((5, 2, 1), 3), ((1,), 2), ((1, 30), 3)])
def test_mixing(spark, odd, weights, most):
    """Targets by filling sources step by step; copies by exact prefix sums; near the targets."""
    rng = np.random.default_rng(6)
    sizes = {"a": 30, "b": 3000, "c": 40, None: 500, "": 2}
    rows = [(k, "w " * int(rng.integers(0, 60)), s, 1) for s, n in sizes.items() for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    for docs in (frame, odd):
        found = mixing.mixed(mixing.measured(docs).drop("text"), weights, most).collect()
        texts = Counter((r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in docs.collect())
        assert Counter((r.doc_id, r.source, r.size) for r in found) == texts
        size = Counter()
        for r in found:
            size[r.source] += r.size
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
        full, words = set(), sum(size.values())
        while True:
            left, w = words - sum(most * size[s] for s in full), sum(weight[s] for s in order if s not in full)
            more = {s for s in order if s not in full and left * weight[s] > most * size[s] * w or size[s] == 0} - full
            if not more:
                break
            full |= more
        largest = {s: max(r.size for r in found if r.source == s) for s in order}
        for s in order:
            target = most * size[s] if s in full else left * weight[s] / w
            own = [r for r in found if r.source == s]
            assert {r.source_size for r in own} == {size[s]} and all(r.target == pytest.approx(target) for r in own)
            assert all(r.taken == r.copies * r.size and 0 <= r.copies <= most for r in own)
            assert abs(sum(r.taken for r in own) - target) <= 2 * largest[s]
        again = mixing.mixed(mixing.measured(docs).drop("text").repartition(5), weights, most)
        assert Counter(map(tuple, again.select("source", "size", "taken").collect())) == Counter((r.source, r.size, r.taken) for r in found)
        assert mixing.emitted(again).count() == sum(r.copies for r in found)
    assert mixing.mixed(mixing.measured(odd.where("false"))).count() == 0


def test_sums_before(spark):
    rows = [(g, k % 7, k) for g in ("a", "b", None) for k in range(50 if g == "a" else 4)]
    frame = spark.createDataFrame(rows, "g string, o int, v long")
    got = sums_before(frame, ["g"], [F.col("o"), F.col("v")], {"before": "v"}).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.before == sum(v for g, o, v in rows if g == r.g and (o, v) < (r.o, r.v))
