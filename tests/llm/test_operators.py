"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import components, cuckoo, embed_dedup, html_extract, langid, line_dedup, packing, quality, range_coder, sentencepiece_codec, simhash, token_file, tokenise, toxicity
from strandline.llm.shared import local_roots, lookup
from strandline.llm.tokenise import encoder

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "Don't  I'll <|endoftext|>x", "İstanbul ΑΣ é́ 's x's .'s foo..bar 12a ﬁ", "\x1cq\x1c q", "日本語 テスト 😀", "word " * 9000, "a\xa0b", "THE The the"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, a null id, and columns whose names the operators use."""
    rows = [(k, t, "en", "s", "x", 1.5) for k, t in enumerate(ODD)] + [(3, "\n", "en", "s", "x", 1.5), (None, "no id here", None, None, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, length string, score double").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def whole_ids(texts):
    library = Tokenizer.from_file(WORDS)
    return [[*x.ids, 1] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def empty(frame):
    return frame.where("false")


def test_word_encoder_equals_whole_texts(docs):
    texts = [r[0] for r in docs.select("text").collect()] + ODD
    ids, counts = encoder(WORDS).encode(pa.array(texts, pa.string()))
    expected = [x[:-1] for x in whole_ids(texts)]
    assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("frame", ["odd", "docs"])
def test_token_file_round_trip(frame, request):
    rows = request.getfixturevalue(frame)
    found = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file.documents(token_file.write(rows, WORDS)).collect()), key=lambda r: r[0])
    ordered = sorted(((r.doc_id, r.text) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (at, doc, n, c), (key, _), ids in zip(found, ordered, whole_ids([t for _, t in ordered]), strict=True):
        assert (at, doc, n, c) == (start, key, len(ids), crc(ids))
        start += n
    assert token_file.documents(token_file.write(empty(rows), WORDS)).count() == 0


def test_range_coder_blocks():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, top, n) for top, n in ((300, 1), (300, 0), (20, 3000), (300, 8192), (49408, 700))] + [np.full(8192, 7)]
    coded = range_coder.encode(blocks, 49408)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert len(coded[-1]) < 100 and len(coded[2]) < 2 * 3000
    assert np.array_equal(range_coder.decode([coded[3]])[0], blocks[3])  # no block needs another
    with pytest.raises(ValueError, match="damaged"):
        range_coder.decode([coded[3][:-1] + bytes([coded[3][-1] ^ 1])])


@pytest.mark.parametrize("vocabulary", [1, 2, 9, 1 << 16, 200_000, 1 << 20])
def test_range_coder_vocabularies(vocabulary):
    """Ids counted one by one and ids that share a count, the first and the last one included."""
    rng = np.random.default_rng(vocabulary)
    ends = np.array([0, vocabulary - 1] * 300)
    blocks = [rng.integers(0, vocabulary, n) for n in (1, 700, 64)] + [ends, np.minimum(rng.zipf(1.3, 900), vocabulary) - 1]
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(range_coder.encode(blocks, vocabulary)), strict=True))


def test_range_coder_counts_every_id():
    """Ids in random order, which no context predicts, and other ids in the second half, which a table of the first would code at
    about 10 bits each. Failed predictions cost over half a bit, so bounds are a bit and two above the entropy of 3 and 4 bits."""
    rng = np.random.default_rng(5)
    halves = [rng.choice(rng.choice(49408, 8, replace=False), 3000) for _ in range(2)]
    first, both = (8 * len(x) for x in range_coder.encode([halves[0], np.concatenate(halves)], 49408))
    assert first / 3000 < 4 and (both - first) / 3000 < 6
    counts = range_coder._Order0(2, 49408)
    for t, x in enumerate(halves[0][:50]):
        counts.learn(np.arange(2), np.array([x, 7]))
        assert counts.count(np.arange(2), np.array([x, 7])).tolist() == [int((halves[0][: t + 1] == x).sum()), t + 1]

@pytest.mark.parametrize("vocabulary", [9, 49408, 200_000, 1 << 30])
def test_range_coder_wide_blocks(vocabulary):
    """Blocks of many lanes beside small ones: lanes of unequal length, ids that share a count, ids that nothing predicts."""
    rng = np.random.default_rng(vocabulary)
    blocks = [np.minimum(rng.zipf(1.3, n), vocabulary) - 1 for n in (8193, 20_000, 700)] + [np.tile([0, vocabulary - 1, 0], 5000), rng.integers(0, vocabulary, 9001)]
    coded = range_coder.encode(blocks, vocabulary)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert len(coded[3]) < 15_000 and len(coded[4]) < 9001 * (np.log2(vocabulary) + 2) / 8
    with pytest.raises(ValueError, match="damaged"):
        range_coder.decode([coded[1][:-1] + bytes([coded[1][-1] ^ 1])])


def test_full_memory_keeps_repeated_words(monkeypatch):
    """A full memory forgets words met once, learns repeated ones only once, and gives the library's ids all along."""
    monkeypatch.setattr(tokenise, "REMEMBERED", 40)
    own, learned = tokenise.WordEncoder(WORDS), Counter()
    learn = own.memory.learn
    own.memory.learn = lambda words: learned.update(words.to_pylist()) or learn(words)
    for k in range(12):
        texts = [f"often again. k{k}a{n}" for n in range(9)] + ["Often, again.", None]
        ids, counts = own.encode(pa.array(texts))
        assert np.split(ids.tolist(), np.cumsum(counts)[:-1])[-2].tolist() == whole_ids(["Often, again."])[0][:-1]
        assert ids.tolist() == [i for x in whole_ids(texts) for i in x[:-1]]
    assert learned["often"] == learned["again."] == 1 and len(own.memory.strings) <= 40


def test_joined_crc():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc" * 99, b"de" * 1000)):
        assert token_file.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("frame", ["odd", "docs"])
def test_packing(frame, request):
    rows = request.getfixturevalue(frame)
    found = packing.pack(rows, WORDS, 512, keep_ids=True)
    packed = found.collect()
    texts = Counter()
    for r, ids in zip(rows.collect(), whole_ids([r.text for r in rows.collect()]), strict=True):
        for k in range(0, len(ids), 512):
            texts[(r.doc_id, k // 512, k, len(ids[k : k + 512]), crc(ids[k : k + 512]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == texts
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(r.length for r in packed)
    assert len(places) <= -(-total // 512) * 1.03 + 1
    whole = packing.sequences(found).collect()
    assert sum(len(r.ids) for r in whole) == 4 * total and max(len(r.ids) for r in whole) <= 2048
    assert packing.pack(empty(rows), WORDS).count() == 0


def test_plan_is_small_and_complete():
    counts = {n: 10**9 + n for n in range(1, 513)}
    rows = packing.plan(counts, 512)
    assert len(rows) < 3 * 512 * 9
    for n in (1, 100, 512):
        own = sorted((a, b) for length, a, b, *_ in rows if length == n)
        assert own[0][0] == 0 and own[-1][1] == counts[n] and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


def rule_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("frame", ["odd", "docs"])
def test_quality_statistics(frame, request, spark):
    rows = request.getfixturevalue(frame)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for r in quality.judged(rows, quality.fit(rows, labels)).collect():
        n, chars, symbols, dups, repeats = rule_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        failed = n < 50 or 100 * repeats > 50 * n
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.judged(empty(rows), quality.fit(empty(rows), empty(labels))).count() == 0


def test_forest_isolates_what_is_odd():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.05, (2000, len(quality.FEATURES)))
    x[:, 1] = np.where(np.arange(2000) < 100, rng.uniform(0.4, 3, 2000), 0.0)
    x[:100, 0] += rng.uniform(1, 3, 100)
    good = np.arange(2000) >= 100
    forest = quality.calibrated(quality.grow(x, (0, 1, 7)), x, good)
    kept = forest.paths(x) >= forest.threshold
    assert kept[good].mean() > 0.98 and kept[~good].mean() < 0.1


def test_language_id_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs, ~held)
    found = langid.identified(docs.where(held), model).where("n_chars > 30")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    rows = langid.identified(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows if r.text in (None, "", " ", "\n")} == {"und"}
    assert langid.identified(odd, langid.fit(empty(docs), F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_naive_bayes_scores_match_a_plain_sum():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b"], rng.normal(size=(1 << langid.BITS, 2)), np.log([0.5, 0.5]))
    texts = ["Abc dé", "x", "1 2", "the end of\nit"]
    best, score = model.scores(pa.array(texts))
    for text, k, p in zip(texts, best, score, strict=True):
        points, lengths, lettered = langid._points(pa.array([text]))
        total = model.prior.copy()
        for _, bucket in langid.ngrams.hashed(points, lengths, langid.SIZES, langid.BITS):
            for b in bucket:
                total = total + model.matrix[b]
        assert (k == -1) == (not lettered[0])
        if k >= 0:
            assert k == total.argmax() and p == pytest.approx(1 / np.exp(total - total.max()).sum())


def test_sentencepiece_parity(docs, odd):
    texts = [r[0] for r in docs.select("text").limit(60).collect()] + [t or "" for t in ODD] + ["  a b\n\nc  d \t é x ", "▁a ▁", "x" + " " * 37 + "y", "<s> </s> <0x0A>", "<unk>"]
    assert sentencepiece_codec.codec(PIECES).check_parity(PIECES, texts) == []
    rows = sentencepiece_codec.decoded(sentencepiece_codec.encoded(odd, PIECES), PIECES).collect()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert sentencepiece_codec.checked(docs, PIECES).where("not round_trip or not parity").count() == 0
    assert sentencepiece_codec.checked(odd, PIECES).where("not parity").count() == 0


def model_file(pieces, kind, byte_fallback=False, trim=True):
    def field(number, kind, data):
        tag = number << 3 | kind
        head = bytes([tag]) if tag < 128 else bytes([tag & 127 | 128, tag >> 7])
        return head + (bytes([len(data)]) + data if kind == 2 else data)

    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    return data + field(2, 2, field(3, 0, bytes([kind])) + field(35, 0, bytes([byte_fallback]))) + field(3, 2, field(4, 0, bytes([trim])))


@pytest.mark.parametrize(("byte_fallback", "trim"), [(False, True), (True, False)])
def test_unigram_models_equal_the_library(tmp_path, byte_fallback, trim):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("[X]", 0.0, 4), ("zq", -1.0, 5), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1)]
    pieces += [(c, -4.0 - k / 10, 1) for k, c in enumerate("<>sxyzq/")] + [("▁b", -2.5, 1), ("abb", -3.6, 1)]
    pieces += [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)] if byte_fallback else []
    data = model_file(pieces, sentencepiece_codec.UNIGRAM, byte_fallback, trim)
    file = sentencepiece_codec.ModelFile.read(data)
    assert [(p, k) for p, _, k in file.pieces] == [(p, k) for p, _, k in pieces] and file.trim == trim and file.dummy_prefix and file.byte_fallback == byte_fallback
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as out:
        out.write(data)
    texts = ["a <s> b", "ab abb  aab", "zq qz", "a[X]b [X]", " a  b ", "", "é", "aéeéb é", "<unk>", "</s>a", "x\ny", "abab" * 50, "<0x41>"]
    assert sentencepiece_codec.SentenceCodec(path).check_parity(path, texts) == []


def brute_lines(rows, min_docs=3, min_chars=20):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(strip))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in rows:
        kept = [x for x in (text or "").split("\n") if doc is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc]
        out[doc] = "\n".join(kept)
    return out


def test_line_dedup_and_its_reversal(spark):
    shared = "This line is shared by many"
    rows = [(k, f"{shared} \nown {k} {'x' * 20}\n  {shared.upper()}\nshort") for k in range(6)] + [(None, shared), (7, None), (8, ""), (9, f"{shared}\n{shared}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "key": F.lit("k")})
    index = line_dedup.build(frame)
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(frame, index).collect()} == brute_lines(rows)

    def state(i):
        return sorted((bytes(r.key), r.n_docs, r.max_doc) for r in i.refs.collect()), sorted((r.shard, r.n) for r in i.filters.collect())

    more = spark.createDataFrame([(20, f"own 1 {'x' * 20}\n{shared}"), (21, f"own 1 {'x' * 20}")], "doc_id long, text string")
    grown = line_dedup.insert(index, more)
    assert state(grown) == state(line_dedup.build(frame.select("doc_id", "text").unionByName(more)))
    back = line_dedup.delete(grown, more.select("doc_id"))
    assert state(back) == state(index)
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(frame, back).collect()} == brute_lines(rows)
    assert line_dedup.deduplicated(empty(frame), line_dedup.build(empty(frame))).count() == 0


def test_cuckoo_filter():
    keys = np.array([hashlib.md5(str(k).encode()).digest() for k in range(4000)], "S16")
    raw = np.frombuffer(b"".join(hashlib.md5(str(k).encode()).digest() for k in range(4000)), "S16")
    own = cuckoo.CuckooFilter(3000)
    own.insert(raw[:3000])
    assert own.contains(raw[:3000]).all() and own.contains(raw[3000:]).mean() < 0.01 and len(keys) == 4000
    own.remove(raw[:1500])
    assert own.contains(raw[1500:3000]).all() and own.contains(raw[:1500]).mean() < 0.01
    assert cuckoo.CuckooFilter.of(own.to_bytes()).contains(raw[1500:3000]).all()


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("frame", "heavy"), [("odd", 1 << 17), ("docs", 1 << 17), ("docs", 8)])
def test_simhash_groups(frame, heavy, request):
    rows = request.getfixturevalue(frame).collect()
    found = simhash.near_duplicates(request.getfixturevalue(frame), heavy=heavy).collect()
    prints = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    ids = [r.doc_id for r in rows]
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1))
    root = local_roots(len(rows), a, b)
    smallest = {g: min((ids[k] for k in np.flatnonzero(root == g) if ids[k] is not None), default=None) for g in set(root.tolist())}
    expected = Counter((i, f"{int(p):016x}", smallest[g]) for i, p, g in zip(ids, prints, root.tolist(), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    assert simhash.near_duplicates(empty(request.getfixturevalue(frame))).count() == 0


def test_trie_finds_every_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(8)]))
    tree = np.sort(rng.integers(0, 2, len(values)))
    order = np.lexsort((values, tree))
    values, tree = values[order], tree[order]
    found = {tuple(sorted(x)) for p, q in simhash.trie_pairs(tree, values) for x in zip(p.tolist(), q.tolist(), strict=True)}
    near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 3) & (tree[:, None] == tree[None, :])
    assert found == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True))


def test_similar_documents(spark, odd):
    rng = np.random.default_rng(5)
    word = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(30):
        base = rng.choice(word, 200).tolist()
        near = base.copy()
        near[50] = "changed"
        texts += [base, near, base[:100] + rng.choice(word, 100).tolist()]
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    sets = [set(zip(*(t[j:] for j in range(5)), strict=False)) for t in texts]
    assert sum(found[k + 1] == k for k in range(0, 90, 3)) >= 29
    for k, c in found.items():
        assert k == c or len(sets[k] & sets[c]) / len(sets[k] | sets[c]) >= 0.8
    ids = {r.doc_id: r.component_id for r in simhash.similar_documents(odd).collect()}
    assert ids[0] == ids[1] == ids[2] == ids[3] == 0 and None not in ids
    assert simhash.similar_documents(empty(odd)).count() == 0


def test_components_and_heavy_keys(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 400)] + [(5, 5), (None, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {k: 1 for k in range(2, 61)} | {k: 100 for k in range(101, 400)}
    left = spark.createDataFrame([(1,)] * 50 + [(2,), (3,), (None,)], "k long")
    right = spark.createDataFrame([(1, 50, "a"), (2, 1, "b")], "k long, n long, x string")
    assert Counter(r.x for r in lookup(left, right, "k", "n", 53).collect()) == {"a": 50, "b": 1, None: 2}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="ad">Buy &amp; buy</div><div class="content" id="c{n}"><h1>Head {n}</h1><p>First &amp; <b>bold</b> text
 over   lines, long enough to count.<br><p>Second &eacute; paragraph with words</p><div class="comments"><p>A reader's comment</p></div></div><footer>&copy; us</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(k, "https://a.example/x", PAGE.format(n=k)) for k in range(5)] + [(8, None, PAGE.format(n=8)), (9, "https://a.example/", None), (10, "nonsense", "<p>only this"), (11, "https://b.example", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "host": F.lit("h"), "path": F.lit("p")})
    found = {r.page_id: r.text for r in html_extract.extracted(frame).collect()}
    for k in (0, 4, 8):
        assert found[k] == f"Head {k}\nFirst & bold text over lines, long enough to count.\nSecond é paragraph with words"
    assert found[9] == "" and found[11] == "" and found[10] == "only this"
    assert html_extract.extracted(empty(frame)).count() == 0


def test_toxicity_held_out(spark, odd):
    rng = np.random.default_rng(3)
    stems, plain = ["grumbl", "snarkov"], [f"{a}{b}" for a in ("tal", "mer", "sin", "dov") for b in ("o", "en", "ist", "ar", "um")]
    rows, labels = [], []
    for k in range(700):
        toxic = k % 4 == 0
        text = rng.choice(plain, 60).tolist()
        if toxic:
            text[5:5] = [f"{rng.choice(stems)}{rng.choice(['a', 'ed', 'ing', 'ers'])}" for _ in range(2)]
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(frame, marks, ~held)
    right = toxicity.scored(frame.where(held), model).join(marks, "doc_id").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95
    misspelt = toxicity.scored(spark.createDataFrame([(1, " ".join(["talo", "grumblezz", "sinist"] * 3))], "doc_id long, text string"), model).first()
    assert misspelt.predicted == 1
    scores = toxicity.scored(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in scores)
    assert toxicity.scored(odd, toxicity.fit(empty(frame), empty(marks), F.lit(True))).where("score is null").count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 24))
    rows = []
    for k in range(400):
        v = centers[k % 12] + rng.normal(0, 0.12, 24) if k < 200 else rng.normal(size=24)
        rows.append((k, [float(x) for x in v], k % 2))
    rows += [(500 + k, rows[0][1], 0) for k in range(30)] + [(600, None, 0), (601, [0.0] * 24, 0), (602, [float("nan")] + [1.0] * 23, 0), (603, [None] + [1.0] * 23, 0), (604, rows[0][1], None), (605, [1.0, 2.0], 0), (606, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(frame).collect()}
    usable = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if v and len(v) == 24 and None not in v and lab is not None and np.isfinite(v).all() and any(v)]
    ids = [u[0] for u in usable]
    x = np.array([u[1] / np.linalg.norm(u[1]) for u in usable])
    linked = (x @ x.T >= 0.93) & (np.array([u[2] for u in usable])[:, None] == np.array([u[2] for u in usable])[None, :])
    np.fill_diagonal(linked, False)
    root = local_roots(len(ids), *np.nonzero(np.triu(linked)))
    got = sum(min(found[i][0], n) for i, n in zip(ids, linked.sum(axis=1), strict=True))
    assert got >= 0.98 * linked.sum() and all(found[i][0] <= n for i, n in zip(ids, linked.sum(axis=1), strict=True))
    assert np.mean([found[i][1] == ids[r] for i, r in zip(ids, root, strict=True)]) > 0.98
    assert all(found[i] == (0, i, True) for i in (600, 601, 602, 603, 604, 605, 606))
    assert embed_dedup.near_duplicates(empty(frame)).count() == 0


def _pair_at(rng, v, cosine):
    other = rng.normal(size=len(v))
    other -= (other @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_embedding_pairs_of_a_small_label_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LEAF", 1)
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=32)).tolist(), 0) for k in range(4000)]
    hot = rng.normal(size=32)
    rows += [(5000 + k, (hot + rng.normal(0, 0.05, 32)).tolist(), 0) for k in range(300)]
    for k in range(200):
        v = rng.normal(size=32)
        rows += [(10000 + 2 * k, v.tolist(), 1), (10001 + 2 * k, _pair_at(rng, v, 0.932).tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.component_id for r in embed_dedup.near_duplicates(frame).where("vec_id >= 10000").collect()}
    assert sum(found[10001 + 2 * k] == 10000 + 2 * k for k in range(200)) == 200


def test_embedding_pairs_within_a_dense_region(spark, monkeypatch):
    for name, value in (("LARGEST", 16), ("LEAF", 8), ("LIST", 3), ("ROUNDS", 1)):
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(9)
    middle = rng.normal(size=48)
    middle /= np.linalg.norm(middle)
    rows = []
    for k in range(1500):
        side = rng.normal(size=48)
        side -= (side @ middle) * middle
        v = np.sqrt(0.8) * middle + np.sqrt(0.2) * side / np.linalg.norm(side)
        rows.append((k, v, 0))
        if k < 300:
            rows.append((5000 + k, _pair_at(rng, v, 0.945), 0))
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.93).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v.tolist(), lab) for i, v, lab in rows], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(frame).collect()}
    assert all(found[i] <= n for (i, _, _), n in zip(rows, linked, strict=True))
    assert sum(found[i] for i, _, _ in rows) >= 0.96 * linked.sum() > 500


def test_embedding_search_alone(spark, monkeypatch):
    """What NN-descent finds by itself in one label of 3,000 vectors: no group is compared whole, whatever an audit says."""
    def whole(rows, threshold):
        raise AssertionError("a group was compared whole")

    monkeypatch.setattr(embed_dedup, "_compared", whole)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(2400, 32))
    vectors = [*base, *(_pair_at(rng, base[k], 0.935) for k in range(600))]
    x = np.array([v / np.linalg.norm(v) for v in vectors])
    linked = (x @ x.T >= 0.93).sum(axis=1) - 1
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    rows = embed_dedup.near_duplicates(frame).collect()
    assert all(r.n_links <= linked[r.vec_id] for r in rows)
    assert sum(r.n_links for r in rows) >= 0.97 * linked.sum() >= 0.97 * 1200
    assert rows[0].audit_recall >= 0.97


def test_embedding_audit_goes_on_until_it_can_tell(spark):
    """One vector in 50 has a partner: the first share of 200 sees too few of them."""
    rng = np.random.default_rng(13)
    base = rng.normal(size=(1960, 16))
    x = np.array([*base, *(_pair_at(rng, base[k], 0.97) for k in range(20))])
    units = x / np.linalg.norm(x, axis=1)[:, None]
    rows = [("0:16", len(x), k, u.tolist()) for k, u in enumerate(units)]
    found = embed_dedup.audited(spark.createDataFrame(rows, "group string, n long, rep long, unit array<double>"), 0.93).collect()
    linked = (units @ units.T >= 0.93).sum(axis=1) - 1
    assert len(found) >= embed_dedup.LEAST and all(r.real == linked[r.rep] > 0 for r in found)


def test_similar_documents_that_share_a_passage(spark):
    """Near copies in a hot group whose members are mostly too far from its centre."""
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(400)]
    rows, pairs = [], []
    for k in range(240):
        own = [f"d{k}x{j}" for j in range(110)]
        rows.append((2 * k, " ".join(passage + own)))
        changed = [w if j > 3 else f"c{k}x{j}" for j, w in enumerate(own)]
        rows.append((2 * k + 1, " ".join(passage + changed)))
        pairs.append((2 * k, 2 * k + 1))
    order = rng.permutation(len(rows)).tolist()
    frame = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame, words=5, similarity=0.8).collect()}
    assert all(found[u] == found[v] == u for u, v in pairs) and len(set(found.values())) == 240


@pytest.mark.parametrize("chunk", [256, 4])
def test_similar_documents_against_brute_force(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(12)
    base = [f"b{k}" for k in range(150)]
    family = [(10_000 + k, " ".join(w if rng.random() > 0.004 * (k % 9) else f"x{k}" for w in base)) for k in range(60)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(family, "doc_id long, text string"))
    rows = frame.collect()
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)})
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = local_roots(len(rows), *(np.array(x) for x in zip(*pairs, strict=True)))
    smallest = {g: min(rows[k].doc_id for k in np.flatnonzero(root == g)) for g in set(root.tolist())}
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    assert found == {r.doc_id: smallest[g] for r, g in zip(rows, root.tolist(), strict=True)}


def test_similarity_of_long_documents_is_exact(spark):
    rows, want = [], {}
    for k in range(60):
        words = [f"w{k}x{j}" for j in range(1200)]
        same = 1072 if k % 2 else 1056  # of 1196 shingles: similarity 0.807 or 0.784
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:same] + [f"o{k}x{j}" for j in range(1200 - same)]))]
        want[2 * k] = 2 * k
        want[2 * k + 1] = 2 * k + (k % 2 == 0)
    sims = [(s - 4) / (2 * 1196 - (s - 4)) for s in (1072, 1056)]
    assert sims[0] > 0.8 > sims[1] and sims[0] < 0.815
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=0.8).collect()}
    assert all(found[k] == v for k, v in want.items() if k % 4 < 2)
    assert sum(found[k] == v for k, v in want.items()) >= 118


def test_html_headers_under_long_classes():
    long = " ".join(f"category-{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    read = lambda html: [text for _, text, _ in html_extract.page_blocks(html)]
    assert read(f'<article><div class="{long}"><header><h1>Title</h1><p>by</p></header><p>Text</p></div></article>') == ["Title", "Text"]
    assert read(f'<body><header><div class="{long}"><p>Shop</p></div></header><main><p>Text</p></main></body>') == ["Text"]
    pages = [f'<body><{tag}><div class="{long}"><p>Words of the text</p></div></{tag}></body>' for tag in ("main", "section")]
    paths = [html_extract.page_blocks(x)[0][0].parent.path for x in pages]
    assert paths[0] != paths[1] and max(map(len, paths)) <= html_extract.PATH_BYTES


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_line_dedup_with_filters_dealt_by_shard(spark, docs, monkeypatch, most):
    for name, value in (("BROADCAST_BYTES", most), ("SHARD_KEYS", 3), ("HOLDERS", 20)):
        monkeypatch.setattr(line_dedup, name, value)
    rows = docs.select("doc_id", "text")
    found = {r.doc_id: r.text for r in line_dedup.deduplicated(rows, line_dedup.build(rows)).collect()}
    assert found == brute_lines([(r.doc_id, r.text) for r in rows.collect()])


def test_line_index_grows_past_its_filters(spark):
    line = lambda k: f"a line of its own, number {k}"
    start = spark.createDataFrame([(k, line(0)) for k in range(4)], "doc_id long, text string")
    more = spark.createDataFrame([(10 + k, "\n".join(line(j) for j in range(1, 60))) for k in range(3)], "doc_id long, text string")
    grown = line_dedup.insert(line_dedup.build(start), more)
    assert grown.filters.agg(F.sum("n")).first()[0] == 60
    rows = [(r.doc_id, r.text) for r in start.unionByName(more).collect()]
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(start.unionByName(more), grown).collect()} == brute_lines(rows)


def test_letters_and_bounds_of_languages(spark):
    model = langid.Model(["a", "b"], np.zeros((1 << langid.BITS, 2)), np.log([0.5, 0.5]))
    best, score = model.scores(pa.array(["😀😀", "𝒜", "12 !", "日本", None]))
    assert best.tolist() == [-1, 0, -1, 0, -1] and score[1] == pytest.approx(0.5)  # ties go to the first language
    frame = spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 3"):
        langid.fit(frame, F.lit(True), languages=3)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    forests = quality.fit(docs, labels.where(~held))
    judged = quality.judged(docs.join(labels.where(held).select("doc_id", "quality"), "doc_id"), forests).where("not base_failed").collect()
    assert np.mean([r.kept for r in judged if r.quality == 1]) > 0.97 and np.mean([r.kept for r in judged if r.quality == 0]) < 0.1
    again = quality.fit(docs.repartition(7), labels.where(~held).repartition(3))
    assert [f.threshold for f in again] == [f.threshold for f in forests]


def test_quality_learns_from_every_document_and_label(spark):
    """Bad documents that come last in the order of a hash of doc_id, behind 8,000 good ones."""
    ids = spark.range(8600).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")).alias("place"))
    word = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.when(F.col("place") > 8300, F.lit("#|#")).otherwise(F.lit("")), F.lit("w"), (k * 7919 + F.col("doc_id") * 31) % 997))
    rows = ids.select("doc_id", "place", F.concat_ws(" ", word).alias("text")).repartition(3)
    forests = quality.fit(rows, rows.select("doc_id", (F.col("place") <= 8300).cast("int").alias("quality")))
    found = quality.judged(rows, forests).where("not base_failed").groupBy(F.col("place") > 8300).agg(F.avg(F.col("kept").cast("int")), F.count("*")).collect()
    kept = {r[0]: r[1] for r in found}
    assert sum(r[2] for r in found) == 8600 and kept[False] > 0.99 and kept[True] < 0.05
    assert all(f.path[:, 0].max() > quality.path_constant(quality.TREE_SAMPLE // 2) for f in forests)


def test_quality_forest_holds_every_row():
    x = np.random.default_rng(3).normal(size=(70_000, len(quality.FEATURES)))
    for n in (1, 300, 70_000):
        forest = quality.bare((0, 1))
        tally = quality.Tally.of_none(forest, 0)
        tally.add(forest, 0, x[:n], np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), quality.shares(n))
        assert tally.n.sum() == n * quality.shares(n) and tally.low.min() == x[:n, :2].min()
    halves = [quality.grow(x[:9000], (0, 1)), quality.grow(x[:9000], (0, 1))]
    assert (halves[0].split == halves[1].split).all()


def test_toxicity_scores_match_plain_sums():
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS) / 50, -0.3)
    texts = ["Some words, some MORE", "", None, "ab", "é" * 40, "a " * 5000]
    for text, score in zip(texts, model.scores(pa.array(texts)), strict=True):
        words = [w.strip(toxicity.MARKS) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
        total = 0.0
        for w in words:
            grams = [b for _, bucket in toxicity.subwords(pa.array([w], pa.large_string())) for b in bucket]
            total += sum(model.weights[b] for b in grams) / max(1, len(grams))
        assert score == pytest.approx(1 / (1 + np.exp(-(toxicity.SCALE * total / max(1, len(words)) - 0.3))))


def test_one_long_text_does_not_empty_the_sample(spark):
    rows = [(k, ("grumblers " if k % 2 else "kindly ") + "tal mer sin dov " * 10, k % 2) for k in range(200)] + [(1000, "tal " * 20_000, 1)]
    frame = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 3, "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.scored(frame, toxicity.fit(frame, marks, F.lit(True))).collect()}
    assert sum(found[k] == k % 2 for k in range(200)) > 195


def test_components_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SMALL", 16)
    rng = np.random.default_rng(14)
    chain = np.cumsum(rng.normal(0, 0.05, (300, 16)), axis=0) + rng.normal(size=16) * 2
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(chain)] + [(300, [float(x) for x in chain[0]], 0)] * 2
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    found = sorted((r.vec_id, r.n_links) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert found == sorted((r[0], int(n)) for r, n in zip(rows, linked.sum(axis=1), strict=True))


GOLDEN = {
    "blog": (
        '<html><body class="home"><div class="site-header"><p>Our site has a long header text that must not stay in</p></div><div class="wrap"><div id="sidebar"><p>Popular posts of the week</p></div>'
        '<main><article class="post-{n} entry"><header class="entry-header"><h1>Title {n}</h1></header><p>Body &lt;one&gt; of   page {n}.</p><ul><li>First item</li><li>Second item</li></ul>'
        '<form><p>Subscribe here now please</p></form><blockquote>Quoted words</blockquote></article></main></div><div class="comments-area"><p>I disagree with all of this</p></div></body></html>',
        "Title {n}\nBody <one> of page {n}.\nFirst item\nSecond item\nQuoted words",
    ),
    "table": (
        "<body><table><tr><td class=nav><a href=/>Home</a> <a href=/x>More</a></td><td class=text><h2>Report {n}</h2><p>Numbers went up in the year {n} as was told.<p>Then they fell, &copy; nobody knows why.</td></tr></table>"
        "<div class='cookie-notice'>We use cookies on this site</div></body>",
        "Report {n}\nNumbers went up in the year {n} as was told.\nThen they fell, © nobody knows why.",
    ),
    "sections": (
        "<div role=navigation><p>Sections Sections Sections</p></div><section class='story body-{n}'><h1>Story {n}</h1><p>It was a dark&nbsp;night and {n} people came.</p><aside><p>Read also this other story</p></aside>"
        "<pre>code  here</pre><script>var p = '<p>no</p>';</script><!-- <p>hidden</p> --><p>The end &#8212; really.</p></section><div class='masthead'><p>Daily news of the whole wide world</p></div>",
        "Story {n}\nIt was a dark night and {n} people came.\ncode here\nThe end — really.",
    ),
}


@pytest.mark.parametrize("hosts", [0, 200_000])
def test_html_golden_pages(spark, monkeypatch, hosts):
    monkeypatch.setattr(html_extract, "HOSTS", hosts)
    rows = [(10 * k + j, f"https://{name}.example/{k}", page.replace("{n}", str(k))) for j, (name, (page, _)) in enumerate(GOLDEN.items()) for k in range(4)]
    rows += [rows[0], (900, "https://blog.example/long", GOLDEN["blog"][0].replace("Quoted words", "word " * 60_000))]
    found = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for j, (_, text) in enumerate(GOLDEN.values()):
        for k in range(4):
            assert found[10 * k + j] == text.replace("{n}", str(k))
    assert len(found[900]) > 290_000
