"""The training-data operators against brute force on a small fixture that holds nulls, empty
and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

import corpus_pipeline
from qscope.llm import common, fingerprint, jaccard_join, langid, lm_score, media, mixing, packing, sharding, suffix_dedup, token_io, tokens
from qscope.llm.queries import tokenizer_file
from qscope.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, piece string"


def make():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    texts = [base, base, base.upper(), base + " end", "x " + base, text(80) + passage + text(40), passage, text(30) + "\n" + passage, "", None, "one", "one two", "In " * 200, text(3000), "!!! 123", "日本語 テキスト です ね え", text(4), text(4), " ".join(base.split()[:100]) + text(20)]
    near = base.split()
    for i in range(12):
        v = list(near)
        for _ in range(i):
            v[r.randrange(len(v))] = text(1)
        texts.append(" ".join(v))
    return [(i * 3 + 1, t, r.choice(["en", "de", None]), r.choice(["a", "b", "ü", None]), len(t or ""), i, "extra") for i, t in enumerate(texts)]


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(1, "a b c d e f " * 20, "en", "a", 1, 0, "x")] * 2 + [(1, None, None, None, None, None, None), (None, "a b c d e f " * 20, "en", "a", 1, 0, "x"), (2, "", "en", "a", 0, 0, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def removal(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [jaccard_join.HOT_SETS, 2])
def test_jaccard_join(docs, hot):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, links_too=False, hot_sets=hot).collect()}
    assert got == components(ROWS)


def test_jaccard_join_counts_every_link(docs):
    sets = {r[0]: shingles(r[1]) for r in ROWS}
    linked = lambda x, y: bool(x & y) and 100 * len(x & y) >= 80 * len(x | y)
    got = {r.doc_id: r.n_links for r in jaccard_join.join(docs).collect()}
    assert got == {i: sum(j != i and linked(sets[i], sets[j]) for j in sets) for i in sets}
    assert max(got.values()) > 2


def test_jaccard_join_counts_links_between_blocks():
    import pandas as pd

    sets = [np.sort(np.arange(100, dtype="<u8") + s) for s in (0, 5, 50)]
    rows = pd.DataFrame({"block": [0, 1, 1], "k": [1, 2, 3], "comp": [4, 2, 1], "s": [s.tobytes() for s in sets]})
    assert jaccard_join._degrees(rows).values.tolist() == [[1, 2], [2, 4], [3, 0]]


def chosen_signatures(features, frequency):
    """A set's candidates when each signature has the given frequency."""
    signed = jaccard_join.sign(np.zeros(1, np.int64), np.array([len(features)]), features)
    out = set()
    for sig, (_, _, need, total) in zip(signed.signatures, np.concatenate(signed.totals).tolist(), strict=True):
        assert len(sig) == len(set(sig.tolist())) == total
        out.update(sorted(sig.tolist(), key=lambda x: (frequency(x), x))[:need])
    return out


def test_jaccard_join_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    for trial in range(600):
        n = int(rng.integers(1, 40)) if trial % 2 else int(rng.integers(1, 900))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a[rng.permutation(n)[: n - int(rng.integers(0, n // 5 + 1))]]
        while True:  # as many features of its own as the similarity allows
            more = np.append(b, rng.integers(0, 1 << 63, 1, dtype=np.uint64))
            both = len(np.intersect1d(a, more))
            if 100 * both < 80 * (n + len(more) - both):
                break
            b = more
        order = (lambda x: 2) if trial % 3 else (lambda x: x % 7)
        x, y = (chosen_signatures(np.unique(s), order) for s in (a, b))
        if 100 * len(b) >= 80 * n:
            assert x & y, (n, len(b))


def test_jaccard_join_signs_sets_together_as_alone():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 3, 8, 24, 25, 80, 700)]
    signed = jaccard_join.sign(np.arange(7), np.array([len(s) for s in sets]), np.concatenate(sets))
    k, sig = np.concatenate(signed.sets), np.concatenate(signed.signatures)
    for i, s in enumerate(sets):
        alone = jaccard_join.enumerate_signatures(s)
        assert sorted(sig[k == i].tolist()) == sorted(x for a in alone for x in a.tolist())
    assert common.unpacked(common.packed(k), len(k)).tolist() == k.tolist()


def test_jaccard_join_matrix_counts_by_patterns():
    import pandas as pd

    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[: int(rng.integers(0, 61))], rng.choice(common, 20), rng.integers(0, 1 << 63, int(rng.integers(1, 9)), dtype=np.uint64)])) for _ in range(60)]
    for cut in (60, 25):
        rows = pd.DataFrame({"block": [0] * cut + [64] * (60 - cut), "k": range(60), "comp": range(60), "s": [s.astype("<u8").tobytes() for s in sets]})
        left, right, linked = jaccard_join._matrix(rows)
        for i in left:
            for j in right:
                both = len(np.intersect1d(sets[i], sets[j]))
                assert linked[i - left[0], j - right[0]] == (100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both))


def test_jaccard_join_blocks_find_what_stars_miss():
    import pandas as pd

    sets = [np.sort(np.arange(100, dtype="<u8") + s) for s in (0, 5, 50)]
    rows = pd.DataFrame({"block": [0] * 3, "k": [1, 2, 3], "comp": [1, 2, 3], "s": [s.tobytes() for s in sets]})
    assert jaccard_join._compare(rows).values.tolist() == [[1, 2]]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_RUNS, 1])
def test_suffix_dedup(docs, hot):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(docs, hot).collect()}
    assert got == removal(ROWS)


def test_suffix_dedup_of_long_texts_and_one_crowded_hash(spark):
    """Texts over a segment (1 MB), repeats across its border, and many runs of one hash that
    differ at their ends."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    long = " ".join(word() for _ in range(190_000))
    border = long[(1 << 20) - 90 : (1 << 20) + 120]
    rows = [(1, long), (2, border + " " + word()), (3, "tail " + long[-400:]), (4, "ab" * 700), (5, "x" + "ab" * 300)]
    rows += [(10 + i, word() + " " + passage + " " + word() + str(i)) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = removal(rows)
    assert len(long) > 1 << 20
    for hot in (suffix_dedup.HOT_RUNS, 1):
        assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(made, hot).collect()} == want


@pytest.mark.parametrize("buckets", [1024, 1])
def test_suffix_array(buckets, monkeypatch):
    monkeypatch.setattr("qscope.llm.suffix_array.BUCKETS", buckets)
    r = np.random.default_rng(1)
    for _ in range(100):
        t = np.append(r.integers(1, r.integers(2, 6), r.integers(1, 60)), 0)
        tails = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix_array(t)
        assert sa.tolist() == tails
        p = common_prefixes(t, sa)
        for a, b in zip(sa, sa[1:], strict=False):
            x, y = t[a:].tolist(), t[b:].tolist()
            n = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
            assert p[b] == n


def test_fingerprint(docs):
    order = sorted(ROWS)
    got = {r.doc_id: r for r in fingerprint.fingerprint(docs).collect()}
    for i, row in enumerate(order):
        t, following = row[1] or "", order[i - 1][1] or ""
        n = len(t) // 3
        e, r = t[: len(t) - n] + following[:n], got[row[0]]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = shingles(t), shingles(e), shingles(following)
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        assert abs(r.near_edited - like(a, b)) < 0.15 and abs(r.near_next - like(a, c)) < 0.15
    assert got[1].fingerprint == got[4].fingerprint


def test_fingerprint_bins_by_hand():
    """Every bin recomputed with whole numbers: least hash, or a donor's by (bin, attempt)."""
    top = (1 << 64) - 1

    def mix(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & top
        return x ^ (x >> 32)

    r = random.Random(5)
    for size in (0, 1, 3, 40, 700):
        features = sorted({r.getrandbits(64) for _ in range(size)})
        bins, held = 64, {}
        for f in features:
            h = mix(f)
            held[(h >> 32) % bins] = min(h, held.get((h >> 32) % bins, top))
        want = []
        for i in range(bins):
            at, attempt = i, 0
            while held and at not in held:
                attempt += 1
                at = mix((i * 0x9E3779B97F4A7C15 + attempt) & top) % bins
            want.append(held[at] if held else 0)
        got = fingerprint.one_permutation(np.array(features, np.uint64), bins)
        assert got.tolist() == want
        for bits in (3, 8):
            low = "".join(f"{mix(x) & ((1 << bits) - 1):0{bits}b}" for x in want)
            raw = fingerprint.pack(got, not features, bits)
            assert raw == bytes([bool(features)]) + bytes(int(low[i : i + 8], 2) for i in range(0, len(low), 8))


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    per = {}
    for r in rows:
        per.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for rs in per.values():
        assert sum(r.taken for r in rs) == int(rs[0].target) and rs[0].target <= 3 * rs[0].source_size + 1e-9
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(2)).collect()}


def test_mix_documents_takes_what_mix_says(docs):
    words = lambda t: len((t or "").encode().split())
    got = Counter()
    for r in mixing.mix_documents(docs).collect():
        got[r.doc_id] += words(r.text)
    assert all(got[r.doc_id] == r.taken for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(docs, bits):
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in token_io.token_files(docs, tokenizer_file("word_bpe_49k.json"), bits=bits).collect()}
    at = 0
    for i, text, *_ in sorted(ROWS):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert got[i] == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_token_file_round_trip_and_damage():
    ids = np.random.default_rng(0).integers(0, 2**32, 1000).astype(np.uint32)
    for bits in (False, True):
        data = token_io.write_ids(ids, 3, bits, 64)
        assert (token_io.read_ids(data) == ids).all() and (token_io.read_ids(data, 100, 300) == ids[100:300]).all()
    with pytest.raises(ValueError):
        token_io.read_ids(data[:-1])


def test_language_id(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = langid.identify(spark.read.parquet(path)).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(path).select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_language_id_is_the_cosine_of_explicit_vectors():
    r = np.random.default_rng(2)
    words = {lang: ["".join(r.choice(list(letters), int(r.integers(2, 8)))) for _ in range(60)] for lang, letters in (("x", "abcdefé"), ("y", "defghij"), ("z", "opqrsабв"))}
    text = lambda lang, n: " ".join(r.choice(words[lang], n))
    a, b, c = langid.letters(0, langid.DIMENSIONS)

    def vector(text, weigh):
        grams, counts = langid.gram_counts(text)
        n = langid.SYMBOLS
        return sum(w * a[g // n**2] * b[g // n % n] * c[g % n] for g, w in zip(grams.tolist(), weigh(counts), strict=True))

    def unit(v):
        return v / np.linalg.norm(v)

    root = lambda counts: np.sqrt(counts) / np.sqrt(counts.sum())
    sums = np.array([sum(vector(text(lang, 80), root) for _ in range(5)) for lang in words])
    profiles = langid.Profiles(list(words), sums, 0, langid.DIMENSIONS)
    center = np.mean([unit(s) for s in sums], axis=0)
    for lang in words:
        for n in (1, 12, 150):
            t = text(lang, n)
            cosines = [unit(vector(t, np.sqrt)) @ unit(unit(s) - center) for s in sums]
            got, score = profiles.predict(t)
            assert got == list(words)[int(np.argmax(cosines))]
            # The norm is that of vectors without chance overlap.
            assert abs(score - (0.5 + 0.5 * max(cosines))) < 0.04


def test_language_id_und(docs):
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert all(got[r[0]] == "und" for r in ROWS if not any(c.isalpha() for c in r[1] or ""))


def test_media(docs):
    got = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.store(p)).hexdigest() and r.feature.startswith("audio/wav")


def test_sniffing_corrects_and_carves():
    wav = media.store(b"abcd")
    assert media.sniff(wav, "image/png").corrected and not media.sniff(wav, "audio/wav").corrected
    s = media.sniff(b"junk RIFF BM " + wav + b" tail", "text/plain")
    assert [(f.kind, f.start, f.length) for f in s.carved] == [("audio/wav", 13, len(wav))]
    assert media.sniff(None).kind == "application/x-empty" and media.sniff(b"RIFF").kind == "text/plain"


def test_shards(docs):
    rows = sharding.shard(docs, 4).collect()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    by = {r.doc_id: (r.shard, r.slot) for r in rows}
    assert all(by[r[0]] == sharding.place(i, len(ROWS), 4) for i, r in enumerate(sorted(ROWS)))
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100])
def test_permutation(n):
    assert sorted(sharding.place(i, n, 1)[1] for i in range(n)) == list(range(n))


def test_pack(docs):
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), capacity=256).collect()
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ROWS}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    bins = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256


def test_plan_keeps_every_constraint():
    counts = np.zeros(101, np.int64)
    counts[[10, 35, 60, 90]] = [40, 7, 5, 3]
    for rule in ("norm", "dot"):
        for n, inside in packing.plan(counts, 100, 3, 5000 + 4000, rule, (1.0, 0.5, 0.5)):
            assert n and sum(inside) <= 100 and len(inside) <= 3 and sum(x * x for x in inside) <= 9000


def one_by_one(lengths, capacity, max_docs, max_cost, rule):
    """Vector best-fit, a piece at a time; of bins that tie, the first."""
    scale, w = (capacity, max_docs, max_cost), packing.WEIGHTS
    bins, left = [], []
    for length in sorted(lengths, reverse=True):
        item, best = (length, 1, length * length), None
        for i, room in enumerate(left):
            if all(r >= x for r, x in zip(room, item, strict=True)):
                after = [(r - x) / s for r, x, s in zip(room, item, scale, strict=True)]
                score = -sum(a * a * c for a, c in zip(after, w, strict=True)) if rule == "norm" else sum(r / s * c * x / s for r, s, c, x in zip(room, scale, w, item, strict=True))
                if best is None or score > best[0] + 1e-12:
                    best = score, i
        if best is None:
            bins.append([])
            left.append(scale)
            best = 0, len(bins) - 1
        bins[best[1]].append(length)
        left[best[1]] = tuple(r - x for r, x in zip(left[best[1]], item, strict=True))
    return sorted(map(tuple, bins))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_is_best_fit_one_by_one(rule):
    r = np.random.default_rng(4)
    for trial in range(12):
        capacity = int(r.integers(40, 200))
        lengths = r.integers(1, capacity + 1, int(r.integers(1, 160)))
        for max_docs, max_cost in ((capacity, capacity**2), (4, capacity**2 * 2 // 3 + capacity)):
            some = [int(x) for x in (lengths if trial % 2 else np.maximum(1, lengths**2 // capacity)) if x * x <= max_cost]
            got = packing.plan(np.bincount(some, minlength=capacity + 1), capacity, max_docs, max_cost, rule)
            assert sorted(tuple(c) for n, c in got for _ in range(n)) == one_by_one(some, capacity, max_docs, max_cost, rule)


def test_plan_weighs_every_dimension():
    counts = np.bincount(np.random.default_rng(1).integers(1, 60, 400), minlength=101)
    own, tokens = packing.plan(counts, 100, 100, 10000), packing.plan(counts, 100, 100, 10000, weights=(1.0, 0.0, 0.0))
    assert own != tokens and sum(n for n, _ in own) <= sum(n for n, _ in tokens)


def test_lm_score(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (7, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, labels).collect()}
    assert len(rows) == len(ROWS)
    assert all(r.n_tokens == len((t or "").encode().split()) for i, t, *_ in ROWS for r in [rows[i]])
    assert rows[4].score > rows[40].score  # a copy of the target against unrelated text


def test_lm_score_counts_every_word_and_bigram_apart(spark):
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(6000)}" if r.random() < 0.7 else r.choice(["the", "of", "and"]) for _ in range(150)) for _ in range(60)]
    texts += [texts[0], None, "", "alone"]
    rows = [(i, t) for i, t in enumerate(texts)]
    good = {i for i in range(len(rows)) if i % 4 == 0}
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    words = {i: (t or "").encode().split() for i, t in rows}
    size = len({w for ws in words.values() for w in ws})
    l2, l1, l0 = lm_score.LAMBDAS
    for i, ws in words.items():
        for name, ids in (("ce_target", good), ("ce_background", set(words))):
            others = [words[j] for j in ids if j != i]
            uni, pair = Counter(w for o in others for w in o), Counter(p for o in others for p in zip(o, o[1:], strict=False))
            loss = 0.0
            for j, w in enumerate(ws):
                one = uni[w] / max(uni.total(), 1)
                two = min(1.0, pair[ws[j - 1], w] / max(uni[ws[j - 1]], 1)) if j else one
                loss -= np.log(l2 * two + l1 * one + l0 / size)
            assert abs(getattr(got[i], name) - loss / max(len(ws), 1)) < 1e-9


EVERY = [
    lambda s, d: lm_score.cross_entropy_difference(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    lambda s, d: jaccard_join.join(d),
    lambda s, d: suffix_dedup.dedup(d),
    lambda s, d: fingerprint.fingerprint(d),
    lambda s, d: mixing.mix(d),
    lambda s, d: token_io.token_files(d, tokenizer_file("word_bpe_49k.json")),
    lambda s, d: langid.identify(d),
    lambda s, d: media.media_digests(d),
    lambda s, d: sharding.shard(d),
    lambda s, d: packing.pack(d, tokenizer_file("byte_bpe_50k.json")),
]


CLASHES = ("_t", "_n", "_w", "_p", "_k", "_size", "_i", "_rn", "_x", "_r", "_qscope_n", "_qscope_c", "row", "size", "taken", "nth", "words", "new", "k", "rep", "h", "c", "ranges", "found", "component", "part", "block", "sig", "score", "target", "piece", "length")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(*r[:5], *range(len(CLASHES))) for r in ROWS[:12]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)).cache()


@pytest.mark.parametrize("i", range(10))
def test_columns_of_any_names(spark, clashing, i):
    plain = EVERY[i](spark, clashing.select("doc_id", "text", "lang", "source", "n_chars"))
    assert sorted(map(str, EVERY[i](spark, clashing).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns_of_any_names(spark, clashing, stage):
    for rows in (clashing, clashing.unionAll(clashing.limit(3))):
        out = stage[1](spark, rows, "")
        assert out.columns == clashing.columns
        assert all(list(r[5:]) == list(range(len(CLASHES))) for r in out.collect())


def test_mix_documents_pairs_repeated_rows(spark):
    rows = [(1, "a b c d", "s", 1), (1, "e f g h", "s", 2), (None, "i j k l", "s", 3), (None, "i j k l", "s", 4), (5, "m n o p q", "t", 5), (1, "r s t u", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x int")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    got = Counter()
    for r in mixing.mix_documents(docs).collect():
        got[r.source] += len(r.text.split())
    assert got == want


@pytest.mark.parametrize("i", range(10))
def test_empty_and_repeated(spark, empty, repeated, i):
    assert EVERY[i](spark, empty).count() == 0
    assert EVERY[i](spark, repeated).count() == 5


def test_pipeline_stages(spark, docs):
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, d = d, stage(spark, d, "").cache()
        assert d.columns == docs.columns, name
        if name == "near_duplicates":
            rows = [tuple(r) for r in before.collect()]
            assert {r.doc_id for r in d.collect()} == {i for i, (_, c) in components(rows).items() if i == c}
        if name == "repeated_passages":
            gone = removal([tuple(r) for r in before.collect()])
            for r in d.collect():
                n, cut, _, _ = gone[r.doc_id]
                assert 0 <= len((r.text or "").encode()) - (n - cut) <= 6 * cut
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() >= d.count()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_pipeline_stage_odd_tables(spark, empty, repeated, stage):
    assert stage[1](spark, empty, "").count() == 0
    out = stage[1](spark, repeated, "")
    assert out.columns == repeated.columns
    out.collect()


@pytest.mark.parametrize(("name", "drop_space"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_are_the_librarys(name, drop_space, monkeypatch):
    monkeypatch.setattr(tokens, "SPAN_CHARS", 7)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    path = tokenizer_file(name)
    library, own = Tokenizer.from_file(path), tokens.PieceEncoder(path, drop_space, 2)
    library.encode_special_tokens = True
    latin = "".join(map(chr, range(256)))

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=30), st.text(alphabet=latin, max_size=30), st.text(alphabet=" \n\t\r\x1c\x85\xa0aB's\u00e91.!,&\u0120\u65e5", max_size=20)))
    def same(text):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]

    same()


def test_texts_together_are_the_librarys(monkeypatch):
    monkeypatch.setattr(tokens, "SPAN_CHARS", 20)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    monkeypatch.setattr(tokens, "CALL_WORDS", 3)
    path = tokenizer_file("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.PieceEncoder(path, True, 2)
    library.encode_special_tokens = True
    latin = "".join(map(chr, range(0x250)))

    def same(texts):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all(texts)]
        assert got == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]

    letters = " ".join(latin)
    same([letters, letters.replace(" ", "x "), letters.replace(" ", "!A ")])
    texts = st.one_of(st.text(max_size=30), st.text(alphabet=latin + " " * 100, max_size=60), st.text(alphabet=" \nabAB,.!'\u00e9\u0130\u0301\u03a3\u1e9e\u212b", max_size=40))
    settings(max_examples=200, deadline=None)(given(st.lists(texts, max_size=6))(same))()


def test_new_words_go_to_the_library_together(monkeypatch):
    single, one = [], tokens.PieceEncoder._word
    monkeypatch.setattr(tokens.PieceEncoder, "_word", lambda self, word: (single.append(word), one(self, word))[1])
    monkeypatch.setattr(tokens, "_encoders", {})
    rng, path = np.random.default_rng(5), tokenizer_file("word_bpe_49k.json")
    texts = [" ".join("".join(rng.choice(list("aeinrst\u00e9\u00df"), 9)) + "," for _ in range(50)) for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 10, pa.int32()), pa.array(range(10), pa.int64()), pa.array(texts)], names=["bucket", "k", "text"])
    (file,) = token_io._encode(path, 2, False)(iter([batch]))
    t = Tokenizer.from_file(path)
    assert token_io.read_ids(file["ids"][0].as_py()).tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
    assert single == [","]


def test_texts_together_keep_their_spaces(monkeypatch):
    for name, n in (("SPAN_CHARS", 20), ("CACHE_WORDS", 40), ("CACHE_PIECES", 40), ("CALL_WORDS", 3)):
        monkeypatch.setattr(tokens, name, n)
    path = tokenizer_file("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokens.PieceEncoder(path, False, 2)
    library.encode_special_tokens = True
    latin = "".join(map(chr, range(0x250)))

    def same(texts):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all(texts)]
        assert got == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]

    letters = " ".join(latin)
    same([letters, letters.replace(" ", "x "), letters.replace(" ", "!A "), letters.replace(" ", "\nB "), "\nA\nb c\n", "\n\nA b\n\n\nc", "a" * 50 + "\n" + "b" * 50 + "\n", ""])
    texts = st.one_of(st.text(max_size=30), st.text(alphabet=latin + " \n" * 50, max_size=60), st.text(alphabet=" \nabAB,.!'\u00e01\u0130\u0301\u03a3\u00a0\u65e5", max_size=40), st.lists(st.sampled_from(["a", "\u00e9t\u00e9", "No,", "it's", "1,2.", "!?", "\n", "\nThe"]), max_size=20).map(" ".join).map(lambda t: t.replace(" \n", "\n")))
    settings(max_examples=300, deadline=None)(given(st.lists(texts, max_size=6))(same))()


def test_new_words_with_spaces_go_to_the_library_together(monkeypatch):
    single, one = [], tokens.PieceEncoder._word
    monkeypatch.setattr(tokens.PieceEncoder, "_word", lambda self, word: (single.append(word), one(self, word))[1])
    monkeypatch.setattr(tokens, "_encoders", {})
    rng, path = np.random.default_rng(6), tokenizer_file("byte_bpe_50k.json")
    texts = ["".join("".join(rng.choice(list("aeinrst\u00e9\u00df"), 9)) + end for end in [", ", ".\n", " "] * 20) + "End" for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array(range(10), pa.int64()), pa.array(texts)], names=["k", "doc_id", "text"])
    (out,) = packing.cut(path, 2, 1 << 20)(iter([batch]))
    t = Tokenizer.from_file(path)
    assert out["ids_crc32"].to_pylist() == [zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for x in texts]
    assert single == ["\n"]


@pytest.mark.parametrize("merge", [("a", "\u0120"), ("\u010a", "b"), ("a", "b"), ("\u0120", "b")])
def test_words_that_would_merge_together_are_made_apart(merge, tmp_path):
    vocab = {c: i for i, c in enumerate([*tokens.byte_letters().values(), "".join(merge)])}
    t = Tokenizer(BPE(vocab, [merge]))
    t.pre_tokenizer = ByteLevel(add_prefix_space=False)
    t.save(path := str(tmp_path / "t.json"))
    own = tokens.PieceEncoder(path, False, 2)
    for text in ("ba ab ba\nba, b\nb", "a b a\na b"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_runs_take_bounded_memory():
    words = np.random.default_rng(3).integers(97, 123, 3 << 20, np.uint8)
    off = np.array([0, 1 << 20, 3 << 20])
    tracemalloc.start()
    try:
        found = sum(len(key) for key, *_ in suffix_dedup.runs(words, off))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found > 1 << 16 and peak < 64 << 20
