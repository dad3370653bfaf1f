"""Brute-force checks of the operators that work on whole documents: 1, 6, 7, 9, 10 and the pipeline."""

import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lamella.llm import exact_dedup, mixing, packing, quality, simhash, word_model
from tests.llm.helpers import SCHEMA, WORD, awkward, empty, rows

SF = "/root/testdata/sf0.001"


# exact dedup


def expected_dedup(data):
    groups = defaultdict(list)
    for doc_id, text in data:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        ordered = sorted(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ordered):
            out[i, keep, len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_exact_dedup_awkward(spark, block):
    docs = awkward(spark)
    got = Counter(map(tuple, exact_dedup.exact_dedup(docs, block_bytes=block).collect()))
    assert got == expected_dedup([(r.doc_id, r.text) for r in docs.collect()])


def test_block_names_do_not_trust_the_routing_hash(spark):
    docs = spark.createDataFrame(rows("abcabcabd", "abcabcabd", "abcabcabe", "abd", "", None), SCHEMA)
    named = exact_dedup.block_identities(docs.select("doc_id", "text"), "text", 3, routing=lambda b: F.octet_length(b).cast("long"))
    ids = {r.row.doc_id: (r.level, r.name) for r in named.collect()}
    assert ids[0] == ids[1] != ids[2] and ids[4] == ids[5] and len(set(ids.values())) == 4


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(empty(spark)).collect() == [] == exact_dedup.drop_copies(empty(spark)).collect()


def test_drop_copies_keeps_one_row(spark):
    docs = awkward(spark)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted({r.text or "" for r in docs.collect()})


# mixing


def filled(sizes, weights, total):
    """Targets by resharing the excess again and again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        rest = total - sum(v for k, v in target.items() if k not in open_)
        share = {k: rest * weights[k] / sum(weights[j] for j in open_) for k in open_}
        above = {k for k in open_ if share[k] > 2 * sizes[k]}
        if not above:
            return target | share
        for k in above:
            target[k] = 2.0 * sizes[k]
        open_ -= above
    return target


def check_mix(spark, docs):
    got = mixing.mix(docs, carry=("doc_id", "source", "text")).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.row.text or ""))
        sizes[r.row.source] += r.size
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(ranked)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(targets[r.row.source])
        assert 0 <= r.taken <= 2 * r.size and sum(r.takes) == r.taken
        assert all((p is None) == (t == 0) and (p is None or 0 <= p <= 1) for p, t in zip(r.positions, r.takes, strict=True))
        taken[r.row.source] += r.taken
    assert all(targets[s] - 1 <= taken[s] <= targets[s] for s in sizes)
    return got


def test_mix(spark):
    check_mix(spark, awkward(spark))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(str, check_mix(spark, docs))) == sorted(map(str, check_mix(spark, docs.repartition(5))))
    assert mixing.mix(empty(spark)).collect() == []


def test_demand_is_inverted(spark):
    for knots in mixing.SCHEDULES:
        t = np.linspace(0, 1, 20001)
        w = np.interp(t, *zip(*knots, strict=True))
        area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))))
        q = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
        got = spark.createDataFrame([(x,) for x in q], "q double").select(mixing.inverse_demand(F.col("q"), knots)).collect()
        assert np.allclose([r[0] for r in got], np.interp(q, area / area[-1], t), atol=1e-4)


def test_mixed_documents_have_the_words_taken(spark):
    docs = awkward(spark)
    want = sum(r.taken for r in mixing.mix(docs).collect())
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in got.collect()) == want


# near copies


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def check_near(docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [plain_fingerprint(t) for _, t in data]
    distinct = sorted(set(fps))
    root = plain_components([p for p in itertools.combinations(distinct, 2) if (p[0] ^ p[1]).bit_count() <= 2], distinct)
    least = {}
    for (i, _), f in zip(data, fps, strict=True):
        least[root[f]] = min((x for x in (least.get(root[f]), i) if x is not None), default=None)
    want = Counter((i, f"{f:016x}", least[root[f]]) for (i, _), f in zip(data, fps, strict=True))
    got = simhash.near_copies(docs)
    assert Counter(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect())) == want
    assert got.where("kept").select("doc_id", "text_hash").distinct().count() == len({root[f] for f in fps})


def test_near_copies(spark):
    check_near(awkward(spark))
    check_near(spark.read.parquet(f"{SF}/documents.parquet"))
    assert simhash.near_copies(empty(spark)).collect() == []


def test_links_join_all_within_two_bits(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(25):
            g = f
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3, 5])):
                g ^= 1 << b
            fps.add(g)
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, a, 5)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.simhash_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all((a ^ b) & (2**64 - 1) for a, b in links)
    got = plain_components([tuple(r) for r in links], signed)
    want = plain_components([(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2], signed)
    classes = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert classes(got) == classes(want)


def test_drop_near_copies(spark):
    docs = awkward(spark)
    kept = simhash.near_copies(docs).where("kept").select("doc_id", "text_hash").distinct().count()
    assert simhash.drop_near_copies(docs).count() == kept


def plain_similar(data):
    """Ids that stay: the smallest of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in data:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    pairs = [(i, j) for i, j in itertools.combinations(range(len(data)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root, least = plain_components(pairs, range(len(data))), {}
    for i, r in root.items():
        order = (data[i][0] is None, data[i][0] or 0)
        least[r] = min(least.get(r, order), order)
    return [None if missing else i for missing, i in least.values()]


def test_similar_copies(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 20, 60, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for i in rng.sample(range(len(copy)), rng.choice([0, 1, 2, 4]) if len(copy) > 20 else 0):
                copy[i] = word().upper()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    docs = spark.createDataFrame(rows(*texts, None, "", " ", "one", ids=[*range(len(texts)), 901, 902, 903, None]), SCHEMA).repartition(3)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    left = simhash.drop_similar(docs)
    assert left.columns == docs.columns and sorted(map(str, plain_similar(data))) == sorted(str(r.doc_id) for r in left.collect())
    assert sorted(str(r.doc_id) for r in simhash.drop_similar(awkward(spark)).collect()) == sorted(map(str, plain_similar([(r.doc_id, r.text) for r in awkward(spark).collect()])))
    assert simhash.drop_similar(empty(spark)).collect() == []


def test_similar_families(spark):
    """No link is lost in a star whose copies lie up to 0.8 apart and in a chain of small steps, both in few buckets; also where a number is dealt into slices."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]

    def changed(text, n):
        text = list(text)
        for i in rng.sample(range(300), n):
            text[i] = rng.choice(words)
        return text

    star = [changed(base, rng.randrange(3, 8)) for _ in range(300)]
    chain = [[rng.choice(words) for _ in range(300)]]
    while len(chain) < 300:
        chain.append(changed(chain[-1], 4))
    for texts, most in ((star + chain, 8192), (star[:60] + chain[:20], 9)):
        data = list(enumerate(" ".join(t) for t in texts))
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
        pairs = [(i, j) for i, j in itertools.combinations(range(len(data)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        root = plain_components(pairs, range(len(data)))
        docs = spark.createDataFrame([(t,) for _, t in data], "text string").repartition(4)
        links = simhash.similar_links(docs, most=most)
        ids = {r.node: r.t for r in docs.select(F.xxhash64("text").alias("node"), F.col("text").alias("t")).collect()}
        at = {t: i for i, t in data}
        found = plain_components([(at[ids[r.a]], at[ids[r.b]]) for r in links.collect()], range(len(data)))
        assert sum(found[a] == found[b] for a, b in pairs) >= 0.99 * len(pairs)
        assert len(set(found.values())) == len(set(root.values()))


@pytest.mark.parametrize("common", [0, 60, 100])
def test_whole_sets_in_a_task(common):
    """Shares are those of Python's sets, and numbering shingles takes less memory than four times their own."""
    rng = np.random.default_rng(common)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 120)
    sets = [np.sort(np.concatenate((rng.choice(base, common, replace=False), rng.integers(-(1 << 63), (1 << 63) - 1, 400 - common)))) for _ in range(1000)]
    sets += sets[:1] + [base[:1]]
    tracemalloc.start()
    share = simhash._exact(sets, 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(x.nbytes for x in sets)
    for i in (0, 1, 1001):
        near = np.array([j for j in range(1002) if j != i])
        some = set(sets[i].tolist())
        want = [len(some & set(sets[j].tolist())) / len(some | set(sets[j].tolist())) for j in near]
        assert share(i, near).tolist() == [w if w >= 0.05 else 0 for w in want]


def test_similar_links_of_a_crowd_nearly_similar(spark, monkeypatch):
    """Copies mostly just under the similarity: pairs to verify grow with the texts, not with their square, and no link is lost; also in slices by shingles."""
    rng = random.Random(33)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for k in range(150):
        text = list(base if k < 110 else texts[k - 110])
        for i in rng.sample(range(300), 4 if k < 110 else 3):
            text[i] = rng.choice(words)
        texts.append(text)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    every = itertools.combinations(range(len(texts)), 2)
    root = plain_components([(i, j) for i, j in every if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])], range(len(texts)))
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "text string").repartition(4)
    ids = {r.t: r.node for r in docs.select(F.xxhash64("text").alias("node"), F.col("text").alias("t")).collect()}
    at = {ids[" ".join(t)]: i for i, t in enumerate(texts)}
    plain, sent = simhash._verified, []

    def counted(pairs, *more):
        sent.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(simhash, "_verified", counted)
    for shingles in (simhash.SHINGLES, 20_000):
        monkeypatch.setattr(simhash, "SHINGLES", shingles)
        sent.clear()
        links = [(at[r.a], at[r.b]) for r in simhash.similar_links(docs).collect()]
        assert all(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i, j in links)
        assert plain_components(links, range(len(texts))) == root
        assert sum(sent) <= simhash.ORDERS * len(texts)


# packing


def check_packing(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[r.doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.packed(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins), sum(r.length for r in got)


def test_packing(spark):
    bins, tokens = check_packing(spark.read.parquet(f"{SF}/documents.parquet"))
    assert bins <= 1.06 * tokens / 2048 + 2
    check_packing(awkward(spark))
    odd = ["a\x1cb \x85 \xa0x don't 'LL we'Re <|endoftext|>a <|startoftext|> é İ Σας ΑΣ x́ ́y 12ab a|b", "\x1c\x1d", "ÀÖ×÷Øþß '`^~ É's"]
    rng = random.Random(1)
    odd += ["".join(rng.choice("aB'sT<|endofx>12 \x1c\x1f\x85éÉ×́ \t!?#$") for _ in range(80)) for _ in range(100)]
    check_packing(spark.createDataFrame(rows(*odd), SCHEMA))
    assert packing.packed(empty(spark)).collect() == []


def test_packer_takes_the_tightest_bin_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 5, 4, 10, 9, 5, 1)] == [(0, 0), (1, 0), (0, 6), (2, 0), (3, 0), (1, 5), (3, 9)]
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (8, 7, 6, 2)] == [(0, 0), (1, 0), (2, 0), (1, 7)]


# quality


def plain_word_model(texts):
    """Interpolated modified Kneser-Ney log-probability of a text, pair by pair, by dictionaries."""
    seqs = [["<s>", *WORD.findall(t), ""] for t in texts]
    pairs = Counter((s[i - 1], s[i]) for s in seqs for i in range(1, len(s)))
    words = Counter(c for _, c in pairs)

    def discounts(counts):
        n = [sum(v == j for v in counts.values()) for j in range(1, 5)]
        if not (n[0] and n[1]):
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.9]
        return [min(max(x, 0.1), j - 0.05) for j, x in enumerate(raw, 1)]

    d1, d2, follow = discounts(words), discounts(pairs), defaultdict(list)
    for (b, _), v in pairs.items():
        follow[b].append(v)
    every = sum(words.values())

    def left(v, d):
        return sum(d[min(x, 3) - 1] for x in v)

    def less(v, d):
        return v - d[min(v, 3) - 1] if v else 0

    unseen, weight = left(words.values(), d1) / every / (len(words) + 1), {b: left(v, d2) / sum(v) for b, v in follow.items()}
    total = {b: sum(v) for b, v in follow.items()}

    def one(c):
        return less(words[c], d1) / every + unseen

    def two(b, c):
        if b not in follow:
            return one(c)
        return less(pairs[b, c], d2) / total[b] + weight[b] * one(c)

    def mean(text):
        s = ["<s>", *WORD.findall(text), ""]
        return -sum(np.log(two(s[i - 1], s[i])) for i in range(1, len(s))) / (len(s) - 1)

    return mean


def hash_of(spark, texts):
    return {r.text: r.h for r in spark.createDataFrame([(t,) for t in set(texts)], "text string").select("text", F.xxhash64("text").alias("h")).collect()}


def test_word_model(spark):
    rng = random.Random(6)
    words = [f"w{i}é," for i in range(60)]
    text = lambda extra=(): " ".join(rng.choice(words + list(extra)) for _ in range(rng.randrange(1, 60)))
    trusted = [text() for _ in range(60)]
    asked = [text(("NEW!", "||", "x" * 30)) for _ in range(30)] + trusted[:5] + ["  \n ", "w1é,", "word " * 3000, asked_twice := text(), asked_twice]
    mean = plain_word_model(trusted)
    terms, unknown = word_model.fit(spark.createDataFrame([(t,) for t in trusted], "text string").repartition(3))
    grams = {g for t in trusted for s in [["<s>", *WORD.findall(t), ""]] for i in range(1, len(s)) for g in ((s[i],), (s[i - 1], s[i]))}
    assert terms.count() == len(grams) + 1  # none is left out; the start has a row as a context
    docs = spark.createDataFrame([(t,) for t in asked] + [(None,), ("",)], "text string").repartition(3)
    ids = hash_of(spark, asked)
    for frequent in (1, 50, 1 << 17):  # joined and looked up
        got = {r.text_id: r.nll for r in word_model.scores(docs, terms, unknown, frequent).collect()}
        assert set(got) == set(ids.values()) and all(np.isclose(got[ids[t]], mean(t), rtol=1e-5) for t in asked)


def test_rare_words_meet_by_join(spark, monkeypatch):
    trusted = ["a b c d e a b", "b c d e f", "c a a b", "x y z a"]
    want = {tuple(r) for r in word_model.fit(spark.createDataFrame([(t,) for t in trusted], "text string"))[0].collect()}
    monkeypatch.setattr(word_model, "FREQUENT_WORDS", 2)
    assert {tuple(r) for r in word_model.fit(spark.createDataFrame([(t,) for t in trusted], "text string"))[0].collect()} == want


def test_texts_meet_terms_in_arrays():
    """A row for each slice and group, not for each text and word; sums are those of a dictionary."""
    rng, ids = np.random.default_rng(4), [7, -9, 1 << 40]
    term = {int(k): float(np.float32(v)) for k, v in zip(rng.integers(-(1 << 62), 1 << 62, 50), rng.normal(size=50), strict=True)}
    keys = [rng.choice([*term, 1, 2], 20).tolist() for _ in ids]
    raw = lambda x, t: np.array(x, t).tobytes()
    asked = {"ids": [raw(ids, np.int64)] * 2, "sizes": [raw([20] * 3, np.int32), bytes(12)], "keys": [raw(sum(keys, []), np.int64), b""], "base": [None, raw([1, 2, 3], float)], "tokens": [None, raw([4, 5, 6], np.int64)]}
    terms = pa.table({"key": pa.array(list(term), pa.int64()), "term": pa.array(list(term.values()), pa.float32())})
    met = word_model._met(2)(pa.table(asked), terms)
    assert met.num_rows <= 2
    got = dict(zip(*(word_model._means(met).column(c).to_pylist() for c in ("text_id", "nll")), strict=True))
    assert set(got) == set(ids) and all(np.isclose(got[i], -(k + 1 + sum(term.get(x, 0) for x in keys[k])) / (k + 4)) for k, i in enumerate(ids))


def test_quality_by_brute_force(spark):
    """Perplexity, threshold and verdict of each document."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    data, good = docs.collect(), {r.doc_id for r in labels.where("quality = 1").collect()}
    ids = hash_of(spark, [r.text for r in data])
    mean = plain_word_model([r.text for r in data if r.doc_id in good and ids[r.text] % quality.HELD_OUT])
    nll, limit = {t: mean(t) for t in ids}, {}
    for lang in {r.lang for r in data}:
        own = [r for r in data if r.lang == lang and r.doc_id in good]
        own = [r for r in own if ids[r.text] % quality.HELD_OUT == 0] or own
        if own:
            limit[lang] = np.quantile([np.ceil(nll[r.text] * quality.BINS) for r in own], quality.QUANTILE) / quality.BINS
    got = {r.row.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(data)
    for r in data:
        out = got[r.doc_id]
        assert np.isclose(np.log(out.perplexity), nll[r.text], rtol=1e-5)
        assert (out.threshold is None) == (r.lang not in limit) and (out.threshold is None or abs(np.log(out.threshold) - limit[r.lang]) < 2 / quality.BINS)
        assert out.rejected == (out.threshold is not None and out.perplexity > out.threshold)
    kept = {r.doc_id for r in quality.good_documents(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, 1), (11, 0, None), (12, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and sum(r.perplexity is None for r in got) == 2
    assert not any(r.rejected for r in got if r.perplexity is None)
    none = quality.classify(docs, labels.where("doc_id < 0")).collect()
    assert not any(r.rejected for r in none) and all(r.threshold is None for r in none)
    assert quality.classify(empty(spark), labels).collect() == []
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_quality_separates(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).select("row.doc_id", "rejected").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("rejected").cast("int"))).collect()
    share = dict(map(tuple, got))
    assert share[1] < 0.02 and share[0] > 0.9


# pipeline


def test_pipeline_of_awkward_and_empty_tables(spark):
    """Null and empty texts, texts of 45 KB, ties, repeated rows and clashing names go through every stage; so does nothing."""
    docs, nothing = awkward(spark), empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs, nothing = docs, corpus_pipeline.saved(stage(spark, docs, SF), "test"), stage(spark, nothing, SF)
        assert docs.columns == before.columns == nothing.columns and nothing.isEmpty()
    texts = {r.text for r in docs.collect()}
    assert texts and all(t.strip() for t in texts) and len(texts) >= 4  # texts without words are never taken by the mix
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, docs, SF).where("piece = 0").count() == docs.count() and packed(spark, nothing, SF).isEmpty()


def test_pipeline_stages(spark):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.saved(stage(spark, docs, SF), "test")
        assert docs.columns == before.columns
        if name == "exact dedup":
            assert sorted(r.text for r in docs.collect()) == sorted({r.text for r in before.collect()})
        if name == "simhash near-dedup":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(plain_similar([(r.doc_id, r.text) for r in before.collect()]))
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).where("piece = 0").collect()) == Counter(r.doc_id for r in docs.collect())
