"""Brute-force checks and round trips: operators 2, 3, 4, 5 and 8."""

import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamella.llm import lz_dedup, media, queries, recurrence, suffix_dedup, toxicity, warc, windows
from tests.llm.helpers import SCHEMA, WORD, awkward, empty, rows

SF = "/root/testdata/sf0.001"


# media


def check_media(docs):
    got = media.stored_and_probed(docs).collect()
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        want[r.doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
        assert media.read(media.container(full))[0].timescale == 8000
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for r in got:
        assert r.codec == "raw " and r.duration == r.payload_bytes and r.samples * 64 == r.payload_bytes
        assert len(r.keyframes) == -(-r.samples // 16) and all(k.size == 64 for k in r.keyframes)
    return got


def test_media(spark):
    check_media(awkward(spark))
    check_media(spark.read.parquet(f"{SF}/documents.parquet"))
    assert media.stored_and_probed(empty(spark)).collect() == []


def test_media_query(spark):
    """All columns of the query against files made and walked here; equal texts have equal values."""
    got = queries.op2_media(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = {}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        stored = media.container(data + bytes(-len(data) % 64 if data else 64))
        track, _ = media.read(stored)
        keys = ",".join(f"{o}+{n}" for o, n in zip(track.key_offsets, track.key_sizes, strict=True))
        want = ";".join([track.codec, f"{track.duration}/{track.timescale}", f"{len(track.key_offsets)}/{r.payload_bytes // 64}", hashlib.sha256(keys.encode()).hexdigest()])
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), want)
        assert seen.setdefault(data, tuple(r)[1:]) == tuple(r)[1:]
    assert len(got) == len(texts)


def test_media_keyframes_point_into_the_file():
    payload = random.Random(2).randbytes(64 * 777)
    data = media.container(payload)
    track, view = media.read(data)
    assert b"".join(track.payload(view)) == payload
    for k, (o, s) in enumerate(zip(track.key_offsets, track.key_sizes, strict=True)):
        assert data[o : o + s] == payload[k * 16 * 64 : k * 16 * 64 + 64]
    assert [b[0] for b in media.boxes(view, 0, len(view))] == [b"ftyp", b"moov", b"mdat"]


def test_media_reads_other_tables():
    """Sample sizes one by one, no sync table, wide chunk offsets, a version-1 header, boxes to the end of the file."""
    sizes, body = [5, 9, 7], b"abcdefghijklmnopqrstu"
    for shift in (0, 1):
        table = media._box(
            b"stbl", media._full(b"stsd", struct.pack(">I", 1), media._box(b"avc1", bytes(8))), media._full(b"stsz", struct.pack(">II3I", 0, 3, *sizes)),
            media._full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), media._full(b"co64", struct.pack(">IQQ", 2, shift, shift + 14)),
        )
        mdhd = media._box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQI", 0, 0, 600, 1200, 0))
        moov = media._box(b"moov", media._box(b"trak", media._box(b"mdia", mdhd, media._box(b"minf", table))))
    first = len(moov) + 8
    moov = moov.replace(struct.pack(">QQ", 1, 15), struct.pack(">QQ", first, first + 14))
    data = moov + struct.pack(">I4s", 0, b"mdat") + body
    track, view = media.read(data)
    assert (track.codec, track.timescale, track.duration) == ("avc1", 600, 1200)
    assert [data[o : o + s] for o, s in zip(track.key_offsets, track.key_sizes, strict=True)] == [b"abcde", b"fghijklmn", b"opqrstu"]
    for broken in (data[:-30], data[: len(moov) // 2], b"\0\0\0\4free", moov):
        with pytest.raises((ValueError, struct.error)):
            list(media.read(broken)[0].payload(memoryview(broken)))


# repeated byte strings


def plain_repeats(texts, window=400):
    where = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - window + 1):
            where[d[i : i + window]] += 1
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if where[d[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()


def check_repeats(docs, spec=suffix_dedup.SPEC):
    data = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(data, plain_repeats([r.text for r in data]), strict=True))
    assert Counter(map(tuple, suffix_dedup.remove_repeats(docs, spec).collect())) == want


def passages(seed, n, unit):
    """Texts sharing passages of many lengths around the window's, in different surroundings."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(k)) for k in (3, unit - 1, unit, unit + 1, 2 * unit, 5 * unit)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(" ".join(word() for _ in range(rng.randint(0, 3 * unit))))
            if rng.random() < 0.8:
                p = rng.choice(shared)
                a = rng.randint(0, len(p) // 3)
                parts.append(p[a : len(p) - rng.randint(0, len(p) // 3)])
        out.append(" ".join(parts))
    return out


def test_repeats(spark):
    check_repeats(awkward(spark))
    check_repeats(spark.read.parquet(f"{SF}/documents.parquet"))
    assert suffix_dedup.remove_repeats(empty(spark)).collect() == []


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_in_passages(spark, hot):
    spec = recurrence.Spec(100, 301, hot, suffix_dedup._units, suffix_dedup.SPEC.finish)
    texts = [*passages(4, 40, 90), "ab" * 700, "é" * 300, "x" * 399, "y" * 400, None]
    check_repeats(spark.createDataFrame(rows(*texts), SCHEMA).repartition(5), spec)


def test_shards_are_merged(spark):
    rng = random.Random(9)
    core = rng.randbytes(420)
    runs = [rng.randbytes(rng.randint(0, 90)) + core[rng.randint(0, 30) :] + rng.randbytes(rng.randint(0, 90)) for _ in range(60)]
    runs += [runs[3][:450], runs[7][5:440]]
    rows_ = sorted((0 if i % 3 else 1, b, i, 10 * i) for i, b in enumerate(runs) if len(b) >= 400)

    def found(size):
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int64()), pa.array([r[1] for r in rows_], pa.binary()), *(pa.array([r[k] for r in rows_], pa.int64()) for k in (2, 3))], names=["key", "body", "rid", "first"])
        return sorted(tuple(x) for b in suffix_dedup.resolve(iter([batch]), size) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))

    def spread(ranges):
        return {(r, i) for r, a, z in ranges for i in range(a, z + 1)}

    seen = Counter((k, b[i : i + 400]) for k, b, _, _ in rows_ for i in range(len(b) - 399))
    want = {(r, f + i) for k, b, r, f in rows_ for i in range(len(b) - 399) if seen[k, b[i : i + 400]] > 1}
    assert want and spread(found(1 << 20)) == want == spread(found(2000))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for alphabet, n in ((2, 900), (4, 2000), (200, 500)):
        data = rng.integers(0, alphabet, n).astype(np.uint8)
        data[300:450] = data[100:250]
        word, depth = suffix_dedup.words8(data), 64
        text = bytes(data) + bytes(depth)
        rank = suffix_dedup.suffix_array(word, depth)
        order = sorted(range(n - depth), key=lambda i: text[i : i + depth])
        for a, b in zip(order, order[1:], strict=False):
            assert (rank[a] < rank[b]) == (text[a : a + depth] < text[b : b + depth]) and (rank[a] == rank[b]) == (text[a : a + depth] == text[b : b + depth])
        begin, count = np.array([0, 200]), np.array([150, n - depth - 200])
        at = np.concatenate([b + np.arange(c) for b, c in zip(begin, count, strict=True)])
        sa = at[np.argsort(rank[at], kind="stable")]
        lcp = suffix_dedup.common_prefixes(word, begin, count, sa, depth, rank)
        for k in range(1, len(sa)):
            a, b = text[sa[k - 1] : sa[k - 1] + depth], text[sa[k] : sa[k] + depth]
            assert min(lcp[k], depth) == next((i for i in range(depth) if a[i] != b[i]), depth)


def test_window_runs():
    rng = np.random.default_rng(2)
    lengths = [0, 5, 12, 40, 300, 11, 0, 77]
    values = rng.integers(1, 4, sum(lengths)).astype(np.uint64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    text, first, last, key, twice = windows.runs(values, offsets, 5, 8)
    covered = [(t, i) for t, a, z in zip(text.tolist(), first.tolist(), last.tolist(), strict=True) for i in range(a, z + 1)]
    assert covered == [(t, i) for t, n in enumerate(lengths) for i in range(n - 11)]
    by_window = defaultdict(set)
    for t, a, z, h, w in zip(text.tolist(), first.tolist(), last.tolist(), key.tolist(), twice.tolist(), strict=True):
        own = [tuple(values[offsets[t] + i : offsets[t] + i + 12].tolist()) for i in range(a, z + 1)]
        assert w or len(set(own)) == len(own)
        for x in own:
            by_window[x].add(h)
    assert all(len(h) == 1 for h in by_window.values())


# repeated word sequences


def plain_duplicates(data):
    first, words = {}, [WORD.findall(t or "") for _, t in data]
    order = lambda i: (i is None, i or 0)
    for (i, _), w in zip(data, words, strict=True):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, order(i)), order(i))
    for (i, _), w in zip(data, words, strict=True):
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(i):
                gone.update(range(k, k + 13))
        yield i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


def check_duplicates(docs, spec=lz_dedup.SPEC):
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, lz_dedup.remove_duplicates(docs, spec).collect())) == Counter(plain_duplicates(data))


def test_duplicates(spark):
    check_duplicates(awkward(spark))
    check_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    assert lz_dedup.remove_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("hot", [20_000, 2])
def test_duplicates_in_passages(spark, hot):
    spec = recurrence.Spec(6, 8, hot, lz_dedup.word_units, lz_dedup._finish)
    texts = [*passages(6, 60, 13), "a b " * 40, "b a " * 40, None, " ", "a b " * 40]
    ids = [*range(60), 70, 61, 62, 63, None]
    random.Random(1).shuffle(ids)
    check_duplicates(spark.createDataFrame(rows(*texts, ids=ids), SCHEMA).repartition(5), spec)


def test_a_passage_that_all_documents_share(spark):
    """No anchor sends more texts than ``hot``, whatever surrounds the passage; results are those of brute force."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(100))
    texts = [" ".join([*(word() for _ in range(30)), passage, *(word() for _ in range(30))]) for _ in range(400)]
    docs = spark.createDataFrame(rows(*texts), SCHEMA).repartition(6)
    for spec, check, once in (
        (recurrence.Spec(6, 8, 50, lz_dedup.word_units, lz_dedup._finish), check_duplicates, lz_dedup._once),
        (recurrence.Spec(100, 301, 50, suffix_dedup._units, suffix_dedup.SPEC.finish), check_repeats, suffix_dedup._once),
    ):
        sent = recurrence.recurring(docs, spec, once)
        assert sent.where(F.col("kind") == recurrence.HOT).count() > 0
        assert all(r["count"] <= 50 for r in sent.where(F.col("kind") == recurrence.RUN).groupBy("key").count().collect())
        check(docs, spec)


def test_parsing_looks_across_factor_boundaries():
    w = [b"w%d" % i for i in range(60)]
    r = lz_dedup.Reference()
    r.add(w[:20])
    r.add(w[8:33])
    r.add(w[40:])
    assert r.spans(w) == [(0, 7), (8, 20), (40, 47)]


# toxicity


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels)
    scored = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    held = [r for r in scored if r.held_out]
    toxic = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    assert sum(toxic) > 0.88 * len(toxic) and sum(clean) < 0.02 * len(clean)


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (3, 0, 0), (None, 1, 1), (11, 0, None), (12, None, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and len({r.score for r in got if r.doc_id in (8, 9)}) == 1
    assert toxicity.score_toxicity(empty(spark), labels).collect() == []
    assert len(toxicity.score_toxicity(docs, labels.where("doc_id < 0")).collect()) == docs.count()


def small_network(seed):
    network, rng = toxicity.Network(seed), np.random.default_rng(seed)
    words = rng.integers(0, 40, 60)
    begins = np.array([0, 0, 1, 3, 20, 41, 60])
    network.embedding[:40] = rng.normal(0, 0.5, (40, toxicity.DIM))
    network.out[:] = rng.normal(0, 0.5, len(network.out))
    return network, words, begins, rng.integers(0, 2, 6).astype(float)


def plain_logit(network, words):
    """Filters slid over a text by loops; no window, or none above 0, leaves 0."""
    total = float(network.constant)
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(words) - w + 1):
                best = max(best, float(network.bias[k][f]) + sum(float(network.embedding[words[i + j]] @ network.filters[k][j][:, f]) for j in range(w)))
            total += best * float(network.out[k * toxicity.FILTERS + f])
    return total


def test_toxicity_forward_pass_and_gradients():
    network, words, begins, y = small_network(3)
    texts = [words[a:b] for a, b in zip(begins, begins[1:], strict=False)]
    want = [1 / (1 + np.exp(-plain_logit(network, t))) for t in texts]
    assert np.allclose(network.score(words, begins), want, atol=1e-5)

    def loss():
        p = np.array([1 / (1 + np.exp(-plain_logit(network, t))) for t in texts])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grad, rng, eps = network.gradients(words, begins, y), np.random.default_rng(1), 1e-2
    places = [(network.out, grad["out"])] + [(network.filters[k], grad[f"filter{k}"]) for k in range(3)] + [(network.bias[k], grad[f"bias{k}"]) for k in range(3)]
    full = np.zeros((40, toxicity.DIM), np.float32)
    full[grad["touched"]] = grad["embedding"]
    close = 0
    for value, own in [*places, (network.embedding[:40], full)]:
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            old = value[at]
            value[at] = old + eps
            up = loss()
            value[at] = old - eps
            down = loss()
            value[at] = old
            close += abs((up - down) / (2 * eps) - own[at]) < 2e-3
    assert close >= 46  # of 48; a step of eps may change which window is the largest


def test_toxicity_query(spark):
    """Every score of the query, from the text by plain loops over the network that the labels of the sample give."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    network, _ = toxicity.fit(docs, labels)
    power = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)]

    def bucket(word):
        h = sum(b * power[i & 63] for i, b in enumerate(word)) % (1 << 64)
        return ((h ^ h >> 32) * 0xD6E8FEB86659FD93 % (1 << 64)) >> 44

    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    for r in docs.collect():
        words = [bucket(w) for w in re.findall(rb"[a-z\x80-\xff]+", (r.text or "").encode().lower())]
        if len(words) < 60:
            total = plain_logit(network, words)
        else:
            x, total = network.embedding[words].astype(float), float(network.constant)
            for k, w in enumerate(toxicity.WIDTHS):
                conv = sum(x[j : len(x) - w + 1 + j] @ network.filters[k][j].astype(float) for j in range(w)) + network.bias[k]
                total += float(np.maximum(conv.max(axis=0), 0) @ network.out[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS])
        want = 1 / (1 + np.exp(-total))
        assert abs(got[r.doc_id].score - want) < 1e-4 and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(want - 0.5) < 1e-4 or got[r.doc_id].predicted == int(want >= 0.5)


def test_toxicity_learns_from_every_label(spark):
    """Each text has a word of its own; those of all rows to be trained on have an embedding, however the rows are dealt."""
    word = lambda i: "w" + "".join(chr(97 + int(c)) for c in str(i))
    docs = spark.createDataFrame([(i, f"{word(i)} {'vile' if i % 9 == 0 else 'kind'} words", "en") for i in range(5000)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    rows = toxicity.labelled(docs, labels).collect()
    assert {r.doc_id for r in rows} == {i for i in range(5000) if zlib.crc32(str(i).encode()) % 5}
    network, _ = toxicity.fit(docs, labels)
    own, _ = toxicity.hashed_words(pa.array([word(r.doc_id) for r in rows if not r.checked]))
    assert len(own) > 3000 and network.embedding[own].any(axis=1).all()
    again, _ = toxicity.fit(docs.repartition(3), labels.repartition(2))
    assert np.array_equal(network.embedding, again.embedding) and network.constant == again.constant


def test_toxicity_words():
    words, begins = toxicity.hashed_words(pa.array(["You, IDIOT! you", "", None, "l'été 12", "idiot" * 30]))
    assert begins.tolist() == [0, 3, 3, 3, 5, 6] and words[0] == words[2]
    alone, _ = toxicity.hashed_words(pa.array(["idiot"]))
    assert alone[0] == words[1]


# WARC


def plain_records(pages):
    least = {}
    for i, html in pages:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            least[b] = min(least.get(b, i), i)
    for i, html in pages:
        b = (html or "").encode()
        first = least.get(b, i) if len(b) >= 100 else i
        yield i, len(b), hashlib.sha256(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first


def check_warc(pages):
    assert Counter(map(tuple, warc.written_and_read(pages).collect())) == Counter(plain_records([(r.page_id, r.html) for r in pages.collect()]))


def test_warc(spark):
    check_warc(spark.read.parquet(f"{SF}/pages.parquet"))
    quoted = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    page = [(5, "u", "x" * 100), (4, "u\r\nWARC-Type: x", "x" * 100), (4, None, "x" * 100), (None, "v", "x" * 100), (1, "v", None), (2, "v", ""), (6, "v", "y" * 99), (7, "v", "y" * 99)]
    page += [(8, "q", quoted * 3), (9, "q", "WARC/1.1\r\n" + quoted * 2), (10, "q", quoted * 3), (None, "z", "n" * 200), (None, "z", "n" * 200), (11, "e", "é🙂\r\n\r\n" * 60)]
    check_warc(spark.createDataFrame([(*p, 1, "k") for p in page], "page_id long, url string, html string, at long, first string").repartition(3))
    check_warc(spark.createDataFrame([], "page_id long, url string, html string"))


def test_warc_files_are_bounded(spark, tmp_path):
    """Files are closed by bytes, so pages of any size make files of about one size; one record may be more."""
    rng = random.Random(2)
    pages = [(i, "u", rng.randbytes(rng.choice([10, 20_000, 100_000, 900_000])).hex()) for i in range(60)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write(docs, str(tmp_path / "out"), file_bytes=1 << 20)
    sizes = [len(warc.inflated(f.read_bytes())) for f in (tmp_path / "out").rglob("part-*")]
    assert max(sizes) < (1 << 20) + 1_900_000 and len(sizes) > 15 and sum(sizes) > sum(len(h) for *_, h in pages)
    got = warc.read(spark, str(tmp_path / "out")).select("page_id", "payload_digest").collect()
    assert sorted(map(tuple, got)) == sorted((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in pages)


def test_warc_foreign_ids_fail(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"".join(archive("1.1", ": ", [(1, b"x")])).replace(b"<urn:page:1>", b"<urn:uuid:1-2>"))
    with pytest.raises(Exception, match="urn:uuid:1-2"):
        warc.read(spark, str(tmp_path)).select("page_id").collect()


def test_reachable(spark):
    links = [("a", 0, 10), ("a", 10, 35), ("a", 12, 20), ("a", 20, 35), ("a", 35, 50), ("a", 50, 90), ("b", 5, 7), ("b", 7, 9), ("c", 0, 4), ("c", 0, 4)]
    got = warc.reachable(spark.createDataFrame(links, "file string, at long, next long")).collect()
    assert {tuple(r) for r in got} - {("a", 90), ("c", 4)} == {("a", 0), ("a", 10), ("a", 35), ("a", 50), ("c", 0)}


def test_reachable_stores_no_more_for_longer_chains(spark, monkeypatch):
    plain, stored = warc.checkpointed, []
    monkeypatch.setattr(warc, "checkpointed", lambda df: stored.append(df) or plain(df))
    for n in (2, 1000):
        stored.clear()
        links = [(f, 10 * k, 10 * k + 10) for f in ("a", "b") for k in range(n)] + [("a", 10 * k + 3, 10 * k + 13) for k in range(n)] + [("c", 7, 9)]
        got = warc.reachable(spark.createDataFrame(links, "file string, at long, next long").repartition(3)).collect()
        assert sorted(map(tuple, got)) == [(f, 10 * k) for f in ("a", "b") for k in range(n + 1)]
        assert len(stored) == 1


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def archive(version, colon, pages):
    out = []
    for i, body in pages:
        head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>"), ("Content-Length", str(len(body)))]
        out.append(f"WARC/{version}\r\n".encode() + b"".join(f"{k}{colon}{v}\r\n".encode() for k, v in head) + b"\r\n" + body + b"\r\n\r\n")
    return out


@pytest.mark.parametrize(("version", "colon"), [("1.0", ":"), ("1.1", ": "), ("1.0", ": \t")])
def test_warc_reads_other_archives(spark, tmp_path, version, colon):
    pages = [(i, b"page %d WARC/1.0\r\n" % i * 9) for i in range(5)]
    (tmp_path / "part-0.warc.gz").write_bytes(b"".join(map(gzip.compress, archive(version, colon, pages))))
    got = warc.read(spark, str(tmp_path)).select("page_id", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(i, len(b)) for i, b in pages]


@pytest.mark.parametrize("tail", [b"more", b"WARC/1.1\r\nContent-Length: 900\r\n\r\nshort"])
def test_warc_broken_archives_fail(spark, tmp_path, tail):
    (tmp_path / "part-0").write_bytes(b"".join(archive("1.1", ": ", [(1, b"x")])) + tail)
    with pytest.raises(ValueError, match="do not lead to its end"):
        warc.read(spark, str(tmp_path))
