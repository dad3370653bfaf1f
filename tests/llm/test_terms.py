"""Operators 11, 12 and 13 against plain Python, and the sorting they share."""

import html
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import divergence, html_text, phrases, queries, terms
from tests.llm.helpers import SCHEMA, awkward, empty

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# packing and sorting


def test_numbered():
    rng = random.Random(3)
    some = [bytes(rng.choices(b"ab\x00z", k=rng.choice([1, 2, 6, 7, 8, 14, 15, 16, 17, 40]))) for _ in range(3000)] + [b"a", b"a\x00", b"a\x00\x00", b"a" * 16, b"a" * 16 + b"\x00"]
    data = np.frombuffer(b"".join(some), np.uint8)
    ends = np.cumsum([len(x) for x in some])
    ids, order, first = terms.numbered(data, ends - [len(x) for x in some], ends)
    assert len(set(ids.tolist())) == len(set(some)) == len(first)
    assert all((ids[i] == ids[j]) == (some[i] == some[j]) for i, j in [(rng.randrange(3005), rng.randrange(3005)) for _ in range(20000)])
    assert (np.diff(ids[order]) >= 0).all() and all(a < b for a, b in zip(order, order[1:], strict=False) if ids[a] == ids[b])
    assert ids[first].tolist() == list(range(len(first)))


@pytest.mark.parametrize("seed", range(5))
def test_equal_partitions(seed):
    rng = np.random.default_rng(seed)
    n, depth = [1, 2, 50, 700, 3000][seed], 4
    keys = [rng.integers(1, 6, n) if seed % 2 else rng.integers(1, 200, n)]
    for _ in range(depth - 1):
        keys.append(np.where(keys[-1] > 0, rng.integers(0, 4, n), 0))
    got = phrases.equal_partitions(keys, np.arange(n))
    for d, (pointers, size) in enumerate(got):
        want = Counter(k for k in zip(*[x.tolist() for x in keys[: d + 1]], strict=True) if 0 not in k)
        assert Counter(dict(zip([tuple(int(x[p]) for x in keys[: d + 1]) for p in pointers], size.tolist(), strict=True))) == want
    assert [len(p) for p, _ in phrases.equal_partitions(keys, np.zeros(0, np.int64))] == [0] * depth


# source divergence


def plain_divergence(docs, least, top):
    groups, found, having, counts = set(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang, source].update(words)
        found[lang].update(words)
        having[lang].update(set(words))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in having[lang].items() if n >= least)
        v = len(kept)

        def share(of):
            n = sum(of[t] for t in kept)  # noqa: B023
            return {t: 1 + int(Fraction(1000000000 * (of[t] + 2), n + 2 * v)) for t in kept}  # noqa: B023

        every, mine = share(found[lang]), {s: share(counts[lang, s]) for g, s in groups if g == lang}
        for s, p in mine.items():
            f = lambda a, b: (a - b) ** 2 // (a + b)
            pair = [(o, sum(f(p[t], q[t]) for t in kept)) for o, q in mine.items() if o != s]
            term = [(t, f(p[t], every[t])) for t in kept if counts[lang, s][t] and p[t] > every[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, k))
    return out


def hard_documents(spark):
    rng = random.Random(8)
    words = ["Ab", "ab", "é", "Éa", "a-b", "x1y", "mañana", "漢字漢字漢字漢字", "longer" * 4, "longer" * 4 + "s", "[z]", "I'm", "q_q", "w" * 15, "w" * 16]
    out = [(i, " ".join(rng.choices(words, weights=range(15, 0, -1), k=rng.randrange(0, 25))), rng.choice(["en", "fr", None, "", "x"]), rng.choice(["s1", "s2", None, "", "ß"]), 0, 1, "a", "b", "c", 2, 3) for i in range(140)]
    return spark.createDataFrame(out + [(None, None, "xx", None, 0, 1, "a", "b", "c", 2, 3), (1, "ab ab", "xx", "t", 0, 1, "a", "b", "c", 2, 3)], SCHEMA)


def test_divergence(spark):
    for docs, least in ((hard_documents(spark), 4), (hard_documents(spark), 1), (awkward(spark), 2), (spark.read.parquet(f"{SF}/documents.parquet"), 10)):
        got = divergence.divergence(docs, least, 3).collect()
        want = plain_divergence([(r.lang, r.source, r.text) for r in docs.collect()], least, 3)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert divergence.divergence(empty(spark)).collect() == []


def test_divergence_slices(spark, monkeypatch):
    """Slices of any size add up."""
    batch = pa.record_batch({"lang": ["en"] * 6, "source": list("aabbab"), "text": ["x y x", "y", "", "z x", "x", "\x00 9"]})
    got = Counter()
    for r in divergence._count(batch).to_pylist():
        got[r["source"], r["term"], r["n"], r["docs"]] += 1
    assert got == Counter({("a", "x", 3, 2): 1, ("a", "y", 2, 2): 1, ("b", "x", 1, 1): 1, ("b", "z", 1, 1): 1})


# phrases


def plain_collocations(docs, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    counts[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, every in counts.items():
        candidates = {p: n for p, n in every.items() if len(p) > 1 and n >= least}
        dropped = {p[i : i + m] for p, n in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if n >= candidates[p[i : i + m]]}
        rows = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, x, y = min((1000 * a * totals[lang] // (every[p[:k]] * every[p[k:]]), k, every[p[:k]], every[p[k:]]) for k in range(1, len(p)))
                rows.append((" ".join(p), a, x, y, totals[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, k, *r) for k, r in enumerate(rows[:top], 1)]
    return sorted(out)


def test_collocations(spark):
    rng = random.Random(5)
    hot = "the very Common line of text here"
    texts = [" ".join(rng.choices(["a", "b", "c\x00", "c", "é", "new. york", "x\ty", "w" * 16, "p\x0bq", "A"], k=rng.randrange(0, 60))) + rng.choice([" ", ". ", "\n"]) + hot * rng.randrange(3) for _ in range(150)]
    rows = [(i, t, rng.choice(["en", "en", "de", None, "und"]), "s", 0, 1, "a", "b", "c", 2, 3) for i, t in enumerate([*texts, None, "", " \t. "])]
    docs = spark.createDataFrame(rows, SCHEMA)
    for data, least, longest, top, bits in ((docs, 12, 5, 2000, 1 << 26), (docs, 3, 5, 40, 64), (docs, 12, 3, 2000, 1 << 12), (awkward(spark), 2, 5, 2000, 1 << 20)):
        got = sorted(tuple(r) for r in phrases.collocations(data, least, longest, top, bits=bits).collect())
        assert got == plain_collocations([(r.lang, r.text) for r in data.collect()], least, longest, top)
    assert phrases.collocations(empty(spark)).collect() == []


def test_collocation_query(spark):
    got = sorted(tuple(r) for r in queries.op13_phrases(spark, SF).collect())
    assert got and got == plain_collocations([(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 100, 5, 2000)


# main text

LONG = "This sentence of the article has a number of words, commas and all, and goes on for a while. " * 3
STRIPPED = LONG.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body class="has-sidebar"><header><h1>Site</h1></header><div class="page with-sidebar"><div id="content"><h1>Title</h1><p>{LONG}<p>Short.<ul><li>one<li>two <a href=x>link</a></ul><p>{LONG}</p><div class="comments"><p>{LONG}</div></div>'
         f'<div class=sidebar><p>{LONG}</div></div><footer>(c)</footer>', ["Title", STRIPPED, "Short.", "one", "two link", STRIPPED]),
        (f"<div class=nav><a href=1>a</a><a href=2>b</a></div><div><a href=1>Home</a> <a href=2>News</a></div><h2>Head</h2><p>{LONG}<p>{LONG}<p>tiny<p>{LONG}", ["Head", STRIPPED, STRIPPED, "tiny", STRIPPED]),
        (f'<article><header><h1>T</h1></header><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</form><section id=comments><article class="comment">{LONG}</article></section><p>end</article>', ["T", STRIPPED, "end"]),
        (f'<main><p>{LONG}</p><p>a<br>b  \n c</p><table><tr><td>x<td>y</table></main><div class="cookie-notice"><p>We use cookies. {LONG}</div>', [STRIPPED, "a b c", "x", "y"]),
        (f'<nav>menu</nav><div class="post"><p>{LONG}</div><div class="post"><p>{LONG}</div><div class="ad">buy</div>', [STRIPPED, STRIPPED]),
        ("<div><p>a &amp; b&nbsp;c &lt;p&gt; &#x41;&eacute;</p></div>", ["a & b c <p> Aé"]),
        (f"<article><p>{LONG}</p><script>if (a<b) '<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><noscript>no</noscript><p>one</article>", [STRIPPED, "one"]),
        ("", []), ("<p>", []), ("just words", ["just words"]), ("<!-- cut", []), ("<p>a</p><p cla", ["a"]), ("<script>var a = '<p>x</p>'", []), ("<nav>only a menu</nav>", []),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == "\n\n".join(want)


def test_chunks(monkeypatch):
    """A page read in chunks of any size is the same page, also where constructs stay open over many of them."""
    page = f"<article><p>{LONG}&amp;{LONG}</p><!-- {'x' * 500} --><p>{'w ' * 400}<b>bold</b> end</p><script>{'1;' * 300}</script></article>"
    whole = html_text.main_text(page)
    for n in (1, 7, 64):
        monkeypatch.setattr(html_text, "CHUNK", n)
        assert html_text.main_text(page) == whole
    assert html_text.main_text("<p>" + "long " * 300000) == ("long " * 300000).strip()


def test_smoothed():
    ratio = np.array([0.0, 0, 9, 0, 0, 0, 3])
    got = html_text.smoothed(ratio, 1.0)
    for i in range(7):
        w = [np.exp(-((i - j) ** 2) / 2) if abs(i - j) <= 3 else 0 for j in range(7)]
        assert abs(got[i] - np.dot(w, ratio) / sum(w)) < 1e-12


def plain_article(page):
    """The article of the test pages, whose tags are known."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1)>", body.replace("<b>", "").replace("<br>", " "))
    return "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_extraction_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op12_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        want = plain_article(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_extraction_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<p>a 🙂</p>", "x", 1), (1, "u", "<p>a 🙂</p>", "x", 1), (None, None, None, None, None), (2, "v", "", "y", 2)]
    got = Counter(tuple(r) for r in html_text.extracted(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter({(1, "u", "a 🙂", 3): 2, (None, None, "", 0): 1, (2, "v", "", 0): 1})
    assert html_text.extracted(spark.createDataFrame([], schema)).collect() == []
