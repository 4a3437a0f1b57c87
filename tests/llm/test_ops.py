"""Training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrain.llm import graph, html_text, lines, lm, matroska, minhash, mixing, packing, queries, repeats, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, None, f"src{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.integers(vocabulary))}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    base = [words(rng, int(rng.integers(1, 120))) for _ in range(30)]
    out = list(base)
    for k in range(25):
        w = base[k].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = "zz"
        out.append("\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12)))
    return [*out, None, "", "   ", "one", "One", "two words", base[0], base[0], "x" * 5000, "A B c d e"]


# 1

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div id="main"><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First   paragraph<br>with <b>bold</b> text.<p>Second &lt;one&gt; is here.
<form><input><label>Mail</label></form><ul><li>item one<li>item two</ul><div class="ad">Buy now</div><section id="comments"><p>Great article!</p></section></article>
<aside>Related</aside></div><script>var x = "<p>no</p>";</script><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Title & more\n\nFirst paragraph with bold text.\n\nSecond <one> is here.\n\nitem one\n\nitem two"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>x</nav>") == ""
    assert html_text.extract("<div><div><p>" + "a " * 50_000) == ("a " * 50_000).strip()
    assert html_text.extract("a < b") == "a < b"


LONG = "<p>" + "plain words of a paragraph, and more of them, " * 9 + "</p>"


def brute_density(node, share):
    """Composite text density from the text itself: characters, tags, and those of links."""
    chars = tags = link_chars = link_tags = 0
    stack = [(node, node.tag == "a")]
    while stack:
        n, linked = stack.pop()
        for c in n.children:
            if isinstance(c, str):
                k = len(c.replace(" ", "")) if c.strip() else 0
                chars, link_chars = chars + k, link_chars + k * linked
            elif not c.drop:
                tags, link_tags = tags + 1, link_tags + (c.tag == "a")
                stack.append((c, linked or c.tag == "a"))
    link_tags += node.tag == "a"
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = max(math.log(c / max(c - link_chars, 1) * link_chars + share * c + math.e), math.e)
    return c / t * max(math.log(c / lc * t / lt), 0.0) / math.log(base)


@pytest.mark.parametrize("seed", range(30))
def test_densities_by_brute_force(seed):
    rng = random.Random(seed)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return "word " * rng.randrange(0, 40)
        tag = rng.choice(["div", "p", "a", "section", "b", "ul", "nav"])
        return f"<{tag}>" + "".join(make(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"

    root = html_text.dom("<body>" + "".join(make(4) for _ in range(4)) + "</body>")
    order = html_text._measure(root)
    body = next(n for n in order if n.tag == "body")
    html_text._densities(order, body)
    share = body.link_chars / max(body.chars, 1)
    for n in order:
        assert n.density == pytest.approx(brute_density(n, share))
    sums = [n.density_sum for n in order if n is not root]
    assert html_text._best(body).density_sum == max(sums)


def test_main_text_without_an_article_element():
    menu = "<div class=top>" + "".join(f"<a href=/{i}>entry {i}</a> " for i in range(12)) + "</div>"
    want = ["Head", *[html_text.extract(LONG)] * 2]
    for holder in ("div", "section", "td"):
        for name in ("", " class='content has-sidebar'", " id=no-comments", " class=rail"):
            open_, close = (f"<table><tr><td{name}>", "</td></tr></table>") if holder == "td" else (f"<{holder}{name}>", f"</{holder}>")
            page = f"<body>{menu}{open_}<h1>Head</h1>{LONG}<div class=ad>{LONG}</div>{LONG}<div class=notice>Mind this</div>{close}<div class=sidebar>{LONG}</div><div id=comments>{LONG * 9}</div><div>short tail</div></body>"
            assert html_text.extract(page).split("\n\n") == want, (holder, name)
    assert html_text.extract(f"<body>{menu}<h1>Head</h1>{LONG}{LONG}<div>short tail</div></body>").split("\n\n") == want
    # a doubtful name goes below the threshold alone, a heading stays before what is chosen
    assert "Mind" not in html_text.extract(f"<article>{LONG}<div class=legal>Mind this</div></article>")
    assert len(html_text.extract(f"<article>{LONG}<div class=legal>{LONG * 3}</div></article>").split("\n\n")) == 4
    assert html_text.extract("<p>a <math><mi>x</mi></math> b<xmp><b>c</b></xmp>") == "a x b\n\n<b>c</b>"


def test_densities_decide(monkeypatch):
    pages = [f"<body><div>{'tail ' * 5}</div><div><h2>A</h2>{LONG * k}</div><div><p>other</p></div></body>" for k in (1, 2, 5)]
    before = [html_text.extract(p) for p in [*pages, PAGE]]
    monkeypatch.setattr(html_text, "composite_density", lambda *a: 0.0)
    after = [html_text.extract(p) for p in [*pages, PAGE]]
    assert all(b and a != b for a, b in zip(after, before, strict=True))


def test_main_text_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 0), (None, None, None, 1)], "page_id long, url string, html string, text long")
    rows = html_text.main_text(df.union(df)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0)] * 2 + [(1, len(html_text.extract(PAGE)))] * 2
    assert html_text.main_text(df.limit(0)).count() == 0


# 2


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    ev, trans, first = rng.normal(size=6), rng.normal(size=(2, 2)), 0.3
    total, p = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        w = math.exp(first * y[0] + sum(ev[i] * y[i] for i in range(6)) + sum(trans[y[i], y[i + 1]] for i in range(5)))
        total, p = total + w, p + w * np.array(y)
    starts = np.array([True] + [False] * 5)
    np.testing.assert_allclose(toxicity.marginals(ev, starts, trans, first)[0], p / total)


def test_toxicity_training_memory():
    """Rounds of training hold few arrays of the tokens' length at a time: the driver is small."""
    import tracemalloc

    rng, n = np.random.default_rng(3), 200_000
    flat, starts, y = rng.integers(0, 50, n), np.arange(n) % 400 == 0, rng.random(n) < 0.1
    tracemalloc.start()
    toxicity.Model()._train(flat, starts, y, np.arange(50), np.arange(50), 50, [f"={k}" for k in range(50)], 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 13 * 8 * n, peak / 8 / n


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(240):
        t = words(rng, 40).split()
        if i % 4 == 0:
            for k in range(3):
                t.insert(int(rng.integers(len(t))), "vilifying" if k else "nastyword,")
        rows.append(" ".join(t))
        labels.append((i, 1, int(i % 4 == 0)))
    d = docs(spark, [*rows, None, ""])
    out = toxicity.score(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    truth = np.array([i % 4 == 0 for i in range(240)])
    held = out.held_out.loc[range(240)].to_numpy()
    assert held.any() and ((out.score.loc[range(240)].to_numpy() >= 0.7) == truth)[held].mean() > 0.95
    assert out.score.between(0, 1).all() and out.predicted.loc[240] == 0
    hit = out.spans.loc[0]
    assert all(rows[0][s["begin"] : s["end"]].strip(",") in ("nastyword", "vilifying") for s in hit) and len(hit)
    none = toxicity.score(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).toPandas()
    assert len(none) == 242 and none.score.between(0, 1).all()


# 3


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)) * rng.exponential(1, (300, 1)), 3).astype(np.float32)
    x[40] = x[20]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")], 0), (1020, [float("inf")], 0), (None, [1.0], 0)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    q = np.floor(64 * x.astype(float)).astype(int)
    assert set(got) == set(range(0, 300, 20))
    for i in got:
        s = q @ q[i]
        want = sorted(((-int(s[j]), j) for j in range(300) if j != i))[:20]
        assert [got[i][k + 1] for k in range(20)] == [(-a, b) for a, b in want]
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 6)), 3)
    x[0] *= 50  # leads the block of each partition
    rows = [(0, x[0].tolist(), 0), *((i, x[i].tolist(), 0) for i in range(1, 100)), (0, x[0].tolist(), 0), *((i, x[i].tolist(), 0) for i in range(100, 200))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "vec_id long, embedding array<double>, rank int")
    got = {(r["query_id"], r["rank"]): (r["score"], r["vec_id"]) for r in topk.top_k(df).collect()}
    ids, q = np.array([r[0] for r in rows]), np.floor(64 * np.array([r[1] for r in rows])).astype(int)
    want = {}
    for i in range(0, 200, 20):
        pairs = sorted((-int(q[a] @ q[b]), int(ids[b])) for a in np.nonzero(ids == i)[0] for b in range(len(rows)) if ids[b] != i)[:20]
        want |= {(i, k + 1): (-s, j) for k, (s, j) in enumerate(pairs)}
    assert got == want


def test_huge_products_are_exact():
    a = np.array([[1 << 30, -(1 << 30)]], np.int64)
    assert topk.products(a, a).tolist() == [[1 << 61]]


# 4


def test_lm_scores(spark, corpus):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    p = lm.score(docs(spark, corpus), labels, vocabulary=120).toPandas()
    seqs = {i: [(lm._EDGE.sub("", w.decode().lower()) or w.decode().lower()) for w in (t or "").encode().split()] for i, t in enumerate(corpus)}
    count = collections.Counter(w for s in seqs.values() for w in s)
    import xxhash

    order = sorted(count, key=lambda w: (-count[w], int(np.array([xxhash.xxh3_64_intdigest(w.encode())], np.uint64).view(np.int64)[0])))
    known = set(order[:120])
    n1, n2, cx = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for i, s in seqs.items():
        seqs[i] = q = ["<s>", *(w if w in known else "<u>" for w in s), "</s>"]
        for m in (0, 1) if i < 40 and i % 3 == 0 else (0,):
            n1[m].update(q[1:]), n2[m].update(zip(q, q[1:])), cx[m].update(q[:-1])
    size = [sum(c.values()) for c in n1]

    def loss(m, u, v):
        return -math.log((n2[m][u, v] + 5 * (n1[m][v] + 0.5) / (size[m] + 0.5 * (len(known) + 2))) / (cx[m][u] + 5))

    for r in p.itertuples():
        q = seqs[r.doc_id]
        for m, got in ((1, r.ce_target), (0, r.ce_background)):
            assert abs(sum(loss(m, u, v) for u, v in zip(q, q[1:])) / (len(q) - 1) - got) < 1e-9
    assert len(p) == len(corpus)


def test_lm_knows_every_word(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 30_000)
    texts = [" ".join(f"w{(i * 2000 + j) if j % 4 else j % 12}" for j in range(2000)) for i in range(50)]
    texts += texts[:3]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    p = lm.score(docs(spark, texts), labels).toPandas()
    n1, n2, cx = ([collections.Counter(), collections.Counter()] for _ in range(3))
    seqs = [["<s>", *t.split(), "</s>"] for t in texts]
    for i, q in enumerate(seqs):
        for m in (0, 1) if i < 40 and i % 3 == 0 else (0,):
            n1[m].update(q[1:]), n2[m].update(zip(q, q[1:])), cx[m].update(q[:-1])
    size, n_words = [sum(c.values()) for c in n1], len(n1[0]) - 1
    assert n_words > 70_000 and len(p) == len(texts)
    for r in p.itertuples():
        q = seqs[r.doc_id]
        for m, got in ((1, r.ce_target), (0, r.ce_background)):
            loss = [-math.log((n2[m][u, v] + 5 * (n1[m][v] + 0.5) / (size[m] + 0.5 * (n_words + 2))) / (cx[m][u] + 5)) for u, v in zip(q, q[1:])]
            assert abs(sum(loss) / len(loss) - got) < 1e-9


# 5


def linked(texts, k, share):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    s = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        n = len(s[i] & s[j])
        if s[i] and s[j] and 100 * n >= share * (len(s[i]) + len(s[j]) - n):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], [len(x) for x in s]


@pytest.mark.parametrize("k,share", [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, k, share):
    chain = ["a b c d e f g h i j k l m n o p q r s t " + " ".join(f"x{i + d}" for i in range(60)) for d in range(6)]
    texts = corpus + chain
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts), k, share).collect()}
    comp, size = linked(texts, k, share)
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == size
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(len(texts)))
    assert minhash.near_duplicates(docs(spark, texts).limit(0), k, share).count() == 0


@pytest.mark.parametrize("large, block", [(3, 4), (10**9, 4), (3, 2048)])
def test_large_families(spark, monkeypatch, large, block):
    """Copies at and around the threshold, in buckets dealt to rounds of centres and to blocks."""
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = words(rng, 70, 10**6).split()
    texts = []
    for d in range(40):
        w = list(base)
        for at in rng.choice(len(w), int(rng.integers(0, 4)), replace=False):
            w[at] = f"v{d}x{at}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == linked(texts, 3, 85)[0]


def test_near_duplicates_with_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (None, None), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, 7, "k", -1) for i, t in rows], "doc_id long, text string, component_id int, band string, n_shingles int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(1, 4, 1, True)] * 2 + [(2, 4, 1, False), (None, 4, None, True), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True)], key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 10), (20, 19), (19, 18), (18, 17), (17, 16)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7, 9: 7, **dict.fromkeys(range(16, 21), 16)}


# 6


@pytest.mark.parametrize("n", [64, 512, 1536 + 64, 40_960, 300_032])
def test_matroska_round_trip(n):
    data = os.urandom(n)
    stored = matroska.mux_pcm8(data)
    media = matroska.parse(stored)
    assert matroska.demux(stored, media) == data
    assert all(stored[place : place + 4] == b"\x1f\x43\xb6\x75" for _, _, place in media.cues)
    assert [p.timestamp_ns for p in media.packets] == [i * matroska.FRAME * 10**9 // matroska.RATE for i in range(len(media.packets))]


def test_matroska_unknown_sizes_and_damage(spark):
    e = matroska._element
    block = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x81\x00\x05\x00abc") + matroska._uint(matroska.REFERENCE, 1))
    cluster = bytes.fromhex("1f43b675ff") + matroska._uint(matroska.TIMESTAMP, 7) + e(0xEC, b"void") + block
    live = matroska._HEAD + bytes.fromhex("18538067ff") + cluster + cluster
    packets = matroska.parse(live).packets
    assert [(p.timestamp_ns, live[p.offset : p.offset + p.size], p.keyframe, p.cluster) for p in packets] == [(12_000_000, b"abc", False, 0), (12_000_000, b"abc", False, 1)]
    df = spark.createDataFrame([(1, bytearray(live)), (2, bytearray(b"junk")), (3, None), (4, bytearray(live[:-2]))], "id long, data binary")
    assert sorted(r["id"] for r in matroska.packet_table(df, "id", "data").collect()) == [1, 1]


def test_text_round_trip(spark, corpus):
    for r in matroska.text_round_trip(docs(spark, corpus)).collect():
        raw = (corpus[r["doc_id"]] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())


# 7


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything(seed):
    rng = random.Random(seed)
    for _ in range(20):
        h = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(0, 30))}
        p = packing.plan(h, 100)
        at, count = collections.defaultdict(list), collections.Counter()
        for s, a, b, first, per, head in p.runs:
            count[s] += b - a
            for j in range(b - a):
                at[first + j // per].append((head + j % per * s, s))
        assert count == {s: c for s, c in h.items() if c} and set(at) == set(range(p.sequences))
        for v in at.values():
            end = 0
            for place, s in sorted(v):
                assert place == end
                end += s
            assert end <= 100


@pytest.mark.parametrize("low, high, gain", [(500, 1000, 1.06), (400, 700, 1.05), (300, 1200, 1.0)])
def test_plan_beats_best_fit(low, high, gain):
    """Lengths without small ones, where best fit decreasing leaves much empty."""
    rng = random.Random(1)
    h = collections.Counter(rng.randint(low, high) for _ in range(20_000))
    plain = packing.Plan(2048)
    for s in sorted(h, reverse=True):
        plain.fill(s, h[s])
    made = packing.plan(h, 2048)
    least = -(-sum(s * c for s, c in h.items()) // 2048)
    assert least <= made.sequences and made.sequences * gain <= plain.sequences


def test_plan_is_at_the_token_bound_by_configurations(monkeypatch):
    """Documents of mixed lengths: the first setting places large pieces side by side, and needs
    no more sequences than best fit or a thousandth over the tokens alone."""
    rng = random.Random(4)
    h = collections.Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(30_000))
    several = []
    real = packing.configurations
    monkeypatch.setattr(packing, "configurations", lambda *a: several.extend(real(*a)) or real(*a))
    made = packing.plan(h, 2048)
    least = -(-sum(s * c for s, c in h.items()) // 2048)
    assert made.sequences <= least * 1.001 + 1
    assert any(c.sum() > 1 and t for c, t in several)


def test_cells_hold_the_runs_of_their_ranks():
    rng = random.Random(2)
    runs, cells, want = [], [], {}
    for length in (3, 9):
        at, ends = 0, sorted(rng.sample(range(1, 200), 12))
        for e in ends:
            runs.append((length, at, e, rng.randrange(99), 1, 0))
            want |= {(length, k): runs[-1][1:] for k in range(at, e)}
            at = e
        cuts = [0, *sorted(rng.sample(range(1, at), 5)), at]
        cells += [(length, b, x, y - x) for b, (x, y) in enumerate(zip(cuts, cuts[1:]))]
    rng.shuffle(runs)
    rows = packing._by_cell(cells, sorted(runs))
    for length, b, before, count in cells:
        for k in range(before, before + count):
            assert [r[3:] for r in rows if r[:2] == (length, b) and r[3] <= k < r[4]] == [want[length, k]]


def test_workers_keep_one_operators_words(spark, monkeypatch):
    """A task drops what tasks of other operators have kept in its worker (the pipeline's add up)."""
    docs = spark.createDataFrame([(1, "a fine text of some words"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    ran = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: (ran.append(f), self.sparkSession.createDataFrame([], schema))[1])
    minhash.signature_table(docs, 3, 0.85), packing.pieces(docs), toxicity.keep_clean(docs, labels), toxicity.score(docs, labels)
    batches = docs.toArrow().to_batches()
    run = lambda f: [b.to_pydict() for b in f(iter(batches))]
    sign, cut, *tag = ran
    signed, pieces = run(sign), None
    for f in tag:
        assert minhash.WORDS and not packing._ENCODERS
        again = run(cut)
        assert packing._ENCODERS and not minhash.WORDS and pieces in (None, again)
        pieces = again
        assert run(cut) == pieces and packing._ENCODERS
        run(f)
        assert not packing._ENCODERS and not minhash.WORDS
        assert run(sign) == signed


def test_encoder_keeps_words_in_use(monkeypatch):
    """Words that texts go on asking for are learnt once, however many others come and go."""
    import public_tokenizers

    monkeypatch.setattr(packing, "KEPT", 50)
    enc, learnt, rng = packing.Encoder(public_tokenizers.path(packing.TOKENIZER)), [], random.Random(5)
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (learnt.extend(words), learn(words)))
    for _ in range(60):
        texts = ["The usual, " + " ".join("".join(rng.choices("abcdeé", k=7)) for _ in range(5)) for _ in range(2)]
        assert enc.encode(texts) == [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(enc.known) + len(enc.older) <= 2 * (50 + 13)
    assert learnt.count("usual") == 1 and len(learnt) > 500


def test_pack(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    odd = ["İstanbul Σ é é ß", "don't they'll", "<|endoftext|> x", "a\x1cb \x85 c", "日本 123 4.5%", "w " * 5000]
    texts = corpus + odd
    rows = packing.pack(docs(spark, texts)).toPandas().sort_values(["doc_id", "piece"])
    import zlib

    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = rows[rows.doc_id == i]
        assert mine.start.tolist() == list(range(0, len(ids), 2048))
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in mine.start]
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert packing.pack(docs(spark, ["x"]).limit(0)).count() == 0
    again = docs(spark, ["x y", "x y", None])
    assert packing.pack(again.union(again).withColumn("length", F.lit("clash"))).count() == 6


# 8


def test_lines_by_brute_force(spark, corpus):
    texts = [*corpus, "same line here\nsame line here\n\nanother one", "Same line  here"]
    got = {(r["doc_id"], r["line"]): r["kept"] for r in lines.line_report(docs(spark, texts)).collect()}
    seen, want = [], {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            s = {w for w in re.split("[ \t\x0b\f\r]+", line.lower()) if w}
            if t and s:
                want[i, k] = not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen)
                seen.append(s)
    assert got == want
    out = {r["doc_id"]: r["text"] for r in lines.drop_lines(docs(spark, texts)).collect()}
    assert out[len(texts) - 2] == "same line here\n\nanother one" and len(texts) - 1 not in out
    assert out[len(corpus) - 10] is None and lines.line_report(docs(spark, texts).limit(0)).count() == 0


# 9


def test_first_lines_of_tokens_meet_by_one_shuffle(spark):
    """The earliest lines of a token are found in the shuffle by which all lines meet them; no line of
    another size that only later tokens of the prefix show is lost."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(base[:32]), " ".join(base[:31]), " ".join(base[4:] + list("abcd")), " ".join(base + [f"v{i}" for i in range(10)])]
    table = docs(spark, texts)
    kept = [r["kept"] for r in sorted(lines.line_report(table).collect(), key=lambda r: r["doc_id"])]
    sets = [set(t.split()) for t in texts]
    assert kept == [all(9 * len(sets[i] & sets[j]) < 4 * (len(sets[i]) + len(sets[j])) for j in range(i)) for i in range(5)]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = lines._meet_heads(lines._read(table).filter("prefix is not null and n is not null"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held[0])
        spark.conf.set("spark.sql.adaptive.enabled", held[1])
    assert "ReusedExchange" in plan and "WindowGroupLimit" not in plan


def test_all_lines_meet_by_one_shuffle(spark):
    """Tokens of earlier lines and of later open ones come from the same shuffle, which is written
    once; and lines that are not open meet as earlier ones only."""
    base = [f"w{i}" for i in range(60)]
    table = docs(spark, [" ".join(base[k:] + [f"v{k}"]) for k in range(4)])
    sets = lines._read(table).filter("prefix is not null and n is not null").withColumn("open", F.col("doc") != 2)
    met = lines._meet_all(sets)
    assert {(r["x_doc"], r["y_doc"]) for r in met.collect()} == {(0, 1), (0, 3), (1, 3), (2, 3)}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = lines._meet_all(sets)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held[0])
        spark.conf.set("spark.sql.adaptive.enabled", held[1])
    assert "ReusedExchange" in plan


def test_mixing(spark, corpus):
    d = docs(spark, [*(corpus * 4)])
    out = mixing.mix(d, {"src0": 1.0, "src1": 5.0}).toPandas()
    again = mixing.mix(d.repartition(7), {"src0": 1.0, "src1": 5.0}).toPandas()
    key = ["doc_id", "mix_copy", "mix_copies", "mix_key"]
    assert sorted(map(tuple, out[key].values)) == sorted(map(tuple, again[key].values))
    assert (out.groupby("doc_id").mix_copy.nunique() == out.groupby("doc_id").mix_copies.first()).all()
    high = mixing.mix(docs(spark, ["a"] * 5 + ["b" * 1200] * 300), {"src0": 1e6}, 1.0)
    assert high.count() >= 0 and mixing.mix(d.limit(0)).count() == 0


# 10


def removed(texts):
    seen, out = set(), []
    for t in texts:
        t = (t or "").encode()
        gone, here = bytearray(len(t)), None
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(t[p : p + 100])
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeats(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab c") for _ in range(rng.randint(60, 300))) for _ in range(6)]
    texts = ["".join(rng.choice(parts)[rng.randint(0, 40) : rng.randint(50, 300)] + "".join(rng.choice("xyzé") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += ["ab" * 400, "x" * 150, "x" * 99, None, "ab" * 80, "q" * 100, "q" * 100]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeat_report(docs(spark, texts).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)
    assert repeats.repeat_report(docs(spark, texts).limit(0)).count() == 0


def test_large_buckets_are_dealt_out_again():
    rows = [(1, b, b, 0, 1) for b in range(5000)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "body", "doc", "at", "span"])
    kinds = [k for b in repeats._buckets([batch]) for k in b.column(0).to_pylist()]
    assert kinds == [2] * 5000


def in_process(texts, size=7):
    """The operator's steps one after the other on this process, in batches of size rows."""
    import pandas as pd
    import pyarrow as pa
    import zstandard

    def through(step, table, by=None):
        table = table.sort_values(by) if by else table
        batches = [pa.RecordBatch.from_pandas(table.iloc[i : i + size], preserve_index=False) for i in range(0, len(table), size)]
        made = [b.to_pandas() for b in step(iter(batches))]
        return pd.concat(made) if made else None

    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    found = through(repeats._buckets, through(repeats._send_blocks, rows), ["key", "body", "doc", "at"])
    out = {i: [] for i in range(len(texts))}
    for r in found[found.kind == 0].itertuples():
        out[r.doc].append((r.at, r.at + r.span))
    wanted = found[found.kind > 0]
    if len(wanted):
        parts = [(d, zstandard.compress((texts[d] or "").encode()), g[["kind", "key", "at", "span"]].to_dict("records")) for d, g in wanted.groupby("doc")]
        scanned = through(repeats._scan, through(repeats._cut, pd.DataFrame(parts, columns=["doc", "blob", "wanted"])), ["key", "doc", "at"])
        for r in scanned.itertuples() if scanned is not None else ():
            out[r.doc].append((r.start, r.end))
    report = []
    for i, t in enumerate(texts):
        t = (t or "").encode()
        gone = repeats.merged(out[i])
        kept = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(t)]))
        report.append((len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return report


@pytest.mark.parametrize("blocks", [1, 3, 4096])
def test_repeats_with_dealt_out_buckets(monkeypatch, blocks):
    """A passage of little over 100 bytes in ever new surroundings, and texts in small pieces."""
    monkeypatch.setattr(repeats, "BLOCKS", blocks)
    monkeypatch.setattr(repeats, "PIECE", 500)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    hot, other = noise(104), noise(180)
    texts = [noise(rng.randint(0, 90)) + (hot if i % 4 else other) + noise(rng.randint(0, 90)) + hot[:101] * (i % 5 == 0) for i in range(60)]
    texts += [None, "", hot, hot, noise(20_000) + hot + "\n" + noise(9_000) + hot]
    assert in_process(texts) == removed(texts)


def test_windows_dealt_out_move_as_hashes_and_leave_their_first_place():
    """Rows repeated with their doc_id in other batches keep their windows, those of other documents go."""
    import pandas as pd
    import pyarrow as pa
    import zstandard

    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij ") for _ in range(200)).encode()
    rows = [(d, zstandard.compress(text), [{"kind": 2, "key": 5, "at": 0, "span": 101}]) for d in (1, 1, 2)]
    batches = [pa.RecordBatch.from_pandas(pd.DataFrame([r], columns=["doc", "blob", "wanted"])) for r in rows]
    cut = pa.Table.from_batches(repeats._cut(iter(batches))).sort_by([(c, "ascending") for c in ("key", "doc", "at")])
    gone = {1: [], 2: []}
    for b in repeats._scan(iter(cut.to_batches(max_chunksize=7))):
        for d, s, e in zip(*(c.to_pylist() for c in b.columns)):
            gone[d].append((s, e))
    assert gone[1] == [] and repeats.merged(gone[2]) == [(0, 200)]
    assert cut.num_rows == 303 and cut["bytes"].null_count == 303
    alike = cut.set_column(0, "key", pa.array([3] * 303)).sort_by([("doc", "ascending"), ("at", "ascending")])  # told apart by the other hash
    other = [x for b in repeats._scan(iter(alike.to_batches(max_chunksize=7))) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(other) == [(2, p, p + 100) for p in range(101)]


def test_maximal_repeats_lists_all_occurrences():
    a = b"k" * 5 + bytes(range(60, 120)) * 2
    array = repeats.SuffixArray([0, 0, 0], [b"1" + a + b"x", b"2" + a + b"y", b"3" + a + b"z"])
    found = [(length, sorted(zip(array.block[s].tolist(), array.at[s].tolist()))) for length, s in repeats.maximal_repeats(array)]
    assert (len(a), [(0, 1), (1, 1), (2, 1)]) in found


def test_names():
    assert {re.match(r"op\d+", n)[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_blocks_of_a_long_text_behind_a_short_one():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    short, long = (rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode() for n in (1_900_000, 17_000_000))

    def sent(rows):
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], ["doc", "text"])
        made = pa.Table.from_batches(repeats._send_blocks([batch])).to_pandas()
        return made[made["doc"] == 2].sort_values(["at", "span"]).to_numpy()

    np.testing.assert_array_equal(sent([(1, short), (2, long)]), sent([(2, long)]))
