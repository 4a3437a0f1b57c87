"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns of clashing names:
each operator's defined result for them."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrain.llm import html_text, lines, lm, matroska, minhash, mixing, packing, repeats, topk, toxicity

LONG = "some words of a long text " * 9000
TEXTS = ["plain words here and there", "", None, "   ", LONG, "plain words here and there", "x", "two\nlines"]
#: Columns that the operators use themselves, here of other types and contents.
CLASH = ["label", "score", "bucket", "word", "key", "place", "gone", "row", "bands", "component_id", "kept", "rate", "token", "piece", "length", "many"]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows of one id, rows without an id, and extra columns."""
    rows = [(i, t, "en", f"src{i % 2}" if i else None, len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[4], (None, "plain words here and there", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def marks(spark):
    """Several labels for a document, null labels, labels of unknown documents."""
    rows = [(0, 1, 1), (0, 0, 0), (1, None, None), (2, 1, 0), (4, 0, 1), (7, 1, 0), (99, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def ids(rows, name="doc_id"):
    return collections.Counter(r[name] for r in rows)


WANT = collections.Counter([*range(len(TEXTS)), 0, 4, None, None])


def test_toxicity(odd, marks):
    rows = toxicity.score(odd, marks).collect()
    assert ids(rows) == WANT and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 0}) == 1
    assert toxicity.score(odd.limit(0), marks).count() == 0 and toxicity.score(odd, marks.limit(0)).count() == len(TEXTS) + 4
    assert toxicity.keep_clean(odd, marks).columns == odd.columns


def test_lm(odd, marks, monkeypatch):
    rows = lm.score(odd, marks).collect()
    assert ids(rows) == WANT and all(r["score"] is None or math.isfinite(r["score"]) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 0}) == 1
    assert lm.score(odd.limit(0), marks).count() == 0
    assert ids(lm.score(odd, marks.limit(0)).collect()) == WANT  # no target at all
    monkeypatch.setattr(lm, "BROADCAST_IDS", -1)  # ids of the target joined by a shuffle
    again = lm.score(odd, marks).collect()
    by = lambda rows: {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is not None}
    assert by(again) == pytest.approx(by(rows))


def test_matroska(odd):
    rows = matroska.text_round_trip(odd).collect()
    assert ids(rows) == WANT
    for r in rows:
        if r["doc_id"] is not None:
            raw = (TEXTS[r["doc_id"]] or "").encode()
            padded = raw + bytes((-len(raw)) % 64 or (64 if not raw else 0))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    assert matroska.text_round_trip(odd.limit(0)).count() == 0


def test_packing(odd):
    rows = packing.pack(odd).collect()
    assert ids([r for r in rows if r["piece"] == 0]) == WANT
    filled = collections.Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert packing.pack(odd.limit(0)).count() == 0


def test_near_duplicates(odd):
    rows = minhash.near_duplicates(odd).collect()
    assert ids(rows) == WANT
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0, 6: 6, 7: 7}


@pytest.mark.parametrize("docs_broadcast", [500_000, -1])
def test_lines(odd, monkeypatch, docs_broadcast):
    monkeypatch.setattr(lines, "BROADCAST_DOCS", docs_broadcast)
    rows = lines.line_report(odd).collect()
    assert None not in ids(rows)
    assert {(r["doc_id"], r["line"]) for r in rows if r["kept"]} == {(0, 0), (4, 0), (6, 0), (7, 0), (7, 1)}
    out = lines.drop_lines(odd)
    assert out.columns == odd.columns and ids(out.collect()) == WANT - collections.Counter([5])
    assert lines.line_report(odd.limit(0)).count() == 0 and lines.drop_lines(odd.limit(0)).count() == 0


def test_lines_of_a_family(spark):
    """Hundreds of similar lines, each removed for an earlier one, however their matches chain."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for d in range(150):
        w = list(base)
        for at in rng.choice(40, int(rng.integers(0, 6)), replace=False):
            w[at] = f"v{d}x{at}"
        texts.append(" ".join(w))
    sets = [set(t.split()) for t in texts]
    want = [not any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in sets[:k]) for k, s in enumerate(sets)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in lines.line_report(df).collect()}
    assert [got[k] for k in range(len(texts))] == want and 0 < sum(want) < 60


def test_mixing(odd):
    rows = mixing.mix(odd).collect()
    assert {r["source"] for r in rows} <= {None, "src0", "src1"} and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd).columns[: len(odd.columns)] == odd.columns


def test_mixing_meets_its_targets(spark):
    """Shares of characters by source, a null one among them; and means above 500 in parts."""
    rows = [(i, "y" * 99, [None, "a", "b"][i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["source"]: r["n"] for r in mixing.mix(df, {"a": 2.0, "b": 3.0}, 1.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    total = sum(out.values())
    assert [out[s] / total for s in (None, "a", "b")] == pytest.approx([1 / 6, 1 / 3, 1 / 2], abs=0.02) and total == pytest.approx(3000, rel=0.05)
    few = spark.createDataFrame([(i, "a", "rare") for i in range(3)] + [(100 + i, "b" * 999, "much") for i in range(60)], "doc_id long, text string, source string")
    copies = mixing.mix(few, {"rare": 1.0, "much": 1.0}).filter("source = 'rare'").groupBy("doc_id").agg(F.max("mix_copies").alias("n"), F.count("*").alias("k")).collect()
    mean = 0.5 * (60 * 1000 + 3 * 2) / (3 * 2)
    assert mean > 5 * mixing.PART and all(r["n"] == r["k"] and abs(r["n"] - mean) < 6 * math.sqrt(mean) for r in copies) and len(copies) == 3


def test_repeats(odd):
    rows = repeats.repeat_report(odd).collect()
    assert ids(rows) == WANT
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["n_removed"] == by[5]["n_removed"] == 0 and by[4]["n_removed"] > len(LONG) - 200 and by[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (20, [0.1, 0.1]), (3, [1.0, 0.5]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("score", "rank", "query_id", "q", "label")})
    got = topk.top_k(df).collect()
    q = {i: [math.floor(64 * x) for x in v] for i, v in ((0, (1.0, 0.5)), (20, (np.float32(0.1), np.float32(0.1))), (3, (1.0, 0.5)), (8, (0.0, 0.0)))}
    for r in got:
        assert r["score"] == sum(a * b for a, b in zip(q[r["query_id"]], q[r["vec_id"]]))
    assert {r["query_id"] for r in got} == {0, 20} and topk.top_k(df.limit(0)).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + LONG, "x"), (1, "u", "<p>" + LONG, "x"), (2, None, "", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_text.main_text(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (1, len(LONG.strip())), (1, len(LONG.strip())), (2, 0)]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_stages(spark, odd, marks, tmp_path):
    """Every pipeline stage on odd rows and on an empty table."""
    import corpus_pipeline

    marks.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{name}{docs is odd}")
            out.write.parquet(path)
            assert k == 4 or out.columns == odd.columns
            if docs is not odd:
                assert spark.read.schema(out.schema).parquet(path).count() == 0
