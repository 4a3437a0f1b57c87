"""Toxicity by a linear-chain conditional random field over tokens.

A bounded, hashed sample of labelled documents trains the model.  Token labels come from the
document labels: in a toxic document, tokens are toxic that carry a feature (the word or one of
its beginnings) which toxic documents have often and clean ones hardly ever.  A two-state chain
with these features and transitions is fit by maximum likelihood.  Every whole text is then
tagged: forward and backward messages give each token's marginal, marginals give the spans, and
their sum, greatest and share give the document score through a logistic fit.

The chain runs over all tokens of a batch at once: rows of a fixed number of tokens are
composed as 2x2 matrices, row starts follow from these, and document starts reset the chain, so
the result is that of each document by itself.

Defined edge cases: null or empty text has no spans and the score of a text without toxic tokens;
repeated rows score alike; without toxic or without clean labelled rows the score is 0 or 1 for
all; several labels of one document count as toxic if any is.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, prepare, utf8_values

#: Labelled documents used of each class at most (chosen by hash); rounds of training.
SAMPLE, ROUNDS = 1500, 40
#: A feature marks tokens as toxic if so many toxic documents of the sample have it, and clean
#: ones at most this share as often.
SUPPORT, CLEAN_SHARE = 5, 0.05
#: Beginnings of words that are features; score from which a document is toxic; of a span.
PREFIXES, THRESHOLD, SPAN = range(3, 9), 0.7, 0.5
L2, ROW, KEPT = 1.0, 128, 250_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TOKEN = re.compile("[^\x20\x09-\x0d]+")


def features(word: str) -> list[str]:
    """The word without marks around it, in lower case, and its beginnings."""
    w = _EDGE.sub("", word.lower())
    return [f"={w}", *(w[:n] for n in PREFIXES if len(w) >= n)] if w else []


class Emissions(dict):
    """Evidence of each word for the toxic state."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: bytes) -> float:
        if len(self) > KEPT:
            self.clear()
        get = self.weights.get
        v = self[word] = self.bias + sum(get(f, 0.0) for f in features(word.decode("utf-8", "replace")))
        return v


def marginals(evidence: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """P(toxic) of each token, and odds messages for pairwise terms.

    evidence: log odds of each token, documents one after the other; starts: true at their first
    tokens; trans: 2x2 log transitions; first: log odds of the first state.
    """
    n = len(evidence)
    if not n:
        return np.empty(0), (np.empty(0), np.empty(0))
    t = np.exp(trans)
    e = np.exp(np.clip(evidence, -30, 30))
    ahead = _messages(e, starts, t, math.exp(first), True)
    back_starts = np.r_[starts[1:], True][::-1]
    # r of the reversed chain holds a token's own evidence too; the message to it doesn't
    behind = _messages(e[::-1], back_starts, t.T, 1.0, False)[::-1]
    odds = ahead * behind
    return odds / (1 + odds), (ahead, behind)


def _messages(e: np.ndarray, starts: np.ndarray, t: np.ndarray, first: float, forward: bool) -> np.ndarray:
    """Odds of the toxic state from what comes before, including (forward) the token's own
    evidence or (backward) only that of later tokens."""
    n = len(e)
    rows = -(-n // ROW)
    pad = rows * ROW - n
    E = np.r_[e, np.ones(pad)].reshape(rows, ROW).T.copy()
    S = np.r_[starts, np.ones(pad, bool)].reshape(rows, ROW).T.copy()
    out = np.empty((ROW, rows))
    t00, t01, t10, t11 = t[0, 0], t[0, 1], t[1, 0], t[1, 1]
    # composed matrix of each row on (1, odds): odds -> (c + d*odds) / (a + b*odds)
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    before = np.ones(rows)  # evidence of the token before, for the backward form

    def entry(k):
        """Coefficients of step k: odds -> x * (p + q*odds) / (r + s*odds)."""
        if forward:
            return E[k], 1.0
        return np.ones(rows), E[k - 1] if k else None

    prior = np.r_[1.0, E[-1, :-1]]  # evidence of the last token of the row before
    for k in range(ROW):
        s = S[k]
        if forward:
            x = E[k]
            na, nb, nc, nd = t00 * a + t10 * c, t00 * b + t10 * d, x * (t01 * a + t11 * c), x * (t01 * b + t11 * d)
            ra, rc = np.ones(rows), first * x
        else:
            y = E[k - 1] if k else prior
            na, nb, nc, nd = t00 * a + t10 * y * c, t00 * b + t10 * y * d, t01 * a + t11 * y * c, t01 * b + t11 * y * d
            ra, rc = np.ones(rows), np.ones(rows)
        a, b, c, d = np.where(s, ra, na), np.where(s, 0.0, nb), np.where(s, rc, nc), np.where(s, 0.0, nd)
        z = a + b + c + d
        a, b, c, d = a / z, b / z, c / z, d / z
    odds, into = 1.0, np.empty(rows)
    for k, (ka, kb, kc, kd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        into[k] = odds
        odds = (kc + kd * odds) / (ka + kb * odds)
    r = into
    for k in range(ROW):
        if forward:
            r = np.where(S[k], first * E[k], E[k] * (t01 + t11 * r) / (t00 + t10 * r))
        else:
            y = E[k - 1] if k else prior
            r = np.where(S[k], 1.0, (t01 + t11 * y * r) / (t00 + t10 * y * r))
        out[k] = r
    return out.T.reshape(-1)[:n]


class Model:
    """Feature weights, transitions and the logistic fit of document scores."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.bias, self.first = -4.0, -4.0
        self.trans = np.zeros((2, 2))
        self.logit = np.array([0.0, 0.0, 0.0, 0.0])

    def fit(self, texts: list[str], toxic: list[int], ratio: float = 1.0) -> "Model":
        """ratio: clean documents that one of the sample stands for, over that of toxic ones."""
        labels = np.array(toxic, bool)
        if labels.all() or not labels.any():
            self.logit[0] = 50.0 if labels.any() else -50.0
            return self
        ids: dict[str, int] = {}
        streams = [np.fromiter((ids.setdefault(w, len(ids)) for w in _TOKEN.findall(t)), np.int32) for t in texts]
        half = np.arange(len(texts)) % 3 < 2  # trains the chain; the rest fits the document score
        half[0] = half[-1] = True
        if labels[half].all() or not labels[half].any() or labels[~half].all() or not labels[~half].any():
            half[:] = True
        # features as numbers, all words' in a row: lists of them would take the driver's memory
        number: dict[str, int] = {}
        flat_f, ends = array("i"), array("i", [0])
        for w in ids:
            flat_f.extend(number.setdefault(f, len(number)) for f in features(w))
            ends.append(len(flat_f))
        of, ends = np.frombuffer(flat_f, np.int32), np.frombuffer(ends, np.int32)
        seen = np.zeros((2, len(number)), np.int32)
        for k in np.nonzero(half)[0].tolist():
            if len(streams[k]):
                words = np.unique(streams[k]).tolist()
                seen[int(labels[k]), np.unique(np.concatenate([of[ends[w] : ends[w + 1]] for w in words]))] += 1
        many = [max(1, int((half & ~labels).sum())), max(1, int((half & labels).sum()))]
        support = max(2, min(SUPPORT, many[1] // 20))
        marks = (seen[1] >= support) & (seen[0] / many[0] <= CLEAN_SHARE * seen[1] / many[1])
        known = seen.sum(0) >= support
        names = sorted(f for f, i in number.items() if known[i])
        place = np.full(len(number), -1, np.int32)
        place[[number[f] for f in names]] = np.arange(len(names))
        del number
        word = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends))
        marked = np.bincount(word, marks[of], len(ids)) > 0
        rows, cols = word[known[of]], place[of[known[of]]]
        chosen = [k for k in np.nonzero(half)[0].tolist() if len(streams[k])]
        if not chosen:  # no words at all: the share of toxic documents is all there is to say
            self.logit[0] = math.log(max(labels.mean(), 1e-9) / max((1 - labels.mean()) * ratio, 1e-9))
            return self
        flat = np.concatenate([streams[k] for k in chosen])
        starts = np.zeros(len(flat), bool)
        starts[np.cumsum([0, *(len(streams[k]) for k in chosen[:-1])])] = True
        y = marked[flat] & np.repeat(labels[chosen], [len(streams[k]) for k in chosen])
        vocabulary = len(ids)
        del streams, ids, seen, of, flat_f, ends, word
        self._train(flat, starts, y, rows, cols, vocabulary, names, ROUNDS)
        rest = np.nonzero(~half if not half.all() else half)[0]
        x = self.summaries([texts[k].encode() for k in rest])[0]
        self._logistic(x, labels[rest], np.where(labels[rest], 1.0, ratio))
        return self

    def _train(self, flat, starts, y, rows, cols, vocabulary, names, rounds) -> None:
        """Maximum likelihood with L2 by RProp-like steps on the full batch (Adam)."""
        n_feat = len(names)
        theta = np.zeros(n_feat + 6)  # weights, bias, first, transitions
        theta[n_feat], theta[n_feat + 1] = -4.0, -4.0
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pair_from = np.nonzero(~starts)[0] - 1
        gold = np.zeros((2, 2))
        np.add.at(gold, (y[pair_from].astype(int), y[pair_from + 1].astype(int)), 1)
        for step in range(1, rounds + 1):
            w = np.bincount(rows, theta[cols], vocabulary) + theta[n_feat]
            trans = theta[n_feat + 2 :].reshape(2, 2)
            ev = w[flat]
            p, (ahead, behind) = marginals(ev, starts, trans, theta[n_feat + 1])
            d = y - p
            g = np.empty_like(theta)
            by_word = np.bincount(flat, d, vocabulary)
            g[:n_feat] = np.bincount(cols, by_word[rows], n_feat) - L2 * theta[:n_feat]
            g[n_feat] = d.sum()
            g[n_feat + 1] = d[starts].sum()
            a, b = ahead[pair_from], behind[pair_from + 1] * np.exp(np.clip(ev[pair_from + 1], -30, 30))
            t = np.exp(trans)
            # one state pair after the other, and nothing kept into the next round: the driver's memory is small
            pairs = [lambda: np.full_like(a, t[0, 0]), lambda: t[0, 1] * b, lambda: t[1, 0] * a, lambda: t[1, 1] * a * b]
            z = pairs[0]()
            for pair in pairs[1:]:
                z += pair()
            joint = np.array([(pair() / z).sum() for pair in pairs])
            g[n_feat + 2 :] = gold.reshape(-1) - joint - 0.01 * theta[n_feat + 2 :]
            del ev, p, ahead, behind, d, a, b, z
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = {f: float(x) for f, x in zip(names, theta) if abs(x) > 1e-2}
        self.bias, self.first = float(theta[n_feat]), float(theta[n_feat + 1])
        self.trans = theta[n_feat + 2 :].reshape(2, 2).copy()

    def summaries(self, texts: list[bytes], emit: Emissions | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(1, log(1 + sum), greatest, share) of each text's marginals, and the marginals."""
        emit = emit if emit is not None else Emissions(self.weights, self.bias)
        split = [t.split() for t in texts]
        sizes = np.array([len(s) for s in split], int)
        total = int(sizes.sum())
        ev = np.fromiter((v for s in split for v in map(emit.__getitem__, s)), float, total)
        ends = np.cumsum(sizes)
        starts = np.zeros(total, bool)
        starts[(ends - sizes)[sizes > 0]] = True
        p = marginals(ev, starts, self.trans, self.first)[0]
        each = np.split(p, ends[:-1]) if len(texts) else []
        x = np.zeros((len(texts), 4))
        x[:, 0] = 1
        for k, q in enumerate(each):
            if len(q):
                s = q.sum()
                x[k, 1:] = math.log1p(s), q.max(), s / math.sqrt(len(q))
        return x, each

    def _logistic(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        beta = np.zeros(x.shape[1])
        ridge = np.array([1e-3, *[0.05] * (x.shape[1] - 1)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (weight * (y - p)) - ridge * beta
            h = (x.T * (weight * p * (1 - p))) @ x + np.diag(ridge)
            step = np.linalg.solve(h, g)
            beta += step / max(1.0, np.abs(step).max() / 5)
            if np.abs(step).max() < 1e-8:
                break
        self.logit = beta

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.logit, -40, 40)))


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample documents of each class, whole texts, none of them held out."""
    marks = labels.filter(labels["toxic"].isin(0, 1)).select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marks = marks.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    chosen = [marks.filter(F.col("toxic") == t).withColumn("by", F.xxhash64("doc_id")).orderBy("by", "doc_id").limit(sample) for t in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 x sample rows
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(few, "doc_id")
    rows = sorted(texts.select("by", "doc_id", "toxic", "text").collect(), key=lambda r: (r["by"], r["doc_id"], r["text"] or ""))
    stands = {t: sizes.get(t, 0) / max(1, min(sample, sizes.get(t, 0))) for t in (0, 1)}
    return Model().fit([r["text"] or "" for r in rows], [r["toxic"] for r in rows], stands[0] / max(stands[1], 1e-9))


SCORED = "doc_id long, score double, spans array<struct<begin:int,end:int,p:double>>"


def _tagger(model: Model):
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    emit = None

    def tag(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        nonlocal emit
        if emit is None:
            emit = Emissions(model.weights, model.bias)
        texts = utf8_values(column)
        x, each = model.summaries(texts, emit)
        spans = []
        for text, p in zip(texts, each):
            hot = np.nonzero(p >= SPAN)[0]
            if len(hot):
                places = [m.span() for m in _TOKEN.finditer(text.decode("utf-8"))]
                spans.append([{"begin": places[i][0], "end": places[i][1], "p": float(p[i])} for i in hot.tolist()])
            else:
                spans.append([])
        return model.scores(x), pa.array(spans, span)

    return tag


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and toxic spans (code points) of every document."""
    prepare(docs.sparkSession)
    model = train(docs, labels, sample)

    def run(batches):
        begin("toxicity")
        tag = _tagger(model)
        for batch in batches:
            s, spans = tag(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), spans], ["doc_id", "score", "spans"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = rows.mapInArrow(run, SCORED)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that score below the threshold."""
    prepare(docs.sparkSession)
    model = train(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches):
        begin("toxicity")
        tag = _tagger(model)
        for batch in batches:
            yield batch.filter(pa.array(tag(batch.column(at))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
