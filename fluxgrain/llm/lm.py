"""Cross-entropy difference under matched bigram models of a target and of all documents.

Both models have the same order, smoothing and vocabulary (all words of all documents, and one
unknown word); the target's counts come from documents labelled as good, the background's from
all.  Probabilities are Dirichlet-smoothed bigrams over smoothed unigrams; a document's score is
the mean over its tokens of target loss minus background loss (low: like the target).

Words are 64-bit hashes.  Counting and scoring share one shuffle.  Tasks cut their documents into
chunks and send the chunk's counts by bigram to hash buckets.  A bucket adds up the counts (a hot
bigram is one number per chunk) and answers each chunk with the sums of its bigrams; the answers
meet the chunk's documents, which turn them into losses.  Bigrams that end in a rare word lie in
the word's bucket, so that its count is the sum of theirs; those that end in a frequent word are
dealt out by the whole bigram, and only frequent words, HOT at most, are collected with their
counts.  A context's count needs no table of its own: a document's contexts are the start mark and
its words, its tokens the words and the end mark, and both marks are counted once a document.

Defined edge cases: null or empty text is the end mark alone (one token); repeated rows are
scored and counted each; without target documents the target model is uniform; words are runs
of bytes other than ASCII white space, lowered, without marks around them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, prepare, utf8_values

#: Smoothing of uni- and bigrams.
DELTA, STRENGTH = 0.5, 5.0
#: Words with more than one in so many tokens are frequent (there are fewer than that).
HOT = 50_000
#: Tokens of a chunk, and of a bucket on average; words a worker keeps.
CHUNK_TOKENS, BUCKET_TOKENS, KEPT = 600_000, 4_000_000, 400_000
#: Target ids up to this many are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
UNKNOWN, END, START = 1, 2, 3
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_U = np.uint64


class Hashes(dict):
    """64-bit hashes of words as the models see them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        text = word.decode("utf-8", "replace").lower()
        h = self[word] = xxhash.xxh3_64_intdigest((_EDGE.sub("", text) or text).encode())
        return h


class Ids(dict):
    """Hashes of words; those outside a given vocabulary are unknown."""

    def __init__(self, known: np.ndarray | None) -> None:
        super().__init__()
        self.known = None if known is None else set(known.tolist())
        self.hashes = Hashes()

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
            self.hashes.clear()
        h = self.hashes[word]
        h = self[word] = h if self.known is None or h in self.known else UNKNOWN
        return h


def _count_words(batches):
    """(hash, documents' count, target's count), combined within the task."""
    hashes, empty = Hashes(), np.empty((0, 3), np.int64)
    held, table = [], empty

    def combine(parts):
        x = np.concatenate(parts)
        order = np.argsort(x[:, 0], kind="stable")
        x = x[order]
        first = np.r_[True, x[1:, 0] != x[:-1, 0]]
        return np.column_stack([x[first, 0], np.add.reduceat(x[:, 1:], np.nonzero(first)[0])]) if len(x) else empty

    size = 0
    for batch in batches:
        for text, target in zip(utf8_values(batch.column(0)), batch.column(1).to_pylist()):
            words = text.split()
            h = np.fromiter(map(hashes.__getitem__, words), _U, len(words)).view(np.int64)
            held.append(np.column_stack([h, np.ones(len(h), np.int64), np.full(len(h), int(target))]))
            size += len(h)
        if size > 1_000_000:
            table, held, size = combine([table, *held]), [], 0
    table = combine([table, *held])
    for at in range(0, len(table), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in table[at : at + 50_000].T.copy()], ["word", "n", "n_target"])


class Models:
    """What both models share with every task: frequent words with their counts, smoothing."""

    def __init__(self, hot: dict[int, tuple[int, int]], known: np.ndarray | None, n_words: int, tokens) -> None:
        self.hot = np.array(sorted(hot), _U)
        self.counts = np.array([hot[h] for h in sorted(hot)], float).T
        self.known = known
        self.rest = (np.array(tokens, float) + DELTA * (n_words + 2))[:, None]

    def losses(self, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """(target, background) loss of each bigram, of its context the share that its word has as
        one; pairs, words: the counts of bigrams and of their last words, background first."""
        return (np.log(words + STRENGTH) - np.log(pairs + STRENGTH * (words + DELTA) / self.rest))[::-1]


def _planes(x: np.ndarray, kind: str) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: leading zeros pack well."""
    x = np.ascontiguousarray(x.astype(kind))
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


class _Reader:
    """Reads what _planes wrote, in its order."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def __call__(self, n: int, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        x = np.frombuffer(self.data, np.uint8, n * size, self.at).reshape(size, n)
        self.at += n * size
        return np.ascontiguousarray(x.T).view(kind).reshape(n)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.nonzero(np.r_[True, x[1:] != x[:-1]])[0] if len(x) else np.empty(0, np.int64)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of 64-bit hashes."""
    return ((x >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _send(models: Models, buckets: int):
    """Chunks as rows (bucket, kind, chunk, payload): counts by bucket (0), and the documents (2)."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        ids, task, chunk = Ids(models.known), TaskContext.get().partitionId(), 0
        docs, flags, streams, held = [], [], [], 0

        def flush():
            nonlocal chunk, held
            name = (task << 24) + chunk
            sizes = np.array([len(s) for s in streams])
            owner = np.repeat(np.arange(len(streams)), sizes + 1)
            ends = np.cumsum(sizes + 1)
            after = np.full(int(ends[-1]), END, _U)
            inner = np.ones(len(after), bool)
            inner[ends - 1] = False
            after[inner] = np.concatenate(streams)
            before = np.r_[_U(START), after[:-1]]
            before[np.r_[0, ends[:-1]]] = START
            with np.errstate(over="ignore"):
                keys = mix64(mix64(before) + after)
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], owner[order]
            new = np.r_[True, keys[1:] != keys[:-1]]
            entry = np.nonzero(new | np.r_[True, who[1:] != who[:-1]])[0]
            many, who = np.diff(np.r_[entry, len(keys)]), who[entry]
            first = np.nonzero(new[entry])[0]
            keys, word, runs = keys[entry[first]], after[order[entry[first]]], np.diff(np.r_[first, len(entry)])
            all_n = np.add.reduceat(many, first)
            target_n = np.add.reduceat(many * np.array(flags, np.int64)[who], first)
            place = np.minimum(np.searchsorted(models.hot, word), len(models.hot) - 1)
            rare = models.hot[place] != word
            where = _bucket(np.where(rare, word, keys), buckets)
            # by bucket, frequent words first, these by bigram, rare ones by word and bigram
            by = np.lexsort((np.where(rare, word, _U(0)), where * 2 + rare))
            spread = np.repeat(by, runs[by])
            at = first[spread] + np.arange(len(spread)) - np.repeat(np.cumsum(runs[by]) - runs[by], runs[by])
            who, many, runs = who[at], many[at], runs[by]
            keys, word, place, rare, where, all_n, target_n = (x[by] for x in (keys, word, place, rare, where, all_n, target_n))
            cuts = np.searchsorted(where, np.arange(buckets + 1))
            out = [[], [], [], []]
            for b in np.nonzero(np.diff(cuts))[0].tolist():
                low, high = int(cuts[b]), int(cuts[b + 1])
                mid = low + int(np.searchsorted(rare[low:high], True))
                start = _starts(word[mid:high])
                body = [
                    np.array([mid - low, high - mid, len(start)], "<u4").tobytes(), _planes(np.diff(keys[low:mid], prepend=_U(0)), "<u8"), _planes(place[low:mid], "<u2"),
                    _planes(np.diff(word[mid:high][start], prepend=_U(0)), "<u8"), _planes(np.diff(np.r_[start, high - mid]), "<u4"), _planes(keys[mid:high], "<u8"),
                    _planes(all_n[low:high], "<u4"), _planes(target_n[low:high], "<u4"),
                ]
                for column, value in zip(out, (b, 0, name, pack(b"".join(body)))):
                    column.append(value)
            body = [
                np.array([len(docs), buckets, len(runs), len(who)], "<u4").tobytes(), _planes(np.array([d or 0 for d in docs], np.int64), "<i8"), _planes(np.array([d is None for d in docs]), "<u1"),
                _planes(sizes + 1, "<i8"), _planes(np.diff(cuts), "<u4"), _planes(runs, "<u2"), _planes(who, "<u2"), _planes(many, "<u4"),
            ]
            for column, value in zip(out, (name % buckets, 2, name, pack(b"".join(body)))):
                column.append(value)
            chunk += 1
            docs.clear(), flags.clear(), streams.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["bucket", "kind", "chunk", "payload"])

        for batch in batches:
            for doc, text, target in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                docs.append(doc)
                flags.append(bool(target))
                streams.append(np.fromiter(map(ids.__getitem__, words), _U, len(words)))
                held += len(words) + 1
                if held >= CHUNK_TOKENS or len(docs) == 65_000:
                    yield flush()
        if docs:
            yield flush()

    return run


def _read(data: bytes):
    """Bigrams of a chunk's bucket: keys, places of frequent words, rare words and their runs, counts."""
    n, m, w = np.frombuffer(data, "<u4", 3).tolist()
    read = _Reader(data)
    read.at = 12
    with np.errstate(over="ignore"):
        keys, place = np.cumsum(read(n, "<u8"), dtype=_U), read(n, "<u2")
        words = np.cumsum(read(w, "<u8"), dtype=_U)
    runs = read(w, "<u4").astype(np.int64)
    keys = np.r_[keys, read(m, "<u8")]
    return keys, place, words, runs, np.stack([read(n + m, "<u4"), read(n + m, "<u4")]).astype(np.int64)


class _Sums:
    """Counts of both models by hash."""

    def __init__(self) -> None:
        self.keys, self.n, self.fresh, self.size = np.empty(0, _U), np.empty((2, 0), np.int64), [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.fresh.append((keys, n))
        self.size += len(keys)
        if self.size > max(1_000_000, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        if self.fresh:
            k = np.concatenate([self.keys, *[f[0] for f in self.fresh]])
            n = np.concatenate([self.n, *[f[1] for f in self.fresh]], axis=1)
            order = np.argsort(k, kind="stable")
            k = k[order]
            first = _starts(k)
            self.keys, self.n = k[first], np.add.reduceat(n[:, order], first, axis=1) if len(k) else n
            self.fresh, self.size = [], 0

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.n[:, np.searchsorted(self.keys, keys)]


def _add_up(batches):
    """Adds up a bucket's counts and answers each of its chunks with the sums; sorted by bucket."""
    pack, unzip = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    bucket, held, pairs, singles = None, [], _Sums(), _Sums()
    names = ["chunk", "kind", "bucket", "payload"]

    def rows(kind, values):
        chunks, payloads = zip(*values)
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([kind] * len(chunks), pa.int32()), pa.array([bucket] * len(chunks), pa.int32()), pa.array(payloads, pa.binary())], names)

    def answers():
        pairs.settle(), singles.settle()
        for at in range(0, len(held), 64):
            out = []
            for chunk, data in held[at : at + 64]:
                keys, place, words, runs, _ = _read(unzip(data))
                n, w = pairs.of(keys), singles.of(words)
                body = [np.array([len(place), len(keys) - len(place), len(words)], "<u4").tobytes(), _planes(place, "<u2"), _planes(runs, "<u4"), *(_planes(x, "<u8") for x in (*w, *n))]
                out.append((chunk, pack(b"".join(body))))
            yield rows(1, out)

    for batch in batches:
        for b, kind, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                if held:
                    yield from answers()
                bucket, held, pairs, singles = b, [], _Sums(), _Sums()
            if kind == 2:
                yield rows(2, [(chunk, data)])
                continue
            held.append((chunk, data))
            keys, place, words, runs, n = _read(unzip(data))
            pairs.add(keys, n)
            if len(words):
                singles.add(words, np.add.reduceat(n[:, len(place) :], np.cumsum(runs) - runs, axis=1))
    if held:
        yield from answers()


SCORES = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"


def _gather(models: Models):
    """Turns a chunk's answers into its documents' rows; sorted by chunk, documents first."""

    def run(batches):
        unzip = zstandard.ZstdDecompressor().decompress
        docs = None

        def out():
            ids, n, cuts, runs, who, many, loss = docs
            of = np.repeat(np.arange(len(runs)), runs)
            ce = np.stack([np.bincount(who, many * row[of], len(n)) for row in loss]) / n
            return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(ce[0]), pa.array(ce[1]), pa.array(ce[0] - ce[1])], ["doc_id", "n_tokens", "ce_target", "ce_background", "score"])

        for batch in batches:
            for chunk, kind, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
                data = unzip(data)
                read = _Reader(data)
                if kind == 2:
                    if docs:
                        yield out()
                    size, buckets, n, m = np.frombuffer(data, "<u4", 4).tolist()
                    read.at = 16
                    ids, none, sizes = read(size, "<i8"), read(size, "<u1").astype(bool), read(size, "<i8")
                    cuts = np.r_[0, np.cumsum(read(buckets, "<u4").astype(np.int64))]
                    docs = pa.array(ids, mask=none), sizes, cuts, read(n, "<u2").astype(np.int64), read(m, "<u2").astype(np.int64), read(m, "<u4").astype(np.int64), np.full((2, n), np.nan)
                else:
                    n, m, w = np.frombuffer(data, "<u4", 3).tolist()
                    read.at = 12
                    place, runs = read(n, "<u2"), read(w, "<u4").astype(np.int64)
                    single = np.stack([read(w, "<u8"), read(w, "<u8")]).astype(float)
                    pairs = np.stack([read(n + m, "<u8"), read(n + m, "<u8")]).astype(float)
                    words = np.concatenate([models.counts[:, place], np.repeat(single, runs, axis=1)], axis=1)
                    docs[-1][:, docs[2][bucket] : docs[2][bucket + 1]] = models.losses(pairs, words)
        if docs:
            yield out()

    return run


def score(docs: DataFrame, labels: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """doc_id, n_tokens, both cross entropies and their difference for every document.

    The models know all words, or only the given number of most frequent ones.
    """
    spark = prepare(docs.sparkSession)
    good = labels.filter(labels["quality"] == 1).select(labels["doc_id"].cast("long").alias("good_id")).filter("good_id is not null").distinct().withColumn("good", F.lit(True))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    narrow = good.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(good) if narrow else good, F.col("doc_id") == F.col("good_id"), "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("target"))
    if not narrow:  # chunks must come out alike if a task runs again
        rows = rows.sortWithinPartitions("doc_id", "text")
    words = rows.select("text", "target").mapInArrow(_count_words, "word long, n long, n_target long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    words = words.persist()
    try:
        totals = words.agg(F.count("*"), F.sum("n"), F.sum("n_target")).first()
        n_words, tokens, target_tokens = totals[0], totals[1] or 0, totals[2] or 0
        hot = {r["word"] & (1 << 64) - 1: (r["n"], r["n_target"]) for r in words.filter(F.col("n") > tokens / HOT).collect()}  # fewer than HOT
        known = None
        if vocabulary is not None:
            best = {r["word"] & (1 << 64) - 1: (r["n"], r["n_target"]) for r in words.orderBy(F.col("n").desc(), "word").limit(vocabulary).collect()}
            hot = {h: n for h, n in hot.items() if h in best}
            hot[UNKNOWN] = tokens - sum(n for n, _ in best.values()), target_tokens - sum(n for _, n in best.values())
            known, n_words = np.array(sorted(best), _U), len(best)
    finally:
        words.unpersist()
    many = rows.agg(F.count("*"), F.sum(F.col("target").cast("long"))).first()
    hot[END] = many[0], many[1] or 0
    models = Models(hot, known, n_words, [tokens + many[0], target_tokens + (many[1] or 0)])
    buckets = max(1, -(-int(tokens + many[0]) // BUCKET_TOKENS))
    n = partitions(spark)
    sent = rows.mapInArrow(_send(models, buckets), "bucket int, kind int, chunk long, payload binary")
    back = sent.repartition(max(n, buckets), "bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(_add_up, "chunk long, kind int, bucket int, payload binary")
    return back.repartition(n, "chunk").sortWithinPartitions("chunk", F.col("kind").desc()).mapInArrow(_gather(models), SCORES)
