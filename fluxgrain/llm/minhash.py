"""Near-duplicate groups by min-max hashing of word shingles, links confirmed on full sets.

Each permutation gives two signature values, the least and the greatest image of a set, so half
as many hash evaluations fill the same bands.  Documents with equal sets are one class first;
representatives that share a band are candidates.  Every candidate is compared with the most
central member of its bucket.  In a bucket that then holds several components, its members are
compared with a member drawn anew, as long as that joins many of them, so that a family of
thousands of near copies is connected by a few comparisons each.  In what stays open, members
meet block by block, by a parity word of each set that bounds the symmetric difference from
below, and every pair across components that it cannot rule out is compared as well.  All links
are confirmed exactly, on whole shingle sets.

Words are runs of bytes other than ASCII white space, A-Z lowered.  A set holds the distinct
k-word shingles, the whole sequence if the text is shorter, and nothing without words.

Defined edge cases: null or empty text has no shingles and no links; rows of the same doc_id are
one document; rows with a null doc_id take no part in links and come back with a null component.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, materialise, mix64, prepare, release, seeds, utf8_values
from .graph import connected_components

#: Chance at most that two documents right at the threshold share no band; signature values.
MISS, VALUES = 1e-6, 128
#: Shingles handled at a time, words kept by a worker, members of a block in a large bucket, bits
#: of a parity word.
CHUNK, KEPT, BLOCK, BITS = 400_000, 500_000, 1024, 512
#: Buckets of more members than this get a new centre, for at most so many rounds, while a round
#: joins one in ten of those it compared.
LARGE, STARS, JOINED = 64, 6, 0.1
_U = np.uint64


class Words(dict):
    """64-bit hashes of words, kept between texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Words()


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    n = len(words)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], _U)
    h = np.fromiter(map(WORDS.__getitem__, words), _U, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - k + 1, _U)
        for i in range(k):
            out = mix64(out + h[i : n - k + 1 + i])
    return np.unique(out)


def bands(threshold: float, miss: float = MISS, values: int = VALUES) -> tuple[int, int]:
    """(rows of a band, bands): the longest bands that fit the values and miss rarely enough."""
    best = (1, values)
    for r in range(1, 17):
        b = math.ceil(math.log(miss) / math.log1p(-(threshold**r))) if threshold < 1 else 1
        if r * b <= values:
            best = (r, b)
    return best


def signatures(sets: list[np.ndarray], rows: int, count: int) -> np.ndarray:
    """Band keys, a row for each set (none may be empty): minima first, then maxima."""
    perms = -(-rows * count // 2)
    mult, add = seeds(perms, 11) | _U(1), seeds(perms, 29)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = np.concatenate(sets)
    sig = np.empty((2 * perms, len(sets)), _U)
    with np.errstate(over="ignore"):
        for p in range(perms):
            y = x * mult[p] + add[p]
            y ^= y >> _U(32)
            y *= mult[p]
            sig[p], sig[perms + p] = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
        keys = np.empty((len(sets), count), _U)
        for b in range(count):
            h = np.full(len(sets), b + 1, _U)
            for row in sig[b * rows : (b + 1) * rows]:
                h = mix64(h + row)
            keys[:, b] = h
    return keys


def parity(s: np.ndarray) -> bytes:
    """For each slot, whether oddly many elements fall into it: equal elements of two sets cancel,
    so the bits in which two words differ are at most the symmetric difference."""
    return np.packbits(np.bincount((s & _U(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, parity binary"


def signature_table(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Size, 128-bit digest and band keys of each document's set."""
    rows, count = bands(threshold)

    def run(batches):
        from fluxgrain.llm import minhash  # the worker's own module keeps its words between tasks

        begin("minhash", minhash.WORDS.clear)
        for batch in batches:
            sizes, digests, keys, words, group, held = [], [], [], [], [], 0

            def flush():
                nonlocal held
                full = [s for s in group if len(s)]
                got = iter(minhash.signatures(full, rows, count)) if full else iter(())
                for s in group:
                    sizes.append(len(s))
                    words.append(minhash.parity(s))
                    with np.errstate(over="ignore"):
                        digests.append((int(np.add.reduce(s)) if len(s) else 0, int(np.add.reduce(minhash.mix64(s ^ _U(0x5851F42D4C957F2D)))) if len(s) else 0))
                    keys.append(minhash._as_long(next(got)) if len(s) else None)
                group.clear()
                held = 0

            for text in utf8_values(batch.column(1)):
                group.append(minhash.shingles(text, k))
                held += len(group[-1])
                if held > CHUNK:
                    flush()
            flush()
            d = np.array(digests, _U).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(_as_long(d[:, 0].copy())), pa.array(_as_long(d[:, 1].copy())), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "parity"],
            )

    return docs.mapInArrow(run, SIGNATURE)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and the text, compressed: what a comparison needs moves at a third of its size."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(t) for t in utf8_values(batch.column(1))], pa.binary())], ["doc_id", "blob"])

    return docs.mapInArrow(run, "doc_id long, blob binary")


def _similar(inter: int, a: int, b: int, share: int) -> bool:
    return 100 * inter >= share * (a + b - inter)


def _verify(pairs: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs whose full sets are similar enough; rows (a, b, blob_a, blob_b), b repeating."""

    def run(batches):
        from fluxgrain.llm import minhash

        begin("minhash", minhash.WORDS.clear)
        unzip = zstandard.ZstdDecompressor().decompress
        kept = None, None
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if kept[0] != b:
                    kept = b, minhash.shingles(unzip(y), k)
                s, t = minhash.shingles(unzip(x), k), kept[1]
                if len(s) and len(t) and minhash._similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), share):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[], []])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, blobs: DataFrame, k: int, share: int) -> DataFrame:
    left, right = blobs.select(F.col("doc_id").alias("a"), F.col("blob").alias("blob_a")), blobs.select(F.col("doc_id").alias("b"), F.col("blob").alias("blob_b"))
    return _verify(pairs.join(left, "a").join(right, "b").select("a", "b", "blob_a", "blob_b"), k, share)


def _block_pairs(share: int):
    """Pairs across components, within two blocks of a bucket, that parity doesn't rule out.

    Sets of a and b elements are similar enough with a symmetric difference of at most
    (a + b) * (100 - share) / (100 + share).
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("doc").sort_values("doc")
        docs, comp, size = (part[c].to_numpy() for c in ("doc", "comp", "n_shingles"))
        words = np.frombuffer(b"".join(part["parity"]), _U).reshape(len(part), -1)
        out = []
        for i in range(len(docs) - 1):
            apart = np.bitwise_count(words[i] ^ words[i + 1 :]).sum(1, dtype=np.int64)
            near = (apart * (100 + share) <= (size[i] + size[i + 1 :]) * (100 - share)) & (comp[i] != comp[i + 1 :])
            out += [(int(d), int(docs[i])) for d in docs[i + 1 :][near]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _held(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets with their components so far."""
    parts = connected_components(links)
    return shared.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")


def _open(held: DataFrame, *more) -> DataFrame:
    """key and n of the buckets that hold several components."""
    return held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), *more).filter("low < high")


def _again(shared: DataFrame, blobs: DataFrame, links: DataFrame, k: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with their components, and links, after rounds in which members of large
    open buckets are compared with a new centre: one drawn by hash, in each round another, from the
    component that has most members in the bucket."""
    held = materialise(_held(shared, links), "held")
    for turn in range(STARS):
        large = _open(held).filter(F.col("n") > LARGE).select("key")
        of = held.join(large, "key")
        # the centre: of the component with most members in the bucket, the member of the least hash
        parts = of.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("doc", F.lit(turn)), "doc")).alias("drawn"))
        centre = parts.groupBy("key").agg(F.max(F.struct("size", (-F.col("comp")).alias("minus"), F.col("drawn.doc").alias("centre"))).alias("top"))
        pairs = of.join(centre, "key").filter(F.col("comp") != -F.col("top.minus")).select(F.greatest("doc", "top.centre").alias("a"), F.least("doc", "top.centre").alias("b")).distinct()
        pairs = materialise(pairs, "pairs")
        asked = pairs.count()
        if not asked:
            break
        found = materialise(_confirm(pairs, blobs, k, share), "links")
        joined = found.count()
        release(pairs)
        if joined:
            links, old = materialise(links.unionByName(found), "links"), (links, held, found)
            held = materialise(_held(shared, links), "held")
            release(*old)
        if joined < JOINED * asked:
            break
    return held, links


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; linked are documents with
    100 * intersection >= share * union."""
    prepare(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sig = materialise(signature_table(docs, k, share / 100), "signatures")
    some = sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    of = materialise(some.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "rep"), "classes")
    reps = some.join(of.filter(F.col("doc_id") == F.col("rep")).select("doc_id").distinct(), "doc_id", "left_semi")
    member = reps.select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("band", "value")).select("doc", F.xxhash64("band", "value").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > 1)
    shared = materialise(member.join(sizes, "key"), "buckets")
    ranked = shared.withColumn("degree", F.sum("many").over(Window.partitionBy("doc")))  # a row per band and document
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc")).alias("minus"))).alias("top"), F.min("doc").alias("least"))
    star = shared.join(centre, "key").select("doc", F.explode(F.array_distinct(F.array(-F.col("top.minus"), F.col("least")))).alias("other"))
    star = materialise(star.filter("doc <> other").select(F.greatest("doc", "other").alias("a"), F.least("doc", "other").alias("b")).distinct(), "pairs")
    wanted = shared.select(F.col("doc").alias("doc_id")).distinct()
    blobs = materialise(packed(docs).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    links = materialise(_confirm(star, blobs, k, share), "links")
    release(star)
    held, links = _again(shared, blobs, links, k, share)
    open_ = _open(held, F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("print"))
    open_ = open_.groupBy("print", "n").agg(F.min("key").alias("key"))  # buckets of the same members count once
    blocks = held.join(open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    blocks = blocks.withColumn("i", F.pmod(F.hash("doc"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("key", "doc", "comp", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))
    words = reps.select(F.col("doc_id").alias("doc"), "n_shingles", "parity").dropDuplicates(["doc"])
    rest = blocks.join(words, "doc").groupBy("key", "x", "y").applyInPandas(_block_pairs(share), "a long, b long").distinct()
    more = _confirm(materialise(rest, "pairs"), blobs, k, share)
    parts = connected_components(links.unionByName(more))
    final = of.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    final = final.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
