"""Repeated byte strings by the interval tree of enhanced suffix arrays, bucket by bucket.

Every window of ``width`` bytes chooses its anchor, the least hashed gram in it (leftmost of
equals).  Equal windows choose equal anchors at equal places, so the suffixes that start a
window can be bucketed by the anchor's hash, and each bucket has all occurrences of its repeats.
Consecutive windows with the same anchor form a block; blocks that are equal byte by byte (both
hashes, 128 bits) are one block with several occurrences, combined within a task before anything
is shuffled.  Buckets with one block need no sorting; for the others an enhanced suffix array
over the blocks is built, and a stack scan of its common prefixes walks the interval tree.  An
interval whose occurrences differ in the byte before them cannot be extended to the left: it is a
maximal repeat and is given with all its occurrences.  All but the earliest are removed.

Buckets of very many different blocks (a short phrase in ever new surroundings) are dealt out
again by the hashes of each whole window, 128 bits as for blocks: windows of one length need no
suffix array, only their earliest place, and their bytes need not move.  They are combined first
within a batch and then in the stream that a worker scans, so that neither a bucket nor a phrase
that a third of all documents share has to fit a worker's memory.

Defined edge cases: null or empty text has nothing to remove, nor has text shorter than the
width; matches never cross documents; doc_id orders documents and identifies their text, so
rows repeated with their doc_id are one document and get the same result; rows without a
doc_id neither remove nor are removed from.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, partitions, prepare, seeds, utf8_values
from .minhash import packed

WIDTH, GRAM = 100, 24
#: Bytes hashed at a time, bytes of blocks sorted at a time, different blocks of a plain bucket.
PIECE, SORTED, BLOCKS = 2_000_000, 1_000_000, 4096
#: Bytes that positions beside an anchor's hash can tell apart: no more are hashed at a time.
PLACES = 1 << 24
_U = np.uint64
_BYTE = seeds(256, 5)
_B = _U(0x9E3779B97F4A7C15)
_OTHER, _C = seeds(256, 6), _U(0xD1342543DE82EF95)
_POWERS = {}


def _power(n: int) -> np.uint64:
    return _U(pow(int(_B), n, 1 << 64))


def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all substrings of gram bytes (a multiple of 8), by doubling."""
    with np.errstate(over="ignore"):
        h, n = _BYTE[text], 1
        while n < 8:
            h, n = h[:-n] * _power(n) + h[n:], 2 * n
        out, eight = h, h
        for k in range(1, gram // 8):
            out = out[:-8] * _power(8) + eight[8 * k :]
        return mix64(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of width."""
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def blocks_of(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor hash, block hash) of each block of the texts."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(flat) < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    if len(flat) > PLACES:
        raise ValueError(f"more than {PLACES} bytes at a time")
    h = gram_hashes(flat, gram)
    spot = _least((h >> _U(24) << _U(24)) | np.arange(len(h), dtype=_U), width - gram + 1)
    anchor = (spot & _U(PLACES - 1)).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    fits = np.arange(len(anchor)) + width <= (begins + sizes)[owner]
    at = np.nonzero(fits)[0]
    if not len(at):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    who, where = owner[at], anchor[at]
    head = np.nonzero(np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1])])[0]
    first, many, spots = at[head], np.diff(np.r_[head, len(at)]), where[head]
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.r_[_U(1), np.full(len(flat), _B)])
        back = np.multiply.accumulate(np.r_[_U(1), np.full(len(flat), _U(pow(int(_B), -1, 1 << 64)))])
        total = np.r_[_U(0), np.add.accumulate(_BYTE[flat] * power[:-1])]
        body = (total[first + many - 1 + width] - total[first]) * back[first]
        body = mix64(body + (spots - first).astype(_U) * _U(0xD6E8FEB86659FD93) + many.astype(_U) * _U(0xA0761D6478BD642F))
    return who[head], first - begins[who[head]], many, h[spots], body


def _earliest(key: np.ndarray, body: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, block and place; which of it are first of their block; each one's first."""
    order = np.lexsort((at, doc, body, key))
    k, b = key[order], body[order]
    first = np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])]
    return order, first, np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.r_[True, doc[1:] != doc[:-1]]
    # ends run on within a document: shift documents apart so that one running maximum does
    group = np.cumsum(new) - 1
    room = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * room) - group * room
    new[1:] |= start[1:] > reach[:-1]
    head = np.nonzero(new)[0]
    return doc[head], start[head], np.maximum.reduceat(end, head)


BLOCK_ROWS = "key long, body long, doc long, at long, span long"


def _rows(names, *columns):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == _U else c) for c in columns], names)


def _split(doc, text: bytes):
    """Very long texts in overlapping pieces: each window lies in one of them."""
    for at in range(0, max(len(text) - WIDTH + 1, 1), 8 * PIECE):
        yield doc, at, text[at : at + 8 * PIECE + WIDTH - 1]


def _send_blocks(batches):
    """Blocks of each document; repetitions within the piece at hand are decided here.

    span: number of windows of a block; negative, the length of a range to remove.
    """
    names = ["key", "body", "doc", "at", "span"]

    def settle(held):
        docs = np.array([d for d, _, _ in held], np.int64)
        base = np.array([a for _, a, _ in held], np.int64)
        who, at, many, key, body = blocks_of([t for _, _, t in held])
        doc, at = docs[who], at + base[who]
        order, first, of = _earliest(key, body, doc, at)
        doc, at, many, key, body = doc[order], at[order], many[order], key[order], body[order]
        again = ~first & ((doc != doc[of]) | (at != at[of]))
        d, s, e = _spans(doc[again], at[again], at[again] + many[again] + WIDTH - 1)
        yield _rows(names, *(np.concatenate(p) for p in ((key[first], mix64(d.astype(_U))), (body[first], np.zeros(len(d), _U)), (doc[first], d), (at[first], s), (many[first], s - e))))

    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1))):
            if doc is None or len(text) < WIDTH:
                continue
            for part in _split(doc, text):
                if held and size + len(part[2]) > PLACES:
                    yield from settle(held)
                    held, size = [], 0
                held.append(part)
                size += len(part[2])
                if size >= PIECE:
                    yield from settle(held)
                    held, size = [], 0
    if held:
        yield from settle(held)


FOUND_ROWS = "kind int, key long, doc long, at long, span long"


def _buckets(batches):
    """Sorted by bucket, block, place: ranges of repeated blocks (kind 0), and the first of each
    block of a bucket that has several (1; 2 in a bucket of very many)."""
    names = ["kind", "key", "doc", "at", "span"]
    now, body, lead, waiting, many = None, None, None, [], 0
    out: list[tuple] = []

    for batch in batches:
        for key, b, doc, at, span in zip(*(c.to_pylist() for c in batch.columns)):
            if span < 0:
                out.append((0, key, doc, at, -span))
                continue
            if key != now:
                if many > 1:
                    out += [(1 + (many > BLOCKS), *w) for w in waiting]
                now, body, waiting, many = key, None, [], 0
            if b != body:
                body, lead = b, (doc, at)
                waiting.append((key, doc, at, span))
                many += 1
                if many > BLOCKS:
                    out += [(2, *w) for w in waiting]
                    waiting = []
            elif (doc, at) != lead:
                out.append((0, key, doc, at, span + WIDTH - 1))
        if len(out) > 50_000:
            yield _table(names, out)
            out = []
    if many > 1:
        out += [(1 + (many > BLOCKS), *w) for w in waiting]
    if out:
        yield _table(names, out)


def _table(names, rows):
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names)


SEGMENTS = "key long, body long, doc long, at long, span long, bytes binary"


def _window_hashes(flat: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Two hashes of the windows of flat that begin at starts."""
    out = []
    with np.errstate(over="ignore"):
        for table, base in ((_BYTE, int(_B)), (_OTHER, int(_C))):
            power = np.multiply.accumulate(np.r_[_U(1), np.full(len(flat), _U(base))])
            back = np.multiply.accumulate(np.r_[_U(1), np.full(len(flat), _U(pow(base, -1, 1 << 64)))])
            total = np.r_[_U(0), np.add.accumulate(table[flat] * power[:-1])]
            out.append(mix64((total[starts + width] - total[starts]) * back[starts]))
    return out


def _cut(batches):
    """What a document has to bring to its buckets: the bytes of its blocks (span 0), or the hashes
    of their windows (span 1); windows that stand earlier in the batch are ranges to remove (span
    is their length, negative)."""
    unzip = zstandard.ZstdDecompressor().decompress
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def windows(pieces):
        docs, ats, spans, texts = zip(*pieces)
        spans = np.array(spans, np.int64)
        begins = np.cumsum(spans) - spans
        step = np.arange(int(spans.sum())) - np.repeat(begins, spans)  # within a piece
        starts = step + np.repeat(begins + (WIDTH - 1) * np.arange(len(spans)), spans)
        doc, at = np.repeat(np.array(docs, np.int64), spans), step + np.repeat(np.array(ats, np.int64), spans)
        key, body = _window_hashes(np.frombuffer(b"".join(texts), np.uint8), starts)
        order, first, of = _earliest(key, body, doc, at)
        key, body, doc, at = key[order], body[order], doc[order], at[order]
        again = ~first & ((doc != doc[of]) | (at != at[of]))
        d, s, e = _spans(doc[again], at[again], at[again] + WIDTH)
        made = _rows(names[:5], *(np.concatenate(p) for p in ((key[first], mix64(d.astype(_U))), (body[first], np.zeros(len(d), _U)), (doc[first], d), (at[first], s), (np.ones(int(first.sum()), np.int64), s - e))))
        return pa.RecordBatch.from_arrays([*made.columns, pa.nulls(made.num_rows, pa.binary())], names)

    for batch in batches:
        rows: list[tuple] = []
        held, size = [], 0
        for doc, blob, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            text = unzip(blob)
            for w in wanted:
                at, end = w["at"], w["at"] + w["span"]
                if w["kind"] == 1:
                    rows.append((w["key"], 0, doc, at, 0, text[at : end + WIDTH - 1]))
                    continue
                while at < end:
                    span = min(end - at, PIECE // 8)
                    held.append((doc, at, span, text[at : at + span + WIDTH - 1]))
                    at, size = at + span, size + span
                    if size >= PIECE // 8:
                        yield windows(held)
                        held, size = [], 0
        if held:
            yield windows(held)
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names)


class SuffixArray:
    """An enhanced suffix array over blocks: order, common prefixes and bytes to the left.

    Suffixes are those that start a window; a bucket's stay together, and none runs beyond its
    block.  Ranks of 7, 14, ... bytes order them by prefix doubling and give common prefixes.
    """

    def __init__(self, buckets: list[int], blocks: list[bytes], width: int = WIDTH) -> None:
        sizes = np.array([len(b) for b in blocks], np.int64)
        flat = np.frombuffer(b"".join(blocks), np.uint8)
        n = len(flat)
        self.block = np.repeat(np.arange(len(blocks)), sizes)
        begins = np.cumsum(sizes) - sizes
        self.at = np.arange(n) - begins[self.block]
        left = sizes[self.block] - self.at  # bytes to the block's end
        symbols = np.zeros((7, n), np.int64)
        for k in range(7):
            symbols[k, : n - k] = np.where(left[: n - k] > k, flat[k:].astype(np.int64) + 1, 0) if k else flat + np.int64(1)
        word = np.zeros(n, np.int64)
        for row in symbols:
            word = word << 9 | row
        rank = np.unique(word, return_inverse=True)[1]
        bucket = np.unique(np.array(buckets), return_inverse=True)[1][self.block]
        rank = np.unique(bucket * (int(rank.max(initial=0)) + 1) + rank, return_inverse=True)[1]
        self.ranks, step = [(7, rank.astype(np.int32))], 7
        longest = int(sizes.max(initial=0))
        while step < longest:
            second = np.zeros(n, np.int64)
            second[: n - step] = np.where(left[: n - step] > step, rank[step:] + 1, 0)
            rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1]
            step *= 2
            self.ranks.append((step, rank.astype(np.int32)))
        starts = np.nonzero(left >= width)[0]
        self.order = starts[np.argsort(rank[starts], kind="stable")]
        self.left, self.flat, self.bucket = left, flat, bucket
        self.before = np.where(self.at[self.order] > 0, flat[self.order - 1].astype(np.int64), -1)
        self.common = self._common()

    def _common(self) -> np.ndarray:
        """Bytes that each suffix shares with the one before it in order."""
        i, j = self.order[:-1].copy(), self.order[1:].copy()
        out = np.zeros(len(self.order), np.int64)
        if not len(i):
            return out
        room = np.minimum(self.left[i], self.left[j])
        got = np.zeros(len(i), np.int64)
        same = self.bucket[i] == self.bucket[j]
        for step, rank in reversed(self.ranks):
            a, b = i + got, j + got
            ok = same & (got < room)
            a, b = np.where(ok, a, 0), np.where(ok, b, 0)
            ok &= (rank[a] == rank[b])
            got += np.where(ok, step, 0)
        got = np.minimum(got, room)
        for _ in range(7):
            ok = same & (got < room)
            a, b = np.where(ok, i + got, 0), np.where(ok, j + got, 0)
            got += ok & (self.flat[a] == self.flat[b])
        out[1:] = np.where(same, got, 0)
        return out


def maximal_repeats(array: SuffixArray, width: int = WIDTH):
    """(length, suffixes in the array's order) of each maximal repeat of width bytes at least.

    A stack holds the open intervals while the common prefixes are scanned; an interval closes
    when they fall below its length.  Intervals with one byte before all their occurrences are
    not maximal (a block's first suffix counts as different: what precedes it is elsewhere).
    """
    common, before = array.common, array.before
    n = len(common)
    if n < 2:
        return
    runs = np.nonzero(common < width)[0]  # tops of the tree: stretches that share width bytes
    ends = np.r_[runs[1:], n]
    wide = ends - runs > 1
    runs, ends = runs[wide], ends[wide]
    if not len(runs):
        return
    bounds = np.column_stack([runs, ends]).reshape(-1)
    bounds = bounds[:-1] if bounds[-1] == n else bounds
    low, high = np.minimum.reduceat(before, bounds)[::2], np.maximum.reduceat(before, bounds)[::2]
    for lo, hi in zip(runs[(low != high) | (low < 0)].tolist(), ends[(low != high) | (low < 0)].tolist()):
        heights = common[lo + 1 : hi].tolist()
        stack: list[tuple[int, int]] = []
        for k, height in enumerate([*heights, 0], start=lo + 1):
            start = k - 1
            while stack and stack[-1][0] > height:
                length, start = stack.pop()
                left = before[start:k]
                if left.min() < 0 or left.min() != left.max():
                    yield length, array.order[start:k]
            if height and (not stack or stack[-1][0] < height):
                stack.append((height, start))


RANGES = "doc long, start long, end long"


def _scan(batches):
    """Ranges to remove: all occurrences of maximal repeats but the earliest; sorted by bucket."""

    def settle(rows):
        array = SuffixArray([r[0] for r in rows], [r[3] for r in rows])
        doc, base = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        d, s, e = [], [], []
        for length, suffixes in maximal_repeats(array):
            of = array.block[suffixes]
            docs, at = doc[of], base[of] + array.at[suffixes]
            first = np.lexsort((at, docs))[0]
            other = (docs != docs[first]) | (at != at[first])
            d.append(docs[other]), s.append(at[other]), e.append(at[other] + length)
        if d:
            d, s, e = _spans(np.concatenate(d), np.concatenate(s), np.concatenate(e))
            yield _rows(["doc", "start", "end"], d, s, e)

    def windows(key, body, doc, at):
        """Places of windows that stand earlier in the stream; by its hashes a window is told from
        another that shares the first of them."""
        nonlocal last, leads
        order = np.lexsort((np.arange(len(key)), body, key))
        key, body, doc, at = key[order], body[order], doc[order], at[order]
        first = np.r_[True, (key[1:] != key[:-1]) | (body[1:] != body[:-1])]
        head = np.nonzero(first)[0]
        group = np.cumsum(first) - 1
        docs, ats = doc[head], at[head]
        for g in range(int((key[head] == last).sum()) if last is not None else 0):  # the first keys are the least
            docs[g], ats[g] = leads.get(int(body[head[g]]), (docs[g], ats[g]))
        of = key[head] == key[-1]
        found = {b: (d, a) for b, d, a in zip(body[head[of]].tolist(), docs[of].tolist(), ats[of].tolist())}
        leads = leads | found if last == key[-1] else found
        last = int(key[-1])
        again = (doc != docs[group]) | (at != ats[group])
        return doc[again], at[again]

    held, size, key = [], 0, None
    last, leads = None, {}  # the last window's key and the earliest places of its windows
    first = b"", None  # the key's earliest block, where it is a single window, and its place
    for batch in batches:
        of = [np.asarray(batch.column(c)) for c in range(5)]
        span = of[4]
        if (span < 0).any():
            yield _rows(["doc", "start", "end"], of[2][span < 0], of[3][span < 0], (of[3] - span)[span < 0])
        again = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if (span > 0).any():
            again.append(windows(*(c[span > 0] for c in of[:4])))
        places = []
        whole = batch.filter(pa.array(span == 0)) if (span != 0).any() else batch
        for row in zip(*(whole.column(c).to_pylist() for c in (0, 2, 3, 5))):
            if row[0] != key:
                if size >= SORTED:
                    yield from settle(held)
                    held, size = [], 0
                key, first = row[0], (row[3] if len(row[3]) == WIDTH else b"", row[1:3])
            elif row[3] == first[0]:
                if row[1:3] != first[1]:
                    places.append(row[1:3])
                continue
            held.append(row)
            size += len(row[3])
        if places:
            again.append(tuple(np.array(c, np.int64) for c in zip(*places)))
        d, s = (np.concatenate(c) for c in zip(*again))
        if len(d):
            yield _rows(["doc", "start", "end"], d, s, s + WIDTH)
    if held:
        yield from settle(held)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _report(batches):
    unzip = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for doc, blob, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            text = unzip(blob)
            gone = merged([(r["start"], r["end"]) for r in ranges or []])
            digest, at = hashlib.sha256(), 0
            for a, b in gone:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((doc, len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], [x.split()[0] for x in REPORT.split(", ")])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, start, end): ranges whose every window of 100 bytes also starts earlier; they overlap."""
    n = partitions(docs.sparkSession)
    sent = docs.mapInArrow(_send_blocks, BLOCK_ROWS)
    found = sent.repartition(n, "key").sortWithinPartitions("key", "body", "doc", "at").mapInArrow(_buckets, FOUND_ROWS)
    found = materialise(found, "blocks")
    wanted = found.filter("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "at", "span")).alias("wanted"))
    texts = packed(docs.filter("doc_id is not null")).withColumnRenamed("doc_id", "doc")
    cut = texts.join(wanted, "doc").select("doc", "blob", "wanted").mapInArrow(_cut, SEGMENTS)
    scanned = cut.repartition(n, "key").sortWithinPartitions("key", "doc", "at").mapInArrow(_scan, RANGES)
    plain = found.filter("kind = 0").select("doc", F.col("at").alias("start"), (F.col("at") + F.col("span")).alias("end"))
    return plain.unionByName(scanned)


def repeat_report(docs: DataFrame) -> DataFrame:
    """What is left of each document without bytes of earlier-seen strings of 100 bytes."""
    prepare(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    ranges = repeated_ranges(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return packed(docs).join(ranges, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "blob", "ranges").mapInArrow(_report, REPORT)
