"""Sequence packing by linear grouping and best fit, planned on the histogram of lengths.

Lengths are whole numbers up to the capacity, so a histogram of at most ``capacity`` counts
describes any corpus; the plan is made on it alone, whatever the number of documents:

1. large pieces are sorted and cut into groups of equal cardinality, each rounded up to its
   longest member (linear grouping);
2. configurations of the few rounded sizes are optimised by column generation (a covering LP;
   knapsacks price the columns) and rounded down; those that leave more than a small share of the
   capacity empty are passed over, and what is left goes to best fit decreasing;
3. actual lengths take the places of the rounded ones, run by run;
4. small pieces fill what is left, longest first, each into the fullest sequence that holds it.

The plan is a list of runs: ranks of a length, the first sequence, and how many of them each
sequence takes at which offset.  Pieces get ranks within their length from counts by (length,
bucket), so that no length, however common, meets in one task, and look their run up among those
of their (length, bucket): a join by equality, of a table that the capacity bounds.

Defined edge cases: null or empty text is the closing id alone (length 1); a document longer
than the capacity is cut into full pieces and a shorter last one; repeated rows are pieces of
their own; an empty table has no sequences.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, materialise, prepare

CAPACITY, END_ID, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Ways to plan: pieces above this share of the capacity are large; the number of their groups; the
#: share of the capacity that a configuration may leave empty.
SETTINGS = ((1 / 3, 128, 1 / 500), (1 / 5, 128, 1 / 200), (1 / 2, 64, 1.0))
#: A plan is kept at once if it needs at most this share more sequences than the tokens alone do;
#: else the best one is.
NEAR = 1 / 1000
#: Buckets of doc_id hashes by which ranks are counted.
RANK_BUCKETS = 64
#: A Python worker keeps the ids of word pieces in two halves of about this many: when the newer
#: one is full it becomes the older, and what the older held and no text has asked for since goes.
KEPT = 350_000
#: Texts of these characters alone are split by us just as the tokenizer would: letters that
#: are their own NFC form and lower one by one, ASCII digits, marks but the apostrophe, and space.
_OTHER = re.compile("[^A-Za-zÀ-ÖØ-öø-ÿ0-9\t\n\r -&(-~]|<\\|")
_PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t\n\r ]+")


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, by the pieces that the tokenizer splits
    a text into: it encodes each by itself, so the ids of a piece are kept.

    Texts with other characters than plain ones go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """The ids of pieces, many to a call."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(t) + 1 for t in part])
            owner = np.searchsorted(ends, [o[0] for o in got.offsets], side="right")
            cuts = (4 * np.searchsorted(owner, np.arange(len(part) + 1))).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            self.known.update((w, raw[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out: list = [None] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        fresh: set[str] = set()
        for k, text in enumerate(texts):
            if _OTHER.search(text):
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            found = _PIECE.findall(text.lower())
            ids = list(map(known.get, found))
            if None in ids:
                fresh.update([w for w, i in zip(found, ids) if i is None])
                waiting.append((k, found))
            else:
                out[k] = b"".join(ids)
        known.update([(w, older[w]) for w in fresh if w in older])
        self._learn([w for w in fresh if w not in known])
        for k, found in waiting:
            out[k] = b"".join(map(known.__getitem__, found))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder per tokenizer and worker; a path or the name of a public tokenizer."""
    if name not in _ENCODERS:
        path = name
        if not os.path.exists(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[name] = Encoder(path)
    return _ENCODERS[name]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: place and checksum of its ids, at most capacity each."""
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches):
        from fluxgrain.llm import packing  # the worker's own module, so that encoders are kept between tasks

        begin("packing", packing._ENCODERS.clear)
        enc, end, width = packing.encoder(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for ident, raw in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                rows += [(ident, k, at // 4, len(part := raw[at : at + width]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(raw), width))]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES)], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)


def _price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of most dual value that fits: an unbounded knapsack over the sizes."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for room in range(smallest, capacity + 1):
        gains = np.where(sizes <= room, best[np.maximum(room - sizes, 0)] + duals, -1.0)
        k = int(gains.argmax())
        if gains[k] > best[room - 1] + 1e-12:
            best[room], last[room] = gains[k], k
        else:
            best[room] = best[room - 1]
    column, room = np.zeros(len(sizes), int), capacity
    while room >= smallest:
        if last[room] >= 0:
            column[last[room]] += 1
            room -= int(sizes[last[room]])
        else:
            room -= 1
    return column, float(best[capacity])


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, waste: float = 1.0, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(items of each size, times used) of configurations that leave at most the share of waste
    empty, whole times only: the covering LP rounded down."""
    n = len(sizes)
    if not n:
        return []
    basis = np.diag(capacity // sizes).astype(float)  # columns: configurations of one size
    use = counts / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        column, value = _price(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(way > 1e-10, use / np.where(way > 1e-10, way, 1), np.inf)
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        step = ratio[k]
        use = np.maximum(use - step * way, 0)
        use[k] = step
        basis[:, k] = column
    full = sizes @ np.rint(basis) >= capacity * (1 - waste)
    return [(np.rint(basis[:, k]).astype(int), int(use[k] + 1e-9)) for k in range(n) if full[k] and use[k] >= 1 - 1e-9]


class Plan:
    """Runs of a packing and the room that its sequences still have."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.free: list[int] = []  # the rooms that occur, ascending
        self.room: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
        self.rank: dict[int, int] = {}

    def add_room(self, room: int, first: int, many: int) -> None:
        if many and room:
            if room not in self.room:
                bisect.insort(self.free, room)
                self.room[room] = []
            self.room[room].append((first, many))

    def run(self, length: int, many: int, first: int, per: int, offset: int) -> None:
        """many pieces of a length, per of them in each sequence from first on."""
        at = self.rank.get(length, 0)
        self.runs.append((length, at, at + many, first, per, offset))
        self.rank[length] = at + many

    def open(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def fill(self, length: int, many: int) -> None:
        """Best fit: the fullest sequences that still hold the length, else new ones."""
        while many:
            k = bisect.bisect_left(self.free, length)
            if k == len(self.free):
                fit = self.capacity // length
                first, there, room = self.open(-(-many // fit)), -(-many // fit), self.capacity
            else:
                room = self.free[k]
                first, there = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room]
                    self.free.pop(k)
            fit = room // length
            whole, rest = divmod(min(many, fit * there), fit)
            if whole:
                self.run(length, whole * fit, first, fit, self.capacity - room)
                self.add_room(room - fit * length, first, whole)
            if rest:
                self.run(length, rest, first + whole, rest, self.capacity - room)
                self.add_room(room - rest * length, first + whole, 1)
            self.add_room(room, first + whole + (rest > 0), there - whole - (rest > 0))
            many -= whole * fit + rest


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack a histogram of lengths by the best of SETTINGS; every count is placed."""
    least = -(-sum(s * c for s, c in histogram.items()) // capacity)
    best: Plan | None = None
    for large_share, groups, waste in SETTINGS:
        made = plan_by(histogram, capacity, large_share, groups, waste)
        if best is None or made.sequences < best.sequences:
            best = made
        if best.sequences <= least * (1 + NEAR):
            break
    return best


def plan_by(histogram: dict[int, int], capacity: int, large_share: float, groups: int, waste: float = 1.0) -> Plan:
    """Linear grouping of the large lengths, configurations, substitution, best fit."""
    out = Plan(capacity)
    left = {s: c for s, c in histogram.items() if c}
    if full := left.pop(capacity, 0):
        out.run(capacity, full, out.open(full), 1, 0)
    large = sorted((s for s in left if s > large_share * capacity), reverse=True)
    total = sum(left[s] for s in large)
    if total:
        quota = -(-total // groups)
        queues: list[list[list[int]]] = [[]]  # by group: [length, count], longest first
        room = quota
        for s in large:
            c = left[s]
            while c:
                if not room:
                    queues.append([])
                    room = quota
                take = min(c, room)
                queues[-1].append([s, take])
                c, room = c - take, room - take
        sizes = np.array([q[0][0] for q in queues])
        counts = np.array([sum(c for _, c in q) for q in queues])
        # groups of one rounded size are one size to the programme
        distinct = sorted(set(sizes.tolist()), reverse=True)
        merged: dict[int, list[list[int]]] = {s: [] for s in distinct}
        for s, q in zip(sizes.tolist(), queues):
            merged[s] += q
        weight = np.array([sum(c for _, c in merged[s]) for s in distinct])
        for column, times in configurations(np.array(distinct), weight, capacity, waste):
            slots = [merged[s] for s, n in zip(distinct, column.tolist()) for _ in range(n)]
            while times and all(slots):
                need: dict[int, int] = {}
                for q in slots:
                    need[id(q)] = need.get(id(q), 0) + 1
                many = min([times, *(q[0][1] // need[id(q)] for q in slots)])
                if many:
                    lengths = [(q, q[0][0]) for q in slots]
                else:  # a run ends inside one sequence: take its pieces one by one
                    many, lengths, short = 1, [], False
                    for q in slots:
                        if not q:
                            short = True
                            break
                        lengths.append((None, q[0][0]))
                        q[0][1] -= 1
                        if not q[0][1]:
                            q.pop(0)
                    if short:
                        for _, s in lengths:
                            out.fill(s, 1)
                        times = 0
                        break
                first, place = out.open(many), 0
                for q, s in lengths:
                    out.run(s, many, first, 1, place)
                    place += s
                    if q is not None:
                        q[0][1] -= many
                for q in {id(q): q for q in slots}.values():
                    while q and not q[0][1]:
                        q.pop(0)
                out.add_room(capacity - place, first, many)
                times -= many
        rest: dict[int, int] = {}
        for q in merged.values():
            for s, c in q:
                rest[s] = rest.get(s, 0) + c
        for s in sorted(rest, reverse=True):
            out.fill(s, rest[s])
    for s in sorted((s for s in left if s <= large_share * capacity), reverse=True):
        out.fill(s, left[s])
    return out


def _by_cell(cells: list[tuple], runs: list[tuple]) -> list[tuple]:
    """(length, bucket, before, low, high, first, per, head): the runs that each cell's ranks, from
    before on, fall into.  Runs of a length follow one another without a gap."""
    of: dict[int, list[tuple]] = {}
    for length, *run in runs:
        of.setdefault(length, []).append(tuple(run))
    out = []
    for length, bucket, before, count in cells:
        mine = of[length]
        k = bisect.bisect_right(mine, before, key=lambda r: r[0]) - 1
        while k < len(mine) and mine[k][0] < before + count:
            out.append((length, bucket, before, *mine[k]))
            k += 1
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity, tokenizer, end_id).withColumn("bucket", F.abs(F.hash("doc_id", "piece", "start")) % RANK_BUCKETS), "pieces")
    counts = cut.groupBy("length", "bucket").count()
    # at most capacity x RANK_BUCKETS rows, whatever the input: a histogram
    histogram: dict[int, int] = {}
    cells = []
    for s, b, c in sorted((r["length"], r["bucket"], r["count"]) for r in counts.collect()):
        cells.append((s, b, histogram.get(s, 0), c))
        histogram[s] = histogram.get(s, 0) + c
    looked_up = spark.createDataFrame(_by_cell(cells, plan(histogram, capacity).runs), "length long, bucket int, before long, low long, high long, first long, per long, head long")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = cut.withColumn("place", F.row_number().over(order)).join(looked_up, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    hit = ranked.filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return hit.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + (step / F.col("per")).cast("long")).alias("sequence_id"),
        (F.col("head") + step % F.col("per") * F.col("length")).alias("offset"),
    )
