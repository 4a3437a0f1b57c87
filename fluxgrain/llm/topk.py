"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised, grouped by length into buckets (descending), and each block of queries
walks the buckets of its lane from the longest on.  The k-th best product so far gives, with the
query's and the bucket's greatest length, a local cosine threshold.  Above one the bucket and all
behind it are skipped; a low threshold prunes by length (the bucket's prefix of long enough
vectors); a high one prunes by coordinate (feasible intervals of the query's largest
coordinates).  What is left is verified by exact integer products.

Lanes and blocks bound every task: a bucket meets each block of queries once, in blocks, and a
task keeps only k results for each query of its group.

Defined edge cases: vectors null, empty of components, or holding null or non-finite ones take no
part, nor do rows without a vec_id; shorter vectors count as padded with zeros; a query's
own row is any row of its vec_id; repeated rows are candidates each; ties go to the smaller id.
Products beyond 64 bits saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, prepare

SCALE, K, EVERY = 64.0, 20, 20
#: Vectors of a bucket, queries of a block, queries that a task serves at most.
BUCKET, BLOCK, SERVED = 256, 128, 8192
#: Local cosine thresholds from here on prune by coordinate; coordinates looked at.
COSINE, FOCUS = 0.75, 3
_SAFE = 1 << 26


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, its integer components (floor(SCALE * x)) and their length."""
    x = F.col("x")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), F.transform(vectors["embedding"], lambda v: v.cast("double")).alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    q = F.transform("x", lambda v: F.floor(v * F.lit(SCALE)))
    rows = rows.select("vec_id", q.alias("q"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def _blocks(rows: DataFrame, size: int, hold: str) -> DataFrame:
    """Rows in their order, packed: ids, components and the greatest length; name tells blocks apart."""

    def run(batches):
        ids, vecs, name = [], [], TaskContext.get().partitionId() << 32

        def out():
            nonlocal name
            width = max(map(len, vecs))
            m = np.zeros((len(vecs), width), np.int64)
            for k, v in enumerate(vecs):
                m[k, : len(v)] = v
            norms = np.sqrt((m.astype(float) ** 2).sum(1))
            order = np.argsort(-norms, kind="stable")
            m, norms = m[order], norms[order]
            block = pa.RecordBatch.from_arrays(
                [pa.array([int(np.array(ids)[order][0])]), pa.array([float(norms[0])]), pa.array([width], pa.int32()), pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([name])],
                ["first", "longest", "width", "ids", "data", "name"],
            )
            name += 1
            ids.clear()
            vecs.clear()
            return block

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                vecs.append(v)
                if len(ids) == size:
                    yield out()
        if ids:
            yield out()

    made = rows.mapInArrow(run, "first long, longest double, width int, ids binary, data binary, name long")
    return made.toDF(*[f"{hold}_{c}" for c in made.columns])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: in doubles where these are exact, else in whole numbers."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    big = a.astype(object) @ b.T.astype(object)
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Served:
    """The best k candidates so far of a block's queries."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int) -> None:
        self.ids, self.data, self.k = ids, data, k
        self.norms = np.sqrt((data.astype(float) ** 2).sum(1))
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), -np.inf)

    def _merge(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.ids[q]
        if len(self.scores[q]) >= self.k:
            other &= scores >= self.scores[q][-1]
        if not other.any():
            return
        s, i = np.concatenate([self.scores[q], scores[other]]), np.concatenate([self.found[q], ids[other]])
        best = np.lexsort((i, ~s))[: self.k]
        self.scores[q], self.found[q] = s[best], i[best]
        if len(best) == self.k:
            self.least[q] = s[best[-1]]

    def meet(self, ids: np.ndarray, data: np.ndarray) -> None:
        """Search a bucket, longest vectors first."""
        width = max(self.data.shape[1], data.shape[1])
        mine, theirs = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (self.data, data))
        norms = np.sqrt((theirs.astype(float) ** 2).sum(1))
        bound = self.norms * norms[0]
        alive = np.nonzero(bound * (1 + 1e-9) + 1e-9 >= self.least)[0]
        if not len(alive):
            return
        local = np.where(bound[alive] > 0, self.least[alive] / np.maximum(bound[alive], 1e-300), -1.0)
        by_coordinate = alive[local >= COSINE]
        by_length = alive[local < COSINE]
        if len(by_length):
            need = np.where(self.norms[by_length] > 0, self.least[by_length] / np.maximum(self.norms[by_length], 1e-300), -np.inf)
            reach = np.searchsorted(-norms, -(need * (1 - 1e-9) - 1e-9), side="right")
            got = products(mine[by_length], theirs[: reach.max(initial=0)])
            for row, q, n in zip(got, by_length.tolist(), reach.tolist()):
                self._merge(q, row[:n], ids[:n])
        if len(by_coordinate):
            unit = theirs / np.maximum(norms, 1e-300)[:, None]
            for q, cos in zip(by_coordinate.tolist(), local[local >= COSINE].tolist()):
                u = mine[q] / max(self.norms[q], 1e-300)
                spread = np.arccos(min(cos, 1.0))
                live = np.ones(len(ids), bool)
                for f in np.argsort(-np.abs(u))[:FOCUS]:
                    angle = np.arccos(np.clip(u[f], -1, 1))
                    low, high = np.cos(min(np.pi, angle + spread)), np.cos(max(0.0, angle - spread))
                    live &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
                if live.any():
                    self._merge(q, products(mine[q : q + 1], theirs[live])[0], ids[live])


def _search(k: int):
    def run(batches):
        from fluxgrain.llm import topk

        served: dict[tuple[int, int], topk.Served] = {}  # by group and block: repeated rows may lead several blocks
        for batch in batches:
            for group, name, qw, qi, qd, cw, ci, cd in zip(*(c.to_pylist() for c in batch.columns)):
                key = (group, name)
                if key not in served:
                    served[key] = topk.Served(np.frombuffer(qi, np.int64), np.frombuffer(qd, np.int64).reshape(-1, qw), k)
                served[key].meet(np.frombuffer(ci, np.int64), np.frombuffer(cd, np.int64).reshape(-1, cw))
        for s in served.values():
            n = [len(x) for x in s.scores]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, n)), pa.array(np.concatenate(s.found)), pa.array(np.concatenate(s.scores))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row with vec_id % every = 0."""
    spark = prepare(vectors.sparkSession)
    ready = quantised(vectors)
    lanes = partitions(spark)
    queries = ready.filter(F.col("vec_id") % every == 0)
    groups = max(1, -(-queries.count() // SERVED))
    blocks = _blocks(queries.select("vec_id", "q"), BLOCK, "q").withColumn("group", F.pmod(F.hash("q_first", "q_ids"), F.lit(groups)))
    ordered = ready.repartitionByRange(lanes, F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), F.col("vec_id"))
    buckets = _blocks(ordered.select("vec_id", "q"), BUCKET, "c").withColumn("lane", F.pmod(F.hash("c_first", "c_ids"), F.lit(lanes)))
    buckets = buckets.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("short", -F.col("c_longest"))
    buckets = buckets.repartition(lanes * groups, "lane", "group").sortWithinPartitions("lane", "group", "short")
    blocks = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(lanes * groups, "lane", "group").sortWithinPartitions("lane", "group")
    met = buckets.join(blocks.hint("merge"), ["lane", "group"]).select("group", "q_name", "q_width", "q_ids", "q_data", "c_width", "c_ids", "c_data")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
