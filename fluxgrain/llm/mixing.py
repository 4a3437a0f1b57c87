"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of all characters over its own.  A document's
number of copies inverts the Poisson distribution of that mean at a uniform variable hashed
from a seed and its id: reproducible, independent of partitioning, right in expectation.  The
copies are then dealt out and ordered by a hash, a shuffle over the whole corpus.

Defined edge cases: a null source is a source of its own; text null counts as empty; rows of the
same doc_id get equally many copies; sources without a stated weight get the default one; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Production weights: twenty sources of four ranks; others count as rank one.
WEIGHTS = {f"src{i}": float(1 + i % 4) for i in range(20)}
DEFAULT_WEIGHT, SEED = 1.0, 17
#: Means above this are split into equal parts, as e^-mean would underflow.
PART = 500.0
#: Rate tables up to this many sources are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _uniform(*parts):
    """Uniform in [0, 1): 52 bits of an MD5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float) -> DataFrame:
    """mix_source, parts and the cumulative Poisson distribution of a part's mean."""
    spark = docs.sparkSession
    size = docs.groupBy(F.col("source").cast("string").alias("mix_source")).agg(F.sum(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long") + 1).alias("size"))
    stated = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, stated double")
    size = size.join(F.broadcast(stated), F.col("mix_source") == F.col("name"), "left").withColumn("weight", F.coalesce("stated", F.lit(default_weight)))
    total = size.agg(F.sum("size"), F.sum("weight")).first()
    mean = F.col("weight") / F.lit(total[1] or 1.0) * F.lit(float(total[0] or 0)) / F.col("size")
    table = size.withColumn("rate", mean).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("mean", F.col("rate") / F.col("parts"))
    top = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda s, k: F.struct((s["p"] * F.col("mean") / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("mean") / k)).alias("cdf")),
        lambda s: s["cdf"],
    )
    return table.select("mix_source", "rate", "parts", steps.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, seed: int = SEED) -> DataFrame:
    """docs' own columns, repeated, with mix_copy (from 0), mix_copies and mix_key appended."""
    own = F.struct(*[docs[c] for c in docs.columns]) if docs.columns else F.struct(F.lit(1))
    rows = docs.select(own.alias("row"), docs["source"].cast("string").alias("of"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).alias("ident"))
    table = rates(docs, weights, default_weight)
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    single = F.size(F.filter("cdf", lambda c: F.col("u") >= c))
    joined = rows.join(table, F.col("of").eqNullSafe(F.col("mix_source"))).withColumn("u", _uniform(F.lit(str(seed)), F.col("ident")))
    many = F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.col("parts"), F.lit(2))),
        single,
        lambda n, j: n + F.when(j <= F.col("parts"), F.size(F.filter("cdf", lambda c: _uniform(F.lit(str(seed)), F.col("ident"), j.cast("string")) >= c))).otherwise(0),
    )
    joined = joined.withColumn("mix_copies", F.when(F.col("parts") == 1, single).otherwise(many)).filter("mix_copies > 0")
    copies = joined.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}s"), "ident", F.col("mix_copy").cast("string"))), 1, 15), 16, 10).cast("long")
    dealt = copies.withColumn("mix_key", key).select("row", "mix_copy", "mix_copies", "mix_key")
    n = partitions(docs.sparkSession)
    return dealt.repartition(n, "mix_key").sortWithinPartitions("mix_key").select("row.*", "mix_copy", "mix_copies", "mix_key")
