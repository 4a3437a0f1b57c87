"""Flow records: CSV scans with cleaning, day tags and timelines; the event adapter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BENIGN
from . import store

# Columns, days and label spellings of the public flow data sets.
LOAD_COLUMNS = ("Timestamp", "Label", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets")
RATE_COLUMNS = ("Flow Bytes/s", "Flow Packets/s")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")
UNSW_NAMES = {"srcip": "src_ip", "sport": "src_port", "dstip": "dst_ip", "dsport": "dst_port", "proto": "protocol", "dur": "Flow Duration", "sbytes": "Total Length of Fwd Packets", "dbytes": "Total Length of Bwd Packets", "spkts": "Total Fwd Packets", "dpkts": "Total Backward Packets", "attack_cat": "attack_category", "stime": "Timestamp"}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def normal_label(c: Column) -> Column:
    """No-break spaces to spaces, trimmed, in upper case."""
    return F.upper(F.trim(F.translate(c, " ", " ")))


def infinite_to_max(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Infinities become the greatest finite value of the column (by file), 0 if there is none.

    The maxima are an aggregate of a row per file, joined back; a global one is a single row.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    tops = [F.coalesce(F.max(F.when(finite(F.col(f"`{c}`")), F.col(f"`{c}`"))), F.lit(0.0)).alias(f"__top_{i}") for i, c in enumerate(columns)]
    top = df.groupBy(*by).agg(*tops)
    joined = df.join(top, list(by)) if by else df.join(F.broadcast(top), F.lit(True))
    for i, c in enumerate(columns):
        joined = joined.withColumn(c, F.when(F.abs(F.col(f"`{c}`")) == float("inf"), F.col(f"__top_{i}")).otherwise(F.col(f"`{c}`")))
    return joined.drop(*[f"__top_{i}" for i in range(len(columns))])


def zero_missing(df: DataFrame) -> DataFrame:
    """Missing numbers and NaN become 0 in every numeric column."""
    return df.na.fill(0.0).na.fill(0)


def day_of(path: Column) -> Column:
    """The first day name in a file name, capitalised; else unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(*[F.when(name.contains(d), F.lit(d.capitalize())) for d in DAYS], F.lit("unknown"))


def parse_time(c: Column, seconds: bool = False) -> Column:
    """Day/month/year with minutes, or with seconds; null for anything else."""
    return F.try_to_timestamp(c, F.lit("d/M/yyyy H:m:s" if seconds else "d/M/yyyy H:m")).cast("timestamp_ntz")


def synthetic_timeline(df: DataFrame, order: Sequence[str], base: str = "2017-07-03") -> DataFrame:
    """A flow a second from midnight on, each day of the table a day later than the one before.

    Days are numbered in order of their first file.
    """
    first = df.groupBy("day").agg(F.min(F.struct(*order)).alias("__first"))
    number = first.withColumn("__block", F.row_number().over(Window.orderBy("__first")) - 1).select("day", "__block")  # a row per day
    place = F.row_number().over(Window.partitionBy("day").orderBy(*order)) - 1
    seconds = F.col("__block").cast("long") * 86_400 + F.col("__place")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(f"{base} 00:00:00")) + seconds).cast("timestamp_ntz")
    return df.join(F.broadcast(number), "day").withColumn("__place", place).withColumn("Timestamp", at).drop("__block", "__place")


def binary_label(c: Column, numeric: bool = False) -> Column:
    """0/1: numeric labels by being non-zero, text by not being benign."""
    if numeric:
        return F.when(c.isNull() | (c == 0), 0).otherwise(1)
    return F.when(F.upper(F.trim(c)) == BENIGN, 0).otherwise(1)


def class_codes(df: DataFrame, label: str = "Label") -> DataFrame:
    """label_code: dense codes of the sorted labels; the window runs over distinct labels only."""
    codes = df.select(label).distinct().withColumn("label_code", F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(F.broadcast(codes), label)


def time_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("hour", F.hour(ts).cast("short")).withColumn("day_of_week", F.weekday(ts).cast("short"))


def coerce(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def files_of(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """CSV files by path, pattern or folder, in order of their names."""
    out: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        out += store.listed(spark, path if path.lower().endswith(".csv") else f"{path.rstrip('/')}/*.csv")
    if not out:
        raise FileNotFoundError(f"no CSV files in {paths}")
    return sorted(dict.fromkeys(out))


def day_name(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return next((d.capitalize() for d in DAYS if d in name), "unknown")


def _clean(raw: DataFrame) -> DataFrame:
    """The known columns of flow CSVs that share a header, cleaned, with day, __file and __pos."""
    names = {c.strip(): c for c in raw.columns}
    wanted = [c for c in LOAD_COLUMNS if c in names] or list(names)
    rates = [c for c in RATE_COLUMNS if c in wanted]
    text = ("Label", "Timestamp")
    chosen = raw.select(*[(F.col(f"`{names[c]}`") if c in text else F.col(f"`{names[c]}`").try_cast("double")).alias(c) for c in wanted], F.col("_metadata.file_path").alias("__file"))
    df = chosen.withColumn("day", day_of(F.col("__file"))).withColumn("__pos", F.monotonically_increasing_id())
    df = zero_missing(infinite_to_max(df, rates, ["__file"]))
    if "Label" in wanted:
        df = df.withColumn("Label", normal_label(F.col("Label")))
    at = F.col("Timestamp") if "Timestamp" in wanted else F.lit(None).cast("string")
    return df.withColumn("__exact", parse_time(at, seconds=True)).withColumn("Timestamp", parse_time(at))


def _cached(spark: SparkSession, file: str, folder: str) -> DataFrame:
    """The cleaned rows of one file, from its Parquet copy if that is no older than the file."""
    copy = f"{folder.rstrip('/')}/{file.rsplit('/', 1)[-1].removesuffix('.csv')}.parquet"
    if not (store.exists(spark, copy) and store.modified(spark, copy) >= store.modified(spark, file)):
        _clean(spark.read.option("header", True).csv(file)).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)


def read_cicids(spark: SparkSession, paths: str | Sequence[str], days: Sequence[str] | None = None, cache_dir: str | None = None) -> DataFrame:
    """Flow CSVs (files, patterns or folders), cleaned, with day and Timestamp.

    Columns are found by name in each file's own header, stray spaces apart; of those known, only
    the ones that some file has are read, null where a file lacks them.  days filters by file name
    (all files if no name has one of them).  With cache_dir each file's cleaned rows are kept there
    as Parquet, whatever the days, and read again while the copy is no older than the file.
    """
    files = files_of(spark, paths)
    files = [f for f in files if not days or day_name(f) in days] or files
    if cache_dir:
        parts = [_cached(spark, f, cache_dir) for f in files]
    else:
        groups: dict[tuple, list[str]] = {}
        for f in files:
            groups.setdefault(tuple(spark.read.option("header", True).csv(f).columns), []).append(f)
        parts = [_clean(spark.read.option("header", True).csv(g)) for g in groups.values()]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    # one format for the whole table: with minutes, else with seconds, else a synthetic timeline
    if not df.filter(F.col("Timestamp").isNotNull()).limit(1).count():
        exact = df.filter(F.col("__exact").isNotNull()).limit(1).count()
        df = df.withColumn("Timestamp", F.col("__exact")) if exact else synthetic_timeline(df, ["__file", "__pos"])
    return df.drop("__file", "__pos", "__exact")


def read_unsw(spark: SparkSession, paths: str | Sequence[str], header: bool | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """UNSW-style CSVs (files, patterns or folders; lists of features apart): lower-case trimmed
    names, renamed; missing numbers 0; integer label.

    header None looks at each file: its first line is a header if it names a known column.
    Headerless files take names, or the default names c0, c1 and so on.
    """
    parts: dict[tuple, list[str]] = {}
    for f in files_of(spark, paths):
        if "feature" in f.rsplit("/", 1)[-1].lower():
            continue
        first = [c.strip().lower() for c in spark.read.option("header", True).csv(f).columns]
        known = set(first) & (set(UNSW_NAMES) | {"label"})
        parts.setdefault((bool(known) if header is None else header, tuple(first) if known else len(first)), []).append(f)
    out = None
    for (named, _), group in parts.items():
        df = spark.read.option("header", named).csv(group)
        fallback = list(names)[: len(df.columns)] if names else [f"c{i}" for i in range(len(df.columns))]
        df = df.toDF(*[c.strip().lower() for c in (df.columns if named else fallback)]).withColumnsRenamed(UNSW_NAMES)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no CSV files of flows in {paths}")
    text = {"src_ip", "dst_ip", "protocol", "state", "service", "attack_category"}
    df = out.select(*[(F.col(f"`{c}`") if c in text else coerce(F.col(f"`{c}`"))).alias(c) for c in out.columns])
    return df.withColumn("label", F.col("label").cast("int")) if "label" in df.columns else df


def load(spark: SparkSession, source: str, path: str | None = None, days: Sequence[str] | None = None, cache_dir: str | None = None, n: int = 5_000, seed: int = 42) -> DataFrame:
    """Flows of a source by its name: sample or cicids.  unsw has no days to train and test on."""
    if source == "sample":
        return sample_flows(spark, n, seed)
    if source == "cicids":
        return read_cicids(spark, path, days, cache_dir)
    raise ValueError(f"{source} can't be evaluated by days; sources are sample and cicids")


def by_day(df: DataFrame) -> dict[str, DataFrame]:
    """A table for each day, in order of first appearance of the day's name; the days are few."""
    if "day" not in df.columns:
        raise ValueError("the table has no day")
    return {r["day"]: df.filter(F.col("day") == r["day"]) for r in df.select("day").distinct().orderBy("day").collect()}


def day_against_rest(df: DataFrame, day: str = "Monday") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("day") == day), df.filter(F.col("day") != day)


def feature_columns(df: DataFrame, candidates: Sequence[str] = LOAD_COLUMNS, exclude: Sequence[str] = ("Label", "label", "label_code", "y", "flow_id", "event_id"), most: int | None = None) -> list[str]:
    """The numeric candidates that the table has; where there are none, all numeric columns but the
    excluded, the first most of them."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return [c for c in candidates if c in numbers] or [c for c in numbers if c not in exclude][:most]


def finite_or_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles, with 0 for what is missing, NaN or infinite."""
    return df.withColumns({c: F.when(finite(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).otherwise(0.0) for c in columns})


def sample_flows(spark: SparkSession, n: int = 5_000, seed: int = 42, extra: int = 71) -> DataFrame:
    """Seeded synthetic flows: one a second, four fifths benign, one burst of seven attack kinds;
    five columns that series are made of and extra ones (f0, f1, ...) that attacks shift."""
    kinds = ("DDOS", "PORTSCAN", "FTP-PATATOR", "SSH-PATATOR", "DOS SLOWLORIS", "BOT", "WEB ATTACK BRUTE FORCE")
    i = F.col("id")
    burst = (i >= int(0.4 * n)) & (i < int(0.6 * n))
    u = lambda k: (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)
    draw = lambda k, mean: -F.log(u(k)) * F.lit(mean) * F.when(burst, 5.0).otherwise(1.0)
    which = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(len(kinds))) + 1).cast("int"))
    return spark.range(n).select(
        i.alias("flow_id"),
        F.timestamp_seconds(F.lit(1499068800) + i).cast("timestamp_ntz").alias("Timestamp"),
        draw(1, 1e6).alias("Flow Duration"), draw(2, 10.0).alias("Total Fwd Packets"), draw(3, 8.0).alias("Total Backward Packets"),
        draw(4, 500.0).alias("Total Length of Fwd Packets"), draw(5, 400.0).alias("Total Length of Bwd Packets"),
        *[draw(10 + k, 1.0 + k).alias(f"f{k}") for k in range(extra)],
        F.when(burst, which).otherwise(F.lit(BENIGN)).alias("Label"), F.lit("Monday").alias("day"),
    )


def write_sample(spark: SparkSession, folder: str, n: int = 5_000, seed: int = 42) -> None:
    """The synthetic flows as CSV with a header, timestamps as day/month/year."""
    rows = sample_flows(spark, n, seed).orderBy("flow_id")
    rows.withColumn("Timestamp", F.date_format("Timestamp", "dd/MM/yyyy HH:mm:ss")).drop("flow_id").coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def as_flows(df: DataFrame) -> DataFrame:
    """The flow view of a flow table: ts, event_id, total_bytes, total_packets, duration, label, day."""
    c = lambda name: F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
    return df.select(
        F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]).alias("event_id"), F.col("Timestamp").alias("ts"),
        (c("Total Length of Fwd Packets") + c("Total Length of Bwd Packets")).alias("total_bytes"),
        (c("Total Fwd Packets") + c("Total Backward Packets")).alias("total_packets"), c("Flow Duration").alias("duration"),
        F.col("Label").alias("label"), "day",
    )


def from_events(events: DataFrame) -> DataFrame:
    """The flow view of an event table: bytes, packets, duration, label, calendar day.

    Durations are user numbers over a prime, so that no mean of them lies half-way between two
    decimals, where the order of additions would decide how it is rounded.
    """
    k = F.get_json_object("props", "$.k").cast("double")
    bad = F.col("event_type").isin("error", "signup") | ((F.col("event_type") == "purchase") & (k < 50))
    return events.select(
        "event_id", "ts", F.col("value").alias("total_bytes"), k.alias("total_packets"), (F.col("user_id").cast("double") / 997).alias("duration"),
        F.when(bad, F.upper("event_type")).otherwise(F.lit(BENIGN)).alias("label"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )

