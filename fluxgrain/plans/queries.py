"""Queries over the driver's tables, one or more for each operator, with the SQL that checks them.

Flows come from ``events`` (see sources.flows.from_events): hourly bins, windows of 8 bins that
overlap by 4, slow windows of 32.  Values that sum floating-point numbers are rounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Spectral
from ..functions.spectral import descriptor_names
from ..operators import detectors, ensemble, labels, metrics, ranks, scaling, spectral, splits, timeseries
from ..sources import flows as src
from ..sources.scratch import keep
from . import pipeline

HOUR, W, HOP, SLOW = 3600, 8, 4, 32
CFG = Spectral(bin_seconds=HOUR, window=W, overlap=W - HOP, slow_window=SLOW, slow_overlap=0)
CH = list(CFG.channels)
ALL = ["flow_count", *CH]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _flows(spark, sf):
    return src.from_events(_t(spark, sf, "events"))


def _series(spark, sf):
    return timeseries.flow_series(_flows(spark, sf), "ts", HOUR)


def _log_series(spark, sf):
    return timeseries.log_channels(_series(spark, sf), CFG.log_channels)


def _win(spark, sf):
    return timeseries.windows(_log_series(spark, sf), W, HOP, ALL)


def _r(c: str, digits: int = 6):
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


def _rs(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0 AS {c}"


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
FLOWS = f"""flows AS (SELECT event_id, ts, value AS total_bytes, {K} AS total_packets, CAST(user_id AS DOUBLE) / 997 AS duration,
  CASE WHEN event_type IN ('error', 'signup') OR (event_type = 'purchase' AND {K} < 50) THEN upper(event_type) ELSE 'BENIGN' END AS label,
  strftime(ts, '%Y-%m-%d') AS day FROM events)"""


def _bins_sql(seconds: int = HOUR) -> str:
    return f"""{FLOWS},
o AS (SELECT epoch_us(date_trunc('day', min(ts))) AS origin FROM flows),
b AS (SELECT (epoch_us(ts) - (SELECT origin FROM o)) // {seconds}000000 AS bin, count(*)::DOUBLE AS flow_count, sum(total_bytes) AS total_bytes,
  sum(total_packets) AS total_packets, avg(duration) AS mean_duration FROM flows WHERE ts IS NOT NULL GROUP BY 1),
g AS (SELECT min(bin) AS lo, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b),
bins AS (SELECT g.bin - lo AS bin_idx, coalesce(flow_count, 0.0) AS flow_count, coalesce(total_bytes, 0.0) AS total_bytes,
  coalesce(total_packets, 0.0) AS total_packets, coalesce(mean_duration, 0.0) AS mean_duration FROM g LEFT JOIN b ON g.bin = b.bin)"""


BINS = _bins_sql()
LOGS = BINS + ",\nlogs AS (SELECT bin_idx, flow_count, ln(1 + greatest(total_bytes, 0)) AS total_bytes, ln(1 + greatest(total_packets, 0)) AS total_packets, mean_duration FROM bins)"


def _win_sql(source: str, size: int = W, hop: int = HOP, name: str = "win") -> str:
    return f"""{name}_t AS (SELECT max(bin_idx) + 1 AS n FROM {source}),
{name}_w AS (SELECT unnest(range(0, (n - {size}) // {hop} + 1)) AS win FROM {name}_t WHERE n >= {size}),
{name} AS (SELECT win, s.bin_idx - win * {hop} AS j, s.* FROM {name}_w JOIN {source} s ON s.bin_idx BETWEEN win * {hop} AND win * {hop} + {size - 1})"""


WIN = LOGS + ",\n" + _win_sql("logs")


def _psd_sql(size: int = W, win: str = "win", name: str = "psd") -> str:
    ks = size // 2 + 1
    parts = " UNION ALL ".join(f"SELECT win, j, '{c}' AS channel, {c} AS x FROM {win}" for c in CH)
    return f"""{name}_l AS ({parts}),
{name}_k AS (SELECT unnest(range(0, {ks})) AS k),
{name} AS (SELECT win, channel, k, (pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {size})) * cos(2 * pi() * ((j * k) % {size}) / {size})), 2)
  + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {size})) * sin(2 * pi() * ((j * k) % {size}) / {size})), 2)) / {size} * CASE WHEN k > 0 AND k < {ks - 1} THEN 2 ELSE 1 END AS p
  FROM {name}_l, {name}_k GROUP BY win, channel, k)"""


def _desc_sql(size: int, fs: float, psd: str = "psd", name: str = "d") -> str:
    ks = size // 2 + 1
    cuts = [int(round(i * ks / 3)) for i in range(4)]
    f = f"(k * {fs!r} / {size})"
    bands = ", ".join(f"coalesce(sum(p) FILTER (k >= {a} AND k < {b}), 0) / any_value(total) AS energy_band_{i}" for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return f"""{name}_t AS (SELECT win, channel, sum(p) AS total, sum(p * {f}) / sum(p) AS centre FROM {psd} GROUP BY win, channel),
{name}_c AS (SELECT p.*, total, centre, sum(p) OVER (PARTITION BY p.win, p.channel ORDER BY k) AS run FROM {psd} p JOIN {name}_t t ON p.win = t.win AND p.channel = t.channel),
{name}_m AS (SELECT win, channel, avg(x) AS dc_component FROM {psd}_l GROUP BY win, channel),
{name}_r AS (SELECT win, channel, sum(-greatest(p / total, 1e-10) * ln(greatest(p / total, 1e-10))) AS entropy, any_value(centre) AS centroid,
  exp(avg(ln(greatest(p, 1e-10)))) / avg(greatest(p, 1e-10)) AS flatness, sqrt(sum(p * pow({f} - centre, 2)) / any_value(total)) AS bandwidth,
  arg_max({f}, struct_pack(a := round(p, 9), b := -k)) FILTER (k >= 1) AS dominant_frequency, max(p) FILTER (k >= 1) AS dominant_amplitude, any_value(total) AS total_power,
  coalesce(min({f}) FILTER (run / total >= 0.85), {ks - 1} * {fs!r} / {size}) AS rolloff_85, coalesce(min({f}) FILTER (run / total >= 0.95), {ks - 1} * {fs!r} / {size}) AS rolloff_95, {bands}
  FROM {name}_c GROUP BY win, channel),
{name} AS (SELECT r.*, dc_component FROM {name}_r r JOIN {name}_m m ON r.win = m.win AND r.channel = m.channel)"""


FS = 1.0 / HOUR
PSD = WIN + ",\n" + _psd_sql()
DESC = PSD + ",\n" + _desc_sql(W, FS)
NAMES = descriptor_names(CFG.rolloff)
#: Frequencies of hourly bins are small numbers: they are compared in 1e-12.
DIGITS = {n: 12 if n in ("centroid", "bandwidth", "dominant_frequency", "rolloff_85", "rolloff_95") else 6 for n in NAMES}


# cleaning and projections


@query("SELECT event_id, upper(trim(replace(x, chr(160), ' '))) AS label, CASE WHEN upper(trim(replace(x, chr(160), ' '))) = 'BENIGN' THEN 0 ELSE 1 END AS y FROM (SELECT event_id, concat(' ', CASE WHEN event_type = 'view' THEN 'Benign' ELSE event_type END, chr(160), 'x') AS x0, CASE WHEN event_type = 'view' THEN ' Benign ' ELSE concat(event_type, chr(160), 'x ') END AS x FROM events)")
def clean_labels(spark, sf):
    e = _t(spark, sf, "events")
    x = F.when(F.col("event_type") == "view", F.lit(" Benign ")).otherwise(F.concat("event_type", F.lit(" x ")))
    return e.select("event_id", src.normal_label(x).alias("label")).withColumn("y", src.binary_label(F.col("label")))


@query("""WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 97 = 0 THEN 'inf'::DOUBLE WHEN event_id % 89 = 0 THEN NULL ELSE value END AS value FROM events),
m AS (SELECT event_type, coalesce(max(value) FILTER (isfinite(value)), 0.0) AS top FROM x GROUP BY event_type)
SELECT event_id, coalesce(CASE WHEN isinf(value) THEN top ELSE value END, 0.0) AS value FROM x JOIN m ON x.event_type = m.event_type""")
def clean_infinite(spark, sf):
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).when(F.col("event_id") % 89 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    x = _t(spark, sf, "events").select("event_id", "event_type", v.alias("value"))
    return src.zero_missing(src.infinite_to_max(x, ["value"], ["event_type"])).select("event_id", "value")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE epoch_us(date_trunc('minute', ts)) END AS micros FROM events")
def clean_timestamps(spark, sf):
    text = F.when(F.col("event_id") % 10 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "d/M/yyyy H:m"))
    return _t(spark, sf, "events").select("event_id", F.coalesce(F.unix_micros(src.parse_time(text).cast("timestamp")), F.lit(-1)).cast("long").alias("micros"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Friday' WHEN 2 THEN 'Wednesday' ELSE 'unknown' END AS day FROM events")
def clean_day_tag(spark, sf):
    name = F.element_at(F.array(*[F.lit(f"/data/monday/{n}.csv") for n in ("Monday-Hours", "x-FRIDAY-2", "wednesday", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, sf, "events").select("event_id", src.day_of(name).alias("day"))


@query(f"""WITH {FLOWS}, d AS (SELECT day, row_number() OVER (ORDER BY min(event_id)) - 1 AS block FROM flows GROUP BY day)
SELECT event_id, epoch_us(TIMESTAMP '2017-07-03') + 1000000 * (block * 86400 + row_number() OVER (PARTITION BY flows.day ORDER BY event_id) - 1) AS made FROM flows JOIN d ON flows.day = d.day""")
def clean_synthetic_timeline(spark, sf):
    return src.synthetic_timeline(_flows(spark, sf), ["event_id"]).select("event_id", F.unix_micros(F.col("Timestamp").cast("timestamp")).alias("made"))


@query("SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type)::INTEGER - 1 AS label_code FROM events")
def label_codes(spark, sf):
    return src.class_codes(_t(spark, sf, "events"), "event_type").select("event_id", "event_type", "label_code")


@query(f"WITH {FLOWS} SELECT label, count(*) AS n FROM flows GROUP BY label ORDER BY n DESC, label")
def label_counts(spark, sf):
    return _flows(spark, sf).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("SELECT event_id, hour(ts)::SMALLINT AS hour, (isodow(ts) - 1)::SMALLINT AS day_of_week FROM events")
def clean_time_features(spark, sf):
    return src.time_features(_t(spark, sf, "events"), "ts").select("event_id", "hour", "day_of_week")


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE value::VARCHAR END AS DOUBLE), 0.0) AS value FROM events")
def clean_coerce(spark, sf):
    x = F.when(F.col("event_id") % 7 == 0, F.lit("bad")).otherwise(F.col("value").cast("string"))
    return _t(spark, sf, "events").select("event_id", src.coerce(x).alias("value"))


@query(f"WITH {FLOWS} SELECT event_id, label FROM flows WHERE upper(label) NOT IN ('ERROR', 'SIGNUP')")
def filter_attack_labels(spark, sf):
    return labels.without_labels(_flows(spark, sf), ["error", "Signup"]).select("event_id", "label")


@query(f"WITH {FLOWS} SELECT avg((total_packets IS NULL)::INTEGER) AS packets, avg((label = 'BENIGN')::INTEGER) AS benign FROM flows")
def missing_share(spark, sf):
    return _flows(spark, sf).agg(F.avg(F.col("total_packets").isNull().cast("int")).alias("packets"), F.avg((F.col("label") == "BENIGN").cast("int")).alias("benign"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_type <> 'view'")
def union_by_name(spark, sf):
    e = _t(spark, sf, "events")
    a, b = e.filter("event_type = 'view'").select("event_id", "event_type", "value"), e.filter("event_type <> 'view'").select("event_type", "event_id")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT event_id, value FROM events ORDER BY ts NULLS LAST, event_id LIMIT 100")
def sort_time_head(spark, sf):
    return _t(spark, sf, "events").orderBy(F.col("ts").asc_nulls_last(), "event_id").limit(100).select("event_id", "value")


# series and windows


@query(f"WITH {BINS} SELECT bin_idx, flow_count, {_rs('total_bytes')}, {_rs('total_packets')}, {_rs('mean_duration', 10)} FROM bins")
def bin_series(spark, sf):
    return _series(spark, sf).select("bin_idx", "flow_count", _r("total_bytes"), _r("total_packets"), _r("mean_duration", 10))


@query(f"WITH {_bins_sql(25_000)} SELECT bin_idx, flow_count, {_rs('total_bytes')} FROM bins")
def bin_series_odd_width(spark, sf):
    return timeseries.flow_series(_flows(spark, sf), "ts", 25_000).select("bin_idx", "flow_count", _r("total_bytes"))


@query("""WITH b AS (SELECT (epoch_us(l_shipdate) - epoch_us((SELECT date_trunc('day', min(l_shipdate)) FROM lineitem))) // 86400000000 AS bin, sum(l_quantity)::DOUBLE AS l_quantity, count(*)::DOUBLE AS flow_count FROM lineitem GROUP BY 1),
g AS (SELECT min(bin) AS lo, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b)
SELECT g.bin - lo AS bin_idx, round(coalesce(l_quantity, 0.0), 6) AS l_quantity, coalesce(flow_count, 0.0) AS flow_count FROM g LEFT JOIN b ON g.bin = b.bin""")
def bin_sums(spark, sf):
    return timeseries.sum_series(_t(spark, sf, "lineitem"), "l_shipdate", 86_400, ["l_quantity"]).select("bin_idx", F.round("l_quantity", 6).alias("l_quantity"), "flow_count")


@query(f"WITH {LOGS} SELECT bin_idx, {_rs('total_bytes')}, {_rs('total_packets')} FROM logs")
def log_transform(spark, sf):
    return _log_series(spark, sf).select("bin_idx", _r("total_bytes"), _r("total_packets"))


LABELS = f"""{BINS},
lb AS (SELECT (epoch_us(ts) - (SELECT origin FROM o)) // {HOUR}000000 AS bin, sum((label <> 'BENIGN')::INTEGER)::DOUBLE AS attack_count FROM flows WHERE ts IS NOT NULL GROUP BY 1),
lk AS (SELECT (epoch_us(ts) - (SELECT origin FROM o)) // {HOUR}000000 AS bin, label, count(*) AS n, min((ts, event_id)) AS first FROM flows WHERE label <> 'BENIGN' GROUP BY 1, 2),
ld AS (SELECT bin, label FROM lk QUALIFY row_number() OVER (PARTITION BY bin ORDER BY n DESC, first) = 1),
binlab AS (SELECT g.bin - lo AS bin_idx, coalesce(attack_count, 0.0) AS attack_count, coalesce(flow_count, 0.0) AS flow_count, coalesce(label, 'BENIGN') AS dominant_attack,
  coalesce(attack_count / flow_count, 0.0) AS attack_fraction FROM g LEFT JOIN b ON g.bin = b.bin LEFT JOIN lb ON g.bin = lb.bin LEFT JOIN ld ON g.bin = ld.bin)"""


@query(f"WITH {LABELS} SELECT bin_idx, attack_count, flow_count, dominant_attack, {_rs('attack_fraction')} FROM binlab")
def bin_labels(spark, sf):
    return labels.bin_labels(_flows(spark, sf), "ts", HOUR).select("bin_idx", "attack_count", "flow_count", "dominant_attack", _r("attack_fraction"))


def _wlab_sql(rule: str) -> str:
    hit = "max(attack_count) > 0" if rule == "any" else "avg(attack_fraction) >= 0.499999999"
    return f"""{LABELS},
{_win_sql('binlab', name='lw')},
wy AS (SELECT win, ({hit})::INTEGER AS y FROM lw GROUP BY win),
wm AS (SELECT win, dominant_attack, count(*) AS n FROM lw WHERE attack_count > 0 AND dominant_attack <> 'BENIGN' GROUP BY 1, 2),
wd AS (SELECT win, dominant_attack FROM wm QUALIFY row_number() OVER (PARTITION BY win ORDER BY n DESC, dominant_attack) = 1),
wl AS (SELECT wy.win, y, CASE WHEN y = 1 THEN coalesce(dominant_attack, 'ATTACK') ELSE 'BENIGN' END AS label FROM wy LEFT JOIN wd ON wy.win = wd.win)"""


def _wlab(spark, sf, rule="majority"):
    return labels.window_labels(labels.bin_labels(_flows(spark, sf), "ts", HOUR), W, HOP, rule)


for _rule in ("any", "majority"):
    query(f"WITH {_wlab_sql(_rule)} SELECT win, y, label FROM wl", f"window_labels_{_rule}")(lambda spark, sf, rule=_rule: _wlab(spark, sf, rule).select("win", "y", "label"))


@query(f"WITH {WIN} SELECT win, count(*) AS bins, min(bin_idx) AS first_bin, round(sum(flow_count), 6) AS flows FROM win GROUP BY win")
def win_hopping(spark, sf):
    s = _log_series(spark, sf).withColumn("at", F.col("bin_idx"))
    return timeseries.windows(s, W, HOP, ["at", "flow_count"]).groupBy("win").agg(F.count("*").alias("bins"), F.min("at").alias("first_bin"), F.round(F.sum("flow_count"), 6).alias("flows"))


@query(f"WITH {LOGS}, {_win_sql('logs', 10, 10)} SELECT win, round(sum(flow_count), 6) AS flows FROM win GROUP BY win")
def win_tumbling(spark, sf):
    return timeseries.tumbling(_log_series(spark, sf), 10, ["flow_count"]).groupBy("win").agg(F.round(F.sum("flow_count"), 6).alias("flows"))


_DELTA = ", ".join(f"avg(d_{c}) AS {c}__delta_mean, stddev_pop(d_{c}) AS {c}__delta_std" for c in CH)
DELTAS = "dl AS (SELECT win, " + ", ".join(f"{c} - lag({c}) OVER (PARTITION BY win ORDER BY j) AS d_{c}" for c in CH) + f" FROM win), delta AS (SELECT win, {_DELTA} FROM dl GROUP BY win)"
DELTA_NAMES = [f"{c}__{d}" for c in CH for d in ("delta_mean", "delta_std")]


@query(f"WITH {WIN}, {DELTAS} SELECT win, {', '.join(_rs(c) for c in DELTA_NAMES)} FROM delta")
def win_deltas(spark, sf):
    return timeseries.deltas(_win(spark, sf), CH, W).select("win", *[_r(c) for c in DELTA_NAMES])


@query(f"WITH {BINS} SELECT bin_idx, flow_count - lag(flow_count) OVER (ORDER BY bin_idx) AS difference FROM bins")
def first_difference(spark, sf):
    return timeseries.first_differences(_series(spark, sf), "flow_count").select("bin_idx", "difference")


@query(f"WITH {LABELS}, i AS (SELECT bin_idx, bin_idx - row_number() OVER (ORDER BY bin_idx) AS island FROM binlab WHERE attack_count > 2) SELECT min(bin_idx) AS first_bin, max(bin_idx) AS last_bin, count(*) AS bins FROM i GROUP BY island")
def attack_timeline(spark, sf):
    b = labels.bin_labels(_flows(spark, sf), "ts", HOUR).withColumn("attack_count", F.col("attack_count") - 2)
    return labels.attack_runs(b).select("first_bin", "last_bin", "bins")


# spectra

_PSD_SQL = f"WITH {PSD} SELECT win, channel, k, round(p, 6) + 0.0 AS p FROM psd"


def _psd_rows(made):
    return made.select("win", "channel", F.posexplode("psd").alias("k", "p")).select("win", "channel", F.col("k").cast("long").alias("k"), _r("p"))


@query(_PSD_SQL)
def psd_catalyst(spark, sf):
    return _psd_rows(spectral.psd(_win(spark, sf), CH, W))


@query(_PSD_SQL)
def psd_arrow(spark, sf):
    return _psd_rows(spectral.psd_arrow(_win(spark, sf), CH, W))


def _described(spark, sf):
    return spectral.describe(spectral.psd(_win(spark, sf), CH, W), W, FS)


for _n in NAMES:
    query(f"WITH {DESC} SELECT win, channel, {_rs(_n, DIGITS[_n])} FROM d", f"desc_{_n}")(lambda spark, sf, n=_n: _described(spark, sf).select("win", "channel", _r(n, DIGITS[n])))


@query(f"WITH {DESC} SELECT win, channel, {', '.join(_rs(n, DIGITS[n]) for n in NAMES)} FROM d")
def spectral_descriptors(spark, sf):
    return _described(spark, sf).select("win", "channel", *[_r(n, DIGITS[n]) for n in NAMES])


_WIDE = ", ".join(f"max(round({n}, {DIGITS[n]}) + 0.0) FILTER (channel = '{c}') AS {c}__{n}" for c in CH for n in NAMES)
_WIDE_NAMES = [f"{c}__{n}" for c in CH for n in NAMES]


def _digits(c: str) -> int:
    return DIGITS.get(c.rsplit("__", 1)[-1], 6)


@query(f"WITH {DESC}, {DELTAS}, wide AS (SELECT win, {_WIDE} FROM d GROUP BY win) SELECT wide.*, {', '.join(_rs(c) for c in DELTA_NAMES)} FROM wide JOIN delta ON wide.win = delta.win")
def feature_matrix(spark, sf):
    made = spectral.feature_matrix(_log_series(spark, sf), CFG)
    return made.select("win", *[_r(c, _digits(c)) for c in _WIDE_NAMES + DELTA_NAMES])


_MS = ("entropy", "total_power", "flatness")
_MULTI = f"""WITH {DESC},
{_win_sql('logs', SLOW, SLOW, 'swin')},
{_psd_sql(SLOW, 'swin', 'spsd')},
{_desc_sql(SLOW, FS, 'spsd', 'sd')},
n AS (SELECT max(win) + 1 AS slow FROM sd)
SELECT f.win, {', '.join(f"round(max(f.{m}) FILTER (f.channel = '{c}'), 6) + 0.0 AS fast__{c}__{m}, round(max(s.{m}) FILTER (s.channel = '{c}'), 6) + 0.0 AS slow__{c}__{m}" for c in CH for m in _MS)}
FROM d f JOIN n ON true JOIN sd s ON s.win = least(f.win * {HOP} // {SLOW}, n.slow - 1) AND s.channel = f.channel GROUP BY f.win"""


@query(_MULTI)
def multiscale_asof(spark, sf):
    made = spectral.multiscale_matrix(_log_series(spark, sf), CFG)
    return made.select("win", *[_r(f"{p}__{c}__{m}") for c in CH for m in _MS for p in ("fast", "slow")])


# joins of flows with windows

_POOL = f"""WITH {FLOWS}, s AS (SELECT win AS id, date_trunc('day', (SELECT min(ts) FROM flows)) + INTERVAL 1 SECOND * (win * 50000 + 77) AS start FROM (SELECT unnest(range(0, 1 + (epoch_us(max(ts)) - epoch_us(date_trunc('day', min(ts)))) // 50000000000)) AS win FROM flows))
SELECT id, coalesce(max(total_bytes), 0.0) AS pooled_max, round(coalesce(avg(total_bytes), 0.0), 6) AS pooled_mean, count(total_bytes) AS n FROM s LEFT JOIN flows f ON f.ts >= s.start AND f.ts {{op}} s.start + INTERVAL 90000 SECOND GROUP BY id"""


def _pool(spark, sf, inclusive):
    f = _flows(spark, sf)
    span = f.agg(F.date_trunc("day", F.min("ts").cast("timestamp")).alias("first"), F.max("ts").cast("timestamp").alias("last"))
    ids = F.sequence(F.lit(0).cast("long"), F.floor((F.unix_micros("last") - F.unix_micros("first")) / 50_000_000_000).cast("long"))
    starts = span.select("first", F.explode(ids).alias("id")).select("id", F.timestamp_micros(F.unix_micros("first") + (F.col("id") * 50_000 + 77) * 1_000_000).cast("timestamp_ntz").alias("start"))
    return timeseries.pool_interval(f, starts, "ts", "total_bytes", 90_000, inclusive).select("id", "pooled_max", _r("pooled_mean"), "n")


@query(_POOL.replace("{op}", "<"))
def flow_window_pool(spark, sf):
    return _pool(spark, sf, False)


@query(_POOL.replace("{op}", "<="))
def raw_window_features(spark, sf):
    return _pool(spark, sf, True)


# splits, scaling, detectors: windows with three plain features

FEATS = ["f_count", "f_bytes", "f_packets"]
WF = f"""{_wlab_sql('majority')},
logs AS (SELECT bin_idx, flow_count, ln(1 + greatest(total_bytes, 0)) AS total_bytes, ln(1 + greatest(total_packets, 0)) AS total_packets, mean_duration FROM bins),
{_win_sql('logs')},
wf AS (SELECT w.win, round(avg(flow_count), 6) AS f_count, round(avg(total_bytes), 6) AS f_bytes, round(avg(total_packets), 6) AS f_packets, any_value(y) AS y, any_value(label) AS label FROM win w JOIN wl ON w.win = wl.win GROUP BY w.win)"""


def _wf(spark, sf):
    f = _win(spark, sf).groupBy("series", "win").agg(*[F.round(F.avg(c), 6).alias(n) for n, c in zip(FEATS, ALL)])
    return keep(f.join(_wlab(spark, sf), ["series", "win"]), "wf")  # used several times by most queries


SPLIT = f"""{WF},
tr AS (SELECT *, row_number() OVER (ORDER BY win) - 1 AS place, count(*) OVER () AS many FROM wf WHERE y = 0 AND win % 3 <> 2),
ev AS (SELECT *, row_number() OVER (ORDER BY (win * 7919 + 13) % 10007, win) - 1 AS place, count(*) OVER () AS many FROM wf WHERE win % 3 = 2),
split AS (SELECT win, y, label, CASE WHEN place < many - greatest(2, floor(many * 0.3)) THEN 'train' WHEN place - (many - greatest(2, floor(many * 0.3))) < greatest(1, floor(greatest(2, floor(many * 0.3)) / 2)) THEN 'val' ELSE 'test' END AS split FROM tr
  UNION ALL SELECT win, y, label, CASE WHEN place < greatest(1, many // 2) THEN 'val' ELSE 'test' END FROM ev)"""


def _split(spark, sf):
    m = _wlab(spark, sf)
    return splits.day_split(m.filter("win % 3 <> 2"), m.filter("win % 3 = 2"))


@query(f"WITH {SPLIT} SELECT win, y, label, split FROM split")
def split_days(spark, sf):
    return _split(spark, sf).select("win", "y", "label", "split")


@query(f"WITH {SPLIT} SELECT split, count(*) AS windows, sum(y)::BIGINT AS attacks, round(avg(y), 6) AS attack_share FROM split GROUP BY split")
def split_summary(spark, sf):
    return splits.summary(_split(spark, sf)).select("split", "windows", "attacks", _r("attack_share"))


_QUANT = " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS place, quantile_cont({f}, 0.5) AS center, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS iqr FROM wf WHERE y = 0" for i, f in enumerate(FEATS))


@query(f"WITH {WF}, q AS ({_QUANT}) SELECT feature, place, round(center, 9) AS center, round(CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 9) AS scale FROM q")
def scale_fit(spark, sf):
    return scaling.fit_scaler(_wf(spark, sf).filter("y = 0"), FEATS).select("feature", "place", _r("center", 9), _r("scale", 9))


@query(f"WITH {WF}, q AS ({_QUANT}) SELECT win, " + ", ".join(f"round(({f} - (SELECT center FROM q WHERE feature = '{f}')) / (SELECT CASE WHEN iqr = 0 THEN 1 ELSE iqr END FROM q WHERE feature = '{f}'), 6) + 0.0 AS {f}" for f in FEATS) + " FROM wf")
def scale_apply(spark, sf):
    w = _wf(spark, sf)
    return scaling.scale(w, scaling.fit_scaler(w.filter("y = 0"), FEATS), FEATS).select("win", *[_r(f) for f in FEATS])


def _tail_sql(source: str, ids: str, feats: list[str], kind: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {ids}, '{f}' AS feature, {f} AS x FROM {source}" for f in feats)
    each = "greatest(l, r, s)" if kind == "ecod" else "greatest(s, (l + r) / 2)"
    return f"""tl AS ({parts}),
tk AS (SELECT feature, CASE WHEN max(x) = min(x) THEN 0 ELSE sign(skewness(x)) END AS sg FROM tl GROUP BY feature),
tp AS (SELECT {ids}, feature, -ln(cume_dist() OVER (PARTITION BY feature ORDER BY x)) AS l, -ln(cume_dist() OVER (PARTITION BY feature ORDER BY x DESC)) AS r FROM tl),
ts_ AS (SELECT tp.*, CASE WHEN sg < 0 THEN l WHEN sg > 0 THEN r ELSE l + r END AS s FROM tp JOIN tk ON tp.feature = tk.feature),
raw AS (SELECT {ids}, sum({each}) AS raw FROM ts_ GROUP BY {ids})"""


for _kind in ("ecod", "copod"):
    query(f"WITH {WF}, {_tail_sql('wf', 'win', FEATS, _kind)} SELECT win, {_rs('raw')} FROM raw", f"{_kind}_windows")(lambda spark, sf, kind=_kind: detectors.tail_scores(_wf(spark, sf), ["series", "win"], FEATS, kind).select("win", _r("raw")))

FF = ["total_bytes", "total_packets", "duration"]


@query(f"WITH {FLOWS}, {_tail_sql('flows', 'event_id', FF, 'ecod')}, m AS (SELECT min(raw) AS lo, max(raw) AS hi FROM raw) SELECT event_id, round((raw - lo) / (hi - lo), 6) + 0.0 AS score FROM raw, m")
def flow_ecod(spark, sf):
    raw = detectors.tail_scores(_flows(spark, sf), ["event_id"], FF)
    span = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return raw.crossJoin(F.broadcast(span)).select("event_id", scaling.normalised(F.col("raw"), F.col("lo"), F.col("hi")).alias("score")).select("event_id", _r("score"))


_IND = " UNION ALL ".join(f"SELECT win, y, '{f}' AS feature, {f} AS x FROM wf" for f in FEATS)
IND = f"""il AS ({_IND}), it AS (SELECT feature, x FROM il WHERE y = 0),
ik AS (SELECT feature, sign(skewness(x)) AS sg, count(*) AS n FROM it GROUP BY feature),
ip AS (SELECT win, y, il.feature, sg, -ln((1 + (SELECT count(*) FROM it WHERE it.feature = il.feature AND it.x <= il.x)) / (n + 1.0::DOUBLE)) AS l, -ln((1 + (SELECT count(*) FROM it WHERE it.feature = il.feature AND it.x >= il.x)) / (n + 1.0::DOUBLE)) AS r FROM il JOIN ik ON il.feature = ik.feature),
raw AS (SELECT win, any_value(y) AS y, sum(greatest(l, r, CASE WHEN sg < 0 THEN l WHEN sg > 0 THEN r ELSE l + r END)) AS raw FROM ip GROUP BY win)"""


@query(f"WITH {WF}, {IND} SELECT win, {_rs('raw')} FROM raw")
def ecod_inductive(spark, sf):
    w = _wf(spark, sf)
    return detectors.inductive_tail_scores(w.filter("y = 0"), w, ["series", "win"], FEATS).select("win", _r("raw"))


HB = f"""hl AS ({_IND}), he AS (SELECT feature, min(x) AS lo, max(x) AS hi, count(*) AS n, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 10 ELSE 0.1 END AS w FROM hl WHERE y = 0 GROUP BY feature),
hc AS (SELECT he.feature, greatest(0, least(9, floor((x - lo) / w)))::INTEGER AS cell, count(*) AS c FROM hl JOIN he ON hl.feature = he.feature WHERE y = 0 GROUP BY 1, 2),
hg AS (SELECT he.feature, r.cell, log2(coalesce(c, 0) / (n * w) + 0.1) AS logd FROM he, range(0, 10) r(cell) LEFT JOIN hc ON hc.feature = he.feature AND hc.cell = r.cell),
hw AS (SELECT feature, min(logd) AS worst FROM hg GROUP BY feature),
raw AS (SELECT win, sum(-CASE WHEN x < lo - 0.5 * w OR x > hi + 0.5 * w THEN worst ELSE logd END) AS raw FROM hl JOIN he ON hl.feature = he.feature JOIN hw ON hw.feature = hl.feature JOIN hg ON hg.feature = hl.feature AND hg.cell = greatest(0, least(9, floor((x - lo) / w)))::INTEGER GROUP BY win)"""
HB = HB.replace("FROM he, range(0, 10) r(cell) LEFT JOIN", "FROM he CROSS JOIN range(0, 10) r(cell) LEFT JOIN")


@query(f"WITH {WF}, {HB} SELECT win, {_rs('raw')} FROM raw")
def hbos_windows(spark, sf):
    w = _wf(spark, sf)
    return detectors.hbos_scores(w.filter("y = 0"), w, ["series", "win"], FEATS).select("win", _r("raw"))


def _models(spark, sf):
    w = _wf(spark, sf)
    ids = ["series", "win"]
    e, c = (detectors.tail_scores(w, ids, FEATS, k).withColumn("model", F.lit(k)) for k in ("ecod", "copod"))
    return keep(w.select(*ids, "y", "label").join(e.unionByName(c), ids), "models")


def _models_sql() -> str:
    e = _tail_sql("wf", "win", FEATS, "ecod")
    c = _tail_sql("wf", "win", FEATS, "copod")
    for n in ("tl", "tk", "tp", "ts_"):
        c = c.replace(f"{n} AS (", f"c{n} AS (").replace(f"FROM {n}", f"FROM c{n}").replace(f"JOIN {n}", f"JOIN c{n}").replace(f"{n}.", f"c{n}.")
    c = c.replace("raw AS (SELECT", "craw AS (SELECT")
    return f"""{WF}, {e}, {c}, ms AS (SELECT win, 'ecod' AS model, raw FROM raw UNION ALL SELECT win, 'copod', raw FROM craw),
mb AS (SELECT model, quantile_cont(raw, 0.05) AS low, quantile_cont(raw, 0.95) AS high FROM ms JOIN wf ON ms.win = wf.win WHERE y = 0 GROUP BY model),
sc AS (SELECT ms.win, ms.model, y, label, greatest(0.0, least(1.0, (raw - low) / (high - low))) AS score FROM ms JOIN wf ON ms.win = wf.win JOIN mb ON ms.model = mb.model)"""


MODELS = _models_sql()


@query(f"WITH {MODELS} SELECT model, {_rs('low')}, {_rs('high')} FROM mb")
def calibrate_bounds(spark, sf):
    return scaling.bounds(_models(spark, sf)).select("model", _r("low"), _r("high"))


def _calibrated(spark, sf):
    m = _models(spark, sf)
    return scaling.calibrate(m, m)


@query(f"WITH {MODELS} SELECT win, model, {_rs('score')} FROM sc")
def calibrate_scores(spark, sf):
    return _calibrated(spark, sf).select("win", "model", _r("score"))


@query(f"WITH {MODELS} SELECT win, round(greatest(0.0, least(1.0, sum(score * CASE model WHEN 'ecod' THEN 0.75 ELSE 0.25 END))), 6) + 0.0 AS score FROM sc GROUP BY win")
def ensemble_blend(spark, sf):
    return ensemble.blend(_calibrated(spark, sf), {"ecod": 1.5, "copod": 0.5, "absent": 9.0}).select("win", _r("score"))


def _wide(spark, sf):
    return _calibrated(spark, sf).groupBy("series", "win").agg(F.max("y").alias("y"), *[F.round(F.max(F.when(F.col("model") == m, F.col("score"))), 6).alias(m) for m in ("ecod", "copod")])


def _auc_sql(source: str, by: str) -> str:
    g, p = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""cp AS (SELECT {g}score, sum((y = 1)::INTEGER)::DOUBLE AS p, sum((y = 0)::INTEGER)::DOUBLE AS n FROM {source} GROUP BY {g}score),
cv AS (SELECT *, sum(p) OVER ({p} ORDER BY score DESC) AS tp, sum(n) OVER ({p} ORDER BY score DESC) AS fp, sum(p) OVER ({p}) AS tot_p, sum(n) OVER ({p}) AS tot_n FROM cp),
au AS (SELECT {g}CASE WHEN max(tot_p) > 0 AND max(tot_n) > 0 THEN sum(n * (tp - p + p / 2)) / (max(tot_p) * max(tot_n)) END AS auroc, CASE WHEN max(tot_p) > 0 THEN sum(p * tp / (tp + fp)) / max(tot_p) END AS auprc FROM cv {'GROUP BY ' + by if by else ''})"""


_WIDE_SQL = f"{MODELS}, wd2 AS (SELECT win, max(y) AS y, round(max(score) FILTER (model = 'ecod'), 6) AS ecod, round(max(score) FILTER (model = 'copod'), 6) AS copod FROM sc GROUP BY win)"


@query(f"""WITH {_WIDE_SQL}, gr AS (SELECT k::INTEGER AS combo, k / 4.0::DOUBLE AS we, (4 - k) / 4.0::DOUBLE AS wc FROM range(0, 5) r(k)), mx AS (SELECT combo, we, wc, y, we * ecod + wc * copod AS score FROM wd2, gr), {_auc_sql('mx', 'combo')}
SELECT au.combo, we AS ecod, wc AS copod, {_rs('auroc').replace('AS auroc', 'AS value')} FROM au JOIN gr ON au.combo = gr.combo""")
def ensemble_weight_search(spark, sf):
    return ensemble.search_weights(_wide(spark, sf), ["ecod", "copod"], step=0.25, least=0.0).select("combo", "ecod", "copod", _r("value"))


@query(f"""WITH {_WIDE_SQL}, mx AS (SELECT w AS weight, y, (1 - w) * ecod + w * copod AS score FROM wd2, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) v(w)), {_auc_sql('mx', 'weight')} SELECT weight, {_rs('auprc')} FROM au""")
def fusion_sweep(spark, sf):
    w = _wide(spark, sf).withColumnsRenamed({"ecod": "score", "copod": "flow_score"})
    return ensemble.sweep_fusion(w).select("weight", _r("auprc"))


@query(f"WITH {_WIDE_SQL} SELECT win, round(0.7 * ecod + 0.3 * copod, 8) + 0.0 AS score FROM wd2")
def fusion_blend(spark, sf):
    return ensemble.fuse(_wide(spark, sf).withColumnsRenamed({"ecod": "score", "copod": "flow_score"}), 0.3).select("win", _r("score", 8))


# metrics: flows scored by their bytes, ties and all

SCORES = f"{FLOWS}, scored AS (SELECT day, label, (label <> 'BENIGN')::INTEGER AS y, round(total_bytes) AS score FROM flows)"


def _scored(spark, sf):
    return _flows(spark, sf).select("day", "label", (F.col("label") != "BENIGN").cast("int").alias("y"), F.round("total_bytes").alias("score"))


@query(f"WITH {SCORES}, {_auc_sql('scored', 'day')} SELECT day, {_rs('auroc')}, {_rs('auprc')} FROM au")
def metric_auc(spark, sf):
    return metrics.auc(_scored(spark, sf), ["day"]).select("day", _r("auroc"), _r("auprc"))


@query(f"WITH {SCORES}, {_auc_sql('scored', '')} SELECT score AS threshold, round(fp / tot_n, 6) + 0.0 AS fpr, round(tp / tot_p, 6) + 0.0 AS tpr FROM cv")
def metric_roc(spark, sf):
    return metrics.roc_points(_scored(spark, sf)).select("threshold", _r("fpr"), _r("tpr"))


_F1 = "coalesce(2 * tp / (2 * tp + fp + (tot_p - tp)), 0)"


@query(f"WITH {SCORES}, {_auc_sql('scored', 'day')}, f AS (SELECT day, score, {_F1} AS f1 FROM cv) SELECT day, score AS threshold, round(f1, 6) AS value FROM f QUALIFY row_number() OVER (PARTITION BY day ORDER BY f1 DESC, score DESC) = 1")
def threshold_f1(spark, sf):
    return metrics.threshold(_scored(spark, sf), "f1", ["day"]).select("day", "threshold", _r("value"))


@query(f"WITH {SCORES}, {_auc_sql('scored', '')}, f AS (SELECT score, tp / tot_p - fp / tot_n AS j FROM cv) SELECT score AS threshold, round(j, 6) AS value FROM f QUALIFY row_number() OVER (ORDER BY j DESC, score DESC) = 1")
def threshold_youden(spark, sf):
    return metrics.threshold(_scored(spark, sf), "youden_j").select("threshold", _r("value"))


@query(f"WITH {SCORES}, q AS (SELECT day, quantile_cont(score, 0.95) AS t FROM scored GROUP BY day) SELECT s.day, round(t, 6) AS threshold, round(coalesce(2.0 * sum((score >= t AND y = 1)::INTEGER) / (sum((score >= t)::INTEGER) + sum(y)), 0), 6) AS value FROM scored s JOIN q ON s.day = q.day GROUP BY s.day, t")
def threshold_percentile(spark, sf):
    return metrics.threshold(_scored(spark, sf), "percentile", ["day"]).select("day", _r("threshold"), _r("value"))


@query(f"""WITH {SCORES}, {_auc_sql('scored', '')}, z AS (SELECT score, p, n, lead(p) OVER (ORDER BY score DESC) AS np, lead(n) OVER (ORDER BY score DESC) AS nn, row_number() OVER (ORDER BY score DESC) AS nr, fp / tot_n AS fpr, tp / tot_p AS tpr FROM cv)
SELECT score AS threshold, round(tpr, 6) AS value FROM z WHERE (nr = 1 OR np IS NULL OR np <> p OR nn <> n) AND fpr <= 0.1 ORDER BY score LIMIT 1""")
def threshold_fpr(spark, sf):
    return metrics.threshold(_scored(spark, sf), "fpr_0.10").select("threshold", _r("value"))


_CONF = "sum((score < 50 AND y = 0)::INTEGER)::BIGINT AS tn, sum((score >= 50 AND y = 0)::INTEGER)::BIGINT AS fp, sum((score < 50 AND y = 1)::INTEGER)::BIGINT AS fn, sum((score >= 50 AND y = 1)::INTEGER)::BIGINT AS tp"
_RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(fp / greatest(fp + tn, 1), 6) AS fpr, round(fn / greatest(fn + tp, 1), 6) AS fnr"


@query(f"WITH {SCORES}, {_auc_sql('scored', 'day')}, c AS (SELECT day, {_CONF} FROM scored GROUP BY day) SELECT c.day, {_rs('auroc')}, {_rs('auprc')}, tn, c.fp, fn, c.tp, {_RATES.replace('tp', 'c.tp').replace('fp ', 'c.fp ').replace('fp,', 'c.fp,').replace('+ fp', '+ c.fp')} FROM c JOIN au ON c.day = au.day".replace("c.c.", "c."))
def metric_evaluate(spark, sf):
    s = _scored(spark, sf)
    t = s.select("day").distinct().withColumn("threshold", F.lit(50.0))
    return metrics.evaluate(s, t, ["day"]).select("day", _r("auroc"), _r("auprc"), "tn", "fp", "fn", "tp", *[_r(c) for c in ("precision", "recall", "f1", "fpr", "fnr")])


_PC = f"""WITH {SCORES}, kinds AS (SELECT DISTINCT label AS attack_type FROM scored WHERE label <> 'BENIGN'),
pc AS (SELECT attack_type, 0 AS y, score FROM scored, kinds WHERE label = 'BENIGN' UNION ALL SELECT label, 1, score FROM scored WHERE label <> 'BENIGN'), {_auc_sql('pc', 'attack_type')},
f AS (SELECT attack_type, score AS threshold, {_F1} AS f1 FROM cv QUALIFY row_number() OVER (PARTITION BY attack_type ORDER BY {_F1} DESC, score DESC) = 1)
SELECT au.attack_type, (SELECT count(*) FROM scored WHERE label = au.attack_type) AS n_samples, {_rs('auroc')}, {_rs('auprc')}, threshold, round(f1, 6) AS f1 FROM au JOIN f ON au.attack_type = f.attack_type"""


@query(_PC)
def per_class(spark, sf):
    return metrics.per_class(_scored(spark, sf)).select("attack_type", "n_samples", _r("auroc"), _r("auprc"), "threshold", _r("f1"))


@query(f"WITH {SCORES}, c AS (SELECT day, {_CONF} FROM scored GROUP BY day) SELECT day, round(tn / greatest(tn + fp, 1), 6) AS tn_share, round(fp / greatest(tn + fp, 1), 6) AS fp_share, round(fn / greatest(fn + tp, 1), 6) AS fn_share, round(tp / greatest(fn + tp, 1), 6) AS tp_share FROM c")
def confusion_shares(spark, sf):
    s = _scored(spark, sf)
    return metrics.normalised_confusion(s, s.select("day").distinct().withColumn("threshold", F.lit(50.0)), ["day"]).select("day", *[_r(f"{c}_share") for c in ("tn", "fp", "fn", "tp")])


@query(f"WITH {SCORES} SELECT label, greatest(1, least(10, floor(score / 10) + 1))::INTEGER AS cell, count(*) AS n FROM scored GROUP BY 1, 2")
def score_histogram(spark, sf):
    return metrics.histogram(_scored(spark, sf), "score", 0.0, 100.0, 10, ["label"])


@query(f"WITH {FLOWS} SELECT label, round(quantile_cont(total_bytes, 0.05), 6) AS p5, round(quantile_cont(total_bytes, 0.5), 6) AS p50, round(quantile_cont(total_bytes, 0.95), 6) AS p95, round(avg(total_bytes), 6) AS mean FROM flows GROUP BY label")
def percentiles(spark, sf):
    f = _flows(spark, sf)
    q = ranks.percentiles(f, ["label"], "total_bytes", [0.05, 0.5, 0.95])
    mean = f.groupBy("label").agg(F.round(F.avg("total_bytes"), 6).alias("mean"))
    return q.join(mean, "label").select("label", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))], "mean")


_HALVES = f"""{FLOWS}, sc AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, (label <> 'BENIGN')::INTEGER AS y, round(total_bytes) AS score FROM flows),
v AS (SELECT y, score FROM sc WHERE split = 'val'), {_auc_sql('v', '')},
th AS (SELECT 'f1' AS threshold_method, score AS t FROM cv QUALIFY row_number() OVER (ORDER BY {_F1} DESC, score DESC) = 1
  UNION ALL SELECT 'youden_j', score FROM (SELECT score, tp / tot_p - fp / tot_n AS j FROM cv) QUALIFY row_number() OVER (ORDER BY j DESC, score DESC) = 1
  UNION ALL SELECT 'percentile_95', quantile_cont(score, 0.95) FROM v),
c AS (SELECT threshold_method, t, sum((score < t AND y = 0)::INTEGER)::BIGINT AS tn, sum((score >= t AND y = 0)::INTEGER)::BIGINT AS fp, sum((score < t AND y = 1)::INTEGER)::BIGINT AS fn, sum((score >= t AND y = 1)::INTEGER)::BIGINT AS tp
  FROM sc JOIN th ON split = 'test' GROUP BY 1, 2)"""


@query(f"WITH {_HALVES} SELECT threshold_method, round(t, 6) AS threshold, tn, fp, fn, tp, {_RATES} FROM c")
def threshold_methods(spark, sf):
    rows = _flows(spark, sf).select(F.when(F.col("event_id") % 2 == 0, "val").otherwise("test").alias("split"), F.lit("bytes").alias("model"), (F.col("label") != "BENIGN").cast("int").alias("y"), F.round("total_bytes").alias("score"))
    made = pipeline.evaluate_methods(keep(rows, "halves"), ("f1", "youden_j", "percentile_95"), "bytes")
    return made.select("threshold_method", _r("threshold"), "tn", "fp", "fn", "tp", *[_r(c) for c in ("precision", "recall", "f1", "fpr", "fnr")])


@query(f"WITH {FLOWS} SELECT label, count(*) AS n, round(avg(total_bytes), 6) AS mean, round(stddev_samp(total_bytes), 6) AS stddev, min(total_bytes) AS low, max(total_bytes) AS high FROM flows GROUP BY label")
def describe_flows(spark, sf):
    x = "total_bytes"
    return _flows(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev(x), 6).alias("stddev"), F.min(x).alias("low"), F.max(x).alias("high"))


@query(f"WITH {FLOWS} SELECT day, count(DISTINCT label) AS labels, count(DISTINCT duration) AS users FROM flows GROUP BY day")
def distinct_per_day(spark, sf):
    return _flows(spark, sf).groupBy("day").agg(F.count_distinct("label").alias("labels"), F.count_distinct("duration").alias("users"))


@query(f"WITH {FLOWS} SELECT event_id, label FROM flows WHERE day IN (SELECT day FROM flows WHERE label = 'SIGNUP' GROUP BY day HAVING count(*) >= 3)")
def semi_join_days(spark, sf):
    f = _flows(spark, sf)
    busy = f.filter("label = 'SIGNUP'").groupBy("day").count().filter("count >= 3")
    return f.join(busy, "day", "left_semi").select("event_id", "label")


@query(f"WITH {FLOWS}, d AS (SELECT min(day) AS first FROM flows) SELECT day = first AS train, count(*) AS n, round(sum(total_bytes), 6) AS total FROM flows, d GROUP BY 1")
def day_against_rest(spark, sf):
    f = _flows(spark, sf)
    first = f.agg(F.min("day")).first()[0]
    parts = src.day_against_rest(f, first)
    both = parts[0].withColumn("train", F.lit(True)).unionByName(parts[1].withColumn("train", F.lit(False)))
    return both.groupBy("train").agg(F.count("*").alias("n"), F.round(F.sum("total_bytes"), 6).alias("total"))


@query("SELECT event_id, CASE WHEN value = 0 OR event_id % 7 = 0 THEN 0.0 ELSE value END AS x FROM events")
def finite_or_zero(spark, sf):
    odd = F.when(F.col("event_id") % 21 == 0, float("nan")).when(F.col("event_id") % 14 == 0, float("inf")).when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))
    return src.finite_or_zero(_t(spark, sf, "events").select("event_id", odd.alias("x")), ["x"])


@query(f"WITH {FLOWS}, d AS (SELECT label, round(total_bytes) AS x, count(*) AS c FROM flows GROUP BY 1, 2) SELECT label, x, c, sum(c) OVER (PARTITION BY label ORDER BY x)::BIGINT AS run_c, sum(c) OVER (PARTITION BY label)::BIGINT AS all_c FROM d")
def running_counts(spark, sf):
    return ranks.counted(_flows(spark, sf).select("label", F.round("total_bytes").alias("x")), ["label"], "x")


@query("SELECT l_linenumber AS series, l_orderkey AS win, row_number() OVER (ORDER BY l_linenumber, l_orderkey) - 1 AS place, count(*) OVER () AS many FROM (SELECT DISTINCT l_linenumber, l_orderkey FROM lineitem)")
def places(spark, sf):
    return ranks.places(_t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("series"), F.col("l_orderkey").alias("win")).distinct(), "win")


# without a form in SQL


def _fitted(spark, sf, model):
    w = _wf(spark, sf)
    w = scaling.scale(w, scaling.fit_scaler(w.filter("y = 0"), FEATS), FEATS)
    return detectors.score_batches(w, ["series", "win", "y"], FEATS, model.fit(detectors.matrix(w.filter("y = 0"), FEATS))).select("win", "y", "raw")


@query()
def iforest(spark, sf):
    return _fitted(spark, sf, detectors.IsolationForest())


@query()
def vae(spark, sf):
    return _fitted(spark, sf, detectors.VariationalAutoencoder())


@query()
def deep_svdd(spark, sf):
    return _fitted(spark, sf, detectors.DeepSvdd())


@query()
def sample_flows(spark, sf):
    return src.sample_flows(spark)


@query()
def detection_pipeline(spark, sf):
    f = _flows(spark, sf)
    first = f.agg(F.date_trunc("day", F.min("ts").cast("timestamp")).cast("timestamp_ntz").alias("t0"))
    f = f.crossJoin(F.broadcast(first))
    early = F.col("ts") < F.col("t0") + F.expr("INTERVAL 15 DAY")
    return pipeline.detect(f.filter(early), f.filter(~early), CFG, models=("ecod", "hbos"))["models"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return spectral_descriptors(spark, sf)
