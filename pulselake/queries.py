"""The operators applied to the driver's tables, each with the SQL that gives the same rows.

events stands for frames (value: energy, user_id: recording, event_type: label), orders for
intervals, part for spectra, embeddings for descriptors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FEATURE_FLOORS, FEATURE_WEIGHTS, FEATURES
from .functions import scalars as S
from .operators import frames, intervals, matching, overview, reports, review, separation, series
from .plans import commits
from .sinks import tables
from .storage import checkpoint, shared_folder
from .streaming import pulses as streams

LABELS = ["click", "error", "purchase", "view"]  # signup is left out on purpose: it counts as unknown
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with energy, whose cube gives calls that stand out."""
    e = _t(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts", "user_id", "event_type", "value")
    return e.withColumn("energy", F.col("value") * F.col("value") * F.col("value"))


#: Frames of a block.
BLOCK = series.BLOCK


def _framed(spark: SparkSession, sf: str) -> DataFrame:
    """_events with frame, their number within user_id by (ts, event_id)."""
    return series.numbered(_events(spark, sf), ["user_id"], ["ts", "event_id"], "frame")


_FRAMES = "f AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
_DB = _FRAMES + ", d AS (SELECT *, greatest(10 * log10(greatest(value * value * value, 1e-10)) - 10 * log10(greatest(max(value * value * value) OVER (PARTITION BY user_id), 1e-10)), -80.0) AS db FROM f)"
_SMOOTH = _DB + """, s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id) >= 5 THEN sum(db) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE db END AS x FROM d)"""
_ACTIVE = _SMOOTH + """, h AS (SELECT user_id, greatest(-28.0, median(x) + 10.0) AS th FROM s GROUP BY user_id),
a AS (SELECT s.*, th FROM s JOIN h USING (user_id) WHERE round(x, 9) >= round(th, 9))"""
_ISLANDS = _ACTIVE + """, g AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 3 THEN 1 WHEN lag(frame) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame)::BIGINT AS island FROM g)"""


def _smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed frames, kept, as what follows reads them more than once."""
    e = frames.normalise_db(_framed(spark, sf), ["user_id"], "energy", "db", BLOCK)
    x = frames.smooth(e, ["user_id"], ["frame"], "db", "x", BLOCK).withColumn("x", F.round("x", 9))
    return checkpoint(x.select("user_id", "event_id", "frame", "value", "x"))


def _lit(x: DataFrame) -> DataFrame:
    """Smoothed frames at or above their user's threshold."""
    q = series.quantiles(x, ["user_id"], "x", {"median": 0.5})
    return frames.active(x, ["user_id"], "x", levels=q.select("user_id", F.round(frames.detection_level(F.col("median")), 9).alias("threshold_db")))


def _islands(x: DataFrame) -> DataFrame:
    return frames.merge_gaps(_lit(x), ["user_id"], "frame", 2, block=BLOCK)


@query(f"WITH {_DB} SELECT user_id, event_id, round(db, 6) AS db FROM d")
def frame_db_normalise(spark, sf):
    """W11, F9, Q2."""
    return frames.normalise_db(_events(spark, sf), ["user_id"], "energy", "db", BLOCK).select("user_id", "event_id", F.round("db", 6).alias("db"))


@query(f"WITH {_SMOOTH} SELECT user_id, event_id, round(x, 6) AS smooth_db FROM s")
def smooth_zero_pad(spark, sf):
    """W1, Q1."""
    return _smooth(spark, sf).select("user_id", "event_id", F.round("x", 6).alias("smooth_db"))


@query(
    f"WITH {_SMOOTH} SELECT user_id, round(greatest(-28.0, median(x) + 10.0), 6) AS detect_db, round(least(-10.0, greatest(-24.0, quantile_cont(x, 0.2) + 6.0)), 6) AS refine_db, count(*)::BIGINT AS n FROM s GROUP BY user_id"
)
def adaptive_threshold(spark, sf):
    """A2, A3."""
    x = _smooth(spark, sf)
    q = series.with_facts(series.quantiles(x, ["user_id"], "x", {"median": 0.5, "p20": 0.2}), x.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"])
    return q.select("user_id", F.round(frames.detection_level(F.col("median")), 6).alias("detect_db"), F.round(frames.refine_level(F.col("p20")), 6).alias("refine_db"), "n")


@query(f"WITH {_ISLANDS} SELECT user_id, island, min(frame)::BIGINT AS first_frame, max(frame)::BIGINT AS last_frame, count(*)::BIGINT AS n FROM i GROUP BY user_id, island")
def gap_merge(spark, sf):
    """P3, W2, T3, Q3."""
    return _islands(_smooth(spark, sf)).select("user_id", "island", F.col("first_frame").cast("long"), F.col("last_frame").cast("long"), "n")


@query(
    f"""WITH {_FRAMES}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 3600000000 THEN 1 WHEN lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS island FROM g)
    SELECT user_id, island, min(us)::BIGINT AS first_us, max(us)::BIGINT AS last_us, count(*)::BIGINT AS n FROM i GROUP BY user_id, island"""
)
def gap_merge_time(spark, sf):
    """W2 on times: the batch twin of a session window."""
    x = frames.islands(_events(spark, sf), ["user_id"], "us", F.lit(3_600_000_000), ["us", "event_id"], 7 * 86_400_000_000)
    return x.groupBy("user_id", "island").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))


@query(
    f"""WITH {_ISLANDS}, b AS (SELECT user_id, island, min(frame) AS a, max(frame) AS z FROM i GROUP BY user_id, island),
    n AS (SELECT b.user_id, b.island, s.x, s.frame BETWEEN b.a AND b.z AS core FROM b JOIN s ON s.user_id = b.user_id AND s.frame BETWEEN b.a - 20 AND b.z + 20)
    SELECT user_id, island, round(median(x) FILTER (core) - coalesce(median(x) FILTER (NOT core), quantile_cont(x, 0.2)), 6) AS snr_db FROM n GROUP BY user_id, island"""
)
def pulse_snr(spark, sf):
    """A4 over each island and 20 frames on either side."""
    s = _smooth(spark, sf)
    near = _islands(s).withColumn("frame", F.explode(F.sequence(F.col("first_frame") - 20, F.col("last_frame") + 20)))
    # So many tasks that one has no more rows of a larger table than of a small one; and no side is broadcast, as Spark takes near for as small as it is before explode.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), s.count() >> 17)
    near, s = near.repartition(tasks, "user_id", "frame"), s.select("user_id", "frame", "x").repartition(tasks, "user_id", "frame")
    x = near.hint("merge").join(s, ["user_id", "frame"]).repartition(tasks, "user_id", "island")
    return frames.island_snr(x, ["user_id", "island"], "x", F.col("frame").between(F.col("first_frame"), F.col("last_frame"))).withColumn("snr_db", F.round("snr_db", 6))


def _orders(spark, sf):
    """Orders as pulses: days as seconds, a chunk of 30 days, SNR from the price."""
    return _as_pulses(_t(spark, sf, "orders"))


def _as_pulses(o: DataFrame) -> DataFrame:
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    x = o.select(F.col("o_custkey").alias("recording_key"), "o_orderkey", start.alias("start_s"), (start + 5 + F.col("o_orderkey") % 40).alias("end_s"), F.col("o_totalprice").alias("snr_db"))
    return x.withColumn("chunk_index", F.floor(F.col("start_s") / 30).cast("long"))


_ORDERS = """o AS (SELECT o_custkey AS recording_key, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS start_s,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE + 5 + o_orderkey % 40 AS end_s, o_totalprice AS snr_db, floor(date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 30)::BIGINT AS chunk_index FROM orders)"""


@query(
    f"""WITH {_ORDERS} SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key, round(greatest(0, least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) / least(a.end_s - a.start_s, b.end_s - b.start_s), 6) AS overlap
    FROM o a JOIN o b ON a.recording_key = b.recording_key AND b.chunk_index = a.chunk_index + 1"""
)
def overlap_ratio_pairs(spark, sf):
    """J4 over the orders of neighbouring chunks."""
    a, b = (_orders(spark, sf).select([F.col(c).alias(f"{s}_{c}") for c in ("recording_key", "o_orderkey", "start_s", "end_s", "chunk_index")]) for s in "ab")
    x = a.join(b, (F.col("a_recording_key") == F.col("b_recording_key")) & (F.col("a_chunk_index") + 1 == F.col("b_chunk_index")))
    return x.select(F.col("a_o_orderkey").alias("a_key"), F.col("b_o_orderkey").alias("b_key"), F.round(S.overlap_ratio(F.col("a_start_s"), F.col("a_end_s"), F.col("b_start_s"), F.col("b_end_s")), 6).alias("overlap"))


@query(
    f"""WITH {_ORDERS} SELECT n.o_orderkey, n.recording_key, n.chunk_index FROM o n WHERE NOT EXISTS (
      SELECT 1 FROM o p WHERE p.recording_key = n.recording_key AND p.chunk_index = n.chunk_index - 1 AND (
        greatest(0, least(p.end_s, n.end_s) - greatest(p.start_s, n.start_s)) / least(p.end_s - p.start_s, n.end_s - n.start_s) >= 0.5
        OR abs((p.start_s + p.end_s) / 2 - (n.start_s + n.end_s) / 2) <= 0.0015))"""
)
def cross_chunk_antijoin(spark, sf):
    """J3, Q6, Q7."""
    x = intervals.drop_repeats_across_chunks(_orders(spark, sf), bucket_s=32.0, tail=None)
    return x.select("o_orderkey", "recording_key", "chunk_index")


@query(
    f"""WITH RECURSIVE {_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_key ORDER BY start_s, end_s, snr_db) AS i FROM o),
    k AS (SELECT recording_key, i, 1 AS slot, start_s, end_s, snr_db FROM r WHERE i = 1
      UNION ALL SELECT r.recording_key, r.i, CASE WHEN v.same THEN k.slot ELSE k.slot + 1 END,
        CASE WHEN v.same AND r.snr_db <= k.snr_db THEN k.start_s ELSE r.start_s END, CASE WHEN v.same AND r.snr_db <= k.snr_db THEN k.end_s ELSE r.end_s END, CASE WHEN v.same AND r.snr_db <= k.snr_db THEN k.snr_db ELSE r.snr_db END
      FROM k JOIN r ON r.recording_key = k.recording_key AND r.i = k.i + 1,
      LATERAL (SELECT greatest(0, least(k.end_s, r.end_s) - greatest(k.start_s, r.start_s)) / least(k.end_s - k.start_s, r.end_s - r.start_s) >= 0.6 AS same) v)
    SELECT recording_key, arg_max(start_s, i) AS start_s, arg_max(end_s, i) AS end_s, arg_max(snr_db, i) AS snr_db FROM k GROUP BY recording_key, slot"""
)
def greedy_dedup(spark, sf):
    """G5, Q5."""
    return intervals.greedy_dedup(_orders(spark, sf), ["recording_key"])


@query(
    """WITH r AS (SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 3600 AS d FROM events GROUP BY user_id)
    SELECT user_id, c::INT AS chunk_index, round(c * 10.0::DOUBLE, 6) AS coverage_start_s, round(least((c + 1) * 10.0::DOUBLE, d), 6) AS coverage_end_s,
      round(greatest(0, c * 10.0::DOUBLE - 0.5), 6) AS read_start_s, round(least(d, least((c + 1) * 10.0, d) + 0.5), 6) AS read_end_s
    FROM (SELECT user_id, d, unnest(range(ceil(d / 10.0)::BIGINT)) AS c FROM r WHERE d > 0)"""
)
def chunk_grid(spark, sf):
    """An hour of events stands for a second."""
    e = _events(spark, sf).groupBy("user_id").agg(((F.max("us") - F.min("us")) / 1e6 / 3600).alias("duration_s"))
    g = intervals.chunk_grid(e)
    return g.select("user_id", "chunk_index", *(F.round(c, 6).alias(c) for c in ("coverage_start_s", "coverage_end_s", "read_start_s", "read_end_s")))


@query(
    f"WITH {_ORDERS} SELECT chunk_index + k AS chunk, count(*)::BIGINT AS n FROM o, (VALUES (0), (1), (2)) v(k) WHERE (start_s + end_s) / 2 >= (chunk_index + k) * 30 AND (start_s + end_s) / 2 < (chunk_index + k + 1) * 30 GROUP BY ALL"
)
def ownership_filter(spark, sf):
    """P5: orders by the chunk that owns their centre."""
    x = _orders(spark, sf).withColumn("chunk", F.explode(F.sequence(F.col("chunk_index"), F.col("chunk_index") + 2)))
    return x.filter(intervals.owned(F.col("start_s"), F.col("end_s"), F.col("chunk") * 30, (F.col("chunk") + 1) * 30)).groupBy("chunk").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, max(value) AS peak, median(value) AS med FROM events GROUP BY ALL), r AS (SELECT user_id, median(peak) AS block FROM d GROUP BY user_id)
    SELECT user_id, epoch_us(day)::BIGINT AS day_us, peak > 0 AND (peak >= 2000.0 * 0 + 0.02 OR peak >= power(10, 0.3) * med OR peak >= 2.5 * block) AS keep FROM d JOIN r USING (user_id)"""
)
def fast_skip(spark, sf):
    """A day of a user's events is a chunk."""
    e = _events(spark, sf).withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    d = e.groupBy("user_id", "day").agg(F.max("value").alias("peak"), F.median("value").alias("med"))
    x = d.join(d.groupBy("user_id").agg(F.median("peak").alias("block")), "user_id")
    return x.select("user_id", F.unix_micros("day").alias("day_us"), frames.may_contain_pulse(F.col("peak"), F.col("med"), F.col("block")).alias("keep"))


@query(
    """WITH b AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS s, count(*) AS n, max(abs(value)) AS p FROM events GROUP BY ALL)
    SELECT user_id, round(sum(s) / sum(n), 6) AS mean, max(p) AS peak, round(median(p), 6) AS block_peak_median, count(*)::BIGINT AS block_count FROM b GROUP BY user_id"""
)
def global_stats(spark, sf):
    """A5, A6, J14."""
    e = _events(spark, sf).withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    x = frames.global_stats(e, ["user_id"], ["day"], "value")
    return x.withColumns({"mean": F.round("mean", 6), "block_peak_median": F.round("block_peak_median", 6)})


def _descriptors(spark, sf):
    """Embeddings with their first 11 dimensions as features (times 10) and the last 32 as a track (times 10)."""
    x = _t(spark, sf, "embeddings")
    at = {f: (F.col("embedding")[i].cast("double") * 10).alias(f) for i, f in enumerate(FEATURES)}
    return x.select("vec_id", F.concat(F.lit("class"), "label").alias("label"), *at.values(), F.transform(F.slice("embedding", 33, 32), lambda v: v.cast("double") * 10).alias("track"))


_DESC = "e AS (SELECT vec_id, 'class' || label AS label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE * 10 AS {f}" for i, f in enumerate(FEATURES)) + " FROM embeddings)"
_SCALES = "sc AS (SELECT label, " + ", ".join(f"greatest({v}, 0.5 * (max({f}) - min({f}))) AS scale_{f}" for f, v in FEATURE_FLOORS.items()) + " FROM {src} GROUP BY label)"
_SIM = "exp(-sqrt((" + " + ".join(f"{w} * power((q.{f} - t.{f}) / sc.scale_{f}, 2)" for f, w in FEATURE_WEIGHTS.items()) + f") / {sum(FEATURE_WEIGHTS.values())}))"
_MATCH = f"""WITH {_DESC}, t AS (SELECT *, vec_id AS ord FROM e WHERE vec_id % 10 = 0), {_SCALES.format(src="t")},
m AS (SELECT q.vec_id, t.label, t.ord, {_SIM} AS score FROM e q, t JOIN sc ON sc.label = t.label WHERE q.vec_id % 10 <> 0),
b AS (SELECT vec_id, label AS template_label, ord, score FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, ord) = 1)"""


@query(f"WITH {_DESC}, {_SCALES.format(src='e')} SELECT label, " + ", ".join(f"round(scale_{f}, 6) AS scale_{f}" for f in FEATURES) + " FROM sc")
def group_scales(spark, sf):
    """A16."""
    return matching.group_scales(_descriptors(spark, sf)).select("label", *(F.round(f"scale_{f}", 6).alias(f"scale_{f}") for f in FEATURES))


def _matched(spark, sf, track=None):
    d = _descriptors(spark, sf)
    t = d.filter("vec_id % 10 = 0").withColumns({"ord": F.col("vec_id"), "file": F.concat("label", F.lit("_"), "vec_id")})
    q = d.filter("vec_id % 10 <> 0").withColumn("pulse_key", F.col("vec_id"))
    return matching.best_matches(q, t, track=track)


@query(_MATCH + " SELECT vec_id, template_label, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN template_label ELSE 'unknown' END AS predicted_label, round(-ln(greatest(score, 1e-12)), 5) AS distance FROM b")
def feature_similarity_argmax(spark, sf):
    """J1, J2, F14, F16, P6, P7, Q4."""
    return _matched(spark, sf).select("vec_id", "template_label", F.round("confidence", 6).alias("score"), "predicted_label", F.round("template_match_distance", 5).alias("distance"))


@query()
def dtw_similarity(spark, sf):
    """With tracks; a sequential recurrence, tested against its definition."""
    return _matched(spark, sf, "track").select("vec_id", "template_label", F.round("confidence", 6).alias("score"), "predicted_label")


@query(_MATCH + " SELECT vec_id, template_label, round(score, 6) AS score, format('npulse{:06d}.wav', row_number() OVER (ORDER BY vec_id)) AS pulse_file FROM b WHERE score < 0.75")
def low_similarity_scan(spark, sf):
    """P8, K10, Q15, at a threshold that some rows of the table are below."""
    x = matching.low_similarity(_matched(spark, sf), ["vec_id"], 0.75)
    return x.select("vec_id", "template_label", F.round("confidence", 6).alias("score"), "pulse_file")


_FOLD = "CASE WHEN event_type IN ('click', 'error', 'purchase', 'view') THEN event_type ELSE 'unknown' END"
_COUNTS = f"""c AS (SELECT u.user_id, l.ord, l.label, count(e.event_id)::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events) u
CROSS JOIN (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'view'), (4, 'unknown')) l(ord, label)
LEFT JOIN events e ON e.user_id = u.user_id AND {_FOLD} = l.label GROUP BY ALL)"""


def _label_counts(spark, sf):
    return reports.label_counts(_t(spark, sf, "events"), "user_id", "event_type", LABELS)


@query(f"WITH {_COUNTS} SELECT user_id, label, n FROM c")
def label_counts(spark, sf):
    """A8, Q24."""
    return _label_counts(spark, sf).select("user_id", "label", "n")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER ({_FOLD} = '{x}') AS {x}" for x in [*LABELS, "unknown"]) + " FROM events GROUP BY user_id")
def segment_pivot(spark, sf):
    """A13."""
    return reports.segment_summary(_t(spark, sf, "events"), "user_id", "event_type", LABELS)


@query(f"WITH {_COUNTS} SELECT label, count(*) FILTER (n >= 1) AS segment_count, sum(n)::BIGINT AS call_count FROM c GROUP BY label")
def overall_by_label(spark, sf):
    """A14."""
    return reports.overall_by_label(_label_counts(spark, sf))


@query(
    f"""WITH {_COUNTS}, m AS (SELECT user_id, arg_max(label, n * 10 - ord) AS lab, max(n) AS top, sum(n)::BIGINT AS classified FROM c WHERE label <> 'unknown' GROUP BY user_id)
    SELECT user_id, CASE WHEN top > 0 THEN lab ELSE '' END AS major_label, classified, CASE WHEN classified > 0 THEN round(top / classified, 6) ELSE 0 END AS purity,
      CASE WHEN classified > 0 AND top / classified < 0.5 THEN 'mixed' ELSE '' END AS consistency_note FROM m"""
)
def major_purity(spark, sf):
    """A11."""
    return reports.majority(_label_counts(spark, sf), "user_id").withColumn("purity", F.round("purity", 6))


@query(
    "SELECT user_id, round(count(*) / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 0), 9) AS calls_per_second, count(*) AS n, round(avg(value) FILTER (event_type <> 'signup'), 6) AS prediction_confidence FROM events GROUP BY user_id HAVING max(ts) > min(ts)"
)
def call_rate(spark, sf):
    """A9, A10, A12, Q14."""
    e = _events(spark, sf)
    x = e.groupBy("user_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("d")).join(reports.accumulate(e, "user_id", "event_type", LABELS, "value"), "user_id").filter("d > 0")
    return x.select("user_id", F.round(reports.call_rate(F.col("total_calls"), F.col("d")), 9).alias("calls_per_second"), F.col("total_calls").alias("n"), F.round("prediction_confidence", 6).alias("prediction_confidence"))


_RESULTS = "r AS (SELECT user_id, count(*) AS total_calls, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS d, CASE WHEN user_id % 13 = 0 THEN 'failed' WHEN user_id % 17 = 0 THEN 'cancelled' ELSE 'success' END AS st FROM events GROUP BY user_id)"


@query(
    f"WITH {_RESULTS} SELECT count(*) FILTER (st = 'success') AS success_count, count(*) FILTER (st <> 'success') AS failed_count, count(*) FILTER (st = 'cancelled') AS cancelled_count, sum(total_calls)::BIGINT AS total_calls, round(sum(d), 3) AS total_duration_s, CASE WHEN count(*) FILTER (st = 'cancelled') > 0 THEN 'cancelled' WHEN count(*) FILTER (st <> 'success') > 0 THEN 'partial_failure' ELSE 'success' END AS status FROM r"
)
def run_totals(spark, sf):
    """A15, A31, Q11."""
    e = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("total_calls"), ((F.max("us") - F.min("us")) / 1e6).alias("duration_s"))
    return reports.run_totals(e.withColumn("processing_status", F.when(F.col("user_id") % 13 == 0, "failed").when(F.col("user_id") % 17 == 0, "cancelled").otherwise("success")))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ROLLUP (user_id, event_type)")
def rollup_counts(spark, sf):
    """A13 and A14 as one rollup."""
    return reports.rollup_counts(_t(spark, sf, "events"), "user_id", "event_type")


@query("WITH b AS (SELECT p_brand, p_size, sum(p_retailprice)::DECIMAL(18, 2) AS w FROM part GROUP BY ALL), s AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size)::DOUBLE / sum(w) OVER (PARTITION BY p_brand)::DOUBLE AS sh FROM b) SELECT p_brand, min(p_size) FILTER (sh >= 0.05) AS f05, min(p_size) FILTER (sh >= 0.5) AS f50, min(p_size) FILTER (sh >= 0.95) AS f95 FROM s GROUP BY p_brand")
def weighted_quantile(spark, sf):
    """Sizes as bins, prices as power."""
    b = _t(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.sum("p_retailprice").cast("decimal(18,2)").alias("w"))
    b = b.withColumn("w", F.col("w").cast("double"))
    return frames.weighted_quantiles(b, ["p_brand"], "p_size", "w", {"f05": 0.05, "f50": 0.5, "f95": 0.95})


@query("SELECT user_id, hour(ts)::INT AS bin, round(avg(value), 6) AS mean_power FROM events GROUP BY ALL")
def spectrum_mean(spark, sf):
    """Hours as bins."""
    return _t(spark, sf, "events").groupBy("user_id", F.hour("ts").alias("bin")).agg(F.round(F.avg("value"), 6).alias("mean_power"))


@query("SELECT user_id, date_trunc('day', ts)::DATE AS frame, round(sum(value), 6) AS power FROM events WHERE hour(ts) BETWEEN 6 AND 18 GROUP BY ALL")
def band_power(spark, sf):
    """Hours 6 to 18 are the band, days the frames."""
    e = _t(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("frame"), F.hour("ts").alias("hz"), F.col("value").alias("power"))
    return frames.band_power(e, ["user_id"], 6, 18).withColumn("power", F.round("power", 6))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_quantity) > 1")
def slope(spark, sf):
    """A21."""
    g = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"))
    return g.filter("a < b").select("l_suppkey", F.round("slope", 4).alias("slope"))


@query("SELECT l_suppkey, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_quantity) > 1 AND count(DISTINCT l_extendedprice) > 1")
def corr(spark, sf):
    """A22."""
    g = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(S.pearson("l_extendedprice", "l_quantity").alias("r"), *(f(c).alias(f"{n}_{c[2:4]}") for c in ("l_quantity", "l_extendedprice") for n, f in (("lo", F.min), ("hi", F.max))))
    return g.filter("lo_qu < hi_qu and lo_ex < hi_ex").select("l_suppkey", F.round("r", 6).alias("r"))


@query(
    "WITH m AS (SELECT l_suppkey, median(l_quantity) AS med FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(median(abs(l_quantity - med)), 6) AS mad, round(quantile_cont(abs(l_quantity - med), 0.9), 6) AS p90, round(stddev_pop(l_quantity), 6) AS sd, max(l_quantity) - min(l_quantity) AS ptp FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey"
)
def mad_p90(spark, sf):
    """A23."""
    x = _t(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    x = x.join(x.groupBy("l_suppkey").agg(F.median("l_quantity").alias("med")), "l_suppkey").withColumn("d", F.abs(F.col("l_quantity") - F.col("med")))
    return x.groupBy("l_suppkey").agg(F.round(F.median("d"), 6).alias("mad"), F.round(F.percentile("d", F.lit(0.9)), 6).alias("p90"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), (F.max("l_quantity") - F.min("l_quantity")).alias("ptp"))


@query(f"WITH {_FRAMES} SELECT user_id, round(max(j), 6) AS max_jump FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)) AS j FROM f) GROUP BY user_id")
def jump_max(spark, sf):
    """W3."""
    return frames.largest_jump(_framed(spark, sf), ["user_id"], ["frame"], "value", BLOCK).withColumn("max_jump", F.round("max_jump", 6))


@query(
    f"WITH {_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM f) SELECT user_id, round(median(value) FILTER (frame < 3), 6) AS start_value, round(median(value) FILTER (frame >= c - 3), 6) AS end_value FROM n GROUP BY user_id"
)
def edge_medians(spark, sf):
    """W6."""
    x = frames.edge_medians(_events(spark, sf), ["user_id"], ["ts", "event_id"], "value")
    return x.withColumns({c: F.round(c, 6) for c in ("start_value", "end_value")})


@query(
    f"""WITH {_FRAMES}, x AS (SELECT user_id, event_id, value, coalesce(lag(value) OVER w, value) AS a, coalesce(lead(value) OVER w, value) AS b,
    coalesce(lag(value) OVER w, 0) AS p1, coalesce(lag(value, 2) OVER w, 0) AS p2, coalesce(lead(value) OVER w, 0) AS n1, coalesce(lead(value, 2) OVER w, 0) AS n2 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame))
    SELECT user_id, event_id, list_sort([a, value, b])[2] AS near3, list_sort([p2, p1, value, n1, n2])[3] AS zero5 FROM x"""
)
def rolling_medians(spark, sf):
    """W4, W5, Q20."""
    x = frames.rolling_median(_framed(spark, sf), ["user_id"], ["frame"], "value", 3, "nearest", "near3", BLOCK)
    return frames.rolling_median(x, ["user_id"], ["frame"], "value", 5, "zero", "zero5", BLOCK).select("user_id", "event_id", "near3", "zero5")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events QUALIFY rank <= 5")
def topk_peaks(spark, sf):
    """O2, O3, O4."""
    return frames.top_rows(_t(spark, sf, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 5).select("user_id", "event_id", "rank")


@query(f"WITH {_FRAMES} SELECT user_id, event_id, value FROM f QUALIFY value > lag(value) OVER (PARTITION BY user_id ORDER BY frame) AND value > lead(value) OVER (PARTITION BY user_id ORDER BY frame)")
def local_maxima(spark, sf):
    """O11 by height."""
    return frames.local_maxima(_framed(spark, sf), ["user_id"], ["frame"], "value", BLOCK).select("user_id", "event_id", "value")


@query("SELECT user_id, arg_min(event_id, (-value, event_id)) AS best_event, max(value) AS value FROM events GROUP BY user_id")
def best_by_snr(spark, sf):
    """O5, Q4."""
    return _t(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("best_event"), F.max("value").alias("value"))


_ISL = "SELECT user_id, island, min(frame) AS a, max(frame) AS z FROM i GROUP BY user_id, island"


@query(
    f"""WITH {_ISLANDS}, b AS ({_ISL}), p AS (SELECT user_id, arg_min(frame, (-value, frame)) AS peak FROM f GROUP BY user_id)
    SELECT user_id, peak::BIGINT AS peak, arg_min(a, (greatest(0, a - peak, peak - z), a, z))::BIGINT AS first_frame, min(greatest(0, a - peak, peak - z))::BIGINT AS distance FROM p JOIN b USING (user_id) GROUP BY user_id, peak"""
)
def nearest_interval(spark, sf):
    """The island of a user's loudest frame, or the nearest."""
    s = _smooth(spark, sf)
    peak = s.groupBy("user_id").agg(F.min_by("frame", F.struct(-F.col("value"), F.col("frame"))).cast("long").alias("peak"))
    i = _islands(s).select("user_id", F.col("first_frame").cast("long").alias("first_frame"), F.col("last_frame").cast("long").alias("last_frame"))
    x = intervals.nearest_interval(peak, i, ["user_id"], "peak", "first_frame", "last_frame")
    return x.select("user_id", "peak", "first_frame", F.col("distance").cast("long").alias("distance"))


_CLASS = """CASE WHEN regexp_full_match(lower({0}), 'npulse[0-9]+') THEN 'noise pulse' WHEN regexp_full_match(lower({0}), '(pulse|p)[0-9]+') THEN '可疑声波'
  WHEN regexp_matches({0}, '^.+[0-9](\\.[0-9]+)?[kK][_-]?[0-9]+$') THEN regexp_extract({0}, '^(.+[0-9](?:\\.[0-9]+)?[kK])[_-]?([0-9]+)$', 1) ELSE {0} END"""
_STEM = "CASE p_partkey % 5 WHEN 0 THEN 'npulse' || p_partkey WHEN 1 THEN 'P' || p_partkey WHEN 2 THEN 'CF' || p_size || '_' || p_size || 'K' || p_partkey WHEN 3 THEN p_brand || '.5k-' || p_size ELSE p_name END"


@query(
    f"WITH s AS (SELECT p_partkey, {_STEM} AS stem FROM part) SELECT p_partkey, {_CLASS.format('stem')} AS class, trim(regexp_replace(stem, '[<>:\"/\\\\|?*]', '_', 'g'), ' .') AS safe, regexp_replace(stem || '.wav', '^npulse([0-9]+)', 'pulse\\1') AS candidate, try_cast(regexp_replace(stem, '[^0-9]', '', 'g') AS BIGINT) AS number FROM s"
)
def class_from_name(spark, sf):
    """F1, F2, F3, F25."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    stem = (
        F.when(k % 5 == 0, F.concat(F.lit("npulse"), k)).when(k % 5 == 1, F.concat(F.lit("P"), k)).when(k % 5 == 2, F.concat(F.lit("CF"), size, F.lit("_"), size, F.lit("K"), k))
        .when(k % 5 == 3, F.concat("p_brand", F.lit(".5k-"), size)).otherwise(F.col("p_name"))
    )
    x = _t(spark, sf, "part").withColumn("stem", stem)
    s = F.col("stem")
    return x.select("p_partkey", S.class_from_stem(s).alias("class"), S.safe_component(s).alias("safe"), S.candidate_name(F.concat(s, F.lit(".wav"))).alias("candidate"), S.pulse_number(s).alias("number"))


@query(
    "WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents) SELECT doc_id, sha256(b[1:1048576] || CASE WHEN octet_length(b) > 2097152 THEN b[octet_length(b) - 1048575:octet_length(b)] ELSE ''::BLOB END) AS identity FROM d"
)
def file_identity(spark, sf):
    """Blocks of 1 MiB, so these texts are read whole."""
    d = _t(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    return d.select("doc_id", S.file_identity(F.col("b")).alias("identity"))


@query("SELECT page_id, substr(sha256(url), 1, 12) AS recording_key, substr(sha256(url), 1, 12) || '_chunk' || lpad((page_id % 7)::VARCHAR, 6, '0') || '_candidate' || lpad(page_id::VARCHAR, 6, '0') AS event_id FROM pages WHERE url IS NOT NULL")
def recording_key(spark, sf):
    """F4, F5."""
    p = _t(spark, sf, "pages").filter("url is not null").withColumn("k", S.recording_key(F.col("url")))
    return p.select("page_id", F.col("k").alias("recording_key"), S.event_id(F.col("k"), F.col("page_id") % 7, F.col("page_id")).alias("event_id"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, '[' || event_id || ',' || user_id || ']' AS packed FROM events")
def json_roundtrip(spark, sf):
    """F8, F26, S14."""
    e = _t(spark, sf, "events")
    packed = F.to_json(F.array("event_id", "user_id"))
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.when(F.from_json(packed, "array<bigint>") == F.array("event_id", "user_id"), packed).alias("packed"))


_SPAN = "t AS (SELECT min(epoch_us(ts)) AS t0, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS d FROM events)"


@query(f"WITH {_SPAN} SELECT user_id, least(399, floor((epoch_us(ts) - t0)::DOUBLE / d * 400))::INT AS time_bin, event_type, max(value) AS value FROM events, t GROUP BY ALL")
def overview_maxpool(spark, sf):
    """A24, D18."""
    e = _events(spark, sf)
    span = e.agg(F.min("us").alias("t0"), (F.max("us") - F.min("us") + 1).alias("d"))
    return overview.max_pool(e.crossJoin(F.broadcast(span)), ["user_id"], (F.col("us") - F.col("t0")).cast("double"), F.col("d"), "event_type", "value", 400)


@query(
    f"""WITH {_FRAMES}, b AS (SELECT user_id, frame // 16 AS bucket, min((value, frame)) AS lo, max((value, -frame)) AS hi FROM f GROUP BY ALL)
    SELECT DISTINCT user_id, bucket::BIGINT AS bucket, "at"::BIGINT AS "at", value FROM (SELECT user_id, bucket, unnest([lo[2], -hi[2]]) AS "at", unnest([lo[1], hi[1]]) AS value FROM b)"""
)
def waveform_minmax(spark, sf):
    """A25."""
    x = overview.minmax_trace(_framed(spark, sf), ["user_id"], F.floor(F.col("frame") / 16), "frame", "value")
    return x.select("user_id", "bucket", F.col("at").cast("long").alias("at"), "value")


@query(
    "WITH p AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, sum(value) AS p FROM events GROUP BY ALL), m AS (SELECT user_id, max(p) AS hi, min(p) AS lo FROM p GROUP BY user_id) SELECT user_id, day, round(CASE WHEN hi <= 0 OR (hi - lo) / hi < 0.5 THEN 0 ELSE p / hi END, 6) AS envelope FROM p JOIN m USING (user_id)"
)
def band_envelope(spark, sf):
    """A26."""
    e = _t(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    return overview.band_envelope(e, ["user_id"], "day", "value").withColumn("envelope", F.round("envelope", 6))


@query("SELECT l_orderkey, min(l_quantity) AS start_value, max(l_quantity) AS end_value, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels, min(l_discount) AS low, max(l_discount) AS high, count(*) AS n_components FROM lineitem GROUP BY l_orderkey")
def merged_events(spark, sf):
    """A27."""
    return overview.merged_events(_t(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_quantity", "l_returnflag", "l_discount", "l_discount")


@query(
    """WITH a AS (SELECT p_partkey, p_retailprice * 10 AS lo, p_retailprice * 10 + p_size * 1500 AS hi FROM part), b AS (SELECT *, greatest(15000, lo - 8000) AS x, least(120000, hi + 8000) AS y FROM a),
    c AS (SELECT *, greatest(15000, x - greatest(0, 20000 - (y - x)) / 2) AS u, least(120000, y + greatest(0, 20000 - (y - x)) / 2) AS v FROM b)
    SELECT p_partkey, round(CASE WHEN v - u >= 89250 THEN 15000 ELSE u END, 4) AS low_hz, round(CASE WHEN v - u >= 89250 THEN 120000 ELSE v END, 4) AS high_hz FROM c"""
)
def frequency_limits(spark, sf):
    """F22, W12."""
    p = _t(spark, sf, "part")
    lo = F.col("p_retailprice") * 10
    x = p.select("p_partkey", overview.frequency_limits(lo, lo + F.col("p_size") * 1500).alias("f"))
    return x.select("p_partkey", F.round("f.low_hz", 4).alias("low_hz"), F.round("f.high_hz", 4).alias("high_hz"))


@query("SELECT url, min(page_id) AS first FROM pages GROUP BY url")
def path_dedupe_sorted(spark, sf):
    """A30, O9, U2."""
    return review.first_paths(_t(spark, sf, "pages").select("url", "page_id"), "url", ["page_id"]).select("url", F.col("first.page_id").alias("first"))


@query(
    "SELECT d.doc_id, CASE WHEN l.status = 1 THEN 'candidate' ELSE 'unselected' END AS review_status, CASE WHEN l.status = 1 THEN 'pulse' ELSE 'npulse' END || lpad(d.doc_id::VARCHAR, 6, '0') || '.wav' AS pulse_file FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS status FROM labels GROUP BY doc_id) l USING (doc_id)"
)
def review_view(spark, sf):
    """Labels as decisions, toxic ones as candidates."""
    p = _t(spark, sf, "documents").select("doc_id", F.format_string("npulse%06d.wav", "doc_id").alias("pulse_file"))
    d = _t(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "candidate").otherwise("unselected").alias("status"), F.col("toxic").alias("decided_at"))
    return review.review_view(p, d, "doc_id")


@query(
    f"WITH {_ORDERS} SELECT o_orderkey FROM o WHERE NOT EXISTS (SELECT 1 FROM o s WHERE s.o_orderkey % 3 = 0 AND s.recording_key = o.recording_key AND s.start_s = o.start_s AND s.end_s = o.end_s)"
)
def replay_antijoin(spark, sf):
    """J5, T9."""
    o = _orders(spark, sf)
    return review.without_replayed(o, o.filter("o_orderkey % 3 = 0"), ["recording_key"], ["start_s", "end_s"]).select("o_orderkey")


@query(f"WITH {_ORDERS} SELECT recording_key, count(*)::BIGINT AS n, round(sum(snr_db), 2) AS total, max(chunk_index) + 1 AS done FROM o GROUP BY recording_key")
def committed_replay(spark, sf):
    """Orders written in parts: half are committed, a part of the others is left by a step that broke off, and they are done again from each watermark."""
    out = f"{shared_folder(spark)}/run-{uuid.uuid4()}"
    o = _orders(spark, sf).withColumn("recording_key", F.col("recording_key").cast("string"))
    put = lambda rows, part: tables.write_table(rows, f"{out}/predictions/part={part}")

    def finish(rows, part):
        put(rows, part)
        ranges = rows.groupBy("recording_key").agg(F.min("chunk_index").cast("int").alias("first_chunk"), (F.max("chunk_index") + 1).cast("int").alias("end_chunk"), F.count("*").alias("n_pulses"))
        commits.commit(ranges.withColumns({"seconds": F.lit(0.0), "identity": F.lit("")}), out, part)

    finish(o.filter("chunk_index < 40"), "first")
    put(o.filter("chunk_index >= 40 and o_orderkey % 2 = 0"), "lost")
    done = commits.progress(commits.commits(spark, out)).select("recording_key", "done")
    finish(o.join(done, "recording_key", "left").filter("done is null or chunk_index >= done").drop("done"), "again")
    done = commits.progress(commits.commits(spark, out)).select("recording_key", F.col("done").cast("long").alias("done"))
    x = commits.committed(spark, out, "predictions").groupBy("recording_key").agg(F.count("*").alias("n"), F.round(F.sum("snr_db"), 2).alias("total"))
    return x.join(done, "recording_key").withColumn("recording_key", F.col("recording_key").cast("long"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unknown_keys(spark, sf):
    """Documents without a label."""
    return review.unknown_keys(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id")


@query(f"WITH {_FRAMES} SELECT user_id, event_id, format('p{{:03d}}', frame + 1) AS pulse_id FROM f")
def pulse_numbering(spark, sf):
    """W8, W9, Q17."""
    return reports.number_pulses(_events(spark, sf), "user_id", ["us", "event_id"]).select("user_id", "event_id", "pulse_id")


@query(
    f"""WITH {_ISLANDS}, b AS (SELECT user_id, island, min(frame)::DOUBLE AS duration_ms, max(value) AS peak_freq_khz, (max(frame) - min(frame) + 1)::DOUBLE AS slope_khz_per_ms FROM i GROUP BY user_id, island),
    t(label, ord, duration_ms, peak_freq_khz, slope_khz_per_ms) AS (VALUES ('long', 0, 30.0, 100.0, 6.0), ('loud', 1, 40.0, 200.0, 2.0), ('short', 2, 20.0, 60.0, 1.0)),
    m AS (SELECT b.user_id, b.island, t.label, t.ord, exp(-sqrt((1.0 * power((b.duration_ms - t.duration_ms) / 2.0, 2) + 1.5 * power((b.peak_freq_khz - t.peak_freq_khz) / 4.0, 2) + 1.25 * power((b.slope_khz_per_ms - t.slope_khz_per_ms) / 4.0, 2)) / 3.75)) AS score FROM b, t),
    z AS (SELECT user_id, CASE WHEN score >= 1e-6 THEN label ELSE 'unknown' END AS label FROM m QUALIFY row_number() OVER (PARTITION BY user_id, island ORDER BY score DESC, ord) = 1)
    SELECT user_id, count(*) FILTER (label = 'long') AS "long", count(*) FILTER (label = 'loud') AS loud, count(*) FILTER (label = 'short') AS short, count(*) FILTER (label = 'unknown') AS "unknown" FROM z GROUP BY user_id"""
)
def segment_summary(spark, sf):
    """Calls per class and recording: frames, threshold, islands, match and pivot."""
    p = frames.islands(_lit(_smooth(spark, sf)), ["user_id"], "frame", F.lit(3), block=BLOCK).groupBy("user_id", "island").agg(
        F.min("frame").cast("double").alias("duration_ms"), F.max("value").alias("peak_freq_khz"), (F.max("frame") - F.min("frame") + 1).cast("double").alias("slope_khz_per_ms")
    )
    t = spark.createDataFrame([("long", 0, 30.0, 100.0, 6.0), ("loud", 1, 40.0, 200.0, 2.0), ("short", 2, 20.0, 60.0, 1.0)], "label string, ord int, duration_ms double, peak_freq_khz double, slope_khz_per_ms double")
    x = matching.best_matches(p.withColumn("pulse_key", F.struct("user_id", "island")), t.withColumn("file", F.col("label")), ("duration_ms", "peak_freq_khz", "slope_khz_per_ms"), min_score=1e-6)
    return reports.segment_summary(x, "user_id", "predicted_label", ["long", "loud", "short"])


def _stream(spark, sf):
    """Events as a file stream, with event time and a watermark."""
    path = f"{sf}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream's path is no single file
    e = e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return streams.with_event_time(e, "ts")


@query("SELECT user_id, epoch_us(ts) // 3600000000 * 3600000000 AS window_us, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    """T1 as a stream: hours."""
    return streams.completed(streams.windowed_counts(_stream(spark, sf), ["user_id"], "1 hour")).select("user_id", F.unix_micros("window_start").alias("window_us"), "n")


@query("SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 - k * 3600000000 AS window_us, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL")
def stream_sliding(spark, sf):
    """T2 as a stream: two hours, each hour."""
    return streams.completed(streams.windowed_counts(_stream(spark, sf), ["event_type"], "2 hours", "1 hour")).select("event_type", F.unix_micros("window_start").alias("window_us"), "n")


@query(
    f"""WITH {_FRAMES}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 3600000000 THEN 1 WHEN lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM g) SELECT user_id, min(us)::BIGINT AS first_us, max(us)::BIGINT AS last_us, count(*)::BIGINT AS n FROM i GROUP BY user_id, island"""
)
def stream_sessions(spark, sf):
    """T3 as a stream: sessions of a user's events that lie at most an hour apart."""
    x = streams.completed(streams.sessions(_stream(spark, sf), ["user_id"], "1 hour"))
    return x.select("user_id", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"), "n")


@query("SELECT user_id, count(*) AS total_calls, " + ", ".join(f"count(*) FILTER ({_FOLD} = '{x}') AS {x}" for x in [*LABELS, "unknown"]) + " FROM events GROUP BY user_id")
def stream_totals(spark, sf):
    """T6 as a stream."""
    return streams.completed(streams.running_totals(_stream(spark, sf), "user_id", "event_type", LABELS))


@query("SELECT user_id, count(*) AS total_calls, " + ", ".join(f"count(*) FILTER ({_FOLD} = '{x}') AS {x}" for x in [*LABELS, "unknown"]) + " FROM events GROUP BY user_id")
def stream_state(spark, sf):
    """The totals of a stream over events of even ids, read from its state store, gone on with in batch by the others."""
    root = streams.new_root(spark)
    streams.ran_to_end(streams.running_totals(_stream(spark, sf).filter("event_id % 2 = 0"), "user_id", "event_type", LABELS), root)
    state = streams.totals_state(spark, f"{root}/state", "user_id", LABELS)
    return streams.add_totals(state, _t(spark, sf, "events").filter("event_id % 2 <> 0"), "user_id", "event_type", LABELS)


# Order by order within a customer: st has the last kept intervals of the chunk before and of this one.
_SAME = "(greatest(0, least(b.e, r.end_s) - greatest(b.s, r.start_s)) / least(b.e - b.s, r.end_s - r.start_s) >= 0.5 OR abs((b.s + b.e) / 2 - (r.start_s + r.end_s) / 2) <= 0.0015)"


@query(
    f"""WITH RECURSIVE {_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_key ORDER BY chunk_index, start_s, end_s, o_orderkey) AS i FROM o),
    st AS (SELECT recording_key, i, o_orderkey, chunk_index, [{{'s': -1.0::DOUBLE, 'e': -1.0::DOUBLE}}][2:] AS before, [{{'s': start_s, 'e': end_s}}] AS mine, true AS keep FROM r WHERE i = 1
      UNION ALL SELECT r.recording_key, r.i, r.o_orderkey, r.chunk_index, v.before, CASE WHEN k.keep THEN list_append(v.mine, {{'s': r.start_s, 'e': r.end_s}}) ELSE v.mine END, k.keep
      FROM st JOIN r ON r.recording_key = st.recording_key AND r.i = st.i + 1,
      LATERAL (SELECT CASE WHEN r.chunk_index = st.chunk_index THEN st.before WHEN r.chunk_index = st.chunk_index + 1 THEN st.mine[-8:] ELSE st.mine[:0] END AS before, CASE WHEN r.chunk_index = st.chunk_index THEN st.mine ELSE st.mine[:0] END AS mine) v,
      LATERAL (SELECT len(list_filter(v.before, lambda b: {_SAME})) = 0 AS keep) k)
    SELECT o_orderkey, recording_key, chunk_index FROM st WHERE keep"""
)
def stream_repeats(spark, sf):
    """T5, J3, W13 as a stream with list state: orders that the last eight kept ones of the chunk before don't show."""
    path = f"{sf}/orders.parquet"
    src = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    before = spark.conf.get(streams.STATE_STORE)
    spark.conf.set(streams.STATE_STORE, streams.ROCKSDB)
    try:
        x = streams.completed(streams.unrepeated_for(_as_pulses(src), keep_ms=None), "append")
    finally:
        spark.conf.set(streams.STATE_STORE, before)
    return x.select("o_orderkey", "recording_key", "chunk_index")


# Tracks of one pulse: three neighbours in the table of embeddings. The first is a contour, the second
# its double with small deviations and the same envelope, the third lies elsewhere.
_TRACKS = """v AS (SELECT vec_id // 3 AS pulse, (vec_id % 3)::INT AS track, embedding AS e FROM embeddings),
pt AS (SELECT pulse, track, f::INT AS frame, CASE track WHEN 0 THEN 30000 + 3000 * l[f + 1]::DOUBLE WHEN 1 THEN 2 * (30000 + 3000 * l[f + 1]::DOUBLE) * (1 + 0.002 * e[f + 1]::DOUBLE) ELSE 47000 + 2000 * e[f + 1]::DOUBLE END AS hz,
  exp(3 * l[f + 33]::DOUBLE) * (1 + 0.1 * abs(e[f + 1]::DOUBLE)) AS power
  FROM (SELECT v.*, w.e AS l FROM v JOIN v w ON w.pulse = v.pulse AND w.track = 0), range(32) r(f) WHERE NOT (track = 2 AND f > 24))"""
_TOTALS = ", tt AS (SELECT pulse, track, count(*)::BIGINT AS n, min(frame) AS first, max(frame) AS last, sum(power) AS total_power, median(hz) AS median_hz FROM pt GROUP BY ALL)"


def _track_points(spark, sf):
    v = _t(spark, sf, "embeddings").select(F.expr("vec_id div 3").alias("pulse"), (F.col("vec_id") % 3).cast("int").alias("track"), F.col("embedding").cast("array<double>").alias("e"))
    lead = v.filter("track = 0").select("pulse", F.col("e").alias("l"))
    x = v.join(lead, "pulse").select("pulse", "track", "e", "l", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("frame")).filter("not (track = 2 and frame > 24)")
    own, led, level = F.col("e")[F.col("frame")], F.col("l")[F.col("frame")], F.col("l")[F.col("frame") + 32]
    base = 30000 + 3000 * led
    hz = F.when(F.col("track") == 0, base).when(F.col("track") == 1, 2 * base * (1 + 0.002 * own)).otherwise(47000 + 2000 * own)
    return x.select("pulse", "track", "frame", hz.alias("hz"), (F.exp(3 * level) * (1 + 0.1 * F.abs(own))).alias("power"))


@query(f"WITH {_TRACKS}{_TOTALS} SELECT pulse, track, n, first, last, round(total_power, 4) AS total_power, round(median_hz, 4) AS median_hz FROM tt")
def track_totals(spark, sf):
    """A28."""
    x = separation.track_totals(_track_points(spark, sf), ["pulse"])
    return x.withColumns({"total_power": F.round("total_power", 4), "median_hz": F.round("median_hz", 4)})


_PAIRS = f"""{_TRACKS}{_TOTALS}, s AS (SELECT p.*, n, first, last, median_hz FROM pt p JOIN tt USING (pulse, track)),
j AS (SELECT a.pulse, a.track AS a_track, b.track AS b_track, a.hz AS ah, b.hz AS bh, a.n AS an, b.n AS bn, a.first AS af, b.first AS bf, a.last AS al, b.last AS bl, a.median_hz AS am, b.median_hz AS bm, b.hz / a.hz AS ratio,
  abs(b.hz - a.hz) / 1000 AS gap, 10 * log10(greatest(a.power, 1e-18)) AS adb, 10 * log10(greatest(b.power, 1e-18)) AS bdb
  FROM s a JOIN s b ON a.pulse = b.pulse AND a.frame = b.frame AND (a.median_hz < b.median_hz OR (a.median_hz = b.median_hz AND a.track < b.track))),
o AS (SELECT pulse, a_track, b_track, count(*) AS common, median(ratio) AS mr, median(ah) AS low, median(bh) AS high, greatest(1, round_even(median(ratio), 0)) AS k, round_even(median(ratio), 0) AS ord FROM j GROUP BY ALL),
x AS (SELECT *, bh / k AS scaled, bh / k - ah AS res FROM j JOIN o USING (pulse, a_track, b_track)),
t AS (SELECT pulse, a_track, b_track, common, low, high, k, ord, an, bn, af, bf, al, bl, am, bm, avg((abs(ratio / k - 1) <= 0.06)::INT) AS cover, median(abs(ratio - mr)) / any_value(k) AS mad, max(ah) - min(ah) AS lows, max(scaled) - min(scaled) AS highs,
  covar_pop(ah, scaled) / nullif(stddev_pop(ah) * stddev_pop(scaled), 0) AS cc, median(res) AS mres, stddev_pop(adb) AS asd, stddev_pop(bdb) AS bsd, covar_pop(adb, bdb) / nullif(stddev_pop(adb) * stddev_pop(bdb), 0) AS ec,
  median(gap) AS gap_khz, avg((gap >= 1.5)::INT) AS resolved FROM x GROUP BY ALL),
q AS (SELECT pulse, a_track, b_track, quantile_cont(abs(res - mres), 0.9) AS p90 FROM x JOIN t USING (pulse, a_track, b_track) GROUP BY ALL)"""


@query(
    f"""WITH {_PAIRS} SELECT pulse, a_track, b_track, common >= 2 AND common / least(an, bn) >= 0.45 AND gap_khz >= 1.5 AND resolved >= 0.6 AS independent,
    abs(greatest(bm / am, am / bm) - 2) / 2 <= 0.06 OR abs(greatest(bm / am, am / bm) - 3) / 3 <= 0.06 AS basic_harmonic, round(common / least(an, bn), 6) AS overlap, round(gap_khz, 4) AS gap_khz FROM t"""
)
def track_independence(spark, sf):
    """J6, J8, F17, F18."""
    x = separation.track_pairs(_track_points(spark, sf), ["pulse"])
    return x.select("pulse", "a_track", "b_track", "independent", "basic_harmonic", F.round("overlap", 6).alias("overlap"), F.round("gap_khz", 4).alias("gap_khz"))


@query(
    f"""WITH {_PAIRS} SELECT pulse, a_track, b_track, ord::INT AS harmonic_order, common::INT AS common_frames, round(cover, 6) AS ratio_coverage, round(mad, 6) AS ratio_mad,
    round(CASE WHEN greatest(lows, highs) > 750 THEN cc END, 5) AS contour_correlation, round(ec, 5) AS envelope_correlation FROM t JOIN q USING (pulse, a_track, b_track)
    WHERE common >= 6 AND common / greatest(an, bn) >= 0.8 AND abs(af - bf) <= greatest(2, ceil(0.2 * greatest(al - af, bl - bf) + 0.2)) AND abs(al - bl) <= greatest(2, ceil(0.2 * greatest(al - af, bl - bf) + 0.2))
    AND ord BETWEEN 2 AND 6 AND cover >= 0.9 AND mad <= 0.015 AND (greatest(lows, highs) <= 750 OR (least(lows, highs) >= 375 AND coalesce(cc >= 0.8, false)))
    AND abs(mres) <= greatest(500, low * 0.015) AND p90 <= greatest(500, low * 0.015) AND least(asd, bsd) >= 1 AND coalesce(ec >= 0.75, false)"""
)
def harmonic_evidence(spark, sf):
    """Pairs of which the upper track is a harmonic of the lower."""
    x = separation.track_pairs(_track_points(spark, sf), ["pulse"]).filter("evidence is not null")
    e = {"harmonic_order": F.col("evidence.order"), "common_frames": F.col("evidence.common_frames")}
    e |= {c: F.round(f"evidence.{c}", d) for c, d in (("ratio_coverage", 6), ("ratio_mad", 6), ("contour_correlation", 5), ("envelope_correlation", 5))}
    return x.select("pulse", "a_track", "b_track", *(v.alias(k) for k, v in e.items()))


_EVIDENCE = """common >= 6 AND common / greatest(an, bn) >= 0.8 AND abs(af - bf) <= greatest(2, ceil(0.2 * greatest(al - af, bl - bf) + 0.2)) AND abs(al - bl) <= greatest(2, ceil(0.2 * greatest(al - af, bl - bf) + 0.2))
    AND ord BETWEEN 2 AND 6 AND cover >= 0.9 AND mad <= 0.015 AND (greatest(lows, highs) <= 750 OR (least(lows, highs) >= 375 AND coalesce(cc >= 0.8, false)))
    AND abs(mres) <= greatest(500, low * 0.015) AND p90 <= greatest(500, low * 0.015) AND least(asd, bsd) >= 1 AND coalesce(ec >= 0.75, false)"""
# Track by track from the lowest frequency on: st has the tracks so far, each with its family's anchor and its order there.
_FAMILIES = f"""{_PAIRS}, ev AS (SELECT pulse, a_track, b_track, ord::INT AS ord FROM t JOIN q USING (pulse, a_track, b_track) WHERE {_EVIDENCE}),
rk AS (SELECT *, row_number() OVER (PARTITION BY pulse ORDER BY median_hz, track) AS i FROM tt),
inp AS (SELECT rk.pulse, i, track, coalesce(list({{'low': a_track, 'ord': ord}}) FILTER (a_track IS NOT NULL), []) AS e FROM rk LEFT JOIN ev ON ev.pulse = rk.pulse AND b_track = track GROUP BY ALL),
st AS (SELECT pulse, i, [{{'track': track, 'anchor': track, 'ord': 0}}] AS s FROM inp WHERE i = 1
  UNION ALL SELECT st.pulse, st.i + 1, list_append(s, CASE WHEN len(c) = 1 AND len(list_filter(s, lambda x: x.anchor = c[1].low AND x.ord = c[1].ord)) = 0
    THEN {{'track': track, 'anchor': c[1].low, 'ord': c[1].ord}} ELSE {{'track': track, 'anchor': track, 'ord': 0}} END)
  FROM st JOIN inp ON inp.pulse = st.pulse AND inp.i = st.i + 1, LATERAL (SELECT list_filter(inp.e, lambda e: len(list_filter(s, lambda x: x.track = e.low AND x.anchor = x.track)) > 0) AS c) v),
fm AS (SELECT pulse, unnest(arg_max(s, i)) AS m FROM st GROUP BY pulse)"""


@query(f"WITH RECURSIVE {_FAMILIES} SELECT pulse, m.track AS track, m.anchor AS anchor, m.ord AS harmonic_order FROM fm")
def harmonic_families(spark, sf):
    """The family of each track, and its order there; 0 for an anchor."""
    points = _track_points(spark, sf)
    x = separation.families(separation.track_totals(points, ["pulse"]), separation.track_pairs(points, ["pulse"]), ["pulse"])
    return x.select("pulse", "track", "anchor", F.coalesce("evidence.order", F.lit(0)).alias("harmonic_order"))


@query(
    f"""WITH RECURSIVE {_FAMILIES}, f AS (SELECT fm.pulse, m.anchor AS anchor, sum(total_power) AS power, arg_max(tt.track, total_power) AS lead, min(median_hz) AS lowest, string_agg(tt.track, ',' ORDER BY median_hz, tt.track) AS members FROM fm JOIN tt ON tt.pulse = fm.pulse AND tt.track = m.track GROUP BY ALL),
    g AS (SELECT *, row_number() OVER (PARTITION BY pulse ORDER BY power DESC, lowest, anchor) AS i, count(*) OVER (PARTITION BY pulse) AS families, 10 * log10(power / max(power) OVER (PARTITION BY pulse)) AS db FROM f),
    w AS (SELECT pulse, a_track, b_track, common / least(an, bn) AS overlap, gap_khz, common >= 2 AND common / least(an, bn) >= 0.45 AND gap_khz >= 1.5 AND resolved >= 0.6 AS apart FROM t),
    b AS (SELECT pulse, a_track AS x, b_track AS y, overlap, gap_khz, apart FROM w UNION ALL SELECT pulse, b_track, a_track, overlap, gap_khz, apart FROM w),
    k AS (SELECT g.pulse, list({{'y': y, 'apart': apart}}) AS met, g.i, lead, db FROM g LEFT JOIN b ON b.pulse = g.pulse AND x = lead GROUP BY ALL),
    z AS (SELECT pulse, i, [lead] AS c FROM k WHERE i = 1
      UNION ALL SELECT z.pulse, z.i + 1, CASE WHEN len(c) < 3 AND db >= -18 AND len(list_filter(met, lambda m: m.apart AND list_contains(c, m.y))) = len(c) THEN list_append(c, lead) ELSE c END FROM z JOIN k ON k.pulse = z.pulse AND k.i = z.i + 1),
    h AS (SELECT pulse, arg_max(c, i) AS c FROM z GROUP BY pulse),
    n AS (SELECT g.*, list_position(c, lead) AS component_id, len(c) AS component_count, c[1] AS main FROM g JOIN h USING (pulse) WHERE list_contains(c, lead)),
    og AS (SELECT n.*, b.overlap, b.gap_khz FROM n LEFT JOIN b ON b.pulse = n.pulse AND b.x = lead AND b.y = main),
    u AS (SELECT *, CASE WHEN component_id = 1 THEN max(overlap) OVER (PARTITION BY pulse) ELSE overlap END AS ov, CASE WHEN component_id = 1 THEN min(gap_khz) OVER (PARTITION BY pulse) ELSE gap_khz END AS gk, CASE WHEN component_id = 1 THEN 0 ELSE db END AS d FROM og)
    SELECT pulse, component_id::INT AS component_id, component_count::INT AS component_count, CASE WHEN component_count > 1 OR families = 1 THEN members ELSE '' END AS members, round(CASE WHEN component_count > 1 THEN d ELSE 0 END, 5) AS track_relative_db,
      round(CASE WHEN component_count > 1 THEN least(1, 0.45 * least(1, ov) + 0.35 * least(1, gk / 3) + 0.2 * greatest(0, 1 + d / 18)) ELSE 1 END, 5) AS separation_confidence FROM u"""
)
def independent_sources(spark, sf):
    """The sources of each pulse."""
    p = _track_points(spark, sf).groupBy("pulse", "track").agg(F.array_sort(F.collect_list(F.struct("frame", "hz", "power"))).alias("p"))
    tracks = p.select("pulse", "track", F.col("p.frame").alias("frames"), F.col("p.hz").alias("hz"), F.col("p.power").alias("power"))
    x = separation.sources(tracks, ["pulse"])
    return x.select("pulse", "component_id", "component_count", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), F.round("track_relative_db", 5).alias("track_relative_db"), F.round("separation_confidence", 5).alias("separation_confidence"))


@query(f"WITH {_DESC} SELECT count(*)::BIGINT AS template_count, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(1.5 * max(duration_ms) + 10, 6) AS max_pulse_ms FROM e")
def template_totals(spark, sf):
    """A17, X4."""
    x = matching.template_totals(_descriptors(spark, sf))
    return x.select("template_count", F.array_join("labels", ",").alias("labels"), F.round("max_pulse_ms", 6).alias("max_pulse_ms"))


@query(f"WITH {_ORDERS} SELECT recording_key, o_orderkey FROM o QUALIFY row_number() OVER (PARTITION BY recording_key ORDER BY start_s, o_orderkey) <= 3")
def export_budget(spark, sf):
    """A budget of three."""
    return tables.within_budget(_orders(spark, sf), 3, order=("start_s", "o_orderkey")).select("recording_key", "o_orderkey")


@query("SELECT p_brand AS segment_id, p_brand || '/npulse' || p_partkey || '.png' AS path FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_size % 2 = 0")
def gallery(spark, sf):
    """Figures of one label whose file is there."""
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("segment_id"), F.col("p_type").alias("label"), "p_size", F.concat("p_brand", F.lit("/npulse"), "p_partkey", F.lit(".png")).alias("path"))
    label = p.agg(F.min("label")).first()[0]
    return review.gallery(p.select("segment_id", "label", "path"), p.filter("p_size % 2 = 0"), label).select("segment_id", "path")


@query(
    f"""WITH {_ORDERS}, d AS (SELECT DISTINCT o_orderkey AS pulse_key FROM o WHERE o_orderkey % 3 = 0), r AS (SELECT o_orderkey AS pulse_key FROM o WHERE snr_db > 200000)
    SELECT DISTINCT pulse_key, 'candidate' AS status FROM r ANTI JOIN d USING (pulse_key)"""
)
def review_moves(spark, sf):
    """Expensive orders become candidates; every third is one already."""
    o = _orders(spark, sf).withColumn("pulse_key", F.col("o_orderkey"))
    done = o.filter("o_orderkey % 3 = 0").select("pulse_key", F.lit("candidate").alias("status"), F.lit(1).alias("decided_at"))
    return review.move_to_candidates(o.filter("snr_db > 200000"), o, done, F.lit(2)).select("pulse_key", "status")


@query(
    """WITH n AS (SELECT p_partkey, (p_size * 37 + p_partkey % 11)::BIGINT AS n FROM part)
    SELECT p_partkey, greatest(128, least(1024, power(2, floor(log2(greatest(n, 1))))))::INT AS n_fft, greatest(8, floor(greatest(128, least(1024, power(2, floor(log2(greatest(n, 1)))))) / 16))::INT AS hop,
    greatest(256, least(1024, power(2, floor(log2(greatest(n / 3, 1))))))::INT AS separation_window FROM n"""
)
def stft_sizes(spark, sf):
    """windows for pieces of as many samples as a part's size tells."""
    x = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 37 + F.col("p_partkey") % 11).cast("long").alias("n"))
    return x.select("p_partkey", S.stft_size(F.col("n"), 1024, 128, 8).alias("s"), F.greatest(F.lit(256), S.separation_window(F.col("n"), "adaptive")).alias("separation_window")).select("p_partkey", "s.n_fft", "s.hop", "separation_window")


@query(
    """SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, 0.45 * least(1, l_discount::DOUBLE * 10) + 0.35 * least(1, l_quantity::DOUBLE / 50 / 6 * 5) + 0.2 * least(1, greatest(0, 1 - l_tax::DOUBLE * 250 / 18)))), 6) AS confidence,
    round(greatest(0, l_quantity::DOUBLE - l_tax::DOUBLE * 250), 6) AS snr_db, abs(greatest(l_quantity::DOUBLE / 10, 10 / l_quantity::DOUBLE) - 2) / 2 <= 0.06 OR abs(greatest(l_quantity::DOUBLE / 10, 10 / l_quantity::DOUBLE) - 3) / 3 <= 0.06 AS harmonic,
    round(120000 - least(1, greatest(0, (l_quantity::DOUBLE - 2) / 40)) * 105000, 4) AS hz FROM lineitem"""
)
def source_measures(spark, sf):
    """F17, F19, F21, F23."""
    x = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax")))
    db = -F.col("tax") * 250
    return x.select(
        "l_orderkey", "l_linenumber", F.round(S.separation_confidence(F.col("discount") * 10, F.col("quantity") / 50 * 5 / 2, db), 6).alias("confidence"), F.round(S.relative_snr(F.col("quantity"), db), 6).alias("snr_db"),
        S.is_harmonic(F.col("quantity") / 10).alias("harmonic"), F.round(S.pixel_to_hz(F.col("quantity"), F.lit(2.0), F.lit(40.0), F.lit(15000.0), F.lit(120000.0)), 4).alias("hz"),
    )


@query("SELECT p_partkey, sha256('{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}') AS fingerprint FROM part")
def model_fingerprint(spark, sf):
    """F7."""
    return _t(spark, sf, "part").select("p_partkey", S.fingerprint("p_partkey", "p_size").alias("fingerprint"))


# Time warping by diagonals of the cells: c1, l1 are costs and lengths of the last diagonal by row, c2, l2 of the one before. Cells off the band cost 1e300.
_DTW = _MATCH.split(",\nm AS", 1)[0] + """, a AS (SELECT vec_id AS i, embedding[33:64]::DOUBLE[] AS x FROM embeddings),
pr AS (SELECT q.vec_id AS q, t.vec_id AS t, list_transform(q1.x, lambda v: v * 10) AS x, list_transform(t1.x, lambda v: v * 10) AS y FROM e q, t, a q1, a t1 WHERE q.vec_id % 10 <> 0 AND q1.i = q.vec_id AND t1.i = t.vec_id),
st AS (SELECT q, t, x, y, 1 AS d, list_transform(range(33), lambda i: 1e300) AS c1, list_transform(range(33), lambda i: 0.0::DOUBLE) AS l1, list_transform(range(33), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE 1e300 END) AS c2, list_transform(range(33), lambda i: 0.0::DOUBLE) AS l2 FROM pr
UNION ALL SELECT q, t, x, y, d + 1,
  list_transform(range(33), lambda i: CASE WHEN i < 1 OR d + 1 - i < 1 OR d + 1 - i > 32 OR abs(d + 1 - 2 * i) > 4 THEN 1e300 ELSE abs(x[i] - y[d + 1 - i]) + least(c2[i], c1[i], c1[i + 1]) END),
  list_transform(range(33), lambda i: CASE WHEN i < 1 OR d + 1 - i < 1 OR d + 1 - i > 32 OR abs(d + 1 - 2 * i) > 4 THEN 0.0 WHEN c2[i] <= c1[i] AND c2[i] <= c1[i + 1] THEN l2[i] + 1 WHEN c1[i] <= c1[i + 1] THEN l1[i] + 1 ELSE l1[i + 1] + 1 END),
  c1, l1 FROM st WHERE d < 64),
w AS (SELECT q AS vec_id, t AS ord, c1[33] / l1[33] AS far FROM st WHERE d = 64),
m AS (SELECT q.vec_id, t.label, t.ord, 0.5 * """ + _SIM + """ + 0.5 * exp(-w.far / 6) AS score FROM e q JOIN w ON w.vec_id = q.vec_id JOIN t ON t.vec_id = w.ord JOIN sc ON sc.label = t.label),
b AS (SELECT vec_id, label AS template_label, score FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, ord) = 1)"""
SQL["dtw_similarity"] = _DTW.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT vec_id, template_label, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN template_label ELSE 'unknown' END AS predicted_label FROM b"


@query("SELECT event_id, strftime(ts::TIMESTAMP, '%Y%m%d_%H%M%S') AS time_name, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def time_names(spark, sf):
    """F27."""
    at = F.col("ts").cast("timestamp")
    return _t(spark, sf, "events").select("event_id", S.time_name(at).alias("time_name"), S.iso_time(at).alias("iso"))
