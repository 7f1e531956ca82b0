"""Operators on small frames whose results are plain to see; edges and quirks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.functions import scalars as S
from pulselake.operators import frames, intervals, matching, reports, review, separation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "stem,want",
    [("CF1_47K1", "CF1_47K"), ("CFFM1_67K08", "CFFM1_67K"), ("npulse000001", "noise pulse"), ("NPULSE7", "noise pulse"), ("p12", "可疑声波"), ("CF2_35.5K_4", "CF2_35.5K"), ("CF2_35.5K-4", "CF2_35.5K"), ("recording_2024", "recording_2024")],
)
def test_class_names(spark, stem, want):
    assert one(spark, S.class_from_stem(F.lit(stem))) == want


def test_scalars(spark):
    assert one(spark, S.overlap_ratio(*map(F.lit, (0.0, 2.0, 1.0, 5.0)))) == 0.5
    assert one(spark, S.overlap_ratio(*map(F.lit, (0.0, 0.0, 0.0, 5.0)))) == 0.0
    assert [one(spark, S.is_harmonic(F.lit(r))) for r in (2.1, 2.2, 0.5, 3.1, 1.0)] == [True, False, True, True, False]
    assert one(spark, S.stft_size(F.lit(1300), 256, 64, 4)) == (256, 16) and one(spark, S.stft_size(F.lit(100), 256, 64, 4)) == (64, 4)
    assert one(spark, S.candidate_name(F.lit("npulse000003.wav"))) == "pulse000003.wav"


def test_smoothing_pads_with_zeros(spark):
    x = spark.createDataFrame([("a", i, -10.0) for i in range(6)] + [("b", i, -10.0) for i in range(4)], "k string, i int, v double")
    got = {(r.k, r.i): r.smooth_db for r in frames.smooth(x, ["k"], ["i"], "v").collect()}
    assert [got["a", i] for i in range(6)] == [-6, -8, -10, -10, -8, -6] and got["b", 0] == -10


def test_gaps_of_just_the_limit(spark):
    x = spark.createDataFrame([("a", i) for i in (1, 2, 4, 7, 11)], "k string, frame int")
    got = sorted((r.first_frame, r.last_frame, r.n) for r in frames.merge_gaps(x, ["k"], "frame", 2).collect())
    assert got == [(1, 7, 4), (11, 11, 1)]


def test_ownership_is_half_open(spark):
    x = spark.createDataFrame([(9.99, 10.01)], "a double, b double")
    low, high = (x.filter(intervals.owned(F.col("a"), F.col("b"), F.lit(s), F.lit(e))).count() for s, e in ((0.0, 10.0), (10.0, 20.0)))
    assert (low, high) == (0, 1)


def slow_fold(pulses, overlap):
    kept = []
    for p in sorted(pulses):
        if kept:
            a = kept[-1]
            shorter = min(a[1] - a[0], p[1] - p[0])
            if shorter > 0 and max(0, min(a[1], p[1]) - max(a[0], p[0])) / shorter >= overlap:
                kept[-1] = p if p[2] > a[2] else a
                continue
        kept.append(p)
    return kept


def test_greedy_fold_and_cross_chunk_rule(spark):
    r = np.random.default_rng(4)
    rows = [(k, *sorted(r.uniform(0, 10, 2).round(3).tolist()), float(r.integers(0, 9)), f"{k}-{i}") for k in range(5) for i in range(30)]
    x = spark.createDataFrame(rows, "k int, start_s double, end_s double, snr_db double, name string")
    got = intervals.greedy_dedup(x, ["k"], extra=("name",)).collect()
    for k in range(5):
        assert sorted((g.start_s, g.end_s, g.snr_db, g.name) for g in got if g.k == k) == slow_fold([row[1:] for row in rows if row[0] == k], 0.6)
    assert intervals.greedy_dedup(x.limit(0), ["k"]).count() == 0
    run = [(1, i / 10, i / 10 + 1 + i % 3, float(i * 7 % 11)) for i in range(25_000)]  # overlaps all along, over several batches
    got = intervals.greedy_dedup(spark.createDataFrame(run, "k int, start_s double, end_s double, snr_db double"), ["k"]).collect()
    assert sorted(tuple(g)[1:] for g in got) == slow_fold([row[1:] for row in run], 0.6)
    odd = spark.createDataFrame([(None, 0.0, 1.0, 5.0), (None, 0.1, 1.0, None), (1, 0.0, 1.0, 1.0), (1, None, 1.0, 9.0)], "k int, start_s double, end_s double, snr_db double")
    assert sorted(tuple(g) for g in intervals.greedy_dedup(odd, ["k"]).na.fill(-1).collect()) == [(-1, 0.0, 1.0, 5.0), (1, -1.0, 1.0, 9.0), (1, 0.0, 1.0, 1.0)]
    p = [("r", int(c), float(a), float(a + w)) for c, a, w in zip(r.integers(0, 4, 120), r.uniform(0, 20, 120).round(3), r.uniform(0.001, 2, 120).round(3))]
    got = intervals.drop_repeats_across_chunks(spark.createDataFrame(p, "recording_key string, chunk_index int, start_s double, end_s double"), tail=None).collect()

    def same(a, b):
        shorter = min(a[3] - a[2], b[3] - b[2])
        return max(0, min(a[3], b[3]) - max(a[2], b[2])) / shorter >= 0.5 or abs((a[2] + a[3]) / 2 - (b[2] + b[3]) / 2) <= 0.0015

    want = [b for b in p if not any(a[1] == b[1] - 1 and same(a, b) for a in p)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_numbers_run_over_all_partitions(spark):
    x = spark.range(500).select("id", (F.col("id") % 7 / 10).alias("confidence")).repartition(9)
    got = matching.low_similarity(x, ["id"], 0.2).orderBy("id").collect()
    assert [r.pulse_file for r in got] == [f"npulse{i + 1:06d}.wav" for i in range(len(got))] and all(r.confidence < 0.2 for r in got)


def test_numbers_are_unique_over_many_rows(spark, tmp_path):
    """A million rows with a payload and many ties, whose partitions adaptive execution joins as it likes."""
    n = 1_000_000
    x = spark.range(n, numPartitions=20).select("id", (F.col("id") % 1000).alias("tie"), F.repeat(F.lit("x"), 50).alias("payload"), F.lit(0.1).alias("confidence"))
    matching.low_similarity(x, ["tie"], 0.2).write.parquet(str(tmp_path / "low"))
    got = spark.read.parquet(str(tmp_path / "low"))
    assert got.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number"), F.count_distinct("pulse_file")).first()[:] == (n, n, 1, n, n)
    ordered = got.groupBy("tie").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    assert ordered.filter("lo != tie * 1000 + 1 or hi != tie * 1000 + 1000").count() == 0


def test_ties_go_to_the_first_template_and_bad_values_to_none(spark):
    t = spark.createDataFrame([("b", "b1", 0, 5.0), ("a", "a1", 1, 5.0)], "label string, file string, ord int, duration_ms double")
    p = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, 900.0)], "pulse_key int, duration_ms double")
    got = {r.pulse_key: r for r in matching.best_matches(p, t, ("duration_ms",)).collect()}
    assert got[1].template_label == "b" and got[1].confidence == 1.0
    assert [got[k].predicted_label for k in (1, 2, 3, 4)] == ["b", "unknown", "unknown", "unknown"] and got[2].template_label is None


def test_totals_are_kept_whole(spark):
    p = spark.createDataFrame([("r", "x", 0.9), ("r", "y", 0.8), ("r", "other", 0.1), ("s", "unknown", 0.2)], "k string, l string, c double")
    counts = reports.label_counts(p, "k", "l", ["x", "y"])
    assert counts.count() == 6 and counts.agg(F.sum("n")).first()[0] == 4
    assert reports.majority(counts, "k").filter("k = 'r'").first()[1:] == ("x", 2, 0.5, "")
    assert reports.majority(counts, "k").filter("k = 's'").first().major_label == ""
    assert reports.accumulate(p, "k", "l", ["x", "y"], "c").filter("k = 'r'").first().prediction_confidence == pytest.approx(0.85)


def test_review(spark):
    pulses = spark.createDataFrame([(i, f"npulse{i:06d}.wav") for i in range(4)], "pulse_key int, pulse_file string")
    done = spark.createDataFrame([(1, "candidate", 1), (2, "candidate", 1), (2, "unselected", 2)], "pulse_key int, status string, decided_at int")
    new = review.move_to_candidates(pulses.filter("pulse_key in (1, 3)"), pulses, done, 3)
    assert [tuple(r) for r in new.collect()] == [(3, "candidate", 3)]
    got = {r.pulse_key: (r.review_status, r.pulse_file) for r in review.review_view(pulses, done.union(new)).collect()}
    assert got == {0: ("unselected", "npulse000000.wav"), 1: ("candidate", "pulse000001.wav"), 2: ("unselected", "npulse000002.wav"), 3: ("candidate", "pulse000003.wav")}
    with pytest.raises(ValueError):
        review.move_to_candidates(spark.createDataFrame([(9,)], "pulse_key int"), pulses, done, 3)


def track(k, hz, level, first=0):
    return (1, k, list(range(first, first + len(hz))), [float(h) for h in hz], [float(p) for p in level])


def test_harmonics_and_independent_sources(spark):
    """A sweep, its octave with the same envelope, and another call: the octave joins its family, the other is a source."""
    n = 60
    sweep = np.linspace(40_000, 30_000, n)
    shape = np.hanning(n) ** 2 * 50 + 1
    other = np.full(n, 55_000.0)
    rows = [track(0, sweep, shape * 4), track(1, 2 * sweep, shape), track(2, other, shape[::-1] * 2 + 3 * np.sin(np.arange(n)) ** 2)]
    t = spark.createDataFrame(rows, "p int, track int, frames array<int>, hz array<double>, power array<double>")
    pairs = {(r.a_track, r.b_track): r for r in separation.track_pairs(separation.track_points(t, ["p"]), ["p"]).collect()}
    e = pairs[0, 1].evidence
    assert e.order == 2 and e.common_frames == n and e.envelope_correlation == pytest.approx(1) and e.contour_correlation == pytest.approx(1)
    assert pairs[0, 2].evidence is None and pairs[0, 2].independent and pairs[0, 1].basic_harmonic
    got = sorted(separation.sources(t, ["p"], "enhanced").collect(), key=lambda r: r.component_id)
    assert [r.members for r in got] == [[0, 1], [2]] and got[0].component_count == 2
    basic = sorted(separation.sources(t, ["p"], "basic").collect(), key=lambda r: r.component_id)
    assert [r.members for r in basic] == [[0], [2]]


@pytest.mark.parametrize("change", ["few", "late", "ratio", "flat", "envelope"])
def test_each_gate_of_the_evidence(spark, change):
    n = 60
    sweep, shape = np.linspace(40_000, 30_000, n), np.hanning(n) * 50 + 1
    low, high, a, b = sweep, 2 * sweep, shape, shape
    first = 0
    if change == "few":
        low, high, a, b = (x[:5] for x in (low, high, a, b))
    elif change == "late":
        first = 20
    elif change == "ratio":
        high = 2.2 * sweep
    elif change == "flat":
        a, b = np.full(n, 3.0), np.full(n, 2.0)
    else:
        b = 30 + 25 * np.sin(0.9 * np.arange(n))  # its level moves, but not with the other
    t = spark.createDataFrame([track(0, low, a), track(1, high, b, first)], "p int, track int, frames array<int>, hz array<double>, power array<double>")
    assert all(r.evidence is None for r in separation.track_pairs(separation.track_points(t, ["p"]), ["p"]).collect())


def test_one_family_is_not_split(spark):
    n = 60
    sweep, shape = np.linspace(40_000, 30_000, n), np.hanning(n) * 50 + 1
    t = spark.createDataFrame([track(0, sweep, shape), track(1, 2 * sweep, shape / 2)], "p int, track int, frames array<int>, hz array<double>, power array<double>")
    got = separation.sources(t, ["p"], "enhanced").collect()
    assert len(got) == 1 and got[0].component_count == 1 and got[0].members == [0, 1]


def test_dtw_column(spark):
    x = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), (None, [1.0]), ([], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in x.select(matching.dtw("a", "b")).collect()] == [0.0, None, None]


@pytest.mark.parametrize("seed", range(3))
def test_families_against_the_rule(spark, seed):
    """Random evidence between the tracks of many pulses, told track by track from the lowest on."""
    import random

    r = random.Random(seed)
    totals, pairs, want = [], [], {}
    for p in range(60):
        n = r.randrange(2, 12)
        hz = [float(r.randrange(1, 6)) for _ in range(n)]
        totals += [(p, k, hz[k]) for k in range(n)]
        low = sorted(range(n), key=lambda k: (hz[k], k))
        found = {}
        for i, b in enumerate(low):
            for a in low[:i]:
                if r.random() < 0.4:
                    found[a, b] = r.randrange(2, 4)
                pairs.append((p, a, b, (found[a, b],) if (a, b) in found else None))
        anchor, order = {}, {}
        for b in low:
            may = [a for a in low if anchor.get(a) == a and (a, b) in found]
            free = len(may) == 1 and not any(anchor[x] == may[0] and order[x] == found[may[0], b] for x in anchor)
            anchor[b], order[b] = (may[0], found[may[0], b]) if free else (b, 0)
        want |= {(p, b): (anchor[b], order[b]) for b in low}
    t = spark.createDataFrame(totals, "p int, track int, median_hz double")
    e = spark.createDataFrame(pairs, "p int, a_track int, b_track int, evidence struct<order: int>")
    got = {(x.p, x.track): (x.anchor, x.evidence.order if x.evidence else 0) for x in separation.families(t, e, ["p"]).collect()}
    assert got == want and len({v[1] for v in want.values()}) == 3


def test_windows_of_sources(spark):
    n = spark.createDataFrame([(k,) for k in (100, 256, 900, 1600, 9000)], "n long")
    assert [r[0] for r in n.select(S.separation_window(F.col("n"), "adaptive")).collect()] == [100, 256, 256, 512, 1024]
    assert [r[0] for r in n.select(S.separation_window(F.col("n"))).collect()] == [100, 256, 256, 256, 256]


def test_bounds_lose_no_match(spark):
    """The best of warping every pair, with tracks of several lengths, without tracks, and ties; and fewer pairs warped."""
    r = np.random.default_rng(3)
    shapes = [np.cumsum(r.normal(0, 1.5, 32)) + 50 for _ in range(12)]
    of = lambda k: [None, [], (shapes[k % 12][:20] + r.normal(0, 0.3, 20)).tolist()][k % 9] if k % 9 < 3 else (shapes[k % 12] + r.normal(0, 0.3, 32)).tolist()
    t = [("x" if k % 2 else "y", f"f{k}", k, float(k % 7), of(k)) for k in range(60)]
    t += [(*t[5][:2], 60, *t[5][3:])]
    p = [(k, float(k % 7) + 0.2, of(k + 3)) for k in range(80)] + [(80, t[5][3], t[5][4])]
    templates = spark.createDataFrame(t, "label string, file string, ord int, duration_ms double, track array<double>")
    pulses = spark.createDataFrame(p, "pulse_key int, duration_ms double, track array<double>")
    scales = {x.label: x.scale_duration_ms for x in matching.group_scales(templates, ("duration_ms",)).collect()}
    got = {x.pulse_key: x for x in matching.best_matches(pulses, templates, ("duration_ms",), "track", with_count=True).collect()}
    for key, value, track_ in p:
        best = None
        for label, file, ord_, v, other in t:
            s = np.exp(-abs(value - v) / scales[label])
            if track_ and other:
                s = 0.5 * s + 0.5 * np.exp(-matching.dtw_distances(np.array([track_]), np.array([other]))[0] / 6)
            if best is None or s > best[0] + 1e-12:
                best = s, file
        assert got[key].confidence == pytest.approx(best[0], abs=1e-12) and got[key].template_file == best[1], key
    assert got[80].template_file == "f5" and 0 < sum(x.n_warped for x in got.values()) < 0.7 * len(p) * len(t)
    a, b = r.normal(0, 3, (40, 32)), r.normal(0, 3, (30, 27))
    bound = matching.dtw_bounds(a, b)
    assert all(bound[i, j] <= matching.dtw_distances(a[i : i + 1], b[j : j + 1])[0] + 1e-12 for i in range(40) for j in range(30))


def test_products_find_what_pairs_find(spark):
    """Features alone: ties, copies, values far off zero, scores that round to 0 and templates that are not finite, against every pair; no pair of a pulse and a template is a row."""
    r = np.random.default_rng(5)
    names = ("duration_ms", "peak_freq_khz")
    t = [(f"c{k % 3}", f"f{k}", k, *(1e5 + r.normal(0, 9, 2)).tolist()) for k in range(300)]
    t += [(*t[7][:2], 300, *t[7][3:]), ("c1", "f301", 301, float("nan"), 1.0)]
    p = [(k, *(1e5 + r.normal(0, 9, 2)).tolist()) for k in range(400)] + [(400, *t[7][3:]), (401, 1e9, 1e9), (402, 1e5 + 1470.0, 1e5)]
    templates = spark.createDataFrame(t[:-1], "label string, file string, ord long, duration_ms double, peak_freq_khz double")
    pulses = spark.createDataFrame(p, "pulse_key int, duration_ms double, peak_freq_khz double")
    s = {x.label: x for x in matching.group_scales(templates, names).collect()}
    pairs = pulses.withColumnsRenamed({f: f"p_{f}" for f in names}).crossJoin(templates).join(spark.createDataFrame(list(s.values())), "label")
    score = S.feature_similarity({f: F.col(f"p_{f}") for f in names}, {f: F.col(f) for f in names}, {f: F.col(f"scale_{f}") for f in names})
    want = {x.pulse_key: x.m for x in pairs.withColumn("score", score).groupBy("pulse_key").agg(F.min_by(F.struct("file", "score"), F.struct(-F.col("score"), F.col("ord"))).alias("m")).collect()}
    found = matching.best_matches(pulses, templates, names)
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    got = {x.pulse_key: x for x in found.collect()}
    assert all(got[k].template_file == m.file and got[k].confidence == pytest.approx(m.score, rel=1e-12, abs=0) for k, m in want.items())
    assert got[400].template_file == "f7" and (got[401].template_file, got[401].confidence) == ("f0", 0.0) and 0 < got[402].confidence < 1e-9
    odd = spark.createDataFrame(t[-1:] + t[:1], templates.schema)
    assert {x.template_file for x in matching.best_matches(pulses, odd, names).collect()} == {"f0"}


def test_least_costs_rule_pairs_out():
    """A floor never lies above the distance, nor far off a path's least cost, so few of many unlike pairs are warped with their paths' lengths."""
    r = np.random.default_rng(8)
    for wide, shift, n, m in ((1.7, 0.0, 32, 32), (3.0, 5e4, 32, 27), (0.0, 7.0, 5, 9), (1.0, 0.0, 1, 1)):
        a, b = r.normal(shift, wide, (200, n)), r.normal(shift, wide, (200, m))
        floor, far = matching.dtw_floors(a, b), matching.dtw_distances(a, b)
        assert (floor <= far + 1e-12).all() and (wide != 1.7 or (floor > 0.5 * far).all())
    rows = [{"label": "a", "file": f"f{k}", "ord": k, "duration_ms": v, "scale_duration_ms": 2.0, "track": r.normal(0, 17, 32).tolist()} for k, v in enumerate(r.normal(0, 0.5, 900))]
    x, tracks = r.normal(0, 0.5, (30, 1)), list(r.normal(0, 17, (30, 32)))
    library = matching.Library(rows, ("duration_ms",), "track")
    at, score, warped = matching.warped_best(library, x, tracks)
    for i in range(30):
        every = 0.5 * library.similarity(np.repeat(x[i : i + 1], 900, 0), np.arange(900)) + 0.5 * np.exp(-matching.dtw_distances(np.repeat(tracks[i][None], 900, 0), library.tracks[32][1]) / 6)
        assert at[i] == every.argmax() and score[i] == pytest.approx(every.max(), abs=1e-14)
    assert warped.mean() < 250


def test_snr_ranks_values(spark):
    """Medians and the 20th percentile as Spark's own, with ties, nulls and islands that have nothing outside or only nulls."""
    r = np.random.default_rng(9)
    rows = [(g, k, None if k % 11 == 3 else float(r.integers(-9, 9)), g % 3 == 0 or k < g) for g in range(40) for k in range(g + 1)] + [(90, 0, None, True), (91, 0, None, False), (91, 1, 2.0, True), (92, 0, 4.0, None), (92, 1, 9.0, True)]
    x = spark.createDataFrame(rows, "g int, k int, v double, inside boolean")
    side = F.col("inside")
    want = x.groupBy("g").agg((F.median(F.when(side, F.col("v"))) - F.coalesce(F.median(F.when(~side, F.col("v"))), F.percentile("v", F.lit(0.2)))).alias("snr_db"))
    found = frames.island_snr(x, ["g"], "v", side)
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got, want = ({a.g: a.snr_db for a in y.collect()} for y in (found, want))
    assert got.keys() == want.keys() and all(got[g] == (None if w is None else pytest.approx(w, abs=1e-12)) for g, w in want.items())


def test_snr_broadcasts_no_frames(spark, sf):
    """Islands are small, the frames that they are spread to are not, which a plan doesn't see."""
    import re

    from pulselake.queries import QUERIES

    found = QUERIES["pulse_snr"](spark, sf)
    found.collect()
    joins = re.findall(r"(\w+Join)\S* \[user_id#\w+, frame#\w+\]", found._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
