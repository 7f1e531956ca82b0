"""Overviews of a recording and what review shows of a run."""

import numpy as np
import pytest
import sounds as S

from pulselake.config import SAMPLE_RATE
from pulselake.functions import signal
from pulselake.operators import matching, review
from pulselake.plans import overviews, segments
from pulselake.sources import recordings as R
from pulselake.storage import checkpoint


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("overview")
    S.write(root / "a.wav", S.recording(12, [(t, S.tone(47, 20)) for t in (2, 10)], 1e-4))
    return root, checkpoint(segments.chunk_rows(R.recording_stats(R.recordings(spark, str(root)))))


def test_spectrogram_and_envelope(chunks):
    cells = checkpoint(overviews.spectrogram(chunks[1]))
    hop = 12 * SAMPLE_RATE // 4000
    assert cells.selectExpr("max(time_bin)").first()[0] <= 4001 and cells.select("time_bin", "bin").distinct().count() == cells.count()
    top = cells.orderBy("value", ascending=False).first()
    assert abs(top.bin * SAMPLE_RATE / 1024 - 47_000) < 500 and min(abs(top.time_bin * hop / SAMPLE_RATE - t) for t in (2, 10)) < 0.02
    e = {r.time_bin: r.envelope for r in overviews.band_envelope(cells).collect()}
    assert max(e.values()) == 1 and e[int(5 * SAMPLE_RATE / hop)] < 0.01 and e[round(10 * SAMPLE_RATE / hop)] > 0.3


def test_waveform_keeps_both_extremes(chunks):
    rows = overviews.waveform(chunks[1], 500).collect()
    raw = R.wav_samples((chunks[0] / "a.wav").read_bytes()[44:], {"code": 1, "bits": 16, "channels": 1})
    y = signal.highpass(raw - raw.mean())
    width = 12 * SAMPLE_RATE // 500
    by = {}
    for r in rows:
        by.setdefault(r.bucket, []).append((r.at, r.value))
    assert len(by) == 500 and all(1 <= len(v) <= 2 for v in by.values())
    loud = np.abs(y).argmax() // width
    part = y[loud * width : (loud + 1) * width]
    assert sorted(at for at, _ in by[loud]) == sorted({loud * width + part.argmin(), loud * width + part.argmax()})


def test_gallery_and_labels(spark):
    f = spark.createDataFrame([("s1", "A", "x/p10.png"), ("s1", "A", "x/p9.png"), ("s2", "A", "x/p1.png"), ("s1", "B", "x/p2.png"), ("s1", "A", "x/gone1.png")], "segment_id string, label string, path string")
    files = spark.createDataFrame([("x/p10.png",), ("x/p9.png",), ("x/p1.png",), ("x/p2.png",)], "path string")
    assert [r.path for r in review.gallery(f, files, "A").collect()] == ["x/p9.png", "x/p10.png", "x/p1.png"]
    assert [r.path for r in review.gallery(f, files, "A", "s2").collect()] == ["x/p1.png"]
    assert review.label_list(["B"], f) == ["B", "unknown", "A"]
    t = matching.template_totals(spark.createDataFrame([("a", 4.0), ("b", 6.0), ("a", 2.0)], "label string, duration_ms double")).first()
    assert (t.template_count, t.labels, t.max_pulse_ms) == (3, ["a", "b"], 19.0)
