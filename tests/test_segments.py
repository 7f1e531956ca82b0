"""Recordings with known pulses through the whole analysis."""

import pytest
import sounds as S

from pulselake.config import SegmentConfig
from pulselake.plans import segments
from pulselake.sources import recordings as R


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    S.write(root / "templates/CF1_47K1.wav", S.recording(0.02, [(0.01, S.tone(47))]))
    S.write(root / "templates/CF1_47K2.wav", S.recording(0.02, [(0.01, S.tone(47.5))]))
    S.write(root / "templates/FM1_60K1.wav", S.recording(0.02, [(0.01, S.tone(90, 8, to_khz=40))]))
    rec = root / "rec"
    S.write(rec / "cf47_x5.wav", S.recording(12, [(t, S.tone(47)) for t in (1, 3, 5, 7, 11)], 1e-4))
    S.write(rec / "fm_sweep.wav", S.recording(3, [(1.5, S.tone(90, 8, to_khz=40))], 1e-4))
    S.write(rec / "edge_exact.wav", S.recording(12, [(10.0, S.tone(47))]))
    S.write(rec / "sub/silent.WAV", S.recording(12, []))
    S.write(rec / "two_tones.wav", S.recording(2, [(1.0, S.tone(47, 10) + S.tone(67, 10, 0.4))], 1e-4))
    (rec / "stereo.wav").write_bytes(S.stereo(S.recording(2, [(1.0, S.tone(47))], 1e-4)))
    (rec / "corrupt.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVEfmt ")
    (rec / "empty.wav").write_bytes(b"")
    templates, errors = segments.template_table(spark, str(root / "templates"))
    a = segments.analyze(spark, str(rec), templates)
    pulses = a.pulses.persist()
    return root, segments.Analysis(a.recordings, a.metrics, pulses, a.labels, a.config), {r.segment_id: r for r in a.summary().collect()}, templates


def test_templates(run):
    assert {(r.label, round(r.peak_freq_khz)) for r in run[3].collect()} >= {("CF1_47K", 47)}
    assert run[1].labels == ["CF1_47K", "FM1_60K"]


def test_known_calls(run):
    s = run[2]
    assert s["cf47_x5"].CF1_47K == 5 and s["cf47_x5"].total_calls == 5 and s["cf47_x5"].major_label == "CF1_47K"
    assert s["fm_sweep"].total_calls == 1 and s["fm_sweep"].FM1_60K == 1
    assert s["edge_exact"].total_calls == 1
    assert s["stereo"].CF1_47K == 1
    assert s["cf47_x5"].calls_per_second == pytest.approx(5 / 12)


def test_silence_is_skipped_but_monitored(run):
    s = run[2]["silent"]
    assert s.total_calls == 0 and s.fast_skipped_chunk_count == 2 and s.valid_monitoring_duration_s == 12.0


def test_broken_files_fail_alone(run):
    for name in ("corrupt", "empty"):
        assert run[2][name].processing_status == "failed" and run[2][name].error_message
    t = run[1].totals().collect()[0]
    assert t.failed_count == 2 and t.success_count == 6 and t.status == "partial_failure"


def test_times_and_features(run):
    found = sorted(run[1].pulses.filter("segment_id = 'cf47_x5'").collect(), key=lambda r: r.start_s)
    for r, at in zip(found, (1, 3, 5, 7, 11)):
        assert abs((r.start_s + r.end_s) / 2 - at) < 0.002 and abs(r.peak_freq_khz - 47) < 1
    assert [r.pulse_id for r in found] == [f"p{i:03d}" for i in range(1, 6)]
    fm = run[1].pulses.filter("segment_id = 'fm_sweep'").collect()[0]
    assert fm.frequency_drop_khz > 0 and fm.slope_khz_per_ms < 0


def test_two_sources(run):
    found = sorted(run[1].pulses.filter("segment_id = 'two_tones'").collect(), key=lambda r: r.component_id)
    assert [round(r.track_median_freq_khz) for r in found] == [47, 67]
    assert len({r.event_id for r in found}) == 1 and all(r.separation_applied for r in found)
    assert [round(r.peak_freq_khz) for r in found] == [47, 67]


def test_overall(run):
    o = {r.species: r for r in run[1].overall().collect()}
    assert o["CF1_47K"].call_count >= 7 and o["FM1_60K"].segment_count >= 1


def test_missing_root(spark, tmp_path):
    assert R.wav_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        R.require_recordings(spark, str(tmp_path))


def test_config_is_checked():
    with pytest.raises(ValueError):
        SegmentConfig(overlap_seconds=0.1)
    with pytest.raises(ValueError):
        SegmentConfig(harmonic_mode="other")
