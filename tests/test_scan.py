"""The low-similarity scan from recordings to exported files."""

import pytest
import sounds as S
from pyspark.sql import functions as F

from pulselake.functions.signal import wav_header
from pulselake.plans import scan, segments
from pulselake.sinks import tables


def test_scan_exports_what_no_template_resembles(spark, tmp_path):
    S.write(tmp_path / "templates/CF1_47K1.wav", S.recording(0.02, [(0.01, S.tone(47))]))
    S.write(tmp_path / "rec/mixed.wav", S.recording(2, [(0.5, S.tone(47)), (1.0, S.tone(100, 3)), (1.5, S.tone(47, 10) + S.tone(75, 10, 0.4))], 1e-4))
    templates, errors = segments.template_table(spark, str(tmp_path / "templates"))
    assert errors.count() == 0
    low, totals = scan.scan(spark, str(tmp_path / "rec"), templates, 0.2)
    out = tables.write_pulse_audio(low, str(tmp_path / "out"), F.col("pulse_file")).select(*scan.COLUMNS).orderBy("start_s").collect()
    assert [r.template_filename for r in out] == ["npulse000001.wav", "npulse000002.wav"]
    assert [round(r.peak_freq_khz / 5) * 5 for r in out] == [100, 75] and [r.separation_applied for r in out] == [False, True]
    t = totals.first()
    assert (t.selected_pulse_count, t.total_calls, t.status) == (2, 4, "success")
    for r in out:
        data = (tmp_path / "out" / r.pulse_file).read_bytes()
        assert wav_header(data, len(data))["frames"] == pytest.approx(r.duration_ms * 250, abs=1) and r.audio_export_error == ""
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            scan.check_threshold(bad)
