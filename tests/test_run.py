"""A run from recordings to files: stopped, resumed, and guarded."""

import csv
import json

import pytest
import sounds as S

from pulselake.config import SegmentConfig
from pulselake.plans import run as R
from pulselake.plans import segments
from pulselake.sinks import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    S.write(root / "templates/CF1_47K1.wav", S.recording(0.02, [(0.01, S.tone(47))]))
    for i, at in enumerate(([0.5, 1.5], [1.0], [])):
        S.write(root / f"rec/r{i}.wav", S.recording(2, [(t, S.tone(47)) for t in at], 1e-4))
    (root / "rec/empty.wav").write_bytes(b"")
    templates, _ = segments.template_table(spark, str(root / "templates"))
    return root, templates.persist()


def test_run_stops_and_goes_on(spark, folder):
    root, templates = folder
    rec, out = str(root / "rec"), str(root / "out")
    seen = []
    assert R.run(spark, rec, templates, out, step_files=1, should_stop=lambda: True, on_step=lambda a, b: seen.append((a, b))) == "cancelled"
    assert seen == [(1, 4)] and [r.status for r in R.unfinished(spark, out).collect()] == ["cancelled"]
    for other in (SegmentConfig(min_confidence=0.9),):
        with pytest.raises(ValueError):
            R.run(spark, rec, templates, out, other)
    assert R.run(spark, rec, templates, out, step_files=2) == "completed"
    assert R.unfinished(spark, out).isEmpty()
    with open(root / "out/segment_summary.csv", encoding="utf-8-sig") as f:
        rows = {r["segment_id"]: r for r in csv.DictReader(f)}
    assert {k: int(v["total_calls"]) for k, v in rows.items()} == {"r0": 2, "r1": 1, "r2": 0, "empty": 0} and rows["empty"]["processing_status"] == "failed"
    about = json.loads((root / "out/run_metadata.json").read_text())
    assert (about["total_calls"], about["failed_count"], about["success_count"], about["status"]) == (3, 1, 3, "partial_failure")
    assert json.loads((root / "out/model.json").read_text())["template_count"] == 1
    assert len(list((root / "out/audio").glob("*.wav"))) == 3
    assert R.whole(spark, out, templates, SegmentConfig()).pulses.count() == 3
    assert R.run(spark, rec, templates, out) == "completed"  # nothing is left to do
    assert R.whole(spark, out, templates, SegmentConfig()).pulses.count() == 3
    S.write(root / "rec/r1.wav", S.recording(3, [], 1e-4))
    with pytest.raises(ValueError):
        R.run(spark, rec, templates, out)


def test_run_without_recordings(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.run(spark, str(tmp_path), folder[1], str(tmp_path / "out"))


def write_then(root, spans, seconds=2, name="x"):
    S.write(root / f"{name}.wav", S.recording(seconds, [(t, S.tone(47)) for t in spans], 1e-4))


def test_a_step_that_broke_off_is_never_read(spark, folder, tmp_path, monkeypatch):
    """The recordings table cannot be written in the first step, one file is added, and the run is started again."""
    templates = folder[1]
    write_then(tmp_path / "rec", [0.5, 1.5], name="r0")
    write_then(tmp_path / "rec", [1.0], name="r1")
    rec, out = str(tmp_path / "rec"), str(tmp_path / "out")
    for broken in ("recordings", "predictions"):
        before = tables.write_table

        def fail(rows, path, *a, **kw):
            before(rows, path, *a, **kw)
            if f"/{broken}/" in path:
                raise OSError("lost")

        monkeypatch.setattr(tables, "write_table", fail)
        with pytest.raises(OSError):
            R.run(spark, rec, templates, out, with_audio=False)
        monkeypatch.undo()
    write_then(tmp_path / "rec", [], name="r2")
    assert R.run(spark, rec, templates, out, with_audio=False) == "completed"
    a = R.whole(spark, out, templates, SegmentConfig())
    assert a.pulses.count() == 3 and {r.segment_id: r.total_calls for r in a.summary().collect()} == {"r0": 2, "r1": 1, "r2": 0}


def test_a_changed_file_of_equal_length_is_noticed(spark, folder, tmp_path):
    write_then(tmp_path / "rec", [0.5])
    rec, out = str(tmp_path / "rec"), str(tmp_path / "out")
    assert R.run(spark, rec, folder[1], out, with_audio=False) == "completed"
    write_then(tmp_path / "rec", [])
    with pytest.raises(ValueError, match="changed"):
        R.run(spark, rec, folder[1], out, with_audio=False)


def test_a_run_goes_on_inside_a_recording(spark, folder, tmp_path):
    """Half of a long recording is committed; that half's samples are then gone, and are not asked for again."""
    at = [1.0, 2.001, 3.5, 4.999, 5.0 + 1e-4, 6.5, 8.0, 9.5]
    write_then(tmp_path / "rec", at, 10, "long")
    write_then(tmp_path / "rec", [0.5], 2, "short")
    config, rec = SegmentConfig(chunk_seconds=1.0), str(tmp_path / "rec")
    whole, halves = str(tmp_path / "whole"), str(tmp_path / "halves")
    assert R.run(spark, rec, folder[1], whole, config) == "completed"
    assert R.run(spark, rec, folder[1], halves, config, step_chunks=5, should_stop=lambda: True) == "cancelled"
    done = {r.recording_key: r.done for r in R.progress(R.commits(spark, halves)).collect()}
    assert sorted(done.values()) == [2, 5]
    with open(tmp_path / "rec/long.wav", "r+b") as f:  # samples from 2.2 to 4 s; the first and last MiB stay
        f.seek(44 + 2 * round(2.2 * S.SR))
        f.write(bytes(2 * round(1.8 * S.SR)))
    assert R.run(spark, rec, folder[1], halves, config, step_chunks=5) == "completed"
    rows = [sorted((r.segment_id, r.pulse_id, round(r.start_s, 6), r.predicted_label) for r in R.whole(spark, x, folder[1], config).pulses.collect()) for x in (whole, halves)]
    assert rows[0] == rows[1] and len(rows[0]) >= 8
    assert len(list((tmp_path / halves / "audio").glob("*.wav"))) == len(rows[0])
