"""Readers and writers against files made here."""

import csv
import json
import struct

import numpy as np
import pytest
import sounds as S
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pulselake.functions.signal import wav_bytes, wav_header, wav_samples
from pulselake.sinks import tables
from pulselake.sources import documents, spectra


def son(frames: np.ndarray, comment: bytes = b"", told: int | None = None) -> bytes:
    head = bytearray(92)
    head[:4] = b"SONA"
    for at, kind, v in ((4, "<I", 250_000), (8, "<f", 0.001), (12, "<f", 500.0), (24, "<I", frames.shape[0]), (28, "<I", frames.shape[1]), (88, "<I", len(comment) if told is None else told)):
        struct.pack_into(kind, head, at, v)
    return bytes(head) + frames.astype("<i2").tobytes() + comment


@pytest.mark.parametrize("comment,told", [(b"", None), (b"site 7", None), (b"site 7", 0)])
def test_son_layouts(comment, told):
    x = np.arange(32).reshape(4, 8) + 200
    head, got = spectra.parse(son(x, comment, told))
    assert (got == x).all() and head["comment"] == comment.decode() and head["bin_hz"] == 500.0


def test_son_as_rows(spark, tmp_path):
    x = np.arange(32).reshape(4, 8) + 200
    (tmp_path / "a.son").write_bytes(son(x, b"note"))
    (tmp_path / "b.SON").write_bytes(b"SONA")
    s = spectra.read_spectra(spark, str(tmp_path))
    rows = s.collect()
    assert sum(r.error is None for r in rows) == 4 and sum(r.error is not None for r in rows) == 1
    cells = spectra.spectrum_cells(s).collect()
    assert len(cells) == 32 and max(r.power_db for r in cells) == 0.0
    worst = min(cells, key=lambda r: r.power_db)
    assert worst.frame == 0 and worst.bin == 0 and worst.power_db == pytest.approx(20 * np.log10(200 / 231))
    files = spark.createDataFrame([("file:/x/a.wav",), ("file:/x/c.wav",)], "path string")
    got = documents.companions(spark.createDataFrame([("file:/x/a.son",), ("file:/x/b.son",)], "path string"), files).collect()
    assert {r.path[-5:]: r.companion for r in got} == {"a.son": "file:/x/a.wav", "b.son": None}


def test_wav_formats():
    y = S.tone(47, 1)
    whole = wav_bytes(y)
    h = wav_header(whole, len(whole))
    assert np.abs(wav_samples(whole[h["start"] :], h) * 32768 / 32767 - y).max() < 1e-4
    for code, bits, body in ((1, 24, b"\x00\x00\x40\x00\x00\xc0"), (3, 32, np.array([0.5, -0.5], "<f4").tobytes()), (1, 8, bytes([192, 64]))):
        h = {"code": code, "bits": bits, "channels": 1}
        assert wav_samples(body, h).tolist() == [0.5, -0.5]
    with pytest.raises(ValueError):
        wav_header(b"RIFFxxxxWAVE", 12)


def test_csv_and_documents(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿name,n,score\nä,3,0.5\nb,x,\n", encoding="utf-8")
    got = documents.read_csv(spark, str(tmp_path / "r.csv"), StructType.fromDDL("name string, n int, score double, more string")).collect()
    assert [tuple(r) for r in got] == [("ä", 3, 0.5, None), ("b", None, None, None)]
    for name, doc in (("a", '{\n "version": 3,\n "status": "cancelled",\n "processed_until_s": 20.0\n}'), ("b", '{"version": 2, "status": "cancelled"}'), ("c", "{broken")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "run_state.json").write_text(doc)
    found = documents.resumable_runs(spark, str(tmp_path / "runs")).collect()
    assert [(r.path.split("/")[-2], r.processed_until_s) for r in found] == [("a", 20.0)]
    bad = documents.read_documents(spark, str(tmp_path / "runs"), "version int", "run_state.json").filter("_corrupt is not null").collect()
    assert [r._corrupt for r in bad] == ["{broken"]


def test_reports_are_single_files(spark, tmp_path):
    df = spark.createDataFrame([("CF1", 2, None), ("未知", 0, 0.5)], "label string, n int, score double").coalesce(1)
    assert tables.write_report_csv(df, str(tmp_path / "o/r.csv")) == 2
    with open(tmp_path / "o/r.csv", encoding="utf-8-sig") as f:
        assert list(csv.reader(f)) == [["label", "n", "score"], ["CF1", "2", ""], ["未知", "0", "0.5"]]
    with pytest.raises(ValueError):
        tables.write_report_csv(df, str(tmp_path / "o/s.csv"), 1)
    tables.write_document(df.limit(1), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"label": "CF1", "n": 2, "score": None}
    tables.write_csv(df.withColumn("a", F.array("n")), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_audio_export(spark, tmp_path):
    long, short = wav_bytes(S.tone(47)), wav_bytes(np.zeros(4))
    p = spark.createDataFrame([("r", "p1", 1.0, 1, long), ("r", "p2", 2.0, 1, short), ("r", "../p3", 3.0, 1, long), ("r", "p4", 4.0, 1, long)], "recording_key string, pulse_id string, start_s double, component_id int, pcm binary")
    out = tables.write_pulse_audio(tables.within_budget(p, 3), str(tmp_path / "w"), F.concat("pulse_id", F.lit(".wav"))).collect()
    assert {r.pulse_id: (r.pulse_file, bool(r.audio_export_error)) for r in out} == {"p1": ("p1.wav", False), "p2": ("", True), "../p3": ("", True)}
    assert (tmp_path / "w/p1.wav").read_bytes() == long and sorted(f.name for f in (tmp_path / "w").iterdir()) == ["p1.wav"]


def test_render_specs(spark):
    p = spark.createDataFrame([("e", "k1", 1.0, 1.005, "CF1", 47.0, 46.0, 45.0, 48.0), ("e", "k2", 1.001, 1.006, "CF2", 67.0, 67.0, 66.0, 68.0)], "event_id string, pulse_key string, start_s double, end_s double, predicted_label string, start_freq_khz double, end_freq_khz double, f05_khz double, f95_khz double")
    one = tables.render_specs(p).collect()
    assert len(one) == 1 and one[0].labels == "CF1,CF2" and (one[0].low_hz, one[0].high_hz) == (37_000.0, 76_000.0)
    assert tables.render_specs(p, "separate").count() == 2


def test_empty_recordings_are_listed(spark, tmp_path):
    from pulselake.sources import recordings

    (tmp_path / "a dir%20").mkdir()
    for name, data in (("a dir%20/none.wav", b""), ("some.WAV", b"RIFF"), ("other.txt", b"")):
        (tmp_path / name).write_bytes(data)
    got = {(r.path.rsplit("/", 1)[1], r.length) for r in recordings.wav_files(spark, str(tmp_path)).collect()}
    assert got == {("none.wav", 0), ("some.WAV", 4)}
    (tmp_path / "some.WAV").write_bytes(b"")
    assert recordings.wav_files(spark, str(tmp_path)).count() == 2
    failed = recordings.recordings(spark, str(tmp_path)).collect()
    assert len(failed) == 2 and all(r.error for r in failed)
    with pytest.raises(FileNotFoundError):
        recordings.require_recordings(spark, str(tmp_path / "missing"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from pulselake import storage

    session = lambda master, folder=None: N(conf=N(get=lambda *_: folder), sparkContext=N(master=master))
    assert storage.shared_folder(session("yarn", "hdfs:/x")) == "hdfs:/x" and storage.shared_folder(session("local[2]"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_folder(session(master))


def test_copies_and_saved_configuration(spark, tmp_path):
    from pulselake.config import SegmentConfig, load_config, save_config

    (tmp_path / "a.txt").write_text("a")
    rows = [(str(tmp_path / "a.txt"), "x/b.txt"), (str(tmp_path / "missing"), "c.txt"), (str(tmp_path / "a.txt"), "../out.txt")]
    got = {r.name: r.copy_error for r in tables.copy_files(spark.createDataFrame(rows, "path string, name string"), str(tmp_path / "to")).collect()}
    assert got["x/b.txt"] == "" and (tmp_path / "to/x/b.txt").read_text() == "a"
    assert "FileNotFoundError" in got["c.txt"] and "ValueError" in got["../out.txt"] and not (tmp_path / "out.txt").exists()
    path = str(tmp_path / "settings.json")
    assert load_config(path) == SegmentConfig()
    save_config(SegmentConfig(min_confidence=0.7), path)
    assert load_config(path) == SegmentConfig(min_confidence=0.7)
    (tmp_path / "settings.json").write_text('{"min_confidence": 2, "other": 1}')
    with pytest.raises(ValueError):
        load_config(path)


def test_csv_files_by_their_own_headers(spark, tmp_path):
    """Three orders of columns, with and without a byte order mark, quotes, line breaks, columns that lack or are too many, and an empty file."""
    files = {
        "a.csv": "a,b\n1,x\n2,\"y\nz\"\n", "b.csv": "﻿b,a\nq,3\nr,4\n", "c.csv": "﻿\"other\",\"b\",\"a\"\n9,s,5\n9,,six\n",
        "d.csv": "a\n7\n", "e.csv": "", "f.csv": "b,a,b\nno,8,yes\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    kind = StructType([StructField("a", IntegerType()), StructField("b", StringType())])
    got = sorted(map(tuple, documents.read_csv(spark, str(tmp_path), kind).collect()), key=repr)
    assert got == sorted([(1, "x"), (2, "y\nz"), (3, "q"), (4, "r"), (5, "s"), (None, None), (7, None), (8, "yes")], key=repr)
    (tmp_path / "none").mkdir()
    (tmp_path / "none/e.csv").write_text("")
    assert documents.read_csv(spark, str(tmp_path / "none"), kind).count() == 0
