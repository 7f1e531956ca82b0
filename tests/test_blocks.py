"""The data source for recordings: what is pushed down, what is read, and stores that are not mounted."""

from types import SimpleNamespace

import sounds as S
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan

from pulselake.functions.signal import wav_bytes
from pulselake.sources import blocks, recordings


def folder(root):
    S.write(root / "a.wav", S.recording(3.3, [(1.0, S.tone(47))], 1e-3))
    S.write(root / "deep/b.WAV", S.recording(1.0, [], 1e-3))
    (root / "empty.wav").write_bytes(b"")
    (root / "no.txt").write_bytes(b"no")
    return str(root)


def test_blocks_are_rows(spark, tmp_path):
    root = folder(tmp_path)
    blocks.register(spark)
    x = spark.read.format("recordings").option("path", root).option("blockSeconds", 1).option("sliceBytes", 600_000).load()
    rows = x.collect()
    a = sorted((r for r in rows if r.path.endswith("a.wav")), key=lambda r: r.block)
    assert [(r.block, r.start_s, round(r.end_s, 6), len(r.samples), r.sr) for r in a] == [(0, 0.0, 1.0, S.SR, S.SR), (1, 1.0, 2.0, S.SR, S.SR), (2, 2.0, 3.0, S.SR, S.SR), (3, 3.0, 3.3, round(0.3 * S.SR), S.SR)]
    assert [r.error is not None for r in rows if "empty" in r.path] == [True] and sum("b.WAV" in r.path for r in rows) == 1 and len(rows) == 6
    kept = x.filter((F.col("start_s") >= 1) & (F.col("end_s") < 3) & F.col("path").endswith("a.wav"))
    assert [r.block for r in kept.select("block").collect()] == [1]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    condition = plan[plan.index("Filter") :].split("\n")[0]
    assert "start_s" not in condition and "end_s" not in condition and "path" in condition


def test_filters_decide_what_is_read(tmp_path, monkeypatch):
    root, read = folder(tmp_path), []
    plain = recordings.open_input

    class Counted:
        def __init__(self, path):
            self.f = plain(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, *a):
            return self.f.seek(*a)

        def read(self, n):
            out = self.f.read(n)
            read.append(len(out))
            return out

    monkeypatch.setattr(blocks, "open_input", Counted)
    reader = blocks.BlockReader({"path": root, "blockSeconds": "1", "sliceBytes": str(1 << 30)})
    rest = list(reader.pushFilters([EqualTo(("path",), f"{root}/a.wav"), GreaterThanOrEqual(("start_s",), 1.0), LessThan(("end_s",), 3), IsNotNull(("sr",))]))
    assert rest == [IsNotNull(("sr",))]
    parts = reader.partitions()
    assert [p.path for p in parts] == [f"{root}/a.wav"]
    got = [r for p in parts for r in reader.read(p)]
    assert [g.column(1)[0].as_py() for g in got] == [1] and sum(read) <= recordings.HEAD + 2 * S.SR
    asked = blocks.BlockReader({"path": root})
    assert list(asked.pushFilters([EqualTo(("path",), "other")])) == [] and [r for p in asked.partitions() for r in asked.read(p)] == []


def test_a_store_that_is_not_mounted(monkeypatch):
    from pyarrow import fs

    store = fs._MockFileSystem()
    store.create_dir("bucket/in")
    with store.open_output_stream("bucket/in/x.wav") as f:
        f.write(wav_bytes(S.recording(2.0, [(0.5, S.tone(47))])))
    monkeypatch.setattr(fs, "FileSystem", SimpleNamespace(from_uri=lambda uri: (store, uri.split("://")[1])))
    found = recordings.list_recordings("mock://bucket")
    assert [p for p, _ in found] == ["mock://bucket/in/x.wav"]
    row = {"path": found[0][0], "sr": S.SR, "frames": 2 * S.SR, "data_start": 44, "align": 2, "code": 1, "bits": 16, "channels": 1}
    assert abs(recordings.read_samples(row, 0.4, 0.6)).max() > 0.4 and len(recordings.read_samples(row, 1.9, 9)) == S.SR // 10
    reader = blocks.BlockReader({"path": "mock://bucket", "blockseconds": "1"})
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 2
