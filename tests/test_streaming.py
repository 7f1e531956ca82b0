"""Streams give what the batch operators give."""

import pytest

from pulselake.operators import frames, intervals
from pulselake.streaming import pulses as P

ROWS = [
    ("a", 0, 0.100, 0.105), ("a", 0, 9.998, 10.003), ("a", 1, 9.999, 10.004), ("a", 1, 12.0, 12.005), ("a", 2, 12.001, 12.006), ("a", 2, 25.0, 25.004),
    ("b", 0, 9.99, 10.0), ("b", 2, 9.99, 10.0), ("b", 3, 9.9914, 10.0014), ("c", 5, 50.0, 50.01), ("c", 6, 50.02, 50.03),
]
KIND = "recording_key string, chunk_index int, start_s double, end_s double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "pulses")
    for chunk in range(7):  # a file for each chunk, in order
        part = [r for r in ROWS if r[1] == chunk]
        if part:
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def source(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)


def test_repeats_match_the_batch_operator(spark, folder):
    got = drain(P.unrepeated(source(spark, folder)), "unrepeated").collect()
    want = intervals.drop_repeats_across_chunks(spark.createDataFrame(ROWS, KIND)).collect()
    # In the batch form a dropped pulse still stands for its chunk; here none of these cases differs.
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_windows_and_totals(spark, folder):
    x = P.with_event_time(spark.read.parquet(folder))
    s = P.with_event_time(source(spark, folder))
    got = drain(P.windowed_counts(s, ["recording_key"]), "tumbling", "complete").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, P.windowed_counts(x, ["recording_key"]).collect()))
    slid = drain(P.windowed_counts(s, ["recording_key"], "10 seconds", "5 seconds"), "sliding", "complete")
    assert slid.groupBy().sum("n").first()[0] == 2 * len(ROWS)
    totals = drain(P.running_totals(source(spark, folder), "recording_key", "recording_key", ["a"]), "totals", "complete")
    assert {r.recording_key: (r.total_calls, r.a, r.unknown) for r in totals.collect()} == {"a": (6, 6, 0), "b": (3, 0, 3), "c": (2, 0, 2)}


def test_sessions_are_islands(spark, folder):
    got = drain(P.sessions(P.with_event_time(source(spark, folder)), ["recording_key"], "3 seconds"), "sess", "complete").collect()
    x = spark.read.parquet(folder)
    i = frames.islands(x, ["recording_key"], "start_s", 3.0, ["start_s", "end_s"]).groupBy("recording_key", "island").count().collect()
    assert sorted((r.recording_key, r.n) for r in got) == sorted((r.recording_key, r["count"]) for r in i)


def test_batches_are_written_once_and_guarded(spark, folder, tmp_path):
    table, point = str(tmp_path / "table"), str(tmp_path / "point")
    for _ in range(2):
        P.write_batches(source(spark, folder), table, point, {"threshold": 0.2}).awaitTermination(120)
    assert spark.read.parquet(table).count() == len(ROWS)
    with pytest.raises(ValueError):
        P.write_batches(source(spark, folder), table, point, {"threshold": 0.3})


def test_new_recordings(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/x.WAV").write_bytes(b"1234")
    (tmp_path / "in/y.txt").write_bytes(b"no")
    got = drain(P.new_recordings(spark, str(tmp_path / "in")), "files").collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in got] == [("x.WAV", 4)]


def test_state_is_forgotten(spark, tmp_path):
    """A repeat of the chunk before is dropped while the tail is kept, and comes through once it has ended."""
    import time

    spark.conf.set(P.STATE_STORE, P.ROCKSDB)
    for keep_ms, pause, want in ((600_000, 0, 1), (1, 0.5, 2)):
        path, out = str(tmp_path / f"in{keep_ms}"), str(tmp_path / f"out{keep_ms}")
        put = lambda rows: spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)  # noqa: B023, E731
        put([("a", 0, 9.998, 10.003)])
        x = P.unrepeated_for(spark.readStream.schema(KIND).parquet(path), keep_ms=keep_ms)
        q = x.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(processingTime="200 milliseconds").start()

        def seen():
            try:
                return spark.read.schema(KIND).parquet(out)  # noqa: B023
            except Exception:  # the folder is not there yet
                return spark.createDataFrame([], KIND)

        def wait(n):
            until = time.time() + 60
            while seen().count() < n and time.time() < until:
                assert q.exception() is None  # noqa: B023
                time.sleep(0.2)

        try:
            wait(1)
            time.sleep(pause)
            put([("a", 1, 9.999, 10.004), ("b", 1, 1.0, 1.01)])
            wait(want + 1)
            assert sorted((r.recording_key, r.chunk_index) for r in seen().collect()) == [("a", 0), *[("a", 1)] * (want - 1), ("b", 1)]
        finally:
            q.stop()


def test_totals_go_on_from_the_state(spark, folder, tmp_path):
    P.ran_to_end(P.running_totals(source(spark, folder), "recording_key", "recording_key", ["a"]), str(tmp_path))
    state = P.totals_state(spark, str(tmp_path / "state"), "recording_key", ["a"])
    assert {r.recording_key: (r.total_calls, r.a, r.unknown) for r in state.collect()} == {"a": (6, 6, 0), "b": (3, 0, 3), "c": (2, 0, 2)}
    more = spark.createDataFrame([("a", 9, 0.0, 1.0), ("d", 0, 0.0, 1.0)], KIND)
    assert {r.recording_key: r.total_calls for r in P.add_totals(state, more, "recording_key", "recording_key", ["a"]).collect()} == {"a": 7, "b": 3, "c": 2, "d": 1}


def test_recordings_share_calls(spark, folder, tmp_path, monkeypatch):
    """Recordings of one map of state keep their own tails, batch by batch and at once; a call of Python takes a map's rows, not a recording's."""
    monkeypatch.setattr(P, "BUCKETS", 1)
    spark.conf.set(P.STATE_STORE, P.ROCKSDB)
    want = sorted(map(tuple, intervals.drop_repeats_across_chunks(spark.createDataFrame(ROWS, KIND)).collect()))
    for name, src in (("many", source(spark, folder)), ("one", spark.readStream.schema(KIND).parquet(folder))):
        x = P.unrepeated_for(src, keep_ms=None)
        assert "_bucket" in x._jdf.queryExecution().analyzed().toString()
        P.ran_to_end(x, str(tmp_path / name), "append")
        assert sorted(map(tuple, spark.read.schema(KIND).parquet(str(tmp_path / name / "rows")).select("recording_key", "chunk_index", "start_s", "end_s").collect())) == want
    rows = [(None, 0, 9.998, 10.003), ("a", 1, 9.999, 10.004), (None, 1, 9.999, 10.004), *((f"r{k}", c, 10.0 * c + 9.998, 10.0 * c + 10.003) for k in range(3000) for c in range(4))]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(str(tmp_path / "in"))
    P.ran_to_end(P.unrepeated_for(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), keep_ms=None), str(tmp_path / "wide"), "append")
    assert spark.read.schema(KIND).parquet(str(tmp_path / "wide/rows")).count() == len(rows) - 1
