"""Sharding, importance resampling and the prefix trie against their SQL, plain definitions and the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus as C
import duckdb
import pytest
from pyspark.sql import functions as F

from pulselake.llm import importance, registry, sharding, trie
from pulselake.llm.common import numbered


@pytest.mark.parametrize("name", ["op11_sharding", "op12_importance", "op13_trie"])
def test_same_rows_as_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr) and rows


def test_numbers_over_many_tasks(spark):
    x = spark.range(0, 3000, 1, 20).select((F.col("id") % 3).alias("p"), F.lit("one").alias("same"), "id")
    rows = numbered(x.repartition(7), ["same"], ["p"], "n").collect()
    assert all(sorted(r.n for r in rows if r.p == p) == list(range(1000)) for p in range(3))
    assert numbered(x.limit(0), ["id"]).count() == 0


def test_shards_move_only_to_the_new_one(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("shard"), F.lit(1).alias("_place"))
    rows = sharding.shard_records(keys, sharding.even(5), "k", more=sharding.even(6)).collect()
    assert len(rows) == 4000 and {r._place for r in rows} == {1}
    assert all(r.grown_shard in (r.shard, 5) for r in rows) and 500 < sum(r.grown_shard == 5 for r in rows) < 850
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    again = sharding.shard_records(keys.repartition(9), sharding.even(5), "k").collect()
    assert {(r.k, r.shard, r.slot) for r in rows} == {(r.k, r.shard, r.slot) for r in again}


def test_weights_are_shares(spark):
    keys = spark.range(20000)
    heavy = {1: 1.0, 2: 3.0, 7: 0.0}
    one, more = (keys.select("id", sharding.shard_of(F.col("id"), w).alias("s")).collect() for w in (heavy, {**heavy, 2: 4.0}))
    assert abs(sum(r.s == 2 for r in one) / 20000 - 0.75) < 0.02 and {r.s for r in one} == {1, 2}
    assert all(b.s in (a.s, 2) for a, b in zip(one, more))  # a weight that grows only takes
    for bad in ({}, {0: 0.0}, {0: -1.0, 1: 1.0}, {0: math.inf}):
        with pytest.raises(ValueError):
            sharding.shard_of(F.col("id"), bad)


def test_shards_of_awkward_rows(spark, tmp_path):
    docs = C.clashing(C.frame(spark, [(None, None, None, None, None)] * 3), "slot", "grown_shard")
    x = sharding.shard_records(docs, sharding.even(3), order=("text",))
    rows = x.collect()
    assert len(rows) == docs.count() and set(x.columns) == {*docs.columns, "shard", "slot"} - {"grown_shard"} and {r.node for r in rows} == {"own"}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.shard_records(docs.limit(0), sharding.even(3)).count() == 0
    sharding.write_shards(x, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def plain_features(text):
    low = (text or "").translate(C.LOWER)
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def plain_weights(texts, target, buckets):
    s, t = Counter(), Counter()
    for into, all_texts in ((s, texts), (t, target)):
        for x in all_texts:
            for f, n in plain_features(x)[1].items():
                into[zlib.crc32(f.encode()) % buckets] += n
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for x in texts:
        f = plain_features(x)[1]
        n = sum(f.values())
        out.append((n, sum(gain[zlib.crc32(k.encode()) % buckets] * v for k, v in f.items()) // n if n else 0))
    return out


def test_importance_of_awkward_rows(spark):
    docs = C.clashing(C.frame(spark), "weight", "body", "block", "slice")
    target = spark.createDataFrame([(1, C.prose(40, 1)), (2, None), (3, "")], "item_id long, text string")
    rows = docs.select("doc_id", "text").collect()
    for buckets in (10_000, 130):
        want = Counter((r.doc_id, *w) for r, w in zip(rows, plain_weights([r.text for r in rows], [C.prose(40, 1), None, ""], buckets)))
        x = importance.weigh(docs, target, buckets)
        got = x.collect()
        assert Counter((r.doc_id, r.n_features, r.weight) for r in got) == want
        assert {r.body for r in got} == {"own"} and set(x.columns) == {*docs.columns, "n_features", "n_words", "weight"} - {"text"}
    drawn = importance.resample(docs, target, percent=50).collect()
    n = sum(r.n_words >= 20 for r in drawn)
    ranked = sorted((r["rank"], -r["score"]) for r in drawn if r["rank"] is not None)
    assert [a for a, _ in ranked] == list(range(1, n * 50 // 100 + 1)) and [b for _, b in ranked] == sorted(b for _, b in ranked)
    lowest = -ranked[-1][1]
    assert all(r["score"] <= lowest for r in drawn if r.n_words >= 20 and r["rank"] is None)
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.weigh(docs, target.limit(0)).count() == len(rows)


def test_features_of_parts(monkeypatch):
    text = " ".join(f"w{i % 7} É{i}" for i in range(300)) + "--" + "z" * 50
    for longest in (1, 2, 3):
        w = plain_features(text)[0]
        want = Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
        for part in (1 << 22, 1, 10, 64):
            monkeypatch.setattr(importance, "PART", part)
            assert Counter(int(c) for a in importance.features(text, longest) for c in a) == want
            n_words, n, bucket, count = importance.counted(text, longest, 97)
            assert (n_words, n) == (len(w), sum(want.values())) and n == count.sum()
            assert dict(zip(bucket.tolist(), count.tolist())) == dict(Counter({b: sum(v for k, v in want.items() if k % 97 == b) for b in {k % 97 for k in want}}))


def plain_trie(convs):
    """Nodes by their definition; convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(path))))
        out[path] = (
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own), sum(len(p) == len(path) + 1 for p in below), len(leaves),
            sum((len(members[p]) - 1) * len(C.words(p[-1][1])) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return Counter(out.values())


@pytest.mark.parametrize("shuffles", [1, 3, 40])
def test_trie_against_its_definition(spark, shuffles, monkeypatch):
    monkeypatch.setattr(trie, "WAITING", 2)
    r = random.Random(shuffles)
    convs = {i: [(r.choice(("user", "assistant", "")), r.choice(("", "a", "b c", "é d e"))) for _ in range(r.choice((0, 1, 1, 2, 3, 5, 9)))] for i in range(-5, 120)}
    convs |= {200 + i: convs[7] or [("user", "a")] for i in range(30)}
    rows = [(c, n if n else None, role or None, text or None) for c, turns in convs.items() for n, (role, text) in enumerate(turns)]
    rows += [(None, 1, "user", "lost")]
    df = C.clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "part", "depth", "chain")
    convs = {c: t for c, t in convs.items() if t}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        x = trie.prefix_trie(df)
        found = x.collect()
        assert Counter(tuple(r[c] for c in trie.RESULT[:-1]) for r in found) == plain_trie(convs)
        assert x.filter("depth > 0").join(trie.turn_texts(df), "turn_key").count() == len(found) - 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rebuilt_conversations(spark):
    convs = {c: [("user", f"{c}-{i}") for i in range(n)] for c, n in ((0, 2), (1, 5), (2, 1), (19, 4), (21, 3), (40, 1), (41, 2), (59, 6))}
    df = spark.createDataFrame([(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    want = {c: convs.get(c - c % 20, [])[: h[c]] + convs[c][h[c] :] for c in convs}
    assert Counter(tuple(r[c] for c in trie.RESULT[:-1]) for r in trie.trie_of(trie.sequences(trie.rebuilt(df))).collect()) == plain_trie(want)
    assert trie.prefix_trie(df.limit(0)).count() == 0
