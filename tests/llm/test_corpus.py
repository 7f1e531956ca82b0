"""Toxicity, mixing, packing and the pipeline."""

import sys
import zlib
from pathlib import Path

import corpus as C
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import mixing, packing, registry, toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of which some hold one of a few marked words or pairs."""
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 10 == 0
        t = C.prose(40, i).split(" ")
        if toxic:
            t[i % 39] = ("vile", "nasty stuff", "you rot")[i % 3]
        rows.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, C.KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_the_held_out_fold(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    x = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    test = [i for i in x if held_out(i)]
    assert np.mean([(x[i] >= 0.3) == (i % 10 == 0) for i in test]) > 0.97
    assert len(model[0]) < 20_000  # sparse


def test_ftrl_against_plain_updates():
    """The published per-coordinate update, row by row and coordinate by coordinate, in plain Python."""
    import math
    import random

    r = random.Random(2)
    rows = []
    for i in range(300):
        y = int(r.random() < 0.3)
        x = {r.randrange(10, 60) for _ in range(6)} | ({5} if y and r.random() < 0.8 else set()) | ({7} if r.random() < 0.5 else set())
        rows.append((np.array(sorted(x)), y))
    found, learned = toxicity.ftrl(rows, epochs=3)
    rate = sum(y for _, y in rows) / len(rows)
    l1 = toxicity.L1_SPREAD * math.sqrt(len(rows) * rate * (1 - rate))
    z, n = {}, {}

    def weight(i):
        hold, zi = (0.0 if i == 0 else l1), z.get(i, 0.0)
        if abs(zi) <= hold:
            return 0.0
        return -(zi - math.copysign(hold, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for x, y in rows:
            ids = [0, *map(int, x)]
            w = {i: weight(i) for i in ids}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in ids:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(found.tolist(), learned.tolist())) == pytest.approx(want, abs=1e-9) and 5 in want and len(want) < 30


def test_toxicity_learns_nothing_from_the_fold(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.bucket() == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a[0] == b[0]).all() and np.allclose(a[1], b[1])


def test_toxicity_edges(spark):
    d = C.clashing(C.frame(spark), "score", "x")
    model = toxicity.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_toxicity(d, model).filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(d.limit(0), model).count() == 0


def targets(sizes, share=1.5, cap=2.0):
    """Water filling by repeated rounds."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, out, left = set(), {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        room = left - sum(cap * sizes[s] for s in full)
        over = [s for s in open_ if room * weight[s] / sum(weight[o] for o in open_) > cap * sizes[s]]
        if not over:
            break
        full |= set(over)
    open_ = [s for s in names if s not in full]
    for s in names:
        out[s] = cap * sizes[s] if s in full else room * weight[s] / sum(weight[o] for o in open_)
    return out


def test_mixing(spark):
    d = C.clashing(C.frame(spark, [(2000 + i, C.prose(30, i), "en", f"s{i % 7}", 1) for i in range(200)]), "size", "target", "taken")
    got = mixing.mix(d).collect()
    assert len(got) == d.count()
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len(C.words(r.text)) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = sorted((r.doc_id or 0, r.size, r.taken) for r in mixing.mix(d.repartition(3)).collect())
    assert again == sorted((r.doc_id or 0, r.size, r.taken) for r in got)
    assert mixing.mix(d.limit(0)).count() == 0


def test_whole_documents(spark):
    d = C.frame(spark)
    for r in mixing.mix(d, whole=True).collect():
        assert r.taken == r.copies * r.size and r.copies <= 2


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_tokens_are_those_of_the_public_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*C.texts(), "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext |>", " \n<|endoftext|>\n "]:
        assert packing.encode(own, text or "") == t.encode(text or "", add_special_tokens=False).ids
    assert 50256 in packing.encode(own, "a <|endoftext|> b")


def check_packing(rows, docs, capacity):
    import public_tokenizers

    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    left = sorted((i or 0, packing.encode(own, t or "") + [0]) for i, t in docs)
    mine = {}
    for r in rows:
        mine.setdefault((r.doc_id or 0, r.start == 0), []).append(r)
    total = 0
    by_sequence = {}
    for r in rows:
        total += r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = [x for i, x in left if i == (r.doc_id or 0)]
        part = [x[r.start : r.start + r.length] for x in ids]
        assert any(len(p) == r.length and zlib.crc32(np.array(p, "<u4").tobytes()) == r.ids_crc32 for p in part)
        assert all(r.piece == 0 or r.length == capacity for x in part if len(x) == r.length)
    assert total == sum(len(x) for _, x in left)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing(spark):
    d = C.clashing(C.frame(spark), "piece", "length", "offset", "ids")
    rows = packing.pack(d, capacity=256).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in d.collect()], 256)
    assert used <= least + 2
    assert packing.pack(d.limit(0)).count() == 0


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing uses: each piece, the longest first, to the least room that holds it."""
    rooms, used = [0] * (capacity + 1), 0
    for n in sorted(lengths, reverse=True):
        for _ in range(lengths[n]):
            r = next((r for r in range(n, capacity + 1) if rooms[r]), None)
            used += r is None
            r = r or capacity
            rooms[r] = max(0, rooms[r] - 1)
            rooms[r - n] += 1
    return used


def test_packing_with_a_map_column(spark):
    d = C.frame(spark).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    x = packing.pack(d, capacity=256)
    assert x.filter("m['a'] != 1").count() == 0 and x.count() == packing.pack(d.drop("m"), capacity=256).count()


def test_configurations_are_as_few_as_can_be():
    """Against all ways of cutting a small instance, and the bound by total length."""
    used = lambda sizes, counts: sum(n for _, n in packing.configurations(sizes, counts, 100))
    assert used([50, 33], [300, 300]) == 250  # 150 of two halves and 100 of three thirds
    assert 130 <= used([60, 40, 30], [300, 300, 300]) // 3 <= 134  # 60 + 40, 60 + 30 and 40 + 30 + 30 together; fullest first takes 300 of 60 + 40 and 100 of three 30
    for shape, n in packing.configurations([70, 45, 30, 26], [40, 50, 60, 70], 100):
        assert sum(a * b for a, b in zip(shape, (70, 45, 30, 26))) <= 100 and n >= 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_sequences(seed):
    r = np.random.default_rng(seed)
    capacity = 512
    lengths = {int(n): int(r.integers(1, 60)) for n in r.integers(1, capacity + 1, 120)}
    places = packing.plan(lengths, capacity)
    seen = {n: np.zeros(k, int) for n, k in lengths.items()}
    fill = {}
    for n, first, end, sequence, offset in places:
        seen[n][first:end] += 1
        for k in range(end - first):
            fill.setdefault(sequence + k, []).append((offset, n))
    assert all((v == 1).all() for v in seen.values())
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(fill) <= 1.01 * best_fit(lengths, capacity) + 2


def test_pipeline_stages(spark, sf):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline as P

    own = spark.read.parquet(f"{sf}/documents.parquet")
    docs = own
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "mixing", "packing"]
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.checkpoint(stage(spark, docs, sf))
        assert docs.columns == own.columns and docs.filter("n_chars != length(text)").count() == 0
        n = docs.count()
        assert n > 0 and (name in ("line_dedup", "mixing") or n <= before)
        before = n
    out = P.checkpoint(P.packing(spark, docs, sf))
    used, least = check_packing(out.collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= 1.05 * least + 1


def test_pipeline_against_brute_force(spark, tmp_path):
    """The first three stages against plain definitions, with nulls, empties, ties, copies and a very long text."""
    import corpus_pipeline as P
    import test_joins as J

    from pulselake.llm import quality

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = C.frame(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r.text for r in d.collect()}
    fine = {}
    for i, t in rows.items():
        n, *_, repeated, _, _, _ = quality.measure_text(t or "")
        if n >= 10 and 100 * repeated <= 20 * n:
            fine[i] = t
    x = P.checkpoint(P.quality(spark, d, str(tmp_path)))
    assert {r.doc_id: r.text for r in x.collect()} == fine and len(fine) > 20
    seen = [(i, k, line) for i in sorted(fine) for k, line in enumerate(fine[i].split("\n")) if line.strip()]
    _, gone = J.brute_lines([((i, k), line) for i, k, line in seen])
    left = {i: "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in fine.items()}
    left = {i: t for i, t in left.items() if t.strip()}
    x = P.checkpoint(P.line_dedup(spark, x, str(tmp_path)))
    assert {r.doc_id: r.text for r in x.collect()} == left and len(left) < len(fine)
    more = spark.createDataFrame([(900 + i, C.prose(100, 77) + tail, "en", "web", 1) for i, tail in enumerate(("", " one", " two", ""))] + [(910, None, None, None, 0), (911, "", None, None, 0)], C.KIND)
    x = x.union(more)
    texts = {r.doc_id: r.text for r in x.collect()}
    first = {c for _, _, c in J.groups(list(texts.items()), 5, 80)}
    x = P.checkpoint(P.near_duplicates(spark, x, str(tmp_path)))
    assert sorted(r.doc_id for r in x.collect()) == sorted(first) and {900, 910, 911} <= first and 901 not in first


def test_pipeline_with_nothing_and_clashes(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = C.clashing(C.frame(spark), "kept", "copies", "size", "n_lines", "component_id")
    for docs, empty in ((d, False), (d.limit(0), True)):
        for _, stage in P.STAGES:
            docs = P.checkpoint(stage(spark, docs, str(tmp_path)))
        assert (docs.count() > 0) == (not empty) and {"sequence_id", "offset"} <= set(docs.columns)
