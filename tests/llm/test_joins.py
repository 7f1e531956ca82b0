"""N-gram join, line dedup and substring dedup against brute force."""

import hashlib
from collections import Counter

import corpus as C
import pytest
from pyspark.sql import functions as F

from pulselake.llm import common, lines, ngram_join, substrings


class Union(dict):
    def __missing__(self, x):
        return x

    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def groups(rows, size, percent):
    """(doc_id, number of shingles, smallest doc_id of the component) of rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = C.words((t or "").translate(C.LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    u, ids = Union(), list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                u.join(a, b)
    return sorted((i, len(sets[i]), u.find(i)) for i in ids)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(5, 3), (3, 9), (9, 5), (20, 21), (21, 22), (4, 4)]])
def test_components(spark, edges):
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((n, u.find(n)) for n in {x for a, b in edges for x in (a, b) if a != b})


def test_ngram_groups(spark):
    rows = [(i, t) for i, t in enumerate(C.texts(), 1)]
    got = ngram_join.ngram_groups(C.clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n_shingles", "component_id"))
    assert sorted(map(tuple, got.collect())) == groups(rows, 4, 85)


def test_ngram_groups_with_common_tokens(spark):
    """Many near copies, in several clusters that share their frequent shingles: hubs, and what hubs miss."""
    import random

    r, rows = random.Random(3), []
    common_part = C.prose(24, 50).split(" ")
    for c in range(4):
        own = C.prose(12, 60 + c).split(" ")
        for _ in range(30):
            w = common_part + own
            w[r.randrange(24, 36)] = f"v{r.randrange(3)}"
            rows.append((len(rows), " ".join(w)))
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), size=3, percent=70)
    assert sorted(map(tuple, got.collect())) == groups(rows, 3, 70)


def test_orders_rule_out_long_pairs(spark):
    """Long texts in a ring, each half its neighbour's, and a line of its own with each other text: too long for sketches of fixed size, so the tokens of each order rule pairs out."""
    import random

    r = random.Random(11)
    part = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1500)) for _ in range(20)]
    line = lambda i, j: f"a{min(i, j)} b{max(i, j)} " * 2 + "and"
    rows = [(k, " ".join([part[k], part[k - 1], *(line(k, j) for j in range(20) if j != k)])) for k in range(20)]
    rows += [(100, rows[0][1] + " and more"), (101, rows[1][1].replace(" ", "  "))]
    report: list = []
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string"), report=report)
    assert sorted(map(tuple, got.collect())) == groups(rows, 4, 85)
    before, second, third = (sum(x[i] for x in report) for i in range(3))
    assert before > second > third >= 1


def test_ngram_groups_nulls_and_nothing(spark):
    d = C.frame(spark)
    assert ngram_join.ngram_groups(d).count() == d.count()
    assert ngram_join.ngram_groups(d.limit(0)).count() == 0
    lone = ngram_join.ngram_groups(spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")).collect()
    assert {r.component_id for r in lone} == {3}


def windows_gone(rows, size=20):
    """kept words by doc_id; rows in order of doc_id."""
    first, out = {}, {}
    for i, t in rows:
        w = C.words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), (i, k))
    for i, t in rows:
        w = C.words(t)
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] != (i, k) for j in range(k, k + size)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("size", [20, 9, 5, 1])
def test_substrings(spark, size):
    rows = [(i, t) for i, t in enumerate(C.texts(), 1)]
    d = C.clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), "n_words", "n_removed", "kept")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_substrings(d, size).collect()}
    assert got == windows_gone(rows, size)
    assert any(v[1] for v in got.values())


def test_substrings_repeated_rows_and_nothing(spark):
    d = C.frame(spark)
    x = substrings.remove_substrings(d)
    assert x.count() == d.count() and x.filter("doc_id is null").first().n_removed == 0
    twice = d.filter("doc_id = 9").select("text").first().text
    assert x.filter("doc_id = 9").select("n_removed").distinct().count() == 1 and twice
    assert substrings.remove_substrings(d.limit(0)).count() == 0


def test_substrings_of_texts_with_one_short_hash(spark):
    """Texts that 32 bits don't tell apart, under one id and under null ids, are documents of their own."""
    shared = C.prose(30, 11)
    rows = [(1, f"{shared} 65510"), (5, f"{shared} 65510"), (5, "w 19262"), (None, f"{shared} 100099"), (None, f"{shared} 241535")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert d.select(F.hash("text").alias("h")).distinct().count() < 4
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for parts in (1, 4) for r in substrings.remove_substrings(d.repartition(parts)).collect())
    assert got == sorted(2 * [(0, 31, 0), (0, 31, 30), (1, 31, 30), (5, 31, 31), (5, 2, 0)])


def test_substrings_of_no_words_are_refused(spark):
    with pytest.raises(ValueError):
        substrings.remove_substrings(C.frame(spark), 0)


@pytest.mark.parametrize("kind, ids", [("long", [None, 2**53, 2**53 + 1, 2**62]), ("string", [None, "9", "b", "é"]), ("date", None), ("decimal(30,2)", None)])
def test_substrings_with_ids_of_any_kind(spark, kind, ids):
    """Equal texts under a null id and three others in order: only the first of them keeps its words."""
    x = spark.createDataFrame([(i, C.prose(25, 1)) for i in range(4)], "n long, text string").coalesce(1)
    if ids:
        x = x.join(spark.createDataFrame(list(enumerate(ids)), f"n long, doc_id {kind}"), "n")
    else:
        x = x.withColumn("doc_id", F.when(F.col("n") > 0, F.lit(7).cast(kind) if kind != "date" else F.expr("date_add(DATE'2020-01-01', cast(n as int))")))
        x = x if kind == "date" else x.withColumn("doc_id", F.col("doc_id") + F.col("n").cast(kind))
    for parts in (1, 3):
        got = {r.n: r.n_removed for r in substrings.remove_substrings(x.repartition(parts)).collect()}
        assert got == {0: 0, 1: 25, 2: 25, 3: 25}


def test_sketch_counts_are_merged_as_they_come(spark, monkeypatch):
    """Slices merged in small steps give the bits of plain counts."""
    import numpy as np

    from pulselake.llm import sketch

    monkeypatch.setattr(sketch, "FLUSH", 50)
    r = np.random.default_rng(1)
    keys = r.integers(0, 40, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.concatenate((keys, r.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)))
    rows = [(b["d"][i].as_py(), b["slice"][i].as_py(), b["cells"][i].as_py()) for p in np.array_split(keys, 7) for b in sketch.slice_rows(iter([p]), 1, 4, 16, 3, lambda k, d: k) for i in range(b.num_rows)]
    seen = sketch.bitmaps(spark.createDataFrame(rows, sketch.ROWS), 1, 4, 16, 16, (2, 3))
    values, n = np.unique(keys >> np.uint64(44), return_counts=True)
    for k, least in enumerate((2, 3)):
        want = np.zeros(1 << 20, bool)
        want[values[n >= least]] = True
        assert (np.unpackbits(seen[k, 0]).astype(bool) == want).all()


def line_sets(line):
    """Shingles from word starts only, for lines of which either kind of shingle gives the same links."""
    starts = [i for i, c in enumerate(line) if not c.isspace() and (i == 0 or line[i - 1].isspace())]
    return {line[i : i + lines.SHINGLE] for i in starts}


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil water in a copper kettle"
    near = long.replace("seven", "eight")
    rows = [(1, f"{long}\nunlike anything else\n\n"), (2, f"first of two\n{near}"), (3, f"{long}\n{long}"), (4, None), (5, ""), (6, "\n \n"), (7, "first of two"), (8, "first of three")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(C.clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n_lines", "n_removed", "g", "band")).collect()}
    u, seen = Union(), [(i, p, x) for i, t in rows if t for p, x in enumerate(t.split("\n")) if x.strip()]
    for n, (_, _, x) in enumerate(seen):
        for m, (_, _, y) in enumerate(seen[:n]):
            a, b = line_sets(x), line_sets(y)
            if x == y or 100 * len(a & b) >= 80 * len(a | b):
                u.join(m, n)
    gone = Counter(seen[n][:2] for n in range(len(seen)) if u.find(n) != n)
    for i, t in rows:
        if t is None:
            assert got[i] == (None, 0, 0)
        else:
            parts = t.split("\n")
            kept = [x for p, x in enumerate(parts) if (i, p) not in gone]
            assert got[i] == ("\n".join(kept), len(parts), len(parts) - len(kept))
    assert got[2][2] == 1 and got[3][2] == 2 and got[7][2] == 1


def test_line_dedup_of_documents(spark):
    d = C.frame(spark)
    x = lines.dedup_lines(d)
    assert x.count() == d.count() and set(x.columns) == {*d.columns, "n_lines", "n_removed"}
    kept = x.filter("text is not null").select(F.explode(F.split("text", "\n")).alias("l"), "doc_id").filter(r"l rlike '\\S'").distinct().groupBy("l").count()
    assert kept.filter("count > 1").count() == 0
    assert lines.dedup_lines(d.limit(0)).count() == 0


def test_line_dedup_of_copies_of_one_line(spark):
    """300 lines with 3 of 60 words changed: each resembles the base, hardly two each other."""
    import random

    r = random.Random(3)
    base = [f"{r.randrange(10**6):06d}" for _ in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        for k in r.sample(range(60), 3):
            w[k] = f"{r.randrange(10**6):06d}"
        rows.append((i, " ".join(w)))
    sets = [line_sets(x) for _, x in rows]
    u = Union()
    for n, a in enumerate(sets):
        for m, b in enumerate(sets[:n]):
            if 100 * len(a & b) >= 80 * len(a | b):
                u.join(m, n)
    brute = len({u.find(n) for n in range(300)})
    left = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed = 0").count()
    # Lines of similarity 0.8 share no band with probability 0.014.
    assert brute <= left <= brute + 15


def test_line_dedup_reads_long_words_to_the_end(spark):
    """Lines without white space that share their first 8 characters stay; near copies of such lines go."""
    rows = [(1, "https://a.org/x"), (2, "https://b.com/y"), (3, "统一资源定位符表示一个地址"), (4, "统一资源定位符表不同的东西在这里"), (5, "x" * 8), (6, "x" * 8 + "abc")]
    long = hashlib.sha512(b"a").hexdigest()
    rows += [(7, long), (8, long[:-1] + "z"), (9, long[:8] + hashlib.sha512(b"b").hexdigest())]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i == 8) for i in range(1, 10)}


def test_hashes_in_queries(spark, sf):
    got = {r.doc_id: r for r in substrings.op9_substrings(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    for i, (n, gone, kept) in windows_gone(rows).items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_op4_query(spark, sf):
    got = ngram_join.op4_ngram_join(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == groups(rows, 4, 85)


def all_shingles(line):
    """The shingles of a line by definition: SHINGLE characters from every place on, or the whole of a shorter line."""
    return {line[i : i + lines.SHINGLE] for i in range(max(1, len(line) - lines.SHINGLE + 1))}


def brute_lines(rows, percent=80):
    """Links and the number of lines that go, of rows with one line each and distinct ids."""
    sets = [all_shingles(x) for _, x in rows]
    u, links = Union(), 0
    for n, a in enumerate(sets):
        for m, b in enumerate(sets[:n]):
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                links += 1
                u.join(m, n)
    return links, {rows[n][0] for n in range(len(rows)) if u.find(n) != n}


def test_line_dedup_finds_families(spark):
    """1,000 lines: 40 families of 25 near copies with 1 to 4 of 40 words changed; at least 0.95 of what brute force removes goes, and nothing else."""
    import random

    r, rows = random.Random(11), []
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10)))
    for _ in range(40):
        base = [word() for _ in range(40)]
        for _ in range(25):
            w = list(base)
            for k in r.sample(range(40), r.randrange(1, 5)):
                w[k] = word()
            rows.append((len(rows), " ".join(w)))
    _, brute = brute_lines(rows)
    got = {x.doc_id for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).filter("n_removed > 0").collect()}
    assert got <= brute and len(got) >= 0.95 * len(brute) > 200


def test_line_dedup_of_a_group_below_the_threshold(spark):
    """400 lines that share a band with the base but hardly resemble each other, and chains among them: no link of a band is lost."""
    import random

    r = random.Random(5)
    base = [f"{r.randrange(10**6):06d}" for _ in range(60)]
    rows, w = [(0, " ".join(base))], list(base)
    for i in range(1, 400):
        w = list(base) if i % 4 == 1 else w
        for k in r.sample(range(60), 5):
            w[k] = f"{r.randrange(10**6):06d}"
        rows.append((i, " ".join(w)))
    links, brute = brute_lines(rows)
    left = {x.doc_id for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed = 0").collect()}
    assert links and left >= set(range(400)) - brute and len(left) <= 400 - 0.95 * len(brute)


def test_line_dedup_keeps_unlike_lines_without_spaces(spark):
    rows = [
        (1, "https://example.com/alpha"), (2, "https://other.org/beta"), (3, "量子力学描述微观粒子的运动规律和性质"), (4, "量子力学描述猫和狗在花园里的快乐生活"), (5, "1234567890123"), (6, "12345678999"),
        (7, "internationalization guidelines"), (8, "internationally guidelined"), (9, "é" * 5), (10, "\U0001f600\U0001f601\U0001f602"), (11, "a"), (12, "b"),
    ]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed > 0").collect()
    assert not got


def test_line_dedup_of_very_long_lines(spark):
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(20_000))
    rows = [(1, long), (2, long.replace("w7919 ", "changed ")), (3, long[::-1]), (4, "x" * 50_000), (5, "x" * 50_001)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_line_dedup_with_null_ids_and_repeated_rows(spark):
    rows = [(None, "one line that is there twice"), (None, "one line that is there twice"), (5, "one line that is there twice"), (5, "another line\nanother line"), (5, "another line\nanother line")]
    got = sorted(((r.doc_id or 0, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 0), (0, 0), (5, 1), (5, 1), (5, 1)]


def test_line_dedup_sets_of_shingles(spark):
    """Characters beyond the basic plane are one character each, and a shingle that is there twice counts once."""
    rows = [("",), ("short",), ("sixsix",), ("abc" * 20,), ("统一资源定位符表示一个地址",), ("".join(chr(0x1F600 + i) for i in range(30)) + " and some words",), ("é\U0001f600" * 9,)]
    got = spark.createDataFrame(rows, "line string").select("line", F.size(lines.shingles(F.col("line"))).alias("n")).collect()
    assert {r.line: r.n for r in got} == {x: len(all_shingles(x)) for x, in rows}


def test_line_dedup_links_roots_in_later_turns(spark, monkeypatch):
    """Turns after the first give union-find links between components, not all that was linked before."""
    import random

    r = random.Random(7)
    base = [f"{r.randrange(10**6):06d}" for _ in range(60)]
    rows, w = [(0, " ".join(base))], list(base)
    for i in range(1, 300):
        w = list(base) if i % 3 == 1 else w
        for k in r.sample(range(60), 4):
            w[k] = f"{r.randrange(10**6):06d}"
        rows.append((i, " ".join(w)))
    given, components = [], lines.components

    def record(links, a="a", b="b"):
        given.append([(x[a], x[b]) for x in links.collect()])
        return components(links, a, b)

    monkeypatch.setattr(lines, "components", record)
    lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).count()
    root: dict = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    first, *later, _ = given
    assert later
    for links in [first, *later]:
        if links is not first:
            assert all(find(x) == x for link in links for x in link)
        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)


def test_line_dedup_deals_bands_once(spark, monkeypatch):
    """Bands of few lines are dealt and read once: no aggregation by band, and the rows and hubs that brute force finds."""
    rows = [(b, k) for b in range(400) for k in range(b, b + (b % 5 == 0) * (b % 7) + 1)]
    d = spark.createDataFrame(rows, "band long, kl long").repartition(3)
    x = lines._shared_once(d)
    by = {}
    for b, k in rows:
        by.setdefault(b, set()).add(k)
    want = sorted((b, k, min(ks)) for b, ks in by.items() if len(ks) > 1 for k in ks)
    assert sorted(map(tuple, x.select("band", "kl", "hub").collect())) == want
    plan = x._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan
    used, once = [], lines._shared_once
    monkeypatch.setattr(lines, "_shared_once", lambda each: used.append(1) or once(each))
    lines.line_links(C.frame(spark).select("doc_id", "text"))
    assert used
