"""Exact n-gram Jaccard self-join, filtered under several global token orders."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, table, with_fields
from .kernel import lower, mix, text_blocks, windows, word_hashes, words
from .sketch import ROWS, bitmaps, clipped, lookup, slice_rows, words_log

#: Shingles are counted by LOW_BITS bits within a slice. There are 2 ** FEWEST slices, so that what tasks give out grows with the words only,
#: up to where one would be for more than 2 ** SLICE_LOAD words, beyond that more of them, 2 ** SLICES at most.
LOW_BITS, FEWEST, SLICE_LOAD, SLICES = 32, 8, 23, 18
#: A shingle of at least so many documents is common: it comes last in every order.
COMMON = 32
#: Sets that share a prefix token are compared pair by pair up to this number, beyond it with hubs.
PAIRWISE = 16
#: log2 of the bits that mark the sets to verify.
MARK_BITS = 23
#: Orders after the first that a pair must also share a prefix token in.
ORDERS = (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)
#: Longs of a set's parity sketch, and of the marks of its prefix tokens in each of ORDERS.
PARITY, MARKS = 8, 4
#: Each turn has so many times the hubs of the turn before.
MORE_HUBS = 8
#: Tokens in a batch that a task gives out, and keys that it sorts at once: both bound its memory.
OUT_TOKENS, FLUSH = 1 << 19, 1 << 20


def shingle_sets(column: pa.Array, size: int):
    """For each row of a column of texts: the distinct shingles, A-Z in lower case, as sorted 64-bit hashes."""
    for first, data, offsets in text_blocks(column):
        data = lower(data)
        starts, ends, rows = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        shingles, at = windows(hashes, rows, size)
        owner = rows[at]
        n_words = np.bincount(rows, minlength=len(offsets) - 1)
        for n in range(1, size):  # texts of fewer words: the whole sequence
            short = np.flatnonzero(n_words == n)
            if len(short):
                begin = np.searchsorted(rows, short)
                one, _ = windows(hashes[(begin[:, None] + np.arange(n)).ravel()], np.repeat(short, n), n)
                shingles, owner = np.concatenate((shingles, one)), np.concatenate((owner, short))
        order = np.lexsort((shingles, owner))
        shingles, owner = shingles[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])))) if len(shingles) else []
        shingles, owner = shingles[new], owner[new]
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield first + i, shingles[cuts[i] : cuts[i + 1]]


def node_of(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a, b = (mix(tokens + np.uint64(c)).sum(dtype=np.uint64) for c in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47))
    return np.array([a, b ^ np.uint64(len(tokens))], ">u8").tobytes()


def prefix(tokens: np.ndarray, level: np.ndarray, factor: int | None, percent: int) -> np.ndarray:
    """Indices of the first tokens in an order: by level, then by hash. Two sets whose Jaccard similarity
    is at least percent share one of them, whatever the order is."""
    n = len(tokens)
    size = n - -(-n * percent // 100) + 1
    return np.lexsort((tokens if factor is None else mix(tokens * np.uint64(factor)), level))[:size]


def _levels(tokens: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return lookup(seen[0, 0], tokens).astype(np.int8) + lookup(seen[1, 0], tokens)


def sketches(tokens: np.ndarray, firsts: list[np.ndarray]) -> np.ndarray:
    """PARITY longs in which each token turns one bit over, then MARKS longs for each of ORDERS, in which its shared prefix tokens (firsts) set bits.

    Sets differ in at least as many tokens as bits of their parity sketches differ. Sets that link
    share a prefix token in every order, and so a bit of its marks.
    """
    out = [np.bincount((tokens & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1]
    for first in firsts:
        out.append(np.bincount((first & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) > 0)
    return np.packbits(np.concatenate(out).astype(np.uint8), bitorder="little").view(np.int64)


def _can_link(x, y, percent: int) -> Column:
    """False only for sets whose similarity is less, or whose prefix tokens have no mark in common in some order. x, y: give the columns n, m and s of two sets by name."""
    n = x("n") + y("n")
    known = F.least(x("m"), y("m")) * (100 + percent) >= n * percent  # at most the known shingles of either are shared
    differ = reduce(lambda a, b: a + b, (F.bit_count(x("s")[i].bitwiseXOR(y("s")[i])) for i in range(PARITY)))
    meet = [reduce(lambda a, b: a.bitwiseOR(b), (x("s")[PARITY + k * MARKS + i].bitwiseAND(y("s")[PARITY + k * MARKS + i]) for i in range(MARKS))) != 0 for k in range(len(ORDERS))]
    return reduce(lambda a, b: a & b, [known, differ * (100 + percent) <= n * (100 - percent), *meet])


def _meet(pairs: DataFrame, prefixes: DataFrame, report: list | None = None) -> DataFrame:
    """The pairs (a, b) whose prefix tokens intersect under each of ORDERS, too.

    prefixes has node and p, whose columns have a set's prefix tokens, cut to 32 bits, which lose no pair.
    To report is added how many pairs came and how many were left after each order.
    """
    t = pairs.join(prefixes.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b").join(prefixes.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
    share = [F.arrays_overlap(f"pa.p{k}", f"pb.p{k}") for k in range(len(ORDERS))]
    if report is not None:
        upto = [F.count_if(reduce(lambda a, b: a & b, share[: k + 1])) for k in range(len(ORDERS))]
        report.append(tuple(t.agg(F.count("*"), *upto).first()))
    return t.filter(reduce(lambda a, b: a & b, share)).select("a", "b")


def _marked(nodes: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** MARK_BITS bits (1 MB) of the leading bits of nodes, built by slices of 4 KB in Spark."""
    mark = F.shiftright(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long"), 32 - MARK_BITS) + 1
    slices = nodes.select(mark.alias("m")).groupBy(F.bitmap_bucket_number("m").alias("s")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits"))
    out = np.zeros((1 << MARK_BITS) // 8, np.uint8)
    for s, bits in slices.collect():  # at most 2 ** MARK_BITS / 2 ** 15 rows
        out[(s - 1) * 4096 : s * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _token_sets(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, tokens) of the given nodes: their sets are made again from the texts, and kept for all tests of pairs.

    Most other documents are passed over by a bitmap before anything is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_marked(nodes))

    def found(out):
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([t for _, t in out], pa.list_(pa.int64()))], names=["node", "tokens"])

    def sets(batches):
        for b in batches:
            out, done, held = [], set(), 0
            for _, tokens in shingle_sets(b.column(0), size):
                if len(tokens):
                    node = node_of(tokens)
                    m = int.from_bytes(node[:4], "big") >> (32 - MARK_BITS)
                    if sent.value[m >> 3] >> (m & 7) & 1 and node not in done:
                        done.add(node)
                        out.append((node, tokens.view(np.int64)))
                        held += len(tokens)
                if held >= OUT_TOKENS:
                    yield found(out)
                    out, held = [], 0
            yield found(out)

    return checkpoint(docs.select("text").mapInArrow(sets, "node binary, tokens array<bigint>").join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def _verify(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    # A set is moved once for each of its pairs; splits of a large key repeat one set only.
    t = pairs.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    t = t.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    common = F.size(F.array_intersect("ta", "tb"))
    t = t.select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).alias("n"))
    return t.filter((F.col("common") > 0) & (F.col("common") * (100 + percent) >= F.col("n") * percent)).select("a", "b")


def ngram_groups(docs: DataFrame, size: int = 4, percent: int = 85, report: list | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Rows link when the Jaccard similarity of their sets of shingles of size words is at least
    percent / 100; component_id is the smallest doc_id that links reach. Exact but for 64-bit hashes.

    Equal sets are one node from the start, so copies are never paired. Shingles are counted over
    all rows; every order puts those of one document first, then others, then common ones, each by
    another hash. Two linked sets share a prefix token in every order. Prefix tokens of the first
    order are joined, without those that a single document holds. Sketches of fixed size rule out
    pairs that differ in more shingles than linked sets can, or whose marks of prefix tokens do not
    meet (_can_link); of what they let through, the prefix tokens themselves must intersect under every
    other order (_meet), all before any whole set is moved or intersected. A list given as report gets
    a tuple for each turn: pairs before, and after each further order. Up to PAIRWISE sets
    of a token are paired. More are tested with the token's hub, the set with the fewest shingles of
    its own; while sets of a token lie in different components, more of its sets become hubs,
    MORE_HUBS times as many each turn, until all have met. Pairs already in one component need no test.

    Null and empty texts have no shingles, link with nothing and are their own component. Rows with
    the same doc_id and text fall together; a null doc_id is ignored as the smallest, unless all
    are null. An empty table gives no rows. Other columns of docs are not returned.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession

    bits = words_log(docs)
    slice_bits = max(FEWEST, min(SLICES, bits - SLICE_LOAD))
    index_bits = clipped(bits) - 1 - slice_bits

    def count(batches):
        yield from slice_rows((t for b in batches for _, t in shingle_sets(b.column(0), size)), 1, slice_bits, LOW_BITS, COMMON, lambda keys, d: keys, FLUSH)

    seen = spark.sparkContext.broadcast(bitmaps(docs.select("text").mapInArrow(count, ROWS), 1, slice_bits, LOW_BITS, index_bits, (2, COMMON)))

    def given(ids, out):
        names, sizes, known, tokens, sketched, others = zip(*out)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(tokens, longs), pa.array(sketched, longs), *(pa.array([o[k] for o in others], ints) for k in range(len(ORDERS)))], names=schema.names
        )

    def nodes(batches):
        for b in batches:
            out, done, first_row, held = [], set(), 0, 0
            for _, t in shingle_sets(b.column(1), size):
                node = node_of(t) if len(t) else None
                if node in done or not len(t):  # a copy: its set's tokens are there
                    out.append((node, len(t), 0, None, None, [None] * len(ORDERS)))
                else:
                    done.add(node)
                    level = _levels(t, seen.value)
                    first = prefix(t, level, None, percent)
                    firsts = [prefix(t, level, factor, percent) for factor in ORDERS]
                    firsts = [t[f[level[f] > 0]] for f in firsts]
                    out.append((node, len(t), int((level > 0).sum()), t[first[level[first] > 0]].view(np.int64), sketches(t, firsts), [f.astype(np.uint32).view(np.int32) for f in firsts]))
                    held += sum(map(len, firsts)) + len(out[-1][3])
                if held >= OUT_TOKENS:
                    yield given(b.column(0).slice(first_row, len(out)), out)
                    first_row, out, held = first_row + len(out), [], 0
            if out:
                yield given(b.column(0).slice(first_row), out)

    from pyspark.sql.types import ArrayType, IntegerType, LongType

    schema = with_fields(docs.select("doc_id").schema, node="binary", n_shingles="long", known="long").add("tokens", ArrayType(LongType())).add("s", ArrayType(LongType()))
    for k in range(len(ORDERS)):
        schema = schema.add(f"p{k}", ArrayType(IntegerType()))
    d = checkpoint(docs.mapInArrow(nodes, schema))
    posts = d.filter("tokens is not null").select(F.explode("tokens").alias("token"), "node", F.col("n_shingles").alias("n"), F.col("known").alias("m")).distinct()
    # A hub has the fewest shingles of its own, so what links with any set of its token links with it as a rule.
    counts = posts.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct((F.col("n") - F.col("m")).alias("u"), "node")).alias("h")).filter("c > 1")
    posts = posts.join(counts.select("token", "c", F.col("h.node").alias("hub")), "token")
    few = posts.filter(F.col("c") <= PAIRWISE).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "n", "m"))).alias("s"))
    near = lambda x, y: F.least(x["m"], y["m"]) * (100 + percent) >= (x["n"] + y["n"]) * percent
    rest = lambda i: F.slice("s", i + 2, F.size("s"))
    each = F.flatten(F.transform("s", lambda x, i: F.transform(F.filter(rest(i), lambda y: near(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    few = few.select(F.explode(each).alias("p")).select("p.a", "p.b")
    many = checkpoint(posts.filter(F.col("c") > PAIRWISE).select("token", "node", "hub"))
    pairs = few.union(many.filter("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct()
    known = d.filter("tokens is not null").select("node", F.struct(F.col("n_shingles").alias("n"), F.col("known").alias("m"), "s").alias("x")).dropDuplicates(["node"])
    pairs = pairs.join(known.select(F.col("node").alias("b"), F.col("x").alias("y")), "b").join(known.withColumnRenamed("node", "a"), "a")
    tested = checkpoint(pairs.filter(_can_link(lambda c: F.col("x")[c], lambda c: F.col("y")[c], percent)).select("a", "b"))
    prefixes = d.filter("tokens is not null").select("node", F.struct(*(f"p{k}" for k in range(len(ORDERS)))).alias("p")).dropDuplicates(["node"])
    met = checkpoint(_meet(tested, prefixes, report))
    # Sets of large tokens may meet other sets later on, so theirs are kept too.
    sets = _token_sets(met.select(F.col("a").alias("node")).union(met.select("b")).union(many.select("node")).distinct(), docs, size)
    roots = checkpoint(components(checkpoint(_verify(met, sets, percent))))

    def split(left: DataFrame) -> DataFrame:
        """Tokens' sets with their components and the token's number of sets c, of tokens whose sets aren't all in one."""
        m = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        bounds = m.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
        return m.join(bounds.select("token", "c"), "token")

    left = many if many.isEmpty() else checkpoint(split(many.filter("node != hub").drop("hub")).drop("root", "c").join(known, "node").select("token", "node", "x.n", "x.m", "x.s"))
    hubs, most = MORE_HUBS, 0 if many.isEmpty() else 2
    while hubs // MORE_HUBS < most:
        out = checkpoint(split(left))
        most = out.agg(F.max("c")).first()[0] or 0
        if not most:
            break
        chosen = (F.pmod(F.xxhash64("node", "token"), F.lit(1 << 20)) * F.col("c") < hubs << 20) & (F.col("m") * (100 + percent) >= F.col("n") * (2 * percent))
        other = out.filter(chosen).select("token", F.struct("node", "n", "m", "s", "root").alias("h"))  # of two sets that link, one at least has few shingles of its own
        link = (F.col("root") != F.col("h.root")) & _can_link(F.col, lambda c: F.col(f"h.{c}"), percent)
        p = out.join(other, "token").filter(link).select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()
        hubs *= MORE_HUBS
        p = checkpoint(p.join(tested, ["a", "b"], "left_anti"))
        if p.isEmpty():
            continue
        tested = tested.union(p)
        # What is known already are stars, so joining the new links takes few rounds.
        roots = checkpoint(components(roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(_verify(_meet(p, prefixes, report), sets, percent))))
    d = d.select("doc_id", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = d.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    d = d.join(least, "root", "left")
    return d.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-equal texts of ``documents``."""
    return ngram_groups(table(spark, sf_dir, "documents"))
