"""Fuzzy line dedup by MinHash (native)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, checkpoint, components, sized, table

#: Characters of a shingle; a line has one at every place, and a shorter line is one shingle.
SHINGLE = 6
#: Minima of a signature, and bands of ROWS minima each. Lines of similarity 0.8 share a band with probability 0.97, of 0.85 with 0.99.
MINIMA, BANDS, ROWS = 21, 12, 5
#: Band b takes the minima b + d modulo MINIMA. Any two bands share one minimum: all differences of these numbers differ.
DIFFERENCES = (0, 1, 4, 14, 16)
#: Places of a line that one row stands for while its minima are taken.
BLOCK = 4
#: log2 of the most values that a broadcast filter of keys can have.
FILTER_BITS = 21
#: log2 of the buckets by which bands that many lines share are noticed.
BUCKET_BITS = 16
#: Longs of a sketch: each shingle of a line sets one of 64 * SKETCH bits.
SKETCH = 16
#: Each turn has so many times the hubs of the turn before.
MORE_HUBS = 8
#: Narrow rows that a row with a line's text counts as when tasks are sized.
TEXT = 16


def shingles(line: Column) -> Column:
    """The distinct shingles of a line, as 64-bit hashes: SHINGLE characters from every place on, or the whole of a shorter line."""
    last = lambda b: F.greatest(F.lit(1), F.length(b) - (4 * SHINGLE - 1))
    of = lambda b: F.array_distinct(F.transform(F.sequence(F.lit(1), last(b), F.lit(4)), lambda p: F.xxhash64(F.substring(b, p, F.lit(4 * SHINGLE)))))
    return F.transform(F.array(F.encode(line, "UTF-32")), of)[0]  # so that a line is encoded once, not for each place


def _places(lines: DataFrame, keep: list[str], step: int, code: str, width: int) -> tuple[DataFrame, Callable[[int], Column]]:
    """For every step-th place of each line: keep, whether it is the first, and what gives the shingle at the i-th place from there (or the last one).

    Shingles are cut from the bytes of the line in a code of so many bytes a character, where any place is reached at once.
    """
    last = F.greatest(F.lit(1), F.length("_b") - width * SHINGLE + 1)
    x = lines.select(*keep, F.encode("line", code).alias("_b")).withColumn("_last", last)
    x = x.select(*keep, "_b", "_last", F.explode(F.sequence(F.lit(1), "_last", F.lit(width * step))).alias("_p"))
    return x.withColumn("first", F.col("_p") == 1), lambda i: F.substring(F.col("_b"), F.least(F.col("_p") + width * i, F.col("_last")), F.lit(width * SHINGLE))


def _signed(lines: DataFrame) -> DataFrame:
    """(kl, kr, n, bands) for each distinct line: its number of occurrences, and a key for each band of its minima.

    A shingle's hash crossed with MINIMA constants orders shingles in so many ways; the least under
    each is taken over every place of the line, BLOCK places a row.
    """
    each, shingle = _places(lines, ["kl", "kr"], BLOCK, "UTF-16BE", 2)
    each = each.select("kl", "kr", "first", *(F.hash(shingle(i)).alias(f"h{i}") for i in range(BLOCK)))
    order = [(k * 0x9E3779B9 + 0x7F4A7C15) % 2**32 - 2**31 for k in range(MINIMA)]
    minima = [F.min(F.least(*(F.col(f"h{i}").bitwiseXOR(F.lit(c)) for i in range(BLOCK)))).alias(f"m{k}") for k, c in enumerate(order)]
    signed = each.groupBy("kl", "kr").agg(F.sum(F.when(F.col("first"), 1).otherwise(0)).alias("n"), *minima)
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.col(f"m{(b + d) % MINIMA}") for d in DIFFERENCES)) for b in range(BANDS)))
    return signed.select("kl", "kr", "n", bands.alias("bands"))


def _lines(docs: DataFrame) -> DataFrame:
    """The lines with a word, and 128 bits (kl, kr) that stand for a line's text."""
    split = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    x = docs.select("doc_id", F.xxhash64("text").alias("text_id"), split).filter(F.col("line").rlike(r"\S"))
    return x.withColumns({"kl": F.xxhash64("line"), "kr": F.xxhash64(F.lit(1), "line")})


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Most of the rows whose kl is not in keys are left out before any shuffle, and none that is.

    What is broadcast are leading bits of keys, at most 2 ** FILTER_BITS distinct numbers (some 32 MB).
    """
    lead = F.shiftrightunsigned("kl", 64 - FILTER_BITS)
    few = keys.select(lead.alias("_lead")).distinct()
    return rows.withColumn("_lead", lead).join(F.broadcast(few), "_lead", "left_semi").drop("_lead")


def _shared(each: DataFrame) -> DataFrame:
    """The rows (band, kl) of bands with several lines, and each band's first line as hub."""
    ends = each.groupBy("band").agg(F.min("kl").alias("hub"), F.max("kl").alias("hi")).filter("hub < hi").select("band", "hub")
    return each.select("band", "kl").join(ends.hint("shuffle_hash"), "band")  # few bands are shared, and the rows of all need no sort


def _shared_once(each: DataFrame) -> DataFrame:
    """As _shared, for bands of few lines: one shuffle and sort by band, read once, where the two aggregations of _shared keep a row for each band in memory."""
    lines = Window.partitionBy("band")
    x = each.select("band", "kl", F.min("kl").over(lines).alias("hub"), F.max("kl").over(lines).alias("hi"))
    return x.filter("hub < hi").select("band", "kl", "hub")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs (a, b, ...) whose sets of shingles have a Jaccard similarity of at least percent / 100. rows: how many texts there are."""
    among = lambda end, line: _among(texts, pairs.select(F.col(end).alias("kl"))).select(F.col("kl").alias(end), F.col("line").alias(line))
    of = among("a", "la").join(pairs.select("a").distinct(), "a", "left_semi").repartition("a")
    x = sized(pairs.join(among("b", "lb"), "b"), TEXT * rows)
    # The set of a is made once for all its pairs, where the pairs meet it: texts are dealt, not sets.
    x = x.join(of.select("a", shingles(F.col("la")).alias("sa")), "a")
    x = x.select(*pairs.columns, F.explode(F.array(F.struct("sa", shingles(F.col("lb")).alias("sb")))).alias("s"))  # so that sets are made once, not for each use
    return x.filter((100 + percent) * F.size(F.array_intersect("s.sa", "s.sb")) >= percent * (F.size("s.sa") + F.size("s.sb"))).select(*pairs.columns)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after links (u, v) between roots, or between lines that are in no component yet."""
    top = components(links, "u", "v")
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return moved.select("node", F.coalesce("top", "root").alias("root")).union(top).distinct()


def _apart(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """The lines (band, kl, ...) of bands whose lines lie in several components, with their root and the band's number of lines c."""
    x = lines.join(roots.select(F.col("node").alias("kl"), "root"), "kl", "left").withColumn("root", F.coalesce("root", "kl"))
    bounds = x.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo < hi").select("band", "c")
    return x.join(bounds, "band")


def _sketched(texts: DataFrame) -> DataFrame:
    """(kl, n, k) for each of texts: its number of places, and a sketch in which each shingle sets one of 64 * SKETCH bits."""
    x, shingle = _places(texts, ["kl"], BLOCK, "UTF-32", 4)
    x = x.select("kl", F.when(F.col("first"), F.col("_last")).otherwise(0).alias("n"), *(F.hash(shingle(i)).alias(f"h{i}") for i in range(BLOCK)))
    x = x.select("kl", "n", *(_slot(f"h{i}").alias(f"w{i}") for i in range(BLOCK)), *(_bit(f"h{i}").alias(f"b{i}") for i in range(BLOCK)))
    word = lambda j: reduce(Column.bitwiseOR, (F.when(F.col(f"w{i}") == j, F.col(f"b{i}")).otherwise(F.lit(0).cast("long")) for i in range(BLOCK)))
    x = x.groupBy("kl").agg(((F.sum("n") + 3) / 4).cast("long").alias("n"), *(F.bit_or(word(j)).alias(f"k{j}") for j in range(SKETCH)))
    return x.select("kl", "n", F.struct(*(f"k{j}" for j in range(SKETCH))).alias("k"))


def _parity(texts: DataFrame) -> DataFrame:
    """(kl, n, k) for each of texts: its number of distinct shingles, and a sketch in which each of these turns a bit over. Closer than _sketched, and dearer."""
    x = texts.repartition("kl").select("kl", F.explode(shingles(F.col("line"))).alias("h")).select("kl", _slot("h").alias("w"), _bit("h").alias("b"))
    longs = [F.bit_xor(F.when(F.col("w") == j, F.col("b")).otherwise(F.lit(0).cast("long"))).alias(f"k{j}") for j in range(SKETCH)]
    return x.groupBy("kl").agg(F.count("*").alias("n"), *longs).select("kl", "n", F.struct(*(f"k{j}" for j in range(SKETCH))).alias("k"))


def _slot(h: str) -> Column:
    return F.shiftright(h, 6).bitwiseAND(F.lit(SKETCH - 1))


def _bit(h: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({h} & 63 as int))")


def _can_link(percent: int) -> Column:
    """False only for lines whose similarity is less: they differ in at least as many shingles as bits of their sketches (of either kind) differ, and have at most n shingles each."""
    n = F.col("n") + F.col("h.n")
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"k.k{i}").bitwiseXOR(F.col(f"h.k.k{i}"))) for i in range(SKETCH)))
    return differ * (100 + percent) <= n * (100 - percent)


def _pair() -> list[Column]:
    return [F.least("kl", "h.kl").alias("a"), F.greatest("kl", "h.kl").alias("b")]


def line_links(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(keys, links): (kl, kr, n) for each distinct line with its number of occurrences, and (a, b): kl of similar lines.

    One aggregation makes each line's minima over its shingles, and joins equal lines, since equal
    lines have equal minima; its map side leaves one row for each distinct line and task. Lines of a
    band are tested against its first line, which in a group of near copies is the same for most
    bands, so such a group makes few pairs. While lines of a band lie in different components, more
    of its lines become hubs that the others are tested against, MORE_HUBS times as many each turn,
    until all its lines are hubs. So lines of a band that link are never left in two components, and
    large groups shrink by few hubs before many are taken; pairs within a component need no test, nor
    do pairs whose sketches differ in too many bits. Candidates are verified by the exact Jaccard
    similarity of their sets of shingles. links are those that components need.
    """
    lines = _lines(docs)
    keys = checkpoint(_signed(lines))
    each = keys.select("kl", F.explode("bands").alias("band"))
    # Bands are dealt once where no bucket of bands is large; the rows of large buckets are summed
    # before they are dealt, and Spark splits their join.
    lead = F.shiftrightunsigned("band", 64 - BUCKET_BITS)
    mean = keys.count() * BANDS / 2**BUCKET_BITS
    some = each.filter(F.col("kl").bitwiseAND(F.lit(15)) == 0)  # enough to see what is large; all rows go on
    large = some.groupBy(lead.alias("_lead")).agg(F.count("*").alias("n")).filter(16 * F.col("n") > 8 * mean + 1000).select("_lead")
    each = each.withColumn("_lead", lead)
    large = F.broadcast(checkpoint(large))  # under 2 ** BUCKET_BITS / 8 numbers
    members = _shared_once(each.join(large, "_lead", "left_anti")).union(_shared(each.join(large, "_lead", "left_semi")))
    members = checkpoint(members)
    ends = members.select("kl").distinct()
    texts = checkpoint(_among(lines.select("kl", "line"), ends).join(ends, "kl", "left_semi").dropDuplicates(["kl"]))
    rows = texts.count()
    texts = sized(texts, TEXT * rows)
    known = checkpoint(_sketched(texts))
    tested = members.filter("kl != hub").select("kl", "hub").distinct().join(known, "kl").join(known.select(F.col("kl").alias("hub"), F.struct(F.col("kl"), "n", "k").alias("h")), "hub")
    tested = checkpoint(sized(tested.filter(_can_link(percent)).select(*_pair()), rows))
    roots = sized(checkpoint(components(checkpoint(sized(_linked(tested, texts, percent, rows), rows)))), rows)
    left = _apart(members.filter("kl != hub").select("band", "kl"), roots).drop("root", "c")  # hubs met all lines of their bands
    left = checkpoint(left.select("band", "kl"))
    n = left.count()
    if n:
        left = checkpoint(left.join(_parity(texts.join(left.select("kl").distinct(), "kl", "left_semi")), "kl"))
    left = sized(left, n)
    hubs, most = MORE_HUBS, 2
    while n and hubs // MORE_HUBS < most:
        out = checkpoint(sized(_apart(left, roots), n))
        most = out.agg(F.max("c")).first()[0] or 0
        if not most:
            break
        chosen = F.pmod(F.xxhash64("kl", "band"), F.lit(1 << 20)) * F.col("c") < hubs << 20
        other = out.filter(chosen).select("band", F.struct("kl", "n", "k", "root").alias("h"))
        more = sized(out.join(other, "band"), n).filter((F.col("root") != F.col("h.root")) & _can_link(percent))
        more = more.select(*_pair(), F.least("root", "h.root").alias("u"), F.greatest("root", "h.root").alias("v")).distinct()
        hubs *= MORE_HUBS
        more = checkpoint(sized(more.join(tested, ["a", "b"], "left_anti"), n))
        if more.isEmpty():
            continue
        tested = tested.union(more.select("a", "b"))
        links = checkpoint(sized(_linked(more, texts, percent, rows).select("u", "v").distinct(), n))
        if not links.isEmpty():
            roots = sized(checkpoint(_joined(roots, links)), rows)
    return keys.select("kl", "kr", "n"), roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


@aside("doc_id", "text")
def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with n_lines, n_removed, and text without the lines that resemble an earlier one.

    Lines link when the Jaccard similarity of their sets of shingles is at least percent / 100, found
    by MinHash and verified exactly; of each component of links the first line stays, by (doc_id, hash
    of the text, place), and all others go. Equal lines always link. Lines without a word are kept
    and never counted as copies. Null texts stay null and have 0 lines; a text whose lines all go
    is empty. A null doc_id comes first; rows with the same doc_id and text are one document and get
    the same result. Columns n_lines and n_removed of docs are replaced, other columns stay.
    """
    docs = docs.drop("n_lines", "n_removed")
    keys, links = line_links(docs, percent)
    roots = components(links)
    keys = keys.join(roots.select(F.col("node").alias("kl"), "root"), "kl", "left").filter("n > 1 or root is not null")
    keys = checkpoint(keys.select("kl", "kr", F.coalesce("root", "kl").alias("g"), F.when(F.col("root").isNull(), F.col("kr")).otherwise(0).alias("g2")))
    found = _among(_lines(docs).select("doc_id", "text_id", "pos", "kl", "kr"), keys).join(keys, ["kl", "kr"]).select("g", "g2", F.struct("doc_id", "text_id", "pos").alias("at"))
    found = checkpoint(found)
    first = found.groupBy("g", "g2").agg(F.min("at").alias("first"))
    gone = found.join(first, ["g", "g2"]).filter("at > first").groupBy("at.doc_id", "at.text_id").agg(F.collect_set("at.pos").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_i"), "_gone").hint("shuffle_hash")  # a row a document; so texts need no sort
    x = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_i")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    new = {
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long"),
    }
    return x.withColumns(new).withColumn("text", kept).drop("_d", "_i", "_gone")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = dedup_lines(docs)
    return x.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
