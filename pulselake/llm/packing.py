"""Best-fit packing of tokenised documents by a linear grouping scheme."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, checkpoint, table, with_fields

CAPACITY = 2048
#: Lengths over CAPACITY / SMALL are large; they are rounded up within GROUPS groups of equal cardinality.
SMALL, GROUPS = 4, 128
#: Configurations that the optimisation adds at most, a gain below which it stops, and steps without gain after which it does.
COLUMNS, GAIN, STALL = 400, 1e-3, 40
#: Room that actual large pieces may leave in a sequence that stays as it is; the best of these limits is taken.
OPEN = (0, 1, 2, 4, 8, 16, 32, 64)
#: Blocks that pieces of one length are dealt to by hash for their numbering.
BLOCKS = 256
END = 0


def encoder(path: str):
    """The vocabulary as a tiktoken encoding.

    A .json path takes the merges from the ranks file beside it, whose ids are the same, and the
    special tokens from the .json file itself.
    """
    import public_tokenizers
    import tiktoken

    special = {}
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    path = path.removesuffix(".json").removesuffix(".tiktoken") + ".tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(encoding, text: str) -> list[int]:
    """The ids of a text; the string of a special token is that token, as the public file has it."""
    if any(t in text for t in encoding.special_tokens_set):
        return encoding.encode(text, allowed_special="all")
    return encoding.encode_ordinary(text)


PIECE = {"piece": "integer", "start": "long", "length": "long", "ids_crc32": "long"}


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs without text, a row for each piece: PIECE, and with_ids the ids (array<int>).

    A document is the ids of its text and one END. Longer ones than capacity are cut into full
    pieces; only the first may be shorter. A null or empty text is END alone. vocabulary is a path, or
    the name of a public vocabulary that each worker looks up.
    """
    docs = docs.drop(*PIECE, "ids")
    schema = with_fields(docs.drop("text").schema, **PIECE)
    if with_ids:
        from pyspark.sql.types import ArrayType, IntegerType

        schema = schema.add("ids", ArrayType(IntegerType()))
    names = schema.names

    def run(batches):
        import public_tokenizers

        encoding = encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                rows, out, seen = [], [], {}
                for i, x in enumerate(b.column(b.schema.get_field_index("text"))):
                    text = x.as_py() or ""
                    if (made := seen.get(text)) is None:
                        ids = np.array([*encode(encoding, text), END], "<u4")
                        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                        made = seen[text] = [(k, s, e - s, zlib.crc32(ids[s:e]), ids[s:e] if with_ids else None) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
                    rows += [i] * len(made)
                    out += made
                kept = b.select([c for c in names if c in b.schema.names]).take(pa.array(rows, pa.int64()))
                new = [pa.array([p[j] for p in out], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                new += [pa.array([p[4].astype(np.int32) for p in out], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=names)

    return docs.mapInArrow(run, schema)


def _fullest(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best, with at least one of the largest that is left."""
    first = next(g for g, c in enumerate(counts) if c)
    reach: dict[int, tuple] = {sizes[first]: (None, first)}  # total -> (total before, size added last)
    for g in range(first, len(sizes)):
        used = 1 if g == first else 0
        frontier = list(reach)
        for _ in range(min(counts[g] - used, (capacity - min(reach)) // sizes[g])):
            added = [t + sizes[g] for t in frontier if t + sizes[g] <= capacity and t + sizes[g] not in reach]
            for t in added:
                reach[t] = (t - sizes[g], g)
            frontier = added
    out, at = [0] * len(sizes), max(reach)
    while at is not None:
        before, g = reach[at]
        out[g] += 1
        at = before
    return out


def _best(values: np.ndarray, sizes: list[int], capacity: int, most: int) -> tuple[np.ndarray, float]:
    """The configuration with the largest sum of values, and that sum: a knapsack by the number of pieces and their total."""
    worth, choices = np.zeros(capacity + 1), []
    for _ in range(most):
        new, choice = worth.copy(), np.full(capacity + 1, -1)
        for g in np.flatnonzero(values > 0):
            with_it = worth[: capacity + 1 - sizes[g]] + values[g]
            better = np.flatnonzero(with_it > new[sizes[g] :] + 1e-12) + sizes[g]
            new[better], choice[better] = with_it[better - sizes[g]], g
        worth = new
        choices.append(choice)
    out, at = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if (g := choice[at]) >= 0:
            out[g] += 1
            at -= sizes[g]
    return out, float(worth[capacity])


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations of the sizes and how often each is used, of the fewest sequences but for rounding.

    A linear program over all configurations, in which each size must be covered counts times, solved
    by generating columns: the dual prices of the basis are a knapsack's values, whose best configuration
    enters the basis while it is worth more than a sequence. Uses are rounded down; the pieces this
    leaves over, fewer than a configuration's for each size, are left to the caller.
    """
    if not sizes:
        return []
    most = capacity // min(sizes)
    each = np.array([capacity // s for s in sizes], float)
    basis, inverse, uses = np.diag(each), np.diag(1 / each), np.array(counts, float) / each
    least, since = np.inf, 0
    for _ in range(COLUMNS):
        since = 0 if uses.sum() < least * (1 - 1e-9) else since + 1
        least = min(least, float(uses.sum()))
        column, worth = _best(inverse.sum(axis=0), sizes, capacity, most)
        if worth <= 1 + GAIN or since > STALL:  # degenerate steps may go round in circles
            break
        step = inverse @ column
        ratio = np.full(len(uses), np.inf)
        np.divide(uses, step, out=ratio, where=step > 1e-9)
        leaves = int(ratio.argmin())
        enters = max(0.0, ratio[leaves])
        uses = np.maximum(0, uses - enters * step)
        uses[leaves] = enters
        basis[:, leaves] = column
        inverse[leaves] /= step[leaves]
        others = np.arange(len(uses)) != leaves
        inverse[others] -= step[others, None] * inverse[leaves]
    return [([int(k) for k in basis[:, j]], int(uses[j] + 1e-6)) for j in range(len(uses))]


def best_fit(kept: list[tuple[int, tuple[int, ...]]], loose: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """{lengths in a sequence: how many such sequences}: kept, (how many, lengths), and loose pieces, {length: how many}, put in them.

    The longest come first, and each goes to the sequence with the least room that holds it, or to a
    new one; equal sequences and pieces of one length are placed at once.
    """
    by_room: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(inside: tuple[int, ...], count: int, room: int) -> None:
        if count:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = Counter()
            by_room[room][inside] += count

    for count, inside in kept:
        put(inside, count, capacity - sum(inside))
    for n in sorted(loose, reverse=True):
        left = loose[n]
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                room, inside, count = capacity, (), -(-left // (capacity // n))
            else:
                room = rooms[i]
                inside, count = by_room[room].popitem()
                if not by_room[room]:
                    del by_room[room], rooms[i]
            each = room // n
            full, some = min(count, left // each), 0
            put(inside + (n,) * each, full, room - each * n)
            left -= each * full
            if left and full < count:  # the last ones
                put(inside + (n,) * left, 1, room - left * n)
                left, some = 0, 1
            put(inside, (count - full - some) * bool(inside), room)
    return {inside: count for r in sorted(by_room) for inside, count in by_room[r].items()}


def plan(lengths: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Places for numbered pieces: (length, first, end, sequence, offset).

    Pieces of that length with numbers first to end - 1 go to the sequences from ``sequence`` on, one
    each, all at ``offset``. Works on the number of pieces of each length alone, so its time and size
    depend on capacity and groups, not on the number of pieces.

    Linear grouping: large pieces, the longest first, make groups of equal cardinality and count as
    the longest of their group. Configurations, multisets of these few sizes, are chosen by a linear
    program for the fewest sequences; what rounding its uses down leaves over gets the fullest
    configuration that holds the largest size left, as often as its sizes last. Then actual
    pieces take the places, which frees what rounding lengths up added. Sequences in which they leave more
    room than a limit are opened again, and their pieces and the small ones, the longest first, go
    each to the sequence with the least room that holds it; what is left opens new sequences. Of the
    limits OPEN the one with the fewest sequences counts, of equal ones the largest.
    """
    large = sorted((n for n in lengths if capacity // small < n < capacity and lengths[n]), reverse=True)
    total = sum(lengths[n] for n in large)
    runs: list[list[list[int]]] = []  # by group: [length, how many], the longest first
    room = 0
    for n in large:
        left = lengths[n]
        while left:
            if not room:
                runs.append([])
                room = -(-total // groups)
            k = min(room, left)
            runs[-1].append([n, k])
            left, room = left - k, room - k
    sizes, counts = [r[0][0] for r in runs], [sum(x[1] for x in r) for r in runs]

    filled: Counter = Counter()  # sequences by the actual lengths of their large pieces
    chosen = configurations(sizes, counts, capacity)
    while any(counts):
        shape, times = chosen.pop() if chosen else (_fullest(sizes, counts, capacity), sum(counts))
        times = min(times, *(c // k for c, k in zip(counts, shape) if k))
        if not times:
            continue
        slots = [g for g, k in enumerate(shape) for _ in range(k)]
        counts = [c - k * times for c, k in zip(counts, shape)]
        taken = []
        for g in slots:  # each place of the configuration gets the next pieces of its group
            got, left = [], times
            while left:
                run = runs[g][0]
                k = min(left, run[1])
                got.append([run[0], k])
                run[1], left = run[1] - k, left - k
                if not run[1]:
                    runs[g].pop(0)
            taken.append(got)
        while times:  # runs of sequences with the same actual lengths
            k = min(got[0][1] for got in taken)
            filled[tuple(got[0][0] for got in taken)] += k
            for got in taken:
                got[0][1] -= k
                if not got[0][1]:
                    got.pop(0)
            times -= k

    fewest: dict[tuple[int, ...], int] = {}
    for limit in sorted({*OPEN, capacity}, reverse=True):
        kept, loose = [], Counter({n: k for n, k in lengths.items() if n <= capacity // small and k})
        for inside, count in filled.items():
            if capacity - sum(inside) <= limit:
                kept.append((count, inside))
            else:
                for n in inside:
                    loose[n] += count
        found = best_fit(kept, loose, capacity)
        if not fewest or sum(found.values()) < sum(fewest.values()):
            fewest = found
    if lengths.get(capacity):
        fewest[(capacity,)] = lengths[capacity]
    out, sequence, number = [], 0, Counter()
    for inside, count in fewest.items():
        offset = 0
        for n in inside:
            out.append((n, number[n], number[n] + count, sequence, offset))
            number[n] += count
            offset += n
        sequence += count
    return out


@aside("text")
def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset; each sequence is gapless from 0 and holds at most capacity ids.

    Texts are tokenised once; the pieces, narrow unless with_ids, are kept in the shared folder. The
    driver sees the number of pieces of each length only (at most capacity numbers) and plans from
    these. Pieces of one length are numbered by hash block, so a length that a third of all pieces
    share is dealt over BLOCKS groups; numbers follow a row id of the kept pieces, so other columns may have any type. Null texts are empty, repeated rows are documents of their own,
    an empty table gives no rows. Columns of docs with the names of the result are replaced.
    """
    docs = docs.drop("sequence_id", "offset")
    p = checkpoint(pieces(docs, vocabulary, capacity, with_ids).withColumn("_row", F.monotonically_increasing_id()))
    p = p.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(BLOCKS)))
    counts = p.groupBy("length", "_block").agg(F.count("*").alias("n"))
    places = plan({int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    places = np.array(sorted(places), np.int64).reshape(-1, 5)
    before = counts.select("length", "_block", (F.sum("n").over(Window.partitionBy("length").orderBy("_block")) - F.col("n")).alias("_before"))
    p = p.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_block").orderBy("_row")) - 1)
    p = p.join(before, ["length", "_block"]).withColumn("_number", F.col("_in") + F.col("_before")).drop("_in", "_before", "_block", "_row")
    names = [*(c for c in p.columns if c != "_number"), "sequence_id", "offset"]
    schema = with_fields(p.drop("_number").schema, sequence_id="long", offset="long")
    sent = docs.sparkSession.sparkContext.broadcast(places)  # its size depends on capacity, not on the rows

    def run(batches):
        at = sent.value
        keys = (at[:, 0] << 44) | at[:, 1] if len(at) else np.zeros(0, np.int64)
        for b in batches:
            number = b.column(b.schema.get_field_index("_number")).to_numpy()
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            found = at[np.searchsorted(keys, (length << 44) | number, side="right") - 1] if b.num_rows else np.zeros((0, 5), np.int64)
            kept = [b.column(b.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found[:, 3] + number - found[:, 1]), pa.array(found[:, 4].copy())], names=names)

    return p.mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` and its place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
