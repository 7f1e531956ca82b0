"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table, with_fields

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: A document is bad by a rule if its ratio exceeds the rule's cutoff.
RULES = {
    "repeat_words": lambda: _ratio("n_repeat_words", "n_words"),
    "symbols": lambda: _ratio("n_symbols", "n_words"),
    "dup_lines": lambda: _ratio("n_dup_lines", "n_lines"),
    "capitals": lambda: _ratio("n_capitals", "word_chars"),
    "shouts": lambda: _ratio("n_shouts", "n_words"),
    "few_words": lambda: F.lit(1) / F.greatest(F.col("n_words"), F.lit(1)),
    "word_chars": lambda: F.coalesce(F.least(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) / 40, F.lit(1.0)), F.lit(0.0)),
}
#: Ratios are counted in bins of 1 / STEPS.
STEPS = 50
#: Joint rule sets tried at most, and times the risk that the design rows may lose in them.
LEVELS, LOSS = 64, 4
#: Of so many parts of the labelled rows, by a hash of doc_id, one designs the rule sets and the others certify them.
PARTS = 4


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0)), F.lit(0.0))


def measure_text(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_shouts of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at ASCII white space only
    n = len(words)
    word_chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.split()]
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        seen: dict = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        end = 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeated += i + 5 - max(i, end)
                end = i + 5
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shouts = sum(map(bytes.isupper, words)) if capitals else 0
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), capitals, shouts


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")


def measure(docs: DataFrame) -> DataFrame:
    """docs with the columns MEASURES; a null text has no words. Columns of docs with these names are replaced."""
    docs = docs.drop(*MEASURES)
    schema = with_fields(docs.schema, **dict.fromkeys(MEASURES, "long"))
    names = schema.names

    def run(batches):
        for b in batches:
            found = [measure_text(x or "") for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            new = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=names)

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def at_most(k: int, n: int, p: float) -> float:
    """Probability of at most k of n at rate p: the exact binomial tail."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def _stratum(column: str, known: list) -> Column:
    return F.when(F.col(column).isin(known), F.col(column)).otherwise(F.lit("*")) if known else F.lit("*")


def _bin(rule: str) -> Column:
    return F.ceil(RULES[rule]() * STEPS).cast("int")


def design(counts: dict[str, dict[int, tuple[int, int]]], risk: float) -> list[dict[str, int]]:
    """Joint rule sets {rule: highest bin that stays}, the laxest first, from each rule's histogram of (good, bad) rows.

    Starting with no cutoff, each step lowers the cutoff of one rule so that it gains the most bad rows
    for each good one that it loses, one more counted as lost; of equal ones the laxer, then the rule
    listed first. So each set rejects what the sets before it reject. Sets that lose over LOSS * risk
    of the good rows end the sequence.
    """
    n = max((sum(g for g, _ in bins.values()) for bins in counts.values()), default=0)
    cuts, out, lost = dict.fromkeys(counts, STEPS), [], 0
    while len(out) < LEVELS:
        steps = []
        for order, (rule, bins) in enumerate(counts.items()):
            good = bad = 0
            for b in range(cuts[rule], 0, -1):  # the cutoff b - 1 rejects bin b too
                good, bad = good + bins.get(b, (0, 0))[0], bad + bins.get(b, (0, 0))[1]
                if bad and bins.get(b, (0, 0))[1]:
                    steps.append((bad / (good + 1), b - 1, -order, rule, good))
        if not steps:
            break
        _, cut, _, rule, good = max(steps)
        lost += good
        if lost > LOSS * risk * n:
            break
        cuts = {**cuts, rule: cut}
        out.append(cuts)
    return out


def certify(rejected: list[tuple[int, int]], n: int, risk: float, level: float) -> int | None:
    """The strictest safe rule set: rejected has the (good, bad) rows that each rejects, of n good ones.

    A set is safe if "it rejects more than risk of the good rows" fails the exact binomial test at the
    level. Sets are tested from the laxest on, up to the first that fails, so testing many costs
    nothing. A set that rejects no more bad rows than a laxer one is not taken; None if none is.
    """
    taken, most = None, 0
    for t, (good, bad) in enumerate(rejected):
        if not n or at_most(good, n, risk) > level:
            break
        if bad > most:
            taken, most = t, bad
    return taken


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.01, alpha: float = 0.05) -> tuple[list, dict]:
    """Strata and {stratum: {rule: cutoff}} with a guaranteed limit on false rejections.

    One of PARTS parts of the labelled rows designs a sequence of joint rule sets for each stratum
    (design). The others are the holdout: the good rows (quality 1) that each set rejects, by any of
    its rules, are counted in Spark, and the strictest set that is safe at level alpha / strata
    (Bonferroni over strata) is taken (certify). With probability 1 - alpha, no stratum loses more
    than ``risk`` of its good rows by the cutoffs.

    Strata are the values among labelled rows that have as many good holdout rows as a set which
    rejects none of them needs to be proved safe, at the level that is left when all of them and the
    pool share alpha; all others, and null, are pooled into "*", for which the limit then holds as a
    whole. A stratum takes hundreds of labels, so there are few even of many values; none is dropped.
    Without labelled rows every rule is off.
    """
    x = measured.join(labels.select("doc_id", "quality").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
    holdout = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(PARTS)) != 0
    x = x.filter(~base_failed() & F.col("quality").isin(0, 1)).select(F.col(stratum).alias("s"), "quality", holdout.alias("holdout"), *(_bin(r).alias(r) for r in RULES))
    x = checkpoint(x)  # narrow rows of what is labelled
    need = lambda k: math.log(alpha / (k + 1)) / math.log1p(-risk)  # noqa: E731  rows that one of k strata and the pool needs
    enough = x.filter("holdout and quality = 1 and s is not null").groupBy("s").count().filter(F.col("count") >= need(1))
    ranked = enough.orderBy(F.desc("count"), "s").collect()  # one row for some hundred labels
    known = [r[0] for r in ranked[: max((k for k, r in enumerate(ranked, 1) if r[1] >= need(k)), default=0)]]
    x = x.withColumn("s", _stratum("s", known))
    bins = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES))
    both = [F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)]
    h = x.filter("not holdout").select("s", "quality", F.explode(bins).alias("b")).groupBy("s", "b.rule", "b.bin").agg(*both)
    found: dict = {}
    for s, rule, b, good, bad in h.collect():  # for each stratum at most rules * (STEPS + 1) rows
        found.setdefault(s, {r: {} for r in RULES})[rule][b] = (good, bad)
    sets = {s: design(g, risk) for s, g in found.items()}
    first = F.lit(LEVELS)  # the first set that rejects the row
    for s, cuts in sets.items():
        by_rule = [F.element_at(F.array(*(F.lit(next((t for t, c in enumerate(cuts) if b > c[r]), LEVELS)) for b in range(STEPS + 1))), F.col(r) + 1) for r in RULES]
        first = F.when(F.col("s") == s, F.least(*by_rule)).otherwise(first)
    counted: dict = {}
    for s, t, n, bad in x.filter("holdout").withColumn("t", first).groupBy("s", "t").agg(*both).collect():
        counted.setdefault(s, {})[t] = (n, bad)
    cutoffs = {}
    for s, by in counted.items():
        upto = [tuple(sum(by.get(u, (0, 0))[k] for u in range(t + 1)) for k in (0, 1)) for t in range(len(sets.get(s, [])))]
        t = certify(upto, sum(n for n, _ in by.values()), risk, alpha / len(counted))
        cutoffs[s] = {r: c for r, c in sets[s][t].items() if c < STEPS} if t is not None else {}
    return known, cutoffs


def verdict(known: list, cutoffs: dict, stratum: str = "lang") -> Column:
    """False if the base rules or a cutoff of the row's stratum reject it."""
    bad = base_failed()
    s = _stratum(stratum, known)
    for name, rules in cutoffs.items():
        for rule, cut in rules.items():
            bad = bad | ((s == F.lit(name)) & (_bin(rule) > cut))
    return ~bad


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **fit) -> DataFrame:
    """docs with MEASURES, base_failed and kept.

    Null and empty texts have no words and fail the base rule; a null stratum is pooled. Rows with
    the same doc_id are judged each for itself (a doc_id with labels 0 and 1 counts as 0). Texts are
    measured whole, twice: first only the numbers are kept to fit the cutoffs, then with the rows.
    """
    numbers = measure(docs.select("doc_id", stratum, "text")).drop("text")
    known, cutoffs = fit_cutoffs(numbers, labels, stratum, **fit)
    return measure(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict(known, cutoffs, stratum))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    numbers = checkpoint(measure(docs).drop("text"))  # narrow rows: the texts are read once
    known, cutoffs = fit_cutoffs(numbers, table(spark, sf_dir, "labels"))
    return numbers.select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(known, cutoffs).alias("kept"))
