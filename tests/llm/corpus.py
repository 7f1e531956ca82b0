"""A small corpus with the awkward cases, and plain definitions to compare with."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa mu nu xi pi rho tau") + str(r.randrange(40)) for _ in range(n))


def texts():
    """Nulls, empties, white space of other kinds, copies, near copies, shared passages, ties and one very long text."""
    base, shared = prose(120, 1), prose(30, 2)
    near = base.split(" ")
    near[60] = "changed"
    out = [
        None, "", "   \n\t ", "one", "One two", "one  two", "a b c d e f", base, base, " ".join(near), base.upper(), prose(50, 3) + " " + shared, shared + " " + prose(50, 4), shared + "\n" + shared,
        "x y " * 60, prose(4, 5), prose(4, 5), "tab\tand\vvertical\fform\rreturn", "l1 same line here\nl2 other\nl1 same line here\n\n\nend", "SHOUT " * 15, "été \U0001f600 naïve #$% <|endoftext|> </s> \x00 z",
    ]
    out += [prose(n, 100 + n) for n in range(8, 30)]
    out += [prose(3000, 7) + " " + shared]
    return out


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, more=()):
    """The corpus as documents; one null doc_id, one row that is there twice."""
    rows = [(i, t, ("en", "de", None)[i % 3], ("web", "code", None, "web")[i % 4], len(t or "")) for i, t in enumerate(texts(), 1)]
    rows += [(None, prose(25, 900), "en", "web", 1), rows[8], *more]
    return spark.createDataFrame(rows, KIND).repartition(5)


def clashing(df, *names):
    """df with further columns of the given names, and others that operators may use inside."""
    from pyspark.sql import functions as F

    for n in (*names, "_d", "_t", "node", "k", "key"):
        if n not in df.columns:
            df = df.withColumn(n, F.lit("own"))
    return df
