"""Chat formatting by prefix-target expansion (native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, HEAD, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that would read as control strings, and what stands for them inside a text. The backslash
#: comes first, so each later backslash in an escaped text begins one of these pairs.
ESCAPES = (
    ("\\", "\\e"), ("<|im_start|>", "\\a"), ("<|im_end|>", "\\z"), ("<|endoftext|>", "\\x"),
    ("<s>", "\\s"), ("</s>", "\\t"), ("[INST]", "\\i"), ("[/INST]", "\\j"), ("<<SYS>>", "\\p"), ("<</SYS>>", "\\q"),
)


def escape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(ESCAPES), text)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chat(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """One example for each assistant turn: (conv_id, example, n_turns, formatted, loss_start, loss_end).

    An example holds the turns up to its target turn; only the target's text is trainable, and
    [loss_start, loss_end) is its place in ``formatted``, in code points from 0. A conversation that
    does not end with an assistant turn gets one more example with all turns and no trainable part
    (loss_start null), so that no turn is lost. ``example`` counts from 0.

    Turns are ordered by (turn, role, text), nulls first. Null roles and texts are empty; an empty
    reply is an example with an empty target; repeated rows are turns of their own; rows with a null
    conv_id make one conversation. An example is one row that holds its whole context, so a task
    needs memory for one conversation and its examples are made one after another by a generator.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    head = lambda x: F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit(HEAD))
    c = c.select("conv_id", "t", F.transform("t", lambda x: F.concat(head(x), escape(x["text"]), F.lit(CLOSE))).alias("s"))
    ends = F.filter(F.transform("t", lambda x, i: F.when((x["role"] == target) | (i == F.size("t") - 1), i + 1)), lambda i: i.isNotNull())
    c = c.select("conv_id", "t", "s", F.posexplode(ends).alias("example", "n_turns"))
    formatted = F.array_join(F.slice("s", F.lit(1), F.col("n_turns")), "")
    last = F.element_at("t", F.col("n_turns"))
    c = c.select("conv_id", "example", "n_turns", formatted.alias("formatted"), (last["role"] == target).alias("_loss"), F.length(escape(last["text"])).alias("_n"))
    end = F.when(F.col("_loss"), F.length("formatted") - len(CLOSE))
    return c.select("conv_id", "example", "n_turns", "formatted", (end - F.col("_n")).alias("loss_start"), end.alias("loss_end"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    body = F.substr(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN + CLOSE))
    pieces = F.split(body, r"<\|im_end\|>\n<\|im_start\|>", -1)
    role = lambda x: F.substring_index(x, HEAD, 1)
    return F.transform(pieces, lambda x: F.struct(unescape_role(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + 2)).alias("text")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the formatted ``conversations``, and from conversation -1 with control strings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    c = c.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], c.schema))
    x = format_chat(c)
    reply = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    x = x.select("conv_id", "example", F.length("formatted").alias("n"), reply.alias("reply"), "formatted")
    # The longest example holds all turns; the replies follow in the order of the examples.
    whole = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("example"))) == 1
    turns = F.transform(parse_chat(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    x = x.withColumn("turns", F.when(whole, turns))
    x = x.groupBy("conv_id").agg(
        F.max("turns").alias("turns"), F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("r"), F.sum("n").alias("formatted_chars"), F.count("*").alias("n_examples")
    )
    replies = F.array_join(F.transform("r", lambda r: r["reply"]), "")
    return x.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length(replies).cast("long").alias("loss_chars"), F.sha2(replies, 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )


def _sql_escape(c: str, pairs: tuple = ESCAPES) -> str:
    return reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", pairs, c)


OP3_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
       length({_sql_escape("role")}) + length({_sql_escape("text")}) + (length(role) - length(replace(role, chr(10), ''))) + {len(OPEN + HEAD + CLOSE)} AS len
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i) AS so_far, (role = 'assistant' OR i = n) AS ends FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(so_far) FILTER (ends))::BIGINT AS formatted_chars, (count(*) FILTER (ends))::BIGINT AS n_examples
FROM e GROUP BY conv_id
"""
