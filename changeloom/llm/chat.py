"""Chat formatting by prefix-target expansion, with DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, its reply as the only
text under the loss mask. A turn is written `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Control strings inside
roles and texts get a backslash after their first character, and backslashes are doubled; `unescaped`
takes both back. Turns after the last assistant turn come in one further example without a loss mask, so
nothing is lost.

A conversation is put together in one row, because each of its examples is a string that holds it; rows
are then made from it one at a time.

Edge cases. Null text or role: empty. Turns go by turn, role and text, null turns first; repeated rows are
turns of their own. Null conv_id: a conversation of its own. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Without their first characters, control strings of the usual chat templates (fixed values).
CONTROL = r"([<\[])(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def prefix_examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) to conv_id, example, n_turns, formatted, loss_start, loss_end.

    loss_start and loss_end are code points in formatted, the end exclusive; null where there is no target.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), F.concat(F.lit(START), escaped_role(role), F.lit("\n")).alias("head"), escaped(text).alias("body")).alias("t"))
    one = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(t["role"].alias("role"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"))).alias("sizes"),
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n"))), "").alias("whole"),
    )
    tail = len(END) + 1
    # ends: where each turn ends in the whole text, by one running sum over the turns.
    ends = F.expr(f"aggregate(sizes, named_struct('at', 0, 'ends', cast(array() as array<int>)), (a, s) -> named_struct('at', a.at + s.head + s.body + {tail}, 'ends', array_append(a.ends, a.at + s.head + s.body + {tail})), a -> a.ends)")
    numbered = one.withColumn("ends", ends).withColumn(
        "spans", F.expr(f"transform(sizes, (s, i) -> named_struct('n', i + 1, 'target', s.role = '{target_role}', 'end', ends[i], 'loss_end', ends[i] - {tail}, 'loss_start', ends[i] - {tail} - s.body))")
    )
    kept = F.expr("filter(spans, s -> s.target OR s.n = size(spans))")
    return numbered.select("conv_id", "whole", F.posexplode(kept).alias("example", "s")).select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("s.n").cast("long").alias("n_turns"),
        F.substring("whole", F.lit(1), F.col("s.end")).alias("formatted"),
        F.when(F.col("s.target"), F.col("s.loss_start")).cast("long").alias("loss_start"),
        F.when(F.col("s.target"), F.col("s.loss_end")).cast("long").alias("loss_end"),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescaped(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def parsed_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""

    def turn(part: Column) -> Column:
        role = F.regexp_extract(part, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - F.lit(2 + len(END)))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != ""), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """One row for each conversation, all of it taken from the examples' own strings."""
    per_conv = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text"))))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns, loss = parsed_turns(F.col("last")), F.array_join(F.transform("losses", lambda x: x["text"]), "")
    return per_conv.withColumn("turns", turns).withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
