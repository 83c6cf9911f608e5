"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the
context, and its text alone is trainable. A conversation that does not end with an
assistant turn also gives one example without a trainable part, so that no turn is
lost from the formatted data.

A turn is written `<turn role>`, newline, text, `</turn>`, newline. Inside texts
and roles a backslash becomes `\\s` and `<` becomes `\\l` (in roles also `>` becomes
`\\g` and a newline `\\n`), so no text holds a mark of the template, and undoing the
replacements, the backslash last, gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")))


def expand(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_length: the examples of conversations(conv_id, turn, role, text).

    example counts from 0 in a conversation; loss_start and loss_length are code points
    of formatted, the trainable text as it stands there, still escaped (length 0: an
    example without a trainable part).

    Null texts and roles are empty. Turns are ordered by turn, null first; rows with one
    turn by role and text, and repeated rows all count. Rows without conv_id form one
    conversation. Texts are formatted whole, however long. Other columns are ignored. An empty table gives
    no rows. A conversation is one group by the nature of its output, each example of which holds all turns
    before it: a hot conv_id is as large a group as its last example is a text.
    """
    one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    head = lambda t: F.concat(F.lit("<turn "), escape_role(t["role"]), F.lit(">\n"))
    marked = F.transform("turns", lambda t: F.struct((t["role"] == trained).alias("trained"), head(t).alias("head"), escape(t["text"]).alias("body")))
    turns = turns.select("conv_id", marked.alias("turns"))
    numbers = F.sequence(F.lit(1), F.size("turns"))
    shown = F.filter(numbers, lambda i: F.element_at("turns", i.cast("int"))["trained"] | (i == F.size("turns")))
    rows = turns.select("conv_id", "turns", F.posexplode(shown).alias("example", "at"))
    written = F.transform(F.slice("turns", 1, F.col("at") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(_END)))
    rows = rows.select("conv_id", "example", F.array_join(written, "").alias("context"), F.element_at("turns", F.col("at")).alias("last"))
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat("context", F.col("last.head"), F.col("last.body"), F.lit(_END)).alias("formatted"),
        (F.length("context") + F.length("last.head")).cast("long").alias("loss_start"),
        F.when(F.col("last.trained"), F.length("last.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id and the digests of what the formatted examples say: one row for each conversation.

    The last example of a conversation holds all its turns.
    """
    loss = F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_length as int))")
    seen = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.sort_array(F.collect_list(F.struct("example", unescape(loss).alias("text")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    marks = F.filter(F.split("formatted", "</turn>\n"), lambda t: t != "")
    role = lambda t: F.substring_index(t, ">\n", 1)
    turn = lambda t: F.concat(unescape_role(F.substr(role(t), F.lit(7))), F.lit("\n"), unescape(F.substr(t, F.length(role(t)) + 3)), F.lit("\n"))
    loss_text = F.array_join(F.col("losses.text"), "")
    return seen.select(
        "conv_id",
        F.size(marks).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(marks, turn), ""), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"),
        "formatted_chars",
    )
