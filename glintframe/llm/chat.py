"""Training examples from conversations by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a turn: head, role, divider, text, tail.
HEAD, DIVIDER, TAIL = "### ", ": ", " </turn>\n"
#: Characters that never stand as such inside a text or role, and what does.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs: tuple = ESCAPES) -> Column:
    """The text without control strings; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, coded in pairs:
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column, pairs: tuple = ESCAPES) -> Column:
    """Undoes escape(): a backslash in escaped text always begins a code, so codes
    can be replaced one kind after the other, the backslash's own last."""
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def examples(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant"
) -> DataFrame:
    """Examples (conv_id, example, formatted, loss_start, loss_chars, last): one for
    every turn whose role is `target`, holding all turns before it and this reply,
    where loss_start and loss_chars (code points of `formatted`, from 0) are the
    reply alone. A conversation that doesn't end with such a turn has one more
    example, with all its turns and nothing to learn; `last` marks the example
    that holds all turns.

    Turns are in order of turn, role and text, nulls first; a null text or role is
    empty; repeated rows are turns of their own; a null conv_id is a conversation.
    Further columns aren't read. Conversations are the groups of the one shuffle; a
    conversation must fit a task, as its examples must.
    """
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))))
    byconv = df.groupBy(F.col(conv_col).alias("conv_id")).agg(turns.alias("turns"))
    heads = byconv.select(
        "conv_id",
        F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("")) == target).alias("learn"),
        F.transform("turns", lambda t: F.concat(F.lit(HEAD), escape(t["role"], ROLE_ESCAPES), F.lit(DIVIDER))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
    )
    whole = heads.select(
        "conv_id", "heads", "texts", F.size("texts").alias("n"),
        F.zip_with("heads", "texts", lambda h, t: F.concat(h, t, F.lit(TAIL))).alias("marked"),
        F.filter(F.sequence(F.lit(0), F.size("learn")), lambda i: F.when(i < F.size("learn"), F.get("learn", i)).otherwise(~F.get("learn", F.size("learn") - 1))).alias("at"),
    )
    one = whole.select("conv_id", "heads", "texts", "marked", "n", F.posexplode("at").alias("example", "i"))
    context = one.select(
        "conv_id", "example", F.array_join(F.slice("marked", F.lit(1), F.col("i")), "").alias("context"),
        F.coalesce(F.get("heads", F.col("i")), F.lit("")).alias("head"), F.get("texts", F.col("i")).alias("reply"), (F.col("i") >= F.col("n") - 1).alias("last"),
    )
    return context.select(
        "conv_id", "example", F.concat("context", "head", F.coalesce(F.concat("reply", F.lit(TAIL)), F.lit(""))).alias("formatted"),
        (F.length("context") + F.length("head")).alias("loss_start"), F.coalesce(F.length("reply"), F.lit(0)).alias("loss_chars"), "last",
    )


def read_back(out: DataFrame) -> DataFrame:
    """What examples() has written, told from `formatted` and the loss spans alone:
    conv_id, n_turns, turns_sha256 (of role, newline, text, newline for each turn),
    loss_chars and loss_sha256 (of all text under the loss masks, unescaped),
    formatted_chars (of all its examples) and examples.

    The rows of a conversation lie together since examples(), and so nothing is
    shuffled here.
    """
    marked = F.split("formatted", TAIL, -1)
    turns = F.slice(marked, F.lit(1), F.size(marked) - 1)

    def line(turn: Column) -> Column:
        head = F.substring_index(turn, DIVIDER, 1)
        role, text = F.substring(head, len(HEAD) + 1, 1 << 30), F.substr(turn, F.length(head) + len(DIVIDER) + 1)
        return F.concat(unescape(role, ROLE_ESCAPES), F.lit("\n"), unescape(text), F.lit("\n"))

    parsed = out.select(
        "conv_id", "example", F.length("formatted").alias("chars"), unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_chars"))).alias("reply"),
        F.when(F.col("last"), F.size(turns)).alias("n_turns"), F.when(F.col("last"), F.sha2(F.array_join(F.transform(turns, line), ""), 256)).alias("turns_sha256"),
    )
    byconv = parsed.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.sort_array(F.collect_list(F.struct("example", "reply")))["reply"], "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("examples"),
    )
    return byconv.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "examples"
    )
