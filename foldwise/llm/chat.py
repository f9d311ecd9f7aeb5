"""Chat formatting by prefix-target expansion, with built-in functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only
its own text is trainable.  A turn is written as

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

Control strings inside a text get one backslash after their first character ('<s>' becomes
'<\\s>', '<\\s>' becomes '<\\\\s>'), which is undone exactly on reading; roles other than
lower-case letters are written as '#' and their hexadecimal bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of common chat templates, without their first character.
CONTROL = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
ESCAPE = (rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")
UNESCAPE = (rf"([<\[])\\(\\*){CONTROL}", "$1$2$3")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _role_mark(role: Column) -> Column:
    return F.when(role.rlike("^[a-z]+$") & ~role.contains("\n"), role).otherwise(F.concat(F.lit("#"), F.hex(F.encode(role, "UTF-8"))))


def _role_of(mark: Column) -> Column:
    return F.when(mark.startswith("#"), F.decode(F.unhex(F.substring(mark, 2, 1 << 30)), "UTF-8")).otherwise(mark)


def training_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): the loss mask is the code points
    loss_start <= i < loss_end of text.

    Turns are ordered by (turn, role, text); a null turn comes first, a null role or text is
    empty, rows that repeat are turns of their own and a null conv_id is one conversation.  Turns behind the last
    assistant turn (or all, if there is none) follow in one example with an empty mask, so
    that nothing of a conversation is lost.  An empty assistant text gives an empty mask.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(F.lit(START), _role_mark(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"))).alias("turns"),
    )
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["reply"] | (i == n))
    each = written.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto"))
    last = F.element_at("turns", F.col("upto"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return each.select(
        "conv_id", "example", F.concat(before, last["head"]).alias("context"), last["body"].alias("body"), last["reply"].alias("reply")
    ).select(
        "conv_id",
        "example",
        F.concat("context", "body", F.lit(END)).alias("text"),
        F.when(F.col("reply"), F.length("context")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("reply"), F.length("context") + F.length("body")).otherwise(0).cast("long").alias("loss_end"),
    )


def turns_of(text: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.split(text, r"<\|im_end\|>\n", -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            _role_of(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), "\n", 1)).alias("role"),
            unescaped(F.substring(p, F.locate("\n", p) + 1, F.lit(1 << 30))).alias("text"),
        ),
    )


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The unescaped text under a loss mask."""
    return unescaped(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted examples alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (code points of all its examples), n_examples."""
    parts = examples.select(
        "conv_id", "example", "text", F.length("text").cast("long").alias("chars"), loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss")
    )
    whole = parts.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    joined = whole.select("conv_id", turns_of(F.col("text")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars", "n_examples")
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return joined.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
