"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Each assistant turn becomes an example of its own: all preceding turns are context and only that reply is trainable.
A conversation whose last turn is not an assistant's gets one more example, with all turns and nothing trainable, so
that the examples together hold every turn.

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside a text get a backslash after their first character, and those that have backslashes there one
more, so taking one away gives the text back. A role's backslashes and line ends are escaped.

Rows are ordered by turn, then role, then text, nulls first; repeated rows are repeated turns. Null texts and roles
count as empty; rows without conv_id form one conversation. An empty text that is an assistant's is an example with
nothing trainable in it. An empty table gives an empty one. Columns other than conv_id, turn, role and text are
neither read nor returned. One conversation is one row, as one document is; its examples repeat its prefixes, so the
output of a conversation of n turns grows with n times its length, which is what this format means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What follows < or [ in the control strings of common chat templates.
_RESTS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>|s>|/s>|SYS>>|/SYS>>|INST\]|/INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_RESTS})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_RESTS})", r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """\\n is a line end where an even number of backslashes stands before it: pairs are put aside first."""
    aside = F.lit("\0")
    plain = unescape(role)
    plain = F.replace(F.replace(plain, aside, F.concat(aside, F.lit("0"))), F.lit("\\\\"), F.concat(aside, F.lit("1")))
    plain = F.replace(plain, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(plain, F.concat(aside, F.lit("1")), F.lit("\\")), F.concat(aside, F.lit("0")), aside)


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_end: the code points that are trainable, end exclusive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = whole.select(
        "conv_id",
        F.transform("t", lambda x: x["role"]).alias("roles"),
        F.transform("t", lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))).alias("heads"),
        F.transform("t", lambda x: escape(x["text"])).alias("texts"),
    )
    whole = whole.select("conv_id", "roles", "heads", "texts", F.transform("heads", lambda h, i: F.concat(h, F.get("texts", i), F.lit(END + "\n"))).alias("parts"))
    last = F.size("roles") - 1
    ends = F.filter(F.transform("roles", lambda r, i: F.when((r == "assistant") | (i == last), i)), lambda i: i.isNotNull())
    one = whole.select("*", F.posexplode(ends).alias("example", "at"))
    before = F.concat(F.array_join(F.slice("parts", 1, F.col("at")), ""), F.get("heads", F.col("at")))
    one = one.select("conv_id", F.col("example").cast("long"), F.get("roles", F.col("at")).alias("role"), before.alias("before"), F.get("texts", F.col("at")).alias("reply"))
    return one.select(
        "conv_id",
        "example",
        F.concat("before", "reply", F.lit(END + "\n")).alias("formatted"),
        F.length("before").cast("long").alias("loss_start"),
        F.when(F.col("role") == "assistant", F.length("before") + F.length("reply")).otherwise(F.length("before")).cast("long").alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substring(x, len(START) + 1, 1 << 30), "\n", 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, "\n") + 1, 1 << 30)).alias("text"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its examples: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    Trainable text is read under the mask and joined in the order of the examples; the turns are those of the last
    example, which holds them all.
    """
    trained = unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    # An example is cut down to its own reply before it is gathered; only the longest goes on whole.
    per = formatted.select("conv_id", "example", trained.alias("loss"), F.length("formatted").cast("long").alias("chars"), "formatted")
    per = per.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    per = per.select("conv_id", parse(F.col("all")).alias("turns"), "loss", "formatted_chars")
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose two turns are made of control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(rows)
