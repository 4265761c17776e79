"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into an example of its own: all turns before it are its context, and only its text is
trainable, the stretch [loss_start, loss_end) of the example. First each turn is formatted, numbered and given its
character offset in the conversation, block by block, so that no task holds a long conversation for it; then ``expand``
puts the examples together from the turns up to their target. ``write`` stores both, the turns for those who
want each text once. Examples are as large as the method makes them: the square of a conversation's length.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts, ``<`` and ``|`` with any number of backslashes
between get one more backslash, so no text holds a control string, and taking one away restores the text.
In roles, backslash and line break are escaped the usual way as well.

Defined cases: NULL text or role is empty; turns go by number, NULL first, equal numbers by role and text;
NULL conversations are one conversation; one without an assistant has no example; an empty table gives no
rows. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: Turn numbers of a block; a task numbers one block of a conversation.
BLOCK = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """One row per turn: conv, ordinal, formatted, start, loss_start, loss_end, example (the last three for assistant turns)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    rows = conversations.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(F.col(turn_col) / BLOCK), F.lit(-(1 << 53))).cast("long").alias("block"),
        F.concat(head, escape(text), F.lit(CLOSE)).alias("formatted"), F.length(head).alias("head"))
    rows = rows.withColumns({
        "chars": F.length("formatted").cast("long"), "mine": F.when(F.col("role") == ASSISTANT, 1).otherwise(0)})
    # running numbers within a block, and the totals of the blocks before: no task holds a whole long conversation
    upto = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    blocks = rows.groupBy("conv", "block").agg(
        F.sum("chars").alias("c"), F.count(F.lit(1)).alias("n"), F.sum("mine").alias("m")).select(
        "conv", "block", before("c").alias("chars_before"), before("n").alias("turns_before"), before("m").alias("mine_before"))
    local = rows.withColumns({"c": F.sum("chars").over(upto), "n": F.row_number().over(upto), "m": F.sum("mine").over(upto)})
    out = local.join(blocks, ["conv", "block"])
    start = F.col("chars_before") + F.col("c") - F.col("chars")
    own = F.col("mine") == 1
    loss = start + F.col("head")
    return out.select(
        F.col("conv.id").alias("conv"), (F.col("turns_before") + F.col("n") - 1).alias("ordinal"), "formatted", start.alias("start"),
        F.when(own, loss).alias("loss_start"), F.when(own, start + F.col("chars") - len(CLOSE)).alias("loss_end"),
        F.when(own, F.col("mine_before") + F.col("m") - 1).alias("example"))


def parsed(turns: DataFrame) -> DataFrame:
    """``turns`` with role, text and loss_text (what the mask covers, unescaped), read from the formatted strings."""
    rest = F.expr(f"substring(formatted, {len(OPEN) + 1})")
    text = F.expr(f"substring(__rest, __cut + 1, length(__rest) - __cut - {len(CLOSE)})")
    masked = F.expr("substring(formatted, cast(loss_start - start + 1 as int), cast(loss_end - loss_start as int))")
    return (turns.withColumn("__rest", rest).withColumn("__cut", F.instr("__rest", "\n")).withColumn("text", unescape(text)).withColumn(
        "role", unescape_role(F.expr("substring(__rest, 1, __cut - 1)"))).withColumn("loss_text", unescape(masked)).drop("__rest", "__cut"))


def expand(turns: DataFrame) -> DataFrame:
    """The examples in full: conv, example, text, loss_start, loss_end. Their size is the square of a conversation's length."""
    targets = turns.where("example is not null").select(
        F.struct("conv").alias("k"), "example", F.col("ordinal").alias("last"), "loss_start", "loss_end")
    parts = turns.select(F.struct("conv").alias("k"), "ordinal", "formatted")
    met = targets.join(parts, "k").where("ordinal <= last")
    return met.groupBy("k", "example", "loss_start", "loss_end").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "formatted"))), lambda x: x["formatted"]), "").alias("text")
    ).select("k.conv", "example", "text", "loss_start", "loss_end")


def trainable(examples: DataFrame) -> DataFrame:
    """``examples`` with ``loss_text``: what the mask of each covers, unescaped."""
    masked = F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")
    return examples.withColumn("loss_text", unescape(masked))


def write(conversations: DataFrame, path: str, **columns) -> tuple[DataFrame, DataFrame]:
    """Write the turns and the examples of all conversations below ``path``; returns both, read back."""
    spark = conversations.sparkSession
    formatted(conversations, **columns).write.parquet(f"{path}/turns")
    turns = spark.read.parquet(f"{path}/turns")
    expand(turns).write.parquet(f"{path}/examples")
    return turns, spark.read.parquet(f"{path}/examples")
