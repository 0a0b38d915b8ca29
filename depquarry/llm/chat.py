"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example: all turns before it as context, and its own text as the only
part under the loss. Turns after the last reply, or of a conversation without one, form an example
without a loss, so that the output holds every turn.

A turn is ``<turn>role``, a line break, its text and ``</turn>`` with a line break. In roles and texts a
backslash is written ``\\b`` and ``<`` as ``\\l`` (in roles a line break as ``\\n``), so no text can hold a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end): an example per assistant turn, and one for turns after the last.

    ``conversations``: rows (conv_id, turn, role, text, any others), in the order of turn, then role and
    text; nulls first. Null roles and texts count as empty. The loss covers the code points
    [loss_start, loss_end) of ``text``; both are null for an example without one. Repeated rows are
    repeated turns. Rows of a null conv_id are one conversation.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", marked.alias("marked")))).alias("turns"))
    rows = rows.select("conv_id", F.size("turns").alias("n"), F.transform("turns", lambda t: t.marked).alias("marked"), F.transform("turns", lambda t: t.role).alias("roles"), F.transform("turns", lambda t: F.char_length(escape(t.text))).alias("chars"))
    at = F.transform(F.col("roles"), lambda r, i: F.when((r == "assistant") | (i == F.col("n") - 1), i))
    e = rows.select("*", F.explode(F.filter(at, lambda i: i.isNotNull())).alias("at"))
    text = F.array_join(F.slice("marked", F.lit(1), F.col("at") + 1), "")
    reply = F.get(F.col("roles"), F.col("at")) == "assistant"
    e = e.select("conv_id", F.col("at").alias("example"), (F.col("at") + 1).alias("n_turns"), text.alias("text"), F.when(reply, F.get(F.col("chars"), F.col("at"))).alias("loss"))
    end = F.char_length("text") - len(CLOSE)
    return e.select("conv_id", "example", "n_turns", "text", F.when(F.col("loss").isNotNull(), end - F.col("loss")).alias("loss_start"), F.when(F.col("loss").isNotNull(), end).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as array<struct<role, text>>."""
    parts = F.filter(F.split(text, OPEN), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(1), F.char_length(p) - len(CLOSE))
        cut = F.locate("\n", body)
        return F.struct(unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.char_length(body))).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What lies under the loss, unescaped."""
    return unescape(F.substring(text, start + 1, end - start))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns, text under the loss, and the characters of all examples."""
    whole = F.max_by("text", F.struct("n_turns", "example"))
    loss = F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("t"))
    g = examples.groupBy("conv_id").agg(whole.alias("text"), F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), loss))).alias("loss"), F.sum(F.char_length("text")).alias("formatted_chars"))
    turns = read_turns(F.col("text"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    g = g.select("conv_id", turns.alias("turns"), F.array_join(F.transform("loss", lambda x: x.t), "").alias("loss"), "formatted_chars")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")
