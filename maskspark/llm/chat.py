"""Chat template with a grammar round trip, in DataFrame expressions alone.

A conversation is rendered as <s>, then for each turn [INST] role [/INST] text </s>. A deterministic parser reads it back.
A turn whose rendering doesn't parse back to the same role and text is escaped: each backslash is doubled, and each control
string gets one backslash after its opening bracket. An escaped turn holds an odd run of backslashes there and even runs
elsewhere, so unescaping is exact. The finished conversation is parsed once more and must equal its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"</?s>|\[/?INST\]"
_OPENED = r"([<\[])(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _OPENED, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(ROLE), role, F.lit(TEXT), text, F.lit(END))


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of a rendered turn without its end mark; null if the grammar doesn't allow it."""
    pieces = F.split(turn, _CONTROL, -1)
    role, text = pieces[1], pieces[2]
    well_formed = (F.size(pieces) == 3) & (F.concat(F.lit(ROLE), role, F.lit(TEXT), text) == turn)
    return F.when(well_formed, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation."""
    body = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END, -1)
    return F.transform(F.slice(body, F.lit(1), F.size(body) - 1), parse_turn)


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation rendered, with the spans (start, end in code points of
    formatted, end exclusive) of the learned role's texts as they stand there, escaped.

    Rows are ordered by turn, then role, then text; repeated rows are turns of their own; null turns come first. Null
    roles and texts are empty. Rows with a null conv_id are one conversation. An empty table gives no rows. Other columns
    are not read. The rows of one conversation meet in one task, since its text is one value of the result.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = F.struct("role", "text")
    # a turn that holds the end mark would break up into several, and is then more than two controls
    safe = F.coalesce(parse_turn(F.concat(F.lit(ROLE), F.col("role"), F.lit(TEXT), F.col("text"))) == source, F.lit(False))
    rows = rows.withColumn("safe", safe)
    rows = rows.withColumn("role_out", F.when(F.col("safe"), F.col("role")).otherwise(escape(F.col("role"))))
    rows = rows.withColumn("text_out", F.when(F.col("safe"), F.col("text")).otherwise(escape(F.col("text"))))
    rows = rows.withColumn("rendered", render(F.col("role_out"), F.col("text_out")))
    up_to = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.length("rendered")).over(up_to) + len(BEGIN) - len(END))
    item = F.struct("end", "rendered", "role", "text", F.length("text_out").alias("size"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = whole.withColumn("formatted", F.concat(F.lit(BEGIN), F.array_join(F.transform("items", lambda x: x.rendered), "")))
    sources = F.transform("items", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    whole = whole.withColumn("formatted", F.when(parse(F.col("formatted")) == sources, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't survive the round trip"))))
    learned = F.filter("items", lambda x: x.role == learn)
    spans = F.transform(learned, lambda x: F.struct((x.end - x["size"]).alias("start"), x.end.alias("end")))
    return whole.select("conv_id", "formatted", spans.alias("loss_spans"))
