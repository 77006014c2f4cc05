r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output, ``<|`` being reserved for markers::

    conversation = { turn }
    turn         = "<|im_start|>" role "\n" text "<|im_end|>\n"

``<|nl|>`` stands for a line break inside a role. Inside texts and roles a run
``<``, n backslashes, ``|`` is written with n + 1 backslashes, so no marker can
appear there, and removing one backslash restores the source for every n.

Each turn is first rendered verbatim and parsed again with the parser of the
grammar. If that does not give back the very same role and text, the turn is
rendered with escapes. The whole conversation is then parsed again and compared
with its source turns; a difference raises an error. Everything that is reported
(turns, loss text) is read back from the formatted text.

Rendering works turn by turn without any grouping; turns meet only to be joined
into their conversation, which has to be one string.

Defined results: a null text or role counts as empty. Turns are ordered by turn
number (null last), then role and text, so ties and repeated rows have one
order. A null conversation id is a conversation of its own. Very long texts and
conversations are one string each, as the format wants. Columns are taken by name into
fresh ones, so that other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Role whose texts are under the loss mask.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        role, text = F.replace(escape(role), F.lit("\n"), F.lit(BREAK)), escape(text)
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text; a turn that breaks the grammar
    is null."""
    segments = F.split(formatted, r"<\|im_end\|>\n")

    def turn(segment: Column) -> Column:
        body = F.substring(segment, F.lit(len(START) + 1), F.length(segment))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        name = F.replace(role, F.lit(BREAK), F.lit("\n"))
        valid = segment.startswith(START) & body.contains("\n") & ~name.contains("<|") & ~text.contains("<|")
        return F.when(valid, F.struct(unescape(name).alias("role"), unescape(text).alias("text")))

    # What follows the last end marker must be nothing.
    closed = F.when(F.element_at(segments, -1) == "", F.slice(segments, F.lit(1), F.size(segments) - 1)).otherwise(segments)
    return F.transform(closed, turn)


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """conv_id, formatted, turns (source), recovered (parsed from formatted) and
    loss_spans (code point offsets [start, end) of the loss texts in formatted)."""
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").isNull().alias("late"),
                        F.col(f"`{turn}`").alias("at"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    plain, safe = render(F.col("role"), F.col("text"), False), render(F.col("role"), F.col("text"), True)
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("rendered", F.when(F.coalesce(parse(plain) == source, F.lit(False)), plain).otherwise(safe))
    order = Window.partitionBy("conv").orderBy("late", "at", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "end", F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END))
    # The text of a turn is what its rendering holds after the first line.
    head = F.length(F.substring_index("rendered", "\n", 1)) + 1
    start = F.col("end") + len(END) - F.length("rendered") + head
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(start.alias("start"), F.col("end").alias("end")))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(
        F.struct("n", "role", "text", "rendered", span.alias("span")))).alias("t"))
    out = whole.select(
        F.col("conv").alias(conv_id),
        F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))
    out = out.withColumn("recovered", parse(F.col("formatted")))
    same = F.coalesce(F.col("recovered") == F.col("turns"), F.lit(False))
    return out.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("round trip failed for conversation "),
                               F.coalesce(F.col(conv_id).cast("string"), F.lit("null"))))))


def digests(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Counts and digests of what ``format_conversations`` gives, read back from it."""
    spoken = F.array_join(F.transform(
        "recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumn("loss", loss).select(
        conv_id, F.size("recovered").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
