"""Chat formatting by perspective rotation: each dialogue is rendered once for every participant.

In a rendering one participant is the assistant, the others are users by name, and system turns stay system turns. The mask lists the
character spans (start-end, end exclusive) that the assistant is to learn: its texts and their end markers. Participants are told apart by their
whole role; its characters that a header line can't hold (white space, ``%``, ``<``, ``|``, ``>``) are percent-encoded in it.

A dialogue is one row a participant, whole, however many turns it has. Only one whose turns are more than a row can hold (``part_bytes``, 64 MB with 64 bytes a turn
for what is put around it) comes in parts of so much, in order, each a row of its own; a later part begins with the system turns of the first again, and the participants are
the whole dialogue's. Turns of these dialogues are placed by a sort over all tasks, so one that holds a third of all rows is spread like any others, and
no task gathers more than a part. Spans come from running sums over a part's turns. Expressions only, no Python.

Null role: a participant without a name (null; ``%`` in the rendering); null text: empty; null conv_id: one dialogue; null turn numbers: last. Turns of
one number are ordered by role, then text; repeated rows are repeated turns. Marker-like text (``<|``) is defused, so no turn can forge another.
Very long texts are whole; a single turn must fit in a string (2 GiB) once it is rendered. A dialogue of system turns only has no participant and no row. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.llm.common import only, stored

#: Markers of the rendered form, and what stands for "<|" in a text.
START, END, DEFUSED = "<|im_start|>", "<|im_end|>", "< |"
SYSTEM = "system"
#: Bytes of a row's turns at most, and what a turn counts besides its text.
PART_BYTES, TURN_BYTES = 1 << 26, 64
#: Characters of roles that are encoded in headers; % is the first, as the others' codes begin with it.
ENCODED = ("%", " ", "\t", "\n", "\r", "<", "|", ">")
#: Keys that a long dialogue's parts are dealt to.
_SALTS = 64
_ORDER = ("no_turn", "turn", "role", "text")


def name_of(role: Column) -> Column:
    """A role as a header line holds it: different roles have different names."""
    out = role
    for c in ENCODED:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(out, F.lit("%"))


def _placed(turns: DataFrame, part_bytes: int) -> DataFrame:
    """turns with their part, by the bytes before them in their dialogue: sums within ranges of the sorted rows, then over the ranges."""
    spread = turns.withColumn("nth", F.monotonically_increasing_id())  # equal rows may be dealt to several ranges
    ranges = spread.repartitionByRange("conv_id", *_ORDER, "nth").withColumn("range", F.spark_partition_id())
    ranges = stored(ranges, "chat-ranges")
    per = ranges.groupBy("range", "conv_id").agg(F.sum("bytes").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("range").alias("p_range"), F.col("conv_id").alias("p_conv"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.sum("bytes").over(Window.partitionBy("range", "conv_id").orderBy(*_ORDER, "nth").rowsBetween(Window.unboundedPreceding, -1))
    joined = ranges.withColumn("within", F.coalesce(within, F.lit(0))).join(per, (F.col("range") == F.col("p_range")) & F.col("conv_id").eqNullSafe(F.col("p_conv")))
    return joined.withColumn("part", F.floor((F.col("base") + F.col("within")) / F.lit(part_bytes)).cast("long")).select("conv_id", "part", *_ORDER)


def _head(role: Column) -> Column:
    """The header of a turn of somebody who isn't the assistant."""
    return F.when(role.eqNullSafe(F.lit(SYSTEM)), START + "system\n").otherwise(F.concat(F.lit(START + "user name="), name_of(role), F.lit("\n")))


def _gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, turns): in order, each with the characters before it if nobody were the assistant, and how many turns of its own role are."""
    length = F.char_length(_head(F.col("role"))) + F.char_length("text") + len(END) + 1
    in_part = Window.partitionBy("conv_id", "part").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("before", F.coalesce(F.sum(length.cast("long")).over(in_part), F.lit(0)))
    # Equal turns are told apart by what is before them.
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "part", "role").orderBy(*_ORDER, "before")) - 1)
    return rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "before", "own"))).alias("turns"))


def _rendered(parts: DataFrame) -> DataFrame:
    """(conv_id, part, speaker, n_turns, n_own, rendered, mask) from (conv_id, part, speaker, system, turns)."""
    assistant = START + "assistant\n"

    def own(t: Column) -> Column:
        return t["role"].eqNullSafe(F.col("speaker"))

    # The assistant's header stands for its name's in all its turns before.
    shorter = F.lit(len(assistant)) - F.char_length(_head(F.col("speaker")))
    ahead = F.aggregate("system", F.lit(0).cast("long"), lambda n, t: n + F.char_length(_head(t["role"])) + F.char_length(t["text"]) + len(END) + 1)

    def span(t: Column) -> Column:
        start = F.col("ahead") + t["before"] + t["own"] * F.col("shorter") + len(assistant)
        return F.concat(start.cast("string"), F.lit("-"), (start + F.char_length(t["text"]) + len(END)).cast("string"))

    mine = F.filter("turns", own)
    texts = F.transform(F.concat("system", "turns"), lambda t: F.concat(F.when(own(t), assistant).otherwise(_head(t["role"])), t["text"], F.lit(END + "\n")))
    return parts.withColumn("shorter", shorter).withColumn("ahead", ahead).select(
        "conv_id",
        "part",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(mine).cast("long").alias("n_own"),
        F.array_join(texts, "").alias("rendered"),
        F.array_join(F.transform(mine, span), ",").alias("mask"),
    )


def _speakers(turns: DataFrame) -> DataFrame:
    return turns.where(~F.col("role").eqNullSafe(F.lit(SYSTEM))).select(F.col("conv_id").alias("s_conv"), F.col("role").alias("speaker")).distinct()


def rotate(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, speaker, n_turns, n_own, rendered, mask) from conversations (conv_id, turn, role, text)."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit(DEFUSED)).alias("text")
    turns = only(conversations, "conv_id", "turn", "role", "text").select("conv_id", F.isnull("turn").alias("no_turn"), "turn", "role", text)
    turns = turns.withColumn("bytes", (F.octet_length("text") + TURN_BYTES).cast("long"))
    long = turns.groupBy(F.col("conv_id").alias("l_conv")).agg(F.sum("bytes").alias("n")).where(F.col("n") > part_bytes).select("l_conv")
    long = stored(long, "chat-long")
    is_long = F.col("conv_id").eqNullSafe(F.col("l_conv"))
    any_long = not long.isEmpty()

    short = turns.join(long, is_long, "left_anti") if any_long else turns
    whole = _gathered(short.withColumn("part", F.lit(0).cast("long")))
    speakers = F.array_distinct(F.transform(F.filter("turns", lambda t: ~t["role"].eqNullSafe(F.lit(SYSTEM))), lambda t: t["role"]))
    none = F.filter("turns", lambda t: F.lit(False))
    out = _rendered(whole.withColumn("system", none).withColumn("speaker", F.explode(speakers)))
    if not any_long:
        return out

    placed = stored(_placed(turns.join(long, is_long, "left_semi"), part_bytes), "chat-placed")
    parts = _gathered(placed).withColumn("salt", F.pmod("part", F.lit(_SALTS)))
    first = _gathered(placed.where((F.col("part") == 0) & F.col("role").eqNullSafe(F.lit(SYSTEM)))).select(F.col("conv_id").alias("f_conv"), F.col("turns").alias("system"))
    who = _speakers(placed)
    who = who.join(first, F.col("s_conv").eqNullSafe(F.col("f_conv")), "left").withColumn("s_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    parts = parts.join(who, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("salt") == F.col("s_salt")))
    return out.union(_rendered(parts.withColumn("system", F.when((F.col("part") > 0) & F.col("system").isNotNull(), F.col("system")).otherwise(none))))
