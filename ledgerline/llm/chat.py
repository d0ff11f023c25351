r"""Chat formatting from event logs, with DataFrame functions alone.

A log holds events of conversations: ``delta`` adds a piece to a message, ``edit`` replaces what the
message has so far, ``regenerate`` throws it away, ``delete`` removes the message until a later event
brings it back. Events of a message are folded in the order of their sequence: what counts is the last
edit, regeneration or deletion and the deltas after it. The messages of a conversation are then
rendered in order with control strings between them, and a loss mask says which characters of the
result are the assistant's.

Inside texts and roles every ``<``, ``[`` and ``\`` gets a backslash behind it, so none of the control
strings below, nor ``</s>`` or ``[INST]``, can come from a text, and ``unescape`` restores it exactly.

Folding and rendering go in two steps, messages into chunks of CHUNK positions and chunks into
conversations, so that of a conversation with a large share of all rows only the chunks meet in one
row. That row is the conversation's formatted string, which is the result itself.

Defined results: null texts and roles are empty; events without a known kind count as deltas; null
sequence numbers and positions come first; ties are ordered by kind, role and text; repeated events are
applied as often as they occur; a null conversation is one of its own; an empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed control strings of the template.
BEGIN = "<|turn|>"
TEXT = "<|text|>"
END = "<|end|>\n"

#: Positions in one chunk of a conversation.
CHUNK = 256


def escape(text: Column) -> Column:
    """Put a backslash behind every <, [ and backslash."""
    return F.regexp_replace(text, r"[<\[\\]", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the messages left at the end of the log.

    events: conv_id, position (of the message), part (to tell messages at one position apart), seq, kind, role, text.
    The first role that an event of the message gives is its role.
    """
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    rows = events.select(
        "conv_id", "position", "part",
        F.struct("seq", kind.alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")).alias("event"),
    )
    grouped = rows.groupBy("conv_id", "position", "part").agg(F.array_sort(F.collect_list("event")).alias("log"))
    at = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "delete"), i)))
    last = grouped.withColumn("reset", F.coalesce(at, F.lit(-1)))
    live = F.filter("log", lambda e, i: (i >= F.col("reset")) & ~e["kind"].isin("regenerate", "delete"))
    kept = last.withColumn("live", live).filter((F.size("live") > 0) | (F.col("reset") < 0) | (F.element_at("log", (F.col("reset") + 1).cast("int"))["kind"] != "delete"))
    role = F.try_element_at(F.transform(F.filter("log", lambda e: e["role"].isNotNull()), lambda e: e["role"]), F.lit(1))
    return kept.select("conv_id", "position", "part", F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform("live", lambda e: e["text"]), "").alias("text"))


def _running(values: Column, block: int = CHUNK) -> Column:
    """Sums of the values before each, in blocks, so that no long array is copied once a value."""
    upto = lambda b, first: F.aggregate(b, F.array(first), lambda e, x: F.concat(e, F.array(F.element_at(e, -1) + x)))
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / block).cast("int") - 1), lambda i: F.slice(values, i * block + 1, block))
    blocks = F.when(F.size(values) > 0, blocks).otherwise(F.array().cast("array<array<bigint>>"))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda e, x: e + x))
    starts = F.slice(upto(sums, zero), F.lit(1), F.size(sums))
    return F.flatten(F.zip_with(blocks, starts, lambda b, first: F.slice(upto(b, first), F.lit(1), F.size(b))))


def render(messages: DataFrame, learner: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, formatted, loss, parts): the rendered conversation and the masked spans, as (start, length) in code points.

    parts cuts the conversation: for each chunk its turns and its spans counted from its own start.

    messages: conv_id, position, part, role, text.
    """
    text, role = escape(F.coalesce("text", F.lit(""))), escape(F.coalesce("role", F.lit("")))
    head = F.concat(F.lit(BEGIN), role, F.lit(TEXT))
    turns = messages.select(
        "conv_id", F.floor(F.col("position") / chunk).alias("chunk"),
        F.struct(
            "position", "part", F.concat(head, text, F.lit(END)).alias("shown"),
            F.length(head).alias("lead"), F.length(text).alias("body"), F.coalesce(F.col("role") == learner, F.lit(False)).alias("learn"),
        ).alias("turn"),
    )
    chunks = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def place(held, turn):
        span = F.struct((held["at"] + turn["lead"]).alias("start"), turn["body"].cast("long").alias("length"))
        return F.struct((held["at"] + F.length(turn["shown"])).alias("at"), F.when(turn["learn"], F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"))

    # a chunk becomes one string, its length, and its spans counted from its own start
    pieces = chunks.select(
        "conv_id",
        F.struct("chunk", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("shown"), F.aggregate("turns", start, place).alias("held"), F.size("turns").alias("n")).alias("piece"),
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    whole = whole.withColumn("ends", _running(F.transform("pieces", lambda p: p["held"]["at"])))
    shifted = F.zip_with("pieces", "ends", lambda p, e: F.transform(p["held"]["spans"], lambda s: F.struct((s["start"] + e).alias("start"), s["length"].alias("length"))))
    parts = F.transform("pieces", lambda p: F.struct(p["n"].alias("turns"), p["held"]["spans"].alias("spans")))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["shown"]), "").alias("formatted"), F.flatten(shifted).alias("loss"), parts.alias("parts"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learned, formatted): role and text of each turn and the masked text, recovered from the output.

    The text is split at the control strings once, and a span is cut out of its chunk, not out of the whole conversation.
    """
    pieces = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda x, i: i > 0)
    rows = formatted.withColumn("__pieces", pieces).withColumn("__first", _running(F.transform("parts", lambda p: p["turns"].cast("long"))))
    turn = lambda x: F.struct(
        unescape(F.split_part(x, F.lit(TEXT), F.lit(1))).alias("role"),
        unescape(F.split_part(F.split_part(x, F.lit(TEXT), F.lit(2)), F.lit(END), F.lit(1))).alias("text"),
    )
    whole = lambda p, first: F.concat(F.lit(BEGIN), F.array_join(F.slice("__pieces", (first + 1).cast("int"), p["turns"]), BEGIN))
    shown = rows.withColumn("__shown", F.zip_with("parts", "__first", lambda p, first: F.struct(whole(p, first).alias("text"), p["spans"].alias("spans"))))
    learned = F.flatten(F.transform("__shown", lambda c: F.transform(c["spans"], lambda s: unescape(F.substring(c["text"], (s["start"] + 1).cast("int"), s["length"].cast("int"))))))
    return shown.select("conv_id", F.transform("__pieces", turn).alias("turns"), learned.alias("learned"), "formatted")


def turns_as_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = 512) -> DataFrame:
    """The log that would have streamed a table of turns: deltas of ``piece`` characters each."""
    same = Window.partitionBy("conv_id", "position").orderBy("role", "text")
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("position"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("part", F.row_number().over(same))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / piece) - 1, F.lit(0)).cast("int")), lambda i: F.substring("text", i * piece + 1, F.lit(piece)))
    return rows.select("conv_id", "position", "part", "role", F.posexplode(pieces).alias("seq", "text")).withColumn("kind", F.lit("delta"))


def drafts_as_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = 512, draft: int = 64) -> DataFrame:
    """A log whose fold is the table of turns, with detours, as a hash of the message decides.

    Of five messages one is streamed straight; one streams a draft that a regeneration throws away; one
    streams a draft that an edit replaces by the first piece, the other pieces following as deltas; one is
    deleted and streamed again; one has all of these. Drafts are the first ``draft`` characters, reversed.
    """
    log = turns_as_events(turns, conv_col, turn_col, role_col, text_col, piece)
    way = F.pmod(F.xxhash64("conv_id", "position", "part"), F.lit(5))
    wrong = F.reverse(F.substring("text", 1, draft))
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    nothing = F.lit(None).cast("string")
    again, edited = [event(-6, "delta", wrong), event(-5, "regenerate", nothing)], [event(-2, "delta", wrong)]
    gone = [event(-4, "delta", wrong), event(-3, "delete", nothing)]
    first = F.when(way.isin(2, 4), "edit").otherwise("delta")
    own = F.struct(F.col("seq"), F.when(F.col("seq") == 0, first).otherwise(F.lit("delta")).alias("kind"), F.col("text"))
    before = F.when(way == 1, F.array(*again, own)).when(way == 2, F.array(*edited, own)).when(way == 3, F.array(*gone, own)).when(way == 4, F.array(*again, *gone, *edited, own))
    events = F.when((F.col("seq") == 0) & (way > 0), before).otherwise(F.array(own))
    return log.select("conv_id", "position", "part", "role", F.explode(events).alias("e")).select("conv_id", "position", "part", "role", "e.seq", "e.kind", "e.text")
