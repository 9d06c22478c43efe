"""Chat transcripts from event logs: fold streamed events into messages, then render.

Events (conv_id, seq, turn, kind, role, text) of one message slot (conversation and turn) are sorted by
seq, which may be of any type that sorts, and folded:

* ``message`` adds a complete message to the slot,
* ``start`` opens a message (its role, its text if any),
* ``delta`` appends text to the slot's last message (opening one if there is none),
* ``edit`` replaces the text of the slot's last message,
* ``regenerate`` drops the slot's last message and opens a new one of its role, and drops all events of later
  turns of the conversation with a smaller seq.

So a message begins at its opening event, and its text is that of the last event that sets it, with all later
deltas behind it: each slot is cut at the openings, and every event is read once. Events of other kinds are ignored.

Messages are rendered as ``<|role|>``, newline, text, ``</s>``, newline. Inside texts and roles a backslash is
doubled and one is put after every ``<``, ``[`` and ``|``, so that no control string (``</s>``,
``[INST]``, ``<|...|>``) can occur there, and undoing it gives the text back. The loss mask is a list of
spans (code point offsets) of the assistants' texts.

Native: DataFrame functions only. Slots are folded before conversations gather, and no text meets another
conversation's; a conversation is one output string, so its text meets in one task, already rendered. Work
grows in proportion to events and characters. Null texts and roles are empty, ties of seq are decided by kind, role and text, repeated
``message`` events are messages of their own, texts of any length are kept whole, extra columns of any name are left
out, an empty table gives no rows, and rows with a null conv_id are one conversation, as SQL groups them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</s>\n"


def escape(c: Column) -> Column:
    for plain in ("\\", "<", "[", "|"):
        c = F.replace(c, F.lit(plain), F.lit(plain + "\\"))
    return c


def unescape(c: Column) -> Column:
    for plain in ("|", "[", "<", "\\"):
        c = F.replace(c, F.lit(plain + "\\"), F.lit(plain))
    return c


#: Offsets that one inner sum reaches back over; longer arrays go by totals of such pieces.
PIECE = 128


def offsets(sizes: Column) -> Column:
    """What the entries before each entry of an array of long add up to."""
    piece = lambda k: F.slice(sizes, k * PIECE + 1, PIECE)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PIECE).cast("int")), piece)
    totals = F.transform(pieces, total)
    inner = lambda xs, base: F.transform(xs, lambda _, i: base + total(F.slice(xs, F.lit(1), i)))
    many = F.flatten(F.transform(pieces, lambda xs, k: inner(xs, total(F.slice(totals, F.lit(1), k)))))
    return F.when(F.size(sizes) == 0, sizes).when(F.size(sizes) <= PIECE, inner(sizes, F.lit(0).cast("long"))).otherwise(many)


def _fold(events: Column) -> Column:
    """Messages (role, text) of one slot from its sorted events."""
    known = F.filter(events, lambda e: e["kind"].isin("message", "start", "delta", "edit", "regenerate"))
    # bound to a name by a one-element array, so each step is evaluated once
    opened = F.transform(F.array(known), lambda es: F.struct(
        es.alias("es"), F.filter(F.transform(es, lambda e, i: F.when((i == 0) | e["kind"].isin("message", "start"), i)), lambda i: i.isNotNull()).alias("at")
    ))

    def cut(o: Column) -> Column:
        end = lambda k: F.when(k + 1 < F.size(o["at"]), F.get(o["at"], k + 1)).otherwise(F.size(o["es"]))
        return F.transform(o["at"], lambda i, k: F.slice(o["es"], i + 1, end(k) - i))

    def text(own: Column) -> Column:
        set_ = F.array_max(F.transform(own, lambda e, i: F.when((i == 0) | (e["kind"] != "delta"), i)))
        return F.array_join(F.transform(F.slice(own, set_ + 1, F.size(own) - set_), lambda e: e["text"]), "")

    single = F.size(events) == 1  # most slots: nothing to fold
    whole = F.transform(known, lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text")))
    folded = F.flatten(F.transform(opened, lambda o: F.transform(cut(o), lambda own: F.struct(F.get(own, F.lit(0))["role"].alias("role"), text(own).alias("text")))))
    return F.when(single, whole).otherwise(folded)


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, messages (role, text): the final messages of each slot."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    event = F.struct("seq", "kind", role, text)
    slots = events.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(event)).alias("events"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again")
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("again").over(before)
    slots = slots.withColumn("cut", cut).withColumn("events", F.when(F.col("cut").isNull(), F.col("events")).otherwise(F.filter("events", lambda e: e["seq"] >= F.col("cut"))))
    return slots.select("conv_id", "turn", _fold(F.col("events")).alias("messages"))


def rendered(folded: DataFrame) -> DataFrame:
    """conv_id, formatted (the transcript) and loss_spans (start, length; code points, from 0)."""
    piece = F.transform("messages", lambda m: F.struct(
        F.concat(F.lit("<|"), escape(m["role"]), F.lit("|>\n")).alias("head"), escape(m["text"]).alias("body"), (m["role"] == "assistant").alias("loss")
    ))
    pieces = folded.select("conv_id", "turn", F.posexplode(piece).alias("place", "p")).select("conv_id", "turn", "place", "p.*")
    part = F.struct("turn", "place", F.concat("head", "body", F.lit(END)).alias("text"), F.length("head").alias("head"), F.length("body").alias("body"), "loss")
    conv = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    sizes = F.transform("parts", lambda p: (p["head"] + p["body"] + len(END)).cast("long"))
    conv = conv.select("conv_id", "parts", offsets(sizes).alias("at"))
    spans = F.zip_with("parts", "at", lambda p, at: F.when(p["loss"], F.struct((at + p["head"]).alias("start"), p["body"].cast("long").alias("length"))))
    return conv.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(transcripts: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text, loss) parsed from the transcript and its loss spans."""
    cut = F.split("formatted", END)
    segments = F.slice(cut, 1, F.size(cut) - 1)
    parsed = F.transform(segments, lambda x: F.struct(F.substring_index(x, "|>\n", 1).alias("head"), x.alias("all"), F.length(x).cast("long").alias("size")))
    rows = transcripts.select("conv_id", "formatted", "loss_spans", parsed.alias("parsed"))
    rows = rows.withColumn("at", offsets(F.transform("parsed", lambda p: p["size"] + len(END))))
    # body starts and spans in one order: a body is under the mask where a span of its start and length stands before it
    body = lambda p: p["size"] - F.length(p["head"]) - 3
    bodies = F.zip_with("parsed", "at", lambda p, at: F.struct((at + F.length(p["head"]) + 3).alias("start"), F.lit(1).alias("kind"), body(p).alias("length")))
    spans = F.transform("loss_spans", lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("kind"), s["length"].alias("length")))
    rows = rows.withColumn("line", F.array_sort(F.concat(spans, bodies)))
    before = lambda i: F.get(F.col("line"), i - 1)
    masked = F.filter(F.transform("line", lambda x, i: F.when(x["kind"] == 1, (i > 0) & F.coalesce((before(i)["kind"] == 0) & (before(i)["start"] == x["start"]) & (before(i)["length"] == x["length"]), F.lit(False)))), lambda m: m.isNotNull())
    rows = rows.withColumn("masked", masked)
    turns = F.zip_with("parsed", "masked", lambda p, m: F.struct(
        unescape(p["head"].substr(F.lit(3), F.length(p["head"]))).alias("role"),
        unescape(p["all"].substr(F.length(p["head"]) + 4, F.length(p["all"]))).alias("text"), m.alias("loss"),
    ))
    return rows.select("conv_id", "formatted", turns.alias("turns"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Logged conversation rows as ``message`` events in the order of their turns."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"),
        F.lit("message").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def logged_events(conversations: DataFrame) -> DataFrame:
    """An event log that a chat service could have written for the conversation rows, whose fold gives them back.

    By a hash of conversation and place, a row came as one message; as a start and deltas of its text in pieces; as a wrong
    text that was edited; or as an answer that was streamed wrongly, got a follow-up in the next turn, and was
    regenerated, which drops both. seq is the row's turn, its place among the turn's rows, and the step.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    way = F.pmod(F.xxhash64("conv_id", "turn", "place"), F.lit(4))
    rows = rows.withColumn("place", place).withColumn("way", way)
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))

    def event(step: int, kind: str, text: Column, later: int = 0) -> Column:
        seq = F.struct(F.col("turn").alias("turn"), F.col("place").alias("place"), F.lit(step).alias("step"))
        return F.struct(seq.alias("seq"), (F.col("turn") + later).alias("turn"), F.lit(kind).alias("kind"), F.col("role"), text.alias("text"))

    wrong = F.concat(F.lit("no, "), F.reverse("text"))
    log = (
        F.when(F.col("way") == 0, F.array(event(1, "message", F.col("text"))))
        .when(F.col("way") == 1, F.array(event(1, "start", F.lit("")), event(2, "delta", first), event(3, "delta", rest)))
        .when(F.col("way") == 2, F.array(event(1, "message", wrong), event(2, "edit", F.col("text"))))
        .otherwise(F.array(
            event(1, "start", F.lit("")), event(2, "delta", wrong), event(3, "message", wrong, later=1),
            event(4, "regenerate", F.lit("")), event(5, "delta", first), event(6, "delta", rest),
        ))
    )
    return rows.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation of an event log."""
    return rendered(messages(events))
