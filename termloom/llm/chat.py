"""Chat formatting: final messages folded from an event log, rendered by a template that can be read back.

DataFrame operations only. Control strings inside a text are escaped by one backslash after their "<", and those that
look escaped already get one more, so taking one away restores any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, kind, role, text) to (conv_id, message, role, text), a row per message that isn't deleted.

    Events of a message apply by seq: delta appends its text, edit replaces all before it, regenerate starts the message
    anew (its own text is the first delta), delete removes it unless something follows. Other kinds and null kinds count
    as delta, null texts as empty. Events with equal seq apply in the order of kind, then text. The role is the last one
    given, '' if none is. Rows without a conversation form one conversation of their own. The log is cut into messages
    before it is gathered, so a task holds the events of one message, not of a conversation.
    """
    kind = F.coalesce(F.lower("kind"), F.lit("delta"))
    event = F.struct(F.col("seq").alias("seq"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role"))
    reset = kind.isin("edit", "regenerate", "delete")
    # The last reset and the last role come from the aggregation: looked up inside the filter, they would cost a pass of the log for each of its events.
    log = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(event)).alias("log"), F.max(F.when(reset, event)).alias("last"), F.max(F.when(F.col("role").isNotNull(), event)).alias("named")
    )
    last = F.col("last")
    live = F.when(last.isNull(), F.col("log")).otherwise(F.filter("log", lambda e: (e.seq > last.seq) | (e == last) | ((e.seq == last.seq) & (e.kind >= last.kind))))
    out = log.select("conv_id", "message", F.coalesce("named.role", F.lit("")).alias("role"), live.alias("live")).where(~((F.size("live") == 1) & (F.col("live")[0].kind == "delete")))
    texts = F.transform(F.filter("live", lambda e: e.kind != "delete"), lambda e: e.text)
    return out.select("conv_id", "message", "role", F.array_join(texts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) to (conv_id, formatted), messages in order; a conversation is one value."""
    turn = F.concat(F.lit(START), _role_out(F.coalesce("role", F.lit(""))), F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END + "\n"))
    turns = messages.select("conv_id", F.struct("message", turn.alias("turn")).alias("m"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m")).select("conv_id", F.array_join(F.transform("m", lambda x: x.turn), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, as array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, "\n")
        body = F.substring(p, at + F.lit(1), F.char_length(p) - at - F.lit(len(END) + 1))
        return F.struct(_role_in(F.substring(p, F.lit(1), at - F.lit(1))).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_texts(turns: Column) -> Column:
    """The texts under the loss mask: the assistant's, without the marks around them."""
    return F.transform(F.filter(turns, lambda t: t.role == "assistant"), lambda t: t.text)


#: Characters of a streamed delta.
DELTA = 1024


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A conversation table (conv_id, turn, role, text) as a log of the events that streaming it makes.

    Rows of a conversation follow each other by turn (null first), then role, then text; repeated rows stay. The
    message's key is that order, with a number for repeated rows. A message begins with a first draft, its role and a
    delta that says nothing final; it is regenerated, and then its text comes as deltas of DELTA characters, numbered by
    seq. So what is rendered is what the fold makes of the log, in whatever order its rows come."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    named = each.select("conv_id", F.struct("turn", "role", F.sha2("text", 256).alias("digest"), "copy").alias("message"), "role", "text")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    event = lambda seq, kind, role, text: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.alias("text"))
    draft = F.array(event(F.lit(0), "delta", F.lit(""), F.lit("draft")), event(F.lit(1), "regenerate", F.col("role"), F.lit("")))
    deltas = F.transform(pieces, lambda t, i: event(i + 2, "delta", F.lit(None), t))
    return named.select("conv_id", "message", F.inline(F.concat(draft, deltas)))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from (conv_id, formatted): turns, text under the loss mask, and their digests."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    read = read.withColumn("loss", F.array_join(loss_texts(F.col("turns")), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
