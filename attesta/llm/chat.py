"""Chat formatting by event-sourced reconstruction. DataFrame functions only.

A log holds events ``(conv_id, seq, msg, kind, role, text)``: ``delta`` appends to message ``msg``, ``edit`` puts the
text in place of what the message had, ``regenerate`` does that too and drops all later messages of that time.
Events are folded into final messages, messages rendered as turns, turns joined in order.

A turn reads ``<|im_start|>role LF text <|im_end|> LF``. In roles and texts a backslash becomes two and ``<|``
becomes ``<\\|``, so no control string can arise inside; in roles a line feed gets a backslash as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Finished turns ``(conv_id, turn, role, text)`` as events: each is one delta. Turns of one number become neighbours, by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return turns.withColumn("seq", F.row_number().over(order)).select("conv_id", "seq", F.col("seq").alias("msg"), F.lit("delta").alias("kind"), "role", "text")


def folded(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, msg, role, text)`` of an event log.

    The text of a message is the concatenation, by seq, of its events from its last edit or regenerate on; ties of
    seq go by kind, role and text. Its role is that of its last event with one; null roles and texts are empty. A
    message goes if a regenerate of an earlier message of its conversation came after all its own events. An
    unknown kind counts as delta; null conv_ids are one conversation; a null msg comes first. Messages are folded per message with
    map-side partial sums, and the drop needs one running maximum per conversation.
    """
    resets = F.col("kind").isin("edit", "regenerate")
    event = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = events.groupBy("conv_id", "msg").agg(
        F.array_sort(F.collect_list(event)).alias("log"),
        F.max(F.when(resets, F.struct("seq", "kind"))).alias("reset"),
        F.max("seq").alias("last"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    live = F.filter("log", lambda e: F.col("reset").isNull() | (F.struct(e["seq"].alias("seq"), e["kind"].alias("kind")) >= F.col("reset")))
    earlier = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    m = m.select(
        "conv_id", "msg", "last", "again",
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
        F.coalesce(F.get(F.filter(F.reverse("log"), lambda e: e["role"] != ""), F.lit(0))["role"], F.lit("")).alias("role"),
    ).withColumn("cut", F.max("again").over(earlier))
    return m.where("cut is null or last is null or last >= cut").select("conv_id", "msg", "role", "text")


def rendered(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` of messages ``(conv_id, msg, role, text)``.

    loss lists the spans ``(start, length)`` of the trained role's texts in ``formatted``, in code points from 0.
    Messages stand in order of msg, then role and text where msg is repeated. One conversation is one string, as the
    format asks; running sums of lengths give the spans without a second pass.
    """
    turn = F.concat(F.lit(OPEN), F.col("erole"), F.lit("\n"), F.col("etext"), F.lit(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("msg", "role", "text")
    m = messages.select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("erole", escaped_role(F.col("role"))).withColumn("etext", escaped(F.col("text"))).withColumn("turn", turn)
    ends = F.sum(F.length("turn")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = m.select(
        "conv_id", F.row_number().over(order).alias("at"), "turn", (F.col("role") == TRAINED_ROLE).alias("trained"),
        (ends - F.length("etext") - len(CLOSE)).alias("start"), F.length("etext").cast("long").alias("length"),
    )
    return m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "trained", "start", "length"))).alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
    )


def parsed(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, an array of ``(role, text)``, read back from the column ``formatted``."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"
    return formatted.withColumn(
        "turns",
        F.transform(pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text"))),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of ``rendered`` output, all taken from the formatted text and its loss spans."""
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return (
        parsed(formatted)
        .withColumn("masked", F.array_join(masked, ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("masked").cast("long").alias("loss_chars"),
            F.sha2("masked", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
