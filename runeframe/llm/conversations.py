"""Conversations rebuilt from message rows.

Every message points at its parent, the message of the same channel one position earlier. The
pointers are resolved by pointer jumping: each round, a pointer to a message that is not yet
resolved is replaced by that message's own pointer, so chains of n messages resolve in about
log2(n) rounds of equi-joins on (channel, position). A chain that ends at the root is whole; one
that ends at a missing parent makes its messages orphans; one that never ends is a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeframe.session import cut_lineage

#: What is left of a text that shows nothing: white space, and characters without a glyph.
NOTHING_VISIBLE = r"^[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{2800}]*$"

WHOLE, ORPHAN, CYCLE = "whole", "orphan", "cycle"


def is_blank(text: Column) -> Column:
    """True for null texts and texts that show nothing."""
    return text.isNull() | text.rlike(NOTHING_VISIBLE)


def handle(author: Column) -> Column:
    """An author as a member's handle: without padding, case and a trailing ``(pinned)``."""
    bare = F.regexp_replace(author, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r"(?i)\s*\(pinned\)$", "")), r"\s+$", "")


def resolve_parents(messages: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """``group, node, state``: where each message's chain of parents ends.

    ``node`` is unique in its group; a null ``parent`` marks a root. Chains to a root are
    ``whole``, chains to a parent that does not exist ``orphan``, chains that return ``cycle``.
    Rows with null group or node are left out.
    """
    nodes = messages.select(F.col(group).alias("g"), F.col(node).alias("v"), F.col(parent).alias("p")).where("g is not null and v is not null")
    known = nodes.select("g", F.col("v").alias("p"), F.lit(True).alias("exists"))
    state = F.when(F.col("p").isNull(), WHOLE).when(F.col("exists").isNull(), ORPHAN)
    step = cut_lineage(nodes.join(known, ["g", "p"], "left").select("g", "v", F.when(state.isNull(), F.col("p")).alias("p"), state.alias("s")))
    total, open_now = step.agg(F.count(F.lit(1)), F.count("p")).first()
    settled, step, rounds = step.where("p is null"), step.where("p is not null"), 0
    while open_now and 2**rounds <= total:
        # only open messages jump and are written again; what is settled stays where it was written
        above = settled.unionAll(step).select("g", F.col("v").alias("p"), F.col("p").alias("pp"), F.col("s").alias("ps"))
        jumped = cut_lineage(step.join(above, ["g", "p"]).select("g", "v", F.when(F.col("ps").isNull(), F.col("pp")).alias("p"), F.col("ps").alias("s")))
        settled, step = settled.unionAll(jumped.where("p is null")), jumped.where("p is not null")
        open_now = step.count()
        rounds += 1
    return settled.unionAll(step).select(F.col("g").alias(group), F.col("v").alias(node), F.coalesce("s", F.lit(CYCLE)).alias("state"))


def _rows(messages: DataFrame, channels: DataFrame, members: DataFrame) -> DataFrame:
    """One row per channel and position of the threads, with role and visibility.

    Repeated rows are copies: the first is taken. A handle listed more than once has the first of its roles by name.
    """
    threads = channels.where("kind = 'thread' and channel is not null").select("channel").distinct()
    handles = members.where("author is not null").select(F.lower(F.trim("author")).alias("handle"), "speaker_role").groupBy("handle").agg(F.min("speaker_role").alias("speaker_role"))
    rows = (
        messages.select("channel", "seq", "id", "author", "body")
        .join(threads, "channel", "left_semi")
        .groupBy("channel", "seq")
        .agg(F.min_by(F.struct("id", "author", "body"), "id").alias("m"))
        .select("channel", "seq", "m.id", "m.author", "m.body")
    )
    return rows.withColumn("handle", handle(F.col("author"))).join(F.broadcast(handles) if _small(handles) else handles, "handle", "left")


def _small(df: DataFrame, bound: int = 100_000) -> bool:
    """Whether a table has at most ``bound`` rows; read only as far as needed to know."""
    return df.limit(bound + 1).count() <= bound


def thread_states(messages: DataFrame, channels: DataFrame, members: DataFrame) -> DataFrame:
    """``channel, broken, nameless, unanswered``: why a thread is unusable; all false for a usable one.

    A thread is broken if its positions are not 1, 2, 3 … without a hole (a thread without
    messages is broken, a null position breaks it), nameless if a row's author is null or shows
    nothing, unanswered if no assistant row with visible text follows a user row with visible text.
    """
    rows = _rows(messages, channels, members)
    placed = rows.where("seq is not null").select("channel", "seq", F.when(F.col("seq") != 1, F.col("seq") - 1).alias("parent"))
    states = resolve_parents(placed, "channel", "seq", "parent").groupBy("channel").agg(F.max(F.col("state") != WHOLE).alias("torn"))
    seen = ~is_blank(F.col("body"))
    facts = rows.groupBy("channel").agg(
        F.max(F.col("seq").isNull()).alias("unplaced"),
        F.max(is_blank(F.col("author"))).alias("nameless"),
        F.min(F.when(seen & (F.col("speaker_role") == "user"), F.col("seq"))).alias("first_question"),
        F.max(F.when(seen & (F.col("speaker_role") == "assistant"), F.col("seq"))).alias("last_answer"),
    )
    threads = channels.where("kind = 'thread' and channel is not null").select("channel").distinct()
    return (
        threads.join(facts, "channel", "left")
        .join(states, "channel", "left")
        .select(
            "channel",
            F.coalesce(F.col("torn") | F.col("unplaced"), F.lit(True)).alias("broken"),
            F.coalesce("nameless", F.lit(False)).alias("nameless"),
            F.coalesce(F.col("last_answer") <= F.col("first_question"), F.lit(True)).alias("unanswered"),
        )
    )


def conversations(messages: DataFrame, channels: DataFrame, members: DataFrame) -> DataFrame:
    """``channel, seq, role, author, body``: the usable threads, one row per turn from root to leaf, in order of channel and position.

    A whole thread's positions are 1, 2, 3 …, so ``seq`` is a turn's place in its conversation. A
    role is null where no member has the author's handle. Turns stay rows, ordered by range
    partitions, so a very long thread is never gathered in one place.
    """
    usable = thread_states(messages, channels, members).where("not (broken or nameless or unanswered)").select("channel")
    turns = _rows(messages, channels, members).join(usable, "channel", "left_semi")
    return turns.select("channel", "seq", F.col("speaker_role").alias("role"), "author", "body").orderBy("channel", "seq")
