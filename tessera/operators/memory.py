"""Conversation memory (M1-M6) over a message table
``(conv_id, turn, role, text)``.

The reference keeps a deque of the newest ``2k`` user/assistant messages
per session.  In batch that is a per-session top-``2k`` by turn:
``row_number() over (partition by conv_id order by turn desc) <= 2k``,
which Spark plans with a partial WindowGroupLimit *before* the shuffle, so
even a session holding a third of all rows ships only ``2k`` rows per map
task.  Every later step works on at most ``2k`` rows per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rolling import global_row_index

# Roles the memory holds and their display names.
MEMORY_ROLES = ("user", "assistant")
DISPLAY = {"user": "User", "assistant": "Assistant"}


def memory_messages(messages: DataFrame) -> DataFrame:
    """Only user / assistant messages enter memory (system rows never do)."""
    return messages.where(F.col("role").isin(*MEMORY_ROLES))


def last_k(messages: DataFrame, k: int = 5, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """M1: newest ``2k`` messages per session; ``pos`` 1 = newest.  A lone
    user message takes a slot, so a window may start mid-exchange."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return (memory_messages(messages).withColumn("pos", F.row_number().over(w).cast("bigint"))
            .where(F.col("pos") <= 2 * k))


def last_k_per_session(messages: DataFrame, settings: DataFrame, default_k: int = 5,
                       session: str = "conv_id") -> DataFrame:
    """M5: a per-session ``k`` from a settings table ``(session, k)``.

    The rank is first limited by the largest ``k`` (one number), a literal
    that Spark applies before the shuffle, so a long session ships few
    rows; each session's own ``k`` then filters what is left.  Of several
    settings rows of one session the largest counts."""
    own = (settings.where(F.col(session).isNotNull() & F.col("k").isNotNull())
                   .groupBy(F.col(session).alias("_s")).agg(F.max("k").alias("_k")))
    largest = max(default_k, own.agg(F.max("_k")).first()[0] or 0)
    newest = last_k(messages, largest, session)
    return (newest.join(own, F.col(session) == F.col("_s"), "left")
                  .where(F.col("pos") <= 2 * F.coalesce(F.col("_k"), F.lit(default_k))).drop("_s", "_k"))


def save_context(exchanges: DataFrame, session: str = "conv_id") -> DataFrame:
    """M2: ``(session, seq, input, output)`` -> messages; each part is
    appended only when present (input first)."""
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("input").alias("text")),
        F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("output").alias("text")))
    return (exchanges.select(session, "seq", F.inline(parts)).where(F.col("text").isNotNull())
            .select(session, (F.col("seq") * 2 + F.col("part")).alias("turn"), "role", "text"))


def history(window: DataFrame, session: str = "conv_id") -> DataFrame:
    """M3: the kept messages as an ordered ``array<struct<turn, role, text>>``
    (at most ``2k`` per session)."""
    return window.groupBy(session).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def formatted(window: DataFrame, session: str = "conv_id") -> DataFrame:
    """M4: ``User: ...`` / ``Assistant: ...`` lines, oldest first."""
    label = F.create_map(*[x for k, v in DISPLAY.items() for x in (F.lit(k), F.lit(v))])
    h = history(window, session)
    return h.select(session, F.array_join(F.transform(
        F.filter("messages", lambda m: m["role"].isin(*MEMORY_ROLES)),
        lambda m: F.concat(label[m["role"]], F.lit(": "), m["text"])), "\n").alias("history"))


def apply_controls(messages: DataFrame, controls: DataFrame, session: str = "conv_id") -> DataFrame:
    """M6: control rows ``(session, turn, op)`` with op in clear / delete.

    ``clear`` drops the messages at or before its turn but keeps the
    session; ``delete`` removes the session (left-anti join).  Both are
    silent for unknown sessions.  Controls are aggregated to one row per
    session before the join, so the join is one-to-one."""
    last_clear = (controls.where(F.col("op") == "clear").groupBy(session)
                  .agg(F.max("turn").alias("_cleared_at")))
    deleted = controls.where(F.col("op") == "delete").select(session).distinct()
    kept = (messages.join(last_clear, session, "left")
                    .where(F.col("_cleared_at").isNull() | (F.col("turn") > F.col("_cleared_at")))
                    .drop("_cleared_at"))
    return kept.join(deleted, session, "left_anti")


def sessions(messages: DataFrame, k: int = 5, session: str = "conv_id") -> DataFrame:
    """M5 list: one row per session with its message count and window fill."""
    return (memory_messages(messages).groupBy(session)
            .agg(F.count(F.lit(1)).alias("n_messages"), F.min("turn").alias("first_turn"),
                 F.max("turn").alias("last_turn"))
            .withColumn("n_kept", F.least(F.col("n_messages"), F.lit(2 * k))))


def history_before_each(messages: DataFrame, k: int = 5, session: str = "conv_id") -> DataFrame:
    """For every user message, the ``2k`` memory messages before it in the
    same session (what the memory holds when that question is asked).

    Skew-safe: a dense global index over (session, turn) comes from the
    blocked plan in ``plans.rolling``; each question then fans out to at
    most ``2k`` index offsets and meets its predecessors by an equi-join on
    the index, so no session is ever gathered into one task."""
    m = global_row_index(memory_messages(messages).select(session, "turn", "role", "text"),
                         [session, "turn"], index_col="idx")
    q = m.where(F.col("role") == "user").select(
        F.col(session), F.col("turn").alias("q_turn"), F.col("idx").alias("q_idx"),
        F.explode(F.sequence(F.lit(1), F.lit(2 * k))).alias("off"))
    prev = m.select(F.col(session).alias("_s"), F.col("idx").alias("_i"), "turn", "role", "text")
    h = q.join(prev, (F.col("_i") == F.col("q_idx") - F.col("off")) & (F.col("_s") == F.col(session)))
    return h.groupBy(session, "q_turn").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
