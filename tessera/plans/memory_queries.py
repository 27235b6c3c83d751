"""Registered conversation-memory queries (M1-M5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory
from ..sources.tables import read_table
from .registry import register

_MEM = "conversations WHERE role IN ('user', 'assistant')"


def _conv(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations")


def _lastk_sql(k):
    return f"""
SELECT conv_id, turn, role, text, pos FROM (
  SELECT conv_id, turn, role, text,
         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM {_MEM})
WHERE pos <= {2 * k}"""


@register("memory_lastk", _lastk_sql(5))
def q_memory_lastk(spark, sf_dir):
    return memory.last_k(_conv(spark, sf_dir), k=5)


@register("memory_lastk2", _lastk_sql(2))
def q_memory_lastk2(spark, sf_dir):
    return memory.last_k(_conv(spark, sf_dir), k=2)


@register("memory_messages", f"""
SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_messages,
       string_agg(role, ',' ORDER BY turn) AS roles, MIN(turn) AS first_turn, MAX(turn) AS last_turn
FROM ({_lastk_sql(2)}) GROUP BY conv_id""")
def q_memory_messages(spark, sf_dir):
    h = memory.history(memory.last_k(_conv(spark, sf_dir), k=2))
    return h.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    F.col("messages")[0]["turn"].alias("first_turn"),
                    F.element_at("messages", -1)["turn"].alias("last_turn"))


@register("memory_formatted", f"""
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text,
                           chr(10) ORDER BY turn) AS history
FROM ({_lastk_sql(5)}) GROUP BY conv_id""")
def q_memory_formatted(spark, sf_dir):
    return memory.formatted(memory.last_k(_conv(spark, sf_dir), k=5))


@register("memory_append", """
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
     ex AS (SELECT u.conv_id, u.turn AS seq, u.text AS input, a.text AS output
            FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)
SELECT conv_id, seq * 2 AS turn, 'user' AS role, input AS text FROM ex WHERE input IS NOT NULL
UNION ALL
SELECT conv_id, seq * 2 + 1, 'assistant', output FROM ex WHERE output IS NOT NULL""")
def q_memory_append(spark, sf_dir):
    c = _conv(spark, sf_dir)
    u = c.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("seq"),
                                               F.col("text").alias("input"))
    a = c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("output"))
    ex = u.join(a, (a.a_conv == u.conv_id) & (a.a_turn == u.seq + 1), "left").drop("a_conv", "a_turn")
    return memory.save_context(ex).select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                                          "role", "text")


@register("sessions", f"""
SELECT conv_id, COUNT(*) AS n_messages, MIN(turn) AS first_turn, MAX(turn) AS last_turn,
       LEAST(COUNT(*), 10) AS n_kept
FROM {_MEM} GROUP BY conv_id""")
def q_sessions(spark, sf_dir):
    return memory.sessions(_conv(spark, sf_dir), k=5)


@register("memory_own_k", f"""
SELECT conv_id, turn, role, text, pos FROM (
  SELECT conv_id, turn, role, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM {_MEM})
WHERE pos <= CASE WHEN conv_id % 3 = 0 THEN 10 ELSE 2 * (1 + conv_id % 3) END""")
def q_memory_own_k(spark, sf_dir):
    """Sessions with settings of their own (derived from their ids), the others with the default."""
    c = _conv(spark, sf_dir)
    settings = c.select("conv_id").distinct().where("conv_id % 3 <> 0").select("conv_id", (1 + F.col("conv_id") % 3).cast("int").alias("k"))
    return memory.last_k_per_session(c, settings, default_k=5)


@register("session_control", """
SELECT c.conv_id, turn, role, text FROM conversations c
WHERE conv_id % 5 <> 1 AND NOT (conv_id % 5 = 2 AND turn <= COALESCE((SELECT MIN(turn) FROM conversations d
                                                             WHERE d.conv_id = c.conv_id AND role = 'assistant'), -1))""")
def q_session_control(spark, sf_dir):
    """Some sessions deleted, some cleared at their first answer."""
    c = _conv(spark, sf_dir)
    deleted = c.where("conv_id % 5 = 1").select("conv_id", "turn", F.lit("delete").alias("op"))
    cleared = (c.where("conv_id % 5 = 2 and role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("turn"))
                .select("conv_id", "turn", F.lit("clear").alias("op")))
    return memory.apply_controls(c, deleted.unionByName(cleared)).select("conv_id", "turn", "role", "text")
