"""Registered streaming and store round-trip queries (M7, D7s, S4-S8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import documents
from ..session import ensure_checkpoint_dir
from ..sources import store
from ..sources.tables import SALES_ROLES, read_table, sales_view
from ..streaming.daily_summary import run_daily_summary
from ..streaming.memory_state import stream_memory
from ..streaming.session_state import run_sessions
from .doc_queries import _GROUP_CTES, _SUMMARY_CTES
from .memory_queries import _lastk_sql
from .oracle import with_sales
from .rag_queries import q_eval_detail
from .registry import ORACLE_SQL, register


def _stream_path(sf_dir, table):
    """A file stream source watches a directory or glob; the fixture is one
    file per table, so watch a glob that matches it (and later arrivals
    named like it)."""
    return f"{sf_dir.rstrip('/')}/{table}*.parquet"


@register("stream_memory", _lastk_sql(5))
def q_stream_memory(spark, sf_dir):
    """M7: the streamed window state equals batch M1 on the same input."""
    return stream_memory(spark, _stream_path(sf_dir, "conversations"), k=5)


@register("stream_session_control", """
SELECT conv_id, turn, role, text, pos FROM (
  SELECT conv_id, turn, role, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos
  FROM conversations c WHERE role IN ('user', 'assistant') AND conv_id % 5 <> 1
    AND NOT (conv_id % 5 = 2 AND turn <= COALESCE((SELECT MIN(turn) FROM conversations d
                                                   WHERE d.conv_id = c.conv_id AND role = 'assistant'), -1)))
WHERE pos <= CASE WHEN conv_id % 3 = 0 THEN 10 ELSE 2 * (1 + conv_id % 3) END""")
def q_stream_session_control(spark, sf_dir):
    """M7 with M5 and M6: the controls of ``session_control`` and the settings of ``memory_own_k``, written as
    files of their own, stream beside the messages."""
    c = read_table(spark, sf_dir, "conversations")
    control = lambda df, op, k: df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(op).alias("op"), k.cast("int").alias("k"))
    none = F.lit(None)
    per = c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first"))
    rows = (control(per.where("conv_id % 5 = 1"), "delete", none)
            .unionByName(control(per.where("conv_id % 5 = 2 and first is not null").select("conv_id", F.col("first").alias("turn")), "clear", none))
            .unionByName(control(per.where("conv_id % 3 <> 0"), "k", 1 + F.col("conv_id") % 3)))
    path = _scratch(spark, "controls")
    rows.write.parquet(path)
    return run_sessions(spark, _stream_path(sf_dir, "conversations"), path, default_k=5)


@register("stream_daily_summary", """
WITH d AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(ts AS DATE) AS dd, event_type,
                  COUNT(*) AS n_events, SUM(value) AS total_value
           FROM events GROUP BY 1, 2, 3)
SELECT day, event_type, n_events, ROUND(total_value, 6) AS total_value FROM d
WHERE CAST(dd AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""")
def q_stream_daily_summary(spark, sf_dir):
    """D7s: closed days of the watermarked daily summary."""
    out = run_daily_summary(spark, _stream_path(sf_dir, "events"), delay="1 day")
    return out.select("day", "event_type", "n_events", F.round("total_value", 6).alias("total_value"))


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("kb_roundtrip", with_sales("""
SELECT doc_type, key, n_rows, page_content,
       CASE doc_type WHEN 'summary' THEN 0 WHEN 'time_period' THEN 1 WHEN 'product' THEN 2 ELSE 3 END AS part,
       doc_type || ':' || key AS doc_id
FROM (SELECT doc_type, key, CAST(NULL AS BIGINT) AS n_rows, page_content FROM summary
      UNION ALL SELECT * FROM groups)""", *_SUMMARY_CTES, *_GROUP_CTES))
def q_kb_roundtrip(spark, sf_dir):
    """S4 + S5: write the document corpus as a store, read it back."""
    d = _scratch(spark, "kb")
    store.write_store(d, documents=documents.corpus(sales_view(spark, sf_dir, materialized=True), SALES_ROLES))
    return store.read_store(spark, d, "documents")


@register("eval_report", ORACLE_SQL["eval_detail"])
def q_eval_report(spark, sf_dir):
    """The evaluation detail written as CSV with a header, read back."""
    path = _scratch(spark, "report")
    detail = q_eval_detail(spark, sf_dir)
    store.write_report(detail, path)
    return store.read_report(spark, path, detail.schema)
