"""Prompts with retrieved context (R8 + R9 + R10): document chunks found by
sparse search and the statistics document, in both retrieval modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, sparse, stats, text
from ..sources.tables import read_table, sales_view
from .oracle import with_sales
from .rag_queries import _NL, QUESTIONS_CTE, R, STATDOC_CTES, _quick_sql
from .registry import register
from .rolling import materialize
from .stats_queries import _FACTS_SQL
from .text_queries import _SPARSE_CTES

_HITS_CTES = _SPARSE_CTES.strip() + """,
qtf AS (SELECT conv_id, turn, term, COUNT(*) AS tf
        FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM conversations WHERE role = 'user') GROUP BY ALL),
qw AS (SELECT conv_id, turn, term, CAST(floor(1000 * tf * idf) AS BIGINT) AS w FROM qtf JOIN idf USING (term)),
qv AS (SELECT conv_id, turn, term, CAST(floor(1e6::DOUBLE * w / sqrt(CAST(SUM(w * w) OVER (PARTITION BY conv_id, turn) AS DOUBLE))) AS BIGINT) AS nw
       FROM qw WHERE w > 0),
sc AS (SELECT conv_id, turn, doc_id, chunk_pos, SUM(qv.nw * vec.nw) AS score FROM qv JOIN vec USING (term) GROUP BY ALL),
hit AS (SELECT conv_id, turn, rank, substring(d.text, chunk_pos * 800 + 1, 1000) AS content
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id, chunk_pos) AS rank FROM sc WHERE score > 0) x
        JOIN documents d ON d.doc_id = x.doc_id WHERE rank <= 5)"""


def _context_sql(mode: str, most: int) -> str:
    """The first five of the hits up to rank ``most`` and, after them, the statistics document."""
    return f"""{mode} AS (
  SELECT conv_id, turn, COUNT(*) AS n, string_agg(content, {_NL} || {_NL} ORDER BY position) AS context
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY src, rank) AS position FROM (
          SELECT conv_id, turn, 0 AS src, rank, content FROM hit WHERE rank <= {most}
          UNION ALL SELECT q.conv_id, q.turn, 1, 0, s.page_content FROM q JOIN statdocs s ON q.intent = s.intent))
  WHERE position <= 5 GROUP BY ALL)"""


def _prompt_sql(context: str) -> str:
    tpl = retrieval.TEMPLATES["rag"]
    out = []
    for piece in tpl.replace("{context}", "\0c\0").replace("{statistics}", "\0s\0").replace("{question}", "\0q\0").split("\0"):
        out.append({"c": f"COALESCE({context}, '')", "s": _quick_sql("q.question"), "q": "q.question"}.get(
            piece, "'" + piece.replace("\n", f"' || {_NL} || '") + "'"))
    return " || ".join(out)


@register("rag_prompt_context", with_sales(f"""
SELECT q.conv_id, q.turn, q.intent, COALESCE(reserved.n, 0) AS n_reserved, COALESCE(parity.n, 0) AS n_parity,
       {_prompt_sql('reserved.context')} AS prompt, {_prompt_sql('parity.context')} AS prompt_parity
FROM q LEFT JOIN reserved ON q.conv_id = reserved.conv_id AND q.turn = reserved.turn
LEFT JOIN parity ON q.conv_id = parity.conv_id AND q.turn = parity.turn, facts f""",
    *STATDOC_CTES, QUESTIONS_CTE, _FACTS_SQL, _HITS_CTES, _context_sql("reserved", 4), _context_sql("parity", 5)))
def q_rag_prompt_context(spark, sf_dir):
    """The human message of every user turn with its retrieved context.

    ``prompt`` keeps a slot of the five for the statistics document; ``prompt_parity`` takes the first five
    of hits and statistics in the reference's order, where five hits leave none."""
    sv = sales_view(spark, sf_dir)
    users = read_table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    chunks = text.chunk_fixed(read_table(spark, sf_dir, "documents"))
    key = ["conv_id", "turn"]
    hits = sparse.search(sparse.build(chunks, ["doc_id", "chunk_pos"], "chunk_text"), users, key, "question", k=5)
    # the texts of at most five chunks a question; both modes and no second search read them
    hits = materialize(hits.join(chunks.select("doc_id", "chunk_pos", F.col("chunk_text").alias("page_content")), ["doc_id", "chunk_pos"])
                           .select(F.struct(*key).alias("question_id"), "rank", F.lit("chunk").alias("source"), "page_content"))
    docs = materialize(retrieval.statistics_documents(sv, R))
    asked = retrieval.attach_statistics(users, docs)
    stat = asked.select(F.struct(*key).alias("question_id"), "page_content")
    out = stats.quick_statistics(retrieval.classify(users), "question", stats.table_facts(sv, R), R)
    for name, reserve in (("reserved", True), ("parity", False)):
        ranked = retrieval.hybrid_topk(hits, stat, 5, reserve_stats=reserve)
        found = ranked.groupBy("question_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        found = found.join(retrieval.context_text(ranked).withColumnRenamed("context", f"context_{name}"), "question_id")
        out = out.join(found.select("question_id.*", f"n_{name}", f"context_{name}"), key, "left")

    def prompt(context):
        return retrieval.render_template("rag", context=F.col(context), statistics=F.col("statistics"), question=F.col("question"))
    return out.select(*key, "intent", F.coalesce("n_reserved", F.lit(0).cast("long")).alias("n_reserved"),
                      F.coalesce("n_parity", F.lit(0).cast("long")).alias("n_parity"),
                      prompt("context_reserved").alias("prompt"), prompt("context_parity").alias("prompt_parity"))
