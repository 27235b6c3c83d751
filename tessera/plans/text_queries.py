"""Registered chunking, embedding and vector-search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ann, retrieval, sparse, text, vector
from ..session import ensure_checkpoint_dir
from ..sources.tables import SALES_ROLES, read_table, sales_view
from .registry import register
from .rolling import materialize


@register("chunk_fixed", """
SELECT doc_id, CAST(p AS BIGINT) AS chunk_pos, CAST(p * 800 AS BIGINT) AS chunk_start,
       substring(text, p * 800 + 1, 1000) AS chunk_text,
       CAST(length(substring(text, p * 800 + 1, 1000)) AS BIGINT) AS chunk_len
FROM (SELECT doc_id, text,
             unnest(generate_series(0, greatest(CAST(ceil((length(text) - 1000) / 800) AS BIGINT), 0))) AS p
      FROM documents)""")
def q_chunk_fixed(spark, sf_dir):
    return text.chunk_fixed(read_table(spark, sf_dir, "documents"))


@register("chunk_recursive")
def q_chunk_recursive(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return text.chunk_recursive(docs, keys=("doc_id", "lang", "source"))


@register("embed_tfidf")
def q_embed_tfidf(spark, sf_dir):
    # the Python splitter runs once; fit and transform both read the result
    chunks = materialize(text.chunk_recursive(read_table(spark, sf_dir, "documents")))
    model = text.fit_tfidf(chunks, dims=512)
    out = text.embed(model, chunks, "chunk_text")
    return out.select("doc_id", "chunk_pos", "n_tokens", "embedding")


# TF-IDF vectors of the fixed chunks of all documents, as (doc_id, chunk_pos, term, nw).
_SPARSE_CTES = """
c AS (SELECT doc_id, CAST(p AS BIGINT) AS chunk_pos, lower(substring(text, p * 800 + 1, 1000)) AS chunk_text
      FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 1000) / 800) AS BIGINT), 0))) AS p
            FROM documents)),
total AS (SELECT COUNT(*) AS n FROM c),
tf AS (SELECT doc_id, chunk_pos, term, COUNT(*) AS tf
       FROM (SELECT doc_id, chunk_pos, unnest(regexp_extract_all(chunk_text, '[a-z0-9_]+')) AS term FROM c) GROUP BY ALL),
idf AS (SELECT term, ln((n + 1)::DOUBLE / (df + 1)::DOUBLE) AS idf FROM (SELECT term, COUNT(*) AS df FROM tf GROUP BY term), total),
w AS (SELECT doc_id, chunk_pos, term, CAST(floor(1000 * tf * idf) AS BIGINT) AS w FROM tf JOIN idf USING (term)),
vec AS (SELECT doc_id, chunk_pos, term, CAST(floor(1e6::DOUBLE * w / sqrt(CAST(SUM(w * w) OVER (PARTITION BY doc_id, chunk_pos) AS DOUBLE))) AS BIGINT) AS nw
        FROM w WHERE w > 0)"""


@register("embed_sparse", f"""WITH {_SPARSE_CTES}
SELECT doc_id, chunk_pos, COUNT(*) AS n_terms, CAST(MAX(nw) AS BIGINT) AS greatest_weight,
       md5(string_agg(term || ':' || CAST(nw AS VARCHAR), ' ' ORDER BY term)) AS vector_md5
FROM vec WHERE nw > 0 GROUP BY doc_id, chunk_pos""")
def q_embed_sparse(spark, sf_dir):
    """R5 over the fixed chunks of all documents: sparse vectors, as digests of their sorted terms and weights."""
    index = sparse.build(text.chunk_fixed(read_table(spark, sf_dir, "documents")), ["doc_id", "chunk_pos"], "chunk_text")
    listed = F.array_join(F.zip_with("terms", "nws", lambda t, n: F.concat(t, F.lit(":"), n.cast("string"))), " ")
    return index.vectors.select(
        "key.*", F.size("terms").cast("long").alias("n_terms"), F.array_max("nws").cast("long").alias("greatest_weight"),
        F.md5(listed).alias("vector_md5"))


@register("sparse_topk", f"""WITH {_SPARSE_CTES},
qtf AS (SELECT conv_id, turn, term, COUNT(*) AS tf
        FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM conversations WHERE role = 'user') GROUP BY ALL),
qw AS (SELECT conv_id, turn, term, CAST(floor(1000 * tf * idf) AS BIGINT) AS w FROM qtf JOIN idf USING (term)),
q AS (SELECT conv_id, turn, term, CAST(floor(1e6::DOUBLE * w / sqrt(CAST(SUM(w * w) OVER (PARTITION BY conv_id, turn) AS DOUBLE))) AS BIGINT) AS nw
      FROM qw WHERE w > 0),
s AS (SELECT conv_id, turn, doc_id, chunk_pos, CAST(SUM(q.nw * vec.nw) AS BIGINT) AS score FROM q JOIN vec USING (term) GROUP BY ALL)
SELECT conv_id, turn, rank, doc_id, chunk_pos, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id, chunk_pos) AS rank FROM s WHERE score > 0)
WHERE rank <= 5""")
def q_sparse_topk(spark, sf_dir):
    """R3 / R8 search part: the 5 best fixed chunks of every user turn, from posting lists."""
    index = sparse.build(text.chunk_fixed(read_table(spark, sf_dir, "documents")), ["doc_id", "chunk_pos"], "chunk_text")
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return sparse.search(index, conv, ["conv_id", "turn"], "text", k=5)


@register("vector_topk", """
WITH x AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i,
                  unnest(embedding) AS v FROM embeddings),
     d AS (SELECT label, i, AVG(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, i),
     c AS (SELECT label, list(m ORDER BY i) AS centroid FROM d GROUP BY label),
     r AS (SELECT CAST(c.label AS BIGINT) AS query_id, e.vec_id AS id,
                  list_distance(CAST(e.embedding AS DOUBLE[]), c.centroid) AS distance
           FROM c, embeddings e)
SELECT query_id, rank, id, ROUND(distance, 6) AS distance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM r)
WHERE rank <= 5""")
def q_vector_topk(spark, sf_dir):
    """Top-5 vectors nearest to each label's centroid (queries derived from
    the table, so the work grows with it)."""
    emb = read_table(spark, sf_dir, "embeddings")
    cent = vector.centroids(emb, "label")
    out = vector.knn(emb, cent, k=5, id_col="vec_id", vec_col="embedding",
                     query_id="label", query_vec="centroid")
    return out.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def _ann(spark, sf_dir, k: int):
    """Index of all embeddings, probed by every 50th of them."""
    emb = read_table(spark, sf_dir, "embeddings")
    asked = emb.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    index = ann.build(emb, f"{ensure_checkpoint_dir(spark).rstrip('/')}/ann/{uuid.uuid4().hex}", "vec_id")
    probes, recall = ann.probes_for(index, emb, asked, k, 0.95, "vec_id", "embedding", "query_id", "embedding")
    return emb, asked, ann.search(index, asked, k, probes), recall


@register("vector_ann")
def q_vector_ann(spark, sf_dir):
    """The 10 nearest vectors of every 50th vector by the inverted-file index; recall is
    measured against exact search on at most 200 of the queries."""
    *_, found, recall = _ann(spark, sf_dir, 10)
    return found.withColumn("recall", F.lit(recall))


@register("vector_ann_recall", """
SELECT COUNT(*) AS n_queries, CAST(10 AS BIGINT) AS k, TRUE AS floor_reached FROM embeddings WHERE vec_id % 50 = 0""")
def q_vector_ann_recall(spark, sf_dir):
    """Recall of ``vector_ann`` against exact search (R3) over all its queries: 0.9 at least."""
    emb, asked, found, _ = _ann(spark, sf_dir, 10)
    exact = vector.knn(emb, asked, k=10, id_col="vec_id", vec_col="embedding")
    return ann.recall(found, exact).agg(F.count(F.lit(1)).alias("n_queries"), F.max("k").alias("k"),
                                        (F.sum("hits") >= 0.9 * F.sum("k")).alias("floor_reached"))


@register("hybrid_topk")
def q_hybrid_topk(spark, sf_dir):
    """R5 + R3 + R2 + R8 + R9: every user turn retrieves its nearest
    document chunks (sparse TF-IDF, cosine) and its statistics document; the
    hybrid list is cut to k = 5 with one slot kept for statistics."""
    split = text.chunk_recursive(read_table(spark, sf_dir, "documents"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chunks/{uuid.uuid4().hex}"
    split.write.option("compression", "zstd").parquet(path)     # a checkpoint is not compressed
    chunks = spark.read.schema(split.schema).parquet(path)
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    qs = conv.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), "conv_id", "turn", F.col("text").alias("question"))
    hits = sparse.search(sparse.build(chunks, ["doc_id", "chunk_pos"], "chunk_text"), qs, ["question_id"], "question", k=5)
    hits = (hits.join(chunks.select("doc_id", "chunk_pos", F.col("chunk_text").alias("page_content")), ["doc_id", "chunk_pos"])
                .select("question_id", "rank", F.concat_ws(":", F.lit("chunk"), "doc_id", "chunk_pos").alias("source"), "page_content"))
    st = retrieval.attach_statistics(qs, retrieval.statistics_documents(sales_view(spark, sf_dir, materialized=True),
                                                                        SALES_ROLES))
    ranked = retrieval.hybrid_topk(hits, st.select("question_id", "page_content"), k=5)
    return (retrieval.context_text(ranked, rows=True).join(qs.select("question_id", "conv_id", "turn"), "question_id")
                     .select("conv_id", "turn", "position", "source", "content", "context"))


@register("chunk_invariants", """
SELECT doc_id, TRUE AS sizes_ok, TRUE AS words_kept, TRUE AS overlap_ok FROM documents WHERE length(text) > 0""")
def q_chunk_invariants(spark, sf_dir):
    """Per document: no chunk above 1000 characters, every word in some chunk, no more than 200
    characters repeated from chunk to chunk."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").where(F.length("text") > 0)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    per = (text.chunk_recursive(docs).groupBy(F.col("doc_id").alias("c_doc"))
           .agg(F.max("chunk_len").alias("longest"), F.sum("chunk_len").alias("total"), F.count(F.lit(1)).alias("n"),
                F.array_distinct(F.flatten(F.collect_list(words("chunk_text")))).alias("got")))
    return docs.join(per, F.col("doc_id") == F.col("c_doc")).select(
        "doc_id", (F.col("longest") <= 1000).alias("sizes_ok"), (F.size(F.array_except(words("text"), "got")) == 0).alias("words_kept"),
        (F.col("total") <= F.length("text") + 200 * (F.col("n") - 1)).alias("overlap_ok"))
