"""Routing, statistics documents, hybrid retrieval and prompts
(R1, R2, R8-R12).

The reference answers one question at a time and recomputes statistics
per question.  Here a *question table* flows through one plan: intents
are column expressions, the statistics documents are computed once (at
most six rows, so their broadcast is bounded by construction) and joined
on the intent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.roles import resolve_roles
from ..plans.rolling import materialize
from . import stats

# Intent rules, tested in this order on the lower-cased
# question as substrings; the first rule with a hit wins, else 'general'.
INTENT_RULES = (
    ("sales", ("sales", "revenue", "sell", "sold")),
    ("product", ("product", "item")),
    ("region", ("region", "location", "area", "geographic")),
    ("customer", ("customer", "buyer", "demographics", "age", "gender")),
    ("time", ("trend", "time", "period", "month", "year", "quarter")),
    ("statistics", ("average", "mean", "median", "std", "statistics")),
)

# The six suggested questions of the reference's UI.
SUGGESTED_QUESTIONS = (
    "What is the total sales?",
    "Which are the top-selling products?",
    "Show me the sales trend",
    "Which region performs best?",
    "What is the customer demographic?",
    "What is the average order value?",
)


def suggested_questions(spark) -> DataFrame:
    """R13 as rows (position, question, intent)."""
    rows = spark.createDataFrame(list(enumerate(SUGGESTED_QUESTIONS, 1)), "position int, question string")
    return classify(rows)


def intent_expr(text: Column) -> Column:
    """R1 as one CASE expression (stays inside whole-stage codegen)."""
    q = F.lower(text)
    expr = None
    for name, words in INTENT_RULES:
        cond = None
        for w in words:
            c = q.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("general"))


def classify(questions: DataFrame, text_col: str = "question") -> DataFrame:
    return questions.withColumn("intent", intent_expr(F.col(text_col)))


def statistics_documents(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """R2: (intent, doc_type, page_content), one row per intent except
    'general' (at most six rows).

    All six documents come from **two** passes over the table: one wide
    global aggregation (sales, age, date range and per-column statistics)
    and one GROUPING SETS aggregation ((product), (region), (gender),
    (month)) with partial aggregation per set.  The documents are rendered
    from those two small results; the plan reuses their exchanges, so the
    table (and any join behind it) is read twice, not once per statistic."""
    roles = resolve_roles(df.columns, roles)
    s, p, r, a, g, d = (roles.get(k) for k in ("sales", "product", "region", "age", "gender", "date"))
    spark = df.sparkSession
    num = stats.numeric_columns(df)

    def col(name):
        return F.col(f"`{name}`")

    # ---- exact medians (distributed selection), then one wide global aggregate
    med = stats.quantile_literals(df, list(dict.fromkeys([c for c in (s, a) if c] + num)))
    aggs = [F.count(F.lit(1)).alias("n_all")]
    if s:
        x = col(s)
        aggs += [F.coalesce(stats.exact_sum(x), F.lit(0.0)).alias("total_sales"), F.count(x).alias("_ns"),
                 F.first(med[(s, 0.5)]).alias("median_sale"),
                 F.stddev_samp(x.cast("double")).alias("std_sale"),
                 F.min(x).cast("double").alias("min_sale"), F.max(x).cast("double").alias("max_sale")]
    if a:
        x = col(a).cast("double")
        aggs += [stats.exact_mean(col(a)).alias("avg_age"), F.first(med[(a, 0.5)]).alias("median_age"),
                 F.min(x).alias("min_age"), F.max(x).alias("max_age")]
    if d:
        dd = col(d).cast("date")
        aggs += [F.min(dd).alias("earliest"), F.max(dd).alias("latest"), F.count(dd).alias("n_dated")]
    for i, c in enumerate(num):
        x = col(c).cast("double")
        aggs += [stats.exact_mean(col(c)).alias(f"ga{i}"), F.first(med[(c, 0.5)]).alias(f"gm{i}"),
                 F.stddev_samp(x).alias(f"gs{i}"), F.min(x).alias(f"glo{i}"), F.max(x).alias(f"ghi{i}")]
    wide = materialize(df.agg(*aggs))

    # ---- pass 2: one grouping-sets aggregate
    base, keys = df, []
    for k, src in (("_kp", p), ("_kr", r), ("_kg", g)):
        if src:
            base = base.withColumn(k, col(src).cast("string"))
            keys.append(k)
    if d and s:
        base = base.withColumn("_km", F.trunc(col(d).cast("date"), "month"))
        keys.append("_km")
    groups = None
    if keys:
        gaggs = [F.count(F.lit(1)).alias("n_rows"), F.grouping_id(*keys).alias("_gid")]
        if s:
            gaggs += [F.coalesce(stats.exact_sum(col(s)), F.lit(0.0)).alias("total_sales"),
                      F.count(col(s)).alias("_ns"),
                      F.coalesce(F.sum(col(s).try_cast(stats.EXACT)), F.lit(0)).alias("_tdec")]
        groups = materialize(base.groupingSets([[k] for k in keys], *keys).agg(*gaggs))

    def one_set(k):
        j = keys.index(k)
        gid = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - j))
        out = groups.where((F.col("_gid") == gid) & F.col(k).isNotNull()).withColumnRenamed(k, "key")
        if s:
            out = out.withColumn("avg_sale", F.try_divide(F.col("total_sales"), F.col("_ns")))
        return out

    def row(intent, doc_type, text_df):
        return text_df.select(F.lit(intent).alias("intent"), F.lit(doc_type).alias("doc_type"),
                              F.col("page_content"))

    def msg(intent, text, doc_type="statistics"):
        return spark.range(1).select(F.lit(intent).alias("intent"), F.lit(doc_type).alias("doc_type"),
                                     F.lit(text).alias("page_content"))

    parts = []
    if s:
        parts.append(row("sales", "sales_statistics", wide.select(
            "total_sales", F.try_divide(F.col("total_sales"), F.col("_ns")).alias("avg_sale"),
            "median_sale", "std_sale", "min_sale", "max_sale",
            F.col("n_all").alias("total_transactions")).select(stats.sales_text().alias("page_content"))))
    else:
        parts.append(msg("sales", "No sales data available."))
    if p:
        prod = one_set("_kp")
        n_p = prod.agg(F.count(F.lit(1))).scalar()
        top = stats._ranked_top(prod, "total_sales" if s else "n_rows", 5)
        top = top.withColumn("n_products", n_p).withColumnRenamed("key", "product")
        parts.append(row("product", "product_statistics", stats.render_product_document(top, s is not None)))
    else:
        parts.append(msg("product", "No product data available."))
    if r:
        reg = one_set("_kr")
        n_r = reg.agg(F.count(F.lit(1))).scalar()
        reg = reg.withColumn("n_regions", n_r).withColumnRenamed("key", "region")
        parts.append(row("region", "regional_statistics", stats.render_region_document(reg, s is not None)))
    else:
        parts.append(msg("region", "No regional data available."))
    age_part = wide.select(stats.age_text().alias("page_content")) if a else None
    share = None
    if g:
        n_all = wide.select("n_all").scalar()
        share = one_set("_kg").select(F.col("key").alias("value"), "n_rows",
                                      (F.col("n_rows") * F.lit(100.0) / n_all).alias("pct"))
    cust = stats.render_customer_document(
        age_part.withColumn("avg_age", F.lit(0.0)) if age_part is not None else None, share)
    parts.append(row("customer", "customer_statistics", cust) if cust is not None else
                 msg("customer", "Customer Statistics:\nNo customer demographic data available.",
                     "customer_statistics"))
    if d:
        rng = wide.select("earliest", "latest", "n_dated",
                          F.datediff("latest", "earliest").cast("bigint").alias("span_days"))
        monthly = None
        if s:
            m = one_set("_km")
            key = F.year("key") * 12 + F.month("key")
            monthly = m.agg(
                F.try_divide(F.sum("_tdec").cast("double"), F.count(F.lit(1))).alias("avg_monthly_sales"),
                F.date_format(F.max_by("key", F.struct(F.col("_tdec"), -key)), "yyyy-MM").alias("best_month"),
                F.max("_tdec").cast("double").alias("best_month_sales"),
                F.date_format(F.min_by("key", F.struct(F.col("_tdec"), key)), "yyyy-MM").alias("worst_month"),
                F.min("_tdec").cast("double").alias("worst_month_sales"))
        parts.append(row("time", "time_statistics", stats.render_time_document(rng, monthly)))
    else:
        parts.append(msg("time", "No time-series data available."))
    gen = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.col(f"ga{i}").alias("mean"),
                 F.col(f"gm{i}").alias("median"), F.col(f"gs{i}").alias("std"),
                 F.col(f"glo{i}").alias("min"), F.col(f"ghi{i}").alias("max"))
        for i, c in enumerate(num)]))) if num else spark.createDataFrame(
        [], "column string, pos int, mean double, median double, std double, min double, max double")
    parts.append(row("statistics", "general_statistics", stats.render_general_document(gen)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def attach_statistics(questions: DataFrame, stat_docs: DataFrame, text_col: str = "question") -> DataFrame:
    """R2 join: intent -> statistics document, left outer ('general' has
    none).  ``stat_docs`` has at most one row per intent (six rows), so the
    broadcast is bounded whatever the question table's size."""
    q = classify(questions, text_col)
    return q.join(F.broadcast(stat_docs), "intent", "left")


def hybrid_topk(vector_hits: DataFrame, stat_docs_per_question: DataFrame, k: int = 5,
                reserve_stats: bool = True, key: str = "question_id") -> DataFrame:
    """Vector hits first (by their rank), then the statistics document,
    cut to the first ``k`` per question.

    ``reserve_stats=False`` is the reference's behaviour: with k or more
    vector hits the statistics document falls off the end.  The default
    keeps k - 1 hits and the statistics document.
    ``vector_hits``: (key, rank, source, page_content);
    ``stat_docs_per_question``: (key, page_content) with NULL for none.
    """
    hits = vector_hits.select(key, F.lit(0).alias("src"), F.col("rank").cast("bigint").alias("r"),
                              F.col("source"), F.col("page_content"))
    st = (stat_docs_per_question.where(F.col("page_content").isNotNull())
          .select(key, F.lit(1).alias("src"), F.lit(0).cast("bigint").alias("r"),
                  F.lit("statistics").alias("source"), "page_content"))
    if reserve_stats:
        hits = hits.where(F.col("r") <= k - 1)
    u = hits.unionByName(st)
    w = Window.partitionBy(key).orderBy("src", "r")
    return (u.withColumn("position", F.row_number().over(w).cast("bigint"))
             .where(F.col("position") <= k).drop("src", "r"))


def context_text(ranked_docs: DataFrame, key: str = "question_id", rows: bool = False) -> DataFrame:
    """Documents joined with a blank line in rank order (at most k per
    question, so the collected list is bounded).

    ``rows`` gives each document's (position, source, content) with the
    context: they come out of the same list, so what ``ranked_docs`` is made
    of is computed once, and no join meets it with itself."""
    kept = ["position", "source", "page_content"] if rows else ["position", "page_content"]
    listed = ranked_docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("docs"))
    context = F.array_join(F.transform("docs", lambda x: x["page_content"]), "\n\n").alias("context")
    if not rows:
        return listed.select(key, context)
    return listed.select(key, context, F.inline("docs")).withColumnRenamed("page_content", "content")


# Prompt wording is ours; only the slot order (system text, history, then
# the filled template) follows the reference.
SYSTEM_TEXT = (
    "You are a business intelligence analyst. Answer from the data context and the "
    "statistics given, cite the numbers you use, and say so when the data is not enough.")

TEMPLATES = {
    "rag": "Data context:\n{context}\n\nStatistics:\n{statistics}\n\nQuestion: {question}\n\nAnswer:",
    "analysis": "Data summary:\n{data_summary}\n\nFocus: {focus}\n\nFindings, trends, statistics, "
                "implications and recommendations:",
    "visualization": "Question: {question}\nAvailable dimensions: {dimensions}\n"
                     "Pick one chart type (line_chart, bar_chart, pie_chart, scatter_plot, heatmap, "
                     "histogram) and give one sentence why.",
    "intent": "Question: {question}\nCategory (sales_analysis, product_analysis, regional_analysis, "
              "customer_analysis, time_analysis, statistical_query, general_query):",
    "followup": "Analysis: {analysis}\nThree follow-up questions:\n1.\n2.\n3.",
}


def render_template(name: str, **slots: Column) -> Column:
    """Fill a template from columns, one row at a time, JVM-side."""
    tpl = TEMPLATES[name]
    pieces, rest = [], tpl
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        pieces += [F.lit(pre), F.coalesce(slots[slot], F.lit(""))]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def prompt_messages(history: Column, human: Column) -> Column:
    """array<struct<role, content>>: system, history..., human."""
    sys_msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_TEXT).alias("content")))
    hum = F.array(F.struct(F.lit("human").alias("role"), human.alias("content")))
    return F.concat(sys_msg, F.coalesce(history, F.array().cast(
        "array<struct<role:string,content:string>>")), hum)


def extractive_answer(questions_with_docs: DataFrame) -> DataFrame:
    """R12 without a model: the answer is the routed statistics document."""
    return questions_with_docs.withColumn(
        "answer", F.coalesce(F.col("page_content"),
                             F.lit("I can only answer questions about the statistics of this data.")))
