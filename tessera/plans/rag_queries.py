"""Registered routing, retrieval-prompt and evaluation queries
(R1, R2, R9-R12, E1-E7) over the conversations table and the sales view."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation, memory, retrieval, stats
from ..sources.tables import SALES_ROLES, read_table, sales_view
from .oracle import fixed, money, with_sales, xavg
from .registry import register
from .stats_queries import _FACTS_SQL

R = SALES_ROLES


# ----------------------------------------------------------------- SQL parts
def _intent_sql(col: str) -> str:
    arms = []
    for name, words in retrieval.INTENT_RULES:
        cond = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
        arms.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(arms) + " ELSE 'general' END"


_NL = "chr(10)"

STATDOC_CTES = [
    f"""sdoc AS (SELECT 'Sales Statistics:' || {_NL} || 'Total Sales: ' || {money('ts')} || {_NL}
        || 'Average Sale: ' || {money('ts / ns')} || {_NL} || 'Median Sale: ' || {money('md')} || {_NL}
        || 'Standard Deviation: ' || {money('sd')} || {_NL} || 'Minimum Sale: ' || {money('mn')} || {_NL}
        || 'Maximum Sale: ' || {money('mx')} || {_NL} || 'Total Transactions: ' || CAST(n AS VARCHAR)
        AS page_content
      FROM (SELECT CAST(SUM(sales) AS DOUBLE) AS ts, COUNT(sales) AS ns, MEDIAN(CAST(sales AS DOUBLE)) AS md,
                   STDDEV_SAMP(CAST(sales AS DOUBLE)) AS sd, CAST(MIN(sales) AS DOUBLE) AS mn,
                   CAST(MAX(sales) AS DOUBLE) AS mx, COUNT(*) AS n FROM sales))""",
    """pg AS (SELECT product, CAST(SUM(sales) AS DOUBLE) AS t, COUNT(sales) AS ns, COUNT(*) AS n
             FROM sales WHERE product IS NOT NULL GROUP BY product)""",
    """ptop AS (SELECT *, ROW_NUMBER() OVER (ORDER BY t DESC, product) AS rk FROM pg
               ORDER BY t DESC, product LIMIT 5)""",
    f"""pdoc AS (SELECT 'Product Statistics:' || {_NL} || 'Total Products: '
          || CAST((SELECT COUNT(*) FROM pg) AS VARCHAR) || {_NL} || {_NL} || 'Top 5 Products by Sales:' || {_NL}
          || string_agg(CAST(rk AS VARCHAR) || '. ' || product || ': Total Sales=$' || {money('t')}
                        || ', Avg=$' || {money('t / ns')} || ', Count=' || CAST(n AS VARCHAR) || {_NL}, '' ORDER BY rk)
          AS page_content FROM ptop)""",
    f"""rdoc AS (SELECT 'Regional Statistics:' || {_NL} || 'Total Regions: ' || CAST(COUNT(*) AS VARCHAR)
          || {_NL} || {_NL} || 'Performance by Region:' || {_NL}
          || string_agg(region || ': Total=$' || {money('t')} || ', Avg=$' || {money('t / ns')}
                        || ', Count=' || CAST(n AS VARCHAR) || {_NL}, '' ORDER BY t DESC, region) AS page_content
        FROM (SELECT region, CAST(SUM(sales) AS DOUBLE) AS t, COUNT(sales) AS ns, COUNT(*) AS n
              FROM sales WHERE region IS NOT NULL GROUP BY region))""",
    f"""cdoc AS (SELECT 'Customer Statistics:' || {_NL}
          || (SELECT {_NL} || 'Age Demographics:' || {_NL} || 'Average Age: ' || {fixed('a', 1)} || {_NL}
                  || 'Median Age: ' || {fixed('m', 1)} || {_NL} || 'Age Range: ' || {fixed('lo', 0)} || ' - '
                  || {fixed('hi', 0)} || {_NL}
              FROM (SELECT {xavg('acctbal')} AS a, MEDIAN(CAST(acctbal AS DOUBLE)) AS m,
                           MIN(CAST(acctbal AS DOUBLE)) AS lo, MAX(CAST(acctbal AS DOUBLE)) AS hi FROM sales))
          || (SELECT {_NL} || 'Gender Distribution:' || {_NL}
                  || string_agg(value || ': ' || CAST(n AS VARCHAR) || ' (' || {fixed('pct', 1)} || '%)' || {_NL},
                                '' ORDER BY n DESC, value)
              FROM (SELECT segment AS value, COUNT(*) AS n,
                           COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sales) AS pct
                    FROM sales WHERE segment IS NOT NULL GROUP BY segment)) AS page_content)""",
    """mt AS (SELECT date_trunc('month', order_date) AS m, SUM(sales) AS t
             FROM sales WHERE order_date IS NOT NULL GROUP BY 1)""",
    f"""tdoc AS (SELECT CASE WHEN n_dated > 0 THEN
            'Time Period Statistics:' || {_NL} || 'Date Range: ' || CAST(lo AS VARCHAR) || ' to '
            || CAST(hi AS VARCHAR) || {_NL} || 'Total Days: ' || CAST(CAST(hi - lo AS BIGINT) AS VARCHAR) || {_NL}
            || {_NL} || 'Monthly Sales Summary:' || {_NL} || 'Average Monthly Sales: $' || {money('am')}
            || {_NL} || 'Best Month: ' || bm || ' ($' || {money('bt')} || ')' || {_NL}
            || 'Worst Month: ' || wm || ' ($' || {money('wt')} || ')' || {_NL}
          ELSE 'No valid time-series data available.' END AS page_content
        FROM (SELECT MIN(order_date) AS lo, MAX(order_date) AS hi, COUNT(*) AS n_dated
              FROM sales WHERE order_date IS NOT NULL),
             (SELECT CAST(SUM(t) AS DOUBLE) / COUNT(*) AS am, CAST(MAX(t) AS DOUBLE) AS bt,
                     CAST(MIN(t) AS DOUBLE) AS wt,
                     (SELECT strftime(m, '%Y-%m') FROM mt ORDER BY t DESC, m LIMIT 1) AS bm,
                     (SELECT strftime(m, '%Y-%m') FROM mt ORDER BY t ASC, m LIMIT 1) AS wm FROM mt))""",
    f"""gdoc AS (SELECT 'General Statistics:' || {_NL} || {_NL}
          || string_agg(c || ':' || {_NL} || 'Mean: ' || {fixed('a')} || {_NL} || 'Median: ' || {fixed('m')}
                        || {_NL} || 'Std Dev: ' || {fixed('s')} || {_NL} || 'Min: ' || {fixed('lo')} || {_NL}
                        || 'Max: ' || {fixed('hi')} || {_NL} || {_NL}, '' ORDER BY pos) AS page_content
        FROM (""" + " UNION ALL ".join(
        f"""SELECT '{c}' AS c, {i} AS pos, {xavg(c)} AS a, MEDIAN(CAST({c} AS DOUBLE)) AS m,
               STDDEV_SAMP(CAST({c} AS DOUBLE)) AS s, MIN(CAST({c} AS DOUBLE)) AS lo,
               MAX(CAST({c} AS DOUBLE)) AS hi FROM sales"""
        for i, c in enumerate(["acctbal", "quantity", "sales"])) + "))",
    """statdocs AS (
        SELECT 'sales' AS intent, 'sales_statistics' AS doc_type, page_content FROM sdoc
        UNION ALL SELECT 'product', 'product_statistics', page_content FROM pdoc
        UNION ALL SELECT 'region', 'regional_statistics', page_content FROM rdoc
        UNION ALL SELECT 'customer', 'customer_statistics', page_content FROM cdoc
        UNION ALL SELECT 'time', 'time_statistics', page_content FROM tdoc
        UNION ALL SELECT 'statistics', 'general_statistics', page_content FROM gdoc)""",
]

QUESTIONS_CTE = f"""q AS (SELECT conv_id, turn, text AS question, {_intent_sql('text')} AS intent
                         FROM conversations WHERE role = 'user')"""


def _user_turns(spark, sf_dir):
    return (read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("question")))


def _stat_docs(spark, sf_dir):
    return retrieval.statistics_documents(sales_view(spark, sf_dir, materialized=True), R)


# ------------------------------------------------------------------ queries
@register("intent", f"""
SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations WHERE role = 'user'""")
def q_intent(spark, sf_dir):
    return retrieval.classify(_user_turns(spark, sf_dir)).select("conv_id", "turn", "intent")


@register("stat_documents", with_sales("SELECT * FROM statdocs", *STATDOC_CTES))
def q_stat_documents(spark, sf_dir):
    return _stat_docs(spark, sf_dir)


@register("question_stats", with_sales("""
SELECT q.conv_id, q.turn, q.intent, s.doc_type, s.page_content
FROM q LEFT JOIN statdocs s ON q.intent = s.intent""", *STATDOC_CTES, QUESTIONS_CTE))
def q_question_stats(spark, sf_dir):
    out = retrieval.attach_statistics(_user_turns(spark, sf_dir), _stat_docs(spark, sf_dir))
    return out.select("conv_id", "turn", "intent", "doc_type", "page_content")


_FALLBACK = "I can only answer questions about the statistics of this data."


@register("answer_extractive", with_sales(f"""
SELECT q.conv_id, q.turn, COALESCE(s.page_content, '{_FALLBACK}') AS answer
FROM q LEFT JOIN statdocs s ON q.intent = s.intent""", *STATDOC_CTES, QUESTIONS_CTE))
def q_answer_extractive(spark, sf_dir):
    out = retrieval.extractive_answer(
        retrieval.attach_statistics(_user_turns(spark, sf_dir), _stat_docs(spark, sf_dir)))
    return out.select("conv_id", "turn", "answer")


def _quick_sql(text: str) -> str:
    return f"""concat_ws(chr(10),
    'Total Records: ' || CAST(f.n_rows AS VARCHAR),
    CASE WHEN contains(lower({text}), 'sales') OR contains(lower({text}), 'revenue')
         THEN 'Total Sales: $' || {money('f.total_sales')} END,
    CASE WHEN contains(lower({text}), 'sales') OR contains(lower({text}), 'revenue')
         THEN 'Average Sale: $' || {money('f.avg_sale')} END,
    CASE WHEN contains(lower({text}), 'product') THEN 'Total Products: ' || CAST(f.n_products AS VARCHAR) END,
    CASE WHEN contains(lower({text}), 'region') OR contains(lower({text}), 'location')
         THEN 'Total Regions: ' || CAST(f.n_regions AS VARCHAR) END)"""


_HIST_CTE = """h AS (
  SELECT conv_id, turn, role, text,
         COALESCE(LIST(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
           CAST([] AS VARCHAR[])) AS hist
  FROM conversations WHERE role IN ('user', 'assistant'))"""


def _rag_sql():
    tpl = retrieval.TEMPLATES["rag"]
    pre_ctx, rest = tpl.split("{context}")
    mid_stat, rest = rest.split("{statistics}")
    mid_q, post = rest.split("{question}")

    def lit(s):
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return with_sales(f"""
SELECT h.conv_id, h.turn, q.intent, CAST(len(h.hist) AS BIGINT) AS n_history,
       CAST(len(h.hist) + 2 AS BIGINT) AS n_messages,
       array_to_string(h.hist, chr(10)) AS history_text,
       {lit(pre_ctx)} || COALESCE(s.page_content, '') || {lit(mid_stat)} || {_quick_sql('h.text')}
         || {lit(mid_q)} || h.text || {lit(post)} AS prompt
FROM h JOIN q ON h.conv_id = q.conv_id AND h.turn = q.turn
LEFT JOIN statdocs s ON q.intent = s.intent, facts f
WHERE h.role = 'user'""", *STATDOC_CTES, QUESTIONS_CTE, _FACTS_SQL, _HIST_CTE)


@register("rag_prompt", _rag_sql())
def q_rag_prompt(spark, sf_dir):
    """R9 + R10 + R2 + A11 + M1 for every user turn in one plan: the
    prompt a model would receive, with the memory as it stood then."""
    sv = sales_view(spark, sf_dir, materialized=True)
    conv = read_table(spark, sf_dir, "conversations")
    qs = retrieval.attach_statistics(_user_turns(spark, sf_dir), retrieval.statistics_documents(sv, R))
    qs = stats.quick_statistics(qs, "question", stats.table_facts(sv, R), R)
    hist = memory.history_before_each(conv, k=5)
    label = F.create_map(*[x for k, v in memory.DISPLAY.items() for x in (F.lit(k), F.lit(v))])
    j = qs.join(hist, (qs.conv_id == hist.conv_id) & (qs.turn == hist.q_turn), "left").drop(hist.conv_id)
    hist_msgs = F.transform(F.col("history"), lambda m: F.struct(
        m["role"].alias("role"), m["text"].alias("content")))
    human = retrieval.render_template("rag", context=F.col("page_content"),
                                      statistics=F.col("statistics"), question=F.col("question"))
    msgs = retrieval.prompt_messages(hist_msgs, human)
    n_hist = F.coalesce(F.size("history"), F.lit(0)).cast("bigint")
    return j.select(
        "conv_id", "turn", "intent", n_hist.alias("n_history"),
        F.size(msgs).cast("bigint").alias("n_messages"),
        F.array_join(F.transform(F.coalesce(F.col("history"), F.array().cast(
            "array<struct<turn:bigint,role:string,text:string>>")),
            lambda m: F.concat(label[m["role"]], F.lit(": "), m["text"])), "\n").alias("history_text"),
        F.element_at(msgs, -1)["content"].alias("prompt"))


# ---------------------------------------------------------------- evaluation
_PAIRS_CTE = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS ground_truth, a.text AS prediction
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def _match_sql(pred: str, truth: str) -> str:
    nums = "list_distinct(regexp_extract_all({x}, '[0-9]+\\.?[0-9]*'))"
    words = "list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''))"
    pn, tn = nums.format(x=f"COALESCE({pred}, '')"), nums.format(x=f"COALESCE({truth}, '')")
    pw, tw = words.format(x=f"COALESCE({pred}, '')"), words.format(x=f"COALESCE({truth}, '')")
    return (f"CASE WHEN len({tn}) > 0 THEN len(list_intersect({pn}, {tn})) > 0 "
            f"WHEN len({tw}) > 0 THEN len(list_intersect({pw}, {tw})) / len({tw}) > 0.3 ELSE false END")


def _exchange_pairs(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ground_truth"))
    a = c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("prediction"))
    return u.join(a, (a.a_conv == u.conv_id) & (a.a_turn == u.turn + 1)).drop("a_conv", "a_turn")


@register("simple_match", f"""WITH {_PAIRS_CTE}
SELECT conv_id, turn, {_match_sql('prediction', 'ground_truth')} AS correct FROM pairs""")
def q_simple_match(spark, sf_dir):
    return evaluation.score(_exchange_pairs(spark, sf_dir)).select("conv_id", "turn", "correct")


@register("eval_summary", f"""WITH {_PAIRS_CTE},
s AS (SELECT {_match_sql('prediction', 'ground_truth')} AS correct FROM pairs)
SELECT COUNT(*) AS total_examples, CAST(COALESCE(SUM(CAST(correct AS BIGINT)), 0) AS BIGINT) AS correct,
       COUNT(*) - CAST(COALESCE(SUM(CAST(correct AS BIGINT)), 0) AS BIGINT) AS incorrect,
       CASE WHEN COUNT(*) > 0 THEN CAST(COALESCE(SUM(CAST(correct AS BIGINT)), 0) AS BIGINT) * 100.0 / COUNT(*)
            ELSE 0.0 END AS accuracy
FROM s""")
def q_eval_summary(spark, sf_dir):
    return evaluation.summary(evaluation.score(_exchange_pairs(spark, sf_dir)))


def _test_cases_sql():
    arms = []
    vals = {"n_rows": "CAST(n_rows AS VARCHAR)", "total_sales": money("total_sales"),
            "avg_sale": money("avg_sale"), "n_products": "CAST(n_products AS VARCHAR)",
            "top_product": "top_product", "n_regions": "CAST(n_regions AS VARCHAR)"}
    for qid, question, answer in evaluation.TEST_CASES:
        pre, _, tail = answer.partition("{")
        slot, _, post = tail.partition("}")
        arms.append(f"SELECT CAST({qid} AS BIGINT) AS question_id, '{question}' AS question, "
                    f"'{pre}' || {vals[slot]} || '{post}' AS expected_answer FROM facts")
    return "tc AS (" + " UNION ALL ".join(arms) + ")"


@register("test_cases", with_sales("SELECT * FROM tc", _FACTS_SQL, _test_cases_sql()))
def q_test_cases(spark, sf_dir):
    return evaluation.test_cases(stats.table_facts(sales_view(spark, sf_dir, materialized=True), R))


def _eval_detail_df(spark, sf_dir):
    sv = sales_view(spark, sf_dir, materialized=True)
    tc = evaluation.test_cases(stats.table_facts(sv, R))
    routed = retrieval.extractive_answer(
        retrieval.attach_statistics(tc, retrieval.statistics_documents(sv, R), "question"))
    return evaluation.score(routed, prediction="answer", truth="expected_answer")


_DETAIL_SQL = f"""detail AS (
  SELECT tc.question_id, tc.question, tc.expected_answer AS expected,
         COALESCE(s.page_content, '{_FALLBACK}') AS predicted,
         {_match_sql(f"COALESCE(s.page_content, '{_FALLBACK}')", 'tc.expected_answer')} AS correct
  FROM tc LEFT JOIN statdocs s ON s.intent = {_intent_sql('tc.question')})"""


@register("eval_detail", with_sales("""
SELECT question_id, question, expected, predicted,
       CASE WHEN correct THEN 'CORRECT' ELSE 'INCORRECT' END AS evaluation FROM detail""",
    *STATDOC_CTES, _FACTS_SQL, _test_cases_sql(), _DETAIL_SQL))
def q_eval_detail(spark, sf_dir):
    d = _eval_detail_df(spark, sf_dir)
    return d.select("question_id", "question", F.col("expected_answer").alias("expected"),
                    F.col("answer").alias("predicted"), "evaluation")


@register("eval_accuracy", with_sales("""
SELECT COUNT(*) AS total_examples, CAST(SUM(CAST(correct AS BIGINT)) AS BIGINT) AS correct,
       COUNT(*) - CAST(SUM(CAST(correct AS BIGINT)) AS BIGINT) AS incorrect,
       CAST(SUM(CAST(correct AS BIGINT)) AS BIGINT) * 100.0 / COUNT(*) AS accuracy FROM detail""",
    *STATDOC_CTES, _FACTS_SQL, _test_cases_sql(), _DETAIL_SQL))
def q_eval_accuracy(spark, sf_dir):
    return evaluation.summary(_eval_detail_df(spark, sf_dir))


@register("response_metrics", """
SELECT AVG(length(text)) AS avg_response_length,
       AVG(len(regexp_extract_all(text, '\\S+'))) AS avg_word_count,
       CAST(MIN(length(text)) AS BIGINT) AS min_response_length,
       CAST(MAX(length(text)) AS BIGINT) AS max_response_length,
       COUNT(*) AS total_responses
FROM conversations WHERE role = 'assistant'""")
def q_response_metrics(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return evaluation.response_metrics(c, "text")


def _first_ten() -> list[str]:
    return [q for _, block in evaluation.QUESTION_BLOCKS for q in block][:10]


@register("eval_ten", with_sales(f"""
SELECT seq, question, response, CAST(length(response) AS BIGINT) AS response_length,
       (SELECT AVG(length(response)) FROM answered) AS avg_response_length,
       (SELECT COUNT(*) FROM said WHERE said.turn < 2 * a.seq AND said.turn >= 2 * a.seq - 10) AS n_history,
       COALESCE((SELECT string_agg(line, {_NL} ORDER BY turn) FROM said
                 WHERE said.turn < 2 * a.seq AND said.turn >= 2 * a.seq - 10), '') AS history
FROM answered a""", *STATDOC_CTES,
    "ten AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS seq, '{q}' AS question" for i, q in enumerate(_first_ten())) + ")",
    f"""answered AS (SELECT ten.seq, ten.question, COALESCE(s.page_content, '{_FALLBACK}') AS response
                 FROM ten LEFT JOIN statdocs s ON s.intent = {_intent_sql('ten.question')})""",
    """said AS (SELECT 2 * seq AS turn, 'User: ' || question AS line FROM answered
            UNION ALL SELECT 2 * seq + 1, 'Assistant: ' || response FROM answered)"""))
def q_eval_ten(spark, sf_dir):
    """E8 + E9 + R12 + M2 + M3: the first ten test questions in order, each with the memory that it found."""
    run = evaluation.run_in_order(evaluation.first_questions(spark, R), _stat_docs(spark, sf_dir))
    return run.select("seq", "question", "response", "response_length", F.avg("response_length").over(Window.partitionBy("session"))
                      .alias("avg_response_length"), "n_history", "history")
