"""Evaluation (E1-E9): answer matching, scoring, test cases, metrics.

Scoring is an equi-join on a question id followed by one aggregation;
the reference zips Python lists by position, which has no meaning on an
unordered table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fmt
from ..plans.rolling import materialize

NUMBER_PATTERN = r"[0-9]+\.?[0-9]*"   # the reference's \d+\.?\d* on ASCII digits
WORD_THRESHOLD = 0.3                   # strict: more than 30 % of truth words


def _numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER_PATTERN), 0))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def simple_match(prediction: Column, truth: Column) -> Column:
    """E1 + E2 as one boolean expression.

    If the truth has numbers: correct iff the number sets share any
    element (string equality).  Otherwise: distinct lower-case words,
    common / truth > 0.3; an empty truth is incorrect."""
    pn, tn = _numbers(F.coalesce(prediction, F.lit(""))), _numbers(F.coalesce(truth, F.lit("")))
    pw, tw = _words(F.coalesce(prediction, F.lit(""))), _words(F.coalesce(truth, F.lit("")))
    by_words = F.when(F.size(tw) > 0,
                      F.size(F.array_intersect(pw, tw)) / F.size(tw) > F.lit(WORD_THRESHOLD)
                      ).otherwise(F.lit(False))
    return F.when(F.size(tn) > 0, F.size(F.array_intersect(pn, tn)) > 0).otherwise(by_words)


def score(pairs: DataFrame, prediction: str = "prediction", truth: str = "ground_truth") -> DataFrame:
    """E3 per row: adds ``correct`` and the CORRECT / INCORRECT label."""
    m = simple_match(F.col(prediction), F.col(truth))
    return pairs.withColumn("correct", m).withColumn(
        "evaluation", F.when(F.col("correct"), F.lit("CORRECT")).otherwise(F.lit("INCORRECT")))


def summary(scored: DataFrame) -> DataFrame:
    """E3 totals: total, correct, incorrect, accuracy percent (0 if empty)."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)).cast("bigint").alias("correct"),
    ).select("total_examples", "correct",
             (F.col("total_examples") - F.col("correct")).alias("incorrect"),
             F.when(F.col("total_examples") > 0,
                    F.col("correct") * F.lit(100.0) / F.col("total_examples")).otherwise(F.lit(0.0))
             .alias("accuracy"))


# Test-case questions and expected-answer formats.
TEST_CASES = (
    (1, "How many total records are in the dataset?", "There are {n_rows} records in the dataset."),
    (2, "What is the total sales?", "The total sales is ${total_sales}."),
    (3, "What is the average sale amount?", "The average sale amount is ${avg_sale}."),
    (4, "How many unique products are there?", "There are {n_products} unique products."),
    (5, "What is the top-selling product?", "The top-selling product is {top_product}."),
    (6, "How many regions are covered?", "There are {n_regions} regions covered."),
)
_NEEDS = {1: (), 2: ("total_sales",), 3: ("avg_sale",), 4: ("n_products",),
          5: ("top_product",), 6: ("n_regions",)}


def test_cases(facts: DataFrame) -> DataFrame:
    """Question / expected-answer rows from the one-row A13 facts; a row
    exists only when its facts exist."""
    rendered = {
        "n_rows": F.col("n_rows").cast("string"),
        "total_sales": fmt.money("total_sales") if "total_sales" in facts.columns else None,
        "avg_sale": fmt.money("avg_sale") if "avg_sale" in facts.columns else None,
        "n_products": F.col("n_products").cast("string") if "n_products" in facts.columns else None,
        "top_product": F.col("top_product") if "top_product" in facts.columns else None,
        "n_regions": F.col("n_regions").cast("string") if "n_regions" in facts.columns else None,
    }
    items = []
    for qid, question, answer in TEST_CASES:
        if any(rendered[n] is None for n in _NEEDS[qid]):
            continue
        pre, _, tail = answer.partition("{")
        slot, _, post = tail.partition("}")
        items.append(F.struct(F.lit(qid).cast("bigint").alias("question_id"),
                              F.lit(question).alias("question"),
                              F.concat(F.lit(pre), rendered[slot], F.lit(post)).alias("expected_answer")))
    return facts.select(F.inline(F.array(*items)))


def response_metrics(responses: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean length, mean word count, min / max length, count."""
    t = F.col(text_col)
    return responses.agg(
        F.avg(F.length(t)).alias("avg_response_length"),
        F.avg(F.size(F.regexp_extract_all(t, F.lit(r"\S+"), 0))).alias("avg_word_count"),
        F.min(F.length(t)).cast("bigint").alias("min_response_length"),
        F.max(F.length(t)).cast("bigint").alias("max_response_length"),
        F.count(F.lit(1)).alias("total_responses"))


# Generated test questions per role block.
QUESTION_BLOCKS = (
    ("general", ("What is the overview of the dataset?", "How many records are in the data?",
                 "What are the main columns in the dataset?")),
    ("sales", ("What is the total sales?", "What is the average sale amount?",
               "What is the sales trend?", "Which period had the highest sales?")),
    ("product", ("How many products are there?", "What are the top products?",
                 "Which product has the best performance?", "Compare the top 3 products")),
    ("region", ("How many regions are covered?", "Which region has the best performance?",
                "Compare sales across regions")),
    ("age", ("What is the customer age distribution?", "What is the average customer age?")),
)


def test_questions(spark, roles: dict) -> DataFrame:
    """The question blocks whose role resolves on this table, in order."""
    rows, seq = [], 0
    for role, qs in QUESTION_BLOCKS:
        present = role == "general" or roles.get(role) is not None
        for q in qs:
            if present:
                rows.append((seq, role, q))
            seq += 1
    return spark.createDataFrame(rows, "seq int, role string, question string")


def first_questions(spark, roles: dict, n: int = 10, session: str = "evaluation") -> DataFrame:
    """The first ``n`` test questions as one session (session, seq, question); seq counts from 0."""
    asked = test_questions(spark, roles).orderBy("seq").limit(n)
    at = F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1
    return asked.withColumn("session", F.lit(session)).select("session", at.cast("long").alias("seq"), "question")


def run_in_order(questions: DataFrame, stat_docs: DataFrame, k: int = 5, session: str = "session") -> DataFrame:
    """E9 over R12 with memory: the questions of a session are asked in the order of ``seq``, and each
    exchange enters the memory window of the last ``k`` before the next question is asked.

    (session, seq, question, response, response_length, n_history, history).  ``history`` is the window as
    the model would read it.  Without a model an answer depends on its question alone, so the
    fold needs no state: exchanges become messages (M2) and every question meets the
    ``2k`` before it by the blocked index of ``history_before_each``; a session of any length,
    or one that holds most rows, is split over tasks."""
    from . import memory, retrieval
    answered = materialize(retrieval.extractive_answer(retrieval.attach_statistics(questions, stat_docs))
                           .select(session, F.col("seq").cast("long").alias("seq"), "question", F.col("answer").alias("response")))
    messages = memory.save_context(answered.select(session, "seq", F.col("question").alias("input"), F.col("response").alias("output")),
                                   session)
    before = memory.history_before_each(messages, k, session)
    label = F.create_map(*[x for r, shown in memory.DISPLAY.items() for x in (F.lit(r), F.lit(shown))])
    seen = before.select(F.col(session).alias("_s"), (F.col("q_turn") / 2).cast("long").alias("_q"), "history")
    kept = F.coalesce("history", F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))
    return (answered.join(seen, (F.col(session) == F.col("_s")) & (F.col("seq") == F.col("_q")), "left")
            .select(session, "seq", "question", "response", F.length("response").cast("long").alias("response_length"),
                    F.size(kept).cast("long").alias("n_history"),
                    F.array_join(F.transform(kept, lambda m: F.concat(label[m["role"]], F.lit(": "), m["text"])), "\n").alias("history")))
