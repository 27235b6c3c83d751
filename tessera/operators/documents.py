"""Grouped text documents (D1-D6): the knowledge-base corpus.

D1 summarises the whole table; D2-D4 summarise each month, product and
region.  The three group-bys of the reference are **one** GROUPING SETS
aggregation (D5): one scan, one shuffle, partial aggregation per set.
Texts are built with column expressions; only per-group rows (already
aggregated) are concatenated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from ..functions import fmt
from ..functions.roles import resolve_role, resolve_roles
from . import stats

# Order of the parts in the assembled corpus.
PART_ORDER = {"summary": 0, "time_period": 1, "product": 2, "region": 3}


def _c(name: str):
    return F.col(f"`{name}`")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType)]


def _as_text(df: DataFrame, name: str):
    t = df.schema[name].dataType
    if isinstance(t, (DateType, TimestampType, TimestampNTZType)):
        return F.date_format(_c(name), "yyyy-MM-dd")
    return _c(name).cast("string")


def value_counts_topn(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Per column: distinct non-null values and the top-n (value, count),
    count desc then value asc.  Long form via ``inline``: plan size grows
    with the column count, not columns x statistics.  The per-column
    ranking uses ``row_number() <= n`` which Spark plans with a partial
    WindowGroupLimit before the shuffle, so a column with many distinct
    values ships at most n rows per map task."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), _as_text(df, c).alias("value"))
        for i, c in enumerate(columns)])))
    counts = (long.where(F.col("value").isNotNull())
                  .groupBy("column", "pos", "value").agg(F.count(F.lit(1)).alias("n")))
    distinct = counts.groupBy("column", "pos").agg(F.count(F.lit(1)).alias("n_distinct"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    top = (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                 .groupBy("column").agg(F.array_sort(F.collect_list(
                     F.struct("rank", "value", "n"))).alias("top")))
    return distinct.join(top, "column", "left")


def summary_document(df: DataFrame) -> DataFrame:
    """One row (doc_type, key, page_content)."""
    num = stats.numeric_columns(df)
    txt = _text_columns(df)
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    head = F.concat(F.lit("Dataset Overview:\nTotal Records: "), n_rows.cast("string"),
                    F.lit("\nColumns: " + ", ".join(df.columns) + "\n\nNumeric Columns Statistics:"))
    pieces = [head]
    if num:
        g = stats.general_statistics(df, num)
        line = F.concat(F.col("column"), F.lit(": Mean="), fmt.fixed("mean"), F.lit(", Median="),
                        fmt.fixed("median"), F.lit(", Std="), fmt.fixed("std"), F.lit(", Min="),
                        fmt.fixed("min"), F.lit(", Max="), fmt.fixed("max"))
        num_text = g.agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))),
            lambda x: F.concat(F.lit("\n"), x["l"])), "")).scalar()
        pieces.append(num_text)
    if txt:
        vc = value_counts_topn(df, txt, 3)
        tops = F.array_join(F.transform(F.col("top"), lambda x: F.concat(
            x["value"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
        line = F.concat(F.col("column"), F.lit(": "), F.col("n_distinct").cast("string"),
                        F.lit(" unique values. Top values: "), F.coalesce(tops, F.lit("")))
        txt_text = vc.agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))),
            lambda x: F.concat(F.lit("\n"), x["l"])), "")).scalar()
        pieces += [F.lit("\n\nText/Categorical Columns:"), txt_text]
    spark = df.sparkSession
    return spark.range(1).select(F.lit("summary").alias("doc_type"), F.lit("dataframe").alias("key"),
                                 F.concat(*pieces).alias("page_content"))


def group_text(title: str, key, num: list[str], source: str):
    """Text of a group's document from its count ``n_rows``, totals ``_t<i>`` and counts of values
    ``_n<i>``; the column the key was made from gets no line."""
    lines = [F.concat(F.lit(title), key), F.concat(F.lit("Records: "), F.col("n_rows").cast("string"))]
    for i, c in enumerate(num):
        if c == source:
            continue
        t = F.coalesce(F.col(f"_t{i}"), F.lit(0.0))
        lines.append(F.concat(F.lit(f"{c}: Total="), fmt.fixed(t), F.lit(", Average="),
                              fmt.fixed(F.try_divide(F.col(f"_t{i}"), F.col(f"_n{i}")))))
    return F.concat_ws("\n", *lines)


def group_keys(df: DataFrame, roles: dict | None = None) -> list[tuple[str, str, str, object]]:
    """(doc_type, title, source column, key) of the groupings whose column is there."""
    given = roles or {}
    roles = resolve_roles(df.columns, roles)
    # a location column makes no region documents
    d, p, r = roles["date"], roles["product"], given.get("region") or resolve_role(df.columns, "region_only")
    out = []
    if d:
        out.append(("time_period", "Time Period: ", d, F.date_format(F.trunc(_c(d).cast("date"), "month"), "yyyy-MM")))
    if p:
        out.append(("product", "Product: ", p, _c(p).cast("string")))
    if r:
        out.append(("region", "Region: ", r, _c(r).cast("string")))
    return out


def group_documents(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """One GROUPING SETS aggregation over (month), (product),
    (region); rows (doc_type, key, n_rows, page_content).  Months skip
    unparsed dates; products / regions skip blank keys.  Every numeric
    column except the set's own key gets Total and Average."""
    kinds = group_keys(df, roles)
    num = stats.numeric_columns(df)
    base, keys = df, []
    for kind, _, _, key in kinds:
        keys.append(f"_k_{kind}")
        base = base.withColumn(keys[-1], key)
    if not keys:
        return df.sparkSession.createDataFrame([], "doc_type string, key string, n_rows bigint, page_content string")
    sets = [[k] for k in keys]
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.grouping_id(*keys).alias("_gid")]
    for i, c in enumerate(num):
        aggs += [stats.exact_sum(_c(c)).alias(f"_t{i}"), F.count(stats.present(_c(c))).alias(f"_n{i}")]
    g = base.groupingSets(sets, *keys).agg(*aggs)
    # one projection over the single aggregate: the set (grouping id)
    # chooses type, key and text, so the aggregate is computed once
    nk = len(keys)
    kind_e = key_e = text_e = keep_e = None
    for j, (k, (kind, title, src, _)) in enumerate(zip(keys, kinds)):
        gid = (1 << nk) - 1 - (1 << (nk - 1 - j))  # only key j grouped
        text = group_text(title, F.col(k), num, src)
        ok = F.col(k).isNotNull()
        if kind != "time_period":
            ok = ok & (F.trim(F.col(k)) != "")
        is_set = F.col("_gid") == gid
        kind_e = F.when(is_set, F.lit(kind)) if kind_e is None else kind_e.when(is_set, F.lit(kind))
        key_e = F.when(is_set, F.col(k)) if key_e is None else key_e.when(is_set, F.col(k))
        text_e = (F.when(is_set, text) if text_e is None
                  else text_e.when(is_set, text))
        keep_e = (is_set & ok) if keep_e is None else (keep_e | (is_set & ok))
    return g.where(keep_e).select(kind_e.alias("doc_type"), key_e.alias("key"), "n_rows",
                                  text_e.alias("page_content"))


def corpus(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """Summary, months, products, regions with a sort position."""
    s = summary_document(df).withColumn("n_rows", F.lit(None).cast("bigint"))
    docs = s.unionByName(group_documents(df, roles))
    part = F.create_map(*[x for k, v in PART_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return docs.withColumn("part", part[F.col("doc_type")].cast("int")).withColumn(
        "doc_id", F.concat(F.col("doc_type"), F.lit(":"), F.col("key")))
