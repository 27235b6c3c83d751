"""URL filter by host-suffix and path-prefix expressions (DataFrame only).

Each distinct URL is expanded into (host suffix, path prefix) expressions,
the expressions are equi-joined with the rules on a short prefix of their
SHA-256 digest alone (rules that share a prefix are one row with an array),
full digests and the texts confirm, and the longest rule wins.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased.  Path: what follows up to ``?``, ``#`` or the end.  Null URLs
and URLs without ``://`` have an empty host and path and match nothing.
A rule fits its host and all subdomains when the path starts with the
rule's path.  Of several fitting rules the one with the most characters
wins, then the longer host; equal (host, path) rules that disagree: block
wins.  URLs that no rule fits get ``default`` (allow: a filter list names
what it judges).
Repeated rows stay repeated; null page columns are carried; other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are sent to every executor; longer lists are joined by a shuffle.
BROADCAST_RULES = 1_000_000
PREFIX_HEX = 8        # four bytes of the digest


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _expression(host: Column, path: Column) -> Column:
    # the length of the host keeps "a" + "b/c" apart from "ab" + "/c"
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> one row for each digest prefix, with the rules that share it."""
    r = (rules.where("host is not null and path is not null and verdict is not null")
              .select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
              .groupBy("rule_host", "rule_path")
              .agg(F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise("allow").alias("rule_verdict")))
    rule = F.struct(_expression(F.col("rule_host"), F.col("rule_path")).alias("digest"), "rule_host", "rule_path", "rule_verdict")
    return (r.select(rule.alias("r"))
             .groupBy(F.substring("r.digest", 1, PREFIX_HEX).alias("rule_key")).agg(F.collect_list("r").alias("rules")))


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Distinct URLs with ``host``, ``path``, ``rule``, ``verdict``.

    Suffixes with more labels and prefixes of other lengths than any rule
    has cannot match and are not expanded; both bounds are read from the
    rules (one row), so no URL loses an expression."""
    prepared = prepare_rules(rules)
    each = prepared.select(F.explode("rules").alias("r"))
    n, labels, lengths = each.agg(
        F.count(F.lit(1)), F.max(F.size(F.split("r.rule_host", r"\."))),
        F.sort_array(F.collect_set(F.length("r.rule_path")))).first()
    host, path = split_url(F.col(url_col))
    parts = (urls.select(url_col).distinct()
                 .withColumn("host", host).withColumn("path", path))
    names = F.split("host", r"\.")
    first = F.greatest(F.size(names) - F.lit(labels or 1) + 1, F.lit(1))
    suffixes = F.transform(F.sequence(first, F.size(names)),
                           lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    prefixes = F.filter(F.array_distinct(F.array(*[F.substring("path", 1, k) for k in lengths or [0]])),
                        lambda p: F.length(p).isin(*[int(k) for k in lengths or [0]]))
    expanded = (parts.where("host <> ''")
                     .withColumn("x_host", F.explode(suffixes))
                     .withColumn("x_path", F.explode(prefixes))
                     .withColumn("x_digest", _expression(F.col("x_host"), F.col("x_path")))
                     .withColumn("x_key", F.substring("x_digest", 1, PREFIX_HEX)))
    side = F.broadcast(prepared) if n <= BROADCAST_RULES else prepared
    fits = F.filter("rules", lambda r: (r["digest"] == F.col("x_digest")) & (r["rule_host"] == F.col("x_host"))
                    & (r["rule_path"] == F.col("x_path")))
    # an expression is the text of one rule at most
    hits = (expanded.join(side, F.col("x_key") == F.col("rule_key"))
            .select(F.col(url_col).alias("_url"), F.get(fits, F.lit(0)).alias("r")).where("r is not null")
            .groupBy("_url")
            .agg(F.max(F.struct(F.length("r.rule_host") + F.length("r.rule_path"), F.length("r.rule_host"),
                                F.concat("r.rule_host", "r.rule_path").alias("rule"),
                                F.col("r.rule_verdict").alias("rule_verdict"))).alias("best")))
    return (parts.join(hits, parts[url_col] == hits["_url"], "left")
                 .select(url_col, "host", "path", F.col("best.rule").alias("rule"),
                         F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict")))


def judge_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """One row for each page: its id and the verdict on its URL.

    The verdicts of the distinct URLs are joined back by URL; a URL shared
    by a large part of the pages is a skewed key of that join, which AQE
    splits.  Null URLs take the default directly."""
    verdicts = filter_urls(pages.select(url_col).where(F.col(url_col).isNotNull()), rules, url_col, default)
    v = verdicts.withColumnRenamed(url_col, "_v_url")
    p = pages.select(F.col(id_col), F.col(url_col).alias("_p_url"))
    return (p.join(v, F.col("_p_url") == F.col("_v_url"), "left")
             .select(id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                     "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
