"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, html_extract, jaccard_join, lexical_search, line_dedup, quality, sharding, spelling,
               substring_dedup, topk_search, toxicity, url_filter)
from ..sources.tables import read_table
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


@register("op1_topk_search", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
           from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
             cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""")
def op1(spark, sf_dir):
    return topk_search.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=20, query_every=20, scale=64)


# The fixed rules of the query: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@register("op3_url_filter", """
with p as (select page_id, url,
             case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(rh, rp, rv) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select page_id, host, path, rh || rp as rule, rv,
             row_number() over (partition by page_id order by length(rh || rp) desc nulls last) as k
      from h left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from m where k = 1""")
def op3(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_pages(table(spark, sf_dir, "pages", "page_id", "url"), rules)


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("op8_byte_bpe")
def op8(spark, sf_dir):
    out = bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op9_jaccard_join", f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 4
               then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
               when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
n as (select doc_id, cast(len(s) as bigint) as n_shingles from s),
x as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from x a join x b on a.g = b.g and a.doc_id <> b.doc_id
      group by all),
l as (select a, b from p join n i on i.doc_id = a join n j on j.doc_id = b
      where 100 * k >= 85 * (i.n_shingles + j.n_shingles - k)),
r(a, b) as (select doc_id, doc_id from n union select r.a, l.b from r join l on r.b = l.a)
select a as doc_id, any_value(n_shingles) as n_shingles, min(b) as component_id
from r join n on n.doc_id = a group by a""")
def op9(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, num=85, den=100)


@register("op6_line_dedup", """
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos,
                  unnest(string_split(text, chr(10))) as raw from documents),
t as (select doc_id, pos, raw, trim(raw, concat(' ', chr(9), chr(11), chr(12), chr(13))) as line from l),
f as (select line, min((doc_id, pos)) as f, length(line) as n from t where length(line) >= 20 group by line),
near as (select distinct b.line from f a join f b
         on b.n between a.n - 2 and a.n + 2 and a.f < b.f
            and (contains(b.line, substr(a.line, 1, a.n // 3)) or contains(b.line, substr(a.line, a.n // 3 + 1, a.n // 3))
                 or contains(b.line, substr(a.line, 2 * (a.n // 3) + 1, a.n // 3)))
         where levenshtein(a.line, b.line) <= 2),
j as (select t.*, f.f is not null and (f.f <> (t.doc_id, t.pos) or t.line in (select line from near)) as gone
      from t left join f on t.line = f.line)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
       sha256(coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id
union all
select doc_id, 0, 0, sha256('') from documents where text is null""")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.dedup(docs, min_chars=20).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op5_quality_classifier")
def op5(spark, sf_dir):
    out = quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).alias("keep"))


@register("op10_decontamination")
def op10(spark, sf_dir):
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"),
                                      table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"),
                      F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
                      F.transform("leaks", lambda x: x["edits"]).alias("edits"))


@register("op2_substring_dedup", """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, unnest(range(len(w) - 19)) as s from w where len(w) >= 20),
g as (select p.doc_id, s, array_to_string(w[s + 1:s + 20], ' ') as t from p join w using (doc_id)),
f as (select doc_id, s, row_number() over (partition by t order by doc_id, s) as k from g),
gone as (select doc_id, list(s) as starts from f where k > 1 group by doc_id),
hit as (select distinct doc_id, unnest(range(s, s + 20)) as i from (select doc_id, unnest(starts) as s from gone)),
v as (select doc_id, generate_subscripts(w, 1) - 1 as i, unnest(w) as x from w),
kept as (select v.doc_id, count(*) as n, string_agg(x, ' ' order by v.i) as t
         from v left join hit h on v.doc_id = h.doc_id and v.i = h.i where h.i is null group by v.doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id""")
def op2(spark, sf_dir):
    out = substring_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op7_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op4_html_extraction", r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as x from pages),
b as (select page_id, url, list_transform(string_split_regex(x, '</?(h1|p)>'), lambda t: trim(regexp_replace(
        replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'),
          '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) as l from a)
select page_id, url, array_to_string(list_filter(l, lambda t: t <> ''), chr(10) || chr(10)) as text,
       cast(length(array_to_string(list_filter(l, lambda t: t <> ''), chr(10) || chr(10))) as bigint) as n_chars from b""")
def op4(spark, sf_dir):
    out = html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op11_sharding")
def op11(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"), shards=16)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@register("op12_lexical_search", f"""
with w as (select doc_id, row_number() over () as r, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as t from documents),
d as (select r, any_value(doc_id) as doc_id, count(*) as n from w group by r),
c as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from d),
f as (select r, t, count(*) as tf from w group by r, t),
i as (select item_id, t, count(*) as reps from (
        select item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as t
        from (select distinct item_id, text from benchmark where item_id is not null)) group by item_id, t),
x as (select t, count(*) as df from f where t in (select t from i) group by t),
v as (select t, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as weight from x, c),
s as (select item_id, d.doc_id, r,
             cast(sum(reps * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) as bigint) as score
      from i join v using (t) join f using (t) join d using (r), c where d.doc_id is not null group by item_id, d.doc_id, r),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
      from s where score > 0)
select * from k where rank <= 20""")
def op12(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark"), k=20)


# crc32 by its definition: eight halvings a byte, over the bytes of each distinct run of a document.
@register("op13_spelling_variants", f"""
with recursive tab as (
  select list(x order by b) as t from (
    select b, list_reduce(list_prepend(b, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as x
    from (select unnest(range(256)) as b))),
runs as (select doc_id, t as run, count(*) as c from (
  select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as t from documents) group by doc_id, t),
h as (select run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2),
               lambda i: cast('0x' || substr(x, i + 1, 2) as bigint))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h
      from (select *, hex(encode(doc_id || ':' || run)) as x from runs), tab),
n as (select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from h),
v as (select word, cast(sum(c) as bigint) as n from n group by word having sum(c) >= 3 and length(word) >= 5),
e as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest
      from (select *, unnest(range(1, length(word) + 1)) as i from v)),
p as (select a.word, b.word as other, b.n as other_n from e a join e b on a.rest = b.rest and a.i = b.i and a.word <> b.word
      union select e.word, v.word, v.n from e join v on e.rest = v.word
      union select v.word, e.word, e.n from e join v on e.rest = v.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from p group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * n then other end as form,
             case when other_n >= 2 * n then other_n end as form_n from v left join best using (word)),
chain as (select word, word as root, 0 as step from f
          union all select c.word, f.form, step + 1 from chain c join f on f.word = c.root where f.form is not null)
select f.word, form, root, n, cast(n_near as bigint) as n_near, form_n
from f join (select word, arg_max(root, step) as root from chain group by word) r using (word)""")
def op13(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"))
