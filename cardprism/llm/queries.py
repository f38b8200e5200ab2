"""Registered queries: each applies one operator, with production parameters,
to its whole table, and derives the contract's digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cardprism.llm import collocations, decontam, exact_dedup, html_extract, importance, line_dedup, minhash, neighbours, packing, pii, token_rollup, toxicity, url_filter
from cardprism.llm.common import table
from cardprism.llm.registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES"]

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register("op1_html_extract")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_extract.extract_main(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


OP2_SQL = f"""
with n as (
  select doc_id, coalesce(length(text), 0) n_code, translate(coalesce(text, ''), {_WHITE}, '') norm from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by norm) as group_size,
  row_number() over g = 1 as kept, sha256(norm) as text_sha256
from n window g as (partition by norm order by n_code desc, doc_id)"""


@register("op2_exact_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = pii.detect_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
                        text_of(F.col("spans")).alias("spans"))


URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
OP8_SQL = rf"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') head from u),
s as (select row_number() over () as n, page_id, translate(head, {_AZ}) as host,
        regexp_extract(substr(rest, length(head) + 1), '^[^?#]*') as path from h),
r as (select * from (values {_RULE_ROWS}) t(verdict, rule_host, rule_path)),
f as (select s.*, r.*, row_number() over (partition by n order by length(rule_host) desc, length(rule_path) desc) as k
      from s left join r on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path))
select page_id, host, path, rule_host || rule_path as rule, coalesce(verdict, 'allow') as verdict from f where k = 1"""


@register("op8_url_filter", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "url_filter.*")


OP10_SQL = f"""
with d as (select row_number() over () as n, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select n, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select *, translate(trim(line, {_WHITE}), {_AZ}) as key from l),
r as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, r.key is not null and k.doc_id <> r.keeper as goes from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (goes) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not goes), '')) as kept_sha256
from m group by n, doc_id"""


@register("op10_line_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op5_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@register("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity.score").alias("score"),
                         (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity.n_restored").alias("n_restored"))


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.rollup_documents(table(spark, sf_dir, "documents"))


@register("op9_decontaminate")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), {_AZ}) as text from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words
      from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d)),
n as (select lang, sum(len(words)) as n from p group by lang),
o as (select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase
      from (select lang, words, k, unnest(generate_series(1, len(words) - k + 1)) as i from p, range(1, 5) as r(k))),
f as (select lang, k, phrase, count(*) as f from o group by all),
c as (select lang, k, phrase, string_split(phrase, ' ') as words, f as a from f where k >= 2 and f >= 30),
s as (select distinct lang, array_to_string(words[i:i + m - 1], ' ') as phrase, phrase as longer, a
      from (select *, unnest(generate_series(1, k - m + 1)) as i from c, range(2, 4) as r(m) where m < k)),
absorbed as (select distinct lang, phrase from s join c using (lang, phrase) where 100 * s.a::hugeint >= 80 * c.a::hugeint),
cuts as (select c.lang, c.phrase, c.a, j, l.f as l, r.f as r, (2000000 * c.a::hugeint) // (l.f + r.f) as score
      from c cross join range(1, 4) as x(j)
      join f l on l.lang = c.lang and l.phrase = array_to_string(words[1:j], ' ')
      join f r on r.lang = c.lang and r.phrase = array_to_string(words[j + 1:c.k], ' ')
      where j < c.k),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
      from best anti join absorbed using (lang, phrase))
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked join n using (lang) where rank <= 2000"""


@register("op11_phrase_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@register("op12_nearest_neighbours")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_CRC = "3988292384"   # fixed value: the reversed polynomial of crc32
OP13_SQL = rf"""
with crc as (select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
    lambda c, i: case when (c & 1) = 1 then xor(c >> 1, {_CRC}) else c >> 1 end)) as tab),
t as (select doc_id, coalesce(text, '') as text, 0 as side from documents union all select null, coalesce(text, ''), 1 from benchmark),
r as (select row_number() over () as n, doc_id, side, regexp_extract_all(translate(text, {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as words from t),
w as (select n, side, unnest(words) as word from r),
d as (select word, hex(encode(word)) as code from (select distinct word from w)),
b as (select word, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(code) // 2 + 1),
        lambda i: ('0x' || substr(code, (2 * i - 1)::int, 2))::bigint)),
        lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)]))) % 10000 as bucket from d, crc),
f as (select n, side, bucket from w join b using (word)),
s as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from f group by bucket),
g as (select bucket, floor(1000 * ln(((t + 1)::double * (sum(s) over () + 10000)) / ((s + 1)::double * (sum(t) over () + 10000)))) as gain
      from s),
e as (select n, count(*) as n_features, floor(sum(gain) / count(*)) as weight from f join g using (bucket) where side = 0 group by n),
x as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0)::bigint as weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
      from r left join e using (n) where side = 0),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from x),
z as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as place,
        count(*) filter (n_features >= 20) over () as able from y)
select doc_id, n_features::bigint as n_features, weight, score,
  case when n_features >= 20 and place <= 10 * able // 100 then place end as rank from z"""


@register("op13_importance_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
