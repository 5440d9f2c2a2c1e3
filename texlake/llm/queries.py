"""The operators' queries over whole tables, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, langid, mixing, near_dedup, packing, quality_classifier, quality_rules, toxicity, url_filters
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, toxicity.train(docs, read(spark, sf_dir, "labels")), threshold=0.5)


#: The conversation that holds the template's look-alikes.
HOSTILE = r"\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(k).alias("turn"), F.lit(role).alias("role"), F.lit(HOSTILE).alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("r"))
    return chat.digests(turns.union(added.select("r.*")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.Cascade().fit(docs).apply(docs).drop("rejected_by")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda k: F.round(F.get("positions", F.lit(k))).cast("long")
    mixed = mixing.mix(read(spark, sf_dir, "documents")).withColumns({"position": place(0), "second_position": place(1)})
    return mixing.training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "position", "second_position")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


WORD = r"[^\x20\x09-\x0D]+"

OP4_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f as (
  select *, replace(replace(role, '\', '\\'), '<|', '<\|') as r, replace(replace(text, '\', '\\'), '<|', '<\|') as x from t
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, r, x)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, r, x) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(r) + length(r) - length(replace(r, chr(10), '')) + length(x) + 17)::bigint as formatted_chars
from f group by conv_id
"""

OP5_SQL = r"""
with recursive u as (
  select page_id, url, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, html, url,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail
  from u
), tags as (
  -- elements from their '<' on, up to the next '>'
  select host, path, tail, split_part(x, '>', 1) as tag
  from p, unnest(list_filter(string_split(coalesce(html, ''), '<')[2:], lambda x: regexp_matches(x, '(?i)^(link|meta)\s') and contains(x, '>'))) as t(x) where host <> ''
), attributes as (
  select host, path, tail, lower(regexp_extract(tag, '^\w+', 0)) as name,
    list_transform(regexp_extract_all(tag, '[\w-]+\s*=\s*("[^"]*"|''[^'']*''|[^\s"'']+)'), lambda x: {'k': lower(trim(split_part(x, '=', 1))), 'v': trim(substr(x, strpos(x, '=') + 1), chr(32) || chr(34) || chr(39))}) as a
  from tags
), read as (
  select host, path, tail, name, list_filter(a, lambda x: x.k = 'rel')[1].v as rel, list_filter(a, lambda x: x.k = 'href')[1].v as href,
    list_filter(a, lambda x: x.k = 'http-equiv')[1].v as equiv, list_filter(a, lambda x: x.k = 'content')[1].v as content from attributes
), targets as (
  select host, path, tail, trim(replace(replace(case when name = 'link' and lower(trim(rel)) = 'canonical' then href
    when name = 'meta' and lower(trim(equiv)) = 'refresh' then regexp_extract(content, '(?i)url\s*=\s*(.+)$', 1) end, '&amp;', '&'), '&#38;', '&'), chr(32) || chr(34) || chr(39)) as dst
  from read
), d as (
  select host, path, tail, case when regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*://') then substr(dst, strpos(dst, '://') + 3) when starts_with(dst, '//') then substr(dst, 3)
    when regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*:') then '' when starts_with(dst, '/') then host || dst when starts_with(dst, '?') then host || path || dst
    else host || case when path = '' then '/' else regexp_replace(path, '[^/]*$', '') end || dst end as rest
  from targets where dst <> ''
), flat(host, tail, rest, steps) as (
  -- one step of a dot segment at a time
  select host, tail, rest, 9 from d where rest <> ''
  union all
  select host, tail, regexp_replace(regexp_replace(regexp_replace(rest, '/\./', '/'), '^([^/?#]+)/\.\./', '\1/'), '^([^?#]*)/[^/?#]+/\.\./', '\1/'), steps - 1 from flat where steps > 0
), e as (
  select host || tail as src, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as dst
  from flat where steps = 0
), both_ways as (
  select src, dst from e where src <> dst union select dst, src from e where src <> dst
), reach as (
  select src as a, src as b from both_ways union select r.a, w.dst from reach r join both_ways w on r.b = w.src
), rules(rule, verdict, rhost, rpath) as (
  values ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
    ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), nodes as (
  select distinct b as node, regexp_extract(b, '^[^/?#]*', 0) as host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) as path from reach
), verdicts as (
  select node, arg_max(verdict, length(rule)) as verdict from nodes join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by node
), spread as (
  select a as alias, bool_or(verdict = 'block') and not bool_or(verdict = 'allow') as blocked from reach join verdicts on b = node group by a
), own as (
  select page_id, host, path, host || tail as node, list(rule order by length(rule) desc) as fits, list(verdict order by length(rule) desc) as says
  from (select page_id, coalesce(host, '') as host, coalesce(path, '') as path, coalesce(tail, '') as tail from p) left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id, host, path, tail
)
select page_id, host, path, fits[1] as rule, coalesce(says[1], case when blocked then 'block' else 'allow' end) as verdict
from own left join spread on host <> '' and node = alias
"""

OP10_SQL = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, md5('mix:' || coalesce(doc_id::varchar, '')) as k from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source
), w as (
  select *, [3, 1, 2][((place - 1) % 3 + 1)::int]::double as weight, 2.0 * source_size as cap from s
), o as (
  select *, cap / weight as full_at, 1.5 * sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as open_weight from w
), l as (
  select *, min(case when (total - capped) / open_weight <= full_at then {{'f': full_at, 'p': place, 'l': (total - capped) / open_weight}} end) over () as found from o
), t as (
  select source, source_size, place, least(cap, coalesce(found.l * weight, cap))::double as target from l
), c as (
  -- a weight runs from a to b over training time; at time x the share a x + (b - a) x^2 / 2 of its demand is met
  select d.*, t.source_size, t.target, round(t.target)::bigint as goal,
    (select sum(target) from t) as whole, case when place % 2 = 1 then 1.5 else 0.5 end::double as a,
    coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as begun
  from d join t on d.source is not distinct from t.source
), p as (
  select *, least(size, greatest(goal - begun, 0)) as one, least(size, greatest(goal - begun - source_size, 0)) as two,
    begun / nullif(target, 0) as at_one, (begun + source_size) / nullif(target, 0) as at_two, 2 * (1 - a) as slope
  from c
)
select doc_id, size, source_size, target, (one + two)::bigint as taken,
  case when one > 0 then round((sqrt(a * a + 2 * slope * at_one) - a) / slope * whole)::bigint end as position,
  case when two > 0 then round((sqrt(a * a + 2 * slope * at_two) - a) / slope * whole)::bigint end as second_position
from p
"""

OP8_SQL = rf"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from documents
), spread as (
  select doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as i from t
), three as (
  select doc_id, i, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from spread window o as (partition by doc_id order by i)
), win as (
  select doc_id, i, count(*) over (partition by doc_id, w, w2, w3) as n from three where w3 is not null
), hit as (
  select distinct doc_id, i + j as pos from win, (values (0), (1), (2)) as x(j) where n > 1
), rep as (
  select doc_id, count(*)::bigint as n_repeat_words from hit group by doc_id
), m as (
  select t.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines) as n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) as n_upper,
    length(text) - length(replace(text, '!', '')) as n_exclamations
  from t left join rep on t.doc_id is not distinct from rep.doc_id
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 12 * n_words or 10 * n_dup_lines > 3 * n_lines
    or 10 * n_upper > 4 * word_chars or 10 * n_exclamations > 3 * n_words) as kept
from b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return {**found, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4_SQL, "op5_url_filters": OP5_SQL, "op8_quality_rules": OP8_SQL, "op10_mixing": OP10_SQL}
