"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, fuzzy_lines, hard_negatives, langid, minhash, mixing, packing, prefix_trie, topk, toxicity, url_filter, warc
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; nulls, repeats and empty tables as in toxicity.toxicity."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles; odd rows as in minhash.near_duplicates."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2).drop("text_key")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through an archive and back, a row each; odd rows as in warc.archive_round_trip."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every document; odd rows as in exact_dedup.deduplicate."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents; odd rows as in packing.pack."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line of all documents; odd rows as in fuzzy_lines.fuzzy_lines."""
    return fuzzy_lines.fuzzy_lines(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out; odd rows as in langid.language_of."""
    return langid.language_of(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth one; odd rows as in topk.top_k."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; odd rows as in mixing.mix."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages: those of the document with the page's number; bad is low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page; odd rows as in url_filter.filter_urls."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir)).drop("confidence")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and back, as digests; odd rows as in bpe.round_trip."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations; odd rows as in prefix_trie.prefix_trie."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all others; odd rows as in hard_negatives.hard_negatives."""
    return hard_negatives.hard_negatives(hard_negatives.labelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_minhash, op3_warc, op4_exact_dedup, op5_packing, op6_lines, op7_language, op8_topk, op9_mixing, op10_urls, op11_bpe, op12_prefix_trie, op13_hard_negatives)
}

SQL: dict[str, str] = {}

SQL["op2_minhash"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from words),
sized as (select doc_id, len(s) as n, s from sets),
items as (select doc_id, n, hash(unnest(s)) as h from sized),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as common, any_value(a.n) as n, any_value(b.n) as m
  from items a join items b on a.h = b.h and a.doc_id < b.doc_id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  group by 1, 2),
links as (select x, y from shared where 100 * common >= 80 * (n + m - common)),
both_ways as (select x, y from links union select y, x from links),
reach as (
  select doc_id, doc_id as near from documents
  union
  select r.doc_id, l.y from reach r join both_ways l on l.x = r.near),
comp as (select doc_id, min(near) as component_id from reach group by 1)
select s.doc_id, cast(s.n as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sized s join comp c using (doc_id)
"""

SQL["op3_warc"] = r"""
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
e as (select html, max(page_id) as first_id from p where n >= 1000 group by 1)
select page_id, cast(n as bigint) as payload_bytes, sha1(p.html) as payload_digest,
  case when e.first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when e.first_id <> page_id then e.first_id end as refers_to
from p left join e on p.n >= 1000 and p.html = e.html
"""

SQL["op4_exact_dedup"] = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size,
  first_value(doc_id) over w = doc_id as kept, h as text_sha256
from d window w as (partition by h order by chars desc, doc_id rows between unbounded preceding and unbounded following)
"""

SQL["op8_topk"] = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5
"""

SQL["op9_mixing"] = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5('mix/' || doc_id) as turn from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
p as (select *, cast([5, 2, 1][cast((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as int)] as bigint) as weight from s),
o as (
  select *, row_number() over (order by cast(source_size * 3 as double) / weight, encode(source) nulls last) as k from p),
f as (
  select *, (cast((select sum(source_size) from s) as bigint) - cast(coalesce(sum(source_size * 3) over (order by k rows between unbounded preceding and 1 preceding), 0) as bigint))::double
    / cast(sum(weight) over (order by k rows between current row and unbounded following) as bigint) as level from o),
l as (select level from f where level * weight <= source_size * 3 order by k limit 1),
t as (select f.source, f.source_size, least(cast(f.source_size * 3 as double), l.level * f.weight) as target from f, l),
q as (
  select d.*, t.source_size, t.target, cast(sum(size) over (partition by d.source order by turn, doc_id, size rows unbounded preceding) as bigint) as upto
  from d join t on d.source is not distinct from t.source),
c as (
  select q.*, cast(upto + e * source_size as double) / target as finish from q, (select unnest([0, 1, 2]) as e) where size > 0 and target > 0),
r as (
  select *, sum(size) over (order by finish, source is null, encode(source), turn, doc_id rows unbounded preceding) as run from c),
k as (select doc_id, source, turn, cast(sum(size) as bigint) as taken from r where run <= (select sum(size) from d) group by 1, 2, 3)
select q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) as taken
from q left join k on q.doc_id = k.doc_id
"""

SQL["op12_prefix_trie"] = r"""
with recursive t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
ids as (
  select conv_id, list_reduce(list_prepend(4294967295::bigint, list_transform(str_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i::bigint)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)) as c
  from (select distinct conv_id from t)),
h as (select conv_id, xor(c, 4294967295::bigint) % 4 as h, conv_id - conv_id % 20 as base from ids),
whole as (
  select h.conv_id, 0 as own, t.pos, t.role, t.text from h join t on t.conv_id = h.base and t.pos <= h.h
  union all
  select h.conv_id, 1, t.pos, t.role, t.text from h join t on t.conv_id = h.conv_id and t.pos > h.h),
rows_of as (
  select conv_id, row_number() over (partition by conv_id order by own, pos) as d, sha256(sha256(role) || text) as turn,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from whole),
paths as (
  select conv_id, d, words, string_agg(turn, '') over (partition by conv_id order by d) as seq from rows_of
  union all
  select conv_id, 0, 0, '' from ids),
named as (select conv_id, d, words, sha256(seq) as key, max(d) over (partition by conv_id) as last_d from paths),
nodes as (
  select key, min(conv_id) as conv_id, any_value(d) as depth, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved,
    sha256(coalesce(string_agg(case when d = last_d then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from named group by 1),
linked as (
  select n.*, p.key as parent_key from nodes n left join named p on p.conv_id = n.conv_id and p.d = n.depth - 1),
kids as (select parent_key as key, count(*) as n_children from linked where parent_key is not null group by 1),
full_nodes as (
  select l.*, coalesce(k.n_children, 0) as n_children, p.conv_id as parent_conv_id
  from linked l left join kids k on k.key = l.key left join nodes p on p.key = l.parent_key),
sums as (
  select a.key, sum(n.saved) as saved_tokens, count(*) filter (n.n_children = 0) as n_leaves
  from full_nodes n join named a on a.conv_id = n.conv_id and a.d <= n.depth group by 1)
select cast(f.conv_id as bigint) as conv_id, cast(f.depth as bigint) as depth, cast(f.parent_conv_id as bigint) as parent_conv_id, cast(f.n_convs as bigint) as n_convs,
  cast(f.n_children as bigint) as n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, f.ends_sha256
from full_nodes f join sums s using (key)
"""

SQL["op13_hard_negatives"] = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
    cast(list_sum(list_transform(range(1, len(a.w) + 1), lambda i: a.w[i] * r.w[i])) as bigint) as score
  from v a join v r on r.vec_id <> a.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""
