"""The registered queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates as D, geometry as G, names as N, rules as R, vectors as V
from ..operators import aggregates as A, filters as P, index as I, joins as J, lifecycle as L, pages as T, resolve, search as X, similarity as S
from ..schema import Corpus
from ..sources import feeds
from ..streaming import jobs as K
from ..tables import scratch, snapshot
from . import reports
from .binding import AS_OF, EVENTS_AS_OF, corpus, table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (corpus, read), where read(name) is a driver's table; ``sql`` may name the model's tables as c_..."""
    def register(f: Callable[[Corpus, Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(corpus(spark, sf_dir), lambda name: table(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_tables(sql)
        return f

    return register


def date_text(*columns: str):
    return [F.col(c).cast("string").alias(c) for c in columns]


# ---- names and scalars

@query("""select p_partkey, array_to_string(list_prepend(list_last(w), []::varchar[]), '') || ', ' || array_to_string(w[1:len(w) - 1], ' ') as name
  from (select p_partkey, string_split(p_name || ' jr', ' ') as w from part)""")
def p1_canonical_name(c, read):
    return read("part").select("p_partkey", N.canonical_name(F.concat("p_name", F.lit(" jr"))).alias("name"))


@query("""select c_custkey, trim(regexp_replace(strip_accents(lower(list_last(w) || ', ' || w[1])), '[^a-z0-9]+', '-', 'g'), '-') as slug
  from (select c_custkey, ['Élodie', c_name] as w from customer)""")
def p2_slug(c, read):
    return read("customer").select("c_custkey", N.slug(F.concat(F.lit("Élodie "), "c_name")).alias("slug"))


@query("""select e.id, coalesce(a.alias, case when contains(e.name, ',') then trim(split_part(e.name, ',', 2)) || ' ' || trim(split_part(e.name, ',', 1)) end, e.name) as natural
  from c_entities e left join (select entity_id, arg_min(alias, id) as alias from c_aliases group by 1) a on a.entity_id = e.id""")
def p3_natural_name(c, read):
    first = c.aliases.groupBy(F.col("entity_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return c.entities.join(first, "id", "left").select("id", N.natural_name(F.col("name"), F.col("aliases")).alias("natural"))


@query("""select id as entity_id, cast(unnest(range(len(v))) as int) as position, unnest(v) as variant from (
  select e.id, list_filter(list_concat([e.name, case when contains(e.name, ',') then trim(split_part(e.name, ',', 2)) || ' ' || trim(split_part(e.name, ',', 1)) end], coalesce(a.l, [])), lambda x: x is not null and x <> '') as v
  from c_entities e left join (select entity_id, list(alias order by id) as l from c_aliases group by 1) a on a.entity_id = e.id)""")
def p4_name_variants(c, read):
    return J.variants_table(c.entities, c.aliases)


LETTER = "case when regexp_matches(upper(strip_accents(substr({0}, 1, 1))), '^[A-Z]$') then upper(strip_accents(substr({0}, 1, 1))) else '#' end"


@query(f"select doc_id, {LETTER.format('text')} as letter from documents")
def p5_bucket_letter(c, read):
    return read("documents").select("doc_id", N.bucket_letter(F.col("text")).alias("letter"))


@query("select doc_id from documents where substr(text, 1, 1) in ('E', 'e', 'È', 'É', 'Ê', 'Ë')")
def p6_letter_filter(c, read):
    return read("documents").filter(N.in_letter(F.col("text"), "E")).select("doc_id")


@query("select doc_id from documents where not regexp_matches(substr(text, 1, 1), '[A-Za-zÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ]')")
def p6_letter_rest(c, read):
    return read("documents").filter(N.in_letter(F.col("text"), "#")).select("doc_id")


@query("select id from c_entities where id % 3 = 0 or starts_with(name, 'Y') or starts_with(name, 'y')")
def p6_letter_y(c, read):
    named = c.entities.withColumn("name", F.when(F.col("id") % 6 == 0, F.concat(F.lit("Ÿ"), "name")).when(F.col("id") % 3 == 0, F.concat(F.lit("Ý"), "name")).otherwise(F.col("name")))
    return named.filter(N.in_letter(F.col("name"), "Y")).select("id")


@query("select id, case when contains(name, ',') then trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) else name end as sort_key from c_entities")
def p7_sort_key(c, read):
    return c.entities.select("id", N.sort_key(F.col("name")).alias("sort_key"))


@query("select o_orderkey, cast(o_orderdate as date)::varchar as day from orders")
def p8_pub_date(c, read):
    mail = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss '+0000'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return read("orders").select("o_orderkey", D.parse_pub_date(mail).cast("string").alias("day"))


@query("select o_orderkey, case when o_orderkey % 3 <> 0 then cast(o_orderdate as date)::varchar end as day from orders")
def p9_kb_time(c, read):
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-"), F.date_format("o_orderdate", "yyyy-MM-"), F.when(F.col("o_orderkey") % 3 == 0, "00").otherwise(F.date_format("o_orderdate", "dd")), F.lit("T00:00:00Z"))
    return read("orders").select("o_orderkey", D.parse_kb_time(text).cast("string").alias("day"))


@query("select page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') as host from pages")
def p10_url_host(c, read):
    return read("pages").select("page_id", R.url_host(F.col("url")).alias("host"))


@query("select id, case when regexp_matches(source_url, '[.]PNG') then '.png' else '.jpg' end as ext from c_images")
def p11_guess_ext(c, read):
    return c.images.select("id", R.guess_ext(F.col("source_url")).alias("ext"))


@query("select id, array_to_string(list_filter(string_split(nationalities_text, '|'), lambda x: trim(x) <> ''), ';') as parts from c_entities")
def p12_pipe_list(c, read):
    return c.entities.select("id", F.array_join(R.pipe_list(F.col("nationalities_text")), ";").alias("parts"))


@query("""select id, case when a >= 0 then cast(a as int) end as age from (select id, year(death_date) - year(birth_date)
  - (case when (month(death_date), day(death_date)) < (month(birth_date), day(birth_date)) then 1 else 0 end) as a from c_entities)""")
def p13_age_at_death(c, read):
    return c.entities.select("id", D.age_at_death(F.col("birth_date"), F.col("death_date")).alias("age"))


@query("select id, lower(trim(split_part(name, ',', 1))) as surname from c_entities")
def p14_surname(c, read):
    return c.entities.select("id", N.surname_key(F.col("name")).alias("surname"))


@query(r"select doc_id, array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') as folded from documents")
def p15_tokens(c, read):
    return read("documents").select("doc_id", F.array_join(N.tokens(F.col("text")), " ").alias("folded"))


@query("select l_orderkey, l_linenumber, y as yaw, case when y >= 15 then 'right' when y <= -15 then 'left' else 'front' end as pose from (select *, l_quantity - 25 as y from lineitem)")
def p16_pose(c, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("yaw")).withColumn("pose", G.classify_pose(F.col("yaw")))


@query("select l_orderkey, l_linenumber, round(case when abs(l_tax * 1000) < 1 then 0.0 else 60.0 * (l_quantity - (l_tax * 1000) / 2) / abs(l_tax * 1000) end, 6) as yaw from lineitem")
def p17_yaw(c, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", F.round(G.estimate_yaw(F.col("l_quantity"), F.lit(0.0), F.col("l_tax") * 1000), 6).alias("yaw"))


@query("select l_orderkey, l_linenumber, round(degrees(atan2(l_tax, l_quantity)), 6) as roll, round(100.0 * (l_discount - l_tax), 6) as pitch from lineitem")
def p18_p19_roll_pitch(c, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", F.round(G.estimate_roll(F.col("l_quantity"), F.col("l_tax")), 6).alias("roll"), F.round(G.estimate_pitch(F.col("l_discount"), F.col("l_tax")), 6).alias("pitch"))


def _points(read) -> DataFrame:
    """Vectors as points: 32 for each, in a frame of 300."""
    v = F.col("embedding")
    return read("embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        (v[i * 2].cast("double") * 300 + 150).alias("x"), (v[i * 2 + 1].cast("double") * 300 + 150).alias("y"))).alias("mesh"))


POINTS = "(select vec_id, list_transform(range(32), lambda i: {'x': embedding[2 * i + 1]::double * 300 + 150, 'y': embedding[2 * i + 2]::double * 300 + 150}) as m from embeddings)"
EYES = f"(select vec_id, m, (m[1].x + m[2].x) / 2 as lx, (m[1].y + m[2].y) / 2 as ly, (m[3].x + m[4].x) / 2 as rx, (m[3].y + m[4].y) / 2 as ry from {POINTS})"


@query(f"select vec_id, round(lx, 6) as lx, round(ry, 6) as ry, cast(trunc(sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly))) as int) as distance from {EYES}")
def p20_eye_geometry(c, read):
    return _points(read).select("vec_id", G.eye_geometry(F.col("mesh"), (0, 1), (2, 3)).alias("e")).select("vec_id", F.round("e.lx", 6).alias("lx"), F.round("e.ry", 6).alias("ry"), "e.distance")


@query(f"""select vec_id, round(a, 6) as a, round(b, 6) as b, round(150 - a * (lx + rx) / 2 - b * (ly + ry) / 2, 4) as tx,
  round((a * m[6].x + b * m[6].y + (150 - a * (lx + rx) / 2 - b * (ly + ry) / 2)) / 300, 5) as x6 from (
  select *, 80 * (rx - lx) / g as a, 80 * (ry - ly) / g as b from (select *, (rx - lx) * (rx - lx) + (ry - ly) * (ry - ly) as g from {EYES}))""")
def p21_p22_align(c, read):
    e = _points(read).withColumn("e", G.eye_geometry(F.col("mesh"), (0, 1), (2, 3)))
    m = e.withColumn("m", G.align_matrix(F.col("e.lx"), F.col("e.ly"), F.col("e.rx"), F.col("e.ry"))).withColumn("moved", G.transform_mesh(F.col("mesh"), F.col("m")))
    return m.select("vec_id", F.round(F.col("m")[0], 6).alias("a"), F.round(F.col("m")[1], 6).alias("b"), F.round(F.col("m")[2], 4).alias("tx"), F.round(F.col("moved")[5]["x"], 5).alias("x6"))


@query("select vec_id, round(cast(embedding[1] as double), 6) as first, cast(len(embedding) as int) as n from embeddings")
def p23_decode(c, read):
    back = G.decode_f32(G.encode_f32(F.col("embedding")))
    return read("embeddings").select("vec_id", back.alias("v")).select("vec_id", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.size("v").alias("n"))


@query("select l_orderkey, l_linenumber, bit_count(xor(l_orderkey, l_partkey)) / 64.0::double as distance from lineitem")
def p24_hamming(c, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", V.hamming64(F.col("l_orderkey"), F.col("l_partkey")).alias("distance"))


@query("""select a.vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)), 6) as distance
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def p25_cosine(c, read):
    e = read("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("""select l_orderkey, l_linenumber, round(l_quantity / sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) as x from lineitem""")
def p26_normalize(c, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", F.round(V.l2_normalize(F.array("l_quantity", "l_tax"))[0], 6).alias("x"))


@query("""select i.id, case when f.face_count > 1 then 'composition' when f.face_count = 1 then 'misattribution' else 'unknown' end as hypothesis,
  case association_status when 'human_flagged' then 'human' when 'flagged' then 'automatic' end as origin from c_images i left join c_faces f on f.image_id = i.id""")
def p27_p28_flag_rules(c, read):
    return J.images_wide(c).select("id", R.flag_hypothesis(F.col("face_count")).alias("hypothesis"), R.flag_origin(F.col("association_status")).alias("origin"))


@query("select id, contains(caption, 'Portrait') and not contains(caption, 'RO') as fits from c_images")
def p29_caption_rule(c, read):
    return c.images.select("id", R.caption_rule(F.col("caption"), ["Portrait"], ["RO"]).alias("fits"))


@query("select entity_id, n, case when n < 2 then 'not enough unique images' end as note from (select entity_id, cast(sum(case when is_duplicate = false then 1 else 0 end) as bigint) % 3 as n from c_images group by 1)")
def p30_diversity_note(c, read):
    n = c.images.groupBy("entity_id").agg((F.count_if(F.col("is_duplicate").eqNullSafe(False)) % 3).alias("n"))
    return n.withColumn("note", R.diversity_note(F.col("n")))


@query("select id, case when image_count > 0 then least(1.0, greatest(0.18, image_count / 60::double)) else 0.0 end as level, case when image_count > 0 then round(1 / image_count::double, 4) else 0.0 end as ratio from c_entities")
def p31_p32_heat_ratio(c, read):
    return c.entities.select("id", R.heat_level(F.col("image_count"), F.lit(60)).alias("level"), R.safe_ratio(F.lit(1), F.col("image_count"), 4).alias("ratio"))


@query("select a.id, case when lower(a.alias) = lower(e.name) then 1.0 else 0.7 end::double as score from c_aliases a join c_entities e on e.id = 3")
def p34_label_score(c, read):
    name = c.entities.filter("id = 3").select("name")
    return c.aliases.crossJoin(F.broadcast(name)).select("id", R.label_score(F.col("alias"), F.col("name")).alias("score"))


@query("""select id, strftime(published_at, '%Y-%m-%d') as d, strftime(published_at, '%Y-%m') as m,
  case when published_at is not null then printf('%04d-W%02d', isoyear(published_at), weekofyear(published_at)) end as w from c_articles""")
def p35_period_key(c, read):
    day = F.col("published_at")
    return c.articles.select("id", D.period_key(day, "day").alias("d"), D.period_key(day, "month").alias("m"), F.when(day.isNotNull(), D.period_key(day, "week")).alias("w"))


@query("select id, case when aligned_path is not null then '/images/' || id || '/aligned' end as url from c_images")
def p36_aligned_url(c, read):
    return c.images.select("id", R.aligned_url(F.col("id"), F.col("aligned_path")).alias("url"))


# ---- filters

@query("select id from c_entities where kb_status is null or kb_status <> 'not_person'")
def f1_live(c, read):
    return P.live(c.entities).select("id")


@query("select id from c_entities where kb_status <> 'not_person'")
def f2_live_strict(c, read):
    return P.live(c.entities, strict=True).select("id")


@query("select id, 'in' as side from c_images where association_status in ('flagged', 'manual') union all select id, 'out' from c_images where association_status not in ('flagged', 'manual')")
def f3_status_sets(c, read):
    return P.status_in(c.images, "flagged", "manual").select("id", F.lit("in").alias("side")).unionByName(P.status_not_in(c.images, "flagged", "manual").select("id", F.lit("out").alias("side")))


@query("select id, 'analysis' as kind from (select id from c_images where analysis_status = 'pending' order by id limit 40) union all select id, 'kb_done' from (select id from c_entities where kb_status = 'done' and kb_id is not null order by id limit 40)")
def f4_backlog(c, read):
    return P.backlog(c.images, "analysis", 40).select("id", F.lit("analysis").alias("kind")).unionByName(P.backlog(c.entities, "kb_done", 40).select("id", F.lit("kb_done").alias("kind")))


@query("select id from c_articles where published_at between date '1997-01-01' and date '1997-12-31'")
def f5_date_range(c, read):
    return P.date_range(c.articles, "1997-01-01", "1997-12-31").select("id")


@query("select id from c_images where coalesce(provider, 'feed') = 'feed'")
def f6_provider(c, read):
    return P.where_provider(c.images, "feed").select("id")


@query("select id from c_articles where domain = '1-URGENT' union all select id from c_entities where is_favorite")
def f6_domain_favorites(c, read):
    return P.where_domain(c.articles, "1-URGENT").select("id").unionByName(P.favorites(c.entities).select("id"))


@query("select id from c_images where starts_with(caption, 'View of R') or source_url ilike '%/17%.png%'")
def f7_demo_rows(c, read):
    return P.demo_rows(c.images, ["View of R"], "%/17%.png%").select("id")


# ---- joins

@query("select l.article_id, l.entity_id, a.domain, e.name from c_links l join c_articles a on a.id = l.article_id join c_entities e on e.id = l.entity_id")
def j1_article_mentions(c, read):
    return J.article_mentions(c).select("article_id", "entity_id", "domain", "name")


@query("""select i.id, e.name as entity_name, a.title as article_title, f.pose from c_images i left join c_entities e on e.id = i.entity_id
  left join c_articles a on a.id = i.article_id left join c_faces f on f.image_id = i.id""")
def j2_images_wide(c, read):
    return J.images_wide(c).select("id", "entity_name", "article_title", "pose")


@query("select id, title from c_articles where id in (select article_id from c_links where entity_id = 3)")
def j3_articles_of(c, read):
    return J.articles_of(c, 3).select("id", "title")


@query("select id from c_articles where not exists (select 1 from c_links where article_id = c_articles.id)")
def j4_orphan_articles(c, read):
    return J.orphan_articles(c).select("id")


@query("select a.entity_id as entity_a, b.entity_id as entity_b, count(*) as shared from c_links a join c_links b on a.article_id = b.article_id and a.entity_id < b.entity_id group by 1, 2")
def j5_cooccurrence(c, read):
    return J.cooccurrence(c.links)


@query("""select a.id, a.title, l.entity_id, e.name as entity_name from c_articles a left join (select article_id, min(entity_id) as entity_id from c_links group by 1) l on l.article_id = a.id
  left join c_entities e on e.id = l.entity_id""")
def j6_first_entity(c, read):
    return J.first_entity(c)


J7_SQL = """select i.id as image_id, arg_min(l.entity_id, l.entity_id) as entity_id from c_images i join c_links l on l.article_id = i.article_id join c_entities e on e.id = l.entity_id
  where contains(lower('for Nation' || (i.id % 25) || ', Supplier#00000000' || (i.id % 10) || ' ' || i.caption), lower(e.name)) group by 1"""


def _captioned(c: Corpus) -> DataFrame:
    text = F.concat(F.lit("for Nation"), (F.col("id") % 25).cast("string"), F.lit(", Supplier#00000000"), (F.col("id") % 10).cast("string"))
    return c.images.filter("article_id is not null").select(F.col("id").alias("image_id"), "article_id", text.alias("alt"), "caption")


@query(J7_SQL)
def j7_associate(c, read):
    own = c.links.select("article_id", "entity_id", F.col("entity_id").alias("entity_pos"))
    names = c.entities.select(F.col("id").alias("entity_id"), F.lit(0).alias("position"), F.col("name").alias("variant"))
    return J.associate(_captioned(c), own, names)


def _hashed(read) -> DataFrame:
    return read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("entity_id"), F.col("vec_id").alias("scraped_at"), V.median_bits(F.col("embedding")).alias("hash64"))


#: The 64 bits as text, first number first.
BITS = """(select vec_id as id, label::bigint as entity_id, array_to_string(list_transform(embedding, lambda x: case when x::double > list_sort(embedding[2:64])[32]::double then '1' else '0' end), '') as b from embeddings)"""


@query(f"select id, b as bits from {BITS}")
def v1_median_bits(c, read):
    bits = F.reverse(F.lpad(F.bin("hash64"), 64, "0"))
    return _hashed(read).select("id", bits.alias("bits"))


@query(f"select x.entity_id, x.id as a, y.id as b, cast(hamming(x.b, y.b) as int) as bits from {BITS} x join {BITS} y on x.entity_id = y.entity_id and x.id < y.id where hamming(x.b, y.b) <= 20")
def j8_hamming_pairs(c, read):
    return S.hamming_pairs(_hashed(read), 20)


@query("""select a.vec_id as a, b.vec_id as b, round(1 - list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)), 6) as distance
  from embeddings a join embeddings b on a.vec_id < b.vec_id
  where 1 - list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)) <= 0.6""")
def j9_vector_pairs(c, read):
    return S.vector_pairs(read("embeddings"), 0.6, "vec_id", "embedding").select("a", "b", F.round("distance", 6).alias("distance"))


@query("""select m.raw_name, coalesce(e.id, a.entity_id) as entity_id, case when s.kb_status = 'not_person' then 'rejected' when e.id is not null then 'slug' when a.entity_id is not null then 'alias' else 'new' end as outcome
  from (select c_name as raw_name from customer union all select s_name from supplier) m
  left join (select id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug from c_entities) e on e.slug = trim(regexp_replace(lower(m.raw_name), '[^a-z0-9]+', '-', 'g'), '-')
  left join (select alias, arg_max(entity_id, id) as entity_id from c_aliases group by 1) a on a.alias = m.raw_name
  left join c_entities s on s.id = coalesce(e.id, a.entity_id)""")
def j10_resolve_mentions(c, read):
    mentions = read("customer").select(F.col("c_name").alias("raw_name")).unionByName(read("supplier").select(F.col("s_name").alias("raw_name")))
    own = c.entities.withColumn("slug", F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return J.resolve_mentions(mentions, own, c.aliases).select("raw_name", "entity_id", "outcome")


@query("select i.id, d.source_url as canonical_url from (select id, case when is_duplicate then id - id % 100 + 1 end as of from c_images) i left join c_images d on d.id = i.of")
def j11_with_canonical(c, read):
    images = c.images.withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("id") - F.col("id") % 100 + 1))
    return J.with_canonical(images).select("id", "canonical_url")


@query("""select s_suppkey as key, array_to_string(list_filter([n.n_name, m.n_name], lambda x: x is not null), ',') as labels from supplier
  left join nation n on n.n_nationkey = s_nationkey left join nation m on m.n_nationkey = (s_nationkey + 7) % 30""")
def j12_labels(c, read):
    q = lambda x: F.concat(F.lit("Q"), x.cast("string"))
    ids = read("supplier").select(F.col("s_suppkey").alias("key"), F.array(q(F.col("s_nationkey")), q((F.col("s_nationkey") + 7) % 30)).alias("kb_ids"))
    labels = read("nation").select(q(F.col("n_nationkey")).alias("kb_id"), F.when(F.col("n_nationkey") % 2 == 0, "fr").otherwise("en").alias("lang"), F.col("n_name").alias("label"))
    return J.resolve_labels(ids, labels).select("key", F.array_join("labels", ",").alias("labels"))


@query("select id from c_images where aligned_path is not null and aligned_path not in (select 'a/' || p_partkey from part where p_size > 5)")
def j13_missing_files(c, read):
    manifest = read("part").filter("p_size > 5").select(F.concat(F.lit("a/"), F.col("p_partkey").cast("string")).alias("path"))
    return J.missing_files(c.images.withColumn("local_path", F.col("aligned_path")), manifest).select("id")


CLASH = """(select id, name, image_count as n from c_entities where kb_status is null or kb_status <> 'not_person')"""
J14_SQL = f"""select name as collision_on, case when f then id else owner end as first_id, case when f then owner else id end as second_id from (
  select a.id, a.name, o.owner, a.n > b.n or (a.n = b.n and a.name <= b.name) as f, row_number() over (partition by least(a.id, o.owner), greatest(a.id, o.owner) order by a.id) as k
  from {CLASH} a join (select alias, arg_max(entity_id, id) as owner from c_aliases group by 1) o on o.alias = a.name and o.owner <> a.id join {CLASH} b on b.id = o.owner) where k = 1"""


@query(J14_SQL)
def j14_alias_collisions(c, read):
    return J.alias_collisions(c.entities, c.aliases)


# ---- aggregates

COUNTS = """(select e.*, coalesce(i.n, 0) as images, coalesce(i.u, 0) as uniques, coalesce(l.n, 0) as articles, coalesce(e.first_seen, l.t) as seen from c_entities e
  left join (select entity_id, count(*) as n, count(*) filter (where is_duplicate = false) as u from c_images group by 1) i on i.entity_id = e.id
  left join (select entity_id, count(distinct article_id) as n, min(a.scraped_at) as t from c_links left join c_articles a on a.id = article_id group by 1) l on l.entity_id = e.id)"""


@query(f"select id, articles as article_count, images as image_count, uniques as unique_image_count, cast(cast(seen as date) as varchar) as first_seen from {COUNTS}")
def a1_a2_recompute_counts(c, read):
    return A.recompute_counts(c).select("id", "article_count", "image_count", "unique_image_count", F.col("first_seen").cast("date").cast("string").alias("first_seen"))


@query("""select entity_id, coalesce(f.pose, 'unknown') as pose, count(*) as n from c_images i left join c_faces f on f.image_id = i.id group by 1, 2
  union all select null, coalesce(f.pose, 'unknown'), count(*) from c_images i left join c_faces f on f.image_id = i.id group by 2""")
def a3_pose_distribution(c, read):
    return A.pose_distribution(c, per_entity=True).unionByName(A.pose_distribution(c).withColumn("entity_id", F.lit(None).cast("bigint")))


IMAGE_ARTICLES = "c_images i join c_articles a on a.id = i.article_id"


@query(f"select i.entity_id, a.domain, count(distinct i.id) as n from {IMAGE_ARTICLES} group by 1, 2")
def a4_source_distribution(c, read):
    return A.source_distribution(c)


@query(f"select i.entity_id, min(a.published_at)::varchar as first_day, max(a.published_at)::varchar as last_day from {IMAGE_ARTICLES} group by 1")
def a5_coverage_range(c, read):
    return A.coverage_range(c).select("entity_id", *date_text("first_day", "last_day"))


TIMELINE = f"(select l.entity_id, a.published_at as day, count(distinct l.article_id) as n from c_links l join c_articles a on a.id = l.article_id where a.published_at between date '{AS_OF}' - 365 and date '{AS_OF}' group by 1, 2)"


@query(f"select entity_id, day::varchar as day, n from {TIMELINE}")
def a6_timeline(c, read):
    return A.timeline(c, AS_OF).select("entity_id", *date_text("day"), "n")


@query(f"""select i.entity_id, printf('%04d-W%02d', isoyear(a.published_at), weekofyear(a.published_at)) as period, count(*) as n from {IMAGE_ARTICLES} where a.published_at is not null group by 1, 2""")
def a7_media_timeline(c, read):
    return A.media_timeline(c, "week")


@query("""select (select count(*) from c_entities) as entities, (select count(*) from c_articles) as articles, count(*) as images, count(aligned_path) as aligned,
  count(*) filter (where is_duplicate) as duplicates, round(count(aligned_path) / count(*)::double, 3) as alignment_rate from c_images""")
def a8_corpus_stats(c, read):
    return A.corpus_stats(c)


@query("select id, name, image_count from c_entities where kb_status is distinct from 'not_person' order by image_count desc nulls last, id limit 10")
def a8_top_entities(c, read):
    return A.top_entities(c.entities)


SORT_KEY = "(case when contains(name, ',') then trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) else name end)"


@query(f"select 'name' as by, {LETTER.format('name')} as letter, count(*) as n from c_entities where kb_status is distinct from 'not_person' group by 2 union all select 'first', {LETTER.format(SORT_KEY)}, count(*) from c_entities where kb_status is distinct from 'not_person' group by 2")
def a9_letter_histogram(c, read):
    return A.letter_histogram(c.entities).withColumn("by", F.lit("name")).unionByName(A.letter_histogram(c.entities, "first").withColumn("by", F.lit("first")))


@query(f"""select f.*, t.total, e.name, round(f.flagged / t.total::double, 3) as ratio from (select i.entity_id, count(*) as flagged, round(avg(match_score), 4) as mean_score, min(published_at)::varchar as first_day, max(published_at)::varchar as last_day
  from {IMAGE_ARTICLES} where association_status = 'flagged' and published_at between date '1996-01-01' and date '1999-12-31' group by 1) f
  join (select entity_id, count(*) as total from c_images group by 1) t on t.entity_id = f.entity_id join c_entities e on e.id = f.entity_id order by flagged desc, f.entity_id limit 20""")
def a10_flagged_by_period(c, read):
    return A.flagged_by_period(c, "1996-01-01", "1999-12-31").select("entity_id", "flagged", "mean_score", *date_text("first_day", "last_day"), "total", "name", "ratio")


GAUGES = """select (select count(*) from c_entities) as entities, (select count(*) from c_entities where kb_status = 'not_person') as tombstones, count(*) as images,
  count(*) filter (where association_status in ('flagged', 'human_flagged')) as flagged, round(count(*) filter (where association_status in ('flagged', 'human_flagged')) / count(*)::double, 6) as flagged_ratio from c_images"""


@query(GAUGES)
def a11_gauges(c, read):
    return A.gauges(c)


@query("select coalesce(provider, 'feed') as provider, count(*) as n from c_images group by 1")
def a12_by_provider(c, read):
    return A.by_provider(c.images)


@query("select count(*) filter (where scrape_status = 'downloaded') as downloaded, count(*) filter (where scrape_status = 'failed') as failed, count(*) filter (where analysis_status = 'pending') as pending, count(*) filter (where analysis_status = 'done') as done, count(*) as total from c_images")
def a13_queue_status(c, read):
    return A.queue_status(c.images)


SYNC = f"""(select count(*) as total, count(last_synced_at) as ever_synced, count(*) - count(last_synced_at) as never_synced,
  count(*) filter (where is_favorite and (last_synced_at is null or last_synced_at < timestamp '{AS_OF}' - interval 7 day)) as favorites_due,
  count(*) filter (where last_synced_at < timestamp '{AS_OF}' - interval 30 day) as stale from c_entities)"""


@query(f"select * from {SYNC}")
def a14_sync_status(c, read):
    return A.sync_status(c.entities, AS_OF)


ARTICLE_COUNTS = """(select a.id, (coalesce(l.n, 0)) as entities, coalesce(i.n, 0) as images from c_articles a left join (select article_id, count(distinct entity_id) as n from c_links group by 1) l on l.article_id = a.id
  left join (select article_id, count(*) as n from c_images group by 1) i on i.article_id = a.id)"""


@query(f"select * from {ARTICLE_COUNTS}")
def a15_article_counts(c, read):
    return A.article_counts(c)


@query("select kb_id, count(*) as members from c_entities where kb_id is not null and kb_status is distinct from 'not_person' group by 1 having count(*) > 1")
def a16_same_kb_groups(c, read):
    return A.same_kb_groups(c.entities)


@query("select entity_id, string_agg(alias, ' ' order by alias) as alias_text from c_aliases group by 1")
def a17_alias_text(c, read):
    return A.alias_text(c.aliases)


def _vectors(read) -> DataFrame:
    status = F.when(F.col("vec_id") % 7 == 0, "flagged").when(F.col("vec_id") % 11 == 0, "human_flagged").when(F.col("vec_id") % 13 == 0, "manual").when(F.col("vec_id") % 3 == 0, "auto")
    return read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("entity_id"), F.col("embedding").alias("vector"), status.alias("association_status"), F.col("vec_id").alias("scraped_at"))


VECTORS = "(select vec_id as id, label::bigint as entity_id, embedding as vector, case when vec_id % 7 = 0 then 'flagged' when vec_id % 11 = 0 then 'human_flagged' when vec_id % 13 = 0 then 'manual' when vec_id % 3 = 0 then 'auto' end as association_status from embeddings)"
MEANS = f"(select entity_id, k, avg(vector[k]::double) as m, count(*) as n from {VECTORS}, (select unnest(range(1, 65)) as k) where association_status is null or association_status not in ('flagged', 'human_flagged') group by 1, 2)"
CENTROIDS = f"(select entity_id, list(m order by k) as v, sqrt(sum(m * m)) as size, max(n) as n from {MEANS} group by 1)"


@query(f"select entity_id, n as centroid_n, round(v[1] / size, 6) as x1, round(v[64] / size, 6) as x64 from {CENTROIDS}")
def a18_centroids(c, read):
    return A.centroids(_vectors(read)).select("entity_id", "centroid_n", F.round(F.col("centroid")[0], 6).alias("x1"), F.round(F.col("centroid")[63], 6).alias("x64"))


@query(f"select entity_id, count(*) as n, round(coalesce((select avg(hamming(x.b, y.b)) / 64 from {BITS} x join {BITS} y on x.id < y.id where x.entity_id = z.entity_id and y.entity_id = z.entity_id), 0), 4) as diversity from {BITS} z group by 1")
def a19_diversity(c, read):
    return S.diversity(_hashed(read))


@query("select entity_id, count(*) filter (where is_duplicate) as duplicates from c_images group by 1")
def a20_duplicate_count(c, read):
    return A.duplicate_count(c.images)


@query("select count(*) as entities, cast(sum(article_count) as bigint) as article_count, cast(sum(image_count) as bigint) as image_count, cast(sum(unique_image_count) as bigint) as unique_image_count from c_entities")
def a22_recompute_summary(c, read):
    return A.recompute_summary(c.entities)


@query(f"select entity_id, count(*) as active_days, cast(sum(n) as bigint) as total, max(n) as peak from {TIMELINE} group by 1")
def a23_timeline_summary(c, read):
    return A.timeline_summary(A.timeline(c, AS_OF))


@query("select count(distinct entity_id) as entities, count(*) filter (where association_status = 'confirmed') as confirmed, count(*) filter (where association_status = 'flagged') as flagged from c_images")
def a24_audit_summary(c, read):
    return A.audit_summary(c.images)


@query("""select entity_id, round(sum(w * vector[1]::double) / sum(w), 6) as x1 from (select *, 1.0 - 0.9 * (row_number() over (partition by entity_id order by id) - 1) / (count(*) over (partition by entity_id) - 1)::double as w from """ + VECTORS + ") group by 1")
def a25_composite_vector(c, read):
    return A.composite_vector(_vectors(read), "linear").select("entity_id", F.round(F.col("vector")[0], 6).alias("x1"))


# ---- windows and pages

RANKED = """(select kb_id, id, image_count, kb_score, row_number() over (partition by kb_id order by image_count desc nulls last, length(name) desc, first_seen asc nulls first, id) as place, count(*) over (partition by kb_id) as members
  from c_entities where kb_id is not null)"""


@query(f"select kb_id, id, cast(place as int) as place from {RANKED} where members > 1")
def w1_elect_canonical(c, read):
    return resolve.elect_canonical(c.entities).select("kb_id", "id", "place")


@query("""select loop, strftime(max(ts) filter (where kind = 'success'), '%Y-%m-%d %H:%M:%S') as last_success, strftime(max(ts) filter (where kind = 'error'), '%Y-%m-%d %H:%M:%S') as last_error,
  arg_max(summary, ts) filter (where kind = 'success') as last_summary from c_events where loop is not null and kind in ('success', 'error') group by 1""")
def w2_last_run(c, read):
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return A.last_run(c.events).select("loop", text("last_success"), text("last_error"), "last_summary")


@query("""select entity_id, cast(place as int) as place, id from (select entity_id, id, row_number() over (partition by entity_id order by scraped_at, id) as place from c_images
  where aligned_path is not null and is_duplicate = false and association_status is distinct from 'flagged') where place <= 24""")
def w5_contact_sheet(c, read):
    return A.contact_sheet(c.images)


@query("select l_orderkey as image_id, max(l_quantity * l_extendedprice) as area, count(*) as faces from lineitem group by 1")
def w6_primary_detection(c, read):
    boxes = read("lineitem").select(F.col("l_orderkey").alias("image_id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.col("l_extendedprice").alias("y2"))
    return A.primary_detection(boxes).select("image_id", (F.col("box.x2") * F.col("box.y2")).alias("area"), "faces")


@query("select kb_id, array_to_string(list(id order by image_count desc, name, id), ',') as members, cast(sum(image_count) as bigint) as images from c_entities where kb_id is not null group by 1")
def w7_ordered_members(c, read):
    return A.ordered_members(c.entities.filter("kb_id is not null"), "kb_id").select("kb_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "images")


REVIEW = """(select * from c_images where association_status in ('flagged', 'human_flagged') order by case when provider is null then 0 when provider <> 'feed' then 1 else 2 end, match_score desc nulls last, id limit 200)"""


REVIEW_TOTAL = "(select count(*) from c_images where association_status in ('flagged', 'human_flagged')) as total"


@query(f"select id, match_score, {REVIEW_TOTAL} from {REVIEW}")
def t1_review_queue(c, read):
    return T.review_queue(c.images, 500).select("id", "match_score", "total")


@query("select id, (select count(*) from c_articles) as total from c_articles order by published_at desc nulls last, scraped_at desc nulls last, id limit 50 offset 100")
def t2_article_page(c, read):
    return T.article_page(c.articles, 50, 100).select("id", "total")


@query("select id, name from c_entities where kb_status is distinct from 'not_person' order by name, id limit 40 offset 10")
def t3_entity_page(c, read):
    return T.entity_page(c.entities, 40, 10).select("id", "name")


@query("select id from c_entities where is_favorite and kb_status is distinct from 'not_person' order by image_count desc nulls last, name, id limit 100")
def t4_favorite_page(c, read):
    return T.favorite_page(c.entities).select("id")


NEXT = f"""(select id, tier from (select *, case when is_favorite and (last_synced_at is null or last_synced_at < timestamp '{AS_OF}' - interval 7 day) then 1 when last_synced_at is null then 2
  when last_synced_at < timestamp '{AS_OF}' - interval 30 day then 3 end as tier from c_entities) where tier is not null
  order by tier, case when tier < 3 then mentions end desc nulls last, case when tier = 3 then last_synced_at end, id limit {{n}})"""


@query(f"select * from {NEXT.format(n=60)}")
def t5_next_batch(c, read):
    return T.next_batch(c.entities, AS_OF, 60).select("id", "tier")


SURNAMES = """(select lower(trim(split_part(name, ',', 1))) as surname, list(id order by image_count desc, name, id) as members, cast(sum(image_count) as bigint) as images from c_entities
  where kb_status is distinct from 'not_person' group by 1 having count(*) > 1 order by images desc, surname limit 30)"""


@query(f"select surname, array_to_string(members, ',') as members, images from {SURNAMES}")
def t6_surname_groups(c, read):
    return T.surname_groups(c.entities).select("surname", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "images")


# Keys begin with a number of fixed width, so French order is that of the numbers.
@query("select id, name from c_entities where kb_status is distinct from 'not_person' order by regexp_extract(name, 'Supplier#[0-9]+'), id limit 200")
def t7_first_name_page(c, read):
    return T.first_name_page(c.entities).select("id", "name")


@query("select id from c_entities where kb_status <> 'not_person'")
def f2_live_strict(c, read):
    return P.live(c.entities, strict=True).select("id")


@query("select id, 'in' as side from c_images where association_status in ('flagged', 'manual') union all select id, 'out' from c_images where association_status not in ('flagged', 'manual')")
def f3_status_sets(c, read):
    return P.status_in(c.images, "flagged", "manual").select("id", F.lit("in").alias("side")).unionByName(P.status_not_in(c.images, "flagged", "manual").select("id", F.lit("out").alias("side")))


@query("select id, 'analysis' as kind from (select id from c_images where analysis_status = 'pending' order by id limit 40) union all select id, 'kb_done' from (select id from c_entities where kb_status = 'done' and kb_id is not null order by id limit 40)")
def f4_backlog(c, read):
    return P.backlog(c.images, "analysis", 40).select("id", F.lit("analysis").alias("kind")).unionByName(P.backlog(c.entities, "kb_done", 40).select("id", F.lit("kb_done").alias("kind")))


@query("select id from c_articles where published_at between date '1997-01-01' and date '1997-12-31'")
def f5_date_range(c, read):
    return P.date_range(c.articles, "1997-01-01", "1997-12-31").select("id")


@query("select id from c_images where coalesce(provider, 'feed') = 'feed'")
def f6_provider(c, read):
    return P.where_provider(c.images, "feed").select("id")


@query("select id from c_articles where domain = '1-URGENT' union all select id from c_entities where is_favorite")
def f6_domain_favorites(c, read):
    return P.where_domain(c.articles, "1-URGENT").select("id").unionByName(P.favorites(c.entities).select("id"))


@query("select id from c_images where starts_with(caption, 'View of R') or source_url ilike '%/17%.png%'")
def f7_demo_rows(c, read):
    return P.demo_rows(c.images, ["View of R"], "%/17%.png%").select("id")


# ---- joins

@query("select l.article_id, l.entity_id, a.domain, e.name from c_links l join c_articles a on a.id = l.article_id join c_entities e on e.id = l.entity_id")
def j1_article_mentions(c, read):
    return J.article_mentions(c).select("article_id", "entity_id", "domain", "name")


@query("""select i.id, e.name as entity_name, a.title as article_title, f.pose from c_images i left join c_entities e on e.id = i.entity_id
  left join c_articles a on a.id = i.article_id left join c_faces f on f.image_id = i.id""")
def j2_images_wide(c, read):
    return J.images_wide(c).select("id", "entity_name", "article_title", "pose")


@query("select id, title from c_articles where id in (select article_id from c_links where entity_id = 3)")
def j3_articles_of(c, read):
    return J.articles_of(c, 3).select("id", "title")


@query("select id from c_articles where not exists (select 1 from c_links where article_id = c_articles.id)")
def j4_orphan_articles(c, read):
    return J.orphan_articles(c).select("id")


@query("select a.entity_id as entity_a, b.entity_id as entity_b, count(*) as shared from c_links a join c_links b on a.article_id = b.article_id and a.entity_id < b.entity_id group by 1, 2")
def j5_cooccurrence(c, read):
    return J.cooccurrence(c.links)


@query("""select a.id, a.title, l.entity_id, e.name as entity_name from c_articles a left join (select article_id, min(entity_id) as entity_id from c_links group by 1) l on l.article_id = a.id
  left join c_entities e on e.id = l.entity_id""")
def j6_first_entity(c, read):
    return J.first_entity(c)


J7_SQL = """select i.id as image_id, arg_min(l.entity_id, l.entity_id) as entity_id from c_images i join c_links l on l.article_id = i.article_id join c_entities e on e.id = l.entity_id
  where contains(lower('for Nation' || (i.id % 25) || ', Supplier#00000000' || (i.id % 10) || ' ' || i.caption), lower(e.name)) group by 1"""


def _captioned(c: Corpus) -> DataFrame:
    text = F.concat(F.lit("for Nation"), (F.col("id") % 25).cast("string"), F.lit(", Supplier#00000000"), (F.col("id") % 10).cast("string"))
    return c.images.filter("article_id is not null").select(F.col("id").alias("image_id"), "article_id", text.alias("alt"), "caption")


@query(J7_SQL)
def j7_associate(c, read):
    own = c.links.select("article_id", "entity_id", F.col("entity_id").alias("entity_pos"))
    names = c.entities.select(F.col("id").alias("entity_id"), F.lit(0).alias("position"), F.col("name").alias("variant"))
    return J.associate(_captioned(c), own, names)


def _hashed(read) -> DataFrame:
    return read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("entity_id"), F.col("vec_id").alias("scraped_at"), V.median_bits(F.col("embedding")).alias("hash64"))


#: The 64 bits as text, first number first.
BITS = """(select vec_id as id, label::bigint as entity_id, array_to_string(list_transform(embedding, lambda x: case when x::double > list_sort(embedding[2:64])[32]::double then '1' else '0' end), '') as b from embeddings)"""


@query(f"select id, b as bits from {BITS}")
def v1_median_bits(c, read):
    bits = F.reverse(F.lpad(F.bin("hash64"), 64, "0"))
    return _hashed(read).select("id", bits.alias("bits"))


@query(f"select x.entity_id, x.id as a, y.id as b, cast(hamming(x.b, y.b) as int) as bits from {BITS} x join {BITS} y on x.entity_id = y.entity_id and x.id < y.id where hamming(x.b, y.b) <= 20")
def j8_hamming_pairs(c, read):
    return S.hamming_pairs(_hashed(read), 20)


@query("""select a.vec_id as a, b.vec_id as b, round(1 - list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)), 6) as distance
  from embeddings a join embeddings b on a.vec_id < b.vec_id
  where 1 - list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)) <= 0.6""")
def j9_vector_pairs(c, read):
    return S.vector_pairs(read("embeddings"), 0.6, "vec_id", "embedding").select("a", "b", F.round("distance", 6).alias("distance"))


@query("""select m.raw_name, coalesce(e.id, a.entity_id) as entity_id, case when s.kb_status = 'not_person' then 'rejected' when e.id is not null then 'slug' when a.entity_id is not null then 'alias' else 'new' end as outcome
  from (select c_name as raw_name from customer union all select s_name from supplier) m
  left join (select id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug from c_entities) e on e.slug = trim(regexp_replace(lower(m.raw_name), '[^a-z0-9]+', '-', 'g'), '-')
  left join (select alias, arg_max(entity_id, id) as entity_id from c_aliases group by 1) a on a.alias = m.raw_name
  left join c_entities s on s.id = coalesce(e.id, a.entity_id)""")
def j10_resolve_mentions(c, read):
    mentions = read("customer").select(F.col("c_name").alias("raw_name")).unionByName(read("supplier").select(F.col("s_name").alias("raw_name")))
    own = c.entities.withColumn("slug", F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return J.resolve_mentions(mentions, own, c.aliases).select("raw_name", "entity_id", "outcome")


@query("select i.id, d.source_url as canonical_url from (select id, case when is_duplicate then id - id % 100 + 1 end as of from c_images) i left join c_images d on d.id = i.of")
def j11_with_canonical(c, read):
    images = c.images.withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("id") - F.col("id") % 100 + 1))
    return J.with_canonical(images).select("id", "canonical_url")


@query("""select s_suppkey as key, array_to_string(list_filter([n.n_name, m.n_name], lambda x: x is not null), ',') as labels from supplier
  left join nation n on n.n_nationkey = s_nationkey left join nation m on m.n_nationkey = (s_nationkey + 7) % 30""")
def j12_labels(c, read):
    q = lambda x: F.concat(F.lit("Q"), x.cast("string"))
    ids = read("supplier").select(F.col("s_suppkey").alias("key"), F.array(q(F.col("s_nationkey")), q((F.col("s_nationkey") + 7) % 30)).alias("kb_ids"))
    labels = read("nation").select(q(F.col("n_nationkey")).alias("kb_id"), F.when(F.col("n_nationkey") % 2 == 0, "fr").otherwise("en").alias("lang"), F.col("n_name").alias("label"))
    return J.resolve_labels(ids, labels).select("key", F.array_join("labels", ",").alias("labels"))


@query("select id from c_images where aligned_path is not null and aligned_path not in (select 'a/' || p_partkey from part where p_size > 5)")
def j13_missing_files(c, read):
    manifest = read("part").filter("p_size > 5").select(F.concat(F.lit("a/"), F.col("p_partkey").cast("string")).alias("path"))
    return J.missing_files(c.images.withColumn("local_path", F.col("aligned_path")), manifest).select("id")


CLASH = """(select id, name, image_count as n from c_entities where kb_status is null or kb_status <> 'not_person')"""
J14_SQL = f"""select name as collision_on, case when f then id else owner end as first_id, case when f then owner else id end as second_id from (
  select a.id, a.name, o.owner, a.n > b.n or (a.n = b.n and a.name <= b.name) as f, row_number() over (partition by least(a.id, o.owner), greatest(a.id, o.owner) order by a.id) as k
  from {CLASH} a join (select alias, arg_max(entity_id, id) as owner from c_aliases group by 1) o on o.alias = a.name and o.owner <> a.id join {CLASH} b on b.id = o.owner) where k = 1"""


@query(J14_SQL)
def j14_alias_collisions(c, read):
    return J.alias_collisions(c.entities, c.aliases)


# ---- aggregates

COUNTS = """(select e.*, coalesce(i.n, 0) as images, coalesce(i.u, 0) as uniques, coalesce(l.n, 0) as articles, coalesce(e.first_seen, l.t) as seen from c_entities e
  left join (select entity_id, count(*) as n, count(*) filter (where is_duplicate = false) as u from c_images group by 1) i on i.entity_id = e.id
  left join (select entity_id, count(distinct article_id) as n, min(a.scraped_at) as t from c_links left join c_articles a on a.id = article_id group by 1) l on l.entity_id = e.id)"""


@query(f"select id, articles as article_count, images as image_count, uniques as unique_image_count, cast(cast(seen as date) as varchar) as first_seen from {COUNTS}")
def a1_a2_recompute_counts(c, read):
    return A.recompute_counts(c).select("id", "article_count", "image_count", "unique_image_count", F.col("first_seen").cast("date").cast("string").alias("first_seen"))


@query("""select entity_id, coalesce(f.pose, 'unknown') as pose, count(*) as n from c_images i left join c_faces f on f.image_id = i.id group by 1, 2
  union all select null, coalesce(f.pose, 'unknown'), count(*) from c_images i left join c_faces f on f.image_id = i.id group by 2""")
def a3_pose_distribution(c, read):
    return A.pose_distribution(c, per_entity=True).unionByName(A.pose_distribution(c).withColumn("entity_id", F.lit(None).cast("bigint")))


IMAGE_ARTICLES = "c_images i join c_articles a on a.id = i.article_id"


@query(f"select i.entity_id, a.domain, count(distinct i.id) as n from {IMAGE_ARTICLES} group by 1, 2")
def a4_source_distribution(c, read):
    return A.source_distribution(c)


@query(f"select i.entity_id, min(a.published_at)::varchar as first_day, max(a.published_at)::varchar as last_day from {IMAGE_ARTICLES} group by 1")
def a5_coverage_range(c, read):
    return A.coverage_range(c).select("entity_id", *date_text("first_day", "last_day"))


TIMELINE = f"(select l.entity_id, a.published_at as day, count(distinct l.article_id) as n from c_links l join c_articles a on a.id = l.article_id where a.published_at between date '{AS_OF}' - 365 and date '{AS_OF}' group by 1, 2)"


@query(f"select entity_id, day::varchar as day, n from {TIMELINE}")
def a6_timeline(c, read):
    return A.timeline(c, AS_OF).select("entity_id", *date_text("day"), "n")


@query(f"""select i.entity_id, printf('%04d-W%02d', isoyear(a.published_at), weekofyear(a.published_at)) as period, count(*) as n from {IMAGE_ARTICLES} where a.published_at is not null group by 1, 2""")
def a7_media_timeline(c, read):
    return A.media_timeline(c, "week")


@query("""select (select count(*) from c_entities) as entities, (select count(*) from c_articles) as articles, count(*) as images, count(aligned_path) as aligned,
  count(*) filter (where is_duplicate) as duplicates, round(count(aligned_path) / count(*)::double, 3) as alignment_rate from c_images""")
def a8_corpus_stats(c, read):
    return A.corpus_stats(c)


@query("select id, name, image_count from c_entities where kb_status is distinct from 'not_person' order by image_count desc nulls last, id limit 10")
def a8_top_entities(c, read):
    return A.top_entities(c.entities)


SORT_KEY = "(case when contains(name, ',') then trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) else name end)"


@query(f"select 'name' as by, {LETTER.format('name')} as letter, count(*) as n from c_entities where kb_status is distinct from 'not_person' group by 2 union all select 'first', {LETTER.format(SORT_KEY)}, count(*) from c_entities where kb_status is distinct from 'not_person' group by 2")
def a9_letter_histogram(c, read):
    return A.letter_histogram(c.entities).withColumn("by", F.lit("name")).unionByName(A.letter_histogram(c.entities, "first").withColumn("by", F.lit("first")))


@query(f"""select f.*, t.total, e.name, round(f.flagged / t.total::double, 3) as ratio from (select i.entity_id, count(*) as flagged, round(avg(match_score), 4) as mean_score, min(published_at)::varchar as first_day, max(published_at)::varchar as last_day
  from {IMAGE_ARTICLES} where association_status = 'flagged' and published_at between date '1996-01-01' and date '1999-12-31' group by 1) f
  join (select entity_id, count(*) as total from c_images group by 1) t on t.entity_id = f.entity_id join c_entities e on e.id = f.entity_id order by flagged desc, f.entity_id limit 20""")
def a10_flagged_by_period(c, read):
    return A.flagged_by_period(c, "1996-01-01", "1999-12-31").select("entity_id", "flagged", "mean_score", *date_text("first_day", "last_day"), "total", "name", "ratio")


GAUGES = """select (select count(*) from c_entities) as entities, (select count(*) from c_entities where kb_status = 'not_person') as tombstones, count(*) as images,
  count(*) filter (where association_status in ('flagged', 'human_flagged')) as flagged, round(count(*) filter (where association_status in ('flagged', 'human_flagged')) / count(*)::double, 6) as flagged_ratio from c_images"""


@query(GAUGES)
def a11_gauges(c, read):
    return A.gauges(c)


@query("select coalesce(provider, 'feed') as provider, count(*) as n from c_images group by 1")
def a12_by_provider(c, read):
    return A.by_provider(c.images)


@query("select count(*) filter (where scrape_status = 'downloaded') as downloaded, count(*) filter (where scrape_status = 'failed') as failed, count(*) filter (where analysis_status = 'pending') as pending, count(*) filter (where analysis_status = 'done') as done, count(*) as total from c_images")
def a13_queue_status(c, read):
    return A.queue_status(c.images)


SYNC = f"""(select count(*) as total, count(last_synced_at) as ever_synced, count(*) - count(last_synced_at) as never_synced,
  count(*) filter (where is_favorite and (last_synced_at is null or last_synced_at < timestamp '{AS_OF}' - interval 7 day)) as favorites_due,
  count(*) filter (where last_synced_at < timestamp '{AS_OF}' - interval 30 day) as stale from c_entities)"""


@query(f"select * from {SYNC}")
def a14_sync_status(c, read):
    return A.sync_status(c.entities, AS_OF)


ARTICLE_COUNTS = """(select a.id, (coalesce(l.n, 0)) as entities, coalesce(i.n, 0) as images from c_articles a left join (select article_id, count(distinct entity_id) as n from c_links group by 1) l on l.article_id = a.id
  left join (select article_id, count(*) as n from c_images group by 1) i on i.article_id = a.id)"""


@query(f"select * from {ARTICLE_COUNTS}")
def a15_article_counts(c, read):
    return A.article_counts(c)


@query("select kb_id, count(*) as members from c_entities where kb_id is not null and kb_status is distinct from 'not_person' group by 1 having count(*) > 1")
def a16_same_kb_groups(c, read):
    return A.same_kb_groups(c.entities)


@query("select entity_id, string_agg(alias, ' ' order by alias) as alias_text from c_aliases group by 1")
def a17_alias_text(c, read):
    return A.alias_text(c.aliases)


def _vectors(read) -> DataFrame:
    status = F.when(F.col("vec_id") % 7 == 0, "flagged").when(F.col("vec_id") % 11 == 0, "human_flagged").when(F.col("vec_id") % 13 == 0, "manual").when(F.col("vec_id") % 3 == 0, "auto")
    return read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("entity_id"), F.col("embedding").alias("vector"), status.alias("association_status"), F.col("vec_id").alias("scraped_at"))


VECTORS = "(select vec_id as id, label::bigint as entity_id, embedding as vector, case when vec_id % 7 = 0 then 'flagged' when vec_id % 11 = 0 then 'human_flagged' when vec_id % 13 = 0 then 'manual' when vec_id % 3 = 0 then 'auto' end as association_status from embeddings)"
MEANS = f"(select entity_id, k, avg(vector[k]::double) as m, count(*) as n from {VECTORS}, (select unnest(range(1, 65)) as k) where association_status is null or association_status not in ('flagged', 'human_flagged') group by 1, 2)"
CENTROIDS = f"(select entity_id, list(m order by k) as v, sqrt(sum(m * m)) as size, max(n) as n from {MEANS} group by 1)"


@query(f"select entity_id, n as centroid_n, round(v[1] / size, 6) as x1, round(v[64] / size, 6) as x64 from {CENTROIDS}")
def a18_centroids(c, read):
    return A.centroids(_vectors(read)).select("entity_id", "centroid_n", F.round(F.col("centroid")[0], 6).alias("x1"), F.round(F.col("centroid")[63], 6).alias("x64"))


@query(f"select entity_id, count(*) as n, round(coalesce((select avg(hamming(x.b, y.b)) / 64 from {BITS} x join {BITS} y on x.id < y.id where x.entity_id = z.entity_id and y.entity_id = z.entity_id), 0), 4) as diversity from {BITS} z group by 1")
def a19_diversity(c, read):
    return S.diversity(_hashed(read))


@query("select entity_id, count(*) filter (where is_duplicate) as duplicates from c_images group by 1")
def a20_duplicate_count(c, read):
    return A.duplicate_count(c.images)


@query("select count(*) as entities, cast(sum(article_count) as bigint) as article_count, cast(sum(image_count) as bigint) as image_count, cast(sum(unique_image_count) as bigint) as unique_image_count from c_entities")
def a22_recompute_summary(c, read):
    return A.recompute_summary(c.entities)


@query(f"select entity_id, count(*) as active_days, cast(sum(n) as bigint) as total, max(n) as peak from {TIMELINE} group by 1")
def a23_timeline_summary(c, read):
    return A.timeline_summary(A.timeline(c, AS_OF))


@query("select count(distinct entity_id) as entities, count(*) filter (where association_status = 'confirmed') as confirmed, count(*) filter (where association_status = 'flagged') as flagged from c_images")
def a24_audit_summary(c, read):
    return A.audit_summary(c.images)


@query("""select entity_id, round(sum(w * vector[1]::double) / sum(w), 6) as x1 from (select *, 1.0 - 0.9 * (row_number() over (partition by entity_id order by id) - 1) / (count(*) over (partition by entity_id) - 1)::double as w from """ + VECTORS + ") group by 1")
def a25_composite_vector(c, read):
    return A.composite_vector(_vectors(read), "linear").select("entity_id", F.round(F.col("vector")[0], 6).alias("x1"))


# ---- windows and pages

RANKED = """(select kb_id, id, image_count, kb_score, row_number() over (partition by kb_id order by image_count desc nulls last, length(name) desc, first_seen asc nulls first, id) as place, count(*) over (partition by kb_id) as members
  from c_entities where kb_id is not null)"""


@query(f"select kb_id, id, cast(place as int) as place from {RANKED} where members > 1")
def w1_elect_canonical(c, read):
    return resolve.elect_canonical(c.entities).select("kb_id", "id", "place")


@query("""select loop, strftime(max(ts) filter (where kind = 'success'), '%Y-%m-%d %H:%M:%S') as last_success, strftime(max(ts) filter (where kind = 'error'), '%Y-%m-%d %H:%M:%S') as last_error,
  arg_max(summary, ts) filter (where kind = 'success') as last_summary from c_events where loop is not null and kind in ('success', 'error') group by 1""")
def w2_last_run(c, read):
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return A.last_run(c.events).select("loop", text("last_success"), text("last_error"), "last_summary")


@query("""select entity_id, cast(place as int) as place, id from (select entity_id, id, row_number() over (partition by entity_id order by scraped_at, id) as place from c_images
  where aligned_path is not null and is_duplicate = false and association_status is distinct from 'flagged') where place <= 24""")
def w5_contact_sheet(c, read):
    return A.contact_sheet(c.images)


@query("select l_orderkey as image_id, max(l_quantity * l_extendedprice) as area, count(*) as faces from lineitem group by 1")
def w6_primary_detection(c, read):
    boxes = read("lineitem").select(F.col("l_orderkey").alias("image_id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.col("l_extendedprice").alias("y2"))
    return A.primary_detection(boxes).select("image_id", (F.col("box.x2") * F.col("box.y2")).alias("area"), "faces")


@query("select kb_id, array_to_string(list(id order by image_count desc, name, id), ',') as members, cast(sum(image_count) as bigint) as images from c_entities where kb_id is not null group by 1")
def w7_ordered_members(c, read):
    return A.ordered_members(c.entities.filter("kb_id is not null"), "kb_id").select("kb_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "images")


REVIEW = """(select * from c_images where association_status in ('flagged', 'human_flagged') order by case when provider is null then 0 when provider <> 'feed' then 1 else 2 end, match_score desc nulls last, id limit 200)"""


REVIEW_TOTAL = "(select count(*) from c_images where association_status in ('flagged', 'human_flagged')) as total"


@query(f"select id, match_score, {REVIEW_TOTAL} from {REVIEW}")
def t1_review_queue(c, read):
    return T.review_queue(c.images, 500).select("id", "match_score", "total")


@query("select id, (select count(*) from c_articles) as total from c_articles order by published_at desc nulls last, scraped_at desc nulls last, id limit 50 offset 100")
def t2_article_page(c, read):
    return T.article_page(c.articles, 50, 100).select("id", "total")


@query("select id, name from c_entities where kb_status is distinct from 'not_person' order by name, id limit 40 offset 10")
def t3_entity_page(c, read):
    return T.entity_page(c.entities, 40, 10).select("id", "name")


@query("select id from c_entities where is_favorite and kb_status is distinct from 'not_person' order by image_count desc nulls last, name, id limit 100")
def t4_favorite_page(c, read):
    return T.favorite_page(c.entities).select("id")


NEXT = f"""(select id, tier from (select *, case when is_favorite and (last_synced_at is null or last_synced_at < timestamp '{AS_OF}' - interval 7 day) then 1 when last_synced_at is null then 2
  when last_synced_at < timestamp '{AS_OF}' - interval 30 day then 3 end as tier from c_entities) where tier is not null
  order by tier, case when tier < 3 then mentions end desc nulls last, case when tier = 3 then last_synced_at end, id limit {{n}})"""


@query(f"select * from {NEXT.format(n=60)}")
def t5_next_batch(c, read):
    return T.next_batch(c.entities, AS_OF, 60).select("id", "tier")


SURNAMES = """(select lower(trim(split_part(name, ',', 1))) as surname, list(id order by image_count desc, name, id) as members, cast(sum(image_count) as bigint) as images from c_entities
  where kb_status is distinct from 'not_person' group by 1 having count(*) > 1 order by images desc, surname limit 30)"""


@query(f"select surname, array_to_string(members, ',') as members, images from {SURNAMES}")
def t6_surname_groups(c, read):
    return T.surname_groups(c.entities).select("surname", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "images")


@query()
def t7_first_name_page(c, read):
    return T.first_name_page(c.entities).select("id", "name")


@query("select id from c_entities where kb_status <> 'not_person' order by image_count desc nulls last, id limit 500")
def t8_full_listing(c, read):
    return T.full_listing(c.entities).select("id")


# ---- maintenance

#: A merge for every seventh entity, in short chains.
EDGES = "(select id as duplicate_id, id - id % 7 as canonical_id from c_entities where id % 7 in (3, 5))"


def _edges(c: Corpus) -> DataFrame:
    return c.entities.filter("id % 7 in (3, 5)").select(F.col("id").alias("duplicate_id"), (F.col("id") - F.col("id") % 7).alias("canonical_id"))


@query(f"select distinct l.article_id, coalesce(m.canonical_id, l.entity_id) as entity_id from c_links l left join {EDGES} m on m.duplicate_id = l.entity_id")
def u1_merged_links(c, read):
    return resolve.merged_links(c.links, _edges(c)).select("article_id", "entity_id")


@query(f"""select distinct coalesce(m.canonical_id, a.entity_id) as entity_id, a.alias from c_aliases a left join {EDGES} m on m.duplicate_id = a.entity_id
  union select m.canonical_id, e.name from {EDGES} m join c_entities e on e.id = m.duplicate_id""")
def u2_merged_aliases(c, read):
    return resolve.merged_aliases(c.aliases, c.entities, _edges(c)).select("entity_id", "alias")


@query(f"""select e.id, (select count(*) from c_images i left join {EDGES} m on m.duplicate_id = i.entity_id where coalesce(m.canonical_id, i.entity_id) = e.id) as image_count,
  (select count(distinct article_id) from c_links l left join {EDGES} m on m.duplicate_id = l.entity_id where coalesce(m.canonical_id, l.entity_id) = e.id) as article_count
  from c_entities e where e.id not in (select duplicate_id from {EDGES})""")
def m5_apply_merges(c, read):
    return resolve.apply_merges(c, _edges(c)).entities.select("id", "image_count", "article_count")


BLOCKED = f"""(select d.kb_id, f.id as canonical_id, d.id as duplicate_id, case when f.image_count > 0 and (f.image_count + d.image_count) / f.image_count::double > 1.5 then 'growth'
  when f.kb_score is null or f.kb_score < 1 then 'canonical_score' when d.kb_score is null or d.kb_score < 1 then 'duplicate_score' end as reason
  from {RANKED} d join {RANKED} f on f.kb_id = d.kb_id and f.place = 1 where d.place > 1)"""


@query(f"select * from {BLOCKED} where reason is not null")
def m7_blocked_merges(c, read):
    return resolve.blocked_merges(c.entities)


@query("""select kb_id, canonical_id, duplicate_id, reason is null as merge, reason from (
  with recursive r as (select kb_id, id, image_count as n, kb_score as s, row_number() over (partition by kb_id order by image_count desc nulls last, length(name) desc, first_seen asc nulls first, id) as place from c_entities where kb_id is not null),
  f as (select kb_id, id as canonical_id, s as cs, n as grown, cast(1 as bigint) as place, cast(null as bigint) as duplicate_id, cast(null as varchar) as reason from r where place = 1
    union all
    select kb_id, canonical_id, cs, case when why is null then grown + n else grown end, place, id, why from (
      select f.kb_id, f.canonical_id, f.cs, f.grown, r.n, r.place, r.id, case when f.grown > 0 and (f.grown + r.n) / f.grown::double > 1.5 then 'growth' when f.cs is null or f.cs < 1 then 'canonical_score'
        when r.s is null or r.s < 1 then 'duplicate_score' end as why from f join r on r.kb_id = f.kb_id and r.place = f.place + 1))
  select * from f where duplicate_id is not null)""")
def m6_plan_kb_merges(c, read):
    return resolve.plan_kb_merges(c.entities)


@query("select id, case when id % 5 = 0 and entity_id <> 2 then 2 else entity_id end as entity_id, case when id % 5 = 0 and entity_id <> 2 then 'manual' else association_status end as association_status, case when id % 5 = 0 and entity_id <> 2 then null else match_score end as match_score from c_images")
def m10_reassign(c, read):
    decisions = c.images.filter("id % 5 = 0").select("id", F.lit(2).cast("bigint").alias("entity_id"))
    return L.apply_reassign(c.images, decisions).select("id", "entity_id", "association_status", "match_score")


@query("""select e.id, count(i.id) as image_count, count(i.id) filter (where i.is_duplicate = false) as unique_image_count from c_entities e
  left join (select id, is_duplicate, case when id % 5 = 0 then 2 else entity_id end as entity_id from c_images) i on i.entity_id = e.id group by 1""")
def m10_reassign_counts(c, read):
    decisions = c.images.filter("id % 5 = 0").select("id", F.lit(2).cast("bigint").alias("entity_id"))
    return L.reassign(c, decisions).entities.select("id", "image_count", "unique_image_count")


@query("""with gone as (select id from c_entities where id % 10 = 1 and kb_status is distinct from 'not_person')
  select e.id, count(i.id) as image_count from c_entities e left join (select id, case when entity_id in (select id from gone) then 2 else entity_id end as entity_id from c_images) i on i.entity_id = e.id
  where e.id not in (select id from gone) group by 1""".replace("with gone", "select * from (with gone", 1) + ")")
def m9_merge_manual(c, read):
    asked = c.entities.filter("id % 10 = 1").select(F.lit(2).cast("bigint").alias("canonical_id"), F.col("id").alias("duplicate_id"))
    other = c.entities.filter("id = 3").select(F.col("id").alias("canonical_id"), F.explode(F.array(F.col("id"), F.lit(-7).cast("bigint"))).alias("duplicate_id"))
    return resolve.merge_manual(c, asked.unionByName(other))[0].entities.select("id", "image_count")


@query("select id, case when id in (select doc_id * 100 + 1 from labels where quality = 0) and (association_status is null or association_status not in ('flagged', 'human_flagged')) then 'human_flagged' else association_status end as association_status from c_images")
def m11_flags(c, read):
    ids = read("labels").filter("quality = 0").select((F.col("doc_id") * 100 + 1).alias("id"))
    return L.apply_flags(c.images, ids).select("id", "association_status")


@query("select id, case when id in (select doc_id * 100 + 1 from labels where quality = 1) then 'manual' else association_status end as association_status from c_images")
def m12_confirms(c, read):
    ids = read("labels").filter("quality = 1").select((F.col("doc_id") * 100 + 1).alias("id"))
    return L.apply_confirms(c.images, ids).select("id", "association_status")


@query("select e.id, count(i.id) as image_count from c_entities e left join (select * from c_images where id not in (select doc_id * 100 + 1 from labels where toxic = 1)) i on i.entity_id = e.id group by 1")
def m13_delete_images(c, read):
    ids = read("labels").filter("toxic = 1").select((F.col("doc_id") * 100 + 1).alias("id"))
    return L.delete_images(c, ids).entities.select("id", "image_count")


@query("""select 'entities' as what, count(*) as n from c_entities where id % 10 = 4 union all select 'aliases', count(*) from c_aliases where entity_id in (select id from c_entities where id % 10 = 4)
  union all select 'links', count(*) from c_links where entity_id % 10 = 4 union all select 'images', count(*) from c_images where entity_id % 10 = 4
  union all select 'faces', count(*) from c_faces where image_id in (select id from c_images where entity_id % 10 = 4)
  union all select 'orphans', count(*) from (select article_id from c_links group by 1 having bool_and(entity_id % 10 = 4))""")
def m14_erasure(c, read):
    return L.erase_entities(c, c.entities.filter("id % 10 = 4").select("slug"))[1]


@query("select id, case when id % 6 = 1 then 'not_person' else kb_status end as kb_status, case when id % 6 = 1 then 0 else image_count end as image_count, case when id % 6 = 1 then false else is_favorite end as is_favorite, case when id % 6 <> 1 then summary end as summary from c_entities")
def m15_purge(c, read):
    return L.purge_not_person(c, c.entities.filter("id % 6 = 1").select("id")).entities.select("id", "kb_status", "image_count", "is_favorite", "summary")


@query("""select id, case when scrape_status = 'failed' then 'scrape_failed' else 'missing_file' end as reason from c_images
  where scrape_status = 'failed' or (aligned_path is not null and aligned_path not in (select 'a/' || p_partkey from part where p_size > 5))""")
def m17_invalid_images(c, read):
    manifest = read("part").filter("p_size > 5").select(F.concat(F.lit("a/"), F.col("p_partkey").cast("string")).alias("path"))
    return L.invalid_images(c.images.withColumn("local_path", F.col("aligned_path")), manifest)


@query("select id, case when contains(caption, 'RO') and not contains(caption, 'View') then 101 when contains(caption, 'AF') then 102 end::bigint as target_id, not (contains(caption, 'RO') and not contains(caption, 'View')) and not contains(caption, 'AF') and contains(caption, 'View') and contains(caption, 'N') as ambiguous from c_images where entity_id = 5")
def m19_split_images(c, read):
    return resolve.split_images(c.images, 5, [(101, ["RO"], ["View"]), (102, ["AF"], [])], [["View"], ["N"]])


@query("select id, case when id % 4 = 0 then false when id % 4 = 1 and kb_status is distinct from 'not_person' then true else is_favorite end as is_favorite from c_entities")
def m20_favorites(c, read):
    return L.set_favorites(c.entities, c.entities.filter("id % 4 < 2").select("id", (F.col("id") % 4 == 1).alias("favorite"))).select("id", "is_favorite")


@query("""select (select count(*) from c_images where starts_with(caption, 'View of R')) as images,
  (select count(*) from (select article_id from c_images where article_id is not null group by 1 having bool_and(starts_with(caption, 'View of R')))) as articles""")
def m21_cleanup_demo(c, read):
    return L.cleanup_demo(c, ["View of R"], "nothing")[1]


@query(f"select id, strftime(case when id % 3 = 0 then timestamp '{AS_OF}' else last_synced_at end, '%Y-%m-%d') as last_synced_at from c_entities")
def m22_mark_synced(c, read):
    return L.mark_synced(c.entities, c.entities.filter("id % 3 = 0"), AS_OF).select("id", F.date_format("last_synced_at", "yyyy-MM-dd").alias("last_synced_at"))


@query("select image_id, coalesce(face_count, greatest(1, image_id % 3)) as face_count from c_faces")
def m23_backfill_faces(c, read):
    faces = c.faces.withColumn("mesh", F.lit(None).cast("array<struct<x:float,y:float>>"))
    marks = c.faces.select("image_id", F.lit(None).cast("array<struct<x:float,y:float>>").alias("mesh"), (F.col("image_id") % 3).alias("n"))
    return L.backfill_faces(faces, marks).select("image_id", "face_count")


@query("select id, case when id % 5 > 0 then id % 5 else mentions end as mentions from c_entities")
def m24_refresh_mentions(c, read):
    return L.refresh_mentions(c.entities, c.entities.select("slug", (F.col("id") % 5).alias("mentions"))).select("id", "mentions")


@query("""select slug, case when count(*) > 0 then min(name) end as name from (select trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as s, p_name from part), lateral (select
  trim(regexp_replace(lower(split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1)), '[^a-z0-9]+', '-', 'g'), '-') as slug, split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) as name) group by 1""")
def m1_upsert_entities(c, read):
    mentions = read("part").select(F.col("p_name").alias("raw_name"), F.col("p_brand").alias("source"))
    after, _, _ = L.upsert_entities(mentions, c.entities, c.aliases, AS_OF)
    return after.join(c.entities.select("id"), "id", "left_anti").select("slug", "name")


@query("select url, min(title) as title from (select 'https://o.example/' || (l_orderkey % 1000) as url, 'T' || l_linenumber as title from lineitem) where url not in (select url from c_articles) group by 1")
def m2_upsert_articles(c, read):
    rows = read("lineitem").select(F.concat(F.lit("https://o.example/"), (F.col("l_orderkey") % 1000).cast("string")).alias("url"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("title"), F.lit(None).cast("date").alias("published_at"))
    return L.upsert_articles(rows, c.articles).join(c.articles.select("id"), "id", "left_anti").select("url", "title")


@query("select article_id, entity_id from c_links union select o_orderkey, o_custkey % 100 from orders")
def m3_upsert_links(c, read):
    return L.upsert_links(read("orders").select(F.col("o_orderkey").alias("article_id"), (F.col("o_custkey") % 100).alias("entity_id")), c.links).select("article_id", "entity_id")


VARIANTS_SQL = J7_SQL.replace("join c_entities e on e.id = l.entity_id", "join (select id, name from c_entities union all select entity_id, alias from c_aliases) e on e.id = l.entity_id")


@query(f"""select i.id as image_id, coalesce(n.entity_id, o.entity_id) as entity_id, case when n.entity_id is not null then 'named' when o.entity_id is not null then 'only_person' else 'ignored' end as outcome
  from c_images i left join ({VARIANTS_SQL}) n on n.image_id = i.id left join (select article_id, min(entity_id) as entity_id from c_links group by 1 having count(distinct entity_id) = 1) o on o.article_id = i.article_id where i.article_id is not null""")
def m4_attribute_images(c, read):
    own = c.links.select("article_id", "entity_id", F.col("entity_id").alias("entity_pos"))
    return L.attribute_images(_captioned(c), own, c.entities, c.aliases)


@query("select count(*) as n, count(distinct source_url) as urls from (select source_url from c_images union all select distinct 'https://img.example/' || p_partkey || '/2.jpeg' as u from part where 'https://img.example/' || p_partkey || '/2.jpeg' not in (select source_url from c_images))")
def s8_append_images(c, read):
    new = read("part").select(F.concat(F.lit("https://img.example/"), F.col("p_partkey").cast("string"), F.lit("/2.jpeg")).alias("source_url"))
    return L.append_images(c.images, new, "web").agg(F.count("*").alias("n"), F.countDistinct("source_url").alias("urls"))


# ---- similarity

V2_SQL = f"""select entity_id, id, of is not null as is_duplicate, of as duplicate_of from (
  with recursive b as (select *, row_number() over (partition by entity_id order by id) as k from {BITS}),
  f as (select entity_id, id, k, cast(null as bigint) as of, [{{'i': id, 'b': b}}] as leaders from b where k = 1
    union all
    select entity_id, id, k, of, case when of is null then list_append(leaders, {{'i': id, 'b': b}}) else leaders end from (
      select b.entity_id, b.id, b.k, b.b, f.leaders, list_filter(f.leaders, lambda l: hamming(l.b, b.b) <= 22)[1].i as of from f join b on b.entity_id = f.entity_id and b.k = f.k + 1))
  select * from f)"""


@query(V2_SQL)
def v2_mark_duplicates(c, read):
    return S.mark_duplicates(_hashed(read), 22)


@query(V2_SQL)
def v2_mark_duplicates_large(c, read):
    return S.mark_duplicates_large(_hashed(read), 22)


@query(V2_SQL.replace("<= 22", "<= 5"))
def v2_mark_duplicates_five_bits(c, read):
    return S.mark_duplicates_large(_hashed(read), 5)


@query(f"select entity_id, count(*) as items, count(*) filter (where not is_duplicate) as uniques, count(*) filter (where is_duplicate) as duplicates from ({V2_SQL}) group by 1")
def v3_dedup_totals(c, read):
    rows = _hashed(read)
    return S.dedup_groups(rows, S.mark_duplicates_large(rows, 22)).select("entity_id", "items", "uniques", "duplicates")


UNIQUE = f"(select b.* from {BITS} b join ({V2_SQL}) v on v.id = b.id and not v.is_duplicate)"


@query(f"select entity_id, count(*) as n, round(coalesce((select avg(hamming(x.b, y.b)) / 64 from {UNIQUE} x join {UNIQUE} y on x.id < y.id where x.entity_id = z.entity_id and y.entity_id = z.entity_id), 0), 4) as diversity from {UNIQUE} z group by 1")
def a19_diversity_unique(c, read):
    rows = _hashed(read)
    return S.dedup_groups(rows, S.mark_duplicates_large(rows, 22)).select("entity_id", F.col("uniques").alias("n"), "diversity")


SIMHASH = "(select doc_id as id, source as entity_id, concat(" + ", ".join(f"case when sum((h >> {i}) & 1) * 2 > count(*) then '1' else '0' end" for i in range(64)) + r""") as b from (
  select doc_id, source, ('0x' || substr(md5(term), 1, 16))::ubigint as h from (
    select doc_id, source, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from documents)) group by all)"""
DOCUMENTS_SQL = V2_SQL.replace(BITS, SIMHASH).replace("<= 22", "<= 5").replace("b.entity_id = f.entity_id", "b.entity_id is not distinct from f.entity_id")


def _documents_hashed(read) -> DataFrame:
    docs = read("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("entity_id"), F.col("doc_id").alias("scraped_at"), "text")
    return snapshot(S.simhashes(docs, ["id", "entity_id", "scraped_at"], "text", S.md5_64))  # read more than once


@query(DOCUMENTS_SQL)
def v3_dedup_documents(c, read):
    return S.mark_duplicates_large(_documents_hashed(read), 5)


@query(f"select entity_id, count(*) as items, count(*) filter (where not is_duplicate) as uniques, count(*) filter (where is_duplicate) as duplicates from ({DOCUMENTS_SQL}) group by 1")
def v3_dedup_document_totals(c, read):
    rows = _documents_hashed(read)
    return S.dedup_groups(rows, S.mark_duplicates_large(rows, 5)).select("entity_id", "items", "uniques", "duplicates")


@query(f"""select v.id, v.entity_id, round(d, 4) as match_score, case when d <= 0.9 then 'confirmed' else 'flagged' end as association_status from (
  select v.id, v.entity_id, 1 - list_sum(list_transform(range(1, 65), lambda i: v.vector[i]::double * c.v[i] / c.size)) as d from {VECTORS} v join {CENTROIDS} c on c.entity_id = v.entity_id
  where v.association_status is null or v.association_status not in ('manual', 'human_flagged')) v""")
def v4_audit(c, read):
    rows = _vectors(read)
    return S.audit(rows, A.centroids(rows), 0.9)


V5_SQL = """select case when s then b else a end as canonical_id, case when s then a else b end as duplicate_id, round(d, 4) as distance, why is null as can_auto, why as reason from (
  select a, b, d, nb > na as s, case when d > 0.2 then 'distance' when greatest(na, nb) > 0 and (na + nb) / greatest(na, nb)::double > 1.5 then 'growth' end as why from (
    select a.vec_id as a, b.vec_id as b, a.vec_id * 7 % 40 as na, b.vec_id * 7 % 40 as nb, 1 - list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)) as d
    from embeddings a join embeddings b on a.vec_id < b.vec_id and (a.label % 5 = 0 or b.label % 5 = 0 or a.label <> b.label) where a.vec_id * 7 % 40 >= 5 and b.vec_id * 7 % 40 >= 5 and a.vec_id % 9 <> 4 and b.vec_id % 9 <> 4) where d <= 0.65)"""


def _with_centroids(read) -> DataFrame:
    return read("embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 5 > 0, F.concat(F.lit("Q"), F.col("label").cast("string"))).alias("kb_id"), F.when(F.col("vec_id") % 9 == 4, "not_person").otherwise("done").alias("kb_status"), (F.col("vec_id") * 7 % 40).alias("image_count"), F.col("embedding").alias("centroid"))


@query(V5_SQL)
def v5_v6_candidate_pairs(c, read):
    return S.candidate_pairs(_with_centroids(read), 0.65)


@query(f"""with recursive p as (select canonical_id as c, duplicate_id as d, distance as x, row_number() over (order by distance, canonical_id, duplicate_id) as k from ({V5_SQL.replace("d > 0.2", "d > 0.65")}) where can_auto),
  f as (select 0::bigint as k, null::bigint as c, null::bigint as d, null::double as x, false as taken, []::bigint[] as gone
    union all select k, c, d, x, free, case when free then list_append(gone, d) else gone end from (
      select p.*, f.gone, not list_contains(f.gone, p.c) and not list_contains(f.gone, p.d) as free from f join p on p.k = f.k + 1))
  select c as canonical_id, d as duplicate_id, x as distance from f where taken""")
def m8_plan_centroid_merges(c, read):
    return resolve.plan_centroid_merges(S.candidate_pairs(_with_centroids(read), 0.65, auto_distance=0.65), 0.65)


@query("""select i.id, i.match_score, case when f.face_count > 1 then 'composition' when f.face_count = 1 then 'misattribution' else 'unknown' end as hypothesis from c_images i left join c_faces f on f.image_id = i.id
  where association_status = 'flagged' order by match_score desc nulls last, i.id limit 50""")
def v7_flagged_images(c, read):
    return S.flagged_images(J.images_wide(c)).select("id", "match_score", "hypothesis")


# ---- search

def _scope(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return X.build_index(docs)


def _standing(read, name: str = "documents", key: str = "doc_id") -> I.Index:
    """The standing index of a table's texts: the first query over the table builds it, later ones open it."""
    return I.standing_index(X.documents(read(name), ["text"], key), read(name), name)


TERMS = r"(select doc_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from documents)"


@query(f"select term, count(*) as n, count(distinct doc_id) as docs from {TERMS} group by 1")
def x1_postings(c, read):
    docs = read("documents")
    return I.vocabulary(docs.sparkSession, _standing(read))


@query(f"select doc_id from {TERMS} group by 1 having bool_or(starts_with(term, 'thea')) and bool_or(starts_with(term, 'he'))")
def x2_match(c, read):
    return I.matches(read("documents").sparkSession, _standing(read), "Théa he*").select("doc_id")


BM25 = f"""(with t as (select * from {TERMS}), len as (select doc_id, count(t.term) as l from documents left join t using (doc_id) group by 1), st as (select count(*) as docs, avg(l) as mean from len),
  h as (select doc_id, 0 as q, count(*) as tf from t where starts_with(term, 'thea') group by 1 union all select doc_id, 1, count(*) from t where starts_with(term, 'he') group by 1),
  w as (select * from h where doc_id in (select doc_id from h group by 1 having count(*) = 2)), df as (select q, count(*) as df from w group by 1)
  select doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) as score from w join df using (q) join len using (doc_id), st group by 1)"""


@query(f"select doc_id, round(score, 6) as score from {BM25}")
def x3_rank(c, read):
    return I.full_ranking(read("documents").sparkSession, _standing(read), "thea he").select("doc_id", F.round("score", 6).alias("score"))


@query(f"select doc_id, round(score, 6) as score from (select * from {BM25} order by score desc, doc_id limit 10)")
def x3_top(c, read):
    return I.top(read("documents").sparkSession, _standing(read), "thea he", 10).hits.select("doc_id", F.round("score", 6).alias("score"))


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
MASK = r"list_filter(regexp_split_to_array(lower(strip_accents(w[i + 1])), '[^\p{L}\p{N}]+'), lambda x: starts_with(x, 'PREFIX'))"


@query(f"""with w as (select doc_id, text, {WORDS} as w from documents),
  h as (select doc_id, text, w, list_filter(list_transform(range(len(w)), lambda i: {{'p': i, 'a': len({MASK.replace('PREFIX', 'thea')}) > 0, 'b': len({MASK.replace('PREFIX', 'he')}) > 0}}), lambda x: x.a or x.b) as h from w),
  r as (select doc_id, text, w, h, list_sort(list_transform(range(1, len(h) + 1), lambda k: {{
    's': -(999 * (cast(len(list_filter(h[k:k + 11], lambda x: x.p < h[k].p + 12 and x.a)) > 0 as int) + cast(len(list_filter(h[k:k + 11], lambda x: x.p < h[k].p + 12 and x.b)) > 0 as int))
      + len(list_filter(h[k:k + 11], lambda x: x.p < h[k].p + 12 and x.a)) + len(list_filter(h[k:k + 11], lambda x: x.p < h[k].p + 12 and x.b))),
    'f': h[k].p, 'l': list_filter(h[k:k + 11], lambda x: x.p < h[k].p + 12)[-1].p}}))[1] as best from h),
  c as (select doc_id, text, w, h, case when best is null then 0 else greatest(0, least(best.f - cast(floor((12 - (best.l - best.f)) / 2.0) as bigint), len(w) - 12)) end as s from r),
  m as (select *, list_transform(h, lambda x: x.p) as p from c)
  select doc_id, case when text is null then null else (case when s > 0 then '…' else '' end)
    || array_to_string(list_transform(range(s, least(s + 12, len(w))), lambda i: case when list_contains(p, i) then '<mark>' || w[i + 1] || '</mark>' else w[i + 1] end), ' ') || (case when len(w) > s + 12 then '…' else '' end) end as snippet from m""")
def x4_snippet(c, read):
    return read("documents").select("doc_id", X.snippet(F.col("text"), "thea he").alias("snippet"))


@query(f"select 'documents' as scope, doc_id, round(score, 6) as score, (select count(*) from {BM25}) as total from (select * from {BM25} order by score desc, doc_id limit 20)")
def x5_x6_search(c, read):
    scopes = {"documents": lambda: _standing(read), "benchmark": lambda: _standing(read, "benchmark", "item_id")}
    return I.search_index(read("documents").sparkSession, scopes, "thea he", "documents").withColumn("score", F.round("score", 6))


BENCHMARK = BM25.replace("from documents)", "from (select item_id as doc_id, text from benchmark))").replace("from documents left join", "from (select item_id as doc_id from benchmark) left join")


@query(f"""select 'documents' as scope, doc_id, round(score, 6) as score, (select count(*) from {BM25}) as total from (select * from {BM25} order by score desc, doc_id limit 5)
  union all select 'benchmark', doc_id, round(score, 6), (select count(*) from {BENCHMARK}) from (select * from {BENCHMARK} order by score desc, doc_id limit 5)""")
def x6_all_scopes(c, read):
    scopes = {"documents": lambda: _standing(read), "benchmark": lambda: _standing(read, "benchmark", "item_id")}
    return I.search_index(read("documents").sparkSession, scopes, "thea he", limit=5).withColumn("score", F.round("score", 6))


@query("""select 'entities' as scope, count(*) as total from c_entities where kb_status is distinct from 'not_person' and regexp_matches(lower(name), 'nation1')
  union all select 'articles', count(*) from c_articles where regexp_matches(title, 'Order 1') or starts_with(domain, '1') union all select 'images', count(*) from c_images where regexp_matches(caption, '^Portrait')""")
def x5_totals(c, read):
    found = [X.global_search(c, q, scope, 5).groupBy("scope").agg(F.max("total").alias("total")) for scope, q in (("entities", "nation1"), ("articles", "order 1"), ("images", "PORTRAIT"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("select 'entities' as scope, id as doc_id, id as entity_id, name from c_entities where kb_status is distinct from 'not_person' and regexp_matches(lower(name), 'nation1')")
def x6_hits_with_entity(c, read):
    return X.global_search(c, "nation1", "entities", 1_000_000).filter("snippet like '%<mark>Nation1%'").select("scope", "doc_id", "entity_id", "name")


@query("select id, name from c_entities where kb_status is distinct from 'not_person' and regexp_matches(lower(name), 'nation1')")
def x7_search_entities(c, read):
    postings, lengths = _scope(X.documents(c.entities, ["name", "summary"]))
    return X.search_entities(c.entities, postings, lengths, "nation1", 1_000_000).select("id", "name")


@query(f"select term, count(*) as n from (select doc_id, term from {TERMS} where doc_id % 5 <> 0 union all select doc_id, unnest(['moved', 'alias']) from documents where doc_id % 10 = 0) group by 1")
def x8_refresh_index(c, read):
    docs = read("documents")
    index = I.branch(docs.sparkSession, _standing(read), scratch(docs.sparkSession))  # later queries find the index as it was
    now = X.documents(docs.filter("doc_id % 10 <> 5").withColumn("text", F.when(F.col("doc_id") % 10 == 0, "Moved alias").otherwise(F.col("text"))), ["text"], "doc_id")
    return I.vocabulary(docs.sparkSession, I.refresh(index, docs.filter("doc_id % 5 = 0").select("doc_id"), now)).select("term", "n")


# ---- streams, in their batch form; and a stream run to the end

HEALTH = f"""(select loop, count(*) filter (where kind = 'success' and ts >= timestamp '{EVENTS_AS_OF}' - interval 24 hour) as successes, count(*) filter (where kind = 'error' and ts >= timestamp '{EVENTS_AS_OF}' - interval 24 hour) as errors,
  arg_max(summary, ts) filter (where kind = 'success') as last_summary from c_events where loop is not null and kind in ('success', 'error') group by 1)"""
BUSINESS = f"(select kind, count(*) as n from c_events where kind not in ('success', 'error') and ts >= timestamp '{EVENTS_AS_OF}' - interval 24 hour group by 1)"


@query(f"select * from {HEALTH}")
def k1_job_health(c, read):
    return K.job_health(c.events, EVENTS_AS_OF).select("loop", "successes", "errors", "last_summary")


@query(f"select * from {BUSINESS}")
def k1_business_events(c, read):
    return K.business_events(c.events, EVENTS_AS_OF)


@query(f"""select loop, strftime(max(ts) filter (where kind = 'success'), '%Y-%m-%d %H:%M:%S') as last_success, strftime(max(ts) filter (where kind = 'error'), '%Y-%m-%d %H:%M:%S') as last_error, max(ts) < timestamp '{EVENTS_AS_OF}' - interval 10 minute as stale
  from c_events where loop is not null and kind in ('success', 'error') and ts <= timestamp '{EVENTS_AS_OF}' group by 1""")
def k2_liveness(c, read):
    text = lambda k: F.date_format(k, "yyyy-MM-dd HH:mm:ss").alias(k)
    return K.liveness_at(c.events, EVENTS_AS_OF).select("loop", text("last_success"), text("last_error"), "stale")


@query("select coalesce(scrape_status, 'none') as outcome, count(*) as n from c_images group by 1")
def a21_ingest_summary(c, read):
    return A.ingest_summary(c.images.select(F.coalesce("scrape_status", F.lit("none")).alias("outcome")))


@query(f"select event_id from c_events where ts >= timestamp '{EVENTS_AS_OF}' - interval 7 day")
def k3_retain(c, read):
    return K.retain(c.events, EVENTS_AS_OF).select("event_id")


@query(f"select case when reason is null then 'merge_ok' else 'merge_blocked' end as kind, count(*) as n from {BLOCKED} group by 1")
def k7_rare_events(c, read):
    bad = resolve.blocked_merges(c.entities).select(F.col("duplicate_id"), "reason")
    all_pairs = resolve.elect_canonical(c.entities).filter("place > 1").select(F.col("id").alias("duplicate_id"))
    verdicts = all_pairs.join(bad, "duplicate_id", "left").select(F.col("reason").isNull().alias("merge"), "reason")
    return K.rare_events(verdicts, EVENTS_AS_OF).groupBy("kind").agg(F.count("*").alias("n"))


# ---- sources

@query(r"""select page_id, count(*) as n from (select distinct page_id, link from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) as link from pages)) group by 1""")
def s3_extract_links(c, read):
    return feeds.extract_media(read("pages"), "a").groupBy("page_id").agg(F.count("*").alias("n"))


@query("select count(*) as n, count(distinct user_id) as users, strftime(min(ts), '%Y-%m-%d') as first_day from events where event_type = 'error'")
def s6_read_events(c, read):
    events, path = read("events"), _folder(read)
    feeds.append_events(events.filter("event_type = 'error'"), path)
    log = feeds.read_events(events.sparkSession, path, schema=events.schema.simpleString()[7:-1].replace(":", " "))
    return log.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))


def _folder(read) -> str:
    """A new place in the shared folder."""
    return scratch(read("region").sparkSession)


@query("""select trim(p_name) as name, case when p_partkey % 4 = 0 then 0 else p_size end as mentions, case when p_partkey % 3 = 0 then 'https://p/' || p_partkey end as url
  from part where p_partkey % 5 <> 0 and trim(p_name) <> ''""")
def s1_read_entity_feed(c, read):
    """A feed of lines with some parts each, as persons and as other things."""
    part, path = read("part"), _folder(read)
    image = F.when(F.col("p_partkey") % 3 == 0, F.struct(F.concat(F.lit("https://p/"), F.col("p_partkey").cast("string")).alias("url"), F.lit(3).alias("width")))
    entity = F.struct(
        F.when(F.col("p_partkey") % 5 == 0, "ORG").otherwise("PERSON").alias("type"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("value"),
        F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).alias("mentions"), image.alias("image"))
    part.groupBy(F.floor(F.col("p_partkey") / 50)).agg(F.collect_list(entity).alias("entities")).select(F.to_json(F.struct("entities"))).write.text(path)
    return feeds.read_entity_feed(part.sparkSession, path, lines=True).select("name", "mentions", F.col("image.url").alias("url"))


@query("""select case when o_orderkey % 7 = 0 then 'no_url' when o_orderkey % 11 = 0 then 'no_person' else 'ok' end as outcome, count(*) as n,
  sum(case when o_orderkey % 11 <> 0 then 2 - cast(o_custkey % 2 = 0 as int) else 0 end)::bigint as persons from orders group by 1""")
def s2_read_article_feed(c, read):
    """A feed of lines: single articles, lists, and objects with articles."""
    orders, path = read("orders"), _folder(read)
    url = F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.concat(F.lit("https://a/"), F.col("o_orderkey").cast("string")))
    persons = F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(" A "), F.when(F.col("o_custkey") % 2 == 0, "").otherwise("B")))
    article = F.to_json(F.struct(url.alias("URL"), F.struct(persons.alias("PERSON")).alias("entities")))
    line = F.when(F.col("o_orderkey") % 3 == 0, article).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("["), article, F.lit("]"))).otherwise(F.concat(F.lit('{"articles":['), article, F.lit("]}")))
    orders.select(line).write.text(path)
    ok, rejected = feeds.read_article_feed(orders.sparkSession, path, lines=True)
    rows = ok.select(F.lit("ok").alias("outcome"), "persons").unionByName(rejected.select(F.col("reason").alias("outcome"), "persons"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.size("persons").cast("bigint")).alias("persons"))


@query("""select p_partkey, array_to_string(list_filter(['https://i/' || p_partkey || '|' || case when p_size % 2 = 0 then p_type else p_brand end, case when p_size % 3 = 0 then 'http://j|' || p_brand end], lambda x: x is not null), ';') as found from part""")
def p37_feed_candidates(c, read):
    image = lambda url, title: F.struct(url.alias("url"), F.col("p_brand").alias("alt"), title.alias("title"))
    own = image(F.concat(F.lit("https://i/"), F.col("p_partkey").cast("string")), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""))
    other = image(F.when(F.col("p_size") % 3 == 0, "http://j").otherwise("ftp://j"), F.lit(None).cast("string"))
    found = R.feed_candidates(F.array(own, other, image(F.lit(None).cast("string"), F.lit("x"))))
    return read("part").select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat_ws("|", x["src"], x["caption"])), ";").alias("found"))


def _statements(nation, key):
    """Statements of a knowledge base about a row, as JSON values: ids, numbers, structs and dates of all kinds."""
    json = lambda *parts: F.parse_json(F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts]))
    text = lambda x: x.cast("string")
    return F.create_map(
        F.lit("P31"), F.array(F.when(nation % 5 == 0, json('"Q43229"')).otherwise(json('"Q5"')), json("17")),
        F.lit("P19"), F.array(json('"Q', text(nation), '"'), json('{"id": "Q1"}')), F.lit("P27"), F.array(json('"Q', text(nation), '"'), json('"x"'), json('"Q', text(key % 7), '"')),
        F.lit("P569"), F.array(json('{"time": "+19', F.lpad(text(key % 100), 2, "0"), '-00-01T00:00:00Z"}'), json('{"time": "+1950-', F.lpad(text(1 + key % 12), 2, "0"), '-31T00:00:00Z"}'), json("null")))


@query("""select s_suppkey, 'Q' || s_nationkey || ',Q' || (s_suppkey % 7) as ids, case when (1 + s_suppkey % 12) in (1, 3, 5, 7, 8, 10, 12) then '1950-' || lpad((1 + s_suppkey % 12)::varchar, 2, '0') || '-31' else '' end as dates from supplier""")
def p33_statements(c, read):
    held = read("supplier").withColumn("s", _statements(F.col("s_nationkey"), F.col("s_suppkey")))
    dates = F.array_join(F.transform(R.statement_dates(F.col("s"), "P569"), lambda d: d.cast("string")), ",")
    return held.select("s_suppkey", F.array_join(R.statement_ids(F.col("s"), "P27"), ",").alias("ids"), dates.alias("dates"))


@query("select s_suppkey, case when s_nationkey = s_suppkey % 7 then 'Q' || s_nationkey else 'Q' || s_nationkey || ',Q' || (s_suppkey % 7) end as ids from supplier")
def u4_label_ids(c, read):
    held = read("supplier").withColumn("s", _statements(F.col("s_nationkey"), F.col("s_suppkey")))
    return held.select("s_suppkey", F.array_join(L.label_ids(F.col("s")), ",").alias("ids"))


@query("""select id, case when gone then 'not_person' else kb_status end as kb_status, case when gone then 0 else image_count end as image_count, (select count(*) from c_links l join c_entities x on x.id = l.entity_id where not (x.kb_status is not distinct from 'done' and x.kb_id is not null and substr(x.kb_id, 2)::int % 5 = 0)) as links_left
  from (select *, kb_status is not distinct from 'done' and kb_id is not null and substr(kb_id, 2)::int % 5 = 0 as gone from c_entities)""")
def m16_recheck(c, read):
    kb = read("nation").select(F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("kb_id"), _statements(F.col("n_nationkey"), F.col("n_nationkey")).alias("statements"))
    after = L.recheck(c, kb)
    left = after.links.join(c.entities.select(F.col("id").alias("entity_id")).hint("merge"), "entity_id", "left_semi").agg(F.count("*").alias("links_left"))
    return after.entities.select("id", "kb_status", "image_count").join(F.broadcast(left))


QUERY_NAME = "case when name like '%,%' then trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) else name end"


@query(f"""select * from (with e as (select *, {QUERY_NAME} as q from c_entities),
  h as (select e.*, case when kb_id is null and id % 3 = 0 then 'Q' || (id % 25) else kb_id end as k, kb_id is null and id % 3 = 0 as found from e),
  l as (select h.*, n_nationkey as n, n_name, case when found then case when id % 2 = 0 then upper(q) else 'Other ' || id end when kb_score is null then n_name end as label from h left join nation on k = 'Q' || n_nationkey),
  s as (select *, case when k is null then 'not_found' when n % 5 = 0 then 'not_person' else 'done' end as status from l)
  select id, k as kb_id, case when found or kb_score is null then case when label is null then null when lower(label) = lower(q) then 1.0 else 0.7 end else kb_score end::double as kb_score, status as kb_status,
    case when status = 'done' then coalesce(case when id % 4 = 0 then 'About ' || id end, summary) else summary end as summary, case when status = 'done' then n_name end as birth_place,
    case when status = 'done' and 1 + n % 12 in (1, 3, 5, 7, 8, 10, 12) then '1950-' || lpad((1 + n % 12)::varchar, 2, '0') || '-31' end as birth_date from s)""")
def m18_enrich(c, read):
    """Entities against a snapshot of a knowledge base made of the nations: hits for some without an id, labels, pages."""
    entities = c.entities.withColumns({k: F.lit(None).cast(t) for k, t in (("birth_place", "string"), ("death_place", "string"), ("occupations", "array<string>"), ("employer", "string"), ("kb_synced_at", "timestamp_ntz"))})
    name = F.coalesce(N.inverted_name(F.col("name")), F.col("name"))
    hits = c.entities.filter("id % 3 = 0").select(
        name.alias("query"), F.lit("fr").alias("lang"), F.lit(1).alias("rank"), F.concat(F.lit("Q"), (F.col("id") % 25).cast("string")).alias("kb_id"),
        F.when(F.col("id") % 2 == 0, F.upper(name)).otherwise(F.concat(F.lit("Other "), F.col("id").cast("string"))).alias("label"))
    kb_id = F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("kb_id")
    statements = read("nation").select(kb_id, _statements(F.col("n_nationkey"), F.col("n_nationkey")).alias("statements"))
    labels = read("nation").select(kb_id, F.lit("en").alias("lang"), F.col("n_name").alias("label"))
    pages = c.entities.filter("id % 4 = 0").select(name.alias("title"), F.lit("fr").alias("lang"), F.lit("standard").alias("type"), F.concat(F.lit("About "), F.col("id").cast("string")).alias("extract"))
    found = L.enrich(entities, hits, statements, labels, pages, AS_OF)
    return found.select("id", "kb_id", "kb_score", "kb_status", "summary", "birth_place", F.col("birth_date").cast("string").alias("birth_date"))


@query("""select raw_name, entity_id, outcome from (select m.raw_name, coalesce(e.id, a.entity_id) as entity_id, case when s.kb_status = 'not_person' then 'rejected' when e.id is not null then 'slug' when a.entity_id is not null then 'alias' else 'new' end as outcome
  from (select c_name as raw_name from customer union all select s_name from supplier) m
  left join (select id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug from c_entities) e on e.slug = trim(regexp_replace(lower(m.raw_name), '[^a-z0-9]+', '-', 'g'), '-')
  left join (select alias, arg_max(entity_id, id) as entity_id from c_aliases group by 1) a on a.alias = m.raw_name
  left join c_entities s on s.id = coalesce(e.id, a.entity_id)) where outcome <> 'rejected'""")
def k5_resolved_stream(c, read):
    """A stream of names, run to its end, against the tables as they are."""
    mentions = read("customer").select(F.col("c_name").alias("raw_name")).unionByName(read("supplier").select(F.col("s_name").alias("raw_name")))
    spark, path = mentions.sparkSession, _folder(read)
    mentions.write.parquet(f"{path}/in")
    own = c.entities.withColumn("slug", F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    owners = c.aliases.groupBy(F.col("alias")).agg(F.max_by("entity_id", "id").alias("entity_id"), F.max("id").alias("id"))
    K.run_available(K.resolved_stream(spark.readStream.schema("raw_name string").parquet(f"{path}/in"), own, owners), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("raw_name", "entity_id", "outcome")


@query("select count(*) as n, count(distinct o_custkey) as customers from orders")
def k6_run_cycle(c, read):
    """A backlog of files, some a cycle; what each cycle has is added, and the sums are taken after the last."""
    orders, path = read("orders").select("o_orderkey", "o_custkey"), _folder(read)
    orders.repartition(3).write.parquet(f"{path}/in")
    spark = orders.sparkSession
    backlog = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    K.run_cycle(backlog, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


METRICS = f"""(select 'corpus_' || k as metric, '' as labels, v::double as value from (select unnest(['entities', 'tombstones', 'images', 'flagged', 'flagged_ratio']) as k, unnest([entities::double, tombstones, images, flagged, flagged_ratio]) as v from ({GAUGES}))
  union all select 'corpus_images_by_provider', '{{provider="' || coalesce(provider, 'feed') || '"}}', count(*)::double from c_images group by coalesce(provider, 'feed')
  union all select 'job_successes', '{{loop="' || loop || '"}}', successes::double from {HEALTH} union all select 'job_errors', '{{loop="' || loop || '"}}', errors::double from {HEALTH}
  union all select 'job_events_24h', '{{kind="' || kind || '"}}', n::double from {BUSINESS})"""


@query(f"select metric || labels || ' ' || case when value = floor(value) then cast(value::bigint as varchar) else printf('%.6f', value) end as value from {METRICS}")
def s7_r14_metrics_text(c, read):
    return feeds.metrics_text(reports.metric_rows(c, EVENTS_AS_OF))


# ---- reports

@query("select id, name, slug, (select count(*) from c_entities where kb_status is distinct from 'not_person' and name like 'N%') as total from c_entities where kb_status is distinct from 'not_person' and name like 'N%' order by name, id limit 50")
def r1_entity_list(c, read):
    return reports.entity_list(c, "N")


@query("""select e.id, name, a.alias_text, array_to_string(list_filter(string_split(nationalities_text, '|'), lambda x: trim(x) <> ''), ';') as nationalities, case when y >= 0 then cast(y as int) end as age_at_death from (
  select *, year(death_date) - year(birth_date) - (case when (month(death_date), day(death_date)) < (month(birth_date), day(birth_date)) then 1 else 0 end) as y from c_entities) e
  left join (select entity_id, string_agg(alias, ' ' order by alias) as alias_text from c_aliases group by 1) a on a.entity_id = e.id""")
def r2_entity_card(c, read):
    return reports.entity_card(c).withColumn("nationalities", F.array_join("nationalities", ";"))


GALLERY = "from c_images i left join c_articles a on a.id = i.article_id left join c_faces f on f.image_id = i.id where entity_id = 3"


@query(f"select i.id, f.pose, association_status, published_at::varchar as published_at, (select count(*) from c_images where entity_id = 3) as total, (select count(*) {GALLERY} and f.pose = 'front' and published_at >= date '1996-01-01') as filtered {GALLERY} and f.pose = 'front' and published_at >= date '1996-01-01' order by i.id limit 100")
def r3_gallery(c, read):
    return reports.gallery(c, 3, pose="front", low="1996-01-01").withColumn("published_at", F.col("published_at").cast("string"))


@query(f"select i.id, f.pose, (select count(*) {GALLERY} and is_duplicate = false) as filtered {GALLERY} and is_duplicate = false order by i.id limit 100")
def r4_gallery_unique(c, read):
    return reports.gallery(c, 3, unique_only=True).select("id", "pose", "filtered")


@query(f"select p.id, p.title, p.published_at::varchar as published_at, (select count(*) from c_articles where id in (select article_id from c_links where entity_id = 3) and domain = '1-URGENT') as total, n.entities, n.images from (select * from c_articles where id in (select article_id from c_links where entity_id = 3) and domain = '1-URGENT' order by published_at desc nulls last, scraped_at desc nulls last, id limit 50) p join {ARTICLE_COUNTS} n on n.id = p.id")
def r5_article_list(c, read):
    return reports.article_list(c, 3, "1-URGENT").withColumn("published_at", F.col("published_at").cast("string"))


@query("""select a.id, a.title, (select coalesce(string_agg(e.name, '; ' order by e.name), '') from c_links l join c_entities e on e.id = l.entity_id where l.article_id = 7) as entities,
  (select coalesce(string_agg(id::varchar, ',' order by id), '') from c_images where article_id = 7) as images from c_articles a where a.id = 7""")
def r6_article_detail(c, read):
    return reports.article_detail(c, 7)


@query(f"select id, entity_id, association_status, case association_status when 'human_flagged' then 'human' else 'automatic' end as origin, match_score, {REVIEW_TOTAL} from {REVIEW} limit 50")
def r7_review_queue(c, read):
    return reports.review_queue(c)


@query(f"""select i.entity_id, count(*) filter (where f.pose = 'front') as pose_front, count(*) filter (where f.pose = 'left') as pose_left, count(*) filter (where f.pose = 'right') as pose_right, count(*) filter (where f.pose is null) as pose_unknown,
  count(distinct a.domain) as domains, min(a.published_at)::varchar as first_day, max(a.published_at)::varchar as last_day, count(*) filter (where is_duplicate) as duplicates, count(*) filter (where is_duplicate = false) as unique_images,
  case when count(*) filter (where is_duplicate = false) < 2 then 'not enough unique images' end as note
  from c_images i left join c_faces f on f.image_id = i.id left join c_articles a on a.id = i.article_id group by 1""")
def r8_entity_profile(c, read):
    return reports.entity_profile(c).withColumns({k: F.col(k).cast("string") for k in ("first_day", "last_day")})


@query("select 2 as entity_a, 5 as entity_b, (select count(*) from c_links a join c_links b using (article_id) where a.entity_id = 2 and b.entity_id = 5) as shared, (select count(*) from c_links where entity_id = 2) as articles_a, (select count(*) from c_links where entity_id = 5) as articles_b")
def r9_compare(c, read):
    return reports.compare(c, 2, 5)


@query(f"""select d::date::varchar as day, case when d between date '{AS_OF}' - 365 and date '{AS_OF}' then coalesce(t.n, 0) end as n, cast(isodow(d) - 1 as int) as weekday,
  case when d between date '{AS_OF}' - 365 and date '{AS_OF}' then round(case when coalesce(t.n, 0) > 0 then least(1.0, greatest(0.18, t.n / (select max(n) from {TIMELINE} where entity_id = 3)::double)) else 0.0 end, 6) end as level
  from (select unnest(generate_series(date_trunc('week', date '{AS_OF}' - 365), date_trunc('week', date '{AS_OF}') + interval 6 day, interval 1 day)) as d) left join (select * from {TIMELINE} where entity_id = 3) t on t.day = d""")
def r10_calendar(c, read):
    return reports.calendar(c, 3, AS_OF).withColumn("day", F.col("day").cast("string"))


@query(f"""select i.entity_id, strftime(a.published_at, '%Y-%m') as period, count(*) as n, (select least(50, count(distinct title)) from c_articles where id in (select article_id from c_links where entity_id = 3)) as titles,
  (select count(*) from c_images where entity_id = 3 and is_duplicate = false) as unique_images from {IMAGE_ARTICLES} where i.entity_id = 3 and a.published_at is not null group by 1, 2""")
def r11_visibility(c, read):
    return reports.visibility(c, 3)


@query("select distinct title from c_articles where id in (select article_id from c_links where entity_id = 3) and title is not null order by title limit 50")
def r11_titles(c, read):
    return reports.visibility_report(c, 3)["titles"]


@query(f"""select 'surname' as category, surname as key, array_to_string(members, ',') as members from {SURNAMES}
  union all select * from (select 'kb_id', kb_id, array_to_string(list(id order by image_count desc, name, id), ',') from c_entities where kb_id is not null and kb_status is distinct from 'not_person' group by 2 having count(*) > 1 order by 2 limit 30)
  union all select * from (select 'alias', collision_on, first_id || ',' || second_id from ({J14_SQL}) order by collision_on, first_id limit 30)""")
def r12_duplicate_candidates(c, read):
    return reports.duplicate_candidates(c)


@query(f"select h.*, (select round(count(*) filter (where association_status = 'flagged') / count(*)::double, 4) from c_images) as flag_ratio from {HEALTH} h")
def r13_job_status(c, read):
    return reports.job_status(c, EVENTS_AS_OF)


@query(f"select count(*) filter (where kb_status is distinct from 'not_person') as persons, count(*) filter (where kb_status = 'not_person') as tombstones, count(*) filter (where is_favorite) as favorites, g.images, g.flagged, g.flagged_ratio from c_entities, ({GAUGES}) g group by all")
def r15_corpus_snapshot(c, read):
    return reports.corpus_snapshot(c)


@query(f"""select 'flagged_share' as kind, entity_id::varchar as subject, round(x, 4) as value from (select entity_id, count(*) filter (where association_status = 'flagged') / count(*)::double as x from c_images group by 1) where x > 0.08
  union all select 'busy_day', i.entity_id || '/' || strftime(a.published_at, '%Y-%m-%d'), count(*)::double from {IMAGE_ARTICLES} where a.published_at is not null group by i.entity_id, a.published_at having count(*) >= 4
  union all select 'outside', provider, count(*)::double from c_images where coalesce(provider, 'feed') <> 'feed' group by provider""")
def r16_anomalies(c, read):
    return reports.anomalies(c, 0.08, 4)


@query(f"select n.id, n.tier, s.* from {NEXT.format(n=5)} n, {SYNC} s")
def r17_sync_report(c, read):
    return reports.sync_report(c, AS_OF)
