"""The corpus model over the driver's tables.

Each table is one SELECT that Spark and DuckDB both run: Spark as the input of an operator, DuckDB as the start of
the SQL that the operator is held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Corpus

#: The time that stands for "now" in every report over these tables.
AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-20 12:00:00"

TABLES: dict[str, str] = {}
TABLES["entities"] = """
select s_suppkey as id,
  case when s_suppkey % 10 = 3 then s_name else concat('Nation', cast(s_nationkey as {text}), ', ', s_name) end as name,
  concat('s-', cast(s_suppkey as {text})) as slug,
  case when s_suppkey % 8 = 0 then null else cast(date '1994-01-01' + cast(s_suppkey % 500 as int) as {time}) end as first_seen,
  cast(0 as bigint) as article_count, s_suppkey * 13 % 60 as image_count, cast(0 as bigint) as unique_image_count, cast(null as double) as diversity_score,
  s_acctbal < 0 as is_favorite,
  case when s_suppkey % 4 = 1 then null else concat('Q', cast(s_nationkey as {text})) end as kb_id,
  case when s_suppkey % 9 = 4 then 'not_person' when s_suppkey % 5 = 0 then null when s_suppkey % 11 = 1 then 'pending' else 'done' end as kb_status,
  cast(case when s_suppkey % 6 = 0 then 0.7 when s_suppkey % 13 = 2 then null else 1.0 end as double) as kb_score,
  concat('Supplier of ', cast(s_nationkey as {text})) as summary,
  date '1930-01-01' + cast(s_suppkey * 97 % 20000 as int) as birth_date,
  case when s_suppkey % 4 = 0 then date '1960-01-01' + cast(s_suppkey * 31 % 14000 as int) end as death_date,
  concat('N', cast(s_nationkey as {text}), '||', case when s_suppkey % 2 = 0 then 'EU' else '' end) as nationalities_text,
  case when s_suppkey % 3 = 0 then null else cast(date '2001-01-01' + cast(s_suppkey * 7 % 212 as int) as {time}) end as last_synced_at,
  case when s_suppkey % 7 = 3 then null else s_suppkey * 37 % 101 end as mentions
from supplier
"""
TABLES["aliases"] = """
select c_custkey as id, c_custkey % 10 as entity_id,
  case when c_custkey % 50 = 7 then 'Supplier#000000003' else c_name end as alias, c_mktsegment as source
from customer where c_custkey % 3 = 1
"""
TABLES["articles"] = """
select o_orderkey as id, concat('https://', lower(o_orderstatus), '.example/', cast(o_orderkey as {text})) as url,
  concat('Order ', cast(o_orderkey % 400 as {text})) as title,
  case when o_orderkey % 40 = 0 then null else cast(o_orderdate as date) end as published_at, o_orderdate as scraped_at, o_orderpriority as domain
from orders
"""
TABLES["links"] = "select distinct l_orderkey as article_id, l_suppkey as entity_id from lineitem"
TABLES["images"] = """
select l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as id,
  case when l_partkey % 50 = 7 then null else l_orderkey end as article_id, l_suppkey as entity_id,
  concat('https://img.example/', cast(l_partkey as {text}), '/', cast(l_linenumber as {text}), case when l_partkey % 3 = 0 then '.PNG?x=1' when l_partkey % 3 = 1 then '.jpeg' else '' end) as source_url,
  case when l_partkey % 3 = 0 then null else concat('a/', cast(l_partkey as {text})) end as aligned_path,
  concat(case when l_quantity > 25 then 'Portrait of ' else 'View of ' end, l_returnflag, l_linestatus) as caption,
  case when l_tax = 0.08 then 'failed' else 'downloaded' end as scrape_status,
  case when l_tax < 0.02 then 'pending' else 'done' end as analysis_status,
  case when l_partkey % 10 = 0 then null when l_partkey % 10 = 1 then 'web' when l_partkey % 10 = 2 then 'manual' else 'feed' end as provider,
  case when l_partkey % 17 = 0 then null else l_partkey % 6 = 0 end as is_duplicate,
  case when l_quantity = 50 then null else l_discount end as match_score,
  case when l_quantity < 5 then 'flagged' when l_quantity < 8 then 'human_flagged' when l_quantity < 20 then 'confirmed' when l_quantity = 33 then null
    when l_quantity < 45 then 'auto' else 'manual' end as association_status,
  l_shipdate as scraped_at,
  case when l_quantity = 13 then null when l_returnflag = 'R' then 'right' when l_returnflag = 'A' then 'left' else 'front' end as pose,
  case when l_linenumber = 1 then null else cast(l_linenumber % 3 as bigint) end as face_count
from lineitem
"""
TABLES["events"] = """
select ts, case when event_type = 'purchase' then 'success' else event_type end as kind,
  case when event_type in ('purchase', 'error') then concat('loop', cast(user_id % 12 as {text})) end as loop, props as summary, event_id
from events
"""
DIALECT = {"spark": {"text": "string", "time": "timestamp_ntz"}, "duckdb": {"text": "varchar", "time": "timestamp"}}
DRIVER_TABLES = {"entities": "supplier", "aliases": "customer", "articles": "orders", "links": "lineitem", "images": "lineitem", "events": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the model over the driver's table."""
    source = DRIVER_TABLES[name]
    text = TABLES[name].format(**DIALECT["spark"]).replace(f"from {source}", "from {source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    images = bound(spark, sf_dir, "images")
    return Corpus(
        entities=bound(spark, sf_dir, "entities"), aliases=bound(spark, sf_dir, "aliases"), articles=bound(spark, sf_dir, "articles"),
        links=bound(spark, sf_dir, "links"), images=images.drop("pose", "face_count"),
        faces=images.filter("analysis_status = 'done'").select(images.id.alias("image_id"), "pose", "face_count"), events=bound(spark, sf_dir, "events"))


def with_tables(sql: str) -> str:
    """DuckDB SQL that begins with those tables of the model that ``sql`` names, as c_entities, c_images and so on."""
    used = [k for k in TABLES if f"c_{k}" in sql or (k == "images" and "c_faces" in sql)]
    parts = [f"c_{k} as ({TABLES[k].format(**DIALECT['duckdb'])})" for k in used]
    if "c_faces" in sql:
        parts.append("c_faces as (select id as image_id, pose, face_count from c_images where analysis_status = 'done')")
    return f"with {', '.join(parts)} {sql}" if parts else sql
