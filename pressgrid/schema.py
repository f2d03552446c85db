"""The corpus model: explicit schemas, and the corpus as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

ENTITIES = (
    "id bigint, name string, slug string, first_seen timestamp_ntz, article_count bigint, image_count bigint, unique_image_count bigint, "
    "diversity_score double, is_favorite boolean, kb_id string, kb_status string, kb_score double, kb_synced_at timestamp_ntz, summary string, "
    "birth_date date, death_date date, birth_place string, death_place string, nationalities array<string>, occupations array<string>, "
    "employer string, centroid array<float>, centroid_n bigint, last_synced_at timestamp_ntz, mentions bigint"
)
ALIASES = "id bigint, entity_id bigint, alias string, source string, created_at timestamp_ntz"
ARTICLES = "id bigint, url string, title string, published_at date, scraped_at timestamp_ntz, domain string"
LINKS = "article_id bigint, entity_id bigint, confidence double"
IMAGES = (
    "id bigint, article_id bigint, entity_id bigint, source_url string, local_path string, aligned_path string, caption string, alt_text string, "
    "copyright string, scrape_status string, analysis_status string, provider string, hash64 bigint, is_duplicate boolean, duplicate_of bigint, "
    "vector array<float>, match_score double, association_status string, scraped_at timestamp_ntz"
)
FACES = "image_id bigint, pose string, yaw double, pitch double, roll double, eye_distance bigint, mesh array<struct<x:float,y:float>>, face_count bigint"
EVENTS = "ts timestamp_ntz, kind string, loop string, summary string"
SCHEMAS = {"entities": ENTITIES, "aliases": ALIASES, "articles": ARTICLES, "links": LINKS, "images": IMAGES, "faces": FACES, "events": EVENTS}


@dataclass(frozen=True)
class Corpus:
    """The seven tables.  A maintenance job takes one corpus and returns another."""

    entities: DataFrame
    aliases: DataFrame
    articles: DataFrame
    links: DataFrame
    images: DataFrame
    faces: DataFrame
    events: DataFrame

    def with_(self, **tables: DataFrame) -> Corpus:
        return replace(self, **tables)

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    @staticmethod
    def empty(spark: SparkSession, **tables: DataFrame) -> Corpus:
        return Corpus(**{k: tables.get(k, spark.createDataFrame([], s)) for k, s in SCHEMAS.items()})
