"""Predicates and backlog selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import in_letter, sort_key
from ..functions.rules import TOMBSTONE


def live(entities: DataFrame, strict: bool = False, status: str = "kb_status") -> DataFrame:
    """Without tombstones; ``strict`` also drops rows without a status, as two of the reports do (F1, F2)."""
    return entities.filter(F.col(status) != TOMBSTONE if strict else ~F.col(status).eqNullSafe(TOMBSTONE))


def status_in(df: DataFrame, *values: str, status: str = "association_status") -> DataFrame:
    return df.filter(F.col(status).isin(*values))


def status_not_in(df: DataFrame, *values: str, status: str = "association_status") -> DataFrame:
    """Three-valued logic: a null status is neither in nor not in."""
    return df.filter(~F.col(status).isin(*values))


#: What each kind of backlog waits for.
BACKLOGS: dict[str, Column | str] = {
    "analysis": "analysis_status = 'pending'",
    "hash": "aligned_path is not null and hash64 is null",
    "vector": "analysis_status = 'done' and vector is null",
    "mesh": "mesh is null",
    "face_count": "face_count is null",
    "kb_pending": "kb_status = 'pending'",
    "kb_done": "kb_status = 'done' and kb_id is not null",
}


def backlog(df: DataFrame, kind: str, limit: int, key: str = "id") -> DataFrame:
    """The first ``limit`` waiting rows by id: a top-k, not a sort of the table."""
    return df.filter(BACKLOGS[kind]).orderBy(key).limit(limit)


def date_range(df: DataFrame, low: str | None = None, high: str | None = None, day: str = "published_at") -> DataFrame:
    """Both ends included; with either end given, rows without a date drop."""
    if low:
        df = df.filter(F.col(day) >= F.lit(low).cast("date"))
    if high:
        df = df.filter(F.col(day) <= F.lit(high).cast("date"))
    return df


def where_provider(images: DataFrame, provider: str, default: str = "feed") -> DataFrame:
    return images.filter(F.coalesce("provider", F.lit(default)) == provider)


def where_domain(articles: DataFrame, domain: str) -> DataFrame:
    return articles.filter(F.col("domain") == domain)


def favorites(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("is_favorite").eqNullSafe(True))


def letter_filter(entities: DataFrame, letter: str, sort_by: str = "name") -> DataFrame:
    """Entities listed under a letter, by name or by first name."""
    return entities.filter(in_letter(F.col("name") if sort_by == "name" else sort_key(F.col("name")), letter))


def demo_rows(images: DataFrame, captions: list[str], url_pattern: str) -> DataFrame:
    """Test data: captions with one of the beginnings, or URLs like the pattern, ASCII case aside."""
    starts = F.lit(False)
    for text in captions:
        starts = starts | F.coalesce(F.startswith("caption", F.lit(text)), F.lit(False))
    return images.filter(starts | F.coalesce(F.ilike("source_url", F.lit(url_pattern)), F.lit(False)))
