"""Small rules on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_PROVIDER = "feed"
HUMAN_FLAG, FLAG, TOMBSTONE = "human_flagged", "flagged", "not_person"


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def guess_ext(url: Column, gif: bool = True) -> Column:
    """File extension by the URL's path; what isn't known is ``.jpg``."""
    known = "jpe?g|png|gif|webp" if gif else "jpe?g|png|webp"
    ext = F.regexp_extract(F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), rf"\.({known})$", 1)
    return F.when(ext.isin("", "jpeg"), ".jpg").otherwise(F.concat(F.lit("."), ext))


def pipe_list(text: Column) -> Column:
    """Parts between pipes, trimmed, without empty ones; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def flag_hypothesis(faces: Column) -> Column:
    return F.when(faces > 1, "composition").when(faces == 1, "misattribution").otherwise("unknown")


def flag_origin(status: Column) -> Column:
    return F.when(status == HUMAN_FLAG, "human").when(status == FLAG, "automatic")


def caption_rule(caption: Column, wanted: list[str], unwanted: list[str] = ()) -> Column:
    """Holds one of the wanted texts and none of the unwanted, case counting; null is false."""
    has = lambda words: sum((F.when(F.contains(caption, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)) > 0
    return F.coalesce(has(wanted) & ~has(unwanted), F.lit(False))


def diversity_note(unique_images: Column) -> Column:
    return F.when(F.coalesce(unique_images, F.lit(0)) < 2, "not enough unique images")


def heat_level(count: Column, most: Column) -> Column:
    """0 without activity, else the share of the peak, at least 0.18."""
    return F.when((count > 0) & (most > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.18), count / most))).otherwise(F.lit(0.0))


def safe_ratio(n: Column, d: Column, digits: int, empty: float | None = 0.0) -> Column:
    return F.when(d > 0, F.round(n / d, digits)).otherwise(F.lit(empty).cast("double"))


def label_score(label: Column, name: Column) -> Column:
    return F.when(F.lower(label) == F.lower(name), 1.0).otherwise(0.7)


def aligned_url(image_id: Column, path: Column) -> Column:
    return F.when(path.isNotNull(), F.concat(F.lit("/images/"), image_id.cast("string"), F.lit("/aligned")))


def feed_candidates(images: Column) -> Column:
    """Feed images with an http(s) URL, captioned by their title or else their alt text."""
    own = F.filter(images, lambda i: F.coalesce(i["url"].rlike("^https?://"), F.lit(False)))
    return F.transform(own, lambda i: F.struct(
        i["url"].alias("src"), i["alt"].alias("alt"), F.coalesce(F.when(i["title"] != "", i["title"]), i["alt"]).alias("caption")))


def statement_ids(statements: Column, prop: str) -> Column:
    """Knowledge-base ids of a property of ``map<string, array<variant>>``: strings that start with Q."""
    values = F.coalesce(F.try_element_at(statements, F.lit(prop)), F.array().cast("array<variant>"))
    return F.filter(F.transform(values, lambda v: F.try_variant_get(v, "$", "string")), lambda x: F.coalesce(x.startswith("Q"), F.lit(False)))


def statement_dates(statements: Column, prop: str) -> Column:
    """Dates of a property: its structs' ``time`` (or plain strings) that are full dates."""
    from .dates import parse_kb_time

    values = F.coalesce(F.try_element_at(statements, F.lit(prop)), F.array().cast("array<variant>"))
    times = F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$.time", "string"), F.try_variant_get(v, "$", "string")))
    return F.filter(F.transform(times, parse_kb_time), lambda x: x.isNotNull())
