"""URL verdicts: fixed host and path rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, sided

#: The item that marks a labelled transaction as bad.
BAD = "label=bad"
#: Up to so many items a labelled row FP-growth mines, whose combinations are at most two to that power; beyond, combinations
#: are counted level by level, which stops at the length of the longest rule and finds the same ones.
WIDE = 16


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = (
    PathRule("allow", "org", "/"),
    PathRule("block", "example.org", "/es/"),
    PathRule("block", "example.org", "/en/1"),
    PathRule("allow", "com", "/fr/"),
    PathRule("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_matches(host: Column, path: Column, rule: PathRule) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def longest_rule(host: Column, path: Column, rules: tuple[PathRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest of a short list of rules that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = rule_matches(host, path, rule)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Items of a URL: host suffixes, words of the host, path segments, query keys, fragment, scheme."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("word="), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.split_part(x, F.lit("="), F.lit(1))))
    tail = F.array_compact(F.array(F.when(F.contains(url, F.lit("#")), F.lit("has=fragment")), F.concat(F.lit("scheme="), F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, words, segments, keys, tail)))


@dataclass(frozen=True)
class Rules:
    """Mined rules ``rule_id, items, confidence`` over classes of items, and the ``item``s of each class, named by its first.

    Items that occur in the same labelled rows are a class: what holds of one in a rule holds of each.
    """

    rules: DataFrame
    classes: DataFrame


def _wanted(min_confidence: float, min_lift: float, base: float) -> Column:
    """Whether counts ``n, bads`` of a combination make a rule."""
    confidence = F.col("bads") / F.col("n")
    return (confidence >= min_confidence) & (confidence / base >= min_lift)


def _by_levels(rows: DataFrame, least: int, wanted: Column, max_items: int) -> DataFrame:
    """Rules of two items or more by counting combinations level by level: ``items, confidence``.

    ``rows(row, bad, items)``.  Only combinations that are frequent and no rule yet are grown: what holds a rule
    needs no rule of its own.
    """
    spread = materialize(rows.select("row", "bad", F.explode("items").alias("z")))
    held, found = spread.select("row", "bad", F.array("z").alias("items")), None
    for _ in range(2, max_items + 1):
        grown = held.join(spread.select("row", "z").hint("merge"), "row").filter(F.col("z") > F.element_at("items", -1)).select("row", "bad", F.array_append("items", F.col("z")).alias("items"))
        counts = materialize(grown.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("bads")).filter(F.col("bads") >= least))
        rules = counts.filter(wanted).select("items", (F.col("bads") / F.col("n")).alias("confidence"))
        found = rules if found is None else found.unionByName(rules)
        held = materialize(grown.join(counts.filter(~wanted).select("items").hint("merge"), "items", "left_semi"))
    return found


def mine_rules(labelled: DataFrame, min_support: float, min_rows: int, min_confidence: float, min_lift: float, max_items: int) -> Rules:
    """Rules over ``labelled(items, bad)`` whose consequent is bad, of ``max_items`` items at most, by FP-growth.

    Support is that of items and label together, relative to all labelled rows, and never below ``min_rows`` rows:
    few labelled rows would else make every combination frequent.  Every item that is frequent among bad rows is mined, so no
    verdict is lost: an item that is a rule by itself blocks whatever holds it, and leaves before longer rules are sought; the
    other items are mined as classes.  No labelled rows, or no bad ones: no rules.
    """
    spark = labelled.sparkSession
    none = Rules(spark.createDataFrame([], "rule_id bigint, items array<string>, confidence double"), spark.createDataFrame([], "item string, class string"))
    rows = materialize(labelled.withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bads")).first()
    if not total["bads"]:
        return none
    support = min(1.0, max(min_support, min_rows / total["n"]))
    least, wanted = math.ceil(support * total["n"] - 1e-9), _wanted(min_confidence, min_lift, total["bads"] / total["n"])

    spread = rows.select("row", F.explode("items").alias("item"), "bad")
    stats = materialize(spread.groupBy("item").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("bads"), F.sum(F.shiftright(F.xxhash64("row"), 24)).alias("rows"), F.sum(F.shiftright(F.xxhash64("row", F.lit(1)), 24)).alias("again"),
    ).filter(F.col("bads") >= least))
    single = stats.filter(wanted).select(F.array("item").alias("items"), (F.col("bads") / F.col("n")).alias("confidence"))
    group = ["n", "bads", "rows", "again"]
    named = stats.filter(~wanted).groupBy(*group).agg(F.min("item").alias("class"), F.collect_list("item").alias("members"))
    classes = materialize(named.select("class", F.explode("members").alias("item")).unionByName(stats.filter(wanted).select(F.col("item").alias("class"), "item")))

    first = materialize(named.select("class"))
    lists = spread.join(sided(first), F.col("item") == F.col("class")).groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("mined"))
    mined = materialize(rows.select("row", "bad").join(lists.hint("merge"), "row", "left").select("row", "bad", F.coalesce("mined", F.array().cast("array<string>")).alias("items")))
    if (mined.agg(F.max(F.size("items"))).first()[0] or 0) <= WIDE:
        baskets = materialize(mined.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
        longer = model.associationRules.filter(
            (F.col("consequent") == F.array(F.lit(BAD))) & (F.size("antecedent") <= max_items) & (F.col("lift") >= min_lift)).select(F.array_sort("antecedent").alias("items"), "confidence")
    else:
        longer = _by_levels(mined, least, wanted, max_items)
    rules = single.unionByName(longer) if longer is not None else single
    return Rules(materialize(rules.select(F.xxhash64(F.array_join("items", "\n")).alias("rule_id"), "items", "confidence")), classes)


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: tuple[PathRule, ...] = RULES,
    min_support: float = 0.002, min_rows: int = 5, min_confidence: float = 0.5, min_lift: float = 1.5, max_items: int = 3,
) -> DataFrame:
    """A verdict for every row of ``pages(page_id, url)``; ``labels(page_id, bad)`` covers some of them.

    The longest fixed rule that fits decides.  Elsewhere a URL is blocked if it holds all items of a mined rule:
    items point to the rules that hold them (an inverted index), and a rule fires when as many of its items were
    met as it has.  Returns ``page_id, host, path, rule, verdict, confidence``.  Null URLs, and those without
    ``://``, have an empty host and path, no rule, and are allowed.  Repeated rows are judged each by itself.
    A null label counts for nothing; a page with several labels is bad if one is.  Empty tables give no rows.
    ``confidence`` is the highest of the rules that fired; combinations that hold a rule are no rules of their own.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    tokens = url_tokens(F.col("host"), F.col("path"), F.col("url"))
    marks = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = parts.join(marks.hint("merge"), "page_id").select(tokens.alias("items"), "bad").filter("size(items) > 0")
    mined = mine_rules(labelled, min_support, min_rows, min_confidence, min_lift, max_items)
    needed = mined.rules.select(F.explode("items").alias("class"), "rule_id", F.size("items").alias("needs"), "confidence")
    postings = materialize(needed.join(mined.classes.hint("merge"), "class"))

    # Each different URL is matched once; its items meet the postings, and a rule counts the classes it met.
    urls = materialize(parts.filter("host <> ''").select("url", "host", "path").distinct())
    met = urls.select("url", F.explode(tokens).alias("item")).join(sided(postings), "item").dropDuplicates(["url", "rule_id", "class"])
    fired = met.groupBy("url", "rule_id").agg(F.count("*").alias("n"), F.first("needs").alias("needs"), F.first("confidence").alias("confidence")).filter("n = needs")
    blocked = materialize(fired.groupBy("url").agg(F.max("confidence").alias("confidence")))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return parts.join(sided(blocked.withColumnRenamed("url", "bad_url")), F.expr("url = bad_url"), "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence",
    )
