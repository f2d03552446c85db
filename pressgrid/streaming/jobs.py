"""Job health, liveness, retention and intake, in batch and as streams (K1-K7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.aggregates import ingest_summary, last_run
from ..operators.joins import resolve_mentions
from ..operators.lifecycle import upsert_articles, upsert_entities, upsert_links
from ..schema import Corpus
from ..sources.versions import commit, last_commit, read_version
from ..tables import snapshot


def job_health(events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Successes and errors of each loop over the trailing hours, the boundary included; loops seen before stay with 0 (K1)."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    rows = events.filter("loop is not null and kind in ('success', 'error')")
    recent = F.col("ts") >= start
    counts = rows.groupBy("loop").agg(F.count_if(recent & (F.col("kind") == "success")).alias("successes"), F.count_if(recent & (F.col("kind") == "error")).alias("errors"))
    return counts.join(last_run(events), "loop")


def business_events(events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Other events by kind over the trailing hours (K1)."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    return events.filter(~F.col("kind").isin("success", "error") & (F.col("ts") >= start)).groupBy("kind").agg(F.count("*").alias("n"))


def job_health_stream(events: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by loop and kind over sliding windows on the hour; rows later than the watermark drop (K1).

    Windows are aligned, not anchored at the time of asking as in :func:`job_health`.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window, slide), "loop", "kind").agg(F.count("*").alias("n")).select(F.col("window.end").alias("window_end"), "loop", "kind", "n")


LIVENESS = "loop string, last_success timestamp, last_error timestamp, last_summary string, stale boolean"


#: Spark keeps the state of timers in this store alone.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Liveness(StatefulProcessor):
    """State of one loop: its last success, error and summary, and a timer for the moment when it turns stale."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_success timestamp, last_error timestamp, last_summary string")

    def _row(self, loop: str, stale: bool) -> pd.DataFrame:
        ok, bad, summary = self.last.get()
        return pd.DataFrame({"loop": [loop], "last_success": [pd.Timestamp(ok) if ok else None], "last_error": [pd.Timestamp(bad) if bad else None], "last_summary": [summary], "stale": [stale]}).astype({"last_success": "datetime64[ns]", "last_error": "datetime64[ns]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ok, bad, summary = self.last.get() if self.last.exists() else (None, None, None)
        for f in rows:
            good, failed = f[f["kind"] == "success"], f[f["kind"] == "error"]
            if len(good) and (ok is None or good["ts"].max() >= ok):
                newest = good["ts"].idxmax()
                ok, summary = good["ts"][newest].to_pydatetime(), good["summary"][newest]
            if len(failed) and (bad is None or failed["ts"].max() >= bad):
                bad = failed["ts"].max().to_pydatetime()
        self.last.update((ok, bad, summary))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        newest = max(x for x in (ok, bad) if x is not None)
        due = int(pd.Timestamp(newest, tz="UTC" if newest.tzinfo is None else None).timestamp() * 1000) + self.limit_ms
        stale = due <= timerValues.getCurrentProcessingTimeInMs()
        if not stale:
            self.handle.registerTimer(due)
        yield self._row(key[0], stale)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key[0], True)

    def close(self) -> None:
        pass


def liveness(events: DataFrame, stale_after: str = "10 minutes") -> DataFrame:
    """Each loop's last success, error and summary, updated as events come; a silent loop turns stale as the others' events go on (K2).

    Goes by event time, so it can run over what there is and stop; :func:`liveness_by_clock` tells a silent corpus too.
    """
    limit_ms = int(pd.Timedelta(stale_after).total_seconds() * 1000)

    def update(key, frames, state):
        ok, bad, summary = state.get if state.exists else (None, None, None)
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], ok, bad, summary, True)], columns=["loop", "last_success", "last_error", "last_summary", "stale"])
            return
        for f in frames:
            good, failed = f[f["kind"] == "success"], f[f["kind"] == "error"]
            if len(good) and (ok is None or good["ts"].max() >= ok):
                newest = good["ts"].idxmax()
                ok, summary = good["ts"][newest], good["summary"][newest]
            if len(failed):
                bad = failed["ts"].max() if bad is None else max(bad, failed["ts"].max())
        state.update((ok, bad, summary))
        newest = max(x for x in (ok, bad) if x is not None)
        at = int(newest.timestamp() * 1000) + limit_ms
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], ok, bad, summary, False)], columns=["loop", "last_success", "last_error", "last_summary", "stale"])

    timed = events.filter("loop is not null and kind in ('success', 'error')").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return timed.groupBy("loop").applyInPandasWithState(update, LIVENESS, "last_success timestamp, last_error timestamp, last_summary string", "update", "EventTimeTimeout")


def liveness_by_clock(events: DataFrame, stale_after: str = "10 minutes") -> DataFrame:
    """Each loop's last success, error and summary, updated as events come; a silent loop turns stale (K2).

    Staleness goes by the clock, not by the events: a timer of each loop fires when its newest event is older than the
    limit, though no loop sends any more.  Events that are that old when they come are stale at once.  For streams with a
    processing-time trigger: while timers are set, a stream over what there is would not end.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    limit_ms = int(pd.Timedelta(stale_after).total_seconds() * 1000)
    rows = events.filter("loop is not null and kind in ('success', 'error') and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("loop").transformWithStateInPandas(Liveness(limit_ms), LIVENESS, "Update", "ProcessingTime")


def liveness_at(events: DataFrame, as_of: str, stale_after: str = "10 minutes") -> DataFrame:
    """:func:`liveness` of a table of events at a moment: a loop whose newest event is older than the limit is stale (K2).

    A stream's watermark rests while no events come; this form tells a silent corpus too.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = events.filter(F.col("loop").isNotNull() & F.col("kind").isin("success", "error") & (F.col("ts") <= now))
    good = F.when(F.col("kind") == "success", F.col("ts"))
    found = rows.groupBy("loop").agg(F.max(good).alias("last_success"), F.max(F.when(F.col("kind") == "error", F.col("ts"))).alias("last_error"), F.max_by("summary", good).alias("last_summary"), F.max("ts").alias("newest"))
    return found.withColumn("stale", F.col("newest") < now - F.expr(f"interval {stale_after}")).drop("newest")


def ingest(batch: DataFrame, corpus: Corpus, as_of: str, source: str = "feed") -> tuple[Corpus, DataFrame]:
    """One batch of articles ``url, title, published_at, scraped_at, domain, persons array<string>`` into the corpus (K4).

    Persons become entities (M1), new URLs articles (M2) and both links (M3); known URLs only get links.  The
    summary is that of A21.  To be called from ``foreachBatch``, with the corpus read anew for each batch.
    """
    rows = snapshot(batch)
    named = rows.select(F.explode("persons").alias("raw_name"), F.lit(source).alias("source")).filter("raw_name <> ''").distinct()
    entities, aliases, owners = map(snapshot, upsert_entities(named, corpus.entities, corpus.aliases, as_of))
    known = corpus.articles.select("url")
    outcomes = rows.select("url").distinct().join(known.withColumn("had", F.lit(True)).hint("merge"), "url", "left").select(F.when(F.col("had"), "already").otherwise("new").alias("outcome"))
    articles = snapshot(upsert_articles(rows.drop("persons"), corpus.articles))
    met = rows.select("url", F.explode("persons").alias("raw_name")).join(articles.select("url", F.col("id").alias("article_id")).hint("merge"), "url")
    links = upsert_links(met.join(owners.hint("merge"), "raw_name").select("article_id", "entity_id").distinct(), corpus.links)
    return corpus.with_(entities=entities, aliases=aliases, articles=articles, links=links), ingest_summary(outcomes)


def ingest_batch(batch: DataFrame, number: int, path: str, as_of: str, source: str = "feed") -> DataFrame | None:
    """:func:`ingest` of one batch into the versioned corpus of a folder; None where that batch was committed before (K4).

    To be given to ``foreachBatch``: a batch that is played again, after a loss of the driver between two tables or of the
    checkpoint, changes nothing that stands.
    """
    spark = batch.sparkSession
    if number <= last_commit(spark, path)[0]:
        return None
    before = read_version(spark, path)
    after, summary = ingest(batch, before, as_of, source)
    summary = snapshot(summary)
    commit(before, after, path, number, ("entities", "aliases", "articles", "links"))
    return summary


def retain(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Events of the last days, the boundary included (K3)."""
    return events.filter(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def new_articles(stream: DataFrame, late: str = "1 day", time: str = "scraped_at") -> DataFrame:
    """Each URL once within the watermark (K4)."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["url"])


def resolved_stream(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions of a stream met with the tables of entities and aliases; tombstones are rejected (K5)."""
    return resolve_mentions(mentions, entities, aliases).filter("outcome <> 'rejected'")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is into a Parquet folder, then stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_cycle(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, after: Callable[[], None] | None = None) -> int:
    """Bounded cycles over a backlog: ``work`` gets each batch that has rows, and ``after`` runs only if one had (K6).

    Returns the number of batches with rows; the size of a batch is the source's ``maxFilesPerTrigger``.
    """
    done = []

    def each(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            work(batch, number)
            done.append(number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if done and after:
        after()
    return len(done)


def rare_events(verdicts: DataFrame, as_of: str) -> DataFrame:
    """Event rows for each merge done or blocked in ``verdicts(merge, reason)`` (K7)."""
    return verdicts.select(
        F.lit(as_of).cast("timestamp_ntz").alias("ts"), F.when(F.col("merge"), "merge_ok").otherwise("merge_blocked").alias("kind"),
        F.lit(None).cast("string").alias("loop"), F.to_json(F.struct("reason")).alias("summary"))
