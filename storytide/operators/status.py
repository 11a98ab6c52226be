"""Funnels, telemetry, backlogs, work selection, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, ratio
from .relational import eligible_within, top_per

#: Stages of the ingestion funnel after `ingested`, in order, fixed values.
STAGES = ("with_text", "extracted", "with_signals", "classified", "matched", "approved", "candidate_evidence")


def funnel(documents: DataFrame, group: str = "source_class") -> DataFrame:
    """Per class and in total ('all'): documents at each stage. documents carry one boolean per stage."""
    out = documents.rollup(group).agg(F.count("*").alias("ingested"), *[F.count_if(F.col(s)).alias(s) for s in STAGES], F.grouping(group).alias("g"))
    return out.withColumn(group, F.when(F.col("g") == 1, "all").otherwise(F.col(group))).drop("g")


def funnel_stages(totals: DataFrame) -> DataFrame:
    """The totals as rows stage, n, share of the stage before and of all ingested."""
    pairs = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(s).alias("stage"), F.col(s).alias("n"), F.col("ingested" if k == 0 else ("ingested", *STAGES)[k - 1]).alias("before")) for k, s in enumerate(("ingested", *STAGES))])
    return totals.select("ingested", F.explode(pairs).alias("p")).select("p.place", "p.stage", "p.n", half_up(ratio(F.col("p.n"), F.col("p.before")), 3).alias("share_of_previous"), half_up(ratio(F.col("p.n"), F.col("ingested")), 3).alias("share_of_ingested"))


def telemetry(ids: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """ids left-joined with pre-aggregated parts on the key; counts that are missing are 0."""
    out = ids
    for p in parts:
        out = out.join(p, key, "left")
    return out.fillna(0)


def backlog(documents: DataFrame, runs: DataFrame, most_attempts: int = 5, group: str = "source_class") -> DataFrame:
    """Per class: documents waiting, done, and given up after too many unsuccessful attempts. runs: document_id, status."""
    per = runs.groupBy("document_id").agg(F.bool_or(F.col("status") == "succeeded").alias("done"), F.count_if(F.col("status") != "succeeded").alias("failures"))
    x = documents.join(per, "document_id", "left")
    done, spent = F.coalesce("done", F.lit(False)), F.coalesce("failures", F.lit(0)) >= most_attempts
    return x.groupBy(group).agg(F.count("*").alias("documents"), F.count_if(done).alias("completed"), F.count_if(~done & spent).alias("exhausted"), F.count_if(~done & ~spent).alias("waiting"))


def classification_order(documents: DataFrame, as_of: str, priority_days: int, limit: int) -> DataFrame:
    """The next documents: those of the last days newest first, then the classes in turn, newest first in each."""
    age = F.datediff(F.to_date(F.lit(as_of)), "date")
    recent = age.between(0, priority_days)
    # by class: later days, the recent band, the rest. No place beyond the limit of a band can come out, and a turn is
    # the rank in the band after the bands before it, so that no task sorts a class
    banded = documents.withColumn("band", F.when(age < 0, 0).when(recent, 1).otherwise(2)).withColumn("recent", F.coalesce(recent, F.lit(False)))
    sizes = banded.groupBy("source_class").agg(F.count_if(F.col("band") == 0).alias("later"), F.count_if(F.col("band") <= 1).alias("both"))
    first = top_per(banded, ["source_class", "band"], limit, F.desc("date"), F.asc("document_id"), rank="turn")
    before = F.when(F.col("band") == 0, 0).when(F.col("band") == 1, F.col("later")).otherwise(F.col("both"))
    turns = first.join(sizes, "source_class").withColumn("turn", (F.col("turn") + before).cast("int")).drop("band", "later", "both")
    order = [F.desc("recent"), F.desc(F.when(F.col("recent"), F.col("date"))), F.asc(F.when(~F.col("recent"), F.col("turn"))), F.desc("date"), F.asc("document_id")]
    return turns.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def extraction_rank(source_class: Column, form: Column) -> Column:
    """Transcripts, then core filings and exhibits, then the rest."""
    return F.when(source_class == "transcript", 0).when((source_class == "filing") & F.coalesce(form, F.lit("")).isin("10-K", "10-Q", "8-K", "EX-99.1", "EX-99.2"), 1).otherwise(2)


def usage(messages: DataFrame, *group: str) -> DataFrame:
    """Summed token counters of JSON usage records."""
    n = lambda k: F.coalesce(F.get_json_object("usage", f"$.{k}").try_cast("long"), F.lit(0).cast("long"))
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return messages.groupBy(*group).agg(F.count("*").alias("requests"), *[F.sum(n(k)).alias(k) for k in names])


def job_states(attempts: DataFrame, most: int = 3) -> DataFrame:
    """job, state, attempts: from the attempts' outcomes (job, at, status); the last one decides. A failed job is queued
    again until its attempts are used up; a finished one stays so whatever comes later."""
    per = attempts.groupBy("job").agg(F.max_by("status", "at").alias("last"), F.count_if(F.col("status") == "failed").alias("attempts"), F.bool_or(F.col("status") == "succeeded").alias("done"))
    state = F.when(F.col("done"), "succeeded").when(F.col("last") == "running", "running").when(F.col("attempts") >= most, "exhausted").when(F.col("last") == "failed", "retry").otherwise("queued")
    return per.select("job", state.alias("state"), "attempts")


def backfill_cursor(days: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """key, cursor: the first day of each key that is not done, from which a backfill goes on; null where all are."""
    open_ = days.join(done.select(key, "date"), [key, "date"], "left_anti")
    return days.select(key).distinct().join(open_.groupBy(key).agg(F.min("date").alias("cursor")), key, "left")


def polling(runs: DataFrame) -> DataFrame:
    """One row: runs, fetched, inserted, skipped, failed of completed polls, and dedupe_rate, the share of what was fetched
    that was there. runs: stage, status, metadata (JSON with the counters)."""
    n = lambda k: F.coalesce(F.sum(F.get_json_object("metadata", f"$.{k}").try_cast("double")), F.lit(0.0)).cast("long").alias(k)
    done = runs.where((F.col("stage") == "poll_sources") & (F.col("status") == "completed"))
    x = done.agg(F.count("*").alias("runs"), *map(n, ("fetched", "inserted", "skipped", "failed")))
    return x.withColumn("dedupe_rate", F.when(F.col("fetched") > 0, half_up(ratio(F.col("skipped"), F.col("fetched")), 3)).otherwise(0.0))


def source_telemetry(documents: DataFrame, extraction: DataFrame, discovery: DataFrame, observations: DataFrame, rules: DataFrame, checkpoints: DataFrame, feeds: DataFrame, as_of: str, *, extraction_attempts: int = 5, discovery_attempts: int = 3, discovery_days: int = 30) -> DataFrame:
    """Per source, of documents, checkpoints or feeds: its documents, what was analysed, what waits for extraction,
    classification and discovery, its matches by review, its last attempts.

    documents: document_id, source_id, source_class, published (date), retention, category, text_hash, text_length;
    extraction and discovery: document_id, status, attempts and, for discovery, text_hash (a run each); observations:
    document_id, rule, matched, review_status; rules: rule, days (a bounded table); checkpoints: source_id, last_attempt,
    last_success, last_error; feeds: source_id, name, enabled.
    """
    today = F.to_date(F.lit(as_of))
    kept = documents.where(F.coalesce("retention", F.lit("full_text")) != "metadata_only")
    age = F.datediff(today, "published")
    busy = lambda c: F.coalesce(c, F.lit("")).isin("completed", "running")
    about = documents.groupBy("source_id").agg(F.min("source_class").alias("source_class"), F.count("*").alias("documents"), F.max("published").alias("latest"))
    runs = extraction.select("document_id", F.col("status").alias("s"), F.coalesce("attempts", F.lit(0)).alias("a"))
    read = kept.where(~((F.col("source_id") == "sec-filings") & (F.coalesce("category", F.lit("")) == "capital_markets"))).join(runs, "document_id", "left")
    extracted = read.groupBy("source_id").agg(F.count_distinct(F.when(F.col("s") == "completed", F.col("document_id"))).alias("analysed"), F.count_distinct(F.when(~busy(F.col("s")) & (F.coalesce("a", F.lit(0)) < extraction_attempts), F.col("document_id"))).alias("extraction_backlog"))
    judged = observations.select("document_id", "rule")
    open_ = eligible_within(kept.select("document_id", "published"), "document_id", "published", rules, "rule", "days", judged, as_of)
    classified = kept.join(open_, "document_id", "left_semi").groupBy("source_id").agg(F.count_distinct("document_id").alias("classification_backlog"))
    found = discovery.select("document_id", F.col("status").alias("s"), F.coalesce("attempts", F.lit(0)).alias("a"), F.col("text_hash").alias("h"), F.lit(True).alias("ran"))
    looked = kept.where(F.coalesce("text_length", F.lit(0)) > 0).join(found, "document_id", "left")
    waits = F.col("ran").isNull() | (F.col("h").isNotNull() & ~F.col("h").eqNullSafe(F.col("text_hash"))) | (~busy(F.col("s")) & (F.col("a") < discovery_attempts))
    discovered = looked.groupBy("source_id").agg(F.count_distinct(F.when((age <= discovery_days) & waits, F.col("document_id"))).alias("discovery_backlog"))
    own = observations.where("matched").join(documents.select("document_id", "source_id"), "document_id")
    matches = own.groupBy("source_id").agg(*[F.count_if(F.col("review_status") == s).alias(f"matched_{s}") for s in ("pending", "approved", "rejected")])
    ids = documents.select("source_id").union(checkpoints.select("source_id")).union(feeds.select("source_id")).distinct()
    out = telemetry(ids, "source_id", about, extracted, classified, discovered, matches).join(checkpoints, "source_id", "left").join(feeds, "source_id", "left")
    return out.select("source_id", "source_class", F.coalesce("name", "source_id").alias("label"), "enabled", "documents", "latest", "analysed", "extraction_backlog", "classification_backlog", "discovery_backlog", "matched_pending", "matched_approved", "matched_rejected", "last_attempt", "last_success", "last_error")


#: What an event makes of a job in a state; all other pairs leave it as it is.
JOB_STEPS = {
    ("none", "queue"): "queued", ("queued", "claim"): "running", ("running", "finish"): "completed", ("running", "fail"): "failed",
    ("stop_requested", "finish"): "cancelled", ("stop_requested", "fail"): "failed",
    ("queued", "stop"): "cancelled", ("running", "stop"): "stop_requested", ("stop_requested", "stop"): "cancelled",
}
LEASE_MINUTES = 5


def controlled_jobs(events: DataFrame, as_of: str, lease: int = LEASE_MINUTES) -> DataFrame:
    """job, state, last, stale: what each job's events (job, at, event) made of it, in order of time; a running job or
    one that is asked to stop, whose last event is older than the lease, has failed. A job's events are few."""
    log = events.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("log"), F.max("at").alias("last"))
    steps = F.create_map(*[F.lit(v) for (s, e), to in JOB_STEPS.items() for v in (f"{s} {e}", to)])
    walked = F.aggregate("log", F.lit("none"), lambda s, x: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(" "), x["event"])), s))
    x = log.select("job", walked.alias("state"), "last")
    stale = F.col("state").isin("running", "stop_requested") & (F.col("last") < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(mins=F.lit(lease)))
    return x.select("job", F.when(stale, "failed").otherwise(F.col("state")).alias("state"), "last", stale.alias("stale"))
