"""Review of observations: corroboration, inheritance, definition lifecycle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.address import blocked_source
from .relational import first_per, window_ends


@dataclass(frozen=True)
class ReviewPolicy:
    least_score: float = 90.0
    window_days: int = 7
    least_stories: int = 2
    least_owners: int = 2


STRUCTURAL = ReviewPolicy(least_score=70.0, window_days=14)


def corroborated(observations: DataFrame, as_of: str, policy: ReviewPolicy = ReviewPolicy(), unreliable: Sequence[str] = tuple(lists.UNRELIABLE)) -> DataFrame:
    """The pending observations to approve, with the stories and owners that corroborate them.

    observations: definition_id, observation_id, document_id, published (date), matched, review_status, score,
    snippet, content, story_fingerprint, publisher_owner, and optionally publisher, platform, url, blocked, seed, satisfied,
    preview. Evidence of `unreliable` owners, publishers, platforms and hosts counts for nothing.
    The best row of a story stands for it; a definition needs enough stories and owners over these rows.
    """
    has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in observations.columns else F.lit(d)
    age = F.datediff(F.to_date(F.lit(as_of)), "published")
    said = lambda c: F.col(c) if c in observations.columns else F.lit(None).cast("string")
    if unreliable:
        values = F.array(*[F.lit(v.lower()) for v in unreliable])
        observations = observations.where(~blocked_source(F.col("publisher_owner"), said("publisher"), said("platform"), said("url"), values))
    rows = observations.where(F.col("matched") & F.col("review_status").isin("pending", "approved") & (F.col("score") >= policy.least_score) & (F.coalesce("snippet", F.lit("")) != "") & age.between(0, policy.window_days) & ~has("blocked", False) & ~has("seed", False) & has("satisfied", True) & ~has("preview", False) & F.expr("instr(content, snippet) > 0"))
    best = first_per(rows, ["definition_id", "story_fingerprint"], F.desc("score"), F.desc("published"), F.asc("observation_id"))
    breadth = best.groupBy("definition_id").agg(F.count_distinct("story_fingerprint").alias("stories"), F.count_distinct("publisher_owner").alias("owners"))
    passed = breadth.where((F.col("stories") >= policy.least_stories) & (F.col("owners") >= policy.least_owners))
    return best.where("review_status = 'pending'").join(passed, "definition_id").select("definition_id", "observation_id", "document_id", "story_fingerprint", "score", "stories", "owners")


def historical_windows(observations: DataFrame, as_of: str, recent_days: int, skip_days: int, limit: int = 120) -> DataFrame:
    """The publication days (before the recent window) of evidence observed lately: each is judged again in the window
    that ends on it. The latest `limit`, oldest first."""
    late = observations.where((F.datediff(F.to_date(F.lit(as_of)), "observed").between(0, recent_days)) & (F.datediff(F.to_date(F.lit(as_of)), "published") > skip_days))
    return late.groupBy(F.col("published").alias("window_end")).agg(F.count("*").alias("observations")).orderBy(F.desc("window_end")).limit(limit).orderBy("window_end")


def corroborated_windows(observations: DataFrame, ends: DataFrame, policy: ReviewPolicy = ReviewPolicy()) -> DataFrame:
    """corroborated() for many window ends at once: per end and definition the stories, owners and pending rows."""
    rows = observations.where(F.col("matched") & F.col("review_status").isin("pending", "approved") & (F.col("score") >= policy.least_score))
    rows = window_ends(rows, policy.window_days + 1, "published", "window_end").join(F.broadcast(ends.select("window_end")), "window_end")  # a bounded list of days
    best = first_per(rows, ["window_end", "definition_id", "story_fingerprint"], F.desc("score"), F.desc("published"), F.asc("observation_id"))
    out = best.groupBy("window_end", "definition_id").agg(F.count_distinct("story_fingerprint").alias("stories"), F.count_distinct("publisher_owner").alias("owners"), F.count_if(F.col("review_status") == "pending").alias("pending"))
    return out.where((F.col("stories") >= policy.least_stories) & (F.col("owners") >= policy.least_owners))


def inherit_reviews(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """The review status of re-classified observations.

    A human decision passes on when snippet, text hash and definition version are unchanged; a human decision
    stays while hash and version do; everything else, automatic approvals too, is pending again.
    """
    old = stored.select("definition_id", "document_id", F.col("snippet").alias("old_snippet"), F.col("text_hash").alias("old_hash"), F.col("definition_version").alias("old_version"), F.col("review_status").alias("old_status"), F.col("actor_type").alias("old_actor"))
    same = F.col("text_hash").eqNullSafe(F.col("old_hash")) & F.col("definition_version").eqNullSafe(F.col("old_version"))
    human = (F.col("old_actor") == "human") & F.col("old_status").isin("approved", "rejected")
    keeps = F.coalesce(human & same, F.lit(False))
    out = fresh.join(old, ["definition_id", "document_id"], "left")
    return out.select(*fresh.columns, F.when(keeps, F.col("old_status")).otherwise("pending").alias("review_status"), F.coalesce(keeps & F.col("snippet").eqNullSafe(F.col("old_snippet")), F.lit(False)).alias("inherited"), keeps.alias("kept"))


def definition_lifecycle(definitions: DataFrame, evidence: DataFrame, as_of: str, days: int = 7, least_stories: int = 3, least_owners: int = 3) -> DataFrame:
    """definition_id, status, new_status: events past their expiry expire; probationary definitions with enough approved recent evidence become active."""
    recent = evidence.where(F.datediff(F.to_date(F.lit(as_of)), "published").between(0, days) & (F.col("review_status") == "approved")).groupBy("definition_id").agg(F.count_distinct("story_fingerprint").alias("stories"), F.count_distinct("publisher_owner").alias("owners"))
    d = definitions.join(recent, "definition_id", "left")
    expired = (F.col("kind") == "event") & (F.col("expires") <= F.to_date(F.lit(as_of)))
    gate = (F.col("status") == "probationary") & (F.col("stories") >= least_stories) & (F.col("owners") >= least_owners)
    new = F.when(F.col("status").isin("active", "probationary") & expired, "expired").when(gate, "active").otherwise(F.col("status"))
    return d.select("definition_id", "status", new.alias("new_status"), F.coalesce("stories", F.lit(0)).alias("stories"), F.coalesce("owners", F.lit(0)).alias("owners"))
