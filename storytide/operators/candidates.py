"""Candidates for new narratives: breadth, persistence, collisions, promotion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.address import blocked_source
from ..functions.similarity import attachment_floor, collision_floor
from ..functions.text import tokens
from ..session import written
from .relational import first_per, top_per
from .setjoin import distinct_sets, jaccard_pairs, overlap_pairs


@dataclass(frozen=True)
class PromotionPolicy:
    least_score: float = 90.0
    least_stories: int = 3
    least_owners: int = 3
    window_days: int = 7
    least_span_days: float = 7.0


def breadth(evidence: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per candidate: documents, stories and owners of the trailing days."""
    return evidence.where(F.datediff(F.to_date(F.lit(as_of)), "published").between(0, days)).groupBy("candidate_id").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("story_fingerprint").alias("stories"), F.count_distinct("publisher_owner").alias("owners"), F.max("published").alias("latest"))


def queue(evidence: DataFrame, as_of: str, least_stories: int = 2, least_owners: int = 2) -> DataFrame:
    b = breadth(evidence, as_of)
    return b.withColumn("qualified", (F.col("stories") >= least_stories) & (F.col("owners") >= least_owners))


def persistence(evidence: DataFrame) -> DataFrame:
    """Per candidate: days between first and last evidence, and distinct weeks (of seven days from the epoch)."""
    day = F.unix_date("published")
    return evidence.groupBy("candidate_id").agg((F.max(day) - F.min(day)).cast("double").alias("span_days"), F.count_distinct(F.floor(day / 7)).alias("weeks"))


def attachments(evidence: DataFrame, definition_documents: DataFrame) -> DataFrame:
    """Per candidate the structural definition that shares the most of its documents, if enough; ties by name."""
    size = evidence.groupBy("candidate_id").agg(F.count_distinct("document_id").alias("n"))
    both = evidence.select("candidate_id", "document_id").distinct().join(definition_documents.select("definition_id", "name", "document_id").distinct(), "document_id").groupBy("candidate_id", "definition_id", "name").agg(F.count("*").alias("shared"))
    return first_per(both.join(size, "candidate_id").where(F.col("shared") >= attachment_floor(F.col("n"))), ["candidate_id"], F.desc("shared"), F.asc("name"), F.asc("definition_id"))


def evidence_collisions(evidence: DataFrame, definition_documents: DataFrame) -> DataFrame:
    """The pairs of candidate and definition that share two thirds of the candidate's documents, three at least."""
    size = evidence.groupBy("candidate_id").agg(F.count_distinct("document_id").alias("n"))
    both = evidence.select("candidate_id", "document_id").distinct().join(definition_documents.select("definition_id", "document_id").distinct(), "document_id").groupBy("candidate_id", "definition_id").agg(F.count("*").alias("shared"))
    return both.join(size, "candidate_id").where(F.col("shared") >= collision_floor(F.col("n")))


def _alike(a: DataFrame, b: DataFrame, words, names: float, texts: float, shared: int | None) -> DataFrame:
    """candidate_id, definition_id of the pairs whose names or propositions are alike. Both sides may be large: equal
    descriptions are compared once, and only sets that share rare words are."""
    sets = lambda d, key, of: distinct_sets(d.select(key, words(F.col(of)).alias("w")), key, "w")
    (names_a, called_a), (names_b, called_b) = sets(a, "candidate_id", "name"), sets(b, "definition_id", "name")
    (texts_a, told_a), (texts_b, told_b) = sets(a, "candidate_id", "proposition"), sets(b, "definition_id", "proposition")
    near = jaccard_pairs(names_a, names_b, names).select("a", "b")
    if shared is not None:
        near = near.union(overlap_pairs(names_a, names_b, names, shared)).distinct()
    of = lambda pairs, x, y: pairs.join(x.withColumnRenamed("id", "a"), "a").join(y.withColumnRenamed("id", "b"), "b").select("candidate_id", "definition_id")
    return of(near, called_a, called_b).union(of(jaccard_pairs(texts_a, texts_b, texts).select("a", "b"), told_a, told_b)).distinct()


def description_collisions(candidates: DataFrame, definitions: DataFrame) -> DataFrame:
    """The pairs of candidate and definition whose descriptions say the same: names with half of their words or,
    of three shared words at least, half of the shorter's, or propositions with 0.55 of theirs."""
    return _alike(candidates, definitions, tokens, 0.5, 0.55, 3)


def discovery_duplicates(candidates: DataFrame, definitions: DataFrame) -> DataFrame:
    """The pairs of a new candidate and one that is there that are the same: 0.74 of the names' words or 0.72 of the
    propositions'; words as they are, with the stop words of discovery."""
    return _alike(candidates, definitions, lambda x: tokens(x, lists.DISCOVERY_STOPWORDS, synonyms=False), 0.74, 0.72, None)


def promotable(evidence: DataFrame, as_of: str, definition_documents: DataFrame, policy: PromotionPolicy = PromotionPolicy()) -> DataFrame:
    """Candidates with enough strong, recent, independent evidence that last, or attach to a structural theme, and collide with none."""
    recent = evidence.where((F.col("score") >= policy.least_score) & F.datediff(F.to_date(F.lit(as_of)), "published").between(0, policy.window_days))
    b = recent.groupBy("candidate_id").agg(F.count_distinct("story_fingerprint").alias("stories"), F.count_distinct("publisher_owner").alias("owners")).where((F.col("stories") >= policy.least_stories) & (F.col("owners") >= policy.least_owners))
    out = b.join(persistence(evidence), "candidate_id").join(attachments(evidence, definition_documents).select("candidate_id", F.col("definition_id").alias("attached_to")), "candidate_id", "left")
    out = out.where((F.col("span_days") >= policy.least_span_days) | F.col("attached_to").isNotNull())
    return out.join(evidence_collisions(evidence, definition_documents).select("candidate_id").distinct(), "candidate_id", "left_anti")


#: A candidate with more rows than this is large; the shares by which a large one's rows are counted off.
LARGE, SHARES = 50_000, 64
_KEYS = ("snippet_key", "title_key", "near_key")


def _contenders(evidence: DataFrame, most: int, order: Sequence[Column]) -> DataFrame:
    """The evidence without rows that can't be selected, whatever else there is: for ten selected ones at most 27 730 rows
    of a candidate are left, and no task orders all of them.

    A row is left out if enough rows that share keys with it stand before it. Suppose it were selected. Then at most
    m = `most` - 1 rows are by then, none with a key of its, so that rows with a key of its were all rejected for other
    keys. After a row of its three keys that can't be. Of rows that share two keys with it and have no third in common, the
    selected ones reject at most m; of rows that share one key with it and no other with each other, at most 2 m. As m + 1 of
    each pair are left, each of those meets at most 2 m others, so that 2 m (2 m + 1) + 1 of one key hold 2 m + 1 that don't
    meet. Of rows that share no key with each other, 3 m at most are selected or rejected, and a row meets at most
    3 (one - 1) others.
    """
    m = most - 1
    one = 2 * m * (2 * m + 1) + 1
    all_ = 3 * m * (3 * (one - 1) + 1) + 1
    own = [f"__{c}" for c in _KEYS]
    alone = lambda c: F.struct(c, F.when(F.col(c).isNull(), F.monotonically_increasing_id()))  # noqa: E731 - a missing key is equal to no other
    rows = evidence.withColumns({o: alone(c) for o, c in zip(own, _KEYS, strict=True)})
    for n, k in ((3, 1), (2, most), (1, one)):
        for keys in combinations(own, n):
            rows = top_per(rows, ["candidate_id", *keys], k, *order)
    rows = rows.withColumn("__share", F.pmod(F.xxhash64("document_id", *own), F.lit(SHARES)))
    return top_per(top_per(rows, ["candidate_id", "__share"], all_, *order), ["candidate_id"], all_, *order).drop(*own, "__share")


def selected_evidence(evidence: DataFrame, most: int = 10) -> DataFrame:
    """Per candidate, by score, date and id: evidence whose snippet, title and near-duplicate key are all unseen, at most `most`.

    Rows come sorted by candidate, and the greedy choice is made for all candidates of an Arrow batch at once; what is
    selected of its last candidate stands before the next batch. Large candidates are thinned out first.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = lambda t, c: t[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

        def told(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            rank = np.arange(len(group)) - np.searchsorted(group, group) + 1
            yield from t.select(["candidate_id", "document_id", "score"]).append_column("rank", pa.array(rank, pa.int32())).to_batches()

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if not t.num_rows:
                continue
            candidate, keys = codes(t, "candidate_id"), [codes(t, c) for c in _KEYS]
            group = np.cumsum(np.diff(candidate, prepend=candidate[0]) != 0)
            left, picked = np.arange(t.num_rows), []
            for _ in range(most):
                first = np.diff(group[left], prepend=-1) != 0
                heads = left[first]
                picked.append(heads)
                head = heads[np.cumsum(first) - 1]  # of each row that is left, the row selected last
                ok = ~first
                for k in keys:
                    ok &= (k[left] < 0) | (k[left] != k[head])
                left = left[ok]
                if not len(left):
                    break
            pick = np.sort(np.concatenate(picked))
            ended = group[pick] < group[-1]
            yield from told(t.take(pick[ended]), group[pick[ended]])
            held = t.take(pick[~ended])
        if held is not None:
            yield from told(held, np.zeros(held.num_rows, int))

    order = [F.desc("score"), F.desc("published"), F.asc("document_id"), *map(F.asc, _KEYS)]
    slim = evidence.select("candidate_id", "document_id", F.col("score").cast("double").alias("score"), "published", *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in _KEYS])
    large = written(slim.groupBy("candidate_id").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("candidate_id"), "large")
    if not large.isEmpty():
        large = F.broadcast(large)  # one in `LARGE` rows at most
        slim = slim.join(large, "candidate_id", "left_anti").unionByName(_contenders(slim.join(large, "candidate_id", "left_semi"), most, order))
    ordered = slim.repartition("candidate_id").sortWithinPartitions("candidate_id", *order).drop("published")
    return ordered.mapInArrow(choose, f"candidate_id {slim.schema['candidate_id'].dataType.simpleString()}, document_id {slim.schema['document_id'].dataType.simpleString()}, score double, rank int")


#: What a promotion never goes below, and the days that its evidence never goes beyond, fixed values.
FLOORS = PromotionPolicy()


def bounded(policy: PromotionPolicy) -> PromotionPolicy:
    """The policy, no looser than the floors."""
    return PromotionPolicy(max(FLOORS.least_score, policy.least_score), max(FLOORS.least_stories, policy.least_stories), max(FLOORS.least_owners, policy.least_owners), min(FLOORS.window_days, max(1, policy.window_days)), policy.least_span_days)


def promotion_queue(candidates: DataFrame, evidence: DataFrame, parents: DataFrame, as_of: str, policy: PromotionPolicy = FLOORS, limit: int = 5, unreliable: Sequence[str] = tuple(lists.UNRELIABLE)) -> DataFrame:
    """candidate_id, stories, owners, latest, persistent, turn: the next candidates to validate, those with the newest
    evidence first, `limit` at most; those that aren't persistent wait.

    candidates: candidate_id, status, validation (status of the last validation), evaluated, updated (times); pending ones
    without a sound validation, or changed since, are judged. evidence: candidate_id, document_id, published (time), score,
    text_hash (of the text that was judged), content_hash (of the text now), content, owner, publisher, platform, url,
    story. It counts if it is strong, recent, of the text as it is now, no preview, and of no unreliable source.
    parents: definition_id, document_id of active structural definitions. A candidate persists if its strong evidence
    spans enough days, or if a parent shares half of its documents, two at least. The policy can't loosen the floors.
    """
    p, now = bounded(policy), F.to_timestamp(F.lit(as_of))
    again = (F.coalesce("validation", F.lit("")).isin("", "eligible")) | F.col("evaluated").isNull() | (F.col("updated") > F.col("evaluated"))
    open_ = candidates.where((F.col("status") == "pending") & again).select("candidate_id")
    strong = evidence.join(open_, "candidate_id", "left_semi").where((F.col("score") >= p.least_score))
    source = F.trim(F.lower(F.coalesce(F.nullif(F.trim("owner"), F.lit("")), F.col("publisher"))))
    clean = ~blocked_source(source, F.trim("publisher"), F.col("platform"), F.col("url"), F.array(*[F.lit(v.lower()) for v in unreliable]))
    fresh = F.col("published").between(now - F.make_dt_interval(days=F.lit(p.window_days)), now)
    recent = strong.where(fresh & F.col("text_hash").eqNullSafe(F.col("content_hash")) & (F.lower(F.coalesce("content", F.lit(""))) != "preview") & clean)
    b = recent.groupBy("candidate_id").agg(F.count_distinct("story").alias("stories"), F.count_distinct(F.nullif(source, F.lit(""))).alias("owners"), F.max("published").alias("latest"))
    b = b.where((F.col("stories") >= p.least_stories) & (F.col("owners") >= p.least_owners))
    past = strong.where(F.col("published") <= now)
    span = past.groupBy("candidate_id").agg(((F.unix_micros(F.max("published")) - F.unix_micros(F.min("published"))) / 86_400e6).alias("span_days"))
    total = strong.groupBy("candidate_id").agg(F.count_distinct("document_id").alias("n"))
    both = strong.select("candidate_id", "document_id").distinct().join(parents.select("definition_id", "document_id").distinct(), "document_id").groupBy("candidate_id", "definition_id").agg(F.count("*").alias("shared"))
    attached = both.join(total, "candidate_id").where(F.col("shared") >= attachment_floor(F.col("n"))).select("candidate_id").distinct().withColumn("attached", F.lit(True))
    x = b.join(span, "candidate_id", "left").join(attached, "candidate_id", "left")
    x = x.withColumn("persistent", F.coalesce(F.col("span_days") >= p.least_span_days, F.lit(False)) | F.coalesce("attached", F.lit(False)))
    order = [F.desc("latest"), F.asc("candidate_id")]
    return x.orderBy(*order).limit(limit).withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).select("candidate_id", "stories", "owners", "latest", "persistent", "turn")


def promotion_verdicts(decisions: DataFrame, verdicts: DataFrame, policy: PromotionPolicy = FLOORS) -> DataFrame:
    """candidate_id, status, reasons, supported, stories, events, entities, owners, classes of validated candidates.

    decisions: candidate_id, decision (approve, manual_review or other), kind (event, else structural), event_label,
    exclusion; verdicts, one for each item: candidate_id, evidence_id, verdict, supports, violates, event_key, entity_key,
    story, owner, source_class. An item supports if all three say so. Empty keys are missing keys. A candidate without
    reasons is eligible, one that the validator leaves to people is manual_review, any other ineligible.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    key = lambda c: F.nullif(F.trim(c), F.lit(""))
    ok = (F.col("verdict") == "support") & said("supports") & ~said("violates")
    per = verdicts.where(ok).groupBy("candidate_id").agg(
        F.count("*").alias("supported"), F.count_distinct("story").alias("stories"), F.count_distinct(key("event_key")).alias("events"), F.count_distinct(key("entity_key")).alias("entities"),
        F.count_distinct(key("owner")).alias("owners"), F.count_distinct("source_class").alias("classes"), F.count_if(key("event_key").isNull()).alias("no_event"), F.count_if(key("entity_key").isNull()).alias("no_entity"),
    )
    x = decisions.join(per, "candidate_id", "left").fillna(0, ["supported", "stories", "events", "entities", "owners", "classes", "no_event", "no_entity"])
    event, decision = F.coalesce(F.col("kind") == "event", F.lit(False)), F.coalesce("decision", F.lit(""))
    tests = (
        (decision == "manual_review", "VALIDATOR_REQUIRES_MANUAL_REVIEW"),
        (~decision.isin("manual_review", "approve"), "VALIDATOR_REJECTED"),
        (F.col("stories") < policy.least_stories, "INSUFFICIENT_UNIQUE_STORIES"),
        (F.col("owners") < policy.least_owners, "INSUFFICIENT_PUBLISHER_OWNERS"),
        (F.col("no_event") > 0, "MISSING_EVENT_KEYS"),
        (F.col("no_entity") > 0, "MISSING_PRIMARY_ENTITY_KEYS"),
        (event & (F.trim(F.coalesce("event_label", F.lit(""))) == ""), "EVENT_LABEL_REQUIRED"),
        (event & (F.col("events") != 1), "EVENT_KEY_MUST_BE_SINGULAR"),
        (~event & (F.col("events") < 2) & (F.col("entities") < 2), "STRUCTURAL_REQUIRES_MULTIPLE_EVENTS_OR_ENTITIES"),
        (~event & (F.col("classes") < 2) & (F.col("events") < 2), "STRUCTURAL_REQUIRES_SOURCE_OR_EVENT_BREADTH"),
        (F.coalesce("exclusion", F.lit("")).rlike("(?i)single[- ]company") & (F.col("entities") < 2), "SINGLE_COMPANY_EXCLUSION_VIOLATED"),
    )
    reasons = F.array_compact(F.array(*[F.when(test, code) for test, code in tests]))
    x = x.withColumn("reasons", reasons)
    status = F.when(F.size("reasons") == 0, "eligible").when(decision == "manual_review", "manual_review").otherwise("ineligible")
    return x.select("candidate_id", status.alias("status"), "reasons", "supported", "stories", "events", "entities", "owners", "classes")
