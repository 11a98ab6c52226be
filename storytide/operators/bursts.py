"""Attention bursts: terms whose stories surge against the weeks before."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.numeric import half_up, mad_of, mean_of
from ..functions.text import normalise_term, title_ngrams
from .containment import containing


@dataclass(frozen=True)
class BurstPolicy:
    window: int = 7
    baseline: int = 84
    least_stories: int = 3
    least_owners: int = 2
    least_z: float = 2.0
    results: int = 60


#: Documents a task takes when terms are listed.
DOCUMENTS_A_TASK = 20_000


def burst_terms(documents: DataFrame) -> DataFrame:
    """documents x term, kind: title n-grams, entities and labels; within a document a later kind wins (n-gram, entity, label).

    Documents are dealt out by id before their terms are listed, so many to a task: a small file holds a great many short
    titles, and what counts by document and term needs no further exchange.
    """
    slim = documents.select("document_id", "date", "story_fingerprint", "publisher_owner", "title", "entities", "theme_labels")
    documents = slim.repartition(max(1, -(-documents.count() // DOCUMENTS_A_TASK)), "document_id")
    entity = F.filter(F.transform("entities", normalise_term), lambda e: (F.length(e) >= 3) & ~e.isin(lists.GENERIC_ENTITIES) & ~e.isin(lists.TITLE_STOPWORDS))
    label = F.filter(F.transform("theme_labels", normalise_term), lambda e: F.length(e) >= 4)
    tag = lambda a, kind: F.transform(a, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<string>")
    terms = F.concat(tag(title_ngrams(F.col("title")), 0), tag(F.coalesce(entity, none), 1), tag(F.coalesce(label, none), 2))
    rows = documents.withColumn("t", F.explode(terms)).select("document_id", "date", "story_fingerprint", "publisher_owner", "t.term", "t.kind")
    return rows.groupBy("document_id", "date", "story_fingerprint", "publisher_owner", "term").agg(F.max("kind").alias("kind"))


def term_windows(terms: DataFrame, as_of: str, policy: BurstPolicy = BurstPolicy()) -> DataFrame:
    """Per term and window (0 is the current, then adjacent ones backwards): distinct stories and owners."""
    age = F.datediff(F.to_date(F.lit(as_of)), "date")
    rows = terms.where((age >= 0) & (age < policy.window + policy.baseline)).withColumn("window", F.floor(age / policy.window).cast("int"))
    return rows.groupBy("term", "window").agg(F.count_distinct("story_fingerprint").alias("stories"), F.count_distinct(F.nullif("publisher_owner", F.lit(""))).alias("owners"))


def scored_terms(terms: DataFrame, as_of: str, policy: BurstPolicy = BurstPolicy()) -> DataFrame:
    """The terms that burst: enough stories and owners now, and novel or far above the windows before, of which those without a story count as 0."""
    weeks = policy.baseline // policy.window
    per = term_windows(terms, as_of, policy).groupBy("term").agg(
        F.max(F.when(F.col("window") == 0, F.col("stories"))).alias("stories"),
        F.max(F.when(F.col("window") == 0, F.col("owners"))).alias("owners"),
        F.map_from_entries(F.collect_list(F.struct("window", F.col("stories").cast("double")))).alias("by_window"),  # weeks + 1 entries at most
    )
    per = per.where((F.col("stories") >= policy.least_stories) & (F.col("owners") >= policy.least_owners))
    per = per.withColumn("history", F.transform(F.sequence(F.lit(1), F.lit(weeks)), lambda k: F.coalesce(F.try_element_at("by_window", k), F.lit(0.0))))
    mean, mad = mean_of(F.col("history")), mad_of(F.col("history"))
    per = per.withColumn("baseline_mean", mean).withColumn("scale", F.greatest(F.lit(1.0), F.sqrt(F.greatest(mean, F.lit(0.0))), mad))
    per = per.withColumn("z", (F.col("stories") - F.col("baseline_mean")) / F.col("scale")).withColumn("novel", F.forall("history", lambda v: v == 0))
    kind = terms.where(F.datediff(F.to_date(F.lit(as_of)), "date").between(0, policy.window + policy.baseline - 1)).groupBy("term").agg(F.coalesce(F.min_by(F.when(F.col("kind") > 0, F.col("kind")), F.when(F.col("kind") > 0, F.struct("date", "document_id"))), F.lit(0)).alias("kind"))
    out = per.where(F.col("novel") | (F.col("z") >= policy.least_z)).join(kind, "term")
    names = F.element_at(F.array(*map(F.lit, ("title_ngram", "entity", "theme_label"))), F.col("kind") + 1)
    return out.select("term", names.alias("kind"), "stories", "owners", half_up(F.col("baseline_mean")).alias("baseline_mean"), half_up(F.col("z")).alias("z_score"), "novel", half_up(F.when(F.col("novel"), F.col("stories") + F.col("z")).otherwise(F.col("z"))).alias("score"))


def rank_order() -> list:
    return [F.desc("score"), F.desc("owners"), F.desc(F.size(F.split("term", " "))), F.asc("term")]


def without_nested(bursts: DataFrame, limit: int = 60) -> DataFrame:
    """In rank order, drops a title n-gram that a kept one with the same stories contains or is contained by; then the first `limit`.

    Only terms with the same number of stories are compared, so each number's terms are one group; the first `limit`
    that a group keeps are all that can come out of it.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, int]] = []
        rows = []
        for i, r in enumerate(pdf.sort_values("rank").itertuples()):
            if r.kind == "title_ngram":
                if any(n == r.stories and (t in r.term or r.term in t) for t, n in kept):
                    continue
                kept.append((r.term, r.stories))
            rows.append(i)
            if len(rows) == limit:
                break
        return pdf.sort_values("rank").iloc[rows]

    ranked = bursts.withColumn("rank", F.row_number().over(Window.partitionBy("stories").orderBy(*rank_order())))
    kept = ranked.groupBy("stories").applyInPandas(lambda pdf: keep(pdf), ranked.schema).drop("rank").orderBy(*rank_order()).limit(limit)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*rank_order())))


def covering(bursts: DataFrame, definitions: DataFrame) -> DataFrame:
    """bursts x definitions: the definitions whose name, proposition, criteria or examples hold the term."""
    text = F.lower(F.concat_ws(" ", "name", "proposition", "inclusion", "examples"))
    texts = definitions.select("definition_id", F.xxhash64("definition_id", text).alias("k"), text.alias("haystack"))  # an id may have several
    hits = containing(texts, "k", "haystack", bursts, "term").join(texts.select("k", "definition_id"), "k")
    found = hits.groupBy("term").agg(F.array_sort(F.collect_set("definition_id")).alias("covering"))
    return bursts.join(found, "term", "left").select(*bursts.columns, F.coalesce("covering", F.array().cast(found.schema["covering"].dataType)).alias("covering"))
