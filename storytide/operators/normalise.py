"""Validation of model output: signals, observations, theme groups and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp
from ..functions.text import contains_loosely, evidence_reasons, slug, squeezed
from . import guards
from .relational import first_per, running_sums, small, top_per

#: The directions of tone, fixed values.
STANCES = ("risk", "bullish", "mixed", "neutral")


def valid_signals(signals: DataFrame) -> DataFrame:
    """Signals with a label, tones and confidence from 0 to 100 and a quotation that the text holds; one per document, theme and snippet."""
    ok = (F.trim(F.coalesce("label", F.lit(""))) != "") & F.col("risk_tone").between(0, 100) & F.col("bullish_tone").between(0, 100) & F.col("confidence").between(0, 100) & (F.trim(F.coalesce("snippet", F.lit(""))) != "") & contains_loosely(F.col("content"), F.col("snippet"))
    rows = signals.where(ok).withColumn("theme_id", F.concat(F.lit("theme:"), slug(F.col("label"), default="uncategorized"))).withColumn("__s", squeezed(F.col("snippet")))
    return first_per(rows, ["document_id", "theme_id", "__s"], F.desc("confidence"), F.asc("signal_id")).drop("__s")


def normalise_observations(raw: DataFrame, documents: DataFrame, definitions: DataFrame) -> DataFrame:
    """A row per document and definition (a bounded table): matches that meet every condition; what the model left out is no match.

    A match needs matched, the contract satisfied, no exclusion, a score of 70 and a quotation in the text;
    other scores are at most 69.
    """
    grid = documents.select("document_id", "content").join(small(definitions.select("definition_id")))
    x = grid.join(raw, ["document_id", "definition_id"], "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    matched = f("matched") & f("satisfied") & ~f("excluded") & (F.coalesce("score", F.lit(0.0)) >= 70) & F.coalesce(contains_loosely(F.col("content"), F.col("snippet")), F.lit(False))
    score = clamp(F.coalesce(F.col("score"), F.lit(0.0)), 0.0, 100.0)
    return x.select("document_id", "definition_id", matched.alias("matched"), F.when(matched, score).otherwise(F.least(score, F.lit(69.0))).alias("score"), F.when(matched, F.col("snippet")).alias("snippet"))


def classified_observations(raw: DataFrame, documents: DataFrame, definitions: DataFrame) -> DataFrame:
    """A row per document and definition: document_id, definition_id, matched, score, stance, risk_tone, bullish_tone,
    evidence, interpretation, entities.

    raw: what a model said: document_id, definition_id (each pair once), matched, satisfied, exclusions (array), score,
    evidence, interpretation, stance, risk_tone, bullish_tone, entities; documents: document_id, text; definitions, a bounded
    table: definition_id, metadata (JSON with its evidence contract), proposition. A match needs to be said, the contract
    satisfied, no exclusion, a score of 70, evidence that the text holds as it is, the definition's patterns and term
    groups met, and no reason of evidence quality against it. Scores of others are 69 at most. Pairs that the model left
    out, and raw rows of unknown definitions or documents, are no matches and no rows. Texts are only read for pairs that
    pass all other conditions.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    cut = lambda c, n: F.substring(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", ""), 1, n)
    listed = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    score = clamp(F.coalesce(F.col("score"), F.lit(0.0)), 0.0, 100.0)
    own = raw.withColumns({"score": score, "evidence": cut("evidence", 800), "excluded": F.size(listed("exclusions")) > 0})
    asked = own.where(said("matched") & said("satisfied") & ~F.col("excluded") & (F.col("score") >= 70) & (F.col("evidence") != "")).select("document_id", "definition_id", "evidence", "interpretation")
    held = asked.join(small(guards.contracts(definitions).join(definitions.select("definition_id", "proposition"), "definition_id")), "definition_id")
    held = held.where(guards.passes(F.col("evidence"), F.col("required"), F.col("forbidden"), F.col("groups")))
    held = held.where(F.size(evidence_reasons(F.col("evidence"), F.coalesce("interpretation", F.lit("")), F.coalesce("proposition", F.lit("")))) == 0)
    found = held.join(documents.select("document_id", "text"), "document_id").where(F.contains("text", "evidence")).select("document_id", "definition_id", F.lit(True).alias("found"))
    grid = documents.select("document_id").join(small(definitions.select("definition_id")))  # the result has a row for each
    x = grid.join(own, ["document_id", "definition_id"], "left").join(found, ["document_id", "definition_id"], "left")
    match, tone = F.coalesce("found", F.lit(False)), lambda c: clamp(F.coalesce(F.col(c), F.lit(0.0)), 0.0, 100.0)
    stance = F.when(F.col("stance").isin(*STANCES), F.col("stance")).otherwise("neutral")
    best = F.coalesce("score", F.lit(0.0))
    return x.select("document_id", "definition_id", match.alias("matched"), F.when(match, best).otherwise(F.least(best, F.lit(69.0))).alias("score"), stance.alias("stance"), tone("risk_tone").alias("risk_tone"), tone("bullish_tone").alias("bullish_tone"), F.when(match, F.col("evidence")).otherwise("").alias("evidence"), F.when(match, cut("interpretation", 1000)).otherwise("").alias("interpretation"), F.slice(listed("entities"), 1, 20).alias("entities"))


def normalised_theme_id(level: Column, label: Column, sector: Column) -> Column:
    return F.concat(F.lit("theme:"), level, F.lit(":"), slug(F.when(level == "sector", F.concat_ws(":", sector, label)).otherwise(label)))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 80, "high").when(confidence >= 60, "medium").otherwise("low")


def theme_groups(signals: DataFrame, limit: int, representatives: int = 3) -> DataFrame:
    """The themes with the most signals and their best ones (a lateral top 3). signal_count counts the representatives."""
    counted = signals.groupBy("theme_id").agg(F.count("*").alias("total")).orderBy(F.desc("total"), F.asc("theme_id")).limit(limit)
    best = top_per(signals.join(counted, "theme_id"), ["theme_id"], representatives, F.desc("score"), F.asc("signal_id"))
    return best.groupBy("theme_id", "total").agg(F.count("*").alias("signal_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.negate("score").alias("o"), "signal_id"))), lambda x: x["signal_id"].cast("string")), ",").alias("representatives"))


def mapping_status(signals: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per mapped theme: signals (one for each of their entities, one at least), and the distinct entities in order."""
    exploded = signals.withColumn("entity", F.explode_outer("entities")).join(mappings, "theme_id")
    return exploded.groupBy("canonical_theme_id").agg(F.count("signal_id").alias("signal_rows"), F.count_distinct("theme_id").alias("themes"), F.array_join(F.slice(F.array_sort(F.collect_set("entity")), 1, 3), ",").alias("top_entities"))


def apply_mappings(signals: DataFrame, mappings: DataFrame, least: float = 80.0) -> DataFrame:
    """Signals with the canonical theme of mappings that are sure enough to apply."""
    sure = mappings.where(F.col("confidence") >= least).select("theme_id", F.col("canonical_theme_id").alias("__to"))
    return signals.join(sure, "theme_id", "left").withColumn("canonical_theme_id", F.coalesce("__to", "canonical_theme_id")).drop("__to")


def sequence(df: DataFrame, *order: Column) -> DataFrame:
    """A dense number from 1 over all rows in a total order, counted range by range."""
    return running_sums(df, [], order, {"seq": F.lit(1)})
