"""Classifier scores and the backtest of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up, ratio
from .relational import small


def confusion(expected: Column, predicted: Column) -> list[Column]:
    return [F.count_if(expected & predicted).alias("tp"), F.count_if(~expected & predicted).alias("fp"), F.count_if(expected & ~predicted).alias("fn"), F.count_if(~expected & ~predicted).alias("tn")]


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and accuracy to three places; a ratio of nothing is 1."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.withColumns({"precision": half_up(p, 3), "recall": half_up(r, 3), "f1": half_up(f1, 3), "accuracy": half_up(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), 1.0), 3)})


def stratified(cases: DataFrame, stratum: str) -> DataFrame:
    """Scores of every stratum and of all cases ('all'). cases: expected, predicted (booleans), the stratum."""
    counts = cases.rollup(stratum).agg(*confusion(F.col("expected"), F.col("predicted")), F.grouping(stratum).alias("g"))
    return scores(counts.select(F.when(F.col("g") == 1, "all").otherwise(F.col(stratum)).alias("stratum"), "tp", "fp", "fn", "tn"))


def expand_cases(cases: DataFrame, definitions: DataFrame) -> DataFrame:
    """Labelled cases x definitions (a bounded table) with expected and predicted."""
    return cases.where("expected_slugs is not null").join(small(definitions.select("slug"))).withColumn("expected", F.array_contains("expected_slugs", F.col("slug"))).withColumn("predicted", F.array_contains("predicted_slugs", F.col("slug")))


def document_recall(cases: DataFrame) -> DataFrame:
    """The share of labelled documents with an expected narrative of which one at least was found."""
    wanted = cases.where("expected_slugs is not null and size(expected_slugs) > 0")
    hit = F.arrays_overlap("expected_slugs", "predicted_slugs")
    return wanted.agg(F.count("*").alias("documents"), F.count_if(hit).alias("found")).withColumn("document_recall", half_up(ratio(F.col("found"), F.col("documents"), 1.0), 3))


def first_fires(trends: DataFrame, signal_z: float = 2.0) -> DataFrame:
    """Per definition: the first day of each detector, the peak day, the first fading after it, the latest state."""
    when = lambda c: F.min(F.when(c, F.col("date")))
    covered = F.col("coverage").isin("measured", "measured_zero")
    first = trends.groupBy("definition_id").agg(
        when((F.col("attention_z") >= signal_z) & (F.col("attention_matched_documents") >= 2)).alias("first_attention"),
        when(covered & (F.col("density_z") >= signal_z) & (F.col("matched_documents") >= 2)).alias("first_reviewed"),
        when(F.col("state") == "emerging").alias("first_emerging"),
        when(F.col("state") == "rising").alias("first_rising"),
        F.max_by("date", F.when(covered, F.struct("density", F.negate(F.unix_date("date"))))).alias("peak_date"),
        F.max_by("state", "date").alias("latest_state"),
        F.count("*").alias("trend_days"),
    )
    fading = trends.where("state = 'fading'").select("definition_id", "date").join(first.select("definition_id", "peak_date"), "definition_id").where("date > peak_date").groupBy("definition_id").agg(F.min("date").alias("first_fading"))
    return first.join(fading, "definition_id", "left")


def backtest(timelines: DataFrame, truth: DataFrame) -> DataFrame:
    """Timelines with the true date (truth: definition_id, truth_date) and the days between detectors, definition and truth."""
    x = timelines.join(truth, "definition_id", "left")
    return x.withColumns(
        {
            "attention_lead_vs_definition": F.datediff("created", "first_attention"),
            "emerging_lead_vs_definition": F.datediff("created", "first_emerging"),
            "attention_lag_vs_truth": F.datediff("first_attention", "truth_date"),
            "emerging_lag_vs_truth": F.datediff("first_emerging", "truth_date"),
            "reviewed_lag_vs_truth": F.datediff("first_reviewed", "truth_date"),
        }
    )


def backtest_summary(rows: DataFrame) -> DataFrame:
    """Counts, medians and the shares found within 7 and 14 days of the truth (early ones too), in one row."""
    known = F.col("truth_date").isNotNull()
    within = lambda c, n: half_up(ratio(F.count_if(known & (F.col(c) <= n)), F.count_if(known), None), 3)
    return rows.agg(
        F.count("*").alias("narratives"),
        F.count_if(known).alias("with_truth"),
        F.count("first_attention").alias("with_attention_signal"),
        F.count("first_emerging").alias("with_emerging_state"),
        F.median("attention_lead_vs_definition").alias("median_attention_lead"),
        F.median("emerging_lead_vs_definition").alias("median_emerging_lead"),
        F.median("attention_lag_vs_truth").alias("median_attention_lag"),
        within("attention_lag_vs_truth", 7).alias("attention_within_7"),
        within("attention_lag_vs_truth", 14).alias("attention_within_14"),
        within("emerging_lag_vs_truth", 14).alias("emerging_within_14"),
    )
