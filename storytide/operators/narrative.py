"""Narrative trends: pooled density per window, robust baselines, peaks and lifecycle states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, half_up, median_of, percentile_rank, ratio, robust_scale
from ..session import written
from .relational import calendar, first_per, rolling_distinct


@dataclass(frozen=True)
class NarrativePolicy:
    window: int = 7
    low_history_days: int = 14
    corpus_floor: int = 100
    measured_percent: float = 100.0
    peak_days: int = 90
    least_stories: int = 3
    least_owners: int = 2

    @property
    def stride(self) -> int:
        return max(1, self.window // 2)


def resolve_observations(observations: DataFrame, versions: list[str]) -> DataFrame:
    """One row per definition and document: of the compatible versions the current (first) one, then the newest."""
    rows = observations.where(F.col("prompt_version").isin(versions))
    return first_per(rows, ["definition_id", "document_id"], (F.col("prompt_version") == versions[0]).desc(), F.col("observed_at").desc_nulls_last(), F.col("prompt_version").desc(), F.col("observation_id"))


def coverage_state(corpus: Column, classified: Column, matched: Column, percent: float = 100.0) -> Column:
    share = ratio(100.0 * F.least(classified, corpus), corpus)
    return F.when(corpus == 0, "no_corpus").when(share < percent, "backfill_pending").when(matched == 0, "measured_zero").otherwise("measured")


def lifecycle(covered: Column, low_history: Column, density: Column, previous: Column, change: Column, previous_change: Column, percentile: Column, peak: Column, days_since_peak: Column, stories: Column, owners: Column, policy: NarrativePolicy = NarrativePolicy()) -> Column:
    """The state of a narrative from unrounded figures; the first rule that holds decides."""
    noise = F.greatest(F.lit(0.5), 0.1 * F.coalesce(peak, F.lit(0.0)))
    past_peak = F.coalesce(days_since_peak >= policy.window, F.lit(False))
    return (
        F.when(~covered, "unmeasured")
        .when((density <= 0) & (previous.isNull() | (previous <= 0)), "dormant")
        .when((density <= 0) | ((change <= -noise) & (previous_change <= 0)) | (past_peak & (percentile < 50) & (change <= noise)), "fading")
        .when(low_history, "emerging")
        .when((stories < policy.least_stories) | (owners < policy.least_owners), "steady")
        .when(change > noise, "rising")
        .when((percentile >= 85) & ~past_peak, "peaking")
        .otherwise("steady")
    )


@dataclass(frozen=True)
class DocumentDays:
    """single: definition_id, source_class, date, matched, raw_matched, n, weight: the documents of one day and class, counted;
    several: the observations of all other documents, null if there are none."""

    single: DataFrame
    several: DataFrame | None

    def counted(self, keys: list[str], kinds: dict[str, Column]) -> DataFrame:
        """keys, date, kind, n: the single documents of each kind."""
        of = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
        x = self.single.select(*keys, "date", F.explode(of).alias("kind"), "n")
        return x.groupBy(*keys, "date", "kind").agg(F.sum("n").alias("n"))


def _weight() -> Column:
    return F.max(F.when(F.col("raw_matched"), clamp(F.col("match_score"), 0.0, 100.0) / 100.0)).alias("weight")


def document_days(observations: DataFrame) -> DocumentDays:
    """The documents of each definition by their day: those of one day and class, mostly all, are counted in one pass and not
    listed. Their class is told by a hash, as numbers are aggregated without a sort."""
    keys, h = ["definition_id", "document_id"], F.xxhash64("source_class")
    ever = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    per = observations.groupBy(*keys).agg(F.min("date").alias("date"), F.max("date").alias("high"), F.min(h).alias("h"), F.max(h).alias("h_high"), ever("matched"), ever("raw_matched"), _weight())
    one = (F.col("date") == F.col("high")) & (F.col("h") == F.col("h_high")) & F.col("document_id").isNotNull()
    counts = written(per.groupBy("definition_id", "date", "h", "matched", "raw_matched", one.alias("one")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "document-counts")
    classes = observations.select("source_class").distinct().withColumn("h", h)
    single = written(counts.where("one").join(classes, "h").drop("h", "one"), "document-days")
    if counts.where("not one").isEmpty():
        return DocumentDays(single, None)
    x, y = observations.alias("x"), per.where(~one).alias("y")
    same = F.col("x.definition_id").eqNullSafe(F.col("y.definition_id")) & F.col("x.document_id").eqNullSafe(F.col("y.document_id"))
    return DocumentDays(single, written(x.join(y, same, "left_semi"), "document-rows"))


def pooled(observations: DataFrame, grid: DataFrame, days: int, documents: DocumentDays | None = None) -> DataFrame:
    """Per definition and day of the grid (definition_id, date, idx): density and attention of the trailing window,
    pooled over its documents.

    Each class weighs ln(1 + eligible documents). Documents are distinct over the window; attention weights
    (score over 100, the best row of a document within day and class) are summed over its days.
    """
    keys = ["definition_id", "source_class"]
    documents = documents or document_days(observations)
    one = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("document_id").cast("string").alias("m"))
    both = F.when(F.col("matched"), F.array(one("all"), one("hit"))).otherwise(F.array(one("all")))
    rest = documents.several if documents.several is not None else observations.limit(0)
    day = rest.groupBy(*keys, "date", "document_id").agg(F.bool_or("matched").alias("matched"), _weight())
    members = None
    if documents.several is not None:
        day = written(day, "document-days")
        members = day.select(*keys, "date", F.explode(both).alias("x")).select(*keys, "date", "x.kind", "x.m")
    weights = documents.single.select(*keys, "date", "weight").unionByName(day.select(*keys, "date", "weight")) if members is not None else documents.single
    daily = written(weights.groupBy(*keys, "date").agg(F.sum("weight").alias("weight")), "daily-weights")
    cells = grid.join(daily.select(*keys).distinct(), "definition_id").join(daily, [*keys, "date"], "left")
    counted = documents.counted(keys, {"all": F.lit(True), "hit": F.col("matched")})
    x = rolling_distinct(members, cells, keys, days, {"all": "eligible", "hit": "hits"}, brief=("all", "hit"), counted=counted)
    span = Window.partitionBy(*keys).orderBy("idx").rowsBetween(-(days - 1), 0)
    x = x.withColumn("attention", F.coalesce(F.sum("weight").over(span), F.lit(0.0))).where("eligible > 0")
    w = F.log1p("eligible")
    return x.groupBy("definition_id", "date").agg(ratio(F.sum(100.0 * F.col("hits") / F.col("eligible") * w), F.sum(w)).alias("density"), ratio(F.sum(100.0 * F.col("attention") / F.col("eligible") * w), F.sum(w)).alias("attention_density"))


def window_breadth(observations: DataFrame, grid: DataFrame, days: int, documents: DocumentDays | None = None, matched: DataFrame | None = None) -> DataFrame:
    """The grid (definition_id, date, idx) with the distinct documents, publishers, owners, stories, classes and entities of the trailing window.

    matched: the observations that match, if they are at hand."""
    documents = documents or document_days(observations)
    s = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("m"))
    listed = lambda df, each: df.select("definition_id", "date", F.explode(each).alias("x")).select("definition_id", "date", "x.kind", "x.m").where("m is not null")
    story = F.coalesce(F.nullif("story_fingerprint", F.lit("")), F.col("document_id").cast("string"))
    on_match = [s("publisher", F.nullif(F.col("publisher_id").cast("string"), F.lit(""))), s("owner", F.nullif("publisher_owner", F.lit(""))), s("story", story), s("class", F.col("source_class"))]
    of_match = F.concat(F.array(*on_match), F.transform("entities", lambda e: s("entity", e)))
    hits = matched if matched is not None else observations.where("matched")
    members = listed(hits, of_match)
    flags = {"classified": F.lit(True), "matched": F.col("matched"), "raw": F.col("raw_matched")}
    if documents.several is not None:
        members = members.unionByName(listed(documents.several, F.array_compact(F.array(*[F.when(c, s(k, F.col("document_id"))) for k, c in flags.items()]))))
    kinds = {"classified": "classified_documents", "matched": "matched_documents", "raw": "attention_matched_documents", "publisher": "publisher_breadth", "owner": "owner_breadth", "story": "story_breadth", "class": "class_breadth", "entity": "entity_breadth"}
    brief = tuple(flags) if documents.several is not None else ()
    return rolling_distinct(members, grid, ["definition_id"], days, kinds, brief=brief, counted=documents.counted(["definition_id"], flags))


def window_corpus(corpus: DataFrame, calendar_: DataFrame, days: int) -> DataFrame:
    """Per day of the calendar: distinct documents of the trailing window."""
    members = corpus.select(F.lit(0).alias("all"), "date", F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("m"))
    return rolling_distinct(members, calendar_.select(F.lit(0).alias("all"), "date"), ["all"], days, {"document": "corpus_documents"}, brief=("document",)).drop("all")


def tones(observations: DataFrame, grid: DataFrame, days: int) -> DataFrame:
    """Per definition and day of the grid: means of the daily mean tones above 0 of the trailing window, over matched rows."""
    daily = observations.where("matched").groupBy("definition_id", "date").agg(F.avg("risk_tone").alias("risk"), F.avg("bullish_tone").alias("bullish"))
    span = Window.partitionBy("definition_id").orderBy("idx").rowsBetween(-(days - 1), 0)
    x = grid.join(daily, ["definition_id", "date"], "left")
    return x.select("definition_id", "date", *[F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))).over(span), F.lit(0.0)).alias(f"{c}_tone") for c in ("risk", "bullish")])


def trend_series(observations: DataFrame, corpus: DataFrame, first: str, last: str, policy: NarrativePolicy = NarrativePolicy()) -> DataFrame:
    """Per definition and day of [first, last]: the window's figures, baseline, peak and lifecycle state.

    Windows are cut at the first day. The baseline samples earlier windows at a stride of half a window, from
    one window back, whole, measured and with enough corpus. The windows one and two lengths back count as
    without corpus before the first day.
    """
    spark, w, s = observations.sparkSession, policy.window, policy.stride
    inside = F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    observations, corpus = observations.where(inside), corpus.where(inside)
    days = calendar(spark, first, last)
    documents = document_days(observations)
    matched = written(observations.where("matched"), "matched")
    defined = documents.single.select("definition_id")
    if documents.several is not None:
        defined = defined.union(documents.several.select("definition_id"))
    grid = written(defined.distinct().crossJoin(F.broadcast(days)), "grid")  # a bounded calendar
    x = window_breadth(observations, grid, w, documents, matched)
    for part in (pooled(observations, grid, w, documents), tones(matched, grid, w)):
        x = x.join(part, ["definition_id", "date"], "left")
    x = x.join(window_corpus(corpus, days, w), "date", "left")
    x = x.fillna(0)
    x = x.withColumn("coverage", coverage_state(F.col("corpus_documents"), F.col("classified_documents"), F.col("matched_documents"), policy.measured_percent))
    x = x.withColumn("covered", F.col("coverage").isin("measured", "measured_zero"))
    series = Window.partitionBy("definition_id").orderBy("idx")
    ok = F.col("covered") & (F.col("corpus_documents") >= policy.corpus_floor)
    # earlier windows as (idx, density, attention); strided below
    x = x.withColumn("point", F.when(ok & (F.col("idx") >= w - 1), F.struct("idx", "density", "attention_density")))
    x = x.withColumn("past", F.collect_list("point").over(series.rowsBetween(Window.unboundedPreceding, -w)))
    x = x.withColumn("past", F.filter("past", lambda p: (F.col("idx") - w - p["idx"]) % s == 0))
    for k, back in ((1, w), (2, 2 * w)):
        x = x.withColumn(f"d{k}", F.lag("density", back).over(series)).withColumn(f"c{k}", F.coalesce(F.lag("covered", back).over(series), F.lit(False)))
    x = x.withColumn("previous", F.when(F.col("c1"), F.col("d1")))
    x = x.withColumn("change", F.when(F.col("covered") & F.col("c1"), F.col("density") - F.col("d1")).otherwise(0.0))
    x = x.withColumn("previous_change", F.when(F.col("c1") & F.col("c2"), F.col("d1") - F.col("d2")).otherwise(0.0))
    x = x.withColumn("acceleration", F.when(F.col("covered") & F.col("c1") & F.col("c2"), F.col("change") - F.col("previous_change")).otherwise(0.0))
    for name, column in (("density", "density"), ("attention", "attention_density")):
        values = F.col(f"past.{column}")
        enough = F.col("covered") & (F.size(values) >= 2)
        x = x.withColumn(f"{name}_z", F.when(enough, (F.col(column) - median_of(values)) / robust_scale(values)).otherwise(0.0))
        x = x.withColumn(f"{name}_percentile", F.when(enough, percentile_rank(values, F.col(column))).otherwise(F.lit(0)))
    x = x.withColumn("samples", F.size("past"))
    need = max(3, -(-policy.low_history_days // s))
    x = x.withColumn("low_history", ~F.col("covered") | (F.col("samples") < need))
    # the highest of the trailing windows, the latest of equals; thin windows count only as the current one
    peak = F.max(F.when(ok, F.struct("density", "idx"))).over(series.rowsBetween(-(policy.peak_days - 1), -1))
    current = F.when(F.col("covered"), F.struct("density", "idx"))
    x = x.withColumn("peak", F.greatest(peak, current))
    x = x.withColumn("peak_density", F.col("peak.density")).withColumn("days_since_peak", F.col("idx") - F.col("peak.idx"))
    x = x.withColumn("state", lifecycle(F.col("covered"), F.col("low_history"), F.col("density"), F.col("previous"), F.col("change"), F.col("previous_change"), F.col("density_percentile"), F.col("peak_density"), F.col("days_since_peak"), F.col("story_breadth"), F.col("owner_breadth"), policy))
    two = lambda c: half_up(F.col(c)).alias(c)
    x = x.select("definition_id", "date", *map(two, ("density", "attention_density", "risk_tone", "bullish_tone", "change", "acceleration", "density_z", "attention_z", "peak_density")), "density_percentile", "attention_percentile", "days_since_peak", "samples", "low_history", "coverage", "state", "corpus_documents", "classified_documents", "matched_documents", "attention_matched_documents", "publisher_breadth", "owner_breadth", "story_breadth", "class_breadth", "entity_breadth")
    return x
