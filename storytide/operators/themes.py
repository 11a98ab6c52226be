"""Theme trends: contributions, daily buckets, window scores, publication."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import deviation_of, half_up, mean_of, percentile_rank
from ..session import written
from ..sources.sinks import DayTable
from .relational import calendar, member_days, rolling_distinct, top_per


@dataclass(frozen=True)
class TrendPolicy:
    lookback_days: int = 120
    storage_days: int = 45
    windows: tuple[int, ...] = (7, 30)
    low_history: int = 14
    least_z: float = 1.8
    least_percentile: int = 90
    least_evidence: int = 2


def score_contribution(risk: Column, bullish: Column, confidence: Column, transcript: Column) -> Column:
    """The stronger tone times the confidence, a tenth more for transcripts, to three places."""
    return half_up(F.greatest(risk, bullish) / 100.0 * confidence / 100.0 * F.when(transcript, 1.1).otherwise(1.0), 3)


def promotes(z: Column, percentile: Column, evidence: Column, policy: TrendPolicy = TrendPolicy()) -> Column:
    return (z >= policy.least_z) & (percentile >= policy.least_percentile) & (evidence >= policy.least_evidence)


def contributions(signals: DataFrame, themes: DataFrame, between: tuple[str, str] | None = None) -> DataFrame:
    """theme_id, trend_level and the signal's columns: a row for the market theme and one for the sector theme, if any.

    A signal whose two themes are equal counts twice. Themes that are not listed drop out. A theme's level
    is that of its non-sector rows where it has any; between them, that of the smallest document, then signal.
    The signals are read once, and their rows written, as levels and all that follows read them several times.
    between: a first and a last day; then the signals are read twice, for the levels, which all days make, and for the rows
    of these days, which alone are written.
    """
    keep = ["signal_id", "document_id", "date", "source_class", "entities", "score"]
    theme = lambda t, level: F.struct(t.alias("theme_id"), level.alias("level"))
    market = theme(F.coalesce("canonical_theme_id", "theme_id"), F.when(F.col("canonical_theme_id").isNull(), "unmapped").otherwise("market"))
    sector = F.when(F.col("canonical_subtheme_id").isNotNull(), theme(F.col("canonical_subtheme_id"), F.lit("sector")))
    rows = signals.select(F.explode(F.array_compact(F.array(market, sector))).alias("x"), *keep).select("x.*", *keep)
    rows = rows.join(themes.select("theme_id"), "theme_id", "left_semi")
    if between is None:
        rows = written(rows, "contributions")
    level = rows.groupBy("theme_id").agg(F.min_by("level", F.struct((F.col("level") == "sector").alias("s"), "document_id", "signal_id")).alias("trend_level"))
    if between is not None:
        rows = rows.where(F.col("date").between(*(F.to_date(F.lit(d)) for d in between)))
        return written(rows.drop("level").join(level, "theme_id"), "contributions")
    return rows.drop("level").join(level, "theme_id")


def boost(base: Column, classes: Column, entities: Column) -> Column:
    """A day's score with at most 15 % for source classes beyond one and 15 % for entities beyond one."""
    more = lambda n, by: F.least(F.greatest(n - 1, F.lit(0)) * by, F.lit(0.15))
    return F.when(base == 0, 0.0).otherwise(base * (1 + more(classes, 0.05) + more(entities, 0.02)))


def daily_buckets(rows: DataFrame) -> DataFrame:
    """Per theme and day: base_intensity, evidence_count, document, class and entity breadth, boosted intensity."""
    entities = F.array_distinct(F.filter(F.transform("entities", lambda e: F.trim(e)), lambda e: e != ""))
    clean = rows.withColumn("entities", entities)
    base = clean.groupBy("theme_id", "date").agg(F.sum("score").alias("base_intensity"), F.count("*").alias("evidence_count"), F.count_distinct("document_id").alias("document_breadth"), F.count_distinct("source_class").alias("class_breadth"))
    named = clean.select("theme_id", "date", F.explode("entities").alias("entity")).groupBy("theme_id", "date").agg(F.count_distinct("entity").alias("entity_breadth"))
    out = base.join(named, ["theme_id", "date"], "left").withColumn("entity_breadth", F.coalesce("entity_breadth", F.lit(0)))
    return out.withColumn("intensity", boost(F.col("base_intensity"), F.col("class_breadth"), F.col("entity_breadth")))


def source_mix(rows: DataFrame) -> DataFrame:
    """theme_id, date, source_mix: map from source class to its number of signals."""
    per_class = rows.groupBy("theme_id", "date", "source_class").agg(F.count("*").alias("n"))
    return per_class.groupBy("theme_id", "date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_class", "n")))).alias("source_mix"))


def breadth_members(rows: DataFrame) -> DataFrame:
    """theme_id, date, kind, m: the documents (d), source classes (c) and entities (e) of each theme and day."""
    member = lambda kind, m: F.struct(F.lit(kind).alias("kind"), m.cast("string").alias("m"))
    named = F.transform(F.filter("entities", lambda e: F.trim(e) != ""), lambda e: member("e", F.trim(e)))
    all_ = F.concat(F.array(member("d", F.col("document_id")), member("c", F.col("source_class"))), named)
    return rows.select("theme_id", "date", F.explode(all_).alias("x")).select("theme_id", "date", "x.kind", "x.m")


def lookback(spark, as_of: str, policy: TrendPolicy = TrendPolicy()) -> tuple[str, str]:
    """The first and the last day of the contributions that window scores rest on."""
    return spark.sql(f"SELECT CAST(date_sub(date'{as_of}', {policy.lookback_days - 1}) AS STRING)").first()[0], as_of


def window_scores(rows: DataFrame, as_of: str, policy: TrendPolicy = TrendPolicy(), suppress: bool = True) -> DataFrame:
    """Per theme, stored day and window: the window's intensity against all earlier windows of the lookback.

    rows: contributions. Baselines are the totals of all windows that end before the current one begins;
    with fewer earlier days than a window, the single total of what there is. Rows without information
    (no intensity, z or evidence) are left out except on the last day.
    """
    spark = rows.sparkSession
    start = f"date_sub(date'{as_of}', {policy.lookback_days - 1})"
    first, store = (spark.sql(f"SELECT CAST({e} AS STRING)").first()[0] for e in (start, f"date_sub(date'{as_of}', {policy.storage_days - 1})"))
    own = rows.where(F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(as_of))))
    daily = daily_buckets(own)
    levels = own.groupBy("theme_id").agg(F.min("trend_level").alias("trend_level"))
    grid = levels.crossJoin(F.broadcast(calendar(spark, first, as_of)))  # a bounded calendar
    dense = grid.join(daily.select("theme_id", "date", "intensity", "base_intensity", "evidence_count"), ["theme_id", "date"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("intensity", "base_intensity", "evidence_count")})
    dense = written(dense, "daily-themes")
    held = member_days(breadth_members(own), ["theme_id"], brief=("d",))
    held = replace(held, runs=written(held.runs, "theme-members"))  # each window reads them
    series = Window.partitionBy("theme_id").orderBy("idx")
    out = None
    for w in policy.windows:
        roll = series.rowsBetween(-(w - 1), 0)
        x = rolling_distinct(held, dense, ["theme_id"], w, {"d": "document_breadth", "c": "source_diversity", "e": "entity_breadth"})
        x = x.withColumns({c: F.sum(c).over(roll) for c in ("intensity", "base_intensity", "evidence_count")})
        x = x.withColumn("total", F.when(F.col("idx") >= w - 1, F.col("intensity")))
        # what ended before the current window began; a partial first total only where no whole one is there
        x = x.withColumn("history", F.collect_list("total").over(series.rowsBetween(Window.unboundedPreceding, -w)))
        x = x.withColumn("early", F.max_by("intensity", "idx").over(series.rowsBetween(-w, -w)))
        x = x.withColumn("history", F.when((F.size("history") == 0) & (F.col("idx") >= w), F.array("early")).otherwise(F.col("history")))
        x = x.where(F.col("date") >= F.to_date(F.lit(store)))
        mean = F.coalesce(mean_of(F.col("history")), F.lit(0.0))
        x = x.withColumn("mean", mean).withColumn("deviation", F.greatest(deviation_of(F.col("history")), F.lit(1.0)))
        x = x.withColumn("z", (F.col("intensity") - F.col("mean")) / F.col("deviation")).withColumn("percentile_rank", percentile_rank(F.col("history"), F.col("intensity")))
        low = F.size("history") < policy.low_history
        broad = (F.col("trend_level") != "market") | ((F.col("document_breadth") >= 2) & (F.col("entity_breadth") >= 2))
        x = x.select("theme_id", "trend_level", "date", F.lit(f"{w}d").alias("trend_window"), half_up(F.col("intensity"), 3).alias("intensity"), half_up(F.col("base_intensity"), 3).alias("base_intensity"), half_up(F.col("mean"), 3).alias("baseline_mean"), half_up(F.col("deviation"), 3).alias("baseline_stddev"), half_up(F.col("z"), 3).alias("z_score"), "percentile_rank", low.alias("low_history"), F.size("history").alias("baseline_days"), F.col("evidence_count").cast("long").alias("evidence_count"), "document_breadth", "source_diversity", "entity_breadth", (~low & promotes(F.col("z"), F.col("percentile_rank"), F.col("evidence_count"), policy) & broad & (F.col("source_diversity") >= 1)).alias("candidate"))
        out = x if out is None else out.unionByName(x)
    return informative(out, as_of) if suppress else out


def informative(scores: DataFrame, as_of: str) -> DataFrame:
    """Without rows that say nothing, but with all of the last day."""
    return scores.where((F.col("intensity") != 0) | (F.col("z_score") != 0) | (F.col("evidence_count") != 0) | (F.col("date") == F.to_date(F.lit(as_of))))


def publication(stored: DataFrame, fresh: DataFrame, first: str, last: str, keep_from: str, rebuild_at: int = 50_000) -> tuple[DataFrame, str]:
    """(the table after publishing, how): fresh rows replace those of [first, last]; rows outside stay unless older than
    keep_from. The table is built anew beside the old one and swapped if there are `rebuild_at` fresh rows or more (never,
    if that is 0) and the newest stored day, if any, is before the last day; else it is changed in place. The rows are
    the same."""
    inside = F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    after = stored.where(~inside & (F.col("date") >= F.to_date(F.lit(keep_from)))).unionByName(fresh)
    newest = stored.agg(F.max("date").cast("string")).first()[0]
    anew = rebuild_at > 0 and (newest is None or newest < last) and fresh.count() >= rebuild_at
    return after, "rebuild" if anew else "in_place"


def publish(table: DayTable, fresh: DataFrame, keys: list[str], first: str, last: str, keep_from: str, rebuild_at: int = 50_000) -> dict:
    """Publishes the fresh rows of [first, last] to a table of days: how, and the rows changed, removed and pruned.

    In place, only days with a new, differing or obsolete row are written; anew, all days of [first, last] are.
    """
    fresh = written(fresh, "fresh-trends")
    how = publication(table.read(), fresh, first, last, keep_from, rebuild_at)[1]
    if how == "rebuild":
        changed = fresh.count()
        days = [r[0] for r in fresh.select(F.col("date").cast("string")).distinct().collect()]  # a calendar
        table.replace_days(fresh, sorted({*days, *(d for d in table.days() if first <= d <= last)}))
        removed = 0
    else:
        changed = table.upsert(fresh, keys)
        removed = table.delete_obsolete(fresh, keys, first, last)
    return {"how": how, "changed": changed, "removed": removed, "pruned": table.prune(keep_from)}


def details(scores: DataFrame, rows: DataFrame, as_of: str, most: int = 5, evidence: int = 3) -> DataFrame:
    """Per theme of the last day: its seven-day figures, whether it is confirmed (a candidate with enough history) or
    emerging (low history, yet evidence), its most frequent entities and its strongest documents of the last 30 days."""
    now = scores.where((F.col("date") == F.to_date(F.lit(as_of))) & (F.col("trend_window") == "7d"))
    kind = F.when(F.col("candidate"), "confirmed").when(F.col("low_history") & (F.col("evidence_count") > 0), "emerging").otherwise("quiet")
    recent = rows.where(F.datediff(F.to_date(F.lit(as_of)), "date").between(0, 29))
    named = recent.select("theme_id", F.explode("entities").alias("e")).groupBy("theme_id", F.trim("e").alias("entity")).agg(F.count("*").alias("n"))
    listed = top_per(named, ["theme_id"], most, F.desc("n"), F.asc("entity"), rank="k").groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "entity"))), lambda x: x["entity"]), ",").alias("top_entities"))
    per = recent.groupBy("theme_id", "document_id").agg(F.max("score").alias("score"))
    shown = top_per(per, ["theme_id"], evidence, F.desc("score"), F.asc("document_id"), rank="k").groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "document_id"))), lambda x: x["document_id"].cast("string")), ",").alias("evidence"))
    out = now.select("theme_id", kind.alias("kind"), "z_score", "evidence_count").join(listed, "theme_id", "left").join(shown, "theme_id", "left")
    return out.fillna("", ["top_entities", "evidence"])


def subthemes(themes: DataFrame, most: int = 12) -> DataFrame:
    """theme_id, place, subtheme_id: the themes below each theme, by sector (null last) and label, `most` at most.
    themes: theme_id, parent_theme_id, sector, label."""
    own = themes.where("parent_theme_id IS NOT NULL").select(F.col("parent_theme_id").alias("theme_id"), F.col("theme_id").alias("subtheme_id"), "sector", "label")
    return top_per(own, ["theme_id"], most, F.asc_nulls_last("sector"), F.asc("label"), F.asc("subtheme_id"), rank="place").select("theme_id", "place", "subtheme_id")


def average_score(daily: DataFrame, as_of: str, window: int, baseline: int) -> DataFrame:
    """The older scorer: mean daily intensity of the window against that of the baseline before it; deviation 0 counts as 1."""
    age = F.datediff(F.to_date(F.lit(as_of)), "date")
    current, before = (age >= 0) & (age < window), (age >= window) & (age < window + baseline)
    x = daily.groupBy("theme_id").agg(*[F.coalesce(F.avg(F.when(c, F.col("intensity"))), F.lit(0.0)).alias(n) for c, n in ((current, "current"), (before, "mean"))], F.coalesce(F.stddev_samp(F.when(before, F.col("intensity"))), F.lit(0.0)).alias("deviation"))
    return x.withColumn("z_score", (F.col("current") - F.col("mean")) / F.when(F.col("deviation") == 0, 1.0).otherwise(F.col("deviation")))


def dashboard_score(z: Column, evidence: Column, entities: Column, sources: Column, low_history: Column) -> Column:
    return 4 * z + F.log1p(evidence) + F.log1p(entities) + F.log1p(sources) - low_history.cast("int")
