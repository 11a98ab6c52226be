"""Theme trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..operators import normalise, relational, themes
from ..plans import views
from ..session import published
from ..sources.sinks import difference
from .registry import query, r

AS_OF = "1998-06-30"
POLICY = themes.TrendPolicy()
#: Signals that a task takes when the documents of all contributions are counted.
SIGNALS_A_TASK = 250_000


def _rows(spark, d, between=None):
    return themes.contributions(views.signals(spark, d), views.themes(spark, d), between)


@query("WITH " + views.CONTRIBUTIONS_SQL + " SELECT theme_id, trend_level, count(*) AS n, count(DISTINCT document_id) AS documents, floor(sum(score) * 1000 + 0.5) / 1000.0 AS score FROM contributions GROUP BY 1, 2")
def union_all_contributions(spark, d):
    # dealt out by document, so many signals to a task: documents are counted there, in tables of bounded size, and what is exchanged by theme is counts
    rows = _rows(spark, d).select("theme_id", "trend_level", "document_id", "score")
    tasks = max(1, -(-views.table(spark, d, "lineitem").count() // SIGNALS_A_TASK))
    return rows.repartition(tasks, "document_id").groupBy("theme_id", "trend_level").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"), half_up(F.sum("score"), 3).alias("score"))


_BOOST = "CASE WHEN base = 0 THEN 0.0 ELSE base * (1 + least(greatest(classes - 1, 0) * 0.05, 0.15) + least(greatest(entities - 1, 0) * 0.02, 0.15)) END"
_DAILY = (
    views.CONTRIBUTIONS_SQL
    + f""", base_daily AS (
  SELECT theme_id, date, sum(score) AS base, count(*) AS evidence_count, count(DISTINCT document_id) AS document_breadth, count(DISTINCT source_class) AS classes FROM contributions GROUP BY 1, 2
), entity_daily AS (
  SELECT theme_id, date, count(DISTINCT entity) AS entities FROM (SELECT theme_id, date, unnest(entities) AS entity FROM contributions) GROUP BY 1, 2
), daily AS (
  SELECT *, {_BOOST} AS intensity FROM base_daily JOIN entity_daily USING (theme_id, date)
)"""
)


@query("WITH " + _DAILY + f" SELECT theme_id, date, {r('base')} AS base_intensity, evidence_count, document_breadth, classes AS class_breadth, entities AS entity_breadth, {r('intensity')} AS intensity FROM daily")
def theme_daily_buckets(spark, d):
    x = themes.daily_buckets(_rows(spark, d))
    return x.select("theme_id", "date", half_up(F.col("base_intensity"), 3).alias("base_intensity"), "evidence_count", "document_breadth", "class_breadth", "entity_breadth", half_up(F.col("intensity"), 3).alias("intensity"))


@query("WITH " + views.CONTRIBUTIONS_SQL + " SELECT theme_id, date, string_agg(source_class || ':' || CAST(n AS VARCHAR), ',' ORDER BY source_class) AS source_mix FROM (SELECT theme_id, date, source_class, count(*) AS n FROM contributions GROUP BY 1, 2, 3) GROUP BY 1, 2")
def map_aggregate_source_mix(spark, d):
    x = themes.source_mix(_rows(spark, d))
    return x.select("theme_id", "date", F.array_join(F.transform(F.map_entries("source_mix"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("source_mix"))


def _scores_sql(windows=(7, 30), suppress=True) -> str:
    parts = []
    for w in windows:
        parts.append(f"""
  SELECT s.*, m.document_breadth, m.source_diversity, m.entity_breadth FROM (
    SELECT c.theme_id, c.trend_level, c.date, '{w}d' AS trend_window, c.intensity, c.base, c.evidence_count,
      coalesce(avg(h.total), 0) AS mean, greatest(coalesce(stddev_samp(h.total), 0), 1) AS deviation, count(h.total) AS n,
      CASE WHEN count(h.total) = 0 THEN 0 ELSE CAST(floor(count(h.total) FILTER (h.total <= c.intensity) * 100.0 / count(h.total) + 0.5) AS BIGINT) END AS percentile_rank
    FROM rolled{w} c LEFT JOIN history{w} h ON h.theme_id = c.theme_id AND h.i = c.idx
    WHERE c.date > DATE '{AS_OF}' - {POLICY.storage_days}
    GROUP BY ALL) s
  JOIN breadth{w} m ON m.theme_id = s.theme_id AND m.date = s.date""")
    ctes = ""
    for w in windows:
        ctes += f""", rolled{w} AS (
  SELECT theme_id, trend_level, date, idx, sum(intensity) OVER x AS intensity, sum(base) OVER x AS base, sum(evidence_count) OVER x AS evidence_count
  FROM dense WINDOW x AS (PARTITION BY theme_id ORDER BY idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)
), history{w} AS (
  SELECT a.theme_id, a.idx AS i, b.intensity AS total FROM rolled{w} a JOIN rolled{w} b ON a.theme_id = b.theme_id AND b.idx <= a.idx - {w} AND (b.idx >= {w - 1} OR (a.idx < {2 * w - 1} AND b.idx = a.idx - {w}))
), breadth{w} AS (
  SELECT d.theme_id, d.date, count(DISTINCT c.document_id) AS document_breadth, count(DISTINCT c.source_class) AS source_diversity, count(DISTINCT c.entity) AS entity_breadth
  FROM dense d LEFT JOIN (SELECT theme_id, date, document_id, source_class, unnest(entities) AS entity FROM own) c ON c.theme_id = d.theme_id AND c.date BETWEEN d.date - {w - 1} AND d.date
  WHERE d.date > DATE '{AS_OF}' - {POLICY.storage_days} GROUP BY 1, 2
)"""
    where = f"WHERE intensity <> 0 OR z_score <> 0 OR evidence_count <> 0 OR date = DATE '{AS_OF}'" if suppress else ""
    return (
        "WITH "
        + _DAILY.replace("FROM contributions GROUP BY 1, 2", "FROM own GROUP BY 1, 2").replace("AS entity FROM contributions", "AS entity FROM own").replace("), base_daily AS", f"), own AS (SELECT * FROM contributions WHERE date BETWEEN DATE '{AS_OF}' - {POLICY.lookback_days - 1} AND DATE '{AS_OF}'), base_daily AS")
        + f""", days AS (SELECT DATE '{AS_OF}' - {POLICY.lookback_days - 1} + CAST(i AS INTEGER) AS date, i AS idx FROM range({POLICY.lookback_days}) t(i)
), dense AS (
  SELECT l.theme_id, l.trend_level, y.date, y.idx, coalesce(d.intensity, 0) AS intensity, coalesce(d.base, 0) AS base, coalesce(d.evidence_count, 0) AS evidence_count
  FROM (SELECT DISTINCT theme_id, trend_level FROM own) l CROSS JOIN days y LEFT JOIN daily d ON d.theme_id = l.theme_id AND d.date = y.date
)"""
        + ctes
        + ", scored AS ("
        + " UNION ALL ".join(parts)
        + f"""
), rounded AS (
  SELECT theme_id, trend_level, date, trend_window, {r("intensity")} AS intensity, {r("base")} AS base_intensity, {r("mean")} AS baseline_mean, {r("deviation")} AS baseline_stddev,
    {r("(intensity - mean) / deviation")} AS z_score, percentile_rank, n < {POLICY.low_history} AS low_history, CAST(n AS INTEGER) AS baseline_days, CAST(evidence_count AS BIGINT) AS evidence_count,
    document_breadth, source_diversity, entity_breadth,
    n >= {POLICY.low_history} AND (intensity - mean) / deviation >= 1.8 AND percentile_rank >= 90 AND evidence_count >= 2 AND (trend_level <> 'market' OR (document_breadth >= 2 AND entity_breadth >= 2)) AND source_diversity >= 1 AS candidate
  FROM scored
), kept AS (SELECT * FROM rounded {where})"""
    )


def scores(spark, d, window: int | None = None):
    """The published scores of all windows, or of one, which all reports read."""
    x = published(spark, [f"{d}/lineitem.parquet", f"{d}/part.parquet"], "theme-scores", lambda: themes.window_scores(_rows(spark, d, themes.lookback(spark, AS_OF, POLICY)), AS_OF, POLICY))
    return x if window is None else x.where(F.col("trend_window") == f"{window}d")


@query(_scores_sql() + " SELECT * FROM kept")
def theme_trend_scores(spark, d):
    return scores(spark, d)


@query(_scores_sql(suppress=False) + f" SELECT trend_window, count(*) AS n, count(*) FILTER (intensity <> 0 OR z_score <> 0 OR evidence_count <> 0 OR date = DATE '{AS_OF}') AS kept FROM kept GROUP BY 1")
def no_information_suppression(spark, d):
    x = themes.window_scores(_rows(spark, d, themes.lookback(spark, AS_OF, POLICY)), AS_OF, POLICY, suppress=False)
    kept = themes.informative(x, AS_OF)
    return x.groupBy("trend_window").agg(F.count("*").alias("n")).join(kept.groupBy("trend_window").agg(F.count("*").alias("kept")), "trend_window")


_DASH = "4 * z_score + ln(1 + evidence_count) + ln(1 + entity_breadth) + ln(1 + source_diversity) - CAST(low_history AS INTEGER)"


@query(_scores_sql((7,)) + f" SELECT theme_id, z_score, evidence_count, {r(_DASH)} AS dashboard_score FROM kept WHERE date = DATE '{AS_OF}' ORDER BY {r(_DASH)} DESC, theme_id LIMIT 10")
def dashboard_score_topk(spark, d):
    x = scores(spark, d, 7).where(F.col("date") == F.to_date(F.lit(AS_OF)))
    s = half_up(themes.dashboard_score(F.col("z_score"), F.col("evidence_count"), F.col("entity_breadth"), F.col("source_diversity"), F.col("low_history")), 3)
    return x.select("theme_id", "z_score", "evidence_count", s.alias("dashboard_score")).orderBy(F.desc("dashboard_score"), "theme_id").limit(10)


@query(
    _scores_sql((7,))
    + """, stored AS (SELECT theme_id, date, trend_window, CASE WHEN date = DATE '1998-06-20' THEN intensity + 1 ELSE intensity END AS intensity, z_score FROM kept WHERE date <> DATE '1998-06-30'
  UNION ALL SELECT 'gone', DATE '1998-06-29', '7d', 1.0, 1.0)
SELECT action, count(*) AS n FROM (
  SELECT CASE WHEN s.theme_id IS NULL THEN 'insert' WHEN k.theme_id IS NULL THEN 'delete' WHEN k.intensity = s.intensity AND k.z_score = s.z_score THEN 'keep' ELSE 'update' END AS action
  FROM kept k FULL JOIN stored s ON k.theme_id = s.theme_id AND k.date = s.date AND k.trend_window = s.trend_window) GROUP BY 1"""
)
def publication_diff(spark, d):
    fresh = scores(spark, d, 7).select("theme_id", "date", "trend_window", "intensity", "z_score")
    changed = F.when(F.col("date") == F.to_date(F.lit("1998-06-20")), F.col("intensity") + 1).otherwise(F.col("intensity"))
    stored = fresh.where("date <> date'1998-06-30'").withColumn("intensity", changed)
    stored = stored.unionByName(spark.sql("SELECT 'gone' AS theme_id, date'1998-06-29' AS date, '7d' AS trend_window, 1.0D AS intensity, 1.0D AS z_score"))
    return difference(stored, fresh, ["theme_id", "date", "trend_window"]).groupBy("action").agg(F.count("*").alias("n"))


_G = "FROM (SELECT theme_id, y.date, y.idx, coalesce(d.intensity, 0) AS intensity FROM (SELECT DISTINCT theme_id FROM daily) t CROSS JOIN (SELECT DATE '1998-01-01' + CAST(i AS INTEGER) AS date, i AS idx FROM range(181) g(i)) y LEFT JOIN daily d USING (theme_id, date))"


@query("WITH " + _DAILY + f" SELECT theme_id, date, {r('intensity')} AS intensity {_G}")
def gap_filled_series(spark, d):
    daily = themes.daily_buckets(_rows(spark, d)).select("theme_id", "date", "intensity")
    return relational.fill_days(daily, ["theme_id"], relational.calendar(spark, "1998-01-01", "1998-06-30"), {"intensity": F.lit(0.0)}).select("theme_id", "date", half_up(F.col("intensity"), 3).alias("intensity"))


@query("WITH " + _DAILY + f" SELECT theme_id, date, {r('sum(intensity) OVER (PARTITION BY theme_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS rolling_7d {_G}")
def rolling_sum_7d(spark, d):
    from pyspark.sql import Window

    daily = themes.daily_buckets(_rows(spark, d)).select("theme_id", "date", "intensity")
    x = relational.fill_days(daily, ["theme_id"], relational.calendar(spark, "1998-01-01", "1998-06-30"), {"intensity": F.lit(0.0)})
    return x.select("theme_id", "date", half_up(F.sum("intensity").over(Window.partitionBy("theme_id").orderBy("idx").rowsBetween(-6, 0)), 3).alias("rolling_7d"))


@query("WITH " + _DAILY + f""", x AS (SELECT theme_id, coalesce(avg(intensity) FILTER (date BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}'), 0) AS current, coalesce(avg(intensity) FILTER (date BETWEEN DATE '{AS_OF}' - 96 AND DATE '{AS_OF}' - 7), 0) AS mean,
  coalesce(stddev_samp(intensity) FILTER (date BETWEEN DATE '{AS_OF}' - 96 AND DATE '{AS_OF}' - 7), 0) AS deviation FROM daily GROUP BY 1)
SELECT theme_id, {r("current")} AS current, {r("mean")} AS mean, {r("(current - mean) / CASE WHEN deviation = 0 THEN 1 ELSE deviation END")} AS z_score FROM x""")
def average_baseline_score(spark, d):
    x = themes.average_score(themes.daily_buckets(_rows(spark, d)), AS_OF, 7, 90)
    return x.select("theme_id", half_up(F.col("current"), 3).alias("current"), half_up(F.col("mean"), 3).alias("mean"), half_up(F.col("z_score"), 3).alias("z_score"))


@query(f"SELECT l_linenumber AS line, {r('avg(' + r('greatest(l_quantity * 2, l_tax * 1000) / 100.0 * (l_discount * 1000) / 100.0 * CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN 1.1 ELSE 1.0 END') + ')')} AS mean_contribution FROM lineitem GROUP BY 1")
def score_contributions(spark, d):
    li = views.table(spark, d, "lineitem")
    s = themes.score_contribution(F.col("l_quantity") * 2, F.col("l_tax") * 1000, F.col("l_discount") * 1000, F.col("l_returnflag") == "R")
    return li.groupBy(F.col("l_linenumber").alias("line")).agg(half_up(F.avg(s), 3).alias("mean_contribution"))


@query("WITH " + views.SIGNALS_SQL + """, counted AS (SELECT theme_id, count(*) AS total FROM signals GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
best AS (SELECT s.theme_id, total, signal_id, score, row_number() OVER (PARTITION BY s.theme_id ORDER BY score DESC, signal_id) AS k FROM signals s JOIN counted c ON s.theme_id = c.theme_id)
SELECT theme_id, total, count(*) AS signal_count, string_agg(CAST(signal_id AS VARCHAR), ',' ORDER BY score DESC, signal_id) AS representatives FROM best WHERE k <= 3 GROUP BY 1, 2""")
def lateral_top3(spark, d):
    return normalise.theme_groups(views.signals(spark, d), 8)


@query("WITH " + views.SIGNALS_SQL + """, mappings AS (SELECT DISTINCT theme_id, 'market:' || right(theme_id, 1) AS canonical FROM signals),
x AS (SELECT canonical, theme_id, signal_id, unnest(entities) AS entity FROM signals JOIN mappings USING (theme_id)),
e AS (SELECT canonical, string_agg(entity, ',' ORDER BY entity) AS top_entities FROM (SELECT canonical, entity, row_number() OVER (PARTITION BY canonical ORDER BY entity) AS k FROM (SELECT DISTINCT canonical, CASE WHEN entity LIKE 'size%' THEN ' ' || entity || ' ' ELSE entity END AS entity FROM x)) WHERE k <= 3 GROUP BY 1)
SELECT canonical AS canonical_theme_id, count(*) AS signal_rows, count(DISTINCT theme_id) AS themes, any_value(top_entities) AS top_entities FROM x JOIN e USING (canonical) GROUP BY 1""")
def theme_mapping_status(spark, d):
    s = views.signals(spark, d).drop("canonical_theme_id")
    mappings = s.select("theme_id").distinct().withColumn("canonical_theme_id", F.concat(F.lit("market:"), F.right("theme_id", F.lit(1))))
    return normalise.mapping_status(s, mappings)


@query("WITH " + views.SIGNALS_SQL + """, m AS (SELECT DISTINCT theme_id, 70.0 + CAST(right(theme_id, 1) AS INTEGER) * 4 AS confidence FROM signals)
SELECT CASE WHEN confidence >= 80 THEN 'mapped' ELSE coalesce(s.canonical_theme_id, 'none') END AS canonical, CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM signals s JOIN m USING (theme_id) GROUP BY 1, 2""")
def mapping_application(spark, d):
    s = views.signals(spark, d)
    m = s.select("theme_id").distinct().select("theme_id", (70.0 + F.right("theme_id", F.lit(1)).cast("int") * 4).alias("confidence"), F.lit("mapped").alias("canonical_theme_id"))
    x = normalise.apply_mappings(s, m).join(m.select("theme_id", "confidence"), "theme_id")
    return x.groupBy(F.coalesce("canonical_theme_id", F.lit("none")).alias("canonical"), normalise.confidence_label(F.col("confidence")).alias("label")).agg(F.count("*").alias("n"))


@query("WITH " + views.SIGNALS_SQL + """ SELECT theme, count(*) AS n, count(DISTINCT document_id) AS documents FROM (
  SELECT document_id, unnest(list_distinct(list_filter([theme_id, canonical_theme_id, canonical_subtheme_id], lambda x: x IS NOT NULL))) AS theme FROM signals) GROUP BY 1""")
def or_condition_theme_evidence(spark, d):
    any_ = F.array_distinct(F.array_compact(F.array("theme_id", "canonical_theme_id", "canonical_subtheme_id")))
    return views.signals(spark, d).select("signal_id", "document_id", F.explode(any_).alias("theme")).groupBy("theme").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


@query("WITH " + views.CONTRIBUTIONS_SQL + f", x AS (SELECT theme_id, unnest(entities) AS entity FROM contributions WHERE date BETWEEN DATE '{AS_OF}' - 29 AND DATE '{AS_OF}'), c AS (SELECT theme_id, entity, count(*) AS n FROM x GROUP BY 1, 2) SELECT theme_id, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY n DESC, entity) AS k FROM c) WHERE k <= 5")
def theme_top_entities(spark, d):
    """The entities of a theme's last 30 days, the five most frequent."""
    x = _rows(spark, d).where(F.col("date").between(F.date_sub(F.to_date(F.lit(AS_OF)), 29), F.to_date(F.lit(AS_OF))))
    c = x.select("theme_id", F.explode("entities").alias("entity")).withColumn("entity", F.trim("entity")).groupBy("theme_id", "entity").agg(F.count("*").alias("n"))
    return relational.top_per(c, ["theme_id"], 5, F.desc("n"), F.asc("entity"))


@query(_scores_sql() + " SELECT trend_window, trend_level, count(*) FILTER (candidate) AS candidates, count(DISTINCT theme_id) FILTER (candidate) AS themes, max(z_score) AS top_z FROM kept GROUP BY 1, 2")
def candidate_themes(spark, d):
    x = scores(spark, d)
    return x.groupBy("trend_window", "trend_level").agg(F.count_if("candidate").alias("candidates"), F.count_distinct(F.when(F.col("candidate"), F.col("theme_id"))).alias("themes"), F.max("z_score").alias("top_z"))
