"""Narrative trends, bursts, board, changes, backtest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..operators import board, bursts, evaluation, narrative, relational
from ..plans import views
from ..session import published
from .registry import query, r

FIRST, LAST, PREVIOUS = "2024-01-01", "2024-01-30", "2024-01-29"
POLICY = narrative.NarrativePolicy(window=7, corpus_floor=50, low_history_days=14)


def _days(first=FIRST, last=LAST):
    return f"days AS (SELECT DATE '{first}' + CAST(i AS INTEGER) AS date, i AS idx FROM range(datediff('day', DATE '{first}', DATE '{last}') + 1) t(i))"


def series_sql(w: int = 7) -> str:
    """The window series as common table expressions ending in `series` (unrounded)."""
    s, p = max(1, w // 2), POLICY
    need = max(3, -(-p.low_history_days // s))
    return (
        views.OBSERVATIONS_SQL
        + ", "
        + _days()
        + f""", grid AS (SELECT definition_id, date, idx FROM definitions CROSS JOIN days),
day_docs AS (SELECT definition_id, date, source_class, document_id, bool_or(matched) AS matched, max(CASE WHEN raw_matched THEN least(greatest(match_score, 0), 100) / 100.0 END) AS weight FROM observations GROUP BY 1, 2, 3, 4),
win_docs AS (SELECT g.definition_id, g.date, d.source_class, d.document_id, bool_or(d.matched) AS matched, sum(d.weight) AS weight FROM grid g JOIN day_docs d ON d.definition_id = g.definition_id AND d.date BETWEEN g.date - {w - 1} AND g.date GROUP BY 1, 2, 3, 4),
per_class AS (SELECT definition_id, date, source_class, count(*) AS eligible, count(*) FILTER (matched) AS hits, coalesce(sum(weight), 0) AS attention FROM win_docs GROUP BY 1, 2, 3),
pooled AS (SELECT definition_id, date, sum(100.0 * hits / eligible * ln(1 + eligible)) / sum(ln(1 + eligible)) AS density, sum(100.0 * attention / eligible * ln(1 + eligible)) / sum(ln(1 + eligible)) AS attention_density FROM per_class GROUP BY 1, 2),
breadth AS (SELECT g.definition_id, g.date, count(DISTINCT o.document_id) AS classified_documents, count(DISTINCT o.document_id) FILTER (o.matched) AS matched_documents, count(DISTINCT o.document_id) FILTER (o.raw_matched) AS attention_matched_documents,
  count(DISTINCT o.publisher_id) FILTER (o.matched) AS publisher_breadth, count(DISTINCT o.publisher_owner) FILTER (o.matched) AS owner_breadth, count(DISTINCT o.story_fingerprint) FILTER (o.matched) AS story_breadth,
  count(DISTINCT o.source_class) FILTER (o.matched) AS class_breadth, count(DISTINCT o.entity) FILTER (o.matched) AS entity_breadth
  FROM grid g LEFT JOIN observations o ON o.definition_id = g.definition_id AND o.date BETWEEN g.date - {w - 1} AND g.date GROUP BY 1, 2),
day_tones AS (SELECT definition_id, date, avg(risk_tone) AS risk, avg(bullish_tone) AS bullish FROM observations WHERE matched GROUP BY 1, 2),
tones AS (SELECT g.definition_id, g.date, coalesce(avg(t.risk) FILTER (t.risk > 0), 0) AS risk_tone, coalesce(avg(t.bullish) FILTER (t.bullish > 0), 0) AS bullish_tone FROM grid g LEFT JOIN day_tones t ON t.definition_id = g.definition_id AND t.date BETWEEN g.date - {w - 1} AND g.date GROUP BY 1, 2),
win_corpus AS (SELECT y.date, count(DISTINCT e.document_id) AS corpus_documents FROM days y LEFT JOIN evidence e ON e.date BETWEEN y.date - {w - 1} AND y.date GROUP BY 1),
base AS (SELECT g.definition_id, g.date, g.idx, coalesce(p.density, 0) AS density, coalesce(p.attention_density, 0) AS attention_density, t.risk_tone, t.bullish_tone, c.corpus_documents, b.* EXCLUDE (definition_id, date)
  FROM grid g LEFT JOIN pooled p ON p.definition_id = g.definition_id AND p.date = g.date JOIN breadth b ON b.definition_id = g.definition_id AND b.date = g.date JOIN tones t ON t.definition_id = g.definition_id AND t.date = g.date JOIN win_corpus c ON c.date = g.date),
stated AS (SELECT *, CASE WHEN corpus_documents = 0 THEN 'no_corpus' WHEN 100.0 * least(classified_documents, corpus_documents) / corpus_documents < {p.measured_percent} THEN 'backfill_pending' WHEN matched_documents = 0 THEN 'measured_zero' ELSE 'measured' END AS coverage FROM base),
covered AS (SELECT *, coverage IN ('measured', 'measured_zero') AS ok, coverage IN ('measured', 'measured_zero') AND corpus_documents >= {p.corpus_floor} AS full_ FROM stated),
past AS (SELECT a.definition_id, a.idx, median(b.density) AS dm, median(b.attention_density) AS am, count(b.idx) AS samples,
  count(*) FILTER (b.density <= a.density) AS dle, count(*) FILTER (b.attention_density <= a.attention_density) AS ale, stddev_samp(b.density) AS dsd, stddev_samp(b.attention_density) AS asd
  FROM covered a LEFT JOIN covered b ON b.definition_id = a.definition_id AND b.full_ AND b.idx >= {w - 1} AND b.idx <= a.idx - {w} AND (a.idx - {w} - b.idx) % {s} = 0 GROUP BY 1, 2),
spread AS (SELECT a.definition_id, a.idx, median(abs(b.density - q.dm)) * 1.4826 AS dmad, median(abs(b.attention_density - q.am)) * 1.4826 AS amad
  FROM covered a JOIN past q ON q.definition_id = a.definition_id AND q.idx = a.idx LEFT JOIN covered b ON b.definition_id = a.definition_id AND b.full_ AND b.idx >= {w - 1} AND b.idx <= a.idx - {w} AND (a.idx - {w} - b.idx) % {s} = 0 GROUP BY 1, 2),
peaks AS (SELECT a.definition_id, a.idx, max((b.density, b.idx)) AS peak FROM covered a LEFT JOIN covered b ON b.definition_id = a.definition_id AND b.idx BETWEEN a.idx - {p.peak_days - 1} AND a.idx AND (b.full_ OR (b.idx = a.idx AND b.ok)) GROUP BY 1, 2),
lagged AS (SELECT c.*, q.samples,
  CASE WHEN c.ok AND q.samples >= 2 THEN (c.density - q.dm) / greatest(CASE WHEN z.dmad > 0 THEN z.dmad ELSE q.dsd END, 0.5) ELSE 0 END AS density_z,
  CASE WHEN c.ok AND q.samples >= 2 THEN (c.attention_density - q.am) / greatest(CASE WHEN z.amad > 0 THEN z.amad ELSE q.asd END, 0.5) ELSE 0 END AS attention_z,
  CAST(CASE WHEN c.ok AND q.samples >= 2 THEN floor(q.dle * 100.0 / q.samples + 0.5) ELSE 0 END AS BIGINT) AS density_percentile,
  CAST(CASE WHEN c.ok AND q.samples >= 2 THEN floor(q.ale * 100.0 / q.samples + 0.5) ELSE 0 END AS BIGINT) AS attention_percentile,
  NOT c.ok OR q.samples < {need} AS low_history, k.peak[1] AS peak_density, c.idx - k.peak[2] AS days_since_peak,
  lag(c.density, {w}) OVER v AS d1, lag(c.density, {2 * w}) OVER v AS d2, coalesce(lag(c.ok, {w}) OVER v, false) AS c1, coalesce(lag(c.ok, {2 * w}) OVER v, false) AS c2
  FROM covered c JOIN past q ON q.definition_id = c.definition_id AND q.idx = c.idx JOIN spread z ON z.definition_id = c.definition_id AND z.idx = c.idx JOIN peaks k ON k.definition_id = c.definition_id AND k.idx = c.idx WINDOW v AS (PARTITION BY c.definition_id ORDER BY c.idx)),
moved AS (SELECT *, CASE WHEN c1 THEN d1 END AS previous, CASE WHEN ok AND c1 THEN density - d1 ELSE 0 END AS change, CASE WHEN c1 AND c2 THEN d1 - d2 ELSE 0 END AS previous_change FROM lagged),
series AS (SELECT *, CASE WHEN ok AND c1 AND c2 THEN change - previous_change ELSE 0 END AS acceleration, greatest(0.5, 0.1 * coalesce(peak_density, 0)) AS noise,
  CASE WHEN NOT ok THEN 'unmeasured' WHEN density <= 0 AND (previous IS NULL OR previous <= 0) THEN 'dormant'
    WHEN density <= 0 OR (change <= -greatest(0.5, 0.1 * coalesce(peak_density, 0)) AND previous_change <= 0) OR (coalesce(days_since_peak >= {w}, false) AND density_percentile < 50 AND change <= greatest(0.5, 0.1 * coalesce(peak_density, 0))) THEN 'fading'
    WHEN low_history THEN 'emerging' WHEN story_breadth < 3 OR owner_breadth < 2 THEN 'steady' WHEN change > greatest(0.5, 0.1 * coalesce(peak_density, 0)) THEN 'rising'
    WHEN density_percentile >= 85 AND NOT coalesce(days_since_peak >= {w}, false) THEN 'peaking' ELSE 'steady' END AS state FROM moved)"""
    )


def series(spark, d, w: int = 7):
    """The published series of windows of w days, which all boards read."""
    p = narrative.NarrativePolicy(window=w, corpus_floor=POLICY.corpus_floor, low_history_days=POLICY.low_history_days)
    return published(spark, [f"{d}/events.parquet"], f"series-{w}", lambda: narrative.trend_series(views.observations(spark, d), views.corpus(spark, d), FIRST, LAST, p))


@query("WITH " + series_sql() + f" SELECT definition_id, date, {r('density', 2)} AS density, {r('attention_density', 2)} AS attention_density, {r('risk_tone', 2)} AS risk_tone, {r('bullish_tone', 2)} AS bullish_tone FROM series")
def pooled_density(spark, d):
    return series(spark, d).select("definition_id", "date", "density", "attention_density", "risk_tone", "bullish_tone")


@query("WITH " + series_sql() + " SELECT definition_id, date, CAST(corpus_documents AS BIGINT) AS corpus_documents, classified_documents, matched_documents, coverage FROM series")
def coverage_states(spark, d):
    return series(spark, d).select("definition_id", "date", "corpus_documents", "classified_documents", "matched_documents", "coverage")


@query("WITH " + series_sql() + " SELECT definition_id, date, publisher_breadth, owner_breadth, story_breadth, class_breadth, entity_breadth, attention_matched_documents FROM series")
def rolling_distinct_7d(spark, d):
    return series(spark, d).select("definition_id", "date", "publisher_breadth", "owner_breadth", "story_breadth", "class_breadth", "entity_breadth", "attention_matched_documents")


@query("WITH " + series_sql() + f" SELECT definition_id, date, CAST(samples AS INTEGER) AS samples, {r('density_z', 2)} AS density_z, {r('attention_z', 2)} AS attention_z, density_percentile, attention_percentile, low_history FROM series")
def strided_baseline_mad(spark, d):
    return series(spark, d).select("definition_id", "date", "samples", "density_z", "attention_z", "density_percentile", "attention_percentile", "low_history")


@query("WITH " + series_sql() + f" SELECT definition_id, date, {r('peak_density', 2)} AS peak_density, CAST(days_since_peak AS INTEGER) AS days_since_peak FROM series")
def trailing_peak_90d(spark, d):
    return series(spark, d).select("definition_id", "date", "peak_density", "days_since_peak")


@query("WITH " + series_sql() + f" SELECT definition_id, date, {r('change', 2)} AS change, {r('acceleration', 2)} AS acceleration FROM series")
def lag_change_acceleration(spark, d):
    return series(spark, d).select("definition_id", "date", "change", "acceleration")


@query("WITH " + series_sql() + " SELECT definition_id, date, state FROM series")
def lifecycle_states(spark, d):
    return series(spark, d).select("definition_id", "date", "state")


# --- attention bursts -------------------------------------------------------------------------------
BURST_AS_OF = "2024-01-30"
BURSTS = bursts.BurstPolicy(window=7, baseline=21, least_stories=2, least_owners=2, least_z=0.5)


def _burst_terms(spark, d):
    """Terms of events: their entity (a kind 1 term) and their narrative with the class (kind 0)."""
    e = views.evidence(spark, d)
    term = F.explode(F.array(F.struct(F.col("entity").alias("term"), F.lit(1).alias("kind")), F.struct(F.concat_ws(" ", "definition_id", "source_class").alias("term"), F.lit(0).alias("kind")), F.struct(F.concat(F.lit("day"), (F.col("document_id") % 11 + F.dayofmonth("date")).cast("string")).alias("term"), F.lit(0).alias("kind"))))
    return e.select("document_id", "date", "story_fingerprint", "publisher_owner", term.alias("t")).select("document_id", "date", "story_fingerprint", "publisher_owner", "t.term", "t.kind")


_BURST_SQL = (
    views.EVIDENCE_SQL
    + f""", terms AS (SELECT document_id, date, story_fingerprint, publisher_owner, unnest([entity, definition_id || ' ' || source_class, 'day' || CAST(document_id % 11 + dayofmonth(date) AS VARCHAR)]) AS term FROM evidence),
win AS (SELECT *, CAST(floor(datediff('day', date, DATE '{BURST_AS_OF}') / 7) AS INTEGER) AS w FROM terms WHERE datediff('day', date, DATE '{BURST_AS_OF}') BETWEEN 0 AND 27),
per AS (SELECT term, w, count(DISTINCT story_fingerprint) AS stories, count(DISTINCT publisher_owner) AS owners FROM win GROUP BY 1, 2),
cur AS (SELECT term, stories, owners FROM per WHERE w = 0 AND stories >= 2 AND owners >= 2),
hist AS (SELECT c.term, h.w, coalesce(p.stories, 0) AS stories FROM cur c CROSS JOIN (SELECT unnest([1, 2, 3]) AS w) h LEFT JOIN per p ON p.term = c.term AND p.w = h.w),
stat AS (SELECT term, avg(stories) AS mean, median(stories) AS med, max(stories) = 0 AS novel FROM hist GROUP BY 1),
dev AS (SELECT h.term, median(abs(h.stories - s.med)) * 1.4826 AS mad FROM hist h JOIN stat s USING (term) GROUP BY 1),
burst AS (SELECT term, stories, owners, mean, (stories - mean) / greatest(1, sqrt(greatest(mean, 0)), mad) AS z, novel FROM cur JOIN stat USING (term) JOIN dev USING (term))"""
)


@query("WITH " + _BURST_SQL + f" SELECT term, stories, owners, {r('mean', 2)} AS baseline_mean, {r('z', 2)} AS z_score, novel, {r('CASE WHEN novel THEN stories + z ELSE z END', 2)} AS score FROM burst WHERE novel OR z >= 0.5")
def attention_bursts(spark, d):
    return bursts.scored_terms(_burst_terms(spark, d), BURST_AS_OF, BURSTS).drop("kind")


@query()
def burst_suppression(spark, d):
    """Greedy in rank order, so without SQL; tested against a loop."""
    return bursts.without_nested(bursts.scored_terms(_burst_terms(spark, d), BURST_AS_OF, BURSTS), 60)


@query(
    "WITH " + _BURST_SQL + ", defs AS (SELECT DISTINCT definition_id, definition_id || ' ' || source_class AS haystack FROM evidence WHERE source_class IN ('filing', 'newspaper')) SELECT term, stories, coalesce(string_agg(DISTINCT definition_id, ',' ORDER BY definition_id), '') AS covering FROM burst b LEFT JOIN defs ON contains(defs.haystack, b.term) WHERE novel OR z >= 0.5 GROUP BY 1, 2"
)
def burst_coverage(spark, d):
    e = views.evidence(spark, d).where("source_class in ('filing', 'newspaper')")
    defs = e.select("definition_id", F.concat_ws(" ", "definition_id", "source_class").alias("name"), F.lit("").alias("proposition"), F.lit("").alias("inclusion"), F.lit("").alias("examples")).distinct()
    x = bursts.scored_terms(_burst_terms(spark, d), BURST_AS_OF, BURSTS).select("term", "stories")
    return bursts.covering(x, defs).select("term", "stories", F.array_join("covering", ",").alias("covering"))


@query("WITH " + views.TEXTS_SQL + " SELECT source_class, count(*) AS documents, count(DISTINCT document_id) AS ids FROM texts WHERE title IS NOT NULL GROUP BY 1")
def burst_corpus(spark, d):
    return views.texts(spark, d).where("title is not null").groupBy("source_class").agg(F.count("*").alias("documents"), F.count_distinct("document_id").alias("ids"))


# --- board, changes, alerts, backtest ----------------------------------------------------------------
def _definitions(spark, d):
    """Definitions: kind, status, activation by the length of the name."""
    n = F.length("definition_id")
    x = views.evidence(spark, d).select("definition_id").distinct()
    return x.select("definition_id", F.col("definition_id").alias("name"), F.when(n % 2 == 0, "structural").otherwise("event").alias("kind"), F.when(F.col("definition_id") == "signup", "expired").when(F.col("definition_id") == "view", "probationary").otherwise("active").alias("status"), F.when(F.col("definition_id") == "click", F.to_date(F.lit("2024-01-29"))).alias("activated"), F.when(n % 2 == 1, "purchase").alias("parent_id"))


_DEFS = """defs AS (SELECT DISTINCT definition_id, definition_id AS name, CASE WHEN length(definition_id) % 2 = 0 THEN 'structural' ELSE 'event' END AS kind,
  CASE definition_id WHEN 'signup' THEN 'expired' WHEN 'view' THEN 'probationary' ELSE 'active' END AS status, CASE WHEN definition_id = 'click' THEN DATE '2024-01-29' END AS activated, CASE WHEN length(definition_id) % 2 = 1 THEN 'purchase' END AS parent_id FROM evidence)"""


def _board(spark, d):
    return series(spark, d).join(_definitions(spark, d), "definition_id")


_BOARD = f"""board AS (SELECT s.definition_id, s.date, d.name, d.kind, d.status, d.activated, s.coverage, s.state, {r("s.density", 2)} AS density, {r("s.change", 2)} AS change, {r("s.attention_z", 2)} AS attention_z, {r("s.density_z", 2)} AS density_z, {r("s.attention_density", 2)} AS attention_density, s.story_breadth, s.attention_matched_documents, s.days_since_peak FROM series s JOIN defs d USING (definition_id))"""


@query(
    f"""WITH {series_sql()}, {_DEFS}, {_BOARD}, now_ AS (SELECT *, coverage IN ('measured', 'measured_zero') AS m, state IN ('rising', 'peaking') AND coverage IN ('measured', 'measured_zero') AS moving FROM board WHERE date = DATE '{LAST}')
SELECT * FROM (
  SELECT state AS lane, row_number() OVER (PARTITION BY state ORDER BY attention_z DESC, density_z DESC, story_breadth DESC, name) AS place, definition_id, density FROM now_ WHERE m AND state IN ('rising', 'peaking')
  UNION ALL SELECT 'fading', row_number() OVER (ORDER BY change, coalesce(days_since_peak, 0) DESC, name), definition_id, density FROM now_ WHERE m AND state = 'fading'
  UNION ALL SELECT 'emerging', row_number() OVER (ORDER BY attention_matched_documents DESC, attention_density DESC, name), definition_id, density FROM now_ WHERE NOT moving AND (state = 'emerging' OR status = 'probationary' OR coalesce(datediff('day', activated, DATE '{LAST}') <= 7, false))
) WHERE place <= 6"""
)
def homepage_lanes(spark, d):
    return board.lanes(_board(spark, d).where(F.col("date") == F.to_date(F.lit(LAST))), LAST).select("lane", F.col("place").cast("long").alias("place"), "definition_id", "density")


@query(f"WITH {series_sql()}, ok AS (SELECT date, bool_and(coverage IN ('measured', 'measured_zero')) AS complete FROM series WHERE definition_id <> 'error' GROUP BY 1) SELECT date, complete FROM ok")
def bool_and_complete_dates(spark, d):
    x = series(spark, d).where("definition_id <> 'error'")
    return x.groupBy("date").agg(F.bool_and(board.is_measured(F.col("coverage"))).alias("complete"))


@query(f"WITH {series_sql()} SELECT max(date) AS date FROM (SELECT date, bool_and(coverage IN ('measured', 'measured_zero')) AS complete FROM series WHERE definition_id <> 'error' AND date >= DATE '{LAST}' - 7 GROUP BY 1) WHERE complete")
def retained_complete_board(spark, d):
    return board.complete_date(series(spark, d).where("definition_id <> 'error'"), LAST)


_SNAP = f"""snap AS (SELECT d.*, c.density AS cd, c.state AS cs, c.coverage AS cc, p.density AS pd, p.state AS ps, p.coverage AS pc FROM defs d
  LEFT JOIN board c ON c.definition_id = d.definition_id AND c.date = DATE '{LAST}' LEFT JOIN board p ON p.definition_id = d.definition_id AND p.date = DATE '{PREVIOUS}'),
flags AS (SELECT *, coalesce(cc IN ('measured', 'measured_zero'), false) AS now_, coalesce(pc IN ('measured', 'measured_zero'), false) AS was, coalesce({r("cd - pd", 2)}, 0) AS ch FROM snap),
changes AS (
  SELECT definition_id, 'expired_definition' AS change_kind, 3 AS priority, ch AS change, cs FROM flags WHERE status = 'expired'
  UNION ALL SELECT definition_id, 'new_definition', 0, ch, cs FROM flags WHERE status <> 'expired' AND activated >= DATE '{PREVIOUS}'
  UNION ALL SELECT definition_id, 'entered_board', 2, ch, cs FROM flags WHERE status <> 'expired' AND now_ AND NOT was
  UNION ALL SELECT definition_id, 'left_board', 4, ch, cs FROM flags WHERE status <> 'expired' AND NOT now_ AND was
  UNION ALL SELECT definition_id, 'state_change', 1, ch, cs FROM flags WHERE status <> 'expired' AND now_ AND was AND cs <> ps
  UNION ALL SELECT definition_id, 'mover', 5, ch, cs FROM flags WHERE status <> 'expired' AND now_ AND was AND cs = ps AND abs(ch) >= 1)"""


def _changes(spark, d):
    return board.changes(board.snapshots(_definitions(spark, d), series(spark, d), LAST, PREVIOUS), LAST, PREVIOUS)


@query(f"WITH {series_sql()}, {_DEFS}, {_BOARD}, {_SNAP} SELECT definition_id, change_kind, priority, change FROM changes")
def two_snapshot_changes(spark, d):
    return _changes(spark, d).select("definition_id", "change_kind", "priority", "change")


@query(f"WITH {series_sql()}, {_DEFS}, {_BOARD}, {_SNAP} SELECT state, count(*) AS n FROM (SELECT CASE WHEN now_ AND cs IS NOT NULL THEN cs WHEN status <> 'expired' THEN 'unmeasured' END AS state FROM flags) WHERE state IS NOT NULL GROUP BY 1")
def change_state_counts(spark, d):
    return board.state_counts(board.snapshots(_definitions(spark, d), series(spark, d), LAST, PREVIOUS))


@query(
    f"""WITH {series_sql()}, {_DEFS}, {_BOARD}, {_SNAP} SELECT DISTINCT definition_id, DATE '{LAST}' AS alert_date, alert_type, severity FROM (
  SELECT definition_id, 'state_change' AS alert_type, CASE WHEN cs IN ('rising', 'fading') THEN 'warning' ELSE 'notice' END AS severity FROM changes WHERE change_kind = 'state_change'
  UNION ALL SELECT definition_id, 'new_definition', 'notice' FROM changes WHERE change_kind = 'new_definition'
  UNION ALL SELECT definition_id, 'mover', 'notice' FROM changes WHERE change_kind = 'mover' AND abs(change) >= 3
  UNION ALL SELECT definition_id, 'attention_surge', 'warning' FROM board WHERE date = DATE '{LAST}' AND state = 'rising' AND coverage IN ('measured', 'measured_zero') AND attention_z >= 2.5)"""
)
def alert_rules(spark, d):
    now = _board(spark, d).where(F.col("date") == F.to_date(F.lit(LAST)))
    rising = now.where((F.col("state") == "rising") & board.is_measured(F.col("coverage")))
    return board.alerts(_changes(spark, d), rising, LAST)


_LANES = f"""now_ AS (SELECT *, coverage IN ('measured', 'measured_zero') AS m, state IN ('rising', 'peaking') AND coverage IN ('measured', 'measured_zero') AS moving FROM board WHERE date = DATE '{LAST}'),
lanes AS (SELECT * FROM (
  SELECT state AS lane, row_number() OVER (PARTITION BY state ORDER BY attention_z DESC, density_z DESC, story_breadth DESC, name) AS place, name, kind, state FROM now_ WHERE m AND state IN ('rising', 'peaking')
  UNION ALL SELECT 'fading', row_number() OVER (ORDER BY change, coalesce(days_since_peak, 0) DESC, name), name, kind, state FROM now_ WHERE m AND state = 'fading'
  UNION ALL SELECT 'emerging', row_number() OVER (ORDER BY attention_matched_documents DESC, attention_density DESC, name), name, kind, state FROM now_ WHERE NOT moving AND (state = 'emerging' OR status = 'probationary' OR coalesce(datediff('day', activated, DATE '{LAST}') <= 7, false))) WHERE place <= 6),
turns AS (SELECT *, CASE WHEN state = 'unmeasured' THEN NULL WHEN lane = 'rising' THEN CASE kind WHEN 'structural' THEN 0 ELSE 2 END WHEN lane = 'peaking' THEN CASE kind WHEN 'structural' THEN 1 ELSE 3 END WHEN lane = 'emerging' AND state = 'emerging' THEN 4 END AS turn FROM lanes),
lead_ AS (SELECT name, state FROM turns WHERE turn IS NOT NULL ORDER BY turn, place LIMIT 1), falls AS (SELECT name FROM lanes WHERE lane = 'fading' AND state <> 'unmeasured' ORDER BY place LIMIT 1),
states AS (SELECT CASE WHEN now_ AND cs IS NOT NULL THEN cs WHEN status <> 'expired' THEN 'unmeasured' END AS state FROM flags)"""


@query(f"""WITH {series_sql()}, {_DEFS}, {_BOARD}, {_SNAP}, {_LANES.replace("now_ AS (", "today AS (", 1).replace("FROM now_", "FROM today")}
SELECT DATE '{LAST}' AS date, (SELECT name FROM lead_) AS lead, (SELECT state FROM lead_) AS lead_state, (SELECT name FROM falls) AS fading,
  CASE WHEN (SELECT state FROM lead_) = 'rising' THEN 'gaining' WHEN (SELECT state FROM lead_) = 'peaking' THEN 'at_peak' WHEN (SELECT name FROM lead_) IS NOT NULL THEN 'newly_measurable' WHEN (SELECT name FROM falls) IS NOT NULL THEN 'only_fading' WHEN (SELECT count(*) FROM states WHERE state = 'unmeasured') > 0 THEN 'awaiting_coverage' ELSE 'no_movement' END AS headline,
  (SELECT count(*) FROM states WHERE state = 'unmeasured') AS unmeasured, (SELECT count(*) FROM changes WHERE change_kind = 'state_change') AS transitions, {", ".join(f"(SELECT count(*) FROM states WHERE state = '{x}') AS {x}" for x in ("rising", "peaking", "steady", "emerging", "dormant"))}, (SELECT count(*) FROM states WHERE state = 'fading') AS fading_count""")
def daily_brief_summary(spark, d):
    """Who leads the brief, who fades, how many changed; the series is read by lanes, changes and counts."""
    trends = series(spark, d)
    definitions = _definitions(spark, d)
    shown = board.lanes(trends.join(definitions, "definition_id").where(F.col("date") == F.to_date(F.lit(LAST))), LAST)
    snaps = board.snapshots(definitions, trends, LAST, PREVIOUS)
    return board.brief(shown, board.changes(snaps, LAST, PREVIOUS), board.state_counts(snaps), LAST)


@query()
def daily_brief(spark, d):
    """The sentences of the brief; number formatting differs between engines, so without SQL."""
    return board.brief_lines(board.lanes(_board(spark, d).where(F.col("date") == F.to_date(F.lit(LAST))), LAST))


@query(f"WITH {series_sql()} SELECT definition_id, CASE WHEN days_since_peak IS NULL OR peak_density <= 0 THEN 'no measured peak' WHEN days_since_peak = 0 THEN 'at its peak' ELSE CAST(CAST(floor(100 * {r('density', 2)} / {r('peak_density', 2)} + 0.5) AS BIGINT) AS VARCHAR) || '% of its peak, ' || CAST(days_since_peak AS VARCHAR) || CASE WHEN days_since_peak = 1 THEN ' day ago' ELSE ' days ago' END END AS position FROM series WHERE date = DATE '{LAST}'")
def peak_positions(spark, d):
    x = series(spark, d).where(F.col("date") == F.to_date(F.lit(LAST)))
    return x.select("definition_id", board.peak_position(F.col("density"), F.col("peak_density"), F.col("days_since_peak")).alias("position"))


@query(f"WITH {views.EVIDENCE_SQL}, {_DEFS} SELECT coalesce(parent_id, definition_id) AS section, definition_id, row_number() OVER (PARTITION BY coalesce(parent_id, definition_id) ORDER BY CASE kind WHEN 'structural' THEN 0 ELSE 1 END, name) AS place FROM defs")
def board_sections(spark, d):
    return board.sections(_definitions(spark, d)).select("section", "definition_id", F.col("place").cast("long").alias("place"))


_FIRES = f"""fires AS (SELECT definition_id, min(date) FILTER ({r("attention_z", 2)} >= 1 AND attention_matched_documents >= 2) AS first_attention, min(date) FILTER (ok AND {r("density_z", 2)} >= 1 AND matched_documents >= 2) AS first_reviewed,
  min(date) FILTER (state = 'emerging') AS first_emerging, min(date) FILTER (state = 'rising') AS first_rising, arg_max(state, date) AS latest_state, count(*) AS trend_days FROM series GROUP BY 1),
peak AS (SELECT definition_id, date AS peak_date FROM (SELECT definition_id, date, row_number() OVER (PARTITION BY definition_id ORDER BY {r("density", 2)} DESC, date) AS k FROM series WHERE ok) WHERE k = 1),
timeline AS (SELECT f.*, p.peak_date, (SELECT min(s.date) FROM series s WHERE s.definition_id = f.definition_id AND s.state = 'fading' AND s.date > p.peak_date) AS first_fading FROM fires f LEFT JOIN peak p USING (definition_id))"""


@query(f"WITH {series_sql()}, {_FIRES} SELECT * FROM timeline")
def backtest_first_fire(spark, d):
    return evaluation.first_fires(series(spark, d), 1.0)


@query(
    f"""WITH {series_sql()}, {_FIRES}, x AS (SELECT *, DATE '2024-01-20' AS created, CASE WHEN definition_id IN ('click', 'view', 'purchase') THEN DATE '2024-01-10' + CAST(length(definition_id) AS INTEGER) END AS truth_date FROM timeline),
y AS (SELECT *, datediff('day', first_attention, created) AS a_lead, datediff('day', first_emerging, created) AS e_lead, datediff('day', truth_date, first_attention) AS a_lag, datediff('day', truth_date, first_emerging) AS e_lag FROM x)
SELECT count(*) AS narratives, count(truth_date) AS with_truth, count(first_attention) AS with_attention_signal, count(first_emerging) AS with_emerging_state, median(a_lead) AS median_attention_lead, median(e_lead) AS median_emerging_lead, median(a_lag) AS median_attention_lag,
  {r("CAST(count(*) FILTER (a_lag <= 7) AS DOUBLE) / count(truth_date)")} AS attention_within_7, {r("CAST(count(*) FILTER (a_lag <= 14) AS DOUBLE) / count(truth_date)")} AS attention_within_14, {r("CAST(count(*) FILTER (e_lag <= 14) AS DOUBLE) / count(truth_date)")} AS emerging_within_14 FROM y"""
)
def backtest_summary(spark, d):
    t = evaluation.first_fires(series(spark, d), 1.0).withColumn("created", F.to_date(F.lit("2024-01-20")))
    truth = t.select("definition_id").where("definition_id in ('click', 'view', 'purchase')").withColumn("truth_date", F.date_add(F.to_date(F.lit("2024-01-10")), F.length("definition_id")))
    return evaluation.backtest_summary(evaluation.backtest(t, truth))


@query("WITH " + views.EVIDENCE_SQL + """, versions AS (SELECT *, 'v' || CAST(document_id % 3 AS VARCHAR) AS prompt_version, document_id // 10 AS doc FROM evidence)
SELECT definition_id, doc AS document_id, prompt_version, observation_id FROM (
  SELECT definition_id, doc, prompt_version, document_id AS observation_id, row_number() OVER (PARTITION BY definition_id, doc ORDER BY CASE WHEN prompt_version = 'v2' THEN 0 ELSE 1 END, date DESC, prompt_version DESC, document_id) AS k FROM versions WHERE prompt_version IN ('v2', 'v1')) WHERE k = 1""")
def distinct_on_latest(spark, d):
    e = views.evidence(spark, d)
    o = e.select("definition_id", F.floor(F.col("document_id") / 10).alias("document_id"), F.concat(F.lit("v"), (F.col("document_id") % 3).cast("string")).alias("prompt_version"), F.col("date").alias("observed_at"), F.col("document_id").alias("observation_id"))
    return narrative.resolve_observations(o, ["v2", "v1"]).select("definition_id", "document_id", "prompt_version", "observation_id")


@query("WITH " + views.EVIDENCE_SQL + " SELECT definition_id, document_id, place FROM (SELECT definition_id, document_id, row_number() OVER (PARTITION BY definition_id ORDER BY match_score DESC, date DESC, document_id) AS place FROM evidence) WHERE place <= 12")
def topk_per_group(spark, d):
    x = relational.top_per(views.evidence(spark, d), ["definition_id"], 12, F.desc("match_score"), F.desc("date"), F.asc("document_id"), rank="place")
    return x.select("definition_id", "document_id", F.col("place").cast("long").alias("place"))


@query("WITH " + views.EVIDENCE_SQL + " SELECT definition_id, story_fingerprint, document_id FROM (SELECT *, row_number() OVER (PARTITION BY definition_id, story_fingerprint ORDER BY match_score DESC, date DESC, document_id) AS k FROM evidence) WHERE k = 1")
def dedupe_story_best(spark, d):
    return relational.first_per(views.evidence(spark, d), ["definition_id", "story_fingerprint"], F.desc("match_score"), F.desc("date"), F.asc("document_id")).select("definition_id", "story_fingerprint", "document_id")


@query("WITH " + views.EVIDENCE_SQL + ", " + _days() + f""", daily AS (SELECT definition_id, date, count(*) AS n FROM evidence GROUP BY 1, 2), g AS (SELECT definition_id, y.date, y.idx, coalesce(n, 0) AS n FROM (SELECT DISTINCT definition_id FROM evidence) CROSS JOIN days y LEFT JOIN daily USING (definition_id, date)),
roll AS (SELECT *, sum(n) OVER (PARTITION BY definition_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS total FROM g),
h AS (SELECT a.definition_id, a.date, a.idx, a.total, avg(b.total) AS mean, stddev_samp(b.total) AS deviation, count(b.total) AS n FROM roll a LEFT JOIN roll b ON a.definition_id = b.definition_id AND b.idx BETWEEN 6 AND a.idx - 7 GROUP BY 1, 2, 3, 4)
SELECT definition_id, date, CAST(total AS BIGINT) AS total, CAST(n AS INTEGER) AS n, {r("(total - coalesce(mean, 0)) / greatest(coalesce(deviation, 0), 1)")} AS z FROM h""")
def expanding_baseline_z(spark, d):
    daily = views.evidence(spark, d).groupBy("definition_id", "date").agg(F.count("*").alias("n"))
    x = relational.fill_days(daily, ["definition_id"], relational.calendar(spark, FIRST, LAST), {"n": F.lit(0)})
    s = Window.partitionBy("definition_id").orderBy("idx")
    x = x.withColumn("total", F.sum("n").over(s.rowsBetween(-6, 0)))
    before = s.rowsBetween(Window.unboundedPreceding, -7)
    whole = F.when(F.col("idx") >= 6, F.col("total"))
    x = x.withColumn("whole", whole).withColumn("mean", F.avg("whole").over(before)).withColumn("deviation", F.stddev_samp("whole").over(before)).withColumn("k", F.count("whole").over(before))
    z = (F.col("total") - F.coalesce("mean", F.lit(0.0))) / F.greatest(F.coalesce("deviation", F.lit(0.0)), F.lit(1.0))
    return x.select("definition_id", "date", "total", F.col("k").cast("int").alias("n"), half_up(z, 3).alias("z"))


@query(
    "WITH " + _BURST_SQL + ", defs AS (SELECT DISTINCT definition_id || ' ' || source_class AS haystack FROM evidence WHERE source_class IN ('filing', 'newspaper')) SELECT term, stories FROM burst b WHERE (novel OR z >= 0.5) AND NOT EXISTS (SELECT 1 FROM defs WHERE contains(defs.haystack, b.term))"
)
def burst_watchlist(spark, d):
    """Bursts that no definition covers."""
    e = views.evidence(spark, d).where("source_class in ('filing', 'newspaper')")
    defs = e.select("definition_id", F.concat_ws(" ", "definition_id", "source_class").alias("name"), F.lit("").alias("proposition"), F.lit("").alias("inclusion"), F.lit("").alias("examples")).distinct()
    x = bursts.covering(bursts.scored_terms(_burst_terms(spark, d), BURST_AS_OF, BURSTS).select("term", "stories"), defs)
    return x.where(F.size("covering") == 0).select("term", "stories")


@query(f"WITH {series_sql()}, {_DEFS}, {_BOARD} SELECT definition_id, row_number() OVER (ORDER BY story_breadth > 0 DESC, CASE kind WHEN 'structural' THEN 0 ELSE 1 END, attention_z DESC, density_z DESC, story_breadth DESC, name) AS place FROM board WHERE date = DATE '{LAST}'")
def board_order(spark, d):
    x = _board(spark, d).where(F.col("date") == F.to_date(F.lit(LAST)))
    return x.select("definition_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*board.by_kind())).cast("long").alias("place"))


@query("WITH " + views.EVIDENCE_SQL + ", x AS (SELECT definition_id AS e, CASE WHEN document_id % 4 = 0 THEN 'view' ELSE definition_id END AS p FROM evidence WHERE document_id % 6 <> 0) SELECT count(*) AS documents, count(*) FILTER (e = p) AS found, floor(CAST(count(*) FILTER (e = p) AS DOUBLE) / count(*) * 1000 + 0.5) / 1000.0 AS document_recall FROM x")
def document_recall(spark, d):
    e = views.evidence(spark, d)
    return evaluation.document_recall(e.select(F.when(F.col("document_id") % 6 != 0, F.array("definition_id")).alias("expected_slugs"), F.array(F.when(F.col("document_id") % 4 == 0, "view").otherwise(F.col("definition_id"))).alias("predicted_slugs")))


@query("WITH " + views.EVIDENCE_SQL + " SELECT definition_id, source_class, count(*) AS n, max(date) AS latest FROM evidence WHERE date BETWEEN DATE '2024-01-30' - 6 AND DATE '2024-01-30' AND match_score >= 20 GROUP BY 1, 2")
def evidence_page_counts(spark, d):
    """The evidence of a window, by class, as the evidence page pages through it."""
    x = views.evidence(spark, d).where("date between date'2024-01-24' and date'2024-01-30' and match_score >= 20")
    return x.groupBy("definition_id", "source_class").agg(F.count("*").alias("n"), F.max("date").alias("latest"))
