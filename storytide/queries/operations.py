"""Promotion of candidates, telemetry of sources, jobs under control, parts of the brief, themes below themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import board, candidates, status, themes
from ..plans import views
from .narratives import _BOARD, _DEFS, _LANES, _SNAP, LAST, _board, _changes, series_sql
from .registry import query

AS_OF = "2024-01-30 12:00:00"
_URLS = ("https://news.test/a", "https://www.youtube.com/watch", "https://wire.test/b", "https://paper.test:8080/c")


def _evidence(spark, d):
    """The evidence of candidates (narratives of a class): judged texts, some of which have changed, previews, sources."""
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    v, n = views.evidence(spark, d), F.col("document_id")
    x = v.join(e.select(F.col("event_id").alias("document_id"), "ts"), "document_id")
    return x.select(
        F.concat_ws("/", "entity", "source_class").alias("candidate_id"), n.alias("document_id"), F.col("ts").alias("published"), F.col("match_score").alias("score"), F.lit("h").alias("text_hash"),
        F.when(n % 9 == 4, "changed").otherwise("h").alias("content_hash"), F.when(n % 7 == 3, "Preview").otherwise("full").alias("content"), F.when(n % 5 == 0, " ").otherwise("publisher_owner").alias("owner_kind"), F.when(n % 5 == 0, " ").otherwise(F.col("publisher_owner")).alias("owner"),
        F.concat(F.lit("Pub "), (n % 6).cast("string")).alias("publisher"), F.when(n % 13 == 5, "YouTube").otherwise("web").alias("platform"), F.element_at(F.array(*map(F.lit, _URLS)), (n % 4 + 1).cast("int")).alias("url"), F.col("story_fingerprint").alias("story"), "definition_id",
    ).drop("owner_kind")


_CANDIDATES = views.EVIDENCE_SQL + ", ev AS (SELECT entity || '/' || source_class AS candidate_id, document_id, e.ts AS published, match_score AS score, document_id % 9 = 4 AS changed, document_id % 7 = 3 AS preview, CASE WHEN document_id % 5 = 0 THEN 'pub ' || CAST(document_id % 6 AS VARCHAR) ELSE lower(publisher_owner) END AS owner, 'pub ' || CAST(document_id % 6 AS VARCHAR) AS publisher, CASE WHEN document_id % 13 = 5 THEN 'youtube' ELSE 'web' END AS platform, CASE document_id % 4 " + " ".join(f"WHEN {k} THEN '{u}'" for k, u in enumerate(_URLS)) + " END AS url, story_fingerprint AS story, definition_id FROM evidence JOIN events e ON e.event_id = document_id), cand AS (SELECT DISTINCT candidate_id, CASE WHEN candidate_id LIKE 'entity1%' THEN 'rejected' ELSE 'pending' END AS status, CASE length(candidate_id) % 3 WHEN 0 THEN 'ineligible' WHEN 1 THEN 'eligible' END AS validation, TIMESTAMP '2024-01-20' AS evaluated, CASE WHEN candidate_id LIKE '%filing' THEN TIMESTAMP '2024-01-21' ELSE TIMESTAMP '2024-01-19' END AS updated FROM ev)"


@query("WITH " + _CANDIDATES + f""", open_ AS (SELECT candidate_id FROM cand WHERE status = 'pending' AND (coalesce(validation, '') IN ('', 'eligible') OR evaluated IS NULL OR updated > evaluated)),
strong AS (SELECT * FROM ev SEMI JOIN open_ USING (candidate_id) WHERE score >= 90),
recent AS (SELECT * FROM strong WHERE published BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}' AND NOT changed AND NOT preview AND owner NOT IN ('youtube') AND platform <> 'youtube' AND url NOT LIKE '%.youtube.com/%'),
b AS (SELECT candidate_id, count(DISTINCT story) AS stories, count(DISTINCT owner) AS owners, max(published) AS latest FROM recent GROUP BY 1 HAVING count(DISTINCT story) >= 3 AND count(DISTINCT owner) >= 3),
span AS (SELECT candidate_id, max(published) - min(published) >= INTERVAL 7 DAY AS long_ FROM strong WHERE published <= TIMESTAMP '{AS_OF}' GROUP BY 1),
total AS (SELECT candidate_id, count(DISTINCT document_id) AS n FROM strong GROUP BY 1),
att AS (SELECT DISTINCT candidate_id FROM (SELECT candidate_id, definition_id, count(DISTINCT document_id) AS shared FROM strong WHERE definition_id IN ('purchase', 'view') GROUP BY 1, 2) JOIN total USING (candidate_id) WHERE shared >= greatest(2, ceil(n * 0.5))),
r AS (SELECT b.candidate_id, stories, owners, latest, coalesce(long_, false) OR a.candidate_id IS NOT NULL AS persistent, row_number() OVER (ORDER BY latest DESC, b.candidate_id) AS turn FROM b LEFT JOIN span USING (candidate_id) LEFT JOIN att a ON a.candidate_id = b.candidate_id)
SELECT candidate_id, stories, owners, CAST(epoch_us(latest) AS BIGINT) AS latest, persistent, turn FROM r WHERE turn <= 40""")
def promotion_queue(spark, d):
    """Candidates to validate next, under floors that the looser policy given here can't move."""
    ev = _evidence(spark, d)
    ids = ev.select("candidate_id").distinct()
    n = F.length("candidate_id") % 3
    time = lambda v: F.to_timestamp(F.lit(v))
    own = ids.select("candidate_id", F.when(F.col("candidate_id").startswith("entity1"), "rejected").otherwise("pending").alias("status"), F.when(n == 0, "ineligible").when(n == 1, "eligible").alias("validation"), time("2024-01-20 00:00:00").alias("evaluated"), F.when(F.col("candidate_id").endswith("filing"), time("2024-01-21 00:00:00")).otherwise(time("2024-01-19 00:00:00")).alias("updated"))
    parents = ev.where("definition_id IN ('purchase', 'view')").select("definition_id", "document_id")
    loose = candidates.PromotionPolicy(least_score=10.0, least_stories=1, least_owners=1, window_days=60)
    x = candidates.promotion_queue(own, ev.drop("definition_id"), parents, AS_OF, loose, limit=40)
    return x.select("candidate_id", "stories", "owners", F.unix_micros("latest").alias("latest"), "persistent", F.col("turn").cast("long").alias("turn"))


_VERDICTS = views.EVIDENCE_SQL + """, v AS (SELECT entity || '/' || publisher_id AS candidate_id, document_id % 8 <> 1 AND document_id % 11 <> 2 AND document_id % 10 <> 3 AS ok, CASE WHEN document_id % 19 = 0 THEN NULL ELSE definition_id END AS event_key, CASE WHEN document_id % 17 = 0 THEN NULL ELSE publisher_owner END AS entity_key, story_fingerprint AS story, 'o' || CAST(document_id % 5 AS VARCHAR) AS owner, source_class FROM evidence),
d AS (SELECT DISTINCT candidate_id, CASE length(candidate_id) % 4 WHEN 0 THEN 'manual_review' WHEN 1 THEN 'reject' ELSE 'approve' END AS decision, CASE WHEN candidate_id LIKE 'entity2%' THEN 'event' ELSE 'structural' END AS kind, CASE WHEN candidate_id LIKE '%7' THEN 'A label' ELSE ' ' END AS label, CASE WHEN candidate_id LIKE '%3' THEN 'Not a Single-Company story' ELSE '' END AS exclusion FROM v),
p AS (SELECT candidate_id, count(*) AS supported, count(DISTINCT story) AS stories, count(DISTINCT event_key) AS events, count(DISTINCT entity_key) AS entities, count(DISTINCT owner) AS owners, count(DISTINCT source_class) AS classes, count(*) FILTER (event_key IS NULL) AS no_event, count(*) FILTER (entity_key IS NULL) AS no_entity FROM v WHERE ok GROUP BY 1),
j AS (SELECT d.*, coalesce(supported, 0) AS supported, coalesce(stories, 0) AS stories, coalesce(events, 0) AS events, coalesce(entities, 0) AS entities, coalesce(owners, 0) AS owners, coalesce(classes, 0) AS classes, coalesce(no_event, 0) AS no_event, coalesce(no_entity, 0) AS no_entity FROM d LEFT JOIN p USING (candidate_id)),
r AS (SELECT *, list_filter([CASE WHEN decision = 'manual_review' THEN 'VALIDATOR_REQUIRES_MANUAL_REVIEW' END, CASE WHEN decision = 'reject' THEN 'VALIDATOR_REJECTED' END, CASE WHEN stories < 3 THEN 'INSUFFICIENT_UNIQUE_STORIES' END, CASE WHEN owners < 3 THEN 'INSUFFICIENT_PUBLISHER_OWNERS' END, CASE WHEN no_event > 0 THEN 'MISSING_EVENT_KEYS' END, CASE WHEN no_entity > 0 THEN 'MISSING_PRIMARY_ENTITY_KEYS' END, CASE WHEN kind = 'event' AND trim(label) = '' THEN 'EVENT_LABEL_REQUIRED' END, CASE WHEN kind = 'event' AND events <> 1 THEN 'EVENT_KEY_MUST_BE_SINGULAR' END, CASE WHEN kind <> 'event' AND events < 2 AND entities < 2 THEN 'STRUCTURAL_REQUIRES_MULTIPLE_EVENTS_OR_ENTITIES' END, CASE WHEN kind <> 'event' AND classes < 2 AND events < 2 THEN 'STRUCTURAL_REQUIRES_SOURCE_OR_EVENT_BREADTH' END, CASE WHEN exclusion <> '' AND entities < 2 THEN 'SINGLE_COMPANY_EXCLUSION_VIOLATED' END], lambda x: x IS NOT NULL) AS reasons FROM j)
SELECT candidate_id, CASE WHEN len(reasons) = 0 THEN 'eligible' WHEN decision = 'manual_review' THEN 'manual_review' ELSE 'ineligible' END AS status, array_to_string(reasons, ',') AS reasons, supported, stories FROM r"""


@query("WITH " + _VERDICTS)
def promotion_verdicts(spark, d):
    """What validation makes of candidates, with the codes of its reasons."""
    e, n = views.evidence(spark, d), F.col("document_id")
    v = e.select(F.concat_ws("/", "entity", "publisher_id").alias("candidate_id"), n.alias("evidence_id"), F.when(n % 10 == 3, "reject").otherwise("support").alias("verdict"), (n % 8 != 1).alias("supports"), (n % 11 == 2).alias("violates"), F.when(n % 19 == 0, " ").otherwise(F.col("definition_id")).alias("event_key"), F.when(n % 17 != 0, F.col("publisher_owner")).alias("entity_key"), F.col("story_fingerprint").alias("story"), F.concat(F.lit("o"), (n % 5).cast("string")).alias("owner"), "source_class")
    k = F.length("candidate_id") % 4
    c = F.col("candidate_id")
    own = v.select("candidate_id").distinct().select("candidate_id", F.when(k == 0, "manual_review").when(k == 1, "reject").otherwise("approve").alias("decision"), F.when(c.startswith("entity2"), "event").otherwise("structural").alias("kind"), F.when(c.endswith("7"), "A label").otherwise(" ").alias("event_label"), F.when(c.endswith("3"), "Not a Single-Company story").otherwise("").alias("exclusion"))
    return candidates.promotion_verdicts(own, v).select("candidate_id", "status", F.array_join("reasons", ",").alias("reasons"), "supported", "stories")


@query("SELECT count(*) AS runs, CAST(sum(k) AS BIGINT) AS fetched, CAST(sum(k // 2) AS BIGINT) AS inserted, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 50 END) AS BIGINT) AS skipped, 0 AS failed, floor(sum(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 50 END) * 1000.0 / sum(k) + 0.5) / 1000.0 AS dedupe_rate FROM (SELECT *, event_id % 100 AS k FROM events WHERE event_type IN ('click', 'view') AND user_id % 7 <> 0)")
def polling_summary(spark, d):
    """What polls fetched, and the share of it that was there."""
    e = views.table(spark, d, "events")
    k, u = F.col("event_id") % 100, F.col("user_id")
    meta = F.to_json(F.struct(k.alias("fetched"), F.floor(k / 2).alias("inserted"), F.when(u % 3 != 0, u % 50).alias("skipped")))
    runs = e.select(F.when(F.col("event_type").isin("click", "view"), "poll_sources").otherwise("classify").alias("stage"), F.when(u % 7 == 0, "failed").otherwise("completed").alias("status"), meta.alias("metadata"))
    return status.polling(runs)


TODAY = "2024-03-20"
_SOURCES = views.TEXTS_SQL + f""", docs AS (SELECT document_id, publisher AS source_id, source_class, date AS published, document_id % 12 = 1 AS bare, document_id % 9 = 2 AS capital, n_chars, md5(text) AS h FROM texts WHERE text IS NOT NULL AND publisher IS NOT NULL),
ext AS (SELECT document_id, CASE document_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'failed' END AS s, CAST(document_id % 8 AS INTEGER) AS a FROM docs WHERE document_id % 4 <> 0),
dis AS (SELECT document_id, CASE document_id % 3 WHEN 0 THEN 'completed' ELSE 'failed' END AS s, document_id % 5 AS a, CASE WHEN document_id % 7 = 0 THEN 'old' WHEN document_id % 7 = 1 THEN NULL ELSE h END AS h FROM docs WHERE document_id % 6 <> 0),
rules AS (SELECT * FROM (VALUES ('short', 30), ('long', 80)) v(rule, days)),
obs AS (SELECT document_id, rule, document_id % 3 = 0 AS matched, CASE document_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review FROM docs, rules WHERE (document_id % 5 <> 0 OR rule = 'short') AND document_id % 11 <> 0),
kept AS (SELECT * FROM docs WHERE NOT bare),
about AS (SELECT source_id, min(source_class) AS source_class, count(*) AS documents, max(published) AS latest FROM docs GROUP BY 1),
x1 AS (SELECT source_id, count(DISTINCT k.document_id) FILTER (s = 'completed') AS analysed, count(DISTINCT k.document_id) FILTER (coalesce(s, '') NOT IN ('completed', 'running') AND coalesce(a, 0) < 5) AS extraction_backlog FROM kept k LEFT JOIN ext USING (document_id) GROUP BY 1),
x2 AS (SELECT source_id, count(DISTINCT k.document_id) AS classification_backlog FROM kept k WHERE EXISTS (SELECT 1 FROM rules r WHERE k.published >= DATE '{TODAY}' - r.days AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.document_id = k.document_id AND o.rule = r.rule)) GROUP BY 1),
x3 AS (SELECT source_id, count(DISTINCT k.document_id) FILTER (datediff('day', published, DATE '{TODAY}') <= 30 AND (d.document_id IS NULL OR (d.h IS NOT NULL AND d.h <> k.h) OR (d.s NOT IN ('completed', 'running') AND d.a < 3))) AS discovery_backlog FROM kept k LEFT JOIN dis d ON d.document_id = k.document_id WHERE n_chars > 0 GROUP BY 1),
x4 AS (SELECT source_id, count(*) FILTER (review = 'pending') AS matched_pending, count(*) FILTER (review = 'approved') AS matched_approved, count(*) FILTER (review = 'rejected') AS matched_rejected FROM obs JOIN docs USING (document_id) WHERE matched GROUP BY 1),
ids AS (SELECT source_id FROM docs UNION SELECT 'feed only')
SELECT i.source_id, source_class, CASE WHEN i.source_id IN ('src1', 'feed only') THEN 'Feed ' || i.source_id ELSE i.source_id END AS label, coalesce(documents, 0) AS documents, latest, coalesce(analysed, 0) AS analysed, coalesce(extraction_backlog, 0) AS extraction_backlog, coalesce(classification_backlog, 0) AS classification_backlog, coalesce(discovery_backlog, 0) AS discovery_backlog, coalesce(matched_pending, 0) AS matched_pending, coalesce(matched_approved, 0) AS matched_approved, coalesce(matched_rejected, 0) AS matched_rejected, CASE WHEN i.source_id = 'src2' THEN 'timeout' END AS last_error
FROM ids i LEFT JOIN about USING (source_id) LEFT JOIN x1 USING (source_id) LEFT JOIN x2 USING (source_id) LEFT JOIN x3 USING (source_id) LEFT JOIN x4 USING (source_id)"""


@query("WITH " + _SOURCES)
def source_telemetry(spark, d):
    """What waits and what was done, per source."""
    t = views.texts(spark, d).where("text IS NOT NULL AND publisher IS NOT NULL")
    n = F.col("document_id")
    docs = t.select("document_id", F.col("publisher").alias("source_id"), "source_class", F.col("date").alias("published"), F.when(n % 12 == 1, "metadata_only").alias("retention"), F.when(n % 9 == 2, "capital_markets").alias("category"), F.md5("text").alias("text_hash"), F.col("n_chars").alias("text_length"))
    runs = docs.where(n % 4 != 0).select("document_id", F.when(n % 5 == 0, "completed").when(n % 5 == 1, "running").otherwise("failed").alias("status"), (n % 8).alias("attempts"))
    looks = docs.where(n % 6 != 0).select("document_id", F.when(n % 3 == 0, "completed").otherwise("failed").alias("status"), (n % 5).alias("attempts"), F.when(n % 7 == 0, "old").when(n % 7 != 1, F.col("text_hash")).alias("text_hash"))
    rules = spark.createDataFrame([("short", 30), ("long", 80)], "rule string, days int")
    seen = docs.select("document_id").crossJoin(F.broadcast(rules.select("rule"))).where(((n % 5 != 0) | (F.col("rule") == "short")) & (n % 11 != 0))  # two rules
    seen = seen.select("document_id", "rule", (n % 3 == 0).alias("matched"), F.when(n % 4 == 0, "approved").when(n % 4 == 1, "rejected").otherwise("pending").alias("review_status"))
    checks = spark.createDataFrame([("src2", None, None, "timeout")], "source_id string, last_attempt timestamp, last_success timestamp, last_error string")
    feeds = spark.createDataFrame([("src1", "Feed src1", True), ("feed only", "Feed feed only", False)], "source_id string, name string, enabled boolean")
    return status.source_telemetry(docs, runs, looks, seen, rules, checks, feeds, TODAY).drop("enabled", "last_attempt", "last_success")


_EVENTS = "SELECT user_id AS job, ts AS moment, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'queue' ELSE CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'beat' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'stop' END END AS event FROM events"
_STEPS = "CASE " + " ".join(f"WHEN s = '{s}' AND e = '{e}' THEN '{to}'" for (s, e), to in status.JOB_STEPS.items()) + " ELSE s END"


@query(f"WITH ev AS ({_EVENTS}), log AS (SELECT job, list(event ORDER BY moment, event) AS events, max(moment) AS last FROM ev GROUP BY 1), w AS (SELECT job, list_reduce(list_concat(['none'], events), lambda s, e: {_STEPS}) AS state, last FROM log), x AS (SELECT *, state IN ('running', 'stop_requested') AND last < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE AS stale FROM w) SELECT job, CASE WHEN stale THEN 'failed' ELSE state END AS state, stale FROM x")
def controlled_jobs(spark, d):
    """Jobs that are queued, claimed, stopped, finished or left behind, one a user."""
    from pyspark.sql import Window

    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    kind = F.col("event_type")
    event = F.when(first, "queue").when(kind == "click", "claim").when(kind == "view", "beat").when(kind == "purchase", "finish").when(kind == "error", "fail").otherwise("stop")
    x = e.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), event.alias("event"))
    return status.controlled_jobs(x, AS_OF).select("job", "state", "stale")


_PARTS = _LANES.replace("now_ AS (", "today AS (", 1).replace("FROM now_", "FROM today")
_RANK = "CASE change_kind " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(board.CHANGES)) + " END"


@query(f"WITH {series_sql()}, {_DEFS}, {_BOARD}, {_SNAP}, {_PARTS} SELECT CASE lane WHEN 'rising' THEN 0 WHEN 'peaking' THEN 1 WHEN 'fading' THEN 2 ELSE 3 END AS section, place, name AS definition_id, lane AS what FROM lanes UNION ALL SELECT 4, k, definition_id, change_kind FROM (SELECT *, row_number() OVER (ORDER BY {_RANK}, abs(change) DESC, definition_id) AS k FROM changes WHERE change_kind <> 'mover') WHERE k <= 8")
def brief_sections(spark, d):
    """The parts of the daily brief, with what changed."""
    lanes = board.lanes(_board(spark, d).where(F.col("date") == F.to_date(F.lit(LAST))), LAST)
    return board.brief_sections(lanes, _changes(spark, d))


@query(f"WITH {series_sql()}, {_DEFS}, {_BOARD}, {_SNAP}, {_PARTS}, s AS (SELECT CASE lane WHEN 'rising' THEN 0 WHEN 'peaking' THEN 1 WHEN 'fading' THEN 2 ELSE 3 END AS section, place, name FROM lanes), f AS (SELECT name, min((section, place)) AS first_ FROM s GROUP BY 1) SELECT name AS definition_id, row_number() OVER (ORDER BY first_) AS place FROM f")
def brief_narratives(spark, d):
    """The narratives that the brief's lanes name."""
    lanes = board.lanes(_board(spark, d).where(F.col("date") == F.to_date(F.lit(LAST))), LAST)
    return board.brief_ids(board.brief_sections(lanes, _changes(spark, d)))


@query("SELECT * FROM (SELECT p_mfgr AS theme_id, row_number() OVER (PARTITION BY p_mfgr ORDER BY sector NULLS LAST, p_brand, subtheme_id) AS place, subtheme_id FROM (SELECT DISTINCT substr(p_brand, 1, 7) AS p_mfgr, p_brand, p_brand || ' ' || p_size AS subtheme_id, CASE WHEN p_size % 3 <> 0 THEN 'sector ' || (p_size % 4) END AS sector FROM part)) WHERE place <= 12")
def related_subthemes(spark, d):
    """The themes below each theme."""
    p = views.table(spark, d, "part")
    x = p.select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("theme_id"), F.substring("p_brand", 1, 7).alias("parent_theme_id"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("sector "), (F.col("p_size") % 4).cast("string"))).alias("sector"), F.col("p_brand").alias("label")).distinct()
    return themes.subthemes(x).select("theme_id", F.col("place").cast("long").alias("place"), "subtheme_id")
