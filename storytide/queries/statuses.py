"""Funnels, telemetry, work selection, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..operators import relational, status
from ..plans import views
from ..session import scratch
from ..sources import archive
from ..streaming import ingestion, streams, windows
from .registry import query, r


def _flags(spark, d):
    """Every document with its funnel flags, from its id and label."""
    t = views.texts(spark, d).select("document_id", "source_class", "text").join(views.table(spark, d, "labels").withColumnRenamed("doc_id", "document_id"), "document_id", "left")
    i = F.col("document_id")
    flags = {"with_text": F.length("text") > 100, "extracted": i % 2 == 0, "with_signals": i % 4 == 0, "classified": i % 3 == 0, "matched": F.coalesce(F.col("quality") == 1, F.lit(False)), "approved": F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)), "candidate_evidence": i % 10 == 0}
    return t.select("document_id", "source_class", *[c.alias(k) for k, c in flags.items()])


_FLAGS = views.TEXTS_SQL + ", flags AS (SELECT t.document_id, source_class, length(text) > 100 AS with_text, t.document_id % 2 = 0 AS extracted, t.document_id % 4 = 0 AS with_signals, t.document_id % 3 = 0 AS classified, coalesce(quality = 1, false) AS matched, coalesce(quality = 1 AND toxic = 0, false) AS approved, t.document_id % 10 = 0 AS candidate_evidence FROM texts t LEFT JOIN labels l ON l.doc_id = t.document_id)"
_COUNTS = "count(*) AS ingested, " + ", ".join(f"count(*) FILTER ({s}) AS {s}" for s in status.STAGES)


@query("WITH " + _FLAGS + f" SELECT CASE WHEN grouping(source_class) = 1 THEN 'all' ELSE source_class END AS source_class, {_COUNTS} FROM flags GROUP BY ROLLUP (source_class)")
def rollup_funnel(spark, d):
    return status.funnel(_flags(spark, d))


@query("WITH " + _FLAGS + f", c AS (SELECT {_COUNTS} FROM flags), s AS (" + " UNION ALL ".join(f"SELECT {k} AS place, '{s}' AS stage, {s} AS n, {('ingested', *status.STAGES)[max(0, k - 1)]} AS before, ingested FROM c" for k, s in enumerate(("ingested", *status.STAGES))) + f") SELECT place, stage, n, {r('CAST(n AS DOUBLE) / before')} AS share_of_previous, {r('CAST(n AS DOUBLE) / ingested')} AS share_of_ingested FROM s")
def funnel_shares(spark, d):
    return status.funnel_stages(status.funnel(_flags(spark, d)).where("source_class = 'all'"))


@query("WITH " + views.TEXTS_SQL + ", ids AS (SELECT publisher FROM texts UNION SELECT 'src999'), a AS (SELECT publisher, count(*) AS documents FROM texts GROUP BY 1), b AS (SELECT publisher, count(*) AS english FROM texts WHERE lang = 'en' GROUP BY 1), c AS (SELECT publisher, count(*) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM texts t JOIN labels l ON l.doc_id = t.document_id GROUP BY 1) SELECT publisher, coalesce(documents, 0) AS documents, coalesce(english, 0) AS english, coalesce(labelled, 0) AS labelled, coalesce(toxic, 0) AS toxic FROM ids LEFT JOIN a USING (publisher) LEFT JOIN b USING (publisher) LEFT JOIN c USING (publisher)")
def left_outer_telemetry(spark, d):
    t = views.texts(spark, d)
    ids = t.select("publisher").union(spark.range(1).select(F.lit("src999"))).distinct()
    lab = t.join(views.table(spark, d, "labels").withColumnRenamed("doc_id", "document_id"), "document_id")
    return status.telemetry(ids, "publisher", t.groupBy("publisher").agg(F.count("*").alias("documents")), t.where("lang = 'en'").groupBy("publisher").agg(F.count("*").alias("english")), lab.groupBy("publisher").agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic")))


@query("WITH " + views.EVIDENCE_SQL + ", docs AS (SELECT document_id // 5 AS document_id, arg_min(source_class, document_id) AS source_class FROM evidence GROUP BY document_id // 5), runs AS (SELECT document_id // 5 AS document_id, CASE WHEN document_id % 7 = 0 THEN 'succeeded' ELSE 'failed' END AS st FROM evidence WHERE document_id % 5 <> 0), p AS (SELECT document_id, bool_or(st = 'succeeded') AS done, count(*) FILTER (st <> 'succeeded') AS f FROM runs GROUP BY 1) SELECT source_class, count(*) AS documents, count(*) FILTER (coalesce(done, false)) AS completed, count(*) FILTER (NOT coalesce(done, false) AND coalesce(f, 0) >= 3) AS exhausted, count(*) FILTER (NOT coalesce(done, false) AND coalesce(f, 0) < 3) AS waiting FROM docs LEFT JOIN p USING (document_id) GROUP BY 1")
def attempt_backlog(spark, d):
    e = views.evidence(spark, d)
    k = F.floor(F.col("document_id") / 5).alias("document_id")
    docs = e.groupBy(k).agg(F.min_by("source_class", "document_id").alias("source_class"))
    runs = e.where("document_id % 5 <> 0").select(k, F.when(F.col("document_id") % 7 == 0, "succeeded").otherwise("failed").alias("status"))
    return status.backlog(docs, runs, 3)


@query("WITH " + views.EVIDENCE_SQL + ", x AS (SELECT source_class, document_id, row_number() OVER (PARTITION BY source_class ORDER BY date DESC, document_id) AS turn FROM evidence) SELECT source_class, document_id, turn FROM x WHERE turn <= 25")
def round_robin_fair_share(spark, d):
    x = relational.fair_share(views.evidence(spark, d), "source_class", F.desc("date"), F.asc("document_id"))
    return x.where("turn <= 25").select("source_class", "document_id", F.col("turn").cast("long").alias("turn"))


@query("WITH " + views.EVIDENCE_SQL + ", x AS (SELECT *, date >= DATE '2024-01-30' - 1 AS recent, row_number() OVER (PARTITION BY source_class ORDER BY date DESC, document_id) AS turn FROM evidence), o AS (SELECT document_id, row_number() OVER (ORDER BY recent DESC, CASE WHEN recent THEN date END DESC NULLS LAST, CASE WHEN NOT recent THEN turn END ASC NULLS FIRST, date DESC, document_id) AS place FROM x) SELECT * FROM o WHERE place <= 900")
def recent_band_ordering(spark, d):
    return status.classification_order(views.evidence(spark, d), "2024-01-30", 1, 900).select("document_id", F.col("place").cast("long").alias("place"))


@query("WITH " + views.TEXTS_SQL + ", x AS (SELECT document_id, source_class, sum(n_chars) OVER w AS total, row_number() OVER w AS k FROM texts WINDOW w AS (PARTITION BY source_class ORDER BY date DESC, document_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT document_id, source_class FROM x WHERE total <= 100000 OR k = 1")
def byte_budget_prefix(spark, d):
    return relational.budget_prefix(views.texts(spark, d), F.col("n_chars"), 100000, ["source_class"], F.desc("date"), F.asc("document_id")).select("document_id", "source_class")


@query("SELECT event_type AS model, count(*) AS requests, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS input_tokens FROM events GROUP BY 1")
def usage_accounting(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_type").alias("model"), F.to_json(F.struct(F.get_json_object("props", "$.k").alias("input_tokens"))).alias("usage"))
    return status.usage(e, "model").select("model", "requests", "input_tokens")


@query("SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100.0 AS total FROM events GROUP BY 1, 2")
def tumbling_daily_counts(spark, d):
    """The streaming aggregate, run over what is there."""
    s = streams.daily_counts(streams.parquet_stream(spark, f"{d}/events.parquet"), "ts", "event_type")
    x = streams.drain(s, "tumbling_daily_counts", "update", ("date", "event_type"))
    return x.select("date", "event_type", "n", half_up(F.col("total")).alias("total"))


@query("SELECT event_type, CAST(ts AS DATE) + CAST(i AS INTEGER) AS date, count(*) AS n FROM events, range(7) t(i) GROUP BY 1, 2")
def sliding_7d_counts(spark, d):
    s = streams.sliding_counts(streams.parquet_stream(spark, f"{d}/events.parquet"), "ts", "event_type")
    return streams.drain(s, "sliding_7d_counts", "update", ("event_type", "date")).select("event_type", "date", "n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(DISTINCT k) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1")
def session_activity(spark, d):
    e = views.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT count(*) AS documents FROM (SELECT DISTINCT sha256(text) FROM documents)")
def stream_content_dedupe(spark, d):
    """Stateful removal of repeated texts from a stream: the first of each hash stays."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 91).cast("int")).cast("timestamp")
    x = streams.parquet_stream(spark, f"{d}/documents.parquet").select(F.sha2("text", 256).alias("hash"), day.alias("seen"))
    return streams.drain(streams.first_by_hash(x, "seen", "hash", "120 days"), "stream_content_dedupe").agg(F.count("*").alias("documents"))


@query("WITH " + views.TEXTS_SQL + ", x AS (SELECT document_id, CASE WHEN source_class = 'transcript' THEN 0 WHEN source_class = 'filing' AND document_id % 3 = 0 THEN 1 ELSE 2 END AS band FROM texts) SELECT band, count(*) AS n, min(document_id) AS first_document FROM x GROUP BY 1")
def extraction_order(spark, d):
    form = F.when(F.col("document_id") % 3 == 0, "10-K")
    x = views.texts(spark, d).select("document_id", status.extraction_rank(F.col("source_class"), form).alias("band"))
    return x.groupBy("band").agg(F.count("*").alias("n"), F.min("document_id").alias("first_document"))


@query("WITH " + views.EVIDENCE_SQL + ", a AS (SELECT document_id, match_score AS v FROM evidence WHERE document_id % 3 <> 1), b AS (SELECT document_id, CASE WHEN document_id % 5 = 0 THEN -1.0 ELSE match_score END AS v FROM evidence WHERE document_id % 2 = 0) SELECT coalesce(a.document_id, b.document_id) AS document_id, CASE WHEN b.document_id IS NOT NULL THEN b.v ELSE a.v END AS v, b.document_id IS NOT NULL AND (a.document_id IS NULL OR a.v IS DISTINCT FROM b.v) AS changed FROM a FULL JOIN b ON a.document_id = b.document_id")
def merge_upsert(spark, d):
    """The rows that an upsert would store, with those that changed."""
    from ..sources.sinks import merge

    e = views.evidence(spark, d).select("document_id", F.col("match_score").alias("v"))
    b = e.where("document_id % 2 = 0").withColumn("v", F.when(F.col("document_id") % 5 == 0, -1.0).otherwise(F.col("v")))
    return merge(e.where("document_id % 3 <> 1"), b, ["document_id"]).withColumnRenamed("__changed", "changed")


@query("WITH w AS (SELECT user_id, max(ts) AS last_ts FROM events WHERE event_id % 2 = 0 GROUP BY 1), p AS (SELECT user_id, max(ts) AS new_ts FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(w.user_id, p.user_id) AS user_id, greatest(last_ts, new_ts) AS last_published FROM w FULL JOIN p ON w.user_id = p.user_id")
def watermark_advance(spark, d):
    from ..sources.readers import advance_watermark

    e = views.table(spark, d, "events")
    stored = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("last_published"))
    return advance_watermark(stored, e.where("event_id % 2 = 1").select("user_id", F.col("ts").alias("published")), "user_id")


_ARRIVALS = views.TEXTS_SQL + """, arrivals AS (
  SELECT CAST(document_id AS VARCHAR) AS document_id, date, 'preview' AS content, title AS body FROM texts WHERE lang = 'en' AND text IS NOT NULL
  UNION ALL SELECT CAST(document_id AS VARCHAR), date + 1, 'full', text FROM texts WHERE text IS NOT NULL
  UNION ALL SELECT CAST(document_id AS VARCHAR), date + 2, 'full', text || ' (corrected)' FROM texts WHERE lang = 'de' AND text IS NOT NULL
  UNION ALL SELECT CAST(document_id AS VARCHAR), date + 3, 'preview', title FROM texts WHERE lang = 'fr' AND text IS NOT NULL
), firsts AS (
  SELECT *, sha256(body) AS hash FROM arrivals QUALIFY row_number() OVER (PARTITION BY sha256(body) ORDER BY date, document_id) = 1
), numbered AS (
  SELECT *, row_number() OVER w AS k, first_value(content) OVER w AS begun, min(CASE WHEN content = 'full' THEN date END) OVER (PARTITION BY document_id) AS full_date FROM firsts WINDOW w AS (PARTITION BY document_id ORDER BY date, hash)
), changes AS (
  SELECT *, CASE WHEN k = 1 THEN 'insert' WHEN begun = 'preview' AND content = 'full' AND date = full_date THEN 'upgrade' ELSE 'revision' END AS action FROM numbered
), stored AS (
  SELECT CASE WHEN action = 'revision' THEN document_id || ':rev:' || substr(hash, 1, 8) ELSE document_id END AS stored_id, action, content, hash, date FROM changes
)"""


def _arrivals(spark, d):
    """Arrivals of all texts by day: previews of some languages a day ahead, corrections and previews again later."""
    t = views.texts(spark, d).where("text IS NOT NULL").withColumn("document_id", F.col("document_id").cast("string"))
    kinds = [(0, "preview", F.col("title"), "en"), (1, "full", F.col("text"), None), (2, "full", F.concat("text", F.lit(" (corrected)")), "de"), (3, "preview", F.col("title"), "fr")]
    out = None
    for days, content, body, lang in kinds:
        x = (t if lang is None else t.where(F.col("lang") == lang)).select("document_id", F.date_add("date", days).cast("timestamp").alias("at"), F.lit(content).alias("content"), F.sha2(body, 256).alias("hash"), body.alias("text"))
        out = x if out is None else out.unionByName(x)
    return out


@query("WITH " + _ARRIVALS + " SELECT stored_id, action, content, hash, date FROM stored QUALIFY row_number() OVER (PARTITION BY stored_id ORDER BY CASE WHEN action = 'upgrade' THEN 0 ELSE 1 END, date, hash) = 1")
def preview_upgrades(spark, d):
    """Arrivals as a stream of four spans of days, one batch each: first writers of texts, previews that full texts replace."""
    path = scratch(spark, "arrivals")
    span = F.least(F.floor(F.datediff("at", F.to_date(F.lit("2024-01-01"))) / 25), F.lit(3))
    ingestion.written_in_order(_arrivals(spark, d).withColumn("span", span), path, "span", 4)
    changes = streams.drain(ingestion.ingested(ingestion.arrivals_stream(spark, path)), "preview-upgrades")
    return ingestion.store(changes).select("stored_id", "action", "content", "hash", F.to_date("at").alias("date"))


@query("WITH " + views.EVIDENCE_SQL + " SELECT definition_id, date + CAST(i AS INTEGER) AS date, count(DISTINCT publisher_id) AS publishers, count(DISTINCT story_fingerprint) AS stories, count(*) AS rows FROM evidence, range(7) t(i) WHERE date + CAST(i AS INTEGER) <= (SELECT max(date) FROM evidence) GROUP BY 1, 2")
def late_evidence_windows(spark, d):
    """A window series that follows a stream of evidence in which every batch is late for some days and one comes twice."""
    e = views.evidence(spark, d).select("document_id", "definition_id", "publisher_id", "story_fingerprint", "date")
    path, last = scratch(spark, "evidence"), str(e.agg(F.max("date")).first()[0])
    parted = e.withColumn("part", F.pmod(F.xxhash64("document_id"), F.lit(3)))
    ingestion.written_in_order(parted.unionByName(parted.where("part = 1").withColumn("part", F.lit(3))), path, "part", 4)
    schema = "document_id bigint, definition_id string, publisher_id string, story_fingerprint string, date date"
    view = windows.WindowView(spark, scratch(spark, "windows"), schema, "document_id", ["definition_id"], {"publishers": "publisher_id", "stories": "story_fingerprint"}, 7, last)
    view.follow(ingestion.arrivals_stream(spark, path), f"{path}-checkpoint").awaitTermination()
    return view.series.read()


_POSTS = views.TEXTS_SQL + ", posts AS (SELECT publisher AS publication, 'post-' || CAST(document_id AS VARCHAR) AS slug, CAST(date AS VARCHAR) || 'T08:00:00Z' AS post_date, title FROM texts WHERE document_id IS NOT NULL AND publisher IS NOT NULL)"


@query("WITH " + _POSTS + " SELECT publication, slug, post_date, title FROM posts WHERE post_date > '2024-01-20T08:00:00Z'")
def archive_scan(spark, d):
    """Archives of all publications, read in polls of at most 500 posts of each, back to a watermark."""
    t = views.texts(spark, d).where("document_id IS NOT NULL AND publisher IS NOT NULL")
    posts = t.select(F.col("publisher").alias("publication"), F.concat(F.lit("post-"), F.col("document_id").cast("string")).alias("slug"), F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T08:00:00Z")).alias("post_date"), "title")
    path = scratch(spark, "archive")
    posts.repartitionByRange("publication", F.desc("post_date"), F.desc("slug")).sortWithinPartitions("publication", F.desc("post_date"), F.desc("slug")).write.partitionBy("publication").json(f"{path}/pages")
    stream = lambda: archive.archive_stream(spark, f"{path}/pages", "2024-01-20T08:00:00Z", 500)
    archive.drain_polls(spark, stream, f"{path}/posts", f"{path}/checkpoint")
    return spark.read.schema(archive.POST).option("basePath", f"{path}/posts").parquet(f"{path}/posts").select("publication", "slug", "post_date", "title")
