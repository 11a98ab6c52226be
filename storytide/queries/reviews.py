"""Review, lifecycle and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, evaluation, normalise, review
from ..plans import views
from .registry import query, r

AS_OF = "2024-01-30"


def _review_rows(spark, d):
    """Observations under review: the status by the document's id, the snippet from the text it is part of."""
    e = views.evidence(spark, d)
    return e.select("definition_id", F.col("document_id").alias("observation_id"), "document_id", F.col("date").alias("published"), F.lit(True).alias("matched"), F.when(F.col("document_id") % 5 == 0, "approved").when(F.col("document_id") % 7 == 0, "rejected").otherwise("pending").alias("review_status"), F.col("match_score").alias("score"), F.concat(F.lit("quote "), (F.col("document_id") % 13).cast("string")).alias("snippet"), F.concat(F.lit("text with quote "), (F.col("document_id") % 12).cast("string"), F.lit(" in it")).alias("content"), "story_fingerprint", "publisher_owner", (F.col("document_id") % 31 == 3).alias("blocked"), F.date_add("date", 2).alias("observed"))


_REVIEW = (
    views.EVIDENCE_SQL
    + """, rows_ AS (SELECT definition_id, document_id AS observation_id, document_id, date AS published, CASE WHEN document_id % 5 = 0 THEN 'approved' WHEN document_id % 7 = 0 THEN 'rejected' ELSE 'pending' END AS review_status, match_score AS score,
  'quote ' || CAST(document_id % 13 AS VARCHAR) AS snippet, 'text with quote ' || CAST(document_id % 12 AS VARCHAR) || ' in it' AS content, story_fingerprint, publisher_owner, document_id % 31 = 3 AS blocked, date + 2 AS observed FROM evidence)"""
)


@query(
    "WITH " + _REVIEW + f""", ok AS (SELECT * FROM rows_ WHERE review_status IN ('pending', 'approved') AND score >= 90 AND published BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' AND NOT blocked AND contains(content, snippet)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY definition_id, story_fingerprint ORDER BY score DESC, published DESC, observation_id) AS k FROM ok) WHERE k = 1),
passed AS (SELECT definition_id, count(DISTINCT story_fingerprint) AS stories, count(DISTINCT publisher_owner) AS owners FROM best GROUP BY 1 HAVING count(DISTINCT story_fingerprint) >= 2 AND count(DISTINCT publisher_owner) >= 2)
SELECT b.definition_id, observation_id, document_id, story_fingerprint, score, stories, owners FROM best b JOIN passed p ON b.definition_id = p.definition_id WHERE review_status = 'pending'"""
)
def auto_review_corroboration(spark, d):
    return review.corroborated(_review_rows(spark, d), AS_OF)


_ENDS = f"ends AS (SELECT published AS window_end, count(*) AS observations FROM rows_ WHERE observed BETWEEN DATE '{AS_OF}' - 14 AND DATE '{AS_OF}' AND published < DATE '{AS_OF}' - 7 GROUP BY 1 ORDER BY 1 DESC LIMIT 120)"


@query(
    "WITH " + _REVIEW + f""", {_ENDS}, ok AS (SELECT e.window_end, r.* FROM rows_ r JOIN ends e ON r.published BETWEEN e.window_end - 7 AND e.window_end WHERE review_status IN ('pending', 'approved') AND score >= 90),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_end, definition_id, story_fingerprint ORDER BY score DESC, published DESC, observation_id) AS k FROM ok) WHERE k = 1)
SELECT window_end, definition_id, count(DISTINCT story_fingerprint) AS stories, count(DISTINCT publisher_owner) AS owners, count(*) FILTER (review_status = 'pending') AS pending FROM best GROUP BY 1, 2 HAVING count(DISTINCT story_fingerprint) >= 2 AND count(DISTINCT publisher_owner) >= 2"""
)
def historical_review_windows(spark, d):
    x = _review_rows(spark, d)
    return review.corroborated_windows(x, review.historical_windows(x, AS_OF, 14, 7))


@query(
    "WITH " + views.EVIDENCE_SQL + """, stored AS (SELECT definition_id, document_id, 's' || CAST(document_id % 4 AS VARCHAR) AS snippet, 'h' || CAST(document_id % 6 AS VARCHAR) AS hash, 1 AS version, CASE document_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN document_id % 2 = 0 THEN 'human' ELSE 'auto' END AS actor FROM evidence WHERE document_id % 10 <> 9),
fresh AS (SELECT definition_id, document_id, 's' || CAST(document_id % 5 AS VARCHAR) AS snippet, 'h' || CAST(document_id % 9 AS VARCHAR) AS hash, CASE WHEN document_id % 11 = 0 THEN 2 ELSE 1 END AS version FROM evidence),
j AS (SELECT f.*, coalesce(s.actor = 'human' AND s.status IN ('approved', 'rejected') AND s.hash = f.hash AND s.version = f.version, false) AS kept, s.status, s.snippet AS old FROM fresh f LEFT JOIN stored s USING (definition_id, document_id))
SELECT CASE WHEN kept THEN status ELSE 'pending' END AS review_status, kept, kept AND snippet = old AS inherited, count(*) AS n FROM j GROUP BY 1, 2, 3"""
)
def review_inheritance(spark, d):
    e = views.evidence(spark, d)
    tag = lambda p, k: F.concat(F.lit(p), (F.col("document_id") % k).cast("string"))
    status = F.element_at(F.array(F.lit("approved"), F.lit("rejected"), F.lit("pending")), (F.col("document_id") % 3 + 1).cast("int"))
    stored = e.where("document_id % 10 <> 9").select("definition_id", "document_id", tag("s", 4).alias("snippet"), tag("h", 6).alias("text_hash"), F.lit(1).alias("definition_version"), status.alias("review_status"), F.when(F.col("document_id") % 2 == 0, "human").otherwise("auto").alias("actor_type"))
    fresh = e.select("definition_id", "document_id", tag("s", 5).alias("snippet"), tag("h", 9).alias("text_hash"), F.when(F.col("document_id") % 11 == 0, 2).otherwise(1).alias("definition_version"))
    return review.inherit_reviews(fresh, stored).groupBy("review_status", "kept", "inherited").agg(F.count("*").alias("n"))


@query(
    "WITH " + _REVIEW + f""", defs AS (SELECT DISTINCT definition_id, CASE WHEN length(definition_id) % 2 = 0 THEN 'structural' ELSE 'event' END AS kind, CASE WHEN definition_id IN ('view', 'signup') THEN 'probationary' ELSE 'active' END AS status, CASE WHEN definition_id = 'click' THEN DATE '2024-01-15' ELSE DATE '2024-03-01' END AS expires FROM rows_),
recent AS (SELECT definition_id, count(DISTINCT story_fingerprint) AS stories, count(DISTINCT publisher_owner) AS owners FROM rows_ WHERE review_status = 'approved' AND published BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' GROUP BY 1)
SELECT d.definition_id, status, CASE WHEN status IN ('active', 'probationary') AND kind = 'event' AND expires <= DATE '{AS_OF}' THEN 'expired' WHEN status = 'probationary' AND stories >= 3 AND owners >= 3 THEN 'active' ELSE status END AS new_status, coalesce(stories, 0) AS stories, coalesce(owners, 0) AS owners FROM defs d LEFT JOIN recent r ON d.definition_id = r.definition_id"""
)
def activation_gate(spark, d):
    x = _review_rows(spark, d)
    defs = x.select("definition_id").distinct().select("definition_id", F.when(F.length("definition_id") % 2 == 0, "structural").otherwise("event").alias("kind"), F.when(F.col("definition_id").isin("view", "signup"), "probationary").otherwise("active").alias("status"), F.when(F.col("definition_id") == "click", F.to_date(F.lit("2024-01-15"))).otherwise(F.to_date(F.lit("2024-03-01"))).alias("expires"))
    return review.definition_lifecycle(defs, x, AS_OF)


@query("WITH " + views.EVIDENCE_SQL + ", x AS (SELECT definition_id, count(DISTINCT story_fingerprint) AS stories, count(DISTINCT publisher_owner) AS owners FROM evidence WHERE match_score >= 50 GROUP BY 1 HAVING count(DISTINCT story_fingerprint) >= 3 AND count(DISTINCT publisher_owner) >= 3) SELECT * FROM x")
def having_multi_distinct(spark, d):
    x = views.evidence(spark, d).where("match_score >= 50").groupBy("definition_id").agg(F.count_distinct("story_fingerprint").alias("stories"), F.count_distinct("publisher_owner").alias("owners"))
    return x.where("stories >= 3 AND owners >= 3")


def _candidates(spark, d):
    """Candidate evidence: a candidate for every user and narrative."""
    e = views.evidence(spark, d)
    return e.select(F.concat_ws(":", "publisher_id", "definition_id").alias("candidate_id"), "document_id", F.col("date").alias("published"), F.col("match_score").alias("score"), "story_fingerprint", F.concat(F.lit("o"), (F.col("document_id") % 9).cast("string")).alias("publisher_owner"))


_CAND = views.EVIDENCE_SQL + ", cand AS (SELECT publisher_id || ':' || definition_id AS candidate_id, document_id, date AS published, match_score AS score, story_fingerprint, 'o' || CAST(document_id % 9 AS VARCHAR) AS publisher_owner FROM evidence)"


def _definition_documents(spark, d):
    """The documents of structural definitions: of every class and narrative those with a good score."""
    e = views.evidence(spark, d).where("match_score >= 30")
    return e.select(F.concat_ws("/", "definition_id", "source_class").alias("definition_id"), "definition_id", "document_id").toDF("definition_id", "name", "document_id")


_DEFDOC = ", defdoc AS (SELECT definition_id || '/' || source_class AS definition_id, definition_id AS name, document_id FROM evidence WHERE match_score >= 30)"


@query("WITH " + _CAND + f" SELECT candidate_id, count(DISTINCT document_id) AS documents, count(DISTINCT story_fingerprint) AS stories, count(DISTINCT publisher_owner) AS owners, max(published) AS latest, count(DISTINCT story_fingerprint) >= 2 AND count(DISTINCT publisher_owner) >= 2 AS qualified FROM cand WHERE published BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' GROUP BY 1")
def candidate_breadth(spark, d):
    return candidates.queue(_candidates(spark, d), AS_OF)


@query("WITH " + _CAND + " SELECT candidate_id, CAST(max(published) - min(published) AS DOUBLE) AS span_days, count(DISTINCT floor((published - DATE '1970-01-01') / 7)) AS weeks FROM cand GROUP BY 1")
def persistence_span(spark, d):
    return candidates.persistence(_candidates(spark, d))


_SHARED = ", size_ AS (SELECT candidate_id, count(DISTINCT document_id) AS n FROM cand GROUP BY 1), shared AS (SELECT c.candidate_id, f.definition_id, f.name, count(DISTINCT c.document_id) AS shared FROM cand c JOIN defdoc f ON c.document_id = f.document_id GROUP BY 1, 2, 3)"


@query("WITH " + _CAND + _DEFDOC + _SHARED + " SELECT candidate_id, definition_id, shared, n FROM shared JOIN size_ USING (candidate_id) WHERE shared >= greatest(3, ceil(n * 2 / 3.0))")
def evidence_collision(spark, d):
    return candidates.evidence_collisions(_candidates(spark, d), _definition_documents(spark, d)).select("candidate_id", "definition_id", "shared", "n")


@query("WITH " + _CAND + _DEFDOC + _SHARED + " SELECT candidate_id, definition_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY shared DESC, name, definition_id) AS k FROM shared JOIN size_ USING (candidate_id) WHERE shared >= greatest(2, ceil(n * 0.5))) WHERE k = 1")
def structural_attachment(spark, d):
    return candidates.attachments(_candidates(spark, d), _definition_documents(spark, d)).select("candidate_id", "definition_id", "shared")


@query(
    "WITH " + _CAND + _DEFDOC + _SHARED + f""", strong AS (SELECT candidate_id, count(DISTINCT story_fingerprint) AS stories, count(DISTINCT publisher_owner) AS owners FROM cand WHERE score >= 60 AND published BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' GROUP BY 1 HAVING count(DISTINCT story_fingerprint) >= 2 AND count(DISTINCT publisher_owner) >= 2),
span AS (SELECT candidate_id, CAST(max(published) - min(published) AS DOUBLE) AS span_days, count(DISTINCT floor((published - DATE '1970-01-01') / 7)) AS weeks FROM cand GROUP BY 1),
attached AS (SELECT candidate_id, definition_id AS attached_to FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY shared DESC, name, definition_id) AS k FROM shared JOIN size_ USING (candidate_id) WHERE shared >= greatest(2, ceil(n * 0.5))) WHERE k = 1),
collided AS (SELECT DISTINCT candidate_id FROM shared JOIN size_ USING (candidate_id) WHERE shared >= greatest(3, ceil(n * 2 / 3.0)))
SELECT s.candidate_id, stories, owners, span_days, weeks, attached_to FROM strong s JOIN span USING (candidate_id) LEFT JOIN attached USING (candidate_id) WHERE (span_days >= 7 OR attached_to IS NOT NULL) AND candidate_id NOT IN (SELECT candidate_id FROM collided)"""
)
def auto_promotion(spark, d):
    policy = candidates.PromotionPolicy(least_score=60.0, least_stories=2, least_owners=2)
    return candidates.promotable(_candidates(spark, d), AS_OF, _definition_documents(spark, d), policy)


@query()
def promotion_evidence_selection(spark, d):
    """Greedy over three keys, so without SQL; tested against a loop."""
    x = _candidates(spark, d)
    return candidates.selected_evidence(x.select("candidate_id", "document_id", "score", F.col("published"), F.concat(F.lit("s"), (F.col("document_id") % 17).cast("string")).alias("snippet_key"), F.concat(F.lit("t"), (F.col("document_id") % 29).cast("string")).alias("title_key"), F.col("story_fingerprint").alias("near_key")))


def _described(table, key: str, text: str):
    """Names and propositions: the first line of a text and the whole of it."""
    return table.select(F.col(key), F.regexp_extract(text, r"^([^\n]*)", 1).alias("name"), F.col(text).alias("proposition"))


_TOK = "list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ('a','an','and','are','as','because','for','from','in','is','of','or','the','to')), lambda w: CASE WHEN w IN ('oil','crude','petroleum') THEN 'energy' WHEN w IN ('rates','hike','hikes','tightening') THEN 'rate' WHEN w IN ('prices','pricing') THEN 'price' ELSE w END))"
_SHORT = "SELECT {key}, {name} AS n, {text} AS t FROM (SELECT {key}, regexp_extract(text, '^([^\\n]*)', 1) AS name, text AS prop FROM {table})"


def _short(key: str, table: str) -> str:
    return _SHORT.replace("{key}", key).replace("{table}", table).replace("{name}", _TOK.replace("{x}", "name")).replace("{text}", _TOK.replace("{x}", "prop"))


_J = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
_O = "CASE WHEN len(list_intersect({a}, {b})) >= 3 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) ELSE 0 END"


def _pair(t, a, b):
    return "(" + t.replace("{a}", a).replace("{b}", b) + ")"


@query(f"WITH a AS ({_short('doc_id', 'documents')}), b AS ({_short('item_id', 'benchmark')}) SELECT doc_id AS candidate_id, item_id AS definition_id FROM a JOIN b ON {_pair(_J, 'a.n', 'b.n')} >= 0.5 OR {_pair(_O, 'a.n', 'b.n')} >= 0.5 OR {_pair(_J, 'a.t', 'b.t')} >= 0.55")
def overlap_coefficient_pairs(spark, d):
    a = _described(views.table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "candidate_id")
    return candidates.description_collisions(a, _described(views.table(spark, d, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "definition_id"))


@query("SELECT event_type AS stratum, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM (SELECT event_type, value >= 50 AS e, event_id % 3 = 0 AS p FROM events) GROUP BY 1 UNION ALL SELECT 'all', count(*) FILTER (e AND p), count(*) FILTER (NOT e AND p), count(*) FILTER (e AND NOT p), count(*) FILTER (NOT e AND NOT p) FROM (SELECT value >= 50 AS e, event_id % 3 = 0 AS p FROM events)")
def classifier_confusion(spark, d):
    e = views.table(spark, d, "events").select("event_type", (F.col("value") >= 50).alias("expected"), (F.col("event_id") % 3 == 0).alias("predicted"))
    return evaluation.stratified(e, "event_type").select("stratum", "tp", "fp", "fn", "tn")


_P = "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 1 END"
_R = "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 1 END"


@query(
    f"""WITH x AS (SELECT d.lang AS stratum, l.toxic = 1 AS e, regexp_matches(lower(d.text), 'idiot|moron|scum|loser|stupid') AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT stratum, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM (SELECT * FROM x UNION ALL SELECT 'all', e, p FROM x) GROUP BY 1), q AS (SELECT *, {_P} AS pr, {_R} AS re FROM c)
SELECT stratum, tp, fp, fn, tn, {r("pr")} AS precision, {r("re")} AS recall, {r("CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END")} AS f1, {r("CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn)")} AS accuracy FROM q"""
)
def classifier_scores(spark, d):
    docs, labels = views.table(spark, d, "documents"), views.table(spark, d, "labels")
    x = docs.join(labels, "doc_id").select("lang", (F.col("toxic") == 1).alias("expected"), F.lower("text").rlike("idiot|moron|scum|loser|stupid").alias("predicted"))
    return evaluation.stratified(x, "lang")


@query("WITH " + views.EVIDENCE_SQL + """, defs AS (SELECT DISTINCT definition_id AS slug FROM evidence), cases AS (SELECT definition_id AS own, definition_id AS e, CASE WHEN document_id % 4 = 0 THEN 'view' ELSE definition_id END AS p FROM evidence WHERE document_id % 6 <> 0)
SELECT slug, count(*) FILTER (e = slug AND p = slug) AS tp, count(*) FILTER (e <> slug AND p = slug) AS fp, count(*) FILTER (e = slug AND p <> slug) AS fn, count(*) FILTER (e <> slug AND p <> slug) AS tn FROM cases CROSS JOIN defs GROUP BY 1""")
def per_definition_scores(spark, d):
    e = views.evidence(spark, d)
    cases = e.select(F.when(F.col("document_id") % 6 != 0, F.array("definition_id")).alias("expected_slugs"), F.array(F.when(F.col("document_id") % 4 == 0, "view").otherwise(F.col("definition_id"))).alias("predicted_slugs"))
    x = evaluation.expand_cases(cases, e.select(F.col("definition_id").alias("slug")).distinct())
    return x.groupBy("slug").agg(*evaluation.confusion(F.col("expected"), F.col("predicted")))


@query("""WITH x AS (SELECT doc_id AS document_id, doc_id * 2 AS signal_id, 'Theme ' || CAST(doc_id % 7 AS VARCHAR) || ' & Co' AS label, CAST(doc_id % 130 AS DOUBLE) AS risk, 50.0 AS bull, 80.0 AS conf, substr(text, 3, 25) AS snippet, text FROM documents)
SELECT document_id, 'theme:theme-' || CAST(document_id % 7 AS VARCHAR) || '-and-co' AS theme_id FROM x WHERE risk <= 100 AND trim(snippet) <> '' AND contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(snippet, '\\s+', ' ', 'g'))))""")
def signal_validation(spark, d):
    t = views.table(spark, d, "documents")
    x = t.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") * 2).alias("signal_id"), F.concat(F.lit("Theme "), (F.col("doc_id") % 7).cast("string"), F.lit(" & Co")).alias("label"), (F.col("doc_id") % 130).cast("double").alias("risk_tone"), F.lit(50.0).alias("bullish_tone"), F.lit(80.0).alias("confidence"), F.substring("text", 3, 25).alias("snippet"), F.col("text").alias("content"))
    return normalise.valid_signals(x).select("document_id", "theme_id")


@query("WITH " + views.EVIDENCE_SQL + """, defs AS (SELECT DISTINCT definition_id FROM evidence), docs AS (SELECT document_id, 'content ' || CAST(document_id % 9 AS VARCHAR) AS content FROM evidence),
raw AS (SELECT document_id, definition_id, document_id % 2 = 0 AS m, document_id % 3 <> 0 AS s, document_id % 11 = 0 AS x, match_score AS score, 'CONTENT  ' || CAST(document_id % 8 AS VARCHAR) AS snippet FROM evidence),
j AS (SELECT d.document_id, f.definition_id, coalesce(m AND s AND NOT x AND score >= 70 AND contains(lower(content), lower(regexp_replace(snippet, '\\s+', ' ', 'g'))), false) AS matched, coalesce(score, 0) AS score FROM docs d CROSS JOIN defs f LEFT JOIN raw r ON r.document_id = d.document_id AND r.definition_id = f.definition_id)
SELECT document_id, definition_id, matched, CASE WHEN matched THEN score ELSE least(score, 69.0) END AS score FROM j""")
def observation_normalisation(spark, d):
    e = views.evidence(spark, d)
    docs = e.select("document_id", F.concat(F.lit("content "), (F.col("document_id") % 9).cast("string")).alias("content"))
    raw = e.select("document_id", "definition_id", (F.col("document_id") % 2 == 0).alias("matched"), (F.col("document_id") % 3 != 0).alias("satisfied"), (F.col("document_id") % 11 == 0).alias("excluded"), F.col("match_score").alias("score"), F.concat(F.lit("CONTENT  "), (F.col("document_id") % 8).cast("string")).alias("snippet"))
    return normalise.normalise_observations(raw, docs, e.select("definition_id").distinct()).select("document_id", "definition_id", "matched", "score")
