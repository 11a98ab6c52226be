"""Filing forms, research leads, terms, telemetry, publication and theme details."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsondoc, lists, text
from ..operators import bursts, relational, research, status, themes
from ..plans import views
from ..sources import readers
from .registry import query, r
from .themes import AS_OF, _rows, _scores_sql, scores

_FORMS = ["10-K", "10-Q", "8-K", "20-F", "40-F", "6-K", "DEF 14A", "DEFA14A", "S-1/A", "424B3", "F-1", "F-4/A", "SC 13D/A", "SC 13G", "NT 10-K", "10-K/A", "8-K/A", "20-F/A", "NT 20-F", "13F-HR", "4", "425", "CORRESP"]
_ITEMS = ["2.02", "5.02", "4.01", "9.01 and 1.01"]
_HAS = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words)
_LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH f AS (SELECT ({_LISTED(_FORMS)})[p_partkey % {len(_FORMS)} + 1] AS form, lower(({_LISTED(_ITEMS)})[p_size % 4 + 1] || ' ' || p_type) AS t FROM part),
c AS (SELECT *, CASE WHEN form IN ('DEF 14A', 'DEFA14A', 'PRE 14A') THEN 'proxy' WHEN form LIKE '424B%' OR form LIKE 'S-_' OR form LIKE 'S-_/A' OR form LIKE 'F-_' OR form LIKE 'F-_/A' THEN 'capital_markets' WHEN form LIKE 'SC 13%' THEN 'ownership'
  WHEN form LIKE 'NT %' OR form IN ('10-K/A', '10-Q/A', '8-K/A', '20-F/A', '40-F/A', '6-K/A') THEN 'stress' WHEN form IN ('13F-HR', '4') THEN 'structured_ownership' ELSE 'core' END AS category FROM f)
SELECT form, category, CASE category WHEN 'proxy' THEN 'governance_political_regulatory' WHEN 'capital_markets' THEN 'capital_markets_risk_appetite' WHEN 'ownership' THEN 'activism_ownership_change' WHEN 'stress' THEN 'accounting_operational_stress' WHEN 'structured_ownership' THEN 'structured_positioning' ELSE 'formal_disclosure' END AS use_case,
  CASE WHEN form IN ('10-K', '10-Q', '20-F', '40-F', '6-K') OR category = 'stress' THEN 'high' WHEN category IN ('proxy', 'capital_markets', 'ownership') THEN 'medium' WHEN {_HAS(lists.HIGH_SIGNALS)} THEN 'high' WHEN {_HAS(lists.MEDIUM_SIGNALS)} THEN 'medium' ELSE 'low' END AS relevance,
  form NOT IN ('13F-HR', '4', '425', 'CORRESP') AS enabled, count(*) AS n FROM c GROUP BY ALL""")
def filing_forms(spark, d):
    p = views.table(spark, d, "part")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    x = p.select(pick(_FORMS, F.col("p_partkey")).alias("form"), pick(_ITEMS, F.col("p_size")).alias("items"), "p_type")
    category = readers.form_category(F.col("form"))
    x = x.select("form", category.alias("category"), readers.use_case(category).alias("use_case"), readers.relevance(F.col("form"), F.col("items"), F.col("p_type")).alias("relevance"), F.col("form").isin(readers.enabled_forms()).alias("enabled"))
    return x.groupBy(*x.columns).agg(F.count("*").alias("n"))


_ADDED = '{"n":1.5,"t":true,"z":null,"o":{"a":[1,null,"x"]}}'


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"n\":1.5,\"t\":true,\"z\":null,\"o\":{\"a\":[1,null,\"x\"]}}' AS merged, '{\"n\":1.5,\"t\":true,\"z\":null,\"o\":{\"a\":[1,null,\"x\"]}}' AS without_k FROM events")
def json_merge_types(spark, d):
    """Numbers, booleans, nulls and nested values keep their types through merging and removing."""
    m = jsondoc.merged(F.col("props"), F.lit(_ADDED))
    return views.table(spark, d, "events").select("event_id", m.alias("merged")).select("event_id", "merged", jsondoc.without(F.col("merged"), "k").alias("without_k"))


@query("SELECT c_custkey AS source, c_custkey + n AS target, n AS steps FROM (SELECT c_custkey, least(20, 27 - c_custkey % 27, (SELECT max(c_custkey) FROM customer) + 1 - c_custkey) AS n FROM customer WHERE c_custkey % 27 <> 0)")
def long_merge_chains(spark, d):
    """Chains of up to 26 links, of which twenty are followed."""
    links = views.table(spark, d, "customer").where("c_custkey % 27 <> 0").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") + 1).alias("target"))
    x = relational.resolve_chain(links, "source", "target")
    return x.select("source", "target", F.col("steps").cast("long").alias("steps"))


def _reports(spark, d):
    """Reports made of figures: a company a nation, one report a supplier, sentences on lines of their own."""
    s = views.table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_acctbal").cast("long").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lines = [
        say("Revenue of the company increased to $", n, " million compared to the year before."),
        F.when(k % 3 != 1, say("The backlog of orders reached ", (k % 90 + 10).cast("string"), " million at the end of the quarter.")),
        F.when(k % 4 == 0, say("Free cash flow was $", (k % 70).cast("string"), " million after prepayment by customers.")),
        F.when(k % 5 == 0, say("Operating margin declined to ", (k % 30).cast("string"), " % in the second half of the year.")),
        F.when(k % 7 == 0, F.lit("Illustrative net income was $5 million in the reconciliation of the segments.")),
        F.when(k % 6 == 0, F.lit("Backlog was lower and debt under the revolving credit facility was $9 million.")),
    ]
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (k % 13).cast("int"))
    cls = F.element_at(F.array(*map(F.lit, ("filing", "transcript", "newspaper"))), (k % 3 + 1).cast("int"))
    return s.select(k.alias("document_id"), F.concat(F.lit("company"), F.col("s_nationkey").cast("string")).alias("company"), day.alias("published"), cls.alias("source_class"), F.concat_ws("\n", *lines).alias("text"))


def _first_place(q: str, p: str) -> str:
    return f"CASE WHEN regexp_matches({q}, '(?i){p}') THEN instr({q}, regexp_extract({q}, '(?i){p}')) END"


_REPORTS_SQL = """reports AS (SELECT s_suppkey AS document_id, 'company' || CAST(s_nationkey AS VARCHAR) AS company, DATE '2024-01-01' + CAST(s_suppkey % 13 AS INTEGER) AS published, (['filing', 'transcript', 'newspaper'])[s_suppkey % 3 + 1] AS source_class,
  list_filter(['Revenue of the company increased to $' || CAST(CAST(trunc(s_acctbal) AS BIGINT) AS VARCHAR) || ' million compared to the year before.',
    CASE WHEN s_suppkey % 3 <> 1 THEN 'The backlog of orders reached ' || CAST(s_suppkey % 90 + 10 AS VARCHAR) || ' million at the end of the quarter.' END,
    CASE WHEN s_suppkey % 4 = 0 THEN 'Free cash flow was $' || CAST(s_suppkey % 70 AS VARCHAR) || ' million after prepayment by customers.' END,
    CASE WHEN s_suppkey % 5 = 0 THEN 'Operating margin declined to ' || CAST(s_suppkey % 30 AS VARCHAR) || ' % in the second half of the year.' END,
    CASE WHEN s_suppkey % 7 = 0 THEN 'Illustrative net income was $5 million in the reconciliation of the segments.' END,
    CASE WHEN s_suppkey % 6 = 0 THEN 'Backlog was lower and debt under the revolving credit facility was $9 million.' END], lambda x: x IS NOT NULL) AS lines FROM supplier)"""
_FACTS_SQL = (
    _REPORTS_SQL
    + f""", quotes AS (SELECT document_id, company, published, unnest(lines) AS quote, generate_subscripts(lines, 1) - 1 AS place FROM reports WHERE source_class IN ('filing', 'transcript')),
placed AS (SELECT *, {", ".join(f"{_first_place('quote', p)} AS m{k}" for k, (_, p) in enumerate(lists.METRICS))} FROM quotes
  WHERE length(quote) BETWEEN 45 AND 600 AND regexp_matches(quote, '(?i){lists.QUANTITY}') AND regexp_matches(quote, '(?i){lists.REPORTING_VERB}') AND {" AND ".join(f"NOT regexp_matches(quote, '(?i){p}')" for p in lists.NOT_RESEARCH)}),
named AS (SELECT *, CASE least(m0, m1, m2, m3) WHEN m0 THEN 'Revenue' WHEN m1 THEN 'Demand and capacity' WHEN m2 THEN 'Cash and investment' WHEN m3 THEN 'Profitability' END AS metric FROM placed WHERE least(m0, m1, m2, m3) IS NOT NULL),
facts AS (SELECT document_id, company, published, metric, quote, min(place) AS place, CASE WHEN regexp_matches(quote, '(?i){lists.OUTLOOK}') THEN 'Outlook' ELSE 'Reported result' END AS basis FROM named
  WHERE NOT (metric = 'Demand and capacity' AND regexp_matches(quote, '(?i){lists.FINANCING}')) GROUP BY document_id, company, published, metric, quote)"""
)


@query("WITH " + _FACTS_SQL + " SELECT document_id, company, metric, basis, quote FROM facts")
def research_report_facts(spark, d):
    return research.facts(_reports(spark, d)).select("document_id", "company", "metric", "basis", "quote")


@query(
    "WITH "
    + _FACTS_SQL
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY company, metric ORDER BY published DESC, CASE WHEN regexp_matches(quote, '(?i)prepayment|upfront license') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(quote, '(?i)year.over.year|relative to|compared to|increased|decreased|grew|declined') THEN 3 ELSE 0 END DESC, document_id, place) AS k FROM facts),
per AS (SELECT company, count(*) AS metrics, max(published) AS reported, string_agg(metric, ',' ORDER BY metric) AS names, bool_or(regexp_matches(quote, '(?i)prepayment')) AS pre, bool_or(metric = 'Cash and investment') AS cash, bool_or(metric = 'Demand and capacity') AS demand FROM ranked WHERE k = 1 GROUP BY 1 HAVING count(*) >= 2),
against AS (SELECT company, least(count(DISTINCT quote), 2) AS n FROM facts WHERE regexp_matches(quote, '(?i){lists.NEGATIVE}') GROUP BY 1)
SELECT p.company, CASE WHEN pre AND demand THEN 'prepayments and backlog: ' WHEN cash AND demand THEN 'demand against cash and investment: ' ELSE 'figures against profitability: ' END || p.company AS question, reported, metrics, names AS metric_names, coalesce(a.n, 0) AS counter_evidence,
  CASE WHEN cash THEN 'cash_conversion' ELSE 'revenue_demand_margins' END AS invalidation, 'one_source_event,' || CASE WHEN cash THEN '' ELSE 'no_cash_passage,' END || CASE WHEN a.n IS NULL THEN 'no_contrary_passage,' ELSE '' END || 'management_reported,expectations_unchecked' AS gaps,
  CAST(row_number() OVER (ORDER BY reported DESC, metrics DESC, p.company) AS INTEGER) AS rank FROM per p LEFT JOIN against a ON a.company = p.company QUALIFY rank <= 5"""
)
def research_report_leads(spark, d):
    x = research.leads(research.facts(_reports(spark, d)))
    return x.select("company", "question", "reported", "metrics", F.array_join("metric_names", ",").alias("metric_names"), F.col("counter_evidence").cast("long").alias("counter_evidence"), "invalidation", F.array_join("gaps", ",").alias("gaps"), "rank")


_WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[''’]', '', 'g'), '[^a-z0-9&%$.\\- ]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT list_contains({stop}, w) AND NOT regexp_matches(w, '^[0-9]+(\\.[0-9]+)?%?$'))"


@query(f"""WITH t AS (SELECT p_partkey AS id, 'The $5 ' || p_name || ' sale of 2024-25 is up 12% and ' || p_type || ' 3.5' AS title, p_brand, p_type FROM part),
w AS (SELECT id, p_brand, p_type, {_WORDS.format(stop=_LISTED(lists.TITLE_STOPWORDS))} AS w FROM t),
g AS (SELECT id, unnest(list_concat(list_transform(range(len(w) - 1), lambda i: array_to_string(w[i + 1 : i + 2], ' ')), list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' ')))) AS term, 0 AS kind FROM w
  UNION ALL SELECT id, regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'), 1 FROM w UNION ALL SELECT id, trim(regexp_replace(lower(p_type), '[^a-z0-9&%$.\\- ]+', ' ', 'g')), 2 FROM w)
SELECT term, max(kind) AS kind, count(DISTINCT id) AS documents FROM (SELECT id, term, max(kind) AS kind FROM g WHERE kind > 0 OR regexp_matches(term, '[a-z]{{3,}}') GROUP BY 1, 2) GROUP BY 1""")
def burst_term_extraction(spark, d):
    """Terms of titles with amounts, years and percentages, of entities and of labels."""
    p = views.table(spark, d, "part")
    title = F.concat(F.lit("The $5 "), "p_name", F.lit(" sale of 2024-25 is up 12% and "), "p_type", F.lit(" 3.5"))
    docs = p.select(F.col("p_partkey").alias("document_id"), F.lit("2024-01-01").cast("date").alias("date"), F.lit("s").alias("story_fingerprint"), F.lit("o").alias("publisher_owner"), title.alias("title"), F.array("p_brand").alias("entities"), F.array("p_type").alias("theme_labels"))
    return bursts.burst_terms(docs).groupBy("term").agg(F.max("kind").alias("kind"), F.count_distinct("document_id").alias("documents"))


@query("WITH " + views.EVIDENCE_SQL + " SELECT definition_id, story_fingerprint, document_id FROM (SELECT *, row_number() OVER (PARTITION BY definition_id, story_fingerprint ORDER BY date DESC, match_score DESC, document_id) AS k FROM evidence) WHERE k = 1")
def dedupe_story_newest(spark, d):
    e = views.evidence(spark, d)
    return relational.first_per(e, ["definition_id", "story_fingerprint"], F.desc("date"), F.desc("match_score"), F.asc("document_id")).select("definition_id", "story_fingerprint", "document_id")


@query("WITH " + views.EVIDENCE_SQL + ", x AS (SELECT *, CASE document_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review_status FROM evidence) SELECT definition_id, review_status, document_id, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY definition_id, review_status ORDER BY date DESC, document_id) AS k FROM x WHERE review_status <> 'pending' AND match_score >= 20) WHERE k <= 6")
def reviewed_sample(spark, d):
    """The latest reviewed matches of each definition and outcome."""
    s = F.element_at(F.array(F.lit("approved"), F.lit("rejected"), F.lit("pending")), (F.col("document_id") % 3 + 1).cast("int"))
    x = views.evidence(spark, d).withColumn("review_status", s).where((F.col("review_status") != "pending") & (F.col("match_score") >= 20))
    return relational.top_per(x, ["definition_id", "review_status"], 6, F.desc("date"), F.asc("document_id"), rank="place").select("definition_id", "review_status", "document_id", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id AS document_id FROM documents ORDER BY md5('cases:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40")
def unlabelled_sample(spark, d):
    return relational.hashed_sample(views.table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), 40, "cases", "document_id")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM events WHERE value > 50) AS strong_events, (SELECT count(*) FROM pages) AS pages")
def scalar_counters(spark, d):
    t = lambda name: views.table(spark, d, name)
    return relational.counters(("documents", t("documents")), ("labels", t("labels")), ("strong_events", t("events").where("value > 50")), ("pages", t("pages")))


@query("SELECT 'all' AS asked, count(*) AS n FROM documents UNION ALL SELECT 'en', count(*) FROM documents WHERE lang = 'en'")
def optional_predicate(spark, d):
    x = views.table(spark, d, "documents")
    count = lambda name, value: x.where(relational.optional(F.col("lang"), value)).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n")
    return count("all", None).unionAll(count("en", "en"))


@query("SELECT count(*) AS n FROM events WHERE ts < least(date_trunc('day', TIMESTAMP '2024-01-10 15:00:00') + INTERVAL 1 DAY, TIMESTAMP '2024-01-10 18:30:00')")
def events_until_day_end(spark, d):
    return views.table(spark, d, "events").where(F.col("ts").cast("timestamp") < relational.day_end("2024-01-10 15:00:00", "2024-01-10 18:30:00")).agg(F.count("*").alias("n"))


@query("WITH " + views.SIGNALS_SQL + " SELECT document_id, array_to_string(list_sort(list_distinct(list_concat(list(theme_id), list_filter(list(canonical_subtheme_id), lambda x: x IS NOT NULL)))), ',') AS themes FROM signals GROUP BY 1")
def document_theme_arrays(spark, d):
    """The themes of each document from either column, as an array from a union."""
    s = views.signals(spark, d)
    both = s.select("document_id", "theme_id").union(s.where("canonical_subtheme_id is not null").select("document_id", "canonical_subtheme_id"))
    return both.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("theme_id")), ",").alias("themes"))


_PARTS = {
    "documents": ("t", "true"),
    "with_label": ("t JOIN labels l ON l.doc_id = t.document_id", "true"),
    "long_texts": ("t", "length(text) > 2000"),
    "approved": ("t JOIN labels l ON l.doc_id = t.document_id", "quality = 1"),
    "toxic": ("t JOIN labels l ON l.doc_id = t.document_id", "toxic = 1"),
    "recent": ("t", "date >= DATE '2024-03-01'"),
    "languages": ("t", "lang IS NOT NULL"),
}


@query("WITH " + views.TEXTS_SQL + ", t AS (SELECT * FROM texts), ids AS (SELECT DISTINCT source_class FROM texts)" + "".join(f", p_{k} AS (SELECT source_class, count({'DISTINCT lang' if k == 'languages' else '*'}) AS n FROM {a} WHERE {w} GROUP BY 1)" for k, (a, w) in _PARTS.items()) + " SELECT ids.source_class, " + ", ".join(f"coalesce(p_{k}.n, 0) AS {k}" for k in _PARTS) + " FROM ids " + " ".join(f"LEFT JOIN p_{k} ON p_{k}.source_class = ids.source_class" for k in _PARTS))
def telemetry_of_seven_parts(spark, d):
    t = views.texts(spark, d)
    labelled = t.join(views.table(spark, d, "labels").withColumnRenamed("doc_id", "document_id"), "document_id")
    part = lambda x, name, what=None: x.groupBy("source_class").agg((F.count("*") if what is None else F.count_distinct(what)).alias(name))
    parts = [part(t, "documents"), part(labelled, "with_label"), part(t.where(F.length("text") > 2000), "long_texts"), part(labelled.where("quality = 1"), "approved"), part(labelled.where("toxic = 1"), "toxic"), part(t.where("date >= date'2024-03-01'"), "recent"), part(t, "languages", "lang")]
    return status.telemetry(t.select("source_class").distinct(), "source_class", *parts)


@query("""WITH a AS (SELECT user_id AS job, ts AS moment, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'running' WHEN 'click' THEN 'failed' ELSE 'queued' END AS status, event_id FROM events)
SELECT job, CASE WHEN bool_or(status = 'succeeded') THEN 'succeeded' WHEN arg_max(status, (moment, event_id)) = 'running' THEN 'running' WHEN count(*) FILTER (status = 'failed') >= 3 THEN 'exhausted' WHEN arg_max(status, (moment, event_id)) = 'failed' THEN 'retry' ELSE 'queued' END AS state, count(*) FILTER (status = 'failed') AS attempts FROM a GROUP BY 1""")
def job_state_machine(spark, d):
    s = F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'running' WHEN 'click' THEN 'failed' ELSE 'queued' END")
    e = views.table(spark, d, "events")
    return status.job_states(e.select(F.col("user_id").alias("job"), F.struct("ts", "event_id").alias("at"), s.alias("status")))


@query("WITH " + views.EVIDENCE_SQL + ", days AS (SELECT DISTINCT definition_id, date FROM evidence), done AS (SELECT DISTINCT definition_id, date FROM evidence WHERE document_id % 2 = 0) SELECT d.definition_id, min(d.date) FILTER (o.date IS NULL) AS cursor FROM days d LEFT JOIN done o ON o.definition_id = d.definition_id AND o.date = d.date GROUP BY 1")
def backfill_cursors(spark, d):
    e = views.evidence(spark, d)
    return status.backfill_cursor(e.select("definition_id", "date").distinct(), e.where("document_id % 2 = 0").select("definition_id", "date").distinct(), "definition_id")


_PUBLISHED = """, stored AS (SELECT theme_id, DATE '1998-05-01' + CAST(i * 10 AS INTEGER) AS date, 1.0 AS intensity, 0.0 AS z_score FROM (SELECT DISTINCT theme_id FROM kept), range(8) t(i))"""


@query(_scores_sql((7,)) + _PUBLISHED + f" SELECT date, count(*) AS themes, {r('sum(intensity)')} AS intensity FROM (SELECT theme_id, date, intensity FROM kept WHERE date BETWEEN DATE '1998-06-15' AND DATE '{AS_OF}' UNION ALL SELECT theme_id, date, intensity FROM stored WHERE date < DATE '1998-06-15' AND date >= DATE '1998-05-20' OR date > DATE '{AS_OF}') GROUP BY 1")
def publication(spark, d):
    """Fresh rows of a range of days replace those stored; older ones are pruned."""
    fresh = scores(spark, d, 7).select("theme_id", "date", "intensity", "z_score")
    days = spark.range(8).select((F.date_add(F.lit("1998-05-01").cast("date"), (F.col("id") * 10).cast("int"))).alias("date"))
    stored = fresh.select("theme_id").distinct().crossJoin(F.broadcast(days)).select("theme_id", "date", F.lit(1.0).alias("intensity"), F.lit(0.0).alias("z_score"))  # eight days
    after, _ = themes.publication(stored, fresh.where("date >= date'1998-06-15'"), "1998-06-15", AS_OF, "1998-05-20")
    return after.groupBy("date").agg(F.count("*").alias("themes"), (F.floor(F.sum("intensity") * 1000 + 0.5) / 1000).alias("intensity"))


@query(
    _scores_sql()
    + f""", recent AS (SELECT * FROM contributions WHERE date BETWEEN DATE '{AS_OF}' - 29 AND DATE '{AS_OF}'),
e AS (SELECT theme_id, entity, count(*) AS n FROM (SELECT theme_id, unnest(entities) AS entity FROM recent) GROUP BY 1, 2),
te AS (SELECT theme_id, string_agg(entity, ',' ORDER BY k) AS top_entities FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY n DESC, entity) AS k FROM e) WHERE k <= 5 GROUP BY 1),
dd AS (SELECT theme_id, document_id, max(score) AS score FROM recent GROUP BY 1, 2),
td AS (SELECT theme_id, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY score DESC, document_id) AS k FROM dd) WHERE k <= 3 GROUP BY 1)
SELECT s.theme_id, CASE WHEN candidate THEN 'confirmed' WHEN low_history AND evidence_count > 0 THEN 'emerging' ELSE 'quiet' END AS kind, z_score, evidence_count, coalesce(top_entities, '') AS top_entities, coalesce(evidence, '') AS evidence
FROM kept s LEFT JOIN te ON te.theme_id = s.theme_id LEFT JOIN td ON td.theme_id = s.theme_id WHERE s.date = DATE '{AS_OF}' AND trend_window = '7d'"""
)
def theme_details(spark, d):
    return themes.details(scores(spark, d), _rows(spark, d), AS_OF)


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>|<script.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) > 0 AS has_text FROM pages")
def chrome_stripped_pages(spark, d):
    """Whether a page has text once widgets are gone (the pages have none of a newsletter's, so none is lost)."""
    return views.table(spark, d, "pages").select("page_id", (F.length(text.html_to_text(text.without_chrome(F.col("html")))) > 0).alias("has_text"))
