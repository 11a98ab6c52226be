"""Evidence judged by definitions' own rules, blocked hosts, sections of texts, bursts of titles, publication."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import address, jsondoc, lists, text
from ..operators import bursts, candidates, ingest, normalise, review, themes
from ..plans import views
from ..session import scratch
from ..sources import readers
from ..sources.sinks import DayTable
from .corpus import _BODY, _FOLD, _HTML, reasons_sql
from .narratives import _BURST_SQL
from .registry import SQL, query, r
from .reviews import _CAND, _described

#: Definitions with contracts: patterns and term groups, some of them no patterns at all.
DEFINITIONS = (
    ("tides", {"requiredPatterns": [r"\b(the|der|die|el|la|le)\b", " ("], "forbiddenPatterns": ["licen[sc]e"], "requiredTermGroups": [["  THE ", "der", "la"], ["tion", "schaft", "ment", "en"]]}, "Growth of demand"),
    ("plain", {}, "Returns grew with conviction"),
    ("numbers", {"requiredPatterns": [r"\d", " "], "forbiddenPatterns": ["^the", "["]}, "Orders rose"),
)


def _definitions(spark):
    return spark.createDataFrame([(d, json.dumps({"evidenceContract": c}), p) for d, c, p in DEFINITIONS], "definition_id string, metadata string, proposition string")


def _raw(spark, d):
    """What a model might have said of every text and definition; nothing of Spanish texts for 'plain'."""
    t = views.texts(spark, d).where("text IS NOT NULL").crossJoin(F.broadcast(_definitions(spark).select("definition_id"))).where("NOT (lang = 'es' AND definition_id = 'plain')")  # three definitions
    quote = F.concat(F.lit(" "), F.substring("text", 3, 300), F.lit("\n"))
    said = F.when((F.col("lang") == "fr") & (F.col("definition_id") == "plain"), F.upper(quote)).otherwise(quote)
    return t.select("document_id", "definition_id", (F.col("n_chars") >= 100).alias("matched"), F.lit(True).alias("satisfied"), F.when(F.col("text").contains("idiot"), F.array(F.lit(" abuse "))).otherwise(F.array(F.lit(" "))).alias("exclusions"), (F.col("document_id") % 137 + 0.5).alias("score"), said.alias("evidence"), F.col("title").alias("interpretation"), F.col("lang").alias("stance"), F.lit(120.0).alias("risk_tone"), F.lit(None).cast("double").alias("bullish_tone"), F.array("publisher", F.lit(" ")).alias("entities"))


_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


@query("WITH " + views.TEXTS_SQL + f""", defs AS (SELECT * FROM (VALUES ('tides', 'Growth of demand'), ('plain', 'Returns grew with conviction'), ('numbers', 'Orders rose')) v(definition_id, proposition)),
raw AS (SELECT *, {_TRIM("substr(CASE WHEN lang = 'fr' AND definition_id = 'plain' THEN upper(substr(text, 3, 300)) ELSE substr(text, 3, 300) END, 1, 800)")} AS evidence, least(document_id % 137 + 0.5, 100.0) AS own_score FROM texts, defs WHERE text IS NOT NULL),
flat AS (SELECT *, trim(regexp_replace(lower(evidence), '\\s+', ' ', 'g')) AS f FROM raw),
judged AS (SELECT *, NOT (lang = 'es' AND definition_id = 'plain') AS said, n_chars >= 100 AND NOT contains(text, 'idiot') AND own_score >= 70 AND evidence <> '' AND contains(text, evidence) AND {reasons_sql("evidence", "(title || ' ' || proposition)")} = 0
  AND CASE definition_id WHEN 'tides' THEN regexp_matches(evidence, '(?i)\\b(the|der|die|el|la|le)\\b') AND NOT regexp_matches(evidence, '(?i)licen[sc]e') AND (contains(f, 'the') OR contains(f, 'der') OR contains(f, 'la')) AND (contains(f, 'tion') OR contains(f, 'schaft') OR contains(f, 'ment') OR contains(f, 'en'))
    WHEN 'numbers' THEN regexp_matches(evidence, '\\d') AND NOT regexp_matches(evidence, '(?i)^the') ELSE true END AS good FROM flat)
SELECT document_id, definition_id, said AND good AS matched, CASE WHEN NOT said THEN 0 WHEN good THEN own_score ELSE least(own_score, 69.0) END AS score, CASE WHEN said AND good THEN md5(evidence) ELSE md5('') END AS evidence, 'neutral' AS stance, CASE WHEN said THEN 100.0 ELSE 0.0 END AS risk_tone, CASE WHEN said AND {_TRIM("publisher")} <> '' THEN 1 ELSE 0 END AS entities FROM judged""")
def guarded_observations(spark, d):
    """Observations under each definition's own patterns and term groups, the rules of evidence quality and the text."""
    docs = views.texts(spark, d).where("text IS NOT NULL").select("document_id", "text")
    x = normalise.classified_observations(_raw(spark, d), docs, _definitions(spark))
    return x.select("document_id", "definition_id", "matched", "score", F.md5("evidence").alias("evidence"), "stance", "risk_tone", F.size("entities").alias("entities"))


_URLS = ("https://www.youtube.com/watch", "https://m.youtube.com:443/watch", "https://notyoutube.com/watch", "https://youtu.be/x", "https://news.test/a", "http://site.test/x.youtube.com/y", "https://youtube.com", "https://news.test/b")
_HOSTED = views.TEXTS_SQL + ", hosted AS (SELECT lang AS definition_id, document_id, date, publisher, md5(title) AS story, text, CASE document_id % 8 " + " ".join(f"WHEN {k} THEN '{u}'" for k, u in enumerate(_URLS)) + " END AS url, CASE WHEN document_id % 5 = 0 THEN 'YouTube' ELSE 'web' END AS platform FROM texts WHERE text <> '')"
_LIKE = " OR ".join(f"url LIKE '%{mark}' || v || '{end}'" for mark in ("//", ".") for end in ("/%", ":%/%"))


@query("WITH " + _HOSTED + f""", ok AS (SELECT * FROM hosted WHERE date BETWEEN DATE '2024-02-10' - 7 AND DATE '2024-02-10' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest({lists.UNRELIABLE!r}) AS v) WHERE lower(publisher) = v OR lower(platform) = v OR {_LIKE})),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY definition_id, story ORDER BY date DESC, document_id) = 1),
passed AS (SELECT definition_id, count(*) AS stories, count(DISTINCT lower(publisher)) AS owners FROM best GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT lower(publisher)) >= 2)
SELECT definition_id, document_id, stories, owners FROM best JOIN passed USING (definition_id)""")
def blocked_host_review(spark, d):
    """Corroborated evidence whose platform, publisher and host are not blocked."""
    t = views.texts(spark, d).where("text <> ''")
    url = F.element_at(F.array(*map(F.lit, _URLS)), (F.col("document_id") % 8 + 1).cast("int"))
    x = t.select(F.col("lang").alias("definition_id"), F.col("document_id").alias("observation_id"), "document_id", F.col("date").alias("published"), F.lit(True).alias("matched"), F.lit("pending").alias("review_status"), F.lit(95.0).alias("score"), F.substring("text", 1, 20).alias("snippet"), F.col("text").alias("content"), F.md5("title").alias("story_fingerprint"), F.lower("publisher").alias("publisher_owner"), "publisher", url.alias("url"), F.when(F.col("document_id") % 5 == 0, "YouTube").otherwise("web").alias("platform"))
    return review.corroborated(x, "2024-02-10").select("definition_id", "document_id", "stories", "owners")


_CALL = "SELECT conv_id, string_agg(CASE turn % 4 WHEN 0 THEN 'Presentation' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) WHEN 1 THEN 'Questions and Answers  ' ELSE 'Prepared  remarks' || chr(9) END || role || ': ' || text, chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1"


@query(f"WITH c AS ({_CALL}), n AS (SELECT conv_id, regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g') AS t FROM c), h AS (SELECT conv_id, regexp_replace(regexp_replace(t, '(question-and-answer session|questions and answers)', chr(10) || chr(10) || '[Q&A]' || chr(10) || '\\1', 'gi'), '(prepared remarks|presentation)', chr(10) || chr(10) || '[Prepared Remarks]' || chr(10) || '\\1', 'gi') AS t FROM n) SELECT conv_id, md5({_TRIM('t')}) AS text_md5 FROM h")
def transcript_texts(spark, d):
    """Dialogues as transcripts of calls, with headings before questions and remarks."""
    c, at = views.table(spark, d, "conversations"), F.col("turn") % 4
    opened = F.when(at == 0, "Presentation\r\n\n\n\n").when(at == 1, "Questions and Answers  ").otherwise("Prepared  remarks\t")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", opened.alias("opened")))), lambda x: F.concat(x["opened"], x["role"], F.lit(": "), x["text"]))
    return c.groupBy("conv_id").agg(F.md5(text.transcript_text(F.array_join(lines, "\n"))).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN n <= 1200 THEN 'Full document' ELSE 'Section ' || CAST(k + 1 AS VARCHAR) END AS label, md5(CASE WHEN n <= 1200 THEN text ELSE substr(text, k * 450 + 1, 500) END) AS part FROM (SELECT doc_id, text, length(text) AS n, unnest(range(CASE WHEN length(text) <= 1200 THEN 1 ELSE CAST(greatest(0, ceil((length(text) - 500) / 450.0)) AS BIGINT) + 1 END)) AS k FROM documents WHERE text IS NOT NULL)")
def document_sections(spark, d):
    """Texts in overlapping sections, short ones whole; the production sizes are a hundred times these."""
    t = views.table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.explode(text.sections(F.col("text"), 1200, 500, 50)).alias("s")).select("doc_id", "s.label", F.md5("s.text").alias("part"))


_PART = "CASE p_size % 6 WHEN 0 THEN 'Management''s Discussion and Analysis' WHEN 1 THEN 'RISK FACTORS and business' WHEN 2 THEN 'results of operations' WHEN 3 THEN 'our Business' WHEN 4 THEN repeat('x', 50000) || ' business' ELSE 'nothing' END || ' ' || p_name"


@query("SELECT part, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(t, '{said.replace(chr(39), chr(39) * 2)}') THEN '{label}'" for label, said in lists.FILING_PARTS) + f" END AS part FROM (SELECT lower(substr({_PART}, 1, 50000)) AS t FROM part)) GROUP BY 1")
def filing_parts(spark, d):
    k = F.col("p_size") % 6
    said = F.when(k == 0, "Management's Discussion and Analysis").when(k == 1, "RISK FACTORS and business").when(k == 2, "results of operations").when(k == 3, "our Business").when(k == 4, F.concat(F.repeat(F.lit("x"), 50000), F.lit(" business"))).otherwise("nothing")
    return views.table(spark, d, "part").select(readers.filing_part(F.concat(said, F.lit(" "), "p_name")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


TITLES_AS_OF, TITLES = "2024-03-20", bursts.BurstPolicy(window=7, baseline=28, least_stories=2, least_owners=2, least_z=0.5)
_WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[''’]', '', 'g'), '[^a-z0-9&%$.\\- ]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND NOT list_contains(" + repr(lists.TITLE_STOPWORDS) + ", x) AND NOT regexp_full_match(x, '\\d+(\\.\\d+)?%?'))"
_GRAMS = "list_distinct(list_filter(flatten([" + ", ".join(f"list_transform(range(1, greatest(len(w) - {k - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in (2, 3)) + "]), lambda g: regexp_matches(g, '[a-z]{3,}')))"


@query(
    "WITH RECURSIVE "
    + views.TEXTS_SQL
    + f""", titled AS (SELECT document_id, date, publisher, {_WORDS} AS w FROM texts WHERE title IS NOT NULL),
terms AS (SELECT document_id, date, publisher, unnest({_GRAMS}) AS term FROM titled),
win AS (SELECT *, CAST(floor(datediff('day', date, DATE '{TITLES_AS_OF}') / 7) AS INTEGER) AS k FROM terms WHERE datediff('day', date, DATE '{TITLES_AS_OF}') BETWEEN 0 AND 34),
per AS (SELECT term, k, count(DISTINCT document_id) AS stories, count(DISTINCT publisher) AS owners FROM win GROUP BY 1, 2),
cur AS (SELECT term, stories, owners FROM per WHERE k = 0 AND stories >= 2 AND owners >= 2),
hist AS (SELECT c.term, h.k, coalesce(p.stories, 0) AS stories FROM cur c CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) h LEFT JOIN per p ON p.term = c.term AND p.k = h.k),
stat AS (SELECT term, avg(stories) AS mean, median(stories) AS med, max(stories) = 0 AS novel FROM hist GROUP BY 1),
dev AS (SELECT h.term, median(abs(h.stories - s.med)) * 1.4826 AS mad FROM hist h JOIN stat s USING (term) GROUP BY 1),
burst AS (SELECT term, stories, owners, mean, (stories - mean) / greatest(1, sqrt(greatest(mean, 0)), mad) AS z, novel FROM cur JOIN stat USING (term) JOIN dev USING (term)),
scored AS (SELECT term, stories, owners, {r('CASE WHEN novel THEN stories + z ELSE z END', 2)} AS score FROM burst WHERE novel OR z >= 0.5),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, owners DESC, len(string_split(term, ' ')) DESC, term) AS k FROM scored),
greedy AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(t VARCHAR, n BIGINT)[]) AS kept
  UNION ALL
  SELECT g.k + 1, CASE WHEN len(list_filter(g.kept, lambda x: x.n = b.stories AND (contains(x.t, b.term) OR contains(b.term, x.t)))) > 0 THEN g.kept ELSE list_append(g.kept, {{'t': b.term, 'n': b.stories}}) END
  FROM greedy g JOIN ranked b ON b.k = g.k + 1 WHERE len(g.kept) < 60
),
final AS (SELECT unnest(kept) AS x FROM greedy WHERE k = (SELECT max(k) FROM greedy))
SELECT s.term, s.stories, s.owners, s.score, row_number() OVER (ORDER BY s.k) AS rank FROM final JOIN ranked s ON s.term = x.t"""
)
def title_bursts(spark, d):
    """From titles to bursts: word pairs and triples, scored, ranked, without those that another says."""
    t = views.first_lines(spark, d).where("title IS NOT NULL").join(views.texts(spark, d).select("document_id", "date", "publisher"), "document_id")
    none = F.array().cast("array<string>")
    docs = t.select("document_id", "date", "title", F.col("document_id").cast("string").alias("story_fingerprint"), F.col("publisher").alias("publisher_owner"), none.alias("entities"), none.alias("theme_labels"))
    x = bursts.without_nested(bursts.scored_terms(bursts.burst_terms(docs), TITLES_AS_OF, TITLES), 60)
    return x.select("term", "stories", "owners", "score", F.col("rank").cast("long").alias("rank"))


SQL["title_ngrams"] = "WITH " + views.TEXTS_SQL + f", titled AS (SELECT document_id, {_WORDS} AS w FROM texts) SELECT gram, count(DISTINCT document_id) AS documents FROM (SELECT document_id, unnest({_GRAMS}) AS gram FROM titled) GROUP BY 1"


_TRENDS = "SELECT p_brand AS theme_id, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS date, CAST(count(*) AS DOUBLE) AS intensity FROM part WHERE p_size <= 40 GROUP BY 1, 2"


@query(f"""WITH t AS ({_TRENDS}), fresh AS (SELECT theme_id, date, CASE WHEN date = DATE '2024-01-20' THEN intensity + 1 ELSE intensity END AS intensity FROM t WHERE date BETWEEN DATE '2024-01-11' AND DATE '2024-02-10' AND NOT (theme_id = 'Brand#11' AND date = DATE '2024-01-25')),
f AS (SELECT count(*) AS n, max(date) AS newest FROM fresh), o AS (SELECT count(*) AS n FROM t WHERE date < DATE '2024-01-06'), gone AS (SELECT count(*) AS n FROM t WHERE theme_id = 'Brand#11' AND date = DATE '2024-01-25'),
new_ AS (SELECT count(*) AS n FROM fresh WHERE date = DATE '2024-01-20' OR date = DATE '2024-02-10'), upd AS (SELECT count(*) AS n FROM fresh WHERE date = DATE '2024-01-20')
SELECT 'few rows' AS state, 'in_place' AS how, new_.n AS changed, gone.n AS removed, o.n AS pruned FROM new_, gone, o
UNION ALL SELECT 'day stored', 'in_place', upd.n, gone.n, o.n FROM upd, gone, o
UNION ALL SELECT 'new day', 'rebuild', f.n, 0, o.n FROM f, o""")
def publication_rules(spark, d):
    """How trends are published, for stored tables with and without the last day and for few and many fresh rows."""
    t = views.table(spark, d, "part").where("p_size <= 40").groupBy(F.col("p_brand").alias("theme_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("date")).agg(F.count("*").cast("double").alias("intensity"))
    day = lambda v: F.to_date(F.lit(v))
    fresh = t.where(F.col("date").between(day("2024-01-11"), day("2024-02-10")) & ~((F.col("theme_id") == "Brand#11") & (F.col("date") == day("2024-01-25")))).withColumn("intensity", F.when(F.col("date") == day("2024-01-20"), F.col("intensity") + 1).otherwise(F.col("intensity")))
    out = []
    for state, last, least in (("few rows", False, 10**9), ("day stored", True, 1), ("new day", False, 1)):
        table = DayTable(spark, scratch(spark, "trends"), "theme_id string, intensity double, date date", "date")
        table.replace_days(*_all_days(t if last else t.where(F.col("date") < day("2024-02-10"))))
        x = themes.publish(table, fresh, ["theme_id", "date"], "2024-01-11", "2024-02-10", "2024-01-06", least)
        out.append((state, x["how"], x["changed"], x["removed"], x["pruned"]))
    return spark.createDataFrame(out, "state string, how string, changed long, removed long, pruned long")


def _all_days(df):
    return df, [str(x[0]) for x in df.select("date").distinct().collect()]


_WIDGET = "'<div id=\"w\" class=\"x " + lists.WIDGETS[0] + "-box\"><p>Subscribe now</p></div>' || html || '<P class=''post-ufi''>12 likes</P><p> Thanks for reading this! <b>More</b></p>'"


@query(f"SELECT page_id, md5(trim(regexp_replace({_HTML}, '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def widget_free_pages(spark, d):
    """Pages with a newsletter's widgets and closing calls around them: the text of the page alone."""
    html = F.concat(F.lit(f'<div id="w" class="x {lists.WIDGETS[0]}-box"><p>Subscribe now</p></div>'), F.col("html"), F.lit("<P class='post-ufi'>12 likes</P><p> Thanks for reading this! <b>More</b></p>"))
    return views.table(spark, d, "pages").select("page_id", F.md5(text.html_to_text(text.without_chrome(html))).alias("text_md5"))


_FILES = "SELECT p_partkey, name, type, CASE p_size % 9 WHEN 3 THEN name ELSE 'main.htm' END AS main FROM (SELECT p_partkey, p_size, CASE p_partkey % 8 WHEN 0 THEN 'Ex99-1.htm' WHEN 1 THEN 'exhibit_99.txt' WHEN 2 THEN 'merger-plan.html' WHEN 3 THEN 'ex10a.htm' WHEN 4 THEN 'chart.jpg' WHEN 5 THEN 'doc.htm' WHEN 6 THEN 'ex99_2.xml' ELSE 'ex-2.htm' END AS name, CASE p_size % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN ' ex- 10.1' WHEN 2 THEN NULL ELSE 'EX-31' END AS type FROM part)"


@query(f"""WITH f AS ({_FILES}), t AS (SELECT *, upper(regexp_replace(coalesce(type, ''), '\\s+', '', 'g')) AS u, lower(name) AS n FROM f),
k AS (SELECT *, CASE WHEN regexp_matches(u, '^EX-[0-9]') THEN u WHEN regexp_matches(n, 'ex(hibit)?[-_]?99') THEN CASE WHEN regexp_extract(n, 'ex(hibit)?[-_]?99([._-]?([12]))?', 3) <> '' THEN 'EX-99.' || regexp_extract(n, 'ex(hibit)?[-_]?99([._-]?([12]))?', 3) ELSE 'EX-99' END WHEN contains(n, 'ex10') OR contains(n, 'ex-10') THEN 'EX-10' WHEN contains(n, 'ex2') OR contains(n, 'ex-2') THEN 'EX-2' ELSE name END AS kind FROM t)
SELECT p_partkey, kind AS exhibit_type, CASE WHEN regexp_matches(lower(kind || ' ' || name), '99\\.1|99\\.2|earnings|presentation|investor') THEN 'high' WHEN regexp_matches(lower(kind || ' ' || name), '10\\.|2\\.1') THEN 'medium' ELSE 'low' END AS relevance FROM k WHERE name <> main AND regexp_matches(n, '\\.(htm|html|txt)$') AND (kind IN {tuple(lists.EXHIBIT_TYPES)!r} OR regexp_matches(n, '{"|".join(lists.EXHIBIT_NAMES)}'))""")
def filing_exhibits(spark, d):
    p, k, n = views.table(spark, d, "part"), F.col("p_partkey") % 8, F.col("p_size") % 4
    names = ("Ex99-1.htm", "exhibit_99.txt", "merger-plan.html", "ex10a.htm", "chart.jpg", "doc.htm", "ex99_2.xml", "ex-2.htm")
    name = F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    kind = F.when(n == 0, "text/html").when(n == 1, " ex- 10.1").when(n == 3, "EX-31")
    x = p.select("p_partkey", name.alias("name"), kind.alias("type"), F.when(F.col("p_size") % 9 == 3, name).otherwise("main.htm").alias("primary"))
    return readers.exhibits(x).select("p_partkey", "exhibit_type", "relevance")


@query("WITH " + views.TEXTS_SQL + """, feeds AS (SELECT DISTINCT publisher AS feed_id, length(publisher) % 2 = 0 AS fresh FROM texts WHERE publisher IS NOT NULL AND publisher <> 'src3'),
rows_ AS (SELECT t.publisher, document_id, date, CASE WHEN fresh THEN 12 ELSE 24 * 20 END AS hours, document_id % 5 = 0 AS empty_ FROM texts t JOIN feeds f ON f.feed_id = t.publisher WHERE document_id IS NOT NULL)
SELECT publisher AS source, document_id, 'https://news.test/' || CAST(document_id AS VARCHAR) AS url, date, CASE WHEN length(publisher) % 2 = 0 THEN 2000 ELSE 2500 END AS length FROM rows_ WHERE NOT empty_ AND date + INTERVAL 8 HOUR BETWEEN TIMESTAMP '2024-03-20 18:00:00' - to_hours(hours) AND TIMESTAMP '2024-03-20 18:00:00' QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY date DESC, 'https://news.test/' || CAST(document_id AS VARCHAR)) <= 7""")
def registered_feed_scan(spark, d):
    """Feeds of all publishers, written as RSS and read in one scan, each by its own lookback, cap and retention."""
    as_of = "2024-03-20 18:00:00"
    t = views.texts(spark, d).where("publisher IS NOT NULL AND document_id IS NOT NULL")
    n = F.col("document_id")
    body = F.when(n % 5 == 0, "<p> </p>").otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("0123456789"), 250), F.lit("</p>")))
    items = t.select(F.col("publisher").alias("feed"), F.concat(F.lit("Title & <"), n.cast("string")).alias("title"), F.concat(F.lit("https://news.test/"), n.cast("string")).alias("link"), F.date_format(F.col("date").cast("timestamp") + F.expr("INTERVAL 8 HOURS"), "EEE, d MMM yyyy HH:mm:ss Z").alias("pubDate"), body.alias("description"), n.cast("string").alias("guid"))
    path = scratch(spark, "feeds")
    items.repartition("feed").write.partitionBy("feed").format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    fresh = F.length("publisher") % 2 == 0
    feeds = t.select("publisher").distinct().where("publisher <> 'src3'").select(F.col("publisher").alias("feed_id"), F.col("publisher").alias("name"), F.lit("owner").alias("owner"), F.when(fresh, "snippet").otherwise("full_text").alias("retention"), F.when(fresh, F.to_timestamp(F.lit("2024-03-20 15:30:00"))).alias("last_published"), F.lit(20).alias("backfill_days"), F.lit(7).alias("most"))
    x = readers.registered(spark, f"{path}/feed=*", feeds, as_of)
    return x.select("source", F.col("document_id").cast("long").alias("document_id"), "url", F.to_date("published").alias("date"), F.length("text").alias("length"))


@query("WITH " + views.TEXTS_SQL + f""", k AS (SELECT document_id, date, 'https://news.test/' || CAST(document_id % 40 AS VARCHAR) AS address, CASE WHEN lang = 'es' THEN sha256(publisher || ':https://news.test/' || CAST(document_id % 40 AS VARCHAR) || ':' || CAST(date AS VARCHAR)) ELSE sha256({_BODY}) END AS content_hash, sha256({_FOLD.replace("{x}", "title")}) AS near_duplicate_key FROM texts WHERE text <> '')
SELECT content_hash, document_id, near_duplicate_key, address AS canonical_url FROM k QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY date, document_id) = 1""")
def first_writers(spark, d):
    """Of equal texts the first document; of those with metadata alone (here Spanish ones) the first of an address and day."""
    t = views.texts(spark, d).where("text <> ''")
    url = F.concat(F.lit("https://news.test/"), (F.col("document_id") % 40).cast("string"), F.lit("?utm_source=x#top"))
    docs = t.select("document_id", F.when(F.col("lang") != "es", F.col("text")).alias("text"), "title", F.col("publisher").alias("source"), F.col("date").alias("published"), url.alias("url"))
    x = ingest.first_writer(ingest.with_keys(docs), F.asc("published"), F.asc("document_id"))
    return x.select("content_hash", "document_id", "near_duplicate_key", "canonical_url")


@query("SELECT p_partkey, 'theme:' || CASE WHEN p_size % 2 = 0 THEN 'sector:' || trim(regexp_replace(replace(lower(p_brand || ':' || p_type), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') ELSE 'market:' || trim(regexp_replace(replace(lower(p_type), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') END AS theme_id FROM part")
def theme_ids(spark, d):
    level = F.when(F.col("p_size") % 2 == 0, "sector").otherwise("market")
    return views.table(spark, d, "part").select("p_partkey", normalise.normalised_theme_id(level, F.col("p_type"), F.col("p_brand")).alias("theme_id"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def global_sequence(spark, d):
    """All events numbered in the order of time."""
    e = views.table(spark, d, "events")
    return normalise.sequence(e.select("event_id", "ts"), F.col("ts"), F.col("event_id")).select("event_id", "seq")


_BLOCKED = ["example.com", "thth.test", "www.none.test"]


@query("SELECT page_id, " + " OR ".join(f"host = '{b}' OR ends_with(host, '.{b}')" for b in _BLOCKED) + " AS blocked FROM (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://www.Example.com/a' WHEN 2 THEN 'http://notexample.com/' ELSE 'https://a.thth.test/b' END AS u FROM pages))")
def blocked_hosts(spark, d):
    p, k = views.table(spark, d, "pages"), F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, "https://www.Example.com/a").when(k == 2, "http://notexample.com/").otherwise("https://a.thth.test/b")
    return p.select("page_id", address.blocked_host(url, _BLOCKED).alias("blocked"))


_WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND NOT list_contains(" + repr(lists.DISCOVERY_STOPWORDS) + ", w)))"
_NEAR = "(len({a}) > 0 AND len({b}) > 0 AND CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) >= {t})"


@query("WITH x AS (SELECT doc_id, " + _WORDS_OF.replace("{x}", "regexp_extract(text, '^([^\\n]*)', 1)") + " AS n, " + _WORDS_OF.replace("{x}", "text") + " AS t FROM documents), y AS (SELECT item_id, " + _WORDS_OF.replace("{x}", "regexp_extract(text, '^([^\\n]*)', 1)") + " AS n, " + _WORDS_OF.replace("{x}", "text") + " AS t FROM benchmark) SELECT doc_id AS candidate_id, item_id AS definition_id FROM x JOIN y ON " + _NEAR.format(a="x.n", b="y.n", t=0.74) + " OR " + _NEAR.format(a="x.t", b="y.t", t=0.72))
def discovery_duplicates(spark, d):
    """New candidates that say the same as what is there, documents against benchmark items."""
    a = _described(views.table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "candidate_id")
    return candidates.discovery_duplicates(a, _described(views.table(spark, d, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "definition_id"))


_NEWS = ("https://markets.wsj.com/a", "https://www.nytimes.com/b", "https://paper.test/c", "http://ft.com/d", "https://notft.com/e", "https://reuters.com:443/f")
_PUBS = ("Some Paper", "The FT", "Reuters.", "Bloomberg L.P.", "Soft Paper", "Barron's & Sons")
_PICK = lambda column, values: f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in enumerate(values)) + " END"
_BY_DOMAIN = " ".join(f"WHEN host = '{x}' OR ends_with(host, '.{x}') THEN '{owner}'" for owner, domains, _ in lists.OWNERS for x in domains)
_BY_NAME = " ".join("WHEN regexp_matches(lower(pub), '(^|[^a-z0-9])" + x.replace("'", "''").replace(".", "\\.") + f"([^a-z0-9]|$)') THEN '{owner}'" for owner, _, names in lists.OWNERS for x in names)


@query(f"SELECT p_partkey, CASE {_BY_DOMAIN} {_BY_NAME} ELSE trim(regexp_replace(replace(lower(pub), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') END AS owner FROM (SELECT p_partkey, regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, pub FROM (SELECT p_partkey, {_PICK('p_size % 6', _NEWS)} AS u, {_PICK('p_partkey % 6', _PUBS)} AS pub FROM part))")
def publisher_owner_table(spark, d):
    """The owners of publishers by address, by name and by neither."""
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    p = views.table(spark, d, "part")
    return p.select("p_partkey", address.owner_of(pick(F.col("p_size") % 6, _NEWS), pick(F.col("p_partkey") % 6, _PUBS)).alias("owner"))


@query("SELECT p_partkey, regexp_matches(p_type, '\\bST[A-Z]*\\b') AS whole, regexp_matches(p_type, 'ED\\b.*[0-9[:upper:]]$') AS ends FROM part")
def posix_words(spark, d):
    """Patterns with POSIX word borders and classes."""
    x = F.col("p_type")
    return views.table(spark, d, "part").select("p_partkey", x.rlike(text.posix_regex(r"\mST[A-Z]*\M")).alias("whole"), x.rlike(text.posix_regex(r"ED\M.*[0-9[:upper:]]$")).alias("ends"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, CASE WHEN event_type = 'click' THEN 7 END AS deep FROM events")
def json_paths(spark, d):
    """JSON documents with values put at paths: a new key, one below an object, one below what is no object."""
    e = views.table(spark, d, "events")
    own = F.when(F.col("event_type") == "click", jsondoc.with_path(F.col("props"), ["o"], F.lit("{}"))).otherwise(F.col("props"))
    x = jsondoc.with_path(own, ["kind"], F.to_json(F.struct(F.col("event_type").alias("v"))))
    x = jsondoc.with_path(x, ["kind", "v"], F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), create=False)
    x = jsondoc.with_path(jsondoc.with_path(x, ["o", "deep"], F.lit("7")), ["k", "below"], F.lit("1"))
    return e.select("event_id", jsondoc.number(x, "k").cast("long").alias("k"), jsondoc.get(x, "kind.v").alias("kind"), jsondoc.number(x, "o.deep").cast("int").alias("deep"))


SQL["burst_suppression"] = f"""WITH RECURSIVE {_BURST_SQL}, scored AS (SELECT term, CASE WHEN starts_with(term, 'entity') THEN 'entity' ELSE 'title_ngram' END AS kind, stories, owners, {r('mean', 2)} AS baseline_mean, {r('z', 2)} AS z_score, novel, {r('CASE WHEN novel THEN stories + z ELSE z END', 2)} AS score FROM burst WHERE novel OR z >= 0.5),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, owners DESC, len(string_split(term, ' ')) DESC, term) AS k FROM scored),
greedy AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(t VARCHAR, n BIGINT, g BOOLEAN)[]) AS kept
  UNION ALL
  SELECT g.k + 1, CASE WHEN b.kind = 'title_ngram' AND len(list_filter(g.kept, lambda x: x.g AND x.n = b.stories AND (contains(x.t, b.term) OR contains(b.term, x.t)))) > 0 THEN g.kept ELSE list_append(g.kept, {{'t': b.term, 'n': b.stories, 'g': b.kind = 'title_ngram'}}) END
  FROM greedy g JOIN ranked b ON b.k = g.k + 1 WHERE len(g.kept) < 60
),
final AS (SELECT unnest(kept) AS x FROM greedy WHERE k = (SELECT max(k) FROM greedy))
SELECT s.term, kind, stories, owners, baseline_mean, z_score, novel, score, row_number() OVER (ORDER BY s.k) AS rank FROM final JOIN ranked s ON s.term = x.t"""

SQL["promotion_evidence_selection"] = f"""WITH {_CAND}, items AS (SELECT candidate_id, list({{'d': [{{'id': document_id, 'score': score}}], 's': ['s' || document_id % 17], 't': ['t' || document_id % 29], 'n': [story_fingerprint]}} ORDER BY score DESC, published DESC, document_id) AS own FROM cand GROUP BY 1),
kept AS (SELECT candidate_id, list_reduce(own, lambda a, x: CASE WHEN len(a.d) < 10 AND NOT list_contains(a.s, x.s[1]) AND NOT list_contains(a.t, x.t[1]) AND NOT coalesce(list_contains(a.n, x.n[1]), false) THEN {{'d': list_concat(a.d, x.d), 's': list_concat(a.s, x.s), 't': list_concat(a.t, x.t), 'n': list_concat(a.n, x.n)}} ELSE a END) AS a FROM items)
SELECT candidate_id, d.id AS document_id, d.score AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT candidate_id, unnest(a.d) AS d, generate_subscripts(a.d, 1) AS rank FROM kept)"""

SQL["source_quotations"] = "SELECT doc_id AS document_id, CASE WHEN q = '' THEN NULL WHEN contains(text, q) THEN q ELSE nullif(regexp_extract(text, replace(regexp_escape(q), '\\ \\ ', '\\s+')), '') END AS quotation FROM (SELECT doc_id, text, " + _TRIM("regexp_replace(substr(text, 5, 60), '\\s+', '  ', 'g')") + " AS q FROM documents)"
SQL["publisher_owners"] = f"SELECT page_id, CASE {_BY_DOMAIN} {_BY_NAME} ELSE trim(regexp_replace(replace(lower(pub), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') END AS owner FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS pub FROM pages)"


_SPOKEN = "upper(substr(role, 1, 1)) || substr(role, 2) || CASE WHEN turn % 3 = 0 THEN ' Jr.' ELSE '' END || ': ' || text"


@query(f"SELECT conv_id, len(list_distinct(regexp_extract_all(string_agg({_SPOKEN}, chr(10) ORDER BY turn, role, text), '(^|\\n)[A-Z][A-Za-z .''-]{{2,80}}:'))) AS speakers FROM conversations GROUP BY 1")
def speaker_counts(spark, d):
    """The headings of speakers in dialogues."""
    c = views.table(spark, d, "conversations")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.expr(_SPOKEN).alias("line")))), lambda x: x["line"])
    return c.groupBy("conv_id").agg(text.speakers(F.array_join(lines, "\n")).cast("long").alias("speakers"))


_SECTIONED = """CASE doc_id % 7 WHEN 0 THEN '{"transcriptSections":{"sections":[{"label":"prepared_remarks","start":0,"end":' || n || '},{"label":"qa","start":' || n || ',"end":' || n_chars || '}]}}' WHEN 1 THEN '{"transcriptSections":{"sections":[{"label":"other","start":0,"end":1}]}}'
  WHEN 2 THEN '{"transcriptSections":{"sections":[{"label":"qa","start":0.5,"end":1}]}}' WHEN 3 THEN '{"transcriptSections":{"sections":[{"label":"qa","start":0,"end":' || (n_chars + 1) || '}]}}' WHEN 4 THEN '{"transcriptSections":{"sections":[]}}' WHEN 5 THEN '{"sections":1}' ELSE '{"transcriptSections":{"sections":[{"label":"qa","start":3,"end":3}]}}' END"""


@query(f"""WITH j AS (SELECT doc_id, n_chars, {_SECTIONED} AS j FROM (SELECT doc_id, n_chars, n_chars // 2 AS n FROM documents WHERE n_chars > 1)),
s AS (SELECT doc_id, n_chars, CAST(json_extract(j, '$.transcriptSections.sections') AS JSON[]) AS own FROM j),
g AS (SELECT doc_id, own, len(list_filter(own, lambda x: json_extract_string(x, '$.label') IN ('prepared_remarks', 'qa') AND regexp_full_match(json_extract_string(x, '$.start'), '[0-9]+') AND regexp_full_match(json_extract_string(x, '$.end'), '[0-9]+') AND TRY_CAST(json_extract_string(x, '$.end') AS BIGINT) <= n_chars AND TRY_CAST(json_extract_string(x, '$.end') AS BIGINT) > TRY_CAST(json_extract_string(x, '$.start') AS BIGINT))) AS good FROM s)
SELECT doc_id, CASE WHEN len(own) > 0 AND good = len(own) THEN len(own) END AS sections FROM g""")
def stored_sections(spark, d):
    """The sections that documents carry, where all of them are sound."""
    t = views.table(spark, d, "documents").where("n_chars > 1").withColumn("n", F.floor(F.col("n_chars") / 2).cast("int"))
    spans = text.stored_spans(F.expr(_SECTIONED), F.col("n_chars"))
    return t.select("doc_id", F.when(spans.isNotNull(), F.size(spans)).cast("long").alias("sections"))
