"""Texts and addresses of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, lists, similarity, text
from ..operators import ingest, relational, research, setjoin
from ..plans import views
from .registry import query


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 2000")
def scan_documents_filter(spark, d):
    return views.table(spark, d, "documents").where("lang = 'en' AND n_chars BETWEEN 500 AND 2000").select("doc_id", "n_chars")


@query("SELECT doc_id AS document_id, i AS chunk_index, i * 900 AS start, md5(substr(text, CAST(i * 900 + 1 AS BIGINT), 1000)) AS chunk_md5 FROM documents, range(CAST(greatest(0, ceil((length(text) - 1000) / 900.0)) AS BIGINT) + 1) t(i) WHERE length(text) > 0")
def chunk_documents(spark, d):
    x = ingest.chunk_rows(views.table(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), 1000, 100)
    return x.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.md5("content").alias("chunk_md5"))


@query("WITH c AS (SELECT doc_id, i, substr(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS content FROM documents, range(CAST(greatest(0, ceil((length(text) - 1000) / 900.0)) AS BIGINT) + 1) t(i) WHERE length(text) > 0) SELECT doc_id AS document_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM c GROUP BY 1")
def ordered_string_agg(spark, d):
    x = ingest.repair_texts(ingest.chunk_rows(views.table(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), 1000, 100))
    return x.select("document_id", F.md5("text").alias("text_md5"))


_BODY = "trim(regexp_replace(regexp_replace(text, '\\s+\\n', chr(10), 'g'), '[ \\t]+', ' ', 'g'))"


@query(f"SELECT content_hash, min(doc_id) AS document_id, count(*) AS copies FROM (SELECT doc_id, sha256({_BODY}) AS content_hash FROM documents) GROUP BY 1")
def content_hash_dedupe(spark, d):
    x = views.table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return x.groupBy("content_hash").agg(F.min("doc_id").alias("document_id"), F.count("*").alias("copies"))


_FOLD = "substr(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), 1, 180)"


@query("WITH " + views.TEXTS_SQL + f" SELECT sha256({_FOLD.replace('{x}', 'title')}) AS near_duplicate_key, count(*) AS documents, min(document_id) AS first_document FROM texts GROUP BY 1")
def near_duplicate_groups(spark, d):
    x = views.texts(spark, d).select("document_id", text.near_duplicate_key(F.col("title")).alias("near_duplicate_key"))
    return x.groupBy("near_duplicate_key").agg(F.count("*").alias("documents"), F.min("document_id").alias("first_document"))


@query("WITH " + views.TEXTS_SQL + " SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'key' || CAST(document_id % 10 AS VARCHAR) ELSE md5(lower(regexp_replace(title, '[^a-z0-9]+', ' ', 'g'))) END AS story FROM texts")
def story_fingerprint(spark, d):
    key = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("key"), (F.col("document_id") % 10).cast("string"))).otherwise("")
    return views.texts(spark, d).select("document_id", text.story_fingerprint(key, F.lit(""), F.col("title")).alias("story"))


@query("WITH " + views.TEXTS_SQL + """, i AS (SELECT document_id, sha256(text) AS h, sha256(CASE WHEN document_id % 5 = 0 THEN text || '!' ELSE text END) AS stored FROM texts),
s AS (SELECT document_id, stored FROM i WHERE document_id % 4 <> 1)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN h IN (SELECT stored FROM s) THEN 'skip' WHEN document_id IN (SELECT document_id FROM s) THEN 'revise' ELSE 'insert' END AS action FROM i) GROUP BY 1""")
def document_resolution(spark, d):
    x = views.texts(spark, d).select("document_id", F.sha2("text", 256).alias("content_hash"), F.sha2(F.when(F.col("document_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    stored = x.where("document_id % 4 <> 1").select("document_id", F.col("h").alias("content_hash"))
    return ingest.resolve(x.select("document_id", "content_hash"), stored).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host, rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref|source|campaign)=[^&]*', '\\1', 'gi'), '&{2,}', '&', 'g'), '\\?&+', '?', 'g'), '?&') AS canonical FROM pages")
def canonical_urls(spark, d):
    return views.table(spark, d, "pages").select("page_id", address.hostname(F.col("url")).alias("host"), address.canonical_url(F.col("url")).alias("canonical"))


_HTML = "regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
_HTML = f"regexp_replace({_HTML}, '(?s)<[^>]+>', ' ', 'g')"
for _n, _t in (("nbsp", " "), ("quot", '"'), ("#39", "''"), ("lt", "<"), ("gt", ">"), ("#160", " "), ("amp", "&")):
    _HTML = f"regexp_replace({_HTML}, '(?i)&{_n};', '{_t}', 'g')"


@query(f"SELECT page_id, md5(trim(regexp_replace({_HTML}, '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_to_text(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.md5(text.html_to_text(F.col("html"))).alias("text_md5"))


@query("SELECT page_id, CASE WHEN host LIKE '%.example.com' AND (starts_with(host, 'th')) THEN 'th-group' WHEN regexp_matches(lower(name), '(^|[^a-z0-9])fr([^a-z0-9]|$)') THEN 'french' ELSE trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') END AS owner FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?]*)', 1) AS name FROM pages)")
def publisher_owner_rules(spark, d):
    p = views.table(spark, d, "pages")
    name = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?]*)", 1)
    host = address.hostname(F.col("url"))
    return p.select("page_id", F.when(host.endswith(".example.com") & host.startswith("th"), "th-group").otherwise(address.owner_of(F.lit("http://none.test/"), name, (("french", (), ("fr",)),))).alias("owner"))


@query()
def publisher_owners(spark, d):
    """The published owner rules over the pages' addresses; ordered rules over many names, tested on their own."""
    p = views.table(spark, d, "pages")
    return p.select("page_id", address.owner_of(F.col("url"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("owner"))


@query()
def title_ngrams(spark, d):
    """Word pairs and triples of titles with their documents; the stop list is long, so tested against a loop."""
    return views.first_lines(spark, d).select("document_id", F.explode(text.title_ngrams(F.col("title"))).alias("gram")).groupBy("gram").agg(F.count_distinct("document_id").alias("documents"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ('a','an','and','are','as','because','for','from','in','is','of','or','the','to')))"


@query("WITH " + views.TEXTS_SQL + f", t AS (SELECT min(document_id) AS id, count(*) AS n, w FROM (SELECT document_id, list_sort({_TOK}) AS w FROM texts) WHERE len(w) > 0 GROUP BY w), p AS (SELECT a.id AS a, b.id AS b, a.n AS members_a, b.n AS members_b, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS j FROM t a JOIN t b ON a.id < b.id) SELECT a, b, members_a, members_b, floor(j * 1000 + 0.5) / 1000.0 AS similarity FROM p WHERE j >= 0.5")
def token_jaccard_pairs(spark, d):
    """Pairs of different title word sets with Jaccard similarity of a half at least, by the first document of each set."""
    from ..functions.numeric import half_up

    t = views.texts(spark, d).select("document_id", text.tokens(F.col("title"), synonyms=False).alias("w"))
    sets, members = setjoin.distinct_sets(t, "document_id", "w")
    sizes = members.groupBy("id").agg(F.count("*").alias("n"))
    of = lambda k: sizes.toDF(k, f"members_{k}")
    x = setjoin.jaccard_pairs(sets, sets, 0.5, one_way=True).join(of("a"), "a").join(of("b"), "b")
    return x.select("a", "b", "members_a", "members_b", half_up(F.col("similarity"), 3).alias("similarity"))


@query("WITH " + views.TEXTS_SQL + " SELECT document_id, regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)license|token') AND NOT regexp_matches(text, '(?i)idiot') AS passes FROM texts")
def regex_guards(spark, d):
    return views.texts(spark, d).select("document_id", text.passes_guard(F.col("text"), ["the", "license|token", "("], ["idiot"]).alias("passes"))


_TERM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9&%$.\\- ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("WITH " + views.TEXTS_SQL + f" SELECT document_id, (contains(t, 'the') OR contains(t, 'que')) AND (contains(t, 'tion') OR contains(t, 'schaft')) AS passes FROM (SELECT document_id, {_TERM} AS t FROM texts)")
def term_group_guards(spark, d):
    return views.texts(spark, d).select("document_id", text.passes_groups(F.col("text"), [["the", "que"], ["tion", "schaft"]]).alias("passes"))


@query("WITH " + views.TEXTS_SQL + " SELECT document_id, CASE WHEN instr(text, 'tion') > 0 THEN md5(substr(text, greatest(1, instr(text, 'tion') - 180), instr(text, 'tion') - greatest(1, instr(text, 'tion') - 180) + 184)) END AS context FROM texts")
def local_contexts(spark, d):
    return views.texts(spark, d).select("document_id", F.md5(text.local_context(F.col("text"), F.lit("tion"))).alias("context"))


@query()
def source_quotations(spark, d):
    """Quotations found again in their source, up to white space; Arrow-batched, tested on its own."""
    q = F.regexp_replace(F.substring("text", 5, 60), r"\s+", "  ")
    return views.texts(spark, d).select("document_id", text.source_quotation(F.col("text"), q).alias("quotation"))


@query()
def conversation_sections(spark, d):
    """Where the questions of dialogues begin; Arrow-batched, tested on its own."""
    c = views.table(spark, d, "conversations")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return whole.select("conv_id", text.transcript_boundary(F.col("text")).alias("b"), text.speakers(F.col("text")).alias("speakers"), "text").select("conv_id", "b.at", "b.method", F.size(text.transcript_spans(F.col("text"), F.col("b.at"))).alias("sections"), "speakers")


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text)) AS text_md5 FROM conversations GROUP BY 1")
def conversation_texts(spark, d):
    c = views.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))), lambda x: x["line"]), "\n")).alias("text_md5"))


_REPORT = {
    "revenue": "'Revenue increased ' || CAST(o_custkey % 40 + 7 AS INTEGER) || '.5% to $' || CAST(floor(o_totalprice) AS BIGINT) || ' million during the reported quarter.'",
    "2-HIGH": "'Operating cash flow declined 12.7% to $' || CAST(floor(o_totalprice) AS BIGINT) || ' million during the same quarter.'",
    "3-MEDIUM": "'Backlog and orders rose 12% on customer prepayments to $' || CAST(floor(o_totalprice) AS BIGINT) || ' million, as capital expenditure was lower.'",
    "4-NOT SPECIFIED": "'Net income is expected to be $' || CAST(floor(o_totalprice) AS BIGINT) || ' million, compared to $3.25 million in the year before.'",
    "5-LOW": "'The total debt capacity under the revolving credit facility was $4.6 billion at the end of it.'",
}
_REPORTS = "reports AS (SELECT o_orderkey AS document_id, 'C' || o_custkey AS company, CAST(o_orderdate AS DATE) AS published, CASE o_orderstatus WHEN 'F' THEN 'transcript' WHEN 'O' THEN 'filing' ELSE 'newspaper' END AS source_class, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS companies, " + _REPORT["revenue"] + " AS first_, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _REPORT.items() if k != "revenue") + " ELSE '' END AS second_ FROM orders)"
_FIRST = lambda p: f"length(regexp_extract(quote, '(?is)^(.*?){p}', 1))"
_FACTS = "WITH " + _REPORTS + f""", passages AS (SELECT document_id, company, published, place, quote FROM (SELECT document_id, company, published, 0 AS place, first_ AS quote FROM reports WHERE companies = 1 AND source_class <> 'newspaper' UNION ALL SELECT document_id, company, published, 1, second_ FROM reports WHERE companies = 1 AND source_class <> 'newspaper') WHERE length(quote) BETWEEN 45 AND 600 AND regexp_matches(quote, '(?i){lists.QUANTITY}') AND regexp_matches(quote, '(?i){lists.REPORTING_VERB}') AND NOT regexp_matches(quote, '(?i){lists.NOT_RESEARCH[0]}') AND NOT regexp_matches(quote, '(?i){lists.NOT_RESEARCH[1]}') AND len(regexp_extract_all(quote, '\\d[\\d,.]*')) <= 12),
found AS (SELECT *, list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(quote, '(?i){p}') THEN {{'at': {_FIRST(p)}, 'm': '{m}'}} END" for m, p in lists.METRICS)}], lambda x: x IS NOT NULL))[1].m AS metric FROM passages),
facts AS (SELECT document_id, company, published, place, quote, metric, CASE WHEN regexp_matches(quote, '(?i){lists.OUTLOOK}') THEN 'Outlook' ELSE 'Reported result' END AS basis FROM found WHERE metric IS NOT NULL AND NOT (metric = 'Demand and capacity' AND regexp_matches(quote, '(?i){lists.FINANCING}')))"""


def _reports(spark, d):
    """Reports of companies, as texts, one an order: revenue, and a second passage by the order's priority."""
    o = views.table(spark, d, "orders")
    one = lambda k: F.expr(_REPORT[k])
    second = F.lit("")
    for k in _REPORT:
        if k != "revenue":
            second = F.when(F.col("o_orderpriority") == k, one(k)).otherwise(second)
    company = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    tickers = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(company, F.lit("OTHER"))).otherwise(F.array(company))
    kind = F.when(F.col("o_orderstatus") == "F", "transcript").when(F.col("o_orderstatus") == "O", "filing").otherwise("newspaper")
    return o.select(F.col("o_orderkey").alias("document_id"), company.alias("company"), tickers.alias("tickers"), F.to_date("o_orderdate").alias("published"), kind.alias("source_class"), F.concat(one("revenue"), F.lit(" "), second).alias("text"))


@query(_FACTS + " SELECT document_id, company, metric, basis, quote FROM facts")
def research_facts(spark, d):
    """Facts in reports of one company each."""
    return research.facts(_reports(spark, d)).select("document_id", "company", "metric", "basis", "quote")


@query(
    _FACTS
    + f""", rel AS (SELECT *, CASE WHEN regexp_matches(quote, '(?i)prepayment|upfront license') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(quote, '(?i)year.over.year|relative to|compared to|increased|decreased|grew|declined') THEN 3 ELSE 0 END AS relevance, regexp_matches(quote, '(?i){lists.NEGATIVE}') AS contrary FROM facts),
best AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY published DESC, relevance DESC, document_id, place) = 1),
per AS (SELECT company, count(*) AS metrics, max(published) AS reported, list_sort(list(metric)) AS names, list(quote ORDER BY published DESC, relevance DESC, document_id, place) AS quotes FROM best GROUP BY 1 HAVING count(*) >= 2),
once AS (SELECT * FROM rel WHERE contrary QUALIFY row_number() OVER (PARTITION BY company, quote ORDER BY published DESC, relevance DESC, document_id, place) = 1),
against AS (SELECT company, count(*) AS n, string_agg(quote, ' | ' ORDER BY published DESC, relevance DESC, document_id, place) AS quotes FROM (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY company ORDER BY published DESC, relevance DESC, document_id, place) <= 2) GROUP BY 1),
leads AS (SELECT p.company, reported, metrics, array_to_string(names, ',') AS metric_names, array_to_string(p.quotes[1:4], ' | ') AS facts, coalesce(a.quotes, '') AS contrary, coalesce(a.n, 0) AS counter_evidence,
  CASE WHEN len(list_filter(p.quotes, lambda q: regexp_matches(q, '(?i)prepayment'))) > 0 AND list_contains(names, 'Demand and capacity') THEN 'prepayments' WHEN list_contains(names, 'Cash and investment') AND list_contains(names, 'Demand and capacity') THEN 'demand' ELSE 'figures' END AS asks FROM per p LEFT JOIN against a ON a.company = p.company)
SELECT *, row_number() OVER (ORDER BY reported DESC, metrics DESC, company) AS rank FROM leads ORDER BY reported DESC, metrics DESC, company LIMIT 5"""
)
def research_queue(spark, d):
    """The leads, with the passages that they rest on and those that speak against them."""
    x = research.leads(research.facts(_reports(spark, d)))
    quotes = lambda c: F.array_join(F.transform(c, lambda f: f["quote"]), " | ")
    return x.select("company", "reported", "metrics", F.array_join("metric_names", ",").alias("metric_names"), quotes("facts").alias("facts"), quotes("contrary").alias("contrary"), "counter_evidence", F.regexp_extract("question", "^([a-z]+)", 1).alias("asks"), F.col("rank").cast("long").alias("rank"))


@query("WITH " + views.TEXTS_SQL + " SELECT DISTINCT publisher AS company FROM texts WHERE publisher NOT IN (SELECT publisher FROM texts WHERE source_class = 'transcript' AND date BETWEEN DATE '2024-03-31' - 20 AND DATE '2024-03-31')")
def companies_without_transcript(spark, d):
    t = views.texts(spark, d).select(F.col("publisher").alias("company"), F.col("date").alias("published"), "source_class")
    return research.without_transcript(t.select("company").distinct(), t.where("source_class = 'transcript'"), "2024-03-31", 20)


_WIRE = "CASE " + " ".join(f"WHEN regexp_matches(substr(t, 1, 320), '{head}') OR regexp_matches(t, '{said}') THEN '{name}'" for name, head, said in lists.WIRES) + " END"


@query("WITH " + views.TEXTS_SQL + f" SELECT document_id, {_WIRE} AS wire FROM (SELECT document_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM texts)")
def wire_origins(spark, d):
    return views.texts(spark, d).select("document_id", text.wire_origin(F.col("text")).alias("wire"))


@query("WITH " + views.TEXTS_SQL + " SELECT document_id, document_id % 2 = 1 AND (len(list_filter(regexp_split_to_array(substr(text, 1, 200), '\\s+'), lambda w: w <> '')) < 0.9 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS preview FROM texts")
def preview_detection(spark, d):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return views.texts(spark, d).select("document_id", ingest.preview(F.col("document_id") % 2 == 0, F.substring("text", 1, 200), words).alias("preview"))


def reasons_sql(q: str = "text", c: str = "(title || ' ' || publisher)") -> str:
    """How many reasons speak against a quotation q for a conclusion c."""
    out = []
    for said, claimed, lacks, _ in lists.UNSUPPORTED:
        out.append(f"CASE WHEN regexp_matches({q}, '(?i){said}') AND regexp_matches({c}, '(?i){claimed}')" + (f" AND NOT regexp_matches({q}, '(?i){lacks}')" if lacks else "") + " THEN 1 ELSE 0 END")
    words, number, claimed, _ = lists.FRAGMENT
    out.append(f"CASE WHEN len(regexp_split_to_array(trim({q}), '\\s+')) < {words} AND NOT regexp_matches({q}, '(?i){number}') AND regexp_matches({c}, '(?i){claimed}') THEN 1 ELSE 0 END")
    return " + ".join(out)


@query("WITH " + views.TEXTS_SQL + f" SELECT document_id, {reasons_sql()} AS reasons FROM texts")
def evidence_quality_reasons(spark, d):
    q, i, p = F.col("text"), F.col("title"), F.col("publisher")
    return views.texts(spark, d).select("document_id", F.size(text.evidence_reasons(q, i, p)).alias("reasons"))


@query()
def folded_titles(spark, d):
    """Near-duplicate keys after compatibility decomposition, Arrow-batched; tested on its own."""
    x = views.first_lines(spark, d).select("document_id", text.near_duplicate_key(text.nfkd(F.col("title"))).alias("key"))
    return x.groupBy("key").agg(F.count("*").alias("documents"))


_HAS = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words)


@query(f"""SELECT form, CASE WHEN form IN ('10-K', 'NT 10-K') THEN 'high' WHEN form = 'DEF 14A' THEN 'medium' WHEN {_HAS(lists.HIGH_SIGNALS)} THEN 'high' WHEN {_HAS(lists.MEDIUM_SIGNALS)} THEN 'medium' ELSE 'low' END AS relevance, count(*) AS n
FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN 'NT 10-K' WHEN 2 THEN 'DEF 14A' WHEN 3 THEN '8-K' ELSE '425' END AS form, CASE p_size % 4 WHEN 0 THEN '2.02' WHEN 1 THEN '5.02' ELSE '4.01' END || ' ' || lower(p_type) AS t FROM part) GROUP BY 1, 2""")
def filing_relevance(spark, d):
    from ..sources.readers import relevance

    k, n = F.col("p_partkey") % 5, F.col("p_size") % 4
    form = F.when(k == 0, "10-K").when(k == 1, "NT 10-K").when(k == 2, "DEF 14A").when(k == 3, "8-K").otherwise("425")
    items = F.when(n == 0, "2.02").when(n == 1, "5.02").otherwise("4.01")
    return views.table(spark, d, "part").select(form.alias("form"), relevance(form, items, F.col("p_type")).alias("relevance")).groupBy("form", "relevance").agg(F.count("*").alias("n"))
