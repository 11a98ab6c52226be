"""Connectors over payloads written from the tables, as they come from their services, and sinks read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import views
from ..session import scratch
from ..sources import readers, sinks
from .registry import query

_DOCS = views.TEXTS_SQL + ", docs AS (SELECT * FROM texts WHERE document_id IS NOT NULL AND publisher IS NOT NULL)"
_ID = lambda source, url: f"'{source}:' || substr(sha256({url}), 1, 24)"


def _docs(spark, d):
    return views.texts(spark, d).where("document_id IS NOT NULL AND publisher IS NOT NULL")


def _payloads(df, value, path: str, *keys: str) -> str:
    """Writes one JSON payload a key, a file each, and returns the folder."""
    df.select(*keys, F.to_json(value).alias("value")).repartition(*keys).write.partitionBy(*keys).text(path)
    return path


def _lines(df, path: str) -> str:
    df.write.json(path)
    return path


@query("WITH " + _DOCS + f""", a AS (SELECT document_id, CASE WHEN document_id % 7 = 0 THEN '' ELSE ' http://www.' || publisher || '.test/' || CAST(document_id // 2 AS VARCHAR) || ' ' END AS u, CASE WHEN document_id % 7 = 0 AND document_id % 2 = 0 THEN 'http://m.' || publisher || '.test/' || CAST(document_id AS VARCHAR) ELSE '' END AS m, CASE WHEN document_id % 11 = 0 THEN ' ' ELSE 'Title ' || CAST(document_id AS VARCHAR) END AS title, date, CASE WHEN document_id % 5 = 0 THEN publisher || '.org' ELSE '' END AS domain, publisher, document_id % 13 = 0 AS undated FROM docs),
b AS (SELECT *, CASE WHEN trim(u) <> '' THEN trim(u) ELSE nullif(trim(m), '') END AS url FROM a WHERE NOT undated AND trim(title) <> ''),
c AS (SELECT *, CASE WHEN domain <> '' THEN domain WHEN url LIKE 'http://m.%' THEN 'm.' || publisher || '.test' ELSE publisher || '.test' END AS host FROM b WHERE url IS NOT NULL)
SELECT {_ID('gdelt-news', 'url')} AS document_id, title, host AS publisher, url, date, 'metadata_only' AS retention FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY date DESC, title) = 1""")
def discovery_scan(spark, d):
    """News discovery payloads: addresses, mobile ones where they are missing, each once."""
    n, p = F.col("document_id"), F.col("publisher")
    url = F.when(n % 7 == 0, "").otherwise(F.concat(F.lit(" http://www."), p, F.lit(".test/"), F.floor(n / 2).cast("string"), F.lit(" ")))
    mobile = F.when((n % 7 == 0) & (n % 2 == 0), F.concat(F.lit("http://m."), p, F.lit(".test/"), n.cast("string"))).otherwise("")
    title = F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit("Title "), n.cast("string")))
    seen = F.when(n % 13 == 0, "soon").otherwise(F.concat(F.date_format("date", "yyyyMMdd"), F.lit("T120000Z")))
    domain = F.when(n % 5 == 0, F.concat(p, F.lit(".org"))).otherwise("")
    x = _docs(spark, d).withColumns({"url": url, "url_mobile": mobile, "title": title, "seendate": seen, "domain": domain})
    x = x.groupBy(F.col("publisher").alias("key")).agg(F.collect_list(F.struct("url", "url_mobile", "title", "seendate", "domain")).alias("articles"))
    found = readers.discovered(spark, _payloads(x, F.struct("articles"), scratch(spark, "discovery"), "key"))
    return found.select("document_id", "title", "publisher", "url", F.to_date("published").alias("date"), "retention")


@query("WITH " + _DOCS + f""", a AS (SELECT 'http://n.test/' || CAST(document_id // 3 AS VARCHAR) AS url, 'T' || CAST(document_id AS VARCHAR) AS title, date, CASE document_id % 4 WHEN 0 THEN 'abstract' WHEN 1 THEN 'snippet' WHEN 2 THEN '' ELSE 'both' END AS body, document_id % 8 AS page, CASE WHEN document_id % 6 = 0 THEN 'The New York Times' ELSE publisher END AS publisher FROM docs)
SELECT {_ID('nyt-search', 'url')} AS document_id, title, publisher, url, date, body AS text FROM a WHERE page < 5 AND body <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY date DESC, title) = 1""")
def article_search_scan(spark, d):
    """Article search payloads, a page each: abstracts, snippets where they are missing, five pages at most."""
    n = F.col("document_id")
    abstract = F.when(n % 4 == 0, "abstract").when(n % 4 == 3, "both").otherwise("")
    snippet = F.when(n % 4 == 1, " snippet ").when(n % 4 == 3, "other")
    doc = F.struct(F.concat(F.lit("http://n.test/"), F.floor(n / 3).cast("string")).alias("web_url"), F.struct(F.concat(F.lit("T"), n.cast("string")).alias("main")).alias("headline"), abstract.alias("abstract"), snippet.alias("snippet"), F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T12:00:00+0000")).alias("pub_date"), F.when(n % 6 != 0, F.col("publisher")).alias("source"))
    x = _docs(spark, d).groupBy((n % 8).cast("int").alias("page")).agg(F.collect_list(doc).alias("docs")).withColumn("key", F.col("page"))
    found = readers.searched(spark, _payloads(x, F.struct("page", F.struct("docs").alias("response")), scratch(spark, "search"), "key"), 9)
    return found.select("document_id", "title", "publisher", "url", F.to_date("published").alias("date"), "text")


@query("WITH " + _DOCS + f""", a AS (SELECT 'https://www.s' || CAST(document_id % 4 AS VARCHAR) || '.test/' || CAST(document_id // 2 AS VARCHAR) AS url, 'T' || CAST(document_id AS VARCHAR) AS title, date + INTERVAL 9 HOUR AS published, CASE WHEN document_id % 3 = 0 THEN 'body' ELSE 'T' || CAST(document_id AS VARCHAR) END AS text, CASE WHEN document_id % 5 = 0 THEN 's' || CAST(document_id % 4 AS VARCHAR) || '.test' ELSE publisher END AS publisher FROM docs)
SELECT {_ID('fmp-news', 'url')} AS document_id, title, publisher, text, CAST(published AS DATE) AS date FROM a WHERE published >= TIMESTAMP '2024-03-20 12:00:00' - INTERVAL 480 HOUR QUALIFY row_number() OVER (PARTITION BY url ORDER BY published DESC, title) = 1""")
def market_news_scan(spark, d):
    """News of tickers within a lookback; the title stands for a missing text, the host for a missing site."""
    n = F.col("document_id")
    x = _docs(spark, d).select(F.lit("A").alias("symbol"), F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 09:00:00")).alias("publishedDate"), F.concat(F.lit("T"), n.cast("string")).alias("title"), F.when(n % 3 == 0, "body").otherwise(" ").alias("text"), F.when(n % 5 != 0, F.col("publisher")).alias("site"), F.concat(F.lit("https://www.s"), (n % 4).cast("string"), F.lit(".test/"), F.floor(n / 2).cast("string")).alias("url"))
    found = readers.market_news(spark, _lines(x, scratch(spark, "news")), "2024-03-20 12:00:00", 480)
    return found.select("document_id", "title", "publisher", "text", F.to_date("published").alias("date"))


@query("SELECT ticker, year, quarter, content FROM (SELECT DISTINCT 'C' || CAST(o_custkey % 40 AS VARCHAR) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, 'call of ' || CAST(year(o_orderdate) AS VARCHAR) AS content FROM orders) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY year DESC, quarter DESC) <= 8")
def transcript_scan(spark, d):
    """The newest eight quarters' transcripts of each ticker."""
    o = views.table(spark, d, "orders")
    x = o.select(F.concat(F.lit("C"), (F.col("o_custkey") % 40).cast("string")).alias("ticker"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.lit("").alias("date"), F.concat(F.lit("call of "), F.year("o_orderdate").cast("string")).alias("content")).distinct()
    return readers.transcripts(spark, _lines(x, scratch(spark, "transcripts"))).select("ticker", "year", "quarter", "content")


_FORMS = "CASE o_orderkey % 7 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' WHEN 2 THEN 'S-1' WHEN 3 THEN '13F-HR' WHEN 4 THEN '6-K' WHEN 5 THEN 'NT 10-Q' ELSE 'SC 13D' END"


@query(f"""WITH f AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS ticker, {_FORMS} AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed, CAST(o_orderkey AS VARCHAR) AS number, CASE o_orderstatus WHEN 'F' THEN '2.02' WHEN 'O' THEN '5.02' ELSE '4.01' END AS items FROM orders)
SELECT ticker, form, filed, number, CASE WHEN form IN ('10-K', '6-K', 'NT 10-Q') THEN 'high' WHEN form IN ('S-1', 'SC 13D') THEN 'medium' WHEN items = '2.02' THEN 'high' WHEN items = '5.02' THEN 'medium' ELSE 'low' END AS relevance FROM f WHERE form <> '13F-HR' AND filed >= '1995-01-01' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filed DESC, number) <= 5""")
def filing_scan(spark, d):
    """Filings from parallel arrays: the enabled forms since a day, the newest five of each ticker, with relevance."""
    o = views.table(spark, d, "orders")
    items = F.when(F.col("o_orderstatus") == "F", "2.02").when(F.col("o_orderstatus") == "O", "5.02").otherwise("4.01")
    row = F.struct(F.expr(_FORMS).alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.col("o_orderkey").cast("string").alias("accessionNumber"), F.lit("a.htm").alias("primaryDocument"), items.alias("items"), F.lit("").alias("description"))
    x = o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), (F.col("o_custkey") % 16).alias("key")).agg(F.collect_list(row).alias("r"))
    names = ("form", "filingDate", "accessionNumber", "primaryDocument", "items", "description")
    value = F.struct("ticker", *[F.col(f"r.{c}").alias(c) for c in names])
    path = scratch(spark, "filings")  # payloads of several companies to a file, as arrays
    x.groupBy("key").agg(F.to_json(F.collect_list(value)).alias("value")).repartition("key").write.partitionBy("key").text(path)
    found = readers.filings(spark, path, readers.enabled_forms(), "1995-01-01", 5)
    return found.select("ticker", "form", F.col("filingDate").alias("filed"), F.col("accessionNumber").alias("number"), "relevance")


@query("SELECT DISTINCT upper(replace(p_brand, '#', '')) AS ticker, 'listed' AS via FROM part")
def ticker_universe(spark, d):
    """Tickers of the first list that has any, here the constituents."""
    p = views.table(spark, d, "part")
    x = p.select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("symbol"), F.col("p_type").alias("name"), F.lit("s").alias("sector"))
    own = readers.constituents(spark, _lines(x, scratch(spark, "constituents")))
    return readers.universe(own.where("false").select("ticker"), own.select("ticker"), p.select(F.col("p_type").alias("ticker"))).withColumn("via", F.lit("listed"))


@query("SELECT DISTINCT source AS name, 'https://' || source || '.test' AS url, CASE WHEN length(source) % 2 = 0 THEN 'owner ' || source END AS owner FROM documents WHERE source IS NOT NULL")
def publication_list(spark, d):
    """Publications from a YAML file that lists them."""
    x = _docs(spark, d).select("publisher").distinct()
    even = F.length("publisher") % 2 == 0
    entry = F.concat_ws("\n", F.concat(F.lit("  - name: "), "publisher"), F.concat(F.lit("    url: 'https://"), "publisher", F.lit(".test'")), F.when(even, F.concat(F.lit("    owner: owner "), "publisher")))
    path = scratch(spark, "publications")
    x.agg(F.concat(F.lit("publications:\n"), F.array_join(F.array_sort(F.collect_list(entry)), "\n")).alias("value")).write.text(path)  # a list kept by hand
    return readers.publications(spark, path).where("url IS NOT NULL").select("name", "url", "owner")


@query("WITH " + _DOCS + ", a AS (SELECT *, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS turn, 'http://x.test/' || md5(title) AS url FROM docs) SELECT CAST(document_id AS VARCHAR) AS document_id, CASE turn WHEN 0 THEN 'english' ELSE 'others' END AS connector_id, url FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY turn, CAST(document_id AS VARCHAR)) = 1")
def connector_poll(spark, d):
    """All connectors polled, the first of an address kept."""
    t = _docs(spark, d)
    rows = lambda x: x.select(F.col("document_id").cast("string").alias("document_id"), F.lit("s").alias("source"), "source_class", "title", "publisher", F.concat(F.lit("http://x.test/"), F.md5("title")).alias("url"), F.col("date").cast("timestamp").alias("published"), "text", F.lit("snippet").alias("retention"))
    two = [readers.Connector("english", "newspaper", lambda _: rows(t.where("lang = 'en'"))), readers.Connector("others", "newspaper", lambda _: rows(t.where("NOT lang <=> 'en'")))]
    return readers.poll_all(spark, two).select("document_id", "connector_id", "url")


@query("SELECT user_id, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY 1")
def snapshot_rebuild(spark, d):
    """A table built in versions: a first snapshot, rows added once, rows changed, a rebuilt snapshot swapped in."""
    e = views.table(spark, d, "events")
    per = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").cast("long").alias("last"))
    own = {f.name: f.dataType.simpleString() for f in per.schema}
    t = sinks.Table(spark, scratch(spark, "snapshot"), ", ".join(f"{k} {v}" for k, v in own.items()))
    t.replace(per.where("n % 2 = 0").withColumn("n", F.col("n") + 1))
    added = t.insert_ignore(per, ["user_id"])
    changed = t.upsert(per, ["user_id"])
    if added + changed != per.count():
        raise AssertionError("rows were written that had not changed")
    t.replace(t.read())
    return t.read()


@query("SELECT event_type AS kind, count(*) AS n, CAST(floor(sum(value)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_export(spark, d):
    """A report written as JSON and read back."""
    e = views.table(spark, d, "events")
    path = scratch(spark, "export")
    sinks.export_json(e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.floor(F.sum("value")).alias("total")), path)
    return spark.read.schema("kind string, n long, total long").json(path)
